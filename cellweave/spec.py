"""What to compute: triggers, bands, block, scales, sections; its checks, the band plan and the names of outputs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import ceil

#: Statistics of a scale, by trigger.
STATISTICS = {
    "dmp": 2, "fourier": 2, "gabor": 16, "grad": 2, "hog": 5, "lac": 1, "lbp": 62, "lbpm": 5, "lsr": 3, "mean": 2, "orb": 5, "pantex": 1, "saliency": 2, "seg": 2, "sfs": 6,
    "ndvi": 2, "evi2": 2, "gndvi": 2,
}
#: Declared by name only: nothing is computed for these.
UNSUPPORTED = ("ctr", "hough", "sfsorf", "surf", "xy")
#: Colours that the spectral indices are made of.
INDEX_COLOURS = {"ndvi": ("nir", "red"), "gndvi": ("nir", "green"), "evi2": ("nir", "red")}
#: Bands (from 1) of the colours of common sensors.
SENSORS = {
    "rgb": {"red": 1, "green": 2, "blue": 3}, "bgr": {"blue": 1, "green": 2, "red": 3}, "pan": {}, "bgrn": {"blue": 1, "green": 2, "red": 3, "nir": 4}, "rgbn": {"red": 1, "green": 2, "blue": 3, "nir": 4},
    "landsat5": {"blue": 1, "green": 2, "red": 3, "nir": 4}, "landsat7": {"blue": 1, "green": 2, "red": 3, "nir": 4}, "landsat8": {"coastal": 1, "blue": 2, "green": 3, "red": 4, "nir": 5},
    "sentinel2-10m": {"blue": 1, "green": 2, "red": 3, "nir": 4}, "worldview2": {"coastal": 1, "blue": 2, "green": 3, "yellow": 4, "red": 5, "rededge": 6, "nir": 7, "nir2": 8},
    "quickbird": {"blue": 1, "green": 2, "red": 3, "nir": 4}, "ikonos": {"blue": 1, "green": 2, "red": 3, "nir": 4},
}
#: Range of a storage type; None: 0 to 255.
STORAGE_MAX = {"byte": 255.0, "uint16": 10000.0, "float32": 1.0, "float64": 1.0}


class SpecError(ValueError):
    """Parameters that can't be computed."""


@dataclass(frozen=True)
class FeatureSpec:
    """Parameters of one computation; scales are kept sorted.

    ``section_size`` is raised until the largest scale divides it, as tiles are made of whole windows. ``formulas``
    are further spectral indices: names, which are triggers then, with Spark SQL expressions over the sensor's colours.
    """

    triggers: tuple[str, ...] = ("mean",)
    bands: tuple[int, ...] = (1,)
    block: int = 2
    scales: tuple[int, ...] = (8,)
    section_size: int = 1000
    image_min: float = -999.0
    image_max: float = -999.0
    storage: str = "byte"
    smooth: int = 0
    equalize: bool = False
    equalize_adapt: bool = False
    visible_order: str = "bgr"
    line_threshold: float = 40.0
    line_skip: int = 4
    box: int = 2
    weight: bool = False
    neighbors: bool = False
    sensor_bands: dict[str, int] = field(default_factory=lambda: dict(SENSORS["bgrn"]))
    formulas: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        object.__setattr__(self, "scales", tuple(sorted(self.scales)))
        object.__setattr__(self, "triggers", tuple(self.triggers))
        object.__setattr__(self, "bands", tuple(self.bands))
        self.validate()
        s = self.scales[-1]
        object.__setattr__(self, "section_size", -(-self.section_size // s) * s)

    def validate(self) -> None:
        """Raises SpecError unless everything that is asked for can be computed."""
        if not self.triggers or not self.bands or not self.scales:
            raise SpecError("triggers, bands and scales must not be empty")
        for t in self.triggers:
            if t in UNSUPPORTED:
                raise SpecError(f"{t} has no implementation")
            if t not in STATISTICS and t not in self.formulas:
                raise SpecError(f"unknown trigger {t}; there are {', '.join(sorted(STATISTICS))}, or give a formula")
            if missing := [c for c in self.colours(t) if c not in self.sensor_bands]:
                raise SpecError(f"{t} needs {', '.join(missing)}, which the sensor does not have")
        if taken := [t for t in self.formulas if t in STATISTICS or t in UNSUPPORTED]:
            raise SpecError(f"{', '.join(taken)} can't be given a formula")
        if min(self.scales) < 1 or self.block < 1:
            raise SpecError("block and scales must be positive")
        if self.block > self.scales[-1]:
            raise SpecError("the block must not be larger than the largest scale")
        if len({k % 2 for k in self.scales}) > 1:
            raise SpecError("scales must be all odd or all even")
        if self.block % 2 and self.block > 1 and not self.scales[0] % 2:
            raise SpecError("an odd block needs odd scales")
        if self.smooth and (self.smooth < 3 or not self.smooth % 2):
            raise SpecError("smooth must be odd and 3 at least")
        if self.storage not in STORAGE_MAX:
            raise SpecError(f"storage {self.storage} is not supported")
        if self.section_size < 1:
            raise SpecError("section_size must be positive")

    def colours(self, trigger: str) -> tuple[str, ...]:
        """The colours that a spectral index is made of; none for other triggers."""
        if trigger in self.formulas:
            words = set(re.findall(r"[A-Za-z_]\w*", self.formulas[trigger]))
            return tuple(sorted(words & {c for sensor in SENSORS.values() for c in sensor} | words & self.sensor_bands.keys()))
        return INDEX_COLOURS.get(trigger, ())

    def statistics(self, trigger: str) -> int:
        """Statistics of a scale; a formula is measured like the other indices."""
        return 2 if trigger in self.formulas else STATISTICS[trigger]

    @property
    def largest(self) -> int:
        return self.scales[-1]

    @property
    def halo(self) -> int:
        """Pixels that neighbouring sections share on an axis."""
        return self.largest - self.block

    def offset(self, k: int) -> int:
        """Where a window of scale k starts in the window of the largest scale: all are concentric."""
        return self.largest // 2 - k // 2

    def range(self) -> tuple[float, float]:
        """Least and largest value of the image, by storage where they aren't given."""
        low = 0.0 if self.image_min == -999.0 else self.image_min
        return low, STORAGE_MAX[self.storage] if self.image_max == -999.0 else self.image_max

    def out_size(self, rows: int, cols: int) -> tuple[int, int]:
        """Rows and columns of the output grid of an image (0 if it is not larger than the halo)."""
        return max(0, ceil((rows - self.halo) / self.block)), max(0, ceil((cols - self.halo) / self.block))

    def step(self) -> int:
        """From one section to the next, in whole cells."""
        step = (self.section_size - self.halo) // self.block * self.block
        if step < 1:
            raise SpecError("section_size leaves no cells between the halos")
        return step

    def band_ranges(self) -> dict[str, tuple[int, int]]:
        """First and last output band (from 1) of every trigger."""
        out, at = {}, 0
        for t in self.triggers:
            n = self.statistics(t) * len(self.scales) * len(self.bands)
            out[t] = (at + 1, at + n)
            at += n
        return out

    def out_band(self, trigger: str, band: int, k: int, stat: int) -> int:
        """Output band (from 1) of a statistic (from 0): bands within a trigger, scales within a band, statistics within a scale."""
        n = self.statistics(trigger)
        return self.band_ranges()[trigger][0] + (self.bands.index(band) * len(self.scales) + self.scales.index(k)) * n + stat

    def base_name(self, image: str, with_triggers: bool = True) -> str:
        name = f"{image}__BD{'-'.join(map(str, self.bands))}_BK{self.block}_SC{'-'.join(map(str, self.scales))}"
        return f"{name}_TR{'-'.join(self.triggers)}" if with_triggers else name

    def tile_name(self, image: str, tile: int) -> str:
        """Name of a tile (from 1) with the range of its output bands."""
        last = max(hi for _, hi in self.band_ranges().values())
        return f"{self.base_name(image, False)}__ST1-{last:03d}__TL{tile:06d}"
