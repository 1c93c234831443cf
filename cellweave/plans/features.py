"""All triggers of a specification as one plan, in long form (trigger, band, k, stat, bi, bj, value, out_band)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.pixels import INDICES, spectral_index
from cellweave.geometry import MOST_COPIES, copies, extent
from cellweave.operators import kernels, stencils, texture, window
from cellweave.operators.tiles import image_on_tiles, on_tiles
from cellweave.spec import FeatureSpec

Size = tuple[int, int]
KEYS = ("band",)


def wide_bands(pixels: DataFrame, bands: tuple[int, ...]) -> DataFrame:
    """(r, c, b1, b2, ...) of pixels; the bands are known, so the pivot needs no pass of its own."""
    return pixels.where(F.col("band").isin(*bands)).groupBy("r", "c").agg(*(F.max(F.when(F.col("band") == b, F.col("v"))).alias(f"b{b}") for b in bands))


def base_image(pixels: DataFrame, spec: FeatureSpec, size: Size, top: int = 255, enhance: bool = True) -> DataFrame:
    """The bands of a specification as whole numbers 0 .. top, equalised (section by section) and smoothed as it says."""
    image = stencils.prepared(pixels.where(F.col("band").isin(*spec.bands)), spec, top)
    if enhance and spec.equalize:
        image = image_on_tiles(image, spec, kernels.equalized_tile, size)
    if enhance and spec.equalize_adapt:
        image = image_on_tiles(image, spec, kernels.adaptive_equalized, size)
    if enhance and spec.smooth:
        image = stencils.smoothed(image, spec.smooth, *size)
    return image


def window_means(image: DataFrame, spec: FeatureSpec, size: Size, digits: int = 0) -> DataFrame:
    """Weighted means: by spread pixels, or on tiles where a pixel is in too many windows for that."""
    if copies(spec) <= MOST_COPIES:
        return window.window_mean(image, spec, size, digits=digits)
    unit = 10.0**digits
    fixed = image.withColumn("v", window.fixed(F.col("v"), digits))
    made = on_tiles(fixed, spec, kernels.MEAN, size).drop("layer")
    return made.withColumns({"mean": F.col("mean") / F.lit(unit), "var": F.col("var") / F.lit(unit * unit)}) if digits else made


def three_bands(pixels: DataFrame, spec: FeatureSpec) -> tuple[DataFrame, tuple[str, str, str]]:
    return wide_bands(pixels, (1, 2, 3)), ("b1", "b2", "b3")


def for_every_band(features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Features of an image of several bands, under each of the specification's bands."""
    return features.drop("band").withColumn("band", F.explode(F.array(*map(F.lit, spec.bands))))


def index_image(pixels: DataFrame, spec: FeatureSpec, name: str) -> DataFrame:
    used = {x: spec.sensor_bands[x] for x in spec.colours(name)}
    wide = wide_bands(pixels, tuple(sorted(set(used.values()))))
    return spectral_index(wide, name, spec.range()[1], {x: f"b{b}" for x, b in used.items()}, spec.formulas.get(name)).withColumn("band", F.lit(spec.bands[0]))


def saliency_image(pixels: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
    low, high = spec.range()
    colour = stencils.colours(wide_bands(pixels, (1, 2, 3)), *size, low, high, spec.visible_order)
    return stencils.saliency(colour, stencils.colour_means(colour, spec.section_size))


def segment_image(pixels: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
    wide, names = three_bands(pixels, spec)
    return image_on_tiles(wide.withColumn("band", F.lit(1)), spec, kernels.segment_layer, size, values=names)


def keypoint_image(image: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
    return image_on_tiles(image, spec, kernels.keypoint_mask, size)


def gabor_features(image: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
    """The sixteen statistics: mean and var of each of the eight layers."""
    return on_tiles(image, spec, kernels.GABOR_BANK, size)


def long_form(wide: DataFrame, trigger: str, names: tuple[str, ...], per_layer: bool = False) -> DataFrame:
    """(trigger, band, k, stat, name, bi, bj, value): a row for each statistic, counted from 0."""
    stats = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names)))
    first = F.col("layer") * len(names) if per_layer else F.lit(0)
    name = F.concat(F.lit("g"), F.col("layer"), F.lit("_"), F.col("s.name")) if per_layer else F.col("s.name")
    return wide.withColumn("s", F.explode(stats)).select(F.lit(trigger).alias("trigger"), F.col("band").cast("int").alias("band"), F.col("k").cast("int").alias("k"), (first + F.col("s.i")).cast("int").alias("stat"), name.alias("name"), "bi", "bj", "s.value")


def _mean(pixels: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
    return long_form(window_means(base_image(pixels, spec, size), spec, size), "mean", ("mean", "var"))


def _kernel(name: str, kernel, enhance: bool = True) -> Callable:
    return lambda pixels, spec, size: long_form(on_tiles(base_image(pixels, spec, size, enhance=enhance), spec, kernel, size), name, kernel.names)


def _of_mean(name: str, image: Callable, every: bool = False, digits: int = 0) -> Callable:
    def run(pixels: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
        got = window_means(image(pixels, spec, size), spec, size, digits)
        return long_form(for_every_band(got, spec) if every else got, name, ("mean", "var"))

    return run


def _pantex(pixels: DataFrame, spec: FeatureSpec, size: Size) -> DataFrame:
    measure = texture.pantex_weighted if spec.weight else texture.pantex
    return long_form(measure(base_image(pixels, spec, size, 31), spec, size), "pantex", ("contrast",))


#: What each trigger is made by: (pixels, specification, size) -> long form.
TRIGGERS: dict[str, Callable[[DataFrame, FeatureSpec, Size], DataFrame]] = {
    "mean": _mean,
    "pantex": _pantex,
    "lac": lambda p, s, z: long_form(texture.lacunarity(base_image(p, s, z, 31), s, z), "lac", ("lacunarity",)),
    "hog": lambda p, s, z: long_form(texture.hog(base_image(p, s, z), s, z), "hog", kernels.FIVE),
    "sfs": lambda p, s, z: long_form(texture.sfs(base_image(p, s, z), s, z), "sfs", ("max", "min", "mean", "wmean", "std", "orthogonal")),
    "orb": lambda p, s, z: long_form(window.keypoint_moments(keypoint_image(base_image(p, s, z), s, z), s, z), "orb", kernels.FIVE),
    "fourier": _kernel("fourier", kernels.FOURIER),
    "lbpm": _kernel("lbpm", kernels.LBP_MOMENTS),
    "lbp": _kernel("lbp", kernels.LBP_HISTOGRAM),
    "dmp": _kernel("dmp", kernels.DMP, enhance=False),
    "lsr": _kernel("lsr", kernels.LSR),
    "gabor": lambda p, s, z: long_form(gabor_features(base_image(p, s, z), s, z), "gabor", ("mean", "var"), per_layer=True),
    "grad": _of_mean("grad", lambda p, s, z: stencils.gradient(base_image(p, s, z), *z)),
    "saliency": _of_mean("saliency", saliency_image, every=True),
    "seg": _of_mean("seg", segment_image, every=True),
    **{n: _of_mean(n, lambda p, s, z, n=n: index_image(p, s, n), every=True, digits=6) for n in INDICES},
}


def trigger(spec: FeatureSpec, name: str) -> Callable[[DataFrame, FeatureSpec, Size], DataFrame]:
    return _of_mean(name, lambda p, s, z: index_image(p, s, name), every=True, digits=6) if name in spec.formulas else TRIGGERS[name]


def spatial_features(pixels: DataFrame, spec: FeatureSpec, size: Size | None = None) -> DataFrame:
    """Every statistic of every trigger, band and scale; with ``neighbors``, those of the four cells around as further statistics.

    Pixels (band, r, c, v) are read once for each trigger; persist them, or give a table. An empty raster, or one
    not larger than the halo, gives no rows.
    """
    size = size or extent(pixels)
    parts = [trigger(spec, t)(pixels, spec, size) for t in spec.triggers]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = with_out_band(out, spec)
    return neighbors(out) if spec.neighbors else out


def with_out_band(features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Adds the output band (from 1): triggers in order, within them bands, scales and statistics."""
    first = F.create_map(*(x for t, (lo, _) in spec.band_ranges().items() for x in (F.lit(t), F.lit(lo))))
    per = F.create_map(*(x for t in spec.triggers for x in (F.lit(t), F.lit(spec.statistics(t)))))
    band, scale = (F.array_position(F.array(*map(F.lit, xs)), F.col(c)) - 1 for xs, c in ((spec.bands, "band"), (spec.scales, "k")))
    place = first[F.col("trigger")] + (band * len(spec.scales) + scale) * per[F.col("trigger")] + F.col("stat")
    return features.withColumn("out_band", place.cast("int"))


def neighbors(features: DataFrame) -> DataFrame:
    """features with ``side``: each cell's own value, and those above, to the left, to the right and below it; edges are repeated.

    A window function along the columns and one along the rows of cells; a task sorts one line of one output band.
    """
    by = ["trigger", "band", "k", "stat"]
    row, col = Window.partitionBy(*by, "bi").orderBy("bj"), Window.partitionBy(*by, "bj").orderBy("bi")
    v = F.col("value")
    around = features.withColumns({"__l": F.coalesce(F.lag(v).over(row), v), "__r": F.coalesce(F.lead(v).over(row), v)})
    around = around.withColumns({"__t": F.coalesce(F.lag(v).over(col), v), "__b": F.coalesce(F.lead(v).over(col), v)})
    sides = F.array(*(F.struct(F.lit(n).alias("side"), x.alias("value")) for n, x in (("own", v), ("top", F.col("__t")), ("left", F.col("__l")), ("right", F.col("__r")), ("bottom", F.col("__b")))))
    kept = [c for c in features.columns if c != "value"]
    return around.select(*kept, F.explode(sides).alias("s")).select(*kept, "s.side", "s.value")


def band_name(spec: FeatureSpec, trigger: str, band: int, k: int, stat: int) -> str:
    return f"{trigger}_{band}_{k}_{stat}"


def wide_form(features: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(bi, bj, a column for each output band, in order); the columns follow from the specification, so nothing is scanned for them."""
    columns = []
    for t in spec.triggers:
        for b in spec.bands:
            for k in spec.scales:
                for s in range(spec.statistics(t)):
                    same = (F.col("trigger") == t) & (F.col("band") == b) & (F.col("k") == k) & (F.col("stat") == s)
                    columns.append(F.max(F.when(same, F.col("value"))).alias(band_name(spec, t, b, k, s)))
    return features.groupBy("bi", "bj").agg(*columns)
