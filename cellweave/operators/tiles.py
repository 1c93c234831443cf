"""Kernels that no relational form fits, on tiles: one shuffle brings the pixels of a section, with its halo, to one task.

A tile is as wide as its section and halo whatever the image; all scales of a trigger are made of one tile in one
pass. A kernel prepares layers from the tile (an image, or one for each scale) and measures the windows of one size
of many cells. What needs windows one by one gets them in stacks of STACK bytes, so besides its tile a task holds little.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.geometry import extent, spread_to_sections
from cellweave.spec import FeatureSpec


#: Bytes of a stack of windows.
STACK = 16 << 20


@dataclass(frozen=True)
class Cells:
    """The windows of scale k and size h x w of a grid of cells: the first one's place in the layer, and how many there are, ``step`` pixels apart."""

    layer: np.ndarray  # its last axes are rows and columns
    first: tuple[int, int]
    count: tuple[int, int]
    step: int
    h: int
    w: int
    k: int

    def at(self, r: int, c: int, layer: np.ndarray | None = None) -> np.ndarray:
        """The pixel (r, c) of every window, as a view of the layer or of another image of its shape."""
        i, j = self.first[0] + r, self.first[1] + c
        return (self.layer if layer is None else layer)[..., i : i + (self.count[0] - 1) * self.step + 1 : self.step, j : j + (self.count[1] - 1) * self.step + 1 : self.step]

    def sums(self, image: np.ndarray, r0: int = 0, r1: int | None = None, c0: int = 0, c1: int | None = None) -> np.ndarray:
        """Sums of an image of whole numbers over rows r0 .. r1 and columns c0 .. c1 of every window, from running sums."""
        r1, c1 = self.h if r1 is None else r1, self.w if c1 is None else c1
        if r0 >= r1 or c0 >= c1:
            return np.zeros(self.count, np.int64)
        i, j = self.first
        rows, cols = (self.count[0] - 1) * self.step + self.h, (self.count[1] - 1) * self.step + self.w
        total = np.zeros((rows + 1, cols + 1), np.int64)
        np.cumsum(np.cumsum(image[i : i + rows, j : j + cols], axis=0, dtype=np.int64), axis=1, out=total[1:, 1:])
        own = Cells(total, (0, 0), self.count, self.step, self.h, self.w, self.k)
        return own.at(r1, c1) - own.at(r0, c1) - own.at(r1, c0) + own.at(r0, c0)

    def chunks(self, bytes_a_cell: int) -> Iterator[tuple[slice, Cells]]:
        """Some lines of cells at a time: which they are, and the cells."""
        lines = max(1, STACK // max(1, bytes_a_cell * self.count[1]))
        for at in range(0, self.count[0], lines):
            n = min(lines, self.count[0] - at)
            yield slice(at, at + n), replace(self, first=(self.first[0] + at * self.step, self.first[1]), count=(n, self.count[1]))

    def stacks(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Windows one by one (n x .. x h x w), some lines of cells at a time."""
        for lines, part in self.chunks(8 * self.h * self.w * int(np.prod(self.layer.shape[:-2], dtype=int))):
            rows, cols = (part.count[0] - 1) * self.step + self.h, (part.count[1] - 1) * self.step + self.w
            area = self.layer[..., part.first[0] : part.first[0] + rows, part.first[1] : part.first[1] + cols]
            view = np.lib.stride_tricks.sliding_window_view(area, (self.h, self.w), axis=(-2, -1))[..., :: self.step, :: self.step, :, :]
            yield lines, np.moveaxis(view, (-4, -3), (0, 1)).reshape(part.count[0] * part.count[1], *self.layer.shape[:-2], self.h, self.w)


def one_by_one(measure: Callable[[np.ndarray, FeatureSpec, int], np.ndarray]) -> Callable[[Cells, FeatureSpec], np.ndarray]:
    """A measure of stacks (n windows, spec, k) -> n x statistics as one of cells."""

    def run(cells: Cells, spec: FeatureSpec) -> np.ndarray:
        return np.concatenate([measure(stack, spec, cells.k).reshape(lines.stop - lines.start, cells.count[1], -1) for lines, stack in cells.stacks()])

    return run


@dataclass(frozen=True)
class Kernel:
    """prepare: (values x rows x cols, spec) -> {scale or 0: layers x rows x cols}; measure: (cells of a layer, spec) -> lines x columns of cells x statistics.

    margin: pixels around a section that ``prepare`` needs to be seamless; None where it is made for whole sections.
    """

    names: tuple[str, ...]
    prepare: Callable[[np.ndarray, FeatureSpec], dict[int, np.ndarray]]
    measure: Callable[[Cells, FeatureSpec], np.ndarray]
    margin: Callable[[FeatureSpec], int] = lambda spec: 0
    joint: bool = False  # measure takes all layers at once


def cells_by_size(layer: np.ndarray, at: tuple[int, int], cells: tuple[range, range], spec: FeatureSpec, k: int, size: tuple[int, int]) -> Iterator[tuple[list[int], list[int], Cells]]:
    """The cells of a tile by the size that their windows of scale k have, with their numbers; ``at`` is the tile's place, ``size`` the image's."""
    groups: list[dict[int, list[int]]] = [{}, {}]
    for axis in (0, 1):
        for x in cells[axis]:
            groups[axis].setdefault(min(k, size[axis] - x * spec.block - spec.offset(k)), []).append(x)
    for h, rows in groups[0].items():
        for w, cols in groups[1].items():
            first = tuple(x[0] * spec.block + spec.offset(k) - a for x, a in zip((rows, cols), at, strict=True))
            yield rows, cols, Cells(layer, first, (len(rows), len(cols)), spec.block, h, w, k)


def on_tiles(pixels: DataFrame, spec: FeatureSpec, kernel: Kernel, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",), values: tuple[str, ...] = ("v",)) -> DataFrame:
    """(keys, k, layer, bi, bj, statistics) of a kernel; layer counts the images of a scale from 0. Missing pixels are 0."""
    rows, cols = size or extent(pixels)
    n, m = spec.out_size(rows, cols)
    margin, step, b, halo = kernel.margin(spec), spec.step(), spec.block, spec.halo
    spread = spread_to_sections(pixels.select(*keys, "r", "c", *values), spec, rows, cols, margin)
    key_types = [pixels.schema[x] for x in keys]
    schema = T.StructType([*key_types, T.StructField("k", T.IntegerType()), T.StructField("layer", T.IntegerType()), T.StructField("bi", T.LongType()), T.StructField("bj", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in kernel.names)])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tr, tc = (x.as_py() for x in key[-2:])
        r0, c0 = max(0, tr * step - margin), max(0, tc * step - margin)
        r1, c1 = min(rows, tr * step + step + halo + margin), min(cols, tc * step + step + halo + margin)
        image = np.zeros((len(values), r1 - r0, c1 - c0))
        at = group.column("r").to_numpy() - r0, group.column("c").to_numpy() - c0
        for x, name in enumerate(values):
            image[x][at] = np.nan_to_num(group.column(name).to_numpy().astype(np.float64))
        cells = range(tr * step // b, min(n, (tr + 1) * step // b)), range(tc * step // b, min(m, (tc + 1) * step // b))
        made = kernel.prepare(image, spec)
        parts: list[list[np.ndarray]] = [[] for _ in range(4 + len(kernel.names))]
        for k in spec.scales:
            layers = made[k] if k in made else made[0]
            for number, layer in enumerate([layers] if kernel.joint else layers):
                for bi, bj, some in cells_by_size(layer, (r0, c0), cells, spec, k, (rows, cols)):
                    got = kernel.measure(some, spec).reshape(len(bi) * len(bj), -1)
                    for part, column in zip(parts, [np.full(len(got), k, np.int32), np.full(len(got), number, np.int32), np.repeat(bi, len(bj)), np.tile(bj, len(bi)), *got.T], strict=True):
                        part.append(column)
        total = sum(map(len, parts[0]))
        columns = [pa.array([x.as_py()] * total, pa_type) for x, pa_type in zip(key[:-2], [c.type for c in key[:-2]], strict=True)]
        kinds = [np.int32, np.int32, np.int64, np.int64, *[np.float64] * len(kernel.names)]
        columns += [pa.array(np.concatenate(p).astype(kind) if p else np.array([], kind)) for p, kind in zip(parts, kinds, strict=True)]
        return pa.table(columns, names=schema.names)

    return spread.groupBy(*keys, "tr", "tc").applyInArrow(run, schema)


def image_on_tiles(pixels: DataFrame, spec: FeatureSpec, make: Callable[[np.ndarray, FeatureSpec], np.ndarray], size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",), values: tuple[str, ...] = ("v",), margin: int = 0) -> DataFrame:
    """(keys, r, c, v): an image made section by section; every pixel is taken from one section, the last one keeps its halo."""
    rows, cols = size or extent(pixels)
    step, halo = spec.step(), spec.halo
    spread = spread_to_sections(pixels.select(*keys, "r", "c", *values), spec, rows, cols, margin)
    n, m = spec.out_size(rows, cols)
    last = tuple(max(0, -(-x * spec.block // step) - 1) for x in (n, m))
    schema = T.StructType([*(pixels.schema[x] for x in keys), T.StructField("r", T.LongType()), T.StructField("c", T.LongType()), T.StructField("v", T.LongType())])

    def run(key: tuple, group: pa.Table) -> pa.Table:
        tr, tc = (x.as_py() for x in key[-2:])
        r0, c0 = max(0, tr * step - margin), max(0, tc * step - margin)
        r1, c1 = min(rows, tr * step + step + halo + margin), min(cols, tc * step + step + halo + margin)
        image = np.zeros((len(values), r1 - r0, c1 - c0))
        at = group.column("r").to_numpy() - r0, group.column("c").to_numpy() - c0
        for x, name in enumerate(values):
            image[x][at] = np.nan_to_num(group.column(name).to_numpy().astype(np.float64))
        out = make(image, spec)
        e0 = rows if tr == last[0] else (tr + 1) * step
        e1 = cols if tc == last[1] else (tc + 1) * step
        part = out[tr * step - r0 : e0 - r0, tc * step - c0 : e1 - c0]
        i, j = np.meshgrid(np.arange(part.shape[0]) + tr * step, np.arange(part.shape[1]) + tc * step, indexing="ij")
        columns = [pa.array([x.as_py()] * part.size, x.type) for x in key[:-2]]
        return pa.table([*columns, pa.array(i.ravel().astype(np.int64)), pa.array(j.ravel().astype(np.int64)), pa.array(part.ravel().astype(np.int64))], names=schema.names)

    return spread.groupBy(*keys, "tr", "tc").applyInArrow(run, schema)
