"""Grids, windows and sections as columns.

A pixel (r, c) belongs to the cells bi whose window of scale k holds it; as windows are concentric and start
every ``block`` pixels, these cells are an integer range, so pixels are spread to their windows by arithmetic:
no join, and the aggregation that follows is partial before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.spec import FeatureSpec

#: Copies of a pixel over all windows beyond which spreading is not sensible and tiles are used.
MOST_COPIES = 64


def extent(pixels: DataFrame) -> tuple[int, int]:
    """Rows and columns of an image: one row to the driver."""
    low = pixels.agg(F.max("r"), F.max("c")).first()
    return (0, 0) if low[0] is None else (int(low[0]) + 1, int(low[1]) + 1)


def copies(spec: FeatureSpec) -> float:
    """How many windows a pixel is in."""
    return sum((k / spec.block) ** 2 for k in spec.scales)


def cell_range(x: Column, offset: Column | int, k: Column | int, block: int, n: int) -> Column:
    """The cells (of n) whose window holds position x; null if there are none."""
    lo = F.greatest(F.lit(0).cast("long"), F.ceil((x - offset - k + 1) / F.lit(block)))
    hi = F.least(F.lit(n - 1).cast("long"), F.floor((x - offset) / F.lit(block)))
    return F.when(hi >= lo, F.sequence(lo, hi))


def windows(pixels: DataFrame, spec: FeatureSpec, rows: int, cols: int) -> DataFrame:
    """pixels in every window that holds them: their columns with k, bi, bj, place (lr, lc) and clipped size (h, w)."""
    n, m = spec.out_size(rows, cols)
    names = [c for c in pixels.columns if c not in ("r", "c")]
    scales = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(spec.offset(k)).cast("long").alias("o")) for k in spec.scales))
    out = pixels.select("*", F.explode(scales).alias("s")).select(*pixels.columns, "s.k", "s.o")
    out = out.select("*", F.explode(cell_range(F.col("r"), F.col("o"), F.col("k"), spec.block, n)).alias("bi"))
    out = out.select("*", F.explode(cell_range(F.col("c"), F.col("o"), F.col("k"), spec.block, m)).alias("bj"))
    r0, c0 = F.col("bi") * spec.block + F.col("o"), F.col("bj") * spec.block + F.col("o")
    size = lambda total, at: F.least(F.col("k").cast("long"), F.lit(total) - at)
    return out.select(*names, "k", "bi", "bj", (F.col("r") - r0).alias("lr"), (F.col("c") - c0).alias("lc"), size(rows, r0).alias("h"), size(cols, c0).alias("w"))


def spread_to_sections(pixels: DataFrame, spec: FeatureSpec, rows: int, cols: int, margin: int = 0) -> DataFrame:
    """pixels in every section that reads them, with its index (tr, tc); ``margin`` further pixels around the section."""
    step, n, m = spec.step(), *spec.out_size(rows, cols)
    tiles = lambda cells: max(0, -(-cells * spec.block // step))
    size = step + spec.halo + 2 * margin
    out = pixels.select("*", F.explode(cell_range(F.col("r"), -margin, size, step, tiles(n))).alias("tr"))
    return out.select("*", F.explode(cell_range(F.col("c"), -margin, size, step, tiles(m))).alias("tc"))


def sections(spark: SparkSession, spec: FeatureSpec, rows: int, cols: int) -> DataFrame:
    """(section, r0, c0, h, w, out_rows, out_cols) of every overlapping section, row by row from 1.

    A section that is not larger than the halo has no cells.
    """
    size_r, size_c = min(spec.section_size, rows), min(spec.section_size, cols)
    step_r, step_c = max(1, size_r - spec.halo), max(1, size_c - spec.halo)
    n_r, n_c = -(-rows // step_r), -(-cols // step_c)
    out = spark.range(n_r * n_c).select((F.col("id") + 1).alias("section"), (F.floor(F.col("id") / n_c) * step_r).alias("r0"), (F.col("id") % n_c * step_c).alias("c0"))
    h, w = F.least(F.lit(size_r).cast("long"), F.lit(rows) - F.col("r0")), F.least(F.lit(size_c).cast("long"), F.lit(cols) - F.col("c0"))
    cells = lambda x: F.greatest(F.lit(0).cast("long"), F.ceil((x - spec.halo) / F.lit(spec.block)))
    return out.select("*", h.alias("h"), w.alias("w")).select("*", cells(F.col("h")).alias("out_rows"), cells(F.col("w")).alias("out_cols"))


def output_georeference(grids: DataFrame, spec: FeatureSpec) -> DataFrame:
    """grids (rows, cols, left, top, cell_x, cell_y) as the output's: cells of a block, shifted to the first block's corner."""
    shift = spec.largest / 2 - spec.block / 2
    cells = lambda x: F.greatest(F.lit(0).cast("long"), F.ceil((F.col(x) - spec.halo) / F.lit(spec.block)))
    return grids.select(
        cells("rows").alias("rows"), cells("cols").alias("cols"), (F.col("left") + shift * F.col("cell_x")).alias("left"), (F.col("top") - shift * F.col("cell_y")).alias("top"),
        (F.col("cell_x") * spec.block).alias("cell_x"), (F.col("cell_y") * spec.block).alias("cell_y"),
    )


def padded(pixels: DataFrame, reach: int, rows: int, cols: int, mode: str) -> DataFrame:
    """pixels with mirrored copies around the image: mode "reflect" repeats the edge, "reflect101" doesn't."""
    first = {"reflect": 1, "reflect101": 0}[mode]

    def places(x: str, n: int) -> Column:
        own = F.col(x)
        before, after = -own - first, F.lit(2 * n - 2 + first) - own
        all_ = [own, F.when((before < 0) & (before >= -reach), before), F.when((after >= n) & (after < n + reach), after)]
        return F.explode(F.filter(F.array(*all_), lambda p: p.isNotNull()))

    rest = [c for c in pixels.columns if c not in ("r", "c")]
    out = pixels.select(*rest, "c", places("r", rows).alias("r"))
    return out.select(*rest, "r", places("c", cols).alias("c"))


def neighbourhood(pixels: DataFrame, reach: int, keys: tuple[str, ...] = (), value: str = "v") -> DataFrame:
    """pixels with ``n``: the (2 reach + 1)² values around as an array, row by row; null outside the image.

    Two passes of a window function, along rows, then along columns: each shuffles every pixel once, and a task
    sorts one line of the image at a time. Every pixel of the grid must be there.
    """

    def line(x: Column, along: str, across: str) -> Column:
        w = Window.partitionBy(*keys, across).orderBy(along)
        return F.array(*(F.lag(x, -d).over(w) if d else x for d in range(-reach, reach + 1)))

    across = pixels.withColumn("__h", line(F.col(value), "c", "r"))
    return across.withColumn("__n", line(F.col("__h"), "r", "c")).withColumn("n", F.flatten(F.transform("__n", lambda x: F.coalesce(x, F.array_repeat(F.lit(None), 2 * reach + 1))))).drop("__h", "__n")


def near(dr: int, dc: int, reach: int) -> Column:
    """The value at (r + dr, c + dc) of a neighbourhood, null outside."""
    return F.col("n")[(dr + reach) * (2 * reach + 1) + dc + reach]
