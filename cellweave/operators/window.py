"""Window aggregates that are one grouped aggregation of spread pixels.

Sums are kept in whole numbers: values are fixed-point numbers of ``digits`` decimals and weights of nine, so a
result does not depend on the order of rows or on how they are dealt over tasks. An overflow raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.moments import moments5
from cellweave.geometry import MOST_COPIES, copies, extent, windows
from cellweave.operators import wide
from cellweave.operators.tiles import on_tiles
from cellweave.spec import FeatureSpec

#: Fixed-point weights.
WEIGHT = 1e9


def cell_keys(keys: tuple[str, ...]) -> list[str]:
    return [*keys, "k", "bi", "bj"]


def distance_weight(lr: Column, lc: Column, k: Column) -> Column:
    """1 / distance to the centre of the window, in fixed point; 0 at the centre itself."""
    half = k / F.lit(2.0)
    d = F.sqrt((lc - half) * (lc - half) + (lr - half) * (lr - half))
    return F.when(d > 0, F.floor(F.lit(WEIGHT) / d + F.lit(0.5)).cast("long")).otherwise(F.lit(0).cast("long"))


def fixed(v: Column, digits: int) -> Column:
    return v.cast("long") if not digits else F.floor(v * F.lit(10.0**digits) + F.lit(0.5)).cast("long")


def window_mean(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",), digits: int = 0) -> DataFrame:
    """(keys, k, bi, bj, mean, var): the mean weighted by 1 / distance over all pixels of the window, and the mean square deviation from it.

    Values must be whole numbers, or are rounded to ``digits`` decimals. The weights are not normalised: their
    sum is divided by the number of pixels, null values among them counted but not summed.
    """
    rows, cols = size or extent(pixels)
    spread = windows(pixels, spec, rows, cols)
    v = fixed(F.col("v"), digits)
    sums = spread.groupBy(*cell_keys(keys)).agg(
        F.coalesce(F.sum(v * distance_weight(F.col("lr"), F.col("lc"), F.col("k"))), F.lit(0)).alias("sw"), F.coalesce(F.sum(v), F.lit(0)).alias("s1"),
        F.coalesce(F.sum(v * v), F.lit(0)).alias("s2"), F.count(F.lit(1)).alias("n"), F.count("v").alias("nv"),
    )
    unit = F.lit(10.0**digits)
    mean = F.col("sw").cast("double") / F.lit(WEIGHT) / F.col("n") / unit
    square = F.col("s2").cast("double") / unit / unit / F.col("n")
    var = square - F.lit(2.0) * F.col("mean") * (F.col("s1").cast("double") / unit / F.col("n")) + F.col("mean") * F.col("mean") * F.col("nv") / F.col("n")
    return sums.withColumn("mean", mean).select(*cell_keys(keys), "mean", var.alias("var"))


def window_basic(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, n, sum, min, max, mean, var_pop, var_samp) of whole numbers.

    Blocks are summed first: where every window is made of whole blocks (and none is clipped), pixels go to one
    block each and only blocks are spread to windows, so the work does not grow with the windows' size.
    """
    rows, cols = size or extent(pixels)
    v, b = F.col("v").cast("long"), spec.block
    measures = lambda n, s1, s2, lo, hi: [n.alias("n"), s1.alias("s1"), s2.alias("s2"), lo.alias("min"), hi.alias("max")]
    whole = all(k % b == 0 and spec.offset(k) % b == 0 for k in spec.scales) and (rows - spec.halo) % b == 0 and (cols - spec.halo) % b == 0
    if whole and b > 1:
        blocks = pixels.groupBy(*keys, F.floor(F.col("r") / b).alias("r"), F.floor(F.col("c") / b).alias("c")).agg(*measures(F.count(F.lit(1)), F.sum(v), F.sum(v * v), F.min(v), F.max(v)))
        # In units of blocks: windows of k / b blocks at every block.
        coarse = FeatureSpec(triggers=("mean",), block=1, scales=tuple(k // b for k in spec.scales), section_size=spec.section_size) if len({k // b % 2 for k in spec.scales}) == 1 else None
        if coarse is not None and all(coarse.offset(k // b) == spec.offset(k) // b for k in spec.scales):
            spread = windows(blocks, coarse, rows // b, cols // b).withColumn("k", F.col("k") * b)
            sums = spread.groupBy(*cell_keys(keys)).agg(*measures(F.sum("n"), F.sum("s1"), F.sum("s2"), F.min("min"), F.max("max")))
            return _basic(sums, keys)
    sums = windows(pixels, spec, rows, cols).groupBy(*cell_keys(keys)).agg(*measures(F.count(F.lit(1)), F.sum(v), F.sum(v * v), F.min(v), F.max(v)))
    return _basic(sums, keys)


def _basic(sums: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    n, s1, s2 = F.col("n").cast("double"), F.col("s1").cast("double"), F.col("s2").cast("double")
    spread = (s2 * n - s1 * s1) / n
    return sums.select(*cell_keys(keys), "n", F.col("s1").alias("sum"), "min", "max", (s1 / n).alias("mean"), (spread / n).alias("var_pop"), F.try_divide(spread, n - F.lit(1.0)).alias("var_samp"))


def window_moments(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",), textbook: bool = False) -> DataFrame:
    """(keys, k, bi, bj, max, mean, var, skew, kurt) of whole numbers, by power sums; all 0 where the largest value is 0."""
    rows, cols = size or extent(pixels)
    if copies(spec) > MOST_COPIES and not textbook:
        return on_tiles(pixels, spec, wide.POWERS, (rows, cols), keys).drop("layer")
    v = F.col("v").cast("long")
    sums = windows(pixels, spec, rows, cols).groupBy(*cell_keys(keys)).agg(F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(_times(v, p)).cast("double").alias(f"s{p}") for p in (1, 2, 3, 4)), F.max(v).cast("double").alias("max"))
    n, m = F.col("n"), F.col("s1") / F.col("n")
    m2 = F.col("s2") / n - m * m
    m3 = F.col("s3") / n - F.lit(3.0) * m * (F.col("s2") / n) + F.lit(2.0) * m * m * m
    m4 = F.col("s4") / n - F.lit(4.0) * m * (F.col("s3") / n) + F.lit(6.0) * m * m * (F.col("s2") / n) - F.lit(3.0) * m * m * m * m
    var = F.try_divide(m2 * n, n - F.lit(1.0))
    sd = F.sqrt(var) if textbook else var * F.lit(0.5)
    none = lambda x: F.when(F.col("max") == 0, F.lit(0.0)).otherwise(F.coalesce(x, F.lit(0.0)))
    return sums.select(*cell_keys(keys), "max", none(m).alias("mean"), none(var).alias("var"), none(F.try_divide(m3, sd * sd * sd)).alias("skew"), none(F.try_divide(m4, sd * sd * sd * sd)).alias("kurt"))


def _times(v: Column, p: int) -> Column:
    out = v
    for _ in range(p - 1):
        out = out * v
    return out


def pyramid_histogram(mask: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, bins): sums of a 0/1 mask over the tiles of three levels, as one array.

    A level L cuts the window into tiles of a side floor(side / L), and is left out unless both sides are over
    1; tiles start at multiples of the side below side - 1, and clipped ones of one row or column are left out.
    """
    rows, cols = size or extent(mask)
    spread = windows(mask, spec, rows, cols)
    levels = F.explode(F.array(*(F.lit(x) for x in (2, 4, 8)))).alias("level")
    each = spread.select("*", levels)
    each = each.select("*", F.floor(F.col("h") / F.col("level")).alias("ty"), F.floor(F.col("w") / F.col("level")).alias("tx")).where("ty > 1 AND tx > 1")
    each = each.select("*", F.floor(F.col("lr") / F.col("ty")).alias("i"), F.floor(F.col("lc") / F.col("tx")).alias("j"))
    own = lambda place, tile, n: (F.col(place) * F.col(tile) < F.col(n) - 1) & (F.least(F.col(tile), F.col(n) - F.col(place) * F.col(tile)) > 1)
    tiles = each.where(own("i", "ty", "h") & own("j", "tx", "w")).groupBy(*cell_keys(keys), "level", "i", "j").agg(F.sum("v").cast("double").alias("s"))
    bins = F.transform(F.sort_array(F.collect_list(F.struct("level", "i", "j", "s"))), lambda x: x["s"])
    return tiles.groupBy(*cell_keys(keys)).agg(bins.alias("bins"))


def keypoint_moments(mask: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, max, mean, var, skew, kurt) of the pyramid histogram of a mask."""
    if copies(spec) > MOST_COPIES:
        return on_tiles(mask, spec, wide.PYRAMID, size, keys).drop("layer")
    bins = pyramid_histogram(mask, spec, size, keys)
    return bins.select(*cell_keys(keys), *(x.alias(n) for n, x in moments5(F.col("bins")).items()))
