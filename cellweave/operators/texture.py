"""Texture of windows in DataFrame functions: co-occurrence contrast, lacunarity, oriented gradients; line features, on tiles.

Where a pixel is in more than MOST_COPIES windows it is not copied to them: tiles give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.moments import moments5
from cellweave.geometry import MOST_COPIES, copies, extent, near, neighbourhood, windows
from cellweave.operators import wide
from cellweave.operators.shapes import PAIR_OFFSETS
from cellweave.operators.tiles import on_tiles
from cellweave.operators.wide import MAGNITUDE
from cellweave.operators.window import cell_keys, window_mean
from cellweave.spec import FeatureSpec


def pantex(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, contrast) of 5-bit pixels: the least co-occurrence contrast over the offsets.

    The contrast of a symmetric, normalised co-occurrence matrix is the mean squared difference of its pairs, so
    no matrix is built: a pixel brings its squared differences to every window that holds both pixels of a pair.
    """
    rows, cols = size or extent(pixels)
    if copies(spec) > MOST_COPIES:
        return on_tiles(pixels, spec, wide.PANTEX, (rows, cols), keys).drop("layer")
    around = neighbourhood(pixels, 2, keys)
    v = F.col("v")
    squares = [(near(dr, dc, 2) - v) * (near(dr, dc, 2) - v) for dr, dc in PAIR_OFFSETS]
    pairs = around.select(*keys, "r", "c", *(q.alias(f"q{i}") for i, q in enumerate(squares)))
    spread = windows(pairs, spec, rows, cols)
    inside = lambda dr, dc: (F.col("lr") + dr < F.col("h")) & (F.col("lc") + dc < F.col("w")) & (F.col("lc") + dc >= 0)
    sums = spread.groupBy(*cell_keys(keys)).agg(F.first("h").alias("h"), F.first("w").alias("w"), *(F.sum(F.when(inside(dr, dc), F.col(f"q{i}"))).alias(f"s{i}") for i, (dr, dc) in enumerate(PAIR_OFFSETS)))
    contrast = [F.try_divide(F.col(f"s{i}").cast("double"), (F.col("h") - dr) * (F.col("w") - abs(dc))) for i, (dr, dc) in enumerate(PAIR_OFFSETS)]
    return sums.select(*cell_keys(keys), F.coalesce(F.array_min(F.filter(F.array(*contrast), lambda x: x.isNotNull())), F.lit(0.0)).alias("contrast"))


def pantex_weighted(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, contrast): the contrast times the distance-weighted mean of the same 5-bit window."""
    size = size or extent(pixels)
    both = pantex(pixels, spec, size, keys).join(window_mean(pixels, spec, size, keys), cell_keys(keys))
    return both.select(*cell_keys(keys), (F.col("contrast") * F.col("mean")).alias("contrast"))


def lacunarity(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, lacunarity) of 5-bit pixels by differential box counting.

    The mass of a box is how many levels its values span; with the share P of the boxes of a mass, lacunarity is
    the sum over boxes of m² P(m) over the squared sum of m P(m). Boxes at the window's end are clipped.
    """
    rows, cols = size or extent(pixels)
    if copies(spec) > MOST_COPIES:
        return on_tiles(pixels, spec, wide.LACUNARITY, (rows, cols), keys).drop("layer")
    r = spec.box
    spread = windows(pixels, spec, rows, cols)
    x, y = F.floor(F.col("lr") / r), F.floor(F.col("lc") / r)
    boxes = spread.groupBy(*cell_keys(keys), x.alias("x"), y.alias("y")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("h").alias("h"), F.first("w").alias("w"))
    side = F.least(F.lit(r), F.col("h") - F.col("x") * r, F.col("w") - F.col("y") * r)
    mass = F.ceil(F.greatest(F.col("hi"), F.lit(1)) / side) - F.ceil(F.col("lo") / side) + 1
    by_mass = boxes.select(*cell_keys(keys), mass.alias("m")).groupBy(*cell_keys(keys), "m").agg(F.count(F.lit(1)).alias("n"))
    m, n = F.col("m"), F.col("n")
    sums = by_mass.groupBy(*cell_keys(keys)).agg(F.sum(n).alias("ns"), F.sum(m * n * n).cast("double").alias("s1"), F.sum(m * m * n * n).cast("double").alias("s2"))
    return sums.select(*cell_keys(keys), F.coalesce(F.try_divide(F.col("ns") * F.col("s2"), F.col("s1") * F.col("s1")), F.lit(0.0)).alias("lacunarity"))


def hog(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, max, mean, var, skew, kurt): moments of nine oriented-gradient bins of each window.

    Central differences, 0 at the window's border; magnitudes by unsigned angle in bins of 20 degrees, over the
    window's area; then normalised, cut at 0.2 and normalised again. A window of zeros gives zeros.
    """
    rows, cols = size or extent(pixels)
    if copies(spec) > MOST_COPIES:
        return on_tiles(pixels, spec, wide.HOG, (rows, cols), keys).drop("layer")
    around = neighbourhood(pixels, 1, keys)
    slopes = around.select(*keys, "r", "c", "v", (near(1, 0, 1) - near(-1, 0, 1)).alias("gr"), (near(0, 1, 1) - near(0, -1, 1)).alias("gc"))
    spread = windows(slopes, spec, rows, cols)
    inner = lambda at, n, g: F.when((F.col(at) > 0) & (F.col(at) < F.col(n) - 1), F.col(g)).otherwise(F.lit(0)).cast("double")
    spread = spread.select(*cell_keys(keys), "v", "h", "w", inner("lr", "h", "gr").alias("y"), inner("lc", "w", "gc").alias("x"))
    angle = F.degrees(F.atan2("y", "x"))
    angle = F.when(angle < 0, angle + 180.0).otherwise(angle)
    angle = F.when(angle >= 180, angle - 180.0).otherwise(angle)
    magnitude = F.floor(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")) * F.lit(MAGNITUDE) + 0.5).cast("long")
    binned = spread.select(*cell_keys(keys), "v", "h", "w", F.least(F.floor(angle / 20.0), F.lit(8)).alias("b"), magnitude.alias("g"))
    sums = binned.groupBy(*cell_keys(keys)).agg(F.max("v").alias("top"), F.first("h").alias("h"), F.first("w").alias("w"), *(F.coalesce(F.sum(F.when(F.col("b") == i, F.col("g"))), F.lit(0)).alias(f"g{i}") for i in range(9)))
    area = (F.col("h") * F.col("w")).cast("double")
    bins = sums.select(*cell_keys(keys), "top", F.array(*(F.col(f"g{i}").cast("double") / F.lit(MAGNITUDE) / area for i in range(9))).alias("a"))
    norm = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) + F.lit(1e-10))
    bins = bins.withColumn("norm", norm(F.col("a"))).withColumn("a", F.transform("a", lambda x: F.least(x / F.col("norm"), F.lit(0.2))))
    bins = bins.withColumn("norm", norm(F.col("a"))).withColumn("a", F.transform("a", lambda x: x / F.col("norm")))
    return bins.select(*cell_keys(keys), *(F.when(F.col("top") > 0, x).otherwise(F.lit(0.0)).alias(n) for n, x in moments5(F.col("a")).items()))


def sfs(pixels: DataFrame, spec: FeatureSpec, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, k, bi, bj, max, min, mean, wmean, std, orthogonal) of the lengths of homogeneous lines from the window's centre.

    A line grows while the summed difference of its pixels from the central block's mean is below the threshold.
    Its length is the distance from the centre to the first pixel that it leaves out, or its last one. min skips
    lengths of 0; wmean weighs by 0.1 (length - 1) / (half the variance along the line), skipped where that is
    not finite; orthogonal is the largest difference to the line at a right angle. Lines are walked on tiles: a window
    gathered from its pixels would be as large as all of them, so nothing would shrink before the shuffle.
    """
    return on_tiles(pixels, spec, wide.SFS, size or extent(pixels), keys).drop("layer")
