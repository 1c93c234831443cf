"""Images made of images, pixel by pixel from fixed surroundings: gradient, blur, saliency, smoothing."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.geometry import near, neighbourhood, padded
from cellweave.functions.pixels import rescaled
from cellweave.spec import FeatureSpec

#: Linear colour transform of (red, green, blue).
RGB_CIE = ((0.1387, 0.6708, 0.0611), (0.0999, 0.8017, 0.0984), (0.0, 0.0660, 0.8910))


def gradient(pixels: DataFrame, rows: int, cols: int, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """8-bit gradient magnitude (keys, r, c, v): the mean of four 2 x 2 differences of square roots, cut.

    The two kernels of a pair differ in sign only, so a pair's magnitude is the difference times the root of 2.
    Edges are repeated.
    """
    inside = (F.col("r") < rows) & (F.col("c") < cols) & (F.col("r") >= 0) & (F.col("c") >= 0)
    around = neighbourhood(padded(pixels, 1, rows, cols, "reflect"), 1, keys).where(inside)
    root = lambda dr, dc: F.sqrt(near(dr, dc, 1).cast("double"))
    pre = around.select(*keys, "r", "c", root(-1, -1).alias("a"), root(-1, 0).alias("b"), root(0, -1).alias("d"), root(0, 0).alias("e"))
    a, b, d, e = map(F.col, "abde")
    total = F.abs(d - b) + F.abs(e - a) + F.abs(d + e - a - b) + F.abs(b + e - a - d)
    return pre.select(*keys, "r", "c", F.floor(total * F.lit(2.0**0.5 / 4) + F.lit(1e-9)).cast("long").alias("v"))


def blur_weights(sigma: float = 3.0) -> list[float]:
    """Three weights of a Gaussian that sum to 1."""
    side = exp(-1 / (2 * sigma * sigma))
    return [side / (1 + 2 * side), 1 / (1 + 2 * side), side / (1 + 2 * side)]


def colours(bands: DataFrame, rows: int, cols: int, low: float, high: float, order: str = "bgr") -> DataFrame:
    """(r, c, x, y, z) of three bands (r, c, b1, b2, b3): scaled, blurred, mapped to -1 .. 1 and transformed, in fixed point of 9 decimals.

    The blur is made on whole numbers, so it is exact.
    """
    unit = 1e6
    scaled = [F.floor((F.least(F.greatest(F.col(f"b{i}").cast("double"), F.lit(low)), F.lit(high)) - low) / F.lit(high - low) * unit + 0.5).cast("long").alias(f"b{i}") for i in (1, 2, 3)]
    base = bands.select("r", "c", F.struct(*scaled).alias("v"))
    inside = (F.col("r") < rows) & (F.col("c") < cols) & (F.col("r") >= 0) & (F.col("c") >= 0)
    around = neighbourhood(padded(base, 1, rows, cols, "reflect101"), 1).where(inside)
    w = [int(x * 1e6 + 0.5) for x in blur_weights()]
    total = sum(w) ** 2
    blurred = lambda i: sum((near(dr, dc, 1)[f"b{i}"] * F.lit(w[dr + 1] * w[dc + 1]) for dr in (-1, 0, 1) for dc in (-1, 0, 1)), F.lit(0).cast("long"))
    flat = around.select("r", "c", *((blurred(i).cast("double") / F.lit(float(total)) / F.lit(unit) * 2.0 - 1.0).alias(f"p{i}") for i in (1, 2, 3)))
    red, green, blue = ("p3", "p2", "p1") if order == "bgr" else ("p1", "p2", "p3")
    mixed = [F.floor((F.col(red) * m[0] + F.col(green) * m[1] + F.col(blue) * m[2]) * F.lit(1e9) + 0.5).cast("long").alias(x) for m, x in zip(RGB_CIE, "xyz", strict=True)]
    return flat.select("r", "c", *mixed)


def colour_means(colour: DataFrame, section: int) -> DataFrame:
    """(x, y, z): the unweighted mean of the sections' mean colours."""
    each = colour.groupBy(F.floor(F.col("r") / section).alias("tr"), F.floor(F.col("c") / section).alias("tc")).agg(*((F.sum(x).cast("double") / F.count(F.lit(1)) / F.lit(1e9)).alias(x) for x in "xyz"))
    # Rounded before they are summed: the sum is the same in any order.
    return each.agg(*((F.sum(F.floor(F.col(x) * F.lit(1e9) + 0.5).cast("long")).cast("double") / F.count(F.lit(1)) / F.lit(1e9)).alias(x) for x in "xyz"))


def saliency(colour: DataFrame, means: DataFrame) -> DataFrame:
    """8-bit saliency (band, r, c, v): the squared distance from the mean colour, from -1 .. 1 to 0 .. 255, cut."""
    mean = means.select(*(F.col(x).alias(f"m{x}") for x in "xyz"))  # one row
    both = colour.crossJoin(F.broadcast(mean))
    far = sum(((F.col(x).cast("double") / F.lit(1e9) - F.col(f"m{x}")) * (F.col(x).cast("double") / F.lit(1e9) - F.col(f"m{x}")) for x in "xyz"), F.lit(0.0))
    return both.select(F.lit(1).alias("band"), "r", "c", F.floor((F.least(far, F.lit(1.0)) + 1.0) / 2.0 * 255.0).cast("long").alias("v"))


def smoothed(pixels: DataFrame, d: int, rows: int, cols: int, keys: tuple[str, ...] = ("band",), sigma_colour: float = 0.1, sigma_space: float = 0.1) -> DataFrame:
    """Bilateral filter of 8-bit pixels over a disc of diameter d; edges are mirrored."""
    reach = d // 2
    inside = (F.col("r") < rows) & (F.col("c") < cols) & (F.col("r") >= 0) & (F.col("c") >= 0)
    around = neighbourhood(padded(pixels, reach, rows, cols, "reflect101"), reach, keys).where(inside)
    disc = [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1) if i * i + j * j <= reach * reach]
    weight = lambda i, j: F.exp(-(near(i, j, reach) - F.col("v")) * (near(i, j, reach) - F.col("v")) / F.lit(2 * sigma_colour**2)) * F.lit(exp(-(i * i + j * j) / (2 * sigma_space**2)))
    top = sum((weight(i, j) * near(i, j, reach) for i, j in disc), F.lit(0.0))
    return around.select(*keys, "r", "c", F.floor(top / sum((weight(i, j) for i, j in disc), F.lit(0.0)) + 0.5).cast("long").alias("v"))


def prepared(pixels: DataFrame, spec: FeatureSpec, top: int = 255, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """pixels as whole numbers 0 .. top, by the range of the image."""
    low, high = spec.range()
    return pixels.select(*keys, "r", "c", rescaled(F.col("v"), low, high, top).alias("v"))
