"""Row-wise functions of pixel values and of bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.spec import SpecError

#: Formulas of the spectral indices over n(ear infrared), r(ed), g(reen), b(lue), all 0 to 1.
INDICES = {
    "ndvi": (("nir", "red"), lambda n, r: F.try_divide(n - r, n + r)),
    "gndvi": (("nir", "green"), lambda n, g: F.try_divide(n - g, n + g)),
    "evi2": (("nir", "red"), lambda n, r: F.try_divide(2.5 * (n - r), n + 2.4 * r + 1.0)),
}


def rescaled(v: Column, low: float, high: float, top: int = 255) -> Column:
    """v, clipped to low .. high, as an integer 0 .. top (cut, not rounded). An empty range gives 0."""
    if high <= low:
        return F.lit(0).cast("long")
    clipped = F.least(F.greatest(v.cast("double"), F.lit(float(low))), F.lit(float(high)))
    return F.floor((clipped - float(low)) / F.lit(float(high - low)) * F.lit(float(top))).cast("long")


def gray(blue: Column, green: Column, red: Column) -> Column:
    """The plain mean of the three."""
    return (blue + green + red) / F.lit(3.0)


def spectral_index(bands: DataFrame, name: str, top: float, of: dict[str, str], formula: str | None = None, digits: int = 6) -> DataFrame:
    """(r, c, v): an index of bands clipped at ``top`` and divided by it, to so many digits; 0 where it has no value.

    of: the column of each colour that the index needs. formula: a Spark SQL expression over the colours, for
    an index that isn't known here.
    """
    if formula is not None:
        colours, value = tuple(of), None
    elif name in INDICES:
        colours, value = INDICES[name]
    else:
        raise SpecError(f"unknown index {name}; there are {', '.join(INDICES)}, or give a formula")
    if missing := [c for c in colours if c not in of]:
        raise SpecError(f"the sensor has no {', '.join(missing)}")
    scaled = bands.select("r", "c", *((F.least(F.col(of[c]).cast("double"), F.lit(float(top))) / F.lit(float(top))).alias(c) for c in colours))
    v = F.expr(formula) if formula is not None else value(*(F.col(c) for c in colours))
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return scaled.select("r", "c", (F.floor(F.coalesce(v, F.lit(0.0)) * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits)).alias("v"))


def image_range(low: float, high: float, storage: Column) -> tuple[Column, Column]:
    """Range of the values of an image: what is given, or (-999) what its storage allows."""
    least = F.lit(0.0 if low == -999.0 else float(low))
    if high != -999.0:
        return least, F.lit(float(high))
    top = F.when(storage == "byte", 255.0).when(storage == "uint16", 10000.0).when(storage.isin("float32", "float64"), 1.0)
    return least, top.otherwise(F.raise_error(F.concat(F.lit("unsupported storage "), storage)).cast("double"))


def block_percentiles(pixels: DataFrame, block: int = 2048, low: float = 0.01, high: float = 0.99, keys: tuple[str, ...] = ("band",)) -> DataFrame:
    """(keys, p_low, p_high): the least low and the largest high percentile of the blocks of an image."""
    each = pixels.groupBy(*keys, F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(F.percentile("v", low).alias("lo"), F.percentile("v", high).alias("hi"))
    return each.groupBy(*keys).agg(F.min("lo").alias("p_low"), F.max("hi").alias("p_high"))


def equalized(pixels: DataFrame, keys: tuple[str, ...] = ("band",), bins: int = 256) -> DataFrame:
    """8-bit pixels (keys, r, c, v) with equalised histogram: the share of pixels up to the value's bin, times 255, cut.

    The histogram has ``bins`` rows for each key, which are small enough to be broadcast.
    """
    limits = pixels.groupBy(*keys).agg(F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    place = F.when(F.col("__hi") == F.col("__lo"), F.lit(0)).otherwise(F.least(F.floor((F.col("v") - F.col("__lo")) / width), F.lit(bins - 1))).cast("long")
    binned = pixels.join(F.broadcast(limits), list(keys)).withColumn("__bin", place).drop("__lo", "__hi")
    from pyspark.sql import Window

    counts = binned.groupBy(*keys, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__bin")) / F.sum("__n").over(Window.partitionBy(*keys))
    table = counts.select(*keys, "__bin", F.floor(upto * F.lit(255.0)).cast("long").alias("__e"))
    return binned.join(F.broadcast(table), [*keys, "__bin"]).select(*keys, "r", "c", F.col("__e").alias("v"))
