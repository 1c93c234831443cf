"""Rasters made of tables: pixels (band, r, c, v) with a row for every place of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Side of the grid that line items are binned to.
SIDE = 96
#: Values of the binned bands are between 0 and this.
BANDS_MAX = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_arrays(rows: DataFrame, row_col: str, array_col: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """One band, 0 to 255: a line of the image for every row, a pixel for every element."""
    v = F.floor((F.col("x").cast("double") - low) * F.lit(255.0 / (high - low)))
    out = rows.select(F.col(row_col).cast("long").alias("r"), F.posexplode(array_col).alias("c", "x"))
    return out.select(F.lit(1).alias("band"), "r", F.col("c").cast("long").alias("c"), F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("long").alias("v"))


def embeddings_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def lineitem_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(r, c, b1 .. b4): line items binned to a grid; order-independent aggregates; empty cells 0."""
    items = table(spark, sf_dir, "lineitem")
    cells = items.groupBy((F.col("l_orderkey") % SIDE).alias("r"), (F.col("l_partkey") % SIDE).alias("c")).agg(
        F.max("l_quantity").alias("q"), F.max("l_tax").alias("t"), F.max("l_discount").alias("d"), F.max("l_extendedprice").alias("p")
    )
    grid = spark.range(SIDE * SIDE).select(F.floor(F.col("id") / SIDE).alias("r"), (F.col("id") % SIDE).alias("c"))
    hundredths = lambda x: F.floor(F.col(x) * 100 + 0.5).cast("long") * 1000
    bands = [F.floor("q").cast("long") * 200, hundredths("t"), hundredths("d"), F.least(F.lit(BANDS_MAX), F.floor(F.col("p") / 10)).cast("long")]
    filled = [F.coalesce(b, F.lit(0).cast("long")).alias(f"b{i}") for i, b in enumerate(bands, 1)]
    return grid.join(cells, ["r", "c"], "left").select("r", "c", *filled)


def long_bands(wide: DataFrame, bands: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """(band, r, c, v) of columns b1, b2, ...; only the bands that are asked for are read."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("v")) for i in bands)))
    return wide.select("r", "c", each.alias("x")).select("x.band", "r", "c", "x.v")


def events_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 0/1 mask of users by hour of the day: 1 where there was an event; dense."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("r"), F.hour("ts").cast("long").alias("c")).distinct()
    last = F.broadcast(seen.agg(F.max("r").alias("last")))
    grid = last.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("r")).select("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("c"))
    return grid.join(seen.withColumn("one", F.lit(1).cast("long")), ["r", "c"], "left").select(F.lit(1).alias("band"), "r", "c", F.coalesce("one", F.lit(0).cast("long")).alias("v"))
