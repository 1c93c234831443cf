"""Features of pixels that arrive file by file.

Each micro-batch is stored by tile as it comes. A tile is whole when it has all pixels of its section and margin, so files
may arrive in any order and more than once; it is computed and written once it and all tiles that its values depend
on are whole, with their pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellweave.geometry import spread_to_sections
from cellweave.plans.features import spatial_features
from cellweave.plans.mosaic import IMAGE_WIDE, all_tiles, exists, margin_of, sections_around, tile_of, with_surroundings
from cellweave.spec import FeatureSpec, SpecError

PIXELS = "band int, r long, c long, v double"
TILES = "tr long, tc long, batch long"


def read_pixel_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PIXELS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def bands_needed(spec: FeatureSpec) -> tuple[int, ...]:
    """The bands whose pixels a tile needs: those asked for, those of spectral indices, and three for segments."""
    colours = {spec.sensor_bands[c] for t in spec.triggers for c in spec.colours(t)}
    plain = set(spec.bands) if any(not spec.colours(t) and t != "seg" for t in spec.triggers) else set()
    return tuple(sorted(plain | colours | ({1, 2, 3} if "seg" in spec.triggers else set())))


def whole_tiles(spread: DataFrame, spec: FeatureSpec, rows: int, cols: int) -> DataFrame:
    """(tr, tc) of the tiles of spread pixels (tr, tc, band, r, c) that have every pixel, of every band, of the section and its margin."""
    step, size, margin = spec.step(), spec.step() + spec.halo, margin_of(spec)
    counted = spread.groupBy("tr", "tc").agg(F.count(F.lit(1)).alias("n"))

    def side(t: str, n: int) -> Column:
        return F.least(F.col(t) * step + size + margin, F.lit(n).cast("long")) - F.greatest(F.col(t) * step - margin, F.lit(0).cast("long"))

    return counted.where(F.col("n") == side("tr", rows) * side("tc", cols) * len(bands_needed(spec))).select("tr", "tc")


def feature_stream(stream: DataFrame, spec: FeatureSpec, size: tuple[int, int], path: str, once: bool = True) -> StreamingQuery:
    """Starts a query that writes (trigger, .., value, tr, tc) of every tile once it is ready, under ``path``/features.

    Pixels are stored by tile, so a batch reads again only the tiles that it adds to and those around them, however long
    the stream. Triggers that need the whole image are refused; values are those of the whole image otherwise.
    """
    if wide := [t for t in spec.triggers if t in IMAGE_WIDE]:
        raise SpecError(f"{', '.join(wide)} needs the whole image, which a stream does not have")
    reach = sections_around(spec)

    def before(spark: SparkSession, name: str, number: int) -> DataFrame:
        """The tiles of a list of earlier batches; a batch that is run again does not see its own."""
        if not exists(spark, f"{path}/{name}"):
            return spark.createDataFrame([], "tr long, tc long")
        return spark.read.schema(TILES).parquet(f"{path}/{name}").where(F.col("batch") < number).select("tr", "tc")

    def ingest(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = spread_to_sections(batch.where(F.col("band").isin(*bands_needed(spec))), spec, *size, margin=margin_of(spec))
        arrived.write.mode("overwrite").partitionBy("tr", "tc").parquet(f"{path}/pixels/batch={number}")
        held = spark.read.schema(f"{PIXELS}, batch long, tr long, tc long").parquet(f"{path}/pixels").where(F.col("batch") <= number)
        touched = held.where(F.col("batch") == number).select("tr", "tc").distinct().join(before(spark, "whole", number), ["tr", "tc"], "left_anti")
        own = held.join(touched, ["tr", "tc"], "left_semi").select("tr", "tc", "band", "r", "c").distinct()
        whole_tiles(own, spec, *size).write.mode("overwrite").parquet(f"{path}/whole/batch={number}")
        new = spark.read.schema("tr long, tc long").parquet(f"{path}/whole/batch={number}")
        # A tile is ready if none of those around it that the image has is missing.
        every = all_tiles(spark, spec, *size)
        open_ = with_surroundings(new, reach).join(every, ["tr", "tc"], "left_semi").join(before(spark, "done", number), ["tr", "tc"], "left_anti")
        missing = every.join(new.union(before(spark, "whole", number)), ["tr", "tc"], "left_anti")
        open_.join(with_surroundings(missing, reach), ["tr", "tc"], "left_anti").write.mode("overwrite").parquet(f"{path}/done/batch={number}")
        ready = spark.read.schema("tr long, tc long").parquet(f"{path}/done/batch={number}")
        used = held.join(with_surroundings(ready, reach), ["tr", "tc"], "left_semi").select("band", "r", "c", "v").dropDuplicates(["band", "r", "c"])
        made = spatial_features(used, spec, size).withColumns(tile_of(spec)).join(ready, ["tr", "tc"], "left_semi")
        made.write.mode("overwrite").parquet(f"{path}/features/batch={number}")

    writer = stream.writeStream.foreachBatch(ingest).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if once else writer).start()
