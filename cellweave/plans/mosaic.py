"""Tables of tiles: written with their status, resumed, joined, stacked and thinned out."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.geometry import extent, spread_to_sections
from cellweave.plans.features import spatial_features
from cellweave.spec import FeatureSpec

#: Triggers that need the whole image, and pixels around a section that any other may need.
IMAGE_WIDE, MARGIN = ("saliency",), 16
#: Triggers whose images are made section by section, and how many such steps (an equalised image, one made of it, windows) may follow one another.
SECTION_WIDE, STEPS = ("dmp", "lsr", "orb", "seg"), 3
STATUS = "trigger string, band int, tr long, tc long, section_size int, state string, written timestamp"


def tile_of(spec: FeatureSpec) -> dict:
    """Columns tr and tc of cells (bi, bj)."""
    cells = spec.step() // spec.block
    return {"tr": F.floor(F.col("bi") / cells), "tc": F.floor(F.col("bj") / cells)}


def margin_of(spec: FeatureSpec) -> int:
    """Pixels around a section that stencils and smoothing may look at."""
    return max(spec.largest, MARGIN) + spec.smooth // 2


def sections_around(spec: FeatureSpec, triggers: tuple[str, ...] | None = None) -> int:
    """How many sections around a tile its values depend on: 0 where no step takes sections as a whole."""
    by_section = spec.equalize or spec.equalize_adapt or any(t in SECTION_WIDE for t in triggers or spec.triggers)
    return STEPS * -(-(spec.halo + 2 * margin_of(spec)) // spec.step()) if by_section else 0


def with_surroundings(tiles: DataFrame, reach: int) -> DataFrame:
    """(tr, tc) of tiles and of all that are up to ``reach`` of them away; some may not be of the image."""
    around = F.sequence(F.lit(-reach), F.lit(reach))
    out = tiles.select(F.explode(F.transform(around, lambda x: F.col("tr") + x)).alias("tr"), "tc")
    return out.select("tr", F.explode(F.transform(around, lambda x: F.col("tc") + x)).alias("tc")).distinct()


def all_tiles(spark: SparkSession, spec: FeatureSpec, rows: int, cols: int) -> DataFrame:
    """(tr, tc) of every tile with cells."""
    n, m = spec.out_size(rows, cols)
    tiles = lambda x: -(-x * spec.block // spec.step())
    if not n or not m:
        return spark.createDataFrame([], "tr long, tc long")
    return spark.range(tiles(n) * tiles(m)).select(F.floor(F.col("id") / tiles(m)).alias("tr"), (F.col("id") % tiles(m)).alias("tc"))


def latest(status: DataFrame) -> DataFrame:
    """The last state of every trigger, band and tile."""
    return status.groupBy("trigger", "band", "tr", "tc").agg(F.max_by(F.struct("state", "section_size"), "written").alias("s")).select("trigger", "band", "tr", "tc", "s.state", "s.section_size")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def unfinished(spark: SparkSession, spec: FeatureSpec, path: str, rows: int, cols: int) -> DataFrame:
    """(trigger, band, tr, tc) without a complete tile of this section size."""
    wanted = all_tiles(spark, spec, rows, cols)
    wanted = wanted.select(F.explode(F.array(*map(F.lit, spec.triggers))).alias("trigger"), "tr", "tc").select("trigger", F.explode(F.array(*map(F.lit, spec.bands))).alias("band"), "tr", "tc")
    if not exists(spark, f"{path}/status"):
        return wanted
    done = latest(spark.read.schema(STATUS).parquet(f"{path}/status")).where((F.col("state") == "complete") & (F.col("section_size") == spec.section_size))
    return wanted.join(done, ["trigger", "band", "tr", "tc"], "left_anti")


def write_tiles(pixels: DataFrame, spec: FeatureSpec, path: str, size: tuple[int, int] | None = None, overwrite: bool = False) -> DataFrame:
    """Writes the features of all unfinished tiles under ``path``/tiles, and their state under ``path``/status; returns the latest states.

    Tiles are partitions by trigger, band and place, replaced one by one. A tile with a missing or non-finite value
    is corrupt, and made again next time; so are those of another section size. A run that is cut off between the
    two writes leaves tiles without a state, which are made again too. Only the pixels that unfinished tiles
    read are computed with; where a step takes sections as a whole, these are all of the sections that it reaches.
    """
    spark = pixels.sparkSession
    size = size or extent(pixels)
    todo = unfinished(spark, spec, path, *size) if not overwrite else unfinished(spark, spec, f"{path}/none", *size)
    # A row for each tile, trigger and band: small, but not bounded by anything, so it stays a table.
    for trigger in spec.triggers:
        own = todo.where(F.col("trigger") == trigger)
        if not own.limit(1).count():
            continue
        needed = pixels
        if trigger not in IMAGE_WIDE:
            spread = spread_to_sections(pixels, spec, *size, margin=margin_of(spec))
            tiles = with_surroundings(own.select("tr", "tc").distinct(), sections_around(spec, (trigger,)))
            needed = spread.join(tiles, ["tr", "tc"], "left_semi").select(*pixels.columns).dropDuplicates(["band", "r", "c"])
        single = _only(spec, trigger)
        made = spatial_features(needed, single, size).withColumns(tile_of(spec)).join(own, ["trigger", "band", "tr", "tc"], "left_semi")
        made.repartition("trigger", "band", "tr", "tc").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trigger", "band", "tr", "tc").parquet(f"{path}/tiles")
        # Tiles that had nothing to write are judged with the rest.
        back = spark.read.parquet(f"{path}/tiles").where(F.col("trigger") == trigger)
        bad = F.count_if(F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf")))
        states = back.groupBy("trigger", "band", "tr", "tc").agg(bad.alias("bad")).select("trigger", "band", F.col("tr").cast("long"), F.col("tc").cast("long"), "bad")
        seen = own.join(states, ["trigger", "band", "tr", "tc"], "left")
        state = F.when(F.col("bad").isNull(), "incomplete").when(F.col("bad") > 0, "corrupt").otherwise("complete")
        seen.select("trigger", "band", "tr", "tc", F.lit(spec.section_size).alias("section_size"), state.alias("state"), F.current_timestamp().alias("written")).coalesce(1).write.mode("append").parquet(f"{path}/status")
    return latest(spark.read.schema(STATUS).parquet(f"{path}/status"))


def _only(spec: FeatureSpec, trigger: str) -> FeatureSpec:
    from dataclasses import replace

    return replace(spec, triggers=(trigger,))


def log_parameters(spark: SparkSession, spec: FeatureSpec, path: str, **more) -> None:
    """Appends a line of JSON with the parameters, when they were used and what else is given to the log under ``path``/parameters."""
    from dataclasses import asdict

    line = json.dumps({"when": datetime.now(UTC).isoformat(timespec="seconds"), **more, **asdict(spec)}, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{path}/parameters")


def finished(states: DataFrame) -> DataFrame:
    """One row: whether every tile is complete, and how many are in which state."""
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return states.agg((F.count_if(F.col("state") != "complete") == 0).alias("all_finished"), count("complete"), count("corrupt"), count("incomplete"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """(out_band, bi, bj, value) of tiles that may overlap: places without a value are 0, and of several values the last tile's holds."""
    last = tiles.groupBy("out_band", "bi", "bj").agg(F.max_by("value", F.struct("tr", "tc")).alias("value"))
    return last.select("out_band", "bi", "bj", F.coalesce(F.when(~F.isnan("value"), F.col("value")), F.lit(0.0)).alias("value"))


def stack(tables: list[DataFrame]) -> DataFrame:
    """Several wide tables (bi, bj, columns) side by side; columns of one name are told apart by the table's number."""
    names: set[str] = set()
    out = None
    for i, t in enumerate(tables):
        own = [c for c in t.columns if c not in ("bi", "bj")]
        t = t.select("bi", "bj", *(F.col(c).alias(f"{c}__{i + 1}" if c in names else c) for c in own))
        names |= set(own)
        out = t if out is None else out.join(t, ["bi", "bj"], "full_outer")
    return out


def overviews(cells: DataFrame, factors: tuple[int, ...] = (2, 4, 8, 16), keys: tuple[str, ...] = ("out_band",), how: str = "nearest") -> DataFrame:
    """(factor, keys, bi, bj, value): the grid thinned out by every factor, by its upper left cell or by the mean."""
    each = cells.select(F.explode(F.array(*map(F.lit, factors))).alias("factor"), *keys, "bi", "bj", "value")
    if how == "nearest":  # a filter: nothing is shuffled
        kept = each.where((F.col("bi") % F.col("factor") == 0) & (F.col("bj") % F.col("factor") == 0))
        return kept.select("factor", *keys, F.floor(F.col("bi") / F.col("factor")).alias("bi"), F.floor(F.col("bj") / F.col("factor")).alias("bj"), "value")
    places = [F.floor(F.col(x) / F.col("factor")).alias(x) for x in ("bi", "bj")]
    return each.groupBy("factor", *keys, *places).agg(F.avg("value").alias("value"))


def numbered(states: DataFrame) -> DataFrame:
    """states with the number of their tile, row by row from 1."""
    width = F.max("tc").over(Window.partitionBy("trigger", "band")) + 1
    return states.withColumn("tile", F.col("tr") * width + F.col("tc") + 1)
