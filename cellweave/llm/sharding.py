"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A document descends region, rack and shard levels. At each level every child draws, and the least draw wins. A
shard's draw is made of the hash of the document's id and the shard's name and is exponential with its weight as
rate; the draw of a rack or region is the least within it, which is exponential with the sum of its weights as rate.
So a child gets its share by weight, and as no draw depends on another shard's weight, a change of weights moves
documents only into or out of the shards whose weights changed: one more shard, wherever it is put in the tree,
takes documents only into itself, whatever the number of shards before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import table, with_rank

#: Shards of a rack and racks of a region.
RACK, REGION = 5, 2
SHARDS = 40
#: Pieces in which a shard's slots are numbered; a fixed number, as slots depend on it.
CHUNKS = 1024


def topology(weights: list[float], rack: int = RACK, region: int = REGION) -> list[list[list[tuple[int, float]]]]:
    """regions -> racks -> (shard, weight): shards fill racks, and racks fill regions, in order. What has no weight is left out."""
    racks = [[(s, w) for s, w in list(enumerate(weights))[k : k + rack] if w > 0] for k in range(0, len(weights), rack)]
    regions = [[r for r in racks[k : k + region] if r] for k in range(0, len(racks), region)]
    return [r for r in regions if r]


def draw(key: Column, name: Column, weight: Column) -> Column:
    """An exponential draw of rate weight, from a hash of 52 bits."""
    u = (F.shiftrightunsigned(F.xxhash64(key, name), 12).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def tree_shard(key: Column, weights: list[float], rack: int = RACK, region: int = REGION) -> Column:
    """The shard of a key. Weights must not be negative, and one of them must be above 0. Equal draws go to the smaller shard."""
    if any(w < 0 for w in weights) or not sum(weights) > 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    shard = lambda s, w: F.struct(F.lit(s).alias("s"), F.lit(f"shard/{s}").alias("name"), F.lit(float(w)).alias("w"))
    tree = F.array(*(F.array(*(F.array(*(shard(s, w) for s, w in k)) for k in r)) for r in topology(weights, rack, region)))
    of_rack = lambda k: F.array_min(F.transform(k, lambda x: F.struct(draw(key, x["name"], x["w"]).alias("d"), x["s"].alias("s"))))
    of_region = lambda r: F.array_min(F.transform(r, of_rack))
    return F.array_min(F.transform(tree, of_region))["s"].cast("int")


def shard(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", out: str = "shard") -> DataFrame:
    """docs with the shard of every row in the column ``out``.

    All columns are kept; one that has this name already goes on as the first free one of ``out``_1, ``out``_2, ...
    Null ids are one key of their own, repeated rows have one shard, and an empty table gives an empty one.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    if out not in docs.columns:
        return docs.withColumn(out, tree_shard(key, weights))
    free = next(x for k in range(1, len(docs.columns) + 2) if (x := f"{out}_{k}") not in docs.columns)
    placed = tree_shard(F.coalesce(F.col(free if id_col == out else id_col).cast("string"), F.lit("")), weights)
    return docs.withColumnRenamed(out, free).withColumn(out, placed)


def op6_hierarchical_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law "key": the id and the number of shards decide; one more shard takes rows only into itself.

    Null ids are one key, null texts have no bytes; repeated rows are placed alike and have slots of their own.
    Columns besides doc_id and text are not looked at. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.select("*", F.lit("key").alias("law"), tree_shard(key, [1.0] * SHARDS).alias("shard"), tree_shard(key, [1.0] * (SHARDS + 1)).alias("grown_shard"))
    ranked = with_rank(rows, F.col("shard"), [F.col("doc_id"), F.col("text_crc32")], F.struct("doc_id", "text_crc32"), "slot", CHUNKS)
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
