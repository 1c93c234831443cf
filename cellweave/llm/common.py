"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A key is hot if it has over HOT_ROWS rows and over a HOT_KEYS-th of all: there are HOT_KEYS of these at most.
HOT_ROWS, HOT_KEYS = 1000, 10_000
#: Rounds of the component search, which halves what is left in a round or two.
MOST_ROUNDS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run on one machine may it be unset: a temporary folder then."""
    base, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own_dirs:
            _own_dirs[app] = f"file://{tempfile.mkdtemp(prefix='cellweave-')}"
        base = _own_dirs[app]
    return f"{base}/cellweave-{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def with_rank(df: DataFrame, group: Column, order: list[Column], chunk_of: Column, out: str, chunks: int) -> DataFrame:
    """Adds ``out``: a gapless rank from 0 within each group, without one task holding a whole group.

    Rows of a group are dealt over ``chunks`` pieces by a hash; a piece's offset is the running count of
    the pieces before it, and only a piece is ever sorted in one task.
    """
    from pyspark.sql import Window

    cols = df.columns
    df = df.withColumns({"__g": group, "__c": F.pmod(F.xxhash64(chunk_of), F.lit(chunks)).cast("int")})
    # The counts are a row a group and chunk: they are numbered by group, which has at most ``chunks`` rows.
    counts = df.groupBy("__g", "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__g").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__g", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    local = df.withColumn("__r", F.row_number().over(Window.partitionBy("__g", "__c").orderBy(*order)) - 1)
    return local.join(offsets, ["__g", "__c"]).select(*cols, (F.col("__o") + F.col("__r")).cast("long").alias(out))


def join_hot(rows: DataFrame, side: DataFrame, on: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row a key, whose column ``size`` says how many rows have the key, ``total`` being all.

    Hot keys, which are HOT_KEYS at most, are broadcast, so that no task gets all rows of one; the others are shuffled.
    """
    hot = F.col(size) > max(HOT_ROWS, total // HOT_KEYS)
    first = rows.join(F.broadcast(side.where(hot).drop(size)), on)
    rest = rows.join(F.broadcast(side.where(hot).select(on)), on, "left_anti")
    return first.unionByName(rest.join(side.where(~hot).drop(size), on, how))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of (a, b) long edges: rows (node, component = the smallest node reachable).

    Alternates large-star and small-star steps until the edges are stars; raises if they don't become such. Every
    round is an aggregation by node and a join with it; a hub is one row of the aggregate, and its edges are split
    by adaptive execution. Each round is written to the shared folder.
    """
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    cur = written(edges.where("a <> b").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), name)
    last = None
    for _ in range(MOST_ROUNDS):
        # Large star: every larger neighbour of a node points to the smallest of it and its neighbours.
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(b.alias("a"), m.alias("b"))
        # Small star: a node and its smaller neighbours point to the smallest of these.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(b == m, a).otherwise(b).alias("a"), m.alias("b"))
        small = small.union(low.select("a", m.alias("b")))
        new = written(small.distinct(), name)
        sign = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if sign == last:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last, cur = sign, new
    raise RuntimeError(f"the components are not found after {MOST_ROUNDS} rounds")


def varpack(values: np.ndarray) -> bytes:
    """Small non-negative integers as one byte each, larger ones as an escape and four or eight bytes."""
    small = np.minimum(values, 255).astype(np.uint8)
    return np.uint64(len(values)).tobytes() + small.tobytes() + values[values >= 255].astype("<u8").tobytes()


def varunpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    out = np.frombuffer(data, np.uint8, n, 8).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", -1, 8 + n).astype(np.int64)
    return out
