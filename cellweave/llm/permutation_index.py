"""Nearest neighbours by a permutation index.

Pivots are a sample of the vectors whose number grows with the root of theirs. Every vector is represented by its
nearest pivots in order and posted in the inverted files of the first few. A query looks into the files of its own
nearest pivots, sums up the footrule distance between the two orders over the pivots that both have, and reranks by
the exact inner product what is near enough by it. How many files that are and how near is near enough is measured:
on a sample of queries, whose true neighbours one pass finds, so that a given share of these would be met.

Files are put together into buckets of about as many postings, which are the unit of work; a file of more is cut.
A candidate that several of a query's files have counts in the first of them only. What a query finds in its first
few files bounds what the others must give to be among its nearest, so a bucket passes on little. A query that finds too
few is compared with all vectors, in blocks. Equal vectors are one posting with their smallest ids, as no query
needs more than k + 1 of these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import table, type_of, written

K = 20
#: Pivots: so many times the root of the number of vectors, as long as they take no more than so many bytes.
DENSITY, PIVOT_BYTES = 8.0, 64 << 20
#: Files that a vector is posted in; pivots of the order that it is known by.
POSTED, ORDER = 4, 96
#: Files, of vectors by their nearest pivot, whose finds bound those of all.
FIRST = 8
#: Queries whose true neighbours are found; share of these that the files and the footrule distance must each meet.
SAMPLED, MET = 128, 0.97
#: Postings of a bucket, queries of a block, pairs that are ranked at once, finds that are held at once.
BUCKET, QUERY_BLOCK, PAIRS, HELD = 8192, 4096, 1 << 17, 1 << 21
#: Entries of the table of pivots' places in queries' orders.
PLACES = 1 << 23
FAR = np.int32(1 << 30)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: an id, no null or non-finite component, not zero; of an id with several vectors the first in order."""
    v = F.col("v")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kind = "float" if isinstance(type_of(vectors, vec_col).elementType, T.FloatType) else "double"
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v): equal vectors as one, with their k + 1 smallest ids; the window keeps so many a task before it shuffles."""
    order = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    ids = kept.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    return ids.select(F.col("ids")[0].alias("rep"), "ids", "v")


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors as lines of doubles; a shorter one is as if it went on with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if (ends == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size))
    out[np.arange(size)[None, :] < ends[:, None]] = flat
    return out


def numbers(column: pa.ChunkedArray, kind: np.dtype, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, -1).astype(np.int32)


@dataclass
class Pivots:
    """The pivots, the largest norm of all vectors, and what is derived of them."""

    base: np.ndarray
    top: float

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<i2") if len(self.base) < 1 << 15 else np.dtype("<i4")

    def orders(self, x: np.ndarray, n: int, query: bool) -> np.ndarray:
        """The n nearest pivots of every vector, in order; ties go to the pivot of the smaller number.

        Nearness to a pivot is the distance after a further component has brought all vectors to one norm, so that
        the nearest by distance is the largest by inner product; a query's further component is 0.
        """
        near = x @ self.base.T
        if not query:
            own, extra = (np.sqrt(np.maximum(self.top * self.top - (a * a).sum(1), 0)) for a in (x, self.base))
            near += np.outer(own, extra)
        if n < near.shape[1]:
            first = np.sort(np.argpartition(-near, n - 1, axis=1)[:, :n], axis=1)
            order = np.argsort(-np.take_along_axis(near, first, 1), axis=1, kind="stable")
            return np.take_along_axis(first, order, 1).astype(np.int32)
        return np.argsort(-near, axis=1, kind="stable").astype(np.int32)


def coded(vecs: DataFrame, pivots: Pivots, n: int, query: bool) -> DataFrame:
    """(rep, ids, v, order: the numbers of the n nearest pivots, as bytes)."""
    shared = vecs.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType([*(vecs.schema[x] for x in ("rep", "ids", "v")), T.StructField("order", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, len(b), 2048)):
            orders = own.orders(matrix(batch.column(2), own.base.shape[1]), n, query).astype(own.kind)
            yield batch.append_column("order", pa.array([x.tobytes() for x in orders], pa.binary()))

    return vecs.select("rep", "ids", "v").mapInArrow(run, schema)


def gains(orders: np.ndarray, own: np.ndarray, length: int) -> np.ndarray:
    """By how much the footrule distance of each order to ``own`` is less than that of orders without a common pivot, halved.

    A pivot that one of them lacks is at place ``length`` there, so pivots at places a and b of the two gain length - max(a, b).
    """
    place = np.full(max(int(orders.max(initial=0)), int(own.max(initial=0))) + 1, length, np.int32)
    place[own[:length]] = np.arange(min(length, len(own)))
    return (length - np.maximum(place[orders[:, :length]], np.arange(min(length, orders.shape[1]))[None, :])).sum(1)


def best_so_far(q: np.ndarray, key: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Places of the best ``most`` of every q: by score, then by the smaller key."""
    order = np.lexsort((key, -score, q))
    q = q[order]
    first = np.searchsorted(q, q)
    return order[np.arange(len(q)) - first < most]


def true_neighbours(codes: DataFrame, asking: list, pivots: Pivots, k: int, posted: int, length: int) -> list[tuple[int, int]]:
    """Of each of the k nearest of each given query (its rep, vector): the place, in the query's order, of the first pivot that it is posted under, and its gain.

    A task keeps the best of every query; the driver gets k rows a query.
    """
    kind, size = type_of(codes, "rep"), pivots.base.shape[1]
    y = np.array([list(v) + [0.0] * (size - len(v)) for _, v in asking], np.float64)
    shared = codes.sparkSession.sparkContext.broadcast((y, pivots.orders(y, len(pivots.base), True), pivots.kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, whole, kind_ = shared.value
        held = None
        for batch in batches:
            if not len(batch):
                continue
            score = matrix(batch.column(2), size) @ y.T
            most = min(k + 1, len(batch))
            at = np.argpartition(-score, most - 1, axis=0)[:most]
            new = pa.table([pa.array(np.tile(np.arange(len(y), dtype=np.int32), most)), pa.array(np.take_along_axis(score, at, 0).ravel()), *(batch.column(x).take(pa.array(at.ravel())) for x in (0, 3))], names=["q", "score", "rep", "order"])
            held = new if held is None else pa.concat_tables([held, new])
            held = held.take(pa.array(best_so_far(held["q"].to_numpy(), np.arange(len(held)), held["score"].to_numpy(), k + 1)))
        if held is not None:
            orders, q = numbers(held["order"], kind_, len(held)), held["q"].to_numpy()
            place = np.argsort(whole, axis=1, kind="stable")  # of every pivot in every query's order
            first = np.take_along_axis(place[q], orders[:, :posted], 1).min(1).astype(np.int32)
            gain = np.concatenate([gains(orders[x : x + 1], whole[q[x]], length) for x in range(len(q))]).astype(np.int32)
            yield from pa.table([held["q"], held["score"], held["rep"], pa.array(first), pa.array(gain)], names=["q", "score", "rep", "first", "gain"]).to_batches()

    schema = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("rep", kind), T.StructField("first", T.IntegerType()), T.StructField("gain", T.IntegerType())])
    found = codes.mapInArrow(run, schema)
    own = F.array(*(F.lit(r) for r, _ in asking))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    kept = found.where(F.col("rep") != F.element_at(own, F.col("q") + 1)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return [(r["first"], r["gain"]) for r in kept.select("first", "gain").collect()]


class Bucket:
    """Postings of some files in one task: ranks them for queries by footrule, and what is near by the inner product."""

    def __init__(self, posted: pa.Table, kind: np.dtype, size: int, n_posted: int, length: int):
        self.x, self.orders = matrix(posted["v"], size), numbers(posted["order"], kind, len(posted))[:, :length]
        self.length, self.n_posted = length, n_posted
        self.pivots, flat = np.unique(self.orders, return_inverse=True)
        self.local = flat.reshape(self.orders.shape)
        files = posted["pivot"].to_numpy()
        order = np.argsort(files, kind="stable")
        names, starts = np.unique(files[order], return_index=True)
        self.files = dict(zip(names.tolist(), np.split(order, starts[1:]), strict=True))

    def rank(self, y: np.ndarray, asked: np.ndarray, probed: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, posting, inner product) of what gains at least ``least`` in the files of the queries' first ``probed`` pivots."""
        step = max(1, PLACES // len(self.pivots))
        for k in range(0, len(y), step):
            for q, x, score in self.rank_some(y[k : k + step], asked[k : k + step], probed, least):
                yield q + k, x, score

    def rank_some(self, y: np.ndarray, asked: np.ndarray, probed: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at = np.minimum(np.searchsorted(self.pivots, asked), len(self.pivots) - 1)
        there = self.pivots[at] == asked
        place = np.full((len(y), len(self.pivots)), FAR, np.int32)  # of the pivots here, in the queries' orders
        q, j = np.nonzero(there)
        place[q, at[q, j]] = j
        near = np.where(there[:, : self.length], at[:, : self.length], -1)
        for pivot, own in self.files.items():
            column = place[:, np.searchsorted(self.pivots, pivot)]
            asking = np.flatnonzero(column < probed)
            step = max(1, PAIRS // max(1, len(own)))
            for some in (asking[k : k + step] for k in range(0, len(asking), step)):
                qi, xi = self.near(place[some], column[some], near[some], own, least)
                a, b = some[qi], own[xi]
                yield a, b, np.einsum("ij,ij->i", self.x[b], y[a])

    def near(self, place: np.ndarray, column: np.ndarray, near: np.ndarray, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one file of which it is the first that the query shares with the vector, and that gain enough."""
        first = place[:, self.local[own, : self.n_posted]].min(2) == column[:, None]
        flat = self.local[own].ravel()
        order = np.argsort(flat, kind="stable")
        edges = np.searchsorted(flat[order], np.arange(len(self.pivots) + 1))
        q, j = np.nonzero(near >= 0)
        lo, n = edges[near[q, j]], np.diff(edges)[near[q, j]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)
        posting, rank = np.divmod(order[at], self.orders.shape[1])
        gain = np.bincount(np.repeat(q, n) * len(own) + posting, self.length - np.maximum(np.repeat(j, n), rank), len(place) * len(own))
        return np.nonzero(first & (gain.reshape(len(place), len(own)) >= least))


def emitted(posted: pa.Table, asking: pa.Table, finds: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.Table:
    """(query, vec_id, score): the k + 1 best finds of every query that are not below its bound, ties by the smallest id of a vector, with all the ids that it has."""
    kind = posted.schema.field("rep").type
    _, smaller = np.unique(np.array(posted["rep"].to_pylist()), return_inverse=True)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, x, s = (np.concatenate(c) for c in zip(*parts, strict=True))
        keep = best_so_far(q, smaller[x], s, k + 1)
        return [(q[keep], x[keep], s[keep])]

    bound = asking["bound"].to_numpy() if "bound" in asking.column_names else None
    for part in finds:
        keep = part[2] >= bound[part[0]] if bound is not None else slice(None)
        parts.append(tuple(c[keep] for c in part))
        if sum(len(p[0]) for p in parts) > HELD:
            parts = best()
    q, x, s = best()[0] if parts else (np.array([], int), np.array([], int), np.array([]))
    ids = posted["ids"].combine_chunks().take(pa.array(x, pa.int64()))
    n = np.diff(ids.offsets.to_numpy()) if len(x) else np.array([], int)
    reps = asking["rep"].combine_chunks().take(pa.array(np.repeat(q, n), pa.int64()))
    return pa.table({"query": reps.cast(kind), "vec_id": ids.flatten().cast(kind), "score": pa.array(np.repeat(s, n), pa.float64())})


def found_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query", kind), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())])


def buckets_of(sizes: np.ndarray, bucket: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every file its bucket, and into how many parts the bucket is cut: files of more postings than a bucket are alone."""
    home, cuts, at, held = np.zeros(len(sizes), np.int64), [1], 0, 0
    for p, n in enumerate(sizes.tolist()):
        if held and held + n > bucket:
            at, held = at + 1, 0
            cuts.append(1)
        home[p], held = at, held + n
        cuts[at] = max(1, ceil(held / bucket))
    return home, np.array(cuts)


def searched(codes: DataFrame, asks: DataFrame, pivots: Pivots, k: int, posted: int, length: int, probed: int, least: int) -> DataFrame:
    """(query, vec_id, score): the k + 1 nearest postings of every query, not below its bound, in every bucket that has a file of it."""
    spark, kind, size, code = codes.sparkSession, type_of(codes, "rep"), pivots.base.shape[1], pivots.kind
    n_pivots = len(pivots.base)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_pivots, np.int64)
        for batch in batches:
            n += np.bincount(numbers(batch.column(0), code, len(batch))[:, :posted].ravel(), minlength=n_pivots) if len(batch) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(n).astype(np.int32)), pa.array(n[n > 0])], ["pivot", "n"])

    sizes = np.zeros(n_pivots, np.int64)
    for p, n in codes.select("order").mapInArrow(counted, "pivot int, n long").groupBy("pivot").sum("n").collect():  # a row a pivot
        sizes[p] = n
    shared = spark.sparkContext.broadcast(buckets_of(sizes, BUCKET))

    def spread(first: int, query: bool) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            home, cuts = shared.value
            for batch in (b.slice(x, 1024) for b in batches for x in range(0, len(b), 1024)):
                own = numbers(batch.column("order"), code, len(batch))[:, :first] if len(batch) else np.zeros((0, 1), int)
                if query:  # once to every bucket that has a file of it
                    row, bucket = np.divmod(np.unique(np.arange(len(own))[:, None] * len(cuts) + home[own]), len(cuts))
                    pivot = np.full(len(row), -1, np.int32)
                else:
                    row, pivot = np.repeat(np.arange(len(own)), own.shape[1]), own.ravel().astype(np.int32)
                    bucket = home[pivot]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(cuts[bucket].astype(np.int32)), pa.array(pivot), *(c.take(pa.array(row)) for c in batch.columns)], ["bucket", "cuts", "pivot", *batch.schema.names])

        return run

    schema = lambda df: T.StructType([*(T.StructField(x, T.IntegerType()) for x in ("bucket", "cuts", "pivot")), *df.schema.fields])
    blocks = max(1, ceil(asks.count() / QUERY_BLOCK))
    mine = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = codes.mapInArrow(spread(posted, False), schema(codes)).select("*", mine(F.col("cuts")).alias("cut"), every(F.lit(blocks)).alias("block"))
    right = asks.mapInArrow(spread(probed, True), schema(asks)).select("*", mine(F.lit(blocks)).alias("block"), every(F.col("cuts")).alias("cut"))

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        if not (have.num_rows and want.num_rows):
            return emitted(have, want, iter(()), k)
        bucket = Bucket(have, code, size, posted, length)
        return emitted(have, want, bucket.rank(matrix(want["v"], size), numbers(want["order"], code, len(want)), probed, least), k)

    keys = ("bucket", "cut", "block")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(rank, found_schema(kind))


def exhaustive(vecs: DataFrame, wanted: DataFrame, n: int, asked: int, size: int, k: int) -> DataFrame:
    """(query, vec_id, score): the k + 1 nearest of every wanted query in every block of the vectors."""
    cut, block = max(1, ceil(n / BUCKET)), max(1, ceil(asked / QUERY_BLOCK))
    mine = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vecs.select("rep", "ids", "v", mine(cut).alias("cut"), every(block).alias("block"))
    right = wanted.select("rep", "ids", "v", mine(block).alias("block"), every(cut).alias("cut"))

    def rank(have: pa.Table, want: pa.Table) -> pa.Table:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            x, y = matrix(have["v"], size), matrix(want["v"], size)
            for at in range(0, len(y), 64):
                score = y[at : at + 64] @ x.T
                yield np.repeat(np.arange(at, at + len(score)), len(x)), np.tile(np.arange(len(x)), len(score)), score.ravel()

        return emitted(have, want, pairs() if have.num_rows and want.num_rows else iter(()), k)

    return left.groupBy("cut", "block").cogroup(right.groupBy("cut", "block")).applyInArrow(rank, found_schema(type_of(vecs, "rep")))


def nearest(vectors: DataFrame, divisor: int = 20, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", density: float = DENSITY, posted: int = POSTED, order: int = ORDER, met: float = MET, sampled: int = SAMPLED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id ``divisor`` divides.

    Null ids and unusable vectors (null, empty, zero, null or non-finite components) take no part. A shorter vector
    is as if it went on with zeros. Rows of one id and vector are one; of an id with several vectors the first in order
    takes part. Ties go to the smaller id. An empty table, or a query without
    candidates, gives no rows; fewer candidates than k are all given. Other columns are not looked at.
    density, posted, order and met trade recall for work; ``sampled`` queries are what ``met`` is measured on.
    """
    rows = written(usable(vectors, id_col, vec_col), "usable")
    vecs = written(distinct_vectors(rows, k), "vectors")
    kind = type_of(vectors, id_col)
    n, top, size = vecs.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))), F.max(F.size("v"))).first()
    asking = rows.where(F.pmod(F.col("vec_id"), F.lit(divisor)) == 0)
    asked = written(asking.join(vecs.select(F.col("v").alias("v2"), "rep"), F.col("v") == F.col("v2")).select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    wanted = written(vecs.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "ids", "v"), "wanted")
    by_hash = lambda seed: [F.xxhash64("rep", F.lit(seed)), F.col("rep")]
    # Another seed than the pivots': a query that is a pivot would be nearer to its neighbours' pivots than others are.
    sample = [(r[0], r[1]) for r in wanted.orderBy(*by_hash(1)).limit(sampled).select("rep", "v").collect()]
    if not sample:
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", kind), T.StructField("score", T.DoubleType())]))
    most = max(1, min(n, ceil(density * sqrt(n)), PIVOT_BYTES // (8 * size)))
    base = [list(r[0]) + [0.0] * (size - len(r[0])) for r in vecs.orderBy(*by_hash(0)).limit(most).select("v").collect()]
    pivots = Pivots(np.array(base, np.float64), top)
    posted, order = min(posted, most), min(order, most)
    codes = written(coded(vecs, pivots, order, False), "codes")
    measured = true_neighbours(codes, sample, pivots, k, posted, order) or [(0, 0)]
    first, gain = np.array(measured).T
    probed, least = int(np.quantile(first, met, method="higher")) + 1, int(np.quantile(gain, 1 - met, method="lower"))
    asks = written(coded(wanted, pivots, max(order, probed), True), "asks")
    begun = best_of(searched(codes, asks, pivots, k, 1, order, min(FIRST, most), 0), k).where(F.size("best") > k)
    bounds = begun.select(F.col("query").alias("rep"), (-F.element_at("best", -1)["less"]).alias("bound"))
    asks = written(asks.join(bounds, "rep", "left").select(*asks.columns, F.coalesce("bound", F.lit(float("-inf"))).alias("bound")), "bounded")
    found = searched(codes, asks, pivots, k, posted, order, probed, least)
    lists = written(best_of(found, k), "found")
    # The exact way for the rest: those with too few finds are compared with everything.
    enough = lists.where(F.size("best") > k).select(F.col("query").alias("rep"))
    poor = written(wanted.join(enough, "rep", "left_anti").select("rep", "ids", "v"), "poor")
    if many := poor.count():
        more = written(best_of(exhaustive(vecs, poor, n, many, size, k), k), "more")
        lists = lists.join(more.select("query"), "query", "left_anti").union(more)
    own = asked.join(lists, asked["rep"] == lists["query"]).select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))


def best_of(found: DataFrame, k: int) -> DataFrame:
    """(query, best): each query's k + 1 nearest ids of what the buckets gave, which is so many a bucket at most."""
    once = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    kept = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    return kept.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("best"))


def op5_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
