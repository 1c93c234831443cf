"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within ``distance`` bits must, in some partition i of m, be within t_i bits, if the thresholds sum
to distance - m + 1 (a threshold of -1 leaves a partition out). Correlated bits are put into one partition, the
thresholds are allocated by dynamic programming on estimated candidate counts, and m is the number with the
least estimated cost. Every distinct fingerprint is posted under its own bits of a partition and, where the
threshold is above 0, under those within the threshold; postings of one signature meet in one task, which
verifies the distance and passes on a spanning forest of the links, never all pairs. Signatures with many
postings are split into blocks and pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import ascii_words, components, join_hot, table, type_of, written

BITS = 64
#: Postings of a block of a signature that has more.
BLOCK = 2048
#: Cost of a posting (shuffled and sorted) in units of a candidate pair (compared).
POSTING_COST = 60.0


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of a whole text; repeats count, a bit is set if over half of the shingles' hashes have it."""
    words = ascii_words(text)
    if not words:
        return 0
    data = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    h = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    hashes = [h(data[a:b], seed) for a, b in zip(starts[:n], ends[min(shingle, len(words)) - 1 :], strict=True)]
    count = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(np.array(hashes[at : at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp: the fingerprint's bits as a signed long) of every row."""
    schema = T.StructType([T.StructField(id_col, type_of(docs, id_col)), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], [id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bit_agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits of each pair (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS + 1), pa.int32()), pa.array([*both.ravel().tolist(), float(n)], pa.float64())], ["at", "n"])

    rows = fps.select("fp").mapInArrow(run, "at int, n double").groupBy("at").sum("n").collect()  # 4097 rows
    got = np.zeros(BITS * BITS + 1)
    for at, n in rows:
        got[at] = n
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m partitions of near-equal width that keep correlated bits together: the strongest pairs first."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    strength = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    width, own = -(-BITS // m), {b: [b] for b in range(BITS)}
    home = list(range(BITS))
    for i, j in sorted(combinations(range(BITS), 2), key=lambda x: -strength[x]):
        a, b = home[i], home[j]
        if a != b and len(own[a]) + len(own[b]) <= width:
            own[a] += own.pop(b)
            for x in own[a]:
                home[x] = a
    out: list[list[int]] = [[] for _ in range(m)]
    for bits in sorted(own.values(), key=len, reverse=True):  # what could not be joined whole is dealt bit by bit
        room = min(out, key=len)
        if len(room) + len(bits) <= width:
            room += bits
        else:
            for b in bits:
                min(out, key=len).append(b)
    return [sorted(x) for x in out]


def allocate(cost: list[list[float]], total: int) -> list[int]:
    """Thresholds t_i >= -1 of least summed cost[i][t_i + 1] that sum to ``total``, by dynamic programming."""
    m, top = len(cost), len(cost[0]) - 2
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for i in range(m):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for s, (c, ts) in best.items():
            for t in range(-1, top + 1):
                if s + t not in nxt or c + cost[i][t + 1] < nxt[s + t][0]:
                    nxt[s + t] = (c + cost[i][t + 1], [*ts, t])
        best = nxt
    return best[total][1]


def scheme(fps: DataFrame, distance: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost.

    Candidates at threshold 0 are counted: the sum of squared counts of a partition's values. A wider threshold
    multiplies them by the sum, over the bits that may differ, of the odds of each bit to differ.
    """
    n, both = bit_agreement(fps)
    p = np.diag(both) / max(n, 1)
    odds = 2 * p * (1 - p) / np.maximum(1 - 2 * p * (1 - p), 1e-9)
    choices = {m: partitions(both, n, m) for m in range(min(2, distance + 1), distance + 2)}
    keys = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), part_value(bits).alias("v")) for m, parts in choices.items() for i, bits in enumerate(parts)]
    pairs = {(r[0], r[1]): r[2] for r in fps.select(F.explode(F.array(*keys)).alias("k")).select("k.*").groupBy("m", "i", "v").count().groupBy("m", "i").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()}
    best = None
    for m, parts in choices.items():
        cost = []
        for i, bits in enumerate(parts):
            grown = [1.0]
            for b in bits:  # elementary symmetric sums
                grown = [x + (grown[k - 1] * odds[b] if k else 0) for k, x in enumerate([*grown, 0.0])][: distance + 2]
            own = [0.0]
            for t in range(distance + 1):
                balls = sum(comb(len(bits), r) for r in range(t + 1))
                own.append(n * (1 + (balls if t else 0)) * POSTING_COST + pairs.get((m, i), 0.0) * sum(grown[: t + 1]) / (2 if t == 0 else 1))
            cost.append(own)
        thresholds = allocate(cost, distance - m + 1)
        total = sum(own[t + 1] for own, t in zip(cost, thresholds, strict=True))
        if best is None or total < best[0]:
            best = (total, parts, thresholds)
    return best[1], best[2]


def part_value(bits: list[int]):
    """The given bits of fp, gathered: a masked long, which is as good a key as packed bits."""
    mask = sum(1 << b for b in bits)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def postings(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(key, near, fp): near is 0 under a fingerprint's own bits, 1 under others within the threshold."""
    out = None
    for i, (bits, t) in enumerate(zip(parts, thresholds, strict=True)):
        if t < 0:
            continue
        masks = [sum(1 << b for b in x) for r in range(1, t + 1) for x in combinations(bits, r)]
        signed = [x - (1 << 64) if x >> 63 else x for x in masks]
        value = part_value(bits)
        rows = fps.select(F.lit(i).alias("i"), value.alias("v"), F.lit(0).cast("byte").alias("near"), "fp")
        if signed:
            flips = F.array(*map(F.lit, signed)) if len(signed) <= 64 else F.from_json(F.lit(str(signed)), T.ArrayType(T.LongType()))
            rows = rows.union(fps.select(F.lit(i).alias("i"), value.alias("v"), "fp", F.explode(flips).alias("x")).select("i", F.col("v").bitwiseXOR(F.col("x")).alias("v"), F.lit(1).cast("byte").alias("near"), "fp"))
        out = rows if out is None else out.union(rows)
    return out.select(F.xxhash64("i", "v").alias("key"), "near", "fp")


def split_hot(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Signatures of over ``block`` postings as pairs of blocks: each pair has its own key, so no task gets them whole."""
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    both = rows.join(hot, "key", "left").select("key", "near", "fp", "k", own.alias("own"))
    blocks = F.when(F.col("k").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("k") - 1))
    spread = both.select("key", "near", "fp", "own", F.explode(blocks).alias("other"))
    pair = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return spread.select(F.when(F.col("other") < 0, F.col("key")).otherwise(pair).alias("key"), "near", "fp")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges a spanning forest keeps."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    keep = np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            root[x], keep[k] = y, True
    return keep


def links_of(keys: np.ndarray, near: np.ndarray, fp: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by key and near, thinned to forests now and then."""
    pending, held = [], 0
    active = np.flatnonzero(near == 0)
    d = 1
    while len(active):
        active = active[active + d < len(keys)]
        active = active[keys[active + d] == keys[active]]
        if not len(active):
            break
        close = active[np.bitwise_count(fp[active] ^ fp[active + d]) <= distance]
        if len(close):
            pending.append((fp[close], fp[close + d]))
            held += len(close)
        if held > 200_000:
            a, b = (np.concatenate(x) for x in zip(*pending, strict=True))
            keep = forest(a, b)
            pending, held = [(a[keep], b[keep])], 0
        d += 1
    if pending:
        a, b = (np.concatenate(x) for x in zip(*pending, strict=True))
        keep = forest(a, b)
        yield a[keep], b[keep]


def links(fps: DataFrame, distance: int, parts: list[list[int]], thresholds: list[int], block: int = BLOCK) -> DataFrame:
    """(a, b) fingerprints within ``distance``: in every connected set of them, links enough to connect it."""
    rows = split_hot(postings(fps, parts, thresholds), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            own = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            own = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
            # The last key may go on in the next batch.
            cut = int(np.searchsorted(own[0], own[0][-1])) if len(own[0]) else 0
            rest = [x[cut:] for x in own]
            yield from emit([x[:cut] for x in own])
        if rest is not None:
            yield from emit(rest)

    def emit(own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a, b in links_of(own[0], own[1], own[2].view(np.uint64), distance):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "near").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, distance: int, shingle: int, id_col: str, text_col: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, and (fp, n: its rows, component, component_id, chosen: whether the component's first row has it) of every fingerprint."""
    rows = written(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min(id_col).alias("low"), F.count(F.lit(1)).alias("n")), "nodes")
    fps = nodes.select("fp")
    parts, thresholds = scheme(fps, distance)
    found = components(links(fps, distance, parts, thresholds, block), "components").withColumnRenamed("node", "fp")
    # Only nodes with links are of another component than their own.
    linked = written(found.join(nodes.select("fp", "low"), "fp"), "linked")
    first = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("first")
    firsts = linked.groupBy("component").agg(first, F.count(F.lit(1)).alias("n"))
    named = join_hot(linked.select("fp", "component"), firsts, "component", "n", linked.count())
    chosen = F.when(F.col("first").isNull(), True).otherwise(F.col("first.fp") == F.col("fp"))
    low = F.when(F.col("first").isNull(), F.col("low")).otherwise(F.col("first.low"))
    return rows, written(nodes.join(named, "fp", "left").select("fp", "n", F.coalesce("component", "fp").alias("component"), low.alias("component_id"), chosen.alias("chosen")), "named")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest id reachable over links.

    Equal fingerprints are one node, so exact copies make no links. Texts without words (null, empty) have
    fingerprint zero and are linked like any other; texts of fewer words than a shingle are one shingle.
    Rows of a null id belong to the component of their fingerprint and give it no id; a component of such rows
    only has none. Repeated rows give repeated rows; an empty table gives none. Other columns are not looked at.
    """
    rows, named = classes(docs, distance, shingle, id_col, text_col, block)
    return join_hot(rows, named.select("fp", "n", "component_id"), "fp", "n", rows.count()).select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame, distance: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns kept, with one row of each component: one of the smallest id (null ids last), and of several fingerprints of that id the smallest.

    Of rows of one id and fingerprint an arbitrary one stays.
    """
    _, named = classes(docs, distance, shingle, id_col, text_col)
    kept = named.where("chosen").select(F.col("fp").alias("__fp"), F.col("component_id").alias("__low"))
    at = docs.columns.index(text_col)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield batch.append_column("__own", pa.array(fp))

    own = docs.mapInArrow(marked, T.StructType([*docs.schema.fields, T.StructField("__own", T.LongType())]))
    return own.join(kept, (F.col("__own") == F.col("__fp")) & F.col(id_col).eqNullSafe(F.col("__low")), "left_semi").dropDuplicates(["__own"]).select(*docs.columns)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
