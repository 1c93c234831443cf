"""Language-model scoring by deleted interpolation.

n-gram maximum-likelihood estimates of all orders, down to the uniform one, are mixed with weights that depend
on the longest context seen and on how often it was seen. The weights are learned by expectation-maximisation
on the counts of a deleted part of the training documents, with the estimates of the rest; then the counts of
all training documents are used.

Counting by request and answer: a task numbers the words of a batch of documents and asks, for the distinct
n-grams of the batch, for the counts of the whole corpus. Requests meet by a hash of the n-gram, one row for each
batch and share of the hash space, so no word or phrase, however common, is more than one entry of a batch; there are
as many shares as the corpus is large. The answers, a table in the shared folder, go back to the batches, which score
their documents. The batches are made anew from the texts, which is less than storing them; an answer tells if its
batch has changed. Deleted documents have batches of their own, so that learning the weights looks at these only.

n-grams are 56-bit hashes: a collision among a billion of them would give one a wrong count in 70 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from cellweave.llm.common import ascii_words, shuffle_partitions, table, trim, type_of, varpack, varunpack, written

ORDER = 3
#: Tokens of a batch: what a task holds at a time.
BATCH_TOKENS = 600_000
#: Bytes of text whose requests are a share of the hash space: what a task that answers holds at a time.
SHARE_BYTES = 4 << 20
#: Tasks that answer; beyond so many shares a task answers several, one after another, as every asking task has a block for each.
MOST_TASKS = 20_000
#: Requests that are handed on at once.
ASKED = 1000
FOLDS, HELD_OUT, DELETED = 10, 0, 1
#: Cells a unit of the logarithm of a ratio of probabilities (tokens of a cell go by their mean ratios); bounds of the exponent; buckets of an order.
FINE, WIDEST, BUCKETS = 16, 480, 24
#: Words can't have white space, so these are no words.
END_WORD, START_WORD = b" ", b"  "
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


def joined_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (context * MIX) ^ (word + (context >> np.uint64(29)))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def entry(keys: np.ndarray, unigram: bool) -> np.ndarray:
    """The 56-bit key under which an n-gram is counted; the last bit tells unigrams, whose number is wanted."""
    return (keys >> np.uint64(9) << np.uint64(1)) | np.uint64(unigram)


class Batch:
    """Documents as word numbers: derives every token's n-grams and their places in the sorted distinct keys."""

    def __init__(self, keys: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, order: int):
        """keys: of the distinct words; tokens: word numbers, each document's last one the end; sizes: tokens of each document."""
        first = np.zeros(len(tokens), bool)
        first[np.cumsum(sizes) - sizes] = True
        # Before a document there are as many starts as a context is long.
        starts = [word_keys([START_WORD])]
        grams, words = [keys[tokens]], keys[tokens]
        for _ in range(1, order):
            context = np.empty_like(words)
            context[1:] = grams[-1][:-1]
            context[first] = starts[-1][0]
            grams.append(joined_keys(context, words))
            starts.append(joined_keys(starts[-1], starts[0]))
        own = [entry(keys, True), *(entry(s, False) for s in starts[: order - 1]), *(entry(g, False) for g in grams[1:])]
        self.keys, at = np.unique(np.concatenate(own), return_inverse=True)
        at = np.split(at.astype(np.int32), np.cumsum([len(x) for x in own])[:-1])
        self.starts, self.grams = at[1:order], [at[0][tokens], *at[order:]]
        self.contexts = []
        for g, start in zip(self.grams, self.starts, strict=False):  # the context of order k + 1 is the n-gram of order k that ends before
            c = np.empty_like(g)
            c[1:] = g[:-1]
            c[first] = start
            self.contexts.append(c)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)

    def counts(self, docs: np.ndarray) -> np.ndarray:
        """Counts of every key in the given documents (a mask); a document counts one start of each length."""
        use = docs[self.doc]
        out = np.zeros(len(self.keys), np.int64)
        for start in self.starts:
            out[start] += docs.sum()
        for g in self.grams:
            out += np.bincount(g[use], minlength=len(self.keys))
        return out


def share_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of the equal parts of the hash space a key is in; grows with the key."""
    return ((keys >> np.uint64(24)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pack_sorted(keys: np.ndarray) -> bytes:
    """The first of ascending keys, and the differences of the others in as few bytes as the largest needs."""
    d = np.diff(keys)
    width = max(1, -(-int(d.max()).bit_length() // 8)) if len(d) else 1
    return bytes([width]) + keys[:1].astype("<u8").tobytes() + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width, raw = data[0], np.frombuffer(data, np.uint8, offset=9)
    full = np.zeros((1 + len(raw) // width, 8), np.uint8)
    full[0] = np.frombuffer(data, np.uint8, 8, 1)
    full[1:, :width] = raw.reshape(-1, width)
    return np.cumsum(full.view("<u8").ravel(), dtype=np.uint64)


def squeezed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueezed(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """32-bit numbers by byte place, which compresses better."""
    return squeezed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unplanes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(unsqueezed(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


class Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def encoded(docs: DataFrame, order: int, parts: int, batch_tokens: int, asks: bool, deleted_only: bool = False) -> DataFrame:
    """Rows of the batches: their distinct n-grams by share of the hash space, with their counts in training documents (asks); or their documents.

    Batches of deleted documents have odd numbers.
    """
    kind = type_of(docs, "doc_id")
    if asks:
        schema = T.StructType([T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType()), *(T.StructField(x, T.BinaryType()) for x in ("keys", "train"))])
    else:
        schema = T.StructType([T.StructField("batch", T.LongType()), *(T.StructField(x, T.BinaryType()) for x in ("keys", "tokens")), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("sizes", "folds"))])
    arrow = to_arrow_schema(schema)

    class Held:
        """Documents of the batch that is being gathered."""

        def __init__(self, number: int):
            self.number = number
            self.begin()

        def begin(self) -> None:
            self.ids, self.folds, self.pieces, self.numbers, self.n = [], [], [], Numbers(), 0
            self.end = self.numbers[END_WORD]

        def add(self, key: object, words: list[bytes], fold: int) -> None:
            piece = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
            self.pieces.append(np.append(piece, np.int32(self.end)))
            self.ids.append(key)
            self.folds.append(fold)
            self.n += len(words) + 1

        def rows(self) -> Iterator[pa.RecordBatch]:
            if not self.pieces:
                return
            sizes, tokens, keys = np.array([len(p) for p in self.pieces]), np.concatenate(self.pieces), word_keys(list(self.numbers))
            if asks:
                batch = Batch(keys, tokens, sizes, order)
                train = batch.counts(np.array(self.folds) != HELD_OUT)
                share = share_of(batch.keys, parts)
                edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
                for k in range(0, len(edges) - 1, ASKED):
                    own = [slice(*x) for x in pairwise(edges[k : k + ASKED + 1])]
                    made = [{"batch": self.number, "part": int(share[x.start]), "keys": pack_sorted(batch.keys[x]), "train": squeezed(varpack(train[x]))} for x in own]
                    yield pa.RecordBatch.from_pylist(made, schema=arrow)
            else:
                yield pa.RecordBatch.from_pylist([{"batch": self.number, "keys": keys.tobytes(), "tokens": planes(tokens), "ids": self.ids, "sizes": sizes.tolist(), "folds": self.folds}], schema=arrow)
            self.number += 2
            self.begin()
            trim()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        rest, deleted = Held(task), Held(task + 1)
        for batch in batches:
            for key, text, fold in zip(*(batch.column(k) for k in range(3)), strict=True):
                fold = fold.as_py()
                if deleted_only and fold != DELETED:
                    continue
                held = deleted if fold == DELETED else rest
                held.add(key.as_py(), ascii_words(text.as_py()), fold)
                if held.n >= batch_tokens:
                    yield from held.rows()
        for held in (rest, deleted):
            yield from held.rows()

    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)).cast("int")
    # All rows go through, so that partitions are the same; texts that are not looked at stay behind.
    text = F.when(F.col("fold") == DELETED, F.col("text")) if deleted_only else F.col("text")
    return docs.select("doc_id", "text", fold.alias("fold")).select("doc_id", text.alias("text"), "fold").mapInArrow(run, schema)


ANSWER = T.StructType([T.StructField("batch", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType()), T.StructField("deleted", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("sign", "unigrams", "train_tokens", "deleted_tokens"))])


def signature(keys: np.ndarray) -> int:
    return int(keys.sum(dtype=np.uint64).view(np.int64))


def answered(asks: DataFrame, parts: int, most_tasks: int = MOST_TASKS) -> DataFrame:
    """The corpus counts of every batch's n-grams, in the order of its request, and a sum of the keys as its sign; for deleted batches also those of deleted documents.

    A share is a group of its own, whatever the number of tasks. One row of a share has its number of distinct training tokens, and their occurrences.
    """
    arrow = to_arrow_schema(ANSWER)

    def meet(group: pa.Table) -> pa.Table:
        rows = group.sort_by("batch").to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total, deleted = (np.zeros(len(distinct), np.int64) for _ in range(2))
        edges = np.cumsum([0, *map(len, keys)])
        for r, lo, hi in zip(rows, edges, edges[1:], strict=False):  # the keys of a request are distinct
            train = varunpack(unsqueezed(r["train"]))
            total[at[lo:hi]] += train
            if r["batch"] & 1:
                deleted[at[lo:hi]] += train
        unigram = (distinct & np.uint64(1)).astype(bool)
        whole = [int((unigram & (total > 0)).sum()), int(total[unigram].sum()), int(deleted[unigram].sum())]
        out = []
        for k, (r, lo, hi) in enumerate(zip(rows, edges, edges[1:], strict=False)):
            own = dict(zip(("unigrams", "train_tokens", "deleted_tokens"), [0, 0, 0] if k else whole, strict=True))
            gone = squeezed(varpack(deleted[at[lo:hi]])) if r["batch"] & 1 else None
            out.append({"batch": r["batch"], "part": r["part"], "counts": squeezed(varpack(total[at[lo:hi]])), "deleted": gone, "sign": signature(keys[k])} | own)
        return pa.Table.from_pylist(out, arrow)

    return asks.repartition(min(parts, most_tasks), "part").groupBy("part").applyInArrow(meet, ANSWER)


def reassembled(text: pa.Table, answers: pa.Table, order: int) -> tuple[dict, Batch, np.ndarray, np.ndarray | None]:
    """A batch as it was asked for, with the counts of its keys."""
    row = text.to_pylist()[0]
    batch = Batch(np.frombuffer(row["keys"], np.uint64), unplanes(row["tokens"]), np.array(row["sizes"]), order)
    parts = sorted(answers.to_pylist(), key=lambda r: r["part"])
    whole = lambda x: np.concatenate([varunpack(unsqueezed(p[x])) for p in parts])
    counts = whole("counts")
    if len(counts) != len(batch.keys) or signature(batch.keys) != int(np.array([p["sign"] for p in parts]).view(np.uint64).sum(dtype=np.uint64).view(np.int64)):
        raise RuntimeError("a batch has changed since its counts were asked for: write the documents to a table first")
    return row, batch, counts, whole("deleted") if row["batch"] & 1 else None


def ratios(batch: Batch, counts: np.ndarray, tokens: np.ndarray, total: int, distinct: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token: the estimates of every order over the uniform one (tokens x orders), and the bucket of its context."""
    out = np.zeros((len(tokens), len(batch.grams)))
    if total > 0:
        out[:, 0] = counts[batch.grams[0][tokens]] * ((distinct + 1) / total)
    bucket = np.zeros(len(tokens), np.int64)
    for k, context in enumerate(batch.contexts, 1):
        seen = counts[context[tokens]]
        np.divide(counts[batch.grams[k][tokens]] * float(distinct + 1), seen, out=out[:, k], where=seen > 0)
        level = np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), BUCKETS - 1)
        bucket = np.where(seen > 0, k * BUCKETS + level, bucket)
    return out, bucket


def cells(batch: Batch, counts: np.ndarray, total: int, distinct: int) -> pa.Table:
    """The tokens of a batch as (bucket, cell, n: tokens, s0, s1, ..: summed ratio of each order); a cell is the rounded logarithm of every ratio."""
    ratio, bucket = ratios(batch, counts, np.arange(len(batch.doc)), total, distinct)
    with np.errstate(divide="ignore"):
        place = np.where(ratio > 0, np.clip(np.round(np.log(ratio) * FINE), -WIDEST, WIDEST) + WIDEST + 1, 0).astype(np.int64)
    code = bucket.copy()
    for k in range(place.shape[1]):
        code = code * (2 * WIDEST + 2) + place[:, k]
    distinct_cells, first, at = np.unique(code, return_index=True, return_inverse=True)
    sums = {f"s{k}": np.bincount(at, ratio[:, k]) for k in range(ratio.shape[1])}
    return pa.table({"bucket": bucket[first].astype(np.int32), "cell": distinct_cells, "n": np.bincount(at).astype(np.int64)} | sums)


def mixed(n: np.ndarray, sums: np.ndarray, top: int, rounds: int = 500) -> np.ndarray:
    """Weights of the uniform estimate and the first ``top`` orders by expectation-maximisation on cells (n tokens, summed ratios)."""
    ratio = np.column_stack([np.ones(len(n)), sums[:, :top] / n[:, None]])
    w = np.full(top + 1, 1 / (top + 1))
    for _ in range(rounds):
        new = w * (ratio * (n / (ratio @ w))[:, None]).sum(0) / n.sum()
        done, w = np.abs(new - w).max() < 1e-9, new
        if done:
            break
    return w


def learned(found: DataFrame, order: int) -> DataFrame:
    """(bucket, weights) of cells (bucket, cell, n, s0, ..): a task holds a bucket's cells, of which there are so many at most as they are fine."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group["bucket"][0].as_py()
        group = group.sort_by("cell")  # the same sums whatever the order of arrival
        w = mixed(group["n"].to_numpy().astype(float), np.column_stack([group[f"s{k}"].to_numpy() for k in range(order)]), bucket // BUCKETS + 1)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "weights": pa.array([w.tolist()], pa.list_(pa.float64()))})

    return found.groupBy("bucket").applyInArrow(run, "bucket int, weights array<double>")


def completed(found: dict[int, list[float]], order: int) -> np.ndarray:
    """Weights (buckets x uniform and orders) of all buckets from those that have any.

    A bucket without held-out tokens takes those of the next one below; orders whose context is unseen get none.
    The uniform estimate keeps a trace, so nothing has probability 0.
    """
    weights = np.zeros((order * BUCKETS, order + 1))
    for b in range(len(weights)):
        top = b // BUCKETS + 1
        if b in found:
            weights[b, : top + 1] = found[b]
        elif b % BUCKETS and weights[b - 1].any():
            weights[b] = weights[b - 1]
        else:
            weights[b, : top + 1] = 1 / (top + 1)
        weights[b] = np.maximum(weights[b], [1e-6, *[0.0] * order])
        weights[b] /= weights[b].sum()
    return weights


def deleted_interpolation(docs: DataFrame, order: int = ORDER, batch_tokens: int = BATCH_TOKENS, id_col: str = "doc_id", text_col: str = "text", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Words are cut at ASCII white space after lower-casing A-Z; every document ends with an end token, so null
    and empty texts have one token. Documents whose crc32(id) mod 10 is 0 are held out; those with 1 are the
    deleted part of training. A null id hashes as an empty text. Repeated rows count and are scored each. Scores
    are log10 probabilities: base by unigram counts with 0.1 added, score by the mixture. Without training
    documents every token has the uniform probability. An empty table gives no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = type_of(docs, "doc_id")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-size // share_bytes))
    made = lambda asks, deleted_only=False: encoded(docs, order, parts, batch_tokens, asks, deleted_only)
    answers = written(answered(made(True), parts), "answers")
    total, deleted, distinct = answers.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("train_tokens", "deleted_tokens", "unigrams"))).first()

    def pairs(function: Callable, out: str | T.StructType, deleted_only: bool) -> DataFrame:
        own = answers.select("batch", "part", "counts", "deleted", "sign")
        own = own.where(F.col("deleted").isNotNull()) if deleted_only else own
        return made(False, deleted_only).groupBy("batch").cogroup(own.groupBy("batch")).applyInArrow(function, out)

    def held(text: pa.Table, own: pa.Table) -> pa.Table:
        _, batch, counts, gone = reassembled(text, own, order)
        return cells(batch, counts - gone, total - deleted, distinct)

    names = [f"s{k}" for k in range(order)]
    found = pairs(held, ", ".join(["bucket int, cell long, n long", *(f"{x} double" for x in names)]), True)
    found = found.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names))
    weights = completed({r["bucket"]: r["weights"] for r in learned(found, order).collect()}, order)  # a row a bucket

    def score(text: pa.Table, own: pa.Table) -> pa.Table:
        row, batch, counts, _ = reassembled(text, own, order)
        n_docs = len(row["sizes"])
        known, base, total_score = np.zeros(n_docs, np.int64), np.zeros(n_docs), np.zeros(n_docs)
        for at in range(0, len(batch.doc), 500_000):
            tokens = np.arange(at, min(at + 500_000, len(batch.doc)))
            doc, count = batch.doc[tokens], counts[batch.grams[0][tokens]]
            ratio, bucket = ratios(batch, counts, tokens, total, distinct)
            p = weights[bucket, 0] + (weights[bucket, 1:] * ratio).sum(1)
            known += np.bincount(doc, count > 0, n_docs).astype(np.int64)
            base += np.bincount(doc, np.log10((count + 0.1) / (total + 0.1 * (distinct + 1))), n_docs)
            total_score += np.bincount(doc, np.log10(p / (distinct + 1)), n_docs)
        fold = np.array(row["folds"])
        trim()
        return pa.table([pa.array(row["ids"], id_type), pa.array(fold == HELD_OUT), pa.array(row["sizes"], pa.int64()), pa.array(known), pa.array(np.full(n_docs, total)), pa.array(base), pa.array(total_score)], names=list(columns))

    id_type = to_arrow_type(kind)
    columns = {"doc_id": kind, "held_out": T.BooleanType(), "n_tokens": T.LongType(), "n_known": T.LongType(), "train_tokens": T.LongType(), "base_score": T.DoubleType(), "score": T.DoubleType()}
    return pairs(score, T.StructType([T.StructField(k, v) for k, v in columns.items()]), False)


def op1_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation(table(spark, sf_dir, "documents"))
