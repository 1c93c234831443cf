"""Benchmark decontamination: test n-grams in a hash set, looked up from every window of the training text.

The windows of the benchmark are hashed into a sorted list that is broadcast, in blocks of bounded size; the
documents' words are numbered by the block's vocabulary, window hashes are made by vector operations, looked
up, and hits are verified word by word. A benchmark of more than one block is scanned for block by block and
the hits of a document are merged. A block is arrays but for its vocabulary: some 30 bytes a word, and 120 more for
each different word.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import table, type_of, written

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WIDTH = 10
#: Words of benchmark in a block: 150 MB on every worker if all are different.
BLOCK_WORDS = 1_000_000
TABLE_BITS = 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def rolled(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window."""
    n = len(ids) - width + 1
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = (h ^ ids[k : k + n]) * MIX
        h ^= h >> np.uint64(29)
    return h


class Windows:
    """The windows of a block of items: vocabulary, all words as numbers, and for each width the hashes of the different windows, sorted, with their places and items."""

    def __init__(self, items: list[tuple[object, list[bytes]]], width: int):
        self.vocab: dict[bytes, int] = {}
        vocab = self.vocab
        self.words = np.fromiter((vocab.setdefault(w, len(vocab) + 1) for _, words in items for w in words), np.uint32, sum(len(words) for _, words in items))
        self.names = [item for item, _ in items]
        sizes = np.array([len(words) for _, words in items])
        ends = np.cumsum(sizes)
        self.by_width = {}
        for size in np.unique(np.minimum(sizes, width)).tolist() if len(items) else []:
            own = np.flatnonzero(np.minimum(sizes, width) == size)
            n = sizes[own] - size + 1
            item = np.repeat(own, n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (ends - sizes)[item]
            self.by_width[size] = self.sorted_windows(at.astype(np.int64), item.astype(np.int32), size)

    def sorted_windows(self, at: np.ndarray, item: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
        """Table of the first bits of hashes; hashes and places of the different windows, ascending; the items of each, from an edge to the next one."""
        hashes = rolled(self.words.astype(np.uint64), size)[at]
        order = np.lexsort((item, hashes))
        hashes, at, item = hashes[order], at[order], item[order]
        # Windows of one hash are put by their words, so that equal ones lie side by side; different ones are very rare.
        same = np.append(False, hashes[1:] == hashes[:-1])
        new = ~same
        for k in range(size):
            word = self.words[at + k]
            new |= np.append(True, word[1:] != word[:-1])
        if (new & same).any():
            order = np.lexsort((item, *(self.words[at + k] for k in reversed(range(size))), hashes))
            hashes, at, item = hashes[order], at[order], item[order]
            new = np.append(True, hashes[1:] != hashes[:-1])
            for k in range(size):
                word = self.words[at + k]
                new |= np.append(True, word[1:] != word[:-1])
        once = new | np.append(True, item[1:] != item[:-1])  # a window that an item has twice
        first = np.flatnonzero(new)
        edges = np.append(np.cumsum(once)[first] - 1, once.sum())
        maybe = np.zeros(1 << TABLE_BITS, bool)
        maybe[hashes >> np.uint64(64 - TABLE_BITS)] = True
        return maybe, hashes[first], at[first], edges, item[once]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Positions of words hit, and the items that hit."""
        get = self.vocab.get
        ids = np.array([get(w, 0) for w in words], np.uint32)
        hit, items = np.zeros(len(ids) + 1, np.int32), set()
        for size, (maybe, hashes, places, edges, own) in self.by_width.items():
            if len(ids) < size:
                continue
            h = rolled(ids.astype(np.uint64), size)
            at = np.flatnonzero(maybe[h >> np.uint64(64 - TABLE_BITS)])
            lo, hi = (np.searchsorted(hashes, h[at], side) for side in ("left", "right"))
            while (more := lo < hi).any():  # once, but for different windows of one hash
                at, lo, hi = at[more], lo[more], hi[more]
                same = np.ones(len(at), bool)
                for k in range(size):
                    same &= ids[at + k] == self.words[places[lo] + k]
                np.add.at(hit, at[same], 1)
                np.add.at(hit, at[same] + size, -1)
                for w in np.unique(lo[same]).tolist():
                    items.update(own[edges[w] : edges[w + 1]].tolist())
                lo = lo + 1
        return np.flatnonzero(np.cumsum(hit[:-1]) > 0), {self.names[x] for x in items}


def blocks_of(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The benchmark in blocks of about ``block_words`` words; the driver holds one at a time."""
    block, n = [], 0
    for item, text in benchmark.select(id_col, text_col).toLocalIterator():
        if words := words_of(text):
            block.append((item, words))
            n += len(words)
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def scanned(docs: DataFrame, block: list, width: int, id_col: str, text_col: str) -> DataFrame:
    """(__row, doc_id, n_words, hits: positions of hit words, items: those that occur, as strings) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(Windows(block, width))
    kind = type_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hits, items = [], [], []
            for text in batch.column("__text").to_pylist():
                words = words_of(text)
                at, own = shared.value.scan(words)
                n.append(len(words))
                hits.append(at)
                items.append([str(x) for x in own])
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("__id"), pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["__row", "doc_id", "n_words", "hits", "items"])

    schema = T.StructType([T.StructField("__row", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
    return docs.select("__row", F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, hits, items) of every row of docs.

    A window is ``width`` consecutive words of an item (a shorter item is one window); hits are the positions
    of the document's words inside any occurrence. Null and wordless texts have no words and no hits; wordless
    items have no windows; an empty benchmark hits nothing. Repeated rows give repeated rows; other columns are not
    looked at.
    """
    blocks = blocks_of(benchmark, block_words, item_col, item_text)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return scanned(docs.select(id_col, text_col).withColumn("__row", F.lit(0).cast("long")), first, width, id_col, text_col).drop("__row")
    docs = written(docs.select(id_col, text_col).withColumn("__row", F.monotonically_increasing_id()), "scanned")
    parts = scanned(docs, first, width, id_col, text_col)
    merged = [written(parts.where("size(items) > 0"), "hits")]
    whole = written(parts.select("__row", "doc_id", "n_words"), "rows")
    while second is not None:
        merged.append(written(scanned(docs, second, width, id_col, text_col).where("size(items) > 0"), "hits"))
        second = next(blocks, None)
    hits = merged[0]
    for more in merged[1:]:
        hits = hits.union(more)
    hits = hits.groupBy("__row").agg(F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return whole.join(hits, "__row", "left").select("doc_id", "n_words", F.coalesce("hits", none("int")).alias("hits"), F.coalesce("items", none("string")).alias("items"))


def cut_spans(text: str, hits: set[int]) -> str:
    """The text without the hit words (counted as by words_of) and what stands between two of them; a line break takes their place."""
    data = text.encode("utf-8", "surrogatepass")
    out, at, inside = [], 0, False
    for k, m in enumerate(WORDS.finditer(data.lower())):
        if k in hits:
            if not inside:
                out += [data[at : m.start()], b"\n"]
            at, inside = m.end(), True
        else:
            inside = False
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", width: int = WIDTH, text_col: str = "text", item_text: str = "text", item_col: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns kept, without what the benchmark has.

    mode "documents" drops every document with a hit; "spans" cuts the hit words out of the text and keeps
    the document. Cutting is repeated until no window is left, as what moves together may hit anew; where the
    benchmark has several blocks, all are looked for again until none hits. Null and wordless texts stay, repeated
    rows have one fate, an empty benchmark changes nothing, and other columns may have any names.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode}")
    out, blocks, before = docs, 0, None
    while True:
        for block in blocks_of(benchmark, block_words, item_col, item_text):
            out = without(out, Windows(block, width), mode, text_col)
            blocks += 1
        if mode == "documents" or blocks < 2:
            return out
        # A later block's cut may have made a window of an earlier one: until a pass over all blocks cuts nothing.
        out = written(out, "cut")
        texts = out.agg(F.sum(F.xxhash64(text_col).cast("decimal(38,0)"))).first()[0]
        if texts == before:
            return out
        before = texts


def without(docs: DataFrame, windows: Windows, mode: str, text_col: str) -> DataFrame:
    """docs without what one block of the benchmark has."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            for k, text in enumerate(texts):
                hits, _ = shared.value.scan(words_of(text))
                keep.append(mode == "spans" or not len(hits))
                while mode == "spans" and len(hits):
                    text = cut_spans(text, set(hits.tolist()))
                    hits, _ = shared.value.scan(words_of(text))
                texts[k] = text
            if mode == "documents":
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


OP3_SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS win
  FROM items, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
docs AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
places AS (
  SELECT doc_id, size, k, array_to_string(w[k:k + size - 1], ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM docs, sizes WHERE len(w) >= size)),
hits AS (SELECT p.doc_id, p.k, p.size, x.item_id FROM places p JOIN windows x ON x.size = p.size AND x.win = p.win),
hit_words AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, unnest(generate_series(0, size - 1)) AS t(j) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)
"""
