"""Best-fit packing of token sequences by a linear grouping scheme.

The plan is made from the histogram of piece lengths alone, which has at most ``capacity`` rows whatever the
input: large lengths (over a quarter of the capacity, at first) are sorted, cut into groups of equal cardinality and
rounded up to the largest of their group; configurations of these few sizes are optimised by column generation; the actual
lengths take the places of the rounded ones; and what remains, small lengths above all, goes best-fit, longest
first, into the tightest open space. The plan is a short list of runs (length, ranks) -> (sequences, offset),
which the pieces, ranked within their length, look up in a broadcast join.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import shuffle_partitions, table, type_of, with_rank, written
from cellweave.llm.token_counts import byte_letters

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of other characters are encoded by the library whole.
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e¡-įı-ɏ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]*")
#: Pieces and words whose ids a worker remembers: some 200 bytes each.
REMEMBERED = 600_000
END = 1
#: What is large (over so many parts of the capacity) and into how many groups it is put, tried in turn until a plan has as few sequences as the tokens need.
SCHEMES = ((4, 12), (4, 24), (3, 24), (2, 24), (8, 24), (8, 96))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """A text's ids, as little-endian unsigned 32-bit integers, exactly as the library gives them.

    No token reaches over white space, so a text is cut at it and the ids of every piece are remembered.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tok, self.memo = Tokenizer.from_str(spec), {}
        self.tok.no_truncation()
        self.tok.no_padding()
        self.find, self.letters = regex.compile(PATTERN).findall, {b: c for b, c in byte_letters().items() if chr(b) != c}
        self.special = [t["content"] for t in json.loads(spec)["added_tokens"]]

    def word(self, word: str) -> bytes:
        """The ids of a lower-case pre-token."""
        letters = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        out = array("I", [t.id for t in self.tok.model.tokenize(letters)]).tobytes()
        return self.keep(word, out)

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= 64:
            if len(self.memo) >= REMEMBERED:
                self.memo.clear()
            self.memo[text] = ids
        return ids

    def piece(self, piece: str) -> bytes | None:
        """The ids of a text without white space; None where only the library knows them."""
        if piece.isascii() and piece.isalpha():
            lower = piece.lower()
            return self.word(lower) if lower == piece else self.keep(piece, self.memo.get(lower) or self.word(lower))
        if not PLAIN.fullmatch(piece):
            return None
        words, get = self.find(piece.lower()), self.memo.get
        if len(words) == 1 and words[0] == piece:
            return self.word(piece)
        return self.keep(piece, b"".join([get(w) or self.word(w) for w in words]))

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.special):
            return self.whole(text)
        pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        out = list(map(self.memo.get, pieces))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None and (ids := self.piece(pieces[k])) is None:
                    return self.whole(text)
                out[k] = ids
        return b"".join(out)


_encoders: dict[str, WordEncoder] = {}


def encoder_of(spec: str) -> WordEncoder:
    """One encoder for a worker, so that what it remembers outlives a task."""
    if spec not in _encoders:
        _encoders.clear()
        _encoders[spec] = WordEncoder(spec)
    return _encoders[spec]


def encoded_pieces(docs: DataFrame, capacity: int, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, piece, start, length, ids_crc32) for each piece; only longer documents are cut."""
    with open(path or default_path(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = type_of(docs, id_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, step = encoder_of(shared.value), np.uint32(END).tobytes(), 4 * capacity
        for batch in batches:
            rows, out = [], ([], [], [], [])
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = encoder.encode(text or "") + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append(i)
                    for column, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 300) -> list[tuple[tuple[int, ...], float]]:
    """Patterns (how many of each size) and how often to use each: a linear programme solved by column generation.

    Any basis on the way covers the demand, so stopping after ``rounds`` costs sequences, never results.
    """
    g = len(sizes)
    size = np.array(sizes)
    patterns = np.diag(capacity // size).astype(float)  # a column is a pattern
    inverse = np.diag(1.0 / np.diag(patterns))
    use = inverse @ np.array(demand, float)
    for _ in range(rounds):
        worth = inverse.T @ np.ones(g)
        # The most that patterns of one more item each time are worth in every capacity, for all capacities at once.
        best, taken = np.zeros(capacity + 1), []
        for _ in range(capacity // int(size.min())):
            gain, took = best.copy(), np.full(capacity + 1, -1)
            for k in range(g):
                own = best[: capacity + 1 - size[k]] + worth[k]
                more = own > gain[size[k] :] + 1e-12
                gain[size[k] :][more], took[size[k] :][more] = own[more], k
            if (took < 0).all():
                break
            taken.append(took)
            best = gain
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(g), capacity
        for took in reversed(taken):
            if took[c] >= 0:
                new[took[c]] += 1
                c -= size[took[c]]
        direction = inverse @ new
        able = direction > 1e-9
        if not able.any():
            break
        ratio = np.where(able, use / np.where(able, direction, 1), np.inf)
        out = int(ratio.argmin())
        use = use - ratio[out] * direction
        use[out] = ratio[out]
        patterns[:, out] = new
        row = inverse[out] / direction[out]
        inverse = inverse - np.outer(direction, row)
        inverse[out] = row
    return [(tuple(int(round(x)) for x in patterns[:, k]), float(use[k])) for k in range(g) if use[k] > 1e-9]


def plan(histogram: dict[int, int], capacity: int, groups: int = 12, large: int | None = None) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, ranks, first sequence, ranks per sequence, offset) and the number of sequences.

    The pieces of a length with ranks from first rank on fill consecutive sequences, so many per sequence,
    side by side from the offset.
    """
    large = capacity // 4 if large is None else large
    runs: list[tuple[int, int, int, int, int, int]] = []
    n_seq = 0
    next_rank = dict.fromkeys(histogram, 0)
    left = {k: v for k, v in histogram.items() if v > 0}
    spaces: dict[int, list[tuple[int, int]]] = {}  # space left -> [(first sequence, sequences)]

    big = [(k, left[k]) for k in sorted(left, reverse=True) if k > large]
    total = sum(n for _, n in big)
    if total:
        g = min(groups, total)
        # Equal cardinality: group j has the items from total*j//g on, longest first.
        grouped: list[list[list[int]]] = []  # of group: [length, count]
        source, at = [list(x) for x in big], 0
        for j in range(g):
            need, own = total * (j + 1) // g - total * j // g, []
            while need:
                take = min(need, source[at][1])
                own.append([source[at][0], take])
                source[at][1] -= take
                need -= take
                at += source[at][1] == 0
            grouped.append(own)
        merged: list[list[list[int]]] = []  # groups of one rounded size are one
        for own in grouped:
            if merged and merged[-1][0][0] == own[0][0]:
                merged[-1] += own
            else:
                merged.append(own)
        sizes, demand = [own[0][0] for own in merged], [sum(n for _, n in own) for own in merged]
        for pattern, use in sorted(configurations(sizes, demand, capacity), reverse=True):
            bins = min([int(use + 1e-6), *(demand[j] // a for j, a in enumerate(pattern) if a)])
            if bins <= 0:
                continue
            slots: list[list[tuple[int, int]]] = []  # of each place of the pattern: (length, count) over its sequences
            for j, a in enumerate(pattern):
                demand[j] -= a * bins
                for _ in range(a):
                    need, got = bins, []
                    while need:
                        head = merged[j][0]
                        take = min(need, head[1])
                        got.append((head[0], take))
                        head[1] -= take
                        need -= take
                        if not head[1]:
                            merged[j].pop(0)
                    slots.append(got)
            cuts = sorted({0, *(int(x) for got in slots for x in np.cumsum([n for _, n in got]))})
            where, heads = [0] * len(slots), [list(got[0]) for got in slots]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                used = 0
                for s, head in enumerate(heads):
                    runs.append((head[0], next_rank[head[0]], hi - lo, n_seq, 1, used))
                    next_rank[head[0]] += hi - lo
                    left[head[0]] -= hi - lo
                    used += head[0]
                    head[1] -= hi - lo
                    if not head[1] and where[s] + 1 < len(slots[s]):
                        where[s] += 1
                        heads[s] = list(slots[s][where[s]])
                if used < capacity:
                    spaces.setdefault(capacity - used, []).append((n_seq, hi - lo))
                n_seq += hi - lo

    keys = sorted(spaces)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            k = bisect.bisect_left(keys, length)
            if k == len(keys):  # no space: new sequences
                fresh = -(-n // (capacity // length))
                bisect.insort(keys, capacity)
                spaces[capacity] = [(n_seq, fresh)]
                n_seq += fresh
                continue
            space = keys[k]
            first, bins = spaces[space].pop()
            if not spaces[space]:
                del spaces[space]
                keys.pop(k)
            per = space // length
            whole = min(bins, n // per)
            parts = [(first, whole, per)] if whole else []
            n -= whole * per
            if whole < bins and n:
                parts.append((first + whole, 1, n))
                n = 0
            done = sum(x[1] for x in parts)
            for start, count, each in parts:
                runs.append((length, next_rank[length], count * each, start, each, capacity - space))
                next_rank[length] += count * each
                if rest := space - each * length:
                    if rest not in spaces:
                        bisect.insort(keys, rest)
                    spaces.setdefault(rest, []).append((start, count))
            if done < bins:
                if space not in spaces:
                    bisect.insort(keys, space)
                spaces.setdefault(space, []).append((first + done, bins - done))
    return runs, n_seq


def best_plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The plan of the fewest sequences of all grouping schemes, or the first that has no more than the tokens need."""
    least, best = -(-sum(k * n for k, n in histogram.items()) // capacity), None
    for share, groups in SCHEMES:
        got = plan(histogram, capacity, groups, capacity // share)
        best = got if best is None or got[1] < best[1] else best
        if best[1] <= least:
            break
    return best


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    Ranks within a length are made over hashed chunks, so a length that a third of all rows share stays
    spread out. Repeated rows, and rows of a null id, are packed each for itself; ties are put in order of doc_id,
    nulls first. Only these columns are looked at and given, so no name can clash. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    pieces = written(pieces, "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, _ = best_plan(histogram, capacity)
    names = ["length", "__first", "__n", "__seq", "__per", "__at"]
    schema = T.StructType([T.StructField(x, T.LongType()) for x in names])
    lookup = spark.createDataFrame(pd.DataFrame(runs, columns=names, dtype="int64"), schema) if runs else spark.createDataFrame([], schema)
    if len(runs) <= 1_000_000:  # 48 bytes each; beyond it the planner chooses
        lookup = F.broadcast(lookup)
    ranked = with_rank(pieces, F.col("length"), [F.col("doc_id"), F.col("piece")], F.struct("doc_id", "piece"), "__rank", shuffle_partitions(spark))
    at = F.col("__rank") - F.col("__first")
    joined = ranked.join(lookup, "length").where((at >= 0) & (at < F.col("__n")))
    each = at - F.floor(at / F.col("__per")) * F.col("__per")
    return joined.select(*pieces.columns, (F.col("__seq") + F.floor(at / F.col("__per"))).cast("long").alias("sequence_id"), (F.col("__at") + each * F.col("length")).cast("long").alias("offset"))


def best_fit_packing(docs: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """Packs the whole text of every document (null: empty) into sequences of at most ``capacity`` tokens.

    Every document ends with id 1, so an empty one is a piece of one token. An empty table gives no rows. A null id
    stays null, repeated rows are repeated pieces, and columns besides doc_id and text are not looked at.
    """
    return pack(encoded_pieces(docs, capacity, path), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
