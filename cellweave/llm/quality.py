"""Quality classifier by co-training of a text view and a metadata view.

Each view is a logistic regression on binary features: words, their beginnings, trailing signs and shapes of the text; language,
source and length of the page. All features are used whose label counts lie far from chance. They are numbered, and
the numbers of every document's features are written once. Over rounds each view scores all unlabelled documents, and
the surest of them, by its calibrated probability, are labelled for the other view to learn from: a share of what is
labelled. At last the views, calibrated on labelled rows that were kept out, are combined by a logistic regression on
these rows, and score every document.

The fit is on a bounded sample of labelled documents, MAX_LABELLED, taken by the hash of their ids.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import table, type_of, written

MAX_LABELLED = 20_000
#: Rounds, the least probability of a pseudo-label, and how many a round gives a view, as a share of the labelled ones of the class.
ROUNDS, SURE, GROWTH = 3, 0.98, 0.25
#: Least deviation of a feature's label counts, in standard errors, and least documents that have it.
DEVIATION, SEEN = 4.0, 4
KEEP = 0.5
#: Characters of the beginnings of words that are features beside the word: they stand for words that the labels have too few of.
PREFIXES = (4, 5, 6, 7)
#: Bytes up to which a word or a run of signs is a feature as it is; a longer one is by its hash.
SPELT = 6
#: Characters of the windows over text without white space: of scripts that have none, and of other runs of over RUN characters.
WINDOWS, RUN_WINDOWS, RUN = (2, 3, 4), (4, 6), 40
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
NOT_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())


def text_features(text: str | None) -> set[bytes]:
    """Words without the signs around them, their beginnings, windows over runs without white space, the signs that trail words, and shapes; every feature once, whatever the length."""
    data = (text or "").encode("utf-8", "surrogatepass")
    lower = data.lower()
    words = lower.split()
    distinct = set(words)
    out, starts = set(), Counter()
    for w in distinct:
        core = w.rstrip(SIGNS)
        if len(core) != len(w):
            signs = w[len(core) :]
            out.add(b"s:" + signs if len(signs) <= SPELT else b"t:" + xxhash.xxh64_digest(signs))
        core = core.lstrip(SIGNS)
        if core:
            out.add(b"w:" + core if len(core) <= SPELT else b"h:" + xxhash.xxh64_digest(core))
            if core.isascii() and len(core) <= RUN:
                starts.update([core[:k] for k in PREFIXES if len(core) > k])
            else:
                run = core.decode("utf-8", "surrogatepass")
                starts.update([run[:k].encode("utf-8", "surrogatepass") for k in PREFIXES if len(run) > k])
                sizes = WINDOWS if UNSPACED.search(run) else RUN_WINDOWS if len(run) > RUN else ()
                for size in sizes:
                    out.update([b"c:" + x.encode("utf-8", "surrogatepass") for x in {run[k : k + size] for k in range(len(run) - size + 1)}])
    # A beginning is a feature of its own where 1, 2 or 4 different words have it, as chance gives long texts some.
    for start, k in starts.items():
        out.add(b"p:" + start)
        if k >= 2:
            out.add(b"q:" + start)
        if k >= 4:
            out.add(b"r:" + start)
    n = len(words)
    size = min(n.bit_length(), 12)
    out.add(b"n:%d" % size)
    letters = len(data.translate(None, NOT_LETTER))
    if letters:
        out.add(b"upper:%d" % (10 * len(data.translate(None, NOT_UPPER)) // letters))
    if n >= 8:
        out.add(b"distinct:%d:%d" % (size, 10 * len(distinct) // n))
        twice = sum(map(bytes.__eq__, words, words[1:]))
        out.add(b"twice:%d" % (10 * twice // n))
        lines = [x for x in lower.split(b"\n") if x]
        if len(lines) >= 4:
            out.add(b"lines:%d" % (10 * len(set(lines)) // len(lines)))
    return out


def meta_features(row: dict) -> set[bytes]:
    """A feature for each value of lang and source, and the order of magnitude of n_chars; a null is a value."""
    out = {f"{k}={row[k]}".encode("utf-8", "surrogatepass") for k in ("lang", "source") if k in row}
    if "n_chars" in row:
        n = row["n_chars"]
        out.add(b"n_chars=none" if n is None else b"n_chars=%d" % max(0, int(n)).bit_length())
    return out


def fit_logistic(rows: np.ndarray, cols: np.ndarray, d: int, y: np.ndarray, steps: int = 250, rate: float = 0.15, ridge: float = 5e-5) -> np.ndarray:
    """Weights (d) and bias of a logistic regression on binary rows, given as places of their ones, by full-batch adaptive steps."""
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    n = len(y)
    for t in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + w[d]
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / max(n, 1)
        grad = np.append(np.bincount(cols, g[rows], d), g.sum())
        grad[:d] += ridge * w[:d]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def fit_dense(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, nonnegative: bool = True) -> np.ndarray:
    """Weights and bias of a small dense logistic regression by Newton steps; a negative weight is set to 0."""
    x = np.column_stack([x, np.ones(len(x))])
    active = np.ones(x.shape[1], bool)
    for _ in range(x.shape[1]):
        w = np.zeros(x.shape[1])
        a = x[:, active]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w[active], -40, 40)))
            penalty = ridge * np.append(np.ones(active.sum() - 1), 0.01)
            h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
            w[active] -= np.linalg.solve(h, a.T @ (p - y) + penalty * w[active])
            w = np.clip(w, -30, 30)
        bad = np.append(w[:-1] < 0, False)
        if not (nonnegative and bad.any()):
            return w
        active &= ~bad
    return w


@dataclass
class View:
    """Numbers of the features of a view, their weights and bias (last), and the calibration (slope, bias)."""

    numbers: dict[bytes, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scale: tuple[float, float] = (1.0, 0.0)

    @property
    def kind(self) -> np.dtype:
        return np.dtype("<u2" if len(self.numbers) < 1 << 16 else "<u4")

    def coded(self, features: set[bytes]) -> bytes:
        """The numbers of the features that the view knows, in order."""
        own = self.numbers
        return np.array(sorted(own[f] for f in features & own.keys()), self.kind).tobytes()

    def raw(self, column: list[bytes]) -> np.ndarray:
        """The logits of coded rows."""
        rows, cols = places(column, self.kind)
        return np.bincount(rows, self.weights[cols], len(column)) + self.weights[-1]

    def logits(self, column: list[bytes]) -> np.ndarray:
        return self.scale[0] * self.raw(column) + self.scale[1]


def places(column: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of all features of coded rows."""
    return np.repeat(np.arange(len(column), dtype=np.int32), [len(x) // kind.itemsize for x in column]), np.frombuffer(b"".join(column), kind).astype(np.int32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    """Both views and the weights of their combination."""

    text: View = field(default_factory=lambda: View({}))
    meta: View = field(default_factory=lambda: View({}))
    mix: tuple[float, float, float] = (0.0, 0.0, 0.0)
    prior: float | None = 1.0  # given for all documents where labels don't allow a fit

    def scores(self, text: list[bytes], meta: list[bytes]) -> np.ndarray:
        """Calibrated probabilities of good quality of coded rows: by text, by metadata, combined."""
        if self.prior is not None:
            return np.full((len(text), 3), self.prior)
        a, b = self.text.logits(text), self.meta.logits(meta)
        return np.column_stack([sigmoid(a), sigmoid(b), sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])])


def labelled_ids(labels: DataFrame, bound: int) -> DataFrame:
    """(doc_id, y): 1 if of quality and not toxic (null: not), of a bounded number of documents; contradicting rows count as bad."""
    y = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min(y.cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def views_of(names: list[str], batch: pa.RecordBatch) -> Iterator[tuple[set[bytes], set[bytes]]]:
    """The text and the metadata features of each row; ``names`` are the metadata columns."""
    meta = batch.select(names).to_pylist() if names else [{}] * len(batch)
    return zip(map(text_features, batch.column("text").to_pylist()), map(meta_features, meta), strict=True)


def hashes(features: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, features), np.uint64, len(features)).view(np.int64)


def choose(learn: DataFrame, names: list[str], n: int, p: float) -> tuple[View, View]:
    """The features of both views whose label counts lie far from chance, numbered from the farthest.

    Features are counted by their hashes, in every task before the shuffle; only the chosen ones are spelt out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 500) for b in batches for k in range(0, len(b), 500)):
            ys = batch.column("y").to_pylist()
            rows = list(views_of(names, batch))
            for v in (0, 1):
                found = hashes([f for r in rows for f in r[v]])
                good = np.repeat(ys, [len(r[v]) for r in rows])
                distinct, at = np.unique(found, return_inverse=True)
                k, g = np.bincount(at, minlength=len(distinct)), np.bincount(at, good, len(distinct)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(distinct), v, np.int8)), *map(pa.array, (distinct, k, g))], ["view", "h", "k", "g"])

    k = F.col("k")
    found = learn.mapInArrow(counted, "view byte, h long, k long, g long").groupBy("view", "h").agg(F.sum("k").alias("k"), F.sum("g").alias("g"))
    off = F.abs(F.col("g") - k * p) / F.sqrt(k * p * (1 - p) * (1 - k / F.lit(float(n + 1))))
    text = F.col("view") == 0
    found = written(found.where(k >= F.when(text, SEEN).otherwise(2)).withColumn("off", off).where(F.col("off") >= F.when(text, DEVIATION).otherwise(0.0)), "found")
    wanted = [{r[0]: i for i, r in enumerate(found.where(F.col("view") == v).orderBy(F.desc("off"), "h").select("h").collect())} for v in (0, 1)]
    shared = learn.sparkSession.sparkContext.broadcast(wanted)

    def spelt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[set[bytes], set[bytes]] = (set(), set())
        for batch in batches:
            out = []
            for row in views_of(names, batch):
                for v in (0, 1):
                    new = list(row[v] - seen[v])
                    seen[v].update(new)
                    out += [(v, shared.value[v][h], f) for h, f in zip(hashes(new).tolist(), new, strict=True) if h in shared.value[v]]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int8(), pa.int32(), pa.binary()))], ["view", "at", "name"])

    named = learn.mapInArrow(spelt, "view byte, at int, name binary").distinct().collect()
    return tuple(View({bytes(r[2]): r[1] for r in named if r[0] == v}, np.zeros(len(wanted[v]) + 1)) for v in (0, 1))


CODED = [T.StructField("text", T.BinaryType()), T.StructField("meta", T.BinaryType())]


def coded(docs: DataFrame, text: View, meta: View, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(kept columns, text, meta: the coded features of both views) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((text, meta))
    names = [c for c in META if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            rows = [(own[0].coded(a), own[1].coded(b)) for a, b in views_of(names, batch)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), *(pa.array([r[v] for r in rows], pa.binary()) for v in (0, 1))], [*kept, "text", "meta"])

    return docs.select(*dict.fromkeys([*kept, "text", *names])).mapInArrow(run, T.StructType([*(docs.schema[x] for x in kept), *CODED]))


META = ("lang", "source", "n_chars")


def surest(free: DataFrame, view: View, by: str, value: int, most: int) -> list[tuple[object, bytes, bytes]]:
    """(doc_id, text, meta) of the ``most`` unlabelled documents of which a view is surest that they are good (1) or bad (0), the surest first."""
    shared = free.sparkSession.sparkContext.broadcast(view)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sigmoid(shared.value.logits(batch.column(by).to_pylist()))
            sure = p if value else 1 - p
            keep = np.flatnonzero(sure >= SURE)
            yield pa.RecordBatch.from_arrays([*(batch.column(x).take(pa.array(keep)) for x in ("doc_id", "text", "meta")), pa.array(sure[keep])], ["doc_id", "text", "meta", "sure"])

    found = free.mapInArrow(run, T.StructType([*(free.schema[x] for x in ("doc_id", "text", "meta")), T.StructField("sure", T.DoubleType())]))
    best = found.orderBy(F.desc("sure"), F.xxhash64("doc_id"), "doc_id", "text", "meta").limit(most)
    return [(r[0], bytes(r[1]), bytes(r[2])) for r in best.collect()]


def trained(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> tuple[Model, DataFrame | None]:
    """The fitted model, and a written table (doc_id, text, meta) of the coded features of all documents.

    Without labels of both kinds every document gets the share of good ones (1 without labels), and there is no
    table. A label without a document, of a null id or of a null quality says nothing; labels that contradict each
    other count as bad, and of several documents of one labelled id the first in order of its columns is learnt from.
    """
    spark = docs.sparkSession
    known = [c for c in ("doc_id", "text", *META) if c in docs.columns]
    names = [c for c in META if c in docs.columns]
    ids = labelled_ids(labels, max_labelled)
    # The list has a bounded number of ids; it is collected, so that the scan of texts needs no shuffle.
    mine = [(r[0], r[1]) for r in ids.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").collect()]
    good = sum(y for _, y in mine)
    if not mine or good in (0, len(mine)):
        return Model(prior=good / len(mine) if mine else 1.0), None
    wanted = spark.createDataFrame(mine, T.StructType([T.StructField("doc_id", type_of(docs, "doc_id")), T.StructField("y", T.IntegerType())]))
    first = Window.partitionBy("doc_id").orderBy(*known)
    rows = docs.select(*known).join(F.broadcast(wanted), "doc_id").withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")
    # The texts are written, as their features would be several times as large, and are read for every use.
    rows = written(rows.withColumn("out", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0), "sample")
    learn = rows.where(~F.col("out"))
    n, n_good = learn.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not 0 < (n_good or 0) < n:
        return Model(prior=good / len(mine)), None
    text, meta = choose(learn, names, n, n_good / n)
    data = coded(rows, text, meta, ("doc_id", "y", "out")).collect()
    every = written(coded(docs, text, meta), "coded")
    free = None
    if rounds:
        free = written(every.where(F.col("doc_id").isNotNull()).join(labels.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", "text", "meta"), "free")
    data = sorted((r["y"], r["out"], bytes(r["text"]), bytes(r["meta"])) for r in data)  # the same sums whatever the order of arrival
    return cotrain(data, text, meta, rounds, lambda view, by, value, most: surest(free, view, by, value, most)), every


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    return trained(docs, labels, max_labelled, rounds)[0]


def cotrain(data: list[tuple[int, bool, bytes, bytes]], text: View, meta: View, rounds: int, sure: Callable[[View, str, int, int], list]) -> Model:
    """data: labelled rows (y, kept out, coded text, coded metadata). sure(view, its name, value, most) gives the surest unlabelled documents, as ``surest`` does."""
    views, at = {"text": text, "meta": meta}, {"text": 2, "meta": 3}
    y = np.array([r[0] for r in data])
    out = np.array([bool(r[1]) for r in data])
    held = out if 0 < y[out].sum() < out.sum() else ~out
    given: dict[str, list[tuple[bytes, int]]] = {v: [] for v in views}
    taken: dict[str, set] = {v: set() for v in views}
    fitted = dict.fromkeys(views, -1)
    for turn in range(rounds + 1):
        for v, view in views.items():
            if fitted[v] == len(given[v]):  # nothing new to learn from
                continue
            fitted[v] = len(given[v])
            column = [r[at[v]] for r in data]
            rows, cols = places([x for x, o in zip(column, out, strict=True) if not o] + [x for x, _ in given[v]], view.kind)
            view.weights = fit_logistic(rows, cols, len(view.weights) - 1, np.append(y[~out], [k for _, k in given[v]]).astype(float))
            view.scale = tuple(map(float, fit_dense(view.raw([x for x, h in zip(column, held, strict=True) if h])[:, None], y[held].astype(float))))
        if turn == rounds:
            break
        for v, other in (("text", "meta"), ("meta", "text")):
            for value in (1, 0):
                # No more than a share of what is labelled so, lest a view drown the other.
                most = int(GROWTH * (y[~out] == value).sum())
                for key, *coded_views in sure(views[v], v, value, most + len(taken[other])):
                    if most and key not in taken[other]:
                        taken[other].add(key)
                        given[other].append((coded_views[at[other] - 2], value))
                        most -= 1
    logits = np.column_stack([view.logits([r[at[v]] for r, h in zip(data, held, strict=True) if h]) for v, view in views.items()])
    return Model(text, meta, tuple(map(float, fit_dense(logits, y[held].astype(float)))), None)


SCORES = ("text_prob", "meta_prob", "quality_prob")


def scored(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """(doc_id, text_prob, meta_prob, quality_prob, keep) of every row of docs by a model that is fitted to labels.

    Null and empty texts, and nulls of the metadata, are judged by what they lack, like any other; null ids are scored,
    repeated rows alike; an empty table gives no rows. Columns besides doc_id, text, lang, source and n_chars, of which
    only the first two must be there, are not looked at.
    """
    model, table_ = trained(docs, labels, **more)
    rows = coded(docs, model.text, model.meta) if table_ is None else table_
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.scores(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[:, k]) for k in range(3)), pa.array(got[:, 2] >= KEEP)], ["doc_id", *SCORES, "keep"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *(T.StructField(x, T.DoubleType()) for x in SCORES), T.StructField("keep", T.BooleanType())]))


def filter_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """docs, all columns kept, without the documents whose combined probability is under ``keep``.

    Nulls, repeated rows and other columns are as in ``scored``. Features are made anew, so that rows need not be
    told apart to meet their scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = [c for c in META if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = [(model.text.coded(a), model.meta.coded(b)) for a, b in views_of(names, batch)] if model.prior is None else [(b"", b"")] * len(batch)
            yield batch.filter(pa.array(model.scores([a for a, _ in rows], [b for _, b in rows])[:, 2] >= keep))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
