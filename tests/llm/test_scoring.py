from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from texts import documents, empty, prose, rows

from cellweave.llm import interpolation as op


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [None]


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10


def brute(docs, order):
    """Estimates of all orders mixed by buckets of the longest seen context's count, weights learned by plain expectation-maximisation on every token."""
    lists = [(i, fold(i), tokens(t)) for i, t in docs]

    def histories(ts):
        """Of every token: (context, n-gram) of each order from 2 on; before a text there are starts."""
        line = ["start"] * (order - 1) + ts
        for at in range(order - 1, len(line)):
            yield line[at], [(tuple(line[at - k : at]), tuple(line[at - k : at + 1])) for k in range(1, order)]

    def counts(use):
        uni, grams, ctx = Counter(), Counter(), Counter()
        for _, f, ts in lists:
            if use(f):
                for t, own in histories(ts):
                    uni[t] += 1
                    for c, g in own:
                        grams[g] += 1
                        ctx[c] += 1
        return uni, grams, ctx

    def estimates(ts, counted):
        uni, grams, ctx = counted
        n, v = sum(uni.values()), len(whole[0])
        for t, own in histories(ts):
            bucket, out = 0, [1 / (v + 1), uni[t] / n if n else 0.0]
            for k, (c, g) in enumerate(own, 1):
                if ctx[c]:
                    bucket = 24 * k + min(int(math.log2(ctx[c])), 23)
                    out.append(grams[g] / ctx[c])
            yield bucket, out

    whole = counts(lambda f: f != 0)
    rest = counts(lambda f: f not in (0, 1))
    by_bucket = {}
    for _, f, ts in lists:
        if f == 1:
            for bucket, p in estimates(ts, rest):
                by_bucket.setdefault(bucket, []).append(p)
    weights = {}
    for bucket, ps in by_bucket.items():
        w = [1 / len(ps[0])] * len(ps[0])
        for _ in range(500):
            total = [0.0] * len(w)
            for p in ps:
                z = sum(a * b for a, b in zip(w, p))
                total = [x + a * b / z for x, a, b in zip(total, w, p)]
            w = [x / len(ps) for x in total]
        weights[bucket] = w
    n, v = sum(whole[0].values()), len(whole[0])

    def weights_of(bucket):
        """A bucket without deleted tokens has the weights of the next one below of its order, or equal ones."""
        for b in range(bucket, bucket // 24 * 24 - 1, -1):
            if b in weights:
                return weights[b]
        top = bucket // 24 + 2
        return [1 / top] * top

    out = []
    for i, f, ts in lists:
        base = sum(math.log10((whole[0][t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        score = 0.0
        for bucket, p in estimates(ts, whole):
            w = weights_of(bucket)
            w = [max(w[0], 1e-6), *w[1:]]
            score += math.log10(sum(a * b for a, b in zip(w, p)) / sum(w))
        out.append((i, f == 0, len(ts), sum(whole[0][t] > 0 for t in ts), n, base, score))
    return out


@pytest.mark.parametrize(("order", "batch"), [(3, 50), (3, 10_000_000), (2, 10_000), (1, 10_000), (4, 10_000)])
def test_against_brute_force(spark, order, batch):
    docs = [(k, prose(k % 70, 5 + k % 30)) for k in range(150)] + [(500, None), (501, ""), (502, "unseen words here"), (503, "alpha unseen beta gamma")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in op.deleted_interpolation(df, order, batch_tokens=batch, share_bytes=200).collect()}
    assert len(got) == len(docs)
    for i, held, n, known, total, base, score in brute(docs, order):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        # Tokens of a cell of a 16th of e-fold share a ratio: weights are off by some 10 ** -4.
        assert r["score"] == pytest.approx(score, rel=1e-3)


def test_requests_are_answered_alike_by_any_number_of_tasks_and_in_pieces(spark, monkeypatch):
    df = spark.createDataFrame([(k, prose(k % 20, 5 + k % 30)) for k in range(60)], "doc_id long, text string")
    want = None
    for asked, tasks in ((1000, 1000), (3, 1), (1, 7)):
        monkeypatch.setattr(op, "ASKED", asked)
        got = [tuple(r) for r in op.answered(op.encoded(df.coalesce(1), 3, 50, 200, True), 50, tasks).orderBy("batch", "part").collect()]
        want = want or got
        assert got == want and len({r[1] for r in got}) == 50


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_sorted_keys_come_back(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**56, n, np.uint64))
    packed = op.pack_sorted(keys) if n else b""
    assert n == 0 or (np.array_equal(op.unpack_sorted(packed), keys) and len(packed) <= 9 + 7 * n)


def test_a_mixture_is_learnt_as_by_plain_steps_where_cells_are_single_ratios():
    n, ratio = np.array([3.0, 5.0, 2.0]), np.array([[2.0, 9.0], [0.5, 0.0], [3.0, 1.0]])
    w = np.full(3, 1 / 3)
    for _ in range(500):
        share = np.column_stack([np.ones(3), ratio]) * w
        w = (share / share.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
    assert np.allclose(op.mixed(n, ratio * n[:, None], 2), w, atol=1e-6)


def test_documents_seen_twice_score_higher_than_what_is_like_them(spark):
    """What occurs twice in the corpus is told from other prose of the same words by its trigrams."""
    docs = [(k, prose(k, 60)) for k in range(300)] + [(1000 + k, prose(k, 60)) for k in range(0, 300, 10)]
    got = {r["doc_id"]: r["score"] for r in op.deleted_interpolation(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    twice = [got[k] for k in range(0, 300, 10)]
    once = [got[k] for k in range(300) if k % 10]
    assert np.mean([a > b for a in twice for b in once]) > 0.8


def test_scores_are_better_than_the_base_on_text_with_order(spark):
    phrase = "the quick brown fox jumps over the lazy dog and runs away"
    docs = spark.createDataFrame([(k, " ".join([phrase] * 3)) for k in range(200)], "doc_id long, text string")
    got = op.deleted_interpolation(docs).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] for r in got)


def test_mixture_is_a_distribution():
    """Weights of every bucket sum to 1, so a mixture of distributions is one; nothing gets probability 0."""
    found = {0: op.mixed(np.array([10.0]), np.array([[5.0, 0.0]]), 1), 24: op.mixed(np.array([4.0]), np.array([[8.0, 40.0]]), 2), 27: op.mixed(np.array([9.0]), np.array([[3.0, 90.0]]), 2)}
    w = op.completed(found, 2)
    assert (abs(w.sum(1) - 1) < 1e-12).all() and (w[:, 0] > 0).all() and (w[:24, 2] == 0).all() and w[27, 2] > w[27, 1]


def test_the_same_whatever_the_order_of_rows(spark):
    docs = [(k, prose(k, 12)) for k in range(80)]
    a, z = ({r["doc_id"]: r["score"] for r in op.deleted_interpolation(spark.createDataFrame(x, "doc_id long, text string").repartition(n), batch_tokens=200).collect()} for x, n in ((docs, 1), (docs[::-1], 3)))
    assert a.keys() == z.keys() and all(a[k] == pytest.approx(z[k], rel=1e-6) for k in a)


def test_awkward_rows_and_empty_tables(spark):
    got = op.deleted_interpolation(documents(spark)).collect()
    assert len(got) == len(rows()) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[4]["n_tokens"] == by[5]["n_tokens"] == by[6]["n_tokens"] == 1 and by[10]["n_tokens"] == 30_001
    assert op.deleted_interpolation(empty(spark)).collect() == []
    only_held = spark.createDataFrame([(next(i for i in range(100) if fold(i) == 0), "a b")], "doc_id long, text string")
    r = op.deleted_interpolation(only_held).first()
    assert (r["train_tokens"], r["n_known"]) == (0, 0) and math.isfinite(r["score"])
