from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import permutation_index as op


def table(spark, vectors, ids=None):
    ids = list(range(len(vectors))) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 7, "x") for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int, pivot string")


def brute(vectors, ids, k=20, divisor=20):
    x = np.asarray(vectors, np.float32).astype(float)
    out = {}
    for i, q in zip(ids, x):
        if i % divisor == 0:
            score = x @ q
            order = sorted((-s, j) for s, j in zip(score.tolist(), ids) if j != i)[:k]
            out[i] = [(j, -s) for s, j in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in best}) / len(best) for q, best in want.items()])


def in_order(got, vectors, ids):
    """Scores are the exact inner products of the original vectors; the nearest first, ties by id."""
    x = dict(zip(ids, np.asarray(vectors, np.float32).astype(float)))
    for q, best in got.items():
        assert [(-s, i) for i, s in best] == sorted((-s, i) for i, s in best) and len({i for i, _ in best}) == len(best) and q not in {i for i, _ in best}
        assert np.allclose([s for _, s in best], [float(x[i] @ x[q]) for i, _ in best], rtol=1e-12)


@pytest.mark.parametrize("n", [12, 300, 900])
def test_small_tables_go_through_the_same_index(spark, n):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 8))
    x[n // 3 : n // 3 + n // 5] = x[0]  # exact copies, more than are wanted
    x[-(n // 10) :] *= 50
    got, want = found(op.nearest(table(spark, x))), brute(x, range(n))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    in_order(got, x, range(n))
    assert recall(got, want) >= 0.9


def test_queries_with_too_few_finds_are_compared_with_everything(spark):
    x = np.random.default_rng(7).normal(size=(400, 6))
    got, want = found(op.nearest(table(spark, x), posted=1, order=2, met=0.01)), brute(x, range(400))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    exact = found(op.nearest(table(spark, x), density=0.01))  # one pivot: one file, whole
    assert {q: [i for i, _ in v] for q, v in exact.items()} == {q: [i for i, _ in v] for q, v in want.items()}


def test_partial_footrule_distances_against_their_definition():
    rng = np.random.default_rng(8)
    n, length = 30, 7
    orders = np.array([rng.permutation(n)[:length] for _ in range(50)])
    own = rng.permutation(n)[: length + 5]
    place = lambda o: {p: k for k, p in enumerate(o[:length].tolist())}
    far = [sum(abs(place(o).get(p, length) - place(own).get(p, length)) for p in range(n)) for o in orders]
    assert [length * (length + 1) - 2 * g for g in op.gains(orders, own, length).tolist()] == far


def test_every_pair_is_ranked_in_one_file_only(spark):
    """What a bucket finds is what the definition says: first shared file, footrule gain, each pair once."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    pivots = op.Pivots(rng.normal(size=(12, 5)), 9.0)
    x, y = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    orders, asked = pivots.orders(x, 6, False), pivots.orders(y, 8, True)
    rows = [(int(p), i) for i in range(60) for p in orders[i, :3] if p < 8]
    posted = pa.table({"pivot": pa.array([p for p, _ in rows], pa.int32()), "rep": [i for _, i in rows], "v": [x[i].tolist() for _, i in rows], "order": [orders[i].astype("<i2").tobytes() for _, i in rows]})
    got = sorted((int(q), rows[p][1]) for a, b, _ in op.Bucket(posted, pivots.kind, 5, 3, 6).rank(y, asked, 5, 4) for q, p in zip(a, b))
    want = []
    for q in range(9):
        for i in range(60):
            shared = [p for p in asked[q, :5].tolist() if p in orders[i, :3]]
            if shared and shared[0] < 8 and op.gains(orders[i : i + 1], asked[q], 6)[0] >= 4:
                want.append((q, i))
    assert got == want and want


def test_files_are_put_into_buckets():
    home, cuts = op.buckets_of(np.array([3, 0, 4, 25, 2, 9, 1]), 10)
    assert home.tolist() == [0, 0, 0, 1, 2, 3, 3] and cuts.tolist() == [1, 3, 1, 1]
    assert op.buckets_of(np.array([25]), 10)[1].tolist() == [3]


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.6 * rng.normal(size=(6000, 32))
    x *= rng.uniform(0.5, 1.5, (6000, 1))
    got, want = found(op.nearest(table(spark, x), divisor=100)), brute(x, range(6000), divisor=100)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    in_order(got, x, range(len(x)))
    assert recall(got, want) >= 0.9


def test_unusable_vectors_take_no_part(spark):
    vectors = [[1, 0], [0, 1], [0, 0], None, [float("nan"), 1], [float("inf"), 1], [None, 1], [1, 1], [1, 2, 3], []]
    df = table(spark, vectors, [0, 1, 20, 40, 60, 80, 100, 120, 140, 160]).union(table(spark, [[5, 5]], [None])).union(table(spark, [[1, 0]], [0]))
    got = found(op.nearest(df))
    # [1, 2, 3] is as [1, 2] in what it shares with the others, and they are as if they went on with zeros.
    assert got == {0: [(120, 1.0), (140, 1.0), (1, 0.0)], 120: [(140, 3.0), (0, 1.0), (1, 1.0)], 140: [(120, 3.0), (1, 2.0), (0, 1.0)]}


def test_of_an_id_with_several_vectors_the_first_in_order_takes_part(spark):
    df = table(spark, [[1, 0], [0.5, 0], [2, 0], [3, 0], [1, 1]], [1, 1, 20, 20, 2])
    assert found(op.nearest(df)) == {20: [(2, 2.0), (1, 1.0)]}


def test_empty_and_lonely_tables(spark):
    assert op.nearest(table(spark, [])).collect() == []
    assert op.nearest(table(spark, [[1, 2]])).collect() == []
    assert op.nearest(table(spark, [[1, 2], [3, 4]], [1, 2])).collect() == []


def test_a_third_of_all_rows_alike(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4500, 16))
    x[::3] = x[0]
    got, want = found(op.nearest(table(spark, x), divisor=150)), brute(x, range(4500), divisor=150)
    assert got.keys() == want.keys()
    assert [s for _, s in got[0]] == pytest.approx([s for _, s in want[0]]) and [i for i, _ in got[0]] == [3 * k for k in range(1, 21)]
    in_order(got, x, range(len(x)))
    assert recall(got, want) >= 0.9


def test_extra_columns_change_nothing(spark):
    df = table(spark, np.random.default_rng(4).normal(size=(50, 4)))
    assert found(op.nearest(df)) == found(op.nearest(df.withColumn("v", F.lit(1)).withColumn("query", F.lit(2)).withColumn("score", F.lit(3))))
