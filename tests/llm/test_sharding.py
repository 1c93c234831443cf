from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from texts import documents, empty, rows, saved

from cellweave.llm import sharding as op


def placed(spark, n, weights):
    return {r[0]: r[1] for r in spark.range(n).select("id", op.tree_shard(F.col("id").cast("string"), weights)).collect()}


def test_shares_follow_the_weights(spark):
    weights = [1.0, 2.0, 0.0, 4.0, 1.0, 1.0, 3.0]
    got = Counter(placed(spark, 60_000, weights).values())
    assert got[2] == 0
    for s, w in enumerate(weights):
        assert abs(got[s] / 60_000 - w / 12) < 0.01


def plain(key: str, weights, rack=op.RACK, region=op.REGION):
    """Placement by plain descent: regions, racks and shards by the least draw within them."""
    def draw(s):
        h = xxhash.xxh64_intdigest(f"shard/{s}".encode(), xxhash.xxh64_intdigest(key.encode(), 42))
        return -math.log(((h >> 12) + 0.5) / (1 << 52)) / weights[s]

    def least(shards):
        return min(((draw(s), s) for s in shards if weights[s] > 0), default=(math.inf, -1))

    shards = list(range(len(weights)))
    while len(shards) > rack:  # down to a rack: by the part with the least draw
        size = rack * region if len(shards) > rack * region else rack
        shards = min((shards[k : k + size] for k in range(0, len(shards), size)), key=least)
    return least(shards)[1]


@pytest.mark.parametrize("weights", [[1.0] * 40, [1.0] * 41, [1.0, 2.5, 0.0, 4.0, 1.0, 0.0, 3.0, 0.5, 1.0, 1.0, 2.0, 0.0, 0.0], [0.0, 2.0]])
def test_placement_against_a_plain_descent(spark, weights):
    got = placed(spark, 3000, weights)
    assert got == {k: plain(str(k), weights) for k in range(3000)}


@pytest.mark.parametrize("n", [1, 2, 4, 5, 9, 10, 39, 40, 41, 42, 45, 46, 50, 99])
def test_one_more_shard_takes_only_into_itself_whatever_their_number(spark, n):
    a, z = placed(spark, 8000, [1.0] * n), placed(spark, 8000, [1.0] * (n + 1))
    moved = [k for k in a if a[k] != z[k]]
    assert all(z[k] == n for k in moved) and abs(len(moved) / 8000 - 1 / (n + 1)) < 0.025


def test_a_changed_weight_moves_only_into_or_out_of_its_shard(spark):
    before = [1.0] * 40
    after = list(before)
    after[12] = 3.0
    a, z = placed(spark, 20_000, before), placed(spark, 20_000, after)
    assert all(z[k] == 12 for k in a if a[k] != z[k]) and any(a[k] != z[k] for k in a)
    after[12] = 0.5
    z = placed(spark, 20_000, after)
    assert all(a[k] == 12 for k in a if a[k] != z[k]) and any(a[k] != z[k] for k in a)


def test_weights_must_be_sensible():
    for bad in ([-1.0, 2.0], [0.0, 0.0], []):
        with pytest.raises(ValueError):
            op.tree_shard(F.lit("x"), bad)


def test_query_on_awkward_rows(spark, tmp_path):
    d = saved(tmp_path, documents=documents(spark))
    got = op.op6_hierarchical_sharding(spark, d).collect()
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = {}
    for r in got:
        assert r["law"] == "key" and 0 <= r["shard"] < 40 and r["grown_shard"] in (r["shard"], 40)
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    homes = {}
    for r in got:
        homes.setdefault(r["doc_id"], set()).add((r["shard"], r["grown_shard"]))
    assert all(len(x) == 1 for x in homes.values())
    d = saved(tmp_path, documents=empty(spark))
    assert op.op6_hierarchical_sharding(spark, d).collect() == []


def test_the_plan_has_no_python(spark, tmp_path, capsys):
    d = saved(tmp_path, documents=documents(spark))
    op.op6_hierarchical_sharding(spark, d).explain("formatted")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_all_columns_are_kept(spark):
    table = documents(spark)
    assert op.shard(table, [1.0, 1.0], out="home").columns == [*table.columns, "home"]
    got = op.shard(table, [1.0, 1.0])  # the table has a column shard
    assert got.columns == [*("shard_1" if c == "shard" else c for c in table.columns), "shard"]
    assert {r["shard_1"] for r in got.collect()} == {"s"} and {r["shard"] for r in got.collect()} == {0, 1}
    assert op.shard(empty(spark), [1.0]).count() == 0
    ids = table.select("doc_id")
    assert op.shard(ids, [1.0, 1.0], out="doc_id").columns == ["doc_id_1", "doc_id"]
