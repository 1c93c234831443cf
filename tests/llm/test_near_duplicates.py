from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
import xxhash
from texts import documents, empty, prose, rows

from cellweave.llm import simhash as op
from cellweave.llm.common import components


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def plain_fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(pairs, links):
    """pairs: (id, fingerprint); the smallest id reachable."""
    root = list(range(len(pairs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(pairs):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(pairs))]


def brute(docs, distance=4):
    pairs = [(i, plain_fingerprint(t)) for i, t in docs]
    links = [(a, b) for a, b in combinations(range(len(pairs)), 2) if (pairs[a][1] ^ pairs[b][1]).bit_count() <= distance]
    return sorted(((i, f, c) for (i, f), c in zip(pairs, plain_components(pairs, links))), key=repr)


def result(df, **more):
    return sorted(((r["doc_id"], r["fp"] & ((1 << 64) - 1), r["component_id"]) for r in op.near_duplicates(df, **more).collect()), key=repr)


def test_fingerprints():
    for text in [t for _, t, *_ in rows()] + [prose(7, 2000)]:
        assert op.fingerprint(text) == plain_fingerprint(text)


def near_copies(n=400):
    rng = np.random.default_rng(5)
    docs = []
    for k in range(n):
        base = prose(k % 80, 150 + k % 60).split() if k % 5 else prose(1000 + k, 60).split()
        for at in rng.integers(0, len(base), k % 4):
            base[at] = f"edit{k}"
        docs.append((k * 3, " ".join(base)))
    return docs


@pytest.mark.parametrize("block", [4, 2048])
def test_against_brute_force(spark, block):
    docs = near_copies()
    want = brute(docs)
    assert len({c for _, _, c in want}) < len(docs) - 50  # there is something to find
    assert result(spark.createDataFrame(docs, "doc_id long, text string"), block=block) == want


@pytest.mark.parametrize("distance", [0, 1, 3, 6])
def test_other_distances(spark, distance):
    docs = near_copies(150)
    assert result(spark.createDataFrame(docs, "doc_id long, text string"), distance=distance) == brute(docs, distance)


def test_awkward_rows_and_empty_tables(spark):
    assert result(documents(spark)) == brute([r[:2] for r in rows()])
    assert result(empty(spark)) == []


def test_one_document_of_a_group_stays_with_all_its_columns(spark):
    table = documents(spark)
    kept = op.deduplicate(table)
    assert kept.columns == table.columns
    got = kept.collect()
    low = {i for i, _, c in brute([r[:2] for r in rows()]) if i is not None and i == c}
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(low)
    assert [r["text"] for r in got if r["doc_id"] is None] == ["no id at all"]  # the other null id is a text without words, like documents 4 to 6
    assert op.deduplicate(empty(spark)).count() == 0


def test_one_row_of_a_component_whatever_the_ids(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    near = c + " " + c.split()[0]
    assert (op.fingerprint(c) ^ op.fingerprint(near)).bit_count() <= 4
    texts = [(1, a), (1, b), (2, a), (3, b), (None, a), (None, c), (None, near), (None, c)]
    got = op.deduplicate(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    first = min((c, near), key=lambda t: (op.fingerprint(t) ^ 1 << 63))  # as signed numbers
    assert sorted(((r["doc_id"] or 0, r["text"]) for r in got)) == sorted([(0, first), (1, a), (1, b)])


def test_every_pair_within_the_distance_meets_in_a_partition():
    """For thresholds that sum to distance - m + 1, two fingerprints within the distance agree in some partition up to its threshold."""
    rng = np.random.default_rng(6)
    for m, ts in ((2, (1, 2)), (3, (0, 0, 2)), (3, (2, 1, -1)), (5, (0,) * 5)):
        parts = op.partitions(rng.random((64, 64)), 10, m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and sum(ts) == 4 - m + 1
        for _ in range(200):
            flips = rng.choice(64, rng.integers(0, 5), replace=False)
            assert any(t >= 0 and sum(b in p for b in flips) <= t for p, t in zip(parts, ts))


def test_thresholds_are_allocated_at_least_cost():
    rng = np.random.default_rng(7)
    for m, total in ((2, 3), (3, 2), (4, 1)):
        cost = [[0.0, *np.cumsum(rng.random(5))] for _ in range(m)]
        got = op.allocate(cost, total)
        from itertools import product

        best = min(sum(cost[i][t + 1] for i, t in enumerate(ts)) for ts in product(range(-1, 5), repeat=m) if sum(ts) == total)
        assert sum(got) == total and sum(cost[i][t + 1] for i, t in enumerate(got)) == pytest.approx(best)


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 161)) and all(got[k] == 1 for k in range(1, 60)) and got[202] == 200 and 300 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
