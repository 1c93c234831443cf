from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from texts import documents, empty, prose, rows

from cellweave.llm import decontamination as op

ITEMS = [(1, prose(50, 25)), (2, prose(50, 25)), (3, "short item, of five words"), (4, None), (5, "!!! ..."), (6, "Straße über alles ja"), (10, prose(51, 10)), (None, prose(52, 12))]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            x = words(t)
            n = min(10, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if x else set()
            for k in range(len(w) - n + 1) if n else []:
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()))
    return sorted(out, key=repr)


def docs():
    a, b = prose(50, 25).split(), prose(51, 10)
    return [
        (1, f"lead {' '.join(a)} end"), (2, " ".join(a[3:12])), (3, " ".join(a[3:13]).upper() + "!"), (4, f"{b}, {b}"), (5, "a SHORT item of: five-words and more"), (6, "straße ÜBER alles ja"), (7, "straße über alles ja"),
        (8, None), (9, ""), (10, prose(60, 5000) + " " + " ".join(a[5:20]) + " " + prose(61, 5000)), (11, prose(52, 12)),
    ]


def result(spark, table, items=ITEMS, **more):
    from pyspark.sql import functions as F

    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = op.benchmark_hits(table, bench, **more).collect()
    return sorted(((r["doc_id"], r["n_words"], len(r["hits"]), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest()) for r in got), key=repr)


@pytest.mark.parametrize("block", [1, 30, 1_000_000])
def test_against_brute_force_in_blocks_of_any_size(spark, block):
    items = [(i, t) for i, t in ITEMS if i is not None]
    assert result(spark, spark.createDataFrame(docs(), "doc_id long, text string"), items, block_words=block) == brute(docs(), items)


def test_awkward_rows_and_empty_tables(spark):
    items = [(1, "the same text in many rows, all alike"), (2, "one")]
    assert result(spark, documents(spark), items) == brute([r[:2] for r in rows()], items)
    assert result(spark, empty(spark), items) == []
    assert all(x[2] == 0 for x in result(spark, documents(spark), []))


def test_removal_keeps_every_column_and_clean_documents(spark):
    bench = spark.createDataFrame([(1, "the same text in many rows, all alike")], "item_id long, text string")
    table = documents(spark)
    left = op.decontaminate(table, bench)
    assert left.columns == table.columns and left.count() == len(rows()) - 30
    cut = op.decontaminate(table, bench, mode="spans")
    assert cut.count() == len(rows()) and not any(x[2] for x in result(spark, cut, [(1, "the same text in many rows, all alike")]))
    assert {r["doc_id"]: r["text"] for r in cut.collect()}[9] == "two words"


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash that is the same for all, every lookup is decided by the words."""
    monkeypatch.setattr(op, "rolled", lambda ids, width: np.zeros(len(ids) - width + 1, np.uint64))
    items = [(i, words(t)) for i, t in ITEMS if i is not None]
    found = op.Windows([(i, [w.encode() for w in ws]) for i, ws in items if ws], 10)
    for i, text in docs():
        if i == 10:
            continue
        hits, own = found.scan(op.words_of(text))
        want = next(x for x in brute([(i, text)], [x for x in ITEMS if x[0] is not None]))
        assert (len(hits), len(own)) == want[2:4]


def test_spans_of_several_blocks_are_cut_until_none_hits(spark):
    """The second block's cut puts together a window of the first."""
    first, second = " ".join("abcdefghij"), " ".join(f"z{k}" for k in range(10))
    text = f"start a b c d e {second} f g h i j end"
    df = spark.createDataFrame([(1, text), (2, "clean words"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, first), (2, second)], "item_id long, text string").repartition(1)
    cut = {r["doc_id"]: r["text"] for r in op.decontaminate(df, bench, mode="spans", block_words=1).collect()}
    assert cut[1].split() == ["start", "end"] and cut[2] == "clean words" and cut[3] is None
    left = {r["doc_id"] for r in op.decontaminate(df, bench, block_words=1).collect()}
    assert left == {2, 3}


def test_a_block_is_small():
    """Some 30 bytes a word and a vocabulary."""
    import pickle

    rng = np.random.default_rng(1)
    items = [(k, [b"w%d" % x for x in rng.integers(0, 3000, 200)]) for k in range(500)]
    own = op.Windows(items, 10)
    arrays = sum(x.nbytes for x in own.by_width[10][1:]) + own.words.nbytes
    assert arrays < 35 * 100_000 and len(pickle.dumps(own)) < 60 * 100_000 + (1 << op.TABLE_BITS)


def test_spans_are_cut_out_until_nothing_is_left():
    window = " ".join("abcdefghij")
    text = f"Keep THIS. {window} and this"
    assert op.cut_spans(text, set(range(2, 12))) == "Keep THIS. \n and this"
    with pytest.raises(ValueError):
        op.decontaminate(None, None, mode="other")
