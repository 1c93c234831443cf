from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import documents, empty, prose, rows

from cellweave.llm import quality as op

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=600):
    """Good prose, repeated junk and prose with insults; sources tell a little."""
    docs, labels = [], []
    for k in range(n):
        good, toxic = k % 4 != 0, k % 10 == 1
        text = prose(k, 30 + k % 50).capitalize() + "." if good else " ".join([prose(k, 1)] * 2 * (5 + k % 9)) + " !!!"
        if toxic:
            text = text.replace(" ", f" vile{'abcdefgh'[k % 8]}x ", 2)
        docs.append((k, text, "en", f"src{k % 3 if good else 4 + k % 2}", len(text)))
        labels.append((k, int(good), int(toxic)))
    return docs, labels


def test_accuracy_on_labels_that_were_kept_out(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in op.scored(df, spark.createDataFrame([x for x in labels if x[0] % 3], LABELS)).collect()}
    kept_out = [x for x in labels if x[0] % 3 == 0]
    right = [got[i]["keep"] == bool(q and not t) for i, q, t in kept_out]
    assert len(got) == len(docs) and np.mean(right) > 0.95
    assert all(0 <= r[c] <= 1 for r in got.values() for c in ("text_prob", "meta_prob", "quality_prob"))
    again = {r["doc_id"]: r["quality_prob"] for r in op.scored(df, spark.createDataFrame([x for x in labels if x[0] % 3][::-1], LABELS)).collect()}
    assert again == {i: r["quality_prob"] for i, r in got.items()}


def coded(numbers):
    return np.array(numbers, "<u2").tobytes()


def memory(free):
    """surest() of rows (id, coded text, coded metadata) in memory."""
    def sure(view, by, value, most):
        p = op.sigmoid(view.logits([r[1 if by == "text" else 2] for r in free]))
        s = p if value else 1 - p
        return [free[i] for i in np.argsort(-s, kind="stable")[:most] if s[i] >= op.SURE]

    return sure


def test_views_teach_each_other():
    """With labels for a tenth of the documents, pseudo-labels bring the metadata view what only the text view could learn."""
    rng = np.random.default_rng(1)
    data, free = [], []
    for k in range(800):
        y = k % 2
        row = coded([0 if y else 1] + [int(rng.integers(2, 6))]), coded([y if rng.random() < 0.9 else 1 - y])
        data.append((y, k // 10 % 5 == 0, *row)) if k % 10 < 2 else free.append((k, *row))
    views = lambda: (op.View({b"%d" % i: i for i in range(6)}, np.zeros(7)), op.View({b"0": 0, b"1": 1}, np.zeros(3)))
    alone, taught = op.cotrain(data, *views(), 0, memory(free)), op.cotrain(data, *views(), 3, memory(free))
    assert taught.meta.weights[1] > 0 > taught.meta.weights[0] and taught.text.weights[0] > taught.text.weights[1] and alone.prior is taught.prior is None
    assert not np.allclose(alone.meta.weights, taught.meta.weights)


def plain_cotraining(docs, labels, kept_out, hashes, rounds):
    """Co-training by dense matrices and plain loops: the same features and definitions, no shared code but the features'."""
    meta = lambda r: op.meta_features({"lang": r[2], "source": r[3], "n_chars": r[4]})
    sets = [{r[0]: op.text_features(r[1]) for r in docs}, {r[0]: meta(r) for r in docs}]
    y = {i: int(q == 1 and not t) for i, q, t in labels if i in sets[0]}
    learn, held = [i for i in sorted(y) if not kept_out[i]], [i for i in sorted(y) if kept_out[i]]
    p, n = sum(y[i] for i in learn) / len(learn), len(learn)
    names = []
    for v in (0, 1):
        count, good = {}, {}
        for i in learn:
            for f in sets[v][i]:
                count[f] = count.get(f, 0) + 1
                good[f] = good.get(f, 0) + y[i]
        off = {f: abs(good[f] - k * p) / np.sqrt(k * p * (1 - p) * (1 - k / (n + 1))) for f, k in count.items()}
        names.append(sorted(f for f, k in count.items() if (k >= 4 and off[f] >= 4 if v == 0 else k >= 2)))
    dense = [{i: np.array([f in s for f in names[v]], float) for i, s in sets[v].items()} for v in (0, 1)]

    def descend(x, t):
        x = np.column_stack([x, np.ones(len(x))])
        w, m, s = np.zeros(x.shape[1]), 0.0, 0.0
        ridge = np.append(np.full(x.shape[1] - 1, 5e-5), 0)
        for k in range(1, 251):
            g = x.T @ (1 / (1 + np.exp(-(x @ w))) - t) / len(t) + ridge * w
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            w = w - 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-9)
        return w

    def newton(x, t):
        x = np.column_stack([x, np.ones(len(x))])
        ridge, w = np.append(np.ones(x.shape[1] - 1), 0.01), np.zeros(x.shape[1])
        for _ in range(30):
            q = 1 / (1 + np.exp(-(x @ w)))
            w = w - np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + np.diag(ridge), x.T @ (q - t) + ridge * w)
        assert (w[:-1] >= 0).all()  # where one is below 0 it would be left out
        return w

    given = [dict(), dict()]
    for turn in range(rounds + 1):
        logits = []
        for v in (0, 1):
            w = descend(np.array([dense[v][i] for i in learn] + [dense[v][i] for i in given[v]]), np.array([y[i] for i in learn] + list(given[v].values())))
            raw = {i: float(x @ w[:-1] + w[-1]) for i, x in dense[v].items()}
            slope, bias = newton(np.array([[raw[i]] for i in held]), np.array([y[i] for i in held]))
            logits.append({i: slope * z + bias for i, z in raw.items()})
        if turn < rounds:
            for v in (0, 1):
                for value in (1, 0):
                    sure = {i: 1 / (1 + np.exp(-z if value else z)) for i, z in logits[v].items() if i not in y and i not in given[1 - v]}
                    most = int(0.25 * sum(y[i] == value for i in learn))
                    for i in sorted((i for i, s in sure.items() if s >= 0.98), key=lambda i: (-round(sure[i], 12), hashes[i]))[:most]:
                        given[1 - v][i] = value
    a, b, c = newton(np.array([[logits[0][i], logits[1][i]] for i in held]), np.array([y[i] for i in held]))
    return {i: [1 / (1 + np.exp(-z)) for z in (logits[0][i], logits[1][i], a * logits[0][i] + b * logits[1][i] + c)] for i in sets[0]}, given


def test_against_plain_cotraining_row_by_row(spark):
    """Every document's three probabilities; the equally sure go by the hash of their ids."""
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for k in range(500):
        good = rng.random() < 0.6
        words = prose(k, 25).split() + [("calm", "vile")[rng.random() < (0.15 if good else 0.85)] for _ in range(int(rng.integers(1, 4)))] + ([f"rare{k % 7}"] if good else [])
        docs.append((k, " ".join(words), ("en", "de")[rng.random() < (0.3 if good else 0.7)], f"s{int(rng.integers(0, 4)) + (0 if good else 2)}", int(rng.integers(50, 900))))
        if k % 3 == 0:
            labels.append((k, int(good), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    own = df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5)) == 0, F.xxhash64("doc_id")).collect()
    want, given = plain_cotraining(docs, labels, {r[0]: r[1] for r in own}, {r[0]: r[2] for r in own}, 1)
    assert given[0] or given[1]
    got = op.scored(df, spark.createDataFrame(labels, LABELS), rounds=1).collect()
    assert len(got) == len(docs)
    for r in got:
        np.testing.assert_allclose([r["text_prob"], r["meta_prob"], r["quality_prob"]], want[r["doc_id"]], atol=1e-4)


def test_unlabelled_documents_of_all_the_table_are_scored(spark):
    """The surest are taken from all of them, however many there are, whatever their place."""
    rows = [(k, coded([0] if k % 100 == 7 else [1]), coded([])) for k in range(20_000)]
    free = spark.createDataFrame(rows, "doc_id long, text binary, meta binary").repartition(8)
    view = op.View({b"a": 0, b"b": 1}, np.array([9.0, 0.0, 0.0]))
    got = op.surest(free, view, "text", 1, 500)
    assert len(got) == 200 and {i % 100 for i, *_ in got} == {7}
    assert len(op.surest(free, view, "text", 1, 50)) == 50 and op.surest(free, view, "text", 0, 50) == []


@pytest.mark.parametrize(("labels", "prior"), [([], 1.0), ([(1, 1, 0), (2, 1, 0)], 1.0), ([(1, 0, 0), (2, 1, 1)], 0.0), ([(None, 1, 0), (1, None, 0), (999, 1, 0)], 1.0)])
def test_labels_that_allow_no_fit_give_everyone_one_score(spark, labels, prior):
    table = documents(spark)
    given = spark.createDataFrame(labels, LABELS)
    got = op.scored(table, given).collect()
    assert len(got) == len(rows()) and {r["quality_prob"] for r in got} == {prior}
    assert op.filter_quality(table, given).count() == (len(rows()) if prior else 0)


def test_awkward_rows_and_empty_tables(spark):
    table = documents(spark)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 50)] + [(20, 1, None), (None, 1, 1)], LABELS)
    got = op.scored(table, labels).collect()
    assert len(got) == len(rows()) and all(0 <= r["quality_prob"] <= 1 for r in got)
    kept = op.filter_quality(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(r["keep"] for r in got)
    assert op.scored(empty(spark), labels).collect() == []
    few = table.select("doc_id", "text")
    assert len(op.scored(few, labels).collect()) == len(rows())


def test_features():
    assert op.text_features(None) == op.text_features("") and b"w:hello" in op.text_features("“Hello, (hello)") | op.text_features("(Hello!")
    few, many = op.text_features("abcdefx abcdefy"), op.text_features("abcdefx abcdefy abcdefz abcdefw")
    assert b"q:abcdef" in few and b"r:abcdef" not in few and b"r:abcdef" in many and b"w:abcdefx" not in few and b"w:abcdef" in op.text_features("abcdef")
    assert b"lang=None" in op.meta_features({"lang": None, "n_chars": None}) and b"n_chars=none" in op.meta_features({"lang": None, "n_chars": None})


def test_runs_of_signs_are_told_apart_to_their_ends():
    assert op.text_features("no !!!!!!!!!?") != op.text_features("no !!!!!!!!!.") and b"s:!?" in op.text_features("no!?")


def test_words_differ_after_their_beginnings_and_runs_have_insides():
    first, second = op.text_features("abcdefghijkl-end"), op.text_features("abcdefghijkl-and")
    assert first != second and op.text_features("преступность") != op.text_features("преступления")
    inside = op.text_features("今日はとても毒言葉良い天気ですね。")
    assert op.text_features("毒言葉") & inside and "c:毒言葉".encode() in inside
    assert b"c:toxic" not in op.text_features("toxic") and b"c:venomy" in op.text_features("q" * 50 + "venomy" + "z" * 50)


def test_endings_of_long_words_and_insides_of_sentences_are_learnt(spark):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(400):
        filler = "".join(chr(0x4E00 + int(c)) for c in rng.integers(0, 60, 30))
        bad = k % 2
        texts.append((k, f"{prose(k, 20)} interconnect{'edly' if bad else 'ions'}" if k % 4 < 2 else filler[:15] + ("毒言葉" if bad else "") + filler[15:], 1 - bad))
    df = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string")
    got = {r["doc_id"]: r["keep"] for r in op.scored(df, spark.createDataFrame([(k, y, 0) for k, _, y in texts if k % 8 < 6], LABELS)).collect()}
    assert np.mean([got[k] == bool(y) for k, _, y in texts if k % 8 >= 6 and k % 4 >= 2]) > 0.95
    got = {r["doc_id"]: r["keep"] for r in op.scored(df, spark.createDataFrame([(k, y, 0) for k, _, y in texts if k % 8 < 4], LABELS)).collect()}
    assert np.mean([got[k] == bool(y) for k, _, y in texts if k % 8 >= 4]) > 0.95
