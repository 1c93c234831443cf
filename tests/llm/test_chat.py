from __future__ import annotations

from texts import prose

from cellweave.llm import chat_rotation as op

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi <|end|> there"), (1, 3, "ann", None), (1, 4, "cy\n<x>", "third"), (2, 0, "system", "nobody else"), (3, 0, None, "no name"), (3, 0, "ann", "same turn"), (3, 0, "ann", "same turn"),
    (None, 0, "ann", "no conversation"), (None, 1, "bob", "still one"), (4, None, "ann", "no turn"), (4, 1, "ann", ""), (5, 0, "ann", "x" * 50_000), *((6, k, "ann" if k % 2 else "bob", prose(k, 3)) for k in range(200)),
]
SCHEMA = "conv_id long, turn int, role string, text string"


def plain(turns, system=("system",)):
    """Every speaker's rendering: {(conversation, speaker): (text, spans of the assistant)}."""
    out = {}
    for conv in {t[0] for t in turns}:
        own = [((-1 if t[1] is None else t[1]), "unknown" if t[2] is None else t[2], (t[3] or "").replace("<|", "< |")) for t in turns if t[0] == conv]
        own.sort()
        for speaker in {n for _, n, _ in own} - set(system):
            text, spans = "", []
            for _, name, said in own:
                safe = "".join("_" if c in "<|>\n\r" else c for c in name)
                text += "<|system|>\n" if name in system else "<|assistant|>\n" if name == speaker else f"<|user name={safe}|>\n"
                start = len(text)
                text += said + op.END
                if name == speaker and name not in system:
                    spans.append((start, len(text)))
            out[conv, speaker] = (text, spans)
    return out


def test_every_perspective(spark):
    got = op.renderings(op.rotate(spark.createDataFrame(TURNS, SCHEMA))).collect()
    assert {(r["conv_id"], r["speaker"]): (r["text"], [(m["start"], m["end"]) for m in r["masks"]]) for r in got} == plain(TURNS)


def test_rows_have_gapless_positions_and_places(spark):
    rows = op.rotate(spark.createDataFrame(TURNS, SCHEMA).repartition(7)).collect()
    by = {}
    for r in rows:
        by.setdefault((r["conv_id"], r["speaker"]), []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r["position"])
        at = 0
        for k, r in enumerate(own):
            assert (r["position"], r["start"]) == (k, at)
            assert (r["mask_start"] is None) == (r["author"] != "assistant")
            at += len(r["piece"])


def test_a_conversation_of_one_long_run_is_spread(spark):
    turns = [(1, k, "ann" if k % 3 else "bob", "word") for k in range(3000)]
    got = op.renderings(op.rotate(spark.createDataFrame(turns, SCHEMA)))
    assert {(r["conv_id"], r["speaker"]): r["text"] for r in got.collect()} == {k: v[0] for k, v in plain(turns).items()}


def test_empty_tables_and_extra_columns(spark):
    assert op.rotate(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame(TURNS, SCHEMA)
    more = df.selectExpr("*", "1 AS name", "2 AS row", "3 AS part", "4 AS speaker", "5 AS n", "6 AS c")
    key = lambda r: (repr(r["conv_id"]), r["speaker"], r["position"])
    assert sorted(op.rotate(more).collect(), key=key) == sorted(op.rotate(df).collect(), key=key)
