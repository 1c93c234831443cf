from __future__ import annotations

import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import warc as op

SCHEMA = "page_id long, url string, html string, row long, digest string, page string"


def pages():
    rng = np.random.default_rng(1)
    big = "".join(rng.choice(list("abcé日\r\n<> "), 200_000))
    rows = [(1, "http://a/\r\nx", big), (2, "u", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "y" * 100), (9, "u", "y" * 100), (8, "u", "y" * 99), (10, "u", "y" * 99)]
    rows += [(11, "u", "WARC/1.1\r\n\r\n0\r\n\r\n" * 30), (None, "u", "z" * 200), (12, "u", "z" * 200), (13, "u", "é" * 40_000), (13, "u", "é" * 40_000)]
    rows += [(100 + k, "u", "one page that many copy, with more than a hundred bytes of text in it, so that they are revisits of the first" + "!") for k in range(50)]
    return [(i, u, h, 1, "d", "p") for i, u, h in rows]


def want(rows):
    out, first = Counter(), {}
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        if len(data) >= 100:
            key = (i is None, i)
            first[data] = min(first.get(data, key), key)
    taken = set()
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        lead = len(data) < 100 or first[data] == (i is None, i) and data not in taken
        taken |= {data} if lead else set()
        out[i, len(data), hashlib.sha256(data).hexdigest(), "response" if lead else "revisit", None if lead else first[data][1]] += 1
    return out


@pytest.mark.parametrize("segment", [700, op.SEGMENT])
def test_round_trip(spark, tmp_path, segment):
    path = f"file://{tmp_path}/w"
    op.write_archives(spark.createDataFrame(pages(), SCHEMA).repartition(3), path, segment=segment)
    back = op.read_archives(spark, path, payloads=True).select("*", op.refers_page(F.col("refers")).alias("first")).collect()
    whole = lambda x: None if x is None else int(x)
    got = Counter((whole(r["page"]), r["payload_bytes"], r["payload_digest"], r["type"], whole(r["first"])) for r in back)
    assert got == want(pages())
    texts = Counter(r["payload"].decode() for r in back if r["type"] == "response")
    leads = [h or "" for (i, n, d, kind, _), k in want(pages()).items() for _ in range(k) if kind == "response" for h in [next(p[2] for p in pages() if hashlib.sha256((p[2] or "").encode()).hexdigest() == d)]]
    assert texts == Counter(leads) and all(r["payload"] is None for r in back if r["type"] == "revisit")


def test_ids_of_any_characters_come_back(spark, tmp_path):
    ids = ["", " ", " a ", "a\r\nWARC-Type: revisit", "x:y:z", "%0D", "é日+ %", None, "plain"]
    rows = [(i, "u", f"page {k % 4} " * 30) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(map(tuple, op.op10_warc_reassembly(spark, str(tmp_path)).collect()))
    first = {}
    for i, _, h in rows:
        first[h] = min(first.get(h, (i is None, i or "")), (i is None, i or ""))
    plain = Counter()
    for i, _, h in rows:
        lead = (i is None, i or "") == first[h]
        plain[i, len(h), hashlib.sha256(h.encode()).hexdigest(), "response" if lead else "revisit", None if lead else first[h][1]] += 1
    assert got == plain


def test_revisits_need_their_response(spark, tmp_path):
    own = dict(url="u", payload="", digest="0" * 64, length=5, segment=100)
    (tmp_path / "w").mkdir()
    (tmp_path / "w/part-0").write_bytes((op.records("1", "urn:uuid:1", refers_to="urn:page:2:x", **own)[0] + op.END).encode())
    with pytest.raises(op.WarcError):
        op.read_archives(spark, f"file://{tmp_path}/w")


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    op.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert op.read_archives(spark, path).collect() == []


def test_framing():
    for text in ("", "x", "é日" * 9000):
        assert op.dechunked(op.chunked(text).encode()) == text.encode()
    assert op.dechunked(b"3;ext=1\r\nabc\r\n0\r\n\r\n") == b"abc"
    for bad in (b"zz\r\n", b"3\r\nabcd\r\n0\r\n\r\n", b"3", b"5\r\nabc"):
        with pytest.raises(op.WarcError):
            op.dechunked(bad)
    for size in (1, 2, 3, 5, 100):
        parts = op.cut("aé日😀z" * 5, size)
        assert "".join(parts) == "aé日😀z" * 5 and all(len(p.encode()) <= max(size, 4) for p in parts)


def test_segments_must_be_whole():
    assert op.whole_block("o", [(2, 5, b"de"), (1, None, b"abc")]) == b"abcde"
    for bad in ([(2, 2, b"de")], [(1, None, b"a"), (3, 2, b"b")], [(1, None, b"a"), (2, 9, b"b")], [(1, None, b"a"), (1, 2, b"b")]):
        with pytest.raises(op.WarcError):
            op.whole_block("o", bad)


def test_records_of_any_number_of_gzip_members():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (one * 2, gzip.compress(one * 2), gzip.compress(one) + gzip.compress(one)):
        assert [b for _, b in op.parse_records(data)] == [b"abc", b"abc"]
    for bad in (one[:-6], b"no record", one.replace(b"3", b"4")):
        with pytest.raises(op.WarcError):
            list(op.parse_records(bad))
