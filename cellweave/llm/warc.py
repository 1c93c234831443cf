"""WARC archives: written in segments with chunked transfer framing, read back by reassembly.

Writing: a page is a response record, or a revisit of the first page of equal payload. A record whose block is
longer than the segment size is cut, at character borders, into a first segment and continuation records; the
last of these has the total length. The files go to a folder that all executors share, written by Spark's text
writer (records end with the line separator CRLF CRLF), so any file system that Spark knows will do.

Reading: records are found by their Content-Length in every file, segments are grouped by origin identifier,
ordered by segment number, checked to be gapless and of the total length, then the HTTP header is cut off and
the chunked framing decoded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import join_hot, scratch_path, table, type_of, written

DATE = "2024-01-01T00:00:00Z"
SEGMENT = 64 * 1024
CHUNK = 8 * 1024
LEAST = 100
FILE_RECORDS = 1000
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
END = "\r\n\r\n"


class WarcError(ValueError):
    """An archive that breaks its own lengths, order or framing."""


def chunked(payload: str, size: int = CHUNK) -> str:
    """Chunked transfer framing; chunks have ``size`` characters, their lengths are in bytes."""
    parts = [payload[k : k + size] for k in range(0, len(payload), size)]
    return "".join(f"{len(p.encode('utf-8')):x}\r\n{p}\r\n" for p in parts) + "0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk size without an end of line")
        try:
            n = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            raise WarcError(f"not a chunk size: {data[at:end][:20]!r}") from None
        if n == 0:
            return b"".join(out)
        if data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise WarcError("chunk without its end")
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def cut(text: str, size: int) -> list[str]:
    """The text in parts of at most ``size`` bytes of UTF-8 (one character at least)."""
    data, out, at = text.encode("utf-8"), [], 0
    while len(data) - at > size:
        end = at + size
        while end > at and data[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # a character longer than the size
            end = at + 1
            while end < len(data) and data[end] & 0xC0 == 0x80:
                end += 1
        out.append(data[at:end].decode("utf-8"))
        at = end
    return [*out, data[at:].decode("utf-8")]


def header(fields: list[tuple[str, object]]) -> str:
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return "WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n"


def records(page: str | None, urn: str, url: str | None, payload: str, digest: str, length: int, refers_to: str | None, segment: int) -> list[str]:
    """The WARC records of one page, without their ends; page is its id as it may stand in a header."""
    own = [("WARC-Record-ID", f"<{urn}>"), ("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha256:{digest}"), *([] if page is None else [("X-Page-ID", page)])]
    if refers_to is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return [header([("WARC-Type", "revisit"), *own, profile, ("WARC-Refers-To", f"<{refers_to}>"), ("X-Payload-Length", length), ("Content-Length", 0)])]
    block = HTTP.decode() + chunked(payload)
    parts = cut(block, segment)
    sizes = [len(p.encode("utf-8")) for p in parts]
    typed = [("WARC-Type", "response"), *own, ("Content-Type", "application/http; msgtype=response")]
    if len(parts) == 1:
        return [header([*typed, ("Content-Length", sizes[0])]) + block]
    out = [header([*typed, ("WARC-Segment-Number", 1), ("Content-Length", sizes[0])]) + parts[0]]
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Segment-Total-Length", sum(sizes))] if k == len(parts) else []
        out.append(header([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{urn}/{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{urn}>"), ("WARC-Segment-Number", k), *more, ("Content-Length", sizes[k - 1])]) + part)
    return out


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> None:
    """Writes one record (in segments) for every row of pages.

    Of pages with equal payloads of at least ``least`` bytes the one with the smallest id is the response
    (nulls last; of repeated rows one), the others revisit it. Only digests are grouped, by partial
    aggregation; a payload moves once, to meet its page's role. Null payloads are empty, ids are percent-encoded
    (a null id has no header), line ends in urls too; an empty table makes archives without records.
    """
    payload = F.coalesce(F.col(text_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha2(payload.cast("binary"), 256).alias("digest"), F.octet_length(payload).alias("n"))
    # Rows are told apart by page and digest, which a recomputed plan gives again; a row number it may not.
    kinds = written(rows.groupBy("page", "digest").agg(F.count(F.lit(1)).alias("m"), F.first("n").alias("n")), "kinds")
    firsts = kinds.where(F.col("n") >= least).groupBy("digest").agg(F.min(F.struct(F.col("page").isNull().alias("none"), "page")).alias("first"), F.count(F.lit(1)).alias("k"), F.sum("m").alias("rows"))
    # A payload that one row has only needs no role.
    firsts = written(firsts.where("rows > 1").drop("rows"), "firsts")
    same = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("page"))
    roles = join_hot(kinds, firsts, "digest", "k", kinds.count(), "left").select(F.col("page").alias("p"), F.col("digest").alias("d"), "m", "n", "first", F.col("first").eqNullSafe(same("page")).alias("lead"))
    roles = written(roles, "roles")
    of_role = lambda roles: rows.drop("n").join(roles, F.col("page").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d"))).drop("p", "d")
    alone, many = F.col("first").isNull() | F.col("lead"), F.col("lead") & (F.col("m") > 1)
    made = of_role(roles).where(~many).select("page", "url", F.when(alone, F.col("payload")).alias("payload"), "digest", "n", "first", alone.alias("response"))
    if roles.where(many).limit(1).count():
        # Repeated rows of the page that leads are one response and revisits of it, which are made from their number.
        repeated = of_role(roles.where(many)).groupBy("page", "digest").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.first("n").alias("n"), F.first("first").alias("first"), F.first("m").alias("m"))
        repeated = repeated.select("page", "url", "payload", "digest", "n", "first", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("i"))
        made = made.union(repeated.select("page", "url", F.when(F.col("i") == 1, F.col("payload")).alias("payload"), "digest", "n", "first", (F.col("i") == 1).alias("response")))
    encoded = lambda page: F.url_encode(page.cast("string"))
    name = lambda page, digest: F.concat(F.when(page.isNull(), F.lit("urn:nopage:")).otherwise(F.concat(F.lit("urn:page:"), encoded(page), F.lit(":"))), digest)
    refers = F.when(F.col("first").isNotNull(), name(F.col("first.page"), F.col("digest")))
    joined = made.select(encoded(F.col("page")).alias("page"), "url", "payload", "digest", "n", refers.alias("refers"), "response")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                # A response that others refer to has the name that they know; all else has one of its own.
                lead = row["response"] and row["refers"] is not None
                urn = row["refers"] if lead else f"urn:uuid:{uuid.uuid4()}"
                made = records(row["page"], urn, row["url"], row["payload"] or "", row["digest"], row["n"], None if row["response"] else row["refers"], segment)
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])

    joined.mapInArrow(run, "value string").write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record of a file, gzip of any number of members or plain."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            out.append(member.decompress(data) + member.flush())
            if not member.eof:
                raise WarcError("compressed file without its end")
            data = member.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise WarcError(f"no record at byte {at}")
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            fields[k.decode("utf-8").strip().lower()] = v.decode("utf-8").strip()
        n = int(fields.get("content-length", "-1"))
        at = end + 4 + n
        if n < 0 or data[at : at + 4] != b"\r\n\r\n":
            raise WarcError(f"record {fields.get('warc-record-id')} is not as long as it says")
        yield fields, data[end + 4 : at]
        at += 4


def whole_block(origin: str, segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a segmented record: numbers 1..n, the last of them with the total length."""
    segments = sorted(segments, key=lambda x: x[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise WarcError(f"{origin} has segments {[s[0] for s in segments][:20]}")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise WarcError(f"{origin} has {len(block)} bytes of {segments[-1][1]}")
    return block


def http_payload(block: bytes) -> bytes:
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        raise WarcError("no end of the HTTP header")
    names = {line.split(b":")[0].strip().lower(): line.partition(b":")[2].strip().lower() for line in head.split(b"\r\n")[1:]}
    return dechunked(body) if names.get(b"transfer-encoding") == b"chunked" else body


SCHEMA = pa.schema([*((x, pa.string()) for x in ("urn", "origin", "type", "page", "digest", "refers")), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary()), ("n", pa.int64())])
RECORD = "urn string, origin string, type string, page string, digest string, refers string, number int, total long, block binary, n long"


def verified(urn: str, payload: bytes, digest: str) -> str:
    own = hashlib.sha256(payload).hexdigest()
    if digest and own != digest:
        raise WarcError(f"the payload of {urn} does not have its digest")
    return own


def row_of(fields: dict[str, str], block: bytes, payloads: bool) -> dict:
    """A record as a row of RECORD: of a whole response n and digest are the payload's; a segment keeps its block."""
    kind, number, total = fields["warc-type"], fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
    urn, refers, length = fields["warc-record-id"].strip("<>"), fields.get("warc-refers-to"), fields.get("x-payload-length")
    row = {"urn": urn, "origin": fields.get("warc-segment-origin-id", urn).strip("<>"), "type": kind, "page": fields.get("x-page-id"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha256:")}
    row |= {"refers": refers.strip("<>") if refers else None, "number": int(number) if number else None, "total": int(total) if total else None, "block": block if number else None, "n": int(length) if length else None}
    if kind == "response" and not number:
        payload = http_payload(block)
        row |= {"n": len(payload), "digest": verified(urn, payload, row["digest"]), "block": payload if payloads else None}
    return row


def read_records(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each record; with ``payloads`` the block of a whole response is its payload, else null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for fields, block in parse_records(data.as_py()):
                    rows.append(row_of(fields, block, payloads))
                    held += len(rows[-1]["block"] or b"")
                    if held > 1 << 23:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, RECORD)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(urn, page, type, payload_digest, payload_bytes, refers, with ``payloads`` also payload): a row for each record, continuations put together.

    page is as it stands in the header. Segments meet by origin: a task holds one record at a time. A revisit states
    length and digest of the record that it refers to; the different statements, one for each such record, are held
    against the responses before anything is returned.
    """
    found = read_records(spark, path, payloads)
    segments = found.where("number IS NOT NULL")

    def join(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        first = next((r for r in rows if r["type"] == "response"), None)
        if first is None:
            raise WarcError(f"{rows[0]['origin']} has no first segment")
        payload = http_payload(whole_block(first["urn"], [(r["number"], r["total"], r["block"]) for r in rows]))
        digest = verified(first["urn"], payload, first["digest"])
        return pa.Table.from_pylist([first | {"n": len(payload), "digest": digest, "block": payload if payloads else None}], SCHEMA)

    whole = found.where("number IS NULL").union(segments.groupBy("origin").applyInArrow(join, RECORD))
    whole = written(whole.select("urn", "page", "type", F.col("digest").alias("payload_digest"), F.col("n").alias("payload_bytes"), "refers", *(["block"] if payloads else [])), "records")
    stated = whole.where("type = 'revisit'").select("refers", "payload_digest", "payload_bytes").distinct()
    responses = whole.where("type = 'response'").select(F.col("urn").alias("refers"), "payload_digest", "payload_bytes")
    if bad := stated.join(responses, ["refers", "payload_digest", "payload_bytes"], "left_anti").select("refers").head(1):
        raise WarcError(f"revisits of {bad[0][0]} without a response of the digest and length that they state")
    return whole.withColumnRenamed("block", "payload")


def op10_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path)
    id_of = lambda c: F.url_decode(c).cast(type_of(pages, "page_id"))
    return back.select(id_of(F.col("page")).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), id_of(refers_page(F.col("refers"))).alias("refers_to"))


def refers_page(refers: Column) -> Column:
    """The encoded id in the name of a response that is referred to; null where it has none."""
    return F.when(refers.startswith("urn:page:"), F.regexp_extract(refers, "^urn:page:([^:]*):", 1))


OP10_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first_id IS NULL OR f.first_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
