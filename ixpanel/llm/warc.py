"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing: each page's payload is sent as an HTTP response in chunked framing. Blocks of
more than SEGMENT bytes become a first segment and continuation records, which name
their origin, carry a segment number and, in the last one, the total length. Of pages
with equal payloads one is a response, the others are revisits that refer to it. The
archives are the files of Spark's text writer, whose line end is the blank line that
closes a record; so any store Spark writes to will do, and a lost task writes again.

Reading: files are parsed record by record, by their content lengths. Continuations
are grouped by their origin and ordered by segment number; a record counts only if its
segments are complete, in number and total length. Then the chunked framing is
decoded. A group is one record, never more than one page.

Defined results: a null html is an empty payload; equal payloads share the response
with the largest page_id (a null one is the smallest); rows that repeat that page_id
are responses, too, and the revisits refer to one of them; every record has an id of its
own, made of its row's number, so ``pages`` must give its rows in the same order each time
it is read, as files and checkpoints do; an empty table gives an empty archive and no records. A broken
record has a null payload and an entry in ``problem``.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ixpanel.llm.common import cut, field_of, prepare, table
from ixpanel.session import remove_scratch, scratch_path

SEGMENT = 32 * 1024        # bytes of a record's block
CHUNK = 8 * 1024           # bytes of an HTTP chunk
MIN_REVISIT = 0            # bytes from which on equal payloads are revisits
RECORDS_PER_FILE = 4000
CLOSE = "\r\n\r\n"         # after each record


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[k:k + size] for k in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunk without its end")
        out.append(body[at:at + size])
        at += size + 2


def _record(kind: str, name: str, block: bytes, **fields) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    head += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block


def _name(*parts) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr(parts))}"


def records(page_id, url, payload: bytes, response_id, segment: int, row: int | None = None):
    """The records of one page; response_id: that of its response; row: the row's number, None for
    the response that revisits refer to."""
    sha = digest(payload)
    kind = "response" if page_id == response_id else "revisit"
    name = _name(kind, page_id, sha, *(() if row is None else (row,)))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    url = None if url is None else "".join(c for c in url if c >= " " and c != "\x7f")
    common = {"WARC_Target_URI": url, "X_Page_ID": page_id, "WARC_Payload_Digest": f"sha1:{sha}",
              "Content_Type": "application/http; msgtype=response"}
    if kind == "revisit":
        yield _record("revisit", name, head, WARC_Refers_To=f"<{_name('response', response_id, sha)}>",
                      WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", **common)
        return
    block = head + chunked(payload)
    if len(block) <= segment:
        yield _record("response", name, block, **common)
        return
    yield _record("response", name, block[:segment], WARC_Segment_Number=1, **common)
    last = (len(block) - 1) // segment
    for k in range(1, last + 1):
        yield _record("continuation", _name(name, k), block[k * segment:(k + 1) * segment], WARC_Segment_Number=k + 1,
                      WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Total_Length=len(block) if k == last else None)


def write(pages: DataFrame, path: str, segment: int = SEGMENT, min_revisit: int = MIN_REVISIT) -> None:
    """Writes ``pages`` (page_id, url, html) as archives in the folder ``path``."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"),
                        F.monotonically_increasing_id().alias("row")).withColumn(
        "same", F.sha2(F.col("html").cast("binary"), 256))
    # One of the rows with the largest page_id is the response that the revisits refer to.
    responses = cut(rows.select("same", F.octet_length("html").alias("n"), "page_id", "row").where(
        F.col("n") >= min_revisit).groupBy("same").agg(
            F.max("page_id").alias("response_id"), F.count("*").alias("copies"),
            F.coalesce(F.max_by("row", "page_id"), F.min("row")).alias("response_row"))
                    .where("copies > 1").select("same", "response_id", "response_row"))
    alone = F.col("response_row").isNull() & (F.octet_length("html") >= min_revisit)
    rows = rows.join(responses, "same", "left").select(
        "page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"),
        F.coalesce("response_id", "page_id").alias("response_id"),
        F.when(~alone & ~F.col("row").eqNullSafe(F.col("response_row")), F.col("row")).alias("row"))

    def run(batches):
        for b in batches:
            out = [r for *page, row in zip(*(b.column(k).to_pylist() for k in range(5)))
                   for r in records(*page, segment, row)]
            for k in range(0, len(out), 500):
                yield pa.RecordBatch.from_arrays([pa.array(out[k:k + 500], pa.binary())], ["record"])

    prepare(pages.sparkSession)
    (rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
     .write.option("lineSep", CLOSE).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE)
     .text(path))


PARSED = ("kind string, name string, page string, origin string, segment int, total long, refers_to string, "
          "digest string, block binary, problem string")
_FIELDS = ["kind", "name", "page", "origin", "segment", "total", "refers_to", "digest", "block", "problem"]
_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(),
          pa.binary(), pa.string()]


def parse(data: bytes):
    """The records of one archive; a broken end gives one row that names the problem."""
    import zlib

    if data[:2] == b"\x1f\x8b":             # one gzip member, or one for each record
        out = []
        while data:
            d = zlib.decompressobj(31)
            out.append(d.decompress(data))
            data = d.unused_data
        data = b"".join(out)
    at = 0
    close = CLOSE.encode()
    while at < len(data):
        try:
            end = data.index(close, at)
            lines = data[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no record begins here")
            h = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
            size = int(h["content-length"])
            block = data[end + 4:end + 4 + size]
            if len(block) < size or data[end + 4 + size:end + 8 + size] != close:
                raise ValueError("the block doesn't end where its length says")
            number = lambda k: int(h[k]) if k in h else None
            bare = lambda k: h[k].strip("<>") if k in h else None
            yield (h["warc-type"], bare("warc-record-id"), h.get("x-page-id"), bare("warc-segment-origin-id"),
                   number("warc-segment-number"), number("warc-segment-total-length"), bare("warc-refers-to"),
                   h.get("warc-payload-digest", "").removeprefix("sha1:"), block, None)
        except (ValueError, KeyError) as e:
            yield (None,) * 9 + (f"byte {at}: {e!r}",)
            return
        at = end + 8 + size


def _parse(batches):
    for b in batches:
        for data in b.column(0):
            rows, size = [], 0
            for r in parse(data.as_py()):
                rows.append(r)
                size += len(r[8] or b"")
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _FIELDS)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _FIELDS)


def _whole(batches):
    """Segments in order, joined, checked and freed of their framing."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            segments = sorted(r.pop("segments"), key=lambda s: s["segment"] or 1)
            problem, payload = r["problem"], None
            if problem is None and r["kind"] is None:
                problem = "continuations without an origin"
            if problem is None:
                block = b"".join(s["block"] for s in segments)
                total = max((s["total"] for s in segments if s["total"] is not None), default=None)
                numbered = segments[0]["segment"] is not None
                if numbered and ([s["segment"] for s in segments] != list(range(1, len(segments) + 1))
                                 or total != len(block)):
                    problem = "segments are missing, repeated, or not of the total length"
                elif r["kind"] == "response":
                    try:
                        head, body = block.split(b"\r\n\r\n", 1)
                        coded = b"transfer-encoding: chunked" in head.lower()
                        payload = unchunked(body) if coded else body
                        if r["digest"] and digest(payload) != r["digest"]:
                            problem, payload = "the payload hasn't its digest", None
                    except ValueError as e:
                        problem = f"framing: {e!r}"
            rows.append((r["name"], r["kind"], r["page"], r["refers_to"], r["digest"], payload, problem))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string()))],
            ["name", "kind", "page", "refers_to", "digest", "payload", "problem"]) if rows else b.slice(0, 0).select([])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives in ``path``, segments joined: name, kind (response, revisit),
    page (its number as text), refers_to, digest, payload and problem."""
    prepare(spark)
    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, PARSED)
    one = parsed.where("segment is null").select(
        *(c for c in _FIELDS if c not in ("origin", "segment", "total", "block")),
        F.array(F.struct("segment", "total", "block")).alias("segments"))
    first = F.col("kind") != "continuation"
    many = parsed.where("segment is not null").groupBy(F.coalesce("origin", "name").alias("name")).agg(
        *(F.max(F.when(first, F.col(c))).alias(c) for c in ("kind", "page", "refers_to", "digest", "problem")),
        F.collect_list(F.struct("segment", "total", "block")).alias("segments"))
    every = one.unionByName(many.select(one.columns))
    return every.mapInArrow(_whole, "name string, kind string, page string, refers_to string, digest string, "
                                    "payload binary, problem string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write(pages, path)
    kind = pages.schema["page_id"].dataType
    found = cut(read(spark, path).select("name", "kind", F.col("page").cast(kind).alias("page_id"), "refers_to",
                                         "digest", F.octet_length("payload").cast("long").alias("bytes")))
    remove_scratch(spark, path)
    own = found.where("kind = 'response'").select(
        F.col("name").alias("of"), F.col("page_id").alias("of_page"), F.col("bytes").alias("of_bytes")).distinct()
    return found.join(own, (F.col("refers_to") == F.col("of")), "left").select(
        "page_id", F.coalesce("bytes", "of_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("of_page").alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT html, max(page_id) AS response_id FROM p GROUP BY html),
bits AS (SELECT page_id, html, h, string_agg(lpad(bin(CAST('0x' || h[i:i] AS INTEGER)), 4, '0'), '' ORDER BY i) AS b
  FROM (SELECT *, unnest(range(1, 41)) AS i FROM p) GROUP BY ALL),
coded AS (SELECT page_id, html, string_agg('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[v + 1:v + 1], '' ORDER BY k) AS d
  FROM (SELECT page_id, html, k, list_sum(list_transform(range(5), lambda x:
      CAST(b[5 * k + x + 1:5 * k + x + 1] AS INTEGER) * CAST(pow(2, 4 - x) AS INTEGER))) AS v
    FROM (SELECT *, unnest(range(32)) AS k FROM bits)) GROUP BY page_id, html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = response_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = response_id THEN NULL ELSE response_id END AS refers_to
FROM coded JOIN r USING (html)
"""
