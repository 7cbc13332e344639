"""Operator 5: WARC archives with revisit records resolved by payload digest.

write_archives   headers (no payloads) are grouped by payload digest and each
                 group's response is chosen. The choices, one row per digest
                 that occurs again, are broadcast to the pages while they are
                 within broadcast_bytes, so that no payload is shuffled; beyond
                 that, pages are joined to them by digest.
                 Response records carry the payload, revisit records only a
                 reference. Every record gets fresh headers and its own gzip
                 member.
read_archives    parses the archives by Content-Length, record by record.
resolve          joins revisit records to the responses they refer to.

Files are written by Spark's text writer (raw bytes, committed per task), so
any Hadoop file system will do and a lost executor costs a retry only. The
writer insists on a separator between rows: it gets an empty gzip member,
which every gzip reader skips.

Defined results: a null payload is empty; payloads under min_revisit bytes are
never revisits; of equal payloads the row with the largest id is the response,
and rows that repeat that very id are responses too; a null id is smaller than
any; rows that are equal in id, url and payload have one record id; a payload is
written whole, however long, and files hold so many records that they have about
file_bytes; an empty table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ._shared import map_batches, new_path, stored

EMPTY_MEMBER = zlib.compress(b"", wbits=31)
EOL = "\r\n"
RECORD = (
    "record_id string, record_type string, target_uri string, page_id long, refers_to_id long, "
    "digest string, content_bytes long, payload_ok boolean"
)


def _block(fields: list[tuple[str, str]], length: int) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {length}"]
    return (EOL.join(lines) + EOL + EOL).encode()


def _uuid(*parts: object) -> str:
    x = hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-{x[12:16]}-{x[16:20]}-{x[20:]}>"


def _one_line(text: str | None) -> str:
    return " ".join((text or "").split())


def record(page_id, url, payload: bytes | None, hex_digest: str, refers_to, refers_url, date: str) -> bytes:
    """One record as a gzip member; payload None makes it a revisit."""
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()
    uri = _one_line(url)
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", _uuid(page_id, uri, hex_digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri or "about:blank"),
        ("WARC-Payload-Digest", labelled),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if payload is None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", _uuid(refers_to, _one_line(refers_url), hex_digest)),
            ("WARC-Refers-To-Target-URI", _one_line(refers_url) or "about:blank"),
            ("WARC-Refers-To-Date", date),
            ("X-Refers-To-Page-Id", str(refers_to)),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        body = head + b"\r\n"
    else:
        fields.append(("Content-Type", "application/http; msgtype=response"))
        body = head + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    squeeze = zlib.compressobj(5, zlib.DEFLATED, 31)
    return squeeze.compress(_block(fields, len(body)) + body + b"\r\n\r\n") + squeeze.flush()


def _record_batches(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, urls, digests, refs, refs_urls = (b.column(n).to_pylist() for n in ("page_id", "url", "digest", "refers_to", "refers_url"))
        payloads = b.column("payload")
        out, size = [], 0
        for i, (page_id, url, digest, ref, ref_url) in enumerate(zip(ids, urls, digests, refs, refs_urls)):
            payload = None if ref is not None else (payloads[i].as_py() or b"")
            out.append(record(page_id, url, payload, digest, ref, ref_url, date))
            size += len(out[-1])
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])


def choose_responses(pages: DataFrame, min_revisit: int = 1000, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, payload, digest, refers_to,
    refers_url (null for responses; the payload of a revisit is null)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    heads = rows.where(F.octet_length("payload") >= min_revisit).select("digest", F.struct("page_id", "url").alias("head"))
    firsts = heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("head").alias("head")).where("n > 1")
    firsts = stored(firsts.select("digest", F.col("head.page_id").alias("response_id"), F.col("head.url").alias("response_url")), "responses")
    size = firsts.agg(F.sum(F.coalesce(F.octet_length("response_url"), F.lit(0)) + 60)).first()[0] or 0
    if size <= broadcast_bytes:
        firsts = F.broadcast(firsts)
    joined = rows.join(firsts, "digest", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return joined.select(
        "page_id",
        "url",
        F.when(~revisit, F.col("payload")).alias("payload"),
        "digest",
        F.when(revisit, F.col("response_id")).alias("refers_to"),
        F.when(revisit, F.col("response_url")).alias("refers_url"),
    )


def write_archives(
    pages: DataFrame, path: str, min_revisit: int = 1000, date: str = "2024-01-01T00:00:00Z", file_bytes: int = 128 << 20, broadcast_bytes: int = 32 << 20
) -> None:
    """Write deduplicated archives below path."""
    chosen = choose_responses(pages, min_revisit, broadcast_bytes)
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)))).first()[0] or 0
    rows = map_batches(chosen, lambda it: _record_batches(it, date), "value binary")
    (
        rows.select(F.col("value").cast("string"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", max(1, int(file_bytes / (mean + 1000))))
        .text(path)
    )


def _members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members, empty ones left out."""
    view, at = memoryview(data), 0
    while at < len(view):
        d = zlib.decompressobj(wbits=31)
        parts, took = [], at
        while not d.eof and took < len(view):
            step = view[took : took + (1 << 16)]
            parts.append(d.decompress(step))
            took += len(step)
        if not d.eof:
            raise ValueError("archive ends inside a record")
        at = took - len(d.unused_data)
        if body := b"".join(parts):
            yield body


def _parse(content: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split(EOL)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        length = int(fields["Content-Length"])
        body = content[end + 4 : end + 4 + length]
        at = end + 4 + length + 4
        cut = body.index(b"\r\n\r\n") + 4
        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        kind, page, ref = fields["WARC-Type"], fields.get("X-Page-Id"), fields.get("X-Refers-To-Page-Id")
        if kind == "response":
            ok = hashlib.sha1(memoryview(body)[cut:]).hexdigest() == digest
            size = length - cut
        else:
            ok, size = None, None  # known when it is resolved
        uri = fields["WARC-Target-URI"]
        yield fields["WARC-Record-ID"], kind, uri, page and int(page), ref and int(ref), digest, size, ok


def _archive_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    for b in batches:
        for content in b.column("content"):
            rows = []
            for member in _members(content.as_py()):
                rows += _parse(member)
                if len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below path, digests recomputed."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return map_batches(files, _archive_batches, RECORD)


def resolve(records: DataFrame) -> DataFrame:
    """Revisits get the length of the response payload they refer to, and whether
    that is there and has the digest.

    One response per digest and id is on the other side of the join, and the
    revisits of a very common payload can be split by the skew join."""
    long_ones = (
        records.where("record_type = 'response'")
        .groupBy(F.col("digest"), F.col("page_id").alias("refers_to_id"))
        .agg(F.max("content_bytes").alias("response_bytes"), F.min("payload_ok").alias("response_ok"))
    )
    revisits = records.where("record_type = 'revisit'").join(long_ones, ["digest", "refers_to_id"], "left")
    kept = ["record_id", "page_id", "target_uri", "record_type", "digest"]
    return (
        records.where("record_type = 'response'")
        .select(*kept, "payload_ok", F.col("content_bytes").alias("payload_bytes"), F.lit(None).cast("long").alias("refers_to_id"))
        .unionByName(revisits.select(*kept, F.coalesce("response_ok", F.lit(False)).alias("payload_ok"), F.col("response_bytes").alias("payload_bytes"), "refers_to_id"))
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back; one row per page."""
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    out = resolve(read_archives(spark, path))
    return out.select(
        "page_id",
        "payload_bytes",
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.col("refers_to_id").alias("refers_to"),
        "payload_ok",
    )


#: DuckDB for op5_warc.
SQL5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to,
       true AS payload_ok
FROM m
"""
