"""WARC archives with an index first: offset, length, URL and digest per record, then coalesced byte-range reads.

Writing: record types are decided from digests alone (partial aggregation, salted join back), each task streams its
pages into archives of its own in the shared folder, one gzip member a record, and returns one index row a record.
The index is written as a table before anything is read, which cuts the lineage: a task that runs again writes files
of other names, and only those of the attempt whose index rows were committed are ever read.

Reading: index rows are dealt by (archive, section of `section` bytes), so that no archive is one task's alone, are
sorted by offset, and neighbours no more than `gap` bytes apart are fetched by one range read of at most `span` bytes.

Cases: a null html is an empty payload. Of records with equal payloads of at least min_bytes bytes, that of the
smallest page_id is the response (rows that repeat that page_id are responses too) and the others are revisits of it;
smaller payloads are responses all. A null page_id never is the smallest unless all are null; a null url is written
as an empty target. Very long payloads are held one at a time. An empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm import common

INDEX_SCHEMA = (
    "archive string, offset long, length long, page_id long, url string, payload_digest string, "
    "payload_bytes long, record_type string, refers_to long"
)
READ_SCHEMA = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
)
RECORD_DATE = "1970-01-01T00:00:00Z"  # pages carry no time of capture; a fixed date keeps archives reproducible


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_types(pages: DataFrame, min_bytes: int, salts: int = 32) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): a payload's smallest page_id is its response.

    Digests are counted on narrow rows. Only rows whose digest may be a repeated one (by a key filter) are joined with
    its smallest page_id, a hot digest's rows being spread over `salts` tasks; all others pass by and are not shuffled.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("sha1", F.sha1("payload"))
    repeated = (
        rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("sha1", "first")
    )
    repeated = common.materialize(repeated, "repeated")
    marked = common.flagged(rows, "sha1", common.key_filter(repeated, "sha1"), "maybe")
    joined = common.salted_lookup(marked.filter("maybe"), repeated, "sha1", "page_id", salts=salts)
    own = F.col("first").isNull() | F.col("first").eqNullSafe(F.col("page_id"))
    columns = ["page_id", "url", "payload"]
    found = joined.select(*columns, F.when(own, "response").otherwise("revisit").alias("record_type"), F.when(~own, F.col("first")).alias("refers_to"))
    return found.unionByName(marked.filter("NOT maybe").select(*columns, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")))


def _record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One record: a revisit has headers alone, and says how long the payload is that it refers to."""
    body = payload if kind == "response" else b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {RECORD_DATE}", f"WARC-Target-URI: {(url or '').translate({13: '%0D', 10: '%0A'})}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    if url is None:
        lines.append("X-Target-URI-Missing: 1")
    lines.append(f"Content-Length: {len(http) + len(body)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + body + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(typed: DataFrame, folder: str, max_archive_bytes: int = 256 << 20, level: int = 1) -> DataFrame:
    """Write record_types() rows as .warc.gz archives below folder; the index rows, not yet persisted."""
    schema = _arrow(INDEX_SCHEMA)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        out = name = None
        offset = 0
        try:
            for batch in common.slices(batches, "payload"):
                rows = []
                for r in batch.to_pylist():
                    if out is None or offset >= max_archive_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        fs.create_dir(base, recursive=True)
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    digest = base32_sha1(r["payload"])
                    data = _gzip(_record(r["page_id"], r["url"], r["payload"], digest, r["record_type"], r["refers_to"]), level)
                    out.write(data)
                    rows.append({
                        "archive": name, "offset": offset, "length": len(data), "page_id": r["page_id"], "url": r["url"],
                        "payload_digest": digest, "payload_bytes": len(r["payload"]), "record_type": r["record_type"],
                        "refers_to": r["refers_to"],
                    })
                    offset += len(data)
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
        finally:
            if out is not None:
                out.close()

    return typed.mapInArrow(write, INDEX_SCHEMA)


def parse_record(data: bytes) -> dict:
    """What one uncompressed record says of itself, its payload's length and digest taken anew from a response's bytes."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    of = lambda urn: int(n) if (n := urn[len("<urn:page:"):-1]) else None
    kind = fields["WARC-Type"]
    if kind == "response":
        n_bytes, digest = len(payload), base32_sha1(payload)
        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
            raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match its payload")
    else:
        n_bytes = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    return {
        "page_id": of(fields["WARC-Record-ID"]),
        "url": None if "X-Target-URI-Missing" in fields else fields["WARC-Target-URI"],
        "payload_bytes": n_bytes, "payload_digest": digest, "record_type": kind,
        "refers_to": of(fields["WARC-Refers-To"]) if kind == "revisit" else None,
        "payload": payload if kind == "response" else None,
    }


def coalesced(ranges: list[tuple[int, int]], gap: int, span: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """Sorted (offset, length) pairs as (start, length, members) reads: neighbours within gap share one, up to span bytes."""
    reads: list[tuple[int, int, list[tuple[int, int]]]] = []
    for offset, length in ranges:
        if reads and offset - (reads[-1][0] + reads[-1][1]) <= gap and offset + length - reads[-1][0] <= span:
            start, held, members = reads[-1]
            members.append((offset, length))
            reads[-1] = (start, max(held, offset + length - start), members)
        else:
            reads.append((offset, length, [(offset, length)]))
    return reads


def read_records(
    index: DataFrame, folder: str, *, section: int = 16 << 20, gap: int = 64 << 10, span: int = 4 << 20, payloads: bool = True,
) -> DataFrame:
    """The records that the given index rows select, read from the archives by byte ranges."""
    schema = _arrow(READ_SCHEMA)
    parts = common.shuffle_partitions(index.sparkSession)
    keyed = index.select("archive", F.floor(F.col("offset") / section).cast("long").alias("section"), "offset", "length")
    dealt = keyed.repartition(parts, "archive", "section").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = common.filesystem(folder)
        for batch in batches:
            rows = batch.to_pylist()
            start = 0
            while start < len(rows):
                end = start
                while end < len(rows) and rows[end]["archive"] == rows[start]["archive"]:
                    end += 1
                with fs.open_input_file(f"{base}/{rows[start]['archive']}") as file:
                    for at, length, members in coalesced([(r["offset"], r["length"]) for r in rows[start:end]], gap, span):
                        data = file.read_at(length, at)
                        found = [parse_record(zlib.decompress(data[o - at : o - at + n], 31)) for o, n in members]
                        if not payloads:
                            for r in found:
                                r["payload"] = None
                        yield pa.RecordBatch.from_pylist(found, schema=schema)
                start = end

    return dealt.mapInArrow(read, READ_SCHEMA)


def archive_pages(spark: SparkSession, pages: DataFrame, *, min_bytes: int = 0, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write every page; (the persisted index, the archives' folder)."""
    folder = folder or common.shared_path(spark, "warc")
    return common.materialize(write_archives(record_types(pages, min_bytes), folder), "warc-index"), folder


def op10_warc(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    index, folder = archive_pages(spark, pages, min_bytes=0)
    return read_records(index, folder, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url",
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
d AS (
  SELECT page_id, url, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, first,
         list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(1 + 5 * i AS INT), 5) AS BIGINT)) AS fives
  FROM p JOIN f ON p.html = f.html)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(fives, lambda v:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v >> 15) AS INT), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> 10) & 31) AS INT), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((v >> 5) & 31) AS INT), 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (v & 31) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM d
"""
