"""WARC archives with revisit records.

``resolve_revisits`` shuffles headers alone (digest, id) to find the first record of each payload. What it finds is
broadcast to the pages where its measured size allows, so that no page is shuffled; beyond that pages are joined by
digest, those of very common digests apart. ``write_archives`` writes records with fresh headers, a gzip member each;
``read_archives`` reads any such archive by its Content-Length fields, whoever wrote it; ``payload_facts`` resolves
revisit records to the response they refer to.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_dir, small_batches, utf8

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: An empty gzip member. It stands between two records, so that Spark's text writer, which needs a
#: separator, makes a valid multi-member archive.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000030300" + "00" * 8)
#: What is looked up is broadcast up to so many bytes; beyond, keys of more rows than this are, at most so many of them.
BROADCAST_BYTES, HOT_ROWS, HOT_KEYS = 32 << 20, 1 << 16, 10_000
#: Compressed bytes and records of an archive file; a record larger than that has a file of its own.
FILE_BYTES, FILE_RECORDS = 32 << 20, 4096
RECORD = "page_id long, record_type string, refers_to long, uri string, header_digest string, payload binary, record_id string, refers_to_id string"


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` left-joined to ``table`` by its columns ``k_*``; ``n`` tells how many rows have a key, which is there once.

    A small table is broadcast, as measured; else only its most common keys are, so that no task gets all their rows.
    """
    table = cut(table)
    size = table.agg(F.sum(F.octet_length(F.concat_ws("", *table.columns)) + 64)).first()[0] or 0
    on = lambda t: [rows[k] == t[f"k_{k}"] for k in keys]
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on(table), "left")
    hot = cut(table.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(HOT_KEYS))
    first = rows.join(F.broadcast(hot), on(hot))
    rest = rows.join(F.broadcast(hot), on(hot), "left_anti")
    return first.unionByName(rest.join(table, [rest[k] == table[f"k_{k}"] for k in keys], "left"))


def resolve_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """``page_id, url, payload, payload_digest, record_type, refers_to, refers_uri`` for rows of (page_id, url, html).

    Null html: empty payload. Payloads under ``min_bytes`` are responses. Of equal payloads the smallest
    page_id is the response; rows that repeat this very page_id are responses too; a null page_id is a
    revisit unless no row of its payload has an id. Other columns are left out, whatever their names. No rows: no rows.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), utf8(F.col("html")).alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256))
    firsts = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy(F.col("payload_digest").alias("k_payload_digest"))
        .agg(F.min_by(F.struct("page_id", "url"), F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("k_payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "n")
    )
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return looked_up(rows, firsts, ["payload_digest"]).select(
        "page_id",
        "url",
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(revisit, F.col("first_url")).alias("refers_uri"),
    )


def _line(value: str | None) -> str:
    """A header value that cannot end its line."""
    return "urn:unknown" if value is None else "".join(c if c >= " " else f"%{ord(c):02X}" for c in value)


def _record(page_id, url, payload, digest, kind, refers_to, refers_uri) -> bytes:
    if kind == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        more = ""
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        more = f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: <urn:page:{refers_to}>\r\nWARC-Refers-To-Target-URI: {_line(refers_uri)}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\n"
        f"WARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: {_line(url)}\r\n{more}WARC-Payload-Digest: sha256:{digest}\r\n"
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 1, mtime=0)


def _bundles(most: int):
    """Records of a task's rows, so many to a file, each a gzip member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        bundle = lambda: pa.RecordBatch.from_arrays([pa.array([EMPTY_MEMBER.join(held)], pa.binary())], ["members"])
        for b in batches:
            for k in range(b.num_rows):
                member = _record(*(c[k].as_py() for c in b.columns))
                if held and (len(held) >= most or size + len(member) > FILE_BYTES):
                    yield bundle()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield bundle()

    return run


def write_archives(resolved: DataFrame, path: str, records_per_file: int = FILE_RECORDS) -> str:
    """Write ``resolve_revisits``'s rows as gzipped WARC files under ``path``: a member for each record."""
    small_batches(resolved.sparkSession)
    (
        resolved.mapInArrow(_bundles(records_per_file), "members binary")
        .select(F.col("members").cast("string"))
        .write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
        .option("encoding", "ISO-8859-1")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )
    return path


def _unzipped(content: memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of each gzip member, whatever the members hold."""
    at, z, parts = 0, zlib.decompressobj(31), []
    while at < len(content):
        part = content[at : at + step]
        parts.append(z.decompress(part))
        at += len(part)
        if z.eof:
            at -= len(z.unused_data)
            if member := b"".join(parts):
                yield member
            z, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends within a record")


def _page(identifier: str) -> int | None:
    """The page's id of a record id of ours; that of another writer has none."""
    number = identifier.removeprefix("urn:page:")
    return int(number) if number != identifier and number.lstrip("-").isdecimal() else None


def parse_records(content) -> Iterator[tuple]:
    """Of each record of one archive file, zipped or not, a row of ``RECORD``; only responses have payloads.

    Record ids are kept as they stand, without their brackets; ``page_id`` and ``refers_to`` are null unless ours.
    """
    content = memoryview(content)
    for data in _unzipped(content) if bytes(content[:2]) == b"\x1f\x8b" else [bytes(content)]:
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError("no WARC record here")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(head["content-length"])
            block = data[end + 4 : end + 4 + n]
            at = end + 8 + n
            kind, own, other = head["warc-type"], *(head.get(k, "").removeprefix("<").removesuffix(">") for k in ("warc-record-id", "warc-refers-to"))
            http = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
            payload = block[http:] if kind == "response" else None
            yield _page(own), kind, _page(other), head.get("warc-target-uri"), head.get("warc-payload-digest", "").removeprefix("sha256:"), payload, own, other or None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(x.strip().split() for x in RECORD.split(",")), strict=True)
    types = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], list(names))

    for b in batches:
        for content in b.column(0):
            rows, held = [], 0
            for r in parse_records(content.as_buffer()):
                rows.append(r)
                held += len(r[5] or b"")
                if len(rows) >= 512 or held > 1 << 23:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``; a batch holds no more files than a scan's task."""
    small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, RECORD)


def payload_facts(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each response and revisit.

    Length and digest are those of the full payload, a revisit's from the response that its header names by id and digest;
    null where there is none. Only headers are shuffled.
    """
    rows = records.select("page_id", "record_type", "refers_to", "record_id", "refers_to_id", "header_digest", F.octet_length("payload").cast("long").alias("own_bytes"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("own_digest"))
    rows = cut(rows.where(F.col("record_type").isin("response", "revisit")))
    revisits = rows.where("record_type = 'revisit'")
    named = revisits.groupBy(F.col("refers_to_id").alias("k_refers_to_id"), F.col("header_digest").alias("k_header_digest")).agg(F.count("*").alias("n"))
    originals = (
        rows.where("record_type = 'response'").groupBy("record_id", "header_digest").agg(F.min(F.struct("own_bytes", "own_digest")).alias("o"))
        .join(named, (F.col("record_id") == F.col("k_refers_to_id")) & (F.col("header_digest") == F.col("k_header_digest")))
        .select("k_refers_to_id", "k_header_digest", F.col("o.own_bytes").alias("o_bytes"), F.col("o.own_digest").alias("o_digest"), "n")
    )
    found = looked_up(revisits, originals, ["refers_to_id", "header_digest"])
    columns = lambda size, digest: ("page_id", F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", "refers_to")
    return rows.where("record_type = 'response'").select(*columns("own_bytes", "own_digest")).unionByName(found.select(*columns("o_bytes", "o_digest")))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, revisits resolved, and what the archives say of it, read back."""
    path = write_archives(resolve_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet")), new_dir(spark, "warc"))
    return payload_facts(read_archives(spark, path))


ORACLE = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
