"""WARC archives with revisit records, written and read without a local file system.

Writing. Only headers (page_id, url, payload digest, length) are shuffled by digest to find, of records with equal payloads, the one with
the smallest page_id; digests that more than a thousandth of the pages share meet it in a broadcast. Of the pages themselves, only those
that may revisit one are shuffled, by page_id, which no group of copies makes hot. Every record gets fresh
headers and becomes one gzip member. Spark's own text sink writes them, so archives go to any store through its commit protocol
and a lost task leaves nothing behind: the last byte of a gzip member is the top byte of the record's length, zero below
16 MB, so members are written without it and the sink's line separator, a zero byte, puts it back. A longer record is followed by
an empty member, which readers skip. The files are plain .warc.gz data under Spark's part names. A file has as many records as have
FILE_BYTES of payload at the most (one, if that is larger); payloads over LARGE bytes have files of their own, so that a few of them don't make all
files short. There is no warcinfo record, as the sink gives no say in where a file starts.

Reading. Whole files, of FILE_BYTES or one record, are read as bytes, inflated member by member, and each payload is hashed and held
against its record's digest. Revisit records have no payload: their length comes from the original response, to which they are
joined by record id; the digest must be the same there.

Null payloads are empty. Pages without page_id are responses. Rows that repeat page_id and payload are written as often; those with
the smallest page_id of a payload are all responses. A null url leaves out the target header; control characters in it are escaped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common as c

LEAST_BYTES = 0
RECORDS = 20_000
FILE_BYTES = 128 << 20
LARGE = 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def record_id(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def base32_sha1(hexa: str) -> str:
    return base64.b32encode(bytes.fromhex(hexa)).decode()


def _uri(url: str) -> str:
    return quote(url, safe=";/?:@&=+$,#%!~*()[]'")


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, original_url: str | None = None) -> bytes:
    """One record; refers_to and original_url are the page_id and url of the original, for a revisit."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id, sha1)}",
        f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {_uri(url)}"]),
        *([] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"WARC-Refers-To-Date: {DATE}"]),
        *([] if refers_to is None or original_url is None else [f"WARC-Refers-To-Target-URI: {_uri(original_url)}"]),
        f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out = z.compress(data) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY


def members(data: memoryview) -> Iterator[bytes]:
    """The inflated members of a gzip file, one at a time."""
    at = 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            step = data[at : at + 65536]
            if not len(step):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        if any(parts):
            yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no record starts with {lines[0][:40]!r}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"the length of {headers['WARC-Record-ID']} is wrong")
    return headers, rest[:n]


def write(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, records: int = RECORDS) -> None:
    """Writes pages (page_id, url, html) as archives under path."""
    body = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("payload"), F.sha1(body).alias("sha1"))
    heads = pages.select("page_id", "url", "sha1", F.octet_length("payload").cast("long").alias("n"))
    total, most_small, most = heads.agg(F.count("*"), F.max(F.when(F.col("n") <= LARGE, F.col("n"))), F.max("n")).first()
    heads = heads.where(F.col("n") >= least_bytes).select("page_id", "url", "sha1")
    first = heads.where("page_id IS NOT NULL").groupBy("sha1").agg(F.min(F.struct("page_id", "url")).alias("f"), F.max("page_id").alias("last"), F.count("*").alias("copies"))
    first = first.where("f.page_id < last").select("sha1", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("original_url"), "copies")
    again = c.split_join(heads.select("page_id", "sha1"), first, ["sha1"], "copies", total).where("page_id > refers_to")
    tables = c.Tables(pages.sparkSession)
    again = tables.cut(again.select("page_id", "sha1", "refers_to", "original_url").distinct())
    known = c.maybe(pages, again, ["page_id", "sha1"])
    met = known.where("may").drop("may").join(again.hint("merge"), ["page_id", "sha1"], "left").select("page_id", "url", "payload", "sha1", "refers_to", "original_url")
    rows = met.union(known.where("may IS NULL").select("page_id", "url", "payload", "sha1", F.lit(None).cast("long"), F.lit(None).cast("string")))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, size = [], 0
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                out.append(member(record(*row))[:-1])
                size += len(out[-1])
                if size > 4 * c.CHUNK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    large = F.octet_length("payload") > LARGE
    for some, longest in ((~large, most_small), (large, most if (most or 0) > LARGE else None)):
        if longest is not None or (some is not large and not total):
            made = rows.where(some).mapInArrow(make, "value binary").select(F.col("value").cast("string").alias("value"))
            limit = max(1, min(records, FILE_BYTES // max(1, longest or 1)))
            made.write.mode("append").option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", limit).text(path)
    tables.drop(again)


HEADERS = "page_id long, record_type string, record_id string, refers_to string, payload_bytes long, payload_digest string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path, as HEADERS; for revisits payload_bytes is null. Digests that don't fit are an error."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows = []
                for data in members(memoryview(content.as_buffer())):
                    h, block = parse(data)
                    digest, n = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    if h["WARC-Type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        n = len(payload)
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} doesn't fit its digest")
                    page = h.get("X-Page-ID")
                    rows.append((None if page is None else int(page), h["WARC-Type"], h["WARC-Record-ID"], h.get("WARC-Refers-To"), n, digest))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], [x.split()[0] for x in HEADERS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(scan, HEADERS)


def resolve(records: DataFrame, tables: c.Tables) -> DataFrame:
    """A row per record: revisits get length and page_id of their original responses."""
    records = tables.cut(records)
    revisits = records.where("record_type = 'revisit'")
    copies = revisits.groupBy("refers_to").agg(F.count("*").alias("copies"))
    originals = records.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("page_id").alias("original"), F.first("payload_bytes").alias("n"), F.first("payload_digest").alias("digest"))
    originals = tables.cut(originals.join(copies.hint("merge"), "refers_to"))
    met = c.split_join(revisits.drop("payload_bytes"), originals, ["refers_to"], "copies", revisits.count())
    fits = F.when(F.col("digest") == F.col("payload_digest"), F.col("n")).otherwise(F.raise_error(F.lit("a revisit has no original with its digest")).cast("long"))
    plain = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    return plain.union(met.select("page_id", fits.alias("payload_bytes"), "payload_digest", "record_type", F.col("original").alias("refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives into the scratch folder, reads them back and resolves revisits."""
    spark = pages.sparkSession
    path = c.scratch(spark)
    write(pages, path)
    out = resolve(read(spark, path), c.Tables(spark))
    c.remove(spark, path)
    return out


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS x FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS lo FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(x, CAST((5 * i) // 4 + 1 AS INT), 2) AS INT) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = lo THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id > lo THEN lo END AS refers_to
FROM m
"""
