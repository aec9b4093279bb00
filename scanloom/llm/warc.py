"""WARC archives of Zstandard frames (operator 9): a writer and a validating reader.

An archive starts with a skippable frame that carries the dictionary; then each
record is one frame. The reader loads the dictionary from there, decodes a frame
per record and checks version, headers, lengths and digests. Archives travel as
rows (archive, content), written as a table to the folder that all executors
share, or read from ``.warc.zst`` files by Spark's binaryFile source; executors
open no paths of their own, so any store that Spark reads will do.

Records with equal payloads of at least ``least`` bytes: the largest page_id is
the response, the others are revisits of it. Defined results: null html is an
empty payload; a null page_id sorts below all others (and is a response if its
payload has no other id); rows that repeat a page are as often written, those
with the largest id all as responses; very long pages are a frame of their own
length; a null url gives no target; an empty table gives no archive and no rows;
other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, small_batches

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ID = "urn:page:"

#: Pages that a dictionary is trained on at most, the bytes that such a page has at most, and the dictionary's size.
SAMPLE, PAGE_BYTES, DICTIONARY = 400, 64 << 10, 32 << 10
ARCHIVE_BYTES = 8 << 20


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of a string's SHA-1, from the hex digits: ten of them are eight of base 32."""
    digits = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digits, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def decided(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for revisits.

    Which page is the response is found on ids and digests alone, which are written; the
    html is shuffled once, by page, so that copies of one page don't meet in a task.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"))
    key = {"none": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0)), "key": F.xxhash64("html")}
    own = own.withColumns(key)
    narrow = cut(own.select(*key, base32_sha1(F.col("html")).alias("digest"), F.octet_length("html").alias("n")))
    known = F.when(~F.col("none"), F.col("id"))
    last = narrow.where(F.col("n") >= least).groupBy("digest").agg(F.max(known).alias("last"), F.count("*").alias("copies"))
    last = last.where("copies > 1 and last is not null").select("digest", "last")
    refers = F.when(F.col("none") | (F.col("id") != F.col("last")), F.col("last"))
    marks = narrow.select(*key, "digest").distinct().join(last, "digest", "left").select(*key, "digest", refers.alias("refers_to"))
    return own.join(marks, list(key)).select("page_id", "url", "html", "digest", "refers_to")


def train(pages: DataFrame, sample: int = SAMPLE, size: int = DICTIONARY) -> bytes:
    """A dictionary from at most ``sample`` pages of at most PAGE_BYTES; empty if they are too few to train on."""
    short = pages.where(F.octet_length("html").between(1, PAGE_BYTES))
    rows = [r[0].encode() for r in short.select("html").limit(sample).collect()]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes() if len(rows) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record: an HTTP response with the payload, or a revisit without it."""
    revisit = refers_to is not None
    block = HTTP if revisit else HTTP + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        head += [("WARC-Refers-To", f"<{ID}{refers_to}>"), ("WARC-Profile", PROFILE)]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode()
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def _opening(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""


def archives(rows: DataFrame, dictionary: bytes, date: str = "2000-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, content): archives of about ``most`` compressed bytes from rows of ``decided``."""
    small_batches(rows.sparkSession)

    def run(batches):
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=3, dict_data=trained, write_content_size=True)
        part, number, frames, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            name = f"part-{part:06d}-{number:05d}.warc.zst"
            content = _opening(dictionary) + b"".join(frames)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                frames.append(press.compress(record(page_id, url, html.encode(), digest, refers_to, date)))
                size += len(frames[-1])
                if size >= most:
                    yield close()
                    number, frames, size = number + 1, [], 0
        if frames:
            yield close()

    return rows.mapInArrow(run, "archive string, content binary")


class BadArchive(ValueError):
    """An archive that isn't as the format has it."""


def split_archive(content: bytes):
    """Yield (offset, record bytes) of an archive, one frame each."""
    pos, dictionary = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) != size:
            raise BadArchive("the dictionary frame is cut short")
        if raw[:4] == ZSTD_MAGIC:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary, pos = zstandard.ZstdCompressionDict(raw), 8 + size
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while pos < len(content):
        start, parts, one = pos, [], unpack.decompressobj()
        if content[pos : pos + 4] != ZSTD_MAGIC:
            raise BadArchive(f"no frame starts at {pos}")
        while not one.eof:
            chunk = content[pos : pos + 16384]
            if not chunk:
                raise BadArchive(f"the frame at {start} is cut short")
            try:
                parts.append(one.decompress(chunk))
            except zstandard.ZstdError as e:
                raise BadArchive(f"the frame at {start}: {e}") from e
            pos += len(chunk)
        pos -= len(one.unused_data)
        yield start, b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, checked."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise BadArchive("not a WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise BadArchive(f"bad header {name!r}")
        headers[name] = value.strip()
    if missing := [n for n in NEEDED if n not in headers]:
        raise BadArchive(f"headers missing: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("the block isn't as long as it says")
    return headers, rest[:-4]


FIELDS = "archive string, at long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def read(rows: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives given as (archive, content); ``payloads=False`` leaves the payload null."""
    small_batches(rows.sparkSession)
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]

    def of(name: str, content: bytes):
        for at, raw in split_archive(content):
            headers, block = parse(raw)
            http, end, payload = block.partition(b"\r\n\r\n")
            kind, digest = headers["WARC-Type"], headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
            if not end or not http.startswith(b"HTTP/"):
                raise BadArchive(f"{name} at {at}: no HTTP headers")
            size, refers = len(payload), None
            if kind == "revisit":
                size = int(headers["X-Payload-Length"])
                refers = int(headers["WARC-Refers-To"][len(ID) + 1 : -1])
            elif digest != base64.b32encode(hashlib.sha1(payload).digest()).decode():
                raise BadArchive(f"{name} at {at}: the payload isn't that of its digest")
            page = headers["WARC-Record-ID"][len(ID) + 1 : -1]
            yield name, at, int(page) if page else None, headers.get("WARC-Target-URI"), kind, size, digest, refers, payload if payloads and kind == "response" else None

    def run(batches):
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[f.split(" ")[1]]) for n, f in zip(names, FIELDS.split(", "), strict=True)])
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, size = [], 0
                for row in of(name, content):
                    held.append(row)
                    size += len(row[-1] or b"")
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return rows.select("archive", "content").mapInArrow(run, FIELDS)


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of ``.warc.zst`` files in any store that Spark reads."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(path)
    return found.select(F.col("path").alias("archive"), "content")


def export(rows: DataFrame, folder: str) -> None:
    """Write archives as files to a folder that is mounted on every executor; a repeated task replaces its files."""

    def run(part):
        for r in part:
            spare = f"{folder}/.{r.archive}.{TaskContext.get().taskAttemptId()}"
            with open(spare, "wb") as f:
                f.write(r.content)
            os.replace(spare, f"{folder}/{r.archive}")

    rows.foreachPartition(run)


def write_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archive every page, then read the archives back; a row per record."""
    return read(cut(archives(decided(pages, least), train(pages))), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


#: DuckDB has no base32; the digest is rebuilt from five-bit groups of the hex digits.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT page_id, octet_length(b) AS n, h, max(page_id) OVER (PARTITION BY h) AS last FROM p),
r AS (SELECT *, list_transform(range(0, 4), lambda k: CAST('0x' || substr(h, CAST(10 * k + 1 AS BIGINT), 10) AS BIGINT)) AS g FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g[i // 8 + 1] >> (5 * (7 - i % 8))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM r
"""
