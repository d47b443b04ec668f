"""WARC archives: write, normalise monolithic gzip to a member per record with offset index, read.

1. ``revisits`` groups narrow (digest, length) rows; equal payloads keep one response, the one with the
   largest page id, and the others become revisits of it. A hot payload's rows are salted.
2. ``write_monolithic`` writes archives whose records share a single gzip stream (the form that
   ``gzip file.warc`` leaves), rolled at ``ROLL_BYTES``. Pages whose payload no other page has are
   written from the scan; a Bloom filter of digests finds the rest, which alone meet ``revisits``.
3. ``normalise`` inflates each whole-file stream once, in pieces, rewrites every record as its own
   gzip member and writes a sidecar ``.idx``: offset, length, type, page and digest per line.
4. ``read_archives`` seeks to the members by the sidecars, parses them and verifies the digests.

Files go to a shared folder through its URI, under names that hold the task attempt; only files in
the manifest of a committed stage count, so retries and lost executors leave nothing wrong behind.
Memory of a task: one record and one buffer.

Defined results: null html is an empty payload, a null url leaves the header out. A null page id
refers to, but is never referred to; such rows are responses if no other row has their payload.
Rows that repeat the largest page id are all responses. An empty table gives no archive and no rows.
A very long page is one record in memory. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bloom
from tracefold.llm.common import fresh_dir, materialise, pieces, salted_join, table

ROLL_BYTES = 64 << 20
READ_BYTES = 1 << 20
LEVEL = 6
MAX_TASKS = 20_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, n_records long"
INDEX = "archive string, offset long, length long, record_type string, page_id long, digest string"
RECORDS = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _pages(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))


def revisits(rows: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page_id, sha1, refers_to) of payloads that another page responds with, and the (sha1, n) that several rows have."""
    narrow = materialise(rows.select("page_id", "sha1", F.octet_length("html").alias("size")).filter(F.col("size") >= min_bytes).drop("size"), "warc-digests")
    held = narrow.groupBy("sha1").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1 AND last IS NOT NULL")
    classes = materialise(held, "warc-classes")
    found = salted_join(narrow, classes, "sha1", narrow.count(), "page_id").filter("page_id IS NULL OR page_id < last")
    return materialise(found.select("page_id", "sha1", F.col("last").alias("refers_to")).distinct(), "warc-revisits"), classes


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def build_record(page_id: int | None, url: str | None, html: str, refers_to: int | None) -> bytes:
    payload = html.encode("utf-8", "surrogatepass")
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        # header values are one line: control characters are percent-encoded
        lines.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not mark or not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {raw[:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('warc-record-id')} is cut or runs over its length")
    return headers, rest[:n]


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream that arrives in pieces."""
    buffer, need = bytearray(), 0
    for piece in pieces:
        buffer += piece
        while len(buffer) >= max(need, 1):
            if not need:
                end = buffer.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = [x for x in bytes(buffer[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:")]
                if not length:
                    raise ValueError("a record has no Content-Length")
                need = end + 4 + int(length[0].split(b":")[1]) + 4
                continue
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer:
        raise ValueError(f"the stream ends within a record ({len(buffer)} bytes left)")


def inflate(source) -> Iterator[bytes]:
    """Pieces of a gzip file, of one member or many; none is over ``READ_BYTES``, however well it is packed."""
    member = zlib.decompressobj(31)
    while data := source.read(READ_BYTES):
        while data:
            if member.eof:
                member = zlib.decompressobj(31)
            yield member.decompress(data, READ_BYTES)
            data = member.unused_data if member.eof else member.unconsumed_tail
    if not member.eof:
        raise ValueError("the gzip stream is cut")


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _name(number: int) -> str:
    task = TaskContext.get()
    return f"records-{task.partitionId():05d}-{task.taskAttemptId()}-{number:03d}"


def _picked(batches: Iterator[pa.RecordBatch], packed: bytes, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose hash (column 0) may be in a filter, or those whose hash is surely not."""
    for batch in batches:
        hit = bloom.holds(packed, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        yield batch.filter(pa.array(hit if inside else ~hit))


def _repeated(shared):
    return lambda batches: _picked(batches, shared.value, True)


def _write_monolithic(folder: str, shared=None):
    """Writes rows of (hash, page_id, url, html, refers_to); with a filter ``shared`` only those that it surely lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        out = squeeze = None
        number = written = n = 0
        name = ""

        def close() -> pa.RecordBatch:
            out.write(squeeze.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

        for batch in pieces(_picked(batches, shared.value, False) if shared else batches):
            for _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name = f"{_name(number)}.warc.gz"
                    out, squeeze = store.open_output_stream(f"{base}/{name}", compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                    number, written, n = number + 1, 0, 0
                record = build_record(*row)
                out.write(squeeze.compress(record))
                written, n = written + len(record), n + 1
                if written >= ROLL_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_monolithic(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Manifest of the archives written under ``folder``, each a single gzip stream."""
    spark = pages.sparkSession
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    rows = _pages(pages)
    again, classes = revisits(rows, min_bytes)
    shared = spark.sparkContext.broadcast(bloom.build(classes.select(F.xxhash64("sha1").alias("h")), classes.count()))
    hashed = rows.select(F.xxhash64("sha1").alias("h"), "page_id", "url", "html", "sha1")
    columns = ["h", "page_id", "url", "html"]
    once = hashed.select(*columns, F.lit(None).cast("long").alias("refers_to")).mapInArrow(_write_monolithic(folder, shared), MANIFEST)
    side = again.select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "refers_to")
    joined = hashed.mapInArrow(_repeated(shared), hashed.schema).join(side, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left")
    return materialise(once.unionByName(joined.select(*columns, "refers_to").mapInArrow(_write_monolithic(folder), MANIFEST)), "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """Archives one to a partition, up to ``MAX_TASKS``."""
    return manifest.select("archive").repartition(min(MAX_TASKS, max(1, manifest.count())))


def _normalise(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                source_store, source_path = _open(archive)
                store, base = _open(folder)
                name, number = f"{_name(number)}.warc.gz", number + 1
                offset = n = 0
                with source_store.open_input_stream(source_path, compression=None) as source, store.open_output_stream(f"{base}/{name}", compression=None) as out, store.open_output_stream(f"{base}/{name}.idx", compression=None) as index:
                    for record in split_records(inflate(source)):
                        headers, _ = parse_record(record)
                        squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = squeeze.compress(record) + squeeze.flush()
                        out.write(member)
                        page = headers.get("x-page-id")
                        line = {"offset": offset, "length": len(member), "type": headers["warc-type"], "page_id": None if page is None else int(page), "digest": headers["warc-payload-digest"].removeprefix("sha1:")}
                        index.write(json.dumps(line).encode() + b"\n")
                        offset, n = offset + len(member), n + 1
                yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": pa.array([n], pa.int64())})

    return run


def normalise(manifest: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Manifest of the archives rewritten under ``folder`` with a gzip member per record; each has ``.idx``."""
    store, base = _open(folder)
    store.create_dir(base, recursive=True)
    return materialise(_spread(manifest).mapInArrow(_normalise(folder, level), MANIFEST), "warc-manifest")


def _sidecar(archive: str) -> list[dict]:
    store, path = _open(archive)
    with store.open_input_stream(f"{path}.idx", compression=None) as f:
        return [json.loads(x) for x in f.read().splitlines()]


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            lines = _sidecar(archive)
            yield pa.RecordBatch.from_pydict({
                "archive": [archive] * len(lines), "offset": pa.array([x["offset"] for x in lines], pa.int64()), "length": pa.array([x["length"] for x in lines], pa.int64()),
                "record_type": pa.array([x["type"] for x in lines], pa.string()), "page_id": pa.array([x["page_id"] for x in lines], pa.int64()), "digest": pa.array([x["digest"] for x in lines], pa.string()),
            })


def offset_index(manifest: DataFrame) -> DataFrame:
    """Rows of all sidecars."""
    return manifest.select("archive").mapInArrow(_index_rows, INDEX)


def _read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive in batch.column("archive").to_pylist():
            store, path = _open(archive)
            rows: list[tuple] = []
            held = 0
            with store.open_input_file(path) as source:
                for line in _sidecar(archive):
                    source.seek(line["offset"])
                    headers, block = parse_record(zlib.decompress(source.read(line["length"]), 31))
                    payload = block.partition(b"\r\n\r\n")[2] if headers["warc-type"] == "response" else None
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    if payload is not None and (digest != base64.b32encode(hashlib.sha1(payload).digest()).decode() or len(payload) != int(headers["x-payload-length"])):
                        raise ValueError(f"{archive} at {line['offset']}: the payload does not match its digest")
                    page, refers = headers.get("x-page-id"), headers.get("x-refers-to-page")
                    rows.append((None if page is None else int(page), headers.get("warc-target-uri"), payload, int(headers["x-payload-length"]), digest, headers["warc-type"], None if refers is None else int(refers)))
                    held += len(payload or b"")
                    if held > 8 << 20:
                        yield _records(rows)
                        rows, held = [], 0
            if rows:
                yield _records(rows)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_pydict({c.split()[0]: pa.array(v, t) for c, v, t in zip(RECORDS.split(", "), zip(*rows), types)})


def read_archives(manifest: DataFrame) -> DataFrame:
    """Records of normalised archives, read member by member through their sidecars."""
    return _spread(manifest).mapInArrow(_read_members, RECORDS)


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_dir(spark, "warc")
    whole = write_monolithic(table(spark, sf_dir, "pages"), f"{folder}/monolithic")
    members = normalise(whole, f"{folder}/members")
    return read_archives(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
w AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
bits AS (SELECT page_id, html, last, h, array_to_string(list_transform(range(1, 41), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', substr(h, i, 1)) - 1) + 1, 4)), '') AS bin FROM p JOIN w USING (h))
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(1, 33), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bin, 5 * j - 4, 1) AS INTEGER) + 8 * CAST(substr(bin, 5 * j - 3, 1) AS INTEGER) + 4 * CAST(substr(bin, 5 * j - 2, 1) AS INTEGER) + 2 * CAST(substr(bin, 5 * j - 1, 1) AS INTEGER) + CAST(substr(bin, 5 * j, 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM bits
"""
