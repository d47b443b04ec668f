"""Bloom filters of 64-bit hashes, built on executors and broadcast as packed bits of a bounded size.

A filter never misses a key. It sends the few rows whose key may be in a table to a join, so that
texts of all others stay where they are. Keys beyond what ``MAX_BITS`` was made for only raise the
share of rows that are sent needlessly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
BITS_PER_KEY, HASHES, SEGMENTS = 16, 4, 16
_SCHEMA = "segment int, bits binary"


def filter_bits(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << max(1, n * BITS_PER_KEY - 1).bit_length()))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(HASHES)], axis=1)


def _partial(bits: int):
    width = bits // SEGMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, dtype=np.uint8)
        for batch in batches:
            at = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits))
            np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        for k in range(SEGMENTS):
            part = marks[k * width // 8 : (k + 1) * width // 8]
            if part.any():
                yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "bits": [zlib.compress(part.tobytes(), 1)]})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    have: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(zlib.decompress(raw), dtype=np.uint8)
            have[segment] = have[segment] | part if segment in have else part
    for segment, part in have.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "bits": [zlib.compress(part.tobytes(), 1)]})


def build(keys: DataFrame, n: int) -> bytes:
    """The filter of the one column of ``keys`` (longs, already hashes), made for ``n`` of them."""
    bits = filter_bits(n)
    out, width = np.zeros(bits // 8, dtype=np.uint8), bits // SEGMENTS // 8
    merged = keys.mapInArrow(_partial(bits), _SCHEMA).repartition(SEGMENTS, "segment").mapInArrow(_merged, _SCHEMA)
    for row in merged.toLocalIterator():  # MAX_BITS together at most, 32 MB
        out[row.segment * width : (row.segment + 1) * width] = np.frombuffer(zlib.decompress(row.bits), dtype=np.uint8)
    return out.tobytes()


def holds(packed: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) may be in the filter."""
    if not len(hashes):
        return np.zeros(0, dtype=bool)
    marks = np.frombuffer(packed, dtype=np.uint8)
    at = _positions(hashes, len(marks) * 8)
    return ((marks[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).all(axis=1)


def id_hash(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of longs."""
    h = ids.astype(np.int64).view(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def of_ids(ids: DataFrame, n: int) -> bytes:
    """The filter of a column of longs; look up ``id_hash`` of an id."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array(id_hash(batch.column(0).to_numpy(zero_copy_only=False)).view(np.int64))})

    name = ids.columns[0]
    return build(ids.select(F.col(name).cast("long").alias("id")).filter("id IS NOT NULL").mapInArrow(hashed, "h long"), n)


def of_digests(digests: DataFrame, n: int) -> bytes:
    """The filter of a column of binary digests; look up ``digest_hash``."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array(digest_hash(batch.column(0).to_pylist()).view(np.int64))})

    return build(digests.mapInArrow(hashed, "h long"), n)


def digest_hash(digests: list[bytes]) -> np.ndarray:
    """64-bit hashes of digests: their first eight bytes."""
    return np.frombuffer(b"".join([d[:8] for d in digests]), dtype="<u8").astype(np.uint64)
