"""Line dedup with two Bloom filters: only suspected repeats are shuffled and confirmed exactly.

1. Every partition hashes the keys of its documents' lines, once per document, and keeps two bit
   sets: bits set by anything, bits set at least twice. Partial filters travel in segments and merge
   as ``twice |= t | (once & o); once |= o``, so that a key held by two documents anywhere has all
   its bits in ``twice``.
2. The merged ``twice`` filter (at most ``MAX_FILTER_BITS``, 64 MB) is broadcast. Documents emit only
   keys that it suspects: 16-byte digest and document id.
3. ``min`` and ``max`` document per digest confirm repeats exactly and choose the first holder, with
   map-side combining, so that a line held by a third of the corpus costs a row per task; suspects of
   such a digest are salted in the join that follows.
4. The digests to drop are gathered per document and joined back; the text is cut there.

Digests fall into ranges, each with a filter and a pass of its own, so that the bits per line stay at
``BITS_PER_LINE`` when one filter would be too large: ``MAX_RANGES`` filters serve 268 million lines.
Beyond that fewer hashes are taken and the share of suspects rises, up to shuffling each distinct
(document, line) digest; the result does not depend on the filters.

Defined results: a null or empty text is one empty line. A null ``doc_id`` holds no line for others
and keeps all its own. Rows that repeat a ``doc_id`` count as one document. Keys are told apart by
128-bit BLAKE2b. An empty table gives an empty table. Extra columns stay, ``n_lines`` and
``n_dropped`` of the input are replaced. A text is one row in memory, however long.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.common import materialise, pieces, salted_join, table
from tracefold.storage import cut_with

MIN_CODE_POINTS = 10
BITS_PER_LINE = 16
HASHES = 4
MIN_FILTER_BITS, MAX_FILTER_BITS, MAX_RANGES = 1 << 18, 1 << 29, 8
#: Positions that a task gathers before it merges them.
GATHER = 1 << 21
SEGMENTS = 64
_SPACE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_code_points: int = MIN_CODE_POINTS) -> bytes | None:
    """The stripped, lower-cased (A-Z) line, or None if it has too few code points."""
    key = line.strip(_SPACE).lower()
    if len(key) < min_code_points:
        return None
    if len(key) < 4 * min_code_points and len(key.decode("utf-8", "replace")) < min_code_points:
        return None
    return key


def key_digests(text: str | None, min_code_points: int) -> list[bytes]:
    """Digest per line of ``text``, b'' for lines that are too short to count."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line_key(line, min_code_points)
        out.append(b"" if key is None else hashlib.blake2b(key, digest_size=16).digest())
    return out


@dataclass(frozen=True)
class Layout:
    """Bits and hashes of each filter, and the number of digest ranges with a filter of their own."""

    bits: int
    ranges: int = 1
    hashes: int = HASHES

    def own(self, digests: list[bytes], k: int) -> list[bytes]:
        """The digests of range ``k``."""
        return digests if self.ranges == 1 else [d for d in digests if d[15] % self.ranges == k]

    def positions(self, digests: list[bytes]) -> np.ndarray:
        h = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2)
        step = h[:, 1] | np.uint64(1)
        return np.stack([(h[:, 0] + np.uint64(k) * step) & np.uint64(self.bits - 1) for k in range(self.hashes)], axis=1)


def layout(n_lines: int, most: int = MAX_FILTER_BITS, ranges: int = MAX_RANGES) -> Layout:
    """``BITS_PER_LINE`` bits a line in powers of two, over as many ranges as that takes, up to ``ranges``."""
    wanted = max(MIN_FILTER_BITS, 1 << max(1, n_lines * BITS_PER_LINE - 1).bit_length())
    if wanted <= most:
        return Layout(wanted)
    parts = min(ranges, wanted // most)
    return Layout(most, parts, min(HASHES, max(1, round(0.7 * most * parts / n_lines))))


class _Marks:
    """Positions seen once and twice: sorted arrays, or bit sets where those are smaller."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice, self.dense = bits, np.empty(0, np.uint64), np.empty(0, np.uint64), False

    def _pack(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(self.bits // 8, dtype=np.uint8)
        self._set(out, at)
        return out

    @staticmethod
    def _set(marks: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(marks, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))

    def add(self, at: np.ndarray) -> None:
        new, times = np.unique(at, return_counts=True)
        if self.dense:
            held = (self.once[(new >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (new & np.uint64(7)).astype(np.uint8))) & 1
            self._set(self.twice, new[(times > 1) | (held == 1)])
            self._set(self.once, new)
            return
        self.twice = np.union1d(self.twice, np.concatenate([new[times > 1], np.intersect1d(self.once, new, assume_unique=True)]))
        self.once = np.union1d(self.once, new)
        if len(self.once) > self.bits // 64:
            self.once, self.twice, self.dense = self._pack(self.once), self._pack(self.twice), True

    def segment(self, k: int) -> list[np.ndarray] | None:
        """Packed bits of both sets in segment ``k``, None if it is empty."""
        width = self.bits // SEGMENTS
        if self.dense:
            return [x[k * width // 8 : (k + 1) * width // 8] for x in (self.once, self.twice)]
        out = []
        for x in (self.once, self.twice):
            lo, hi = np.searchsorted(x, np.array([k * width, (k + 1) * width], dtype=np.uint64))
            marks = np.zeros(width, dtype=np.uint8)
            marks[(x[lo:hi] - np.uint64(k * width)).astype(np.int64)] = 1
            out.append(np.packbits(marks))
            if not out[0].any():
                return None
        return out


def _partial_filters(plan: Layout, part: int, min_code_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, found = _Marks(plan.bits), []
        for batch in pieces(batches):
            digests: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc_id is not None:
                    digests += {d for d in key_digests(text, min_code_points) if d}
            if digests := plan.own(digests, part):
                found.append(plan.positions(digests).ravel())
            if sum(map(len, found)) > GATHER:
                marks.add(np.concatenate(found))
                found = []
        if found:
            marks.add(np.concatenate(found))
        for segment in range(SEGMENTS):
            if packed := marks.segment(segment):
                once, twice = (zlib.compress(x.tobytes(), 1) for x in packed)
                yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "once": [once], "twice": [twice]})

    return run


def _merge_filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition, any segments: holds one merged pair of bit sets per segment."""
    merged: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for segment, once, twice in zip(*(c.to_pylist() for c in batch.columns)):
            o, t = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in (once, twice))
            if segment in merged:
                have = merged[segment]
                have[1] = have[1] | t | (have[0] & o)
                have[0] = have[0] | o
            else:
                merged[segment] = [o, t]
    for segment, (o, t) in merged.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "once": [zlib.compress(o.tobytes(), 1)], "twice": [zlib.compress(t.tobytes(), 1)]})


def twice_filter(keyed: DataFrame, plan: Layout, part: int = 0, min_code_points: int = MIN_CODE_POINTS) -> np.ndarray:
    """The merged filter of keys that at least two documents may hold, as packed bits."""
    schema = "segment int, once binary, twice binary"
    partial = keyed.mapInArrow(_partial_filters(plan, part, min_code_points), schema)
    merged = partial.repartition(SEGMENTS, "segment").mapInArrow(_merge_filters, schema)
    size = plan.bits // SEGMENTS // 8
    out = np.zeros(plan.bits // 8, dtype=np.uint8)
    for row in merged.select("segment", "twice").toLocalIterator():  # SEGMENTS rows at most, 64 MB together
        out[row.segment * size : (row.segment + 1) * size] = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint8)
    return out


def _suspects(shared, plan: Layout, part: int, min_code_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(shared.value, dtype=np.uint8)
        for batch in pieces(batches):
            ids: list[int] = []
            digests: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if doc_id is not None:
                    own = plan.own(list({d for d in key_digests(text, min_code_points) if d}), part)
                    ids += [doc_id] * len(own)
                    digests += own
            if not ids:
                continue
            at = plan.positions(digests)
            hit = ((twice[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1).all(axis=1)
            chosen = np.flatnonzero(hit)
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([ids[k] for k in chosen], pa.int64()), "digest": pa.array([digests[k] for k in chosen], pa.binary())})

    return run


def suspected(keyed: DataFrame, plan: Layout, min_code_points: int = MIN_CODE_POINTS) -> tuple[DataFrame, int]:
    """(doc_id, digest) of the lines that the filters of all ranges suspect, and their number."""
    found, total = None, 0
    for part in range(plan.ranges):
        shared = keyed.sparkSession.sparkContext.broadcast(twice_filter(keyed, plan, part, min_code_points).tobytes())
        rows, seen = cut_with(keyed.mapInArrow(_suspects(shared, plan, part, min_code_points), "doc_id long, digest binary"), "line-suspects", n=F.count("*"))
        shared.unpersist()
        found, total = rows if found is None else found.unionByName(rows), total + seen["n"]
    return found, total


def _cut(text_column: str, columns: list[str], min_code_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts, lines_in, dropped = [], [], []
            for text, drop in zip(batch.column(text_column).to_pylist(), batch.column("__drop").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                lines_in.append(len(lines))
                if drop:
                    drop = set(drop)
                    kept = [x for x, d in zip(lines, key_digests(text, min_code_points), strict=True) if d not in drop]
                    dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    dropped.append(0)
                    texts.append(text)
            out = {c: batch.column(c) for c in columns}
            out[text_column] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_pydict(out | {"n_lines": pa.array(lines_in, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    return run


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``docs`` with repeated lines cut from ``text``, plus ``n_lines`` and ``n_dropped``."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_lines = keyed.select(F.sum(F.regexp_count("text", F.lit("\n")) + 1)).first()[0] or 0
    suspects, total = suspected(keyed, layout(n_lines), min_code_points)
    holders = suspects.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    repeated = materialise(holders.filter("keeper < last").select("digest", "keeper", "n"), "line-repeated")
    drops = salted_join(suspects, repeated, "digest", total, "doc_id").filter("doc_id > keeper").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("digest").alias("__drop"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = docs.select(*columns).join(drops, F.col(doc_id).cast("long") == F.col("__id"), "left").select(*columns, "__drop")
    schema = T.StructType([docs.schema[c] for c in columns]).add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_cut(text, columns, min_code_points), schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
x AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
r AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
  count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(keeper IS NOT NULL AND doc_id <> keeper, false)), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY rid
"""
