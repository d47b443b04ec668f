"""Media columns: content-defined chunking with a deduplicated chunk store.

1. ``chunk_digests`` cuts every payload where a rolling gear hash of the last 32 bytes hits a mask
   and lists the chunks' SHA-256 digests (bytes don't move).
2. Spark joins digest rows with their counts to find the digests that several documents hold, and each
   one's owner: the smallest document, at its first place.
3. ``write_store`` writes a row per document: the ordered chunk list (digest, length), the bytes of
   chunks that no other document holds, the bytes that it lends to others and the digests that it
   borrows. Every distinct chunk is stored once.
4. ``read_media`` reads the store back. Borrowed chunks are fetched by one join on digest; then each
   payload is joined in order and every digest is verified. A chunk that is gone is an error.

Only texts that hold a shared chunk meet their chunk lists in a shuffle, found by a Bloom filter of
their ids; all others are stored from the scan. A chunk held by a third of all documents is stored
once, counted with map-side combining, and its rows are salted in both joins. Joins of rows are sorted
merges at every size, so that small inputs show what large ones cost.

Defined results: null or empty text is a payload of padding alone. Null ``doc_id`` and repeated rows
keep their own copy of the bytes where no other id shares them. Very long texts take one row each
in memory. An empty table gives an empty store and no rows. Extra columns, also such as are named like
the store's own, are dropped here; join on ``doc_id`` to add them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm import bloom
from tracefold.llm.common import fresh_dir, materialise, pieces, salted_join, table
from tracefold.storage import cut_with

UNIT, PAD = 576, b"\xff"


@dataclass(frozen=True)
class Cutter:
    """Chunks hold ``least`` to ``most`` bytes and about ``least + 2**mask_bits`` on average."""

    mask_bits: int = 11
    least: int = 512
    most: int = 16384
    seed: int = 20240229

    def gear(self) -> np.ndarray:
        """256 fixed pseudo-random 32-bit words: the seeded table of the rolling hash."""
        out = [int.from_bytes(hashlib.blake2b(f"{self.seed}:{b}".encode(), digest_size=4).digest(), "big") for b in range(256)]
        return np.array(out, dtype=np.uint32)

    def ends(self, data: bytes, gear: np.ndarray) -> list[int]:
        """Cut positions: the hash at byte i is the sum of gear[b[i-k]] << k over the last 32 bytes.

        Five doublings of the window compute it for all bytes at once.
        """
        h = gear[np.frombuffer(data, dtype=np.uint8)]
        for k in (1, 2, 4, 8, 16):
            if len(h) > k:
                h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        marks = np.flatnonzero((h >> np.uint32(32 - self.mask_bits)) == 0) + 1
        ends, start, n = [], 0, len(data)
        while n - start > self.least:
            i = int(np.searchsorted(marks, start + self.least, side="left"))
            end = int(marks[i]) if i < len(marks) else n
            end = min(end, start + self.most, n)
            ends.append(end)
            start = end
        if start < n:
            ends.append(n)
        return ends


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with 255 to a positive multiple of 576 bytes, and its length before padding."""
    data = (text or "").encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(data) // UNIT)) * UNIT
    return data + PAD * (whole - len(data)), len(data)


def _chunks(payload: bytes, cutter: Cutter, gear: np.ndarray) -> list[bytes]:
    out, start = [], 0
    for end in cutter.ends(payload, gear):
        out.append(payload[start:end])
        start = end
    return out


def _digest_rows(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = cutter.gear()
        for batch in pieces(batches):
            ids, at, digests = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc_id is None:
                    continue
                for k, chunk in enumerate(_chunks(payload_of(text)[0], cutter, gear)):
                    ids.append(doc_id)
                    at.append(k)
                    digests.append(hashlib.sha256(chunk).digest())
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "at": pa.array(at, pa.int32()), "digest": pa.array(digests, pa.binary())})

    return run


STORE = "doc_id long, n_bytes long, digests array<binary>, sizes array<int>, own array<binary>, lent array<struct<digest:binary,bytes:binary,n:long>>, borrowed array<binary>"
_LENT = pa.list_(pa.struct([("digest", pa.binary()), ("bytes", pa.binary()), ("n", pa.int64())]))
_STORE_TYPES = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), _LENT, pa.list_(pa.binary()))


def _store_rows(cutter: Cutter, shared=None):
    """Rows of (doc_id, text, chunks); with a filter ``shared`` only documents that it surely lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, names = cutter.gear(), [c.split()[0] for c in STORE.split(", ")[:5]] + ["lent", "borrowed"]
        for batch in pieces(_picked(batches, shared.value, False) if shared else batches):
            cols: dict[str, list] = {c: [] for c in names}
            for doc_id, text, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload, n = payload_of(text)
                chunks = _chunks(payload, cutter, gear)
                digests = [hashlib.sha256(c).digest() for c in chunks]
                elsewhere = {x["digest"]: x for x in held or ()}
                own, lent, borrowed, kept = [], [], [], set()
                for c, d in zip(chunks, digests, strict=True):
                    own.append(None if d in kept or d in elsewhere else c)
                    if d in elsewhere and d not in kept:
                        if elsewhere[d]["mine"]:
                            lent.append({"digest": d, "bytes": c, "n": elsewhere[d]["n"]})
                        else:
                            borrowed.append(d)
                    kept.add(d)
                for name, value in zip(names, (doc_id, n, digests, [len(c) for c in chunks], own, lent, borrowed), strict=True):
                    cols[name].append(value)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(cols.items(), _STORE_TYPES, strict=True)})

    return run


def _picked(batches: Iterator[pa.RecordBatch], packed: bytes, inside: bool) -> Iterator[pa.RecordBatch]:
    """Rows whose id may be in a filter, or those whose id is surely not; null ids never are."""
    for batch in batches:
        ids = batch.column(0)
        hit = bloom.holds(packed, bloom.id_hash(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False))) & ~pc.is_null(ids).to_numpy(zero_copy_only=False)
        yield batch.filter(pa.array(hit if inside else ~hit))


def _only(shared):
    return lambda batches: _picked(batches, shared.value, True)


def write_store(docs: DataFrame, path: str, cutter: Cutter = Cutter(), doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the chunk store of ``docs`` to ``path``."""
    spark = docs.sparkSession
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    digests, seen = cut_with(keyed.mapInArrow(_digest_rows(cutter), "doc_id long, at int, digest binary"), "chunk-digests", n=F.count("*"))
    place = F.struct("doc_id", "at")
    holders = digests.groupBy("digest").agg(F.min(place).alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    shared = materialise(holders.filter("owner.doc_id != last").select("digest", F.col("owner.doc_id").alias("owner"), "n", F.col("n").alias("holders")), "chunk-shared")
    held = salted_join(digests.select("doc_id", "digest"), shared.hint("merge"), "digest", seen["n"], "doc_id")
    chunks = F.collect_set(F.struct("digest", (F.col("doc_id") == F.col("owner")).alias("mine"), F.col("holders").alias("n"))).alias("chunks")
    lists, few = cut_with(held.groupBy("doc_id").agg(chunks), "chunk-lists", n=F.count("*"))
    packed = spark.sparkContext.broadcast(bloom.of_ids(lists.select("doc_id"), few["n"]))
    none = F.lit(None).cast(lists.schema["chunks"].dataType).alias("chunks")
    write = lambda rows, run: rows.mapInArrow(run, STORE).write.mode("append").option("compression", "zstd").parquet(path)
    write(keyed.select("doc_id", "text", none), _store_rows(cutter, packed))
    joined = keyed.mapInArrow(_only(packed), keyed.schema).join(lists.hint("merge"), "doc_id", "left").select("doc_id", "text", "chunks")
    write(joined, _store_rows(cutter))


MEDIA = "doc_id long, n_bytes long, payload binary, n_chunks int, media_bytes long, media_sha256 string"


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        cols: dict[str, list] = {c.split()[0]: [] for c in MEDIA.split(", ")}
        for doc_id, n, digests, sizes, own, lent, fetched in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have = {x["digest"]: x["bytes"] for x in (*(lent or ()), *(fetched or ()))}
            stream, parts = hashlib.sha256(), []
            for k, digest in enumerate(digests):
                chunk = own[k] if own[k] is not None else have.get(digest)
                if chunk is None:
                    raise ValueError(f"document {doc_id}: chunk {k} ({digest.hex()}) is not in the store")
                if len(chunk) != sizes[k] or hashlib.sha256(chunk).digest() != digest:
                    raise ValueError(f"document {doc_id}: chunk {k} does not match its digest")
                have[digest] = chunk
                parts.append(chunk)
                stream.update(len(chunk).to_bytes(4, "big") + digest + chunk)
            payload = b"".join(parts)
            for name, value in zip(cols, (doc_id, n, payload, len(parts), len(payload) + 36 * len(parts), stream.hexdigest()), strict=True):
                cols[name].append(value)
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(cols.items(), types, strict=True)})


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """Verified payloads of a store. The stored form of a payload is its framed chunk stream: for each
    chunk in order a 4-byte big-endian length, the digest and the bytes."""
    store = spark.read.schema(STORE).parquet(path)
    missing = store.select("doc_id", F.explode("borrowed").alias("digest")).distinct()
    # rows that repeat an owner's id lend the same bytes
    lent = store.select(F.explode("lent").alias("c")).select("c.*").groupBy("digest").agg(F.first("bytes").alias("bytes"), F.max("n").alias("n"))
    total = store.agg(F.sum(F.size("borrowed"))).first()[0] or 0
    got = salted_join(missing, lent.hint("merge"), "digest", total, "doc_id").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct("digest", "bytes")).alias("fetched"))
    columns = ["doc_id", "n_bytes", "digests", "sizes", "own", F.transform("lent", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("lent")]
    # documents that borrow nothing stay where they are
    whole = store.filter(F.size("borrowed") == 0).select(*columns, F.lit(None).cast("array<struct<digest:binary,bytes:binary>>").alias("fetched"))
    partial = store.filter(F.size("borrowed") > 0).join(got.hint("merge"), F.col("doc_id") == F.col("__id"), "left").select(*columns, "fetched")
    return whole.unionByName(partial).mapInArrow(_assemble, MEDIA)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the bytes read back: mean and spread of the samples, entropy of their histogram."""
    for batch in pieces(batches):
        tails, shas, feats = [], [], []
        for payload, n_chunks in zip(batch.column("payload").to_pylist(), batch.column("n_chunks").to_pylist()):
            samples = np.frombuffer(payload, dtype=np.uint8)
            share = np.bincount(samples, minlength=256) / len(samples)
            level = np.arange(256)
            mean = float((share * level).sum())
            spread = float((share * (level - mean) ** 2).sum()) ** 0.5
            entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
            tails.append(zlib.crc32(payload[-32:]))
            shas.append(hashlib.sha256(payload).hexdigest())
            feats.append(f"chunks={n_chunks};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f}")
        lengths = [len(p) for p in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "payload_bytes": pa.array(lengths, pa.int64()), "payload_sha256": pa.array(shas, pa.string()),
            "tail_crc32": pa.array(tails, pa.int64()), "media_bytes": batch.column("media_bytes"), "media_sha256": batch.column("media_sha256"), "feature": pa.array(feats, pa.string()),
        })


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(media: DataFrame) -> DataFrame:
    return media.mapInArrow(_features, FEATURES)


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "chunk-store")
    write_store(table(spark, sf_dir, "documents"), path)
    return media_features(read_media(spark, path))
