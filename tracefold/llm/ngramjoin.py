"""Exact near-duplicate groups: a blocked, sparse document by n-gram product with size bounds.

Documents with equal shingle sets are one row of the incidence matrix. Shingles have one global order,
rare before frequent (by a count sketch of 2^20 counters over the whole corpus). With n and m for the
sizes of two rows, ``o = ceil(t (n + m) / (1 + t))`` is the overlap that a link needs.

1. Nomination. The prefix of a row, its first ``n - ceil(t n) + 1`` shingles, is what a partner can't
   avoid. Every column (shingle) links its rows to one of them, its centre: a row each, never all
   pairs. The centre is the row whose shingles are most frequent on average, as a source text's are
   among its edited copies. Columns that the sketch calls hot are dealt into salted blocks, each with
   a centre, and the blocks' centres are linked to one of them. Pairs must pass the bounds of their
   sizes: ``min >= t max``, and the shingle stands at most ``n - o`` and ``m - o`` places into its
   rows; the first common shingle of a linked pair does.
2. Product. First the rows' bitmaps meet, two to four bits a shingle (64 at least): a bit that only one
   row has stands for a shingle that the other lacks, so that ``n`` less such bits, and ``m`` less
   those of the other row, bound the overlap from above. Pairs whose bound is below ``o`` are discarded.
   The overlaps of the others accumulate over two blocks of columns, rare and frequent ones: in each,
   blocks of up to ``BLOCK`` partners meet their centre's row. After the first block a pair is
   discarded unless its count and what its rows still hold in the second block reach ``o``. The counts
   after the second block are the whole overlaps, and alone decide the links.
3. Columns whose rows now lie in one component are done. In the others rows of different components
   meet, in blocks of ``BLOCK`` rows, within the same bounds; their counts accumulate per pair, and a
   pair is discarded unless its count and what its rows hold behind the last shared place reach ``o``.
   The rest that step 2 has not decided goes through the same product.

A link within one component can't change a component, so the groups are those of all links. Texts
never shuffle: a Bloom filter finds the rows that are in nominated pairs, and their shingles move.

Shingles are told apart by 64-bit hashes, sets of them by 128-bit digests. Defined results: a text
with one to four words has its whole sequence as its only shingle; a null or empty text, or one
without words, has none and is linked with nothing. Rows without ``doc_id`` have no component. Rows
that repeat a ``doc_id`` are one vertex with the links of all. Equal similarities of 3/4 count as
links. An empty table gives no rows. Columns of the input, whatever their names, are not carried. A
very long text is one row of shingles in memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm import bloom
from tracefold.llm.common import HOT_SHARE, materialise, maybe_broadcast, pieces, salted_join, table
from tracefold.operators.components import connected_components
from tracefold.storage import cut_with, release

WORDS = 5
#: Similarity at least 3/4, in whole numbers: 4 * overlap >= 3 * union.
NUM, DEN = 3, 4
SKETCH_BITS, SEGMENTS = 20, 16
#: Words whose hashes a worker remembers (about 200 bytes each); a bound on memory, never on results.
MEMO = 100_000
#: Rows that meet at once in a block of a column, and partners of a centre in a block of the product.
BLOCK = 1000
#: Share of all entries in the rare block of columns, which is multiplied first.
RARE_SHARE = 0.3

_P = np.uint64(0x9E3779B97F4A7C15)
_memo: dict[bytes, int] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII space only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(_memo) > MEMO:
        _memo.clear()
    for w in set(words).difference(_memo):
        _memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    h = np.fromiter(map(_memo.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        out = _mix(out * _P + h[k : len(words) - size + 1 + k])
    return np.unique(out)


def set_digest(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Bits of the shingles' low hash bits, as longs: a power of two of them. A longer bitmap folds to a
    shorter one by the bitwise or of its halves."""
    size = 1 << max(6, (2 * len(grams) - 1).bit_length())
    bits = np.zeros(size, dtype=np.uint8)
    bits[(grams & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def prefix_length(n: np.ndarray | int):
    return n - (NUM * n + DEN - 1) // DEN + 1


_SETS = "doc_id long, n int, digest binary, segment int, counts binary"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, then the partition's sketch in segments."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for batch in pieces(batches):
        n, digests = [], []
        for text in batch.column(1).to_pylist():
            grams = shingles(text)
            n.append(len(grams))
            digests.append(set_digest(grams))
            at, more = np.unique((grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
            counts[at] += more.astype(np.uint32)
        none = [None] * len(n)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n": pa.array(n, pa.int32()), "digest": pa.array(digests, pa.binary()), "segment": pa.array(none, pa.int32()), "counts": pa.array(none, pa.binary())})
    for k, part in enumerate(np.split(counts, SEGMENTS)):
        if part.any():
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([None], pa.int64()), "n": pa.array([None], pa.int32()), "digest": pa.array([None], pa.binary()), "segment": pa.array([k], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(zlib.decompress(raw), dtype=np.uint32)
            # saturating: a count only orders shingles
            total[segment] = np.minimum(total[segment].astype(np.uint64) + part, 0xFFFFFFFF).astype(np.uint32) if segment in total else part
    for segment, part in total.items():
        yield pa.RecordBatch.from_pydict({"segment": pa.array([segment], pa.int32()), "counts": [zlib.compress(part.tobytes(), 1)]})


@dataclass(frozen=True)
class Shared:
    """Broadcasts of bounded size: the sketch (4 MB) and filters of sets with copies, of ids that
    repeat with different sets, and of the rows of nominated pairs."""

    sketch: object
    copied: object
    repeated: object
    least_hot: int
    rare: int
    members: object = None


def _counts(sketch: np.ndarray, grams: np.ndarray) -> np.ndarray:
    return sketch[(grams >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]


def _vertices(ids: np.ndarray, repeated: bytes, sets: list[np.ndarray] | None, texts: list[str | None]) -> list[int]:
    """The row's number: its id, or one made of its set where the id may repeat with another set."""
    out = ids.tolist()
    for k in np.flatnonzero(bloom.holds(repeated, bloom.id_hash(ids))).tolist():
        digest = set_digest(sets[k] if sets else shingles(texts[k]))
        out[k] = (1 << 62) | (int.from_bytes(digest[:8], "little") >> 2) if digest else out[k]
    return out


def _prefixes(shared: Shared):
    """(vertex, doc, n, turn, digest if the set may have copies, prefix, salts of hot columns, bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(shared.sketch.value, dtype=np.uint32)
        for batch in pieces(batches):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            sets = [shingles(t) for t in texts]
            digests = [set_digest(g) for g in sets]
            copied = bloom.holds(shared.copied.value, bloom.digest_hash([d or bytes(8) for d in digests])).tolist()
            cols: dict[str, list] = {c.split()[0]: [] for c in _PACKED.split(", ")}
            for v, doc, grams, digest, may in zip(_vertices(ids, shared.repeated.value, sets, texts), ids.tolist(), sets, digests, copied, strict=True):
                if not len(grams):
                    continue
                counts = _counts(sketch, grams)
                order = np.lexsort((grams, counts))
                turn = -int(32 * np.log2(np.maximum(counts, 1)).mean())  # coarse: fewer bytes to shuffle
                chosen = order[: prefix_length(len(grams))]
                parts = -(-counts[chosen].astype(np.int64) // shared.least_hot)
                salts = np.where(parts > 1, 1 + ((v * 2654435761 >> 16) & 0x7FFFFFFF) % np.maximum(parts, 1), 0) if parts.max() > 1 else None
                for name, value in zip(cols, (v, doc, len(grams), turn, digest if may else None, grams[chosen].view(np.int64), salts, bitmap(grams)), strict=True):
                    cols[name].append(value)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(cols.items(), types, strict=True)})

    return run


_PACKED = "vid long, doc long, n int, turn int, digest binary, grams array<long>, salts array<int>, bits array<long>"


def _incidence(shared: Shared):
    """(vertex, rare, common): whole rows of the vertices that the filter of members holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(shared.sketch.value, dtype=np.uint32)
        for batch in pieces(batches):
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            vertices = _vertices(ids, shared.repeated.value, None, texts)
            inside = bloom.holds(shared.members.value, bloom.id_hash(np.array(vertices, dtype=np.int64)))
            vids, rare, common = [], [], []
            for k in np.flatnonzero(inside).tolist():
                grams = shingles(texts[k])
                few = _counts(sketch, grams) <= shared.rare
                vids.append(vertices[k])
                rare.append(grams[few].view(np.int64))
                common.append(grams[~few].view(np.int64))
            yield pa.RecordBatch.from_pydict({"vid": pa.array(vids, pa.int64()), "rare": pa.array(rare, pa.list_(pa.int64())), "common": pa.array(common, pa.list_(pa.int64()))})

    return run


def _needed(n: Column, m: Column) -> Column:
    """Shingles that sets of ``n`` and ``m`` must have in common to be linked."""
    return F.ceil(F.lit(NUM) * (n + m) / (NUM + DEN))


def _fold(bits: Column, size: Column) -> Column:
    """A bitmap of ``size`` or ``2 * size`` longs, as one of ``size``: all that the bound on sizes allows."""
    return F.when(F.size(bits) <= size, bits).otherwise(F.zip_with(F.slice(bits, F.lit(1), size), F.slice(bits, size + 1, size), lambda p, q: p.bitwiseOR(q)))


def _only(x: Column, y: Column) -> Column:
    """Bits of ``x`` that ``y`` lacks."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda total, n: total + n)


def _meet(now: DataFrame, rows: DataFrame, column: str, left: Column) -> DataFrame:
    """Pairs with ``column`` of both rows as x and y, and ``left`` of both as xs and ys."""
    # sorted merges at every size, as these sides outgrow any broadcast: a small input shows what a large one costs
    partners = now.join(rows.select(F.col("vid").alias("a"), F.col(column).alias("x"), left.alias("xs")).hint("merge"), "a")
    centres = now.select("b", "parts").distinct().join(rows.select(F.col("vid").alias("b"), F.col(column).alias("y"), left.alias("ys")).hint("merge"), "b")
    centres = centres.select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "y", "ys")
    return partners.join(centres.hint("merge"), ["b", "part"])


def product(pairs: DataFrame, known: DataFrame, bitmaps: DataFrame, shared: Shared) -> DataFrame:
    """(a, b, overlap) of those pairs (a, b, n, m) that reach the needed overlap: whole overlaps,
    accumulated over the two blocks of columns. Partners of a centre b are dealt into salted blocks."""
    spark = pairs.sparkSession
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    dealt = pairs.join(maybe_broadcast(many), "b", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")).withColumn("overlap", F.lit(0).cast("long"))
    # a row that repeats has one bitmap; rows that repeat are one
    met = _meet(dealt, bitmaps, "bits", F.size("bits")).withColumn("xs", F.least("xs", "ys"))
    met = met.withColumn("x", _fold(F.col("x"), F.col("xs"))).withColumn("y", _fold(F.col("y"), F.col("xs")))
    bound = F.least(F.col("n") - _only(F.col("x"), F.col("y")), F.col("m") - _only(F.col("y"), F.col("x")))
    now = materialise(met.filter(bound >= _needed(F.col("n"), F.col("m"))).select(*dealt.columns).distinct(), "ngram-product")
    members, some = cut_with(now.select(F.explode(F.array("a", "b")).alias("vid")).distinct(), "ngram-members", n=F.count("*"))
    shared = replace(shared, members=spark.sparkContext.broadcast(bloom.of_ids(members, some["n"])))
    rows = materialise(known.mapInArrow(_incidence(shared), "vid long, rare array<long>, common array<long>"), "ngram-rows")
    for block, rest in (("rare", "common"), ("common", None)):
        met = _meet(now, rows, block, F.size(rest) if rest else F.lit(0)).withColumn("overlap", F.col("overlap") + F.size(F.array_intersect("x", "y")))
        met = met.filter((NUM + DEN) * (F.col("overlap") + F.least("xs", "ys")) >= NUM * (F.col("n") + F.col("m")))
        now = materialise(met.groupBy("a", "b", "n", "m", "part", "parts").agg(F.max("overlap").alias("overlap")), "ngram-product")
    release(rows)
    return now.select("a", "b", "overlap")


def _sketch(sets: DataFrame) -> np.ndarray:
    sketch = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    sums = sets.filter("segment IS NOT NULL").select("segment", "counts").repartition(SEGMENTS, "segment").mapInArrow(_add_counts, "segment int, counts binary")
    width = (1 << SKETCH_BITS) // SEGMENTS
    for row in sums.toLocalIterator():  # 4 MB together, at any size of input
        sketch[row.segment * width : (row.segment + 1) * width] = np.frombuffer(zlib.decompress(row.counts), dtype=np.uint32)
    return sketch


def _rare_count(sketch: np.ndarray) -> int:
    """The count up to which ``RARE_SHARE`` of all entries lie."""
    counts = np.sort(sketch)
    total = np.cumsum(counts, dtype=np.float64)
    return int(counts[np.searchsorted(total, RARE_SHARE * total[-1])]) if total[-1] else 0


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = texts.filter("doc_id IS NOT NULL")
    sets, seen = cut_with(texts.mapInArrow(_sets, _SETS), "ngram-sets", n=F.count("*"))
    rows = sets.filter("segment IS NULL").select("doc_id", "n", "digest")
    sketch = _sketch(sets)

    # copies: rows whose set a smaller document holds
    held = rows.filter("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "digest")
    holders = held.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    classes, many = cut_with(holders.filter("rep != last").select("digest", "rep", "n"), "ngram-classes", n=F.count("*"))
    copies = materialise(salted_join(held, classes, "digest", seen["n"], "doc_id").filter("doc_id != rep").distinct(), "ngram-copies")
    repeated, again = cut_with(held.groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).filter("d != e").select("doc_id"), "ngram-repeated", n=F.count("*"))
    shared = Shared(
        share(sketch.tobytes()), share(bloom.of_digests(classes.select("digest"), many["n"])), share(bloom.of_ids(repeated, again["n"])),
        max(BLOCK, seen["n"] // HOT_SHARE), _rare_count(sketch),
    )

    # columns with two rows or more, each with its centre
    packed = materialise(known.mapInArrow(_prefixes(shared), _PACKED), "ngram-packed")
    single = packed.filter("digest IS NOT NULL").join(copies.select(F.col("doc_id").alias("doc"), "digest"), ["doc", "digest"], "left_anti")
    prefixes = packed.filter("digest IS NULL").unionByName(single.select(*packed.columns)).select("vid", "n", "turn", "salts", F.posexplode("grams").alias("at", "gram"))
    prefixes = prefixes.select("gram", F.coalesce(F.get("salts", "at"), F.lit(0)).alias("salt"), "vid", "n", "at", "turn")
    by_gram = Window.partitionBy("gram", "salt").orderBy("turn", "vid")
    ranked = prefixes.select(
        "gram", "salt", "vid", "n", "at", "turn",
        F.row_number().over(by_gram).alias("rank"),
        F.lead("vid").over(by_gram).alias("next"),
        F.first(F.struct("vid", "n", "at")).over(by_gram.rowsBetween(Window.unboundedPreceding, 0)).alias("centre"),
    )
    columns, entries = cut_with(ranked.filter("rank > 1 OR next IS NOT NULL OR salt > 0").select("gram", "salt", "vid", "n", "at", "turn", "rank", F.col("centre.vid").alias("centre"), F.col("centre.n").alias("cn"), F.col("centre.at").alias("cat")), "ngram-columns", n=F.count("*"))
    bitmaps = materialise(packed.select("vid", "bits"), "ngram-bitmaps")
    named = materialise(packed.filter("vid != doc").select(F.col("vid").alias("a"), F.col("doc").alias("b")), "ngram-named")
    release(packed)
    within = lambda n, at, m, bt: (DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (at <= n - _needed(n, m)) & (bt <= m - _needed(n, m))
    nominated = lambda df: df.filter("vid != centre").filter(within(F.col("n"), F.col("at"), F.col("cn"), F.col("cat"))).select(F.col("vid").alias("a"), F.col("centre").alias("b"), "n", F.col("cn").alias("m"))
    heads = columns.filter("salt > 0 AND rank = 1").select("gram", "vid", "n", "at", "turn")
    tops = heads.groupBy("gram").agg(F.min(F.struct("turn", "vid", "n", "at")).alias("t")).select("gram", F.col("t.vid").alias("centre"), F.col("t.n").alias("cn"), F.col("t.at").alias("cat"))
    first, some = cut_with(nominated(columns).unionByName(nominated(heads.join(tops, "gram"))).distinct(), "ngram-pairs", n=F.count("*"))
    links = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).union(named)
    if some["n"]:
        links = links.union(product(first, known, bitmaps, shared).select("a", "b"))
    found = materialise(connected_components(links, "a", "b"), "ngram-components")

    # columns that still span components: rows of different components meet; the one pair of two rows is decided
    places = found.select(F.col("node").alias("vid"), F.col("component").alias("comp"))
    placed = columns.select("gram", "vid", "n", "at").join(maybe_broadcast(places), "vid", "left").withColumn("comp", F.coalesce("comp", "vid"))
    spans = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).filter("lo != hi AND n > 2")
    spans = materialise(spans.select(F.col("gram").alias("g"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"), "n"), "ngram-open-columns")
    left, open_rows = cut_with(salted_join(placed.withColumnRenamed("gram", "g"), spans, "g", entries["n"], "vid"), "ngram-open", n=F.count("*"))
    if open_rows["n"]:
        x = left.withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).alias("x")
        y = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
        bounds = within(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
        met = x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.vid") < F.col("y.vid")) & (F.col("x.comp") != F.col("y.comp")) & bounds)
        counted = met.groupBy(F.col("x.vid").alias("a"), F.col("y.vid").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m")).agg(F.count("*").alias("overlap"), F.max("x.at").alias("at"), F.max("y.at").alias("bt"))
        possible = counted.filter(F.col("overlap") + F.least(F.col("n") - 1 - F.col("at"), F.col("m") - 1 - F.col("bt")) >= _needed(F.col("n"), F.col("m"))).select("a", "b", "n", "m")
        tested = first.select("a", "b").union(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
        second, more = cut_with(possible.join(tested, ["a", "b"], "left_anti"), "ngram-pairs", n=F.count("*"))
        if more["n"]:
            found = materialise(connected_components(links.union(product(second, known, bitmaps, shared).select("a", "b")), "a", "b"), "ngram-components")
    return rows.join(maybe_broadcast(found), F.col("doc_id") == F.col("node"), "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
