"""Byte-level BPE by recursive DuckDB queries, one private engine per Python worker.

Encoding a partition: texts split into pieces; distinct pieces become rows (piece, token list); the
recursive query unnests token positions, joins neighbouring tokens with the merge table, contracts
each piece's leftmost minimum-rank pair and repeats until no piece has a pair left. Pieces that are
tokens themselves skip it. Pieces of over ``LONG`` bytes use a query over token-position rows that
contracts every disjoint occurrence of the minimum-rank pair in a round, where the new token can't
form a pair of lower rank (checked against the whole merge table), else the leftmost alone; rounds
then follow the number of different pairs, not the length.

Decoding joins token-position rows with the vocabulary and aggregates their bytes in order.

The vocabulary file is a parameter; the driver reads it and broadcasts its bytes (under 4 MB,
checked). Memory of a worker: the DuckDB limit, the vocabulary and a memo of ``MEMO`` pieces. The
memo only saves work; losing a worker or an executor loses nothing.

Defined results: null or empty text has no tokens and decodes to nothing; an id that the vocabulary
lacks is an error. Null ids of documents and repeated rows pass through; an empty table gives an empty
table. Extra columns stay; the columns that a function adds replace the input's of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.llm.common import keeps, pieces, table

#: The code points with Unicode's White_Space property.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MAX_VOCABULARY_BYTES = 4 << 20
LONG, MEMO, BATCH_CHARS, BATCH_PIECES, BATCH_TOKENS = 1024, 500_000, 2_000_000, 20_000, 1_000_000
#: The recursion keeps the rows of all its rounds: at most so many (list elements, or positions) at once.
ROUND_ROWS = 8_000_000

ENCODE = """
WITH RECURSIVE t(w, ids, done) AS (
  SELECT w, ids, false FROM pieces
  UNION ALL
  SELECT t.w, CASE WHEN b.best IS NULL THEN t.ids ELSE t.ids[:b.best % 1048576 - 1] || [(b.best // 1048576)::INTEGER] || t.ids[b.best % 1048576 + 2:] END, b.best IS NULL
  FROM (SELECT * FROM t WHERE NOT done) t LEFT JOIN (
    SELECT u.w, min(m.merged * 1048576 + u.pos) AS best
    FROM (SELECT w, unnest(ids) AS l, unnest(ids[2:]) AS r, unnest(range(1, len(ids) + 1)) AS pos FROM t WHERE NOT done) u
    JOIN merges m ON m.l = u.l AND m.r = u.r GROUP BY u.w) b ON b.w = t.w)
SELECT w, ids FROM t WHERE done
"""
ENCODE_LONG = """
WITH RECURSIVE t(w, pos, id, step, done) AS (
  SELECT w, pos, id, 0, false FROM positions
  UNION ALL
  SELECT w, pos, CASE WHEN take THEN best ELSE id END, step + 1, best IS NULL OR step + 1 = {rounds} FROM (
    SELECT w, pos, id, step, best, take, coalesce(lag(take) OVER (PARTITION BY w ORDER BY pos), false) AS gone FROM (
      SELECT w, pos, id, step, best, hit AND CASE WHEN safe THEN row_number() OVER (PARTITION BY w, hit, run ORDER BY pos) % 2 = 1 ELSE nth = 1 END AS take FROM (
        SELECT *, CASE WHEN hit THEN nth END AS k, rn - nth AS run FROM (
          SELECT *, row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS nth FROM (
            SELECT *, coalesce(merged = best, false) AS hit FROM (
              SELECT p.w, p.pos, p.id, p.step, p.rn, m.merged, m.safe, min(m.merged) OVER (PARTITION BY p.w) AS best
              FROM (SELECT w, pos, id, step, lead(id) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS rn FROM t WHERE NOT done) p
              LEFT JOIN merges m ON m.l = p.id AND m.r = p.nxt))))))
  WHERE NOT gone)
SELECT list(id ORDER BY pos) AS ids FROM t WHERE done
"""
DECODE = "SELECT w, string_agg(hex, '' ORDER BY pos) AS hex FROM tokens JOIN vocabulary USING (id) GROUP BY w"


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} holds over {MAX_VOCABULARY_BYTES} bytes, more than is broadcast")
    return data


class Codec:
    """Encodes and decodes with one vocabulary (lines of base64 token and rank) and one split pattern."""

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line.strip())}
        lacking = [b for b in range(256) if bytes([b]) not in self.ranks]
        if lacking:
            raise ValueError(f"the vocabulary lacks the single bytes {lacking}")
        self.known = frozenset(self.ranks.values())
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        exact = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")
        self.pattern = regex.compile(exact)
        # pieces cross no white space but one leading space or a run of it, so a text splits first into
        # such spans, which repeat often; any other pattern is applied to the text as it is
        spans_do = pattern.endswith(r"|\s+(?!\S)|\s+") and all(x.startswith(("'", " ?")) for x in pattern.removesuffix(r"|\s+(?!\S)|\s+").split("|"))
        self.spans = re.compile(rf"[ ]?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+").findall if spans_do else self.pattern.findall
        self.memo: dict[str, bytes] = {}
        self._engine()

    def _engine(self) -> None:
        rows = [(a, b, k) for t, k in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        l, r, merged = np.array(rows, dtype=np.int32).reshape(-1, 3).T
        risky = set(l[merged < l].tolist()) | set(r[merged < r].tolist())
        safe = np.array([k not in risky for k in merged.tolist()], dtype=bool)
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB"})
        self.db.register("given", pa.table({"l": l, "r": r, "merged": merged.astype(np.int64), "safe": safe}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.register("given", pa.table({"id": pa.array(list(self.ranks.values()), pa.int32()), "hex": [t.hex() for t in self.ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")

    def _encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each piece."""
        out: list[bytes] = [b""] * len(pieces)
        chosen, rows = [], 0
        for k, piece in enumerate(pieces):
            if len(piece) > LONG:
                out[k] = self._encode_long(piece)
                continue
            if chosen and (len(chosen) == BATCH_PIECES or rows + len(piece) ** 2 > ROUND_ROWS):
                self._encode_batch(pieces, chosen, out)
                chosen, rows = [], 0
            chosen.append(k)
            rows += len(piece) ** 2
        if chosen:
            self._encode_batch(pieces, chosen, out)
        return out

    def _encode_batch(self, pieces: list[bytes], chosen: list[int], out: list[bytes]) -> None:
        flat = self.byte_ids[np.frombuffer(b"".join(pieces[k] for k in chosen), dtype=np.uint8)]
        offsets = np.concatenate([[0], np.cumsum([len(pieces[k]) for k in chosen])]).astype(np.int32)
        self.db.register("pieces", pa.table({"w": np.arange(len(chosen)), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}))
        found = self.db.sql(ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("pieces")
        ids = found.column("ids").chunk(0)
        starts, values = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4").tobytes()
        for w, a, b in zip(found.column("w").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
            out[chosen[w]] = values[4 * a : 4 * b]

    def _encode_long(self, piece: bytes) -> bytes:
        """So many rounds a query that their rows stay bounded, until a query contracts nothing."""
        ids, before = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)].astype(np.int64), -1
        while len(ids) != before:
            before = len(ids)
            self.db.register("positions", pa.table({"w": np.zeros(before, dtype=np.int64), "pos": np.arange(before), "id": ids}))
            query = ENCODE_LONG.replace("{rounds}", str(max(1, ROUND_ROWS // before)))
            ids = np.array(self.db.sql(query).fetchall()[0][0], dtype=np.int64)
            self.db.unregister("positions")
        return ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        spans = [self.spans(t) for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        new = set().union(*spans).difference(memo)
        if new:
            split = {s: [s] if s.lstrip(" ").isalpha() and not s.startswith("  ") else self.pattern.findall(s) for s in new}
            todo = {p for ps in split.values() for p in ps}.difference(memo)
            raw = [p.encode("utf-8", "surrogatepass") for p in todo]
            whole = {p: self.ranks.get(b) for p, b in zip(todo, raw)}
            hard = [(p, b) for p, b in zip(todo, raw) if whole[p] is None]
            memo.update((p, k.to_bytes(4, "little")) for p, k in whole.items() if k is not None)
            memo.update(zip((p for p, _ in hard), self._encode_pieces([b for _, b in hard])))
            memo.update((s, b"".join([memo[p] for p in ps])) for s, ps in split.items() if len(ps) != 1 or ps[0] != s)
        return [b"".join([memo[s] for s in x]) for x in spans]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each id sequence, by ordered aggregation of token-position rows."""
        out, at = [b""] * len(ids), 0
        unknown = set(np.frombuffer(b"".join(ids), dtype="<u4").tolist()).difference(self.known)
        if unknown:
            raise ValueError(f"ids that the vocabulary lacks: {sorted(unknown)[:10]}")
        while at < len(ids):
            end, n = at, 0
            while end < len(ids) and (end == at or n + len(ids[end]) // 4 <= BATCH_TOKENS):
                n += len(ids[end]) // 4
                end += 1
            flat = np.frombuffer(b"".join(ids[at:end]), dtype="<u4").astype(np.int32)
            self.db.register("tokens", pa.table({"w": np.repeat(np.arange(end - at), [len(x) // 4 for x in ids[at:end]]), "pos": np.arange(len(flat)), "id": flat}))
            for w, text in self.db.sql(DECODE).fetchall():
                out[at + w] = bytes.fromhex(text)
            self.db.unregister("tokens")
            at = end
        return out


_CODECS: dict[str, Codec] = {}


def _drop_codecs() -> None:
    for kept in _CODECS.values():
        kept.db.close()
    _CODECS.clear()


def codec(vocabulary: bytes, pattern: str) -> Codec:
    """The worker's codec; a worker keeps one until it works for another operator."""
    key = hashlib.sha256(vocabulary + b"\0" + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, pattern)
        keeps("bpe", _drop_codecs)
    return _CODECS[key]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= BATCH_CHARS):
            chars += len(texts[end])
            end += 1
        yield at, end
        at = end


def _columns(batch: pa.RecordBatch, at: int, end: int, names: list[str]) -> dict[str, pa.Array]:
    return {c: batch.column(c).slice(at, end - at) for c in names}


def _encode_rows(shared, pattern: str, text: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in pieces(batches, operator="bpe"):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for at, end in _slices(texts):
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in own.encode(texts[at:end])]
                yield pa.RecordBatch.from_pydict(_columns(batch, at, end, keep) | {"ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def _decode_rows(shared, pattern: str, ids: str, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in pieces(batches, operator="bpe"):
            raw = [np.array(x or [], dtype="<i4").view("<u4").tobytes() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_pydict(_columns(batch, 0, batch.num_rows, keep) | {"decoded": pa.array(own.decode(raw), pa.binary())})

    return run


def _share(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def bpe_encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``, the tokens of ``text`` (array of int)."""
    keep = [c for c in docs.columns if c != "ids"]
    schema = T.StructType([docs.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*keep).mapInArrow(_encode_rows(_share(docs, path), pattern, text, keep), schema)


def bpe_decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of ``ids``."""
    keep = [c for c in encoded.columns if c != "decoded"]
    schema = T.StructType([encoded.schema[c] for c in keep]).add("decoded", "binary")
    return encoded.select(*keep).mapInArrow(_decode_rows(_share(encoded, path), pattern, ids, keep), schema)


def _round_trip(shared, pattern: str, text: str, keep: list[str], with_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in pieces(batches, operator="bpe"):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            for at, end in _slices(texts):
                ids = own.encode(texts[at:end])
                decoded = own.decode(ids)
                yield pa.RecordBatch.from_pydict(_columns(batch, at, end, keep) | {
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded],
                } | ({"ids": pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in ids], pa.list_(pa.int32()))} if with_tokens else {}))

    return run


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", with_tokens: bool = False) -> DataFrame:
    """``docs`` with token count and digests of ids and of the bytes decoded from them, in one pass:
    encoder and decoder share a worker, so an executor holds one codec a task."""
    added = [*(x.split()[0] for x in DIGESTS.split(", ")), *["ids"] * with_tokens]
    keep = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in keep]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_tokens:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    return docs.select(*keep).mapInArrow(_round_trip(_share(docs, path), pattern, text, keep, with_tokens), schema)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = default_vocabulary()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, path, pattern).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
