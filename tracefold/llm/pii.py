"""Personal data: base patterns, then contextual patterns bootstrapped from them.

1. One pass over the texts finds the base spans (email, ip, card, phone) and, for every base span
   and every other identifier-like token (it holds a digit, ``@`` or ``_``), the lexical patterns
   around it: the two words before, the word before where that ends as a label (``:`` or ``=``), the
   two words behind, and the word on either side. Words are taken whole, however long; patterns of
   over ``PATTERN_CHARS`` characters stand as their digest.
2. Spark builds the graph of patterns and instances, distinct and with map-side combining, and
   scores it in rounds: a pattern's confidence is the mean score of its instances, an instance's
   score is noisy-or over its patterns; base entities score 1. Scores only rise, and the rounds end
   when neither the confident patterns nor their confidence (to four decimals) change.
3. Occurrences that a confident pattern surrounds and that score high are new spans, ``ctx``.

Base spans are never changed. Every pattern counts over the whole corpus; patterns of fewer than
``MIN_SUPPORT`` distinct instances can't become confident and leave the graph before the rounds. Rows
of hot patterns and instances are salted in every join.

Spans are code points, end exclusive; ties in start are ordered by kind and end. Defined results: null
or empty text has no spans. Null ids and repeated rows pass through; equal texts get equal spans. An
empty table gives no rows. A very long text is one row. Other columns, whatever their names, are not
carried.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import materialise, maybe_broadcast, pieces, salted_join, table
from tracefold.storage import cut_with

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT, MIN_CONFIDENCE, MIN_SCORE = 3.0, 0.6, 0.6
PATTERN_CHARS = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# from the start of a run of digits only and without giving digits back: linear, with the same matches
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME_DIGIT = re.compile(r"[0-9]")
_TOKEN, _MARK = re.compile(r"\S+"), re.compile(r"[0-9@_]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base matches, in order."""
    out = []
    if "@" in text:
        done = 0
        # an address is the domain after an @ and the run of local characters before it
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    if _SOME_DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m.group().split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Words:
    """Tokens of a text, for the patterns around its places."""

    def __init__(self, text: str):
        self.text = text
        at = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [s for s, _ in at], [e for _, e in at]

    def _word(self, k: int, to: int | None = None) -> str:
        return self.text[self.starts[k] : self.ends[k] if to is None else min(self.ends[k], to)]

    def patterns(self, start: int, end: int) -> list[str]:
        """Lexical patterns around the place, each once; the token it stands in counts up to it."""
        k, n = bisect_left(self.starts, start) - 1, bisect_left(self.starts, end)
        before = ([self._word(k - 1)] if k > 0 else []) + ([self._word(k, start)] if k >= 0 else [])
        behind = [self._word(j) for j in range(n, min(n + 2, len(self.starts)))]
        out = []
        if len(before) == 2:
            out.append(f"L {before[0]} {before[1]}")
        if before and before[-1][-1] in ":=":
            out.append(f"l {before[-1]}")
        if len(behind) == 2:
            out.append(f"R {behind[0]} {behind[1]}")
        if before and behind:
            out.append(f"M {before[-1]} {behind[0]}")
        return [p if len(p) <= PATTERN_CHARS else "#" + hashlib.blake2b(p.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for p in map(str.lower, out)]


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that overlap no base span, without quotes and punctuation around them."""
    if not _MARK.search(text):
        return []
    out, k = [], 0
    ends = sorted((s, e) for s, _, e in taken)
    for m in _TOKEN.finditer(text):
        token = m.group()
        if not _MARK.search(token):
            continue
        start = m.start() + len(token) - len(token.lstrip("\"'([{<,;:=."))
        end = m.end() - (len(token) - len(token.rstrip("\"')]}>,;:=.!?")))
        while k < len(ends) and ends[k][1] <= start:
            k += 1
        if k == len(ends) or ends[k][0] >= end:
            out.append((start, end))
    return out


_ROW = "doc_id long, key binary, base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,end:int,seed:int,instance:string,contexts:array<string>>>"
_BASE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_SEEN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.int32()), ("instance", pa.string()), ("contexts", pa.list_(pa.string()))]))


def places(text: str) -> tuple[list[tuple[int, int, int]], list[dict]]:
    """Base spans of a text, and its base and identifier places with the patterns around them."""
    base = base_spans(text)
    found = [(s, e, 1) for s, _, e in base] + [(s, e, 0) for s, e in identifiers(text, base)]
    words = Words(text) if found else None
    return base, [{"start": s, "end": e, "seed": seed, "instance": text[s:e].lower(), "contexts": c} for s, e, seed in found if (c := words.patterns(s, e))]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        keys, bases, seens = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            keys.append(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest())
            base, seen = places(text)
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            seens.append(seen)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "key": pa.array(keys, pa.binary()), "base": pa.array(bases, _BASE_TYPE), "seen": pa.array(seens, _SEEN_TYPE)})


def score_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(context, confidence) and (instance, score) from distinct (context, instance, seed) edges."""
    edges, seen = cut_with(edges, "pii-edges", n=F.count("*"))
    supported = materialise(edges.groupBy("context").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_SUPPORT), "pii-supported")
    edges, seen = cut_with(salted_join(edges, supported, "context", seen["n"], "instance"), "pii-edges", n=F.count("*"))
    scores = materialise(edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"), F.count("*").alias("n")), "pii-instances")
    before = None
    while True:
        scored = salted_join(edges, scores, "instance", seen["n"], "context")
        confident = scored.groupBy("context").agg(F.avg("score").alias("confidence"), F.sum("score").alias("support"), F.count("*").alias("n"))
        confident = confident.filter((F.col("support") >= MIN_SUPPORT) & (F.col("confidence") >= MIN_CONFIDENCE)).select("context", "confidence", "n")
        confident, now = cut_with(confident, "pii-contexts", n=F.count("*"), s=F.sum(F.round("confidence", 4).cast("decimal(20,4)")))
        if now == before:
            return confident, scores
        before = now
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.coalesce("confidence", F.lit(0.0)), F.lit(1e-12)))))
        joined = salted_join(edges, confident, "context", seen["n"], "instance", "left")
        scores = materialise(joined.groupBy("instance").agg(F.greatest(F.max("seed").cast("double"), 1 - doubt).alias("score"), F.count("*").alias("n")), "pii-instances")


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, found): base spans, and base and contextual spans together, in order."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = materialise(texts.mapInArrow(_scan, _ROW), "pii-rows")
    held = rows.filter(F.size("seen") > 0).select("key", F.explode("seen").alias("s")).select("key", "s.*")
    edges = held.select(F.explode("contexts").alias("context"), "instance", "seed").groupBy("context", "instance").agg(F.max("seed").alias("seed"))
    confident, scores = score_graph(edges)
    # per (context, instance) once, and per text once, before they meet
    wanted = edges.filter("seed = 0").join(maybe_broadcast(confident.select("context")), "context", "left_semi").join(maybe_broadcast(scores.filter(F.col("score") >= MIN_SCORE).select("instance")), "instance", "left_semi")
    wanted = materialise(wanted.select("context", "instance"), "pii-wanted")
    new = held.filter("seed = 0").select("key", "start", "end", "instance", F.explode("contexts").alias("context")).distinct()
    new = new.join(maybe_broadcast(wanted), ["context", "instance"], "left_semi")
    extra = new.groupBy("key").agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("extra"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.select("doc_id", "key", "base").join(maybe_broadcast(extra), "key", "left").select("doc_id", "base", F.array_sort(F.concat("base", F.coalesce("extra", none))).alias("found"))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "ctx")])
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def _count_of(kind: int) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[_count_of(k) for k in range(len(KINDS))], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"),
        (F.size("found") > 0).alias("has_personal_data"),
    )
