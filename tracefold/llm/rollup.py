"""Token counts: delta-maintained rollups with idempotent batch commits.

A change is an insert (new count), a delete (old count) or a revision (old and new count) of one
document under one tokenizer version. Changes become signed deltas, summed per (source, language,
version) with map-side combining, so a hot source costs a row per task. A batch's deltas are a few
rows, written under an attempt of their own; the batch is committed by creating one marker file.
Totals are sums over one committed attempt of each batch, so that a batch submitted again, two
writers of one batch, or a task or driver that is lost half-way change nothing.

``compact`` folds all commits into a snapshot: their totals and the list of their batches, which stay
refused. Totals are then the newest snapshot plus the commits that it doesn't list, so that readers
open a few files and the driver lists the commits since then only.

Tokenizer versions are vocabularies of the public byte-level BPE library; a file's place is a
parameter, the driver reads it and broadcasts its bytes.

Defined results: null counts are 0. Null source, language or version is a group of its own. Other
operations than the three are an error. A change row that repeats counts as often as it stands in its
batch. No changes make an empty batch, which is committed too. Totals keep groups that have fallen to
zero. Null and empty texts have 0 tokens; a very long text is counted whole. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.bpe import read_vocabulary
from tracefold.llm.common import fresh_dir, materialise, pieces, table

GROUP = ("source", "lang", "version")
TOTALS = "source string, lang string, version string, docs long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def signed_deltas(changes: DataFrame) -> DataFrame:
    """Changes (op, source, lang, version, old_tokens, new_tokens) to additive (docs, tokens) per group."""
    new, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("new_tokens", "old_tokens"))
    op = F.col("op")
    docs = F.when(op == INSERT, 1).when(op == DELETE, -1).when(op == REVISE, 0).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(op, F.lit("null")))))
    tokens = F.when(op == INSERT, new).when(op == DELETE, -old).otherwise(new - old)
    return changes.groupBy(*GROUP).agg(F.sum(docs.cast("long")).alias("docs"), F.sum(tokens).alias("tokens"))


class TokenRollup:
    """A rollup under ``path``: ``deltas/<attempt>`` Parquet folders, ``commits/<batch>@<attempt>``
    markers, and ``snapshots/<batches>@<attempt>`` markers of ``totals/<attempt>`` and ``batches/<attempt>``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.path, *parts)))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._files.listStatus(at)) if self._files.exists(at) else []

    def _mark(self, folder: str, name: str) -> bool:
        self._files.mkdirs(self._path(folder))
        return self._files.createNewFile(self._path(folder, name))

    def snapshot(self) -> str | None:
        """Attempt of the snapshot that lists most batches, of equals the smallest."""
        found = [(-int(n), attempt) for n, _, attempt in (name.partition("@") for name in self._names("snapshots"))]
        return min(found)[1] if found else None

    def _folded(self, attempt: str | None) -> DataFrame:
        schema = "batch string, attempt string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/batches/{attempt}") if attempt else self.spark.createDataFrame([], schema)

    def committed(self) -> dict[str, str]:
        """Attempt by batch of the commits since the last snapshot. Of two writers that committed one
        batch at once, the smaller attempt counts."""
        # the marker's name holds both, so that no marker has to be opened
        found: dict[str, str] = {}
        for name in self._names("commits"):
            batch, _, attempt = name.rpartition("@")
            if batch:
                found.setdefault(batch, attempt)
        known = self.snapshot()
        if known and found:
            asked = self.spark.createDataFrame([(b,) for b in found], "batch string")
            for row in self._folded(known).join(F.broadcast(asked), "batch", "left_semi").toLocalIterator():
                found.pop(row.batch, None)
        return found

    def has(self, batch: str) -> bool:
        return batch in self.committed() or not self._folded(self.snapshot()).filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` once under the name ``batch``; False if that batch is committed already."""
        if not batch or any(c in batch for c in "/@:"):
            raise ValueError(f"a batch name is not empty and holds none of / @ : ({batch!r})")
        if self.has(batch):
            return False
        attempt = uuid.uuid4().hex
        signed_deltas(changes).write.parquet(f"{self.path}/deltas/{attempt}")
        return self._mark("commits", f"{batch}@{attempt}")

    def _totals(self, known: str | None, commits: dict[str, str]) -> DataFrame:
        parts = [f"{self.path}/deltas/{a}" for a in sorted(commits.values())] + [f"{self.path}/totals/{known}"] * (known is not None)
        if not parts:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(*parts).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        return self._totals(self.snapshot(), self.committed())

    def compact(self) -> bool:
        """Fold all commits into a snapshot and delete what it replaces; False if there are none. A
        commit that comes in meanwhile stays a commit; a snapshot that is lost half-way has no marker."""
        known, commits = self.snapshot(), self.committed()
        if not commits:
            return False
        attempt = uuid.uuid4().hex
        self._totals(known, commits).write.parquet(f"{self.path}/totals/{attempt}")
        batches = self._folded(known).unionByName(self.spark.createDataFrame(sorted(commits.items()), "batch string, attempt string"))
        batches.write.parquet(f"{self.path}/batches/{attempt}")
        n = self._folded(attempt).count()
        self._mark("snapshots", f"{n}@{attempt}")
        for batch, a in commits.items():
            self._files.delete(self._path("commits", f"{batch}@{a}"), False)
            self._files.delete(self._path("deltas", a), True)
        return True


def default_tokenizers() -> dict[str, tuple[str, str]]:
    """(file of ranks, split pattern) of each tokenizer version of the registered query."""
    import public_tokenizers

    names = ("byte_bpe_50k", "byte_bpe_multi_50k")
    return {n: (public_tokenizers.path(f"{n}.tiktoken"), public_tokenizers.PATTERN) for n in names}


COUNTS = "doc_id long, source string, lang string, version string, tokens long, trimmed long"


def _count_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {v: {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())} for v, (data, _) in shared.value.items()}
        coders = {v: tiktoken.Encoding(v, pat_str=shared.value[v][1], mergeable_ranks=r, special_tokens={}) for v, r in ranks.items()}
        for batch in pieces(batches):
            ids, sources, langs, texts = (c.to_pylist() for c in batch.columns)
            whole = [t or "" for t in texts]
            once = ["\n".join(dict.fromkeys(t.split("\n"))) for t in whole]
            for version, coder in coders.items():
                tokens = [len(coder.encode_ordinary(t)) for t in whole]
                trimmed = [n if len(o) == len(t) else len(coder.encode_ordinary(o)) for n, t, o in zip(tokens, whole, once, strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids, pa.int64()), "source": pa.array(sources, pa.string()), "lang": pa.array(langs, pa.string()),
                    "version": pa.array([version] * len(ids), pa.string()), "tokens": pa.array(tokens, pa.int64()), "trimmed": pa.array(trimmed, pa.int64()),
                })

    return run


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """A row per document and tokenizer version: tokens of the text and of its distinct lines."""
    tokenizers = default_tokenizers() if tokenizers is None else tokenizers
    shared = docs.sparkSession.sparkContext.broadcast({v: (read_vocabulary(path), pattern) for v, (path, pattern) in tokenizers.items()})
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(_count_rows(shared), COUNTS)


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, delete those labelled toxic, revise the rest to their distinct lines, and
    submit every batch a second time, before and after the first two are folded into a snapshot."""
    rows = materialise(counted(table(spark, sf_dir, "documents")), "rollup-counts")
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    change = lambda df, op: df.select(F.lit(op).alias("op"), *GROUP, F.col("tokens").alias("old_tokens"), F.col("trimmed" if op == REVISE else "tokens").alias("new_tokens"))
    batches = {
        "load": change(rows, INSERT),
        "remove-toxic": change(rows.join(toxic, "doc_id", "left_semi"), DELETE),
        "trim-lines": change(rows.join(toxic, "doc_id", "left_anti").filter("tokens != trimmed"), REVISE),
    }
    rollup = TokenRollup(spark, fresh_dir(spark, "token-rollup"))
    for name in ("load", "remove-toxic", "load"):
        rollup.commit(name, batches[name])
    rollup.compact()
    for name in ("trim-lines", "remove-toxic", "trim-lines"):
        rollup.commit(name, batches[name])
    return rollup.totals()
