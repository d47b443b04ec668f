"""The corpus pipeline: quality rules, line dedup, near duplicates, source mix, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame
that is written as Parquet and read again as the next stage's ``docs``. All but the last return the
columns of ``documents``; other columns of the input, whatever their names, are not carried.

Defined results: null and empty texts fail the quality rules. Null ids pass the rules, hold no line and
belong to no group, so that such rows stay unless the mix leaves them out; they draw one common number
there. Rows that repeat an id are one document: they hold lines, join groups and are sampled together.
An empty table passes through all stages. Very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.bpe import bpe_round_trip, default_vocabulary
from tracefold.llm.common import fresh_dir, maybe_broadcast
from tracefold.llm.linededup import line_dedup
from tracefold.llm.mixing import mix
from tracefold.llm.ngramjoin import near_duplicates
from tracefold.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return quality_rules(docs.select(*COLUMNS)).filter("kept").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document holds; documents with no word left go."""
    cut = line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    return cut.filter((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    groups = near_duplicates(docs)
    gone = groups.filter("doc_id != component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(maybe_broadcast(gone), "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of source, language and topic."""
    return mix(docs.select(*COLUMNS)).filter("sampled").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with counts and the digests of ids and decoded bytes."""
    path, pattern = default_vocabulary()
    encoded = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path, pattern, with_tokens=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", duplicates),
    ("mix_sources", mixture),
    ("byte_bpe", tokens),
]

#: SQL can't express the n-gram components and the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
