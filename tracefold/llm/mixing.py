"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

0. Topics are a column of the input, or fitted to the whole corpus: of every language, the ``TOPICS``
   words that most of its documents hold among those that at most one in ``COMMON`` holds are anchors,
   and a document's topic is the place of the anchor that it holds most often (``topic-1`` ...).
1. Token counts add up to one row per (source, language, topic) cell, combined before the shuffle.
2. Raking: each sweep scales the cells to the source, then language, then topic target shares, until
   every marginal is within ``TOLERANCE`` of its target or no round brings it nearer; ``rake`` returns
   the largest error. Only the cell table takes part (its size is the number of cells, not of documents).
3. A cell's weight is its raked share over its actual share. Sampling probabilities are
   ``min(1, c weight)``; ``c`` solves for the token budget exactly, over the cells in order.
4. A document is sampled if a uniform number from the MD5 of seed and id lies below its probability:
   the same at any partitioning.

Defined results: null source, language or topic is the group ``(none)``. Documents without words (null
or empty text included) have weight and probability 0. Null ids draw one common number; rows that
repeat an id are sampled together. Ties between anchors go to the one that more documents hold, then
to the smaller word. An empty table gives an empty table. Targets that lack a group which has tokens,
or name a group which has none, are an error. Extra columns stay, ``topic`` of the input is used if
present; ``tokens``, ``weight``, ``probability`` and ``sampled`` are replaced. Long texts count whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import SPACE_CLASS, WORD, let, materialise, maybe_broadcast, table, text_or_empty
from tracefold.storage import cut_with, release

DIMENSIONS = ("source", "lang", "topic")
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.8}
TOLERANCE, SWEEPS, BUDGET, SEED = 1e-10, 4, 0.6, "mix-1"
TOPICS, COMMON = 4, 10
NONE, OTHER = "(none)", "(other)"


def lower_words(text: str) -> Column:
    """Lower-case words, with an empty one in front or behind where white space stands there. Only
    whole-array functions are used on it: lambdas over every word of a corpus are several times dearer."""
    return F.split(F.lower(text_or_empty(text)), f"[{SPACE_CLASS}]+", -1)


def n_words(words: Column) -> Column:
    empty = lambda x: F.when(x == "", 1).otherwise(0)
    behind = F.when(F.size(words) > 1, empty(F.element_at(words, -1))).otherwise(0)
    return (F.size(words) - empty(F.get(words, F.lit(0))) - behind).cast("long")


def fit_anchors(docs: DataFrame, text: str = "text", lang: str = "lang", topics: int = TOPICS) -> DataFrame:
    """(lang, anchors): up to ``topics`` words of every language by document frequency over all of ``docs``."""
    named = F.coalesce(F.col(lang).cast("string"), F.lit(NONE)).alias("lang")
    held = docs.select(named, F.explode(F.array_distinct(lower_words(text))).alias("word")).filter("word != ''").groupBy("lang", "word").agg(F.count("*").alias("df"))
    size = maybe_broadcast(materialise(docs.groupBy(named).agg(F.count("*").alias("size")), "mix-languages"))
    order = Window.partitionBy("lang").orderBy(F.col("df").desc(), "word")
    top = held.join(size, "lang").filter(F.col("df") * COMMON <= F.col("size")).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= topics)
    return materialise(top.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]).alias("anchors")), "mix-anchors")


def topic_of(words: Column, anchors: Column, topics: int = TOPICS) -> Column:
    """The place of the most frequent of ``anchors`` among lower-case ``words``."""
    count = lambda k: F.coalesce(F.size(words) - F.size(F.array_remove(words, F.get(anchors, F.lit(k)))), F.lit(0))
    counts = F.array(*[F.struct(F.when(F.get(anchors, F.lit(k)).isNull(), 0).otherwise(count(k)).alias("n"), F.lit(-1 - k).alias("k")) for k in range(topics)])
    return let(F.array_max(counts), lambda best: F.when(best["n"] > 0, F.concat(F.lit("topic"), best["k"].cast("string"))).otherwise(OTHER))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares proportional to a power of the actual token totals."""
    totals = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).filter("t > 0").select(dimension, F.pow("t", F.lit(power)).alias("p"))
    return totals.select(dimension, (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("target"))


def check_targets(cells: DataFrame, targets: dict[str, DataFrame]) -> None:
    """Every group with tokens needs a target, and every target above 0 a group."""
    for d, target in targets.items():
        have, want = cells.filter("tokens > 0").select(d).distinct(), target.filter("target > 0").select(d).distinct()
        for what, left, right in (("has no target", have, want), ("has a target but no tokens", want, have)):
            odd = [r[0] for r in left.join(right, d, "left_anti").limit(5).collect()]
            if odd:
                raise ValueError(f"{d} {what}: {odd}")


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """``cells`` with ``raked``, token weights whose marginals meet the targets, and the largest
    relative error of a marginal. It is above ``tolerance`` only where no weights meet all targets."""
    now = cells.filter("tokens > 0").withColumn("raked", F.col("tokens").cast("double"))
    for dimension, target in targets.items():
        now = now.join(maybe_broadcast(target.withColumnRenamed("target", f"target_{dimension}"), 100_000), dimension)
    marginal = lambda d: F.sum("raked").over(Window.partitionBy(d))
    before = None
    while True:
        for dimension in [*targets] * SWEEPS:
            now = now.withColumn("raked", F.col("raked") * F.col(f"target_{dimension}") / marginal(dimension))
        last = now
        now, seen = cut_with(now.withColumn("off", F.greatest(F.lit(0.0), *[F.abs(marginal(d) / F.col(f"target_{d}") - 1) for d in targets])), "mix-sweep", off=F.max("off"))
        now, off = now.drop("off"), float(seen["off"])
        release(last)
        if off <= tolerance or (before is not None and off > 0.999 * before):
            return now.select(*cells.columns, "raked"), off
        before = off


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``weight`` and ``probability``: expected tokens are ``budget`` of all tokens."""
    whole = Window.partitionBy()
    r = raked.filter("tokens > 0").withColumn("weight", (F.col("raked") / F.sum("raked").over(whole)) / (F.col("tokens") / F.sum("tokens").over(whole)))
    order = Window.orderBy(F.col("weight").desc(), *DIMENSIONS).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("mass", F.col("tokens") * F.col("weight"))
    # if the cells before this one are kept whole, the factor of the rest
    r = r.withColumn("c", (budget * F.sum("tokens").over(whole) - (F.sum("tokens").over(order) - F.col("tokens"))) / (F.sum("mass").over(whole) - (F.sum("mass").over(order) - F.col("mass"))))
    r = r.withColumn("rank", F.row_number().over(Window.orderBy(F.col("weight").desc(), *DIMENSIONS)))
    first = F.min_by(F.when(F.col("c") * F.col("weight") <= 1, F.col("c")), F.when(F.col("c") * F.col("weight") <= 1, F.col("rank"))).over(whole)
    return r.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.coalesce(first, F.lit(1e300)) * F.col("weight")).alias("probability"))


def uniform(doc_id: Column, seed: str) -> Column:
    """In [0, 1), from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: str = SEED, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` (its columns ``keep``, all by default) with ``topic``, ``tokens``, ``weight``,
    ``probability`` and ``sampled``. Targets are shares that add up to 1, by dimension."""
    own = ("tokens", "weight", "probability", "sampled")
    names = [c for c in keep or docs.columns if c not in own and c != "topic"]
    given = "topic" in docs.columns
    words = lower_words(text)
    if given:
        counted = docs.select(*names, F.coalesce(F.col("topic").cast("string"), F.lit(NONE)).alias("topic"), n_words(words).alias("tokens"))
    else:
        anchors = maybe_broadcast(fit_anchors(docs, text).withColumnRenamed("lang", "__lang").withColumnRenamed("anchors", "__anchors"))
        joined = docs.join(anchors, F.coalesce(F.col("lang").cast("string"), F.lit(NONE)) == F.col("__lang"), "left")
        facts = let(words, lambda w: F.struct(n_words(w).alias("tokens"), topic_of(w, F.col("__anchors")).alias("topic")))
        counted = joined.select(*docs.columns, facts.alias("__f")).select(*names, F.col("__f.topic").alias("topic"), F.col("__f.tokens").alias("tokens"))
    counted = materialise(counted, "mix-counted")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in DIMENSIONS]
    cells = materialise(counted.select(*keys, "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    if targets:
        check_targets(cells, targets)
    targets = targets or {d: tempered(cells, d, TEMPER[d]) for d in DIMENSIONS}
    weights = materialise(calibrate(rake(cells, targets)[0], budget), "mix-weights")
    side = weights.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], "weight", "probability")
    match = [F.coalesce(F.col(d).cast("string"), F.lit(NONE)) == F.col(f"__{d}") for d in DIMENSIONS]
    has_words = F.col("tokens") > 0
    joined = counted.join(maybe_broadcast(side, 100_000), match, "left")
    weight, p = (F.when(has_words, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0)) for c in ("weight", "probability"))
    return joined.select(*counted.columns, weight.alias("weight"), p.alias("probability"), (uniform(F.col(doc_id), seed) < p).alias("sampled"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs, keep=("doc_id", "source", "lang")).select("doc_id", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "sampled")


#: Sweeps of the SQL, which has no loop that ends on a tolerance: more than the operator takes.
SQL_SWEEPS = 16


def _sweep_sql() -> str:
    parts, last = [], "r0"
    for s in range(SQL_SWEEPS):
        for d in DIMENSIONS:
            name = f"r{s}_{d}"
            parts.append(f"{name} AS MATERIALIZED (SELECT * REPLACE (raked * target_{d} / sum(raked) OVER (PARTITION BY {d}) AS raked) FROM {last})")
            last = name
    return ",\n".join(parts) + f",\nlast AS (SELECT * FROM {last})"


def _target_sql(d: str) -> str:
    return f"t_{d} AS (SELECT {d}, pow(t, {TEMPER[d]}) / sum(pow(t, {TEMPER[d]})) OVER () AS target_{d} FROM (SELECT {d}, sum(tokens) AS t FROM cells GROUP BY {d}) WHERE t > 0)"


OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang FROM documents),
c AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(lower(text), '{WORD}') AS words FROM d),
x AS (SELECT rid, lang, unnest(words) AS word FROM c),
df AS (SELECT lang, word, count(DISTINCT rid) AS df FROM x GROUP BY lang, word),
anchors AS (SELECT * FROM (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY df DESC, word) AS k FROM df JOIN (SELECT lang, count(*) AS size FROM d GROUP BY lang) USING (lang) WHERE df * {COMMON} <= size) WHERE k <= {TOPICS}),
topics AS (SELECT rid, 'topic-' || arg_min(k, (-n, k)) AS topic FROM (SELECT rid, k, count(*) AS n FROM x JOIN anchors USING (lang, word) GROUP BY rid, k) GROUP BY rid),
k AS (SELECT doc_id, source, lang, len(words) AS tokens, coalesce(topic, '{OTHER}') AS topic FROM c LEFT JOIN topics USING (rid)),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens FROM k GROUP BY ALL),
{', '.join(_target_sql(d) for d in DIMENSIONS)},
r0 AS (SELECT *, CAST(tokens AS DOUBLE) AS raked FROM cells JOIN t_source USING (source) JOIN t_lang USING (lang) JOIN t_topic USING (topic)),
{_sweep_sql()},
w AS (SELECT source, lang, topic, CAST(tokens AS DOUBLE) AS tokens, (raked / sum(raked) OVER ()) / (tokens / sum(tokens) OVER ()) AS weight FROM last WHERE tokens > 0),
q AS (SELECT *, row_number() OVER o AS rank, ({BUDGET} * sum(tokens) OVER () - (sum(tokens) OVER o - tokens)) / (sum(tokens * weight) OVER () - (sum(tokens * weight) OVER o - tokens * weight)) AS c FROM w WINDOW o AS (ORDER BY weight DESC, source, lang, topic ROWS UNBOUNDED PRECEDING)),
f AS (SELECT arg_min(c, rank) AS c FROM q WHERE c * weight <= 1)
SELECT doc_id, k.topic, CAST(k.tokens AS BIGINT) AS tokens, round(coalesce(weight, 0), 6) AS weight, round(coalesce(least(1.0, f.c * weight), 0), 6) AS probability,
  CAST(CAST(('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496 < coalesce(least(1.0, f.c * weight), 0) AS sampled
FROM k LEFT JOIN w ON k.source = w.source AND k.lang = w.lang AND k.topic = w.topic AND k.tokens > 0 CROSS JOIN f
"""
