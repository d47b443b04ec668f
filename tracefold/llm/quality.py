"""Quality rules: a threshold table compiled into one native projection.

Every metric is a built-in expression over the whole text; rules are rows of a table that compile
to boolean columns of the same projection. No shuffle, no user function.

Defined results: a null text has no words, an empty text likewise; both fail ``n_words``. Null ids
and repeated rows pass through row by row. Extra columns stay; the operator's own columns replace
columns of the same name. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import SPACE_CLASS, WORD, let, table, text_or_empty, words_of

#: Frequent function words of the corpus languages.
STOP_WORDS = (
    "a and are as at be by for from has he in is it of on or that the they this to was were with "
    "der die das und den dem des ein eine ist nicht mit auf für von zu im als sich "
    "le la les de du des et en un une est que pour dans qui par sur pas au ce "
    "el los las del y una por con para como se al lo más su"
).split()

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Passes while ``low <= metric <= high``; applies only to texts of ``from_words`` words or more."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0


#: The base rules come first; the rest are the method's own.
RULES = (
    Rule("length", "n_words", low=10),
    Rule("repetition", "repeat_ratio", high=0.20),
    Rule("word_length", "mean_word_chars", low=1.5, high=20.0, from_words=10),
    Rule("symbols", "symbol_ratio", high=0.10),
    Rule("stop_words", "stop_ratio", low=0.03, from_words=50),
    Rule("lines", "dup_line_ratio", high=0.50),
)
BASE_RULES = ("length", "repetition")


def _repeated_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice in ``windows``."""

    def covered(pairs: Column) -> Column:
        at = lambda j, field: F.get(pairs, j)[field]
        same = lambda j, k: F.coalesce(at(j, "h") == at(k, "h"), F.lit(False))
        hit = F.filter(
            F.transform(
                F.sequence(F.lit(0), F.size(pairs) - 1),
                lambda j: F.when(same(j, j - 1) | same(j, j + 1), at(j, "i")),
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            F.sort_array(hit),
            lambda p: F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0).cast("long"),
                lambda acc, k: acc + F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - F.get(p, k)), F.lit(WINDOW)),
            ),
        )

    # most texts repeat no window: a hash set tells that without sorting
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
        let(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered)
    )


def metrics(text: Column) -> Column:
    """One struct of all counts of ``text``; each intermediate array is built once per row."""

    def of_words(words: Column) -> Column:
        windows = let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.transform(
                F.sequence(F.lit(0), F.size(h) - WINDOW),
                lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]),
            ),
        )
        repeated = F.when(F.size(words) > WINDOW, let(windows, _repeated_words)).otherwise(F.lit(0).cast("long"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            repeated.alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    of_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    return F.struct(
        let(words_of(text), of_words).alias("w"),
        of_lines.alias("l"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )


def _count(m: Column, name: str) -> Column:
    return m["n_symbols"] if name == "n_symbols" else m["l" if name in ("n_lines", "n_dup_lines") else "w"][name]


def ratios(m: Column) -> dict[str, Column]:
    """The metrics that rules refer to, of a struct made by ``metrics``."""
    n = F.greatest(_count(m, "n_words"), F.lit(1))
    return {
        "n_words": _count(m, "n_words"),
        "repeat_ratio": _count(m, "n_repeat_words") / n,
        "mean_word_chars": _count(m, "word_chars") / n,
        "symbol_ratio": _count(m, "n_symbols") / n,
        "stop_ratio": _count(m, "n_stop_words") / n,
        "dup_line_ratio": _count(m, "n_dup_lines") / F.greatest(_count(m, "n_lines"), F.lit(1)),
    }


def passes(rule: Rule, m: Column) -> Column:
    if rule.name == "repetition":  # in whole numbers, exactly as the base rule is stated
        ok = 100 * _count(m, "n_repeat_words") <= 20 * _count(m, "n_words")
    else:
        metric = ratios(m)[rule.metric]
        ok = F.lit(True)
        if rule.low is not None:
            ok = ok & (metric >= F.lit(rule.low))
        if rule.high is not None:
            ok = ok & (metric <= F.lit(rule.high))
    return ok | (_count(m, "n_words") < rule.from_words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One struct of counts, ``base_failed`` and ``failed_rules``.

    The counts are bound once inside the expression, so that a filter on the verdict, which the
    optimizer moves below the projection, doesn't count again for every rule.
    """

    def judged(m: Column) -> Column:
        failed = F.filter(F.array(*[F.when(~passes(r, m), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        base = F.lit(False)
        for r in rules:
            if r.name in BASE_RULES:
                base = base | ~passes(r, m)
        return F.struct(*[_count(m, c).alias(c) for c in COUNTS], base.alias("base_failed"), failed.alias("failed_rules"))

    return let(metrics(text), judged)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``failed_rules``, ``base_failed`` and ``kept`` beside its own columns."""
    own = (*COUNTS, "base_failed", "failed_rules", "kept")
    rest = [c for c in docs.columns if c not in own]
    judged = docs.select(*[docs[c] for c in rest], verdict(text_or_empty(text), rules).alias("__q"))
    return judged.select(*rest, *[F.col(f"__q.{c}").alias(c) for c in own[:-1]], (F.size("__q.failed_rules") == 0).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos
      FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS words FROM d)),
g AS (SELECT rid, pos, word, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN
        word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS gram
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY pos)),
f AS (SELECT rid, pos, CASE WHEN gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 THEN 1 ELSE 0 END AS dup FROM g),
c AS (SELECT rid, max(dup) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM f),
r AS (SELECT rid, sum(hit) AS n_repeat_words FROM c GROUP BY rid),
s AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE lower(word) IN ({_STOP_SQL})) AS n_stop FROM w GROUP BY rid),
l AS (SELECT rid, len(x) AS n_lines, len(x) - len(list_distinct(x)) AS n_dup_lines
      FROM (SELECT rid, list_filter(string_split(text, chr(10)), lambda y: regexp_matches(y, '{WORD}')) AS x FROM d)),
m AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_stop, 0) AS n_stop, n_lines
      FROM d LEFT JOIN s USING (rid) LEFT JOIN r USING (rid) LEFT JOIN l USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND (word_chars / greatest(n_words, 1)) BETWEEN 1.5 AND 20 AND (n_symbols / greatest(n_words, 1)) <= 0.10
    AND (n_words < 50 OR (n_stop / greatest(n_words, 1)) >= 0.03) AND (n_dup_lines / greatest(n_lines, 1)) <= 0.50 AS kept
FROM m
"""
