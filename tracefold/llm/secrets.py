"""Secret scans over an incremental blob ledger, with DataFrame operations only.

Every historical version of every path is addressed by the SHA-256 of its content. The ledger holds
the (blob, rule, rule version) triples already scanned and their findings. A scan takes the triples
that the ledger lacks, fetches one text per such blob (the version with the smallest path), runs
only the missing rules over it, appends both tables, and joins findings back to all paths.

Shuffles: one of narrow (path, blob) rows; one of texts on the unique (path, blob) pair, which hot
content can't skew; one of narrow rows to their findings, salted for blobs that many paths hold.

Spans are code points, end exclusive. They follow from the pieces between the matches, because
``split`` and ``regexp_extract_all`` find the same leftmost matches.

Defined results: null text counts as empty. Null paths are allowed and compare equal. Repeated rows
give repeated rows. An empty table adds nothing to the ledger and returns no rows. A very long text is
one row, scanned whole. Columns of the input other than path and text, whatever their names, are not
carried. A rule edit needs a new version; old findings stay in the ledger and are not reported.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import fresh_dir, let, materialise, salted_join, table
from tracefold.storage import cut_with, release


@dataclass(frozen=True)
class SecretRule:
    """``group`` of the match needs ``least`` characters; shorter matches are consumed and dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: str = "1"
    base: bool = False


#: What the name of an assigned secret ends in, letters in either case.
KEYWORDS = ("[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]", "[Pp][Aa][Ss][Ss][Ww][Dd]", "[Ss][Ee][Cc][Rr][Ee][Tt]", "[Tt][Oo][Kk][Ee][Nn]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
ASSIGN = "(" + "|".join(KEYWORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For access keys and hex runs a failing match reaches to the end of its run, where no longer one
#: can start, so the least length can stand in the pattern.
RULES = (
    SecretRule("assign", ASSIGN, group=2, least=6, base=True),
    SecretRule("access", "AKIA[A-Z0-9]{16,}", least=20, base=True),
    SecretRule("hex", "[0-9a-f]{24,}", least=24, base=True),
    SecretRule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    SecretRule("vcs_token", "gh[opsu]_[A-Za-z0-9]{36}"),
)

#: The rules before the last edit of the table: ``vcs_token`` knew one prefix and the other two kinds were not there.
FIRST_RULES = (*(r for r in RULES if r.base), SecretRule("vcs_token", "ghp_[A-Za-z0-9]{36}", version="0"))

SPAN = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: SecretRule) -> Column:
    """Array of (start, end) of the rule's matches in ``text``; texts without any are only tested."""
    pattern = F.lit(rule.pattern)

    def walk(parts: Column, found: Column, values: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(parts, i))
            end = start + F.length(F.get(found, i))
            long_enough = F.length(F.get(values, i)) >= rule.least
            one = F.array(F.struct(start.alias("start"), end.alias("end")))
            return F.struct(end.alias("at"), F.when(long_enough, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda acc: acc["out"])

    matched = let(
        F.split(text, rule.pattern, -1),
        lambda parts: let(
            F.regexp_extract_all(text, pattern, F.lit(0)),
            lambda found: let(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda values: walk(parts, found, values)),
        ),
    )
    return F.when(text.rlike(rule.pattern), matched).otherwise(F.array().cast(SPAN))


class BlobLedger:
    """Two append-only Parquet tables under ``path``; a commit is one sub-folder of each."""

    SEEN = "blob string, rule string, rule_version string"
    FINDINGS = "blob string, rule string, rule_version string, start int, end int"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        exists = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if exists else self.spark.createDataFrame([], schema)

    def seen(self) -> DataFrame:
        return self._read("seen", self.SEEN)

    def findings(self) -> DataFrame:
        return self._read("findings", self.FINDINGS)

    def append(self, scanned: DataFrame) -> None:
        """``scanned``: (blob, rules, found). Findings go first, so a crash between leaves pairs unseen
        and the next scan repeats them; ``findings`` of a triple are read as a set."""
        scanned.select("blob", F.explode("found").alias("f")).select("blob", "f.rule", "f.rule_version", "f.start", "f.end").write.mode("append").parquet(f"{self.path}/findings")
        scanned.select("blob", F.explode("rules").alias("r")).select("blob", "r.rule", "r.rule_version").write.mode("append").parquet(f"{self.path}/seen")


_FOUND = "array<struct<rule:string,rule_version:string,start:int,end:int>>"


def _found_by(rule: SecretRule) -> Column:
    """Findings of one rule in ``text``, none unless ``rules`` lists it."""
    due = F.exists("rules", lambda x: (x["rule"] == rule.kind) & (x["rule_version"] == rule.version))
    own = lambda s: F.struct(F.lit(rule.kind).alias("rule"), F.lit(rule.version).alias("rule_version"), s["start"].alias("start"), s["end"].alias("end"))
    return F.when(due, F.transform(spans(F.col("text"), rule), own)).otherwise(F.array().cast(_FOUND))


def scan_versions(versions: DataFrame, ledger: BlobLedger, rules: tuple[SecretRule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """(path, blob, found) for every row of ``versions``; ``found`` holds rule, start, end in order."""
    spark = versions.sparkSession
    texts = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    paths, seen = cut_with(texts.select("path", "blob"), "blob-paths", n=F.count("*"))
    blobs = materialise(paths.groupBy("blob").agg(F.min("path").alias("owner"), F.count("*").alias("n")), "blob-owners")

    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("rule_version")) for r in rules])
    done = ledger.seen().distinct().groupBy("blob").agg(F.collect_set(F.struct("rule", "rule_version")).alias("done"))
    unseen = (
        blobs.join(done, "blob", "left")
        .select("blob", "owner", F.array_except(wanted, F.coalesce("done", F.array().cast("array<struct<rule:string,rule_version:string>>"))).alias("rules"))
        .filter(F.size("rules") > 0)
    )
    picked = texts.join(unseen.withColumnRenamed("blob", "b"), F.col("path").eqNullSafe(F.col("owner")) & (F.col("blob") == F.col("b")))
    found = F.flatten(F.array(*[_found_by(r) for r in rules]))
    scanned = materialise(picked.select("blob", "rules", found.alias("found")), "blob-scan")
    ledger.append(scanned)
    release(scanned)

    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}\x00{r.version}"), F.lit(k))])
    current = ledger.findings().withColumn("k", F.element_at(order, F.concat_ws("\x00", "rule", "rule_version"))).filter("k IS NOT NULL").distinct()
    per_blob = current.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", "k", "end", "rule"))).alias("found"))
    held = materialise(per_blob.join(blobs.select("blob", "n"), "blob"), "blob-findings")
    back = salted_join(paths, held, "blob", seen["n"], "path", "left")
    none = F.array().cast("array<struct<start:int,k:int,end:int,rule:string>>")
    return back.select("path", "blob", F.transform(F.coalesce("found", none), lambda x: F.struct(x["rule"].alias("rule"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("found", lambda x: x["rule"] == kind)).cast("long").alias(f"n_{kind}")


def history(docs: DataFrame) -> DataFrame:
    """(path, text): the versions of every document, its first line as ``<id>@0`` and the whole text as ``<id>@1``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    versions = F.array(F.struct(F.lit("@0").alias("v"), F.substring_index(text, "\n", 1).alias("text")), F.struct(F.lit("@1").alias("v"), text.alias("text")))
    return docs.select("doc_id", F.explode(versions).alias("x")).select(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "x.v").alias("path"), "x.text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans on one ledger: the first versions under the first rules, then all versions under the
    rules of today, which scans new blobs by all rules and known ones by new rules and versions only."""
    ledger, versions = BlobLedger(spark, fresh_dir(spark, "secret-ledger")), history(table(spark, sf_dir, "documents"))
    scan_versions(versions.filter(F.col("path").endswith("@0")), ledger, FIRST_RULES)
    found = scan_versions(versions, ledger).filter(F.col("path").endswith("@1"))
    base = [r.kind for r in RULES if r.base]
    return found.select(
        F.substring_index("path", "@", 1).try_cast("long").alias("doc_id"),
        *[_count_of(k) for k in base],
        F.sha2(joined(F.filter("found", lambda x: x["rule"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def _sql_matches(k: int, r: SecretRule) -> str:
    pattern = r.pattern.replace("'", "''")
    return f"""SELECT rid, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(text, '{pattern}') AS ms,
  regexp_extract_all(text, '{pattern}', {r.group}) AS vs, string_split_regex(text, '{pattern}') AS ps FROM d"""


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(_sql_matches(k, r) for k, r in enumerate(RULES))}),
i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT rid, k, kind, list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS b, length(ms[i]) AS n
  FROM i WHERE length(vs[i]) >= least),
t AS (SELECT rid, k, b, kind || ':' || CAST(CAST(b AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(b + n AS BIGINT) AS VARCHAR) AS span FROM s)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY b, k) FILTER (WHERE k < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY b, k), '') AS spans
FROM d LEFT JOIN t USING (rid) GROUP BY rid
"""
