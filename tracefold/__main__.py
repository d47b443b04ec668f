"""``python -m tracefold LOG POI [--format json|text|parquet] [--communities lineage|learned] [--out FOLDER]``

Traces the causal history of the node POI (at its last event) through the audit log and writes
communities, paths and graphs.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tracefold.operators.graph import flow_edges
from tracefold.plans.summarise import summarise, write_summary
from tracefold.sources.audit import read_audit_log
from tracefold.storage import clean


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tracefold", description=__doc__)
    parser.add_argument("log")
    parser.add_argument("poi")
    parser.add_argument("--format", default="json", choices=("json", "text", "parquet"))
    parser.add_argument("--communities", default="lineage", choices=("lineage", "learned"))
    parser.add_argument("--out", default="summary-out")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("tracefold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    events, bad = read_audit_log(spark, given.log, given.format)
    flow = flow_edges(events)
    poi = flow.filter(F.col("dst") == given.poi).agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select(F.lit(given.poi).alias("node"), "ts")
    if poi.isEmpty():
        raise SystemExit(f"no event reaches {given.poi!r}")
    write_summary(summarise(flow, poi, given.communities == "learned"), given.out)
    bad.write.mode("overwrite").text(f"{given.out}/quarantine")
    clean(spark)


if __name__ == "__main__":
    main()
