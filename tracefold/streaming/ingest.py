"""Structured Streaming ingest: audit events to merged edges, batch by batch.

An extension: merging is associative (minimum, maximum, count, sum), so every micro-batch leaves its
own merged edges and process starts under its batch id, and the graph at any time is the merge of
those. A batch that is run again overwrites its own folders.

An event counts once, however late it or its repetition comes: a batch drops the ids that earlier
batches hold, and as a repeated event has the time of the first one, only the days that occur in the
batch are read. Nothing is dropped for being late; events that come more than ``lateness`` behind the
latest time of earlier batches are merged like all others and listed under ``late`` besides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracefold.operators.graph import flow_edges, merge_edges
from tracefold.sources.audit import audit_events, lineage_of_days, process_days
from tracefold.storage import cut, release

EDGES = "src string, dst string, op string, first_ts long, last_ts long, n long, amount double"
IDS, DAYS, MARKS = "event_id long, ts long", "user_id long, proc string, ts long", "latest long"


def _table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """All batches of one table; none are written yet if the folder is absent."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/{name}")


def start_merge(events: DataFrame, path: str, lateness: str = "1 day", available_now: bool = True) -> StreamingQuery:
    """Merge a stream of the ``events`` table into ``path``."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).dropDuplicates(["event_id"]), "stream-batch")
        days = [r.day for r in rows.select(day_of("us").alias("day")).distinct().collect()]  # days, not events
        known = _table(spark, path, "ids", IDS + ", batch long, day string").filter((F.col("batch") < batch_id) & F.col("day").isin(days))
        fresh = cut(rows.join(known.select("event_id"), "event_id", "left_anti"), "stream-fresh")
        latest = _table(spark, path, "marks", MARKS + ", batch long").filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        if latest is not None:
            behind = F.unix_micros(F.timestamp_micros(F.lit(latest)) - F.expr(f"INTERVAL {lateness}"))
            write(fresh.filter(F.col("us") < behind).drop("us"), "late")
        audit = audit_events(fresh.drop("us"))
        write(merge_edges(flow_edges(audit)), "edges")
        write(process_days(audit), "days")
        write(fresh.agg(F.max("us").alias("latest")), "marks")
        fresh.select("event_id", F.col("us").alias("ts")).withColumn("day", day_of("ts")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/ids/batch={batch_id}")
        release(rows, fresh)

    writer = events.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def day_of(us: str):
    return F.date_format(F.timestamp_micros(us), "yyyyMMdd")


def late_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events that came late, with the batch that brought them."""
    return _table(spark, path, "late", schema + ", batch long")


def merged_so_far(spark: SparkSession, path: str) -> DataFrame:
    """Merged edges of all batches, lineage included."""
    parts = _table(spark, path, "edges", EDGES + ", batch long").select(*[c.split()[0] for c in EDGES.split(", ")])
    days = _table(spark, path, "days", DAYS + ", batch long").groupBy("user_id", "proc").agg(F.min("ts").alias("ts"))
    rows = parts.unionByName(merge_edges(lineage_of_days(days)))
    return rows.groupBy("src", "dst", "op").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def events_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over Parquet files of the ``events`` table; ``path`` is a file or a folder."""
    schema = spark.read.parquet(path).schema
    # a file source takes folders and patterns only, so the name becomes a pattern that matches itself
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
