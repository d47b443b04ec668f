"""Shared storage of a run: folders for intermediate tables, lineage cuts, and their removal.

Intermediate tables lie under one folder per application inside ``spark.checkpoint.dir``, which driver
and executors share, so that a lost executor loses none of them. ``clean`` removes that folder when its
results have been written elsewhere; loops ``release`` a round's table when the next one replaces it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of narrow keys that one broadcast may hold.
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI without trailing slash.

    Reads ``spark.checkpoint.dir``. Where it is unset, a local master gets a temporary folder and
    anything else is an error: executors of a cluster don't see each other's local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_shared_dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracefold-")
        spark._shared_dir = root
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/") if "://" in root else "file://" + root.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tracefold-{spark.sparkContext.applicationId}"


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "step") -> DataFrame:
    """Write to the shared folder and read back: lineage ends here and survives lost executors."""
    path = fresh_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._cut_at = path
    return back


def cut_with(df: DataFrame, label: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``cut``, and aggregates of the rows taken while they are written. Null or absent ones are 0."""
    seen = Observation()
    back = cut(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]), label)
    found = seen.get
    return back, {name: found.get(name) or 0 for name in metrics}


def bounded_broadcast(side: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if ``side`` (narrow rows) is counted and has at most ``limit`` rows."""
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete the tables that ``cut`` wrote for ``frames``, which nothing reads any more."""
    for frame in frames:
        if path := getattr(frame, "_cut_at", None):
            delete(frame.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Frames built on them can't be read after it."""
    delete(spark, run_dir(spark))
