"""Shared plumbing of the training-data operators: tables, size-checked joins, salted joins, batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.storage import cut as materialise  # noqa: F401  the operators' name for it
from tracefold.storage import fresh_dir as fresh_dir

#: ASCII white space as the contracts define it (space and \t \n \v \f \r), for Java and RE2 classes.
SPACE_CLASS = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE_CLASS}]+"

#: Rows of (long or digest) keys that one broadcast may hold; beyond it joins of narrow rows shuffle.
BROADCAST_ROWS = 400_000
#: A key of over one in ``HOT_SHARE`` rows is hot: there are at most so many of them.
HOT_SHARE = 1000
BATCH_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def maybe_broadcast(side: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only if ``side`` (narrow rows) is counted and has at most ``limit`` rows."""
    limit = BROADCAST_ROWS if limit is None else min(limit, BROADCAST_ROWS)
    return F.broadcast(side) if side.limit(limit + 1).count() <= limit else side


def salted_join(rows: DataFrame, side: DataFrame, key: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``side`` on ``key``, without a task that gets all rows of a hot key.

    ``side`` has one row per key and ``n``, the number of ``rows`` with it. Keys of over ``total /
    HOT_SHARE`` rows are at most ``HOT_SHARE``: only their rows in ``side`` are repeated, and ``rows``
    of such a key are dealt out by a hash of ``spread``.
    """
    least = max(1000, total // HOT_SHARE)
    hot = side.filter(F.col("n") > least).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / least).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__salt", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("__hot", "__parts")
    repeated = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / least).cast("int"), F.lit(1)) - 1))).drop("n")
    return dealt.join(repeated, [key, "__salt"], how).drop("__salt")


def let(value: Column, body) -> Column:
    """Bind ``value`` to a name inside one expression, so that it is evaluated once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Words are maximal runs of anything but ASCII white space."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")


_kept: dict[str, Callable[[], None]] = {}


def keeps(operator: str, drop: Callable[[], None]) -> None:
    """This worker keeps state of ``operator`` between its tasks; ``drop`` frees it."""
    _kept[operator] = drop


def let_go(operator: str | None = None) -> None:
    """Free what this worker keeps for other operators: workers are reused, and would hold it all along."""
    others = [x for x in _kept if x != operator]
    for x in others:
        _kept.pop(x)()
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
            trim(0)


def pieces(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES, operator: str | None = None) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about ``most`` bytes of text at a time, one row at least.

    Spark bounds its batches by bytes (``spark.sql.execution.arrow.maxBytesPerBatch``); Python objects
    made of them take several times that, so that workers handle them in slices. What the worker keeps
    for any other than ``operator`` goes first.
    """
    let_go(operator)
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        flat, sizes = 0, np.zeros(batch.num_rows, dtype=np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                flat += column.nbytes
        ends, at = np.cumsum(sizes + (batch.nbytes - flat) // batch.num_rows), 0  # nested columns count by their mean
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
