"""Connected components over an edge table, for cyclic and skewed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.storage import cut, cut_with, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges``.

    Alternates large-star and small-star steps until no edge changes: every node links its larger
    neighbours, then its smaller ones, to the smallest node it sees. Each step costs a row per edge at
    most and the rounds grow with the logarithm of the longest path. Minima are combined before the
    shuffle, and edges join them by node, so that a hub's edges can be split by skewed-join handling.
    Whether a round changed anything shows in a count and a hash sum taken while it is written.
    Null ends are ignored; loops give a component of one node; no edges, no rows.
    """
    all_edges = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    nodes = cut(all_edges.select(F.col("a").alias("node")).union(all_edges.select("b")).distinct(), "cc-nodes")
    marks = {"n": F.count("*"), "s": F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))}
    now, total = cut_with(all_edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc", **marks)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        before, last = total, now
        now, total = cut_with(small.filter("a != b").distinct(), "cc", **marks)
        release(last)
        if before == total:
            break
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("m")), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
