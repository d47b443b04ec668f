"""Causality: backward closure from a point of interest under time order, and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.storage import cut, cut_with, release


def backward_bounds(edges: DataFrame, poi: DataFrame) -> DataFrame:
    """(node, bound): the latest time at which the node could still influence the point of interest.

    ``bound(poi) = its time``; an event u -> v at or before ``bound(v)`` raises ``bound(u)`` to its
    time. Only nodes whose bound rose take part in the next round, and events later than the point of
    interest never do. Rounds go on until no bound rises, which ends as bounds are event times; the
    fixpoint doesn't depend on their order.
    """
    latest = poi.agg(F.max("ts")).first()[0]
    if latest is None:
        return poi.select("node", F.col("ts").alias("bound"))
    usable = cut(edges.filter(F.col("ts") <= latest).select("src", "dst", "ts").distinct(), "usable")
    bounds = cut(poi.groupBy("node").agg(F.max("ts").alias("bound")), "bounds")
    frontier = bounds
    while True:
        raised = usable.join(frontier, usable.dst == frontier.node).filter("ts <= bound").groupBy(F.col("src").alias("node")).agg(F.max("ts").alias("new"))
        moved = raised.join(bounds, "node", "left").filter("bound IS NULL OR new > bound").select("node", F.col("new").alias("bound"))
        frontier, seen = cut_with(moved, "frontier", n=F.count("*"))
        if not seen["n"]:
            return bounds
        last = bounds
        bounds = cut(bounds.unionByName(frontier).groupBy("node").agg(F.max("bound").alias("bound")), "bounds")
        release(last)


def causal_edges(edges: DataFrame, poi: DataFrame) -> DataFrame:
    """Events that can have influenced the point of interest. Merge them afterwards: an interval can't
    tell which of its events is early enough."""
    bounds = backward_bounds(edges, poi)
    return edges.join(bounds, edges.dst == bounds.node).filter("ts <= bound").select(*edges.columns)


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, hops): nodes reachable from each root and the fewest hops; the root itself is 0."""
    pairs = cut(edges.select("src", "dst").distinct(), "pairs")
    found = cut(roots.select(F.col("node").alias("root"), F.col("node")).distinct().withColumn("hops", F.lit(0)), "reach")
    frontier, hop = found, 0
    while True:
        hop += 1
        step = frontier.join(pairs, frontier.node == pairs.src).select("root", F.col("dst").alias("node")).distinct()
        frontier, seen = cut_with(step.join(found, ["root", "node"], "left_anti").withColumn("hops", F.lit(hop)), "reach", n=F.count("*"))
        if not seen["n"]:
            return found
        last = found
        found = cut(found.unionByName(frontier), "reach")
        release(last)
