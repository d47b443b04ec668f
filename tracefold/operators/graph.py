"""Graph construction: flow edges, merging, parallel-edge keys, nodes, degrees, induced subgraphs.

Nodes are keyed by their label. Edges are directed by data or control flow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.labels import BETWEEN_PROCESSES, BOTH_WAYS, FROM_PROCESS, INTO_PROCESS, attribute_1, attribute_2, node_type
from tracefold.storage import bounded_broadcast, cut

#: A node of more communities than these meets edges by its other end.
MANY = 4


def flow_edges(audit: DataFrame) -> DataFrame:
    """(src, dst, op, ts, amount) rows; a rename makes two, unknown operations none."""
    edge = lambda a, b: F.struct(a.alias("src"), b.alias("dst"))
    proc, thing, renamed, op = F.col("proc"), F.col("object"), F.col("object2"), F.col("op")
    ends = (
        F.when(op.isin(*INTO_PROCESS), F.array(edge(thing, proc)))
        .when(op.isin(*FROM_PROCESS, *BETWEEN_PROCESSES), F.array(edge(proc, thing)))
        .when(op.isin(*BOTH_WAYS), F.array(edge(thing, proc), edge(proc, renamed)))
    )
    return audit.select(F.explode(ends).alias("e"), "op", "ts", "amount").select("e.src", "e.dst", "op", "ts", "amount")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, op) with its interval, count and total amount."""
    return edges.groupBy("src", "dst", "op").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.sum("amount").alias("amount"))


def edge_keys(merged: DataFrame) -> DataFrame:
    """``key`` numbers the different operations of a pair from 0, in alphabetical order."""
    order = Window.partitionBy("src", "dst").orderBy("op")
    return merged.withColumn("key", (F.row_number().over(order) - 1).cast("long"))


def ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("label")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """(label, attr1, attr2, type) of every end of ``edges``."""
    label = F.col("label")
    return ends(edges).select("label", attribute_1(label).alias("attr1"), attribute_2(label).alias("attr2"), node_type(label).alias("type"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, numbers from 1 by ``order`` within each of ``keys``.

    Rows are range-partitioned once; numbers are the rank within a partition plus the sizes of the
    partitions before it, so that no task sees a whole key. Only keys that span partitions have such
    sizes, two rows a partition at most, which bounds the broadcast.
    """
    placed = cut(rows.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__part", F.sum("__size").over(before).alias("__offset")).filter("__offset IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
    found = placed.withColumn(name, rank).join(F.broadcast(offsets), [*keys, "__part"], "left")
    return found.select(*rows.columns, (F.col(name) + F.coalesce("__offset", F.lit(0))).alias(name))


def node_ids(all_nodes: DataFrame) -> DataFrame:
    """``nid``: type letter and a dense number by label, one counter per type."""
    found = numbered(all_nodes, ["type"], ["label"], "rank")
    return found.select(F.concat("type", F.col("rank").cast("string")).alias("nid"), "label", "attr1", "attr2", "type")


def degree(merged: DataFrame) -> DataFrame:
    """Distinct in- and out-neighbours of every node."""
    pairs = merged.select("src", "dst").distinct()
    out = pairs.select(F.col("src").alias("label"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = pairs.select(F.col("dst").alias("label"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("label").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def lineage(merged: DataFrame) -> DataFrame:
    """(parent, child) process pairs."""
    return merged.filter(F.col("op").isin(*BETWEEN_PROCESSES)).select(F.col("src").alias("parent"), F.col("dst").alias("child")).distinct()


def access_edges(merged: DataFrame) -> DataFrame:
    """Edges between a process and a resource, with both as ``proc`` and ``resource``."""
    src_is_process = node_type(F.col("src")) == "p"
    dst_is_process = node_type(F.col("dst")) == "p"
    return merged.filter(src_is_process != dst_is_process).select(
        F.when(src_is_process, F.col("src")).otherwise(F.col("dst")).alias("proc"), F.when(src_is_process, F.col("dst")).otherwise(F.col("src")).alias("resource"), *merged.columns
    )


def accesses(merged: DataFrame) -> DataFrame:
    """(proc, resource) pairs, whatever the direction."""
    return access_edges(merged).select("proc", "resource").distinct()


def induced(merged: DataFrame, membership: DataFrame, unique: bool = False) -> DataFrame:
    """Edges of each community: both ends are its members. ``unique``: no member repeats.

    An edge meets the communities of the end that has fewer of them, and of those the ones that hold the
    other end stay. So an edge between a process of one community and a file of a million costs one row.
    Only nodes of over ``MANY`` communities are told apart by their number.
    """
    member = membership.select("community", "nid")
    member = member if unique else member.distinct()
    many = cut(member.groupBy("nid").agg(F.count("*").alias("n")).filter(F.col("n") > MANY), "held-by-many")
    side = lambda end: bounded_broadcast(many.select(F.col("nid").alias(end), F.col("n").alias(f"__{end}")))
    known = merged.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    of_src = F.coalesce("__src", F.lit(0)) <= F.coalesce("__dst", F.lit(0))
    out = []
    for near, far, chosen in (("src", "dst", of_src), ("dst", "src", ~of_src)):
        met = known.filter(chosen).select(*merged.columns).join(member.withColumnRenamed("nid", near), near)
        out.append(met.join(member.withColumnRenamed("nid", far), ["community", far], "left_semi").select("community", *merged.columns))
    return out[0].unionByName(out[1])
