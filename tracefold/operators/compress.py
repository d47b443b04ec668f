"""Compression: leaves, repetition groups, collapse.

Sets as grouping keys are never gathered: a set's signature is its size, the sum of one 64-bit hash of
its members and the exclusive or of another, which combine before the shuffle, so that a hub with
millions of partners costs a row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.labels import executable, node_type
from tracefold.operators.graph import accesses, lineage


def set_signature(member: Column) -> list[Column]:
    """Aggregates that identify a set of distinct members."""
    return [
        F.count("*").alias("set_size"),
        F.sum(F.xxhash64(member, F.lit(1)).cast("decimal(38,0)")).alias("set_sum"),
        F.bit_xor(F.xxhash64(member, F.lit(2))).alias("set_xor"),
    ]


SIGNATURE = ("set_size", "set_sum", "set_xor")


def leaf_nodes(merged: DataFrame) -> DataFrame:
    """(proc, leaf, type): resources adjacent to exactly one process."""
    only = accesses(merged).groupBy(F.col("resource").alias("leaf")).agg(F.count("*").alias("n"), F.min("proc").alias("proc")).filter("n = 1")
    return only.select("proc", "leaf", node_type(F.col("leaf")).alias("type"))


def leaf_groups(merged: DataFrame) -> DataFrame:
    """Per process its leaves, their number and the number of merged edges to and from them."""
    leaves = leaf_nodes(merged)
    edges = merged.select(F.explode(F.array("src", "dst")).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("edges"))
    return leaves.join(edges, "leaf").groupBy("proc").agg(
        F.concat_ws(",", F.array_sort(F.collect_list("leaf"))).alias("leaves"), F.count("*").alias("n_leaves"), F.sum("edges").alias("n_edges")
    )


def leaf_merge(merged: DataFrame) -> DataFrame:
    """(nid, rep): file leaves of a process collapse to the smallest label; network leaves stay."""
    files = leaf_nodes(merged).filter("type = 'f'")
    rep = files.groupBy("proc").agg(F.min("leaf").alias("rep"))
    return files.join(rep, "proc").select(F.col("leaf").alias("nid"), "rep")


def process_files(merged: DataFrame) -> DataFrame:
    """(proc, file) rows without leaves."""
    files = accesses(merged).filter(node_type(F.col("resource")) == "f")
    shared = files.groupBy("resource").agg(F.count("*").alias("n")).filter("n > 1").select("resource")
    return files.join(shared, "resource", "left_semi").select("proc", F.col("resource").alias("file"))


def proc_files(merged: DataFrame) -> DataFrame:
    return process_files(merged).groupBy("proc").agg(F.concat_ws(",", F.array_sort(F.collect_list("file"))).alias("files"), F.count("*").alias("n_files"))


def _numbered(members: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more: representative (smallest label) and sequence from 1."""
    sizes = members.groupBy(*keys).agg(F.min("nid").alias("rep"), F.count("*").alias("size")).filter("size > 1")
    seq = F.row_number().over(Window.partitionBy("rep").orderBy("nid"))
    return members.join(sizes, keys).withColumn("seq", seq.cast("long"))


def proc_groups(merged: DataFrame, files: DataFrame | None = None, parents: DataFrame | None = None) -> DataFrame:
    """(rep, seq, nid, parent, exe): processes of one parent and executable that access one set of
    non-leaf files. A process without a parent never groups."""
    files = process_files(merged) if files is None else files
    parents = lineage(merged) if parents is None else parents
    parent = parents.groupBy(F.col("child").alias("nid")).agg(F.min("parent").alias("parent"))
    signed = files.groupBy(F.col("proc").alias("nid")).agg(*set_signature(F.col("file")))
    members = parent.join(signed, "nid").withColumn("exe", executable(F.col("nid")))
    return _numbered(members, ["parent", "exe", *SIGNATURE]).select("rep", "seq", "nid", "parent", "exe")


def file_groups(merged: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(rep, seq, nid): non-leaf files accessed by one set of processes."""
    files = process_files(merged) if files is None else files
    signed = files.groupBy(F.col("file").alias("nid")).agg(*set_signature(F.col("proc")))
    return _numbered(signed, list(SIGNATURE)).select("rep", "seq", "nid")


def collapse_map(merged: DataFrame) -> DataFrame:
    """(nid, rep) of every node that a representative replaces."""
    maps = [leaf_merge(merged), proc_groups(merged).select("nid", "rep"), file_groups(merged).select("nid", "rep")]
    return maps[0].unionByName(maps[1]).unionByName(maps[2]).filter("nid != rep")


def collapse(merged: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with members replaced by representatives, merged again."""
    m = mapping.select("nid", "rep")
    src = merged.join(m.select(F.col("nid").alias("src"), F.col("rep").alias("src_rep")), "src", "left")
    both = src.join(m.select(F.col("nid").alias("dst"), F.col("rep").alias("dst_rep")), "dst", "left")
    renamed = both.select(F.coalesce("src_rep", "src").alias("src"), F.coalesce("dst_rep", "dst").alias("dst"), "op", "first_ts", "last_ts", "n", "amount")
    return renamed.groupBy("src", "dst", "op").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n").alias("n"), F.sum("amount").alias("amount"))


def compression_stats(merged: DataFrame, collapsed: DataFrame) -> DataFrame:
    """Nodes and edges before and after collapse."""
    parts = []
    for name, edges in (("before", merged), ("after", collapsed)):
        parts.append(edges.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("value")).withColumn("name", F.lit(f"nodes_{name}")))
        parts.append(edges.agg(F.count("*").alias("value")).withColumn("name", F.lit(f"edges_{name}")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = ("nodes_before", "edges_before", "nodes_after", "edges_after")
    one = rows.agg(*[F.max(F.when(F.col("name") == x, F.col("value"))).alias(x) for x in names])
    return one.select("*", F.round(F.col("nodes_after") / F.col("nodes_before"), 6).alias("node_ratio"), F.round(F.col("edges_after") / F.col("edges_before"), 6).alias("edge_ratio"))
