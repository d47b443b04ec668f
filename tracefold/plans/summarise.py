"""The whole run: events and a point of interest to communities, compressed and summarised."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators import causality, community, compress, graph, summary
from tracefold.storage import cut
from tracefold.sources import sinks


@dataclass(frozen=True)
class Summary:
    merged: DataFrame
    nodes: DataFrame
    collapsed: DataFrame
    members: DataFrame
    edges: DataFrame
    ranked: DataFrame
    links: DataFrame
    communities: DataFrame
    numbers: DataFrame


def collapsed_communities(communities: DataFrame, mapping: DataFrame) -> DataFrame:
    """(community, proc) with processes replaced by their representatives."""
    reps = mapping.select(F.col("nid").alias("proc"), "rep")
    return communities.join(reps, "proc", "left").select("community", F.coalesce("rep", "proc").alias("proc")).distinct()


def summarise(flow: DataFrame, poi: DataFrame, learned: bool = False, max_edges: int | None = None) -> Summary:
    """``flow``: (src, dst, op, ts, amount); ``poi``: one row (node, ts). Communities follow lineage, or
    are learned from walks with ``learned``."""
    merged = cut(graph.merge_edges(causality.causal_edges(flow, poi)), "merged")
    mapping = cut(compress.collapse_map(merged), "collapse-map")
    collapsed = cut(compress.collapse(merged, mapping), "collapsed")
    found = community.learned_communities(merged) if learned else community.lineage_communities(merged)
    members = cut(community.membership(collapsed, collapsed_communities(found, mapping)), "members")
    edges = cut(graph.induced(collapsed, members), "community-edges")
    inputs, outputs = summary.infopath_inputs(members, edges, poi), summary.infopath_outputs(members, edges, poi)
    ranked = cut(summary.infopath_rank(summary.best_paths(summary.edge_weights(edges, poi), inputs, outputs, max_edges)), "ranked")
    return Summary(
        merged=merged, nodes=cut(graph.node_ids(graph.nodes(merged)), "nodes"), collapsed=collapsed, members=members, edges=edges, ranked=ranked,
        links=summary.summary_edges(members, edges), communities=summary.community_summary(members, edges, ranked), numbers=cut(sinks.community_numbers(members, edges), "numbers"),
    )


def write_summary(result: Summary, path: str) -> None:
    """All outputs under ``path``: node, leaf, group and file tables of the whole graph, and the graph of
    every community, their graph, text summary and members after collapse."""
    text = lambda lines, name: lines.select("line").write.mode("overwrite").text(f"{path}/{name}")
    numbered = lambda df: df.join(result.numbers, "community").drop("community").withColumnRenamed("number", "community")
    sinks.write_nodes(result.nodes, f"{path}/nodes")
    text(sinks.leaf_lines(result.merged, result.nodes), "leaves")
    sinks.write_groups(sinks.group_table(result.merged, result.nodes), f"{path}/groups")
    text(sinks.process_file_lines(result.merged, result.nodes), "process_files")
    sinks.write_lines(numbered(sinks.community_dot_lines(result.members, result.edges, result.nodes)), f"{path}/communities")
    sinks.write_summary_dot(result.links, result.numbers, f"{path}/summary_graph")
    lines = sinks.summary_lines(summary.master_process(result.members, result.edges), summary.time_span(result.edges), result.ranked, result.numbers)
    sinks.write_lines(lines, f"{path}/summary", by=None, order=("number", "line_no"))
    sinks.write_lines(sinks.membership_lines(result.members, result.numbers), f"{path}/membership", by=None, order=("number",))
