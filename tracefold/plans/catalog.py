"""Registered queries of the provenance engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.functions.labels import file_stem, node_type
from tracefold.operators import causality, community, compress, graph, summary
from tracefold.operators.components import connected_components
from tracefold.storage import cut, fresh_dir
from tracefold.plans.oracles import ORACLES as ORACLES
from tracefold.sources import audit as source
from tracefold.sources import sinks
from tracefold.streaming import ingest

TOP_K = 5
AUDIT_COLUMNS = ("event_id", "ts", "proc", "object", "object2", "op", "amount")


class Graph:
    """The tables of one input. Those that several queries start from are written once, when the first
    of them asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def audit(self) -> DataFrame:
        return source.audit_events(self.table("events"))

    def flow(self) -> DataFrame:
        a = self.audit()
        return graph.flow_edges(a).unionByName(source.lineage_events(a))

    def merged(self) -> DataFrame:
        return graph.merge_edges(self.flow())

    def poi(self) -> DataFrame:
        return source.point_of_interest(self.audit())

    def kept(self, df: DataFrame, label: str) -> DataFrame:
        return cut(df, label)

    @cached_property
    def edges_all(self) -> DataFrame:
        return self.kept(self.merged(), "merged")

    @cached_property
    def labels(self) -> DataFrame:
        return community.label_propagation(self.edges_all)

    @cached_property
    def vectors(self) -> DataFrame:
        found = community.embed(community.random_walks(self.edges_all))
        return self.kept(found.filter(node_type(F.col("node")) == "p"), "vectors")

    @cached_property
    def counts(self) -> list[tuple[int, float]]:
        return community.cluster_counts(self.vectors)

    @cached_property
    def communities(self) -> DataFrame:
        return self.kept(community.lineage_communities(self.edges_all), "communities")

    @cached_property
    def members(self) -> DataFrame:
        return self.kept(community.membership(self.edges_all, self.communities, self.accessed), "members")

    @cached_property
    def accessed(self) -> DataFrame:
        return self.kept(community.accessed_edges(self.edges_all, self.communities), "accessed-edges")

    @cached_property
    def process_members(self) -> DataFrame:
        return self.kept(community.process_members(self.edges_all, self.communities), "process-members")

    def community_edges(self) -> DataFrame:
        """For one reader; what several read is ``inner``."""
        return community.community_edges(self.edges_all, self.communities, self.members, self.accessed)

    @cached_property
    def inner(self) -> DataFrame:
        return self.kept(self.community_edges(), "community-edges")

    @cached_property
    def at(self) -> DataFrame:
        return self.kept(self.poi(), "poi")

    @cached_property
    def inputs(self) -> DataFrame:
        return summary.infopath_inputs(self.members, self.inner, self.at)

    @cached_property
    def outputs(self) -> DataFrame:
        return summary.infopath_outputs(self.members, self.inner, self.at)

    @cached_property
    def paths(self) -> DataFrame:
        return summary.simple_paths(summary.edge_weights(self.inner, self.at), self.inputs, self.outputs)

    def pairs(self) -> DataFrame:
        return summary.infopath_pairs(self.inputs, self.outputs)

    def best(self) -> DataFrame:
        return summary.best_paths(summary.edge_weights(self.inner, self.at), self.inputs, self.outputs)

    @cached_property
    def ranked(self) -> DataFrame:
        return self.kept(summary.infopath_rank(self.best()), "ranked")


def _amount(df: DataFrame) -> DataFrame:
    return df.withColumn("amount", F.round("amount", 4))


def _text_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.array_join("path", " "))


def events_parse(g: Graph) -> DataFrame:
    """Audit rows rendered as tab-separated log lines and parsed again."""
    fields = [F.coalesce((F.timestamp_micros("ts") if c == "ts" else F.col(c)).cast("string"), F.lit("")) for c in AUDIT_COLUMNS]
    events, _ = source.parse_log(g.audit().select(F.concat_ws("\t", *fields).alias("value")), "text")
    return events.select(*AUDIT_COLUMNS)


def star_edges(g: Graph) -> DataFrame:
    """Region to nation to customer to order, and nation to supplier to part: a graph without cycles."""
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    parts = (
        ("nation", "r", "n_regionkey", "n", "n_nationkey"), ("customer", "n", "c_nationkey", "c", "c_custkey"), ("orders", "c", "o_custkey", "o", "o_orderkey"),
        ("supplier", "n", "s_nationkey", "s", "s_suppkey"), ("lineitem", "s", "l_suppkey", "p", "l_partkey"),
    )
    out = None
    for table, a, x, b, y in parts:
        rows = g.table(table).select(name(a, x).alias("src"), name(b, y).alias("dst"))
        out = rows if out is None else out.unionByName(rows)
    return out


def reachable(g: Graph) -> DataFrame:
    roots = g.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return causality.reachable(star_edges(g), roots)


def stream_merged_edges(g: Graph) -> DataFrame:
    """The events table as a stream, merged batch by batch."""
    path = fresh_dir(g.spark, "stream")
    ingest.start_merge(ingest.events_stream(g.spark, f"{g.dir}/events.parquet"), path).awaitTermination()
    return ingest.merged_so_far(g.spark, path)


def components(g: Graph) -> DataFrame:
    return connected_components(g.edges_all.select("src", "dst"))


def votes(communities: DataFrame) -> DataFrame:
    """Three experts' votes on every process, drawn by hash."""
    drawn = community.portable_hash(F.lit("vote"), F.col("proc"), F.col("expert")) % 3
    return communities.withColumn("expert", F.explode(F.array(*[F.lit(x) for x in "abc"]))).select(F.col("proc").alias("nid"), F.concat(F.lit("c"), drawn.cast("string")).alias("community"), "expert")


def community_f1(g: Graph) -> DataFrame:
    team = F.concat(F.lit("t"), F.floor(F.col("user_id") / 4).cast("string"))
    truth = g.audit().select(team.alias("community"), F.col("proc").alias("nid")).distinct()
    return community.community_f1(g.communities.withColumnRenamed("proc", "nid"), truth)


def embed(g: Graph) -> DataFrame:
    """A row per process and dimension."""
    return g.vectors.select("node", F.posexplode("vector").alias("dim", "value")).select("node", "dim", (F.round("value", 6) + 0.0).alias("value"))


def soft(g: Graph, threshold: float = 0.3) -> DataFrame:
    return community.soft_clusters(g.vectors, community.best_count(g.counts), threshold=threshold)


def cluster_count(g: Graph) -> DataFrame:
    best = community.best_count(g.counts)
    return g.spark.createDataFrame([(k, c, k == best) for k, c in g.counts], "k int, coefficient double, chosen boolean")


def learned_membership(g: Graph) -> DataFrame:
    """Members of the learned communities: processes of soft clusters, their masters and resources."""
    found = soft(g).select(F.concat(F.lit("soft-"), F.col("cluster").cast("string")).alias("community"), F.col("node").alias("proc"))
    return community.membership(g.edges_all, g.kept(found, "learned"))


_QUERIES: dict[str, Callable[[Graph], DataFrame]] = {
    "poi_lookup": lambda g: g.poi(),
    "events_parse": events_parse,
    "flow_edges": lambda g: g.flow(),
    "merged_edges": lambda g: _amount(g.merged()),
    "edge_keys": lambda g: graph.edge_keys(g.merged()).select("src", "dst", "op", "key"),
    "nodes": lambda g: graph.nodes(g.merged()),
    "node_ids": lambda g: graph.node_ids(graph.nodes(g.merged())).select("nid", "label", "type"),
    "file_stem": lambda g: graph.ends(g.merged()).filter(node_type(F.col("label")) == "f").select(F.col("label").alias("path"), file_stem(F.col("label")).alias("stem")),
    "degree": lambda g: graph.degree(g.merged()),
    "proc_lineage": lambda g: graph.lineage(g.merged()),
    "causal_backward": lambda g: _amount(graph.merge_edges(causality.causal_edges(g.flow(), g.poi()))),
    "reachable": reachable,
    "leaf_nodes": lambda g: compress.leaf_nodes(g.merged()),
    "leaf_groups": lambda g: compress.leaf_groups(g.merged()),
    "leaf_merge": lambda g: compress.leaf_merge(g.merged()),
    "proc_files": lambda g: compress.proc_files(g.merged()),
    "proc_groups": lambda g: compress.proc_groups(g.edges_all),
    "file_groups": lambda g: compress.file_groups(g.edges_all),
    "collapsed_edges": lambda g: _amount(compress.collapse(g.edges_all, compress.collapse_map(g.edges_all))),
    "compression_stats": lambda g: compress.compression_stats(g.edges_all, g.kept(compress.collapse(g.edges_all, compress.collapse_map(g.edges_all)), "collapsed")),
    "components": components,
    "stream_merged_edges": lambda g: _amount(stream_merged_edges(g)),
    "random_walks": lambda g: community.random_walks(g.edges_all),
    "label_propagation": lambda g: g.labels,
    "modularity": lambda g: community.modularity(g.edges_all, g.labels),
    "embed": embed,
    "soft_clusters": soft,
    "cluster_count": cluster_count,
    "learned_membership": learned_membership,
    "lineage_communities": lambda g: g.communities,
    "membership": lambda g: g.members,
    "community_edges": lambda g: _amount(g.community_edges()),
    "shared_nodes": lambda g: community.shared_nodes(g.members),
    "community_stats": lambda g: community.community_stats(g.members, g.community_edges()),
    "master_process": lambda g: summary.master_process(g.process_members, community.process_edges(g.edges_all, g.process_members)),
    "time_span": lambda g: summary.time_span(g.community_edges()),
    "summary_edges": lambda g: summary.summary_edges(g.members, g.inner),
    "dot_lines": lambda g: sinks.dot_lines(g.members, g.inner),
    "community_f1": community_f1,
    "majority_vote": lambda g: community.majority_vote(g.communities.withColumnRenamed("proc", "nid"), votes(g.communities)),
    "merged_communities": lambda g: community.merge_communities(g.members),
    "infopath_inputs": lambda g: g.inputs,
    "infopath_outputs": lambda g: g.outputs,
    "infopath_pairs": lambda g: g.pairs(),
    "simple_paths": lambda g: _text_path(g.paths).drop("score"),
    "infopath_scores": lambda g: _text_path(g.paths).select("community", "path", F.round("score", 6).alias("score")),
    "infopath_best": lambda g: _text_path(g.best()).withColumn("score", F.round("score", 6)),
    "infopath_rank": lambda g: _text_path(g.ranked).select("community", "path", "rank", F.round("share", 6).alias("share")),
    "infopath_topk": lambda g: _text_path(summary.infopath_topk(g.ranked, TOP_K)).select("community", "path", "rank"),
    "community_summary": lambda g: summary.community_summary(g.members, g.inner, g.ranked),
}


def _bound(f: Callable[[Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(Graph(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _bound(f) for name, f in _QUERIES.items()}
