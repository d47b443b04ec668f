"""Summary: master processes, spans, information-flow paths and the graph of communities.

``edges`` are community edges: (community, src, dst, op, first_ts, last_ts, n, amount).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.labels import executable, node_type, span_text
from tracefold.operators.grouped import EDGE, PATHS, START, STOP, dealt, path_rows, wide_keys
from tracefold.storage import bounded_broadcast, cut, cut_with

HOUR_US = 3_600_000_000
#: Words of 64 bits in a bitmap of nodes, and rows of one node that a block of links takes.
WORDS, BLOCK = 4, 2000


def master_process(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, master, exe): the process without an incoming process edge in the community; of
    several the one that starts most processes, then the smallest label."""
    procs = members.filter("type = 'p'").select("community", "nid").distinct()
    between = edges.filter((node_type(F.col("src")) == "p") & (node_type(F.col("dst")) == "p") & (F.col("src") != F.col("dst")))
    roots = procs.join(between.select("community", F.col("dst").alias("nid")).distinct(), ["community", "nid"], "left_anti")
    started = between.select("community", F.col("src").alias("nid"), "dst").distinct().groupBy("community", "nid").agg(F.count("*").alias("started"))
    order = Window.partitionBy("community").orderBy(F.coalesce("started", F.lit(0)).desc(), "nid")
    first = roots.join(started, ["community", "nid"], "left").withColumn("r", F.row_number().over(order)).filter("r = 1")
    return first.select("community", F.col("nid").alias("master"), executable(F.col("nid")).alias("exe"))


def time_span(edges: DataFrame) -> DataFrame:
    return edges.groupBy("community").agg(F.min("first_ts").alias("start_ts"), F.max("last_ts").alias("end_ts"))


def _shared(members: DataFrame) -> DataFrame:
    return members.groupBy("nid").agg(F.countDistinct("community").alias("c")).filter("c > 1").select("nid")


def infopath_inputs(members: DataFrame, edges: DataFrame, poi: DataFrame) -> DataFrame:
    """(community, nid, first_out): nodes shared with other communities, or network nodes, with an
    out-edge in the community; never the point of interest."""
    out = edges.groupBy("community", F.col("src").alias("nid")).agg(F.min("first_ts").alias("first_out"))
    shared = _shared(members).withColumn("shared", F.lit(True))
    kept = out.join(shared, "nid", "left").filter(F.col("shared") | (node_type(F.col("nid")) == "n"))
    return kept.join(poi.select(F.col("node").alias("nid")), "nid", "left_anti").select("community", "nid", "first_out")


def infopath_outputs(members: DataFrame, edges: DataFrame, poi: DataFrame) -> DataFrame:
    """(community, nid, last_in): shared nodes with an in-edge in the community, and the point of interest."""
    into = edges.groupBy("community", F.col("dst").alias("nid")).agg(F.max("last_ts").alias("last_in"))
    wanted = _shared(members).unionByName(poi.select(F.col("node").alias("nid"))).distinct()
    return into.join(wanted, "nid", "left_semi").select("community", "nid", "last_in")


def infopath_pairs(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(community, input, output) that time allows: the input acts before the output is last reached."""
    i = inputs.select("community", F.col("nid").alias("input"), "first_out")
    o = outputs.select("community", F.col("nid").alias("output"), "last_in")
    return i.join(o, "community").filter((F.col("input") != F.col("output")) & (F.col("first_out") < F.col("last_in"))).select("community", "input", "output")


def edge_weights(edges: DataFrame, poi: DataFrame) -> DataFrame:
    """(community, src, dst, w): ``ln(1 + amount) / (1 + hours to the point of interest)``, the largest
    over parallel edges."""
    at = poi.select(F.col("ts").alias("poi_ts")).withColumn("one", F.lit(1))
    hours = F.abs(F.col("poi_ts") - F.col("last_ts")) / HOUR_US
    weighed = edges.withColumn("one", F.lit(1)).join(F.broadcast(at), "one")  # poi: one row
    return weighed.groupBy("community", "src", "dst").agg(F.max(F.log1p("amount") / (1 + hours)).alias("w"))


def simple_paths(weights: DataFrame, inputs: DataFrame, outputs: DataFrame, max_edges: int | None = None) -> DataFrame:
    """(community, input, output, path, hops, score) of all simple paths, or of those of at most ``max_edges`` edges.

    The score adds edge weights, and at every junction the product of the two weights that meet.
    Communities of at most ``NARROW`` weights are searched depth first by a worker each, which stores no
    partial path; the paths of larger ones grow by joins.
    """
    return _paths(weights, inputs, outputs, max_edges, best=False)


def _paths(weights: DataFrame, inputs: DataFrame, outputs: DataFrame, max_edges: int | None, best: bool) -> DataFrame:
    weights = cut(weights.select("community", "src", "dst", "w"), "path-edges")
    wide = wide_keys(weights, "community")
    near = lambda df: df if wide is None else df.join(wide, "community", "left_anti")
    no, time = F.lit(None).cast("string").alias("b"), lambda c: F.col(c).cast("long").alias("ts") if best else F.lit(None).cast("long").alias("ts")
    end = lambda df, kind, ts: near(df).select("community", F.lit(kind).alias("kind"), F.col("nid").alias("a"), no, F.lit(None).cast("double").alias("w"), time(ts))
    rows = near(weights).select("community", F.lit(EDGE).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("w").cast("double").alias("w"), F.lit(None).cast("long").alias("ts"))
    rows = rows.unionByName(end(inputs, START, "first_out")).unionByName(end(outputs, STOP, "last_in"))
    found = dealt(rows, "community").mapInArrow(path_rows(best, max_edges), PATHS)
    if wide is None:
        return found
    only = lambda df: df.join(wide, "community", "left_semi")
    far = _grown_paths(only(weights), only(inputs), only(outputs), max_edges)
    if best:
        far = far.join(infopath_pairs(only(inputs), only(outputs)), ["community", "input", "output"], "left_semi")
    return found.unionByName(far)


def _grown_paths(weights: DataFrame, inputs: DataFrame, outputs: DataFrame, max_edges: int | None) -> DataFrame:
    """Paths grow by a join on (community, node) until none can be extended, which ends by itself as no
    node repeats; only those that end in an output are kept. Edges know whether they lead to an output
    and all lengths are read back in one scan, so that the plan doesn't grow with the longest path."""
    spark = weights.sparkSession
    ends = outputs.select("community", F.col("nid").alias("to")).distinct().withColumn("ends", F.lit(True))
    e = cut(weights.withColumnRenamed("dst", "to").join(ends, ["community", "to"], "left").select("community", F.col("src").alias("at"), "to", "w", F.coalesce("ends", F.lit(False)).alias("ends")), "path-edges")
    now = inputs.select("community", F.col("nid").alias("input"), F.col("nid").alias("at")).withColumn("path", F.array("at")).withColumn("score", F.lit(0.0)).withColumn("last_w", F.lit(0.0))
    written: list[str] = []
    while max_edges is None or len(written) < max_edges:
        step = now.join(e, ["community", "at"]).filter(~F.array_contains("path", F.col("to")))
        grown = step.select(
            "community", "input", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"), (F.col("score") + F.col("w") + F.col("last_w") * F.col("w")).alias("score"),
            F.col("w").alias("last_w"), "ends", F.lit(len(written) + 1).alias("hops"),
        )
        found, seen = cut_with(grown, "paths", n=F.count("*"))
        written.append(found._cut_at)
        if not seen["n"]:
            break
        now = found.drop("ends", "hops")
    return spark.read.schema(grown.schema).parquet(*written).filter("ends").select("community", "input", F.col("at").alias("output"), "path", "hops", "score")


def best_paths(weights: DataFrame, inputs: DataFrame, outputs: DataFrame, max_edges: int | None = None) -> DataFrame:
    """``infopath_best`` of all simple paths. Workers drop paths that surely aren't their pair's best,
    so that only about a row a pair moves; communities are dealt once for this and for ``infopath_rank``."""
    return _first_of_pairs(_paths(weights, inputs, outputs, max_edges, best=True).repartition("community"))


def infopath_best(paths: DataFrame, pairs: DataFrame) -> DataFrame:
    """One path for each feasible pair: the highest score, then the fewest hops, then the path itself."""
    return _first_of_pairs(paths.join(pairs, ["community", "input", "output"], "left_semi"))


def _first_of_pairs(paths: DataFrame) -> DataFrame:
    order = Window.partitionBy("community", "input", "output").orderBy(F.round("score", 9).desc(), "hops", F.array_join("path", " "))
    return paths.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def infopath_rank(best: DataFrame) -> DataFrame:
    """``share`` of the community's highest score, and ``rank`` from 1."""
    text = F.array_join("path", " ")
    order = Window.partitionBy("community").orderBy(F.round("score", 9).desc(), "hops", text)
    top = F.max("score").over(Window.partitionBy("community"))
    return best.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("share", F.when(top > 0, F.col("score") / top).otherwise(0.0))


def infopath_topk(ranked: DataFrame, k: int) -> DataFrame:
    return ranked.filter(F.col("rank") <= k)


def summary_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, key, label): community i to a later-starting community j for each shared node with an
    in-edge in i and an out-edge in j. Equal starts are ordered by id.

    Only links whose communities may share another node, by a bitmap of each side's other nodes, meet in
    a shuffle to be numbered; all others have key 0 where the join makes them. Nodes of many communities
    are dealt out in blocks.
    """
    spans = time_span(edges).select("community", F.struct(F.col("start_ts"), F.col("community").alias("c")).alias("at"))
    nodes = bounded_broadcast(_shared(members))
    ends = edges.select("community", F.explode(F.array(F.struct(F.lit(0).alias("out"), F.col("dst").alias("nid")), F.struct(F.lit(1).alias("out"), F.col("src").alias("nid")))).alias("e")).select("community", "e.*").distinct()
    rows = ends.join(nodes, "nid", "left_semi").join(spans, "community")
    bit = F.pmod(F.xxhash64("nid"), F.lit(64 * WORDS))
    others = rows
    for k in range(WORDS):
        mine = F.when(F.floor(bit / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).otherwise(F.lit(0).cast("long"))
        others = others.withColumn(f"m{k}", mine)
    side = Window.partitionBy("community", "out").orderBy("nid")
    before, after = side.rowsBetween(Window.unboundedPreceding, -1), side.rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0).cast("long")
    masks = [F.coalesce(F.bit_or(f"m{k}").over(before), none).bitwiseOR(F.coalesce(F.bit_or(f"m{k}").over(after), none)).alias(f"o{k}") for k in range(WORDS)]
    rows = cut(others.select("nid", "out", "community", "at", *masks), "link-ends")
    size = rows.filter("out = 1").groupBy("nid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    blocks = F.broadcast(size)  # a row per BLOCK rows at most
    pick = lambda out, c, m: rows.filter(F.col("out") == out).join(blocks, "nid", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).select("nid", F.col("community").alias(c), F.col("at").alias(f"{c}_at"), "blocks", *[F.col(f"o{k}").alias(f"{m}{k}") for k in range(WORDS)])
    into = pick(0, "src", "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    out = pick(1, "dst", "b").withColumn("block", F.pmod(F.xxhash64("dst"), F.col("blocks")).cast("int")).drop("blocks")
    met = into.join(out, ["nid", "block"]).filter(F.col("src_at") < F.col("dst_at"))
    single = F.lit(True)
    for k in range(WORDS):
        single = single & (F.col(f"a{k}").bitwiseAND(F.col(f"b{k}")) == 0)
    alone = met.filter(single).select("src", "dst", F.col("nid").alias("label"), F.lit(0).cast("long").alias("key"))
    several = met.filter(~single).select("src", "dst", F.col("nid").alias("label"))
    numbers = several.withColumn("key", F.row_number().over(Window.partitionBy("src", "dst").orderBy("label")).cast("long") - 1)
    return alone.unionByName(numbers)


def community_summary(members: DataFrame, edges: DataFrame, ranked: DataFrame) -> DataFrame:
    """(community, exe, span, n_paths, top_path) of every community."""
    spans = time_span(edges).select("community", span_text(F.col("start_ts"), F.col("end_ts")).alias("span"))
    best = ranked.groupBy("community").agg(F.count("*").alias("n_paths"), F.min_by(F.array_join("path", " "), "rank").alias("top_path"))
    head = master_process(members, edges).select("community", "exe").join(spans, "community", "left")
    return head.join(best, "community", "left").select("community", "exe", "span", F.coalesce("n_paths", F.lit(0)).alias("n_paths"), F.coalesce("top_path", F.lit("")).alias("top_path"))
