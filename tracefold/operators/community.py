"""Communities: lineage-guided and learned, membership, evaluation.

``membership`` is (community, nid), many to many. A community's id is the smallest label of its
processes, prefixed by its master where lineage made it.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracefold.functions.labels import BETWEEN_PROCESSES, node_type
from tracefold.operators import rounds
from tracefold.operators.components import connected_components
from tracefold.storage import bounded_broadcast, cut, cut_with, release
from tracefold.operators.graph import access_edges, accesses, induced, lineage, numbered
from tracefold.operators.grouped import dealt, smallest_linked, wide_keys


def lineage_communities(merged: DataFrame) -> DataFrame:
    """(community, proc): processes of one parent that are related through shared resources.

    Of the children that touch a resource all link to the smallest one, so that a resource of a million
    processes costs a million edges, not their pairs, and one that a single child touches costs none. A
    child that is related to no other one is a community of its own. A worker links the children of a
    parent of few links; parents of more than ``NARROW`` links take rounds of joins.
    """
    children = lineage(merged).filter("parent IS NOT NULL AND child IS NOT NULL")
    touched = children.join(accesses(merged).withColumnRenamed("proc", "child"), "child")
    first = F.first("child").over(Window.partitionBy("parent", "resource").orderBy("child").rowsBetween(Window.unboundedPreceding, 0))
    links = cut(touched.select("parent", "child", first.alias("first")).filter("child != first"), "related")
    wide = wide_keys(links, "parent")
    near = links if wide is None else links.join(wide, "parent", "left_anti")
    found = dealt(near, "parent").mapInArrow(smallest_linked, "parent string, child string, component string")
    if wide is not None:
        key = lambda child: F.concat("parent", F.lit("\x00"), child).alias(child)
        part = lambda c, k: F.get(F.split(c, "\x00"), F.lit(k))
        far = connected_components(links.join(wide, "parent", "left_semi").select(key("child"), key("first")), "child", "first")
        found = found.unionByName(far.select(part("node", 0).alias("parent"), part("node", 1).alias("child"), part("component", 1).alias("component")))
    both = children.join(found, ["parent", "child"], "left")
    return both.select(F.concat("parent", F.lit("/"), F.coalesce("component", "child")).alias("community"), F.col("child").alias("proc"))


def _with_masters(merged: DataFrame, communities: DataFrame) -> DataFrame:
    masters = communities.join(lineage(merged), F.col("proc") == F.col("child")).select("community", F.col("parent").alias("nid"))
    return communities.select("community", F.col("proc").alias("nid")).unionByName(masters)


def process_members(merged: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, nid, type): the members that are processes."""
    return _with_masters(merged, communities).distinct().withColumn("type", node_type(F.col("nid"))).filter("type = 'p'")


def membership(merged: DataFrame, communities: DataFrame, accessed: DataFrame | None = None) -> DataFrame:
    """(community, nid, type): a community's processes, their parent as master, and every resource
    that its processes access, which ``accessed_edges`` has if they are at hand. Overlaps are kept."""
    found = communities.join(accesses(merged), "proc") if accessed is None else accessed
    rows = _with_masters(merged, communities).unionByName(found.select("community", F.col("resource").alias("nid"))).distinct()
    return rows.withColumn("type", node_type(F.col("nid")))


def accessed_edges(merged: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, proc, resource, edge): the edges between a community's processes and resources. All
    belong to the community, as it holds every resource of its processes; masters are not among these."""
    return access_edges(merged).join(communities.distinct(), "proc").select("community", "proc", "resource", *merged.columns)


def process_edges(merged: DataFrame, procs: DataFrame) -> DataFrame:
    """Edges of each community between its ``process_members``."""
    between = merged.filter((node_type(F.col("src")) == "p") & (node_type(F.col("dst")) == "p"))
    return induced(between, procs, unique=True)


def community_edges(merged: DataFrame, communities: DataFrame, members: DataFrame, accessed: DataFrame) -> DataFrame:
    """``induced`` edges of ``membership(merged, communities)``: those of ``accessed_edges``, between
    processes, between resources, and of masters with resources that their children access. Only the
    last two kinds and the processes are looked up among the members."""
    columns = ["community", *merged.columns]
    procs, things = members.filter("type = 'p'"), members.filter("type != 'p'")
    masters = cut(procs.join(communities.select("community", F.col("proc").alias("nid")), ["community", "nid"], "left_anti").select(*members.columns), "masters")
    some = bounded_broadcast(masters.select(F.col("nid").alias("proc")).distinct())
    theirs = cut(access_edges(merged).join(some, "proc", "left_semi"), "master-edges")
    touched = bounded_broadcast(theirs.select(F.col("resource").alias("nid")).distinct())
    near = masters.unionByName(things.join(touched, "nid", "left_semi").select(*masters.columns))
    found = accessed.select(*columns).unionByName(process_edges(merged, procs)).unionByName(induced(theirs.select(*merged.columns), near, unique=True))
    lone = merged.filter((node_type(F.col("src")) != "p") & (node_type(F.col("dst")) != "p"))
    return found if lone.isEmpty() else found.unionByName(induced(lone, things, unique=True))


def shared_nodes(members: DataFrame) -> DataFrame:
    """(nid, n_communities) of nodes in two communities or more."""
    return members.groupBy("nid").agg(F.countDistinct("community").alias("n_communities")).filter("n_communities > 1")


def community_stats(members: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = [F.sum(F.when(F.col("type") == t, 1).otherwise(0)).alias(f"n_{t}") for t in ("p", "f", "n")]
    size = members.groupBy("community").agg(F.count("*").alias("n_nodes"), *kinds)
    return size.join(edges.groupBy("community").agg(F.count("*").alias("n_edges")), "community", "left").select("community", "n_nodes", "n_p", "n_f", "n_n", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def portable_hash(*parts: Column) -> Column:
    """32 bits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def random_walks(merged: DataFrame, steps: int = 8, walks: int = 2, seed: str = "walk-1", lineage_weight: int = 3) -> DataFrame:
    """(walk, step, node): seeded walks over undirected neighbours from every process, guided by
    lineage: a parent or child is ``lineage_weight`` times as likely as another neighbour.

    Every neighbour has a slot or ``lineage_weight`` of them, numbered within its node. A step joins
    (node, slot): a hash of walk and step modulo the number of slots, so that a walker at a hub costs
    one row and not the hub's whole adjacency.
    """
    weight = F.when(F.col("op").isin(*BETWEEN_PROCESSES), lineage_weight).otherwise(1).alias("w")
    pairs = merged.select(F.col("src").alias("node"), F.col("dst").alias("next"), weight).union(merged.select("dst", "src", weight)).groupBy("node", "next").agg(F.max("w").alias("w"))
    slots = pairs.select("node", "next", F.explode(F.sequence(F.lit(1), F.col("w"))).alias("copy"))
    ranked = cut(numbered(slots, ["node"], ["next", "copy"], "slot").select("node", "next", (F.col("slot") - 1).alias("slot")), "adjacency")
    degrees = cut(ranked.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    starts = degrees.filter(node_type(F.col("node")) == "p").select("node", F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("w"))
    now = starts.select(F.concat("node", F.lit("#"), F.col("w").cast("string")).alias("walk"), F.lit(0).alias("step"), "node")
    out = now
    for step in range(1, steps + 1):
        drawn = now.join(degrees, "node").select("walk", "node", (portable_hash(F.lit(seed), F.col("walk"), F.lit(str(step))) % F.col("degree")).alias("slot"))
        now = cut(drawn.join(ranked, ["node", "slot"]).select("walk", F.lit(step).alias("step"), F.col("next").alias("node")), "walks")
        out = out.unionByName(now)
    return out


def embed(walks: DataFrame, size: int = 16, window: int = 2) -> DataFrame:
    """(node, vector): positive pointwise mutual information of nodes that walks visit within ``window``
    steps of each other, projected to ``size`` dimensions (32 at most) and scaled to length 1.

    The projection adds every context with signs from its MD5, so that vectors are one aggregation:
    no vocabulary on the driver, no order of training, the same result at any partitioning.
    """
    near = walks.select("walk", "step", F.col("node").alias("context"))
    met = walks.select("walk", "node", F.explode(F.array(*[F.col("step") + k for k in range(-window, window + 1) if k])).alias("step")).join(near, ["walk", "step"])
    counts = cut(met.groupBy("node", "context").agg(F.count("*").alias("n")), "co-visits")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sums = counts.groupBy("node").agg(F.sum("n").alias("a"))
    both = counts.join(sums, "node").join(sums.select(F.col("node").alias("context"), F.col("a").alias("b")), "context")
    gain = F.greatest(F.lit(0.0), F.log(F.col("n") * F.lit(float(total)) / (F.col("a") * F.col("b"))))
    signed = both.select("node", gain.alias("gain"), F.md5("context").alias("h"))
    sign = lambda d: F.when(F.conv(F.substring("h", d + 1, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    added = signed.groupBy("node").agg(*[F.sum(F.col("gain") * sign(d)).alias(f"d{d}") for d in range(size)])
    length = F.sqrt(sum((F.col(f"d{d}") * F.col(f"d{d}") for d in range(1, size)), F.col("d0") * F.col("d0")))
    return added.select("node", F.array(*[F.when(length > 0, F.col(f"d{d}") / length).otherwise(0.0) for d in range(size)]).alias("vector"))


def _distances(centroids: list[list[float]]) -> list[Column]:
    square = lambda a, b: (a - b) * (a - b)
    return [F.greatest(F.aggregate(F.zip_with("vector", F.array(*[F.lit(x) for x in c]), square), F.lit(0.0), lambda s, x: s + x), F.lit(1e-12)) for c in centroids]


def _memberships(centroids: list[list[float]], fuzziness: float) -> Column:
    near = [F.pow(far, F.lit(-1.0 / (fuzziness - 1.0))) for far in _distances(centroids)]
    total = sum(near[1:], near[0])
    return F.array(*[x / total for x in near])


def fuzzy_centroids(vectors: DataFrame, k: int, fuzziness: float = 2.0, tolerance: float = 1e-3, seed: int = 7) -> list[list[float]]:
    """Centroids of fuzzy c-means, from ``k`` vectors drawn by hash, until none moves ``tolerance``.

    Centroids are ``k`` short vectors; each round is one aggregation with map-side combining.
    """
    first = vectors.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(k).collect()
    jitter = random.Random(seed)
    centroids = [[x + 1e-6 * jitter.random() for x in r.vector] for r in first]
    while centroids:
        weighed = vectors.select("vector", F.transform(_memberships(centroids, fuzziness), lambda w: F.pow(w, F.lit(fuzziness))).alias("w"))
        size = len(centroids[0])
        sums = [F.sum(F.get("w", F.lit(j)) * F.get("vector", F.lit(d))).alias(f"s{j}_{d}") for j in range(len(centroids)) for d in range(size)]
        row = weighed.agg(*sums, *[F.sum(F.get("w", F.lit(j))).alias(f"t{j}") for j in range(len(centroids))]).first()
        moved = [[row[f"s{j}_{d}"] / max(row[f"t{j}"], 1e-12) for d in range(size)] for j in range(len(centroids))]
        far = max(sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(moved, centroids, strict=True)) ** 0.5
        centroids = moved
        if far <= tolerance:
            break
    return centroids


def soft_clusters(vectors: DataFrame, k: int = 4, fuzziness: float = 2.0, seed: int = 7, threshold: float = 0.3) -> DataFrame:
    """(node, cluster, weight) by fuzzy c-means; weights of a node add up to 1 before ``threshold``. A
    node stays in its best cluster and in all others of at least ``threshold``."""
    centroids = fuzzy_centroids(vectors, k, fuzziness, seed=seed)
    if not centroids:
        return vectors.select("node", F.lit(0).alias("cluster"), F.lit(0.0).alias("weight"))
    weights = vectors.select("node", _memberships(centroids, fuzziness).alias("w")).withColumn("best", F.array_max("w"))
    rows = weights.select("node", "best", F.posexplode("w").alias("cluster", "weight"))
    return rows.filter((F.col("weight") >= threshold) | (F.col("weight") == F.col("best"))).select("node", "cluster", "weight")


def cluster_counts(vectors: DataFrame, patience: int = 2) -> list[tuple[int, float]]:
    """(k, coefficient) from 2 clusters on, until ``patience`` more have not raised the best coefficient
    or there are as many clusters as vectors. The coefficient is the mean of squared memberships,
    rescaled so that memberships of 1/k give 0 at any k."""
    n, found = vectors.count(), []
    while len(found) + 2 <= n:
        k = len(found) + 2
        row = vectors.select(F.aggregate(_memberships(fuzzy_centroids(vectors, k), 2.0), F.lit(0.0), lambda s, x: s + x * x).alias("u")).agg(F.avg("u").alias("u")).first()
        found.append((k, 1 - k / (k - 1) * (1 - row.u)))
        if k - max(found, key=lambda x: (x[1], -x[0]))[0] >= patience:
            break
    return found


def best_count(found: list[tuple[int, float]]) -> int:
    """The number of clusters of the largest coefficient, of equals the smallest; 1 if none was tried."""
    return max(found, key=lambda x: (x[1], -x[0]))[0] if found else 1


def learned_communities(merged: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(community, proc), overlapping: walks, vectors, as many soft clusters as the coefficient picks."""
    vectors = cut(embed(random_walks(merged)).filter(node_type(F.col("node")) == "p"), "vectors")
    found = soft_clusters(vectors, best_count(cluster_counts(vectors)), threshold=threshold)
    return found.select(F.concat(F.lit("soft-"), F.col("cluster").cast("string")).alias("community"), F.col("node").alias("proc"))


def merge_communities(members: DataFrame, least_overlap: float = 0.5) -> DataFrame:
    """(community, merged): communities joined where they share at least ``least_overlap`` of the
    smaller one's processes; components of such pairs merge. Only processes pair communities up.

    A community that needs one common process links with all others of that process, which a star
    around the smallest community of each process spans. Others meet on the smaller one's rarest
    processes only, as many as a partner can't avoid, and are counted exactly then.
    """
    procs = members.filter("type = 'p'").select("community", "nid").distinct()
    size = procs.groupBy("community").agg(F.count("*").alias("size")).withColumn("need", F.greatest(F.lit(1), F.ceil(least_overlap * F.col("size"))))
    held = procs.groupBy("nid").agg(F.count("*").alias("held"))
    rows = cut(procs.join(size, "community").join(held, "nid"), "merge-rows")
    centre = rows.groupBy("nid").agg(F.min(F.struct("size", "community", "need")).alias("c")).filter("c.need = 1").select("nid", F.col("c.community").alias("dst"))
    stars = rows.join(centre, "nid").filter("community != dst").select(F.col("community").alias("src"), "dst")
    rarest = Window.partitionBy("community").orderBy("held", "nid")
    prefix = rows.filter("need > 1").withColumn("r", F.row_number().over(rarest)).filter("r <= size - need + 1")
    a, b = prefix.select("nid", F.col("community").alias("src"), F.col("size").alias("sa"), "need"), rows.select("nid", F.col("community").alias("dst"), F.col("size").alias("sb"))
    met = a.join(b, "nid").filter(F.struct("sa", "src") < F.struct("sb", "dst")).select("src", "dst", "need").distinct()
    common = met.join(procs.withColumnRenamed("community", "src"), "src").join(procs.withColumnRenamed("community", "dst"), ["dst", "nid"])
    pairs = common.groupBy("src", "dst", "need").agg(F.count("*").alias("n")).filter("n >= need").select("src", "dst")
    found = connected_components(stars.union(pairs))
    return size.select("community").join(found, F.col("community") == F.col("node"), "left").select("community", F.coalesce("component", "community").alias("merged"))


def modularity(merged: DataFrame, labels: DataFrame) -> DataFrame:
    """(n_edges, n_labels, modularity) of ``labels`` (node, label) on the undirected graph: the share of
    edges inside a label less the share that equal degrees would put there by chance."""
    pairs = merged.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    ends = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    ends = cut(ends.select("la", "lb"), "label-ends")
    sides = ends.select(F.explode(F.array(F.struct(F.col("la").alias("label"), (F.col("la") == F.col("lb")).alias("inside")), F.struct(F.col("lb").alias("label"), (F.col("la") == F.col("lb")).alias("inside")))).alias("e")).select("e.*")
    per = sides.groupBy("label").agg(F.count("*").alias("degree"), (F.sum(F.col("inside").cast("long")) / 2).alias("inner"))
    total = ends.count()
    value = F.sum(F.col("inner") / F.lit(total) - F.pow(F.col("degree") / F.lit(2 * total), F.lit(2.0))) if total else F.lit(0.0)
    return per.agg(F.lit(total).cast("long").alias("n_edges"), F.count("*").alias("n_labels"), F.coalesce(value, F.lit(0.0)).alias("modularity"))


def community_f1(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(community, matched, f1): best-matching true community of every predicted one, by F1 of members."""
    size_p = predicted.groupBy("community").agg(F.count("*").alias("np"))
    size_t = truth.groupBy(F.col("community").alias("matched")).agg(F.count("*").alias("nt"))
    common = predicted.join(truth.select("nid", F.col("community").alias("matched")), "nid").groupBy("community", "matched").agg(F.count("*").alias("n"))
    scored = common.join(size_p, "community").join(size_t, "matched").withColumn("f1", 2 * F.col("n") / (F.col("np") + F.col("nt")))
    best = Window.partitionBy("community").orderBy(F.col("f1").desc(), "matched")
    return scored.withColumn("r", F.row_number().over(best)).filter("r = 1").select("community", "matched", F.round("f1", 6).alias("f1"))


def majority_vote(original: DataFrame, votes: DataFrame, least: int = 2) -> DataFrame:
    """(nid, community, changed): the community that at least ``least`` experts vote for, else the
    original one. Equal votes go to the smaller community."""
    counted = votes.groupBy("nid", "community").agg(F.countDistinct("expert").alias("n")).filter(F.col("n") >= least)
    order = Window.partitionBy("nid").orderBy(F.col("n").desc(), "community")
    chosen = counted.withColumn("r", F.row_number().over(order)).filter("r = 1").select("nid", F.col("community").alias("voted"))
    both = original.join(chosen, "nid", "left")
    return both.select("nid", F.coalesce("voted", "community").alias("community"), (F.coalesce("voted", "community") != F.col("community")).alias("changed"))


def label_propagation(merged: DataFrame) -> DataFrame:
    """(node, label): a modularity-style baseline. Nodes take the label most of their neighbours carry,
    the smallest of equals, until none wants another one; a label that is among the most frequent stays.

    Of neighbours that want to change in the same round only one does: processes and resources take
    turns, then a hash decides (the first 32 bits of the MD5 of "turn|round|node"). So each change makes
    more pairs of neighbours agree, and the rounds end. Nodes are numbered in the order of their names,
    then ``rounds`` does the rest: a round looks at the nodes around those that changed only.
    """
    pairs = cut(merged.filter("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct(), "neighbours")
    ends = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().withColumn("all", F.lit(0)), "ends")
    ids, numbers = cut_with(numbered(ends, ["all"], ["node"], "id").select((F.col("id") - 1).cast("long").alias("id"), "node"), "ids", n=F.count("*"))
    if not numbers["n"]:
        return ids.select("node", F.col("node").alias("label"))
    x = pairs.join(ids.select(F.col("node").alias("a"), F.col("id").alias("x")), "a").select("x", "b")
    known, links = cut_with(x.join(ids.select(F.col("node").alias("b"), F.col("id").alias("y")), "b").select("x", "y"), "links", n=F.count("*"))
    both = known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y")))
    names = ids.select("id", F.col("node").cast("binary").alias("name"), (node_type(F.col("node")) == "p").alias("process"))
    found = rounds.labelled(both, names, 2 * links["n"])
    release(pairs, ends, known)
    return found.join(ids.select(F.col("id").alias("label"), F.col("node").alias("of")), "label").select(F.col("name").cast("string").alias("node"), F.col("of").alias("label"))
