"""Nodes that many communities share, and communities of many paths: whole results in rows that don't explode."""

import random

import pytest
from pyspark.sql import functions as F

from tracefold.operators import community, graph, grouped, summary

EDGE = "src string, dst string, op string, first_ts long, last_ts long, n long, amount double"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def most_rows(df):
    """The largest number of rows that an operator of the executed plan of ``df`` put out."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        found = node.metrics().get("numOutputRows")
        below = node.children()
        return max([found.get().value() if found.isDefined() else 0, *[walk(below.apply(k)) for k in range(below.size())]])

    return walk(df._jdf.queryExecution().executedPlan())


def hub_graph(spark, n=300):
    """A file that a process of each community reads and writes, and a file of each."""
    procs = [f"u{k}(1)" for k in range(n)]
    edges = [("/null", p, "read") for p in procs] + [(p, "/null", "write") for p in procs] + [(p, f"/own/{p}", "write") for p in procs]
    merged = spark.createDataFrame([(s, d, op, k, k, 1, 1.0) for k, (s, d, op) in enumerate(edges)], EDGE)
    members = spark.createDataFrame([(p, x, "x") for p in procs for x in (p, "/null", f"/own/{p}")], "community string, nid string, type string")
    return merged, members


def test_community_edges_of_a_shared_file(spark):
    merged, members = hub_graph(spark)
    found = graph.induced(merged, members)
    held = {}
    for c, nid, _ in members.collect():
        held.setdefault(nid, set()).add(c)
    assert rows(found, "community", "src", "dst", "op") == sorted((c, e.src, e.dst, e.op) for e in merged.collect() for c in held[e.src] & held[e.dst])
    assert most_rows(found) <= 10 * merged.count()  # the shared file alone met all 300 communities with each of its edges


@pytest.mark.parametrize("narrow", [0, 10_000])
def test_children_of_one_parent_are_linked_by_workers_and_joins(spark, monkeypatch, narrow):
    monkeypatch.setattr(grouped, "NARROW", narrow)
    draw = random.Random(5)
    touch = [(f"p{k % 3}(0)", f"c{k:02}({k % 3})", f"/f{draw.randrange(30)}") for k in range(40) for _ in range(2)]
    edges = {(p, c, "execve") for p, c, _ in touch} | {(c, f, "write") for _, c, f in touch} | {("p0(0)", "alone(9)", "execve")}
    merged = spark.createDataFrame([(s, d, op, 1, 1, 1, 1.0) for s, d, op in edges], EDGE)
    least = {(p, c): c for p, c, _ in touch} | {("p0(0)", "alone(9)"): "alone(9)"}
    for _ in least:
        for p, c, f in touch:
            for q, d, g in touch:
                if p == q and f == g:
                    least[p, c] = least[p, d] = min(least[p, c], least[p, d])
    assert rows(community.lineage_communities(merged), "community", "proc") == sorted((f"{p}/{m}", c) for (p, c), m in least.items())


def drawn_lineage(spark):
    """Parents with children and resources of their own, a child that is a parent, files that feed files
    and children that look like files."""
    draw = random.Random(11)
    procs = [f"p{k}({k})" for k in range(12)] + ["odd"]
    edges = {(procs[draw.randrange(4)], procs[draw.randrange(3, 13)], draw.choice(["execve", "clone"])) for _ in range(22)}
    edges |= {(draw.choice(procs), f"/f{draw.randrange(9)}", "write") for _ in range(30)} | {(f"/f{draw.randrange(9)}", draw.choice(procs), "read") for _ in range(30)}
    edges |= {("/f1", "/f2", "read"), ("/f3", "1.2.3.4:5->6.7.8.9:10", "write"), ("p5(5)", "p5(5)", "clone")}
    return spark.createDataFrame([(s, d, op, k, k + 1, 1, 1.0) for k, (s, d, op) in enumerate(sorted(edges))], EDGE)


def test_edges_of_children_need_no_lookup_of_members(spark):
    merged = drawn_lineage(spark)
    communities = community.lineage_communities(merged)
    accessed = community.accessed_edges(merged, communities)
    members = community.membership(merged, communities, accessed)
    assert rows(members) == rows(community.membership(merged, communities)) != []
    expect = graph.induced(merged, members)
    assert rows(community.community_edges(merged, communities, members, accessed)) == rows(expect) != []
    procs = community.process_members(merged, communities)
    assert rows(procs) == rows(members.filter("type = 'p'"), *procs.columns)
    assert rows(summary.master_process(procs, community.process_edges(merged, procs))) == rows(summary.master_process(members, expect)) != []


def test_masters_need_no_edges_of_files(spark):
    from tracefold.plans import catalog

    g = catalog.Graph(spark, "/root/testdata/sf0.001")
    assert rows(catalog._QUERIES["master_process"](g)) == rows(summary.master_process(g.members, g.inner)) != []
    g = catalog.Graph(spark, "/root/testdata/sf0.001")
    catalog._QUERIES["master_process"](g)
    assert not {"members", "accessed", "inner"} & set(vars(g))


def test_events_parse_their_properties_once(spark):
    from tracefold.sources import audit

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = audit.audit_events(events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 1


def drawn_paths(spark):
    draw = random.Random(3)
    weights = {(c, f"n{a}", f"n{b}"): draw.choice([0.0, 0.5, 1.25, 2.0]) for c in "ab" for a in range(7) for b in range(7) if a != b and draw.random() < 0.55}
    w = spark.createDataFrame([(*k, v) for k, v in weights.items()] + [("a", "n1", "n1", 9.0), ("c", "n0", "n1", 1.0)], "community string, src string, dst string, w double")
    inputs = spark.createDataFrame([(c, f"n{k}", 3 * k) for c in "ab" for k in range(3)] + [("c", "n9", 0)], "community string, nid string, first_out long")
    outputs = spark.createDataFrame([(c, f"n{k}", k + 1) for c in "ab" for k in range(1, 7)], "community string, nid string, last_in long")
    return w, inputs, outputs


@pytest.mark.parametrize("most", [None, 3])
def test_paths_by_workers_equal_paths_by_joins(spark, most):
    given = drawn_paths(spark)
    assert rows(summary.simple_paths(*given, most)) == rows(summary._grown_paths(*given, most)) != []


@pytest.mark.parametrize("narrow", [0, 10_000])
def test_best_paths_need_no_list_of_all_paths(spark, monkeypatch, narrow):
    monkeypatch.setattr(grouped, "NARROW", narrow)
    w, inputs, outputs = drawn_paths(spark)
    every = summary._grown_paths(w, inputs, outputs, None)
    best = summary.best_paths(w, inputs, outputs)
    expect = rows(summary.infopath_best(every, summary.infopath_pairs(inputs, outputs)))
    assert rows(best, *every.columns) == expect != []
    if narrow:
        assert most_rows(summary.best_paths(w, inputs, outputs)) < every.count() / 5


def moved(df, metric):
    """The sum of a metric of the shuffles of the executed plan of ``df``."""
    df.collect()

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        below = node.children()
        own = node.metrics().get(metric).get().value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(walk(below.apply(k)) for k in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_dot_lines_move_no_texts(spark):
    from tracefold.sources import sinks

    merged, members = hub_graph(spark)
    lines = sinks.dot_lines(members, graph.induced(merged, members).localCheckpoint())
    assert moved(lines, "dataSize") < 4 * sum(len(r.line) for r in lines.collect())


def test_links_of_a_shared_node_stay_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(summary, "BLOCK", 50)
    merged, members = hub_graph(spark, 200)
    extra = [(f"u{k}(1)", "/two", "write") for k in range(6)] + [("/two", f"u{k}(1)", "read") for k in range(6)]
    merged = merged.union(spark.createDataFrame([(s, d, op, 900, 900, 1, 1.0) for s, d, op in extra], EDGE))
    members = members.union(spark.createDataFrame([(f"u{k}(1)", "/two", "x") for k in range(6)], "community string, nid string, type string"))
    inner = graph.induced(merged, members).localCheckpoint()
    start, into, out = {}, {}, {}
    for e in inner.collect():
        start[e.community] = min(start.get(e.community, e.first_ts), e.first_ts)
        into.setdefault(e.dst, set()).add(e.community)
        out.setdefault(e.src, set()).add(e.community)
    shared = sorted({"/null", "/two"})
    pairs = [(i, o, x) for x in shared for i in into[x] for o in out[x] if (start[i], i) < (start[o], o)]
    seen, expect = {}, []
    for i, o, x in sorted(pairs, key=lambda p: p[2]):
        expect.append((i, o, seen.get((i, o), 0), x))
        seen[i, o] = seen.get((i, o), 0) + 1
    found = summary.summary_edges(members, inner)
    assert rows(found, "src", "dst", "key", "label") == sorted(expect) and max(k for _, _, k, _ in expect) == 1
    assert moved(found, "shuffleRecordsWritten") < len(expect) / 4
