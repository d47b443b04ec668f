"""The engine on hand-made graphs: typing, flows, causality, compression, communities, paths, sinks."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracefold.functions import labels
from tracefold.operators import causality, community, compress, graph, summary
from tracefold.operators.components import connected_components
from tracefold.sources import audit, sinks

EDGE = "src string, dst string, op string, ts long, amount double"
MASTER, A, B, C = "sh(1)", "vim(2)", "vim(3)", "gzip(4)"


def edges(spark, rows):
    return spark.createDataFrame([(s, d, op, ts, 1.0) for s, d, op, ts in rows], EDGE)


@pytest.fixture(scope="module")
def merged(spark):
    rows = [
        (MASTER, A, "execve", 1), (MASTER, B, "execve", 2), (MASTER, C, "execve", 3),
        ("/f/one", A, "read", 4), ("/f/one", B, "read", 5), ("/f/two", A, "read", 4), (B, "/f/two", "write", 6),
        (C, "/out", "write", 9), ("/f/one", C, "read", 8), ("/tmp/a", C, "read", 7), ("/tmp/b", C, "read", 7),
        ("10.0.0.1:80->10.0.0.2:90", C, "recvfrom", 7), ("/f/one", A, "read", 10),
    ]
    return graph.merge_edges(edges(spark, rows)).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def test_labels(spark):
    given = ["sh(13)", "/a/b.tar.gz", "/home/.viminfo", "/a.b/c", "1.2.3.4:5->6.7.8.9:10", "plain"]
    df = spark.createDataFrame([(x,) for x in given], "l string")
    got = {r.l: tuple(r)[1:] for r in df.select("l", labels.node_type(F.col("l")), labels.attribute_1(F.col("l")), labels.attribute_2(F.col("l")), labels.shape(F.col("l"))).collect()}
    assert got["sh(13)"] == ("p", "sh", "13", "box")
    assert got["/a/b.tar.gz"] == ("f", "", "/a/b.tar", "ellipse")
    assert got["/home/.viminfo"][2] == "/home/"
    assert got["/a.b/c"][2] == "/a.b/c"
    assert got["1.2.3.4:5->6.7.8.9:10"] == ("n", "1.2.3.4", "6.7.8.9", "parallelogram")


def test_parse_log_and_quarantine(spark):
    lines = [
        '{"event_id": 1, "ts": "2024-01-01 00:00:00", "proc": "a(1)", "object": "/x", "op": "read", "amount": 2.5}',
        '{"event_id": 2, "ts": "2024-01-01 00:00:01", "proc": "a(1)", "object": "/x", "op": "ioctl"}', "not json", "",
        '{"event_id": 3, "ts": "2024-01-01 00:00:02", "proc": "a(1)", "object": "/x", "op": "rename"}',
    ]
    good, bad = audit.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r.event_id, r.ts, r.amount) for r in good.collect()] == [(1, 1704067200000000, 2.5)]
    assert bad.count() == 4
    text, rest = audit.parse_log(spark.createDataFrame([("5\t2024-01-01 00:00:00\tp(1)\t/a\t/b\trename\t1",), ("x\ty",)], "value string"), "text")
    assert rows(graph.flow_edges(text), "src", "dst", "op") == [("/a", "p(1)", "rename"), ("p(1)", "/b", "rename")]
    assert rest.count() == 1
    with pytest.raises(ValueError):
        audit.parse_log(text, "xml")


def test_merge_and_keys(spark, merged):
    one = {(r.src, r.dst): r for r in merged.collect()}[("/f/one", A)]
    assert (one.first_ts, one.last_ts, one.n, one.amount) == (4, 10, 2, 2.0)
    two = graph.merge_edges(edges(spark, [("x", "p(1)", "recvfrom", 1), ("x", "p(1)", "read", 2)]))
    assert rows(graph.edge_keys(two), "op", "key") == [("read", 0), ("recvfrom", 1)]


def test_node_ids_are_dense_per_type(merged):
    ids = [r.nid for r in graph.node_ids(graph.nodes(merged)).collect()]
    assert sorted(ids) == sorted([f"p{k}" for k in range(1, 5)] + [f"f{k}" for k in range(1, 6)] + ["n1"])


def test_causality_respects_time(spark):
    e = edges(spark, [("a", "b", "x", 1), ("b", "c", "x", 5), ("c", "b", "x", 4), ("late", "b", "x", 6), ("d", "a", "x", 2), ("e", "a", "x", 1)])
    poi = spark.createDataFrame([("c", 5)], "node string, ts long")
    assert rows(causality.causal_edges(e, poi), "src", "dst") == [("a", "b"), ("b", "c"), ("c", "b"), ("e", "a")]
    none = spark.createDataFrame([], "node string, ts long")
    assert causality.causal_edges(e, none).count() == 0


def test_reachable_with_cycle(spark):
    e = edges(spark, [("a", "b", "x", 1), ("b", "c", "x", 1), ("c", "a", "x", 1)])
    roots = spark.createDataFrame([("a",)], "node string")
    assert rows(causality.reachable(e, roots)) == [("a", "a", 0), ("a", "b", 1), ("a", "c", 2)]


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (200, 200), (None, 3)] + [(500, 500 + k) for k in range(1, 50)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "src long, dst long"))))
    assert {got[k] for k in range(41)} == {0} and got[101] == 100 and got[200] == 200 and got[549] == 500


def test_leaves_and_groups(merged):
    assert rows(compress.leaf_nodes(merged), "proc", "leaf", "type") == [(C, "/out", "f"), (C, "/tmp/a", "f"), (C, "/tmp/b", "f"), (C, "10.0.0.1:80->10.0.0.2:90", "n")]
    assert rows(compress.leaf_groups(merged)) == [(C, "/out,/tmp/a,/tmp/b,10.0.0.1:80->10.0.0.2:90", 4, 4)]
    assert rows(compress.leaf_merge(merged)) == [("/out", "/out"), ("/tmp/a", "/out"), ("/tmp/b", "/out")]
    assert rows(compress.proc_files(merged)) == [(C, "/f/one", 1), (A, "/f/one,/f/two", 2), (B, "/f/one,/f/two", 2)]
    assert rows(compress.proc_groups(merged), "rep", "seq", "nid", "parent", "exe") == [(A, 1, A, MASTER, "vim"), (A, 2, B, MASTER, "vim")]
    assert rows(compress.file_groups(merged)) == []


def test_collapse_is_idempotent(merged):
    once = compress.collapse(merged, compress.collapse_map(merged)).cache()
    stats = compress.compression_stats(merged, once).first()
    assert stats.nodes_after == stats.nodes_before - 3
    assert once.agg(F.sum("n")).first()[0] == merged.agg(F.sum("n")).first()[0]
    labels_after = {r.label for r in graph.ends(once).collect()}
    assert labels_after <= {r.label for r in graph.ends(merged).collect()}
    assert compress.leaf_merge(once).filter("nid != rep").count() == 0


def test_communities_and_summary(spark, merged):
    communities = community.lineage_communities(merged)
    assert rows(communities) == [(f"{MASTER}/{C}", C), (f"{MASTER}/{C}", A), (f"{MASTER}/{C}", B)]
    members = community.membership(merged, communities).cache()
    inner = graph.induced(merged, members).cache()
    assert rows(summary.master_process(members, inner)) == [(f"{MASTER}/{C}", MASTER, "sh")]
    stats = community.community_stats(members, inner).first()
    assert (stats.n_nodes, stats.n_p, stats.n_f, stats.n_n, stats.n_edges) == (10, 4, 5, 1, merged.count())
    poi = spark.createDataFrame([("/out", 9)], "node string, ts long")
    inputs, outputs = summary.infopath_inputs(members, inner, poi), summary.infopath_outputs(members, inner, poi)
    assert rows(inputs, "nid") == [("10.0.0.1:80->10.0.0.2:90",)] and rows(outputs, "nid") == [("/out",)]
    paths = summary.simple_paths(summary.edge_weights(inner, poi), inputs, outputs, 4)
    best = summary.infopath_rank(summary.infopath_best(paths, summary.infopath_pairs(inputs, outputs))).collect()
    assert [r.path for r in best] == [["10.0.0.1:80->10.0.0.2:90", C, "/out"]] and best[0].share == 1.0
    lines = [r.line for r in sinks.dot_lines(members, inner).orderBy("line_no").collect()]
    assert lines[0] == "digraph {" and lines[-1] == "}" and len(lines) == 2 + 10 + merged.count()


def test_summary_edges_go_forward(spark):
    e = spark.createDataFrame([("c1", "p(1)", "/x", "write", 1, 1, 1, 1.0), ("c2", "/x", "q(2)", "read", 3, 3, 1, 1.0), ("c2", "q(2)", "/y", "write", 4, 4, 1, 1.0)], "community string, src string, dst string, op string, first_ts long, last_ts long, n long, amount double")
    members = spark.createDataFrame([("c1", "p(1)", "p"), ("c1", "/x", "f"), ("c2", "/x", "f"), ("c2", "q(2)", "p"), ("c2", "/y", "f")], "community string, nid string, type string")
    assert rows(summary.summary_edges(members, e), "src", "dst", "key", "label") == [("c1", "c2", 0, "/x")]


def test_votes_and_f1(spark):
    original = spark.createDataFrame([("a", "x"), ("b", "y")], "nid string, community string")
    votes = spark.createDataFrame([("a", "z", "1"), ("a", "z", "2"), ("a", "x", "3"), ("b", "z", "1"), ("b", "x", "2")], "nid string, community string, expert string")
    assert rows(community.majority_vote(original, votes)) == [("a", "z", True), ("b", "y", False)]
    assert rows(community.community_f1(original, original)) == [("x", "x", 1.0), ("y", "y", 1.0)]


def test_walks_follow_edges(merged):
    found = community.random_walks(merged, steps=3, walks=1).collect()
    pairs = {(r.src, r.dst) for r in merged.collect()} | {(r.dst, r.src) for r in merged.collect()}
    by = {}
    for r in found:
        by.setdefault(r.walk, {})[r.step] = r.node
    assert len(by) == 4 and all((w[k], w[k + 1]) in pairs for w in by.values() for k in range(3))
    assert sorted(map(tuple, found)) == sorted(map(tuple, community.random_walks(merged, steps=3, walks=1).collect()))


def test_soft_memberships_add_up(spark):
    vectors = spark.createDataFrame([(f"a{k}", [0.0 + k / 100, 0.0]) for k in range(5)] + [(f"b{k}", [9.0, 9.0 + k / 100]) for k in range(5)], "node string, vector array<double>")
    found = community.soft_clusters(vectors, 2, threshold=0.0)
    assert all(abs(r.s - 1) < 1e-9 for r in found.groupBy("node").agg(F.sum("weight").alias("s")).collect())
    top = {r.node: r.cluster for r in community.soft_clusters(vectors, 2, threshold=0.5).collect()}
    assert len({top[f"a{k}"] for k in range(5)}) == 1 and top["a0"] != top["b0"]


def test_children_without_resources_stay(spark):
    lone = graph.merge_edges(edges(spark, [(MASTER, A, "execve", 1), (MASTER, B, "execve", 2), (MASTER, C, "execve", 2), ("/f", A, "read", 3), ("/f", B, "read", 3)]))
    assert rows(community.lineage_communities(lone)) == [(f"{MASTER}/{C}", C), (f"{MASTER}/{A}", A), (f"{MASTER}/{A}", B)]
    assert (f"{MASTER}/{C}", MASTER, "p") in rows(community.membership(lone, community.lineage_communities(lone)))


def test_long_chains_need_no_limit_of_rounds(spark):
    chain = edges(spark, [(f"n{k:03}", f"n{k + 1:03}", "x", k) for k in range(12)])
    assert causality.backward_bounds(chain, spark.createDataFrame([("n012", 11)], "node string, ts long")).count() == 13
    assert max(r.hops for r in causality.reachable(chain, spark.createDataFrame([("n000",)], "node string")).collect()) == 12


def test_numbering_is_dense_in_a_hub(spark):
    given = spark.createDataFrame([("hub", f"{k:04}") for k in range(500)] + [("b", "1"), ("a", "2"), ("a", "1")], "node string, next string").repartition(7)
    got = rows(graph.numbered(given, ["node"], ["next"], "at"))
    assert got == [("a", "1", 1), ("a", "2", 2), ("b", "1", 1)] + [("hub", f"{k:04}", k + 1) for k in range(500)]


def brute_vectors(found, size=16, window=2):
    by, n = {}, Counter()
    for r in found:
        by.setdefault(r.walk, {})[r.step] = r.node
    for w in by.values():
        n.update((w[i], w[j]) for i in w for j in w if i != j and abs(i - j) <= window)
    total, sums, out = sum(n.values()), Counter(), {}
    for (a, _), c in n.items():
        sums[a] += c
    for (a, b), c in n.items():
        gain = max(0.0, math.log(c * total / (sums[a] * sums[b])))
        signs = [1 if int(x, 16) % 2 == 0 else -1 for x in hashlib.md5(b.encode()).hexdigest()[:size]]
        out[a] = [x + gain * s for x, s in zip(out.get(a, [0.0] * size), signs, strict=True)]
    length = {a: math.sqrt(sum(x * x for x in v)) for a, v in out.items()}
    return {a: [x / length[a] if length[a] else 0.0 for x in v] for a, v in out.items()}


def test_vectors_match_brute_force(merged):
    walks = community.random_walks(merged, steps=5, walks=3)
    expect, got = brute_vectors(walks.collect()), {r.node: r.vector for r in community.embed(walks).collect()}
    assert set(got) == set(expect) and all(abs(x - y) < 1e-9 for a in got for x, y in zip(got[a], expect[a], strict=True))


def test_cluster_count_finds_groups(spark):
    """Four groups of points: the coefficient picks four, and the count of tries grows as needed."""
    vectors = spark.createDataFrame([(f"{g}{k}", [9.0 * (g % 2) + k / 50, 9.0 * (g // 2) - k / 60]) for g in range(4) for k in range(6)], "node string, vector array<double>").cache()
    found = community.cluster_counts(vectors)
    assert community.best_count(found) == 4 and [k for k, _ in found] == [2, 3, 4, 5, 6]
    assert all(0 <= c <= 1 for _, c in found) and community.cluster_counts(vectors.limit(1)) == [] and community.best_count([]) == 1


def brute_merge(members, least):
    sets = {}
    for c, n in members:
        sets.setdefault(c, set()).add(n)
    up = {c: c for c in sets}

    def root(c):
        while up[c] != c:
            c = up[c]
        return c

    for a in sets:
        for b in sets:
            if a < b and (common := len(sets[a] & sets[b])) and common >= least * min(len(sets[a]), len(sets[b])):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sorted((c, root(c)) for c in sets)


@pytest.mark.parametrize("least", [0.5, 0.7, 1.0])
def test_merged_communities_match_brute_force(spark, least):
    rng = random.Random(5)
    members = sorted({(f"c{rng.randrange(25):02}", f"p({min(rng.randrange(40), rng.randrange(40))})") for _ in range(110)})
    given = spark.createDataFrame([(c, n, "p") for c, n in members] + [("c00", "/f", "f"), ("c01", "/f", "f")], "community string, nid string, type string")
    assert rows(community.merge_communities(given, least)) == brute_merge(members, least)


def test_modularity_of_two_cliques(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(4) for j in range(i)] + [("a0", "b0")]
    e = graph.merge_edges(edges(spark, [(a, b, "x", 1) for a, b in pairs] + [("b0", "a0", "x", 1), ("a0", "a0", "x", 1)]))
    labels = spark.createDataFrame([(f"{g}{i}", g) for g in "ab" for i in range(4)], "node string, label string")
    assert rows(community.modularity(e, labels))[0][:2] == (13, 2)
    assert abs(community.modularity(e, labels).first().modularity - (12 / 13 - 0.5)) < 1e-12


def test_empty_graph(spark):
    e = graph.merge_edges(edges(spark, []))
    assert compress.collapse(e, compress.collapse_map(e)).count() == 0
    assert community.membership(e, community.lineage_communities(e)).count() == 0


def test_written_outputs(spark, merged, tmp_path):
    ids = graph.node_ids(graph.nodes(merged))
    sinks.write_nodes(ids, str(tmp_path / "nodes"))
    assert sorted(map(tuple, sinks.read_nodes(spark, str(tmp_path / "nodes")).fillna("").collect())) == sorted(map(tuple, ids.collect()))


def test_stream_merges_batches_and_drops_repeats(spark, tmp_path):
    from tracefold.streaming import ingest

    base = spark.sql("SELECT id AS event_id, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id % 5) AS ts, id % 3 AS user_id, element_at(array('view', 'purchase', 'signup', 'error'), int(id % 4) + 1) AS event_type, double(id) AS value, concat('{\"k\": ', id % 7, '}') AS props FROM range(200)").cache()
    for k in range(2):  # two files, the second one repeats a part of the first
        base.filter(f"event_id < {200 if k else 120}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.start_merge(ingest.events_stream(spark, str(tmp_path / "in")), out, "60 days").awaitTermination()
    expect = audit.audit_events(base)
    expect = graph.merge_edges(graph.flow_edges(expect).unionByName(audit.lineage_events(expect)))
    assert rows(ingest.merged_so_far(spark, out)) == rows(expect)


def test_stream_merges_late_events_and_lists_them(spark, tmp_path):
    from tracefold.streaming import ingest

    row = lambda k, day: (k, f"2024-01-{day:02} 10:00:00", 1, "view", 1.0, '{"k": 3}')
    schema = "event_id long, ts string, user_id long, event_type string, value double, props string"
    parts = [[row(1, 20), row(2, 21)], [row(3, 2), row(1, 20)], [row(4, 21), row(3, 2)]]
    for part in parts:
        spark.createDataFrame(part, schema).withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    ingest.start_merge(ingest.events_stream(spark, str(tmp_path / "in")), out, "1 day").awaitTermination()
    whole = audit.audit_events(spark.createDataFrame([row(1, 20), row(2, 21), row(3, 2), row(4, 21)], schema).withColumn("ts", F.to_timestamp("ts")))
    expect = graph.merge_edges(graph.flow_edges(whole).unionByName(audit.lineage_events(whole)))
    assert rows(ingest.merged_so_far(spark, out)) == rows(expect)
    late = {r.event_id for r in ingest.late_events(spark, out, schema.replace("ts string", "ts timestamp")).collect()}
    assert late <= {3} and late == ({3} if _order(spark, out) else set())


def _order(spark, out):
    """Whether the old event came behind a later one: files of one folder may be read in any order."""
    found = {r.event_id: r.batch for r in spark.read.parquet(out + "/ids").select("event_id", "batch").collect()}
    return found[3] > min(found.values())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_summary_is_written_and_read_back(spark, tmp_path):
    from tracefold.plans.summarise import summarise, write_summary

    third, lone, net = "vim(9)", "sleep(7)", "10.0.0.1:80->10.0.0.2:90"
    flow = [(MASTER, x, "execve", 1, 0.0) for x in (A, B, third, lone)]
    flow += [(net, A, "recvfrom", 2, 5.0), ("/in", A, "read", 3, 5.0), (A, "/mid", "write", 4, 5.0), ("/mid", B, "read", 5, 5.0), (B, "/poi", "write", 6, 5.0), ("/leaf1", A, "read", 2, 1.0), ("/leaf2", A, "read", 2, 1.0)]
    flow += [("/q,\"1\"", third, "read", 2, 1.0), (third, "/mid", "write", 3, 1.0), ("/in", third, "read", 2, 1.0), (third, "/poi", "write", 5, 1.0), ("/mid", A, "read", 2, 1.0)]
    flow += [(lone, "u(8)", "execve", 3, 0.0), ("u(8)", "/poi", "write", 6, 1.0)]
    result = summarise(spark.createDataFrame(flow, EDGE), spark.createDataFrame([("/poi", 6)], "node string, ts long"))
    out = str(tmp_path / "s")
    write_summary(result, out)
    ids = {r.label: r.nid for r in sinks.read_nodes(spark, out + "/nodes").collect()}
    assert ids == {r.label: r.nid for r in result.nodes.collect()} and lone in ids
    leaves = {r.proc: r for r in sinks.read_leaves(spark.read.text(out + "/leaves")).collect()}
    assert (leaves[A].nid, sorted(leaves[A].leaves), leaves[A].n_leaves, leaves[A].n_edges) == (ids[A], sorted([ids["/leaf1"], ids["/leaf2"], ids[net]]), 3, 3)
    assert {tuple(r) for r in sinks.read_process_files(spark.read.text(out + "/process_files")).collect()} == {(ids[r.proc], ids[r.file]) for r in compress.process_files(result.merged).collect()}
    groups = rows(sinks.read_groups(spark, out + "/groups"))
    assert groups == rows(sinks.group_table(result.merged, result.nodes)) and all(g[0].startswith("group") for g in groups)
    number = {r.community: r.number for r in result.numbers.collect()}
    assert sorted(number.values()) == list(range(1, len(number) + 1))
    dots = spark.read.text(out + "/communities").select("value", "community")
    nodes, arrows = sinks.read_community_dot(dots)
    assert {(r.community, r.label, r.nid) for r in nodes.collect()} == {(number[r.community], r.nid, ids[r.nid]) for r in result.members.collect()}
    assert {(r.community, r.src, r.dst, r.op) for r in arrows.collect()} == {(number[r.community], ids[r.src], ids[r.dst], r.op) for r in result.edges.collect()}
    assert {tuple(r) for r in sinks.read_membership(spark.read.text(out + "/membership")).collect() if "," not in r.label} >= {(number[r.community], r.nid) for r in result.members.collect() if "," not in r.nid}
    links = {tuple(r) for r in sinks.read_summary_dot(spark.read.text(out + "/summary_graph")).collect()}
    assert links == {(number[r.src], number[r.dst], r.key, r.label) for r in result.links.collect()}
    text = spark.createDataFrame(list(enumerate(r.value for r in spark.read.text(out + "/summary").collect())), "at int, value string")
    told = {(r.number, r.line_no): r.line for r in sinks.read_summary(text).collect()}
    masters = {number[r.community]: r.exe for r in result.communities.collect()}
    assert {n: told[n, 1] for n in masters} == masters
    for r in result.ranked.collect():
        assert told[number[r.community], r.rank + 2].startswith(",".join(r.path) + ",")
    # members after collapse: no node that a representative replaces
    gone = {r.nid for r in compress.collapse_map(result.merged).collect()}
    assert gone and not gone & {r.nid for r in result.members.collect()}


def test_logs_of_all_formats(spark, tmp_path):
    lines = ['{"event_id": 1, "ts": "2024-01-01 00:00:00", "proc": "a(1)", "object": "/x", "op": "read", "amount": 2.5}', "bad"]
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(str(tmp_path / "json"))
    events, bad = audit.read_audit_log(spark, str(tmp_path / "json"))
    assert events.count() == 1 and rows(bad) == [("bad",)]
    events.withColumn("ts", F.timestamp_micros("ts")).write.parquet(str(tmp_path / "parquet"))
    again, none = audit.read_audit_log(spark, str(tmp_path / "parquet"), "parquet")
    assert rows(again, "event_id", "ts", "proc") == rows(events, "event_id", "ts", "proc") and none.count() == 0


def test_learned_communities_overlap(spark, merged):
    found = community.learned_communities(merged).collect()
    assert {r.proc for r in found} == {MASTER, A, B, C}
    members = community.membership(merged, community.learned_communities(merged))
    assert {"/f/one", "/out"} <= {r.nid for r in members.collect()}
