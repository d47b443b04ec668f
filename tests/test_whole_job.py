"""Registered queries against brute force over the whole graph of a small input."""

import hashlib
import math
from collections import Counter, defaultdict


from tracefold.plans import catalog

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns or df.columns).collect())


def all_paths(weights, inputs, outputs):
    """{(community, path): score} by depth-first search."""
    after, ends = defaultdict(dict), {tuple(r) for r in outputs.select("community", "nid").collect()}
    for c, src, dst, w in weights.select("community", "src", "dst", "w").collect():
        after[c, src][dst] = w
    found = {}

    def go(c, path, score, last):
        for to, w in after[c, path[-1]].items():
            if to not in path:
                total = score + w + last * w
                if (c, to) in ends:
                    found[c, (*path, to)] = total
                go(c, (*path, to), total, w)

    for c, nid in inputs.select("community", "nid").collect():
        go(c, (nid,), 0.0, 0.0)
    return found


def test_simple_paths_have_no_limit_of_length(spark):
    from tracefold.operators import summary

    chain = [(f"n{k:02}", f"n{k + 1:02}") for k in range(13)] + [("n03", "n01"), ("n02", "n07"), ("n07", "n04"), ("n13", "n00")]
    weights = spark.createDataFrame([("c", s, d, 0.1 * (k + 1)) for k, (s, d) in enumerate(chain)], "community string, src string, dst string, w double")
    inputs = spark.createDataFrame([("c", "n00", 1)], "community string, nid string, first_out long")
    outputs = spark.createDataFrame([("c", "n13", 9), ("c", "n05", 9)], "community string, nid string, last_in long")
    expect = all_paths(weights, inputs, outputs)
    got = {(r.community, tuple(r.path)): r.score for r in summary.simple_paths(weights, inputs, outputs).collect()}
    assert max(len(path) for _, path in expect) == 14 and set(got) == set(expect)
    assert all(math.isclose(got[k], expect[k]) for k in got)


def test_registered_best_paths(spark):
    p = catalog.Graph(spark, SMALL)
    from tracefold.operators import summary

    expect, best = all_paths(summary.edge_weights(p.inner, p.at), p.inputs, p.outputs), {}
    pairs = {tuple(r) for r in p.pairs().collect()}
    for (c, path), score in expect.items():
        if (key := (c, path[0], path[-1])) in pairs:
            best[key] = min(best.get(key, (math.inf,)), (-round(score, 9), len(path) - 1, " ".join(path)))
    assert max(hops for _, hops, _ in best.values()) > 4
    assert rows(catalog._QUERIES["simple_paths"](p), "community", "path") == sorted((c, " ".join(path)) for c, path in expect)
    assert rows(catalog._QUERIES["infopath_best"](p), "community", "input", "output", "hops", "path") == sorted((*k, hops, text) for k, (_, hops, text) in best.items())


def test_summary_follows_long_paths(spark):
    from tracefold.plans.summarise import summarise

    net, a, b, c = "10.0.0.1:80->10.0.0.2:90", "vim(2)", "vim(3)", "vim(4)"
    chain = [net, a, "/one", b, "/two", c, "/poi"]
    flow = [("sh(1)", x, "execve", k, 0.0) for k, x in enumerate((a, b, c))] + [(s, d, "write", 10 + k, 5.0) for k, (s, d) in enumerate(zip(chain, chain[1:], strict=False))]
    result = summarise(spark.createDataFrame(flow, "src string, dst string, op string, ts long, amount double"), spark.createDataFrame([("/poi", 15)], "node string, ts long"))
    assert [r.path for r in result.ranked.collect()] == [chain]


def test_registered_components_take_every_edge(spark):
    edges = catalog.Graph(spark, SMALL).merged().select("src", "dst").collect()
    least = {x: x for e in edges for x in e}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for src, dst in edges:
        a, b = sorted((root(src), root(dst)))
        least[b] = a
    assert rows(catalog.QUERIES["components"](spark, SMALL)) == sorted((x, root(x)) for x in least)


def test_label_propagation_ends_where_no_label_changes(spark):
    from tracefold.operators import community

    clique = lambda prefix, n: [(f"{prefix}{i}", f"{prefix}{j}") for i in range(n) for j in range(i)]
    edges = [("a0", "b0"), ("x", "y"), *clique("a", 4), *clique("b", 5)] + [(f"u{k}(1)", f"/f{k // 2}") for k in range(6)] + [(f"u{k}(1)", "/dev/null") for k in range(6)]
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    label, step = {x: x for x in near}, 0
    while True:
        wanted = {}
        for x in near:
            n = Counter(label[y] for y in near[x])
            if n[label[x]] < max(n.values()):
                wanted[x] = min(c for c in n if n[c] == max(n.values()))
        if not wanted:
            break
        turn = {x: (x.endswith(")") == (step % 2 == 0), int(hashlib.md5(f"turn|{step}|{x}".encode()).hexdigest()[:8], 16), x) for x in wanted}
        label |= {x: c for x, c in wanted.items() if all(turn[y] < turn[x] for y in near[x] if y in turn)}
        step += 1
    got = dict(rows(community.label_propagation(spark.createDataFrame(edges, "src string, dst string"))))
    for x in near:  # no other label is more frequent around it
        n = Counter(got[y] for y in near[x])
        assert n[got[x]] == max(n.values())
    assert got == label and len({got[f"a{k}"] for k in range(4)}) == 1 and got["x"] == got["y"]
