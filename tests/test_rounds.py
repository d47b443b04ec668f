"""Label propagation over several parts, against brute force, and what its rounds write."""

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrameWriter

from tracefold.operators import community
from tracefold.plans import catalog


def propagated(edges):
    """({node: label}, rounds) by the definition, node by node."""
    near = defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    process = {x: "->" not in x and re.search(r"^[^/]*\([0-9]+\)$", x) is not None for x in near}
    label, step = {x: x for x in near}, 0
    while True:
        wanted = {}
        for x in near:
            n = Counter(label[y] for y in near[x])
            if n[label[x]] < max(n.values()):
                wanted[x] = min(c for c in n if n[c] == max(n.values()))
        if not wanted:
            return label, step
        turn = {x: (process[x] == (step % 2 == 0), int(hashlib.md5(f"turn|{step}|{x}".encode()).hexdigest()[:8], 16), x) for x in wanted}
        label |= {x: c for x, c in wanted.items() if all(turn[y] < turn[x] for y in near[x] if y in turn)}
        step += 1


def labels(found):
    rows = found.collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.label for r in rows}


def test_rounds_of_few_changes_share_a_job(spark, monkeypatch):
    merged, written, write = catalog.Graph(spark, "/root/testdata/sf0.01").edges_all, [], DataFrameWriter.parquet
    expected, steps = propagated([(r.src, r.dst) for r in merged.select("src", "dst").collect()])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (written.append(path), write(self, path, *a, **k))[1])
    got = labels(community.label_propagation(merged))
    assert got == expected and steps > 15
    assert len(written) <= steps  # wants and labels of every node were two tables a round


def test_labels_do_not_depend_on_the_number_of_parts(spark, monkeypatch):
    from tracefold.operators import rounds

    hub = [(f"u{k}(1)", "/dev/null") for k in range(60)] + [(f"u{k}(1)", f"/f{k // 3}") for k in range(60)] + [(f"u{k}(1)", f"/f{(k * 7) % 20}") for k in range(60)]
    odd = [("é(2)", "/ü\n"), ("é(2)", "/z"), ("\U0001f600(3)", "/z"), ("￮(3)", "/z"), (None, "/z"), ("/z", None), ("/z", "/z"), ("", "u1(1)"), ("/z", "10.0.0.1:1->10.0.0.2:2")]
    expected, _ = propagated(hub + odd)
    monkeypatch.setattr(rounds, "FEW", 2)
    for least, most, parts in ((1_000, 1_000, 1), (100, 100, 4), (10, 7, None)):
        monkeypatch.setattr(rounds, "LEAST", least)
        monkeypatch.setattr(rounds, "MOST", most)
        assert parts in (None, rounds.parts_of(400, 4))
        assert labels(community.label_propagation(spark.createDataFrame(hub + odd, "src string, dst string"))) == expected
    nothing = community.label_propagation(spark.createDataFrame([("/z", "/z"), (None, "/a")], "src string, dst string"))
    assert nothing.columns == ["node", "label"] and nothing.collect() == []


def test_a_task_that_runs_again_leaves_the_file(spark, tmp_path):
    from tracefold.operators import rounds

    uri = f"file://{tmp_path}/twice"

    def run(batches):
        import numpy as np

        for batch in batches:
            rounds.Folder(uri).put("x", 0, np.arange(3))
            yield batch

    for _ in range(2):
        assert spark.range(1, numPartitions=1).mapInArrow(run, "id long").count() == 1
    assert [p.name for p in (tmp_path / "twice").iterdir() if not p.name.startswith(".")] == ["x-0"]
    values = rounds.Folder(uri).get("x", 0)
    values[0] = 9  # the reader's own copy
    assert rounds.Folder(uri).get("x", 0).tolist() == [0, 1, 2]
