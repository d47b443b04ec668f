"""Sinks and their readers: node, leaf, group and file tables, dot graphs, text summary, membership.

Lines are rendered by expressions over node ids (``nid``: type letter and number) and labels; files are
written by Spark, one folder per community where the format has a file each. A line that lists a set
holds the whole set, as its format demands, so its length is that of the set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.functions.labels import edge_label, executable, quoted, shape, span_text
from tracefold.operators.compress import file_groups, leaf_nodes, proc_groups, process_files
from tracefold.operators.graph import numbered
from tracefold.operators.summary import time_span


def dot_lines(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, line_no, line) of a digraph per community: nodes by label, then edges.

    Communities are dealt once, as narrow rows in one order from which keys and line numbers come; the
    texts are made last.
    """
    row = lambda df, part, *cols: df.select("community", F.lit(part).alias("part"), *[(F.col(c) if c else F.lit("")).alias(x) for c, x in zip(cols, "abc", strict=True)])
    frame = members.select("community").distinct().select("community", F.explode(F.array(F.lit(0), F.lit(3))).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"))
    arrows = row(edges.select("community", "src", "dst", "op").distinct(), 2, "src", "dst", "op")
    dealt = frame.unionByName(row(members, 1, "nid", None, None)).unionByName(arrows).repartition("community")
    number = F.row_number().over(Window.partitionBy("community").orderBy("part", "a", "b", "c")).cast("long")
    key = (F.row_number().over(Window.partitionBy("community", "part", "a", "b").orderBy("c")) - 1).cast("string")
    a, b, part = F.col("a"), F.col("b"), F.col("part")
    node = F.concat(quoted(a), F.lit(" [shape="), shape(a), F.lit("];"))
    arrow = F.concat(quoted(a), F.lit(" -> "), quoted(b), F.lit(" [key="), F.col("key"), F.lit(", label="), quoted(edge_label(a, b, F.col("c"))), F.lit("];"))
    line = F.when(part == 0, "digraph {").when(part == 1, node).when(part == 2, arrow).otherwise("}")
    return dealt.withColumn("key", key).withColumn("line_no", number).select("community", "line_no", line.alias("line"))


def _keys(edges: DataFrame) -> DataFrame:
    order = Window.partitionBy("community", "src", "dst").orderBy("op")
    return edges.select("community", "src", "dst", "op").distinct().withColumn("key", (F.row_number().over(order) - 1).cast("long"))


def _named(rows: DataFrame, ids: DataFrame, label: str, name: str) -> DataFrame:
    """``rows`` with the nid of a label column."""
    return rows.join(ids.select(F.col("label").alias(label), F.col("nid").alias(name)), label)


def _listed(member: str) -> Column:
    return F.array_sort(F.collect_set(member))


def leaf_lines(merged: DataFrame, ids: DataFrame) -> DataFrame:
    """A ``line`` per process with leaves: nid, label, leaf nids, number of leaves and of their edges."""
    edges = merged.select(F.explode(F.array("src", "dst")).alias("leaf")).groupBy("leaf").agg(F.count("*").alias("edges"))
    rows = _named(_named(leaf_nodes(merged).join(edges, "leaf"), ids, "leaf", "lid"), ids, "proc", "nid")
    per = rows.groupBy("nid", "proc").agg(_listed("lid").alias("leaves"), F.count("*").cast("string").alias("n"), F.sum("edges").cast("string").alias("e"))
    return per.select(F.concat_ws(",", "nid", "proc", "leaves", "n", "e").alias("line"))


def read_leaves(lines: DataFrame) -> DataFrame:
    """(nid, proc, leaves, n_leaves, n_edges) of ``value`` lines."""
    part = F.split("value", ",", -1)
    n = F.size(part)
    return lines.select(part[0].alias("nid"), part[1].alias("proc"), F.slice(part, F.lit(3), n - 4).alias("leaves"), F.get(part, n - 2).cast("int").alias("n_leaves"), F.get(part, n - 1).cast("int").alias("n_edges"))


def group_table(merged: DataFrame, ids: DataFrame) -> DataFrame:
    """(group_id, seq, rep, parent, nid, label): process groups, then file groups, numbered by representative."""
    procs = proc_groups(merged).select(F.lit(0).alias("kind"), "rep", "seq", "nid", "parent")
    rows = procs.unionByName(file_groups(merged).select(F.lit(1).alias("kind"), "rep", "seq", "nid", F.lit("").alias("parent")))
    order = numbered(rows.select("kind", "rep").distinct().withColumn("all", F.lit(0)), ["all"], ["kind", "rep"], "group")
    rows = rows.join(order.select("kind", "rep", "group"), ["kind", "rep"])
    found = _named(_named(rows.withColumnRenamed("nid", "label"), ids, "label", "nid"), ids, "rep", "rid")
    return found.select(F.concat(F.lit("group"), F.col("group").cast("string")).alias("group_id"), F.col("seq").cast("int").alias("seq"), F.col("rid").alias("rep"), "parent", "nid", "label")


def write_groups(groups: DataFrame, path: str) -> None:
    groups.select("group_id", "seq", "rep", "parent", "nid", "label").write.mode("overwrite").csv(path, emptyValue="")


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("group_id string, seq int, rep string, parent string, nid string, label string").csv(path).fillna("", ["parent"])


def process_file_lines(merged: DataFrame, ids: DataFrame) -> DataFrame:
    """A ``line`` per process with non-leaf files: nid, file nids."""
    rows = _named(_named(process_files(merged), ids, "file", "fid"), ids, "proc", "nid")
    return rows.groupBy("nid").agg(_listed("fid").alias("files")).select(F.concat_ws(",", "nid", "files").alias("line"))


def read_process_files(lines: DataFrame) -> DataFrame:
    """(nid, file) rows of ``value`` lines."""
    part = F.filter(F.split("value", ",", -1), lambda x: x != "")
    return lines.select(part[0].alias("nid"), F.explode(F.slice(part, F.lit(2), F.size(part))).alias("file")).select("nid", "file")


def community_numbers(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(community, number): from 1 by start, then id; communities without edges come last."""
    spans = members.select("community").distinct().join(time_span(edges), "community", "left").select("community", F.coalesce("start_ts", F.lit((1 << 63) - 1)).alias("at"), F.lit(0).alias("all"))
    return numbered(spans, ["all"], ["at", "community"], "number").select("community", "number")


def community_dot_lines(members: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(community, line_no, line) of a digraph per community, nodes by nid with their labels."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    nodes = _named(members.select("community", F.col("nid").alias("label")), ids, "label", "nid")
    nodes = nodes.select("community", F.lit(1).alias("part"), F.col("nid").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), text(F.col("nid"), " [label=", quoted(text(F.col("nid"), ": ", F.col("label"))), ", shape=", shape(F.col("label")), "];").alias("line"))
    arrows = _named(_named(_keys(edges), ids, "src", "s"), ids, "dst", "d")
    arrows = arrows.select("community", F.lit(2).alias("part"), F.col("s").alias("a"), F.col("d").alias("b"), F.col("op").alias("c"), text(F.col("s"), " -> ", F.col("d"), "  [key=", F.col("key").cast("string"), ", label=", quoted(edge_label(F.col("s"), F.col("d"), F.col("op"))), "];").alias("line"))
    frame = lambda part, line: members.select("community").distinct().select("community", F.lit(part).alias("part"), F.lit("").alias("a"), F.lit("").alias("b"), F.lit("").alias("c"), F.lit(line).alias("line"))
    rows = frame(0, "digraph  {").unionByName(nodes).unionByName(arrows).unionByName(frame(3, "}"))
    return numbered(rows, ["community"], ["part", "a", "b", "c"], "line_no").select("community", "line_no", "line")


#: The line forms of the dot files.
_NODE, _ARROW = r'^(\w+) \[label="(\w+): (.*)", shape=(\w+)\];$', r'^(\w+) -> (\w+)  \[key=(\d+), label="\w+->\w+: (.*)"\];$'
_BOX, _LINK = r"^(\d+) \[label=C\d+, shape=box\];$", r'^(\d+) -> (\d+)  \[key=(\d+), label="(.*)"\];$'


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def read_community_dot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (nid, label, shape) and edges (src, dst, key, op) of ``value`` lines, beside their other columns."""
    rest = [c for c in lines.columns if c != "value"]
    get = lambda p, k: F.regexp_extract("value", p, k)
    nodes = lines.filter(F.col("value").rlike(_NODE)).select(*rest, get(_NODE, 1).alias("nid"), _plain(get(_NODE, 3)).alias("label"), get(_NODE, 4).alias("shape"))
    edges = lines.filter(F.col("value").rlike(_ARROW)).select(*rest, get(_ARROW, 1).alias("src"), get(_ARROW, 2).alias("dst"), get(_ARROW, 3).cast("int").alias("key"), get(_ARROW, 4).alias("op"))
    return nodes, edges


def summary_dot_lines(links: DataFrame, numbers: DataFrame) -> DataFrame:
    """(part, a, b, k, line) of the summary graph: a box per community, a labelled arrow per shared node."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    number = F.col("number").cast("long")
    boxes = numbers.select(F.lit(1).alias("part"), number.alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("k"), text(number, " [label=C", number, ", shape=box];").alias("line"))
    side = lambda c, n: numbers.select(F.col("community").alias(c), F.col("number").cast("long").alias(n))
    both = links.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    arrows = both.select(F.lit(2).alias("part"), "a", "b", F.col("key").cast("long").alias("k"), text(F.col("a"), " -> ", F.col("b"), "  [key=", F.col("key"), ", label=", quoted(F.col("label")), "];").alias("line"))
    return boxes.unionByName(arrows)


def read_summary_dot(lines: DataFrame) -> DataFrame:
    """(src, dst, key, label) of ``value`` lines."""
    get = lambda k: F.regexp_extract("value", _LINK, k)
    return lines.filter(F.col("value").rlike(_LINK)).select(get(1).cast("int").alias("src"), get(2).cast("int").alias("dst"), get(3).cast("int").alias("key"), _plain(get(4)).alias("label"))


def write_lines(lines: DataFrame, path: str, by: str | None = "community", order: tuple[str, ...] = ("line_no",)) -> None:
    """Text files, sorted within a community; one sub-folder per value of ``by``."""
    if by is None:
        lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
        return
    lines.repartition(by).sortWithinPartitions(by, *order).select(by, "line").write.mode("overwrite").partitionBy(by).text(path)


def write_summary_dot(links: DataFrame, numbers: DataFrame, path: str) -> None:
    lines = summary_dot_lines(links, numbers)
    head = lines.sparkSession.createDataFrame([(0, 0, 0, 0, "digraph  {"), (3, 0, 0, 0, "}")], "part int, a long, b long, k long, line string")
    write_lines(lines.unionByName(head), path, by=None, order=("part", "a", "b", "k"))


def summary_lines(masters: DataFrame, spans: DataFrame, ranked: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, line_no, line): the number, the master's executable, the span, then the ranked paths,
    each with its score behind its nodes."""
    span = F.coalesce(span_text(F.col("start_ts"), F.col("end_ts")), F.lit(""))
    head = numbers.join(masters, "community", "left").join(spans, "community", "left").select(
        "number", F.posexplode(F.array(F.concat(F.col("number").cast("string"), F.lit(": ")), F.coalesce(executable(F.col("master")), F.lit("")), span)).alias("line_no", "line"))
    paths = ranked.join(numbers, "community").select("number", (F.col("rank") + 2).alias("line_no"), F.concat_ws(",", "path", F.col("score").cast("string")).alias("line"))
    return head.unionByName(paths)


def read_summary(lines: DataFrame) -> DataFrame:
    """(number, line_no, line) of ``value`` lines of one file, read in order of ``at``."""
    starts = F.regexp_extract("value", r"^(\d+): $", 1).try_cast("int")
    order = Window.orderBy("at")
    rows = lines.select("at", "value", F.last(starts, ignorenulls=True).over(order).alias("number"))
    return rows.select("number", (F.row_number().over(Window.partitionBy("number").orderBy("at")) - 1).alias("line_no"), F.col("value").alias("line"))


def write_nodes(ids: DataFrame, path: str) -> None:
    """(nid, label, attr1, attr2, type) as CSV without header; values with commas are quoted."""
    ids.select("nid", "label", "attr1", "attr2", "type").write.mode("overwrite").csv(path)


def read_nodes(spark, path: str) -> DataFrame:
    return spark.read.schema("nid string, label string, attr1 string, attr2 string, type string").csv(path)


def membership_lines(members: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, line): a community's number and sorted labels, a comma behind each."""
    labels = members.groupBy("community").agg(_listed("nid").alias("labels")).join(numbers, "community")
    return labels.select("number", F.concat(F.concat_ws(",", F.col("number").cast("string"), "labels"), F.lit(",")).alias("line"))


def read_membership(lines: DataFrame) -> DataFrame:
    """(number, label) rows of ``value`` lines."""
    part = F.filter(F.split("value", ",", -1), lambda x: x != "")
    return lines.select(part[0].cast("int").alias("number"), F.explode(F.slice(part, F.lit(2), F.size(part))).alias("label")).select("number", "label")
