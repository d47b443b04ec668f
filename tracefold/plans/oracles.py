"""DuckDB statements of the registered queries, over the driver's tables."""

from __future__ import annotations


def kind(x: str) -> str:
    return rf"CASE WHEN {x} LIKE '%->%' THEN 'n' WHEN regexp_matches({x}, '^[^/]*\([0-9]+\)$') THEN 'p' ELSE 'f' END"


def _path(k: str) -> str:
    return f"CASE WHEN {k} = 0 THEN '/dev/null' ELSE '/srv/t' || team || '/k' || {k} || CASE WHEN {k} % 3 = 0 THEN '.log' ELSE '' END END"


AUDIT = f"""
raw AS (SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value AS amount, user_id // 4 AS team,
  'u' || user_id || '(' || strftime(ts, '%Y%m%d') || ')' AS proc, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events),
audit AS (SELECT event_id, ts, user_id, team, proc, amount,
  CASE WHEN event_type = 'error' THEN '10.1.' || (team % 250) || '.' || (k % 3) || ':' || (5000 + k % 10) || '->192.0.2.7:443' ELSE {_path('k')} END AS object,
  CASE WHEN event_type = 'signup' THEN {_path('((k + 50) % 100)')} END AS object2,
  CASE WHEN event_type IN ('view', 'click') THEN 'read' WHEN event_type = 'purchase' THEN 'write' WHEN event_type = 'signup' THEN 'rename' WHEN k % 2 = 0 THEN 'recvfrom' ELSE 'write' END AS op FROM raw)"""
FLOW = f"""{AUDIT},
days AS (SELECT user_id, proc, min(ts) AS ts FROM audit GROUP BY user_id, proc),
firsts AS (SELECT user_id, min(proc) AS parent FROM days GROUP BY user_id),
lineage_rows AS (SELECT parent AS src, proc AS dst, 'execve' AS op, ts, CAST(0 AS DOUBLE) AS amount FROM days JOIN firsts USING (user_id) WHERE proc <> parent),
flow AS (SELECT CASE WHEN op = 'write' THEN proc ELSE object END AS src, CASE WHEN op = 'write' THEN object ELSE proc END AS dst, op, ts, amount FROM audit
  UNION ALL SELECT proc, object2, op, ts, amount FROM audit WHERE op = 'rename'),
edges AS (SELECT * FROM flow UNION ALL SELECT * FROM lineage_rows)"""
MERGED = f"""{FLOW},
merged AS MATERIALIZED (SELECT src, dst, op, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, sum(amount) AS amount FROM edges GROUP BY src, dst, op),
poi AS (SELECT arg_max(object, (ts, event_id)) AS node, max(ts) AS ts FROM audit WHERE op = 'write' AND object LIKE '/%')"""
COMPRESS = f"""{MERGED},
access AS (SELECT DISTINCT CASE WHEN {kind('src')} = 'p' THEN src ELSE dst END AS proc, CASE WHEN {kind('src')} = 'p' THEN dst ELSE src END AS resource FROM merged WHERE ({kind('src')} = 'p') <> ({kind('dst')} = 'p')),
holders AS (SELECT resource, count(*) AS n, min(proc) AS proc FROM access GROUP BY resource),
leaf AS (SELECT proc, resource AS leaf, {kind('resource')} AS type FROM holders WHERE n = 1),
pfile AS (SELECT a.proc, a.resource AS file FROM access a JOIN holders h USING (resource) WHERE h.n > 1 AND {kind('a.resource')} = 'f'),
parent AS (SELECT dst AS nid, min(src) AS parent FROM merged WHERE op IN ('execve', 'clone') GROUP BY dst),
psets AS (SELECT proc AS nid, list(file ORDER BY file) AS files FROM pfile GROUP BY proc),
pmembers AS (SELECT nid, parent, regexp_extract(nid, '^(.*)\\([0-9]+\\)$', 1) AS exe, files FROM parent JOIN psets USING (nid)),
pgroups AS (SELECT min(nid) OVER g AS rep, row_number() OVER (PARTITION BY parent, exe, files ORDER BY nid) AS seq, nid, parent, exe, count(*) OVER g AS size FROM pmembers WINDOW g AS (PARTITION BY parent, exe, files)),
fsets AS (SELECT file AS nid, list(proc ORDER BY proc) AS procs FROM pfile GROUP BY file),
fgroups AS (SELECT min(nid) OVER g AS rep, row_number() OVER (PARTITION BY procs ORDER BY nid) AS seq, nid, count(*) OVER g AS size FROM fsets WINDOW g AS (PARTITION BY procs)),
lmerge AS (SELECT leaf AS nid, min(leaf) OVER (PARTITION BY proc) AS rep FROM leaf WHERE type = 'f'),
cmap AS (SELECT nid, rep FROM lmerge WHERE nid <> rep UNION ALL SELECT nid, rep FROM pgroups WHERE size > 1 AND nid <> rep UNION ALL SELECT nid, rep FROM fgroups WHERE size > 1 AND nid <> rep),
collapsed AS (SELECT coalesce(a.rep, src) AS src, coalesce(b.rep, dst) AS dst, op, min(first_ts) AS first_ts, max(last_ts) AS last_ts, CAST(sum(n) AS BIGINT) AS n, sum(amount) AS amount
  FROM merged LEFT JOIN cmap a ON a.nid = src LEFT JOIN cmap b ON b.nid = dst GROUP BY 1, 2, 3)"""
COMMUNITY = f"""{COMPRESS},
kids AS (SELECT DISTINCT src AS parent, dst AS child FROM merged WHERE op IN ('execve', 'clone')),
touch AS (SELECT parent, child, resource FROM kids JOIN access ON access.proc = child),
related AS (SELECT DISTINCT a.parent, a.child AS a, b.child AS b FROM touch a JOIN touch b USING (parent, resource) UNION SELECT parent, child, child FROM kids),
closure(parent, a, b) AS (SELECT parent, a, b FROM related UNION SELECT c.parent, c.a, r.b FROM closure c JOIN related r ON r.parent = c.parent AND r.a = c.b),
communities AS MATERIALIZED (SELECT parent || '/' || min(b) AS community, a AS proc FROM closure GROUP BY parent, a),
members AS MATERIALIZED (SELECT DISTINCT community, nid, {kind('nid')} AS type FROM (SELECT community, proc AS nid FROM communities
  UNION ALL SELECT community, parent FROM communities JOIN kids ON child = proc UNION ALL SELECT community, resource FROM communities JOIN access USING (proc))),
cedges AS MATERIALIZED (SELECT a.community, m.* FROM merged m JOIN members a ON a.nid = m.src JOIN members b ON b.nid = m.dst AND b.community = a.community),
shared AS (SELECT nid, count(DISTINCT community) AS n_communities FROM members GROUP BY nid HAVING count(DISTINCT community) > 1),
spans AS (SELECT community, min(first_ts) AS start_ts, max(last_ts) AS end_ts FROM cedges GROUP BY community),
pp AS (SELECT DISTINCT community, src, dst FROM cedges WHERE {kind('src')} = 'p' AND {kind('dst')} = 'p' AND src <> dst),
roots AS (SELECT community, nid, (SELECT count(*) FROM pp WHERE pp.community = m.community AND pp.src = m.nid) AS started FROM members m WHERE type = 'p' AND NOT EXISTS (SELECT 1 FROM pp WHERE pp.community = m.community AND pp.dst = m.nid)),
masters AS (SELECT community, nid AS master, regexp_extract(nid, '^(.*)\\([0-9]+\\)$', 1) AS exe FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY started DESC, nid) AS r FROM roots) WHERE r = 1),
inputs AS (SELECT community, src AS nid, min(first_ts) AS first_out FROM cedges WHERE (src IN (SELECT nid FROM shared) OR {kind('src')} = 'n') AND src NOT IN (SELECT node FROM poi) GROUP BY community, src),
outputs AS (SELECT community, dst AS nid, max(last_ts) AS last_in FROM cedges WHERE dst IN (SELECT nid FROM shared) OR dst IN (SELECT node FROM poi) GROUP BY community, dst),
pairs AS (SELECT i.community, i.nid AS input, o.nid AS output FROM inputs i JOIN outputs o USING (community) WHERE i.nid <> o.nid AND first_out < last_in),
weights AS MATERIALIZED (SELECT community, src, dst, max(ln(1 + amount) / (1 + abs((SELECT ts FROM poi) - last_ts) / 3600000000)) AS w FROM cedges GROUP BY community, src, dst)"""
PATHS = f"""{COMMUNITY},
walk(community, input, spot, path, score, last_w, hops) AS (SELECT community, nid, nid, [nid], CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM inputs
  UNION ALL SELECT x.community, input, e.dst, list_append(path, e.dst), score + w + last_w * w, w, hops + 1 FROM walk x JOIN weights e ON e.community = x.community AND e.src = x.spot WHERE NOT list_contains(path, e.dst)),
paths AS (SELECT x.community, input, spot AS output, array_to_string(path, ' ') AS path, hops, score FROM walk x JOIN outputs o ON o.community = x.community AND o.nid = x.spot WHERE hops > 0),
best AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.community, p.input, p.output ORDER BY round(score, 9) DESC, hops, path) AS r FROM paths p JOIN pairs q ON q.community = p.community AND q.input = p.input AND q.output = p.output) WHERE r = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY round(score, 9) DESC, hops, path) AS rank, CASE WHEN max(score) OVER (PARTITION BY community) > 0 THEN score / max(score) OVER (PARTITION BY community) ELSE 0 END AS share FROM best)"""


def w(prelude: str, body: str) -> str:
    return f"WITH RECURSIVE {prelude.strip()}\n{body}"


EDGE = "src, dst, op, first_ts, last_ts, n, round(amount, 4) AS amount"


def _walks(steps: int, walks: int) -> str:
    parts = [f"w0 AS (SELECT node || '#' || k AS walk, 0 AS step, node FROM deg, (SELECT unnest(range({walks})) AS k) WHERE " + kind("node") + " = 'p')"]
    for s in range(1, steps + 1):
        drawn = f"SELECT walk, w.node AS node, CAST(('0x' || substr(md5('walk-1|' || walk || '|{s}'), 1, 8)) AS BIGINT) % degree AS slot FROM w{s - 1} w JOIN deg USING (node)"
        parts.append(f"w{s} AS MATERIALIZED (SELECT walk, {s} AS step, next AS node FROM ({drawn}) d JOIN adj USING (node, slot))")
    return ", ".join(parts)


STEPS, WALKS, SIZE, NEAR = 8, 2, 16, 2
GUIDED = f"""nb AS (SELECT node, next, max(w) AS w FROM (SELECT src AS node, dst AS next, CASE WHEN op IN ('execve', 'clone') THEN 3 ELSE 1 END AS w FROM merged
  UNION ALL SELECT dst, src, CASE WHEN op IN ('execve', 'clone') THEN 3 ELSE 1 END FROM merged) GROUP BY node, next),
adj AS MATERIALIZED (SELECT node, next, row_number() OVER (PARTITION BY node ORDER BY next, c) - 1 AS slot FROM (SELECT node, next, unnest(range(w)) AS c FROM nb)),
deg AS MATERIALIZED (SELECT node, count(*) AS degree FROM adj GROUP BY node), {_walks(STEPS, WALKS)},
walks AS MATERIALIZED ({" UNION ALL ".join(f"SELECT walk, step, node FROM w{s}" for s in range(STEPS + 1))})"""
_SIGNS = ", ".join(f"sum(gain * CASE WHEN CAST(('0x' || substr(h, {d + 1}, 1)) AS INTEGER) % 2 = 0 THEN 1 ELSE -1 END) AS d{d}" for d in range(SIZE))
VECTORS = f"""covisits AS MATERIALIZED (SELECT a.node, b.node AS context, count(*) AS n FROM walks a JOIN walks b ON a.walk = b.walk AND a.step <> b.step AND abs(a.step - b.step) <= {NEAR} GROUP BY a.node, b.node),
sums AS (SELECT node, sum(n) AS t FROM covisits GROUP BY node),
gains AS (SELECT c.node, greatest(0, ln(CAST(n AS DOUBLE) * (SELECT CAST(sum(n) AS DOUBLE) FROM covisits) / (a.t * b.t))) AS gain, md5(context) AS h FROM covisits c JOIN sums a ON a.node = c.node JOIN sums b ON b.node = c.context),
added AS (SELECT node, {_SIGNS} FROM gains GROUP BY node),
lengths AS (SELECT *, sqrt({" + ".join(f"d{d} * d{d}" for d in range(SIZE))}) AS length FROM added)"""


SHOW = "strftime(make_timestamp({0}), '%Y-%m-%d %H:%M:%S')"
SPAN = SHOW.format("start_ts") + " || '->' || " + SHOW.format("end_ts")

ORACLES = {
    "poi_lookup": w(MERGED, "SELECT node, ts FROM poi"),
    "events_parse": w(AUDIT, "SELECT event_id, ts, proc, object, object2, op, amount FROM audit"),
    "flow_edges": w(FLOW, "SELECT src, dst, op, ts, amount FROM edges"),
    "merged_edges": w(MERGED, f"SELECT {EDGE} FROM merged"),
    "stream_merged_edges": w(MERGED, f"SELECT {EDGE} FROM merged"),
    "edge_keys": w(MERGED, "SELECT src, dst, op, row_number() OVER (PARTITION BY src, dst ORDER BY op) - 1 AS key FROM merged"),
    "nodes": w(MERGED, f"""SELECT label, CASE WHEN t = 'p' THEN regexp_extract(label, '^(.*)\\([0-9]+\\)$', 1) WHEN t = 'n' THEN regexp_extract(label, '^(.*):[0-9]+->', 1) ELSE '' END AS attr1,
        CASE WHEN t = 'p' THEN regexp_extract(label, '\\(([0-9]+)\\)$', 1) WHEN t = 'n' THEN regexp_extract(label, '->(.*):[0-9]+$', 1) ELSE regexp_replace(label, '\\.[^./]*$', '') END AS attr2, t AS type
        FROM (SELECT label, {kind('label')} AS t FROM (SELECT src AS label FROM merged UNION SELECT dst FROM merged))"""),
    "node_ids": w(MERGED, f"SELECT t || CAST(dense_rank() OVER (PARTITION BY t ORDER BY label) AS VARCHAR) AS nid, label, t AS type FROM (SELECT label, {kind('label')} AS t FROM (SELECT src AS label FROM merged UNION SELECT dst FROM merged))"),
    "file_stem": w(MERGED, f"SELECT label AS path, regexp_replace(label, '\\.[^./]*$', '') AS stem FROM (SELECT src AS label FROM merged UNION SELECT dst FROM merged) WHERE {kind('label')} = 'f'"),
    "degree": w(MERGED, "SELECT label, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS label, 0 AS i, 1 AS o FROM (SELECT DISTINCT src, dst FROM merged) UNION ALL SELECT dst, 1, 0 FROM (SELECT DISTINCT src, dst FROM merged)) GROUP BY label"),
    "proc_lineage": w(COMMUNITY, "SELECT parent, child FROM kids"),
    "causal_backward": w(f"""{MERGED}, reach(node, ts) AS (SELECT node, ts FROM poi UNION SELECT e.src, e.ts FROM reach r JOIN edges e ON e.dst = r.node AND e.ts <= r.ts),
        bounds AS (SELECT node, max(ts) AS bound FROM reach GROUP BY node)""", "SELECT src, dst, op, min(e.ts) AS first_ts, max(e.ts) AS last_ts, count(*) AS n, round(sum(amount), 4) AS amount FROM edges e JOIN bounds ON node = dst AND e.ts <= bound GROUP BY src, dst, op"),
    "reachable": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders
        UNION SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
        r(root, node, hops) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT root, e.dst, hops + 1 FROM r JOIN e ON e.src = r.node) SELECT root, node, min(hops) AS hops FROM r GROUP BY root, node""",
    "leaf_nodes": w(COMPRESS, "SELECT proc, leaf, type FROM leaf"),
    "leaf_groups": w(COMPRESS, "SELECT proc, string_agg(leaf, ',' ORDER BY leaf) AS leaves, count(*) AS n_leaves, CAST(sum(c) AS BIGINT) AS n_edges FROM leaf JOIN (SELECT x, count(*) AS c FROM (SELECT src AS x FROM merged UNION ALL SELECT dst FROM merged) GROUP BY x) ON x = leaf GROUP BY proc"),
    "leaf_merge": w(COMPRESS, "SELECT nid, rep FROM lmerge"),
    "proc_files": w(COMPRESS, "SELECT proc, string_agg(file, ',' ORDER BY file) AS files, count(*) AS n_files FROM pfile GROUP BY proc"),
    "proc_groups": w(COMPRESS, "SELECT rep, seq, nid, parent, exe FROM pgroups WHERE size > 1"),
    "file_groups": w(COMPRESS, "SELECT rep, seq, nid FROM fgroups WHERE size > 1"),
    "collapsed_edges": w(COMPRESS, f"SELECT {EDGE} FROM collapsed"),
    "compression_stats": w(COMPRESS, """SELECT *, round(nodes_after / nodes_before, 6) AS node_ratio, round(edges_after / edges_before, 6) AS edge_ratio FROM (SELECT
        (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM merged UNION ALL SELECT dst FROM merged)) AS nodes_before, (SELECT count(*) FROM merged) AS edges_before,
        (SELECT count(DISTINCT x) FROM (SELECT src AS x FROM collapsed UNION ALL SELECT dst FROM collapsed)) AS nodes_after, (SELECT count(*) FROM collapsed) AS edges_after)"""),
    "components": f"""WITH RECURSIVE {MERGED.strip()}, both_ways AS MATERIALIZED (SELECT src AS a, dst AS b FROM merged UNION SELECT dst, src FROM merged),
        cl(node, component) USING KEY (node) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT e.b, min(c.component) FROM cl c JOIN both_ways e ON e.a = c.node JOIN recurring.cl r ON r.node = e.b WHERE c.component < r.component GROUP BY e.b)
        SELECT node, component FROM cl""",
    "lineage_communities": w(COMMUNITY, "SELECT community, proc FROM communities"),
    "membership": w(COMMUNITY, "SELECT community, nid, type FROM members"),
    "community_edges": w(COMMUNITY, f"SELECT community, {EDGE} FROM cedges"),
    "shared_nodes": w(COMMUNITY, "SELECT nid, n_communities FROM shared"),
    "community_stats": w(COMMUNITY, """SELECT m.community, count(*) AS n_nodes, count(*) FILTER (WHERE type = 'p') AS n_p, count(*) FILTER (WHERE type = 'f') AS n_f, count(*) FILTER (WHERE type = 'n') AS n_n,
        coalesce(any_value(e.c), 0) AS n_edges FROM members m LEFT JOIN (SELECT community, count(*) AS c FROM cedges GROUP BY community) e ON e.community = m.community GROUP BY m.community"""),
    "master_process": w(COMMUNITY, "SELECT community, master, exe FROM masters"),
    "time_span": w(COMMUNITY, "SELECT community, start_ts, end_ts FROM spans"),
    "infopath_inputs": w(COMMUNITY, "SELECT community, nid, first_out FROM inputs"),
    "infopath_outputs": w(COMMUNITY, "SELECT community, nid, last_in FROM outputs"),
    "infopath_pairs": w(COMMUNITY, "SELECT community, input, output FROM pairs"),
    "simple_paths": w(PATHS, "SELECT community, input, output, path, hops FROM paths"),
    "infopath_scores": w(PATHS, "SELECT community, path, round(score, 6) AS score FROM paths"),
    "infopath_best": w(PATHS, "SELECT community, input, output, path, hops, round(score, 6) AS score FROM best"),
    "infopath_rank": w(PATHS, "SELECT community, path, rank, round(share, 6) AS share FROM ranked"),
    "infopath_topk": w(PATHS, "SELECT community, path, rank FROM ranked WHERE rank <= 5"),
    "summary_edges": w(COMMUNITY, """SELECT i.community AS src, o.community AS dst, row_number() OVER (PARTITION BY i.community, o.community ORDER BY i.x) - 1 AS key, i.x AS label
        FROM (SELECT DISTINCT community, dst AS x FROM cedges) i JOIN (SELECT DISTINCT community, src AS x FROM cedges) o ON i.x = o.x JOIN shared ON shared.nid = i.x JOIN spans a ON a.community = i.community JOIN spans b ON b.community = o.community
        WHERE (a.start_ts, i.community) < (b.start_ts, o.community)"""),
    "community_summary": w(PATHS, f"""SELECT m.community, exe, {SPAN} AS span, coalesce(n_paths, 0) AS n_paths, coalesce(top_path, '') AS top_path FROM masters m LEFT JOIN spans USING (community)
        LEFT JOIN (SELECT community, count(*) AS n_paths, arg_min(path, rank) AS top_path FROM ranked GROUP BY community) USING (community)"""),
    "dot_lines": w(COMMUNITY, f"""SELECT community, row_number() OVER (PARTITION BY community ORDER BY part, a, b, c) AS line_no, line FROM (
        SELECT community, 1 AS part, nid AS a, '' AS b, '' AS c, '"' || nid || '" [shape=' || CASE type WHEN 'p' THEN 'box' WHEN 'f' THEN 'ellipse' ELSE 'parallelogram' END || '];' AS line FROM members
        UNION ALL SELECT community, 2, src, dst, op, '"' || src || '" -> "' || dst || '" [key=' || CAST(row_number() OVER (PARTITION BY community, src, dst ORDER BY op) - 1 AS VARCHAR) || ', label="' || src || '->' || dst || ': ' || op || '"];' FROM cedges
        UNION ALL SELECT DISTINCT community, 0, '', '', '', 'digraph {{' FROM members UNION ALL SELECT DISTINCT community, 3, '', '', '', '}}' FROM members)"""),
    "random_walks": w(f"{MERGED}, {GUIDED}", "SELECT walk, step, node FROM walks"),
    "embed": w(f"{MERGED}, {GUIDED}, {VECTORS}", " UNION ALL ".join(f"SELECT node, {d} AS dim, round(CASE WHEN length > 0 THEN d{d} / length ELSE 0 END, 6) + 0.0 AS value FROM lengths WHERE {kind('node')} = 'p'" for d in range(SIZE))),
    "community_f1": w(f"{COMMUNITY}, truth AS (SELECT DISTINCT 't' || team AS matched, proc AS nid FROM audit), pred AS (SELECT community, proc AS nid FROM communities)", """SELECT community, matched, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY f1 DESC, matched) AS r FROM (
        SELECT p.community, t.matched, 2 * count(*) / ((SELECT count(*) FROM pred x WHERE x.community = p.community) + (SELECT count(*) FROM truth y WHERE y.matched = t.matched)) AS f1 FROM pred p JOIN truth t USING (nid) GROUP BY p.community, t.matched)) WHERE r = 1"""),
    "majority_vote": w(f"""{COMMUNITY}, votes AS (SELECT proc AS nid, e AS expert, 'c' || (CAST(('0x' || substr(md5('vote|' || proc || '|' || e), 1, 8)) AS BIGINT) % 3) AS vote FROM communities, (SELECT unnest(['a', 'b', 'c']) AS e)),
        voted AS (SELECT nid, arg_min(vote, (-n, vote)) AS vote FROM (SELECT nid, vote, count(DISTINCT expert) AS n FROM votes GROUP BY nid, vote) WHERE n >= 2 GROUP BY nid)""", "SELECT proc AS nid, coalesce(vote, community) AS community, coalesce(vote, community) <> community AS changed FROM communities LEFT JOIN voted ON voted.nid = proc"),
}
