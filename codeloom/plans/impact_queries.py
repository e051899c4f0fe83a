"""Change impact (group F) and telemetry (group G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import changes as C
from codeloom.operators import telemetry as T

from .edge_queries import PATHS, _paths
from .registry import query

HUNKS = "hunks AS (SELECT o_custkey AS owner, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') AS a, datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01') + 3 AS b FROM orders WHERE o_orderstatus = 'P')".replace(
    "datediff(CAST(o_orderdate AS DATE), DATE '1992-01-01')", "CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER)"
)


def _hunks(orders):
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("owner"), day.alias("a"), (day + 3).alias("b"))


@query("intervals orders", f"""WITH {HUNKS} SELECT i.owner, i.l_orderkey, count(*)::BIGINT AS hits FROM intervals i JOIN hunks h ON i.owner = h.owner AND i.a <= h.b AND h.a <= i.b GROUP BY ALL""")
def affected_nodes(intervals, orders):
    """Shipping spans of a customer that overlap a hunk of days of the same customer."""
    met = C.overlaps(intervals.select("owner", "l_orderkey", "a", "b"), _hunks(orders), "owner")
    return met.groupBy("owner", "l_orderkey").agg(F.count("*").alias("hits"))


ISLANDS = """islands AS (SELECT owner, min(a) AS a, max(b) AS b, count(*)::BIGINT AS n FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
    SELECT owner, a, b, CASE WHEN a > coalesce(max(b) OVER (PARTITION BY owner ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a - 1) THEN 1 ELSE 0 END AS fresh FROM intervals) x) y
  GROUP BY owner, island)"""


@query("intervals", f"WITH {ISLANDS} SELECT owner, a, b, n FROM islands")
def interval_islands(intervals):
    return C.islands(intervals.select("owner", "a", "b"), "owner").select("owner", "a", "b", "n")


@query("intervals", f"WITH {ISLANDS} SELECT owner, sum(b - a)::BIGINT AS length, count(*)::BIGINT AS islands FROM islands GROUP BY owner")
def interval_union(intervals):
    return C.union_length(intervals.select("owner", "a", "b"), "owner")


@query("intervals orders", f"""WITH {HUNKS}, {ISLANDS} SELECT owner, a, b FROM hunks h WHERE NOT EXISTS (SELECT 1 FROM islands i WHERE i.owner = h.owner AND i.a <= h.a AND h.b <= i.b)""".replace("a > coalesce(max(b)", "a > 1 + coalesce(max(b)").replace("a - 1) THEN 1", "a - 2) THEN 1"))
def own_lines_changed(intervals, orders):
    """Hunks that no merged span of the same owner covers."""
    return C.not_covered(_hunks(orders), intervals.select("owner", "a", "b"), "owner")


@query("intervals orders", f"""WITH {HUNKS} SELECT DISTINCT owner FROM hunks WHERE owner NOT IN (SELECT i.owner FROM intervals i JOIN hunks h ON i.owner = h.owner AND i.a <= h.b AND h.a <= i.b)""")
def unmapped_files(intervals, orders):
    hunks = _hunks(orders)
    return C.unmapped(hunks.select("owner").distinct(), C.overlaps(intervals.select("owner", "a", "b"), hunks, "owner"), "owner")


CHANGED = "changed AS (SELECT id FROM nodes WHERE kind = 'function' AND (length(id) + ascii(right(id, 1))) % 4 = 0)"


def _changed(nodes):
    return nodes.filter("kind = 'function' AND (length(id) + ascii(right(id, 1))) % 4 = 0").select("id")


LOCATED = """files AS (SELECT concat(module, '.ts') AS file, CASE WHEN n_nationkey % 2 = 0 THEN 'added' ELSE 'modified' END AS status, n_nationkey % 6 <> 0 AS has_hunks, n_nationkey FROM nation JOIN nation_module USING (n_nationkey) WHERE n_nationkey % 4 <> 3),
hunks AS (SELECT file, 13 * (s_suppkey % 160)::INTEGER + 2 AS a, 13 * (s_suppkey % 160)::INTEGER + 2 + (s_suppkey % 4)::INTEGER AS b, CASE s_suppkey % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'modified' ELSE 'deleted' END AS kind
          FROM supplier JOIN files ON s_nationkey = n_nationkey WHERE has_hunks)"""


def _change(nation, supplier):
    """Changed files of nations and hunks in them."""
    k = F.col("n_nationkey")
    named = nation.filter(k % 4 != 3).select("n_nationkey", F.concat(F.lit("tp:r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".ts")).alias("file"))
    files = named.select("file", F.when(k % 2 == 0, "added").otherwise("modified").alias("status"), (k % 6 != 0).alias("has_hunks"))
    s, at = F.col("s_suppkey"), (13 * (F.col("s_suppkey") % 160) + 2).cast("int")
    kind = F.when(s % 3 == 0, "added").when(s % 3 == 1, "modified").otherwise("deleted")
    hunks = supplier.join(named.filter(k % 6 != 0), F.col("s_nationkey") == k).select("file", at.alias("a"), (at + s % 4).cast("int").alias("b"), kind.alias("kind"))
    return files, hunks


TOUCHED_NODES = f"""{LOCATED}, placed AS (SELECT l.*, f.status, f.has_hunks FROM located l JOIN files f USING (file)),
met AS (SELECT p.id, p.file, p.status, greatest(p.a, h.a) AS a, least(p.b, h.b) AS b FROM placed p JOIN hunks h ON h.file = p.file AND p.a <= h.b AND h.a <= p.b WHERE p.kind NOT IN ('package', 'module')),
lines AS (SELECT id, file, status, unnest(range(a, b + 1)) AS line FROM met),
hit AS (SELECT DISTINCT id, file, status FROM lines l WHERE NOT EXISTS (SELECT 1 FROM located c WHERE c.parent_id = l.id AND c.a <= l.line AND l.line <= c.b)),
affected AS (SELECT id, file, status, true AS by_hunk FROM hit UNION ALL SELECT id, file, status, false FROM placed WHERE kind = 'module' AND file NOT IN (SELECT file FROM hit))"""


@query("located nation supplier", f"WITH {TOUCHED_NODES} SELECT * FROM affected", needs="located nation_module")
def changed_blocks(located, nation, supplier):
    """Nodes that hunks touch on their own lines, and modules that stand for their file."""
    files, hunks = _change(nation, supplier)
    return C.affected_nodes(located, files, hunks)


@query("located nation supplier", f"""WITH {LOCATED}, met AS (SELECT DISTINCT l.id, l.file FROM located l JOIN hunks h ON h.file = l.file AND l.a <= h.b AND h.a <= l.b WHERE l.kind NOT IN ('package', 'module'))
SELECT id, kind, id IN (SELECT id FROM met) OR kind = 'module' AND file IN (SELECT file FROM hunks) AND file NOT IN (SELECT file FROM met) AS is_changed FROM located""", needs="located nation_module")
def changed_tags(located, nation, supplier):
    return C.changed_tags(located, _change(nation, supplier)[1]).select("id", "kind", "is_changed")


@query("located nation supplier", f"""WITH {LOCATED}, l AS (SELECT n.id, unnest(range(greatest(n.a, h.a), least(n.b, h.b) + 1))::INTEGER AS line, CASE h.kind WHEN 'deleted' THEN 2 WHEN 'modified' THEN 1 ELSE 0 END AS r
FROM located n JOIN hunks h ON h.file = n.file AND n.a <= h.b AND h.a <= n.b) SELECT id, line, CASE max(r) WHEN 2 THEN 'deleted' WHEN 1 THEN 'modified' ELSE 'added' END AS kind FROM l GROUP BY ALL""", needs="located nation_module")
def changed_lines(located, nation, supplier):
    return C.changed_lines(located, _change(nation, supplier)[1])


@query("located nation supplier", f"""WITH {TOUCHED_NODES},
known AS (SELECT id AS flow FROM located WHERE kind = 'class'),
targets AS (SELECT k.flow, o.id AS target, o.file FROM known k JOIN located o ON o.kind = 'method' AND o.a % 50 = length(k.flow) % 50 AND right(o.id, 1) = right(k.flow, 1)),
hits AS (SELECT DISTINCT flow, file FROM targets WHERE target IN (SELECT id FROM affected)), h AS (SELECT flow, string_agg(file, ' ' ORDER BY file) AS files_hit FROM hits GROUP BY flow)
SELECT k.flow, l.file AS owner_file, k.flow IN (SELECT id FROM affected) AS owner_changed, coalesce(files_hit, '') AS files_hit FROM known k JOIN located l ON l.id = k.flow LEFT JOIN h USING (flow)
WHERE k.flow IN (SELECT id FROM affected) OR files_hit IS NOT NULL""", needs="located nation_module")
def flow_impact(located, nation, supplier):
    """Classes as flows that call methods of like names."""
    files, hunks = _change(nation, supplier)
    flows = located.filter("kind = 'class'").select(F.col("id").alias("flow"))
    name = lambda m, id: F.concat_ws("#", m % 50, F.substring(id, -1, 1)).alias("via")
    uses = flows.select("flow", name(F.length("flow"), "flow"))
    calls = located.filter("kind = 'method'").select(name(F.col("a"), "id"), F.col("id").alias("target"), F.lit("resolved").alias("resolution"))
    told = C.flow_impact(flows, calls, located, C.affected_nodes(located, files, hunks), uses=uses)
    return told.withColumn("files_hit", F.array_join("files_hit", " "))


@query("nodes edges", f"WITH {CHANGED} SELECT source AS flow, count(DISTINCT target)::BIGINT AS changed_targets FROM edges WHERE target IN (SELECT id FROM changed) GROUP BY source")
def affected_flows(nodes, edges):
    return C.affected_flows(edges.select(F.col("source").alias("flow"), "target"), _changed(nodes))


@query("nodes edges", f"""WITH RECURSIVE {CHANGED}, own AS (SELECT source, target FROM edges WHERE source IN (SELECT id FROM changed) AND target IN (SELECT id FROM changed)),
two AS (SELECT source, target FROM own UNION SELECT target, source FROM own),
reach AS (SELECT id, id AS other FROM changed UNION SELECT r.id, t.target FROM reach r JOIN two t ON t.source = r.other)
SELECT id, min(other) AS "group" FROM reach GROUP BY id""")
def change_groups(nodes, edges):
    return C.change_groups(_changed(nodes), edges)


MODS = """mods AS (SELECT path AS module, 0 AS k FROM paths WHERE p_partkey % 2 = 0 UNION SELECT regexp_replace(path, '^src/', ''), 1 FROM paths WHERE p_partkey % 6 = 0
UNION SELECT path, 2 FROM paths WHERE p_partkey % 10 = 0 UNION SELECT concat('./', path), 3 FROM paths WHERE p_partkey % 9 = 1)"""


@query("part supplier", f"""WITH {PATHS}, {MODS}, files AS (SELECT DISTINCT file, regexp_replace(file, '^([.]/)+', '') AS path FROM (SELECT concat(CASE WHEN p_partkey % 5 = 0 THEN './' WHEN p_partkey % 4 = 0 THEN 'repo/' ELSE '' END, path) AS file FROM paths)),
m AS (SELECT concat(module, '@', k) AS id, module AS raw, regexp_replace(module, '^([.]/)+', '') AS path FROM mods),
met AS (SELECT f.file, m.id, CASE WHEN m.raw = f.path THEN 1000000 WHEN m.path = f.path THEN 500000 ELSE length(m.path) END AS fit FROM files f JOIN m ON m.path = f.path OR ends_with(f.path, concat('/', m.path))),
best AS (SELECT file, id, rank() OVER (PARTITION BY file ORDER BY fit DESC) AS r FROM met), won AS (SELECT file, count(DISTINCT id) AS n, min(id) AS id FROM best WHERE r = 1 GROUP BY file)
SELECT f.file, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, CASE WHEN n = 1 THEN id END AS module FROM (SELECT DISTINCT file FROM files) f LEFT JOIN won USING (file)""")
def file_suffix_match(part, supplier):
    """Files of a larger tree against modules told by their path or a part of it, some of them twice."""
    paths = _paths(part, supplier)
    own = paths.filter("p_partkey % 2 = 0").select("path", F.lit(0)).union(paths.filter("p_partkey % 6 = 0").select(F.regexp_replace("path", "^src/", ""), F.lit(1)))
    own = own.union(paths.filter("p_partkey % 10 = 0").select("path", F.lit(2))).union(paths.filter("p_partkey % 9 = 1").select(F.concat(F.lit("./"), "path"), F.lit(3)))
    modules = own.toDF("module", "k").distinct().select("module", F.concat("module", F.lit("@"), F.col("k").cast("string")).alias("id"))
    lead = F.when(F.col("p_partkey") % 5 == 0, "./").when(F.col("p_partkey") % 4 == 0, "repo/").otherwise("")
    return C.suffix_match(paths.select(F.concat(lead, "path").alias("file")).distinct(), modules)


TOUCHED = "touched AS (SELECT DISTINCT regexp_replace(id, '#.*$', '') AS file FROM nodes WHERE kind = 'function' AND (starts_with(id, 'tp:Brand1/') OR starts_with(id, 'tp:r1/')))"


@query("nodes edges", f"""WITH {TOUCHED} SELECT regexp_replace(target, '#.*$', '') AS file, count(DISTINCT regexp_replace(source, '#.*$', ''))::BIGINT AS callers FROM edges
WHERE regexp_replace(target, '#.*$', '') IN (SELECT file FROM touched) AND regexp_replace(source, '#.*$', '') NOT IN (SELECT file FROM touched) GROUP BY 1""")
def blast_radius(nodes, edges):
    touched = nodes.filter("kind = 'function' AND (startswith(id, 'tp:Brand1/') OR startswith(id, 'tp:r1/'))").select(F.regexp_replace("id", "#.*$", "").alias("file")).distinct()
    return C.blast_radius(edges, touched, F.regexp_replace("source", "#.*$", ""))


@query("nodes edges", f"""WITH {CHANGED}, calls AS (SELECT DISTINCT source, target FROM edges WHERE target IN (SELECT id FROM changed) AND source NOT IN (SELECT id FROM changed)),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY source) AS rn FROM calls)
SELECT target AS id, count(*)::BIGINT AS callers, string_agg(source, ',' ORDER BY source) FILTER (WHERE rn <= 5) AS shown FROM r GROUP BY target""")
def deletion_impact(nodes, edges):
    return C.surviving_callers(edges, _changed(nodes))


@query("lineitem", """WITH r AS (SELECT l_orderkey AS run, l_linenumber AS line, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey) AS place FROM lineitem WHERE l_returnflag = 'A')
SELECT run, place AS line, CASE WHEN place <= run % 4 THEN 'modified' ELSE 'added' END AS kind FROM r""")
def line_kinds(lineitem):
    """Runs of added lines (the line items of an order), of which order key mod 4 lines replace deleted ones."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey"))
    rows = lineitem.filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run"), place.cast("long").alias("line"), (F.col("l_orderkey") % 4).alias("deleted"))
    return C.line_kinds(rows).drop("deleted")


@query("orders", """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 5 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 3 <> 0)
SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'deleted' WHEN a.v = b.v THEN 'unchanged' ELSE 'changed' END AS state, count(*)::BIGINT AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def version_diff(orders):
    k = F.col("o_orderkey")
    a = orders.filter(k % 5 != 0).select("o_orderkey", F.col("o_orderstatus").alias("v"))
    b = orders.filter(k % 3 != 0).select("o_orderkey", F.when(k % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("v"))
    return C.version_diff(a, b, "o_orderkey", "v")


@query("labels documents", """WITH r AS (SELECT lang, source, quality, toxic FROM labels JOIN documents USING (doc_id)),
l AS (SELECT lang, source, 'quality' AS counter, quality AS hits FROM r UNION ALL SELECT lang, source, 'toxic', toxic FROM r)
SELECT lang, source, counter, count_if(hits > 0)::BIGINT AS hit, count(*)::BIGINT AS total, floor(count_if(hits > 0) * 100.0::DOUBLE / count(*) + 0.5::DOUBLE)::BIGINT AS percent FROM l GROUP BY ALL""")
def counter_coverage(labels, documents):
    return C.counter_coverage(labels.join(documents.select("doc_id", "lang", "source"), "doc_id"), ["lang", "source"], ["quality", "toxic"])


@query("events", """SELECT event_type AS node, count(*)::BIGINT AS calls, count_if(event_type = 'error')::DOUBLE / count(*) AS error_rate, floor(quantile_cont(value, 0.5::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000 AS p50, floor(quantile_cont(value, 0.95::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000 AS p95,
floor(quantile_cont(value, 0.99::DOUBLE) * 10000 + 0.5::DOUBLE) / 10000 AS p99 FROM events GROUP BY event_type""")
def overlay_metrics(events):
    four = lambda c: (F.floor(F.col(c) * 10000 + F.lit(0.5)) / 10000).alias(c)
    rows = T.overlay(events.withColumn("is_error", F.col("event_type") == "error"), "event_type", "value")
    return rows.select("node", "calls", "error_rate", *[four(c) for c in ("p50", "p95", "p99")])


U = "('0x' || substr(sha256(concat('prod ', id, ' 42 {0}')), 1, 8))::BIGINT / 4294967295.0::DOUBLE"


@query("nodes", f"""WITH u AS (SELECT id, {U.format('count')} AS c, {U.format('p50')} AS p, {U.format('error')} AS e FROM nodes)
SELECT id, floor(exp(0.0::DOUBLE + c * 9.0::DOUBLE) + 0.5::DOUBLE)::BIGINT AS calls, floor(exp(0.0::DOUBLE + p * 6.0::DOUBLE) + 0.5::DOUBLE)::BIGINT AS p50, floor(pow(e, 3.0::DOUBLE) * 0.25::DOUBLE * 1000000 + 0.5::DOUBLE)::BIGINT AS errors_ppm FROM u""")
def mock_metrics(nodes):
    return T.mock_metrics(nodes, "prod", "42")


@query("spans", """WITH s AS (SELECT *, epoch_us(ts) AS t FROM spans), w AS (SELECT *, min(t) OVER (PARTITION BY user_id, trace) AS t0, max(t) OVER (PARTITION BY user_id, trace) AS t1,
row_number() OVER (PARTITION BY user_id, trace ORDER BY ts, event_id)::INTEGER AS row FROM s)
SELECT user_id, trace, event_id, row, t - t0 AS offset_us, floor((t - t0) * 1000.0::DOUBLE / greatest(t1 - t0, 1) + 0.5::DOUBLE) / 1000.0::DOUBLE AS at FROM w""")
def timeline(spans):
    return T.timeline(spans, ["user_id", "trace"])


@query("events", """WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS run FROM c),
r AS (SELECT user_id, run, min(event_type) AS state, count(*)::BIGINT AS n, min(event_id) AS first_id FROM n GROUP BY ALL)
SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY run) AS came_from FROM r""")
def observed_route(events):
    return T.routes(events, "user_id", "event_type", ["ts", "event_id"])


@query("conversations", """WITH s AS (SELECT lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS from_role, role AS to_role FROM conversations)
SELECT from_role, to_role, count(*)::BIGINT AS n FROM s WHERE from_role IS NOT NULL GROUP BY ALL""")
def dialogue_transitions(conversations):
    return T.transitions(conversations, ["conv_id"], "turn", "role")


@query("spans nodes unit_edges", """WITH p AS (SELECT concat('tp:r', user_id % 5, '/n', user_id % 25) AS source, concat('tp:r', event_id % 5, '/n', event_id % 25) AS target, count(*)::BIGINT AS n FROM spans GROUP BY ALL),
e AS (SELECT source, target, count_if(kind = 'calls') AS c, count_if(kind = 'instantiates') AS i FROM unit_edges GROUP BY ALL)
SELECT p.source, p.target, p.n, CASE WHEN c = 1 THEN 'observed' WHEN c > 1 THEN 'ambiguous' WHEN i = 1 THEN 'observed' WHEN i > 1 THEN 'ambiguous' ELSE 'runtime-only' END AS state FROM p LEFT JOIN e USING (source, target)""")
def span_overlay(spans, nodes, unit_edges):
    name = lambda c: F.concat(F.lit("tp:r"), (F.col(c) % 5).cast("string"), F.lit("/n"), (F.col(c) % 25).cast("string"))
    pairs = spans.groupBy(name("user_id").alias("source"), name("event_id").alias("target")).agg(F.count("*").alias("n"))
    return T.match_edges(pairs, unit_edges)


@query("spans", """SELECT user_id, trace, count(*)::BIGINT AS spans, count(DISTINCT event_type)::BIGINT AS types, count_if(event_type = 'error')::BIGINT AS errors,
CASE WHEN count(DISTINCT event_type = 'error') > 1 THEN 'mixed' WHEN bool_and(event_type = 'error') THEN 'error' ELSE 'ok' END AS status FROM spans GROUP BY ALL""")
def event_counts(spans):
    return T.event_counts(spans, ["user_id", "trace"], F.when(F.col("event_type") == "error", "error").otherwise("ok"))


@query("spans", "SELECT user_id, trace, epoch_us(max(ts)) AS last_us FROM spans GROUP BY ALL HAVING bool_or(event_type = 'purchase')")
def trace_candidates(spans):
    return T.candidates(spans, ["user_id", "trace"], "purchase")


@query("events", """WITH x AS (SELECT user_id, event_type, event_id % 2 AS side, row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY ts, event_id) AS nth FROM events),
a AS (SELECT * FROM x WHERE side = 0), b AS (SELECT * FROM x WHERE side = 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.nth IS NULL THEN 'after-only' WHEN b.nth IS NULL THEN 'before-only' ELSE 'matched' END AS presence, count(*)::BIGINT AS n
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.nth = b.nth GROUP BY ALL""")
def run_compare(events):
    return T.compare_runs(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), ["user_id", "event_type"])


@query("events", """WITH s AS (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, event_type FROM events) SELECT * FROM s WHERE previous <> event_type""")
def watch_changes(events):
    return T.watched_changes(events, "user_id", ["ts", "event_id"], "event_type")


@query("located nation supplier unit_edges", f"""WITH RECURSIVE {LOCATED}, m AS (SELECT l.id, l.file FROM located l JOIN files f USING (file) WHERE l.kind = 'module'),
own AS (SELECT DISTINCT source, target FROM unit_edges WHERE kind IN ('calls', 'extends') AND source IN (SELECT id FROM m) AND target IN (SELECT id FROM m)), two AS (SELECT source, target FROM own UNION SELECT target, source FROM own),
reach AS (SELECT id, id AS other FROM m UNION SELECT r.id, t.target FROM reach r JOIN two t ON t.source = r.other), g AS (SELECT id, min(other) AS grp FROM reach GROUP BY id),
r AS (SELECT grp, file, split_part(file, '/', 1) AS dir, split_part(file, '/', 2) AS name FROM g JOIN m USING (id)), d AS (SELECT grp, dir, row_number() OVER (PARTITION BY grp ORDER BY dir) AS k FROM (SELECT DISTINCT grp, dir FROM r)),
j AS (SELECT grp, string_agg(dir, '+' ORDER BY dir) FILTER (WHERE k <= 3) || CASE WHEN count(*) > 3 THEN '+…' ELSE '' END AS parts, count(*) AS dirs FROM d GROUP BY grp)
SELECT grp AS "group", CASE WHEN count(*) = 1 THEN min(name) WHEN min(dirs) = 1 AND (SELECT count(DISTINCT dir) FROM r) > 1 THEN min(dir) ELSE min(parts) END AS label, count(*)::BIGINT AS n_files FROM r JOIN j USING (grp) GROUP BY grp""", needs="located nation_module unit_edges")
def change_group_labels(located, nation, supplier, unit_edges):
    """Groups of changed nations and what they are called."""
    modules = located.filter("kind = 'module'").join(_change(nation, supplier)[0].select("file"), "file", "left_semi").select("id", "file")
    near = modules.select("id", F.col("id").alias("near"))
    groups = C.module_change_groups(modules, unit_edges.withColumn("resolution", F.lit(None).cast("string")), near)
    return C.group_labels(groups).select("group", "label", "n_files")
