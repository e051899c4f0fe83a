"""Views of a graph: gates, composition, linked systems, request checks, source texts (groups B, C and R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.functions.materialize import cut, stored
from codeloom.operators import cluster as G
from codeloom.operators import compose, gates, link, telemetry, tree
from codeloom.operators import metrics as M
from codeloom.operators import relations as R
from codeloom.operators import similarity as S
from codeloom.operators import validate as V
from codeloom.functions import paths

from .edge_queries import CALLS, PATHS, TEMPLATES, _calls, _paths
from .metric_queries import METRICS, METRIC_VIEWS
from .reach_queries import ANC, TESTS
from .registry import query
from .similarity_queries import PAIRS

IS_TEST = f"""(regexp_matches(path, '(?i)\\.(test|spec)\\.[a-z0-9]+$') OR regexp_matches(path, '(^|/)test_[^/]+\\.py$') OR regexp_matches(path, '_test\\.(py|go)$') OR regexp_matches(path, '(^|/)conftest\\.py$')
OR len(list_filter(string_split(path, '/')[:-2], lambda x: lower(x) IN {paths.TEST_DIRECTORIES} OR regexp_matches(x, '(?i)(^|-)(e2e|tests?|testbench|testkit)(-|$)'))) > 0)"""


@query("part supplier", f"""WITH {PATHS}, t AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN ['test', 'slow'] WHEN p_partkey % 3 = 1 THEN ['slow'] ELSE []::VARCHAR[] END AS own FROM paths)
SELECT path, p_partkey, array_to_string(CASE WHEN {IS_TEST} AND NOT list_contains(own, 'test') THEN list_append(own, 'test') ELSE own END, ',') AS tags FROM t""")
def test_tags(part, supplier):
    """The tag of tests on nodes of test files; some have it already."""
    k = F.col("p_partkey") % 3
    own = F.when(k == 0, F.array(F.lit("test"), F.lit("slow"))).when(k == 1, F.array(F.lit("slow")))
    return gates.tagged_tests(_paths(part, supplier).withColumn("tags", own), "path").withColumn("tags", F.array_join("tags", ","))


@query("occurrences", f"""WITH k AS (SELECT CASE line % 7 WHEN 0 THEN 'renders' WHEN 1 THEN 'imports' ELSE kind END AS kind FROM occurrences)
SELECT m.mode, count(*)::BIGINT AS n FROM k, (VALUES ('call'), ('ui'), ('logic'), ('modules')) AS m(mode) WHERE m.mode = 'ui' AND kind = 'renders' OR m.mode = 'call' AND kind IN {gates.CALL_KINDS} GROUP BY 1""")
def edges_by_mode(occurrences):
    rows = occurrences.select(F.when(F.col("line") % 7 == 0, "renders").when(F.col("line") % 7 == 1, "imports").otherwise(F.col("kind")).alias("kind"))
    out = None
    for mode in ("call", "ui", "logic", "modules"):
        one = gates.edges_for_mode(rows, mode).groupBy(F.lit(mode).alias("mode")).agg(F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("located occurrences", f"""WITH n AS (SELECT id, kind, CASE WHEN b % 9 = 0 THEN '  ' ELSE file END AS file FROM located UNION ALL SELECT DISTINCT target, 'function', file FROM occurrences WHERE starts_with(target, 'ext:') OR starts_with(target, 'unresolved:'))
SELECT id, kind, file FROM n WHERE trim(file) <> '' AND kind NOT IN {gates.SOURCELESS_KINDS} AND split_part(id, ':', 1) NOT IN {gates.SOURCELESS_LANGUAGES}""")
def source_backed(located, occurrences):
    own = located.select("id", "kind", F.when(F.col("b") % 9 == 0, "  ").otherwise(F.col("file")).alias("file"))
    out = occurrences.filter("startswith(target, 'ext:') OR startswith(target, 'unresolved:')").select(F.col("target").alias("id"), F.lit("function").alias("kind"), "file").distinct()
    return own.unionByName(out).filter(gates.is_source_backed(F.col("id"), F.col("kind"), F.col("file")))


DELETED = "deleted AS (SELECT id FROM nodes WHERE kind = 'function' AND right(id, 1) = '3')"


@query("occurrences nodes", f"""WITH {DELETED} SELECT kind, source, target, line FROM occurrences WHERE kind = 'calls' AND (source IN (SELECT id FROM deleted) OR target IN (SELECT id FROM deleted))
OR kind = 'references' AND target IN (SELECT id FROM deleted)""")
def deleted_context(occurrences, nodes):
    gone = nodes.filter("kind = 'function' AND right(id, 1) = '3'").select("id")
    return gates.around_deleted(occurrences.select("kind", "source", "target", "line"), gone)


@query("occurrences nodes", f"""WITH {DELETED}, e AS (SELECT CASE WHEN kind = 'instantiates' THEN 'implementedBy' ELSE kind END AS kind, source, target FROM occurrences)
SELECT * FROM e WHERE kind <> 'implementedBy' OR source IN (SELECT id FROM deleted)""")
def visible_wires(occurrences, nodes):
    """Inverse implementations only from suppliers whose id ends in 3."""
    shown = nodes.filter("kind = 'function' AND right(id, 1) = '3'").select("id")
    return gates.visible_wires(occurrences.select(F.when(F.col("kind") == "instantiates", "implementedBy").otherwise(F.col("kind")).alias("kind"), "source", "target"), shown)


@query("nation region", """SELECT n_name AS name, n_nationkey % 4 = 0 OR coalesce(r_name IN ('ASIA', 'EUROPE') AND n_nationkey % 2 = 1, false) AS allowed, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE 'tempo' END AS producer
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def environment_gate(nation, region):
    """Nations as telemetry sources; every fourth takes any environment."""
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    named = F.when(F.col("n_nationkey") % 2 == 1, F.array(F.when(F.col("r_name").isin("ASIA", "EUROPE"), "prod").otherwise("test")))
    mode = F.when(F.col("n_nationkey") % 4 == 0, "arbitrary").otherwise("enumerated")
    kind = F.when(F.col("n_nationkey") % 3 == 0, "file").otherwise("tempo")
    return rows.select(F.col("n_name").alias("name"), gates.allows_environment(mode, named, "prod").alias("allowed"), gates.expected_producer(kind).alias("producer"))


@query("nodes edges", f"""WITH RECURSIVE {ANC}, {TESTS}
SELECT 'node' AS what, kind, count(*)::BIGINT AS n FROM nodes WHERE id NOT IN (SELECT id FROM tests) GROUP BY kind
UNION ALL SELECT 'edge', kind, count(*) FROM edges WHERE source NOT IN (SELECT id FROM tests) AND target NOT IN (SELECT id FROM tests) GROUP BY kind""")
def without_tests(nodes, edges):
    n, e = gates.without_tests(nodes, edges, tree.closed_tests(nodes, nodes.filter("is_test").select("id")))
    by = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return by(n, "node").unionByName(by(e, "edge"))


@query("part supplier", f"""WITH {PATHS}, f AS (SELECT DISTINCT concat(CASE p_partkey % 4 WHEN 0 THEN '/' WHEN 1 THEN './' WHEN 2 THEN 'work/' ELSE '' END, replace(path, '/', CASE WHEN p_partkey % 5 = 0 THEN chr(92) ELSE '/' END)) AS file FROM paths WHERE p_partkey > 0),
m AS (SELECT min(p_partkey) AS id, path FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN path ELSE regexp_replace(path, '^src/', '') END AS path FROM paths WHERE p_partkey > 0) GROUP BY path),
n AS (SELECT file, regexp_replace(replace(file, chr(92), '/'), '^[.]?/', '') AS plain FROM f), met AS (SELECT file, id, path, row_number() OVER (PARTITION BY file ORDER BY plain = path DESC, length(path) DESC) AS r FROM n JOIN m ON plain = path OR ends_with(plain, concat('/', path)))
SELECT file, 'modified' AS status, id AS module, path AS module_file FROM met WHERE r = 1""")
def review_file_match(part, supplier):
    """Files of a review, written in several ways, against modules."""
    rows, k = _paths(part, supplier).filter("p_partkey > 0"), F.col("p_partkey")
    lead = F.when(k % 4 == 0, "/").when(k % 4 == 1, "./").when(k % 4 == 2, "work/").otherwise("")
    files = rows.select(F.concat(lead, F.when(k % 5 == 0, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))).alias("file")).distinct().withColumn("status", F.lit("modified"))
    modules = rows.select(k.alias("id"), F.when(k % 2 == 0, F.col("path")).otherwise(F.regexp_replace("path", "^src/", "")).alias("module"))
    return gates.review_files(files, modules)


UNITS = METRICS + f""", upn AS (SELECT u.id, u.package FROM units u)"""


def _unit_nodes(units):
    """Units below their packages, and the packages below two continents."""
    packs = units.select(F.col("package").alias("id")).distinct()
    top = lambda c: F.when(F.substring(c, -1, 1).isin("0", "1"), "tp:west").otherwise("tp:east")
    none = F.lit(None).cast("string")
    nodes = units.select("id", F.col("kind"), F.col("id").alias("display_name"), F.col("package").alias("parent_id"))
    nodes = nodes.unionByName(packs.select("id", F.lit("package").alias("kind"), F.concat(F.lit("region "), F.substring("id", -1, 1)).alias("display_name"), top("id").alias("parent_id")))
    tops = units.sparkSession.createDataFrame([("tp:west", "west"), ("tp:east", "east")], "id string, display_name string")
    nodes = cut(nodes.unionByName(tops.select("id", F.lit("package").alias("kind"), "display_name", none.alias("parent_id"))))
    return nodes, cut(tree.ancestors(nodes))


@query(METRIC_VIEWS, METRICS + """ SELECT package AS id, concat('region ', right(package, 1)) AS label, count(*)::BIGINT AS units, count_if(smells <> '')::BIGINT AS smelly FROM metrics JOIN units USING (id) GROUP BY package""")
def unit_clusters(units, *views):
    return compose.clusters(M.unit_metrics(units, *views), *_unit_nodes(units))


PLACED = """, up AS (SELECT id, package, CASE WHEN right(package, 1) IN ('0', '1') THEN 'tp:west' ELSE 'tp:east' END AS top FROM units),
placed AS (SELECT id, CASE WHEN top = 'tp:west' THEN top WHEN package IN ('tp:r2', 'tp:r3') THEN id ELSE package END AS card, CASE WHEN top = 'tp:west' THEN []::VARCHAR[] WHEN package IN ('tp:r2', 'tp:r3') THEN [top, package] ELSE [top] END AS frames FROM up)"""


def _placed(units):
    """The eastern frame is opened, and in it two of three regions."""
    nodes, closure = _unit_nodes(units)
    opened = units.sparkSession.createDataFrame([("tp:east",), ("tp:r2",), ("tp:r3",)], "id string")
    return compose.placements(units, nodes, closure, opened)


@query(METRIC_VIEWS, METRICS + PLACED + """, f AS (SELECT id, frames, unnest(frames) AS frame FROM placed)
SELECT frame AS id, CASE WHEN frame = 'tp:east' THEN NULL ELSE 'tp:east' END AS parent, CASE WHEN frame = 'tp:east' THEN 0 ELSE 1 END AS depth, count(*)::BIGINT AS units, count_if(smells <> '')::BIGINT AS smelly FROM f JOIN metrics USING (id) GROUP BY frame""")
def frame_counts(units, *views):
    return compose.frame_counts(M.unit_metrics(units, *views), _placed(units))


@query(METRIC_VIEWS, METRICS + PLACED + """ SELECT card AS id, count(*)::BIGINT AS units, sum(members)::BIGINT AS members, count_if(smells <> '')::BIGINT AS smelly, max(distance) AS worst FROM placed JOIN metrics USING (id) WHERE card <> id GROUP BY card""")
def package_cards(units, *views):
    return compose.package_cards(M.unit_metrics(units, *views), _placed(units))


@query("units unit_edges", f"""WITH x AS (SELECT 1){PLACED}
SELECT a.card AS source, b.card AS target, bool_and(kind IN ('extends', 'implements')) AS inheritance_only, bool_and(NOT (a.card = a.id AND b.card = b.id AND a.frames = b.frames)) AS cross_boundary
FROM unit_edges e JOIN placed a ON a.id = e.source JOIN placed b ON b.id = e.target WHERE a.card <> b.card GROUP BY 1, 2""")
def card_couplings(units, unit_edges):
    return compose.card_couplings(unit_edges, _placed(units))


@query(METRIC_VIEWS, METRICS + """, ends AS (SELECT source AS id FROM unit_edges UNION SELECT target FROM unit_edges), left_ AS (SELECT id, package FROM metrics JOIN units USING (id) WHERE members > 0 OR id IN (SELECT id FROM ends))
SELECT id, 'unit' AS role FROM left_ UNION ALL SELECT DISTINCT package, 'frame' FROM left_ UNION ALL SELECT DISTINCT CASE WHEN right(package, 1) IN ('0', '1') THEN 'tp:west' ELSE 'tp:east' END, 'frame' FROM left_""")
def composition(units, unit_edges, *views):
    """Few units, so each stands for itself in the frames of its packages."""
    nodes, closure = _unit_nodes(units)
    return compose.composition(M.unit_metrics(units, unit_edges, *views), unit_edges, nodes, closure, nodes.filter("false").select("id"))[0]


@query(METRIC_VIEWS, METRICS + """ SELECT DISTINCT m.id AS target, unit, CASE WHEN distance <= 0.2 THEN 'good' WHEN distance >= 0.7 THEN 'bad' ELSE 'warn' END AS tone, smells <> '' AS smelly FROM members m JOIN metrics x ON x.id = m.unit WHERE right(m.id, 1) = '7'""")
def call_owners(units, unit_edges, members, *views):
    wanted = members.filter(F.substring("id", -1, 1) == "7").select(F.col("id").alias("target"))
    return compose.owners(wanted, members.select("id", "unit"), M.unit_metrics(units, unit_edges, members, *views))


SYSTEMS = """sys_nodes AS (SELECT CASE WHEN starts_with(id, 'tp:r') THEN 'web shop' ELSE 'stock' END AS system, id, kind, parent_id, regexp_replace(id, '[#].*$', '') AS file, id AS ord FROM nodes
UNION ALL SELECT s, 'ext:npm/lib', 'external', NULL, concat('lib of ', s), 'z' FROM (VALUES ('web shop'), ('stock')) AS v(s) UNION ALL SELECT 'stock', 'ipc:http/channel=x', 'channel', NULL, 'x', 'y'),
placed AS (SELECT *, CASE WHEN split_part(id, ':', 1) IN ('ext', 'ipc') THEN id ELSE concat('tp:', system, '/', regexp_replace(id, '^[^:]*:', '')) END AS pid,
           CASE WHEN parent_id IS NULL THEN concat('sys:', replace(system, ' ', '-')) ELSE concat('tp:', system, '/', regexp_replace(parent_id, '^[^:]*:', '')) END AS pparent FROM sys_nodes WHERE kind <> 'channel')"""


def _systems(nodes):
    own = nodes.select(F.when(F.col("id").startswith("tp:r"), "web shop").otherwise("stock").alias("system"), "id", "kind", "parent_id", F.regexp_replace("id", "#.*$", "").alias("file"), F.col("id").alias("ord"))
    more = [("web shop", "ext:npm/lib", "external", None, "lib of web shop", "z"), ("stock", "ext:npm/lib", "external", None, "lib of stock", "z"), ("stock", "ipc:http/channel=x", "channel", None, "x", "y")]
    return own.unionByName(nodes.sparkSession.createDataFrame(more, own.schema))


@query("nodes", f"""WITH {SYSTEMS}, r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY system, ord) AS k FROM placed)
SELECT pid AS id, kind, CASE WHEN pid = id THEN parent_id ELSE pparent END AS parent_id, CASE WHEN pid = id THEN file ELSE concat(system, '/', file) END AS file FROM r WHERE k = 1
UNION ALL SELECT DISTINCT concat('sys:', replace(system, ' ', '-')), 'system', NULL, system FROM sys_nodes""")
def linked_nodes(nodes):
    """Two systems under one roof; they share an outside package, and a channel of one of them goes."""
    return link.linked_nodes(_systems(nodes))


@query("edges", """WITH se AS (SELECT CASE WHEN starts_with(source, 'tp:r') THEN 'web shop' ELSE 'stock' END AS system, kind, source, target FROM edges
  UNION ALL SELECT DISTINCT 'stock', 'sends', source, 'ipc:http/channel=x' FROM edges WHERE kind = 'calls' UNION ALL SELECT DISTINCT 'web shop', 'imports', source, 'ext:npm/lib' FROM edges WHERE kind = 'references'),
p AS (SELECT system, kind, CASE WHEN starts_with(source, 'tp:') THEN concat('tp:', system, '/', source[4:]) ELSE source END AS source, CASE WHEN starts_with(target, 'tp:') THEN concat('tp:', system, '/', target[4:]) ELSE target END AS target FROM se WHERE kind NOT IN ('sends', 'handles'))
SELECT concat(kind, '@', source, '|', target) AS id, kind, source, target, system FROM p""")
def linked_edges(edges):
    """The edges of both systems: ends set apart, outside packages shared, sends of a single system gone."""
    system = F.when(F.col("source").startswith("tp:r"), "web shop").otherwise("stock")
    own = edges.select(system.alias("system"), "kind", "source", "target")
    sent = edges.filter("kind = 'calls'").select(F.lit("stock").alias("system"), F.lit("sends").alias("kind"), "source", F.lit("ipc:http/channel=x").alias("target")).distinct()
    outside = edges.filter("kind = 'references'").select(F.lit("web shop").alias("system"), F.lit("imports").alias("kind"), "source", F.lit("ext:npm/lib").alias("target")).distinct()
    return link.linked_edges(own.unionByName(sent).unionByName(outside))


PORTS = f"""{CALLS}, calls_s AS (SELECT channel, CASE WHEN contains(channel, '/2') THEN 'api' END AS scope, CASE WHEN length(channel) % 2 = 0 THEN 'shop' ELSE 'web' END AS system FROM calls),
templates AS (SELECT t AS channel, s.scope, s.system FROM (SELECT unnest({TEMPLATES}) AS t), (VALUES (NULL, 'shop'), ('api', 'stock')) AS s(scope, system)),
shaped AS (SELECT 'c' AS side, channel, scope FROM calls_s UNION ALL SELECT 't', channel, scope FROM templates),
sh AS (SELECT DISTINCT side, channel, scope, CASE WHEN regexp_matches(channel, '^[A-Z]+ ') THEN split_part(channel, ' ', 1) ELSE 'GET' END AS method, regexp_replace(channel, '^[A-Z]+ ', '') AS path,
       string_split(trim(regexp_replace(channel, '^[A-Z]+ ', ''), '/'), '/') AS parts FROM shaped),
fit AS (SELECT DISTINCT c.method, c.scope, c.path AS call, t.path AS template, len(list_filter(t.parts, lambda x: starts_with(x, ':') OR x = '*')) AS wild FROM sh c JOIN sh t ON c.side = 'c' AND t.side = 't' AND c.method = t.method
        AND c.scope IS NOT DISTINCT FROM t.scope AND len(c.parts) = len(t.parts) WHERE len(list_filter(list_zip(c.parts, t.parts), lambda z: z[1] <> z[2] AND NOT starts_with(z[2], ':') AND z[2] <> '*')) = 0),
best AS (SELECT *, rank() OVER (PARTITION BY method, scope, call ORDER BY wild) AS r FROM fit), won AS (SELECT method, scope, call, min(template) AS template FROM best WHERE r = 1 GROUP BY ALL HAVING count(*) = 1),
outs AS (SELECT s.*, w.template IS NOT NULL AND w.template <> w.call AS joined, CASE WHEN w.template IS NOT NULL AND w.template <> w.call THEN concat(w.method, ' ', w.template) ELSE s.channel END AS to_channel
         FROM calls_s s LEFT JOIN won w ON w.method = CASE WHEN regexp_matches(s.channel, '^[A-Z]+ ') THEN split_part(s.channel, ' ', 1) ELSE 'GET' END AND w.call = regexp_replace(s.channel, '^[A-Z]+ ', '') AND w.scope IS NOT DISTINCT FROM s.scope),
ports AS (SELECT system, 'out' AS direction, to_channel AS channel, scope, joined FROM outs UNION ALL SELECT system, 'in', channel, scope, false FROM templates)"""


def _ports(pages):
    calls = _calls(pages).select(F.when(F.length("channel") % 2 == 0, "shop").otherwise("web").alias("system"), F.lit("out").alias("direction"), "channel", F.when(F.col("channel").contains("/2"), "api").alias("scope"))
    rows = [(s, "in", t, scope) for t in TEMPLATES for s, scope in (("shop", None), ("stock", "api"))]
    both = calls.unionByName(pages.sparkSession.createDataFrame(rows, "system string, direction string, channel string, scope string"))
    none = F.lit(None).cast("string")
    return both.select("*", F.lit("http").alias("protocol"), none.alias("lane"), F.lit("global").alias("scope_kind"), F.concat(F.lit("ts:"), "system", F.lit("/m")).alias("owner"), none.alias("handler"), F.lit(1.0).alias("confidence"))


@query("page_paths", f"WITH {PORTS} SELECT system, direction, channel, scope, joined FROM ports")
def unified_channels(pages):
    """HTTP calls of pages on the templates of their scope."""
    return link.unified_http(_ports(pages)).select("system", "direction", "channel", "scope", "joined")


@query("page_paths", f"""WITH {PORTS}, sides AS (SELECT scope, channel, list_distinct(list(system) FILTER (WHERE direction = 'out')) AS o, list_distinct(list(system) FILTER (WHERE direction = 'in')) AS i FROM ports GROUP BY ALL),
s AS (SELECT *, coalesce(len(o), 0) = 0 OR coalesce(len(i), 0) = 0 AS dangling, len(list_distinct(list_concat(coalesce(o, []), coalesce(i, [])))) > 1 AS two FROM sides)
SELECT (SELECT count(DISTINCT system) FROM ports)::BIGINT AS systems, (SELECT count_if(joined) FROM ports)::BIGINT AS template_joins, count(*)::BIGINT AS channels, count_if(NOT dangling AND two)::BIGINT AS cross_system, count_if(dangling)::BIGINT AS dangling FROM s""")
def joint_stats(pages):
    return link.joint_stats(link.unified_http(_ports(pages)))


TRACED = """sp AS (SELECT o_custkey AS trace, l_orderkey * 10 + l_linenumber AS span, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_partkey % 40 = 0 THEN l_orderkey * 10 + 9 WHEN l_partkey % 37 = 0 THEN l_orderkey * 10 + l_linenumber ELSE l_orderkey * 10 + l_linenumber - 1 END AS parent,
             epoch(o_orderdate)::BIGINT AS s, epoch(l_shipdate)::BIGINT AS e, l_quantity::BIGINT AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tr AS (SELECT trace, min(s) + CASE WHEN trace % 5 = 0 THEN 864000 ELSE 0 END AS s, max(e) AS e, CASE WHEN trace % 7 = 0 THEN -1 ELSE min(span) END AS root, trace % 3 = 0 AS complete, trace % 2 AS dropped FROM sp GROUP BY trace),
ev AS (SELECT trace, span, concat('e', span % 50) AS event, s + q * 86400 AS moment, q AS emitted, 40 AS iterations FROM sp WHERE q > 35)"""


@query("lineitem orders", f"""WITH {TRACED}, one AS (SELECT trace, span, count(*) AS n, min(s) AS s0, max(e) AS e1 FROM sp GROUP BY ALL)
SELECT 'TRACE_TIME' AS code, trace::VARCHAR AS subject FROM tr WHERE s > e
UNION ALL SELECT 'COMPLETE_WITH_DROPS', trace::VARCHAR FROM tr WHERE complete AND dropped > 0
UNION ALL SELECT 'ROOT_MISSING', trace::VARCHAR FROM tr WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.trace = tr.trace AND sp.span = tr.root)
UNION ALL SELECT 'DUPLICATE_SPAN', concat(trace, '/', span) FROM one, range(1, n) AS r(i)
UNION ALL SELECT 'SPAN_TIME', concat(trace, '/', span) FROM sp WHERE s > e
UNION ALL SELECT 'SPAN_OUTSIDE_TRACE', concat(sp.trace, '/', span) FROM sp JOIN tr USING (trace) WHERE sp.s < tr.s OR sp.e > tr.e
UNION ALL SELECT 'PARENT_MISSING', concat(trace, '/', span) FROM sp WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM one o WHERE o.trace = sp.trace AND o.span = sp.parent)
UNION ALL SELECT DISTINCT 'PARENT_CYCLE', trace::VARCHAR FROM (SELECT trace, span, min(concat(trace, '/', parent)) FILTER (WHERE parent IS NOT NULL) AS up FROM sp GROUP BY ALL) x WHERE up = concat(trace, '/', span)
UNION ALL SELECT 'DUPLICATE_EVENT', concat(trace, '/', event) FROM (SELECT trace, event, count(*) AS n FROM ev GROUP BY ALL) x, range(1, n) AS r(i)
UNION ALL SELECT 'EVENT_OUTSIDE_SPAN', concat(ev.trace, '/', event) FROM ev JOIN one o USING (trace, span) WHERE moment < s0 OR moment > e1
UNION ALL SELECT 'LOOP_COUNT', concat(trace, '/', event) FROM ev WHERE emitted > iterations
UNION ALL SELECT 'TOO_MANY_EVENTS', trace::VARCHAR FROM ev GROUP BY trace HAVING count(*) > {V.MOST_EVENTS}""")
def trace_issues(lineitem, orders):
    """Customers as traces, line items as spans with parents and events, some of them wrong."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    key, k = F.col("l_orderkey") * 10, F.col("l_linenumber")
    parent = F.when(k == 1, None).when(F.col("l_partkey") % 40 == 0, key + 9).when(F.col("l_partkey") % 37 == 0, key + k).otherwise(key + k - 1)
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    spans = cut(rows.select(F.col("o_custkey").alias("trace"), (key + k).alias("span"), parent.alias("parent"), seconds("o_orderdate").alias("start"), seconds("l_shipdate").alias("end"), F.col("l_quantity").cast("long").alias("q")))
    t = F.col("trace")
    traces = spans.groupBy("trace").agg((F.min("start") + F.when(t % 5 == 0, 864000).otherwise(0)).alias("start"), F.max("end").alias("end"), F.when(t % 7 == 0, -1).otherwise(F.min("span")).alias("root"))
    traces = traces.withColumns({"complete": t % 3 == 0, "dropped": t % 2})
    events = spans.filter("q > 35").select("trace", "span", F.concat(F.lit("e"), (F.col("span") % 50).cast("string")).alias("event"), (F.col("start") + F.col("q") * 86400).alias("at"), F.col("q").alias("emitted"), F.lit(40).alias("iterations"))
    return V.trace_issues(traces, spans.drop("q"), events)


@query("part supplier", """WITH f AS (SELECT p_brand AS document, p_partkey AS k, CASE WHEN p_partkey % 211 = 0 THEN '../x' WHEN p_partkey % 223 = 0 THEN 'a//b' ELSE concat('src/', p_partkey % 50) END AS file, p_size AS hits, p_partkey % 30 AS line, p_partkey % 30 + CASE WHEN p_partkey % 307 = 0 THEN -1 ELSE 2 END AS end_line FROM part),
bad AS (SELECT document FROM f WHERE file IN ('../x', 'a//b') OR hits < 0 OR end_line < line) SELECT document, count(*)::BIGINT AS n FROM f WHERE document NOT IN (SELECT document FROM bad) GROUP BY document""")
def sound_coverage(part, supplier):
    """Coverage documents of brands; one bad counter rejects its document."""
    k = F.col("p_partkey")
    file = F.when(k % 211 == 0, "../x").when(k % 223 == 0, "a//b").otherwise(F.concat(F.lit("src/"), (k % 50).cast("string")))
    rows = part.select(F.col("p_brand").alias("document"), file.alias("file"), F.lit("function").alias("kind"), k.alias("entry"), F.lit(0).alias("arm"), (k % 30).alias("line"), F.lit(0).alias("col"),
                       (k % 30 + F.when(k % 307 == 0, -1).otherwise(2)).alias("end_line"), F.lit(0).alias("end_col"), F.col("p_size").alias("hits"))
    return V.sound_coverage(rows).groupBy("document").agg(F.count("*").alias("n"))


@query("orders", """WITH f AS (SELECT o_custkey % 97 AS document, o_orderkey AS k, CASE WHEN o_orderkey % 1999 = 0 THEN 'moved' ELSE 'added' END AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 40 + 1 END AS a, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 40 + CASE WHEN o_orderkey % 1501 = 0 THEN 0 ELSE 1 END END AS b FROM orders)
SELECT document, count(*)::BIGINT AS n FROM f WHERE document NOT IN (SELECT document FROM f WHERE status = 'moved' OR b < a) GROUP BY document""")
def sound_changes(orders):
    k = F.col("o_orderkey")
    some = lambda c: F.when(k % 3 != 0, c)
    rows = orders.select((F.col("o_custkey") % 97).alias("document"), k.cast("string").alias("path"), F.when(k % 1999 == 0, "moved").otherwise("added").alias("status"), some(k % 40 + 1).alias("start"), some(k % 40 + F.when(k % 1501 == 0, 0).otherwise(1)).alias("stop"))
    return V.sound_changes(rows).groupBy("document").agg(F.count("*").alias("n"))


@query("part", """WITH f AS (SELECT p_brand AS document, p_partkey % 2 AS scope, p_partkey AS k, concat(p_name, '#', p_partkey % 400) AS address, CASE WHEN p_partkey % 331 = 0 THEN 'zz' ELSE sha256(p_name) END AS digest FROM part),
bad AS (SELECT document FROM f WHERE digest = 'zz' UNION SELECT document FROM f GROUP BY document, scope, address HAVING count(*) > 1) SELECT document, count(*)::BIGINT AS n FROM f WHERE document NOT IN (SELECT document FROM bad) GROUP BY document""")
def sound_fingerprints(part):
    k = F.col("p_partkey")
    address = F.concat("p_name", F.lit("#"), (k % 400).cast("string"))
    rows = part.select(F.col("p_brand").alias("document"), (k % 2).alias("scope"), k.cast("string").alias("key"), address.alias("address"), F.when(k % 331 == 0, "zz").otherwise(F.sha2(F.col("p_name").cast("binary"), 256)).alias("digest"))
    return V.sound_fingerprints(rows).groupBy("document").agg(F.count("*").alias("n"))


SITES = """sites AS (SELECT concat(kind, '@', source, '|', target) AS edge, file, line, CASE WHEN line % 5 <> 0 THEN col END AS col, CASE WHEN line % 3 = 0 THEN line + 1 END AS end_line, CASE WHEN line % 4 <> 0 THEN col + 2 END AS end_col, kind, source FROM occurrences),
pairs AS (SELECT DISTINCT a.edge AS candidate, b.edge AS boundary FROM sites a JOIN sites b ON a.source = b.source AND a.kind = 'calls' AND b.kind = 'instantiates' AND a.line % 20 = b.line % 20)"""


@query("occurrences", f"""WITH {SITES} SELECT candidate, boundary FROM pairs p WHERE EXISTS (SELECT 1 FROM sites a JOIN sites b ON a.file = b.file WHERE a.edge = p.candidate AND b.edge = p.boundary
AND (a.line > coalesce(b.end_line, b.line) OR a.line = coalesce(b.end_line, b.line) AND b.end_col IS NOT NULL AND a.col IS NOT NULL AND a.col >= b.end_col))""")
def occurs_after(occurrences):
    """Calls against constructions of the same supplier."""
    line = F.col("line")
    sites = stored(occurrences.filter("kind IN ('calls', 'instantiates')").select(F.concat("kind", F.lit("@"), "source", F.lit("|"), "target").alias("edge"), "file", "line", F.when(line % 5 != 0, F.col("col")).alias("col"),
                                   F.when(line % 3 == 0, line + 1).alias("end_line"), F.when(line % 4 != 0, F.col("col") + 2).alias("end_col"), "kind", "source"))
    side = lambda kind, name: sites.filter(F.col("kind") == kind).select(F.concat_ws("@", "source", line % 20).alias("group"), F.col("edge").alias(name))
    return R.occurs_after_in_groups(side("calls", "candidate"), side("instantiates", "boundary"), sites)


@query("orders", """WITH e AS (SELECT concat('f', o_orderkey) AS flow, concat('p', o_custkey % 400) AS promise, o_orderkey % 4 = 0 AS returns FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT concat('f', o_orderkey), 'p0', false FROM orders WHERE o_orderkey % 11 = 0),
one AS (SELECT flow, min(promise) AS promise, bool_or(returns) AS returns FROM e WHERE NOT (promise = 'p7') GROUP BY flow HAVING count(DISTINCT promise) = 1),
f AS (SELECT concat('f', o_orderkey) AS flow, o_orderkey AS place FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY promise ORDER BY NOT returns, place) AS k, count(*) OVER (PARTITION BY promise) AS n FROM one JOIN f USING (flow))
SELECT f.flow, coalesce(l.flow, f.flow) AS lead, CASE WHEN r.n > 1 THEN r.promise END AS promise FROM f LEFT JOIN r USING (flow) LEFT JOIN r l ON l.promise = r.promise AND l.k = 1 AND r.n > 1""")
def promise_groups(orders):
    """Orders as flows that share the promises of customers; one of these is no promise."""
    k = F.col("o_orderkey")
    flow = F.concat(F.lit("f"), k.cast("string"))
    own = orders.filter(k % 5 != 0).select(F.when(k % 4 == 0, "returnsPromise").otherwise("resolvesPromise").alias("kind"), flow.alias("source"), F.concat(F.lit("p"), (F.col("o_custkey") % 400).cast("string")).alias("target"))
    edges = own.unionByName(orders.filter(k % 11 == 0).select(F.lit("rejectsPromise").alias("kind"), flow.alias("source"), F.lit("p0").alias("target"))).withColumn("resolution", F.lit("resolved"))
    promises = edges.select(F.col("target").alias("id")).distinct().filter("id <> 'p7'")
    return R.promise_groups(orders.select(flow.alias("flow"), k.alias("place")), edges, promises)


@query("flow_steps", """WITH changed AS (SELECT DISTINCT target AS id FROM flow_steps WHERE target LIKE '%3'), c AS (SELECT flow::VARCHAR AS flow, target, min(path) AS path FROM flow_steps WHERE kind = 'call' GROUP BY flow, target),
own AS (SELECT DISTINCT flow::VARCHAR AS flow FROM flow_steps WHERE flow % 10 = 0), e AS (SELECT flow, target, path, 'modified' AS status FROM c WHERE target IN (SELECT id FROM changed) UNION ALL SELECT flow, flow, '', 'added' FROM own)
SELECT flow, target, status, row_number() OVER (PARTITION BY flow ORDER BY path, target)::INTEGER AS place FROM e""")
def flow_changes(flow_steps):
    """Changed parts that flows call, and every tenth flow itself."""
    steps = flow_steps.withColumn("flow", F.col("flow").cast("string")).withColumn("resolution", F.lit("resolved"))
    changed = steps.filter("target LIKE '%3'").select(F.col("target").alias("id")).distinct().withColumn("status", F.lit("modified"))
    return R.flow_changes(steps, changed.unionByName(steps.filter("flow % 10 = 0").select(F.col("flow").alias("id")).distinct().withColumn("status", F.lit("added"))))


@query("part")
def class_orders(part):
    """The C3 orders of sizes as classes: each extends the halves and thirds of its number."""
    ids = part.select("p_size").distinct().unionByName(part.sparkSession.range(1, 51).select(F.col("id").cast("int").alias("p_size"))).distinct()
    name = lambda c: F.concat(F.lit("K"), c.cast("string"))
    bases = ids.filter("p_size > 1").select(name(F.col("p_size")).alias("id"), F.posexplode(F.array_distinct(F.array(F.floor(F.col("p_size") / 2), F.greatest(F.lit(1), F.floor(F.col("p_size") / 3))))).alias("ord", "b"))
    classes = ids.select(name(F.col("p_size")).alias("id"), (F.col("p_size") != 13).alias("complete"))
    return R.linearisations(classes, bases.select("id", name(F.col("b")).alias("base"), "ord")).withColumn("mro", F.array_join("mro", " "))


@query("units unit_edges", """WITH p AS (SELECT DISTINCT a.package AS s, b.package AS t FROM unit_edges e JOIN units a ON a.id = e.source JOIN units b ON b.id = e.target WHERE a.package <> b.package)
SELECT 'tp:r1' AS "group" UNION SELECT t FROM p WHERE s = 'tp:r1' UNION SELECT s FROM p WHERE t = 'tp:r1'""")
def coupled_groups(units, unit_edges):
    owning = units.sparkSession.createDataFrame([("tp:r1",)], "`group` string")
    return G.neighbourhood(owning, unit_edges, units.select("id", F.col("package").alias("group")))


@query("unit_edges units", f"""WITH {PAIRS}, r AS (SELECT weight / 1000 AS weight, row_number() OVER (ORDER BY weight) - 1 AS k, count(*) OVER () AS n FROM aff)
SELECT (SELECT floor(least(0.05, greatest(0.001, weight * 0.12::DOUBLE * 1.5::DOUBLE)) * 1000000 + 0.5::DOUBLE) / 1000000 FROM r WHERE k = n // 2) AS potts,
floor(least(2.4, greatest(1.2, 1.2::DOUBLE + 0.25::DOUBLE * log2(greatest(1.0, (SELECT count(*) FROM units) / 12.0::DOUBLE)) + 0.08::DOUBLE * log2(greatest(1.0, 2.0::DOUBLE * (SELECT count(*) FROM aff) / (SELECT count(*) FROM units) / 4)))) * 1000000 + 0.5::DOUBLE) / 1000000 AS domain""")
def resolutions(unit_edges, units):
    pairs = S.pair_affinities(unit_edges)
    six = lambda c, name: (F.floor(F.col(c) * 1000000 + F.lit(0.5)) / 1000000).alias(name)
    potts = G.potts_resolution(pairs.withColumn("weight", F.col("weight") / 1000), size=8).select(six("resolution", "potts"))
    return potts.join(G.domain_resolution(units, pairs).select(six("resolution", "domain")))  # one row each


@query("units", "SELECT count_if(package <> 'tp:r4') >= 12 OR bool_or(package = 'tp:r4') AS grouped FROM units")
def grouped_domains(units):
    return G.grouped_domains(units.select((F.col("package") != "tp:r4").alias("assigned")))


SIGNED = "signed AS (SELECT p_partkey AS k, concat(p_name, ' (a', p_size, ': ', p_type, ', b?: number = ', p_size, '.5, c: \"', p_brand, '\") ') AS signature, p_name AS name FROM part)"


@query("part", rf"""WITH {SIGNED}, a AS (SELECT k, replace(trim(signature), concat(name, ' ('), 'method(') AS s FROM signed), b AS (SELECT k, regexp_replace(s, '\b[$A-Z_a-z][$\w]*\s*(\??\s*:)', 'arg\1', 'g') AS s FROM a),
c AS (SELECT k, regexp_replace(regexp_replace(s, '"[^"]*"', 'text', 'g'), '\b\d+(?:\.\d+)?\b', 'number', 'g') AS s FROM b) SELECT k, substr(lower(regexp_replace(s, '\s+', '', 'g')), 1, 180) AS shape, 3 AS arity FROM c""")
def signature_shapes(part):
    signature = F.concat("p_name", F.lit(" (a"), F.col("p_size").cast("string"), F.lit(": "), "p_type", F.lit(", b?: number = "), F.col("p_size").cast("string"), F.lit('.5, c: "'), "p_brand", F.lit('") '))
    return part.select(F.col("p_partkey").alias("k"), scalars.signature_shape(signature, F.col("p_name")).alias("shape"), scalars.arity(signature).alias("arity"))


@query("units members unit_edges", """WITH f AS (SELECT package AS id, concat('unit:', kind) AS term, 0.25::DOUBLE AS w FROM units WHERE id IN (SELECT unit FROM members)
UNION ALL SELECT package, 'member:method', 0.25 FROM members m JOIN units u ON u.id = m.unit UNION ALL SELECT package, 'tag:abstract', 0.5 FROM members m JOIN units u ON u.id = m.unit WHERE is_abstract
UNION ALL SELECT DISTINCT ON (e.kind, e.source, e.target) a.package, concat('out:', e.kind), 1 FROM unit_edges e JOIN units a ON a.id = e.source JOIN units b ON b.id = e.target WHERE a.package <> b.package
UNION ALL SELECT DISTINCT ON (e.kind, e.source, e.target) b.package, concat('in:', e.kind), 1 FROM unit_edges e JOIN units a ON a.id = e.source JOIN units b ON b.id = e.target WHERE a.package <> b.package)
SELECT id, term, sum(w) AS weight FROM f GROUP BY ALL""")
def structure_features(units, members, unit_edges):
    """Structural features of regions; those that names, signatures and buckets give are left out here."""
    sizes = members.groupBy(F.col("unit").alias("id")).agg(F.count("*").alias("members"))
    told = units.join(sizes, "id", "left").select("id", F.lit("x").alias("name"), "kind", F.coalesce("members", F.lit(0)).alias("members"), F.lit(1.0).alias("cohesion"), F.lit(0.0).alias("abstractness"))
    own = members.select("unit", F.lit("method").alias("kind"), F.lit("x").alias("name"), F.when(F.col("is_abstract"), F.array(F.lit("Abstract"))).alias("tags"), F.lit(None).cast("string").alias("signature"))
    vectors = G.feature_vectors(told, own, unit_edges, units.select("id", F.col("package").alias("group")))
    return vectors.filter(F.col("term").rlike("^(unit|member|tag|out|in):"))


@query("pages", rf"""WITH t AS (SELECT page_id, list_transform(regexp_extract_all(html, '''(?:\\[\s\S]|[^''\\])*''|"(?:\\[\s\S]|[^"\\])*"|`(?:\\[\s\S]|[^`\\])*`|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|[^''"`/]+|[\s\S]'),
  lambda p: CASE WHEN starts_with(p, '//') OR starts_with(p, '/*') THEN regexp_replace(p, '[^\n]+', chr(1), 'g') ELSE p END) AS parts FROM pages),
l AS (SELECT page_id, unnest(string_split(array_to_string(parts, ''), chr(10))) AS line FROM t)
SELECT page_id, count(*)::BIGINT AS lines, count_if(contains(line, chr(1)))::BIGINT AS commented, count_if(contains(line, chr(1)) AND trim(replace(line, chr(1), '')) = '')::BIGINT AS comment_only, sum(length(replace(line, chr(1), '')))::BIGINT AS code_chars FROM l GROUP BY page_id""")
def comment_lines(pages):
    """Pages read as scripts: their lines, those with comments, those with nothing else."""
    lines = pages.select("page_id", F.explode(scalars.comment_lines(F.col("html"))).alias("x")).select("page_id", "x.*")
    only = F.col("comment") & (F.btrim("code") == "")
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.count_if("comment").alias("commented"), F.count_if(only).alias("comment_only"), F.sum(F.length("code")).alias("code_chars"))


@query("intervals nodes", """WITH ev AS (SELECT concat('P', l_partkey) AS part, l_partkey, least(a, b) AS a, greatest(a, b) AS b, reversed, l_orderkey FROM intervals),
placed AS (SELECT CASE WHEN l_partkey % 3 = 0 THEN concat('brand', l_partkey % 7) WHEN l_partkey % 3 = 1 THEN 'rest' END AS spot, * FROM ev),
r AS (SELECT *, max(b) OVER (PARTITION BY spot ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM placed WHERE spot IS NOT NULL), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY spot ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r),
w AS (SELECT spot, sum(b - a) AS wall FROM (SELECT spot, island, min(a) AS a, max(b) AS b FROM g GROUP BY ALL) GROUP BY spot)
SELECT spot AS "at", count(*)::BIGINT AS spans, count_if(reversed)::BIGINT AS errors, min(l_orderkey) AS first, min(wall)::BIGINT AS wall FROM g JOIN w USING (spot) GROUP BY spot""", needs="intervals")
def rolled_evidence(intervals, nodes):
    """Shipping spans of parts at the visible brand of every third, and in one frame for another third."""
    k = F.col("l_partkey")
    rows = cut(intervals.select(k.alias("node"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("reversed").alias("is_error"), F.col("l_orderkey").alias("seq")))
    ids = rows.select(F.col("node").alias("id")).distinct()
    near = ids.filter("id % 3 = 0").select("id", F.concat(F.lit("brand"), (F.col("id") % 7).cast("string")).alias("near"))
    return telemetry.rolled_evidence(rows, near, ids.filter("id % 3 = 1").select("id", F.lit("rest").alias("frame")))


@query("nodes edges", f"""WITH RECURSIVE {ANC}, pk AS (SELECT a.id, a.anc_id AS package FROM anc a JOIN nodes p ON p.id = a.anc_id AND p.kind = 'package'), md AS (SELECT a.id, a.anc_id AS module FROM anc a JOIN nodes p ON p.id = a.anc_id AND p.kind = 'module'),
shown AS (SELECT id FROM nodes WHERE kind = 'package' AND (id LIKE 'tp:Brand1%' OR id = 'tp:r0')),
x AS (SELECT e.kind, s.package AS source, t.package AS target, s.package IN (SELECT id FROM shown) AS out, t.package IN (SELECT id FROM shown) AS into_, e.source AS a, e.target AS b FROM edges e JOIN pk s ON s.id = e.source JOIN pk t ON t.id = e.target)
SELECT source, target, kind, count(*)::BIGINT AS weight, count(DISTINCT m.module)::BIGINT AS members FROM x LEFT JOIN md m ON m.id = CASE WHEN out THEN b ELSE a END WHERE out <> into_ GROUP BY source, target, kind""")
def folder_ghosts(nodes, edges):
    """Wires from some brands and a region, which are drawn, to packages that aren't."""
    shown = nodes.filter("kind = 'package' AND (id LIKE 'tp:Brand1%' OR id = 'tp:r0')").select("id")
    return R.folder_ghosts(edges, nodes, cut(tree.ancestors(nodes)), shown)
