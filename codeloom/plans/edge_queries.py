"""Ids and predicates (group A) and edge algebra (group B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import ids, paths, scalars
from codeloom.operators import edges as E
from codeloom.operators import tree

from .reach_queries import ANC
from .registry import query

ODD_IDS = """odd AS (
  SELECT id FROM nodes UNION ALL SELECT concat('py:pkg/m', c_custkey, '.py#', c_name, '~', c_custkey % 5) FROM customer
  UNION ALL SELECT concat('ts:src/a', s_suppkey, '~x#K::f$g.<locals>.h~', s_suppkey) FROM supplier)"""
PATHS = """paths AS (
  SELECT concat('src/', CASE p_partkey % 13 WHEN 0 THEN 'utils' WHEN 1 THEN 'Tests' WHEN 2 THEN 'latest' WHEN 3 THEN 'web-e2e-kit' WHEN 4 THEN 'components'
                WHEN 5 THEN 'config' WHEN 6 THEN '__mocks__' ELSE p_type END, '/', replace(p_name, ' ', '_'),
                CASE p_partkey % 7 WHEN 0 THEN '.test.ts' WHEN 1 THEN '_test.py' WHEN 2 THEN '.spec.tsx' WHEN 3 THEN '.py' ELSE '.ts' END) AS path, p_partkey FROM part
  UNION ALL SELECT concat('pkg/test_', s_suppkey, '.py'), -s_suppkey FROM supplier)"""


def _odd(nodes, customer, supplier):
    a = customer.select(F.concat(F.lit("py:pkg/m"), "c_custkey", F.lit(".py#"), "c_name", F.lit("~"), (F.col("c_custkey") % 5).cast("string")).alias("id"))
    b = supplier.select(F.concat(F.lit("ts:src/a"), "s_suppkey", F.lit("~x#K::f$g.<locals>.h~"), "s_suppkey").alias("id"))
    return nodes.select("id").unionAll(a).unionAll(b)


def _paths(part, supplier):
    k, m = F.col("p_partkey") % 13, F.col("p_partkey") % 7
    folder = F.element_at(F.array(*[F.lit(x) for x in ("utils", "Tests", "latest", "web-e2e-kit", "components", "config", "__mocks__")]), (F.least(k, F.lit(6)) + 1).cast("int"))
    ending = F.element_at(F.array(*[F.lit(x) for x in (".test.ts", "_test.py", ".spec.tsx", ".py", ".ts")]), (F.least(m, F.lit(4)) + 1).cast("int"))
    own = part.select(F.concat(F.lit("src/"), F.when(k <= 6, folder).otherwise(F.col("p_type")), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), ending).alias("path"), "p_partkey")
    return own.unionAll(supplier.select(F.concat(F.lit("pkg/test_"), "s_suppkey", F.lit(".py")), -F.col("s_suppkey")))


@query("nodes customer supplier", f"""WITH {ODD_IDS}, r AS (SELECT id, regexp_replace(id, '^[^:]*:', '') AS rest FROM odd),
b AS (SELECT *, regexp_replace(rest, '~([0-9]+)$', '') AS body, regexp_extract(rest, '~([0-9]+)$', 1) AS o FROM r)
SELECT id, split_part(id, ':', 1) AS lang, split_part(body, '#', 1) AS module_path, CASE WHEN contains(body, '#') THEN regexp_replace(body, '^[^#]*#', '') END AS qualname,
       CASE WHEN o <> '' THEN o::BIGINT END AS ordinal FROM b""")
def node_id_parse(nodes, customer, supplier):
    return _odd(nodes, customer, supplier).withColumns(ids.parse_node_id(F.col("id")))


@query("nodes customer supplier", f"""WITH {ODD_IDS} SELECT id, replace(regexp_replace(id, '::|#|\\$', '.', 'g'), '.<locals>', '') AS scope FROM odd""")
def scope_normalize(nodes, customer, supplier):
    return _odd(nodes, customer, supplier).withColumn("scope", ids.normal_scope(F.col("id")))


@query("part supplier", f"""WITH {PATHS}, s AS (SELECT *, string_split(path, '/') AS parts FROM paths)
SELECT path, p_partkey, regexp_matches(path, '(?i)\\.(test|spec)\\.[a-z0-9]+$') OR regexp_matches(path, '(^|/)test_[^/]+\\.py$') OR regexp_matches(path, '_test\\.(py|go)$')
       OR regexp_matches(path, '(^|/)conftest\\.py$')
       OR len(list_filter(parts[:-2], lambda x: lower(x) IN {paths.TEST_DIRECTORIES} OR regexp_matches(x, '(?i)(^|-)(e2e|tests?|testbench|testkit)(-|$)'))) > 0 AS is_test FROM s""")
def test_path(part, supplier):
    return _paths(part, supplier).withColumn("is_test", paths.is_test_path(F.col("path")))


@query("part supplier", f"""WITH {PATHS}, s AS (SELECT *, string_split(lower(path), '/') AS parts FROM paths)
SELECT path, p_partkey, CASE WHEN list_has_any(parts, {list(paths.UTIL)}) THEN 'util' WHEN list_has_any(parts, {list(paths.UI)}) THEN 'ui'
  WHEN list_has_any(parts, {list(paths.CONFIG)}) OR split_part(parts[-1], '.', 1) IN {paths.CONFIG} THEN 'config' ELSE 'app' END AS role FROM s""")
def path_category(part, supplier):
    return _paths(part, supplier).withColumn("role", paths.role_of_path(F.col("path")))


@query("part supplier", f"""WITH {PATHS} SELECT path, p_partkey, path = 'src/utils' OR starts_with(path, 'src/utils/') AS inside FROM paths""")
def review_path_scope(part, supplier):
    return _paths(part, supplier).withColumn("inside", paths.in_scope(F.col("path"), F.lit("./src//utils/")))


@query("nodes", f"""WITH RECURSIVE {ANC}
SELECT a.id, coalesce(min_by(a.anc_id, a.depth), 'root') AS scope FROM nodes n JOIN anc a ON a.id = n.id LEFT JOIN nodes p ON p.id = a.anc_id
WHERE p.kind = 'package' GROUP BY a.id""")
def package_scope(nodes):
    """The nearest package of every node."""
    return tree.package_scopes(nodes)


CALLS = """calls AS (SELECT DISTINCT concat(CASE page_id % 3 WHEN 0 THEN 'GET ' WHEN 1 THEN '' ELSE 'POST ' END, path) AS channel FROM page_paths)"""


def _calls(pages):
    k = F.col("page_id") % 3
    return pages.select(F.concat(F.when(k == 0, "GET ").when(k == 1, "").otherwise("POST "), "path").alias("channel")).distinct()


@query("page_paths", f"""WITH {CALLS} SELECT channel, CASE WHEN regexp_matches(channel, '^[A-Z]+ ') THEN split_part(channel, ' ', 1) ELSE 'GET' END AS method,
regexp_replace(channel, '^[A-Z]+ ', '') AS path FROM calls""")
def http_channel_split(pages):
    return _calls(pages).withColumns({"method": scalars.http_method(F.col("channel")), "path": scalars.http_path(F.col("channel"))})


TEMPLATES = ["/en/:id", "/fr/:id", "/:lang/:id", "/:lang/25", "POST /:lang/:id", "POST /en/*"]


@query("page_paths", f"""WITH {CALLS}, templates AS (SELECT unnest({TEMPLATES}) AS channel),
shaped AS (SELECT 'c' AS side, channel FROM calls UNION ALL SELECT 't', channel FROM templates),
s AS (SELECT DISTINCT side, channel, CASE WHEN regexp_matches(channel, '^[A-Z]+ ') THEN split_part(channel, ' ', 1) ELSE 'GET' END AS method,
      string_split(trim(regexp_replace(channel, '^[A-Z]+ ', ''), '/'), '/') AS parts FROM shaped),
met AS (SELECT c.channel AS call, t.channel AS template, len(list_filter(t.parts, lambda x: starts_with(x, ':') OR x = '*')) AS wildcards
        FROM s c JOIN s t ON c.side = 'c' AND t.side = 't' AND c.method = t.method AND len(c.parts) = len(t.parts)
        WHERE len(list_filter(list_zip(c.parts, t.parts), lambda z: z[1] <> z[2] AND NOT starts_with(z[2], ':') AND z[2] <> '*')) = 0),
best AS (SELECT *, rank() OVER (PARTITION BY call ORDER BY wildcards) AS r FROM met)
SELECT call, min(template) AS template FROM best WHERE r = 1 GROUP BY call HAVING count(*) = 1""")
def route_match(pages):
    templates = pages.sparkSession.createDataFrame([(t,) for t in TEMPLATES], "channel string")
    return E.match_routes(_calls(pages), templates)


@query("nodes", """SELECT id, kind FROM nodes WHERE kind IN ('package', 'module', 'namespace', 'class', 'object', 'interface', 'enum', 'typeAlias')""")
def depth_filter(nodes):
    """Nodes of rank 2 or less; unknown kinds rank lowest."""
    return tree.within_rank(nodes, 2).select("id", "kind")


@query("part", """WITH codes AS (SELECT p_name AS name, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT) AS c FROM part GROUP BY p_name)
SELECT name, printf('%08x', list_reduce(list_prepend(2166136261, c), lambda h, x: (xor(h, x) * 16777619) % 4294967296)) AS hash FROM codes""")
def fnv_fingerprint(part):
    return part.select(F.col("p_name").alias("name")).distinct().withColumn("hash", scalars.fnv1a(F.col("name")))


@query("part", """SELECT p_name AS name, concat('ipc:http/channel=', replace(replace(concat(p_name, ' ~(', p_brand, ')*!/é'), ' ', '%20'), '#', '%23').replace('/', '%2F').replace('é', '%C3%A9')) AS id FROM part""")
def percent_encode_channel(part):
    text = F.concat("p_name", F.lit(" ~("), "p_brand", F.lit(")*!/é"))
    return part.select(F.col("p_name").alias("name"), scalars.channel_id(F.lit("http"), text).alias("id"))


@query("part", """WITH t AS (SELECT p_type, p_partkey, regexp_replace(regexp_replace(concat(p_name, 'ServiceHTTPHandlers', p_type), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g') AS x FROM part),
w AS (SELECT p_partkey, unnest(regexp_extract_all(lower(x), '[a-z][a-z0-9]*')) AS token FROM t)
SELECT p_partkey, token, CASE WHEN length(token) > 4 AND token LIKE '%ies' THEN concat(left(token, -3), 'y') WHEN length(token) > 3 AND token LIKE '%s' AND token NOT LIKE '%ss' THEN left(token, -1) ELSE token END AS stem
FROM w WHERE length(token) > 1 AND token NOT IN ('service', 'object', 'type')""")
def name_tokens(part):
    found = scalars.name_tokens(F.concat("p_name", F.lit("ServiceHTTPHandlers"), "p_type"))
    return part.select("p_partkey", F.explode(found).alias("token")).withColumn("stem", scalars.stem(F.col("token")))


SITES = "string_agg(concat(file, ':', line, ':', col), ',' ORDER BY ord, file, line, col)"


def _sites_text(df):
    text = F.concat_ws(",", F.transform("call_sites", lambda s: F.concat(s["file"], F.lit(":"), s["line"].cast("string"), F.lit(":"), s["col"].cast("string"))))
    return df.withColumn("call_sites", F.md5(text.cast("binary")))


@query("occurrences", f"""SELECT concat(kind, '@', source, '|', target) AS id, kind, source, target, count(*)::BIGINT AS weight, md5({SITES}) AS call_sites,
CASE WHEN bool_or(resolution = 'resolved') THEN 'resolved' ELSE 'unresolved' END AS resolution, max(confidence) AS confidence FROM occurrences GROUP BY kind, source, target""")
def edge_aggregate(occurrences):
    return _sites_text(E.aggregate(occurrences))


@query("occurrences", f"""SELECT concat(kind, '@', source, '|', target) AS id, kind, source, target, count(*)::BIGINT AS weight, md5({SITES}) AS call_sites,
min_by(resolution, ord) AS resolution FROM occurrences WHERE NOT starts_with(target, 'ext:') AND NOT starts_with(target, 'unresolved:') GROUP BY kind, source, target""")
def edge_aggregate_first(occurrences):
    return _sites_text(E.aggregate_first(occurrences))


AGG = """agg AS (SELECT concat(kind, '@', source, '|', target) AS id, kind, source, target, count(*)::BIGINT AS weight,
CASE WHEN bool_or(resolution = 'resolved') THEN 'resolved' ELSE 'unresolved' END AS resolution FROM occurrences GROUP BY kind, source, target)"""
MODULES = "mods AS (SELECT a.id, min_by(a.anc_id, a.depth) AS near FROM anc a JOIN nodes n ON n.id = a.anc_id AND n.kind IN ('module', 'package') GROUP BY a.id)"


@query("nodes occurrences", f"""WITH RECURSIVE {ANC}, {AGG}, {MODULES},
moved AS (SELECT e.kind, s.near AS source, CASE WHEN n.id IS NULL THEN e.target ELSE t.near END AS target, e.weight, e.resolution, e.id
          FROM agg e JOIN mods s ON s.id = e.source LEFT JOIN mods t ON t.id = e.target LEFT JOIN nodes n ON n.id = e.target)
SELECT concat(kind, '@', source, '|', target) AS id, kind, source, target, sum(weight)::BIGINT AS weight, min_by(resolution, id) AS resolution
FROM moved WHERE target IS NOT NULL AND source <> target GROUP BY kind, source, target""")
def collapse_depth(nodes, occurrences):
    """Edges after all nodes below modules are folded into their modules."""
    near = tree.nearest(tree.ancestors(nodes), nodes.filter("kind IN ('module', 'package')").select("id"))
    return E.relink(E.aggregate(occurrences).drop("call_sites", "confidence"), near, nodes)


LIFTED = f"""WITH RECURSIVE {ANC}, {AGG}, {MODULES},
lifted AS (SELECT kind, s.near AS source, t.near AS target, sum(weight)::BIGINT AS weight, CASE WHEN bool_and(resolution = 'resolved') THEN 'resolved' ELSE 'unresolved' END AS resolution,
           count(*)::BIGINT AS underlying FROM agg e JOIN mods s ON s.id = e.source JOIN mods t ON t.id = e.target WHERE s.near <> t.near GROUP BY ALL)"""


def _lifted(nodes, occurrences):
    near = tree.nearest(tree.ancestors(nodes), nodes.filter("kind IN ('module', 'package')").select("id"))
    return E.lift(E.aggregate(occurrences), near)


@query("nodes occurrences", LIFTED + " SELECT * FROM lifted")
def lift_edges(nodes, occurrences):
    return _lifted(nodes, occurrences)


@query("nodes occurrences", f"""WITH RECURSIVE {ANC}, {AGG},
tops AS (SELECT id, anc_id AS near FROM anc WHERE depth = 1 UNION ALL SELECT id, id FROM nodes WHERE parent_id IS NULL)
SELECT kind, s.near AS source, t.near AS target, sum(weight)::BIGINT AS weight, CASE WHEN bool_and(resolution = 'resolved') THEN 'resolved' ELSE 'unresolved' END AS resolution, count(*)::BIGINT AS underlying
FROM agg e JOIN tops s ON s.id = e.source JOIN tops t ON t.id = e.target WHERE s.near <> t.near
AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.depth > 0 AND (a.id = s.near AND a.anc_id = t.near OR a.id = t.near AND a.anc_id = s.near)) GROUP BY ALL""")
def lift_dep_edges(nodes, occurrences):
    """Edges lifted by one level, without pairs of which one contains the other."""
    closure = tree.ancestors(nodes)
    near = closure.filter("depth = 1").select("id", F.col("anc_id").alias("near")).unionByName(nodes.filter("parent_id IS NULL").select("id", F.col("id").alias("near")))
    return E.without_containment(E.lift(E.aggregate(occurrences), near), closure)


@query("occurrences nodes", """WITH leaves AS (SELECT DISTINCT target AS id FROM occurrences WHERE (starts_with(target, 'ext:') OR starts_with(target, 'unresolved:')) AND target NOT IN (SELECT id FROM nodes))
SELECT id, CASE WHEN starts_with(id, 'ext:') THEN 'external' ELSE 'unresolved' END AS kind, 'ext:__external__' AS parent_id FROM leaves
UNION ALL SELECT 'ext:__external__', 'external', NULL FROM (SELECT count(*) AS n FROM leaves) WHERE n > 0""")
def boundary_nodes(occurrences, nodes):
    return E.boundary(occurrences, nodes)


PORTS = """ports AS (
  SELECT concat('C', c_custkey) AS owner, CASE WHEN c_custkey % 2 = 0 THEN 'out' ELSE 'in' END AS direction, 'http' AS protocol,
         CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat('/', c_mktsegment, '/', c_custkey % 37) END AS channel, concat('sys', c_nationkey % 3) AS system,
         CASE WHEN c_custkey % 5 = 0 THEN 0.5::DOUBLE END AS confidence FROM customer)"""


def _ports(customer):
    k = F.col("c_custkey")
    return customer.select(
        F.concat(F.lit("C"), k).alias("owner"), F.when(k % 2 == 0, "out").otherwise("in").alias("direction"), F.lit("http").alias("protocol"),
        F.when(k % 17 != 0, F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), (k % 37).cast("string"))).alias("channel"),
        F.concat(F.lit("sys"), (F.col("c_nationkey") % 3).cast("string")).alias("system"), F.when(k % 5 == 0, 0.5).alias("confidence"),
    )


CHANNEL = "concat('ipc:http/channel=', replace(channel, '/', '%2F'))"


@query("customer", f"""WITH {PORTS} SELECT {CHANNEL} AS id, min(coalesce(confidence, 1)) AS confidence, count(*)::BIGINT AS n_ports FROM ports WHERE channel IS NOT NULL GROUP BY channel""")
def channels(customer):
    return E.channel_nodes(_ports(customer))


@query("customer", f"""WITH {PORTS}, e AS (SELECT CASE direction WHEN 'out' THEN 'sends' ELSE 'handles' END AS kind, CASE direction WHEN 'out' THEN owner ELSE {CHANNEL} END AS source,
CASE direction WHEN 'out' THEN {CHANNEL} ELSE owner END AS target, coalesce(confidence, 1) AS confidence FROM ports WHERE channel IS NOT NULL)
SELECT kind, source, target, count(*)::BIGINT AS weight, CASE WHEN bool_or(confidence >= 1) THEN 'resolved' ELSE 'unresolved' END AS resolution, max(confidence) AS confidence FROM e GROUP BY kind, source, target""")
def channel_edges(customer):
    return E.channel_edges(_ports(customer))


@query("customer", f"""WITH {PORTS} SELECT DISTINCT o.owner AS source, i.owner AS target FROM ports o JOIN ports i USING (protocol, channel) WHERE o.direction = 'out' AND i.direction = 'in' AND o.owner <> i.owner""")
def ipc_pairs(customer):
    return E.sender_handler_pairs(_ports(customer))


@query("customer", f"""WITH {PORTS}, s AS (SELECT protocol, channel, count(DISTINCT system) FILTER (WHERE direction = 'out')::INTEGER AS n_out, count(DISTINCT system) FILTER (WHERE direction = 'in')::INTEGER AS n_in,
count(DISTINCT system) AS n FROM ports WHERE channel IS NOT NULL GROUP BY protocol, channel)
SELECT protocol, channel, n_out, n_in, n_out = 0 OR n_in = 0 AS dangling, n_out > 0 AND n_in > 0 AND n > 1 AS cross_system FROM s""")
def link_stats(customer):
    return E.channel_joins(_ports(customer))


@query("unit_edges", """SELECT kind, least(source, target) AS a, greatest(source, target) AS b, sum(weight)::BIGINT AS weight, count(DISTINCT source) > 1 AS fused FROM unit_edges GROUP BY ALL""")
def cycle_fuse(unit_edges):
    return E.fuse_cycles(unit_edges)


@query("nodes occurrences", LIFTED + """, wires AS (SELECT l.*, a.parent_id AS ps, b.parent_id AS pt FROM lifted l JOIN nodes a ON a.id = l.source JOIN nodes b ON b.id = l.target WHERE a.parent_id <> b.parent_id),
kinds AS (SELECT ps, pt, kind, count(*) AS n, sum(weight) AS w FROM wires GROUP BY ps, pt, kind)
SELECT ps, pt, sum(n)::BIGINT AS strands, sum(w)::BIGINT AS weight, arg_max(kind, (w, kind)) AS dominant FROM kinds GROUP BY ps, pt HAVING sum(n) >= 3""")
def bundle(nodes, occurrences):
    return E.bundle(_lifted(nodes, occurrences), nodes)


@query("unit_edges", """SELECT source, target, count(*)::BIGINT AS strands, sum(weight)::BIGINT AS weight, arg_max(kind, (weight, kind)) AS dominant FROM unit_edges GROUP BY source, target HAVING count(*) >= 2""")
def ribbon(unit_edges):
    return E.ribbons(unit_edges)


@query("unit_edges", """SELECT kind, source, target, weight, count(*) OVER (PARTITION BY source)::BIGINT AS fan_out, count(*) OVER (PARTITION BY target)::BIGINT AS fan_in,
count(*) OVER (PARTITION BY source) >= 6 OR count(*) OVER (PARTITION BY target) >= 6 AS spooled FROM unit_edges""")
def spool(unit_edges):
    return E.spools(unit_edges)


@query("unit_edges", """SELECT *, (SELECT count(*) FROM unit_edges) > 32 AND weight <= 1 AND kind IN ('references', 'imports') AS faded FROM unit_edges""")
def fade(unit_edges):
    return E.faint(unit_edges)


@query("nodes", """WITH c AS (SELECT parent_id, count(*) AS n, min(id) AS child, min(kind) AS k FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id)
SELECT id, child FROM nodes JOIN c ON c.parent_id = id WHERE kind = 'package' AND n = 1 AND k = 'package'
UNION ALL SELECT 'join', NULL""")
def chain_collapse(nodes):
    """Packages that are absorbed by their only child; the last row marks the end of the list."""
    end = nodes.sparkSession.createDataFrame([("join", None)], "id string, child string")
    return E.collapsible(nodes).unionByName(end)
