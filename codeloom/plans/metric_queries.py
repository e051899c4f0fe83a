"""Validation (group C) and component metrics (group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import metrics as M
from codeloom.operators import tree
from codeloom.operators import validate as V

from .edge_queries import AGG, MODULES
from .reach_queries import ANC
from .registry import query

CE = f"""pairs AS (SELECT DISTINCT source, target FROM unit_edges WHERE source <> target),
cc AS (SELECT u.id, (SELECT count(*) FROM pairs WHERE source = u.id)::BIGINT AS ce, (SELECT count(*) FROM pairs WHERE target = u.id)::BIGINT AS ca FROM units u)"""


@query("units unit_edges", f"WITH {CE} SELECT * FROM cc")
def coupling(units, unit_edges):
    return M.couplings(units, unit_edges)


@query("unit_edges", """SELECT source, target, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, sum(weight)::BIGINT AS weight, bool_and(kind IN ('extends', 'implements')) AS inheritance_only
FROM unit_edges GROUP BY source, target""")
def coupling_pairs(unit_edges):
    return M.coupling_pairs(unit_edges)


LCOM = """inner_calls AS (SELECT c.source, c.target FROM member_calls c JOIN members a ON a.id = c.source JOIN members b ON b.id = c.target WHERE a.unit = b.unit),
two AS (SELECT source, target FROM inner_calls UNION SELECT target, source FROM inner_calls),
reach AS (SELECT id, id AS other FROM members UNION SELECT r.id, t.target FROM reach r JOIN two t ON t.source = r.other),
roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
lcom AS (SELECT unit, count(*)::BIGINT AS members, count(DISTINCT root)::BIGINT AS components FROM members JOIN roots USING (id) GROUP BY unit)"""


@query("members member_calls", f"WITH RECURSIVE {LCOM} SELECT * FROM lcom")
def lcom4(members, member_calls):
    return M.lcom4(members, member_calls)


METRICS = f"""WITH RECURSIVE {CE}, {LCOM},
shares AS (SELECT unit AS id, avg(is_abstract::INTEGER)::DOUBLE AS share FROM members GROUP BY unit),
ext AS (SELECT source AS id, count(DISTINCT target)::BIGINT AS external FROM outside GROUP BY source),
raw AS (SELECT id, ce, ca, coalesce(members, 0)::BIGINT AS members, coalesce(components, 0)::BIGINT AS components, coalesce(external, 0)::BIGINT AS external,
        CASE WHEN ce + ca > 0 THEN ce::DOUBLE / (ce + ca) ELSE 0.0::DOUBLE END AS i, CASE WHEN kind = 'interface' THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS a,
        CASE WHEN coalesce(members, 0) > 1 THEN 1.0::DOUBLE - (components - 1.0::DOUBLE) / (members - 1.0::DOUBLE) ELSE 1.0::DOUBLE END AS c
        FROM cc JOIN units USING (id) LEFT JOIN (SELECT unit AS id, members, components FROM lcom) l USING (id) LEFT JOIN shares USING (id) LEFT JOIN ext USING (id)),
d AS (SELECT *, abs(a + i - 1) AS d, concat_ws(',', CASE WHEN ca >= 5 AND ce >= 5 THEN 'god-module' END, CASE WHEN a <= 0.3 AND i <= 0.3 AND ca >= 3 THEN 'zone-of-pain' END,
      CASE WHEN a >= 0.7 AND i >= 0.7 THEN 'zone-of-uselessness' END, CASE WHEN members >= 4 AND c <= 0.34 THEN 'low-cohesion' END) AS smells FROM raw),
metrics AS (SELECT id, ce, ca, members, components, external, floor(i * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS instability, floor(a * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS abstractness,
            floor(d * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS distance, floor(c * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS cohesion, smells FROM d)"""
METRIC_VIEWS = "units unit_edges members member_calls outside"
SEVERITY = """(CASE WHEN contains(smells, 'god-module') THEN 4 ELSE 0 END + CASE WHEN contains(smells, 'low-cohesion') THEN 3 ELSE 0 END
+ CASE WHEN contains(smells, 'zone-of-pain') THEN 3 ELSE 0 END + CASE WHEN contains(smells, 'zone-of-uselessness') THEN 2 ELSE 0 END)"""


@query(METRIC_VIEWS, METRICS + " SELECT * FROM metrics")
def unit_metrics(*views):
    """Nations as units; the parts of the brand with a nation's number are its members."""
    return M.unit_metrics(*views)


@query(METRIC_VIEWS, METRICS + " SELECT id, unnest(string_split(smells, ',')) AS smell FROM metrics WHERE smells <> ''")
def smells(*views):
    return M.unit_metrics(*views).filter("smells <> ''").select("id", F.explode(F.split("smells", ",")).alias("smell"))


@query(METRIC_VIEWS, METRICS + f" SELECT id, {SEVERITY} AS severity, distance, members FROM metrics")
def refactor_rank(*views):
    return M.refactor_rank(M.unit_metrics(*views))


@query(METRIC_VIEWS, METRICS + f""", told AS (SELECT *, CASE WHEN contains(smells, 'god-module') THEN 'god-module' WHEN contains(smells, 'low-cohesion') THEN 'low-cohesion'
WHEN contains(smells, 'zone-of-pain') THEN 'zone-of-pain' WHEN contains(smells, 'zone-of-uselessness') THEN 'zone-of-uselessness' END AS worst FROM metrics)
SELECT id, CASE WHEN contains(smells, 'god-module') OR contains(smells, 'zone-of-pain') THEN 'bad' WHEN worst IS NOT NULL OR distance > {M.BALANCED} THEN 'warn' ELSE 'good' END AS tone, worst,
CASE WHEN worst IS NULL THEN concat('distance ', distance, ', cohesion ', cohesion, ' over ', members, ' members') ELSE concat_ws('; ',
  CASE WHEN contains(smells, 'god-module') THEN concat(ca, ' units use it and it uses ', ce) END,
  CASE WHEN contains(smells, 'low-cohesion') THEN concat(members, ' members in ', components, ' groups that don''t call each other') END,
  CASE WHEN contains(smells, 'zone-of-pain') THEN concat('concrete (', abstractness, '), stable (', instability, ') and used by ', ca, ' units') END,
  CASE WHEN contains(smells, 'zone-of-uselessness') THEN concat('abstract (', abstractness, ') and unstable (', instability, '), used by ', ca, ' units') END) END AS findings,
(contains(smells, 'god-module')::INTEGER + contains(smells, 'low-cohesion')::INTEGER + contains(smells, 'zone-of-pain')::INTEGER + contains(smells, 'zone-of-uselessness')::INTEGER) AS n_suggestions FROM told""")
def diagnosis(*views):
    told = M.diagnosis(M.unit_metrics(*views))
    return told.select("id", "tone", "worst", F.array_join("findings", "; ").alias("findings"), F.size("suggestions").alias("n_suggestions"))


@query("unit_edges", """WITH peers AS (SELECT count(*) AS n FROM (SELECT source FROM unit_edges UNION SELECT target FROM unit_edges)),
used AS (SELECT target AS id, count(DISTINCT source)::BIGINT AS dependents FROM unit_edges WHERE source <> target GROUP BY target)
SELECT id, dependents FROM used, peers WHERE dependents >= greatest(4, ceil(n * 0.3::DOUBLE))""")
def hub_demotion(unit_edges):
    return M.hubs(unit_edges)


MODULE_GRAPH = f"""WITH RECURSIVE {ANC}, {MODULES},
mg AS (SELECT s.near AS source, t.near AS target, count(*)::BIGINT AS weight FROM edges e JOIN mods s ON s.id = e.source JOIN mods t ON t.id = e.target WHERE s.near <> t.near GROUP BY ALL)"""


def _module_graph(nodes, edges):
    return M.module_graph(edges, tree.nearest(tree.ancestors(nodes), nodes.filter("kind IN ('module', 'package')")))


@query("nodes edges", MODULE_GRAPH + " SELECT * FROM mg")
def module_graph(nodes, edges):
    return _module_graph(nodes, edges)


@query("nodes edges", MODULE_GRAPH + " SELECT target AS id, sum(weight)::BIGINT AS imports FROM mg JOIN nodes n ON n.id = mg.target AND n.kind = 'module' GROUP BY target ORDER BY imports DESC, id LIMIT 1")
def root_module(nodes, edges):
    return M.root_module(nodes.filter("kind = 'module'").select("id"), _module_graph(nodes, edges))


@query("lineitem", """WITH c AS (SELECT concat(l_orderkey, '.', l_linenumber) AS id, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT 'DUPLICATE_NODE_ID' AS code, id AS subject FROM c, range(1, n) AS r(i)""")
def validate_duplicates(lineitem):
    """(order, line number) is no key: a row for each repetition."""
    return V.duplicate_ids(lineitem.select(F.concat("l_orderkey", F.lit("."), "l_linenumber").alias("id")))


BROKEN = """broken AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 0 THEN NULL WHEN p_partkey % 50 = 49 THEN p_partkey - 4 WHEN p_partkey % 50 = 45 THEN p_partkey + 4 WHEN p_partkey % 50 = 7 THEN -p_partkey
ELSE p_partkey - 1 END AS parent_id FROM part)"""


@query("part", f"""WITH RECURSIVE {BROKEN},
up AS (SELECT id, parent_id AS at, 1 AS depth FROM broken WHERE parent_id IN (SELECT id FROM broken)
       UNION ALL SELECT u.id, b.parent_id, u.depth + 1 FROM up u JOIN broken b ON b.id = u.at WHERE b.parent_id IN (SELECT id FROM broken) AND u.depth < 120)
SELECT 'DANGLING_PARENT' AS code, id AS subject FROM broken WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM broken)
UNION ALL SELECT DISTINCT 'PARENT_CYCLE', id FROM up WHERE depth = 120""")
def validate_parents(part):
    """Chains of fifty parts; one parent in fifty is missing and one chain runs into a cycle."""
    m, k = F.col("p_partkey") % 50, F.col("p_partkey")
    parent = F.when(m == 0, None).when(m == 49, k - 4).when(m == 45, k + 4).when(m == 7, -k).otherwise(k - 1)
    return V.parents(part.select(F.col("p_partkey").alias("id"), parent.alias("parent_id")), max_doublings=8)


RAW = """raw AS (SELECT CASE WHEN line % 41 = 0 THEN 'x' ELSE concat(kind, '@', source, '|', target) END AS id, kind, source, target, CASE WHEN col = 7 THEN 2 ELSE 1 END AS weight, 1 AS n_sites,
line, col, CASE WHEN line % 29 = 0 THEN line - 1 ELSE line END AS end_line, CASE WHEN line % 31 = 0 THEN col - 1 ELSE col + 2 END AS end_col FROM occurrences)"""


@query("occurrences", f"""WITH {RAW} SELECT 'EDGE_ID_MISMATCH' AS code, id AS subject FROM raw WHERE id <> concat(kind, '@', source, '|', target)
UNION ALL SELECT 'WEIGHT_MISMATCH', id FROM raw WHERE weight <> n_sites
UNION ALL SELECT 'CALL_SITE_RANGE', id FROM raw WHERE end_line < line OR end_line = line AND end_col < col""")
def validate_edges(occurrences):
    o = occurrences
    rows = o.select(
        F.when(F.col("line") % 41 == 0, "x").otherwise(F.concat("kind", F.lit("@"), "source", F.lit("|"), "target")).alias("id"), "kind", "source", "target",
        F.when(F.col("col") == 7, 2).otherwise(1).alias("weight"), F.lit(1).alias("n_sites"), "line", "col",
        F.when(F.col("line") % 29 == 0, F.col("line") - 1).otherwise(F.col("line")).alias("end_line"), F.when(F.col("line") % 31 == 0, F.col("col") - 1).otherwise(F.col("col") + 2).alias("end_col"),
    )
    return V.edge_rows(rows)


@query("occurrences nodes", """SELECT 'DANGLING_EDGE_SOURCE' AS code, source AS subject FROM occurrences WHERE source NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'DANGLING_EDGE_TARGET', target FROM occurrences WHERE resolution = 'resolved' AND target NOT IN (SELECT id FROM nodes)""")
def validate_endpoints(occurrences, nodes):
    return V.endpoints(occurrences, nodes)


@query("events", "SELECT event_type AS kind, count(*)::BIGINT AS n FROM events WHERE event_type NOT IN ('click', 'view', 'purchase') GROUP BY event_type")
def validate_vocab(events):
    return V.vocabulary(events.select(F.col("event_type").alias("kind")), ["click", "view", "purchase"])


@query("lineitem orders", """WITH s AS (SELECT o_custkey AS trace, concat(l_orderkey, '.', l_linenumber) AS span, o_orderdate AS start, l_shipdate AS finish FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'SPAN_TIME' AS code, span AS subject FROM s WHERE finish < start
UNION ALL SELECT DISTINCT 'DUPLICATE_SPAN', span FROM (SELECT trace, span FROM s GROUP BY ALL HAVING count(*) > 1)""")
def validate_traces(lineitem, orders):
    """Shipping spans of orders, by customer."""
    rows = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return V.traces(rows.select(F.col("o_custkey").alias("trace"), F.concat("l_orderkey", F.lit("."), "l_linenumber").alias("span"), F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("end")))
