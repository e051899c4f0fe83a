"""Containment and reachability (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import reach, slices, tree
from codeloom.operators.iterate import bfs, connectors
from codeloom.functions.materialize import cut

from .registry import query

ANC = """
anc AS (SELECT id, id AS anc_id, 0 AS depth FROM nodes
        UNION ALL SELECT a.id, n.parent_id, a.depth + 1 FROM anc a JOIN nodes n ON n.id = a.anc_id WHERE n.parent_id IS NOT NULL)"""
TESTS = """
closed AS (SELECT DISTINCT a.id FROM anc a JOIN nodes t ON t.id = a.anc_id AND t.is_test),
classes AS (SELECT parent_id AS id FROM nodes n WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING bool_and(EXISTS (SELECT 1 FROM closed c WHERE c.id = n.id))),
tests AS (SELECT id FROM closed UNION SELECT id FROM classes)"""
LEAVES = f"""WITH RECURSIVE {ANC}, {TESTS},
run AS (SELECT DISTINCT source, target FROM edges WHERE kind IN ('calls', 'instantiates', 'renders') AND coalesce(resolution, 'resolved') = 'resolved'),
steps AS (SELECT source, target FROM run WHERE target NOT IN (SELECT id FROM tests)),
hop AS (SELECT DISTINCT target AS id, 1 AS distance FROM steps WHERE source IN (SELECT id FROM tests)
        UNION SELECT s.target, h.distance + 1 FROM hop h JOIN steps s ON s.source = h.id WHERE h.distance < 12),
best AS (SELECT id, min(distance) AS distance FROM hop GROUP BY id),
firsts AS (SELECT target AS id, source, source IN (SELECT id FROM tests) AS by_test,
           row_number() OVER (PARTITION BY target, source IN (SELECT id FROM tests) ORDER BY source) AS rn FROM run),
callers AS (SELECT id, list(source ORDER BY source) FILTER (WHERE by_test) AS tests, list(source ORDER BY source) FILTER (WHERE NOT by_test) AS code FROM firsts WHERE rn <= 8 GROUP BY id),
leaves AS (
  SELECT n.id, CASE WHEN b.distance = 1 THEN 'covered' WHEN b.distance > 1 THEN 'indirect' ELSE 'uncovered' END AS status, coalesce(b.distance, -1)::INTEGER AS distance,
         CASE WHEN b.distance IS NULL THEN CASE WHEN c.code IS NULL THEN 'never-called' ELSE 'only-uncovered-callers' END END AS reason,
         coalesce(CASE WHEN b.distance = 1 THEN c.tests WHEN b.distance IS NULL THEN c.code END, []::VARCHAR[]) AS callers
  FROM nodes n LEFT JOIN best b USING (id) LEFT JOIN callers c USING (id)
  WHERE n.kind IN ('function', 'method') AND n.id NOT IN (SELECT id FROM tests))"""


@query("nodes", f"WITH RECURSIVE {ANC} SELECT id, anc_id, depth::INTEGER AS depth FROM anc")
def ancestors(nodes):
    return tree.ancestors(nodes)


@query("nodes", f"""WITH RECURSIVE {ANC}, {TESTS} SELECT id FROM tests""")
def tests_closure(nodes):
    return tree.closed_tests(nodes, nodes.filter("is_test").select("id"))


def _kept(nodes):
    """Nodes and their ancestors, made once for all that a query asks of them."""
    nodes = cut(nodes)
    return nodes, cut(tree.ancestors(nodes))


@query("nodes edges", LEAVES + " SELECT id, status, distance, reason, array_to_string(callers, ' ') AS callers FROM leaves")
def coverage_leaf(nodes, edges):
    nodes, closure = _kept(nodes)
    return reach.leaf_coverage(nodes, edges, closure).withColumn("callers", F.array_join("callers", " "))


@query("nodes edges", LEAVES + """
, rolled AS (SELECT a.anc_id AS id, count_if(status <> 'uncovered')::BIGINT AS covered, count(*)::BIGINT AS total
             FROM leaves l JOIN anc a ON a.id = l.id AND a.depth > 0 GROUP BY a.anc_id),
holders AS (SELECT id, coalesce(covered, 0) AS covered, coalesce(total, 0) AS total FROM nodes n LEFT JOIN rolled USING (id)
            WHERE id IN (SELECT parent_id FROM nodes) AND id NOT IN (SELECT id FROM tests))
SELECT id, covered, total, CASE WHEN total = 0 THEN 0 ELSE floor(covered * 100.0::DOUBLE / total + 0.5::DOUBLE)::BIGINT END AS percent,
       CASE WHEN total = 0 THEN 'no-callables' WHEN covered = 0 THEN 'uncovered' WHEN covered = total THEN 'covered' ELSE 'partial' END AS status FROM holders""")
def coverage_container(nodes, edges):
    nodes, closure = _kept(nodes)
    return reach.container_coverage(nodes, reach.leaf_coverage(nodes, edges, closure), closure)


@query("nodes edges", LEAVES + """
SELECT count(*)::BIGINT AS callables, count_if(status = 'covered')::BIGINT AS covered, count_if(status = 'indirect')::BIGINT AS indirect,
       count_if(status = 'uncovered')::BIGINT AS uncovered, floor(count_if(status <> 'uncovered') * 100.0::DOUBLE / count(*) + 0.5::DOUBLE)::BIGINT AS percent,
       (SELECT count(*) FROM tests)::BIGINT AS test_nodes, (SELECT count(*) FROM edges WHERE resolution = 'unresolved' AND source IN (SELECT id FROM tests))::BIGINT AS unresolved_from_tests FROM leaves""")
def coverage_summary(nodes, edges):
    nodes, closure = _kept(nodes)
    return reach.coverage_summary(nodes, edges, reach.leaf_coverage(nodes, edges, closure), closure)


@query("nodes edges", LEAVES + """
SELECT n.parent_id AS id, count(*)::BIGINT AS total, count_if(status = 'uncovered')::BIGINT AS missing,
       floor(count_if(status <> 'uncovered') * 100.0::DOUBLE / count(*) + 0.5::DOUBLE)::BIGINT AS percent,
       coalesce(string_agg(concat(l.id, ':', reason), ' ' ORDER BY l.id) FILTER (WHERE status = 'uncovered'), '') AS uncovered
FROM leaves l JOIN nodes n USING (id) GROUP BY n.parent_id""")
def coverage_rows(nodes, edges):
    """Callables by direct parent, the worst first when shown."""
    rows = reach.coverage_rows(nodes, reach.leaf_coverage(nodes, edges))
    told = F.array_join(F.transform("uncovered", lambda x: F.concat(x["id"], F.lit(":"), x["reason"])), " ")
    return rows.withColumn("uncovered", told).orderBy("percent", F.desc("total"))


@query("nodes edges", f"""WITH RECURSIVE {ANC}
SELECT a.anc_id AS id, count(*)::BIGINT AS n FROM anc a WHERE depth > 0 AND a.id IN (SELECT target FROM edges) GROUP BY a.anc_id""")
def changed_descendants(nodes, edges):
    return tree.descendant_counts(tree.ancestors(nodes), edges.select(F.col("target").alias("id")))


@query("nodes", f"""WITH RECURSIVE {ANC}
SELECT a.anc_id AS id, count(*)::BIGINT AS n FROM anc a JOIN nodes n ON n.id = a.id AND n.kind = 'module' JOIN nodes p ON p.id = a.anc_id AND p.kind = 'package'
WHERE depth > 0 GROUP BY a.anc_id""")
def subtree_counts(nodes):
    """Modules below each package."""
    counts = tree.descendant_counts(tree.ancestors(nodes), nodes.filter("kind = 'module'"))
    return counts.join(nodes.filter("kind = 'package'").select("id"), "id")


@query("nodes", f"""WITH RECURSIVE {ANC},
want AS (SELECT id FROM nodes WHERE kind = 'class' AND id LIKE 'tp:r0/%'),
met AS (SELECT anc_id, count(*) AS n, sum(depth)::BIGINT AS depth_sum FROM anc WHERE id IN (SELECT id FROM want) GROUP BY anc_id)
SELECT anc_id AS id, depth_sum FROM met WHERE n = (SELECT count(*) FROM want) ORDER BY depth_sum, anc_id LIMIT 1""")
def common_ancestor(nodes):
    """The nearest node above all classes of one region."""
    return tree.common_ancestor(tree.ancestors(nodes), nodes.filter("kind = 'class' AND id LIKE 'tp:r0/%'"))


FILES = """
files AS (SELECT DISTINCT regexp_replace(source, '#.*$', '') AS source, regexp_replace(target, '#.*$', '') AS target FROM edges),
both_ways AS (SELECT source, target FROM files WHERE source <> target UNION SELECT target, source FROM files WHERE source <> target),
walk AS (SELECT 'tp:Brand1/STANDARD' AS id, 0 AS distance UNION SELECT b.target, w.distance + 1 FROM walk w JOIN both_ways b ON b.source = w.id WHERE w.distance < 2),
slice AS (SELECT id, min(distance)::INTEGER AS distance FROM walk GROUP BY id)"""


def _slice(edges, depth=2):
    module = lambda c: F.regexp_replace(c, "#.*$", "")
    files = edges.select(module("source").alias("source"), module("target").alias("target")).filter("source <> target")
    both = cut(files.unionByName(files.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct())
    seeds = edges.sparkSession.createDataFrame([("tp:Brand1/STANDARD",)], "id string")
    return bfs(seeds, both, max_depth=depth), both


@query("edges", f"WITH RECURSIVE {FILES} SELECT id, distance FROM slice")
def slice_bfs(edges):
    """Files within two steps of a root over the undirected file graph."""
    return _slice(edges)[0]


@query("edges", f"""WITH RECURSIVE {FILES}
SELECT s.id, s.distance, count(b.target)::BIGINT AS beyond FROM slice s JOIN both_ways b ON b.source = s.id
WHERE b.target NOT IN (SELECT id FROM slice) GROUP BY s.id, s.distance""")
def slice_frontier(edges):
    """Files of the slice from which something is still to be loaded, and how many files that is."""
    reached, both = _slice(edges)
    out = both.join(reached.select(F.col("id").alias("target")), "target", "left_anti")
    return reached.join(out, F.col("id") == F.col("source")).groupBy("id", "distance").agg(F.count("target").alias("beyond"))


@query("nodes edges", """WITH RECURSIVE seed AS (SELECT min(id) AS id FROM nodes WHERE kind = 'function' AND id LIKE '%#S%' AND id IN (SELECT target FROM edges)),
up AS (SELECT id, 0 AS distance FROM seed UNION SELECT e.source, u.distance + 1 FROM up u JOIN edges e ON e.target = u.id WHERE u.distance < 3)
SELECT id, min(distance)::INTEGER AS distance FROM up GROUP BY id""")
def transitive_callers(nodes, edges):
    """Callers of one supplier up to three calls away."""
    called = nodes.filter("kind = 'function' AND id LIKE '%#S%'").join(edges.select(F.col("target").alias("id")), "id", "left_semi")
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return bfs(called.agg(F.min("id").alias("id")), back, max_depth=3)


@query("nodes edges", """WITH picked AS (SELECT id FROM nodes WHERE kind = 'function' AND parent_id = 'tp:Brand1/STANDARD')
SELECT id FROM picked UNION SELECT target FROM edges WHERE source IN (SELECT id FROM picked) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM picked)""")
def one_hop(nodes, edges):
    """A selection and its neighbours in both directions."""
    picked = nodes.filter("kind = 'function' AND parent_id = 'tp:Brand1/STANDARD'").select("id")
    out = edges.join(picked, edges["source"] == picked["id"], "left_semi").select(F.col("target").alias("id"))
    back = edges.join(picked, edges["target"] == picked["id"], "left_semi").select(F.col("source").alias("id"))
    return picked.unionByName(out).unionByName(back).distinct()


@query("nodes edges", f"""WITH RECURSIVE {ANC},
inside AS (SELECT id FROM anc WHERE anc_id = 'tp:Brand1'),
seen AS (SELECT id FROM inside UNION SELECT target FROM edges WHERE source IN (SELECT id FROM inside) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM inside))
SELECT n.id, n.kind FROM nodes n JOIN seen USING (id) WHERE kind IN ('function', 'method')""")
def rooted_view(nodes, edges):
    """Callables below a root, and those that call them or are called by them."""
    inside = cut(tree.ancestors(nodes).filter("anc_id = 'tp:Brand1'").select("id"))
    out = edges.join(inside, edges["source"] == inside["id"], "left_semi").select(F.col("target").alias("id"))
    back = edges.join(inside, edges["target"] == inside["id"], "left_semi").select(F.col("source").alias("id"))
    seen = inside.unionByName(out).unionByName(back).distinct()
    return nodes.filter("kind IN ('function', 'method')").join(seen, "id", "left_semi").select("id", "kind")


@query("nodes", f"""WITH RECURSIVE {ANC}, own AS (SELECT id FROM nodes WHERE kind = 'package' AND (id LIKE 'tp:Brand1%' OR id = 'tp:r2')), files AS (SELECT id FROM nodes WHERE kind = 'module'),
near AS (SELECT id, min_by(anc_id, depth) AS near FROM anc WHERE anc_id IN (SELECT id FROM own) AND id IN (SELECT id FROM files) GROUP BY id),
top AS (SELECT a.id, max_by(a.anc_id, a.depth) AS top FROM anc a JOIN nodes p ON p.id = a.anc_id AND p.kind = 'package' WHERE depth > 0 AND a.anc_id NOT IN (SELECT anc_id FROM anc WHERE depth > 0 AND id IN (SELECT near FROM near)) GROUP BY a.id)
SELECT f.id AS file, coalesce(near, top, f.id) AS root FROM files f LEFT JOIN near USING (id) LEFT JOIN top USING (id)""")
def overview_roots(nodes):
    """Modules under the packages that own them, of which some brands and one region are such."""
    return tree.overview_roots(nodes, nodes.filter("kind = 'module'").select("id"), nodes.filter("kind = 'package' AND (id LIKE 'tp:Brand1%' OR id = 'tp:r2')").select("id"))


@query("edges", f"""WITH RECURSIVE {FILES.split("walk AS")[0].rstrip().rstrip(",")},
pairs AS (SELECT source, target, count(*)::BIGINT AS k FROM (SELECT source, target FROM files WHERE source <> target UNION ALL SELECT target, source FROM files WHERE source <> target) x GROUP BY ALL),
known AS (SELECT DISTINCT s.id FROM (SELECT unnest(['tp:Brand1/STANDARD', 'tp:r0/n0', 'tp:Brand3/PROMO', 'tp:r1/n1', 'tp:Brand2/SMALL']) AS id) s JOIN pairs b ON b.source = s.id),
walk AS (SELECT id AS seed, id, 0 AS d FROM known UNION SELECT w.seed, b.target, w.d + 1 FROM walk w JOIN pairs b ON b.source = w.id WHERE w.d < 6),
dist AS (SELECT seed, id, min(d) AS d FROM walk GROUP BY ALL),
best AS (SELECT id AS seed, id, 0 AS d, 0::BIGINT AS k, [id] AS way FROM known
  UNION ALL SELECT seed, id, d, k, way FROM (
    SELECT b.seed, p.target AS id, x.d, b.k + p.k AS k, list_append(b.way, p.target) AS way, row_number() OVER (PARTITION BY b.seed, p.target ORDER BY b.k + p.k DESC, list_append(b.way, p.target)) AS rn
    FROM best b JOIN pairs p ON p.source = b.id JOIN dist x ON x.seed = b.seed AND x.id = p.target AND x.d = b.d + 1) y WHERE rn = 1)
SELECT DISTINCT id FROM (SELECT unnest(way) AS id FROM best WHERE id IN (SELECT id FROM known) AND seed < id) z WHERE id NOT IN (SELECT id FROM known)""")
def selection_connectors(edges):
    """Files on the ways between five files."""
    module = lambda c: F.regexp_replace(c, "#.*$", "")
    files = cut(edges.select(module("source").alias("source"), module("target").alias("target")).filter("source <> target").distinct())
    seeds = edges.sparkSession.createDataFrame([("tp:Brand1/STANDARD",), ("tp:r0/n0",), ("tp:Brand3/PROMO",), ("tp:r1/n1",), ("tp:Brand2/SMALL",)], "id string")
    ends = files.select(F.col("source").alias("id")).unionByName(files.select(F.col("target").alias("id")))
    return connectors(seeds.join(ends.distinct(), "id", "left_semi"), files)


@query("nodes edges", f"""WITH RECURSIVE {FILES}, {ANC}, own AS (SELECT id FROM nodes WHERE regexp_replace(id, '#.*$', '') IN (SELECT id FROM slice)),
p AS (SELECT id, 'own' AS role FROM own UNION ALL SELECT DISTINCT anc_id, 'ancestor' FROM anc WHERE id IN (SELECT id FROM own) AND anc_id NOT IN (SELECT id FROM own))
SELECT 'node' AS what, role AS kind, count(*)::BIGINT AS n FROM p GROUP BY role
UNION ALL SELECT 'edge', CASE WHEN source IN (SELECT id FROM own) AND target IN (SELECT id FROM own) THEN 'inside' WHEN source IN (SELECT id FROM own) THEN 'out' ELSE 'in' END, count(*)
FROM edges WHERE source IN (SELECT id FROM own) OR target IN (SELECT id FROM own) GROUP BY 2""")
def slice_projection(nodes, edges):
    """What the slice of slice_bfs holds, with ancestors and the edges in and at its rim."""
    reached = _slice(edges)[0].select(F.col("id").alias("file"))
    placed = cut(slices.projected_nodes(nodes.withColumn("file", F.regexp_replace("id", "#.*$", "")), reached))
    by = lambda df, what, kind: df.groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return by(placed, "node", "role").unionByName(by(slices.projected_edges(edges, placed), "edge", "where"))


@query("edges", f"""WITH RECURSIVE {FILES} SELECT count(*)::BIGINT AS files, max(distance) AS deepest, coalesce(min(distance) FILTER (WHERE id IN (SELECT source FROM both_ways WHERE target NOT IN (SELECT id FROM slice))), max(distance)) AS complete_through FROM slice""")
def slice_completeness(edges):
    reached, both = _slice(edges)
    return slices.completeness(reached.select(F.col("id").alias("file"), "distance"), both)
