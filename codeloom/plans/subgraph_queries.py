"""Subgraphs around a selection, and what a slice of files needs beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.materialize import cut
from codeloom.operators import identity, subgraph, tree

from .registry import query

_CHOSEN = "kind = 'module' AND (id LIKE 'tp:r0/%' OR id LIKE 'tp:Brand1/S%') OR id = 'tp:Brand2' OR kind = 'class' AND id LIKE 'tp:r1/%1' OR kind = 'function' AND id LIKE 'tp:r2/%#S%'"
_WIRES = f"""
up AS (SELECT id, id AS anc_id, 0 AS depth FROM deep_nodes UNION ALL SELECT u.id, n.parent_id, u.depth + 1 FROM up u JOIN deep_nodes n ON n.id = u.anc_id WHERE n.parent_id IS NOT NULL),
mem AS (SELECT id, kind, name, length(id) % 2 = 0 AS origin FROM deep_nodes WHERE {_CHOSEN}),
near AS (SELECT id, min_by(anc_id, depth) AS box FROM up WHERE anc_id IN (SELECT id FROM mem) GROUP BY id),
own AS (SELECT u.id, min_by(anc_id, depth) AS pkg FROM up u JOIN deep_nodes n ON n.id = u.anc_id WHERE owns_files GROUP BY u.id),
frame AS (SELECT u.id, min_by(anc_id, depth) AS f FROM up u JOIN deep_nodes n ON n.id = u.anc_id WHERE n.kind = 'package' GROUP BY u.id),
met AS (SELECT e.*, a.box AS sb, b.box AS tb, p.pkg IS DISTINCT FROM q.pkg AS crosses FROM deep_edges e LEFT JOIN near a ON a.id = e.source LEFT JOIN near b ON b.id = e.target LEFT JOIN own p ON p.id = e.source LEFT JOIN own q ON q.id = e.target),
wires AS (
  SELECT CASE kind WHEN 'imports' THEN 'import' ELSE 'dep' END AS what, kind, sb AS source, tb AS target, sum(weight)::BIGINT AS weight, kind = 'imports' AND any_value(fs.f) IS DISTINCT FROM any_value(ft.f) AS cross_frame, bool_or(crosses) AS cross_package
  FROM met LEFT JOIN frame fs ON fs.id = sb LEFT JOIN frame ft ON ft.id = tb WHERE sb <> tb GROUP BY kind, sb, tb
  UNION ALL SELECT 'ghost', kind, coalesce(sb, source), coalesce(tb, target), sum(weight)::BIGINT, false, bool_or(crosses) FROM met WHERE kind <> 'imports' AND (sb IS NULL) <> (tb IS NULL) GROUP BY ALL)"""


def _chosen(nodes):
    return nodes.filter(_CHOSEN).select("id", (F.length("id") % 2 == 0).alias("origin"))


@query("deep_nodes deep_edges", f"WITH RECURSIVE {_WIRES} SELECT * FROM wires")
def minimal_wires(nodes, edges):
    """Wires of the subgraph around some files, a package, classes and functions, and those to ghosts beyond."""
    nodes = cut(nodes)
    return subgraph.minimal_edges(nodes, cut(edges), _chosen(nodes), cut(tree.ancestors(nodes)))


@query("deep_nodes deep_edges", f"""WITH RECURSIVE {_WIRES},
ghost AS (SELECT DISTINCT g.id FROM (SELECT source AS id FROM wires WHERE what = 'ghost' UNION SELECT target FROM wires WHERE what = 'ghost') g JOIN deep_nodes USING (id) WHERE g.id NOT IN (SELECT id FROM mem)),
files AS (SELECT * FROM mem WHERE kind = 'module'), kept AS (SELECT n.* FROM deep_nodes n WHERE id IN (SELECT anc_id FROM up WHERE id IN (SELECT id FROM files))),
thru AS (SELECT p.id FROM kept p JOIN kept c ON c.parent_id = p.id WHERE p.kind = 'package' GROUP BY p.id HAVING count(*) = 1 AND min(c.kind) = 'package'),
left_of AS (SELECT * FROM kept WHERE id NOT IN (SELECT id FROM thru)),
par AS (SELECT l.id, min_by(u.anc_id, u.depth) FILTER (WHERE u.anc_id NOT IN (SELECT id FROM thru)) AS parent_id, coalesce(min(u.depth) FILTER (WHERE u.anc_id NOT IN (SELECT id FROM thru)), 1000) AS at FROM left_of l JOIN up u ON u.id = l.id AND u.depth > 0 GROUP BY l.id),
lab AS (SELECT u.id, string_agg(n.name, '/' ORDER BY u.depth DESC) AS label FROM up u JOIN par p ON p.id = u.id AND u.depth < p.at JOIN deep_nodes n ON n.id = u.anc_id GROUP BY u.id),
tier AS (SELECT id, CASE WHEN origin THEN 'seed' ELSE 'persistent' END AS tier FROM mem)
SELECT l.id, CASE WHEN l.kind = 'module' THEN 'file' ELSE 'group' END AS role, p.parent_id, t.tier, coalesce(b.label, l.name) AS label, CASE WHEN l.kind <> 'module' THEN (SELECT count(*) FROM up u JOIN files f ON f.id = u.id WHERE u.anc_id = l.id)::BIGINT END AS n_files
FROM left_of l LEFT JOIN par p ON p.id = l.id LEFT JOIN lab b ON b.id = l.id LEFT JOIN tier t ON t.id = l.id WHERE l.id NOT IN (SELECT id FROM mem WHERE kind <> 'module') AND l.id NOT IN (SELECT id FROM ghost)
UNION ALL SELECT id, CASE WHEN kind = 'package' THEN 'group' WHEN kind = 'class' THEN 'unit' ELSE 'block' END, NULL, tier, name, CASE WHEN kind = 'package' THEN (SELECT count(*) FROM up u JOIN deep_nodes n ON n.id = u.id AND n.kind = 'module' WHERE u.anc_id = m.id)::BIGINT END FROM mem m JOIN tier USING (id) WHERE kind <> 'module'
UNION ALL SELECT id, 'ghost', NULL, NULL, name, NULL FROM ghost JOIN deep_nodes USING (id)""")
def minimal_cards(nodes, edges):
    """Cards, frames and ghosts of the same subgraph; chains of packages are one frame."""
    nodes = cut(nodes)
    return subgraph.minimal_subgraph(nodes, cut(edges), _chosen(nodes), cut(tree.ancestors(nodes)))[0]


_CLOSED = """
f AS (SELECT *, regexp_matches(path, '(^|/)__init__[.]py$') AS init FROM python_files),
pre AS (SELECT path, module, array_to_string(list_slice(string_split(module, '.'), 1, k), '.') AS prefix FROM f, range(1, 9) r(k) WHERE k < len(string_split(module, '.'))),
needs AS (SELECT DISTINCT module, prefix AS needs FROM pre WHERE prefix IN (SELECT module FROM f WHERE init)
  UNION SELECT f.module, w.witness FROM f JOIN (SELECT prefix, min_by(module, path) AS witness FROM pre GROUP BY prefix) w ON w.prefix = f.module WHERE NOT init AND f.module NOT IN (SELECT module FROM f WHERE init)),
asked AS (SELECT DISTINCT slice, path FROM python_slices), py AS (SELECT a.*, module, init FROM asked a LEFT JOIN f USING (path) WHERE a.path LIKE '%.py'),
flat AS (SELECT slice FROM py GROUP BY slice HAVING NOT bool_or(coalesce(init OR contains(module, '.'), false))),
hold AS (SELECT slice, module FROM py WHERE module IS NOT NULL UNION SELECT slice, (SELECT min_by(module, path) FROM f WHERE init OR contains(module, '.')) FROM flat UNION SELECT h.slice, n.needs FROM hold h JOIN needs n ON n.module = h.module),
files AS (SELECT slice, path FROM hold JOIN f USING (module) UNION SELECT slice, path FROM asked WHERE path NOT LIKE '%.py'),
refused AS (SELECT DISTINCT slice, 'unknown' AS reason FROM py WHERE module IS NULL UNION ALL SELECT slice, 'large' FROM files WHERE slice NOT IN (SELECT slice FROM py WHERE module IS NULL) GROUP BY slice HAVING count(*) > 30)"""


@query("python_files python_slices", f"WITH RECURSIVE {_CLOSED} SELECT * FROM files WHERE slice NOT IN (SELECT slice FROM refused)")
def identity_slices(files, slices):
    """Slices of files, with all that their module ids depend on."""
    return identity.closed_slices(files, slices, 30)[0]


@query("python_files python_slices", f"WITH RECURSIVE {_CLOSED} SELECT * FROM refused")
def identity_refused(files, slices):
    """Slices that hold more than 30 files when closed, or name unknown ones."""
    return identity.closed_slices(files, slices, 30)[1]
