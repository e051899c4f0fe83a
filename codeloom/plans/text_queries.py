"""Labels and texts of nodes, paths, channels and values; trees in reading order."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.operators import search, tree

from .edge_queries import PATHS, _paths
from .reach_queries import ANC
from .registry import query


@query("nodes", """WITH RECURSIVE p AS (SELECT *, lpad(CAST(row_number() OVER (PARTITION BY parent_id ORDER BY display_name, id) AS VARCHAR), 8, '0') AS place FROM nodes),
t AS (SELECT id, 0 AS depth, id AS path FROM p WHERE parent_id IS NULL UNION ALL SELECT p.id, t.depth + 1, concat(t.path, '/', p.place) FROM t JOIN p ON p.parent_id = t.id)
SELECT id, depth::INTEGER AS depth, path FROM t""")
def tree_rows(nodes):
    """The containment tree in reading order."""
    return tree.preorder(nodes, [F.col("display_name"), F.col("id")])


@query("part supplier", f"""WITH {PATHS}, d AS (SELECT DISTINCT path, string_split(path, '/') AS parts FROM paths), e AS (SELECT array_to_string(parts[:k], '/') AS folder FROM d, unnest(range(1, len(parts))) AS r(k))
SELECT folder, count(*)::BIGINT AS files FROM e GROUP BY folder HAVING count(*) > 1""")
def path_suggestions(part, supplier):
    return search.path_suggestions(_paths(part, supplier))


@query("nodes", f"""WITH RECURSIVE {ANC}, chosen AS (SELECT id FROM nodes WHERE id = 'tp:Brand1' OR (kind = 'class' AND id LIKE 'tp:r0/%')),
f AS (SELECT id FROM anc WHERE anc_id IN (SELECT id FROM chosen) UNION SELECT anc_id FROM anc WHERE id IN (SELECT id FROM chosen)), m AS (SELECT f.id FROM f JOIN nodes n ON n.id = f.id AND n.kind = 'module')
SELECT id AS file, (SELECT count(*) FROM m)::BIGINT AS total FROM m ORDER BY id LIMIT 100""")
def files_in_scope(nodes):
    """Modules below one package and around the classes of a region."""
    chosen = nodes.filter("id = 'tp:Brand1' OR (kind = 'class' AND id LIKE 'tp:r0/%')").select("id")
    return search.files_in_scope(tree.ancestors(nodes), nodes.filter("kind = 'module'"), chosen)


@query("orders", "SELECT o_orderkey AS number, CASE WHEN o_orderkey % 2 = 0 THEN 'local' ELSE 'remote' END AS origin FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def pr_merge(orders):
    rows = orders.select(F.col("o_orderkey").alias("number"))
    return search.appended(rows.filter("number % 2 = 0").withColumn("origin", F.lit("local")), rows.filter("number % 3 = 0").withColumn("origin", F.lit("remote")))


@query("part", """SELECT p_partkey, 'http' AS protocol, CASE WHEN p_partkey % 2 = 0 THEN p_type END AS lane, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS scope, concat(p_name, ' +/é') AS channel FROM part""")
def channel_info(part):
    """Channel ids that were built from parts, taken apart again."""
    k = F.col("p_partkey")
    made = scalars.channel_id(F.lit("http"), F.concat("p_name", F.lit(" +/é")), F.when(k % 2 == 0, F.col("p_type")), F.when(k % 3 == 0, F.col("p_brand")))
    return part.select("p_partkey", made.alias("id")).select("p_partkey", *[c.alias(n) for n, c in scalars.channel_parts(F.col("id")).items()])


@query("occurrences", """SELECT ord, concat(file, ':', line, ':', col, CASE line % 3 WHEN 0 THEN '' WHEN 1 THEN concat('-', col + 4) ELSE concat('-', line + 2, ':', col + 4) END) AS site FROM occurrences""")
def call_sites(occurrences):
    m = F.col("line") % 3
    end_line, end_col = F.when(m == 1, F.col("line")).when(m == 2, F.col("line") + 2), F.when(m != 0, F.col("col") + 4)
    return occurrences.select("ord", scalars.site_text(F.col("file"), F.col("line"), F.col("col"), end_line, end_col).alias("site"))


@query("documents", "SELECT doc_id, CASE WHEN length(text) > 42 THEN concat(substring(text, 1, 39), '…') ELSE text END AS label FROM documents")
def compact_labels(documents):
    return documents.select("doc_id", scalars.compact(F.col("text")).alias("label"))
