"""Step trees, branch evidence, imports through re-exports, first callers."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import flows as S
from codeloom.operators.tree import first_of

from .registry import query


@query("flow_steps", "SELECT flow, parent AS path, arg_max(kind, ord) = 'exit' AS terminates FROM flow_steps WHERE parent IS NOT NULL GROUP BY flow, parent")
def flow_terminates(steps):
    return S.terminating(steps)


@query("flow_steps", """SELECT s.flow, s.path FROM flow_steps s JOIN (SELECT flow, parent, min(ord) AS first FROM flow_steps WHERE kind = 'exit' GROUP BY flow, parent) e
ON e.flow = s.flow AND e.parent = s.parent AND s.ord > e.first""")
def flow_dead_steps(steps):
    return S.dead_steps(steps)


@query("flow_steps", """WITH p AS (SELECT *, lead(path) OVER w AS nx, row_number() OVER w AS nth FROM flow_steps WINDOW w AS (PARTITION BY flow, parent ORDER BY ord))
SELECT flow, path AS source, nx AS target, 'next' AS kind FROM p WHERE nx IS NOT NULL AND kind <> 'exit' UNION ALL SELECT flow, parent, path, 'enter' FROM p WHERE parent IS NOT NULL AND nth = 1""")
def flow_control_edges(steps):
    return S.control_edges(steps)


@query("flow_steps", """WITH t AS (SELECT *, count(*) OVER (PARTITION BY flow) AS total, row_number() OVER (PARTITION BY flow ORDER BY path)::INTEGER AS place FROM flow_steps WHERE depth <= 1)
SELECT flow, place, path, kind, total > 4 AS truncated FROM t WHERE place <= 4""")
def flow_sequence(steps):
    return S.sequences(steps, 1, 4)


@query("flow_steps", "SELECT flow, target, count(*)::BIGINT AS times FROM flow_steps WHERE target IS NOT NULL GROUP BY flow, target")
def flow_callees(steps):
    return S.callees(steps)


@query("flow_steps", "SELECT flow, count_if(kind <> 'exit')::BIGINT AS steps FROM flow_steps GROUP BY flow")
def flow_step_counts(steps):
    return S.step_counts(steps)


@query("flow_steps", "SELECT * FROM flow_steps WHERE path = 'F' OR starts_with(path, 'F.')")
def flow_block(steps):
    """All that lies in the branch of filled lines."""
    return S.below(steps, "F")


@query("intervals", """WITH arms AS (SELECT l_orderkey * 1000000 + l_partkey AS arm, owner, a, b FROM intervals WHERE l_linenumber <= 3), c AS (SELECT owner, a, b, count(*) AS n, min(l_suppkey % 3) AS h FROM intervals WHERE l_linenumber > 1 GROUP BY owner, a, b),
m AS (SELECT arms.*, count(*) OVER (PARTITION BY owner, a, b) AS n FROM arms), e AS (SELECT arm, CASE WHEN m.n = 1 AND c.n = 1 THEN h END AS hits FROM m LEFT JOIN c ON c.owner = m.owner AND c.a = m.a AND c.b = m.b)
SELECT arm, hits, CASE WHEN hits > 0 THEN 'taken' WHEN hits = 0 THEN 'not-taken' ELSE 'unknown' END AS state FROM e""")
def branch_coverage(intervals):
    """Shipping spans of early lines as branch arms, of later ones as counters of the same customer."""
    span = [F.col("owner").alias("file"), F.col("a").alias("start"), F.col("b").alias("stop")]
    arms = intervals.filter("l_linenumber <= 3").select((F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("arm"), *span)
    return S.branch_evidence(arms, intervals.filter("l_linenumber > 1").select(*span, (F.col("l_suppkey") % 3).alias("hits")))


@query("part", """WITH RECURSIVE p AS (SELECT p_partkey AS id, p_name AS name, p_size, concat(p_brand, '/', p_type) AS subpath, concat(p_brand, '/', p_type, CASE length(p_type) % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '/index.ts' ELSE '' END) AS file FROM part),
ex AS (SELECT DISTINCT file, name FROM p WHERE p_size % 3 = 0), re AS (SELECT DISTINCT file, name, min(file) OVER (PARTITION BY split_part(file, '/', 1)) AS from_file FROM p WHERE p_size % 3 = 1),
walk AS (SELECT id, name, file, 0 AS d FROM p UNION SELECT w.id, w.name, re.from_file, w.d + 1 FROM walk w JOIN re ON re.file = w.file AND re.name = w.name WHERE w.d < 16 AND (w.file, w.name) NOT IN (SELECT (file, name) FROM ex))
SELECT DISTINCT id, file, name FROM walk WHERE (file, name) IN (SELECT (file, name) FROM ex)""")
def import_resolution(part):
    """Parts import their name from brand and type; some files define it, some pass on to the brand's first file."""
    subpath = F.concat("p_brand", F.lit("/"), "p_type")
    ending = F.when(F.length("p_type") % 3 == 0, ".ts").when(F.length("p_type") % 3 == 1, "/index.ts").otherwise("")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size", "p_brand", subpath.alias("subpath"), F.concat(subpath, ending).alias("file"))
    first = rows.groupBy("p_brand").agg(F.min(F.when(F.col("p_size") % 3 == 1, F.col("file"))).alias("from_file"))
    passed = rows.filter("p_size % 3 = 1").join(first, "p_brand").select("file", "name", "from_file")
    return S.resolved_imports(rows.select("id", "subpath", "name"), rows.select("file"), rows.filter("p_size % 3 = 0").select("file", "name"), passed)


@query("occurrences", """WITH f AS (SELECT target, source, min(ord) AS ord FROM occurrences WHERE kind = 'calls' GROUP BY target, source), r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY ord, source)::INTEGER AS nth FROM f)
SELECT target, source, nth FROM r WHERE nth <= 8""")
def first_callers(occurrences):
    """The first eight distinct callers of every target, in the order of their occurrences."""
    from pyspark.sql import Window as W

    firsts = occurrences.filter("kind = 'calls'").groupBy("target", "source").agg(F.min("ord").alias("ord"))
    few = first_of(firsts, ["target"], [F.asc("ord"), F.asc("source")], 8)
    return few.select("target", "source", F.row_number().over(W.partitionBy("target").orderBy("ord", "source")).alias("nth"))
