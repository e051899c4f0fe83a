"""Similarity, affinities and clusters (group I)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import cut
from codeloom.operators import cluster as G
from codeloom.operators import partition as P
from codeloom.operators import similarity as S

from .edge_queries import PATHS, _paths
from .metric_queries import CE
from .registry import query


def _six(x: str) -> Column:
    """Six decimals, so that the order of a sum doesn't show."""
    return (F.floor(F.col(x) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).alias(x)


SIX = "floor({0} * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS {0}"
VEC = """total AS (SELECT count(DISTINCT id) AS total FROM module_terms), df AS (SELECT term, count(*) AS df FROM module_terms GROUP BY term),
raw AS (SELECT id, term, (ln(n) + 1) * (ln((total + 1)::DOUBLE / (df + 1)) + 1) AS raw FROM module_terms JOIN df USING (term), total),
vec AS (SELECT id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw)"""


@query("module_terms", f"WITH {VEC} SELECT id, term, {SIX.format('weight')} FROM vec")
def tfidf(module_terms):
    return S.tf_idf(module_terms).select("id", "term", _six("weight"))


TOP = """ways AS (SELECT a AS source, b AS target, score FROM pairs UNION ALL SELECT b, a, score FROM pairs),
best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, target) AS r FROM ways)
SELECT least(source, target) AS a, greatest(source, target) AS b, floor(max(score) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS score FROM best WHERE r <= 3 GROUP BY 1, 2"""


@query("module_terms", f"""WITH {VEC}, pairs AS (SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS score FROM vec a JOIN vec b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.weight * b.weight) >= 0.25), {TOP}""")
def cosine_topk(module_terms):
    """The three most similar modules of each by what their parts are called, from a cosine of 0.25 on."""
    return S.nearest_pairs(S.cosine_pairs(S.tf_idf(module_terms), 0.25), 3).select("a", "b", _six("score"))


@query("module_terms", f"""WITH tot AS (SELECT id, sum(n) AS t FROM module_terms GROUP BY id),
low AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS m FROM module_terms a JOIN module_terms b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT a, b, m::DOUBLE / (x.t + y.t - m) AS score FROM low JOIN tot x ON x.id = a JOIN tot y ON y.id = b WHERE m::DOUBLE / (x.t + y.t - m) >= 0.2), {TOP}""")
def jaccard_topk(module_terms):
    weighed = module_terms.select("id", "term", F.col("n").cast("double").alias("weight"))
    return S.nearest_pairs(S.jaccard_pairs(weighed, 0.2), 3).select("a", "b", _six("score"))


PAIRS = """w AS (SELECT source, target, CASE kind WHEN 'instantiates' THEN 5.0::DOUBLE WHEN 'calls' THEN 4 WHEN 'extends' THEN 2 WHEN 'implements' THEN 2 WHEN 'imports' THEN 1 WHEN 'references' THEN 1 ELSE 0.5 END AS w FROM unit_edges),
aff AS (SELECT least(source, target) AS a, greatest(source, target) AS b, sum(w) AS weight FROM w WHERE source <> target GROUP BY 1, 2),
strength AS (SELECT id, sum(weight) AS s FROM (SELECT a AS id, weight FROM aff UNION ALL SELECT b, weight FROM aff) GROUP BY id)"""


@query("unit_edges", f"WITH {PAIRS} SELECT a, b, weight FROM aff")
def pair_affinity(unit_edges):
    return S.pair_affinities(unit_edges)


@query("unit_edges", f"WITH {PAIRS}, n AS (SELECT aff.a, aff.b, weight / sqrt(x.s * y.s) AS weight FROM aff JOIN strength x ON x.id = aff.a JOIN strength y ON y.id = aff.b) SELECT a, b, {SIX.format('weight')} FROM n")
def norm_affinity(unit_edges):
    return S.normal_affinities(S.pair_affinities(unit_edges)).select("a", "b", _six("weight"))


@query("unit_edges", f"WITH {PAIRS}, n AS (SELECT source, target, sum(w) AS weight FROM w WHERE source <> target GROUP BY ALL) SELECT source, target, {SIX.format('weight')} FROM n")
def directed_affinity(unit_edges):
    return S.directed_affinities(unit_edges).select("source", "target", _six("weight"))


FOLDER = """f AS (SELECT id, package AS folder, row_number() OVER (PARTITION BY package ORDER BY id) AS k FROM units),
near AS (SELECT x.id AS a, y.id AS b, 1.0::DOUBLE AS weight FROM f x JOIN f y ON x.folder = y.folder AND y.k BETWEEN x.k + 1 AND x.k + 3)"""


@query("units", f"WITH {FOLDER} SELECT a, b, weight FROM near")
def folder_affinity(units):
    return S.folder_affinities(units.select("id", F.col("package").alias("folder")))


@query("units unit_edges", f"""WITH {PAIRS}, {FOLDER}, x AS (SELECT a, b, weight / (SELECT max(weight) FROM aff) AS v FROM aff UNION ALL SELECT a, b, weight * 0.5::DOUBLE FROM near),
c AS (SELECT a, b, sum(v) AS weight FROM x GROUP BY a, b) SELECT a, b, {SIX.format('weight')} FROM c""")
def combine_affinity(units, unit_edges):
    near = S.folder_affinities(units.select("id", F.col("package").alias("folder")))
    return S.combined([(S.pair_affinities(unit_edges), 1.0), (near, 0.5)]).select("a", "b", _six("weight"))


@query("part supplier", f"""WITH {PATHS}, p AS (SELECT DISTINCT path FROM paths), d AS (SELECT path, string_split(path, '/')[:-2] AS parts FROM p),
e AS (SELECT unnest(range(1, len(parts) + 1)) AS k, parts FROM d), c AS (SELECT k, array_to_string(parts[:k], '/') AS prefix, count(*) AS n FROM e GROUP BY ALL),
best AS (SELECT coalesce(max(k), 0) AS k, coalesce(arg_max(prefix, k), '') AS prefix FROM c WHERE 2 * n > (SELECT count(*) FROM d))
SELECT path, coalesce(CASE WHEN array_to_string(parts[:k], '/') = prefix THEN parts[k + 1] ELSE parts[1] END, 'root') AS domain FROM d, best""")
def path_domains(part, supplier):
    return S.path_domains(_paths(part, supplier).select("path"))


@query("module_terms module_groups", f"""WITH {VEC}, sizes AS (SELECT package, count(*) AS members FROM module_groups GROUP BY package),
found AS (SELECT package, term, count(*) AS covers, sum(weight) AS score FROM vec JOIN module_groups USING (id) GROUP BY ALL),
fit AS (SELECT *, score * pow(covers::DOUBLE / members, 2.0::DOUBLE) AS v FROM found JOIN sizes USING (package) WHERE covers >= greatest(2, ceil(members * 0.2::DOUBLE))),
best AS (SELECT *, row_number() OVER (PARTITION BY package ORDER BY v DESC, term) AS r FROM fit)
SELECT package AS "group", term, covers::BIGINT AS covers, members::BIGINT AS members FROM best WHERE r = 1""")
def group_labels(module_terms, module_groups):
    return S.label_terms(module_terms, module_groups.withColumnRenamed("package", "group"))


@query("unit_edges", """WITH RECURSIVE seeds AS (SELECT DISTINCT source AS id FROM unit_edges WHERE regexp_matches(source, '/n(1|7|13)$')),
hop AS (SELECT id, id AS owner, 0 AS distance FROM seeds UNION SELECT e.target, h.owner, h.distance + 1 FROM hop h JOIN unit_edges e ON e.source = h.id WHERE h.distance < 25)
SELECT id, arg_min(owner, (distance, owner)) AS owner, min(distance)::INTEGER AS distance FROM hop GROUP BY id""")
def service_clusters(unit_edges):
    named = unit_edges.filter(F.col("source").rlike("/n(1|7|13)$")).select(F.col("source").alias("id"))
    return G.owned(named, unit_edges)


@query("units unit_edges", f"WITH {CE} SELECT id, (ce + ca) * (1 + ca) AS rank FROM cc ORDER BY rank DESC, id LIMIT 2")
def cluster_seeds(units, unit_edges):
    """No unit is named like a service here, so the best connected tenth stands in."""
    from codeloom.operators.metrics import couplings

    degrees = couplings(units, unit_edges)
    chosen = G.seeds(units, degrees, F.col("id").rlike("(?i)(service|server|app)$"))
    return degrees.join(chosen, "id", "left_semi").select("id", ((F.col("ce") + F.col("ca")) * (1 + F.col("ca"))).alias("rank"))


def _packages(units: DataFrame) -> DataFrame:
    return units.select("id", F.col("package").alias("group"))


@query("units unit_edges", """WITH p AS (SELECT DISTINCT a.package AS s, b.package AS t FROM unit_edges e JOIN units a ON a.id = e.source JOIN units b ON b.id = e.target WHERE a.package <> b.package)
SELECT package AS "group", count(*)::BIGINT AS members, (SELECT count(*) FROM p WHERE s = u.package)::BIGINT AS ce, (SELECT count(*) FROM p WHERE t = u.package)::BIGINT AS ca FROM units u GROUP BY package""")
def domains(units, unit_edges):
    return G.group_degrees(unit_edges, _packages(units))


@query("units unit_edges", """SELECT a.package AS source, b.package AS target, sum(e.weight)::BIGINT AS weight, count(*)::BIGINT AS n FROM unit_edges e JOIN units a ON a.id = e.source JOIN units b ON b.id = e.target
WHERE a.package <> b.package GROUP BY ALL""")
def cluster_couplings(units, unit_edges):
    return G.lifted_pairs(unit_edges, _packages(units))


@query("units unit_edges", f"""WITH {PAIRS}, x AS (SELECT least(p.package, q.package) AS x, greatest(p.package, q.package) AS y, sum(weight) AS w, count(*) AS n FROM aff JOIN units p ON p.id = a JOIN units q ON q.id = b WHERE p.package <> q.package GROUP BY 1, 2),
s AS (SELECT package, count(*) AS n FROM units GROUP BY package)
SELECT (SELECT count(*) FROM s)::BIGINT AS groups, (SELECT max(n) FROM s)::BIGINT AS largest, coalesce(sum(w), 0)::DOUBLE AS cut_weight, coalesce(sum(n), 0)::BIGINT AS cut_edges, count(*)::BIGINT AS quotient_edges FROM x""")
def partition_measure(units, unit_edges):
    return G.measure(S.pair_affinities(unit_edges), _packages(units))


@query("units unit_edges", f"""WITH {PAIRS}, m AS (SELECT p.package AS x, q.package AS y, weight FROM aff JOIN units p ON p.id = a JOIN units q ON q.id = b),
s AS (SELECT package AS g, count(*) AS n, coalesce((SELECT sum(weight) FROM m WHERE x = u.package AND y = x), 0) AS i, coalesce((SELECT sum(weight) FROM m WHERE (x = u.package OR y = u.package) AND x <> y), 0) AS o FROM units u GROUP BY package),
q AS (SELECT sum(i - 0.5::DOUBLE * n * (n - 1) / 2) AS cpm, sum(i / (SELECT sum(weight) FROM aff) - pow((2 * i + o) / (2 * (SELECT sum(weight) FROM aff)), 2.0::DOUBLE)) AS modularity, sum(CASE WHEN i > 0 THEN 2 * i / (2 * i + o) ELSE 0 END) AS mq FROM s)
SELECT {SIX.format('cpm')}, {SIX.format('modularity')}, {SIX.format('mq')} FROM q""")
def partition_quality(units, unit_edges):
    return G.qualities(S.pair_affinities(unit_edges), _packages(units), 0.5).select(_six("cpm"), _six("modularity"), _six("mq"))


@query("units unit_edges")
def potts_clusters(units, unit_edges):
    """Groups by local moves on the constant Potts objective."""
    return G.local_moves(units, S.pair_affinities(unit_edges), G.potts_gain(1.0))


@query("units unit_edges")
def modular_clusters(units, unit_edges):
    """Groups by local moves on modularity."""
    pairs = S.pair_affinities(unit_edges)
    return G.local_moves(units, pairs, G.modular_gain(pairs.agg(F.sum("weight")).first()[0] or 1.0))


@query("units unit_edges")
def sized_clusters(units, unit_edges):
    """As potts_clusters, but groups of six are closed."""
    return G.local_moves(units, S.pair_affinities(unit_edges), G.potts_gain(0.5), most=6)


#: Files, and how many edges they have between them.
_FILES = """fe AS (SELECT least(a, b) AS a, greatest(a, b) AS b, count(*)::DOUBLE AS weight FROM (SELECT regexp_replace(source, '#.*$', '') AS a, regexp_replace(target, '#.*$', '') AS b FROM edges) x WHERE a <> b GROUP BY 1, 2),
fn AS (SELECT a AS id FROM fe UNION SELECT b FROM fe)"""


def _file_graph(edges):
    module = lambda c: F.regexp_replace(c, "#.*$", "")
    rows = edges.select(module("source").alias("x"), module("target").alias("y")).filter("x <> y")
    pairs = cut(rows.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").cast("double").alias("weight")))
    nodes = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    return nodes, pairs


@query("edges", f"""WITH {_FILES} SELECT (SELECT count(*) FROM fn)::BIGINT AS nodes, true AS once, true AS bounded, true AS whole, true AS full""")
def packed_groups(edges):
    """Files packed to groups of about 40, from groups of three: none is over 50, no group is torn, and no two that belong together still fit."""
    nodes, pairs = _file_graph(edges)
    start = cut(nodes.select("id", F.concat(F.regexp_replace("id", "/.*$", ""), F.lit("."), F.pmod(F.xxhash64("id"), F.lit(3)).cast("string")).alias("group")))
    groups = cut(P.packed(start, pairs, 40))
    size = groups.groupBy("group").agg(F.count("*").alias("n"))
    torn = start.withColumnRenamed("group", "was").join(groups, "id").groupBy("was").agg(F.count_distinct("group").alias("k")).agg((F.max("k") == 1).alias("whole"))
    of = lambda end: groups.join(size, "group").select(F.col("id").alias(end), F.col("group").alias(f"g{end}"), F.col("n").alias(f"n{end}"))
    still = pairs.join(of("a"), "a").join(of("b"), "b").filter("ga <> gb AND na + nb <= 50 AND least(na, nb) < 40").agg((F.count("*") == 0).alias("full"))
    once = groups.groupBy("id").agg(F.count("*").alias("k")).join(nodes, "id", "full_outer").agg(F.count("*").alias("nodes"), F.min(F.coalesce(F.col("k") == 1, F.lit(False))).alias("once"))
    return once.join(size.agg((F.max("n") <= 50).alias("bounded"))).join(torn).join(still)
