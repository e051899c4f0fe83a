"""Reviews of changes and relations between nodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import relations as R
from codeloom.operators import review as V
from codeloom.operators import tree

from .impact_queries import HUNKS, _hunks
from .reach_queries import ANC
from .registry import query

LINES = """l AS (SELECT l_orderkey, l_linestatus, CASE l_returnflag WHEN 'A' THEN '+' WHEN 'R' THEN '-' ELSE ' ' END AS sign, l_partkey,
row_number() OVER (PARTITION BY l_orderkey, l_linestatus ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity) AS k,
dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linestatus) AS hunk FROM lineitem),
n AS (SELECT *, count(CASE WHEN sign IN ('-', ' ') THEN 1 END) OVER w AS o, count(CASE WHEN sign IN ('+', ' ') THEN 1 END) OVER w AS p FROM l
  WINDOW w AS (PARTITION BY l_orderkey, hunk ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lines AS (SELECT CAST(l_orderkey AS VARCHAR) AS path, hunk::BIGINT AS hunk, CASE sign WHEN '+' THEN 'added' WHEN '-' THEN 'deleted' ELSE 'context' END AS kind,
CASE WHEN sign <> '+' THEN l_orderkey % 50 + hunk * 100 + o END::BIGINT AS old_line, CASE WHEN sign <> '-' THEN l_orderkey % 40 + hunk * 100 + p END::BIGINT AS new_line, CAST(l_partkey AS VARCHAR) AS text FROM n)"""


def _patches(lineitem):
    """One patch for each order: a hunk for each line status, signs from return flags."""
    sign = F.when(F.col("l_returnflag") == "A", "+").when(F.col("l_returnflag") == "R", "-").otherwise(" ")
    row = F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", F.concat(sign, F.col("l_partkey").cast("string")).alias("line"))
    hunks = lineitem.groupBy("l_orderkey", "l_linestatus").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    bodies = hunks.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linestatus", "rows"))).alias("h"))
    start = lambda m, i: (F.col("l_orderkey") % m + (i + 1) * 100).cast("string")
    text = F.transform("h", lambda x, i: F.concat(F.lit("@@ -"), start(50, i), F.lit(",9 +"), start(40, i), F.lit(",9 @@\n"), F.array_join(x["rows"]["line"], "\n")))
    return bodies.select(F.col("l_orderkey").cast("string").alias("path"), F.concat(F.lit("diff --git a b\n"), F.array_join(text, "\n")).alias("patch"))


@query("lineitem", f"WITH {LINES} SELECT * FROM lines")
def diff_lines(lineitem):
    return V.patch_lines(_patches(lineitem)).drop("pos")


@query("lineitem", f"""WITH {LINES} SELECT path, hunk, min(CASE WHEN kind = 'added' THEN new_line END) AS first, max(CASE WHEN kind = 'added' THEN new_line END) AS last,
count_if(kind = 'added')::BIGINT AS added, count_if(kind = 'deleted')::BIGINT AS deleted FROM lines GROUP BY path, hunk""")
def diff_ranges(lineitem):
    return V.changed_ranges(V.patch_lines(_patches(lineitem)))


STATUS = "status AS (SELECT concat('src/p', p_partkey) AS path, CASE p_partkey % 4 WHEN 0 THEN 'added' WHEN 1 THEN 'deleted' WHEN 2 THEN 'modified' ELSE 'renamed' END AS status, CASE WHEN p_partkey % 4 = 3 THEN concat('old/p', p_partkey) END AS previous FROM part)"


@query("part", f"WITH {STATUS} SELECT * FROM status")
def changed_manifest(part):
    """Status manifests, one for each brand, read back."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("src/p"), k)
    token = F.when(k % 4 == 0, F.array(F.lit("A"), name)).when(k % 4 == 1, F.array(F.lit("D"), name)).when(k % 4 == 2, F.array(F.lit("M"), name))
    token = token.otherwise(F.array(F.lit("R087"), F.concat(F.lit("old/p"), k), name))
    return V.name_status(part.groupBy("p_brand").agg(F.concat(F.array_join(F.flatten(F.collect_list(token)), "\x00"), F.lit("\x00")).alias("body")))


@query("intervals orders", f"""WITH {HUNKS}, met AS (SELECT h.owner, h.comment, h.line, i.l_partkey AS node, row_number() OVER (PARTITION BY h.comment ORDER BY i.l_linenumber DESC, i.b - i.a, i.l_partkey) AS r
FROM (SELECT o_custkey AS owner, o_orderkey AS comment, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS INTEGER) AS line FROM orders) h LEFT JOIN intervals i ON i.owner = h.owner AND h.line BETWEEN i.a AND i.b)
SELECT owner, comment, line, node FROM met WHERE r = 1""")
def comment_nodes(intervals, orders):
    """Order days as comments on the shipping spans of their customer; the line number is the depth."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
    comments = orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("comment"), day.alias("line"))
    return V.comment_places(comments, intervals.select("owner", F.col("l_partkey").alias("node"), "a", "b", F.col("l_linenumber").alias("depth")), "owner")


@query("intervals", """WITH s AS (SELECT n.l_orderkey * 1000000 + n.l_partkey AS node, f.l_orderkey * 1000000 + f.l_partkey AS function,
8 + CASE WHEN f.a + f.l_linenumber % 2 = n.a THEN 4 ELSE 0 END + CASE WHEN n.l_partkey % 3 = f.l_suppkey % 3 THEN 2 ELSE 0 END + CASE WHEN f.b <= n.b AND f.a + f.l_linenumber % 2 >= n.a THEN 1 ELSE 0 END AS score
FROM intervals n JOIN intervals f ON n.owner = f.owner AND n.a = f.a),
t AS (SELECT *, max(score) OVER (PARTITION BY node) AS top FROM s)
SELECT node, min(function) AS function, max(score)::INTEGER AS score FROM t WHERE score = top GROUP BY node HAVING count(*) = 1""")
def coverage_match(intervals):
    """Shipping spans as nodes and as counters of the same customer."""
    key = F.col("l_orderkey") * 1000000 + F.col("l_partkey")
    nodes = intervals.select(F.col("owner").alias("file"), key.alias("node"), F.col("a").alias("line"), F.col("b").alias("end_line"), (F.col("l_partkey") % 3).alias("name"))
    counters = intervals.select(
        F.col("owner").alias("in_file"), key.alias("function"), F.col("a").alias("decl"), (F.col("a") + F.col("l_linenumber") % 2).alias("body"), F.col("b").alias("fn_end"), (F.col("l_suppkey") % 3).alias("fn_name")
    )
    return V.coverage_evidence(nodes, counters)


@query("part", """WITH base AS (SELECT p_partkey AS id, p_type AS g, p_name AS s FROM part WHERE p_partkey % 3 <> 0), head AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN -p_partkey ELSE p_partkey END AS id, p_type AS g, p_name AS s FROM part WHERE p_partkey % 4 <> 0),
l AS (SELECT * FROM base WHERE id NOT IN (SELECT id FROM head)), r AS (SELECT * FROM head WHERE id NOT IN (SELECT id FROM base)),
l1 AS (SELECT g, s, min(id) AS b FROM l GROUP BY g, s HAVING count(*) = 1), r1 AS (SELECT g, s, min(id) AS h FROM r GROUP BY g, s HAVING count(*) = 1),
sig AS (SELECT b, h FROM l1 JOIN r1 USING (g, s)), l2 AS (SELECT * FROM l WHERE id NOT IN (SELECT b FROM sig)), r2 AS (SELECT * FROM r WHERE id NOT IN (SELECT h FROM sig)),
rest AS (SELECT x.b, y.h FROM (SELECT g, min(id) AS b FROM l2 GROUP BY g HAVING count(*) = 1) x JOIN (SELECT g, min(id) AS h FROM r2 GROUP BY g HAVING count(*) = 1) y USING (g))
SELECT id AS base_id, id AS head_id, 'id' AS how FROM base WHERE id IN (SELECT id FROM head) UNION ALL SELECT b, h, 'signature' FROM sig UNION ALL SELECT b, h, 'leftover' FROM rest
UNION ALL SELECT id, NULL, 'deleted' FROM l2 WHERE id NOT IN (SELECT b FROM rest) UNION ALL SELECT NULL, id, 'new' FROM r2 WHERE id NOT IN (SELECT h FROM rest)""")
def rename_pairs(part):
    """Two versions of the parts, every second one renamed."""
    k = F.col("p_partkey")
    base = part.filter(k % 3 != 0).select(k.alias("id"), F.col("p_type").alias("group"), F.col("p_name").alias("signature"))
    head = part.filter(k % 4 != 0).select(F.when(k % 2 == 0, -k).otherwise(k).alias("id"), F.col("p_type").alias("group"), F.col("p_name").alias("signature"))
    return V.paired(base, head)


@query("events", """WITH a AS (SELECT event_id // 2 AS pair, props->>'$.k' AS v FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id // 2 AS pair, props->>'$.k' AS v FROM events WHERE event_id % 2 = 1)
SELECT coalesce(a.pair, b.pair) AS pair, 'k' AS field, CASE WHEN a.pair IS NULL THEN 'added' WHEN b.pair IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM a FULL JOIN b ON a.pair = b.pair WHERE a.v IS DISTINCT FROM b.v""")
def value_diff(events):
    """Properties of every second event against those of the next."""
    half = lambda r: events.filter(F.col("event_id") % 2 == r).select(F.floor(F.col("event_id") / 2).alias("pair"), F.col("props").alias("body"))
    return V.value_changes(half(0), half(1), "pair")


@query("lineitem", """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 7 AS p, l_quantity::BIGINT AS q, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i FROM lineitem),
w AS (SELECT o, count(*) AS n, arg_min(f, i) AS f FROM l GROUP BY o), b AS (SELECT o // 2 AS pair, * FROM w WHERE o % 2 = 0), a AS (SELECT o // 2 AS pair, * FROM w WHERE o % 2 = 1),
x AS (SELECT b.pair, l.i, l.p, l.q FROM l JOIN b USING (o)), y AS (SELECT a.pair, l.i, l.p, l.q FROM l JOIN a USING (o)), both_ AS (SELECT pair FROM a JOIN b USING (pair)),
z AS (SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.i, y.i) AS i, x.p AS p0, x.q AS q0, y.p AS p1, y.q AS q1 FROM x FULL JOIN y ON x.pair = y.pair AND x.i = y.i WHERE coalesce(x.pair, y.pair) IN (SELECT pair FROM both_))
SELECT pair, concat('$.lines[', i, '][0]') AS path, 'changed' AS state, p0::VARCHAR AS before, p1::VARCHAR AS after FROM z WHERE p0 <> p1
UNION ALL SELECT pair, concat('$.lines[', i, '][1].q'), 'changed', q0::VARCHAR, q1::VARCHAR FROM z WHERE q0 <> q1
UNION ALL SELECT pair, concat('$.lines[', i, ']'), CASE WHEN p0 IS NULL THEN 'added' ELSE 'removed' END, concat('[', p0, ',{"q":', q0, '}]').replace('[,{"q":}]', 'x').nullif('x'), concat('[', p1, ',{"q":', q1, '}]').replace('[,{"q":}]', 'x').nullif('x') FROM z WHERE (p0 IS NULL) <> (p1 IS NULL)
UNION ALL SELECT pair, '$["first flag"]', 'changed', concat('"', b.f, '"'), concat('"', a.f, '"') FROM a JOIN b USING (pair) WHERE a.f <> b.f""")
def value_paths(lineitem):
    """Orders as nested values, each even one against the next."""
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    lines = F.sort_array(F.collect_list(F.struct(place.alias("at"), (F.col("l_partkey") % 7).alias("p"), F.col("l_quantity").cast("long").alias("q"))))
    made = lineitem.groupBy("l_orderkey").agg(lines.alias("l"), F.min_by("l_returnflag", place).alias("f"))
    texts = F.array_join(F.transform("l", lambda x: F.concat(F.lit("["), x["p"].cast("string"), F.lit(', {"q": '), x["q"].cast("string"), F.lit("}]"))), ", ")
    body = F.concat(F.lit('{"lines": ['), texts, F.lit('], "first flag": "'), "f", F.lit('"}'))
    half = lambda r, name: made.filter(F.col("l_orderkey") % 2 == r).select(F.floor(F.col("l_orderkey") / 2).alias("pair"), body.alias(name))
    return V.nested_changes(half(0, "before").join(half(1, "after"), "pair"), "pair")


TICKS = """t AS (SELECT user_id, arg_max(value > 20, event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY user_id),
s AS (SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN seen IS NULL THEN 'todo' WHEN seen = (c_acctbal > 0) THEN 'done' ELSE 'stale' END AS state FROM customer LEFT JOIN t ON user_id = c_custkey)"""


def _ticks(events, customer):
    ticks = events.filter("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("event_id").alias("at"), (F.col("value") > 20).alias("digest"))
    return V.tick_states(ticks, customer.select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("digest")))


@query("events customer", f"WITH {TICKS} SELECT id, state FROM s")
def review_ticks(events, customer):
    return _ticks(events, customer)


@query("events customer", f"WITH {TICKS} SELECT nation, CASE WHEN bool_or(state = 'stale') THEN 'stale' WHEN bool_and(state = 'done') THEN 'done' ELSE 'todo' END AS state, count_if(state = 'done')::BIGINT AS viewed FROM s GROUP BY nation")
def review_views(events, customer):
    states = _ticks(events, customer).join(customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), "id")
    return V.view_states(states, "nation")


KINDS = [("calls", "behaviour"), ("instantiates", "behaviour"), ("references", "dependency"), ("imports", "dependency"), ("extends", "inheritance"), ("tests", "other")]
KIND_RULES = [("imports", "ignore", True, 1.0), ("calls", "wire", True, 4.0)]
FAMILY_RULES = [("behaviour", "wire", True, 2.0), ("dependency", "wire", False, 1.0)]
OVERRIDES = [("references", True), ("calls", True), ("imports", True), ("extends", False)]


def _policy(spark):
    rules = "{0} string, role string, visible boolean, weight double"
    kinds = spark.createDataFrame(KINDS, "kind string, family string")
    return R.policies(kinds, spark.createDataFrame(KIND_RULES, rules.format("kind")), spark.createDataFrame(FAMILY_RULES, rules.format("family")), {"role": "wire", "visible": True, "weight": 0.5})


POLICY = f"""k(kind, family) AS (VALUES {", ".join(map(str, KINDS))}), kr(kind, role, visible, weight) AS (VALUES {", ".join(map(str, KIND_RULES))}), fr(family, role, visible, weight) AS (VALUES {", ".join(map(str, FAMILY_RULES))}),
o(kind, own) AS (VALUES {", ".join(map(str, OVERRIDES))}),
policy AS (SELECT kind, family, coalesce(kr.role, fr.role, 'wire') AS role, coalesce(kr.visible, fr.visible, true) AS visible, coalesce(kr.weight, fr.weight, 0.5)::DOUBLE AS weight FROM k LEFT JOIN kr USING (kind) LEFT JOIN fr USING (family))"""


#: Types of parts within a brand as kinds of relations, brands as their families; rules and wishes come from sizes and prices.
TABLED = """k AS (SELECT concat(p_brand, '/', p_type) AS kind, p_brand AS family, count(*) AS n, min(p_size) AS s, max(p_partkey) AS m FROM part GROUP BY p_brand, p_type),
kr AS (SELECT kind, CASE WHEN s = 1 THEN 'ignore' ELSE 'wire' END AS role, m % 2 = 0 AS visible, (n / 4.0)::DOUBLE AS weight FROM k WHERE n % 3 = 0),
fr AS (SELECT family, 'wire' AS role, sum(n) % 2 = 0 AS visible, sum(n)::DOUBLE AS weight FROM k WHERE right(family, 1) IN ('1', '2', '3') GROUP BY family), o AS (SELECT kind, m % 3 = 0 AS own FROM k WHERE s > 2),
policy AS (SELECT kind, family, coalesce(kr.role, fr.role, 'wire') AS role, coalesce(kr.visible, fr.visible, true) AS visible, coalesce(kr.weight, fr.weight, 0.5)::DOUBLE AS weight FROM k LEFT JOIN kr USING (kind) LEFT JOIN fr USING (family))"""


def _tabled(part):
    k = part.groupBy(F.concat("p_brand", F.lit("/"), "p_type").alias("kind"), F.col("p_brand").alias("family")).agg(F.count("*").alias("n"), F.min("p_size").alias("s"), F.max("p_partkey").alias("m"))
    kind_rules = k.filter("n % 3 = 0").select("kind", F.when(F.col("s") == 1, "ignore").otherwise("wire").alias("role"), (F.col("m") % 2 == 0).alias("visible"), (F.col("n") / 4.0).alias("weight"))
    family_rules = k.filter(F.right("family", F.lit(1)).isin("1", "2", "3")).groupBy("family").agg(F.lit("wire").alias("role"), (F.sum("n") % 2 == 0).alias("visible"), F.sum("n").cast("double").alias("weight"))
    policy = R.policies(k.select("kind", "family"), kind_rules, family_rules, {"role": "wire", "visible": True, "weight": 0.5})
    return policy, k.filter("s > 2").select("kind", (F.col("m") % 3 == 0).alias("shown"))


@query("part", f"WITH {TABLED} SELECT * FROM policy")
def relation_policy(part):
    return _tabled(part)[0]


@query("occurrences", f"""WITH {POLICY}, s AS (SELECT kind, role <> 'ignore' AND coalesce(own, visible) AS shown FROM policy LEFT JOIN o USING (kind))
SELECT kind, shown, (SELECT count(*) FROM occurrences c WHERE c.kind = s.kind)::BIGINT AS edges FROM s""")
def relation_visibility(occurrences):
    """Which kinds are shown, and how many edges that is."""
    spark = occurrences.sparkSession
    overrides = spark.createDataFrame(OVERRIDES, "kind string, shown boolean")
    counts = occurrences.groupBy("kind").agg(F.count("*").alias("edges"))
    return R.shown(_policy(spark), overrides).join(counts, "kind", "left").select("kind", "shown", F.coalesce("edges", F.lit(0).cast("long")).alias("edges"))


@query("part", f"WITH {TABLED} SELECT kind, own AS shown FROM o JOIN policy USING (kind) WHERE own <> visible")
def relation_overrides(part):
    return R.departures(*_tabled(part))


@query("part", f"WITH {TABLED} SELECT kind, role <> 'ignore' AND coalesce(own, visible) AS shown FROM policy LEFT JOIN o USING (kind)")
def relation_shown(part):
    """Which kinds are drawn once the rules of the tables and the reader's wishes have met."""
    return R.shown(*_tabled(part))


MADE = """n AS (SELECT id, kind, parent_id, CASE WHEN kind = 'method' AND right(id, 1) IN ('3', '7') THEN 'constructor' ELSE display_name END AS display_name FROM nodes),
made AS (SELECT CASE WHEN right(s.id, 1) = '1' THEN 'calls' ELSE 'instantiates' END AS kind, s.id AS source, c.id AS target FROM n s JOIN n c ON s.parent_id = c.parent_id AND right(s.id, 1) = right(c.id, 1) WHERE s.kind = 'function' AND c.kind = 'class'),
ctor AS (SELECT parent_id, id FROM n WHERE display_name = 'constructor')"""


def _made(nodes):
    """Suppliers that make customers of their nation; orders that end in 3 or 7 as constructors.

    Edges lead from places, a nation and a digit, to the customers there; the suppliers of a place are (place, source).
    """
    named = nodes.withColumn("display_name", F.when((F.col("kind") == "method") & F.substring("id", -1, 1).isin("3", "7"), "constructor").otherwise(F.col("display_name")))
    end = F.substring("id", -1, 1)
    place = F.concat_ws("#", "parent_id", end)
    makers = named.filter("kind = 'function'").select(place.alias("place"), F.col("id").alias("source"))
    edges = named.filter("kind = 'class'").select(F.when(end == "1", "calls").otherwise("instantiates").alias("kind"), place.alias("source"), F.col("id").alias("target"))
    return named, edges, makers


def _from_makers(edges, makers):
    """Edges from places as edges from each supplier there: these are the product of the two, and are made last."""
    return makers.join(edges.withColumnRenamed("source", "place"), "place").select("kind", "source", "target")


@query("nodes", f"WITH {MADE} SELECT * FROM made UNION ALL SELECT kind, source, ctor.id FROM made JOIN ctor ON parent_id = target WHERE kind = 'instantiates'")
def expand_instantiations(nodes):
    named, edges, makers = _made(nodes)
    return _from_makers(R.with_constructor_calls(named, edges), makers)


@query("nodes", f"WITH {MADE}, f AS (SELECT parent_id, min(id) AS id FROM ctor GROUP BY parent_id) SELECT kind, source, CASE WHEN kind = 'instantiates' THEN coalesce(f.id, target) ELSE target END AS target FROM made LEFT JOIN f ON parent_id = target")
def block_deps(nodes):
    named, edges, makers = _made(nodes)
    return _from_makers(R.to_constructors(named, edges), makers)


@query("nodes units unit_edges", """WITH RECURSIVE ext AS (SELECT DISTINCT source, target FROM unit_edges WHERE kind = 'extends'),
up AS (SELECT source AS id, target AS super, 1 AS depth FROM ext UNION SELECT u.id, e.target, u.depth + 1 FROM up u JOIN ext e ON e.source = u.super WHERE u.depth < 25),
sup AS (SELECT id, super, min(depth) AS depth FROM up WHERE id <> super GROUP BY id, super),
m AS (SELECT parent_id AS owner, id, right(id, 1) AS name FROM nodes WHERE kind = 'function' AND contains(id, '#S')),
i AS (SELECT id FROM units WHERE kind = 'interface')
SELECT a.id AS source, b.id AS target, min(depth)::INTEGER AS depth FROM sup JOIN m a ON a.owner = sup.super AND a.owner IN (SELECT id FROM i) JOIN m b ON b.owner = sup.id AND b.name = a.name AND b.owner NOT IN (SELECT id FROM i) GROUP BY 1, 2""")
def implemented_by(nodes, units, unit_edges):
    """Suppliers as members of their nation, named by their last digit."""
    members = nodes.filter("kind = 'function' AND contains(id, '#S')").select(F.col("parent_id").alias("owner"), "id", F.substring("id", -1, 1).alias("name"))
    return R.implementations(members, units.filter("kind = 'interface'").select("id"), R.supertypes(unit_edges))


GHOSTS = f"""WITH RECURSIVE {ANC}, vis AS (SELECT a.id, min_by(a.anc_id, a.depth) AS near FROM anc a WHERE a.anc_id IN (SELECT id FROM nodes WHERE parent_id = 'tp:Brand1' OR id = 'tp:Brand1') GROUP BY a.id),
w AS (SELECT coalesce(s.near, t.near) AS visible, CASE WHEN s.near IS NOT NULL THEN e.target ELSE e.source END AS ghost, CASE WHEN s.near IS NOT NULL THEN 'out' ELSE 'in' END AS direction
FROM edges e LEFT JOIN vis s ON s.id = e.source LEFT JOIN vis t ON t.id = e.target WHERE (s.near IS NULL) <> (t.near IS NULL)),
wires AS (SELECT visible, ghost, direction, count(*)::BIGINT AS weight FROM w GROUP BY ALL)"""


def _ghosts(nodes, edges):
    visible = nodes.filter("parent_id = 'tp:Brand1' OR id = 'tp:Brand1'").select("id")
    return R.ghosts(edges, tree.nearest(tree.ancestors(nodes), visible))


@query("nodes edges", GHOSTS + " SELECT * FROM wires")
def ghost_wires(nodes, edges):
    return _ghosts(nodes, edges)


@query("nodes edges", GHOSTS + """, p AS (SELECT w.*, n.parent_id FROM wires w LEFT JOIN nodes n ON n.id = w.ghost), c AS (SELECT direction, parent_id FROM p WHERE parent_id IS NOT NULL GROUP BY ALL HAVING count(DISTINCT ghost) > 3)
SELECT visible, CASE WHEN c.parent_id IS NOT NULL THEN c.parent_id ELSE ghost END AS ghost, p.direction, sum(weight)::BIGINT AS weight FROM p LEFT JOIN c ON c.direction = p.direction AND c.parent_id = p.parent_id GROUP BY ALL""")
def ghost_groups(nodes, edges):
    return R.folded_ghosts(_ghosts(nodes, edges), nodes)


@query("nodes edges", """WITH s AS (SELECT DISTINCT n.parent_id AS id FROM edges e JOIN nodes n ON n.id = e.target WHERE n.kind = 'function' AND right(e.target, 1) = '5'),
p AS (SELECT s.id, n.parent_id, count(*) OVER (PARTITION BY n.parent_id) AS n FROM s JOIN nodes n USING (id))
SELECT CASE WHEN parent_id IS NOT NULL AND n >= 3 THEN parent_id ELSE id END AS id, count(*)::BIGINT AS n FROM p GROUP BY 1""")
def seed_rollup(nodes, edges):
    """Modules of called functions that end in 5, rolled up to their packages."""
    called = edges.filter(F.substring("target", -1, 1) == "5").select(F.col("target").alias("id"))
    modules = nodes.filter("kind = 'function'").join(called, "id", "left_semi").select(F.col("parent_id").alias("id")).distinct()
    return R.rolled_seeds(modules, nodes)


CAUSAL = """e AS (SELECT CASE WHEN right(target, 1) = '4' THEN 'handles' ELSE kind END AS kind, source, target FROM edges),
a AS (SELECT kind, CASE WHEN kind = 'handles' THEN target ELSE source END AS source, CASE WHEN kind = 'handles' THEN source ELSE target END AS target FROM e),
handled AS (SELECT DISTINCT target FROM a WHERE kind = 'handles'),
arcs AS (SELECT * FROM a WHERE kind = 'handles' UNION ALL SELECT a.* FROM a ANTI JOIN handled USING (target) WHERE kind <> 'handles')"""


def _arcs(edges):
    """Calls to ids that end in 4 as handlings."""
    return R.causal_arcs(edges.withColumn("kind", F.when(F.substring("target", -1, 1) == "4", "handles").otherwise(F.col("kind"))))


@query("edges", f"WITH {CAUSAL} SELECT * FROM arcs")
def causal_arcs(edges):
    return _arcs(edges)


@query("edges", f"""WITH RECURSIVE {CAUSAL}, seed AS (SELECT min(source) AS id FROM arcs WHERE contains(source, '#S')),
b AS (SELECT id, 0 AS d FROM seed UNION SELECT a.source, d + 1 FROM b JOIN arcs a ON a.target = b.id WHERE d < 4), f AS (SELECT id, 0 AS d FROM seed UNION SELECT a.target, d + 1 FROM f JOIN arcs a ON a.source = f.id WHERE d < 4),
x AS (SELECT id, min(d)::INTEGER AS causes FROM b GROUP BY id), y AS (SELECT id, min(d)::INTEGER AS effects FROM f GROUP BY id)
SELECT coalesce(x.id, y.id) AS id, causes, effects FROM x FULL JOIN y ON x.id = y.id""")
def causal_slice(edges):
    """Causes and effects of the first supplier up to four steps away."""
    arcs = _arcs(edges)
    return R.causal_slice(arcs, arcs.filter(F.col("source").contains("#S")).agg(F.min("source").alias("id")), 4)


@query("part", "SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_size, p_partkey)::INTEGER - 1 AS ordinal FROM part")
def final_ids(part):
    """Ordinals of parts of one name."""
    return R.collision_ordinals(part.select("p_partkey", "p_name", "p_size"), "p_name", [F.col("p_size"), F.col("p_partkey")]).drop("p_size")


@query("nodes occurrences", """SELECT 'node' AS what, kind, count(*)::BIGINT AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*)::BIGINT FROM occurrences GROUP BY kind UNION ALL SELECT 'resolution', resolution, count(*)::BIGINT FROM occurrences GROUP BY resolution""")
def extraction_stats(nodes, occurrences):
    return R.extraction_stats(nodes, occurrences)
