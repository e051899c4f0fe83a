"""Joins whose result is a product of groups: each pair once, and no product in the plan where it isn't asked for."""

import random

from pyspark.sql import functions as F

from codeloom.functions.pairs import distinct_pairs
from codeloom.operators import changes, edges, relations
from codeloom.plans import review_queries


def _text(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_that_meet_more_than_once(spark):
    rng = random.Random(5)
    rows = lambda n: [(*key, rng.randrange(9)) for key in {(rng.randrange(25), rng.choice("xyz")) for _ in range(n)}]
    left, right = rows(60), rows(60)
    of = lambda rows, name: spark.createDataFrame(rows, f"{name} int, g string, {name}_at int")
    got = [tuple(r) for r in distinct_pairs(of(left, "a"), of(right, "b"), ["g"], "a", "b", F.col("a_at") > F.col("b_at"), 3).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(x, y) for x, g, p in left for y, h, q in right if g == h and p > q}


def test_pairs_of_a_channel_are_not_sorted_out(spark):
    """Owners with one channel each: their pairs go straight to the result, without an aggregation behind the join."""
    ports = spark.createDataFrame([(f"o{k}", "out" if k % 2 else "in", "http", f"/{k % 3}" if k % 5 else None) for k in range(60)] + [("o1", "in", "http", "/1"), ("o1", "out", "http", "/2")], "owner string, direction string, protocol string, channel string")
    found = edges.sender_handler_pairs(ports)
    assert not _text(found).startswith("Aggregate")
    known = [r for r in ports.collect() if r.channel is not None]
    want = {(a.owner, b.owner) for a in known for b in known if a.direction == "out" and b.direction == "in" and a.channel == b.channel and a.owner != b.owner}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_sites_compared_in_groups(spark):
    sites = [("c1", "f", 5, 1, None, None), ("c1", "g", 1, 1, None, None), ("c2", "f", 1, 1, None, None), ("b1", "f", 3, 1, 4, 2), ("b1", "f", 2, 1, None, 9), ("b2", "f", 5, 0, 5, 1), ("b3", "g", 0, 0, None, None)]
    sites = spark.createDataFrame(sites, "edge string, file string, line int, col int, end_line int, end_col int")
    candidates = spark.createDataFrame([("c1", "p"), ("c1", "q"), ("c2", "p")], "candidate string, group string")
    boundaries = spark.createDataFrame([("b1", "p"), ("b1", "q"), ("b2", "q"), ("b3", "p")], "boundary string, group string")
    pairs = candidates.join(boundaries, "group").select("candidate", "boundary")
    want = sorted(map(tuple, relations.occurs_after(pairs, sites).collect()))
    assert want == [("c1", "b1"), ("c1", "b2"), ("c1", "b3")]
    assert sorted(map(tuple, relations.occurs_after_in_groups(candidates, boundaries, sites).collect())) == want


def test_flows_that_share_their_calls(spark):
    nodes = spark.createDataFrame([("m1", "method", "x.ts", 1), ("m2", "method", "y.ts", 1), ("m3", "method", "x.ts", 9), *[(f"f{k}", "class", "z.ts", k) for k in range(4)]], "id string, kind string, file string, a int")
    uses = spark.createDataFrame([("f0", "p"), ("f1", "p"), ("f1", "q"), ("f2", "q"), ("f3", "r")], "flow string, via string")
    calls = spark.createDataFrame([("p", "m1"), ("q", "m1"), ("q", "m2"), ("r", "m3")], "via string, target string").withColumn("resolution", F.lit("resolved"))
    flows, affected = nodes.filter("kind = 'class'").select(F.col("id").alias("flow")), spark.createDataFrame([("m1",), ("m2",)], "id string")
    plain = changes.flow_impact(flows, uses.join(calls, "via").drop("via"), nodes, affected).collect()
    assert [(r.flow, r.files_hit) for r in plain] == [("f0", ["x.ts"]), ("f1", ["x.ts", "y.ts"]), ("f2", ["x.ts", "y.ts"])]
    assert changes.flow_impact(flows, calls, nodes, affected, uses=uses).collect() == plain


def test_makers_meet_their_places_last(spark):
    """Constructors are found for the edges of a place, which are as many as its classes; the makers multiply them behind that."""
    nodes = [("f1", "function", "m", "f"), ("g1", "function", "m", "g"), ("f2", "function", "m", "f"), ("c1", "class", "m", "c"), ("c2", "class", "m", "c"), ("d2", "class", "m", "d"), ("c2.3", "method", "c2", "x"), ("c2.7", "method", "c2", "x"), ("c2.8", "method", "c2", "x")]
    nodes = spark.createDataFrame(nodes, "id string, kind string, parent_id string, display_name string")
    made = [("calls", "f1", "c1"), ("calls", "g1", "c1"), ("instantiates", "f2", "c2"), ("instantiates", "f2", "d2")]
    for query, extra in ((review_queries.expand_instantiations, {("instantiates", "f2", "c2.3"), ("instantiates", "f2", "c2.7")}), (review_queries.block_deps, {("instantiates", "f2", "c2.3")})):
        found = query(nodes)
        want = set(made) | extra if query is review_queries.expand_instantiations else {e for e in made if e[2] != "c2"} | extra
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(want) and set(rows) == want
        assert _text(found).split("\n")[1].startswith("+- Join Inner")
