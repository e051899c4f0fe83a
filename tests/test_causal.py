"""Causal slices of small hand-made graphs; one search over separate components covers most cases."""

from codeloom.operators import causal

EDGE = "id string, source string, target string, kind string, resolution string, confidence double"
SITE = "id string, file string, line int, col int, end_line int, end_col int"


def sliced(spark, edges, seeds, sites=(), **bounds):
    rows = [(i, s, t, k, *(more or (None, None))) for i, s, t, k, *more in edges]
    e, nodes = spark.createDataFrame(rows, EDGE), spark.createDataFrame(sorted({(x,) for r in rows for x in r[1:3]}), "id string")
    return causal.causal_slice(nodes, e, spark.createDataFrame([(i, "flow.ts", *p) for i, *p in sites], SITE), spark.createDataFrame([(s,) for s in seeds], "id string"), **bounds)


def depths(found):
    return {r["id"]: (r["causes"], r["effects"]) for r in found.nodes.collect()}


CASES = [
    # a promise that is settled, returned and waited for
    ("p1", "ack", "ready", "resolvesPromise"), ("p2", "wait", "ready", "returnsPromise"), ("p3", "boot", "ready", "awaitsPromise"),
    # a channel beats setup callers
    ("c1", "sender", "chan", "sends"), ("c2", "chan", "handler", "handles"), ("c3", "setup1", "handler", "calls"), ("c4", "setup2", "handler", "calls"), ("c5", "handler", "done", "calls"),
    # only what begins behind the await follows from it
    ("w0", "b.ack", "b.ready", "resolvesPromise"), ("w1", "b.boot", "b.ready", "awaitsPromise"), ("before", "b.boot", "b.before", "calls"), ("operand", "b.boot", "b.operand", "calls"),
    ("after", "b.boot", "b.after", "calls"), ("nested", "b.after", "b.nested", "calls"), ("shared-before", "b.boot", "b.shared", "calls"), ("shared-after", "b.after", "b.shared", "calls"),
    # without the await's end nothing on its line is proven, and without places nothing at all
    ("n1", "n.boot", "n.ready", "awaitsPromise"), ("n2", "n.boot", "n.next", "calls"), ("m1", "m.boot", "m.ready", "awaitsPromise"), ("m2", "m.boot", "m.next", "calls"), ("m3", "m.boot", "m.lower", "calls"),
    # circles end; what isn't resolved counts only with a confidence
    ("r1", "ra", "rb", "calls"), ("r2", "rb", "ra", "calls"), ("u1", "ra", "ru", "calls", "unresolved", None), ("u2", "ra", "rv", "calls", "unresolved", 0.65), ("x1", "ra", "rx", "imports"),
]
SITES = [
    ("w1", 20, 2, 20, 24), ("before", 19, 2, 19, 14), ("operand", 20, 8, 20, 24), ("after", 20, 26, 20, 37), ("shared-before", 18, 2, 18, 14),
    ("n2", 30, None, None, None), ("m1", 5, 2, None, None), ("m2", 5, 40, 5, 50), ("m3", 6, None, None, None),
]


def test_states_aliases_gates_and_deliveries(spark):
    found = sliced(spark, CASES, ["wait", "done", "b.ready", "n.ready", "m.ready", "ra", "no node"], SITES)
    got = depths(found)
    assert {k: got[k] for k in ("ack", "ready", "wait", "boot")} == {"ack": (1, None), "ready": (0, 0), "wait": (0, 0), "boot": (None, 1)}
    assert {k: got[k] for k in ("handler", "chan", "sender")} == {"handler": (1, None), "chan": (2, None), "sender": (3, None)} and not {"setup1", "setup2"} & got.keys()
    assert {k: got[k][1] for k in got if k.startswith("b.")} == {"b.ack": None, "b.ready": 0, "b.boot": 1, "b.after": 2, "b.nested": 3, "b.shared": 3}
    assert {k for k in got if k[:2] in ("n.", "m.")} == {"n.ready", "n.boot", "m.ready", "m.boot", "m.lower"}
    assert got["ra"] == (0, 0) and got["rb"] == (1, 1) and got["rv"] == (None, 1) and not {"ru", "rx", "no node"} & got.keys()
    held = {r["id"]: r["kind"] for r in found.arcs.collect()}
    assert held == {"p1": "resolve", "p2": "alias", "p3": "await", "c1": "send", "c2": "handle", "c5": "call", "w0": "resolve", "w1": "await", "after": "call", "nested": "call", "shared-after": "call", "n1": "await", "m1": "await", "m3": "call", "r1": "call", "r2": "call", "u2": "call"}
    told = found.told.first()
    assert (told["confidence"], told["truncated"]) == (0.65, False) and found.frontier.count() == 0


CHAIN = [("ab", "a", "b", "calls"), ("bc", "b", "c", "calls"), ("cd", "c", "ready", "resolvesPromise"), ("out", "ready", "z", "calls")]


def test_bounds_are_told(spark):
    shallow = sliced(spark, CHAIN, ["ready"], max_depth=1)
    assert set(depths(shallow)) == {"c", "ready", "z"} and shallow.told.first()["truncated"] and {tuple(r) for r in shallow.frontier.collect()} == {("backward", "c")}
    few = sliced(spark, CHAIN, ["ready"], max_nodes=2)
    assert set(depths(few)) == {"c", "ready"} and {tuple(r) for r in few.frontier.collect()} == {("backward", "c"), ("forward", "ready")}
    assert sliced(spark, CHAIN, ["ready"], least=1.0).told.first()["confidence"] == 1.0


def test_no_seed(spark):
    none = sliced(spark, CHAIN, ["gone"])
    assert none.nodes.count() == none.arcs.count() == 0 and tuple(none.told.first()) == (1.0, False)
