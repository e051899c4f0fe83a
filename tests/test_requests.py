"""Timelines and occurrence graphs of small hand-made traces."""

from codeloom.operators import requests

SPAN = "trace string, span string, parent string, start long, stop long"
LINK = "trace string, span string, ord int, linked_trace string, linked_span string, relation string"
EVENT = "trace string, span string, event string, at long, label string, target_span string, mode string"


def test_timeline_rows(spark):
    """Children below callers; orphans and circles stay; linked work stands below its cause unless that closes a circle."""
    spans = spark.createDataFrame(
        [
            ("t", "root", None, 0, 1000), ("t", "b", "root", 500, 900), ("t", "a", "root", 100, 300), ("t", "leaf", "a", 150, 150), ("t", "orphan", "gone", 50, 60),
            ("t", "late", None, 400, 2000), ("t", "x", "y", 700, 800), ("t", "y", "x", 600, 800), ("t", "under", "x", 650, 660),
            ("u", "p", None, 10, 20), ("u", "q", None, 11, 20), ("u", "r", None, 12, 20), ("v", "s", "s", 5, 5),
        ],
        SPAN,
    )
    links = spark.createDataFrame(
        [("t", "late", 0, "other", "a", "async"), ("t", "late", 1, "t", "late", "async"), ("t", "late", 2, "t", "a", "message"), ("t", "b", 0, "t", "a", "async"), ("u", "p", 0, "u", "q", "async"), ("u", "q", 0, "u", "r", "async"), ("u", "r", 0, "u", "p", "detached")],
        LINK,
    )
    rows = requests.timeline_rows(spans, links).orderBy("trace", "row").collect()
    told = lambda t: [(r["span"], r["depth"], r["parent"], r["relation"]) for r in rows if r["trace"] == t]
    assert told("t") == [
        ("root", 0, None, None), ("a", 1, "root", None), ("leaf", 2, "a", None), ("late", 2, "a", "message"), ("b", 1, "root", None), ("orphan", 0, None, None),
        ("y", 0, None, None), ("x", 1, "y", None), ("under", 2, "x", None),
    ]
    # p and q take their links; that of r, the last, would close the circle
    assert told("u") == [("r", 0, None, None), ("q", 1, "r", "async"), ("p", 2, "q", "async")] and told("v") == [("s", 0, None, None)]
    by = {r["span"]: r for r in rows if r["trace"] == "t"}
    assert (by["a"]["offset"], by["a"]["duration"], by["a"]["at"], by["a"]["width"]) == (100, 200, 0.05, 0.1)
    assert (by["leaf"]["duration"], by["leaf"]["width"]) == (1, 0.002) and by["late"]["width"] == 0.8
    wider = requests.timeline_rows(spans, links, spark.createDataFrame([("t", -1000, 3000)], "trace string, start long, stop long"))
    assert wider.filter("span = 'a'").first()["at"] == 0.275
    assert requests.timeline_rows(spans.filter("false"), links).count() == 0


def graph(spark, spans, events=(), links=(), root="r"):
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    s = frame([("t", i, p, 0, 0) for i, p in spans], SPAN)
    found = requests.request_graph(s, frame([("t", *e) for e in events], EVENT), frame([("t", a, 0, t, b, r) for a, t, b, r in links], LINK), frame([("t", root)], "trace string, span string")).collect()
    out = {(r["source"], r["target"]): (r["relation"], r["label"]) for r in found}
    assert len(out) == len(found)
    return out


def test_siblings_fan_out_and_detached_work_joins(spark):
    got = graph(spark, [("r", None), ("a", "r"), ("b", "r"), ("w", None)], [("a", "e2", 9, "then", None, None), ("a", "e1", 5, None, "w", "detached")], [("w", "t", "b", "async"), ("w", "other", "a", "async"), ("b", "t", "r", "async")])
    assert got == {
        ("entry", "r"): ("trace-entry", None), ("r", "a"): ("parent-child", None), ("r", "b"): ("parent-child", None), ("a", "a:e1"): ("span-local-order", None), ("a:e1", "a:e2"): ("span-local-order", None),
        ("b", "w"): ("span-link", "async link"), ("a:e1", "w"): ("async-handoff", "detached handoff"), ("a:e2", "exit"): ("trace-exit", "then"), ("w", "exit"): ("trace-exit", None),
    }


def test_causes_that_close_circles_are_left_out(spark):
    """Against the call tree, and among causes: of three that go round the last one is refused, one that only hangs on the circle stays."""
    tree = [("r", None), ("a", "r"), ("b", "a"), ("p", None), ("q", None), ("s", "q"), ("z", None)]
    links = [("a", "t", "b", "async"), ("p", "t", "q", "async"), ("q", "t", "p", "async"), ("z", "t", "s", "async"), ("p", "t", "z", "message")]
    got = graph(spark, tree, [("b", "e", 1, None, "b", "callback"), ("s", "h", 1, None, "p", "awaited")], links)
    caused = {k for k, (relation, _) in got.items() if relation in ("span-link", "async-handoff")}
    # in the order of span and cause: a<-b closes on the tree, p<-q and p<-z stay, q<-p would go back, z<-s goes q, s, z, p and stays
    assert caused == {("q", "p"), ("z", "p"), ("s", "z"), ("s:h", "p")}
    assert got["entry", "q"] == ("trace-entry", None) and got["p", "exit"] == ("trace-exit", None)


def test_requests_without_spans(spark):
    assert graph(spark, []) == {("entry", "exit"): ("trace-exit", None)}
