"""Coverage maps by any kind of path, connectors of selections, and packing of groups."""

import json
import random

import pytest

from codeloom.functions import scalars
from codeloom.functions.materialize import Unsettled
from codeloom.operators import partition, review
from codeloom.operators.iterate import connectors
from codeloom.sources import artifacts

EDGE = "source string, target string, weight double"


def ways(spark, chosen, edges, levels=None, **kw):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = None if levels is None else frame(list(levels.items()), "id string, abstraction string")
    return {r["id"] for r in connectors(frame([(c,) for c in chosen], "id string"), frame([(s, t, 1.0, *w)[:2] + ((w or [1.0])[0],) for s, t, *w in edges], EDGE), nodes, **kw).collect()}


def test_paths_of_coverage_maps(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/B.ts",), ("a.ts",)], "file string")
    of = lambda paths, root=None: {(r["path"], r["file"]) for r in artifacts.coverage_files(spark.createDataFrame([(p,) for p in paths], "path string"), files, root).collect()}
    own = ["/work/src/a.ts", "src/./x/../a.ts", "C:\\work\\SRC\\b.ts", "/elsewhere/src/B.ts", "/elsewhere/src/b.ts", "/work/none.ts"]
    assert of(own, "/work") == {("/work/src/a.ts", "src/a.ts"), ("src/./x/../a.ts", "src/a.ts"), ("C:\\work\\SRC\\b.ts", "src/B.ts"), ("/elsewhere/src/B.ts", "src/B.ts")}
    with pytest.raises(Exception, match="several files"):
        of(["/other/src/a.ts"], "/work")
    with pytest.raises(Exception, match="escapes"):
        of(["../src/a.ts"])


def test_coverage_entries_that_contradict(spark, tmp_path):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "file string")
    entry = lambda path, f=None: {"path": path, "fnMap": {"0": {"name": "f"}}, "f": {"0": 1} if f is None else f, "branchMap": {}, "b": {}}
    for name, told, message in (
        ("two", {"/w/src/a.ts": entry("/w/src/a.ts"), "/v/src/a.ts": entry("/v/src/a.ts")}, "two coverage entries"), ("other", {"/w/src/a.ts": entry("/w/src/b.ts")}, "different files"),
        ("ids", {"/w/src/a.ts": entry("/w/src/a.ts", {"1": 1})}, "different ids"), ("count", {"/w/src/a.ts": entry("/w/src/a.ts", {"0": -1})}, "negative"),
    ):
        (tmp_path / f"{name}.json").write_text(json.dumps(told))
        with pytest.raises(Exception, match=message):
            artifacts.coverage(spark, f"{tmp_path}/{name}.json", files).collect()


def test_connectors(spark):
    assert ways(spark, ["api", "repo"], [("api", "services"), ("services", "repo")]) == {"services"}
    strands = [("services", "n")] * 2 + [("services", "p")] * 2 + [("n", "domain", 3.0), ("p", "domain", 3.0), ("index", "n"), ("index", "p")]
    assert ways(spark, ["n", "p"], strands) == {"services"}
    level = {"api": "pkg", "repo": "pkg", "method": "block", "far": "pkg"}
    assert ways(spark, ["api", "repo"], [("api", "method"), ("method", "repo")], level) == set()
    assert ways(spark, ["api", "method"], [("api", "far"), ("far", "method")], level) == ways(spark, ["api", "gone"], [("api", "far")], level) == set()
    chain = [(f"{k:02}", f"{k + 1:02}") for k in range(6)]
    assert len(ways(spark, ["00", "06"], chain)) == 5 and ways(spark, ["00", "06"], chain, max_depth=2) == set()
    with pytest.raises(Unsettled):
        ways(spark, ["00", "06"], chain, max_rounds=3)


def test_packing_of_groups(spark):
    """Five chains of eight groups of three: each chain fits one target, groups stay whole and none is over the bound."""
    groups = [(f"{c}.{k}.{j}", f"{c}.{k}") for c in range(5) for k in range(8) for j in range(3)]
    edges = [(f"{c}.{k}.0", f"{c}.{k + 1}.0", 1.0 + k) for c in range(5) for k in range(7)] + [("0.0.0", "1.0.0", 0.1)]
    out = partition.packed(spark.createDataFrame(groups, "id string, group string"), spark.createDataFrame(edges, "a string, b string, weight double"), 20).collect()
    sizes, torn = {}, {}
    for r in out:
        sizes[r["group"]] = sizes.get(r["group"], 0) + 1
        torn.setdefault(r["id"].rpartition(".")[0], set()).add(r["group"])
    assert len(out) == 120 and max(sizes.values()) <= 25 and all(len(g) == 1 for g in torn.values()) and len(sizes) <= 12


def _arguments(signature):
    """By one look at each character."""
    depth, commas, found = 0, 0, False
    for c in signature.partition("(")[2]:
        if c == ")" and not depth:
            break
        if c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth = max(0, depth - 1)
        elif c == "," and not depth:
            commas += 1
        elif not c.isspace():
            found = True
    return commas + 1 if found else 0


def test_arguments_of_signatures(spark):
    rng = random.Random(6)
    texts = ["f()", "f( )", "f(a)", "f(a, b: Map<x, y>)", "f(cb: (p, q) => void, x)", "f({a, b}, [c])", "f({})", "f(a, b < c, d)", "f(a, [b, c", "no brackets", "f(,)", "f(a, )\n: T<u, v>"]
    texts += ["f(" + "".join(rng.choice("ab ,()[]{}<>=") for _ in range(rng.randrange(16))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [(r[0], r[1]) for r in df.select("t", scalars.arity(df["t"])).collect()] == [(t, _arguments(t)) for t in texts]


def test_nested_values(spark):
    pairs = [
        (1, '{"a": 1, "b": {"c": [1, 2, {"d": "x"}], "e f": true}}', '{"b": {"e f": false, "c": [1, 3]}, "g": null, "a": 1}'), (2, '{"x": 1, "y": 2}', '{"y": 2, "x": 1}'),
        (3, '["1"]', "[1]"), (4, '{"a": []}', '{"a": {}}'), (5, "no json", '"text"'), (6, None, "null"), (7, "{}", '{"\\"": 1}'),
    ]
    df = spark.createDataFrame(pairs, "id int, before string, after string")
    got = {(r["id"], r["path"]): (r["state"], r["before"], r["after"]) for r in review.nested_changes(df, "id").collect()}
    assert got == {
        (1, "$.b.c[1]"): ("changed", "2", "3"), (1, "$.b.c[2]"): ("removed", '{"d":"x"}', None), (1, '$.b["e f"]'): ("changed", "true", "false"), (1, "$.g"): ("added", None, "null"),
        (3, "$[0]"): ("changed", '"1"', "1"), (4, "$.a"): ("changed", "[]", "{}"), (5, "$"): ("changed", "null", '"text"'), (7, '$["\\""]'): ("added", None, "1"),
    }
    flat = {(r["id"], r["path"]): r["state"] for r in review.nested_changes(df, "id", shallow=True).collect()}
    assert flat == {(1, "$.b"): "changed", (1, "$.g"): "added", (3, "$[0]"): "changed", (4, "$.a"): "changed", (5, "$"): "changed", (7, '$["\\""]'): "added"}
