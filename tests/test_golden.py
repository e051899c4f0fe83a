"""Hand-made graphs with known answers."""

import json
import time

import pytest
from pyspark.sql import functions as F

from codeloom.functions import scalars
from codeloom.functions.materialize import Unsettled
from codeloom.operators import changes, cluster, edges, flows, link, merge, metrics, reach, relations, review, search, similarity, telemetry, tree
from codeloom.operators.iterate import bfs, components
from codeloom.sources import artifacts, python_code


@pytest.fixture(scope="module")
def shop(spark):
    """Module and class with two methods, callables around them, and one test, one of whose calls isn't resolved."""
    nodes = [
        ("m", "module", None), ("m#Svc", "class", "m"), ("place", "method", "m#Svc"), ("cancel", "method", "m#Svc"), ("save", "function", None),
        ("handle", "function", None), ("send", "function", None), ("dead", "function", None), ("t1", "function", None),
    ]
    calls = [("t1", "place", "resolved"), ("place", "save", None), ("handle", "place", "resolved"), ("handle", "send", "resolved"), ("t1", "dead", "unresolved")]
    n = spark.createDataFrame([(i, k, i, p, i == "t1") for i, k, p in nodes], "id string, kind string, display_name string, parent_id string, is_test boolean")
    return n, spark.createDataFrame([("calls", *c) for c in calls], "kind string, source string, target string, resolution string")


def test_reachability(shop):
    leaves = reach.leaf_coverage(*shop)
    got = {r["id"]: (r["status"], r["distance"], r["reason"], r["callers"]) for r in leaves.collect()}
    assert got == {
        "place": ("covered", 1, None, ["t1"]), "save": ("indirect", 2, None, []), "send": ("uncovered", -1, "only-uncovered-callers", ["handle"]), "dead": ("uncovered", -1, "never-called", []),
        "handle": ("uncovered", -1, "never-called", []), "cancel": ("uncovered", -1, "never-called", []),
    }
    assert {r["id"]: (r["covered"], r["total"], r["percent"], r["status"]) for r in reach.container_coverage(shop[0], leaves).collect()} == {"m": (1, 2, 50, "partial"), "m#Svc": (1, 2, 50, "partial")}
    assert tuple(reach.coverage_summary(*shop, leaves).first()) == (6, 1, 1, 4, 33, 1, 1)


def test_constructors_are_reached_by_instantiation(spark):
    n = spark.createDataFrame(
        [("m", "module", "m", None, False), ("C", "class", "C", "m", False), ("C.c", "method", "constructor", "C", False), ("D", "class", "D", "m", False), ("t", "function", "t", None, True)],
        "id string, kind string, display_name string, parent_id string, is_test boolean",
    )
    e = spark.createDataFrame([("instantiates", "t", "C")], "kind string, source string, target string")
    assert {r["id"]: r["status"] for r in reach.leaf_coverage(n, e).collect()} == {"C.c": "covered"}
    n = n.unionByName(spark.createDataFrame([("D.x", "field", "x", "D", False)], n.schema))
    assert {r["id"]: r["status"] for r in reach.container_coverage(n, reach.leaf_coverage(n, e)).collect()} == {"m": "covered", "C": "covered", "D": "no-callables"}


def test_parent_cycles_end(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "gone"), ("d", "d"), ("e", "a"), ("f", "e")], "id string, parent_id string")
    got = {}
    for r in tree.ancestors(nodes).collect():
        got.setdefault(r["id"], {})[r["anc_id"]] = r["depth"]
    assert got == {"a": {"a": 0, "b": 1}, "b": {"b": 0, "a": 1}, "c": {"c": 0}, "d": {"d": 0}, "e": {"e": 0, "a": 1, "b": 2}, "f": {"f": 0, "e": 1, "a": 2, "b": 3}}
    deep = spark.createDataFrame([(f"{k:03}", f"{k - 1:03}" if k else None) for k in range(22)], "id string, parent_id string")
    assert tree.ancestors(deep).count() == 22 * 23 // 2
    with pytest.raises(Unsettled):
        tree.ancestors(deep, max_depth=9)


def test_bounds_raise(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(9)], "source long, target long")
    start = spark.createDataFrame([(0,)], "id long")
    assert bfs(start, chain).count() == 10 and bfs(start, chain, max_depth=4).count() == 5
    with pytest.raises(Unsettled):
        bfs(start, chain, max_rounds=4)
    with pytest.raises(Unsettled):
        components(chain.select(chain["source"].alias("id")), chain, max_rounds=1)
    with pytest.raises(Unsettled):
        cluster.owned(start, chain, max_depth=3)


def test_groups_never_hold_more_than_they_may(spark):
    import itertools

    e = spark.createDataFrame([(f"{a:02}", f"{b:02}", 1.0) for a, b in itertools.combinations(range(30), 2)], "a string, b string, weight double")
    ids = spark.createDataFrame([(f"{a:02}",) for a in range(30)], "id string")
    sizes = [r["count"] for r in cluster.local_moves(ids, e, cluster.potts_gain(0.1), most=5).groupBy("group").count().collect()]
    assert max(sizes) == 5 and sum(sizes) == 30


def test_blocks_touched_on_their_own_lines(spark):
    """A container is touched only beside its children, adjacent children leave nothing between them, and a module stands in for what no block shows."""
    nodes = [
        ("ts:a", "module", None, "a", 1, 40), ("ts:a#K", "class", "ts:a", "a", 1, 20), ("ts:a#K.f", "method", "ts:a#K", "a", 1, 5), ("ts:a#K.g", "method", "ts:a#K", "a", 6, 10), ("ts:a#K.h", "method", "ts:a#K", "a", 15, None),
        ("ts:b", "module", None, "b", 1, 9), ("ts:b#f", "function", "ts:b", "b", 5, 9), ("ts:c", "module", None, "c", 1, 9), ("ts:d", "module", None, "d", 1, 9), ("ts:d#f", "function", "ts:d", "d", 1, 9),
    ]
    n = spark.createDataFrame(nodes, "id string, kind string, parent_id string, file string, a int, b int")
    files = spark.createDataFrame([("a", "modified", True), ("b", "added", True), ("c", "renamed", False)], "file string, status string, has_hunks boolean")
    hunks = lambda *h: spark.createDataFrame(list(h), "file string, a int, b int")
    got = lambda *h: [(r["id"], r["by_hunk"]) for r in changes.affected_nodes(n, files, hunks(*h)).collect()]
    assert got(("a", 4, 7), ("b", 1, 2)) == [("ts:a#K.f", True), ("ts:a#K.g", True), ("ts:b", False), ("ts:c", False)]
    assert got(("a", 10, 11), ("b", 9, 9)) == [("ts:a#K", True), ("ts:a#K.g", True), ("ts:b#f", True), ("ts:c", False)]
    assert got(("a", 15, 15), ("a", 30, 30), ("b", 4, 4)) == [("ts:a#K.h", True), ("ts:b", False), ("ts:c", False)]
    tags = {r["id"] for r in changes.changed_tags(n, hunks(("a", 30, 30), ("b", 9, 9))).collect() if r["is_changed"]}
    assert tags == {"ts:a", "ts:b#f"}


def test_long_intervals_meet_short_ones(spark):
    import random

    rng = random.Random(2)
    spans = lambda n: [(k % 3, a, a + rng.choice([0, 3, 90, 2000, 10**6])) for k in range(n) for a in [rng.randrange(10**5)]]
    left, right = spans(60), spans(60)
    df = lambda rows: spark.createDataFrame([(f"f{k}", a, b) for k, a, b in rows], "file string, a long, b long")
    got = sorted((r["file"], r["a"], r["b"], r["r_a"], r["r_b"]) for r in changes.overlaps(df(left), df(right), "file").collect())
    assert got == sorted((f"f{k}", a, b, c, d) for k, a, b in left for m, c, d in right if k == m and a <= d and c <= b)


def test_files_end_in_the_paths_of_modules(spark):
    modules = spark.createDataFrame([("1", "src/a.ts"), ("2", "a.ts"), ("3", "x/b.ts"), ("4", "x/b.ts"), ("5", "./c.ts")], "id string, module string")
    files = spark.createDataFrame([("repo/src/a.ts",), ("lib/a.ts",), ("x/b.ts",), ("c.ts",), ("ba.ts",)], "file string")
    got = {r["file"]: (r["status"], r["module"]) for r in changes.suffix_match(files, modules).collect()}
    assert got == {"repo/src/a.ts": ("matched", "1"), "lib/a.ts": ("matched", "2"), "x/b.ts": ("ambiguous", None), "c.ts": ("matched", "5"), "ba.ts": ("unmatched", None)}


def test_metrics_of_small_graphs(spark):
    units = spark.createDataFrame([("a", "module"), ("b", "module"), ("C", "class"), ("I", "interface")], "id string, kind string")
    pairs = spark.createDataFrame([("calls", "a", "b", 1)], "kind string, source string, target string, weight int")
    members = spark.createDataFrame([("a.f", "a", False), ("b.g", "b", False), *[(f"C.m{k}", "C", k == 1) for k in range(1, 5)]], "id string, unit string, is_abstract boolean")
    calls = spark.createDataFrame([("C.m1", "C.m2"), ("C.m3", "C.m4")], "source string, target string")
    got = {r["id"]: r for r in metrics.unit_metrics(units, pairs, members, calls).collect()}
    assert (got["a"]["instability"], got["a"]["distance"], got["b"]["instability"], got["b"]["distance"]) == (1.0, 0.0, 0.0, 1.0)
    assert (got["C"]["components"], got["C"]["cohesion"], got["C"]["abstractness"], got["C"]["smells"]) == (2, 0.67, 0.25, "") and got["I"]["abstractness"] == 1.0
    assert metrics.refactor_rank(metrics.unit_metrics(units, pairs, members, calls)).count() == 4
    n = spark.createDataFrame([("m", "module", None), ("m#C", "class", "m"), ("m#C.f", "method", "m#C"), ("m#g", "function", "m"), ("p", "package", None)], "id string, kind string, parent_id string")
    e = spark.createDataFrame([("calls", "m#g", "m#C.f"), ("calls", "m#C.f", "m#C.f"), ("calls", "m#g", "ext:npm/x"), ("calls", "m#g", "gone")], "kind string, source string, target string")
    placed = metrics.unit_of(n, tree.ancestors(n))
    assert {tuple(r) for r in metrics.members_of(n, placed).collect()} == {("m#C.f", "m#C"), ("m#g", "m")}
    across, inner, out = metrics.between_units(e, placed, n)
    assert [tuple(r) for r in across.collect()] == [("calls", "m", "m#C", 1)] and inner.count() == 1 and {r["target"] for r in out.collect()} == {"ext:npm/x", "gone"}


def test_labels_of_change_groups(spark):
    rows = [("g1", "src/a/x.ts"), ("g1", "src/a/y.ts"), ("g2", "src/b/z.ts"), ("g3", "src/c/q.ts"), ("g3", "src/d/q.ts"), ("g3", "src/r.ts")]
    got = {r["group"]: (r["label"], r["n_files"]) for r in changes.group_labels(spark.createDataFrame(rows, "`group` string, file string")).collect()}
    assert got == {"g1": ("src/a", 2), "g2": ("z.ts", 1), "g3": ("c+d+r.ts", 3)}


def test_hash_of_names_beyond_ascii(spark):
    def plain(text):
        h = 2166136261
        raw = text.encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2], "big")) * 16777619) % 2**32
        return f"{h:08x}"

    names = ["abc", "größe", "東京", "a😀", ""]
    df = spark.createDataFrame([(x,) for x in names], "x string")
    assert [r[0] for r in df.select(scalars.fnv1a(df["x"])).collect()] == [plain(x) for x in names]


def test_signatures(spark):
    rows = [("f", "f(a: string, b?: number = 12.5): void", "method(arg:string,arg?:number=number):void", 2), ("g", "g()", "method()", 0), ("h", "h(x: Map<a, b>, {c, d}: T)", "method(arg:map<a,b>,{c,d}:t)", 2), ("k", "", "", 0)]
    df = spark.createDataFrame([(n, s) for n, s, *_ in rows], "n string, s string")
    got = df.select(scalars.signature_shape(df["s"], df["n"]), scalars.arity(df["s"])).collect()
    assert [tuple(r) for r in got] == [(shape, k) for *_, shape, k in rows]


def test_comments_of_sources(spark):
    script = "a // b\n/* c\n d */ e\nx = '// no'\n"
    python = "# a\nx = '#' # b\ny = \"\"\"\n# in a text\n\"\"\""
    df = spark.createDataFrame([(script, python)], "s string, p string")
    got = df.select(scalars.comment_lines(df["s"]), scalars.comment_lines(df["p"], python=True)).first()
    assert [tuple(x) for x in got[0]] == [("a ", True), ("", True), (" e", True), ("x = '// no'", False), ("", False)]
    assert [tuple(x) for x in got[1]] == [("", True), ("x = '#' ", True), ('y = """', False), ("# in a text", False), ('"""', False)]


def test_class_orders(spark):
    classes = spark.createDataFrame([(x, x != "Bad") for x in ("O", "A", "B", "C", "X", "Y", "Z", "Bad", "Sub", "L1", "L2")], "id string, complete boolean")
    given = {"A": "O", "B": "O", "C": "AB", "X": "AB", "Y": "BA", "Z": "XY", "L1": ["L2"], "L2": ["L1"], "Sub": ["Bad"]}
    bases = spark.createDataFrame([(i, b, k) for i, bs in given.items() for k, b in enumerate(bs)], "id string, base string, ord int")
    got = {r["id"]: r["mro"] for r in relations.linearisations(classes, bases).collect()}
    assert got == {"O": ["O"], "A": ["A", "O"], "B": ["B", "O"], "C": list("CABO"), "X": list("XABO"), "Y": list("YBAO"), "Z": None, "Bad": None, "Sub": None, "L1": None, "L2": None}


def test_two_linked_systems(spark):
    """Ids are set apart under a root for each system; a call takes the one template of its method; what nobody calls dangles."""
    nodes = spark.createDataFrame(
        [("web", "ts:app", "module", None, "app.ts", 0), ("web", "ts:app#load", "function", "ts:app", "app.ts", 1), ("api", "ts:app", "module", None, "app.ts", 0), ("api", "ext:npm/x", "external", None, "x", 1)],
        "system string, id string, kind string, parent_id string, file string, ord int",
    )
    got = {r["id"]: (r["parent_id"], r["file"]) for r in link.linked_nodes(nodes).collect()}
    assert got == {"sys:web": (None, "web"), "sys:api": (None, "api"), "ts:web/app": ("sys:web", "web/app.ts"), "ts:web/app#load": ("ts:web/app", "web/app.ts"), "ts:api/app": ("sys:api", "api/app.ts"), "ext:npm/x": (None, "x")}
    rows = [("web", "ts:app#load", "out", "GET /api/orders/123"), ("api", "ts:app", "in", "GET /api/orders/:id"), ("api", "ts:app", "in", "DELETE /api/orders/:id")]
    schema = "system string, owner string, handler string, direction string, protocol string, channel string, lane string, scope string, scope_kind string, confidence double"
    ports = link.linked_ports(spark.createDataFrame([(s, o, None, d, "http", c, None, None, None, 1.0) for s, o, d, c in rows], schema))
    joined = link.unified_http(ports)
    assert {r["channel"] for r in joined.filter("direction = 'out'").collect()} == {"GET /api/orders/:id"}
    stats = link.joint_stats(joined).first()
    assert (stats["systems"], stats["template_joins"], stats["channels"], stats["cross_system"], stats["dangling"]) == (2, 1, 2, 1, 1)
    wires = link.channel_graph(joined, link.linked_nodes(nodes), spark.createDataFrame([], "id string"))
    assert {(r["kind"], r["source"].split("/channel")[0]) for r in wires.collect()} == {("sends", "ts:web/app#load"), ("handles", "ipc:http")}


def test_route_ties_match_nothing(spark):
    calls = spark.createDataFrame([("GET /en/25",), ("GET /en/7",), ("/fr/7",), ("DELETE /fr/7",)], "channel string")
    routes = spark.createDataFrame([("GET /en/:id",), ("GET /:lang/25",), ("GET /:lang/:id",)], "channel string")
    assert {tuple(r) for r in edges.match_routes(calls, routes).collect()} == {("GET /en/7", "GET /en/:id"), ("/fr/7", "GET /:lang/:id")}


def test_merge_rules_differ(spark):
    occ = spark.createDataFrame(
        [("calls", "a", "b", "unresolved", 0.2, "f", 1, 1, "1"), ("calls", "a", "b", "resolved", 0.9, "f", 2, 1, "2"), ("calls", "a", "ext:x", "resolved", 1.0, "f", 3, 1, "3")],
        "kind string, source string, target string, resolution string, confidence double, file string, line int, col int, ord string",
    )
    both = {r["target"]: r for r in edges.aggregate(occ).collect()}
    assert (both["b"]["weight"], both["b"]["resolution"], both["b"]["confidence"]) == (2, "resolved", 0.9) and [s["line"] for s in both["b"]["call_sites"]] == [1, 2]
    first = {r["target"]: r["resolution"] for r in edges.aggregate_first(occ).collect()}
    assert first == {"b": "unresolved"}


def test_cohesion_of_two_clusters(spark):
    members = spark.createDataFrame([(x, "u") for x in "abcd"], "id string, unit string")
    calls = spark.createDataFrame([("a", "b"), ("c", "d")], "source string, target string")
    assert [(r["members"], r["components"]) for r in metrics.lcom4(members, calls).collect()] == [(4, 2)]


def test_groups_do_not_merge_through_an_unchanged_neighbour(spark):
    graph = spark.createDataFrame([("calls", "a", "n"), ("calls", "b", "n"), ("calls", "b", "c")], "kind string, source string, target string")
    changed = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert {r["id"]: r["group"] for r in changes.change_groups(changed, graph).collect()} == {"a": "a", "b": "b", "c": "b"}


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(f"{k:03}", f"{k + 1:03}") for k in range(120)], "source string, target string")
    ids = spark.createDataFrame([(f"{k:03}",) for k in range(122)], "id string")
    roots = {r["root"] for r in components(ids, chain).collect()}
    assert roots == {"000", "121"}


def test_estimates_of_components_do_not_pile_up(spark):
    """Names in no order on a chain take some twenty rounds; the planner's guess of the rows once doubled its digits in each."""
    name = lambda k: F.md5(k.cast("string"))
    links = spark.range(1_000).select(name(F.col("id")).alias("source"), name(F.col("id") + 1).alias("target"))
    found = components(links.select(F.col("source").alias("id")).union(links.select("target")).distinct(), links)
    assert len(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 12
    assert [tuple(r) for r in found.groupBy("root").count().collect()] == [(min(r.source for r in links.collect()), 1_001)]


def test_prefix_filter_loses_no_pair(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    counts = {(int(i), f"t{int(t)}"): int(rng.integers(1, 5)) for i, t in zip(rng.integers(0, 60, 900), rng.zipf(1.5, 900) % 40)}
    df = spark.createDataFrame([(i, t, n) for (i, t), n in counts.items()], "id long, term string, n long")
    vectors = {}
    for r in similarity.tf_idf(df).collect():
        vectors.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) >= 0.6}
    assert {(r["a"], r["b"]) for r in similarity.cosine_pairs(similarity.tf_idf(df), 0.6).collect()} == want and want
    total = {i: sum(n for (k, _), n in counts.items() if k == i) for i in vectors}
    low = lambda a, b: sum(min(n, counts.get((b, t), 0)) for (k, t), n in counts.items() if k == a)
    want = {(a, b) for a in vectors for b in vectors if a < b and low(a, b) / (total[a] + total[b] - low(a, b)) >= 0.3}
    weighed = df.selectExpr("id", "term", "CAST(n AS DOUBLE) AS weight")
    assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(weighed, 0.3).collect()} == want and want


def test_local_moves_find_two_cliques(spark):
    pairs = [(a, b, 1.0) for g in ("abcd", "wxyz") for k, a in enumerate(g) for b in g[k + 1 :]] + [("d", "w", 0.1)]
    e = spark.createDataFrame(pairs, "a string, b string, weight double")
    ids = spark.createDataFrame([(x,) for x in "abcdwxyz"], "id string")
    groups = cluster.local_moves(ids, e, cluster.potts_gain(0.2))
    found = {}
    for r in groups.collect():
        found.setdefault(r["group"], set()).add(r["id"])
    assert sorted(map(sorted, found.values())) == [list("abcd"), list("wxyz")]
    single = ids.selectExpr("id", "id AS `group`")
    assert cluster.qualities(e, groups, 0.2).first()["cpm"] > cluster.qualities(e, single, 0.2).first()["cpm"]


def test_patch_numbers(spark):
    patch = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -3,3 +3,4 @@ def f\n keep\n-old\n+new\n+more\n tail\n\\ No newline at end of file\n@@ -20 +21,0 @@\n-gone"
    rows = review.patch_lines(spark.createDataFrame([("x", patch)], "path string, patch string")).orderBy("pos").collect()
    assert [(r["kind"], r["old_line"], r["new_line"], r["text"]) for r in rows] == [
        ("context", 3, 3, "keep"), ("deleted", 4, None, "old"), ("added", None, 4, "new"), ("added", None, 5, "more"), ("context", 5, 6, "tail"), ("deleted", 20, None, "gone"),
    ]


def test_renamed_entries_of_a_manifest(spark):
    body = "M\x00a.py\x00R100\x00old.py\x00new.py\x00D\x00M\x00A\x00b.py\x00"  # a file may be called M
    rows = review.name_status(spark.createDataFrame([(body,)], "body string")).collect()
    assert {tuple(r) for r in rows} == {("a.py", "modified", None), ("new.py", "renamed", "old.py"), ("M", "deleted", None), ("b.py", "added", None)}


def test_a_long_manifest_costs_its_length(spark):
    """Paths that look like a status, an entry that is cut off, and so many that a list written anew for each would take minutes."""
    many = [("A", f"a{k}") if k % 2 else ("R087", f"o{k}", f"n{k}") for k in range(20_000)]
    body = "\0".join(["M", "A", "R100", "R1", "D", "\0T", "T", *[x for row in many for x in row], "R50", "lost"])
    began = time.monotonic()
    rows = review.name_status(spark.createDataFrame([(body,), ("",), (None,)], "body string")).collect()
    assert time.monotonic() - began < 30
    assert [tuple(r) for r in rows[:3]] == [("A", "modified", None), ("D", "renamed", "R1"), ("T", "modified", None)]
    assert [tuple(r) for r in rows[3:]] == [(x[-1], "added" if x[0] == "A" else "renamed", None if x[0] == "A" else x[1]) for x in many]


def test_imports_through_reexports(spark):
    pending = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "c", "x"), (4, "zz", "x")], "id long, subpath string, name string")
    files = spark.createDataFrame([("a.ts",), ("a/index.ts",), ("b.ts",), ("c/index.ts",)], "file string")
    exports = spark.createDataFrame([("b.ts", "x")], "file string, name string")
    passed = spark.createDataFrame([("a.ts", "x", "b.ts"), ("a.ts", "y", "c/index.ts"), ("c/index.ts", "y", "a.ts"), ("c/index.ts", "x", "a.ts")], "file string, name string, from_file string")
    found = flows.resolved_imports(pending, files, exports, passed)
    assert {tuple(r) for r in found.collect()} == {(1, "b.ts", "x"), (3, "b.ts", "x")}


def test_control_flow_of_a_branch(spark):
    steps = spark.createDataFrame(
        [("f", "1", None, 0, 1, "call"), ("f", "2", None, 0, 2, "branch"), ("f", "2.1", "2", 1, 1, "exit"), ("f", "2.2", "2", 1, 2, "call"), ("f", "3", None, 0, 3, "call")],
        "flow string, path string, parent string, depth int, ord int, kind string",
    )
    assert {tuple(r)[1:] for r in flows.control_edges(steps).collect()} == {("1", "2", "next"), ("2", "3", "next"), ("2", "2.1", "enter")}
    assert [r["path"] for r in flows.dead_steps(steps).collect()] == ["2.2"]


def test_slices_that_disagree_fail(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, v int")
    b = spark.createDataFrame([("y", 2), ("z", 3)], "id string, v int")
    assert merge.merge([a, b]).count() == 3
    with pytest.raises(Exception, match="disagree"):
        merge.merge([a, b.replace(2, 9)]).collect()
    assert [r["id"] for r in merge.conflicts([a, b.replace(2, 9)]).collect()] == ["y"]


def test_search_order_and_threads(spark):
    rows = spark.createDataFrame([("m#a", "parse", "function", 0, False), ("m#b", "Parser", "class", 2, False), ("m#c", "other", "function", 1, True)], "id string, display_name string, kind string, steps long, is_private boolean")
    assert [r["id"] for r in search.ranked(rows, "PARS").collect()] == ["m#b", "m#a"] and [r["id"] for r in search.ranked(rows, "").collect()] == ["m#b", "m#c"]
    talk = spark.createDataFrame([(1, None, "Ann"), (2, 1, "bob"), (3, None, "bob"), (4, 9, "Cy")], "id long, reply_to long, author string")
    assert {r["id"] for r in search.comments_of(talk, "ANN", True).collect()} == {1, 2} and {r["id"] for r in search.comments_of(talk, "Bob", False).collect()} == {2, 3}


def test_observed_edges(spark):
    pairs = spark.createDataFrame([("a", "b", 2), ("a", "c", 1), ("a", "d", 1), ("a", "e", 1)], "source string, target string, n long")
    known = spark.createDataFrame([("a", "b", "calls"), ("a", "c", "calls"), ("a", "c", "calls"), ("a", "d", "instantiates")], "source string, target string, kind string")
    assert {r["target"]: r["state"] for r in telemetry.match_edges(pairs, known).collect()} == {"b": "observed", "c": "ambiguous", "d": "observed", "e": "runtime-only"}


def test_handlers_beat_other_causes(spark):
    e = spark.createDataFrame([("calls", "a", "x"), ("handles", "x", "h"), ("calls", "b", "c")], "kind string, source string, target string")
    assert {tuple(r) for r in relations.causal_arcs(e).collect()} == {("handles", "h", "x"), ("calls", "b", "c")}


def test_artifact_round_trip(spark, tmp_path):
    doc = {
        "schemaVersion": "1.1.0", "generatedAt": "2026-01-01T00:00:00Z", "generator": {"name": "g", "version": "1"}, "target": {"name": "t", "root": ".", "language": "py"},
        "nodes": [{"id": "py:a", "kind": "module", "qualifiedName": "a", "displayName": "a", "location": {"file": "a.py", "startLine": 1}}, {"id": "py:a#f", "kind": "function", "qualifiedName": "f", "displayName": "f", "parentId": "py:a", "summary": "does", "location": {"file": "a.py", "startLine": 2}}],
        "edges": [{"id": "calls@py:a|py:a#f", "source": "py:a", "target": "py:a#f", "kind": "calls", "weight": 1, "callSites": [{"file": "a.py", "line": 3}]}],
    }
    (tmp_path / "one.json").write_text(json.dumps(doc))
    docs = artifacts.artifacts(spark, f"{tmp_path}/one.json")
    n, e = artifacts.nodes(docs), artifacts.edges(docs)
    assert [r["id"] for r in n.orderBy("ord").collect()] == ["py:a", "py:a#f"] and e.first()["callSites"][0]["line"] == 3
    manifest = artifacts.write_snapshot(n, e, f"{tmp_path}/store", "s1").collect()
    assert {(r["table"], r["rows"]) for r in manifest} == {("nodes", 2), ("edges", 1)}
    again = artifacts.read_snapshot(spark, f"{tmp_path}/store", "s1")
    n.limit(1).write.mode("overwrite").parquet(f"{tmp_path}/store/nodes/snapshot=s2")
    e.write.parquet(f"{tmp_path}/store/edges/snapshot=s2")
    spark.read.parquet(f"{tmp_path}/store/manifest/snapshot=s1").write.parquet(f"{tmp_path}/store/manifest/snapshot=s2")
    with pytest.raises(ValueError, match="differ from its manifest"):
        artifacts.read_snapshot(spark, f"{tmp_path}/store", "s2")
    assert again[0].count() == 2 and ("summary", "present", 1) in {tuple(r) for r in artifacts.report(*again).collect()}


def test_coverage_map(spark, tmp_path):
    entry = {"path": "/w/src/a.ts", "fnMap": {"0": {"name": "f", "decl": {"start": {"line": 1, "column": 0}, "end": {"line": 1, "column": 5}}}}, "f": {"0": 3}, "branchMap": {"0": {"type": "if", "line": 2}}, "b": {"0": [1, 0]}}
    (tmp_path / "c.json").write_text(json.dumps({"/w/src/a.ts": entry, "/w/src/other.ts": entry | {"path": "/w/src/other.ts"}}))
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "file string")
    assert {tuple(r) for r in artifacts.coverage(spark, f"{tmp_path}/c.json", files).collect()} == {("src/a.ts", "function", "f", 3), ("src/a.ts", "branch", "0.0", 1), ("src/a.ts", "branch", "0.1", 0)}


def test_overlay_of_another_environment_fails(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"env": "prod", "metrics": {"a": {"callCount": 5, "errorRate": 0.5, "latencyMs": {"p50": 1, "p95": 2, "p99": 3}, "sampleCount": 5}}}))
    assert artifacts.overlay(spark, f"{tmp_path}/o.json", "prod").first()["callCount"] == 5
    with pytest.raises(Exception, match="another environment"):
        artifacts.overlay(spark, f"{tmp_path}/o.json", "test").collect()


def test_python_source(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("")
    (tmp_path / "pkg/store.py").write_text("class Store:\n    def save(self, x):\n        return check(x)\n\ndef check(x):\n    return unknown(x)\n")
    (tmp_path / "pkg/app.py").write_text("from pkg.store import Store\n\ndef main():\n    Store().save(1)\n")
    (tmp_path / "pkg/bad.py").write_text("def (:\n")
    rows = python_code.parse(spark, str(tmp_path))
    assert {r["id"] for r in rows.filter("what = 'node'").collect()} >= {"py:pkg", "py:pkg/store#Store", "py:pkg/store#Store.save", "py:pkg/store#check", "py:pkg/app#main", "py:pkg/bad"}
    assert rows.filter("what = 'diagnostic'").count() == 1
    found = {(r["kind"], r["source"], r["target"]) for r in python_code.resolved(rows).collect()}
    assert {
        ("instantiates", "py:pkg/app#main", "py:pkg/store#Store"), ("calls", "py:pkg/app#main", "py:pkg/store#Store.save"), ("calls", "py:pkg/store#Store.save", "py:pkg/store#check"),
        ("calls", "py:pkg/store#check", "unresolved:py/?"),
    } <= found


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["id", "covered", "total", "percent", "status"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
