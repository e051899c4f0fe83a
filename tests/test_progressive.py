"""Slices in any order and any split of micro-batches give one graph."""

import random

import pytest

from codeloom.streaming import progressive
from codeloom.streaming.sinks import drained

SCHEMA = "graph string, generation long, what string, id string, payload string, depth int, has_more boolean"


def _slices():
    rng, rows = random.Random(4), []
    for graph in "ab":
        for generation in (1, 2) if graph == "a" else (3,):
            for k in range(30):
                what = rng.choice(["node", "edge", "file", "frontier", "root", "ready"])
                rows.append((graph, generation, what, f"{what}{k % 7}", f"{graph}{what}{k % 7}", rng.randrange(4), rng.random() < 0.6))
    return rows


def _as_set(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_and_split(spark, tmp_path, seed):
    rows, rng = _slices(), random.Random(seed)
    want = _as_set(progressive.newest(progressive.merged(spark.createDataFrame(rows, SCHEMA))))
    assert {(r[0], r[1]) for r in want} == {("a", 2), ("b", 3)}
    rng.shuffle(rows)
    parts = [rows[k::4] for k in range(4)] + [rows[:11]]  # some slices come twice
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/slices/{k}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/slices")
    assert _as_set(progressive.newest(drained(progressive.merged(stream), "update", progressive.KEYS))) == want


def test_frontiers_and_readiness(spark):
    rows = [
        ("g", 7, "frontier", "x", None, 1, True), ("g", 7, "frontier", "x", None, 2, True), ("g", 7, "frontier", "x", None, 2, False), ("g", 7, "frontier", "y", None, 1, True),
        ("g", 7, "root", "x", None, 2, False), ("g", 7, "ready", "x", None, 0, False), ("g", 7, "node", "n", "same", 0, False), ("g", 7, "node", "n", "same", 0, False),
        ("g", 6, "node", "old", "other", 0, False), ("h", 1, "root", "x", None, 2, False),
    ]
    graph = progressive.newest(progressive.merged(spark.createDataFrame(rows, SCHEMA)))
    assert {(r["id"], r["depth"], r["has_more"]) for r in graph.filter("what = 'frontier'").collect()} == {("x", 2, False), ("y", 1, True)}
    assert graph.filter("what = 'node'").count() == 1
    assert {r["graph"]: (r["generation"], r["nodes"], r["open"], r["ready"]) for r in progressive.readiness(graph, 2).collect()} == {"g": (7, 1, 1, True), "h": (1, 0, 0, False)}
    assert progressive.readiness(graph, 3).filter("ready").count() == 0


def test_contradictions_and_bounds_are_errors(spark):
    rows = [("g", 1, "node", "n", "one", 0, False), ("g", 1, "node", "n", "two", 0, False)]
    with pytest.raises(Exception, match="contradict"):
        progressive.newest(progressive.merged(spark.createDataFrame(rows, SCHEMA))).collect()
    older = [("g", 2, "node", "n", "new", 0, False), *rows]
    assert [r["payload"] for r in progressive.newest(progressive.merged(spark.createDataFrame(older, SCHEMA))).collect()] == ["new"]
    many = spark.createDataFrame([("g", 1, "edge", str(k), "e", 0, False) for k in range(5)], SCHEMA)
    assert progressive.newest(progressive.merged(many), {"edge": 5}).count() == 5
    with pytest.raises(Exception, match="larger than its limit"):
        progressive.newest(progressive.merged(many), {"edge": 4}).collect()
