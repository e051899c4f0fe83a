"""Step trees as tables: steps (flow, path, parent, depth, ord, kind, target) with materialised paths.

Paths of siblings sort as the siblings do. A step's kind is call, await, branch, loop,
callback or exit; top-level steps have a null parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union

from .tree import first_of

_SIBLINGS = ["flow", "parent"]


def terminating(steps: DataFrame) -> DataFrame:
    """(flow, path, terminates): whether a step with children ends in an exit."""
    last = steps.filter("parent IS NOT NULL").groupBy("flow", "parent").agg(F.max_by("kind", "ord").alias("kind"))
    return last.select("flow", F.col("parent").alias("path"), (F.col("kind") == "exit").alias("terminates"))


def dead_steps(steps: DataFrame) -> DataFrame:
    """(flow, path) of steps behind an exit among their siblings."""
    before = W.partitionBy(*_SIBLINGS).orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("_exits", F.count(F.when(F.col("kind") == "exit", 1)).over(before)).filter("_exits > 0").select("flow", "path")


def control_edges(steps: DataFrame) -> DataFrame:
    """(flow, source, target, kind): next from a step that is no exit to its following sibling, enter from a step to its first child."""
    order = W.partitionBy(*_SIBLINGS).orderBy("ord")
    placed = steps.withColumn("_next", F.lead("path").over(order)).withColumn("_nth", F.row_number().over(order))
    following = placed.filter("_next IS NOT NULL AND kind <> 'exit'").select("flow", F.col("path").alias("source"), F.col("_next").alias("target"), F.lit("next").alias("kind"))
    entered = placed.filter("parent IS NOT NULL AND _nth = 1").select("flow", F.col("parent").alias("source"), F.col("path").alias("target"), F.lit("enter").alias("kind"))
    return following.unionByName(entered)


def sequences(steps: DataFrame, max_depth: int, top: int) -> DataFrame:
    """(flow, place, path, kind, truncated): the first ``top`` steps of each flow down to a depth, and whether there are more."""
    seen = steps.filter(F.col("depth") <= max_depth)
    total = steps.groupBy("flow").agg(F.count("*").alias("total"))
    shown = seen.withColumn("place", F.row_number().over(W.partitionBy("flow").orderBy("path"))).filter(F.col("place") <= top)
    size = shown.groupBy("flow").agg(F.count("*").alias("n"))
    return shown.join(total, "flow").join(size, "flow").select("flow", "place", "path", "kind", (F.col("total") > F.col("n")).alias("truncated"))


def callees(steps: DataFrame) -> DataFrame:
    """(flow, target, times) of what a flow calls at any depth."""
    return steps.filter("target IS NOT NULL").groupBy("flow", "target").agg(F.count("*").alias("times"))


def step_counts(steps: DataFrame) -> DataFrame:
    """(flow, steps) without exits."""
    return steps.groupBy("flow").agg(F.count_if(F.col("kind") != "exit").alias("steps"))


def below(steps: DataFrame, path: str) -> DataFrame:
    """Steps of all flows at or under one path."""
    return steps.filter((F.col("path") == path) | F.col("path").startswith(f"{path}."))


def branch_evidence(arms: DataFrame, counters: DataFrame) -> DataFrame:
    """(arm, hits, state): arms (arm, file, start, stop) met with counters (file, start, stop, hits) of exactly their span.

    Only a span that one arm and one counter have counts; others are unknown.
    """
    span = ["file", "start", "stop"]
    one_arm = arms.groupBy(*span).agg(F.count("*").alias("arms"))
    one_counter = counters.groupBy(*span).agg(F.count("*").alias("counters"), F.min("hits").alias("hits"))
    met = arms.join(one_arm, span).join(one_counter, span, "left")
    sure = (F.col("arms") == 1) & (F.col("counters") == 1)
    hits = F.when(sure, F.col("hits"))
    state = F.when(hits > 0, "taken").when(hits == 0, "not-taken").otherwise("unknown")
    return met.select("arm", hits.alias("hits"), state.alias("state"))


def resolved_imports(pending: DataFrame, files: DataFrame, exports: DataFrame, reexports: DataFrame, endings=("", ".ts", ".tsx", "/index.ts"), max_depth: int = 1_000) -> DataFrame:
    """(id, file, name) of pending imports (id, subpath, name): the file that at last defines the name.

    A subpath is tried with each ending in turn against files (file); exports (file,
    name) define, reexports (file, name, from_file) pass on. Circles of re-exports and
    names that nobody defines give no row.
    """
    tried = pending.select("id", "name", F.posexplode(F.array(*[F.concat("subpath", F.lit(e)) for e in endings])).alias("rank", "file"))
    at = cut(first_of(tried.join(files.select("file").distinct(), "file", "left_semi"), ["id"], [F.asc("rank")]).select("id", "name", "file"))
    defined = cut(exports.select("file", "name").distinct())
    passed = cut(reexports.select("file", "name", "from_file").distinct())
    hops = [at]
    for _ in range(max_depth):
        onward = at.join(defined, ["file", "name"], "left_anti").join(passed, ["file", "name"]).select("id", "name", F.col("from_file").alias("file")).distinct()
        at = cut(onward.join(union(hops), ["id", "name", "file"], "left_anti"))
        if at.isEmpty():
            return union(hops).join(defined, ["file", "name"], "left_semi").distinct().select("id", "file", "name")
        hops.append(at)
    raise Unsettled(f"re-exports in more than {max_depth} hops")
