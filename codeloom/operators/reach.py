"""Estimated test reachability: which callables tests reach along execution edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import cut
from codeloom.functions.scalars import percent

from .iterate import bfs
from .relations import with_constructor_calls
from .tree import ancestors, closed_tests

#: Edges that execute code, kinds that are called, and how many callers are told.
EXECUTION = ("calls", "instantiates", "renders")
CALLABLE = ("function", "method")
CALLERS = 8


def is_resolved_execution(edges: DataFrame) -> Column:
    """Whether an edge runs its target for sure; a missing resolution is a resolved one."""
    known = F.coalesce("resolution", F.lit("resolved")) == "resolved" if "resolution" in edges.columns else F.lit(True)
    return F.col("kind").isin(*EXECUTION) & known


def _first_callers(pairs: DataFrame, name: str) -> DataFrame:
    """(id, name): the first sources of each target, by id; ranks are cut off before anything is gathered."""
    rank = F.row_number().over(W.partitionBy("target").orderBy("source"))
    first = pairs.select("source", "target").distinct().withColumn("_rank", rank).filter(F.col("_rank") <= CALLERS)
    return first.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_list("source")).alias(name))


def leaf_coverage(nodes: DataFrame, edges: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """id, status, distance, reason and callers of every callable that is no test.

    nodes: id, kind, parent_id, is_test and, for constructors, display_name; edges: kind,
    source, target and, where known, resolution. At distance 1 from a test a callable is
    covered, further away indirect. Others are uncovered (distance -1), with the reason
    never-called or only-uncovered-callers. Callers are the first eight tests that call a
    covered one, or the first eight callers of an uncovered one; none otherwise.
    """
    tests = cut(closed_tests(nodes, nodes.filter("is_test").select("id"), closure))
    sure = edges.filter(is_resolved_execution(edges)).select("kind", "source", "target")
    expanded = with_constructor_calls(nodes, sure) if "display_name" in nodes.columns else sure
    run = cut(expanded.select("source", "target").distinct())
    reached = bfs(tests, run, blocked=tests).filter("distance > 0")
    leaves = nodes.filter(F.col("kind").isin(*CALLABLE)).select("id").join(tests, "id", "left_anti")
    from_tests = run.join(tests.select(F.col("id").alias("source")), "source", "left_semi")
    from_code = run.join(tests.select(F.col("id").alias("source")), "source", "left_anti")
    met = leaves.join(reached, "id", "left").join(_first_callers(from_tests, "by_tests"), "id", "left").join(_first_callers(from_code, "by_code"), "id", "left")
    status = F.when(F.col("distance") == 1, "covered").when(F.col("distance") > 1, "indirect").otherwise("uncovered")
    reason = F.when(F.col("distance").isNull(), F.when(F.col("by_code").isNull(), "never-called").otherwise("only-uncovered-callers"))
    callers = F.when(F.col("distance") == 1, F.col("by_tests")).when(F.col("distance").isNull(), F.col("by_code"))
    none = F.array().cast("array<string>")
    return met.select("id", status.alias("status"), F.coalesce("distance", F.lit(-1)).alias("distance"), reason.alias("reason"), F.coalesce(callers, none).alias("callers"))


def container_coverage(nodes: DataFrame, leaves: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """id, covered, total, percent, status of every node with children that is no test, indirect ones counted as covered.

    Where nothing callable is below, the status is no-callables.
    """
    closure = ancestors(nodes) if closure is None else closure
    tests = closed_tests(nodes, nodes.filter("is_test").select("id"), closure)
    holders = nodes.select(F.col("parent_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_semi").join(tests, "id", "left_anti")
    hit = F.count_if(F.col("status") != "uncovered")
    above = closure.filter("depth > 0 AND anc_id <> id")
    rolled = above.join(leaves.select("id", "status"), "id").groupBy(F.col("anc_id").alias("id")).agg(hit.alias("covered"), F.count("*").alias("total"))
    zero = F.lit(0).cast("long")
    met = holders.join(rolled, "id", "left").select("id", F.coalesce("covered", zero).alias("covered"), F.coalesce("total", zero).alias("total"))
    state = F.when(F.col("total") == 0, "no-callables").when(F.col("covered") == 0, "uncovered").when(F.col("covered") == F.col("total"), "covered").otherwise("partial")
    return met.withColumn("percent", percent(F.col("covered"), F.col("total"))).withColumn("status", state)


def coverage_summary(nodes: DataFrame, edges: DataFrame, leaves: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """One row: callables by status, the percentage reached, the tests, and unresolved edges that leave tests."""
    tests = cut(closed_tests(nodes, nodes.filter("is_test").select("id"), closure))
    count = lambda s: F.count_if(F.col("status") == s)
    out = leaves.agg(F.count("*").alias("callables"), count("covered").alias("covered"), count("indirect").alias("indirect"), count("uncovered").alias("uncovered"))
    unsure = edges.filter("resolution = 'unresolved'").join(tests.select(F.col("id").alias("source")), "source", "left_semi")
    told = tests.agg(F.count("*").alias("test_nodes")).join(unsure.agg(F.count("*").alias("unresolved_from_tests")))  # one row each
    return out.withColumn("percent", percent(F.col("covered") + F.col("indirect"), F.col("callables"))).join(F.broadcast(told))


def coverage_rows(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Callables by direct parent: total, missing, percent, and the missing ones (id, reason) as an array in order of their ids."""
    placed = leaves.join(nodes.select("id", "parent_id"), "id")
    good = F.count_if(F.col("status") != "uncovered")
    gone = F.when(F.col("status") == "uncovered", F.struct("id", "reason"))
    return placed.groupBy(F.col("parent_id").alias("id")).agg(
        F.count("*").alias("total"), (F.count("*") - good).alias("missing"), percent(good, F.count("*")).alias("percent"), F.array_sort(F.collect_list(gone)).alias("uncovered")
    )
