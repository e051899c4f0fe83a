"""Telemetry: metrics per node, request timelines, routes, overlays and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.scalars import unit_interval

from .changes import union_length


def overlay(spans: DataFrame, node: str, value: str) -> DataFrame:
    """Per node: calls, error rate and exact latency percentiles."""
    at = lambda q: F.expr(f"percentile({value}, {q}D)")
    return spans.groupBy(F.col(node).alias("node")).agg(
        F.count("*").alias("calls"), (F.count_if(F.col("is_error")) / F.count("*")).alias("error_rate"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")
    )


def mock_metrics(nodes: DataFrame, env: str, seed: str) -> DataFrame:
    """Made-up metrics that depend on environment, node and seed only: log-uniform calls and latency, cubed error rate."""
    u = lambda channel: unit_interval(F.concat(F.lit(f"{env} "), F.col("id"), F.lit(f" {seed} {channel}")))
    log_uniform = lambda x, low, high: F.exp(F.lit(low).cast("double") + x * F.lit(high - low))
    return nodes.select(
        "id", F.floor(log_uniform(u("count"), 0.0, 9.0) + 0.5).cast("long").alias("calls"), F.floor(log_uniform(u("p50"), 0.0, 6.0) + 0.5).cast("long").alias("p50"),
        F.floor(F.pow(u("error"), F.lit(3.0)) * 0.25 * 1000000 + 0.5).cast("long").alias("errors_ppm"),
    )


def timeline(spans: DataFrame, trace: list[str]) -> DataFrame:
    """Spans of each trace in order, with their offset in microseconds and share of the trace's duration."""
    w = W.partitionBy(*trace)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    start, end = F.min(t).over(w), F.max(t).over(w)
    row = F.row_number().over(w.orderBy("ts", "event_id"))
    whole = F.greatest(end - start, F.lit(1))
    return spans.select(*trace, "event_id", row.alias("row"), (t - start).alias("offset_us"), (F.floor((t - start) * F.lit(1000.0) / whole + F.lit(0.5)) / F.lit(1000.0)).alias("at"))


def routes(spans: DataFrame, owner: str, state: str, order: list[str]) -> DataFrame:
    """Runs of one state in the order of an owner's spans: first and last span, length, and the state before."""
    w = W.partitionBy(owner).orderBy(*order)
    change = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)), 0).otherwise(1)
    numbered = spans.withColumn("_c", change).withColumn("run", F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    runs = numbered.groupBy(owner, "run").agg(F.min(state).alias("state"), F.count("*").alias("n"), F.min(order[-1]).alias("first_id"))
    before = F.lag("state").over(W.partitionBy(owner).orderBy("run"))
    return runs.withColumn("came_from", before)


def transitions(spans: DataFrame, parent: list[str], order: str, role: str) -> DataFrame:
    """Counts of steps from one role to the next."""
    step = F.lag(role).over(W.partitionBy(*parent).orderBy(order))
    return spans.select(step.alias("from_role"), F.col(role).alias("to_role")).filter("from_role IS NOT NULL").groupBy("from_role", "to_role").agg(F.count("*").alias("n"))


def match_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Observed pairs (source, target, n) against calls: one call edge observed, more ambiguous, else instantiations, else runtime only."""
    seen = edges.groupBy("source", "target").agg(F.count_if(F.col("kind") == "calls").alias("c"), F.count_if(F.col("kind") == "instantiates").alias("i"))
    judge = lambda n: F.when(n == 1, "observed").when(n > 1, "ambiguous")
    zero = F.lit(0)
    state = F.coalesce(judge(F.coalesce("c", zero)), judge(F.coalesce("i", zero)), F.lit("runtime-only"))
    return pairs.join(seen, ["source", "target"], "left").select("source", "target", "n", state.alias("state"))


def event_counts(spans: DataFrame, trace: list[str], status: Column) -> DataFrame:
    """Per trace: spans, distinct types, errors, and one, mixed or no status."""
    rolled = spans.withColumn("_s", status).groupBy(*trace).agg(
        F.count("*").alias("spans"), F.count_distinct("event_type").alias("types"), F.count_if(F.col("_s") == "error").alias("errors"), F.min("_s").alias("low"), F.max("_s").alias("high")
    )
    return rolled.select(*trace, "spans", "types", "errors", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("mixed").alias("status"))


def candidates(spans: DataFrame, trace: list[str], node: str) -> DataFrame:
    """Traces that touch a node, the newest first when shown."""
    hit = spans.groupBy(*trace).agg(F.max("ts").alias("last"), F.bool_or(F.col("event_type") == node).alias("hit"))
    return hit.filter("hit").select(*trace, F.unix_micros(F.col("last").cast("timestamp")).alias("last_us")).orderBy(F.desc("last_us"))


def compare_runs(before: DataFrame, after: DataFrame, identity: list[str]) -> DataFrame:
    """Occurrences of two runs aligned by identity and ordinal: matched, before only or after only."""
    nth = lambda df: df.withColumn("nth", F.row_number().over(W.partitionBy(*identity).orderBy("ts", "event_id"))).select(*identity, "nth")
    a, b = nth(before).withColumn("a", F.lit(True)), nth(after).withColumn("b", F.lit(True))
    state = F.when(F.col("a").isNull(), "after-only").when(F.col("b").isNull(), "before-only").otherwise("matched")
    return a.join(b, [*identity, "nth"], "full_outer").groupBy(*identity, state.alias("presence")).agg(F.count("*").alias("n"))


def watched_changes(rows: DataFrame, watcher: str, order: list[str], value: str) -> DataFrame:
    """Occurrences whose value differs from the one before for the same watcher."""
    last = F.lag(value).over(W.partitionBy(watcher).orderBy(*order))
    return rows.withColumn("previous", last).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value))).select(watcher, order[-1], "previous", value)


def rolled_evidence(evidence: DataFrame, near: DataFrame, frames: DataFrame) -> DataFrame:
    """("at", spans, errors, first, wall) of evidence (node, a, b, is_error, seq) at what is visible.

    That is the nearest visible ancestor (near: id, near), else the frame of the node's
    service (frames: id, frame). Wall time counts overlapping spans once; nodes that are
    nowhere visible drop out.
    """
    placed = evidence.join(near.select(F.col("id").alias("node"), "near"), "node", "left").join(frames.select(F.col("id").alias("node"), "frame"), "node", "left")
    rows = placed.withColumn("at", F.coalesce("near", "frame")).filter("at IS NOT NULL")
    counts = rows.groupBy("at").agg(F.count("*").alias("spans"), F.count_if("is_error").alias("errors"), F.min("seq").alias("first"))
    return counts.join(union_length(rows.select("at", "a", "b"), "at").select("at", F.col("length").alias("wall")), "at")
