"""Merging of slices and extractions, and what a cache may drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conflicts(slices: list[DataFrame], key: str = "id") -> DataFrame:
    """(key, versions) of rows that slices tell differently."""
    every = _union(slices)
    rest = [c for c in every.columns if c != key]
    return every.groupBy(key).agg(F.count_distinct(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})).alias("versions")).filter("versions > 1")


def merge(slices: list[DataFrame], key: str = "id") -> DataFrame:
    """Rows of all slices, equal ones once; a row that two slices tell differently fails the job."""
    every = _union(slices).distinct()
    twice = every.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").agg(F.count("*").alias("_bad"))
    checked = F.assert_true(F.col("_bad") == 0, "slices disagree about a row")
    return every.join(F.broadcast(twice)).filter(checked.isNull()).select(*every.columns)


def _union(slices: list[DataFrame]) -> DataFrame:
    out = slices[0]
    for part in slices[1:]:
        out = out.unionByName(part)
    return out


def merged_stats(stats: DataFrame, group: str) -> DataFrame:
    """Counters (group, language, counter, n) summed, with the one language or ``mixed``."""
    one = F.when(F.count_distinct("language") == 1, F.min("language")).otherwise("mixed")
    return stats.groupBy(group, "counter").agg(F.sum("n").alias("n"), one.alias("language"))


def evictions(entries: DataFrame, cache: str, now, idle, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Entries (cache, entry, used_at, pinned and a column for each limit) that go, with the reason.

    Entries idle for longer than ``idle`` go; then, in caches where a limit's high mark is
    passed, the least recently used until every such limit is at its low mark. Pinned
    entries stay but count.
    """
    free = entries.withColumn("stale", ~F.col("pinned") & (F.lit(now) - F.col("used_at") > F.lit(idle)))
    every = W.partitionBy(cache)
    order = every.orderBy("used_at", "entry").rowsBetween(W.unboundedPreceding, -1)
    pressed = F.lit(False)
    for name, (low, high) in limits.items():
        left = F.when(~F.col("stale"), F.col(name)).otherwise(F.lit(0))
        free = free.withColumn(f"_all_{name}", F.sum(left).over(every))
        gone = F.coalesce(F.sum(F.when(~F.col("pinned"), left)).over(order), F.lit(0))
        pressed = pressed | ((F.col(f"_all_{name}") > high) & (F.col(f"_all_{name}") - gone > low))
    reason = F.when(F.col("stale"), "idle").when(~F.col("pinned") & pressed, "pressure")
    return free.withColumn("reason", reason).filter("reason IS NOT NULL").select(cache, "entry", "reason")
