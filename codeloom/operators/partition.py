"""Packing of whole groups to a target size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut


def packed(groups: DataFrame, edges: DataFrame, target: int, slack: float = 1.25, max_rounds: int = 200) -> DataFrame:
    """(id, group): whole groups (id, group) merged by affinity as long as none passes ``slack`` times target.

    In a round a hash parts the groups into those that propose and those that accept. One
    below the target proposes to the accepting group to which it has most weight by size; a
    group accepts in that order while there is room, so that many merge at once. It ends
    when no two groups with weight between them fit. edges: a, b, weight.
    """
    most = int(slack * target)
    now = cut(groups.select("id", "group"))
    links = cut(edges.select("a", "b", "weight"))
    for number in range(max_rounds):
        size = now.groupBy("group").agg(F.count("*").alias("n"))
        of = lambda end: now.join(size, "group").select(F.col("id").alias(end), F.col("group").alias(f"g{end}"), F.col("n").alias(f"n{end}"))  # noqa: E731, B023
        met = links.join(of("a"), "a").join(of("b"), "b").filter((F.col("ga") != F.col("gb")) & (F.col("na") + F.col("nb") <= most) & (F.least("na", "nb") < target))
        side = lambda own, n, other, m: met.select(F.col(own).alias("g"), F.col(n).alias("n"), F.col(other).alias("to"), F.col(m).alias("m"), "weight")  # noqa: E731, B023
        both = side("ga", "na", "gb", "nb").unionByName(side("gb", "nb", "ga", "na"))
        fits = cut(both.groupBy("g", "n", "to", "m").agg((F.sum("weight") / F.sqrt(F.col("n") * F.col("m"))).alias("by")))
        if fits.isEmpty():
            return now
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(number)), F.lit(2))  # noqa: E731, B023
        asked = fits.filter((coin("g") == 1) & (coin("to") == 0) & (F.col("n") < target)).groupBy("g", "n").agg(F.max(F.struct("by", "to", "m")).alias("t")).select("g", "n", "t.*")
        room = F.sum("n").over(W.partitionBy("to").orderBy(F.desc("by"), "g").rowsBetween(W.unboundedPreceding, 0))
        moves = cut(asked.withColumn("_upto", room + F.col("m")).filter(F.col("_upto") <= most).select(F.col("g").alias("group"), "to"))
        if moves.isEmpty():  # few are left, and all on one side
            moves = cut(fits.filter(F.col("n") < target).orderBy(F.desc("by"), "g", "to").limit(1).select(F.col("g").alias("group"), "to"))
        # a union of those that stay and those that move: what the planner knows of either doesn't pile up round by round
        now = cut(now.join(moves, "group", "left_anti").select("id", "group").unionByName(now.join(moves, "group").select("id", F.col("to").alias("group"))))
    raise Unsettled(f"groups not packed within {max_rounds} rounds")
