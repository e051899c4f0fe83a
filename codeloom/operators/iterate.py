"""Driver loops over DataFrames: breadth-first search, components, fixpoints.

A round is one or two joins; its result is cut from its lineage, and the loop ends when
a round adds nothing. Adjacency is never collected, and what earlier rounds have found is
read where they left it and not written again. A loop that doesn't end within its bound
is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, remove, shared_folder, stored, union


def bfs(seeds: DataFrame, edges: DataFrame, blocked: DataFrame | None = None, max_depth: int | None = None, max_rounds: int = 1_000) -> DataFrame:
    """(id, distance) of all that seeds (id) reach along edges (source, target), at distance 0 the seeds themselves.

    Nodes of blocked (id) are never entered; max_depth, where given, is how far to go.
    """
    steps = edges.select("source", "target").distinct()
    if blocked is not None:
        steps = steps.join(blocked.select(F.col("id").alias("target")), "target", "left_anti")
    steps = cut(steps)
    levels = [cut(seeds.select("id").distinct().withColumn("distance", F.lit(0)))]
    for depth in range(1, (max_rounds if max_depth is None else max_depth) + 1):
        front = levels[-1]
        found = front.join(steps, front["id"] == steps["source"]).select(F.col("target").alias("id")).distinct()
        level = cut(found.join(union(levels).select("id"), "id", "left_anti").withColumn("distance", F.lit(depth)))
        if level.isEmpty():
            return union(levels)
        levels.append(level)
    if max_depth is None:
        raise Unsettled(f"the search has not ended within {max_rounds} steps")
    return union(levels)


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, root): the smallest id of each node's component; edges (source, target) are read both ways.

    Each round takes the smallest label of the neighbours, tells it to all that share the
    label so far, and then follows labels of labels: a chain takes about log n rounds in
    whatever order its names are. The labels of a round are removed when those of the next are written.
    """
    spark = nodes.sparkSession
    way = lambda a, b: F.struct(F.col(a).alias("id"), F.col(b).alias("other"))
    both = cut(edges.select(F.explode(F.array(way("source", "target"), way("target", "source"))).alias("e")).select("e.*").distinct())
    base = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"
    labels = stored(nodes.select("id", F.col("id").alias("root")).distinct(), f"{base}/0")
    for number in range(1, max_rounds + 1):
        near = both.join(labels.select(F.col("id").alias("other"), F.col("root").alias("seen")), "other").groupBy("id").agg(F.min("seen").alias("seen"))
        met = labels.join(near, "id", "left")
        told = met.filter("seen < root").groupBy("root").agg(F.min("seen").alias("told"))
        lower = met.join(told, "root", "left").select("id", "root", F.least("root", "seen", "told").alias("low"))
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("lowest"))
        new = stored(lower.join(jump, "low", "left").select("id", "root", F.least("low", F.coalesce("lowest", "low")).alias("next")), f"{base}/{number}")
        remove(spark, f"{base}/{number - 1}")
        labels = new.select("id", F.col("next").alias("root"))
        if new.filter("next <> root").isEmpty():
            return labels
    raise Unsettled(f"components have not settled within {max_rounds} rounds")


def connectors(chosen: DataFrame, edges: DataFrame, nodes: DataFrame | None = None, max_depth: int | None = None, max_rounds: int = 1_000) -> DataFrame:
    """(id): what lies between the members of a small selection (id) on one shortest way for each pair; edges are read both ways.

    Of ways of one length that with more edges wins, then the heavier one, then that whose
    ids come first. edges: one row for each drawn relation: source, target and, where
    known, weight. With nodes (id, abstraction) ways stay within the abstraction of the
    selection; there are none if its members differ in it or one isn't a node. max_depth,
    where given, is how far a search goes; else it goes on while it finds new nodes. A
    row carries its way, which is as long as the distance.
    """
    weight = F.when(F.col("weight") > 0, F.col("weight")).otherwise(1).cast("double") if "weight" in edges.columns else F.lit(1.0)
    seeds = chosen.select("id").distinct()
    if nodes is not None:
        own = cut(seeds.join(nodes.select("id", "abstraction"), "id", "left"))
        same = own.agg(F.count_distinct("abstraction").alias("n"), F.count_if(F.col("abstraction").isNull()).alias("missing"), F.min("abstraction").alias("abstraction"))
        level = same.filter("n = 1 AND missing = 0").select("abstraction")
        seeds = own.join(F.broadcast(level), "abstraction", "left_semi").select("id")
        inside = nodes.join(F.broadcast(level), "abstraction", "left_semi").select("id")
        for end in ("source", "target"):
            edges = edges.join(inside.select(F.col("id").alias(end)), end, "left_semi")
    rows = edges.filter("source <> target").select(F.least("source", "target").alias("id"), F.greatest("source", "target").alias("next"), weight.alias("w"))
    pairs = rows.groupBy("id", "next").agg(F.count("*").alias("k"), F.sum("w").alias("w"))
    both = cut(pairs.unionByName(pairs.select(F.col("next").alias("id"), F.col("id").alias("next"), "k", "w")))
    seeds = cut(seeds)
    levels = [cut(seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("way"), F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("w")))]
    for _ in range(max_rounds if max_depth is None else max_depth):
        last = levels[-1].select("seed", "id", "way", F.col("k").alias("k0"), F.col("w").alias("w0"))
        step = F.struct((-F.col("k0") - F.col("k")).alias("k"), (-F.col("w0") - F.col("w")).alias("w"), F.concat("way", F.array("next")).alias("way"))
        best = last.join(both, "id").groupBy("seed", F.col("next").alias("id")).agg(F.min(step).alias("s"))
        found = best.select("seed", "id", "s.way", (-F.col("s.k")).alias("k"), (-F.col("s.w")).alias("w"))
        level = cut(found.join(union(levels).select("seed", "id"), ["seed", "id"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
    else:
        if max_depth is None:
            raise Unsettled(f"the searches have not ended within {max_rounds} steps")
    ends = union(levels).join(seeds, "id", "left_semi").filter("seed < id")
    return ends.select(F.explode("way").alias("id")).distinct().join(seeds, "id", "left_anti")
