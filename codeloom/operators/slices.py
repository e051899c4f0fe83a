"""Slices of a graph around some files: what they hold, what holds them, and the edges in and at the rim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import ancestors


def projected_nodes(nodes: DataFrame, reached: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(id, role) of nodes (id, parent_id, file) in reached files (file), and of what is above them: own or ancestor."""
    closure = ancestors(nodes) if closure is None else closure
    own = nodes.join(reached.select("file").distinct(), "file", "left_semi").select("id").distinct()
    above = closure.join(own, "id", "left_semi").select(F.col("anc_id").alias("id")).distinct().join(own, "id", "left_anti")
    return own.withColumn("role", F.lit("own")).unionByName(above.withColumn("role", F.lit("ancestor")))


def projected_edges(edges: DataFrame, projected: DataFrame) -> DataFrame:
    """edges that touch a slice's own nodes, with where: inside it, out of it or into it."""
    own = projected.filter("role = 'own'").select("id").withColumn("_own", F.lit(True))
    side = lambda end: own.select(F.col("id").alias(end), F.col("_own").alias(f"_{end}"))
    met = edges.join(side("source"), "source", "left").join(side("target"), "target", "left").filter("_source OR _target")
    where = F.when(F.col("_source").isNotNull() & F.col("_target").isNotNull(), "inside").when(F.col("_source").isNotNull(), "out").otherwise("in")
    return met.withColumn("where", where).drop("_source", "_target")


def completeness(reached: DataFrame, links: DataFrame) -> DataFrame:
    """One row (files, deepest, complete_through): up to which distance no file of a slice (file, distance) has a neighbour outside it.

    links (source, target) go both ways. A slice without a rim is complete through its deepest file.
    """
    rim = links.join(reached.select(F.col("file").alias("target")), "target", "left_anti").select(F.col("source").alias("file")).distinct()
    met = reached.join(rim.withColumn("_rim", F.lit(True)), "file", "left")
    told = met.agg(F.count("*").alias("files"), F.max("distance").alias("deepest"), F.min(F.when(F.col("_rim"), F.col("distance"))).alias("rim"))
    return told.select("files", "deepest", F.coalesce("rim", "deepest").alias("complete_through"))
