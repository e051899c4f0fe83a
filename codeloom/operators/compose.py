"""Composition of units: packages as clusters, frames and cards, couplings lifted to what is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import COUPLING, INHERITANCE
from .tree import nearest

ROOT = "(root)"
#: Fixed value: with more units than this, packages stand for them.
MOST_UNITS = 120


def clusters(units: DataFrame, nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """id, label, units, smelly of the nearest packages of units (id, smells), by label; units without one are in (root)."""
    near = nearest(closure, nodes.filter("kind = 'package'").select("id")).withColumnRenamed("near", "cluster")
    placed = units.join(near, "id", "left").select(F.coalesce("cluster", F.lit(ROOT)).alias("cluster"), (F.col("smells") != "").alias("smelly"))
    rolled = placed.groupBy(F.col("cluster").alias("id")).agg(F.count("*").alias("units"), F.count_if("smelly").alias("smelly"))
    return rolled.join(nodes.select("id", F.col("display_name").alias("label")), "id", "left").select("id", F.coalesce("label", "id").alias("label"), "units", "smelly").orderBy("label", "id")


def placements(units: DataFrame, nodes: DataFrame, closure: DataFrame, opened: DataFrame) -> DataFrame:
    """(id, card, frames) of units: packages from the top down are frames while they are opened (id), the first one that isn't is the card, else the unit."""
    packages = nodes.filter("kind = 'package'").select(F.col("id").alias("anc_id"))
    shown = opened.select(F.col("id").alias("anc_id"), F.lit(True).alias("open"))
    above = closure.filter("depth > 0").join(packages, "anc_id").join(shown, "anc_id", "left").join(units.select("id"), "id", "left_semi")
    chain = above.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", F.coalesce("open", F.lit(False)).alias("open"), "anc_id")), asc=False).alias("c"))  # as many as the tree is deep
    first = F.array_position(F.transform("c", lambda x: x["open"]), F.lit(False)).cast("int")
    frames = F.transform(F.when(first > 0, F.slice("c", F.lit(1), first - 1)).otherwise(F.col("c")), lambda x: x["anc_id"])
    card = F.when(first > 0, F.get("c", first - 1)["anc_id"])
    met = units.select("id").join(chain.select("id", card.alias("card"), frames.alias("frames")), "id", "left")
    return met.select("id", F.coalesce("card", "id").alias("card"), F.coalesce("frames", F.array().cast("array<string>")).alias("frames"))


def frame_counts(units: DataFrame, placed: DataFrame) -> DataFrame:
    """id, parent, depth, units, smelly of every frame on the way to units (id, smells)."""
    rows = units.join(placed, "id").select((F.col("smells") != "").alias("smelly"), "frames", F.posexplode("frames").alias("depth", "frame"))
    parent = F.get("frames", F.col("depth") - 1)
    return rows.groupBy(F.col("frame").alias("id")).agg(F.min(parent).alias("parent"), F.min("depth").alias("depth"), F.count("*").alias("units"), F.count_if("smelly").alias("smelly"))


def package_cards(units: DataFrame, placed: DataFrame) -> DataFrame:
    """id, units, members, smelly, worst of the packages that stand for units (id, members, distance, smells)."""
    rows = units.join(placed.select("id", "card"), "id").filter("card <> id")
    return rows.groupBy(F.col("card").alias("id")).agg(
        F.count("*").alias("units"), F.sum("members").alias("members"), F.count_if(F.col("smells") != "").alias("smelly"), F.max("distance").alias("worst")
    )


def card_couplings(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """source, target, inheritance_only, cross_boundary between different cards.

    Two units that stand for themselves in one frame are not across a boundary; a pair is
    inheritance only where nothing else is between any of its units.
    """
    frame = F.get("frames", F.size("frames") - 1)
    own = placed.select("id", "card", (F.col("card") == F.col("id")).alias("single"), frame.alias("frame"))
    side = lambda end: own.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("card", "single", "frame")])
    rows = edges.filter(F.col("kind").isin(*COUPLING)).join(side("source"), "source").join(side("target"), "target").filter("source_card <> target_card")
    inside = F.col("source_single") & F.col("target_single") & F.col("source_frame").eqNullSafe(F.col("target_frame"))
    return rows.groupBy(F.col("source_card").alias("source"), F.col("target_card").alias("target")).agg(
        F.bool_and(F.col("kind").isin(*INHERITANCE)).alias("inheritance_only"), F.bool_and(~inside).alias("cross_boundary")
    )


def channel_wires(edges: DataFrame, placed: DataFrame) -> DataFrame:
    """source, target, channels between the cards (id, card) of a channel's senders and handlers; what stays in one card is no wire."""
    cards = placed.select(F.col("id").alias("end"), "card")
    side = lambda kind, channel, end, name: edges.filter(F.col("kind") == kind).select(F.col(channel).alias("channel"), F.col(end).alias("end")).join(cards, "end").select("channel", F.col("card").alias(name)).distinct()
    met = side("sends", "target", "source", "source").join(side("handles", "source", "target", "target"), "channel").filter("source <> target")
    return met.groupBy("source", "target").agg(F.count_distinct("channel").alias("channels"))


def surviving(units: DataFrame, edges: DataFrame) -> DataFrame:
    """units that have members or a coupling."""
    ends = edges.filter(F.col("kind").isin(*COUPLING) & (F.col("source") != F.col("target")))
    met = ends.select(F.col("source").alias("id")).unionByName(ends.select(F.col("target").alias("id"))).distinct().withColumn("_met", F.lit(True))
    return units.join(met, "id", "left").filter("members > 0 OR _met").drop("_met")


def composition(units: DataFrame, edges: DataFrame, nodes: DataFrame, closure: DataFrame, opened: DataFrame, most: int = MOST_UNITS) -> tuple[DataFrame, DataFrame]:
    """(id, role) of cards and frames, and the couplings between cards, of the units that survive.

    Up to ``most`` units each stands for itself in the frames of its packages; beyond, packages that aren't opened stand for theirs.
    """
    left = surviving(units, edges)
    all_open = left.limit(most + 1).count() <= most
    placed = placements(left, nodes, closure, nodes.filter("kind = 'package'").select("id") if all_open else opened)
    role = F.when(F.col("card") == F.col("id"), "unit").otherwise("package")
    cards = placed.select(F.col("card").alias("id"), role.alias("role")).distinct()
    frames = placed.select(F.explode("frames").alias("id")).distinct().withColumn("role", F.lit("frame"))
    return cards.unionByName(frames), card_couplings(edges, placed)


def owners(targets: DataFrame, placed: DataFrame, metrics: DataFrame) -> DataFrame:
    """(target, unit, tone, smelly) of call targets (target) that belong to a unit; placed (id, unit), metrics (id, distance, smells)."""
    known = metrics.select(F.col("id").alias("unit"), "distance", (F.col("smells") != "").alias("smelly"))
    # fixed values: the distances at which a tone ends
    tone = F.when(F.col("distance") <= 0.2, "good").when(F.col("distance") >= 0.7, "bad").otherwise("warn")
    met = targets.select("target").distinct().join(placed.select(F.col("id").alias("target"), "unit"), "target").join(known, "unit")
    return met.select("target", "unit", tone.alias("tone"), "smelly")
