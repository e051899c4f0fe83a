"""Edge algebra: aggregation, relinking, lifting, boundaries, channels and wire folding.

The merge rules differ on purpose between the operators: which resolution survives,
whether weights are counted or summed, and what happens to call sites.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.ids import edge_id, is_outside
from codeloom.functions.pairs import distinct_pairs
from codeloom.functions.scalars import channel_id, http_method, http_path


#: The senders of one channel are dealt out to so many tasks.
CHANNEL_PARTS = 8


def _site() -> Column:
    return F.struct("ord", "file", "line", "col")


def aggregate(occurrences: DataFrame) -> DataFrame:
    """One edge for each (kind, source, target): weight counts, sites in input order, resolved if any is, highest confidence."""
    return _with_id(
        occurrences.groupBy("kind", "source", "target").agg(
            F.count("*").alias("weight"),
            F.array_sort(F.collect_list(_site())).alias("call_sites"),
            F.when(F.bool_or(F.col("resolution") == "resolved"), "resolved").otherwise(F.min_by("resolution", "ord")).alias("resolution"),
            F.max("confidence").alias("confidence"),
        )
    )


def aggregate_first(occurrences: DataFrame, keep_outside: bool = False) -> DataFrame:
    """As :func:`aggregate`, but the first resolution wins, no confidence is kept and outside targets may be dropped."""
    rows = occurrences if keep_outside else occurrences.filter(~is_outside(F.col("target")))
    return _with_id(
        rows.groupBy("kind", "source", "target").agg(
            F.count("*").alias("weight"),
            F.array_sort(F.collect_list(_site())).alias("call_sites"),
            F.min_by("resolution", "ord").alias("resolution"),
        )
    )


def _with_id(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", edge_id(F.col("kind"), F.col("source"), F.col("target")))


def relink(edges: DataFrame, survivor: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints moved to their surviving ancestors (id, near); weights summed, first resolution kept.

    A target that is no node keeps its id; edges inside one survivor go, and so does
    ``implementedBy`` where an end died.
    """
    src = survivor.select(F.col("id").alias("source"), F.col("near").alias("new_source"))
    tgt = survivor.select(F.col("id").alias("target"), F.col("near").alias("new_target"))
    known = nodes.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    moved = edges.join(src, "source").join(tgt, "target", "left").join(known, "target", "left")
    moved = moved.withColumn("to", F.when(F.col("known"), F.col("new_target")).otherwise(F.col("target"))).filter("to IS NOT NULL AND new_source <> to")
    whole = (F.col("new_source") == F.col("source")) & (F.col("to") == F.col("target"))
    moved = moved.filter((F.col("kind") != "implementedBy") | whole)
    merged = moved.groupBy("kind", F.col("new_source").alias("s"), F.col("to").alias("t")).agg(
        F.sum(F.coalesce("weight", F.lit(1))).alias("weight"), F.min_by("resolution", "id").alias("resolution")
    )
    return _with_id(merged.withColumnRenamed("s", "source").withColumnRenamed("t", "target"))


def lift(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Edges between the nearest visible ancestors (id, near), by kind; resolved only where all are.

    Occurrences between the same ends are summed before they meet the ancestors.
    """
    all_in = F.bool_and(F.coalesce(F.col("resolution"), F.lit("resolved")) == "resolved").alias("sure")
    once = edges.groupBy("kind", "source", "target").agg(F.sum(F.coalesce("weight", F.lit(1))).alias("weight"), all_in, F.count("*").alias("n"))
    src = near.select(F.col("id").alias("source"), F.col("near").alias("s"))
    tgt = near.select(F.col("id").alias("target"), F.col("near").alias("t"))
    met = once.join(src, "source").join(tgt, "target").filter("s <> t")
    lifted = met.groupBy("kind", "s", "t").agg(
        F.sum("weight").alias("weight"), F.when(F.bool_and("sure"), "resolved").otherwise("unresolved").alias("resolution"), F.sum("n").alias("underlying")
    )
    return lifted.withColumnRenamed("s", "source").withColumnRenamed("t", "target")


def without_containment(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """edges whose ends do not contain each other."""
    pairs = closure.filter("depth > 0")
    up = pairs.select(F.col("id").alias("source"), F.col("anc_id").alias("target"))
    down = pairs.select(F.col("anc_id").alias("source"), F.col("id").alias("target"))
    return edges.join(up, ["source", "target"], "left_anti").join(down, ["source", "target"], "left_anti")


def boundary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, kind, parent_id of nodes for outside targets, with one container; nothing where there are none."""
    missing = edges.select(F.col("target").alias("id")).filter(is_outside(F.col("id"))).distinct().join(nodes.select("id"), "id", "left_anti")
    kind = F.when(F.col("id").startswith("ext:"), "external").otherwise("unresolved")
    leaves = missing.select("id", kind.alias("kind"), F.lit("ext:__external__").alias("parent_id"))
    container = missing.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit("ext:__external__").alias("id"), F.lit("external").alias("kind"), F.lit(None).cast("string").alias("parent_id"))
    return leaves.unionByName(container)


def channel_nodes(ports: DataFrame) -> DataFrame:
    """Channel nodes of ports (owner, direction, protocol, channel, confidence), with the lowest confidence."""
    named = ports.filter("channel IS NOT NULL").withColumn("id", channel_id(F.col("protocol"), F.col("channel")))
    return named.groupBy("id").agg(F.min(F.coalesce("confidence", F.lit(1.0))).alias("confidence"), F.count("*").alias("n_ports"))


def channel_edges(ports: DataFrame) -> DataFrame:
    """sends edges from senders to channels and handles edges from channels to handlers; certain ports resolve them."""
    named = ports.filter("channel IS NOT NULL").withColumn("id", channel_id(F.col("protocol"), F.col("channel")))
    out = F.col("direction") == "out"
    edges = named.select(
        F.when(out, "sends").otherwise("handles").alias("kind"),
        F.when(out, F.col("owner")).otherwise(F.col("id")).alias("source"),
        F.when(out, F.col("id")).otherwise(F.col("owner")).alias("target"),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    sure = F.bool_or(F.col("confidence") >= 1)
    return edges.groupBy("kind", "source", "target").agg(F.count("*").alias("weight"), F.when(sure, "resolved").otherwise("unresolved").alias("resolution"), F.max("confidence").alias("confidence"))


def sender_handler_pairs(ports: DataFrame) -> DataFrame:
    """Distinct (source, target) owners of the two sides of a channel. The pairs of a channel are as many as the product of its sides."""
    side = lambda d, name: ports.filter((F.col("direction") == d) & F.col("channel").isNotNull()).select("protocol", "channel", F.col("owner").alias(name)).distinct()
    return distinct_pairs(side("out", "source"), side("in", "target"), ["protocol", "channel"], "source", "target", F.col("source") != F.col("target"), CHANNEL_PARTS)


def channel_joins(ports: DataFrame) -> DataFrame:
    """Per channel: systems on each side, whether a side is missing, whether two different systems meet."""
    sides = ports.filter("channel IS NOT NULL").groupBy("protocol", "channel").agg(
        F.collect_set(F.when(F.col("direction") == "out", F.col("system"))).alias("outs"), F.collect_set(F.when(F.col("direction") == "in", F.col("system"))).alias("ins")
    )
    two = F.size(F.array_union("outs", "ins")) > 1
    dangling = (F.size("outs") == 0) | (F.size("ins") == 0)
    return sides.select("protocol", "channel", F.size("outs").alias("n_out"), F.size("ins").alias("n_in"), dangling.alias("dangling"), (~dangling & two).alias("cross_system"))


def match_routes(calls: DataFrame, templates: DataFrame) -> DataFrame:
    """(channel, template): the one most specific template of the same method and length; a tie matches nothing."""

    def shaped(df, name):
        path = F.btrim(http_path(F.col("channel")), F.lit("/"))
        return df.select(F.col("channel").alias(name), http_method(F.col("channel")).alias("method"), F.split(path, "/").alias(f"{name}_parts")).distinct()

    wild = lambda p: p.startswith(":") | (p == "*")
    left, right = shaped(calls, "call"), shaped(templates, "template")
    left, right = left.withColumn("n", F.size("call_parts")), right.withColumn("n", F.size("template_parts"))
    met = left.join(right, ["method", "n"]).filter(F.forall(F.zip_with("call_parts", "template_parts", lambda a, b: (a == b) | wild(b)), lambda x: x))
    met = met.withColumn("wildcards", F.size(F.filter("template_parts", wild)))
    best = met.groupBy("call").agg(F.min("wildcards").alias("wildcards"))
    return met.join(best, ["call", "wildcards"]).groupBy("call").agg(F.count("*").alias("n"), F.min("template").alias("template")).filter("n = 1").select("call", "template")


def fuse_cycles(edges: DataFrame) -> DataFrame:
    """One row for each unordered pair and kind: summed weight, and whether both directions occur."""
    pair = edges.groupBy("kind", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return pair.agg(F.sum("weight").alias("weight"), (F.count_distinct("source") > 1).alias("fused"))


def bundle(edges: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """Wires between the children of two different parents, bundled from ``least`` on, with the dominant kind by weight."""
    parent = nodes.filter("parent_id IS NOT NULL").select("id", "parent_id")
    up = lambda end, name: parent.select(F.col("id").alias(end), F.col("parent_id").alias(name))
    met = edges.join(up("source", "ps"), "source").join(up("target", "pt"), "target").filter("ps <> pt")
    kinds = met.groupBy("ps", "pt", "kind").agg(F.count("*").alias("n"), F.sum("weight").alias("w"))
    return kinds.groupBy("ps", "pt").agg(F.sum("n").alias("strands"), F.sum("w").alias("weight"), F.max_by("kind", F.struct("w", "kind")).alias("dominant")).filter(F.col("strands") >= least)


def ribbons(edges: DataFrame) -> DataFrame:
    """Ordered pairs with two strands or more, folded into the heaviest."""
    return edges.groupBy("source", "target").agg(F.count("*").alias("strands"), F.sum("weight").alias("weight"), F.max_by("kind", F.struct("weight", "kind")).alias("dominant")).filter("strands >= 2")


def spools(edges: DataFrame, fan: int = 6) -> DataFrame:
    """edges with their fan-out and fan-in, and whether one of the two reaches ``fan``; hubs are counted before they are joined."""
    out = edges.groupBy("source").agg(F.count("*").alias("fan_out"))
    into = edges.groupBy("target").agg(F.count("*").alias("fan_in"))
    return edges.join(out, "source").join(into, "target").withColumn("spooled", (F.col("fan_out") >= fan) | (F.col("fan_in") >= fan))


def faint(edges: DataFrame, crowd: int = 32, kinds=("references", "imports")) -> DataFrame:
    """edges, faded where there are more than ``crowd`` in all and the strand is light and of a dependency kind."""
    total = edges.agg(F.count("*").alias("total"))
    return edges.join(F.broadcast(total)).withColumn("faded", (F.col("total") > crowd) & (F.col("weight") <= 1) & F.col("kind").isin(*kinds)).drop("total")


def collapsible(nodes: DataFrame) -> DataFrame:
    """Packages with exactly one child, which is a package: (id, child)."""
    child = nodes.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("id").alias("child"), F.min("kind").alias("child_kind"))
    packages = nodes.filter("kind = 'package'").select("id")
    return packages.join(child.filter("n = 1 AND child_kind = 'package'"), F.col("id") == F.col("parent_id")).select("id", "child")


def parallel_order(edges: DataFrame) -> DataFrame:
    """edges with their place among the strands of their ordered pair, the heaviest first."""
    return edges.withColumn("strand", F.row_number().over(W.partitionBy("source", "target").orderBy(F.desc("weight"), "kind")))
