"""The smallest subgraph around chosen members: cards, the frames around files, wires between cards and ghosts beyond.

Everything is an equi-join on the closure of containment: a card is the nearest member
above an end, a frame is an ancestor of a member file, and chains of packages that hold
one package each are contracted into the package at their end by comparing depths, with
no loop over the chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import cut

from .tree import nearest

#: Kinds of nodes that are cards of code, and kinds of edges that are wires between cards.
UNIT_KINDS = ("class", "interface", "object", "enum", "typeAlias", "namespace")
BLOCK_KINDS = ("function", "method")
WIRE_KINDS = ("calls", "instantiates", "extends", "implements", "references", "renders", "ipc")


def contracted(nodes: DataFrame, kept: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, parent_id, label) of kept nodes (id, closed upward) that are left: a package whose one kept child is a package goes into it.

    parent_id is the nearest ancestor that is left; label joins the names from the first
    contracted package down to the node, and is null where none was contracted.
    """
    own = nodes.join(kept.select("id").distinct(), "id", "left_semi").select("id", "parent_id", "kind", "name")
    only = own.filter("parent_id IS NOT NULL AND parent_id <> id").groupBy("parent_id").agg(F.count("*").alias("n"), F.min("kind").alias("child_kind"))
    through = own.filter("kind = 'package'").join(only.withColumnRenamed("parent_id", "id"), "id").filter("n = 1 AND child_kind = 'package'").select("id")
    left = own.join(through, "id", "left_anti")
    above = closure.filter("depth > 0").join(left.select("id"), "id", "left_semi").join(own.select(F.col("id").alias("anc_id"), "name"), "anc_id")
    above = cut(above.join(through.select(F.col("id").alias("anc_id"), F.lit(True).alias("gone")), "anc_id", "left"))
    parent = above.filter("gone IS NULL").groupBy("id").agg(F.min_by("anc_id", "depth").alias("parent_id"), F.min("depth").alias("at"))
    chain = above.filter("gone").join(parent.select("id", "at"), "id", "left").filter("at IS NULL OR depth < at")
    named = chain.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("depth", "name")), asc=False)["name"].alias("names"))  # as long as the tree is deep
    met = left.select("id", "name").join(parent.select("id", "parent_id"), "id", "left").join(named, "id", "left")
    return met.select("id", "parent_id", F.when(F.col("names").isNotNull(), F.concat_ws("/", F.array_join("names", "/"), "name")).alias("label"))


def minimal_nodes(nodes: DataFrame, members: DataFrame, closure: DataFrame, ghosts: DataFrame) -> DataFrame:
    """(id, role, parent_id, tier, label, n_files) of what is drawn.

    nodes: id, parent_id, kind, name; members: id, origin; ghosts: id. Member files are
    cards in the frames of their ancestors, with how many member files a frame holds; a
    member package is one card with all its files, a member declaration a card of its own,
    and neither has a frame. Members of the first selection (origin) are seeds, the
    others persistent. A member or a ghost is never a frame as well.
    """
    tier = F.when(F.col("origin"), "seed").otherwise("persistent").alias("tier")
    cards = nodes.join(members.select("id", "origin").distinct(), "id").select("id", "kind", "name", tier)
    files = cut(cards.filter("kind = 'module'").select("id", "name", "tier"))
    kept = closure.join(files.select("id"), "id", "left_semi")
    frames = contracted(nodes, kept.select(F.col("anc_id").alias("id")).distinct(), closure)
    counts = kept.filter("depth > 0").groupBy(F.col("anc_id").alias("id")).agg(F.count_distinct("id").alias("n_files"))
    none = F.lit(None)
    drawn = frames.join(files.select("id", "tier"), "id", "left").join(counts, "id", "left").join(nodes.select("id", "name"), "id")
    claimed = cards.filter("kind <> 'module'").select("id").unionByName(ghosts.select("id")).distinct()
    drawn = drawn.join(claimed, "id", "left_anti")
    role = F.when(F.col("tier").isNotNull(), "file").otherwise("group")
    inside = drawn.select("id", role.alias("role"), "parent_id", "tier", F.coalesce("label", "name").alias("label"), F.when(F.col("tier").isNull(), F.col("n_files")).alias("n_files"))
    code = cards.filter(F.col("kind").isin(*UNIT_KINDS, *BLOCK_KINDS))
    exact = code.select("id", F.when(F.col("kind").isin(*UNIT_KINDS), "unit").otherwise("block").alias("role"), none.cast("string").alias("parent_id"), "tier", F.col("name").alias("label"), none.cast("long").alias("n_files"))
    groups = cards.filter(~F.col("kind").isin("module", *UNIT_KINDS, *BLOCK_KINDS))
    below = closure.filter("depth > 0").join(nodes.filter("kind = 'module'").select("id"), "id", "left_semi").join(groups.select(F.col("id").alias("anc_id")), "anc_id", "left_semi")
    below = below.groupBy(F.col("anc_id").alias("id")).agg(F.count("*").alias("n_files"))
    whole = groups.join(below, "id", "left").select("id", F.lit("group").alias("role"), none.cast("string").alias("parent_id"), "tier", F.col("name").alias("label"), F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"))
    beyond = nodes.join(ghosts.select("id").distinct(), "id").join(members.select("id"), "id", "left_anti")
    beyond = beyond.select("id", F.lit("ghost").alias("role"), none.cast("string").alias("parent_id"), none.cast("string").alias("tier"), F.col("name").alias("label"), none.cast("long").alias("n_files"))
    return inside.unionByName(exact).unionByName(whole).unionByName(beyond)


def minimal_edges(nodes: DataFrame, edges: DataFrame, members: DataFrame, closure: DataFrame) -> DataFrame:
    """(what, kind, source, target, weight, cross_frame, cross_package) of the wires of the subgraph.

    what is import (between cards of two members), dep (by kind) or ghost (one end is the
    declaration itself, beyond every member). An import crosses a frame where its cards'
    nearest packages differ; a wire crosses a package where the owning packages (nodes:
    owns_files) of the ends of one of its edges do. edges: kind, source, target, weight.
    """
    near = cut(nearest(closure, members.select("id")))
    owner = cut(nearest(closure, nodes.filter("owns_files").select("id")).withColumnRenamed("near", "pkg"))
    frame = nearest(closure, nodes.filter("kind = 'package'").select("id")).withColumnRenamed("near", "frame")
    weight = F.coalesce("weight", F.lit(1))
    kinds = edges.filter(F.col("kind").isin("imports", *WIRE_KINDS)).groupBy("kind", "source", "target").agg(F.sum(weight).alias("weight"))
    met = kinds
    for end in ("source", "target"):
        met = met.join(near.select(F.col("id").alias(end), F.col("near").alias(f"{end}_box")), end, "left").join(owner.select(F.col("id").alias(end), F.col("pkg").alias(f"{end}_pkg")), end, "left")
    met = met.withColumn("crosses", ~F.col("source_pkg").eqNullSafe(F.col("target_pkg"))).filter("source_box IS NOT NULL OR target_box IS NOT NULL")
    both = met.filter("source_box <> target_box").groupBy("kind", F.col("source_box").alias("source"), F.col("target_box").alias("target")).agg(F.sum("weight").alias("weight"), F.bool_or("crosses").alias("cross_package"))
    framed = both.join(frame.select(F.col("id").alias("source"), F.col("frame").alias("f")), "source", "left").join(frame.select(F.col("id").alias("target"), F.col("frame").alias("g")), "target", "left")
    is_import = F.col("kind") == "imports"
    inside = framed.select(F.when(is_import, "import").otherwise("dep").alias("what"), "kind", "source", "target", "weight", (is_import & ~F.col("f").eqNullSafe(F.col("g"))).alias("cross_frame"), "cross_package")
    one = met.filter("kind <> 'imports' AND (source_box IS NULL OR target_box IS NULL)")
    ends = one.groupBy("kind", F.coalesce("source_box", "source").alias("source"), F.coalesce("target_box", "target").alias("target")).agg(F.sum("weight").alias("weight"), F.bool_or("crosses").alias("cross_package"))
    return inside.unionByName(ends.select(F.lit("ghost").alias("what"), "kind", "source", "target", "weight", F.lit(False).alias("cross_frame"), "cross_package"))


def ghost_ids(wires: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """(id): ends of ghost wires that are nodes and no members."""
    ends = wires.filter("what = 'ghost'").select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(members.select("id"), "id", "left_anti").join(nodes.select("id"), "id", "left_semi")


def minimal_subgraph(nodes: DataFrame, edges: DataFrame, members: DataFrame, closure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges drawn for members (id, origin); nodes: id, parent_id, kind, name, owns_files."""
    wires = cut(minimal_edges(nodes, edges, members, closure))
    return minimal_nodes(nodes, members, closure, ghost_ids(wires, nodes, members)), wires
