"""Operators over containment: nodes (id, parent_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union


#: Chains of parents that are longer than this are looked at for circles.
LONG_CHAIN = 16


def ancestors(nodes: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(id, anc_id, depth), each node its own ancestor at depth 0; a chain of parents that runs into a circle ends where it closes."""
    parents = cut(nodes.select("id", "parent_id"))
    known = parents.select(F.col("id").alias("_p"))
    links = parents.join(known, F.col("parent_id") == F.col("_p"), "left_semi").filter("parent_id <> id")
    up = cut(links.select(F.col("id").alias("anc_id"), F.col("parent_id").alias("next")))
    levels = [parents.select("id", F.col("id").alias("anc_id"), F.lit(0).alias("depth"))]
    closed = None
    for depth in range(1, max_depth + 1):
        level = levels[-1].join(up, "anc_id").select("id", F.col("next").alias("anc_id"), F.lit(depth).alias("depth"))
        if closed is not None:
            level = level.join(union(levels[closed:]).select("id", "anc_id"), ["id", "anc_id"], "left_anti")
        level = cut(level)
        if level.isEmpty():
            return union(levels)
        levels.append(level)
        if depth == LONG_CHAIN:  # only what still goes on can be in a circle: its ancestors count once, at their first depth
            going, every = level.select("id").distinct(), union(levels)
            ended = every.join(going, "id", "left_anti")
            first = cut(every.join(going, "id", "left_semi").groupBy("id", "anc_id").agg(F.min("depth").alias("depth")))
            levels, closed = [ended, first.filter(F.col("depth") < depth), first.filter(F.col("depth") == depth)], 1
    raise Unsettled(f"chains of more than {max_depth} parents")


#: The rank of kinds from the top; unknown kinds rank lowest.
RANKS = {"package": 0, "module": 1, "namespace": 1, "class": 2, "object": 2, "interface": 2, "enum": 2, "typeAlias": 2}


def within_rank(nodes: DataFrame, most: int) -> DataFrame:
    """nodes of kinds that rank ``most`` or less."""
    rank = F.lit(max(RANKS.values()) + 1)
    for kind, r in RANKS.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    return nodes.filter(rank <= most)


def package_scopes(nodes: DataFrame, root: str = "root") -> DataFrame:
    """(id, scope): the nearest package of every node that has one."""
    found = nearest(ancestors(nodes), nodes.filter("kind = 'package'").select("id"))
    return found.select("id", F.coalesce("near", F.lit(root)).alias("scope"))


def overview_roots(nodes: DataFrame, files: DataFrame, owning: DataFrame) -> DataFrame:
    """(file, root) of files (id): the nearest package that owns its files (owning: id), else the topmost package above it that holds no such root, else the file."""
    closure = cut(ancestors(nodes))
    near = cut(nearest(closure, owning).join(files.select("id"), "id", "left_semi"))
    packages = nodes.filter("kind = 'package'").select(F.col("id").alias("anc_id"))
    roots = near.select(F.col("near").alias("id")).distinct()
    blocked = closure.filter("depth > 0").join(roots, "id", "left_semi").select("anc_id").distinct()
    free = files.select("id").join(near.select("id"), "id", "left_anti")
    above = closure.filter("depth > 0").join(free, "id", "left_semi").join(packages, "anc_id", "left_semi").join(blocked, "anc_id", "left_anti")
    top = above.groupBy("id").agg(F.max_by("anc_id", "depth").alias("top"))
    met = files.select("id").join(near, "id", "left").join(top, "id", "left")
    return met.select(F.col("id").alias("file"), F.coalesce("near", "top", "id").alias("root"))


def nearest(closure: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, near): the nearest ancestor-or-self of each node that is in chosen (id)."""
    met = closure.join(chosen.select(F.col("id").alias("anc_id")).distinct(), "anc_id")
    return met.groupBy("id").agg(F.min_by("anc_id", "depth").alias("near"))


def descendant_counts(closure: DataFrame, marked: DataFrame) -> DataFrame:
    """(id, n): how many proper descendants of each node are in marked (id)."""
    met = closure.filter("depth > 0").join(marked.select("id").distinct(), "id")
    return met.groupBy(F.col("anc_id").alias("id")).agg(F.count("*").alias("n"))


def common_ancestor(closure: DataFrame, chosen: DataFrame) -> DataFrame:
    """(id, depth_sum): the deepest node above all of chosen (id); no row where none is."""
    want = chosen.select("id").distinct()
    met = closure.join(want, "id").groupBy("anc_id").agg(F.count("*").alias("n"), F.sum("depth").alias("depth_sum"))
    size = want.agg(F.count("*").alias("size"))
    return met.join(F.broadcast(size), F.col("n") == F.col("size")).orderBy("depth_sum", "anc_id").limit(1).select(F.col("anc_id").alias("id"), "depth_sum")


def closed_tests(nodes: DataFrame, seeds: DataFrame, closure: DataFrame | None = None, max_rounds: int = 1_000) -> DataFrame:
    """(id): seeds, all below them, and parents all of whose children are tests, until nothing is added."""
    closure = ancestors(nodes) if closure is None else closure
    found = [cut(closure.join(seeds.select(F.col("id").alias("anc_id")), "anc_id", "left_semi").select("id").distinct())]
    children = nodes.filter("parent_id IS NOT NULL").select("id", "parent_id")
    for _ in range(max_rounds):
        tests = union(found)
        marked = children.join(tests.withColumn("t", F.lit(True)), "id", "left")
        full = marked.groupBy("parent_id").agg(F.min(F.coalesce("t", F.lit(False))).alias("all")).filter("all").select(F.col("parent_id").alias("id"))
        new = cut(full.join(nodes.select("id"), "id", "left_semi").join(tests, "id", "left_anti"))
        if new.isEmpty():
            return tests
        found.append(new)
    raise Unsettled(f"tests are nested deeper than {max_rounds}")


def preorder(nodes: DataFrame, order: list[Column], max_depth: int = 1_000) -> DataFrame:
    """(id, depth, path) of nodes (id, parent_id): paths of sibling places sort as the tree is read from the top.

    Roots are nodes without a parent among the nodes; what hangs below a cycle has no path.
    """
    known = nodes.select(F.col("id").alias("_p"))
    linked = nodes.join(known, F.col("parent_id") == F.col("_p"), "left").withColumn("parent_id", F.col("_p")).drop("_p")
    place = F.lpad(F.row_number().over(W.partitionBy("parent_id").orderBy(*order)).cast("string"), 8, "0")
    children = cut(linked.filter("parent_id IS NOT NULL").withColumn("_place", place).select("id", "parent_id", "_place"))
    # roots may be many, so they are told apart by their id and not by a place among all of them
    level = cut(linked.filter("parent_id IS NULL").select("id", F.lit(0).alias("depth"), F.col("id").cast("string").alias("path")))
    levels = level
    for depth in range(1, max_depth + 1):
        above = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_above"))
        level = cut(children.join(above, "parent_id").select("id", F.lit(depth).alias("depth"), F.concat("_above", F.lit("/"), "_place").alias("path")))
        if level.isEmpty():
            return levels
        levels = levels.unionByName(level)
    raise Unsettled(f"a tree deeper than {max_depth}")


def first_of(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
