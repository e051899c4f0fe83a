"""Relations: policies, constructors, implementations, ghosts, causal arcs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union
from codeloom.functions.pairs import distinct_pairs

from .iterate import bfs
from .tree import nearest

#: Names of constructors; edge kinds that a causal slice reads against their direction.
CONSTRUCTORS = ("constructor", "__init__")
REVERSED = ("awaitsPromise", "handles")


def policies(kinds: DataFrame, kind_rules: DataFrame, family_rules: DataFrame, fallback: dict) -> DataFrame:
    """kinds (kind, family) with role, visible and weight: a kind's rule beats its family's, which beats the fallback."""
    names = ["role", "visible", "weight"]
    own = kind_rules.select("kind", *[F.col(n).alias(f"k_{n}") for n in names])
    family = family_rules.select("family", *[F.col(n).alias(f"f_{n}") for n in names])
    met = kinds.join(F.broadcast(own), "kind", "left").join(F.broadcast(family), "family", "left")
    return met.select("kind", "family", *[F.coalesce(f"k_{n}", f"f_{n}", F.lit(fallback[n])).alias(n) for n in names])


def shown(policy: DataFrame, overrides: DataFrame) -> DataFrame:
    """(kind, shown) of available kinds: what the user (kind, shown) says, else the policy; an ignored kind is never shown."""
    own = overrides.select("kind", F.col("shown").alias("own"))
    return policy.join(own, "kind", "left").select("kind", ((F.col("role") != "ignore") & F.coalesce("own", "visible")).alias("shown"))


def departures(policy: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides that differ from the policy; the others need not be kept."""
    return overrides.join(policy.select("kind", "visible"), "kind").filter("shown <> visible").select("kind", "shown")


def constructors(nodes: DataFrame) -> DataFrame:
    """(class, constructor, nth) of the constructor children of every class."""
    own = nodes.filter(F.col("display_name").isin(*CONSTRUCTORS) & F.col("parent_id").isNotNull())
    return own.select(F.col("parent_id").alias("class"), F.col("id").alias("constructor"), F.row_number().over(W.partitionBy("parent_id").orderBy("id")).alias("nth"))


def with_constructor_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges, and for each instantiation one more to every constructor of its class."""
    made = edges.filter("kind = 'instantiates'").join(constructors(nodes), F.col("target") == F.col("class"))
    return edges.select("kind", "source", "target").unionByName(made.select("kind", "source", F.col("constructor").alias("target")))


def to_constructors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with instantiations moved from the class to its first constructor, where it has one."""
    first = constructors(nodes).filter("nth = 1")
    met = edges.join(first, (F.col("target") == F.col("class")) & (F.col("kind") == "instantiates"), "left")
    return met.select("kind", "source", F.coalesce("constructor", "target").alias("target"))


def supertypes(edges: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """(id, super, depth): all that a type extends or implements, by the shortest way."""
    step = cut(edges.filter("kind IN ('extends', 'implements') AND source <> target").select("source", "target").distinct())
    levels = [step.select(F.col("source").alias("id"), F.col("target").alias("super"), F.lit(1).alias("depth"))]
    for depth in range(2, max_depth + 1):
        more = levels[-1].join(step, F.col("super") == F.col("source")).select("id", F.col("target").alias("super")).filter("id <> super").distinct()
        front = cut(more.join(union(levels).select("id", "super"), ["id", "super"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return union(levels)
        levels.append(front)
    raise Unsettled(f"types above each other in more than {max_depth} steps")


def implementations(members: DataFrame, interfaces: DataFrame, above: DataFrame) -> DataFrame:
    """(source, target, depth) from members (owner, id, name) of interfaces (id) to members of that name in types below (supertypes)."""
    asked = members.join(interfaces.select(F.col("id").alias("owner")), "owner", "left_semi").select(F.col("owner").alias("super"), F.col("id").alias("source"), "name")
    given = members.join(interfaces.select(F.col("id").alias("owner")), "owner", "left_anti").select("owner", F.col("id").alias("target"), "name")
    met = above.join(asked, "super").join(given, [F.col("id") == F.col("owner"), asked["name"] == given["name"]])
    return met.groupBy("source", "target").agg(F.min("depth").alias("depth"))


def ghosts(edges: DataFrame, near: DataFrame) -> DataFrame:
    """(visible, ghost, direction, weight) of edges of which one end only is below something visible (id, near)."""
    of = lambda end, name: near.select(F.col("id").alias(end), F.col("near").alias(name))
    met = edges.join(of("source", "s"), "source", "left").join(of("target", "t"), "target", "left")
    one = met.filter(F.col("s").isNull() != F.col("t").isNull())
    out = F.col("s").isNotNull()
    rows = one.select(F.coalesce("s", "t").alias("visible"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("ghost"), F.when(out, "out").otherwise("in").alias("direction"))
    return rows.groupBy("visible", "ghost", "direction").agg(F.count("*").alias("weight"))


def folded_ghosts(wires: DataFrame, nodes: DataFrame, more_than: int = 3) -> DataFrame:
    """Wires of :func:`ghosts` whose ghost gives way to its parent where that has more than so many in one direction."""
    parents = nodes.select(F.col("id").alias("ghost"), "parent_id")
    placed = wires.join(parents, "ghost", "left")
    crowded = placed.filter("parent_id IS NOT NULL").groupBy("direction", "parent_id").agg(F.count_distinct("ghost").alias("n")).filter(F.col("n") > more_than)
    met = placed.join(crowded, ["direction", "parent_id"], "left")
    shown = F.when(F.col("n").isNotNull(), F.col("parent_id")).otherwise(F.col("ghost"))
    return met.groupBy("visible", shown.alias("ghost"), "direction").agg(F.sum("weight").alias("weight"))


def rolled_seeds(seeds: DataFrame, nodes: DataFrame, least: int = 3) -> DataFrame:
    """(id, n): seeds (id), those of one package with ``least`` or more rolled up to it."""
    placed = seeds.join(nodes.select("id", "parent_id"), "id")
    sizes = placed.groupBy("parent_id").agg(F.count("*").alias("n"))
    met = placed.join(sizes, "parent_id", "left")
    whole = F.col("parent_id").isNotNull() & (F.col("n") >= least)
    return met.groupBy(F.when(whole, F.col("parent_id")).otherwise(F.col("id")).alias("id")).agg(F.count("*").alias("n"))


def causal_arcs(edges: DataFrame) -> DataFrame:
    """Edges from cause to effect; where a target has a handler, only its handlers cause it."""
    back = F.col("kind").isin(*REVERSED)
    arcs = edges.select("kind", F.when(back, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(back, F.col("source")).otherwise(F.col("target")).alias("target"))
    handled = arcs.filter("kind = 'handles'").select("target").distinct().withColumn("handled", F.lit(True))
    return arcs.join(handled, "target", "left").filter(F.col("handled").isNull() | (F.col("kind") == "handles")).select("kind", "source", "target")


def causal_slice(arcs: DataFrame, seeds: DataFrame, depth: int = 8) -> DataFrame:
    """(id, causes, effects): distances up to ``depth`` against and along the arcs from seeds (id); null where there is no way."""
    turned = arcs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    before = bfs(seeds, turned, max_depth=depth).select("id", F.col("distance").alias("causes"))
    after = bfs(seeds, arcs, max_depth=depth).select("id", F.col("distance").alias("effects"))
    return before.join(after, "id", "full_outer")


def collision_ordinals(nodes: DataFrame, base: str, order: list[Column]) -> DataFrame:
    """nodes with ``ordinal``: 0 for the first node of a base id, then 1, 2 and so on."""
    return nodes.withColumn("ordinal", F.row_number().over(W.partitionBy(base).orderBy(*order)) - 1)


def extraction_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, kind, n): nodes by kind, edges by kind and by resolution, a missing one read as resolved."""
    by = lambda df, what, kind: df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return by(nodes, "node", F.col("kind")).unionByName(by(edges, "edge", F.col("kind"))).unionByName(by(edges, "resolution", F.coalesce("resolution", F.lit("resolved"))))


def _first_and_last(sites: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """Per edge and file the last site of a candidate and the first end of a boundary, and whether the one comes after the other."""
    begins = sites.groupBy(F.col("edge").alias("candidate"), "file").agg(F.max(F.struct("line", F.coalesce("col", F.lit(-1)).alias("col"))).alias("last"))
    stop = F.struct(F.coalesce("end_line", "line").alias("line"), F.coalesce("end_col", F.lit(2**31 - 1)).alias("col"))
    ends = sites.groupBy(F.col("edge").alias("boundary"), "file").agg(F.min(stop).alias("first"))
    later = (F.col("last.line") > F.col("first.line")) | ((F.col("last.line") == F.col("first.line")) & (F.col("last.col") >= F.col("first.col")))
    return begins, ends, later


def occurs_after(pairs: DataFrame, sites: DataFrame) -> DataFrame:
    """(candidate, boundary) of pairs of edge ids of which a site of the one begins after one of the other in the same file.

    sites: edge, file, line, col, end_line, end_col. Only the last site of the candidate
    and the first end of the boundary in a file matter. On one line both columns must be known.
    """
    begins, ends, later = _first_and_last(sites)
    met = pairs.select("candidate", "boundary").distinct().join(begins, "candidate").join(ends, ["boundary", "file"])
    return met.filter(later).select("candidate", "boundary").distinct()


def occurs_after_in_groups(candidates: DataFrame, boundaries: DataFrame, sites: DataFrame) -> DataFrame:
    """:func:`occurs_after` of all candidates (candidate, group) and boundaries (boundary, group) of one group, without writing out their pairs."""
    begins, ends, later = _first_and_last(sites)
    placed = lambda df, name, of: df.select(name, "group").distinct().join(of, name)
    return distinct_pairs(placed(candidates, "candidate", begins), placed(boundaries, "boundary", ends), ["group", "file"], "candidate", "boundary", later)


#: Edges by which a flow makes a promise its own.
PROMISES = ("returnsPromise", "resolvesPromise", "rejectsPromise")


def promise_groups(flows: DataFrame, edges: DataFrame, promises: DataFrame) -> DataFrame:
    """(flow, lead, promise) of flows (flow, place): those that have to do with just one promise and share it stand together, led by one that returns it.

    Other flows lead themselves and have no promise. promises: id.
    """
    own = edges.filter(F.col("kind").isin(*PROMISES) & (F.coalesce("resolution", F.lit("resolved")) == "resolved"))
    own = own.join(promises.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("flow"), F.col("target").alias("promise"), (F.col("kind") == "returnsPromise").alias("returns"))
    one = own.groupBy("flow").agg(F.count_distinct("promise").alias("n"), F.min("promise").alias("promise"), F.bool_or("returns").alias("returns")).filter("n = 1")
    placed = flows.join(one, "flow", "left").select("flow", "place", "promise", F.coalesce("returns", F.lit(False)).alias("returns"))
    first = F.min(F.struct((~F.col("returns")).alias("no"), "place", "flow")).alias("first")
    shared = placed.filter("promise IS NOT NULL").groupBy("promise").agg(F.count("*").alias("n"), first).filter("n > 1")
    met = placed.join(shared.select("promise", F.col("first.flow").alias("lead"), F.lit(True).alias("together")), "promise", "left")
    return met.select("flow", F.coalesce("lead", "flow").alias("lead"), F.when(F.col("together"), F.col("promise")).alias("promise"))


def flow_changes(steps: DataFrame, changed: DataFrame) -> DataFrame:
    """(flow, target, status, place): what changed in each flow, its owner first, then what it surely calls, in order, each once.

    steps: flow, path, kind, target, resolution, with paths that sort as they run; changed: id, status.
    """
    calls = steps.filter("kind = 'call' AND target IS NOT NULL AND resolution = 'resolved'").select("flow", "target", "path")
    own = steps.select("flow").distinct().select("flow", F.col("flow").alias("target"), F.lit("").alias("path"))
    every = calls.unionByName(own).groupBy("flow", "target").agg(F.min("path").alias("path"))
    met = every.join(changed.select(F.col("id").alias("target"), "status"), "target")
    return met.select("flow", "target", "status", F.row_number().over(W.partitionBy("flow").orderBy("path", "target")).alias("place"))


def linearisations(classes: DataFrame, bases: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, mro) of classes (id, complete) with bases (id, base, ord): the C3 order of each; null where a class or one above it
    isn't complete, is in a circle, or has bases whose orders disagree.

    A round settles the classes all of whose bases are settled; the merging of a class's few lists is a small function of its row.
    """

    @F.udf("array<string>")
    def merged(own, above, direct):
        lists, out = [list(x) for x in above] + [list(direct)], [own]
        while lists := [x for x in lists if x]:
            head = next((x[0] for x in lists if all(x[0] not in y[1:] for y in lists)), None)
            if head is None:
                return None
            out.append(head)
            lists = [x[1:] if x[0] == head else x for x in lists]
        return out

    links = cut(bases.select("id", "base", "ord").distinct())
    left = cut(classes.filter("complete").select("id").distinct())
    done = [cut(left.join(links.select("id"), "id", "left_anti").select("id", F.array("id").alias("mro")))]
    for _ in range(max_rounds):
        left = cut(left.join(done[-1].select("id"), "id", "left_anti"))
        settled = union(done)
        met = left.join(links, "id").join(settled.select(F.col("id").alias("base"), F.lit(True).alias("ok"), "mro"), "base", "left")
        ready = met.groupBy("id").agg(F.min(F.coalesce("ok", F.lit(False))).alias("all"), F.sort_array(F.collect_list(F.struct("ord", "base", "mro"))).alias("b")).filter("all")
        above, direct = F.transform("b", lambda x: x["mro"]), F.transform("b", lambda x: x["base"])
        order = merged("id", F.transform(above, lambda x: F.coalesce(x, F.array().cast("array<string>"))), direct)
        new = cut(ready.select("id", F.when(F.forall(above, lambda x: x.isNotNull()), order).alias("mro")))
        if new.isEmpty():
            return classes.select("id").distinct().join(settled, "id", "left")
        done.append(new)
    raise Unsettled(f"classes above each other in more than {max_rounds} steps")


def folder_ghosts(edges: DataFrame, nodes: DataFrame, closure: DataFrame, visible: DataFrame) -> DataFrame:
    """(source, target, kind, weight, members) of wires between visible packages (visible: id) and packages that aren't drawn.

    An edge of which one end is below a visible package and the other below nothing that
    is visible goes to the package above the other end that is as many packages deep as
    the visible one, or to its deepest; members is how many modules it stands for.
    """
    packages = nodes.filter("kind = 'package'").select(F.col("id").alias("anc_id"))
    tiers = closure.join(packages, "anc_id", "left_semi").withColumn("tier", F.row_number().over(W.partitionBy("id").orderBy(F.desc("depth"))))
    tiers = cut(tiers.select("id", F.col("anc_id").alias("package"), "tier"))
    deepest = tiers.groupBy("id").agg(F.max("tier").alias("most"))
    near = nearest(closure, visible)
    modules = nearest(closure, nodes.filter("kind = 'module'").select("id")).withColumnRenamed("near", "module")
    weight = F.coalesce("weight", F.lit(1)) if "weight" in edges.columns else F.lit(1)
    rows = edges.select("kind", "source", "target", weight.alias("weight"))
    of = lambda end: near.select(F.col("id").alias(end), F.col("near").alias(f"_{end}"))
    met = rows.join(of("source"), "source", "left").join(of("target"), "target", "left").filter(F.col("_source").isNull() != F.col("_target").isNull())
    out = F.col("_source").isNotNull()
    far = met.select("kind", "weight", out.alias("out"), F.coalesce("_source", "_target").alias("anchor"), F.when(out, F.col("target")).otherwise(F.col("source")).alias("far"))
    anchors = visible.join(packages, visible["id"] == packages["anc_id"], "left_semi").join(deepest, "id").select(F.col("id").alias("anchor"), F.col("most").alias("wanted"))
    placed = far.join(anchors, "anchor").join(deepest.select(F.col("id").alias("far"), "most"), "far").withColumn("tier", F.least("wanted", "most"))
    peers = placed.join(tiers.select(F.col("id").alias("far"), "tier", "package"), ["far", "tier"])
    peers = peers.filter("package <> anchor").join(visible.select(F.col("id").alias("package")), "package", "left_anti").join(modules.select(F.col("id").alias("far"), "module"), "far", "left")
    source, target = F.when(F.col("out"), F.col("anchor")).otherwise(F.col("package")), F.when(F.col("out"), F.col("package")).otherwise(F.col("anchor"))
    return peers.groupBy(source.alias("source"), target.alias("target"), "kind").agg(F.sum("weight").alias("weight"), F.count_distinct("module").alias("members"))
