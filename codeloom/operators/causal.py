"""Causal slices: what leads to some seeds and what follows from them, over calls, channels and promises.

The search runs over states (node, gate), where a gate is the await that was just
crossed: behind it only effects go on that begin after the awaited expression in the
same file, and the next step leaves the gate. A promise that a callable returns is the
same resource, so such nodes are reached together at no cost; their groups are found
once, as components. Both directions go level by level over all states of a level.
Which arcs lie behind which await is one join by callable and file, on the last site of
an arc and the first end of an await, so that occurrences are not paired.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import cut, union

from .iterate import components

#: Kinds of edges that carry causes, by what they are; awaits point against time, aliases have no time.
ARC_KINDS = {
    "calls": "call", "instantiates": "instantiate", "sends": "send", "handles": "handle", "createsPromise": "create", "resolvesPromise": "resolve", "rejectsPromise": "reject",
    "awaitsPromise": "await", "returnsPromise": "alias",
}


def arcs(edges: DataFrame, nodes: DataFrame, least: float = 0.0) -> DataFrame:
    """(id, kind, source, target, confidence) of edges between nodes (id) from cause to effect.

    Edges that aren't resolved count only if they tell a confidence, which is cut to 0..1
    and is 1 where none is told; those below ``least`` are left out.
    """
    kind = F.create_map(*[F.lit(x) for pair in ARC_KINDS.items() for x in pair])[F.col("kind")]
    sure = F.coalesce(F.col("resolution") == "resolved", F.lit(True)) | F.col("confidence").isNotNull()
    turned = kind == "await"
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(1.0))))
    rows = edges.filter(sure & kind.isNotNull()).select("id", kind.alias("kind"), F.when(turned, F.col("target")).otherwise(F.col("source")).alias("source"), F.when(turned, F.col("source")).otherwise(F.col("target")).alias("target"), confidence.alias("confidence"))
    for end in ("source", "target"):
        rows = rows.join(nodes.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return rows.filter(F.col("confidence") >= least)


def behind_awaits(found: DataFrame, sites: DataFrame) -> DataFrame:
    """(gate, id) of arcs out of the awaiter that begin behind the await (gate): sites are id, file, line, col, end_line, end_col."""
    end = F.struct(F.coalesce("end_line", "line").alias("line"), F.col("end_col").isNull().alias("open"), F.col("end_col").alias("col"))
    stops = found.filter("kind = 'await'").select(F.col("id").alias("gate"), F.col("target").alias("at")).join(sites.withColumnRenamed("id", "gate"), "gate").groupBy("gate", "at", "file").agg(F.min(end).alias("stop"))
    begin = F.struct("line", F.coalesce("col", F.lit(-1)).alias("col"))
    starts = found.filter("kind NOT IN ('await', 'alias')").select("id", F.col("source").alias("at")).join(sites, "id").groupBy("id", "at", "file").agg(F.max(begin).alias("start"))
    line = F.col("start.line")
    later = (line > F.col("stop.line")) | ((line == F.col("stop.line")) & F.coalesce((F.col("start.col") >= 0) & (F.col("start.col") >= F.col("stop.col")), F.lit(False)))
    return stops.join(starts, ["at", "file"]).filter(later).select("gate", "id").distinct()


@dataclass(frozen=True)
class Slice:
    """nodes: id, causes, effects (distances, null where there is no way); arcs as :func:`arcs`; frontier: direction, id (where a bound cut something off); told: confidence, truncated."""

    nodes: DataFrame
    arcs: DataFrame
    frontier: DataFrame
    told: DataFrame


def causal_slice(nodes: DataFrame, edges: DataFrame, sites: DataFrame, seeds: DataFrame, max_depth: int = 8, max_nodes: int | None = 64, least: float = 0.0) -> Slice:
    """The slice around seeds (id) that are nodes.

    Causes are sought first, then effects; where a handler delivers to a node, only its
    deliveries are its causes. max_nodes bounds both together: where a level would pass it,
    its nodes are taken in the order of their ids, and what is left out is told by
    ``truncated`` and the frontier, as is what lies beyond max_depth. Seeds always stay.
    """
    known = cut(nodes.select("id").distinct())
    found = cut(arcs(edges, known, least))
    same = found.filter("kind = 'alias'")
    ends = same.select(F.col("source").alias("id")).union(same.select("target")).distinct()
    group = cut(components(ends, same)).select("id", F.col("root").alias("group"))
    later = cut(behind_awaits(found, sites))
    runtime = found.filter("kind <> 'alias'")
    delivered = runtime.filter("kind = 'handle'").select("target").distinct().withColumn("delivered", F.lit(True))
    incoming = runtime.join(delivered, "target", "left").filter("delivered IS NULL OR kind = 'handle'").select("id", "kind", F.col("target").alias("here"), F.col("source").alias("next"))
    outgoing = runtime.select("id", "kind", F.col("source").alias("here"), F.col("target").alias("next"))
    start = cut(seeds.select("id").distinct().join(known, "id", "left_semi"))
    room = None if max_nodes is None else max(max_nodes, start.count())
    admitted = [start]

    def with_aliases(states: DataFrame) -> DataFrame:
        """States (id, gate and by, the node they come from) and those of the same resource."""
        others = states.join(group, "id").drop("id").join(group, "group").drop("group")
        return states.unionByName(others.select(*states.columns)).groupBy("id", "gate").agg(F.min("by").alias("by"))

    def admit(states: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The states that have room, and the nodes from which others were left out."""
        states = cut(states)
        if room is None:
            admitted.append(states.select("id").distinct())
            return states, states.select(F.col("by").alias("id")).limit(0)
        fresh = cut(states.select("id").distinct().join(union(admitted), "id", "left_anti"))
        left = max(0, room - union(admitted).distinct().count())
        taken = cut(fresh.orderBy("id").limit(left))  # no more than room rows
        admitted.append(taken)
        out = fresh.join(taken, "id", "left_anti")
        return cut(states.join(out, "id", "left_anti")), states.join(out, "id", "left_semi").select(F.col("by").alias("id")).distinct()

    def walk(adjacency: DataFrame, gated: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
        none = F.lit(None).cast("string")
        first, lost = admit(with_aliases(start.select("id", none.alias("gate"), F.col("id").alias("by"))))
        levels, passed, frontier = [first.select("id", "gate", F.lit(0).alias("depth"))], [], [cut(lost)]
        for depth in range(max_depth + 1):
            ways = levels[-1].select(F.col("id").alias("here"), "gate").join(adjacency, "here")
            if gated:
                ways = ways.join(later.withColumn("ok", F.lit(True)), ["gate", "id"], "left").filter("gate IS NULL OR ok").drop("ok")
            ways = cut(ways.select("here", "id", "next", F.when(F.lit(gated) & (F.col("kind") == "await"), F.col("id")).alias("to_gate")))
            if ways.isEmpty():
                break
            if depth == max_depth:
                frontier.append(ways.select(F.col("here").alias("id")).distinct())
                break
            states = with_aliases(ways.select(F.col("next").alias("id"), F.col("to_gate").alias("gate"), F.col("here").alias("by")))
            kept, lost = admit(states)
            passed.append(ways.join(kept.select(F.col("id").alias("next")).distinct(), "next", "left_semi").select("id"))
            frontier.append(cut(lost))
            seen = union(levels).select(F.col("id").alias("_i"), F.col("gate").alias("_g"))
            level = kept.join(seen, (F.col("id") == F.col("_i")) & F.col("gate").eqNullSafe(F.col("_g")), "left_anti").select("id", "gate", F.lit(depth + 1).alias("depth"))
            levels.append(cut(level))
        depths = union(levels).groupBy("id").agg(F.min("depth").alias("depth"))
        ids = union(passed).distinct() if passed else found.select("id").limit(0)
        return cut(depths), cut(ids), cut(union(frontier).distinct())

    causes, back, cut_back = walk(incoming, False)
    effects, on, cut_on = walk(outgoing, True)
    slice_nodes = cut(causes.select("id", F.col("depth").alias("causes")).join(effects.select("id", F.col("depth").alias("effects")), "id", "full_outer"))
    own = found.join(back.unionByName(on).distinct(), "id", "left_semi").unionByName(same)
    for end in ("source", "target"):
        own = own.join(slice_nodes.select(F.col("id").alias(end)), end, "left_semi")
    own = cut(own.select(*found.columns))
    frontier = cut_back.select(F.lit("backward").alias("direction"), "id").unionByName(cut_on.select(F.lit("forward"), "id").toDF("direction", "id"))
    told = own.agg(F.coalesce(F.min("confidence"), F.lit(1.0)).alias("confidence")).join(frontier.agg((F.count("*") > 0).alias("truncated")))
    return Slice(slice_nodes, own, frontier, told)
