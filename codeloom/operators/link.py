"""Linking of artifacts: ids set apart by system, HTTP calls met with templates, statistics of the joints.

Ports: system, owner, handler, direction, protocol, channel, lane, scope, scope_kind,
confidence. Ids of shared spaces (outside packages, channels) are the same in all systems.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import edge_id, node_id, parse_node_id
from codeloom.functions.scalars import channel_id, http_method, http_path

#: Languages of ids that all systems share, and what a single artifact has made of its channels.
SHARED = ("ext", "unresolved", "ipc")
CHANNEL, CHANNEL_EDGES = "channel", ("sends", "handles")


def system_id(name: Column) -> Column:
    return F.concat(F.lit("sys:"), F.replace(F.regexp_replace(name, r"\s+", "-"), F.lit("#"), F.lit("%23")))


def placed_id(own: Column, system: Column) -> Column:
    """The id with its module path below the system's name; shared ids stay."""
    p = parse_node_id(own)
    return F.when(p["lang"].isin(*SHARED), own).otherwise(node_id(p["lang"], F.concat(system, F.lit("/"), p["module_path"]), p["qualname"], p["ordinal"]))


def linked_nodes(nodes: DataFrame) -> DataFrame:
    """id, kind, parent_id, file of all systems' nodes (system, id, kind, parent_id, file, ord) below one root for each system.

    Channels of single artifacts go. A node of several systems is told as by the first one.
    """
    own = nodes.filter(F.col("kind") != CHANNEL).withColumn("_id", placed_id(F.col("id"), F.col("system")))
    shared = F.col("_id") == F.col("id")
    parent = F.when(shared, F.col("parent_id")).when(F.col("parent_id").isNull(), system_id(F.col("system"))).otherwise(placed_id(F.col("parent_id"), F.col("system")))
    file = F.when(shared, F.col("file")).otherwise(F.concat("system", F.lit("/"), "file"))
    rows = own.select("_id", F.struct("system", "ord", "kind", parent.alias("parent_id"), file.alias("file")).alias("r"))
    first = rows.groupBy(F.col("_id").alias("id")).agg(F.min("r").alias("r")).select("id", "r.kind", "r.parent_id", "r.file")
    none = F.lit(None).cast("string")
    roots = nodes.select("system").distinct().select(system_id(F.col("system")).alias("id"), F.lit("system").alias("kind"), none.alias("parent_id"), F.col("system").alias("file"))
    return first.unionByName(roots)


def linked_edges(edges: DataFrame) -> DataFrame:
    """id, kind, source, target of all systems' edges (system, kind, source, target), without those of single artifacts' channels."""
    rows = edges.filter(~F.col("kind").isin(*CHANNEL_EDGES)).withColumns({c: placed_id(F.col(c), F.col("system")) for c in ("source", "target")})
    return rows.select(edge_id(F.col("kind"), F.col("source"), F.col("target")).alias("id"), "kind", "source", "target", "system")


def linked_ports(ports: DataFrame) -> DataFrame:
    """ports with owners and handlers set apart; a scope of one artifact becomes a global one with the system's name."""
    own = F.col("scope").isNotNull() & (F.col("scope_kind") == "artifact")
    scope = F.when(own, F.concat(F.lit("artifact:"), "system", F.lit("/"), "scope")).otherwise(F.col("scope"))
    return ports.withColumns({
        "owner": placed_id(F.col("owner"), F.col("system")), "handler": placed_id(F.col("handler"), F.col("system")), "scope": scope,
        "scope_kind": F.when(own, "global").otherwise(F.col("scope_kind")),
    })


def unified_http(ports: DataFrame) -> DataFrame:
    """ports; HTTP calls take the channel of the one most specific template of their method, scope and length (joined is then true).

    Templates are the channels of incoming HTTP ports; a call that is a template itself, or that two templates fit equally well, stays.
    """
    http = F.col("channel").isNotNull() & (F.col("protocol") == "http")

    def shaped(rows: DataFrame, name: str) -> DataFrame:
        path = http_path(F.col("channel"))
        parts = F.split(F.btrim(path, F.lit("/")), "/")
        return rows.select(http_method(F.col("channel")).alias("method"), F.coalesce("scope", F.lit("\x00")).alias("scope"), path.alias(name), parts.alias(f"{name}_parts"), F.size(parts).alias("n")).distinct()

    wild = lambda p: p.startswith(":") | (p == "*")
    calls, templates = shaped(ports.filter(http & (F.col("direction") == "out")), "call"), shaped(ports.filter(http & (F.col("direction") == "in")), "template")
    fits = F.forall(F.zip_with("call_parts", "template_parts", lambda a, b: (a == b) | wild(b)), lambda x: x)
    met = calls.join(templates, ["method", "scope", "n"]).filter(fits).withColumn("wild", F.size(F.filter("template_parts", wild)))
    best = met.groupBy("method", "scope", "call").agg(F.min("wild").alias("wild"))
    won = met.join(best, ["method", "scope", "call", "wild"]).groupBy("method", "scope", "call").agg(F.count("*").alias("k"), F.min("template").alias("template"))
    moved = won.filter("k = 1 AND template <> call").select(F.col("method").alias("_method"), F.col("scope").alias("_scope"), F.col("call").alias("_call"), "template")
    asks = http & (F.col("direction") == "out")
    same = asks & (http_method(F.col("channel")) == F.col("_method")) & (F.coalesce("scope", F.lit("\x00")) == F.col("_scope")) & (http_path(F.col("channel")) == F.col("_call"))
    out = ports.join(moved, same, "left").withColumn("joined", F.col("template").isNotNull())
    return out.withColumn("channel", F.when(F.col("joined"), F.concat("_method", F.lit(" "), "template")).otherwise(F.col("channel"))).drop("_method", "_scope", "_call", "template")


def joint_stats(ports: DataFrame) -> DataFrame:
    """One row over :func:`unified_http`'s ports: systems, channels, those with two systems' sides, those with one side only, and calls that took a template."""
    named = ports.filter("channel IS NOT NULL")
    side = lambda d: F.collect_set(F.when(F.col("direction") == d, F.col("system")))  # noqa: E731  at most all systems
    sides = named.groupBy("protocol", "lane", "scope", "channel").agg(side("out").alias("outs"), side("in").alias("ins"))
    dangling = (F.size("outs") == 0) | (F.size("ins") == 0)
    across = ~dangling & (F.size(F.array_union("outs", "ins")) > 1)
    told = sides.agg(F.count("*").alias("channels"), F.count_if(across).alias("cross_system"), F.count_if(dangling).alias("dangling"))
    all_ = ports.agg(F.count_distinct("system").alias("systems"), F.count_if("joined").alias("template_joins"))
    return all_.join(F.broadcast(told))


def channel_graph(ports: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kind, source, target, resolution, confidence, weight) of sends and handles edges of ports whose owner is a node (id).

    A handler stands in for the owner of an incoming port; an edge that is there already isn't made again.
    """
    known = nodes.select(F.col("id").alias("_end")).distinct()
    channel = channel_id(F.col("protocol"), F.col("channel"), F.col("lane"), F.col("scope"))
    end = F.when(F.col("direction") == "in", F.coalesce("handler", "owner")).otherwise(F.col("owner"))
    rows = ports.filter("channel IS NOT NULL").withColumn("_channel", channel).withColumn("_end", end).join(known, "_end", "left_semi")
    out = F.col("direction") == "out"
    made = rows.select(
        F.when(out, "sends").otherwise("handles").alias("kind"), F.when(out, F.col("_end")).otherwise(F.col("_channel")).alias("source"),
        F.when(out, F.col("_channel")).otherwise(F.col("_end")).alias("target"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
    )
    sure = F.bool_or(F.col("confidence") >= 1)
    one = made.groupBy("kind", "source", "target").agg(F.count("*").alias("weight"), F.when(sure, "resolved").otherwise("unresolved").alias("resolution"), F.max("confidence").alias("confidence"))
    one = one.withColumn("id", edge_id(F.col("kind"), F.col("source"), F.col("target")))
    return one.join(edges.select("id").distinct(), "id", "left_anti")
