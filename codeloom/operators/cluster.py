"""Service clusters: ownership by breadth-first search, partition measures, local moves.

Clustering is done in rounds of joins over the whole graph. In a round each node of one
half, drawn by a hash of node and round, moves to the neighbouring group that gains most,
so no round depends on the order of nodes and no group is ever gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union

#: Edges through which a service owns what it uses.
OWNERSHIP = ("registers", "binds", "provides", "injects", "owns", "aliases", "instantiates")


def owned(seeds: DataFrame, edges: DataFrame, max_depth: int = 1_000) -> DataFrame:
    """(id, owner, distance): every node goes to the nearest seed (id) along edges, the smaller id where two are as near."""
    steps = cut(edges.select("source", "target").distinct())
    levels = [cut(seeds.select("id").distinct().select("id", F.col("id").alias("owner"), F.lit(0).alias("distance")))]
    for depth in range(1, max_depth + 1):
        met = levels[-1].join(steps, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(F.min("owner").alias("owner"))
        front = cut(met.join(union(levels).select("id"), "id", "left_anti").withColumn("distance", F.lit(depth)))
        if front.isEmpty():
            return union(levels)
        levels.append(front)
    raise Unsettled(f"ownership reaches further than {max_depth} steps")


def seeds(units: DataFrame, degrees: DataFrame, named: Column, share: int = 10) -> DataFrame:
    """(id): units whose name says so; where none does, the tenth with the largest degree times one plus afferents."""
    chosen = units.filter(named).select("id")
    if not chosen.isEmpty():
        return chosen
    ranked = degrees.withColumn("rank", (F.col("ce") + F.col("ca")) * (1 + F.col("ca")))
    return ranked.orderBy(F.desc("rank"), "id").limit(max(1, units.count() // share)).select("id")


def lifted_pairs(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(source, target, weight, n) between different groups (id, group) of the ends of edges."""
    of = lambda end, name: groups.select(F.col("id").alias(end), F.col("group").alias(name))
    met = edges.join(of("source", "gs"), "source").join(of("target", "gt"), "target").filter("gs <> gt")
    return met.groupBy(F.col("gs").alias("source"), F.col("gt").alias("target")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def group_degrees(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """("group", members, ce, ca): distinct groups used and using."""
    pairs = lifted_pairs(edges, groups)
    out = pairs.groupBy(F.col("source").alias("group")).agg(F.count("*").alias("ce"))
    back = pairs.groupBy(F.col("target").alias("group")).agg(F.count("*").alias("ca"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    zero = F.lit(0).cast("long")
    return sizes.join(out, "group", "left").join(back, "group", "left").select("group", "members", F.coalesce("ce", zero).alias("ce"), F.coalesce("ca", zero).alias("ca"))


def _flows(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Per group: weight inside, and weight of edges with one end in it; edges (a, b, weight) are unordered."""
    of = lambda end: groups.select(F.col("id").alias(end), F.col("group").alias(f"g{end}"))
    met = edges.join(of("a"), "a").join(of("b"), "b")
    same = F.col("ga") == F.col("gb")
    ends = met.select(F.col("ga").alias("group"), F.when(same, F.col("weight")).alias("inner"), F.when(~same, F.col("weight")).alias("outer")).unionByName(
        met.filter(~same).select(F.col("gb").alias("group"), F.lit(None).cast("double").alias("inner"), F.col("weight").alias("outer"))
    )
    zero = F.lit(0.0)
    sums = ends.groupBy("group").agg(F.coalesce(F.sum("inner"), zero).alias("inner"), F.coalesce(F.sum("outer"), zero).alias("outer"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    return sizes.join(sums, "group", "left").select("group", "members", F.coalesce("inner", zero).alias("inner"), F.coalesce("outer", zero).alias("outer"))


def measure(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: groups, the largest, weight and number of cut edges, and pairs of groups with a cut edge."""
    of = lambda end: groups.select(F.col("id").alias(end), F.col("group").alias(f"g{end}"))
    crossing = edges.join(of("a"), "a").join(of("b"), "b").filter("ga <> gb")
    between = crossing.groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    totals = between.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("cut_weight"), F.coalesce(F.sum("n"), F.lit(0)).alias("cut_edges"), F.count("*").alias("quotient_edges"))
    sizes = groups.groupBy("group").agg(F.count("*").alias("n")).agg(F.count("*").alias("groups"), F.max("n").alias("largest"))
    return sizes.join(F.broadcast(totals))


def qualities(edges: DataFrame, groups: DataFrame, resolution: float) -> DataFrame:
    """One row: constant Potts quality, modularity, and the sum of cluster factors (2 inner over 2 inner plus outer)."""
    flows = _flows(edges, groups)
    total = edges.agg(F.sum("weight").alias("m"))
    potts = F.col("inner") - resolution * F.col("members") * (F.col("members") - 1) / 2
    degree = 2 * F.col("inner") + F.col("outer")
    modular = F.col("inner") / F.col("m") - F.pow(degree / (2 * F.col("m")), F.lit(2))
    factor = F.when(F.col("inner") > 0, 2 * F.col("inner") / degree).otherwise(F.lit(0.0))
    return flows.join(F.broadcast(total)).agg(F.sum(potts).alias("cpm"), F.sum(modular).alias("modularity"), F.sum(factor).alias("mq"))


def local_moves(nodes: DataFrame, edges: DataFrame, gain, rounds: int = 12, most: int | None = None) -> DataFrame:
    """(id, group): from single nodes, rounds of moves to the neighbouring group with the largest gain.

    ``gain(w, n, d, dg)`` rates a group from the weight between node and group, the
    group's size and degree without the node, and the node's degree. No group ever has
    more than ``most`` members: of those that want to join one, the ones that gain most
    get its free places, the others stay. ``rounds`` is how often nodes move at most; what
    comes out is a partition whose quality is to be measured, not a fixpoint.
    """
    ends = edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    near = cut(ends.filter("a <> b").groupBy(F.col("a").alias("id"), F.col("b").alias("other")).agg(F.sum("weight").alias("weight")))
    degree = cut(nodes.select("id").distinct().join(near.groupBy("id").agg(F.sum("weight").alias("d")), "id", "left").select("id", F.coalesce("d", F.lit(0.0)).alias("d")))
    groups = cut(degree.select("id", F.col("id").alias("group")))
    for number in range(rounds):
        sizes = groups.join(degree, "id").groupBy("group").agg(F.count("*").alias("n"), F.sum("d").alias("dg"))
        towards = near.join(groups.select(F.col("id").alias("other"), "group"), "other").groupBy("id", "group").agg(F.sum("weight").alias("w"))
        own = groups.select("id", F.col("group").alias("now"))
        stay = own.select("id", F.col("now").alias("group"), F.lit(0.0).alias("w"))
        options = towards.unionByName(stay).groupBy("id", "group").agg(F.sum("w").alias("w"))
        mine = F.col("group") == F.col("now")
        without = lambda total, part: F.col(total) - F.when(mine, part).otherwise(F.lit(0))
        rated = options.join(own, "id").join(degree, "id").join(sizes, "group")
        if most is not None:
            rated = rated.filter(mine | (F.col("n") < most))
        rated = rated.withColumn("g", gain(F.col("w"), without("n", F.lit(1)), F.col("d"), without("dg", F.col("d"))))
        top = F.max(F.struct("g", mine.cast("int").alias("own"), "group", "n")).alias("top")
        best = rated.groupBy("id").agg(top, F.min("now").alias("now")).select("id", "now", F.col("top.group").alias("best"), "top.g", "top.n")
        turn = (F.pmod(F.xxhash64("id", F.lit(number)), F.lit(2)) == 0) & (F.col("best") != F.col("now"))
        chosen = best.withColumn("turn", turn)
        if most is not None:  # the free places of a group, as it was before the round
            place = F.row_number().over(W.partitionBy("best", "turn").orderBy(F.desc("g"), "id"))
            chosen = chosen.withColumn("turn", F.col("turn") & (place <= most - F.col("n")))
        moved = cut(chosen.select("id", F.when(F.col("turn"), F.col("best")).otherwise(F.col("now")).alias("group"), (F.col("best") != F.col("now")).alias("wants")))
        groups = moved.select("id", "group")
        if not moved.filter("wants").limit(1).count():
            break
    return groups


def potts_gain(resolution: float):
    return lambda w, n, d, dg: w - resolution * n


def modular_gain(total: float, resolution: float = 1.0):
    return lambda w, n, d, dg: w - resolution * d * dg / (2 * total)


def neighbourhood(owning: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """("group"): owning ("group") and all groups that an edge of theirs leads to or comes from; one step, not further."""
    pairs = lifted_pairs(edges, groups).select("source", "target")
    out = pairs.join(owning.select(F.col("group").alias("source")), "source", "left_semi").select(F.col("target").alias("group"))
    back = pairs.join(owning.select(F.col("group").alias("target")), "target", "left_semi").select(F.col("source").alias("group"))
    return owning.select("group").unionByName(out).unionByName(back).distinct()


#: The Potts resolution without edges, its bounds, and its part of the median weight.
NO_EDGES, LOWEST, HIGHEST, OF_MEDIAN = 0.005, 0.001, 0.05, 0.12


def potts_resolution(edges: DataFrame, size: int, usual: int = 12) -> DataFrame:
    """One row (resolution): of the upper median of the edges' weights, less where groups may be larger than usual, within bounds."""
    median = edges.selectExpr("-percentile_disc(0.5) WITHIN GROUP (ORDER BY -weight) AS m")
    scaled = F.least(F.lit(HIGHEST), F.greatest(F.lit(LOWEST), F.col("m") * F.lit(OF_MEDIAN) * F.lit(usual / max(1, size))))
    return median.select(F.when(F.col("m").isNull(), F.lit(NO_EDGES)).otherwise(scaled).alias("resolution"))


#: The bounds of a domain's resolution, and how many services make domains worth drawing.
DOMAIN_LOWEST, DOMAIN_HIGHEST, LEAST_SERVICES = 1.2, 2.4, 12


def domain_resolution(services: DataFrame, affinities: DataFrame) -> DataFrame:
    """One row (resolution): finer groups for more and for denser services (rows) and affinities (rows)."""
    n, m = services.agg(F.count("*").alias("n")), affinities.agg(F.count("*").alias("m"))
    by_size = F.log2(F.greatest(F.lit(1.0), F.col("n") / 12))
    by_density = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.log2(F.greatest(F.lit(1.0), 2 * F.col("m") / F.col("n") / 4)))
    raw = F.lit(DOMAIN_LOWEST) + F.lit(0.25) * by_size + F.lit(0.08) * by_density
    return n.join(F.broadcast(m)).select(F.least(F.lit(DOMAIN_HIGHEST), F.greatest(F.lit(DOMAIN_LOWEST), raw)).alias("resolution"))


def grouped_domains(services: DataFrame) -> DataFrame:
    """One row (grouped): whether services (assigned) are drawn in domains: there are many, or some code has no service."""
    return services.agg(((F.count_if("assigned") >= LEAST_SERVICES) | F.coalesce(F.bool_or(~F.col("assigned")), F.lit(False))).alias("grouped"))


def feature_vectors(units: DataFrame, members: DataFrame, edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, term, weight): structural features of groups (id, group), summed over their units.

    units: id, name, kind, members, cohesion, abstractness; members: unit, kind, name,
    tags, signature; edges: kind, source, target. Weights are fixed values. Units without
    members have no features of their own, only those of their couplings.
    """
    from codeloom.functions.scalars import arity, bucket, name_tokens, signature_shape

    feature = lambda text, weight: F.struct(text.alias("term"), F.lit(float(weight)).alias("weight"))
    named = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    own = groups.withColumnRenamed("id", "unit")
    shape = units.filter("members > 0").withColumnRenamed("id", "unit").join(own, "unit").select("group", F.explode(F.array(
        feature(named("unit:", F.col("kind")), 0.25), feature(named("members:", bucket(F.col("members"), [0, 2, 5, 10, 20])), 0.25),
        feature(named("cohesion:", bucket(F.col("cohesion"), [0.25, 0.5, 0.75, 0.99])), 0.25), feature(named("abstract:", bucket(F.col("abstractness"), [0.01, 0.5, 0.99])), 0.25),
    )).alias("f"))
    sign = F.btrim(F.coalesce("signature", F.lit("")))
    empty = F.array().cast("array<struct<term:string,weight:double>>")
    signed = F.when(sign != "", F.array(feature(named("signature:", signature_shape(sign, F.col("name"))), 4), feature(named("arity:", arity(sign)), 0.5))).otherwise(empty)
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: feature(named("tag:", F.lower(t)), 0.5))
    roles = F.transform(name_tokens(F.col("name")), lambda t: feature(named("role:", t), 2))
    of_members = members.join(own, "unit").select("group", F.explode(F.concat(F.array(feature(named("member:", F.col("kind")), 0.25)), tags, roles, signed)).alias("f"))

    side = lambda end: own.select(F.col("unit").alias(end), F.col("group").alias(f"g_{end}"))
    met = edges.select("kind", "source", "target").distinct().join(side("source"), "source").join(side("target"), "target").filter("g_source <> g_target")
    names = lambda end: units.select(F.col("id").alias(f"g_{end}"), F.col("name").alias(f"n_{end}"))
    met = met.join(names("source"), "g_source", "left").join(names("target"), "g_target", "left")
    words = lambda end: name_tokens(F.coalesce(f"n_{end}", f"g_{end}"))
    out = met.select(F.col("g_source").alias("group"), F.explode(F.concat(F.array(feature(named("out:", F.col("kind")), 1)), F.transform(words("target"), lambda t: feature(named("out-role:", t), 1)))).alias("f"))
    into = met.select(F.col("g_target").alias("group"), F.explode(F.concat(F.array(feature(named("in:", F.col("kind")), 1)), F.transform(words("source"), lambda t: feature(named("in-role:", t), 1)))).alias("f"))
    every = shape.unionByName(of_members).unionByName(out).unionByName(into)
    return every.groupBy(F.col("group").alias("id"), F.col("f.term").alias("term")).agg(F.sum("f.weight").alias("weight"))
