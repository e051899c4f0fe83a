"""Component metrics: coupling, cohesion, abstractness, design smells, ranking and advice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.ids import is_outside
from codeloom.functions.scalars import round2

from .iterate import components
from .tree import nearest

#: Edge kinds that couple units.
COUPLING = ("registers", "binds", "provides", "injects", "owns", "aliases", "calls", "instantiates", "extends", "implements", "references")
INHERITANCE = ("extends", "implements")
#: Kinds that are units, and kinds that are their members.
UNITS = ("module", "class", "interface", "object")
MEMBERS = ("function", "method")


def coupling_pairs(edges: DataFrame) -> DataFrame:
    """One row for each ordered pair of units: kinds, evidence, and whether it is inheritance only."""
    rows = edges.filter(F.col("kind").isin(*COUPLING) & (F.col("source") != F.col("target")))
    return rows.groupBy("source", "target").agg(
        F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"),
        F.sum(F.coalesce("weight", F.lit(1))).alias("weight"),
        F.bool_and(F.col("kind").isin(*INHERITANCE)).alias("inheritance_only"),
    )


def couplings(units: DataFrame, edges: DataFrame) -> DataFrame:
    """id, ce and ca (distinct units used and using) of every unit."""
    pairs = edges.filter(F.col("kind").isin(*COUPLING) & (F.col("source") != F.col("target"))).select("source", "target").distinct()
    ce = pairs.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("ce"))
    ca = pairs.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("ca"))
    zero = F.lit(0).cast("long")
    return units.select("id").join(ce, "id", "left").join(ca, "id", "left").select("id", F.coalesce("ce", zero).alias("ce"), F.coalesce("ca", zero).alias("ca"))


def lcom4(members: DataFrame, calls: DataFrame) -> DataFrame:
    """unit, members and components: connected groups of a unit's members over calls inside the unit."""
    side = lambda end: members.select(F.col("id").alias(end), F.col("unit").alias(f"{end}_unit"))
    inside = calls.join(side("source"), "source").join(side("target"), "target").filter("source_unit = target_unit").select("source", "target")
    roots = components(members, inside)
    return members.join(roots, "id").groupBy("unit").agg(F.count("*").alias("members"), F.count_distinct("root").alias("components"))


def external_fanout(units: DataFrame, outside: DataFrame) -> DataFrame:
    """(id, external): distinct targets outside the graph of every unit; outside (source, target)."""
    used = outside.groupBy(F.col("source").alias("id")).agg(F.count_distinct("target").alias("external"))
    return units.select("id").join(used, "id", "left").select("id", F.coalesce("external", F.lit(0).cast("long")).alias("external"))


def unit_of(nodes: DataFrame, closure: DataFrame) -> DataFrame:
    """(id, unit): the nearest node at or above each that is a unit; nodes outside of all units are left out."""
    return nearest(closure, nodes.filter(F.col("kind").isin(*UNITS)).select("id")).select("id", F.col("near").alias("unit"))


def members_of(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, unit) of all members, each in one unit; placed is :func:`unit_of`."""
    return nodes.filter(F.col("kind").isin(*MEMBERS)).select("id").join(placed, "id")


def between_units(edges: DataFrame, placed: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coupling edges by what they are: between units (kind, source, target, weight), calls inside one (source, target), and out of the graph (source, target)."""
    own = placed.select(F.col("id").alias("source"), F.col("unit").alias("su"))
    rows = edges.filter(F.col("kind").isin(*COUPLING)).join(own, "source")
    known = nodes.select(F.col("id").alias("target")).distinct()
    leaves = is_outside(F.col("target"))
    out = rows.filter(leaves).unionByName(rows.filter(~leaves).join(known, "target", "left_anti")).select(F.col("su").alias("source"), "target").distinct()
    met = rows.filter(~leaves).join(placed.select(F.col("id").alias("target"), F.col("unit").alias("tu")), "target")
    inner = met.filter("su = tu AND kind = 'calls'").select("source", "target").distinct()
    across = met.filter("su <> tu").groupBy("kind", F.col("su").alias("source"), F.col("tu").alias("target")).agg(F.count("*").alias("weight"))
    return across, inner, out


def unit_metrics(units: DataFrame, edges: DataFrame, members: DataFrame, calls: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """ce, ca, members, components, instability, abstractness, distance, cohesion, external and smells; thresholds see unrounded values.

    units: id, kind; members: id, unit, is_abstract; calls between members; outside:
    (source unit, target). Abstractness is the share of abstract members, 0 without
    members, and 1 for an interface.
    """
    total = F.col("ce") + F.col("ca")
    shares = members.groupBy(F.col("unit").alias("id")).agg(F.avg(F.col("is_abstract").cast("double")).alias("share"))
    cohesion = lcom4(members, calls).withColumnRenamed("unit", "id")
    base = couplings(units, edges).join(units.select("id", "kind"), "id").join(cohesion, "id", "left").join(shares, "id", "left")
    if outside is None:
        base = base.withColumn("external", F.lit(0).cast("long"))
    else:
        base = base.join(external_fanout(units, outside), "id")
    zero, one = F.lit(0).cast("long"), F.lit(1.0)
    m, k = F.coalesce("members", zero), F.coalesce("components", zero)
    raw = base.select(
        "id", "ce", "ca", m.alias("members"), k.alias("components"), "external",
        F.when(total > 0, F.col("ce") / total).otherwise(F.lit(0.0)).alias("i"),
        F.when(F.col("kind") == "interface", 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("a"),
        F.when(m > 1, one - (k - one) / (m - one)).otherwise(one).alias("c"),
    ).withColumn("d", F.abs(F.col("a") + F.col("i") - 1))
    return raw.withColumn("smells", F.array_join(smells(), ",")).select(
        "id", "ce", "ca", "members", "components", "external", round2(F.col("i")).alias("instability"), round2(F.col("a")).alias("abstractness"),
        round2(F.col("d")).alias("distance"), round2(F.col("c")).alias("cohesion"), "smells",
    )


def smells() -> Column:
    """The thresholds of the smells."""
    c = F.col
    found = (
        ((c("ca") >= 5) & (c("ce") >= 5), "god-module"),
        ((c("a") <= 0.3) & (c("i") <= 0.3) & (c("ca") >= 3), "zone-of-pain"),
        ((c("a") >= 0.7) & (c("i") >= 0.7), "zone-of-uselessness"),
        ((c("members") >= 4) & (c("c") <= 0.34), "low-cohesion"),
    )
    return F.array_compact(F.array(*[F.when(test, name) for test, name in found]))


#: Severity of a smell, for ranking.
SEVERITY = {"god-module": 4, "low-cohesion": 3, "zone-of-pain": 3, "zone-of-uselessness": 2}


def severity(smell_list: Column) -> Column:
    total = F.lit(0)
    for name, weight in SEVERITY.items():
        total = total + F.when(smell_list.contains(name), weight).otherwise(0)
    return total


def refactor_rank(metrics: DataFrame) -> DataFrame:
    """All units, the worst first: by severity, distance, members and id."""
    order = [F.desc("severity"), F.desc("distance"), F.desc("members"), F.asc("id")]
    return metrics.withColumn("severity", severity(F.col("smells"))).orderBy(*order).select("id", "severity", "distance", "members")


#: What a smell makes of a unit, what was found (a format and its columns) and what helps.
ADVICE = {
    "god-module": ("bad", "%s units use it and it uses %s", ("ca", "ce"), "part it into units behind narrow interfaces"),
    "low-cohesion": ("warn", "%s members in %s groups that don't call each other", ("members", "components"), "split it along these groups"),
    "zone-of-pain": ("bad", "concrete (%s), stable (%s) and used by %s units", ("abstractness", "instability", "ca"), "let its users depend on an interface"),
    "zone-of-uselessness": ("warn", "abstract (%s) and unstable (%s), used by %s units", ("abstractness", "instability", "ca"), "drop the abstraction or give it users"),
}
BALANCED = 0.2


def diagnosis(metrics: DataFrame) -> DataFrame:
    """id, tone, worst smell (first in order of severity), findings and suggestions, the worst first.

    A unit without smells is good up to a distance of 0.2 from the main sequence, and to be watched beyond.
    """
    has = lambda s: F.col("smells").contains(s)
    worst = F.coalesce(*[F.when(has(s), F.lit(s)) for s in SEVERITY])
    bad = F.lit(False)
    for name, (tone, *_) in ADVICE.items():
        bad = bad | (has(name) & F.lit(tone == "bad"))
    tone = F.when(bad, "bad").when(worst.isNotNull() | (F.col("distance") > BALANCED), "warn").otherwise("good")
    clean = F.array(F.format_string("distance %s, cohesion %s over %s members", *[F.col(c).cast("string") for c in ("distance", "cohesion", "members")]))
    found = F.array_compact(F.array(*[F.when(has(s), F.format_string(ADVICE[s][1], *[F.col(c).cast("string") for c in ADVICE[s][2]])) for s in SEVERITY]))
    helps = F.array_compact(F.array(*[F.when(has(s), F.lit(ADVICE[s][3])) for s in SEVERITY]))
    findings = F.when(worst.isNull(), clean).otherwise(found)
    return metrics.select("id", tone.alias("tone"), worst.alias("worst"), findings.alias("findings"), helps.alias("suggestions"))


def hubs(edges: DataFrame, share: float = 0.3, least: int = 4) -> DataFrame:
    """Targets that at least max(least, share of all units) distinct units depend on."""
    units = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().agg(F.count("*").alias("peers"))
    used = edges.filter("source <> target").groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("dependents"))
    return used.join(F.broadcast(units)).filter(F.col("dependents") >= F.greatest(F.lit(least), F.ceil(F.col("peers") * F.lit(share)))).select("id", "dependents")


def module_graph(edges: DataFrame, near: DataFrame) -> DataFrame:
    """Imports between modules; the weight is the number of edges below."""
    src, tgt = near.select(F.col("id").alias("source"), F.col("near").alias("s")), near.select(F.col("id").alias("target"), F.col("near").alias("t"))
    return edges.join(src, "source").join(tgt, "target").filter("s <> t").groupBy(F.col("s").alias("source"), F.col("t").alias("target")).agg(F.count("*").alias("weight"))


def root_module(modules: DataFrame, imports: DataFrame) -> DataFrame:
    """The entry module: the most imported, ties to the smaller id."""
    count = imports.groupBy(F.col("target").alias("id")).agg(F.sum("weight").alias("imports"))
    return modules.join(count, "id").orderBy(F.desc("imports"), "id").limit(1).select("id", "imports")
