"""Similarity of nodes by weighted terms, and affinities between pairs.

Similarity joins take a floor and are exact above it. Terms are ordered from rare to
common; two nodes can only reach the floor if the first term they share lies, for both,
before the point where the rest of the vector is too light to reach it. So candidates
meet on those terms alone and a term that everything has seldom joins anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tree import first_of

#: How strongly an edge kind ties two services.
KIND_WEIGHTS = {"instantiates": 5.0, "calls": 4.0, "implements": 2.0, "extends": 2.0, "imports": 1.0, "references": 1.0}
OTHER_WEIGHT = 0.5
#: Sums of doubles may fall short of an exact floor by so much.
SLACK = 1e-9


def tf_idf(counts: DataFrame) -> DataFrame:
    """(id, term, weight) of unit length: damped frequency times smoothed inverse document frequency; counts (id, term, n)."""
    frequency = counts.groupBy("term").agg(F.count("*").alias("df"))
    total = counts.agg(F.count_distinct("id").alias("total"))
    raw = counts.join(frequency, "term").join(F.broadcast(total))
    raw = raw.withColumn("raw", (F.log("n") + 1) * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1))
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"))
    return raw.join(length, "id").select("id", "term", (F.col("raw") / F.col("length")).alias("weight"))


def _leading(vectors: DataFrame, mass: Column, need: Column) -> DataFrame:
    """(id, term) of the terms from which on, towards the common ones, a vector still has the mass that it needs."""
    common = vectors.groupBy("term").agg(F.count("*").alias("df"))
    rest = W.partitionBy("id").orderBy(F.desc("df"), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)
    return vectors.join(common, "term").withColumn("_rest", F.sum(mass).over(rest)).filter(F.col("_rest") >= need - SLACK).select("id", "term")


def _candidates(leading: DataFrame) -> DataFrame:
    other = leading.select(F.col("id").alias("b"), "term")
    return leading.select(F.col("id").alias("a"), "term").join(other, "term").filter("a < b").select("a", "b").distinct()


def _shared(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pairs with the weights of both on every term that they share."""
    left = vectors.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    right = vectors.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    return pairs.join(left, "a").join(right, ["b", "term"])


def cosine_pairs(vectors: DataFrame, floor: float) -> DataFrame:
    """(a, b, score), a < b, of every pair of unit vectors (id, term, weight) whose cosine reaches the floor."""
    pairs = _candidates(_leading(vectors, F.col("weight") * F.col("weight"), F.lit(floor * floor)))
    return _shared(pairs, vectors).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("score")).filter(F.col("score") >= floor)


def jaccard_pairs(vectors: DataFrame, floor: float) -> DataFrame:
    """(a, b, score), a < b, of every pair whose sum of minima over sum of maxima reaches the floor; weights are positive."""
    total = vectors.groupBy("id").agg(F.sum("weight").alias("total"))
    pairs = _candidates(_leading(vectors.join(total, "id"), F.col("weight"), floor * F.col("total")))
    least = _shared(pairs, vectors).groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("least"))
    of = lambda name: total.select(F.col("id").alias(name), F.col("total").alias(f"t{name}"))
    scored = least.join(of("a"), "a").join(of("b"), "b")
    return scored.select("a", "b", (F.col("least") / (F.col("ta") + F.col("tb") - F.col("least"))).alias("score")).filter(F.col("score") >= floor)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(source, target, score) of pairs (a, b, score) in either direction."""
    there = pairs.select(F.col("a").alias("source"), F.col("b").alias("target"), "score")
    return there.unionByName(pairs.select(F.col("b").alias("source"), F.col("a").alias("target"), "score"))


def nearest_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """Unordered pairs of which one is among the k best partners of the other, with the score."""
    best = first_of(both_ways(pairs), ["source"], [F.desc("score"), F.asc("target")], k)
    return best.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("score").alias("score"))


def kind_weight(kind: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in KIND_WEIGHTS.items():
        out = F.when(kind == name, F.lit(weight)).otherwise(out)
    return out


def pair_affinities(edges: DataFrame) -> DataFrame:
    """(a, b, weight) of unordered pairs, by the sum of their edges' kind weights."""
    apart = edges.filter("source <> target")
    return apart.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(kind_weight(F.col("kind"))).alias("weight"))


def normal_affinities(pairs: DataFrame) -> DataFrame:
    """Pair weights over the geometric mean of the two strengths."""
    ends = pairs.select(F.col("a").alias("id"), "weight").unionByName(pairs.select(F.col("b").alias("id"), "weight"))
    strength = ends.groupBy("id").agg(F.sum("weight").alias("s"))
    of = lambda name: strength.select(F.col("id").alias(name), F.col("s").alias(f"s{name}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.col("weight") / F.sqrt(F.col("sa") * F.col("sb"))).alias("weight"))


def directed_affinities(edges: DataFrame) -> DataFrame:
    """(source, target, weight) by the sum of kind weights."""
    return edges.filter("source <> target").groupBy("source", "target").agg(F.sum(kind_weight(F.col("kind"))).alias("weight"))


def folder_affinities(nodes: DataFrame, reach: int = 3) -> DataFrame:
    """(a, b, weight 1) between every node (id, folder) and the next ``reach`` of its folder."""
    order = W.partitionBy("folder").orderBy("id")
    after = F.array_compact(F.array(*[F.lead("id", k).over(order) for k in range(1, reach + 1)]))
    return nodes.select(F.col("id").alias("a"), after.alias("after")).select("a", F.explode("after").alias("b")).withColumn("weight", F.lit(1.0))


def combined(parts: list[tuple[DataFrame, float]]) -> DataFrame:
    """Affinities (a, b, weight) added after each is divided by its own maximum and given its factor."""
    out = None
    for part, factor in parts:
        top = part.agg(F.max("weight").alias("top"))
        scaled = part.join(F.broadcast(top)).filter("top > 0").select("a", "b", (F.col("weight") / F.col("top") * factor).alias("weight"))
        out = scaled if out is None else out.unionByName(scaled)
    return out.groupBy("a", "b").agg(F.sum("weight").alias("weight"))


def path_domains(paths: DataFrame) -> DataFrame:
    """(path, domain): the first folder after the longest prefix of folders that more than half of all paths share.

    Paths beside that prefix belong to their own first folder, files without one to ``root``.
    """
    folders = paths.select("path").distinct().withColumn("parts", F.split("path", "/")).withColumn("parts", F.slice("parts", F.lit(1), F.size("parts") - 1))
    at = F.when(F.size("parts") > 0, F.sequence(F.lit(1), F.size("parts")))
    prefixes = folders.select(F.explode(at).alias("k"), "parts").select("k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("prefix"))
    total = folders.agg(F.count("*").alias("total"))
    shared = prefixes.groupBy("k", "prefix").agg(F.count("*").alias("n")).join(F.broadcast(total)).filter("2 * n > total")
    chosen = shared.agg(F.coalesce(F.max("k"), F.lit(0)).alias("k"), F.coalesce(F.max_by("prefix", "k"), F.lit("")).alias("prefix"))
    met = folders.join(F.broadcast(chosen))
    inside = F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/") == F.col("prefix")
    domain = F.when(inside, F.get("parts", F.col("k"))).otherwise(F.get("parts", F.lit(0)))
    return met.select("path", F.coalesce(domain, F.lit("root")).alias("domain"))


def label_terms(counts: DataFrame, groups: DataFrame, share: float = 0.2) -> DataFrame:
    """("group", term) of the best label of every group: the term with the largest weight times squared coverage.

    counts (id, term, n) are terms of members, groups (id, group); a term must cover two
    members and a fifth of them.
    """
    sizes = groups.groupBy("group").agg(F.count("*").alias("members"))
    found = tf_idf(counts).join(groups, "id").groupBy("group", "term").agg(F.count("*").alias("covers"), F.sum("weight").alias("score")).join(sizes, "group")
    fit = found.filter(F.col("covers") >= F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("members"))))
    value = F.col("score") * F.pow(F.col("covers") / F.col("members"), F.lit(2))
    return first_of(fit.withColumn("value", value), ["group"], [F.desc("value"), F.asc("term")]).select("group", "term", "covers", "members")
