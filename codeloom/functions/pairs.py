"""Joins whose pairs are many more than their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .materialize import stored


def distinct_pairs(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, where: Column | None = None, parts: int = 1) -> DataFrame:
    """Distinct (a, b) of rows of left and of right that are equal in ``on`` and for which ``where`` holds.

    Neither side may have two rows of one a (one b) and one key. So a pair of which one side
    has a single row comes once at most, and only pairs of two that have several rows each
    are shuffled to be told apart; the others are never written or sorted. Rows of left
    that share a key are dealt out to so many parts.
    """
    rows = lambda df, name: df.withColumn("_n", F.count("*").over(W.partitionBy(name)))
    left = stored(rows(left, a).withColumn("_part", F.pmod(F.hash(a), F.lit(parts))))
    right = stored(rows(right, b).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    one, several = F.col("_n") == 1, F.col("_n") > 1

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.drop("_n").join(y.drop("_n"), [*on, "_part"])
        return (pairs if where is None else pairs.filter(where)).select(a, b)

    return met(left.filter(one), right).unionByName(met(left.filter(several), right.filter(one))).unionByName(met(left.filter(several), right.filter(several)).distinct())
