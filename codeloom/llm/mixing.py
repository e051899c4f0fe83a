"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by a seeded hash and laid end to end; the stream is
cut into blocks of equal word counts. The mix has as many slots as blocks fit into its
words. Slot i falls on the golden-ratio point frac(i * phi), and the cumulative targets
say whose slot that is, so every prefix of the mix has nearly the target shares. The
k-th slot of a source takes the source's block k, beginning again after its last one.

Prefix sums and ranks are taken in two levels (inside a hash bucket or a run of slots,
then over the few bucket totals), so a source with most of the rows is never one task.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; sources without words have target 0; slots beyond ``max_repeats`` passes over a
source are left out, so no document is taken more often; repeated rows are documents of
their own in the mix; an empty table gives an empty table. Columns beyond doc_id, source
and text are ignored by :func:`mixture` and passed on by :func:`mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, fresh, shuffle_key, table, text_of, words

WEIGHTS, SHARE, MAX_REPEATS = (3, 1, 2), 1.5, 2
BLOCK_WORDS = 64
SEED = 17
#: Points have 32 bits; the multiplier is 2^32 divided by the golden ratio, made odd.
POINTS, GOLDEN = 1 << 32, 2654435769
BUCKET_BITS, KEY_BITS, RUN = 12, 60, 1 << 16


def document_sizes(documents: DataFrame, text: str = "text", *more: str) -> DataFrame:
    return documents.select("doc_id", "source", *more, F.size(words(text_of(text))).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: weight shares of the mix, none above cap times its source.

    One row for each source. A source is full where its limit is at most its part of what
    the sources with lower limits by weight leave over; all others share the rest by weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(place, F.lit(len(weights))) + 1))
    tight = W.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before = tight.rowsBetween(W.unboundedPreceding, -1)
    after = tight.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    left = share * F.sum("source_size").over(every) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = weighed.withColumn("level", left / F.sum("weight").over(after))
    full = level.withColumn("full", cap * F.col("source_size") <= F.col("level") * F.col("weight"))
    common = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(every)["level"]
    target = F.when(F.col("full"), (cap * F.col("source_size")).cast("double")).otherwise(common * F.col("weight"))
    return full.withColumn("target", target).select("source", "source_size", "target")


def _running(df: DataFrame, group: list[str], bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows before each row of its group, in order of bucket, then order."""
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    before = W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*[F.col(g).alias(f"_{g}") for g in [*group, bucket]], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in [*group, bucket]]
    joined = inside.join(base, same)
    return joined.withColumn(name, F.col("_base") + F.col("_inside")).drop("_base", "_inside", *[f"_{g}" for g in [*group, bucket]])


def streams(sizes: DataFrame, seed: int = SEED) -> DataFrame:
    """sizes with ``start``, the words before a document in its source's shuffled stream."""
    keyed = sizes.withColumn("_key", shuffle_key(F.col("doc_id"), seed))
    bucketed = keyed.withColumn("_bucket", F.shiftright("_key", KEY_BITS - BUCKET_BITS))
    return _running(bucketed, ["source"], "_bucket", ["_key", "doc_id", "size"], F.col("size"), "start").drop("_key", "_bucket")


def schedule(spark, targets: DataFrame, block_words: int = BLOCK_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """slot, source, rank, block: which block the mix takes in each slot."""
    slots = int((targets.agg(F.sum("target")).first()[0] or 0) // block_words)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(1))
    upto = W.orderBy(F.asc_nulls_last("source")).rowsBetween(W.unboundedPreceding, 0)
    edge = F.floor(F.sum("target").over(upto) / F.sum("target").over(every) * POINTS)
    edges = targets.filter("target > 0").withColumn("high", F.when(F.row_number().over(W.orderBy(F.desc_nulls_first("source"))) == 1, F.lit(POINTS)).otherwise(edge))
    low = F.coalesce(F.lag("high").over(W.orderBy(F.asc_nulls_last("source"))), F.lit(0))
    shift = 22  # points are matched to ranges through 1024 cells
    ranges = edges.withColumn("low", low).filter("high > low").select(
        "source",
        F.ceil(F.col("source_size") / block_words).alias("blocks"),
        "low",
        "high",
        F.explode(F.sequence(F.shiftright("low", shift), F.shiftright(F.col("high") - 1, shift))).alias("cell"),
    )
    point = F.pmod(F.pmod(F.col("slot"), F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(POINTS))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.shiftright("point", shift))
    dealt = points.join(ranges, "cell").filter("point >= low AND point < high").select("slot", "source", "blocks", F.expr(f"slot div {RUN}").alias("run"))
    ranked = _running(dealt, ["source"], "run", ["slot"], F.lit(1), "rank")
    kept = ranked.filter(F.col("rank") < max_repeats * F.col("blocks"))
    return kept.select("slot", "source", "rank", F.pmod("rank", "blocks").alias("block"))


def _plan(documents: DataFrame, text: str, block_words: int, *more: str):
    sizes = checkpointed(document_sizes(documents, text, *more))
    targets = checkpointed(source_targets(sizes))
    used = schedule(documents.sparkSession, targets, block_words).groupBy("source", "block").agg(F.count("*").alias("times"))
    return sizes, targets, used


def mixture(documents: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """For every document: doc_id, source, size, source_size, target and taken, the words the mix takes of it."""
    sizes, targets, used = _plan(documents, text, block_words)
    laid = checkpointed(streams(sizes).withColumn("row", F.monotonically_increasing_id()))
    first, last = F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}")
    spread = laid.filter("size > 0").select("row", "source", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    shared = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    other = used.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "times")
    met = spread.join(other, (F.col("block") == F.col("_block")) & F.col("source").eqNullSafe(F.col("_source")))
    taken = met.groupBy("row").agg(F.sum(shared * F.col("times")).alias("taken"))
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    out = laid.join(taken, "row", "left").join(named, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(documents: DataFrame, text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself, with the columns of documents: a document once for each time it is taken.

    Slots of a source take its blocks in order, so each pass but the last is whole, and the
    last pass ends inside one document at most, whose text is cut there.
    """
    row, own_row, part, n_words = (fresh(name, documents) for name in ("_row", "_own_row", "_spans", "_words"))
    numbered = checkpointed(documents.withColumn(row, F.monotonically_increasing_id()))
    sizes, targets, used = _plan(numbered, text, block_words, row)
    reach = used.withColumn("end", (F.col("block") + 1) * block_words).groupBy("source").agg(
        *[F.max(F.when(F.col("times") > p, F.col("end"))).alias(f"pass{p}") for p in range(MAX_REPEATS)]
    )
    other = reach.withColumnRenamed("source", "_source")
    laid = streams(sizes).join(other, F.col("source").eqNullSafe(F.col("_source")))
    spans = F.array(*[F.least(F.col("start") + F.col("size"), F.col(f"pass{p}")) - F.col("start") for p in range(MAX_REPEATS)])
    spans = laid.select(F.col(row).alias(own_row), F.filter(spans, lambda n: n > 0).alias(part)).filter(F.size(part) > 0)
    taken = numbered.join(spans, F.col(row) == F.col(own_row)).select("*", F.explode(part).alias(n_words))
    own = words(text_of(text))
    cut = F.when(F.size(own) <= F.col(n_words), F.col(text)).otherwise(F.concat_ws(" ", F.slice(own, F.lit(1), F.col(n_words).cast("int"))))
    return taken.withColumn(text, cut).select(*documents.columns)
