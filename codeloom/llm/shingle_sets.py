"""Texts linked by the Jaccard similarity of their sets of five-word shingles, exactly.

Two sets of a similarity of 0.8 share a member within the first fifth (and one more) of
both, in whatever order all members are put. Prefixes are taken with members that a
sample of the texts holds often at the end, and texts meet on equal prefix members. The
sample and its bound move cost only: every order finds every pair. Where the first
shared member stands in either set bounds what they share, so pairs whose sets have too
little left behind it are passed over; the smaller set of a pair has it in its first
ninth, the head of its prefix.

A pair that meets is dropped where parity bits of both sets differ in more places than
the sets could at 0.8 (a member that one set lacks changes one bit at most, so no pair
of 0.8 goes). Whole sets are made and shuffled only for pairs that are left after their
bits; where too many texts meet others to broadcast their ids, these are set aside first.

Texts whose fingerprints are linked are compared first, and their links start the
components. Texts that meet and are still apart are compared in rounds. A round compares each text of a group
with a few leaders of the group, which have the member in their head, and links are
joined into components; texts that are connected by then need no comparison, and leaders
leave, as all their pairs are done. Groups go on, with more leaders each time, until no
head or one component is left. So a large group of near copies costs a few comparisons
for each member. Texts that share a passage come to be compared in pairs only where
less than a ninth of the one and a fifth of the other is their own.

A text stands for its copies by a 64-bit hash; a shingle is a 64-bit hash too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, checkpointed, checkpointed_in_batches, gathered, in_parts, small, text_of

WORDS = 5
#: A pair is linked where PARTS * shared >= LEAST * united, that is from 0.8 on.
LEAST, PARTS = 4, 5
#: One text in SAMPLE counts members; OFTEN among them is often, for MOST_OFTEN members at most.
SAMPLE, OFTEN, MOST_OFTEN = 32, 3, 200_000
#: Parity bits of a set, as longs: at least so many, and two bits or more for each member.
LONGS = 8
#: Rows of numbers that a text to be hashed counts as, where partitions are gathered.
TEXTS = 20
#: Leaders of a group in the first round, and how many times more there are in each next one.
LEADERS, MORE = 4, 8


def text_key(text: str = "text") -> Column:
    """The hash that stands for a text; texts without a word are copies of each other."""
    own = text_of(text)
    return F.xxhash64(F.when(own.rlike(r"[^\x20\x09-\x0D]"), own).otherwise(F.lit("")))


def _prefix_batches(often: np.ndarray, times: np.ndarray, fingerprint):
    """A mapInArrow function: (id, hashes) -> id, number of members, fingerprint, prefix and parity bits, for texts with a word."""

    def run(batches):
        for batch in batches:
            lists, rows = batch.column(1), []
            values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            for key, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                own = np.unique(values[a:b])
                n = len(own)
                if not n:
                    continue
                width = 64 * max(LONGS, 1 << (-(-n // 32) - 1).bit_length())
                parity = np.bincount((own.view(np.uint64) % np.uint64(width)).astype(np.int64), minlength=width) & 1
                if len(often):
                    place = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    own = own[np.argsort(np.where(often[place] == own, times[place], 0), kind="stable")]
                rows.append((key, n, fingerprint(values[a:b]), own[: n - -(-LEAST * n // PARTS) + 1], np.packbits(parity.astype(bool)).view(np.int64)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n", "fp", "prefix", "bits"])

    return run


def groups(texts: DataFrame, hashes: Column, fingerprint, near, components) -> DataFrame:
    """(node, root) for every id that is connected to others by similarities from 0.8 on.

    texts has id and text, those of one id alike; hashes makes the shingles of text and
    fingerprint a number of these; near makes pairs (a, b) of texts with fingerprints (id,
    fp) to be compared first; components makes (node, root) of links (a, b).
    """
    counted = texts.filter(F.pmod("id", F.lit(SAMPLE)) == 0).select(F.explode(F.array_distinct(hashes)).alias("h")).groupBy("h").count()
    top = counted.filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(MOST_OFTEN).collect()
    often, times = np.array([r["h"] for r in top], dtype=np.int64), np.array([r["count"] for r in top], dtype=np.int64)
    order = np.argsort(often)
    schema = "id long, n long, fp long, prefix array<long>, bits array<long>"
    told = checkpointed_in_batches(texts.select("id", hashes.alias("hashes")).mapInArrow(_prefix_batches(often[order], times[order], fingerprint), schema))

    def with_both(pairs: DataFrame, own: DataFrame, name: str) -> DataFrame:
        """pairs with x and y, what own (id and the column name) has of their ends."""
        ends = pairs.select("a", "b", "sum", F.explode(F.array("a", "b")).alias("id"))
        two = own.join(small(ends), "id").groupBy("a", "b", "sum").agg(F.collect_list(name).alias("two"))
        return two.select("a", "b", "sum", F.get("two", F.lit(0)).alias("x"), F.get("two", F.lit(1)).alias("y"))

    def alike(pairs: DataFrame, bits: DataFrame, held: DataFrame) -> DataFrame | None:
        """Those of pairs (a, b, sum) whose sets have a similarity of 0.8, if any are left after their parity bits."""
        told_bits = with_both(pairs, bits, "bits")
        differ = F.aggregate(F.zip_with(_halved("x", "y"), _halved("y", "x"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, d: s + d)
        left = gathered(told_bits.filter((LEAST + PARTS) * differ <= (PARTS - LEAST) * F.col("sum")).select("a", "b", "sum"))
        if left.isEmpty():
            return None
        own = gathered(left.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        once = held.join(small(own), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
        sets = in_parts(once, TEXTS * own.count()).select("id", F.array_distinct(hashes).alias("s"))
        both = with_both(left, sets, "s").select("a", "b", "sum", F.size(F.array_intersect("x", "y")).alias("both"))
        return both.filter(PARTS * F.col("both") >= LEAST * (F.col("sum") - F.col("both"))).select("a", "b")

    prints = gathered(told.select("id", "n", "fp").distinct())
    first = gathered(near(prints.select("id", "fp")))
    ends = first.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    first = gathered(prints.join(small(ends), "id").groupBy("a", "b").agg(F.sum("n").alias("sum")))
    ids = gathered(ends.select("id").distinct())
    bits = told.join(small(ids), "id", "left_semi").groupBy("id").agg(F.first("bits").alias("bits"))
    none = first.select("a", "b").filter(F.lit(False))
    new = alike(first, bits, texts)
    roots = components(none if new is None else new)

    named = told.join(small(roots), F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id"))
    prefixes = named.select(F.posexplode("prefix").alias("at", "h"), "id", "n", "root").select("h", "id", (F.col("n") - F.col("at")).alias("left"), "n", "root")
    head = (LEAST + PARTS) * F.col("left") >= 2 * LEAST * F.col("n")

    def some_pair(rows: DataFrame) -> DataFrame:
        """(h) of groups with a head and two different roots."""
        ends = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.bool_or(head).alias("head"))
        return ends.filter("low < high AND head").select("h")

    met = gathered(prefixes.join(some_pair(prefixes), "h", "left_semi").distinct())
    ids = gathered(met.select("id").distinct())
    bits = gathered(told.join(small(ids), "id", "left_semi").groupBy("id").agg(F.first("bits").alias("bits")))
    held = texts if ids.count() <= BROADCAST_ROWS else checkpointed(texts.join(ids, "id", "left_semi"))
    k = LEADERS
    while rows := met.count():
        slot = F.pmod(F.xxhash64("id", F.lit(k)), F.lit(k))
        leaders = met.filter(head).groupBy("h", slot.alias("slot")).agg(F.min(F.struct("id", "n", "root", "left")).alias("to")).select("h", "to")
        leaders = gathered(in_parts(leaders, rows))
        enough = (LEAST + PARTS) * F.least("left", "to.left") >= LEAST * (F.col("n") + F.col("to.n"))
        near_size = (F.col("root") != F.col("to.root")) & (PARTS * F.least("n", "to.n") >= LEAST * F.greatest("n", "to.n")) & enough
        pairs = in_parts(met.join(leaders, "h").filter(near_size), k * rows)
        pairs = gathered(pairs.select(F.least("id", "to.id").alias("a"), F.greatest("id", "to.id").alias("b"), (F.col("n") + F.col("to.n")).alias("sum")).distinct())
        if not pairs.isEmpty() and (new := alike(pairs, bits, held)) is not None:
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))
        done = leaders.select("h", F.col("to.id").alias("id"))
        rest = in_parts(met.drop("root").join(done, ["h", "id"], "left_anti"), rows).join(small(roots), F.col("id") == F.col("node"), "left")
        rest = rest.select("h", "id", "left", "n", F.coalesce("root", "id").alias("root"))
        met = gathered(in_parts(rest.join(some_pair(rest), "h", "left_semi"), rows))
        k *= MORE
    return roots


def _halved(own: str, other: str) -> Column:
    """The parity bits of one set, folded to the size of the other's where they are twice as many."""
    half = F.size(other)
    return F.when(F.size(own) > half, F.transform(F.slice(own, F.lit(1), half), lambda x, i: x.bitwiseXOR(F.get(F.col(own), i + half)))).otherwise(F.col(own))
