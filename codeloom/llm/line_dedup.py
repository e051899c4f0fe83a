"""Line dedup: passages that occur again anywhere in the corpus lose their later occurrences.

Lines with a word are trimmed and every run of three of them is hashed, in overlapping
windows. Windows that are found twice keep their first place, by (doc_id, line), and at
all later places the positions they cover are merged and removed.

A passage on fewer lines is no window. With ``passage_words``, which is off by default,
one line or two lines that have so many words together are windows too;
:func:`without_repeats`, for corpus stages, takes 50.

The whole job is DataFrame functions. The first place of a window is a partial
aggregation and comes back by a join, so a line that a third of the corpus shares is
summed before it is shuffled and its rows can be split between tasks. Two 64-bit hashes
stand for a window; windows are hashed once and set aside, as they are read twice.

Defined results: a null or empty text has no windows and comes back as it is (null as
null); documents of fewer than three lines have nothing to lose but with ``passage_words``; lines
without a word are never removed; a window that overlaps its own first occurrence loses
only what reaches beyond it; rows without a doc_id neither lose lines nor make others
lose them; rows with the same doc_id are read as one document told twice and lose the
same places; an empty table gives an empty table; further columns pass through, and
columns named n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CHARS, checkpointed, fresh, let, text_of, words

SPAN, PASSAGE_WORDS = 3, 50


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SEPARATOR_CHARS))


def _content(text: Column) -> Column:
    """The trimmed lines that have a word."""
    return F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != "")


def windows(documents: DataFrame, text: str = "text", passage_words: int | None = None) -> DataFrame:
    """doc_id, pos, span, h1, h2: every window of every document; pos counts lines with a word, from 0."""

    def hashed(pos: Column, span: int, *lines: Column) -> Column:
        return F.struct(
            pos.alias("pos"),
            F.lit(span).alias("span"),
            F.xxhash64(F.lit(2 * span), *lines).alias("h1"),
            F.xxhash64(F.lit(2 * span + 1), *lines).alias("h2"),
        )

    def of(lines: Column) -> Column:
        n = F.size(lines)
        starts = F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: hashed(i, SPAN, *[F.get(lines, i + k) for k in range(SPAN)]))
        if passage_words is None:
            return runs
        return F.concat(runs, let(F.transform(lines, lambda x: F.size(words(x))), lambda sizes: passages(lines, sizes)))

    def passages(lines: Column, sizes: Column) -> Column:
        one = F.transform(lines, lambda x, i: F.when(F.get(sizes, i) >= passage_words, hashed(i, 1, x)))
        enough = lambda i: F.get(sizes, i) + F.get(sizes, i + 1) >= passage_words
        two = F.transform(lines, lambda x, i: F.when(enough(i), hashed(i, 2, x, F.get(lines, i + 1))))
        return F.filter(F.concat(one, two), lambda w: w.isNotNull())

    rows = documents.filter(F.col("doc_id").isNotNull()).select("doc_id", let(_content(text_of(text)), of).alias("w"))
    return rows.select("doc_id", F.explode("w").alias("w")).select("doc_id", "w.*")


def removed_positions(documents: DataFrame, text: str = "text", passage_words: int | None = None) -> DataFrame:
    """doc_id and the sorted positions that it loses, for documents that lose any."""
    every = checkpointed(windows(documents, text, passage_words))
    place = F.struct("doc_id", "pos")
    firsts = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first < last")
    later = every.join(firsts.select("h1", "h2", "first"), ["h1", "h2"]).filter(place > F.col("first"))
    own = F.when(F.col("first.doc_id") == F.col("doc_id"), F.col("first.pos") + F.col("span")).otherwise(F.lit(0))
    reach = later.select("doc_id", F.greatest("pos", own).alias("a"), (F.col("pos") + F.col("span") - 1).alias("b")).filter("a <= b")
    merged = reach.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b")).alias("r"))
    covered = F.array_distinct(F.flatten(F.transform("r", lambda x: F.sequence(x["a"], x["b"]))))
    return merged.select("doc_id", F.sort_array(covered).alias("positions"))


def dedup_lines(documents: DataFrame, text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed", passage_words: int | None = None) -> DataFrame:
    """All documents, with text without its removed lines, n_lines (lines with a word) and n_removed."""
    doc_id, positions = fresh("_doc_id", documents), fresh("_positions", documents)
    lost = removed_positions(documents, text, passage_words).select(F.col("doc_id").alias(doc_id), F.col("positions").alias(positions))

    def rest(lines: Column) -> Column:
        marked = F.filter(F.transform(lines, lambda x, i: F.when(_trimmed(x) != "", i)), lambda i: i.isNotNull())
        gone = let(marked, lambda at: F.transform(positions, lambda p: F.get(at, p)))
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    joined = documents.join(lost, F.col("doc_id") == F.col(doc_id), "left")
    return (
        joined.withColumn(n_lines, F.size(_content(text_of(text))).cast("long"))
        .withColumn(n_removed, F.coalesce(F.size(positions), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col(positions).isNull(), F.col(text)).otherwise(let(F.split(text_of(text), "\n"), rest)))
        .drop(doc_id, positions)
    )


def without_repeats(documents: DataFrame, text: str = "text", passage_words: int | None = PASSAGE_WORDS) -> DataFrame:
    """documents, in their own columns, after line dedup; those of which nothing is left go."""
    lines, removed = fresh("_n_lines", documents), fresh("_n_removed", documents)
    cleaned = dedup_lines(documents, text, lines, removed, passage_words)
    return cleaned.filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines))).select(*documents.columns)
