"""Quality rules: one threshold table compiled into a single Spark projection.

Every statistic is a built-in function of the text column, so the whole filter is
one narrow stage over the documents: no shuffle, no Python worker.

Defined results: a null or empty text has no words and fails the base rule; ids,
sources and any further columns pass through untouched; repeated rows give repeated
results; an empty table gives an empty table with the same columns. Columns named like
a statistic are replaced by the statistic.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, letters, lines_with_words, listed_words, occurrences, text_of, words

SYMBOLS = "#*$%&|<>"

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as with on this was are be by not or at from have has an but",  # en
    "le la les de des du et un une est que qui dans en pour pas sur au avec ce",  # fr
    "der die das und den dem von zu mit ist nicht auf für ein eine im auch sich als",  # de
    "el los las y se por con una para es no lo su al del como",  # es
)


@dataclass(frozen=True)
class Rule:
    """A document fails where ``metric`` lies outside [low, high]."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Thresholds of the default table; ratios are per word unless named otherwise.
RULES = (
    Rule("mean_word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.15),
    Rule("stop_words", "stop_ratio", 0.03, None),
    Rule("capitals", "upper_ratio", None, 0.4),
    Rule("repeated_lines", "dup_line_ratio", None, 0.35),
)

#: Base rule: shortest document, and largest share (percent) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def repeated_window_words(w: Column, span: int = 3) -> Column:
    """How many words lie in a window of ``span`` words that is found twice or more.

    Windows are compared by a chained 64-bit hash of their words. Texts whose windows all
    differ, the usual case, stop after one hash-set pass; the others sort (hash, position)
    and merge the covered positions.
    """
    n = F.size(w)
    hashes = F.transform(
        F.when(n >= span, F.sequence(F.lit(0), n - F.lit(span))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(span)]),
    )

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def merge(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            hit = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
            spread = F.flatten(F.transform(hit, lambda x: F.array(*[x["i"] + k for k in range(span)])))
            return F.size(F.array_distinct(spread))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(placed, merge))

    return let(hashes, covered)


def text_statistics(text: Column) -> Column:
    """A struct of counts of one text."""
    stops = [x for line in STOP_WORDS for x in line.split()]

    def of(t: Column) -> Column:
        line_counts = let(lines_with_words(t), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
        word_counts = let(
            words(t),
            lambda w: F.struct(
                F.size(w).alias("n"),
                repeated_window_words(w).alias("repeat"),
                F.length(F.array_join(w, "")).alias("chars"),
            ),
        )
        return F.struct(
            word_counts.alias("w"),
            line_counts.alias("l"),
            listed_words(t, stops).alias("stop"),
            occurrences(t, f"[{SYMBOLS}]").alias("symbols"),
            occurrences(t, r"\p{Lu}").alias("upper"),
            letters(t).alias("letters"),
        )

    return let(text, of)


def measure(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with the counts and ratios that rules refer to."""
    stats = fresh("_stats", documents)
    s = documents.withColumn(stats, text_statistics(text_of(text)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    at = lambda path: F.col(f"{stats}.{path}")
    return s.withColumns(
        {
            "n_words": at("w.n").cast("long"),
            "word_chars": at("w.chars").cast("long"),
            "n_symbols": at("symbols").cast("long"),
            "n_dup_lines": at("l.dup").cast("long"),
            "n_repeat_words": at("w.repeat").cast("long"),
            "mean_word_chars": ratio(at("w.chars"), at("w.n")),
            "symbol_ratio": ratio(at("symbols"), at("w.n")),
            "stop_ratio": ratio(at("stop"), at("w.n")),
            "upper_ratio": ratio(at("upper"), at("letters")),
            "dup_line_ratio": ratio(at("l.dup"), at("l.n")),
        }
    ).drop(stats)


def compile_rules(rules=RULES) -> Column:
    """True where no rule of the table is broken."""
    passed = F.lit(True)
    for r in rules:
        if r.low is not None:
            passed = passed & (F.col(r.metric) >= r.low)
        if r.high is not None:
            passed = passed & (F.col(r.metric) <= r.high)
    return passed


def apply_rules(documents: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """All documents with their statistics, ``base_failed`` and the verdict ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measure(documents, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))
