"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics come from built-in functions in one pass over the texts and are made roughly
normal by logarithms and logits. Per class, counts, means and second moments are summed
on the executors over all labelled training rows; covariances are shrunk towards their
pooled form and a scaled identity, and their Cholesky factors are computed once and
sent with the scoring task. The score is the logistic of the difference of the classes'
log densities plus their log prior odds.

Defined results: a null or empty text has all statistics at their smallest and is scored
like any other; several labels of one document count as the mean, 1 from a half on; rows
whose doc_id is null are in no fold (held_out false) and are not learnt from; without
labels of both classes every score is the prior, 0.5 where there is none; repeated rows
give repeated results; columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc32_mod, labels_of, let, letters, lines_with_words, listed_words, occurrences, text_of, words
from .quality_rules import STOP_WORDS, repeated_window_words

#: Weight of the pooled covariance, then of the scaled identity, in a class covariance.
POOL, RIDGE = 0.2, 0.02
FEATURES = (
    "log_words", "word_length", "symbols", "capitals", "digits", "marks", "bars", "exclaims",
    "stops", "repeats", "same_lines", "distinct_words", "short_words", "line_words",
)


def statistics(text: Column) -> Column:
    """An array of transformed statistics of one text, in the order of FEATURES; every entry is finite."""
    stops = [x for line in STOP_WORDS for x in line.split()]
    share = lambda a, b: a.cast("double") / (b + 1)
    logit = lambda a, b: F.log((a + 0.5) / (b - a + 0.5))  # noqa: E731  of counts with a <= b
    root = lambda a, b: F.sqrt(share(a, b))

    def of(t: Column) -> Column:
        same = let(lines_with_words(t), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))

        def counted(w: Column) -> Column:
            return F.struct(
                F.size(w).alias("n"),
                F.length(F.array_join(w, "")).alias("chars"),
                repeated_window_words(w).alias("repeat"),
                F.size(F.array_distinct(w)).alias("distinct"),
                F.size(F.filter(w, lambda x: F.length(x) <= 2)).alias("short"),
            )

        def all_of(s: Column) -> Column:
            w, ln, c = s["w"], s["l"], s["w"]["chars"]
            n = w["n"]
            return F.array(
                F.log1p(n),
                F.log1p(share(c, n)),
                root(occurrences(t, "[#*$%&|<>]"), n),
                root(s["upper"], s["letters"]),
                root(occurrences(t, "[0-9]"), c),
                root(occurrences(t, "[.,;:?]"), n),
                root(occurrences(t, "[|]"), n),
                root(occurrences(t, "!"), n),
                logit(s["stop"], n),
                root(w["repeat"], n),
                root(ln["dup"], ln["n"]),
                logit(w["distinct"], n),
                logit(w["short"], n),
                F.log1p(share(n, ln["n"])),
            )

        counts = F.struct(
            let(words(t), counted).alias("w"), same.alias("l"), listed_words(t, stops).alias("stop"), letters(t).alias("letters"), occurrences(t, r"\p{Lu}").alias("upper")
        )
        return let(counts, all_of)

    return let(text, of)


def _moments(batches):
    """Per class: count, sum and sum of outer products of the features, as one flat row a batch."""
    for batch in batches:
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        y = batch.column(1).to_numpy()
        classes = [c for c in (0, 1) if (y == c).any()]
        rows = [np.concatenate([[np.sum(y == c)], x[y == c].sum(axis=0), (x[y == c].T @ x[y == c]).ravel()]) for c in classes]
        yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int32()), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["y", "m"])


class Discriminant:
    """Two Gaussian classes with shrunk covariances, kept as Cholesky factors."""

    def __init__(self, moments: dict[int, np.ndarray], p: int, pool: float = POOL, ridge: float = RIDGE):
        n = {c: m[0] for c, m in moments.items()}
        mean = {c: m[1 : 1 + p] / m[0] for c, m in moments.items()}
        scatter = {c: moments[c][1 + p :].reshape(p, p) - n[c] * np.outer(mean[c], mean[c]) for c in moments}
        shared = sum(scatter.values()) / sum(n.values())
        scale = np.sqrt(np.maximum(np.diag(shared), 1e-6))  # the identity is scaled feature by feature
        self.classes = []
        for c in (0, 1):
            own = (1 - pool - ridge) * scatter[c] / n[c] + pool * shared + ridge * np.diag(scale**2)
            factor = np.linalg.cholesky(own + 1e-9 * np.eye(p))
            self.classes.append((mean[c], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[c])))

    def scores(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, inverse, log_det, log_n in self.classes:
            z = (x - mean) @ inverse.T
            density.append(log_n - 0.5 * (log_det + (z * z).sum(axis=1)))
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / 2, -500, 500)))


def train(features: DataFrame, labels: DataFrame, pool: float = POOL, ridge: float = RIDGE) -> Discriminant | float:
    """The discriminant of features (doc_id, x) and labels (doc_id, y), or the prior where a class has no rows."""
    p = len(FEATURES)
    rows = features.join(labels, "doc_id").select("x", "y").mapInArrow(_moments, "y int, m array<double>")
    summed = rows.groupBy("y").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(1 + p + p * p)]).alias("m")).collect()
    moments = {r["y"]: np.array(r["m"]) for r in summed}
    if len(moments) < 2:
        return float(next(iter(moments), 0.5))
    return Discriminant(moments, p, pool, ridge)


def classify(documents: DataFrame, labels: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document; labels (doc_id, y) of held-out rows are not used."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), statistics(text_of(text)).alias("x"))
    features = checkpointed(rows)
    model = train(features.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), labels)

    def score(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            y = model.scores(x) if isinstance(model, Discriminant) else np.full(batch.num_rows, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(y), pa.array((y >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def by_fold(documents: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """:func:`classify` with the fold crc32(doc_id) mod folds held out."""
    known = labels_of(labels, label).filter(crc32_mod("doc_id", folds) != fold)
    return classify(documents, known, crc32_mod("doc_id", folds) == fold)
