"""Toxicity scores from a lexicon that is matched with misspellings and read in context.

The lexicon is learnt from labelled training rows: word beginnings and whole words that
occur in toxic documents more often than chance allows, given how many terms are tried. It is kept as a trie. Every
word of a text is run through the trie: exactly, and against all whole words of the
lexicon as the intersection of the trie with the Levenshtein automaton of the word (a
swap of neighbours counts as one edit). A term may be ``EDITS`` away, but has one edit
for each ``LETTERS_PER_EDIT`` letters only. Misspellings that clean training rows also
use are exempt. Words that share no form with a term when as many letters as there are
edits are left out of either can't be that near, and are told by a set of such forms.

A hit counts less where its window of words reads as a quotation (it stands between
quotation marks, or beside a word of reporting). A logistic regression over the summed
hits turns them into a score; as training rows may hold few misspellings, the weight of
a near hit is at least half of an exact one's, whatever the regression says of it. Whole
texts are read, in one pass without a shuffle.

Copies of a training text would count the words of one author many times, so terms are
counted over texts that differ in their sketch, the four smallest hashes of their
five-word shingles; of texts with one sketch that with the smallest doc_id counts.

Training takes at most ``SAMPLE_ROWS`` labelled documents, the first by a hash of doc_id;
where a labelled doc_id has several rows, its smallest text.

Defined results: a null or empty text has no hits and gets the lowest score; rows without
a doc_id are scored, in no fold and not learnt from; several labels of one document count
as their mean; without labels of both classes no term is learnt and every score is the
prior (0 without labels); repeated rows give repeated results; columns beyond doc_id and
text are left alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, crc32_mod, fresh, labels_of, let, text_of, words

SAMPLE_ROWS = 12_000
#: A term must occur in so many toxic training documents, and be this often right.
LEAST_DOCUMENTS, LEAST_PRECISION = 3, 0.9
PREFIXES = range(4, 11)
#: Edits by which a word may differ from a whole-word term, and how many letters a term has for each of them.
EDITS, LETTERS_PER_EDIT = 1, 5
SKETCH = 4
WINDOW, QUOTED_WEIGHT = 8, 0.3
MEMO = 100_000
#: Texts that are unpacked from a batch at a time.
TEXTS = 256

#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|", "oieastasil")
#: Words of reporting, and quotation marks.
REPORTING = frozenset(
    "said says wrote called quote quoted quoting term word insult slur sagte schrieb nannte zitat wort dit écrit cite mot dijo escribió cita palabra".split()
)
QUOTES = "\"“”«»„‟"

_ENDS = re.compile(r"^[^\w@$!|]+|[^\w@$]+$|^_+|_+$")
_AROUND = ".,;:!?\"'()[]«»“”„…-"
_RUN = re.compile(r"(\w)\1{2,}")


def normal(token: str) -> str:
    """The letters of one token, in lower case, without the punctuation around it."""
    word = token.lower()
    if not word.isalpha():
        word = word.strip(_AROUND)
    if not word.isalpha():
        word = _ENDS.sub("", word)
    if not word.isalpha():
        if any(c.isalpha() for c in word):
            word = "".join(c for c in word.translate(LOOKALIKES) if c.isalpha())
        else:
            return ""
    return _RUN.sub(r"\1", word)


def candidate_terms(word: str) -> list[str]:
    """Beginnings of a word, and the word itself marked with a closing $."""
    return [word[:k] for k in PREFIXES if len(word) >= k] + ([word + "$"] if len(word) > 1 else [])


def _shorter(word: str, n: int) -> set[str]:
    """The word and what is left of it without up to n of its letters."""
    found = last = {word}
    for _ in range(n):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        found = found | last
    return found


class Lexicon:
    """Terms with weights in a trie; a term that ends in $ stands for the whole word."""

    def __init__(self, terms: dict[str, float], exempt: frozenset[str] = frozenset(), edits: int = EDITS):
        """exempt: words that never match with an edit; edits: the most that a word may differ by."""
        self.terms, self.exempt, self.edits = terms, exempt, edits
        self.root: dict = {}
        self.fuzzy: dict = {}
        self.forms: set[str] = set()
        for term, weight in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node["weight"] = weight
            word = term[:-1]
            allowed = min(edits, len(word) // LETTERS_PER_EDIT)
            if term[-1] == "$" and allowed:
                node = self.fuzzy
                for c in word:
                    node = node.setdefault(c, {})
                node["$"] = (weight, allowed)
                self.forms |= _shorter(word, allowed)

    def exact(self, word: str) -> float:
        """The largest weight of a term that is a beginning of the word, or the word."""
        node, best = self.root, 0.0
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            best = max(best, node.get("weight", 0.0))
        return max(best, node.get("$", {}).get("weight", 0.0))

    def near(self, word: str) -> float:
        """The largest weight of a whole-word term that is at most its number of edits away."""
        if not self.forms or len(word) < LETTERS_PER_EDIT - 1 or word in self.exempt:
            return 0.0
        forms = self.forms
        if word not in forms and all(word[:i] + word[i + 1 :] not in forms for i in range(len(word))):
            if self.edits < 2 or forms.isdisjoint(_shorter(word, self.edits)):
                return 0.0
        return self._walk(self.fuzzy, word, list(range(len(word) + 1)), None, "")

    def _walk(self, node, word, row, before, last) -> float:
        """Steps the automaton of ``word`` along every branch; row holds its edit counts, those above the budget are dead."""
        best, n = 0.0, len(word)
        if "$" in node and row[-1] <= node["$"][1]:
            best = node["$"][0]
        for c, child in node.items():
            if c == "$":
                continue
            new = [row[0] + 1]
            for j in range(1, n + 1):
                cost = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (word[j - 1] != c))
                if before is not None and j > 1 and word[j - 1] == last and word[j - 2] == c:
                    cost = min(cost, before[j - 2] + 1)
                new.append(cost)
            if min(new) <= self.edits or min(row) < self.edits:  # a swap may yet save a branch whose letter before was right
                best = max(best, self._walk(child, word, new, row, c))
        return best


class _Memo(dict):
    """token -> (exact weight, near weight) or None, in two generations."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.older = lexicon, {}

    def __missing__(self, token: str):
        if token in self.older:
            hit = self.older[token]
        else:
            word = normal(token)
            exact = self.lexicon.exact(word) if word else 0.0
            near = self.lexicon.near(word) if word and not exact else 0.0
            hit = (exact, near) if exact or near else None
        if len(self) >= MEMO:
            self.older = dict(self)
            self.clear()
        self[token] = hit
        return hit


def _quoted(tokens: list[str], at: int) -> bool:
    """Whether the window around a hit reads as quotation."""
    left, right = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    own = tokens[at]
    opened = sum(t.count(q) for t in left for q in QUOTES) + (own[0] in QUOTES)
    closed = any(q in t for t in right for q in QUOTES) or own.rstrip(".,;:!?")[-1:] in QUOTES
    return bool(opened % 2 and closed) or any(normal(t) in REPORTING for t in tokens[max(0, at - 3) : at])


FEATURES = ("exact", "distinct", "near", "quoted", "density")


def features(memo: _Memo, text: str) -> tuple[float, ...]:
    tokens = text.lower().split()
    found = list(map(memo.__getitem__, tokens))
    if not any(found):
        return (0.0,) * len(FEATURES)
    hits = [(i, h) for i, h in enumerate(found) if h]
    exact = near = quoted = 0.0
    for i, (e, k) in hits:
        if _quoted(tokens, i):
            quoted += e or k
            e, k = e * QUOTED_WEIGHT, k * QUOTED_WEIGHT
        exact, near = exact + e, near + k
    seen = len({normal(tokens[i]) for i, (e, _) in hits if e})
    return (math.log1p(exact), math.log1p(seen), math.log1p(near), math.log1p(quoted), math.log1p(100 * len(hits) / len(tokens)))


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray | None, prior: float):
        self.lexicon, self.weights, self.prior = lexicon, weights, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first weight is the unpenalised intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _log_ratio(a: int, b: int, n1: int, n0: int) -> float:
    """Log-likelihood ratio of a term seen in a of n1 toxic and b of n0 clean documents."""
    part = lambda k, n, m: 2 * k * math.log(k * (n1 + n0) / (n * m)) if k else 0.0
    return part(a, n1, a + b) + part(b, n0, a + b) + part(n1 - a, n1, n1 + n0 - a - b) + part(n0 - b, n0, n1 + n0 - a - b)


def _texts(column):
    """The texts of an Arrow column, few of them at a time."""
    for at in range(0, len(column), TEXTS):
        yield from column.slice(at, TEXTS).to_pylist()


def _counted(keys_of):
    """A mapInArrow function: (y, text) -> key, toxic documents, clean documents, summed within a batch."""

    def run(batches):
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for y, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                (toxic if y else clean).update(keys_of(text))
            keys = list(toxic | clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
                names=["key", "toxic", "clean"],
            )

    return run


_COUNTS = "key string, toxic long, clean long"


def _sketch(text: Column, n: int = 5) -> Column:
    """The smallest hashes of n-word shingles; near copies mostly share them, other texts don't."""

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, F.slice(F.array_sort(F.array_distinct(hashes)), 1, SKETCH)).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))

    return let(words(text), of)


def train(documents: DataFrame, labels: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS, edits: int = EDITS) -> Model:
    """A model from labels (doc_id, y) of at most sample_rows documents, the first by a hash of doc_id."""
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    own = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most sample_rows pairs of numbers
    rows = checkpointed(rows)
    differing = rows.withColumn("sketch", _sketch(F.col("text"))).groupBy("y", "sketch").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    told = checkpointed(differing.select("y", "first.text"))
    n = {r["y"]: r["count"] for r in told.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model(Lexicon({}), None, float(n1 > 0))

    def terms_of(text):
        return {t for w in {normal(x) for x in set(text.lower().split())} for t in candidate_terms(w)}

    counts = told.mapInArrow(_counted(terms_of), _COUNTS).groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    tried = checkpointed(counts.filter(F.col("a") >= LEAST_DOCUMENTS))
    chance = 2 * math.log(20 * max(1, tried.count()))  # a ratio that one of so many terms reaches by chance in one of twenty trainings
    likely = tried.filter(F.col("a") >= LEAST_PRECISION * (F.col("a") + F.col("b"))).collect()
    kept: dict[str, float] = {}
    for r in sorted(likely, key=lambda r: (len(r["key"]), r["key"])):
        key, a, b = r["key"], r["a"], r["b"]
        implied = key[-1] != "$" and any(key[:k] in kept for k in range(1, len(key)))
        if not implied and _log_ratio(a, b, n1, n0) >= chance:
            kept[key] = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

    first = Lexicon(kept, edits=edits)

    def misspelt(text):
        return {w for w in {normal(x) for x in set(text.lower().split())} if w and not first.exact(w) and first.near(w)}

    forms = told.mapInArrow(_counted(misspelt), _COUNTS).groupBy("key").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    exempt = forms.filter((F.col("b") > 0) & (F.col("a") < 0.8 * (F.col("a") + F.col("b")))).collect()
    lexicon = Lexicon(kept, frozenset(r["key"] for r in exempt), edits)
    fitted = _featured(rows, lexicon, "y").collect()  # at most sample_rows rows of five numbers
    x, y = np.array([r["x"] for r in fitted]).reshape(-1, len(FEATURES)), np.array([r["y"] for r in fitted], dtype=float)
    weights = _logistic(x, y)
    if weights[FEATURES.index("near") + 1] < weights[1] / 2:  # misspellings seen too seldom to weigh: half an exact hit
        weights[FEATURES.index("near") + 1] = weights[1] / 2
    return Model(lexicon, weights, n1 / (n1 + n0))


def _featured(rows: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """key and the feature array x of rows (key, text)."""

    def run(batches):
        memo = _Memo(lexicon)
        for batch in batches:
            x = [features(memo, t) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=[key, "x"])

    return rows.select(key, "text").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, x array<double>")


def score(documents: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """documents (all columns; one of that name is replaced) with their toxicity score."""
    rows, lexicon = documents.drop(name), model.lexicon
    at = rows.columns.index(text)

    def run(batches):
        memo = _Memo(lexicon)
        for batch in batches:
            x = [features(memo, t or "") for t in _texts(batch.column(at))]
            y = model.scores(np.array(x).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(y, pa.float64())], names=[*batch.schema.names, name])

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(0.0)).schema)


def trained_by_fold(documents: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0) -> Model:
    return train(documents, labels_of(labels, label).filter(crc32_mod("doc_id", folds) != fold))


def by_fold(documents: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted; the fold crc32(doc_id) mod folds is not learnt from."""
    model = trained_by_fold(documents, labels, folds=folds, fold=fold)
    held_out: Column = F.coalesce(crc32_mod("doc_id", folds) == fold, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), text_of(text).alias("text"))
    return score(rows, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def below(documents: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """documents, in their own columns, that score below the threshold; all of them where no term was learnt, as a prior says nothing about a text."""
    if not model.lexicon.terms:
        return documents
    name = fresh("_score", documents)
    return score(documents, model, text, name).filter(F.col(name) < threshold).select(*documents.columns)
