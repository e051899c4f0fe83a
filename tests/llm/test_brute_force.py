"""Operators that SQL can't express, against plain Python over the driver's small tables and a fixture of odd rows."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import mixing, quality_classifier, toxicity
from tests.conftest import SMALL
from tests.llm.test_contracts import SEPARATORS, table, words
from tests.llm.test_edges import _jaccard_groups

LARGE = "/root/testdata/sf0.1"


def edits(a, b):
    """Edits from a to b by the whole table; a swap of neighbours is one."""
    d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    d[:, 0], d[0] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def plain_near(terms, exempt, word, most):
    allowed = {t: min(most, (len(t) - 1) // toxicity.LETTERS_PER_EDIT) for t in terms}
    fit = [w for t, w in terms.items() if t[-1] == "$" and allowed[t] and abs(len(t) - 1 - len(word)) <= most and edits(word, t[:-1]) <= allowed[t]]
    return 0.0 if word in exempt else max(fit, default=0.0)


def plain_exact(terms, word):
    return max([w for t, w in terms.items() if (word == t[:-1] if t[-1] == "$" else word.startswith(t))], default=0.0)


@pytest.mark.parametrize("most", [1, 2])
def test_automaton_meets_every_term_within_its_edits(most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    terms = {word(rng.randrange(3, 13)) + "$": 1.0 + k for k in range(60)}
    lexicon = toxicity.Lexicon(terms, edits=most)
    tried = [word(rng.randrange(1, 14)) for _ in range(400)]
    for t in terms:
        w = list(t[:-1])
        for _ in range(most):
            k = rng.randrange(len(w))
            w[k : k + rng.randrange(3)] = rng.choice([[], ["e"], w[k : k + 2][::-1]])
            w = w or ["a"]
        tried.append("".join(w))
    hits = 0
    for w in tried:
        assert lexicon.near(w) == plain_near(terms, (), w, most), w
        hits += lexicon.near(w) > 0
    assert hits > 20  # not only misses


def test_toxicity_scores(spark):
    """Scores of toxic and other documents from all terms one by one; labels held out change nothing."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.trained_by_fold(docs, labels)
    terms, exempt = dict(model.lexicon.terms), model.lexicon.exempt
    some = labels.filter("toxic = 1").select("doc_id").distinct().orderBy("doc_id").limit(40).unionByName(spark.range(20).select(F.col("id").alias("doc_id")))
    chosen = docs.join(some.distinct(), "doc_id", "left_semi").cache()

    class Plain(dict):
        def __missing__(self, token):
            w = toxicity.normal(token)
            exact = plain_exact(terms, w) if w else 0.0
            near = plain_near(terms, exempt, w, toxicity.EDITS) if w and not exact else 0.0
            self[token] = hit = (exact, near) if exact or near else None
            return hit

    memo = Plain()
    want = {}
    for r in chosen.collect():
        x = np.array(toxicity.features(memo, r["text"] or ""))
        want[r["doc_id"]] = 1 / (1 + np.exp(-(model.weights[0] + model.weights[1:] @ x)))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(chosen, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    assert sum(s >= 0.5 for s in got.values()) > 20
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.trained_by_fold(docs, turned).lexicon.terms == model.lexicon.terms


def plain_statistics(text):
    t = text or ""
    w = [x for x in words(t) if x]
    n, chars = len(w), sum(map(len, w))
    lines = [x for x in t.split("\n") if x.strip(SEPARATORS)]
    grams = [tuple(w[i : i + 3]) for i in range(n - 2)]
    covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    stops = {x for line in quality_classifier.STOP_WORDS for x in line.split()}
    letters = [c for c in t if c.isalpha()]
    count = lambda chars: sum(c in chars for c in t)
    share, logit = lambda a, b: a / (b + 1), lambda a, b: np.log((a + 0.5) / (b - a + 0.5))
    root = lambda a, b: np.sqrt(share(a, b))
    n_stop = sum(x.rstrip(".,;:!?") in stops for x in words(t.lower()))
    return [
        np.log1p(n), np.log1p(share(chars, n)), root(count("#*$%&|<>"), n), root(sum(c.isupper() for c in letters), len(letters)), root(count("0123456789"), chars),
        root(count(".,;:?"), n), root(count("|"), n), root(count("!"), n), logit(n_stop, n), root(len(covered), n), root(len(lines) - len(set(lines)), len(lines)),
        logit(len(set(w)), n), logit(sum(len(x) <= 2 for x in w), n), np.log1p(share(n, len(lines))),
    ]


def test_quality_scores(spark):
    """The discriminant from plain statistics, class by class, with determinants and inverses in place of Cholesky factors."""
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    x = {r["doc_id"]: plain_statistics(r["text"]) for r in table("documents")}
    marks = defaultdict(list)
    for r in table("labels"):
        if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            marks[r["doc_id"]].append(r["quality"])
    rows = {c: np.array([x[i] for i, y in marks.items() if i in x and (np.mean(y) >= 0.5) == c]) for c in (0, 1)}
    pooled = sum(np.cov(v.T, bias=True) * len(v) for v in rows.values()) / sum(map(len, rows.values()))
    density = {}
    for c, v in rows.items():
        own = (1 - quality_classifier.POOL - quality_classifier.RIDGE) * np.cov(v.T, bias=True) + quality_classifier.POOL * pooled
        own += quality_classifier.RIDGE * np.diag(np.maximum(np.diag(pooled), 1e-6)) + 1e-9 * np.eye(len(own))
        away = {i: np.array(s) - v.mean(axis=0) for i, s in x.items()}
        density[c] = {i: np.log(len(v)) - (np.linalg.slogdet(own)[1] + a @ np.linalg.inv(own) @ a) / 2 for i, a in away.items()}
    got = {r["doc_id"]: r["score"] for r in quality_classifier.by_fold(docs, labels).collect()}
    for i in x:
        gap = density[1][i] - density[0][i]
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(gap / 2, -500, 500)))) < 1e-6, i


def plain_repeats(rows, least=50):
    """Texts by doc_id after line dedup, by whole windows of lines; documents of which nothing is left go."""
    places, content = defaultdict(list), {}
    for i, text in rows.items():
        lines = (text or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(SEPARATORS)]
        content[i] = (lines, at)
        bare = [lines[k].strip(SEPARATORS) for k in at]
        size = [len([w for w in words(x) if w]) for x in bare]
        for span in (1, 2, 3):
            for k in range(len(bare) - span + 1):
                if span == 3 or sum(size[k : k + span]) >= least:
                    places[tuple(bare[k : k + span])].append((i, k))
    gone = defaultdict(set)
    for window, found in places.items():
        first = min(found)
        for i, k in found:
            if (i, k) > first:
                gone[i] |= {p for p in range(k, k + len(window)) if i != first[0] or p >= first[1] + len(window)}
    out = {}
    for i, (lines, at) in content.items():
        lost = {at[p] for p in gone[i]}
        if not lost or len(lost) < len(at):
            out[i] = "\n".join(x for k, x in enumerate(lines) if k not in lost) if lost else rows[i]
    return out


def test_every_stage_of_the_pipeline(spark, tmp_path):
    """Each stage's rows and whole texts against plain Python over what the stage before kept."""
    rng = random.Random(11)
    line = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passage = "\n".join(line(12) for _ in range(5))
    texts = {}
    for k in range(60):
        body = [line(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 12))]
        if k % 4 == 0:
            body.insert(rng.randrange(len(body) + 1), passage)
        texts[10 * k] = "\n".join(body)
        if k % 5 == 0:
            w = texts[10 * k].replace("\n", " ").split(" ")
            texts[10 * k + 1] = " ".join([*w, "added"])
        if k % 6 == 0:
            texts[10 * k + 2] = texts[10 * k]
        if k % 7 == 0:
            texts[10 * k + 3] = f"you dreadful zorgface {line(20)} zorgfaces"
    texts |= {900: None, 901: "", 902: " \n\t\n"}
    rows = [(i, t, "en", ("a", "b", "c", None)[i % 4], len(t or "")) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, 1, int("zorgface" in (t or ""))) for i, t in texts.items()]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)

    def after(name):
        nonlocal now
        stages[name](spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        return now.collect()

    model = toxicity.trained_by_fold(now, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    memo = toxicity._Memo(model.lexicon)
    scores = {i: model.scores(np.array([toxicity.features(memo, t or "")]))[0] for i, t in texts.items()}
    left = {r["doc_id"]: r["text"] for r in after("toxicity")}
    assert left == {i: t for i, t in texts.items() if scores[i] < 0.5} and all("zorgface" not in (t or "") for t in left.values()) and len(left) > 60

    want = plain_repeats(left)
    left = {r["doc_id"]: r["text"] for r in after("line_dedup")}
    assert left == want

    some = {i: t for i, t in left.items() if (t or "").strip(SEPARATORS)}
    kept, _ = _jaccard_groups(some)
    blank = min(i for i in left if i not in some)
    left = {r["doc_id"]: r["text"] for r in after("near_dedup")}
    assert left == {i: t for i, t in want.items() if i in kept or i == blank}

    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mixture(now).collect()}
    mixed = defaultdict(list)
    for r in after("mixing"):
        mixed[r["doc_id"]].append(r["text"])
    for i, (size, n) in taken.items():
        got = mixed.get(i, [])
        parts = sorted((len([w for w in words(t) if w]) for t in got), reverse=True)
        assert parts == [p for p in (min(n, size), n - min(n, size)) if p] and all(t == left[i] for t, p in zip(sorted(got, key=len, reverse=True), parts, strict=True) if p == size)
        assert all(t.split() == left[i].split()[: len(t.split())] for t in got)

    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = sorted(len(encoder.encode(t, add_special_tokens=False).ids) + 1 for found in mixed.values() for t in found)
    packed = after("packing")
    assert sorted(r["length"] for r in packed) == sizes
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096
