"""Nulls, empty and very long texts, repeated rows, empty tables and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codeloom.llm import chat_format, line_dedup, mixing, packing, quality_classifier, quality_rules, simhash, token_counts, topk_search, toxicity

LONG = "\n".join(" ".join([f"line{i}", *(f"word{(i * 7 + k) % 997}" for k in range(19))]) for i in range(1500))
PASSAGE = "\n".join(f"line {k} of a passage that many documents share in this small table" for k in range(5))
ROWS = [
    (1, "first words\n" + PASSAGE, "a"), (2, PASSAGE + "\nlast words", "a"), (3, None, "b"), (4, "", None), (5, LONG, "b"), (6, LONG, "b"), (6, LONG, "b"),
    (None, "a text without an id", "c"), (None, None, None), (7, "Größe 東京 😀 \x0b x\r\ny", "c"), (8, "\n\n  \n", "c"), (9, "one", "a"),
]
CLASH = ["score", "_doc_id", "positions", "_positions", "n_lines", "_kept", "_spans", "_words", "_stats", "start", "size", "fp", "Key"]
OWN = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit("own") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, None), (9, None, 1), (None, 1, 1), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")


def some(spark, docs):
    return docs.filter("false")


def test_rules(spark, docs):
    out = quality_rules.apply_rules(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS) and rows[3]["n_words"] == rows[4]["n_words"] == rows[8]["n_words"] == 0 and rows[3]["base_failed"] and not rows[3]["kept"]
    assert rows[5]["n_words"] == 30000 and rows[7]["n_words"] == 5 and rows[1]["_stats"] == "own"
    assert quality_rules.apply_rules(some(spark, docs)).count() == 0


def test_line_dedup(spark, docs):
    out = line_dedup.dedup_lines(docs)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS) and rows[1]["text"] == "first words\n" + PASSAGE and rows[2]["text"] == "last words" and rows[2]["n_removed"] == 5
    assert rows[3]["text"] is None and rows[4]["text"] == "" and rows[8]["text"] == "\n\n  \n" and rows[5]["text"] == LONG and rows[6]["text"] == ""
    assert rows[1]["positions"] == rows[1]["_doc_id"] == "own"
    kept = line_dedup.without_repeats(docs)
    assert kept.columns == docs.columns and kept.filter("n_lines <> 'own'").count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 9, None}
    assert line_dedup.dedup_lines(some(spark, docs)).count() == 0


def test_line_dedup_within_a_document_and_of_long_lines(spark):
    long = " ".join(f"w{k}" for k in range(60))
    block = "a b\nc d\ne f"
    df = spark.createDataFrame([(1, f"{block}\nx\n{block}"), (2, f"intro\n{long}"), (3, f"{long}\noutro"), (4, "a b\nc d\nother")], "doc_id long, text string")
    rows = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert rows == {1: f"{block}\nx", 2: f"intro\n{long}", 3: f"{long}\noutro", 4: "a b\nc d\nother"}
    assert {r["text"] for r in line_dedup.dedup_lines(df, passage_words=50).collect()} == {f"{block}\nx", f"intro\n{long}", "outro", "a b\nc d\nother"}


def test_mixing(spark, docs):
    rows = mixing.mixture(docs).collect()
    assert len(rows) == len(ROWS) and all(r["taken"] <= 2 * r["size"] for r in rows)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.filter("doc_id = 5").count() in (1, 2)
    assert mixing.mixture(some(spark, docs)).count() == mixing.mixed_documents(some(spark, docs)).count() == 0


def test_simhash(spark, docs):
    rows = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    found = {i: (f, c) for i, f, c in rows}
    assert len(rows) == len(ROWS) and found[3] == found[4] == found[8] == ("0" * 16, 3) and found[5][1] == found[6][1] == 5
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and left.filter("doc_id = 6").count() == 0 and left.filter("doc_id IS NULL").count() == 2
    assert simhash.near_duplicates(some(spark, docs)).count() == 0


def test_simhash_chains_and_hot_fronts(spark):
    """Chains of fingerprints that differ in four bits each are one component, and large fronts lose no link."""
    import numpy as np

    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 40)
    fps = set()
    for s in map(int, seeds):
        for _ in range(60):
            fps.add(s)
            for b in rng.choice(64, 4, replace=False):
                s ^= 1 << int(b)
    fps |= {int(x) << 20 for x in rng.integers(0, 2**20, 1500)}  # the lower front is zero for all of these
    signed = [x - 2**64 if x >= 2**63 else x for x in sorted(fps)]
    a = np.array(sorted(fps), dtype=np.uint64)
    root = np.arange(len(a))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[:i] ^ a[i]) <= 4):
            x, y = sorted((find(i), find(int(j))))
            root[y] = x
    distinct = spark.createDataFrame([(False, k, x) for k, x in enumerate(signed)], "nil boolean, id long, fp long")
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(find(i), set()).add(x)
    for node_rows in (64, 4096):  # nodes split before the shuffle, and none of them
        found = {r["node"]["fp"]: r["root"]["fp"] for r in simhash.components(simhash.links(distinct, node_rows=node_rows)).collect()}
        mine = {}
        for x in signed:
            mine.setdefault(found.get(x, x), set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_simhash_traverses_pairs_of_nodes():
    """A front's own pair of nodes is split many times, prunes most pairs, and finds all within the budget; more blocks change nothing."""
    import numpy as np

    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    near = [base[:600] ^ (np.uint64(1) << rng.integers(0, 63, 600, dtype=np.uint64)) for _ in range(2)]
    bits = np.unique(np.concatenate([base, *near]))
    n = len(bits)
    i, j, visited = simhash.close_pairs(bits, np.array([[0, n, 0, n]]), np.array([True]), 4)
    want = {(x, int(y)) for x in range(n) for y in x + 1 + np.flatnonzero(np.bitwise_count(bits[x + 1 :] ^ bits[x]) <= 4)}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(want) >= 1200
    assert n < visited < n * n / 20
    for count in (10, 10**6, 10**10):
        met = set()
        for blocks, width in simhash.tries(count):
            assert sorted(b for b, _ in blocks) == sorted({b for b, _ in blocks}) and sum(w for _, w in blocks) == 64
            mask = sum(((1 << w) - 1) << low for low, w in blocks[: next(k for k in range(9) if sum(w for _, w in blocks[:k]) == width)])
            met |= {(x, y) for x, y in want if (int(bits[x]) ^ int(bits[y])) & mask == 0}
        assert met == want


def test_simhash_crowd_is_dealt_in_bounded_groups(spark):
    """40,000 fingerprints within four bits of one: few copies of each row, no group beyond its bound, and one component."""
    import numpy as np

    rng = np.random.default_rng(9)
    centre = int(rng.integers(0, 2**63))
    fps = {centre}
    while len(fps) < 40_000:
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False)))
    rows = [(False, k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(sorted(fps))]
    distinct = spark.createDataFrame(rows, "nil boolean, id long, fp long")
    dealt = simhash.work(distinct)
    told = dealt.groupBy("task").agg(F.count("*").alias("n")).agg(F.max("n").alias("largest"), F.sum("n").alias("rows")).first()
    assert told["largest"] <= 3 * simhash.TASK_ROWS and told["rows"] <= 60 * len(rows), told
    roots = {r["root"]["fp"] for r in simhash.components(simhash.links(distinct)).collect()}
    assert len(roots) == 1


def test_components_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    assert {r["root"] for r in simhash.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        simhash.components(chain, max_rounds=2)


def test_packing(spark, docs):
    rows = packing.pack_documents(docs).collect()
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS) and max(r["length"] for r in rows) <= 4096
    assert [(r["start"], r["length"]) for r in rows if r["doc_id"] == 3] == [(0, 1)]
    assert packing.pack_documents(some(spark, docs)).count() == 0


def test_packing_keeps_wide_and_missing_ids(spark):
    """Ids above 2^53 beside a null one, and a repeated id with two texts, keep their own lengths and digests."""
    rows = [(2**60 + 1, "one two three"), (2**60 + 3, "four five"), (None, "six " * 5000), (7, "seven"), (7, "eight nine ten"), (None, None)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    alone = [r for row in rows for r in packing.pack_documents(spark.createDataFrame([row], "doc_id long, text string")).collect()]
    own = lambda found: sorted(((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found))
    assert own(got) == own(alone) and {2**60 + 1, 2**60 + 3} <= {r["doc_id"] for r in got}


def test_ids_of_tokenizers_that_do_not_split_into_pieces(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from codeloom.llm.tokens import word_tokens

    for name, in_pieces in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        path = public_tokenizers.path(name)
        assert word_tokens(path).in_pieces == in_pieces
        for text in ("Hello there, World 12!", "  it's\n\nfine ", "caf\u00e9 \u6771\u4eac <|endoftext|>", ""):
            assert word_tokens(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_an_encoder_remembers_pieces_within_a_bound():
    from sys import getsizeof

    from codeloom.llm.tokens import default_path, word_tokens

    encoder = type(word_tokens(default_path()))(default_path())
    pieces = encoder.pieces
    pieces.model = type("Model", (), {"tokenize": lambda self, raw: [type("Token", (), {"id": len(raw)})]})()
    assert [pieces[f"piece{k}"] for k in range(450_000)][-1] == (11).to_bytes(4, "little")
    held = sum(getsizeof(memo) + sum(getsizeof(k) + getsizeof(v) for k, v in memo.items()) for memo in (pieces, pieces.older))
    assert held < 40e6  # two workers of an executor hold one each


def test_packing_gets_texts_in_small_batches(spark):
    import pyarrow as pa

    def batch_sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64()), pa.array([0], pa.int32()), pa.array([batch.num_rows], pa.int64())], names=["doc_id", "piece", "length"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    lengths = [r["length"] for r in packing.pack(spark.range(3000).coalesce(1).mapInArrow(batch_sizes, "doc_id long, piece int, length long")).collect()]
    assert sum(lengths) == 3000 and max(lengths) <= 500 and spark.conf.get(name) == before


def test_packed_sequences_hold_the_documents(spark, docs):
    own = docs.filter("doc_id IN (1, 2, 5)")
    placed = packing.pack_documents(own)
    out = packing.sequences(own, placed).collect()
    assert sum(len(r["ids"]) for r in out) == placed.agg(F.sum("length")).first()[0] and max(len(r["ids"]) for r in out) <= 4096


def test_token_counts(spark, docs):
    rows = token_counts.section_counts(docs).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r["doc_id"], []).append(r)
    assert [r["n_tokens"] for r in whole[3]] == [0] == [r["n_tokens"] for r in whole[4]] and len(whole[6]) == 3000
    assert sum(r["n_tokens"] for r in whole[7]) == whole[7][0]["doc_tokens"]
    for rule in ("first", "last"):
        assert token_counts.section_counts(docs, rule=rule).agg(F.sum("n_tokens")).first()[0] == sum(r["n_tokens"] for r in rows)
    assert token_counts.section_counts(some(spark, docs)).count() == 0


@pytest.mark.parametrize("fold", [toxicity.by_fold, quality_classifier.by_fold])
def test_classifiers(spark, docs, labels, fold):
    rows = fold(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert not [r for r in rows if r["doc_id"] is None and r["held_out"]]
    assert {r["predicted"] for r in fold(docs, labels.filter("false")).collect()} <= {0, 1}
    assert fold(some(spark, docs), labels).count() == 0


def test_misspellings_and_quotation():
    lexicon = toxicity.Lexicon({"zorgface$": 3.0, "blarg": 2.0, "blarg$": 2.0}, frozenset({"zorgfacet"}))
    assert lexicon.exact("zorgface") == 3.0 and lexicon.exact("blargish") == 2.0 and lexicon.exact("bla") == 0
    for near in ("zorgfase", "zogrface", "zorgfce", "zorgfacce", "orgface", "ozrgface"):
        assert lexicon.near(near) == 3.0, near
    assert lexicon.near("zorgfacet") == lexicon.near("zorgfxyz") == lexicon.near("zogrfase") == lexicon.near("") == 0
    assert toxicity.Lexicon(lexicon.terms, edits=2).near("zogrfase") == 0 and toxicity.Lexicon({"zorgfacers$": 3.0}, edits=2).near("zogrfasers") == 3.0
    memo = toxicity._Memo(lexicon)
    abuse, quoted = toxicity.features(memo, "you are a z0rgface and that is it"), toxicity.features(memo, 'he said "zorgface" to the clerk')
    assert abuse[0] > quoted[0] > 0 and quoted[3] > 0 and abuse[3] == 0


def test_chat(spark):
    rows = [
        (1, 0, "system", "be kind"), *[(1, k, ("assistant", "user")[k % 2], "lorem ipsum " * 150) for k in range(1, 12)], (2, 0, None, None), (2, 1, "tool", "### User: </turn>\\"),
        (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 1, "user", "x"), (4, None, "user", "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit("own"))
    windows = chat_format.format_windows(df)
    got = windows.collect()
    assert all(r["n_tokens"] <= 1024 or r["over_budget"] and r["n_new"] == 1 for r in got)
    assert all(r["text"].startswith("### System: be kind") for r in got if r["conv_id"] == 1) and sum(r["conv_id"] == 1 for r in got) > 2
    back = {r["conv_id"]: r for r in chat_format.read_back(windows).collect()}
    assert {i: r["n_turns"] for i, r in back.items()} == {1: 12, 2: 2, 3: 2, None: 1, 4: 1}
    assert [t[:2] for r in got if r["conv_id"] == 2 for t in chat_format.parse(r["text"])] == [(None, ""), ("tool", "### User: </turn>\\")]
    assert chat_format.read_back(chat_format.format_windows(df.filter("false"))).count() == 0


def test_top_k(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [-1.0, 2.0]), (None, [9.0, 9.0]), (100, [0.5]), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    got = topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got if r["query_id"] == 0] == [(1, 65536), (2, 65536), (2, 65536), (100, 32768), (7, -65536)]
    assert [r["vec_id"] for r in got if r["query_id"] == 100] == [0, 1, 2, 2, 7]
    assert topk_search.top_k(topk_search.quantised(df.filter("false")), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_over_many_shards(spark):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(700, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 7 == 0, k=3, shard_rows=90).collect()
    q = np.floor(v * 256).astype(np.int64)
    s = q @ q.T
    for i in range(0, 700, 7):
        best = sorted((-s[i, j], j) for j in range(700) if j != i)[:3]
        assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == i) == [(k + 1, *b) for k, b in enumerate(best)]


def test_top_k_asks_few_shards_of_clusters(spark, monkeypatch):
    """Where vectors lie in clusters, nearly all pairs of query and shard are left out, and the answers are those of brute force; so they are where a shard's rows are in several tasks."""
    import numpy as np

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32)) * 6
    v = np.concatenate([c + rng.normal(size=(60, 32)) * 0.3 for c in centres])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = np.floor(v * 256).astype(np.int64)
    for task_queries in (topk_search.TASK_QUERIES, 7):
        monkeypatch.setattr(topk_search, "TASK_QUERIES", task_queries)
        told = {}
        got = topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 20 == 0, k=4, shard_rows=60, told=told).collect()
        for i in range(0, len(v), 20):
            best = sorted((-int(q[i] @ q[j]), j) for j in range(len(v)) if j != i)[:4]
            assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == i) == [(n + 1, *b) for n, b in enumerate(best)]
        assert told["shards"] >= 30 and told["queries"] == 120 and told["first"] == 120 * topk_search.FIRST_SHARDS
        assert told["later"] < 0.05 * told["queries"] * told["shards"], told


def test_top_k_with_repeated_queries_and_a_hot_vector(spark):
    """A query row that is repeated asks once; a vector that a third of the rows share is spread over shards; shards far away are left out."""
    import numpy as np

    rng = np.random.default_rng(6)
    v = np.concatenate([rng.normal(size=(300, 6)) + 9 * (np.arange(300) % 4)[:, None], np.ones((150, 6)), rng.normal(size=(50, 6))])
    ids = [*range(450), *[k % 20 for k in range(50)]]
    v[450:500] = v[[k % 20 for k in range(50)]]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = topk_search.top_k(topk_search.quantised(df), F.col("vec_id") % 10 == 0, k=4, shard_rows=40).collect()
    q = np.floor(v * 256).astype(np.int64)
    for i in range(0, 450, 10):
        best = sorted((-int(q[i] @ q[j]), ids[j]) for j in range(500) if ids[j] != i)[:4]
        assert sorted((r["rank"], -r["score"], r["vec_id"]) for r in got if r["query_id"] == i) == [(n + 1, *b) for n, b in enumerate(best)]


def test_pipeline_stages(spark, docs, tmp_path):
    docs.select(*OWN).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    first = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/kept").collect()), key=repr)
    (tmp_path / "kept/line_dedup/_SUCCESS").unlink()  # as if that stage had been cut off
    when = (tmp_path / "kept/toxicity/_SUCCESS").stat().st_mtime_ns
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path), f"{tmp_path}/kept").collect()), key=repr) == first
    assert (tmp_path / "kept/toxicity/_SUCCESS").stat().st_mtime_ns == when
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0


def _jaccard_groups(texts):
    """doc_ids in components of a five-word Jaccard similarity of 0.8 or more, by all pairs, and how many pairs there are."""
    sets = {i: (lambda w: frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)]))(t.lower().split()) for i, t in texts.items()}
    root, pairs = {i: i for i in sets}, 0
    ids = sorted(sets)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                pairs += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {find(i) for i in ids}, pairs


def test_near_copies_by_jaccard(spark):
    """Copies with some words changed, a family of many that all share prefixes, and a passage that unlike texts share."""
    import random

    rng = random.Random(7)
    some_words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    changed = lambda w, n: [f"x{rng.randrange(5000)}" if i in at else v for at in [set(rng.sample(range(len(w)), n))] for i, v in enumerate(w)]
    texts = []
    for n in (5, 9, 30, 120, 400):
        for _ in range(8):
            base = some_words(n)
            texts += [base, *[changed(base, max(1, n * k // 200)) for k in (1, 3, 4, 5, 6)]]
    family, passage = some_words(150), some_words(60)
    texts += [changed(family, 1 + k % 2) for k in range(120)] + [some_words(12) + passage for _ in range(40)] + [["one"], ["ONE"], ["two"]]
    rng.shuffle(texts)
    docs = {i: " ".join(w) for i, w in enumerate(texts)}
    kept, pairs = _jaccard_groups(docs)
    assert pairs > 200
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == sorted(kept)


def test_near_copies_are_linked_by_fingerprints_first(spark, monkeypatch):
    """The stage links five-word fingerprints as the operator does, compares the sets of what they link, and finds the other pairs too."""
    import numpy as np

    near, far = ([f"o{x}_{k}" for k in range(60)] for x in (8, 7))  # with one word changed they differ in 4 and in 15 bits
    texts = {1: near, 2: [*near[:30], "y", *near[31:]], 3: far, 4: [*far[:30], "y", *far[31:]], 5: [f"c{k}" for k in range(50)]}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string").repartition(3)
    made, linked = simhash.links, []

    def seen(distinct, budget):
        out = made(distinct, budget)
        linked.append(({r["fp"] for r in distinct.collect()}, [{r["a"]["fp"], r["b"]["fp"]} for r in out.collect()]))
        return out

    monkeypatch.setattr(simhash, "links", seen)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(df).collect()) == [1, 3, 5]
    hashed = df.select("doc_id", simhash.shingle_hashes(F.col("text"), 5).alias("hashes")).collect()
    fps = {r["doc_id"]: simhash._majority_bits(np.array(r["hashes"])) for r in hashed}
    assert [((fps[a] ^ fps[b]) & (2**64 - 1)).bit_count() for a, b in ((1, 2), (3, 4))] == [4, 15]
    assert linked == [(set(fps.values()), [{fps[1], fps[2]}])]


def test_components_of_few_links_are_few_partitions(spark):
    """Rounds over a few rows don't write a file for each shuffle partition."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long").repartition(30)
        found = simhash.components(edges)
        assert found.rdd.getNumPartitions() == 1 and {(r["node"], r["root"]) for r in found.collect()} == {(k, 0) for k in range(1, 41)}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_mixed_documents_keep_rows_without_an_id_apart(spark):
    """Rows that share a doc_id, or have none, come in as often and as long as the mixture says of each."""
    rows = [(None, "a b c", "s"), (None, " ".join(f"v{k}" for k in range(1000)), "s"), (None, " ".join(f"u{k}" for k in range(300)), "t"), (1, "x " * 50, "t"), (1, "y " * 200, "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted((r["source"], r["size"], r["taken"]) for r in mixing.mixture(df).collect())
    firsts = {t.split()[0]: (s, len(t.split())) for _, t, s in rows}
    got = dict.fromkeys(firsts, 0)
    for r in mixing.mixed_documents(df).collect():
        got[r["text"].split()[0]] += len(r["text"].split())
    assert sorted((*firsts[w], n) for w, n in got.items()) == want


def test_near_copies_keep_one_row_whatever_their_ids(spark):
    """Unlike texts that share an id all stay; copies without an id, and with one, are one row."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (None, c), (None, c), (None, c + " more"), (None, a), (2, "w " * 9)], "doc_id long, text string").repartition(3)
    left = sorted((r["doc_id"] or 0, r["text"][:2]) for r in simhash.one_of_each(df).collect())
    assert left == [(0, "c0"), (1, "a0"), (1, "b0"), (2, "w ")]


def test_stage_finds_passages_of_two_lines(spark):
    one, two = " ".join(f"p{k}" for k in range(30)), " ".join(f"q{k}" for k in range(25))
    df = spark.createDataFrame([(1, f"{one}\n{two}"), (2, f"start\n{one}\n{two}\nend"), (3, f"start\n{one}\nend")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(df).collect()} == {1: f"{one}\n{two}", 2: "start\nend", 3: f"start\n{one}\nend"}


def test_packer_opens_a_sequence_only_where_none_has_room():
    import numpy as np

    lengths = np.minimum(np.exp(np.random.default_rng(1).normal(6.2, 0.8, 8192)).astype(int) + 1, 4096)
    bins, offsets = packing.sum_of_squares(lengths)
    room = np.full(bins.max() + 1, 4096)
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        if bins[i] == used:
            assert (room[:used] < lengths[i]).all()
            used += 1
        assert offsets[i] == 4096 - room[bins[i]]
        room[bins[i]] -= lengths[i]
    assert room.min() >= 0
