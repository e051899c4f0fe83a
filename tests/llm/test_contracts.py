"""The registered queries against DuckDB or brute force on the driver's small tables."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

from codeloom.llm import queries
from tests.conftest import MIDDLE, SMALL

SEPARATORS = " \t\n\x0b\x0c\r"


def words(text):
    return (text or "").translate(str.maketrans(SEPARATORS, " " * 6)).split(" ")


def table(name, sf_dir=SMALL):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/{name}.parquet'").df().replace({np.nan: None}).to_dict("records")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(agree, name):
    agree(queries.queries()[name], queries.oracle_sql()[name])


def test_mixture_is_near_its_targets(spark):
    rows = queries.op1_mixing(spark, MIDDLE).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all()
    sources = {r["doc_id"]: r["source"] for r in table("documents", MIDDLE)}
    per = rows.assign(source=rows["doc_id"].map(sources)).groupby("source", dropna=False).agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(per["taken"] - per["target"]) <= 0.02 * per["target"] + 128).all()
    assert abs(per["target"].sum() - min(1.5 * per["source_size"].sum(), 2 * per["source_size"].sum())) < 1


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in words(lower) if x]
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(spark):
    docs = table("documents")
    prints = {r["doc_id"]: fingerprint(r["text"]) for r in docs}
    ids, fps = list(prints), np.array(list(prints.values()), dtype=np.uint64)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for m in np.flatnonzero(np.bitwise_count(fps[:k] ^ fps[k]) <= 4):
            a, b = sorted((find(i), find(ids[m])))
            root[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, SMALL).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in ids}
    assert len({v[1] for v in got.values()}) < len(ids)


def test_packing_is_gapless_and_near_the_bound(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in table("documents", MIDDLE):
        ids = np.array([*encoder.encode(r["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes()))
    rows = queries.op6_packing(spark, MIDDLE).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(places) <= -(-sum(r["length"] for r in rows) // 4096) * 1.02 + 2


def test_chat_digests_by_brute_force(spark):
    rows = table("conversations") + [{"conv_id": -7, "turn": k, "role": role, "text": r"\### Assistant: </turn> ok"} for k, role in enumerate(("user", "assistant"))]
    turns = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        turns[r["conv_id"]].append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.op5_chat_format(spark, SMALL).collect()}
    assert got.keys() == turns.keys()
    for conv_id, own in turns.items():
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[conv_id]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in own).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] >= sum(len(t) for _, t in own)


def test_token_counts_by_offsets(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = defaultdict(dict)
    for r in queries.op3_token_counts(spark, SMALL).collect():
        got[r["doc_id"]][r["section"]] = r
    for doc in table("documents"):
        text = doc["text"] or ""
        ids = encoder.encode_ordinary(text)
        line_of = [k for k, line in enumerate(text.split("\n")) for _ in range(len(line) + 1)][: len(text)]
        own, at = defaultdict(int), 0
        raw = text.encode()
        char_at = np.cumsum([(b & 0xC0) != 0x80 for b in raw]) - 1
        for token in ids:
            size = len(encoder.decode_single_token_bytes(token))
            lines = [line_of[c] for c in range(char_at[at], char_at[at + size - 1] + 1)]
            own[max(sorted(set(lines)), key=lines.count)] += 1
            at += size
        rows = got[doc["doc_id"]]
        assert sum(r["n_tokens"] for r in rows.values()) == len(ids) == rows[0]["doc_tokens"]
        assert {k: r["n_tokens"] for k, r in rows.items() if r["n_tokens"]} == dict(own)


@pytest.mark.parametrize("query, label, n, fold, least", [("op4_toxicity", "toxic", 5, 0, 0.95), ("op10_quality_classifier", "quality", 3, 1, 0.8)])
def test_held_out_ranking(spark, query, label, n, fold, least):
    """The area under the curve over labelled rows that were not learnt from."""
    rows = {r["doc_id"]: r for r in queries.queries()[query](spark, "/root/testdata/sf0.1").collect()}
    assert all((zlib.crc32(str(i).encode()) % n == fold) == r["held_out"] and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in rows.items())
    known = [(rows[x["doc_id"]]["score"], x[label]) for x in table("labels", "/root/testdata/sf0.1") if rows[x["doc_id"]]["held_out"] and x[label] is not None]
    ones, zeros = np.array([s for s, y in known if y == 1]), np.array([s for s, y in known if y == 0])
    area = np.mean((ones[:, None] > zeros) + 0.5 * (ones[:, None] == zeros))
    print(query, "area", area, "right", np.mean([(s >= 0.5) == y for s, y in known]), "of", len(known))
    assert area >= least
