"""Fill-in-middle, turn repair and byte-level BPE against plain Python, on odd rows and on the driver's tables."""

import base64
import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import byte_bpe, fill_in_middle, queries, turn_repair
from tests.conftest import MIDDLE
from tests.llm.test_contracts import table
from tests.llm.test_edges import LONG, ROWS

sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


# --- fill in middle


def plain_fim(doc_id, text):
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    d, n = sha(f"42:{'' if doc_id is None else doc_id}"), len(tokens)
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    return (n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}") if h[3] % 100 < 80 else (n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}")


def test_fill_in_middle_on_odd_texts(spark):
    rng = random.Random(5)
    odd = ["<", "<S", ">", "P>", "<<S", " ", "\n", "\x0b", "a", "é", "東", "😀", "\x1c", "\xa0", "\x00"]
    texts = [*(t for _, t, _ in ROWS), "has <P> in it", "<S>", "  only behind \r\n", " \t ", *("".join(rng.choice(odd) for _ in range(rng.randrange(40))) for _ in range(400))]
    rows = [(None if k % 50 == 7 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("own") for c in ("n", "form", "output", "restored")}).repartition(3)
    out = fill_in_middle.restore(fill_in_middle.transform(df)).collect()
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in out)
    assert got == Counter((i, *plain_fim(i, t or ""), t or "") for i, t in rows) and {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(df.filter("false")).count() == 0


def test_fill_in_middle_rates(spark):
    df = spark.createDataFrame([(k, f"a b c {k}") for k in range(300)], "doc_id long, text string")
    assert fill_in_middle.transform(df, rate=0).filter("form <> 'plain'").count() == 0
    assert fill_in_middle.transform(df, rate=100, spm=0).filter("form <> 'psm'").count() == 0
    assert fill_in_middle.transform(df, seed=7).exceptAll(fill_in_middle.transform(df)).count() > 0


# --- turn repair


def plain_damage(rows):
    out, ids = defaultdict(list), {r["conv_id"] for r in rows}
    for r in rows:
        part = lambda x: " " if x is None else str(x)
        draw = zlib.crc32(f"{part(r['conv_id'])}:{part(r['turn'])}".encode()) % 20
        role, text = part(r["role"]), part(r["text"])
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(draw, text)
        out[r["conv_id"]] += [(r["turn"], "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return {i: sorted(out[i], key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for i in ids}


def plain_repair(rows):
    """Counts by the contract's words; the cheapest edits by a best-first search over whole edit strings."""
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None)
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    start = (0, "", 0, "", ())
    heap, done = [start], set()
    while True:
        cost, audit, i, roles, said = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            break
        key = (i, roles[-1:] if roles != "s" else "S")
        if (key, "done") in done:  # cheaper or earlier in ASCII before
            continue
        done.add((key, "done"))
        legal = lambda x: re.fullmatch("s?(ua)*u?", roles + x) is not None  # noqa: E731, B023
        for name in ("user", "assistant"):
            if legal(name[0]):
                heapq.heappush(heap, (cost + 3, audit + "I", i, roles + name[0], (*said, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, roles, said))
            more = 3 if faults[i] == "truncated" else 0
            if faults[i] not in ("blank", "duplicate"):
                if role and legal(role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, roles + role[0], (*said, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if legal(name[0]):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, roles + name[0], (*said, f"{name}:{text}")))
    n = Counter(faults)
    pairs = zip(rows, rows[1:], strict=False)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, n["blank"], n["duplicate"], n["truncated"], sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, sha("\n".join(said))


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _conversations():
    rng, rows = random.Random(11), []
    for c in range(160):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "umpire", "", None]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            rows.append((None if c == 5 else c, rng.choice([turn, turn, turn, 7 * turn, None]), role, rng.choice(["Yes.", "No", "So?  \n", "x" * 30 + "!", "é. 東", "", " \t", None, "same.", f"w{turn}."])))
    return rows + [(900, 0, "user", "a. b"), (900, 0, "user", "a. b"), (901, None, None, None)]


def _dicts(rows):
    return [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows]


@pytest.mark.parametrize("large", [None, 0, 3])
def test_turn_repair_by_search(spark, large):
    """The whole way, the way in blocks for all conversations, and both."""
    rows = _conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("fault", "place", "block", "large_id", "present")}).repartition(3)
    own = {} if large is None else {"large_turns": large, "block_rows": 2}
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.report(turn_repair.edits(turn_repair.damaged(df), **own)).select(*NAMES).collect()}
    assert got == {i: plain_repair(own) for i, own in plain_damage(_dicts(rows)).items()}
    assert {"D", "I", "K", "R"} <= set("".join(r[6] for r in got.values()))


def test_turn_repair_on_the_given_table(spark):
    want = {i: plain_repair(own) for i, own in plain_damage(table("conversations", MIDDLE)).items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.op12_turn_repair(spark, MIDDLE).select(*NAMES).collect()} == want


def test_turn_repair_of_a_hot_conversation(spark):
    """One conversation with most rows, half of them alike: it goes in blocks, and what comes out is in order and legal."""
    hot = [(1, None, "user", "again."), *[(1, k % 3000, ("user", "assistant", "tool")[k % 3], f"turn {k}" + "." * (k % 5 > 0)) for k in range(6000)]]
    df = spark.createDataFrame([*hot, (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")], "conv_id long, turn long, role string, text string")
    many = df.union(spark.range(6000).selectExpr("1L", "CAST(NULL AS LONG)", "'user'", "'again.'"))
    turns = turn_repair.turns_of(many)
    whole, parts = (turn_repair.edits(turns, large_turns=n, block_rows=500) for n in (10**6, 5000))
    a, b = (turn_repair.report(x).orderBy("conv_id").collect() for x in (whole, parts))
    assert a == b and a[0]["audit"].startswith("KDDDD") and a[0]["duplicate"] == 6000 and a[1]["audit"] == "KK"
    said = "".join(r["role"][0] for r in turn_repair.repaired(parts).filter("conv_id = 1").orderBy("place").collect())
    assert re.fullmatch("(s?(ua)+)?", said) and parts.filter("conv_id = 1").agg(F.max("place") + 1 == F.count("*")).first()[0]


def test_turn_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.report(turn_repair.edits(turn_repair.damaged(df))).count() == 0


# --- byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_perfect_and_minimal():
    rng = random.Random(2)
    for n in (1, 2, 7, 500, 20_000):
        keys = list({rng.randbytes(rng.randrange(1, 12)) for _ in range(n)})
        found = byte_bpe.MinimalPerfectHash(keys)
        assert sorted(map(found.slot, keys)) == list(range(len(keys)))
    with pytest.raises(ValueError):
        byte_bpe.MinimalPerfectHash([b"a", b"a"])


def test_ids_are_the_library_s(library):
    coder = byte_bpe.byte_bpe(byte_bpe.default_path(byte_bpe.RANKS))
    rng = random.Random(3)
    parts = ["a", "e", "é", "th", " ", "  ", "\n", "\r\n", "東", "😀", "12", "²", "'s", "'LL", "...", "ing", "\xa0", "\x1c", "\x85", "<|endoftext|>", "ß", "​", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(3000)]
    texts += ["".join(map(chr, range(a, a + 256))) for a in (0, 256, 0x370, 0x3000, 0x1F600)] + ["a" * 30_000, " " * 30_000 + "x", "東" * 9000, LONG * 4, "x y " * 300_000]
    for text in texts:
        ids = np.frombuffer(coder.encode(text), dtype="<u4").tolist()
        assert ids == library.encode_ordinary(text), text[:80]
        assert coder.decode(ids) == text.encode()


def test_bpe_over_odd_rows(spark, library):
    df = spark.createDataFrame([(i, t) for i, t, _ in ROWS], "doc_id long, text string").withColumns({c: F.lit("own") for c in ("ids", "n_tokens", "decoded")}).repartition(2)
    for packed in (False, True):
        out = byte_bpe.decode(byte_bpe.encode(df, packed=packed).withColumn("decoded", F.lit("own"))).collect()
        ids = lambda r: tuple(np.frombuffer(r["ids"], dtype="<u4").tolist() if packed else r["ids"])  # noqa: E731, B023
        assert Counter((r["doc_id"], r["n_tokens"], ids(r), bytes(r["decoded"])) for r in out) == Counter((i, len(w), tuple(w), (t or "").encode()) for i, t, _ in ROWS for w in [library.encode_ordinary(t or "")])
    assert byte_bpe.decode(byte_bpe.encode(df.filter("false"))).count() == 0
    assert byte_bpe.decode(spark.createDataFrame([(1, None)], "k int, ids array<int>")).first()["decoded"] is None
    with pytest.raises(Exception, match="no id of the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [50256])], "k int, ids array<int>")).collect()


def test_bpe_on_the_given_table(spark, library):
    got = {r["doc_id"]: tuple(r) for r in queries.op13_byte_bpe(spark, MIDDLE).collect()}
    docs = table("documents", MIDDLE)
    ids = [np.array(library.encode_ordinary(d["text"] or ""), dtype="<u4") for d in docs]
    assert got == {d["doc_id"]: (d["doc_id"], len(w), sha(w.tobytes()), sha(d["text"] or "")) for d, w in zip(docs, ids, strict=True)}
