"""Byte-level BPE: whole texts to token ids, and ids back to bytes.

A pattern splits a text into pre-tokens, which are encoded each by itself in two tiers.
A minimal perfect hash over the vocabulary, one slot for each entry and none free,
resolves a pre-token that is an entry by one look at its slot. The others start as a
linked list of single bytes, whose neighbours wait in a heap by the rank of what they
would merge to, leftmost first; a merge relinks its neighbours and pushes two new pairs,
so a pre-token of n bytes takes n log n steps however long it is. A worker remembers short
pre-tokens it has met, a bounded number of them.

Work is one pass over the documents without a shuffle, in batches of bounded size.

Defined results: a null or empty text has no ids and decodes to no bytes; strings of
special tokens are ordinary text; null ids decode to null, an id outside the vocabulary
is an error; repeated rows give repeated results; a null doc_id is carried along; an
empty table gives an empty table; columns beyond doc_id and text are left behind by
:func:`encode`, whatever their names.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import default_path

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers, in two generations; longer ones than so many characters are encoded anew.
MEMO, MEMO_CHARS = 300_000, 48
#: Bytes of ids or of decoded text that a task gathers before it hands them on.
BATCH_BYTES = 8_000_000

_MASK, _SPREAD, _MIX = 2**64 - 1, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


class MinimalPerfectHash:
    """A slot of its own in [0, n) for each of n different keys; other keys land anywhere, so compare what lies there.

    Keys are dealt to buckets by their hash. Buckets are placed from the largest on: each
    takes the first displacement that brings its keys to free slots, and a bucket of one
    key is written straight to a slot left over.
    """

    def __init__(self, keys: list[bytes], load: int = 3):
        self.n, self.m = len(keys), max(1, -(-len(keys) // load))
        for self.seed in count():
            hashes = np.array([xxhash.xxh3_64_intdigest(k, self.seed) for k in keys], dtype=np.uint64)
            if len(np.unique(hashes)) == self.n and (displaced := self._placed(hashes)) is not None:
                break
            if len(set(keys)) < self.n:
                raise ValueError("keys must differ")
        self.displaced = displaced.tolist()

    def _placed(self, hashes: np.ndarray, rounds: int = 200_000) -> np.ndarray | None:
        bucket = (hashes % np.uint64(self.m)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.m)
        starts = np.cumsum(sizes) - sizes
        displaced, taken = np.zeros(self.m, dtype=np.int64), np.zeros(self.n, dtype=bool)
        owner = np.empty(self.n, dtype=np.int64)
        for size in range(int(sizes.max(initial=0)), 1, -1):
            left = np.flatnonzero(sizes == size)
            keys = hashes[order[starts[left][:, None] + np.arange(size)]]
            for d in range(rounds):
                if not len(left):
                    break
                at = (((keys ^ np.uint64(d * _SPREAD & _MASK)) * np.uint64(_MIX) >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)
                free = np.flatnonzero(~taken[at].any(axis=1) & (np.diff(np.sort(at, axis=1)) > 0).all(axis=1))
                owner[at[free[::-1]].ravel()] = np.repeat(free[::-1], size)
                won = free[(owner[at[free]] == free[:, None]).all(axis=1)]
                taken[at[won].ravel()] = True
                displaced[left[won]] = d
                keep = np.ones(len(left), dtype=bool)
                keep[won] = False
                left, keys = left[keep], keys[keep]
            else:
                return None
        alone = np.flatnonzero(sizes == 1)
        displaced[alone] = -1 - np.flatnonzero(~taken)[: len(alone)]
        return displaced

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key, self.seed)
        d = self.displaced[h % self.m]
        return -1 - d if d < 0 else ((h ^ (d * _SPREAD & _MASK)) * _MIX & _MASK) // 2**32 % self.n


#: Texts for which the patterns of both libraries agree; the separators 1C to 1F are white space for one of them only.
_LATIN = re.compile("[\t-\r\x20-\xff]*")


def _latin(pattern: str) -> re.Pattern | None:
    """The pattern for texts of Latin-1 characters, for the faster library, where it names no classes but letters and numbers."""
    own = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    inner = re.sub(r"\[[^\]]*\]", lambda m: re.sub(r"\\p\{([LN])\}", lambda k: own[k[1]], m[0]), pattern)
    outer = re.sub(r"\\p\{([LN])\}", lambda k: f"[{own[k[1]]}]", inner)
    return None if r"\p" in outer.lower() else re.compile(outer)


class ByteBpe:
    """Encoder and decoder of a file of ranked byte strings; ids are unsigned 32-bit, little-endian."""

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        pattern = pattern or public_tokenizers.PATTERN
        self.pattern, self.latin = regex.compile(pattern), _latin(pattern)
        self.ranks = ranks
        self.hash = MinimalPerfectHash(list(ranks))
        self.entries: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)
        for entry, rank in ranks.items():
            at = self.hash.slot(entry)
            self.entries[at], self.ids[at] = entry, rank
        self.table = {rank: entry for entry, rank in ranks.items()}
        self.memo = _Memo(self)

    def whole(self, raw: bytes) -> int | None:
        """The id of a pre-token that is an entry."""
        at = self.hash.slot(raw)
        return self.ids[at] if self.entries[at] == raw else None

    def merged(self, raw: bytes) -> list[int]:
        """Ids of a pre-token that is no entry itself."""
        n, rank = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # a token is known by its first byte; end is where the next begins, 0 once it is gone
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, left, right, stop = heappop(heap)
            if end[left] != right or end[right] != stop:
                continue  # one of the two has merged since
            end[left], end[right] = stop, 0
            if stop < n:
                before[stop] = left
                if (r := rank(raw[left : end[stop]])) is not None:
                    heappush(heap, (r, left, stop, end[stop]))
            if (prior := before[left]) >= 0 and (r := rank(raw[prior:stop])) is not None:
                heappush(heap, (r, prior, left, stop))
        out, at = [], 0
        while at < n:
            if (r := rank(raw[at : end[at]])) is None:
                raise ValueError(f"the vocabulary lacks the byte {raw[at]}")
            out.append(r)
            at = end[at]
        return out

    def pre_token(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.whole(raw)
        return array("I", self.merged(raw) if whole is None else [whole]).tobytes()

    def encode(self, text: str) -> bytes:
        pattern = self.latin if self.latin is not None and _LATIN.fullmatch(text) else self.pattern
        found = pattern.findall(text) if len(text) < 2**20 else (m[0] for m in pattern.finditer(text))
        return b"".join(map(self.memo.__getitem__, found))

    def decode(self, ids: list[int]) -> bytes:
        try:
            return b"".join(map(self.table.__getitem__, ids))
        except KeyError as missing:
            raise ValueError(f"{missing} is no id of the vocabulary") from None


class _Memo(dict):
    """pre-token -> its ids, in two generations of at most MEMO each."""

    def __init__(self, coder: ByteBpe):
        self.coder, self.older = coder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.coder.pre_token(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    """One coder for each worker process and file."""
    return ByteBpe(path)


def _chunks(column: pa.Array, code) -> Iterator[tuple[int, list]]:
    """(first row, results) of runs of rows whose results hold about BATCH_BYTES."""
    at, out, size = 0, [], 0
    for k, value in enumerate(column):
        out.append(code(value.as_py()))
        size += len(out[-1] or b"")
        if size >= BATCH_BYTES:
            yield at, out
            at, out, size = k + 1, [], 0
    if out:
        yield at, out


def encode(documents: DataFrame, text: str = "text", path: str | None = None, packed: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of every document; packed ids are binary, four bytes an id, the least first."""
    path = path or default_path(RANKS)

    def run(batches):
        coder = byte_bpe(path)
        for batch in batches:
            for at, own in _chunks(batch.column(1), coder.encode):
                sizes = np.array([len(x) // 4 for x in own], dtype=np.int64)
                if packed:
                    ids = pa.array(own, pa.binary())
                else:
                    ids = pa.ListArray.from_arrays(np.append(0, np.cumsum(sizes)).astype(np.int32), np.frombuffer(b"".join(own), dtype="<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(own)), pa.array(sizes), ids], names=["doc_id", "n_tokens", "ids"])

    schema = f"doc_id long, n_tokens long, ids {'binary' if packed else 'array<int>'}"
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """tokens, with their ids as an array or packed, and the bytes these stand for as ``decoded`` (in place of a column of that name)."""
    path = path or default_path(RANKS)
    tokens = tokens.drop("decoded")
    names, packed = tokens.columns, dict(tokens.dtypes)["ids"] == "binary"
    at = names.index("ids")

    def run(batches):
        coder = byte_bpe(path)
        unpacked = lambda x: coder.decode(np.frombuffer(x, dtype="<u4").tolist() if packed else x)
        for batch in batches:
            for first, own in _chunks(batch.column(at), lambda x: None if x is None else unpacked(x)):
                part = batch.slice(first, len(own))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary())], names=[*names, "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields) + ", decoded binary"
    return tokens.mapInArrow(run, schema)
