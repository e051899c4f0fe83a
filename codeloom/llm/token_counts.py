"""Token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole, by a byte-level tokenizer. The byte lengths of
its tokens, summed up, give every token's span of characters, and an interval join
against the spans of the document's sections (by default its lines, each with its line
break) says which section a token belongs to. A token that crosses a boundary goes to
one section by an explicit rule: ``most`` (where most of its characters lie, the earlier
one on a tie), ``first`` or ``last``. Counts of all sections add up to the document's.

Work is one pass over the documents without a shuffle.

Defined results: a null or empty text is one section without tokens; a token that is a
part of one character spans that character; repeated rows give repeated results; a null
doc_id is carried along; an empty table gives an empty table; columns beyond doc_id and
text are left alone.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .tokens import default_path

RULES = ("most", "first", "last")


class ByteTokens:
    """Ids and byte lengths of whole texts from a file of ranked byte strings."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def lengths(self, text: str) -> np.ndarray:
        """The bytes of each token of the text."""
        return self.sizes[np.array(self.encoding.encode_ordinary(text), dtype=np.int64)]


@lru_cache(maxsize=2)
def byte_tokens(path: str) -> ByteTokens:
    return ByteTokens(path)


def character_spans(lengths: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last character of each token of the UTF-8 bytes raw."""
    ends = np.cumsum(lengths)
    if len(raw) and raw.isascii():
        return ends - lengths, ends
    begins = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    at = np.cumsum(begins) - 1  # the character of every byte
    return at[ends - lengths], at[ends - 1] + 1


def line_spans(text: str) -> np.ndarray:
    """Starts of the sections of a text, and its length: its lines with their breaks."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    starts = np.concatenate([[0], ends[:-1]])
    return np.append(starts[starts < max(len(text), 1)], len(text))


def attribute(begin: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str = "most") -> tuple[np.ndarray, int]:
    """Tokens of each section [edges[k], edges[k+1]), and how many tokens crossed an edge."""
    first = np.searchsorted(edges, begin, side="right") - 1
    last = np.searchsorted(edges, np.maximum(end, begin + 1) - 1, side="right") - 1
    own = last if rule == "last" else first.copy()
    crossing = np.flatnonzero(first < last)
    if rule == "most":
        for t in crossing:
            parts = np.minimum(edges[first[t] + 1 : last[t] + 2], end[t]) - np.maximum(edges[first[t] : last[t] + 1], begin[t])
            own[t] = first[t] + int(parts.argmax())
    return np.bincount(own, minlength=len(edges) - 1)[: len(edges) - 1], len(crossing)


def section_counts(documents: DataFrame, text: str = "text", path: str | None = None, rule: str = "most") -> DataFrame:
    """doc_id, section (from 0), start and end in characters, n_tokens; doc_tokens and crossing are the document's."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or default_path("byte_bpe_50k.tiktoken")
    names = ["doc_id", "section", "start", "end", "n_tokens", "doc_tokens", "crossing"]
    schema = "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long, crossing long"

    def count(batches):
        tokens = byte_tokens(path)
        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), []
            for text in batch.column(1).to_pylist():
                edges = line_spans(text)
                begin, end = character_spans(tokens.lengths(text), text.encode())
                own, crossing = attribute(begin, end, edges, rule)
                parts.append((edges, own, len(begin), crossing))
            sizes = [len(p[1]) for p in parts]
            flat = lambda k: np.concatenate([k(p) for p in parts]) if parts else np.array([], dtype=np.int64)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, n in zip(ids, sizes, strict=True) for _ in range(n)], pa.int64()),
                    pa.array(flat(lambda p: np.arange(len(p[1]), dtype=np.int32)), pa.int32()),
                    pa.array(flat(lambda p: p[0][:-1]), pa.int64()),
                    pa.array(flat(lambda p: p[0][1:]), pa.int64()),
                    pa.array(flat(lambda p: p[1]), pa.int64()),
                    pa.array(np.repeat(np.array([p[2] for p in parts], dtype=np.int64), sizes)),
                    pa.array(np.repeat(np.array([p[3] for p in parts], dtype=np.int64), sizes)),
                ],
                names=names,
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(count, schema)
