"""Fill-in-middle transformation of whole texts.

A text is decoded to an array of code points. Comparing the class (white space or not)
of neighbours gives the ends of its tokens: a word with the white space before it, or
the white space a text ends with. Two draws choose among the places before, between and
behind the tokens; the array is sliced there and the pieces are written again in one of
two orders: prefix, suffix, middle (psm) or suffix, prefix, middle (spm). Draws are taken from a digest
of seed and doc_id, so reruns and lost executors change nothing. Markers have no common
beginnings and ends, hence a text without them is read back exactly (:func:`restore`).

Work is one pass over the documents without a shuffle; a task holds a few texts.

Defined results: a null text is empty, and an empty text, or one that holds a marker,
stays plain; rows with a null doc_id draw as for an empty id; repeated rows give
repeated results; an empty table gives an empty table; columns beyond doc_id and text
are left behind, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Percent of texts that are rearranged, and percent of these in the order suffix, prefix, middle.
RATE, SPM = 50, 80
#: Characters of output that a task gathers before it hands them on; a longer text goes alone.
BATCH_CHARS = 4_000_000

FORMS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def token_ends(points: np.ndarray) -> np.ndarray:
    """Where each token of the code points ends: at a word's last character, and at the end of the text."""
    if not len(points):
        return np.array([], dtype=np.int64)
    blank = (points == 0x20) | (points - np.uint32(9) <= 4)  # 09 to 0D; smaller ones wrap round
    return np.append(np.flatnonzero(~blank[:-1] & blank[1:]) + 1, len(points))


def draws(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(tokens, form, characters of the prefix, of the middle, output) of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = token_ends(points)
    n, (first, second, whether, order) = len(ends), draws(seed, doc_id)
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= rate:
        return n, "plain", None, None, text
    places = np.append(0, ends)
    low, high = sorted((int(places[first % (n + 1)]), int(places[second % (n + 1)])))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:low], points[low:high], points[high:]))
    if order % 100 < spm:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(documents: DataFrame, text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (null where plain) and the output of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
        for batch in batches:
            for doc_id, own in zip(batch.column(0), batch.column(1), strict=True):
                doc_id = doc_id.as_py()
                out.append((doc_id, *rearranged(own.as_py(), doc_id, seed, rate, spm)))
                chars += len(out[-1][-1])
                if chars >= BATCH_CHARS:
                    yield batch_of()
                    out, chars = [], 0
        if out:
            yield batch_of()

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, FORMS)


def restore(transformed: DataFrame, text: str = "restored") -> DataFrame:
    """transformed with the text as it was, read from output and form alone."""
    body = F.substr("output", F.lit(len(PREFIX) + 1))
    psm, spm = F.split(body, f"{SUFFIX}|{MIDDLE}", 3), F.split(body, f"{PREFIX}|{MIDDLE}", 3)
    own = (
        F.when(F.col("form") == "psm", F.concat(psm[0], psm[2], psm[1]))
        .when(F.col("form") == "spm", F.concat(spm[1], spm[2], spm[0]))
        .otherwise(F.col("output"))
    )
    return transformed.withColumn(text, own)
