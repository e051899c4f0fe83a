"""Chat formatting into budgeted windows of whole turns.

A conversation is rendered turn by turn. Prefix sums of the turns' token counts choose
how many whole turns a window takes: the system turn comes first in each window, then as
much of the turns just before as a history budget allows, then new turns while they fit;
a turn that is larger than the budget has a window of its own and stays whole. The loss
mask covers the texts of assistant turns where they are new, so that repeated history is
read but not learnt twice.

A turn is ``### Role: text</turn>`` and a line break; backslashes, ``###`` and ``</turn>``
inside a text (and any unusual role) are escaped so that the window reads back exactly.

Rows are dealt by conversation and sorted by turn; a conversation then streams through
its task, which holds the system turn, the history and the window that is being filled.

Defined results: a null text is empty; a null or unknown role is kept as it is and never
under the mask; rows of one turn number stand in order of role and text, and repeated
rows are turns of their own; rows with a null conv_id form one conversation; only a
system turn at the start is retained, later ones are ordinary turns; an empty table
gives an empty table; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import default_path, word_tokens

BUDGET, HISTORY = 1024, 256
END = "</turn>"
ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}

_SPECIAL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(\\|###|</turn>)")
_HEADER = re.compile(r'### (?:(System|User|Assistant)|Other\((null|"(?:[^"\\]|\\.)*")\)): ')
_STOP = re.compile(r"\\(?:\\|###|</turn>)|</turn>")


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def header(role: str | None) -> str:
    return f"### {ROLES[role]}: " if role in ROLES else f"### Other({json.dumps(role)}): "


def parse(text: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of every turn of a window; start and end are of the escaped text."""
    out, at = [], 0
    while at < len(text):
        head = _HEADER.match(text, at)
        role = head[1].lower() if head[1] else json.loads(head[2])
        stop = head.end()
        while True:
            m = _STOP.search(text, stop)
            if m[0] == END:
                break
            stop = m.end()
        out.append((role, unescape(text[head.end() : m.start()]), head.end(), m.start()))
        at = m.end() + 1
    return out


class _Turn:
    """A rendered turn; ``before`` and ``upto`` are prefix sums of its conversation's tokens."""

    def __init__(self, role: str | None, text: str | None, before: int, count):
        self.role, self.head, self.body = role, header(role), escape(text or "")
        self.tokens = count(f"{self.head}{self.body}{END}\n")
        self.before, self.upto = before, before + self.tokens


def turn_windows(turns: Iterable[_Turn], budget: int, history: int) -> Iterator[tuple[list[_Turn], list[_Turn]]]:
    """(repeated turns, new turns) of each window, reading the turns once."""
    system: list[_Turn] = []
    past: list[_Turn] = []  # taken turns, the system turn aside, as far back as history may reach
    repeated: list[_Turn] = []
    new: list[_Turn] = []
    for turn in turns:
        if new and turn.upto - new[0].before > budget - sum(t.tokens for t in repeated):
            yield repeated, new
            past = [t for t in past + new if t.before >= turn.before - history and t not in system]
            new = []
        if not new:
            room = min(history, budget - sum(t.tokens for t in system) - turn.tokens)
            repeated = system + [t for t in past if t.before >= turn.before - room]
        if turn.before == 0 and turn.role == "system" and not system:
            system = [turn]
        new.append(turn)
    if new:
        yield repeated, new


def _streams(batches, keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Sorted rows as (key, rows of that key), across batches; a key's rows must be read before the next key."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: r[:keys]):
        yield key, own


WINDOWS = "conv_id long, window int, text string, n_repeated int, n_new int, mask array<struct<start: int, end: int>>, n_tokens int, over_budget boolean"


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, path: str | None = None) -> DataFrame:
    """One row for each window, those of a conversation together and in order; mask is in characters of text."""
    path = path or default_path()

    def rendered(rows, count):
        at = 0
        for _, _, role, text in rows:
            turn = _Turn(role, text, at, count)
            at = turn.upto
            yield turn

    def run(batches):
        encoder, out = word_tokens(path), []
        for (conv_id,), rows in _streams(batches, 1):
            for n, (repeated, new) in enumerate(turn_windows(rendered(rows, lambda t: len(encoder(t))), budget, history)):
                text, mask = "".join(f"{t.head}{t.body}{END}\n" for t in repeated), []
                for t in new:
                    if t.role == "assistant":
                        mask.append({"start": len(text) + len(t.head), "end": len(text) + len(t.head) + len(t.body)})
                    text += f"{t.head}{t.body}{END}\n"
                size = sum(t.tokens for t in repeated + new)
                out.append((conv_id, n, text, len(repeated), len(new), mask, size, size > budget))
                if len(out) >= 256:
                    yield _batch(out, WINDOWS_ARROW)
                    out = []
        if out:
            yield _batch(out, WINDOWS_ARROW)

    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
WINDOWS_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("mask", _SPANS), ("n_tokens", pa.int32()), ("over_budget", pa.bool_())]
)
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of every conversation, taken from the text and the mask of its windows as format_windows leaves them."""

    def run(batches):
        out = []
        for (conv_id,), rows in _streams(batches, 1):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, n_repeated, mask in rows:
                chars += len(text)
                for role, own, _, _ in parse(text)[n_repeated:]:
                    n_turns += 1
                    turns.update(f"{role or ''}\n{own}\n".encode())
                for span in mask:
                    own = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(own)
                    loss.update(own.encode())
            out.append((conv_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) >= 1024:
                yield _batch(out, DIGEST_ARROW)
                out = []
        if out:
            yield _batch(out, DIGEST_ARROW)

    return windows.select("conv_id", "text", "n_repeated", "mask").mapInArrow(run, DIGEST)
