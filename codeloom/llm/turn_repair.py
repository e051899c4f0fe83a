"""Repair of conversation structure by the cheapest edits.

A conversation should read: a system turn or none, then user and assistant by turns,
ended by an assistant. Turns in order are kept, given another role or deleted, and empty
turns inserted. Going backward over the turns, a dynamic programme takes the least cost
still to come for each state of that grammar (nothing yet, behind a system, a user or an
assistant turn); a walk forward then takes, among the edits on which the cost is tight,
the one whose letter comes first in ASCII. The edits are rows of their own, from which
the repaired turns are rebuilt (:func:`repaired`) and counted and hashed (:func:`report`).

Conversations of a bounded size are dealt by conversation, sorted, and repaired in one
pass. Larger ones, of which there may be one that holds a third of all rows, go another exact way:
equal rows are counted before they are shuffled, rows are dealt by ranges of (conversation,
turn, role, text), and each block of a range becomes a table of least costs from state to
state. These tables are few and small; folded backward they give every block its cost to
go, after which a conversation streams through its task block by block. (A digest of one
conversation is sequential by nature.) Both ways give the same edits.

Defined results: a null role or text is one space, as is a null in the key of
:func:`damaged`; rows stand in order of turn (nulls first), role and text, and repeated
rows are turns of their own; rows with a null conv_id form one conversation; one without
turns has one row without an edit; an empty table gives an empty table; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATOR_CHARS, checkpointed, small

#: Conversations of more turns or characters than these are repaired in blocks; a block ends behind so many rows or characters.
LARGE_TURNS, LARGE_CHARS = 20_000, 16_000_000
BLOCK_ROWS, BLOCK_CHARS = 4_096, 8_000_000

#: Costs of the edits, and what a truncated turn adds that is not deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEVER = 2**50
#: States of the grammar by number: nothing yet, behind a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind an inserted or reroled turn, by the state before it.
GROWN = (USER, USER, ASSISTANT, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")

TURN = "conv_id long, turn long, role string, text string, fault string, copies long, first boolean"
EDITS = "conv_id long, place long, edit string, turn long, fault string, old_role string, role string, text string"
_EDITS_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("fault", pa.string()), ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string())]
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_REPORT_ARROW = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text of all rows, nulls read as stated; ``present`` is false for rows that only name a conversation."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(True).alias("present"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns with seeded damage: by the key's crc32 mod 20 a row is dropped, emptied, loses its stops, is repeated, or is the user's."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    drawn = turns_of(conversations).withColumn("draw", draw)
    d = F.col("draw")
    return drawn.select(
        "conv_id",
        "turn",
        F.when(d == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(d == 1, "").when(d == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (d != 0).alias("present"),
        F.explode(F.when(d == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def settled(costs: Iterable[int]) -> tuple[int, int, int, int]:
    """Costs to go of the four states where turns may be inserted first."""
    start, system, user, assistant = costs
    user, assistant = min(user, INSERT + assistant), min(assistant, INSERT + user)
    return min(start, INSERT + user), min(system, INSERT + user), user, assistant


#: Costs to go behind the last turn.
END = settled((0, NEVER, NEVER, 0))


class _Row:
    """A turn, and how many further copies of it come right behind; these are duplicates in any case."""

    __slots__ = ("turn", "role", "text", "fault", "more", "initial", "gone", "added")

    def __init__(self, turn: int | None, role: str, text: str, fault: str | None, more: int = 0):
        self.turn, self.role, self.text, self.fault, self.more = turn, role, text, fault, more
        self.initial, self.gone, self.added = role[:1], fault in ("blank", "duplicate"), TRUNCATED if fault == "truncated" else 0


def costs_to_go(rows: list[_Row], after: tuple[int, int, int, int]) -> list[tuple[int, int, int, int]]:
    """The least cost from each state at each row on, and behind the last row, where it is ``after``."""
    out = [after]
    for row in reversed(rows):
        if row.more:
            after = tuple(c + DELETE * row.more for c in after)
        costs = [c + DELETE for c in after]
        if not row.gone:
            for state in range(4):
                best = REROLE + after[GROWN[state]]
                if (kept := KEPT.get((state, row.initial))) is not None:
                    best = min(best, after[kept])
                costs[state] = min(costs[state], best + row.added)
        after = settled(costs)
        out.append(after)
    out.reverse()
    return out


def walk(rows: list[_Row], costs: list[tuple[int, int, int, int]], state: int) -> Iterator[tuple[str, _Row | None, int]]:
    """(edit, its row, the state behind it) along the tight edits, the least letter first; a further copy has no row of its own."""
    for k, row in enumerate(rows):
        after = tuple(c + DELETE * row.more for c in costs[k + 1]) if row.more else costs[k + 1]
        while True:
            now, grown = costs[k][state], GROWN[state]
            kept = KEPT.get((state, row.initial))
            if DELETE + after[state] == now:
                yield "D", row, state
            elif INSERT + costs[k][grown] == now:
                state = grown
                yield "I", None, state
                continue
            elif kept is not None and row.added + after[kept] == now:
                state = kept
                yield "K", row, state
            else:
                state = grown
                yield "R", row, state
            break
        for _ in range(row.more):
            yield "D", None, state
    return state


def closing(state: int) -> Iterator[tuple[str, None, int]]:
    """Turns inserted behind the last row."""
    while END[state]:
        state = GROWN[state]
        yield "I", None, state


def whole_walk(rows: list[_Row]) -> Iterator[tuple[str, _Row | None, int]]:
    state = yield from walk(rows, costs_to_go(rows, END), START)
    yield from closing(state)


class _Edits:
    """Gathers edit rows and hands them on in batches of bounded size."""

    def __init__(self):
        self.rows, self.chars = [], 0

    def of(self, conv_id: int | None, steps, place: int = 0, state: int = START) -> Iterator[pa.RecordBatch]:
        """Batches as they fill; returns (place, state) where the next edit stands."""
        last = None
        for edit, row, state in steps:
            last = row or last
            if edit == "I":
                own = (conv_id, place, edit, None, None, None, NAMES[state], "")
            elif edit == "D":
                own = (conv_id, place, edit, last.turn, "duplicate" if row is None and last.fault != "blank" else last.fault, last.role, None, None)
            else:
                own = (conv_id, place, edit, row.turn, row.fault, row.role, row.role if edit == "K" else NAMES[state], row.text)
            place += 1
            yield from self.add(own)
        return place, state

    def add(self, own: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(own)
        self.chars += len(own[-1] or "")
        if len(self.rows) >= 8192 or self.chars >= BLOCK_CHARS:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.chars = self.rows, [], 0
        return _batch(rows, _EDITS_ARROW)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)


def _repair_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of conversations that are together and sorted, each held in memory."""
    out = _Edits()
    for conv_id, own in groupby(_tuples(batches), key=lambda r: r[0]):
        seen, rows = set(), []
        for _, turn, role, text, fault, present in own:
            if present:
                key = role, hashlib.sha256(text.encode()).digest()
                rows.append(_Row(turn, role, text, "duplicate" if key in seen and fault != "blank" else fault))
                seen.add(key)
        if not rows:
            yield from out.add((conv_id, 0, None, None, None, None, None, None))
            continue
        yield from out.of(conv_id, whole_walk(rows))
    if out.rows:
        yield out.batch()


def _with_fault(turns: DataFrame) -> DataFrame:
    """turns with what each shows by itself: blank, truncated or null."""
    bare = F.rtrim(F.col("text"), F.lit(SEPARATOR_CHARS))
    return turns.withColumn("fault", F.when(bare == "", "blank").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated"))


def _blocks(turns: DataFrame, block_rows: int) -> DataFrame:
    """Rows of large conversations as :class:`_Row` takes them, each with its block; blocks and rows are in order and lie in the shared folder."""
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    firsts = counted.groupBy("conv_id", "role", "h").agg(F.min(F.struct("turn")).alias("began"))
    c, f = counted.alias("c"), firsts.alias("f")
    same = F.col("c.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("c.role") == F.col("f.role")) & (F.col("c.h") == F.col("f.h"))
    rows = c.join(f, same).select("c.conv_id", "turn", "c.role", "text", "copies", F.col("turn").eqNullSafe(F.col("began.turn")).alias("first"))
    rows = _with_fault(rows).select("conv_id", "turn", "role", "text", "fault", "copies", "first")
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")

    def number(batches):
        block = n = chars = 0
        last = None
        for batch in batches:
            own = []
            for conv_id, text in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                size = len(text.as_py())
                if n and (conv_id != last or n >= block_rows or chars + size > BLOCK_CHARS):
                    block, n, chars = block + 1, 0, 0
                last, n, chars = conv_id, n + 1, chars + size
                own.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int64())], names=[*batch.schema.names, "block"])

    # a partition's number comes first, so that blocks are in order over all of them
    numbered = dealt.mapInArrow(number, f"{TURN}, block long").withColumn("block", F.shiftleft(F.spark_partition_id().cast("long"), 36) + F.col("block"))
    return checkpointed(numbered)


def _row_of(turn, role, text, fault, copies, first) -> _Row:
    return _Row(turn, role, text, fault if first or fault == "blank" else "duplicate", copies - 1)


def _costs_of_blocks(blocks: DataFrame) -> DataFrame:
    """conv_id, block and the costs to go behind it."""
    wide = ", ".join(f"c{k} long" for k in range(16))
    names = ["conv_id", "block", *[f"c{k}" for k in range(16)]]

    def tables(batches):
        out = []
        for (conv_id, block), own in groupby(_tuples(batches), key=lambda r: (r[0], r[7])):
            rows = [_row_of(*r[1:7]) for r in own]
            ends = [costs_to_go(rows, tuple(0 if k == end else NEVER for k in range(4)))[0] for end in range(4)]
            out.append((conv_id, block, *[min(NEVER, ends[end][state]) for state in range(4) for end in range(4)]))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out])
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, o, strict=True)) for o in out])

    def fold(own: pa.Table) -> pa.Table:
        own = own.sort_by("block")
        rows = list(zip(*(own.column(n).to_pylist() for n in names[1:]), strict=True))
        after, out = END, []
        for row in reversed(rows):
            out.append(after)
            after = tuple(min(row[1 + 4 * state + end] + after[end] for end in range(4)) for state in range(4))
        columns = zip(*reversed(out), strict=True)
        return pa.table([own.column("conv_id"), own.column("block"), *[pa.array(c, pa.int64()) for c in columns]], names=["conv_id", "block", "a0", "a1", "a2", "a3"])

    found = blocks.mapInArrow(tables, f"conv_id long, block long, {wide}")
    return found.groupBy("conv_id").applyInArrow(fold, "conv_id long, block long, a0 long, a1 long, a2 long, a3 long")


def _repair_in_blocks(turns: DataFrame, block_rows: int) -> DataFrame:
    blocks = _blocks(turns, block_rows)
    costs = _costs_of_blocks(blocks).select("block", "a0", "a1", "a2", "a3")

    def run(batches):
        out = _Edits()
        for conv_id, own in groupby(_tuples(batches), key=lambda r: r[0]):
            place, state = 0, START
            for _, part in groupby(own, key=lambda r: r[7]):
                rows, after = [], END
                for r in part:
                    rows.append(_row_of(*r[1:7]))
                    after = r[8:12]
                place, state = yield from out.of(conv_id, walk(rows, costs_to_go(rows, after), state), place, state)
            yield from out.of(conv_id, closing(state), place, state)
        if out.rows:
            yield out.batch()

    together = blocks.join(costs, "block").select(*blocks.columns, "a0", "a1", "a2", "a3")
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "block", "turn", "role", "text").mapInArrow(run, EDITS)


def edits(turns: DataFrame, large_turns: int = LARGE_TURNS, large_chars: int = LARGE_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each edit (K keep, R rerole, D delete, I insert), those of a conversation together and in order.

    turns is as :func:`turns_of` or :func:`damaged` leaves it. old_role, turn and fault (blank,
    duplicate, truncated) are the turn's own; role and text are what it becomes, null where deleted.
    """
    sizes = turns.groupBy("conv_id").agg(F.count_if("present").alias("n"), F.sum(F.length("text")).alias("chars"))
    large = checkpointed(sizes.filter((F.col("n") > large_turns) | (F.col("chars") > large_chars)).select(F.col("conv_id").alias("large_id")))
    rest, parts = turns, []
    if not large.isEmpty():
        own, same = small(large), F.col("conv_id").eqNullSafe(F.col("large_id"))
        rest = turns.join(own, same, "left_anti")
        parts = [_repair_in_blocks(turns.filter("present").join(own, same, "left_semi"), block_rows)]
    rows = _with_fault(rest).select("conv_id", "turn", "role", "text", "fault", "present")
    whole = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_repair_whole, EDITS)
    for part in parts:
        whole = whole.unionAll(part)
    return whole


def repaired(edited: DataFrame) -> DataFrame:
    """The turns of every repaired conversation: conv_id, place, role and text."""
    return edited.filter(F.col("edit") != "D").select("conv_id", "place", "role", "text")


def report(edited: DataFrame) -> DataFrame:
    """Counts, cost, audit string and digest of every conversation, from rows that lie as :func:`edits` leaves them."""

    def run(batches):
        out = []
        for conv_id, own in groupby(_tuples(batches), key=lambda r: r[0]):
            n = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
            low = high = initial = None
            distinct = illegal = cost = turns = 0
            audit, digest = [], hashlib.sha256()
            while some := list(islice(own, 4096)):
                audit.append("".join(r[2] or "" for r in some))
                for _, _, edit, turn, fault, old_role, role, text in some:
                    if edit in ("K", "R", "D"):
                        if fault is not None:
                            n[fault] += 1
                        if turn is not None and turn != high:
                            low, high, distinct = turn if low is None else low, turn, distinct + 1
                        if initial is not None and initial + old_role[:1] not in LEGAL:
                            illegal += 1
                        initial = old_role[:1]
                    cost += {None: 0, "K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                    if edit in ("K", "R", "I"):
                        digest.update(f"{chr(10) if turns else ''}{role}:{text}".encode())
                        turns += 1
            gaps = high - low + 1 - distinct if distinct else 0
            out.append((conv_id, gaps, *n.values(), illegal, cost, "".join(audit), digest.hexdigest()))
            if len(out) >= 1024:
                yield _batch(out, _REPORT_ARROW)
                out = []
        if out:
            yield _batch(out, _REPORT_ARROW)

    return edited.mapInArrow(run, REPORT)
