"""Packing of token sequences by the sum-of-squares rule.

Documents are encoded whole, closed with an end id, and cut only where they are longer
than a sequence. A shard of pieces is packed longest first: each piece goes to the open
bin with room after which the sum over residual gaps of the squared number of open bins
with that gap is smallest, on a tie to the tightest; a new bin is opened only where none has room. Rows are dealt
to shards by their place in their partition, so shards are of even size whatever the documents are, as long as
partitions hold more rows than there are shards; a shard loses one or two unfilled sequences at most against
packing everything at once.

Only lengths are shuffled: ids stay where they were encoded and are joined to their
places by :func:`sequences` when the packed text itself is wanted.

Defined results: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; a null doc_id is packed like any other; an empty table gives an
empty table; columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed_in_batches, fresh, text_of
from .tokens import default_path, word_tokens

CAPACITY, END_ID = 4096, 1
SHARD_PIECES = 8192


def pieces(documents: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if kept, the ids of every piece."""
    path = path or default_path()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids]

    def encode(batches):
        encoder = word_tokens(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):  # ids of few documents at a time
                part, rows = batch.slice(at, 512), []
                for doc_id, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encoder(own), np.uint32(end_id)).astype("<u4")
                    for k, start in enumerate(range(0, len(ids), capacity)):
                        cut = ids[start : start + capacity]
                        rows.append((doc_id, k, start, len(cut), zlib.crc32(cut.tobytes()), *([cut.astype(np.int32)] if keep_ids else [])))
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=False)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("text")).mapInArrow(encode, schema)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of each length (1 to capacity)."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; a full one is no longer open
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        grown = 2 * count + 1  # what one more bin of a gap adds to the sum of squares
        grown[0] = 0
        change = np.where(count[size:capacity] > 0, grown[: capacity - size] - (2 * count[size:capacity] - 1), np.iinfo(np.int64).max)
        best = int(change.argmin()) if size < capacity else 0
        if size < capacity and change[best] < np.iinfo(np.int64).max:
            gap = size + best
            own = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, own, used = capacity, used, used + 1
        bins[i], offsets[i] = own, capacity - gap
        if gap > size:
            open_bins[gap - size].append(own)
            count[gap - size] += 1
    return bins, offsets


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """parts, which have a column length, with sequence_id and offset."""
    parts = checkpointed_in_batches(parts)
    shards = max(1, -(-parts.count() // shard_pieces))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields) + ", sequence_id long, offset long"
    shard = fresh("shard", parts)

    def place(own: pa.Table) -> pa.Table:
        own = own.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(own.column("length").to_numpy(), capacity)
        first = own.column(shard).to_numpy() * 2**32
        return own.drop_columns([shard]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    dealt = parts.withColumn(shard, F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
    return dealt.groupBy(shard).applyInArrow(place, schema)


def pack_documents(documents: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: its document, its span of ids, its digest and its place."""
    return pack(pieces(documents, text, path, capacity, keep_ids=False), capacity)


def sequences(documents: DataFrame, placed: DataFrame, text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and its ids, at most ``capacity`` of them; doc_id must be unique and not null."""
    coded = pieces(documents, text, path, capacity).select("doc_id", "piece", "ids")
    parts = placed.join(coded, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
