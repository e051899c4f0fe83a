"""Exact top-k inner-product search: a KD-tree per shard, searched best first.

Vectors are dealt to shards by median splits learnt from a bounded sample, so a shard
covers a part of the space; a part that holds more rows than a shard should, such as a
vector that is often repeated, is spread over several shards by row. Of each shard the
bounding box, the mean and the radius around it are a row of a small table, which says
what a query can find there at most. A first round sends each query to the few shards
whose means promise most; the k-th score found is its floor. A second round sends it to
the shards that may still reach that floor, and to no other. In a round a shard's rows
are shuffled once, to a task that builds the tree and lets the queries stream through
it; only where very many queries come to one shard do several tasks hold its rows.
Neither vectors nor queries are ever broadcast.

The sample (about ``SAMPLE`` rows, by a hash) and the number of shards (``MAX_SHARDS`` at
most, larger beyond) move cost only: every row is in one shard, whatever was sampled.

Defined results: vectors that are null or hold a null or non-finite component, and rows
without an id, take no part; components that a shorter vector lacks count as 0; rows
with the query's id are never its candidates; ties go to the smaller id; fewer
candidates than k give fewer rows; repeated rows each take a place as candidates, and a
repeated query asks once; differing vectors of one query id share its k places; an
empty table gives no rows. Scores that leave 64 bits are cut at that range. Columns
beyond id and embedding are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

LEAF = 64
SHARD_ROWS, MAX_SHARDS, SAMPLE = 4096, 4096, 8192
#: Shards that a query asks in the first round, and queries of one shard that one task takes.
FIRST_SHARDS, TASK_QUERIES = 3, 262_144
#: Stands for no floor; also the edge of the range of scores.
LIMIT = 2**63 - 1


class KdTree:
    """Median splits on the widest axis, with a tight box around the rows of every node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(rows))
        self.low, self.high, self.children, self.span = [], [], [], []
        self._split(rows, order, 0, len(rows))
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _split(self, rows, order, a, b) -> int:
        at, own = len(self.span), rows[order[a:b]]
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.children.append(None)
        if b - a > LEAF and (high > low).any():
            axis, mid = int(np.argmax(high - low)), (b - a) // 2
            order[a:b] = order[a:b][np.argsort(own[:, axis], kind="stable")]
            self.children[at] = (self._split(rows, order, a, a + mid), self._split(rows, order, a + mid, b))
        return at

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, a score that no row in the node's box exceeds."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query_id: int, query: np.ndarray, bound: np.ndarray, k: int, floor):
        """The k best (score, id) that reach floor; a box that can only tie is still opened, for smaller ids."""
        best: list = []  # a heap of (score, -id), the worst first
        todo = [(-bound[0], 0)]
        while todo:
            b, node = heapq.heappop(todo)
            if -b < floor:
                break
            if self.children[node]:
                for c in self.children[node]:
                    if bound[c] >= floor:
                        heapq.heappush(todo, (-bound[c], c))
                continue
            lo, hi = self.span[node]
            scores = self.rows[lo:hi] @ query
            for i in np.flatnonzero(scores >= floor):
                if (own := int(self.ids[lo + i])) != query_id:
                    one = (int(scores[i]), -own)
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
                    if len(best) == k:
                        floor = max(floor, best[0][0])
        return [(s, -i) for s, i in best]


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of a column of lists, shorter ones filled up with 0."""
    flat, sizes = pc.list_flatten(vectors), pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat.to_numpy(zero_copy_only=False)
    return out


def _splits(sample: np.ndarray, parts: int) -> list[tuple[int, float, int, int]]:
    """Median splits of the widest axis into so many parts: (axis, value, left, right); a negative place is part -place - 1."""
    out, ended = [], 0

    def split(rows: np.ndarray, n: int) -> int:
        nonlocal ended
        spread = np.ptp(rows, axis=0) if n > 1 and len(rows) > 1 and rows.shape[1] else np.zeros(1)
        if not spread.any():
            ended += 1
            return -ended
        axis, at = int(np.argmax(spread)), len(out)
        value = np.quantile(rows[:, axis], (n // 2) / n, method="lower")
        left = rows[:, axis] <= value
        if left.all():
            left = rows[:, axis] < value
            value = rows[left, axis].max()
        out.append(())
        out[at] = (axis, value, split(rows[left], n // 2), split(rows[~left], n - n // 2))
        return at

    split(sample, parts)
    return out


def _parts(rows: np.ndarray, splits: list) -> np.ndarray:
    part = np.zeros(len(rows), dtype=np.int64)
    todo = [(0, np.arange(len(rows)))] if splits else []
    while todo:
        at, own = todo.pop()
        axis, value, left, right = splits[at]
        low = rows[own, axis] <= value
        for to, some in ((left, own[low]), (right, own[~low])):
            if to < 0:
                part[some] = -to - 1
            elif len(some):
                todo.append((to, some))
    return part


def _reach(rows: np.ndarray, queries: np.ndarray) -> float:
    """A bound on the size of all scores."""
    return float(np.abs(rows.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0)) * max(rows.shape[1], 1)


_HITS = "query_id long, q long, vec_id long, score long"


class _Shard:
    """The rows of one shard, and the tree over them once the first query comes."""

    def __init__(self, width: int):
        self.width, self.parts, self.rows, self.trees = width, [], None, {}

    def hits(self, asked: pa.RecordBatch, k: int) -> pa.RecordBatch:
        if self.rows is None:
            pool = pa.Table.from_batches(self.parts)
            self.rows, self.ids, self.parts = _matrix(pool.column("v"), self.width), pool.column("vec_id").to_numpy(), []
        queries, found = _matrix(asked.column("v"), self.width), []
        kind = np.float64 if _reach(self.rows, queries) < 2**52 else object  # floats are exact up to there
        if kind not in self.trees:
            self.trees[kind] = KdTree(self.ids, self.rows.astype(kind))
        tree, queries = self.trees[kind], queries.astype(kind)
        bounds = tree.bounds(queries)
        for i, (query_id, q, floor) in enumerate(zip(*(asked.column(c).to_pylist() for c in ("vec_id", "q", "floor")), strict=True)):
            floor = -np.inf if floor <= -LIMIT else floor
            found += [(query_id, q, v, max(-LIMIT, min(LIMIT, s))) for s, v in tree.search(query_id, queries[i], bounds[i], k, floor)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "q", "vec_id", "score"])


def _searched(both: DataFrame, k: int, width: int) -> DataFrame:
    """Hits of both: rows of shards (role 0) and the queries that come to them (role 1), met by shard and salt."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in ("shard", "salt", "role")], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])) if len(at) else []
            for a, b in zip(starts, [*starts[1:], len(at)], strict=True):
                if tuple(at[a, :2]) != key:
                    key, own = tuple(at[a, :2]), _Shard(width)
                part = batch.slice(a, b - a)
                if at[a, 2] == 0:
                    own.parts.append(part)
                elif own.parts or own.rows is not None:
                    for k0 in range(0, part.num_rows, 2048):
                        yield own.hits(part.slice(k0, 2048), k)

    return both.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "role").mapInArrow(run, _HITS)


def quantised(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias(embedding))
    return rows.filter(F.col("vec_id").isNotNull() & F.col(embedding).isNotNull() & ~bad).select(
        "vec_id", F.transform(embedding, lambda x: F.floor(x * F.lit(float(scale)))).alias("v")
    )


def _shards(rows: DataFrame, n: int, width: int, shard_rows: int) -> DataFrame:
    """rows (rid, vec_id, v, asked) with the shard of each."""
    wanted = min(MAX_SHARDS, -(-n // shard_rows))
    shard_rows = max(shard_rows, -(-n // MAX_SHARDS))
    sample = rows.filter(F.pmod(F.xxhash64("rid"), F.lit(max(1, n // SAMPLE))) == 0).select("v").toArrow() if wanted > 1 else None
    splits = _splits(_matrix(sample.column("v"), width), wanted) if sample is not None and sample.num_rows else []

    def place(batches):
        for batch in batches:
            part = pa.array(_parts(_matrix(batch.column("v"), width), splits), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, part], names=[*batch.schema.names, "part"])

    placed = checkpointed(rows.mapInArrow(place, "rid long, vec_id long, v array<long>, asked boolean, part long"))
    sizes = placed.groupBy("part").agg(F.ceil(F.count("*") / F.lit(shard_rows)).alias("pieces"))  # MAX_SHARDS rows at most
    piece = F.pmod(F.xxhash64("rid", F.lit(1)), F.col("pieces"))
    return placed.join(F.broadcast(sizes), "part").select("rid", "vec_id", "v", "asked", (F.col("part") * 2**32 + piece).alias("shard"))


class _Table:
    """What is known of every shard: box, mean and radius; some numbers for each of 2 * MAX_SHARDS shards at most."""

    def __init__(self, placed: DataFrame, width: int):
        told = self._boxes(placed, width).toArrow()
        self.shards, sizes = told.column("shard").to_numpy(), told.column("n").to_numpy()
        self.low, self.high = (_matrix(told.column(c), width).astype(float) for c in ("low", "high"))
        self.mean = _floats(told.column("total"), width) / np.maximum(sizes, 1)[:, None]
        shards, mean = self.shards, self.mean

        def far(batches):
            for batch in batches:
                own = np.searchsorted(shards, batch.column("shard").to_numpy())
                away = np.sqrt(((_matrix(batch.column("v"), width) - mean[own]) ** 2).sum(axis=1)) if width else np.zeros(len(own))
                most = np.zeros(len(shards))
                np.maximum.at(most, own, away)
                met = np.unique(own)
                yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(most[met])], names=["at", "far"])

        radii = placed.select("shard", "v").mapInArrow(far, "at long, far double").groupBy("at").agg(F.max("far").alias("far")).orderBy("at").toArrow()
        self.radius = radii.column("far").to_numpy()

    @staticmethod
    def _boxes(placed: DataFrame, width: int) -> DataFrame:
        def of_batch(batches):
            for batch in batches:
                rows, shard = _matrix(batch.column("v"), width), batch.column("shard").to_numpy()
                order = np.argsort(shard, kind="stable")
                at = np.flatnonzero(np.diff(shard[order], prepend=shard[order[0]] - 1)) if len(order) else np.array([], dtype=np.int64)
                low, high, total = (f.reduceat(rows[order].astype(kind), at, axis=0).tolist() if len(at) else [] for f, kind in ((np.minimum, np.int64), (np.maximum, np.int64), (np.add, np.float64)))
                n = np.diff(np.append(at, len(order))) if len(at) else []
                kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
                columns = (shard[order][at] if len(at) else [], n, low, high, total)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "n", "low", "high", "total"])

        parts = placed.select("shard", "v").mapInArrow(of_batch, "shard long, n long, low array<long>, high array<long>, total array<double>")
        sides = parts.select("shard", "n", F.posexplode_outer(F.arrays_zip("low", "high", "total")).alias("axis", "x"))
        boxes = sides.groupBy("shard", "axis").agg(F.sum("n").alias("n"), F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.sum("x.total").alias("total"))
        in_order = boxes.groupBy("shard").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("axis", "low", "high", "total"))).alias("s"))
        return in_order.select("shard", "n", *[F.filter(F.col(f"s.{c}"), lambda x: x.isNotNull()).alias(c) for c in ("low", "high", "total")]).orderBy("shard")

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and shard, a score that no row of the shard exceeds: that of the box or of the ball, whichever is lower."""
        box = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        ball = queries @ self.mean.T + np.sqrt((queries**2).sum(axis=1))[:, None] * self.radius
        slack = 1e-9 * max(_reach(self.low, queries), _reach(self.high, queries))  # bounds of large numbers are rounded
        return np.minimum(box, ball) + slack


def _floats(vectors, width: int) -> np.ndarray:
    return np.array([x + [0.0] * (width - len(x)) for x in vectors.to_pylist()], dtype=float).reshape(len(vectors), width)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, shard_rows: int = SHARD_ROWS, told: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score over quantised vectors; ``is_query`` marks the rows to ask for.

    Into told, where given, go the numbers of shards, of queries, and of (query, shard) pairs asked in each round.
    """
    rows = checkpointed(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asked")))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width")).first()
    width = size["width"]
    placed = checkpointed(_shards(rows, size["n"], width, shard_rows))
    asked = checkpointed(placed.filter("asked").groupBy("vec_id", "v").agg(F.min("rid").alias("q")).withColumn("floor", F.lit(-LIMIT).cast("long")))
    table = _Table(placed, width)
    n_first = min(FIRST_SHARDS, len(table.shards))

    def promising(queries: np.ndarray) -> np.ndarray:
        """Which shards a query asks first: those whose means score highest."""
        score, out = queries @ table.mean.T, np.zeros((len(queries), len(table.shards)), dtype=bool)
        if n_first:
            np.put_along_axis(out, np.argpartition(-score, n_first - 1, axis=1)[:, :n_first], True, axis=1)
        return out

    def sent(later: bool):
        """Queries, once for each shard that they go to in a round."""

        def run(batches):
            for batch in batches:
                queries, floor = _matrix(batch.column("v"), width).astype(float), batch.column("floor").to_numpy()
                for at in range(0, batch.num_rows, 256):
                    part = queries[at : at + 256]
                    goes = promising(part)
                    if later:
                        goes = ~goes & (table.bounds(part) >= floor[at : at + 256, None])
                    q, s = np.nonzero(goes)
                    yield pa.RecordBatch.from_arrays([pa.array(table.shards[s], pa.int64()), *batch.take(pa.array(at + q)).columns], names=["shard", *batch.schema.names])

        return run

    def search(queries: DataFrame, later: bool) -> DataFrame:
        pairs = checkpointed(queries.select("q", "vec_id", "v", "floor").mapInArrow(sent(later), "shard long, q long, vec_id long, v array<long>, floor long"))
        salts = checkpointed(pairs.groupBy("shard").agg(F.count("*").alias("n"), F.ceil(F.count("*") / F.lit(TASK_QUERIES)).alias("salts")))  # a row a shard
        if told is not None:
            told["later" if later else "first"] = salts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        none = F.lit(0).cast("long")
        pool = placed.join(F.broadcast(salts), "shard").withColumn("salt", F.explode(F.sequence(none, F.col("salts") - 1)))
        pool = pool.select("shard", "salt", F.lit(0).alias("role"), "vec_id", "v", none.alias("q"), none.alias("floor"))
        come = pairs.join(F.broadcast(salts), "shard").withColumn("salt", F.pmod(F.xxhash64("q"), F.col("salts")))
        return _searched(pool.unionByName(come.select("shard", "salt", F.lit(1).alias("role"), "vec_id", "v", "q", "floor")), k, width)

    if told is not None:
        told |= {"shards": len(table.shards), "queries": asked.count(), "rows": size["n"]}
    order = W.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    first = checkpointed(search(asked, False))
    best = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    reached = best.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("reached"))
    floored = asked.join(reached, "q", "left").select("q", "vec_id", "v", F.coalesce("reached", "floor").alias("floor"))
    every = first.unionByName(search(floored, True)) if n_first < len(table.shards) else first
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
