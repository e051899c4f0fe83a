"""SimHash near-duplicates: fingerprints linked by a self-join of binary tries.

Fingerprints of shingle hashes are made distinct first, so exact copies cost one row. The
64 bits are cut into blocks, more of them the more fingerprints there are. Two
fingerprints within four differing bits agree in all blocks but four at least, so for
each choice of so many blocks a trie holds the fingerprints with these blocks in front,
and a pair within the budget shares the whole front in one of them: the self-join of a
trie begins at its pairs (front, front).

A pair of trie nodes is a unit of work. Where a front holds more fingerprints than a task
should take, its pairs of nodes are split before anything is shuffled: by four bits at a
time, with the counts of the nodes only, dropping pairs of nodes whose paths differ in
more bits than the budget has. Where a split would not lower the number of fingerprints to
shuffle, as in a crowd around one fingerprint, the nodes are cut into pieces instead, and
pairs of pieces are units of work. Fingerprints go to the pairs that are left. In a task all
pairs are traversed together, one bit after the other, again adding up differing bits and
dropping pairs beyond the budget, until a handful of fingerprints is left on each side.
Links leave a task as stars around one member of every local set, never as all pairs, and
the stars are joined into components by alternating large-star and small-star steps.

Defined results: a null or empty text has the fingerprint zero and is linked like any
other; a text with fewer words than a shingle has its whole word sequence as the only
shingle; repeated rows are copies of each other; rows with a null doc_id get the
component of their text but are never its id (null where no member has an id); an empty
table gives an empty table. Columns beyond doc_id and text are left alone. Components
that don't settle within the bound of their rounds are an error.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.materialize import union

from . import shingle_sets
from .common import checkpointed, fresh, gathered, in_parts, let, small, text_of, words

BITS, MAX_DIFFERENT, SHINGLE = 64, 4, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fingerprints that share a front by chance, on average: blocks are chosen so that there are no more.
FRONT_ROWS = 64
#: Fingerprints of a trie node beyond which its pairs are split before the shuffle, and rows that are dealt to one task.
NODE_ROWS, TASK_ROWS = 4096, 8192
#: A pair of nodes with at most so many pairs of fingerprints is compared outright.
LEAF_PAIRS = 16
#: Rows of one fingerprint beyond which they aren't shuffled to it, as long as such fingerprints are few.
HOT_COPIES = 256
#: Bits by which nodes are split before the shuffle.
STEP = 4


def shingle_hashes(text: Column, n: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every n-word shingle of the text with A-Z in lower case."""

    def of(w: Column) -> Column:
        count = F.size(w)
        full = F.transform(F.sequence(F.lit(0), count - n), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)])))
        short = F.array(F.xxhash64(F.concat_ws(" ", w)))
        return F.when(count >= n, full).when(count > 0, short).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.translate(text, UPPER, LOWER)), of)


def _majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number, as a signed long, whose bits are set in over half of the hashes."""
    raw = hashes.astype(">i8").view(np.uint8).reshape(-1, 8)
    ones = sum(np.unpackbits(raw[a : a + 65536], axis=1).sum(axis=0, dtype=np.int64) for a in range(0, len(raw), 65536))
    return int(np.packbits(2 * ones > len(raw)).view(">i8")[0]) if len(raw) else 0


def _fingerprint_batches(batches):
    for batch in batches:
        lists = batch.column(1)
        values, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        fps = np.array([_majority_bits(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(documents: DataFrame, text: str = "text") -> DataFrame:
    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), shingle_hashes(text_of(text)).alias("hashes"))
    return hashed.mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def tries(fingerprints: int, budget: int = MAX_DIFFERENT) -> list[tuple[list[tuple[int, int]], int]]:
    """For each trie: its blocks (bits to the right, width) in the order of its bits, and the width of its front.

    One block more than the budget, or as many as keep the fingerprints of a front few.
    """
    for n in range(budget + 1, BITS + 1):
        edges = [BITS * k // n for k in range(n + 1)]
        blocks = [(BITS - b, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        width = BITS * (n - budget) // n
        if n == 2 * budget or fingerprints <= FRONT_ROWS << width:
            break
    out = []
    for front in combinations(blocks, n - budget):
        out.append(([*front, *[b for b in blocks if b not in front]], sum(w for _, w in front)))
    return out


def _rotated(fp: Column, blocks: list[tuple[int, int]]) -> Column:
    """The bits of fp with the blocks in this order, from the left."""
    out, place = F.lit(0).cast("long"), BITS
    for low, width in blocks:
        place -= width
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1)) if width < BITS else fp
        out = out.bitwiseOR(F.shiftleft(part, place))
    return out


def _first_bits(bits: Column, depth: Column) -> Column:
    return F.call_function("shiftrightunsigned", bits, (F.lit(BITS) - depth).cast("int"))


def close_pairs(bits: np.ndarray, ranges: np.ndarray, same: np.ndarray, budget: int, leaf: int = LEAF_PAIRS):
    """Places (i, j) whose bits differ in at most ``budget`` places, and how many pairs of nodes were visited.

    A row (a, b, c, d) of ranges is a pair of trie nodes, bits[a:b] and bits[c:d], each
    sorted; where same is set both are one node. All pairs go down together, bit by bit.
    """
    a, b, c, d = ranges.T
    different, visited, left = np.zeros(len(a), dtype=np.int64), 0, []
    for bit in range(BITS - 1, -2, -1):
        open_ = (b > a) & (d > c) & (different <= budget) & ~(same & (b - a < 2))
        a, b, c, d, different, same = (x[open_] for x in (a, b, c, d, different, same))
        visited += len(a)
        few = ((b - a) * (d - c) <= leaf) | (bit < 0)
        left.append([x[few] for x in (a, b, c, d, same)])
        a, b, c, d, different, same = (x[~few] for x in (a, b, c, d, different, same))
        if not len(a):
            break
        zeros = np.concatenate([[0], np.cumsum((bits >> np.uint64(bit)) & np.uint64(1) == 0)])
        m, n, two = a + zeros[b] - zeros[a], c + zeros[d] - zeros[c], ~same
        a, b, c, d = (
            np.concatenate([a, m, a, m[two]]),
            np.concatenate([m, b, m, b[two]]),
            np.concatenate([c, n, n, c[two]]),
            np.concatenate([n, d, d, n[two]]),
        )
        different = np.concatenate([different, different, different + 1, different[two] + 1])
        same = np.concatenate([same, same, np.zeros(len(same) + two.sum(), dtype=bool)])
    a, b, c, d, same = (np.concatenate(x) for x in zip(*left, strict=True))
    found = [np.zeros((2, 0), dtype=np.int64)]
    cuts = np.flatnonzero(np.diff(np.cumsum((b - a) * (d - c)) // 1_000_000, prepend=0))
    for at in np.split(np.arange(len(a)), cuts):  # about a million comparisons at a time
        width = d[at] - c[at]
        size = (b[at] - a[at]) * width
        own = np.repeat(np.arange(len(at)), size)
        k = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
        i, j = a[at][own] + k // width[own], c[at][own] + k % width[own]
        near = (np.bitwise_count(bits[i] ^ bits[j]) <= budget) & ~(same[at][own] & (i >= j))
        found.append(np.stack([i[near], j[near]]))
    i, j = np.concatenate(found, axis=1)
    return i, j, visited


def local_sets(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places the smallest one that links (i, j) lead to."""
    low = np.arange(n)
    while len(i):
        x, y = low[i], low[j]
        apart = x != y
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low != low[low]).any():
            low = low[low]
    return low


_NODE = ("nil", "id", "fp")


def _stars(pdf: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Links of one task's pairs of nodes: every member of a local set to one of it."""
    bits = pdf["bits"].to_numpy().view(np.uint64)
    side = pdf["side"].to_numpy()
    keys = pdf[["trie", "depth", "u", "v", "pu", "pv"]].to_numpy()
    order = np.lexsort((bits, side, *keys.T))
    pdf, bits, side, keys = pdf.iloc[order], bits[order], side[order], keys[order]
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    end = np.append(start[1:], len(keys))
    same = (keys[start, 2] == keys[start, 3]) & (keys[start, 4] == keys[start, 5])
    ones = np.concatenate([[0], np.cumsum(side)])
    middle = np.where(same, start, end - (ones[end] - ones[start]))
    i, j, _ = close_pairs(bits, np.stack([start, np.where(same, end, middle), middle, end], axis=1), same, budget)
    low = local_sets(len(bits), i, j)
    moved = np.flatnonzero(low != np.arange(len(bits)))
    own, other = pdf.iloc[moved], pdf.iloc[low[moved]]
    return pd.DataFrame({f"{end}_{c}": part[c].to_numpy() for end, part in (("a", own), ("b", other)) for c in _NODE})


def node_pairs(placed: DataFrame, nodes: DataFrame, budget: int, node_rows: int = NODE_ROWS) -> tuple[DataFrame, int]:
    """Rows of placed for each pair of trie nodes, or of their pieces, that they are needed in, and how many these are.

    They have trie, depth, u, v, pu, pv (the pieces), size (rows of the pair), side and the
    row. placed: trie, width, bits and a fingerprint's node; nodes: trie, depth, path and
    n, the fronts with two rows or more. A node of more than node_rows is dealt in pieces.
    """
    path_at = lambda depth: _first_bits(F.col("bits"), depth)
    pieces = lambda n: F.ceil(F.col(n) / F.lit(node_rows))
    one = F.col("u") == F.col("v")
    dealt_rows = F.when(one, F.col("n") * pieces("n")).otherwise(F.col("n") * pieces("m") + F.col("m") * pieces("n"))
    total, done = 0, []

    def deal(rows: DataFrame, pairs: DataFrame) -> None:
        """Adds the rows (trie, path, bits) that the pairs need."""
        nonlocal total
        total += pairs.agg(F.coalesce(F.sum(dealt_rows), F.lit(0))).first()[0]
        sizes = pairs.select("trie", F.explode(F.array(F.struct(F.col("u").alias("path"), "n"), F.struct(F.col("v").alias("path"), F.col("m").alias("n")))).alias("x")).select("trie", "x.*").distinct()
        own = rows.select("trie", "path", "bits", *_NODE).join(sizes, ["trie", "path"]).withColumn("piece", F.pmod(F.xxhash64("bits"), pieces("n"))).drop("n")
        none = F.lit(0).cast("long")
        of = lambda n: F.explode(F.sequence(none, pieces(n) - 1))
        cut = pairs.withColumn("pu", of("n")).withColumn("pv", of("m")).filter(~one | (F.col("pu") <= F.col("pv")))
        size = (F.col("n") / pieces("n") + F.when(one & (F.col("pu") == F.col("pv")), 0).otherwise(F.col("m") / pieces("m"))).cast("long")
        cut = cut.select("trie", "depth", "u", "v", "pu", "pv", size.alias("size"))
        for side, (path, piece), some in ((0, ("u", "pu"), cut), (1, ("v", "pv"), cut.filter("u <> v OR pu <> pv"))):
            met = own.join(some.withColumn("path", F.col(path)).withColumn("piece", F.col(piece)), ["trie", "path", "piece"])
            done.append(met.select("trie", "depth", "u", "v", "pu", "pv", "size", F.lit(side).alias("side"), "bits", *_NODE))

    pairs = nodes.select("trie", "depth", F.col("path").alias("u"), F.col("path").alias("v"), F.lit(0).alias("different"), "n", F.col("n").alias("m"))
    rows = placed.withColumn("path", path_at(F.col("width")))
    deal(rows, pairs.filter(F.col("n") <= node_rows))
    pairs = checkpointed(pairs.filter(F.col("n") > node_rows))
    while not pairs.isEmpty():  # ends at the depth of 64 bits at the latest, where a node is one fingerprint
        ends = pairs.select("trie", "depth", F.explode(F.array_distinct(F.array("u", "v"))).alias("path")).distinct()
        down = F.least(F.col("depth") + STEP, F.lit(BITS))
        rows = checkpointed(rows.select("trie", "bits", *_NODE, "path").join(ends, ["trie", "path"]).withColumn("depth", down).withColumn("below", path_at(F.col("depth"))))
        counts = checkpointed(rows.groupBy("trie", "depth", "path", "below").agg(F.count("*").alias("n")))
        left = counts.select("trie", F.col("depth").alias("down"), F.col("path").alias("u"), F.col("below").alias("to_u"), F.col("n").alias("to_n"))
        right = counts.select("trie", F.col("path").alias("v"), F.col("below").alias("to_v"), F.col("n").alias("to_m"))
        split = pairs.select("trie", "u", "v", "different").join(left, ["trie", "u"]).join(right, ["trie", "v"])
        added = F.bit_count(F.col("to_u").bitwiseXOR(F.col("to_v"))) - F.bit_count(F.col("u").bitwiseXOR(F.col("v")))
        split = split.filter(~one | (F.col("to_u") <= F.col("to_v"))).withColumn("different", F.col("different") + added)
        split = split.filter((F.col("different") <= budget) & ((F.col("to_u") != F.col("to_v")) | (F.col("to_n") > 1)))
        split = checkpointed(split.select("trie", F.col("u").alias("from_u"), F.col("v").alias("from_v"), F.col("down").alias("depth"), F.col("to_u").alias("u"), F.col("to_v").alias("v"), "different", F.col("to_n").alias("n"), F.col("to_m").alias("m")))
        cost = split.groupBy("trie", "from_u", "from_v").agg(F.sum(dealt_rows).alias("cost"))
        stay = pairs.join(cost.select("trie", F.col("from_u").alias("u"), F.col("from_v").alias("v"), "cost"), ["trie", "u", "v"]).filter(F.col("cost") > dealt_rows)
        stay = checkpointed(stay.drop("cost"))
        deal(rows, stay)
        go = split.join(stay.select("trie", F.col("u").alias("from_u"), F.col("v").alias("from_v")), ["trie", "from_u", "from_v"], "left_anti").drop("from_u", "from_v")
        few = F.greatest("n", "m") <= node_rows
        rows = rows.drop("path", "depth").withColumnRenamed("below", "path")
        deal(rows, go.filter(few))
        pairs = checkpointed(go.filter(~few))
    return union(done), total


def links(distinct: DataFrame, budget: int = MAX_DIFFERENT, node_rows: int = NODE_ROWS) -> DataFrame:
    """Links (a, b) that connect all fingerprints within the budget; distinct has nil, id and fp, one row for each fp."""
    schema = ", ".join(f"{end}_{c} {kind}" for end in "ab" for c, kind in zip(_NODE, ("boolean", "long", "long"), strict=True))
    found = work(distinct, budget, node_rows).groupBy("task").applyInPandas(lambda pdf: _stars(pdf.drop(columns=["task", "size"], errors="ignore"), budget), schema)
    node = lambda end: F.struct(*[F.col(f"{end}_{c}").alias(c) for c in _NODE]).alias(end)
    return found.select(node("a"), node("b")).distinct()


def work(distinct: DataFrame, budget: int = MAX_DIFFERENT, node_rows: int = NODE_ROWS) -> DataFrame:
    """The rows of :func:`node_pairs` with their task: small pairs share one of about TASK_ROWS, a larger pair is one by itself."""
    count = distinct.count()
    plan = tries(count, budget)
    each = [F.struct(F.lit(t).alias("trie"), F.lit(width).alias("width"), _rotated(F.col("fp"), blocks).alias("bits")) for t, (blocks, width) in enumerate(plan)]
    placed = distinct.select(*_NODE, F.explode(F.array(*each)).alias("p")).select("p.*", *_NODE)
    fronts = placed.groupBy("trie", F.col("width").alias("depth"), _first_bits(F.col("bits"), F.col("width")).alias("path")).agg(F.count("*").alias("n"))
    dealt, total = node_pairs(placed, checkpointed(fronts.filter("n > 1")), budget, node_rows)
    own = F.xxhash64("trie", "depth", "u", "v", "pu", "pv")
    return dealt.withColumn("task", F.when(F.col("size") * 4 > TASK_ROWS, own).otherwise(F.pmod(own, F.lit(max(1, total // TASK_ROWS)))))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), of any ordered type: large-star and small-star steps until nothing changes."""
    edges = gathered(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    state, rows = None, edges.count()  # no step makes more edges

    def few(df: DataFrame) -> DataFrame:
        return in_parts(df, rows)

    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = few(both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = few(large.filter("a <> b").distinct())
        down = few(large.groupBy("a").agg(F.min("b").alias("m")))
        small = few(large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))).unionByName(down.select("a", F.col("m").alias("b")))
        edges = checkpointed(few(small.filter("a <> b").distinct()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
    raise RuntimeError(f"components have not settled within {max_rounds} rounds")


def near_duplicates(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of documents.

    Nodes are ordered by their smallest doc_id, so the smallest node of a component names it.
    """
    rows = checkpointed(fingerprints(documents, text))
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    distinct = checkpointed(least.select(F.col("least").isNull().alias("nil"), F.coalesce("least", F.lit(0)).alias("id"), "fp", "copies"))
    roots = components(links(distinct)).select(F.col("node.fp").alias("fp"), F.when(~F.col("root.nil"), F.col("root.id")).alias("lowest"), F.lit(True).alias("linked"))
    own = F.when(F.col("linked"), F.col("lowest")).when(~F.col("nil"), F.col("id"))
    members = checkpointed(distinct.join(roots, "fp", "left").select("fp", own.alias("component_id"), "copies"))
    often = small(members.filter(F.col("copies") > HOT_COPIES))  # one of so many rows at most
    named = rows.join(often, "fp").unionByName(rows.join(often, "fp", "left_anti").join(members, "fp"))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_texts(prints: DataFrame, budget: int = MAX_DIFFERENT) -> DataFrame:
    """Pairs (a, b), a < b, of texts that fingerprints link: prints has id and fp.

    A text is paired with one of its fingerprint, and this one with one of the local set
    that its fingerprint is linked to.
    """
    least = gathered(prints.groupBy("fp").agg(F.min("id").alias("id")))
    alike = prints.join(least.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
    linked = links(least.select(F.lit(False).alias("nil"), "id", "fp"), budget).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    pairs = alike.unionByName(linked).filter("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with one row of each component of near copies: the one with the smallest doc_id, null last, then by its other columns.

    Near copies here are texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8 or more. Fingerprints of these shingles are linked as in :func:`near_duplicates`,
    and the links whose sets are that similar stay. Such texts may differ in more bits than
    tries can hold, so :mod:`.shingle_sets` finds the pairs that these links leave apart. Texts
    that share a doc_id and are no near copies all stay; rows of one text without a
    doc_id are copies like any other. Rows with neither an id nor a word pass.
    """
    key, own, doc = fresh("_key", documents), fresh("_own", documents), F.col("doc_id")
    keyed = documents.withColumn(key, shingle_sets.text_key(text))
    blank = doc.isNull() & (F.col(key) == F.xxhash64(F.lit("")))
    texts = keyed.select(F.col(key).alias("id"), text_of(text).alias("text"))
    roots = shingle_sets.groups(texts, shingle_hashes(F.col("text"), shingle_sets.WORDS), _majority_bits, near_texts, components)
    nodes = checkpointed(roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct())

    tables = keyed.filter(~blank).select(doc.alias("doc"), F.col(key).alias("node"))
    least = tables.join(small(nodes), "node").groupBy("root", "node").agg(F.min("doc").alias("doc"))
    first = F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "node")).alias("first")
    kept = least.groupBy("root").agg(first).select(F.col("first.node").alias("node"))
    gone = checkpointed(nodes.select("node").join(kept, "node", "left_anti").select(F.col("node").alias(key)))
    copied = tables.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node").alias(key))
    copied = checkpointed(copied.join(gone, key, "left_anti"))

    stay = keyed.join(small(gone), key, "left_anti")
    alone = stay.join(small(copied), key, "left_anti").unionByName(stay.filter(blank).join(small(copied), key, "left_semi"))
    rows = F.struct(doc.isNull().alias("last"), doc.alias("doc"), F.struct(*documents.columns).alias("row"))
    one = stay.filter(~blank).join(small(copied), key, "left_semi").groupBy(key).agg(F.min(rows).alias(own)).select(f"{own}.row.*")
    return alone.select(*documents.columns).unionByName(one)
