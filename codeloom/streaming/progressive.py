"""A graph that arrives in slices: versioned state of merged slices, with a frontier and bounds that are errors.

Slices are rows: graph, generation, what (node, edge, file, root, ready or frontier), id,
payload (what the row says of the id), depth (how far a frontier is complete; loaded depth of
a root) and has_more. The merge is a streaming aggregation by (graph, generation, what,
id), combined before the shuffle, so any order and any split of micro-batches gives one
state, a slice that comes twice changes nothing, and an older generation never touches
the rows of a newer one. With a watermark the state of ids that no slice has named for that long is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["graph", "generation", "what", "id"]
#: The most nodes, edges and files that a merged graph may hold.
LIMITS = {"node": 250_000, "edge": 1_000_000, "file": 20_000}


def merged(slices: DataFrame, late: str | None = None) -> DataFrame:
    """(KEYS, low, high, depth, has_more, n) of slices, batch or stream (then for update mode).

    low and high are the least and the greatest payload; where they differ, slices of one
    generation contradict each other. Of frontiers the deepest counts, and at one depth
    the word that there is no more.
    """
    if late is not None:
        slices = slices.withWatermark("ts", late)
    reached = F.max(F.struct("depth", (~F.col("has_more")).alias("done")))
    out = slices.groupBy(*KEYS).agg(F.min("payload").alias("low"), F.max("payload").alias("high"), reached.alias("at"), F.count("*").alias("n"))
    return out.select(*KEYS, "low", "high", F.col("at.depth").alias("depth"), (~F.col("at.done")).alias("has_more"), "n")


def newest(rows: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """The rows of every graph's newest generation, payload in place of low and high.

    The job fails where slices of that generation contradict each other about an id, or
    where a graph holds more of a kind than limits says.
    """
    last = rows.groupBy("graph").agg(F.max("generation").alias("_last"))
    older = F.col("generation") < F.col("_last")  # in the test itself, so that it isn't made of older rows before the join
    own = rows.join(last, "graph").filter(F.assert_true(older | F.col("low").eqNullSafe(F.col("high")), "slices of one generation contradict each other").isNull())
    own = own.filter(~older).drop("_last")
    most = F.lit(None).cast("long")
    for what, limit in (LIMITS if limits is None else limits).items():
        most = F.when(F.col("what") == what, limit).otherwise(most)
    full = own.groupBy("graph", "what").agg(F.count("*").alias("_size")).filter(F.col("_size") > most).agg(F.count("*").alias("_over"))
    own = own.join(F.broadcast(full)).filter(F.assert_true(F.col("_over") == 0, "a merged graph is larger than its limit").isNull())
    return own.select(*KEYS, F.col("low").alias("payload"), "depth", "has_more")


def readiness(graph: DataFrame, requested_depth: int) -> DataFrame:
    """(graph, generation, nodes, edges, files, loaded_depth, open, ready) of the rows of :func:`newest`.

    open is how many frontiers are to be loaded further to reach the depth; a graph is
    ready once its roots are all loaded to that depth and named ready.
    """
    of = lambda what: F.count_if(F.col("what") == what)
    counts = graph.groupBy("graph", "generation").agg(
        of("node").alias("nodes"), of("edge").alias("edges"), of("file").alias("files"), F.max(F.when(F.col("what") == "root", F.col("depth"))).alias("loaded_depth"),
        F.count_if((F.col("what") == "frontier") & F.col("has_more") & (F.col("depth") < requested_depth)).alias("open"), of("root").alias("_roots"),
    )
    ready = graph.filter("what = 'ready'").select("graph", "generation", "id")
    missing = graph.filter("what = 'root'").select("graph", "generation", "id").join(ready, ["graph", "generation", "id"], "left_anti").groupBy("graph").agg(F.count("*").alias("_missing"))
    told = counts.join(missing, "graph", "left")
    is_ready = (F.col("_roots") > 0) & F.col("_missing").isNull() & F.coalesce(F.col("loaded_depth") >= requested_depth, F.lit(False))
    return told.select("graph", "generation", "nodes", "edges", "files", "loaded_depth", "open", is_ready.alias("ready"))
