"""Checks of a graph; each gives rows (code, subject) of what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.ids import edge_id
from codeloom.functions.materialize import cut, union


def _issues(df: DataFrame, code: str, subject: str = "id") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(subject).alias("subject"))


def duplicate_ids(nodes: DataFrame) -> DataFrame:
    """A row for each repetition of an id after its first."""
    extra = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    return _issues(extra.select("id", F.explode(F.sequence(F.lit(2), F.col("n")))), "DUPLICATE_NODE_ID")


def parents(nodes: DataFrame, max_doublings: int = 20) -> DataFrame:
    """Parents that aren't there, and every node whose chain of parents runs into a cycle.

    Chains are followed by pointer doubling: after k rounds a pointer skips 2^k parents,
    so whoever still has one after more rounds than the tree is deep is caught in a cycle.
    """
    known = nodes.select(F.col("id").alias("parent_id"))
    dangling = nodes.filter("parent_id IS NOT NULL").join(known, "parent_id", "left_anti")
    jump = cut(nodes.join(known, "parent_id", "left_semi").select("id", F.col("parent_id").alias("up")))
    for _ in range(max_doublings):
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("upper"))
        new = cut(jump.join(far, "up").select("id", F.col("upper").alias("up")))
        if new.isEmpty():
            jump = new
            break
        jump = new
    return _issues(dangling, "DANGLING_PARENT").unionByName(_issues(jump, "PARENT_CYCLE"))


def edge_rows(edges: DataFrame) -> DataFrame:
    """Ids that don't spell the edge, weights that don't count the sites, ranges that run backwards."""
    wrong_id = edges.filter(F.col("id") != edge_id(F.col("kind"), F.col("source"), F.col("target")))
    wrong_weight = edges.filter(F.col("weight").isNotNull() & F.col("n_sites").isNotNull() & (F.col("weight") != F.col("n_sites")))
    backwards = edges.filter((F.col("end_line") < F.col("line")) | ((F.col("end_line") == F.col("line")) & (F.col("end_col") < F.col("col"))))
    return _issues(wrong_id, "EDGE_ID_MISMATCH").unionByName(_issues(wrong_weight, "WEIGHT_MISMATCH")).unionByName(_issues(backwards, "CALL_SITE_RANGE"))


def endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources that are no nodes, and targets of resolved edges that are none."""
    known = lambda end: nodes.select(F.col("id").alias(end)).distinct()
    lost = edges.join(known("source"), "source", "left_anti").select(F.col("source").alias("subject"))
    resolved = edges.filter(F.coalesce("resolution", F.lit("resolved")) == "resolved")
    gone = resolved.join(known("target"), "target", "left_anti").select(F.col("target").alias("subject"))
    return _issues(lost, "DANGLING_EDGE_SOURCE", "subject").unionByName(_issues(gone, "DANGLING_EDGE_TARGET", "subject"))


def vocabulary(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Kinds outside a vocabulary, with how many rows have them."""
    return rows.filter(~F.col("kind").isin(kinds)).groupBy("kind").agg(F.count("*").alias("n"))


def traces(spans: DataFrame) -> DataFrame:
    """Spans (trace, span, start, end) that end before they start, or repeat an id in their trace."""
    reversed_ = _issues(spans.filter("`end` < start"), "SPAN_TIME", "span")
    again = spans.withColumn("_n", F.count("*").over(W.partitionBy("trace", "span"))).filter("_n > 1").select("span").distinct()
    return reversed_.unionByName(_issues(again, "DUPLICATE_SPAN", "span"))


#: Fixed value: how many events a trace may have.
MOST_EVENTS = 2_000


def trace_issues(traces: DataFrame, spans: DataFrame, events: DataFrame) -> DataFrame:
    """(code, subject) of what is wrong in request traces; the subject names the trace, with the span or event behind it.

    traces: trace, start, end, root, complete, dropped; spans: trace, span, parent, start,
    end; events: trace, span, event, at, iterations, emitted. Of spans with one id the
    smallest parent counts when circles are looked for.
    """
    told = lambda df, code, *cs: df.select(F.lit(code).alias("code"), F.concat_ws("/", *[F.col(c).cast("string") for c in cs]).alias("subject"))
    again = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys, F.explode(F.sequence(F.lit(2), F.col("n"))))
    bounds = traces.groupBy("trace").agg(F.min("start").alias("t0"), F.max("end").alias("t1"))
    known = spans.select("trace", "span").distinct()
    in_trace = spans.join(bounds, "trace")
    in_span = events.join(spans.groupBy("trace", "span").agg(F.min("start").alias("s0"), F.max("end").alias("s1")), ["trace", "span"])
    parted = spans.filter("parent IS NOT NULL").join(known.withColumnRenamed("span", "parent"), ["trace", "parent"], "left_anti")
    named = lambda c: F.concat_ws("/", F.col("trace").cast("string"), F.col(c).cast("string"))
    tree = spans.groupBy("trace", named("span").alias("id")).agg(F.min(F.when(F.col("parent").isNotNull(), named("parent"))).alias("parent_id"))
    most = tree.groupBy("trace").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # no chain is longer than its trace
    round_ = parents(tree.select("id", "parent_id"), max_doublings=most.bit_length() + 1).filter("code = 'PARENT_CYCLE'").select(F.col("subject").alias("id"))
    circles = tree.join(round_, "id", "left_semi").select("trace").distinct()
    return union([
        told(again(traces, "trace"), "DUPLICATE_TRACE", "trace"),
        told(traces.filter("start > `end`"), "TRACE_TIME", "trace"),
        told(traces.filter("complete AND dropped > 0"), "COMPLETE_WITH_DROPS", "trace"),
        told(traces.join(known.withColumnRenamed("span", "root"), ["trace", "root"], "left_anti"), "ROOT_MISSING", "trace"),
        told(again(spans, "trace", "span"), "DUPLICATE_SPAN", "trace", "span"),
        told(spans.filter("start > `end`"), "SPAN_TIME", "trace", "span"),
        told(in_trace.filter("start < t0 OR `end` > t1"), "SPAN_OUTSIDE_TRACE", "trace", "span"),
        told(parted, "PARENT_MISSING", "trace", "span"),
        told(circles, "PARENT_CYCLE", "trace"),
        told(again(events, "trace", "event"), "DUPLICATE_EVENT", "trace", "event"),
        told(in_span.filter("at < s0 OR at > s1"), "EVENT_OUTSIDE_SPAN", "trace", "event"),
        told(events.filter("emitted > iterations"), "LOOP_COUNT", "trace", "event"),
        told(events.groupBy("trace").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_EVENTS), "TOO_MANY_EVENTS", "trace"),
    ])


def malformed_ids(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """Trace ids that aren't 32 and span ids that aren't 16 lower-case hex digits, or are all zeros."""
    bad = lambda df, c, n, code: df.filter(~F.col(c).rlike(f"^[0-9a-f]{{{n}}}$") | F.col(c).rlike("^0+$")).select(F.lit(code).alias("code"), F.col(c).alias("subject"))
    return bad(traces, "trace", 32, "TRACE_ID").unionByName(bad(spans, "span", 16, "SPAN_ID"))


def is_relative_posix(path: Column) -> Column:
    """A path below its root: not empty, no leading slash, no backslash, no empty segment, . or .."""
    return (path != "") & ~path.contains("\\") & F.forall(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def whole_documents(rows: DataFrame, document: str, sound: Column) -> DataFrame:
    """Rows of documents of which every row is sound; one bad row rejects all of its document's."""
    bad = rows.filter(~F.coalesce(sound, F.lit(False))).select(document).distinct()
    return rows.join(bad, document, "left_anti")


def sound_coverage(counters: DataFrame) -> DataFrame:
    """Counters (document, file, kind, entry, arm, line, col, end_line, end_col, hits) of coverage maps that hold no fault.

    Paths are relative, counts no less than 0, spans don't run backwards, and an entry has each arm once.
    """
    forward = (F.col("end_line") > F.col("line")) | ((F.col("end_line") == F.col("line")) & (F.col("end_col") >= F.col("col")))
    own = whole_documents(counters, "document", is_relative_posix(F.col("file")) & (F.col("hits") >= 0) & forward)
    twice = own.groupBy("document", "file", "kind", "entry", "arm").agg(F.count("*").alias("n")).filter("n > 1").select("document").distinct()
    return own.join(twice, "document", "left_anti")


#: What a changed file can be, the shape of a digest, and the most entries of one document.
STATUSES = ("added", "modified", "deleted", "renamed")
DIGEST, MOST_PRINTS = "^[a-f0-9]{64}$", 100_000


def sound_changes(files: DataFrame) -> DataFrame:
    """Changed files (document, path, status, start, stop) of documents without a fault: known status, no empty path, ranges from 1 on that don't run backwards."""
    ranges = F.col("start").isNull() & F.col("stop").isNull() | (F.col("start") >= 1) & (F.col("stop") >= F.col("start"))
    return whole_documents(files, "document", (F.col("path") != "") & F.col("status").isin(*STATUSES) & F.coalesce(ranges, F.lit(False)))


def sound_fingerprints(prints: DataFrame) -> DataFrame:
    """Fingerprints (document, scope, key, address, digest) of documents without a fault: SHA-256 digests, an address once in a scope, and not too many."""
    own = whole_documents(prints, "document", (F.col("key") != "") & (F.col("address") != "") & F.col("digest").rlike(DIGEST))
    twice = own.groupBy("document", "scope", "address").agg(F.count("*").alias("n")).filter("n > 1").select("document")
    many = own.groupBy("document").agg(F.count("*").alias("n")).filter(F.col("n") > MOST_PRINTS).select("document")
    return own.join(twice.unionByName(many).distinct(), "document", "left_anti")
