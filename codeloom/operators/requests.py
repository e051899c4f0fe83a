"""Requests as rows of a timeline and as a graph of occurrences.

Spans are rows: trace, span, parent, start, stop. Links name another span as the cause
of one: trace, span, ord, linked_trace, linked_span, relation. Parents form a function,
so circles are found by pointer doubling over all traces at once, and trees are walked
level by level; no trace is one group.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.materialize import Unsettled, cut, union

_SPAN = ["trace", "span"]
#: Fixed value: the least share of its trace that a row is drawn with.
LEAST_WIDTH = 0.002


def effective_parents(spans: DataFrame, links: DataFrame) -> DataFrame:
    """(trace, span, parent, relation): the parent that called, else the first linked span of the trace; null at the top.

    Only a span that names no parent takes a linked one (relation tells how). Of links that
    would close a circle the one of the last span (by start, then id) is left out; a circle
    of parents alone is opened at its first span, so that no span is lost.
    """
    known = spans.select("trace", F.col("span").alias("to"))
    called = spans.filter("parent IS NOT NULL AND parent <> span").select(*_SPAN, F.col("parent").alias("to")).join(known, ["trace", "to"], "left_semi").withColumn("relation", F.lit(None).cast("string"))
    free = spans.filter("parent IS NULL").select(*_SPAN)
    usable = links.filter("linked_trace = trace AND linked_span <> span").select(*_SPAN, "ord", F.col("linked_span").alias("to"), "relation").join(known, ["trace", "to"], "left_semi")
    first = usable.join(free, _SPAN, "left_semi").groupBy(*_SPAN).agg(F.min(F.struct("ord", "to", "relation")).alias("l"))
    linked = first.select(*_SPAN, F.col("l.to").alias("to"), F.coalesce("l.relation", F.lit("link")).alias("relation"))
    order = F.struct("start", "span")
    up = cut(called.unionByName(linked).join(spans.select(*_SPAN, order.alias("order")), _SPAN))
    longest = up.groupBy("trace").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    jump = up.select(*_SPAN, "to", F.when(F.col("relation").isNotNull(), F.col("order")).alias("late"), F.col("order").alias("early"))
    for _ in range(math.ceil(math.log2(longest + 1))):  # each round follows twice as many parents
        ahead = jump.select("trace", F.col("span").alias("to"), F.col("to").alias("next"), F.col("late").alias("l"), F.col("early").alias("e"))
        jump = cut(jump.join(ahead, ["trace", "to"]).select("trace", "span", F.col("next").alias("to"), F.greatest("late", "l").alias("late"), F.least("early", "e").alias("early")))
    round_ = jump.select("trace", F.col("to").alias("span")).distinct()  # so many steps on, every pointer left is on a circle
    opened = jump.join(round_, _SPAN, "left_semi").select(*_SPAN, F.coalesce("late", "early").alias("at"))
    gone = up.join(opened, _SPAN).filter(F.col("order") == F.col("at")).select(*_SPAN)
    left = up.join(gone, _SPAN, "left_anti").select(*_SPAN, F.col("to").alias("_to"), "relation")
    return spans.select(*_SPAN).join(left, _SPAN, "left").select(*_SPAN, F.col("_to").alias("parent"), "relation")


def timeline_rows(spans: DataFrame, links: DataFrame, bounds: DataFrame | None = None, max_depth: int = 10_000) -> DataFrame:
    """(trace, row, span, depth, parent, relation, offset, duration, at, width) of all spans, callers above what they called.

    Siblings stand by start and id. A trace reaches from its first start to its last stop,
    or what bounds (trace, start, stop) adds to these, and lasts 1 at least; at and width are
    shares of it, cut to six places, and width is LEAST_WIDTH or more.
    """
    parents = cut(effective_parents(spans, links))
    sibling = W.partitionBy("trace", "parent").orderBy("start", "span")
    placed = cut(parents.join(spans.select(*_SPAN, "start"), _SPAN).withColumn("place", F.lpad(F.row_number().over(sibling).cast("string"), 9, "0")).select(*_SPAN, "parent", "place"))
    levels = [cut(placed.filter("parent IS NULL").select(*_SPAN, F.lit(0).alias("depth"), F.col("place").alias("path")))]
    below = placed.filter("parent IS NOT NULL")
    for depth in range(1, max_depth + 1):
        above = levels[-1].select("trace", F.col("span").alias("parent"), F.col("path").alias("above"))
        level = cut(below.join(above, ["trace", "parent"]).select(*_SPAN, F.lit(depth).alias("depth"), F.concat_ws("/", "above", "place").alias("path")))
        if level.isEmpty():
            break
        levels.append(level)
    else:
        raise Unsettled(f"spans nested deeper than {max_depth}")
    ends = spans.select("trace", "start", "stop")
    ends = ends if bounds is None else ends.unionByName(bounds.select("trace", "start", "stop"))
    whole = ends.groupBy("trace").agg(F.min("start").alias("t0"), F.max("stop").alias("t1")).withColumn("t1", F.greatest("t1", F.col("t0") + 1))
    met = union(levels).join(parents, _SPAN).join(spans.select(*_SPAN, "start", "stop"), _SPAN).join(whole, "trace")
    start = F.least(F.greatest("start", "t0"), "t1")
    duration = F.greatest(F.least(F.greatest("stop", start), "t1") - start, F.lit(1))
    share = lambda x: F.floor(x * 1_000_000 / (F.col("t1") - F.col("t0"))) / 1_000_000.0
    row = F.row_number().over(W.partitionBy("trace").orderBy("path"))
    return met.select("trace", row.alias("row"), "span", "depth", "parent", "relation", (start - F.col("t0")).alias("offset"), duration.alias("duration"), share(start - F.col("t0")).alias("at"), F.greatest(share(duration), F.lit(LEAST_WIDTH)).alias("width"))


def _without_circles(causes: DataFrame, parents: DataFrame, max_rounds: int = 1_000) -> DataFrame:
    """causes (trace, ord, source, target) that close no circle with the call tree and those before them, all distinct in ord.

    One that stands above its own source closes a circle at once. Whether others do is
    asked among causes alone: one leads to another if its target is the other's source or
    above it. What nothing leads to, or what leads to nothing, is in no circle and is peeled
    off in rounds; only where some are left are these decided one after the other, for all traces at once.
    """
    above = _closure(parents)
    leads = causes.select("trace", F.col("ord").alias("a"), F.col("target").alias("anc")).join(above, ["trace", "anc"]).join(causes.select("trace", F.col("ord").alias("b"), F.col("source").alias("span")), ["trace", "span"])
    leads = cut(leads.select("trace", "a", "b").distinct())
    selfish = leads.filter("a = b").select("trace", F.col("a").alias("ord"))
    leads = cut(leads.join(selfish.select("trace", F.col("ord").alias("a")), ["trace", "a"], "left_anti").join(selfish.select("trace", F.col("ord").alias("b")), ["trace", "b"], "left_anti"))
    tight = leads
    for _ in range(max_rounds):
        inner = cut(tight.join(tight.select("trace", F.col("b").alias("a")).distinct(), ["trace", "a"], "left_semi").join(tight.select("trace", F.col("a").alias("b")).distinct(), ["trace", "b"], "left_semi"))
        if inner.count() == tight.count():
            break
        tight = inner
    else:
        raise Unsettled(f"causes not peeled within {max_rounds} rounds")
    open_ = cut(tight.select("trace", F.col("a").alias("ord")).union(tight.select("trace", F.col("b").alias("ord"))).distinct())
    fine = causes.join(selfish, ["trace", "ord"], "left_anti")
    kept = [cut(fine.select("trace", "ord").join(open_, ["trace", "ord"], "left_anti"))]
    for _ in range(max_rounds):
        if open_.isEmpty():
            return fine.join(union(kept), ["trace", "ord"], "left_semi")
        now = cut(open_.groupBy("trace").agg(F.min("ord").alias("ord")))
        so_far = union(kept).select("trace", F.col("ord").alias("b"))
        front = now.select("trace", F.col("ord").alias("a"))
        seen = [cut(front.withColumnRenamed("a", "b"))]
        while not seen[-1].isEmpty():
            step = seen[-1].withColumnRenamed("b", "a").join(leads, ["trace", "a"]).select("trace", "b").distinct()
            mine = step.join(now.select("trace", F.col("ord").alias("b")), ["trace", "b"], "left_semi").withColumn("back", F.lit(True))
            seen.append(cut(step.join(so_far, ["trace", "b"], "left_semi").join(union([s.select("trace", "b") for s in seen]), ["trace", "b"], "left_anti")))
            front = mine if "back" not in front.columns else front.unionByName(mine)
        bad = cut(front.select("trace").distinct()) if "back" in front.columns else now.select("trace").limit(0)
        kept.append(cut(now.join(bad, "trace", "left_anti")))
        open_ = cut(open_.join(now, ["trace", "ord"], "left_anti"))
    raise Unsettled(f"causes not decided within {max_rounds} rounds")


def _closure(parents: DataFrame, max_depth: int = 10_000) -> DataFrame:
    """(trace, span, anc), each span its own ancestor; circles of parents end where they close."""
    up = cut(parents.filter("parent IS NOT NULL").select("trace", F.col("span").alias("anc"), "parent"))
    found = [cut(parents.select(*_SPAN, F.col("span").alias("anc")))]
    for _ in range(max_depth):
        level = found[-1].join(up, ["trace", "anc"]).select(*_SPAN, F.col("parent").alias("anc"))
        level = cut(level.join(union(found), [*_SPAN, "anc"], "left_anti"))
        if level.isEmpty():
            return union(found)
        found.append(level)
    raise Unsettled(f"spans nested deeper than {max_depth}")


ENTRY, EXIT = "entry", "exit"


def request_graph(spans: DataFrame, events: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(trace, source, target, relation, label) between the moments of each request.

    A moment is a span's card (``span``) or one of its shown events (``span:event``); events:
    trace, span, event, at, label (of the way out of it) and, for a handoff, target_span and
    mode. roots (trace, span) are declared. A card leads to its events in the order of their
    time, to the spans it called and to those that name it as their cause; a handoff leads
    from its event. Siblings never lead to each other. A cause that would close a circle,
    with calls and the causes before it, is left out; calls beat causes, causes beat handoffs
    of the same ends. Entry leads to the declared root and to cards that nothing leads to, and what leads nowhere leads to exit.
    """
    here = cut(spans.select(*_SPAN, "parent").distinct())
    ids = here.select("trace", F.col("span").alias("id"))
    moment = F.concat_ws(":", "span", "event")
    shown = cut(events.join(here.select(*_SPAN), _SPAN, "left_semi").withColumn("id", moment))
    line = here.select(*_SPAN, F.col("span").alias("id"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("string").alias("label"))
    line = line.unionByName(shown.select(*_SPAN, "id", "at", "event", "label"))
    after = W.partitionBy(*_SPAN).orderBy(F.col("event").isNotNull(), "at", "event")
    local = line.withColumn("target", F.lead("id").over(after)).filter("target IS NOT NULL")
    local = local.select("trace", F.col("id").alias("source"), "target", F.lit("span-local-order").alias("relation"), "label")
    parents = here.filter("parent IS NOT NULL AND parent <> span").join(ids.withColumnRenamed("id", "parent"), ["trace", "parent"], "left_semi")
    calls = parents.select("trace", F.col("parent").alias("source"), F.col("span").alias("target"), F.lit("parent-child").alias("relation"), F.lit(None).cast("string").alias("label"))
    told = lambda rows, source, target, relation, label, rank, order: rows.select("trace", F.col("at_span").alias("of"), F.expr(source).alias("source"), F.expr(target).alias("target"), F.lit(relation).alias("relation"), label.alias("label"), F.lit(rank).alias("rank"), *order)
    wanted = links.filter("linked_trace = trace AND linked_span <> span").join(ids.select("trace", F.col("id").alias("linked_span")), ["trace", "linked_span"], "left_semi").join(here.select(*_SPAN), _SPAN, "left_semi").withColumn("at_span", F.col("linked_span"))
    wanted = told(wanted, "linked_span", "span", "span-link", F.concat("relation", F.lit(" link")), 0, [F.col("span").alias("o1"), F.col("linked_span").alias("o2"), F.col("relation").alias("o3")])
    handed = shown.filter("target_span IS NOT NULL").join(ids.select("trace", F.col("id").alias("target_span")), ["trace", "target_span"], "left_semi").withColumn("at_span", F.col("span"))
    handed = told(handed, "id", "target_span", "async-handoff", F.concat("mode", F.lit(" handoff")), 1, [F.col("span").alias("o1"), F.lpad(F.col("at").cast("string"), 20, "0").alias("o2"), F.col("event").alias("o3")])
    causes = wanted.unionByName(handed).join(calls.select("trace", "source", "target"), ["trace", "source", "target"], "left_anti")
    once = causes.withColumn("_n", F.row_number().over(W.partitionBy("trace", "source", "target").orderBy("rank", "o1", "o2", "o3"))).filter("_n = 1")
    ranked = cut(once.withColumn("ord", F.row_number().over(W.partitionBy("trace").orderBy("rank", "o1", "o2", "o3"))))
    ok = _without_circles(ranked.select("trace", "ord", F.col("of").alias("source"), "target"), here.select(*_SPAN).join(parents.select(*_SPAN, "parent"), _SPAN, "left")).select("trace", "ord")
    caused = ranked.join(ok, ["trace", "ord"], "left_semi").select("trace", "source", "target", "relation", "label")
    inner = cut(union([local, calls, caused]))
    none = F.lit(None).cast("string")
    declared = roots.join(here.select(*_SPAN), _SPAN, "left_semi").select("trace", F.col("span").alias("id"))
    loose = ids.join(inner.select("trace", F.col("target").alias("id")), ["trace", "id"], "left_anti")
    begin = declared.unionByName(loose).distinct().select("trace", F.lit(ENTRY).alias("source"), F.col("id").alias("target"), F.lit("trace-entry").alias("relation"), none.alias("label"))
    last = line.select("trace", "id", "label").join(inner.select("trace", F.col("source").alias("id")), ["trace", "id"], "left_anti")
    end = last.select("trace", F.col("id").alias("source"), F.lit(EXIT).alias("target"), F.lit("trace-exit").alias("relation"), "label")
    empty = roots.select("trace").distinct().join(here.select("trace"), "trace", "left_anti").select("trace", F.lit(ENTRY).alias("source"), F.lit(EXIT).alias("target"), F.lit("trace-exit").alias("relation"), none.alias("label"))
    return union([inner, begin, end, empty])
