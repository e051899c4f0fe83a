"""Streams, drained over the files of the events table (group H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.sources.bindings import ctes
from codeloom.streaming import events as E
from codeloom.streaming import progressive
from codeloom.streaming.sinks import drained

from .registry import ORACLES, QUERIES


def stream(sql: str, *views: str):
    """Register f(spark, sf_dir) with its SQL over the named views."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"{ctes(*views)} {sql}"
        return f

    return register


@stream("""SELECT user_id, epoch_us(min(ts)) AS start_us, count(*)::BIGINT AS spans, count_if(event_type = 'error')::BIGINT AS errors FROM spans GROUP BY user_id, trace""", "spans")
def stream_sessions(spark, sf_dir):
    rows = drained(E.sessions(E.source(spark, sf_dir)), "complete")
    return rows.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "spans", "errors")


@stream("""SELECT epoch_us(date_trunc('day', ts)) AS start_us, event_type AS node, count(*)::BIGINT AS calls, min(value) AS low, max(value) AS high FROM events GROUP BY 1, 2""")
def stream_overlay_tumbling(spark, sf_dir):
    rows = drained(E.overlay(E.source(spark, sf_dir)), "update", ["window", "node"])
    return rows.select(F.unix_micros("window.start").alias("start_us"), "node", "calls", "low", "high")


@stream("""SELECT user_id, count(*)::BIGINT AS seen, list_reduce(list_prepend('idle', list(event_type ORDER BY ts, event_id)), lambda s, e:
CASE WHEN e = 'signup' THEN 'running' WHEN s = 'running' AND e = 'view' THEN 'active' WHEN s IN ('running', 'active') AND e = 'error' THEN 'failed'
     WHEN s = 'active' AND e = 'purchase' THEN 'succeeded' ELSE s END) AS state FROM events GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    return drained(E.progress(E.source(spark, sf_dir)), "update", ["user_id"])


@stream("""SELECT user_id, event_id, previous, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) x WHERE previous <> event_type""")
def stream_watch_changes(spark, sf_dir):
    return drained(E.watched_changes(E.source(spark, sf_dir)), "append")


#: Events as slices: of each user's graph, a generation every ten days. Both engines run it.
_SLICES = """SELECT user_id % 20 AS graph, CAST(floor({day} / 10) AS BIGINT) AS generation,
  CASE event_type WHEN 'click' THEN 'node' WHEN 'view' THEN 'edge' WHEN 'purchase' THEN 'frontier' WHEN 'signup' THEN 'root' ELSE 'ready' END AS what,
  event_id % 37 AS id, concat('of ', user_id % 20, '/', event_id % 37) AS payload, CAST(event_id % 5 AS INT) AS depth, event_id % 3 <> 0 AS has_more FROM {events}"""
_MERGED = f"""WITH s AS ({_SLICES.format(day="date_diff('day', DATE '1970-01-01', ts::DATE)", events="events")}), own AS (SELECT * FROM s QUALIFY generation = max(generation) OVER (PARTITION BY graph)),
deep AS (SELECT *, max(depth) OVER (PARTITION BY graph, what, id) AS d FROM own),
m AS (SELECT graph, generation, what, id, payload, d AS depth, bool_and(has_more) FILTER (WHERE depth = d) AS has_more FROM deep GROUP BY ALL)"""


def _progressive(spark, sf_dir):
    events = E.source(spark, sf_dir, files_per_trigger=1)
    slices = spark.sql(_SLICES.format(day="unix_date(CAST(ts AS DATE))", events="{events}"), events=events)
    return progressive.newest(drained(progressive.merged(slices), "update", progressive.KEYS))


@stream(f"{_MERGED} SELECT * FROM m")
def stream_progressive_graph(spark, sf_dir):
    """What each graph holds in its newest generation after all slices."""
    return _progressive(spark, sf_dir)


@stream(f"""{_MERGED} SELECT graph, generation, count_if(what = 'node')::BIGINT AS nodes, count_if(what = 'edge')::BIGINT AS edges, 0::BIGINT AS files, max(depth) FILTER (WHERE what = 'root') AS loaded_depth,
count_if(what = 'frontier' AND has_more AND depth < 3)::BIGINT AS open, count_if(what = 'root') > 0 AND coalesce(max(depth) FILTER (WHERE what = 'root') >= 3, false)
AND count_if(what = 'root' AND (graph, id) NOT IN (SELECT (graph, id) FROM m WHERE what = 'ready')) = 0 AS ready FROM m GROUP BY graph, generation""")
def stream_graph_readiness(spark, sf_dir):
    """How much each graph holds, what is still to be loaded, and whether it may be shown."""
    return progressive.readiness(_progressive(spark, sf_dir), 3)
