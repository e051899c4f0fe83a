"""Streams of events: sessions, tumbling overlays, a progress reducer and field watchers.

Every function takes a streaming DataFrame and returns one, so the caller picks source,
sink and trigger. In append mode the state of windows and sessions is bounded by the
watermark; complete mode, which the registered session query takes to tell sessions that
are still open, keeps all of them. The reducers keep one small record for each key, and
hold a key's rows of one micro-batch at a time: ``files_per_trigger`` bounds these.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What an event does to a review in a state; anything else leaves it as it is.
STEPS = {
    ("running", "view"): "active", ("running", "error"): "failed", ("active", "error"): "failed", ("active", "purchase"): "succeeded",
}
RESET, FIRST = "signup", "running"


def source(spark, sf_dir: str, table: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """The files of a table as a stream; the path is a pattern, as a plain one would have to be a folder."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{table}.parque[t]")


def sessions(events: DataFrame, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Sessions of each user: a gap without events ends one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.session_window("ts", gap)
    return timed.groupBy(window, "user_id").agg(F.count("*").alias("spans"), F.count_if(F.col("event_type") == "error").alias("errors"))


def overlay(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Calls, errors and the summed value of each event type in tumbling windows."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), F.col("event_type").alias("node")).agg(F.count("*").alias("calls"), F.min("value").alias("low"), F.max("value").alias("high"))


def _in_time(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of a micro-batch in the order of their time."""
    return pd.concat(list(parts)).sort_values(["ts", "event_id"], kind="stable")


def _reduce(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, seen = state.get if state.exists else ("idle", 0)
    for kind in _in_time(parts)["event_type"]:
        now = FIRST if kind == RESET else STEPS.get((now, kind), now)
        seen += 1
    state.update((now, seen))
    yield pd.DataFrame({"user_id": [key[0]], "state": [now], "seen": [seen]})


def progress(events: DataFrame) -> DataFrame:
    """The state of each review after a micro-batch; success and failure stay until a reset."""
    rows = events.select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(_reduce, "user_id long, state string, seen long", "state string, seen long", "update", GroupStateTimeout.NoTimeout)


def _changes(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = _in_time(parts)
    before = rows["event_type"].shift()
    if len(rows):
        before.iloc[0] = state.get[0] if state.exists else None
        state.update((rows["event_type"].iloc[-1],))
    out = pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "previous": before, "event_type": rows["event_type"]})
    yield out[before.notna() & (before != rows["event_type"])]


def watched_changes(events: DataFrame) -> DataFrame:
    """Events whose type differs from their user's event before."""
    rows = events.select("user_id", "ts", "event_id", "event_type")
    schema = "user_id long, event_id long, previous string, event_type string"
    return rows.groupBy("user_id").applyInPandasWithState(_changes, schema, "last string", "append", GroupStateTimeout.NoTimeout)
