"""Structured Streaming forms of the stateful behaviour: sessions, daily limits, sliding rates, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the event files in a folder; ts becomes an event time."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def held(events: DataFrame, late: str | None) -> DataFrame:
    """A stream with its watermark: rows later than ``late`` behind the newest are dropped, and the stream's progress counts
    them (numRowsDroppedByWatermark). There is no default, since the right bound is the source's. A table stays as it is."""
    if not events.isStreaming:
        return events
    if late is None:
        raise ValueError("a stream needs a bound for late rows")
    return events.withWatermark("ts", late)


def dropped_rows(query: StreamingQuery) -> int:
    """How many late rows the stream's kept progress says were dropped."""
    return sum(int(state["numRowsDroppedByWatermark"]) for p in query.recentProgress for state in p["stateOperators"])


def sessions(events: DataFrame, gap: str = "24 hours", late: str | None = None) -> DataFrame:
    """user_id, start, end, n_events of each run of events with no pause longer than ``gap``."""
    grouped = held(events, late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n_events"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n_events")


def daily_counts(events: DataFrame, key: str, limit: int, late: str | None = None) -> DataFrame:
    """key, day, n and whether the limit is passed."""
    grouped = held(events, late).groupBy(key, F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("window.start").alias("day"), "n", (F.col("n") > limit).alias("over"))


def sliding_rates(events: DataFrame, key: str, width: str = "5 minutes", slide: str = "1 minute", late: str | None = None) -> DataFrame:
    """n, error rate and quantiles of value in sliding windows of each key."""
    grouped = held(events, late).groupBy(key, F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.percentile_approx("value", [0.5, 0.95, 0.99]).alias("q"))
    return grouped.select(key, F.col("window.start").alias("start"), "n", (F.col("errors") / F.col("n")).alias("error_rate"), F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def alerts(rates: DataFrame, error_rate: float = 0.05, p95: float = 5.0) -> DataFrame:
    return rates.where((F.col("error_rate") > error_rate) | (F.col("p95") > p95))


def upsert_stream(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, late: str, key: str = "event_id") -> StreamingQuery:
    """Give each batch, without repeated keys, to ``merge``; ends when all that is there was read, and resumes from its checkpoint.

    Events more than ``late`` behind the newest are dropped (``dropped_rows`` counts them): keys are remembered that long.
    """
    once = held(stream, late).dropDuplicatesWithinWatermark([key])
    return once.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# States in which an upload can be stuck, minutes without a change, and tries.
STUCK_STATES, STUCK_MINUTES, MOST_RETRIES = ("assembling", "processing"), 10, 3


def stuck_uploads(sessions: DataFrame, as_of: str | None, minutes: int = STUCK_MINUTES, most: int = MOST_RETRIES) -> DataFrame:
    """``sessions`` (session_id, status, updated_at, retry_count) that are stuck, with action: recover, or failed after ``most`` retries.

    ``as_of`` None: at startup, when every session that runs is stuck.
    """
    stuck = sessions.where(F.col("status").isin(*STUCK_STATES))
    if as_of is not None:
        stuck = stuck.where(F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes)))
    return stuck.withColumn("action", F.when(F.col("retry_count") >= most, "failed").otherwise("recover"))


def recoveries(changes: DataFrame, minutes: int = STUCK_MINUTES, most: int = MOST_RETRIES, late: str = "1 minute") -> DataFrame:
    """session_id, retries and action each time that a session of the stream ``changes`` (session_id, status, ts) gets stuck.

    A session's state is its status, its time and its retries. When the watermark passes ``minutes`` after the last
    change of one that runs, it is to be recovered and has as long again, or has failed after ``most`` retries.
    Changes that are older than the state change nothing; an ended session is forgotten.
    """
    span = minutes * 60_000

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        moved, retries = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            failed = retries >= most
            yield pd.DataFrame({"session_id": [key[0]], "retries": [retries], "action": ["failed" if failed else "recover"]})
            if failed:
                state.remove()
                return
            moved, retries, runs = moved + span, retries + 1, True
        else:
            last = None
            for batch in batches:
                for ts, status in zip(batch["ts"], batch["status"]):
                    at = int(ts.timestamp() * 1000)
                    if at >= moved and (last is None or at >= last[0]):
                        last = at, status
            if last is not None:
                moved = last[0]
            runs = last[1] in STUCK_STATES if last is not None else state.exists
        if runs:
            state.update((moved, retries))
            state.setTimeoutTimestamp(max(moved + span, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    timed = changes.select("session_id", "status", "ts").withWatermark("ts", late)
    return timed.groupBy("session_id").applyInPandasWithState(follow, "session_id string, retries int, action string", "moved bigint, retries int", "append", GroupStateTimeout.EventTimeTimeout)
