"""Streams of session events: counters, suppression of repeats, pressure phases, deduplicated calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream; times without a zone are taken in the session's, as watermarks need one."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumns({c: F.col(c).cast("timestamp") for c, kind in raw.dtypes if kind == "timestamp_ntz"})


def session_counters(stream: DataFrame, session: str = "user_id", kind: str = "event_type", ts: str = "ts", late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Events by session, kind and day, closed when the watermark passes the day."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window), session, kind).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def without_repeats(stream: DataFrame, keys: list[str], ts: str = "ts", within: str = "20 seconds") -> DataFrame:
    """The first event of a key within a time of event time."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def pressure_phases(stream: DataFrame, window_tokens: float, session: str = "user_id", tokens: str = "value", idle_ms: int = 3_600_000) -> DataFrame:
    """(session, phase, used): a row each time a session enters a higher phase.

    The state of a session goes once the watermark is idle_ms past its last event; it then starts anew.
    """
    steps = ((0.95, "critical"), (0.85, "aggressive"), (0.7, "warn"))
    rank = {"normal": 0, "warn": 1, "aggressive": 2, "critical": 3}

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used, phase = state.get if state.exists else (0.0, "normal")
        out = []
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        for t in rows[tokens]:
            used += float(t)
            now = next((name for least, name in steps if round(used, 9) / window_tokens >= least), "normal")
            if rank[now] > rank[phase]:
                phase = now
                out.append((key[0], phase, used / window_tokens))
        state.update((used, phase))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=["session", "phase", "used"])

    timed = stream.withWatermark("ts", "1 hour").groupBy(session)
    return timed.applyInPandasWithState(step, "session long, phase string, used double", "used double, phase string", "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything there is, to Parquet, once."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
