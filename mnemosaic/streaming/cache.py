"""Outputs kept for a time, as state of a stream: a map of outputs for each session, whose entries go by timers of event time.

Needs the RocksDB state store: spark.sql.streaming.stateStore.providerClass is set by with_state().
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MINUTES = 60


def with_state(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def _ms(t) -> int:
    return int(t.value // 1_000_000) if isinstance(t, pd.Timestamp) else int(t.timestamp() * 1000)


def _us(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class _Kept(StatefulProcessor):
    """held: key -> (first_id, last time in microseconds). A key that is seen again within the time lives on.

    State is read and written once for each key of a micro-batch, not for each row, and a micro-batch sets one timer, for the time at which the
    last of its keys may go; all that may go by then go with it.
    """

    def __init__(self, keep_ms: int, session: str):
        self.keep_ms, self.session = keep_ms, session

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "key string", "first_id bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, known = [], {}
        for at, i, k in sorted(r for part in rows for r in zip(_us(part["ts"]), part["id"].tolist(), part["key"].tolist())):
            if k not in known:
                known[k] = self.held.getValue((k,)) if self.held.containsKey((k,)) else None
            first, last = known[k] or (i, at)
            cached = known[k] is not None and at - last <= 1000 * self.keep_ms
            known[k] = (int(first), max(at, int(last))) if cached else (i, at)
            out.append((key[0], i, k, known[k][0], cached))
        for k, v in known.items():
            self.held.updateValue((k,), v)
        self.handle.registerTimer(max(last for _, last in known.values()) // 1000 + self.keep_ms + 1)
        yield pd.DataFrame(out, columns=[self.session, "id", "key", "first_id", "cached"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for k in [k for k, v in self.held.iterator() if v[1] // 1000 + self.keep_ms < now]:
            self.held.removeKey(k)
        yield from ()

    def close(self) -> None:
        pass


def kept_outputs(outputs: DataFrame, minutes: int = MINUTES, late: str = "10 minutes", session: str = "session_id") -> DataFrame:
    """A stream outputs(session, id, ts, output) -> session, id, key, first_id, cached, as state.kept_outputs() has it for each session in batch.

    An output is cached if an equal one of its session came in the sixty minutes before it; first_id is the first of that run. Rows of a
    micro-batch are taken in order of time; a row that is late, but not beyond the watermark, is held against what came before it in
    the stream, and doesn't move the time at which its key goes back. Null outputs count as empty.
    """
    with_state(outputs.sparkSession)
    keyed = outputs.select(session, "id", "ts", F.substring(F.sha2(F.coalesce("output", F.lit("")), 256), 1, 16).alias("key"))
    kind = outputs.schema[session].dataType.simpleString()
    timed = keyed.withWatermark("ts", late).groupBy(session)
    return timed.transformWithStateInPandas(_Kept(minutes * 60_000, session), f"{session} {kind}, id bigint, key string, first_id bigint, cached boolean", "append", "eventTime")


class _Idle(StatefulProcessor):
    """The last time of a session; a timer that no later event has overtaken says that the session is idle."""

    def __init__(self, idle_ms: int, session: str):
        self.idle_ms, self.session = idle_ms, session

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, events bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = pd.concat(list(rows))["ts"]
        seen = self.last.get() if self.last.exists() else (None, 0)
        at = max([_ms(t) for t in times] + ([int(seen[0])] if seen[0] is not None else []))
        if seen[0] is not None and int(seen[0]) != at:
            self.handle.deleteTimer(int(seen[0]) + self.idle_ms)
        self.last.update((at, int(seen[1]) + len(times)))
        self.handle.registerTimer(at + self.idle_ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, events = self.last.get()
        self.last.clear()
        yield pd.DataFrame({self.session: [key[0]], "ts": [dt.datetime.fromtimestamp(int(at) / 1000, dt.UTC).replace(tzinfo=None)], "event_type": ["session.idle"], "events": [int(events)]})

    def close(self) -> None:
        pass


def idle_sessions(events: DataFrame, minutes: int = 30, late: str = "10 minutes", session: str = "session_id") -> DataFrame:
    """A stream events(session, ts) -> session, ts, event_type, events: a row for each session without events for so long, with its last time and number of events."""
    with_state(events.sparkSession)
    kind = events.schema[session].dataType.simpleString()
    timed = events.select(session, "ts").withWatermark("ts", late).groupBy(session)
    return timed.transformWithStateInPandas(_Idle(minutes * 60_000, session), f"{session} {kind}, ts timestamp, event_type string, events bigint", "append", "eventTime")
