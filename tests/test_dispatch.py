"""The output cache and the event dispatch as streams, over replays and restarts."""

import datetime as dt
import random

import pytest
from mnemosaic.sources.shared import Scratch
from mnemosaic.streaming import cache, dispatch

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "session_id long, id long, ts timestamp, output string"


def plain_cache(rows, minutes=60):
    """A walk of each session in order of time."""
    held, out = {}, {}
    for s, i, ts, o in sorted(rows, key=lambda r: (r[2], r[1])):
        known = held.get((s, o or ""))
        cached = known is not None and ts - known[1] <= dt.timedelta(minutes=minutes)
        first = known[0] if cached else i
        held[s, o or ""] = (first, ts)
        out[i] = (s, first, cached)
    return out


def files(spark, tmp_path, batches, schema):
    for n, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_cache_equals_a_plain_walk_and_shrinks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.randrange(3), i, T0 + dt.timedelta(minutes=3 * i + rng.randrange(3)), rng.choice(["a", "b", None, "", "c" * 500])) for i in range(120)]
    rows += [(9, 1000, T0 + dt.timedelta(days=2), "last"), (9, 1001, T0 + dt.timedelta(days=3), "last")]
    batches = [rows[i : i + 30] for i in range(0, 120, 30)] + [[rows[120]], [rows[121]]]
    stream = files(spark, tmp_path, batches, SCHEMA)
    q = cache.kept_outputs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.id: (r.session_id, r.first_id, r.cached) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_cache(rows)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in (x if isinstance(x, dict) else x.__dict__ for x in [__import__("json").loads(p.json) for p in q.recentProgress]) if p["stateOperators"]]
    assert kept[-1] < max(kept) / 2


EVENTS = "session_id long, id long, ts timestamp, event_type string, file string"


def some_events(rng, n):
    kinds = ["session.created", "message.updated", "message.part.updated", "file.edited", "session.idle", "session.deleted"]
    return [(rng.randrange(6), i % 40, T0 + dt.timedelta(seconds=i), rng.choices(kinds, [3, 9, 5, 6, 2, 1])[0], rng.choice([None, "a.py", "b.py"])) for i in range(n)]


def plain_tables(rows):
    sessions, messages, touched = {}, {}, {}
    for s, i, ts, kind, file in rows:
        closing = kind in ("session.idle", "session.deleted")
        sessions[s] = (kind if closing else "session.active", kind)
        if kind.startswith("message"):
            messages[i] = (s, kind)
        if kind == "file.edited" and file:
            touched[s, file] = i
    return sessions, messages, touched


def current(d):
    return (
        {r.session: (r.state, r.last_event) for r in d.table("sessions").collect()},
        {r.id: (r.session, r.event_type) for r in d.table("messages").collect()},
        {(r.session, r.file) for r in d.table("files").collect()},
    )


def test_batches_count_once_and_restarts_go_on(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for r in some_events(rng, 300) if r[3] != "session.deleted"]
    root = f"{Scratch(spark, 'd').root}/x"
    d = dispatch.Dispatcher(spark, root, dispatch.standard_handlers())
    stream = files(spark, tmp_path, [rows[i : i + 75] for i in range(0, 150, 75)], EVENTS)
    d.start(stream, str(tmp_path / "c")).awaitTermination()
    before = current(d)
    sessions, messages, touched = plain_tables(rows[:150])
    assert before == (sessions, messages, set(touched))
    batch = spark.createDataFrame(rows[:75], EVENTS)
    d(batch, 0)
    d(batch, 1)  # replayed numbers
    assert current(d) == before
    stream = files(spark, tmp_path, [rows[150:220], rows[220:]], EVENTS)
    dispatch.Dispatcher(spark, root, dispatch.standard_handlers()).start(stream, str(tmp_path / "c")).awaitTermination()
    sessions, messages, touched = plain_tables(rows)
    assert current(d) == (sessions, messages, set(touched))
    d.compact()
    d(batch, 3)
    assert current(d) == (sessions, messages, set(touched)) and len(d.segments.state()["live"]) == 1


def test_a_batch_that_failed_half_way_is_written_anew(spark):
    root = f"{Scratch(spark, 'd').root}/x"
    broken = [True]

    def files_or_fail(batch):
        if broken[0]:
            raise RuntimeError("lost")
        return dispatch.standard_handlers()[2].make(batch)

    handlers = [*dispatch.standard_handlers()[:2], dispatch.Handler("files", ["session", "file"], ["ts"], files_or_fail, ("file.edited",))]
    d = dispatch.Dispatcher(spark, root, handlers)
    batch = spark.createDataFrame([(1, 1, T0, "file.edited", "a"), (2, 2, T0, "session.deleted", None)], EVENTS)
    with pytest.raises(RuntimeError):
        d(batch, 0)
    assert d.segments.state()["live"] == []
    broken[0] = False
    d(batch, 0)
    assert current(d) == ({1: ("session.active", "file.edited")}, {}, {(1, "a")})


def test_idle_sessions_are_told_once(spark, tmp_path):
    rows = [(1, T0), (1, T0 + dt.timedelta(minutes=20)), (2, T0 + dt.timedelta(minutes=5)), (1, T0 + dt.timedelta(minutes=45)), (3, T0 + dt.timedelta(hours=5)), (3, T0 + dt.timedelta(hours=5, minutes=1))]
    stream = files(spark, tmp_path, [rows[:3], rows[3:4], rows[4:5], rows[5:]], "session_id long, ts timestamp")
    q = cache.idle_sessions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.session_id, r.ts, r.event_type, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, T0 + dt.timedelta(minutes=45), "session.idle", 3), (2, T0 + dt.timedelta(minutes=5), "session.idle", 1)]


class _Held:
    """State of one session in memory, which counts what is asked of it."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, [], 0

    def getMapState(self, *_):
        return self

    def containsKey(self, k):
        self.calls += 1
        return k in self.rows

    def getValue(self, k):
        self.calls += 1
        return self.rows[k]

    def updateValue(self, k, v):
        self.calls += 1
        self.rows[k] = v

    def removeKey(self, k):
        del self.rows[k]

    def iterator(self):
        return iter(list(self.rows.items()))

    def registerTimer(self, at):
        self.timers.append(at)


def test_kept_outputs_ask_for_state_once_a_key():
    import pandas as pd

    held = _Held()
    p = cache._Kept(3_600_000, "session_id")
    p.init(held)
    start = pd.Timestamp("2024-01-01")
    # the last row comes an hour and half a millisecond after the one before it
    times = [start + pd.Timedelta(seconds=i) for i in range(1000)] + [start + pd.Timedelta(seconds=999 + 3600, microseconds=500)]
    rows = pd.DataFrame({"id": range(1001), "ts": times, "key": [f"k{i % 2}" for i in range(999)] + ["k0", "k0"]})
    out = pd.concat(p.handleInputRows((7,), iter([rows.iloc[500:], rows.iloc[:500]]), None))
    assert out["id"].tolist() == list(range(1001)) and [i for i, c in zip(out["id"], out["cached"]) if not c] == [0, 1, 1000]
    assert held.calls <= 6 and len(held.timers) == 1
    assert held.rows[("k0",)][0] == 1000 and held.rows[("k1",)][0] == 1

    class Info:
        def __init__(self, at):
            self.at = at

        def getExpiryTimeInMs(self):
            return self.at

    list(p.handleExpiredTimer((7,), None, Info(held.timers[0] - 1000)))
    assert list(held.rows) == [("k0",)]
    list(p.handleExpiredTimer((7,), None, Info(held.timers[0])))
    assert not held.rows
