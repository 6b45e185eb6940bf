"""Stateful streams of tool calls: repeated calls, outputs kept for a time, unchanged re-reads, and transformers in order.

Each takes the same rows in batch and in a stream. The state of a key is small and bounded, and goes by event time.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as tx


class CallMemory:
    """Outputs of a session's calls by signature, the least recently used forgotten beyond a number."""

    def __init__(self, most: int, turns: int, protected: tuple[str, ...], entries: list[tuple[str, str, int]] | None = None):
        self.most, self.turns, self.protected = most, turns, protected
        self.held = OrderedDict((s, (o, t)) for s, o, t in entries or [])

    def seen(self, tool: str, signature: str, turn: int) -> str | None:
        """The output of an equal call that is old enough to be told again."""
        if tool in self.protected or signature not in self.held:
            return None
        self.held.move_to_end(signature)
        output, at = self.held[signature]
        return output if turn - at >= self.turns else None

    def record(self, signature: str, output: str | None, turn: int) -> None:
        if output is not None and len(output) >= 20:
            self.held[signature] = (output, turn)
            self.held.move_to_end(signature)
            while len(self.held) > self.most:
                self.held.popitem(last=False)

    def entries(self) -> list[tuple[str, str, int]]:
        return [(s, o, t) for s, (o, t) in self.held.items()]


def _by_session(rows: DataFrame, session: str, step: Callable, out: str, state: str, idle_ms: int) -> DataFrame:
    """rows through step(rows in order, state) by session, in batch or as a stream."""

    def ordered(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).sort_values(["ts", "id"])

    if not rows.isStreaming:
        return rows.groupBy(session).applyInPandas(lambda key, part: step(key[0], ordered([part]), None)[0], out)

    def run(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        part = ordered(list(parts))
        made, new = step(key[0], part, held.get if held.exists else None)
        held.update(new)
        held.setTimeoutTimestamp(max(int(part["ts"].max().timestamp() * 1000), held.getCurrentWatermarkMs()) + idle_ms)
        yield made

    return rows.withWatermark("ts", "1 hour").groupBy(session).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def repeated_calls(calls: DataFrame, most: int = 50, turns: int = 2, protected: tuple[str, ...] = ("edit", "write"), session: str = "session_id", idle_ms: int = 3_600_000) -> DataFrame:
    """calls(session_id, id, ts, turn, tool, args map, output) -> session_id, id, cached, output.

    A call that equals one of the session's last fifty signatures, two turns or more ago, gets that one's output; tools that change
    things never do. Outputs shorter than twenty characters aren't kept.
    """
    kind = calls.schema[session].dataType.simpleString()

    def step(key, part: pd.DataFrame, state):
        memory = CallMemory(most, turns, protected, list(zip(*state)) if state and state[0] else None)
        out = []
        for r in part.itertuples():
            told = memory.seen(r.tool, r.signature, int(r.turn))
            out.append((key, r.id, told is not None, told if told is not None else r.output))
            if told is None:
                memory.record(r.signature, r.output, int(r.turn))
        kept = memory.entries()
        return pd.DataFrame(out, columns=[session, "id", "cached", "output"]), ([e[0] for e in kept], [e[1] for e in kept], [e[2] for e in kept])

    slim = calls.select(session, "id", "ts", "turn", "tool", tx.call_signature(F.col("tool"), F.col("args")).alias("signature"), "output")
    return _by_session(slim, session, step, f"{session} {kind}, id long, cached boolean, output string", "s array<string>, o array<string>, t array<long>", idle_ms)


def unchanged_reads(reads: DataFrame, most: int = 100, session: str = "session_id", idle_ms: int = 3_600_000) -> DataFrame:
    """reads(session_id, id, ts, turn, path, content) -> session_id, id, unchanged, since, lines, chars.

    A read of one of the session's last hundred files whose content is the same as when it was last read is told as unchanged since that turn.
    """
    kind = reads.schema[session].dataType.simpleString()

    def step(key, part: pd.DataFrame, state):
        held = OrderedDict((p, (h, t)) for p, h, t in zip(*state)) if state and state[0] else OrderedDict()
        out = []
        for r in part.itertuples():
            known = held.pop(r.path, None)
            same = known is not None and known[0] == r.hash
            out.append((key, r.id, same, known[1] if same else None, r.lines, r.chars))
            held[r.path] = (r.hash, int(r.turn))
            while len(held) > most:
                held.popitem(last=False)
        made = pd.DataFrame(out, columns=[session, "id", "unchanged", "since", "lines", "chars"]).astype({"since": "Int64"})
        return made, ([*held], [h for h, _ in held.values()], [t for _, t in held.values()])

    text = F.coalesce("content", F.lit(""))
    slim = reads.select(session, "id", "ts", "turn", "path", F.substring(F.sha2(text, 256), 1, 16).alias("hash"), F.size(F.split(text, "\n")).cast("long").alias("lines"), F.length(text).cast("long").alias("chars"))
    return _by_session(slim, session, step, f"{session} {kind}, id long, unchanged boolean, since long, lines long, chars long", "p array<string>, h array<string>, t array<long>", idle_ms)


def kept_outputs(outputs: DataFrame, minutes: int = 60) -> DataFrame:
    """outputs(id, ts, output) -> id, key, first_id, cached: whether an equal output came in the last sixty minutes, and the first of that run.

    A key's outputs are one run as long as each follows the one before it within the time. In batch; a stream keeps the first of each run
    with sessions.without_repeats().
    """
    from pyspark.sql import Window

    keyed = outputs.withColumn("key", F.substring(F.sha2(F.coalesce("output", F.lit("")), 256), 1, 16))
    w = Window.partitionBy("key").orderBy("ts", "id")
    gap = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)
    runs = keyed.withColumn("cached", F.coalesce(gap <= minutes * 60, F.lit(False)))
    first = F.last(F.when(~F.col("cached"), F.col("id")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.select("id", "key", first.alias("first_id"), "cached")


def transformed(rows: DataFrame, steps: list[tuple[str, int, str, Callable[[Column], Column]]], column: str = "output") -> DataFrame:
    """rows through steps (name, priority, loss, expression) in order of priority; adds provenance, the steps that changed something with their loss.

    A step whose result is null has failed: it leaves the value as it is and is not named. The chain is one projection.
    """
    value, trail = F.col(column), F.array().cast("array<struct<step:string,loss:string>>")
    for name, _, loss, make in sorted(steps, key=lambda s: (s[1], s[0])):
        new = F.coalesce(make(value), value)
        entry = F.struct(F.lit(name).alias("step"), F.lit(loss).alias("loss"))
        trail = F.when(new.eqNullSafe(value), trail).otherwise(F.array_append(trail, entry))
        value = new
    return rows.withColumn("provenance", trail).withColumn(column, value)
