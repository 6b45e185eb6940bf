"""Dispatch of session events: each micro-batch goes through handlers that upsert rows into tables, once, however often it is replayed.

The rows that a batch gives for all tables are one segment with the batch's number, and become visible together when the segment is
published. A batch whose number was published before is skipped; one that failed before it was published is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import Segments

#: A handler's rows may have this column: where it is true, the key's row goes.
GONE = "_gone"


class Handler:
    """make(batch) gives rows for a table; of the rows of a key in a batch the one that is last by order counts."""

    def __init__(self, table: str, keys: list[str], order: list[str], make: Callable[[DataFrame], DataFrame], kinds: tuple[str, ...] | None = None):
        self.table, self.keys, self.order, self.make, self.kinds = table, keys, order, make, kinds


class Dispatcher:
    """Tables under a folder that all executors share, kept by handlers of event kinds. Use start(), or as a function of foreachBatch."""

    def __init__(self, spark: SparkSession, root: str, handlers: list[Handler], kind: str = "event_type"):
        self.spark, self.handlers, self.kind = spark, handlers, kind
        self.segments = Segments(spark, root)
        if len({h.table for h in handlers}) < len(handlers):
            raise ValueError("a table has one handler")

    def __call__(self, batch: DataFrame, number: int) -> None:
        state = self.segments.state()
        if number <= state.get("batch", -1):
            return
        segment, schemas = state["next"], dict(state.get("schemas", {}))
        batch = batch.persist()
        try:
            for h in self.handlers:
                rows = h.make(batch.filter(F.col(self.kind).isin(*h.kinds)) if h.kinds else batch)
                rows = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
                last = F.row_number().over(Window.partitionBy(*h.keys).orderBy(*[F.desc(o) for o in h.order]))
                rows = rows.withColumn("_last", last).filter("_last = 1").drop("_last")
                rows.write.mode("overwrite").parquet(self.segments.path(segment, h.table))
                schemas[h.table] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        finally:
            batch.unpersist()
        self.segments.publish({"live": [*state["live"], segment], "next": segment + 1, "batch": number, "schemas": schemas})

    def table(self, name: str) -> DataFrame:
        """The rows of a table as they are now: of each key the last batch's."""
        h = next(h for h in self.handlers if h.table == name)
        state = self.segments.state()
        rows = self.segments.read(name, state["live"], state["schemas"][name])
        last = F.row_number().over(Window.partitionBy(*h.keys).orderBy(F.desc("segment")))
        return rows.withColumn("_last", last).filter(f"_last = 1 AND NOT {GONE}").drop("_last", GONE, "segment")

    def compact(self) -> None:
        """One segment of what the tables have now. The number of the last batch stays, so a replay is skipped as before."""
        state = self.segments.state()
        segment = state["next"]
        for h in self.handlers:
            self.table(h.table).withColumn(GONE, F.lit(False)).write.mode("overwrite").parquet(self.segments.path(segment, h.table))
        self.segments.publish(state | {"live": [segment], "next": segment + 1})

    def start(self, events: DataFrame, checkpoint: str):
        """A query over all events that are there; started again with the same checkpoint, it goes on where it ended."""
        return events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standard_handlers(session: str = "session_id") -> list[Handler]:
    """Sessions with their first and last event and whether they are idle, the last status of each message, and files touched."""
    own = F.col(session)

    def sessions(batch: DataFrame) -> DataFrame:
        closing = F.col("event_type").isin("session.idle", "session.deleted")
        return batch.groupBy(own.alias("session")).agg(F.max("ts").alias("ts"), F.max_by(F.when(closing, F.col("event_type")).otherwise("session.active"), F.struct("ts", "id")).alias("state"), F.max_by("event_type", F.struct("ts", "id")).alias("last_event"), F.bool_or(F.col("event_type") == "session.deleted").alias(GONE))

    def messages(batch: DataFrame) -> DataFrame:
        return batch.select("id", own.alias("session"), "ts", "event_type")

    def files(batch: DataFrame) -> DataFrame:
        return batch.filter("file IS NOT NULL").groupBy(own.alias("session"), "file").agg(F.max("ts").alias("ts"), F.max("id").alias("last_id"))

    return [
        Handler("sessions", ["session"], ["ts"], sessions),
        Handler("messages", ["id"], ["ts"], messages, ("message.updated", "message.part.updated")),
        Handler("files", ["session", "file"], ["ts"], files, ("file.edited",)),
    ]
