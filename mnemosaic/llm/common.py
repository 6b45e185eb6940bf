"""Shared helpers: reading tables, cutting lineage through the shared checkpoint folder, and dropping rows without moving the rest."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import Scratch, owned, shared_dir  # noqa: F401  for the other modules too


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Hands whole texts to Python in small Arrow batches: their buffers lie outside the heap, twice per task."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that the frame doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of a mark table: 16 for each key, between these. The most makes a million rows of two longs, the bound of its broadcast.
LEAST_BITS, MOST_BITS = 1 << 12, 1 << 26


class Marks:
    """A bit for each of the keys (long, by remainder) as a table of words that is broadcast: what has no mark is not among the keys."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        only = keys.toDF("k")
        n = only.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n).bit_length()))
        place = only.select(F.pmod("k", F.lit(self.bits)).alias("p"))
        words = place.groupBy(F.expr("p div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, CAST(p % 64 AS INT)))").alias("b"))
        self.words = scratch.keep(words)

    def split(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """(rows whose key may be marked, rows whose key isn't), both with the columns of df. Neither is shuffled."""
        p, w, b = (fresh(df, x) for x in ("_p", "_w", "_b"))
        placed = df.withColumn(p, F.coalesce(F.pmod(key, F.lit(self.bits)), F.lit(0))).withColumn(w, F.expr(f"`{p}` div 64"))
        words = F.broadcast(self.words.withColumnsRenamed({"w": w, "b": b}))  # MOST_BITS / 64 rows at most
        seen = placed.join(words, w, "left").withColumn(b, F.expr(f"coalesce(shiftright(`{b}`, CAST(`{p}` % 64 AS INT)) & 1L, 0L)"))
        keep = [F.col(f"`{c}`") for c in df.columns]
        return seen.filter(F.col(b) == 1).select(*keep), seen.filter(F.col(b) == 0).select(*keep)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so many rows. What the allocators hold unused goes back when a batch is done, as workers stay."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)
        trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only with glibc
        ctypes.CDLL(None).malloc_trim(0)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about so many bytes, for work that is done once for equal words of a batch."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of a text column, so that what is made of a slice stays small."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = np.flatnonzero(np.diff(ends // size)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)
    trim()
