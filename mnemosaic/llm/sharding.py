"""Two-pass external shuffle into shards.

Rows are written once with a number, which tells rows apart that are equal. Pass one scatters the whole rows uniformly into
buckets of a size that fits one task's memory, by a seeded hash of their values and numbers, so that a recomputed
task scatters them alike and repeated rows are spread. Pass two shuffles each bucket by Fisher-Yates with a generator
seeded by the bucket, and gives its rows in their new order. The buckets laid end to end are one uniform order; position p goes to
shard p mod n, slot p div n, so row counts differ by one at most. Each bucket is written where it was shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, fresh

#: A bucket holds about so many bytes or rows, whichever fills it first; at least LEAST buckets keep all cores busy. MOST bounds the
#: table of their offsets, which is broadcast; from 256 TB on, buckets grow beyond BUCKET_BYTES instead.
BUCKET_BYTES, BUCKET_ROWS, LEAST, MOST = 64 << 20, 200_000, 64, 1 << 22


def with_sizes(docs: DataFrame) -> DataFrame:
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return docs.withColumns({"size": (F.octet_length(raw) + 1).cast("long"), "text_crc32": F.crc32(raw)})


def shuffled_shards(rows: DataFrame, scratch: Scratch, shards: int = 8, seed: int = 17) -> DataFrame:
    """rows (doc_id, size, text_crc32 and any other columns, of any name) with shard and slot instead of columns so named.

    Null ids are hashed by their other values. Repeated rows stay and are spread like others. An empty table gives an empty one.
    """
    rows = rows.drop("shard", "slot")
    nr, bucket, pos, offset = (fresh(rows, x) for x in ("_nr", "_bucket", "_pos", "_offset"))
    numbered = scratch.keep(rows.withColumn(nr, F.monotonically_increasing_id()))
    n, total = numbered.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = int(min(MOST, max(LEAST, n // BUCKET_ROWS, total // BUCKET_BYTES)))
    at = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), "text_crc32", "size", nr), F.lit(buckets)).cast("int")
    scattered = numbered.withColumn(bucket, at)
    counts = scattered.groupBy(bucket).agg(F.count("*").alias("n"))
    offsets = counts.select(bucket, (F.sum("n").over(Window.orderBy(bucket)) - F.col("n")).alias(offset))  # a row for each bucket
    out = T.StructType([*scattered.schema.fields, T.StructField(pos, T.LongType())])

    def fisher_yates(rows: pa.Table) -> pa.Table:
        keys = ["doc_id", "text_crc32", "size", nr]
        first = pc.sort_indices(rows.select(keys), [(k, "ascending") for k in keys]).to_numpy()  # whatever order they came in
        rng = np.random.Generator(np.random.PCG64([seed, rows[bucket][0].as_py()]))
        at = np.arange(rows.num_rows)
        rng.shuffle(at)
        return rows.take(pa.array(first[np.argsort(at)])).append_column(pos, pa.array(np.arange(rows.num_rows), pa.int64()))

    placed = scattered.groupBy(bucket).applyInArrow(fisher_yates, out)
    p = F.col(offset) + F.col(pos)
    named = placed.join(F.broadcast(offsets), bucket).withColumns({"shard": F.pmod(p, F.lit(shards)).cast("int"), "slot": F.floor(p / shards).cast("long")})
    return named.select(*rows.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, scratch: Scratch, shards: int = 8, seed: int = 17) -> None:
    """All columns of docs with size, text_crc32 and slot, in shuffled order, one folder per shard and in it a file for each bucket.

    Null texts have size 1. Repeated rows stay. An empty table writes no rows.
    """
    placed = shuffled_shards(with_sizes(docs), scratch, shards, seed)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
