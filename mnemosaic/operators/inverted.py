"""A kept inverted index: BM25 from postings on disk, without the texts.

A segment has the postings of its rows in blocks: a block is up to 2^BLOCK_BITS rows of a scope by their number, and an entry is one
term of a block with the rows' ids, frequencies and lengths, the largest frequency and the least length. Entries are written by
bucket of the term, so that a query reads the buckets of its terms only; the bounds are a table of their own, without the lists,
sorted by term like the table of document frequencies.
A row is inserted into a new segment. A removal is a segment too: ids that no longer count in the segments before it, and the
numbers that its terms and lengths take away from the statistics. merge() makes one segment of all.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import Scratch, Segments
from .lexical import B, K1, query_terms

BUCKETS, BLOCK_BITS = 64, 8
#: Blocks that are named in the filter of a scan; more are joined.
NAMED = 1_000
ENTRY = "scope string, term string, block bigint, ids array<bigint>, tfs array<int>, dls array<int>"
BOUNDS = "n int, max_tf int, min_dl int"
BOUND = f"scope string, term string, block bigint, {BOUNDS}"
TERM, TOTAL, GONE = "scope string, term string, df bigint", "scope string, n bigint, length bigint", "id bigint"


def _bucket(term: Column) -> Column:
    return F.pmod(F.crc32(term), F.lit(BUCKETS)).cast("int")


def _bucket_of(term: str) -> int:
    return zlib.crc32(term.encode()) % BUCKETS


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with their bounds, of rows (id, scope, block, dl, t). Rows of a block that come in two batches give two entries of a term."""
    names = ["scope", "term", "block", "ids", "tfs", "dls", "n", "max_tf", "min_dl"]
    for b in batches:
        rows = pa.table(b).sort_by([("block", "ascending"), ("scope", "ascending"), ("id", "ascending")]).combine_chunks()
        column = lambda c: rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c]  # noqa: B023, E731
        words = column("t")
        term = pc.list_flatten(words).dictionary_encode()
        if not len(term):
            continue
        block, scope = column("block").to_numpy(), pc.fill_null(column("scope").dictionary_encode().indices, -1).to_numpy()
        own = np.cumsum(np.r_[0, (block[1:] != block[:-1]) | (scope[1:] != scope[:-1])])  # rows of one block and scope
        key, tf = np.unique(term.indices.to_numpy().astype(np.int64) * len(rows) + pc.list_parent_indices(words).to_numpy(), return_counts=True)
        code, row = np.divmod(key, len(rows))
        start = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (own[row[1:]] != own[row[:-1]])])
        ends = pa.array(np.r_[start, len(key)].astype(np.int32))
        tf, dl = tf.astype(np.int32), column("dl").to_numpy()[row].astype(np.int32)
        lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (column("id").to_numpy()[row], tf, dl)]
        bounds = [np.diff(np.r_[start, len(key)]).astype(np.int32), np.maximum.reduceat(tf, start), np.minimum.reduceat(dl, start)]
        first = pa.array(row[start])
        yield pa.RecordBatch.from_arrays([column("scope").take(first), term.dictionary.take(pa.array(code[start])), column("block").take(first), *lists, *map(pa.array, bounds)], names)


def _total(state: dict) -> list[int]:
    return [state.get("n", 0), state.get("length", 0)]


class InvertedIndex:
    """BM25 over rows (id long, text, scope) kept under a folder that all executors share.

    Texts are tokenised when they are inserted; null texts have no tokens but count as rows. Ids are unique among live rows.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.segments = spark, Segments(spark, root)

    # ---- writing ----

    def _counted(self, rows: DataFrame, id_: str, text: Column, scope: str | None) -> DataFrame:
        own = F.col(scope).cast("string") if scope else F.lit(None).cast("string")
        return rows.select(F.col(id_).cast("long").alias("id"), own.alias("scope"), tokens(F.coalesce(text, F.lit(""))).alias("t"))

    def _statistics(self, counted: DataFrame, segment: int, sign: int) -> list[int]:
        """Writes rows and lengths by scope, and gives those of all."""
        counted.groupBy("scope").agg((F.count("*") * sign).alias("n"), (F.sum("dl") * sign).cast("long").alias("length")).write.parquet(self.segments.path(segment, "totals"))
        return list(self.spark.read.schema(TOTAL).parquet(self.segments.path(segment, "totals")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first())

    def _write(self, counted: DataFrame, segment: int) -> list[int]:
        at = lambda table: self.segments.path(segment, table)
        counted.withColumns({"row": F.monotonically_increasing_id(), "dl": F.size("t")}).write.parquet(at("rows"))
        rows = self.spark.read.parquet(at("rows"))
        total = self._statistics(rows, segment, 1)
        # rows of a block lie together, so a task makes their entries without an exchange
        made = rows.select("id", "scope", F.shiftright("row", BLOCK_BITS).alias("block"), "dl", "t").mapInArrow(_entries, f"{ENTRY}, {BOUNDS}")
        # a bucket is split by size, and sorted so that a term's row groups are found by their bounds
        dealt = made.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "scope", "block")
        dealt.write.partitionBy("bucket").parquet(at("entries"))
        kept = self.spark.read.parquet(at("entries"))
        self._sorted(kept.select("scope", "term", "block", "n", "max_tf", "min_dl"), at("bounds"))
        self._sorted(self.spark.read.parquet(at("bounds")).groupBy("scope", "term").agg(F.sum("n").alias("df")), at("terms"))
        return total

    def _sorted(self, rows: DataFrame, path: str) -> None:
        """A small table by ranges of its terms, so that the bounds in its files say which of them a query needs."""
        rows.repartitionByRange("term").sortWithinPartitions("term").write.parquet(path)

    def _publish(self, live: list[int], *totals: list[int]) -> None:
        n, length = (sum(x) for x in zip(*totals))
        self.segments.publish({"live": live, "next": max(live) + 1, "n": n, "length": length})

    def _begin(self) -> tuple[dict, int]:
        state = self.segments.state()
        return state, self.segments.number(state)

    def insert(self, rows: DataFrame, id_: str, text: Column, scope: str | None = None) -> None:
        state, segment = self._begin()
        total = self._write(self._counted(rows, id_, text, scope), segment)
        self._publish([*state["live"], segment], _total(state), total)

    def _take_out(self, old: DataFrame, segment: int) -> list[int]:
        """old: rows as they were counted. Their ids go from the segments before, their numbers from the statistics."""
        at = lambda table: self.segments.path(segment, table)
        scratch = Scratch(self.spark, "taken")
        old = scratch.keep(old.withColumn("dl", F.size("t")))  # the live rows are read once
        old.select("id").write.parquet(at("gone"))
        total = self._statistics(old, segment, -1)
        terms = old.select("scope", F.explode(F.array_distinct("t")).alias("term")).groupBy("scope", "term").agg((-F.count("*")).alias("df"))
        self._sorted(terms, at("terms"))
        scratch.drop(old)
        return total

    def delete(self, ids: DataFrame, id_: str = "id") -> None:
        """Rows of these ids go. Ids that aren't there change nothing."""
        state, segment = self._begin()
        total = self._take_out(self._live_rows(state["live"]).join(ids.select(F.col(id_).cast("long").alias("id")).distinct(), "id", "left_semi"), segment)
        self._publish([*state["live"], segment], _total(state), total)

    def update(self, rows: DataFrame, id_: str, text: Column, scope: str | None = None) -> None:
        """Rows of these ids as they are now: what was there under the ids goes, in one publication with the insertion."""
        state, segment = self._begin()
        new = self._counted(rows, id_, text, scope)
        less = self._take_out(self._live_rows(state["live"]).join(new.select("id").distinct(), "id", "left_semi"), segment)
        more = self._write(new, segment + 1)
        self._publish([*state["live"], segment, segment + 1], _total(state), less, more)

    def merge(self) -> None:
        """One segment of all live rows. Readers of the last state go on with its files until clean()."""
        state, segment = self._begin()
        self._publish([segment], self._write(self._live_rows(state["live"]), segment))

    # ---- reading ----

    def _without_gone(self, rows: DataFrame, live: list[int]) -> DataFrame:
        if not self.segments.having("gone", live):
            return rows
        gone = self.segments.read("gone", live, GONE).groupBy("id").agg(F.max("segment").alias("until"))
        return rows.join(gone, (rows["id"] == gone["id"]) & (rows["segment"] < gone["until"]), "left_anti")

    def _live_rows(self, live: list[int]) -> DataFrame:
        rows = self.segments.read("rows", live, "id bigint, scope string, t array<string>")
        return self._without_gone(rows, live).select("id", "scope", "t")

    def _of_terms(self, table: str, schema: str, live: list[int], terms: list[str]) -> DataFrame:
        """Of entries only the folders of the terms' buckets are listed and read."""
        if table != "entries":
            return self.segments.read(table, live, schema).filter(F.col("term").isin(terms))
        return self.segments.read(table, live, f"{schema}, bucket int", [f"bucket={_bucket_of(t)}" for t in terms]).filter(F.col("term").isin(terms))

    def _scored(self, live: list[int], entries: DataFrame, wanted: list[str], weigh: DataFrame | None, idf: dict[str, float] | None, avgdl: float | None) -> DataFrame:
        """(id, scope, raw): sums over the terms. Statistics are numbers, or by scope and term in weigh(scope, term, idf, avgdl)."""
        one = entries.select("scope", "term", "segment", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("e")).select("scope", "term", "segment", F.col("e.ids").alias("id"), F.col("e.tfs").alias("tf"), F.col("e.dls").alias("dl"))
        one = self._without_gone(one, live)
        if weigh is None:
            table = F.create_map(*[F.lit(x) for t, v in idf.items() for x in (t, v)])
            one = one.withColumns({"idf": F.element_at(table, F.col("term")), "avgdl": F.lit(avgdl)})
        else:
            w = weigh.withColumnsRenamed({"scope": "_scope", "term": "_term"})
            one = one.join(w, F.col("scope").eqNullSafe(F.col("_scope")) & (F.col("term") == F.col("_term")))
        times = F.create_map(*[F.lit(x) for t in sorted(set(wanted)) for x in (t, wanted.count(t))])
        part = F.element_at(times, F.col("term")) * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        return one.groupBy("id", "scope").agg(F.sum(part).alias("raw"))

    def _numbers(self, state: dict, terms: list[str]) -> tuple[float, dict[str, float]]:
        """The mean length, and the weight of each term that occurs: one number for each term reaches the driver."""
        live, (n, length) = state["live"], _total(state)
        df = {r.term: r.df for r in self._of_terms("terms", TERM, live, terms).groupBy("term").agg(F.sum("df").alias("df")).collect() if r.df > 0}
        return length / n if n else 0.0, {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}

    def raw(self, query: str) -> DataFrame:
        """(id, raw) of all rows that have a term of the query, by statistics of all rows."""
        state, wanted = self.segments.state(), query_terms(query)
        live = state["live"]
        avgdl, idf = self._numbers(state, sorted(set(wanted))) if wanted else (0.0, {})
        if not idf:
            return self.spark.createDataFrame([], "id bigint, raw double")
        return self._scored(live, self._of_terms("entries", ENTRY, live, sorted(idf)), wanted, None, idf, avgdl).select("id", "raw")

    def _best(self, live: list[int], wanted: list[str], idf: dict[str, float], avgdl: float, limit: int) -> DataFrame:
        """(id, raw) that hold the best rows: blocks whose bound is below the score that the most promising blocks reach are not read.

        The bound of a block is the sum of its terms' bounds, each from the largest frequency and the least length.
        """
        terms = sorted(idf)
        times = {t: wanted.count(t) * idf[t] for t in terms}
        weight = F.element_at(F.create_map(*[F.lit(x) for t, v in times.items() for x in (t, v)]), F.col("term"))
        most = weight * F.col("max_tf") * (K1 + 1) / (F.col("max_tf") + K1 * (1 - B + B * F.col("min_dl") / avgdl))
        blocks = self._of_terms("bounds", BOUND, live, terms).groupBy("segment", "block").agg(F.sum(most).alias("bound"), F.max("n").alias("n"))
        listed = blocks.orderBy(F.desc("bound"), "segment", "block").limit(NAMED + 1).collect()
        entries = self._of_terms("entries", ENTRY, live, terms)
        scored = lambda rows: self._scored(live, rows, wanted, None, idf, avgdl).select("id", "raw")

        def among(rows) -> DataFrame:
            pairs = F.broadcast(self.spark.createDataFrame([(r.segment, r.block) for r in rows], "segment int, block bigint"))
            return entries.filter(F.col("block").isin([r.block for r in rows])).join(pairs, ["segment", "block"], "left_semi")

        first = max(4, 2 * limit >> BLOCK_BITS)  # a few blocks hold a list as long
        reached = scored(among(listed[:first])).orderBy(F.desc("raw"), "id").limit(limit).collect()
        if len(reached) < limit:
            return scored(entries)
        least = reached[-1].raw * (1 - 1e-12)
        worth = [r for r in listed if r.bound >= least]
        if len(worth) <= first:  # nothing else can be among the best
            return self.spark.createDataFrame(reached, "id bigint, raw double")
        if len(worth) <= NAMED:
            return scored(among(worth))
        return scored(entries.join(blocks.filter(F.col("bound") >= least).select("segment", "block"), ["segment", "block"], "left_semi"))

    def bm25_topk(self, query: str, limit: int) -> DataFrame:
        """(id, score): the rows of lexical.bm25_topk, from the blocks that can hold them."""
        state, wanted = self.segments.state(), query_terms(query)
        avgdl, idf = self._numbers(state, sorted(set(wanted))) if wanted else (0.0, {})
        if not idf:
            return self.spark.createDataFrame([], "id bigint, score double")
        best = self._best(state["live"], wanted, idf, avgdl, limit).orderBy(F.desc("raw"), "id").limit(limit)
        top = F.max("raw").over(Window.partitionBy(F.lit(0)))  # limit rows at most
        return best.select("id", (F.col("raw") / F.greatest(top, F.lit(1.0))).alias("score")).orderBy(F.desc("score"), "id")

    def bm25_scoped(self, query: str, limit: int) -> DataFrame:
        """(id, scope, score): the rows of lexical.bm25_scoped, with the statistics of each scope."""
        live, wanted = self.segments.state()["live"], query_terms(query)
        if not wanted:
            return self.spark.createDataFrame([], "id bigint, scope string, score double")
        terms = sorted(set(wanted))
        totals = self.segments.read("totals", live, TOTAL).groupBy("scope").agg(F.sum("n").alias("n"), F.sum("length").alias("length")).filter("n > 0")
        df = self._of_terms("terms", TERM, live, terms).groupBy("scope", "term").agg(F.sum("df").alias("df")).filter("df > 0")
        t = totals.withColumnRenamed("scope", "_own")
        weigh = df.join(t, F.col("scope").eqNullSafe(F.col("_own"))).select("scope", "term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (F.col("length") / F.col("n")).alias("avgdl"))
        raw = self._scored(live, self._of_terms("entries", ENTRY, live, terms), wanted, weigh, None, None)
        rank = F.row_number().over(Window.partitionBy("scope").orderBy(F.desc("raw"), "id"))
        best = raw.withColumn("_r", rank).filter(F.col("_r") <= limit)
        top = F.max("raw").over(Window.partitionBy("scope"))
        return best.select("id", "scope", (F.col("raw") / F.greatest(top, F.lit(1.0))).alias("score")).orderBy(F.desc("score"), "id").limit(limit)

    def postings(self) -> DataFrame:
        """(id, term, frequency) of live rows."""
        live = self.segments.state()["live"]
        flat = self.segments.read("entries", live, f"{ENTRY}, bucket int").select("term", "segment", F.explode(F.arrays_zip("ids", "tfs")).alias("e")).select(F.col("e.ids").alias("id"), "term", F.col("e.tfs").cast("long").alias("frequency"), "segment")
        return self._without_gone(flat, live).select("id", "term", "frequency")
