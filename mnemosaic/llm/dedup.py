"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Each scan partition makes a run: one row per digest, with the row that stays so far. Runs meet in
binomial rounds: RUNS runs become RUNS / FAN, and so on, until one remains. A round is a grouped
minimum on (run, digest), so every run is itself spread over tasks by digest, each task merges its
runs in digest order, and a copy group of any size enters a round as at most one row per run. A
second digest and the length of the normalised text travel along and must agree as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, Scratch, fresh

#: Runs before the first round, and how many of them each round merges.
RUNS, FAN = 512, 8
BLANKS = r"[\x20\x09-\x0D]+"
KEY = ["text_sha256", "check", "norm_len"]


def digests(docs: DataFrame) -> DataFrame:
    """One slim row per document: ids, code points of the original text, and digests of the normalised text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    norm = F.regexp_replace(text, BLANKS, "")
    return docs.select("doc_id", F.length(text).alias("n"), norm.alias("norm")).select(
        "doc_id",
        "n",
        F.sha2("norm", 256).alias("text_sha256"),
        F.xxhash64("norm").alias("check"),
        F.length("norm").alias("norm_len"),
        F.monotonically_increasing_id().alias("row"),
    )


def merge_runs(slim: DataFrame) -> DataFrame:
    """(digest, keep, group_size): the winners of all runs, merged round by round."""
    best = F.struct((-F.col("n")).alias("neg"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    runs = slim.select(*KEY, best.alias("best"), F.pmod(F.spark_partition_id(), F.lit(RUNS)).alias("run"), F.lit(1).cast("long").alias("size"))
    left = RUNS
    while True:
        runs = runs.groupBy("run", *KEY).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        if left == 1:
            break
        left //= FAN
        runs = runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
    return runs.select(*KEY, "best", "size")


def exact_groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical without blanks; null counts as empty. The row with the most code
    points stays, then the smallest doc_id (null first), then the first such row, so repeated rows
    leave one. Other columns of docs are not read. An empty table gives an empty one.
    """
    slim = scratch.keep(digests(docs))
    groups = scratch.keep(merge_runs(slim).filter("size > 1"))
    return slim.join(groups, KEY, "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("size").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
        "row",
    )


def drop_exact_duplicates(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents that stay, with all their columns.

    A broadcast table of marks, of bounded size, tells the rows whose doc_id may be that of a dropped
    one; the others pass the scan without a shuffle. Of those few, rows with a dropped doc_id and digest go;
    of rows equal in both, the longest stays. Null texts count as empty, null ids are an id like any
    other, extra columns of any name stay as they are, and an empty table gives an empty one.
    """
    out = exact_groups(docs, scratch)
    key = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")]
    losers = scratch.keep(out.filter("NOT kept").select(*key).distinct())
    winners = out.filter("kept AND group_size > 1").select(*key).distinct()
    twice = F.col("_won").isNotNull()  # rows that repeat a doc_id and its text: one of them stays
    same = losers["_id"].eqNullSafe(winners["_id"]) & (losers["_sha"] == winners["_sha"])
    gone = scratch.keep(losers.join(winners.withColumn("_won", F.lit(1)), same, "left").select(losers["_id"], losers["_sha"], twice.alias("_twice")))
    number = lambda c: F.coalesce(F.xxhash64(c), F.lit(0))
    marks = Marks(gone.select(number("_id")), scratch)
    scratch.drop_but(gone, marks.words)
    may, clean = marks.split(docs, number("doc_id"))
    sha, size = fresh(docs, "_key"), fresh(docs, "_size")
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), BLANKS, ""), 256)
    keyed = may.withColumn(sha, digest)
    again = gone.filter("_twice")
    of = lambda g: keyed["doc_id"].eqNullSafe(g["_id"]) & (keyed[sha] == g["_sha"])
    kept = clean.union(keyed.join(gone, of(gone), "left_anti").drop(sha))
    if again.isEmpty():
        return kept
    rows = keyed.join(again, of(again), "left_semi").withColumn(size, F.length(F.coalesce("text", F.lit(""))))
    longest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(size), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])))
    return kept.union(rows.groupBy("doc_id", sha).agg(longest.alias("row")).select("row.*"))
