"""A kept index for approximate nearest neighbours by cosine: vectors in cells around learned centres.

Centres are found by spherical k-means on a bounded sample; every vector is written to the folder of its nearest centre. A search
reads the folders of the few centres nearest to the query, and scores their vectors exactly. Rows are inserted as segments and
deleted by tombstones; rebuild() learns the centres anew. A node with several vectors has a point for each, and counts by its best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as vx
from ..sources.shared import Segments
from . import dense

#: Rows that centres are learned from, at most; centres, at most: what the driver holds, and sends to the executors, is bounded by both.
SAMPLE, MOST_CELLS, ROUNDS = 32_768, 16_384, 12
POINT, GONE = "id bigint, v array<float>, cell int", "id bigint"


def learned(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Spherical k-means: unit centres. A centre that no row is nearest to moves to the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        close = np.concatenate([sample[i : i + 4096] @ centres.T for i in range(0, len(sample), 4096)])
        own, best = close.argmax(axis=1), close.max(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=len(centres)) == 0)
        sums[empty] = sample[np.argsort(best)[: len(empty)]]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return centres


def needed(sample: np.ndarray, centres: np.ndarray, recall: float, k: int = 10, queries: int = 512) -> int:
    """The fewest probes whose cells hold this share of the k nearest sample rows of some of the sample, each row itself left out."""
    asked = sample[: min(queries, len(sample))]
    close = asked @ sample.T
    np.put_along_axis(close, np.arange(len(asked))[:, None], -np.inf, axis=1)
    near = np.argpartition(-close, min(k, len(sample) - 1), axis=1)[:, :k]
    own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    turn = np.take_along_axis(place, own[near], axis=1).ravel()
    return int(np.sort(turn)[min(len(turn) - 1, int(np.ceil(recall * len(turn))) - 1)]) + 1


class VectorIndex:
    """Probes are as many as build() found to reach the recall it was asked for on its sample, unless a search names its own."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.segments = spark, Segments(spark, root)

    # ---- writing ----

    def build(self, vectors: DataFrame, id_: str, vec: str, cells: int | None = None, recall: float = 0.95) -> None:
        """Learns the centres (as many as the root of the number of vectors, or so many) and writes all vectors that aren't null."""
        state = self.segments.state()
        rows = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).filter("v IS NOT NULL")
        n = rows.count()
        cells = min(MOST_CELLS, cells or max(1, round(n**0.5)))
        part = rows.filter(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.2 * SAMPLE / max(n, 1)))).limit(SAMPLE).select("v").toArrow()
        sample = dense.unit_rows(part["v"])
        centres = learned(sample, cells) if n else np.zeros((0, 0))
        segment = self.segments.number(state)
        kept = [(k, c.tolist()) for k, c in enumerate(centres)]
        self.spark.createDataFrame(kept, "cell int, centre array<double>").coalesce(1).write.parquet(self.segments.path(segment, "centres"))
        self._write(rows, centres, segment)
        self.segments.publish({"live": [segment], "centres": segment, "probes": needed(sample, centres, recall) if n > 1 else 1, "next": segment + 1})

    def _write(self, rows: DataFrame, centres: np.ndarray, segment: int) -> None:
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                unit = dense.unit_rows(b.column("v"))
                cell = np.concatenate([(unit[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(unit), 4096)]) if len(unit) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

        # cells are split by size
        (rows.mapInArrow(place, POINT) if len(centres) else rows.withColumn("cell", F.lit(0))).hint("rebalance", "cell").write.partitionBy("cell").parquet(self.segments.path(segment, "points"))

    def insert(self, vectors: DataFrame, id_: str, vec: str) -> None:
        """New points, in the cells of the centres as they are. An index without centres is built."""
        state = self.segments.state()
        centres = self._centres(state)
        if not len(centres):
            return self.build(vectors, id_, vec)
        segment = self.segments.number(state)
        self._write(vectors.select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).filter("v IS NOT NULL"), centres, segment)
        self.segments.publish(state | {"live": [*state["live"], segment], "next": segment + 1})

    def delete(self, ids: DataFrame, id_: str = "id") -> None:
        """All points of these ids go; the same ids may be inserted again."""
        state = self.segments.state()
        segment = self.segments.number(state)
        ids.select(F.col(id_).cast("long").alias("id")).distinct().write.parquet(self.segments.path(segment, "gone"))
        self.segments.publish(state | {"live": [*state["live"], segment], "next": segment + 1})

    def rebuild(self) -> None:
        """One segment of the live points, with centres learned from them."""
        self.build(self.points(), "id", "v")

    # ---- reading ----

    def _centres(self, state: dict) -> np.ndarray:
        if "centres" not in state:
            return np.zeros((0, 0))
        rows = self.spark.read.parquet(self.segments.path(state["centres"], "centres")).orderBy("cell").collect()  # MOST_CELLS at most
        return np.array([r.centre for r in rows])

    def points(self, cells: list[int] | None = None) -> DataFrame:
        """(id, v, cell) of live points, of all cells or of these, whose folders alone are read."""
        live = self.segments.state()["live"]
        rows = self.segments.read("points", live, POINT)
        rows = rows if cells is None else rows.filter(F.col("cell").isin(cells))
        gone = self.segments.read("gone", live, GONE).groupBy(F.col("id").alias("_id")).agg(F.max("segment").alias("until"))
        return rows.join(gone, (rows["id"] == F.col("_id")) & (rows["segment"] < F.col("until")), "left_anti").select("id", "v", "cell")

    def search(self, query, k: int, probes: int | None = None) -> DataFrame:
        """(id, score): the best of the cells of the nearest centres. With as many probes as there are cells it is exact."""
        state = self.segments.state()
        centres = self._centres(state)
        q = np.asarray(query, float)
        near = np.argsort(-(centres @ q), kind="stable")[: probes or state["probes"]].tolist() if len(centres) else [0]
        scored = self.points(near).groupBy("id").agg(F.max(vx.cosine(F.col("v"), vx.literal(q))).alias("score"))
        return scored.orderBy(F.desc("score"), "id").limit(k)

    def search_many(self, queries: DataFrame, id_: str, vec: str, k: int, probes: int | None = None, block: int = dense.BLOCK) -> DataFrame:
        """(query_id, id, score, rank) for each query row, its own id left out. Queries and points meet by blocks of a cell, in tasks of bounded size."""
        state = self.segments.state()
        centres, probes = self._centres(state), probes or state.get("probes", 1)
        rows = queries.select(F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<float>").alias("v")).filter("v IS NOT NULL")

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                close = dense.unit_rows(b.column("v")) @ centres.T
                n = min(probes, close.shape[1])
                cells = np.argsort(-close, axis=1, kind="stable")[:, :n].ravel().astype(np.int32)
                own = b.take(pa.array(np.repeat(np.arange(b.num_rows), n)))
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("v"), pa.array(cells)], names=["id", "v", "cell"])

        asked = rows.mapInArrow(route, POINT) if len(centres) else rows.withColumn("cell", F.lit(0))
        cells = [r[0] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS at most
        found = dense.grid(asked, self.points(cells), dense.best_of(k), dense.BEST, block)
        return dense.ranked(found.groupBy("query_id", "id").agg(F.max("score").alias("score")), k)
