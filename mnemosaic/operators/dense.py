"""Dense search: exact nearest neighbours, segments, similar pairs, topic runs, selection for diversity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as vx
from ..sources.shared import Scratch

#: Rows of a group among which a greedy choice is made.
POOL = 1_000
#: Vectors of a block (32 MB of 64 dimensions), and the side of a tile of scores.
BLOCK, TILE = 65_536, 2_048
#: Vectors of a block where all pairs over a bound are the result, as a task holds those of a pair of blocks.
PAIR_BLOCK = 16_384


def knn(vectors: DataFrame, id_: str, vec: str, query, k: int) -> DataFrame:
    """(id, score): cosine with the query, best first. Filter before; nothing is filtered after."""
    scored = vectors.select(F.col(id_).alias("id"), vx.cosine(F.col(vec), vx.literal(query)).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def knn_of_row(vectors: DataFrame, id_: str, vec: str, of: int, k: int) -> DataFrame:
    """knn for the vector of one row, itself left out; that row alone is broadcast."""
    query = F.broadcast(vectors.filter(F.col(id_) == of).select(F.col(vec).alias("_q")).limit(1))
    scored = vectors.filter(F.col(id_) != of).crossJoin(query).select(F.col(id_).alias("id"), vx.cosine(F.col(vec), F.col("_q")).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def max_segment_knn(segments: DataFrame, id_: str, vec: str, query, k: int) -> DataFrame:
    """Best cosine over the segment rows of each id."""
    scored = segments.groupBy(F.col(id_).alias("id")).agg(F.max(vx.cosine(F.col(vec), vx.literal(query))).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(k)


def unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of a list column as rows of length one; a vector without length stays zero. Vectors of different length raise."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(whole), -1) if len(whole) and len(flat) else np.zeros((len(whole), 0))
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def grid(queries: DataFrame, points: DataFrame, each, out: str, block: int = BLOCK, same: bool = False) -> DataFrame:
    """each(queries, points) for every block of queries and block of points of one cell; both have id, v and cell.

    A block has about so many rows, whatever the size of its cell, and a pair of blocks is one task's work: rows are copied for each
    block that theirs meets. Numbers of blocks are a row for each cell. With same, both sides are one table, and a pair of blocks
    meets once.
    """
    points = points.select(*[F.col(c).alias(c) for c in ("id", "v", "cell")])  # columns of its own, where both are one table
    size = lambda rows, n: rows.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    blocks = F.broadcast(size(queries, "qn").join(size(points, "pn"), "cell"))
    own = lambda n: F.pmod(F.xxhash64("id", "v"), F.col(n)).cast("int")
    q = queries.join(blocks, "cell").withColumn("qb", own("qn"))
    p = points.join(blocks, "cell").withColumn("pb", own("pn"))
    q = q.select("id", "v", "cell", "qb", F.explode(F.sequence(F.col("qb") if same else F.lit(0), F.col("pn") - 1)).alias("pb"))
    p = p.select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("pb") if same else F.col("qn") - 1)).alias("qb"), "pb")
    return q.groupBy("cell", "qb", "pb").cogroup(p.groupBy("cell", "qb", "pb")).applyInArrow(each, out)


def best_of(k: int):
    """For grid(): query_id, id, score of the k best points of a block for each of its queries, the row of the same id left out."""

    def each(queries: pa.Table, points: pa.Table) -> pa.Table:
        ids, own = queries["id"].to_numpy(), points["id"].to_numpy()
        top, who = np.full((len(ids), k), -2.0), np.full((len(ids), k), -1, np.int64)
        if len(ids) and len(own):
            q, v = unit_rows(queries["v"]), unit_rows(points["v"])
            for lo in range(0, len(ids), TILE):
                t = slice(lo, lo + TILE)
                for at in range(0, len(own), TILE):
                    there = own[at : at + TILE]
                    s = q[t] @ v[at : at + TILE].T
                    s[ids[t, None] == there[None, :]] = -2.0
                    s = np.concatenate([top[t], s], axis=1)
                    w = np.concatenate([who[t], np.broadcast_to(there, (len(s), len(there)))], axis=1)
                    order = np.lexsort((w, -s), axis=1)[:, :k]
                    top[t], who[t] = np.take_along_axis(s, order, 1), np.take_along_axis(w, order, 1)
        keep = top > -1.5
        return pa.table([pa.array(np.repeat(ids, k).reshape(-1, k)[keep]), pa.array(who[keep]), pa.array(top[keep])], ["query_id", "id", "score"])

    return each


BEST = "query_id long, id long, score double"


def ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _points(rows: DataFrame, id_: str, vec: str) -> DataFrame:
    return rows.select(F.col(id_).cast("long").alias("id"), F.col(vec).alias("v"), F.lit(0).alias("cell")).filter("v IS NOT NULL")


def knn_queries(vectors: DataFrame, queries: DataFrame, id_: str, vec: str, k: int, block: int = BLOCK) -> DataFrame:
    """(query_id, id, score, rank): exact top k of every query row against all vectors, by blocks. The row of the same id is left out."""
    return ranked(grid(_points(queries, id_, vec), _points(vectors, id_, vec), best_of(k), BEST, block), k)


def similar_pairs(vectors: DataFrame, id_: str, vec: str, least: float, block: int = PAIR_BLOCK) -> DataFrame:
    """(a, b, cosine) with a < b of all vectors at least so similar, by pairs of blocks."""

    def each(one: pa.Table, other: pa.Table) -> pa.Table:
        ids, own = one["id"].to_numpy(), other["id"].to_numpy()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and len(own):
            within = one["qb"][0].as_py() == one["pb"][0].as_py()  # a block with itself has each pair twice
            q, v = unit_rows(one["v"]), unit_rows(other["v"])
            for lo in range(0, len(ids), TILE):
                for at in range(0, len(own), TILE):
                    s = q[lo : lo + TILE] @ v[at : at + TILE].T
                    x, y = ids[lo : lo + TILE, None], own[None, at : at + TILE]
                    i, j = np.nonzero((s >= least) & ((x < y) if within else (x != y)))
                    x, y = ids[lo + i], own[at + j]
                    found.append((np.minimum(x, y), np.maximum(x, y), s[i, j]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], ["a", "b", "cosine"])

    rows = _points(vectors, id_, vec)
    return grid(rows, rows, each, "a long, b long, cosine double", block, same=True)


def topic_runs(rows: DataFrame, id_: str, vec: str, group: list[str], least: float = 0.7, shortest: int = 2) -> DataFrame:
    """(group, run, first_id, last_id, size): stretches in id order whose neighbours are at least so similar."""
    w = Window.partitionBy(*group).orderBy(id_)
    cut = F.coalesce((vx.cosine(F.col(vec), F.lag(vec).over(w)) < least).cast("int"), F.lit(0))
    runs = rows.withColumn("_cut", cut).withColumn("run", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return runs.groupBy(*group, "run").agg(F.min(id_).alias("first_id"), F.max(id_).alias("last_id"), F.count("*").alias("size")).filter(F.col("size") >= shortest)


def _unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    return v / max(np.linalg.norm(v), 1e-300)


def mmr(pool: DataFrame, by: str, k: int, weight: float = 0.3, per_project: int | None = 2) -> DataFrame:
    """pool(by, id, importance, vec[, project]) -> by, id, pick: greedy importance - weight * closest chosen.

    A pool is cut to its POOL most important rows of a group, and a group is one task's work. Of a project with
    per_project choices already, similarity counts as 0.7 at least.
    """
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("importance"), "id"))
    pool = pool.withColumn("_r", rank).filter(F.col("_r") <= POOL).drop("_r")
    project = "project" in pool.columns

    def pick(key, rows):
        rows = rows.sort_values(["importance", "id"], ascending=[False, True]).reset_index(drop=True)
        vs = np.array([_unit(v) for v in rows["vec"]])
        near = np.zeros(len(rows))
        left, chosen, seen = list(range(len(rows))), [], {}
        while left and len(chosen) < k:
            def gain(i):
                sim = near[i]
                if project and per_project and seen.get(rows["project"][i], 0) >= per_project:
                    sim = max(sim, 0.7)
                return rows["importance"][i] - weight * sim

            best = max(left, key=lambda i: (gain(i), -i))
            chosen.append(best)
            left.remove(best)
            near = np.maximum(near, vs @ vs[best])
            if project:
                seen[rows["project"][best]] = seen.get(rows["project"][best], 0) + 1
        out = rows.iloc[chosen][[by, "id"]].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    return pool.groupBy(by).applyInPandas(pick, f"{by} {pool.schema[by].dataType.simpleString()}, id long, pick int")


def mmr_injection(pool: DataFrame, by: str, k: int, weight: float = 0.5) -> DataFrame:
    """pool(by, id, score, type, level, vec, words) -> by, id, pick: the best by score first, then greedily
    weight * score - (1 - weight) * closest chosen, less 0.1 for each chosen of its type and 0.05 for each of its level.

    Closeness is the cosine, or the shared part of the smaller set of words where a vector is missing. A pool is cut to POOL rows
    of a group by score before it is one task's work; ties go to the smaller id.
    """

    def pick(key, rows):
        rows = rows.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        n = len(rows)
        vs = [None if v is None else _unit(v) for v in rows["vec"]]
        ws = [frozenset(w) if w is not None else frozenset() for w in rows["words"]]
        close = lambda i, j: float(vs[i] @ vs[j]) if vs[i] is not None and vs[j] is not None else len(ws[i] & ws[j]) / min(len(ws[i]), len(ws[j])) if ws[i] and ws[j] else 0.0
        near, less, chosen = np.zeros(n), np.zeros(n), []
        types, levels = rows["type"].to_numpy(object), rows["level"].to_numpy(object)
        left = np.ones(n, bool)
        while left.any() and len(chosen) < k:
            gain = np.where(left, weight * rows["score"].to_numpy() - (1 - weight) * near - less, -np.inf) if chosen and n > k else np.where(left, -np.arange(n), -np.inf)
            best = int(np.argmax(gain))
            chosen.append(best)
            left[best] = False
            near = np.maximum(near, [close(i, best) for i in range(n)])
            less = less + 0.1 * np.array([t is not None and t == types[best] for t in types]) + 0.05 * np.array([x is not None and x == levels[best] for x in levels])
        out = rows.iloc[chosen][[by, "id"]].copy()
        out["pick"] = np.arange(1, len(out) + 1)
        return out

    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "id"))
    bounded = pool.withColumn("_r", rank).filter(F.col("_r") <= POOL).select(by, "id", "score", "type", "level", "vec", "words")
    return bounded.groupBy(by).applyInPandas(pick, f"{by} {pool.schema[by].dataType.simpleString()}, id long, pick int")


def _settle(rows: pa.Table, by: str, least: float) -> pa.Table:
    """One pass in order of id over a bounded table: a row joins the first leader at least so similar, else leads."""
    order = np.argsort(rows["id"].to_numpy(), kind="stable")
    ids, unit = rows["id"].to_numpy()[order], unit_rows(rows["v"])[order]
    leaders, n, out = np.zeros_like(unit), 0, np.zeros(len(ids), np.int64)
    names = np.zeros(len(ids), np.int64)
    for k in range(len(ids)):
        hit = np.flatnonzero(leaders[:n] @ unit[k] >= least)
        if len(hit):
            out[k] = names[hit[0]]
        else:
            leaders[n], names[n], out[k], n = unit[k], ids[k], ids[k], n + 1
    return pa.table({by: rows[by].take(pa.array(order)), "id": ids, "v": rows["v"].take(pa.array(order)), "leader": out})


def leader_clusters(rows: DataFrame, by: str, id_: str, vec: str, least: float = 0.3, shortest: int = 2, scratch: Scratch | None = None, block: int = 4096) -> DataFrame:
    """(by, id, leader): one pass in id order; a row joins the first leader at least so similar, else leads. Ids are unique.

    Rows without a group are one. In rounds: the first rows of each group that are still open, so many at most, are settled among themselves in one task; their
    leaders come before all later ones, so every later row that is like one of them is settled too, by blocks in all tasks. What is
    left goes into the next round. No group meets in one task, and a round costs the rows left times the leaders found.
    """
    scratch = scratch or Scratch(rows.sparkSession, "leaders")
    kind = rows.schema[by].dataType.simpleString()
    left = scratch.keep(rows.select(F.coalesce(F.col(by).cast("string"), F.lit("\x00")).alias("cell"), F.col(id_).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).filter("v IS NOT NULL"))
    done = []

    def first_leader(later: pa.Table, leaders: pa.Table) -> pa.Table:
        ids, names = later["id"].to_numpy(), leaders["id"].to_numpy()
        found = np.full(len(ids), np.iinfo(np.int64).max)
        if len(ids) and len(names):
            q, order = unit_rows(later["v"]), np.argsort(names)
            v, names = unit_rows(leaders["v"])[order], names[order]
            for lo in range(0, len(ids), TILE):
                for at in range(0, len(names), TILE):
                    close = q[lo : lo + TILE] @ v[at : at + TILE].T >= least
                    hit = np.where(close.any(axis=1), names[at + close.argmax(axis=1)], np.iinfo(np.int64).max)
                    found[lo : lo + TILE] = np.minimum(found[lo : lo + TILE], hit)
        met = found < np.iinfo(np.int64).max
        return pa.table([pa.array(ids[met]), pa.array(found[met])], ["id", "leader"])

    while not left.isEmpty():
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("id"))
        head = left.withColumn("_r", rank).filter(F.col("_r") <= block).drop("_r")  # tasks keep so many of a group before the exchange
        settled = scratch.keep(head.groupBy("cell").applyInArrow(lambda t: _settle(t, "cell", least), "cell string, id long, v array<double>, leader long"))
        done.append(settled.select("cell", "id", "leader"))
        cut = settled.groupBy("cell").agg(F.max("id").alias("_last"))
        later = scratch.keep(left.join(cut, "cell").filter("id > _last").select("cell", "id", "v"))
        scratch.drop(left)
        if later.isEmpty():
            break
        joined = scratch.keep(grid(later, settled.filter("id = leader").select("id", "v", "cell"), first_leader, "id long, leader long").groupBy("id").agg(F.min("leader").alias("leader")))
        done.append(later.select("cell", "id").join(joined, "id").select("cell", "id", "leader"))
        left = scratch.keep(later.join(joined, "id", "left_anti"))
    own = F.when(F.col("cell") != "\x00", F.col("cell")).cast(kind).alias(by)
    if not done:
        return left.select(own, "id", F.col("id").alias("leader"))
    every = done[0]
    for d in done[1:]:
        every = every.unionByName(d)
    every = scratch.keep(every)
    large = every.groupBy("leader").agg(F.count("*").alias("n")).filter(F.col("n") >= shortest).select("leader")
    return every.join(large, "leader", "left_semi").select(own, "id", "leader")
