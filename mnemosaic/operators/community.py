"""Communities by modularity: local moves in alternating classes of nodes, then contraction, level by level (Louvain's method).

Nodes of one class move together, each to the neighbouring community of largest gain; the classes are drawn anew each round by a
hash, so that no two nodes keep following each other. A round that doesn't raise the modularity is taken back, and the next one has
twice as many classes, hence fewer moves at once; PATIENCE such rounds on end finish the level.
Everything is joins and sums over edges: neither a node's edges nor a community's members meet in one task. Each half round is
written to the shared folder, which cuts the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch

#: Classes of a round at first, and rounds without gain that end a level. A gain below LEAST is none.
CLASSES, PATIENCE, LEAST = 2, 3, 1e-9


def weighted(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """(src, dst, w) in both directions, each pair once with its summed weight; a loop counts once, with twice its weight."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    whole = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    one = whole.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    back = one.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.withColumn("w", F.when(F.col("src") == F.col("dst"), 2 * F.col("w")).otherwise(F.col("w"))).unionByName(back)


def _modularity(both: DataFrame, labels: DataFrame, total: float) -> float:
    a, b = (labels.select(F.col("id").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    joined = both.join(a, "src").join(b, "dst")
    inside = joined.agg(F.coalesce(F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("w"))), F.lit(0.0))).first()[0]
    tot = labels.groupBy("community").agg(F.sum("k").alias("t"))
    return inside / total - tot.agg(F.coalesce(F.sum((F.col("t") / total) ** 2), F.lit(0.0))).first()[0]


def modularity(edges: DataFrame, labels: DataFrame, weight: str | None = None) -> float:
    """Of labels(id, community) of all nodes of undirected edges(src, dst)."""
    both = weighted(edges, weight)
    total = both.agg(F.sum("w")).first()[0]
    k = both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k"))
    return _modularity(both, labels.select("id", "community").join(k, "id"), total) if total else 0.0


def _half_round(both: DataFrame, labels: DataFrame, total: float, mine) -> DataFrame:
    """labels(id, community, k, moved) after the nodes of a class have moved. Ties of gain go to the smaller community; a node stays unless it gains."""
    near = labels.select(F.col("id").alias("dst"), F.col("community").alias("to"))
    ties = both.filter("src <> dst").filter(mine(F.col("src"))).join(near, "dst").groupBy(F.col("src").alias("id"), "to").agg(F.sum("w").alias("w"))
    own = labels.filter(mine(F.col("id"))).select("id", "community", "k")
    # a node that has no tie into its own community may stay there too
    options = ties.unionByName(own.select("id", F.col("community").alias("to"), F.lit(0.0).alias("w"))).groupBy("id", "to").agg(F.sum("w").alias("w"))
    sums = labels.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("t"))
    here = F.col("to") == F.col("community")
    rest = F.when(here, F.col("t") - F.col("k")).otherwise(F.col("t"))
    gain = F.col("w") - F.col("k") * rest / total
    scored = options.join(own, "id").join(sums, "to").select("id", "to", here.alias("here"), F.round(gain, 9).alias("gain"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("gain")).alias("g"), "to")).alias("b"), F.max(F.when(F.col("here"), F.col("gain"))).alias("stay"))
    moved = best.filter(-F.col("b.g") > F.col("stay") + LEAST).select("id", F.col("b.to").alias("to"))
    return labels.join(moved, "id", "left").select("id", F.coalesce("to", "community").alias("community"), "k", (F.col("moved") | F.col("to").isNotNull()).alias("moved"))


def _level(both: DataFrame, scratch: Scratch, total: float, rounds: int, seed: int) -> tuple[DataFrame, float, bool]:
    """(labels, modularity, whether any node moved) of one level."""
    labels = scratch.keep(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).select("id", F.col("id").alias("community"), "k", F.lit(False).alias("moved")))
    q, moved, failed = _modularity(both, labels, total), False, 0
    for r in range(rounds):
        new, classes = labels.withColumn("moved", F.lit(False)), CLASSES << failed
        first = new
        for c in range(classes):
            mine = lambda x, r=r, c=c, n=classes: F.pmod(F.xxhash64(x, F.lit(seed + r)), F.lit(n)) == c
            last, new = new, scratch.keep(_half_round(both, new, total, mine))
            if last is not first:
                scratch.drop(last)
        if new.filter("moved").isEmpty():  # no node gains by itself
            scratch.drop(new)
            break
        now = _modularity(both, new, total)
        if now <= q + LEAST:
            scratch.drop(new)
            failed += 1
            if failed == PATIENCE:
                break
            continue
        scratch.drop(labels)
        labels, q, moved, failed = new, now, True, 0
    return labels, q, moved


def louvain(edges: DataFrame, scratch: Scratch, weight: str | None = None, levels: int = 10, rounds: int = 20, seed: int = 1) -> DataFrame:
    """(id, community) of every node of undirected edges(src, dst): the community is named after one of its nodes.

    Loops and repeated edges count by their weight; edges with a null end are left out. Levels and rounds end by themselves when the
    modularity no longer rises; the numbers only bound them.
    """
    both = scratch.keep(weighted(edges, weight))
    total = both.agg(F.sum("w")).first()[0]
    if not total:
        return both.select(F.col("src").alias("id"), F.col("src").alias("community"))
    found = None
    for level in range(levels):
        labels, _, moved = _level(both, scratch, total, rounds, seed + 100 * level)
        if found is None:
            found = scratch.keep(labels.select("id", "community"))
        elif moved:
            step = labels.select(F.col("id").alias("community"), F.col("community").alias("up"))
            last, found = found, scratch.keep(found.join(step, "community").select("id", F.col("up").alias("community")))
            scratch.drop(last)
        if not moved:
            break
        a, b = (labels.select(F.col("id").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
        # the sum over both directions gives a contracted community its inner weight twice, as a loop has it
        last, both = both, scratch.keep(both.join(a, "src").join(b, "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w")))
        scratch.drop(last, labels)
    return found
