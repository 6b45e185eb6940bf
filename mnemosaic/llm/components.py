"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is grouped minima (combined map-side) and one join whose both sides are read from
written tables, so a node with a third of all edges is split by adaptive execution. Nothing but
two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(u, v) -> (node, component): the smallest node reachable, for nodes that have an edge.

    Self-loops and nulls are ignored; an empty table gives an empty one.
    """
    spark = scratch.spark
    current = scratch.keep(
        edges.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    before = _signature(current)
    while before[0]:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.keep(
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        scratch.drop(current)
        scratch.drop(least)
        # small star: every u points at its smallest lower neighbour, and so do its other neighbours
        least = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = scratch.keep(
            large.join(least, "u")
            .filter("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        scratch.drop(large)
        scratch.drop(least)
        current = small
        after = _signature(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).distinct() if before[0] else spark.createDataFrame([], roots.schema)
