"""Indexes that the registered queries keep: each is built once for an application and a folder of tables, in the shared folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.annindex import VectorIndex
from ..operators.inverted import InvertedIndex
from ..sources import nodes as src
from ..sources.shared import application_dir

_KEPT: dict[tuple[str, str, str], object] = {}


def _once(spark: SparkSession, name: str, sf: str, kind, build: Callable) -> object:
    key = (spark.sparkContext.applicationId, name, sf)
    if key not in _KEPT or not _KEPT[key].segments.state()["live"]:  # the shared folder may have been emptied
        index = kind(spark, f"{application_dir(spark)}/kept/{name}-{hashlib.sha256(sf.encode()).hexdigest()[:12]}")
        build(index)
        _KEPT[key] = index
    return _KEPT[key]


def texts(spark: SparkSession, sf: str) -> InvertedIndex:
    return _once(spark, "texts", sf, InvertedIndex, lambda i: i.insert(src.table(spark, sf, "documents"), "doc_id", F.col("text")))


def scoped_texts(spark: SparkSession, sf: str) -> InvertedIndex:
    return _once(spark, "scoped", sf, InvertedIndex, lambda i: i.insert(src.nodes(src.table(spark, sf, "documents")), "id", F.col("content"), "scope"))


def changed_texts(spark: SparkSession, sf: str) -> InvertedIndex:
    """All documents, then a seventh deleted, a fifth changed, and a third of those deleted put back."""
    docs = src.table(spark, sf, "documents")

    def build(index: InvertedIndex) -> None:
        index.insert(docs, "doc_id", F.col("text"))
        index.delete(docs.filter("doc_id % 7 = 0"), "doc_id")
        index.update(docs.filter("doc_id % 5 = 0 AND doc_id % 7 <> 0").withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" the data of data"))), "doc_id", F.col("text"))
        index.insert(docs.filter("doc_id % 21 = 0"), "doc_id", F.col("text"))

    return _once(spark, "changed", sf, InvertedIndex, build)


def merged_texts(spark: SparkSession, sf: str) -> InvertedIndex:
    docs = src.table(spark, sf, "documents")

    def build(index: InvertedIndex) -> None:
        index.insert(docs.filter("doc_id % 2 = 0"), "doc_id", F.col("text"))
        index.insert(docs.filter("doc_id % 2 <> 0"), "doc_id", F.col("text"))
        index.delete(docs.filter("doc_id % 7 = 0"), "doc_id")
        index.merge()

    return _once(spark, "merged", sf, InvertedIndex, build)


def vectors(spark: SparkSession, sf: str) -> VectorIndex:
    return _once(spark, "vectors", sf, VectorIndex, lambda i: i.build(src.table(spark, sf, "embeddings"), "vec_id", "embedding"))
