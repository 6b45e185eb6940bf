"""Cleaning pipeline: quality, exact dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns
of documents; the last returns token counts and digests of ids and of the decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mnemosaic.llm import bpe, decontam, dedup, neardup, quality
from mnemosaic.llm.common import Scratch, owned, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more stay. Null and empty texts score like any other (all features zero); repeated rows go or stay together."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without blanks the longest stays, then the smallest doc_id. Null counts as empty: one such row stays."""
    return dedup.drop_exact_duplicates(docs, Scratch(spark, "exact"))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles of similarity 0.8 or more the smallest doc_id stays. Null and empty texts stay."""
    return neardup.keep_one_of_each_group(docs, Scratch(spark, "near"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, edited or not, go. Null and empty texts stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: doc_id, number of tokens, digests of ids and of the decoded text. Null texts have no tokens."""
    return bpe.encode_decode(docs).select("doc_id", *bpe.digest_columns())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The learned scores, fingerprints, alignments and tokens are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has left there goes once its rows are written."""
    scratch, docs, before = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        with owned() as own:
            docs = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return docs
        docs = scratch.keep(docs)
        for made in own:
            made.drop_but()
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
