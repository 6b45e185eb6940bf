"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontam, dedup, html, licenses, pii, quality, secrets, sharding, simhash, vectors, warc
from .common import Scratch, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(table(spark, sf_dir, "documents")).select("doc_id", *secrets.digest_columns())


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"), Scratch(spark, "op2")).drop("row")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"), Scratch(spark, "op3"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"), Scratch(spark, "op4"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.surrogates(table(spark, sf_dir, "documents"), key="production-key-from-the-caller")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", "text", *counts)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alone on its executors, it remembers more than the pipeline's stage."""
    return bpe.encode_decode(table(spark, sf_dir, "documents"), remembered=300_000).select("doc_id", *bpe.digest_columns())


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), Scratch(spark, "op7"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows are scattered and shuffled, as write_shards() has them written."""
    placed = sharding.shuffled_shards(sharding.with_sizes(table(spark, sf_dir, "documents")), Scratch(spark, "op8"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that leak items, a row for each item. Clean documents have no row."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damage_report(table(spark, sf_dir, "conversations"), Scratch(spark, "op11"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"), Scratch(spark, "op12"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.code_report(table(spark, sf_dir, "embeddings"), Scratch(spark, "op13"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_html_extraction": op4_html_extraction,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_bpe": op6_bpe,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_warc": op12_warc,
    "op13_vector_codes": op13_vector_codes,
}

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

SQL = {"op2_exact_dedup": OP2_SQL, "op3_license_scan": licenses.oracle(), "op12_warc": warc.ORACLE, "op13_vector_codes": vectors.oracle()}
