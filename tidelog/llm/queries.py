"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, backoff, bpe, fixity, minhash, packing, passages, secret_scan, toxicity, vector_dedup


def vocab_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path())


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.9)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, in two increments: what the second has in common with the first is found in the ledger."""
    versions = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("path"), "text")
    later = F.coalesce(F.pmod(F.xxhash64("path"), F.lit(2)) == 1, F.lit(False))
    found, _ = secret_scan.scan_increments([versions.where(~later), versions.where(later)])
    return secret_scan.digest(found)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocab_path())


def op6_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return fixity.audit(pages, fixity.damaged(pages))


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=80)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes, and besides what passages of over 50 words, often shorter, repeat."""
    return passages.digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_bpe": op4_bpe,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_fixity": op6_fixity,
    "op7_backoff": op7_backoff,
    "op8_toxicity": op8_toxicity,
    "op9_minhash": op9_minhash,
    "op10_suffix_dedup": op10_suffix_dedup,
}
ORACLE: dict[str, str] = {
    "op6_fixity": fixity.SQL,
    "op7_backoff": backoff.SQL,
}
