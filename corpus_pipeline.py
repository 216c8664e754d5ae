"""A training-corpus pipeline in five stages, each an operator of tidelog.llm applied to all that the one before kept.

Toxic documents go; of every group of near-duplicates one document stays; passages that repeat across documents go;
secrets are masked; what is left is packed into training windows. All stages but the last return the columns of
documents; n_chars is brought up to date where texts change. Stages are written as Parquet and read again in between.

Edge cases, of every stage: a null text counts as an empty one and stays null where it is not changed; rows with a null
id are kept (no label is theirs, they are near-duplicates of nothing), save those that are toxic; repeated rows are
treated alike, and near-duplicates keep one row of equal id and text; ties go to the smaller id; an empty table gives an
empty one; texts of any length are taken whole; columns other than those of documents, whatever their names, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import minhash, packing, passages, queries, secret_scan, suffix_dedup, toxicity
from tidelog.llm.base import lean, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more; the classifier is fitted on labelled documents of this input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.scorer(spark, toxicity.train(docs, labels))
    return docs.select(*COLUMNS).where(score(F.col("text")) < 0.7)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of every class of five-word shingle similarity 0.8; a row of equal id and text is kept once.

    Rows of one id are one document, with all their texts: it stays or goes whole.
    """
    gone = minhash.classes(docs, k=5, percent=80).where("not kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(once)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of over 50 words, and 400-byte strings, that occur more than once; documents left empty go.

    A cut inside a multi-byte character keeps the whole character. Documents that were empty before stay as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, own in zip(b.column(1), b.column(2)):
                raw, gone = text.as_py().encode(), suffix_dedup.merged(own.as_py())
                at, parts = 0, []
                for lo, hi in gone:
                    while lo > 0 and lo < len(raw) and raw[lo] & 0xC0 == 0x80:
                        lo += 1
                    while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                        hi -= 1
                    if hi > lo:
                        parts.append(raw[at:lo])
                        at = hi
                texts.append(b"".join([*parts, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), *[b.column(i) for i in range(3, 6)]], COLUMNS)

    keep = ["lang", "source", "n_chars"]
    types = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    docs = docs.select(*COLUMNS, F.col("text").isNull().alias("none"))
    spans = passages.with_ranges(docs, [*keep, "none"]).select("doc_id", "text", "spans", "_0", "_1", "_2", "_3")
    text = F.when(~F.col("_3"), F.col("text")).alias("text")
    same = spans.where("spans is null").select("doc_id", text, *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)])
    cut = spans.where("spans is not null").drop("_3").mapInArrow(lean(run), f"doc_id long, text string, {types}").where("text <> ''")
    return same.unionByName(cut.withColumn("n_chars", F.length("text").cast("long"))).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; all documents stay."""
    named = secret_scan.address(docs.select(F.col("doc_id").alias("path"), "text"))
    spans, _ = secret_scan.scan(named.select("blob", "text"))
    blob = secret_scan.blob_id(F.col("text"))
    out = docs.select(*COLUMNS).withColumn("blob", blob).join(spans, "blob", "left")
    masked = F.when(F.col("found").isNotNull(), secret_scan.redact(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    out = out.withColumn("masked", masked)
    return out.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.when(F.col("found").isNotNull(), F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2048 tokens; one row per piece, with its ids."""
    return packing.pack_documents(docs, queries.vocab_path(), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: A learned classifier and the packing plan are not expressible in SQL; tests/llm/test_pipeline.py tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
