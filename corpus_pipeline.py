"""The corpus pipeline: quality rules, near-dedup, substring dedup, redaction, packing.

Each stage takes all documents that the one before kept and returns the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.llm import near_copies, pii_boost, quality_lines, rlz_dedup
from shelfledger.llm.queries import packed
from shelfledger.llm.shared import cut

ORACLE_SQL = None  # fingerprints, groups and packing are outside SQL; tests hold run() against a brute-force version


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    return quality_lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies: SimHash links and wider ones, five-word shingles at 0.8 or more."""
    return near_copies.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that a document of smaller id has."""
    names = docs.columns
    parted = rlz_dedup.dedup(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    if "n_chars" in names:
        parted = parted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return parted.select(names)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii_boost.redact(docs, pii_boost.train(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their place in packed sequences."""
    return packed(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("redaction", redaction), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written once to the shared folder, so that no stage runs twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
