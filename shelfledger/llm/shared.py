"""Helpers shared by the training-data operators: the text column, words as columns, checkpointed cuts of the lineage."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.session import shared_folder

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
GAP_CHARS = " \t\n\x0b\x0c\r"


def text_of(column: str = "text") -> Column:
    """The text; NULL counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but blanks (``WORD_GAP``), in order; no word gives an empty array."""
    trimmed = F.btrim(text, F.lit(GAP_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the folder all executors share, so that later passes neither recompute nor lose it.

    Nothing reads the shuffle files of that job again; Spark removes them when it ends, not when the driver next collects garbage.
    """
    spark: SparkSession = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint()  # the setting is read when a plan is made
    finally:
        spark.conf.set(FILE_CLEANUP, before)


def hash_sample(df: DataFrame, row_id: str, about: int) -> DataFrame:
    """About ``about`` rows (all, if fewer): those whose id hash lies in the share of its range that gives so many.

    Nothing is sorted or shuffled for it, and the choice is the same in every run.
    """
    total = df.count()
    if total <= about:
        return df
    return df.filter(F.xxhash64(row_id) < F.lit(int((about / total - 0.5) * 2 ** 64)))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many more underscores in front as it takes to meet no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sheltering(*helpers: str) -> Callable:
    """Makes an operator give back columns of the caller's that have the names of its helper columns: they are renamed meanwhile."""
    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def work(docs: DataFrame, *args, **options) -> DataFrame:
            away = {c: free_name(docs, f"_own{c}") for c in docs.columns if c.lower() in helpers}
            return operator(docs.withColumnsRenamed(away), *args, **options).withColumnsRenamed({v: k for k, v in away.items()})
        return work
    return wrap
