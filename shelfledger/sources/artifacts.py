"""Per-chain JSON results beside their run summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from shelfledger.functions import calendar as cal
from shelfledger.schemas import SUMMARY

FOLDER = r"([^/]+)/{}(?:/[^/]+)?$"  # the name is a file, or a folder of part files


def scan_folder(spark: SparkSession, root: str, name: str, schema: PT.StructType) -> DataFrame:
    """``root/<slug>/<name>`` files (or folders of files) of all chains with their folder as ``slug``."""
    files = spark.read.schema(schema).option("multiLine", name != "rows.jsonl").json(f"{root}/*/{name}")
    return files.withColumn("slug", F.regexp_extract(F.col("_metadata.file_path"), FOLDER.format(name.replace(".", "[.]")), 1))


def usable_summaries(summaries: DataFrame) -> DataFrame:
    """Summaries of finished price runs; others contribute nothing."""
    return summaries.filter((F.col("stage") == "prices") & F.col("status").isin("ok", "degraded"))


def attach_run(rows: DataFrame, summaries: DataFrame, key: str = "slug") -> DataFrame:
    """Rows of usable runs; their own time, else the run's, gives the business day and week."""
    runs = usable_summaries(summaries).select(key, F.col("finished_at").alias("_finished"))
    joined = rows.join(runs, key).withColumn("observed_at", F.coalesce("observed_at", "_finished"))
    day = cal.business_date(F.col("observed_at"))
    return joined.withColumn("business_date", day).withColumn(
        "week_start", cal.monday(F.col("business_date"))).drop("_finished")


def read_results(spark: SparkSession, root: str, rows_schema: PT.StructType, name: str = "prices.json") -> DataFrame:
    summary = PT.StructType([*SUMMARY.fields, PT.StructField("finished_at", PT.StringType())])
    heads = scan_folder(spark, root, "summary.json", summary)
    heads = heads.withColumn("finished_at", cal.utc_instant(F.col("finished_at")))
    rows = scan_folder(spark, root, name, rows_schema)
    return attach_run(rows.withColumn("observed_at", cal.utc_instant(F.col("observed_at"))), heads)
