"""Newest complete run or catalog, read through its header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.operators.audit import count_if
from shelfledger.operators.latest import first_per_key


def newest_headers(headers: DataFrame, groups: Sequence[str]) -> DataFrame:
    return first_per_key(headers, groups, [F.col("completed_at").desc(), F.col("run_id").desc()])


def measured(headers: DataFrame, rows: DataFrame, **counts: Column) -> DataFrame:
    """Headers with counts of their rows.  Rows are counted map-side before the join, so a run that holds a third of
    all rows costs one record per task."""
    per_run = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("found"), *(c.alias(n) for n, c in counts.items()))
    return headers.join(per_run, "run_id", "left").na.fill(0, ["found", *counts])


def complete_runs(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """Headers whose rows are all present; a half-written run stays invisible."""
    return measured(headers, rows).withColumn("complete", F.col("found") == F.col("product_count"))


def latest_run_rows(headers: DataFrame, rows: DataFrame, groups: Sequence[str] = ("year", "week")) -> DataFrame:
    """Rows of the newest run per group, only when that run is complete.

    One small header per run is joined to the rows; a hot run is split by the adaptive skew join.
    """
    newest = complete_runs(newest_headers(headers, groups), rows).filter("complete")
    return rows.join(newest.drop("found", "complete"), "run_id")


def latest_catalog(headers: DataFrame, rows: DataFrame, now: Column, max_age_days: int = V.CATALOG_MAX_AGE_DAYS
                   ) -> DataFrame:
    """Newest catalog header per chain with its verdict: accepted, stale, future, incomplete or without ready links."""
    newest = measured(newest_headers(headers, ["chain"]), rows, ready=count_if(F.col("status") == "ready"))
    age = F.col("completed_at")
    verdict = (F.when(age > now + F.expr(f"INTERVAL '{V.FUTURE_TOLERANCE_MINUTES}' MINUTE"), "future")
               .when(age < now - F.expr(f"INTERVAL '{max_age_days}' DAY"), "stale")
               .when(F.col("found") != F.col("candidate_count"), "incomplete")
               .when((F.col("ready") == 0) | (F.col("ready") != F.col("ready_count")), "no_ready")
               .otherwise("accepted"))
    return newest.withColumn("verdict", verdict)


def catalog_rows(headers: DataFrame, rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(ready, review) rows of accepted catalogs, found through one header per chain."""
    accepted = latest_catalog(headers, rows, now).filter("verdict = 'accepted'").select("run_id")
    mine = rows.join(accepted, "run_id", "left_semi")
    return mine.filter("status = 'ready'"), mine.filter("status <> 'ready'")
