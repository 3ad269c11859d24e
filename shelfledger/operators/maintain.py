"""History and movements kept up to date by change sets.

A batch of observations touches some (series, day) pairs.  Only the partitions of those days are merged again; the day movements that can
change are those of the touched days and the days after them, the week movements those of their weeks and the weeks after; nothing
else is read or written.  The newest record of a day is chosen by instant, then by number, so batches may come in any order and more than once.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfledger.functions import calendar as cal
from shelfledger.operators import movement as M
from shelfledger.operators.history import FULL_SERIES
from shelfledger.operators.latest import first_per_key
from shelfledger.sinks.tables import read_or_empty, write_parts

DAILY = "chain string, sku string, model string, storage string, display_variant string, color string, promo_price bigint, observed_at timestamp_ntz, seq bigint, business_date date"
MOVES = ("chain string, sku string, model string, storage string, display_variant string, color string, before_price bigint, after_price bigint, delta bigint, "
         "percent double, shock boolean")
DAY = dt.timedelta(days=1)


def monday(day: dt.date) -> dt.date:
    return day - day.weekday() * DAY


def days_of_weeks(weeks: Iterable[dt.date]) -> set[dt.date]:
    return {week + i * DAY for week in weeks for i in range(7)}


@dataclass(frozen=True)
class Maintained:
    """Tables under ``path``: ``daily`` (the newest record per series and day), ``days`` and ``weeks`` (movements)."""

    path: str

    def _rows(self, spark: SparkSession, days: Iterable[dt.date]) -> DataFrame:
        """Daily rows of the given days; only their partitions are read."""
        schema = StructType.fromDDL(DAILY)
        return read_or_empty(spark, f"{self.path}/daily", schema).filter(F.col("business_date").isin(sorted(days))).select(schema.names)

    def _publish(self, moves: DataFrame, table: str, period: str, judged: Iterable[dt.date]) -> None:
        """Replace the partitions of the judged periods.  A row without a series marks each of them, so one that lost its last movement is replaced too."""
        spark = moves.sparkSession
        columns = [n for n in StructType.fromDDL(MOVES).names]
        marks = spark.createDataFrame([(day,) for day in sorted(judged)], f"{period} date").select(*[F.lit(None).alias(c) for c in columns], period)
        write_parts(moves.select(*columns, period).unionByName(marks), f"{self.path}/{table}", period)

    def apply(self, batch: DataFrame) -> None:
        """Merge a batch of observations and judge again what it can change.  A repeated batch changes nothing."""
        spark = batch.sparkSession
        keys = [*FULL_SERIES, "business_date"]
        newest = lambda df: first_per_key(df, keys, [F.col("observed_at").desc_nulls_last(), F.col("seq").asc()])
        new = newest(batch.select(*StructType.fromDDL(DAILY).names))
        touched = {r.business_date for r in new.select("business_date").distinct().collect()} - {None}  # at most one row a day
        if not touched:
            return
        write_parts(newest(self._rows(spark, touched).unionByName(new.filter("business_date IS NOT NULL"))), f"{self.path}/daily", "business_date")

        judged = touched | {day + DAY for day in touched}
        moves = M.day_movements(self._rows(spark, judged | {day - DAY for day in touched}))
        self._publish(moves.filter(F.col("business_date").isin(sorted(judged))), "days", "business_date", judged)

        weeks = {monday(day) for day in touched}
        judged = weeks | {week + 7 * DAY for week in weeks}
        rows = self._rows(spark, days_of_weeks(judged | {week - 7 * DAY for week in weeks})).withColumn("week_start", cal.monday(F.col("business_date")))
        self._publish(M.week_movements(rows).filter(F.col("week_start").isin(sorted(judged))), "weeks", "week_start", judged)

    def history(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/daily", StructType.fromDDL(DAILY))

    def day_movements(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/days", StructType.fromDDL(MOVES + ", business_date date")).filter("delta IS NOT NULL")

    def week_movements(self, spark: SparkSession) -> DataFrame:
        return read_or_empty(spark, f"{self.path}/weeks", StructType.fromDDL(MOVES + ", week_start date")).filter("delta IS NOT NULL")
