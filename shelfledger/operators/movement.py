"""Price and promotion changes between periods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfledger import fixed_values as V
from shelfledger.functions.text import fold, matches
from shelfledger.operators.history import FULL_SERIES, SERIES, last_per_day, newest_order
from shelfledger.operators.latest import latest_per_key


def compare_runs(current: DataFrame, previous: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Current rows beside their baseline.  A row without one is unmatched, never a drop.

    Both sides hold one row per key, so no key can be hot in this join.
    """
    before = previous.select(*keys, F.col("promo_price").alias("before_price"), F.col("promo_text").alias("before_text"),
                             F.lit(True).alias("matched"))
    return current.join(before, list(keys), "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def shifted_week(df: DataFrame, days: int = 7) -> DataFrame:
    return df.withColumn("week_start", F.date_add("week_start", days))


def large(delta: Column, before: Column) -> Column:
    """More than 3 percent or more than 500,000, in whole numbers so that exactly 3 percent is not large."""
    return (F.abs(delta) * 100 > before * V.SHOCK_PERCENT) | (F.abs(delta) > V.SHOCK_AMOUNT)


def price_drops(pairs: DataFrame) -> DataFrame:
    delta = F.col("before_price") - F.col("promo_price")
    return (pairs.withColumn("delta", delta).filter((F.col("delta") > 0) & large(F.col("delta"), F.col("before_price")))
            .withColumn("percent", F.col("delta") * 100 / F.col("before_price")))


def promo_changes(pairs: DataFrame, hot: str = V.HOT_PROMO) -> DataFrame:
    text = F.col("promo_text")
    return pairs.filter(F.col("matched") & (text != "") & (fold(text) != fold(F.col("before_text"))) & matches(text, hot))


def moved() -> Column:
    both = (F.col("before_price") > 0) & (F.col("after_price") > 0)
    return F.coalesce(both & (F.col("after_price") != F.col("before_price")), F.lit(False))


def judged_movements(df: DataFrame) -> DataFrame:
    """All pairs, those that are no movement without price before, delta, percent and shock mark."""
    before = F.when(moved(), F.col("before_price"))
    delta = F.col("after_price") - before
    return df.withColumns({"delta": delta, "percent": delta / before * 100, "shock": large(delta, before), "before_price": before})


def movement_columns(df: DataFrame) -> DataFrame:
    """Pairs of positive prices that differ, with delta, percent and shock mark."""
    delta = F.col("after_price") - F.col("before_price")
    return (df.filter(moved()).withColumn("delta", delta)
            .withColumn("percent", F.col("delta") / F.col("before_price") * 100)
            .withColumn("shock", large(F.col("delta"), F.col("before_price"))))


def _previous_period(df: DataFrame, keys: Sequence[str], period: str, days: int) -> DataFrame:
    """Price of exactly the previous period.  Input is one row per (series, period), so a window holds only periods."""
    order = Window.partitionBy(*keys).orderBy(period)
    adjacent = F.datediff(F.col(period), F.lag(period).over(order)) == days
    return df.withColumn("before_price", F.when(adjacent, F.lag("promo_price").over(order)))


def day_movements(history: DataFrame, keys: Sequence[str] = FULL_SERIES) -> DataFrame:
    """Changes against exactly the previous business day; gaps, missing prices and other colors give nothing."""
    daily = (history.groupBy(*keys, "business_date")
             .agg(F.max_by("promo_price", newest_order()).alias("promo_price")))
    return movement_columns(_previous_period(daily, keys, "business_date", 1)
                            .withColumnRenamed("promo_price", "after_price"))


def week_movements(history: DataFrame, keys: Sequence[str] = FULL_SERIES) -> DataFrame:
    """Last actual record of the previous week against that of this week; a status-only record is the last record."""
    weekly = (history.groupBy(*keys, "week_start")
              .agg(F.max_by("promo_price", newest_order()).alias("promo_price")))
    return movement_columns(_previous_period(weekly, keys, "week_start", 7)
                            .withColumnRenamed("promo_price", "after_price"))


def day_view(history: DataFrame) -> DataFrame:
    """Last record of every day and its change against exactly the day before, NULL if either has no price."""
    daily = last_per_day(history).select(*SERIES, "business_date", "promo_price")
    return (_previous_period(daily, SERIES, "business_date", 1)
            .withColumn("change", F.col("promo_price") - F.col("before_price")))


def hide_models(df: DataFrame, hidden: DataFrame) -> DataFrame:
    """Drop rows of hidden (category, model) pairs after folding; rows without a model are kept.

    The hidden list is kept by hand; Spark decides from its size whether it is broadcast.
    """
    keys = hidden.select(fold(F.col("category")).alias("_category"), fold(F.col("model")).alias("_model")).distinct()
    return (df.withColumn("_category", fold(F.col("category"))).withColumn("_model", fold(F.col("model")))
            .join(keys, ["_category", "_model"], "left_anti").drop("_category", "_model"))


def report_scope(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows of the SKUs a run lists for its report."""
    return df.join(listed.select(*SERIES), SERIES, "left_semi")


def fresh_only(df: DataFrame) -> DataFrame:
    return df.filter(F.col("stale_since").isNull())


def top_drops(drops: DataFrame, n: int = 10) -> DataFrame:
    return drops.orderBy(F.desc("percent"), F.desc("delta"), "chain", "sku").limit(n)


def top_movements(moves: DataFrame, *ties: str, n: int = 20) -> DataFrame:
    return moves.orderBy(F.abs("delta").desc(), *ties).limit(n)


def weekly_latest(df: DataFrame) -> DataFrame:
    return latest_per_key(df, ["week_start", *SERIES])
