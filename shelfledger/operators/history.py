"""Per-day history: as-of rows, day grids, week changes, merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfledger.functions import calendar as cal
from shelfledger.operators.latest import first_per_key, latest_per_key

SERIES = ["chain", "sku"]
FULL_SERIES = ["chain", "sku", "model", "storage", "display_variant", "color"]


def newest_order() -> Column:
    """Aggregation order of "latest, first seen on ties" as one number, so that buffers stay fixed-width and are hashed."""
    instant = F.coalesce(F.unix_micros(F.col("observed_at").cast("timestamp")), F.lit(-(10 ** 17))).cast("decimal(18,0)")
    return instant * F.expr("10000000000000000000BD") - F.col("seq").cast("decimal(19,0)")


def date_range(df: DataFrame, start: str, days: int = 7, day: str = "business_date") -> DataFrame:
    """Rows of ``days`` business days from ``start``; a plain range so that partitions and row groups are pruned."""
    first = F.lit(start).cast("date")
    return df.filter(F.col(day).between(first, F.date_add(first, days - 1)))


def visible(history: DataFrame, published: DataFrame) -> DataFrame:
    """History rows whose (chain, sku, day) was published."""
    keys = [*SERIES, "business_date"]
    return history.join(published.select(*keys), keys, "left_semi")


def as_of(df: DataFrame, day: str) -> DataFrame:
    """Latest record per series up to a business day; status-only records count, the future does not."""
    return latest_per_key(df.filter(F.col("business_date") <= F.lit(day).cast("date")), SERIES)


def last_per_day(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    return latest_per_key(df, [*keys, "business_date"])


def week_cells(df: DataFrame, cell: Sequence[str]) -> DataFrame:
    """One row per (week, chain, sku) with ``days``: seven structs, NULL where nothing was observed.

    Fixed-width cells take one hash aggregation with map-side combine.  Wide ones (texts) are first reduced to the last
    record of each day, ranked and limited before the shuffle; at most seven of them meet in a list.
    """
    weekday = F.weekday("business_date")
    if all(isinstance(df.schema[c].dataType, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) for c in cell):
        picks = []
        for i in range(7):
            order = F.when(weekday == i, newest_order())
            picks += [F.max(order).alias(f"seen{i}"), *(F.max_by(c, order).alias(f"{c}{i}") for c in cell)]
        grid = df.groupBy("week_start", *SERIES).agg(*picks)
        days = [F.when(F.col(f"seen{i}").isNotNull(), F.struct(*(F.col(f"{c}{i}").alias(c) for c in cell))) for i in range(7)]
        return grid.select("week_start", *SERIES, F.array(*days).alias("days"))
    last = last_per_day(df).withColumn("_cell", F.struct(*cell))
    grid = last.groupBy("week_start", *SERIES).agg(F.collect_list(F.struct(weekday.alias("w"), "_cell")).alias("_seen"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.get(F.filter("_seen", lambda d: d["w"] == i), F.lit(0))["_cell"])
    return grid.select("week_start", *SERIES, days.alias("days"))


def day_grid(df: DataFrame) -> DataFrame:
    """Seven price columns Monday to Sunday; a missing day stays NULL."""
    cells = week_cells(df, ["promo_price"])
    return cells.select("week_start", *SERIES,
                        *(F.get("days", F.lit(i))["promo_price"].alias(f"day{i + 1}") for i in range(7)))


def require_monday(start: str) -> None:
    from datetime import date
    if date.fromisoformat(start).weekday() != 0:
        raise ValueError("a week starts on Monday")


def week_change(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Last observed day of the week and last minus first observed price; NULL below two days or at a missing end."""
    cells = week_cells(df, ["business_date", "promo_price", *extra])
    seen = F.filter("days", lambda d: d.isNotNull())
    rows = cells.select("week_start", *SERIES, F.size(seen).alias("observed_days"), F.get(seen, F.lit(0)).alias("first"),
                        F.element_at(seen, -1).alias("last"))
    change = F.when(F.col("observed_days") >= 2, F.col("last.promo_price") - F.col("first.promo_price"))
    return rows.select("week_start", *SERIES, "observed_days", F.col("last.business_date").alias("last_day"),
                       F.col("last.promo_price").alias("last_price"), *(F.col(f"last.{c}").alias(c) for c in extra),
                       change.alias("change"))


def missing_dates(df: DataFrame) -> DataFrame:
    """Days of every recorded week on which nothing at all was recorded."""
    seen = df.select("business_date").distinct()
    weeks = seen.select(cal.monday(F.col("business_date")).alias("week_start")).distinct()
    wanted = weeks.select("week_start", F.explode(F.sequence("week_start", F.date_add("week_start", 6))).alias(
        "business_date"))
    return wanted.join(seen, "business_date", "left_anti").select("week_start", "business_date")


def merge_history(previous: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (chain, sku, local day).  The later instant wins, ties go to the incoming row, a late older record
    never overwrites a newer one."""
    both = previous.withColumn("_batch", F.lit(0)).unionByName(incoming.withColumn("_batch", F.lit(1)))
    order = [F.col("observed_at").desc(), F.col("_batch").desc(), F.col("seq").desc()]
    return first_per_key(both, [*SERIES, "business_date"], order).drop("_batch")


def day_snapshots(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, headers): the last record of every SKU and day, and per (day, chain) its size and newest time.

    Rows stay flat: a chain's day may hold a third of all rows, so it is never collected into one nested value.
    """
    rows = last_per_day(df)
    headers = rows.groupBy("chain", "business_date").agg(
        F.count(F.lit(1)).alias("row_count"), F.max("observed_at").alias("updated"))
    return rows, headers


def refuse_naive(df: DataFrame, text: str = "observed_text") -> tuple[DataFrame, DataFrame]:
    """(accepted with a UTC ``observed_at``, refused): time text must carry an offset."""
    stamped = df.withColumn("observed_at", cal.utc_instant(F.col(text)))
    good = F.col("observed_at").isNotNull()
    return stamped.filter(good), stamped.filter(~good)
