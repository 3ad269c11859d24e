"""Business day, Monday week, ISO week and fiscal week.  Instants are TIMESTAMP_NTZ columns holding UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfledger import fixed_values as V

OFFSET_TEXT = r"(?:[Zz]|[+-]\d{2}:?\d{2})$"


def utc_instant(text: Column) -> Column:
    """ISO text with an offset to a UTC instant; text without an offset is refused (NULL)."""
    stamp = F.try_to_timestamp(text)
    as_utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), stamp.cast("timestamp_ntz"))
    return F.when(text.rlike(OFFSET_TEXT), as_utc)


def local_time(instant: Column, zone: str = V.BUSINESS_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant)


def business_date(instant: Column, zone: str = V.BUSINESS_ZONE) -> Column:
    return F.to_date(local_time(instant, zone))


def monday(day: Column) -> Column:
    return F.date_sub(day, F.weekday(day))


def week_end(day: Column) -> Column:
    return F.date_add(monday(day), 6)


def last_completed_week(day: Column) -> Column:
    return F.date_sub(monday(day), 7)


def iso_year(day: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), day).cast("int")


def iso_week(day: Column) -> Column:
    return F.weekofyear(day)


def iso_week_exists(year: Column, week: Column) -> Column:
    """A year has ISO week 53 only when 28 December falls in it."""
    return year.between(2020, 2100) & week.between(1, F.weekofyear(F.make_date(year, F.lit(12), F.lit(28))))


def _weeks_from_anchor(day: Column, anchor: str) -> Column:
    return F.floor(F.datediff(monday(day), F.lit(anchor).cast("date")) / 7)


def fiscal_label(day: Column, anchor: str = V.FISCAL_ANCHOR_WEEK, anchor_year: int = V.FISCAL_ANCHOR_YEAR) -> Column:
    """``W{week}Q{quarter}FY{year}``; weeks before the anchor count backwards by floor division."""
    weeks = _weeks_from_anchor(day, anchor)
    within = F.pmod(weeks, F.lit(V.WEEKS_PER_YEAR))
    year = F.lit(anchor_year) + F.floor(weeks / V.WEEKS_PER_YEAR)
    return F.concat(F.lit("W"), F.pmod(within, F.lit(V.WEEKS_PER_QUARTER)) + 1,
                    F.lit("Q"), F.floor(within / V.WEEKS_PER_QUARTER) + 1,
                    F.lit("FY"), F.when(year < 10, F.lpad(year.cast("string"), 2, "0")).otherwise(year.cast("string")))
