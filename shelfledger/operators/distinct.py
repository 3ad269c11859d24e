"""Distinct counts: exact by two-level grouping, and as sketches that are kept and merged."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_SIZE = 12  # of a sketch: 4096 registers, a relative standard error of about 1.6 percent


def exact_counts(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """(keys, counts): the different values of each column per key, NULL values left out.

    Each column is grouped by (key, value) with map-side combine and then by key, so rows are not copied per column and a key that holds a
    third of all rows is spread by its values.  ``columns`` names the counts.  Keys must not be NULL.
    """
    def one(name: str, column: str) -> DataFrame:
        values = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_rows"))
        return values.groupBy(*keys).agg(F.count(column).alias(name))

    return reduce(lambda a, b: a.join(b, list(keys)), (one(n, c) for n, c in columns.items()))


def sketches(df: DataFrame, keys: Sequence[str], **columns: str) -> DataFrame:
    """One mergeable sketch per key and column, to be kept in a table."""
    return df.groupBy(*keys).agg(*(F.hll_sketch_agg(F.col(c).cast("string"), F.lit(LOG_SIZE)).alias(n) for n, c in columns.items()))


def merged(kept: DataFrame, keys: Sequence[str], *names: str) -> DataFrame:
    """Sketches of coarser keys, united without the rows."""
    return kept.groupBy(*keys).agg(*(F.hll_union_agg(n).alias(n) for n in names))


def estimates(kept: DataFrame, *names: str) -> DataFrame:
    return kept.withColumns({n: F.hll_sketch_estimate(n) for n in names})
