"""Attach per-key facts to rows when one key may hold a third of them.

Facts are aggregated map-side first and are unique per key.  The join is left to Spark: a small side is broadcast after its size
check, and the adaptive skew join splits a hot partition by map output, repeating only that key's single fact row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def attach(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join ``facts`` (one row per key) to ``rows``."""
    return rows.join(facts, list(keys), how)


def with_group_facts(rows: DataFrame, keys: Sequence[str], **facts: Column) -> DataFrame:
    """``facts`` aggregated per key and attached to every row of the key.  Keys must not be NULL."""
    grouped = rows.groupBy(*keys).agg(*(c.alias(n) for n, c in facts.items()))
    return attach(rows, grouped, keys, "inner")
