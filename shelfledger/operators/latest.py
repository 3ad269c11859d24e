"""Latest-per-key and its relatives: the one helper under most history jobs.

``row_number() <= k`` over a fully specified order plans as ``WindowGroupLimit`` on both sides of the shuffle, so a map
task sends at most ``k`` rows per key.  A key that holds a third of all rows therefore never reaches one task whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows per key; ``order`` must end in a unique column so that ties are settled."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


def latest_per_key(df: DataFrame, keys: Sequence[str | Column], time: str = "observed_at", seq: str = "seq",
                   tie: str = "first") -> DataFrame:
    """Newest row per key by instant, never by "newest with a price".

    ``tie="first"``: an equal later row does not replace what was seen.  ``tie="last"``: the incoming row wins.
    """
    last = {"first": F.col(seq).asc(), "last": F.col(seq).desc()}[tie]
    return first_per_key(df, keys, [F.col(time).desc_nulls_last(), last])


def latest_group(df: DataFrame, groups: Sequence[str], time: str) -> DataFrame:
    """All rows that carry the newest ``time`` of their group, ties kept.

    Groups are few and huge (chains, weeks), so the maximum is aggregated map-side and joined back instead of ranking
    whole groups; there is one row per group on the joined side.
    """
    newest = df.groupBy(*groups).agg(F.max(time).alias("_newest"))
    on = [df[g].eqNullSafe(newest[g]) for g in groups] + [df[time] == newest["_newest"]]
    return df.join(newest, on, "left_semi")
