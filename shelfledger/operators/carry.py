"""Keep what a run could not read again, clearly marked as old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.operators.history import SERIES
from shelfledger.operators.quality import missing

POLICIES = ("failed", "unseen", "model")


def carry_forward(previous: DataFrame, fresh: DataFrame, at: Column, reason: Column | str, policy: str = "unseen",
                  issues: DataFrame | None = None, model: str | None = None) -> DataFrame:
    """Fresh rows plus previous rows of SKUs not read now; those keep their time and gain ``stale_since``/``stale_reason``.

    ``failed`` keeps only SKUs with an issue, ``unseen`` all, ``model`` all but marks only rows of one model.
    All sides hold one row per SKU.
    """
    if policy not in POLICIES:
        raise ValueError(f"policy is one of {POLICIES}")
    old = previous.join(fresh.select(*SERIES), SERIES, "left_anti")
    stamp, why = at, reason if isinstance(reason, Column) else F.lit(reason)
    if policy == "failed":
        failed = issues.filter(~missing(F.col("sku"))).groupBy(*SERIES).agg(F.max_by("reason", "seq").alias("_why"))
        old, why = old.join(failed, SERIES), F.col("_why")
    marked = F.col("model") == model if policy == "model" else F.lit(True)
    kept = old.withColumns({
        "stale_since": F.when(marked, stamp).otherwise(F.col("stale_since")),
        "stale_reason": F.when(marked, why).otherwise(F.col("stale_reason"))}).drop("_why")
    return fresh.unionByName(kept, allowMissingColumns=True)
