"""Contracts, gates and evidence checks.  Every check splits or counts; nothing is dropped silently."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import calendar as cal
from shelfledger.functions import links as L
from shelfledger.functions import product as P
from shelfledger.functions import text as T
from shelfledger.operators.audit import count_if


class GateFailed(ValueError):
    """A batch broke a rule; nothing was written."""


def missing(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("")) == ""


def violations(**rules: Column) -> Column:
    """Names of the broken rules, in the given order.  A rule that cannot be decided counts as broken."""
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(True)), F.lit(name))
                                     for name, broken in rules.items())))


def split(df: DataFrame, broken: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows with ``violations``)."""
    marked = df.withColumn("violations", broken)
    return (marked.filter(F.size("violations") == 0).drop("violations"), marked.filter(F.size("violations") > 0))


def dated(day: Column, time: Column) -> Column:
    return ~(F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & F.try_to_timestamp(time).isNotNull())


def observation_violations() -> Column:
    price, listed = F.col("promo_price"), F.col("original_price")
    no_price = price.isNull()
    return violations(
        chain=~F.col("chain").isin(V.CHAIN_NAMES), sku=missing(F.col("sku")), name=missing(F.col("product_name")),
        time=dated(F.col("day_text"), F.col("time_text")), price=F.coalesce(price <= 0, F.lit(False)),
        text=F.col("promo_text").isNull(), status=no_price & (listed.isNotNull() | ~T.has_status(F.col("promo_text"))),
        original=F.coalesce(listed < price, F.lit(False)), link=~L.belongs(F.col("chain"), F.col("source_url")))


def issue_violations() -> Column:
    return violations(
        chain=~F.col("chain").isin(V.CHAIN_NAMES), stage=~F.col("stage").isin("catalog", "price"),
        time=dated(F.col("day_text"), F.col("time_text")), reason=missing(F.trim("reason")),
        link=~L.belongs(F.col("chain"), F.col("source_url")))


def catalog_violations() -> Column:
    return violations(
        chain=~F.col("chain").isin(V.CHAIN_NAMES), sku=(F.col("status") == "ready") & missing(F.col("sku")),
        name=missing(F.col("product_name")), status=~F.col("status").isin("ready", "review"),
        time=F.try_to_timestamp("time_text").isNull(), reason=F.col("reason").isNull(),
        link=~L.belongs(F.col("chain"), F.col("source_url")))


def source_violations() -> Column:
    limits = {name: ~F.col(name).between(low, high) for name, (low, high) in V.SOURCE_LIMITS.items()}
    return violations(seeds=F.size("seeds") < 1, **limits)


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts (counted map-side)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def catalog_gate(items: DataFrame, review: DataFrame) -> DataFrame:
    """One row of counters; a batch passes when all are zero.

    Items are grouped by SKU, with their own counters, and links of both inputs by link: two scans of the items, one of the review.
    """
    skus = items.groupBy("chain", "sku").agg(
        F.count(F.lit(1)).alias("_n"), count_if(~F.col("verified")).alias("_unverified"),
        count_if(missing(F.col("product_name"))).alias("_unnamed"), count_if(F.size("verify_tokens") < 1).alias("_untokened"))
    total = lambda name: F.coalesce(F.sum(f"_{name}"), F.lit(0)).alias(name)
    by_sku = skus.agg(*(total(n) for n in ("unverified", "unnamed", "untokened")), count_if(F.col("_n") > 1).alias("shared_sku"))
    links = items.select("source_url", F.lit(1).alias("_ready")).unionByName(review.select("source_url", F.lit(0).alias("_ready")))
    each = links.groupBy("source_url").agg(F.sum("_ready").alias("_ready"), F.sum(1 - F.col("_ready")).alias("_review"))
    by_link = each.agg(count_if(F.col("_ready") > 1).alias("shared_link"), count_if(F.col("_review") > 1).alias("shared_review_link"),
                       count_if((F.col("_ready") > 0) & (F.col("_review") > 0)).alias("ready_and_review"))
    both = by_sku.unionByName(by_link, allowMissingColumns=True)  # two rows, each with its own counters
    return both.agg(*(F.max(c).alias(c) for c in both.columns))


def enforce(counters: DataFrame, allowed: Sequence[str] = ()) -> None:
    """Raise when a counter of a one-row gate is not zero."""
    row = counters.first()
    broken = {n: row[n] for n in counters.columns if n not in allowed and row[n]}
    if broken:
        raise GateFailed(", ".join(f"{n}={v}" for n, v in broken.items()))


def row_counters(chain: str) -> list[Column]:
    """Aggregates over a run's rows that its gate needs."""
    no_price = F.col("promo_price").isNull()
    bad_status = no_price & (F.col("original_price").isNotNull() | ~T.has_status(F.col("promo_text")))
    return [F.count(F.lit(1)).alias("row_count"), count_if(~F.col("chain").eqNullSafe(F.lit(chain))).alias("other_chain"),
            count_if(F.col("promo_price") <= 0).alias("bad_price"), count_if(bad_status).alias("bad_status")]


def issue_counters(chain: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("issue_count"), count_if(~F.col("chain").eqNullSafe(F.lit(chain))).alias("other_chain_issues")]


def judged_counters(counters: DataFrame, year: int, week: int, expected: int | None) -> DataFrame:
    """One row of what forbids a run, from one row of the counters above."""
    wanted = F.lit(expected).cast("bigint")
    valid_week = cal.iso_week_exists(F.lit(year), F.lit(week))
    return counters.select(
        (F.col("row_count") == 0).cast("bigint").alias("empty"), "other_chain", "other_chain_issues", "bad_price",
        "bad_status", F.coalesce((F.col("row_count") + F.col("issue_count") != wanted).cast("bigint"), F.lit(1)).alias(
            "unreconciled"), (~F.coalesce(valid_week, F.lit(False))).cast("bigint").alias("bad_week"))


def run_gate(rows: DataFrame, issues: DataFrame, chain: str, year: int, week: int, expected: int | None) -> DataFrame:
    """Counters of everything that forbids writing a chain's run, one pass over each input."""
    prices, broken = rows.agg(*row_counters(chain)), issues.agg(*issue_counters(chain))
    for name in broken.columns:
        prices = prices.withColumn(name, broken.select(name).scalar())
    return judged_counters(prices, year, week, expected)


# --- evidence --------------------------------------------------------------------------------------------------------


def color_match(color: Column, wanted: Column) -> Column:
    return T.fold(color) == T.fold(wanted)


def verified_variant(df: DataFrame, tracked: DataFrame) -> DataFrame:
    """Rows whose evidence proves model, color and product code of a tracked model.

    ``tracked`` has one row per model; whether it is broadcast is left to Spark's size check.
    """
    rules = tracked.select(F.col("model"), F.col("color").alias("wanted_color"))
    proof = F.col("color_evidence")
    color_ok = F.col("wanted_color").isNull() | (
        proof["website_color_id"].isNotNull() & color_match(proof["canonical_color"], F.col("wanted_color")))
    price_ok = F.when(F.col("promo_price").isNull(), F.contains("promo_text", F.lit(V.STATUS_PREFIX.strip()))).otherwise(
        F.col("promo_price") > 0)
    proven = ((proof["model"] == F.col("model")) & (proof["product_code"] == F.col("variant_id"))
              & ~missing(proof["verified_at"]))
    return (df.join(rules, "model").filter(~missing(F.col("sku")) & proven & color_ok & price_ok)
            .drop("wanted_color"))


def list_gate(df: DataFrame, most: int = V.MAX_RULES) -> DataFrame:
    """One row: the length of a hand-kept list and whether it is longer than agreed.  Jobs use the whole list either way."""
    return df.agg(F.count(F.lit(1)).alias("entries")).withColumn("too_many", F.col("entries") > most)


def brand_scope(df: DataFrame, brands: Sequence[str] = tuple(V.BRAND_SCOPE)) -> DataFrame:
    """Rows of the allowed brands; an empty list allows all."""
    allowed = [b.strip().lower() for b in brands if b.strip()]
    return df.filter(F.lower(F.trim("brand")).isin(allowed)) if allowed else df


def scope_route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, excluded with ``scope_reason``)."""
    marked = df.withColumn("scope_reason", P.scope_reason(F.col("product_name"), F.col("category")))
    return marked.filter("scope_reason IS NULL").drop("scope_reason"), marked.filter("scope_reason IS NOT NULL")


def tracked_rows(rows: DataFrame, models: DataFrame) -> DataFrame:
    names = models.select("model").distinct()
    return rows.filter(F.col("selection") == "selected").join(names, "model", "left_semi")


def tracked_issues(issues: DataFrame, models: DataFrame) -> DataFrame:
    """Chain-level issues, and issues of tracked models."""
    known = issues.filter(~missing(F.col("model"))).join(models.select("model").distinct(), "model", "left_semi")
    return issues.filter(missing(F.col("model"))).unionByName(known)
