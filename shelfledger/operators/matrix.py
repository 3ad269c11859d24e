"""Cross-chain price matrix, facets and display order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import product as P
from shelfledger.functions.text import fold, search_key
from shelfledger.operators.latest import first_per_key

CELL = ["model", "storage", "variant"]


def display_variant(model: Column, variant: Column, name: Column) -> Column:
    """Variant tokens; a laptop also gets its memory size, tokens sorted and distinct."""
    ram = F.regexp_extract(name, r"(?i)\b(\d{1,2})\s*GB\b", 1)
    tokens = F.split(F.coalesce(variant, F.lit("")), " · ")
    with_ram = F.array_append(tokens, F.when(ram != "", F.concat(F.lit("RAM "), ram, F.lit("GB"))).otherwise(""))
    sorted_tokens = F.array_sort(F.array_distinct(F.filter(with_ram, lambda t: t != "")))
    return F.when(model.startswith("MacBook"), F.array_join(sorted_tokens, " · ")).otherwise(
        F.coalesce(variant, F.lit("")))


def with_cell(df: DataFrame) -> DataFrame:
    variant = display_variant(F.col("model"), F.col("display_variant"), F.col("product_name"))
    return df.withColumn("variant", variant).withColumn("storage", F.coalesce("storage", F.lit("")))


def cell_ranges(quotes: DataFrame) -> DataFrame:
    """Lowest and highest price per cell and chain; a status-only cell has no range but counts its quotes."""
    return with_cell(quotes).groupBy(*CELL, "chain").agg(
        F.min("promo_price").alias("low"), F.max("promo_price").alias("high"), F.count(F.lit(1)).alias("quotes"))


def price_matrix(quotes: DataFrame, chains: Sequence[str] = tuple(V.CHAIN_NAMES)) -> DataFrame:
    """One row per cell key, one column group per chain.  The chain list is given, so no pass is spent to find it;
    the quotes behind a cell stay rows of ``with_cell`` and are never collected into one value."""
    return with_cell(quotes).groupBy(*CELL).pivot("chain", list(chains)).agg(
        F.min("promo_price").alias("low"), F.max("promo_price").alias("high"), F.count(F.lit(1)).alias("quotes"))


def standard_order(model: Column, name: Column, variant: Column) -> list[Column]:
    """Rule position, then the model itself, storage in GB, natural order of the variant; unknown models last."""
    return [P.rule_position(model), P.natural_key(model), P.storage_sort(name), P.natural_key(variant)]


def facet_filter(df: DataFrame, brand: str | None = None, chain: str | None = None, category: str | None = None,
                 model: str | None = None, text: str | None = None, name: str = "product_name") -> DataFrame:
    """Conjunction of chosen facets and an accent-insensitive search text."""
    for column, value in (("brand", brand), ("chain", chain), ("category", category), ("model", model)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if text:
        df = df.filter(F.contains(search_key(F.col(name)), search_key(F.lit(text))))
    return df


def facet_options(df: DataFrame, brand: str | None = None, category: str | None = None,
                  chain: str | None = None) -> DataFrame:
    """Values on offer per facet: brands over everything, models under the other chosen facets."""
    facets = [("brand", df), ("category", facet_filter(df, brand=brand)),
              ("model", facet_filter(df, brand=brand, category=category, chain=chain))]
    parts = [rows.select(F.lit(name).alias("facet"), F.col(name).alias("value")).filter(F.col("value") != "")
             for name, rows in facets]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


def placeholders(rows: DataFrame, tracked: DataFrame, note: str = "Chưa có dữ liệu đúng cấu hình") -> DataFrame:
    """Tracked models without any row, added as rows without data."""
    missing = tracked.select("model").distinct().join(rows.select("model").distinct(), "model", "left_anti")
    return rows.unionByName(missing.withColumn("variant", F.lit(note)), allowMissingColumns=True)


def chain_union(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Outputs of several chains under one schema with the chain's name."""
    out = None
    for name, part in parts:
        labelled = part.withColumn("chain", F.lit(name))
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    if out is None:
        raise ValueError("no chain given")
    return out


def snapshot_dedupe(rows: DataFrame, rank: str = "snapshot") -> DataFrame:
    """Overlapping snapshots: one row per (slug, sku, instant), the first snapshot in ``rank`` order is kept."""
    return first_per_key(rows, ["slug", "sku", "observed_at"], [F.col(rank), F.col("seq")])


def newest_sources(sources: DataFrame) -> DataFrame:
    return first_per_key(sources, ["chain"], [F.col("updated").desc(), F.col("business_date").desc()])


def model_registry(known: DataFrame, seen: DataFrame) -> DataFrame:
    """Known models and new ones.  New ones are fresh unless the registry was empty; a missing brand is filled once."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_c", fold(F.col("category"))).withColumn("_m", fold(F.col("model")))
    added = (keyed(seen).groupBy("_c", "_m").agg(
        F.max_by(F.struct("category", "model"), F.col("seq")).alias("_new"),
        F.max_by("brand", F.when((F.coalesce("brand", F.lit("")) != "") & (F.col("brand") != V.UNKNOWN_BRAND),
                                 F.col("seq"))).alias("_brand")))
    old = keyed(known).withColumn("_old", F.lit(True))
    filled = F.coalesce(F.nullif("brand", F.lit("")), F.col("_brand"))
    has_known = known.agg(F.count(F.lit(1))).scalar() > 0
    joined = old.join(added, ["_c", "_m"], "full_outer")
    return joined.select(
        F.coalesce("category", "_new.category").alias("category"), F.coalesce("model", "_new.model").alias("model"),
        filled.alias("brand"), (F.col("_old").isNull() & has_known).alias("fresh"))
