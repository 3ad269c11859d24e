"""Seed list and its join to per-chain settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions.links import belongs
from shelfledger.operators.latest import first_per_key
from shelfledger.operators.quality import missing, split, violations
from shelfledger.schemas import SEED


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Seed rows from CSV (with header) or JSON lines."""
    reader = spark.read.schema(SEED)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.option("header", True).csv(path)


def seed_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seeds, rejects): trimmed, complete and of the chain's own site; the first row wins per source."""
    trimmed = rows.withColumns({c: F.trim(c) for c in ("category", "brand", "url")})
    good, bad = split(trimmed, violations(
        category=missing(F.col("category")), brand=missing(F.col("brand")), url=missing(F.col("url")),
        link=~belongs(F.col("chain"), F.col("url"))))
    return first_per_key(good, ["chain", "category", "brand", "url"], [F.col("input_row")]), bad


def url_patterns(spark: SparkSession) -> DataFrame:
    """Per chain a map category to link pattern; as many rows as there are chains."""
    rows = [(chain, patterns) for chain, patterns in V.CATEGORY_URL_PATTERNS.items()]
    return spark.createDataFrame(rows, "chain string, patterns map<string, string>")


def with_patterns(seeds: DataFrame, patterns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sources with their link pattern, seeds whose category is not mapped)."""
    joined = seeds.join(patterns, "chain", "left").withColumn(
        "product_url_pattern", F.try_element_at("patterns", F.col("category"))).drop("patterns")
    mapped = F.col("product_url_pattern").isNotNull()
    return joined.filter(mapped), joined.filter(~mapped)


def outside_seeds(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Product links that are not themselves seed pages."""
    return links.join(seeds.select(F.col("url").alias("source_url")).distinct(), "source_url", "left_anti")


def seed_counts(seeds: DataFrame) -> DataFrame:
    by = lambda facet: seeds.groupBy(F.col(facet).alias("value")).agg(F.count(F.lit(1)).alias("seeds")).select(
        F.lit(facet).alias("facet"), "value", "seeds")
    return by("chain").union(by("category"))
