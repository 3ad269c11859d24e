"""Rules as data: model patterns, tracked colors, scope and hidden models read from JSON."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfledger.schemas import PREFERENCE, RULE
from shelfledger.functions.text import fold
from shelfledger.operators.rule_index import only_hit, with_hits


def read_model_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(name, pattern) in file order.  The file is one hand-kept document, so its rules may live in the plan as literals."""
    document = spark.read.option("multiLine", True).schema(f"models array<{RULE.simpleString()}>").json(path)
    rules = [(r.name, r.pattern) for r in document.select(F.inline("models")).collect()]
    for name, pattern in rules:
        re.compile(pattern)
        if not name.strip():
            raise ValueError("a rule needs a name")
    return rules


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    """Tracked products as a small table; a model may occur once."""
    document = spark.read.option("multiLine", True).schema(f"products array<{PREFERENCE.simpleString()}>").json(path)
    products = document.select(F.inline("products"))
    rows = products.select(fold(F.col("model")).alias("_key")).collect()
    keys = [r["_key"] for r in rows]
    if len(set(keys)) != len(keys) or "" in keys:
        raise ValueError("a tracked model is empty or occurs twice")
    return products


def read_hidden_models(spark: SparkSession, path: str) -> DataFrame:
    document = spark.read.option("multiLine", True).schema(
        "version int, hidden_models array<struct<category: string, model_name: string>>").json(path)
    return document.filter("version = 1").select(F.inline("hidden_models")).selectExpr("category", "model_name AS model")


def read_brand_scope(spark: SparkSession, path: str) -> list[str]:
    document = spark.read.option("multiLine", True).schema("version int, brands array<string>").json(path)
    return [r.brand for r in document.filter("version = 1").select(F.explode("brands").alias("brand")).collect()]


def rule_rows(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(position, name, pattern) of a list of rules, in its order."""
    return spark.createDataFrame([(i, n, p) for i, (n, p) in enumerate(rules)], "position int, name string, pattern string")


def read_rule_files(spark: SparkSession, folder: str) -> DataFrame:
    """(brand, position, name, pattern) of all rule files of a folder, one document per brand; positions follow the file."""
    document = spark.read.option("multiLine", True).schema(f"brand string, models array<{RULE.simpleString()}>").json(folder)
    return document.select("brand", F.posexplode("models").alias("position", "rule")).select("brand", "position", "rule.name", "rule.pattern")


def label_by_brand(df: DataFrame, index: DataFrame) -> DataFrame:
    """Label by the rule index of the row's brand: exactly one rule must be found."""
    return with_hits(df, index, "product_name", ["brand"]).withColumn("label", only_hit()).drop("hits")
