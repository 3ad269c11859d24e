"""Rules found through an inverted table of their words.

A rule is a pattern; most patterns can only be found in a text that holds certain whole words.  The rule is filed under the rarest of
them.  A text's different words are equi-joined to that table, the rule's other words are looked up in the text, and only what is left
is searched with the pattern.  Texts are searched once each, however many rows repeat them, so cost follows the texts and their hits and
not the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from re import _constants as C  # the parser of the standard library: nothing of the syntax is repeated here
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

EDGE, GAP, UNSURE = "edge", "gap", "unsure"
ANY_TEXT = ""  # the word of rules without one: every text holds it


def _space(items: Sequence) -> bool:
    return list(items) == [(C.IN, [(C.CATEGORY, C.CATEGORY_SPACE)])]


def _marks(items: Sequence, inside: set[str]) -> Iterator[str]:
    """The pattern as single characters, word edges, gaps and what can't be told; words of lookaheads go to ``inside``."""
    for kind, value in items:
        if kind is C.LITERAL:
            yield chr(value)
        elif kind is C.AT and value is C.AT_BOUNDARY:
            yield EDGE
        elif kind is C.SUBPATTERN:
            yield from _marks(value[3], inside)
        elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and value[0] and _space(value[2]):
            yield GAP
        elif kind is C.IN and value == [(C.CATEGORY, C.CATEGORY_SPACE)]:
            yield GAP
        elif kind is C.ASSERT and value[0] == 1:
            inside |= _words(value[1])
        elif kind in (C.ASSERT, C.ASSERT_NOT):
            continue  # takes no place
        else:
            yield UNSURE


def _words(items: Sequence) -> set[str]:
    found: set[str] = set()
    marks = [UNSURE, *_marks(items, found), UNSURE]
    run = ""
    clear = False  # the run began at an edge
    for mark in marks:
        if len(mark) == 1 and re.match(r"\w", mark):
            run += mark.lower()
            continue
        edge = mark in (EDGE, GAP) or len(mark) == 1
        if run and clear and edge:
            found.add(run)
        run, clear = "", edge
    return found


def pattern_words(pattern: str) -> list[str]:
    """Whole words, lower case, that every text with the pattern holds; sorted, empty if none is sure."""
    return sorted(_words(_parser.parse(pattern, re.IGNORECASE)))


@lru_cache(maxsize=1 << 14)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.IGNORECASE)


@F.pandas_udf(ArrayType(StringType()))
def _rule_words(pattern: pd.Series) -> pd.Series:
    return pattern.map(pattern_words)


@F.pandas_udf(BooleanType())
def _found(text: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([_compiled(p).search(t) is not None for t, p in zip(text, pattern)], dtype=bool)


def text_words(text: Column) -> Column:
    """Different words of a text, lower case."""
    low = F.translate(F.lower(text), "ſ", "s")
    return F.array_distinct(F.filter(F.split(low, r"(?U)\W+"), lambda w: w != ""))


def rule_index(rules: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, token, also, position, rule, pattern) of ``rules`` (by, position, name, pattern): each rule under its rarest word.

    ``by`` are columns, such as a brand, within which rules are searched.  NULL patterns are left out; a rule that is listed twice
    is one hit.
    """
    worded = rules.filter("pattern IS NOT NULL").select(*by, "position", F.col("name").alias("rule"), "pattern", _rule_words("pattern").alias("_all"))
    keys = [*by, "_word"]
    each = worded.withColumn("_word", F.explode("_all"))
    common = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rules"))
    rarest = (each.join(common, keys).groupBy(*by, "position", "rule", "pattern", "_all")
              .agg(F.min(F.struct(F.col("_rules"), (-F.length("_word")).alias("_short"), F.col("_word"))).alias("_best")))
    filed = rarest.select(*by, F.col("_best._word").alias("token"), F.array_remove("_all", F.col("_best._word")).alias("also"), "position", "rule", "pattern")
    wordless = worded.filter(F.size("_all") == 0).select(*by, F.lit(ANY_TEXT).alias("token"), F.col("_all").alias("also"), "position", "rule", "pattern")
    return filed.unionByName(wordless)


def candidates(texts: DataFrame, index: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Different texts beside each rule whose words they hold."""
    different = texts.select(*by, text).filter(F.col(text).isNotNull()).distinct().withColumn("_words", text_words(F.col(text)))
    tokens = different.withColumn("token", F.explode(F.array_append("_words", F.lit(ANY_TEXT))))
    return tokens.join(index, [*by, "token"]).filter(F.forall("also", lambda w: F.array_contains("_words", w))).drop("_words", "token", "also")


def rule_hits(texts: DataFrame, index: DataFrame, text: str = "product_name", by: Sequence[str] = ()) -> DataFrame:
    """(by, text, hits): the rules found in each different text that has any, in the order of their position.

    A text's hits are at most the rules, so the list is as short as the rule table.
    """
    sure = candidates(texts, index, text, by).filter(_found(F.col(text), F.col("pattern")))
    listed = sure.groupBy(*by, text).agg(F.array_sort(F.collect_set(F.struct("position", "rule"))).alias("_hits"))
    return listed.select(*by, text, F.col("_hits.rule").alias("hits"))


def with_hits(rows: DataFrame, index: DataFrame, text: str = "product_name", by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``hits``, empty where no rule is found (a NULL text has none).

    The hits of a text are joined back by the text; one that a third of all rows share is split by the adaptive skew join.
    """
    found = rule_hits(rows, index, text, by)
    return rows.join(found, [*by, text], "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def only_hit(hits: str = "hits") -> Column:
    """The rule where exactly one is found; none and several are both unknown."""
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))
