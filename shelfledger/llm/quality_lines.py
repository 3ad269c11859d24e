"""Line-first cleaning with DataFrame functions only.

Each line of a text is judged on its own (punctuation, navigation, boilerplate); failing lines are removed, and a document
goes when the base rules fail or when it loses too much of its text.  Everything stays inside one row, so there is no shuffle
and no group that could be hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.shared import WORD, sheltering, text_of, words_of

WINDOW = 8  # words of a window whose repetition counts
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOL = r"[#*$%&|<>]"

# Phrases that mark a line as site boilerplate, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "cookie policy",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "privacy policy",
    "skip to content",
    "subscribe to our newsletter",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Bounds of the line rules, in percent of a line's characters outside blanks unless said otherwise."""

    symbol_percent: int = 12  # punctuation: more symbols than this
    upper_percent: int = 55  # punctuation: more upper-case letters than this ...
    upper_chars: int = 40  # ... on a line with at least so many characters
    bars: int = 2  # navigation: at least so many "|" ...
    words_per_bar: int = 3  # ... and at most so many words for each
    boilerplate_chars: int = 200  # boilerplate: a phrase on a line of at most so many characters
    max_lost_percent: int = 50  # of the text's word characters; a document that loses more is rejected


def _share(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def line_facts(line: Column, rules: LineRules) -> Column:
    """What the rules need of one line, taken once."""
    return F.struct(
        line.alias("line"), F.length(line).alias("chars"),
        F.length(F.replace(line, F.lit(" "), F.lit(""))).alias("solid"),
        (F.length(line) - F.length(F.regexp_replace(line, SYMBOL, ""))).alias("symbols"),
        (F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}+", ""))).alias("upper"),
        (F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))).alias("bars"),
        F.when(F.length(line) <= rules.boilerplate_chars, F.lower(line)).alias("low"))


def line_fault(facts: Column, rules: LineRules) -> Column:
    """``punctuation``, ``navigation``, ``boilerplate`` or NULL for one line."""
    tokens = facts["chars"] - facts["solid"] + 1  # words and free-standing bars
    boiler = F.lit(False)
    for known in BOILERPLATE:
        boiler = boiler | F.contains(facts["low"], F.lit(known))
    return (F.when((facts["bars"] >= rules.bars) & (tokens <= facts["bars"] * (rules.words_per_bar + 1) + rules.words_per_bar), "navigation")
            .when(_share(facts["symbols"], facts["solid"], rules.symbol_percent), "punctuation")
            .when((facts["solid"] >= rules.upper_chars) & _share(facts["upper"], facts["solid"], rules.upper_percent), "punctuation")
            .when(boiler, "boilerplate"))


def _repeated_words(docs: DataFrame) -> DataFrame:
    """``n_repeat_words``: words inside windows of eight words found twice or more in the same text.

    Windows are compared by a 64-bit hash of their words' hashes.  Positions are sorted only in texts that repeat a window.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size("_hash") - WINDOW),
                          lambda i: F.xxhash64(*[F.get(F.col("_hash"), i + j) for j in range(WINDOW)]))
    docs = docs.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    docs = docs.withColumn("_win", F.when(F.size("_hash") >= WINDOW, windows))
    repeats = F.size("_win") > F.size(F.array_distinct("_win"))
    docs = docs.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = F.filter("_sorted", lambda x, i: F.coalesce(x["h"] == F.get("_sorted", i - 1)["h"], F.lit(False))
                    | F.coalesce(x["h"] == F.get("_sorted", i + 1)["h"], F.lit(False)))
    docs = docs.withColumn("_starts", F.sort_array(F.transform(twin, lambda x: x["i"])))
    spans = F.transform("_starts", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, b: a + b)
    return (docs.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
            .drop("_hash", "_win", "_sorted", "_starts"))


@sheltering("_words", "_lines", "_judged", "_spoken", "_facts", "_row", "_hash", "_win", "_sorted", "_starts")
def judge(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """``docs`` with counts, ``clean_text``, ``line_faults``, ``lost_chars``, ``base_failed`` and ``kept``.

    A NULL or empty text has no words and fails the base rule of 20 words.  Repeated rows are judged alike, each on its own.
    Columns of the input keep their values, also where they bear the name of a count: the counts replace such a column.
    An empty table gives an empty table.
    """
    rules = rules or LineRules()
    made = ["_words", "_lines", "_judged", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_text",
            "line_faults", "lost_chars", "base_failed", "kept"]
    docs = docs.drop(*made)
    text = text_of()
    docs = docs.withColumn("_words", words_of(text)).withColumn("_lines", F.split(text, "\n"))
    docs = _repeated_words(docs)
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOL, ""))).cast("bigint"),
        "_spoken": F.filter("_lines", lambda x: F.rlike(x, F.lit(WORD))),
        "_facts": F.transform("_lines", lambda x: line_facts(x, rules)),
    })
    docs = docs.withColumn("_judged", F.transform("_facts", lambda x: F.struct(x["line"].alias("line"), line_fault(x, rules).alias("fault"))))
    good = F.filter("_judged", lambda x: x["fault"].isNull())
    docs = docs.withColumns({
        "n_dup_lines": (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("bigint"),
        "clean_text": F.array_join(F.transform(good, lambda x: x["line"]), "\n"),
        "line_faults": F.filter(F.transform("_judged", lambda x: x["fault"]), lambda x: x.isNotNull()),
        # A filter on the verdict must not be pushed below this point, or every count would be computed again inside it.
        "_row": F.monotonically_increasing_id(),
    })
    once = F.col("_row") >= 0
    left = F.length(F.array_join(words_of(F.col("clean_text")), ""))
    docs = docs.withColumn("lost_chars", F.when(F.size("line_faults") == 0, 0).otherwise(F.col("word_chars") - left).cast("bigint"))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = _share(F.col("lost_chars"), F.col("word_chars"), rules.max_lost_percent)
    return (docs.withColumns({"base_failed": failed & once, "kept": ~failed & ~lost & once})
            .drop("_words", "_lines", "_spoken", "_facts", "_judged", "_row"))


def clean(docs: DataFrame, rules: LineRules | None = None) -> DataFrame:
    """The documents that stay, with their failing lines removed and ``n_chars`` set to the new length."""
    names = docs.columns
    kept = judge(docs, rules).filter("kept").withColumn("text", F.col("clean_text"))
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"`{n}`") for n in names])
