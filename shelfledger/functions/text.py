"""Keys, notes, money and error classes."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from shelfledger import fixed_values as V

UNICODE = "(?iU)"  # case and word classes over all letters, on every JDK


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda value: unicodedata.normalize("NFC", value), na_action="ignore")


@F.pandas_udf(StringType())
def _resolved(text: pd.Series) -> pd.Series:
    """Resolve character references; the standard library holds the full table."""
    return text.map(html.unescape, na_action="ignore")


# Blocks without combining marks or characters that composing replaces: Latin and its extensions, Cyrillic, dashes, quotes, the dong sign.
COMPOSED = r"^[\x{0000}-\x{02FF}\x{0400}-\x{0482}\x{048A}-\x{052F}\x{1E00}-\x{1EFF}\x{2010}-\x{2027}\x{20AB}]*$"


def nfc(text: Column) -> Column:
    """Compose accents; Spark SQL has no normalisation function, so texts outside ``COMPOSED``, and only those, go through Python."""
    return F.coalesce(_composed(F.when(~text.rlike(COMPOSED), text)), text)


def unescape(text: Column) -> Column:
    """Resolve character references; only texts with an ampersand go through Python."""
    return F.coalesce(_resolved(F.when(F.contains(text, F.lit("&")), text)), text)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(UNICODE + pattern), F.lit(False))


def spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def fold(text: Column) -> Column:
    """Matching key of composed text: lower case, single spaces, NULL as empty."""
    return F.lower(spaced(F.coalesce(text.cast("string"), F.lit(""))))


def search_key(text: Column) -> Column:
    return F.lower(F.translate(text, V.ACCENTED, V.PLAIN))


def parse_money(text: Column) -> Column:
    """One whole VND amount or NULL.  Two prices are never glued together."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(text, "(?iu)vnd|vnđ|đ|₫", "")), "\u00a0", "")
    shape = bare.rlike(r"^(?:[1-9]\d*|[1-9]\d{0,2}(?:[., ]\d{3})+)$")
    amount = F.regexp_replace(bare, "[., ]", "").try_cast("bigint")
    return F.when(shape & amount.between(V.MIN_VND, V.MAX_VND), amount)


def money_text(amount: Column, unit: str = "đ") -> Column:
    return F.concat(F.translate(F.format_number(amount, 0), ",", "."), F.lit(unit))


def _hundredths_text(hundredths: Column) -> Column:
    return F.concat(F.floor(hundredths / 100), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def millions_text(amount: Column) -> Column:
    """Two decimals at most, rounded half up in whole numbers, decimal comma, trailing zeros dropped."""
    fixed = _hundredths_text(F.floor((amount + 5000) / 10_000))
    return F.concat(F.translate(F.regexp_replace(fixed, r"\.?0+$", ""), ".", ","), F.lit(" tr"))


def percent_text(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, two decimals, rounded half up in whole numbers."""
    return F.when(whole > 0, _hundredths_text(F.floor((part.cast("bigint") * 20_000 + whole) / F.nullif(whole * 2, F.lit(0)))))


def first_match(text: Column, classes: list[tuple[str, str]], default: Column) -> Column:
    """Label of the first class whose pattern is found."""
    return reduce(lambda rest, item: F.when(matches(text, item[1]), F.lit(item[0])).otherwise(rest),
                  reversed(classes), default)


def error_kind(reason: Column) -> Column:
    text = F.coalesce(reason, F.lit(""))
    return F.when(text.startswith(V.TECHNICAL_PREFIX), F.lit("technical")).otherwise(
        first_match(text, V.ERROR_KINDS, F.lit("other")))


def link_check_kind(reason: Column) -> Column:
    return first_match(F.coalesce(reason, F.lit("")), V.LINK_CHECK_KINDS, F.lit("access_error"))


def annotate(notes: Column, status: Column) -> Column:
    """Status line first, then the notes."""
    head = F.concat(F.lit(V.STATUS_PREFIX), status)
    tail = F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("\n"), notes)).otherwise("")
    return F.when(F.coalesce(status, F.lit("")) != "", F.concat(head, tail)).otherwise(F.coalesce(notes, F.lit("")))


def status_of(promo_text: Column) -> Column:
    first_line = F.substring_index(promo_text, "\n", 1)
    return F.when(promo_text.startswith(V.STATUS_PREFIX),
                  F.substr(first_line, F.lit(len(V.STATUS_PREFIX) + 1))).otherwise("")


def has_status(promo_text: Column) -> Column:
    return F.coalesce(promo_text.startswith(V.STATUS_PREFIX), F.lit(False))


def explicit_status(*fields: Column) -> Column:
    """First field that is a known code or contains a status phrase; nothing is inferred from stock."""
    def read(field: Column) -> Column:
        low = F.lower(field)
        coded = reduce(lambda rest, item: F.when(low == item[0], F.lit(item[1])).otherwise(rest),
                       V.STATUS_CODES.items(), F.lit(None).cast("string"))
        phrase = reduce(lambda a, b: a | b, (low.contains(p) for p in V.STATUS_PHRASES))
        return F.coalesce(coded, F.when(phrase, spaced(field)))
    return F.coalesce(*(read(f) for f in fields))


def strip_tags(markup: Column) -> Column:
    return F.regexp_replace(markup, "<[^>]+>", " ")


def ordered_distinct(values: Column) -> Column:
    """Non-empty values, first occurrence kept."""
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))


def clean_notes(markup: Column) -> Column:
    """Markup to distinct note lines in first-seen order.

    The text is unescaped once as a whole; line breaks in the markup become a private separator first, so that the
    Python function runs once per row whatever the number of notes.
    """
    parts = F.regexp_replace(markup, r"(?i)</p>|<br\s*/?>", "\u0001")
    text = unescape(strip_tags(parts))
    return F.array_join(ordered_distinct(F.transform(F.split(text, "\u0001"), spaced)), "\n")
