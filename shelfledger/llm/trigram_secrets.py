"""Secret scan over an inverted index of trigrams, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived; postings of the trigrams that the rules need are kept per block
of rows, so that a trigram found in every text is split; the query intersects and unites postings inside a block, and the regex
verifies the candidates.  A rule without a mandatory trigram reads every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.shared import sheltering, text_of

MOST_STRINGS = 64  # exact alternatives followed through a sequence; beyond them the query is only weaker
ROWS_PER_BLOCK = 1024


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # read alike by Java and Python; may hold groups
    least: int = 0  # fewest characters of ``group``; shorter matches are dropped after matching
    group: int = 0
    base: bool = False


# The base kinds.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, True),
    Rule("hex", r"[0-9a-f]+", 16, 0, True),
)
# Public token formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~-]{6,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES


# -- Boolean queries -------------------------------------------------------------------------------------------------------

def _exact(tree) -> set[str] | None:
    """All strings a parsed sequence can match, if there are few of them."""
    found = {""}
    for op, arg in tree:
        if op is C.LITERAL:
            here = {chr(arg)}
        elif op is C.SUBPATTERN:
            here = _exact(arg[3])
        elif op is C.BRANCH:
            parts = [_exact(branch) for branch in arg[1]]
            here = None if None in parts else set().union(*parts)
        elif op is C.IN and all(kind is C.LITERAL for kind, _ in arg):
            here = {chr(value) for _, value in arg}
        elif op is C.MAX_REPEAT and arg[1] == 1:
            once = _exact(arg[2])
            here = None if once is None else (once | {""} if arg[0] == 0 else once)
        else:
            return None
        if here is None or len(found) * len(here) > MOST_STRINGS:
            return None
        found = {a + b for a, b in product(found, here)}
    return found


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """AND of ORs of trigram sets (each set an AND) that every match of ``regex`` satisfies, in lower case; [] if none is known."""
    clauses: list[list[frozenset[str]]] = []
    run = {""}

    def flush() -> None:
        nonlocal run
        sets = {frozenset(s.lower()[i:i + 3] for i in range(len(s) - 2)) for s in run}
        least = [s for s in sets if not any(other < s for other in sets)]
        if least and all(least):
            clauses.append(sorted(least, key=sorted))
        run = {""}

    def walk(tree) -> None:
        nonlocal run
        for item in tree:
            here = _exact([item])
            if here is not None and len(run) * len(here) <= MOST_STRINGS:
                run = {a + b for a, b in product(run, here)}
                continue
            op, arg = item
            flush()
            if here is not None:
                run = here
            elif op is C.SUBPATTERN:
                walk(arg[3])
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                walk(arg[2])
                flush()

    walk(_parser.parse(regex))
    flush()
    return clauses


def needed_trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for clause in trigram_query(r.regex) for one in clause for t in one})


# -- index and search ------------------------------------------------------------------------------------------------------

def row_key(row_id: str, text: str = "text") -> Column:
    """One number for a row; rows alike in id and text share it and have the same secrets."""
    return F.xxhash64(F.col(row_id), text_of(text))


def postings(docs: DataFrame, trigrams: list[str], row_id: str = "doc_id", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(block, trigram, rows): keys of the block's rows whose lower-cased text holds the trigram."""
    blocks = max(1, -(-docs.count() // rows_per_block))
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # The lower-cased text is bound as a lambda variable, so that it is made once and not again for each trigram.
    held = F.flatten(F.transform(F.array(F.lower(text_of())), lambda low: F.filter(wanted, lambda t: F.contains(low, t))))
    keyed = docs.select(row_key(row_id).alias("_key"), held.alias("_held"))
    return (keyed.select("_key", F.pmod("_key", F.lit(blocks)).alias("block"), F.explode("_held").alias("trigram"))
            .groupBy("block", "trigram").agg(F.collect_set("_key").alias("rows")))


def _all_of(lists: list[Column]) -> Column:
    out = lists[0]
    for x in lists[1:]:
        out = F.array_intersect(out, x)
    return out


def _any_of(lists: list[Column]) -> Column:
    out = lists[0]
    for x in lists[1:]:
        out = F.array_union(out, x)
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(_key, kinds): rows that satisfy the Boolean query of at least one rule with mandatory trigrams."""
    empty = F.array().cast("array<bigint>")
    book = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "rows"))).alias("_book"))
    asked = {r.kind: trigram_query(r.regex) for r in rules}
    found = [F.struct(F.lit(kind).alias("kind"), _all_of([
        _any_of([_all_of([F.coalesce(F.col("_book")[t], empty) for t in sorted(one)]) for one in clause]) for clause in query
    ]).alias("rows")) for kind, query in asked.items() if query]
    hits = book.select(F.explode(F.array(*found)).alias("_hit")).select("_hit.kind", F.explode("_hit.rows").alias("_key"))
    return hits.groupBy("_key").agg(F.collect_set("kind").alias("kinds"))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches as structs (start, end) in code points.

    ``\\G`` chains each match to the end of the one before, so the lengths of the gaps and matches add up to positions and the
    rest of a text is read once.
    """
    gap = rf"\G([\s\S]*?)(?:{rule.regex})"
    whole = rf"\G[\s\S]*?({rule.regex})"
    kept = rule.group + 1 if rule.group else 1
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(gap), 1).alias("gap"), F.regexp_extract_all(text, F.lit(whole), 1).alias("hit"),
                         F.regexp_extract_all(text, F.lit(whole), kept).alias("kept"))
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(part["kept"]) >= rule.least, F.concat(state["out"], one))
                        .otherwise(state["out"]).alias("out"))

    spans = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(F.rlike(text, F.lit(rule.regex)), spans).otherwise(none)


def _quick(rule: Rule) -> str:
    """A cheaper regex that matches somewhere whenever the rule finds something long enough."""
    return rule.regex[:-1] + f"{{{rule.least}}}" if rule.base and rule.kind == "hex" else rule.regex


def _labelled(spans: Column, order: int, named: list[Column]) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), *named))


@sheltering("_key", "kinds")
def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, row_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``spans``, an array of (start, end, kind, base) ordered by start, then by the rules' order.

    A NULL or empty text has no spans.  Repeated rows are scanned alike.  Own columns replace input columns of the same name.
    """
    docs = docs.drop("spans").withColumn("_key", row_key(row_id))
    found = candidates(postings(docs, needed_trigrams(rules), row_id), rules)
    joined = docs.join(found, "_key", "left")
    text = text_of()
    none = F.array().cast("array<struct<start:int,end:int>>")
    lists = []
    for order, rule in enumerate(rules):
        asked = F.array_contains("kinds", rule.kind) if trigram_query(rule.regex) else F.rlike(text, F.lit(_quick(rule)))
        spans = F.when(asked, rule_spans(text, rule)).otherwise(none)
        named = [F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base")]
        lists.append(_labelled(spans, order, named))
    ordered = F.sort_array(F.concat(*lists))
    return joined.withColumn("spans", F.transform(ordered, lambda x: F.struct(x["start"], x["end"], x["kind"], x["base"]))).drop("_key", "kinds")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
