"""Link tables against crawl rules.

A rule's text up to its first ``*`` is a literal prefix.  Each different target gives one row per prefix length that occurs in its
host's rules and is equi-joined to (host, prefix), so a host with ten thousand rules costs a target as many lookups as its rules have
lengths.  What follows a ``*`` is looked for piece by piece from left to right; no pattern is compiled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.functions import links as L
from shelfledger.operators.skew import attach


def agent_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Rules that count for ``agent``: a host's named group replaces its ``*`` group."""
    named = (F.col("agent") != "*") & F.contains(F.lit(agent.lower()), F.lower("agent"))
    rows = rules.withColumn("_named", named).filter(F.col("_named") | (F.col("agent") == "*"))
    best = rows.groupBy("host").agg(F.max("_named").alias("_best"))
    return rows.join(best, "host").filter("_named = _best").drop("_named", "_best", "agent")


def rule_prefixes(rules: DataFrame) -> DataFrame:
    """(host, prefix, pieces, whole, size, allow): the text before the first ``*``, the texts between the next ones, whether the rule
    ends its target, and its rank.  Each different rule is one row."""
    usable = rules.filter(F.coalesce("pattern", F.lit("")) != "")
    parts = F.split(F.regexp_replace("pattern", r"\$$", ""), r"\*")
    return usable.select("host", F.get(parts, F.lit(0)).alias("prefix"), F.slice(parts, 2, F.size(parts)).alias("pieces"),
                         F.endswith("pattern", F.lit("$")).alias("whole"), F.length("pattern").alias("size"), "allow").distinct()


def pieces_follow(target: Column, prefix: Column, pieces: Column, whole: Column) -> Column:
    """Whether the pieces occur in order after the prefix, the last one at the end if the rule ends its target.

    The leftmost place of each piece leaves the most room for the next, so no other place needs to be tried.
    """
    last = F.size(pieces) - 1
    inner = F.when(whole & (last >= 0), F.slice(pieces, 1, F.greatest(last, F.lit(0)))).otherwise(pieces)
    step = lambda at, piece: F.when(at > 0, F.when(piece == "", at).otherwise(
        F.call_function("locate", piece, target, at) + F.when(F.call_function("locate", piece, target, at) > 0, F.length(piece)).otherwise(0))).otherwise(at)
    after = F.aggregate(inner, F.length(prefix) + 1, step)  # one past the last piece found, 0 once a piece is missing
    tail = F.get(pieces, last)
    ends = F.when(last < 0, F.length(target) == F.length(prefix)).otherwise(
        F.endswith(target, tail) & (F.length(target) - F.length(tail) + 1 >= after))
    return (after > 0) & F.when(whole, ends).otherwise(F.lit(True))


def crawl_policy(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Pages with ``allowed`` and ``crawl_delay``: the longest matching rule wins, allow wins ties, default allow."""
    path = F.when(L.path(F.col("url")) == "", "/").otherwise(L.path(F.col("url")))
    query = L.query(F.col("url"))
    rows = pages.withColumn("host", L.host(F.col("url"))).withColumn(
        "_target", F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path))
    mine = agent_rules(rules, agent)
    delays = mine.groupBy("host").agg(F.max("delay").alias("crawl_delay"))
    prefixes = rule_prefixes(mine)
    lengths = prefixes.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("_lengths"))  # at most as many as a path is long
    targets = rows.select("host", "_target").distinct().join(lengths, "host")
    cut = targets.withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("_target"))))
    asked = cut.select("host", "_target", F.substr("_target", F.lit(1), F.col("_n")).alias("prefix"))
    hits = asked.join(prefixes, ["host", "prefix"]).filter(pieces_follow(F.col("_target"), F.col("prefix"), F.col("pieces"), F.col("whole")))
    best = hits.groupBy("host", "_target").agg(F.max(F.struct("size", "allow")).alias("_best"))
    judged = attach(attach(rows, best, ["host", "_target"]), delays, ["host"])
    return judged.withColumn("allowed", F.coalesce(F.col("_best.allow"), F.lit(True))).drop("_target", "_best")
