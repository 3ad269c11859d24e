"""Snapshots compared through a tree of order-free sums.

Rows are dealt into ``FAN ** LEVELS`` leaves by the hash of their key; a node of the tree is the sum of its rows' digests.  Two snapshots are
compared from the top: only children of nodes that differ are looked at, and only rows of leaves that differ are joined, so finding few
changes in a large snapshot reads few leaves.  The tree is a small table kept beside the snapshot, which is partitioned by ``branch``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN, LEVELS = 16, 3


def leaf(keys: Sequence[str]) -> Column:
    """Number of the leaf; its upper digits in base ``FAN`` are its ancestors."""
    return F.pmod(F.xxhash64(*keys), F.lit(FAN ** LEVELS)).cast("int")


def digest(columns: Sequence[str]) -> Column:
    """128 bits of the row as two numbers; NULL and empty differ."""
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.struct(F.xxhash64(text).alias("one"), F.xxhash64(F.lit("two"), text).alias("two"))


def with_leaves(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``leaf`` and ``branch`` (the leaf's ancestor on the first level), by which a snapshot is partitioned."""
    return rows.withColumn("leaf", leaf(keys)).withColumn("branch", F.floor(F.col("leaf") / FAN ** (LEVELS - 1)).cast("int"))


def tree(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(level, node, n, one, two) of rows with ``leaf``: sums of the digests of every node, the root at level 0.  At most a few thousand rows."""
    d = rows.select("leaf", digest(columns).alias("d"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c.split(".")[-1])
    leaves = d.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), wide("d.one"), wide("d.two"))
    levels = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    node = F.floor(F.col("leaf") / F.pow(F.lit(FAN), LEVELS - F.col("level"))).cast("int")
    return levels.groupBy("level", node.alias("node")).agg(F.sum("n").alias("n"), wide("one"), wide("two"))


def changed_nodes(before: DataFrame, after: DataFrame) -> list[list[int]]:
    """Per level the nodes that differ, found from the top: a level is read only below nodes that differ above."""
    out: list[list[int]] = []
    for level in range(LEVELS + 1):
        mine, other = ((t.filter(F.col("level") == level).filter(F.floor(F.col("node") / FAN).isin(out[-1])) if level else t.filter("level = 0"))
                       for t in (before, after))
        b = other.select("node", F.struct("n", "one", "two").alias("after"))
        pairs = mine.select("node", F.struct("n", "one", "two").alias("before")).join(b, "node", "full")
        out.append(sorted(r.node for r in pairs.filter(~F.col("before").eqNullSafe(F.col("after"))).select("node").collect()))
        if not out[-1]:
            break
    return out


def snapshot_diff(before: DataFrame, after: DataFrame, trees: tuple[DataFrame, DataFrame], keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(keys, change): ``added``, ``missing`` or ``changed`` rows of ``after`` against ``before`` (one row per key, with ``leaf`` and ``branch``).

    Filters on ``branch`` and ``leaf`` prune what the changed leaves don't need.
    """
    nodes = changed_nodes(*trees)
    leaves = nodes[LEVELS] if len(nodes) > LEVELS else []
    branches = nodes[1] if len(nodes) > 1 else []
    near = lambda df: df.filter(F.col("branch").isin(branches) & F.col("leaf").isin(leaves))
    a, b = (near(df).select(*keys, digest(columns).alias(n)) for df, n in ((before, "was"), (after, "now")))
    both = a.join(b, list(keys), "full")
    change = (F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "missing").when(F.col("was") != F.col("now"), "changed"))
    return both.select(*keys, change.alias("change")).filter("change IS NOT NULL")
