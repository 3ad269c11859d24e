"""Queries over tables that are kept up to date: change sets, sketches, snapshot trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfledger.operators import distinct as D
from shelfledger.operators import hash_tree as H
from shelfledger.operators.maintain import Maintained
from shelfledger.plans.carriers import observations
from shelfledger.plans.history_queries import BIG, MOVES, text_date
from shelfledger.plans.registry import query
from shelfledger.plans.sink_queries import folder
from shelfledger.sinks import tables as S

BATCHES = 3


def maintained(spark, sf) -> Maintained:
    """All observations as batches that each touch every day, the last ones first."""
    table, rows = Maintained(folder(spark)), observations(spark, sf)
    for part in reversed(range(BATCHES)):
        table.apply(rows.filter(F.col("seq") % BATCHES == part))
    return table


@query("jon5_maintained_day_movement", f"""WITH {MOVES} SELECT CAST(business_date AS VARCHAR) AS business_date, chain, sku, color, before_price,
 after_price, delta, {BIG} AS shock FROM moves""", "obs")
def _(spark, sf):
    return maintained(spark, sf).day_movements(spark).select(text_date("business_date"), "chain", "sku", "color", "before_price", "after_price", "delta", "shock")


@query("agg4_distinct_sketches", """SELECT chain, count(DISTINCT sku) AS skus, count(DISTINCT model) AS models, TRUE AS close FROM obs GROUP BY chain""", "obs")
def _(spark, sf):
    """One sketch per chain and day is kept; merged over all days it must be within a twentieth of the exact counts."""
    path, rows = folder(spark), observations(spark, sf)
    S.write_parts(D.sketches(rows, ["chain", "business_date"], skus="sku", models="model"), path, "business_date")
    about = D.estimates(D.merged(spark.read.parquet(path), ["chain"], "skus", "models"), "skus", "models")
    exact = D.exact_counts(rows, ["chain"], skus="sku", models="model")
    near = lambda c: F.abs(about[c] - exact[c]) * 20 <= exact[c]
    return exact.join(about, "chain").select("chain", exact["skus"], exact["models"], (near("skus") & near("models")).alias("close"))


@query("agg15_snapshot_changes", """WITH a AS (SELECT sku, chain, arg_max(promo_price, seq) AS p FROM obs WHERE k <= 80 GROUP BY ALL),
 b AS (SELECT sku, chain, arg_max(promo_price, seq) AS p FROM obs WHERE k <= 82 AND k <> 3 GROUP BY ALL),
 x AS (SELECT sku, chain, max(seq) AS s FROM obs WHERE k <= 80 GROUP BY ALL), y AS (SELECT sku, chain, max(seq) AS s FROM obs WHERE k <= 82 AND k <> 3 GROUP BY ALL)
SELECT coalesce(x.chain, y.chain) AS chain, coalesce(x.sku, y.sku) AS sku,
 CASE WHEN x.s IS NULL THEN 'added' WHEN y.s IS NULL THEN 'missing' ELSE 'changed' END AS change
FROM x FULL JOIN y ON x.sku = y.sku AND x.chain = y.chain WHERE x.s IS NULL OR y.s IS NULL OR x.s <> y.s""", "obs")
def _(spark, sf):
    """Two snapshots of the newest record per SKU, written with their trees and compared from the top."""
    rows, keys, columns = observations(spark, sf), ["chain", "sku"], ["seq", "promo_price"]

    def snapshot(df):
        path = folder(spark)
        newest = df.groupBy(*keys).agg(F.max(F.struct("seq", "promo_price")).alias("r")).select(*keys, "r.*")
        S.write_parts(H.with_leaves(newest, keys), f"{path}/rows", "branch")
        kept = spark.read.parquet(f"{path}/rows")
        H.tree(kept, columns).coalesce(1).write.parquet(f"{path}/tree")
        return kept, spark.read.parquet(f"{path}/tree")

    (before, old), (after, new) = snapshot(rows.filter("k <= 80")), snapshot(rows.filter("k <= 82 AND k <> 3"))
    return H.snapshot_diff(before, after, (old, new), keys, columns)
