"""Plans and results when one key holds most rows."""

import pytest
from pyspark.sql import functions as F

from shelfledger.operators import catalog as K
from shelfledger.operators import skew
from shelfledger.operators.latest import first_per_key, latest_group


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.range(20_000).selectExpr("id AS seq", "if(id % 3 = 0, 'hot', concat('k', id % 997)) AS key", "id % 7 AS v")


def test_latest_is_limited_before_the_shuffle(skewed):
    text = plan(first_per_key(skewed, ["key"], [F.col("v").desc(), F.col("seq")]))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_latest_group_aggregates_first(skewed):
    got = latest_group(skewed, ["key"], "v")
    assert "partial_max" in plan(got)
    assert got.filter("key = 'hot'").count() == skewed.filter("key = 'hot' AND v = 6").count()


def test_group_facts_run_no_job_while_the_plan_is_built(spark, skewed):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup())
    got = skew.with_group_facts(skewed, ["key"], n=F.count(F.lit(1)))
    assert set(tracker.getJobIdsForGroup()) == before
    assert got.filter("key = 'hot'").select("n").distinct().collect()[0].n == 6667


def test_representatives_with_a_hot_group(spark):
    rows = spark.range(3000).selectExpr(
        "id AS seq", "'FPT Shop' AS chain", "if(id < 1000, 'hot', concat('g', id % 500)) AS group_key", "false AS tracked",
        "lpad(cast(id AS string), 6, '0') AS variant_id", "'u' AS source_url", "cast(id % 2 AS bigint) AS stock",
        "cast(if(group_key = 'g7', id, 100) AS bigint) AS listing_price", "'' AS listing_status")
    chosen = K.representatives(rows).filter("chosen")
    assert [r.seq for r in chosen.filter("group_key = 'hot'").collect()] == [1]
    assert chosen.filter("group_key = 'g7'").count() == rows.filter("group_key = 'g7'").count()
    assert chosen.count() == K.representatives(rows).filter("chosen").count()


def test_shared_skus(spark):
    rows = spark.createDataFrame(
        [(1, "TGDD", "s", "u1", "ready", "", True, ["p1"]), (2, "TGDD", "s", "u2", "ready", "", True, ["p2"]),
         (3, "FPT Shop", "s", "u1", "ready", "", True, ["p1"]), (4, "TGDD", "t", "u3", "ready", "", True, ["b"]),
         (5, "TGDD", "t", "u3", "ready", "", True, ["a"])],
        "seq bigint, chain string, sku string, source_url string, status string, reason string, verified boolean, "
        "listing_urls array<string>")
    got = {r.seq: (r.status, r.verified, r.listing_urls) for r in K.reject_shared_skus(rows).collect()}
    assert got == {1: ("review", False, ["p1"]), 2: ("review", False, ["p2"]), 3: ("ready", True, ["p1"]),
                   4: ("ready", True, ["a", "b"])}
    links = {r.seq: (r.status, r.listing_urls) for r in K.dedupe_links(rows.withColumn("status", F.when(
        F.col("seq") == 4, "review").otherwise("ready"))).collect()}
    assert links == {1: ("ready", ["p1"]), 2: ("ready", ["p2"]), 3: ("ready", ["p1"]), 5: ("ready", ["a", "b"])}


def test_round_robin_covers_sources(spark):
    rows = spark.createDataFrame([(i, 1 if i < 50 else (2 if i < 52 else None)) for i in range(60)], "seq bigint, input_row bigint")
    got = [r.input_row for r in K.round_robin(rows, 6).collect()]
    assert got == [1, 2, None, 1, 2, None]


def test_latest_by_day_is_hashed(spark):
    """Aggregations of the newest record keep fixed-width buffers, so no task sorts its raw rows."""
    from shelfledger.operators import history as H
    from shelfledger.operators import movement as M
    rows = spark.createDataFrame([], "seq bigint, chain string, sku string, model string, storage string, display_variant string, color string, "
                                 "observed_at timestamp_ntz, business_date date, week_start date, promo_price bigint, promo_text string")
    for df in (M.day_movements(rows), M.week_movements(rows), H.day_grid(rows), H.week_change(rows), H.week_change(rows, ["promo_text"])):
        assert "SortAggregate" not in plan(df)
