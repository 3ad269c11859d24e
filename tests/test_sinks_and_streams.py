"""Write paths and streams on real folders."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from shelfledger.functions import calendar as cal
from shelfledger.operators import history as H
from shelfledger.operators import movement as M
from shelfledger.operators.quality import GateFailed
from shelfledger.sinks import tables as S
from shelfledger.sources import artifacts, rules, seeds
from shelfledger.streaming import jobs as J
from shelfledger.streaming.batches import Batches

PRICES = ("seq bigint, chain string, sku string, product_name string, promo_price bigint, original_price bigint, promo_text string, "
          "source_url string")


def prices(spark, *rows):
    return spark.createDataFrame([(i, "TGDD", sku, "n", price, None, "", "u") for i, (sku, price) in enumerate(rows)], PRICES)


def header(run, day, expected):
    return {"run_id": run, "chain": "TGDD", "year": 2024, "week": 2, "expected_count": expected,
            "completed_at": dt.datetime.fromisoformat(day)}


def test_commit_run(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("weekly", "history", "issues", "runs")}
    issues = spark.createDataFrame([("TGDD", "z", None, None, None, None, "HTTP 502")],
                                   "chain string, sku string, product_name string, category string, brand string, error_kind string, reason string")
    S.commit_run(spark, prices(spark, ("a", 10), ("b", 20)), issues, header("r1", "2024-01-08 20:00:00", 3), paths)
    S.commit_run(spark, prices(spark, ("a", 15), ("c", 5)), issues, header("r2", "2024-01-09 03:00:00", 3), paths)
    weekly = {r.sku: r.promo_price for r in spark.read.parquet(paths["weekly"]).collect()}
    assert weekly == {"a": 15, "b": 20, "c": 5}
    history = spark.read.parquet(paths["history"])
    assert {(r.sku, str(r.business_date)) for r in history.collect()} == {
        ("a", "2024-01-09"), ("b", "2024-01-09"), ("c", "2024-01-09")}
    assert history.count() == 4 and spark.read.parquet(paths["runs"]).count() == 2
    S.commit_run(spark, prices(spark, ("a", 15), ("c", 5)), issues, header("r2", "2024-01-09 03:00:00", 3), paths)
    assert spark.read.parquet(paths["history"]).count() == 4 and spark.read.parquet(paths["runs"]).count() == 2
    half = dict(paths, runs=str(tmp_path / "other"))  # a try that lost its header is replaced, not doubled
    S.commit_run(spark, prices(spark, ("a", 15), ("c", 5)), issues, header("r2", "2024-01-09 03:00:00", 3), half)
    assert spark.read.parquet(paths["history"]).count() == 4 and spark.read.parquet(paths["issues"]).count() == 2
    with pytest.raises(GateFailed):
        S.commit_run(spark, prices(spark, ("a", 0)), issues, header("r3", "2024-01-09 03:00:00", 2), paths)
    assert spark.read.parquet(paths["runs"]).count() == 2


def test_a_run_is_computed_once_and_a_failing_one_has_no_header(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("weekly", "history", "issues", "runs")}
    issues = spark.createDataFrame([], "chain string, sku string, product_name string, category string, brand string, error_kind string, reason string")
    passes = spark.sparkContext.accumulator(0)

    def counted(df):
        def work(batches):
            for batch in batches:
                passes.add(batch.num_rows)
                yield batch
        return df.mapInArrow(work, df.schema)

    good = [(f"k{i}", 10 + i) for i in range(6)]
    for bad, expected in (([("a", 0)], 7), ([("k0", 5)], 7), ([], 9), ([("z", -5)], 7), (None, 0)):  # no row at all, no price, a repeated SKU, a wrong number, a negative price
        with pytest.raises(GateFailed):
            S.commit_run(spark, prices(spark, *good, *bad) if bad is not None else prices(spark, *good).limit(0), issues, header("7", "2024-01-08 20:00:00", expected), paths)
        assert not S.committed(spark, "7", paths["runs"]) and not (tmp_path / "weekly").exists()
    S.commit_run(spark, counted(prices(spark, *good)), issues, header("7", "2024-01-08 20:00:00", 6), paths)
    assert passes.value == 6 and S.committed(spark, "7", paths["runs"])
    assert spark.read.parquet(paths["runs"]).first().product_count == 6
    assert spark.read.parquet(paths["history"]).count() == spark.read.parquet(paths["weekly"]).count() == 6  # what failed is replaced


def test_snapshot_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "snap")
    rows = lambda day, price: prices(spark, ("a", price)).withColumn("business_date", F.lit(day).cast("date"))
    S.publish_snapshot(rows("2024-01-01", 1).union(rows("2024-01-02", 2)), path)
    S.publish_snapshot(rows("2024-01-02", 9), path)
    assert {(str(r.business_date), r.promo_price) for r in spark.read.parquet(path).collect()} == {
        ("2024-01-01", 1), ("2024-01-02", 9)}


def test_publish_catalog(spark, tmp_path):
    path = str(tmp_path / "catalog")
    rows = spark.createDataFrame([("r1", "TGDD", "https://a", "ready"), ("r1", "TGDD", "https://b", "review")],
                                 "run_id string, chain string, source_url string, status string")
    S.publish_catalog(rows, path)
    assert spark.read.parquet(path).count() == 2
    for bad in (rows.filter("status = 'review'"), rows.union(rows), rows.withColumn("source_url", F.lit("http://a")),
                rows.withColumn("chain", F.col("source_url"))):
        with pytest.raises(GateFailed):
            S.publish_catalog(bad, path)


def test_artifacts_rules_and_seeds_from_files(spark, tmp_path):
    for slug, status, time in (("tgdd", "ok", None), ("fpt", "failed", None), ("phongvu", "degraded", "2024-01-07T23:00:00+07:00")):
        folder = tmp_path / "out" / slug
        folder.mkdir(parents=True)
        (folder / "summary.json").write_text(json.dumps({"chain": slug, "stage": "prices", "status": status,
                                                         "finished_at": "2024-01-07T17:30:00Z"}))
        (folder / "prices.json").write_text(json.dumps([{"sku": slug + "-1", "observed_at": time}]))
    schema = spark.createDataFrame([], "sku string, observed_at string").schema
    got = {r.sku: (str(r.business_date), str(r.week_start)) for r in artifacts.read_results(spark, str(tmp_path / "out"), schema).collect()}
    assert got == {"tgdd-1": ("2024-01-08", "2024-01-08"), "phongvu-1": ("2024-01-07", "2024-01-01")}

    (tmp_path / "rules.json").write_text(json.dumps({"models": [{"name": "iPhone 19", "pattern": r"\biphone\s+19\b"}]}))
    assert rules.read_model_rules(spark, str(tmp_path / "rules.json")) == [("iPhone 19", r"\biphone\s+19\b")]
    (tmp_path / "prefs.json").write_text(json.dumps({"products": [{"model": "A"}, {"model": " a "}]}))
    with pytest.raises(ValueError):
        rules.read_preferences(spark, str(tmp_path / "prefs.json"))
    (tmp_path / "scope.json").write_text(json.dumps({"version": 1, "brands": ["Apple"]}))
    assert rules.read_brand_scope(spark, str(tmp_path / "scope.json")) == ["Apple"]
    (tmp_path / "seeds.csv").write_text("chain,category,brand,url,input_sheet,input_row\n"
                                        "TGDD,Điện thoại, Apple ,https://thegioididong.com/a,s,2\n"
                                        "TGDD,Điện thoại,Apple,https://thegioididong.com/a,s,3\nTGDD,,Apple,https://thegioididong.com/b,s,4\n")
    good, bad = seeds.seed_sources(seeds.read_seeds(spark, str(tmp_path / "seeds.csv")))
    assert [r.input_row for r in good.collect()] == [2] and [r.input_row for r in bad.collect()] == [4]


def batch(spark, rows):
    data = [(s, "TGDD", k, "m", "s", "", "x", dt.datetime.fromisoformat(t), p) for s, k, t, p in rows]
    df = spark.createDataFrame(data, "seq bigint, chain string, sku string, model string, storage string, display_variant string, "
                                     "color string, observed_at timestamp_ntz, promo_price bigint")
    return df.withColumn("business_date", cal.business_date(F.col("observed_at")))


BATCHES = [
    [(1, "a", "2024-01-01 03:00", 100), (2, "a", "2024-01-02 05:00", 90), (3, "b", "2024-01-01 03:00", 10)],
    [(4, "a", "2024-01-02 04:00", 1), (5, "b", "2024-01-02 03:00", 20)],  # the first row is late and older
    [(6, "a", "2024-01-02 05:00", 80)],  # same instant, arrives later
]


def run(spark, tmp_path, start):
    """Feed the batches file by file through one checkpoint."""
    source = tmp_path / "in"
    schema = batch(spark, BATCHES[0]).schema
    for rows in BATCHES:
        batch(spark, rows).coalesce(1).write.mode("append").parquet(str(source))
        query = start(J.read_stream(spark, str(source), schema))
        query.awaitTermination()
        assert query.exception() is None
    return schema


def test_stream_history_equals_batch_merge(spark, tmp_path):
    path, check = str(tmp_path / "history"), str(tmp_path / "check")
    schema = run(spark, tmp_path, lambda s: J.stream_history(s, path, check))
    merged = batch(spark, []).limit(0)
    for rows in BATCHES:
        merged = H.merge_history(merged, batch(spark, rows))
    want = {r.seq for r in merged.collect()}
    assert {r.seq for r in J.read_history(spark, path, schema).collect()} == want == {1, 3, 5, 6}


def test_stream_alerts(spark, tmp_path):
    state, alerts, check = (str(tmp_path / n) for n in ("state", "alerts", "check"))
    run(spark, tmp_path, lambda s: J.stream_alerts(s, state, alerts, check))
    got = {(r.sku, r.before_price, r.after_price) for r in J.read_alerts(spark, alerts).collect()}
    whole = batch(spark, [r for rows in BATCHES for r in rows])
    want = {(r.sku, r.before_price, r.after_price) for r in M.day_movements(whole).collect()}
    assert got == want == {("a", 100, 90), ("b", 10, 20)}


def test_alerts_follow_late_corrections(spark, tmp_path):
    """A correction of day 1 changes the movement of day 2; a correction of day 2 may take it back."""
    steps = [[(1, "a", "2024-01-01 03:00", 100_000), (2, "a", "2024-01-02 03:00", 200_000)], [(3, "a", "2024-01-01 09:00", 150_000)],
             [(4, "a", "2024-01-02 09:00", 150_000)]]
    state, alerts, check = (str(tmp_path / n) for n in ("state", "alerts", "check"))
    source, seen, rows = tmp_path / "in", [], []
    schema = batch(spark, BATCHES[0]).schema
    for step in steps:
        rows += step
        batch(spark, step).coalesce(1).write.mode("append").parquet(str(source))
        query = J.stream_alerts(J.read_stream(spark, str(source), schema), state, alerts, check)
        query.awaitTermination()
        got = {(str(r.business_date), r.delta) for r in J.read_alerts(spark, alerts).collect()}
        assert got == {(str(r.business_date), r.delta) for r in M.day_movements(batch(spark, rows)).collect()}
        seen.append(got)
    assert seen == [{("2024-01-02", 100_000)}, {("2024-01-02", 50_000)}, set()]


def test_batches_are_merged_level_by_level(spark, tmp_path):
    """Thirteen batches with a fan of three: few folders, the same rows, and a repeated batch changes nothing."""
    path = str(tmp_path / "table")
    store = Batches(path, J.history_batches(path).merge, ("business_date",), fan=3)
    rng, merged, schema = random.Random(1), None, None
    for i in range(13):
        rows = batch(spark, [(100 * i + j, rng.choice("abc"), f"2024-01-0{rng.randint(1, 4)} {rng.randint(0, 9):02d}:00", rng.randint(1, 99)) for j in range(4)])
        schema = rows.schema
        reduced = store.merge(rows.withColumn("batch", F.lit(i))).drop("batch")
        for _ in range(2 if i == 8 else 1):
            store.add(reduced, i)
        merged = reduced if merged is None else H.merge_history(merged, rows)
        merged = spark.createDataFrame(merged.select(schema.names).collect(), schema)
        assert len(store.folders(i + 1)) <= 2 * 3
    assert store.written(spark) == 13 and store.folders(13) == [f"{path}/level=2/from=0", f"{path}/level=1/from=9", f"{path}/level=0/from=12"]
    assert {r.seq for r in store.merge(store.read(spark, schema)).collect()} == {r.seq for r in merged.collect()}
    assert len(list((tmp_path / "table" / "level=0").iterdir())) <= 7 and len(Batches("p", None).folders(1000)) == 3 + 14 + 8


def test_a_late_row_reads_its_own_days_only(spark, tmp_path):
    """One row of last year beside rows of today: the state is read for the days around both, not for the year between."""
    assert J.days_around([dt.date(2024, 3, 1), dt.date(2023, 3, 1)]) == [
        dt.date(2023, 2, 28), dt.date(2023, 3, 1), dt.date(2023, 3, 2), dt.date(2024, 2, 29), dt.date(2024, 3, 1), dt.date(2024, 3, 2)]
    store = J.state_batches(str(tmp_path / "state"))
    rows = batch(spark, [(i, "a", f"2024-0{1 + i // 28}-{1 + i % 28:02d} 03:00", i + 1) for i in range(200)])
    store.add(rows, 0)
    found = store.read(spark, rows.schema).filter(F.col("business_date").isin(J.days_around([dt.date(2024, 1, 5), dt.date(2024, 6, 5)])))
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [business_date" in scan and found.count() == 6


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    """A day with a third of all rows, or all of them, is no single task's file."""
    keep = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000).selectExpr("id AS seq", "'TGDD' AS chain", "date_add(date'2024-01-01', int(if(id % 3 = 0, 0, id % 30))) AS business_date",
                                              "cast(rand(1) AS string) AS text")
        S.publish_snapshot(rows, str(tmp_path / "days"))
        hot = list((tmp_path / "days" / "business_date=2024-01-01" / "chain=TGDD").glob("*.parquet"))
        assert len(hot) > 4
        assert spark.read.parquet(str(tmp_path / "days")).count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", keep)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_keys_are_broadcast(spark):
    """A week's history or a day's load is not dealt by its week or day, whatever the planner thinks of the sizes."""
    rows = spark.range(100).selectExpr("concat('a', id % 2) AS chain", "id AS seq", "2024 + id % 3 AS year", "id % 3 AS week", "date'2024-01-03' AS business_date",
                                       "timestamp_ntz'2024-01-03 05:00:00' AS observed_at")
    weeks = S.touched_weeks(rows, rows.filter("week = 1"))
    assert "LeftSemi, BuildRight" in plan(weeks) and weeks.count() == 33
    good = S.import_history(rows, rows.limit(0), F.lit("2024-02-01").cast("timestamp_ntz"))
    assert "LeftSemi, BuildRight" in plan(good) and good.count() == 100


def test_state_has_few_files_a_day(spark, tmp_path):
    store = J.state_batches(str(tmp_path))
    rows = spark.range(400).repartition(8).selectExpr("id AS seq", "date_add(date'2024-01-01', cast(id % 3 AS int)) AS business_date")
    store.add(rows, 0)
    assert [len(list(day.glob("*.parquet"))) for day in (tmp_path / "level=0" / "from=0").glob("business_date=*")] == [1, 1, 1]
    assert store.read(spark, rows.schema).count() == 400


def test_an_arrival_is_one_batch(spark, tmp_path, monkeypatch):
    from shelfledger.plans import stream_queries

    spark.range(90).selectExpr("id AS event_id", "timestamp_ntz'2024-01-03 05:00:00' AS ts", "id AS user_id", "'click' AS event_type", "1D AS value",
                               """'{"k": 1}' AS props""").repartition(6).write.parquet(f"{tmp_path}/events.parquet")
    seen = {}
    read = J.read_stream

    def kept(session, path, schema, files_per_batch):
        seen.update(files=len(session.read.parquet(path).inputFiles()), most=files_per_batch)
        return read(session, path, schema, files_per_batch=files_per_batch)
    monkeypatch.setattr(J, "read_stream", kept)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "134217728")  # each file is a task, so an arrival has several files
    try:
        stream_queries.stream(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert seen["files"] > 3 and -(-seen["files"] // seen["most"]) == 3
