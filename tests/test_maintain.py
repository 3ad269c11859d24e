"""Change sets, mergeable counts and snapshot trees against whole recomputations."""

import random
import unicodedata

from pyspark.sql import functions as F

from shelfledger.functions import text as T
from shelfledger.operators import distinct as D
from shelfledger.operators import hash_tree as H
from shelfledger.operators import movement as M
from shelfledger.operators import quality as Q
from shelfledger.operators.maintain import DAILY, Maintained
from shelfledger.plans.carriers import observations
from shelfledger.sinks import tables as S

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stamps(folder):
    return {p.name: max(f.stat().st_mtime_ns for f in p.glob("*.parquet")) for p in folder.iterdir() if "=" in p.name}


def moves_of(df, period):
    return {(str(r[period]), r.chain, r.sku, r.model, r.color, r.storage, r.display_variant, r.before_price, r.after_price, r.delta, r.shock) for r in df.collect()}


def test_batches_in_any_order_give_the_whole_result(spark, tmp_path):
    rows = observations(spark, SF).cache()
    week = F.date_trunc("week", "business_date").cast("date")
    rng = random.Random(3)
    parts = list(range(6))
    rng.shuffle(parts)
    table = Maintained(str(tmp_path / "t"))
    for part in [*parts, parts[0]]:  # the first one is repeated
        table.apply(rows.filter(F.col("seq") % 6 == part))
    assert moves_of(table.day_movements(spark), "business_date") == moves_of(M.day_movements(rows), "business_date") != set()
    assert moves_of(table.week_movements(spark), "week_start") == moves_of(M.week_movements(rows.withColumn("week_start", week)), "week_start")


def test_only_touched_days_are_written(spark, tmp_path):
    table = Maintained(str(tmp_path / "t"))
    make = lambda *prices: spark.createDataFrame([("TGDD", "a", "m", "s", "", "x", p, None, n, day) for n, (day, p) in enumerate(prices)],
                                                 DAILY.replace("business_date date", "d string")).withColumn("business_date", F.col("d").cast("date")).withColumn(
        "observed_at", F.col("business_date").cast("timestamp_ntz"))
    table.apply(make(*[(f"2024-01-{d:02d}", 10_000 * d) for d in range(1, 29)]))
    days, moves = tmp_path / "t" / "daily", tmp_path / "t" / "days"
    before, moved = stamps(days), stamps(moves)
    correction = make(("2024-01-10", 990_000)).withColumn("seq", F.lit(-1).cast("bigint"))
    table.apply(correction)
    assert {d for d, t in stamps(days).items() if before[d] != t} == {"business_date=2024-01-10"}
    assert {d for d, t in stamps(moves).items() if moved.get(d) != t} == {"business_date=2024-01-10", "business_date=2024-01-11"}
    got = {str(r.business_date): r.delta for r in table.day_movements(spark).collect()}
    assert got["2024-01-10"] == 900_000 and got["2024-01-11"] == -880_000 and got["2024-01-12"] == 10_000
    table.apply(make(("2024-01-10", 90_000)).withColumn("seq", F.lit(-2).cast("bigint")))  # the same instant as a smaller number: it counts
    assert "2024-01-10" not in {str(r.business_date) for r in table.day_movements(spark).collect()}  # a withdrawn movement leaves its partition
    scan = plan(table._rows(spark, {r.business_date for r in correction.collect()}))
    assert "PartitionFilters: [isnotnull(business_date" in scan or "PartitionFilters: [business_date" in scan
    table.apply(make().limit(0))


def test_distinct_counts(spark, tmp_path):
    rows = spark.range(90_000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 5)) AS chain", "date_add(date'2024-01-01', int(id % 30)) AS day", "id % 7919 AS sku",
                                          "if(id % 11 = 0, NULL, id % 40) AS model")
    exact = D.exact_counts(rows, ["chain"], skus="sku", models="model")
    assert "Expand" not in plan(exact)
    want = {r.chain: (r.skus, r.models) for r in rows.groupBy("chain").agg(F.countDistinct("sku").alias("skus"), F.countDistinct("model").alias("models")).collect()}
    assert {r.chain: (r.skus, r.models) for r in exact.collect()} == want
    D.sketches(rows, ["chain", "day"], skus="sku", models="model").write.parquet(str(tmp_path / "kept"))
    month = D.estimates(D.merged(spark.read.parquet(str(tmp_path / "kept")), ["chain"], "skus", "models"), "skus", "models")
    for r in month.collect():
        assert all(abs(got - true) <= 0.05 * true for got, true in zip((r.skus, r.models), want[r.chain]))


def test_snapshot_changes_read_changed_branches(spark, tmp_path):
    keys, columns = ["chain", "sku"], ["price", "note"]
    rows = spark.range(20_000).selectExpr("concat('c', id % 3) AS chain", "cast(id AS string) AS sku", "id * 7 AS price", "if(id % 5 = 0, NULL, '') AS note")
    after = (rows.filter("sku <> '77'").withColumn("price", F.when(F.col("sku") == "500", F.lit(1)).otherwise(F.col("price")))
             .withColumn("note", F.when(F.col("sku") == "1000", F.lit("")).otherwise(F.col("note")))
             .union(spark.createDataFrame([("c9", "new", 5, None)], rows.schema)))

    def kept(df, name):
        S.write_parts(H.with_leaves(df, keys), str(tmp_path / name), "branch")
        return spark.read.parquet(str(tmp_path / name))

    one, two = kept(rows, "one"), kept(after, "two")
    trees = H.tree(one, columns), H.tree(two, columns)
    nodes = H.changed_nodes(*trees)
    assert [len(n) for n in nodes] == [1, len(nodes[1]), len(nodes[2]), len(nodes[3])] and len(nodes[3]) <= 4
    diff = H.snapshot_diff(one, two, trees, keys, columns)
    assert {(r.sku, r.change) for r in diff.collect()} == {("77", "missing"), ("500", "changed"), ("1000", "changed"), ("new", "added")}
    assert plan(diff).count("PartitionFilters: [branch") >= 2 and "In(leaf" in plan(diff)
    assert H.changed_nodes(trees[0], trees[0]) == [[]]
    assert H.snapshot_diff(one, one, (trees[0], trees[0]), keys, columns).count() == 0
    copies = kept(rows.orderBy(F.rand(1)).repartition(7), "copy")
    assert H.changed_nodes(trees[0], H.tree(copies, columns)) == [[]]  # sums don't depend on the order of rows


def test_catalog_gate_scans_its_inputs_few_times(spark, tmp_path):
    schema = "chain string, sku string, source_url string, verified boolean, product_name string, verify_tokens array<string>"
    items = [("a", "1", "u1", True, "n", ["x"]), ("a", "1", "u2", False, "", []), ("b", "1", "u2", True, "n", ["x"]), ("b", None, None, True, "n", ["x"])]
    review = [("a", "9", "u1", True, "n", ["x"]), ("a", "8", "u7", True, "n", ["x"]), ("a", "7", "u7", True, "n", ["x"]), ("a", "6", None, True, "n", ["x"])]
    for name, data in (("items", items), ("review", review)):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
    gate = Q.catalog_gate(*(spark.read.parquet(str(tmp_path / n)) for n in ("items", "review")))
    assert plan(gate).count("FileScan") == 3
    assert gate.first().asDict() == {"unverified": 1, "unnamed": 1, "untokened": 1, "shared_sku": 1, "shared_link": 1, "shared_review_link": 1, "ready_and_review": 2}
    empty = Q.catalog_gate(*(spark.createDataFrame([], schema) for _ in range(2))).first()
    assert set(empty.asDict().values()) == {0}


def test_only_odd_texts_reach_python(spark):
    rng = random.Random(8)
    blocks = [(0, 0x2FF), (0x300, 0x36F), (0x400, 0x52F), (0x1100, 0x11FF), (0x1E00, 0x1EFF), (0x1F00, 0x1FFF), (0x2000, 0x20CF), (0x2100, 0x212F), (0xAC00, 0xAC80), (0xF900, 0xF9FF)]
    texts = [None, "", "Điện thoại iPhone 17 – 20.000.000₫", unicodedata.normalize("NFD", "Điện thoại"), "a &amp; b", "tên &agrave; &lt;b&gt;"]
    texts += ["".join(chr(rng.randint(*rng.choice(blocks))) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.n, r.u) for r in rows.select("i", T.nfc(F.col("t")).alias("n"), T.unescape(F.col("t")).alias("u")).collect()}
    import html
    assert got == {i: (t and unicodedata.normalize("NFC", t), t and html.unescape(t)) if t is not None else (None, None) for i, t in enumerate(texts)}
    sent = rows.filter(~F.col("t").rlike(T.COMPOSED)).collect()
    assert all(any(ord(c) > 0x2FF for c in r.t) for r in sent) and not any(r.i in (1, 2) for r in sent)
    assert plan(rows.select(T.nfc(F.col("t")).alias("n"))).count("CASE WHEN NOT RLIKE") >= 1
