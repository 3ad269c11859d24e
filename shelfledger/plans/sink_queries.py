"""Queries for the write path: each sink writes to the shared folder, writes again, and what is read back is checked."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import calendar as cal
from shelfledger.operators import quality as Q
from shelfledger.operators.latest import first_per_key
from shelfledger.operators.rule_index import rule_index
from shelfledger.plans.audit_queries import issues
from shelfledger.plans.carriers import catalog, observations, run_headers, run_rows
from shelfledger.plans.history_queries import LAST_DAY, stamp, text_date
from shelfledger.plans.registry import query
from shelfledger.session import shared_folder
from shelfledger.sinks import tables as S
from shelfledger.sources import artifacts
from shelfledger.sources.rules import label_by_brand, read_rule_files, rule_rows


def folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


def weekly(spark, sf):
    day = F.col("business_date")
    return observations(spark, sf).withColumns({"year": cal.iso_year(day), "week": cal.iso_week(day)})


@query("snk1_weekly_upsert", """SELECT chain, sku, CAST(isoyear(business_date) AS BIGINT) AS year, CAST(week(business_date) AS BIGINT)
 AS week, arg_max(seq, CASE WHEN k >= 50 THEN 1000000000 + seq ELSE seq END) AS seq FROM obs GROUP BY ALL""", "obs")
def _(spark, sf):
    rows = weekly(spark, sf)
    path = folder(spark)
    S.write_parts(rows.filter("k < 50"), path, "year", "week")
    for _ in range(2):
        S.write_weekly(spark.read.schema(rows.schema).parquet(path), rows.filter("k >= 50"), path)
    return S.weekly_upsert(rows.limit(0), spark.read.schema(rows.schema).parquet(path)).select(
        "chain", "sku", F.col("year").cast("bigint").alias("year"), F.col("week").cast("bigint").alias("week"), "seq")


@query("snk2_run_gate", f"""WITH c AS (SELECT unnest(['TGDD', 'CellphoneS']) AS chain)
SELECT chain, CAST(0 AS BIGINT) AS empty, (SELECT count(*) FROM obs o WHERE o.chain <> c.chain) AS other_chain,
 (SELECT count(*) FROM cat o WHERE o.chain <> c.chain AND status = 'review') AS other_chain_issues, CAST(0 AS BIGINT) AS bad_price,
 (SELECT count(*) FROM obs WHERE promo_price IS NULL AND (original_price IS NOT NULL OR NOT starts_with(promo_text, '{V.STATUS_PREFIX}')))
 AS bad_status, CAST(0 AS BIGINT) AS unreconciled, CAST(1 AS BIGINT) AS bad_week FROM c""", "obs", "cat")
def _(spark, sf):
    rows, broken = observations(spark, sf), issues(spark, sf)
    expected = rows.count() + broken.count()  # what a run header would say
    gates = [Q.run_gate(rows, broken, chain, 2024, 53, expected).withColumn("chain", F.lit(chain))
             for chain in ("TGDD", "CellphoneS")]
    return gates[0].unionByName(gates[1])


@query("snk3_history_append", """SELECT r.run_id, part, price, chain, CAST(CAST(completed_at + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS business_date,
 CAST(CAST(date_trunc('week', completed_at + INTERVAL 7 HOUR) AS DATE) AS VARCHAR) AS week_start FROM run_rows r JOIN runs h ON h.run_id = r.run_id""",
       "runs")
def _(spark, sf):
    path, rows = folder(spark), S.history_rows(run_rows(spark, sf), run_headers(spark, sf))
    for _ in range(2):
        S.write_parts(rows, path, "week_start", "chain")
    return spark.read.parquet(path).select("run_id", "part", "price", "chain", text_date("business_date"), text_date("week_start"))


@query("snk4_history_backfill", """WITH w AS (SELECT chain, sku, isoyear(business_date) AS y, week(business_date) AS w, max(seq) AS seq FROM obs GROUP BY ALL),
 h AS (SELECT run_id, completed_at FROM runs)
SELECT w.seq, w.chain, w.sku, h.run_id, CAST(CAST(completed_at + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS business_date
FROM w JOIN h ON h.run_id = w.seq""", "obs", "runs")
def _(spark, sf):
    rows = weekly(spark, sf)
    kept = S.weekly_upsert(rows.limit(0), rows).select("seq", "sku", F.col("seq").alias("run_id"), F.col("chain").alias("row_chain"))
    path, out = folder(spark), S.history_rows(kept, run_headers(spark, sf))
    for _ in range(2):
        S.write_parts(out, path, "week_start", "chain")
    return spark.read.parquet(path).select("seq", F.col("row_chain").alias("chain"), "sku", "run_id", text_date("business_date"))


@query("snk5_issue_append", """SELECT seq, CASE WHEN seq % 3 = 0 THEN '' ELSE sku END AS sku, CASE WHEN seq % 5 = 0 THEN '' ELSE product_name END
 AS product_name, kind AS error_kind FROM cat WHERE status = 'review'""", "cat")
def _(spark, sf):
    rows = issues(spark, sf).withColumns({"sku": F.expr("CASE WHEN seq % 3 <> 0 THEN sku END"),
                                          "product_name": F.expr("CASE WHEN seq % 5 <> 0 THEN product_name END")})
    path = folder(spark)
    stamped = S.issue_rows(rows).withColumns({"run_id": F.lit("r1"), "week_start": F.lit("2024-01-01").cast("date")})
    for _ in range(2):
        S.append_history(stamped, path)
    return spark.read.parquet(path).select("seq", "sku", "product_name", "error_kind")


@query("snk6_catalog_publish", """WITH l AS (SELECT chain, raw_url, count(*) AS n, count(*) FILTER (status = 'ready') AS r FROM cat GROUP BY ALL)
SELECT chain, CAST(sum(n) AS BIGINT) AS candidate_count, CAST(sum(r) AS BIGINT) AS ready_count, CAST(0 AS BIGINT) AS bad_status,
 count(*) FILTER (n > 1) AS repeated_links, count(*) FILTER (NOT starts_with(raw_url, 'https://')) AS insecure_links FROM l GROUP BY chain""", "cat")
def _(spark, sf):
    return S.catalog_publish_gate(catalog(spark, sf).withColumn("source_url", F.col("raw_url")))


@query("snk6_published_catalog", """SELECT chain AS run_id, chain, arg_min(seq, seq) AS seq, arg_min(status, seq) AS status FROM cat
WHERE starts_with(raw_url, 'https://') GROUP BY chain, raw_url""", "cat")
def _(spark, sf):
    """Each chain's run is gated, published and published again; what is read back is one row per link."""
    path, rows = folder(spark), catalog(spark, sf).withColumn("source_url", F.col("raw_url")).filter("startswith(raw_url, 'https://')")
    rows = first_per_key(rows, ["chain", "source_url"], [F.col("seq").asc()]).withColumn("run_id", F.col("chain"))
    for chain in V.CHAIN_NAMES:
        for _ in range(2):
            S.publish_catalog(rows.filter(F.col("chain") == chain), path)
    return spark.read.parquet(path).select("run_id", "chain", "seq", "status")


@query("snk7_snapshot_publish", """WITH d AS (SELECT DISTINCT business_date, chain FROM obs WHERE k > 96)
SELECT seq, 'old' AS part FROM obs ANTI JOIN d USING (business_date, chain) WHERE k <= 96
UNION ALL SELECT seq, 'new' FROM obs WHERE k > 96""", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    path = folder(spark)
    S.publish_snapshot(rows.filter("k <= 96").withColumn("part", F.lit("old")), path)
    for _ in range(2):
        S.publish_snapshot(rows.filter("k > 96").withColumn("part", F.lit("new")), path)
    return spark.read.parquet(path).select("seq", "part")


@query("snk8_history_import", """WITH r AS (SELECT *, CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN observed_at + INTERVAL 40 DAY ELSE observed_at END AS t
  FROM obs WHERE k <= 98), h AS (SELECT DISTINCT chain, business_date FROM obs WHERE k > 98),
 d AS (SELECT chain, business_date, count(*) AS n, count(*) FILTER (k IN (4, 5)) AS bad FROM r GROUP BY ALL)
SELECT d.chain, CAST(d.business_date AS VARCHAR) AS business_date, n AS "rows", bad AS bad_time,
 CASE WHEN h.chain IS NOT NULL THEN 'has_history' WHEN bad > 0 THEN 'bad_time' ELSE 'accepted' END AS verdict
FROM d LEFT JOIN h ON h.chain = d.chain AND h.business_date = d.business_date""", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    out = S.import_gate(past_rows(rows), rows.filter("k > 98"), F.lit("2024-02-01").cast("timestamp_ntz"))
    return out.withColumn("business_date", text_date("business_date"))


def past_rows(rows):
    return rows.filter("k <= 98").withColumn("observed_at", F.expr(
        "CASE WHEN k = 4 THEN NULL WHEN k = 5 THEN observed_at + INTERVAL '40' DAY ELSE observed_at END"))


@query("snk8_imported_rows", """WITH h AS (SELECT DISTINCT chain, business_date FROM obs WHERE k > 98 OR k IN (4, 5))
SELECT seq FROM obs ANTI JOIN h USING (chain, business_date) WHERE k <= 98""", "obs")
def _(spark, sf):
    path, rows = folder(spark), observations(spark, sf)
    good = S.import_history(past_rows(rows), rows.filter("k > 98"), F.lit("2024-02-01").cast("timestamp_ntz"))
    for _ in range(2):
        S.write_parts(good, path, "business_date", "chain")
    return spark.read.schema(good.schema).parquet(path).select("seq")


def exported(spark, df):
    """``df`` as read back from its export, written twice."""
    path = folder(spark)
    for _ in range(2):
        S.export(df, path, "parquet")
    return spark.read.parquet(path)


@query("snk9_flat_export", f"""WITH {LAST_DAY}, e AS (SELECT week_start, chain, sku, arg_max(seq, business_date) AS z,
 {', '.join(f"max(CASE WHEN isodow(business_date) = {i} THEN promo_price END) AS price{i}" for i in range(1, 8))} FROM last_day GROUP BY ALL)
SELECT CAST(e.week_start AS VARCHAR) AS week_start, 'W' || CAST(o - 13 * floor(o / 13) + 1 AS BIGINT) || 'Q'
 || CAST(floor((o - 52 * floor(o / 52)) / 13) + 1 AS BIGINT) || 'FY' || CAST(27 + floor(o / 52) AS BIGINT) AS fiscal_week, e.chain, e.sku,
 {', '.join(f'price{i}' for i in range(1, 8))}, product_name, original_price, promo_text, source_url,
 strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f') AS observed_at, CASE WHEN starts_with(promo_text, '{V.STATUS_PREFIX}') THEN 'Hết hàng' ELSE '' END AS status
FROM (SELECT *, CAST(date_diff('day', DATE '2026-09-28', week_start) / 7 AS DOUBLE) AS o FROM e) e JOIN last_day l ON l.seq = e.z""", "obs")
def _(spark, sf):
    return exported(spark, S.flat_prices(observations(spark, sf))).withColumns({"week_start": text_date("week_start"), "observed_at": stamp("observed_at")})


@query("snk9_flat_statuses", f"""WITH {LAST_DAY}, s AS (SELECT *, CASE WHEN starts_with(promo_text, '{V.STATUS_PREFIX}') THEN 'Hết hàng'
 ELSE '{V.PRICE_SEEN}' END AS st FROM last_day) SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku,
 {', '.join(f"coalesce(max(CASE WHEN isodow(business_date) = {i} THEN st END), '{V.NO_DATA}') AS status{i}" for i in range(1, 8))}
FROM s GROUP BY ALL""", "obs")
def _(spark, sf):
    return exported(spark, S.flat_statuses(observations(spark, sf))).withColumn("week_start", text_date("week_start"))


@query("snk9_flat_links", """SELECT chain, category, brand, product_name, sku, source_url, CASE WHEN status = 'ready' THEN 'Đọc được giá'
 ELSE 'Cần kiểm tra: ' || reason END AS state, reason, listing_url AS listing_urls FROM cat""", "cat")
def _(spark, sf):
    return exported(spark, S.flat_links(catalog(spark, sf).withColumn("listing_urls", F.array("listing_url"))))


@query("src5_artifact_scan", """SELECT seq, CAST(CAST(t + INTERVAL 7 HOUR AS DATE) AS VARCHAR) AS business_date,
 CAST(CAST(date_trunc('week', t + INTERVAL 7 HOUR) AS DATE) AS VARCHAR) AS week_start FROM (SELECT seq, slug,
 CASE WHEN k % 9 = 0 THEN TIMESTAMP '2024-02-04 18:30:00' ELSE observed_at END AS t FROM obs) WHERE slug NOT IN ('fpt', 'phongvu')""", "obs")
def _(spark, sf):
    path, observed = folder(spark), observations(spark, sf)
    text = F.when(F.col("k") % 9 != 0, F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    for slug, name in ((c.slug, c.name) for c in V.CHAINS):  # one folder of result files per chain, as its run leaves them
        rows = observed.filter(F.col("slug") == slug).select("seq", text.alias("observed_at"))
        rows.write.mode("overwrite").json(f"{path}/{slug}/rows.jsonl")
        head = {"chain": name, "stage": "discovery" if slug == "fpt" else "prices",
                "status": {"phongvu": "failed", "viettel": "degraded"}.get(slug, "ok"), "finished_at": "2024-02-04T18:30:00Z"}
        spark.createDataFrame([tuple(head.values())], ", ".join(f"{k} string" for k in head)).write.mode("overwrite").json(f"{path}/{slug}/summary.json")
    schema = spark.createDataFrame([], "seq bigint, observed_at string").schema
    return artifacts.read_results(spark, path, schema, "rows.jsonl").select("seq", text_date("business_date"), text_date("week_start"))


def rule_files(spark):
    """The rule index of rule files: one JSON document per brand, written and read back."""
    path = folder(spark)
    rules = rule_rows(spark, V.MODEL_RULES)
    document = rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "pattern"))), lambda r: F.struct(r["name"], r["pattern"])).alias("models"))
    document.select(F.lit("Apple").alias("brand"), "models").write.json(path)
    return rule_index(read_rule_files(spark, path), ["brand"])


@query("udx2_rules_as_data", """SELECT seq, CASE WHEN i < 36 AND model <> 'AirPods Max' THEN model END AS label FROM obs""", "obs")
def _(spark, sf):
    return label_by_brand(observations(spark, sf), rule_files(spark)).select("seq", "label")
