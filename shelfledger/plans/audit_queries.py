"""Summary, audit, evidence and carry-forward queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import text as T
from shelfledger.functions.product import shop_colors
from shelfledger.operators import audit as A
from shelfledger.operators import carry, tracking
from shelfledger.operators import history as H
from shelfledger.operators.rule_index import rule_index
from shelfledger.plans.carriers import catalog, observations, run_headers, sql_list
from shelfledger.plans.history_queries import DAY, stamp
from shelfledger.plans.matrix_queries import TRACKED, tracked
from shelfledger.plans.registry import query
from shelfledger.sources.rules import rule_rows

CHAIN_ROWS = "chains AS (SELECT unnest(" + sql_list(V.CHAIN_NAMES) + ") AS chain)"
ASOF = f"""dated AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain, sku ORDER BY observed_at DESC, seq) AS rn
 FROM obs WHERE business_date <= DATE '{DAY}') WHERE rn = 1)"""


def chains(spark):
    return spark.createDataFrame([(c,) for c in V.CHAIN_NAMES], "chain string")


def issues(spark, sf):
    return catalog(spark, sf).filter("status = 'review'").withColumns({
        "error_kind": T.error_kind(F.col("reason")), "stage": F.when(F.col("stock") == 0, "catalog").otherwise("price")})


def kinds(name: str):
    return F.array_join(F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias(name)


KIND_SQL = """k AS (SELECT chain, string_agg(kind || '=' || n, '|' ORDER BY kind) AS by_kind FROM (SELECT chain, kind, count(*)
 AS n FROM cat WHERE status = 'review' GROUP BY ALL) GROUP BY chain)"""


@query("agg1_run_summary", f"""WITH {ASOF}, {KIND_SQL},
 l AS (SELECT chain, count(*) FILTER (status = 'ready') AS ready, count(*) FILTER (status <> 'ready') AS review,
  count(*) FILTER (status = 'review' AND stock <> 0) AS failures, count(*) FILTER (status = 'review' AND kind = 'blocked')
  AS blocked FROM cat GROUP BY chain),
 p AS (SELECT chain, count(*) AS prices, count(promo_price) AS numeric FROM dated GROUP BY chain)
SELECT chain, ready, review, prices, numeric, prices - numeric AS status_only, review AS issues, failures, blocked,
 ready + review AS expected, CASE WHEN prices * 2 < ready THEN 'degraded' ELSE 'ok' END AS status, by_kind AS issues_by_kind
FROM l JOIN p USING (chain) JOIN k USING (chain)""", "obs", "cat")
def _(spark, sf):
    out = A.run_summary(catalog(spark, sf), H.as_of(observations(spark, sf), DAY), issues(spark, sf))
    return out.withColumn("issues_by_kind", kinds("issues_by_kind"))


DISCOVERY = """WITH s AS (SELECT chain, input_row, bool_and(input_row % 17 <> 3 OR chain = 'TGDD') AS ok,
  count(*) FILTER (stock = 0) AS excluded FROM cat GROUP BY ALL),
 p AS (SELECT chain, count(*) AS sources, count(*) FILTER (NOT ok) AS failed, CAST(sum(excluded) AS BIGINT) AS excluded FROM s
  GROUP BY chain),
 l AS (SELECT chain, count(*) AS links, count(*) FILTER (status = 'ready') AS ready FROM cat GROUP BY chain)"""


def discovery_sources(spark, sf):
    return catalog(spark, sf).groupBy("chain", "input_row").agg(A.count_if(F.col("stock") == 0).alias("excluded")).withColumn(
        "ok", (F.col("input_row") % 17 != 3) | (F.col("chain") == "TGDD"))


@query("agg2_discovery_summary", DISCOVERY + """ SELECT chain, sources, failed AS sources_failed, sources - failed AS sources_ok,
 excluded, links, ready, links - ready AS review, CASE WHEN failed = 0 AND ready > 0 THEN 'ok' ELSE 'failed' END AS status,
 failed = 0 AND ready > 0 AS published FROM p JOIN l USING (chain)""", "cat")
def _(spark, sf):
    return A.discovery_summary(discovery_sources(spark, sf), catalog(spark, sf))


@query("agg2_source_counts", """SELECT chain, input_row, count(*) AS links, count(*) FILTER (status = 'ready') AS ready,
 count(*) FILTER (status = 'review') AS review FROM cat GROUP BY ALL""", "cat")
def _(spark, sf):
    return A.source_counts(catalog(spark, sf))


TODAY = "2024-01-30"


@query("agg3_freshness_metrics", f"""WITH l AS (SELECT *, business_date = DATE '{TODAY}' AND stale_since IS NULL AS fresh FROM (
 SELECT *, row_number() OVER (PARTITION BY chain, sku ORDER BY observed_at DESC, seq) AS rn FROM obs) WHERE rn = 1)
SELECT chain, (SELECT count(*) FROM obs o WHERE o.chain = l.chain) AS history_rows, count(*) AS latest_skus,
 count(DISTINCT model) AS latest_models, count(*) FILTER (fresh) AS today_verified_skus,
 count(promo_price) FILTER (fresh) AS today_numeric, count(*) FILTER (fresh AND promo_price IS NULL) AS today_status_only,
 count(*) FILTER (NOT fresh) AS not_verified_today, count(stale_since) AS explicitly_stale FROM l GROUP BY chain""", "obs")
def _(spark, sf):
    return A.freshness_metrics(observations(spark, sf), TODAY, ["chain"])


@query("agg3_models_without_today", f"""WITH l AS (SELECT *, business_date = DATE '{TODAY}' AND stale_since IS NULL AS fresh FROM (
 SELECT *, row_number() OVER (PARTITION BY chain, sku ORDER BY observed_at DESC, seq) AS rn FROM obs) WHERE rn = 1)
SELECT chain, model FROM l GROUP BY ALL HAVING NOT bool_or(fresh)""", "obs")
def _(spark, sf):
    return A.models_without_today(observations(spark, sf), TODAY)


@query("agg4_coverage_audit", DISCOVERY + f""", {KIND_SQL}, c AS (SELECT chain, count(*) AS links, count(DISTINCT source_url)
 AS urls, count(DISTINCT sku) AS skus, count(DISTINCT model) FILTER (i < 36) AS models, count(*) FILTER (i >= 36) AS unknown_models,
 count(*) FILTER (status = 'review') AS issues, count(*) FILTER (status = 'review' AND kind IN {tuple(V.ACCESS_ERRORS)})
 AS access_errors FROM cat GROUP BY chain),
 o AS (SELECT chain, count(DISTINCT sku) AS price_skus, count(promo_price) AS priced, count(*) - count(promo_price) AS status_only,
  strftime(min(observed_at), '%Y-%m-%d %H:%M:%S.%f') AS observed_from, strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%f')
  AS observed_to FROM obs GROUP BY chain)
SELECT chain, p.sources AS sources_total, p.sources - failed AS sources_ok, c.links, urls, skus, models, unknown_models,
 price_skus, priced, status_only, observed_from, observed_to, issues, access_errors, by_kind AS issue_kinds
FROM p JOIN c USING (chain) JOIN o USING (chain) JOIN k USING (chain)""", "obs", "cat")
def _(spark, sf):
    links = catalog(spark, sf).withColumn("model", F.when(F.col("i") < 36, F.col("model")))
    out = A.coverage_audit(discovery_sources(spark, sf), links, observations(spark, sf), issues(spark, sf))
    return out.withColumns({"observed_from": stamp("observed_from"), "observed_to": stamp("observed_to"),
                            "issue_kinds": kinds("issue_kinds")})


SUMMARY = """WITH h AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs),
 s AS (SELECT chain, CASE state WHEN 'O' THEN 'ok' WHEN 'F' THEN 'degraded' ELSE 'failed' END AS status,
  CASE WHEN state <> 'P' THEN run_id % 50 + 10 END AS expected, CASE WHEN state <> 'P' THEN run_id % 50 + 10 - run_id % 3 END
  AS prices, CASE WHEN state <> 'P' THEN run_id % 3 END AS issues, CASE WHEN state <> 'P' THEN run_id % 2 END AS blocked
  FROM h WHERE rn = 1)"""


def summaries(spark, sf):
    from shelfledger.sources.runs import newest_headers
    heads = newest_headers(run_headers(spark, sf), ["chain"])
    return heads.selectExpr(
        "chain", "CASE state WHEN 'O' THEN 'ok' WHEN 'F' THEN 'degraded' ELSE 'failed' END AS status",
        "CASE WHEN state <> 'P' THEN run_id % 50 + 10 END AS expected",
        "CASE WHEN state <> 'P' THEN run_id % 50 + 10 - run_id % 3 END AS prices",
        "CASE WHEN state <> 'P' THEN run_id % 3 END AS issues", "CASE WHEN state <> 'P' THEN run_id % 2 END AS blocked")


STATES = SUMMARY + f""", {CHAIN_ROWS}, f AS (SELECT * FROM s),
 st AS (SELECT c.chain, coalesce(f.status, CASE WHEN c.chain = 'TGDD' THEN 'skipped' ELSE 'missing' END) AS status,
  CASE WHEN f.chain IS NULL THEN 0 ELSE 1 END AS copies, expected, prices, issues, blocked FROM chains c LEFT JOIN f
  ON f.chain = c.chain)"""


def states(spark, sf):
    return A.chain_states(chains(spark), summaries(spark, sf), [c for c in V.CHAIN_NAMES if c != "TGDD"])


@query("agg5_chain_states", STATES + " SELECT * FROM st", "runs")
def _(spark, sf):
    return states(spark, sf)


@query("agg6_state_detail", STATES + """ SELECT chain, CASE WHEN status IN ('ok', 'degraded') AND (issues > 0 OR prices < expected)
 THEN 'needs_check' ELSE status END AS label, CASE WHEN prices IS NULL THEN '' ELSE prices || '/' || expected
 || CASE WHEN blocked > 0 THEN ', ' || blocked || ' blocked' ELSE '' END END AS detail FROM st""", "runs")
def _(spark, sf):
    return A.state_detail(states(spark, sf)).select("chain", "label", "detail")


@query("agg6_failed_sources", """SELECT chain, input_row FROM (SELECT DISTINCT chain, input_row FROM cat WHERE input_row % 17 = 3
 AND chain <> 'TGDD') QUALIFY row_number() OVER (PARTITION BY chain ORDER BY input_row) <= 5""", "cat")
def _(spark, sf):
    return A.first_failed_sources(discovery_sources(spark, sf)).select("chain", "input_row")


@query("agg7_report_totals", STATES + """ SELECT CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(issues) AS BIGINT) AS issues,
 coalesce(string_agg(chain || '=' || expected || '/' || prices, '|' ORDER BY chain) FILTER (expected > 0), '') AS by_chain,
 string_agg(chain, '|' ORDER BY chain) FILTER (status <> 'ok') AS not_ok FROM st""", "runs")
def _(spark, sf):
    text = F.transform("by_chain", lambda c: F.concat(c["chain"], F.lit("="), c["expected"], F.lit("/"), c["prices"]))
    return A.report_totals(states(spark, sf)).select("expected", "issues", F.array_join(text, "|").alias("by_chain"),
                                                     F.array_join("not_ok", "|").alias("not_ok"))


@query("agg8_overall_status", """SELECT c, CASE WHEN bool_and(state = 'O') THEN 'success' WHEN bool_and(state = 'F') THEN 'error'
 ELSE 'partial' END AS overall FROM runs GROUP BY c""", "runs")
def _(spark, sf):
    rows = run_headers(spark, sf).withColumn("status", F.expr(
        "CASE state WHEN 'O' THEN 'success' WHEN 'F' THEN 'error' ELSE 'partial' END"))
    return A.overall_status(rows, ["c"])


@query("agg15_snapshot_fingerprint", """WITH r AS (SELECT chain, sha256(run_id || chr(31) || strftime(completed_at, '%Y-%m-%d %H:%M:%S'))
 AS h FROM runs) SELECT chain, count(*) || '-' || CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS HUGEINT)::VARCHAR
 || '-' || CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS HUGEINT)::VARCHAR AS fingerprint FROM r GROUP BY chain""", "runs")
def _(spark, sf):
    rows = run_headers(spark, sf).withColumn("completed_at", F.date_format("completed_at", "yyyy-MM-dd HH:mm:ss"))
    return A.content_fingerprint(rows, ["run_id", "completed_at"], ["chain"])


@query("jon11_rule_conflicts", """SELECT DISTINCT product_name AS name, CASE WHEN i = 38 THEN 'iPhone 17|iPhone 16' ELSE '' END AS hits
FROM cat WHERE i >= 36 OR model = 'AirPods Max'""", "cat")
def _(spark, sf):
    names = catalog(spark, sf).select(F.col("product_name").alias("name"), "model")
    return A.rule_conflicts(names, rule_index(rule_rows(spark, V.MODEL_RULES)), "model").select("name", F.array_join("hits", "|").alias("hits"))


@query("jon12_variant_select", f"""WITH {TRACKED}, p AS (SELECT DISTINCT model, color, variant_id AS code FROM cat),
 a AS (SELECT model, color AS wanted FROM tracked),
 ok AS (SELECT p.*, wanted, wanted IS NULL OR lower(p.color) = lower(wanted)
  OR (wanted = 'Đen Không Gian' AND p.color = 'Đen') AS ok FROM p JOIN a USING (model)),
 v AS (SELECT model, any_value(wanted) AS wanted, count(DISTINCT color) FILTER (ok) AS n FROM ok GROUP BY model)
SELECT 'row' AS kind, model, code AS value FROM (SELECT DISTINCT model, code FROM ok JOIN v USING (model) WHERE ok AND (v.wanted IS NULL OR n = 1))
UNION ALL SELECT 'issue', model, CASE WHEN n = 0 THEN 'color_not_found' ELSE 'color_ambiguous' END FROM v WHERE wanted IS NOT NULL AND n <> 1
UNION ALL SELECT 'issue', model, 'wrong_model' FROM a WHERE model NOT IN (SELECT model FROM p)""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    palette = rows.select("model", "color", F.array("variant_id").alias("codes")).distinct()
    versions = rows.select("model", F.col("variant_id").alias("code"), F.col("storage").alias("version")).distinct()
    accepted = [(m, V.MODEL_COLORS.get(m), shop_colors("tgdd", m, V.MODEL_COLORS[m]) if m in V.MODEL_COLORS else None)
                for m in V.MODEL_NAMES]
    rules = spark.createDataFrame(accepted, "model string, color string, accepted array<string>")
    picked, problems = tracking.variant_select(palette, rules, versions)
    return picked.select(F.lit("row").alias("kind"), "model", F.col("code").alias("value")).union(
        problems.select(F.lit("issue"), "model", F.col("reason")))


@query("jon13_source_coverage", """WITH e AS (SELECT DISTINCT input_row, listing_url AS url FROM cat),
 d AS (SELECT input_row, listing_url AS url, max(seq) AS last FROM cat WHERE total > 100000 GROUP BY ALL)
SELECT e.input_row, e.url, CASE WHEN d.url IS NULL THEN 'missing' WHEN last % 5 = 0 THEN 'failed' ELSE 'ok' END AS status,
 CASE WHEN last % 5 = 0 THEN 'HTTP 502' ELSE '' END AS error FROM e LEFT JOIN d ON d.input_row = e.input_row AND d.url = e.url""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).withColumn("url", F.col("listing_url"))
    found = rows.filter("total > 100000").groupBy("input_row", "url").agg(F.max("seq").alias("last")).selectExpr(
        "input_row", "url", "CASE WHEN last % 5 = 0 THEN 'failed' ELSE 'ok' END AS status",
        "CASE WHEN last % 5 = 0 THEN 'HTTP 502' END AS error")
    return A.source_coverage(rows.select("input_row", "url").distinct(), found)


@query("jon14_missing_models", f"""WITH s AS (SELECT DISTINCT chain, sku, model FROM cat WHERE total > 499000),
 m AS (SELECT DISTINCT chain, model FROM cat), r AS (SELECT DISTINCT chain, model FROM cat SEMI JOIN s USING (chain, sku)), {TRACKED}
SELECT m.chain, m.model, CASE WHEN t.color IS NOT NULL THEN 'no_verified_color' ELSE 'no_price_or_name' END AS reason
FROM m ANTI JOIN s ON s.chain = m.chain AND s.model = m.model ANTI JOIN r ON r.chain = m.chain AND r.model = m.model
LEFT JOIN tracked t ON t.model = m.model""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    return A.missing_models(rows, rows.filter("total > 499000"), tracked(spark))


CARRY = """WITH w AS (SELECT *, row_number() OVER (PARTITION BY chain, sku, k < 60 ORDER BY observed_at DESC, seq) AS rn FROM obs),
 fresh AS (SELECT * FROM w WHERE rn = 1 AND k >= 60), prev AS (SELECT * FROM w WHERE rn = 1 AND k < 60),
 old AS (SELECT p.* FROM prev p ANTI JOIN fresh f ON f.chain = p.chain AND f.sku = p.sku),
 fail AS (SELECT DISTINCT chain, sku FROM obs WHERE k = 3)"""


@query("jon15_carry_forward", CARRY + """ SELECT p AS policy, seq, FALSE AS marked FROM fresh, (VALUES ('failed'), ('unseen'), ('model')) t(p)
UNION ALL SELECT 'failed', seq, TRUE FROM old SEMI JOIN fail USING (chain, sku)
UNION ALL SELECT 'unseen', seq, TRUE FROM old UNION ALL SELECT 'model', seq, model = 'iPhone 17' FROM old""", "obs")
def _(spark, sf):
    from shelfledger.operators.latest import latest_per_key
    rows = observations(spark, sf).withColumn("stale_since", F.lit(None).cast("timestamp_ntz")).withColumn(
        "stale_reason", F.lit(None).cast("string"))
    previous = latest_per_key(rows.filter("k < 60"), H.SERIES)
    fresh = latest_per_key(rows.filter("k >= 60"), H.SERIES)
    broken = rows.filter("k = 3").withColumn("reason", F.lit("HTTP 502"))
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    out = None
    for policy in carry.POLICIES:
        part = carry.carry_forward(previous, fresh, at, "not read again", policy, broken, "iPhone 17").select(
            F.lit(policy).alias("policy"), "seq", F.col("stale_since").isNotNull().alias("marked"))
        out = part if out is None else out.unionByName(part)
    return out


@query("jon19_rule_preview", """WITH c AS (SELECT chain, count(*) AS links, count(*) FILTER (status = 'ready') AS links_ready FROM cat
  WHERE model = 'iPhone 16' GROUP BY chain),
 l AS (SELECT *, coalesce(lower(proof_model) = 'iphone 16' AND lower(proof_color) = 'đen' AND proof_code = variant_id
  AND proof_color_id IS NOT NULL AND proof_dated, FALSE) AS holds FROM (SELECT *, row_number() OVER (PARTITION BY chain, sku
  ORDER BY observed_at DESC, seq) AS rn FROM obs WHERE model = 'iPhone 16') WHERE rn = 1),
 r AS (SELECT chain, count(*) AS records, count(*) FILTER (holds) AS verified, count(*) FILTER (NOT holds) AS stale_proofs,
  array_to_string(list_sort(list(DISTINCT color)), '|') AS colors, bool_or(lower(color) = 'đen') AS color_available FROM l GROUP BY chain)
SELECT coalesce(c.chain, r.chain) AS chain, links, links_ready, records, verified, stale_proofs, colors, color_available
FROM c FULL JOIN r ON r.chain = c.chain""", "obs", "cat")
def _(spark, sf):
    out = A.rule_preview(catalog(spark, sf), observations(spark, sf), V.MODEL_RULES, "iPhone 16", ["đen"], ["iphone 16"])
    return out.withColumn("colors", F.array_join("colors", "|"))


@query("jon20_link_check_state", """WITH l AS (SELECT DISTINCT model, slug AS channel, source_url AS url, color FROM cat),
 c AS (SELECT model, slug AS channel, source_url AS url, arg_max(CASE WHEN seq % 4 = 0 THEN 'Tím' ELSE color END, seq) AS color,
  arg_max(CASE WHEN seq % 3 = 0 THEN 'access_error' ELSE 'valid' END, seq) AS status FROM cat WHERE total > 50000 GROUP BY ALL)
SELECT l.model, l.channel, l.url, CASE WHEN lower(c.color) = lower(l.color) THEN c.status ELSE 'unchecked' END AS status
FROM l LEFT JOIN c ON c.model = l.model AND c.channel = l.channel AND c.url = l.url""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).withColumns({"channel": F.col("slug"), "url": F.col("source_url")})
    checks = rows.filter("total > 50000").selectExpr(
        "upper(model) AS model", "channel", "url", "CASE WHEN seq % 4 = 0 THEN 'Tím' ELSE color END AS color",
        "CASE WHEN seq % 3 = 0 THEN 'access_error' ELSE 'valid' END AS status", "'' AS detail", "seq AS checked_at")
    return A.link_check_state(rows.select("model", "channel", "url", "color").distinct(), checks).select(
        "model", "channel", "url", "status")
