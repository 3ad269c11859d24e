"""Catalog, source and run queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions.product import locked_sku
from shelfledger.operators import catalog as K
from shelfledger.operators.skew import attach
from shelfledger.plans.carriers import catalog, run_headers, run_rows
from shelfledger.plans.registry import query
from shelfledger.session import shared_folder
from shelfledger.sources import runs as R
from shelfledger.sources import seeds as S

SHARED = K.SHARED_SKU


def pages(column: str = "listing_urls"):
    return F.array_join(column, "|").alias("pages")


@query("src1_seed_sources", """WITH r AS (SELECT *, CASE WHEN seq % 47 = 0 THEN '' ELSE brand END AS b,
 CASE WHEN seq % 37 = 0 THEN 'http' ELSE '' END AS bad FROM cat)
SELECT chain, category, b AS brand, listing_url AS url, min(input_row) AS input_row, 'seed' AS kind FROM r
 WHERE b <> '' AND bad = '' GROUP BY ALL
UNION ALL SELECT chain, category, b, listing_url, input_row, 'reject' FROM r WHERE b = '' OR bad <> ''""", "cat")
def _(spark, sf):
    path = f"{shared_folder(spark)}/seeds-{uuid.uuid4().hex}"
    listed = seed_rows(spark, sf).select("chain", "category", "brand", "url", F.lit("sheet").alias("input_sheet"), "input_row")
    listed.filter("input_row % 2 = 0").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(f"{path}/seeds.csv")
    listed.filter("input_row % 2 <> 0").write.json(f"{path}/seeds.jsonl")
    seeds, rejects = S.seed_sources(S.read_seeds(spark, f"{path}/seeds.csv").unionByName(S.read_seeds(spark, f"{path}/seeds.jsonl")))
    columns = ["chain", "category", "brand", "url", "input_row"]
    fixed = rejects.withColumn("url", F.regexp_replace("url", "^http:", "https:"))
    return seeds.select(*columns, F.lit("seed").alias("kind")).union(fixed.select(*columns, F.lit("reject")))


def seed_rows(spark, sf):
    seq = F.col("seq")
    return catalog(spark, sf).select(
        "seq", "chain", "category", F.when(seq % 47 == 0, " ").otherwise(F.concat("brand", F.lit(" "))).alias("brand"),
        F.when(seq % 37 == 0, F.regexp_replace("listing_url", "^https:", "http:")).otherwise(
            F.col("listing_url")).alias("url"), "input_row")


@query("src2_sources_with_patterns", f"""SELECT kind, count(*) AS seeds FROM (SELECT DISTINCT chain, category, brand,
 listing_url, CASE WHEN category = '{V.EARBUDS}' OR (chain = 'Viettel Store' AND category = '{V.LAPTOP}') THEN 'unmapped'
 ELSE 'mapped' END AS kind FROM cat WHERE seq % 47 <> 0 AND seq % 37 <> 0) GROUP BY kind
UNION ALL SELECT 'product_links', count(*) FROM cat""", "cat")
def _(spark, sf):
    seeds, _ = S.seed_sources(seed_rows(spark, sf))
    mapped, unmapped = S.with_patterns(seeds, S.url_patterns(spark))
    links = S.outside_seeds(catalog(spark, sf), seeds)
    total = lambda df, kind: df.agg(F.count(F.lit(1)).alias("seeds")).select(F.lit(kind).alias("kind"), "seeds")
    return total(mapped, "mapped").union(total(unmapped, "unmapped")).union(total(links, "product_links"))


NOW = "2001-08-05"


@query("src3_latest_catalog", f"""WITH heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain
 ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1),
 n AS (SELECT run_id, count(*) AS found, count(*) FILTER (flag <> 'R') AS ready FROM run_rows GROUP BY run_id)
SELECT chain, h.run_id, coalesce(found, 0) AS found, coalesce(ready, 0) AS ready,
 CASE WHEN completed_at > TIMESTAMP '{NOW}' + INTERVAL 5 MINUTE THEN 'future'
  WHEN completed_at < TIMESTAMP '{NOW}' - INTERVAL 8 DAY THEN 'stale'
  WHEN coalesce(found, 0) <> product_count THEN 'incomplete'
  WHEN coalesce(ready, 0) = 0 OR ready <> product_count THEN 'no_ready' ELSE 'accepted' END AS verdict
FROM heads h LEFT JOIN n ON n.run_id = h.run_id""", "runs")
def _(spark, sf):
    headers = run_headers(spark, sf).withColumns({"candidate_count": F.col("product_count"),
                                                  "ready_count": F.col("product_count")})
    rows = run_rows(spark, sf).withColumn("status", F.when(F.col("flag") == "R", "review").otherwise("ready"))
    return R.latest_catalog(headers, rows, F.lit(NOW).cast("timestamp_ntz")).select("chain", "run_id", "found", "ready",
                                                                                     "verdict")


@query("src4_latest_run_rows", """WITH heads AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year, week
 ORDER BY completed_at DESC, run_id DESC) AS rn FROM runs) WHERE rn = 1),
 n AS (SELECT run_id, count(*) AS found FROM run_rows GROUP BY run_id)
SELECT h.year, h.week, h.run_id, r.part, r.price FROM heads h JOIN n ON n.run_id = h.run_id AND found = product_count
 JOIN run_rows r ON r.run_id = h.run_id""", "runs")
def _(spark, sf):
    return R.latest_run_rows(run_headers(spark, sf), run_rows(spark, sf)).select("year", "week", "run_id", "part", "price")


@query("src4_run_completeness", """SELECT r.run_id, count(x.run_id) AS found, count(x.run_id) = any_value(product_count)
 AS complete FROM runs r LEFT JOIN run_rows x ON x.run_id = r.run_id GROUP BY r.run_id""", "runs")
def _(spark, sf):
    return R.complete_runs(run_headers(spark, sf), run_rows(spark, sf)).select("run_id", "found", "complete")


@query("agg16_seed_counts", """SELECT 'chain' AS facet, chain AS value, count(*) AS seeds FROM cat GROUP BY ALL
UNION ALL SELECT 'category', category, count(*) FROM cat GROUP BY ALL""", "cat")
def _(spark, sf):
    return S.seed_counts(catalog(spark, sf))


@query("win4_latest_chain_issues", """WITH i AS (SELECT *, date_trunc('month', discovered_at) AS captured,
 CAST(year(discovered_at) AS BIGINT) AS period FROM cat WHERE status = 'review'),
 n AS (SELECT i.* FROM i JOIN (SELECT period, chain, max(captured) AS m FROM i GROUP BY ALL) t
  ON t.period = i.period AND t.chain = i.chain AND t.m = i.captured)
SELECT period, chain, source_url, sku, min(seq) AS seq FROM n GROUP BY ALL""", "cat")
def _(spark, sf):
    issues = catalog(spark, sf).filter("status = 'review'").withColumns({
        "captured_at": F.date_trunc("month", "discovered_at"), "period": F.year("discovered_at").cast("bigint")})
    return K.latest_chain_issues(issues, "period").select("period", "chain", "source_url", "sku", "seq")


REPRESENTATIVES = """WITH g AS (SELECT *, c % 97 AS grp, CASE WHEN c % 3 = 0 THEN listing_price ELSE 1000 END AS lp,
  CASE WHEN seq % 19 = 0 THEN 'Tạm HẾT' ELSE '' END AS ls FROM cat),
 f AS (SELECT chain, grp, priority, count(*) AS n, count(lp) AS priced, min(lp) AS lo, max(lp) AS hi FROM g GROUP BY ALL),
 r AS (SELECT g.*, n, priced, lo, hi, row_number() OVER (PARTITION BY g.chain, g.grp, g.priority
  ORDER BY NOT (stock > 0 AND ls = ''), variant_id, seq) AS rn FROM g JOIN f ON f.chain = g.chain AND f.grp = g.grp
  AND f.priority = g.priority)
SELECT seq, priority = '1-URGENT' OR n = 1 OR priced < n OR lo <> hi OR rn = 1 AS chosen FROM r"""


@query("win7_representatives", REPRESENTATIVES, "cat")
def _(spark, sf):
    rows = catalog(spark, sf).selectExpr(
        "seq", "chain", "concat(c % 97, '/', priority) AS group_key", "priority = '1-URGENT' AS tracked", "variant_id",
        "source_url", "stock", "CASE WHEN c % 3 = 0 THEN listing_price ELSE 1000 END AS listing_price",
        "CASE WHEN seq % 19 = 0 THEN 'Tạm HẾT' ELSE '' END AS listing_status")
    return K.representatives(rows).select("seq", "chosen")


def listed(spark, sf):
    return catalog(spark, sf).withColumn("listing_urls", F.array("listing_url")).withColumn(
        "verified", F.col("status") == "ready")


@query("win8_sku_conflicts", f"""WITH f AS (SELECT chain, sku, min(source_url) <> max(source_url) AS clash,
 min(seq) AS first FROM cat WHERE status = 'ready' GROUP BY ALL),
 p AS (SELECT chain, sku, array_to_string(list_sort(list(DISTINCT listing_url)), '|') AS pages FROM cat
  WHERE status = 'ready' GROUP BY ALL)
SELECT c.seq, CASE WHEN clash THEN 'review' ELSE 'ready' END AS status, CASE WHEN clash THEN '{SHARED}' ELSE reason END
 AS reason, NOT clash AS verified, CASE WHEN clash THEN listing_url ELSE pages END AS pages
FROM cat c JOIN f ON f.chain = c.chain AND f.sku = c.sku JOIN p ON p.chain = c.chain AND p.sku = c.sku
WHERE status = 'ready' AND (clash OR c.seq = first)
UNION ALL SELECT seq, status, reason, FALSE, listing_url FROM cat WHERE status <> 'ready'""", "cat")
def _(spark, sf):
    return K.reject_shared_skus(listed(spark, sf)).select("seq", "status", "reason", "verified", pages())


@query("win9_url_dedupe", """SELECT k.seq, k.status, p.pages FROM (SELECT *, row_number() OVER (PARTITION BY chain, source_url
 ORDER BY status <> 'ready', seq) AS rn FROM cat) k JOIN (SELECT chain, source_url,
 array_to_string(list_sort(list(DISTINCT listing_url)), '|') AS pages FROM cat GROUP BY ALL) p
 ON p.chain = k.chain AND p.source_url = k.source_url WHERE rn = 1""", "cat")
def _(spark, sf):
    return K.dedupe_links(listed(spark, sf)).select("seq", "status", pages())


@query("win10_round_robin_sample", """SELECT seq, source, turn FROM (SELECT seq, source, row_number() OVER (PARTITION BY
 source ORDER BY seq) AS turn FROM (SELECT seq, CASE WHEN input_row <> 85 THEN input_row END AS source FROM cat))
ORDER BY turn, source NULLS LAST LIMIT 300""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).withColumn("source", F.when(F.col("input_row") != 85, F.col("input_row")))
    return K.round_robin(rows, 300, "source").select("seq", "source", F.col("turn").cast("bigint").alias("turn"))


@query("jon7_enrich_precedence", """WITH f AS (SELECT arg_max(priority, seq) AS priority, arg_max(color, seq) AS color,
 source_url FROM cat GROUP BY source_url)
SELECT o.seq, CASE WHEN o.seq % 2 = 0 THEN 'own' ELSE f.color END AS color, f.priority FROM cat o JOIN f USING (source_url)
""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).select("seq", "source_url", F.when(F.col("seq") % 2 == 0, "own").alias("color"))
    return K.enrich(rows, catalog(spark, sf), ["color", "priority"]).select("seq", "color", "priority")


@query("jon7_sku_then_link", """WITH p AS (SELECT * FROM cat WHERE status = 'ready'),
 s AS (SELECT sku, arg_max(priority, discovered_at * 1000000 - seq) AS v FROM (SELECT sku, priority, seq,
  epoch(discovered_at)::BIGINT AS discovered_at FROM p) GROUP BY sku),
 l AS (SELECT source_url, arg_max(priority, discovered_at * 1000000 - seq) AS v FROM (SELECT source_url, priority, seq,
  epoch(discovered_at)::BIGINT AS discovered_at FROM p) GROUP BY source_url)
SELECT c.seq, CASE WHEN s.sku IS NOT NULL THEN s.v ELSE l.v END AS priority FROM cat c LEFT JOIN s ON s.sku = c.sku
LEFT JOIN l ON l.source_url = c.source_url""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    prices = rows.filter("status = 'ready'").withColumn("observed_at", F.col("discovered_at"))
    return K.enrich_by_sku_then_link(rows, prices, ["priority"]).select(
        "seq", F.col("observed_priority").alias("priority"))


@query("jon8_pending_catalog", """WITH a AS (SELECT chain, source_url FROM cat WHERE total > 400000 UNION
 SELECT chain, source_url FROM cat WHERE total < 20000)
SELECT seq, chain, source_url FROM cat c WHERE discovered_at < TIMESTAMP '2000-01-02' AND NOT EXISTS (
 SELECT 1 FROM a WHERE a.chain = c.chain AND a.source_url = c.source_url)""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    return K.pending_links(rows, rows.filter("total > 400000"), rows.filter("total < 20000"), "2000-01-01").select(
        "seq", "chain", "source_url")


RECHECK = """WITH base AS (SELECT min(seq) AS seq, chain, c, source_url, key FROM cat WHERE status = 'review' GROUP BY ALL),
 r AS (SELECT b.*, CASE WHEN c % 9 = 0 THEN NULL ELSE '' || key END AS vid,
  CASE WHEN c % 41 = 0 THEN 'Nhiều URL cùng SKU' ELSE '' END AS why,
  CASE WHEN c % 13 = 0 THEN 'x' || key ELSE '' || key END AS q,
  CASE WHEN c % 17 = 0 THEN 'HTTP 502' END AS err, c % 29 <> 0 AS has_price, c % 58 = 0 AS has_status, c % 31 = 0 AS low
  FROM base b),
 n AS (SELECT chain, vid, count(*) AS n FROM r WHERE vid IS NOT NULL GROUP BY ALL),
 t AS (SELECT DISTINCT chain, key FROM cat WHERE status = 'ready' AND total > 480000),
 j AS (SELECT r.*, CASE WHEN why <> '' OR (coalesce(n, 1) > 1 AND r.chain <> 'Viettel Store') THEN 'shared_code'
  WHEN r.vid IS NULL AND r.chain NOT IN ('Viettel Store', 'TGDD') THEN 'no_code' WHEN err IS NOT NULL THEN err
  WHEN r.vid <> q THEN 'other_code' WHEN t.key IS NOT NULL THEN 'already_priced'
  WHEN NOT has_price AND NOT has_status THEN 'no_price' WHEN has_price AND c % 43 = 0 THEN 'price_range' WHEN has_price AND low THEN 'list_below_price' END AS issue
  FROM r LEFT JOIN n ON n.chain = r.chain AND n.vid = r.vid LEFT JOIN t ON t.chain = r.chain AND '' || t.key = q)
SELECT seq, CASE WHEN issue IS NULL AND row_number() OVER (PARTITION BY chain, q, issue IS NULL ORDER BY seq) > 1
 THEN 'already_priced' ELSE coalesce(issue, '') END AS issue FROM j"""


@query("jon16_review_recheck", RECHECK, "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    base = rows.filter("status = 'review'").groupBy("chain", "c", "source_url", "key").agg(F.min("seq").alias("seq"))
    review = base.selectExpr("seq", "chain", "source_url", "'' AS sku", "CASE WHEN c % 9 <> 0 THEN cast(key AS string) END "
                             "AS variant_id", "CASE WHEN c % 41 = 0 THEN 'Nhiều URL cùng SKU' ELSE '' END AS reason")
    quotes = base.selectExpr(
        "source_url", "CASE WHEN c % 13 = 0 THEN 'x' || key ELSE cast(key AS string) END AS quoted_variant",
        "cast(NULL AS string) AS quoted_sku_key", "CASE WHEN c % 29 = 0 THEN NULL WHEN c % 43 = 0 THEN 900 ELSE 20000000 END AS quoted_price",
        "CASE WHEN c % 31 = 0 THEN 19000000 END AS quoted_list",
        f"CASE WHEN c % 58 = 0 THEN '{V.STATUS_PREFIX}Hết hàng' ELSE '' END AS quoted_text",
        "CASE WHEN c % 17 = 0 THEN 'HTTP 502' END AS error")
    priced = rows.filter("status = 'ready' AND total > 480000").select(
        "chain", locked_sku(F.col("chain"), F.col("key")).alias("sku"))
    good, bad = K.recheck_review(review, quotes, priced)
    return good.select("seq", F.lit("").alias("issue")).union(bad.select("seq", "issue"))


@query("jon17_rerun_supersede", """WITH checked AS (SELECT DISTINCT source_url FROM cat WHERE total > 450000)
SELECT 'issue' AS kind, seq FROM cat WHERE status = 'review' AND source_url NOT IN (SELECT source_url FROM checked)
UNION ALL SELECT 'issue', seq FROM cat WHERE status = 'review' AND total > 450000
UNION ALL SELECT 'price', arg_max(seq, CASE WHEN total > 450000 THEN 1000000000 + seq ELSE seq END) FROM cat
 WHERE status = 'ready' GROUP BY sku""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    fresh = rows.filter("total > 450000")
    issues = K.supersede(rows.filter("status = 'review'"), fresh.filter("status = 'review'"), fresh)
    ready = rows.filter("status = 'ready'")
    prices = K.last_write([ready.filter("total <= 450000"), ready.filter("total > 450000")])
    return issues.select(F.lit("issue").alias("kind"), "seq").union(prices.select(F.lit("price").alias("kind"), "seq"))


RUN_MERGE = """WITH m AS (SELECT *, CASE stock WHEN 0 THEN 'base' WHEN 1 THEN 'rerun1' ELSE 'rerun2' END AS run FROM cat),
 ok AS (SELECT chain, input_row, max(run) AS run FROM m WHERE (input_row + stock) % 5 <> 0 GROUP BY ALL),
 ex AS (SELECT DISTINCT chain, input_row FROM cat WHERE input_row % 12 <> 5)"""


@query("jon18_run_merge", RUN_MERGE + """ SELECT 'row' AS kind, m.chain, m.input_row, seq FROM m JOIN ok
 ON ok.chain = m.chain AND ok.input_row = m.input_row AND ok.run = m.run
UNION ALL SELECT 'missing', chain, input_row, NULL FROM ex ANTI JOIN ok USING (chain, input_row)
UNION ALL SELECT 'unexpected', chain, input_row, NULL FROM ok ANTI JOIN ex USING (chain, input_row)""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).withColumn("run", F.expr(
        "CASE stock WHEN 0 THEN 'base' WHEN 1 THEN 'rerun1' ELSE 'rerun2' END"))
    sources = rows.select("chain", "input_row", "run", ((F.col("input_row") + F.col("stock")) % 5 != 0).alias("ok")).distinct()
    kept, missing, extra = K.merge_runs(sources, rows, rows.filter("input_row % 12 <> 5"))
    none = F.lit(None).cast("bigint").alias("seq")
    keys = ["chain", "input_row"]
    return (kept.select(F.lit("row").alias("kind"), *keys, "seq").union(missing.select(F.lit("missing"), *keys, none))
            .union(extra.select(F.lit("unexpected"), *keys, none)))


@query("set4_source_diff", """WITH e AS (SELECT DISTINCT chain, input_row FROM cat WHERE input_row % 12 <> 5),
 f AS (SELECT DISTINCT chain, input_row FROM cat WHERE input_row % 9 <> 2)
SELECT chain, input_row, 'missing' AS side FROM (SELECT * FROM e EXCEPT SELECT * FROM f)
UNION ALL SELECT chain, input_row, 'unexpected' FROM (SELECT * FROM f EXCEPT SELECT * FROM e)""", "cat")
def _(spark, sf):
    keys = catalog(spark, sf).select("chain", "input_row")
    return K.both_ways(keys.filter("input_row % 12 <> 5"), keys.filter("input_row % 9 <> 2"))


@query("agg14_issue_dedupe", """SELECT arg_max(seq, seq) AS seq, source_url, sku, reason FROM cat WHERE status = 'review'
GROUP BY source_url, sku, reason""", "cat")
def _(spark, sf):
    return K.issue_dedupe(catalog(spark, sf).filter("status = 'review'")).select("seq", "source_url", "sku", "reason")


QUOTES = [
    "source_url", "CASE WHEN c % 19 = 0 THEN 'x' || key ELSE cast(key AS string) END AS quoted_variant",
    "cast(NULL AS string) AS quoted_sku_key", "'Tên ' || c AS quoted_name",
    "CASE WHEN c % 4 = 0 THEN '' ELSE 'Xanh' END AS quoted_color",
    "CASE WHEN c % 23 <> 0 THEN CASE WHEN c % 59 = 0 THEN 9000 ELSE 20000000 END END AS quoted_price",
    f"CASE WHEN c % 46 = 0 THEN '{V.STATUS_PREFIX}Hết hàng' ELSE '' END AS quoted_text",
    "CASE WHEN c % 17 = 0 THEN 'FPT Shop: HTTP 429' END AS error"]


def quotes(spark, sf):
    return catalog(spark, sf).select("source_url", "c", "key").distinct().selectExpr(*QUOTES)


@query("ext6_quote_to_row", """SELECT seq, CASE WHEN c % 17 = 0 THEN 'rate_limited' WHEN c % 19 = 0 THEN 'variant_changed'
 WHEN c % 23 = 0 AND c % 46 <> 0 THEN 'other' WHEN c % 59 = 0 AND c % 23 <> 0 THEN 'other' ELSE 'row' END AS outcome
FROM cat""", "cat")
def _(spark, sf):
    good, bad = K.quote_rows(catalog(spark, sf), quotes(spark, sf))
    return good.select("seq", F.lit("row").alias("outcome")).union(bad.select("seq", F.col("error_kind")))


@query("ext7_ready_review", f"""SELECT seq, CASE WHEN c % 17 = 0 THEN 'review' ELSE 'ready' END AS status,
 CASE WHEN c % 17 = 0 THEN 'FPT Shop: HTTP 429' ELSE '' END AS reason,
 CASE WHEN c % 17 = 0 THEN CASE WHEN chain = 'Viettel Store' THEN '' ELSE sku END
  WHEN c % 19 = 0 THEN regexp_replace(sku, '-', '-x') ELSE sku END AS sku,
 CASE WHEN c % 17 = 0 THEN product_name ELSE 'Tên ' || c || ' · ' || CASE WHEN c % 4 = 0 THEN color ELSE 'Xanh' END END
 AS product_name FROM cat""", "cat")
def _(spark, sf):
    return K.discovery_config(catalog(spark, sf), quotes(spark, sf)).select("seq", "status", "reason", "sku",
                                                                            "product_name")


@query("agg11_listing_complete", """WITH p AS (SELECT chain, listing_url AS listing, c, count(DISTINCT seq % 2) AS pages
 FROM cat WHERE c % 5 = (CASE chain WHEN 'TGDD' THEN 0 ELSE c % 5 END) GROUP BY ALL),
 g AS (SELECT chain, listing, count(*) AS codes, count(*) FILTER (pages > 1) AS repeated FROM p GROUP BY ALL),
 t AS (SELECT *, CASE chain WHEN 'TGDD' THEN codes * 5 // 4 WHEN 'CellphoneS' THEN codes * 2 WHEN 'Phong Vũ' THEN 3000000
  ELSE codes END AS total FROM g)
SELECT chain, listing, codes, total, repeated, CASE WHEN total > 1000000 THEN 'too_many'
 WHEN chain <> 'TGDD' AND repeated > 0 THEN 'repeated' WHEN chain = 'TGDD' AND codes * 100 < total * 80 THEN 'incomplete'
 WHEN chain <> 'TGDD' AND codes <> total THEN 'incomplete' ELSE 'complete' END AS verdict FROM t""", "cat")
def _(spark, sf):
    cards = catalog(spark, sf).select("chain", F.col("listing_url").alias("listing"), F.col("c").alias("code"),
                                      (F.col("seq") % 2).alias("page"))
    codes = cards.groupBy("chain", "listing").agg(F.count_distinct("code").alias("n"))
    totals = codes.selectExpr("chain", "listing", """CASE chain WHEN 'TGDD' THEN n * 5 div 4 WHEN 'CellphoneS' THEN n * 2
        WHEN 'Phong Vũ' THEN 3000000 ELSE n END AS total""")
    paged = attach(cards, totals, ["chain", "listing"])
    return K.listing_complete(paged, V.LISTING_SHARE, 1_000_000)


@query("agg12_listing_merge", """SELECT 'link' AS kind, listing_url AS listing, c AS model, NULL AS name, CAST(NULL AS BIGINT) AS repeats,
 source_url || '/' || stock AS link, min(seq) AS seq FROM cat GROUP BY ALL
UNION ALL SELECT 'card', listing_url, c, arg_min(product_name, seq) FILTER (seq % 3 <> 0), count(*) - 1, NULL, NULL FROM cat
GROUP BY listing_url, c""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    cards = rows.select("seq", F.col("listing_url").alias("listing"), F.col("c").alias("model"),
                        F.when(F.col("seq") % 3 != 0, F.col("product_name")).otherwise("").alias("name"))
    links = rows.select("seq", F.col("listing_url").alias("listing"), F.col("c").alias("model"), F.lit(0).alias("position"),
                        F.concat("source_url", F.lit("/"), "stock").alias("link"))
    merged, first = K.merge_cards(cards, links)
    return merged.withColumn("kind", F.lit("card")).unionByName(
        first.drop("position").withColumn("kind", F.lit("link")), allowMissingColumns=True)
