"""Matrix, facet, contract and evidence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import product as P
from shelfledger.operators import history as H
from shelfledger.operators import matrix as X
from shelfledger.operators import quality as Q
from shelfledger.operators.rule_index import only_hit, rule_index, with_hits
from shelfledger.plans.carriers import MODELS, catalog, observations, sql_list
from shelfledger.plans.history_queries import DAY
from shelfledger.plans.registry import query
from shelfledger.sources.rules import rule_rows

ASOF = f"""dated AS (SELECT *, CASE WHEN starts_with(model, 'MacBook') THEN array_to_string(list_sort(list_filter(
 [display_variant, 'RAM 16GB'], lambda x: x <> '')), ' · ') ELSE display_variant END AS variant FROM (
 SELECT *, row_number() OVER (PARTITION BY chain, sku ORDER BY observed_at DESC, seq) AS rn FROM obs
 WHERE business_date <= DATE '{DAY}') WHERE rn = 1)"""


def quotes(spark, sf):
    return H.as_of(observations(spark, sf), DAY)


def tracked(spark):
    return spark.createDataFrame([(m, V.MODEL_COLORS.get(m)) for m in V.MODEL_NAMES], "model string, color string")


TRACKED = "tracked AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{m}', {repr(V.MODEL_COLORS[m]) if m in V.MODEL_COLORS else 'NULL'})" for m in V.MODEL_NAMES) + ") t(model, color))"


@query("agg9_cell_range", f"""WITH {ASOF} SELECT model, storage, variant, chain, min(promo_price) AS low,
 max(promo_price) AS high, count(*) AS quotes FROM dated GROUP BY ALL""", "obs")
def _(spark, sf):
    return X.cell_ranges(quotes(spark, sf))


@query("agg10_price_matrix", f"""WITH {ASOF} SELECT model, storage, variant, """ + ", ".join(
    f"""min(promo_price) FILTER (chain = '{c.name}') AS low_{c.code}, max(promo_price) FILTER (chain = '{c.name}')
 AS high_{c.code}, nullif(count(*) FILTER (chain = '{c.name}'), 0) AS quotes_{c.code}""" for c in V.CHAINS)
       + " FROM dated GROUP BY ALL", "obs")
def _(spark, sf):
    wide = X.price_matrix(quotes(spark, sf))
    names = [F.col(f"`{c.name}_{m}`").alias(f"{m}_{c.code}") for c in V.CHAINS for m in ("low", "high", "quotes")]
    return wide.select("model", "storage", "variant", *names)


@query("agg19_facet_options", f"""SELECT DISTINCT 'brand' AS facet, brand AS value FROM obs UNION
SELECT DISTINCT 'category', category FROM obs WHERE brand = 'Apple' UNION SELECT DISTINCT 'model', model FROM obs
WHERE brand = 'Apple' AND category = '{V.PHONE}' AND chain = 'TGDD'""", "obs")
def _(spark, sf):
    return X.facet_options(observations(spark, sf), "Apple", V.PHONE, "TGDD")


@query("top4_standard_order", f"""WITH {ASOF}, cells AS (SELECT DISTINCT model, storage, variant FROM dated),
 sized AS (SELECT *, coalesce(list_position({sql_list(MODELS[:36])}, model), 37) - 1 AS pos,
 CASE storage WHEN '1TB' THEN 1024 ELSE CAST(replace(storage, 'GB', '') AS BIGINT) END AS gb FROM cells)
SELECT model, storage, variant, pos, gb FROM sized""", "obs")
def _(spark, sf):
    cells = X.with_cell(quotes(spark, sf)).select("model", "storage", "variant").distinct()
    order = X.standard_order(F.col("model"), F.concat_ws(" ", "model", "storage"), F.col("variant"))
    return cells.orderBy(*order).select("model", "storage", "variant", order[0].cast("bigint").alias("pos"),
                                        order[2].cast("bigint").alias("gb"))


@query("set1_chain_union", "SELECT chain, seq, sku, CASE WHEN chain = 'TGDD' THEN model END AS model FROM obs", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    parts = [(c, rows.filter(F.col("chain") == c).select("seq", "sku", *(["model"] if c == "TGDD" else [])))
             for c in V.CHAIN_NAMES]
    return X.chain_union(parts)


@query("set2_placeholder_models", f"""WITH seen AS (SELECT model, variant, count(*) AS n FROM (SELECT model,
 display_variant AS variant FROM obs) GROUP BY ALL) SELECT model, variant, n FROM seen
UNION ALL SELECT m, 'Chưa có dữ liệu đúng cấu hình', NULL FROM (SELECT unnest({sql_list([*MODELS[:36], 'iPhone 99'])}) AS m)
WHERE m NOT IN (SELECT model FROM seen)""", "obs")
def _(spark, sf):
    rows = (observations(spark, sf).groupBy("model", F.col("display_variant").alias(
        "variant")).agg(F.count(F.lit(1)).alias("n")))
    listed = tracked(spark).unionByName(spark.createDataFrame([("iPhone 99", None)], "model string, color string"))
    return X.placeholders(rows, listed).select("model", "variant", "n")


@query("set5_model_registry", """WITH known AS (SELECT DISTINCT category, upper(model) AS model, CASE WHEN brand <> 'Samsung'
 THEN brand END AS brand FROM obs WHERE promo_price > 4800000),
 seen AS (SELECT category, model, max(brand) AS brand FROM obs GROUP BY ALL)
SELECT coalesce(k.category, s.category) AS category, coalesce(k.model, s.model) AS model,
 coalesce(k.brand, s.brand) AS brand, k.model IS NULL AS fresh FROM known k FULL JOIN seen s
 ON lower(k.category) = lower(s.category) AND lower(k.model) = lower(s.model)""", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    known = (rows.filter("promo_price > 4800000").select(
        "category", F.upper("model").alias("model"), F.when(F.col("brand") != "Samsung", F.col("brand")).alias("brand"))
        .distinct())
    return X.model_registry(known, rows)


@query("set6_snapshot_dedupe", """SELECT slug, sku, seq, CASE WHEN k < 50 THEN 0 ELSE 1 END AS snapshot FROM (
 SELECT *, row_number() OVER (PARTITION BY slug, sku, observed_at ORDER BY CASE WHEN k < 50 THEN 0 ELSE 1 END, seq) AS rn
 FROM obs) WHERE rn = 1""", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    both = rows.filter("k < 50").withColumn("snapshot", F.lit(0).cast("bigint")).unionByName(
        rows.withColumn("snapshot", F.lit(1).cast("bigint")))
    return X.snapshot_dedupe(both).select("slug", "sku", "seq", "snapshot")


@query("flt8_facet_filter", f"""SELECT seq, product_name FROM obs WHERE brand = 'Apple' AND chain = 'FPT Shop'
 AND category = '{V.PHONE}' AND contains(lower(replace(replace(strip_accents(product_name), 'đ', 'd'), 'Đ', 'D')),
 'dien thoai iphone 1')""", "obs")
def _(spark, sf):
    return X.facet_filter(observations(spark, sf), brand="Apple", chain="FPT Shop", category=V.PHONE,
                          text="ĐIỆN thoại iPhone 1").select("seq", "product_name")


@query("flt3_observation_contract", """SELECT seq, array_to_string(list_filter([
 CASE WHEN seq % 53 = 0 THEN 'time' END,
 CASE WHEN promo_price IS NULL AND (original_price IS NOT NULL OR NOT starts_with(promo_text, '[Tình trạng] ')) THEN 'status' END,
 CASE WHEN original_price < promo_price THEN 'original' END,
 CASE WHEN seq % 29 = 0 OR seq % 31 = 0 THEN 'link' END], lambda x: x IS NOT NULL), '|') AS violations FROM obs""", "obs")
def _(spark, sf):
    rows = observations(spark, sf).withColumn("day_text", F.col("business_date").cast("string")).withColumn(
        "time_text", F.when(F.col("seq") % 53 == 0, "hôm qua").otherwise(F.col("observed_at").cast("string")))
    good, bad = Q.split(rows, Q.observation_violations())
    return good.select("seq", F.lit("").alias("violations")).union(
        bad.select("seq", F.array_join("violations", "|").alias("violations")))


@query("flt4_issue_contract", """SELECT seq, array_to_string(list_filter([
 CASE WHEN seq % 3 = 2 THEN 'stage' END, CASE WHEN seq % 59 = 0 THEN 'time' END,
 CASE WHEN seq % 61 = 0 THEN 'reason' END, CASE WHEN seq % 37 = 0 THEN 'link' END], lambda x: x IS NOT NULL), '|') AS violations
FROM cat""", "cat")
def _(spark, sf):
    seq = F.col("seq")
    rows = (catalog(spark, sf).withColumn("source_url", F.col("raw_url"))
            .withColumn("stage", F.when(seq % 3 == 0, "catalog").when(seq % 3 == 1, "price").otherwise("other"))
            .withColumn("day_text", F.date_format("discovered_at", "yyyy-MM-dd"))
            .withColumn("time_text", F.when(seq % 59 == 0, "").otherwise(F.col("discovered_at").cast("string")))
            .withColumn("reason", F.when(seq % 61 == 0, "  ").otherwise(F.col("reason"))))
    good, bad = Q.split(rows, Q.issue_violations())
    return good.select("seq", F.lit("").alias("violations")).union(
        bad.select("seq", F.array_join("violations", "|").alias("violations")))


@query("flt5_catalog_contract", """SELECT seq, array_to_string(list_filter([
 CASE WHEN status = 'ready' AND seq % 43 = 0 THEN 'sku' END, CASE WHEN seq % 37 = 0 THEN 'link' END],
 lambda x: x IS NOT NULL), '|') AS violations FROM cat""", "cat")
def _(spark, sf):
    rows = (catalog(spark, sf).withColumn("source_url", F.col("raw_url"))
            .withColumn("sku", F.when(F.col("seq") % 43 == 0, "").otherwise(F.col("sku")))
            .withColumn("time_text", F.col("discovered_at").cast("string")))
    good, bad = Q.split(rows, Q.catalog_violations())
    return good.select("seq", F.lit("").alias("violations")).union(
        bad.select("seq", F.array_join("violations", "|").alias("violations")))


@query("flt6_catalog_unique_gate", """WITH ready AS (SELECT * FROM cat WHERE status = 'ready'),
 review AS (SELECT * FROM cat WHERE status = 'review')
SELECT (SELECT count(*) FROM ready WHERE seq % 71 = 0) AS unverified, CAST(0 AS BIGINT) AS unnamed,
 CAST(0 AS BIGINT) AS untokened,
 (SELECT count(*) FROM (SELECT 1 FROM ready GROUP BY chain, sku HAVING count(*) > 1)) AS shared_sku,
 (SELECT count(*) FROM (SELECT 1 FROM ready GROUP BY source_url HAVING count(*) > 1)) AS shared_link,
 (SELECT count(*) FROM (SELECT 1 FROM review GROUP BY source_url HAVING count(*) > 1)) AS shared_review_link,
 (SELECT count(*) FROM (SELECT source_url FROM ready INTERSECT SELECT source_url FROM review)) AS ready_and_review""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).withColumn("verified", F.col("seq") % 71 != 0).withColumn(
        "verify_tokens", F.array("variant_id"))
    return Q.catalog_gate(rows.filter("status = 'ready'"), rows.filter("status = 'review'"))


@query("flt7_source_limits", """SELECT seq, array_to_string(list_filter([
 CASE WHEN c % 60 NOT BETWEEN 1 AND 50 THEN 'max_pages' END, CASE WHEN c % 1100 NOT BETWEEN 1 AND 1000 THEN 'max_candidates' END,
 CASE WHEN c % 33 NOT BETWEEN 1 AND 30 THEN 'scroll_rounds' END], lambda x: x IS NOT NULL), '|') AS violations FROM cat""", "cat")
def _(spark, sf):
    c = F.col("c")
    rows = (catalog(spark, sf).withColumn("seeds", F.array("listing_url")).withColumn("max_pages", c % 60)
            .withColumn("max_candidates", c % 1100).withColumn("scroll_rounds", c % 33))
    return rows.select("seq", F.array_join(Q.source_violations(), "|").alias("violations"))


@query("flt1_brand_scope", "SELECT seq, brand FROM cat WHERE brand = 'Apple'", "cat")
def _(spark, sf):
    rows = catalog(spark, sf)
    return Q.brand_scope(rows.withColumn("brand", F.concat(F.lit(" "), F.upper("brand"), F.lit(" "))), [" apple"]).select(
        "seq", F.initcap(F.trim("brand")).alias("brand"))


@query("flt2_scope_route", f"""SELECT seq, CASE WHEN seq % 9 = 0 THEN 'not_new' WHEN model IN ('iMac', 'Mac Mini')
 THEN 'desktop' WHEN category = '{V.EARBUDS}' AND seq % 8 = 0 THEN 'accessory' ELSE 'candidate' END AS route FROM cat""",
       "cat")
def _(spark, sf):
    name = F.col("product_name")
    name = F.when(F.col("seq") % 8 == 0, F.regexp_replace(name, "AirPods", "Powerbeats")).otherwise(name)
    name = F.when(F.col("seq") % 9 == 0, F.concat(name, F.lit(" CŨ đẹp"))).otherwise(name)
    keep, out = Q.scope_route(catalog(spark, sf).withColumn("product_name", name))
    return keep.select("seq", F.lit("candidate").alias("route")).union(out.select("seq", F.col("scope_reason")))


@query("flt9_verified_variant", f"""WITH {TRACKED} SELECT seq, o.chain, o.model FROM obs o JOIN tracked t ON t.model = o.model
WHERE proof_model = o.model AND proof_code = variant_id AND proof_dated
 AND (t.color IS NULL OR (proof_color_id IS NOT NULL AND lower(proof_color) = lower(t.color)))
 AND CASE WHEN promo_price IS NULL THEN contains(promo_text, '[Tình trạng]') ELSE promo_price > 0 END""", "obs")
def _(spark, sf):
    return Q.verified_variant(observations(spark, sf), tracked(spark)).select("seq", "chain", "model")


@query("flt12_tracked_projection", f"""WITH {TRACKED} SELECT 'row' AS kind, seq FROM obs SEMI JOIN tracked USING (model)
WHERE k % 4 <> 0 UNION ALL SELECT 'issue', seq FROM cat WHERE seq % 6 = 0 OR model IN (SELECT model FROM tracked)""",
       "obs", "cat")
def _(spark, sf):
    models = tracked(spark)
    rows = observations(spark, sf).withColumn("selection", F.when(F.col("k") % 4 != 0, "selected").otherwise("other_color"))
    issues = catalog(spark, sf).withColumn("model", F.when(F.col("seq") % 6 != 0, F.col("model")))
    return Q.tracked_rows(rows, models).select(F.lit("row").alias("kind"), "seq").union(
        Q.tracked_issues(issues, models).select(F.lit("issue").alias("kind"), "seq"))


@query("jon10_rule_match", """SELECT seq, CASE WHEN i < 36 AND model <> 'AirPods Max' THEN model END AS label,
 CAST(CASE WHEN model = 'AirPods Max' THEN 0 WHEN i < 36 THEN 1 WHEN i = 38 THEN 2 ELSE 0 END AS BIGINT) AS hits FROM obs""", "obs")
def _(spark, sf):
    rows = observations(spark, sf).select("seq", "product_name")
    return with_hits(rows, rule_index(rule_rows(spark, V.MODEL_RULES))).select(
        "seq", only_hit().alias("label"), F.size("hits").cast("bigint").alias("hits"))
