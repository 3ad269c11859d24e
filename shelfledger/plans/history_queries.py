"""Queries over the observation history."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import calendar as cal
from shelfledger.functions import text as T
from shelfledger.operators import history as H
from shelfledger.operators import movement as M
from shelfledger.plans.carriers import observations
from shelfledger.plans.registry import query

WEEK, DAY = "2024-01-15", "2024-01-20"

# SQL pieces shared by the checks below
LAST_DAY = """last_day AS (SELECT * FROM (SELECT *, row_number() OVER (
 PARTITION BY chain, sku, business_date ORDER BY observed_at DESC, seq) AS rn FROM obs) WHERE rn = 1)"""
LAST_WEEK = """last_week AS (SELECT * FROM (SELECT *, row_number() OVER (
 PARTITION BY week_start, chain, sku ORDER BY observed_at DESC, seq) AS rn FROM obs) WHERE rn = 1)"""
SERIES_DAY = """series_day AS (SELECT * FROM (SELECT *, row_number() OVER (
 PARTITION BY chain, sku, model, storage, display_variant, color, business_date ORDER BY observed_at DESC, seq) AS rn
 FROM obs) WHERE rn = 1)"""
PAIRS = LAST_WEEK + """, pairs AS (SELECT c.*, p.promo_price AS before_price, p.promo_text AS before_text,
  p.seq IS NOT NULL AS matched FROM last_week c LEFT JOIN last_week p
  ON p.chain = c.chain AND p.sku = c.sku AND p.week_start = c.week_start - INTERVAL 7 DAY)"""
BIG = "(abs(delta) * 100 > before_price * 3 OR abs(delta) > 500000)"
MOVES = SERIES_DAY + """, moves AS (SELECT a.chain, a.sku, a.color, a.business_date, b.promo_price AS before_price,
  a.promo_price AS after_price, a.promo_price - b.promo_price AS delta, a.model, a.seq
  FROM series_day a JOIN series_day b ON a.chain = b.chain AND a.sku = b.sku AND a.model = b.model
  AND a.storage = b.storage AND a.display_variant = b.display_variant AND a.color = b.color
  AND b.business_date = a.business_date - INTERVAL 1 DAY
  WHERE a.promo_price > 0 AND b.promo_price > 0 AND a.promo_price <> b.promo_price)"""


def text_date(name: str):
    return F.col(name).cast("string").alias(name)


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)


STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"


@query("src6_date_range_scan", f"""SELECT seq, chain, sku, CAST(business_date AS VARCHAR) AS business_date, promo_price
FROM obs WHERE business_date BETWEEN DATE '{WEEK}' AND DATE '{WEEK}' + INTERVAL 6 DAY""", "obs")
def _(spark, sf):
    return H.date_range(observations(spark, sf), WEEK).select("seq", "chain", "sku", text_date("business_date"),
                                                               "promo_price")


@query("src7_visible_week", f"""WITH {LAST_DAY}, published AS (SELECT chain, sku, business_date FROM last_day
 WHERE stale_since IS NULL AND promo_price IS NOT NULL)
SELECT o.seq, o.chain, o.sku FROM obs o WHERE EXISTS (SELECT 1 FROM published p WHERE p.chain = o.chain
 AND p.sku = o.sku AND p.business_date = o.business_date)""", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    published = M.fresh_only(H.last_per_day(rows)).filter("promo_price IS NOT NULL")
    return H.visible(rows, published).select("seq", "chain", "sku")


@query("win1_latest_asof", f"""SELECT seq, chain, sku, promo_price, {STAMP.format('observed_at')} FROM (
 SELECT *, row_number() OVER (PARTITION BY chain, sku ORDER BY observed_at DESC, seq) AS rn FROM obs
 WHERE business_date <= DATE '{DAY}') WHERE rn = 1""", "obs")
def _(spark, sf):
    return H.as_of(observations(spark, sf), DAY).select("seq", "chain", "sku", "promo_price", stamp("observed_at"))


@query("win2_day_grid", f"""WITH {LAST_DAY}
SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku,
 {', '.join(f"max(CASE WHEN isodow(business_date) = {i} THEN promo_price END) AS day{i}" for i in range(1, 8))}
FROM last_day GROUP BY ALL""", "obs")
def _(spark, sf):
    return H.day_grid(observations(spark, sf)).withColumn("week_start", text_date("week_start"))


WEEK_CHANGE = LAST_DAY + """, edges AS (SELECT week_start, chain, sku, count(*) AS observed_days,
  arg_min(seq, business_date) AS a, arg_max(seq, business_date) AS z FROM last_day GROUP BY ALL),
 changes AS (SELECT e.week_start, e.chain, e.sku, e.observed_days, z.business_date AS last_day,
  z.promo_price AS last_price, z.promo_text, z.observed_at,
  CASE WHEN observed_days >= 2 THEN z.promo_price - a.promo_price END AS change
  FROM edges e JOIN last_day a ON a.seq = e.a JOIN last_day z ON z.seq = e.z)"""


@query("win3_week_change", f"""WITH {WEEK_CHANGE} SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku,
 observed_days, CAST(last_day AS VARCHAR) AS last_day, last_price, change FROM changes""", "obs")
def _(spark, sf):
    rows = H.week_change(observations(spark, sf))
    return rows.select(text_date("week_start"), "chain", "sku", F.col("observed_days").cast("bigint").alias(
        "observed_days"), text_date("last_day"), "last_price", "change")


MERGE_CHECK = """SELECT seq, chain, sku, CAST(business_date AS VARCHAR) AS business_date, promo_price FROM (
 SELECT *, row_number() OVER (PARTITION BY chain, sku, business_date ORDER BY observed_at DESC,
 CASE WHEN k >= 50 THEN 1 ELSE 0 END DESC, seq DESC) AS rn FROM obs) WHERE rn = 1"""


@query("win5_history_merge", MERGE_CHECK, "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    empty = rows.limit(0)
    previous = H.merge_history(empty, rows.filter("k < 50"))
    merged = H.merge_history(previous, rows.filter("k >= 50"))
    return merged.select("seq", "chain", "sku", text_date("business_date"), "promo_price")


@query("win6_day_snapshots", f"""WITH {LAST_DAY}, heads AS (SELECT chain, business_date, count(*) AS row_count,
 max(observed_at) AS updated FROM last_day GROUP BY ALL)
SELECT r.seq, r.chain, CAST(r.business_date AS VARCHAR) AS business_date, h.row_count, {STAMP.format('updated')}
FROM last_day r JOIN heads h USING (chain, business_date)""", "obs")
def _(spark, sf):
    rows, headers = H.day_snapshots(observations(spark, sf))
    return rows.join(headers, ["chain", "business_date"]).select("seq", "chain", text_date("business_date"),
                                                                 "row_count", stamp("updated"))


@query("jon1_week_baseline", f"""WITH {PAIRS} SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku, promo_price,
 before_price, matched FROM pairs""", "obs")
def _(spark, sf):
    return week_pairs(spark, sf).select(text_date("week_start"), "chain", "sku", "promo_price", "before_price", "matched")


def week_pairs(spark, sf):
    weekly = M.weekly_latest(observations(spark, sf))
    return M.compare_runs(weekly, M.shifted_week(weekly), ["week_start", *H.SERIES])


DROPS = PAIRS + f""", drops AS (SELECT *, delta * 100.0 / before_price AS percent FROM (
 SELECT *, before_price - promo_price AS delta FROM pairs) WHERE delta > 0 AND {BIG})"""


@query("jon2_price_drops", f"""WITH {DROPS} SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku, before_price,
 promo_price, delta FROM drops""", "obs")
def _(spark, sf):
    return M.price_drops(week_pairs(spark, sf)).select(text_date("week_start"), "chain", "sku", "before_price",
                                                       "promo_price", "delta")


PROMOS = PAIRS + r""", promos AS (SELECT * FROM pairs WHERE matched AND promo_text <> ''
 AND trim(regexp_replace(lower(promo_text), '\s+', ' ', 'g')) <> trim(regexp_replace(lower(before_text), '\s+', ' ', 'g'))
 AND (contains(lower(promo_text), 'voucher') OR contains(lower(promo_text), 'tặng')))"""


@query("jon3_promo_changes", f"""WITH {PROMOS} SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku, promo_text
FROM promos""", "obs")
def _(spark, sf):
    return M.promo_changes(week_pairs(spark, sf)).select(text_date("week_start"), "chain", "sku", "promo_text")


@query("jon4_day_over_day", f"""WITH {LAST_DAY} SELECT CAST(a.business_date AS VARCHAR) AS business_date, a.chain, a.sku,
 a.promo_price, a.promo_price - b.promo_price AS change FROM last_day a LEFT JOIN last_day b ON a.chain = b.chain
 AND a.sku = b.sku AND b.business_date = a.business_date - INTERVAL 1 DAY""", "obs")
def _(spark, sf):
    return M.day_view(observations(spark, sf)).select(text_date("business_date"), "chain", "sku", "promo_price", "change")


@query("jon5_day_movement", f"""WITH {MOVES} SELECT CAST(business_date AS VARCHAR) AS business_date, chain, sku, color,
 before_price, after_price, delta, CAST(delta AS DOUBLE) / before_price * 100 AS percent, {BIG} AS shock FROM moves""",
       "obs")
def _(spark, sf):
    return M.day_movements(observations(spark, sf)).select(
        text_date("business_date"), "chain", "sku", "color", "before_price", "after_price", "delta", "percent", "shock")


@query("jon6_week_movement", f"""WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (
 PARTITION BY chain, sku, model, storage, display_variant, color, week_start ORDER BY observed_at DESC, seq) AS rn
 FROM obs) WHERE rn = 1)
SELECT CAST(a.week_start AS VARCHAR) AS week_start, a.chain, a.sku, a.color, b.promo_price AS before_price,
 a.promo_price AS after_price, a.promo_price - b.promo_price AS delta FROM w a JOIN w b ON a.chain = b.chain
 AND a.sku = b.sku AND a.model = b.model AND a.storage = b.storage AND a.display_variant = b.display_variant
 AND a.color = b.color AND b.week_start = a.week_start - INTERVAL 7 DAY
WHERE a.promo_price > 0 AND b.promo_price > 0 AND a.promo_price <> b.promo_price""", "obs")
def _(spark, sf):
    return M.week_movements(observations(spark, sf)).select(text_date("week_start"), "chain", "sku", "color",
                                                            "before_price", "after_price", "delta")


def hidden_models(spark):
    return spark.createDataFrame([(V.PHONE.upper(), "  iphone   17 "), (V.TABLET, "IPAD MINI 7")],
                                 "category string, model string")


@query("jon9_hidden_models", f"""SELECT seq, chain, sku, model FROM obs
WHERE NOT ((category = '{V.PHONE}' AND model = 'iPhone 17') OR (category = '{V.TABLET}' AND model = 'iPad Mini 7'))""",
       "obs")
def _(spark, sf):
    return M.hide_models(observations(spark, sf), hidden_models(spark)).select("seq", "chain", "sku", "model")


@query("flt10_fresh_only", "SELECT seq, chain, sku FROM obs WHERE stale_since IS NULL", "obs")
def _(spark, sf):
    return M.fresh_only(observations(spark, sf)).select("seq", "chain", "sku")


@query("flt11_report_scope", """WITH listed AS (SELECT DISTINCT chain, sku FROM obs WHERE promo_price > 4000000)
SELECT seq, o.chain, o.sku FROM obs o SEMI JOIN listed l ON l.chain = o.chain AND l.sku = o.sku""", "obs")
def _(spark, sf):
    rows = observations(spark, sf)
    return M.report_scope(rows, rows.filter("promo_price > 4000000")).select("seq", "chain", "sku")


@query("top1_top_drops", f"""WITH {DROPS} SELECT CAST(week_start AS VARCHAR) AS week_start, chain, sku, delta, percent
FROM drops WHERE week_start = DATE '{WEEK}' ORDER BY percent DESC, delta DESC, chain, sku LIMIT 10""", "obs")
def _(spark, sf):
    drops = M.price_drops(week_pairs(spark, sf)).filter(F.col("week_start") == F.lit(WEEK).cast("date"))
    return M.top_drops(drops).select(text_date("week_start"), "chain", "sku", "delta", "percent")


@query("top2_top_promos_status", f"""WITH {PROMOS} (SELECT 'promo' AS kind, chain, sku, promo_text FROM promos
 WHERE week_start = DATE '{WEEK}' ORDER BY chain, sku LIMIT 10) UNION ALL (SELECT 'status', chain, sku, promo_text
 FROM last_week WHERE week_start = DATE '{WEEK}' AND promo_price IS NULL ORDER BY chain, sku LIMIT 10)""", "obs")
def _(spark, sf):
    week = F.col("week_start") == F.lit(WEEK).cast("date")
    pairs = week_pairs(spark, sf).filter(week)
    promos = M.promo_changes(pairs).orderBy("chain", "sku").limit(10).withColumn("kind", F.lit("promo"))
    status = (M.weekly_latest(observations(spark, sf)).filter(week & F.col("promo_price").isNull())
              .orderBy("chain", "sku").limit(10).withColumn("kind", F.lit("status")))
    columns = ["kind", "chain", "sku", "promo_text"]
    return promos.select(columns).union(status.select(columns))


@query("top3_top_movements", f"""WITH {MOVES} SELECT CAST(business_date AS VARCHAR) AS business_date, chain, sku, color,
 delta FROM moves WHERE business_date = DATE '{DAY}' ORDER BY abs(delta) DESC, chain, sku, color LIMIT 20""", "obs")
def _(spark, sf):
    moves = M.day_movements(observations(spark, sf)).filter(F.col("business_date") == F.lit(DAY).cast("date"))
    return M.top_movements(moves, "chain", "sku", "color").select(text_date("business_date"), "chain", "sku", "color",
                                                                  "delta")


@query("agg17_dashboard_kpis", f"""WITH {WEEK_CHANGE}
SELECT CAST(week_start AS VARCHAR) AS week_start, count(*) AS products, count(DISTINCT chain) AS chains,
 (SELECT count(DISTINCT business_date) FROM obs o WHERE o.week_start = changes.week_start) AS observed_days,
 count(change) AS comparable, count(*) FILTER (change < 0) AS drops, count(*) FILTER (promo_text <> '') AS with_promo,
 (SELECT strftime(max(observed_at), '%Y-%m-%d %H:%M:%S.%f') FROM obs o WHERE o.week_start = changes.week_start)
 AS last_capture FROM changes GROUP BY week_start""", "obs")
def _(spark, sf):
    from shelfledger.operators.audit import dashboard_kpis
    return dashboard_kpis(observations(spark, sf)).select(
        text_date("week_start"), "products", "chains", "observed_days", "comparable", "drops", "with_promo",
        stamp("last_capture"))


@query("agg18_day_counts", """SELECT CAST(business_date AS VARCHAR) AS business_date, chain, count(*) AS records,
 count(DISTINCT sku) AS skus FROM obs GROUP BY ALL""", "obs")
def _(spark, sf):
    from shelfledger.operators.audit import day_counts
    return day_counts(observations(spark, sf)).select(text_date("business_date"), "chain", "records", "skus")


@query("col14_business_calendar", """SELECT seq, CAST(business_date AS VARCHAR) AS day, CAST(week_start AS VARCHAR) AS monday,
 CAST(week_start + INTERVAL 6 DAY AS DATE)::VARCHAR AS sunday, CAST(week_start - INTERVAL 7 DAY AS DATE)::VARCHAR AS done,
 CAST(isoyear(business_date) AS BIGINT) AS y, CAST(week(business_date) AS BIGINT) AS w,
 CAST(isoyear(business_date - INTERVAL 7 DAY) AS BIGINT) AS py, CAST(week(business_date - INTERVAL 7 DAY) AS BIGINT) AS pw,
 'W' || CAST(o - 13 * floor(o / 13) + 1 AS BIGINT) || 'Q' || CAST(floor((o - 52 * floor(o / 52)) / 13) + 1 AS BIGINT)
 || 'FY' || CAST(27 + floor(o / 52) AS BIGINT) AS label
 FROM (SELECT *, CAST(date_diff('day', DATE '2026-09-28', week_start) / 7 AS DOUBLE) AS o FROM obs)""", "obs")
def _(spark, sf):
    day = F.col("business_date")
    return observations(spark, sf).select(
        "seq", day.cast("string").alias("day"), cal.monday(day).cast("string").alias("monday"),
        cal.week_end(day).cast("string").alias("sunday"), cal.last_completed_week(day).cast("string").alias("done"),
        cal.iso_year(day).cast("bigint").alias("y"), cal.iso_week(day).cast("bigint").alias("w"),
        cal.iso_year(F.date_sub(day, 7)).cast("bigint").alias("py"),
        cal.iso_week(F.date_sub(day, 7)).cast("bigint").alias("pw"), cal.fiscal_label(day).alias("label"))


@query("col17_price_text", """WITH h AS (SELECT seq, promo_price AS p, (promo_price + 5000) // 10000 AS m,
 (10000000000 + promo_price) // (2 * promo_price) AS c FROM obs)
SELECT seq, replace(format('{:,}', p), ',', '.') || 'đ' AS money,
 CASE WHEN m % 100 = 0 THEN '' || (m // 100) WHEN m % 10 = 0 THEN (m // 100) || ',' || (m % 100 // 10)
  ELSE (m // 100) || ',' || lpad('' || (m % 100), 2, '0') END || ' tr' AS millions,
 (c // 100) || '.' || lpad('' || (c % 100), 2, '0') AS percent FROM h""", "obs")
def _(spark, sf):
    price = F.col("promo_price")
    rows = observations(spark, sf)
    return rows.select("seq", T.money_text(price).alias("money"), T.millions_text(price).alias("millions"),
                       T.percent_text(F.lit(500000), price).alias("percent"))


@query("set3_missing_dates", """WITH d AS (SELECT DISTINCT business_date, week_start FROM obs),
 w AS (SELECT DISTINCT week_start FROM d)
SELECT CAST(week_start AS VARCHAR) AS week_start, CAST(CAST(week_start + INTERVAL (i) DAY AS DATE) AS VARCHAR) AS business_date
FROM w, range(7) t(i) WHERE CAST(week_start + INTERVAL (i) DAY AS DATE) NOT IN (SELECT business_date FROM d)""", "obs")
def _(spark, sf):
    return H.missing_dates(observations(spark, sf)).select(text_date("week_start"), text_date("business_date"))


@query("win6_refuse_naive", """SELECT seq, CASE WHEN seq % 13 = 0 THEN 'refused' ELSE 'accepted' END AS outcome,
 CASE WHEN seq % 13 <> 0 THEN strftime(date_trunc('second', observed_at), '%Y-%m-%d %H:%M:%S') END AS utc FROM obs""", "obs")
def _(spark, sf):
    local = F.date_format(cal.local_time(F.col("observed_at")), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(local, F.when(F.col("seq") % 13 == 0, "").otherwise("+07:00"))
    good, bad = H.refuse_naive(observations(spark, sf).withColumn("observed_text", text))
    tag = lambda df, name: df.select("seq", F.lit(name).alias("outcome"),
                                     F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss").alias("utc"))
    return tag(good, "accepted").union(tag(bad, "refused"))
