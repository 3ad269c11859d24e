"""Observation, catalog, run and payload tables derived from the shared test tables.

Each carrier exists twice: as a DataFrame for the jobs and as SQL for the independent check.  Work grows with the
tables; no row is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfledger import fixed_values as V

EVENT_CHAIN = {"click": "TGDD", "view": "CellphoneS", "purchase": "FPT Shop", "signup": "Viettel Store",
               "error": "Phong Vũ"}
STORAGES = ["128GB", "256GB", "512GB", "1TB"]
COLORS = ["Đen", "Bạc", "Hồng"]
OTHER_NAMES = ["Samsung Galaxy S26 Ultra 5G 12GB", "Xiaomi Redmi Note 15 Pro 5G 8GB", "iPhone 17 và iPhone 16",
               "Điện thoại Nokia 3210 4G"]
OTHER_MODELS = ["Galaxy S26 Ultra", "Redmi Note 15 Pro", "iPhone 17 và iPhone 16", "Nokia 3210"]


def _prefix(model: str) -> tuple[str, str]:
    for start, word, category in (("iPhone", "Điện thoại", V.PHONE), ("iPad", "Máy tính bảng", V.TABLET),
                                  ("Apple Watch", "Đồng hồ thông minh", V.WATCH),
                                  ("AirPods", "Tai nghe Bluetooth", V.EARBUDS)):
        if model.startswith(start):
            return word, category
    return "Laptop", V.LAPTOP


NAMES = [f"{_prefix(m)[0]} {m}" + (" 16GB" if m.startswith("MacBook") else "") for m in V.MODEL_NAMES] + OTHER_NAMES
MODELS = V.MODEL_NAMES + OTHER_MODELS
NAME_CATEGORIES = [_prefix(m)[1] for m in V.MODEL_NAMES] + [V.PHONE] * 4
NAME_BRANDS = ["Apple"] * 36 + ["Samsung", "Xiaomi", "Apple", "Nokia"]
TRACKED_COLORS = [V.MODEL_COLORS.get(m, "") for m in MODELS]
REASONS = [
    "Phong Vũ chi tiết: HTTP 403 — bị chặn truy cập", "FPT Shop: HTTP 429", "robots.txt không cho cào",
    "HTTP 502 trên nguồn", "Lỗi mạng khi đọc trang", "Biến thể hết hàng tại khu vực", "Sản phẩm đặt trước",
    "Mã màu đã khóa không còn", "Danh mục đọc thiếu thẻ", "Trang chưa mở bán", "Trang đổi cấu trúc",
    "Hàng cũ ngoài phạm vi", "Lỗi kỹ thuật KeyError", "Cần đối chiếu",
]
KINDS = ["blocked", "rate_limited", "robots", "http_error", "network", "out_of_stock", "preorder", "variant_changed",
         "incomplete_listing", "no_price_data", "structure_changed", "out_of_scope", "technical", "other"]
MONEY_STYLES = 8


def _sql(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def sql_list(values: list) -> str:
    return "[" + ", ".join(_sql(v) for v in values) + "]"


def pick(values: list[str], index: str) -> str:
    """Spark SQL text that takes the ``index``-th value."""
    return f"element_at(array({', '.join(_sql(v) for v in values)}), cast({index} AS int) + 1)"


def pick_sql(values: list[str], index: str) -> str:
    return f"{sql_list(values)}[({index}) + 1]"


def by_chain_sql(field: str, chain: str = "chain") -> str:
    whens = " ".join(f"WHEN {_sql(c.name)} THEN {_sql(getattr(c, field))}" for c in V.CHAINS)
    return f"CASE {chain} {whens} END"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared table."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- observations ----------------------------------------------------------------------------------------------------


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """OBS: one row per event; series key chain + sku."""
    return observation_view(table(spark, sf, "events"))


def observation_view(source: DataFrame) -> DataFrame:
    """OBS over a batch or streaming table of events.  Written as SQL text: it is a view, not a job."""
    events = " ".join(f"WHEN {_sql(a)} THEN {_sql(b)}" for a, b in EVENT_CHAIN.items())
    base = source.selectExpr(
        "event_id AS seq", "user_id AS u", "user_id % 40 AS i", f"CASE event_type {events} END AS chain", "value",
        "cast(get_json_object(props, '$.k') AS bigint) AS k", "ts AS observed_at",
        f"to_date(convert_timezone('UTC', '{V.BUSINESS_ZONE}', ts)) AS business_date")
    rows = base.selectExpr(
        "seq", "chain", "k", "i", "u", f"{by_chain_sql('slug')} AS slug", f"{by_chain_sql('code')} || '-' || u AS sku",
        "cast(u AS string) AS variant_id", f"{pick(MODELS, 'i')} AS model", f"{pick(STORAGES, 'u % 4')} AS storage",
        f"{pick(['', 'WiFi', 'GPS'], 'u % 3')} AS display_variant",
        f"CASE WHEN k % 25 = 0 THEN 'Đen' ELSE {pick(COLORS, 'u % 3')} END AS color",
        f"{pick(NAME_BRANDS, 'i')} AS brand", f"{pick(NAME_CATEGORIES, 'i')} AS category",
        f"{pick(NAMES, 'i')} || ' ' || {pick(STORAGES, 'u % 4')} AS product_name", "observed_at", "business_date",
        "CASE WHEN k % 17 <> 0 THEN nullif(cast(round(value * 100) AS bigint) * 1000, 0) END AS promo_price",
        f"""CASE WHEN k % 34 = 0 THEN 'Hết hàng' WHEN k % 17 = 0
         THEN '{V.STATUS_PREFIX}Hết hàng' || chr(10) || 'Liên hệ cửa hàng'
         WHEN k % 10 = 0 THEN 'Tặng  VOUCHER ' || (k % 30) WHEN k % 5 = 0 THEN 'tặng voucher ' || (k % 30) ELSE '' END
         AS promo_text""",
        "CASE WHEN seq % 23 = 0 THEN observed_at END AS stale_since",
        f"""CASE WHEN seq % 29 = 0 THEN 'http://' ELSE 'https://' END || CASE WHEN seq % 31 = 0 THEN 'shop.example'
         ELSE {by_chain_sql('domain')} END || '/p/' || u AS source_url""",
        "k % 6 <> 0 AS promotion_complete", f"{pick(TRACKED_COLORS, 'i')} AS wanted")
    return rows.selectExpr(
        "* except (wanted)",
        """CASE WHEN k % 17 = 0 OR k % 3 = 0 THEN NULL WHEN k % 41 = 0 THEN promo_price - 10000
         ELSE promo_price + (k % 7) * 10000 END AS original_price""",
        "date_sub(business_date, weekday(business_date)) AS week_start",
        """named_struct('model', CASE WHEN k % 19 = 0 THEN 'other' ELSE model END,
         'canonical_color', CASE WHEN k % 13 = 0 THEN 'khác' ELSE wanted END,
         'product_code', CASE WHEN k % 11 = 0 THEN 'x' ELSE variant_id END,
         'website_color_id', CASE WHEN k % 23 <> 0 THEN variant_id END,
         'verified_at', CASE WHEN k % 29 <> 0 THEN cast(observed_at AS string) END) AS color_evidence""")


OBS_SQL = f"""obs0 AS (
 SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 40 AS i,
  CASE event_type {' '.join(f"WHEN {_sql(a)} THEN {_sql(b)}" for a, b in EVENT_CHAIN.items())} END AS chain FROM events),
obs1 AS (
 SELECT event_id AS seq, chain, k, i, user_id AS u, {by_chain_sql('slug')} AS slug,
  {by_chain_sql('code')} || '-' || user_id AS sku, CAST(user_id AS VARCHAR) AS variant_id,
  {pick_sql(MODELS, 'i')} AS model, {pick_sql(STORAGES, 'user_id % 4')} AS storage,
  {pick_sql(['', 'WiFi', 'GPS'], 'user_id % 3')} AS display_variant,
  CASE WHEN k % 25 = 0 THEN 'Đen' ELSE {pick_sql(COLORS, 'user_id % 3')} END AS color,
  {pick_sql(NAME_BRANDS, 'i')} AS brand, {pick_sql(NAME_CATEGORIES, 'i')} AS category,
  {pick_sql(NAMES, 'i')} || ' ' || {pick_sql(STORAGES, 'user_id % 4')} AS product_name,
  ts AS observed_at, CAST(ts + INTERVAL 7 HOUR AS DATE) AS business_date,
  CASE WHEN k % 17 <> 0 THEN nullif(CAST(round(value * 100) AS BIGINT) * 1000, 0) END AS promo_price,
  CASE WHEN k % 34 = 0 THEN 'Hết hàng' WHEN k % 17 = 0 THEN '{V.STATUS_PREFIX}Hết hàng' || chr(10) || 'Liên hệ cửa hàng'
   WHEN k % 10 = 0 THEN 'Tặng  VOUCHER ' || (k % 30) WHEN k % 5 = 0 THEN 'tặng voucher ' || (k % 30) ELSE '' END
   AS promo_text,
  CASE WHEN event_id % 23 = 0 THEN ts END AS stale_since,
  CASE WHEN event_id % 29 = 0 THEN 'http://' ELSE 'https://' END
   || CASE WHEN event_id % 31 = 0 THEN 'shop.example' ELSE {by_chain_sql('domain')} END || '/p/' || user_id AS source_url,
  k % 6 <> 0 AS promotion_complete, {pick_sql(TRACKED_COLORS, 'i')} AS wanted FROM obs0),
obs AS (
 SELECT *, CASE WHEN k % 17 = 0 OR k % 3 = 0 THEN NULL WHEN k % 41 = 0 THEN promo_price - 10000
   ELSE promo_price + (k % 7) * 10000 END AS original_price,
  CAST(date_trunc('week', business_date) AS DATE) AS week_start,
  CASE WHEN k % 19 = 0 THEN 'other' ELSE model END AS proof_model,
  CASE WHEN k % 13 = 0 THEN 'khác' ELSE wanted END AS proof_color,
  CASE WHEN k % 11 = 0 THEN 'x' ELSE variant_id END AS proof_code,
  CASE WHEN k % 23 <> 0 THEN variant_id END AS proof_color_id, k % 29 <> 0 AS proof_dated FROM obs1)"""


# --- catalog ---------------------------------------------------------------------------------------------------------


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    """CAT: one candidate link per order; a third of the link pairs share (chain, sku)."""
    site = by_chain_sql("domain")
    base = table(spark, sf, "orders").selectExpr(
        "*", "o_orderkey AS seq", "o_custkey AS c", "o_custkey % 40 AS i",
        f"{pick(V.CHAIN_NAMES, 'o_custkey % 5')} AS chain",
        """CASE WHEN (o_custkey div 10) % 3 = 0 THEN o_custkey - 5 * ((o_custkey % 10) div 5) ELSE o_custkey END AS key""")
    return base.selectExpr(
        "seq", "c", "i", "key", "chain", f"{by_chain_sql('slug')} AS slug",
        f"'https://' || {site} || '/san-pham-' || c AS source_url",
        f"CASE WHEN seq % 37 = 0 THEN 'http://' ELSE 'https://' END || {site} || '/san-pham-' || c AS raw_url",
        f"{by_chain_sql('code')} || '-' || key AS sku", "cast(key AS string) AS variant_id",
        "CASE WHEN o_orderstatus = 'P' OR c % 7 = 0 THEN 'review' ELSE 'ready' END AS status",
        f"{pick(REASONS, 'seq % 14')} AS reason", "seq % 86 AS input_row",
        f"'https://' || {site} || '/list/' || o_orderpriority AS listing_url",
        "CASE WHEN seq % 11 <> 0 THEN cast(o_totalprice AS bigint) END AS listing_price", "seq % 3 AS stock",
        "o_orderdate AS discovered_at", "o_orderpriority AS priority",
        f"{pick(NAMES, 'i')} || ' ' || {pick(STORAGES, 'c % 4')} AS product_name",
        f"{pick(NAME_BRANDS, 'i')} AS brand", f"{pick(NAME_CATEGORIES, 'i')} AS category",
        f"{pick(MODELS, 'i')} AS model", f"{pick(STORAGES, 'c % 4')} AS storage", f"{pick(COLORS, 'c % 3')} AS color",
        "o_totalprice AS total")


CAT_SQL = f"""cat0 AS (
 SELECT *, {pick_sql(V.CHAIN_NAMES, 'o_custkey % 5')} AS chain, o_custkey % 40 AS i,
  CASE WHEN (o_custkey // 10) % 3 = 0 THEN o_custkey - 5 * ((o_custkey % 10) // 5) ELSE o_custkey END AS key FROM orders),
cat AS (
 SELECT o_orderkey AS seq, o_custkey AS c, i, key, chain, {by_chain_sql('slug')} AS slug,
  'https://' || {by_chain_sql('domain')} || '/san-pham-' || o_custkey AS source_url,
  CASE WHEN o_orderkey % 37 = 0 THEN 'http://' ELSE 'https://' END || {by_chain_sql('domain')} || '/san-pham-' || o_custkey
   AS raw_url,
  {by_chain_sql('code')} || '-' || key AS sku, CAST(key AS VARCHAR) AS variant_id,
  CASE WHEN o_orderstatus = 'P' OR o_custkey % 7 = 0 THEN 'review' ELSE 'ready' END AS status,
  {pick_sql(REASONS, 'o_orderkey % 14')} AS reason, {pick_sql(KINDS, 'o_orderkey % 14')} AS kind,
  o_orderkey % 86 AS input_row, 'https://' || {by_chain_sql('domain')} || '/list/' || o_orderpriority AS listing_url,
  CASE WHEN o_orderkey % 11 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS listing_price, o_orderkey % 3 AS stock,
  o_orderdate AS discovered_at, o_orderpriority AS priority,
  {pick_sql(NAMES, 'i')} || ' ' || {pick_sql(STORAGES, 'o_custkey % 4')} AS product_name,
  {pick_sql(NAME_BRANDS, 'i')} AS brand, {pick_sql(NAME_CATEGORIES, 'i')} AS category,
  {pick_sql(MODELS, 'i')} AS model, {pick_sql(STORAGES, 'o_custkey % 4')} AS storage,
  {pick_sql(COLORS, 'o_custkey % 3')} AS color, o_totalprice AS total FROM cat0)"""


# --- runs ------------------------------------------------------------------------------------------------------------


def run_headers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", f"{pick(V.CHAIN_NAMES, 'o_custkey % 5')} AS chain", "o_orderdate AS completed_at",
        "o_orderkey % 7 AS product_count", "cast(extract(YEAROFWEEK FROM o_orderdate) AS bigint) AS year",
        "cast(weekofyear(o_orderdate) AS bigint) AS week", "o_custkey AS c", "o_orderstatus AS state")


def run_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS run_id", "l_partkey AS part", "l_suppkey AS supplier", "l_linenumber AS line",
        "cast(l_extendedprice AS bigint) AS price", "l_returnflag AS flag")


RUN_SQL = f"""runs AS (
 SELECT o_orderkey AS run_id, {pick_sql(V.CHAIN_NAMES, 'o_custkey % 5')} AS chain, o_orderdate AS completed_at,
  o_orderkey % 7 AS product_count, CAST(isoyear(o_orderdate) AS BIGINT) AS year, CAST(week(o_orderdate) AS BIGINT) AS week,
  o_custkey AS c, o_orderstatus AS state FROM orders),
run_rows AS (
 SELECT l_orderkey AS run_id, l_partkey AS part, l_suppkey AS supplier, l_linenumber AS line,
  CAST(floor(l_extendedprice) AS BIGINT) AS price, l_returnflag AS flag FROM lineitem)"""
