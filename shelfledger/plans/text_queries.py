"""Text, link, label and hand-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import links as L
from shelfledger.functions import product as P
from shelfledger.functions import text as T
from shelfledger.operators import crawl, tracking
from shelfledger.plans.carriers import catalog, observations, table
from shelfledger.plans.matrix_queries import tracked
from shelfledger.plans.registry import query

SPACE = r"[\s\p{Z}\x{0085}]+"
FOLDED = f"lower(trim(regexp_replace(nfc_normalize(text), '{SPACE}', ' ', 'g')))"


@query("col1_fold_keys", f"""SELECT doc_id, md5({FOLDED}) AS folded,
 md5(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D'))) AS search FROM documents""")
def _(spark, sf):
    rows = table(spark, sf, "documents")
    return rows.select("doc_id", F.md5(T.fold(T.nfc(F.col("text")))).alias("folded"),
                       F.md5(T.search_key(F.col("text"))).alias("search"))


@query("col2_parse_money", """SELECT seq, CASE WHEN seq % 8 < 4 THEN CAST(floor(total) AS BIGINT) * 1000 END AS amount FROM cat""",
       "cat")
def _(spark, sf):
    rows = catalog(spark, sf).selectExpr("seq", "format_number(cast(total AS bigint) * 1000, 0) AS n").selectExpr(
        "seq", """CASE seq % 8 WHEN 0 THEN replace(n, ',', '.') || 'đ' WHEN 1 THEN n || ' VND' WHEN 2 THEN replace(n, ',', '')
        WHEN 3 THEN replace(n, ',', ' ') || ' ₫' WHEN 4 THEN 'Liên hệ' WHEN 5 THEN n || 'đ ' || n || 'đ'
        WHEN 6 THEN '9.000đ' ELSE '1.99 triệu' END AS text""")
    return rows.select("seq", T.parse_money(F.col("text")).alias("amount"))


@query("col3_lock_sku", """SELECT seq, CASE seq % 4 WHEN 0 THEN split_part(sku, '-', 1) || '-ab-' || c || '-x'
 WHEN 1 THEN sku END AS locked FROM cat""", "cat")
def _(spark, sf):
    variant = F.expr("CASE seq % 4 WHEN 0 THEN '  AB ' || c || '//X.' WHEN 1 THEN variant_id WHEN 2 THEN ' - ' "
                     "ELSE repeat('9', 81) END")
    return catalog(spark, sf).select("seq", P.locked_sku(F.col("chain"), variant).alias("locked"))


@query("col4_category_brand", f"""SELECT seq, CASE WHEN i IN (36, 37) THEN '{V.UNKNOWN_CATEGORY}' ELSE category END AS category,
 CASE WHEN i = 39 OR model IN ('iMac', 'Mac Mini') OR starts_with(model, 'MacBook') AND FALSE THEN '{V.UNKNOWN_BRAND}'
 ELSE brand END AS brand, CASE WHEN brand = 'Nokia' THEN 'Nokia' ELSE brand END AS given FROM cat""", "cat")
def _(spark, sf):
    name = F.col("product_name")
    return catalog(spark, sf).select(
        "seq", P.category_of(F.lit(""), name).alias("category"), P.brand_of(F.lit(None).cast("string"), name).alias("brand"),
        P.brand_of(F.lower("brand"), name).alias("g"), F.col("brand").alias("given")).selectExpr(
        "seq", "category", "brand", "CASE WHEN lower(g) = lower(given) THEN given ELSE g END AS given")


@query("col5_label_product", f"""SELECT seq, CASE WHEN i < 38 THEN model END AS label,
 CASE WHEN category IN ('{V.PHONE}', '{V.TABLET}', '{V.LAPTOP}') THEN storage END AS label_storage FROM cat""", "cat")
def _(spark, sf):
    return P.label_products(catalog(spark, sf)).select("seq", "label", "label_storage")


@query("col6_storage_gb", """SELECT seq, CASE storage WHEN '1TB' THEN 1024 ELSE CAST(replace(storage, 'GB', '') AS BIGINT) END
 AS gb, storage FROM cat""", "cat")
def _(spark, sf):
    gb = P.storage_gb(F.col("product_name"))
    return catalog(spark, sf).select("seq", gb.cast("bigint").alias("gb"), P.storage_label(gb).alias("storage"))


@query("col7_phone_identity", """SELECT seq, CASE WHEN i < 13 THEN 'apple-' || replace(lower(model), ' ', '-') || '-' || lower(storage)
 END AS phone, CASE WHEN i >= 13 THEN 'model' END AS reason FROM cat""", "cat")
def _(spark, sf):
    sku, _, reason = P.phone_identity(F.col("product_name"))
    return catalog(spark, sf).select("seq", sku.alias("phone"), reason.alias("reason"))


@query("col8_display_columns", f"""SELECT seq, CASE WHEN i IN (36, 37, 39) THEN 'other' WHEN want = '' THEN 'selected'
 WHEN NOT coalesce(proof_model = m AND lower(proof_color) = lower(want) AND proof_code = variant_id
  AND proof_color_id IS NOT NULL AND proof_dated, FALSE) THEN 'needs_verified_color'
 WHEN lower(color) = lower(want) THEN 'selected' ELSE 'other_color' END AS selection,
 CASE WHEN i = 36 OR i = 37 THEN product_name WHEN i = 39 THEN 'Nokia 3210 4G ' || storage ELSE m || ' ' || storage END
 AS display_name FROM (SELECT *, CASE WHEN i = 38 THEN 'iPhone 17' ELSE model END AS m,
 CASE WHEN i = 38 THEN '{V.MODEL_COLORS['iPhone 17']}' ELSE wanted END AS want FROM obs)""", "obs")
def _(spark, sf):
    rows = observations(spark, sf).withColumn("source_product_name", F.lit(None).cast("string"))
    rules = tracked(spark).selectExpr("*", "array() AS aliases", "array() AS previous_names")
    rules = rules.withColumns({"aliases": F.col("aliases").cast("array<string>"),
                               "previous_names": F.col("previous_names").cast("array<string>")})
    return tracking.presentation(rows, rules).select("seq", "selection", "display_name")


@query("col9_canonical_url", r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
 q AS (SELECT page_id, split_part(u, '?', 1) AS base, list_filter(string_split(split_part(u, '?', 2), '&'),
 lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND split_part(lower(x), '=', 1) NOT IN ('fbclid', 'gclid', 'itm',
 'ref', 'source')) AS kept FROM p)
SELECT page_id, base || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS link,
 starts_with(base, 'https://') AS secure FROM q""")
def _(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", L.canonical(url).alias("link"),
                                            (L.scheme(url) == "https").alias("secure"))


LINKS = """CASE chain WHEN 'TGDD' THEN 'https://thegioididong.com/dtdd/sp-{0}/?code={0}&utm_source=a'
 WHEN 'CellphoneS' THEN 'https://cellphones.com.vn/sp-{0}.html?product_id={0}#top'
 WHEN 'FPT Shop' THEN 'https://fptshop.com.vn/dien-thoai/sp-{0}?sku=x{0}'
 WHEN 'Viettel Store' THEN 'https://viettelstore.vn/dien-thoai/sp-pid{0}.html?x=1' ELSE 'https://phongvu.vn/sp--s{0}?sku={0}' END"""


def hand_link(column: str) -> str:
    """SQL text of a hand-entered link whose number is ``column``."""
    return LINKS.replace("'https", "'https").replace("{0}", f"' || {column} || '")


@query("col10_channel_url", """SELECT seq, CASE WHEN seq % 9 = 0 OR chain = 'FPT Shop' THEN NULL
 WHEN chain = 'TGDD' THEN 'https://www.thegioididong.com/dtdd/sp-' || c || '?code=' || c
 WHEN chain = 'CellphoneS' THEN 'https://cellphones.com.vn/sp-' || c || '.html?product_id=' || c
 WHEN chain = 'Viettel Store' THEN 'https://viettelstore.vn/dien-thoai/sp-pid' || c || '.html'
 ELSE 'https://phongvu.vn/sp--s' || c || '?sku=' || c END AS link,
 CASE WHEN seq % 9 = 0 THEN 'scheme' WHEN chain = 'FPT Shop' THEN 'variant' END AS reason, slug AS channel FROM cat""", "cat")
def _(spark, sf):
    rows = catalog(spark, sf).selectExpr("seq", f"{hand_link('c')} AS raw").selectExpr(
        "seq", "CASE WHEN seq % 9 = 0 THEN regexp_replace(raw, '^https', 'http') ELSE raw END AS raw")
    return L.with_channel_link(rows, "raw").select("seq", "link", F.col("link_error").alias("reason"), "channel")


@query("col11_repair_pin_url", """SELECT seq, CASE WHEN seq % 2 = 0 THEN '/laptop/may-' || c ELSE '/laptop/a/may-' || c END AS path,
 CASE WHEN chain = 'TGDD' THEN source_url || '?code=' || key ELSE source_url END AS pinned,
 source_url || '?a=1&sku=' || key AS with_sku FROM cat""", "cat")
def _(spark, sf):
    href = F.expr("CASE WHEN seq % 2 = 0 THEN '/laptop//laptop/may-' || c || '?x=1#y' ELSE '/laptop/a/may-' || c || '?q' END")
    return catalog(spark, sf).select(
        "seq", L.repair_path(href, F.lit("/laptop/")).alias("path"),
        L.pinned(F.col("chain"), F.col("source_url"), F.col("variant_id")).alias("pinned"),
        L.with_parameter(F.concat("source_url", F.lit("?a=1&sku=9#top")), "sku", F.col("variant_id")).alias("with_sku"))


@query("col12_availability", """SELECT seq, CASE seq % 6 WHEN 0 THEN 'Hết hàng' WHEN 1 THEN 'Sắp ĐẶT TRƯỚC nhé'
 WHEN 3 THEN 'Liên hệ cửa hàng' WHEN 5 THEN 'Ngừng kinh doanh' END AS status,
 CASE WHEN seq % 6 IN (0, 1, 3, 5) THEN '[Tình trạng] ' || CASE seq % 6 WHEN 0 THEN 'Hết hàng' WHEN 1 THEN 'Sắp ĐẶT TRƯỚC nhé'
 WHEN 3 THEN 'Liên hệ cửa hàng' ELSE 'Ngừng kinh doanh' END || chr(10) || reason ELSE reason END AS text FROM cat""", "cat")
def _(spark, sf):
    first = F.expr("CASE seq % 6 WHEN 0 THEN 'HET_HANG' WHEN 1 THEN ' Sắp  ĐẶT TRƯỚC nhé' WHEN 2 THEN 'Còn hàng' END")
    second = F.expr("CASE seq % 6 WHEN 3 THEN 'Liên hệ cửa hàng' WHEN 5 THEN 'ngung_kinh_doanh' ELSE 'x' END")
    status = T.explicit_status(first, second)
    rows = catalog(spark, sf).select("seq", "reason", status.alias("s"))
    text = T.annotate(F.col("reason"), F.col("s"))
    return rows.select("seq", F.nullif(T.status_of(text), F.lit("")).alias("status"), text.alias("text"))


@query("col13_error_kind", "SELECT seq, kind, 'access_error' AS link_check FROM cat", "cat")
def _(spark, sf):
    reason = F.col("reason")
    return catalog(spark, sf).select("seq", T.error_kind(reason).alias("kind"), T.link_check_kind(reason).alias("link_check"))


@query("col15_clean_notes", r"""WITH p AS (SELECT page_id, regexp_split_to_array(html, '(?i)</p>|<br\s*/?>') AS parts FROM pages),
 t AS (SELECT page_id, list_filter(list_transform(parts, lambda x: trim(regexp_replace(replace(replace(replace(replace(
  regexp_replace(x, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&copy;', '©'), '&middot;', '·'), '&quot;', '"'),
  '[\s\p{Z}\x{0085}]+', ' ', 'g'))), lambda x: x <> '') AS notes FROM p)
SELECT page_id, md5(array_to_string(list_filter(notes, lambda x, i: list_position(notes, x) = i), chr(10))) AS notes FROM t""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.clean_notes(F.col("html"))).alias("notes"))


@query("col16_color_resolve", """SELECT seq, CASE WHEN seq % 5 = 0 THEN '' ELSE color END AS tail,
 CASE seq % 3 WHEN 0 THEN color ELSE '' END AS coded FROM cat""", "cat")
def _(spark, sf):
    name = F.expr("CASE WHEN seq % 5 = 0 THEN product_name ELSE product_name || '- ' || color END")
    options = F.expr("""CASE seq % 3 WHEN 0 THEN array(named_struct('label', color, 'codes', array(variant_id, '7x')),
        named_struct('label', color, 'codes', array(variant_id)), named_struct('label', 'Tím', 'codes', array('0x')))
        WHEN 1 THEN array(named_struct('label', color, 'codes', array(variant_id)),
        named_struct('label', 'Tím', 'codes', array(variant_id)))
        ELSE array(named_struct('label', color, 'codes', array('0x'))) END""")
    return catalog(spark, sf).select("seq", P.tail_color(name).alias("tail"),
                                     P.coded_color(options, F.col("variant_id")).alias("coded"))


@query("agg13_promo_best", """WITH l AS (SELECT c AS sku, seq, CASE seq % 5 WHEN 0 THEN 'Thu cũ đổi mới giảm thêm đến'
  WHEN 1 THEN 'Ưu đãi HSSV/tân sinh viên giảm đến' WHEN 2 THEN 'Trợ giá khi mua kèm đến' END AS label,
  CASE WHEN seq % 4 = 0 THEN 1500000 ELSE CAST(floor(total) AS BIGINT) END AS amount, priority AS name,
  CASE seq % 5 WHEN 3 THEN 0 ELSE 4 END AS section FROM cat),
 b AS (SELECT sku, label || ' ' || replace(format('{:,}', max(amount)), ',', '.') || 'đ' AS note, 3 AS section, min(seq) AS seq
  FROM l WHERE label IS NOT NULL GROUP BY sku, label UNION ALL SELECT sku, name, section, seq FROM l WHERE label IS NULL),
 f AS (SELECT sku, note, min(section * CAST(1000000000 AS BIGINT) + seq) AS pos FROM b GROUP BY ALL)
SELECT sku, string_agg(note, chr(10) ORDER BY pos) AS promo_text FROM f GROUP BY sku""", "cat")
def _(spark, sf):
    lines = catalog(spark, sf).selectExpr(
        "c AS sku", "seq", "CASE seq % 5 WHEN 0 THEN 'TradeIn' WHEN 1 THEN CASE WHEN seq % 2 = 0 THEN 'BTS' ELSE 'education' END "
        "WHEN 2 THEN 'BundleSuggestions' ELSE 'gift' END AS kind",
        "CASE WHEN seq % 5 < 3 THEN 'Giảm đến 1.500.000đ' ELSE priority END AS name",
        "CASE WHEN seq % 4 = 0 THEN 0 ELSE cast(total AS bigint) END AS amount",
        "CASE seq % 5 WHEN 3 THEN 0 ELSE 4 END AS section")
    return tracking.promo_text(tracking.promo_notes(lines))


@query("agg20_tracked_products", f"""WITH r AS (SELECT seq, lower(model) AS model_key, color, chain, CASE WHEN i = 7 THEN c
  ELSE c % 600 END AS n FROM cat),
 g AS (SELECT * FROM r WHERE seq % 33 <> 0 AND chain <> 'FPT Shop'),
 d AS (SELECT model_key, chain, n, min(seq) AS seq FROM g GROUP BY ALL),
 k AS (SELECT model_key, count(*) AS links FROM d GROUP BY ALL),
 cc AS (SELECT model_key, color, min(seq) AS seq FROM g GROUP BY ALL),
 cc2 AS (SELECT model_key, color, seq AS cs FROM cc),
 h AS (SELECT model_key, arg_min(color, cs) AS color, min(cs) AS position, array_to_string(list(color ORDER BY cs)[2:], '|') AS aliases FROM cc2 GROUP BY ALL)
SELECT h.model_key, h.color, h.position, h.aliases, links,
 CASE WHEN links > 20 THEN 'too_many_links' END AS error, CAST(NULL AS BIGINT) AS seq FROM h JOIN k USING (model_key)
UNION ALL SELECT model_key, NULL, NULL, NULL, NULL, CASE WHEN seq % 33 = 0 THEN 'incomplete' ELSE 'variant' END, seq FROM r
WHERE seq % 33 = 0 OR chain = 'FPT Shop'""", "cat")
def _(spark, sf):
    n = "CASE WHEN i = 7 THEN c ELSE c % 600 END"
    rows = catalog(spark, sf).selectExpr(
        "seq", "CASE WHEN seq % 2 = 0 THEN upper(model) ELSE '  ' || model END AS model",
        "CASE WHEN seq % 33 = 0 THEN '' ELSE color END AS color", f"{hand_link(f'({n})')} AS link")
    products, errors = tracking.tracked_products(rows)
    crowded = errors.filter("error = 'too_many_links'").select("model_key", "error")
    links = F.coalesce(F.aggregate(F.map_values("urls"), F.lit(0), lambda a, u: a + F.size(u)), F.lit(0))
    good = products.select("model_key", "color", "position", F.array_join("aliases", "|").alias("aliases"),
                           links.cast("bigint").alias("links")).join(crowded, "model_key", "left").withColumn(
        "seq", F.lit(None).cast("bigint"))
    bad = errors.filter("error <> 'too_many_links'").selectExpr(
        "model_key", "NULL AS color", "NULL AS position", "NULL AS aliases", "NULL AS links", "error", "seq")
    return good.unionByName(bad)


@query("top5_link_order", "SELECT seq, category, model, storage, chain, color FROM cat", "cat")
def _(spark, sf):
    return tracking.link_order(catalog(spark, sf)).select("seq", "category", "model", "storage", "chain", "color")


POLICY = r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS target FROM pages),
 h AS (SELECT DISTINCT host, starts_with(host, 'blog.') AS named FROM p),
 rules AS (SELECT host, unnest([{'size': 8, 'allow': FALSE, 're': '^/.*[?].*page='}, {'size': 4, 'allow': FALSE, 're': '^/de/'},
   {'size': 5, 'allow': TRUE, 're': '^/de/1'}, {'size': 8, 'allow': FALSE, 're': '^/.*[.]html$'},
   {'size': 8, 'allow': starts_with(host, 'www.'), 're': '^/.*[.]html$'}]) AS r FROM h WHERE NOT named
  UNION ALL SELECT host, {'size': 4, 'allow': FALSE, 're': '^/fr/'} FROM h WHERE named),
 hits AS (SELECT page_id, max(r.size * 2 + CAST(r.allow AS INT)) AS best FROM p JOIN rules USING (host)
  WHERE regexp_matches(target, r.re) GROUP BY page_id)
SELECT page_id, coalesce(best % 2 = 1, TRUE) AS allowed, CASE WHEN named THEN 9.0 ELSE 5.0 END::DOUBLE AS crawl_delay
FROM p JOIN h USING (host) LEFT JOIN hits USING (page_id)"""


@query("jon21_crawl_policy", POLICY)
def _(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url")
    hosts = pages.select(L.host(F.col("url")).alias("host")).distinct()
    rules = hosts.selectExpr("host", """inline(array(named_struct('agent', '*', 'pattern', '/*?*page', 'allow', false, 'delay', 5D),
        named_struct('agent', '*', 'pattern', '/de/', 'allow', false, 'delay', 2D),
        named_struct('agent', '*', 'pattern', '/de/1', 'allow', true, 'delay', NULL),
        named_struct('agent', '*', 'pattern', '/*.html$', 'allow', false, 'delay', NULL),
        named_struct('agent', '*', 'pattern', '/*.html$', 'allow', startswith(host, 'www.'), 'delay', NULL),
        named_struct('agent', if(startswith(host, 'blog.'), 'PriceBot', 'otherbot'), 'pattern', '/fr/', 'allow', false,
         'delay', 9D)))""")
    return crawl.crawl_policy(pages, rules, "shop-pricebot/1.0").select("page_id", "allowed", "crawl_delay")
