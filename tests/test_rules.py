"""Edge cases of the price, text, label and calendar rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import calendar as cal
from shelfledger.functions import links as L
from shelfledger.functions import product as P
from shelfledger.functions import text as T
from shelfledger.operators import audit, crawl
from shelfledger.operators import history as H
from shelfledger.operators import matrix as X
from shelfledger.operators import movement as M
from shelfledger.operators import quality as Q
from shelfledger.operators import tracking
from shelfledger.sources import payloads
from shelfledger.operators.rule_index import rule_index
from shelfledger.sources.rules import label_by_brand, rule_rows


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.select(column(F.col("v")).alias("x"), "i").orderBy("i").select("x").collect()]


def report(spark, rows):
    return spark.createDataFrame(rows, "chain string, sku string, promo_price bigint, promo_text string")


def row(price=10_000_000, sku="a", promo=""):
    return ("TGDD", sku, price, promo)


@pytest.mark.parametrize("now, before, drop", [
    (9_700_000, 10_000_000, False), (9_699_999, 10_000_000, True), (29_499_999, 30_000_000, True),
    (29_500_000, 30_000_000, False), (None, 10_000_000, False), (1, None, False)])
def test_drop_thresholds(spark, now, before, drop):
    pairs = M.compare_runs(report(spark, [row(now)]), report(spark, [row(before)]))
    assert (M.price_drops(pairs).count() == 1) is drop


def test_new_sku_is_unmatched(spark):
    pairs = M.compare_runs(report(spark, [row(1, "new", "Tặng quà")]), report(spark, [row()]))
    assert [r.matched for r in pairs.collect()] == [False]
    assert M.price_drops(pairs).count() == 0 and M.promo_changes(pairs).count() == 0


def test_promo_change_ignores_case_and_spacing(spark):
    before = report(spark, [row(promo="tặng quà"), row(sku="b", promo="Tặng voucher 200k")])
    now = report(spark, [row(promo=" TẶNG  QUÀ "), row(sku="b", promo="Tặng voucher 500k")])
    assert [r.sku for r in M.promo_changes(M.compare_runs(now, before)).collect()] == ["b"]


def test_money(spark):
    good = ["19.990.000đ", "19,990,000 VND", "19990000", "19 990 000 ₫"]
    bad = ["0đ", "Liên hệ", "19.990.000đ 21.000.000đ", "1.99 triệu", "1,999.00", "9.999", "500.000.001"]
    assert values(spark, good, T.parse_money) == [19_990_000] * 4
    assert values(spark, bad, T.parse_money) == [None] * len(bad)


def test_iso_year_edge(spark):
    day = dt.date(2021, 1, 4)
    before = lambda c: F.struct(cal.iso_year(F.date_sub(c, 7)), cal.iso_week(F.date_sub(c, 7)))
    assert [tuple(r) for r in values(spark, [day], before, "date")] == [(2020, 53)]
    exists = lambda c: F.array(cal.iso_week_exists(F.lit(2020), F.lit(53)), cal.iso_week_exists(F.lit(2021), F.lit(53)))
    assert values(spark, [day], exists, "date") == [[True, False]]


def test_fiscal_labels(spark):
    days = [dt.date(2026, 9, 28), dt.date(2026, 10, 11), dt.date(2026, 12, 28), dt.date(2027, 9, 26), dt.date(2027, 9, 27),
            dt.date(2026, 9, 27), dt.date(1998, 1, 5)]
    assert values(spark, days, cal.fiscal_label, "date")[:6] == [
        "W1Q1FY27", "W2Q1FY27", "W1Q2FY27", "W13Q4FY27", "W1Q1FY28", "W13Q4FY26"]


def test_local_day_and_offsets(spark):
    days = values(spark, ["2026-10-04T17:00:00+00:00", "2026-10-05T00:30:00+07:00", "2026-10-05T00:30:00"],
                  lambda c: cal.business_date(cal.utc_instant(c)))
    assert days == [dt.date(2026, 10, 5), dt.date(2026, 10, 5), None]


LABELS = [
    ("Samsung Galaxy A27 A276B 5G (6G+128G) Hồng", V.PHONE, "Galaxy A27", "128GB"),
    ("Samsung Galaxy S26 Ultra 5G 12GB 256GB", V.PHONE, "Galaxy S26 Ultra", "256GB"),
    ("Samsung Galaxy Z Fold8 Ultra 5G 12GB 256GB Tím SM-F976", V.PHONE, "Galaxy Z Fold8 Ultra", "256GB"),
    ("Điện thoại Apple iPhone 18 Pro 256GB - Đỏ Burgundy (MJRR4X/A)", V.PHONE, "iPhone 18 Pro", "256GB"),
    ("Xiaomi Redmi Note 15 Pro 5G 8GB/256GB", V.PHONE, "Redmi Note 15 Pro", "256GB"),
    ("OPPO Reno15 F 5G 8GB/256GB", V.PHONE, "OPPO Reno15 F", "256GB"),
    ("iPhone 17 Pro Max 2TB", V.PHONE, "iPhone 17 Pro Max", "2TB"),
    ("Máy tính bảng Samsung Galaxy Tab S10 FE+ WiFi 8GB/128GB", V.TABLET, "Galaxy Tab S10 FE Plus", "128GB"),
    ("iPad Air M3 11 inch WiFi 128GB", V.TABLET, "iPad Air 11 M3 WiFi", "128GB"),
    ("OPPO Pad SE WiFi 4GB 128GB", V.TABLET, "OPPO Pad SE", "128GB"),
    ("MacBook Air 13 inch M4 16GB/256GB", V.LAPTOP, "MacBook Air 13 M4", "256GB"),
    ("Asus Vivobook 15 X1504VA Core 7 150U (BQ295W)", V.LAPTOP, "Asus Vivobook 15", None),
    ("Samsung Galaxy Watch Ultra2 LTE Đen", V.WATCH, "Galaxy Watch Ultra 2 LTE", None),
    ("Apple Watch Series 11 GPS 42mm viền nhôm", V.WATCH, "Apple Watch S11", None),
    ("Tai nghe chụp tai chống ồn Apple AirPods Max 2 2026", V.EARBUDS, "AirPods Max 2", None),
    ("Tai nghe Bluetooth Apple AirPods 5 2026 Sạc Có Dây (MKFW4)", V.EARBUDS, "AirPods 5", None),
    ("Điện thoại Nokia 3210 4G", V.PHONE, None, None),
]


def test_labels(spark):
    df = spark.createDataFrame(LABELS, "product_name string, category string, want string, size string").withColumn(
        "brand", F.lit(""))
    for r in P.label_products(df).collect():
        assert (r.label, r.label_storage) == (r.want, r.size), r.product_name


def test_out_of_scope(spark):
    rows = [("iPhone 16 128GB cũ đẹp", V.PHONE, "not_new"), ("Tai nghe Bluetooth Powerbeats Pro 2", V.EARBUDS, "accessory"),
            ("Apple Mac mini M5 Pro 24GB 1TB", V.LAPTOP, "desktop"), ("Laptop Dell trưng bày", V.LAPTOP, "not_new"),
            ("iPhone 16 128GB", V.PHONE, None)]
    df = spark.createDataFrame(rows, "n string, c string, want string")
    for r in df.withColumn("got", P.scope_reason(F.col("n"), F.col("c"))).collect():
        assert r.got == r.want, r.n


def test_phone_identity(spark):
    good = {"Apple iPhone 16 Pro Max 256GB | Chính hãng VN/A": "apple-iphone-16-pro-max-256gb",
            "iPhone 16e 128GB": "apple-iphone-16e-128gb", "iPhone Air 1TB": "apple-iphone-air-1tb"}
    bad = ["iPhone 16", "iPhone 16 128GB 256GB", "iPhone 16 128GB cũ", "iPhone 16 128GB xách tay", "iPad Air 128GB",
           "iPhone 16 64TB", "iPhone 16 128GB và iPhone 15 128GB"]
    sku = lambda c: P.phone_identity(c)[0]
    assert values(spark, list(good), sku) == list(good.values())
    assert values(spark, bad, sku) == [None] * len(bad)


def test_each_model_hits_only_its_rule(spark):
    hits = values(spark, V.MODEL_NAMES, lambda c: P.rule_hits(c, V.MODEL_RULES))
    assert hits == [[name] for name in V.MODEL_NAMES]


def test_tracked_model(spark):
    cases = {"iPhone 18 Pro Max 256GB": "iPhone 18 Pro Max", "iPhone 18 Pro 256GB": "iPhone 18 Pro",
             "MacBook Pro 14 inch M5 Pro 24GB/512GB": "MacBook Pro 14 M5 Pro", "iPad Air 11 inch M4 WiFi 128GB": "iPad Air M4 11",
             "Apple Watch Series 11 42mm GPS": "Apple Watch S11", "AirPods 5 sạc không dây": "AirPods 5 sạc ko dây",
             "Tai nghe Bluetooth Apple AirPods 4 chống ồn": "AirPods 4 with ANC"}
    assert values(spark, list(cases), tracking.tracked_model) == list(cases.values())


def test_error_kinds(spark):
    cases = {"Phong Vũ chi tiết: HTTP 403 — bị chặn truy cập, không lưu giá": "blocked", "FPT Shop: HTTP 429": "rate_limited",
             "robots.txt không cho cào TGDD": "robots", "CellphoneS: biến thể hết hàng tại khu vực mặc định": "out_of_stock",
             "Lỗi kỹ thuật KeyError": "technical", "BIẾN THỂ đổi": "variant_changed", "": "other"}
    assert values(spark, list(cases), T.error_kind) == list(cases.values())


def test_link_rules(spark):
    base = F.lit("https://cellphones.com.vn/mobile/apple.html")
    clean = lambda c: L.canonical(L.resolve(base, c))
    assert values(spark, ["/iphone-16.html?utm_source=a&color=blue&storage=128#price"], clean) == [
        "https://cellphones.com.vn/iphone-16.html?color=blue&storage=128"]
    ok = lambda c: L.belongs(F.lit("CellphoneS"), c)
    assert values(spark, ["https://evil.example/item", "https://www.cellphones.com.vn/a", "http://cellphones.com.vn/a",
                          "https://a:b@cellphones.com.vn/x"], ok) == [False, True, False, False]
    assert values(spark, ["/dong-ho-thong-minh//dong-ho-thong-minh/x"],
                  lambda c: L.repair_path(c, F.lit("/dong-ho-thong-minh/"))) == ["/dong-ho-thong-minh/x"]


def test_crawl_rules(spark):
    rules = spark.createDataFrame(
        [("x.vn", "*", "/*sort=", False, 5.0), ("x.vn", "*", "/search?*", False, None), ("x.vn", "*", "/search?ok$", True, None),
         ("y.vn", "*", "/", False, None), ("y.vn", "PriceBot", "/", True, None)],
        "host string, agent string, pattern string, allow boolean, delay double")
    urls = {"https://x.vn/dien-thoai?sort=gia": False, "https://x.vn/search?q=a": False, "https://x.vn/search?ok": True,
            "https://x.vn/dien-thoai/samsung": True, "https://y.vn/a": True, "https://z.vn/": True}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in crawl.crawl_policy(pages, rules, "my-pricebot").collect()}
    assert got == urls


OBS = "seq bigint, chain string, sku string, day date, at timestamp_ntz, promo_price bigint, color string"


def observed(spark, rows):
    """rows of (seq, sku, 'YYYY-MM-DD HH:MM' UTC, price, color)."""
    data = [(s, "TGDD", k, None, dt.datetime.fromisoformat(t), p, c) for s, k, t, p, c in rows]
    df = spark.createDataFrame(data, OBS).withColumnRenamed("at", "observed_at")
    day = cal.business_date(F.col("observed_at"))
    return df.drop("day").withColumns({"business_date": day, "week_start": cal.monday(day), "model": F.lit("m"),
                                       "storage": F.lit("s"), "display_variant": F.lit("")})


def test_day_movement_rules(spark):
    rows = [(1, "a", "2024-01-01 03:00", 100, "x"), (2, "a", "2024-01-02 03:00", 90, "x"), (3, "a", "2024-01-02 05:00", 80, "x"),
            (4, "b", "2024-01-01 03:00", 100, "x"), (5, "b", "2024-01-03 03:00", 50, "x"),  # gap
            (6, "c", "2024-01-01 03:00", 100, "x"), (7, "c", "2024-01-02 03:00", 50, "y"),  # other color
            (8, "d", "2024-01-01 03:00", 100, "x"), (9, "d", "2024-01-02 03:00", None, "x"),  # no price
            (10, "e", "2024-01-01 03:00", 100, "x"), (11, "e", "2024-01-01 04:00", 50, "x")]  # same day
    got = [(r.sku, r.before_price, r.after_price, r.shock) for r in M.day_movements(observed(spark, rows)).collect()]
    assert got == [("a", 100, 80, True)]


def test_week_movement_status_blocks(spark):
    rows = [(1, "a", "2024-01-03 03:00", 100, "x"), (2, "a", "2024-01-09 03:00", 90, "x"), (3, "a", "2024-01-10 03:00", None, "x"),
            (4, "b", "2024-01-03 03:00", 100, "x"), (5, "b", "2024-01-09 03:00", 90, "x")]
    assert [r.sku for r in M.week_movements(observed(spark, rows)).collect()] == ["b"]


def test_grid_keeps_gaps_and_newest(spark):
    rows = [(1, "a", "2024-01-01 03:00", 100, "x"), (2, "a", "2024-01-01 05:00", 120, "x"), (3, "a", "2024-01-01 05:00", 999, "x"),
            (4, "a", "2024-01-04 03:00", None, "x")]
    df = observed(spark, rows)
    grid = H.day_grid(df).first()
    assert [grid[f"day{i}"] for i in range(1, 8)] == [120] + [None] * 6
    assert H.week_change(df).first().change is None
    assert H.missing_dates(df).count() == 5
    with pytest.raises(ValueError):
        H.require_monday("2024-01-02")


def test_merge_history(spark):
    old = observed(spark, [(1, "a", "2024-01-01 03:00", 100, "x"), (2, "a", "2024-01-02 05:00", 100, "x")])
    new = observed(spark, [(3, "a", "2024-01-02 05:00", None, "x"), (4, "a", "2024-01-01 01:00", 7, "x"),
                           (5, "a", "2024-01-02 17:30", 50, "x")])
    assert {r.seq for r in H.merge_history(old, new).collect()} == {1, 3, 5}


def test_as_of_keeps_status_and_ignores_future(spark):
    df = observed(spark, [(1, "a", "2024-01-01 03:00", 100, "x"), (2, "a", "2024-01-02 03:00", None, "x"),
                          (3, "a", "2024-01-05 03:00", 1, "x")])
    assert [(r.seq, r.promo_price) for r in H.as_of(df, "2024-01-03").collect()] == [(2, None)]


def test_gate_refuses_and_passes(spark):
    rows = spark.createDataFrame([("TGDD", 10, None, "")], "chain string, promo_price bigint, original_price bigint, promo_text string")
    issues = spark.createDataFrame([], "chain string")
    Q.enforce(Q.run_gate(rows, issues, "TGDD", 2024, 1, 1))
    for args in (("FPT Shop", 2024, 1, 1), ("TGDD", 2021, 53, 1), ("TGDD", 2024, 1, 2), ("TGDD", 2024, 1, None)):
        with pytest.raises(Q.GateFailed):
            Q.enforce(Q.run_gate(rows, issues, *args))
    zero = rows.withColumn("promo_price", F.lit(0).cast("bigint"))
    with pytest.raises(Q.GateFailed):
        Q.enforce(Q.run_gate(zero, issues, "TGDD", 2024, 1, 1))


def test_registry_fresh_only_when_known(spark):
    seen = spark.createDataFrame([(1, V.PHONE, "iPhone 17", "Apple"), (2, V.PHONE, " IPHONE  17 ", "")],
                                 "seq bigint, category string, model string, brand string")
    known = seen.select("category", "model", "brand").limit(0)
    assert [r.fresh for r in X.model_registry(known, seen).collect()] == [False]
    other = spark.createDataFrame([(V.PHONE, "iPhone 16", None)], "category string, model string, brand string")
    assert {r.model: r.fresh for r in X.model_registry(other, seen.filter("seq = 1")).collect()} == {
        "iPhone 16": False, "iPhone 17": True}


def test_tracked_products_conflicts(spark):
    link = "https://fptshop.com.vn/dien-thoai/a"
    rows = spark.createDataFrame([(1, "iPhone 17", "Đen", link), (2, "IPHONE 17", "đen", link + "?sku=1"), (3, "iPhone 17", "Black", link),
                                  (4, "", "x", link), (5, "iPhone 16", "x", "http://fptshop.com.vn/dien-thoai/a"),
                                  (6, "iPhone 16", "x", "https://other.example/a")], "seq bigint, model string, color string, link string")
    products, errors = tracking.tracked_products(rows)
    one = products.first()
    assert (one.model, one.color, one.aliases, one.urls) == ("iPhone 17", "Đen", ["Black"], {"fpt": [link, link + "?sku=1"]})
    assert {(r.seq, r.error) for r in errors.collect()} == {(4, "incomplete"), (5, "scheme"), (6, "host")}
    _, strict = tracking.tracked_products(rows, "error")
    assert "other_color" in {r.error for r in strict.collect()}
    many = spark.range(21).selectExpr("id AS seq", "'iPhone 17' AS model", "'Đen' AS color", f"concat('{link}', id) AS link")
    _, crowded = tracking.tracked_products(many)
    assert [r.error for r in crowded.collect()] == ["too_many_links"]


def test_long_lists_stay_whole(spark):
    """50 colors, 25 links in a channel and 201 rules: everything comes back, the agreed number is only reported."""
    link = "https://fptshop.com.vn/dien-thoai/a"
    rows = spark.range(50).selectExpr("id AS seq", "'iPhone 17' AS model", "concat('c', id) AS color", f"concat('{link}', id % 25) AS link")
    products, errors = tracking.tracked_products(rows)
    one = products.first()
    assert one.aliases == [f"c{i}" for i in range(1, 50)] and one.urls["fpt"] == [f"{link}{i}" for i in range(25)]
    assert {r.error for r in errors.collect()} == {"too_many_links", "too_many_colors"}
    rules = [(f"r{i}", rf"\bword{i}\b") for i in range(201)]
    names = spark.createDataFrame([("word7", "r7"), ("word8", "r9"), ("none", "r1")], "name string, own string")
    assert {(r.name, tuple(r.hits)) for r in audit.rule_conflicts(names, rule_index(rule_rows(spark, rules)), "own").collect()} == {("word8", ("r8",)), ("none", ())}
    table = spark.createDataFrame([("b", i, n, p) for i, (n, p) in enumerate(rules)], "brand string, position int, name string, pattern string")
    assert Q.list_gate(table).first().asDict() == {"entries": 201, "too_many": True}
    got = label_by_brand(spark.createDataFrame([("b", "a word200 x")], "brand string, product_name string"), rule_index(table, ["brand"]))
    assert got.first().label == "r200"


def test_fingerprint_has_room(spark):
    lanes = audit.content_fingerprint(spark.range(3).withColumn("x", F.col("id").cast("string")), ["x"])
    assert "decimal(38,0)" in lanes._jdf.queryExecution().analyzed().toString() or "decimal(28,0)" in lanes._jdf.queryExecution().analyzed().toString()
    assert lanes.first().fingerprint.startswith("3-")


def test_chain_states(spark):
    chains = spark.createDataFrame([(c,) for c in ("a", "b", "c", "d")], "chain string")
    summaries = spark.createDataFrame([("a", "ok", 3), ("b", "ok", 1), ("b", "failed", 2)], "chain string, status string, prices int")
    got = {r.chain: (r.status, r.copies, r.prices) for r in audit.chain_states(chains, summaries, ["a", "b", "c"]).collect()}
    assert got == {"a": ("ok", 1, 3), "b": ("ambiguous", 2, None), "c": ("missing", 0, None), "d": ("skipped", 0, None)}


def test_cards_are_read_with_a_tag_stack(spark):
    total, link = '<input id="RecordCountSP" value="2">', '<a data-id="{0}" data-name="N&amp;{0}" href="/{0}">x</a>'
    card = lambda i, inner: f'<div class="box product-item">{link.format(i)}{inner}</div>'
    pages = [
        ("nested", total + card(1, '<div class="price">1.<div>500.000</div>đ</div>') + card(2, "")),
        ("footer", total + card(1, "") + '<div class="price">5.000.000</div>'),
        ("twice", total + card(1, '<b class="price">1.500.000</b><b class="price">1.600.000</b>')),
        ("total", card(1, '<b class="price">1.500.000</b>')), ("open", total + f'<div class="product-item">{link.format(1)}'),
        ("link", total + '<div class="product-item"><a href="/x">x</a></div>'), ("inner", total + card(1, card(2, ""))),
        ("void", total + card(1, '<img src="x"><br><i class="promotion-text">Quà <b>A</b><br>B</i>')), ("none", total), ("null", None)]
    rows = payloads.page_cards(spark.createDataFrame(pages, "page string, html string")).collect()
    faults = {r.page: r.page_error for r in rows if r.page_error}
    assert faults == {"twice": "repeated_field", "total": "no_total", "open": "unfinished_card", "link": "card_without_link",
                      "inner": "nested_card", "null": "no_total"}
    good = {(r.page, r.position): (r.card_id, r.name, r.promo_price, r.price_error, r.promo_text) for r in rows if not r.page_error}
    assert good == {("nested", 0): ("1", "N&1", 1_500_000, "", ""), ("nested", 1): ("2", "N&2", None, "price", ""),
                    ("footer", 0): ("1", "N&1", None, "price", ""), ("void", 0): ("1", "N&1", None, "price", "Quà AB")}


def test_all_status_fields_are_read(spark):
    for reader, body in ((payloads.quotes_pv, '{"product":{"productInfo":{"sku":"1","name":"n"},"status":{"stockStatusName":"Ngừng kinh doanh"},"prices":[]}}'),
                         (payloads.quotes_mw, '{"name":"n","productCode":"12345678","sellingStatusName":"Ngừng kinh doanh"}')):
        code = "1" if "productInfo" in body else "12345678"
        row = spark.createDataFrame([(1, "c", "u", code, None, body)], "seq int, chain string, source_url string, variant_id string, parent_id string, payload string")
        got = reader(row).first()
        assert got.issue is None and "gừng kinh doanh" in got.quoted_text



def test_each_rule_is_tried_once(spark):
    """A pattern stands once in the label's expression; texts without its words are not searched, whatever their letters' case."""
    texts = ["iPhone 17 Pro 256GB", "\u0130Phone 17", "\u0131phone 17", "Ipad air \u212anob m3", "MACBOO\u212a Pro M5", "airpod\u017f pro 3", "iPhone 17 iPhone 16", "x", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.array_compact(F.array(*(F.when(T.matches(F.col("t"), p), F.lit(n)) for n, p in V.MODEL_RULES)))
    for r in df.select("t", P.rule_hits(F.col("t"), V.MODEL_RULES).alias("got"), plain.alias("want"), P.rule_label(F.col("t")).alias("label")).collect():
        assert r["got"] == r["want"], r["t"]
        assert r["label"] == (r["want"][0] if len(r["want"]) == 1 else None)
    assert str(P.rule_label(F.col("t"))).lower().count("rlike(") == len(V.MODEL_RULES)


def test_plain_pages_need_no_parser(monkeypatch):
    """Pages of plain tags are read without the standard parser, with the same rows; others are left to it."""
    from shelfledger.sources import cards

    plain = ('<html><input id="RecordCountSP" value="1"><DIV class="product-item x"><a data-id="1" data-name="A &amp; B" href="/a"></a>'
             '<b class="price">1.000 &amp; &#39; &ampx</b><p class="promotion-text"> q  <i>r</i></p></div>')
    other = plain.replace('<html>', "<html><!-- <div class='product-item'> --><script>if (a < b) '</div>'</script>")
    want = [{"published_total": 1, "position": 0, "card_id": "1", "name": "A & B", "href": "/a", "brand": "", "price": "1.000 & ' &x", "price_old": "", "promo_text": "q r"}]
    assert cards.read_page(other) == want
    monkeypatch.setattr(cards._Reader, "feed", None)
    assert cards.read_page(plain) == want
    assert cards.read_page(plain.replace("</div>", "")) == [{"published_total": 1, "page_error": "unfinished_card"}]
