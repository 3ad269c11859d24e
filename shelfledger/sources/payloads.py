"""Raw shop payloads to quotes and issues.

Input is a table of payloads (seq, chain, source_url, variant_id, parent_id, payload); output is the same rows with
quoted_* columns and ``issue`` (NULL for a usable quote).  Only the locked variant is ever read, a limited or conditional
price is a note and never the price, and a missing price needs a status of the same variant.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.functions import product as P
from shelfledger.functions import text as T
from shelfledger.sources import cards
from shelfledger.operators.tracking import OFFER_LABELS

STRINGS = "array<string>"


def none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def strings(*values: Column) -> Column:
    return F.array(*values).cast(STRINGS)


def present(value: Column) -> Column:
    """Zero and empty are "not published"."""
    text = value.cast("string")
    return F.when(~text.isin("", "0"), text)


def money(value: Column) -> Column:
    return T.parse_money(present(value))


def broken_money(*values: Column) -> Column:
    return reduce(lambda a, b: a | b, (present(v).isNotNull() & money(v).isNull() for v in values))


def notes_text(*parts: Column) -> Column:
    """Arrays of notes to one text: trimmed, non-empty, each once in order."""
    whole = F.concat(*(F.coalesce(p, F.array().cast(STRINGS)) for p in parts))
    return F.array_join(T.ordered_distinct(F.transform(whole, T.spaced)), "\n")


def plain(markup: Column) -> Column:
    return T.spaced(T.strip_tags(F.coalesce(markup, F.lit(""))))


def opened(payloads: DataFrame, fields: str, *prices: str) -> DataFrame:
    """``payloads`` with ``_p``, the fields of the payload.

    The payload is parsed once, as a VARIANT (``_doc``, if a caller has parsed it already), so a number written as text counts, a field of another
    kind is missing instead of emptying its object, and unknown fields are ignored.  ``_fault`` is set for broken JSON and for a
    price (paths ``prices``) that is no number.
    """
    rows = payloads if "_doc" in payloads.columns else payloads.withColumn("_doc", F.try_parse_json("payload"))
    no_number = lambda path: (present(F.try_variant_get("_doc", path, "string")).isNotNull()
                              & F.try_variant_get("_doc", path, "bigint").isNull())
    fault = (F.when(F.col("payload").isNotNull() & F.col("_doc").isNull(), "broken_json")
             .when(reduce(lambda a, b: a | b, map(no_number, prices)), "price_not_number"))
    return rows.withColumns({"_fault": fault, "_p": F.try_variant_get("_doc", "$", f"struct<{fields}>")})


def judged(df: DataFrame, checks: Sequence[tuple[Column, str]], variant: Column, name: Column, color: Column,
           notes: Column, complete: Column | None = None) -> DataFrame:
    """Finish a quote from the working columns ``_sale``, ``_listed`` and ``_status``: first broken rule is the issue."""
    rules = [*((F.col("_fault") == f, f) for f in ("broken_json", "price_not_number")), *checks, (F.col("_sale").isNull() & F.col("_status").isNull(), "no_price_or_status"),
             (F.col("_listed") < F.col("_sale"), "list_below_price")]
    issue = reduce(lambda rest, rule: F.when(F.coalesce(rule[0], F.lit(False)), F.lit(rule[1])).otherwise(rest),
                   reversed(rules), none())
    out = df.withColumn("issue", issue).withColumn("_notes", notes)
    ok = F.col("issue").isNull()
    original = F.when(F.col("_listed") > F.col("_sale"), F.col("_listed"))
    return out.withColumns({
        "quoted_variant": F.when(ok, variant), "quoted_name": F.when(ok, name), "quoted_color": F.when(ok, color),
        "quoted_price": F.when(ok, F.col("_sale")), "quoted_list": F.when(ok, original),
        "quoted_text": F.when(ok, T.annotate(F.col("_notes"), F.col("_status"))),
        "promotion_complete": F.when(ok, F.lit(True) if complete is None else complete)}).drop(
        "_sale", "_listed", "_status", "_notes", "_p", "_doc", "_fault")


# --- CellphoneS ------------------------------------------------------------------------------------------------------

CPS = """general struct<product_id: string, name: string, url_path: string>,
 filterable struct<price: bigint, special_price: bigint, stock: int, parent_id: string, promotion_information: string,
 promotion_pack: map<string, map<string, struct<is_active: boolean, items: array<struct<is_active: boolean, name: string>>>>>>"""


def quotes_cps(payloads: DataFrame) -> DataFrame:
    rows = opened(payloads, CPS, "$.filterable.price", "$.filterable.special_price")
    info, general = F.col("_p.filterable"), F.col("_p.general")
    status = F.when(info["stock"] <= 0, "hết hàng tại khu vực mặc định, chưa xác nhận đặt mua.")
    rows = rows.withColumns({
        "_listed": money(info["price"]), "_status": status,
        "_sale": F.when(present(info["special_price"]).isNotNull(), money(info["special_price"])).otherwise(
            money(info["price"]))})
    owner = F.coalesce(info["parent_id"], F.col("variant_id"))
    groups = F.flatten(F.transform(F.map_values(info["promotion_pack"]), F.map_values))
    on = lambda x: F.coalesce(x["is_active"], F.lit(True))
    items = F.flatten(F.transform(F.filter(groups, on), lambda g: F.filter(g["items"], on)))
    lines = F.split(F.regexp_replace(info["promotion_information"], r"(?i)</p>|<br\s*/?>", "\u0001"), "\u0001")
    notes = notes_text(F.transform(lines, plain), F.transform(items, lambda i: i["name"]))
    moved = F.col("parent_id").isNotNull() & (owner != F.col("parent_id")) & (owner != F.col("variant_id"))
    return judged(rows, [(general.isNull() | info.isNull(), "no_payload"), (moved, "other_parent"),
                         (broken_money(info["price"], info["special_price"]), "price_range")],
                  F.col("variant_id"), general["name"], P.tail_color(general["name"]), notes)


# --- FPT Shop --------------------------------------------------------------------------------------------------------

# Status fields of a payload, the first with a known status counts.
STATUS_FIELDS = ("statusOnWeb", "statusText", "statusName", "stockStatusName", "sellingStatusName")
STATUS_SCHEMA = ", ".join(f"{f}: string" for f in STATUS_FIELDS)

FPT = f"""productStatus struct<{STATUS_SCHEMA}, buttonCode: string>,
 variants struct<sku: string, variantResult: struct<skus: array<struct<code: string, name: string, displayName: string,
  price: bigint, inventory: int>>>, skuSlugs: array<struct<sku: string, attributes: array<struct<key:
  struct<propertyName: string, displayValue: string>>>>>>,
 productAdvanceInfo struct<sku: string, finalPrice: bigint, price: bigint, promotion: struct<
  included: array<struct<name: string>>, other: array<struct<programType: string, name: string, finalPrice: bigint,
  discountPrice: bigint, expireDate: string>>, payment: array<struct<name: string>>, extra: array<struct<name: string>>>>"""


def _offer_notes(other: Column) -> Column:
    """Conditional offers: the highest amount per label, the written amount where the field is empty."""
    def best(label: str) -> Column:
        mine = F.filter(other, lambda o: o["programType"].isin([k for k, v in OFFER_LABELS.items() if v == label]))
        amounts = F.transform(mine, lambda o: F.coalesce(
            F.nullif(o["discountPrice"], F.lit(0)), F.regexp_replace(F.regexp_extract(
                o["name"], r"\d{1,3}(?:[.,]\d{3})+", 0), r"\D", "").try_cast("bigint"), F.lit(0)))
        top = F.array_max(amounts)
        return F.when(top > 0, F.concat(F.lit(label + " "), T.money_text(top)))
    return strings(*(best(label) for label in dict.fromkeys(OFFER_LABELS.values())))


def quotes_fpt(payloads: DataFrame) -> DataFrame:
    rows = opened(payloads, FPT, "$.productAdvanceInfo.finalPrice", "$.productAdvanceInfo.price")
    info, shop, state = F.col("_p.productAdvanceInfo"), F.col("_p.variants"), F.col("_p.productStatus")
    code = F.col("variant_id")
    rows = rows.withColumn("_mine", F.filter(shop["variantResult"]["skus"], lambda v: v["code"] == code))
    mine, one = F.col("_mine"), F.get("_mine", F.lit(0))
    slugs = F.filter(shop["skuSlugs"], lambda s: s["sku"] == code)
    keys = F.transform(F.flatten(F.transform(slugs, lambda s: s["attributes"])), lambda a: a["key"])
    colors = T.ordered_distinct(F.transform(F.filter(keys, lambda k: F.lower(k["propertyName"]) == "color"),
                                            lambda k: F.trim(k["displayValue"])))
    color = F.when(F.size(colors) == 1, F.get(colors, F.lit(0))).otherwise("")
    explicit = T.explicit_status(*(state[f] for f in STATUS_FIELDS))
    blocked = state["buttonCode"].isNotNull() & ~state["buttonCode"].isin("ORDER", "BUY_NOW")
    implied = F.when(state["buttonCode"] == "PRE_ORDER", "đặt trước, cần xác minh ngày giao hàng.").when(
        F.coalesce(blocked, F.lit(False)) | F.coalesce(one["inventory"] <= 0, F.lit(False)),
        "biến thể chưa cho đặt mua tại khu vực mặc định.")
    raw = F.coalesce(present(info["finalPrice"]), present(info["price"]))
    rows = rows.withColumns({
        "_sale": F.when(info.isNotNull(), money(raw)), "_listed": F.when(info.isNotNull(), money(info["price"])),
        "_status": F.when(info.isNull(), explicit).otherwise(F.coalesce(explicit, implied)), "_shown": money(one["price"])})
    other = info["promotion"]["other"]
    online = F.filter(other, lambda o: (o["programType"] == "PriceOnline") & present(o["finalPrice"]).isNotNull())
    named = lambda field: F.transform(info["promotion"][field], lambda x: x["name"])
    limited = F.transform(F.slice(online, 1, 1), lambda o: F.concat(
        F.lit("Giá online giới hạn "), T.money_text(o["finalPrice"]), F.lit(": "), o["name"], F.lit(" (đến "),
        F.translate(F.substring(F.coalesce(o["expireDate"], F.lit("")), 1, 16), "T", " "), F.lit(")")))
    plain_others = F.transform(F.filter(other, lambda o: ~F.coalesce(o["programType"], F.lit("")).isin(
        "PriceOnline", *OFFER_LABELS)), lambda o: o["name"])
    notes = F.when(info.isNull(), "Nguồn không trả khối giá hiện tại của SKU; không lấy giá lưu trong danh sách biến thể."
                   ).otherwise(notes_text(named("included"), limited, plain_others, F.array_compact(_offer_notes(other)),
                                          named("payment"), named("extra")))
    gone = info.isNull() & ((shop["sku"] != code) | (F.size(mine) != 1) | explicit.isNull())
    disagrees = (F.col("_shown") != F.col("_sale")) & ~F.exists(
        F.coalesce(online, F.array()), lambda o: o["finalPrice"] == F.col("_shown"))
    return judged(rows, [(shop.isNull(), "no_payload"), (gone, "no_current_price_block"), (info["sku"] != code, "other_sku"),
                         (F.size(mine) != 1, "variant_not_unique"),
                         (info.isNotNull() & broken_money(raw, info["price"], one["price"]), "price_range"),
                         (disagrees, "shown_price_differs")],
                  code, F.coalesce(one["name"], one["displayName"]), color, notes, info.isNotNull()).drop("_shown", "_mine")


# --- Phong Vũ --------------------------------------------------------------------------------------------------------

PV = f"""product struct<productInfo: struct<sku: string, name: string>, status: struct<sellable: boolean, {STATUS_SCHEMA}>,
  prices: array<struct<latestPrice: bigint, supplierRetailPrice: bigint>>,
  productOptions: struct<rows: array<struct<code: string, title: string, options: array<struct<label: string, sku: string,
   selected: boolean>>>>>, productDetail: struct<attributeGroups: array<struct<name: string, value: string>>>>,
 priceAndPromotions struct<promotions: array<struct<groupType: string, promotions: array<struct<title: string, name: string>>>>>,
 salePolicies array<struct<isHighlightedOnPromotionBlock: boolean, highlightText: string, displayText: string>>"""


def quotes_pv(payloads: DataFrame) -> DataFrame:
    rows = opened(payloads, PV, "$.product.prices[0].latestPrice", "$.product.prices[0].supplierRetailPrice")
    product = F.col("_p.product")
    info, price = product["productInfo"], F.get(product["prices"], F.lit(0))
    has_price = F.coalesce(F.size(product["prices"]) > 0, F.lit(False))
    status = F.coalesce(T.explicit_status(*(product["status"][f] for f in STATUS_FIELDS)),
                        F.when(~product["status"]["sellable"], "SKU chưa cho đặt mua tại khu vực mặc định."))
    rows = rows.withColumns({
        "_sale": money(price["latestPrice"]), "_listed": money(price["supplierRetailPrice"]),
        "_status": F.when(has_price, status).otherwise(F.concat(status, F.lit(" Nguồn không hiện giá của SKU này.")))})
    promos = F.flatten(F.transform(F.col("_p.priceAndPromotions.promotions"), lambda g: F.transform(
        g["promotions"], lambda p: F.when(plain(F.coalesce(p["title"], p["name"])) != "", F.concat(
            F.when(g["groupType"] == "GROUP_TYPE_SELECTABLE", "Chọn 1: ").otherwise(""),
            plain(F.coalesce(p["title"], p["name"])))))))
    policies = F.transform(F.filter(F.col("_p.salePolicies"), lambda s: s["isHighlightedOnPromotionBlock"]),
                           lambda s: plain(F.coalesce(s["highlightText"], s["displayText"])))
    color_rows = F.filter(product["productOptions"]["rows"], lambda r: F.contains(
        F.lower(F.coalesce(r["code"], F.lit(""))), F.lit("mausac")) | (F.lower(r["title"]) == "màu sắc"))
    picked = F.filter(F.flatten(F.transform(color_rows, lambda r: r["options"])),
                      lambda o: o["selected"] & (o["sku"] == info["sku"]))
    labels = T.ordered_distinct(F.transform(F.filter(
        product["productDetail"]["attributeGroups"], lambda a: F.lower(F.trim(a["name"])) == "màu sắc"),
        lambda a: T.spaced(a["value"])))
    color = (F.when(F.size(color_rows) > 0, F.when(F.size(picked) == 1, F.get(picked, F.lit(0))["label"]).otherwise(""))
             .otherwise(F.when(F.size(labels) == 1, F.get(labels, F.lit(0))).otherwise("")))
    return judged(rows, [(info.isNull(), "no_payload"), (info["sku"] != F.col("variant_id"), "other_sku"),
                         (broken_money(price["latestPrice"], price["supplierRetailPrice"]), "price_range")],
                  info["sku"], info["name"], color, notes_text(promos, policies))


# --- TGDD ------------------------------------------------------------------------------------------------------------

MW_PROMOTIONS = """giftPromotions: array<struct<title: string, lstGift: array<struct<displayName: string, name: string>>>>,
  discountPromotions: array<struct<content: string, title: string>>, normalPromotions: array<struct<content: string, title: string>>"""
MW = f"""name string, productCode string, hiddenPrice boolean, crmPreorderCode string, {", ".join(f"{f} string" for f in STATUS_FIELDS)},
 productPrices array<struct<price: bigint, sysPrice: bigint, saleProgramTypeId: int, htmlIdRule: struct<groupId: string>,
  stockQuantity: struct<maxQuantity: int>, startDate: string, endDate: string, expectedPrice: bigint, isCanBuy: boolean,
  promotions: struct<{MW_PROMOTIONS}>>>,
 filter array<struct<label: string, values: array<struct<name: string, productCodes: array<string>>>>>,
 payments array<struct<isActivated: boolean, saleName: string>>"""


def is_limited(price: Column) -> Column:
    """A flash price: other program type, a flash group, or a limited number."""
    return ((F.coalesce(price["saleProgramTypeId"], F.lit(0)) != 0)
            | T.matches(price["htmlIdRule"]["groupId"], r"gold\s*hour|flash")
            | (F.coalesce(price["stockQuantity"]["maxQuantity"], F.lit(0)) != 0))


def quotes_mw(payloads: DataFrame) -> DataFrame:
    rows = opened(payloads, MW, "$.productPrices[0].price", "$.productPrices[0].sysPrice")
    p = F.col("_p")
    prices = F.coalesce(p["productPrices"], F.array())
    rows = rows.withColumns({"_normal": F.filter(prices, lambda x: ~is_limited(x)), "_limited": F.filter(prices, is_limited)})
    normal, limited = F.col("_normal"), F.col("_limited")
    pairs = F.array_distinct(F.transform(normal, lambda x: F.struct(x["price"], x["sysPrice"])))
    one = F.get(normal, F.lit(0))
    explicit = T.explicit_status(*(p[f] for f in STATUS_FIELDS))
    hidden = F.coalesce(p["hiddenPrice"], F.lit(False)) | ((F.size(prices) == 0) & explicit.isNotNull())
    preorder = present(one["expectedPrice"]).isNotNull() | present(p["crmPreorderCode"]).isNotNull()
    implied = F.when(preorder, "Sản phẩm đặt trước; xác minh điều kiện/tiền cọc trên trang.").when(
        ~one["isCanBuy"], "mã màu chưa cho đặt mua tại khu vực mặc định.")
    rows = rows.withColumns({
        "_sale": F.when(~hidden, money(one["price"])), "_listed": F.when(~hidden, money(one["sysPrice"])),
        "_status": F.coalesce(explicit, F.when(hidden, "Liên hệ; website ẩn giá của sản phẩm.").otherwise(implied))})
    flash = F.transform(F.filter(limited, lambda x: present(x["price"]).isNotNull()), lambda x: F.concat(
        F.lit("Giá giới hạn (giờ vàng/online) "), T.money_text(x["price"]), F.lit(", "),
        F.substring(F.coalesce(x["startDate"], F.lit("")), 12, 5), F.lit("–"),
        F.substring(F.coalesce(x["endDate"], F.lit("")), 12, 5), F.lit(" "),
        F.substring(F.coalesce(x["endDate"], F.lit("")), 1, 10),
        F.when(F.coalesce(x["stockQuantity"]["maxQuantity"], F.lit(0)) != 0, F.concat(
            F.lit(", tối đa "), x["stockQuantity"]["maxQuantity"], F.lit(" suất"))).otherwise("")))
    source = F.coalesce(one, F.get(prices, F.lit(0)))["promotions"]
    gifts = F.transform(source["giftPromotions"], lambda g: F.concat(
        F.coalesce(F.nullif(plain(g["title"]), F.lit("")), F.lit("Quà tặng")), F.lit(" "),
        F.array_join(F.transform(g["lstGift"], lambda x: plain(F.coalesce(x["displayName"], x["name"]))), ", ")))
    lines = lambda field: F.transform(source[field], lambda x: F.replace(
        plain(F.coalesce(x["content"], x["title"])), F.lit(" Xem chi tiết"), F.lit("")))
    paying = F.transform(F.filter(p["payments"], lambda x: F.coalesce(x["isActivated"], F.lit(True))
                                  & (F.coalesce(x["saleName"], F.lit("")) != "")),
                         lambda x: F.concat(F.lit("Thanh toán: "), plain(x["saleName"])))
    notes = notes_text(F.when(~hidden, flash), gifts, lines("discountPromotions"), lines("normalPromotions"), paying)
    values = F.flatten(F.transform(F.filter(p["filter"], lambda g: g["label"].isin("Màu", "Màu sắc", "Màu sắc master")),
                                   lambda g: g["values"]))
    options = F.transform(values, lambda v: F.struct(v["name"].alias("label"), v["productCodes"].alias("codes")))
    code = p["productCode"]
    return judged(rows, [(p["name"].isNull(), "no_payload"), (~F.coalesce(code.rlike(r"^\d{8,20}$"), F.lit(False)), "no_code"),
                         (code != F.col("variant_id"), "other_code"),
                         (~hidden & (F.size(pairs) != 1), "price_not_unique"),
                         (~hidden & broken_money(one["price"], one["sysPrice"]), "price_range")],
                  code, p["name"], P.coded_color(options, code), notes, p["payments"].isNotNull()).drop("_normal", "_limited")


# --- Viettel Store ---------------------------------------------------------------------------------------------------

VT_PRICE = "PriceDisplayType: int, Erp_Product_ID: string, SaleState: int, AmounInstock: int, Price: bigint, SellPrice: bigint"
VT = f"""product_name string, color string, shown_status string, active boolean, notes array<string>, has_offer boolean,
 d struct<stt: int, data: struct<{VT_PRICE}>>"""


def _vt_price(data: Column) -> Column:
    return F.when(data["PriceDisplayType"].isin(1, 2), data["Price"]).otherwise(data["SellPrice"])


def _vt_checks(answer: Column) -> list[tuple[Column, str]]:
    data = answer["data"]
    return [(data.isNull() | (answer["stt"] != 1), "no_payload"),
            (~F.coalesce(data["PriceDisplayType"].isin(0, 1, 2), F.lit(False)), "display_type"),
            (data["Erp_Product_ID"] != F.col("variant_id"), "other_code"), (broken_money(_vt_price(data)), "price_range")]


def quotes_vt(payloads: DataFrame) -> DataFrame:
    rows = opened(payloads, VT, "$.d.data.Price", "$.d.data.SellPrice")
    p, data = F.col("_p"), F.col("_p.d.data")
    raw = _vt_price(data)
    listed = F.when(money(raw).isNotNull() & (data["Price"] != raw), money(data["Price"]))
    status = F.when(data["SaleState"] != 0, "đặt trước, cần xác minh ngày giao hàng.").when(
        data["AmounInstock"] <= 0, "biến thể hết hàng tại khu vực mặc định.").when(
        money(raw).isNull() & p["active"], T.explicit_status(p["shown_status"]))
    rows = rows.withColumns({"_sale": money(raw), "_listed": listed, "_status": status})
    offers = F.coalesce(p["has_offer"], F.lit(True))
    unsure = F.when(offers, strings(F.lit("CTKM chưa xác minh đầy đủ")))
    return judged(rows, _vt_checks(F.col("_p.d")), F.col("variant_id"), p["product_name"], p["color"],
                  notes_text(p["notes"], unsure), ~offers)


VT_TREE = f"""tree array<struct<Product_ID: string, Rules_ID: string, PreorderProductId: string, Title: string, RuleName: string,
  HasStock: string>>, d struct<stt: int, data: struct<{VT_PRICE}>>"""


def quotes_vt_preorder(payloads: DataFrame) -> DataFrame:
    """Pre-order pages: the variant comes from the product tree (``parent_id`` is the product of the link)."""
    rows = opened(payloads, VT_TREE, "$.d.data.Price", "$.d.data.SellPrice")
    mine = F.filter(F.col("_p.tree"), lambda r: (r["Product_ID"] == F.col("parent_id")) & r["Rules_ID"].isNotNull()
                    & r["PreorderProductId"].isNotNull())
    titles = F.array_distinct(F.transform(mine, lambda r: F.trim(r["Title"])))
    locked = F.filter(mine, lambda r: r["PreorderProductId"] == F.col("variant_id"))
    one, data = F.get(locked, F.lit(0)), F.col("_p.d.data")
    status = F.concat(F.lit("Trang đặt trước; xác minh ngày giao và điều kiện đặt hàng trên website."),
                      F.when(one["HasStock"] == "1", "").otherwise(" Mã màu hiện không còn suất đặt."))
    rows = rows.withColumns({"_sale": money(_vt_price(data)), "_listed": none("bigint"), "_status": status})
    color = F.trim(F.regexp_replace(one["RuleName"], r"^Màu sắc:\s*", ""))
    notes = F.lit("CTKM trang đặt trước chưa được xác minh đầy đủ; chưa trừ ưu đãi thanh toán/thu cũ.")
    checks = [(F.size(titles) != 1, "model_not_unique"), (F.size(locked) != 1, "other_variant"), *_vt_checks(F.col("_p.d"))]
    return judged(rows, checks, F.col("variant_id"), F.get(titles, F.lit(0)), color, notes, F.lit(False))


# --- one registry by chain -------------------------------------------------------------------------------------------

READERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "TGDD": quotes_mw, "CellphoneS": quotes_cps, "Viettel Store": quotes_vt, "FPT Shop": quotes_fpt, "Phong Vũ": quotes_pv}
QUOTE_COLUMNS = ["quoted_variant", "quoted_name", "quoted_color", "quoted_price", "quoted_list", "quoted_text",
                 "promotion_complete", "issue"]


def read_all(payloads: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Quotes of all chains in one pass, by the reader registered for each; add a chain by adding its reader.

    Each payload is parsed once and shown to its own chain's reader only.  Every payload gives one row: one of a chain without a reader,
    or of no chain, has the issue ``no_reader``.
    """
    names = [c for c in payloads.columns if c != "payload"]
    rows = payloads.withColumns({"_all": F.try_parse_json("payload"), "_raw": F.col("payload")})
    answers = []
    for number, (chain, reader) in enumerate((readers or READERS).items()):
        mine = F.col("chain") == chain
        rows = reader(rows.withColumns({"_doc": F.when(mine, F.col("_all")), "payload": F.when(mine, F.col("_raw"))}))
        answers.append(f"_answer{number}")
        rows = rows.withColumn(answers[-1], F.when(mine, F.struct(*QUOTE_COLUMNS))).drop(*QUOTE_COLUMNS)
    kinds = rows.schema[answers[0]].dataType
    unread = F.struct(*(F.lit("no_reader" if f.name == "issue" else None).cast(f.dataType).alias(f.name) for f in kinds))
    out = rows.withColumn("_answer", F.coalesce(*answers, unread)).select(*names, "_answer.*")
    # The counters also keep filters above from being copied into every reader's rules.
    return out.observe("payloads", F.count(F.lit(1)).alias("read"), F.count_if(F.col("issue").isNull()).alias("quoted"))


def split_quotes(quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return quotes.filter("issue IS NULL").drop("issue"), quotes.filter("issue IS NOT NULL")


# --- markup ----------------------------------------------------------------------------------------------------------


def page_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per product card of a listing page: id, name, href, brand, price, list price, promotion text, error.

    A page that can't be trusted (no total, unfinished or nested card, a field or product twice) gives one row with
    ``page_error`` instead.  Pages are read in Arrow batches by a stack of open elements; nothing is shuffled.
    """
    others = [c for c in pages.columns if c != html]
    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in others)
    read = pages.select(*others, html).mapInArrow(cards.read_batches, f"{schema}, _cards array<{cards.FACTS_DDL}>")
    rows = read.select(*others, F.inline("_cards")).withColumns({"_sale": T.parse_money(F.col("price")), "_old": T.parse_money(F.col("price_old"))})
    sale, old = F.col("_sale"), F.col("_old")
    error = (F.when(F.col("page_error").isNotNull(), None).when(sale.isNull(), "price")
             .when((F.col("price_old") != "") & old.isNull(), "list_price").when(old < sale, "list_below_price").otherwise(""))
    return rows.withColumn("price_error", error).withColumns({
        "promo_price": F.when(F.col("price_error") == "", sale), "original_price": F.when(F.col("price_error") == "", old)}).drop(
        "price", "price_old", "_sale", "_old")


def child_codes(html: Column) -> Column:
    """Distinct product codes of the color block, in order; the rest of the page is ignored."""
    block = F.regexp_extract(html, r'(?s)class="list-variants"(.*?)</ul>', 1)
    return F.array_distinct(F.regexp_extract_all(block, F.lit(r'data-product-id="(\d+)"'), 1))


CHUNK = 'self.__next_f.push([1,"'


def script_text(html: Column) -> Column:
    """Joined text of a page's script chunks; NULL without any.

    Each chunk is a JSON string.  It ends at the first quote that is not escaped, so no balanced matching is needed.
    """
    chunks = F.split(html, r"self\.__next_f\.push\(\[1,\"")
    tails = F.slice(chunks, F.lit(2), F.greatest(F.size(chunks) - 1, F.lit(0)))
    raw = F.transform(tails, lambda t: F.regexp_extract(t, r'(?s)^(.*?)(?<!(?<!\\)\\)"\]\)', 1))
    parts = F.transform(raw, lambda r: F.get(F.from_json(F.concat(F.lit('["'), r, F.lit('"]')), "array<string>"), F.lit(0)))
    return F.when(F.contains(html, F.lit(CHUNK)), F.array_join(parts, ""))


def embedded_block(pages: DataFrame, marker: str, schema: str, html: str = "html") -> DataFrame:
    """Parse the JSON value after ``marker`` in a page's script text.  No or several occurrences are an error.

    The JSON reader stops at the end of the first value, which is exactly the balanced cut.
    """
    rows = pages.withColumn("_text", script_text(F.col(html)))
    pieces = F.split("_text", "\\Q" + marker + "\\E")
    rows = rows.withColumn("_pieces", pieces)
    error = (F.when(F.col("_text").isNull(), "no_script").when(F.size("_pieces") < 2, "no_block")
             .when(F.size("_pieces") > 2, "several_blocks"))
    return (rows.withColumn("block_error", error)
            .withColumn("block", F.when(F.col("block_error").isNull(), F.from_json(F.get("_pieces", F.lit(1)), schema)))
            .drop("_text", "_pieces", html))


def page_data(html: Column, schema: str) -> Column:
    """The page's own data document, NULL when it is missing or not JSON."""
    text = F.regexp_extract(html, r'(?s)<script id="__NEXT_DATA__" type="application/json"[^>]*>(.*?)</script>', 1)
    return F.from_json(F.nullif(text, F.lit("")), schema)
