"""Catalog jobs: representatives, conflicts, duplicates, merges of runs, pending links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import text as T
from shelfledger.functions.product import locked_sku
from shelfledger.operators.latest import first_per_key, latest_group, latest_per_key
from shelfledger.operators.quality import missing
from shelfledger.operators.skew import attach, with_group_facts

SHARED_SKU = "Nhiều URL cùng SKU; cần làm rõ biến thể"


def representatives(candidates: DataFrame) -> DataFrame:
    """Mark ``chosen`` candidates of every (chain, group_key).

    All are kept for a tracked model, a lone member, a missing price or several prices; otherwise one: in stock first,
    then the smallest variant id.  All facts are extremes and counts, so nothing of a group is collected.
    """
    in_stock = ((F.coalesce("stock", F.lit(1)) > 0) & ~F.lower(F.coalesce("listing_status", F.lit(""))).contains("hết"))
    rank = F.struct((~in_stock).alias("out"), F.coalesce("variant_id", "source_url").alias("variant"), F.col("seq"))
    rows = with_group_facts(candidates, ["chain", "group_key"], _size=F.count(F.lit(1)),
                            _priced=F.count("listing_price"), _low=F.min("listing_price"), _high=F.max("listing_price"),
                            _tracked=F.max("tracked"), _pick=F.min(rank))
    keep_all = (F.col("_tracked") | (F.col("_size") == 1) | (F.col("_priced") < F.col("_size"))
                | (F.col("_low") != F.col("_high")))
    return rows.withColumn("chosen", keep_all | (F.col("seq") == F.col("_pick.seq"))).drop(
        "_size", "_priced", "_low", "_high", "_tracked", "_pick")


def listing_pages(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted distinct listing pages per link.  Pairs are made distinct before they meet, so the array is as long as
    the number of seed pages that show the link, whatever the number of copies."""
    pairs = rows.select(*keys, F.explode("listing_urls").alias("_page")).distinct()
    return pairs.groupBy(*keys).agg(F.array_sort(F.collect_set("_page")).alias("listing_urls"))


def reject_shared_skus(rows: DataFrame) -> DataFrame:
    """Ready rows that share (chain, sku): one link keeps its first row with all listing pages; several links all go
    to review, because choosing one could mix up colors or conditions."""
    ready, rest = rows.filter("status = 'ready'"), rows.filter("status <> 'ready'")
    marked = with_group_facts(ready, ["chain", "sku"], _low=F.min("source_url"), _high=F.max("source_url"),
                              _first=F.min("seq"))
    clash = F.col("_low") != F.col("_high")
    kept = marked.filter(clash | (F.col("seq") == F.col("_first")))
    pages = listing_pages(ready, ["chain", "sku", "source_url"])
    merged = (kept.withColumn("_clash", clash).drop("_low", "_high", "_first")
              .withColumnRenamed("listing_urls", "_own"))
    merged = attach(merged, pages, ["chain", "sku", "source_url"])
    return (merged.withColumn("listing_urls", F.when(F.col("_clash"), F.col("_own")).otherwise(F.col("listing_urls")))
            .withColumn("status", F.when(F.col("_clash"), "review").otherwise(F.col("status")))
            .withColumn("reason", F.when(F.col("_clash"), SHARED_SKU).otherwise(F.col("reason")))
            .withColumn("verified", F.col("verified") & ~F.col("_clash"))
            .drop("_clash", "_own").unionByName(rest))


def dedupe_links(rows: DataFrame) -> DataFrame:
    """One row per (chain, link): the first ready one, else the first; listing pages of all copies are merged."""
    keys = ["chain", "source_url"]
    kept = first_per_key(rows, keys, [(F.col("status") != "ready").asc(), F.col("seq").asc()]).drop("listing_urls")
    return kept.join(listing_pages(rows, keys), keys, "left").withColumn(
        "listing_urls", F.coalesce("listing_urls", F.array().cast("array<string>")))


def round_robin(rows: DataFrame, n: int, source: str = "input_row") -> DataFrame:
    """``n`` rows spread over the sources: the first of each, then the second of each; rows without a source last."""
    from pyspark.sql.window import Window
    turn = F.row_number().over(Window.partitionBy(source).orderBy("seq"))
    return (rows.withColumn("turn", turn).filter(F.col("turn") <= n)
            .orderBy("turn", F.col(source).asc_nulls_last()).limit(n))


def latest_chain_issues(issues: DataFrame, period: str) -> DataFrame:
    """Issues of the newest capture per (period, chain), then the first per (chain, link, sku)."""
    newest = latest_group(issues, [period, "chain"], "captured_at")
    return first_per_key(newest, [period, "chain", "source_url", "sku"], [F.col("seq")])


def issue_dedupe(issues: DataFrame, keys: Sequence[str] = ("source_url", "sku", "reason")) -> DataFrame:
    """The last issue per key, in arrival order."""
    filled = issues.na.fill("", [k for k in keys])
    return first_per_key(filled, keys, [F.col("seq").desc()])


def enrich(observations: DataFrame, by_link: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Catalog attributes by link; what the observation itself says wins."""
    facts = first_per_key(by_link, ["source_url"], [F.col("seq").desc()]).select(
        "source_url", *(F.col(c).alias(f"_{c}") for c in columns))
    joined = attach(observations, facts, ["source_url"])
    return joined.withColumns({c: F.coalesce(c, f"_{c}") if c in observations.columns else F.col(f"_{c}")
                               for c in columns}).drop(*(f"_{c}" for c in columns))


def enrich_by_sku_then_link(links: DataFrame, prices: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Observed attributes of a catalog link, found by SKU first and by link otherwise."""
    by_sku = latest_per_key(prices, ["sku"]).select("sku", F.lit(True).alias("_by_sku"),
                                                    *(F.col(c).alias(f"_s_{c}") for c in columns))
    by_link = latest_per_key(prices, ["source_url"]).select("source_url", *(F.col(c).alias(f"_l_{c}") for c in columns))
    joined = attach(attach(links, by_sku, ["sku"]), by_link, ["source_url"])
    return joined.withColumns({f"observed_{c}": F.when(F.col("_by_sku"), F.col(f"_s_{c}")).otherwise(F.col(f"_l_{c}"))
                               for c in columns}).drop("_by_sku", *(f"_{p}_{c}" for p in "sl" for c in columns))


def pending_links(catalog: DataFrame, priced: DataFrame, issues: DataFrame, day: str) -> DataFrame:
    """Catalog links found up to the day that have neither a price nor an issue."""
    keys = ["chain", "source_url"]
    answered = priced.select(keys).union(issues.select(keys)).distinct()
    known = catalog.filter(F.to_date("discovered_at") <= F.lit(day).cast("date"))
    return known.join(answered, keys, "left_anti")


def recheck_review(review: DataFrame, quotes: DataFrame, priced: DataFrame,
                   unlocked: Sequence[str] = ("Viettel Store", "TGDD"), shared: str = "Viettel Store"
                   ) -> tuple[DataFrame, DataFrame]:
    """(rows, issues) of requoted review links.

    ``quotes`` has one answer per link: quoted_variant, quoted_sku_key, quoted_price, quoted_list, quoted_text, error.
    The first broken rule is the reason.
    """
    coded = review.withColumn("_code", F.coalesce(F.col("variant_id"), F.concat(F.lit("\u0001"), F.col("seq"))))
    rows = with_group_facts(coded, ["chain", "_code"], _copies=F.count(F.lit(1)))
    rows = attach(rows, quotes, ["source_url"])
    quoted = F.coalesce("quoted_variant", F.lit(""))
    rows = rows.withColumn("_sku", locked_sku(F.col("chain"), F.coalesce("quoted_sku_key", quoted)))
    taken = priced.select("chain", F.col("sku").alias("_sku"), F.lit(True).alias("_taken")).distinct()
    rows = attach(rows, taken, ["chain", "_sku"])
    # two review links may also answer with one SKU: the first in order gets it
    answered = (F.col("quoted_variant").isNotNull() & F.col("error").isNull())
    price = F.col("quoted_price")
    reason = (F.when(F.contains(F.coalesce("reason", F.lit("")), F.lit("Nhiều URL cùng SKU"))
                     | ((F.col("_copies") > 1) & F.col("variant_id").isNotNull() & (F.col("chain") != shared)),
                     "shared_code")
              .when(F.col("variant_id").isNull() & ~F.col("chain").isin(*unlocked), "no_code")
              .when(F.col("error").isNotNull(), F.col("error"))
              .when((quoted == "") | (F.col("variant_id") != quoted), "other_code")
              .when(F.col("_sku").isNull(), "no_sku")
              .when(~missing(F.col("sku")) & (F.col("sku") != F.col("_sku")), "other_sku")
              .when(F.coalesce("_taken", F.lit(False)), "already_priced")
              .when(price.isNull() & ~T.has_status(F.col("quoted_text")), "no_price")
              .when(~price.between(V.MIN_VND, V.MAX_VND), "price_range")
              .when(price.isNotNull() & (F.col("quoted_list") < price), "list_below_price"))
    judged = rows.withColumn("issue", reason).drop("_copies", "_taken", "_code")
    winners = judged.filter("issue IS NULL").groupBy("chain", "_sku").agg(F.min("seq").alias("_first"))
    judged = attach(judged, winners, ["chain", "_sku"])
    judged = judged.withColumn("issue", F.when(F.col("issue").isNull() & (F.col("seq") != F.col("_first")),
                                               "already_priced").otherwise(F.col("issue")))
    listed = F.when(price.isNotNull(), F.col("quoted_list"))
    good = judged.filter("issue IS NULL").withColumn("sku", F.col("_sku")).withColumn("original_price", listed)
    return good.drop("issue", "_sku", "_first"), judged.filter("issue IS NOT NULL").drop("_sku", "_first")


def supersede(old: DataFrame, new: DataFrame, checked: DataFrame, key: str = "source_url") -> DataFrame:
    """Old issues except those of re-checked links, plus the new ones."""
    return old.join(checked.select(key).distinct(), key, "left_anti").unionByName(new)


def last_write(batches: Sequence[DataFrame], keys: Sequence[str] = ("sku",)) -> DataFrame:
    """Union in which a later batch replaces an earlier one per key."""
    out = None
    for rank, batch in enumerate(batches):
        ranked = batch.withColumn("_rank", F.lit(rank))
        out = ranked if out is None else out.unionByName(ranked)
    return first_per_key(out, keys, [F.col("_rank").desc(), F.col("seq").desc()]).drop("_rank")


def merge_runs(sources: DataFrame, rows: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, missing sources, unexpected sources): each source is taken from the last run in which it succeeded, and
    only that run's rows."""
    keys = ["chain", "input_row"]
    chosen = sources.filter("ok").groupBy(*keys).agg(F.max("run").alias("run"))
    kept = rows.join(chosen, [*keys, "run"], "left_semi")
    return (kept, expected.select(keys).distinct().join(chosen, keys, "left_anti"),
            chosen.select(keys).join(expected.select(keys).distinct(), keys, "left_anti"))


def both_ways(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Sources missing from the result and sources nobody asked for."""
    return (expected.subtract(found).withColumn("side", F.lit("missing"))
            .unionByName(found.subtract(expected).withColumn("side", F.lit("unexpected"))))


def discovery_config(candidates: DataFrame, quotes: DataFrame) -> DataFrame:
    """Candidate and quote to a ready row (locked SKU, name with color) or a review row (reason).

    ``quotes`` has one answer per link: quoted_name, quoted_variant, quoted_sku_key, quoted_color, error.
    """
    rows = attach(candidates, quotes, ["source_url"])
    ok = F.col("quoted_variant").isNotNull() & F.col("error").isNull()
    sku = locked_sku(F.col("chain"), F.coalesce("quoted_sku_key", "quoted_variant"))
    ok = ok & sku.isNotNull()
    color = F.coalesce(F.nullif("quoted_color", F.lit("")), F.nullif("color", F.lit("")), F.lit(""))
    name = F.col("quoted_name")
    named = F.when((color != "") & ~F.contains(F.lower(name), F.lower(color)), F.concat(name, F.lit(" · "), color)
                   ).otherwise(name)
    listed_sku = F.when(F.col("chain") != "Viettel Store", locked_sku(F.col("chain"), F.col("variant_id")))
    return rows.withColumns({
        "status": F.when(ok, "ready").otherwise("review"),
        "reason": F.when(ok, "").otherwise(F.coalesce("error", F.lit("no_answer"))),
        "sku": F.when(ok, sku).otherwise(F.coalesce(listed_sku, F.lit(""))),
        "product_name": F.when(ok, named).otherwise(F.col("product_name")),
        "color": F.when(ok, color).otherwise(F.coalesce("color", F.lit(""))), "verified": ok})


def quote_rows(items: DataFrame, quotes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(price rows, issues): the computed SKU must equal the locked one and a missing price needs a status."""
    rows = attach(items, quotes, ["source_url"])
    price = F.col("quoted_price")
    reason = (F.when(F.col("error").isNotNull(), F.col("error"))
              .when(~F.coalesce(locked_sku(F.col("chain"), F.coalesce("quoted_sku_key", "quoted_variant"))
                                == F.col("sku"), F.lit(False)), "Biến thể khác biến thể đã khóa; cần khám phá lại")
              .when(price.isNull() & ~T.has_status(F.col("quoted_text")), "Không có giá hoặc trạng thái")
              .when(price.isNotNull() & T.parse_money(price.cast("string")).isNull(), "Giá ngoài khoảng hợp lý"))
    judged = rows.withColumn("reason", reason)
    good = judged.filter("reason IS NULL").drop("reason")
    bad = judged.filter("reason IS NOT NULL").withColumn("error_kind", T.error_kind(F.col("reason")))
    return good, bad


def listing_complete(cards: DataFrame, share: dict[str, int], max_candidates: int) -> DataFrame:
    """Completeness verdict per (chain, listing): distinct codes against the published total.

    ``cards`` holds page, code and the total printed on that page.
    """
    once = cards.groupBy("chain", "listing", "code").agg(
        F.count_distinct("page").alias("_pages"), F.min("total").alias("_low"), F.max("total").alias("_high"))
    rows = once.groupBy("chain", "listing").agg(
        F.count(F.lit(1)).alias("codes"), F.min("_low").alias("total"), F.max("_high").alias("_high"),
        F.count_if(F.col("_pages") > 1).alias("repeated"))
    percent = F.lit(100)
    for chain, value in share.items():
        percent = F.when(F.col("chain") == chain, value).otherwise(percent)
    tolerant = percent < 100
    verdict = (F.when(F.col("total") != F.col("_high"), "total_changed")
               .when(F.col("total") > max_candidates, "too_many")
               .when(~tolerant & (F.col("repeated") > 0), "repeated")
               .when(tolerant & (F.col("codes") * 100 < F.col("total") * percent), "incomplete")
               .when(~tolerant & (F.col("codes") != F.col("total")), "incomplete").otherwise("complete"))
    return rows.withColumn("verdict", verdict).drop("_high")


def merge_cards(cards: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cards, links) with the cards of one model merged: first non-empty name and number of repeats, and each link once
    at its first place.

    Links stay rows with their order columns; a model that owns a third of all links is never one value.
    """
    keys = ["listing", "model"]
    named = F.when(F.coalesce("name", F.lit("")) != "", F.col("seq"))
    merged = cards.groupBy(*keys).agg(F.min_by("name", named).alias("name"), (F.count(F.lit(1)) - 1).alias("repeats"))
    first = links.groupBy(*keys, "link").agg(F.min(F.struct("seq", "position")).alias("_at"))
    return merged, first.select(*keys, "link", F.col("_at.seq").alias("seq"), F.col("_at.position").alias("position"))
