"""Counts, summaries and coverage reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger import fixed_values as V
from shelfledger.functions import text as T
from shelfledger.operators.distinct import exact_counts
from shelfledger.operators.history import SERIES, week_change
from shelfledger.operators.latest import latest_per_key
from shelfledger.operators.rule_index import with_hits


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def dashboard_kpis(history: DataFrame) -> DataFrame:
    """Headline numbers of every week."""
    marked = history.withColumn("has_promo", F.col("promo_text") != "")
    weeks = week_change(marked, ["has_promo"]).groupBy("week_start").agg(
        F.count(F.lit(1)).alias("products"), F.countDistinct("chain").alias("chains"),
        F.count("change").alias("comparable"), count_if(F.col("change") < 0).alias("drops"),
        count_if(F.col("has_promo")).alias("with_promo"))
    captures = history.groupBy("week_start").agg(F.countDistinct("business_date").alias("observed_days"),
                                                 F.max("observed_at").alias("last_capture"))
    return weeks.join(captures, "week_start")


def day_counts(history: DataFrame) -> DataFrame:
    return history.groupBy("business_date", "chain").agg(F.count(F.lit(1)).alias("records"),
                                                         F.countDistinct("sku").alias("skus"))


# --- run and discovery summaries -------------------------------------------------------------------------------------


def counted_map(df: DataFrame, keys: Sequence[str], kind: str, name: str) -> DataFrame:
    """Map kind to count per key; kinds are a fixed list, so a map stays small."""
    counts = df.groupBy(*keys, kind).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "_n")))).alias(name))


def run_summary(catalog: DataFrame, prices: DataFrame, issues: DataFrame) -> DataFrame:
    """Per chain: links, prices, issues by kind and a status; below half of the ready links a run is degraded."""
    links = catalog.groupBy("chain").agg(count_if(F.col("status") == "ready").alias("ready"),
                                         count_if(F.col("status") != "ready").alias("review"))
    read = prices.groupBy("chain").agg(F.count(F.lit(1)).alias("prices"), F.count("promo_price").alias("numeric"))
    broken = issues.groupBy("chain").agg(
        F.count(F.lit(1)).alias("issues"), count_if(F.col("stage") == "price").alias("failures"),
        count_if(F.col("error_kind") == "blocked").alias("blocked"))
    out = (links.join(read, "chain", "left").join(broken, "chain", "left")
           .join(counted_map(issues, ["chain"], "error_kind", "issues_by_kind"), "chain", "left")
           .na.fill(0, ["prices", "numeric", "issues", "failures", "blocked"]))
    status = F.when(F.col("prices") == 0, "failed").when(F.col("prices") * 2 < F.col("ready"), "degraded").otherwise("ok")
    return out.withColumns({"expected": F.col("ready") + F.col("review"),
                            "status_only": F.col("prices") - F.col("numeric"), "status": status})


def discovery_summary(sources: DataFrame, rows: DataFrame) -> DataFrame:
    """Per chain: sources read and failed, links, ready and review, status and whether the catalog may be published."""
    per_chain = sources.groupBy("chain").agg(
        F.count(F.lit(1)).alias("sources"), count_if(~F.col("ok")).alias("sources_failed"),
        F.sum("excluded").alias("excluded"))
    links = rows.groupBy("chain").agg(F.count(F.lit(1)).alias("links"), count_if(F.col("status") == "ready").alias("ready"))
    out = per_chain.join(links, "chain", "left").na.fill(0, ["links", "ready"])
    good = (F.col("sources_failed") == 0) & (F.col("ready") > 0)
    return out.withColumns({"sources_ok": F.col("sources") - F.col("sources_failed"),
                            "review": F.col("links") - F.col("ready"),
                            "status": F.when(good, "ok").otherwise("failed"), "published": good})


def source_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("chain", "input_row").agg(
        F.count(F.lit(1)).alias("links"), count_if(F.col("status") == "ready").alias("ready"),
        count_if(F.col("status") == "review").alias("review"))


def chain_states(chains: DataFrame, summaries: DataFrame, asked: Sequence[str] | None = None) -> DataFrame:
    """Every chain with its state: the summary's status, skipped when not asked for, else missing.

    Two summaries of one chain are refused: its state is ``ambiguous`` and none of their numbers is passed on.
    """
    once = summaries.groupBy("chain").agg(F.max_by(F.struct(*[c for c in summaries.columns if c != "chain"]), F.col(
        "status")).alias("_s"), F.count(F.lit(1)).alias("copies"))
    joined = chains.join(once, "chain", "left")
    skipped = ~F.col("chain").isin(list(asked)) if asked is not None else F.lit(False)
    several = F.coalesce(F.col("copies") > 1, F.lit(False))
    state = F.when(several, "ambiguous").otherwise(F.coalesce(F.col("_s.status"), F.when(skipped, "skipped").otherwise("missing")))
    extra = [F.when(~several, F.col(f"_s.{c}")).alias(c) for c in summaries.columns if c not in ("chain", "status")]
    return joined.select("chain", state.alias("status"), F.coalesce("copies", F.lit(0)).alias("copies"), *extra)


def state_detail(states: DataFrame) -> DataFrame:
    """Label per chain: open issues or fewer prices than links need a check."""
    open_items = (F.coalesce("issues", F.lit(0)) > 0) | F.coalesce(F.col("prices") < F.col("expected"), F.lit(False))
    label = F.when(F.col("status").isin("ok", "degraded") & open_items, "needs_check").otherwise(F.col("status"))
    detail = F.when(F.col("prices").isNotNull() & F.col("expected").isNotNull(), F.concat_ws(
        ", ", F.concat("prices", F.lit("/"), "expected"),
        F.when(F.col("blocked") > 0, F.concat("blocked", F.lit(" blocked")))))
    return states.withColumns({"label": label, "detail": F.coalesce(detail, F.lit(""))})


def first_failed_sources(sources: DataFrame, n: int = 5) -> DataFrame:
    """The first failed sources of every chain, for a report line each."""
    from shelfledger.operators.latest import first_per_key
    return first_per_key(sources.filter(~F.col("ok")), ["chain"], [F.col("input_row")], n)


def report_totals(states: DataFrame) -> DataFrame:
    """Totals over the chain dimension, whose size is fixed."""
    pair = F.struct("chain", "expected", "prices")
    return states.agg(
        F.sum("expected").alias("expected"), F.sum("issues").alias("issues"),
        F.array_sort(F.collect_list(F.when(F.coalesce("expected", F.lit(0)) > 0, pair))).alias("by_chain"),
        F.array_sort(F.collect_list(F.when(F.col("status") != "ok", F.col("chain")))).alias("not_ok"))


def overall_status(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    all_good, all_bad = F.bool_and(F.col("status") == "success"), F.bool_and(F.col("status") == "error")
    return results.groupBy(*keys).agg(
        F.when(all_good, "success").when(all_bad, "error").otherwise("partial").alias("overall"))


def content_fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Order-free fingerprint: equal row sets give equal values.

    Row digests are summed in two lanes, so nothing is sorted or collected; the row count guards against lost pairs.
    """
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)
    lane = lambda start: F.sum(F.conv(F.substring(row, start, 8), 16, 10).cast("decimal(28,0)"))
    lanes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), lane(1).alias("_a"), lane(9).alias("_b"))
    return lanes.select(*keys, F.concat_ws("-", "_n", F.col("_a").cast("string"), F.col("_b").cast("string")).alias("fingerprint"))


# --- freshness and coverage ------------------------------------------------------------------------------------------


def _today(day: str) -> Column:
    return (F.col("business_date") == F.lit(day).cast("date")) & F.col("stale_since").isNull()


def freshness_metrics(history: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """Counts over the latest record of every series; history is never counted as fresh."""
    latest = latest_per_key(history, SERIES).withColumn("_fresh", _today(day))
    counts = latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("latest_skus"), F.countDistinct("model").alias("latest_models"),
        count_if(F.col("_fresh")).alias("today_verified_skus"),
        count_if(F.col("_fresh") & F.col("promo_price").isNotNull()).alias("today_numeric"),
        count_if(F.col("_fresh") & F.col("promo_price").isNull()).alias("today_status_only"),
        count_if(F.col("stale_since").isNotNull()).alias("explicitly_stale"))
    rows = history.groupBy(*keys).agg(F.count(F.lit(1)).alias("history_rows"))
    counts = counts.withColumn("not_verified_today", F.col("latest_skus") - F.col("today_verified_skus"))
    return rows.join(counts, list(keys)) if keys else counts.withColumn("history_rows", rows.scalar())


def models_without_today(history: DataFrame, day: str) -> DataFrame:
    latest = latest_per_key(history, SERIES)
    seen = latest.filter(_today(day)).select("chain", "model").distinct()
    return latest.select("chain", "model").distinct().join(seen, ["chain", "model"], "left_anti")


def source_coverage(expected: DataFrame, diagnostics: DataFrame, absent: str = "missing") -> DataFrame:
    """Every expected seed with its result; a seed without one is named."""
    return (expected.join(diagnostics, ["input_row", "url"], "left")
            .withColumn("status", F.coalesce("status", F.lit(absent))).withColumn("error", F.coalesce("error", F.lit(""))))


def missing_models(catalog: DataFrame, shown: DataFrame, colored: DataFrame) -> DataFrame:
    """Catalog models neither shown nor represented by a shown SKU, with the reason."""
    keys = ["chain", "model"]
    by_sku = catalog.join(shown.select("chain", "sku").distinct(), ["chain", "sku"], "left_semi")
    wanted = catalog.filter(F.coalesce("model", F.lit("")) != "").select(keys).distinct()
    left = (wanted.join(shown.select(keys).distinct(), keys, "left_anti")
            .join(by_sku.select(keys).distinct(), keys, "left_anti"))
    strict = colored.filter("color IS NOT NULL").select("model", F.lit(True).alias("_strict"))
    return left.join(strict, "model", "left").select(
        *keys, F.when(F.col("_strict"), "no_verified_color").otherwise("no_price_or_name").alias("reason"))


def coverage_audit(sources: DataFrame, catalog: DataFrame, prices: DataFrame, issues: DataFrame) -> DataFrame:
    """One wide row per chain.  Each input is aggregated on its own before the joins over the chain dimension."""
    parts = [
        sources.groupBy("chain").agg(F.count(F.lit(1)).alias("sources_total"), count_if(F.col("ok")).alias("sources_ok")),
        catalog.groupBy("chain").agg(F.count(F.lit(1)).alias("links"), count_if(F.col("model").isNull()).alias("unknown_models")),
        exact_counts(catalog, ["chain"], urls="source_url", skus="sku", models="model"),
        exact_counts(prices, ["chain"], price_skus="sku"),
        prices.groupBy("chain").agg(
            F.count("promo_price").alias("priced"),
            count_if(F.col("promo_price").isNull()).alias("status_only"),
            F.min("observed_at").alias("observed_from"), F.max("observed_at").alias("observed_to")),
        issues.groupBy("chain").agg(F.count(F.lit(1)).alias("issues"),
                                    count_if(F.col("error_kind").isin(V.ACCESS_ERRORS)).alias("access_errors")),
        counted_map(issues, ["chain"], "error_kind", "issue_kinds")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "chain", "left")
    return out


def rule_conflicts(names: DataFrame, index: DataFrame, own: str | None = None) -> DataFrame:
    """Distinct names hit by none or several rules of ``index``, with the rules they hit; with ``own`` (the column that names each
    row's rule) also names that hit one foreign rule."""
    judged = with_hits(names.select("name", *([own] if own else [])).distinct(), index, "name")
    foreign = F.get("hits", F.lit(0)) != F.coalesce(F.col(own), F.lit("")) if own else F.lit(False)
    return judged.filter((F.size("hits") != 1) | foreign)


def rule_preview(catalog: DataFrame, history: DataFrame, rules: Sequence[tuple[str, str]], model: str,
                 accepted: Sequence[str], proof_names: Sequence[str]) -> DataFrame:
    """What a draft rule would do per chain: links, records, proofs that hold, proofs that do not, colors on offer.

    ``accepted``: folded color names, empty for any color; ``proof_names``: folded current and previous model names.
    """
    from shelfledger.functions.product import rule_label
    # the draft's own pattern is one cheap test that spares most rows the whole rule table
    own = T.matches(F.col("product_name"), dict(rules)[model])
    mine = lambda df: df.filter(own & (rule_label(F.col("product_name"), rules) == model))
    links = mine(catalog).groupBy("chain").agg(F.count(F.lit(1)).alias("links"),
                                               count_if(F.col("status") == "ready").alias("links_ready"))
    proof = F.col("color_evidence")
    wanted, names = [F.lit(c) for c in accepted], [F.lit(n) for n in proof_names]
    holds = (T.fold(proof["model"]).isin(names) & T.fold(proof["canonical_color"]).isin(wanted)
             & (proof["product_code"] == F.col("variant_id")) & proof["website_color_id"].isNotNull()
             & (F.coalesce(proof["verified_at"], F.lit("")) != "")) if accepted else F.lit(True)
    holds = F.coalesce(holds, F.lit(False))
    latest = latest_per_key(mine(history), SERIES)
    offered = F.bool_or(T.fold(F.col("color")).isin(wanted)) if accepted else F.lit(True)
    records = latest.groupBy("chain").agg(
        F.count(F.lit(1)).alias("records"), count_if(holds).alias("verified"),
        count_if(~holds & proof.isNotNull()).alias("stale_proofs"),
        F.array_sort(F.collect_set(F.nullif("color", F.lit("")))).alias("colors"), offered.alias("color_available"))
    return links.join(records, "chain", "full_outer")


def link_check_state(links: DataFrame, checks: DataFrame) -> DataFrame:
    """Current links with their last check; it counts only while model and color are still the same."""
    keyed = lambda df: df.withColumn("_model", T.fold(F.col("model")))
    last = checks.groupBy(T.fold(F.col("model")).alias("_model"), "channel", "url").agg(
        F.max_by(F.struct("status", "detail", "color"), "checked_at").alias("_check"))
    joined = keyed(links).join(last, ["_model", "channel", "url"], "left")
    valid = F.col("_check").isNotNull() & (T.fold(F.col("_check.color")) == T.fold(F.col("color")))
    return joined.withColumns({
        "status": F.when(valid, F.col("_check.status")).otherwise("unchecked"),
        "detail": F.when(valid, F.col("_check.detail")).otherwise("")}).drop("_model", "_check")
