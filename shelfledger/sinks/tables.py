"""Writing runs, history, issues, snapshots and exports.

A run is written rows first and header last; readers join through the header, so a half-written run stays invisible.
Every write is a dynamic overwrite of whole partitions, and what belongs to a run lies in partitions of that run, so a
retried run replaces what its first try left and a run that is committed already is not written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfledger import fixed_values as V
from shelfledger.functions import calendar as cal
from shelfledger.functions import text as T
from shelfledger.operators.audit import count_if
from shelfledger.operators.catalog import last_write
from shelfledger.operators.history import SERIES, week_cells
from shelfledger.operators.quality import duplicates, enforce, issue_counters, judged_counters, row_counters

WEEKLY_KEY = ["chain", "sku", "year", "week"]


def weekly_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows win per (chain, sku, ISO year, week); all others stay."""
    return last_write([existing, incoming], WEEKLY_KEY)


def touched_weeks(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    weeks = F.broadcast(incoming.select("year", "week").distinct())  # one row a week; dealt by week, a task would read a week's whole history
    return existing.join(weeks, ["year", "week"], "left_semi")


def write_weekly(existing: DataFrame, incoming: DataFrame, path: str) -> None:
    """Upsert and replace only the (year, week) partitions the run touches."""
    (weekly_upsert(touched_weeks(existing, incoming), incoming).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", "week").parquet(path))


def history_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows with the stamp of their run: capture time, local business day, Monday of its week.

    One header per run; a hot run is split by the adaptive skew join.
    """
    stamped = headers.select("run_id", "chain", F.col("completed_at").alias("captured_at"))
    out = rows.join(stamped, "run_id")
    day = cal.business_date(F.col("captured_at"))
    return out.withColumn("business_date", day).withColumn("week_start", cal.monday(F.col("business_date")))


def write_parts(rows: DataFrame, path: str, *parts: str) -> None:
    """Replace exactly the partitions that ``rows`` has.

    Rows are rebalanced by partition: small ones share a task, one that holds a third of all rows is written by as many as its size needs.
    """
    rows.hint("rebalance", *parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, without rows before it is first written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_history(rows: DataFrame, path: str) -> None:
    """Add a run's rows (with ``run_id``); written again, the run replaces itself."""
    write_parts(rows.withColumn("run", F.col("run_id")), path, "week_start", "chain", "run")


def committed(spark: SparkSession, run_id: str, path: str) -> bool:
    """Whether the header table at ``path`` knows the run."""
    try:
        return not spark.read.parquet(path).filter(F.col("run_id") == run_id).isEmpty()
    except Exception as problem:  # before the first run there is no table
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return False


def issue_rows(issues: DataFrame) -> DataFrame:
    return issues.na.fill("", ["sku", "product_name", "category", "brand", "error_kind"])


def gathered(seen: Observation, *names: str) -> dict[str, int]:
    """Counters of a finished write; all zero where the optimizer knew that there was nothing to write and dropped them."""
    try:
        return seen.get
    except Py4JJavaError as problem:
        if "toPyRow" not in str(problem):
            raise
        return dict.fromkeys(names, 0)


def commit_run(spark: SparkSession, rows: DataFrame, issues: DataFrame, header: dict, paths: dict[str, str]) -> None:
    """Write a chain's history and issues, judge the run by counters gathered while they were written, then write its weekly rows and,
    last, the header; a known run is left as it is.

    Rows and issues are computed once.  A run that fails leaves partitions of its own without a header, which readers don't see and its
    next try replaces.
    """
    if committed(spark, header["run_id"], paths["runs"]):
        return
    stamp = lambda df: df.withColumns({"run_id": F.lit(header["run_id"]), "captured_at": F.lit(header["completed_at"])
                                       .cast("timestamp_ntz")})
    dated = lambda df: df.withColumn("business_date", cal.business_date(F.col("captured_at"))).withColumn(
        "week_start", cal.monday(F.col("business_date")))
    whole, seen_rows, seen_issues = dated(stamp(rows)), Observation(), Observation()
    append_history(whole.observe(seen_rows, *row_counters(header["chain"])), paths["history"])
    append_history(dated(stamp(issue_rows(issues))).observe(seen_issues, *issue_counters(header["chain"])), paths["issues"])
    counters = {**gathered(seen_rows, "row_count", "other_chain", "bad_price", "bad_status"), **gathered(seen_issues, "issue_count", "other_chain_issues")}
    names = ", ".join(f"{n} bigint" for n in counters)
    enforce(judged_counters(spark.createDataFrame([tuple(counters.values())], names), header["year"], header["week"], header["expected_count"]))
    written = read_or_empty(spark, paths["history"], whole.withColumn("run", F.col("run_id")).schema).filter(F.col("run") == header["run_id"])
    enforce(duplicates(written, SERIES).agg(F.count(F.lit(1)).alias("shared_sku")))
    weekly = written.select(*rows.columns, "run_id", "captured_at").withColumns({"year": F.lit(header["year"]), "week": F.lit(header["week"])})
    write_weekly(read_or_empty(spark, paths["weekly"], weekly.schema), weekly, paths["weekly"])
    head = spark.createDataFrame([(counters["row_count"],)], "product_count bigint")
    write_parts(head.select("product_count", *(F.lit(v).alias(k) for k, v in header.items())).withColumn("run", F.col("run_id")), paths["runs"], "run")


def catalog_publish_gate(rows: DataFrame, keys: Sequence[str] = ("chain",)) -> DataFrame:
    """Counters per chain; publishing needs ready links, and https links unique within the run."""
    links = rows.groupBy(*keys, "source_url").agg(F.count(F.lit(1)).alias("_n"), count_if(
        F.col("status") == "ready").alias("_ready"), count_if(~F.col("status").isin("ready", "review")).alias("_odd"))
    return links.groupBy(*keys).agg(
        F.sum("_n").alias("candidate_count"), F.sum("_ready").alias("ready_count"), F.sum("_odd").alias("bad_status"),
        count_if(F.col("_n") > 1).alias("repeated_links"),
        count_if(~F.startswith("source_url", F.lit("https://"))).alias("insecure_links"))


def publish_catalog(rows: DataFrame, path: str) -> None:
    """Write a run's catalog into its ``run_id`` partition; a repeated write replaces it with the same rows."""
    gate = catalog_publish_gate(rows).agg(
        F.count(F.lit(1)).alias("chains"), count_if(F.col("ready_count") == 0).alias("no_ready"),
        F.sum("bad_status").alias("bad_status"), F.sum("repeated_links").alias("repeated"),
        F.sum("insecure_links").alias("insecure"))
    enforce(gate.withColumn("not_one_chain", (F.col("chains") != 1).cast("bigint")), ["chains"])
    write_parts(rows, path, "run_id")


def replace_days(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Snapshot after publishing: (day, chain) groups present in ``incoming`` are replaced, other days untouched."""
    keys = ["business_date", "chain"]
    return existing.join(incoming.select(keys).distinct(), keys, "left_anti").unionByName(incoming)


def publish_snapshot(rows: DataFrame, path: str) -> None:
    """Replace exactly the (day, chain) partitions of ``rows``.  Rows are stored flat, never as one nested payload."""
    write_parts(rows, path, "business_date", "chain")


def import_gate(rows: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Judge past observations per (chain, day): bad instants and days that already have rows refuse the whole day."""
    keys = ["chain", "business_date"]
    time = F.col("observed_at")
    late = now + F.expr(f"INTERVAL '{V.FUTURE_TOLERANCE_MINUTES}' MINUTE")
    bad = time.isNull() | (time > late) | (cal.business_date(time) != F.col("business_date"))
    days = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), count_if(bad).alias("bad_time"))
    taken = history.select(*keys).distinct().withColumn("_taken", F.lit(True))
    verdict = F.when(F.col("_taken"), "has_history").when(F.col("bad_time") > 0, "bad_time").otherwise("accepted")
    return days.join(taken, keys, "left").withColumn("verdict", verdict).drop("_taken")


def import_history(rows: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """Rows of accepted days, at their own times."""
    keys = ["chain", "business_date"]
    days = import_gate(rows, history, now).filter("verdict = 'accepted'").select(keys)  # one row per chain and day: the rows stay where they are
    return rows.join(F.broadcast(days), keys, "left_semi")


# --- flat exports ----------------------------------------------------------------------------------------------------


def flat_prices(history: DataFrame) -> DataFrame:
    """Per (week, chain, sku): fiscal week, seven prices and the newest record's details."""
    cells = week_cells(history, ["promo_price", "original_price", "promo_text", "product_name", "source_url", "observed_at"])
    seen = F.filter("days", lambda d: d.isNotNull())
    last = F.element_at(seen, -1)
    return cells.select(
        cal.fiscal_label(F.col("week_start")).alias("fiscal_week"), "week_start", *SERIES,
        *(F.get("days", F.lit(i))["promo_price"].alias(f"price{i + 1}") for i in range(7)),
        *(last[c].alias(c) for c in ("product_name", "original_price", "promo_text", "source_url", "observed_at")),
        T.status_of(last["promo_text"]).alias("status"))


def flat_statuses(history: DataFrame) -> DataFrame:
    """Per (week, chain, sku): the status of each day, "price seen" or "no data"."""
    cells = week_cells(history, ["promo_text"])

    def shown(i: int) -> Column:
        day = F.get("days", F.lit(i))
        status = T.status_of(day["promo_text"])
        return F.when(day.isNull(), V.NO_DATA).when(status != "", status).otherwise(V.PRICE_SEEN)
    return cells.select("week_start", *SERIES, *(shown(i).alias(f"status{i + 1}") for i in range(7)))


def flat_links(catalog: DataFrame) -> DataFrame:
    state = F.when(F.col("status") == "ready", "Đọc được giá").otherwise(
        F.concat(F.lit("Cần kiểm tra: "), F.coalesce("reason", F.lit(""))))
    return catalog.select("chain", "category", "brand", "product_name", "sku", "source_url", state.alias("state"), "reason",
                          F.array_join("listing_urls", "\n").alias("listing_urls"))


def export(df: DataFrame, path: str, form: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)
