"""Streaming queries: the whole event table arrives in several files and batches, days out of order; the written result is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfledger.plans.carriers import observation_view, table
from shelfledger.plans.history_queries import BIG, MOVES, text_date
from shelfledger.plans.registry import query
from shelfledger.plans.sink_queries import rule_files
from shelfledger.session import shared_folder
from shelfledger.streaming import jobs as J

FLAT = ["seq", "chain", "sku", "model", "storage", "display_variant", "color", "brand", "product_name", "observed_at",
        "business_date", "promo_price"]


def stream(spark, sf):
    events, path = table(spark, sf, "events"), f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    for part in (2, 0, 1):  # each holds rows of all days
        events.filter(F.col("event_id") % 3 == part).write.mode("append").parquet(path)
    files = len(spark.read.schema(events.schema).parquet(path).inputFiles())  # an arrival of a large table is several files, but one batch
    return observation_view(J.read_stream(spark, path, events.schema, files_per_batch=max(1, -(-files // 3)))).select(*FLAT)


def folders(spark, *names: str) -> list[str]:
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return [f"{base}/{n}" for n in names]


def finish(started) -> None:
    started.awaitTermination()
    if started.exception():
        raise started.exception()


@query("str1_stream_history", """SELECT seq, chain, sku, CAST(business_date AS VARCHAR) AS business_date, promo_price FROM (
 SELECT *, row_number() OVER (PARTITION BY chain, sku, business_date ORDER BY observed_at DESC, seq DESC) AS rn FROM obs) WHERE rn = 1""", "obs")
def _(spark, sf):
    path, checkpoint = folders(spark, "history", "checkpoint")
    rows = stream(spark, sf)
    finish(J.stream_history(rows, path, checkpoint))
    return J.read_history(spark, path, rows.schema).select("seq", "chain", "sku", text_date("business_date"), "promo_price")


@query("str2_stream_alerts", f"""WITH {MOVES} SELECT CAST(business_date AS VARCHAR) AS business_date, chain, sku, color, before_price,
 after_price, delta, {BIG} AS shock FROM moves""", "obs")
def _(spark, sf):
    state, alerts, checkpoint = folders(spark, "state", "alerts", "checkpoint")
    finish(J.stream_alerts(stream(spark, sf), state, alerts, checkpoint))
    return J.read_alerts(spark, alerts).select(text_date("business_date"), "chain", "sku", "color", "before_price",
                                               "after_price", "delta", "shock")


@query("str3_stream_rules", """SELECT seq, CASE WHEN i < 36 AND model <> 'AirPods Max' THEN model END AS label FROM obs""", "obs")
def _(spark, sf):
    path, checkpoint = folders(spark, "labels", "checkpoint")
    finish(J.stream_labels(stream(spark, sf), rule_files(spark), path, checkpoint))
    return spark.read.parquet(path).select("seq", "label")
