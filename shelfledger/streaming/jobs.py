"""Streaming forms of the history merge, the price alerts and the rule labels.

State is a table, not a per-key Python object: every micro-batch is first reduced to one row per (series, day) with
map-side combine, so a series that dominates a batch is never handled by one task row by row.  A batch writes its own folder and may be
repeated after a failure with the same result; closed batches are merged level by level (``batches``), and readers merge the rest.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from shelfledger.operators.history import FULL_SERIES, SERIES
from shelfledger.operators.latest import first_per_key
from shelfledger.operators.movement import judged_movements
from shelfledger.sources.rules import label_by_brand
from shelfledger.streaming.batches import Batches


def read_stream(spark: SparkSession, folder: str, schema: StructType, files: str | None = None,
                files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _newest(df: DataFrame, keys: list[str]) -> DataFrame:
    """Later instant first; ties go to the later batch, then to the later row."""
    return first_per_key(df, keys, [F.col("observed_at").desc(), F.col("batch").desc(), F.col("seq").desc()])


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    def adaptive(batch: DataFrame, batch_id: int) -> None:
        # A stream's session plans without adaptive execution, but each batch is a job like any other.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        work(batch, batch_id)

    writer = stream.writeStream.foreachBatch(adaptive).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 minute")).start()


def history_batches(path: str) -> Batches:
    return Batches(path, lambda df: _newest(df, [*SERIES, "business_date"]), ("business_date",))


def stream_history(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merge new observations into the per-day history; a late older record never replaces a newer one."""
    store = history_batches(path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.add(store.merge(batch.withColumn("batch", F.lit(batch_id))).drop("batch"), batch_id)
    return _start(stream, merge, checkpoint, once)


def read_history(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The merged history of all batches so far."""
    store = history_batches(path)
    return store.merge(store.read(spark, schema)).drop("batch")


def state_batches(path: str) -> Batches:
    """Within one day the first of two equal instants stays."""
    return Batches(path, lambda df: first_per_key(df, [*FULL_SERIES, "business_date"], [
        F.col("observed_at").desc(), F.col("batch").asc(), F.col("seq").asc()]), ("business_date",))


def alert_batches(path: str) -> Batches:
    """The newest judgement per series and day; one without a movement withdraws what an earlier batch said."""
    return Batches(path, lambda df: first_per_key(df, [*FULL_SERIES, "business_date"], [F.col("batch").desc(), F.col("seq").desc()]))


def days_around(days: Iterable[dt.date]) -> list[dt.date]:
    """The days themselves and those next to them."""
    return sorted({day + dt.timedelta(step) for day in days for step in (-1, 0, 1)})


def stream_alerts(stream: DataFrame, state: str, alerts: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Judge again every day whose movement a batch can change: the days it brings prices for and the days after them.

    Each judged day gets a row; one without a movement has no ``delta`` and withdraws what an earlier batch said.  Only the partitions
    of those days and the days before them are read, so a single late row of last year reads three days.
    """
    keys = [*FULL_SERIES, "business_date"]
    columns = [*keys, "promo_price", "observed_at", "seq"]
    store, judgements = state_batches(state), alert_batches(alerts)

    def emit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        reduced = store.merge(batch.select(*columns).withColumn("batch", F.lit(batch_id))).drop("batch")
        store.add(reduced, batch_id)
        known = store.read(spark, reduced.schema, batch_id + 1)
        now = known.filter(F.col("batch") == batch_id)
        days = days_around(r.business_date for r in now.select("business_date").distinct().collect())  # at most one row a day, from what is written
        last = store.merge(known.filter(F.col("business_date").isin(days)))
        now = now.filter(F.col("business_date").isin(days))
        following = now.select(*FULL_SERIES, F.date_add("business_date", 1).alias("business_date"))
        judged = now.select(keys).unionByName(following).distinct()
        touched = last.join(judged, keys, "left_semi").withColumnRenamed("promo_price", "after_price").drop("batch")
        before = last.select(*FULL_SERIES, F.date_add("business_date", 1).alias("business_date"),
                             F.col("promo_price").alias("before_price"))
        judgements.add(judged_movements(touched.join(before, keys, "left")), batch_id)
    return _start(stream, emit, checkpoint, once)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """The newest judgement per series and day, where it is a movement."""
    store = alert_batches(path)
    folders = store.folders(store.written(spark))
    return store.merge(spark.read.option("basePath", path).parquet(*folders).drop("level", "from")).filter("delta IS NOT NULL")


def stream_labels(stream: DataFrame, index: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Label each batch by the rule index of its brand; a repeated batch replaces its own rows."""
    return _start(stream, lambda batch, batch_id: label_by_brand(batch, index).write.mode("overwrite").parquet(f"{path}/batch={batch_id}"),
                  checkpoint, once)
