"""What micro-batches have written, kept as a table of few folders.

Each batch writes a folder of its own.  After every ``FAN`` batches their folders are merged into one of the next level, after ``FAN`` of those
into one above, and so on, so a table of n batches is read from at most ``FAN - 1`` folders per level, log n of them, and a row is
rewritten once per level.  The folders that make up the table follow from the number of batches alone.  A repeated batch writes the
same folders again; what a merge replaces is removed one merge later, so neither a repeated batch nor a reader that has just listed the
folders misses anything.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

FAN = 16
BATCH = "batch"


@dataclass(frozen=True)
class Batches:
    """The table at ``path``; ``merge`` reduces rows of several batches (column ``batch``) to those that count."""

    path: str
    merge: Callable[[DataFrame], DataFrame]
    partitions: tuple[str, ...] = ()
    fan: int = FAN

    def _folder(self, level: int, start: int) -> str:
        return f"{self.path}/level={level}/from={start}"

    def _files(self, spark: SparkSession, folder: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def written(self, spark: SparkSession) -> int:
        """How many batches there are: one more than the newest batch's number."""
        files, path = self._files(spark, f"{self.path}/level=0")
        if not files.exists(path):
            return 0
        starts = [int(s.getPath().getName().removeprefix("from=")) for s in files.listStatus(path)]
        return max(starts, default=-1) + 1

    def folders(self, batches: int) -> list[str]:
        """The folders that hold the first ``batches`` batches, largest first."""
        level = 0
        while self.fan ** (level + 1) <= batches:
            level += 1
        out, at = [], 0
        for k in range(level, -1, -1):
            while at + self.fan ** k <= batches:
                out.append(self._folder(k, at))
                at += self.fan ** k
        return out

    def read(self, spark: SparkSession, schema: StructType, batches: int | None = None) -> DataFrame:
        """All rows of the first ``batches`` batches (all, if not given), with their ``batch``; not merged."""
        known = self.written(spark) if batches is None else batches
        schema = StructType([f for f in schema.fields if f.name != BATCH] + [StructField(BATCH, LongType())])
        return self._read(spark, schema, self.folders(known)) if known else spark.createDataFrame([], schema)

    def _read(self, spark: SparkSession, schema: StructType, folders: list[str]) -> DataFrame:
        return spark.read.schema(schema).option("basePath", self.path).parquet(*folders).select(schema.names)

    def _write(self, rows: DataFrame, level: int, start: int) -> None:
        if self.partitions:  # else each task would write a file into each partition
            rows = rows.hint("rebalance", *self.partitions)
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*self.partitions) if self.partitions else writer).parquet(self._folder(level, start))

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Write a batch, and what it completes on the levels above."""
        spark = rows.sparkSession
        rows = rows.withColumn(BATCH, F.lit(batch_id).cast("bigint"))
        self._write(rows, 0, batch_id)
        level, size = 1, self.fan
        while (batch_id + 1) % size == 0:
            start, step = batch_id + 1 - size, size // self.fan
            parts = [self._folder(level - 1, start + i * step) for i in range(self.fan)]
            self._write(self.merge(self._read(spark, rows.schema, parts)), level, start)
            for i in range(self.fan if start >= size else 0):
                files, path = self._files(spark, self._folder(level - 1, start - size + i * step))
                files.delete(path, True)
            level, size = level + 1, size * self.fan
