"""Late rows of a stream, aside from the others: what lies at or behind the watermark of its micro-batch.

The engine only counts the rows it drops. Here the watermark of a batch is kept beside the output: the newest event time of all
batches before it, less the delay. So every batch knows which of its rows are late, also when it is run again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import at
from tidemark.sources import files, lake

KEPT = 16  # notes of older batches are removed


def watermark_before(spark: SparkSession, path: str, batch_id: int, delay_seconds: float) -> tuple[datetime | None, int | None]:
    """The watermark that holds for a batch, in whole milliseconds, and the batch whose note says so; none for the first."""
    notes = [n for n in files.folder_numbers(spark, path, "batch_id") if n < batch_id]
    if not notes:
        return None, None
    row = spark.read.parquet(f"{path}/batch_id={max(notes)}").select(F.date_format("newest", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()
    if row is None or row["t"] is None:
        return None, max(notes)
    newest = datetime.strptime(row["t"], "%Y-%m-%d %H:%M:%S.%f")
    return newest.replace(microsecond=newest.microsecond // 1000 * 1000) - timedelta(seconds=delay_seconds), max(notes)


def late_split(base: str, ts: str = "ts", delay_seconds: float = 10) -> Callable[[DataFrame, int], None]:
    """Sink of every micro-batch: rows ahead of the watermark under `on_time`, the others under `late` with the watermark they missed.

    Rows without a time are on time: nothing tells that they are not. Everything lies under its batch, and a batch that is run
    again replaces what it has written. Both outputs are narrow: no shuffle but that of the write.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, notes = batch.sparkSession, f"{base}/watermarks"
        watermark, last = watermark_before(spark, notes, batch_id, delay_seconds)
        rows = batch.withColumn("batch_id", F.lit(batch_id)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if watermark is None:
                lake.overwrite_partitions(rows, f"{base}/on_time", ["batch_id"])
            else:
                behind = F.coalesce(F.col(ts) <= at(watermark), F.lit(False))
                lake.overwrite_partitions(rows.filter(~behind), f"{base}/on_time", ["batch_id"])
                lake.overwrite_partitions(rows.filter(behind).withColumn("watermark", at(watermark)), f"{base}/late", ["batch_id"])
            newest = rows.agg(F.max(ts).alias("newest"))
            if last is not None:
                newest = newest.unionByName(spark.read.parquet(f"{notes}/batch_id={last}").select("newest")).agg(F.max("newest").alias("newest"))
            # written last: the next batch starts from a complete one
            newest.coalesce(1).write.mode("overwrite").parquet(f"{notes}/batch_id={batch_id}")
            files.remove(spark, [f"{notes}/batch_id={n}" for n in files.folder_numbers(spark, notes, "batch_id") if n < batch_id - KEPT])
        finally:
            rows.unpersist()

    return write


def read_split(spark: SparkSession, base: str, name: str, schema) -> DataFrame:
    """`on_time` or `late` rows so far; an empty frame before the first."""
    path = f"{base}/{name}"
    columns = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), *(["watermark timestamp"] if name == "late" else []), "batch_id bigint"])
    return spark.read.schema(columns).parquet(path) if files.is_folder(spark, path) else spark.createDataFrame([], columns)
