"""Table input: Parquet tables by name, and the newest instant of a frame."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")


def latest_instant(df: DataFrame, ts: str) -> datetime | None:
    """The newest event time of a frame: the default `as_of` of every windowed read.

    One row comes back; knowing it as a literal lets the window filter reach the file scan.
    """
    text = df.agg(F.date_format(F.max(ts), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t")).first()["t"]
    return None if text is None else datetime.strptime(text, "%Y-%m-%d %H:%M:%S.%f")
