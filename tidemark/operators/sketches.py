"""Distinct counts from mergeable sketches: one for each group and day, made once and united at every read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG_REGISTERS = 16  # 65,536 registers: an error of about 0.3 percent at one standard deviation


def daily_sketches(rows: DataFrame, by: Sequence[str], day: str, value: str, log_registers: int = LOG_REGISTERS) -> DataFrame:
    """(by, day, sketch, rows): sketches are merged inside tasks before the shuffle, so a hot group moves no rows."""
    return rows.groupBy(*by, day).agg(F.hll_sketch_agg(F.col(value), F.lit(log_registers)).alias("sketch"), F.count("*").alias("rows"))


def union_of(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, estimate, rows) over all sketches of a group; reads sketches only, whatever number of rows they stand for."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"), F.sum("rows").alias("rows"))
