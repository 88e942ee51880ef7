"""Equality of two result sets: by position of columns, with a tolerance for numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import cut_lineage

TOLERANCE = 1e-6  # fixed


def _quantised(df: DataFrame, numeric: Sequence[bool]) -> DataFrame:
    out = []
    for i, (f, number) in enumerate(zip(df.schema.fields, numeric, strict=True)):
        c = F.col(f"`{f.name}`")
        if number:
            c = c.cast("double")
            c = F.when(F.isnan(c), F.lit("NaN")).otherwise(F.coalesce(F.round(c / TOLERANCE).try_cast("decimal(38,0)").cast("string"), c.cast("string")))
        elif isinstance(f.dataType, T.BinaryType):
            c = F.hex(c)
        else:
            c = c.cast("string")
        out.append(c.alias(f"c{i}"))
    return df.select(*out)


def _numeric(left: DataFrame, right: DataFrame) -> list[bool]:
    real = (T.DoubleType, T.FloatType, T.DecimalType)
    return [isinstance(a.dataType, real) or isinstance(b.dataType, real)
            for a, b in zip(left.schema.fields, right.schema.fields, strict=True)]


def same_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: match, and how many distinct rows only one side has. Duplicates and order do not count."""
    if len(left.columns) != len(right.columns):
        return left.sparkSession.range(1).select(F.lit(False).alias("match"), F.lit(None).cast("long").alias("left_only"),
                                                 F.lit(None).cast("long").alias("right_only"))
    numeric = _numeric(left, right)
    sides = _quantised(left, numeric).withColumn("_s", F.lit(1)).unionByName(_quantised(right, numeric).withColumn("_s", F.lit(2)))
    # bit sum per distinct row: 1 left only, 2 right only, 3 both
    marks = sides.groupBy(*[c for c in sides.columns if c != "_s"]).agg(F.bit_or("_s").alias("m"))
    one = marks.agg(F.count_if(F.col("m") == 1).alias("left_only"), F.count_if(F.col("m") == 2).alias("right_only"))
    return one.select(((F.col("left_only") == 0) & (F.col("right_only") == 0)).alias("match"), "left_only", "right_only")


def numbered(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Append the global position (from 0) in an order, without one task sorting everything.

    Rows are placed by range and the placement is checkpointed; positions are partition offsets plus the place
    inside the partition. The order should be unique.
    """
    from pyspark.sql import Window

    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))  # one row per partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (placed.withColumn("_i", inside).join(F.broadcast(offsets), "_part")
            .withColumn("position", F.col("_offset") + F.col("_i")).drop("_part", "_i", "_offset"))


def same_order(left: DataFrame, left_order: Sequence[str], right: DataFrame, right_order: Sequence[str]) -> DataFrame:
    """One row: match, and how many positions differ when both sides are put in their order."""
    numeric = _numeric(left, right)

    def side(df, order):
        return _positions(numbered(df, order), df.columns)

    a, b = side(left, left_order), side(right, right_order)
    joined = a.alias("a").join(b.alias("b"), F.col("a.position") == F.col("b.position"), "full_outer")
    equal: Column = F.col("a.position").isNotNull() & F.col("b.position").isNotNull()
    for i, number in enumerate(numeric):
        x, y = F.col(f"a.c{i}"), F.col(f"b.c{i}")
        if number:
            x, y = x.cast("double"), y.cast("double")
            close = (F.abs(x - y) <= TOLERANCE) | (F.isnan(x) & F.isnan(y))
            equal = equal & F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(close)
        else:
            equal = equal & x.cast("string").eqNullSafe(y.cast("string"))
    return joined.agg(F.count_if(~equal).alias("different")).select((F.col("different") == 0).alias("match"), "different")


def _positions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select("position", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
