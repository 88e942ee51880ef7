"""Previous-row arithmetic that stays balanced when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def placed_in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows by range of keys and order, with the number of their partition as `_part`; the placement is a checkpoint."""
    n = partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_part", F.spark_partition_id()))


def latest_before(placed: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, here: bool) -> DataFrame:
    """Append the greatest `value` among the rows of the key up to each row (`here`) or before it; rows are placed in order.

    A window sees one (partition, key) slice; of the slices before it only their greatest values are needed, one row for each
    partition that a key reaches.
    """
    keys, order = list(keys), list(order)
    upto = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if here else -1)
    slices = placed.groupBy("_part", *keys).agg(F.max(value).alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("_part", *keys, F.max("_most").over(before).alias("_carry")).filter(F.col("_carry").isNotNull())
    null_safe = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = placed.withColumn("_local", F.max(value).over(upto)).alias("l").join(carried.alias("c"), [F.col("l._part") == F.col("c._part"), *null_safe], "left")
    return joined.select(*[F.col(f"l.{c}") for c in placed.columns], F.greatest("l._local", "c._carry").alias(name))


def previous_in_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str],
                    partitions: int | None = None) -> DataFrame:
    """Append `prev`, a struct of `values` of the row before in (keys, order); NULL for the first of a key.

    Rows are range-partitioned on keys and order, so a hot key spreads over many partitions; the placement is
    checkpointed, because a recomputed range sample could place rows differently. Windows then run inside one
    (partition, key) slice. Only the last row of a slice can be the predecessor of a row elsewhere, and only
    keys that cross a partition border need it: at most two such slices per partition.
    """
    keys, order, values = list(keys), list(order), list(values)
    placed = placed_in_order(df, keys, order, partitions)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    local = placed.withColumn("_prev", F.lag(F.struct(*values)).over(inside))
    ends = placed.groupBy("_part", *keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last"))
    # the keys at the two ends of a partition are the only ones that can continue elsewhere
    border = ends.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).filter(F.col("_n") > 1)
    carried = border.select("_part", *keys, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_part")).alias("_carry"))
    null_safe = [F.col(f"l.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = local.alias("l").join(F.broadcast(carried.alias("c")), [F.col("l._part") == F.col("c._part"), *null_safe], "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce("l._prev", "c._carry").alias("prev"))
