"""Derived tables kept up to date: which keys have changed, and the rewrite of the partitions that hold them.

An input is fingerprinted by buckets of its key: number of rows and sum of row hashes. Buckets whose fingerprints differ hold
the keys that may have changed; only those keys are derived anew, whatever the kind of the change.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage
from tidemark.sources import files

BUCKETS = 1 << 16
PART = "_part"


def key_bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS).cast("long")).cast("int")


def fingerprints(rows: DataFrame, key: Column) -> DataFrame:
    """(bucket, n, h) of a table: at most BUCKETS rows, from one partial aggregate over its scan."""
    whole = F.xxhash64(*rows.columns).cast("decimal(38,0)")
    return rows.groupBy(key_bucket(key).alias("bucket")).agg(F.count("*").alias("n"), F.sum(whole).alias("h"))


def changed_buckets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Buckets that one of both fingerprints has differently."""
    b = before.select("bucket", F.struct("n", "h").alias("b"))
    return b.join(after.select("bucket", F.struct("n", "h").alias("a")), "bucket", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("bucket")


def of_buckets(rows: DataFrame, key: Column, buckets: DataFrame) -> DataFrame:
    """Rows of the buckets; there are at most BUCKETS, so they are sent to every task."""
    return rows.withColumn("_bucket", key_bucket(key)).join(F.broadcast(buckets.withColumnRenamed("bucket", "_bucket")), "_bucket", "left_semi").drop("_bucket")


def row_changes(before: DataFrame, after: DataFrame, key: str, also: Sequence[str]) -> DataFrame:
    """Keys whose row differs, with the columns `also` before (old_...) and after (new_...) the change."""
    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col(key), F.xxhash64(*before.columns).alias(f"_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in also])

    both = side(before, "old").join(side(after.select(*before.columns), "new"), key, "full")
    return both.filter(~F.col("_old").eqNullSafe(F.col("_new"))).drop("_old", "_new")


def affected(changes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of some columns before or after the changes; rows with a missing one belong to no group."""
    sides = [changes.select(*[F.col(f"{side}_{c}").alias(c) for c in columns]) for side in ("old", "new")]
    return sides[0].unionByName(sides[1]).dropna().distinct()


def write_parts(rows: DataFrame, path: str, order: Sequence[str], late: Mapping[str, str] | None = None) -> None:
    """Writes a table by its `_part` column, each part sorted; parts that are there already are replaced.

    `late`: columns that others tell, such as hashes of a key, and their expressions; they are computed after the sort, which need not move them.
    """
    late = late or {}
    ordered = rows.drop(*late).sort(PART, *order).withColumns({k: F.expr(x) for k, x in late.items()}).select(*rows.columns)
    (ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(PART).parquet(path))


def replace_rows(spark: SparkSession, path: str, keys: DataFrame, fresh: DataFrame, order: Sequence[str]) -> list:
    """Takes the rows of `keys` out of a table and puts `fresh` in; rewrites the parts that hold either, and returns them.

    `fresh` has the table's columns with `_part`. The new parts are complete in files of their own before any is replaced.
    """
    table = spark.read.parquet(path)
    match = list(keys.columns)
    held = cut_lineage(fresh.select(*table.columns))
    gone = table.join(keys, match, "left_semi").select(PART).distinct()
    parts = sorted(r[PART] for r in gone.unionByName(held.select(PART).distinct()).distinct().collect())  # names of folders
    if not parts:
        return []
    rows = cut_lineage(table.filter(F.col(PART).isin(parts)).join(keys, match, "left_anti").select(*table.columns).unionByName(held))
    full = {r[PART] for r in rows.select(PART).distinct().collect()}
    write_parts(rows, path, order)
    files.remove(spark, [f"{path}/{PART}={p}" for p in parts if p not in full])
    return parts
