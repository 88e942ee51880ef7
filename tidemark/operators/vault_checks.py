"""Reconciliations, distribution checks and data tests; each is a row (name, passed, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checkdigits import eaeu_prefix, valid_gtin13
from tidemark.functions.columns import ratio


def check_row(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    """A check over one aggregated row."""
    return df.select(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail"))


def stack(checks: Sequence[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def row_count(df: DataFrame, name: str, expected: DataFrame) -> DataFrame:
    """Rows against the rows they were built from."""
    got = df.agg(F.count("*").alias("got")).withColumn("want", F.lit(expected.agg(F.count("*").alias("n")).scalar()))
    return check_row(got, f"rowcount:{name}", F.col("got") == F.col("want"),
                     F.concat(F.lit("expected "), F.col("want").cast("string"), F.lit(", got "), F.col("got").cast("string")))


def mix(df: DataFrame, name: str, column: str, weight: Column, bands: dict[str, tuple[float, float]]) -> DataFrame:
    """Share of each value of a column, by count or by a summed weight, inside its band."""
    shares = df.agg(*[ratio(F.sum(F.when(F.col(column) == v, weight)), F.sum(weight)).alias(f"s_{i}")
                      for i, v in enumerate(bands)])
    values = [F.coalesce(F.col(f"s_{i}"), F.lit(0.0)) for i in range(len(bands))]
    ok = F.lit(True)
    for value, (low, high) in zip(values, bands.values(), strict=True):
        ok = ok & value.between(low, high)
    detail = F.concat_ws(" ", *[F.concat(F.lit(f"{v}="), F.format_string("%.4f", s)) for v, s in zip(bands, values, strict=True)])
    return check_row(shares, name, ok, detail)


def average_bands(df: DataFrame, name: str, by: str, value: str, bands: dict[str, tuple[float, float]],
                  hole: tuple[float, float]) -> DataFrame:
    """Average per group inside its band, and no group's average inside the hole between the two modes."""
    per = df.groupBy(by).agg(ratio(F.sum(value), F.count(value)).alias("a"))
    one = per.agg(*[F.max(F.when(F.col(by) == g, F.col("a"))).alias(f"a_{i}") for i, g in enumerate(bands)],
                  F.count_if((F.col("a") > hole[0]) & (F.col("a") < hole[1])).alias("inside"))
    ok = F.col("inside") == 0
    for i, (low, high) in enumerate(bands.values()):
        ok = ok & F.coalesce(F.col(f"a_{i}"), F.lit(0.0)).between(low, high)
    detail = F.concat_ws(" ", *[F.concat(F.lit(f"{g}="), F.format_string("%.2f", F.col(f"a_{i}"))) for i, g in enumerate(bands)])
    return check_row(one, name, ok, detail)


def gtin_scan(df: DataFrame, column: str = "gs1_gtin") -> DataFrame:
    """Every code valid and in the prefix range: a full scan."""
    bad = ~(valid_gtin13(F.col(column)) & eaeu_prefix(F.col(column)))
    one = df.agg(F.count_if(bad).alias("bad"), F.count("*").alias("n"))
    return check_row(one, "gtin validity", F.col("bad") == 0,
                     F.concat(F.col("bad").cast("string"), F.lit(" invalid of "), F.col("n").cast("string")))


def violations(df: DataFrame, name: str, condition: Column) -> DataFrame:
    """Passes when no row violates; NULL conditions are not violations."""
    one = df.agg(F.count_if(condition).alias("bad"), F.count("*").alias("n"))
    return check_row(one, name, F.col("bad") == 0,
                     F.concat(F.col("bad").cast("string"), F.lit(" of "), F.col("n").cast("string")))


def data_tests(df: DataFrame, table: str, not_null: Sequence[str], accepted: dict[str, Sequence[str]]) -> DataFrame:
    """not_null and accepted_values expectations of a table in one scan."""
    tests = [(f"{table}.{c} not_null", F.col(c).isNull()) for c in not_null]
    tests += [(f"{table}.{c} accepted_values", ~F.col(c).isin(*v)) for c, v in accepted.items()]
    wide = df.agg(*[F.count_if(bad).alias(f"t{i}") for i, (_, bad) in enumerate(tests)])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), (F.col(f"t{i}") == 0).alias("passed"),
                                        F.concat(F.col(f"t{i}").cast("string"), F.lit(" failing")).alias("detail"))
                               for i, (name, _) in enumerate(tests)]))
    return wide.select(rows.alias("r")).select("r.*")
