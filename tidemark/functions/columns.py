"""Small column helpers shared by all operators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Money is summed as an exact decimal and leaves the engine as a double."""
    return col(c).cast("double")


def rounded(c: Column | str, digits: int) -> Column:
    """SQL rounding (half up) on the decimal image of a double."""
    return F.round(col(c).cast("decimal(38,12)"), digits).cast("double")


def half_even(c: Column | str, digits: int) -> Column:
    """Banker's rounding of a double, on its exact binary value.

    The product with the scale is itself rounded, so where it falls on a half its error decides; the error is exact,
    from both factors split into halves of their digits.
    """
    scale = float(10**digits)
    split = 134217729.0  # 2^27 + 1
    high = scale * split - (scale * split - scale)

    def nearest(x: Column) -> Column:
        product = x * scale
        whole = F.rint(product)
        x_high = x * split - (x * split - x)
        error = ((x_high * high - product) + x_high * (scale - high) + (x - x_high) * high) + (x - x_high) * (scale - high)
        over = product - whole
        settled = (F.when((over == 0.5) & (error > 0), whole + 1.0).when((over == -0.5) & (error < 0), whole - 1.0).otherwise(whole))
        # a double of this size has no digits to round, and the split would overflow
        return F.when(F.abs(product) >= 4503599627370496.0, x).otherwise(settled / scale)

    return F.get(F.transform(F.array(col(c).cast("double")), nearest), F.lit(0))


def half_even_exact(c: Column | str, digits: int) -> Column:
    """Banker's rounding of an exact decimal."""
    return F.bround(col(c).cast("decimal(38,12)"), digits).cast("double")


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as a double, NULL when the denominator is zero."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def iso(c: Column | str) -> Column:
    """Timestamp text with microseconds, the same in every engine."""
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Exact elapsed seconds (microsecond resolution) as a double."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))).cast("double") / F.lit(1e6)


def at(value: datetime) -> Column:
    """Literal UTC instant."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def seconds_before(c: Column, seconds: int) -> Column:
    return c - F.expr(f"INTERVAL '{int(seconds)}' SECOND")


def settle(df: DataFrame, *columns: Column) -> DataFrame:
    """Append columns that are evaluated once per row.

    A projection would be inlined into every later filter and column that mentions it; a generator is not, so
    long chains of rules stay linear in plan size. One row in gives one row out. The columns should read top-level
    columns only: fields of a struct are flattened first, as the optimizer rewrites field access under generators.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*columns))))


def flatten(df: DataFrame, struct: str, names: list[str], prefix: str) -> DataFrame:
    """Replace a struct by some of its fields, as top-level columns with a prefix."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != struct],
                     *[F.col(f"`{struct}`.`{n}`").alias(f"{prefix}{n}") for n in names])
