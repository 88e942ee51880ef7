"""Exact continuous quantiles by selection: brackets from the data, counted and narrowed until few values are left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

BINS = 1 << 14
FEW = 1 << 16  # different values that one task may put in order


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], few: int = FEW) -> DataFrame:
    """Per group, the linearly interpolated quantiles of a column, as doubles.

    The input is read once, for the number of rows of each (group, value). A quantile needs the values at one or two ranks; each
    rank has a bracket of values, at first those of its whole group. While a bracket has more than `few` different values, they
    are counted in BINS equal steps between its ends, and the step that holds the rank becomes the bracket. So no task sees more
    than the steps of a bracket or `few` values, however many a group has. NULLs are left out.
    """
    by = list(by)
    cells = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n")))
    groups = cells.groupBy(*by).agg(F.sum("_n").alias("_total"), F.count("*").alias("_many"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = []
    for name, q in quantiles.items():
        at = (F.col("_total") - 1) * F.lit(q)
        ranks += [F.struct(F.lit(name).alias("q"), F.lit(is_low).alias("low"), end(at).cast("long").alias("rank"), (at - F.floor(at)).alias("frac")) for end, is_low in ((F.floor, True), (F.ceil, False))]
    wanted = cut_lineage(groups.filter(F.col("_total") > 0).select(*by, F.explode(F.array(*ranks)).alias("t"), "_lo", "_hi", "_many").select(
        *by, "t.*", "_lo", "_hi", "_many", F.lit(0).cast("long").alias("_below")))
    while (wanted.agg(F.max("_many")).first()[0] or 0) > few:
        wanted = cut_lineage(narrowed(cells, wanted, by))
    key = [*by, "_lo", "_hi"]
    upto = Window.partitionBy(*key).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = in_brackets(cells, wanted, by).withColumn("_cum", F.sum("_n").over(upto) + F.col("_below"))
    hits = matched(wanted, ordered.drop("_below"), key).filter((F.col("rank") < F.col("_cum")) & (F.col("rank") >= F.col("_cum") - F.col("_n")))

    def interpolated(name: str) -> Column:
        mine = F.col("q") == name
        low = F.max(F.when(mine & F.col("low"), F.col("_v")))
        high = F.max(F.when(mine & ~F.col("low"), F.col("_v")))
        return low + (high - low) * F.max(F.when(mine, F.col("frac")))

    return hits.groupBy(*by).agg(*[interpolated(n).alias(n) for n in quantiles])


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on columns of one name, NULLs equal; the right ones are dropped."""
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    condition = F.lit(True)
    for c in keys:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, condition).drop(*[f"_r_{c}" for c in keys])


def in_brackets(cells: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """(group, bracket, _below, _v, _n) of the values in each different bracket."""
    brackets = wanted.select(*by, "_lo", "_hi", "_below").distinct()
    if not by:
        # one group: its brackets are at most two for each quantile
        return cells.join(F.broadcast(brackets), (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    return matched(cells, brackets, by).filter((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))


def narrowed(cells: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """`wanted` with the bracket of each rank cut to the step that holds it. Steps keep the order of the values."""
    key = [*by, "_lo", "_hi"]
    span = F.col("_hi") / 2 - F.col("_lo") / 2
    step = F.when(span > 0, F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / span * (BINS - 1))).otherwise(0)
    steps = (in_brackets(cells, wanted, by).groupBy(*key, "_below", step.alias("_step"))
             .agg(F.sum("_n").alias("_rows"), F.count("*").alias("_new_many"), F.min("_v").alias("_new_lo"), F.max("_v").alias("_new_hi")))
    upto = Window.partitionBy(*key).orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.withColumn("_cum", F.sum("_rows").over(upto) + F.col("_below")).withColumn("_new_below", F.col("_cum") - F.col("_rows"))
    hit = matched(wanted.drop("_below", "_many"), steps.drop("_below", "_step"), key).filter((F.col("rank") >= F.col("_new_below")) & (F.col("rank") < F.col("_cum")))
    return hit.select(*by, "q", "low", "rank", "frac", F.col("_new_lo").alias("_lo"), F.col("_new_hi").alias("_hi"), F.col("_new_many").alias("_many"), F.col("_new_below").alias("_below"))
