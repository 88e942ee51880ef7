"""Selection of quantiles against a sort, however few values a task may order; sketches against exact counts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.sketches import daily_sketches, union_of

QS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def table(seed):
    rng = random.Random(seed)
    rows = [("equal", 7.0)] * 50 + [("one", -3.5), (None, 2.0), (None, 4.0), (None, None), ("none", None)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-12, 15)) for _ in range(900)]
    rows += [("narrow", 1.0 + i * 1e-9) for i in rng.choices(range(4000), k=1500)]
    rows += [("ties", float(rng.randint(0, 9))) for _ in range(700)] + [("negative", -rng.random()) for _ in range(33)]
    return rows


@pytest.mark.parametrize("few", [1, 5, 100, 1 << 16])
def test_selection_equals_sorting(spark, few):
    rows = table(few)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", QS, few=few).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert [got[g][n] for n in QS] == pytest.approx(np.quantile(values, list(QS.values())).tolist(), rel=1e-12, abs=1e-15)
    every = [v for _, v in rows if v is not None]
    one = exact_quantiles(df, [], "v", {"m": 0.5, "t": 0.25}, few=few).collect()
    assert [tuple(r) for r in one] == [pytest.approx(tuple(np.quantile(every, [0.5, 0.25])), rel=1e-12)]
    assert exact_quantiles(df.filter("v is null"), ["g"], "v", QS, few=few).count() == 0


def test_a_group_of_many_values_is_in_no_single_task(spark):
    """The widest group of the last step holds no more than the values that a task may order."""
    df = spark.range(300_000).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 300_000).cast("double").alias("v"))
    found = exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p99": 0.99}, few=500).first()
    assert found["p50"] == 149_999.5 and found["p99"] == pytest.approx(0.99 * 299_999)


def test_sketches_merge(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 10).alias("day"), (F.col("id") % 20_000).alias("k"))
    stored = daily_sketches(rows, ["g"], "day", "k")
    assert stored.count() == 30
    for some, exact in ((stored, rows), (stored.filter("day < 4"), rows.filter("day < 4"))):
        want = {r["g"]: (r["n"], r["rows"]) for r in exact.groupBy("g").agg(F.count_distinct("k").alias("n"), F.count("*").alias("rows")).collect()}
        got = {r["g"]: (r["estimate"], r["rows"]) for r in union_of(some, ["g"]).collect()}
        assert all(abs(got[g][0] - n) <= 0.01 * n and got[g][1] == total for g, (n, total) in want.items())
