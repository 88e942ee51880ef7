"""Keys, fingerprints, ids, check digits, ordered arithmetic."""

import hashlib
import json
import random
import statistics
import uuid
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import checkdigits as k
from tidemark.functions.identity import URL_NAMESPACE, hash_diff, json_number, json_object, json_text, uuid5
from tidemark.operators.compare import numbered, same_order, same_rows
from tidemark.operators.ordered import previous_in_key
from tidemark.operators.quantiles import exact_quantiles


def test_uuid5_equals_the_standard_library(spark):
    rows = [(f"ORD-{i}\"x\\", i) for i in range(40)]
    df = spark.createDataFrame(rows, "entity string, pos long")
    name = json_object({"entity_id": json_text(F.col("entity")), "position": json_object({"lsn": json_number(F.col("pos")), "tx_id": json_number(F.lit(None))})})
    got = {r["entity"]: r["id"] for r in df.select("entity", uuid5(URL_NAMESPACE, name).alias("id")).collect()}
    for entity, pos in rows:
        text = json.dumps({"entity_id": entity, "position": {"lsn": pos, "tx_id": None}}, sort_keys=True)
        assert got[entity] == str(uuid.uuid5(uuid.NAMESPACE_URL, text))


def test_hash_diff_canonical_form(spark):
    df = spark.createDataFrame([(True, Decimal("1.50"), datetime(2024, 1, 2, 3, 4, 5), " a ", None)],
                               "flag boolean, price decimal(6,2), at timestamp, name string, note string")
    want = "at=2024-01-02T03:04:05||flag=true||name=a||note=||price=1.50"
    got = df.select(hash_diff(df, ["price", "note", "name", "flag", "at"]).alias("h")).first()["h"]
    assert got == hashlib.md5(want.encode()).hexdigest()


def test_null_does_not_shift_neighbours(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    assert df.select(hash_diff(df, ["x", "y", "z"]).alias("h")).distinct().count() == 2


def test_check_digits(spark):
    rows = [("4006381333931", "7707083893"), ("4006381333932", "7707083890"), ("400638133393", "77070838931"), ("400638133393x", None), (None, "7830002293")]
    df = spark.createDataFrame(rows, "gtin string, inn string")
    got = [tuple(r) for r in df.select(k.valid_gtin13(F.col("gtin")), k.valid_gln13(F.col("gtin")), k.valid_inn10(F.col("inn"))).collect()]
    assert got == [(True, True, True), (False, False, False), (False, False, False), (False, False, False), (False, False, True)]


def test_previous_row_with_one_hot_key(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 30)}", rng.randint(0, 500), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "key string, t int, id int").repartition(7)
    got = {r["id"]: (r["prev"]["id"] if r["prev"] else None) for r in previous_in_key(df, ["key"], ["t", "id"], ["id"], partitions=9).collect()}
    want, last = {}, {}
    for key, _, i in sorted(rows):
        want[i] = last.get(key)
        last[key] = i
    assert got == want


def test_exact_quantiles_equal_sorted_interpolation(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), float(rng.choice([rng.randint(0, 400), 7]))) for _ in range(3000)] + [("one", 3.5), ("neg", -2.0), ("neg", -1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    for width in (1.0, 25.0, 10_000.0):
        got = {r["g"]: (r["p50"], r["p95"]) for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}, width).collect()}
        for g in ("a", "b", "one", "neg"):
            values = sorted(v for name, v in rows if name == g)
            for q, have in zip((0.5, 0.95), got[g], strict=True):
                pos = q * (len(values) - 1)
                low = int(pos)
                want = values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (pos - low)
                assert abs(have - want) < 1e-9
    assert statistics.median(v for _, v in rows) == exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]


def test_positions_and_comparison(spark):
    df = spark.createDataFrame([(i, i / 3) for i in range(1000)], "a int, b double").repartition(6)
    assert [r["a"] for r in numbered(df, ["a"], 5).orderBy("position").collect()] == list(range(1000))
    near = df.select(F.col("a").alias("x"), (F.col("b") + 1e-9).alias("y"))
    assert same_rows(df, near).first()["match"]
    assert same_rows(df, df.unionAll(df)).first()["match"]
    assert not same_rows(df, df.filter("a < 999")).first()["match"]
    assert not same_rows(df, df.select("a")).first()["match"]
    assert same_order(df, ["a"], near, ["x"]).first()["match"]
    assert same_order(df, ["a"], near, [F.desc("x")]).first()["different"] == 1000
    nan = spark.createDataFrame([(1, float("nan"))], "a int, b double")
    assert same_rows(nan, nan).first()["match"] and same_order(nan, ["a"], nan, ["a"]).first()["match"]


def test_values_of_a_day_apart(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("k", start + timedelta(days=d), d) for d in range(20)], "key string, t timestamp, n int")
    gaps = previous_in_key(df, ["key"], ["t"], ["n"], partitions=3).selectExpr("n - prev.n AS gap").dropna().distinct().collect()
    assert [g["gap"] for g in gaps] == [1]


def test_half_even_is_exact(spark):
    import random

    from tidemark.functions.columns import half_even

    rng = random.Random(5)
    values = [1.115, 2.675, 0.125, 0.375, -0.125, -2.675, 2.5, 3.5, 1e18, -1e300, 0.0, 1e-9, 5e-324, 1.005, 8.345] + [rng.uniform(-1000, 1000) for _ in range(2000)]
    values += [round(rng.uniform(0, 100), 3) for _ in range(3000)] + [k + 0.5**d for k in range(40) for d in range(1, 8)]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    for digits in (2, 3, 4):
        got = [r["r"] for r in df.select(half_even("v", digits).alias("r")).collect()]
        assert got == [round(v, digits) for v in values]


def test_patterns_and_prices(spark):
    from tidemark.functions.checkdigits import valid_gtin13
    from tidemark.functions.rules import EVENT_ID, ORDER_ID

    df = spark.createDataFrame([("4600000000008", "ORD-20240101-0001", "0" * 36)], "g string, o string, e string")
    for end, want in (("", True), ("\n", False), (" ", False)):
        row = df.select(valid_gtin13(F.concat("g", F.lit(end))).alias("g"), F.concat("o", F.lit(end)).rlike(ORDER_ID).alias("o"), F.concat("e", F.lit(end)).rlike(EVENT_ID).alias("e")).first()
        assert tuple(row) == (want, want, want)


def test_comparison_of_huge_numbers(spark):
    from tidemark.operators.compare import same_rows

    a, b = spark.createDataFrame([(1e40,), (2.0,)], "v double"), spark.createDataFrame([(1e40,), (2.0000000001,)], "v double")
    assert same_rows(a, b).first()["match"] and not same_rows(a, b.selectExpr("v * 2 v")).first()["match"]
