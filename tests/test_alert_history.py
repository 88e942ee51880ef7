"""Alert histories in segments against one machine, and subscriptions against all pairs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.alerts import STATE_COLUMNS, AlertMachine, alert_states, match_subscriptions, matches, quiet_segments
from tidemark.operators.ordered import latest_before, placed_in_order

T0 = datetime(2024, 1, 1)
DDL = ("alert_id string, tick_at timestamp, triggered boolean, escalation array<struct<level: int, after_minutes: double>>, "
       "flap_enabled boolean, flap_minutes double, flap_max int, cooldown_minutes double")


def histories(seed, n=900):
    rng = random.Random(seed)
    rows = []
    for alert, flap, steps in (("calm", True, [(1, 0.0), (2, 60.0)]), ("wild", True, [(1, 0.0)]), ("plain", False, [(1, 0.0), (2, 30.0), (3, 240.0)])):
        at, on = T0, False
        for _ in range(n):
            at += timedelta(minutes=rng.choice([1, 5, 30, 60, 200]))
            if rng.random() < (0.4 if alert == "wild" else 0.08):
                on = not on
            rows.append((alert, at, on, [{"level": lv, "after_minutes": mi} for lv, mi in steps], flap, 90.0, 3, 30.0))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_segments_equal_one_machine(spark, seed):
    rows = histories(seed)
    want, machines = [], {}
    for alert, at, on, steps, flap, minutes, most, cooldown in rows:
        m = machines.setdefault(alert, AlertMachine({"escalation": steps, "flap_enabled": flap, "flap_minutes": minutes, "flap_max": most, "cooldown_minutes": cooldown}))
        note = m.tick(at, on)
        want.append((alert, at, on, m.state, note, m.level, m.fired_at, len(m.changes)))
    ticks = spark.createDataFrame(rows, DDL).orderBy(F.rand(1)).repartition(3)
    got = [tuple(r) for r in alert_states(ticks).select(*STATE_COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # one alert is many segments
    assert quiet_segments(ticks).filter("alert_id = 'calm'").select("segment").distinct().count() > 10
    assert alert_states(ticks.limit(0)).count() == 0


def test_latest_before_over_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, rng.randint(0, 99)])) for i in range(400)]
    placed = placed_in_order(spark.createDataFrame(rows, "k string, i long, v long").repartition(4), ["k"], ["i"], 7)
    for here in (True, False):
        got = {(r["k"], r["i"]): r["m"] for r in latest_before(placed, ["k"], ["i"], F.col("v"), "m", here).collect()}
        for k, i, _ in rows:
            seen = [v for kk, j, v in rows if kk == k and v is not None and (j < i or here and j == i)]
            assert got[k, i] == (max(seen) if seen else None)


HOOK_DDL = "webhook_id string, tenant_id string, event_types array<string>, entity_ids array<string>, min_amount double"
EVENT_DDL = "tenant_id string, event_id string, event_type string, entity_id string, order_id string, amount double, processed_at timestamp"


@pytest.mark.parametrize("few", [10**6, 0])
def test_matches_equal_all_pairs(spark, few):
    rng = random.Random(7)
    kinds = ["order", "order.status", "order.status.shipped", "order.created", "payment", "pay", "click", "", "order.status.", None]
    ids = ["a", "b", "c", "", "d", None]
    some = lambda values, most: rng.choice([None, [], [rng.choice(values) for _ in range(rng.randint(1, most))]])
    hooks = [(f"h{i}", rng.choice(["t", "t", "u", None]), some(kinds, 4), some(ids, 4), rng.choice([None, None, 50.0])) for i in range(120)]
    events = [(rng.choice(["t", "t", "u", None]), f"e{i}", rng.choice(kinds), rng.choice(ids), rng.choice(ids), rng.choice([None, 10.0, 99.0]), T0) for i in range(150)]
    h, e = spark.createDataFrame(hooks, HOOK_DDL), spark.createDataFrame(events, EVENT_DDL)
    names = ("entity_id", "order_id")
    want = e.alias("e").crossJoin(h.alias("s")).filter((F.col("e.tenant_id") == F.col("s.tenant_id")) & matches(ids=names)).select("s.webhook_id", "e.event_id")
    got = match_subscriptions(e, h, names, salts=5, few=few).select("webhook_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_hooks_of_one_tenant_are_spread(spark):
    hooks = spark.range(2000).select(F.concat(F.lit("h"), "id").alias("webhook_id"), F.lit("t").alias("tenant_id"), F.array(F.lit("order")).alias("event_types"),
                                     F.lit(None).cast("array<string>").alias("entity_ids"), (F.col("id") * 10.0).alias("min_amount"))
    events = spark.range(300).select(F.lit("t").alias("tenant_id"), F.concat(F.lit("e"), "id").alias("event_id"), F.lit("order.created").alias("event_type"),
                                     F.lit("x").alias("entity_id"), (F.col("id") * 1.0).alias("amount"), F.lit(T0).alias("processed_at"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = match_subscriptions(events, hooks, salts=64, few=0)
        per_task = [r["count"] for r in found.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(per_task) == sum(a // 10 + 1 for a in range(300)) and len(per_task) == 4 and max(per_task) < 0.5 * sum(per_task)
