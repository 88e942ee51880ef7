"""Validation, enrichment, change records, tenancy."""

import json
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import cdc, enrich
from tidemark.operators.tenancy import TenantScopeError, tenant_scope
from tidemark.schemas import EVENT_DDL, conform
from tidemark.streaming import ingest, sources

NOW = datetime(2024, 5, 1, 12)


def order(**change):
    base = {"event_id": str(uuid.uuid4()), "event_type": "order.created", "timestamp": "2024-05-01T11:59:58+00:00", "source": "web", "tenant": "t1",
            "order_id": "ORD-20240501-1001", "user_id": "USR-1", "status": "pending", "total_amount": "120.00", "currency": "RUB",
            "items": [{"product_id": "P1", "quantity": 2, "unit_price": "50.00"}, {"product_id": "P2", "quantity": 1, "unit_price": "20.00"}]}
    return {**base, **change}


def payment(**change):
    return {"event_id": str(uuid.uuid4()), "event_type": "payment.failed", "timestamp": "2024-05-01T11:00:00", "source": "pay", "payment_id": "p", "order_id": "ORD-20240501-1001",
            "user_id": "u", "amount": "10", "method": "card", "status": "failed", "failure_reason": "no funds", **change}


def judged(spark, records, as_of=NOW, **kw):
    df = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r), "events.raw") for r in records], "value string, topic string")
    return ingest.judge(ingest.to_events(ingest.decode_envelope(df), **kw), as_of)


def stages(spark, records, **kw):
    rows = judged(spark, records, **kw).select("value", "stage", "error").collect()
    by = {r["value"]: (r["stage"], r["error"]) for r in rows}
    return [by[r if isinstance(r, str) else json.dumps(r)] for r in records]


CASES = [
    (order(), None, None),
    ("{broken", "parse", "not a JSON object"),
    ("[1, 2]", "parse", "not a JSON object"),
    (order(event_id="nope"), "schema_validation", "event_id"),
    (order(event_type="order.lost"), "schema_validation", "event_type"),
    (order(event_type="refund.made"), "schema_validation", "unknown_event_type"),
    (order(timestamp="2024-05-01T12:05:01"), "schema_validation", "timestamp"),
    (order(timestamp="2024-05-01T12:05:00"), None, None),
    (order(order_id="ORD-1"), "schema_validation", "order_id"),
    (order(items=[]), "schema_validation", "items,total_mismatch"),
    (order(total_amount="120.02"), "schema_validation", "total_mismatch"),
    (order(total_amount="120.01"), None, None),
    (order(currency="CNY"), "schema_validation", "currency"),
    (order(items=[{"product_id": "P", "quantity": 1001, "unit_price": "0.1"}], total_amount="100.10"), "schema_validation", "items.quantity"),
    (order(items=[{"product_id": "P", "quantity": 1, "unit_price": "0.105"}], total_amount="0.105"), "schema_validation", "items.unit_price"),
    (payment(), None, None),
    (payment(amount="0.40"), "semantic_validation", "payment_min_amount"),
    (payment(amount="50000.01"), None, None),  # a warning passes
    (payment(failure_reason=None), None, None),
    (payment(method="cash"), "schema_validation", "method"),
    (payment(amount="0"), "schema_validation", "amount"),
]


def test_stage_and_error(spark):
    assert stages(spark, [record for record, _, _ in CASES]) == [(stage, error) for _, stage, error in CASES]


def test_dead_letter_keeps_the_raw_record(spark):
    raw = "{" + "x" * 5000
    dead = ingest.dead_letters(judged(spark, [raw, order(event_id="bad")])).collect()
    by = {d["stage"]: d for d in dead}
    assert by["parse"]["raw"] == raw and by["parse"]["event_id"] is None
    assert by["schema_validation"]["event_id"] == "bad" and by["schema_validation"]["raw"] is None


def test_envelope_versions(spark):
    inner = json.dumps(order())
    good = {ingest.ENVELOPE_KEY: {"version": 1, "topic": "orders.raw"}, "value": inner}
    old = {ingest.ENVELOPE_KEY: {"version": 2}, "value": inner}
    hollow = {ingest.ENVELOPE_KEY: {"version": 1}, "value": "[]"}
    assert [s for s, _ in stages(spark, [good, old, hollow])] == [None, "parse", "parse"]
    assert judged(spark, [good]).first()["topic"] == "orders.raw"


def test_change_record_becomes_an_event(spark):
    change = {"before": None, "after": {"order_id": "ORD-1", "user_id": "u1", "status": "pending", "total_amount": "5"}, "op": "c", "ts_ms": 1714560000000,
              "source": {"connector": "postgresql", "db": "shop", "schema": "public", "table": "orders_v2", "lsn": 7, "txId": 9, "snapshot": "false"}}
    row = judged(spark, [change]).first()
    key = {"entity_id": "ORD-1", "operation": "insert", "position": {"lsn": 7, "tx_id": 9}, "source": "postgres_cdc", "table": "orders_v2", "tenant": "default"}
    assert row["event_id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, json.dumps(key, sort_keys=True)))
    assert (row["stage"], row["event_type"], row["order_id"], row["user_id"], row["tenant"]) == (None, "order.created", "ORD-1", "u1", "default")
    gone = {**change, "op": "d", "before": change["after"], "after": None}
    assert judged(spark, [gone]).first()["event_type"] == "order.deleted"
    broken = [({**change, "op": "x"}, "unsupported operation"), ({**change, "after": None}, "no row image"),
              ({**change, "source": {**change["source"], "table": "t"}}, "unmapped table"),
              ({**change, "after": {"user_id": "u"}}, "missing key column"), ({**change, "after": {"order_id": "ЗАКАЗ"}}, "non_ascii_key")]
    assert stages(spark, [record for record, _ in broken]) == [("cdc_normalization", why) for _, why in broken]


def test_tenant_resolution(spark):
    entries = [{"connector": "postgresql", "topic_pattern": "cdc.pg.*", "tenant_id": "one"}, {"connector": "postgresql", "topic_pattern": "cdc.*.two", "tenant_id": "two"},
               {"connector": "mysql", "topic_pattern": "my?", "tenant_id": "default"}]
    df = spark.createDataFrame([("postgresql", "cdc.pg.x"), ("postgresql", "cdc.pg.two"), ("postgresql", "other"), ("mysql", "my1"), ("mysql", "cdcxpg.a")], "c string, topic string")
    df = df.select(F.struct(F.col("c").alias("connector")).alias("source"), "topic")
    got = [(r["tenant"], r["tenant_error"]) for r in cdc.resolve_tenants(df, entries).collect()]
    assert got == [("one", None), (None, "ambiguous mapping"), (None, "no mapping"), (None, "production mapping cannot target the default tenant"), (None, "no mapping")]
    assert [r["tenant"] for r in cdc.resolve_tenants(df, entries, "demo").collect()] == ["one", None, "default", "default", "default"]


def test_enrichment_edges(spark):
    df = conform(spark.createDataFrame([("49.99",), ("50",), ("199.99",), ("200",), ("1000",)], "total_amount string"), EVENT_DDL)
    got = [(r["d"]["order_size_bucket"], r["d"]["avg_item_price"], r["d"]["item_count"]) for r in df.select(enrich.order_fields().alias("d")).collect()]
    assert got == [("small", 0.0, 0), ("medium", 0.0, 0), ("medium", 0.0, 0), ("large", 0.0, 0), ("whale", 0.0, 0)]
    urls = ["/products/1", "/cart", "/checkout", "/search?q", "/", "/x", None]
    got = [r["c"] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(enrich.page_category(F.col("u")).alias("c")).collect()]
    assert got == ["product_detail", "cart", "checkout", "search", "home", "other", "other"]
    pay = conform(spark.createDataFrame([("500", "card", "u"), ("501", "wallet", None), ("201", "bank_transfer", "u")], "amount string, method string, user_id string"), EVENT_DDL)
    got = [(round(r["d"]["risk_score"], 3), r["d"]["risk_level"]) for r in pay.select(enrich.payment_fields().alias("d")).collect()]
    assert got == [(0.2, "medium"), (0.75, "high"), (0.1, "low")]


def test_half_even_average(spark):
    df = conform(spark.createDataFrame([("0.25",), ("0.35",)], "total_amount string"), EVENT_DDL).withColumn(
        "items", F.array(F.struct(F.lit("p").alias("product_id"), F.lit("10").alias("quantity"), F.lit("1").alias("unit_price"))))
    assert [r["p"] for r in df.select(enrich.order_fields()["avg_item_price"].alias("p")).collect()] == [0.02, 0.04]


def test_tenant_scope_fails_closed(spark):
    df = spark.createDataFrame([("default", 1), ("acme", 2)], "tenant_id string, v int")
    assert tenant_scope(df, "acme").collect()[0].asDict() == {"v": 2}
    for bad in (None, "", "a/b", "-x", "x" * 65, 5):
        with pytest.raises(TenantScopeError):
            tenant_scope(df, bad)
    assert tenant_scope(df.filter("tenant_id = 'default'"), None).columns == ["v"]
    with pytest.raises(TenantScopeError):
        tenant_scope(df.select("v"), "acme")


def test_tenants_never_see_each_other(spark):
    import random

    rng = random.Random(9)
    rows = [(rng.choice(["t1", "t2"]), f"id{rng.randint(0, 20)}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "tenant_id string, id string, v int")
    for tenant in ("t1", "t2"):
        assert sorted(r["v"] for r in tenant_scope(df, tenant).collect()) == [v for t, _, v in rows if t == tenant]


def test_topics():
    assert sources.check_topics(["a", " b "]) == ["a", "b"]
    for bad in ([], [" "], ["a", "a"]):
        with pytest.raises(ValueError):
            sources.check_topics(bad)
    assert sources.topic_options(["a", "b"], "h:1")["startingOffsets"] == "earliest"


def test_latency_codes(spark):
    rows = judged(spark, [order(timestamp=(NOW - timedelta(seconds=2)).isoformat()), order(timestamp="never")]).select("timestamp", "pipeline_latency_ms", "latency_code").collect()
    assert {(r["pipeline_latency_ms"], r["latency_code"]) for r in rows} == {(2000, 2000), (None, -1)}
