"""Service levels, worklists, alerts, contracts, search, lake files, apply step."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts as al
from tidemark.operators import contracts as co
from tidemark.operators import metrics as m
from tidemark.operators import ops, search, serving, slo
from tidemark.operators.chain import verify_chain
from tidemark.operators.metrics import CATALOG, Metric, register_metric
from tidemark.session import prepare, shared_dir, work_dir
from tidemark.sources import lake
from tidemark.streaming import sinks

T0 = datetime(2024, 3, 1)
JOURNAL = "tenant_id string, event_id string, topic string, event_type string, entity_id string, latency_ms int, status_code int, processed_at timestamp, branch string"


def journal(spark, seconds, topic="events.validated"):
    return spark.createDataFrame([("t", str(i), topic, "click", "e", 10, 200, T0 + timedelta(seconds=s), None) for i, s in enumerate(seconds)], JOURNAL)


def test_freshness_share_equals_a_loop(spark):
    rng = random.Random(4)
    for threshold in (30, 45, 7.5):
        seconds = sorted(round(rng.uniform(0, 7200), 3) for _ in range(300))
        as_of = T0 + timedelta(seconds=7250)
        out = slo.freshness_sli(journal(spark, seconds), threshold, as_of, {"1h": 3600, "2h": 7200}).first()
        for name, width in (("1h", 3600), ("2h", 7200)):
            inside = [s for s in seconds if s >= 7250 - width]
            fresh = sum(min(b - a, threshold) for a, b in zip(inside, inside[1:])) + min(7250 - inside[-1], threshold)
            assert abs(out[f"good_{name}"] - min(fresh, 7250 - inside[0])) < 1e-6
            assert abs(out[f"valid_{name}"] - (7250 - inside[0])) < 1e-6


def test_single_instant_is_unknown(spark):
    report = {r["name"]: r for r in slo.slo_report(journal(spark, [0]), T0).collect()}
    assert report["data_freshness"]["status"] == "unknown" and report["api_latency_p95"]["status"] == "healthy"
    later = {r["name"]: r["status"] for r in slo.slo_report(journal(spark, [0]), T0 + timedelta(days=90)).collect()}
    assert set(later.values()) == {"unknown"}


def test_slo_breach_and_risk(spark):
    rows = [("t", str(i), "events.validated", "c", "e", 500 if i < 6 else 5, 200, T0 - timedelta(days=10) + timedelta(seconds=i), None) for i in range(1000)]
    report = {r["name"]: r for r in slo.slo_report(spark.createDataFrame(rows, JOURNAL), T0).collect()}
    ok = report["api_latency_p95"]
    assert (ok["current"], ok["status"], ok["error_budget_remaining"], ok["burn_1h"]) == (0.994, "healthy", 0.4, None)
    strict = slo.slo_report(spark.createDataFrame(rows, JOURNAL), T0, [slo.Objective("x", 0.995, "p95_latency_ms", 100, 30)]).first()
    assert strict["status"] == "breached" and strict["error_budget_remaining"] == 0.0
    tight = slo.slo_report(spark.createDataFrame(rows, JOURNAL), T0, [slo.Objective("x", 0.993, "p95_latency_ms", 100, 30)]).first()
    assert tight["status"] == "at_risk"


def test_dead_letter_share_without_status_codes(spark):
    rows = journal(spark, range(3)).unionByName(journal(spark, [5], "events.deadletter")).withColumn("status_code", F.lit(None).cast("int"))
    out = slo.error_sli(rows, T0 + timedelta(seconds=10), {"1h": 3600}).first()
    assert (out["good_1h"], out["valid_1h"]) == (3.0, 4.0)


def rule(**change):
    base = {"escalation": [{"level": 1, "after_minutes": 0}, {"level": 2, "after_minutes": 10}, {"level": 3, "after_minutes": 15}],
            "flap_enabled": False, "flap_minutes": 5.0, "flap_max": 3, "cooldown_minutes": 30.0}
    return {**base, **change}


def run(machine, script):
    return [(machine.tick(T0 + timedelta(minutes=mi), on), machine.state, machine.level) for mi, on in script]


def test_alert_escalates_one_level_per_tick_and_resolves():
    got = run(al.AlertMachine(rule()), [(0, False), (1, True), (5, True), (30, True), (31, True), (32, True), (33, False), (34, False)])
    assert got == [(None, "ok", 0), ("firing", "firing", 1), (None, "sustained", 1), ("escalated", "sustained", 2), ("escalated", "sustained", 3),
                   (None, "sustained", 3), ("resolved", "resolved", 0), (None, "ok", 0)]


def test_single_step_repeats_after_its_cooldown():
    got = run(al.AlertMachine(rule(escalation=[{"level": 1, "after_minutes": 0}])), [(0, True), (29, True), (30, True), (31, True), (60, True)])
    assert [g[0] for g in got] == ["firing", None, "sustained", None, "sustained"]


def test_flapping_suppresses_and_recovers():
    got = run(al.AlertMachine(rule(flap_enabled=True, flap_max=2)), [(0, True), (1, False), (2, True), (3, False), (9, False), (20, True)])
    assert [g[1] for g in got] == ["firing", "resolved", "suppressed", "suppressed", "ok", "firing"]


def test_flap_counts_equal_a_loop(spark):
    rng = random.Random(8)
    rows = [(a, T0 + timedelta(minutes=i), rng.random() < 0.4) for a in ("x", "y") for i in range(0, 900, 7)]
    out = al.flap_counts(spark.createDataFrame(rows, "alert_id string, tick_at timestamp, triggered boolean"), 60, 3).collect()
    for a in ("x", "y"):
        mine = [r for r in rows if r[0] == a]
        changes = [t for (_, t, on), (_, _, before) in zip(mine, [(a, None, False), *mine]) if on != before]
        want = {t: sum(1 for c in changes if t - timedelta(minutes=60) <= c <= t) for _, t, _ in mine}
        assert {r["tick_at"]: r["changes"] for r in out if r["alert_id"] == a} == want


def test_rules_from_a_zero_baseline(spark):
    rules = spark.createDataFrame([(c + str(t), "t", "m", "1h", c, float(t)) for c, t in (("above", 5), ("below", 5), ("change_pct", 50), ("change_pct", -50))],
                                  "alert_id string, tenant_id string, metric string, window string, condition string, threshold double")

    def fired(cur, prev):
        def one(v):
            return spark.createDataFrame([("t", "m", "1h", float(v))], "tenant_id string, metric string, window string, value double")
        return {r["alert_id"] for r in al.evaluate_rules(rules, one(cur), one(prev)).collect() if r["triggered"]}

    assert fired(5, 0) == {"change_pct50"}
    assert fired(6, 4) == {"above5", "change_pct50"}
    assert fired(0, 0) == {"below5"}
    assert fired(2, 4) == {"below5", "change_pct-50"}


def test_due_steps(spark):
    steps = "array<struct<level:int,after_minutes:int>>"
    rows = [("a", T0, 1, T0, 30, [(1, 0), (2, 10), (3, 15)]), ("b", T0, 3, T0, 30, [(1, 0), (2, 10), (3, 15)]), ("c", T0, 1, T0, 30, [(1, 0)]), ("d", None, 0, None, 30, [(1, 0)])]
    df = spark.createDataFrame(rows, f"alert_id string, fired_at timestamp, last_escalation_level int, last_triggered_at timestamp, cooldown_minutes int, escalation {steps}")
    at = lambda mi: {r["alert_id"]: r["next_level"] for r in al.due_steps(df, T0 + timedelta(minutes=mi)).collect()}
    assert (at(9), at(20), at(30)) == ({}, {"a": 2}, {"a": 2, "c": 1})


def test_chain_breaks_are_found(spark):
    import hashlib
    import json

    rows, prev = [], ""
    for i in range(1, 9):
        body = f'"row {i}"'
        h = hashlib.sha256(json.dumps({"seq": i, "previous_hash": prev, "payload": f"row {i}"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        rows.append(("log", i, body, h, prev))
        prev = h
    ddl = "log string, seq long, body string, hash string, previous_hash string"
    assert verify_chain(spark.createDataFrame(rows, ddl)).count() == 0
    bad = [r for r in rows if r[1] != 4]
    bad[1] = ("log", 2, "forged", rows[1][3], rows[1][4])
    bad[-1] = (*bad[-1][:4], "zz")
    bad.append(bad[0])
    got = {(r["seq"], r["problem"]) for r in verify_chain(spark.createDataFrame(bad, ddl)).collect()}
    assert got == {(5, "gap"), (2, "hash"), (8, "hash"), (8, "previous_hash"), (1, "duplicate")}
    for at, value in ((3, None), (4, None)):
        gone = [tuple(value if (k, r[1]) == (at, 6) else x for k, x in enumerate(r)) for r in rows]
        assert (6, "hash") in {(r["seq"], r["problem"]) for r in verify_chain(spark.createDataFrame(gone, ddl)).collect()}
    # a replaced row whose successor's link is mended shows in the successor's own hash
    swapped = list(rows)
    other = hashlib.sha256(json.dumps({"seq": 5, "previous_hash": rows[3][3], "payload": "other"}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    swapped[4], swapped[5] = ("log", 5, '"other"', other, rows[3][3]), (*rows[5][:4], other)
    assert {(r["seq"], r["problem"]) for r in verify_chain(spark.createDataFrame(swapped, ddl)).collect()} == {(6, "hash"), (7, "previous_hash")} - {(7, "previous_hash")}


def test_triage_overlay(spark):
    ddl = "item_id string, tenant_id string, source string, status string, first_seen_at timestamp, last_seen_at timestamp, resolved_at timestamp, note string"
    overlay = spark.createDataFrame([("open", "t", "s", "open", T0, T0, None, None), ("gone", "t", "s", "acknowledged", T0, T0, None, None),
                                     ("again", "t", "s", "resolved", T0, T0, T0, "n"), ("same", "t", "s", "resolved", T0, T0, T0 + timedelta(hours=2), "n")], ddl)
    seen = T0 + timedelta(hours=1)
    found = spark.createDataFrame([(i, "t", "s", seen) for i in ("open", "again", "same", "new")], "item_id string, tenant_id string, source string, seen_at timestamp")
    out = {r["item_id"]: r for r in serving.merge_triage(overlay, found, T0 + timedelta(days=1)).collect()}
    assert {k: v["status"] for k, v in out.items()} == {"open": "open", "gone": "resolved", "again": "open", "same": "resolved", "new": "open"}
    assert out["again"]["resolved_at"] is None and out["same"]["last_seen_at"] == T0 and out["open"]["last_seen_at"] == seen


def test_replay_needs_clean_payloads(spark):
    dead = spark.createDataFrame([("t", "1", {"amount": "0.1", "k": "v"}, "failed", 1, None), ("t", "2", {"amount": "0.1"}, "failed", 0, None)],
                                 "tenant_id string, event_id string, payload map<string,string>, status string, retry_count int, last_retried_at timestamp")
    fix = spark.createDataFrame([("t", "1", {"amount": "5", "x": "y"}), ("t", "2", {"x": "y"})], "tenant_id string, event_id string, patch map<string,string>")
    errors = F.when(F.element_at("payload", "amount").cast("double") < 0.5, F.array(F.lit("too small"))).otherwise(F.array().cast("array<string>"))
    out = {r["event_id"]: r for r in serving.replay_dead_letters(dead, fix, errors, T0).collect()}
    assert (out["1"]["status"], out["1"]["retry_count"], out["1"]["payload"], out["1"]["topic"]) == ("replay_pending", 2, {"k": "v", "amount": "5", "x": "y"}, "events.replay")
    assert (out["2"]["status"], out["2"]["retry_count"], out["2"]["first_error"], out["2"]["last_retried_at"]) == ("failed", 0, "too small", None)


FIELDS = "entity string, version int, field string, type string, required boolean, values array<string>, description string, default string"


def test_contract_changes(spark):
    old = spark.createDataFrame([("o", 1, "a", "string", True, None, "x", None), ("o", 1, "b", "string", False, ["p", "q"], "x", None), ("o", 1, "c", "int", False, None, "x", None)], FIELDS)
    new = spark.createDataFrame([("o", 1, "b", "int", True, ["q", "r"], "y", None), ("o", 1, "c", "int", False, None, "x", "0"), ("o", 1, "d", "int", True, None, None, None), ("o", 1, "e", "int", False, None, None, None)], FIELDS)
    diff = sorted((r["field"], r["type"], r["severity"]) for r in co.contract_diff(old, new).collect())
    assert diff == [("a", "field_removed", "breaking"), ("b", "enum_values_added", "non_breaking"), ("b", "enum_values_removed", "breaking"), ("b", "field_became_required", "breaking"),
                    ("b", "field_type_changed", "breaking"), ("d", "field_added", "breaking"), ("e", "field_added", "non_breaking")]
    report = sorted((r["field"], r["type"]) for r in co.evolution_report(old, new).collect())
    assert ("b", "description_changed") in report and ("c", "field_default_added") in report and ("d", "field_required_added") in report and ("e", "field_added_optional") in report
    assert co.unversioned_breaks(old, new).first()["breaking_changes"] == 5
    assert co.unversioned_breaks(old, new.withColumn("version", F.lit(2))).count() == 0
    assert co.contract_diff(old, old).count() == 0


def test_catalog_documents_are_found(spark):
    docs = search.keyed(search.catalog_documents(spark, {"revenue": "12.5 RUB"}))
    assert docs.count() == sum(len(e.fields) for e in search.ENTITIES.values()) + len(CATALOG)
    hits = search.search(search.postings(docs), docs, "total revenue metric", 3).collect()
    assert (hits[0]["type"], hits[0]["id"], hits[0]["score"]) == ("metric", "revenue", 1.0) and "12.5 RUB" in hits[0]["snippet"]
    only = search.search(search.postings(docs), docs, "user order status", 50, authorised=["order"]).collect()
    assert {h["entity_type"] for h in only} <= {"order", None}
    assert all(h["type"] != "metric" for h in search.search(search.postings(docs), docs, "user order status", 50, requested=["user"]).collect())
    assert search.search(search.postings(docs), docs, "the of", 5).count() == 0


def test_metric_registration(spark):
    register_metric(Metric("big_orders", "Orders over 100", "count", "orders", "created_at", lambda i: F.count_if(i & (F.col("total_amount") > 100)).cast("double"), ("order.created",)))
    try:
        orders = spark.createDataFrame([("t", T0, 50), ("t", T0, 150), ("t", T0 - timedelta(days=2), 150)], "tenant_id string, created_at timestamp, total_amount int")
        assert m.metric_value("big_orders", {"orders": orders}, "1h", T0).first()["value"] == 1.0
        with pytest.raises(ValueError):
            m.metric_value("active_sessions", {"sessions": orders}, "1h", T0)
    finally:
        del CATALOG["big_orders"]


def test_empty_window_is_zero(spark):
    orders = spark.createDataFrame([], "status string, total_amount decimal(18,2), created_at timestamp")
    assert m.metric_value("avg_order_value", {"orders": orders}, "1h", T0).first()["value"] == 0.0


def test_stuck_worklist_orders_by_overshoot(spark):
    orders = spark.createDataFrame([("t", "o1", "u", "pending", T0), ("t", "o2", "u", "shipped", T0), ("t", "o3", "u", "delivered", T0), ("t", "o4", "u", "odd", T0)],
                                   "tenant_id string, order_id string, user_id string, status string, created_at timestamp")
    stages = spark.createDataFrame([("t", "o2", "order.status.shipped", T0 - timedelta(days=9)), ("t", "o1", "order.status.confirmed", T0 - timedelta(days=9))],
                                   "tenant_id string, entity_id string, event_type string, processed_at timestamp")
    rows = ops.stuck_orders(orders, stages, T0 + timedelta(minutes=31))
    page = ops.worklist_page(rows, 1, 10).collect()
    assert [(r["order_id"], r["clock"]) for r in page] == [("o2", "journal"), ("o1", "fallback")]
    assert ops.stuck_orders(orders, stages, T0 + timedelta(minutes=30)).count() == 1


def test_lake_tables(spark):
    base = work_dir(spark, "lake")
    with pytest.raises(ValueError):
        lake.partition_columns(spark.range(1), ["months(id)"])
    empty = spark.createDataFrame([], "event_id string, received_at timestamp")
    assert lake.append_lake("dead_letter", empty, base) == 0 and lake.read_lake(spark, "dead_letter", base).count() == 0
    rows = spark.createDataFrame([("t", "1", T0), ("t", "1", T0), ("u", "1", T0), ("u", "2", None)], "tenant_id string, event_id string, received_at timestamp")
    assert lake.append_idempotent("dead_letter", rows, base, "a") == {"consumed": 4, "appended": 3, "duplicates": 1}
    assert lake.append_idempotent("dead_letter", rows, base, "a") == {"consumed": 4, "appended": 3, "duplicates": 1}  # the same batch, run again
    late = rows.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 40 DAYS"))
    assert lake.append_idempotent("dead_letter", late, base, "b") == {"consumed": 4, "appended": 0, "duplicates": 4}
    assert lake.read_lake(spark, "dead_letter", base).count() == 3


def test_apply_step_survives_a_crash_between_its_writes(spark, monkeypatch):
    base = work_dir(spark, "apply")
    rows = spark.createDataFrame([("e1", "t", "click", None, None, False, 1, T0, None), ("e2", "t", "click", None, None, True, 1, T0, None), ("e1", "u", "click", None, None, False, 1, T0, None)],
                                 "event_id string, tenant_id string, event_type string, order_id string, status string, is_dead boolean, latency_ms int, processed_at timestamp, branch string")
    source = f"{base}/in"
    rows.write.parquet(source)
    step = sinks.apply_sink(base)

    def stream():
        return spark.readStream.schema(rows.schema).parquet(source)

    real = sinks.journal_rows
    monkeypatch.setattr(sinks, "journal_rows", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(Exception):
        sinks.run_available(stream(), f"{base}/cp", step)
    monkeypatch.setattr(sinks, "journal_rows", real)
    sinks.run_available(stream(), f"{base}/cp", step)   # the failed batch runs again
    rows.write.mode("append").parquet(source)           # the source delivers everything once more
    sinks.run_available(stream(), f"{base}/cp", step)
    journal_now = spark.read.parquet(f"{base}/journal")
    assert sorted((r["tenant_id"], r["event_id"], r["topic"]) for r in journal_now.collect()) == [
        ("t", "e1", "events.validated"), ("t", "e2", "events.deadletter"), ("u", "e1", "events.validated")]
    assert spark.read.parquet(f"{base}/serving_log").select("tenant_id", "event_id").distinct().count() == 2


def test_shared_folder(spark):
    assert shared_dir(prepare(spark))
