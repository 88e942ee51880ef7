"""Queries of operations analytics: service levels, worklists, usage, alerts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.columns import at, day, iso, money, rounded
from tidemark.functions.identity import json_number, json_object, json_text
from tidemark.operators import alerts as al
from tidemark.operators import entities as e
from tidemark.operators import metrics as m
from tidemark.operators import ops as o
from tidemark.operators import serving as s
from tidemark.operators import slo
from tidemark.operators import usage as u
from tidemark.operators.chain import chain_hash, verify_chain
from tidemark.operators.tenancy import tenant_scope
from tidemark.plans.registry import Inputs, dec_round, query, ts_text

NOW = "(SELECT max(ts) FROM events)"
ORDERS_NOW = "(SELECT max(created_at) FROM a_orders)"
LATER = f"({NOW} + INTERVAL 20 SECOND)"


def later(t: Inputs):
    """Twenty seconds after the last event, so that tails are not empty."""
    return t.events_as_of + timedelta(seconds=20)


def even(expr: str, digits: int) -> str:
    return f"CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE)"


_WINDOWS = {"1h": 3600, "6h": 21600, "3d": 259200}


# --- journal indicators ----------------------------------------------------------------------------

@query("o01_lineage_events", f"""
SELECT event_id, topic, event_type, {ts_text('processed_at')} AS processed_at FROM a_journal WHERE tenant_id = 'default' AND entity_id = (SELECT max(entity_id) FROM a_journal WHERE tenant_id = 'default')""")
def lineage_events(t: Inputs):
    own = tenant_scope(t.a_journal, "default")
    probe = own.agg(F.max("entity_id").alias("id"))
    return slo.lineage_events(own, probe.scalar()).select("event_id", "topic", "event_type", iso("processed_at").alias("processed_at"))


_Q = lambda agg: even(f"greatest(0, least(1, 1 - {agg} / 1000.0))", 3)


@query("o02_lineage_chain", f"""
WITH p AS (SELECT tenant_id, entity_id, min(processed_at) AS a, max(processed_at) AS z, max(processed_at) FILTER (WHERE topic = 'events.validated') AS v,
  count(*) FILTER (WHERE topic = 'events.validated') AS n, {_Q('avg(latency_ms)')} AS qa, {_Q("avg(latency_ms) FILTER (WHERE topic = 'events.validated')")} AS qv
  FROM a_journal GROUP BY ALL),
 r AS (SELECT *, 'source' AS layer, 'web_sdk' AS system, 'clicks.raw' AS table_or_topic, a AS at_, NULL::DOUBLE AS q FROM p
  UNION ALL SELECT *, 'ingestion', 'kafka', 'clicks.raw', a, coalesce(qa, 1.0) FROM p
  UNION ALL SELECT *, 'validation', 'spark', 'events.validated', coalesce(v, z), CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END FROM p
  UNION ALL SELECT *, 'enrichment', 'spark', 'sessions_aggregated', z, coalesce(qv, CASE WHEN n > 0 THEN 1.0 END) FROM p
  UNION ALL SELECT *, 'serving', 'spark', 'sessions_aggregated', z, CASE WHEN n > 0 THEN 1.0 END FROM p)
SELECT tenant_id, entity_id, layer, system, table_or_topic, {ts_text('at_')} AS processed_at, q AS quality_score,
  {even(f'(epoch_us({LATER}) - epoch_us(z)) / 1000000.0', 3)} AS freshness_seconds, n > 0 AS validated, n > 0 AS enriched FROM r""")
def lineage_chain(t: Inputs):
    return slo.lineage_chain(t.a_journal, "session", later(t)).withColumn("processed_at", iso("processed_at"))


@query("o03_freshness", f"""
SELECT tenant_id, {ts_text('max(processed_at)')} AS newest, greatest(0, (epoch_us({LATER}) - epoch_us(max(processed_at))) / 1000000.0) AS age_seconds FROM a_journal GROUP BY tenant_id""")
def freshness(t: Inputs):
    return slo.freshness(t.a_journal, later(t)).withColumn("newest", iso("newest"))


@query("o04_latency_quantile", f"""
SELECT tenant_id, {dec_round('quantile_cont(latency_ms, 0.95)', 4)} AS p95 FROM a_journal
WHERE processed_at >= {LATER} - INTERVAL 10 DAY AND latency_ms IS NOT NULL GROUP BY tenant_id""")
def latency_quantile(t: Inputs):
    return slo.latency_quantile(t.a_journal, 0.95, later(t), 10 * 86400).select("tenant_id", rounded("latency_ms", 4).alias("p95"))


def _sli_sql(good: str, valid: str) -> str:
    parts = []
    for w, secs in _WINDOWS.items():
        inside = f"processed_at >= {LATER} - to_seconds({secs})"
        parts.append(f"CAST({good.format(i=inside)} AS DOUBLE) AS good_{w}, CAST({valid.format(i=inside)} AS DOUBLE) AS valid_{w}")
    return f"SELECT tenant_id, {', '.join(parts)} FROM a_journal WHERE processed_at >= {LATER} - INTERVAL 3 DAY GROUP BY tenant_id"


@query("o05_latency_sli", _sli_sql("count(*) FILTER (WHERE {i} AND latency_ms <= 100)", "count(latency_ms) FILTER (WHERE {i})"))
def latency_sli(t: Inputs):
    return slo.latency_sli(t.a_journal, 100, later(t), _WINDOWS)


@query("o06_error_sli", _sli_sql("count(*) FILTER (WHERE {i} AND status_code < 500)", "count(status_code) FILTER (WHERE {i})"))
def error_sli(t: Inputs):
    return slo.error_sli(t.a_journal, later(t), _WINDOWS)


def _fresh_cte(name: str, secs: int, threshold: float) -> str:
    return f"""{name} AS (SELECT tenant_id, CASE WHEN obs > 0 THEN least(coalesce(between_, 0) + least(tail, {threshold}), obs) ELSE 0 END AS good, obs AS valid FROM (
  SELECT tenant_id, sum(CASE WHEN prev IS NULL THEN 0 ELSE least(date_diff('millisecond', prev, processed_at) / 1000.0, {threshold}) END) AS between_, (epoch_us({LATER}) - epoch_us(max(processed_at))) / 1000000.0 AS tail,
    (epoch_us({LATER}) - epoch_us(min(processed_at))) / 1000000.0 AS obs FROM (
    SELECT tenant_id, processed_at, lag(processed_at) OVER (PARTITION BY tenant_id ORDER BY processed_at) AS prev FROM a_journal
    WHERE processed_at >= {LATER} - to_seconds({secs}) AND processed_at <= {LATER}) GROUP BY tenant_id))"""


@query("w02_freshness_sli", f"""
WITH {', '.join(_fresh_cte(f'f_{w}', secs, 300) for w, secs in _WINDOWS.items())}
SELECT a.tenant_id, round(b.good, 4) AS good_1h, round(b.valid, 4) AS valid_1h, round(c.good, 4) AS good_6h, round(c.valid, 4) AS valid_6h,
       round(a.good, 4) AS good_3d, round(a.valid, 4) AS valid_3d FROM f_3d a LEFT JOIN f_1h b USING (tenant_id) LEFT JOIN f_6h c USING (tenant_id)""")
def freshness_sli(t: Inputs):
    out = slo.freshness_sli(t.a_journal, 300, later(t), _WINDOWS)
    return out.select("tenant_id", *[F.round(c, 4).alias(c) for c in out.columns if c != "tenant_id"])


def _slo_sql() -> str:
    ctes, rows = [], []
    for ob in slo.OBJECTIVES:
        for w, secs in {"slo": ob.window_days * 86400, **_WINDOWS}.items():
            name = f"{ob.measurement[:5]}_{w}"
            inside = f"processed_at >= {LATER} - to_seconds({secs}) AND processed_at <= {LATER}"
            if ob.measurement == "freshness_seconds":
                ctes.append(_fresh_cte(name, secs, ob.threshold))
            elif ob.measurement == "p95_latency_ms":
                ctes.append(f"{name} AS (SELECT tenant_id, count(*) FILTER (WHERE latency_ms <= {ob.threshold}) AS good, count(latency_ms) AS valid FROM a_journal WHERE {inside} GROUP BY 1)")
            else:
                ctes.append(f"{name} AS (SELECT tenant_id, count(*) FILTER (WHERE status_code < 500) AS good, count(status_code) AS valid FROM a_journal WHERE {inside} GROUP BY 1)")
        p = ob.measurement[:5]
        share = lambda w: f"(CAST({w}.good AS DOUBLE) / nullif(CAST({w}.valid AS DOUBLE), 0))"
        budget = 1.0 - ob.target
        cur = even(share("s"), 4)
        burns = {w: even(f"(1.0 - {share(a)}) / {budget!r}", 2) for w, a in (("1h", "b1"), ("6h", "b6"), ("3d", "b3"))}
        diag = {"p95_latency_ms": f"(SELECT quantile_cont(latency_ms, 0.95) FROM a_journal j WHERE j.tenant_id = t.tenant_id AND processed_at >= {LATER} - INTERVAL 30 DAY AND processed_at <= {LATER})",
                "freshness_seconds": f"(SELECT (epoch_us({LATER}) - epoch_us(max(processed_at))) / 1000000.0 FROM a_journal j WHERE j.tenant_id = t.tenant_id)",
                "error_rate_percent": f"(1 - {share('s')}) * 100.0"}[ob.measurement]
        rows.append(f"""SELECT tenant_id, '{ob.name}' AS name, CAST({ob.target} AS DOUBLE) AS target, cur AS current, lft AS error_budget_remaining,
  CASE WHEN cur IS NULL THEN 'unknown' WHEN cur < {ob.target} THEN 'breached' WHEN (burn_1h > 14.4 AND burn_6h > 14.4) OR (burn_6h > 6 AND burn_3d > 6) OR lft < 0.2 THEN 'at_risk' ELSE 'healthy' END AS status,
  {ob.window_days} AS window_days, {even('good', 2)} AS good, {even('valid', 2)} AS valid, '{"seconds" if p == "fresh" else "events"}' AS unit, burn_1h, burn_6h, burn_3d, {even('diag', 4)} AS diagnostic
FROM (SELECT t.tenant_id, {cur} AS cur, {even(f'greatest(0.0, least(1.0, 1.0 - (1.0 - {cur}) / {budget!r}))', 4)} AS lft, s.good, s.valid,
  {burns['1h']} AS burn_1h, {burns['6h']} AS burn_6h, {burns['3d']} AS burn_3d, {diag} AS diag
  FROM (SELECT DISTINCT tenant_id FROM a_journal) t LEFT JOIN {p}_slo s USING (tenant_id) LEFT JOIN {p}_1h b1 USING (tenant_id) LEFT JOIN {p}_6h b6 USING (tenant_id) LEFT JOIN {p}_3d b3 USING (tenant_id))""")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(rows)


@query("o07_slo_report", _slo_sql())
def slo_report(t: Inputs):
    return slo.slo_report(t.a_journal, later(t))


@query("o08_pipeline_health", f"""
WITH x AS (SELECT (epoch_us({LATER}) - epoch_us(max(processed_at))) / 1000000.0 AS age,
  CAST(count(*) FILTER (WHERE processed_at >= {LATER} - INTERVAL 1 HOUR AND topic <> 'events.deadletter') AS DOUBLE) / nullif(count(*) FILTER (WHERE processed_at >= {LATER} - INTERVAL 1 HOUR), 0) AS p FROM a_journal),
 s AS (SELECT *, CASE WHEN age <= 30 THEN 0 WHEN age <= 90 THEN 1 ELSE 2 END AS f, CASE WHEN p IS NULL THEN 1 WHEN p >= 0.99 THEN 0 WHEN p >= 0.95 THEN 1 ELSE 2 END AS q FROM x)
SELECT component, CASE sev WHEN 0 THEN 'healthy' WHEN 1 THEN 'degraded' ELSE 'unhealthy' END AS status, round(value, 6) AS value FROM (
 SELECT 'freshness' AS component, f AS sev, age AS value FROM s UNION ALL SELECT 'quality', q, p FROM s UNION ALL SELECT 'overall', greatest(f, q), NULL FROM s)""")
def health(t: Inputs):
    return slo.pipeline_health(t.a_journal, later(t)).withColumn("value", F.round("value", 6))


@query("w03_rolling_compliance", """
SELECT topic, round(avg(CASE WHEN latency_ms <= 30 THEN 1.0 ELSE 0.0 END), 8) AS compliance, count(*) AS events
FROM a_journal WHERE latency_ms IS NOT NULL GROUP BY topic""")
def rolling_compliance(t: Inputs):
    timed = t.a_journal.filter(F.col("latency_ms").isNotNull())
    return slo.rolling_compliance(timed, limit_ms=30).withColumn("compliance", F.round("compliance", 8))


@query("w03_rolling_window", """
SELECT topic, round(avg(CASE WHEN latency_ms <= 30 THEN 1.0 ELSE 0.0 END), 8) AS compliance, count(*) AS events
FROM (SELECT * FROM a_journal WHERE latency_ms IS NOT NULL QUALIFY row_number() OVER (PARTITION BY topic ORDER BY processed_at DESC, event_id DESC) <= 500) GROUP BY topic""")
def rolling_window(t: Inputs):
    """The share over the last five hundred timed events of each topic."""
    timed = t.a_journal.filter(F.col("latency_ms").isNotNull())
    return slo.rolling_compliance(timed, limit_ms=30, size=500).withColumn("compliance", F.round("compliance", 8))


@query("s14_latency_histogram", " UNION ALL ".join(
    f"SELECT topic, event_type, '{b}' AS le, count(*) FILTER (WHERE latency_ms <= {b * 1000}) AS events FROM a_journal GROUP BY topic, event_type" for b in slo.LATENCY_BUCKETS)
    + " UNION ALL SELECT topic, event_type, '+Inf', count(latency_ms) FROM a_journal GROUP BY topic, event_type")
def latency_histogram(t: Inputs):
    return slo.latency_histogram(t.a_journal)


@query("s13_visible_lag", """
SELECT order_id, greatest(0, ts_ms - 1600000000000 - tx_id * 10) AS lag_ms FROM a_changes""")
def visible_lag(t: Inputs):
    """Milliseconds from emit to visibility on one clock, never negative."""
    emitted = F.timestamp_millis(F.lit(1600000000000) + F.col("tx_id") * 10)
    lag = F.unix_millis(F.timestamp_millis("ts_ms")) - F.unix_millis(emitted)
    return t.a_changes.select("order_id", F.greatest(F.lit(0).cast("long"), lag).alias("lag_ms"))


# --- orders ------------------------------------------------------------------------------------------

_CLOCK = f"""(SELECT o.*, coalesce(j.entered, o.created_at) AS entered_at, CASE WHEN j.entered IS NULL THEN 'fallback' ELSE 'journal' END AS clock,
  (epoch_us({ORDERS_NOW}) - epoch_us(coalesce(j.entered, o.created_at))) / 1000000.0 AS secs, CASE status WHEN 'pending' THEN 30 WHEN 'confirmed' THEN 1440 WHEN 'shipped' THEN 7200 END AS mins
  FROM a_orders o LEFT JOIN (SELECT tenant_id, entity_id, event_type, max(processed_at) AS entered FROM a_stage_rows GROUP BY ALL) j
  ON j.tenant_id = o.tenant_id AND j.entity_id = o.order_id AND j.event_type = 'order.status.' || o.status)"""


@query("o09_stage_clock", f"SELECT tenant_id, order_id, {ts_text('entered_at')} AS entered_at, clock FROM {_CLOCK}")
def stage_clock(t: Inputs):
    return o.stage_clock(t.a_orders, t.a_stage_rows, t.orders_as_of).select("tenant_id", "order_id", iso("entered_at").alias("entered_at"), "clock")


@query("j07_stage_lookup", f"SELECT status, clock, count(*) AS orders FROM {_CLOCK} GROUP BY ALL")
def stage_lookup(t: Inputs):
    return o.stage_clock(t.a_orders, t.a_stage_rows, t.orders_as_of).groupBy("status", "clock").agg(F.count("*").alias("orders"))


@query("w04_first_row_per_key", "SELECT tenant_id, entity_id, event_type FROM a_stage_rows QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY processed_at DESC, event_id DESC) = 1")
def first_row_per_key(t: Inputs):
    from tidemark.operators.latest import latest_version

    return latest_version(t.a_stage_rows, ["tenant_id", "entity_id"], ["processed_at", "event_id"], ["tenant_id", "entity_id", "event_type"])


@query("o10_sla_breach", f"SELECT tenant_id, order_id, secs > mins * 60 AS breached, {dec_round('secs / (mins * 60)', 4)} AS overshoot_ratio FROM {_CLOCK}")
def sla_breach(t: Inputs):
    return o.stage_clock(t.a_orders, t.a_stage_rows, t.orders_as_of).select("tenant_id", "order_id", "breached", rounded("overshoot_ratio", 4).alias("overshoot_ratio"))


TENANT = "default"


def _own(rows):
    """Rows of the tenant whose page is shown; the filter reaches the scan."""
    return tenant_scope(rows, TENANT, keep=True)


@query("o11_stuck_orders", f"""SELECT order_id, user_id, status, {ts_text('entered_at')} AS entered_at, secs AS in_stage_seconds, mins AS sla_minutes, {dec_round('secs / (mins * 60)', 4)} AS overshoot_ratio,
  clock, CAST(total_amount AS DOUBLE) AS total_amount, currency FROM {_CLOCK} c WHERE status IN ('pending', 'confirmed', 'shipped') AND secs > mins * 60
  ORDER BY c.secs / (c.mins * 60) DESC, tenant_id, order_id LIMIT 100 OFFSET 100""")
def stuck_orders(t: Inputs):
    rows = o.stuck_orders(t.a_orders, t.a_stage_rows, t.orders_as_of)
    return o.worklist_page(rows, 2, 100).select(
        "order_id", "user_id", "status", iso("entered_at").alias("entered_at"), "in_stage_seconds", "sla_minutes",
        rounded("overshoot_ratio", 4).alias("overshoot_ratio"), "clock", money("total_amount").alias("total_amount"), "currency")


@query("o11_stage_summary", f"SELECT status, count(*) AS open, count(*) FILTER (WHERE secs > mins * 60) AS breached FROM {_CLOCK} WHERE status IN ('pending', 'confirmed', 'shipped') GROUP BY status")
def stage_summary(t: Inputs):
    return o.stage_summary(o.stuck_orders(t.a_orders, t.a_stage_rows, t.orders_as_of, include_within_sla=True))


def order_journal(t: Inputs):
    """Stage rows plus a validated or dead-lettered row per order."""
    rows = t.a_orders.select(
        F.concat(F.col("src_key").cast("string"), F.lit("-e")).alias("event_id"),
        F.when(F.col("total_amount") > 450000, "events.deadletter").otherwise("events.validated").alias("topic"), "tenant_id",
        F.col("order_id").alias("entity_id"), F.lit("order.created").alias("event_type"), F.col("created_at").alias("processed_at"))
    return t.a_stage_rows.unionByName(rows)


def order_dead(t: Inputs):
    return t.a_orders.filter(F.col("total_amount") > 450000).select(
        "tenant_id", F.concat(F.col("src_key").cast("string"), F.lit("-e")).alias("event_id"), F.lit("schema_validation").alias("failure_reason"),
        F.lit("failed").alias("status"), F.col("created_at").alias("received_at"))


@query("o12_order_timeline", f"""
SELECT tenant_id, order_id, section, {ts_text('at_')} AS "at", detail FROM (
 SELECT tenant_id, order_id, 'order' AS section, created_at AS at_, status || ' ' || user_id AS detail FROM a_orders
 UNION ALL SELECT tenant_id, order_id, 'stage', entered_at, concat_ws(' ', status, clock, CAST(secs > mins * 60 AS VARCHAR)) FROM {_CLOCK}
 UNION ALL SELECT tenant_id, entity_id, 'stage_history', processed_at, substr(event_type, 14) FROM a_stage_rows
 UNION ALL SELECT tenant_id, order_id, 'pipeline_trail', created_at, CASE WHEN total_amount > 450000 THEN 'events.deadletter' ELSE 'events.validated' END || ' order.created' FROM a_orders
 UNION ALL SELECT o.tenant_id, order_id, 'customer', u.last_order_at, o.user_id || ' ' || u.total_orders FROM a_orders o JOIN a_users u ON u.tenant_id = o.tenant_id AND u.user_id = o.user_id
 UNION ALL SELECT tenant_id, order_id, 'exception', created_at, 'schema_validation failed' FROM a_orders WHERE total_amount > 450000)""")
def order_timeline(t: Inputs):
    return o.order_timeline(t.a_orders, order_journal(t), t.a_users, order_dead(t), t.orders_as_of).withColumn("at", iso("at"))


_R1 = """SELECT o.tenant_id, 'r1:' || o.order_id || ':' || js AS dedupe_key, 'high' AS severity, 'order' AS entity_kind, o.order_id AS entity_id, processed_at AS occurred_at
FROM (SELECT tenant_id, entity_id, substr(event_type, 14) AS js, processed_at FROM a_stage_rows QUALIFY row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY processed_at DESC, event_id DESC) = 1) j
JOIN a_orders o ON o.tenant_id = j.tenant_id AND o.order_id = j.entity_id
WHERE list_position(['pending', 'confirmed', 'shipped'], o.status) < list_position(['pending', 'confirmed', 'shipped'], js)"""
_R2 = f"""SELECT tenant_id, 'r2:' || event_id AS dedupe_key, 'medium' AS severity, 'event' AS entity_kind, event_id AS entity_id, last_retried_at AS occurred_at
FROM a_dead_letters WHERE status = 'replay_pending' AND last_retried_at <= {NOW} - INTERVAL 900 SECOND"""
_FIND = "SELECT * REPLACE (strftime(occurred_at, '%Y-%m-%d %H:%M:%S.%f') AS occurred_at) FROM ({})"
_FIND_COLS = ("tenant_id", "dedupe_key", "severity", "entity_kind", "entity_id")


@query("o13_behind_journal", _FIND.format(_R1))
def behind_journal(t: Inputs):
    return o.behind_journal(t.a_orders, t.a_stage_rows).select(*_FIND_COLS, iso("occurred_at").alias("occurred_at"))


@query("o14_stuck_replays", _FIND.format(_R2))
def stuck_replays(t: Inputs):
    return o.stuck_replays(t.a_dead_letters, t.events_as_of, 900).select(*_FIND_COLS, iso("occurred_at").alias("occurred_at"))


def findings(t: Inputs):
    return o.behind_journal(t.a_orders, t.a_stage_rows).unionByName(o.stuck_replays(t.a_dead_letters, t.events_as_of, 900))


def triage_seed(t: Inputs):
    """An overlay as an earlier scan left it: every dead delivery of a large value, some resolved since, and stale items."""
    item = F.concat_ws(":", F.lit("wh"), "webhook_id", "event_id")
    return t.a_deliveries.filter(F.col("webhook_id") == "hook-a").select(
        item.alias("item_id"), "tenant_id", F.lit("webhook_delivery").alias("source"),
        F.when(F.col("tenant_id") == "acme", "resolved").otherwise("open").alias("status"),
        (F.col("updated_at") - F.expr("INTERVAL 1 HOUR")).alias("first_seen_at"), (F.col("updated_at") - F.expr("INTERVAL 1 HOUR")).alias("last_seen_at"),
        F.when(F.col("tenant_id") == "acme", F.col("updated_at") - F.expr("INTERVAL 1 MINUTE")).alias("resolved_at"), F.lit("seen").alias("note"))


def triage_next(t: Inputs):
    seen = t.a_deliveries.filter(F.col("status") == "dead").select(
        F.concat_ws(":", F.lit("wh"), "webhook_id", "event_id").alias("item_id"), "tenant_id", F.lit("webhook_delivery").alias("source"),
        F.col("updated_at").alias("seen_at"))
    return s.merge_triage(triage_seed(t), seen, t.events_as_of)


_TRIAGE = f"""(SELECT coalesce(o.item_id, f.item_id) AS item_id, coalesce(o.tenant_id, f.tenant_id) AS tenant_id, coalesce(o.first_seen_at, f.seen_at) AS first_seen_at,
  CASE WHEN o.item_id IS NULL OR (f.item_id IS NOT NULL AND o.status = 'resolved' AND f.seen_at > o.resolved_at) THEN 'open'
       WHEN f.item_id IS NULL AND o.status <> 'resolved' THEN 'resolved' ELSE o.status END AS status,
  CASE WHEN f.item_id IS NOT NULL AND (o.item_id IS NULL OR o.status <> 'resolved' OR f.seen_at > o.resolved_at) THEN f.seen_at ELSE o.last_seen_at END AS last_seen_at,
  CASE WHEN o.item_id IS NULL OR (f.item_id IS NOT NULL AND o.status = 'resolved' AND f.seen_at > o.resolved_at) THEN NULL
       WHEN f.item_id IS NULL AND o.status <> 'resolved' THEN {NOW} ELSE o.resolved_at END AS resolved_at,
  CASE WHEN o.item_id IS NULL OR (f.item_id IS NOT NULL AND o.status = 'resolved' AND f.seen_at > o.resolved_at) THEN NULL
       WHEN f.item_id IS NULL AND o.status <> 'resolved' THEN 'auto-resolved: no longer reproduces' ELSE o.note END AS note
  FROM (SELECT 'wh:' || webhook_id || ':' || event_id AS item_id, tenant_id, CASE WHEN tenant_id = 'acme' THEN 'resolved' ELSE 'open' END AS status,
    updated_at - INTERVAL 1 HOUR AS first_seen_at, updated_at - INTERVAL 1 HOUR AS last_seen_at, CASE WHEN tenant_id = 'acme' THEN updated_at - INTERVAL 1 MINUTE END AS resolved_at, 'seen' AS note
    FROM a_deliveries WHERE webhook_id = 'hook-a') o
  FULL OUTER JOIN (SELECT 'wh:' || webhook_id || ':' || event_id AS item_id, tenant_id, updated_at AS seen_at FROM a_deliveries WHERE status = 'dead') f ON f.item_id = o.item_id AND f.tenant_id = o.tenant_id)"""


@query("m11_triage_merge", f"SELECT item_id, tenant_id, status, {ts_text('first_seen_at')} AS first_seen_at, {ts_text('last_seen_at')} AS last_seen_at, {ts_text('resolved_at')} AS resolved_at, note FROM {_TRIAGE}")
def triage_merge(t: Inputs):
    return triage_next(t).select("item_id", "tenant_id", "status", *[iso(c).alias(c) for c in ("first_seen_at", "last_seen_at", "resolved_at")], "note")


def inbox(t: Inputs):
    return o.exception_inbox(t.a_dead_letters, t.a_deliveries, findings(t), triage_next(t))


_INBOX = f"""(SELECT tenant_id, 'dl:' || event_id AS item_id, 'deadletter' AS source, 'high' AS severity, received_at AS occurred_at, coalesce(last_retried_at, received_at) AS last_seen_at,
   'event' AS entity_kind, event_id AS entity_id, CASE status WHEN 'failed' THEN 'open' WHEN 'replay_pending' THEN 'in_progress' ELSE 'resolved' END AS status FROM a_dead_letters
 UNION ALL SELECT d.tenant_id, 'wh:' || webhook_id || ':' || event_id, 'webhook_delivery', 'medium', coalesce(t.first_seen_at, updated_at), coalesce(t.last_seen_at, updated_at), 'webhook', webhook_id, coalesce(t.status, 'open')
   FROM a_deliveries d LEFT JOIN {_TRIAGE} t ON t.tenant_id = d.tenant_id AND t.item_id = 'wh:' || webhook_id || ':' || event_id WHERE d.status = 'dead'
 UNION ALL SELECT tenant_id, 'rc:' || dedupe_key, 'reconciliation', severity, occurred_at, occurred_at, entity_kind, entity_id, 'open' FROM ({_R1} UNION ALL {_R2}))"""


@query("u04_exception_union", f"SELECT tenant_id, item_id, source, severity, {ts_text('occurred_at')} AS occurred_at, {ts_text('last_seen_at')} AS last_seen_at, entity_kind, entity_id, status FROM {_INBOX}")
def exception_union(t: Inputs):
    return inbox(t).select("tenant_id", "item_id", "source", "severity", iso("occurred_at").alias("occurred_at"), iso("last_seen_at").alias("last_seen_at"), "entity_kind", "entity_id", "status")


@query("o15_exception_inbox", f"""SELECT item_id, source, severity, {ts_text('occurred_at')} AS occurred_at, status FROM {_INBOX} i WHERE tenant_id = 'default' AND status <> 'resolved'
ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, i.occurred_at DESC, item_id LIMIT 50""")
def exception_inbox(t: Inputs):
    return o.inbox_page(_own(inbox(t)), 1, 50).select("item_id", "source", "severity", iso("occurred_at").alias("occurred_at"), "status")


@query("o16_exception_stats", f"SELECT source, status, count(*) AS items, count(*) FILTER (WHERE occurred_at >= {NOW} - INTERVAL 1 DAY) AS last_24h FROM {_INBOX} GROUP BY ALL")
def exception_stats(t: Inputs):
    return o.inbox_stats(inbox(t), t.events_as_of)


@query("o17_dead_letter_page", f"""SELECT event_id, tenant_id, failure_reason, {ts_text('received_at')} AS received_at FROM a_dead_letters d WHERE failure_reason = 'parse'
ORDER BY d.received_at DESC, event_id LIMIT 25 OFFSET 25""")
def dead_letter_page(t: Inputs):
    return o.dead_letter_page(t.a_dead_letters, "parse", 2, 25).select("event_id", "tenant_id", "failure_reason", iso("received_at").alias("received_at"))


@query("o18_dead_letter_stats", f"""
SELECT tenant_id, 'reason' AS kind, failure_reason AS "key", count(*) AS "count" FROM a_dead_letters WHERE status = 'failed' GROUP BY ALL
UNION ALL SELECT tenant_id, 'total', 'last_24h', count(*) FROM a_dead_letters WHERE status = 'failed' AND received_at >= {NOW} - INTERVAL 1 DAY GROUP BY ALL
UNION ALL SELECT tenant_id, 'hour', strftime(date_trunc('hour', received_at), '%Y-%m-%d %H:%M'), count(*) FROM a_dead_letters WHERE status = 'failed' AND received_at >= {NOW} - INTERVAL 1 DAY GROUP BY ALL""")
def dead_letter_stats(t: Inputs):
    return o.dead_letter_stats(t.a_dead_letters, t.events_as_of)


# --- usage -------------------------------------------------------------------------------------------

@query("l02_top_endpoints", """SELECT tenant, endpoint, requests FROM (SELECT tenant, endpoint, count(*) AS requests, row_number() OVER (PARTITION BY tenant ORDER BY count(*) DESC, endpoint) AS rn
FROM a_api_sessions GROUP BY tenant, endpoint) WHERE rn <= 3""")
def top_endpoints(t: Inputs):
    return u.top_endpoints(t.a_api_sessions).drop("rank")


@query("l03_top_queries", "SELECT query_text, count(*) AS requests FROM a_api_sessions WHERE query_text IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_queries(t: Inputs):
    return u.most_frequent(t.a_api_sessions, ["query_text"], 5)


@query("l03_top_entities", "SELECT entity_type, entity_id, count(*) AS requests FROM a_api_sessions WHERE entity_id IS NOT NULL GROUP BY ALL ORDER BY requests DESC, entity_type, entity_id LIMIT 10")
def top_entities(t: Inputs):
    return u.most_frequent(t.a_api_sessions, ["entity_type", "entity_id"], 10)


@query("o19_usage_by_tenant", f"""
WITH tops AS (SELECT tenant, string_agg(endpoint, ',' ORDER BY rn) AS top_endpoints FROM (SELECT tenant, endpoint, row_number() OVER (PARTITION BY tenant ORDER BY count(*) DESC, endpoint) AS rn FROM a_api_sessions GROUP BY tenant, endpoint) WHERE rn <= 3 GROUP BY 1)
SELECT a.tenant, count(*) AS total_requests, {dec_round('CAST(count(*) FILTER (WHERE status_code >= 400) AS DOUBLE) / count(*)', 4)} AS error_rate,
  {dec_round('CAST(count(*) FILTER (WHERE cache_hit) AS DOUBLE) / count(*)', 4)} AS cache_hit_rate, {dec_round('CAST(sum(duration_ms) AS DOUBLE) / count(*)', 3)} AS avg_duration_ms, any_value(top_endpoints) AS top_endpoints
FROM a_api_sessions a JOIN tops USING (tenant) GROUP BY a.tenant""")
def usage_by_tenant(t: Inputs):
    return u.usage_by_tenant(t.a_api_sessions)


@query("o20_latency_by_endpoint", "SELECT endpoint, " + ", ".join(f"{dec_round(f'quantile_cont(CAST(duration_ms AS DOUBLE), {q})', 3)} AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
       + " FROM a_api_sessions GROUP BY endpoint")
def latency_by_endpoint(t: Inputs):
    return u.latency_by_endpoint(t.a_api_sessions)


@query("o21_traffic_anomalies", f"""
WITH h AS (SELECT tenant, date_trunc('hour', ts) AS hb, count(*) AS n FROM a_api_sessions WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY ALL),
 l AS (SELECT tenant, max(hb) AS hb FROM h GROUP BY 1), c AS (SELECT h.* FROM h JOIN l USING (tenant, hb)),
 a AS (SELECT c.tenant, {dec_round('avg(h.n)', 1)} AS hourly_average FROM c JOIN h ON h.tenant = c.tenant AND h.hb < c.hb GROUP BY 1)
SELECT c.tenant, c.n AS current_hour_requests, hourly_average, {dec_round('c.n / nullif(hourly_average, 0)', 2)} AS spike_ratio FROM c JOIN a USING (tenant)
WHERE {dec_round('c.n / nullif(hourly_average, 0)', 2)} > 0.5""")
def traffic_anomalies(t: Inputs):
    return u.traffic_anomalies(t.a_api_sessions, t.events_as_of, 30 * 86400, 0.5)


@query("o22_request_counts", f"""
SELECT 'tenant_24h' AS kind, tenant AS "key", CAST(count(*) AS DOUBLE) AS value FROM a_api_sessions WHERE ts >= {NOW} - INTERVAL 1 DAY GROUP BY tenant
UNION ALL SELECT 'key_24h', tenant || '/' || key_name, count(*) FROM a_api_sessions WHERE ts >= {NOW} - INTERVAL 1 DAY GROUP BY ALL
UNION ALL SELECT 'previous_key_1h', key_id, count(*) FROM a_api_sessions WHERE ts >= {NOW} - INTERVAL 1 HOUR AND key_slot = 'previous' GROUP BY ALL
UNION ALL SELECT 'per_second', 'all', {dec_round('count(*) / 60.0', 2)} FROM a_api_sessions WHERE ts >= {NOW} - INTERVAL 1 MINUTE""")
def request_counts(t: Inputs):
    return u.request_counts(t.a_api_sessions, t.events_as_of)


# --- alerts and subscriptions --------------------------------------------------------------------------

# (id, tenant, metric, window, condition, threshold)
RULES = (("r1", "default", "error_rate", "24h", "above", 0.15), ("r2", "acme", "error_rate", "24h", "below", 0.15),
         ("r3", "default", "error_rate", "6h", "change_pct", 10.0), ("r4", "acme", "error_rate", "1h", "change_pct", -10.0),
         ("r5", "default", "error_rate", "5m", "change_pct", 5.0))
_RULE_VALUES = ", ".join(f"('{a}', '{b}', '{c}', '{d}', '{f}', CAST({g} AS DOUBLE), {m.WINDOWS[d]})" for a, b, c, d, f, g in RULES)
_ERR = """(SELECT coalesce(CAST(count(*) FILTER (WHERE topic = 'events.deadletter') AS DOUBLE) / nullif(count(*), 0), 0) FROM a_journal j WHERE j.tenant_id = r.tenant_id
   AND processed_at >= {a} - to_seconds(secs) AND processed_at <= {a})"""


@query("o23_alert_rules", f"""
WITH r AS (SELECT * FROM (VALUES {_RULE_VALUES}) AS v(alert_id, tenant_id, metric, win, condition, threshold, secs)),
 x AS (SELECT r.*, {even(_ERR.format(a=NOW), 4)} AS cur, {even(_ERR.format(a=f'({NOW} - to_seconds(secs))'), 4)} AS prev FROM r),
 y AS (SELECT *, CASE WHEN condition = 'change_pct' THEN CASE WHEN prev <> 0 THEN (cur - prev) / abs(prev) * 100 WHEN cur = 0 THEN 0 END END AS chg FROM x)
SELECT alert_id, tenant_id, metric, win AS "window", condition, threshold,
  CASE WHEN condition = 'above' THEN cur > threshold WHEN condition = 'below' THEN cur < threshold
       WHEN chg IS NOT NULL THEN CASE WHEN threshold >= 0 THEN chg >= threshold ELSE chg <= threshold END
       WHEN threshold >= 0 THEN cur > 0 ELSE cur < 0 END AS triggered,
  cur AS current_value, CASE WHEN condition = 'change_pct' THEN prev END AS previous_value, {even('chg', 4)} AS change_pct FROM y""")
def alert_rules(t: Inputs):
    rules = t.spark.createDataFrame(RULES, "alert_id string, tenant_id string, metric string, window string, condition string, threshold double")
    now = m.metric_matrix({"journal": t.a_journal}, {"journal": t.events_as_of}, ["error_rate"])
    past = None
    for window in sorted({r[3] for r in RULES}):
        # each rule looks one of its own windows back
        back = t.events_as_of - timedelta(seconds=m.WINDOWS[window])
        part = m.metric_matrix({"journal": t.a_journal}, {"journal": back}, ["error_rate"]).filter(F.col("window") == window)
        past = part if past is None else past.unionByName(part)
    return al.evaluate_rules(rules, now, past)


def ticks(t: Inputs):
    """Hourly evaluations of a failure rule per tenant and branch."""
    hour = F.date_trunc("hour", "processed_at")
    bad = F.avg((F.col("topic") == "events.deadletter").cast("double")) > 0.25
    return t.a_journal.groupBy(F.concat_ws("/", "tenant_id", F.coalesce("branch", F.lit("none"))).alias("alert_id"), hour.alias("tick_at")).agg(bad.alias("triggered"))


_TICKS = """(SELECT tenant_id || '/' || coalesce(branch, 'none') AS alert_id, date_trunc('hour', processed_at) AS tick_at, avg(CASE WHEN topic = 'events.deadletter' THEN 1.0 ELSE 0.0 END) > 0.25 AS triggered
FROM a_journal GROUP BY ALL)"""


@query("w05_flap_counts", f"""
WITH c AS (SELECT *, CASE WHEN coalesce(triggered <> lag(triggered) OVER (PARTITION BY alert_id ORDER BY tick_at), triggered) THEN 1 ELSE 0 END AS ch FROM {_TICKS})
SELECT alert_id, {ts_text('tick_at')} AS tick_at, triggered, changes, changes > 3 AS suppressed FROM (
  SELECT *, CAST(sum(ch) OVER (PARTITION BY alert_id ORDER BY tick_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS changes FROM c)""")
def flap_counts(t: Inputs):
    return al.flap_counts(ticks(t), 360, 3).withColumn("tick_at", iso("tick_at"))


@query("o24_due_steps", f"""
WITH f AS (SELECT alert_id, max(tick_at) FILTER (WHERE NOT triggered) AS quiet, max(tick_at) AS last_at, min(tick_at) AS first_at FROM {_TICKS} GROUP BY 1),
 g AS (SELECT alert_id, last_at, min(tick_at) AS fired_at FROM {_TICKS} JOIN f USING (alert_id) WHERE triggered AND (quiet IS NULL OR tick_at > quiet - INTERVAL 3 DAY) GROUP BY ALL),
 h AS (SELECT *, date_diff('second', fired_at, {NOW}) / 60.0 AS el FROM g)
SELECT alert_id, {ts_text('fired_at')} AS fired_at, CASE WHEN el >= 60 THEN 2 ELSE 3 END AS next_level FROM h WHERE el >= 60""")
def due_steps(t: Inputs):
    rows = ticks(t)
    quiet = rows.groupBy("alert_id").agg(F.max(F.when(~F.col("triggered"), F.col("tick_at"))).alias("quiet"))
    since = F.col("quiet").isNull() | (F.col("tick_at") > F.col("quiet") - F.expr("INTERVAL 3 DAYS"))
    fired = rows.join(quiet, "alert_id").filter(F.col("triggered") & since).groupBy("alert_id").agg(F.min("tick_at").alias("fired_at"))
    steps = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(mi).alias("after_minutes")) for lv, mi in ((1, 0), (2, 60), (3, 240))])
    alerts = fired.select("*", F.lit(1).alias("last_escalation_level"), F.col("fired_at").alias("last_triggered_at"), F.lit(30).alias("cooldown_minutes"), steps.alias("escalation"))
    return al.due_steps(alerts, t.events_as_of).select("alert_id", iso("fired_at").alias("fired_at"), "next_level")


def rule_ticks(t: Inputs):
    steps = F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(mi).alias("after_minutes")) for lv, mi in ((1, 0), (2, 60), (3, 240))])
    return ticks(t).select("*", steps.alias("escalation"), F.lit(True).alias("flap_enabled"), F.lit(360.0).alias("flap_minutes"),
                           F.lit(3).alias("flap_max"), F.lit(30.0).alias("cooldown_minutes"))


# The machine tick by tick: changes of the last six hours, awake again, changed, and then the new state.
STATES_SQL = f"""
WITH RECURSIVE tk AS (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY tick_at) AS k FROM {_TICKS}),
m AS (SELECT DISTINCT alert_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS tick_at, false AS triggered, 'ok' AS state, CAST(NULL AS VARCHAR) AS notification, 0 AS level,
    CAST(NULL AS TIMESTAMP) AS fired_at, CAST([] AS TIMESTAMP[]) AS changed FROM tk
  UNION ALL
  SELECT alert_id, k, tick_at, triggered,
    CASE WHEN state = 'suppressed' THEN state WHEN triggered THEN CASE WHEN fired_at IS NULL THEN 'firing' ELSE 'sustained' END WHEN fired_at IS NOT NULL THEN 'resolved' WHEN state = 'resolved' THEN 'ok' ELSE state END,
    CASE WHEN state = 'suppressed' THEN NULL WHEN triggered THEN CASE WHEN fired_at IS NULL THEN 'firing' WHEN step > level THEN 'escalated' END WHEN fired_at IS NOT NULL THEN 'resolved' END,
    CASE WHEN state = 'suppressed' THEN level WHEN triggered THEN CASE WHEN fired_at IS NULL THEN 1 ELSE greatest(level, coalesce(step, 0)) END WHEN fired_at IS NOT NULL THEN 0 ELSE level END,
    CASE WHEN state = 'suppressed' THEN fired_at WHEN triggered THEN coalesce(fired_at, tick_at) END, changed
  FROM (SELECT *, CASE WHEN level < 2 AND tick_at - fired_at >= INTERVAL 60 MINUTE THEN 2 WHEN level = 2 AND tick_at - fired_at >= INTERVAL 240 MINUTE THEN 3 END AS step
    FROM (SELECT alert_id, k, tick_at, triggered, changed, CASE WHEN over THEN 'suppressed' ELSE state END AS state, CASE WHEN over THEN 0 ELSE level END AS level, CASE WHEN NOT over THEN fired_at END AS fired_at
      FROM (SELECT * EXCLUDE (changed), turned AND len(changed) + 1 > 3 AS over, CASE WHEN turned THEN list_append(changed, tick_at) ELSE changed END AS changed
        FROM (SELECT alert_id, k, tick_at, triggered, kept AS changed, CASE WHEN awake THEN 'ok' ELSE state END AS state, CASE WHEN awake THEN 0 ELSE level END AS level,
            CASE WHEN NOT awake THEN fired_at END AS fired_at, triggered <> CASE WHEN awake THEN false ELSE was END AS turned
          FROM (SELECT *, state = 'suppressed' AND len(kept) <= 3 AS awake
            FROM (SELECT tk.alert_id, tk.k, tk.tick_at, tk.triggered, m.state, m.level, m.fired_at, m.triggered AS was, list_filter(m.changed, lambda c: tk.tick_at - c <= INTERVAL 360 MINUTE) AS kept
              FROM m JOIN tk ON tk.alert_id = m.alert_id AND tk.k = m.k + 1)))))))
SELECT alert_id, {ts_text('tick_at')} AS tick_at, triggered, state, notification, CAST(level AS INTEGER) AS level, {ts_text('fired_at')} AS fired_at, CAST(len(changed) AS INTEGER) AS changes FROM m WHERE k > 0"""


@query("o25_alert_states", STATES_SQL)
def alert_states(t: Inputs):
    return al.alert_states(rule_ticks(t)).withColumn("tick_at", iso("tick_at")).withColumn("fired_at", iso("fired_at"))


# (webhook, tenant, event types, ids, least amount)
HOOKS = (("h1", "default", ["order"], None, 300000.0), ("h2", "acme", ["order.status.shipped", "order.created"], None, None),
         ("h3", "default", None, ["ORD-19950101-10042"], None), ("h4", "acme", ["payment"], None, None))


def hooks(t: Inputs):
    return t.spark.createDataFrame(HOOKS, "webhook_id string, tenant_id string, event_types array<string>, entity_ids array<string>, min_amount double")


def hook_events(t: Inputs):
    return t.a_orders.select("tenant_id", F.concat(F.col("src_key").cast("string"), F.lit("-e")).alias("event_id"),
                             F.when(F.col("status") == "pending", "order.created").otherwise(F.concat(F.lit("order.status."), "status")).alias("event_type"),
                             F.col("order_id").alias("entity_id"), F.col("total_amount").alias("amount"), F.col("created_at").alias("processed_at"))


_HOOK_EVENTS = """(SELECT tenant_id, CAST(src_key AS VARCHAR) || '-e' AS event_id, CASE WHEN status = 'pending' THEN 'order.created' ELSE 'order.status.' || status END AS event_type, order_id AS entity_id,
  total_amount AS amount, created_at AS processed_at FROM a_orders)"""
_MATCHED = f"""(SELECT CASE WHEN tenant_id = 'default' THEN 'h1' ELSE 'h2' END AS webhook_id, event_id, event_type, processed_at FROM {_HOOK_EVENTS}
  WHERE (tenant_id = 'default' AND amount >= 300000) OR (tenant_id = 'acme' AND event_type IN ('order.status.shipped', 'order.created'))
  UNION ALL SELECT 'h3', event_id, event_type, processed_at FROM {_HOOK_EVENTS} WHERE tenant_id = 'default' AND entity_id = 'ORD-19950101-10042')"""


@query("j08_subscription_match", f"SELECT webhook_id, event_id, event_type FROM {_MATCHED}")
def subscription_match(t: Inputs):
    return al.match_subscriptions(hook_events(t), hooks(t)).select("webhook_id", "event_id", "event_type")


@query("o26_settled_matches", f"""SELECT webhook_id, event_id FROM {_MATCHED} WHERE processed_at <= {ORDERS_NOW} - INTERVAL 30 DAY
  AND (processed_at > {ORDERS_NOW} - INTERVAL 800 DAY OR (processed_at = {ORDERS_NOW} - INTERVAL 800 DAY AND event_id > '5'))""")
def settled_matches(t: Inputs):
    """Matches among settled rows strictly after the last delivered position."""
    now = t.orders_as_of
    rows = e.settled(hook_events(t), now, 30 * 86400)
    start = now - timedelta(days=800)
    rows = rows.filter((F.col("processed_at") > at(start)) | ((F.col("processed_at") == at(start)) & (F.col("event_id") > "5")))
    return al.match_subscriptions(rows, hooks(t)).select("webhook_id", "event_id")


@query("o27_settle_violations", f"""SELECT event_id, tenant_id FROM a_journal WHERE processed_at >= {NOW} - INTERVAL 11 DAY AND processed_at < {NOW} - INTERVAL 1 DAY
  AND event_id NOT IN (SELECT event_id FROM a_deliveries)""")
def settle_violations(t: Inputs):
    frontier = (t.events_as_of - timedelta(days=1), "")
    return al.settle_violations(t.a_journal, t.a_deliveries, frontier, 10 * 86400).select("event_id", "tenant_id")


# --- hash chain ------------------------------------------------------------------------------------------

BLOCK = 50


def audit_log(t: Inputs):
    """Logs of fifty API requests each: numbered from 1, each row's hash covering its number, its body and the hash before it."""
    number = F.col("request_id").cast("long")
    body = json_object({"endpoint": json_text(F.col("endpoint")), "status": json_number(F.col("status_code")), "tenant": json_text(F.col("tenant"))})
    rows = t.a_api_sessions.select(F.concat(F.lit("api-"), F.floor(number / BLOCK).cast("string")).alias("log"), (number % BLOCK + 1).alias("seq"), body.alias("body"))
    kind = "array<struct<seq:bigint,body:string,previous_hash:string,hash:string>>"

    def link(done, row):
        hashed = chain_hash(row["seq"], done["last"], row["body"])
        one = F.array(F.struct(row["seq"].alias("seq"), row["body"].alias("body"), done["last"].alias("previous_hash"), hashed.alias("hash")))
        return F.struct(F.concat(done["rows"], one).cast(kind).alias("rows"), hashed.alias("last"))

    # a log is a bounded block, so its rows may be folded in order; they grow a lot by that, so the number of partitions is kept
    # as the input asks for it: adaptive plans would merge them by the few bytes they have before
    blocks = rows.repartition(t.parts, "log").groupBy("log").agg(F.sort_array(F.collect_list(F.struct("seq", "body"))).alias("given"))
    linked = F.aggregate("given", F.struct(F.array().cast(kind).alias("rows"), F.lit("").alias("last")), link)
    log = blocks.select("log", F.inline(linked["rows"]))
    # some rows of failed requests have another predecessor written into them
    forged = F.col("body").contains("/v1/error") & (F.substring(F.sha2("body", 256), 1, 1) < "4") & (F.col("seq") % 3 == 0)
    return log.withColumn("previous_hash", F.when(forged, F.lit("forged")).otherwise(F.col("previous_hash")))


@query("w06_hash_chain", """
WITH b AS (SELECT 'api-' || (CAST(request_id AS BIGINT) // 50) AS log, CAST(request_id AS BIGINT) % 50 + 1 AS seq,
  '{"endpoint": "' || endpoint || '", "status": ' || status_code || ', "tenant": "' || tenant || '"}' AS body FROM a_api_sessions)
SELECT log, seq, problem FROM b, (VALUES ('hash'), ('previous_hash')) AS p(problem)
WHERE body LIKE '%/v1/error%' AND substr(sha256(body), 1, 1) < '4' AND seq % 3 = 0""")
def hash_chain(t: Inputs):
    return verify_chain(audit_log(t))
