"""Queries of the metric layer."""

from __future__ import annotations

import functools
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at, iso, money, ratio, rounded
from tidemark.operators import metrics as m
from tidemark.operators import sketches as sk
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.tenancy import tenant_scope
from tidemark.plans.registry import Inputs, dec_round, query, stored, ts_text

TENANT = "default"
ORDERS_NOW = "(SELECT max(created_at) FROM a_orders)"
EVENTS_NOW = "(SELECT max(ts) FROM events)"
JOURNAL_NOW = "(SELECT max(processed_at) FROM a_journal)"


def serving_sessions(t: Inputs):
    """Sessions as the serving table shows them: no end while the gap may still be extended."""
    open_since = t.events_as_of - timedelta(minutes=30)
    return t.a_sessions.withColumn("ended_at", F.when(F.col("ended_at") < at(open_since), F.col("ended_at")))


SERVING_SESSIONS = f"""(SELECT * REPLACE (CASE WHEN ended_at < {EVENTS_NOW} - INTERVAL 30 MINUTE THEN ended_at END AS ended_at)
                        FROM a_sessions)"""


def _tables(t: Inputs, *names: str):
    build = {"orders": lambda: t.a_orders, "sessions": lambda: serving_sessions(t), "journal": lambda: t.a_journal}
    return {n: build[n]() for n in names}


def _as_of(t: Inputs, table: str) -> datetime:
    return t.orders_as_of if table == "orders" else t.events_as_of


def _one_metric(t: Inputs, name: str, back: timedelta = timedelta(0)):
    """One tenant's metric in all its windows."""
    table = m.CATALOG[name].table
    scoped = {k: tenant_scope(v, TENANT) for k, v in _tables(t, table).items()}
    return m.metric_matrix(scoped, {table: _as_of(t, table) - back}, [name], by=())


_WINDOW_ROWS = ("(VALUES ('5m', 300), ('15m', 900), ('1h', 3600), ('6h', 21600), ('24h', 86400), ('now', 1800)) "
                "AS w(win, secs)")


def _metric_sql(name, unit, table, ts, now, agg, windows=_WINDOW_ROWS, tenant=True, extra=""):
    return f"""
SELECT {"tenant_id, " if not tenant else ""}'{name}' AS metric, '{unit}' AS unit, win AS "window",
       CAST(printf('%.4f', CAST(coalesce({agg}, 0) AS DOUBLE)) AS DOUBLE) AS value
FROM {windows} LEFT JOIN {table} ON {ts} >= {now} - to_seconds(secs) AND {ts} <= {now}
     AND tenant_id = '{TENANT}' {extra}
GROUP BY win"""


_REVENUE = "sum(CASE WHEN status <> 'cancelled' THEN total_amount END)"
_COUNT = "count(CASE WHEN status <> 'cancelled' THEN 1 END)"
_AVG = f"CAST({_REVENUE} AS DOUBLE) / nullif({_COUNT}, 0)"
_CONV = "CAST(count(CASE WHEN is_conversion THEN 1 END) AS DOUBLE) / nullif(count(is_conversion), 0)"
_ACTIVE = "count(CASE WHEN started_at IS NOT NULL AND ended_at IS NULL THEN 1 END)"
_ERRORS = "CAST(count(*) FILTER (WHERE topic = 'events.deadletter') AS DOUBLE) / nullif(count(topic), 0)"
_NOW_ONLY = "(VALUES ('now', 1800)) AS w(win, secs)"


@query("a01_metric_revenue", _metric_sql("revenue", "RUB", "a_orders", "created_at", ORDERS_NOW, _REVENUE))
def revenue(t: Inputs):
    return _one_metric(t, "revenue")


@query("a02_metric_order_count", _metric_sql("order_count", "count", "a_orders", "created_at", ORDERS_NOW, _COUNT))
def order_count(t: Inputs):
    return _one_metric(t, "order_count")


@query("a03_metric_avg_order_value", _metric_sql("avg_order_value", "RUB", "a_orders", "created_at", ORDERS_NOW, _AVG))
def avg_order_value(t: Inputs):
    return _one_metric(t, "avg_order_value")


@query("a04_metric_conversion_rate",
       _metric_sql("conversion_rate", "ratio", SERVING_SESSIONS, "started_at", EVENTS_NOW, _CONV))
def conversion_rate(t: Inputs):
    return _one_metric(t, "conversion_rate")


@query("a05_metric_active_sessions",
       _metric_sql("active_sessions", "count", SERVING_SESSIONS, "started_at", EVENTS_NOW, _ACTIVE, _NOW_ONLY))
def active_sessions(t: Inputs):
    return _one_metric(t, "active_sessions")


@query("a06_metric_error_rate", _metric_sql("error_rate", "ratio", "a_journal", "processed_at", JOURNAL_NOW, _ERRORS))
def error_rate(t: Inputs):
    return _one_metric(t, "error_rate")


def _matrix_rows(name, unit, table, ts, now, cells):
    """Conditional aggregates of one table, one output row per (tenant, window)."""
    rows = []
    for win, secs, agg in cells:
        inside = f"{ts} >= {now} - to_seconds({secs})"
        rows.append(f"""
SELECT tenant_id, '{name}' AS metric, '{unit}' AS unit, '{win}' AS "window",
       CAST(printf('%.4f', CAST(coalesce({agg.format(i=inside)}, 0) AS DOUBLE)) AS DOUBLE) AS value
FROM {table} WHERE {ts} >= {now} - INTERVAL 1 DAY AND {ts} <= {now} GROUP BY tenant_id""")
    return " UNION ALL ".join(rows)


_W = [(w, s) for w, s in m.WINDOWS.items()]
_F_REV = "sum(total_amount) FILTER (WHERE {i} AND status <> 'cancelled')"
_F_CNT = "count(*) FILTER (WHERE {i} AND status <> 'cancelled')"
_MATRIX_SQL = " UNION ALL ".join([
    _matrix_rows("revenue", "RUB", "a_orders", "created_at", ORDERS_NOW, [(w, s, _F_REV) for w, s in _W]),
    _matrix_rows("order_count", "count", "a_orders", "created_at", ORDERS_NOW, [(w, s, _F_CNT) for w, s in _W]),
    _matrix_rows("avg_order_value", "RUB", "a_orders", "created_at", ORDERS_NOW,
                 [(w, s, f"CAST({_F_REV} AS DOUBLE) / nullif({_F_CNT}, 0)") for w, s in _W]),
    _matrix_rows("conversion_rate", "ratio", SERVING_SESSIONS, "started_at", EVENTS_NOW,
                 [(w, s, "CAST(count(*) FILTER (WHERE {i} AND is_conversion) AS DOUBLE) / nullif(count(*) FILTER (WHERE {i}), 0)")
                  for w, s in _W]),
    _matrix_rows("active_sessions", "count", SERVING_SESSIONS, "started_at", EVENTS_NOW,
                 [("now", 1800, "count(*) FILTER (WHERE {i} AND ended_at IS NULL)")]),
    _matrix_rows("error_rate", "ratio", "a_journal", "processed_at", JOURNAL_NOW,
                 [(w, s, "CAST(count(*) FILTER (WHERE {i} AND topic = 'events.deadletter') AS DOUBLE) / nullif(count(*) FILTER (WHERE {i}), 0)")
                  for w, s in _W]),
])


@query("a07_metric_matrix", _MATRIX_SQL)
def metric_matrix(t: Inputs):
    tables = _tables(t, "orders", "sessions", "journal")
    return m.metric_matrix(tables, {n: _as_of(t, n) for n in tables})


_PAST = f"({ORDERS_NOW} - INTERVAL 365 DAY)"


@query("a08_metric_as_of", _metric_sql("revenue", "RUB", "a_orders", "created_at", _PAST, _REVENUE))
def revenue_as_of(t: Inputs):
    return _one_metric(t, "revenue", timedelta(days=365))


@query("a09_filtered_counts", """
SELECT tenant_id, count(*) FILTER (WHERE topic = 'events.deadletter') AS dead, count(*) FILTER (WHERE status_code >= 500) AS server_errors,
       count(*) FILTER (WHERE latency_ms IS NOT NULL) AS timed, count(*) AS total
FROM a_journal GROUP BY tenant_id""")
def filtered_counts(t: Inputs):
    return t.a_journal.groupBy("tenant_id").agg(
        F.count_if(F.col("topic") == "events.deadletter").alias("dead"),
        F.count_if(F.col("status_code") >= 500).alias("server_errors"),
        F.count("latency_ms").alias("timed"), F.count("*").alias("total"))


@query("a10_latency_quantiles", f"""
SELECT topic, {', '.join(f"{dec_round(f'quantile_cont(latency_ms, {q})', 4)} AS p{n}" for n, q in (('50', 0.5), ('95', 0.95), ('99', 0.99)))}
FROM a_journal WHERE latency_ms IS NOT NULL GROUP BY topic""")
def latency_quantiles(t: Inputs):
    found = exact_quantiles(t.a_journal, ["topic"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return found.select("topic", *[rounded(n, 4).alias(n) for n in ("p50", "p95", "p99")])


# Each day of shipment keeps a sketch of its orders for each flag; a report unions the sketches of its days.
_DISTINCT = """SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(*) AS line_items FROM lineitem {where} GROUP BY l_returnflag"""


@stored("order_sketches", "day", ("lineitem",), lambda rows: F.year("day"))
def order_sketches(t: Inputs):
    return sk.daily_sketches(t.lineitem.withColumn("day", F.to_date("l_shipdate")), ["l_returnflag"], "day", "l_orderkey")


@query("a11_approx_distinct_orders", f"SELECT l_returnflag, orders AS exact_orders, line_items, true AS within_one_percent FROM ({_DISTINCT.format(where='')})")
def approx_distinct_orders(t: Inputs):
    """The union of the stored sketches beside the exact count."""
    exact = t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("exact_orders"))
    return _beside(sk.union_of(t.stored("order_sketches"), ["l_returnflag"]), exact)


_SOME_DAYS = "l_shipdate >= TIMESTAMP '1994-03-01' AND l_shipdate < TIMESTAMP '1996-07-01'"


@query("a11_approx_distinct_days", f"SELECT l_returnflag, orders AS exact_orders, line_items, true AS within_one_percent FROM ({_DISTINCT.format(where='WHERE ' + _SOME_DAYS)})")
def approx_distinct_days(t: Inputs):
    """A range of days: the same sketches, fewer of them."""
    days = t.stored("order_sketches").filter((F.col("day") >= F.lit("1994-03-01").cast("date")) & (F.col("day") < F.lit("1996-07-01").cast("date")))
    exact = t.lineitem.filter((F.col("l_shipdate") >= F.lit("1994-03-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1996-07-01").cast("timestamp"))).groupBy("l_returnflag").agg(
        F.count_distinct("l_orderkey").alias("exact_orders"))
    return _beside(sk.union_of(days, ["l_returnflag"]), exact)


def _beside(estimates, exact):
    near = F.abs(F.col("estimate") - F.col("exact_orders")) <= 0.01 * F.col("exact_orders")
    return exact.join(estimates, "l_returnflag").select("l_returnflag", "exact_orders", F.col("rows").alias("line_items"), near.alias("within_one_percent"))


@query("a11_exact_distinct_orders", """
SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(*) AS line_items FROM lineitem GROUP BY l_returnflag""")
def exact_distinct_orders(t: Inputs):
    return (t.lineitem.groupBy("l_returnflag")
            .agg(F.count_distinct("l_orderkey").alias("orders"), F.count("*").alias("line_items")))


@query("a12_capped_distinct", """
SELECT tenant_id, session_id, count(DISTINCT page_url) AS unique_pages, count(DISTINCT page_url) > 20 AS pages_truncated,
       count(DISTINCT product_id) AS products_viewed, count(DISTINCT product_id) > 20 AS products_truncated
FROM a_events WHERE session_id IS NOT NULL GROUP BY tenant_id, session_id""")
def capped_distinct(t: Inputs):
    """Distinct counts, and whether they pass the limit that a stream's state would keep."""
    cap = 20
    return (t.a_events.filter(F.col("session_id").isNotNull()).groupBy("tenant_id", "session_id")
            .agg(F.count_distinct("page_url").alias("p"), F.count_distinct("product_id").alias("d"))
            .select("tenant_id", "session_id", F.col("p").alias("unique_pages"),
                    (F.col("p") > cap).alias("pages_truncated"), F.col("d").alias("products_viewed"),
                    (F.col("d") > cap).alias("products_truncated")))


@query("a14_conditional_sums", f"""
SELECT status, CAST(sum(CASE WHEN total_amount > 200000 THEN total_amount ELSE 0 END) AS DOUBLE) AS large_value,
       count(*) FILTER (WHERE total_amount > 200000) AS large_orders, count(*) AS orders
FROM a_orders GROUP BY status""")
def conditional_sums(t: Inputs):
    large = F.col("total_amount") > 200000
    return t.a_orders.groupBy("status").agg(
        money(F.sum(F.when(large, F.col("total_amount")).otherwise(F.lit(0).cast("decimal(18,2)")))).alias("large_value"),
        F.count_if(large).alias("large_orders"), F.count("*").alias("orders"))


_CURRENT = """(SELECT order_hk, total_amount FROM a_sat_header WHERE is_deleted = 0 QUALIFY row_number() OVER (PARTITION BY order_hk ORDER BY load_ts DESC, source DESC) = 1)"""


@query("a15_branch_share", f"""
SELECT split_part(record_source, '__', 2) AS branch, count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS revenue,
       {dec_round(f'CAST(sum(total_amount) AS DOUBLE) / CAST((SELECT sum(total_amount) FROM {_CURRENT}) AS DOUBLE)', 4)} AS share
FROM a_hub_order JOIN {_CURRENT} USING (order_hk) GROUP BY 1""")
def branch_share(t: Inputs):
    """Revenue of every branch over the current headers, whatever system the newest came from."""
    current = t.stored("orders").filter(F.col("header_source").isNotNull())
    per = current.groupBy("branch").agg(F.count("*").alias("orders"), F.sum("total_amount").alias("revenue"))
    # the window runs over one row per branch
    total = F.sum("revenue").over(Window.partitionBy())
    return per.select("branch", "orders", money("revenue").alias("revenue"), rounded(ratio("revenue", total), 4).alias("share"))


@query("a16_quality_report", f"""
SELECT 'orders_v2' AS "check", CAST(count(*) AS DOUBLE) AS value FROM a_orders
UNION ALL SELECT 'users_enriched', count(*) FROM a_users
UNION ALL SELECT 'products_current', count(*) FROM a_products
UNION ALL SELECT 'sessions_aggregated', count(*) FROM a_sessions
UNION ALL SELECT 'dead_letter_ratio', {dec_round("CAST(count(*) FILTER (WHERE topic = 'events.deadletter') AS DOUBLE) / count(*)", 4)} FROM a_journal""")
def quality_report(t: Inputs):
    counts = m.table_counts({"orders_v2": t.a_orders, "users_enriched": t.a_users, "products_current": t.a_products,
                             "sessions_aggregated": t.a_sessions})
    dead = t.a_journal.agg(rounded(F.coalesce(m._errors(F.lit(True)), F.lit(0.0)), 4).alias("value"))
    return counts.select(F.col("table").alias("check"), F.col("row_count").cast("double").alias("value")).unionByName(
        dead.select(F.lit("dead_letter_ratio").alias("check"), "value"))


@query("a16b_null_rates_and_deviation", f"""
WITH days AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n, count(*) - count(session_id) AS nulls FROM a_events GROUP BY 1),
     steps AS (SELECT *, lag(n) OVER (ORDER BY d) AS prev FROM days)
SELECT strftime(d, '%Y-%m-%d') AS day, n AS row_count, {dec_round('CAST(nulls AS DOUBLE) / n', 4)} AS null_rate,
       {dec_round('CAST(n - prev AS DOUBLE) / prev', 4)} AS deviation, coalesce(abs(n - prev) > 0.2 * prev, false) AS alert
FROM steps""")
def null_rates_and_deviation(t: Inputs):
    from pyspark.sql import Window

    days = t.a_events.groupBy(F.to_date("ts").alias("d")).agg(
        F.count("*").alias("n"), F.count_if(F.col("session_id").isNull()).alias("nulls"))
    prev = F.lag("n").over(Window.orderBy("d"))  # one row per day
    return days.withColumn("prev", prev).select(
        F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("n").alias("row_count"),
        rounded(ratio("nulls", "n"), 4).alias("null_rate"),
        rounded(ratio(F.col("n") - F.col("prev"), "prev"), 4).alias("deviation"),
        F.coalesce(F.abs(F.col("n") - F.col("prev")) > 0.2 * F.col("prev"), F.lit(False)).alias("alert"))


@query("a17_cross_branch_summary", f"""
SELECT b.branch, count(*) FILTER (WHERE topic = 'node.baseline') AS baseline,
       count(*) FILTER (WHERE topic IN ('events.validated', 'events.deadletter')) AS live_delta,
       {ts_text("max(processed_at) FILTER (WHERE topic IN ('events.validated', 'events.deadletter'))")} AS last_seen,
       CASE WHEN count(*) FILTER (WHERE topic IN ('events.validated', 'events.deadletter')) > 0 THEN 'live' ELSE 'waking' END AS status
FROM (VALUES ('msk'), ('spb'), ('ekb')) AS b(branch) LEFT JOIN a_journal j ON j.branch = b.branch GROUP BY b.branch""")
def cross_branch(t: Inputs):
    return m.cross_branch_summary(t.a_journal).withColumn("last_seen", iso("last_seen"))


_FAMILIES = ("a_ev_orders", "a_ev_payments", "a_ev_clicks", "a_ev_products", "a_ev_other")


@query("o30_metric_lineage", """
WITH cat(metric, source_event, source_table) AS (VALUES
""" + ",\n".join(f"('{a}', '{b}', '{c}')" for a, b, c, _, _ in m.metric_lineage()) + "),\nev AS ("
    + " UNION ALL ".join(f"SELECT event_type, TRY_CAST(timestamp AS TIMESTAMP) AS seen FROM {v}" for v in _FAMILIES) + """)
SELECT metric, source_table, source_event, count(e.event_type) AS journal_rows, strftime(max(seen), '%Y-%m-%d %H:%M:%S.%f') AS last_moved
FROM cat LEFT JOIN ev e ON e.event_type = cat.source_event GROUP BY ALL""")
def metric_lineage(t: Inputs):
    """Which event types move which metric, and when they last did; events of all families are counted per type first."""
    catalog = t.spark.createDataFrame(m.metric_lineage(), "metric string, source_event string, source_table string, unit string, sla int")
    every = functools.reduce(lambda a, b: a.unionByName(b), [t.table(v).select("event_type", F.col("timestamp").try_cast("timestamp").alias("at")) for v in _FAMILIES])
    moved = every.groupBy("event_type").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    return (catalog.join(moved, catalog["source_event"] == moved["event_type"], "left")
            .select("metric", "source_table", "source_event", F.coalesce("n", F.lit(0)).cast("long").alias("journal_rows"),
                    iso("last").alias("last_moved")))
