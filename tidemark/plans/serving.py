"""Queries of materialisation, sessions, entity reads and journal pages."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import enrich
from tidemark.functions.columns import at, iso, money, rounded
from tidemark.operators import entities as e
from tidemark.operators import serving as s
from tidemark.operators import sessions as ses
from tidemark.operators.latest import drop_known, latest_version
from tidemark.operators.metrics import table_counts
from tidemark.operators.tenancy import tenant_scope
from tidemark.plans.registry import Inputs, day_text, dec_round, query, ts_text

ORDERS_NOW = "(SELECT max(created_at) FROM a_orders)"
JOURNAL_NOW = "(SELECT max(processed_at) FROM a_journal)"


# --- scans and point reads -------------------------------------------------------------------

@query("src03_scan_entity", """
SELECT tenant_id, order_id, status, CAST(total_amount AS DOUBLE) AS total_amount FROM a_orders ORDER BY tenant_id, order_id LIMIT 500""")
def scan_orders(t: Inputs):
    return e.scan_entity(t.a_orders, "order_id", 500).select("tenant_id", "order_id", "status", money("total_amount").alias("total_amount"))


@query("src04_scan_entity_by_ids", """
SELECT tenant_id, user_id, total_orders FROM a_users
WHERE user_id IN (SELECT concat('USR-', CAST(10000 + user_id AS STRING)) FROM events WHERE event_type = 'purchase' AND value > 150)""")
def scan_by_ids(t: Inputs):
    ids = t.events.filter((F.col("event_type") == "purchase") & (F.col("value") > 150)).select(
        F.concat(F.lit("USR-"), (10000 + F.col("user_id")).cast("string")).alias("user_id"))
    return e.scan_entity_by_ids(t.a_users, "user_id", ids).select("tenant_id", "user_id", "total_orders")


@query("src07_read_entity", f"""
WITH probe AS (SELECT min(order_id) AS id FROM a_orders WHERE tenant_id = 'default')
SELECT order_id, status, {ts_text('created_at')} AS last_updated,
       CAST(epoch_us({ORDERS_NOW}) - epoch_us(created_at) AS DOUBLE) / 1000000 AS freshness_seconds
FROM a_orders WHERE tenant_id = 'default' AND order_id = (SELECT id FROM probe)""")
def read_order(t: Inputs):
    orders = tenant_scope(t.a_orders, "default")
    probe = orders.agg(F.min("order_id"))
    return e.read_entity(orders, "order_id", probe.scalar(), t.orders_as_of).select(
        "order_id", "status", iso("last_updated").alias("last_updated"), "freshness_seconds")


@query("t01_tenant_scope", "SELECT order_id, status FROM a_orders WHERE tenant_id = 'acme'")
def scoped_orders(t: Inputs):
    return tenant_scope(t.a_orders, "acme").select("order_id", "status")


# --- keyed materialisation -------------------------------------------------------------------

@query("m01_latest_version", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS rn FROM lineitem)
WHERE rn = 1""")
def latest_lines(t: Inputs):
    """The line items repeat keys: the newest ship date is the current version."""
    return latest_version(
        t.lineitem, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"],
        ["l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]).withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))


def order_log(t: Inputs):
    """Order events: created, and a later update (or delete, for returned urgent orders)."""
    o = t.a_orders.withColumn("event_id", F.concat(F.col("src_key").cast("string"), F.lit("-c")))
    created = o.withColumn("status", F.lit("pending")).withColumn("version", F.col("created_at")).withColumn(
        "event_type", F.lit("order.created")).withColumn("operation", F.lit("insert"))
    gone = F.col("status") == "cancelled"
    changed = o.filter(F.col("status") != "pending").withColumn(
        "event_id", F.concat(F.col("src_key").cast("string"), F.lit("-u"))).withColumn(
        "version", F.col("created_at") + F.expr("INTERVAL 1 HOUR")).withColumn(
        "event_type", F.when(gone, "order.deleted").otherwise("order.updated")).withColumn(
        "operation", F.when(gone, "delete").otherwise("update"))
    return created.unionByName(changed)


@query("m02_orders_current", """
SELECT tenant_id, order_id, user_id, status, CAST(total_amount AS DOUBLE) AS total_amount, currency, strftime(created_at, '%Y-%m-%d') AS created_at
FROM a_orders WHERE status <> 'cancelled'""")
def orders_current(t: Inputs):
    return s.order_snapshot(order_log(t), ["version", "event_id"]).select(
        "tenant_id", "order_id", "user_id", "status", money("total_amount").alias("total_amount"), "currency",
        F.date_format("created_at", "yyyy-MM-dd").alias("created_at"))


@query("m03_products_current", """
SELECT tenant_id, product_id, name, category, CAST(price AS DOUBLE) AS price, in_stock, stock_quantity FROM a_products""")
def products_current(t: Inputs):
    first = t.a_products.withColumn("price", F.col("price") * 2).withColumn("version", F.lit(1))
    log = first.unionByName(t.a_products.withColumn("price", F.col("price").cast(first.schema["price"].dataType))
                            .withColumn("version", F.lit(2)))
    return s.product_snapshot(log, ["version", "src_key"]).withColumn("price", money("price"))


@query("m04_user_profiles", f"""
SELECT tenant_id, user_id, total_orders, CAST(total_spent AS DOUBLE) AS total_spent, {day_text('first_order_at')} AS first_order_at,
       {day_text('last_order_at')} AS last_order_at FROM a_users""")
def user_profiles(t: Inputs):
    return t.a_users.select("tenant_id", "user_id", "total_orders", money("total_spent").alias("total_spent"),
                            F.date_format("first_order_at", "yyyy-MM-dd").alias("first_order_at"),
                            F.date_format("last_order_at", "yyyy-MM-dd").alias("last_order_at"))


_CATEGORY = """CASE WHEN page_url LIKE '%/products/%' THEN 'product_detail' WHEN page_url LIKE '%/cart%' THEN 'cart'
     WHEN page_url LIKE '%/checkout%' THEN 'checkout' WHEN page_url LIKE '%/search%' THEN 'search' WHEN page_url = '/' THEN 'home' ELSE 'other' END"""


@query("m05_session_fold", f"""
WITH c AS (SELECT *, {_CATEGORY} AS cat FROM a_events),
     r AS (SELECT *, CASE cat WHEN 'checkout' THEN 4 WHEN 'cart' THEN 3 WHEN 'product_detail' THEN 2 WHEN 'search' THEN 1 ELSE 0 END AS rk,
                  coalesce(session_id, 'unknown') AS sid FROM c),
     f AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, sid ORDER BY ts, src_key) AS seq,
                  row_number() OVER (PARTITION BY tenant_id, sid ORDER BY rk DESC, ts, src_key) AS best FROM r)
SELECT tenant_id, sid AS session_id, max(CASE WHEN seq = 1 THEN user_id END) AS user_id, {ts_text('min(ts)')} AS started_at,
       0.0 AS duration_seconds, count(*) AS event_count, 1 AS unique_pages, max(CASE WHEN best = 1 THEN cat END) AS funnel_stage,
       max(CASE WHEN best = 1 THEN cat END) = 'checkout' AS is_conversion
FROM f GROUP BY tenant_id, sid""")
def session_fold(t: Inputs):
    clicks = t.a_events.withColumn("page_category", enrich.page_category(F.col("page_url")))
    return s_fold(clicks)


def s_fold(clicks):
    return ses.fold_sessions(clicks).drop("ended_at").withColumn("started_at", iso("started_at"))


def applied_events(t: Inputs):
    """Journal input: the order log, with failures where the amount is out of range."""
    return order_log(t).select(
        "event_id", "tenant_id", "event_type", "order_id", "status", (F.col("total_amount") > 450000).alias("is_dead"),
        F.lit(12).alias("latency_ms"), F.col("version").alias("processed_at"), F.lit(None).cast("string").alias("branch"))


_ORDER_LOG = """
ol AS (SELECT concat(CAST(src_key AS STRING), '-c') AS event_id, tenant_id, 'order.created' AS event_type, order_id,
              'pending' AS status, total_amount, created_at AS version FROM a_orders
       UNION ALL
       SELECT concat(CAST(src_key AS STRING), '-u'), tenant_id,
              CASE WHEN status = 'cancelled' THEN 'order.deleted' ELSE 'order.updated' END, order_id, status, total_amount,
              created_at + INTERVAL 1 HOUR FROM a_orders WHERE status <> 'pending')"""


@query("m06_journal_rows", f"""
WITH {_ORDER_LOG}
SELECT event_id, CASE WHEN total_amount > 450000 THEN 'events.deadletter' ELSE 'events.validated' END AS topic, tenant_id,
       order_id AS entity_id, event_type, 12 AS latency_ms, {ts_text('version')} AS processed_at FROM ol
UNION ALL
SELECT concat(event_id, '-status'), 'orders.status', tenant_id, order_id, concat('order.status.', status), NULL, {ts_text('version')}
FROM ol WHERE total_amount <= 450000""")
def journal_rows(t: Inputs):
    return s.journal_rows(applied_events(t)).drop("branch").withColumn("processed_at", iso("processed_at"))


@query("m07_apply_batch", f"""
WITH {_ORDER_LOG},
     seen AS (SELECT DISTINCT tenant_id, event_id FROM ol WHERE version <= (SELECT max(version) - INTERVAL 400 DAY FROM ol)),
     fresh AS (SELECT * FROM ol ANTI JOIN seen USING (tenant_id, event_id))
SELECT count(*) FILTER (WHERE total_amount <= 450000) AS applied, count(*) FILTER (WHERE total_amount > 450000) AS dead,
       2 * (SELECT count(*) FROM ol) - count(*) AS duplicate FROM fresh""")
def apply_batch(t: Inputs):
    """A batch that carries every event twice, against a journal that already holds the older ones."""
    once = applied_events(t)
    journal = s.journal_rows(once).filter(F.col("processed_at") <= at(_newest_order_event(t) - timedelta(days=400)))
    batch = once.unionAll(once)
    return s.apply_counts(batch, s.unapplied(batch, journal))


def _newest_order_event(t: Inputs) -> datetime:
    from tidemark.sources.tables import latest_instant

    return latest_instant(order_log(t), "version")


@query("m08_edge_ingest", f"""
SELECT event_id, 'ekb' AS branch, topic FROM a_journal j
WHERE processed_at > {JOURNAL_NOW} - INTERVAL 10 DAY AND NOT EXISTS (
  SELECT 1 FROM a_journal k WHERE k.event_id = j.event_id AND k.tenant_id = j.tenant_id
     AND k.processed_at <= {JOURNAL_NOW} - INTERVAL 5 DAY)""")
def edge_ingest(t: Inputs):
    """An edge node resends its last ten days; the centre knows all but the last five."""
    now = t.events_as_of
    batch = t.a_journal.filter(F.col("processed_at") > at(now - timedelta(days=10)))
    centre = t.a_journal.filter(F.col("processed_at") <= at(now - timedelta(days=5)))
    return s.ingest_edge(batch, centre, "ekb").select("event_id", "branch", "topic")


@query("m08_edge_counts", f"""
WITH b AS (SELECT *, EXISTS (SELECT 1 FROM a_journal k WHERE k.event_id = j.event_id AND k.tenant_id = j.tenant_id AND k.processed_at <= {JOURNAL_NOW} - INTERVAL 5 DAY) AS known
  FROM a_journal j WHERE processed_at > {JOURNAL_NOW} - INTERVAL 10 DAY)
SELECT count(*) FILTER (WHERE NOT known AND topic = 'events.validated') AS applied, count(*) FILTER (WHERE NOT known AND topic = 'events.deadletter') AS dead,
  count(*) FILTER (WHERE known) + count(*) AS duplicate FROM b""")
def edge_counts(t: Inputs):
    """What the centre answers to a batch that holds every row twice: applied, dead, and known before or earlier in the batch."""
    now = t.events_as_of
    batch = t.a_journal.filter(F.col("processed_at") > at(now - timedelta(days=10))).withColumn("is_dead", F.col("topic") == "events.deadletter")
    centre = t.a_journal.filter(F.col("processed_at") <= at(now - timedelta(days=5)))
    twice = batch.unionAll(batch)
    return s.apply_counts(twice, s.unapplied(twice, centre))


@query("m09_dead_letter_replay", f"""
SELECT tenant_id, event_id, CASE WHEN failure_reason = 'parse' THEN status ELSE 'replay_pending' END AS status,
       retry_count + CASE WHEN failure_reason = 'parse' THEN 0 ELSE 1 END AS retry_count,
       CASE WHEN failure_reason = 'parse' THEN NULL ELSE 'events.replay' END AS topic,
       CASE WHEN failure_reason = 'parse' THEN 'Payment amount 0.10 is below minimum 0.50' END AS first_error
FROM a_dead_letters WHERE status = 'failed'""")
def dead_letter_replay(t: Inputs):
    """Failed payments get a corrected amount, except the unparsable ones, which keep a bad one."""
    dead = t.a_dead_letters.filter(F.col("status") == "failed").withColumn("payload", F.create_map(
        F.lit("event_type"), F.lit("payment.failed"), F.lit("amount"), F.lit("0.10"), F.lit("failure_reason"), F.lit("card")))
    fixes = dead.select("tenant_id", "event_id", F.when(F.col("failure_reason") == "parse", F.create_map(
        F.lit("failure_reason"), F.lit("declined"))).otherwise(F.create_map(F.lit("amount"), F.lit("12.00"))).alias("patch"))
    amount = F.try_element_at("payload", F.lit("amount")).cast("decimal(18,2)")
    errors = F.filter(F.array(F.when(amount < 0.5, F.concat(
        F.lit("Payment amount "), amount.cast("string"), F.lit(" is below minimum 0.50")))), lambda x: x.isNotNull())
    out = s.replay_dead_letters(dead, fixes, errors, t.events_as_of)
    return out.select("tenant_id", "event_id", "status", "retry_count", "topic", "first_error")


@query("m10_retry_schedule", f"""
SELECT event_id, CASE WHEN retry_count >= 4 THEN 'failed' ELSE 'pending' END AS status, retry_count,
       CASE WHEN retry_count < 4 THEN {ts_text("(SELECT max(ts) FROM events) + to_seconds(CASE WHEN failure_reason = 'parse' THEN greatest(CAST(power(2, retry_count) AS BIGINT), 30) ELSE CAST(power(2, retry_count) AS BIGINT) END)")} END AS next_attempt_at
FROM a_dead_letters""")
def retry_schedule(t: Inputs):
    pending = t.a_dead_letters.withColumn("last_error", F.when(F.col("failure_reason") == "parse", "KafkaError{code=_TRANSPORT}")
                                          .otherwise("timeout"))
    return s.schedule_retries(pending, t.events_as_of, 4).select(
        "event_id", "status", "retry_count", iso("next_attempt_at").alias("next_attempt_at"))


# --- sessions --------------------------------------------------------------------------------

@query("s06b_sessions", f"""
SELECT * REPLACE ({ts_text('started_at')} AS started_at, {ts_text('ended_at')} AS ended_at) FROM a_sessions""")
def sessions(t: Inputs):
    return t.a_sessions.withColumn("started_at", iso("started_at")).withColumn("ended_at", iso("ended_at"))


@query("s07_funnel", """
SELECT tenant_id, funnel_stage, count(*) AS sessions, count(*) FILTER (WHERE is_conversion) AS conversions FROM a_sessions GROUP BY ALL""")
def funnel(t: Inputs):
    return t.a_sessions.groupBy("tenant_id", "funnel_stage").agg(
        F.count("*").alias("sessions"), F.count_if("is_conversion").alias("conversions"))


@query("s10_value_sessions", f"""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, src_key) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM a_events),
     n AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, src_key ROWS UNBOUNDED PRECEDING) AS no,
                  sum(brk) OVER (PARTITION BY user_id) AS last_no FROM g)
SELECT user_id, {ts_text('min(ts)')} AS session_start, {ts_text('max(ts)')} AS session_end, count(*) AS event_count,
       CAST(sum(value) AS DOUBLE) AS total_value, CASE WHEN no < max(last_no) THEN 'closed' ELSE 'open' END AS status
FROM n GROUP BY user_id, no""")
def value_sessions(t: Inputs):
    return ses.value_sessions(t.a_events).withColumn("session_start", iso("session_start")).withColumn(
        "session_end", iso("session_end")).withColumn("total_value", money("total_value"))


# --- reads at an instant, pages ----------------------------------------------------------------

_ANCHOR = f"({ORDERS_NOW} - INTERVAL 700 DAY)"


@query("j09_entities_as_of", f"""
WITH past AS (SELECT entity_id, replace(event_type, 'order.status.', '') AS status, processed_at, 'journal' AS origin, 1 AS rk, event_id
              FROM a_stage_rows WHERE processed_at <= {_ANCHOR} AND event_id NOT LIKE '%-placed'),
     cur AS (SELECT order_id, status, created_at, 'current', 0, '' FROM a_orders WHERE created_at <= {_ANCHOR}),
     u AS (SELECT * FROM past UNION ALL SELECT * FROM cur),
     r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY rk DESC, processed_at DESC, event_id DESC) AS rn FROM u)
SELECT entity_id, status, {ts_text('processed_at')} AS last_updated, origin FROM r WHERE rn = 1""")
def orders_as_of(t: Inputs):
    snaps = t.a_stage_rows.filter(~F.col("event_id").endswith("-placed")).select(
        "entity_id", "processed_at", "event_id", F.regexp_replace("event_type", "order.status.", "").alias("status"))
    out = e.entities_as_of(snaps, t.a_orders, "order_id", t.orders_as_of - timedelta(days=700))
    return out.withColumn("last_updated", iso("last_updated"))


@query("l04_offset_page", """
SELECT order_id, CAST(total_amount AS DOUBLE) AS total_amount, 40 + row_number() OVER (ORDER BY total_amount DESC, order_id) AS position,
       true AS has_more, n AS total
FROM (SELECT order_id, total_amount, count(*) OVER () AS n FROM a_orders WHERE tenant_id = 'default' ORDER BY total_amount DESC, order_id LIMIT 20 OFFSET 40)""")
def offset_page(t: Inputs):
    order = [F.desc("total_amount"), F.asc("order_id")]
    page, total = e.offset_page(tenant_scope(t.a_orders, "default").select("order_id", "total_amount"), order, 40, 20)
    return page.select("order_id", money("total_amount").alias("total_amount"), "position", "has_more",
                       F.lit(total.scalar()).alias("total"))


_MID = f"({JOURNAL_NOW} - INTERVAL 15 DAY)"


@query("l05_keyset_page", f"""
SELECT event_id, topic, {ts_text('processed_at')} AS processed_at FROM a_journal
WHERE tenant_id = 'default' AND (processed_at > {_MID} OR (processed_at = {_MID} AND event_id > '0')) ORDER BY a_journal.processed_at, event_id LIMIT 200""")
def keyset_page(t: Inputs):
    return e.keyset_page(tenant_scope(t.a_journal, "default"), (t.events_as_of - timedelta(days=15), "0"), 200).select(
        "event_id", "topic", iso("processed_at").alias("processed_at"))


@query("l06_settled_rows", f"""
SELECT tenant_id, count(*) AS settled, {ts_text('max(processed_at)')} AS frontier FROM a_journal
WHERE processed_at <= {JOURNAL_NOW} - INTERVAL 3600 SECOND GROUP BY tenant_id""")
def settled_rows(t: Inputs):
    return e.settled(t.a_journal, t.events_as_of, 3600).groupBy("tenant_id").agg(
        F.count("*").alias("settled"), iso(F.max("processed_at")).alias("frontier"))


@query("l07_newest_events", f"""
SELECT event_id, entity_id, event_type FROM a_journal WHERE tenant_id = 'default' AND topic = 'events.validated' AND event_type = 'click'
ORDER BY processed_at DESC, event_id DESC LIMIT 50""")
def newest_events(t: Inputs):
    return e.newest_events(tenant_scope(t.a_journal, "default"), 50, event_family="click").select("event_id", "entity_id", "event_type")


@query("l08_bounded_scan", """
SELECT order_id, status, (SELECT count(*) FROM a_orders WHERE tenant_id = 'default' AND status IN ('pending', 'confirmed', 'shipped')) > 500 AS scan_truncated
FROM a_orders WHERE tenant_id = 'default' AND status IN ('pending', 'confirmed', 'shipped')
UNION ALL SELECT order_id, status, (SELECT count(*) FROM a_orders WHERE tenant_id = 'acme' AND status = 'cancelled') > 500 FROM a_orders WHERE tenant_id = 'acme' AND status = 'cancelled'""")
def bounded_scan(t: Inputs):
    """A scan that is longer than its bound, and one that may not be: all rows, with the flag of each scan."""
    open_orders = tenant_scope(t.a_orders, "default").filter(F.col("status").isin("pending", "confirmed", "shipped"))
    dropped = tenant_scope(t.a_orders, "acme").filter(F.col("status") == "cancelled")
    scans = [e.flagged_scan(rows, 500).select("order_id", "status", "scan_truncated") for rows in (open_orders, dropped)]
    return scans[0].unionByName(scans[1])


@query("j05_drop_known", """
SELECT event_id, tenant_id FROM a_journal j WHERE NOT EXISTS (SELECT 1 FROM a_deliveries d WHERE d.event_id = j.event_id AND d.tenant_id = j.tenant_id)""")
def drop_known_rows(t: Inputs):
    """Journal rows that no delivery knows yet."""
    return drop_known(t.a_journal, t.a_deliveries, ["tenant_id", "event_id"]).select("event_id", "tenant_id")


# --- joins and set operations ------------------------------------------------------------------

@query("j04_semi_join", """
SELECT product_hk, count(*) AS lines FROM a_lnk_order_product
WHERE order_hk IN (SELECT order_hk FROM a_hub_order WHERE record_source = 'mp__msk') GROUP BY product_hk""")
def semi_join(t: Inputs):
    chosen = t.a_hub_order.filter(F.col("record_source") == "mp__msk").select("order_hk")
    return t.a_lnk_order_product.join(chosen, "order_hk", "left_semi").groupBy("product_hk").agg(F.count("*").alias("lines"))


@query("j06_hour_vs_earlier_hours", """
WITH h AS (SELECT tenant, date_trunc('hour', ts) AS hb, count(*) AS n FROM a_api_sessions GROUP BY ALL)
SELECT c.tenant, strftime(c.hb, '%Y-%m-%d %H:%M:%S.%f') AS hour_bucket, c.n AS requests, count(e.hb) AS earlier_hours,
       coalesce(CAST(sum(e.n) AS BIGINT), 0) AS earlier_requests
FROM h c LEFT JOIN h e ON e.tenant = c.tenant AND e.hb < c.hb GROUP BY ALL""")
def hour_vs_earlier(t: Inputs):
    """Each hour against all earlier ones: a running window over hourly counts replaces the self join."""
    from pyspark.sql import Window

    hourly = t.a_api_sessions.groupBy("tenant", F.date_trunc("hour", "ts").alias("hb")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("tenant").orderBy("hb").rowsBetween(Window.unboundedPreceding, -1)
    return hourly.select("tenant", iso("hb").alias("hour_bucket"), F.col("n").alias("requests"),
                         F.count("*").over(before).alias("earlier_hours"),
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier_requests"))


@query("j10_share_by_scalar", f"""
SELECT status, count(*) AS orders, {dec_round('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM a_orders)', 4)} AS share FROM a_orders GROUP BY status""")
def share_by_scalar(t: Inputs):
    total = t.a_orders.agg(F.count("*").alias("n"))
    return t.a_orders.groupBy("status").agg(F.count("*").alias("orders")).select(
        "status", "orders", rounded(F.col("orders").cast("double") / F.lit(total.scalar()), 4).alias("share"))


@query("u02_distinct_identities", "SELECT DISTINCT tenant_id, user_id, event_type FROM a_events")
def distinct_identities(t: Inputs):
    return t.a_events.select("tenant_id", "user_id", "event_type").distinct()


@query("u03_unseen_ids", f"""
SELECT event_id FROM a_journal WHERE topic = 'events.validated'
EXCEPT SELECT event_id FROM a_deliveries WHERE status = 'delivered'""")
def unseen_ids(t: Inputs):
    seen = t.a_deliveries.filter(F.col("status") == "delivered")
    return drop_known(t.a_journal.filter(F.col("topic") == "events.validated"), seen, ["event_id"]).select("event_id")


@query("snk06_row_counts", """
SELECT 'orders' AS "table", count(*) AS row_count FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'missing', 0""")
def row_counts(t: Inputs):
    return table_counts({"orders": t.orders, "lineitem": t.lineitem, "events": t.events, "missing": None})


@query("l01_top_products", "SELECT product_id, name, CAST(price AS DOUBLE) AS price FROM a_products ORDER BY a_products.price DESC, product_id LIMIT 5")
def top_products(t: Inputs):
    return t.a_products.orderBy(F.desc("price"), "product_id").limit(5).select("product_id", "name", money("price").alias("price"))
