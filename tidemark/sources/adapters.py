"""Views that give the generic test tables the shape of serving, journal and vault tables.

Every view is one text in the common subset of Spark SQL and DuckDB, so the same definition feeds
a Spark query and the independent SQL it is checked against. `{name}` stands for a table or view.
"""

from __future__ import annotations

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_TENANT_O = "CASE WHEN o_custkey % 10 = 0 THEN 'acme' ELSE 'default' END"
_TENANT_E = "CASE WHEN user_id % 5 = 0 THEN 'acme' ELSE 'default' END"
_ORDER_ID = ("concat('ORD-', CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) "
             "AS STRING), '-', CAST(10000 + o_orderkey AS STRING))")
_STATUS = """CASE WHEN o_orderstatus = 'F' THEN 'delivered'
         WHEN o_orderstatus = 'O' THEN CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'confirmed' ELSE 'shipped' END
         ELSE CASE WHEN o_orderkey % 4 = 0 THEN 'cancelled' ELSE 'shipped' END END"""
_BRANCH = "CASE n_regionkey WHEN 0 THEN 'msk' WHEN 1 THEN 'spb' WHEN 2 THEN 'ekb' WHEN 3 THEN 'dxb' ELSE 'ala' END"
_CHANNEL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'd2c' WHEN '2-HIGH' THEN 'b2b' ELSE 'marketplace' END"
_K = "regexp_extract(props, '[0-9]+', 0)"

VIEWS: dict[str, str] = {
    "a_orders": f"""
SELECT {_TENANT_O} AS tenant_id, {_ORDER_ID} AS order_id,
       concat('USR-', CAST(10000 + o_custkey AS STRING)) AS user_id, {_STATUS} AS status,
       CAST(o_totalprice AS DECIMAL(18, 2)) AS total_amount, 'RUB' AS currency, o_orderdate AS created_at,
       o_orderkey AS src_key
FROM {{orders}}""",
    "a_products": """
SELECT 'default' AS tenant_id, concat('PROD-', CAST(p_partkey AS STRING)) AS product_id, p_name AS name,
       p_type AS category, CAST(p_retailprice AS DECIMAL(18, 2)) AS price,
       p_size < 49 AS in_stock, CAST(49 - p_size AS INT) AS stock_quantity, p_partkey AS src_key
FROM {part}""",
    "a_events": f"""
SELECT {_TENANT_E} AS tenant_id,
       concat(substr(md5(CAST(event_id AS STRING)), 1, 8), '-', substr(md5(CAST(event_id AS STRING)), 9, 4), '-',
              substr(md5(CAST(event_id AS STRING)), 13, 4), '-', substr(md5(CAST(event_id AS STRING)), 17, 4), '-',
              substr(md5(CAST(event_id AS STRING)), 21, 12)) AS event_id,
       CASE event_type WHEN 'click' THEN 'click' WHEN 'purchase' THEN 'add_to_cart' ELSE 'page_view' END AS event_type,
       CASE WHEN event_type = 'error' THEN NULL ELSE concat('SES-', CAST(user_id AS STRING)) END AS session_id,
       concat('USR-', CAST(10000 + user_id AS STRING)) AS user_id,
       CASE event_type WHEN 'click' THEN concat('/products/PROD-', {_K})
            WHEN 'view' THEN '/search' WHEN 'purchase' THEN CASE WHEN value < 60 THEN '/checkout' ELSE '/cart' END
            WHEN 'signup' THEN '/' ELSE '/other' END AS page_url,
       CASE WHEN event_type = 'click' THEN concat('PROD-', {_K}) ELSE NULL END AS product_id,
       CAST(320 + 20 * CAST({_K} AS INT) AS INT) AS viewport_width,
       CAST(value AS DECIMAL(18, 2)) AS value, ts, event_id AS src_key
FROM {{events}}""",
    "a_journal": f"""
SELECT CAST(event_id AS STRING) AS event_id,
       CASE WHEN event_type = 'error' THEN 'events.deadletter' ELSE 'events.validated' END AS topic,
       {_TENANT_E} AS tenant_id, concat('SES-', CAST(user_id AS STRING)) AS entity_id, event_type,
       CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS latency_ms,
       CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 500 ELSE 200 END AS status_code,
       CASE event_id % 3 WHEN 0 THEN 'msk' WHEN 1 THEN 'spb' ELSE NULL END AS branch, ts AS processed_at
FROM {{events}}""",
    # the trail of every order: placed, its present stage (unknown for one priority class), and for urgent
    # orders the next stage already journalled although the serving row still lags behind
    "a_stage_rows": f"""
SELECT concat(CAST(o_orderkey AS STRING), '-placed') AS event_id, 'orders.status' AS topic, {_TENANT_O} AS tenant_id,
       {_ORDER_ID} AS entity_id, 'order.status.pending' AS event_type, o_orderdate AS processed_at
FROM {{orders}}
UNION ALL
SELECT concat(CAST(o_orderkey AS STRING), '-status'), 'orders.status', {_TENANT_O}, {_ORDER_ID},
       concat('order.status.', {_STATUS}), o_orderdate + INTERVAL 10 MINUTE
FROM {{orders}} WHERE o_orderpriority <> '4-NOT SPECIFIED'
UNION ALL
SELECT concat(CAST(o_orderkey AS STRING), '-ahead'), 'orders.status', {_TENANT_O}, {_ORDER_ID},
       CASE {_STATUS} WHEN 'pending' THEN 'order.status.confirmed' ELSE 'order.status.shipped' END,
       o_orderdate + INTERVAL 70 MINUTE
FROM {{orders}} WHERE o_orderpriority = '1-URGENT' AND {_STATUS} IN ('pending', 'confirmed')""",
    "a_api_sessions": f"""
SELECT CAST(event_id AS STRING) AS request_id, {_TENANT_E} AS tenant,
       concat('key-', CAST(user_id % 4 AS STRING)) AS key_name,
       CASE WHEN user_id % 3 = 0 THEN 'previous' ELSE 'current' END AS key_slot,
       concat('kid-', CAST(user_id % 7 AS STRING)) AS key_id, concat('/v1/', event_type) AS endpoint,
       CASE WHEN event_type = 'error' THEN 500 WHEN event_id % 29 = 0 THEN 404 ELSE 200 END AS status_code,
       CAST(value AS DECIMAL(18, 2)) AS duration_ms, event_id % 3 = 0 AS cache_hit,
       CASE WHEN event_type = 'click' THEN 'product' ELSE NULL END AS entity_type,
       CASE WHEN event_type = 'click' THEN {_K} ELSE NULL END AS entity_id,
       CASE WHEN event_type = 'view' THEN concat('q', CAST(user_id % 12 AS STRING)) ELSE NULL END AS query_text, ts
FROM {{events}}""",
    "a_dead_letters": f"""
SELECT CAST(event_id AS STRING) AS event_id, {_TENANT_E} AS tenant_id, event_type,
       CASE event_id % 3 WHEN 0 THEN 'schema_validation' WHEN 1 THEN 'semantic_validation' ELSE 'parse' END AS failure_reason,
       concat('k=', {_K}) AS failure_detail,
       CASE event_id % 4 WHEN 0 THEN 'replay_pending' WHEN 1 THEN 'dismissed' ELSE 'failed' END AS status,
       CAST(event_id % 5 AS INT) AS retry_count, ts AS received_at,
       CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 HOUR ELSE NULL END AS last_retried_at
FROM {{events}} WHERE event_type = 'error'""",
    # deliveries of purchase events to two subscribers; one of them is unreachable
    "a_deliveries": f"""
SELECT CASE WHEN user_id % 2 = 0 THEN 'hook-a' ELSE 'hook-b' END AS webhook_id, CAST(event_id AS STRING) AS event_id,
       {_TENANT_E} AS tenant_id, CASE WHEN value > 120 THEN 'dead' ELSE 'delivered' END AS status,
       'timeout' AS last_error, ts + INTERVAL 5 MINUTE AS updated_at
FROM {{events}} WHERE event_type = 'purchase'""",
    "a_hub_order": f"""
SELECT md5(CAST(o_orderkey AS STRING)) AS order_hk, CAST(o_orderkey AS STRING) AS order_bk, o_orderdate AS load_ts,
       concat(CASE {_CHANNEL} WHEN 'd2c' THEN 'site' WHEN 'b2b' THEN 'bitrix' ELSE 'mp' END, '__', {_BRANCH}) AS record_source
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    # first version from 1c; a newer one from bitrix except for one priority class; some newest ones are tombstones
    "a_sat_header": f"""
SELECT md5(CAST(o_orderkey AS STRING)) AS order_hk, '1c' AS source, o_orderdate AS order_date, {_CHANNEL} AS channel,
       'pending' AS order_status, CAST(o_totalprice AS DECIMAL(18, 2)) AS total_amount, o_orderdate AS load_ts, 0 AS is_deleted
FROM {{orders}}
UNION ALL
SELECT md5(CAST(o_orderkey AS STRING)), 'bitrix', o_orderdate, {_CHANNEL},
       CASE WHEN o_orderstatus = 'P' THEN 'cancelled' ELSE 'delivered' END, CAST(o_totalprice AS DECIMAL(18, 2)),
       o_orderdate + INTERVAL 1 DAY, 0
FROM {{orders}} WHERE o_orderpriority <> '5-LOW'
UNION ALL
SELECT md5(CAST(o_orderkey AS STRING)), 'bitrix', o_orderdate, NULL, 'deleted', CAST(0 AS DECIMAL(18, 2)),
       o_orderdate + INTERVAL 2 DAY, 1
FROM {{orders}} WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P'""",
    "a_sat_pricing": """
SELECT md5(CAST(l_orderkey AS STRING)) AS order_hk,
       CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))), 2) AS DECIMAL(18, 2)) AS subtotal_amount,
       CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * CAST(l_discount AS DECIMAL(4, 2))), 2) AS DECIMAL(18, 2)) AS discount_amount,
       CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2))) * CAST(l_tax AS DECIMAL(4, 2))), 2) AS DECIMAL(18, 2)) AS tax_amount,
       CAST(10 * count(*) AS DECIMAL(18, 2)) AS shipping_cost, max(l_shipdate) AS load_ts, 0 AS is_deleted
FROM {lineitem} GROUP BY l_orderkey""",
    "a_sat_wb": f"""
SELECT md5(CAST(o_orderkey AS STRING)) AS order_hk,
       CASE o_orderstatus WHEN 'F' THEN 'sold' WHEN 'O' THEN 'sorting' ELSE 'returned' END AS wb_status,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) * CAST(0.15 AS DECIMAL(4, 2)) AS DECIMAL(18, 2)) AS wb_commission,
       o_orderdate + INTERVAL 14 DAY AS wb_return_window_until, o_orderdate AS load_ts, 0 AS is_deleted
FROM {{orders}} WHERE {_CHANNEL} = 'marketplace'""",
    "a_lnk_order_customer": """
SELECT md5(CAST(o_orderkey AS STRING)) AS order_hk, md5(CAST(o_custkey AS STRING)) AS customer_hk, o_orderdate AS load_ts
FROM {orders}""",
    "a_lnk_order_store": f"""
SELECT md5(CAST(o_orderkey AS STRING)) AS order_hk, md5(concat('store-', {_BRANCH})) AS store_hk, o_orderdate AS load_ts
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
WHERE {_CHANNEL} = 'd2c'""",
    "a_lnk_order_product": """
SELECT DISTINCT md5(CAST(l_orderkey AS STRING)) AS order_hk, md5(CAST(l_partkey AS STRING)) AS product_hk
FROM {lineitem}""",
    "a_hub_customer": f"""
SELECT md5(CAST(c_custkey AS STRING)) AS customer_hk, concat('CUST-', CAST(c_custkey AS STRING)) AS customer_bk,
       concat(CASE WHEN c_mktsegment = 'MACHINERY' THEN 'oltp' ELSE '1c' END, '__', {_BRANCH}) AS record_source,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS load_ts
FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "a_sat_personal": """
SELECT md5(CAST(c_custkey AS STRING)) AS customer_hk, c_name AS first_name, c_mktsegment AS last_name,
       concat('c', CAST(c_custkey AS STRING), '@old.example') AS email, '+7000' AS phone,
       CAST(CAST('1955-01-01' AS DATE) + CAST(c_nationkey * 700 AS INT) AS DATE) AS birth_date, 'person' AS legal_kind,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS load_ts, 0 AS is_deleted
FROM {customer}
UNION ALL
SELECT md5(CAST(c_custkey AS STRING)), c_name, c_mktsegment, concat('c', CAST(c_custkey AS STRING), '@new.example'),
       '+7111', CAST(CAST('1955-01-01' AS DATE) + CAST(c_nationkey * 700 AS INT) AS DATE), 'person',
       CAST('2024-02-01 00:00:00' AS TIMESTAMP), 0
FROM {customer} WHERE c_acctbal > 0
UNION ALL
SELECT md5(CAST(c_custkey AS STRING)), NULL, NULL, NULL, NULL, NULL, NULL, CAST('2024-03-01 00:00:00' AS TIMESTAMP), 1
FROM {customer} WHERE c_acctbal > 8000""",
    "a_sat_loyalty": """
SELECT md5(CAST(c_custkey AS STRING)) AS customer_hk,
       CASE WHEN c_acctbal > 6000 THEN 'gold' WHEN c_acctbal > 3000 THEN 'silver' ELSE 'base' END AS loyalty_segment,
       CAST(floor(abs(c_acctbal)) AS INT) AS loyalty_points,
       CAST('2024-04-01 00:00:00' AS TIMESTAMP) AS last_visit_at,
       CAST('2024-04-02 00:00:00' AS TIMESTAMP) AS load_ts, 0 AS is_deleted
FROM {customer} WHERE c_mktsegment <> 'HOUSEHOLD'""",
    # events of every family as text fields, with the defects the rules look for
    "a_ev_orders": f"""
SELECT concat(substr(md5(concat('o', CAST(o_orderkey AS STRING))), 1, 8), '-', substr(md5(concat('o', CAST(o_orderkey AS STRING))), 9, 4),
              '-4000-8000-', substr(md5(concat('o', CAST(o_orderkey AS STRING))), 13, 12)) AS event_id,
       CASE {_STATUS} WHEN 'cancelled' THEN 'order.cancelled' WHEN 'pending' THEN 'order.created' ELSE 'order.updated' END AS event_type,
       CAST(o_orderdate AS STRING) AS timestamp, 'shop-web' AS source, {_TENANT_O} AS tenant,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'ORDER?' ELSE {_ORDER_ID} END AS order_id,
       concat('USR-', CAST(10000 + o_custkey AS STRING)) AS user_id, {_STATUS} AS status,
       '1' AS q1, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) - 100 AS STRING) AS p1,
       CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN '0' ELSE '2' END AS q2, '50.00' AS p2,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) + CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS STRING) AS total_amount,
       CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' THEN 'CNY' WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE 'RUB' END AS currency
FROM {{orders}}""",
    "a_ev_payments": f"""
SELECT concat(substr(md5(concat('p', CAST(o_orderkey AS STRING))), 1, 8), '-', substr(md5(concat('p', CAST(o_orderkey AS STRING))), 9, 4),
              '-4000-8000-', CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'XYZ'
                             ELSE substr(md5(concat('p', CAST(o_orderkey AS STRING))), 13, 12) END) AS event_id,
       CASE o_orderstatus WHEN 'F' THEN 'payment.completed' WHEN 'O' THEN 'payment.initiated' ELSE 'payment.failed' END AS event_type,
       CAST(o_orderdate + INTERVAL 25 YEAR AS STRING) AS timestamp, 'billing' AS source, {_TENANT_O} AS tenant,
       concat('PAY-', CAST(o_orderkey AS STRING)) AS payment_id, {_ORDER_ID} AS order_id,
       CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('USR-', CAST(10000 + o_custkey AS STRING)) END AS user_id,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) - 1050 AS STRING) AS amount, 'RUB' AS currency,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'card' WHEN '2-HIGH' THEN 'wallet' WHEN '5-LOW' THEN 'cash' ELSE 'bank_transfer' END AS method,
       CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'initiated' ELSE 'failed' END AS status,
       CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN NULL WHEN o_orderstatus = 'P' THEN 'declined' ELSE NULL END AS failure_reason
FROM {{orders}}""",
    "a_ev_clicks": """
SELECT event_id, event_type, CAST(ts AS STRING) AS timestamp, 'web-sdk' AS source, tenant_id AS tenant, session_id, user_id, page_url,
       CASE WHEN page_url = '/' THEN NULL ELSE 'Mozilla/5.0' END AS user_agent, CAST(viewport_width AS STRING) AS viewport_width, product_id
FROM {a_events}""",
    "a_ev_products": """
SELECT concat(substr(md5(concat('i', CAST(p_partkey AS STRING))), 1, 8), '-', substr(md5(concat('i', CAST(p_partkey AS STRING))), 9, 4),
              '-4000-8000-', substr(md5(concat('i', CAST(p_partkey AS STRING))), 13, 12)) AS event_id,
       'product.updated' AS event_type, '2024-01-15 00:00:00' AS timestamp, 'catalogue' AS source, 'default' AS tenant,
       concat('PROD-', CAST(p_partkey AS STRING)) AS product_id, CASE WHEN p_size = 7 THEN '' ELSE p_name END AS name, p_type AS category,
       CAST(CAST(p_retailprice AS DECIMAL(18, 2)) * 110 AS STRING) AS price, 'RUB' AS currency,
       CASE WHEN p_size < 49 THEN 'true' ELSE 'false' END AS in_stock, CAST(49 - p_size AS STRING) AS stock_quantity
FROM {part}""",
    "a_ev_other": """
SELECT event_id, 'user.signup' AS event_type, CAST(ts AS STRING) AS timestamp, 'web-sdk' AS source, tenant_id AS tenant, user_id
FROM {a_events} WHERE page_url = '/'""",
    # captured row changes of orders: snapshot, insert, update and delete from two connectors, some of unmapped tables
    "a_changes": f"""
SELECT CASE o_orderstatus WHEN 'P' THEN 'd' WHEN 'F' THEN 'u' ELSE CASE WHEN o_orderpriority = '1-URGENT' THEN 'r' ELSE 'c' END END AS op,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'mysql' WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN 'oracle' ELSE 'postgresql' END AS connector,
       CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 'invoices' ELSE 'orders_v2' END AS tbl,
       {_ORDER_ID} AS order_id, concat('USR-', CAST(10000 + o_custkey AS STRING)) AS user_id, {_STATUS} AS status,
       CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS STRING) AS total_amount, o_orderkey AS lsn, o_custkey AS tx_id,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'cdc.mysql.orders' ELSE concat('cdc.postgres.', CASE WHEN o_custkey % 10 = 0 THEN 'acme' ELSE 'main' END) END AS topic,
       1600000000000 + o_orderkey * 1000 + 250 AS ts_ms
FROM {{orders}}""",
    # 13-digit codes: prefix, part number, check digit; the check digit is off by one for the largest parts
    "a_marking_body": """
SELECT p_partkey, p_size, concat(CASE WHEN p_size > 44 THEN '470' ELSE '460' END,
       substr(CAST(1000000000 + p_partkey AS STRING), 2, 9)) AS body
FROM {part}""",
    "a_marking": """
SELECT p_partkey, concat(body, CAST((10 - (
         CAST(substr(body, 1, 1) AS INT) + CAST(substr(body, 3, 1) AS INT) + CAST(substr(body, 5, 1) AS INT)
       + CAST(substr(body, 7, 1) AS INT) + CAST(substr(body, 9, 1) AS INT) + CAST(substr(body, 11, 1) AS INT)
       + 3 * (CAST(substr(body, 2, 1) AS INT) + CAST(substr(body, 4, 1) AS INT) + CAST(substr(body, 6, 1) AS INT)
       + CAST(substr(body, 8, 1) AS INT) + CAST(substr(body, 10, 1) AS INT) + CAST(substr(body, 12, 1) AS INT))
       + CASE WHEN p_size < 6 THEN 1 ELSE 0 END) % 10) % 10 AS STRING)) AS gs1_gtin,
       CASE WHEN p_size < 14 THEN 'issued' WHEN p_size < 42 THEN 'in_circulation' ELSE 'withdrawn' END AS marking_status
FROM {a_marking_body}""",
}

# Views whose Spark form is an operator of this package; the text is the independent SQL form.
SESSION_SQL = """
SELECT tenant_id, session_id, arg_min(user_id, ts) AS user_id, min(ts) AS started_at, max(ts) AS ended_at,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0 AS duration_seconds, count(*) AS event_count,
       count(DISTINCT nullif(page_url, '')) AS unique_pages,
       count(DISTINCT product_id) AS products_viewed,
       CASE WHEN bool_or(page_url LIKE '%/checkout%') THEN 'checkout'
            WHEN bool_or(event_type = 'add_to_cart') THEN 'add_to_cart'
            WHEN count(product_id) > 0 THEN 'product_view' WHEN count(*) > 1 THEN 'browse' ELSE 'bounce' END AS funnel_stage,
       bool_or(page_url LIKE '%/checkout%') AS is_conversion,
       count(DISTINCT nullif(page_url, '')) > 1000 AS pages_truncated, count(DISTINCT product_id) > 1000 AS products_truncated
FROM (SELECT *, sum(brk) OVER (PARTITION BY tenant_id, session_id ORDER BY ts, src_key ROWS UNBOUNDED PRECEDING) AS no
      FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY tenant_id, session_id ORDER BY ts, src_key) <= INTERVAL 30 MINUTE
                           THEN 0 ELSE 1 END AS brk
            FROM {a_events} WHERE session_id IS NOT NULL))
GROUP BY tenant_id, session_id, no"""

USERS_SQL = """
SELECT tenant_id, user_id, count(*) AS total_orders, sum(total_amount) AS total_spent, min(created_at) AS first_order_at,
       max(created_at) AS last_order_at
FROM {a_orders} WHERE status <> 'cancelled' GROUP BY tenant_id, user_id"""

# The canonical order view, customer master and marts, written with ranked rows and left joins.
CANONICAL_SQL = """
SELECT o.order_hk, o.order_bk, split_part(o.record_source, '__', 2) AS branch, c.customer_hk, st.store_hk, h.order_date, h.channel,
       h.order_status, h.total_amount, p.subtotal_amount, p.discount_amount, p.tax_amount, p.shipping_cost, m.wb_status,
       m.wb_commission, m.wb_return_window_until,
       CASE WHEN h.order_hk IS NOT NULL THEN h.source || '__' || split_part(o.record_source, '__', 2) END AS header_source,
       CASE WHEN p.order_hk IS NOT NULL THEN '1c__' || split_part(o.record_source, '__', 2) END AS pricing_source,
       CASE WHEN m.order_hk IS NOT NULL THEN 'wb__msk' END AS marketplace_source
FROM {a_hub_order} o
LEFT JOIN (SELECT * FROM {a_sat_header} WHERE is_deleted = 0 QUALIFY row_number() OVER (PARTITION BY order_hk ORDER BY load_ts DESC, source DESC) = 1) h USING (order_hk)
LEFT JOIN {a_sat_pricing} p USING (order_hk) LEFT JOIN {a_sat_wb} m USING (order_hk)
LEFT JOIN {a_lnk_order_customer} c USING (order_hk) LEFT JOIN {a_lnk_order_store} st USING (order_hk)"""

MASTER_SQL = """
SELECT h.customer_hk, h.customer_bk, split_part(h.record_source, '__', 2) AS branch, p.first_name, p.last_name, p.email, p.phone, p.birth_date,
       l.loyalty_segment, l.loyalty_points, l.last_visit_at,
       CASE WHEN p.customer_hk IS NOT NULL THEN '1c__' || split_part(h.record_source, '__', 2) END AS pii_source,
       CASE WHEN l.customer_hk IS NOT NULL THEN 'bitrix__' || split_part(h.record_source, '__', 2) END AS loyalty_source,
       greatest(coalesce(p.load_ts, TIMESTAMP '1970-01-01'), coalesce(l.load_ts, TIMESTAMP '1970-01-01')) AS last_seen_at
FROM {a_hub_customer} h
LEFT JOIN (SELECT * FROM {a_sat_personal} WHERE is_deleted = 0 QUALIFY row_number() OVER (PARTITION BY customer_hk ORDER BY load_ts DESC) = 1) p USING (customer_hk)
LEFT JOIN {a_sat_loyalty} l ON l.customer_hk = h.customer_hk AND split_part(h.record_source, '__', 2) IN ('msk', 'spb', 'ekb')"""

ORACLE_VIEWS = {**VIEWS, "a_sessions": SESSION_SQL, "a_users": USERS_SQL, "a_canonical": CANONICAL_SQL, "a_master": MASTER_SQL}
