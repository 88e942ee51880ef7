"""Queries of event validation, enrichment and change records."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import cdc, enrich, rules
from tidemark.functions.columns import at, iso
from tidemark.plans.registry import Inputs, query, ts_text
from tidemark.schemas import EVENT_DDL, conform
from tidemark.streaming import ingest

EVENTS_NOW = "(SELECT max(ts) FROM events)"
_ITEM = "struct<product_id:string,quantity:string,unit_price:string>"


def orders_as_events(t: Inputs) -> DataFrame:
    item = lambda n, p: F.struct(F.lit(p).alias("product_id"), F.col(f"q{n}").alias("quantity"),
                                 F.col(f"p{n}").alias("unit_price")).cast(_ITEM)
    return conform(t.a_ev_orders.withColumn("items", F.array(item(1, "PROD-1"), item(2, "PROD-2"))), EVENT_DDL)


def wide_events(t: Inputs) -> DataFrame:
    """Events of all families in the shape of the event record."""
    out = orders_as_events(t)
    for name in ("a_ev_payments", "a_ev_clicks", "a_ev_products", "a_ev_other"):
        out = out.unionByName(conform(t.table(name), EVENT_DDL))
    return out


def now(t: Inputs):
    return at(t.events_as_of)


_ALL = """(SELECT event_id, event_type, 'order' AS fam FROM a_ev_orders UNION ALL SELECT event_id, event_type, 'payment' FROM a_ev_payments
 UNION ALL SELECT event_id, event_type, 'click' FROM a_ev_clicks UNION ALL SELECT event_id, event_type, 'product' FROM a_ev_products
 UNION ALL SELECT event_id, event_type, 'unknown_event_type' FROM a_ev_other)"""


@query("v01_dispatch", f"SELECT fam AS family, event_type, count(*) AS events FROM {_ALL} GROUP BY ALL")
def dispatch(t: Inputs):
    return (wide_events(t).groupBy(F.coalesce(rules.family(), F.lit("unknown_event_type")).alias("family"), "event_type")
            .agg(F.count("*").alias("events")))


def _case(*pairs: tuple[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN NOT coalesce({ok}, false) THEN '{code}' END" for code, ok in pairs) + ")"


_BASE = [("event_id", "regexp_full_match(event_id, '[a-f0-9\\-]{36}')"),
         ("event_type", "event_type IN (" + ", ".join(f"'{e}'" for e in rules.EVENT_TYPES) + ")"),
         ("timestamp", f"TRY_CAST(timestamp AS TIMESTAMP) <= {EVENTS_NOW} + INTERVAL 300 SECOND"),
         ("source", "length(source) BETWEEN 1 AND 64")]
_CUR = ("currency", "coalesce(currency, 'RUB') IN ('RUB', 'USD', 'EUR', 'GBP')")
_OID = ("order_id", r"regexp_full_match(order_id, 'ORD-\d{8}-\d{4,}')")


@query("v02_base_rules", "SELECT event_id, errors FROM (" + " UNION ALL ".join(
    f"SELECT event_id, {_case(*_BASE)} AS errors FROM a_ev_{family}" for family in ("orders", "payments", "clicks", "products", "other")) + ") WHERE errors <> ''")
def base_rules(t: Inputs):
    found = F.filter(F.array(*rules.base_rules(now(t))), lambda x: x.isNotNull())
    return wide_events(t).select("event_id", F.array_join(found, ",").alias("errors")).filter("errors <> ''")


def _family_errors(t: Inputs, frame: DataFrame) -> DataFrame:
    return frame.select("event_id", F.array_join(rules.schema_errors(now(t)), ",").alias("errors")).filter("errors <> ''")


_ITEMS_TOTAL = "(CAST(q1 AS INT) * CAST(p1 AS DECIMAL(18,2)) + CAST(q2 AS INT) * CAST(p2 AS DECIMAL(18,2)))"
_ORDER_RULES = [*_BASE, _OID, ("user_id", "user_id IS NOT NULL"),
                ("status", "status IN ('pending', 'confirmed', 'shipped', 'delivered', 'cancelled')"),
                ("items", "true"), ("items.quantity", "CAST(q1 AS INT) BETWEEN 1 AND 1000 AND CAST(q2 AS INT) BETWEEN 1 AND 1000"),
                ("items.unit_price", "CAST(p1 AS DECIMAL(18,2)) > 0 AND CAST(p2 AS DECIMAL(18,2)) > 0"),
                ("total_amount", "CAST(total_amount AS DECIMAL(18,2)) > 0"),
                ("total_mismatch", f"abs(CAST(total_amount AS DECIMAL(18,2)) - {_ITEMS_TOTAL}) <= 0.01"), _CUR]
_PAYMENT_RULES = [*_BASE, ("payment_id", "payment_id IS NOT NULL"), _OID, ("user_id", "user_id IS NOT NULL"),
                  ("amount", "CAST(amount AS DECIMAL(18,2)) > 0"), _CUR,
                  ("method", "method IN ('card', 'bank_transfer', 'wallet')"),
                  ("status", "status IN ('initiated', 'completed', 'failed', 'refunded')")]
_CLICK_RULES = [*_BASE, *[(c, f"{c} IS NOT NULL") for c in ("session_id", "page_url", "user_agent")]]
_PRODUCT_RULES = [*_BASE, ("product_id", "product_id IS NOT NULL"), ("name", "length(name) BETWEEN 1 AND 500"),
                  ("category", "category IS NOT NULL"), ("price", "CAST(price AS DECIMAL(18,2)) >= 0"), _CUR,
                  ("in_stock", "in_stock IN ('true', 'false')"), ("stock_quantity", "CAST(stock_quantity AS INT) >= 0")]


def _errors_sql(view: str, checks) -> str:
    return f"SELECT event_id, errors FROM (SELECT event_id, {_case(*checks)} AS errors FROM {view}) WHERE errors <> ''"


@query("v03_order_rules", _errors_sql("a_ev_orders", _ORDER_RULES))
def order_rules(t: Inputs):
    return _family_errors(t, orders_as_events(t))


@query("v04_payment_rules", _errors_sql("a_ev_payments", _PAYMENT_RULES))
def payment_rules(t: Inputs):
    return _family_errors(t, conform(t.a_ev_payments, EVENT_DDL))


@query("v05_click_rules", _errors_sql("a_ev_clicks", _CLICK_RULES))
def click_rules(t: Inputs):
    return _family_errors(t, conform(t.a_ev_clicks, EVENT_DDL))


@query("v06_product_rules", _errors_sql("a_ev_products", _PRODUCT_RULES))
def product_rules(t: Inputs):
    return _family_errors(t, conform(t.a_ev_products, EVENT_DDL))


_SPLIT = " UNION ALL ".join(f"SELECT '{fam}' AS family, {_case(*checks)} AS errors FROM {view}" for fam, view, checks in (
    ("order", "a_ev_orders", _ORDER_RULES), ("payment", "a_ev_payments", _PAYMENT_RULES),
    ("click", "a_ev_clicks", _CLICK_RULES), ("product", "a_ev_products", _PRODUCT_RULES)))


@query("v08_valid_split", f"""
SELECT family, errors = '' AS valid, count(*) AS events FROM (
 {_SPLIT} UNION ALL SELECT 'none', 'unknown_event_type' FROM a_ev_other) GROUP BY ALL""")
def valid_split(t: Inputs):
    judged = wide_events(t).select(F.coalesce(rules.family(), F.lit("none")).alias("family"),
                                   (F.size(rules.schema_errors(now(t))) == 0).alias("valid"))
    return judged.groupBy("family", "valid").agg(F.count("*").alias("events"))


def _issues(frame: DataFrame) -> DataFrame:
    return frame.select("event_id", F.explode(rules.semantic_issues()).alias("i")).select("event_id", "i.rule", "i.severity", "i.field")


def _issue_sql(view: str, condition: str, rule: str, severity: str, field: str) -> str:
    return f"SELECT event_id, '{rule}' AS rule, '{severity}' AS severity, '{field}' AS field FROM {view} WHERE {condition}"


_V09 = _issue_sql("a_ev_orders", f"abs(CAST(total_amount AS DECIMAL(18,2)) - {_ITEMS_TOTAL}) > 0.01",
                  "order_total_consistency", "error", "total_amount")
_V10 = (_issue_sql("a_ev_payments", "CAST(amount AS DECIMAL(18,2)) < 0.5", "payment_min_amount", "error", "amount") + " UNION ALL "
        + _issue_sql("a_ev_payments", "CAST(amount AS DECIMAL(18,2)) > 50000", "payment_max_amount", "warning", "amount"))
_V11 = _issue_sql("a_ev_payments", "status = 'failed' AND failure_reason IS NULL", "payment_failure_reason_required", "warning", "failure_reason")
_V12 = _issue_sql("a_ev_clicks", "session_id IS NULL", "clickstream_session_required", "error", "session_id")
_V13 = _issue_sql("a_ev_products", "CAST(price AS DECIMAL(18,2)) > 100000", "product_price_sanity", "warning", "price")


@query("v09_order_total_consistency", _V09)
def order_total(t: Inputs):
    return _issues(orders_as_events(t))


@query("v10_payment_amount_bounds", _V10)
def payment_bounds(t: Inputs):
    return _issues(conform(t.a_ev_payments, EVENT_DDL)).filter(F.col("field") == "amount")


@query("v11_payment_failure_reason", _V11)
def payment_reason(t: Inputs):
    return _issues(conform(t.a_ev_payments, EVENT_DDL)).filter(F.col("field") == "failure_reason")


@query("v12_click_session_required", _V12)
def click_session(t: Inputs):
    return _issues(conform(t.a_ev_clicks, EVENT_DDL))


@query("v13_product_price_sanity", _V13)
def product_price(t: Inputs):
    return _issues(conform(t.a_ev_products, EVENT_DDL))


@query("v14_semantic_registry", f"""
WITH iss AS ({" UNION ALL ".join((_V09, _V10, _V11, _V12, _V13))}),
     per AS (SELECT a.event_id, a.fam, count(i.rule) AS issues, coalesce(bool_or(i.severity = 'error'), false) AS bad
             FROM {_ALL} a LEFT JOIN iss i ON i.event_id = a.event_id
                 AND ((a.fam = 'order' AND i.rule LIKE 'order%') OR (a.fam = 'payment' AND i.rule LIKE 'payment%')
                   OR (a.fam = 'click' AND i.rule LIKE 'click%') OR (a.fam = 'product' AND i.rule LIKE 'product%')) GROUP BY ALL)
SELECT fam AS family, count(*) AS events, count(*) FILTER (WHERE NOT bad) AS clean, CAST(sum(issues) AS BIGINT) AS issues FROM per GROUP BY fam""")
def semantic_registry(t: Inputs):
    judged = wide_events(t).select(F.coalesce(rules.family(), F.lit("unknown_event_type")).alias("family"),
                                   rules.semantic_issues().alias("issues"))
    return judged.groupBy("family").agg(F.count("*").alias("events"), F.count_if(~rules.has_error("issues")).alias("clean"),
                                        F.sum(F.size("issues")).cast("long").alias("issues"))


def change_frame(t: Inputs) -> DataFrame:
    """Raw change records as columns."""
    image = F.create_map(F.lit("order_id"), F.col("order_id"), F.lit("user_id"), F.col("user_id"),
                         F.lit("status"), F.col("status"), F.lit("total_amount"), F.col("total_amount"))
    pg = F.col("connector") != "mysql"
    return t.a_changes.select(
        F.when(F.col("op").isin("u", "d"), image).alias("before"), F.when(F.col("op") != "d", image).alias("after"), "op", "ts_ms", "topic",
        F.struct(F.col("connector"), F.lit("shop").alias("db"), F.lit("public").alias("schema"), F.col("tbl").alias("table"),
                 F.when(pg, F.col("lsn")).alias("lsn"), F.when(pg, F.col("tx_id")).alias("txId"),
                 F.when(~pg, "bin.01").alias("file"), F.when(~pg, F.col("lsn")).alias("pos"),
                 F.when(~pg, F.lit(0).cast("long")).alias("row"), F.lit("false").alias("snapshot"),
                 F.col("ts_ms").alias("ts_ms")).alias("source"))


# Topic patterns of two tenants; the second pattern also matches the first tenant's topics of one connector.
TENANT_SOURCES = (
    {"connector": "postgresql", "topic_pattern": "cdc.postgres.*", "tenant_id": "main"},
    {"connector": "postgresql", "topic_pattern": "cdc.postgres.ac[a-m]e", "tenant_id": "acme"},
)


def resolved_changes(t: Inputs) -> DataFrame:
    return cdc.resolve_tenants(change_frame(t), TENANT_SOURCES)


@query("c06_tenant_resolution", """
SELECT connector, topic, CASE WHEN connector <> 'postgresql' THEN 'no mapping' WHEN topic = 'cdc.postgres.acme' THEN 'ambiguous mapping' END AS tenant_error,
       CASE WHEN connector = 'postgresql' AND topic <> 'cdc.postgres.acme' THEN 'main' END AS tenant, count(*) AS records
FROM a_changes GROUP BY ALL""")
def tenant_resolution(t: Inputs):
    return resolved_changes(t).groupBy("source.connector", "topic", "tenant_error", "tenant").agg(F.count("*").alias("records"))


def demo_changes(t: Inputs) -> DataFrame:
    return cdc.normalize_changes(cdc.resolve_tenants(change_frame(t), (), "demo"))


_MAPPED = "connector <> 'oracle' AND tbl = 'orders_v2'"


@query("c02_change_mapping", f"""
SELECT CASE connector WHEN 'mysql' THEN 'mysql_cdc' WHEN 'postgresql' THEN 'postgres_cdc' END AS source_name,
       CASE op WHEN 'r' THEN 'snapshot' WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' ELSE 'delete' END AS operation,
       CASE WHEN tbl = 'orders_v2' THEN CASE op WHEN 'r' THEN 'order.snapshot' WHEN 'c' THEN 'order.created' WHEN 'u' THEN 'order.updated' ELSE 'order.deleted' END END AS event_type,
       CASE WHEN connector = 'oracle' THEN 'unsupported connector' WHEN tbl <> 'orders_v2' THEN 'unmapped table' END AS error, count(*) AS records
FROM a_changes GROUP BY ALL""")
def change_mapping(t: Inputs):
    kind = F.when(F.col("entity_type").isNotNull(), F.col("event_type")).alias("event_type")
    return demo_changes(t).groupBy("source_name", "operation", kind, "error").agg(F.count("*").alias("records"))


@query("c03_row_image", f"""
SELECT order_id AS entity_id, op = 'd' AS from_before, user_id, status, CAST(total_amount AS DOUBLE) AS total_amount FROM a_changes WHERE {_MAPPED}""")
def row_image(t: Inputs):
    field = lambda n: F.try_element_at("image", F.lit(n))
    return demo_changes(t).filter(F.col("error").isNull()).select(
        "entity_id", (F.col("operation") == "delete").alias("from_before"), field("user_id").alias("user_id"),
        field("status").alias("status"), field("total_amount").cast("double").alias("total_amount"))


@query("c04_change_event_id", f"""
WITH n AS (SELECT order_id, unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(
   '{{"entity_id": "' || order_id || '", "operation": "' ||
   CASE op WHEN 'r' THEN 'snapshot' WHEN 'c' THEN 'insert' WHEN 'u' THEN 'update' ELSE 'delete' END || '", "position": ' ||
   CASE WHEN connector = 'mysql' THEN '{{"file": "bin.01", "pos": ' || lsn || ', "row": 0}}'
        ELSE '{{"lsn": ' || lsn || ', "tx_id": ' || tx_id || '}}' END || ', "source": "' ||
   CASE connector WHEN 'mysql' THEN 'mysql_cdc' ELSE 'postgres_cdc' END || '", "table": "orders_v2", "tenant": "default"}}') AS b
   FROM a_changes WHERE {_MAPPED}),
     d AS (SELECT order_id, sha1(b) AS h FROM n)
SELECT order_id AS entity_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
       CASE WHEN substr(h, 17, 1) IN ('0','4','8','c') THEN '8' WHEN substr(h, 17, 1) IN ('1','5','9','d') THEN '9'
            WHEN substr(h, 17, 1) IN ('2','6','a','e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS event_id
FROM d""")
def change_event_id(t: Inputs):
    return demo_changes(t).filter(F.col("error").isNull()).select("entity_id", "event_id")


@query("c05_source_position", f"""
SELECT order_id AS entity_id, CASE WHEN connector = 'mysql' THEN '{{"file": "bin.01", "pos": ' || lsn || ', "row": 0}}'
        ELSE '{{"lsn": ' || lsn || ', "tx_id": ' || tx_id || '}}' END AS position, {ts_text('epoch_ms(ts_ms)')} AS event_ts FROM a_changes WHERE {_MAPPED}""")
def source_position(t: Inputs):
    return demo_changes(t).filter(F.col("error").isNull()).select("entity_id", "position", iso("event_ts").alias("event_ts"))


def raw_records(t: Inputs) -> DataFrame:
    """JSON records of every family, change records and broken ones, on their topics."""
    plain = wide_events(t).select(F.to_json(F.struct("*")).alias("value"), F.lit("events.raw").alias("topic"))
    changes = change_frame(t)
    body = F.struct(*[F.coalesce(F.to_json(c), F.lit("null")).alias(c) for c in ("before", "after", "source")])
    text = F.concat(F.lit('{"before":'), body["before"], F.lit(',"after":'), body["after"], F.lit(',"op":"'), F.col("op"),
                    F.lit('","ts_ms":'), F.col("ts_ms").cast("string"), F.lit(',"source":'), body["source"], F.lit("}"))
    broken = t.a_ev_other.select(F.concat(F.lit('{"event_id": "'), "event_id", F.lit('", "event_type": ')).alias("value"),
                                 F.lit("events.raw").alias("topic"))
    wrapped = t.a_ev_products.select(F.to_json(F.struct(
        F.struct(F.lit(1).alias("version"), F.lit("products.cdc").alias("topic")).alias(ingest.ENVELOPE_KEY),
        F.to_json(F.struct("*")).alias("value"))).alias("value"), F.lit("products.cdc").alias("topic"))
    return plain.unionByName(changes.select(text.alias("value"), "topic")).unionByName(broken).unionByName(wrapped)


def judged_records(t: Inputs) -> DataFrame:
    return ingest.judge(ingest.to_events(ingest.decode_envelope(raw_records(t))), t.events_as_of)


_PRODUCT_SPLIT = f"SELECT CASE WHEN {_case(*_PRODUCT_RULES)} <> '' THEN 'schema_validation' ELSE 'valid' END AS stage FROM a_ev_products"
_STAGES_SQL = f"""
SELECT stage, count(*) AS records FROM (
  SELECT CASE WHEN errors <> '' THEN 'schema_validation' ELSE 'valid' END AS stage FROM ({_SPLIT})
  UNION ALL {_PRODUCT_SPLIT}
  UNION ALL SELECT CASE WHEN NOT ({_MAPPED}) THEN 'cdc_normalization' ELSE 'valid' END FROM a_changes
  UNION ALL SELECT 'schema_validation' FROM a_ev_other UNION ALL SELECT 'parse' FROM a_ev_other)
"""


@query("v07_change_rules", f"""
SELECT CASE WHEN NOT ({_MAPPED}) THEN 'cdc_normalization' ELSE 'valid' END AS result, count(*) AS records FROM a_changes GROUP BY ALL""")
def change_rules(t: Inputs):
    only = judged_records(t).filter(F.col("is_change"))
    return only.groupBy(F.coalesce("stage", F.lit("valid")).alias("result")).agg(F.count("*").alias("records"))


@query("v15_dead_letters", _STAGES_SQL.replace("GROUP BY", "") + " WHERE stage <> 'valid' GROUP BY stage")
def dead_letters(t: Inputs):
    return ingest.dead_letters(judged_records(t)).groupBy("stage").agg(F.count("*").alias("records"))


@query("src02_decode_envelope", f"""
SELECT error, count(*) AS records FROM (
  SELECT NULL AS error FROM {_ALL} UNION ALL SELECT NULL FROM a_changes UNION ALL SELECT 'not a JSON object' FROM a_ev_other
  UNION ALL SELECT NULL FROM a_ev_products) GROUP BY error""")
def decode_envelope(t: Inputs):
    return ingest.decode_envelope(raw_records(t)).groupBy(F.col("decode_error").alias("error")).agg(F.count("*").alias("records"))


@query("c01_detect_changes", f"""
SELECT is_change, count(*) AS records FROM (SELECT false AS is_change FROM {_ALL} UNION ALL SELECT true FROM a_changes
  UNION ALL SELECT false FROM a_ev_other UNION ALL SELECT false FROM a_ev_products) GROUP BY is_change""")
def detect_changes(t: Inputs):
    return raw_records(t).groupBy(cdc.is_change_record(F.col("value")).alias("is_change")).agg(F.count("*").alias("records"))


# --- enrichment --------------------------------------------------------------------------------

@query("e01_order_fields", """
SELECT event_id, CAST(q1 AS INT) + CAST(q2 AS INT) AS item_count, 2 AS unique_products,
       CASE WHEN CAST(q1 AS INT) + CAST(q2 AS INT) > 0 THEN
            round_even(CAST(CAST(total_amount AS DECIMAL(18,2)) AS DOUBLE) / (CAST(q1 AS INT) + CAST(q2 AS INT)), 2) ELSE 0.0 END AS avg_item_price,
       CASE WHEN CAST(total_amount AS DOUBLE) < 50 THEN 'small' WHEN CAST(total_amount AS DOUBLE) < 200 THEN 'medium'
            WHEN CAST(total_amount AS DOUBLE) < 1000 THEN 'large' ELSE 'whale' END AS order_size_bucket
FROM a_ev_orders""")
def order_fields(t: Inputs):
    return orders_as_events(t).select("event_id", enrich.order_fields().alias("d")).select("event_id", "d.*")


@query("e02_click_fields", """
SELECT event_id, CAST(viewport_width AS INT) < 768 AS is_mobile,
       CASE WHEN page_url LIKE '%/products/%' THEN 'product_detail' WHEN page_url LIKE '%/cart%' THEN 'cart' WHEN page_url LIKE '%/checkout%' THEN 'checkout'
            WHEN page_url LIKE '%/search%' THEN 'search' WHEN page_url = '/' THEN 'home' ELSE 'other' END AS page_category,
       page_url LIKE '%/products/%' AS is_product_page FROM a_ev_clicks""")
def click_fields(t: Inputs):
    return conform(t.a_ev_clicks, EVENT_DDL).select("event_id", enrich.click_fields().alias("d")).select("event_id", "d.*")


@query("e03_payment_risk", """
WITH s AS (SELECT event_id, CASE WHEN CAST(amount AS DOUBLE) > 500 THEN 0.3 WHEN CAST(amount AS DOUBLE) > 200 THEN 0.1 ELSE 0.0 END::DOUBLE
   + CASE method WHEN 'card' THEN 0.1 WHEN 'wallet' THEN 0.15 ELSE 0.0 END::DOUBLE + CASE WHEN user_id IS NULL THEN 0.3 ELSE 0.0 END::DOUBLE AS score FROM a_ev_payments)
SELECT event_id, round(least(score, 1.0), 6) AS risk_score, CASE WHEN score > 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS risk_level FROM s""")
def payment_risk(t: Inputs):
    rows = conform(t.a_ev_payments, EVENT_DDL).select("event_id", enrich.payment_fields().alias("d"))
    return rows.select("event_id", F.round("d.risk_score", 6).alias("risk_score"), "d.risk_level")


@query("e04_tenant", """
SELECT src, tenant, count(*) AS events FROM (
  SELECT 'direct' AS src, tenant FROM a_ev_orders UNION ALL SELECT 'metadata', tenant FROM a_ev_payments UNION ALL SELECT 'none', 'default' FROM a_ev_products)
GROUP BY ALL""")
def tenant(t: Inputs):
    rows = (t.a_ev_orders.select(F.lit("direct").alias("src"), "tenant", F.lit(None).cast("map<string,string>").alias("m"))
            .unionByName(t.a_ev_payments.select(F.lit("metadata").alias("src"), F.lit("").alias("tenant"),
                                                F.create_map(F.lit("tenant"), F.col("tenant")).alias("m")))
            .unionByName(t.a_ev_products.select(F.lit("none").alias("src"), F.lit(None).cast("string").alias("tenant"),
                                                F.create_map(F.lit("branch"), F.lit("msk")).alias("m"))))
    return rows.groupBy("src", enrich.tenant(F.col("tenant"), F.col("m")).alias("tenant")).agg(F.count("*").alias("events"))


@query("e05_processing_metadata", f"""
SELECT event_id, CAST(floor((epoch_us({EVENTS_NOW}) - epoch_us(ts)) / 1000) AS BIGINT) AS latency_ms, user_id AS partition_key, '1.0.0' AS processor_version
FROM a_events""")
def processing_metadata(t: Inputs):
    judged = ingest.judge(conform(t.a_ev_clicks, EVENT_DDL), t.events_as_of)
    return judged.select("event_id", F.col("pipeline_latency_ms").alias("latency_ms"), "partition_key", "processor_version")


@query("e06_journal_entity", """
SELECT entity_id, count(*) AS events FROM (SELECT order_id AS entity_id FROM a_ev_orders UNION ALL SELECT product_id FROM a_ev_products
 UNION ALL SELECT user_id FROM a_ev_other UNION ALL SELECT NULL FROM a_ev_payments UNION ALL SELECT NULL FROM a_ev_clicks) GROUP BY entity_id""")
def journal_entity(t: Inputs):
    from tidemark.operators.serving import journal_entity as entity

    rows = wide_events(t)
    return rows.groupBy(entity(rows).alias("entity_id")).agg(F.count("*").alias("events"))


@query("e07_branch", """
SELECT branch, count(*) AS events FROM a_journal GROUP BY branch""")
def branch(t: Inputs):
    meta = t.a_journal.withColumn("source_metadata", F.create_map(F.lit("branch"), F.coalesce("branch", F.lit(""))))
    return meta.groupBy(enrich.branch(F.col("source_metadata")).alias("branch")).agg(F.count("*").alias("events"))


@query("e08_servable", f"""
SELECT reason, count(*) AS records FROM (
  SELECT CASE WHEN NOT ({_MAPPED}) THEN 'missing_event_id' END AS reason FROM a_changes
  UNION ALL SELECT NULL FROM a_ev_orders UNION ALL SELECT NULL FROM a_ev_payments UNION ALL SELECT NULL FROM a_ev_clicks
  UNION ALL SELECT NULL FROM a_ev_products UNION ALL SELECT NULL FROM a_ev_products
  UNION ALL SELECT 'non_canonical_event_type' FROM a_ev_other UNION ALL SELECT 'undecodable' FROM a_ev_other) GROUP BY reason""")
def servable(t: Inputs):
    events = judged_records(t).withColumn("event_id", F.when(F.coalesce("stage", F.lit("")) != "cdc_normalization", F.col("event_id")))
    return events.groupBy(ingest.servability(events).alias("reason")).agg(F.count("*").alias("records"))


@query("s01_event_time", f"""
SELECT placed, count(*) AS records FROM (SELECT 'event' AS placed FROM {_ALL} UNION ALL SELECT 'event' FROM a_changes UNION ALL SELECT 'event' FROM a_ev_products
  UNION ALL SELECT 'arrival' FROM a_ev_other) GROUP BY placed""")
def event_time(t: Inputs):
    """Records are placed by their own time, broken ones by their arrival."""
    arrival = F.lit("2030-01-01").cast("timestamp")
    raw = raw_records(t).withColumn("ingest_ts", arrival)
    judged = ingest.judge(ingest.to_events(ingest.decode_envelope(raw)), t.events_as_of)
    return judged.groupBy(F.when(F.col("event_ts") == arrival, "arrival").otherwise("event").alias("placed")).agg(F.count("*").alias("records"))
