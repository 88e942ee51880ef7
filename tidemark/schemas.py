"""Declared schemas: the event record, serving tables, lake tables, and how a frame is conformed to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# An event of any family. Scalars stay text until a rule has judged them.
ITEMS = "array<struct<product_id: string, quantity: string, unit_price: string>>"
EVENT_DDL = f"""event_id string, event_type string, timestamp string, source string, tenant string, user_id string,
    order_id string, status string, items {ITEMS}, total_amount string, currency string, created_at string,
    payment_id string, amount string, method string, failure_reason string,
    session_id string, page_url string, referrer string, user_agent string, viewport_width string,
    product_id string, name string, category string, price string, in_stock string, stock_quantity string,
    operation string, entity_type string, entity_id string, before string, after string,
    source_metadata map<string, string>"""

# A raw change record, as capture connectors emit it.
CHANGE_DDL = """before map<string, string>, after map<string, string>, op string, ts_ms bigint,
    source struct<connector: string, db: string, schema: string, table: string, lsn: bigint, txId: bigint,
                  file: string, pos: bigint, row: bigint, snapshot: string, ts_ms: bigint>"""

SERVING_DDL = {
    "orders_v2": "tenant_id string, order_id string, user_id string, status string, total_amount decimal(10,2), "
                 "currency string, created_at timestamp",
    "products_current": "tenant_id string, product_id string, name string, category string, price decimal(10,2), "
                        "in_stock boolean, stock_quantity int",
    "sessions_aggregated": "tenant_id string, session_id string, user_id string, started_at timestamp, "
                           "ended_at timestamp, duration_seconds double, event_count int, unique_pages int, "
                           "funnel_stage string, is_conversion boolean",
    "users_enriched": "tenant_id string, user_id string, total_orders int, total_spent decimal(10,2), "
                      "first_order_at timestamp, last_order_at timestamp, preferred_category string",
    "pipeline_events": "event_id string, topic string, tenant_id string, entity_id string, event_type string, "
                       "latency_ms int, processed_at timestamp, branch string",
}


def fields(ddl: str) -> list[T.StructField]:
    return T.StructType.fromDDL(ddl).fields


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Project to a declared schema: cast what is there, typed NULL for what is not."""
    return df.select(*[
        (F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in fields(ddl)])
