"""Derived fields of events, as column expressions over the event record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import half_even_exact
from tidemark.functions.rules import number
from tidemark.operators.tenancy import DEFAULT_TENANT

# Fixed thresholds of the derived fields.
SIZE_BUCKETS = (("small", 50), ("medium", 200), ("large", 1000))
MOBILE_MAX_WIDTH = 768
RISK_AMOUNTS = ((500, 0.3), (200, 0.1))
RISK_METHODS = (("card", 0.1), ("wallet", 0.15))
RISK_ANONYMOUS = 0.3
RISK_HIGH, RISK_MEDIUM = 0.5, 0.2
PROCESSOR_VERSION = "1.0.0"


def order_fields() -> Column:
    """item_count, unique_products, avg_item_price (banker's rounding to cents), order_size_bucket."""
    total = F.coalesce(number("total_amount"), F.lit(0).cast("decimal(24,6)"))
    count = F.aggregate("items", F.lit(0).cast("long"),
                        lambda n, i: n + F.coalesce(i["quantity"].try_cast("long"), F.lit(0)))
    count = F.coalesce(count, F.lit(0).cast("long"))
    products = F.coalesce(F.size(F.array_distinct(F.filter(
        F.transform("items", lambda i: i["product_id"]), lambda p: p.isNotNull()))), F.lit(0))
    bucket = F.lit("whale")
    for name, limit in reversed(SIZE_BUCKETS):
        bucket = F.when(total < limit, name).otherwise(bucket)
    return F.struct(count.alias("item_count"), products.alias("unique_products"),
                    F.when(count > 0, half_even_exact(total / F.nullif(count, F.lit(0).cast("long")), 2)).otherwise(F.lit(0.0)).alias("avg_item_price"),
                    bucket.alias("order_size_bucket"))


def page_category(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    return (F.when(url.contains("/products/"), "product_detail").when(url.contains("/cart"), "cart")
            .when(url.contains("/checkout"), "checkout").when(url.contains("/search"), "search")
            .when(url == "/", "home").otherwise("other"))


def click_fields() -> Column:
    width = F.col("viewport_width").try_cast("int")
    category = page_category(F.col("page_url"))
    return F.struct(F.coalesce(width < MOBILE_MAX_WIDTH, F.lit(False)).alias("is_mobile"), category.alias("page_category"),
                    (category == "product_detail").alias("is_product_page"))


def payment_fields() -> Column:
    """Additive risk score, capped at one, and its level."""
    amount = F.coalesce(number("amount").cast("double"), F.lit(0.0))
    by_amount = F.lit(0.0)
    for limit, points in reversed(RISK_AMOUNTS):
        by_amount = F.when(amount > limit, points).otherwise(by_amount)
    by_method = F.lit(0.0)
    for name, points in RISK_METHODS:
        by_method = F.when(F.col("method") == name, points).otherwise(by_method)
    anonymous = F.when(F.coalesce("user_id", F.lit("")) == "", RISK_ANONYMOUS).otherwise(0.0)
    score = by_amount + by_method + anonymous
    return F.struct(F.least(score, F.lit(1.0)).alias("risk_score"),
                    F.when(score > RISK_HIGH, "high").when(score >= RISK_MEDIUM, "medium").otherwise("low").alias("risk_level"))


def tenant(direct: Column, metadata: Column | None = None) -> Column:
    """The tenant of the event, else of its source metadata, else the default one."""
    options = [F.nullif(direct, F.lit(""))]
    if metadata is not None:
        options.append(F.nullif(F.try_element_at(metadata, F.lit("tenant")), F.lit("")))
    return F.coalesce(*options, F.lit(DEFAULT_TENANT))


def branch(metadata: Column) -> Column:
    return F.nullif(F.try_element_at(metadata, F.lit("branch")), F.lit(""))


def partition_key() -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("user_id", "order_id", "entity_id")], F.col("event_id"))


def latency_ms(now: Column, event_ts: Column) -> Column:
    """Whole milliseconds from the event to now; NULL where the event has no usable time."""
    return F.floor((F.unix_micros(now) - F.unix_micros(event_ts)) / 1000)
