"""Templated questions as functions with typed parameters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import at, ratio, rounded, seconds_before


def _since(df: DataFrame, ts: str, as_of: datetime, seconds: int) -> DataFrame:
    return df.filter((F.col(ts) >= seconds_before(at(as_of), seconds)) & (F.col(ts) <= at(as_of)))


def order_by_id(orders: DataFrame, order_id) -> DataFrame:
    return orders.filter(F.col("order_id") == order_id)


def revenue_in_window(orders: DataFrame, as_of: datetime, seconds: int = 3600) -> DataFrame:
    live = _since(orders, "created_at", as_of, seconds).filter(F.col("status") != "cancelled")
    return live.agg(F.sum("total_amount").cast("double").alias("revenue"))


def average_order(orders: DataFrame, as_of: datetime, seconds: int = 3600) -> DataFrame:
    live = _since(orders, "created_at", as_of, seconds).filter(F.col("status") != "cancelled")
    return live.agg(ratio(F.sum("total_amount"), F.count("*")).alias("avg_order_value"))


def top_products(products: DataFrame, k: int = 5) -> DataFrame:
    return products.orderBy(F.desc("price"), "product_id").limit(k).select("name", "category", "price", "stock_quantity")


def conversions(sessions: DataFrame, as_of: datetime, seconds: int = 3600) -> DataFrame:
    rows = _since(sessions, "started_at", as_of, seconds)
    return rows.agg(F.count_if("is_conversion").alias("conversions"), F.count("*").alias("total_sessions"),
                    rounded(ratio(F.count_if("is_conversion"), F.count("*")) * 100, 2).alias("conversion_pct"))


def user_by_id(users: DataFrame, user_id) -> DataFrame:
    return users.filter(F.col("user_id") == user_id)


def out_of_stock(products: DataFrame) -> DataFrame:
    return products.filter(~F.col("in_stock") | (F.col("stock_quantity") == 0)).select("product_id", "name", "category", "stock_quantity")


def active_sessions(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """The question's own definition: not ended, or ended in the last half hour."""
    recent = F.col("ended_at") >= seconds_before(at(as_of), 1800)
    return sessions.filter(F.col("ended_at").isNull() | recent).agg(F.count("*").alias("active_sessions"))


def cancelled_count(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count_if(F.col("status") == "cancelled").alias("n"))


def orders_per_status(orders: DataFrame) -> DataFrame:
    return orders.groupBy("status").agg(F.count("*").alias("n"))


def dearest_product(products: DataFrame) -> DataFrame:
    return products.orderBy(F.desc("price"), "product_id").limit(1).select("name")


def products_in_category(products: DataFrame, category: str) -> DataFrame:
    return products.agg(F.count_if(F.col("category") == category).alias("n"))


def order_total(orders: DataFrame) -> DataFrame:
    return orders.agg(F.count("*").alias("n"))


def top_spender(users: DataFrame) -> DataFrame:
    return users.orderBy(F.desc("total_spent"), "user_id").limit(1).select("user_id")


def average_price(products: DataFrame) -> DataFrame:
    return products.agg(ratio(F.sum("price"), F.count("*")).alias("avg_price"))


def converted_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.agg(F.count_if("is_conversion").alias("n"))


def categories(products: DataFrame) -> DataFrame:
    return products.select("category").distinct()


def user_count(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("n"))
