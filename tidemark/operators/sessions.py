"""Gap sessions over a table, and folds of session state.

A session of a key ends when the next event is more than the gap away. Events are first folded
into time cells no wider than the gap: two events of one key in one cell can never be separated,
so the gap test only has to look at cells. The fold is an ordinary partial aggregate, which keeps
a session key that owns a large share of all events from landing in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import seconds_between

GAP_SECONDS = 30 * 60
# Fixed limits of the session state: beyond so many distinct pages or products a session is flagged. Counts are true.
MAX_UNIQUE_PAGES = 1000
MAX_UNIQUE_PRODUCTS = 1000


def gap_cells(df: DataFrame, keys: Sequence[str], ts: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """(keys, cell) -> session number, from the first and last instant of every cell."""
    cells = df.groupBy(*keys, "cell").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    order = Window.partitionBy(*keys).orderBy("cell")
    starts = F.coalesce(
        seconds_between(F.lag("_last").over(order), F.col("_first")) > gap_seconds, F.lit(True))
    return (cells.withColumn("_new", starts.cast("int"))
            .withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            .select(*keys, "cell", "session_no"))


def with_cell(df: DataFrame, ts: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    return df.withColumn("cell", F.floor(F.unix_micros(F.col(ts)) / F.lit(gap_seconds * 1_000_000)))


def funnel_stage(checkout: Column, cart: Column, products: Column, events: Column) -> Column:
    return (F.when(checkout, "checkout").when(cart, "add_to_cart").when(products > 0, "product_view")
            .when(events > 1, "browse").otherwise("bounce"))


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS, tie: str = "src_key",
               max_pages: int = MAX_UNIQUE_PAGES, max_products: int = MAX_UNIQUE_PRODUCTS) -> DataFrame:
    """Sessions per (tenant, session id): bounds, counts, funnel stage, truncation flags."""
    keys = ["tenant_id", "session_id"]
    valid = with_cell(
        events.filter(F.coalesce(F.col("session_id"), F.lit("")) != "")
        .select(*keys, "user_id", "page_url", "product_id", "event_type", "ts", tie), "ts", gap_seconds)
    page = F.coalesce(F.col("page_url"), F.lit(""))
    # one row per key, cell, page and product: the only shuffle that sees raw events
    facts = (valid.withColumn("page", F.when(page != "", page))
             .withColumn("product", F.when(F.col("product_id") != "", F.col("product_id")))
             .groupBy(*keys, "cell", "page", "product")
             .agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"),
                  F.min_by(F.struct("user_id"), F.struct("ts", tie)).alias("who"),
                  F.min(F.struct("ts", tie)).alias("who_at"),
                  F.max(F.col("event_type") == "add_to_cart").alias("cart")))
    numbered = facts.join(gap_cells(
        facts.select(*keys, "cell", F.col("first_ts").alias("ts"))
        .unionAll(facts.select(*keys, "cell", F.col("last_ts").alias("ts"))), keys, "ts", gap_seconds),
        [*keys, "cell"])
    out = numbered.groupBy(*keys, "session_no").agg(
        F.min_by("who", "who_at").alias("who"),
        F.min("first_ts").alias("started_at"), F.max("last_ts").alias("ended_at"),
        F.sum("n").alias("event_count"),
        F.count_distinct("page").alias("pages"), F.count_distinct("product").alias("products"),
        F.max("cart").alias("cart"), F.coalesce(F.max(F.contains("page", F.lit("/checkout"))), F.lit(False))
        .alias("checkout"))
    return out.select(
        *keys, F.col("who.user_id").alias("user_id"), "started_at", "ended_at",
        seconds_between("started_at", "ended_at").alias("duration_seconds"), "event_count",
        F.col("pages").alias("unique_pages"), F.col("products").alias("products_viewed"),
        funnel_stage(F.col("checkout"), F.col("cart"), F.col("products"), F.col("event_count"))
        .alias("funnel_stage"),
        F.col("checkout").alias("is_conversion"),
        (F.col("pages") > max_pages).alias("pages_truncated"),
        (F.col("products") > max_products).alias("products_truncated"))


def value_sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Sessions per user with the summed value.

    Only a later event beyond the gap closes a session, so the last one of each user is `open`.
    """
    valid = with_cell(events.select("user_id", "ts", "value"), "ts", gap_seconds)
    facts = valid.groupBy("user_id", "cell").agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"),
        F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    order = Window.partitionBy("user_id").orderBy("cell")
    starts = F.coalesce(seconds_between(F.lag("last_ts").over(order), F.col("first_ts")) > gap_seconds, F.lit(True))
    numbered = (facts.withColumn("_new", starts.cast("int"))
                .withColumn("session_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("last_no", F.sum("_new").over(Window.partitionBy("user_id"))))
    return (numbered.groupBy("user_id", "session_no")
            .agg(F.min("first_ts").alias("session_start"), F.max("last_ts").alias("session_end"),
                 F.sum("n").alias("event_count"), F.sum("total").alias("total_value"),
                 F.max("last_no").alias("last_no"))
            .select("user_id", "session_start", "session_end", "event_count", "total_value",
                    F.when(F.col("session_no") < F.col("last_no"), "closed").otherwise("open").alias("status")))


# Fixed ranks of page categories in the serving funnel.
FUNNEL_RANK = {"checkout": 4, "cart": 3, "product_detail": 2, "search": 1, "home": 0, "other": 0}


def funnel_rank(category: Column) -> Column:
    rank = F.lit(0)
    for name, value in FUNNEL_RANK.items():
        rank = F.when(category == name, value).otherwise(rank)
    return rank


def fold_sessions(clicks: DataFrame, stored: DataFrame | None = None, tie: str = "src_key") -> DataFrame:
    """Serving-side session rows: first category, advanced only by a strictly higher rank.

    That is the category of the earliest event among those of the highest rank, so the whole fold
    is one aggregate. A stored row joins as event number zero carrying its own stage and count.
    """
    keys = ["tenant_id", "session_id"]
    rows = clicks.withColumn("session_id", F.coalesce("session_id", F.lit("unknown"))).select(
        *keys, "user_id", F.col("ts").alias("started_at"), F.lit(1).cast("long").alias("n"),
        F.lit(None).cast("timestamp").alias("ended_at"), F.lit(0.0).alias("duration_seconds"),
        F.lit(1).alias("unique_pages"), F.coalesce("page_category", F.lit("other")).alias("stage"),
        F.lit(1).alias("phase"), F.col("ts"), F.col(tie).alias("tie"))
    if stored is not None:
        rows = rows.unionByName(stored.select(
            *keys, "user_id", "started_at", F.col("event_count").cast("long").alias("n"), "ended_at",
            F.col("duration_seconds").cast("double").alias("duration_seconds"), "unique_pages",
            F.coalesce("funnel_stage", F.lit("bounce")).alias("stage"), F.lit(0).alias("phase"), F.col("started_at").alias("ts"),
            F.lit(None).cast(rows.schema["tie"].dataType).alias("tie")))
    order = F.struct("phase", "ts", "tie")
    folded = rows.groupBy(*keys).agg(
        F.min_by(F.struct("user_id", "started_at", "ended_at", "duration_seconds", "unique_pages"), order).alias("first"),
        F.sum("n").alias("event_count"),
        F.min_by("stage", F.struct(-funnel_rank(F.col("stage")), "phase", "ts", "tie")).alias("funnel_stage"))
    return folded.select(
        *keys, "first.user_id", "first.started_at", "first.ended_at", "first.duration_seconds", "event_count", "first.unique_pages", "funnel_stage",
        (F.col("funnel_stage") == "checkout").alias("is_conversion"))
