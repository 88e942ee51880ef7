"""Business vault and marts: canonical orders, customer master, profit and loss, returns, access views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import ratio, rounded
from tidemark.operators.latest import latest_version

ANALYST_COLUMNS = ("customer_hk", "customer_bk", "branch", "loyalty_segment", "loyalty_points", "last_visit_at",
                   "pii_source", "loyalty_source", "last_seen_at")  # fixed allow list
PII_COLUMNS = ("first_name", "last_name", "email", "phone", "birth_date")
SOURCE_RANK = {"bitrix": 2, "1c": 1}
CANONICAL_COLUMNS = ("order_hk", "order_bk", "branch", "customer_hk", "store_hk", "order_date", "channel", "order_status", "total_amount",
                     "subtotal_amount", "discount_amount", "tax_amount", "shipping_cost", "wb_status", "wb_commission",
                     "wb_return_window_until", "header_source", "pricing_source", "marketplace_source")
# what each mart reads of the canonical orders
PNL_COLUMNS = ("branch", "order_date", "order_status", "total_amount", "subtotal_amount", "discount_amount", "tax_amount", "shipping_cost")
CUSTOMER_COLUMNS = ("branch", "customer_hk", "order_date", "order_status", "total_amount")
VELOCITY_COLUMNS = ("branch", "channel", "order_date", "order_status", "total_amount", "tax_amount")


def branch_of(record_source: str | Column) -> Column:
    c = F.col(record_source) if isinstance(record_source, str) else record_source
    return F.split_part(c, F.lit("__"), F.lit(2))


def system_of(record_source: str | Column) -> Column:
    c = F.col(record_source) if isinstance(record_source, str) else record_source
    return F.split_part(c, F.lit("__"), F.lit(1))


def current_rows(sat: DataFrame, key: str, columns: Sequence[str], tie: Sequence[str] = (),
                 respect_deletes: bool = False, rank: Column | None = None) -> DataFrame:
    """Current version per key. Tombstones are dropped before the collapse, or after it on request."""
    rows = sat if respect_deletes else sat.filter(F.col("is_deleted") == 0)
    order = [*([] if rank is None else ["_rank"]), "load_ts", *tie]
    if rank is not None:
        rows = rows.withColumn("_rank", rank)
    out = latest_version(rows, [key], order, [key, *columns, "is_deleted"])
    return out.filter(F.col("is_deleted") == 0).select(key, *columns)


def canonical_orders(hub: DataFrame, header: DataFrame, pricing: DataFrame, marketplace: DataFrame,
                     link_customer: DataFrame, link_store: DataFrame, source_priority: bool = False,
                     respect_deletes: bool = False, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per order: newest header, pricing and marketplace versions, customer and store, provenance.

    All sides are collapsed on the order key, so every join meets an input already partitioned by it.
    `source_priority` prefers the CRM header over the ERP one whatever their load times. With `columns` only the
    sides those columns come from are read and joined: each side has one row per order, so leaving one out keeps
    the rows.
    """
    rank = None
    if source_priority:
        rank = F.coalesce(*[F.when(F.col("source") == s, r) for s, r in SOURCE_RANK.items()], F.lit(0))
    sides = {
        ("order_date", "channel", "order_status", "total_amount", "header_source"): lambda: current_rows(
            header, "order_hk", ["order_date", "channel", "order_status", "total_amount", "source"], ["source"], respect_deletes, rank),
        ("subtotal_amount", "discount_amount", "tax_amount", "shipping_cost", "pricing_source"): lambda: current_rows(
            pricing, "order_hk", ["subtotal_amount", "discount_amount", "tax_amount", "shipping_cost"], ["subtotal_amount"],
            respect_deletes).withColumn("_priced", F.lit(True)),
        ("wb_status", "wb_commission", "wb_return_window_until", "marketplace_source"): lambda: current_rows(
            marketplace, "order_hk", ["wb_status", "wb_commission", "wb_return_window_until"], ["wb_status"],
            respect_deletes).withColumn("_marketed", F.lit(True)),
        ("customer_hk",): lambda: latest_version(link_customer, ["order_hk"], ["load_ts", "customer_hk"], ["order_hk", "customer_hk"]),
        ("store_hk",): lambda: latest_version(link_store, ["order_hk"], ["load_ts", "store_hk"], ["order_hk", "store_hk"]),
    }
    derived = {"header_source": lambda: F.when(F.col("source").isNotNull(), F.concat_ws("__", "source", "branch")),
               "pricing_source": lambda: F.when(F.col("_priced"), F.concat(F.lit("1c__"), "branch")),
               "marketplace_source": lambda: F.when(F.col("_marketed"), F.lit("wb__msk"))}
    wanted = list(columns or CANONICAL_COLUMNS)
    joined = hub.select("order_hk", "order_bk", branch_of("record_source").alias("branch"))
    for gives, build in sides.items():
        if set(gives) & set(wanted):
            joined = joined.join(build(), "order_hk", "left")
    return joined.select(*[derived[c]().alias(c) if c in derived else F.col(c) for c in wanted])


def customer_master(hub: DataFrame, personal: DataFrame, loyalty: DataFrame, branch: str | None = None,
                    loyalty_branches: Sequence[str] = ("msk", "spb", "ekb")) -> DataFrame:
    """Customers of one branch (or all) with current personal and loyalty rows and their provenance."""
    customers = hub.select("customer_hk", "customer_bk", branch_of("record_source").alias("branch"))
    if branch is not None:
        customers = customers.filter(F.col("branch") == branch)
    person = (current_rows(personal, "customer_hk", [*PII_COLUMNS, "load_ts"], ["email"])
              .withColumnRenamed("load_ts", "pii_seen_at"))
    points = (current_rows(loyalty, "customer_hk", ["loyalty_segment", "loyalty_points", "last_visit_at", "load_ts"], ["loyalty_segment"])
              .withColumnRenamed("load_ts", "loyalty_seen_at"))
    eligible = F.col("branch").isin(*loyalty_branches)
    epoch = F.timestamp_seconds(F.lit(0))
    joined = customers.join(person, "customer_hk", "left").join(points, "customer_hk", "left")
    gated = {c: F.when(eligible, F.col(c)).alias(c) for c in ("loyalty_segment", "loyalty_points", "last_visit_at")}
    return joined.select(
        "customer_hk", "customer_bk", "branch", *PII_COLUMNS, gated["loyalty_segment"], gated["loyalty_points"], gated["last_visit_at"],
        F.when(F.col("pii_seen_at").isNotNull(), F.concat(F.lit("1c__"), "branch")).alias("pii_source"),
        F.when(eligible & F.col("loyalty_seen_at").isNotNull(), F.concat(F.lit("bitrix__"), "branch")).alias("loyalty_source"),
        F.greatest(F.coalesce("pii_seen_at", epoch), F.coalesce(F.when(eligible, F.col("loyalty_seen_at")), epoch)).alias("last_seen_at"))


RETURNED = "cancelled"  # the terminal-negative status carries returns


def branch_pnl(orders: DataFrame) -> DataFrame:
    """Per branch and month: volumes, money, returns, effective tax rate."""
    returned = F.col("order_status") == RETURNED
    money = lambda c: F.sum(c).cast("double")
    tax, net = F.sum("tax_amount").cast("double"), F.sum("subtotal_amount").cast("double")
    return (orders.filter(F.col("order_date").isNotNull() & F.col("subtotal_amount").isNotNull())
            .groupBy("branch", F.trunc("order_date", "month").alias("month"))
            .agg(F.count("*").alias("orders"), money("total_amount").alias("gross_revenue"), tax.alias("tax_collected"),
                 net.alias("net_revenue"), money("discount_amount").alias("discounts"), money("shipping_cost").alias("shipping"),
                 F.count_if(returned).alias("returned_orders"),
                 F.coalesce(F.sum(F.when(returned, F.col("total_amount"))).cast("double"), F.lit(0.0)).alias("returned_value"),
                 rounded(ratio(tax, net), 4).alias("effective_tax_rate")))


def customer_360(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers with their order aggregates, without contact fields."""
    returned = F.col("order_status") == RETURNED
    per = (orders.filter(F.col("customer_hk").isNotNull()).groupBy("customer_hk", "branch")
           .agg(F.count("*").alias("order_count"), F.sum("total_amount").cast("double").alias("lifetime_value"),
                F.min("order_date").alias("first_order_dt"), F.max("order_date").alias("last_order_dt"),
                F.count_if(returned).alias("returned_orders"),
                F.sum(F.when(returned, F.col("total_amount"))).cast("double").alias("returned_value")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return customers.join(per, ["customer_hk", "branch"], "left").select(
        "customer_hk", "customer_bk", "branch", "loyalty_segment", "loyalty_points", "last_visit_at", "pii_source", "loyalty_source",
        zero("order_count").alias("order_count"), F.coalesce("lifetime_value", F.lit(0.0)).alias("lifetime_value"),
        "first_order_dt", "last_order_dt", zero("returned_orders").alias("returned_orders"),
        F.coalesce("returned_value", F.lit(0.0)).alias("returned_value"),
        F.when(zero("order_count") > 0, F.col("returned_orders").cast("double") / F.col("order_count")).otherwise(0.0).alias("return_rate"))


def week_start(d: str) -> Column:
    """The Sunday on or before a day."""
    return F.date_sub(F.to_date(d), F.dayofweek(d) - 1)


def returns_velocity(orders: DataFrame) -> DataFrame:
    """Per branch, channel and week: orders, returns, return rate, value and tax of returns."""
    returned = F.col("order_status") == RETURNED
    lost = lambda c: F.coalesce(F.sum(F.when(returned, F.col(c))).cast("double"), F.lit(0.0))
    return (orders.filter(F.col("order_date").isNotNull() & F.col("channel").isNotNull())
            .groupBy("branch", "channel", week_start("order_date").alias("week"))
            .agg(F.count("*").alias("orders"), F.count_if(returned).alias("returned_orders"),
                 rounded(ratio(F.count_if(returned), F.count("*")), 4).alias("return_rate"),
                 lost("total_amount").alias("returned_value"), lost("tax_amount").alias("returned_tax_unrecovered")))


def analyst_view(master: DataFrame) -> DataFrame:
    """Column allow list: no contact field passes."""
    return master.select(*ANALYST_COLUMNS)


def jurisdiction_view(hub: DataFrame, branch: str | None) -> DataFrame:
    """Rows of one jurisdiction for its officer; every other role sees all rows."""
    return hub if branch is None else hub.filter(branch_of("record_source") == branch)


AGE_BUCKETS = ((18, 24), (25, 34), (35, 44), (45, 54))  # fixed; older is 55+


def anonymised_customers(master: DataFrame, as_of_year: int) -> DataFrame:
    """Age bucket, region and segment instead of contact fields."""
    age = F.lit(as_of_year) - F.year("birth_date")
    bucket = F.lit("55+")
    for low, high in reversed(AGE_BUCKETS):
        bucket = F.when(age <= high, f"{low}-{high}").otherwise(bucket)
    return master.filter(F.col("birth_date").isNotNull()).select(
        "customer_hk", bucket.alias("age_bucket"), F.col("branch").alias("geo_region"),
        F.coalesce("loyalty_segment", F.lit("new")).alias("customer_segment"), F.col("last_seen_at").alias("load_ts"),
        F.concat(F.lit("1c__"), "branch").alias("record_source"), F.lit(0).alias("is_deleted"))
