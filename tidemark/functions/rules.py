"""Schema rules and business rules of events, as column expressions over the event record.

The same expressions judge a table and a stream: nothing here needs more than the row itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.columns import seconds_between

# Fixed vocabularies, limits and patterns of the event contract.
EVENT_TYPES = ("order.created", "order.updated", "order.cancelled", "payment.initiated", "payment.completed",
               "payment.failed", "click", "page_view", "add_to_cart", "product.updated")
ORDER_STATUSES = ("pending", "confirmed", "shipped", "delivered", "cancelled")
CURRENCIES = ("RUB", "USD", "EUR", "GBP")
PAYMENT_METHODS = ("card", "bank_transfer", "wallet")
PAYMENT_STATUSES = ("initiated", "completed", "failed", "refunded")
CDC_SOURCES = ("postgres_cdc", "mysql_cdc")
CDC_OPERATIONS = ("snapshot", "insert", "update", "delete", "ddl")
CLICK_TYPES = ("click", "page_view", "add_to_cart")
EVENT_ID = r"^[a-f0-9\-]{36}\z"
ORDER_ID = r"^ORD-\d{8}-\d{4,}\z"
CLOCK_SKEW_SECONDS = 300
TOTAL_TOLERANCE = "0.01"


def number(c: str | Column) -> Column:
    """Exact decimal of a text field, NULL if it is not a number."""
    return (F.col(c) if isinstance(c, str) else c).try_cast("decimal(24,6)")


def event_time(c: str | Column = "timestamp") -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("timestamp")


def is_change() -> Column:
    """A normalised change record: change source, operation and source metadata present."""
    return (F.coalesce(F.col("source").isin(*CDC_SOURCES), F.lit(False)) & F.col("operation").isNotNull()
            & F.col("source_metadata").isNotNull())


def family() -> Column:
    """Rule family of an event: change records first, then the type prefix; NULL if none applies."""
    kind = F.col("event_type")
    return (F.when(is_change(), "cdc").when(kind.startswith("order."), "order").when(kind.startswith("payment."), "payment")
            .when(kind.startswith("click") | kind.startswith("page_view") | kind.startswith("add_to_cart"), "click")
            .when(kind.startswith("product."), "product"))


def _fails(condition: Column, code: str) -> Column:
    """`code` unless the condition holds; an unknown condition does not hold."""
    return F.when(~F.coalesce(condition, F.lit(False)), F.lit(code))


def _length(c: str, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def items_total() -> Column:
    """Sum of quantity x unit price over the item array; zero for no items."""
    zero = F.lit(0).cast("decimal(38,6)")
    return F.aggregate(
        F.coalesce("items", F.array().cast("array<struct<product_id:string,quantity:string,unit_price:string>>")), zero,
        lambda total, i: (total + F.coalesce(
            i["quantity"].try_cast("decimal(12,0)") * i["unit_price"].try_cast("decimal(20,6)"), zero)).cast("decimal(38,6)"))


def base_rules(now: Column) -> list[Column]:
    ts = event_time()
    return [
        _fails(F.col("event_id").rlike(EVENT_ID), "event_id"),
        _fails(F.col("event_type").isin(*EVENT_TYPES), "event_type"),
        _fails(ts.isNotNull() & (seconds_between(now, ts) <= CLOCK_SKEW_SECONDS), "timestamp"),
        _fails(_length("source", 1, 64), "source"),
    ]


def order_rules() -> list[Column]:
    items = F.col("items")
    bad_quantity = F.exists(items, lambda i: ~F.coalesce(
        i["quantity"].try_cast("int").between(1, 1000), F.lit(False)))
    # two decimals at most: what the cast keeps has no third one, and neither has the text behind them
    exact = lambda i: i["unit_price"].try_cast("decimal(38,18)")
    price_ok = lambda i: (exact(i) > 0) & (exact(i) == F.round(exact(i), 2)) & ~i["unit_price"].rlike(r"\.[0-9]{2}[0-9]*[1-9]")
    bad_price = F.exists(items, lambda i: ~F.coalesce(price_ok(i), F.lit(False)))
    total = number("total_amount")
    return [
        _fails(F.col("order_id").rlike(ORDER_ID), "order_id"),
        _fails(F.col("user_id").isNotNull(), "user_id"),
        _fails(F.col("status").isin(*ORDER_STATUSES), "status"),
        _fails(F.size("items") >= 1, "items"),
        _fails(~bad_quantity, "items.quantity"),
        _fails(~bad_price, "items.unit_price"),
        _fails(total > 0, "total_amount"),
        _fails(F.abs(total - items_total()) <= F.lit(TOTAL_TOLERANCE).cast("decimal(4,2)"), "total_mismatch"),
        _fails(F.coalesce("currency", F.lit("RUB")).isin(*CURRENCIES), "currency"),
    ]


def payment_rules() -> list[Column]:
    return [
        _fails(F.col("payment_id").isNotNull(), "payment_id"),
        _fails(F.col("order_id").rlike(ORDER_ID), "order_id"),
        _fails(F.col("user_id").isNotNull(), "user_id"),
        _fails(number("amount") > 0, "amount"),
        _fails(F.coalesce("currency", F.lit("RUB")).isin(*CURRENCIES), "currency"),
        _fails(F.col("method").isin(*PAYMENT_METHODS), "method"),
        _fails(F.col("status").isin(*PAYMENT_STATUSES), "status"),
    ]


def click_rules() -> list[Column]:
    return [_fails(F.col(c).isNotNull(), c) for c in ("session_id", "page_url", "user_agent")]


def product_rules() -> list[Column]:
    return [
        _fails(F.col("product_id").isNotNull(), "product_id"),
        _fails(_length("name", 1, 500), "name"),
        _fails(F.col("category").isNotNull(), "category"),
        _fails(number("price") >= 0, "price"),
        _fails(F.coalesce("currency", F.lit("RUB")).isin(*CURRENCIES), "currency"),
        _fails(F.col("in_stock").try_cast("boolean").isNotNull(), "in_stock"),
        _fails(F.col("stock_quantity").try_cast("int") >= 0, "stock_quantity"),
    ]


def change_rules() -> list[Column]:
    return [
        _fails(F.length("event_id") >= 1, "event_id"),
        _fails(_length("event_type", 1, 128), "event_type"),
        _fails(F.col("operation").isin(*CDC_OPERATIONS), "operation"),
        _fails(event_time().isNotNull(), "timestamp"),
        _fails(_length("entity_type", 1, 64), "entity_type"),
        _fails(_length("entity_id", 1, 256), "entity_id"),
        _fails(F.size("source_metadata") >= 1, "source_metadata"),
    ]


def schema_errors(now: Column) -> Column:
    """Names of the violated schema rules of a row; empty when it is valid."""
    kind = family()
    base = base_rules(now)
    chosen = (F.when(kind == "cdc", F.array(*change_rules()))
              .when(kind == "order", F.array(*base, *order_rules()))
              .when(kind == "payment", F.array(*base, *payment_rules()))
              .when(kind == "click", F.array(*base, *click_rules()))
              .when(kind == "product", F.array(*base, *product_rules()))
              .otherwise(F.array(F.lit("unknown_event_type"))))
    return F.filter(chosen, lambda e: e.isNotNull())


# Fixed bounds of the business rules.
PAYMENT_MIN, PAYMENT_MAX, PRICE_MAX = "0.50", "50000", "100000"


def _issue(when: Column, rule: str, severity: str, field: str) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def semantic_issues() -> Column:
    """Issues (rule, severity, field) of a row from all rules of its type; change records are exempt."""
    kind = F.col("event_type")
    zero = F.lit(0).cast("decimal(24,6)")
    order, payment, product = (kind.startswith(p) for p in ("order.", "payment.", "product."))
    click = kind.startswith("click") | kind.startswith("page_view") | kind.startswith("add_to_cart")
    amount = F.coalesce(number("amount"), zero)
    off = F.abs(F.coalesce(number("total_amount"), zero) - items_total()) > F.lit(TOTAL_TOLERANCE).cast("decimal(4,2)")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    issues = F.array(
        _issue(order & off, "order_total_consistency", "error", "total_amount"),
        _issue(payment & (amount < F.lit(PAYMENT_MIN).cast("decimal(8,2)")), "payment_min_amount", "error", "amount"),
        _issue(payment & (amount > F.lit(PAYMENT_MAX).cast("decimal(8,2)")), "payment_max_amount", "warning", "amount"),
        _issue(payment & (F.col("status") == "failed") & blank("failure_reason"),
               "payment_failure_reason_required", "warning", "failure_reason"),
        _issue(click & blank("session_id"), "clickstream_session_required", "error", "session_id"),
        _issue(product & (F.coalesce(number("price"), zero) > F.lit(PRICE_MAX).cast("decimal(10,2)")),
               "product_price_sanity", "warning", "price"))
    found = F.filter(issues, lambda i: i.isNotNull())
    return F.when(is_change(), F.array().cast("array<struct<rule:string,severity:string,field:string>>")).otherwise(found)


def has_error(issues: Column | str) -> Column:
    """Warnings pass; one error does not."""
    return F.exists(issues, lambda i: i["severity"] == "error")


def servable(event_type: Column) -> Column:
    """Types the serving tables take: three prefixes or three click types."""
    return (event_type.startswith("order.") | event_type.startswith("payment.") | event_type.startswith("product.")
            | event_type.isin(*CLICK_TYPES))
