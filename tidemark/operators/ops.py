"""Operations worklists: stage clocks, stuck orders, reconciliation, exceptions, dead letters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import at, seconds_before, seconds_between
from tidemark.operators.latest import latest_version

# Fixed stage ladder of an order: budget in minutes, NULL for terminal stages; the order is the rank.
STAGES = (("pending", 30, False), ("confirmed", 1440, False), ("shipped", 7200, False),
          ("delivered", None, True), ("cancelled", None, True))
LADDER = tuple(name for name, _, terminal in STAGES if not terminal)
STATUS_PREFIX = "order.status."
DEADLETTER_STATUS = {"failed": "open", "replay_pending": "in_progress", "replayed": "resolved", "dismissed": "resolved"}
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}


def budget_minutes(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, minutes, _ in STAGES:
        if minutes is not None:
            out = F.when(status == name, minutes).otherwise(out)
    return out


def ladder_rank(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(LADDER):
        out = F.when(status == name, rank).otherwise(out)
    return out


def stage_clock(orders: DataFrame, stage_rows: DataFrame, as_of: datetime) -> DataFrame:
    """When each order entered its present stage, and for how long it has been there.

    The clock is the newest stage row of the order's *current* status; without one it is the creation time.
    """
    entered = (stage_rows.groupBy("tenant_id", F.col("entity_id").alias("order_id"), "event_type")
               .agg(F.max("processed_at").alias("entered")))
    entered = entered.withColumn("status", F.expr(f"substring(event_type, {len(STATUS_PREFIX) + 1})")).filter(
        F.col("event_type").startswith(STATUS_PREFIX)).drop("event_type")
    joined = orders.join(entered, ["tenant_id", "order_id", "status"], "left")
    at_stage = F.coalesce("entered", "created_at")
    seconds = seconds_between(at_stage, at(as_of))
    minutes = budget_minutes(F.col("status"))
    return joined.select(
        *orders.columns, at_stage.alias("entered_at"), F.when(F.col("entered").isNotNull(), "journal").otherwise("fallback").alias("clock"),
        seconds.alias("in_stage_seconds"), minutes.alias("sla_minutes"), (seconds > minutes * 60).alias("breached"),
        (seconds / (minutes * 60)).alias("overshoot_ratio"))


def stuck_orders(orders: DataFrame, stage_rows: DataFrame, as_of: datetime, stage: str | None = None,
                 include_within_sla: bool = False) -> DataFrame:
    """Open orders beyond their stage budget; the filter on status reaches the order scan."""
    rows = stage_clock(orders.filter(F.col("status").isin(*LADDER)), stage_rows, as_of)
    if stage is not None:
        rows = rows.filter(F.col("status") == stage)
    if not include_within_sla:
        rows = rows.filter("breached")
    return rows


def worklist_page(rows: DataFrame, page: int, page_size: int) -> DataFrame:
    """One page by overshoot, largest first: a bounded top-k, not a sort of the worklist."""
    return (rows.orderBy(F.coalesce("overshoot_ratio", F.lit(-1.0)).desc(), "tenant_id", "order_id")
            .offset((page - 1) * page_size).limit(page_size))


def stage_summary(clocked: DataFrame) -> DataFrame:
    return clocked.groupBy("status").agg(F.count("*").alias("open"), F.count_if("breached").alias("breached"))


def order_timeline(orders: DataFrame, journal: DataFrame, users: DataFrame, dead: DataFrame, as_of: datetime,
                   order_id: str | Column | None = None) -> DataFrame:
    """Everything known about orders as dated rows: order, present stage, stage history, trail, customer, exceptions.

    Rows, not one nested record: an order with a long history stays spread over its rows. With an id the
    filter is applied to every input first.
    """
    if order_id is not None:
        orders, journal = orders.filter(F.col("order_id") == order_id), journal.filter(F.col("entity_id") == order_id)
    mine = journal.join(orders.select("tenant_id", F.col("order_id").alias("entity_id")), ["tenant_id", "entity_id"], "left_semi")
    stage_rows = mine.filter(F.col("topic") == "orders.status")
    trail = mine.filter(F.col("topic") != "orders.status")
    clocked = stage_clock(orders, stage_rows, as_of)

    def rows(df, section, when, key, detail):
        return df.select("tenant_id", key.alias("order_id"), F.lit(section).alias("section"), when.alias("at"), detail.alias("detail"))

    entity, oid = F.col("entity_id"), F.col("order_id")
    parts = [
        rows(orders, "order", F.col("created_at"), oid, F.concat_ws(" ", "status", "user_id")),
        rows(clocked, "stage", F.col("entered_at"), oid, F.concat_ws(" ", "status", "clock", F.col("breached").cast("string"))),
        rows(stage_rows, "stage_history", F.col("processed_at"), entity, F.expr(f"substring(event_type, {len(STATUS_PREFIX) + 1})")),
        rows(trail, "pipeline_trail", F.col("processed_at"), entity, F.concat_ws(" ", "topic", "event_type")),
        rows(orders.join(users.select("tenant_id", "user_id", "total_orders", "last_order_at"), ["tenant_id", "user_id"]),
             "customer", F.col("last_order_at"), oid, F.concat_ws(" ", "user_id", F.col("total_orders").cast("string"))),
        rows(trail.filter(F.col("topic") == "events.deadletter").join(
            dead.select("tenant_id", "event_id", "failure_reason", "status", "received_at"), ["tenant_id", "event_id"]),
            "exception", F.col("received_at"), entity, F.concat_ws(" ", "failure_reason", "status"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def behind_journal(orders: DataFrame, stage_rows: DataFrame) -> DataFrame:
    """Orders whose stored status ranks below the newest journal stage; only the non-terminal ladder counts."""
    rows = stage_rows.filter(F.col("event_type").startswith(STATUS_PREFIX) & F.col("entity_id").isNotNull())
    newest = latest_version(rows, ["tenant_id", "entity_id"], ["processed_at", "event_id"],
                            ["tenant_id", "entity_id", "event_type", "processed_at"])
    newest = newest.select("tenant_id", F.col("entity_id").alias("order_id"), "processed_at",
                           F.expr(f"substring(event_type, {len(STATUS_PREFIX) + 1})").alias("journal_status"))
    joined = newest.join(orders.select("tenant_id", "order_id", "status"), ["tenant_id", "order_id"])
    lag = ladder_rank(F.col("status")) < ladder_rank(F.col("journal_status"))
    return joined.filter(lag).select(
        "tenant_id", F.concat_ws(":", F.lit("r1"), "order_id", "journal_status").alias("dedupe_key"), F.lit("high").alias("severity"),
        F.concat(F.lit("Order "), "order_id", F.lit(" behind its journal stage")).alias("title"),
        F.concat(F.lit("journal '"), "journal_status", F.lit("', store '"), "status", F.lit("'")).alias("detail"),
        F.lit("order").alias("entity_kind"), F.col("order_id").alias("entity_id"), F.col("processed_at").alias("occurred_at"))


def stuck_replays(dead: DataFrame, as_of: datetime, older_than_seconds: int) -> DataFrame:
    """Replays requested longer ago than the limit and still pending."""
    old = (F.col("status") == "replay_pending") & (F.col("last_retried_at") <= seconds_before(at(as_of), older_than_seconds))
    return dead.filter(old).select(
        "tenant_id", F.concat(F.lit("r2:"), "event_id").alias("dedupe_key"), F.lit("medium").alias("severity"),
        F.concat(F.lit("Replay stuck for "), "event_id").alias("title"), F.lit("replay pending").alias("detail"),
        F.lit("event").alias("entity_kind"), F.col("event_id").alias("entity_id"), F.col("last_retried_at").alias("occurred_at"))


def map_value(c: Column, table: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def exception_inbox(dead: DataFrame, deliveries: DataFrame, findings: DataFrame, triage: DataFrame) -> DataFrame:
    """Dead letters, dead deliveries and reconciliation findings as one list of items.

    The triage overlay (tenant_id, item_id, status, first_seen_at, last_seen_at) gives the last two their state.
    """
    letters = dead.select(
        "tenant_id", F.concat(F.lit("dl:"), "event_id").alias("item_id"), F.lit("deadletter").alias("source"), F.lit("high").alias("severity"),
        F.col("received_at").alias("occurred_at"), F.coalesce("last_retried_at", "received_at").alias("last_seen_at"),
        F.lit("event").alias("entity_kind"), F.col("event_id").alias("entity_id"),
        F.concat(F.lit("Dead-letter: "), F.coalesce("failure_reason", F.lit("unknown reason"))).alias("title"),
        F.coalesce("failure_detail", F.lit("")).alias("detail"), map_value(F.col("status"), DEADLETTER_STATUS, "open").alias("status"))
    hooks = deliveries.filter(F.col("status") == "dead").select(
        "tenant_id", F.concat_ws(":", F.lit("wh"), "webhook_id", "event_id").alias("item_id"), F.lit("webhook_delivery").alias("source"),
        F.lit("medium").alias("severity"), F.col("updated_at").alias("occurred_at"), F.col("updated_at").alias("last_seen_at"),
        F.lit("webhook").alias("entity_kind"), F.col("webhook_id").alias("entity_id"),
        F.concat(F.lit("Webhook delivery dead for "), "webhook_id").alias("title"), F.coalesce("last_error", F.lit("")).alias("detail"))
    found = findings.select(
        "tenant_id", F.concat(F.lit("rc:"), "dedupe_key").alias("item_id"), F.lit("reconciliation").alias("source"), "severity",
        "occurred_at", F.col("occurred_at").alias("last_seen_at"), "entity_kind", "entity_id", "title", "detail")
    state = triage.select("tenant_id", "item_id", F.col("status").alias("_s"), F.col("first_seen_at").alias("_f"), F.col("last_seen_at").alias("_l"))
    overlaid = hooks.unionByName(found).join(state, ["tenant_id", "item_id"], "left")
    overlaid = (overlaid.withColumn("status", F.coalesce("_s", F.lit("open"))).withColumn("occurred_at", F.coalesce("_f", "occurred_at"))
                .withColumn("last_seen_at", F.coalesce("_l", "last_seen_at")).drop("_s", "_f", "_l"))
    return letters.unionByName(overlaid)


def inbox_page(items: DataFrame, page: int, page_size: int, source: str | None = None, status: str | None = None) -> DataFrame:
    """Unresolved items by default, by severity and newest first."""
    rows = items.filter(F.col("source") == source) if source else items
    rows = rows.filter(F.col("status") == status) if status else rows.filter(F.col("status") != "resolved")
    rank = F.lit(3)
    for name, value in SEVERITY_RANK.items():
        rank = F.when(F.col("severity") == name, value).otherwise(rank)
    return rows.orderBy(rank, F.desc("occurred_at"), "item_id").offset((page - 1) * page_size).limit(page_size)


def inbox_stats(items: DataFrame, as_of: datetime) -> DataFrame:
    """Counts per source and status, with those of the last day."""
    return items.groupBy("source", "status").agg(
        F.count("*").alias("items"), F.count_if(F.col("occurred_at") >= seconds_before(at(as_of), 86400)).alias("last_24h"))


def dead_letter_page(dead: DataFrame, reason: str | None, page: int, page_size: int) -> DataFrame:
    rows = dead.filter(F.col("failure_reason") == reason) if reason else dead
    return rows.orderBy(F.desc("received_at"), "event_id").offset((page - 1) * page_size).limit(page_size)


def dead_letter_stats(dead: DataFrame, as_of: datetime) -> DataFrame:
    """Failed letters per reason, in the last day, and the hourly trend of that day, as (kind, key, count) rows."""
    failed = dead.filter(F.col("status") == "failed")
    recent = failed.filter(F.col("received_at") >= seconds_before(at(as_of), 86400))
    by_reason = failed.filter(F.col("failure_reason").isNotNull()).groupBy("tenant_id", F.col("failure_reason").alias("key")).agg(F.count("*").alias("count"))
    day = recent.groupBy("tenant_id").agg(F.count("*").alias("count")).withColumn("key", F.lit("last_24h"))
    hours = recent.groupBy("tenant_id", F.date_format(F.date_trunc("hour", "received_at"), "yyyy-MM-dd HH:mm").alias("key")).agg(F.count("*").alias("count"))
    parts = [df.select("tenant_id", F.lit(kind).alias("kind"), "key", "count") for kind, df in (("reason", by_reason), ("total", day), ("hour", hours))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
