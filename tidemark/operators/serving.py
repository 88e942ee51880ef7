"""Materialisation of validated events into keyed serving tables and the journal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import at
from tidemark.operators.latest import drop_known, latest_version

JOURNAL_COLUMNS = ["event_id", "topic", "tenant_id", "entity_id", "event_type", "latency_ms", "processed_at", "branch"]
APPLIED_TOPICS = ["events.validated", "events.deadletter"]


def order_snapshot(order_events: DataFrame, version: list[str]) -> DataFrame:
    """Current orders from an order event log: last writer wins, a delete removes the key."""
    live = latest_version(order_events, ["tenant_id", "order_id"], version)
    if "operation" in live.columns:
        live = live.filter(F.coalesce(F.col("operation"), F.lit("")) != "delete")
    return live.select("tenant_id", "order_id", "user_id", "status", F.col("total_amount").cast("decimal(18,2)"),
                       F.coalesce("currency", F.lit("RUB")).alias("currency"), "created_at")


def product_snapshot(product_events: DataFrame, version: list[str]) -> DataFrame:
    live = latest_version(product_events, ["tenant_id", "product_id"], version)
    return live.select("tenant_id", "product_id", "name", "category", F.col("price").cast("decimal(18,2)"),
                       "in_stock", F.col("stock_quantity").cast("int"))


def user_profiles(orders: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Per user: live order count, spend, first and last order.

    `touched` (tenant_id, user_id) limits the recomputation to the users of a batch.
    """
    rows = orders.filter(F.col("status") != "cancelled")
    if touched is not None:
        rows = rows.join(touched.select("tenant_id", "user_id").distinct(), ["tenant_id", "user_id"], "left_semi")
    return (rows.groupBy("tenant_id", "user_id")
            .agg(F.count("*").alias("total_orders"), F.sum("total_amount").alias("total_spent"),
                 F.min("created_at").alias("first_order_at"), F.max("created_at").alias("last_order_at"))
            .withColumn("preferred_category", F.lit(None).cast("string")))


def journal_entity(events: DataFrame) -> Column:
    """Entity id of a journal row, by event type prefix; NULL for other types."""
    pick = F.lit(None).cast("string")
    for prefix, column in (("session.", "session_id"), ("product.", "product_id"), ("user.", "user_id"),
                           ("order.", "order_id")):
        if column in events.columns:
            pick = F.when(F.col("event_type").startswith(prefix), F.col(column)).otherwise(pick)
    return pick


def journal_rows(events: DataFrame) -> DataFrame:
    """Journal rows of applied events: one per event, and a stage row beside every live order event.

    Expects event_id, tenant_id, event_type, is_dead, latency_ms, processed_at, branch and the id columns.
    """
    base = F.struct(
        F.col("event_id"), F.when(F.col("is_dead"), "events.deadletter").otherwise("events.validated").alias("topic"),
        F.col("tenant_id"), journal_entity(events).alias("entity_id"), F.col("event_type"),
        F.col("latency_ms").cast("long").alias("latency_ms"), F.col("processed_at"), F.col("branch"))
    stage = F.struct(
        F.concat("event_id", F.lit("-status")).alias("event_id"), F.lit("orders.status").alias("topic"),
        F.col("tenant_id"), F.col("order_id").alias("entity_id"),
        F.concat(F.lit("order.status."), "status").alias("event_type"),
        F.lit(None).cast("long").alias("latency_ms"), F.col("processed_at"), F.col("branch"))
    staged = ~F.col("is_dead") & F.col("event_type").startswith("order.") & F.col("status").isNotNull()
    return (events.select(F.explode(F.when(staged, F.array(base, stage)).otherwise(F.array(base))).alias("j"))
            .select("j.*"))


# What tells the first delivery of an identity: arrival, then position, as far as a batch has them.
ARRIVAL = ("processed_at", "ingest_ts", "ts", "offset", "src_key")


def first_delivery(batch: DataFrame, keys: Sequence[str] = ("tenant_id", "event_id")) -> DataFrame:
    """One whole row of each identity: the one that arrived first."""
    order = [c for c in ARRIVAL if c in batch.columns] or list(keys)
    values = [c for c in batch.columns if c not in keys]
    return batch.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("_row")).select(*keys, "_row.*").select(*batch.columns)


def unapplied(batch: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of a batch that are new: first of their identity in the batch and absent from the journal."""
    fresh = first_delivery(batch)
    seen = journal.filter(F.col("topic").isin(APPLIED_TOPICS)).select("tenant_id", "event_id")
    return drop_known(fresh, seen, ["tenant_id", "event_id"])


def apply_counts(batch: DataFrame, fresh: DataFrame) -> DataFrame:
    """applied / dead / duplicate counts of one batch."""
    total = batch.agg(F.count("*").alias("total"))
    done = fresh.agg(F.count_if(~F.col("is_dead")).alias("applied"), F.count_if(F.col("is_dead")).alias("dead"))
    return done.select("applied", "dead",
                       (F.lit(total.scalar()) - F.col("applied") - F.col("dead")).alias("duplicate"))


def ingest_edge(batch: DataFrame, journal: DataFrame, branch: str) -> DataFrame:
    """Edge-to-centre ingest: stamp the branch on the new rows of a batch."""
    return unapplied(batch, journal).withColumn("branch", F.lit(branch))


def replay_dead_letters(dead: DataFrame, corrections: DataFrame, errors: Column, requested_at: datetime) -> DataFrame:
    """Overlay corrected fields on failed payloads and revalidate.

    `dead` carries the payload as map<string,string>; `corrections` (tenant_id, event_id, patch) the fields to
    replace. `errors` is an array column over the overlaid `payload`. Rows that pass become `replay_pending` with
    one more retry and go to the replay topic; the others keep their state and show the first error.
    """
    merged = (dead.join(corrections, ["tenant_id", "event_id"])
              .withColumn("payload", F.map_from_entries(F.map_entries(F.map_concat(
                  F.map_filter("payload", lambda k, _: ~F.array_contains(F.map_keys("patch"), k)), "patch"))))
              .withColumn("first_error", F.get(errors, F.lit(0))))
    ok = F.col("first_error").isNull()
    return merged.select(
        "tenant_id", "event_id", "payload",
        F.when(ok, "replay_pending").otherwise(F.col("status")).alias("status"),
        (F.col("retry_count") + ok.cast("int")).alias("retry_count"),
        F.when(ok, at(requested_at)).otherwise(F.col("last_retried_at")).alias("last_retried_at"),
        F.when(ok, "events.replay").alias("topic"), "first_error")


def schedule_retries(pending: DataFrame, as_of: datetime, max_retries: int) -> DataFrame:
    """Next attempt of failed deliveries: 2^n seconds, at least 30 after a broker error, `failed` at the limit."""
    n = F.col("retry_count")
    broker = F.col("last_error").startswith("KafkaError{") | F.col("last_error").contains(
        "Kafka message(s) were not delivered")
    delay = F.pow(F.lit(2.0), n).cast("long")
    delay = F.when(F.coalesce(broker, F.lit(False)), F.greatest(delay, F.lit(30).cast("long"))).otherwise(delay)
    spent = n >= max_retries
    return pending.select(
        *[c for c in pending.columns if c not in ("status", "next_attempt_at")],
        F.when(spent, "failed").otherwise("pending").alias("status"),
        F.when(~spent, F.timestamp_seconds(F.unix_micros(at(as_of)) / F.lit(1e6) + delay)).alias("next_attempt_at"))


# Fixed note of items a scan no longer finds.
AUTO_RESOLVE_NOTE = "auto-resolved: no longer reproduces"


def merge_triage(overlay: DataFrame, findings: DataFrame, as_of: datetime) -> DataFrame:
    """Next state of the triage overlay after a scan.

    overlay: item_id, tenant_id, source, status, first_seen_at, last_seen_at, resolved_at, note;
    findings: item_id, tenant_id, source, seen_at (one row per item). A scan is whole, so what it lacks is resolved.
    """
    o, f = overlay.alias("o"), findings.alias("f")
    joined = o.join(f, (F.col("o.item_id") == F.col("f.item_id")) & (F.col("o.tenant_id") == F.col("f.tenant_id")),
                    "full_outer")
    new, seen = F.col("o.item_id").isNull(), F.col("f.item_id").isNotNull()
    was_resolved = F.col("o.status") == "resolved"
    reopen = seen & was_resolved & (F.col("f.seen_at") > F.col("o.resolved_at"))
    clear = ~seen & ~was_resolved
    reset = new | reopen
    return joined.select(
        F.coalesce("o.item_id", "f.item_id").alias("item_id"), F.coalesce("o.tenant_id", "f.tenant_id").alias("tenant_id"),
        F.coalesce("o.source", "f.source").alias("source"),
        F.when(reset, "open").when(clear, "resolved").otherwise(F.col("o.status")).alias("status"),
        F.coalesce("o.first_seen_at", "f.seen_at").alias("first_seen_at"),
        F.when(reset | (seen & ~was_resolved), F.col("f.seen_at")).otherwise(F.col("o.last_seen_at")).alias("last_seen_at"),
        F.when(reset, F.lit(None).cast("timestamp")).when(clear, at(as_of)).otherwise(F.col("o.resolved_at"))
        .alias("resolved_at"),
        F.when(reset, F.lit(None).cast("string")).when(clear, F.lit(AUTO_RESOLVE_NOTE)).otherwise(F.col("o.note")).alias("note"))
