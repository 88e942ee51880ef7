"""Entity reads: scans, point reads, reads at an instant, pages."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at, seconds_before, seconds_between
from tidemark.operators.latest import latest_version

# Fixed priority of the columns that can date a row.
TIME_COLUMNS = ("updated_at", "last_updated", "last_order_at", "ended_at", "started_at", "created_at")


def scan_entity(table: DataFrame, key: str, limit: int) -> DataFrame:
    """All tenants, in key order, limited: a top-k per task, not a full sort."""
    return table.orderBy("tenant_id", key).limit(limit)


def scan_entity_by_ids(table: DataFrame, key: str, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Rows of the given ids; a list becomes a pushed-down filter, a frame a semi join."""
    if isinstance(ids, DataFrame):
        return table.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    return table.filter(F.col(key).isin(list(ids)))


def row_time(df: DataFrame) -> Column:
    """First non-null of the dating columns a table has."""
    present = [F.col(c).cast("timestamp") for c in TIME_COLUMNS if c in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("timestamp")


def read_entity(table: DataFrame, key: str, entity_id: str | Column, as_of: datetime) -> DataFrame:
    """Point read with the time of the last change and the age at `as_of`."""
    rows = table.filter(F.col(key) == entity_id).withColumn("last_updated", row_time(table))
    return rows.withColumn("freshness_seconds", seconds_between("last_updated", at(as_of)))


def entities_as_of(snapshots: DataFrame, current: DataFrame, key: str, anchor: datetime) -> DataFrame:
    """Every entity as it was at an instant.

    `snapshots` (entity_id, processed_at, event_id, payload...) is the journal; the newest row at or before the
    anchor wins. An entity without one falls back to its current row if that row is not younger than the anchor.
    Both sides are folded by one aggregate: the journal is preferred by its rank, not by a join.
    """
    time_column = next((c for c in TIME_COLUMNS if c in current.columns), None)
    if time_column is None:
        raise ValueError("the current table has no dating column")
    payload = [c for c in snapshots.columns if c not in ("entity_id", "processed_at", "event_id")]
    past = snapshots.filter(F.col("processed_at") <= at(anchor)).select(
        "entity_id", *payload, F.col("processed_at").alias("last_updated"), F.lit("journal").alias("origin"),
        F.lit(1).alias("_rank"), F.col("event_id").alias("_tie"))
    now = current.filter(F.col(time_column) <= at(anchor)).select(
        F.col(key).alias("entity_id"), *payload, F.col(time_column).alias("last_updated"),
        F.lit("current").alias("origin"), F.lit(0).alias("_rank"), F.lit("").alias("_tie"))
    return latest_version(past.unionByName(now), ["entity_id"], ["_rank", "last_updated", "_tie"],
                          ["entity_id", *payload, "last_updated", "origin"])


def offset_page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """A page with a has-more probe, and the total of all rows."""
    probe = rows.orderBy(*order).offset(offset).limit(limit + 1)
    number = F.row_number().over(Window.orderBy(*order))  # at most limit + 1 rows reach this window
    page = (probe.withColumn("_no", number).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
            .filter(F.col("_no") <= limit).withColumn("position", F.col("_no") + offset).drop("_no"))
    return page, rows.agg(F.count("*").alias("total"))


def query_hash(parts: Sequence[str]) -> Column:
    """Identity of a paged question: a cursor of another question is refused."""
    return F.sha2(F.concat_ws("|", *[F.lit(p) for p in parts]), 256)


def keyset_page(journal: DataFrame, after: tuple[datetime, str] | None, limit: int) -> DataFrame:
    """Rows strictly after (processed_at, event_id), ascending. The bound is split so both halves push down."""
    rows = journal
    if after is not None:
        ts, event_id = after
        rows = rows.filter((F.col("processed_at") >= at(ts)) & (
            (F.col("processed_at") > at(ts)) | (F.col("event_id") > event_id)))
    return rows.orderBy("processed_at", "event_id").limit(limit)


def settled(journal: DataFrame, as_of: datetime, seconds: int) -> DataFrame:
    """Rows old enough that no writer can still add one before them."""
    return journal.filter(F.col("processed_at") <= seconds_before(at(as_of), seconds))


def newest_events(journal: DataFrame, limit: int, event_family: str | None = None, entity_id: str | None = None) -> DataFrame:
    """Newest validated rows, by event family (exact type or dotted prefix) and entity."""
    rows = journal.filter(F.col("topic") == "events.validated")
    if event_family is not None:
        rows = rows.filter((F.col("event_type") == event_family) | F.col("event_type").startswith(event_family + "."))
    if entity_id is not None:
        rows = rows.filter(F.col("entity_id") == entity_id)
    return rows.orderBy(F.desc("processed_at"), F.desc("event_id")).limit(limit)


def flagged_scan(rows: DataFrame, most: int) -> DataFrame:
    """All rows, with a flag that tells whether there are more than a scan of `most` rows would show.

    Only as many rows as decide it are counted.
    """
    more = rows.limit(most + 1).agg((F.count("*") > most).alias("more")).scalar()
    return rows.withColumn("scan_truncated", F.coalesce(more, F.lit(False)))
