"""Windowed metrics over the serving tables, at an explicit instant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import at, half_even, ratio, seconds_before

# Fixed metric windows, in seconds.
WINDOWS = {"5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "24h": 86400, "now": 1800}
ACTIVE_SECONDS = 30 * 60


@dataclass(frozen=True)
class Metric:
    """A metric is an aggregate over the rows of one table that fall into a window."""

    name: str
    description: str
    unit: str
    table: str
    time_column: str
    value: Callable[[Column], Column]  # (in-window flag) -> aggregate
    source_events: tuple[str, ...]
    windows: tuple[str, ...] = tuple(WINDOWS)
    reads: tuple[str, ...] = ()
    fixed_seconds: int | None = None
    sla_seconds: int = field(default=30)


def _live(inside: Column) -> Column:
    return inside & (F.col("status") != "cancelled")


def _conversion(inside: Column) -> Column:
    return ratio(F.count_if(inside & F.col("is_conversion")), F.count_if(inside))


def _active(inside: Column) -> Column:
    return F.count_if(inside & F.col("ended_at").isNull()).cast("double")


def _errors(inside: Column) -> Column:
    return ratio(F.count_if(inside & (F.col("topic") == "events.deadletter")), F.count_if(inside))


_ORDER_EVENTS = ("order.created", "order.updated", "order.cancelled")
_CLICK_EVENTS = ("click", "page_view", "add_to_cart")

CATALOG: dict[str, Metric] = {}


def register_metric(metric: Metric) -> Metric:
    """Add a metric to the catalog."""
    CATALOG[metric.name] = metric
    return metric


register_metric(Metric("revenue", "Total revenue from non-cancelled orders", "RUB", "orders", "created_at",
                       lambda i: F.sum(F.when(_live(i), F.col("total_amount"))).cast("double"), _ORDER_EVENTS,
                       reads=("status", "total_amount")))
register_metric(Metric("order_count", "Number of non-cancelled orders", "count", "orders", "created_at",
                       lambda i: F.count_if(_live(i)).cast("double"), _ORDER_EVENTS, reads=("status",)))
register_metric(Metric("avg_order_value", "Average order value", "RUB", "orders", "created_at",
                       lambda i: ratio(F.sum(F.when(_live(i), F.col("total_amount"))), F.count_if(_live(i))),
                       _ORDER_EVENTS, reads=("status", "total_amount")))
register_metric(Metric("conversion_rate", "Ratio of sessions that reached checkout", "ratio", "sessions", "started_at",
                       _conversion, _CLICK_EVENTS, reads=("is_conversion",)))
register_metric(Metric("active_sessions", "Active user sessions (started in last 30 min, not ended)", "count",
                       "sessions", "started_at", _active, _CLICK_EVENTS, windows=("now",), reads=("ended_at",),
                       fixed_seconds=ACTIVE_SECONDS))
register_metric(Metric("error_rate", "Ratio of failed events in the pipeline", "ratio", "journal", "processed_at",
                       _errors, (*_ORDER_EVENTS, "payment.initiated", "payment.completed", "payment.failed",
                                 *_CLICK_EVENTS, "product.updated"), reads=("topic",)))


def _seconds(metric: Metric, window: str) -> int:
    if window not in metric.windows:
        raise ValueError(f"metric {metric.name} has no window {window}")
    return metric.fixed_seconds or WINDOWS[window]


def _inside(metric: Metric, window: str, as_of: datetime) -> Column:
    ts = F.col(metric.time_column)
    return (ts >= seconds_before(at(as_of), _seconds(metric, window))) & (ts <= at(as_of))


def _finish(value: Column) -> Column:
    return half_even(F.coalesce(value, F.lit(0.0)), 4)


def metric_value(name: str, tables: dict[str, DataFrame], window: str, as_of: datetime) -> DataFrame:
    """One row (metric, unit, window, value); the window is a filter in front of the scan."""
    metric = CATALOG[name]
    rows = tables[metric.table].filter(_inside(metric, window, as_of))
    return rows.agg(_finish(metric.value(F.lit(True))).alias("value")).select(
        F.lit(name).alias("metric"), F.lit(metric.unit).alias("unit"), F.lit(window).alias("window"), "value")


def metric_matrix(tables: dict[str, DataFrame], as_of: dict[str, datetime], names: list[str] | None = None,
                  by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Every metric in every window per tenant: one pass per source table."""
    parts = []
    chosen = [CATALOG[n] for n in (names or CATALOG)]
    for table in dict.fromkeys(m.table for m in chosen):
        metrics = [m for m in chosen if m.table == table]
        cells = [(m, w) for m in metrics for w in m.windows]
        widest = max((c for c in cells), key=lambda c: _seconds(*c))
        wide = tables[table].filter(_inside(*widest, as_of[table])).groupBy(*by).agg(
            *[m.value(_inside(m, w, as_of[table])).alias(f"{m.name}|{w}") for m, w in cells])
        long = F.explode(F.array(*[
            F.struct(F.lit(m.name).alias("metric"), F.lit(m.unit).alias("unit"), F.lit(w).alias("window"),
                     F.col(f"`{m.name}|{w}`").alias("value")) for m, w in cells]))
        # rounded once the cells are rows: one expression instead of one for each cell
        parts.append(wide.select(*by, long.alias("m")).select(*by, "m.*").withColumn("value", _finish(F.col("value"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def metric_lineage() -> list[tuple[str, str, str, str, int]]:
    """(metric, source event, table, unit, freshness budget in seconds) rows of the catalog."""
    return [(m.name, event, m.table, m.unit, m.sla_seconds) for m in CATALOG.values() for event in m.source_events]


# Fixed list of branches the centre reports on, in display order, and the topic of seeded baseline rows.
CROSS_BRANCHES = ("msk", "spb", "ekb")
BASELINE_TOPIC = "node.baseline"


def cross_branch_summary(journal: DataFrame, branches: tuple[str, ...] = CROSS_BRANCHES,
                         baseline_topic: str = BASELINE_TOPIC) -> DataFrame:
    """Per known branch: baseline rows, live rows, last live instant, status; silent branches stay."""
    live = F.col("topic").isin("events.validated", "events.deadletter")
    seen = (journal.filter(F.col("branch").isin(*branches)).groupBy("branch")
            .agg(F.count_if(F.col("topic") == baseline_topic).alias("baseline"), F.count_if(live).alias("live_delta"),
                 F.max(F.when(live, F.col("processed_at"))).alias("last_seen")))
    names = journal.sparkSession.createDataFrame([(b,) for b in branches], "branch string")
    zero = F.lit(0).cast("long")
    return names.join(seen, "branch", "left").select(
        "branch", F.coalesce("baseline", zero).alias("baseline"), F.coalesce("live_delta", zero).alias("live_delta"),
        "last_seen", F.when(F.coalesce("live_delta", zero) > 0, "live").otherwise("waking").alias("status"))


def table_counts(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Row count per named table, zero for a missing one."""
    present = {n: t for n, t in tables.items() if t is not None}
    spark = next(iter(present.values())).sparkSession
    parts = [t.agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table"), "row_count")
             for n, t in present.items()]
    parts += [spark.range(1).select(F.lit(n).alias("table"), F.lit(0).cast("long").alias("row_count"))
              for n in tables if n not in present]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
