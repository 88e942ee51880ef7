"""Service-level reports over the journal: indicators, budgets, burn rates, health, lineage."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at, half_even, ratio, seconds_before, seconds_between
from tidemark.operators.quantiles import exact_quantiles

HOUR, DAY = 3600, 86400
# Fixed: burn windows, alerting pairs with their limits, and the budget that counts as at risk.
BURN_WINDOWS = {"1h": HOUR, "6h": 6 * HOUR, "3d": 3 * DAY}
FAST_PAIR, FAST_LIMIT = ("1h", "6h"), 14.4
SLOW_PAIR, SLOW_LIMIT = ("6h", "3d"), 6.0
LOW_BUDGET = 0.2


@dataclass(frozen=True)
class Objective:
    name: str
    target: float
    measurement: str  # p95_latency_ms | freshness_seconds | error_rate_percent
    threshold: float
    window_days: int


# Fixed default objectives.
OBJECTIVES = (
    Objective("api_latency_p95", 0.99, "p95_latency_ms", 100, 30),
    Objective("data_freshness", 0.999, "freshness_seconds", 30, 7),
    Objective("error_rate", 0.999, "error_rate_percent", 0.1, 30),
)


def in_window(as_of: datetime, seconds: int, ts: str = "processed_at") -> Column:
    return (F.col(ts) >= seconds_before(at(as_of), seconds)) & (F.col(ts) <= at(as_of))


def freshness(journal: DataFrame, as_of: datetime, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Newest row and its age, never negative."""
    newest = F.max("processed_at")
    return journal.groupBy(*by).agg(newest.alias("newest")).withColumn(
        "age_seconds", F.greatest(F.lit(0.0), seconds_between("newest", at(as_of))))


def latency_quantile(journal: DataFrame, q: float, as_of: datetime, seconds: int, by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    rows = journal.filter(in_window(as_of, seconds) & F.col("latency_ms").isNotNull())
    return exact_quantiles(rows, by, "latency_ms", {"latency_ms": q})


def latency_sli(journal: DataFrame, threshold_ms: float, as_of: datetime, windows: dict[str, int],
                by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Per window, rows with a latency (valid) and those at or under the threshold (good)."""
    aggs = []
    for name, seconds in windows.items():
        inside = in_window(as_of, seconds) & F.col("latency_ms").isNotNull()
        aggs += [F.count_if(inside & (F.col("latency_ms") <= threshold_ms)).cast("double").alias(f"good_{name}"),
                 F.count_if(inside).cast("double").alias(f"valid_{name}")]
    return journal.filter(in_window(as_of, max(windows.values()))).groupBy(*by).agg(*aggs)


def error_sli(journal: DataFrame, as_of: datetime, windows: dict[str, int], by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Per window: share without a server error where status codes exist, else the share not dead-lettered."""
    aggs = []
    for name, seconds in windows.items():
        inside = in_window(as_of, seconds)
        http = F.count_if(inside & F.col("status_code").isNotNull())
        bad_http = F.count_if(inside & (F.col("status_code") >= 500))
        dead = F.count_if(inside & (F.col("topic") == "events.deadletter"))
        total = F.count_if(inside)
        aggs += [F.when(http > 0, http - bad_http).otherwise(total - dead).cast("double").alias(f"good_{name}"),
                 F.when(http > 0, http).otherwise(total).cast("double").alias(f"valid_{name}")]
    return journal.filter(in_window(as_of, max(windows.values()))).groupBy(*by).agg(*aggs)


def freshness_sli(journal: DataFrame, threshold_seconds: float, as_of: datetime, windows: dict[str, int],
                  by: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Per window, fresh and observed seconds: every gap counts up to the threshold, and so does the tail.

    Rows are folded into cells, counted back from `as_of`, no wider than the threshold and aligned with every
    window. Inside a cell no gap can exceed the threshold, so its fresh time is last minus first; only the
    borders between cells need the previous row. What is ordered are cells, never events.
    """
    step = int(threshold_seconds * 1000)
    for seconds in windows.values():
        step = gcd(step, seconds * 1000)
    age = F.unix_micros(at(as_of)) - F.unix_micros(F.col("processed_at"))
    cells = (journal.filter(in_window(as_of, max(windows.values()))).groupBy(*by, F.ceil(age / (step * 1000)).alias("cell"))
             .agg(F.min("processed_at").alias("first"), F.max("processed_at").alias("last")))
    order = Window.partitionBy(*by).orderBy(F.desc("cell"))
    gap = (F.unix_millis("first") - F.unix_millis("prev_last")) / 1000.0
    cells = (cells.withColumn("prev_last", F.lag("last").over(order)).withColumn("prev_cell", F.lag("cell").over(order))
             .withColumn("inside", (F.unix_millis("last") - F.unix_millis("first")) / 1000.0)
             .withColumn("bridge", F.least(gap, F.lit(float(threshold_seconds)))))
    aggs = []
    for name, seconds in windows.items():
        edge = seconds * 1000 // step
        mine = F.col("cell") <= edge
        bridged = mine & (F.col("prev_cell") <= edge)
        between = F.sum(F.when(mine, F.col("inside"))) + F.coalesce(F.sum(F.when(bridged, F.col("bridge"))), F.lit(0.0))
        last, first = F.max(F.when(mine, F.col("last"))), F.min(F.when(mine, F.col("first")))
        tail = F.least(F.greatest(seconds_between(last, at(as_of)), F.lit(0.0)), F.lit(float(threshold_seconds)))
        observed = F.greatest(seconds_between(first, at(as_of)), F.lit(0.0))
        aggs += [F.when(observed > 0, F.least(between + tail, observed)).otherwise(F.when(first.isNotNull(), 0.0)).alias(f"good_{name}"),
                 F.when(first.isNotNull(), observed).alias(f"valid_{name}")]
    return cells.groupBy(*by).agg(*aggs)


def slo_report(journal: DataFrame, as_of: datetime, objectives=OBJECTIVES) -> DataFrame:
    """Per tenant and objective: share, error budget, burn rates, status."""
    parts = []
    tenants = journal.select("tenant_id").distinct()
    for o in objectives:
        windows = {"slo": o.window_days * DAY, **BURN_WINDOWS}
        if o.measurement == "p95_latency_ms":
            sli = latency_sli(journal, o.threshold, as_of, windows)
            diagnostic = latency_quantile(journal, 0.95, as_of, windows["slo"]).select("tenant_id", F.col("latency_ms").alias("diagnostic"))
        elif o.measurement == "freshness_seconds":
            sli = freshness_sli(journal, o.threshold, as_of, windows)
            diagnostic = freshness(journal.filter(in_window(as_of, windows["slo"])), as_of).select("tenant_id", F.col("age_seconds").alias("diagnostic"))
        elif o.measurement == "error_rate_percent":
            sli = error_sli(journal, as_of, windows)
            diagnostic = None
        else:
            raise ValueError(f"unsupported measurement {o.measurement}")
        rows = tenants.join(sli, "tenant_id", "left")
        if diagnostic is not None:
            rows = rows.join(diagnostic, "tenant_id", "left")
        else:
            share = ratio("good_slo", "valid_slo")
            rows = rows.withColumn("diagnostic", (1 - share) * 100.0)
        parts.append(_status_rows(rows, o, windows))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _status_rows(rows: DataFrame, o: Objective, windows: dict[str, int]) -> DataFrame:
    budget = 1.0 - o.target
    current = half_even(ratio("good_slo", "valid_slo"), 4)
    left = (F.when(current >= 1.0, 1.0).otherwise(0.0) if o.target >= 1.0
            else F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - (1.0 - current) / budget)))
    left = half_even(F.when(current.isNotNull(), left), 4)
    burn = {w: (F.lit(None).cast("double") if o.target >= 1.0 else half_even((1.0 - ratio(f"good_{w}", f"valid_{w}")) / budget, 2))
            for w in BURN_WINDOWS}
    base = rows.select("tenant_id", "good_slo", "valid_slo", "diagnostic", current.alias("current"), left.alias("left"),
                       *[burn[w].alias(f"burn_{w}") for w in BURN_WINDOWS])
    burns = lambda pair, limit: F.coalesce(
        (F.col(f"burn_{pair[0]}") > limit) & (F.col(f"burn_{pair[1]}") > limit), F.lit(False))
    at_risk = burns(FAST_PAIR, FAST_LIMIT) | burns(SLOW_PAIR, SLOW_LIMIT) | F.coalesce(F.col("left") < LOW_BUDGET, F.lit(False))
    status = (F.when(F.col("current").isNull(), "unknown").when(F.col("current") < o.target, "breached")
              .when(at_risk, "at_risk").otherwise("healthy"))
    known = F.col("valid_slo") > 0
    return base.select(
        "tenant_id", F.lit(o.name).alias("name"), F.lit(o.target).alias("target"), "current",
        F.col("left").alias("error_budget_remaining"), status.alias("status"), F.lit(o.window_days).alias("window_days"),
        half_even(F.when(known, F.col("good_slo")), 2).alias("good"), half_even(F.when(known, F.col("valid_slo")), 2).alias("valid"),
        F.lit("seconds" if o.measurement == "freshness_seconds" else "events").alias("unit"),
        "burn_1h", "burn_6h", "burn_3d", half_even("diagnostic", 4).alias("diagnostic"))


# Fixed: health limits.
FRESHNESS_SLA_SECONDS = 30
PASS_HEALTHY, PASS_DEGRADED = 0.99, 0.95


def pipeline_health(journal: DataFrame, as_of: datetime, sla: int = FRESHNESS_SLA_SECONDS) -> DataFrame:
    """Freshness and quality of the journal, and the worst of both."""
    age = F.greatest(F.lit(0.0), seconds_between(F.max("processed_at"), at(as_of)))
    recent = in_window(as_of, HOUR)
    passed = ratio(F.count_if(recent & (F.col("topic") != "events.deadletter")), F.count_if(recent))
    one = journal.agg(age.alias("age"), passed.alias("passed"))
    fresh = (F.when(F.col("age").isNull(), 1).when(F.col("age") <= sla, 0).when(F.col("age") <= sla * 3, 1).otherwise(2))
    quality = (F.when(F.col("passed").isNull(), 1).when(F.col("passed") >= PASS_HEALTHY, 0).when(F.col("passed") >= PASS_DEGRADED, 1).otherwise(2))
    names = F.array(F.lit("healthy"), F.lit("degraded"), F.lit("unhealthy"))
    rows = F.array(F.struct(F.lit("freshness").alias("component"), fresh.alias("severity"), F.col("age").alias("value")),
                   F.struct(F.lit("quality").alias("component"), quality.alias("severity"), F.col("passed").alias("value")),
                   F.struct(F.lit("overall").alias("component"), F.greatest(fresh, quality).alias("severity"), F.lit(None).cast("double").alias("value")))
    return one.select(F.explode(rows).alias("c")).select("c.component", F.get(names, F.col("c.severity")).alias("status"), "c.value")


def rolling_compliance(events: DataFrame, limit_ms: int = FRESHNESS_SLA_SECONDS * 1000, size: int | None = None) -> DataFrame:
    """Share of the events per topic within the limit; with `size`, of the last so many.

    The rank filter is applied in every task before the shuffle, so one topic ships at most size rows per task.
    """
    newest = Window.partitionBy("topic").orderBy(F.desc("processed_at"), F.desc("event_id"))
    last = events if size is None else events.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= size)
    return last.groupBy("topic").agg(F.avg((F.col("latency_ms") <= limit_ms).cast("double")).alias("compliance"),
                                     F.count("*").alias("events"))


# Fixed: histogram bounds in seconds.
LATENCY_BUCKETS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)


def latency_histogram(events: DataFrame, bounds=LATENCY_BUCKETS, seconds: Column | None = None) -> DataFrame:
    """Cumulative counts per bound, topic and type."""
    value = seconds if seconds is not None else F.col("latency_ms") / 1000.0
    wide = events.groupBy("topic", "event_type").agg(*[F.count_if(value <= b).alias(f"le_{i}") for i, b in enumerate(bounds)],
                                                     F.count(value).alias("le_inf"))
    rows = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{i}").alias("events")) for i, b in enumerate(bounds)],
                   F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("events")))
    return wide.select("topic", "event_type", F.explode(rows).alias("b")).select("topic", "event_type", "b.*")


# Fixed: where the entities of each type come from; the layer systems are those of this engine.
SOURCE_TOPIC = {"order": "orders.raw", "user": "orders.raw", "product": "products.cdc", "session": "clicks.raw"}
SOURCE_SYSTEM = {"order": "postgres_cdc", "user": "postgres_cdc", "product": "postgres_cdc", "session": "web_sdk"}
ENTITY_TABLE = {"order": "orders_v2", "user": "users_enriched", "product": "products_current", "session": "sessions_aggregated"}
LAYER_SYSTEM = {"ingestion": "kafka", "validation": "spark", "enrichment": "spark", "serving": "spark"}
STATUS_TOPIC = "orders.status"


def lineage_events(journal: DataFrame, entity_id: str | Column) -> DataFrame:
    """Ascending trail of an entity, stage rows excluded."""
    return journal.filter((F.col("entity_id") == entity_id) & (F.col("topic") != STATUS_TOPIC)).orderBy("processed_at", "event_id")


def lineage_chain(journal: DataFrame, entity_type: str, as_of: datetime) -> DataFrame:
    """Five layers per entity with times and quality scores, for all entities of the journal at once."""
    rows = journal.filter((F.col("topic") != STATUS_TOPIC) & F.col("entity_id").isNotNull())
    valid = F.col("topic") == "events.validated"
    raw_topic = ~F.col("topic").isin("events.validated", "events.deadletter")
    score = lambda mean: half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean / 1000.0)), 3)
    per = rows.groupBy("tenant_id", "entity_id").agg(
        F.min("processed_at").alias("earliest"), F.max("processed_at").alias("latest"),
        F.max(F.when(valid, F.col("processed_at"))).alias("validated_at"), F.count_if(valid).alias("n_valid"),
        F.min_by(F.when(raw_topic, F.col("topic")), F.when(raw_topic, F.struct("processed_at", "event_id"))).alias("raw_topic"),
        score(F.avg("latency_ms")).alias("q_all"), score(F.avg(F.when(valid, F.col("latency_ms")))).alias("q_valid"))
    ok = F.col("n_valid") > 0
    topic = F.coalesce("raw_topic", F.lit(SOURCE_TOPIC.get(entity_type, f"{entity_type}.raw")))
    table = F.lit(ENTITY_TABLE.get(entity_type, entity_type))
    one = F.when(ok, 1.0)

    def node(layer, system, where, when, quality):
        return F.struct(F.lit(layer).alias("layer"), F.lit(system).alias("system"), where.alias("table_or_topic"),
                        when.alias("processed_at"), quality.cast("double").alias("quality_score"))

    nodes = F.array(
        node("source", SOURCE_SYSTEM.get(entity_type, "unknown"), topic, F.col("earliest"), F.lit(None)),
        node("ingestion", LAYER_SYSTEM["ingestion"], topic, F.col("earliest"), F.coalesce("q_all", F.lit(1.0))),
        node("validation", LAYER_SYSTEM["validation"], F.lit("events.validated"), F.coalesce("validated_at", "latest"), F.coalesce(one, F.lit(0.0))),
        node("enrichment", LAYER_SYSTEM["enrichment"], table, F.col("latest"), F.coalesce("q_valid", one)),
        node("serving", LAYER_SYSTEM["serving"], table, F.col("latest"), one))
    age = half_even(F.greatest(F.lit(0.0), seconds_between("latest", at(as_of))), 3)
    return per.select("tenant_id", "entity_id", age.alias("freshness_seconds"), ok.alias("validated"), ok.alias("enriched"),
                      F.explode(nodes).alias("n")).select("tenant_id", "entity_id", "n.*", "freshness_seconds", "validated", "enriched")
