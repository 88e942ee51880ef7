"""Usage analytics over request rows (tenant, key, endpoint, status, duration, time)."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import at, ratio, rounded, seconds_before
from tidemark.operators.quantiles import exact_quantiles


def recent(sessions: DataFrame, as_of: datetime, seconds: int) -> DataFrame:
    return sessions.filter((F.col("ts") >= seconds_before(at(as_of), seconds)) & (F.col("ts") <= at(as_of)))


def top_endpoints(sessions: DataFrame, k: int = 3) -> DataFrame:
    """The k busiest endpoints per tenant; ranks run over counts, one row per endpoint."""
    counts = sessions.filter(F.col("tenant").isNotNull()).groupBy("tenant", "endpoint").agg(F.count("*").alias("requests"))
    rank = Window.partitionBy("tenant").orderBy(F.desc("requests"), "endpoint")
    return counts.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k)


def usage_by_tenant(sessions: DataFrame) -> DataFrame:
    """Requests, error and cache shares, mean duration and the top endpoints per tenant."""
    base = sessions.filter(F.col("tenant").isNotNull()).groupBy("tenant").agg(
        F.count("*").alias("total_requests"),
        rounded(ratio(F.count_if(F.col("status_code") >= 400), F.count("*")), 4).alias("error_rate"),
        rounded(ratio(F.count_if("cache_hit"), F.count("*")), 4).alias("cache_hit_rate"),
        rounded(ratio(F.sum("duration_ms"), F.count("duration_ms")), 3).alias("avg_duration_ms"))
    tops = top_endpoints(sessions).groupBy("tenant").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "endpoint"))), lambda e: e["endpoint"]), ",").alias("top_endpoints"))
    return base.join(tops, "tenant")


def most_frequent(sessions: DataFrame, columns: list[str], k: int) -> DataFrame:
    """Top-k value combinations by count, ties in value order."""
    rows = sessions
    for c in columns:
        rows = rows.filter(F.col(c).isNotNull())
    return rows.groupBy(*columns).agg(F.count("*").alias("requests")).orderBy(F.desc("requests"), *columns).limit(k)


def latency_by_endpoint(sessions: DataFrame) -> DataFrame:
    q = exact_quantiles(sessions, ["endpoint"], "duration_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("endpoint", *[rounded(c, 3).alias(c) for c in ("p50", "p95", "p99")])


def traffic_anomalies(sessions: DataFrame, as_of: datetime, seconds: int = 86400, limit: float = 3.0) -> DataFrame:
    """Tenants whose last hour with traffic exceeds the mean of their earlier hours by a factor."""
    hourly = recent(sessions, as_of, seconds).filter(F.col("tenant").isNotNull()).groupBy(
        "tenant", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    last = F.max("hour").over(Window.partitionBy("tenant"))
    per = hourly.withColumn("last", last).groupBy("tenant").agg(
        F.max(F.when(F.col("hour") == F.col("last"), F.col("n"))).alias("current_hour_requests"),
        rounded(F.avg(F.when(F.col("hour") < F.col("last"), F.col("n"))), 1).alias("hourly_average"))
    per = per.withColumn("spike_ratio", rounded(ratio("current_hour_requests", "hourly_average"), 2))
    return per.filter(F.col("spike_ratio") > limit)


def request_counts(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Requests per tenant and per key in a day, per superseded key in an hour, and the rate of the last minute."""
    day, hour, minute = (recent(sessions, as_of, s) for s in (86400, 3600, 60))
    tenant = day.groupBy(F.col("tenant").alias("key")).agg(F.count("*").cast("double").alias("value"))
    key = day.groupBy(F.concat_ws("/", "tenant", "key_name").alias("key")).agg(F.count("*").cast("double").alias("value"))
    old = hour.filter((F.col("key_slot") == "previous") & F.col("key_id").isNotNull()).groupBy(F.col("key_id").alias("key")).agg(
        F.count("*").cast("double").alias("value"))
    rate = minute.agg(rounded(F.count("*") / 60.0, 2).alias("value")).withColumn("key", F.lit("all"))
    parts = [df.select(F.lit(kind).alias("kind"), "key", "value") for kind, df in (
        ("tenant_24h", tenant), ("key_24h", key), ("previous_key_1h", old), ("per_second", rate))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
