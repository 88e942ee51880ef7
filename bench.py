"""Headline timings: one JSON line. BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_RUNS the repeats."""

from __future__ import annotations

import json
import os
import statistics
import time

from tidemark.plans import QUERIES
from tidemark.session import build_session

HEADLINE = [
    # windowed metrics, sessions, service levels
    "a01_metric_revenue", "a07_metric_matrix", "s06b_sessions", "o07_slo_report", "w02_freshness_sli", "o11_stuck_orders",
    "o19_usage_by_tenant", "o20_latency_by_endpoint", "m01_latest_version", "v08_valid_split", "q05_search_entities",
    # warehouse load-test and analyst queries
    "d15_pnl_live", "d15_top_products", "d15_customer_point", "d15_return_rate", "d15_line_reach", "d15_pnl_mart",
    "d16_monthly_revenue_by_channel", "d16_aov_by_channel", "d16_sku_volume", "d16_branch_shares", "d16_order_point",
    "d16_marking_status", "d09_canonical_orders", "d06_scd2_versions",
    # streams
    "s06_session_stream", "s11_metric_stream",
]


def main() -> None:
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    timings, cold = {}, {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # every column of every row is produced and thrown away
            QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        cold[name] = round(taken[0], 3)
        timings[name] = round(statistics.median(taken[1:]), 3)
    lines = spark.read.parquet(f"{base}/lineitem.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_warm_median_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "cold": cold, "sf": base.rstrip("/").rsplit("sf", 1)[-1], "line_items": lines, "runs": runs}))


if __name__ == "__main__":
    main()
