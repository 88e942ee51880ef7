"""Worklists, their summary and the dead-letter page hold the rows of every tenant."""

import duckdb
import pytest

from tidemark.plans import QUERIES


@pytest.fixture
def base(tmp_path):
    """250 pending orders and sixty dead events, all of the tenant `acme`; the newest order sets the clock."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i * 3 AS o_orderkey, 10 AS o_custkey, 'O' AS o_orderstatus, 100.0 AS o_totalprice,
      TIMESTAMP '2024-01-01' + to_days(CAST(i AS INT)) AS o_orderdate, '4-NOT SPECIFIED' AS o_orderpriority FROM range(250) t(i)) TO '{tmp_path}/orders.parquet' (FORMAT parquet)""")
    con.execute(f"""COPY (SELECT i * 3 + 2 AS event_id, TIMESTAMP '2024-01-01' + to_minutes(CAST(i AS INT)) AS ts, 5 AS user_id, 'error' AS event_type, 1.0 AS value, '{{"k": 1}}' AS props
      FROM range(60) t(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    return str(tmp_path)


def test_second_page_of_stuck_orders_has_all_tenants(spark, base):
    rows = QUERIES["o11_stuck_orders"](spark, base).collect()
    assert len(rows) == 100 and {r["user_id"] for r in rows} == {"USR-10010"}


def test_stage_summary_counts_all_tenants(spark, base):
    assert [tuple(r) for r in QUERIES["o11_stage_summary"](spark, base).collect()] == [("pending", 250, 249)]


def test_dead_letter_page_has_all_tenants(spark, base):
    rows = QUERIES["o17_dead_letter_page"](spark, base).collect()
    assert len(rows) == 25 and {r["tenant_id"] for r in rows} == {"acme"}
