"""Every registered query runs on whole tables, and agrees with its check SQL where it has one."""

import pytest
from oracle_check import compare, duck

from tidemark.operators.sketches import union_of
from tidemark.plans import ORACLES, QUERIES
from tidemark.plans.registry import Inputs

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(BASE)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, name):
    ok, _, _, note = compare(spark, con, name, QUERIES[name], ORACLES.get(name), BASE)
    assert ok, note


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_approximate_distinct_is_close(spark):
    t = Inputs(spark, BASE)
    near = {r["l_returnflag"]: r["estimate"] for r in union_of(t.stored("order_sketches"), ["l_returnflag"]).collect()}
    exact = {r["l_returnflag"]: r["orders"] for r in QUERIES["a11_exact_distinct_orders"](spark, BASE).collect()}
    assert set(near) == set(exact) and all(abs(near[k] - exact[k]) <= 0.01 * exact[k] for k in exact)


def test_alert_stream_equals_batch(spark):
    batch = sorted(map(tuple, QUERIES["o25_alert_states"](spark, BASE).collect()), key=repr)
    stream = sorted(map(tuple, QUERIES["o25_alert_stream"](spark, BASE).collect()), key=repr)
    assert batch == stream
