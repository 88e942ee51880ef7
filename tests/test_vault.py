"""Loads, history, canonical orders, access."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators import vault_business as vb
from tidemark.operators import vault_load as vl

T0 = datetime(2024, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


SAT = "hk string, load_ts timestamp, hash_diff string"


def test_declared_tables():
    tables = vl.satellite_tables()
    assert (len(tables), len(vl.HUBS), len(vl.LINKS)) == (48, 8, 8)
    assert tables["sat_order_header__bitrix__ala"].fieldNames() == ["order_hk", "load_ts", "hash_diff", "record_source", "order_date", "channel", "order_status", "total_amount", "is_deleted"]


def test_classification_fails_closed(spark):
    names = sorted(vl.satellite_tables())
    assert vl.unclassified(spark, names[:-1], names[-1:]).count() == 0
    assert [r[0] for r in vl.unclassified(spark, names[:-2], names[-1:]).collect()] == [names[-2]]
    assert [r[0] for r in vl.unclassified(spark, names, names[:1]).collect()] == [names[0]]


def test_there_and_back_keeps_three_versions(spark):
    batch = spark.createDataFrame([("k", day(0), "A"), ("k", day(1), "B"), ("k", day(2), "A"), ("k", day(3), "A")], SAT)
    first = vl.changed_versions(batch, "hk")
    assert [r["hash_diff"] for r in first.orderBy("load_ts").collect()] == ["A", "B", "A"]
    assert vl.changed_versions(batch, "hk", first).count() == 0
    newer = spark.createDataFrame([("k", day(9), "A"), ("k", day(10), "C"), ("n", day(0), "A"), ("k", day(1), "Z")], SAT)
    added = vl.changed_versions(newer, "hk", first)
    assert sorted((r["hk"], r["hash_diff"]) for r in added.collect()) == [("k", "C"), ("n", "A")]
    assert [r["hash_diff"] for r in vl.late_rows(newer, first, "hk").collect()] == ["Z"]


def test_history_of_a_hot_key_equals_a_loop(spark):
    rng = random.Random(2)
    rows = list({("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 9)}", day(rng.randint(0, 900)), None) for _ in range(2000)})
    rows = [(k, t, rng.choice("AB")) for k, t, _ in rows]
    got = sorted((r["hk"], r["load_ts"], r["hash_diff"]) for r in vl.changed_versions(spark.createDataFrame(rows, SAT), "hk").collect())
    want, last = [], {}
    for k, t, h in sorted(rows):
        if last.get(k) != h:
            want.append((k, t, h))
        last[k] = h
    assert got == want


def test_hub_takes_the_earliest_row_of_a_new_key(spark):
    batch = spark.createDataFrame([("a", day(2), "s1"), ("a", day(1), "s2"), ("b", day(1), "s1")], "hk string, load_ts timestamp, record_source string")
    stored = batch.filter("hk = 'b'")
    assert [tuple(r) for r in vl.new_keys(batch, stored, "hk").collect()] == [("a", day(1), "s2")]


def test_change_against_the_current_version_only(spark):
    stored = spark.createDataFrame([("k", day(0), "A"), ("k", day(1), "B")], SAT)
    back = spark.createDataFrame([("k", day(2), "A")], SAT)
    same = spark.createDataFrame([("k", day(2), "B")], SAT)
    assert vl.changed_rows(back, stored, "hk").count() == 1
    assert vl.changed_rows(same, stored, "hk").count() == 0


def orders_fixture(spark):
    """Eight orders over five branches; two header sources, a tombstone, a missing price, three tax rates."""
    hub = [(f"h{i}", f"O{i}", f"mp__{b}", T0) for i, b in enumerate(["msk", "spb", "ekb", "dxb", "ala", "msk", "spb", "dxb"])]
    head = []
    for i in range(8):
        head.append((f"h{i}", "1c", T0, "marketplace", "pending", Decimal("100.00"), day(0), 0))
    head += [("h0", "bitrix", T0, "marketplace", "delivered", Decimal("120.00"), day(1), 0),   # newer CRM row
             ("h1", "bitrix", T0, "marketplace", "cancelled", Decimal("90.00"), day(-1), 0),   # older CRM row
             ("h5", "bitrix", T0, None, "deleted", Decimal("0.00"), day(2), 1)]                # newest is a tombstone
    rate = {"msk": "0.20", "spb": "0.20", "ekb": "0.20", "dxb": "0.05", "ala": "0.12"}
    price = [(f"h{i}", Decimal("100.00"), Decimal("0.00"), Decimal("100") * Decimal(rate[hub[i][2][4:]]), Decimal("5.00"), day(0), 0) for i in range(8) if i != 6]
    return dict(
        hub=spark.createDataFrame(hub, "order_hk string, order_bk string, record_source string, load_ts timestamp"),
        header=spark.createDataFrame(head, "order_hk string, source string, order_date timestamp, channel string, order_status string, total_amount decimal(18,2), load_ts timestamp, is_deleted int"),
        pricing=spark.createDataFrame(price, "order_hk string, subtotal_amount decimal(18,2), discount_amount decimal(18,2), tax_amount decimal(18,2), shipping_cost decimal(18,2), load_ts timestamp, is_deleted int"),
        marketplace=spark.createDataFrame([("h0", "sold", Decimal("9.00"), T0, day(0), 0)], "order_hk string, wb_status string, wb_commission decimal(18,2), wb_return_window_until timestamp, load_ts timestamp, is_deleted int"),
        link_customer=spark.createDataFrame([("h0", "c1", day(0)), ("h0", "c2", day(1))], "order_hk string, customer_hk string, load_ts timestamp"),
        link_store=spark.createDataFrame([], "order_hk string, store_hk string, load_ts timestamp"))


def test_canonical_orders(spark):
    parts = orders_fixture(spark)
    rows = {r["order_bk"]: r for r in vb.canonical_orders(**parts).collect()}
    assert len(rows) == 8
    assert (rows["O0"]["order_status"], rows["O0"]["header_source"], rows["O0"]["customer_hk"], rows["O0"]["marketplace_source"]) == ("delivered", "bitrix__msk", "c2", "wb__msk")
    assert (rows["O1"]["order_status"], rows["O1"]["header_source"]) == ("pending", "1c__spb")
    assert rows["O5"]["order_status"] == "pending"  # a newer tombstone does not win
    assert (rows["O6"]["subtotal_amount"], rows["O6"]["pricing_source"]) == (None, None)
    strict = {r["order_bk"]: r for r in vb.canonical_orders(**parts, respect_deletes=True).collect()}
    assert (strict["O5"]["order_status"], strict["O5"]["header_source"]) == (None, None)
    ranked = {r["order_bk"]: r for r in vb.canonical_orders(**parts, source_priority=True).collect()}
    assert (ranked["O1"]["order_status"], ranked["O1"]["header_source"]) == ("cancelled", "bitrix__spb")
    few = vb.canonical_orders(**parts, columns=("branch", "tax_amount"))
    assert few.count() == 8 and few.columns == ["branch", "tax_amount"]


def test_tax_rates_per_branch(spark):
    pnl = {r["branch"]: r for r in vb.branch_pnl(vb.canonical_orders(**orders_fixture(spark))).collect()}
    assert {b: r["effective_tax_rate"] for b, r in pnl.items()} == {"msk": 0.2, "spb": 0.2, "ekb": 0.2, "dxb": 0.05, "ala": 0.12}
    assert pnl["spb"]["orders"] == 1  # the order without a price is left out


def test_week_starts_on_sunday(spark):
    days = spark.createDataFrame([("2024-01-06",), ("2024-01-07",), ("2024-01-08",)], "d string").select(F.to_timestamp("d").alias("d"))
    assert [str(r["w"]) for r in days.select(vb.week_start("d").alias("w")).collect()] == ["2023-12-31", "2024-01-07", "2024-01-07"]


def test_access_views(spark):
    row = {c: None for c in (*vb.ANALYST_COLUMNS, *vb.PII_COLUMNS)}
    ddl = ", ".join(f"{c} string" for c in row)
    view = vb.analyst_view(spark.createDataFrame([tuple(row.values())], ddl))
    assert not set(view.columns) & set(vb.PII_COLUMNS) and len(view.columns) == 9
    hub = spark.createDataFrame([("1c__msk",), ("oltp__ala",), ("site__msk",)], "record_source string")
    assert [vb.jurisdiction_view(hub, b).count() for b in ("msk", "ala", "dxb", None)] == [2, 1, 0, 3]
