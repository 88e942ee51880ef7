"""Queries of the warehouse: loads, business vault, marts, checks, access views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import checkdigits as k
from tidemark.functions.columns import day, iso, money, ratio, rounded
from tidemark.functions.identity import hash_diff, hash_key, pair_key
from tidemark.operators import reference as ref
from tidemark.operators import vault_business as vb
from tidemark.operators import vault_checks as vc
from tidemark.operators import vault_load as vl
from tidemark.operators.latest import latest_version
from tidemark.operators.maintenance import PART, affected, changed_buckets, fingerprints, of_buckets, replace_rows, row_changes
from tidemark.operators.ordered import previous_in_key
from tidemark.operators.quantiles import exact_quantiles
from tidemark.plans.registry import STORED, Inputs, Load, day_text, dec_round, hashed_order, query, stored, ts_text
from tidemark.session import cut_lineage, work_dir
from tidemark.sources import files, lake


def _plain(df):
    """Dates and decimals as text and doubles, so any engine's rows compare."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind.startswith("decimal"):
            out.append(money(f.name).alias(f.name))
        elif kind.startswith("timestamp"):
            out.append(iso(f.name).alias(f.name))
        elif kind == "date":
            out.append(day(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# --- keys and loads ------------------------------------------------------------------------------

@query("d01_hash_keys", """
SELECT l_orderkey, l_partkey, md5(CAST(l_orderkey AS STRING)) AS order_hk, md5(l_orderkey || '|' || l_partkey) AS link_hk,
       md5(l_orderkey || '||' || l_partkey) AS composite_hk, upper(md5(CAST(l_partkey AS STRING))) AS product_hk_hex
FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def hash_keys(t: Inputs):
    o, p = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    return t.lineitem.select("l_orderkey", "l_partkey").distinct().select(
        "l_orderkey", "l_partkey", hash_key(o).alias("order_hk"), pair_key(o, p).alias("link_hk"),
        hash_key(o, p).alias("composite_hk"), F.hex(F.unhex(hash_key(p))).alias("product_hk_hex"))


_HEADER_DIFF = """md5('channel=' || coalesce(channel, '') || '||order_date=' || strftime(order_date, '%Y-%m-%dT%H:%M:%S') || '||order_status=' || order_status
   || '||total_amount=' || CAST(total_amount AS VARCHAR))"""


@query("d02_hash_diff", f"SELECT order_hk, source, {_HEADER_DIFF} AS hash_diff FROM a_sat_header")
def header_hash_diff(t: Inputs):
    s = t.a_sat_header
    return s.select("order_hk", "source", hash_diff(s, ["order_date", "channel", "order_status", "total_amount"]).alias("hash_diff"))


@query("d03_hub_load", f"""
SELECT order_bk, order_hk, {ts_text('load_ts')} AS load_ts FROM a_hub_order
WHERE order_hk NOT IN (SELECT order_hk FROM a_hub_order WHERE load_ts < TIMESTAMP '1998-01-01')""")
def hub_load(t: Inputs):
    """A full re-delivery against a hub that already holds the orders before 1998."""
    batch = t.a_hub_order.select("order_hk", "order_bk", "load_ts").unionAll(
        t.a_hub_order.select("order_hk", "order_bk", F.col("load_ts") + F.expr("INTERVAL 1 DAY")))
    stored = t.a_hub_order.filter(F.col("load_ts") < F.lit("1998-01-01").cast("timestamp"))
    return vl.new_keys(batch, stored, "order_hk").withColumn("load_ts", iso("load_ts"))


@query("d04_link_load", """
SELECT DISTINCT md5(l_orderkey || '|' || l_partkey) AS link_hk FROM lineitem
WHERE md5(l_orderkey || '|' || l_partkey) NOT IN (SELECT md5(l_orderkey || '|' || l_partkey) FROM lineitem WHERE l_returnflag = 'R')""")
def link_load(t: Inputs):
    key = pair_key(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"))
    links = t.lineitem.select(key.alias("link_hk"), F.col("l_shipdate").alias("load_ts"))
    stored = t.lineitem.filter(F.col("l_returnflag") == "R").select(key.alias("link_hk"))
    return vl.new_keys(links, stored, "link_hk").select("link_hk")


def _status_versions(t: Inputs):
    """Line items as versions of a part's supplier: a long history with repeated values."""
    v = t.lineitem.select(F.col("l_partkey").alias("part_hk"), F.col("l_shipdate").alias("load_ts"), "l_returnflag", "l_linestatus")
    v = v.groupBy("part_hk", "load_ts").agg(F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("line_status"))
    return vl.with_hash_diff(v, ["flag", "line_status"])


_VERSIONS = """v AS (SELECT l_partkey AS part_hk, l_shipdate AS load_ts, max(l_returnflag) AS flag, max(l_linestatus) AS line_status FROM lineitem GROUP BY ALL),
     h AS (SELECT *, md5('flag=' || flag || '||line_status=' || line_status) AS hash_diff FROM v)"""


@query("d05_insert_on_change", f"""
WITH {_VERSIONS},
     stored AS (SELECT part_hk, arg_max(hash_diff, load_ts) AS cur FROM h WHERE load_ts < TIMESTAMP '1998-06-01' GROUP BY part_hk),
     batch AS (SELECT * FROM h WHERE load_ts >= TIMESTAMP '1998-06-01' QUALIFY row_number() OVER (PARTITION BY part_hk ORDER BY load_ts) = 1)
SELECT part_hk, flag, line_status, {ts_text('load_ts')} AS load_ts FROM batch LEFT JOIN stored USING (part_hk) WHERE cur IS DISTINCT FROM hash_diff""")
def insert_on_change(t: Inputs):
    rows = _status_versions(t)
    cut = F.lit("1998-06-01").cast("timestamp")
    later = rows.filter(F.col("load_ts") >= cut)
    batch = later.groupBy("part_hk").agg(F.min_by(F.struct("load_ts", "hash_diff", "flag", "line_status"), "load_ts").alias("r")).select("part_hk", "r.*")
    return vl.changed_rows(batch, rows.filter(F.col("load_ts") < cut), "part_hk").select("part_hk", "flag", "line_status", iso("load_ts").alias("load_ts"))


@query("d06_scd2_versions", f"""
WITH {_VERSIONS},
     g AS (SELECT *, lag(hash_diff) OVER (PARTITION BY part_hk ORDER BY load_ts) AS prev FROM h)
SELECT part_hk, flag, line_status, {ts_text('load_ts')} AS load_ts FROM g WHERE hash_diff IS DISTINCT FROM prev""")
def scd2_versions(t: Inputs):
    return vl.changed_versions(_status_versions(t), "part_hk").select("part_hk", "flag", "line_status", iso("load_ts").alias("load_ts"))


@query("d06_scd2_rerun", f"""
WITH {_VERSIONS}, st AS (SELECT part_hk, max(load_ts) AS m, arg_max(hash_diff, load_ts) AS cur FROM h WHERE load_ts < TIMESTAMP '1998-06-01' GROUP BY part_hk),
     b AS (SELECT h.*, m, coalesce(lag(h.hash_diff) OVER (PARTITION BY part_hk ORDER BY load_ts), cur) AS prev
           FROM h LEFT JOIN st USING (part_hk) WHERE m IS NULL OR load_ts > m)
SELECT part_hk, flag, line_status, {ts_text('load_ts')} AS load_ts FROM b WHERE hash_diff IS DISTINCT FROM prev""")
def scd2_rerun(t: Inputs):
    """The whole history delivered again on top of what was stored before mid-1998: only later changes are new."""
    rows = _status_versions(t)
    stored = rows.filter(F.col("load_ts") < F.lit("1998-06-01").cast("timestamp"))
    return vl.changed_versions(rows, "part_hk", stored).select("part_hk", "flag", "line_status", iso("load_ts").alias("load_ts"))


@query("w01_previous_instant", f"""
SELECT tenant_id, event_id, {ts_text('processed_at')} AS processed_at,
       {ts_text('lag(processed_at) OVER (PARTITION BY tenant_id ORDER BY processed_at, CAST(event_id AS BIGINT))')} AS previous_at FROM a_journal""")
def previous_instant(t: Inputs):
    """The instant before, per tenant: two keys own all rows, so the rows are placed by range, not by key."""
    rows = t.a_journal.select("tenant_id", F.col("event_id").cast("long").alias("event_no"), "event_id", "processed_at")
    out = previous_in_key(rows, ["tenant_id"], ["processed_at", "event_no"], ["processed_at"])
    return out.select("tenant_id", "event_id", iso("processed_at").alias("processed_at"), iso("prev.processed_at").alias("previous_at"))


def _diff_sql(attributes: dict) -> str:
    """Attributes in name order, each as name=value; a missing value is empty."""
    return "md5(" + " || '||' || ".join(f"'{name}=' || coalesce({attributes[name]}, '')" for name in sorted(attributes)) + ")"


def _missing(have: dict, every: tuple) -> dict:
    return {name: have.get(name, "NULL") for name in every}


_P_HK, _S_HK, _M_HK = "md5(CAST({} AS VARCHAR))", "md5('SUP-' || {})", "md5(gs1_gtin)"
_LINK = "md5(md5(CAST(l_partkey AS VARCHAR)) || '||' || md5('SUP-' || l_suppkey))"
_MARK_LINK = "md5(md5(CAST(p_partkey AS VARCHAR)) || '||' || md5(gs1_gtin))"
_SOURCING = """(SELECT l_partkey, l_suppkey, strftime(min(l_shipdate), '%Y-%m-%d') AS valid_from, CAST(CAST(min(l_quantity) AS BIGINT) AS VARCHAR) AS min_order_qty,
  CAST(min(CAST(l_extendedprice AS DECIMAL(18,2))) AS VARCHAR) AS purchase_price FROM lineitem GROUP BY l_partkey, l_suppkey)"""


@query("d08_reference_mapping", " UNION ALL ".join(f"SELECT '{target}' AS target, {key} AS hk, {mark} AS fingerprint FROM {table}" for target, key, mark, table in (
    ("hub_supplier", _S_HK.format("s_suppkey"), _S_HK.format("s_suppkey"), "supplier"),
    ("sat_supplier_profile", _S_HK.format("s_suppkey"), _diff_sql(_missing({"supplier_name": "s_name", "supplier_status": "'active'", "tax_country_code": "'RU'"}, ref.SUPPLIER_ATTRIBUTES)), "supplier"),
    ("hub_product", _P_HK.format("p_partkey"), _P_HK.format("p_partkey"), "part"),
    ("sat_product_reference", _P_HK.format("p_partkey"), _diff_sql(_missing({"product_name": "p_name", "brand": "p_brand", "category": "p_type", "units_per_pack": "CAST(p_size AS VARCHAR)",
        "pack_type": "CASE WHEN p_size > 24 THEN 'case' ELSE 'unit' END"}, ref.PRODUCT_ATTRIBUTES)), "part"),
    ("hub_marking_code", _M_HK, _M_HK, "a_marking"), ("sat_marking_code_gs1", _M_HK, _diff_sql({"gs1_gtin": "gs1_gtin", "marking_status": "marking_status"}), "a_marking"),
    ("lnk_product_marking", _MARK_LINK, _MARK_LINK, "a_marking"), ("lnk_product_supplier", _LINK, _LINK, _SOURCING),
    ("sat_sourcing", _LINK, _diff_sql(_missing({c: c for c in ("valid_from", "min_order_qty", "purchase_price")}, ref.SOURCING_ATTRIBUTES)), _SOURCING))))
def reference_mapping(t: Inputs):
    """Nine raw-vault tables; products have twelve attributes and sourcing six, those without a source NULL."""
    suppliers = t.supplier.select(F.concat(F.lit("SUP-"), F.col("s_suppkey").cast("string")).alias("supplier_bk"), F.col("s_name").alias("supplier_name"),
                                  F.lit("RU").alias("tax_country_code"), F.lit("active").alias("supplier_status"))
    products = t.part.select(F.col("p_partkey").cast("string").alias("product_bk"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
                             F.col("p_size").cast("string").alias("units_per_pack"), F.when(F.col("p_size") > 24, "case").otherwise("unit").alias("pack_type"))
    marking = t.a_marking.select(F.col("p_partkey").cast("string").alias("product_bk"), "gs1_gtin", "marking_status")
    sourcing = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(day(F.min("l_shipdate")).alias("valid_from"), F.min("l_quantity").cast("long").cast("string").alias("min_order_qty"),
                                                                F.min(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("purchase_price"))
    sourcing = sourcing.withColumns({"product_bk": F.col("l_partkey").cast("string"), "supplier_bk": F.concat(F.lit("SUP-"), F.col("l_suppkey").cast("string"))})
    mapped = ref.map_reference(suppliers, products, marking, sourcing)
    return vc.stack([rows.select(F.lit(name).alias("target"), F.col(rows.columns[0]).alias("hk"), F.col("hash_diff" if "hash_diff" in rows.columns else rows.columns[0]).alias("fingerprint"))
                     for name, rows in mapped.items()])


@query("src05_oltp_snapshot", """
SELECT order_bk, status, tx_id FROM (SELECT order_id AS order_bk, status, tx_id, op,
   row_number() OVER (PARTITION BY order_id ORDER BY lsn DESC) AS rn FROM a_changes) WHERE rn = 1 AND op <> 'd'""")
def oltp_snapshot(t: Inputs):
    """Operational rows from the change log: last version per key, deletes removed."""
    last = latest_version(t.a_changes, ["order_id"], ["lsn"], ["order_id", "status", "tx_id", "op"])
    return last.filter(F.col("op") != "d").select(F.col("order_id").alias("order_bk"), "status", "tx_id")


# --- check digits --------------------------------------------------------------------------------

_DIG = lambda i: f"CAST(substr(gs1_gtin, {i}, 1) AS INT)"
_MOD10 = "(10 - (" + " + ".join(f"{1 if i % 2 else 3} * {_DIG(i)}" for i in range(1, 13)) + ") % 10) % 10 = " + _DIG(13)


@query("k01_valid_gtin13", f"SELECT gs1_gtin, {_MOD10} AS valid, CAST(substr(gs1_gtin, 1, 3) AS INT) BETWEEN 460 AND 469 AS prefix_ok FROM a_marking")
def valid_gtin(t: Inputs):
    return t.a_marking.select("gs1_gtin", k.valid_gtin13(F.col("gs1_gtin")).alias("valid"), k.eaeu_prefix(F.col("gs1_gtin")).alias("prefix_ok"))


_INN = "(" + " + ".join(f"{w} * CAST(substr(inn, {i}, 1) AS INT)" for i, w in enumerate(k.INN10_WEIGHTS, 1)) + ") % 11 % 10 = CAST(substr(inn, 10, 1) AS INT)"


@query("k02_valid_inn10", f"SELECT c_custkey, {_INN} AS valid FROM (SELECT c_custkey, CAST(7700000000 + c_custkey * 7 AS VARCHAR) AS inn FROM customer)")
def valid_inn(t: Inputs):
    inn = (F.lit(7700000000) + F.col("c_custkey") * 7).cast("string")
    return t.customer.select("c_custkey", k.valid_inn10(inn).alias("valid"))


@query("k03_valid_gln13", f"SELECT s_suppkey, {_MOD10} AS valid FROM (SELECT s_suppkey, CAST(4600000000000 + s_suppkey * 13 AS VARCHAR) AS gs1_gtin FROM supplier)")
def valid_gln(t: Inputs):
    return t.supplier.select("s_suppkey", k.valid_gln13((F.lit(4600000000000) + F.col("s_suppkey") * 13).cast("string")).alias("valid"))


# --- business vault ------------------------------------------------------------------------------

_CANON_OUT = f"""SELECT * REPLACE ({day_text('order_date')} AS order_date, CAST(total_amount AS DOUBLE) AS total_amount, CAST(subtotal_amount AS DOUBLE) AS subtotal_amount,
  CAST(discount_amount AS DOUBLE) AS discount_amount, CAST(tax_amount AS DOUBLE) AS tax_amount, CAST(shipping_cost AS DOUBLE) AS shipping_cost,
  CAST(wb_commission AS DOUBLE) AS wb_commission, {ts_text('wb_return_window_until')} AS wb_return_window_until) FROM a_canonical"""


@query("d09_canonical_orders", _CANON_OUT)
def canonical(t: Inputs):
    return _plain(t.a_canonical.withColumn("order_date", F.to_date("order_date")))


@query("j01_order_left_joins", """
SELECT o.order_hk, CAST(p.subtotal_amount AS DOUBLE) AS subtotal_amount, st.store_hk FROM a_hub_order o
LEFT JOIN a_sat_pricing p USING (order_hk) LEFT JOIN a_lnk_order_store st USING (order_hk)""")
def order_left_joins(t: Inputs):
    return (t.by_key("a_hub_order", "order_hk").select("order_hk").join(t.by_key("a_sat_pricing", "order_hk").select("order_hk", money("subtotal_amount").alias("subtotal_amount")), "order_hk", "left")
            .join(t.by_key("a_lnk_order_store", "order_hk").select("order_hk", "store_hk"), "order_hk", "left"))


@query("a13_latest_by_version", """
SELECT order_hk, source, order_status FROM a_sat_header QUALIFY row_number() OVER (PARTITION BY order_hk ORDER BY load_ts DESC, source DESC) = 1""")
def latest_by_version(t: Inputs):
    return latest_version(t.by_key("a_sat_header", "order_hk"), ["order_hk"], ["load_ts", "source"], ["order_hk", "source", "order_status"])


@query("u01_union_satellites", """
SELECT record_source, count(*) AS versions, CAST(sum(total_amount) AS DOUBLE) AS total FROM (
  SELECT s.source || '__' || split_part(h.record_source, '__', 2) AS record_source, total_amount FROM a_sat_header s JOIN a_hub_order h USING (order_hk)) GROUP BY 1""")
def union_satellites(t: Inputs):
    """Per-source satellites folded into one, the way per-branch tables are."""
    parts = {src: t.a_sat_header.filter(F.col("source") == src).select("order_hk", "total_amount") for src in ("1c", "bitrix")}
    merged = vl.merge_satellites(parts).withColumnRenamed("record_source", "system")
    labelled = merged.join(t.a_hub_order.select("order_hk", vb.branch_of("record_source").alias("branch")), "order_hk")
    return labelled.groupBy(F.concat_ws("__", "system", "branch").alias("record_source")).agg(
        F.count("*").alias("versions"), money(F.sum("total_amount")).alias("total"))


_MASTER_OUT = f"""SELECT * REPLACE ({day_text('birth_date')} AS birth_date, {ts_text('last_visit_at')} AS last_visit_at, {ts_text('last_seen_at')} AS last_seen_at) FROM a_master"""


@query("d10_customer_master", _MASTER_OUT)
def master(t: Inputs):
    return _plain(t.a_master)


@query("d10_customer_master_branch", _MASTER_OUT + " WHERE branch = 'dxb'")
def master_branch(t: Inputs):
    return _plain(vb.customer_master(*(t.by_key(v, "customer_hk") for v in ("a_hub_customer", "a_sat_personal", "a_sat_loyalty")), "dxb"))


@query("d11_canonical_materialised", """
SELECT branch, count(*) AS orders, CAST(sum(total_amount) AS DOUBLE) AS total FROM a_canonical GROUP BY branch""")
def canonical_materialised(t: Inputs):
    """Written once per branch partition; a second write of one branch replaces that partition only."""
    path = work_dir(t.spark, "canonical")
    lake.overwrite_partitions(t.a_canonical, path, ["branch"])
    written = t.spark.read.parquet(path)
    lake.overwrite_partitions(t.a_canonical.filter(F.col("branch") == "msk"), path, ["branch"])
    del written
    return t.spark.read.parquet(path).groupBy("branch").agg(F.count("*").alias("orders"), money(F.sum("total_amount")).alias("total"))


# --- marts ---------------------------------------------------------------------------------------

def _s(expr):
    return f"CAST(sum({expr}) AS DOUBLE)"


_PNL = f"""SELECT branch, date_trunc('month', order_date)::DATE AS month, count(*) AS orders, {_s('total_amount')} AS gross_revenue, {_s('tax_amount')} AS tax_collected,
  {_s('subtotal_amount')} AS net_revenue, {_s('discount_amount')} AS discounts, {_s('shipping_cost')} AS shipping,
  count(*) FILTER (WHERE order_status = 'cancelled') AS returned_orders, coalesce(CAST(sum(total_amount) FILTER (WHERE order_status = 'cancelled') AS DOUBLE), 0) AS returned_value,
  {dec_round(f"{_s('tax_amount')} / nullif({_s('subtotal_amount')}, 0)", 4)} AS effective_tax_rate
FROM a_canonical WHERE order_date IS NOT NULL AND subtotal_amount IS NOT NULL GROUP BY ALL"""


@query("d12_branch_pnl", f"SELECT * REPLACE ({day_text('month')} AS month) FROM ({_PNL})")
def pnl(t: Inputs):
    return _plain(vb.branch_pnl(t.canonical(vb.PNL_COLUMNS)))


_C360 = """SELECT c.customer_hk, c.customer_bk, c.branch, c.loyalty_segment, c.loyalty_points, c.last_visit_at, c.pii_source, c.loyalty_source,
  coalesce(o.n, 0) AS order_count, coalesce(o.v, 0) AS lifetime_value, o.f AS first_order_dt, o.l AS last_order_dt, coalesce(o.rn, 0) AS returned_orders,
  coalesce(o.rv, 0) AS returned_value, CASE WHEN o.n > 0 THEN CAST(o.rn AS DOUBLE) / o.n ELSE 0.0 END AS return_rate
FROM a_master c LEFT JOIN (SELECT customer_hk, branch, count(*) AS n, CAST(sum(total_amount) AS DOUBLE) AS v, min(order_date) AS f, max(order_date) AS l,
   count(*) FILTER (WHERE order_status = 'cancelled') AS rn, CAST(sum(total_amount) FILTER (WHERE order_status = 'cancelled') AS DOUBLE) AS rv
   FROM a_canonical WHERE customer_hk IS NOT NULL GROUP BY ALL) o ON o.customer_hk = c.customer_hk AND o.branch = c.branch"""


@query("d13_customer_360", f"""SELECT * REPLACE ({ts_text('last_visit_at')} AS last_visit_at, {ts_text('first_order_dt')} AS first_order_dt, {ts_text('last_order_dt')} AS last_order_dt,
  round(return_rate, 8) AS return_rate) FROM ({_C360})""")
def c360(t: Inputs):
    return _plain(vb.customer_360(t.a_master, t.canonical(vb.CUSTOMER_COLUMNS))).withColumn("return_rate", F.round("return_rate", 8))


@query("j02_two_key_join", f"SELECT customer_hk, branch, order_count FROM ({_C360})")
def two_key_join(t: Inputs):
    return vb.customer_360(t.a_master, t.canonical(vb.CUSTOMER_COLUMNS)).select("customer_hk", "branch", "order_count")


_VELOCITY = f"""SELECT branch, channel, CAST(order_date::DATE - to_days(CAST(dayofweek(order_date) AS INT)) AS DATE) AS week, count(*) AS orders,
  count(*) FILTER (WHERE order_status = 'cancelled') AS returned_orders,
  {dec_round("CAST(count(*) FILTER (WHERE order_status = 'cancelled') AS DOUBLE) / count(*)", 4)} AS return_rate,
  coalesce(CAST(sum(total_amount) FILTER (WHERE order_status = 'cancelled') AS DOUBLE), 0) AS returned_value,
  coalesce(CAST(sum(tax_amount) FILTER (WHERE order_status = 'cancelled') AS DOUBLE), 0) AS returned_tax_unrecovered
FROM a_canonical WHERE order_date IS NOT NULL AND channel IS NOT NULL GROUP BY ALL"""


@query("d14_returns_velocity", f"SELECT * REPLACE ({day_text('week')} AS week) FROM ({_VELOCITY})")
def velocity(t: Inputs):
    return _plain(vb.returns_velocity(t.canonical(vb.VELOCITY_COLUMNS)))


# --- loaded tables: orders with their current versions, lines with their order, marts -------------------

ORDER_TABLES = ("orders", "lineitem", "customer", "nation")
ORDER_KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
MONTH, WEEK = ("branch", "month"), ("branch", "channel", "week")


def refresh_orders(t: Inputs, loads: dict[str, Load]) -> None:
    """Brings the loaded order tables up to the present files, by the orders that have changed.

    Fingerprints tell the buckets of orders with changed rows; those orders are derived again and compared. What differs gives
    the months, weeks and customers whose rows of the marts are made anew; parts that hold none of them are left alone. A change
    of customers or nations moves orders between branches and loads everything again.
    """
    now, orders = t.version(ORDER_TABLES), loads.get("orders")
    if orders is None or any(orders.version[x] != now[x] for x in ORDER_TABLES if x not in ORDER_KEYS):
        return
    if orders.version != now:
        after = {table: fingerprints(t.table(table), F.col(key).cast("string")).coalesce(1) for table, key in ORDER_KEYS.items()}
        noted = {}
        for table, rows in after.items():
            noted[table] = work_dir(t.spark, f"prints-{table}")
            rows.write.parquet(noted[table])
        moved = [changed_buckets(t.spark.read.parquet(orders.prints[table]), t.spark.read.parquet(noted[table])) for table in ORDER_KEYS]
        buckets = cut_lineage(moved[0].unionByName(moved[1]).distinct())
        some = t.limited(**{table: of_buckets(t.table(table), F.col(key).cast("string"), buckets) for table, key in ORDER_KEYS.items()})
        rows = cut_lineage(stored_orders(some))
        before = of_buckets(t.spark.read.parquet(orders.path).drop(PART), F.col("order_bk"), buckets)
        told = {"month": F.trunc("order_date", "month"), "week": vb.week_start("order_date")}
        changes = cut_lineage(row_changes(before.withColumns(told), rows.withColumns(told), "order_hk", ["branch", "channel", "month", "week", "customer_hk"]))
        own = cut_lineage(rows.select("order_hk").unionByName(before.select("order_hk")).distinct())
        fresh = rows.join(changes.select("order_hk"), "order_hk", "left_semi")
        replace_rows(t.spark, orders.path, changes.select("order_hk"), fresh.withColumn(PART, order_year(fresh)), ["order_bk"])
        if "lines" in loads and loads["lines"].version == orders.version:
            new = stored_lines(some)
            replace_rows(t.spark, loads["lines"].path, own, new.withColumn(PART, order_slot(new)), ["order_hk"])
            loads["lines"].version = now
        current = t.spark.read.parquet(orders.path).drop(PART)
        for name, columns, build in (("mart_pnl", MONTH, vb.branch_pnl), ("mart_velocity", WEEK, vb.returns_velocity)):
            if name in loads and loads[name].version == orders.version:
                groups = affected(changes, columns)
                own = current.withColumns({k: c for k, c in told.items() if k in columns}).join(groups, list(columns), "left_semi").select(*current.columns)
                new = build(own)
                replace_rows(t.spark, loads[name].path, groups, new.withColumn(PART, STORED[name].part(new)), [columns[-1]])
                loads[name].version = now
        if "mart_customer_360" in loads and loads["mart_customer_360"].version == orders.version:
            who = affected(changes, ["customer_hk"])
            new = vb.customer_360(t.a_master.join(who, "customer_hk", "left_semi"), current.select(*vb.CUSTOMER_COLUMNS).join(who, "customer_hk", "left_semi"))
            replace_rows(t.spark, loads["mart_customer_360"].path, who, new.withColumn(PART, customer_slot(new)), ["customer_bk"])
            loads["mart_customer_360"].version = now
        files.remove(t.spark, [orders.prints[table] for table in ORDER_KEYS])
        orders.prints.update(noted)
        orders.version = now


def order_year(rows):
    return F.coalesce(F.year("order_date"), F.lit(0))


def order_slot(rows):
    return F.pmod(F.xxhash64("order_hk"), F.lit(8)).cast("int")


def customer_slot(rows):
    return F.pmod(F.xxhash64("customer_hk"), F.lit(8)).cast("int")


@stored("orders", "order_bk", ORDER_TABLES, order_year, ORDER_KEYS, refresh_orders, {"order_hk": "md5(order_bk)"})
def stored_orders(t: Inputs):
    orders = t.numbered_orders(vb.CANONICAL_COLUMNS)
    return hashed_order(orders.join(t.numbered("a_hub_order").select("order_hk", "record_source"), "order_hk"))


@stored("lines", "order_hk", ORDER_TABLES, order_slot, refresh=refresh_orders)
def stored_lines(t: Inputs):
    """Link rows with the source of their order; no hint, the hub grows with the data. Joined by business key, hashed after it."""
    pairs = t.order_products.select(F.col("l_orderkey").cast("string").alias("order_bk"), "l_partkey")
    return pairs.join(t.a_hub_order.select("order_bk", "record_source"), "order_bk").select(
        F.md5("order_bk").alias("order_hk"), F.md5(F.col("l_partkey").cast("string")).alias("product_hk"),
        vb.branch_of("record_source").alias("branch"), vb.system_of("record_source").alias("system"))


@stored("mart_pnl", "month", ORDER_TABLES, lambda rows: F.year("month"), refresh=refresh_orders)
def stored_pnl(t: Inputs):
    return vb.branch_pnl(t.stored("orders"))


@stored("mart_customer_360", "customer_bk", ORDER_TABLES, customer_slot, refresh=refresh_orders)
def stored_customers(t: Inputs):
    return vb.customer_360(t.a_master, t.stored("orders").select(*vb.CUSTOMER_COLUMNS))


@stored("mart_velocity", "week", ORDER_TABLES, lambda rows: F.year("week"), refresh=refresh_orders)
def stored_velocity(t: Inputs):
    return vb.returns_velocity(t.stored("orders"))


@query("d15_pnl_live", f"""SELECT branch, count(*) AS orders, {_s('total_amount')} AS gross_revenue, {_s('tax_amount')} AS tax_collected FROM a_canonical
WHERE order_date IS NOT NULL GROUP BY branch""")
def pnl_live(t: Inputs):
    return t.stored("orders").filter(F.col("order_date").isNotNull()).groupBy("branch").agg(
        F.count("*").alias("orders"), money(F.sum("total_amount")).alias("gross_revenue"), money(F.sum("tax_amount")).alias("tax_collected"))


_LINES = "FROM a_lnk_order_product lp JOIN (SELECT order_hk, split_part(record_source, '__', 2) AS branch FROM a_hub_order) o USING (order_hk)"


def _lines(t: Inputs):
    return t.stored("lines")


@query("d15_top_products", f"SELECT branch, product_hk, count(*) AS lines {_LINES} GROUP BY ALL ORDER BY lines DESC, branch, product_hk LIMIT 10")
def top_products(t: Inputs):
    return _lines(t).groupBy("branch", "product_hk").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "branch", "product_hk").limit(10)


@query("d15_customer_point", f"""SELECT customer_hk, branch, loyalty_segment, loyalty_points, order_count FROM ({_C360})
WHERE customer_bk = (SELECT max(customer_bk) FROM a_hub_customer)""")
def customer_point(t: Inputs):
    """One customer of the mart: a read of the row groups that may hold the key."""
    probe = t.stored("mart_customer_360").agg(F.max("customer_bk").alias("bk")).scalar()
    return t.stored("mart_customer_360").filter(F.col("customer_bk") == probe).select("customer_hk", "branch", "loyalty_segment", "loyalty_points", "order_count")


@query("d15_return_rate", f"""SELECT branch, CAST(sum(orders) AS BIGINT) AS total_orders, CAST(sum(returned_orders) AS BIGINT) AS total_returned,
  {dec_round('CAST(sum(returned_orders) AS DOUBLE) / nullif(sum(orders), 0)', 4)} AS return_rate FROM ({_VELOCITY}) GROUP BY branch""")
def return_rate(t: Inputs):
    v = t.stored("mart_velocity")
    return v.groupBy("branch").agg(F.sum("orders").alias("total_orders"), F.sum("returned_orders").alias("total_returned"),
                                   rounded(ratio(F.sum("returned_orders"), F.sum("orders")), 4).alias("return_rate"))


@query("d15_line_reach", f"SELECT branch, count(*) AS line_items, count(DISTINCT order_hk) AS orders {_LINES} GROUP BY branch")
def line_reach(t: Inputs):
    # counted per order first: the distinct count is then a plain count and a hot branch stays partial
    per = _lines(t).groupBy("branch", "order_hk").agg(F.count("*").alias("n"))
    return per.groupBy("branch").agg(F.sum("n").alias("line_items"), F.count("*").alias("orders"))


@query("j03_facts_with_branch", f"SELECT branch, count(*) AS lines {_LINES} GROUP BY branch")
def facts_with_branch(t: Inputs):
    return _lines(t).groupBy("branch").agg(F.count("*").alias("lines"))


@query("d15_pnl_mart", f"""SELECT branch, CAST(sum(orders) AS BIGINT) AS orders, round(sum(gross_revenue), 2) AS gross_revenue,
  {dec_round('sum(tax_collected) / nullif(sum(net_revenue), 0)', 4)} AS effective_tax_rate FROM ({_PNL}) GROUP BY branch""")
def pnl_mart(t: Inputs):
    m = t.stored("mart_pnl")
    return m.groupBy("branch").agg(F.sum("orders").alias("orders"), F.round(F.sum("gross_revenue"), 2).alias("gross_revenue"),
                                   rounded(ratio(F.sum("tax_collected"), F.sum("net_revenue")), 4).alias("effective_tax_rate"))


def _headers(t: Inputs):
    """Newest header per order with the order's source."""
    return t.stored("orders").filter(F.col("header_source").isNotNull())


_HEADERS = """(SELECT h.*, o.order_bk, o.record_source FROM (SELECT * FROM a_sat_header WHERE is_deleted = 0
  QUALIFY row_number() OVER (PARTITION BY order_hk ORDER BY load_ts DESC, source DESC) = 1) h JOIN a_hub_order o USING (order_hk))"""


@query("d16_monthly_revenue_by_channel", f"""SELECT {day_text("date_trunc('month', order_date)")} AS month, channel, {_s('total_amount')} AS revenue, count(*) AS orders
FROM {_HEADERS} WHERE order_status <> 'cancelled' GROUP BY ALL""")
def monthly_revenue(t: Inputs):
    return _headers(t).filter(F.col("order_status") != "cancelled").groupBy(day(F.trunc("order_date", "month")).alias("month"), "channel").agg(
        money(F.sum("total_amount")).alias("revenue"), F.count("*").alias("orders"))


@query("d16_aov_by_channel", f"""SELECT channel, {dec_round('CAST(sum(total_amount) AS DOUBLE) / count(*)', 4)} AS aov,
  {dec_round('quantile_cont(CAST(total_amount AS DOUBLE), 0.5)', 4)} AS median_check, count(*) AS orders FROM {_HEADERS} GROUP BY channel""")
def aov(t: Inputs):
    h = _headers(t)
    means = h.groupBy("channel").agg(rounded(ratio(F.sum("total_amount"), F.count("*")), 4).alias("aov"), F.count("*").alias("orders"))
    medians = exact_quantiles(h, ["channel"], "total_amount", {"median_check": 0.5})
    return means.join(medians.withColumn("median_check", rounded("median_check", 4)), "channel")


@query("d16_sku_volume", """SELECT product_hk, count(*) AS lines FROM a_lnk_order_product
WHERE order_hk IN (SELECT order_hk FROM a_hub_order WHERE split_part(record_source, '__', 1) = 'mp') GROUP BY product_hk""")
def sku_volume(t: Inputs):
    return t.stored("lines").filter(F.col("system") == "mp").groupBy("product_hk").agg(F.count("*").alias("lines")).orderBy(F.desc("lines"), "product_hk")


@query("d16_branch_shares", f"SELECT record_source, {_s('total_amount')} AS revenue, count(*) AS orders FROM {_HEADERS} GROUP BY record_source")
def branch_shares(t: Inputs):
    return _headers(t).groupBy("record_source").agg(money(F.sum("total_amount")).alias("revenue"), F.count("*").alias("orders"))


@query("d16_order_point", f"""SELECT {day_text('order_date')} AS order_date, order_status, CAST(total_amount AS DOUBLE) AS total_amount,
  (SELECT count(*) FROM a_lnk_order_product WHERE order_hk IN (SELECT order_hk FROM a_hub_order WHERE order_bk = (SELECT max(order_bk) FROM a_hub_order))) AS line_count
FROM {_HEADERS} WHERE order_bk = (SELECT max(order_bk) FROM a_hub_order)""")
def order_point(t: Inputs):
    """One order and its lines: both keys are literals, so two pruned reads."""
    probe = t.stored("orders").agg(F.max("order_bk").alias("bk")).scalar()
    head = _headers(t).filter(F.col("order_bk") == probe).select("order_hk", day("order_date").alias("order_date"), "order_status", money("total_amount").alias("total_amount"))
    keys = [r["order_hk"] for r in t.stored("orders").filter(F.col("order_bk") == probe).select("order_hk").collect()]  # one key
    lines = t.stored("lines").filter(F.col("order_hk").isin(keys)).agg(F.count("*").alias("line_count"))
    return head.drop("order_hk").join(F.broadcast(lines))


@query("d16_marking_status", "SELECT marking_status, count(*) AS codes FROM a_marking GROUP BY marking_status")
def marking_status(t: Inputs):
    return t.a_marking.groupBy("marking_status").agg(F.count("*").alias("codes"))


@query("d17_vat_rate", f"""SELECT branch, {dec_round('avg(CAST(tax_amount AS DOUBLE) / nullif(CAST(subtotal_amount AS DOUBLE), 0))', 4)} AS vat_rate FROM a_canonical GROUP BY branch""")
def vat_rate(t: Inputs):
    return t.canonical(("branch", "tax_amount", "subtotal_amount")).groupBy("branch").agg(rounded(F.avg(ratio("tax_amount", "subtotal_amount")), 4).alias("vat_rate"))


# --- checks --------------------------------------------------------------------------------------

def _count_sql(name: str, got: str, want: str) -> str:
    return f"SELECT 'rowcount:{name}' AS name, got = want AS passed, 'expected ' || want || ', got ' || got AS detail FROM (SELECT ({got}) AS got, ({want}) AS want)"


def _mix_sql(name: str, column: str, weight: str, table: str, bands: dict) -> str:
    """Shares of the values of a column, each within its band."""
    shares = ", ".join(f"coalesce(CAST(sum({weight}) FILTER (WHERE {column} = '{v}') AS DOUBLE) / nullif(CAST(sum({weight}) AS DOUBLE), 0), 0) AS s{i}" for i, v in enumerate(bands))
    inside = " AND ".join(f"s{i} BETWEEN {low} AND {high}" for i, (low, high) in enumerate(bands.values()))
    shown = " || ' ' || ".join(f"'{v}=' || printf('%.4f', s{i})" for i, v in enumerate(bands))
    return f"SELECT '{name}' AS name, coalesce({inside}, false) AS passed, {shown} AS detail FROM (SELECT {shares} FROM {table})"


# what each loaded table must have as many rows as
_COUNTS = {
    "hub_order": ("SELECT count(*) FROM a_hub_order", "SELECT count(*) FROM orders"),
    "lnk_order_customer": ("SELECT count(*) FROM a_lnk_order_customer", "SELECT count(*) FROM orders"),
    "lnk_order_store": ("SELECT count(*) FROM a_lnk_order_store", "SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT'"),
    "lnk_order_product": ("SELECT count(*) FROM a_lnk_order_product", "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)"),
    "hub_customer": ("SELECT count(*) FROM a_hub_customer", "SELECT count(*) FROM customer"),
    "hub_product": ("SELECT count(DISTINCT product_hk) FROM a_lnk_order_product", "SELECT count(DISTINCT l_partkey) FROM lineitem"),
    "hub_store": ("SELECT count(DISTINCT store_hk) FROM a_lnk_order_store", "SELECT count(*) FROM region"),
    "hub_marking_code": ("SELECT count(DISTINCT gs1_gtin) FROM a_marking", "SELECT count(*) FROM part"),
    "sat_marking_code": ("SELECT count(*) FROM a_marking", "SELECT count(*) FROM part"),
    "order_header": ("SELECT count(*) FROM h", "SELECT count(*) FROM orders"),
}
_ORDER_MIX = {"marketplace": (0.55, 0.65), "b2b": (0.15, 0.25), "d2c": (0.15, 0.25)}
_REVENUE_MIX = {"b2b": (0.65, 0.72), "marketplace": (0.27, 0.33)}
_BRANCH_SHARE = {"msk": (0.15, 0.25)}
_STATUS_FLOW = {"pending": (0.075, 0.085), "confirmed": (0.095, 0.105), "shipped": (0.115, 0.125), "delivered": (0.615, 0.625), "cancelled": (0.075, 0.085)}
_MARKING_MIX = {"issued": (0.2, 0.3), "in_circulation": (0.5, 0.6), "withdrawn": (0.1, 0.2)}


@query("d18_scale_checks", f"WITH h AS {_HEADERS} " + " UNION ALL ".join([
    *(_count_sql(name, got, want) for name, (got, want) in _COUNTS.items()),
    _mix_sql("order-count mix", "channel", "1", "h", _ORDER_MIX), _mix_sql("revenue mix", "channel", "total_amount", "h", _REVENUE_MIX),
    """SELECT 'average bands', coalesce(m BETWEEN 200000 AND 300000 AND b BETWEEN 100000 AND 200000 AND i = 0, false), printf('marketplace=%.2f b2b=%.2f', m, b) FROM
   (SELECT max(a) FILTER (WHERE channel = 'marketplace') AS m, max(a) FILTER (WHERE channel = 'b2b') AS b, count(*) FILTER (WHERE a > 10000 AND a < 25000) AS i FROM (SELECT channel, avg(total_amount) AS a FROM h GROUP BY channel))""",
    _mix_sql("branch revenue share", "split_part(record_source, '__', 2)", "total_amount", "h", _BRANCH_SHARE), _mix_sql("status flow", "order_status", "1", "h", _STATUS_FLOW),
    f"""SELECT 'gtin validity', bad = 0, bad || ' invalid of ' || n FROM (SELECT count(*) FILTER (WHERE NOT ({_MOD10} AND CAST(substr(gs1_gtin, 1, 3) AS INT) BETWEEN 460 AND 469)) AS bad, count(*) AS n FROM a_marking)""",
    _mix_sql("marking status mix", "marking_status", "1", "a_marking", _MARKING_MIX)]))
def scale_checks(t: Inputs):
    """Seventeen checks: ten counts, the mixes of orders, revenue, branches and statuses, averages, and two of the marking codes."""
    h = _headers(t).withColumn("_branch", vb.branch_of("record_source"))
    one = F.lit(1.0)
    counted = {"hub_order": (t.a_hub_order, t.orders), "lnk_order_customer": (t.a_lnk_order_customer, t.orders), "lnk_order_store": (t.a_lnk_order_store, t.orders.filter("o_orderpriority = '1-URGENT'")),
               "lnk_order_product": (t.a_lnk_order_product, t.lineitem.select("l_orderkey", "l_partkey").distinct()), "hub_customer": (t.a_hub_customer, t.customer),
               "hub_product": (t.a_lnk_order_product.select("product_hk").distinct(), t.lineitem.select("l_partkey").distinct()),
               "hub_store": (t.a_lnk_order_store.select("store_hk").distinct(), t.region), "hub_marking_code": (t.a_marking.select("gs1_gtin").distinct(), t.part),
               "sat_marking_code": (t.a_marking, t.part), "order_header": (h, t.orders)}
    return vc.stack([
        *(vc.row_count(got, name, want) for name, (got, want) in counted.items()),
        vc.mix(h, "order-count mix", "channel", one, _ORDER_MIX), vc.mix(h, "revenue mix", "channel", F.col("total_amount"), _REVENUE_MIX),
        vc.average_bands(h, "average bands", "channel", "total_amount", {"marketplace": (200000, 300000), "b2b": (100000, 200000)}, (10000, 25000)),
        vc.mix(h, "branch revenue share", "_branch", F.col("total_amount"), _BRANCH_SHARE), vc.mix(h, "status flow", "order_status", one, _STATUS_FLOW),
        vc.gtin_scan(t.a_marking), vc.mix(t.a_marking, "marking status mix", "marking_status", one, _MARKING_MIX)])


# the expectations of each mart: columns that are never missing, and the values a column may have
_MART_TESTS = {"customer_360": (["customer_hk", "branch", "return_rate", "pii_source"], {"branch": vl.BRANCHES}), "branch_pnl": (["branch", "month"], {"branch": vl.BRANCHES}),
               "returns_velocity": (["branch", "channel", "week", "return_rate"], {"branch": vl.BRANCHES})}


def _tests_sql(table: str) -> str:
    missing, accepted = _MART_TESTS[table]
    tests = [(f"{table}.{c} not_null", f"{c} IS NULL") for c in missing]
    tests += [(f"{table}.{c} accepted_values", f"{c} NOT IN ({', '.join(repr(v) for v in values)})") for c, values in accepted.items()]
    return " UNION ALL ".join(f"SELECT '{name}' AS name, count(*) FILTER (WHERE {bad}) = 0 AS passed, count(*) FILTER (WHERE {bad}) || ' failing' AS detail FROM {table}" for name, bad in tests)


@query("d19_mart_tests", f"WITH branch_pnl AS ({_PNL}), returns_velocity AS ({_VELOCITY}), customer_360 AS ({_C360}) " + " UNION ALL ".join(_tests_sql(m) for m in _MART_TESTS))
def mart_tests(t: Inputs):
    marts = {"customer_360": t.stored("mart_customer_360"), "branch_pnl": t.stored("mart_pnl"), "returns_velocity": t.stored("mart_velocity")}
    return vc.stack([vc.data_tests(rows, name, *_MART_TESTS[name]) for name, rows in marts.items()])


@query("d24_reference_checks", """
WITH ladder AS (SELECT p_partkey, p_retailprice AS retail, min(l_extendedprice / l_quantity) AS purchase FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
     q AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS spend FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 91 DAY GROUP BY 1)
SELECT 'purchase below retail' AS name, bad = 0 AS passed, bad || ' of ' || n AS detail FROM (SELECT count(*) FILTER (WHERE purchase >= retail) AS bad, count(*) AS n FROM ladder)
UNION ALL SELECT 'tariff code', bad = 0, bad || ' of ' || n FROM (SELECT count(*) FILTER (WHERE NOT regexp_full_match(code, '[0-9]{10}') OR substr(code, 1, 4) NOT IN ('8422', '8423', '8509', '8516')) AS bad, count(*) AS n
   FROM (SELECT CASE WHEN p_size < 40 THEN '8516000000' ELSE '9999000000' END AS code FROM part))
UNION ALL SELECT 'loyalty branches', bad = 0, bad || ' of ' || n FROM (SELECT count(*) FILTER (WHERE split_part(h.record_source, '__', 2) NOT IN ('msk', 'spb', 'ekb')) AS bad, count(*) AS n
   FROM a_sat_loyalty l JOIN a_hub_customer h USING (customer_hk))
UNION ALL SELECT 'loyalty cap', bad = 0, bad || ' of ' || n FROM (SELECT count(*) FILTER (WHERE l.loyalty_points > 0.03 * coalesce(spend, 0)) AS bad, count(*) AS n
   FROM a_sat_loyalty l LEFT JOIN (SELECT md5(CAST(o_custkey AS VARCHAR)) AS customer_hk, spend FROM q) USING (customer_hk))""")
def reference_checks(t: Inputs):
    purchase = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("purchase"))
    ladder = t.part.join(purchase, "p_partkey")
    code = F.when(F.col("p_size") < 40, "8516000000").otherwise("9999000000")
    tariff = ~code.rlike("^[0-9]{10}$") | ~F.substring(code, 1, 4).isin("8422", "8423", "8509", "8516")
    members = t.a_sat_loyalty.join(t.a_hub_customer.select("customer_hk", vb.branch_of("record_source").alias("branch")), "customer_hk")
    quarter = t.a_orders.filter(F.col("created_at") > F.lit(t.orders_as_of).cast("timestamp") - F.expr("INTERVAL 91 DAY"))
    spend = t.orders.join(quarter.select(F.col("src_key").alias("o_orderkey")), "o_orderkey", "left_semi").groupBy(
        hash_key(F.col("o_custkey")).alias("customer_hk")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("spend"))
    capped = t.a_sat_loyalty.join(spend, "customer_hk", "left")
    limit = F.lit(0.03).cast("decimal(3,2)") * F.coalesce("spend", F.lit(0).cast("decimal(18,2)"))
    return vc.stack([
        vc.violations(ladder, "purchase below retail", F.col("purchase") >= F.col("p_retailprice")),
        vc.violations(t.part, "tariff code", tariff),
        vc.violations(members, "loyalty branches", ~F.col("branch").isin("msk", "spb", "ekb")),
        vc.violations(capped, "loyalty cap", F.col("loyalty_points") > limit)])


# --- access and cold tier --------------------------------------------------------------------------

_AGE = "2024 - year(birth_date)"
_ANON = f"""SELECT customer_hk, CASE WHEN {_AGE} <= 24 THEN '18-24' WHEN {_AGE} <= 34 THEN '25-34' WHEN {_AGE} <= 44 THEN '35-44' WHEN {_AGE} <= 54 THEN '45-54' ELSE '55+' END AS age_bucket,
  branch AS geo_region, coalesce(loyalty_segment, 'new') AS customer_segment, last_seen_at AS load_ts, '1c__' || branch AS record_source FROM a_master WHERE birth_date IS NOT NULL"""


@query("d20_anonymised_customers", f"SELECT * REPLACE ({ts_text('load_ts')} AS load_ts) FROM ({_ANON})")
def anonymised(t: Inputs):
    return _plain(vb.anonymised_customers(t.a_master, 2024).drop("is_deleted"))


@query("d21_analyst_view", f"""SELECT customer_hk, customer_bk, branch, loyalty_segment, loyalty_points, {ts_text('last_visit_at')} AS last_visit_at, pii_source, loyalty_source,
  {ts_text('last_seen_at')} AS last_seen_at FROM a_master""")
def analyst_view(t: Inputs):
    return _plain(vb.analyst_view(t.a_master))


@query("d22_jurisdiction_view", "SELECT customer_hk, customer_bk, record_source FROM a_hub_customer WHERE split_part(record_source, '__', 2) = 'ala'")
def jurisdiction(t: Inputs):
    return vb.jurisdiction_view(t.a_hub_customer, "ala").select("customer_hk", "customer_bk", "record_source")


@query("snk05_cold_offload", f"""SELECT upper(customer_hk) AS customer_hk_hex, age_bucket, geo_region, customer_segment, {ts_text('load_ts')} AS load_ts, record_source,
  geo_region AS branch, 2024 AS year, 5 AS month FROM ({_ANON}) """)
def cold_offload(t: Inputs):
    path = work_dir(t.spark, "cold")
    sat = vb.anonymised_customers(t.a_master, 2024)
    for branch in vl.BRANCHES:
        lake.cold_offload(sat, path, branch, 2024, 5)
    lake.cold_offload(sat, path, "msk", 2024, 5)  # a re-run replaces the branch's file
    return _plain(t.spark.read.parquet(path))


@query("src06_cold_counts", f"SELECT geo_region AS branch, 2024 AS year, 5 AS month, count(*) AS row_count FROM ({_ANON}) GROUP BY geo_region")
def cold_counts(t: Inputs):
    path = work_dir(t.spark, "cold")
    sat = vb.anonymised_customers(t.a_master, 2024)
    for branch in vl.BRANCHES:
        lake.cold_offload(sat, path, branch, 2024, 5)
    return lake.cold_counts(t.spark, path)
