"""Raw vault loads: hubs and links take new keys, satellites take changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.identity import hash_diff
from tidemark.operators.latest import drop_known, latest_version
from tidemark.operators.ordered import previous_in_key

BRANCHES = ("msk", "spb", "ekb", "dxb", "ala")


def new_keys(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Hub or link load: the earliest batch row of every key that is not stored."""
    values = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*values), F.struct("load_ts", *[v for v in values if v != "load_ts"]))
                                   .alias("_row")).select(key, "_row.*")
    return drop_known(first, stored, [key]).select(*batch.columns)


def with_hash_diff(batch: DataFrame, attributes: Sequence[str]) -> DataFrame:
    return batch.withColumn("hash_diff", hash_diff(batch, attributes))


def changed_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Satellite load, one version per key in the batch: rows that differ from the *current* stored version."""
    current = latest_version(stored, [key], ["load_ts", "hash_diff"], [key, "load_ts", "hash_diff"]).select(
        key, F.col("hash_diff").alias("_current"))
    joined = batch.join(current, key, "left")
    return joined.filter(~F.col("hash_diff").eqNullSafe(F.col("_current"))).drop("_current")


def changed_versions(batch: DataFrame, key: str, stored: DataFrame | None = None) -> DataFrame:
    """Satellite load with many versions per key: drop versions equal to the one before.

    A -> B -> A keeps three rows. The stored current version stands before the batch, so a re-run adds nothing.
    Rows not newer than the stored current version are left out; `late_rows` returns them.
    """
    rows = batch.withColumn("_stored", F.lit(0))
    if stored is not None:
        current = latest_version(stored, [key], ["load_ts", "hash_diff"], [key, "load_ts", "hash_diff"])
        newest = current.select(key, F.col("load_ts").alias("_stored_ts"))
        rows = (rows.join(newest, key, "left").filter(F.col("_stored_ts").isNull() | (F.col("load_ts") > F.col("_stored_ts")))
                .drop("_stored_ts"))
        rows = rows.unionByName(current.withColumn("_stored", F.lit(1)), allowMissingColumns=True)
    ordered = previous_in_key(rows, [key], ["load_ts", "hash_diff"], ["hash_diff"])
    return ordered.filter((F.col("_stored") == 0) & ~F.col("hash_diff").eqNullSafe(F.col("prev.hash_diff"))).drop(
        "_stored", "prev")


def late_rows(batch: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Batch rows not newer than the stored current version of their key."""
    newest = stored.groupBy(key).agg(F.max("load_ts").alias("_stored_ts"))
    return batch.join(newest, key).filter(F.col("load_ts") <= F.col("_stored_ts")).drop("_stored_ts")


# --- declared satellites -------------------------------------------------------------------------

@dataclass(frozen=True)
class Satellite:
    """A satellite family: one table per record source, all with the same attributes."""

    entity: str
    parent: str
    key: str
    sources: tuple[str, ...]
    attributes: str  # DDL
    pii: bool = False
    extra: dict = field(default_factory=dict, compare=False)

    def tables(self) -> dict[str, T.StructType]:
        ddl = f"{self.key} binary, load_ts timestamp, hash_diff binary, record_source string, {self.attributes}, is_deleted boolean"
        return {f"{self.entity}__{s}": T.StructType.fromDDL(ddl) for s in self.sources}


def _each(source: str, branches: Sequence[str] = BRANCHES) -> tuple[str, ...]:
    return tuple(f"{source}__{b}" for b in branches)


# Fixed: hubs, links and satellite families of the warehouse.
HUBS = ("customer", "employee", "marking_code", "order", "product", "shipment", "store", "supplier")
LINKS = ("order_customer", "order_employee", "order_product", "order_shipment", "order_store",
         "product_marking", "product_supplier", "shipment_store")
SATELLITES = (
    Satellite("sat_customer_personal", "hub_customer", "customer_hk", _each("1c"),
              "first_name string, last_name string, email string, phone string, birth_date date, pii_flag boolean", pii=True),
    Satellite("sat_customer_loyalty", "hub_customer", "customer_hk", _each("bitrix", BRANCHES[:3]),
              "loyalty_segment string, loyalty_points decimal(18,2), last_visit_at timestamp"),
    Satellite("sat_customer_behavior", "hub_customer", "customer_hk", ("site__msk",),
              "cart_events_30d bigint, view_events_30d bigint, last_event_at timestamp"),
    Satellite("sat_customer_anon", "hub_customer", "customer_hk", _each("1c"),
              "age_bucket string, geo_region string, customer_segment string"),
    Satellite("sat_product_catalog", "hub_product", "product_hk", ("1c__msk",),
              "product_name string, brand string, category string, size_code string, color string, tnved_code string"),
    Satellite("sat_product_price", "hub_product", "product_hk", ("1c__msk",),
              "retail_price decimal(18,2), wholesale_price decimal(18,2), currency_code string, valid_from timestamp"),
    Satellite("sat_product_stock", "hub_product", "product_hk", ("wms__msk",),
              "qty_on_hand decimal(18,3), qty_reserved decimal(18,3), qty_available decimal(18,3)"),
    Satellite("sat_product_marketplace", "hub_product", "product_hk", ("wb__msk",),
              "wb_id string, wb_price decimal(18,2), wb_status string, wb_rating decimal(5,2)"),
    Satellite("sat_order_header", "hub_order", "order_hk", _each("bitrix") + _each("1c"),
              "order_date timestamp, channel string, order_status string, total_amount decimal(18,2)"),
    Satellite("sat_order_pricing", "hub_order", "order_hk", _each("1c"),
              "subtotal_amount decimal(18,2), discount_amount decimal(18,2), tax_amount decimal(18,2), shipping_cost decimal(18,2)"),
    Satellite("sat_order_marketplace", "hub_order", "order_hk", ("wb__msk",),
              "wb_status string, wb_commission decimal(18,2), return_window_until date"),
    Satellite("sat_shipment_logistics", "hub_shipment", "shipment_hk", ("wms__msk",),
              "shipment_status string, carrier_name string, shipped_at timestamp, delivered_at timestamp"),
    Satellite("sat_shipment_plan", "hub_shipment", "shipment_hk", ("excel__msk",),
              "planned_ship_date date, planned_delivery_date date, route_code string"),
    Satellite("sat_store_master", "hub_store", "store_hk", ("1c__global",),
              "store_name string, branch_code string, city string, country_code string, opened_at date"),
    Satellite("sat_supplier_profile", "hub_supplier", "supplier_hk", ("1c__global",),
              "supplier_name string, tax_country_code string, supplier_status string"),
    Satellite("sat_supplier_profile", "hub_supplier", "supplier_hk", ("ref__global",),
              "supplier_name string, tax_country_code string, supplier_status string, gln string"),
    Satellite("sat_employee_profile", "hub_employee", "employee_hk", ("1c_zup__msk",),
              "first_name string, last_name string, role_name string, employment_status string", pii=True),
    Satellite("sat_employee_sales", "hub_employee", "employee_hk", ("bitrix__msk",),
              "bitrix_user_id string, sales_team string, manager_flag boolean"),
    Satellite("sat_marking_code_gs1", "hub_marking_code", "marking_code_hk", ("1c__global",),
              "gs1_gtin string, serial_number string, marking_status string"),
    Satellite("sat_marking_code_gs1", "hub_marking_code", "marking_code_hk", ("ref__global",),
              "gs1_gtin string, marking_status string"),
    Satellite("sat_marking_code_wms", "hub_marking_code", "marking_code_hk", ("wms__global",),
              "last_scan_at timestamp, last_scan_location string, scan_status string"),
    Satellite("sat_product_reference", "hub_product", "product_hk", ("ref__global",),
              "product_name string, brand string, category string, tnved_code string, gpc_brick_code string, "
              "gross_weight_g bigint, net_weight_g bigint, length_mm bigint, width_mm bigint, height_mm bigint, "
              "units_per_pack int, pack_type string"),
    Satellite("sat_lnk_order_product", "lnk_order_product", "link_hk", ("1c__msk",),
              "qty decimal(18,3), unit_price decimal(18,2), discount_pct decimal(5,2), line_total decimal(18,2)"),
    Satellite("sat_lnk_product_supplier", "lnk_product_supplier", "link_hk", ("1c__global",),
              "valid_from timestamp, valid_to timestamp, supplier_priority int, purchase_price decimal(18,2)"),
    Satellite("sat_lnk_product_supplier", "lnk_product_supplier", "link_hk", ("ref__global",),
              "valid_from timestamp, valid_to timestamp, supplier_priority int, purchase_price decimal(18,2), "
              "min_order_qty bigint, lead_time_days int"),
)


def satellite_tables() -> dict[str, T.StructType]:
    """Name -> schema of every satellite table."""
    return {name: schema for s in SATELLITES for name, schema in s.tables().items()}


def load_month(ts: str = "load_ts"):
    """Partition value of satellite files: year and month of the load."""
    return F.date_format(ts, "yyyyMM")


def unclassified(spark, granted: Sequence[str], denied: Sequence[str]) -> DataFrame:
    """Fail-closed check: satellites that are neither granted nor denied, or both."""
    names = spark.createDataFrame([(n,) for n in satellite_tables()], "table_name string")
    marks = spark.createDataFrame([(n, 1) for n in granted] + [(n, 2) for n in denied], "table_name string, mark int")
    marks = marks.groupBy("table_name").agg(F.sum("mark").alias("mark"))
    return names.join(marks, "table_name", "left").filter(~F.coalesce(F.col("mark"), F.lit(0)).isin(1, 2)).select("table_name")


def merge_satellites(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of per-source satellites of one family, labelled with their record source."""
    out = None
    for record_source, part in parts.items():
        labelled = part.withColumn("record_source", F.lit(record_source))
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    return out


def consecutive_versions(df: DataFrame, key: str) -> DataFrame:
    """Version number and validity interval of every satellite row of a key of bounded history."""
    order = Window.partitionBy(key).orderBy("load_ts", "hash_diff")
    return df.withColumn("version_no", F.row_number().over(order)).withColumn("valid_to", F.lead("load_ts").over(order))
