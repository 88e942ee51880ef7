"""Reference data as raw-vault rows: hubs, links and satellites of suppliers, products and their sourcing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import hash_diff, hash_key

# Fixed: the attributes of each satellite.
SUPPLIER_ATTRIBUTES = ("supplier_name", "tax_country_code", "supplier_status", "gln")
PRODUCT_ATTRIBUTES = ("product_name", "brand", "category", "tnved_code", "gpc_brick_code", "gross_weight_g", "net_weight_g", "length_mm", "width_mm", "height_mm",
                      "units_per_pack", "pack_type")
MARKING_ATTRIBUTES = ("gs1_gtin", "marking_status")
SOURCING_ATTRIBUTES = ("valid_from", "valid_to", "supplier_priority", "purchase_price", "min_order_qty", "lead_time_days")


def with_missing(rows: DataFrame, attributes: tuple[str, ...]) -> DataFrame:
    """Attributes that a source does not have are NULL; a fingerprint still names them."""
    return rows.withColumns({a: F.lit(None).cast("string") for a in attributes if a not in rows.columns})


def map_reference(suppliers: DataFrame, products: DataFrame, marking: DataFrame, sourcing: DataFrame) -> dict[str, DataFrame]:
    """Rows of the nine raw-vault tables, each with its keys, and its attributes and `hash_diff` if it is a satellite.

    suppliers: supplier_bk and attributes; products: product_bk and attributes; marking: product_bk, gs1_gtin, marking_status;
    sourcing: product_bk, supplier_bk and attributes. Every table is one projection of its source: no join, no shuffle.
    """
    s = with_missing(suppliers, SUPPLIER_ATTRIBUTES).withColumn("supplier_hk", hash_key(F.col("supplier_bk")))
    p = with_missing(products, PRODUCT_ATTRIBUTES).withColumn("product_hk", hash_key(F.col("product_bk")))
    m = with_missing(marking, MARKING_ATTRIBUTES).withColumns({"marking_code_hk": hash_key(F.col("gs1_gtin")), "product_hk": hash_key(F.col("product_bk"))})
    o = with_missing(sourcing, SOURCING_ATTRIBUTES).withColumns({"product_hk": hash_key(F.col("product_bk")), "supplier_hk": hash_key(F.col("supplier_bk"))})
    o = o.withColumn("link_hk", hash_key(F.col("product_hk"), F.col("supplier_hk")))

    def satellite(rows: DataFrame, key: str, attributes: tuple[str, ...]) -> DataFrame:
        return rows.select(key, *attributes, hash_diff(rows, list(attributes)).alias("hash_diff"))

    return {
        "hub_supplier": s.select("supplier_hk", "supplier_bk"), "hub_product": p.select("product_hk", "product_bk"),
        "hub_marking_code": m.select("marking_code_hk", F.col("gs1_gtin").alias("marking_code_bk")),
        "lnk_product_supplier": o.select("link_hk", "product_hk", "supplier_hk"),
        "lnk_product_marking": m.select(hash_key(F.col("product_hk"), F.col("marking_code_hk")).alias("link_hk"), "product_hk", "marking_code_hk"),
        "sat_supplier_profile": satellite(s, "supplier_hk", SUPPLIER_ATTRIBUTES), "sat_product_reference": satellite(p, "product_hk", PRODUCT_ATTRIBUTES),
        "sat_marking_code_gs1": satellite(m, "marking_code_hk", MARKING_ATTRIBUTES), "sat_sourcing": satellite(o, "link_hk", SOURCING_ATTRIBUTES)}
