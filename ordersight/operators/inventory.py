"""Inventory health: days below safety stock per product x warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators.facts import as_date, in_range
from ordersight.sources.marts import Marts


def below_safety_days(m: Marts, start, end, warehouse_id: int | None = None,
                      product_id: int | None = None) -> DataFrame:
    """Inventory snapshot rows in range with on hand strictly below the
    product's safety stock (P10).  Only (product_id, safety_stock) of the
    product dimension is joined here; attributes are added after the
    aggregate, so the wide dimension never meets the raw snapshot rows."""
    inv = in_range(m, "inventory", "inventory_date", start, end)
    if warehouse_id is not None:
        inv = inv.filter(F.col("warehouse_id") == F.lit(warehouse_id))
    if product_id is not None:
        inv = inv.filter(F.col("product_id") == F.lit(product_id))
    ss = m.products.select("product_id", "safety_stock")
    return inv.join(ss, "product_id").filter(F.col("quantity_on_hand") < F.col("safety_stock"))


def below_safety_groups(m: Marts, start, end, warehouse_id: int | None = None,
                        product_id: int | None = None) -> DataFrame:
    """A3 in no order."""
    b = below_safety_days(m, start, end, warehouse_id, product_id)
    g = b.groupBy("product_id", "warehouse_id", "safety_stock").agg(
        F.count(F.lit(1)).alias("days_below_safety_stock"),
        F.min("quantity_on_hand").alias("lowest_quantity_on_hand"))
    p = m.products.select("product_id", "sku", "product_name", "category")
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    return g.join(p, "product_id").join(w, "warehouse_id").select(
        "product_id", "sku", "product_name", "category", "warehouse_id", "warehouse_name",
        "days_below_safety_stock", "lowest_quantity_on_hand",
        F.col("safety_stock").alias("safety_stock_target"))


def inventory_below_safety(m: Marts, start, end, warehouse_id: int | None = None,
                           product_id: int | None = None) -> DataFrame:
    """A3: per (product, warehouse) days below safety stock and lowest on hand, most days first (T-2)."""
    return below_safety_groups(m, start, end, warehouse_id, product_id).orderBy(
        F.col("days_below_safety_stock").desc(), "product_id", "warehouse_id")


def distinct_ids(df: DataFrame, id_col: str, keys: list[str], more: list | None = None) -> DataFrame:
    """``keys``, the exact number ``n`` of distinct non-negative ids and the aggregates ``more``, by bitmaps.

    An id is a bit of the bitmap of its bucket of 32,768 ids.  Bitmaps are built per (keys, bucket) in the scan
    tasks, where repeated ids cost nothing, merged, and counted: what is shuffled is one bitmap of 4 KB per bucket
    and task at most, in place of a row per distinct id, and no row is expanded."""
    i = F.col(id_col)
    g = df.groupBy(*keys, F.bitmap_bucket_number(i).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("_bits"), *[part for _, part, _ in more or []])
    return g.groupBy(*keys).agg(F.sum(F.bitmap_count("_bits")).cast("bigint").alias("n"),
                                *[whole.alias(name) for name, _, whole in more or []])


def health_of(a3: DataFrame, start, end, warehouse_id: int | None = None, product_id: int | None = None) -> DataFrame:
    """A4 of A3 rows."""
    parts = [("number_of_days_below_safety_stock", F.sum("days_below_safety_stock").alias("_days"),
              F.coalesce(F.sum("_days"), F.lit(0).cast("bigint"))),
             ("lowest_quantity_on_hand", F.min("lowest_quantity_on_hand").alias("_low"), F.min("_low"))]
    s = distinct_ids(a3, "product_id", [], parts).select(
        F.coalesce("n", F.lit(0).cast("bigint")).alias("products_below_safety_stock"), *[name for name, _, _ in parts])
    return s.select(F.lit(as_date(start)).alias("start_date"), F.lit(as_date(end)).alias("end_date"),
                    F.lit(warehouse_id).cast("bigint").alias("warehouse_id"),
                    F.lit(product_id).cast("bigint").alias("product_id"), "*")


def inventory_health(m: Marts, start, end, warehouse_id: int | None = None,
                     product_id: int | None = None) -> DataFrame:
    """A4: summary row; distinct products != detail rows, days are summed
    across warehouses, lowest on hand is NULL when nothing is below."""
    return health_of(below_safety_groups(m, start, end, warehouse_id, product_id), start, end, warehouse_id, product_id)


def evidence_inventory(m: Marts, start, end, n: int = 12) -> DataFrame:
    """T-6: the first n affected products in detail order (days desc,
    product, warehouse) -- a top-n report, planned as TakeOrderedAndProject."""
    return first_affected(below_safety_groups(m, start, end), n)


def first_affected(a3: DataFrame, n: int = 12) -> DataFrame:
    return a3.orderBy(F.col("days_below_safety_stock").desc(), "product_id", "warehouse_id").limit(n).select(
        "product_id", "warehouse_id", "sku", "product_name", "warehouse_name", "days_below_safety_stock",
        "lowest_quantity_on_hand", "safety_stock_target")


def warehouse_below_safety_span(m: Marts, start, end) -> DataFrame:
    """Per warehouse (id kept in the key): distinct products below,
    product-days below, first and last date below."""
    parts = [("below_safety_product_days", F.count(F.lit(1)).alias("_rows"), F.sum("_rows")),
             ("first_date", F.min("inventory_date").alias("_first"), F.min("_first")),
             ("last_date", F.max("inventory_date").alias("_last"), F.max("_last"))]
    g = distinct_ids(below_safety_days(m, start, end), "product_id", ["warehouse_id"], parts)
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    return g.join(w, "warehouse_id").select("warehouse_id", "warehouse_name", F.col("n").alias("products_below_safety"),
                                            "below_safety_product_days", "first_date", "last_date")
