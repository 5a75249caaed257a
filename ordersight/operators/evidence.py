"""C4: the evidence bundle of one investigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.metrics import cents_to_amount, pct
from ordersight.functions.scan import ordered_scan
from ordersight.functions.shape import public_shape
from ordersight.operators import inventory, service, vendors
from ordersight.operators.facts import as_date
from ordersight.sources.marts import Marts
from ordersight.sources.scratch import written


def _part(name: str, df: DataFrame, order: list[Column], fields: list[str]) -> DataFrame:
    """(part, k0, k1, k2, item): items as JSON with up to three integers that order them."""
    keys = [c.cast("bigint") for c in order] + [F.lit(0).cast("bigint")] * (3 - len(order))
    p = public_shape(df.select(*fields))
    item = F.to_json(F.struct(*[F.col(f"i.{a}").alias(b) for a, b in zip(fields, p.columns)]), {"ignoreNullFields": "false"})
    return df.select(*[k.alias(f"k{n}") for n, k in enumerate(keys)], F.struct(*fields).alias("i")).select(
        F.lit(name).alias("part"), "k0", "k1", "k2", item.alias("item"))


def evidence_bundle(m: Marts, start, end) -> DataFrame:
    """(part, position, item JSON): the observations an investigation of [start, end] shows, in one table: OTIF,
    every warehouse, the inventory summary with its first 12 products, every vendor with late deliveries and the
    first 20 late POs of each, the five most affected customers.

    Orders, snapshots and POs are each passed once: the order facts by GROUPING SETS, the snapshots into
    (product, site) groups, the POs into one ranked table.  Positions come from one ordered scan of all parts."""
    col = F.col
    groups = service.service_groups(m, start, end)
    of = lambda kind: groups.filter(col("kind") == kind)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    n = zero(col("orders"))
    otif = of("all").select(
        F.lit(as_date(start)).alias("start_date"), F.lit(as_date(end)).alias("end_date"), n.alias("total_orders"),
        zero(col("otif")).alias("otif_orders"), pct(col("on_time"), n).alias("on_time_percentage"),
        pct(col("in_full"), n).alias("in_full_percentage"), pct(col("otif"), n).alias("otif_percentage"))
    sites = of("site").select("warehouse_id", col("name").alias("warehouse_name"), n.alias("total_orders"),
                              pct(col("otif"), n).alias("otif_percentage"), col("late").alias("late_order_count"),
                              col("has_short").alias("partial_shipment_count"))
    names = m.customers.select("customer_id", "customer_name")
    customers = of("customer").join(names, "customer_id").select(
        "customer_id", "customer_name", n.alias("total_orders"), pct(col("otif_lenient"), n).alias("otif_percentage"),
        col("late").alias("late_orders"), col("has_short").alias("partial_orders"), zero(col("cents")).alias("cents"),
        cents_to_amount(zero(col("cents"))).alias("estimated_affected_revenue")) \
        .orderBy(col("cents").desc(), "customer_id").limit(5)
    below = written(inventory.below_safety_groups(m, start, end), "below-safety")
    ranked = vendors.ranked_pos(m, start, end)
    late = vendors.performance_of(m, ranked).filter("late_deliveries > 0")
    pos = ranked.filter("listed AND position <= 20").join(m.vendors.select("vendor_id", "vendor_name"), "vendor_id")
    parts = reduce(DataFrame.unionByName, [
        _part("otif", otif, [], ["start_date", "end_date", "total_orders", "otif_orders", "on_time_percentage",
                                 "in_full_percentage", "otif_percentage"]),
        _part("warehouses", sites, [col("warehouse_id")], [
            "warehouse_id", "warehouse_name", "total_orders", "otif_percentage", "late_order_count",
            "partial_shipment_count"]),
        _part("inventory", inventory.health_of(below, start, end), [], [
            "start_date", "end_date", "products_below_safety_stock", "number_of_days_below_safety_stock"]),
        _part("affectedProducts", inventory.first_affected(below), [
            -col("days_below_safety_stock"), col("product_id"), col("warehouse_id")], [
            "sku", "product_name", "warehouse_name", "days_below_safety_stock", "lowest_quantity_on_hand",
            "safety_stock_target"]),
        _part("vendors", late, [col("vendor_id")], [
            "vendor_name", "purchase_orders", "late_deliveries", "on_time_percentage", "average_days_late"]),
        _part("latePurchaseOrders", pos, [col("vendor_id"), col("position")], [
            "vendor_name", "purchase_order_id", "warehouse_name", "product_name", "expected_delivery_date",
            "actual_delivery_date", "days_late", "quantity_ordered", "quantity_received"]),
        _part("customers", customers, [-col("cents"), col("customer_id")], [
            "customer_name", "total_orders", "otif_percentage", "late_orders", "partial_orders",
            "estimated_affected_revenue"]),
    ])
    return ordered_scan(parts, ["part"], ["k0", "k1", "k2"], "position").select(
        "part", F.col("position").cast("int").alias("position"), "item")
