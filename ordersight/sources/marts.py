"""Typed star-schema marts over the raw Parquet tables.

The nine operational tables (customers, products, warehouses, vendors,
orders, order_lines, inventory, purchase_orders, shipments) are derived from
the TPC-H-shaped inputs by deterministic column arithmetic.  Each mart is a
lazy projection of one scan (inventory is one partial+final aggregate), so a
query that uses a mart still gets column pruning and Parquet filter pushdown.

Money is kept as BIGINT cents so sums do not depend on partition order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.sources.tables import Tables

# Fixed values of the mapping (must match the oracle SQL text).
WAREHOUSE_MODULUS = 23       # orders use warehouses 1..23; 24 and 25 stay idle
PO_WAREHOUSE_MODULUS = 25    # purchase orders / inventory spread over 25 sites
CARRIERS = ("Parcel Express", "Freightline", "Regional Haul", "Coastal Cargo")


def _date(c: Column) -> Column:
    return c.cast("date")


def _plus_days(d: Column, n: Column) -> Column:
    return F.date_add(d, n.cast("int"))


def po_key() -> Column:
    """Synthetic purchase-order / order-line id from a lineitem row."""
    return (F.col("l_orderkey") * F.lit(1_000_000_000) + F.col("l_partkey") * F.lit(10_000)
            + F.col("l_suppkey") * F.lit(10) + F.col("l_linenumber").cast("bigint"))


class Marts:
    """Lazily-built mart DataFrames over one test-data directory."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self.t = Tables(spark, root)

    # ---- dimensions -------------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        # nation (25 rows) and region (5 rows) are fixed-size: safe to broadcast.
        c, n, r = self.t.customer, self.t.nation, self.t.region
        geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", "r_name")
        return (c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey)
                .select((F.col("c_custkey") + 1).alias("customer_id"),
                        F.col("c_name").alias("customer_name"),
                        F.col("c_mktsegment").alias("customer_segment"),
                        F.col("r_name").alias("region"),
                        (F.lit(0.90) + (F.col("c_custkey") % 8).cast("double") / 100.0).alias("service_level_target")))

    @cached_property
    def products(self) -> DataFrame:
        p = self.t.part
        pid = F.col("p_partkey") + 1
        return p.select(
            pid.alias("product_id"),
            F.concat(F.lit("SKU-"), F.lpad(pid.cast("string"), 7, "0")).alias("sku"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("category"),
            F.round(F.col("p_retailprice") * 60).cast("bigint").alias("unit_cost_cents"),
            F.round(F.col("p_retailprice") * 100).cast("bigint").alias("unit_price_cents"),
            (F.lit(15) + (F.col("p_size") % 20).cast("int")).alias("safety_stock"))

    @cached_property
    def warehouses(self) -> DataFrame:
        n, r = self.t.nation, self.t.region
        return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                .select((F.col("n_nationkey") + 1).cast("bigint").alias("warehouse_id"),
                        F.col("n_name").alias("warehouse_name"),
                        F.col("r_name").alias("state"),
                        F.concat(F.lit("City of "), F.col("n_name")).alias("city")))

    @cached_property
    def vendors(self) -> DataFrame:
        s = self.t.supplier
        return s.select((F.col("s_suppkey") + 1).alias("vendor_id"),
                        F.col("s_name").alias("vendor_name"),
                        (F.lit(3) + (F.col("s_suppkey") % 12).cast("int")).alias("average_lead_time_days"),
                        (F.lit(0.90) + (F.col("s_suppkey") % 8).cast("double") / 100.0).alias("target_ontime_percentage"))

    # ---- facts ------------------------------------------------------------
    @cached_property
    def orders(self) -> DataFrame:
        o = self.t.orders
        k = F.col("o_orderkey")
        od = _date(F.col("o_orderdate"))
        req_ship = _plus_days(od, 1 + k % 2)
        req_deliv = _plus_days(od, 4 + k % 3)
        partial = F.col("o_orderstatus") == "P"
        act_ship = F.when(partial & (k % 11 == 0), F.lit(None).cast("date")).otherwise(
            _plus_days(req_ship, F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(2))
                       .otherwise(-(k % 3).cast("int") + 1)))
        act_deliv = F.when(partial & (k % 7 == 0), F.lit(None).cast("date")).otherwise(
            _plus_days(req_deliv, F.when(F.col("o_orderpriority") == "5-LOW", F.lit(3))
                       .otherwise(-(k % 2).cast("int"))))
        status = F.when(partial, F.lit("partially_fulfilled")).otherwise(F.lit("delivered"))
        return o.select((k + 1).alias("order_id"),
                        (F.col("o_custkey") + 1).alias("customer_id"),
                        ((k % WAREHOUSE_MODULUS).cast("int") + 1).cast("bigint").alias("warehouse_id"),
                        od.alias("order_date"),
                        req_ship.alias("requested_ship_date"),
                        act_ship.alias("actual_ship_date"),
                        req_deliv.alias("requested_delivery_date"),
                        act_deliv.alias("actual_delivery_date"),
                        status.alias("order_status"))

    @cached_property
    def order_lines(self) -> DataFrame:
        l = self.t.lineitem
        qty = F.col("l_quantity").cast("int")
        shipped = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") <= 2),
                         F.floor(F.col("l_quantity") * 0.45).cast("int")).otherwise(qty)
        return l.select(po_key().alias("order_line_id"),
                        (F.col("l_orderkey") + 1).alias("order_id"),
                        (F.col("l_partkey") + 1).alias("product_id"),
                        qty.alias("quantity_ordered"),
                        shipped.alias("quantity_shipped"),
                        F.floor(F.round(F.col("l_extendedprice") * 100) / F.col("l_quantity")).cast("bigint")
                        .alias("unit_price_cents"))

    @cached_property
    def purchase_orders(self) -> DataFrame:
        l = self.t.lineitem
        exp = _date(F.col("l_shipdate"))
        act = F.when((F.col("l_linestatus") == "O") & (F.col("l_linenumber") == 7), F.lit(None).cast("date")).otherwise(
            _plus_days(exp, F.when(F.col("l_returnflag") == "A", (F.col("l_partkey") % 14).cast("int"))
                       .otherwise(-(F.col("l_partkey") % 3).cast("int"))))
        qty = F.col("l_quantity").cast("int")
        received = (F.when(act.isNull(), F.lit(0))
                    .when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") * 0.8).cast("int"))
                    .otherwise(qty))
        return l.select(po_key().alias("po_id"),
                        (F.col("l_suppkey") + 1).alias("vendor_id"),
                        (F.col("l_partkey") + 1).alias("product_id"),
                        ((F.col("l_suppkey") % PO_WAREHOUSE_MODULUS).cast("int") + 1).cast("bigint").alias("warehouse_id"),
                        F.date_sub(exp, 21).alias("order_date"),
                        exp.alias("expected_delivery_date"),
                        act.alias("actual_delivery_date"),
                        qty.alias("quantity_ordered"),
                        received.alias("quantity_received"))

    @cached_property
    def inventory(self) -> DataFrame:
        # Snapshot per (site, product, day): partial aggregation runs map-side,
        # so a hot product does not concentrate raw rows in one task.
        l = self.t.lineitem
        return (l.select(((F.col("l_suppkey") % PO_WAREHOUSE_MODULUS).cast("int") + 1).cast("bigint").alias("warehouse_id"),
                         (F.col("l_partkey") + 1).alias("product_id"),
                         _date(F.col("l_shipdate")).alias("inventory_date"),
                         F.col("l_quantity").cast("int").alias("q_on_hand"),
                         F.floor(F.col("l_quantity") * F.col("l_tax") * 4).cast("int").alias("q_alloc"))
                .groupBy("warehouse_id", "product_id", "inventory_date")
                .agg(F.min("q_on_hand").alias("quantity_on_hand"),
                     F.min("q_alloc").alias("quantity_allocated"))
                .withColumn("inventory_id", (F.col("product_id") * 100 + F.col("warehouse_id")) * 100_000
                            + F.datediff("inventory_date", F.lit("1970-01-01").cast("date"))))

    @cached_property
    def shipments(self) -> DataFrame:
        o = self.orders
        carrier = F.element_at(F.array(*[F.lit(c) for c in CARRIERS]), ((F.col("order_id") % 4) + 1).cast("int"))
        status = F.when(F.col("actual_delivery_date").isNotNull(), F.lit("delivered")).otherwise(
            F.lit("partially_delivered"))
        return o.select(F.col("order_id").alias("shipment_id"), "order_id",
                        carrier.alias("carrier"),
                        F.col("actual_ship_date").alias("ship_date"),
                        F.col("actual_delivery_date").alias("delivery_date"),
                        (F.lit(500) + (F.col("order_id") % 40) * 25).cast("bigint").alias("shipping_cost_cents"),
                        status.alias("shipment_status"))

    MART_NAMES = ("customers", "products", "warehouses", "vendors", "orders", "order_lines",
                  "inventory", "purchase_orders", "shipments")

    def mart(self, name: str) -> DataFrame:
        if name not in self.MART_NAMES:
            raise KeyError(name)
        return getattr(self, name)
