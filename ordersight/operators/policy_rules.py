"""Policy thresholds as rule operators (the written procedures as columns).

Policy definitions differ from the governed SQL on purpose: on time is by
delivery only and "available" stock is on hand minus allocated.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.metrics import pct_tenths
from ordersight.functions.scan import ordered_scan
from ordersight.operators import stock
from ordersight.operators.facts import filtered_orders, in_range, line_facts, po_facts
from ordersight.sources.marts import Marts

# Fixed policy thresholds.
OTIF_TARGET_TENTHS = 950          # company-wide 95 % OTIF baseline
OTIF_REVIEW_TENTHS = 900
OTIF_CORRECTIVE_TENTHS = 800
REPEAT_FAILURE_LATE_POS = 3
REPEAT_FAILURE_WINDOW_DAYS = 90
SHORTAGE_RUN_BUSINESS_DAYS = 3    # "more than 3 consecutive business days"
CRITICAL_FRACTION_DENOM = 2       # below 50 % of safety stock


def otif_tier(tenths: Column) -> Column:
    """Response tier for an OTIF percentage in integer tenths."""
    return (F.when(tenths >= OTIF_TARGET_TENTHS, F.lit("routine monitoring"))
            .when(tenths >= OTIF_REVIEW_TENTHS, F.lit("operations review"))
            .when(tenths >= OTIF_CORRECTIVE_TENTHS, F.lit("escalate to operations manager"))
            .otherwise(F.lit("formal corrective action")))


def escalation_tier(days_late: Column) -> Column:
    """Vendor escalation level by calendar days late."""
    return (F.when(days_late <= 0, F.lit("not late"))
            .when(days_late <= 2, F.lit("monitor and contact vendor"))
            .when(days_late <= 5, F.lit("formal purchasing escalation"))
            .when(days_late <= 10, F.lit("supply chain leadership escalation"))
            .otherwise(F.lit("critical supplier incident")))


def policy_order_facts(m: Marts, start=None, end=None) -> DataFrame:
    """Orders with the policy OTIF flag: delivered on or before the requested
    delivery date and no short line (zero-line orders count as in full)."""
    o = filtered_orders(m, start, end)
    lf = line_facts(m, start, end)
    d = o.join(lf, "order_id", "left")
    on_time = F.col("actual_delivery_date").isNotNull() & (F.col("actual_delivery_date") <= F.col("requested_delivery_date"))
    in_full = F.coalesce(F.col("short_lines"), F.lit(0)) == 0
    return d.select("order_id", "customer_id", "warehouse_id", "order_date", (on_time & in_full).alias("policy_otif"))


def otif_policy_tier(m: Marts) -> DataFrame:
    """Policy OTIF and response tier per warehouse and order month."""
    f = policy_order_facts(m)
    g = f.groupBy("warehouse_id", F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("policy_otif").alias("otif_orders"))
    t = pct_tenths(F.col("otif_orders"), F.col("orders"))
    return g.select("warehouse_id", "month", "orders", "otif_orders", (t.cast("double") / 10.0).alias("otif_percentage"),
                    otif_tier(t).alias("tier"))


def customer_target_gap(m: Marts, start, end) -> DataFrame:
    """R2: policy OTIF per customer against the stricter of 95 % and the
    customer's own service-level target (meets_target is exact, not rounded)."""
    f = policy_order_facts(m, start, end)
    g = f.groupBy("customer_id").agg(F.count(F.lit(1)).alias("orders"), F.count_if("policy_otif").alias("otif_orders"))
    c = m.customers.select("customer_id", "service_level_target")
    j = g.join(c, "customer_id")
    target_t = F.greatest(F.lit(OTIF_TARGET_TENTHS).cast("bigint"),
                          F.round(F.col("service_level_target") * 1000).cast("bigint"))
    otif_t = pct_tenths(F.col("otif_orders"), F.col("orders"))
    return j.select("customer_id", "orders", "otif_orders", (otif_t.cast("double") / 10.0).alias("otif_percentage"),
                    (target_t.cast("double") / 10.0).alias("target_percentage"),
                    ((otif_t - target_t).cast("double") / 10.0).alias("gap_points"),
                    (F.col("otif_orders") * 1000 >= target_t * F.col("orders")).alias("meets_target"))


def po_escalation_tier(m: Marts, start, end) -> DataFrame:
    """Escalation tier of every late PO expected in range (as of end)."""
    po = po_facts(m, start, end).filter("late")
    return po.select(F.col("po_id").alias("purchase_order_id"), "vendor_id", "product_id", "days_late",
                     escalation_tier(F.col("days_late")).alias("tier"))


def _delivered_late(m: Marts) -> DataFrame:
    po = m.purchase_orders
    return po.filter(F.col("actual_delivery_date") > F.col("expected_delivery_date"))


def vendor_repeat_failure(m: Marts) -> DataFrame:
    """Late POs in the rolling 90 days ending on each day with a late PO.

    Late POs are first counted per (vendor, expected day) -- a partial+final
    aggregate -- so the rolling window runs over at most one row per vendor
    per calendar day, however many POs a vendor has."""
    daily = _delivered_late(m).groupBy("vendor_id", F.col("expected_delivery_date").alias("day")).agg(
        F.count(F.lit(1)).alias("late_pos_day"))
    daynum = F.datediff(F.col("day"), F.lit(dt.date(1970, 1, 1)))
    w = Window.partitionBy("vendor_id").orderBy(daynum).rangeBetween(-(REPEAT_FAILURE_WINDOW_DAYS - 1), 0)
    r = daily.withColumn("late_pos_90d", F.sum("late_pos_day").over(w))
    return r.select("vendor_id", "day", "late_pos_day", "late_pos_90d",
                    (F.col("late_pos_90d") >= REPEAT_FAILURE_LATE_POS).alias("repeat_failure"))


def consecutive_late(m: Marts, critical_products: list[int] | None = None) -> DataFrame:
    """Two consecutive late deliveries for a vendor x product, in
    (expected date, po id) order.  The predecessor comes from an ordered scan,
    so a pair that holds a third of all POs is spread over many tasks."""
    po = m.purchase_orders
    if critical_products:
        po = po.filter(F.col("product_id").isin(*critical_products))
    po = po.select("po_id", "vendor_id", "product_id", "expected_delivery_date",
                   (F.col("actual_delivery_date") > F.col("expected_delivery_date")).alias("late"))
    p = ordered_scan(po, ["vendor_id", "product_id"], ["expected_delivery_date", "po_id"], lag=["po_id", "late"])
    return p.filter(F.col("late") & F.col("previous_late")).select(
        "vendor_id", "product_id", "po_id", F.col("previous_po_id"), "expected_delivery_date")


def inventory_alert_tier(m: Marts, start, end) -> DataFrame:
    """Snapshot rows whose available stock (on hand - allocated) is below
    safety stock; below half of it is critical."""
    inv = in_range(m, "inventory", "inventory_date", start, end)
    j = inv.join(m.products.select("product_id", "safety_stock"), "product_id")
    avail = F.col("quantity_on_hand") - F.col("quantity_allocated")
    j = j.withColumn("available", avail).filter(F.col("available") < F.col("safety_stock"))
    tier = F.when(F.col("available") * CRITICAL_FRACTION_DENOM < F.col("safety_stock"), F.lit("critical")).otherwise(
        F.lit("below safety stock"))
    return j.select("warehouse_id", "product_id", "inventory_date", "quantity_on_hand", "quantity_allocated",
                    "available", F.col("safety_stock").alias("safety_stock_target"), tier.alias("tier"))


def shortage_runs(m: Marts, start, end, state: DataFrame | None = None, holidays: list[str] | None = None,
                  min_days: int = SHORTAGE_RUN_BUSINESS_DAYS + 1) -> DataFrame:
    """Runs of more than 3 consecutive business days (weekends and ``holidays`` are none) with available stock
    below safety stock that touch [start, end].

    A run counts from its first day below, however long before ``start``.  ``state`` is the stock state at
    ``start`` (``StoredMarts.stock_state``, made with the same holidays); without it the history is read."""
    return stock.shortage_runs(m, start, end, min_days, state, holidays)


def shortage_exceptions(runs: DataFrame, m: Marts) -> DataFrame:
    """Exception record per shortage run: first date below, lowest
    available, safety target and the SKU's open purchase orders (counted per
    product first, then joined)."""
    open_pos = m.purchase_orders.filter(F.col("actual_delivery_date").isNull()).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("open_po_count"))
    j = runs.join(open_pos, "product_id", "left")
    return j.select("warehouse_id", "product_id", F.col("run_start").alias("first_date_below"), "business_days",
                    "lowest_available", "safety_stock_target",
                    F.coalesce(F.col("open_po_count"), F.lit(0).cast("bigint")).alias("open_po_count"))


def vendor_target_gap(vp: DataFrame, m: Marts) -> DataFrame:
    """Vendor on-time % against its own target (vendors with POs)."""
    t = m.vendors.select("vendor_id", "target_ontime_percentage")
    j = vp.filter(F.col("purchase_orders") > 0).join(t, "vendor_id")
    target_t = F.round(F.col("target_ontime_percentage") * 1000).cast("bigint")
    on_t = pct_tenths(F.col("on_time_deliveries"), F.col("purchase_orders"))
    return j.select("vendor_id", "vendor_name", "purchase_orders", "on_time_deliveries", "on_time_percentage",
                    (target_t.cast("double") / 10.0).alias("target_percentage"),
                    ((on_t - target_t).cast("double") / 10.0).alias("gap_points"),
                    (F.col("on_time_deliveries") * 1000 >= target_t * F.col("purchase_orders")).alias("meets_target"))

