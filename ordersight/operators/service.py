"""Customer-service analytics over ``order_facts``: OTIF, warehouse and
customer performance, monthly trends and period-over-period comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.metrics import cents_to_amount, pct, pct_tenths
from ordersight.functions.shape import result_json
from ordersight.operators.facts import as_date, filtered_orders, order_facts
from ordersight.sources.marts import Marts
from ordersight.sources.scratch import written


def otif_metrics(m: Marts, start, end, warehouse_id: int | None = None,
                 customer_id: int | None = None) -> DataFrame:
    """A1: one row of OTIF counts and percentages; an empty range gives zeros.

    A global aggregate always returns exactly one row; its partial aggregate
    runs in every scan task, so only one row per task is shuffled.
    """
    f = order_facts(m, start, end, warehouse_id, customer_id)
    agg = f.agg(F.count(F.lit(1)).alias("total_orders"),
                F.count_if("on_time").alias("on_time_orders"),
                F.count_if("in_full").alias("in_full_orders"),
                F.count_if("otif").alias("otif_orders"))
    t = F.col("total_orders")
    return agg.select(
        F.lit(as_date(start)).alias("start_date"), F.lit(as_date(end)).alias("end_date"),
        F.lit(warehouse_id).cast("bigint").alias("warehouse_id"),
        F.lit(customer_id).cast("bigint").alias("customer_id"),
        "total_orders", "on_time_orders", "in_full_orders", "otif_orders",
        pct(F.col("on_time_orders"), t).alias("on_time_percentage"),
        pct(F.col("in_full_orders"), t).alias("in_full_percentage"),
        pct(F.col("otif_orders"), t).alias("otif_percentage"))


def _warehouse_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if("otif").alias("otif_orders"),
        F.count_if("late").alias("late_order_count"),
        F.count_if("has_short").alias("partial_shipment_count"))


def warehouse_performance(m: Marts, start, end) -> DataFrame:
    """A2: every warehouse (idle ones with zeros), strict OTIF %.

    Facts are aggregated per warehouse first; whether the warehouse dimension
    is broadcast is left to Spark, which knows its size.  Ordered by id (T-1).
    """
    counts = _warehouse_counts(order_facts(m, start, end))
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    j = w.join(counts, "warehouse_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return j.select("warehouse_id", "warehouse_name",
                    z("total_orders").alias("total_orders"),
                    pct(z("otif_orders"), z("total_orders")).alias("otif_percentage"),
                    z("late_order_count").alias("late_order_count"),
                    z("partial_shipment_count").alias("partial_shipment_count")).orderBy("warehouse_id")


def service_groups(m: Marts, start, end) -> DataFrame:
    """Order counts in all, by site and by customer from ONE pass over the order facts (GROUPING SETS), with
    ``kind`` "all", "site" or "customer".  Every warehouse adds a row that counts no order, so idle ones are groups
    too, and have their names.  Written, so that all that is read from it shares the pass."""
    site, customer = "warehouse_id", "customer_id"
    flags = ["on_time", "in_full", "otif", "otif_lenient", "late", "has_short"]
    f = order_facts(m, start, end).select(
        site, customer, F.lit(1).alias("orders"), *[F.col(c).cast("int").alias(c) for c in flags],
        F.when(F.col("affected"), F.col("order_value_cents")).alias("cents"), F.lit(None).cast("string").alias("name"))
    sites = m.warehouses.select(site, F.lit(None).cast("bigint").alias(customer), F.lit(0).alias("orders"),
                                *[F.lit(0).alias(c) for c in flags], F.lit(None).cast("bigint").alias("cents"),
                                F.col("warehouse_name").alias("name"))
    g = f.unionByName(sites).groupingSets([[site], [customer], []], site, customer).agg(
        F.grouping_id().alias("level"), *[F.sum(c).cast("bigint").alias(c) for c in ["orders", *flags, "cents"]],
        F.max("name").alias("name"))
    kind = F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "site").otherwise("customer")
    # The sites' own rows have no customer, and orders of an unknown site have no name.
    kept = (F.col("kind") == "all") | F.col("name").isNotNull() & (F.col("kind") == "site") \
        | (F.col("kind") == "customer") & (F.col("orders") > 0)
    return written(g.withColumn("kind", kind).filter(kept).drop("level"), "service-groups")


def customer_impact(m: Marts, start, end, warehouse_id: int | None = None) -> DataFrame:
    """Per customer with orders in range (inner join), lenient OTIF.

    Revenue of an affected order is its whole value (all lines), in cents.
    Ordered by revenue, then id (T-4).
    """
    f = order_facts(m, start, end, warehouse_id)
    per_cust = f.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if("otif_lenient").alias("otif_orders"),
        F.count_if("late").alias("late_orders"),
        F.count_if("has_short").alias("partial_orders"),
        F.sum(F.when(F.col("affected"), F.col("order_value_cents"))).alias("affected_cents"))
    c = m.customers.select("customer_id", "customer_name", "customer_segment", "region")
    return per_cust.join(c, "customer_id").select(
        "customer_id", "customer_name", "customer_segment", "region", "total_orders",
        pct(F.col("otif_orders"), F.col("total_orders")).alias("otif_percentage"),
        "late_orders", "partial_orders",
        cents_to_amount(F.coalesce(F.col("affected_cents"), F.lit(0).cast("bigint"))).alias("estimated_affected_revenue")) \
        .orderBy(F.col("estimated_affected_revenue").desc(), "customer_id")


def monthly_otif(m: Marts) -> DataFrame:
    """Per order month over all orders; lenient in-full (zero-line passes)."""
    f = order_facts(m)
    g = f.groupBy(F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("otif_lenient").alias("otif_orders"))
    return g.select("month", "orders", "otif_orders", pct(F.col("otif_orders"), F.col("orders")).alias("otif_percentage"))


def warehouse_monthly_otif(m: Marts) -> DataFrame:
    """Per warehouse x order month (warehouse id kept in the key)."""
    f = order_facts(m)
    g = f.groupBy("warehouse_id", F.date_format("order_date", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("orders"), F.count_if("otif_lenient").alias("otif_orders"))
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    return g.join(w, "warehouse_id").select(
        "warehouse_id", "warehouse_name", "month", "orders",
        pct(F.col("otif_orders"), F.col("orders")).alias("otif_percentage"))


def orders_in_range(m: Marts, start, end) -> DataFrame:
    """The order mart restricted to an inclusive date range."""
    return filtered_orders(m, start, end)


def _short_line_orders(m: Marts, start, end) -> DataFrame:
    if hasattr(m, "line_facts_in"):
        return m.line_facts_in(start, end).filter("short_lines > 0").select("order_id")
    lines = m.order_lines
    return lines.filter(F.col("quantity_shipped") < F.col("quantity_ordered")).select("order_id")


def orders_with_short_lines(m: Marts, start, end) -> DataFrame:
    """EXISTS a short line, as a left-semi join."""
    o = filtered_orders(m, start, end).select("order_id", "customer_id", "warehouse_id", "order_date")
    return o.join(_short_line_orders(m, start, end), "order_id", "left_semi")


def orders_without_short_lines(m: Marts, start, end) -> DataFrame:
    """NOT EXISTS a short line (zero-line orders included), left-anti join."""
    o = filtered_orders(m, start, end).select("order_id", "customer_id", "warehouse_id", "order_date")
    return o.join(_short_line_orders(m, start, end), "order_id", "left_anti")


def _period_comparison(m: Marts, prev: tuple, cur: tuple) -> DataFrame:
    """Per-warehouse previous/current counts from ONE facts scan over the
    union range (conditional aggregation instead of two queries + self-join)."""
    lo = min(as_date(prev[0]), as_date(cur[0]))
    hi = max(as_date(prev[1]), as_date(cur[1]))
    in_prev = F.col("order_date").between(F.lit(as_date(prev[0])), F.lit(as_date(prev[1])))
    in_cur = F.col("order_date").between(F.lit(as_date(cur[0])), F.lit(as_date(cur[1])))
    f = order_facts(m, lo, hi).filter(in_prev | in_cur)      # reaches the orders scan
    g = f.groupBy("warehouse_id").agg(
        F.count_if(in_prev).alias("previous_orders"), F.count_if(in_cur).alias("current_orders"),
        F.count_if(in_prev & F.col("otif")).alias("previous_otif_orders"),
        F.count_if(in_cur & F.col("otif")).alias("current_otif_orders"),
        F.count_if(in_prev & F.col("late")).alias("previous_late_orders"),
        F.count_if(in_cur & F.col("late")).alias("current_late_orders"),
        F.count_if(in_prev & F.col("has_short")).alias("previous_partial_shipments"),
        F.count_if(in_cur & F.col("has_short")).alias("current_partial_shipments"))
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    j = w.join(g, "warehouse_id", "left")
    cols = [c for c in g.columns if c != "warehouse_id"]
    j = j.select("warehouse_id", "warehouse_name",
                 *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in cols])
    pt = pct_tenths(F.col("previous_otif_orders"), F.col("previous_orders"))
    ct = pct_tenths(F.col("current_otif_orders"), F.col("current_orders"))
    return j.select("*", (pt.cast("double") / 10.0).alias("previous_otif"),
                    (ct.cast("double") / 10.0).alias("current_otif"),
                    ((ct - pt).cast("double") / 10.0).alias("change_points"))


def warehouse_period_comparison(m: Marts, prev: tuple, cur: tuple) -> DataFrame:
    """Previous vs current period per warehouse; change_points is exact."""
    return _period_comparison(m, prev, cur).select(
        "warehouse_id", "warehouse_name", "previous_otif", "current_otif", "change_points",
        "previous_orders", "current_orders", "previous_late_orders", "current_late_orders",
        "previous_partial_shipments", "current_partial_shipments")


def largest_warehouse_decline(m: Marts, prev: tuple, cur: tuple) -> DataFrame:
    """Arg-min of change_points, lowest warehouse id wins ties."""
    c = warehouse_period_comparison(m, prev, cur)
    return c.orderBy(F.col("change_points").asc(), F.col("warehouse_id").asc()).limit(1)


def overview(m: Marts, prev: tuple, cur: tuple) -> DataFrame:
    """One-row KPI overview (current OTIF, change vs previous, late and
    partial totals, largest warehouse decline) from one facts scan."""
    comp = _period_comparison(m, prev, cur)
    tot = comp.agg(
        F.sum("previous_orders").alias("pn"), F.sum("previous_otif_orders").alias("po"),
        F.sum("current_orders").alias("cn"), F.sum("current_otif_orders").alias("co"),
        F.sum("current_late_orders").alias("late_orders"),
        F.sum("current_partial_shipments").alias("partial_shipments"),
        F.min_by(F.struct("warehouse_id", "warehouse_name", "change_points"),
                 F.struct("change_points", "warehouse_id")).alias("dec"))
    pt = pct_tenths(F.col("po"), F.col("pn"))
    ct = pct_tenths(F.col("co"), F.col("cn"))
    return tot.select(
        (ct.cast("double") / 10.0).alias("current_otif"),
        (pt.cast("double") / 10.0).alias("previous_otif"),
        ((ct - pt).cast("double") / 10.0).alias("month_over_month_change"),
        F.col("late_orders").cast("bigint").alias("late_orders"),
        F.col("partial_shipments").cast("bigint").alias("partial_shipments"),
        F.col("dec.warehouse_id").alias("largest_decline_warehouse_id"),
        F.col("dec.warehouse_name").alias("largest_decline_warehouse_name"),
        F.col("dec.change_points").alias("largest_decline_change_points"))


def top_affected_customers(m: Marts, start, end, k: int = 5) -> DataFrame:
    """T-5: top-k customers by affected revenue (id breaks ties); plans as
    TakeOrderedAndProject, so each task keeps only k candidates."""
    return customer_impact(m, start, end).orderBy(
        F.col("estimated_affected_revenue").desc(), F.col("customer_id").asc()).limit(k)


def otif_metrics_json(m: Marts, start, end) -> DataFrame:
    """Structured result sink, ``{"result": {...}}`` as one JSON string (public names, nulls kept)."""
    return result_json(otif_metrics(m, start, end))


COMPARISON = ("warehouse_id", "warehouse_name", "previous_otif", "current_otif", "change_points", "previous_orders",
              "current_orders", "previous_late_orders", "current_late_orders", "previous_partial_shipments",
              "current_partial_shipments")


def overview_json(m: Marts, prev: tuple, cur: tuple) -> DataFrame:
    """C1 whole: the overview with ``warehouseComparison[]`` and ``largestWarehouseDecline`` as one JSON string,
    from one facts scan.  The list has one entry per site."""
    comp = _period_comparison(m, prev, cur)
    site = F.struct(*COMPARISON)
    tot = comp.agg(
        F.sum("previous_orders").alias("pn"), F.sum("previous_otif_orders").alias("po"),
        F.sum("current_orders").alias("cn"), F.sum("current_otif_orders").alias("co"),
        F.sum("current_late_orders").alias("late_orders"),
        F.sum("current_partial_shipments").alias("partial_shipments"),
        F.array_sort(F.collect_list(site)).alias("warehouse_comparison"),
        F.min_by(site, F.struct("change_points", "warehouse_id")).alias("largest_warehouse_decline"))
    pt, ct = pct_tenths(F.col("po"), F.col("pn")), pct_tenths(F.col("co"), F.col("cn"))
    return result_json(tot.select((ct.cast("double") / 10.0).alias("current_otif"),
                                  ((ct - pt).cast("double") / 10.0).alias("month_over_month_change"),
                                  "late_orders", "partial_shipments", "warehouse_comparison",
                                  "largest_warehouse_decline"))


NO_VALUE = "—"


def percent_display(c):
    """``12.3%`` (one decimal); a dash for no value."""
    return F.when(c.isNull(), F.lit(NO_VALUE)).otherwise(F.format_string("%.1f%%", c))


def date_range_display(start):
    """a range by the month that it starts in (``August``); empty without one."""
    return F.coalesce(F.date_format(start, "MMMM"), F.lit(""))


def signed_points_display(c):
    """``+1.2 pts`` / ``-3.4 pts`` / ``0.0 pts``."""
    return F.concat(F.when(c > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.1f", c), F.lit(" pts"))


def count_display(c):
    """thousands separators (``1,234``); a dash for no value."""
    return F.coalesce(F.format_number(c, 0), F.lit(NO_VALUE))


def warehouse_comparison_display(m: Marts, prev: tuple, cur: tuple) -> DataFrame:
    """F13 over J7: the per-warehouse comparison formatted for display."""
    c = warehouse_period_comparison(m, prev, cur)
    return c.select("warehouse_id", "warehouse_name",
                    date_range_display(F.lit(as_date(cur[0]))).alias("period_display"),
                    percent_display(F.col("previous_otif")).alias("previous_otif_display"),
                    percent_display(F.col("current_otif")).alias("current_otif_display"),
                    signed_points_display(F.col("change_points")).alias("change_display"),
                    count_display(F.col("current_orders")).alias("current_orders_display"))
