"""Shared order-level service facts.

``order_facts`` is the one physical design decision of the service queries:

    orders (date filter pushed into the scan)
    order lines -> per-order aggregate (partial aggregate in the scan tasks)
    orders LEFT JOIN per-order aggregate (one row per order on both sides)

Pre-aggregating the lines before the join makes it skew-proof: an order with
a huge number of lines collapses map-side to one partial row per task, and
the join only ever sees one row per order.  Lines are restricted to the date
range by partition pruning (month-partitioned store, ``sources.store``) or,
on raw tables, by the runtime bloom filter Spark derives from the filtered
orders and pushes below the aggregate into the line scan.  Plan: two
exchanges (aggregated lines, filtered orders); AQE broadcasts either side
only when its measured size is under the threshold.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.sources.marts import Marts


def as_date(d: str | dt.date) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)


def date_between(col: str, start, end) -> Column:
    return F.col(col).between(F.lit(as_date(start)), F.lit(as_date(end)))


def in_range(m: Marts, name: str, date_col: str, start, end) -> DataFrame:
    """Rows of a fact mart whose ``date_col`` is in [start, end]; a stored
    layout (``sources.store``) first prunes to the covering month partitions."""
    df = m.mart_in(name, start, end) if hasattr(m, "mart_in") else m.mart(name)
    return df.filter(date_between(date_col, start, end))


def on_time_expr() -> Column:
    """Both actual dates present and neither later than requested (P5)."""
    return (F.col("actual_ship_date").isNotNull() & (F.col("actual_ship_date") <= F.col("requested_ship_date"))
            & F.col("actual_delivery_date").isNotNull()
            & (F.col("actual_delivery_date") <= F.col("requested_delivery_date")))


def filtered_orders(m: Marts, start=None, end=None, warehouse_id: int | None = None,
                    customer_id: int | None = None) -> DataFrame:
    """Orders in an inclusive date range with optional id filters."""
    o = m.orders if start is None else in_range(m, "orders", "order_date", start, end)
    if warehouse_id is not None:
        o = o.filter(F.col("warehouse_id") == F.lit(warehouse_id))
    if customer_id is not None:
        o = o.filter(F.col("customer_id") == F.lit(customer_id))
    return o


def line_facts(m: Marts, start=None, end=None) -> DataFrame:
    """Per-order line aggregate: line_count, short_lines, order_value_cents.

    Aggregated before any join: the partial aggregate runs in the scan tasks,
    so only one row per (order, task) is shuffled even if one order holds a
    third of all lines.  A store keeps these facts by month, bucketed like the
    orders; on raw tables the later join with the filtered orders lets Spark
    inject a runtime bloom filter into the line scan, below this aggregate."""
    if hasattr(m, "line_facts_in"):
        return m.line_facts_in(start, end)
    lines = m.order_lines
    short = F.col("quantity_shipped") < F.col("quantity_ordered")
    return lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.count_if(short).alias("short_lines"),
        F.sum(F.col("quantity_ordered").cast("bigint") * F.col("unit_price_cents")).alias("order_value_cents"))


def order_facts(m: Marts, start=None, end=None, warehouse_id: int | None = None,
                customer_id: int | None = None) -> DataFrame:
    """One row per order with its service flags.

    Columns: order_id, customer_id, warehouse_id, order_date, line_count,
    short_lines, order_value_cents (NULL without lines), on_time, late,
    has_short, in_full (strict: >=1 line and none short), not_short
    (lenient: zero-line orders pass), otif (strict), otif_lenient, affected.
    """
    o = filtered_orders(m, start, end, warehouse_id, customer_id).select(
        "order_id", "customer_id", "warehouse_id", "order_date", on_time_expr().alias("on_time"))
    lf = line_facts(m, start, end)
    f = o.join(lf, "order_id", "left")
    line_count = F.coalesce(F.col("line_count"), F.lit(0).cast("bigint"))
    short_lines = F.coalesce(F.col("short_lines"), F.lit(0).cast("bigint"))
    return f.select(
        "order_id", "customer_id", "warehouse_id", "order_date",
        line_count.alias("line_count"), short_lines.alias("short_lines"), "order_value_cents",
        F.col("on_time"),
        (~F.col("on_time")).alias("late"),
        (short_lines > 0).alias("has_short"),
        ((line_count > 0) & (short_lines == 0)).alias("in_full"),
        (short_lines == 0).alias("not_short"),
        (F.col("on_time") & (line_count > 0) & (short_lines == 0)).alias("otif"),
        (F.col("on_time") & (short_lines == 0)).alias("otif_lenient"),
        ((~F.col("on_time")) | (short_lines > 0)).alias("affected"))


def po_facts(m: Marts, start, end, vendor_id: int | None = None) -> DataFrame:
    """Purchase orders expected in [start, end] with lateness as of ``end``.

    late: delivered after expected (even if after ``end``), or still open and
    expected strictly before ``end``.  days_late: actual - expected when
    delivered late, ``end`` - expected when open and late, else 0.
    """
    end_d = F.lit(as_date(end))
    po = in_range(m, "purchase_orders", "expected_delivery_date", start, end)
    if vendor_id is not None:
        po = po.filter(F.col("vendor_id") == F.lit(vendor_id))
    exp, act = F.col("expected_delivery_date"), F.col("actual_delivery_date")
    delivered_late = act.isNotNull() & (act > exp)
    open_late = act.isNull() & (exp < end_d)
    return po.select(
        "*",
        (act.isNotNull() & (act <= exp)).alias("on_time"),
        (delivered_late | open_late).alias("late"),
        F.when(delivered_late, F.datediff(act, exp))
         .when(open_late, F.datediff(end_d, exp))
         .otherwise(F.lit(0)).cast("int").alias("days_late"))
