"""Vendor performance: purchase-order punctuality as of a reporting end date."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.metrics import avg_signed_round1, avg_tenths_nonneg, pct
from ordersight.functions.scan import ordered_scan
from ordersight.operators.facts import in_range, po_facts
from ordersight.sources.marts import Marts


def vendor_performance(m: Marts, start, end, vendor_id: int | None = None) -> DataFrame:
    """A5: every vendor (idle ones with zeros): POs expected in range,
    on-time, late (as of ``end``), on-time %, average days late (over late POs); by id (T-1)."""
    return performance_of(m, po_facts(m, start, end, vendor_id), vendor_id).orderBy("vendor_id")


def performance_of(m: Marts, po: DataFrame, vendor_id: int | None = None) -> DataFrame:
    """A5 of PO facts, in no order."""
    g = po.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("purchase_orders"),
        F.count_if("on_time").alias("on_time_deliveries"),
        F.count_if("late").alias("late_deliveries"),
        F.sum(F.when(F.col("late"), F.col("days_late"))).alias("late_days"))
    v = m.vendors.select("vendor_id", "vendor_name")
    if vendor_id is not None:
        v = v.filter(F.col("vendor_id") == F.lit(vendor_id))
    j = v.join(g, "vendor_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return j.select("vendor_id", "vendor_name",
                    z("purchase_orders").alias("purchase_orders"),
                    z("on_time_deliveries").alias("on_time_deliveries"),
                    z("late_deliveries").alias("late_deliveries"),
                    pct(z("on_time_deliveries"), z("purchase_orders")).alias("on_time_percentage"),
                    avg_tenths_nonneg(F.col("late_days"), z("late_deliveries")).alias("average_days_late"))


def vendor_late_products(m: Marts, start, end, vendor_id: int | None = None) -> DataFrame:
    """Late POs per vendor x product (attributes joined after the count)."""
    late = po_facts(m, start, end, vendor_id).filter("late")
    g = late.groupBy("vendor_id", "product_id").agg(F.count(F.lit(1)).alias("late_purchase_orders"))
    p = m.products.select("product_id", "sku", "product_name")
    return g.join(p, "product_id").select("vendor_id", "product_id", "sku", "product_name", "late_purchase_orders")


def late_po_rows(m: Marts, start, end, vendor_id: int | None = None) -> DataFrame:
    """Late-PO detail with vendor, warehouse and product attributes, in no order."""
    late = po_facts(m, start, end, vendor_id).filter("late")
    v = m.vendors.select("vendor_id", "vendor_name")
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    p = m.products.select("product_id", "sku", "product_name")
    return (late.join(v, "vendor_id").join(w, "warehouse_id").join(p, "product_id")
            .select(F.col("po_id").alias("purchase_order_id"), "vendor_id", "vendor_name", "warehouse_id",
                    "warehouse_name", "product_id", "sku", "product_name", "expected_delivery_date",
                    "actual_delivery_date", "days_late", "quantity_ordered", "quantity_received"))


def late_purchase_orders(m: Marts, start, end, vendor_id: int | None = None) -> DataFrame:
    """Flat late-PO detail, latest delivery first (T-3)."""
    return late_po_rows(m, start, end, vendor_id).orderBy(F.col("actual_delivery_date").desc_nulls_last(),
                                                          "purchase_order_id")


def evidence_vendor_pos(m: Marts, start, end, n: int = 20) -> DataFrame:
    """T-7: the first n late POs per vendor (actual date desc, nulls last, then
    po id).  The rank filter plans as a WindowGroupLimit below the shuffle,
    so even a vendor holding most POs ships only n rows per map task."""
    w = Window.partitionBy("vendor_id").orderBy(F.col("actual_delivery_date").desc_nulls_last(),
                                                F.col("purchase_order_id").asc())
    return (late_po_rows(m, start, end).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
            .select("vendor_id", "vendor_name", "rank", "purchase_order_id", "warehouse_name", "product_name",
                    "expected_delivery_date", "actual_delivery_date", "days_late", "quantity_ordered",
                    "quantity_received"))


def ranked_pos(m: Marts, start, end, vendor_id: int | None = None) -> DataFrame:
    """Every PO expected in range with its attributes, and for late ones (``listed``) their ``position`` in the
    vendor's list: actual date desc, nulls last, then PO id.

    One scan of the POs and one of each dimension.  The list is numbered by an ordered scan in which listed POs
    come first, so a vendor with a third of all POs is spread over many tasks; the result is a written table that
    counts and lists are both read from."""
    w = m.warehouses.select("warehouse_id", "warehouse_name")
    p = m.products.select("product_id", "sku", "product_name")
    po = po_facts(m, start, end, vendor_id).join(w, "warehouse_id", "left").join(p, "product_id", "left")
    actual, known = F.col("actual_delivery_date"), F.col("warehouse_name").isNotNull() & F.col("sku").isNotNull()
    po = po.withColumns({"listed": F.col("late") & known, "_open": actual.isNull(),
                         "_day": -F.datediff(actual, F.lit("1970-01-01").cast("date"))})
    po = po.withColumn("_rest", ~F.col("listed"))
    out = ordered_scan(po, ["vendor_id"], ["_rest", "_open", "_day", "po_id"], "position")
    return out.withColumns({"position": F.col("position").cast("int"), "purchase_order_id": F.col("po_id")})


SCORECARD_PAGE_SIZE = 100
_PRODUCT_FIELDS = ("product_id", "sku", "product_name", "late_purchase_orders")
_PO_FIELDS = ("purchase_order_id", "warehouse_id", "warehouse_name", "product_id", "sku", "product_name",
              "expected_delivery_date", "actual_delivery_date", "days_late", "quantity_ordered", "quantity_received")


def vendor_scorecard_nested(m: Marts, start, end, vendor_id: int | None = None,
                            page_size: int = SCORECARD_PAGE_SIZE) -> DataFrame:
    """The vendor scorecard -- A5 metrics with the affected products
    (late count desc, product id) and the late POs (actual date desc, nulls
    last, PO id) nested under each vendor.

    Nesting all of a vendor's late POs in one row would hold an unbounded
    group in one row / task, so the children are nested in pages: one row per
    (vendor, page), page p holding ranks ``p*page_size+1 .. (p+1)*page_size``
    of both lists.  Nothing is dropped: the pages of a vendor together hold
    every child, in order (``position`` is the 1-based rank).  The counts stand
    on page 0 only (NULL on later pages), so sums over the result are right.
    Idle vendors keep one page 0 with empty lists.  Both lists are numbered by
    ordered scans of one table (``ranked_pos``); every page group holds at most
    ``page_size`` rows of each list."""
    ranked = ranked_pos(m, start, end, vendor_id)
    perf = performance_of(m, ranked, vendor_id)
    late = ranked.filter(F.col("late") & F.col("sku").isNotNull())
    products = late.groupBy("vendor_id", "product_id").agg(
        F.first("sku").alias("sku"), F.first("product_name").alias("product_name"),
        F.count(F.lit(1)).alias("late_purchase_orders"))
    products = ordered_scan(products.withColumn("_less", -F.col("late_purchase_orders")), ["vendor_id"],
                            ["_less", "product_id"], "position").withColumn("position", F.col("position").cast("int"))
    item = F.struct("position", *_PRODUCT_FIELDS)
    entry = F.struct("position", *_PO_FIELDS)
    listed = ranked.filter("listed").select("vendor_id", "position", entry.alias("entry"))
    item_type, entry_type = products.select(item.alias("x")).schema["x"].dataType, listed.schema["entry"].dataType
    rows = products.select("vendor_id", "position", item.alias("item"), F.lit(None).cast(entry_type).alias("entry")) \
        .unionByName(listed.withColumn("item", F.lit(None).cast(item_type)))
    page = F.floor((F.col("position") - 1) / F.lit(page_size)).cast("int")
    pages = rows.groupBy("vendor_id", page.alias("page")).agg(
        F.array_sort(F.collect_list("item")).alias("products_affected"),
        F.array_sort(F.collect_list("entry")).alias("late_purchase_orders"))
    # Inner join, not perf LEFT JOIN pages: a hot vendor's pages are the skewed
    # side, and AQE can split either side of an inner join but only the
    # preserved side of an outer one.  Idle vendors come from an anti join
    # against the vendors that have pages (a partial+final distinct).
    once = [F.when(F.col("page") == 0, F.col(c)).alias(c) for c in perf.columns[2:]]
    paged = perf.join(pages, "vendor_id").select(*perf.columns[:2], *once, "page", "products_affected",
                                                 "late_purchase_orders")
    listing = late.select("vendor_id").distinct()
    idle = perf.join(listing, "vendor_id", "left_anti").select(
        *perf.columns, F.lit(0).alias("page"),
        F.array().cast(pages.schema["products_affected"].dataType).alias("products_affected"),
        F.array().cast(pages.schema["late_purchase_orders"].dataType).alias("late_purchase_orders"))
    return paged.unionByName(idle)


def evidence_vendors(m: Marts, start, end, n: int = 3) -> DataFrame:
    """T-9: the first n vendors (by id) that have late deliveries."""
    return performance_of(m, po_facts(m, start, end)).filter(F.col("late_deliveries") > 0).orderBy("vendor_id").limit(n)


def vendor_month_variance(m: Marts, month: str) -> DataFrame:
    """A10: POs expected in one month per vendor: count, delivered-late count
    and the signed average (actual - expected), early deliveries included,
    open POs skipped; SQL ROUND (half away from zero) to 0.1."""
    y, mo = (int(x) for x in month.split("-"))
    start = dt.date(y, mo, 1)
    end = dt.date(y, mo, calendar.monthrange(y, mo)[1])
    po = in_range(m, "purchase_orders", "expected_delivery_date", start, end)
    diff = F.datediff("actual_delivery_date", "expected_delivery_date")
    g = po.groupBy("vendor_id").agg(
        F.count(F.lit(1)).alias("purchase_orders"),
        F.count_if(F.col("actual_delivery_date") > F.col("expected_delivery_date")).alias("late_orders"),
        F.sum(diff).alias("s"), F.count(diff).alias("n"))
    v = m.vendors.select("vendor_id", "vendor_name")
    return g.join(v, "vendor_id").select(
        "vendor_id", "vendor_name", "purchase_orders", "late_orders",
        avg_signed_round1(F.col("s"), F.col("n")).alias("average_days_vs_expected")) \
        .orderBy(F.col("late_orders").desc(), F.col("average_days_vs_expected").desc(), "vendor_id")
