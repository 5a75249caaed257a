"""Registered inventory and vendor queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.operators import evidence, inventory, vendors
from ordersight.plans import params as P
from ordersight.plans.mart_sql import with_marts
from ordersight.plans.registry import register
from ordersight.plans.sqlfrag import between, cnt, d, pct_sql
from ordersight.sources.store import stored

CUR = P.CURRENT
ORACLE: dict[str, str] = {}


@register("mart_inventory")
def q_mart_inventory(m):
    """Daily inventory snapshot mart, whole table."""
    return m.inventory


ORACLE["mart_inventory"] = with_marts("m_inventory") + " SELECT * FROM m_inventory"


@register("mart_purchase_orders")
def q_mart_purchase_orders(m):
    """Purchase-order mart, whole table."""
    return m.purchase_orders


ORACLE["mart_purchase_orders"] = with_marts("m_purchase_orders") + " SELECT * FROM m_purchase_orders"

# ---- inventory -------------------------------------------------------------

# Snapshots below the product's safety stock, counted per pair; names are joined to the counts.
_A3_SQL = with_marts("m_inventory", "m_products", "m_warehouses") + f""",
    short AS (SELECT warehouse_id, product_id, quantity_on_hand, inventory_date
              FROM m_inventory SEMI JOIN m_products
                ON m_products.product_id = m_inventory.product_id AND m_products.safety_stock > quantity_on_hand
              WHERE {between('inventory_date', CUR)}),
    pairs AS (SELECT warehouse_id, product_id, COUNT(inventory_date) AS days_below_safety_stock,
                     MIN(quantity_on_hand) AS lowest_quantity_on_hand FROM short GROUP BY ALL),
    a3 AS (SELECT product_id, sku, product_name, category, warehouse_id, warehouse_name, days_below_safety_stock,
                  lowest_quantity_on_hand, safety_stock AS safety_stock_target
           FROM pairs JOIN m_products USING (product_id) JOIN m_warehouses USING (warehouse_id))"""


@register("inventory_below_safety")
def q_inventory_below_safety(m):
    """A3 / P10: days below safety stock per product x warehouse, current month."""
    return inventory.inventory_below_safety(m, *CUR)


ORACLE["inventory_below_safety"] = _A3_SQL + " SELECT * FROM a3"


@register("inventory_health")
def q_inventory_health(m):
    """A4: inventory health summary row, current month."""
    return inventory.inventory_health(m, *CUR)


ORACLE["inventory_health"] = _A3_SQL + f"""
    SELECT {d(CUR[0])} AS start_date, {d(CUR[1])} AS end_date, CAST(NULL AS BIGINT) AS warehouse_id,
           CAST(NULL AS BIGINT) AS product_id, COUNT(DISTINCT product_id) AS products_below_safety_stock,
           CAST(COALESCE(SUM(days_below_safety_stock), 0) AS BIGINT) AS number_of_days_below_safety_stock,
           MIN(lowest_quantity_on_hand) AS lowest_quantity_on_hand
    FROM a3"""


@register("evidence_inventory")
def q_evidence_inventory(m):
    """T-6: first 12 affected products in detail order."""
    return inventory.evidence_inventory(m, *CUR, n=12)


ORACLE["evidence_inventory"] = _A3_SQL + """
    SELECT product_id, warehouse_id, sku, product_name, warehouse_name, days_below_safety_stock,
           lowest_quantity_on_hand, safety_stock_target
    FROM a3 ORDER BY days_below_safety_stock DESC, product_id, warehouse_id LIMIT 12"""


@register("warehouse_below_safety_span")
def q_warehouse_below_safety_span(m):
    """Below-safety span per warehouse, current month."""
    return inventory.warehouse_below_safety_span(m, *CUR)


ORACLE["warehouse_below_safety_span"] = _A3_SQL + """
    SELECT warehouse_id, any_value(warehouse_name) AS warehouse_name, COUNT(DISTINCT product_id) AS products_below_safety,
           COUNT(*) AS below_safety_product_days, MIN(inventory_date) AS first_date, MAX(inventory_date) AS last_date
    FROM short JOIN m_warehouses USING (warehouse_id) GROUP BY warehouse_id"""

# ---- vendors ---------------------------------------------------------------

# Purchase orders of the month, each with the days that it is late: delivered late, or open past its date at
# the month's end (0 or less: not late).
_PO_CTE = f"""po AS (
      SELECT *, CAST(COALESCE(actual_delivery_date, {d(CUR[1])}) - expected_delivery_date AS INTEGER) AS overdue,
             actual_delivery_date IS NOT NULL AS arrived
      FROM m_purchase_orders WHERE {between('expected_delivery_date', CUR)})"""


def _vendor_perf_sql(vendor_id=None) -> str:
    only = "" if vendor_id is None else f"WHERE vendor_id = {vendor_id}"
    return with_marts("m_vendors", "m_purchase_orders") + f""",
    {_PO_CTE},
    tally AS (SELECT vendor_id, COUNT(*) AS n, COUNT(*) FILTER (arrived AND overdue <= 0) AS good,
                     COUNT(*) FILTER (overdue > 0) AS bad, SUM(overdue) FILTER (overdue > 0) AS late_days
              FROM po GROUP BY vendor_id),
    vp AS (SELECT vendor_id, vendor_name, COALESCE(n, 0) AS purchase_orders, COALESCE(good, 0) AS on_time_deliveries,
                  COALESCE(bad, 0) AS late_deliveries, late_days
           FROM (SELECT * FROM m_vendors {only}) v LEFT JOIN tally USING (vendor_id))"""


def _vendor_perf_select() -> str:
    return f"""SELECT vendor_id, vendor_name, purchase_orders, on_time_deliveries, late_deliveries,
           {pct_sql('on_time_deliveries', 'purchase_orders')} AS on_time_percentage,
           CASE WHEN late_deliveries > 0 THEN CAST((20 * CAST(late_days AS BIGINT) + late_deliveries)
                // (2 * late_deliveries) AS DOUBLE) / 10.0 ELSE 0.0 END AS average_days_late
    FROM vp"""


@register("vendor_performance")
def q_vendor_performance(m):
    """Vendor performance as of the current month end."""
    return vendors.vendor_performance(m, *CUR)


ORACLE["vendor_performance"] = _vendor_perf_sql() + " " + _vendor_perf_select()


@register("vendor_performance_filtered")
def q_vendor_performance_filtered(m):
    """Vendor performance for one vendor id."""
    return vendors.vendor_performance(m, *CUR, vendor_id=P.FILTER_VENDOR)


ORACLE["vendor_performance_filtered"] = _vendor_perf_sql(P.FILTER_VENDOR) + " " + _vendor_perf_select()


@register("evidence_vendors")
def q_evidence_vendors(m):
    """T-9: first 3 vendors (by id) with late deliveries."""
    return vendors.evidence_vendors(m, *CUR, n=3)


ORACLE["evidence_vendors"] = (_vendor_perf_sql() + " SELECT * FROM (" + _vendor_perf_select()
                              + ") t WHERE late_deliveries > 0 ORDER BY vendor_id LIMIT 3")


@register("vendor_late_products")
def q_vendor_late_products(m):
    """A6 / J6 (flat): late POs per vendor x product."""
    return vendors.vendor_late_products(m, *CUR)


ORACLE["vendor_late_products"] = with_marts("m_purchase_orders", "m_products") + f""",
    {_PO_CTE},
    n AS (SELECT vendor_id, product_id, COUNT(*) AS late_purchase_orders FROM po WHERE overdue > 0 GROUP BY ALL)
    SELECT vendor_id, product_id, sku, product_name, late_purchase_orders FROM n JOIN m_products USING (product_id)"""

_C2_SQL = with_marts("m_purchase_orders", "m_products", "m_vendors", "m_warehouses") + f""",
    {_PO_CTE},
    c2 AS (SELECT po_id AS purchase_order_id, vendor_id, vendor_name, warehouse_id, warehouse_name, product_id, sku,
                  product_name, expected_delivery_date, actual_delivery_date, overdue AS days_late, quantity_ordered,
                  quantity_received
           FROM (SELECT * FROM po WHERE overdue > 0) late JOIN m_products USING (product_id)
                JOIN m_vendors USING (vendor_id) JOIN m_warehouses USING (warehouse_id))"""


@register("late_purchase_orders")
def q_late_purchase_orders(m):
    """Late purchase-order detail, current month."""
    return vendors.late_purchase_orders(m, *CUR)


ORACLE["late_purchase_orders"] = _C2_SQL + " SELECT * FROM c2"


def _scorecard(m, page_size):
    """The paged scorecard with both lists as JSON text."""
    sc = vendors.vendor_scorecard_nested(m, *CUR, page_size=page_size)
    text = {c: F.to_json(c, {"ignoreNullFields": "false"}) for c in ("products_affected", "late_purchase_orders")}
    return sc.withColumns(text)


@register("vendor_scorecard_nested")
def q_vendor_scorecard_nested(m):
    """Vendor scorecard with affected products and late POs nested
    in pages of at most 100; the counts stand on a vendor's page 0."""
    return _scorecard(m, vendors.SCORECARD_PAGE_SIZE)


@register("vendor_scorecard_small_pages")
def q_vendor_scorecard_small_pages(m):
    """The same in pages of 3, so that vendors have several."""
    return _scorecard(m, 3)


def _scorecard_sql(size: int) -> str:
    return _C2_SQL + f""",
    tally AS (SELECT vendor_id, COUNT(*) AS n, COUNT(*) FILTER (arrived AND overdue <= 0) AS good,
                     COUNT(*) FILTER (overdue > 0) AS bad, SUM(overdue) FILTER (overdue > 0) AS late_days
              FROM po GROUP BY vendor_id),
    vp AS (SELECT vendor_id, vendor_name, COALESCE(n, 0) AS purchase_orders, COALESCE(good, 0) AS on_time_deliveries,
                  COALESCE(bad, 0) AS late_deliveries, late_days FROM m_vendors LEFT JOIN tally USING (vendor_id)),
    perf AS ({_vendor_perf_select()}),
    pr AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY late_purchase_orders DESC, product_id) AS rn
           FROM (SELECT vendor_id, product_id, any_value(sku) AS sku, any_value(product_name) AS product_name,
                        COUNT(*) AS late_purchase_orders FROM c2 GROUP BY vendor_id, product_id)),
    pp AS (SELECT vendor_id, (rn - 1) // {size} AS page, list({{'position': rn, 'product_id': product_id, 'sku': sku,
             'product_name': product_name, 'late_purchase_orders': late_purchase_orders}} ORDER BY rn) AS products
           FROM pr GROUP BY ALL),
    pl AS (SELECT *, row_number() OVER (PARTITION BY vendor_id ORDER BY actual_delivery_date DESC NULLS LAST,
                                        purchase_order_id) AS rn FROM c2),
    lp AS (SELECT vendor_id, (rn - 1) // {size} AS page, list({{'position': rn, 'purchase_order_id': purchase_order_id,
             'warehouse_id': warehouse_id, 'warehouse_name': warehouse_name, 'product_id': product_id, 'sku': sku,
             'product_name': product_name, 'expected_delivery_date': strftime(expected_delivery_date, '%Y-%m-%d'),
             'actual_delivery_date': strftime(actual_delivery_date, '%Y-%m-%d'), 'days_late': days_late,
             'quantity_ordered': quantity_ordered, 'quantity_received': quantity_received}} ORDER BY rn) AS pos
           FROM pl GROUP BY ALL),
    pages AS (SELECT COALESCE(pp.vendor_id, lp.vendor_id) AS vendor_id, COALESCE(pp.page, lp.page) AS page, products, pos
              FROM pp FULL JOIN lp ON lp.vendor_id = pp.vendor_id AND lp.page = pp.page)
    SELECT vendor_id, vendor_name,
           CASE WHEN COALESCE(page, 0) = 0 THEN purchase_orders END AS purchase_orders,
           CASE WHEN COALESCE(page, 0) = 0 THEN on_time_deliveries END AS on_time_deliveries,
           CASE WHEN COALESCE(page, 0) = 0 THEN late_deliveries END AS late_deliveries,
           CASE WHEN COALESCE(page, 0) = 0 THEN on_time_percentage END AS on_time_percentage,
           CASE WHEN COALESCE(page, 0) = 0 THEN average_days_late END AS average_days_late,
           CAST(COALESCE(page, 0) AS INTEGER) AS page,
           COALESCE(CAST(to_json(products) AS VARCHAR), '[]') AS products_affected,
           COALESCE(CAST(to_json(pos) AS VARCHAR), '[]') AS late_purchase_orders
    FROM perf LEFT JOIN pages USING (vendor_id)"""


@register("vendor_scorecard_pages")
def q_vendor_scorecard_pages(m):
    """C3 flat check: the scorecard's pages exploded back to one row per
    child (list, 1-based position, id, measure)."""
    sc = vendors.vendor_scorecard_nested(m, *CUR)
    po = sc.select("vendor_id", "page", F.explode("late_purchase_orders").alias("c")).select(
        "vendor_id", "page", F.lit("late_purchase_orders").alias("list"), "c.position",
        F.col("c.purchase_order_id").alias("child_id"), F.col("c.days_late").cast("bigint").alias("measure"))
    pr = sc.select("vendor_id", "page", F.explode("products_affected").alias("c")).select(
        "vendor_id", "page", F.lit("products_affected").alias("list"), "c.position",
        F.col("c.product_id").alias("child_id"), F.col("c.late_purchase_orders").alias("measure"))
    return po.unionByName(pr)


ORACLE["vendor_scorecard_pages"] = _C2_SQL + """,
    kids AS (
      SELECT vendor_id, 'late_purchase_orders' AS list, purchase_order_id AS child_id, CAST(days_late AS BIGINT) AS measure,
             row_number() OVER (PARTITION BY vendor_id ORDER BY actual_delivery_date DESC NULLS LAST, purchase_order_id) AS rn
      FROM c2
      UNION ALL
      SELECT vendor_id, 'products_affected', product_id, COUNT(*),
             row_number() OVER (PARTITION BY vendor_id ORDER BY COUNT(*) DESC, product_id)
      FROM c2 GROUP BY vendor_id, product_id)
    SELECT vendor_id, CAST((rn - 1) // 100 AS INTEGER) AS page, list, CAST(rn AS INTEGER) AS position, child_id, measure
    FROM kids"""


ORACLE["vendor_scorecard_nested"] = _scorecard_sql(100)
ORACLE["vendor_scorecard_small_pages"] = _scorecard_sql(3)


@register("vendor_month_variance_stored")
def q_vendor_month_variance_stored(m):
    """A10 over the persisted layout: one month's partition of purchase orders."""
    return vendors.vendor_month_variance(stored(m), CUR[0][:7])


@register("evidence_bundle")
def q_evidence_bundle(m):
    """C4: the evidence of an investigation of the current month: OTIF, warehouses, inventory with its first 12
    products, late vendors with their first 20 late POs, the first 5 customers."""
    return evidence.evidence_bundle(m, *CUR)


@register("evidence_vendor_pos")
def q_evidence_vendor_pos(m):
    """T-7: first 20 late POs per vendor."""
    return vendors.evidence_vendor_pos(m, *CUR, n=20)


ORACLE["evidence_vendor_pos"] = _C2_SQL + """,
    r AS (SELECT *, row_number() OVER (PARTITION BY vendor_id
                 ORDER BY actual_delivery_date DESC NULLS LAST, purchase_order_id) AS rank FROM c2)
    SELECT vendor_id, vendor_name, CAST(rank AS INTEGER) AS rank, purchase_order_id, warehouse_name, product_name,
           expected_delivery_date, actual_delivery_date, days_late, quantity_ordered, quantity_received
    FROM r WHERE rank <= 20"""


@register("vendor_month_variance")
def q_vendor_month_variance(m):
    """A10: signed delivery variance per vendor for the current month."""
    return vendors.vendor_month_variance(m, CUR[0][:7])


ORACLE["vendor_month_variance"] = ORACLE["vendor_month_variance_stored"] = with_marts("m_purchase_orders", "m_vendors") + f"""
    SELECT v.vendor_id, v.vendor_name, COUNT(*) AS purchase_orders,
           {cnt('po.actual_delivery_date > po.expected_delivery_date')} AS late_orders,
           ROUND(AVG(CAST(po.actual_delivery_date - po.expected_delivery_date AS DOUBLE)), 1) AS average_days_vs_expected
    FROM m_purchase_orders po JOIN m_vendors v ON v.vendor_id = po.vendor_id
    WHERE strftime(po.expected_delivery_date, '%Y-%m') = '{CUR[0][:7]}'
    GROUP BY v.vendor_id, v.vendor_name"""


def _bundle_sql() -> str:
    from ordersight.plans import q_service

    o = q_service.ORACLE
    a3 = "SELECT * FROM (" + ORACLE["evidence_inventory"] + ") z"

    def part(name, order, fields, src):
        js = ", ".join(f"'{k}': {v}" for k, v in fields.items())
        return (f"SELECT '{name}' AS part, CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS position, "
                f"CAST(to_json({{{js}}}) AS VARCHAR) AS item FROM ({src}) t")

    day = lambda c: f"strftime({c}, '%Y-%m-%d')"
    return " UNION ALL ".join([
        part("otif", "total_orders", {"startDate": day("start_date"), "endDate": day("end_date"), "totalOrders": "total_orders",
             "otifOrders": "otif_orders", "onTimePercentage": "on_time_percentage",
             "inFullPercentage": "in_full_percentage", "otifPercentage": "otif_percentage"}, o["otif_metrics"]),
        part("warehouses", "warehouse_id", {"warehouseId": "warehouse_id", "warehouseName": "warehouse_name",
             "totalOrders": "total_orders", "otifPercentage": "otif_percentage", "lateOrderCount": "late_order_count",
             "partialShipmentCount": "partial_shipment_count"}, o["warehouse_performance"]),
        part("inventory", "start_date", {"startDate": day("start_date"), "endDate": day("end_date"),
             "productsBelowSafetyStock": "products_below_safety_stock",
             "numberOfDaysBelowSafetyStock": "number_of_days_below_safety_stock"}, ORACLE["inventory_health"]),
        part("affectedProducts", "days_below_safety_stock DESC, product_id, warehouse_id", {"sku": "sku",
             "productName": "product_name", "warehouseName": "warehouse_name",
             "daysBelowSafetyStock": "days_below_safety_stock", "lowestQuantityOnHand": "lowest_quantity_on_hand",
             "safetyStockTarget": "safety_stock_target"}, a3),
        part("vendors", "vendor_id", {"vendorName": "vendor_name", "purchaseOrders": "purchase_orders",
             "lateDeliveries": "late_deliveries", "onTimePercentage": "on_time_percentage",
             "averageDaysLate": "average_days_late"},
             "SELECT * FROM (" + ORACLE["vendor_performance"] + ") v WHERE late_deliveries > 0"),
        part("latePurchaseOrders", "vendor_id, rank", {"vendorName": "vendor_name", "purchaseOrderId": "purchase_order_id",
             "warehouseName": "warehouse_name", "productName": "product_name",
             "expectedDeliveryDate": day("expected_delivery_date"), "actualDeliveryDate": day("actual_delivery_date"),
             "daysLate": "days_late", "quantityOrdered": "quantity_ordered", "quantityReceived": "quantity_received"},
             ORACLE["evidence_vendor_pos"]),
        part("customers", "estimated_affected_revenue DESC, customer_id", {"customerName": "customer_name",
             "totalOrders": "total_orders", "otifPercentage": "otif_percentage", "lateOrders": "late_orders",
             "partialOrders": "partial_orders", "estimatedAffectedRevenue": "estimated_affected_revenue"},
             o["top_affected_customers"]),
    ])


ORACLE["evidence_bundle"] = _bundle_sql()
