"""The query catalogue as SQL table functions.

    register_tools(marts, index=index, embedder=embedder)
    spark.sql("SELECT * FROM get_otif_metrics(:s, :e, warehouseId => :w)", args={"s": "1996-08-01", "e": "1996-08-31", "w": 5})

Each tool of ``plans.catalog`` is a temporary SQL function over views of the
marts.  A call is expanded into the query that holds it, so arguments -- literals
or parameter markers, positional or named, optional ones with defaults -- are
constants to the optimizer: filters reach the scans and absent ones fold away.
Arguments are checked in SQL with the messages of the catalogue: unknown or missing
ones when the call is analysed, unfit values when a row of the tables is read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.operators import embed
from ordersight.operators.facts import order_facts
from ordersight.sources.marts import Marts

MAX_ID = 2 ** 53 - 1
_DATES = "startDate STRING, endDate STRING"
_RANGE = "BETWEEN tool_start(startDate, endDate) AND tool_date(endDate, 'endDate')"


def _same(column: str, argument: str) -> str:
    return f"(tool_id({argument}, '{argument}') IS NULL OR {column} = {argument})"


#: Helpers: name -> (arguments, result, body).
HELPERS = {
    "tool_date": ("v STRING, field STRING", "DATE", """
        CASE WHEN NOT coalesce(v RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$', false)
             THEN CAST(raise_error(concat(field, ' must use YYYY-MM-DD format')) AS DATE)
             WHEN try_to_date(v, 'yyyy-MM-dd') IS NULL
             THEN CAST(raise_error(concat(field, ' must be a valid calendar date')) AS DATE)
             ELSE try_to_date(v, 'yyyy-MM-dd') END"""),
    "tool_start": (_DATES, "DATE", """
        CASE WHEN tool_date(startDate, 'startDate') <= tool_date(endDate, 'endDate') THEN tool_date(startDate, 'startDate')
             ELSE CAST(raise_error('startDate must be on or before endDate') AS DATE) END"""),
    "tool_id": ("v BIGINT, field STRING", "BIGINT", f"""
        CASE WHEN v IS NULL OR v BETWEEN 1 AND {MAX_ID} THEN v
             ELSE CAST(raise_error(concat(field, ' must be a positive integer')) AS BIGINT) END"""),
    "tool_pct": ("n BIGINT, d BIGINT", "DOUBLE", """
        CASE WHEN d > 0 THEN ((coalesce(n, 0) * 2000 + d) DIV (d * 2)) / 10.0D ELSE 0.0D END"""),
}

#: Tools over the marts: name -> (arguments, query).
TOOL_SQL = {
    "get_otif_metrics": (f"{_DATES}, warehouseId BIGINT DEFAULT NULL, customerId BIGINT DEFAULT NULL", f"""
        SELECT tool_start(startDate, endDate) AS start_date, tool_date(endDate, 'endDate') AS end_date,
               tool_id(warehouseId, 'warehouseId') AS warehouse_id, tool_id(customerId, 'customerId') AS customer_id, c.*,
               tool_pct(on_time_orders, total_orders) AS on_time_percentage,
               tool_pct(in_full_orders, total_orders) AS in_full_percentage,
               tool_pct(otif_orders, total_orders) AS otif_percentage
        FROM (SELECT count(*) AS total_orders, count_if(on_time) AS on_time_orders, count_if(in_full) AS in_full_orders,
                     count_if(otif) AS otif_orders
              FROM tool_order_facts
              WHERE order_date {_RANGE} AND {_same("warehouse_id", "warehouseId")} AND {_same("customer_id", "customerId")}) c"""),
    "get_warehouse_performance": (_DATES, f"""
        SELECT w.warehouse_id, w.warehouse_name, coalesce(n, 0) AS total_orders, tool_pct(otif, n) AS otif_percentage,
               coalesce(late, 0) AS late_order_count, coalesce(partial, 0) AS partial_shipment_count
        FROM tool_warehouses w LEFT JOIN (
            SELECT warehouse_id, count(*) AS n, count_if(otif) AS otif, count_if(late) AS late, count_if(has_short) AS partial
            FROM tool_order_facts WHERE order_date {_RANGE} GROUP BY warehouse_id) c ON c.warehouse_id = w.warehouse_id"""),
    "get_inventory_health": (f"{_DATES}, warehouseId BIGINT DEFAULT NULL, productId BIGINT DEFAULT NULL", f"""
        SELECT g.product_id, p.sku, p.product_name, p.category, g.warehouse_id, w.warehouse_name, days_below_safety_stock,
               lowest_quantity_on_hand, p.safety_stock AS safety_stock_target
        FROM (SELECT i.product_id, i.warehouse_id, count(*) AS days_below_safety_stock,
                     min(i.quantity_on_hand) AS lowest_quantity_on_hand
              FROM tool_inventory i JOIN (SELECT product_id, safety_stock FROM tool_products) s ON s.product_id = i.product_id
              WHERE i.quantity_on_hand < s.safety_stock AND i.inventory_date {_RANGE}
                AND {_same("i.warehouse_id", "warehouseId")} AND {_same("i.product_id", "productId")}
              GROUP BY i.product_id, i.warehouse_id) g
        JOIN tool_products p ON p.product_id = g.product_id JOIN tool_warehouses w ON w.warehouse_id = g.warehouse_id"""),
    "get_vendor_performance": (f"{_DATES}, vendorId BIGINT DEFAULT NULL", f"""
        SELECT v.vendor_id, v.vendor_name, coalesce(n, 0) AS purchase_orders, coalesce(on_time, 0) AS on_time_deliveries,
               coalesce(late, 0) AS late_deliveries, tool_pct(on_time, n) AS on_time_percentage,
               CASE WHEN late > 0 THEN ((days * 20 + late) DIV (late * 2)) / 10.0D ELSE 0.0D END AS average_days_late
        FROM (SELECT * FROM tool_vendors WHERE {_same("vendor_id", "vendorId")}) v LEFT JOIN (
            SELECT vendor_id, count(*) AS n, count_if(actual_delivery_date <= expected_delivery_date) AS on_time,
                   count_if(late) AS late, sum(CASE WHEN late THEN datediff(until, expected_delivery_date) END) AS days
            FROM (SELECT *, coalesce(actual_delivery_date, tool_date(endDate, 'endDate')) AS until,
                         coalesce(actual_delivery_date, tool_date(endDate, 'endDate')) > expected_delivery_date AS late
                  FROM tool_purchase_orders
                  WHERE expected_delivery_date {_RANGE} AND {_same("vendor_id", "vendorId")})
            GROUP BY vendor_id) c ON c.vendor_id = v.vendor_id"""),
    "get_customer_impact": (f"{_DATES}, warehouseId BIGINT DEFAULT NULL", f"""
        SELECT k.customer_id, k.customer_name, k.customer_segment, k.region, n AS total_orders,
               tool_pct(otif, n) AS otif_percentage, late AS late_orders, partial AS partial_orders,
               coalesce(cents, 0) / 100.0D AS estimated_affected_revenue
        FROM (SELECT customer_id, count(*) AS n, count_if(otif_lenient) AS otif, count_if(late) AS late,
                     count_if(has_short) AS partial, sum(CASE WHEN affected THEN order_value_cents END) AS cents
              FROM tool_order_facts WHERE order_date {_RANGE} AND {_same("warehouse_id", "warehouseId")}
              GROUP BY customer_id) c
        JOIN tool_customers k ON k.customer_id = c.customer_id"""),
}

# The question is one row, embedded once and joined to the index.
_SEARCH = """
        SELECT CAST(rank AS INT) AS rank, {columns}, similarity
        FROM (SELECT {columns}, similarity, row_number() OVER (ORDER BY similarity DESC, _at) AS rank
              FROM (SELECT *, CAST(round(CASE WHEN vv > 0 AND qq > 0 THEN vq / (sqrt(vv) * sqrt(qq)) ELSE 0.0D END * 1000000)
                                   AS BIGINT) / 1000000.0D AS similarity
                    FROM (SELECT *, aggregate(_v, 0.0D, (a, x) -> a + x * x) AS vv,
                                 aggregate(_q, 0.0D, (a, x) -> a + x * x) AS qq,
                                 aggregate(zip_with(_v, _q, (x, y) -> x * y), 0.0D, (a, x) -> a + x) AS vq
                          FROM (SELECT tool_embed(CASE
                                    WHEN query IS NULL OR length(trim(query)) = 0
                                    THEN CAST(raise_error('query must be a non-empty string.') AS STRING)
                                    WHEN length(query) > 4000
                                    THEN CAST(raise_error('query must not exceed 4000 characters.') AS STRING)
                                    ELSE trim(query) END) AS _q) CROSS JOIN tool_policy_index)))
        WHERE rank <= CASE WHEN topK BETWEEN 1 AND 50 THEN topK
                           ELSE CAST(raise_error('topK must be an integer between 1 and 50.') AS INT) END"""


def register_tools(m: Marts, index: DataFrame | None = None, embedder=None) -> list[str]:
    """Register the tools in the session of ``m``; the sixth one if an index and its embedder are given."""
    spark = m.spark
    for name in ("warehouses", "products", "vendors", "customers", "inventory", "purchase_orders"):
        m.mart(name).createOrReplaceTempView(f"tool_{name}")
    order_facts(m).createOrReplaceTempView("tool_order_facts")
    for name, (args, kind, body) in HELPERS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    tools = dict(TOOL_SQL)
    if index is not None:
        @F.pandas_udf("array<double>")
        def vector(texts: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(embedder(texts.fillna("").tolist()), np.float64).tolist())

        spark.udf.register("tool_embed", vector)
        columns = ", ".join(f"`{c}`" for c in index.columns if c != "embedding")
        index.select("*", F.col("embedding").cast("array<double>").alias("_v"), embed.chunk_order(index).alias("_at")) \
            .drop("embedding").createOrReplaceTempView("tool_policy_index")
        tools["search_company_policies"] = "query STRING, topK INT DEFAULT 3", _SEARCH.format(columns=columns)
    for name, (args, body) in tools.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS TABLE RETURN {body}")
    return list(tools)
