"""The marts as SQL text, for the independent DuckDB oracle.

These definitions mirror ``ordersight.sources.marts`` column for column.  They
are prefixed to oracle statements as CTEs named ``m_<mart>`` (the raw tables
keep their own names).
"""

from __future__ import annotations

MART_SQL: dict[str, str] = {
    "m_customers": """
        SELECT c_custkey + 1 AS customer_id, c_name AS customer_name, c_mktsegment AS customer_segment,
               r_name AS region, 0.90 + CAST(c_custkey % 8 AS DOUBLE) / 100.0 AS service_level_target
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "m_products": """
        SELECT p_partkey + 1 AS product_id,
               'SKU-' || lpad(CAST(p_partkey + 1 AS VARCHAR), 7, '0') AS sku,
               p_name AS product_name, p_type AS category,
               CAST(round(p_retailprice * 60) AS BIGINT) AS unit_cost_cents,
               CAST(round(p_retailprice * 100) AS BIGINT) AS unit_price_cents,
               15 + CAST(p_size % 20 AS INTEGER) AS safety_stock
        FROM part""",
    "m_warehouses": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS warehouse_id, n_name AS warehouse_name, r_name AS state,
               'City of ' || n_name AS city
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "m_vendors": """
        SELECT s_suppkey + 1 AS vendor_id, s_name AS vendor_name,
               3 + CAST(s_suppkey % 12 AS INTEGER) AS average_lead_time_days,
               0.90 + CAST(s_suppkey % 8 AS DOUBLE) / 100.0 AS target_ontime_percentage
        FROM supplier""",
    "m_orders": """
        SELECT o_orderkey + 1 AS order_id, o_custkey + 1 AS customer_id,
               CAST(CAST(o_orderkey % 23 AS INTEGER) + 1 AS BIGINT) AS warehouse_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 2 AS INTEGER) AS requested_ship_date,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 11 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 2 AS INTEGER)
                         + (CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE -CAST(o_orderkey % 3 AS INTEGER) + 1 END)
               END AS actual_ship_date,
               CAST(o_orderdate AS DATE) + CAST(4 + o_orderkey % 3 AS INTEGER) AS requested_delivery_date,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 7 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(4 + o_orderkey % 3 AS INTEGER)
                         + (CASE WHEN o_orderpriority = '5-LOW' THEN 3 ELSE -CAST(o_orderkey % 2 AS INTEGER) END)
               END AS actual_delivery_date,
               CASE WHEN o_orderstatus = 'P' THEN 'partially_fulfilled' ELSE 'delivered' END AS order_status
        FROM orders""",
    "m_order_lines": """
        SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + CAST(l_linenumber AS BIGINT) AS order_line_id,
               l_orderkey + 1 AS order_id, l_partkey + 1 AS product_id,
               CAST(l_quantity AS INTEGER) AS quantity_ordered,
               CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN CAST(floor(l_quantity * 0.45) AS INTEGER)
                    ELSE CAST(l_quantity AS INTEGER) END AS quantity_shipped,
               CAST(floor(round(l_extendedprice * 100) / l_quantity) AS BIGINT) AS unit_price_cents
        FROM lineitem""",
    "m_purchase_orders": """
        SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + CAST(l_linenumber AS BIGINT) AS po_id,
               l_suppkey + 1 AS vendor_id, l_partkey + 1 AS product_id,
               CAST(CAST(l_suppkey % 25 AS INTEGER) + 1 AS BIGINT) AS warehouse_id,
               CAST(l_shipdate AS DATE) - 21 AS order_date,
               CAST(l_shipdate AS DATE) AS expected_delivery_date,
               CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN NULL
                    ELSE CAST(l_shipdate AS DATE) + (CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey % 14 AS INTEGER)
                                                          ELSE -CAST(l_partkey % 3 AS INTEGER) END)
               END AS actual_delivery_date,
               CAST(l_quantity AS INTEGER) AS quantity_ordered,
               CASE WHEN l_linestatus = 'O' AND l_linenumber = 7 THEN 0
                    WHEN l_returnflag = 'R' THEN CAST(floor(l_quantity * 0.8) AS INTEGER)
                    ELSE CAST(l_quantity AS INTEGER) END AS quantity_received
        FROM lineitem""",
    "m_inventory": """
        SELECT CAST(CAST(l_suppkey % 25 AS INTEGER) + 1 AS BIGINT) AS warehouse_id, l_partkey + 1 AS product_id,
               CAST(l_shipdate AS DATE) AS inventory_date,
               min(CAST(l_quantity AS INTEGER)) AS quantity_on_hand,
               min(CAST(floor(l_quantity * l_tax * 4) AS INTEGER)) AS quantity_allocated,
               ((l_partkey + 1) * 100 + CAST(l_suppkey % 25 AS INTEGER) + 1) * 100000
                 + CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT) AS inventory_id
        FROM lineitem GROUP BY 1, 2, 3, 6""",
    "m_shipments": """
        SELECT order_id AS shipment_id, order_id,
               CASE order_id % 4 WHEN 0 THEN 'Parcel Express' WHEN 1 THEN 'Freightline'
                                 WHEN 2 THEN 'Regional Haul' ELSE 'Coastal Cargo' END AS carrier,
               actual_ship_date AS ship_date, actual_delivery_date AS delivery_date,
               CAST(500 + (order_id % 40) * 25 AS BIGINT) AS shipping_cost_cents,
               CASE WHEN actual_delivery_date IS NOT NULL THEN 'delivered' ELSE 'partially_delivered' END AS shipment_status
        FROM m_orders""",
}

# CTEs a mart depends on (besides raw tables).
_DEPS = {"m_shipments": ("m_orders",)}


def with_marts(*names: str) -> str:
    """``WITH`` prefix defining the named marts (dependencies first)."""
    ordered: list[str] = []
    for n in names:
        for d in _DEPS.get(n, ()):
            if d not in ordered:
                ordered.append(d)
        if n not in ordered:
            ordered.append(n)
    return "WITH " + ",\n".join(f"{n} AS ({MART_SQL[n]})" for n in ordered)
