"""Registered data-quality queries and their oracle SQL."""

from __future__ import annotations

from ordersight.operators import quality
from ordersight.plans.mart_sql import with_marts
from ordersight.plans.registry import register

ORACLE: dict[str, str] = {}
_ALL = ("m_customers", "m_products", "m_warehouses", "m_vendors", "m_orders", "m_order_lines",
        "m_inventory", "m_purchase_orders", "m_shipments")


@register("table_counts")
def q_table_counts(m):
    """UNION ALL of the nine table row counts."""
    return quality.table_counts(m)


ORACLE["table_counts"] = with_marts(*_ALL) + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM m_{t}" for t in
    ("customers", "products", "warehouses", "vendors", "orders", "order_lines", "inventory",
     "purchase_orders", "shipments"))


@register("duplicate_keys")
def q_duplicate_keys(m):
    """Q1: primary-key / unique violations per constraint."""
    return quality.duplicate_keys(m)


ORACLE["duplicate_keys"] = with_marts(*_ALL) + " " + " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, '{",".join(k)}' AS key_columns, COUNT(*) AS duplicated_keys,
               CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS excess_rows
        FROM (SELECT COUNT(*) AS n FROM m_{t} GROUP BY {", ".join(k)} HAVING COUNT(*) > 1)"""
    for t, k in quality.UNIQUE_KEYS)


def _not_null_sql() -> str:
    cols = {
        "customers": ["customer_id", "customer_name", "customer_segment", "region", "service_level_target"],
        "products": ["product_id", "sku", "product_name", "category", "unit_cost_cents", "unit_price_cents", "safety_stock"],
        "warehouses": ["warehouse_id", "warehouse_name", "state", "city"],
        "vendors": ["vendor_id", "vendor_name", "average_lead_time_days", "target_ontime_percentage"],
        "orders": ["order_id", "customer_id", "warehouse_id", "order_date", "requested_ship_date",
                   "requested_delivery_date", "order_status"],
        "order_lines": ["order_line_id", "order_id", "product_id", "quantity_ordered", "quantity_shipped", "unit_price_cents"],
        "inventory": ["warehouse_id", "product_id", "inventory_date", "quantity_on_hand", "quantity_allocated",
                      "inventory_id"],
        "purchase_orders": ["po_id", "vendor_id", "product_id", "warehouse_id", "order_date", "expected_delivery_date",
                            "quantity_ordered", "quantity_received"],
        "shipments": ["shipment_id", "order_id", "carrier", "shipping_cost_cents", "shipment_status"],
    }
    parts = []
    for t, cs in cols.items():
        for c in cs:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count FROM m_{t}")
    return with_marts(*_ALL) + " " + " UNION ALL ".join(parts)


@register("null_violations")
def q_null_violations(m):
    """Q2: NOT NULL violations per column."""
    return quality.null_violations(m)


ORACLE["null_violations"] = _not_null_sql()

_CHECK_SQL = {
    "customers": [("service_level_target between 0 and 1", "service_level_target BETWEEN 0 AND 1")],
    "products": [("unit_cost >= 0", "unit_cost_cents >= 0"), ("unit_price >= unit_cost", "unit_price_cents >= unit_cost_cents"),
                 ("safety_stock >= 0", "safety_stock >= 0")],
    "vendors": [("target_ontime_percentage between 0 and 1", "target_ontime_percentage BETWEEN 0 AND 1")],
    "orders": [("order_status in enum", "order_status IN ('delivered', 'partially_fulfilled')")],
    "order_lines": [("quantity_ordered > 0", "quantity_ordered > 0"),
                    ("0 <= quantity_shipped <= quantity_ordered", "quantity_shipped >= 0 AND quantity_shipped <= quantity_ordered"),
                    ("unit_price >= 0", "unit_price_cents >= 0")],
    "inventory": [("quantity_on_hand >= 0", "quantity_on_hand >= 0"),
                  ("0 <= quantity_allocated <= quantity_on_hand",
                   "quantity_allocated >= 0 AND quantity_allocated <= quantity_on_hand")],
    "purchase_orders": [("quantity_ordered > 0", "quantity_ordered > 0"),
                        ("0 <= quantity_received <= quantity_ordered",
                         "quantity_received >= 0 AND quantity_received <= quantity_ordered")],
    "shipments": [("shipping_cost >= 0", "shipping_cost_cents >= 0"),
                  ("shipment_status in enum", "shipment_status IN ('delivered', 'partially_delivered')")],
}


@register("check_violations")
def q_check_violations(m):
    """Q3: CHECK-rule violations per rule."""
    return quality.check_violations(m)


ORACLE["check_violations"] = with_marts(*_ALL) + " " + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{name}' AS rule, "
    f"CAST(COALESCE(SUM(CASE WHEN NOT ({expr}) THEN 1 ELSE 0 END), 0) AS BIGINT) AS violations FROM m_{t}"
    for t, rules in _CHECK_SQL.items() for name, expr in rules)


@register("fk_violations")
def q_fk_violations(m):
    """Orphaned foreign keys per relationship."""
    return quality.fk_violations(m)


ORACLE["fk_violations"] = with_marts(*_ALL) + " " + " UNION ALL ".join(
    f"""SELECT '{c}' AS child_table, '{col}' AS column_name, '{p}' AS parent_table, COUNT(*) AS violations
        FROM m_{c} x WHERE x.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_{p} y WHERE y.{pc} = x.{col})"""
    for c, col, p, pc in quality.FOREIGN_KEYS)


@register("constraint_suite")
def q_constraint_suite(m):
    """Q1-Q4: every declared constraint of the nine marts in one report."""
    return quality.constraint_suite(m)


def _within(name: str) -> str:
    return ORACLE[name].removeprefix(with_marts(*_ALL))


ORACLE["constraint_suite"] = with_marts(*_ALL) + f""",
    tc AS ({_within("table_counts")}), nv AS ({_within("null_violations")}), cv AS ({_within("check_violations")}),
    dk AS ({_within("duplicate_keys")}), fv AS ({_within("fk_violations")})
    SELECT 'row_count' AS "check", table_name, table_name AS subject, row_count AS violations FROM tc
    UNION ALL SELECT 'not_null', table_name, column_name, null_count FROM nv
    UNION ALL SELECT 'check', table_name, rule, violations FROM cv
    UNION ALL SELECT 'unique', table_name, key_columns, excess_rows FROM dk
    UNION ALL SELECT 'foreign_key', child_table, column_name || ' -> ' || parent_table, violations FROM fv"""


@register("date_string_quality")
def q_date_string_quality(m):
    """Date-string validation as a column job (format, calendar, round trip)."""
    return quality.date_string_quality(m)


ORACLE["date_string_quality"] = with_marts("m_orders") + r""",
    s AS (SELECT CASE WHEN order_id % 97 = 0 THEN CAST(year(order_date) AS VARCHAR) || '-02-30'
                      WHEN order_id % 89 = 0 THEN strftime(order_date, '%Y/%m/%d')
                      ELSE strftime(order_date, '%Y-%m-%d') END AS t FROM m_orders)
    SELECT CASE WHEN NOT regexp_matches(t, '^\d{4}-\d{2}-\d{2}$') THEN 'bad_format'
                WHEN try_strptime(t, '%Y-%m-%d') IS NULL
                     OR strftime(CAST(try_strptime(t, '%Y-%m-%d') AS DATE), '%Y-%m-%d') <> t THEN 'invalid_date'
                ELSE 'valid' END AS status, COUNT(*) AS rows
    FROM s GROUP BY 1"""
