"""Small SQL text helpers shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from ordersight.plans.mart_sql import with_marts


def d(s: str) -> str:
    return f"DATE '{s}'"


def pct_sql(n: str, den: str) -> str:
    """Half-up tenths of a percent as DOUBLE, 0.0 when the denominator is 0."""
    return (f"CASE WHEN ({den}) > 0 THEN CAST((2000 * CAST({n} AS BIGINT) + CAST({den} AS BIGINT)) "
            f"// (2 * CAST({den} AS BIGINT)) AS DOUBLE) / 10.0 ELSE 0.0 END")


def tenths_sql(n: str, den: str) -> str:
    return (f"CASE WHEN ({den}) > 0 THEN (2000 * CAST({n} AS BIGINT) + CAST({den} AS BIGINT)) "
            f"// (2 * CAST({den} AS BIGINT)) ELSE 0 END")


def cnt(cond: str) -> str:
    """Conditional count as BIGINT (0 on empty input)."""
    return f"CAST(COALESCE(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT)"


def on_time_sql(a: str = "o") -> str:
    return (f"({a}.actual_ship_date IS NOT NULL AND {a}.actual_ship_date <= {a}.requested_ship_date "
            f"AND {a}.actual_delivery_date IS NOT NULL AND {a}.actual_delivery_date <= {a}.requested_delivery_date)")


def facts_cte(where: str = "TRUE") -> str:
    """Order facts: lines flagged and summed per order, joined to the orders."""
    return f"""line_sums AS (
        SELECT order_id, bool_or(quantity_shipped < quantity_ordered) AS any_short,
               CAST(SUM(CAST(quantity_ordered AS BIGINT) * unit_price_cents) AS BIGINT) AS cents
        FROM m_order_lines GROUP BY order_id),
    facts AS (
        SELECT order_id, customer_id, warehouse_id, order_date, {on_time_sql('o')} AS on_time,
               s.any_short IS NOT NULL AS has_lines, COALESCE(s.any_short, FALSE) AS has_short, s.cents AS value_cents
        FROM m_orders o LEFT JOIN line_sums s USING (order_id) WHERE {where})"""


def with_facts(where: str, *extra_marts: str) -> str:
    return with_marts("m_orders", "m_order_lines", *extra_marts) + ",\n" + facts_cte(where)


def between(col: str, rng: tuple[str, str]) -> str:
    return f"{col} BETWEEN {d(rng[0])} AND {d(rng[1])}"
