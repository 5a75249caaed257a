"""Registered service queries (orders side) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.operators import facts, service
from ordersight.plans import params as P
from ordersight.plans.mart_sql import with_marts
from ordersight.plans.registry import register
from ordersight.plans.sqlfrag import between, cnt, d, pct_sql, tenths_sql, with_facts
from ordersight.sources.store import stored

CUR, PREV = P.CURRENT, P.PREVIOUS
ORACLE: dict[str, str] = {}


@register("mart_orders")
def q_mart_orders(m):
    """The typed orders mart, whole table."""
    return m.orders


ORACLE["mart_orders"] = with_marts("m_orders") + " SELECT * FROM m_orders"


@register("mart_order_lines")
def q_mart_order_lines(m):
    """The typed order-lines mart, whole table."""
    return m.order_lines


ORACLE["mart_order_lines"] = with_marts("m_order_lines") + " SELECT * FROM m_order_lines"


for _dim in ("customers", "products", "warehouses", "vendors", "shipments"):
    register(f"mart_{_dim}")(lambda m, _name=_dim: m.mart(_name))
    ORACLE[f"mart_{_dim}"] = with_marts(f"m_{_dim}") + f" SELECT * FROM m_{_dim}"


@register("otif_metrics")
def q_otif_metrics(m):
    """A1 (flagship): OTIF metrics for the current month."""
    return service.otif_metrics(m, *CUR)


def _otif_sql(rng, wh=None, cust=None) -> str:
    where = between("o.order_date", rng)
    if wh is not None:
        where += f" AND o.warehouse_id = {wh}"
    if cust is not None:
        where += f" AND o.customer_id = {cust}"
    return with_facts(where) + f"""
    SELECT {d(rng[0])} AS start_date, {d(rng[1])} AS end_date,
           CAST({'NULL' if wh is None else wh} AS BIGINT) AS warehouse_id,
           CAST({'NULL' if cust is None else cust} AS BIGINT) AS customer_id,
           COUNT(*) AS total_orders,
           {cnt('on_time')} AS on_time_orders,
           {cnt('has_lines AND NOT has_short')} AS in_full_orders,
           {cnt('on_time AND has_lines AND NOT has_short')} AS otif_orders,
           {pct_sql(cnt('on_time'), 'COUNT(*)')} AS on_time_percentage,
           {pct_sql(cnt('has_lines AND NOT has_short'), 'COUNT(*)')} AS in_full_percentage,
           {pct_sql(cnt('on_time AND has_lines AND NOT has_short'), 'COUNT(*)')} AS otif_percentage
    FROM facts"""


ORACLE["otif_metrics"] = _otif_sql(CUR)


@register("otif_metrics_filtered")
def q_otif_metrics_filtered(m):
    """OTIF metrics for one warehouse over a year (optional id filter)."""
    return service.otif_metrics(m, *P.YEAR, warehouse_id=P.FILTER_WAREHOUSE)


ORACLE["otif_metrics_filtered"] = _otif_sql(P.YEAR, wh=P.FILTER_WAREHOUSE)


@register("otif_metrics_customer")
def q_otif_metrics_customer(m):
    """OTIF metrics for one customer from the first order's day to the last one's."""
    first, last = m.orders.agg(F.min("order_date"), F.max("order_date")).first()
    return service.otif_metrics(m, first, last, customer_id=P.FILTER_CUSTOMER)


ORACLE["otif_metrics_customer"] = _otif_sql(("0001-01-01", "9999-12-31"), cust=P.FILTER_CUSTOMER).replace(
    f"SELECT {d('0001-01-01')} AS start_date, {d('9999-12-31')} AS end_date",
    "SELECT (SELECT MIN(order_date) FROM m_orders) AS start_date, (SELECT MAX(order_date) FROM m_orders) AS end_date")


@register("otif_metrics_json")
def q_otif_metrics_json(m):
    """OTIF result wrapped as {"result": ...} JSON (public names, nulls kept)."""
    return service.otif_metrics_json(m, *CUR)


ORACLE["otif_metrics_json"] = f"""
    SELECT CAST(to_json({{'result': {{'startDate': strftime(start_date, '%Y-%m-%d'), 'endDate': strftime(end_date, '%Y-%m-%d'),
             'warehouseId': warehouse_id, 'customerId': customer_id, 'totalOrders': total_orders,
             'onTimeOrders': on_time_orders, 'inFullOrders': in_full_orders, 'otifOrders': otif_orders,
             'onTimePercentage': on_time_percentage, 'inFullPercentage': in_full_percentage,
             'otifPercentage': otif_percentage}}}}) AS VARCHAR) AS json
    FROM ({_otif_sql(CUR)}) a"""


@register("order_service_facts")
def q_order_service_facts(m):
    """Per-order service flags for the current month."""
    return facts.order_facts(m, *CUR).select(
        "order_id", "customer_id", "warehouse_id", "order_date", "line_count", "short_lines",
        "on_time", "late", "in_full", "not_short", "otif", "otif_lenient",
        F.col("order_value_cents"))


ORACLE["order_service_facts"] = with_facts(between("o.order_date", CUR)) + """
    SELECT f.order_id, f.customer_id, f.warehouse_id, f.order_date,
           (SELECT COUNT(*) FROM m_order_lines l WHERE l.order_id = f.order_id) AS line_count,
           (SELECT COUNT(*) FROM m_order_lines l WHERE l.order_id = f.order_id
              AND l.quantity_shipped < l.quantity_ordered) AS short_lines,
           on_time, NOT on_time AS late, has_lines AND NOT has_short AS in_full, NOT has_short AS not_short,
           on_time AND has_lines AND NOT has_short AS otif, on_time AND NOT has_short AS otif_lenient,
           value_cents AS order_value_cents
    FROM facts f"""


@register("orders_in_range")
def q_orders_in_range(m):
    """Inclusive order-date range filter (pushed into the Parquet scan)."""
    return service.orders_in_range(m, *CUR)


ORACLE["orders_in_range"] = with_marts("m_orders") + f" SELECT * FROM m_orders WHERE {between('order_date', CUR)}"


@register("orders_with_short_lines")
def q_orders_with_short_lines(m):
    """Orders in range with a short line (left-semi join)."""
    return service.orders_with_short_lines(m, *CUR)


ORACLE["orders_with_short_lines"] = with_marts("m_orders", "m_order_lines") + f"""
    SELECT order_id, customer_id, warehouse_id, order_date FROM m_orders o
    WHERE {between('order_date', CUR)} AND EXISTS (SELECT 1 FROM m_order_lines l
      WHERE l.order_id = o.order_id AND l.quantity_shipped < l.quantity_ordered)"""


@register("orders_without_short_lines")
def q_orders_without_short_lines(m):
    """Orders in range with no short line (left-anti join)."""
    return service.orders_without_short_lines(m, *CUR)


ORACLE["orders_without_short_lines"] = with_marts("m_orders", "m_order_lines") + f"""
    SELECT order_id, customer_id, warehouse_id, order_date FROM m_orders o
    WHERE {between('order_date', CUR)} AND NOT EXISTS (SELECT 1 FROM m_order_lines l
      WHERE l.order_id = o.order_id AND l.quantity_shipped < l.quantity_ordered)"""


@register("warehouse_performance")
def q_warehouse_performance(m):
    """Every warehouse for the current month, idle ones with zeros."""
    return service.warehouse_performance(m, *CUR)


ORACLE["warehouse_performance"] = with_facts(between("o.order_date", CUR), "m_warehouses") + f"""
    SELECT w.warehouse_id, w.warehouse_name, COUNT(f.order_id) AS total_orders,
           {pct_sql(cnt('f.on_time AND f.has_lines AND NOT f.has_short'), 'COUNT(f.order_id)')} AS otif_percentage,
           {cnt('f.order_id IS NOT NULL AND NOT f.on_time')} AS late_order_count,
           {cnt('f.order_id IS NOT NULL AND f.has_short')} AS partial_shipment_count
    FROM m_warehouses w LEFT JOIN facts f ON f.warehouse_id = w.warehouse_id
    GROUP BY w.warehouse_id, w.warehouse_name"""


@register("customer_impact")
def q_customer_impact(m):
    """Customer impact for the current month (lenient OTIF, whole-order revenue)."""
    return service.customer_impact(m, *CUR)


def _customer_impact_sql(rng) -> str:
    return with_facts(between("o.order_date", rng), "m_customers") + f"""
    SELECT c.customer_id, c.customer_name, c.customer_segment, c.region, COUNT(*) AS total_orders,
           {pct_sql(cnt('f.on_time AND NOT f.has_short'), 'COUNT(*)')} AS otif_percentage,
           {cnt('NOT f.on_time')} AS late_orders,
           {cnt('f.has_short')} AS partial_orders,
           CAST(COALESCE(SUM(CASE WHEN NOT f.on_time OR f.has_short THEN f.value_cents END), 0) AS BIGINT) / 100.0
             AS estimated_affected_revenue
    FROM facts f JOIN m_customers c ON c.customer_id = f.customer_id
    GROUP BY c.customer_id, c.customer_name, c.customer_segment, c.region"""


ORACLE["customer_impact"] = _customer_impact_sql(CUR)


@register("top_affected_customers")
def q_top_affected_customers(m):
    """T-5: top 5 customers by affected revenue, id breaks ties."""
    return service.top_affected_customers(m, *CUR, k=5)


ORACLE["top_affected_customers"] = (
    "SELECT * FROM (" + _customer_impact_sql(CUR) + ") t ORDER BY estimated_affected_revenue DESC, customer_id LIMIT 5")


@register("monthly_otif")
def q_monthly_otif(m):
    """OTIF per order month over all orders."""
    return service.monthly_otif(m)


ORACLE["monthly_otif"] = with_facts("TRUE") + f"""
    SELECT strftime(order_date, '%Y-%m') AS month, COUNT(*) AS orders,
           {cnt('on_time AND NOT has_short')} AS otif_orders,
           {pct_sql(cnt('on_time AND NOT has_short'), 'COUNT(*)')} AS otif_percentage
    FROM facts GROUP BY 1"""


@register("warehouse_monthly_otif")
def q_warehouse_monthly_otif(m):
    """OTIF per warehouse and order month over all orders."""
    return service.warehouse_monthly_otif(m)


ORACLE["warehouse_monthly_otif"] = with_facts("TRUE", "m_warehouses") + f"""
    SELECT w.warehouse_id, w.warehouse_name, strftime(f.order_date, '%Y-%m') AS month, COUNT(*) AS orders,
           {pct_sql(cnt('f.on_time AND NOT f.has_short'), 'COUNT(*)')} AS otif_percentage
    FROM facts f JOIN m_warehouses w ON w.warehouse_id = f.warehouse_id GROUP BY 1, 2, 3"""


def _comparison_sql() -> str:
    rng = (PREV[0], CUR[1])
    ip, ic = between("f.order_date", PREV), between("f.order_date", CUR)
    otif = "f.on_time AND f.has_lines AND NOT f.has_short"
    return with_facts(between("o.order_date", rng), "m_warehouses") + f""",
    per_wh AS (
      SELECT w.warehouse_id, w.warehouse_name,
             {cnt(f'f.order_id IS NOT NULL AND {ip}')} AS previous_orders,
             {cnt(f'f.order_id IS NOT NULL AND {ic}')} AS current_orders,
             {cnt(f'{ip} AND {otif}')} AS previous_otif_orders,
             {cnt(f'{ic} AND {otif}')} AS current_otif_orders,
             {cnt(f'{ip} AND NOT f.on_time')} AS previous_late_orders,
             {cnt(f'{ic} AND NOT f.on_time')} AS current_late_orders,
             {cnt(f'{ip} AND f.has_short')} AS previous_partial_shipments,
             {cnt(f'{ic} AND f.has_short')} AS current_partial_shipments
      FROM m_warehouses w LEFT JOIN facts f ON f.warehouse_id = w.warehouse_id
      GROUP BY w.warehouse_id, w.warehouse_name),
    comp AS (
      SELECT *, CAST({tenths_sql('previous_otif_orders', 'previous_orders')} AS DOUBLE) / 10.0 AS previous_otif,
                CAST({tenths_sql('current_otif_orders', 'current_orders')} AS DOUBLE) / 10.0 AS current_otif,
                CAST({tenths_sql('current_otif_orders', 'current_orders')}
                     - {tenths_sql('previous_otif_orders', 'previous_orders')} AS DOUBLE) / 10.0 AS change_points
      FROM per_wh)"""


_COMP_COLS = ("warehouse_id, warehouse_name, previous_otif, current_otif, change_points, previous_orders, "
              "current_orders, previous_late_orders, current_late_orders, previous_partial_shipments, "
              "current_partial_shipments")


@register("warehouse_period_comparison")
def q_warehouse_period_comparison(m):
    """Previous vs current month per warehouse from one scan."""
    return service.warehouse_period_comparison(m, PREV, CUR)


ORACLE["warehouse_period_comparison"] = _comparison_sql() + f" SELECT {_COMP_COLS} FROM comp"


@register("largest_warehouse_decline")
def q_largest_warehouse_decline(m):
    """Warehouse with the largest OTIF decline (lowest id on ties)."""
    return service.largest_warehouse_decline(m, PREV, CUR)


ORACLE["largest_warehouse_decline"] = _comparison_sql() + f" SELECT {_COMP_COLS} FROM comp ORDER BY change_points, warehouse_id LIMIT 1"


@register("overview")
def q_overview(m):
    """One-row KPI overview for the current vs previous month."""
    return service.overview(m, PREV, CUR)


ORACLE["overview"] = _comparison_sql() + f""",
    tot AS (SELECT SUM(previous_orders) AS pn, SUM(previous_otif_orders) AS po, SUM(current_orders) AS cn,
                   SUM(current_otif_orders) AS co, CAST(SUM(current_late_orders) AS BIGINT) AS late_orders,
                   CAST(SUM(current_partial_shipments) AS BIGINT) AS partial_shipments FROM comp),
    dec AS (SELECT warehouse_id, warehouse_name, change_points FROM comp ORDER BY change_points, warehouse_id LIMIT 1)
    SELECT CAST({tenths_sql('co', 'cn')} AS DOUBLE) / 10.0 AS current_otif,
           CAST({tenths_sql('po', 'pn')} AS DOUBLE) / 10.0 AS previous_otif,
           CAST({tenths_sql('co', 'cn')} - {tenths_sql('po', 'pn')} AS DOUBLE) / 10.0 AS month_over_month_change,
           late_orders, partial_shipments,
           dec.warehouse_id AS largest_decline_warehouse_id, dec.warehouse_name AS largest_decline_warehouse_name,
           dec.change_points AS largest_decline_change_points
    FROM tot, dec"""


@register("overview_json")
def q_overview_json(m):
    """C1 whole: overview with the per-warehouse comparison and the largest decline, as one JSON result."""
    return service.overview_json(m, PREV, CUR)


_SITE = """{'warehouseId': warehouse_id, 'warehouseName': warehouse_name, 'previousOtif': previous_otif,
             'currentOtif': current_otif, 'changePoints': change_points, 'previousOrders': previous_orders,
             'currentOrders': current_orders, 'previousLateOrders': previous_late_orders,
             'currentLateOrders': current_late_orders, 'previousPartialShipments': previous_partial_shipments,
             'currentPartialShipments': current_partial_shipments}"""
ORACLE["overview_json"] = _comparison_sql() + f""",
    tot AS (SELECT SUM(previous_orders) AS pn, SUM(previous_otif_orders) AS po, SUM(current_orders) AS cn,
                   SUM(current_otif_orders) AS co, CAST(SUM(current_late_orders) AS BIGINT) AS late,
                   CAST(SUM(current_partial_shipments) AS BIGINT) AS part,
                   list({_SITE} ORDER BY warehouse_id) AS sites FROM comp),
    dec AS (SELECT {_SITE} AS d FROM comp ORDER BY change_points, warehouse_id LIMIT 1)
    SELECT CAST(to_json({{'result': {{'currentOtif': CAST({tenths_sql('co', 'cn')} AS DOUBLE) / 10.0,
             'monthOverMonthChange': CAST({tenths_sql('co', 'cn')} - {tenths_sql('po', 'pn')} AS DOUBLE) / 10.0,
             'lateOrders': late, 'partialShipments': part, 'warehouseComparison': sites,
             'largestWarehouseDecline': d}}}}) AS VARCHAR) AS json
    FROM tot, dec"""


# ---- one-line tool summaries (C5 / A17) ---------------------------------------

def _num(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


@register("tool_summaries")
def q_tool_summaries(m):
    """One summary sentence per business tool, current month."""
    from ordersight.operators import summaries
    return summaries.tool_summaries(m, *CUR)


def _tool_summaries_sql() -> str:
    from ordersight.plans import q_supply
    a1 = ORACLE["otif_metrics"]
    a2 = ORACLE["warehouse_performance"]
    a4 = q_supply.ORACLE["inventory_health"]
    a5 = q_supply.ORACLE["vendor_performance"]
    c2 = q_supply.ORACLE["late_purchase_orders"]
    a7 = ORACLE["customer_impact"]
    return f"""
    SELECT 'get_otif_metrics' AS tool, CAST(total_orders AS VARCHAR) || ' orders; ' || CAST(otif_orders AS VARCHAR)
           || ' OTIF (' || {_num('otif_percentage')} || '%).' AS summary FROM ({a1}) a1
    UNION ALL
    SELECT 'get_warehouse_performance', CAST((SELECT COUNT(*) FROM ({a2}) x) AS VARCHAR) || ' warehouses; lowest OTIF is '
           || lo.warehouse_name || ' (' || {_num('lo.otif_percentage')} || '%).'
    FROM (SELECT * FROM ({a2}) y ORDER BY otif_percentage, warehouse_id LIMIT 1) lo
    UNION ALL
    SELECT 'get_inventory_health', CAST(products_below_safety_stock AS VARCHAR) || ' products below safety stock across '
           || CAST(number_of_days_below_safety_stock AS VARCHAR) || ' product-location-days.' FROM ({a4}) a4
    UNION ALL
    SELECT 'get_vendor_performance', CAST((SELECT COUNT(*) FROM ({a5}) x) AS VARCHAR) || ' vendors; highest late count is '
           || top.vendor_name || ' (' || CAST(top.late_deliveries AS VARCHAR) || '); destinations: '
           || COALESCE((SELECT string_agg(warehouse_name, ', ' ORDER BY first_rn) FROM (
                 SELECT warehouse_name, MIN(rn) AS first_rn FROM (
                   SELECT warehouse_name, row_number() OVER (ORDER BY actual_delivery_date DESC NULLS LAST, purchase_order_id) AS rn
                   FROM ({c2}) c WHERE c.vendor_id = top.vendor_id) z GROUP BY warehouse_name) w), 'not specified') || '.'
    FROM (SELECT * FROM ({a5}) y ORDER BY late_deliveries DESC, vendor_id LIMIT 1) top
    UNION ALL
    SELECT 'get_customer_impact', CAST(COUNT(*) AS VARCHAR) || ' customers; '
           || CAST(COUNT(*) FILTER (WHERE estimated_affected_revenue > 0) AS VARCHAR) || ' with affected revenue.'
    FROM ({a7}) a7"""


ORACLE["tool_summaries"] = _tool_summaries_sql()


@register("warehouse_comparison_display")
def q_warehouse_comparison_display(m):
    """period comparison formatted for display (12.3%, +1.2 pts, 1,234)."""
    return service.warehouse_comparison_display(m, PREV, CUR)


ORACLE["warehouse_comparison_display"] = _comparison_sql() + """
    SELECT warehouse_id, warehouse_name, 'August' AS period_display, printf('%.1f%%', previous_otif) AS previous_otif_display,
           printf('%.1f%%', current_otif) AS current_otif_display,
           CASE WHEN change_points > 0 THEN '+' ELSE '' END || printf('%.1f', change_points) || ' pts' AS change_display,
           format('{:,}', current_orders) AS current_orders_display
    FROM comp"""


# ---- over the month-partitioned store ------------------------------------------


@register("otif_metrics_stored")
def q_otif_metrics_stored(m):
    """A1 over the persisted layout: one month's partitions of orders and lines."""
    return service.otif_metrics(stored(m), *CUR)


ORACLE["otif_metrics_stored"] = _otif_sql(CUR)


@register("warehouse_performance_stored")
def q_warehouse_performance_stored(m):
    """A2 over the persisted layout."""
    return service.warehouse_performance(stored(m), *CUR)


ORACLE["warehouse_performance_stored"] = ORACLE["warehouse_performance"]


def _over_the_store(name: str, build) -> None:
    """Register a raw query's store-backed form: the same result from the months' partitions."""
    register(f"{name}_stored")(lambda m: build(stored(m)))
    ORACLE[f"{name}_stored"] = ORACLE[name]


_over_the_store("orders_with_short_lines", q_orders_with_short_lines)            # J1
_over_the_store("orders_without_short_lines", q_orders_without_short_lines)      # J2
_over_the_store("order_service_facts", q_order_service_facts)                    # J5
_over_the_store("warehouse_period_comparison", q_warehouse_period_comparison)    # J7
_over_the_store("customer_impact", q_customer_impact)                            # A7
_over_the_store("overview", q_overview)                                          # C1
