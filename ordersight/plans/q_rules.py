"""Registered policy-rule and generator queries and their oracle SQL."""

from __future__ import annotations

from ordersight.operators import policy_rules as R
from ordersight.operators import vendors
from ordersight.plans import params as P
from ordersight.plans.mart_sql import with_marts
from ordersight.plans.q_supply import _vendor_perf_select, _vendor_perf_sql
from ordersight.plans.registry import register
from ordersight.plans.sqlfrag import between, cnt, d, tenths_sql
from ordersight.sources import synth
from ordersight.sources.store import stored

CUR, PREV = P.CURRENT, P.PREVIOUS
ORACLE: dict[str, str] = {}

_POLICY_FACTS = """pf AS (SELECT o.order_id, o.customer_id, o.warehouse_id, o.order_date,
        o.actual_delivery_date IS NOT NULL AND o.actual_delivery_date <= o.requested_delivery_date
        AND NOT EXISTS (SELECT 1 FROM m_order_lines l WHERE l.order_id = o.order_id
                        AND l.quantity_shipped < l.quantity_ordered) AS policy_otif
      FROM m_orders o WHERE {where})"""


def _tier_sql(t: str) -> str:
    return (f"CASE WHEN {t} >= {R.OTIF_TARGET_TENTHS} THEN 'routine monitoring' "
            f"WHEN {t} >= {R.OTIF_REVIEW_TENTHS} THEN 'operations review' "
            f"WHEN {t} >= {R.OTIF_CORRECTIVE_TENTHS} THEN 'escalate to operations manager' "
            f"ELSE 'formal corrective action' END")


@register("otif_policy_tier")
def q_otif_policy_tier(m):
    """Policy OTIF tier per warehouse and month (delivery-only on-time)."""
    return R.otif_policy_tier(m)


ORACLE["otif_policy_tier"] = with_marts("m_orders", "m_order_lines") + ",\n" + _POLICY_FACTS.format(where="TRUE") + f""",
    g AS (SELECT warehouse_id, strftime(order_date, '%Y-%m') AS month, COUNT(*) AS orders,
                 {cnt('policy_otif')} AS otif_orders FROM pf GROUP BY 1, 2)
    SELECT warehouse_id, month, orders, otif_orders, CAST({tenths_sql('otif_orders', 'orders')} AS DOUBLE) / 10.0 AS otif_percentage,
           {_tier_sql(tenths_sql('otif_orders', 'orders'))} AS tier
    FROM g"""


@register("customer_target_gap")
def q_customer_target_gap(m):
    """R2: customer policy OTIF vs max(95 %, own target), current month."""
    return R.customer_target_gap(m, *CUR)


_TT = f"greatest(CAST({R.OTIF_TARGET_TENTHS} AS BIGINT), CAST(round(c.service_level_target * 1000) AS BIGINT))"
ORACLE["customer_target_gap"] = with_marts("m_orders", "m_order_lines", "m_customers") + ",\n" + \
    _POLICY_FACTS.format(where=between("o.order_date", CUR)) + f""",
    g AS (SELECT customer_id, COUNT(*) AS orders, {cnt('policy_otif')} AS otif_orders FROM pf GROUP BY 1)
    SELECT g.customer_id, orders, otif_orders, CAST({tenths_sql('otif_orders', 'orders')} AS DOUBLE) / 10.0 AS otif_percentage,
           CAST({_TT} AS DOUBLE) / 10.0 AS target_percentage,
           CAST({tenths_sql('otif_orders', 'orders')} - {_TT} AS DOUBLE) / 10.0 AS gap_points,
           otif_orders * 1000 >= {_TT} * orders AS meets_target
    FROM g JOIN m_customers c ON c.customer_id = g.customer_id"""

_END = d(CUR[1])


@register("po_escalation_tier")
def q_po_escalation_tier(m):
    """Escalation tier of each late PO by days late."""
    return R.po_escalation_tier(m, *CUR)


ORACLE["po_escalation_tier"] = with_marts("m_purchase_orders") + f""",
    late AS (SELECT po_id, vendor_id, product_id,
                    CAST(CASE WHEN actual_delivery_date > expected_delivery_date THEN actual_delivery_date - expected_delivery_date
                              ELSE {_END} - expected_delivery_date END AS INTEGER) AS days_late
             FROM m_purchase_orders WHERE {between('expected_delivery_date', CUR)}
               AND (actual_delivery_date > expected_delivery_date
                    OR (actual_delivery_date IS NULL AND expected_delivery_date < {_END})))
    SELECT po_id AS purchase_order_id, vendor_id, product_id, days_late,
           CASE WHEN days_late <= 0 THEN 'not late' WHEN days_late <= 2 THEN 'monitor and contact vendor'
                WHEN days_late <= 5 THEN 'formal purchasing escalation'
                WHEN days_late <= 10 THEN 'supply chain leadership escalation'
                ELSE 'critical supplier incident' END AS tier
    FROM late"""


@register("vendor_repeat_failure")
def q_vendor_repeat_failure(m):
    """Rolling 90-day late-PO count per vendor (>= 3 is a repeat failure)."""
    return R.vendor_repeat_failure(m)


ORACLE["vendor_repeat_failure"] = with_marts("m_purchase_orders") + f""",
    daily AS (SELECT vendor_id, expected_delivery_date AS day, COUNT(*) AS late_pos_day FROM m_purchase_orders
              WHERE actual_delivery_date > expected_delivery_date GROUP BY 1, 2),
    r AS (SELECT *, SUM(late_pos_day) OVER (PARTITION BY vendor_id ORDER BY CAST(day - DATE '1970-01-01' AS BIGINT)
                 RANGE BETWEEN {R.REPEAT_FAILURE_WINDOW_DAYS - 1} PRECEDING AND CURRENT ROW) AS w FROM daily)
    SELECT vendor_id, day, late_pos_day, CAST(w AS BIGINT) AS late_pos_90d, w >= {R.REPEAT_FAILURE_LATE_POS} AS repeat_failure
    FROM r"""


@register("consecutive_late")
def q_consecutive_late(m):
    """Two consecutive late deliveries per vendor x product."""
    return R.consecutive_late(m)


ORACLE["consecutive_late"] = with_marts("m_purchase_orders") + """,
    s AS (SELECT po_id, vendor_id, product_id, expected_delivery_date,
                 actual_delivery_date > expected_delivery_date AS late,
                 lag(po_id) OVER w AS previous_po_id,
                 lag(actual_delivery_date > expected_delivery_date) OVER w AS previous_late
          FROM m_purchase_orders
          WINDOW w AS (PARTITION BY vendor_id, product_id ORDER BY expected_delivery_date, po_id))
    SELECT vendor_id, product_id, po_id, previous_po_id, expected_delivery_date FROM s WHERE late AND previous_late"""


@register("inventory_alert_tier")
def q_inventory_alert_tier(m):
    """Available stock below safety (critical below 50 %), current month."""
    return R.inventory_alert_tier(m, *CUR)


ORACLE["inventory_alert_tier"] = with_marts("m_inventory", "m_products") + f"""
    SELECT i.warehouse_id, i.product_id, i.inventory_date, i.quantity_on_hand, i.quantity_allocated,
           i.quantity_on_hand - i.quantity_allocated AS available, p.safety_stock AS safety_stock_target,
           CASE WHEN (i.quantity_on_hand - i.quantity_allocated) * 2 < p.safety_stock THEN 'critical'
                ELSE 'below safety stock' END AS tier
    FROM m_inventory i JOIN m_products p ON p.product_id = i.product_id
    WHERE {between('i.inventory_date', CUR)} AND i.quantity_on_hand - i.quantity_allocated < p.safety_stock"""

_CAL_SQL = with_marts("m_inventory", "m_products", "m_purchase_orders") + f""",
    fst AS (SELECT warehouse_id, product_id, greatest(MIN(inventory_date), {d(CUR[0])}) AS first_date
            FROM m_inventory GROUP BY 1, 2 HAVING MIN(inventory_date) <= {_END}),
    days AS (SELECT warehouse_id, product_id,
                    CAST(unnest(generate_series(first_date, {_END}, INTERVAL 1 DAY)) AS DATE) AS calendar_date FROM fst),
    filled AS (SELECT d.*, i.quantity_on_hand, i.quantity_allocated FROM days d ASOF JOIN m_inventory i
               ON i.warehouse_id = d.warehouse_id AND i.product_id = d.product_id
                  AND i.inventory_date <= d.calendar_date),
    cal AS (SELECT f.warehouse_id, f.product_id, f.calendar_date, f.quantity_on_hand, f.quantity_allocated,
                   f.quantity_on_hand - f.quantity_allocated AS available, p.safety_stock
            FROM filled f JOIN m_products p ON p.product_id = f.product_id)"""
# Runs begin before the month: every day from a pair's first snapshot on, then those that reach the month.
_RUNS_SQL = _CAL_SQL.replace(f"greatest(MIN(inventory_date), {d(CUR[0])})", "MIN(inventory_date)") + f""",
    bd AS (SELECT *, CAST(calendar_date - DATE '1970-01-05' AS BIGINT) AS dd FROM cal
           WHERE isodow(calendar_date) < 6 AND available < safety_stock),
    isl AS (SELECT *, (dd // 7) * 5 + least(dd - (dd // 7) * 7, 5)
                      - row_number() OVER (PARTITION BY warehouse_id, product_id ORDER BY calendar_date) AS island FROM bd),
    runs AS (SELECT warehouse_id, product_id, MIN(calendar_date) AS run_start, MAX(calendar_date) AS run_end,
                    COUNT(*) AS business_days, MIN(available) AS lowest_available, MIN(safety_stock) AS safety_stock_target
             FROM isl GROUP BY warehouse_id, product_id, island
             HAVING COUNT(*) >= {R.SHORTAGE_RUN_BUSINESS_DAYS + 1} AND MAX(calendar_date) >= {d(CUR[0])})"""


@register("synth_inventory_calendar")
def q_synth_inventory_calendar(m):
    """Dense daily inventory calendar (carry-forward) for the current month."""
    return synth.inventory_calendar(m, *CUR)


ORACLE["synth_inventory_calendar"] = _CAL_SQL + " SELECT * FROM cal"


def _draw(salt: str, *keys: str) -> str:
    text = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5({text} || ':{salt}'), 1, 8))::BIGINT % 1000000)"


_SPANS = """,
    ps AS (SELECT product_id, row_number() OVER (ORDER BY product_id) - 1 AS p_rank, COUNT(*) OVER () AS p_n FROM m_products),
    ws AS (SELECT warehouse_id, row_number() OVER (ORDER BY warehouse_id) - 1 AS w_rank, COUNT(*) OVER () AS w_n
           FROM m_warehouses),
    vs AS (SELECT vendor_id, row_number() OVER (ORDER BY vendor_id) - 1 AS v_rank, COUNT(*) OVER () AS v_n FROM m_vendors)"""
_SYNTH = with_marts("m_orders", "m_products", "m_warehouses", "m_vendors") + _SPANS


@register("synth_order_lines")
def q_synth_order_lines(m):
    """1-4 generated order lines per order over all products, hash-derived."""
    return synth.synth_order_lines(m)


ORACLE["synth_order_lines"] = _SYNTH + f""",
    x AS (SELECT order_id, unnest(range(1, {_draw('lines', 'order_id')} % 4 + 2)) AS n FROM m_orders),
    q AS (SELECT *, CAST({_draw('qty', 'order_id', 'n')} % 20 + 1 AS INTEGER) AS qty FROM x)
    SELECT order_id * 10 + n AS order_line_id, order_id,
           product_id, qty AS quantity_ordered,
           CASE WHEN {_draw('short', 'order_id', 'n')} < 80000 THEN CAST(qty * 3 // 5 AS INTEGER) ELSE qty END AS quantity_shipped,
           {_draw('price', 'order_id', 'n')} % 50000 + 500 AS unit_price_cents
    FROM q JOIN ps ON p_rank = {_draw('product', 'order_id', 'n')} % (SELECT COUNT(*) FROM ps)"""


@register("synth_orders")
def q_synth_orders(m):
    """Hash-generated orders (one per order key) over a quarter."""
    return synth.synth_orders(m)


_SYNTH_ORDERS = _SYNTH + f""",
    so AS (SELECT o.order_id, o.customer_id, ws.warehouse_id,
             DATE '2026-07-01' + CAST({_draw('day', 'o.order_id')} % 92 AS INTEGER) AS od
           FROM m_orders o JOIN ws ON w_rank = {_draw('wh', 'o.order_id')} % (SELECT COUNT(*) FROM ws)),
    rq AS (SELECT *, od + CAST(1 + {_draw('ship', 'order_id')} % 2 AS INTEGER) AS rs,
                     od + CAST(3 + {_draw('del', 'order_id')} % 4 AS INTEGER) AS rd,
                     {_draw('open', 'order_id')} < 150000 AS fl FROM so),
    ord AS (SELECT order_id, customer_id, warehouse_id, od AS order_date, rs AS requested_ship_date,
             rs + CAST(CASE WHEN {_draw('sd', 'order_id')} < 800000 THEN 0 ELSE {_draw('sd2', 'order_id')} % 3 + 1 END AS INTEGER)
               AS actual_ship_date, rd AS requested_delivery_date,
             CASE WHEN NOT fl THEN rd + CAST(CASE WHEN {_draw('dd', 'order_id')} < 700000 THEN 0
               ELSE {_draw('dd2', 'order_id')} % 4 + 1 END AS INTEGER) END AS actual_delivery_date,
             CASE WHEN fl THEN 'partially_fulfilled' ELSE 'delivered' END AS order_status FROM rq)"""
ORACLE["synth_orders"] = _SYNTH_ORDERS + " SELECT * FROM ord"


@register("synth_shipments")
def q_synth_shipments(m):
    """One generated shipment per generated order."""
    return synth.synth_shipments(m)


ORACLE["synth_shipments"] = _SYNTH_ORDERS + f"""
    SELECT order_id AS shipment_id, order_id,
           CASE {_draw('carrier', 'order_id')} % 4 WHEN 0 THEN 'North Freight' WHEN 1 THEN 'Summit Parcel'
                WHEN 2 THEN 'Harbor Lines' ELSE 'Prairie Transport' END AS carrier,
           actual_ship_date AS ship_date, actual_delivery_date AS delivery_date,
           {_draw('cost', 'order_id')} % 11000 + 1800 AS shipping_cost_cents,
           CASE order_status WHEN 'delivered' THEN 'delivered' ELSE 'partially_delivered' END AS shipment_status
    FROM ord"""


@register("synth_purchase_orders")
def q_synth_purchase_orders(m):
    """Generated replenishments per product, with the late August receipts of critical products."""
    return synth.synth_purchase_orders(m)


ORACLE["synth_purchase_orders"] = _SYNTH + f""",
    x AS (SELECT product_id, unnest(range(1, CASE WHEN product_id % 5 = 0 THEN 5 ELSE 4 END)) AS slot FROM m_products),
    e AS (SELECT *, CASE WHEN slot = 4 THEN DATE '2026-08-05' + CAST(product_id % 4 AS INTEGER)
                         ELSE DATE '2026-07-15' + CAST(product_id % 10 AS INTEGER) END AS expected,
                 CAST({_draw('qty', 'product_id', 'slot')} % 161 + 150 AS INTEGER) AS qty FROM x)
    SELECT product_id * 10 + slot AS po_id, vendor_id, product_id, warehouse_id, expected - 12 AS order_date,
           expected AS expected_delivery_date,
           CASE WHEN slot = 4 THEN DATE '2026-08-27' + CAST(product_id % 3 AS INTEGER)
                ELSE expected + CAST({_draw('delay', 'product_id', 'slot')} % 3 AS INTEGER) END AS actual_delivery_date,
           qty AS quantity_ordered, qty AS quantity_received
    FROM e JOIN vs ON v_rank = {_draw('vendor', 'product_id')} % (SELECT COUNT(*) FROM vs)
           JOIN ws ON w_rank = {_draw('site', 'product_id', 'slot')} % (SELECT COUNT(*) FROM ws)"""


@register("synth_inventory")
def q_synth_inventory(m):
    """A generated snapshot a day of every product at every site, for the eight days around the 7th of August,
    when the shortage begins."""
    return synth.synth_inventory(m, "2026-08-03", 8)


# The level is the running sum less its lowest value so far, if that is below zero.
ORACLE["synth_inventory"] = _SYNTH + f""",
    pw AS (SELECT ps.product_id, p.safety_stock, ws.warehouse_id, w_rank, (p_rank * w_n + w_rank) * 1000 AS base,
             CAST(floor(p.safety_stock * (155 + {_draw('open', 'ps.product_id', 'ws.warehouse_id')} % 90) / 100.0) AS BIGINT) AS opening,
             {_draw('share', 'ps.product_id', 'ws.warehouse_id')} % 25 + 26 AS share,
             {_draw('alloc', 'ps.product_id', 'ws.warehouse_id')} % 22 + 15 AS alloc
           FROM ps JOIN m_products p USING (product_id) CROSS JOIN ws),
    dy AS (SELECT *, unnest(range(0, 8)) AS dd FROM pw),
    mv AS (SELECT *, ('0x' || substr(md5(product_id || ':' || warehouse_id || ':stock' || (dd // 8)), (dd % 8) * 4 + 1, 4))::BIGINT
             % 41 - 20 AS move FROM dy),
    pf AS (SELECT *, opening + SUM(move) OVER (PARTITION BY base ORDER BY dd) AS total FROM mv),
    lv AS (SELECT *, total - least(0, MIN(total) OVER (PARTITION BY base ORDER BY dd)) AS level FROM pf),
    oh AS (SELECT *, CAST(CASE WHEN product_id % 5 = 0 AND w_rank = 1 AND dd >= 4
                     THEN least(level, floor(safety_stock * share / 100.0)) ELSE level END AS INTEGER) AS q FROM lv)
    SELECT base + dd AS inventory_id, warehouse_id, product_id, DATE '2026-08-03' + CAST(dd AS INTEGER) AS inventory_date,
           q AS quantity_on_hand, CAST(floor(q * alloc / 100.0) AS INTEGER) AS quantity_allocated
    FROM oh"""


def _month_runs(m):
    """The runs that touch the current month: one month of the store and the stock state at its first day, which is
    rolled forward from that of the month before."""
    kept = stored(m)
    return R.shortage_runs(kept, *CUR, state=kept.stock_state(CUR[0], first=PREV[0]))


@register("shortage_runs")
def q_shortage_runs(m):
    """> 3 consecutive business days below safety on available stock."""
    return _month_runs(m)


ORACLE["shortage_runs"] = _RUNS_SQL + " SELECT * FROM runs"


@register("shortage_exceptions")
def q_shortage_exceptions(m):
    """Shortage exception records with the SKU's open PO count."""
    return R.shortage_exceptions(_month_runs(m), m)


ORACLE["shortage_exceptions"] = _RUNS_SQL + """,
    op AS (SELECT product_id, COUNT(*) AS open_po_count FROM m_purchase_orders WHERE actual_delivery_date IS NULL GROUP BY 1)
    SELECT r.warehouse_id, r.product_id, r.run_start AS first_date_below, r.business_days, r.lowest_available,
           r.safety_stock_target, COALESCE(op.open_po_count, 0) AS open_po_count
    FROM runs r LEFT JOIN op ON op.product_id = r.product_id"""


@register("vendor_target_gap")
def q_vendor_target_gap(m):
    """Vendor on-time % vs the vendor's target, current month."""
    return R.vendor_target_gap(vendors.vendor_performance(m, *CUR), m)


ORACLE["vendor_target_gap"] = _vendor_perf_sql() + f""",
    perf AS ({_vendor_perf_select()})
    SELECT p.vendor_id, p.vendor_name, p.purchase_orders, p.on_time_deliveries, p.on_time_percentage,
           CAST(CAST(round(v.target_ontime_percentage * 1000) AS BIGINT) AS DOUBLE) / 10.0 AS target_percentage,
           CAST({tenths_sql('p.on_time_deliveries', 'p.purchase_orders')}
                - CAST(round(v.target_ontime_percentage * 1000) AS BIGINT) AS DOUBLE) / 10.0 AS gap_points,
           p.on_time_deliveries * 1000 >= CAST(round(v.target_ontime_percentage * 1000) AS BIGINT) * p.purchase_orders
             AS meets_target
    FROM perf p JOIN m_vendors v ON v.vendor_id = p.vendor_id WHERE p.purchase_orders > 0"""
