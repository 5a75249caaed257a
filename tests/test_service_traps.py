"""Service-query traps T1, T2, T4, T5, T6, T9 on literal fixtures."""

from __future__ import annotations

from conftest import CUSTOMERS, WAREHOUSES, D

from ordersight.operators import service, summaries

RANGE = ("2026-08-01", "2026-08-31")


def order(oid, wh=1, cust=1, day="2026-08-10", ship_late=0, deliv_late=0, ship_null=False, deliv_null=False):
    od = D(day)
    rs, rd = D("2026-08-11") if day == "2026-08-10" else od, D("2026-08-14") if day == "2026-08-10" else od
    import datetime as dt
    as_ = None if ship_null else rs + dt.timedelta(days=ship_late)
    ad = None if deliv_null else rd + dt.timedelta(days=deliv_late)
    return (oid, cust, wh, od, rs, as_, rd, ad, "delivered")


def line(lid, oid, qty=10, shipped=10, price=1000):
    return (lid, oid, 1, qty, shipped, price)


def test_zero_line_order_strict_vs_lenient(fixture_marts):
    m = fixture_marts(orders=[order(1)], warehouses=WAREHOUSES, customers=CUSTOMERS)
    a1 = service.otif_metrics(m, *RANGE).first()
    assert (a1.total_orders, a1.on_time_orders, a1.in_full_orders, a1.otif_orders) == (1, 1, 0, 0)
    a7 = service.customer_impact(m, *RANGE).first()
    assert a7.otif_percentage == 100.0 and a7.estimated_affected_revenue == 0.0
    a8 = service.monthly_otif(m).first()
    assert a8.otif_orders == 1


def test_null_actual_dates_are_late(fixture_marts):
    m = fixture_marts(orders=[order(1, deliv_null=True)], order_lines=[line(1, 1)], warehouses=WAREHOUSES)
    a1 = service.otif_metrics(m, *RANGE).first()
    assert a1.on_time_orders == 0
    w = {r.warehouse_id: r for r in service.warehouse_performance(m, *RANGE).collect()}
    assert w[1].late_order_count == 1


def test_rounding_half_up_tenths(fixture_marts):
    # 1 of 8 on time = 12.5 %; 49 of 400 = 12.25 % -> 12.3
    orders8 = [order(i, deliv_late=0 if i == 1 else 2) for i in range(1, 9)]
    m = fixture_marts(orders=orders8, warehouses=WAREHOUSES)
    assert service.otif_metrics(m, *RANGE).first().on_time_percentage == 12.5
    orders400 = [order(i, deliv_late=0 if i <= 49 else 2) for i in range(1, 401)]
    m = fixture_marts(orders=orders400, warehouses=WAREHOUSES)
    assert service.otif_metrics(m, *RANGE).first().on_time_percentage == 12.3


def test_empty_range_gives_zeros_not_nulls(fixture_marts):
    m = fixture_marts(orders=[order(1)], warehouses=WAREHOUSES)
    a1 = service.otif_metrics(m, "2020-01-01", "2020-01-31").first()
    assert a1.total_orders == 0 and a1.otif_percentage == 0.0


def test_idle_warehouse_zeros_and_is_lowest(fixture_marts):
    m = fixture_marts(orders=[order(1), order(2, wh=2)], order_lines=[line(1, 1), line(2, 2)],
                      warehouses=WAREHOUSES, customers=CUSTOMERS)
    rows = {r.warehouse_id: r for r in service.warehouse_performance(m, *RANGE).collect()}
    assert rows[3].total_orders == 0 and rows[3].otif_percentage == 0.0 and rows[3].late_order_count == 0
    s = {r.tool: r.summary for r in summaries.tool_summaries(m, *RANGE).collect()}
    assert s["get_warehouse_performance"] == "3 warehouses; lowest OTIF is Idle (0%)."


def test_customer_impact_inner_join_and_whole_order_revenue(fixture_marts):
    # order 1: one short line of two -> affected, revenue counts both lines
    m = fixture_marts(orders=[order(1)], order_lines=[line(1, 1, 10, 5, 1000), line(2, 1, 2, 2, 250)],
                      warehouses=WAREHOUSES, customers=CUSTOMERS)
    rows = service.customer_impact(m, *RANGE).collect()
    assert [r.customer_id for r in rows] == [1]
    assert rows[0].estimated_affected_revenue == 105.0
    assert rows[0].partial_orders == 1


def test_tie_decline_lower_id_wins(fixture_marts):
    prev = ("2026-07-01", "2026-07-31")
    orders = [order(1, wh=1, day="2026-07-10"), order(2, wh=2, day="2026-07-10"),
              order(3, wh=1, deliv_late=3), order(4, wh=2, deliv_late=3)]
    m = fixture_marts(orders=orders, order_lines=[line(i, i) for i in range(1, 5)], warehouses=WAREHOUSES)
    dec = service.largest_warehouse_decline(m, prev, RANGE).first()
    assert dec.warehouse_id == 1 and dec.change_points == -100.0
    ov = service.overview(m, prev, RANGE).first()
    assert ov.largest_decline_warehouse_id == 1 and ov.month_over_month_change == -100.0


def test_exists_form_equals_preaggregate_form(spark, fixture_marts):
    orders = [order(i, deliv_late=i % 3) for i in range(1, 30)]
    lines = [line(10 * i + j, i, 10, 10 - (i + j) % 4, 100) for i in range(1, 30) for j in range(i % 3)]
    m = fixture_marts(orders=orders, order_lines=lines, warehouses=WAREHOUSES)
    m.orders.createOrReplaceTempView("fx_orders")
    m.order_lines.createOrReplaceTempView("fx_lines")
    sql = spark.sql("""
      SELECT COUNT(*) t, SUM(CASE WHEN EXISTS (SELECT 1 FROM fx_lines l WHERE l.order_id = o.order_id)
          AND NOT EXISTS (SELECT 1 FROM fx_lines l WHERE l.order_id = o.order_id
                          AND l.quantity_shipped < l.quantity_ordered) THEN 1 ELSE 0 END) f
      FROM fx_orders o""").first()
    a1 = service.otif_metrics(m, *RANGE).first()
    assert (a1.total_orders, a1.in_full_orders) == (sql.t, sql.f)
