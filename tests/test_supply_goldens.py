"""Inventory / vendor goldens derived from the reference generator."""

from __future__ import annotations

import datetime as dt

from conftest import PRODUCTS, VENDORS, WAREHOUSES, D

from ordersight.operators import inventory, policy_rules, vendors
from ordersight.plans.catalog import run_tool

AUG = ("2026-08-01", "2026-08-31")


def vendor4_pos():
    """POs of vendor 4, warehouse 2, product p = 1..10: expected Aug (5 + p%4), actual Aug (27 + p%3)."""
    return [(p, 4, p, 2, D("2026-07-01"), dt.date(2026, 8, 5 + p % 4), dt.date(2026, 8, 27 + p % 3), 100, 100)
            for p in range(1, 11)]


def test_vendor4_august_golden_and_idle_vendor(fixture_marts):
    m = fixture_marts(purchase_orders=vendor4_pos(), vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    rows = {r.vendor_id: r for r in vendors.vendor_performance(m, *AUG).collect()}
    v4 = rows[4]
    assert (v4.purchase_orders, v4.on_time_deliveries, v4.late_deliveries) == (10, 0, 10)
    assert v4.on_time_percentage == 0.0 and v4.average_days_late == 21.5
    assert rows[10].purchase_orders == 0 and rows[10].average_days_late == 0.0
    detail = vendors.late_purchase_orders(m, *AUG).orderBy("product_id").collect()
    assert [r.days_late for r in detail] == [22, 22, 19, 23, 23, 20, 20, 24, 21, 21]
    assert run_tool(m, "get_vendor_performance", startDate=AUG[0], endDate=AUG[1], vendorId=4).count() == 1


def test_open_po_edges_and_lookahead(fixture_marts):
    end = D("2026-08-31")
    pos = [(1, 1, 1, 1, end, end - dt.timedelta(days=1), None, 5, 0),          # open, due before end -> late
           (2, 1, 1, 1, end, end, None, 5, 0),                                 # open, due on end -> neither
           (3, 1, 1, 1, end, D("2026-08-30"), D("2026-09-10"), 5, 5)]          # delivered after end -> late
    m = fixture_marts(purchase_orders=pos, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    v1 = [r for r in vendors.vendor_performance(m, *AUG).collect() if r.vendor_id == 1][0]
    assert (v1.purchase_orders, v1.on_time_deliveries, v1.late_deliveries) == (3, 0, 2)
    # days late: open one 1 day (to end), delivered one 11 days -> average 6.0
    assert v1.average_days_late == 6.0


def test_early_and_late_po_average_and_signed_variance(fixture_marts):
    e = D("2026-08-10")
    pos = [(1, 1, 1, 1, e, e, e - dt.timedelta(days=2), 5, 5), (2, 1, 1, 1, e, e, e + dt.timedelta(days=3), 5, 5)]
    m = fixture_marts(purchase_orders=pos, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    v1 = [r for r in vendors.vendor_performance(m, *AUG).collect() if r.vendor_id == 1][0]
    assert v1.average_days_late == 3.0
    var = vendors.vendor_month_variance(m, "2026-08").first()
    assert var.average_days_vs_expected == 0.5 and var.late_orders == 1


def august_inventory():
    rows = []
    for p in range(1, 11):
        for day in range(1, 32):
            below = 7 <= day <= 26
            rows.append((2, p, dt.date(2026, 8, day), 5 if below else 50, 0))
            rows.append((1, p, dt.date(2026, 8, day), 50, 0))
    return rows


def test_august_below_safety_golden(fixture_marts):
    m = fixture_marts(inventory=august_inventory(), products=PRODUCTS, warehouses=WAREHOUSES)
    s = inventory.inventory_health(m, *AUG).first()
    assert (s.products_below_safety_stock, s.number_of_days_below_safety_stock, s.lowest_quantity_on_hand) == (10, 200, 5)
    span = inventory.warehouse_below_safety_span(m, *AUG).collect()
    assert [(r.warehouse_id, r.products_below_safety, r.first_date, r.last_date) for r in span] == \
        [(2, 10, D("2026-08-07"), D("2026-08-26"))]
    empty = inventory.inventory_health(m, "2026-08-01", "2026-08-05").first()
    assert empty.products_below_safety_stock == 0 and empty.lowest_quantity_on_hand is None


def test_shortage_runs_business_days(fixture_marts):
    m = fixture_marts(inventory=august_inventory(), products=PRODUCTS, warehouses=WAREHOUSES)
    runs = policy_rules.shortage_runs(m, *AUG).collect()
    assert len(runs) == 10
    r = runs[0]
    # 7-26 Aug 2026 holds 14 business days (7 Aug is a Friday)
    assert (r.run_start, r.run_end, r.business_days) == (D("2026-08-07"), D("2026-08-26"), 14)
    # a holiday inside the run removes one business day but does not break the run
    runs_h = policy_rules.shortage_runs(m, *AUG, holidays=["2026-08-12"]).collect()
    assert {x.business_days for x in runs_h} == {13}


def test_vendor_scorecard_nested_pages_hold_every_child_in_order(fixture_marts):
    """Vendor 4's ten late POs (plus an open one) nested in pages of 3,
    in actual-date-desc / nulls-last / id order; idle vendors keep one empty page."""
    pos = vendor4_pos() + [(11, 4, 3, 2, D("2026-07-01"), D("2026-08-02"), None, 100, 0)]
    m = fixture_marts(purchase_orders=pos, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    rows = vendors.vendor_scorecard_nested(m, *AUG, page_size=3).collect()
    v4 = sorted((r for r in rows if r.vendor_id == 4), key=lambda r: r.page)
    assert [r.page for r in v4] == [0, 1, 2, 3]
    assert [r.late_deliveries for r in v4] == [11, None, None, None]      # counts once per vendor
    assert all(len(r.late_purchase_orders) <= 3 and len(r.products_affected) <= 3 for r in v4)
    got = [po.purchase_order_id for r in v4 for po in r.late_purchase_orders]
    flat = vendors.late_purchase_orders(m, *AUG).collect()
    want = [r.purchase_order_id for r in sorted(
        flat, key=lambda r: (r.actual_delivery_date is None, -(r.actual_delivery_date or D("1970-01-01")).toordinal(),
                             r.purchase_order_id))]
    assert got == want and got[-1] == 11
    assert [po.position for r in v4 for po in r.late_purchase_orders] == list(range(1, 12))
    prods = [(p.product_id, p.late_purchase_orders) for r in v4 for p in r.products_affected]
    assert prods == [(3, 2)] + [(p, 1) for p in (1, 2, 4, 5, 6, 7, 8, 9, 10)]
    idle = [r for r in rows if r.vendor_id == 10]
    assert len(idle) == 1 and idle[0].page == 0
    assert idle[0].late_purchase_orders == [] and idle[0].products_affected == []


def test_public_shape_camel_cases_columns_and_nested_fields(fixture_marts):
    """Public camelCase names, also inside the scorecard's nested pages."""
    from ordersight.plans.catalog import public_shape
    m = fixture_marts(purchase_orders=vendor4_pos(), vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    vp = run_tool(m, "get_vendor_performance", public=True, startDate=AUG[0], endDate=AUG[1], vendorId=4)
    assert vp.columns == ["vendorId", "vendorName", "purchaseOrders", "onTimeDeliveries", "lateDeliveries",
                          "onTimePercentage", "averageDaysLate"]
    assert vp.first().averageDaysLate == 21.5
    sc = public_shape(vendors.vendor_scorecard_nested(m, *AUG))
    assert "latePurchaseOrders" in sc.columns and "productsAffected" in sc.columns
    v4 = [r for r in sc.collect() if r.vendorId == 4][0]
    assert v4.latePurchaseOrders[0].purchaseOrderId is not None and v4.latePurchaseOrders[0].daysLate > 0
    assert v4.productsAffected[0].latePurchaseOrders == 1
