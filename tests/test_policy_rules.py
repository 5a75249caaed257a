"""Policy-rule operators on literal fixtures (R1, R3-R6, R8, R9 and trap T8)."""

from __future__ import annotations

import datetime as dt
import random

from conftest import CUSTOMERS, PRODUCTS, VENDORS, WAREHOUSES, D
from pyspark.sql import functions as F

from ordersight.operators import policy_rules as R
from ordersight.operators import service, vendors
from ordersight.plans import q_rules


def test_policy_on_time_is_delivery_only(fixture_marts):
    # shipped late but delivered on time: governed OTIF no, policy OTIF yes
    o = [(1, 1, 1, D("2026-08-10"), D("2026-08-11"), D("2026-08-13"), D("2026-08-14"), D("2026-08-14"), "delivered")]
    m = fixture_marts(orders=o, warehouses=WAREHOUSES, customers=CUSTOMERS)
    assert service.otif_metrics(m, "2026-08-01", "2026-08-31").first().otif_orders == 0
    tier = R.otif_policy_tier(m).first()
    assert tier.otif_orders == 1 and tier.tier == "routine monitoring"


def test_otif_tiers_at_boundaries(spark):
    df = spark.createDataFrame([(950,), (949,), (900,), (899,), (800,), (799,)], "t long")
    got = [r.x for r in df.select(R.otif_tier(F.col("t")).alias("x")).collect()]
    assert got == ["routine monitoring", "operations review", "operations review",
                   "escalate to operations manager", "escalate to operations manager", "formal corrective action"]


def test_escalation_tiers(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (5,), (6,), (10,), (11,)], "d int")
    got = [r.x for r in df.select(R.escalation_tier(F.col("d")).alias("x")).collect()]
    assert got == ["monitor and contact vendor"] * 2 + ["formal purchasing escalation"] * 2 + \
        ["supply chain leadership escalation"] * 2 + ["critical supplier incident"]


def po(pid, vendor, product, exp, act):
    return (pid, vendor, product, 1, D(exp) - dt.timedelta(days=20), D(exp), None if act is None else D(act), 5, 5)


def test_repeat_failure_rolling_90_days(fixture_marts):
    pos = [po(1, 1, 1, "2026-01-10", "2026-01-12"), po(2, 1, 2, "2026-02-10", "2026-02-11"),
           po(3, 1, 3, "2026-04-09", "2026-04-10"), po(4, 1, 4, "2026-04-20", "2026-04-22")]
    m = fixture_marts(purchase_orders=pos, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    rows = {r.day: r for r in R.vendor_repeat_failure(m).collect()}
    assert rows[D("2026-04-09")].late_pos_90d == 3 and rows[D("2026-04-09")].repeat_failure   # Jan 10 is day -89
    assert rows[D("2026-04-20")].late_pos_90d == 3                                          # Jan 10 dropped


def test_consecutive_late_per_vendor_product(fixture_marts):
    pos = [po(1, 1, 1, "2026-03-01", "2026-03-03"), po(2, 1, 1, "2026-03-05", "2026-03-04"),
           po(3, 1, 1, "2026-03-09", "2026-03-12"), po(4, 1, 1, "2026-03-09", "2026-03-15"),
           po(5, 2, 1, "2026-03-10", "2026-03-20")]
    m = fixture_marts(purchase_orders=pos, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    got = [(r.po_id, r.previous_po_id) for r in R.consecutive_late(m).collect()]
    assert got == [(4, 3)]
    assert R.consecutive_late(m, critical_products=[2]).count() == 0


def test_available_stock_tiers_and_exceptions(fixture_marts):
    inv = [(1, 1, D("2026-08-03"), 30, 25, ), (1, 2, D("2026-08-03"), 30, 15)]   # safety 20: available 5 and 15
    m = fixture_marts(inventory=inv, products=PRODUCTS, warehouses=WAREHOUSES,
                      purchase_orders=[po(9, 1, 1, "2026-09-01", None)], vendors=VENDORS)
    tiers = {r.product_id: r.tier for r in R.inventory_alert_tier(m, "2026-08-01", "2026-08-31").collect()}
    assert tiers == {1: "critical", 2: "below safety stock"}
    runs = R.shortage_runs(m, "2026-08-01", "2026-08-31")
    ex = {r.product_id: r for r in R.shortage_exceptions(runs, m).collect()}
    assert ex[1].open_po_count == 1 and ex[2].open_po_count == 0 and ex[1].lowest_available == 5
    assert ex[1].first_date_below == D("2026-08-03")


def test_shortage_runs_reach_back_before_the_month(fixture_marts):
    rng = random.Random(4)
    # Product 1: below from 10 June, recovered on 4 August (a run of 1 business day in the month), lowest in July.
    stock = {(1, D("2026-05-01")): 50, (1, D("2026-06-10")): 9, (1, D("2026-07-06")): 3, (1, D("2026-07-20")): 12,
             (1, D("2026-08-04")): 60}
    for p in range(2, 11):
        for day in rng.sample(range(150), 25):
            stock[p, D("2026-04-15") + dt.timedelta(days=day)] = rng.choice((5, 12, 18, 19, 20, 45))
    m = fixture_marts(inventory=[(1, p, day, n, 0) for (p, day), n in stock.items()], products=PRODUCTS,
                      warehouses=WAREHOUSES, vendors=VENDORS)
    want = []
    for p in range(1, 11):
        run, now, day = [], None, D("2026-04-15")
        while day <= D("2026-09-01"):
            now = stock.get((p, day), now)
            if day.weekday() < 5:
                if day <= D("2026-08-31") and now is not None and now < 20:
                    run.append((day, now))
                else:
                    if len(run) > 3 and run[-1][0] >= D("2026-08-01"):
                        want.append((p, run[0][0], run[-1][0], len(run), min(n for _, n in run)))
                    run = []
            day += dt.timedelta(days=1)
    assert want[0] == (1, D("2026-06-10"), D("2026-08-03"), 39, 3)
    runs = R.shortage_runs(m, "2026-08-01", "2026-08-31")
    got = sorted((r.product_id, r.run_start, r.run_end, r.business_days, r.lowest_available) for r in runs.collect())
    assert got == want
    assert R.shortage_exceptions(runs, m).filter("product_id = 1").first().first_date_below == D("2026-06-10")


def test_registered_shortage_queries_are_not_clipped(fixture_marts):
    inv = [(1, 1, D("1996-05-01"), 50, 0), (1, 1, D("1996-07-01"), 5, 0), (1, 1, D("1996-08-02"), 50, 0)]
    m = fixture_marts(inventory=inv, products=PRODUCTS, warehouses=WAREHOUSES, vendors=VENDORS)
    r = q_rules.q_shortage_runs(m).first()
    assert (r.run_start, r.run_end, r.business_days) == (D("1996-07-01"), D("1996-08-01"), 24)
    assert q_rules.q_shortage_exceptions(m).first().first_date_below == D("1996-07-01")


def test_vendor_target_gap_exact(fixture_marts):
    pos = [po(i, 1, 1, "2026-08-10", "2026-08-10" if i <= 19 else "2026-08-12") for i in range(1, 21)]
    m = fixture_marts(purchase_orders=pos, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES)
    g = R.vendor_target_gap(vendors.vendor_performance(m, "2026-08-01", "2026-08-31"), m).first()
    assert (g.on_time_percentage, g.target_percentage, g.gap_points, g.meets_target) == (95.0, 95.0, 0.0, True)
