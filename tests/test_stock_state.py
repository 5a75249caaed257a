"""Stock state: rolled forward it equals the history, and a month's query reads a month."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import PRODUCTS, VENDORS, WAREHOUSES, D

from ordersight.operators import policy_rules as R
from ordersight.operators import stock
from ordersight.sources import synth
from ordersight.sources.store import stored

HOLIDAYS = ["2026-07-03", "2026-07-04", "2026-08-03", "2026-08-03", "2026-08-31"]


def snapshots(seed, days=150, each=25):
    rng = random.Random(seed)
    out = {}
    for p in range(1, 11):
        for day in rng.sample(range(days), each if p > 1 else 2):
            out[p, D("2026-04-15") + dt.timedelta(days=day)] = rng.choice((5, 12, 18, 19, 20, 45))
    return [(1, p, day, n + 3, 3) for (p, day), n in out.items()]


def plain_runs(rows, start, end, holidays, least=4):
    held = {(p, day): a - b for _, p, day, a, b in rows}
    want = []
    for p in range(1, 11):
        run, now, day = [], None, D("2026-04-01")
        while day <= end + dt.timedelta(days=10):
            now = held.get((p, day), now) if day <= end else None
            if day.weekday() < 5 and day not in holidays:
                if now is not None and now < 20:
                    run.append((day, now))
                else:
                    if len(run) >= least and run[-1][0] >= start:
                        want.append((p, run[0][0], run[-1][0], len(run), min(n for _, n in run)))
                    run = []
            day += dt.timedelta(days=1)
    return want


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("holidays", [[], HOLIDAYS])
def test_rolled_state_equals_the_history(fixture_marts, seed, holidays):
    rows = snapshots(seed)
    m = fixture_marts(inventory=rows, products=PRODUCTS, warehouses=WAREHOUSES, vendors=VENDORS)
    kept = stored(m)
    month = ("2026-08-01", "2026-08-31")
    state = kept.stock_state(month[0], first="2026-05-01", holidays=holidays)     # May, June, July are rolled forward
    direct = stock.state_at(m, month[0], holidays=holidays)
    key = lambda df: sorted(map(tuple, df.select(*stock.STATE).collect()))
    assert key(state) == key(direct)
    want = plain_runs(rows, D(month[0]), D(month[1]), {D(h) for h in holidays})
    for got in (R.shortage_runs(m, *month, holidays=holidays), R.shortage_runs(kept, *month, state, holidays)):
        assert sorted((r.product_id, r.run_start, r.run_end, r.business_days, r.lowest_available)
                      for r in got.collect()) == want
    assert len(want) > 0
    assert sorted(map(tuple, synth.inventory_calendar(m, *month).collect())) == \
        sorted(map(tuple, synth.inventory_calendar(kept, *month, state).collect()))


def test_a_month_reads_one_month_and_one_state(fixture_marts):
    m = fixture_marts(inventory=snapshots(7), products=PRODUCTS, warehouses=WAREHOUSES, vendors=VENDORS)
    kept = stored(m)
    runs = R.shortage_runs(kept, "2026-08-01", "2026-08-31", kept.stock_state("2026-08-01"))
    files = runs.inputFiles()
    read = {f.split("inventory_month=")[1].split("/")[0] for f in files if "inventory_month=" in f}
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "inventory_month IN (2026-08)" in plan or "inventory_month#" in plan and "= 2026-08)" in plan
    assert not any("as_of=" in f and "as_of=2026-08-01" not in f for f in files) and read
    with pytest.raises(ValueError):
        kept.stock_state("2026-08-02")


def test_state_carries_on_without_snapshots(fixture_marts):
    rows = [(1, 1, D("2026-06-30"), 5, 0), (1, 2, D("2026-06-01"), 50, 0)]
    m = fixture_marts(inventory=rows, products=PRODUCTS, warehouses=WAREHOUSES, vendors=VENDORS)
    state = stored(m).stock_state("2026-09-01", first="2026-07-01")
    got = {r.product_id: r for r in state.collect()}
    assert (got[1].run_start, got[1].run_end, got[1].run_days, got[1].run_lowest) == (D("2026-06-30"), D("2026-08-31"), 45, 5)
    assert got[2].quantity_on_hand == 50 and got[2].run_days is None


def test_a_state_shuffles_its_spans_once(spark, fixture_marts):
    """Every span is dealt once, by product; only the products are dealt to meet them."""
    m = fixture_marts(inventory=snapshots(4), products=PRODUCTS, warehouses=WAREHOUSES, vendors=VENDORS)
    kept = stored(m)
    state = kept.stock_state("2026-08-01", first="2026-07-01")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for df in (stock.state_at(m, "2026-08-01"), stock.state_at(kept, "2026-09-01", "2026-08-01", state),
                   R.shortage_runs(kept, "2026-08-01", "2026-08-31", state)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(product_id") == 2 == plan.count("Exchange "), plan
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_products_that_are_not_known_keep_their_quantities(fixture_marts):
    rows = [(1, 1, D("2026-06-30"), 5, 0), (1, 99, D("2026-06-01"), 4, 1), (1, 99, D("2026-06-09"), 3, 2), (2, 1, D("2026-06-27"), 7, 2)]
    m = fixture_marts(inventory=rows, products=PRODUCTS, warehouses=WAREHOUSES, vendors=VENDORS)
    got = {(r.warehouse_id, r.product_id): tuple(r)[2:] for r in stock.state_at(m, "2026-07-01").collect()}
    assert got[1, 99] == (3, 2, None, None, None, None)
    assert got[1, 1] == (5, 0, D("2026-06-30"), D("2026-06-30"), 1, 5)
    assert got[2, 1] == (7, 2, D("2026-06-29"), D("2026-06-30"), 2, 5)
