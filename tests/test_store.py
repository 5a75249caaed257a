"""The month-partitioned mart store gives the same answers as the raw marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.operators import facts, inventory, policy_rules, quality, service, vendors
from ordersight.sources import store
from ordersight.sources.marts import Marts
from ordersight.sources.store import StoredMarts, _months, write_store

SMOKE = "/root/testdata/sf0.001"
CUR = ("1996-08-01", "1996-08-31")
PREV = ("1996-07-01", "1996-07-31")


def test_months_cover_range():
    assert _months("1996-11-15", "1997-02-01") == ["1996-11", "1996-12", "1997-01", "1997-02"]


def test_store_round_trip_matches_raw_marts(spark, tmp_path):
    raw = Marts(spark, SMOKE)
    stored = StoredMarts(spark, write_store(raw, str(tmp_path / "store")))
    cases = [
        lambda m: service.otif_metrics(m, *CUR),
        lambda m: service.warehouse_performance(m, *CUR),
        lambda m: service.customer_impact(m, *CUR),
        lambda m: service.overview(m, PREV, CUR),
        lambda m: service.monthly_otif(m),
        lambda m: inventory.inventory_below_safety(m, *CUR),
        lambda m: vendors.vendor_performance(m, *CUR),
        lambda m: policy_rules.shortage_runs(m, *CUR),
        lambda m: service.orders_with_short_lines(m, *CUR),
        lambda m: service.orders_without_short_lines(m, *CUR),
    ]
    for case in cases:
        a, b = case(raw), case(stored)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    plans = {"order_month": service.otif_metrics(stored, *CUR), "expected_month": vendors.vendor_month_variance(stored, "1996-08")}
    for part, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan" in x and part in x.split("PartitionFilters")[0]]
        filters = [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines() if "PartitionFilters: [" in x]
        assert sum(part in f and "1996-08" in f for f in filters) >= (2 if part == "order_month" else 1), (scans, filters)


def test_orders_and_line_facts_meet_in_their_buckets(spark, tmp_path, monkeypatch):
    """No exchange on order_id, and one month's partitions read, whichever session opens the store."""
    monkeypatch.setattr(store, "BUCKET_BYTES", 1 << 12)
    raw = Marts(spark, SMOKE)
    path = write_store(raw, str(tmp_path / "store"))
    for name in ("orders", "order_line_facts"):       # as another session would find it
        spark.sql(f"DROP TABLE {store._table_name(path, name)}")
    kept = StoredMarts(spark, path)
    assert spark.read.parquet(f"{path}/layout/orders").first()["buckets"] > 1
    cases = {
        "J1": service.orders_with_short_lines, "J2": service.orders_without_short_lines, "J5": facts.order_facts,
        "A1": service.otif_metrics, "A2": service.warehouse_performance, "A7": service.customer_impact,
        "J7": lambda m, s, e: service.warehouse_period_comparison(m, PREV, (s, e)),
        "C1": lambda m, s, e: service.overview(m, PREV, (s, e))}
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, case in cases.items():
            df = case(kept, *CUR)
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning(order_id" not in plan and "SortMergeJoin" in plan, (name, plan)
            filters = [x.split("PartitionFilters: [")[1].split("]")[0] for x in plan.splitlines() if "PartitionFilters: [" in x]
            pruned = [f for f in filters if "order_month" in f]
            assert len(pruned) == 2 and all("1996-08" in f for f in pruned), (name, filters)
        plan = quality.fk_violations(kept)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(order_id" not in plan
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    for case in (*cases.values(), lambda m, s, e: quality.fk_violations(m)):
        a, b = case(raw, *CUR), case(kept, *CUR)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))


def test_buckets_follow_the_rows(spark, tmp_path, monkeypatch):
    """A task sorts a bucket: packed columns may be few bytes, its rows are what it holds."""
    monkeypatch.setattr(store, "BUCKET_ROWS", 200)
    raw = Marts(spark, SMOKE)
    path = write_store(raw, str(tmp_path / "store"))
    rows = raw.orders.count()
    for name in ("orders", "order_line_facts"):
        buckets = spark.read.parquet(f"{path}/layout/{name}").first()["buckets"]
        assert buckets == -(-rows // 200)
        files = spark.read.parquet(f"{path}/{name}").groupBy(F.regexp_extract(F.input_file_name(), r"_(\d+)\.c000", 1)).count()
        assert max(r["count"] for r in files.collect()) < 2 * 200
    kept = StoredMarts(spark, path)
    for case in (service.orders_with_short_lines, service.warehouse_performance,
                 lambda m, s, e: service.overview(m, PREV, (s, e))):
        a, b = case(raw, *CUR), case(kept, *CUR)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect()))
