"""Invariants the source application asserts on its own queries, checked on
the sf0.01 test tables (filter consistency, detail count = late count, ...)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ordersight.operators import embed, inventory, search, service, vendors
from ordersight.plans.catalog import run_tool
from ordersight.sources.marts import Marts

SF = "/root/testdata/sf0.01"
CUR = ("1996-08-01", "1996-08-31")


@pytest.fixture(scope="module")
def m(spark):
    return Marts(spark, SF)


def test_warehouse_filter_total_equals_warehouse_row(m):
    rows = {r.warehouse_id: r.total_orders for r in service.warehouse_performance(m, *CUR).collect()}
    for wh in (1, 5, 24):
        assert service.otif_metrics(m, *CUR, warehouse_id=wh).first().total_orders == rows[wh]
    assert sum(rows.values()) == service.otif_metrics(m, *CUR).first().total_orders


def test_product_filter_gives_one_product(m):
    some = inventory.inventory_below_safety(m, *CUR).select("product_id").first().product_id
    assert inventory.inventory_below_safety(m, *CUR, product_id=some).select("product_id").distinct().count() == 1


def test_late_detail_count_equals_late_count_and_vendor_filter(m):
    late = {r.vendor_id: r.late_deliveries for r in vendors.vendor_performance(m, *CUR).collect()}
    detail = {r.vendor_id: r["count"] for r in vendors.late_purchase_orders(m, *CUR).groupBy("vendor_id").count().collect()}
    assert {k: v for k, v in late.items() if v} == detail
    assert run_tool(m, "get_vendor_performance", startDate=CUR[0], endDate=CUR[1], vendorId=4).count() == 1


def test_revenue_non_negative_and_rows_match_fields(m):
    ci = service.customer_impact(m, *CUR)
    assert ci.filter(F.col("estimated_affected_revenue") < 0).count() == 0
    assert ci.filter(F.col("late_orders") > F.col("total_orders")).count() == 0


def test_single_query_policy_search(spark):
    docs = spark.createDataFrame([(1, "late vendor deliveries escalate"), (2, "inventory safety stock review"),
                                  (3, "customer shipping service levels")], "id long, text string")
    emb = embed.HashingEmbedder(32)
    idx = embed.embed_column(docs, "text", "embedding", emb)
    hits = search.search_policies(idx, "  safety stock  ", emb, top_k=2).collect()
    assert hits[0].id == 2 and [h.rank for h in hits] == [1, 2]


def test_checkpoint_folder_is_set_once(spark):
    from ordersight.session import checkpoint_dir
    first = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == first == spark.sparkContext.getCheckpointDir()
