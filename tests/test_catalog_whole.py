"""Sixth tool, whole results, display helpers and long answers."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from ordersight.operators import answers, chunker, embed, search, service, summaries
from ordersight.plans.catalog import run_tool, run_tool_parts

from conftest import CUSTOMERS, PRODUCTS, VENDORS, WAREHOUSES, D

AUG = {"startDate": "2026-08-01", "endDate": "2026-08-31"}


def test_policy_search_tool(spark):
    docs = spark.createDataFrame([("vendor.md", "# V\n## Late\nescalate late vendors today"),
                                  ("stock.md", "# S\n## Safety\nkeep safety stock on hand")], "document string, markdown string")
    emb = embed.HashingEmbedder(64)
    index = embed.index_rows(chunker.chunk_documents(docs), emb)
    hit = run_tool(None, "search_company_policies", public=True, index=index, embedder=emb, query="  late vendors ", topK=1).collect()
    assert [(h.document, h.section, h.text) for h in hit] == [("vendor.md", "Late", "escalate late vendors today")]
    for bad in ({"query": 5}, {"query": "x", "topK": 51}, {"query": " "}, {"query": "x", "path": "/etc"}):
        with pytest.raises((TypeError, ValueError)):
            run_tool(None, "search_company_policies", index=index, embedder=emb, **bad)


def test_whole_results_come_in_parts_and_order(fixture_marts):
    late = [(n, 4, n, 2, D("2026-07-20"), D("2026-08-05"), D(f"2026-08-{10 + n:02d}"), 10, 10) for n in (1, 2, 3)]
    stock = [(2, p, D("2026-08-03"), 5, 1) for p in (3, 1)] + [(1, 3, D("2026-08-04"), 5, 1), (1, 3, D("2026-08-05"), 5, 1)]
    m = fixture_marts(purchase_orders=late, inventory=stock, vendors=VENDORS, products=PRODUCTS, warehouses=WAREHOUSES,
                      customers=CUSTOMERS)
    parts = run_tool_parts(m, "get_vendor_performance", vendorId=4, **AUG)
    assert list(parts) == ["vendors", "productsAffected", "latePurchaseOrders"]
    assert [r.purchaseOrderId for r in parts["latePurchaseOrders"].collect()] == [3, 2, 1]
    assert [r.lateDeliveries for r in parts["vendors"].collect()] == [3]
    parts = run_tool_parts(m, "get_inventory_health", **AUG)
    assert parts["result"].first().productsBelowSafetyStock == 2
    assert [(r.productId, r.warehouseId) for r in parts["affectedProducts"].collect()] == [(3, 1), (1, 2), (3, 2)]
    assert list(run_tool_parts(m, "get_otif_metrics", **AUG)) == ["result"]
    assert [r.warehouse_id for r in run_tool(m, "get_warehouse_performance", **AUG).collect()] == [1, 2, 3]


def test_titles_and_displays(spark):
    df = spark.createDataFrame([("shipping_sla.md", 12.34, 1234, D("2026-08-01")), ("x.md", None, None, None)],
                               "d string, p double, n bigint, s date")
    rows = df.select(search.document_title(F.col("d")), service.percent_display(F.col("p")),
                     service.count_display(F.col("n")), service.date_range_display(F.col("s"))).collect()
    assert [tuple(r) for r in rows] == [("Shipping SLA", "12.3%", "1,234", "August"), ("x.md", "—", "—", "")]
    assert summaries.fallback_summary("records", 3) == "3 records returned."
    assert summaries.fallback_summary("other") == "Tool returned a structured result."


def plain_sections(answer):
    out, now = {s: [] for s in answers.SECTIONS}, "executive"
    words = [("executive", "executive"), ("investigation", "executive"), ("observed", "observed"),
             ("operational fact", "observed"), ("interpret", "interpretation"), ("recommend", "actions"), ("policy", "policy"),
             ("limitation", "limitations")]
    for line in answer.split("\n"):
        m = re.match(r"#{1,3}\s+(.+?)\s*#*\s*$", line) or re.match(r"\*\*(.+?)\*\*:?\s*$", line)
        if m:
            now = next((s for w, s in words if w in m[1].lower()), now)
        else:
            out[now].append(line)
    return {s: "\n".join(x).strip() for s, x in out.items()}


def test_long_answers_against_plain_code(spark):
    random.seed(5)
    heads = ["## Executive summary", "# Observed facts", "**Interpretation**:", "### Recommendations", "## Policy basis",
             "**Limitations**", "## Something else", "#### not a heading"]
    texts = ["\n".join(random.choice(heads) if random.random() < 0.1 else f"line {k}" for k in range(n))
             for n in (0, 1, 7, 300, 4000)] + ["", "no heading\nat all"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, answer string")
    for r in answers.answer_sections(df).collect():
        assert {s: r[s] for s in answers.SECTIONS} == plain_sections(texts[r.i])
