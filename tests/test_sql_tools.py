"""The catalogue's SQL table functions give what its API gives, and reject what it rejects."""

from __future__ import annotations

import pytest

from ordersight.operators import chunker, embed
from ordersight.plans.catalog import run_tool
from ordersight.plans.sql_tools import register_tools
from ordersight.sources.marts import Marts

CUR = ("1996-08-01", "1996-08-31")
CALLS = [("get_otif_metrics", {}), ("get_otif_metrics", {"warehouseId": 5, "customerId": 7}), ("get_warehouse_performance", {}),
         ("get_inventory_health", {}), ("get_inventory_health", {"warehouseId": 3}), ("get_vendor_performance", {}),
         ("get_vendor_performance", {"vendorId": 4}), ("get_customer_impact", {}), ("get_customer_impact", {"warehouseId": 5})]


@pytest.fixture(scope="module")
def tools(spark):
    m = Marts(spark, "/root/testdata/sf0.001")
    docs = chunker.documents_as_markdown(m.t.documents.where("doc_id < 40"))
    emb = embed.HashingEmbedder(32)
    index = embed.index_rows(chunker.chunk_documents(docs), emb)
    names = register_tools(m, index, emb)
    assert len(names) == 6
    return m, index, emb


@pytest.mark.parametrize("name, extra", CALLS)
def test_functions_equal_the_api(spark, tools, name, extra):
    args = {"startDate": CUR[0], "endDate": CUR[1], **extra}
    sql = spark.sql(f"SELECT * FROM {name}({', '.join(f'{k} => :{k}' for k in args)})", args=args)
    api = run_tool(tools[0], name, **args)
    assert sql.columns == api.columns
    assert sorted(map(tuple, sql.collect())) == sorted(map(tuple, api.collect())) and api.count() > 0


def test_search_equals_the_api(spark, tools):
    m, index, emb = tools
    text = m.t.documents.where("doc_id = 7").first()["text"][:200]
    for k in (3, 10):
        sql = spark.sql("SELECT * FROM search_company_policies(:q, :k)", args={"q": f"  {text} ", "k": k})
        api = run_tool(None, "search_company_policies", index=index, embedder=emb, query=text, topK=k)
        assert sql.columns == api.columns
        assert [tuple(r) for r in sql.orderBy("rank").collect()] == [tuple(r) for r in api.orderBy("rank").collect()]
    assert spark.sql("SELECT * FROM search_company_policies('late vendor')").count() == 3


def test_calls_join_like_tables_and_push_filters(spark, tools):
    df = spark.sql("""SELECT w.warehouse_name, o.total_orders FROM get_warehouse_performance('1996-08-01', '1996-08-31') w
                      JOIN get_otif_metrics('1996-08-01', '1996-08-31') o ON o.total_orders >= w.total_orders""")
    assert df.count() == 25
    plan = spark.sql("SELECT * FROM get_otif_metrics('1996-08-01', '1996-08-31')")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1996-08-01T00:00)" in plan


@pytest.mark.parametrize("call, message", [
    ("get_otif_metrics('1996/08/01', '1996-08-31')", "startDate must use YYYY-MM-DD format"),
    ("get_otif_metrics('1996-08-01', '1996-02-30')", "endDate must be a valid calendar date"),
    ("get_warehouse_performance('1996-09-01', '1996-08-31')", "startDate must be on or before endDate"),
    ("get_vendor_performance('1996-08-01', '1996-08-31', 0)", "vendorId must be a positive integer"),
    ("get_customer_impact('1996-08-01', NULL)", "endDate must use YYYY-MM-DD format"),
    ("get_inventory_health('1996-08-01', '1996-08-31', productId => -1)", "productId must be a positive integer"),
    ("get_otif_metrics('1996-08-01')", "REQUIRED_PARAMETER_NOT_FOUND|WRONG_NUM_ARGS"),
    ("get_warehouse_performance('1996-08-01', '1996-08-31', 5)", "WRONG_NUM_ARGS"),
    ("get_warehouse_performance('1996-08-01', '1996-08-31', vendorId => 5)", "UNRECOGNIZED_PARAMETER_NAME|WRONG_NUM_ARGS"),
    ("search_company_policies('x', 51)", "topK must be an integer between 1 and 50"),
    ("search_company_policies('   ')", "query must be a non-empty string")])
def test_bad_arguments_are_rejected(spark, tools, call, message):
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM {call}").collect()
