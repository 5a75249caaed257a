"""Tool-argument contracts on awkward calls."""

from __future__ import annotations

from ordersight.operators import trace as T

CALLS = [
    (1, "get_warehouse_performance", '{"startDate": "2026-08-01", "endDate": "2026-08-31"}', []),
    (2, "get_warehouse_performance", "{not json", [(None, "invalid_json")]),
    (3, "get_otif_metrics", None, [(None, "invalid_json")]),
    (4, "get_otif_metrics", "[1, 2]", [(None, "invalid_json")]),
    (5, "get_otif_metrics", '{"endDate": "2026-08-31", "tags": 1}', [("startDate", "missing_required"), ("tags", "unexpected_key")]),
    (6, "search_company_policies", '{"query": "x", "topK": 5.0}', []),
    (7, "search_company_policies", '{"query": "x", "topK": 5.5}', [("topK", "invalid_type")]),
    (8, "get_vendor_performance", '{"startDate": "2026-08-01", "endDate": "2026/08/31", "vendorId": 9007199254740993}',
     [("endDate", "invalid_value"), ("vendorId", "invalid_type")]),
    (9, "search_company_policies", '{"query": "", "topK": 51}', [("query", "invalid_value"), ("topK", "invalid_value")]),
    (10, "get_customer_impact", '{"startDate": null, "endDate": "2026-08-31"}', [("startDate", "invalid_type")]),
    (11, "unknown_tool", '{"a": 1}', []),
]


def _trace(spark):
    return spark.createDataFrame([(1, seq, name, args) for seq, name, args, _ in CALLS],
                                 "run_id bigint, seq int, name string, arguments string")


def test_violations_per_call(spark):
    got: dict = {}
    for r in T.contract_violations(_trace(spark)).collect():
        got.setdefault(r.seq, []).append((r.key, r.violation))
    for seq, _, _, expected in CALLS:
        assert sorted(got.get(seq, []), key=str) == sorted(expected, key=str), seq


def test_unfit_arguments_stop_no_other_call(spark):
    assert {r.seq for r in T.sanitize_arguments(_trace(spark)).collect()} == {1, 5, 6, 7, 8, 9, 10, 11}
    projected = {r.seq: r.projected for r in T.project_arguments(_trace(spark)).collect()}
    assert projected[5] == '{"endDate":"2026-08-31"}' and projected[11] == "{}"
    assert projected[6].startswith('{"query":"x"') and projected[10] == '{"endDate":"2026-08-31","startDate":null}'
