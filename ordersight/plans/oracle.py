"""Collects the DuckDB oracle statements of every registered query module."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    from ordersight.plans import q_quality, q_rules, q_service, q_sql, q_supply, q_text, q_trace

    out: dict[str, str] = {}
    for mod in (q_service, q_sql, q_supply, q_quality, q_text, q_trace, q_rules):
        out.update(mod.ORACLE)
    return out
