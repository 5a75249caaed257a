"""Registered SQL forms of the catalogue's tools, current month."""

from __future__ import annotations

from ordersight.plans import params as P
from ordersight.plans import q_service, q_supply
from ordersight.plans.registry import register
from ordersight.plans.sql_tools import register_tools

ORACLE: dict[str, str] = {}
_DATES = {"startDate": P.CURRENT[0], "endDate": P.CURRENT[1]}


def _sql_form(tool: str, oracle: str, **extra) -> None:
    args = _DATES | extra

    def query(m):
        register_tools(m)
        return m.spark.sql(f"SELECT * FROM {tool}({', '.join(f'{k} => :{k}' for k in args)})", args=args)

    query.__doc__ = f"C6: SELECT * FROM {tool}(...) with parameter markers."
    register(f"sql_{tool}")(query)
    ORACLE[f"sql_{tool}"] = oracle


_sql_form("get_otif_metrics", q_service.ORACLE["otif_metrics_filtered"], startDate=P.YEAR[0], endDate=P.YEAR[1],
          warehouseId=P.FILTER_WAREHOUSE)
_sql_form("get_warehouse_performance", q_service.ORACLE["warehouse_performance"])
_sql_form("get_inventory_health", q_supply.ORACLE["inventory_below_safety"])
_sql_form("get_vendor_performance", q_supply.ORACLE["vendor_performance_filtered"], vendorId=P.FILTER_VENDOR)
_sql_form("get_customer_impact", q_service.ORACLE["customer_impact"])
