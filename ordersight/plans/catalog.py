"""Governed query catalogue (C6): named, parameterised, read-only analytics
with strictly validated arguments (P3, P4, X9).

    from ordersight.plans.catalog import run_tool
    df = run_tool(marts, "get_vendor_performance", startDate="1996-08-01", endDate="1996-08-31", vendorId=4)
    df = run_tool(marts, "get_vendor_performance", public=True, ...)   # camelCase public columns

Validation runs on the driver before any plan is built; the result is a lazy
DataFrame (nothing is collected here).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from ordersight.functions.shape import camel_case, public_shape  # noqa: F401
from ordersight.operators import embed, inventory, search, service, vendors
from ordersight.sources.marts import Marts

_DATE_RE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def validate_date(value, field: str) -> dt.date:
    """``YYYY-MM-DD`` and a real calendar date."""
    if not isinstance(value, str) or not _DATE_RE.match(value):
        raise TypeError(f"{field} must use YYYY-MM-DD format")
    try:
        return dt.date.fromisoformat(value)
    except ValueError:
        raise TypeError(f"{field} must be a valid calendar date") from None


def validate_date_range(start, end) -> tuple[dt.date, dt.date]:
    s, e = validate_date(start, "startDate"), validate_date(end, "endDate")
    if s > e:
        raise TypeError("startDate must be on or before endDate")
    return s, e


def validate_optional_id(value, field: str) -> int | None:
    """Absent, or a safe positive integer."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0 or value > 2 ** 53 - 1:
        raise TypeError(f"{field} must be a positive integer")
    return value


def _otif(m, s, e, a):
    return service.otif_metrics(m, s, e, a.get("warehouseId"), a.get("customerId"))


def _warehouses(m, s, e, a):
    return service.warehouse_performance(m, s, e)


def _inventory(m, s, e, a):
    return inventory.inventory_below_safety(m, s, e, a.get("warehouseId"), a.get("productId"))


def _vendors(m, s, e, a):
    return vendors.vendor_performance(m, s, e, a.get("vendorId"))


def _customers(m, s, e, a):
    return service.customer_impact(m, s, e, a.get("warehouseId"))


def search_company_policies(index: DataFrame, embedder, query, top_k=3) -> DataFrame:
    """The sixth tool: the passages nearest to a question in an index of embedded chunks, text included."""
    if not isinstance(query, str):
        raise TypeError("query must be a string")
    at = index.withColumn("_at", embed.chunk_order(index))
    return search.search_policies(at, query.strip(), embedder, top_k=top_k, id_col="_at").drop("_at")


# name -> (optional id arguments, builder)
TOOLS: dict[str, tuple[tuple[str, ...], Callable[..., DataFrame]]] = {
    "get_otif_metrics": (("warehouseId", "customerId"), _otif),
    "get_warehouse_performance": ((), _warehouses),
    "get_inventory_health": (("warehouseId", "productId"), _inventory),
    "get_vendor_performance": (("vendorId",), _vendors),
    "get_customer_impact": (("warehouseId",), _customers),
}


def _checked(name: str, args: dict):
    ids, build = TOOLS[name]
    extra = set(args) - {"startDate", "endDate", *ids}
    if extra:
        raise TypeError("Unexpected tool argument")
    s, e = validate_date_range(args.get("startDate"), args.get("endDate"))
    return build, s, e, {k: validate_optional_id(args.get(k), k) for k in ids}


def run_tool(m: Marts, name: str, public: bool = False, **args) -> DataFrame:
    """Validate arguments strictly (no unknown keys) and build the query;
    ``public=True`` returns the camelCase public shape (P13).

    ``search_company_policies`` takes the index to search and the embedder that
    made it as ``index`` and ``embedder``, besides query and topK."""
    if name == "search_company_policies":
        if set(args) - {"index", "embedder", "query", "topK"}:
            raise TypeError("Unexpected tool argument")
        out = search_company_policies(args["index"], args["embedder"], args.get("query"), args.get("topK", 3))
    elif name in TOOLS:
        build, s, e, clean = _checked(name, args)
        out = build(m, s, e, clean)
    else:
        raise KeyError(f"Unknown business tool: {name}")
    return public_shape(out) if public else out


def run_tool_parts(m: Marts, name: str, **args) -> dict[str, DataFrame]:
    """C6 whole results: every list of a tool's result as a DataFrame of its own, in the result's order, under
    its public name (a list has no bound, so none is folded into one row)."""
    if name not in ("get_inventory_health", "get_vendor_performance", "get_customer_impact"):
        return {"result": run_tool(m, name, public=True, **args)}
    build, s, e, clean = _checked(name, args)
    if name == "get_inventory_health":
        ids = clean["warehouseId"], clean["productId"]
        parts = {"result": inventory.inventory_health(m, s, e, *ids),
                 "affectedProducts": inventory.inventory_below_safety(m, s, e, *ids)}
    elif name == "get_vendor_performance":
        parts = {"vendors": vendors.vendor_performance(m, s, e, clean["vendorId"]),
                 "productsAffected": vendors.vendor_late_products(m, s, e, clean["vendorId"]),
                 "latePurchaseOrders": vendors.late_purchase_orders(m, s, e, clean["vendorId"])}
    else:
        parts = {"customers": build(m, s, e, clean)}
    return {k: public_shape(v) for k, v in parts.items()}
