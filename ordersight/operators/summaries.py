"""One-line result summaries per business tool (C5), including the
affected-customer count (A17) and the arg-min / arg-max picks (A14, A15)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.metrics import pct
from ordersight.operators import inventory, service
from ordersight.operators.facts import po_facts
from ordersight.sources.marts import Marts

# One-line summary templates per tool.
SUMMARY_TEMPLATES = {
    "get_otif_metrics": "%s orders; %s OTIF (%s%%).",
    "get_warehouse_performance": "%s warehouses; lowest OTIF is %s (%s%%).",
    "get_inventory_health": "%s products below safety stock across %s product-location-days.",
    "get_vendor_performance": "%s vendors; highest late count is %s (%s); destinations: %s.",
    "get_customer_impact": "%s customers; %s with affected revenue.",
}


def js_number(c: Column) -> Column:
    """Render a number the way a JS template literal does (50 -> "50", 63.6 -> "63.6")."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def _row(tool: str, df: DataFrame, summary: Column) -> DataFrame:
    return df.select(F.lit(tool).alias("tool"), summary.alias("summary"))


def _service_row(groups: DataFrame) -> DataFrame:
    """One row with what the three order-side summaries need, from the groups of ``service.service_groups``."""
    is_kind = lambda k: F.col("kind") == k
    pct_otif = pct(F.col("otif"), F.col("orders"))
    return groups.agg(
        F.max(F.when(is_kind("all"), F.col("orders"))).alias("orders"),
        F.max(F.when(is_kind("all"), F.col("otif"))).alias("otif"),
        F.max(F.when(is_kind("all"), pct_otif)).alias("otif_percentage"),
        F.count_if(is_kind("site")).alias("sites"),
        F.min_by(F.when(is_kind("site"), F.struct("name", pct_otif.alias("pct"))),
                 F.when(is_kind("site"), F.struct(pct_otif.alias("pct"), "warehouse_id"))).alias("lo"),
        F.count_if(is_kind("customer")).alias("customers"),
        F.count_if(is_kind("customer") & (F.col("cents") > 0)).alias("affected"))


def _vendor_row(m: Marts, start, end) -> DataFrame:
    """(n, top): number of vendors, and the one with most late POs (lowest id) with the sites of its late POs in the
    order of the detail list.  One pass over the POs, summed up per (vendor, site)."""
    first = F.struct(F.col("actual_delivery_date").isNull(), -F.datediff("actual_delivery_date", F.lit("1970-01-01")),
                     F.col("po_id"))
    late = F.col("late")
    per_site = po_facts(m, start, end).groupBy("vendor_id", "warehouse_id").agg(
        F.count_if("late").alias("late"), F.min(F.when(late, first)).alias("k"))
    names = m.warehouses.select("warehouse_id", "warehouse_name")
    seen = F.when(F.col("k").isNotNull() & F.col("warehouse_name").isNotNull(), F.struct("k", "warehouse_name"))
    per_vendor = per_site.join(names, "warehouse_id", "left").groupBy("vendor_id").agg(
        F.sum("late").cast("bigint").alias("late_deliveries"), F.array_sort(F.collect_list(seen)).alias("d"))
    all_vendors = m.vendors.select("vendor_id", "vendor_name").join(per_vendor, "vendor_id", "left").withColumn(
        "late_deliveries", F.coalesce("late_deliveries", F.lit(0).cast("bigint")))
    return all_vendors.agg(F.count(F.lit(1)).alias("n"),
                           F.max_by(F.struct("vendor_name", "late_deliveries", "d"),
                                    F.struct("late_deliveries", -F.col("vendor_id"))).alias("top"))


def tool_summaries(m: Marts, start, end) -> DataFrame:
    """One sentence per business tool."""
    none = F.lit("n/a")
    lines = {
        "get_otif_metrics": F.format_string(
            SUMMARY_TEMPLATES["get_otif_metrics"], F.coalesce("orders", F.lit(0)), F.coalesce("otif", F.lit(0)),
            js_number(F.coalesce("otif_percentage", F.lit(0.0)))),
        "get_warehouse_performance": F.format_string(
            SUMMARY_TEMPLATES["get_warehouse_performance"], "sites", F.coalesce(F.col("lo.name"), none),
            F.coalesce(js_number(F.col("lo.pct")), none)),
        "get_customer_impact": F.format_string(SUMMARY_TEMPLATES["get_customer_impact"], "customers", "affected"),
    }
    served = _service_row(service.service_groups(m, start, end)).select(F.explode(F.array(*[
        F.struct(F.lit(tool).alias("tool"), text.alias("summary")) for tool, text in lines.items()])).alias("x")).select("x.*")
    a4 = inventory.health_of(inventory.below_safety_groups(m, start, end), start, end)
    inv = _row("get_inventory_health", a4, F.format_string(
        SUMMARY_TEMPLATES["get_inventory_health"],
        F.col("products_below_safety_stock"), F.col("number_of_days_below_safety_stock")))
    # At most one entry per site per vendor; a site that occurs under several names is one entry each.
    dests = F.array_join(F.array_distinct(F.transform(F.col("top.d"), lambda x: x["warehouse_name"])), ", ")
    ven = _row("get_vendor_performance", _vendor_row(m, start, end), F.format_string(
        SUMMARY_TEMPLATES["get_vendor_performance"], F.col("n"),
        F.coalesce(F.col("top.vendor_name"), F.lit("n/a")), F.coalesce(F.col("top.late_deliveries"), F.lit(0)),
        F.when(F.coalesce(F.size("top.d"), F.lit(0)) > 0, dests).otherwise(F.lit("not specified"))))
    return reduce(DataFrame.unionByName, [served, inv, ven])


def policy_summaries(hits: DataFrame) -> DataFrame:
    """C5 for searches: passages in rank order (at most top-k per query)."""
    refs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document", "section"))), lambda h: F.concat(
        F.coalesce(h["document"], F.lit("unknown")), F.lit(" — "), F.coalesce(h["section"], F.lit("unknown"))))
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), refs.alias("refs")).select(
        "query_id", F.concat(F.col("n").cast("string"), F.lit(" policy passages; "), F.array_join("refs", "; "),
                             F.lit(".")).alias("summary"))


def fallback_summary(kind: str, n: int = 0, fields: list[str] | None = None) -> str:
    """The sentence for a result of no known tool: a list of n records, an object with fields, or neither."""
    if kind == "records":
        return f"{n} records returned."
    if kind == "object":
        return f"Structured result with fields: {', '.join((fields or [])[:8])}."
    if kind == "passages" and not n:
        return "0 policy passages; none returned."
    return "Tool returned a structured result."
