from __future__ import annotations

import datetime as dt
import os
import sys
import uuid

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ordersight.session import build_session  # noqa: E402

SCHEMAS = {
    "customers": "customer_id bigint, customer_name string, customer_segment string, region string, "
                 "service_level_target double",
    "products": "product_id bigint, sku string, product_name string, category string, unit_cost_cents bigint, "
                "unit_price_cents bigint, safety_stock int",
    "warehouses": "warehouse_id bigint, warehouse_name string, state string, city string",
    "vendors": "vendor_id bigint, vendor_name string, average_lead_time_days int, target_ontime_percentage double",
    "orders": "order_id bigint, customer_id bigint, warehouse_id bigint, order_date date, requested_ship_date date, "
              "actual_ship_date date, requested_delivery_date date, actual_delivery_date date, order_status string",
    "order_lines": "order_line_id bigint, order_id bigint, product_id bigint, quantity_ordered int, "
                   "quantity_shipped int, unit_price_cents bigint",
    "inventory": "warehouse_id bigint, product_id bigint, inventory_date date, quantity_on_hand int, "
                 "quantity_allocated int, inventory_id bigint",
    "purchase_orders": "po_id bigint, vendor_id bigint, product_id bigint, warehouse_id bigint, order_date date, "
                       "expected_delivery_date date, actual_delivery_date date, quantity_ordered int, "
                       "quantity_received int",
    "shipments": "shipment_id bigint, order_id bigint, carrier string, ship_date date, delivery_date date, "
                 "shipping_cost_cents bigint, shipment_status string",
}


class FixtureMarts:
    """Marts built from literal rows (duck-types ``ordersight.sources.marts.Marts``)."""

    MART_NAMES = tuple(SCHEMAS)

    def __init__(self, spark, **rows):
        self.spark = spark
        self.root = f"fixture-{uuid.uuid4().hex}"
        # Columns that no case is about are filled in.
        rows["warehouses"] = [(*r, f"{r[1]} City") for r in rows.get("warehouses", [])]
        rows["inventory"] = [(*r, n) for n, r in enumerate(rows.get("inventory", []), 1)]
        for name, schema in SCHEMAS.items():
            setattr(self, name, spark.createDataFrame(rows.get(name, []), schema))

    def mart(self, name):
        return getattr(self, name)


def D(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="ordersight-tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def fixture_marts(spark):
    return lambda **rows: FixtureMarts(spark, **rows)


WAREHOUSES = [(1, "North", "A"), (2, "South", "B"), (3, "Idle", "C")]
CUSTOMERS = [(1, "Acme", "Retail", "East", 0.97), (2, "Bolt", "Retail", "West", 0.90)]
PRODUCTS = [(p, f"SKU-{p:04d}", f"Product {p}", "Cat", 500, 1000, 20) for p in range(1, 11)]
VENDORS = [(v, f"Vendor {v}", 5, 0.95) for v in range(1, 11)]
