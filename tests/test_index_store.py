"""Published vector index: versions, pointer, gate; the generator over keys with gaps."""

from __future__ import annotations

import pytest
from conftest import D
from pyspark.sql import functions as F

from ordersight.operators import embed
from ordersight.sources import synth


def index_of(spark, text, model=None):
    chunks = spark.createDataFrame([("d.md", "T", "S", "d.md#0001", 1, text)], "document string, document_title string, "
                                   "section string, chunk_id string, chunk_seq int, text string")
    return embed.index_rows(chunks, embed.HashingEmbedder(8), model)


def test_readers_switch_with_the_pointer(spark, tmp_path):
    base = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        embed.open_vector_index(spark, base, "hashing-8")
    first = embed.publish_vector_index(index_of(spark, "old text"), base, "1")
    assert (first["chunks"], first["document_count"], first["path"]) == (1, 1, "v=1")
    reader = embed.open_vector_index(spark, base, "hashing-8")      # begins before the rewrite
    embed.write_vector_index(index_of(spark, "half done"), base, "2")   # written, not published
    assert embed.open_vector_index(spark, base, "hashing-8").first()["text"] == "old text"
    embed.publish_vector_index(index_of(spark, "new text"), base, "3")
    assert embed.open_vector_index(spark, base, "hashing-8").first()["text"] == "new text"
    assert reader.first()["text"] == "old text"                     # and still finishes
    assert embed.vector_index_manifest(spark, base)["version"] == "3"
    assert not [f for f in (tmp_path / "index").iterdir() if f.name.startswith("CURRENT.")]


def test_gate_on_manifest_and_rows(spark, tmp_path):
    base = str(tmp_path / "index")
    embed.publish_vector_index(index_of(spark, "text", "other-model"), base)
    with pytest.raises(ValueError, match="incompatible"):
        embed.open_vector_index(spark, base, "hashing-8")
    mixed = index_of(spark, "a").unionByName(index_of(spark, "b", "other-model"))
    with pytest.raises(ValueError):
        embed.publish_vector_index(mixed, base)
    assert embed.vector_index_manifest(spark, base)["embedding_model"] == "other-model"  # the pointer stays
    embed.publish_vector_index(index_of(spark, "x").limit(0), base)
    with pytest.raises(ValueError):
        embed.open_vector_index(spark, base, "hashing-8")


@pytest.fixture
def gaps(fixture_marts):
    """Marts whose ids have gaps."""
    products = [(p, f"SKU-{p}", f"P{p}", "Cat", 500, 1000, 20 + n) for n, p in enumerate((3, 10, 55, 1000, 70_005))]
    vendors = [(v, f"V{v}", 5, 0.95) for v in (7, 900)]
    sites = [(w, f"W{w}", "S") for w in (2, 40, 41)]
    orders = [(o, 1, 2, D("2026-08-10"), D("2026-08-11"), None, D("2026-08-14"), None, "delivered") for o in range(5, 900, 9)]
    return fixture_marts(products=products, vendors=vendors, warehouses=sites, orders=orders)


def test_generated_keys_exist_in_marts_with_gaps(gaps):
    keys = {c: {r[0] for r in gaps.mart(t).select(c).collect()} for t, c in
            (("products", "product_id"), ("vendors", "vendor_id"), ("warehouses", "warehouse_id"))}
    for df in (synth.synth_order_lines(gaps), synth.synth_orders(gaps), synth.synth_purchase_orders(gaps),
               synth.synth_inventory(gaps)):
        rows = df.collect()
        for c in keys.keys() & set(df.columns):
            assert {r[c] for r in rows} <= keys[c]
            assert len(rows) < 50 or {r[c] for r in rows} == keys[c]
    assert synth.synth_orders(gaps).count() == gaps.orders.count()


def test_generated_inventory_is_daily_whole_and_moves(gaps):
    rows = synth.synth_inventory(gaps).collect()
    assert len(rows) == 5 * 3 * 31 == len({(r.product_id, r.warehouse_id, r.inventory_date) for r in rows})
    assert len({r.inventory_id for r in rows}) == len(rows)
    assert all(0 <= r.quantity_allocated <= r.quantity_on_hand for r in rows)
    safety = {r.product_id: r.safety_stock for r in gaps.products.collect()}
    by = {(r.product_id, r.warehouse_id, r.inventory_date.day): r.quantity_on_hand for r in rows}
    for (p, w, day), q in by.items():
        if p % 5 == 0 and w == 40 and 7 <= day <= 26:
            assert q <= safety[p] * 0.5                       # the incident
        elif (p, w, day + 1) in by and not (p % 5 == 0 and w == 40):
            assert abs(by[p, w, day + 1] - q) <= 20
    assert len(set(by.values())) > 40
    short = synth.synth_inventory(gaps, "2026-07-01", 10)
    assert short.agg(F.max("inventory_date")).first()[0] == D("2026-07-10")
    with pytest.raises(ValueError):
        synth.synth_inventory(gaps, days=0)
