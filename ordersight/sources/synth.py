"""Synthetic fact generation, derived from the given tables.

Every synthetic value is a pure function of the row key (the first hex digits of
an MD5), so generation is embarrassingly parallel, reproducible on any
partitioning, and the same in any engine with MD5.  Same distributions as a
sequential generator, not the same draws.  Keys come from the real marts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.scan import ordered_scan
from ordersight.operators.facts import as_date, in_range
from ordersight.sources.marts import Marts

CARRIERS = ("North Freight", "Summit Parcel", "Harbor Lines", "Prairie Transport")
INCIDENT_MONTH = "2026-08-01"
CRITICAL_EVERY = 5             # every fifth product is hit by the incident


def inventory_calendar(m: Marts, start, end, state: DataFrame | None = None) -> DataFrame:
    """Dense daily inventory for every (warehouse, product) with a snapshot
    at or before ``end``: one row per calendar day from ``start`` (or the pair's
    first snapshot, if later) to ``end``.  Stock is carried forward from the
    latest snapshot; what a pair enters the range with is its latest snapshot at
    or before ``start``, taken from the stock state at ``start`` if it is given, else
    from the history (a ``max_by`` aggregate, combined before the shuffle).
    Each pair expands with ``explode(sequence(...))`` -- linear in pairs x days,
    no cross join -- and its window holds at most the days of the range."""
    quantities = F.struct("quantity_on_hand", "quantity_allocated")
    pair = ["warehouse_id", "product_id"]
    if state is None:
        before = m.inventory.filter(F.col("inventory_date") <= F.lit(as_date(start)))
    else:
        on_day = in_range(m, "inventory", "inventory_date", start, start)
        before = on_day.select(*pair, "inventory_date", "quantity_on_hand", "quantity_allocated").unionByName(
            state.select(*pair, F.date_sub(F.lit(as_date(start)), 1).alias("inventory_date"), "quantity_on_hand",
                         "quantity_allocated"))
    carried = (before.groupBy(*pair).agg(F.max_by(quantities, "inventory_date").alias("stock"))
               .select(*pair, F.lit(as_date(start)).alias("calendar_date"), "stock.*"))
    later = in_range(m, "inventory", "inventory_date", start, end).filter(
        F.col("inventory_date") > F.lit(as_date(start)))
    snaps = carried.unionByName(later.select(*pair, F.col("inventory_date").alias("calendar_date"),
                                             "quantity_on_hand", "quantity_allocated"))
    days = snaps.groupBy(*pair).agg(F.min("calendar_date").alias("first_date")).select(
        *pair, F.explode(F.sequence(F.col("first_date"), F.lit(as_date(end)))).alias("calendar_date"))
    j = days.join(snaps, [*pair, "calendar_date"], "left")
    w = (Window.partitionBy(*pair).orderBy("calendar_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = j.select(*pair, "calendar_date",
                      F.last("quantity_on_hand", ignorenulls=True).over(w).alias("quantity_on_hand"),
                      F.last("quantity_allocated", ignorenulls=True).over(w).alias("quantity_allocated"))
    ss = m.products.select("product_id", "safety_stock")
    return filled.join(ss, "product_id").select(
        *pair, "calendar_date", "quantity_on_hand", "quantity_allocated",
        (F.col("quantity_on_hand") - F.col("quantity_allocated")).alias("available"), "safety_stock")


def draw(salt: str, *keys: str) -> Column:
    """0 .. 999,999 from the MD5 of the keys and a salt."""
    text = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(salt))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 1_000_000


def ranks(mart: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(rank from 0, key) of a mart's distinct keys in their order, and their number.

    The rank table turns a draw into a key of any key set, with gaps or without: key number ``draw mod n``.  Ranks
    come from an ordered scan, so no task holds all keys."""
    keys = mart.select(F.lit(0).alias("_all"), F.col(key)).where(F.col(key).isNotNull()).distinct()
    out = ordered_scan(keys, ["_all"], [key], "_rank").select((F.col("_rank") - 1).alias("_rank"), key)
    return out, out.count()


def _pick(df: DataFrame, mart: DataFrame, key: str, h: Column, name: str | None = None) -> DataFrame:
    """``df`` with a key of ``mart`` drawn by ``h``, as column ``name`` (the key's own by default)."""
    table, n = ranks(mart, key)
    table = table.withColumnRenamed(key, name or key)
    return df.withColumn("_rank", h % F.lit(max(n, 1))).join(table, "_rank").drop("_rank")


def synth_order_lines(m: Marts) -> DataFrame:
    """1-4 order lines per order of the orders mart, over all products of the products mart, with
    quantities and a short-shipment rate drawn from hashes of (order, line)."""
    x = m.orders.select("order_id", F.explode(F.sequence(F.lit(1), (draw("lines", "order_id") % 4 + 1).cast("int"))).alias("line_number"))
    h = lambda salt: draw(salt, "order_id", "line_number")
    qty = (h("qty") % 20 + 1).cast("int")
    short = h("short") < 80_000                                # about 8 % of lines ship short
    x = _pick(x, m.products, "product_id", h("product"))
    return x.select(
        (F.col("order_id") * 10 + F.col("line_number")).alias("order_line_id"), "order_id",
        "product_id", qty.alias("quantity_ordered"),
        F.when(short, F.floor(qty * 3 / 5).cast("int")).otherwise(qty).alias("quantity_shipped"),
        (h("price") % 50_000 + 500).alias("unit_price_cents"))


def synth_orders(m: Marts, start: str = "2026-07-01", days: int = 92) -> DataFrame:
    """One synthetic order per order key of the orders mart: order date within a quarter, any warehouse of the
    mart, and requested / actual ship and delivery dates with hash-drawn delays (about 15 % of orders missing
    a delivery date when still in flight)."""
    o = m.orders.select("order_id", "customer_id")
    h = lambda salt: draw(salt, "order_id")
    od = F.date_add(F.lit(as_date(start)), (h("day") % days).cast("int"))
    req_ship = F.date_add(od, 1 + (h("ship") % 2).cast("int"))
    req_del = F.date_add(od, 3 + (h("del") % 4).cast("int"))
    ship_delay = F.when(h("sd") < 800_000, F.lit(0)).otherwise((h("sd2") % 3 + 1).cast("int"))
    del_delay = F.when(h("dd") < 700_000, F.lit(0)).otherwise((h("dd2") % 4 + 1).cast("int"))
    in_flight = h("open") < 150_000
    return _pick(o, m.warehouses, "warehouse_id", h("wh")).select(
        "order_id", "customer_id", "warehouse_id",
        od.alias("order_date"), req_ship.alias("requested_ship_date"),
        F.date_add(req_ship, ship_delay).alias("actual_ship_date"), req_del.alias("requested_delivery_date"),
        F.when(in_flight, F.lit(None).cast("date")).otherwise(F.date_add(req_del, del_delay)).alias("actual_delivery_date"),
        F.when(in_flight, F.lit("partially_fulfilled")).otherwise(F.lit("delivered")).alias("order_status"))


def synth_shipments(m: Marts) -> DataFrame:
    """One shipment per synthetic order: carrier and cost drawn, dates and status those of the order."""
    o = synth_orders(m)
    carriers = F.array(*map(F.lit, CARRIERS))
    return o.select(
        F.col("order_id").alias("shipment_id"), "order_id",
        F.get(carriers, (draw("carrier", "order_id") % len(CARRIERS)).cast("int")).alias("carrier"),
        F.col("actual_ship_date").alias("ship_date"), F.col("actual_delivery_date").alias("delivery_date"),
        (draw("cost", "order_id") % 11_000 + 1_800).alias("shipping_cost_cents"),
        F.when(F.col("order_status") == "delivered", "delivered").otherwise("partially_delivered").alias("shipment_status"))


def synth_purchase_orders(m: Marts) -> DataFrame:
    """Per product of the mart three regular replenishments in July (0-2 days late) and, for every fifth
    product, one in early August that arrives weeks late: the incident."""
    critical = F.col("product_id") % CRITICAL_EVERY == 0
    p = m.products.select("product_id", F.explode(F.when(critical, F.array(*map(F.lit, (1, 2, 3, 4)))).otherwise(
        F.array(*map(F.lit, (1, 2, 3))))).alias("slot"))
    h = lambda salt: draw(salt, "product_id", "slot")
    late = F.col("slot") == 4
    august = F.lit(as_date(INCIDENT_MONTH))
    expected = F.when(late, F.date_add(august, 4 + (F.col("product_id") % 4).cast("int"))).otherwise(
        F.date_add(F.lit(as_date("2026-07-15")), (F.col("product_id") % 10).cast("int")))
    actual = F.when(late, F.date_add(august, 26 + (F.col("product_id") % 3).cast("int"))).otherwise(
        F.date_add(expected, (h("delay") % 3).cast("int")))
    qty = (h("qty") % 161 + 150).cast("int")
    p = _pick(p, m.vendors, "vendor_id", draw("vendor", "product_id"))
    p = _pick(p, m.warehouses, "warehouse_id", h("site"))
    return p.select(
        (F.col("product_id") * 10 + F.col("slot")).alias("po_id"), "vendor_id", "product_id", "warehouse_id", F.date_add(expected, -12).alias("order_date"),
        expected.alias("expected_delivery_date"), actual.alias("actual_delivery_date"),
        qty.alias("quantity_ordered"), qty.alias("quantity_received"))


DRAW_DAYS = 8      # days whose draws one MD5 gives: four hex digits each
INCIDENT_DAYS = (7, 26)


def synth_inventory(m: Marts, start: str = INCIDENT_MONTH, days: int = 31) -> DataFrame:
    """A snapshot a day of every product at every site: quantities that move by drawn receipts and picks.

    A pair opens with 155 to 244 % of its product's safety stock, and each day adds a movement of -20 to +20; what
    would go below zero stays at zero.  That is a running sum less its lowest value so far below zero, folded over
    the pair's days inside its row: pairs are expanded in place, nothing is shuffled but the products to their rows.
    Every fifth product is short at the second site from the 7th to the 26th of the incident month: at most
    26 to 50 % of its safety stock.  15 to 36 % of what is there is allocated.  Products and sites may have any keys;
    ``inventory_id`` = (product rank x sites + site rank) x 1,000 + day."""
    if not 1 <= days < 1000:
        raise ValueError("days must be between 1 and 999")
    products, _ = ranks(m.products, "product_id")
    sites, n = ranks(m.warehouses, "warehouse_id")
    pairs = products.join(m.products.select("product_id", "safety_stock"), "product_id").select(
        "product_id", "safety_stock", (F.col("_rank") * n).alias("_base"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("_rank")) if n else None
    if pairs is None:
        raise ValueError("no site to keep stock at")
    # The key tables are small and come in few partitions; the pairs and their days are the work.
    tasks = int(m.spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.join(sites, "_rank").repartition(tasks, "product_id", "warehouse_id")
    h = lambda salt: draw(salt, "product_id", "warehouse_id")
    # One MD5 per eight days, bound by the outer lambda, so it is hashed once and not once a day.
    hashes = F.array(*[F.md5(F.concat_ws(":", F.col("product_id").cast("string"), F.col("warehouse_id").cast("string"),
                                         F.lit(f"stock{k}"))) for k in range(-(-days // DRAW_DAYS))])
    moves = F.slice(F.flatten(F.transform(hashes, lambda x: F.transform(
        F.array(*[F.substring(x, 4 * k + 1, 4) for k in range(DRAW_DAYS)]),
        lambda y: F.conv(y, 16, 10).cast("int") % 41 - 20))), 1, days)
    opening = F.floor(F.col("safety_stock") * (155 + h("open") % 90) / 100).cast("int")
    state = F.struct(opening.alias("level"), F.array().cast("array<int>").alias("all"))

    def day(acc: Column, move: Column) -> Column:
        level = F.greatest(F.lit(0), acc["level"] + move)
        return F.struct(level.alias("level"), F.array_append(acc["all"], level).alias("all"))

    # What a pair draws once stands below the expansion into days.
    pairs = pairs.select("product_id", "warehouse_id", "safety_stock", "_rank", "_base", (h("share") % 25 + 26).alias("_share"),
                         (h("alloc") % 22 + 15).alias("_alloc"), F.aggregate(moves, state, day)["all"].alias("_levels"))
    rows = pairs.select("product_id", "warehouse_id", "safety_stock", "_rank", "_base", "_share", "_alloc",
                        F.posexplode_outer("_levels").alias("_day", "_level"))  # plain explode would test levels below the join
    date = F.date_add(F.lit(as_date(start)), F.col("_day"))
    low = F.floor(F.col("safety_stock") * F.col("_share") / 100).cast("int")
    short = ((F.col("product_id") % CRITICAL_EVERY == 0) & (F.col("_rank") == 1)
             & (F.trunc(date, "month") == F.lit(as_date(INCIDENT_MONTH)))
             & F.dayofmonth(date).between(*INCIDENT_DAYS))
    on_hand = F.when(short, F.least(F.col("_level"), low)).otherwise(F.col("_level"))
    return rows.select(
        ((F.col("_base") + F.col("_rank")) * 1000 + F.col("_day")).alias("inventory_id"), "warehouse_id", "product_id",
        date.alias("inventory_date"), on_hand.alias("quantity_on_hand"),
        F.floor(on_hand * F.col("_alloc") / 100).cast("int").alias("quantity_allocated"))
