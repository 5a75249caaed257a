"""Table data-quality checks as Spark jobs: the constraints the operational
schema declares (primary / unique keys, NOT NULL, CHECK rules, foreign keys),
run over whole tables and reported as violation counts."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ordersight.sources.marts import Marts

# Fixed constraint catalogue of the operational schema.
UNIQUE_KEYS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("customers", ("customer_id",)),
    ("products", ("product_id",)),
    ("products", ("sku",)),
    ("warehouses", ("warehouse_id",)),
    ("vendors", ("vendor_id",)),
    ("orders", ("order_id",)),
    ("order_lines", ("order_line_id",)),
    ("inventory", ("inventory_id",)),
    ("inventory", ("warehouse_id", "product_id", "inventory_date")),
    ("purchase_orders", ("po_id",)),
    ("shipments", ("shipment_id",)),
    ("shipments", ("order_id",)),
)

NULLABLE = {
    "orders": {"actual_ship_date", "actual_delivery_date"},
    "purchase_orders": {"actual_delivery_date"},
    "shipments": {"ship_date", "delivery_date"},
}

FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("orders", "warehouse_id", "warehouses", "warehouse_id"),
    ("order_lines", "order_id", "orders", "order_id"),
    ("order_lines", "product_id", "products", "product_id"),
    ("inventory", "warehouse_id", "warehouses", "warehouse_id"),
    ("inventory", "product_id", "products", "product_id"),
    ("purchase_orders", "vendor_id", "vendors", "vendor_id"),
    ("purchase_orders", "product_id", "products", "product_id"),
    ("purchase_orders", "warehouse_id", "warehouses", "warehouse_id"),
    ("shipments", "order_id", "orders", "order_id"),
)


def check_rules() -> dict[str, list[tuple[str, Column]]]:
    """CHECK rules per table (a rule is violated when it is FALSE; NULL passes)."""
    c = F.col
    return {
        "customers": [("service_level_target between 0 and 1", c("service_level_target").between(0, 1))],
        "products": [("unit_cost >= 0", c("unit_cost_cents") >= 0),
                     ("unit_price >= unit_cost", c("unit_price_cents") >= c("unit_cost_cents")),
                     ("safety_stock >= 0", c("safety_stock") >= 0)],
        "vendors": [("target_ontime_percentage between 0 and 1", c("target_ontime_percentage").between(0, 1))],
        "orders": [("order_status in enum", c("order_status").isin("delivered", "partially_fulfilled"))],
        "order_lines": [("quantity_ordered > 0", c("quantity_ordered") > 0),
                        ("0 <= quantity_shipped <= quantity_ordered",
                         (c("quantity_shipped") >= 0) & (c("quantity_shipped") <= c("quantity_ordered"))),
                        ("unit_price >= 0", c("unit_price_cents") >= 0)],
        "inventory": [("quantity_on_hand >= 0", c("quantity_on_hand") >= 0),
                      ("0 <= quantity_allocated <= quantity_on_hand",
                       (c("quantity_allocated") >= 0) & (c("quantity_allocated") <= c("quantity_on_hand")))],
        "purchase_orders": [("quantity_ordered > 0", c("quantity_ordered") > 0),
                            ("0 <= quantity_received <= quantity_ordered",
                             (c("quantity_received") >= 0) & (c("quantity_received") <= c("quantity_ordered")))],
        "shipments": [("shipping_cost >= 0", c("shipping_cost_cents") >= 0),
                      ("shipment_status in enum", c("shipment_status").isin("delivered", "partially_delivered"))],
    }


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def table_counts(m: Marts) -> DataFrame:
    """Row count of each of the nine tables (UNION ALL of counts)."""
    return _union([m.mart(t).agg(F.count(F.lit(1)).alias("row_count"))
                   .select(F.lit(t).alias("table_name"), "row_count") for t in m.MART_NAMES])


def duplicate_keys(m: Marts) -> DataFrame:
    """Q1: per key constraint, keys occurring more than once and the excess rows.

    Every mart is scanned once: a row gives one (constraint, key) row per key constraint of its table, all go
    through one aggregate.  Keys are up to three integers (dates as day numbers) or a text."""
    streams, day = [], F.lit("1970-01-01").cast("date")
    for table in m.MART_NAMES:
        df = m.mart(table)
        kind = dict(df.dtypes)
        rows = []
        for n, (t, keys) in enumerate(UNIQUE_KEYS):
            if t == table:
                whole = [F.datediff(k, day) if kind[k] == "date" else F.col(k) for k in keys if kind[k] != "string"]
                text = [F.col(k) for k in keys if kind[k] == "string"]
                parts = [c.cast("bigint") for c in whole] + [F.lit(None).cast("bigint")] * (3 - len(whole))
                rows.append(F.struct(F.lit(n).alias("n"), *[c.alias(f"k{i}") for i, c in enumerate(parts)],
                                     (text[0] if text else F.lit(None).cast("string")).alias("t")))
        streams.append(df.select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    many = _union(streams).groupBy("n", "k0", "k1", "k2", "t").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    found = many.groupBy("n").agg(F.count(F.lit(1)).alias("dup"), F.sum(F.col("rows") - 1).alias("excess"))
    names = m.spark.createDataFrame([(n, t, ",".join(k)) for n, (t, k) in enumerate(UNIQUE_KEYS)],
                                    "n int, table_name string, key_columns string")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return names.join(found, "n", "left").select("table_name", "key_columns", zero("dup").alias("duplicated_keys"),
                                                 zero("excess").alias("excess_rows"))


def constraint_metrics(table: str, columns: list[str], family: str | None = None) -> dict[tuple[str, str], Column]:
    """(family, name) -> aggregate that counts a table's rows, NULLs and rule violations."""
    out = {("rows", table): F.count(F.lit(1))}
    out |= {("null", c): F.count_if(F.col(c).isNull()) for c in columns if c not in NULLABLE.get(table, set())}
    out |= {("check", name): F.count_if(~rule) for name, rule in check_rules().get(table, [])}
    return {k: v for k, v in out.items() if family in (None, k[0])}


def observed(df: DataFrame, table: str, family: str | None = None) -> tuple[DataFrame, Observation, list]:
    """``df`` that counts its violations on the way to wherever it is written (``DataFrame.observe``): no scan, no
    shuffle and no job beside the write itself.  The observation's metric ``m<i>`` is the i-th of the list."""
    metrics = constraint_metrics(table, df.columns, family)
    obs = Observation(f"{table}-{uuid.uuid4().hex}")
    return df.observe(obs, *[c.alias(f"m{i}") for i, c in enumerate(metrics.values())]), obs, list(metrics)


def measure(m: Marts, family: str | None = None) -> list[tuple[str, str, str, int]]:
    """(table, family, name, count) of all constraints of a family ("rows", "null", "check"; None: all), from one pass
    over each mart that reads just the columns it counts.  A fixed number of counts per mart reaches the driver."""
    rules = check_rules()

    def one(table: str):
        df = m.mart(table)
        if family == "check":
            if table not in rules:
                return []
            used = [c for c in df.columns if any(c in str(rule) for _, rule in rules[table])]
            df = df.select(*used)
        watched, obs, names = observed(df, table, family)
        watched.write.format("noop").mode("overwrite").save()
        got = obs.get
        return [(table, kind, name, int(got[f"m{i}"])) for i, (kind, name) in enumerate(names)]

    with ThreadPoolExecutor(4) as pool:
        return [row for rows in pool.map(one, m.MART_NAMES) for row in rows]


def _measured(m: Marts, family: str, name: str, count: str) -> DataFrame:
    rows = [(t, n, k) for t, _, n, k in measure(m, family)]
    return m.spark.createDataFrame(rows, f"table_name string, {name} string, {count} bigint")


def null_violations(m: Marts) -> DataFrame:
    """Q2: NULL count of every NOT NULL column, one observed pass per table."""
    return _measured(m, "null", "column_name", "null_count")


def check_violations(m: Marts) -> DataFrame:
    """Q3: rows violating each CHECK rule, one observed pass per table."""
    return _measured(m, "check", "rule", "violations")


def constraint_suite(m: Marts) -> DataFrame:
    """Q1-Q4 in one table (check, table_name, subject, violations): row counts, NULLs and rules from one observed
    pass over each mart, keys and foreign keys from one stacked pass each."""
    spark = m.spark
    labels = {"rows": "row_count", "null": "not_null", "check": "check"}
    found = spark.createDataFrame([(labels[f], t, t if f == "rows" else n, k) for t, f, n, k in measure(m)],
                                  "check string, table_name string, subject string, violations bigint")
    keys = duplicate_keys(m).select(F.lit("unique").alias("check"), "table_name", F.col("key_columns").alias("subject"),
                                    F.col("excess_rows").alias("violations"))
    fks = fk_violations(m).select(F.lit("foreign_key").alias("check"), F.col("child_table").alias("table_name"),
                                  F.concat("column_name", F.lit(" -> "), "parent_table").alias("subject"), "violations")
    return _union([found, keys, fks])


def fk_violations(m: Marts) -> DataFrame:
    """Child rows whose foreign key has no parent.

    Every mart is scanned once: a row gives one (relationship, key) row for each foreign key it holds and each
    relationship it is the parent of; one aggregate, combined before the shuffle, counts the children of a key and
    whether it has a parent, so a hot key is one row per task.  Over a store, lines and orders meet in their
    buckets instead, without an exchange on order_id."""
    bucketed = hasattr(m, "line_facts_in")
    in_buckets = ("order_lines", "order_id", "orders", "order_id")
    streams = []
    for table in m.MART_NAMES:
        rows = []
        for n, fk in enumerate(FOREIGN_KEYS):
            child, col, parent, pcol = fk
            if bucketed and fk == in_buckets:
                continue
            for side, key in ((0, col if child == table else None), (1, pcol if parent == table else None)):
                if key:
                    rows.append(F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), F.col(key).cast("bigint").alias("k")))
        if rows:
            streams.append(m.mart(table).select(F.explode(F.array(*rows)).alias("x")).select("x.*"))
    keys = _union(streams).filter("k IS NOT NULL").groupBy("n", "k").agg(
        F.count_if(F.col("side") == 0).alias("children"), F.max("side").alias("parent"))
    found = keys.filter("parent = 0").groupBy("n").agg(F.sum("children").alias("violations"))
    if bucketed:
        orphans = m.line_facts_in().join(m.orders.select("order_id"), "order_id", "left_anti").filter("order_id IS NOT NULL")
        found = found.unionByName(orphans.agg(F.sum("line_count").alias("violations")).select(
            F.lit(FOREIGN_KEYS.index(in_buckets)).alias("n"), "violations"))
    names = m.spark.createDataFrame([(n, c, col, p) for n, (c, col, p, _) in enumerate(FOREIGN_KEYS)],
                                    "n int, child_table string, column_name string, parent_table string")
    return names.join(found, "n", "left").select(
        "child_table", "column_name", "parent_table", F.coalesce("violations", F.lit(0).cast("bigint")).alias("violations"))


DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"


def classify_date_text(c: Column) -> Column:
    """P3 as a column rule: 'bad_format' unless YYYY-MM-DD, 'invalid_date'
    unless a real calendar date that formats back to the same text, else 'valid'."""
    parsed = F.try_to_date(c, "yyyy-MM-dd")
    return (F.when(~c.rlike(DATE_PATTERN), F.lit("bad_format"))
            .when(parsed.isNull() | (F.date_format(parsed, "yyyy-MM-dd") != c), F.lit("invalid_date"))
            .otherwise(F.lit("valid")))


def date_text_sample(m: Marts) -> DataFrame:
    """Order dates rendered as text, with deterministic bad values injected
    (a day that does not exist, a slash-separated date) to exercise P3."""
    o = m.orders
    k = F.col("order_id")
    text = (F.when(k % 97 == 0, F.concat(F.year("order_date").cast("string"), F.lit("-02-30")))
            .when(k % 89 == 0, F.date_format("order_date", "yyyy/MM/dd"))
            .otherwise(F.date_format("order_date", "yyyy-MM-dd")))
    return o.select("order_id", text.alias("date_text"))


def date_string_quality(m: Marts) -> DataFrame:
    """Status counts of date strings over the whole orders table."""
    s = date_text_sample(m)
    return s.groupBy(classify_date_text(F.col("date_text")).alias("status")).agg(F.count(F.lit(1)).alias("rows"))
