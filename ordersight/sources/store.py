"""Persisted mart layout for large deployments.

At 100 TB the range queries must not scan whole fact tables.  The store holds
the marts as Parquet laid out for the query patterns:

* ``orders``            partitioned by ``order_month``, bucketed and sorted by order_id
* ``order_line_facts``  one row per order that has lines (count, short lines, value), laid out like
                        ``orders``: the two join without an exchange.  Lines are summed up per order before
                        they are dealt to buckets, so an order that holds a third of all lines is one row
* ``order_lines``       the lines, partitioned by the *order's* month
* ``inventory``         partitioned by ``inventory_month``
* ``purchase_orders``   partitioned by ``expected_month``
* ``stock_state``       the stock state (``operators.stock``) at month boundaries, rolled forward
* dimensions            plain Parquet

Rows are sorted by key within each output file, so Parquet row-group statistics
also prune by id.  Writes go through the standard committer (job-level commit;
failed tasks are retried), into a new path per version.  ``StoredMarts`` reads
the layout back with the same interface as ``Marts``; the ``*_in(start, end)``
methods add the partition filter that the range implies.  Bucketed tables are
known to the session's catalogue under a name made from their path; a session
that opens a store written by another one enters them again.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.operators import stock
from ordersight.operators.facts import as_date, line_facts
from ordersight.session import checkpoint_dir
from ordersight.sources.marts import Marts

_MONTH = "yyyy-MM"
_PARTITIONED = {
    "orders": ("order_month", "order_date", "order_id"),
    "inventory": ("inventory_month", "inventory_date", "product_id"),
    "purchase_orders": ("expected_month", "expected_delivery_date", "vendor_id"),
}
_BUCKETED = ("orders", "order_line_facts")
_DIMS = ("customers", "products", "warehouses", "vendors", "shipments")


#: Bytes and rows of a bucket over all months, at most about: a small table is one bucket, so its months are few
#: files.  A task sorts a bucket's rows, unpacked (some 150 bytes each): their number bounds its memory, as the
#: bytes of packed columns, a tenth of that or less, do not.
BUCKET_BYTES = 256 << 20
BUCKET_ROWS = 1 << 21
#: Spark's limit (spark.sql.sources.bucketing.maxBuckets).
MOST_BUCKETS = 100_000


def _buckets(df: DataFrame) -> int:
    """Buckets of a table of this size, by its rows and by Spark's own estimate of its bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, min(MOST_BUCKETS, max(size // BUCKET_BYTES, -(-df.count() // BUCKET_ROWS))))


def _by_order(m: Marts) -> DataFrame:
    """Line facts with their order's month; lines without an order are in the month ``unknown``."""
    months = m.orders.select("order_id", F.date_format("order_date", _MONTH).alias("order_month"))
    return line_facts(m).join(months, "order_id", "left").fillna({"order_month": "unknown"})


def _write_bucketed(df: DataFrame, part: str, key: str, base: str, name: str, buckets: int, mode: str) -> None:
    # Dealt like the buckets: a task writes one file per month of its own bucket.
    (df.repartition(buckets, key).write.mode(mode).partitionBy(part).bucketBy(buckets, key).sortBy(key)
     .option("path", f"{base}/{name}").saveAsTable(_table_name(base, name)))
    df.sparkSession.createDataFrame([(buckets, key)], "buckets int, key string").write.mode(mode).parquet(
        f"{base}/layout/{name}")


def _table_name(base: str, name: str) -> str:
    return f"store_{hashlib.md5(base.encode()).hexdigest()[:16]}_{name}"


def write_mart(m: Marts, base: str, name: str, mode: str = "errorifexists") -> None:
    """Write one table of the layout."""
    if name == "orders":
        df = m.orders.withColumn("order_month", F.date_format("order_date", _MONTH))
        _write_bucketed(df, "order_month", "order_id", base, name, _buckets(m.orders), mode)
    elif name == "order_line_facts":
        _write_bucketed(_by_order(m), "order_month", "order_id", base, name, _buckets(m.orders), mode)
    elif name == "order_lines":
        # Lines carry their order's month: one shuffle join at load time buys pruning for every later range query.
        months = m.orders.select("order_id", F.date_format("order_date", _MONTH).alias("order_month"))
        lines = m.order_lines.join(months, "order_id", "left").fillna({"order_month": "unknown"})
        (lines.repartitionByRange(F.col("order_month"), F.col("order_id"))
         .sortWithinPartitions("order_month", "order_id").write.mode(mode).partitionBy("order_month")
         .parquet(f"{base}/{name}"))
    elif name in _PARTITIONED:
        part, date_col, key = _PARTITIONED[name]
        month = F.date_format(date_col, _MONTH)
        # Range partitioning spreads one month over many tasks (no month-sized
        # task) and keeps keys sorted for row-group statistics.  The month is
        # added behind the shuffle, which then doesn't carry it.
        (m.mart(name).repartitionByRange(month, F.col(key)).withColumn(part, month).sortWithinPartitions(part, key)
         .write.mode(mode).partitionBy(part).parquet(f"{base}/{name}"))
    else:
        m.mart(name).write.mode(mode).parquet(f"{base}/{name}")


def write_store(m: Marts, path: str, mode: str = "errorifexists") -> str:
    """Write every table of the layout (but the stock state) under ``path``."""
    base = path.rstrip("/")
    for name in (*_PARTITIONED, "order_lines", "order_line_facts", *_DIMS):
        write_mart(m, base, name, mode)
    return base


_STORES: dict[tuple[str, str], StoredMarts] = {}


def stored(m: Marts) -> StoredMarts:
    """The store of a table folder under the shared checkpoint folder: each table is written once per session,
    when it is first asked for."""
    key = (m.spark.sparkContext.applicationId, m.root)
    if key not in _STORES:
        _STORES[key] = StoredMarts(m.spark, f"{checkpoint_dir(m.spark).rstrip('/')}/marts-{uuid.uuid4().hex}", m)
    return _STORES[key]


def _months(start, end) -> list[str]:
    s, e = as_date(start), as_date(end)
    out, y, mo = [], s.year, s.month
    while (y, mo) <= (e.year, e.month):
        out.append(f"{y:04d}-{mo:02d}")
        y, mo = (y + 1, 1) if mo == 12 else (y, mo + 1)
    return out


class StoredMarts(Marts):
    """``Marts`` over a store written by ``write_store``; with ``source``, tables are written on first use."""

    def __init__(self, spark: SparkSession, store_path: str, source: Marts | None = None):
        self.spark = spark
        self.root = store_path.rstrip("/")
        self.source = source
        self._ready: set[str] = set()

    def _path(self, name: str) -> str:
        if self.source is not None and name not in self._ready:
            write_mart(self.source, self.root, name)
            self._ready.add(name)
        return f"{self.root}/{name}"

    def _read(self, name: str, drop: str | None = None) -> DataFrame:
        df = self._bucketed(name) if name in _BUCKETED else self.spark.read.parquet(self._path(name))
        return df.drop(drop) if drop else df

    def _bucketed(self, name: str) -> DataFrame:
        path, table = self._path(name), _table_name(self.root, name)
        if not self.spark.catalog.tableExists(table):
            layout = self.spark.read.parquet(f"{self.root}/layout/{name}").first()
            df = self.spark.read.parquet(path)
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY (order_month) CLUSTERED BY "
                           f"({layout['key']}) SORTED BY ({layout['key']}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
            self.spark.sql(f"MSCK REPAIR TABLE {table}")
        return self.spark.table(table)

    @cached_property
    def customers(self) -> DataFrame:
        return self._read("customers")

    @cached_property
    def products(self) -> DataFrame:
        return self._read("products")

    @cached_property
    def warehouses(self) -> DataFrame:
        return self._read("warehouses")

    @cached_property
    def vendors(self) -> DataFrame:
        return self._read("vendors")

    @cached_property
    def shipments(self) -> DataFrame:
        return self._read("shipments")

    @cached_property
    def orders(self) -> DataFrame:
        return self._read("orders", "order_month")

    @cached_property
    def order_lines(self) -> DataFrame:
        return self._read("order_lines", "order_month")

    @cached_property
    def inventory(self) -> DataFrame:
        return self._read("inventory", "inventory_month")

    @cached_property
    def purchase_orders(self) -> DataFrame:
        return self._read("purchase_orders", "expected_month")

    def line_facts_in(self, start=None, end=None) -> DataFrame:
        """Line facts of orders dated in [start, end] (all without a range), bucketed like the orders."""
        df = self._read("order_line_facts")
        if start is not None:
            df = df.filter(F.col("order_month").isin(*_months(start, end)))
        return df.drop("order_month")

    def order_lines_in(self, start, end) -> DataFrame:
        """Lines of orders dated in [start, end]: partition-pruned to the months."""
        df = self._read("order_lines")
        return df.filter(F.col("order_month").isin(*_months(start, end))).drop("order_month")

    def mart_in(self, name: str, start, end) -> DataFrame:
        """A partitioned fact mart restricted to the months of [start, end]."""
        if name not in _PARTITIONED:
            return self.mart(name)
        part = _PARTITIONED[name][0]
        return self._read(name).filter(F.col(part).isin(*_months(start, end))).drop(part)

    # ---- stock state -------------------------------------------------------
    def stock_state(self, day, first=None, holidays: list[str] | None = None) -> DataFrame:
        """The stock state at ``day`` (the first of a month), kept in the store, for each list of holidays.

        It is rolled forward month by month from the latest one that the store has, each step reading one state
        and one month of snapshots; a store without one begins at ``first`` (default: ``day``) with the history."""
        day = as_date(day)
        if day.day != 1:
            raise ValueError("The stock state is kept at the first day of a month.")
        known = ",".join(sorted({as_date(h).isoformat() for h in holidays or []}))
        base = f"{self.root}/stock_state" + (f"_{hashlib.md5(known.encode()).hexdigest()[:8]}" if known else "")

        def kept(at: dt.date) -> DataFrame:
            return self.spark.read.parquet(f"{base}/as_of={at.isoformat()}")

        def keep(at: dt.date, state: DataFrame) -> None:
            state.write.mode("overwrite").parquet(f"{base}/as_of={at.isoformat()}")

        have = [d for d in self._state_days(base) if d <= day]
        at = max(have) if have else as_date(first or day)
        if not have:
            keep(at, stock.state_at(self, at, holidays=holidays))
        while at < day:
            following = (at + dt.timedelta(days=32)).replace(day=1)
            keep(following, stock.state_at(self, following, at, kept(at), holidays))
            at = following
        return kept(day)

    def _state_days(self, base: str) -> list[dt.date]:
        """Days of the states that were committed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/as_of=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [dt.date.fromisoformat(f.getPath().getParent().getName().split("=")[1]) for f in found or []]
