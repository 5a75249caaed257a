"""Stock state at month boundaries, rolled forward.

The state of a (site, product) pair at a day is what later days need of all that
came before: its latest quantities, and the shortage run that is still open, if
any (first and last day, business days, lowest available).  ``state_at`` computes
it from a pair's snapshots since an earlier state, so a store keeps it once a
month and a query over a month reads that month and one state, not the history.

Snapshots hold until the pair's next one; all is computed over these spans.  The
state enters as two spans ahead of the snapshots: the open run as a whole, and the
quantities that hold on the first day.  A window holds one pair's spans, at most
one a day of the range.  All spans are shuffled once, by product: a task holds whole
products at all their sites.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.operators.facts import as_date, in_range
from ordersight.sources.marts import Marts

PAIR = ["warehouse_id", "product_id"]
STATE = (*PAIR, "quantity_on_hand", "quantity_allocated", "run_start", "run_end", "run_days", "run_lowest")
RUN = "struct<run_start:date,run_end:date,run_days:bigint,run_lowest:int>"
_MONDAY = dt.date(1970, 1, 5)


def _weekdays(holidays: list[str] | None) -> list[dt.date]:
    """The holidays that are weekdays, each once."""
    return sorted({as_date(h) for h in holidays or [] if as_date(h).weekday() < 5})


def business_day_ordinal(d: Column, holidays: list[str] | None = None) -> Column:
    """Business days (Monday to Friday but for the listed holidays) from a fixed Monday to the day before ``d``."""
    days = F.datediff(d, F.lit(_MONDAY))
    weeks = F.floor(days / 7)
    ordinal = weeks * 5 + F.least(days - weeks * 7, F.lit(5))
    for h in _weekdays(holidays):
        ordinal = ordinal - F.when(d > F.lit(h), 1).otherwise(0)
    return ordinal.cast("bigint")


def is_business_day(d: Column, holidays: list[str] | None = None) -> Column:
    ok = ~F.dayofweek(d).isin(1, 7)
    off = _weekdays(holidays)
    return ok & ~d.isin(*off) if off else ok


def next_business_day(d: Column, holidays: list[str] | None = None, step: int = 1) -> Column:
    """``d`` itself or the first business day after it (``step`` -1: before it)."""
    off = _weekdays(holidays)
    if not off:
        away = F.when(F.dayofweek(d) == 7, 2 if step > 0 else 1).when(F.dayofweek(d) == 1, 1 if step > 0 else 2)
        return F.date_add(d, F.coalesce(away, F.lit(0)) * step)
    days = F.sequence(d, F.date_add(d, step * (len(off) * 3 + 3)), F.expr(f"interval {step} day"))
    return F.get(F.filter(days, lambda x: is_business_day(x, holidays)), F.lit(0))


def snapshots_before(m: Marts, start, until) -> DataFrame:
    """Snapshots dated in [start, until); ``start`` None: all before ``until``."""
    if start is not None:
        return in_range(m, "inventory", "inventory_date", start, as_date(until) - dt.timedelta(days=1))
    return m.inventory.filter(F.col("inventory_date") < F.lit(as_date(until)))


def _spans(m: Marts, until, start=None, state: DataFrame | None = None, holidays=None) -> DataFrame:
    """(pair, place, on_hand, allocated, used, below, days, first_day, last_day, available, safety_stock, island) of
    spans in [start, until).  Spans that aren't ``used`` (no business day, or no such product) only tell quantities."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = snapshots_before(m, start if state is not None else None, until).select(
        *PAIR, F.struct(F.lit(2).alias("kind"), "inventory_date", F.col("inventory_id").cast("bigint").alias("id")).alias("place"),
        "quantity_on_hand", "quantity_allocated", none(RUN).alias("r"))
    if state is not None:
        at = lambda kind: F.struct(F.lit(kind).alias("kind"), F.lit(as_date(start)).alias("inventory_date"),
                                   none("bigint").alias("id")).alias("place")
        runs = state.filter("run_days > 0").select(
            *PAIR, at(0), none("int").alias("quantity_on_hand"), none("int").alias("quantity_allocated"),
            F.struct("run_start", "run_end", "run_days", "run_lowest").alias("r"))
        held = state.select(*PAIR, at(1), "quantity_on_hand", "quantity_allocated", none(RUN).alias("r"))
        rows = rows.unionByName(held).unionByName(runs)
    # Dealt by product, once: the windows, the join and the aggregates below all stay in this partitioning.
    rows = rows.repartition("product_id")
    past = Window.partitionBy("product_id", "warehouse_id").orderBy("place")
    day, run = F.col("place.inventory_date"), F.col("place.kind") == 0
    end = F.coalesce(F.lead("place.inventory_date", 1).over(past), F.lit(as_date(until)))
    held = rows.select(
        *PAIR, "place", "r", end.alias("end"),
        F.last("quantity_on_hand", ignorenulls=True).over(past).alias("on_hand"),
        F.last("quantity_allocated", ignorenulls=True).over(past).alias("allocated"))
    days = business_day_ordinal(F.col("end"), holidays) - business_day_ordinal(day, holidays)
    known = m.products.select("product_id", "safety_stock", F.lit(True).alias("known"))
    held = held.join(known, "product_id", "left").select(
        *PAIR, "place", "on_hand", "allocated", F.when(run, F.col("r.run_days")).otherwise(days).alias("days"),
        F.when(run, F.col("r.run_lowest")).otherwise(F.col("on_hand") - F.col("allocated")).alias("available"),
        F.when(run, F.col("r.run_start")).otherwise(next_business_day(day, holidays)).alias("first_day"),
        F.when(run, F.col("r.run_end")).otherwise(next_business_day(F.date_sub("end", 1), holidays, -1)).alias("last_day"),
        run.alias("run"), "safety_stock", "known")
    held = held.withColumn("used", F.coalesce(F.col("known") & (F.col("days") > 0), F.lit(False)))
    held = held.withColumn("below", F.col("used") & (
        F.col("run") | F.coalesce(F.col("available") < F.col("safety_stock"), F.lit(False)))).drop("run", "known")
    return held.withColumn("island", F.sum(F.when(F.col("used") & ~F.col("below"), 1).otherwise(0)).over(past))


def _runs(spans: DataFrame) -> DataFrame:
    """One row per (pair, island): the run of spans below safety stock that follows its opening span, if any, and the
    quantities of the newest span."""
    below = lambda c: F.when(F.col("below"), F.col(c))
    return spans.groupBy(*PAIR, "island").agg(
        F.min(below("first_day")).alias("run_start"), F.max(below("last_day")).alias("run_end"),
        F.sum(below("days")).alias("run_days"), F.min(below("available")).alias("run_lowest"),
        F.first("safety_stock").alias("safety_stock"),
        F.max_by(F.struct("on_hand", "allocated"), "place").alias("newest"))


def shortage_runs(m: Marts, start, end, min_days: int, state: DataFrame | None = None, holidays=None) -> DataFrame:
    """Runs of at least ``min_days`` business days below safety stock that touch [start, end], each from its first
    day however long before ``start``, as known at ``end``.

    With ``state`` (the stock state at ``start``) only snapshots of the range are read; without, the whole history."""
    until = as_date(end) + dt.timedelta(days=1)
    g = _runs(_spans(m, until, start, state, holidays))
    return g.filter((F.col("run_days") >= min_days) & (F.col("run_end") >= F.lit(as_date(start)))).select(
        *PAIR, "run_start", "run_end", F.col("run_days").alias("business_days"),
        F.col("run_lowest").alias("lowest_available"), F.col("safety_stock").alias("safety_stock_target"))


def state_at(m: Marts, until, start=None, state: DataFrame | None = None, holidays=None) -> DataFrame:
    """The stock state at ``until``, before that day's snapshots: from all earlier ones, or from an earlier state."""
    # A run is open if it is the pair's last one and its spans come after every span that isn't below.
    runs = _runs(_spans(m, until, start, state, holidays))
    last = runs.groupBy(*PAIR).agg(F.max_by(F.struct("newest", "run_start", "run_end", "run_days", "run_lowest"), "island")
                                   .alias("r"))
    # Without a site a pair has quantities, but no run that is carried on.
    run = [F.when(F.col("warehouse_id").isNotNull(), F.col(f"r.{c}")).alias(c) for c in STATE[4:]]
    return last.select(*PAIR, F.col("r.newest.on_hand").alias("quantity_on_hand"),
                       F.col("r.newest.allocated").alias("quantity_allocated"), *run)
