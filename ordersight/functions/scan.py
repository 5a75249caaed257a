"""One ordered pass over range-partitioned rows, with one carried row per partition.

``ordered_scan`` numbers rows, sums values, looks back one row and counts
sessions per key without a window that holds a key.  Rows are dealt by range of
(keys, order) -- a hot key spreads over as many partitions as its rows need --
and sorted inside a partition.  A partition is then passed once, in Arrow
batches: whatever is wanted is computed from the rows before in the *same*
partition, and the result is written.  Only a partition's first key can have
begun earlier, so what is missing is one row per partition: the totals of that
key over the partitions before, taken from the first and the last row of each
partition.  It is added where a row belongs to its partition's first key.

The input is read twice only to sample range bounds; its rows are shuffled once
and never joined back.  The written table cuts the lineage: a lost executor
repeats its own tasks.  Rows that agree in keys and order are interchangeable
and are dealt by their place in the input, so copies of one row spread as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.sources.scratch import written


def _codes(column: pa.Array) -> np.ndarray:
    """Integers that are equal where values are (nulls among them)."""
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


class _Pass:
    """State of one partition's pass."""

    def __init__(self, keys, sums, lag, gap):
        self.keys, self.sums, self.lag, self.gap = keys, sums, lag, gap
        self.last = None          # last row of the batch before, as length-1 arrays
        self.seq = 0              # rows of the current key so far
        self.total = dict.fromkeys(sums, 0)
        self.breaks = 0           # session breaks of the current key so far
        self.one_key = True       # still in the partition's first key

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        same = np.zeros(n, bool)  # row has its predecessor's key
        same[1:] = True
        for k in self.keys:
            code = _codes(batch.column(k))
            same[1:] &= code[1:] == code[:-1]
        if self.last is not None:
            same[0] = all(self.last[k][0].as_py() == batch.column(k)[0].as_py() for k in self.keys)
        head = self.last is None
        starts = np.flatnonzero(~same)
        at = np.arange(n)
        group = np.searchsorted(starts, at, side="right")       # 0: continues the batch before
        begin = np.where(group > 0, np.r_[0, starts][group], 0)

        def running(values: np.ndarray, before: int) -> np.ndarray:
            c = np.cumsum(values)
            return c - np.where(group > 0, (c - values)[begin], 0) + np.where(group > 0, 0, before)

        out = {"_seq": running(np.ones(n, np.int64), self.seq)}
        for name in self.sums:
            out[f"_sum_{name}"] = running(batch.column(name).to_numpy(zero_copy_only=False), self.total[name])
        if self.gap:
            t = batch.column(self.gap[0]).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.r_[self.last[self.gap[0]][0].as_py() if self.last is not None else 0, t[:-1]]
            out["_breaks"] = running((same & (t - before > self.gap[1])).astype(np.int64), self.breaks)
        first_key = np.full(n, self.one_key) & (group <= (1 if head else 0))
        arrays = [batch.column(i) for i in range(batch.num_columns)] + [pa.array(v, pa.int64()) for v in out.values()]
        names = batch.schema.names + list(out)
        for name in self.lag:
            c = batch.column(name)
            wide = pa.concat_arrays([self.last[name] if self.last is not None else pa.nulls(1, c.type), c])
            arrays.append(wide.take(pa.array(at, mask=~same)))
            names.append(f"_lag_{name}")
        arrays.append(pa.array(first_key))
        names.append("_first")
        if n:
            self.last = {k: batch.column(k).slice(n - 1, 1) for k in
                         {*self.keys, *self.lag, *([self.gap[0]] if self.gap else [])}}
            self.seq = int(out["_seq"][-1])
            self.total = {k: int(out[f"_sum_{k}"][-1]) for k in self.sums}
            self.breaks = int(out["_breaks"][-1]) if self.gap else 0
            self.one_key = bool(first_key[-1])
        return pa.RecordBatch.from_arrays(arrays, names)


def ordered_scan(df: DataFrame, keys: list[str], order: list[str], seq: str | None = None,
                 sums: dict[str, Column] | None = None, lag: list[str] | None = None, prefix: str = "previous_",
                 session: tuple[str, str, int] | None = None) -> DataFrame:
    """``df`` with running values per key in ``order`` (ascending, nulls first).

    ``seq``: name of the 1-based row number.  ``sums``: inclusive running sums by
    name (null counts 0, BIGINT).  ``lag``: columns whose value one row before is
    added under ``prefix``.  ``session`` = (name, BIGINT time column, gap): 1-based
    number of the session, a new one where the time is more than ``gap`` later than
    one row before (the time may not be null).
    """
    sums, lag = sums or {}, lag or []
    own = [f"_v_{k}" for k in sums]
    base = df.select("*", *[F.coalesce(e, F.lit(0)).cast("bigint").alias(f"_v_{k}") for k, e in sums.items()],
                     F.monotonically_increasing_id().alias("_place"))
    dealt = [F.col(f"`{c}`").asc_nulls_first() for c in [*keys, *order]] + [F.col("_place")]
    gap = (session[1], session[2]) if session else None
    fields = [*base.schema.fields, T.StructField("_seq", T.LongType()),
              *[T.StructField(f"_sum_{k}", T.LongType()) for k in own],
              *([T.StructField("_breaks", T.LongType())] if gap else []),
              *[T.StructField(f"_lag_{c}", df.schema[c].dataType) for c in lag],
              T.StructField("_first", T.BooleanType()), T.StructField("_part", T.IntegerType()),
              T.StructField("_edge", T.IntegerType())]
    fields = [T.StructField(f.name, f.dataType) for f in fields]

    def run(batches):
        step, part, held, first = _Pass(keys, own, lag, gap), TaskContext.get().partitionId(), None, True

        def done(batch, last):
            nonlocal first
            edge = np.zeros(batch.num_rows, np.int32)  # bit 1: first row of the partition, bit 2: last
            edge[0] |= int(first)
            edge[-1] |= 2 * int(last)
            first = False
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(edge)],
                [*batch.schema.names, "_part", "_edge"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield done(held, False)
            held = step(batch)
        if held is not None:
            yield done(held, True)

    local = written(base.repartitionByRange(*dealt).sortWithinPartitions(*dealt).mapInArrow(run, T.StructType(fields)),
                    "ordered-scan")
    carry = _carry(local, keys, own, lag, gap)
    out = local.join(carry, "_part", "left")
    first, carried = F.col("_first"), (lambda c: F.coalesce(F.col(c), F.lit(0)))

    def whole(name: str) -> Column:
        return F.col(name) + F.when(first, carried(f"_c{name}")).otherwise(0)

    columns = [F.col(f"`{c}`") for c in df.columns]
    if seq:
        columns.append(whole("_seq").alias(seq))
    columns += [whole(f"_sum__v_{k}").alias(k) for k in sums]
    for n, c in enumerate(lag):
        begins = first & (F.col("_seq") == 1)
        columns.append(F.when(begins, F.col(f"_c_last.v{n}")).otherwise(F.col(f"`_lag_{c}`")).alias(prefix + c))
    if session:
        columns.append((1 + whole("_breaks")).alias(session[0]))
    return out.select(*columns)


def _carry(local: DataFrame, keys, own, lag, gap) -> DataFrame:
    """One row per partition: totals and last row of its first key over the partitions before."""
    key = [F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]
    totals = ["_seq", *[f"_sum_{k}" for k in own], *(["_breaks"] if gap else [])]
    time = F.col(f"`{gap[0]}`") if gap else F.lit(None).cast("bigint")
    last = F.struct(F.col("_part"), *[F.col(f"`{c}`").alias(f"v{n}") for n, c in enumerate(lag)])

    def ends(bit: int) -> DataFrame:
        tail = F.lit(bit == 2)
        return local.where(F.col("_edge").bitwiseAND(bit) > 0).select(
            *key, "_part", tail.alias("tail"), time.alias("time"), F.when(tail, last).alias("last"),
            *[F.when(tail, F.col(c)).otherwise(0).alias(c) for c in totals])

    rows = ends(1).unionByName(ends(2))
    names = [f"k{n}" for n in range(len(keys))]
    before = Window.partitionBy(*names).orderBy("_part").rangeBetween(Window.unboundedPreceding, -1)
    until = Window.partitionBy(*names).orderBy("_part").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", F.last("last", ignorenulls=True).over(before).alias("_c_last"),
                       F.last(F.when(F.col("tail"), F.col("time")), ignorenulls=True).over(before).alias("time_before"),
                       *[F.sum(c).over(before).alias(f"_c{c}") for c in totals])
    if gap:
        opens = F.coalesce(~F.col("tail") & (F.col("time") - F.col("time_before") > gap[1]), F.lit(False))
        rows = rows.withColumn("opens", opens.cast("bigint"))
        rows = rows.withColumn("_c_breaks", F.coalesce("_c_breaks", F.lit(0)) + F.sum("opens").over(until))
    return rows.where("NOT tail").select("_part", "_c_last", *[f"_c{c}" for c in totals])
