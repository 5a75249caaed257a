"""Engine-independent rounding and ratio helpers (Column expressions).

Percentages are computed in exact integer tenths and only then turned into a
double, so every engine (and every partitioning) gives the same value:
``tenths = (2000*n + d) div (2*d)`` is n/d*100 rounded half-up to 0.1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idiv(a: Column, b: Column) -> Column:
    """Integral division (SQL ``div``), exact for BIGINT operands."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def pct_tenths(n: Column, d: Column) -> Column:
    """Integer tenths of a percent, half-up; 0 when the denominator is 0."""
    n = F.coalesce(n.cast("bigint"), F.lit(0))
    d = F.coalesce(d.cast("bigint"), F.lit(0))
    return F.when(d > 0, idiv(n * 2000 + d, d * 2)).otherwise(F.lit(0).cast("bigint"))


def pct(n: Column, d: Column) -> Column:
    """Percentage with one decimal, half-up, zero-guarded (DOUBLE)."""
    return pct_tenths(n, d).cast("double") / 10.0


def avg_tenths_nonneg(total: Column, count: Column) -> Column:
    """Average of non-negative integers rounded half-up to 0.1, 0 if empty."""
    total = F.coalesce(total.cast("bigint"), F.lit(0))
    count = F.coalesce(count.cast("bigint"), F.lit(0))
    return F.when(count > 0, idiv(total * 20 + count, count * 2)).otherwise(F.lit(0).cast("bigint")).cast("double") / 10.0


def avg_signed_round1(total: Column, count: Column) -> Column:
    """Signed average rounded half away from zero to 0.1 (SQL ROUND); NULL if empty."""
    total = total.cast("bigint")
    count = count.cast("bigint")
    mag = idiv(F.abs(total) * 20 + count, count * 2)
    return F.when(count > 0, (F.signum(total).cast("bigint") * mag).cast("double") / 10.0)


def cents_to_amount(cents: Column) -> Column:
    """Exact money: BIGINT cents -> DOUBLE currency units."""
    return cents.cast("double") / 100.0


def flag(c: Column) -> Column:
    """Boolean -> 0/1 INT for conditional sums."""
    return F.when(c, F.lit(1)).otherwise(F.lit(0))
