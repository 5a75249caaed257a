"""Zone-free times of trace rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts_col: str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ column, independent of
    the session time zone (no DST shifts)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, F.col(ts_col).cast("timestamp_ntz"))
