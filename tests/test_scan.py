"""The ordered scan against plain Python, whatever the number of partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ordersight.functions.scan import ordered_scan


def plain(rows, gap):
    """rows of (key, time, amount) -> sorted rows with seq, running amount, previous amount, session."""
    out, state = [], {}
    for k, t, a in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] is not None, r[2] or 0)):
        s = state.setdefault(k, [0, 0, None, None, 1])
        if s[0] and t - s[3] > gap:
            s[4] += 1
        out.append((k, t, a, s[0] + 1, s[1] + (a or 0), s[2], s[4]))
        state[k] = [s[0] + 1, s[1] + (a or 0), a, t, s[4]]
    return out


@pytest.mark.parametrize("parts", [1, 3, 7, 40])
def test_ordered_scan_against_plain_code(spark, parts):
    rng = random.Random(parts)
    keys = ["hot"] * 6 + ["a", "b", "", None]
    rows = [(rng.choice(keys), rng.randrange(400), rng.choice([None, 1, 2, 5])) for _ in range(700)]
    rows += [("hot", 7, 1)] * 150  # copies of one row
    df = spark.createDataFrame(rows, "k string, t bigint, a bigint").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered_scan(df, ["k"], ["t", "a"], "seq", {"total": F.col("a")}, ["a"], session=("round", "t", 3))
        assert got.columns == ["k", "t", "a", "seq", "total", "previous_a", "round"]
        got = [tuple(r) for r in got.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = lambda r: (r[0] is not None, r[0] or "", r[3])
    assert sorted(got, key=order) == sorted(plain(rows, 3), key=order)


def test_ordered_scan_small_and_empty(spark):
    df = spark.createDataFrame([(1, 5, "x")], "k int, t bigint, ab string")
    assert [tuple(r) for r in ordered_scan(df, ["k"], ["t"], "n", lag=["ab"]).collect()] == [(1, 5, "x", 1, None)]
    assert ordered_scan(df.limit(0), ["k"], ["t"], "n").collect() == []
    two = ordered_scan(df.union(df), ["k", "ab"], ["t"], "n")
    assert sorted(r["n"] for r in two.collect()) == [1, 2]
