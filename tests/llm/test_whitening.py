"""Whitening against numpy's dense eigenvectors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from ordersight.llm import whitening as wh

from .messy import SF


def dense(vectors):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n = len(x)
    mean = np.array([int(s) / n for s in x.sum(axis=0)])
    c = x - mean
    e, u = np.linalg.eigh(c.T @ c / n)
    return x, mean, e[::-1], u[:, ::-1]


def compare(got, vectors, ids, tol=1e-6):
    x, mean, e, u = dense(vectors)
    n, total, sums = len(x), e.sum(), x.sum(axis=0)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert len(got) == n * min(8, x.shape[1]) and set(by) == set(ids)
    for k in range(1, min(8, x.shape[1]) + 1):
        want = (x - mean) @ u[:, k - 1] / math.sqrt(e[k - 1])
        have = np.array([by[i][k]["whitened"] for i in ids])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < tol
        assert abs(by[ids[0]][k]["explained"] - e[k - 1] / total) < 1e-9
    for row, i in zip(x, ids):
        r = by[i][1]
        assert r["deviation"] == sum((n * int(v) - int(s)) ** 2 for v, s in zip(row, sums)) and r["n"] == n
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = wh.op12_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


@pytest.mark.parametrize("kind", ["flat", "falling", "ties", "one large", "low rank"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(3)
    d = 90
    values = {"flat": 1 + 0.001 * np.arange(d), "falling": 0.8 ** np.arange(d) * 1e6,
              "ties": np.repeat([5.0, 4.0, 3.0], 30), "one large": np.r_[1e9, np.ones(d - 1) + np.arange(d - 1) * 1e-2],
              "low rank": np.r_[np.arange(1.0, 4.0), np.zeros(d - 3)]}[kind]
    u = np.linalg.qr(rng.standard_normal((d, d)))[0]
    v = (u * values) @ u.T
    calls = []
    e, q, residual = wh.eigenpairs(lambda x: (calls.append(1), v @ x)[1], d)
    want = np.sort(values)[::-1][:8]
    assert np.abs(e - want).max() <= 1e-11 * want[0] and residual <= wh.ACCEPT
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-12 and np.abs(v @ q - q * e).max() <= 1e-9 * want[0]
    assert len(calls) < 200


def test_filter_is_the_chebyshev_polynomial():
    values = np.array([0.5, 1.0, 2.0, 3.0, 7.0])
    got = wh.chebyshev(lambda x: values[:, None] * x, np.ones((5, 1)), 6, 0.5, 3.0, 7.0).ravel()
    t = np.polynomial.chebyshev.Chebyshev([0] * 6 + [1])
    want = t((values - 1.75) / 1.25)
    assert np.allclose(got / got[-1], want / want[-1]) and np.abs(got[:4]).max() < 1e-3 * abs(got[-1])


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.normal(size=3) * [9, 3, 1]], "x") for i in range(40)]
    good += [(None, [0.0, 0.0, 0.0], "x"), (3, good[3][1], "x"), (3, good[3][1], "x")]
    bad = [(100, None, "x"), (101, [], "x"), (102, [1.0, nan, 2.0], "x"), (103, [1.0, inf, 2.0], "x"),
           (104, [1.0, None, 2.0], "x"), (105, [1.0, 2.0], "x")]
    schema = "vec_id bigint, embedding array<float>, n string"
    df = spark.createDataFrame(good + bad, schema)
    got = wh.whiten(df).collect()
    assert len(got) == 3 * len(good) and {r["component"] for r in got} == {1, 2, 3}
    x, mean, e, u = dense([np.float32(r[1]) for r in good])
    for r in got:
        if r["id"] is None:
            want = (100_000 - mean) @ u[:, r["component"] - 1] / math.sqrt(e[r["component"] - 1])
            assert abs(abs(r["whitened"]) - abs(want)) < 1e-9
    assert wh.whiten(df.limit(0)).collect() == []
    same = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], schema)
    assert wh.whiten(same).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k], "") for k in range(9)], schema)
    assert {r["component"] for r in wh.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e30, 0.0], ""), (2, [-1e30, 0.0], ""), (3, [5.0, 1.0], "")], schema)
    assert {r["id"]: r["deviation"] for r in wh.whiten(huge).collect()}[1] is None
