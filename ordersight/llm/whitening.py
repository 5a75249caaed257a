"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 12).

The vectors' entries become integers, are written once as blocks of rows in
binary form, and the covariance V is never formed: every product V Q is a pass
over the blocks in which a task centres its rows and adds up (x - m)'((x - m) Q);
only one such matrix per task leaves it, entry by entry, and Spark sums the
entries.  A few passes of a small block Krylov space bound the spectrum.  Then, in
turn, Rayleigh-Ritz on the block's span gives Ritz pairs, and a Chebyshev
polynomial in V, by its three-term recurrence, damps the interval from the lower
bound to the block's smallest Ritz value, where the unwanted spectrum lies; QR
makes the block orthonormal again.  The pairs are certified when the residuals
|V u - e u| of the wanted ones are at the level of rounding and none of the
Krylov space's Ritz values exceeds the largest.  The block is wider than what is
wanted, so equal or close eigenvalues at the border do not slow it down.

The driver holds matrices of dimensions x block width; nothing that grows with
the rows.  Counts and sums are exact integers.

Defined cases: vectors that are null, empty, or hold a null or non-finite entry
are dropped, as are those of another length than the most frequent one (ties: the
longer); a null id is kept; rows that repeat count each; entries beyond 2**52 are
set to that; a component whose eigenvalue is not above 1e-11 of the largest has
nothing to whiten and is left out (equal vectors: an empty result); a deviation
beyond a long is null; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col, table, written

COMPONENTS = 8
#: Columns of the block beside the wanted ones.
GUARD = 24
DEGREE = 8
SCALE, SHIFT = 1024, 100_000
LARGEST = 1 << 52
BLOCK_BYTES = 1 << 20
#: Residuals over the largest eigenvalue: what is aimed at, and what is accepted once they stop falling.
AIM, ACCEPT = 2e-14, 1e-11
OUT = ("id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v array<double>) of the vectors that take part, and their length."""
    rows = vectors.select(col(id_col).cast("bigint").alias("id"), col(vec_col).cast("array<double>").alias("v")).where(
        "v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x)"
        " AND abs(x) < double('infinity'))")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    d = size["n"] if size else 0
    return rows.where(F.size("v") == d), d


def integers(v: pa.Array, d: int) -> np.ndarray:
    c = np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * c) + SHIFT, -LARGEST, LARGEST).astype(np.int64)


def blocks(rows: DataFrame, d: int) -> DataFrame:
    """(m, data, high, low): blocks of m rows of integers, and exact sums as high * 2**32 + low."""
    most = max(1, min(4096, BLOCK_BYTES // (8 * d)))

    def run(batches):
        for batch in batches:
            x = integers(batch.column("v"), d)
            out = []
            for s in range(0, len(x), most):
                part = x[s:s + most]
                out.append((len(part), part.astype("<i8").tobytes(), (part >> 32).sum(axis=0).tolist(),
                            (part & 0xFFFFFFFF).sum(axis=0).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.binary()),
                     pa.array([o[2] for o in out], pa.list_(pa.int64())),
                     pa.array([o[3] for o in out], pa.list_(pa.int64()))], ["m", "data", "high", "low"])

    return written(rows.select("v").mapInArrow(run, "m int, data binary, high array<long>, low array<long>"),
                   "whitening-blocks")


class Covariance:
    """The covariance of the blocks' rows as an operator: every product is one pass."""

    def __init__(self, data: DataFrame, d: int):
        self.data, self.d, self.passes = data.select("m", "data"), d, 0
        self.n = int(data.agg(F.sum("m")).first()[0] or 0)
        sums = data.select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "s")).groupBy("at").agg(
            F.sum(F.col("s.high").cast("decimal(38,0)")).alias("high"),
            F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low")).collect()  # one row per dimension
        self.sums = [0] * d
        for r in sums:
            self.sums[r["at"]] = int(r["high"]) * (1 << 32) + int(r["low"])
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(d)
        self.trace = None

    def _pass(self, work) -> np.ndarray:
        """Sum over all blocks of the vector that ``work`` makes of a block's centred rows."""
        d, mean = self.d, self.mean

        def run(batches):
            total = None
            for batch in batches:
                for data in batch.column("data"):
                    x = np.frombuffer(data.as_buffer(), "<i8").reshape(-1, d) - mean
                    part = work(x)
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                                 ["at", "y"])

        self.passes += 1
        rows = self.data.select("data").mapInArrow(run, "at int, y double").groupBy("at").agg(F.sum("y").alias("y"))
        out = {r["at"]: r["y"] for r in rows.collect()}  # as many as the product has entries
        return np.array([out[k] for k in range(len(out))])

    def __call__(self, q: np.ndarray) -> np.ndarray:
        y = self._pass(lambda x: np.append((x.T @ (x @ q)).ravel(), (x * x).sum())) / self.n
        self.trace = float(y[-1])
        return y[:-1].reshape(q.shape)

    def identity_error(self, w: np.ndarray) -> float:
        """Largest entry of the covariance of the rows projected on ``w``, less the identity."""
        k = w.shape[1]

        def work(x):
            z = x @ w
            return np.append((z.T @ z).ravel(), z.sum(axis=0))

        y = self._pass(work) / self.n
        c = y[:k * k].reshape(k, k) - np.outer(y[k * k:], y[k * k:])
        return float(np.abs(c - np.eye(k)).max())


def spectrum(apply, d: int, rng, width: int = 4, steps: int = 4):
    """(low, high, basis): bounds of the spectrum from a block Krylov space, its Ritz vectors by falling value."""
    q = np.linalg.qr(rng.standard_normal((d, min(width, d))))[0]
    basis, images = np.zeros((d, 0)), np.zeros((d, 0))
    for _ in range(steps):
        basis, images = np.hstack([basis, q]), np.hstack([images, apply(q)])
        q = images[:, -q.shape[1]:]
        for _ in range(2):
            q = q - basis @ (basis.T @ q)
        size = np.linalg.norm(images) or 1.0
        q, r = np.linalg.qr(q)
        q = q[:, np.abs(np.diag(r)) > 1e-10 * size]   # directions that are new
        for _ in range(2):
            q = q - basis @ (basis.T @ q)
        q = np.linalg.qr(q)[0] if q.shape[1] else q
        if not q.shape[1]:
            break
    t = basis.T @ images
    e, z = np.linalg.eigh((t + t.T) / 2)
    rest = np.linalg.norm(images @ z[:, 0] - e[0] * (basis @ z[:, 0]))
    return max(0.0, e[0] - rest), e[-1], (basis @ z)[:, ::-1]


def chebyshev(apply, q: np.ndarray, degree: int, low: float, cut: float, high: float) -> np.ndarray:
    """p(V) q with the Chebyshev polynomial of [low, cut], scaled to stay near 1 at ``high``."""
    half, centre = (cut - low) / 2, (cut + low) / 2
    s = first = half / (high - centre)
    before, now = q, (apply(q) - centre * q) * (s / half)
    for _ in range(degree - 1):
        t = 1 / (2 / first - s)
        before, now = now, (apply(now) - centre * now) * (2 * t / half) - (s * t) * before
        s = t
    return now


def _growth(at: float, low: float, cut: float) -> float:
    """Factor by which the polynomial grows at ``at`` with each degree."""
    x = max(1.0, (2 * at - cut - low) / (cut - low))
    return x + np.sqrt(x * x - 1)


def _less(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """``x`` without its part along the orthonormal ``held``."""
    return x - held @ (held.T @ x)


def eigenpairs(apply, d: int, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, seed: int = 7,
               rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, residual) of the ``wanted`` largest eigenvalues of a positive semidefinite operator."""
    rng = np.random.default_rng(seed)
    wanted, width = min(wanted, d), min(wanted + guard, d)
    low, high, start = spectrum(apply, d, rng)
    if high <= 0:
        return np.zeros(0), np.zeros((d, 0)), 0.0
    start = start[:, :wanted]
    q = np.linalg.qr(np.hstack([start, rng.standard_normal((d, width - min(width, start.shape[1])))])[:, :width])[0]
    was = np.inf
    for _ in range(rounds):
        y = apply(q)
        h = q.T @ y
        e, z = np.linalg.eigh((h + h.T) / 2)
        e, z = e[::-1], z[:, ::-1]
        u = q @ z
        rest = np.linalg.norm((y @ z - u * e)[:, :wanted], axis=0) / e[0]
        worst = float(rest.max())
        seen = e[0] >= high * (1 - 1e-9)
        if seen and (worst <= AIM or (worst <= ACCEPT and worst > was / 2)):
            return e[:wanted], u[:, :wanted], worst
        was = worst
        done = int(np.argmax(np.append(rest > AIM, True))) if seen else 0  # leading pairs that have settled
        done = min(done, wanted - 1)
        cut = max(e[-1], low + 1e-9 * e[done])
        top = max(e[done], cut * (1 + 1e-9), 0 if done else high)
        rate = _growth(top, low, cut) / _growth(max(e[wanted - 1], cut), low, cut)
        # No direction may outgrow the last wanted one beyond what orthogonalising can tell apart.
        times = int(min(degree, max(1.0, np.log(1e6) / np.log(rate) if rate > 1 else degree)))
        held = u[:, :done]
        q = chebyshev(lambda x: _less(apply(x), held), _less(u[:, done:], held), times, low, cut, top)
        q = np.linalg.qr(np.hstack([held, q]))[0]
    raise RuntimeError(f"residual {worst:.1e} after {rounds} rounds of the subspace iteration")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row per vector and component."""
    rows, d = usable(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    if not d:
        return spark.createDataFrame([], OUT)
    cov = Covariance(blocks(rows, d), d)
    e, u, _ = eigenpairs(cov, d, components)
    keep = e > 1e-11 * (e[0] if len(e) else 0)
    e, u = e[keep], u[:, keep]
    k = len(e)
    if not k:
        return spark.createDataFrame([], OUT)
    u = u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(k)])
    w = u / np.sqrt(e)
    explained, error, mean, n = e / cov.trace, cov.identity_error(w), cov.mean, cov.n
    total = np.array(cov.sums, object)

    def deviations(x: np.ndarray) -> list:
        most = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
        if most < 1 << 62:
            far = n * x - total.astype(np.int64)
            if float(np.abs(far).max(initial=0)) ** 2 * d < 2.0 ** 62:
                return (far * far).sum(axis=1).tolist()
        far = n * x.astype(object) - total
        return [v if v < 1 << 63 else None for v in (far * far).sum(axis=1)]

    def run(batches):
        for batch in batches:
            x = integers(batch.column("v"), d)
            m = len(x)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * k, n, np.int64)), pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                 pa.array(((x - mean) @ w).ravel()), pa.array(np.tile(explained, m)),
                 pa.array(np.full(m * k, error))], [c.split()[0] for c in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
