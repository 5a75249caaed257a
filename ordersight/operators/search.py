"""Exact cosine top-k search over a ball index (X7, X8, J9, W2) and search-hit shaping.

The index is cut into balls: every row belongs to the nearest of a bounded number
of centres, and a ball knows its centre, its rows and its radius (the largest
angle between centre and row).  No row of a ball is nearer to a query than the
ball's border, so ``angle(query, centre) - radius`` bounds its similarity from
above.  A query starts with the k-th best similarity among the rows of a bounded
sample, which are candidates like any other, and skips every ball whose bound is
below it: what is left out cannot be among the k best.  ``blocks_read`` reports
how many balls each query reads.

Balls are cut into cells of ``CELL`` rows.  Index rows and the probes of a cell
meet in one sorted stream, rows first: a task holds one cell, lets the probes pass
in batches, multiplies them tile by tile and returns at most k rows per probe, none
below what the query started with.  Queries are dealt to blocks, whose number
follows from their count, and each block has its own copy of the stream.  The
driver holds the centres and one (rows, radius) per ball; nothing is broadcast
that grows with the index or the queries.

Similarity is rounded to 6 decimals before ranking so that engines that sum
in a different order rank identically; ties go to the lower index id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.functions.text import collapse_ws
from ordersight.session import bounded_batches
from ordersight.sources.scratch import written

TILE = 1024               # probes of one product
CELL = 4096               # index rows that a task holds
PROBES = 1 << 16          # queries of a block, about
SAMPLE = 4096             # rows that centres and starting similarities come from
SAMPLE_VALUES = 1 << 20   # fewer for long vectors
BALL_ROWS = 512           # rows of a ball, as long as there are fewer than MAX_BALLS
MAX_BALLS = 1024
ZERO = -1                 # the ball of zero vectors: similarity 0 to everything
SIM_SCALE = 1_000_000.0   # similarity is reported in exact micro-units


def validate_search_args(query: str | None = None, top_k: int = 3, min_similarity: float = -1.0) -> None:
    """Query 1-4000 characters, top_k integer 1-50, floor in [-1, 1]."""
    if query is not None and (not isinstance(query, str) or not query.strip()):
        raise ValueError("query must be a non-empty string.")
    if query is not None and len(query) > 4000:
        raise ValueError("query must not exceed 4000 characters.")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 50:
        raise ValueError("topK must be an integer between 1 and 50.")
    if not isinstance(min_similarity, (int, float)) or not math.isfinite(min_similarity) \
            or not -1 <= min_similarity <= 1:
        raise ValueError("minSimilarity must be a finite number between -1 and 1.")


def _matrix(vectors, what: str) -> np.ndarray:
    if any(v is None for v in vectors) or len({len(v) for v in vectors}) > 1:
        raise ValueError("Embedding dimensions do not match.")
    out = np.asarray(np.stack(list(vectors)), dtype=np.float64)
    if not np.isfinite(out).all():
        raise ValueError(f"{what} contains an invalid embedding vector.")
    return out


def _arrow_matrix(column: pa.Array, what: str) -> np.ndarray:
    sizes = np.unique(column.value_lengths().to_numpy(zero_copy_only=False)) if not column.null_count else []
    if len(sizes) != 1:
        raise ValueError("Embedding dimensions do not match.")
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(sizes[0]))
    if not np.isfinite(out).all():
        raise ValueError(f"{what} contains an invalid embedding vector.")
    return out


def _unit(mat: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero (their similarity is 0)."""
    norm = np.sqrt(np.einsum("ij,ij->i", mat, mat))[:, None]
    return np.divide(mat, norm, out=np.zeros_like(mat), where=norm > 0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Balls:
    """Centres, and the ball of each row; the radii are known once the rows were seen."""

    def __init__(self, sample: np.ndarray, count: int):
        """``sample``: unit rows; ``count``: balls wanted.  Spherical k-means."""
        rng = np.random.default_rng(5)
        at = sample[rng.choice(len(sample), min(count, len(sample)), replace=False)] if len(sample) else sample
        for _ in range(8 if len(sample) else 0):
            near = (sample @ at.T).argmax(axis=1)
            total = np.zeros_like(at)
            np.add.at(total, near, sample)
            moved = _unit(total)
            at = np.where(np.any(moved, axis=1, keepdims=True), moved, at)
        self.centres = at
        self.radius = np.zeros(len(at))
        self.rows = np.zeros(len(at) + 1, np.int64)     # the last one: zero vectors

    def assign(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ball, angle to its centre) of unit rows."""
        if not len(self.centres):
            return np.full(len(unit), ZERO), np.zeros(len(unit))
        cosine = unit @ self.centres.T
        near = cosine.argmax(axis=1)
        zero = ~unit.any(axis=1)
        return np.where(zero, ZERO, near), np.where(zero, 0.0, _angle(cosine[np.arange(len(unit)), near]))

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """Upper bounds of the similarity of queries to the rows of each ball (the last column: zero vectors)."""
        away = _angle(unit @ self.centres.T) - self.radius if len(self.centres) else np.zeros((len(unit), 0))
        bound = np.cos(np.maximum(away, 0.0))
        bound[~unit.any(axis=1)] = 0.0
        return np.hstack([bound, np.zeros((len(unit), 1))])


class Plan:
    """What a query starts with, and which balls it has to read: all that the tasks need of an index."""

    def __init__(self, balls: Balls, ids: list, sample: np.ndarray):
        self.balls, self.sample = balls, sample
        self.places: dict = {}
        for n, i in enumerate(ids):
            self.places.setdefault(i, []).append(n)

    def __call__(self, vectors: list, own: list, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """(starting similarity in micro-units, balls to read) of queries."""
        unit = _unit(_matrix(vectors, "Query"))
        if len(self.sample) and unit.shape[1] != self.sample.shape[1]:
            raise ValueError("Embedding dimensions do not match.")
        sims = unit @ self.sample.T if len(self.sample) else np.zeros((len(unit), 0))
        for n, o in enumerate(own):
            if o in self.places:
                sims[n, self.places[o]] = -np.inf
        start = np.full(len(unit), -np.inf)
        if sims.shape[1] >= k:
            best = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            start = np.where(np.isfinite(best), np.round(best * SIM_SCALE), -np.inf)
        start = np.maximum(start, math.floor(floor * SIM_SCALE))
        # One micro-unit of slack covers the rounding of both sides.
        return start, (self.balls.bounds(unit) * SIM_SCALE + 1 >= start[:, None]) & (self.balls.rows > 0)


class BallIndex:
    """An index of vectors for exact search."""

    def __init__(self, index: DataFrame, id_col: str = "id", vec_col: str = "embedding", ball_rows: int = BALL_ROWS,
                 cell: int = CELL, sample: int = SAMPLE, probes: int = PROBES):
        bounded_batches(index.sparkSession)
        self.id_col, self.cell, self.probes = id_col, cell, probes
        self.carry = [f for f in index.schema.fields if f.name != vec_col]
        self.names = [f.name for f in self.carry]
        self.rows = written(index.select(*[F.col(f"`{n}`") for n in self.names],
                                         F.col(f"`{vec_col}`").cast("array<double>").alias("_v")), "ball-index")
        count = self.rows.count()
        one = self.rows.select(F.size("_v").alias("n")).first()
        most = max(256, min(sample, SAMPLE_VALUES // max(1, one["n"] or 1))) if one else 0
        picked = self.rows.select(F.col(f"`{id_col}`").alias("i"), "_v").orderBy(F.xxhash64("i"), "i").limit(most).collect()
        near = _unit(_matrix([r["_v"] for r in picked], "Index")) if picked else np.zeros((0, 1))
        self.balls = Balls(near[near.any(axis=1)], min(MAX_BALLS, max(1, count // ball_rows)))
        balls = self.balls

        def seen(batches):
            for batch in batches:
                if batch.num_rows:
                    ball, angle = balls.assign(_unit(_arrow_matrix(batch.column("_v"), "Index")))
                    found, at = np.unique(ball, return_inverse=True)
                    widest = np.zeros(len(found))
                    np.maximum.at(widest, at, angle)
                    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.bincount(at)),
                                                      pa.array(widest)], ["ball", "n", "radius"])

        # One row per ball of the bounded number of balls.
        for r in (self.rows.select("_v").mapInArrow(seen, "ball int, n long, radius double").groupBy("ball")
                  .agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).collect()):
            balls.rows[r["ball"]] = r["n"]
            if r["ball"] != ZERO:
                balls.radius[r["ball"]] = r["radius"] + 1e-9
        slices = np.maximum(1, -(-balls.rows // cell))
        self.first, self.slices = np.cumsum(slices) - slices, slices
        self.plan = Plan(balls, [r["i"] for r in picked], near)

    def blocks_read(self, queries: DataFrame, k: int = 3, min_similarity: float = -1.0, query_id_col: str = "query_id",
                    query_vec_col: str = "embedding", own_col: str | None = None) -> DataFrame:
        """(query_id, blocks, blocks_read): balls that hold rows, and those that the search reads."""
        blocks, wanted = int((self.balls.rows > 0).sum()), self.plan

        def run(batches):
            for pdf in batches:
                if len(pdf):
                    _, read = wanted(pdf["v"].tolist(), pdf["own"].tolist(), k, min_similarity)
                    yield pd.DataFrame({"query_id": pdf["q"], "blocks": blocks, "blocks_read": read.sum(axis=1)})

        return self._asked(queries, query_id_col, query_vec_col, own_col).mapInPandas(
            run, "query_id long, blocks long, blocks_read long")

    def _asked(self, queries, query_id_col, query_vec_col, own_col) -> DataFrame:
        kind = next(f.dataType for f in self.carry if f.name == self.id_col)
        own = F.col(f"`{own_col}`") if own_col else F.lit(None)
        return queries.select(F.col(f"`{query_id_col}`").cast("long").alias("q"), own.cast(kind).alias("own"),
                              F.col(f"`{query_vec_col}`").cast("array<double>").alias("v"))

    def search(self, queries: DataFrame, k: int = 3, min_similarity: float = -1.0, query_id_col: str = "query_id",
               query_vec_col: str = "embedding", own_col: str | None = None) -> DataFrame:
        """For every query the k most similar index rows with similarity >= the floor: query_id, rank, the index
        columns (without the vector), similarity.  ``own_col``: an index id (not null) that the query itself never
        finds."""
        validate_search_args(None, k, min_similarity)
        balls, first, slices, wanted, names, id_col = (self.balls, self.first, self.slices, self.plan, self.names,
                                                       self.id_col)
        asked = written(self._asked(queries, query_id_col, query_vec_col, own_col), "queries")
        blocks = max(1, -(-asked.count() // self.probes))
        kind = next(f.dataType for f in self.carry if f.name == id_col)

        @F.pandas_udf("int")
        def cell_of(v: pd.Series, h: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype="int32")
            ball, _ = balls.assign(_unit(_matrix(v.tolist(), "Index")))
            return pd.Series((first[ball] + h.to_numpy() % slices[ball]).astype(np.int32))

        def probes(batches):
            for pdf in batches:
                for s in range(0, len(pdf), 64):
                    part = pdf.iloc[s:s + 64]
                    start, read = wanted(part["v"].tolist(), part["own"].tolist(), k, min_similarity)
                    q, ball = np.nonzero(read)
                    q, cell = np.repeat(q, slices[ball]), np.concatenate(
                        [np.arange(first[b], first[b] + slices[b]) for b in ball] or [np.zeros(0, np.int64)])
                    # The cells grow with the index: a query's vector is copied for some of them at a time.
                    for t in range(0, len(q), CELL):
                        out = part.iloc[q[t:t + CELL]].copy()
                        out["cell"], out["start"] = cell[t:t + CELL].astype(np.int32), start[q[t:t + CELL]]
                        yield out[["cell", "q", "own", "start", "v"]]

        schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("q", T.LongType()),
                               T.StructField("own", kind), T.StructField("start", T.DoubleType()),
                               T.StructField("v", T.ArrayType(T.DoubleType()))])
        carried = [F.col(f"`{f.name}`") for f in self.carry]
        stream = self.rows.select(
            cell_of("_v", F.pmod(F.xxhash64(f"`{id_col}`"), F.lit(1 << 20))).alias("_cell"),
            F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"), F.lit(0).alias("_kind"),
            F.lit(None).cast("long").alias("_q"), F.lit(None).cast(kind).alias("_own"),
            F.lit(None).cast("double").alias("_start"), "_v", *carried)
        stream = stream.unionByName(asked.mapInPandas(probes, schema).select(
            F.col("cell").alias("_cell"), F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("_block"),
            F.lit(1).alias("_kind"), F.col("q").alias("_q"), F.col("own").alias("_own"), F.col("start").alias("_start"),
            F.col("v").alias("_v"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.carry]))
        out = T.StructType([T.StructField("query_id", T.LongType()),
                            *[T.StructField(f.name, f.dataType) for f in self.carry],
                            T.StructField("similarity", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, parts, held = None, [], None
            for batch in batches:
                where = np.stack([batch.column(c).to_numpy() for c in ("_cell", "_block", "_kind")], axis=1)
                cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
                for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(where)]):
                    if e == s:
                        continue
                    part = batch.slice(s, e - s)
                    if tuple(where[s, :2]) != key:
                        key, parts, held = tuple(where[s, :2]), [], None
                    if where[s, 2] == 0:
                        parts.append(part.select([*names, "_v"]))
                        continue
                    if parts and held is None:
                        rows = pa.Table.from_batches(parts).combine_chunks()
                        ids = np.array(rows.column(id_col).to_pylist())
                        unit = _unit(_arrow_matrix(rows.column("_v").chunk(0), "Index"))
                        held = rows.select(names), unit, ids, np.argsort(np.argsort(ids, kind="stable"), kind="stable")
                    if held is not None:
                        for t in range(0, part.num_rows, TILE):
                            yield from _hits(part.slice(t, TILE), *held, k, min_similarity)

        found = stream.repartition("_cell", "_block").sortWithinPartitions("_cell", "_block", "_kind").mapInArrow(run, out)
        found = found.withColumn("similarity", F.round(F.col("similarity") * SIM_SCALE).cast("bigint") / SIM_SCALE)
        w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col(f"`{id_col}`").asc())
        ranked = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return ranked.select("query_id", "rank", *carried, "similarity")


def _hits(part: pa.RecordBatch, rows: pa.Table, unit: np.ndarray, ids: np.ndarray, order: np.ndarray, k: int,
          floor: float) -> Iterator[pa.RecordBatch]:
    """The at most k best rows of a cell for each probe, none below its starting similarity: positions first, the
    rows' columns are taken once."""
    q = _unit(_arrow_matrix(part.column("_v"), "Query"))
    if q.shape[1] != unit.shape[1]:
        raise ValueError("Embedding dimensions do not match.")
    sims = q @ unit.T
    rounded = np.round(sims * SIM_SCALE)
    hit = (sims >= floor) & (rounded >= part.column("_start").to_numpy()[:, None])
    own = part.column("_own").to_pylist()
    has = np.array([o is not None for o in own])
    if has.any():
        own = np.array([o for o in own if o is not None])
        hit[has] &= ids[None, :] != own[:, None]
    probe, row = np.nonzero(hit)
    best = np.lexsort((order[row], -rounded[probe, row], probe))
    probe, row = probe[best], row[best]
    at = np.arange(len(probe))
    begin = np.r_[True, probe[1:] != probe[:-1]][:len(probe)]
    keep = at - np.maximum.accumulate(np.where(begin, at, 0)) < k
    probe, row = probe[keep], row[keep]
    if len(probe):
        taken = rows.take(pa.array(row)).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [part.column("_q").take(pa.array(probe)), *[c.chunk(0) for c in taken.columns], pa.array(sims[probe, row])],
            ["query_id", *taken.column_names, "similarity"])


def cosine_top_k(index: DataFrame, queries: DataFrame, k: int = 3, min_similarity: float = -1.0,
                 id_col: str = "id", vec_col: str = "embedding", query_id_col: str = "query_id",
                 query_vec_col: str = "embedding", own_col: str | None = None, **sizes) -> DataFrame:
    """Index the rows and search them once (``BallIndex``)."""
    validate_search_args(None, k, min_similarity)
    return BallIndex(index, id_col, vec_col, **sizes).search(queries, k, min_similarity, query_id_col, query_vec_col,
                                                             own_col)


def search_policies(index: DataFrame, query: str, embedder, top_k: int = 3, min_similarity: float = -1.0,
                    id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """X8 single-query form: validate (X9), embed the trimmed query through the
    same hook as the index, and rank the index (similarity desc, id asc)."""
    validate_search_args(query, top_k, min_similarity)
    vec = np.asarray(embedder([query.strip()]), dtype=np.float64)
    if vec.shape[0] != 1:
        raise RuntimeError("Embedding response count did not match submitted chunks.")
    q = index.sparkSession.createDataFrame([(0, vec[0].tolist())], "query_id long, embedding array<double>")
    return cosine_top_k(index, q, k=top_k, min_similarity=min_similarity, id_col=id_col, vec_col=vec_col) \
        .drop("query_id")


# Fixed display titles by a word in the document's name, tested in order.
DOCUMENT_TITLES = (("shipping", "Shipping SLA"), ("inventory", "Inventory SOP"), ("vendor", "Vendor Escalation Procedure"))


def document_title(document: Column) -> Column:
    """display title of a document; other names pass through."""
    out = document
    for word, title in reversed(DOCUMENT_TITLES):
        out = F.when(document.contains(word), F.lit(title)).otherwise(out)
    return out


# ---- shaping of search hits --------------------------------------------------

def policy_sources(hits: DataFrame, run_col: str = "query_id", seq_col: str = "rank",
                   preview_chars: int = 240) -> DataFrame:
    """One entry per (document, section) within a run: the LAST hit's
    values kept at the FIRST hit's position."""
    g = hits.groupBy(run_col, "document", "section").agg(
        F.min(seq_col).alias("position"),
        F.max_by(F.struct("chunk_id", "similarity", collapse_ws(F.col("text"), preview_chars).alias("preview")),
                 F.col(seq_col)).alias("last"))
    return g.select(run_col, "position", "document", "section", "last.chunk_id", "last.similarity", "last.preview")


def sources_by_document(sources: DataFrame, run_col: str = "query_id") -> DataFrame:
    """X11: passages grouped per document with their count and sections in
    position order (sorted struct array, never bare collect order)."""
    g = sources.groupBy(run_col, "document").agg(
        F.count(F.lit(1)).alias("passages"),
        F.array_sort(F.collect_list(F.struct("position", "section"))).alias("_s"))
    return g.select(run_col, "document", "passages", F.transform("_s", lambda x: x["section"]).alias("sections"))
