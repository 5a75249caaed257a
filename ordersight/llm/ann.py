"""Approximate nearest neighbours by a hierarchical k-means tree (operator 2).

The tree is fitted on a bounded sample (``SAMPLE`` rows by a hash of the id, fewer
for long vectors) of unit vectors; every row is indexed under the leaf that a
greedy descent reaches.  A query walks the tree best bin first: a priority queue
holds the branches not taken by their distance, and leaves are visited in that
order.  How many leaves is calibrated: for up to ``CALIBRATION`` queries the exact
neighbours over all rows are found, and the visits widen until the share of them
that lies in visited leaves reaches ``RECALL``; a query also goes on until its
leaves hold more ids than neighbours asked for.

Leaves are laid out in cells of about ``CELL`` rows: small neighbouring leaves
share one, large ones are split by a hash of the id, so no task holds a hot
vector's copies.  Index rows and probes of a cell meet in one sorted stream: the
cell's rows stay in memory, the probes pass in batches.  Scores are recomputed
in double precision on the original vectors before anything is cut off.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component take no part, nor do those of another length than the most frequent
one (ties: the longer); rows with a null id take no part; of rows with an equal
id the best counts once and takes one place, a query id with several vectors is
searched for all of them and keeps its best neighbours, and a query never finds
its own id; equal scores go to
the smaller id; with fewer candidates than neighbours asked for all are returned;
an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import col, table, written

SAMPLE = 8192
SAMPLE_VALUES = 1 << 22
BRANCH = 8
LEAF = 64
CELL = 4096
CALIBRATION = 256
RECALL = 0.97
PROBES = 1 << 18
FOUND = "query_id long, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, summed in the same order whatever the number of rows."""
    return (rows * q).sum(axis=1) / (np.sqrt((q * q).sum()) * np.sqrt((rows * rows).sum(axis=1)))


class Tree:
    """Hierarchical k-means: node k has a centre and either children or a leaf number."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7):
        self.rng, self.branch, self.size = np.random.default_rng(seed), branch, leaf
        self.centres, self.children, self.leaf, self.leaves = [], [], [], 0
        self._grow(x, x.mean(axis=0) if len(x) else np.zeros(1))
        self.centres = np.array(self.centres)
        self.kids = [np.array(c, np.int64) for c in self.children]
        del self.rng

    def _grow(self, x: np.ndarray, centre: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(centre)
        self.children.append([])
        self.leaf.append(-1)
        label = self._split(x) if len(x) > self.size else None
        if label is None:
            self.leaf[node], self.leaves = self.leaves, self.leaves + 1
        else:
            self.children[node] = [self._grow(x[label == k], x[label == k].mean(axis=0)) for k in np.unique(label)]
        return node

    def _split(self, x: np.ndarray) -> np.ndarray | None:
        centres = x[self.rng.choice(len(x), min(self.branch, len(x)), replace=False)]
        label = np.zeros(len(x), np.int64)
        for _ in range(10):
            label = (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)
            centres = np.array([x[label == k].mean(axis=0) if (label == k).any() else centres[k]
                                for k in range(len(centres))])
        return label if len(np.unique(label)) > 1 else None  # equal vectors stay together

    def _near(self, x: np.ndarray, node: int) -> np.ndarray:
        c = self.centres[self.kids[node]]
        return (c * c).sum(axis=1) - 2 * (x @ c.T)  # squared distance less |x|^2

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf number of each row by greedy descent."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                best = self._near(x[rows], node).argmin(axis=1)
                todo += [(int(kid), rows[best == k]) for k, kid in enumerate(self.kids[node])]
        return out

    def visit(self, q: np.ndarray):
        """Leaf numbers best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while self.leaf[node] < 0:
                near = self._near(q, node)
                best = int(near.argmin())
                for k, kid in enumerate(self.kids[node]):
                    if k != best:
                        heapq.heappush(queue, (float(near[k] - near[best]), int(kid)))
                node = int(self.kids[node][best])
            yield self.leaf[node]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the vectors that take part."""
    v = col(vec_col).cast("array<double>")
    rows = vectors.select(col(id_col).cast("bigint").alias("id"), v.alias("v")).where(
        "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND exists(v, x -> x <> 0)"
        " AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _matrix(values) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def _best(ids: np.ndarray, rows: np.ndarray, own: int, q: np.ndarray, rough: np.ndarray, k: int):
    """The k best (score, id) of candidate rows by rough cosines: exact scores, ties to smaller ids."""
    rough = np.where(ids == own, -np.inf, rough)
    at, most = np.arange(len(rough)), k
    while most < len(rough):  # wider until the rows at or above the cut hold k ids
        cut = np.partition(rough, len(rough) - most)[len(rough) - most]
        if len(np.unique(ids[rough >= cut])) >= k:
            at = np.flatnonzero(rough >= cut - 1e-9)
            break
        most *= 2
    at = at[ids[at] != own]
    score = cosines(q, rows[at])
    order = np.lexsort((ids[at], -score))
    _, first = np.unique(ids[at][order], return_index=True)  # an id once
    order = order[np.sort(first)][:k]
    return score[order], ids[at][order]


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _found(parts: list) -> pd.DataFrame:
    """(query_id, vec_id, score) of (query id, scores, ids) parts."""
    return pd.DataFrame({"query_id": np.repeat([q for q, _, _ in parts], [len(i) for _, _, i in parts]).astype(np.int64),
                         "vec_id": np.concatenate([i for _, _, i in parts] or [np.zeros(0, np.int64)]),
                         "score": np.concatenate([s for _, s, _ in parts] or [np.zeros(0)])})


def brute_force(rows: DataFrame, queries: list[tuple[int, int, np.ndarray]], k: int) -> DataFrame:
    """Exact (query_id, rank, vec_id, score, v) of a bounded list of (number, own id, vector) against all rows;
    query_id is the number."""
    q = _matrix([v for _, _, v in queries])
    q_unit = unit(q)

    def run(batches):
        for batch in batches:
            ids, x = batch["id"].to_numpy(), _matrix(batch["v"])
            rough, parts, vectors = q_unit @ unit(x).T, [], []
            for n, (number, own, _) in enumerate(queries):
                score, found = _best(ids, x, own, q[n], rough[n], k)
                parts.append((number, score, found))
                # The vector that a score belongs to: an id may have several.
                for s, i in zip(score, found):
                    at = np.flatnonzero(ids == i)
                    vectors.append(x[at[np.argmax(cosines(q[n], x[at]))]].tolist())
            yield _found(parts).assign(v=vectors)

    found = rows.mapInPandas(run, FOUND + ", v array<double>").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"), F.max_by("v", "score").alias("v"))
    return _top(found, k)


def calibrate(rows: DataFrame, tree: Tree, queries: list[tuple[int, int, np.ndarray]], k: int, recall: float) -> int:
    """Leaf visits at which the share ``recall`` of the queries' exact neighbours lies in visited leaves."""
    found = brute_force(rows, queries, k).select("query_id", "v").collect()  # k rows for each calibration query
    if not found:
        return tree.leaves
    place = {number: {leaf: n for n, leaf in enumerate(tree.visit(v))}
             for (number, _, _), v in zip(queries, unit(_matrix([v for _, _, v in queries])))}
    leaf = tree.assign(unit(_matrix([r["v"] for r in found])))
    depth = np.sort([place[r["query_id"]][n] + 1 for r, n in zip(found, leaf)])
    return int(depth[min(len(depth) - 1, int(np.ceil(recall * len(depth))) - 1)])


def search(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
           recall: float = RECALL, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row where ``is_query`` (on id) holds; an id with
    several vectors has the best of all of them."""
    rows = written(usable(vectors, id_col, vec_col).dropDuplicates(["id", "v"]), "vectors")
    queries = rows.where(is_query)
    spark = rows.sparkSession
    one = rows.first()
    if one is None or queries.limit(1).count() == 0:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = max(256, min(sample, SAMPLE_VALUES // len(one["v"])))
    draw = F.xxhash64(F.lit("ann sample"), "id")
    picked = rows.orderBy(draw, "id").limit(most).collect()
    tree = Tree(unit(_matrix([r["v"] for r in picked])))
    trial = [(n, r["id"], np.array(r["v"]))
             for n, r in enumerate(queries.orderBy(draw, "id").limit(CALIBRATION).collect())]
    visits = calibrate(rows, tree, trial, k, recall)

    @F.pandas_udf("int")
    def leaf_of(v: pd.Series) -> pd.Series:
        return pd.Series(tree.assign(unit(_matrix(v))).astype(np.int32)) if len(v) else pd.Series([], dtype="int32")

    index = written(rows.withColumn("leaf", leaf_of("v")), "ann-index")
    count, fresh = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for r in index.groupBy("leaf").count().collect():  # one row per leaf of the bounded tree
        count[r["leaf"]] = r["count"]
    # Ids counted once, in the first leaf that holds them: visited leaves hold at least so many ids.
    for r in index.groupBy("id").agg(F.min("leaf").alias("leaf")).groupBy("leaf").count().collect():
        fresh[r["leaf"]] = r["count"]
    # Cells: runs of small leaves, or slices of a large one.  first[leaf], slices[leaf].
    first, slices, at, held = np.zeros(tree.leaves, np.int64), np.ones(tree.leaves, np.int64), 0, 0
    for n, c in enumerate(count):
        slices[n] = max(1, -(-int(c) // cell))
        if slices[n] > 1 or held + c > cell:
            at, held = at + (held > 0), 0
        first[n] = at
        if slices[n] > 1:
            at, held = at + int(slices[n]), 0
        else:
            held += int(c)
    copies = max(1, -(-queries.count() // PROBES))

    @F.pandas_udf("int")
    def cell_of(leaf: pd.Series, h: pd.Series) -> pd.Series:
        leaf = leaf.to_numpy()
        return pd.Series((first[leaf] + h.to_numpy() % slices[leaf]).astype(np.int32))

    def probes(batches):
        for batch in batches:
            for s in range(0, len(batch), 256):
                part, out = batch.iloc[s:s + 256], []
                for i, v, u in zip(part["id"], part["v"], unit(_matrix(part["v"]))):
                    cells: dict[int, list[int]] = {}
                    ids_seen = 0
                    for n, leaf in enumerate(tree.visit(u)):
                        if n >= visits and ids_seen > k:
                            break
                        ids_seen += fresh[leaf]
                        for c in range(int(slices[leaf])):
                            cells.setdefault(int(first[leaf]) + c, []).append(leaf)
                    out += [(c, i, v, leaves) for c, leaves in cells.items()]
                yield pd.DataFrame(out, columns=["cell", "id", "v", "leaves"])

    asked = queries.select("id", "v").mapInPandas(probes, "cell int, id long, v array<double>, leaves array<int>")
    stream = (index.select(cell_of("leaf", F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("cell"),
                           F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("salt"), F.lit(0).alias("kind"),
                           "id", "v", F.array("leaf").alias("leaves"))
              .unionByName(asked.select("cell", F.pmod(F.xxhash64("id"), F.lit(copies)).cast("int").alias("salt"),
                                        F.lit(1).alias("kind"), "id", "v", "leaves")))
    stream = stream.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind")

    def compare(batches):
        key, parts, held = None, [], None
        for batch in batches:
            where = batch[["cell", "salt", "kind"]].to_numpy()
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(batch)]):
                part = batch.iloc[s:e]
                c, salt, kind = (int(x) for x in where[s])
                if (c, salt) != key:
                    key, parts, held = (c, salt), [], None
                if kind == 0:
                    parts.append((part["id"].to_numpy(), _matrix(part["v"]),
                                  np.array([x[0] for x in part["leaves"]])))
                    continue
                if not parts:
                    continue
                if held is None:
                    ids, x, leaf = (np.concatenate([p[n] for p in parts]) for n in range(3))
                    held = (ids, x, leaf, unit(x))
                ids, x, leaf, x_unit = held
                q = _matrix(part["v"])
                out = []
                for b in range(0, len(q), 512):
                    rough = unit(q[b:b + 512]) @ x_unit.T
                    for n in range(len(rough)):
                        rows_in = np.flatnonzero(np.isin(leaf, part["leaves"].iloc[b + n]))
                        own = int(part["id"].iloc[b + n])
                        score, found = _best(ids[rows_in], x[rows_in], own, q[b + n], rough[n][rows_in], k)
                        out.append((own, score, found))
                yield _found(out)

    found = stream.mapInPandas(compare, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


def op2_ann(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)
