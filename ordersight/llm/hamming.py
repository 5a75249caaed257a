"""Links between 64-bit fingerprints through bucket tables, without all pairs of a bucket.

A bucket table row says: fingerprint ``fp`` (of node ``id``) sits in, or probes,
bucket ``key`` of table ``part``.  Buckets are compared in numpy inside the
tasks.  A bucket of more than ``BLOCK`` rows is dealt into blocks, and its pairs
of blocks go to different tasks, so no task holds a hot bucket; every pair is
still compared.  What leaves a task is at most one row per fingerprint and
bucket: a spanning edge, or a count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import written

BLOCK = 2048
ROWS = "part int, key long, fp long, id long, probe boolean"


def deal(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """``rows`` with (a, b, mine): the pair of blocks they are compared in and their own block.

    Buckets with one row, or without an own row, have no pair and go.
    """
    sizes = rows.groupBy("part", "key").agg(F.count("*").alias("n"), F.count_if(~F.col("probe")).alias("own"))
    sizes = sizes.where("n > 1 AND own > 0").select("part", "key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, ["part", "key"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return rows.select("part", "key", "fp", "id", "probe", "mine", F.least("mine", "other").alias("a"),
                       F.greatest("mine", "other").alias("b"))


def pairs_of(group: np.ndarray, mine: np.ndarray, probe: np.ndarray, cross: np.ndarray) -> Iterator[tuple]:
    """Index arrays (i, j) of the rows to compare: same group, not both probes, and in a
    group of two different blocks one of each.  ``group`` is sorted."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[start, len(group)])
    left = np.repeat(start + size, size) - np.arange(len(group))  # rows from here to the group's end
    live = np.flatnonzero(left > 1)
    step = 1
    while len(live):
        i, j = live, live + step
        ok = ~(probe[i] & probe[j]) & (~cross[i] | (mine[i] != mine[j]))
        if ok.any():
            yield i[ok], j[ok]
        step += 1
        live = live[left[live] > step]


def compare(dealt: DataFrame, each: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Run ``each`` over whole (part, key, a, b) groups, many groups at a time."""

    def run(batches):
        rest = None
        for batch in batches:
            if rest is not None and len(rest):
                batch = pd.concat([rest, batch], ignore_index=True)
            if not len(batch):
                continue
            keys = batch[["part", "key", "a", "b"]].to_numpy()
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last group may go on in the next batch
            if cut:
                yield each(batch.iloc[:cut])
            rest = batch.iloc[cut:]
        if rest is not None and len(rest):
            yield each(rest)

    dealt = dealt.repartition("part", "key", "a", "b").sortWithinPartitions("part", "key", "a", "b")
    return dealt.mapInPandas(run, schema)


def _arrays(batch: pd.DataFrame):
    keys = batch[["part", "key", "a", "b"]].to_numpy()
    group = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]).any(axis=1)])
    cross = (batch["a"] != batch["b"]).to_numpy()
    return group, batch["mine"].to_numpy(), batch["probe"].to_numpy(dtype=bool), cross


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Label of each of ``n`` rows: the smallest row it is linked to through (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def spanning_edges(rows: DataFrame, distance: int, block: int = BLOCK) -> DataFrame:
    """(u, v) edges between ids that span all links of at most ``distance`` differing bits within buckets."""

    def each(batch):
        fp, ids = batch["fp"].to_numpy(), batch["id"].to_numpy()
        firsts, seconds = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for i, j in pairs_of(*_arrays(batch)):
            near = np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)) <= distance
            firsts.append(i[near])
            seconds.append(j[near])
        label = forest(np.concatenate(firsts), np.concatenate(seconds), len(fp))
        moved = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"u": ids[moved], "v": ids[label[moved]]}).drop_duplicates()

    return compare(deal(rows, block), each, "u long, v long")


def link_counts(rows: DataFrame, distance: int, masks: list[int], block: int = BLOCK) -> DataFrame:
    """(fp, links): other fingerprints within ``distance`` bits.  ``masks``: the bits that each
    table's key holds; a pair counts in the first table whose bits agree."""
    held = [np.uint64(m) for m in masks]

    def each(batch):
        fp, part = batch["fp"].to_numpy().view(np.uint64), batch["part"].to_numpy()
        count = np.zeros(len(fp), np.int64)
        for i, j in pairs_of(*_arrays(batch)):
            diff = fp[i] ^ fp[j]
            near = np.bitwise_count(diff) <= distance
            i, j, diff = i[near], j[near], diff[near]
            first = np.ones(len(i), bool)
            for t, mask in enumerate(held):
                first &= ~((part[i] > t) & ((diff & mask) == 0))
            np.add.at(count, i[first], 1)
            np.add.at(count, j[first], 1)
        some = count > 0
        return pd.DataFrame({"fp": batch["fp"].to_numpy()[some], "links": count[some]})

    return compare(deal(rows, block), each, "fp long, links long").groupBy("fp").agg(F.sum("links").alias("links"))


def expand(fps: DataFrame, keys_of: Callable[[np.ndarray], list[tuple]]) -> DataFrame:
    """Bucket table rows of (fp, id): ``keys_of(fps)`` gives (part, key array, row indices, probe)."""

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 4096):
                fp = batch["fp"].to_numpy()[at:at + 4096]
                ids = batch["id"].to_numpy()[at:at + 4096]
                for part, key, rows, probe in keys_of(fp.view(np.uint64)):
                    yield pd.DataFrame({"part": np.int32(part), "key": key.astype(np.int64), "fp": fp[rows],
                                        "id": ids[rows], "probe": probe})

    return written(fps.select("fp", "id").mapInPandas(run, ROWS), "buckets")
