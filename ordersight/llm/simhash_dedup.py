"""SimHash near-duplicates by the generalised pigeonhole principle (operator 3).

Fingerprints of word shingles are collapsed to distinct values first.  The 64
bits are grouped into partitions of correlated bits; partition i gets a radius
r_i >= -1 with sum(r_i) = distance - partitions + 1, so two fingerprints within
``distance`` bits must be within r_i bits on some partition.  The radii come
from a dynamic programme over estimated costs: pairs that would have to be
verified (from bit frequencies and the exact number of collisions) and bucket
rows.  A fingerprint sits in the bucket of its own value and probes those of
the larger values within the radius (of two values one is the larger, so every
pair meets once per partition); pairs are verified on all 64 bits, and only
spanning edges leave the tasks.

Defined cases: a null text, or one without words, has fingerprint zero and is
linked like any other; a text with fewer words than a shingle is one shingle;
rows that repeat are linked as equal fingerprints; an id may be null or repeat
with other texts, for links are between fingerprints: a component is named by the
smallest id of its rows, and by null where none has an id; an empty table gives
an empty result; very long texts are processed in slices of shingles.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm import hamming
from ordersight.llm.common import col, free, table, written
from ordersight.llm.components import connected_components

SHINGLE = 4
DISTANCE = 4
PARTITIONS = 3
SEED = 42
#: Cost of verifying a candidate pair in numpy, in bucket rows written, shuffled and sorted.
PAIR_COST = 0.02
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash: a bit is 1 if it is set in over half the shingles' XXH64."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8").lower())  # bytes.lower: A-Z only
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    votes, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        part = words[at:at + (1 << 16) + shingle - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(shingle))))
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(seed)), np.uint64)
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint of a text column as a signed long."""

    @F.pandas_udf("long")
    def fp(text: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in text], np.uint64).view(np.int64))

    return fp(text)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp) with the fingerprint as a signed long, one row per row of ``docs``."""
    return written(docs.select(col(id_col).alias("id"), fingerprint_of(col(text_col), shingle).alias("fp")), "fingerprints")


def bit_counts(fps: DataFrame) -> np.ndarray:
    """64 x 64: how many fingerprints have both bits set (4,096 sums over all rows)."""

    def run(batches):
        total = np.zeros((64, 64))
        for batch in batches:
            bits = np.unpackbits(batch["fp"].to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]
            bits = bits.astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                total += bits[at:at + (1 << 16)].T @ bits[at:at + (1 << 16)]
        yield pd.DataFrame({"i": np.arange(4096), "n": total.astype(np.int64).ravel()})

    sums = fps.select("fp").mapInPandas(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n"))
    out = np.zeros(4096, np.int64)
    for r in sums.collect():  # 4,096 rows whatever the input
        out[r["i"]] = r["n"]
    return out.reshape(64, 64)


def correlated_partitions(both: np.ndarray, n: int, parts: int = PARTITIONS) -> list[list[int]]:
    """Bits 0..63 in ``parts`` groups of nearly equal size, each grown by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    left, out = list(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (corr[b, group].sum(), -b)))
        left = [b for b in left if b not in group]
        out.append(sorted(group))
    return out


def near_share(match: np.ndarray, radius: int) -> float:
    """Chance that two random values differ in at most ``radius`` bits, by bits' chances to match."""
    dist = np.zeros(radius + 2)
    dist[0] = 1
    for m in match:
        dist[1:] = dist[1:] * m + dist[:-1] * (1 - m)
        dist[0] *= m
        dist[-1] = 0
    return float(dist[:radius + 1].sum())


def allocate(costs: list[list[float]], total: int) -> list[int]:
    """Radii r_i >= -1 with sum ``total`` and least summed cost; costs[i][r + 1] is that of r on partition i."""
    best = {0: (0.0, [])}
    for cost in costs:
        nxt = {}
        for used, (c, radii) in best.items():
            for r, extra in enumerate(cost, -1):
                at = (c + extra, radii + [r])
                if used + r not in nxt or at < nxt[used + r]:
                    nxt[used + r] = at
        best = nxt
    return best[total][1]


def plan(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTITIONS) -> tuple[list[list[int]], list[int]]:
    """Partitions and radii for distinct fingerprints (fp)."""
    n = fps.count()
    both = bit_counts(fps)
    groups = correlated_partitions(both, n, parts)
    p = np.diag(both) / max(n, 1)
    match = p * p + (1 - p) * (1 - p)
    values = [F.struct(F.lit(k).alias("part"), F.expr(" | ".join(
        f"shiftleft((shiftright(fp, {b}) & 1), {at})" for at, b in enumerate(g))).alias("key"))
        for k, g in enumerate(groups)]
    same = {r["part"]: float(r["c"]) for r in fps.select(F.explode(F.array(*values)).alias("x")).select("x.*")
            .groupBy("part", "key").count().groupBy("part").agg(F.sum(F.expr("count * (count - 1.0D) / 2")).alias("c"))
            .collect()}  # one row per partition
    costs = []
    for k, g in enumerate(groups):
        expected = near_share(match[g], 0) * n * n / 2
        scale = max(1.0, same.get(k, 0.0) / max(expected, 1e-9))
        cost = [0.0]
        for r in range(distance + 1):
            signatures = 1 + sum(len(list(itertools.combinations(range(len(g)), e))) for e in range(1, r + 1)) / 2
            cost.append(n * signatures + PAIR_COST * scale * near_share(match[g], r) * n * n / 2)
        costs.append(cost)
    return groups, allocate(costs, distance - parts + 1)


def bucket_keys(groups: list[list[int]], radii: list[int]):
    """The function that ``hamming.expand`` wants: own value of each partition, and larger ones within its radius."""

    def keys(fp: np.ndarray):
        rows = np.arange(len(fp))
        for k, (bits, radius) in enumerate(zip(groups, radii)):
            if radius < 0:
                continue
            value = np.zeros(len(fp), np.uint64)
            for at, b in enumerate(bits):
                value |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(at)
            yield k, value, rows, False
            for e in range(1, radius + 1):
                for flips in itertools.combinations(range(len(bits)), e):
                    other = value ^ np.uint64(sum(1 << f for f in flips))
                    up = np.flatnonzero(other > value)
                    if len(up):
                        yield k, other[up], up, True

    return keys


def groups(rows: DataFrame, distance: int = DISTANCE, parts: int = PARTITIONS) -> DataFrame:
    """(fp, root) of the distinct fingerprints of ``rows``: root is the smallest one reachable over links."""
    nodes = written(rows.select("fp").distinct().withColumn("id", F.col("fp")), "distinct-fingerprints")
    bits, radii = plan(nodes, distance, parts)
    edges = hamming.spanning_edges(hamming.expand(nodes, bucket_keys(bits, radii)), distance)
    found = connected_components(edges)
    return (nodes.join(found, F.col("fp") == F.col("node"), "left")
            .select("fp", F.coalesce("component", "fp").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    distance: int = DISTANCE, parts: int = PARTITIONS) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of at most ``distance`` bits."""
    rows = fingerprints(docs, id_col, text_col, shingle)
    least = rows.groupBy("fp").agg(F.min("id").alias("id"))
    nodes = written(groups(rows, distance, parts).join(least, "fp"), "groups")
    names = nodes.groupBy("root").agg(F.min("id").alias("component"))
    return rows.join(nodes.select("fp", "root").join(names, "root"), "fp").select("id", "fp", "component")


def op3_simhash_dedup(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.col("component").alias("component_id"))


def stage(spark, docs, sf_dir):
    """Pipeline stage: of each group of near-duplicates one row stays, of those with the smallest id (null last)
    one with the smallest fingerprint.  The row is found by id and fingerprint: an id may be null or name several texts."""
    n_fp, k_id, k_fp = free(docs, "own_fp", "kept_id", "kept_fp")
    marked = written(docs.withColumn(n_fp, fingerprint_of(col("text"))), "marked")
    rows = marked.select(col("doc_id").alias("id"), F.col(n_fp).alias("fp"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "fp")
    least = rows.groupBy("fp").agg(F.min(order).alias("least"))
    keep = (groups(rows).join(least, "fp").groupBy("root").agg(F.min("least").alias("least"))
            .select(F.col("least.id").alias(k_id), F.col("least.fp").alias(k_fp)))
    same = (F.col(n_fp) == F.col(k_fp)) & col("doc_id").eqNullSafe(F.col(k_id))
    # Rows that are equal in id and fingerprint are copies of each other.
    return marked.join(keep, same, "left_semi").dropDuplicates(["doc_id", n_fp]).drop(n_fp)
