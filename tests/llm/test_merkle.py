"""The Merkle manifest against a plain recursive tree."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ordersight.llm import merkle

from .messy import SF, empty, messy

FIELDS = merkle.FIELDS


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text=False):
    return h("".join(field(row[f] if f != "text" or text is False else text) for f in FIELDS))


def plain_tree(nodes):
    """(root, for each leaf its runs: lists with None at its own place)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            first = i - i % 3
            paths[k].append([None if j == i else nodes[j] for j in range(first, min(first + 3, len(nodes)))])
        nodes = [h("".join(nodes[i:i + 3])) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["source"], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        built[s] = plain_tree([leaf(r) for r in trees[s]])
    root, up = plain_tree([built[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for r, path in zip(trees[s], built[s][1]):
            runs = path + up[k]
            i, text = r["doc_id"], r["text"]
            hit = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
            d = leaf(r, text.replace("\n", "") if hit and text is not None else text)
            for run in runs:
                d = h("".join(x or d for x in run))
            proof = h("".join(x for run in runs for x in run if x))
            out.append((i, leaf(r), built[s][0], root, proof, d, d == root))
    return out


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def query(docs, **more):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(docs, tampered=[cut if f == "text" else F.col(f) for f in FIELDS], **more)


def same(got, rows):
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(plain_manifest(rows), key=key)


def test_query_and_statement(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = merkle.op13_merkle(spark, SF)
    same(got, rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(merkle.ORACLE).fetchall(), key=key) == sorted((tuple(r) for r in got.collect()), key=key)
    assert {r["verified"] for r in got.collect()} == {True, False}


@pytest.mark.parametrize("height,parts", [(1, 3), (2, 11)])
def test_many_rounds_of_builders(spark, height, parts):
    """Builders of 3 and 9 leaves: several rounds, partial ones, single sources, a hot one, repeated ids."""
    rng = random.Random(height)
    rows = [(rng.randrange(200), f"t{k % 50}\n", "en", rng.choice(["hot"] * 5 + ["b", "é", "", None]), k % 3)
            for k in range(400)] + [(7, "same\n", "en", "hot", 1)] * 30 + [(1, "x", "en", "alone", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    same(query(df.repartition(parts), height=height), df.collect())


def test_defined_cases(spark):
    same(query(messy(spark)), messy(spark).collect())
    assert query(empty(spark)).collect() == []
    assert query(messy(spark)).columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    same(query(messy(spark).limit(1)), messy(spark).limit(1).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 82, 243, 300])
def test_positions_are_postorder(n):
    sizes, done = merkle.levels(n), []

    def walk(level, idx):
        if level:
            for k in range(idx * 3, min(idx * 3 + 3, sizes[level - 1])):
                walk(level - 1, k)
        done.append((level, idx))

    walk(len(sizes) - 1, 0)
    assert len(done) == sum(sizes)
    for at, (level, idx) in enumerate(done):
        assert merkle.position(level, idx, sizes) == at


def test_logs_are_written_in_order_of_completion(spark):
    rows = [("", 50, k, h(str(k))) for k in range(50)]
    leaves = spark.createDataFrame(rows, "tree string, leaves long, rank long, digest string")
    parts = merkle.build(leaves, 50, height=2)
    log = [r for p in parts for r in p.collect()]
    assert sorted(r["pos"] for r in log) == list(range(sum(merkle.levels(50))))
    for r in parts[0].where("idx < 9 AND level = 0 OR idx = 0 AND level = 2").collect():
        assert r["pos"] <= 12
    assert merkle.roots(parts).first()["digest"] == plain_tree([r[3] for r in rows])[0]
