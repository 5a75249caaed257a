from __future__ import annotations

import collections
import gzip
import hashlib
import io
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ordersight.llm import mixing, suffix_dedup, warc
from ordersight.llm.common import scratch_path

from .messy import LONG, PASSAGE, documents, empty, messy


def cut_plainly(texts, length):
    seen = collections.Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                covered[i:i + length] = True
        b = np.frombuffer(t, np.uint8)
        spans = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        out.append((len(t), int(covered.sum()), spans, b[~covered].tobytes()))
    return out


@pytest.mark.parametrize("more", [{}, {"hot": 2, "shard": 4000}])
def test_repeats_against_every_substring(spark, more):
    docs = documents(spark)
    rows = docs.collect()
    got = {r["id"]: r for r in suffix_dedup.without_repeats(docs, **more).collect()}
    want = cut_plainly([(r["text"] or "").encode() for r in rows], 200)
    assert sum(w[1] for w in want) > 0
    for r, (n, removed, spans, kept) in zip(rows, want):
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_removed"], g["n_spans"], bytes(g["kept"])) == (n, removed, spans, kept)


def test_repeats_inside_periodic_and_random_texts(spark, monkeypatch):
    rng = np.random.default_rng(1)
    noise = "".join(rng.choice(list("ab"), 3000))
    texts = ["x" * 900, "ab" * 300, noise + noise[500:900], noise[100:320], "é" * 150 + "q", "short", "x" * 199,
             "".join(rng.choice(list("abc"), 2000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = cut_plainly([t.encode() for t in texts], 200)
    for size in (1 << 21, 700):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        got = {r["id"]: r for r in suffix_dedup.without_repeats(df).collect()}
        for k, (n, removed, spans, kept) in enumerate(want):
            assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], bytes(got[k]["kept"])) == (
                n, removed, spans, kept)


def test_suffix_ranks_and_common_prefixes():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 99, 300, dtype=np.uint8)) for _ in range(4)]
    texts += [texts[0][40:280] + b"zz", texts[1]]
    sizes = np.array([len(t) for t in texts])
    b = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    left = np.repeat(begin + sizes, sizes) - np.arange(len(b))
    for depth in (16, 50, 200):
        rank = suffix_dedup.suffix_order(b, left, depth)
        at = np.flatnonzero(left >= depth)
        strings = [b[p:p + depth].tobytes() for p in at]
        order = sorted(range(len(at)), key=lambda k: strings[k])
        ranks = rank[at][order]
        assert all((strings[x] == strings[y]) == (rank[at[x]] == rank[at[y]]) for x, y in zip(order, order[1:]))
        assert (np.diff(ranks) >= 0).all()
        order = at[np.argsort(rank[at], kind="stable")]
        before = np.full(len(b), -1)
        before[order[1:]] = order[:-1]
        lcp = suffix_dedup.kasai(b, begin, sizes - depth + 1, before, depth)
        for q, p in zip(order, order[1:]):
            same = next((k for k in range(depth) if b[p + k] != b[q + k]), depth)
            assert lcp[p] == same


def test_repeats_defined_cases(spark):
    got = collections.defaultdict(list)
    for r in suffix_dedup.without_repeats(messy(spark)).collect():
        got[r["id"]].append(r)
    assert len(got[1]) == 2 and all(r["n_removed"] == 0 for r in got[1])  # equal but shorter than a match
    assert got[2][0]["n_bytes"] == 0 and bytes(got[2][0]["kept"]) == b"" and None in got
    assert got[6][0]["n_removed"] >= len(PASSAGE) - 1 and got[6][0]["n_spans"] == 1
    assert got[8][0]["n_bytes"] == len(LONG)
    assert suffix_dedup.without_repeats(empty(spark)).count() == 0
    twice = messy(spark).where("doc_id = 6").unionByName(messy(spark).where("doc_id = 6"))
    assert [r["n_removed"] for r in suffix_dedup.without_repeats(twice).collect()] == [len(PASSAGE) + 17] * 2


PAGES = [(5, "http://a/1", "p" * 150), (3, "http://a/2\r\nX: y", "p" * 150), (9, None, "p" * 150), (9, None, "p" * 150),
         (1, "http://b", "tiny"), (2, "http://b", "tiny"), (4, "http://c", None), (6, "u", ""),
         (None, "n", "p" * 150), (7, "w", "WARC/1.1\r\nfoo\r\n\r\n\r\nWARC/1.1\r\n" + "é" * 100), (8, "l", LONG)]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit("x"))
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=3 << 16)
    records = warc.read_archives(spark, path)
    assert records.count() == len(PAGES) and records.where("NOT intact").count() == 0
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                              for r in warc.resolve(records).collect())
    want = collections.Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        revisit = data == b"p" * 150 and i != 3
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
              3 if revisit else None)] += 1
    assert got == want


def test_warc_records_are_well_formed(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    n = 0
    for f in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect():
        data = gzip.decompress(f["content"])
        for r in warc.parse_records(io.BytesIO(data)):
            assert r["fields"]["warc-record-id"].startswith("<urn:uuid:") and len(r["fields"]["warc-record-id"]) == 47
            assert ("warc-refers-to" in r["fields"]) == (r["fields"]["warc-type"] == "revisit")
            n += 1
    assert n == len(PAGES)


def test_warc_files_are_bounded_in_bytes(spark, tmp_path):
    """Many small and some large payloads: no file holds more than the bound, but for a record of its own."""
    rng = np.random.default_rng(9)
    sizes = [*rng.integers(0, 150, 120), *rng.integers(300, 900, 40), 5000, 5001, 9000]
    rows = [(k, None, "".join(rng.choice(list("abcdef"), n))) for k, n in enumerate(sizes)] + [(900, None, None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(2)
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, file_bytes=4000, classes=(200, 1000))
    held = []
    for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect():
        held.append([len(x["payload"]) for x in warc.parse_records(io.BytesIO(gzip.decompress(r["content"])))])
    assert sorted(n for f in held for n in f) == sorted([*sizes, 0])
    assert all(sum(f) <= 4000 or len(f) == 1 for f in held) and len(held) > 10
    got = {r["page_id"]: r for r in warc.resolve(warc.read_archives(spark, path)).collect()}
    assert len(got) == len(rows) and all(r["intact"] for r in got.values())
    assert [got[k]["payload_bytes"] for k in range(len(sizes))] == [int(n) for n in sizes]


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    assert warc.resolve(warc.read_archives(spark, path)).count() == 0


def water_fill(sizes, weights, cap):
    total, open_ = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while True:
        room = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_)
        w = sum(weights[i] for i in open_)
        for i in open_:
            target[i] = room * weights[i] / w
        above = {i for i in open_ if target[i] > cap * sizes[i] + 1e-9}
        if not above:
            return target
        for i in above:
            target[i] = cap * sizes[i]
        open_ -= above


@pytest.mark.parametrize("sizes", [[100, 1, 1], [5, 5, 5, 5], [0, 7, 100, 3, 2], [1000, 1, 1, 1, 1, 1, 1, 300]])
def test_targets_against_iterative_resharing(spark, sizes):
    names = [chr(97 + k) for k in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = water_fill(sizes, [1 + k % 3 for k in range(len(sizes))], 3)
    assert all(abs(got[n] - w) < 1e-6 * max(sizes) for n, w in zip(names, want))


def test_mix_stays_near_targets_and_reruns_agree(spark):
    out = mixing.mix(documents(spark))
    per = out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target"),
                                    F.max("size").alias("largest"), F.max("copies").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["largest"] and r["most"] <= 3 for r in per)
    again = mixing.mix(documents(spark).repartition(7)).select("doc_id", "copies")
    assert again.exceptAll(out.select("doc_id", "copies")).count() == 0


def test_mix_defined_cases(spark):
    docs = messy(spark)
    out = mixing.mix(docs)
    assert out.columns[:len(docs.columns) - 1] == [c for c in docs.columns if c != "_size"][:len(docs.columns) - 1]
    assert out.count() == docs.count() and mixing.mix(empty(spark)).count() == 0
    assert mixing.stage(spark, docs, None).columns == docs.columns


def test_a_shard_is_handed_on_in_pieces():
    """A hot anchor's windows are many times its contexts: their digests leave in pieces, and arrays are 32 bits."""
    rng = np.random.default_rng(4)
    texts = [rng.integers(97, 123, int(n), dtype=np.uint8).tobytes() for n in rng.integers(220, 300, 8000)]
    texts[100:200] = texts[:100]
    rows = pd.DataFrame({"key": 1, "salt": 0, "salts": 2, "tid": np.arange(len(texts)), "bytes": 500, "start": 7,
                         "context": texts}).astype({"bytes": "int32", "start": "int32"})
    tracemalloc.start()
    seen, local, most = 0, [], 0
    for piece in suffix_dedup.shard_repeats(rows):
        most = max(most, len(piece))
        seen += int((~piece["local"]).sum())
        local.append(piece[piece["local"]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sum(len(t) - 199 for t in texts) - sum(len(t) - 199 for t in texts[:100])
    assert most <= suffix_dedup.SEND < seen
    got = pd.concat(local)
    assert sorted(got["tid"]) == list(range(200)) and set(got["first"]) == {7}
    assert peak < 75 * sum(map(len, texts)), peak
