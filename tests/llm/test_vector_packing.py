"""Vector bin packing: every id once, limits, padding, whole examples."""

from __future__ import annotations

import collections
import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ordersight.llm import vector_packing as vp

from .messy import SF, documents, empty, messy


def check(rows, texts, limits=vp.LIMITS):
    """Rows of a packing against the tokenizer library; the total padding."""
    tok = Tokenizer.from_file(vp.default_tokenizer())
    ids = [tok.encode(t or "", add_special_tokens=False).ids + [1] for _, t in texts]
    want = collections.Counter()
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    # Rows that repeat have equal pieces; count coverage of every (id, position).
    cover = collections.Counter((r["doc_id"], k) for r in rows for k in range(r["start"], r["start"] + r["length"]))
    for (i, _), x in zip(texts, ids):
        want.update((i, k) for k in range(len(x)))
    assert cover == want
    known = collections.defaultdict(list)
    for (i, _), x in zip(texts, ids):
        known[i, len(x)].append(x)
    for r in rows:
        crcs = {zlib.crc32(np.array(x[r["start"]:r["start"] + r["length"]], "<u4").tobytes())
                for x in known[r["doc_id"], r["doc_tokens"]]}
        assert r["ids_crc32"] in crcs and r["length"] > 0
    padding = 0
    by_seq = collections.defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= limits[0] and len(parts) <= limits[1]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return padding, len(by_seq)


def test_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    rows = vp.op11_vector_packing(spark, SF).collect()
    padding, sequences = check(rows, docs)
    tokens = sum(r["length"] for r in rows)
    assert padding == 0 and sequences <= tokens // 2048 + 12


def test_defined_cases(spark):
    rows = [(r["doc_id"], r["text"]) for r in messy(spark).select("doc_id", "text").collect()]
    got = vp.pack(messy(spark), vp.default_tokenizer())
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert check(got.collect(), rows)[0] == 0
    assert vp.pack(empty(spark), vp.default_tokenizer()).collect() == []


def test_small_cells_and_limits(spark):
    """Few items a cell, a low segment limit: many short sequences meet in the second round."""
    docs = documents(spark).where("doc_id < 60").repartition(5, "doc_id")
    limits = (512, 3, 512)
    got = vp.pack(docs, vp.default_tokenizer(), limits=limits, cell=4).collect()
    assert check(got, [(r["doc_id"], r["text"]) for r in docs.collect()], limits)[0] == 0


def test_ids_agree_with_the_library():
    ids, full = vp.Ids(vp.default_tokenizer()), Tokenizer.from_file(vp.default_tokenizer())
    assert ids.fast is not None
    texts = ["", " ", "a  b\n\n\tc ", "it's <|endoftext|> 's I'LL 12 ½ ²", "日本語 Ünïcode​\u0085x", "é" * 3000,
             "<|endoftext|>", "   　x", "a" * 5000, " " * 300_000 + "x"]
    for t in texts:
        assert ids(t).tolist() == full.encode(t, add_special_tokens=False).ids


def best_count(demand, limits):
    """Fewest sequences by trying all assignments of a few items."""
    n = len(demand)
    for bins in range(1, n + 1):
        for where in itertools.product(range(bins), repeat=n):
            load = np.zeros((bins, 3))
            np.add.at(load, list(where), demand)
            if (load <= limits).all():
                return bins


@pytest.mark.parametrize("seed", range(8))
def test_fill_against_exhaustive(seed):
    rng = np.random.default_rng(seed)
    limits = (100, 5, 60)
    tokens = rng.integers(1, 70, 6)
    demand = np.stack([tokens, rng.integers(1, 4, 6), np.minimum(tokens, rng.integers(0, 60, 6))], axis=1)
    got = vp.fill(demand, limits)
    assert sorted(k for b in got for k, _, _ in b) == list(range(6))
    for b in got:
        assert (demand[[k for k, _, _ in b]].sum(axis=0) <= limits).all()
    assert len(got) <= best_count(demand, limits) + 1


def test_fill_sees_every_dimension():
    # Long prompts with little loss pair with short prompts of much loss; by tokens alone they would not.
    demand = np.array([[60, 1, 10]] * 4 + [[40, 1, 40]] * 4)
    assert len(vp.fill(demand, (100, 8, 50))) == 4
    assert len(vp.fill(np.array([[1, 3, 0]] * 4), (100, 6, 100))) == 2


def test_examples_of_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    words = F.size(F.split("text", " "))
    examples = turns.groupBy("conv_id").agg(
        F.sum(words).alias("tokens"), F.count("*").alias("segments"),
        F.sum(F.when(F.col("role") == "assistant", words).otherwise(0)).alias("loss_tokens"))
    limits = (1024, 12, 600)
    rows = vp.pack_examples(examples, limits, id_col="conv_id").collect()
    known = {r["conv_id"]: tuple(r)[1:] for r in examples.collect()}
    assert sorted(r["id"] for r in rows) == sorted(known)
    seqs = collections.defaultdict(list)
    for r in rows:
        assert known[r["id"]] == (r["tokens"], r["segments"], r["loss_tokens"])
        seqs[r["sequence_id"]].append(r)
    for s in seqs.values():
        load = np.array([known[r["id"]] for r in s]).sum(axis=0)
        assert len(s) == 1 or (load <= limits).all()
        at = 0
        for r in sorted(s, key=lambda r: (r["offset"], r["tokens"])):
            assert r["offset"] == at
            at += r["tokens"]
    total = np.array(list(known.values())).sum(axis=0)
    assert len(seqs) <= 1.25 * max(total / limits) + 2


def test_examples_defined_cases(spark):
    rows = [(1, None, 1, 1), (1, None, 1, 1), (None, 5, 1, 2), (2, -3, 1, 0), (3, 900, 1, 1)]
    df = spark.createDataFrame(rows, "id bigint, tokens int, segments int, loss_tokens int").withColumn("bin", F.lit(1))
    got = vp.pack_examples(df, (100, 4, 50)).collect()
    assert len(got) == 5
    alone = next(r for r in got if r["id"] == 3)
    assert [r["id"] for r in got if r["sequence_id"] == alone["sequence_id"]] == [3]
    assert vp.pack_examples(df.limit(0), (100, 4, 50)).collect() == []
