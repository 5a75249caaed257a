"""Vectors (X7-X9, T13), redaction (X12), answer shaping."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordersight.operators import answers, embed, search
from ordersight.functions.text import redact_credentials


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b) / size if size else 0.0


@pytest.mark.parametrize("tile, sizes", [(1024, {}), (3, {"ball_rows": 20, "sample": 256}),
                                         (2, {"ball_rows": 7, "cell": 5, "probes": 4, "sample": 256})])
def test_batch_top_k_equals_brute_force(spark, monkeypatch, tile, sizes):
    rng = np.random.default_rng(7)
    idx = rng.normal(size=(300, 16))
    qs = rng.normal(size=(11, 16))
    idx[5] = 0.0                                           # zero vector scores 0
    idx[200:210] = idx[10]                                 # ties go to the lower id
    qs[0] = idx[10]
    monkeypatch.setattr(search, "TILE", tile)              # more queries than one tile
    index = spark.createDataFrame([(i, idx[i].tolist(), f"t{i}") for i in range(300)],
                                  "id long, embedding array<double>, text string")
    queries = spark.createDataFrame([(100 + j, qs[j].tolist()) for j in range(11)], "query_id long, embedding array<double>")
    got = search.cosine_top_k(index.repartition(7), queries, k=5, min_similarity=-0.1, **sizes).collect()
    for j in range(11):
        sims = sorted(((round(cosine(qs[j], idx[i]) * 1e6), i) for i in range(300)
                       if cosine(qs[j], idx[i]) >= -0.1), key=lambda t: (-t[0], t[1]))[:5]
        mine = sorted((r for r in got if r.query_id == 100 + j), key=lambda r: r.rank)
        assert [(r.id, r.text) for r in mine] == [(i, f"t{i}") for _, i in sims]
        assert [r.rank for r in mine] == [1, 2, 3, 4, 5]


@pytest.mark.parametrize("row", [[1.0, 2.0, 3.0], [1.0, float("nan")], None])
def test_unfit_vectors_are_errors(spark, row):
    index = spark.createDataFrame([(1, row)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<double>")
    with pytest.raises(Exception, match="dimensions do not match|invalid embedding"):
        search.cosine_top_k(index, queries).collect()


def clustered(rng, n, groups=24, dim=12):
    centres = rng.normal(size=(groups, dim))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.normal(size=(n, dim))


def test_balls_that_cannot_win_are_skipped(spark):
    """Clustered vectors: few balls are read, nothing is lost, and a query never finds its own row."""
    rng = np.random.default_rng(3)
    v = clustered(rng, 3000)
    v[17] = 0.0
    rows = spark.createDataFrame([(2**60 + i, x.tolist(), f"t{i}") for i, x in enumerate(v)],
                                 "id long, embedding array<double>, text string")
    queries = rows.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    index = search.BallIndex(rows, ball_rows=60, cell=64, sample=512)
    got = index.search(queries, k=4, own_col="query_id").collect()
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    asked = [i for i in range(3000) if (2**60 + i) % 50 == 0]
    for i in asked:
        score = np.round(unit @ unit[i] * 1e6)
        want = [j for j in np.lexsort((np.arange(3000), -score)) if j != i][:4]
        mine = sorted((r for r in got if r.query_id == 2**60 + i), key=lambda r: r["rank"])
        assert [(r.id, r.text) for r in mine] == [(2**60 + j, f"t{j}") for j in want]
    read = index.blocks_read(queries, k=4, own_col="query_id").collect()
    assert len(read) == len(asked) and {r.blocks for r in read} == {int((index.balls.rows > 0).sum())}
    assert max(r.blocks_read for r in read) < read[0].blocks / 3
    plan = index.search(queries, k=4)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "Cartesian" not in plan


def test_search_of_small_and_empty_indexes(spark):
    empty = spark.createDataFrame([], "id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "query_id long, embedding array<double>")
    assert search.cosine_top_k(empty, queries).collect() == []
    two = spark.createDataFrame([("b", [2.0, 0.0]), ("a", [0.0, 0.0])], "id string, embedding array<double>")
    got = sorted(tuple(r) for r in search.cosine_top_k(two, queries).collect())
    assert got == [(1, 1, "b", 1.0), (1, 2, "a", 0.0), (2, 1, "a", 0.0), (2, 2, "b", 0.0)]
    assert search.cosine_top_k(two, queries.limit(0)).collect() == []


def test_search_argument_checks():
    for kw in ({"top_k": 0}, {"top_k": 51}, {"min_similarity": 1.5}, {"query": ""}, {"query": "x" * 4001}):
        with pytest.raises(ValueError):
            search.validate_search_args(**{"query": "ok", **kw})


def test_index_gate(spark, tmp_path):
    chunks = spark.createDataFrame([("d.md", "T", "S", "d.md#0001", 1, "hello world")],
                                   "document string, document_title string, section string, chunk_id string, "
                                   "chunk_seq int, text string")
    idx = embed.index_rows(chunks, embed.HashingEmbedder(8))
    path = embed.write_vector_index(idx, str(tmp_path / "index"), "1")
    assert embed.read_vector_index(spark, path, "hashing-8").count() == 1
    with pytest.raises(ValueError):
        embed.read_vector_index(spark, path, "other-model")
    null = idx.withColumn("schema_version", F.lit(None).cast("int"))
    with pytest.raises(ValueError):
        embed.read_vector_index(spark, embed.write_vector_index(idx.unionByName(null), str(tmp_path / "index"), "2"),
                                "hashing-8")


def test_embedder_count_check(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string")
    bad = lambda texts: np.zeros((len(texts) + 1, 4))
    with pytest.raises(Exception, match="count did not match"):
        embed.embed_column(df, "t", "e", bad).collect()


def test_redaction_patterns(spark):
    df = spark.createDataFrame([("key sk-abcdefghijklmnop123 and Bearer xyz.1 and OPENAI_API_KEY = abc",)], "t string")
    out = df.select(redact_credentials(F.col("t")).alias("r")).first().r
    assert out == ("key [credential-redacted] and Bearer [credential-redacted] and "
                   "OPENAI_API_KEY=[credential-redacted]")


ANSWER = """## Executive Summary
Top line.
**Observed operational facts**
- Fact one.
### Something unknown
still observed
## Recommended actions
1. **Expedite POs**: Policy requires escalation. Do it now.
2. Review stock. Stock below 50% must escalate.
## Limitations
- The data does not prove a cause. **Unknown** carrier delays remain. 1) Cause is unknown. 2) cause is unknown.
No direct link to vendors. Lack of detail. Not enough evidence here. Evidence gap remains."""


def test_answer_sections_and_gaps(spark):
    df = spark.createDataFrame([(1, ANSWER), (2, "no headings at all")], "id int, answer string")
    s = {r.id: r for r in answers.answer_sections(df.withColumn("a", F.col("answer")), "a").collect()}
    assert s[1].executive == "Top line."
    assert s[1].observed == "- Fact one.\nstill observed"
    assert s[1].actions.startswith("1. **Expedite POs**")
    assert s[2].executive == "no headings at all"
    gaps = answers.evidence_gaps(spark.createDataFrame([(1, s[1].limitations)], "id int, g string"), "g") \
        .orderBy("gap_rank").collect()
    assert len(gaps) == 5
    assert gaps[0].gap == "The data does not prove a cause."
    assert sum(1 for g in gaps if g.gap.lower().endswith("cause is unknown.")) == 1


def test_action_items_titles_and_policy_basis(spark):
    actions = "1. **Expedite POs**: Policy requires escalation. Do it now.\n2. Review stock. Stock below 50% must escalate."
    rows = answers.action_items(spark.createDataFrame([(1, actions)], "id int, actions string")) \
        .orderBy("item_no").collect()
    assert [r.title for r in rows] == ["Expedite POs", "Review stock"]
    assert rows[0].policy_basis == "Policy requires escalation."
    assert rows[1].policy_basis == "Stock below 50% must escalate."
