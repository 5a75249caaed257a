"""Chunker semantics (T11, T12, long lines) on literal documents."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from ordersight.functions.text import SPACES
from ordersight.operators import embed
from ordersight.operators.chunker import (chunk_batch, chunk_batches, chunk_documents, greedy_starts, load_policy_chunks,
                                          read_markdown_corpus, validate_max_characters)

MD = """Intro text before any heading.

# First Title
Overview body.

## Alpha
alpha text

#### Deep
deep text

```
# not really a heading but treated as one
```

# Second Title
## Beta
beta text
"""


@pytest.fixture
def chunks(spark):
    def run(documents: dict, limit: int = 1800):
        df = spark.createDataFrame(list(documents.items()), "document string, markdown string")
        return [r.asDict() for r in chunk_documents(df, max_characters=limit).orderBy("document", "chunk_seq").collect()]
    return run


def test_heading_paths_holes_and_last_h1_title(chunks):
    rows = chunks({"ops_guide.md": MD})
    assert [r["section"] for r in rows] == ["Overview", "Overview", "Alpha", "Alpha >  > Deep", "Overview", "Beta"]
    assert {r["document_title"] for r in rows} == {"Second Title"}     # the last H1 titles every chunk
    assert [r["chunk_id"] for r in rows][:2] == ["ops_guide.md#0001", "ops_guide.md#0002"]
    assert rows[3]["text"] == "deep text\n\n```" and rows[4]["text"] == "```"


def test_sibling_and_parent_headings_reset_the_path(chunks):
    md = "## A\na\n### B\nb\n##### C\nc\n### D\nd\n#### E\ne\n## F\nf\n#### G ##\ng"
    assert [r["section"] for r in chunks({"x.md": md})] == [
        "A", "A > B", "A > B >  > C", "A > D", "A > D > E", "F", "F >  > G"]


def test_default_title_and_empty_documents(chunks):
    rows = chunks({"inventory_sop.MD": "text only", "empty.md": "", "none.md": None, "heads.md": "# A\n## B\n"})
    assert [(r["document"], r["document_title"], r["section"]) for r in rows] == [
        ("inventory_sop.MD", "inventory sop", "Overview")]


def test_long_line_cuts(chunks):
    lengths = {
        "no_space": "x" * 2000,
        "early": "a" * 900 + " " + "b" * 1099,           # last space at 900 < 990: hard cut
        "late": "a" * 1200 + " " + "b" * 799,            # last space at 1200: cut there
        "at_limit": "a" * 1800 + " " + "b" * 10,         # a space right behind the limit counts
    }
    rows = chunks(lengths)
    got = {d: [len(r["text"]) for r in rows if r["document"] == d] for d in lengths}
    assert got == {"no_space": [1800, 200], "early": [1800, 200], "late": [1200, 799], "at_limit": [1800, 10]}


def test_lines_of_a_long_block_join_the_rest_of_a_cut_line(chunks):
    block = "\n".join(["s" * 50, "x" * 450, "t" * 60, "u" * 100])
    assert [r["text"] for r in chunks({"d": block}, 200)] == [
        "s" * 50, "x" * 200, "x" * 200, "x" * 50 + "\n" + "t" * 60, "u" * 100]


def test_packing_respects_limit_and_keeps_text(chunks):
    paras = "\n\n".join(f"para {i} " + "w " * 150 for i in range(30))
    rows = chunks({"d.md": "# T\n" + paras}, 1000)
    assert all(len(r["text"]) <= 1000 for r in rows)
    assert "".join(r["text"] for r in rows).replace("\n", "").replace(" ", "") == paras.replace("\n", "").replace(" ", "")


def test_unicode_spaces_are_trimmed(chunks):
    assert chunks({"d": "　 text \n \nnext﻿"})[0]["text"] == "text\n\nnext"


def test_one_pass_over_the_rows(spark):
    df = spark.createDataFrame([("a", "b")], "document string, markdown string")
    plan = chunk_documents(df)._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Pandas" not in plan


def test_documents_of_one_name_are_kept_apart(spark):
    rows = [("a.md", "# One\n## S\nfirst\nlines"), ("a.md", "# Two\nsecond"), ("a.md", "no heading"), (None, "text")]
    df = spark.createDataFrame(rows, "document string, markdown string").coalesce(1)
    got = [tuple(r) for r in chunk_documents(df).collect()]
    assert got == [("a.md", "One", "S", "a.md#0001", 1, "first\nlines"), ("a.md", "Two", "Overview", "a.md#0001", 1, "second"),
                   ("a.md", "a", "Overview", "a.md#0001", 1, "no heading"), (None, "", "Overview", None, 1, "text")]


def test_greedy_starts_against_a_plain_loop():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        length, opens, gap = rng.integers(0, 60, n), rng.random(n) < 0.2, int(rng.integers(0, 3))
        opens[:1] = True
        want, size = [], 0
        for k in range(n):
            if opens[k] or size + gap + length[k] > 70:
                want.append(k)
                size = length[k]
            else:
                size += gap + length[k]
        assert np.flatnonzero(greedy_starts(length, opens, gap, 70)).tolist() == want


def test_a_batch_is_the_sum_of_its_documents():
    rng = random.Random(1)
    words = ["# T", "## A", "### B b ##", "", "  ", "x" * 250, "w " * 130, "line of text", "\u3000wide\ufeff", "#no", "\r", "  lead"]
    docs = ["\n".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(120)] + ["", "\r\n\r\na\r\nb"]
    names = [f"d{k % 7}.md" for k in range(len(docs))]

    def run(n, d):
        return chunk_batch(pa.array(n, pa.string()), pa.array(d, pa.string()), 200).to_pylist()

    alone = [r for n, d in zip(names, docs) for r in run([n], [d])]
    assert run(names, docs) == alone and len(alone) > 500
    assert all(0 < len(r["text"]) <= 200 and r["text"] == r["text"].strip(SPACES) for r in alone)
    for n, d in zip(names, docs):
        kept = "".join(line for line in d.replace("\r\n", "\n").split("\n") if not re.match(r"#+ ", line))
        got = "".join(r["text"] for r in run([n], [d]))
        assert re.sub(r"\s|\ufeff", "", got) == re.sub(r"\s|\ufeff", "", kept)


def test_max_characters_validation():
    for bad in (199, 250.0, True, "300"):
        with pytest.raises(ValueError):
            validate_max_characters(bad)


def test_markdown_corpus_reader(spark, tmp_path):
    (tmp_path / "b_doc.md").write_text("# B\nbee")
    (tmp_path / "A_doc.MD").write_text("# A\nay")
    (tmp_path / "skip.txt").write_text("no")
    rows = read_markdown_corpus(spark, str(tmp_path)).collect()
    assert sorted(r.document for r in rows) == ["A_doc.MD", "b_doc.md"]
    assert load_policy_chunks(spark, str(tmp_path)).count() == 2


def test_corpus_without_files_or_text_is_an_error(spark, tmp_path):
    (tmp_path / "skip.txt").write_text("no")
    with pytest.raises(FileNotFoundError):
        read_markdown_corpus(spark, str(tmp_path))
    (tmp_path / "only.md").write_text("# Heading\n\n")
    with pytest.raises(ValueError):
        load_policy_chunks(spark, str(tmp_path))


def test_large_batches_are_chunked_in_slices(spark):
    """A task's memory follows the slice, whatever the batch that Spark hands over: same chunks, bounded pieces."""
    rng = random.Random(3)
    docs = [None if n % 17 == 5 else "# T\n\n## S\n" + "\n\n".join("word " * rng.randint(0, 900) for _ in range(n % 9))
            for n in range(400)]
    docs[7] = "long line " * 40_000
    names, md = pa.array([f"d{n}.md" for n in range(400)]), pa.array(docs)
    batch = pa.RecordBatch.from_arrays([names, md], ["document", "markdown"])
    parts = list(chunk_batches(iter([batch.slice(0, 0), batch]), 1800, 1 << 16))
    assert pa.Table.from_batches(parts).to_pylist() == chunk_batch(names, md, 1800).to_pylist()
    assert len(parts) > 20
    most = max(len(d or "") for d in docs)
    assert max(sum(map(len, p.column(5).to_pylist())) for p in parts) <= most + (1 << 16)
    # The batches themselves are bounded in the session that chunks or embeds.
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(key)
    df = spark.createDataFrame([("a.md", "x")], "document string, markdown string")
    try:
        for job in (chunk_documents, lambda d: embed.embed_column(d, "markdown")):
            spark.conf.set(key, str(64 << 20))
            assert job(df).count() == 1 and int(spark.conf.get(key)) <= 4 << 20
    finally:
        spark.conf.set(key, was)
