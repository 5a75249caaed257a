"""The corpus pipeline against plain Python, stage by stage and whole."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from ordersight.llm import packing, simhash_dedup

from .messy import SF, documents, empty, messy
from .test_simhash_fingerprints import components
from .test_text_operators import BASE


def plain_dedup(docs):
    ids = sorted(docs)
    fps = {i: simhash_dedup.fingerprint(docs[i]["text"]) for i in ids}
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4]
    label = components(links, ids)
    return {i: docs[i] for i in ids if label[i] == i}


def plain_masks(docs):
    owners, repos = collections.defaultdict(set), collections.defaultdict(set)
    found = {}
    for i, d in docs.items():
        found[i] = [(m.end() - len(m[2] if kind == "assign" else m[0]), m.end()) for kind, p, ok in BASE
                    for m in p.finditer(d["text"]) if ok(m)]
        for a, e in found[i]:
            owners[d["text"][a:e]].add(d["source"])
            repos[d["text"][a:e]].add(i)
    out = {}
    for i, d in docs.items():
        spans = sorted(s for s in found[i] if len(owners[d["text"][s[0]:s[1]]]) < 3 and len(repos[d["text"][s[0]:s[1]]]) < 25)
        text, at, runs = d["text"], 0, []
        for a, e in spans:
            if runs and a < runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([a, e])
        parts = []
        for a, e in runs:
            parts += [text[at:a], "[SECRET]"]
            at = e
        out[i] = d | {"text": "".join([*parts, text[at:]])}
    return out


def plain_copies(docs):
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for i, d in docs.items()}
    names = sorted({d["source"] for d in docs.values()})
    of = {n: sum(size[i] for i, d in docs.items() if d["source"] == n) for n in names}
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    open_, target = set(names), {}
    while True:
        room = sum(of.values()) - sum(3 * of[n] for n in names if n not in open_)
        total = sum(weight[n] for n in open_)
        target |= {n: room * weight[n] / total for n in open_}
        above = {n for n in open_ if target[n] > 3 * of[n]}
        if not above:
            break
        target |= {n: 3.0 * of[n] for n in above}
        open_ -= above
    out = {}
    for n in names:
        rows = sorted((i for i, d in docs.items() if d["source"] == n), key=lambda i: (size[i], i % 1024, i))
        u = int(hashlib.md5(f"42:{n}".encode()).hexdigest()[:12], 16) / (1 << 48)
        rate = target[n] / of[n] if of[n] else 0.0
        for k, i in enumerate(rows):
            out[i] = min(3, math.floor((k + 1) * rate + u) - math.floor(k * rate + u))
    return out


def test_run_against_plain_code(spark):
    from tokenizers import Tokenizer

    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_dedup", "secret_scan", "mixing", "packing"]
    docs = {r["doc_id"]: r.asDict() for r in documents(spark).collect()}
    docs = {i: d for i, d in docs.items() if re.search(r"[^\W\d_]", d["text"] or "")}
    docs = plain_masks(plain_dedup(docs))
    copies = plain_copies(docs)
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = collections.Counter()
    for i, d in docs.items():
        ids = tok.encode(d["text"], add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s:s + 2048]
            want[(i, k, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += copies[i]
    rows = corpus_pipeline.run(spark, SF).collect()
    got = collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert got == +want
    places = collections.defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in places.values():
        items.sort()
        assert [o for o, _ in items] == np.cumsum([0, *(n for _, n in items)])[:-1].tolist()
        assert sum(n for _, n in items) <= 2048


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_awkward_and_empty_tables(spark, name, stage):
    for docs in (messy(spark), empty(spark)):
        out = stage(spark, docs, None)
        rows = out.collect()
        assert (name == "packing") or out.columns == docs.columns
        assert bool(rows) == (docs.limit(1).count() == 1)


def test_stages_keep_what_they_are_not_about(spark):
    docs = documents(spark)
    clean = docs.where("length(text) > 200")
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:3]:
        assert stage(spark, clean, SF).count() == clean.count(), name


def test_batches_to_python_are_bounded(spark):
    from ordersight.llm.common import BATCH_BYTES, bounded_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, str(64 << 20))
    bounded_batches(spark)
    assert spark.conf.get(key) == str(BATCH_BYTES)
    spark.conf.set(key, "1000")
    bounded_batches(spark)
    assert spark.conf.get(key) == "1000"
    spark.conf.unset(key)
