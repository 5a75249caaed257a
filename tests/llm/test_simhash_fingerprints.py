from __future__ import annotations

import hashlib

import numpy as np
import pytest
import xxhash

from ordersight.llm import fingerprints as fg
from ordersight.llm import hamming
from ordersight.llm import simhash_dedup as sd
from ordersight.llm.components import connected_components

from .messy import LONG, documents, empty, messy


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in words.translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_fingerprint_definition():
    for text in (None, "", "One", "a b c d", "A B c d e f g", "x y z\tq\nr s t u", LONG[:5000]):
        assert sd.fingerprint(text) == plain_fingerprint(text)


def test_query_against_all_pairs(spark):
    rows = sd.near_duplicates(documents(spark)).collect()
    fps = {r["id"]: sd.fingerprint(d["text"]) for r, d in zip(
        sorted(rows, key=lambda r: r["id"]), sorted(documents(spark).collect(), key=lambda d: d["doc_id"]))}
    ids = sorted(fps)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if (fps[a] ^ fps[b]).bit_count() <= 4]
    assert links and {r["id"]: r["component"] for r in rows} == components(links, ids)


@pytest.mark.parametrize("block", [2, 2048])
def test_hot_near_group_is_linked_whole(spark, block):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre}
    while len(fps) < 60:  # a crowd round one value, and a chain leading away from it
        fps.add(centre ^ sum(1 << int(b) for b in rng.choice(62, 3, replace=False)))
    fps |= {centre ^ ((1 << k) - 1) << 20 for k in range(0, 40, 4)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f, n) for n, f in enumerate(fps)], "fp long, id long")
    groups, radii = sd.plan(df)
    assert sum(radii) == sd.DISTANCE - sd.PARTITIONS + 1 and sorted(b for g in groups for b in g) == list(range(64))
    edges = hamming.spanning_edges(hamming.expand(df, sd.bucket_keys(groups, radii)), 4, block)
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    expected = components(links, range(len(fps)))
    assert {n: found.get(n, n) for n in range(len(fps))} == expected


def test_allocation_is_least_cost():
    costs = [[0, 5, 50, 500, 1000, 2000], [0, 1, 2, 3, 400, 500], [0, 9, 10, 11, 12, 13]]
    radii = sd.allocate(costs, 2)
    from itertools import product
    best = min(sum(c[r + 1] for c, r in zip(costs, x)) for x in product(range(-1, 5), repeat=3) if sum(x) == 2)
    assert sum(radii) == 2 and sum(c[r + 1] for c, r in zip(costs, radii)) == best


def test_dedup_defined_cases(spark):
    rows = sd.near_duplicates(messy(spark)).collect()
    assert len(rows) == messy(spark).count()
    by = {r["id"]: r for r in rows}
    assert by[2]["fp"] == by[3]["fp"] == 0 and by[3]["component"] == 2  # null and empty: zero, linked
    assert by[1]["component"] == 1 and by[None]["component"] is None
    assert sd.near_duplicates(empty(spark)).count() == 0
    kept = sd.stage(spark, messy(spark), None)
    assert kept.columns == messy(spark).columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]


def test_dedup_null_and_repeated_ids(spark):
    text = {n: " ".join(f"topic{n}word{k}" for k in range(60)) for n in range(1, 9)}
    rows = [(None, text[1]), (None, text[2]), (None, text[2]), (None, text[3]), (7, text[3]), (None, text[4]), (9, text[4]),
            (5, text[5]), (5, text[6]), (5, text[6]), (6, text[7]), (4, text[7]), (4, text[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted({(r["id"] or 0, r["fp"], r["component"] or 0) for r in sd.near_duplicates(docs).collect()})
    name = {1: 0, 2: 0, 3: 7, 4: 9, 5: 5, 6: 5, 7: 4, 8: 4}
    of = {t: n for n, t in text.items()}
    fp = {n: int(np.uint64(sd.fingerprint(t)).view(np.int64)) for n, t in text.items()}
    assert found == sorted({(i or 0, fp[of[t]], name[of[t]]) for i, t in rows})
    kept = sorted((r["doc_id"] or 0, of[r["text"]]) for r in sd.stage(spark, docs, None).collect())
    assert kept == [(0, 1), (0, 2), (4, 7), (4, 8), (5, 5), (5, 6), (7, 3), (9, 4)]


def test_edited_pairs_against_plain_code(spark):
    docs = documents(spark)
    hasher = fg.Hasher()
    texts = sorted(((d["doc_id"], d["text"]) for d in docs.collect()), reverse=True)
    got = {r["doc_id"]: r for r in fg.edited_pairs(docs, range_rows=30).collect()}
    assert len(got) == len(texts)
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other = hasher.fingerprint(text), hasher.fingerprint(edited)
        assert got[i]["fp"] % (1 << 64) == own and got[i]["edited_fp"] % (1 << 64) == other
        assert got[i]["near_edited"] == 1 - (own ^ other).bit_count() / 64
    near = np.array([(r["near_edited"], r["near_next"]) for r in got.values()])
    assert near[:, 0].mean() > near[:, 1].mean() + 0.1


def test_edited_pairs_defined_cases(spark):
    rows = fg.edited_pairs(messy(spark), range_rows=3).collect()
    assert len(rows) == messy(spark).count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_chars"] == 0 and by[2]["edited_sha256"] == hashlib.sha256(b"").hexdigest() and by[2]["fp"] == 0
    assert None in by  # ordered last, so followed by the largest id
    one = fg.edited_pairs(messy(spark).where("doc_id = 9")).collect()
    text = messy(spark).where("doc_id = 9").first()["text"]
    assert one[0]["edited_sha256"] == hashlib.sha256(
        (text[:len(text) - len(text) // 2] + text[:len(text) // 2]).encode()).hexdigest()
    assert fg.edited_pairs(empty(spark)).count() == 0


def test_weighted_fingerprint_slices(monkeypatch):
    whole = fg.Hasher().fingerprint(LONG)
    monkeypatch.setattr(fg, "SLICE", 1000)
    assert fg.Hasher().fingerprint(LONG) == whole != 0
    assert fg.Hasher().fingerprint("same text") == fg.Hasher().fingerprint("Same  TEXT")


@pytest.mark.parametrize("block", [3, 2048])
def test_permuted_tables_find_all_within_radius(spark, block, monkeypatch):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 62), 1 << 62, 20)]
    fps = sorted(set(base) | {b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False))
                              for b in base for n in (1, 2, 3, 4, 5)})
    monkeypatch.setattr(hamming.link_counts, "__defaults__", (block,))
    df = spark.createDataFrame([(f, f) for f in fps], "fp long, id long")
    got = {r["fp"]: r["links"] for r in fg.within_radius(df).collect()}
    want = {f: sum(((f ^ g) % (1 << 64)).bit_count() <= 3 for g in fps if g != f) for f in fps}
    assert got == {f: n for f, n in want.items() if n}
