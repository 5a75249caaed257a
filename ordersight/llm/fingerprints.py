"""SimHash document fingerprints and permuted block tables (operator 10).

Terms are pairs of adjacent lower-cased words (the word itself if there is only
one); a term's 64-bit hash votes for or against each bit with weight
1 + ln(count).  Words are hashed as polynomials from one running sum over the
text's bytes, so nothing is done word by word in Python.

``within_radius`` cuts the 64 bits into ``radius + 2`` blocks: fingerprints within
the radius agree on at least two whole blocks, so one table per pair of blocks,
led by these two, finds them; buckets are compared as in ``hamming``.

``edited_pairs`` puts every document beside its successor in descending id
order.  Rows are dealt by id ranges, one shuffle of the texts; the first row of
each range also goes to the range before it, the first of all to the last.

Defined cases: a null text is empty; a text without words has fingerprint zero;
equal texts have equal fingerprints; of rows with equal ids the smaller text
comes first; null ids come last; the only row of a table is its own successor;
an empty table gives an empty result; extra columns play no part; long texts
are hashed in slices cut at white space.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm import hamming
from ordersight.llm.common import col, table, written

RADIUS = 3
RANGE_ROWS = 2048
MAX_RANGES = 8192
SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
ROWS = ("doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, near_edited double, "
        "near_next double")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Fingerprints of texts; keeps the powers that the running sums need."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            one = np.ones(size, np.uint64)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                step = one.copy()
                step[1:] = np.uint64(base)
                setattr(self, name, np.multiply.accumulate(step))

    def words(self, data: bytes) -> np.ndarray:
        """64-bit hash of each word."""
        b = np.frombuffer(data, np.uint8)
        solid = (b != 32) & ((b < 9) | (b > 13))
        edge = np.flatnonzero(np.diff(np.r_[False, solid, False].view(np.int8)))
        start, end = edge[::2], edge[1::2]
        self._powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:len(b)], out=sums[1:])
        return _mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def fingerprint(self, text: str | None) -> int:
        data = (text or "").lower().encode("utf-8")
        parts, at = [], 0
        while at < len(data):
            stop = at + SLICE
            while stop < len(data) and not data[stop:stop + 1].isspace():
                stop += 1
            parts.append(self.words(data[at:stop]))
            at = stop
        words = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(words):
            return 0
        terms = words if len(words) == 1 else _mix(words[:-1] * np.uint64(_BASE) + words[1:])
        terms, count = np.unique(terms, return_counts=True)
        weight = (1 + np.log(count)).astype(np.float64)
        votes = np.zeros(64)
        for s in range(0, len(terms), 1 << 14):
            bits = np.unpackbits(terms[s:s + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            votes += weight[s:s + (1 << 14)] @ (bits.astype(np.float32) * 2 - 1)
        return int.from_bytes(np.packbits(votes > 1e-9).tobytes(), "big")


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / 64


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """The columns of ``ROWS`` for every row: its own and its edited text's fingerprint, and likenesses."""
    rows = docs.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    ranges = int(min(max_ranges, max(1, n // range_rows)))
    cuts = []
    if ranges > 1:
        at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
        cuts = rows.agg(F.percentile_approx("id", at, 10 * ranges).alias("q")).first()["q"] or []
    cuts = np.array(sorted(set(cuts)), np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:  # 0: the largest ids; after the last: nulls
        known = ids.notna().to_numpy()
        out = np.full(len(ids), len(cuts) + 1)
        out[known] = len(cuts) - np.searchsorted(cuts, ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(out.astype(np.int32))

    # The largest id of each range: at most max_ranges + 1 rows.
    first = sorted((r["b"], r["id"]) for r in rows.select(range_of("id").alias("b"), "id").groupBy("b")
                   .agg(F.max("id").alias("id")).collect())
    copy_to = {}  # range -> the range before it; that of the first is the last
    for k, (b, _) in enumerate(first):
        copy_to[b] = first[k - 1][0]
    heads = dict(first)

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, bucket: pd.Series) -> pd.Series:  # own range, and the range to close
        out = []
        for i, b in zip(ids, bucket):
            head = heads[b]
            out.append([b, copy_to[b]] if (pd.isna(i) if head is None else i == head) else [b])
        return pd.Series(out)

    rows = rows.withColumn("b", range_of("id"))
    rows = rows.select("id", "text", F.posexplode(places("id", "b")).alias("closes", "b"))
    rows = rows.repartition("b").sortWithinPartitions("b", "closes", F.desc_nulls_last("id"), "text")

    def run(batches):
        hasher = Hasher()
        before = None  # (range, id, text, fp) that waits for its successor
        for batch in batches:
            out = []
            for b, closes, i, text in zip(batch["b"], batch["closes"], batch["id"], batch["text"]):
                if closes and (before is None or before[0] != b):
                    continue  # the range is closed already
                fp = hasher.fingerprint(text)
                if before is not None and before[0] == b:
                    _, own_id, own, own_fp = before
                    cut = len(own) // 2
                    edited = own[:len(own) - cut] + text[:cut]
                    edited_fp = hasher.fingerprint(edited)
                    out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8")).hexdigest(), _signed(own_fp),
                                _signed(edited_fp), likeness(own_fp, edited_fp), likeness(own_fp, fp)))
                before = None if closes else (b, None if pd.isna(i) else int(i), text, fp)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in ROWS.split(", ")]).astype({"doc_id": "Int64"})

    return rows.select("b", "closes", "id", "text").mapInPandas(run, ROWS)


def block_tables(radius: int) -> tuple[list[list[int]], list[tuple]]:
    """Bits of radius + 2 blocks, and the pairs of blocks that lead a table each."""
    blocks = [list(map(int, x)) for x in np.array_split(np.arange(64), radius + 2)]
    return blocks, list(itertools.combinations(range(len(blocks)), 2))


def within_radius(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, links): for distinct fingerprints (fp, id), how many others lie within ``radius`` bits (if any)."""
    blocks, tables = block_tables(radius)
    masks = [sum(1 << b for k in lead for b in blocks[k]) for lead in tables]

    def keys(fp):
        rows = np.arange(len(fp))
        for t, mask in enumerate(masks):
            yield t, (fp & np.uint64(mask)).view(np.int64), rows, False

    return hamming.link_counts(hamming.expand(fps, keys), radius, masks)


def op10_fingerprints(spark, sf_dir):
    rows = written(edited_pairs(table(spark, sf_dir, "documents")), "fingerprints")
    distinct = written(rows.select("fp", F.col("fp").alias("id")).distinct(), "distinct-fingerprints")
    near = within_radius(distinct)
    out = rows.join(near, "fp", "left")
    word = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return out.select("doc_id", "n_chars", "edited_sha256", word("fp").alias("fingerprint"),
                      word("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next",
                      F.coalesce("links", F.lit(0).cast("bigint")).alias("n_near"))
