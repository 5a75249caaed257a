"""Best-fit packing of documents into fixed-length sequences with local search (operator 8).

Documents are tokenised once (ids, then the end id); only those longer than a
sequence are cut.  Only (id, piece, start, length, checksum) rows travel.  Full
pieces are sequences by themselves.  The others are dealt by row number into
cells of about ``CELL`` pieces; a cell is packed by best-fit decreasing and then
improved by moves, one-for-one and two-for-one exchanges from the emptiest bins
into fuller ones, each of which raises the sum of squared fills, until the cell
has no more bins than its tokens need or a whole pass over its bins empties none.
Each cell then hands its emptiest bins on: one, and those beyond what its tokens
need.  They are packed again over all cells, round by round, until one cell is left.

Tokenising goes word by word: where a text has only plain Latin-1 characters
and common punctuation, the tokenizer's own normalisation and splitting are
applied with a pattern, and each distinct word is encoded once by the tokenizer's
model (``MEMO`` words are kept at most); any other text, or one holding a special token, is encoded whole.

Defined cases: a null or empty text is one piece holding the end id; rows that
repeat, also with equal ids, are packed each by itself; null ids are kept; an
empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col, table, written

CAPACITY = 2048
END_ID = 0
CELL = 4096
MEMO = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", cell long, bin int, offset long, open boolean"

_PLAIN = "".join(chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 0x100),
                                  *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC])
_OTHER = re.compile(f"[^{re.escape(_PLAIN)}]")


def _of(kind: str) -> str:
    return re.escape("".join(c for c in _PLAIN if unicodedata.category(c)[0] == kind))


#: The tokenizer file's own split (fixed values), its classes spelled out for plain characters.
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\s{_of('L')}{_of('N')}]+")


class WordIds(dict):
    """Ids of words as little-endian 32-bit bytes, encoded by the tokenizer's model when first asked for."""

    def __init__(self, tokenizer):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.tokenize = tokenizer.model.tokenize
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def __missing__(self, word: str) -> bytes:
        shown = word if word.isascii() else self.bytes_of(word)[0][0]
        out = self[word] = np.array([t.id for t in self.tokenize(shown)], "<u4").tobytes()
        return out


class WordTokenizer:
    """Ids of texts as little-endian 32-bit bytes; each distinct word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.ids = WordIds(self.full)

    def encode(self, text: str) -> bytes:
        if _OTHER.search(text) or any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.ids) > MEMO:
            self.ids.clear()
        return b"".join(map(self.ids.__getitem__, _SPLIT.findall(text.lower())))


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        tok = WordTokenizer(tokenizer_path)
        for batch in batches:
            for at in range(0, len(batch), 64):
                rows = []
                for doc, text in zip(batch["id"].iloc[at:at + 64], batch["text"].iloc[at:at + 64]):
                    data = tok.encode(text or "") + end
                    for k, s in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[s:s + 4 * capacity]
                        rows.append((doc, k, s // 4, len(part) // 4, zlib.crc32(part)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype(
                    {"doc_id": "Int64"})

    return docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text")).mapInPandas(run, PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: item indices by bin."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        at = bisect_left(room, (s, -1))
        if at < len(room):
            free, b = room.pop(at)
            bins[b].append(int(i))
        else:
            free, b = capacity, len(bins)
            bins.append([int(i)])
        if free > s:
            insort(room, (free - s, b))
    return bins


def _pair_sums(sizes: np.ndarray) -> np.ndarray:
    """Sums of every two of a bin's items, each sum once."""
    distinct, count = np.unique(sizes, return_counts=True)
    first, second = np.triu_indices(len(distinct), 1)
    return np.unique(np.r_[distinct[first] + distinct[second], 2 * distinct[count > 1]])


def _two_of(items: list[int], sizes: np.ndarray, total: int) -> list[int]:
    """Two items of ``items`` with sizes that add up to ``total``."""
    seen: dict[int, int] = {}
    for i in items:
        j = seen.get(total - int(sizes[i]))
        if j is not None:
            return [j, i]
        seen.setdefault(int(sizes[i]), i)
    raise AssertionError("no such pair")


def improve(sizes: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Local search: empty the emptiest bins into fuller ones.

    A step moves one item, or gives one or two items of the bin for one smaller item of a fuller bin: the exchange
    that gains most among all items and all pairs.  Every step raises the sum of squared fills, so it ends."""
    sizes = sizes.astype(np.int64)
    home = np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        home[items] = b
    members = [set(x) for x in bins]
    fill = np.array([sizes[x].sum() for x in bins], np.int64)
    least = -(-int(sizes.sum()) // capacity)

    def shift(items, a, b):
        for i in items:
            members[a].discard(i)
            members[b].add(i)
            home[i] = b
            fill[a] -= sizes[i]
            fill[b] += sizes[i]

    def step(a: int) -> bool:
        free = np.where(fill >= fill[a], capacity - fill, 0)
        free[a] = 0
        own = sorted(members[a], key=lambda i: (-sizes[i], i))
        for i in own:  # move, to the tightest room
            fits = np.flatnonzero(free >= sizes[i])
            if len(fits):
                shift([i], a, int(fits[np.argmin(free[fits])]))
                return True
        best = (0, 0, -1, 1)
        for give, sums in ((1, np.unique(sizes[own])), (2, _pair_sums(sizes[own]))):
            if len(sums):  # for every item of a fuller bin the largest sum that fits in its place
                at = np.searchsorted(sums, sizes + free[home], side="right") - 1
                gain = np.where((at >= 0) & (home != a) & (free[home] > 0), sums[at] - sizes, 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (int(gain[k]), int(sums[at[k]]), k, give)
        gain, total, k, give = best
        if not gain:
            return False
        mine = [next(i for i in own if sizes[i] == total)] if give == 1 else _two_of(own, sizes, total)
        b = int(home[k])
        shift([k], b, a)
        shift(mine, a, b)
        return True

    emptied = True
    while emptied and sum(map(bool, members)) > least:
        emptied = False
        for a in np.argsort(fill, kind="stable").tolist():
            if not members[a]:
                continue
            while members[a] and step(a):
                pass
            if not members[a]:
                emptied = True
                if sum(map(bool, members)) <= least:
                    break
    return [sorted(x, key=lambda i: (-sizes[i], i)) for x in members if x]


def _pack_cells(rows: DataFrame, cells: int, capacity: int) -> DataFrame:
    """The rows packed cell by cell; ``open`` are the bins that a cell hands on (none if there is one cell)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "row"], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        where, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        bins = improve(sizes, best_fit(sizes, capacity), capacity)
        fill = np.array([sizes[items].sum() for items in bins])
        hand = len(bins) - -(-int(sizes.sum()) // capacity) + 1 if cells > 1 else 0
        handed = np.isin(np.arange(len(bins)), np.argsort(fill, kind="stable")[:hand])
        for b, items in enumerate(bins):
            at = np.cumsum(sizes[items])
            where[items], offset[items] = b, at - sizes[items]
        out = group[["doc_id", "piece", "start", "length", "ids_crc32", "cell"]].copy()
        out["bin"], out["offset"], out["open"] = where.astype(np.int32), offset, handed[where]
        return out

    return rows.withColumn("cell", F.pmod("row", F.lit(cells))).groupBy("cell").applyInPandas(run, PACKED)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, cell: int = CELL) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    cut = written(pieces(docs, tokenizer_path, id_col, text_col, capacity), "pieces")
    # Row numbers of a written table; consecutive within a file, so cells are of equal size.
    rows = cut.withColumn("row", F.monotonically_increasing_id())
    keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = rows.where(F.col("length") == capacity)
    small, number, done = rows.where(F.col("length") < capacity).select(*keep, "row"), 0, []
    count = cut.where(F.col("length") < capacity).count()

    def named(df: DataFrame, number: int) -> DataFrame:
        seq = F.expr(f"shiftleft({number}L, 56)") + F.shiftleft("cell", 24) + F.col("bin")
        return df.select(*keep, seq.alias("sequence_id"), "offset")

    while True:
        # A cell hands on few bins, so the rounds are about log(pieces) / log(bins of a cell).
        cells = max(1, count // cell)
        packed = _pack_cells(small, cells, capacity)
        if cells == 1:
            done.append(named(packed, number))
            break
        packed = written(packed, "packed")
        done.append(named(packed.where("NOT open"), number))
        small = packed.where("open").withColumn("row", F.monotonically_increasing_id()).select(*keep, "row")
        left = packed.where("open").count()
        cell, count, number = cell if left < count else max(count, left) + 1, left, number + 1
    out = full.select(*keep, (F.expr("shiftleft(127L, 56)") + F.col("row")).alias("sequence_id"),
                      F.lit(0).cast("bigint").alias("offset"))
    for part in done:
        out = out.unionByName(part)
    return out


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())


def stage(spark, docs, sf_dir):
    """Pipeline stage: the packing of the documents that are left."""
    return pack(docs, default_tokenizer())
