"""Vector bin packing of training sequences (operator 11).

Every item has a demand in three dimensions: tokens, segments and loss-bearing
tokens; a sequence has a limit in each.  ``fill`` is the dot-product heuristic:
sequences are filled one after the other, and each time the item goes in whose
demand has the greatest dot product with the room that is left (both as shares
of the limits, dimensions weighted by how scarce they are among the items),
until nothing fits.  Where items may be cut, the head of the next-best item then
fills the sequence to its last token.

``pack`` cuts documents freely: all of a document's ids bear loss and each piece
is a segment.  Pieces of exactly one sequence are split off; what is left of the
documents is packed in *cells* of ``CELL`` items inside the task that tokenised
them, so only the few pieces of sequences that stayed short travel: they are
packed again over all cells, and what is short then is cut into sequences whose
lengths are powers of two, which need no padding.

``pack_examples`` is the form for instruction data: examples are never cut.

Tokenising: byte-level BPE whose ids are merge ranks goes through a faster
library with the same table; special tokens' strings, and any other tokenizer
file, go through the file's own library.

Defined cases: a null or empty text is one piece holding the end id; rows that
repeat, also with equal ids, are packed each by itself; null ids are kept; an
empty table gives an empty result; extra columns play no part.  In
``pack_examples`` a null demand counts as 0, a negative one as 0, and an example
that exceeds a limit by itself is a sequence of its own.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col, table, written

CAPACITY = 2048
SEGMENTS = 64
LIMITS = (CAPACITY, SEGMENTS, CAPACITY)
END_ID = 1
CELL = 4096
#: Sequences of whole examples under this share of every limit are packed again over all cells.
OPEN = 0.9
PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # byte-level BPE's own (fixed value)


class Ids:
    """Ids of texts, as the tokenizer file gives them without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.dtype = "<u2" if self.full.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._ranks(spec)

    @staticmethod
    def _ranks(spec: dict):
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
                 and spec.get("normalizer") is None and model.get("type") == "BPE"
                 and not (model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                          or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")))
        if not plain:
            return None
        import tiktoken

        # Byte-level alphabet: printable Latin-1 stands for itself, other bytes for code points from 256 on.
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(shown)))}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in added}
        merged = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        if any(ranks[bytes(byte_of[c] for c in a + b)] != 256 + n for n, (a, b) in enumerate(merged)):
            return None  # ids aren't merge ranks
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(s in text for s in self.special):
            try:
                return np.array(self.fast(text), self.dtype)
            except BaseException as e:  # the library's splitter gives up on runs of some 100,000 blanks
                if type(e).__name__ not in ("PanicException", "ValueError"):
                    raise
        return np.array(self.full.encode(text, add_special_tokens=False).ids, self.dtype)


def fill(demand: np.ndarray, limits, cut: bool = False) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, start, length), dot-product heuristic.

    ``demand``: rows of (tokens, segments, loss tokens).  With ``cut``, all tokens of an item bear loss
    and every piece counts the item's segments again.
    """
    limits = np.asarray(limits, np.float64)
    alive = np.arange(len(demand))
    need = np.asarray(demand, np.float64).reshape(-1, len(limits)).copy()
    share = need / limits
    scarce = share.sum(axis=0)
    scarce = scarce / scarce.sum() if scarce.sum() > 0 else np.ones(len(limits))
    start = np.zeros(len(demand), np.int64)
    out = []
    while len(alive):
        room, taken, gone = limits.copy(), [], np.zeros(len(alive), bool)
        while True:
            fits = ~gone & (need <= room).all(axis=1)
            value = share @ (scarce * room / limits)
            if not fits.any():
                break
            k = int(np.where(fits, value, -1.0).argmax())
            taken.append((int(alive[k]), int(start[k]), int(need[k, 0])))
            room -= need[k]
            gone[k] = True
        left = int(min(room[0], room[2])) if len(limits) > 2 else int(room[0])
        if not taken and not cut:  # beyond a limit by itself
            k = int(value.argmax())
            taken.append((int(alive[k]), 0, int(need[k, 0])))
            gone[k] = True
        elif cut and left > 0:
            may = ~gone & (need[:, 1] <= room[1]) & (need[:, 0] > left)
            if may.any():
                k = int(np.where(may, value, -1.0).argmax())
                taken.append((int(alive[k]), int(start[k]), left))
                start[k] += left
                need[k, 0] -= left
                need[k, 2] -= left
                share[k] = need[k] / limits
        out.append(taken)
        keep = ~gone
        alive, need, share, start = alive[keep], need[keep], share[keep], start[keep]
    return out


def by_powers(taken: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one short sequence, cut into sequences whose lengths are powers of two."""
    out, rest = [], list(taken)
    total = sum(n for _, _, n in rest)
    for bit in reversed(range(total.bit_length())):
        room, now = total & (1 << bit), []
        while room:
            item, start, n = rest.pop(0)
            part = min(n, room)
            now.append((item, start, part))
            room -= part
            if part < n:
                rest.insert(0, (item, start + part, n - part))
        if now:
            out.append(now)
    return out


class _Rows:
    """Result rows, as columns."""

    def __init__(self):
        self.rows: list[tuple] = []

    def add(self, doc, start, ids, total, sequence, offset, keep=False):
        wide = ids.astype("<u4").tobytes()
        self.rows.append((doc, start, len(ids), zlib.crc32(wide), total, sequence, offset, wide if keep else None))

    def frame(self) -> pd.DataFrame:
        out = pd.DataFrame(self.rows, columns=[*(c.split()[0] for c in PLACED.split(", ")), "ids"])
        self.rows = []
        return out.astype({"doc_id": "Int64"})


def _place(items, limits, out: _Rows, sequence, last: bool):
    """Pack (doc, start, ids, doc_tokens) items; sequences get the numbers that ``sequence`` gives."""
    demand = np.array([(len(ids), 1, len(ids)) for _, _, ids, _ in items], np.int64)
    for taken in fill(demand, limits, cut=True):
        full = sum(n for _, _, n in taken) == limits[0]
        for part in by_powers(taken) if last and not full else [taken]:
            number, offset = (sequence() if full or last else -1), 0
            for k, start, n in part:
                doc, base, ids, total = items[k]
                out.add(doc, base + start, ids[start:start + n], total, number, offset, keep=not (full or last))
                offset += n


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limits=LIMITS,
         end_id: int = END_ID, cell: int = CELL) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    capacity = min(limits[0], limits[2])  # of a document's ids, all of which bear loss
    limits = (capacity, limits[1], capacity)

    def first(batches):
        ids_of, number, out, held = Ids(tokenizer_path), TaskContext.get().partitionId() << 32, _Rows(), []

        def sequence():
            nonlocal number
            number += 1
            return number

        for batch in batches:
            for doc, text in zip(batch["id"], batch["text"]):
                ids = np.append(ids_of(text or ""), np.array([end_id], ids_of.dtype))
                whole = len(ids) - len(ids) % capacity
                for s in range(0, whole, capacity):
                    out.add(doc, s, ids[s:s + capacity], len(ids), sequence(), 0)
                if whole < len(ids):
                    held.append((doc, whole, ids[whole:].copy(), len(ids)))
                if len(held) >= cell:
                    _place(held, limits, out, sequence, last=False)
                    held = []
                if len(out.rows) >= 2048:
                    yield out.frame()
        if held:
            _place(held, limits, out, sequence, last=False)
        yield out.frame()

    def again(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable")
        number, out = (1 << 62) + (int(group["cell"].iloc[0]) << 24), _Rows()

        def sequence():
            nonlocal number
            number += 1
            return number

        items = [(d, s, np.frombuffer(i, "<u4"), t) for d, s, i, t in
                 zip(group["doc_id"], group["start"], group["ids"], group["doc_tokens"])]
        _place(items, limits, out, sequence, last=True)
        return out.frame().drop(columns="ids")

    texts = docs.select(col(id_col).cast("bigint").alias("id"), col(text_col).alias("text"))
    placed = written(texts.mapInPandas(first, PLACED + ", ids binary"), "vector-packed")
    short = placed.where("ids IS NOT NULL")
    cells = max(1, short.count() // cell)
    short = short.withColumn("cell", F.pmod(F.monotonically_increasing_id(), F.lit(cells)))
    return placed.where("ids IS NULL").drop("ids").unionByName(short.groupBy("cell").applyInPandas(again, PLACED))


def pack_examples(examples: DataFrame, limits, id_col: str = "id", tokens_col: str = "tokens",
                  segments_col: str = "segments", loss_col: str = "loss_tokens", cell: int = CELL) -> DataFrame:
    """(id, tokens, segments, loss_tokens, sequence_id, offset): whole examples under all three limits."""
    names = ["tokens", "segments", "loss_tokens"]
    need = [F.greatest(F.coalesce(col(c).cast("bigint"), F.lit(0)), F.lit(0)).alias(n)
            for c, n in zip((tokens_col, segments_col, loss_col), names)]
    rows = written(examples.select(col(id_col).alias("id"), *need), "examples")
    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, tokens long, segments long, loss_tokens long, cell long, bin int, offset long, open boolean"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*names, "id"], kind="stable").reset_index(drop=True)
        demand = group[names].to_numpy()
        where, offset, is_open = np.zeros(len(group), np.int32), np.zeros(len(group), np.int64), []
        for b, taken in enumerate(fill(demand, limits)):
            at = [k for k, _, _ in taken]
            where[at] = b
            offset[at] = np.cumsum(demand[at, 0]) - demand[at, 0]
            is_open.append(bool((demand[at].sum(axis=0) < OPEN * np.asarray(limits)).all()))
        return group.assign(bin=where, offset=offset, open=np.array(is_open, bool)[where])[
            ["id", *names, "cell", "bin", "offset", "open"]]

    def packed(df: DataFrame, count: int) -> DataFrame:
        number = F.pmod(F.monotonically_increasing_id(), F.lit(max(1, count // cell)))
        return df.withColumn("cell", number).groupBy("cell").applyInPandas(run, schema)

    def named(df: DataFrame, number: int) -> DataFrame:
        seq = F.expr(f"shiftleft({number}L, 60)") + F.shiftleft("cell", 24) + F.col("bin")
        return df.select("id", *names, seq.alias("sequence_id"), "offset")

    one = written(packed(rows, rows.count()), "examples-packed")
    short = one.where("open").select("id", *names)
    return named(one.where("NOT open"), 0).unionByName(named(packed(short, one.where("open").count()), 1))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op11_vector_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
