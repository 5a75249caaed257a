"""Suffix-array deduplication of repeated byte strings (operator 5).

Removes every byte that lies in a string of ``length`` bytes that also starts
anywhere else, in the same or another text; matches never cross texts.

1. Anchors.  Every window of ``length`` bytes is owned by the smallest hashed
   ``GRAM``-byte string in it (the leftmost of equal ones), so equal windows have
   the same anchor at the same offset, and windows owned by one anchor occurrence
   form one run: its context.  Anchors are counted over the corpus; a context
   whose anchor occurs once cannot hold a repeated string and stays behind.
2. Shards.  Contexts are dealt by anchor, so equal windows meet; anchors with more
   than ``HOT`` contexts are dealt over several shards, each in a task of its own.  A shard of about
   ``SHARD`` bytes (equal contexts once, with their number) gets a suffix array by
   Larsson-Sadakane refinement: sorted by 8 bytes, then only unsorted groups by the
   ranks 8, 16, 32, ... bytes on, up to the needed depth.  Kasai's common
   prefixes of neighbours, computed for all contexts in step, tell which windows repeat.
3. Merge.  Shards of one hot anchor emit a digest per distinct window; sorted
   together, binary search finds those that other shards hold too.
4. The repeated windows of a text are merged to spans and cut out.

Equal texts are worked on once: their bytes are all repeated (from ``length``
on).  A text's key is its 64-bit hash and byte length.

Defined cases: null texts are empty; texts shorter than ``length`` keep all their
bytes; rows that repeat, equal ids included, count as separate texts; null ids
are kept; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col, remove, scratch_path, table, written, written_to

LENGTH = 200
GRAM = 32
SHARD = 1 << 20
HOT = 8192
#: Bytes of contexts read before they are sorted, equal ones included.
READ = 1 << 22
#: Digests handed on at once.
SEND = 1 << 16
#: Bytes of text hashed at once (the arrays then stay in the processor's cache).
SLICE = 1 << 17
CONTEXTS = "key long, salt int, salts int, tid long, bytes int, start int, context binary"
FOUND = "tid long, bytes int, first int, last int, d1 long, d2 long, local boolean"


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def words_at(b: np.ndarray, order: str) -> np.ndarray:
    """The 8 bytes from each position (zeros behind the end) as one number, least (``<``) or most (``>``)
    significant byte first."""
    pad = np.r_[b, np.zeros(8, np.uint8)]
    return np.ndarray(len(b), f"{order}u8", pad, strides=(1,)).astype(np.uint64)


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """64-bit hash of the ``gram`` bytes (a power of two, 8 at least) from each position."""
    h = words_at(b, "<")
    size = 8
    h = _mix(h, h >> np.uint64(32))
    while size < gram:
        h = _mix(h[:-size], h[size:])
        size *= 2
    return h[:max(0, len(b) - gram + 1)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text number, anchor hash, first and last window start) of every context, in order."""
    parts = []
    at = 0
    while at < len(texts):  # short texts together; a long one alone, in slices that share window starts
        size, stop = 0, at
        while stop < len(texts) and (stop == at or size + len(texts[stop]) <= SLICE):
            size += len(texts[stop])
            stop += 1
        joined = b"".join(texts[at:stop])
        sizes = np.array([len(t) for t in texts[at:stop]], np.int64)
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        for s in range(0, max(1, len(joined) - length + 1), SLICE):
            piece = np.frombuffer(joined, np.uint8, min(len(joined) - s, SLICE + length - 1), s)
            if len(piece) >= length:
                parts.append(_contexts(piece, s, at, ends, owner[s:s + len(piece)], length, gram))
        at = stop
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _contexts(piece, offset, first_text, ends, text, length, gram):
    h = gram_hashes(piece, gram)
    low = np.uint64(0xFFFFFFFF)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    owner = (sliding_min(packed, length - gram + 1) & low).astype(np.int64)
    start = np.arange(offset, offset + len(owner))
    text = text[:len(owner)]
    ok = start + length <= ends[text]
    start, owner, text = start[ok], owner[ok], text[ok]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])[:len(start)]
    last = np.r_[new[1:], len(start)] - 1
    base = np.r_[0, ends][text[new]]
    return text[new] + first_text, h[owner[new]], start[new] - base, start[last] - base


def suffix_order(b: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position by its first ``depth`` bytes (equal bytes, equal rank), by
    Larsson-Sadakane refinement.  ``left``: bytes up to the end of a position's context;
    ranks hold for positions with ``depth`` of them."""
    n = len(b)
    word = words_at(b, ">")
    slots = np.arange(n, dtype=np.int32)
    pos = np.argsort(word).astype(np.int32)
    key = word[pos]
    del word
    rank = np.empty(n, np.int32)
    h = 8
    while True:
        head = np.r_[True, key[1:] != key[:-1]]
        at = np.flatnonzero(head)
        size = np.diff(np.r_[at, len(key)])
        rank[pos] = np.repeat(slots[at], size)  # the group's first place in the array
        if h >= depth:
            return rank
        jump = min(h, depth - h)
        # Unsorted groups only, and positions for which jump + h more bytes mean something.
        keep = np.repeat(size > 1, size) & (left[pos] >= h + jump)
        slots, pos = slots[keep], pos[keep]
        if not len(pos):
            return rank
        key = rank[pos].astype(np.uint64) << np.uint64(32)
        key |= rank[pos + jump].astype(np.uint64)
        # Members that went (too near their end) leave gaps; the first places stay in order.
        order = np.argsort(key)
        pos, key = pos[order], key[order]
        h += jump


def kasai(b: np.ndarray, begin: np.ndarray, count: np.ndarray, before: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix, up to ``depth``, of each window start with its predecessor in sorted order.

    ``before[p]``: the predecessor of position p, or -1.  Contexts (``begin``, ``count``
    window starts each) are walked in step: from one start to the next the common prefix
    shrinks by one at most.  Where it was ``depth`` the order of the two successors is
    open, and the comparison starts anew.
    """
    word = words_at(b, "<")
    lcp = np.zeros(len(b), np.int32)
    have = np.zeros(len(begin), np.int64)
    live = np.argsort(-count, kind="stable")
    for step in range(int(count.max(initial=0))):
        live = live[:np.searchsorted(-count[live], -step)]
        p = begin[live] + step
        q = before[p]
        h = np.where(q >= 0, have[live], 0)
        todo = np.flatnonzero(q >= 0)
        while len(todo):
            at = h[todo]
            diff = word[p[todo] + at] ^ word[q[todo] + at]
            low = diff & (~diff + np.uint64(1))  # lowest differing bit
            same = np.where(diff == 0, 8, np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64)
            h[todo] = np.minimum(at + same, depth)
            todo = todo[(same == 8) & (h[todo] < depth)]
        lcp[p] = h
        have[live] = np.where(h >= depth, 0, np.maximum(h - 1, 0))
    return lcp


def _digests(b: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the ``length`` bytes from each position of ``at``."""
    out = []
    for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
        byte = _mix(np.arange(1, 257, dtype=np.uint64), np.full(256, base, np.uint64))
        power = np.full(len(b) + 1, base, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(len(b) + 1, np.uint64)
        sums[1:] = byte[b]
        sums[1:] *= power[:-1]
        np.cumsum(sums, out=sums)
        power[1:] = pow(base, -1, 1 << 64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        h = (sums[at + length] - sums[at]) * power[at]
        out.append(_mix(h, h >> np.uint64(31)).view(np.int64))
    return out[0], out[1]


def sorted_repeats(texts: list[bytes], times: np.ndarray, hot: np.ndarray, length: int):
    """Repeated window starts of distinct contexts by suffix array and common prefixes.

    ``times``: how often each context came; ``hot``: whether its anchor has other shards.  Gives (context,
    first, last) of runs of repeated starts, and (context, start, digest, digest) of one start per distinct
    window of the hot ones."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    # Positions of a shard fit 32 bits; what one step leaves behind goes before the next.
    left = np.repeat((begin + sizes).astype(np.int32), sizes) - np.arange(len(b), dtype=np.int32)
    rank = suffix_order(b, left, length)
    starts = np.flatnonzero(left >= length).astype(np.int32)
    del left
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes - length + 1)
    order = starts[np.argsort(rank[starts], kind="stable")]
    del rank
    before = np.full(len(b), -1, np.int32)
    before[order[1:]] = order[:-1]
    joined = kasai(b, begin, sizes - length + 1, before, length)[order[1:]] >= length
    del before
    # A start repeats if a neighbour shares all its bytes, or its context came more than once.
    same = np.zeros(len(b), bool)
    same[order[1:][joined]] = True
    same[order[:-1][joined]] = True
    flag = same[starts] | (times[owner] > 1)
    at = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (flag[1:] != flag[:-1])])
    stop = np.r_[at[1:], len(starts)] - 1
    at, stop = at[flag[at]], stop[flag[at]]
    runs = owner[at], starts[at] - begin[owner[at]], starts[stop] - begin[owner[at]]
    if not hot.any():
        return runs, None
    head = np.zeros(len(b), bool)
    head[order[np.r_[True, ~joined]]] = True
    pick = hot[owner] & head[starts]
    return runs, (owner[pick], starts[pick] - begin[owner[pick]], *_digests(b, starts[pick], length))


def _found(rows: pd.DataFrame, first, last, d1, d2, local: bool) -> pd.DataFrame:
    """Rows of ``FOUND``: window starts of contexts, by their places in the texts."""
    start = rows["start"].to_numpy()
    return pd.DataFrame({"tid": rows["tid"].to_numpy(), "bytes": rows["bytes"].to_numpy(np.int32),
                         "first": (start + first).astype(np.int32), "last": (start + last).astype(np.int32),
                         "d1": d1, "d2": d2, "local": local})


def shard_repeats(rows: pd.DataFrame, length: int = LENGTH, size: int = SHARD):
    """Runs of repeated window starts of whole anchors' contexts (sorted by key, salt), and digests for hot anchors,
    in pieces of about ``SEND`` rows."""
    # Equal contexts of an anchor are sorted once.
    group = rows.groupby(["key", "salt", "context"], sort=False).ngroup().to_numpy()
    times = np.bincount(group)
    _, first = np.unique(group, return_index=True)
    rank_of = np.argsort(np.argsort(first))  # distinct contexts in the order of the rows
    group, first = rank_of[group], np.sort(first)
    times = np.bincount(group)
    keys = rows[["key", "salt"]].to_numpy()[first]
    hot = rows["salts"].to_numpy()[first] > 1
    new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
    anchor = np.cumsum(new) - 1
    # A context that is its anchor's only one has no other to be compared with.
    alone = (np.bincount(anchor)[anchor] == 1) & ~hot
    sizes = rows["context"].str.len().to_numpy()[first]
    only = np.flatnonzero(alone & (times > 1))
    runs = [(only, np.zeros(len(only), np.int64), sizes[only] - length)]
    where = rows[["tid", "bytes", "start"]].assign(group=group)
    others = np.flatnonzero(~alone)
    if len(others):
        # Shards of about ``size`` bytes, cut between anchors.
        part = np.cumsum(sizes[others]) // size
        part = np.maximum.accumulate(part[np.searchsorted(anchor[others], anchor[others])])
        for k in np.split(others, np.flatnonzero(np.diff(part)) + 1):
            found, digests = sorted_repeats(rows["context"].iloc[first[k]].tolist(), times[k], hot[k], length)
            runs.append((k[found[0]], *found[1:]))
            if digests is not None:
                at, start, d1, d2 = digests
                for s in range(0, len(at), SEND):
                    cut = slice(s, s + SEND)
                    yield _found(where.iloc[first[k[at[cut]]]], start[cut], start[cut], d1[cut], d2[cut], False)
    runs = pd.DataFrame(dict(zip(("group", "first", "last"), (np.concatenate(x) for x in zip(*runs)))))
    out = where.merge(runs, on="group")
    for s in range(0, len(out), SEND):
        part = out.iloc[s:s + SEND]
        yield _found(part, part["first"].to_numpy(), part["last"].to_numpy(), 0, 0, True)


def _shards(batches, length, size):
    """Whole anchors, about ``READ`` bytes of contexts at a time."""
    rest, held = [], 0
    for batch in batches:
        for s in range(0, len(batch), 2048):
            part = batch.iloc[s:s + 2048]
            rest.append(part)
            held += int(part["context"].str.len().sum())
            if held >= READ:
                rows = pd.concat(rest, ignore_index=True)
                keys = rows[["key", "salt"]].to_numpy()
                change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
                cut = int(change[-1]) + 1 if len(change) else 0
                if cut:
                    yield from shard_repeats(rows.iloc[:cut].reset_index(drop=True), length, size)
                    rows = rows.iloc[cut:]
                rest, held = [rows], int(rows["context"].str.len().sum())
    if held:
        yield from shard_repeats(pd.concat(rest, ignore_index=True), length, size)


def _merge(batches):
    """Digests sorted in a partition: those found more than once by binary search."""
    rest = None
    columns = ["tid", "bytes", "first", "last"]
    for batch in batches:
        if rest is not None:
            batch = pd.concat([rest, batch], ignore_index=True)
        d1 = batch["d1"].to_numpy()
        cut = int(np.searchsorted(d1, d1[-1])) if len(d1) else 0  # the last value may go on
        done, rest = batch.iloc[:cut], batch.iloc[cut:]
        if len(done):
            yield done.loc[_found_again(done), columns]
    if rest is not None and len(rest):
        yield rest.loc[_found_again(rest), columns]


def _found_again(rows: pd.DataFrame) -> np.ndarray:
    d1 = rows["d1"].to_numpy()
    d = _mix(d1.view(np.uint64), rows["d2"].to_numpy().view(np.uint64))
    order = np.lexsort((d, d1))
    d1s, ds = d1[order], d[order]
    lo, hi = np.searchsorted(d1s, d1), np.searchsorted(d1s, d1, side="right")
    many = hi - lo > 1
    out = np.zeros(len(rows), bool)
    for k in np.flatnonzero(many):
        seg = ds[lo[k]:hi[k]]
        out[k] = np.searchsorted(seg, d[k], side="right") - np.searchsorted(seg, d[k]) > 1
    return out


def repeated_starts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH,
                    shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """(tid, bytes, first, last): runs of window starts whose string occurs again, for distinct texts."""
    return _repeats(docs, scratch_path(docs.sparkSession, "repeats"), text_col, id_col, length, shard, hot)


def _repeats(docs: DataFrame, path: str, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH,
             shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``repeated_starts``, read from the table that is written to ``path``."""
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tid"), F.octet_length("text").alias("bytes"))
    rows = rows.where(F.col("bytes") >= length)

    @F.pandas_udf("array<long>")
    def keys_of(text: pd.Series) -> pd.Series:
        data = [t.encode("utf-8") for t in text]
        owner, key, _, _ = anchors(data, length)
        cut = np.searchsorted(owner, np.arange(len(data) + 1))
        key = key.view(np.int64)
        return pd.Series([key[cut[k]:cut[k + 1]] for k in range(len(data))], dtype=object)

    used = [scratch_path(spark, name) for name in ("anchors", "repeated-anchors")]
    seen = written_to(rows.select("id", "tid", "bytes", F.explode(keys_of("text")).alias("key")), used[0])
    often = written_to(seen.groupBy("key").count().where("count > 1")
                       .select("key", F.ceil(F.col("count") / hot).cast("int").alias("salts"), "count"), used[1])
    # Tasks of about ``hot`` contexts; the slices of a hot anchor go to consecutive ones, so no two share a task.
    tasks = max(1, -(-(often.agg(F.sum("count")).first()[0] or 0) // hot))
    kept = seen.join(often.drop("count"), "key").groupBy("tid", "bytes").agg(
        F.min("id").alias("rep"), F.collect_set(F.struct("key", "salts")).alias("keys"))
    kept = kept.select(F.col("tid").alias("k_tid"), F.col("bytes").alias("k_bytes"), "rep", "keys")
    # One text of each key, that of its smallest id.
    picked = rows.join(kept, (F.col("tid") == F.col("k_tid")) & (F.col("bytes") == F.col("k_bytes"))
                       & F.col("id").eqNullSafe(F.col("rep")))

    def cut_out(batches):
        for batch in batches:
            for s in range(0, len(batch), 256):
                part = batch.iloc[s:s + 256]
                data = [t.encode("utf-8") for t in part["text"]]
                owner, key, first, last = anchors(data, length)
                key = key.view(np.int64)
                tids, sizes = part["tid"].to_numpy(), part["bytes"].to_numpy()
                bounds = np.searchsorted(owner, np.arange(len(data) + 1))
                out = []
                for k, wanted in enumerate(part["keys"]):
                    salts = {x["key"]: x["salts"] for x in wanted}
                    for n in range(bounds[k], bounds[k + 1]):
                        if (m := salts.get(int(key[n]))) is not None:
                            f, e = int(first[n]), int(last[n])
                            out.append((int(key[n]), (int(tids[k]) ^ f) % m, m, tids[k], sizes[k], f,
                                        data[k][f:e + length]))
                if out:
                    yield pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXTS.split(", ")]).astype(
                        {"salt": "int32", "salts": "int32", "bytes": "int32", "start": "int32"})

    # Rows that repeat id and text give the same context twice.
    contexts = picked.select("text", "tid", "bytes", "keys").mapInPandas(cut_out, CONTEXTS)
    home = F.pmod(F.xxhash64("key") + F.col("salt"), F.lit(tasks)).cast("int")
    contexts = contexts.repartitionById(tasks, home).sortWithinPartitions("key", "salt", "tid", "bytes", "start")
    found = written_to(contexts.mapInPandas(lambda it: _shards(_once(it), length, shard), FOUND), path)
    remove(spark, *used)
    again = (found.where("NOT local").repartition("d1").sortWithinPartitions("d1", "d2")
             .mapInPandas(_merge, "tid long, bytes int, first int, last int"))
    return found.where("local").select("tid", "bytes", "first", "last").unionByName(again)


def _once(batches):
    """Sorted contexts without those of the text and place just before."""
    last = None
    for batch in batches:
        if len(batch):
            same = batch[["key", "tid", "bytes", "start"]].to_numpy()
            keep = np.r_[last is None or (same[0] != last).any(), (same[1:] != same[:-1]).any(axis=1)]
            last = same[-1]
            yield batch.loc[keep]


def without_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH,
                    **more) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, spans, kept binary) of every row; spans: (from, to) removed bytes."""
    found = scratch_path(docs.sparkSession, "repeats")
    runs = _repeats(docs, found, text_col, id_col, length, **more)
    by_text = runs.groupBy("tid", "bytes").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    rows = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("tid"), F.octet_length("text").alias("bytes"))
    copies = rows.groupBy("tid", "bytes").count().where(f"count > 1 AND bytes >= {length}").select(
        "tid", "bytes", F.lit(True).alias("copied"))
    marks = written(by_text.join(copies, ["tid", "bytes"], "full"), "marks")
    remove(docs.sparkSession, found)
    rows = rows.join(marks, ["tid", "bytes"], "left")
    schema = ("id long, n_bytes long, n_removed long, n_spans long, spans array<struct<a:long,b:long>>, kept binary")

    def cut(batches):
        for batch in batches:
            for s in range(0, len(batch), 256):
                out = []
                for i, text, runs_, copied in zip(*(batch[c].iloc[s:s + 256] for c in ("id", "text", "runs", "copied"))):
                    data = text.encode("utf-8")
                    if copied is True:
                        spans = [(0, len(data))]
                    else:
                        spans = merged(runs_, length)
                    kept, at = [], 0
                    for a, e in spans:
                        kept.append(data[at:a])
                        at = e
                    kept.append(data[at:])
                    kept = b"".join(kept)
                    out.append((i, len(data), len(data) - len(kept), len(spans), [{"a": a, "b": e} for a, e in spans], kept))
                yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"]).astype(
                    {"id": "Int64"})

    return rows.select("id", "text", "runs", "copied").mapInPandas(cut, schema)


def merged(runs, length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by windows that start in ``runs``."""
    out: list[list[int]] = []
    for a, e in sorted((r["first"], r["last"] + length) for r in (runs if runs is not None else [])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([int(a), int(e)])
    return [tuple(x) for x in out]


def op5_suffix_dedup(spark, sf_dir):
    out = without_repeats(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))
