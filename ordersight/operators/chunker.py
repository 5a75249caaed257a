"""Heading-aware Markdown chunking over Arrow batches of documents.

A task takes its documents some ``SLICE`` bytes at a time and all lines of a slice together:
lines, their lengths, blank lines and headings are columns; sections and
blank-line blocks are runs of lines, found by comparing neighbours; and greedy
packing is prefix sums, a binary search for the end of a part begun anywhere, and
jumps from part to part for all sections of the slice at once.  Python sees single
lines only where they begin with ``#`` or are over the limit.  Documents are rows:
nothing is shuffled, and a lost executor repeats its own documents.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordersight.functions.text import SPACES
from ordersight.session import bounded_batches

# Fixed patterns and values of the chunking contract.
DEFAULT_MAX_CHARACTERS = 1800
MIN_MAX_CHARACTERS = 200
SOFT_CUT_FLOOR = 0.55
OVERVIEW = "Overview"
PATH_SEPARATOR = " > "

#: Bytes of Markdown chunked together, about (a longer document alone): lines and units take several times as much.
SLICE = 1 << 20

_S = f"[{SPACES}]"
_HEADING = re.compile(rf"(#{{1,6}}){_S}+([^\n\r\u2028\u2029]+?){_S}*#*{_S}*\Z")
_SPACES = re.compile(f"{_S}*")
_MD = re.compile(r"\.md\Z", re.IGNORECASE)

COLUMNS = ("document", "document_title", "section", "chunk_id", "chunk_seq", "text")


def validate_max_characters(max_characters) -> int:
    """The limit must be an integer of at least 200."""
    if isinstance(max_characters, bool) or not isinstance(max_characters, int) or max_characters < MIN_MAX_CHARACTERS:
        raise ValueError("maxCharacters must be an integer of at least 200.")
    return max_characters


def greedy_starts(length: np.ndarray, opens: np.ndarray, gap: int, limit: int) -> np.ndarray:
    """Mask of the units that begin a part when units are joined greedily, ``gap`` characters apart, up to ``limit``.

    ``opens`` marks the units that begin a part in any case.  With prefix sums the unit at which a part begun
    anywhere would end is one binary search; the parts are the jumps from each opening unit, all at once."""
    n = len(length)
    total = np.r_[0, np.cumsum(length + gap)]
    at = np.flatnonzero(opens)
    end = np.r_[at, n][np.searchsorted(at, np.arange(n), side="right")]
    after = np.searchsorted(total, total[:-1] + limit + gap, side="right") - 1
    after = np.minimum(np.maximum(after, np.arange(1, n + 1)), end)
    begin = np.zeros(n, bool)
    while len(at):
        begin[at] = True
        at = after[at]
        at = at[at < n]
        at = at[~opens[at]]
    return begin


def _joined(texts: list[str], begin: np.ndarray, gap: str) -> list[str]:
    cuts = [*np.flatnonzero(begin).tolist(), len(texts)]
    return [texts[a] if b - a == 1 else gap.join(texts[a:b]) for a, b in zip(cuts, cuts[1:])]


class _Cutter:
    """A line over the limit in pieces: up to the last space at or before the limit, or up to the limit if
    that space comes before ``SOFT_CUT_FLOOR`` of it; pieces are trimmed, empty ones dropped."""

    def __init__(self, limit: int):
        self.limit = limit
        self.cut = re.compile(rf"(?s:.{{{int(limit * SOFT_CUT_FLOOR)},{limit}}}(?= )|.{{{limit}}})")

    def __call__(self, line: str) -> list[str]:
        out, at = [], 0
        while len(line) - at > self.limit:
            end = self.cut.match(line, at).end()
            out.append(line[at:end].strip(SPACES))
            at = _SPACES.match(line, end).end()
        return [p for p in [*out, line[at:]] if p]


def _headings(lines: pa.Array, row: np.ndarray):
    """(line numbers, levels, names) of the headings among the lines; few lines begin with ``#``."""
    found = [(i, _HEADING.match(text)) for i, text in
             ((i, lines[i].as_py()) for i in np.flatnonzero(pc.starts_with(lines, "#").to_numpy(zero_copy_only=False)))]
    found = [(int(i), len(m[1]), m[2].strip(SPACES)) for i, m in found if m]
    return found


def _paths(headings, row: np.ndarray) -> tuple[dict[int, str], dict[int, str]]:
    """(path by heading line, last H1 by row).  A path names the last heading of every level above, a skipped
    level is empty."""
    paths, titles, slots, of = {}, {}, [""] * 7, -1
    for line, level, name in headings:
        if row[line] != of or level == 1:
            slots, of = [""] * 7, row[line]
        if level == 1:
            titles[int(of)] = name
            paths[line] = OVERVIEW
        else:
            slots[level:] = [""] * (7 - level)
            slots[level] = name
            paths[line] = PATH_SEPARATOR.join(slots[2:level + 1])
    return paths, titles


def chunk_batch(documents: pa.Array, markdown: pa.Array, limit: int) -> pa.RecordBatch:
    """The chunks of a batch of documents, all lines of the batch at a time."""
    split = pc.split_pattern(pc.replace_substring(pc.fill_null(markdown.cast(pa.large_string()), ""), "\r\n", "\n"), "\n")
    row = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    lines = split.flatten()
    headings = _headings(lines, row)
    paths, titles = _paths(headings, row)
    is_heading = np.zeros(len(row), bool)
    is_heading[list(paths)] = True
    # Sections open at headings and at the first line of a document; blocks are runs of lines that aren't blank.
    section = np.cumsum(is_heading | np.r_[True, row[1:] != row[:-1]])
    blank = pc.equal(pc.utf8_trim(lines, SPACES), "").to_numpy(zero_copy_only=False)
    body = np.flatnonzero(~is_heading & ~blank)
    first = np.r_[True, (np.diff(body) > 1) | (np.diff(section[body]) > 0)][:len(body)]
    last = np.r_[first[1:], True][:len(body)]
    text = lines.take(pa.array(body))
    text = pc.if_else(pa.array(first), pc.utf8_ltrim(text, SPACES), text)
    text = pc.if_else(pa.array(last), pc.utf8_rtrim(text, SPACES), text)
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = text.to_pylist()
    begin = np.flatnonzero(first)
    stop = np.r_[begin[1:], len(body)]
    total = np.r_[0, np.cumsum(size + 1)]
    block_size = total[stop] - total[begin] - 1
    long_parts = _long_blocks(texts, size, begin, stop, np.flatnonzero(block_size > limit), limit)
    # Units: blocks, or the parts of a long block.
    units: list[str] = []
    count = np.ones(len(begin), np.int64)
    lengths: list[int] = []
    for b, (a, e, n) in enumerate(zip(begin.tolist(), stop.tolist(), block_size.tolist())):
        if n > limit:
            units += long_parts[b]
            lengths += map(len, long_parts[b])
            count[b] = len(long_parts[b])
        else:
            units.append(texts[a] if e - a == 1 else "\n".join(texts[a:e]))
            lengths.append(n)
    unit_line = np.repeat(body[begin], count)
    unit_section = section[unit_line]
    opens = np.r_[True, unit_section[1:] != unit_section[:-1]][:len(units)]
    starts = greedy_starts(np.array(lengths, np.int64), opens, 2, limit)
    chunk_line = unit_line[starts]
    chunk_row = row[chunk_line]
    new_row = np.r_[True, chunk_row[1:] != chunk_row[:-1]][:len(chunk_row)]
    at = np.arange(len(chunk_row))
    seq = at - np.maximum.accumulate(np.where(new_row, at, 0)) + 1
    opened = np.array([p for p, _, _ in headings], np.int64)
    which = np.searchsorted(opened, chunk_line, side="right") - 1
    names = documents.to_pylist()
    out_names = [names[r] for r in chunk_row.tolist()]
    default = {r: _MD.sub("", names[r] or "").replace("_", " ") for r in set(chunk_row.tolist()) - titles.keys()}
    heads = [titles[r] if r in titles else default[r] for r in chunk_row.tolist()]
    # A heading of an earlier document is no section of this one.
    where = [paths[opened[w]] if w >= 0 and row[opened[w]] == r else OVERVIEW
             for w, r in zip(which.tolist(), chunk_row.tolist())]
    ids = [None if d is None else f"{d}#{n:04d}" for d, n in zip(out_names, seq.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(out_names, pa.string()), pa.array(heads, pa.string()), pa.array(where, pa.string()),
         pa.array(ids, pa.string()), pa.array(seq.astype(np.int32)), pa.array(_joined(units, starts, "\n\n"), pa.string())],
        list(COLUMNS))


def _long_blocks(texts, size, begin, stop, blocks, limit) -> dict[int, list[str]]:
    """The parts of the blocks over the limit: their lines joined greedily, lines over the limit in pieces.

    Every piece opens a part, and lines that follow may join a line's last one, unless only white space
    took the line over the limit."""
    cutter, units, opens, of = _Cutter(limit), [], [], []
    for b in blocks.tolist():
        fresh = True
        for k in range(begin[b], stop[b]):
            line, closed = texts[k], False
            if size[k] > limit:
                line = line.rstrip(SPACES)
                closed = len(line) <= limit
                pieces = [line] if closed else cutter(line)
                opens += [True] * len(pieces)
            else:
                pieces = [line]
                opens.append(fresh)
            units += pieces
            of += [b] * len(pieces)
            fresh = closed
    starts = greedy_starts(np.array([len(u) for u in units], np.int64), np.array(opens, bool), 1, limit)
    out: dict[int, list[str]] = {b: [] for b in blocks.tolist()}
    for b, part in zip(np.array(of, np.int64)[starts].tolist(), _joined(units, starts, "\n")):
        part = part.strip(SPACES)
        if part:
            out[b].append(part)
    return out


def chunk_batches(batches, limit: int, size: int = SLICE):
    """The chunks of batches of (document, markdown), some ``size`` bytes of Markdown at a time."""
    for batch in batches:
        bytes_ = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(bytes_) - bytes_) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for s, e in zip(cuts, cuts[1:]):
            if e > s:
                out = chunk_batch(batch.column(0).slice(s, e - s), batch.column(1).slice(s, e - s), limit)
                if out.num_rows:
                    yield out


def chunk_documents(df: DataFrame, document_col: str = "document", markdown_col: str = "markdown",
                    max_characters: int = DEFAULT_MAX_CHARACTERS) -> DataFrame:
    """Chunks of every (document, markdown) row, numbered ``document#0001`` onward.

    Rows are chunked each by itself, whatever they are named: of two documents of one name each keeps its own
    title, sections and numbers."""
    limit = validate_max_characters(max_characters)
    bounded_batches(df.sparkSession)

    def run(batches):
        return chunk_batches(batches, limit)

    schema = "document string, document_title string, section string, chunk_id string, chunk_seq int, text string"
    return df.select(F.col(document_col).cast("string").alias("document"),
                     F.col(markdown_col).cast("string").alias("markdown")).mapInArrow(run, schema)


def documents_as_markdown(documents: DataFrame) -> DataFrame:
    """Give the prose ``documents`` table Markdown structure, deterministically:
    an H1 title, an H2 per source, every other line as its own blank-line
    block, and an H4 under the H2 (a skipped H3) for every fourth document."""
    doc_id = F.col("doc_id")
    body = F.regexp_replace(F.col("text"), "\n", "\n\n")
    hole = F.when(doc_id % 4 == 0, F.lit("#### Detail\n")).otherwise(F.lit(""))
    md = F.concat(F.lit("# Document "), doc_id.cast("string"), F.lit("\n\n## "), F.col("source"),
                  F.lit("\n"), hole, body)
    return documents.select(doc_id, F.concat(F.lit("doc_"), doc_id.cast("string"), F.lit(".md")).alias("document"),
                            md.alias("markdown"))


def read_markdown_corpus(spark, directory: str) -> DataFrame:
    """S3: every ``*.md`` file (any case) of a directory as (document, markdown),
    one row per file; errors when there is none."""
    df = (spark.read.option("pathGlobFilter", "*.[mM][dD]").text(directory, wholetext=True)
          .select(F.col("_metadata.file_name").alias("document"), F.col("value").alias("markdown")))
    if df.limit(1).count() == 0:
        raise FileNotFoundError("No Markdown policy documents found in the approved documents directory.")
    return df


def load_policy_chunks(spark, directory: str, max_characters: int = DEFAULT_MAX_CHARACTERS) -> DataFrame:
    """S3: the chunks of a directory; errors when its files hold no text to chunk."""
    chunks = chunk_documents(read_markdown_corpus(spark, directory), max_characters=max_characters)
    if chunks.limit(1).count() == 0:
        raise ValueError("Policy documents did not contain any chunkable text.")
    return chunks
