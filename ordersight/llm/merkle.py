"""Merkle manifest of a dataset (operator 13).

Every row is a leaf, every source a tree of fan-out ``FAN``: leaves ascend by id,
and runs of ``FAN`` consecutive nodes of a level hash to a node of the next (the
last run may be shorter, down to one) until one node is left, the subroot.  The
subroots, in order of source, are the leaves of one more tree.

The trees are kept as postorder append logs.  ``position`` gives a node's place
in its tree's log in closed form from the sizes of the complete subtrees before
it, so nothing has to be searched or numbered: *aligned builders* -- a builder
owns ``FAN ** HEIGHT`` consecutive leaves -- hash their subtree at one go and
append its nodes in the order of completion, and builders of the next rounds do
the same with the tops of the ones below.  A subtree's nodes are one contiguous
stretch of the log.  Proofs are read from the logs: a builder's own leaves find
their siblings inside its stretch, and the siblings above it, few for each
builder, are joined by their positions.

Leaves are ranked by the ordered scan (dealt by range of source, id, digest; a
hot source or id spreads); no task holds more than a builder's leaves.

Defined cases: null fields hash as ``-``, empty ones as ``0:``; a null source is
a tree of its own, ahead of the others; null ids come first in their tree and are
not tampered with; rows with equal ids are ordered by their leaf, equal rows are
separate leaves; an empty table gives an empty result; extra columns play no part.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.scan import ordered_scan
from ordersight.llm.common import col, table, written

FAN = 3
#: Levels of a builder: FAN ** 7 = 2,187 leaves.
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LOG = "tree string, leaves long, level int, idx long, pos long, digest string"


def levels(n: int, fan: int = FAN) -> list[int]:
    """Nodes on each level of a tree of ``n`` leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def position(level: int, idx: int, sizes: list[int], fan: int = FAN) -> int:
    """Postorder position of node ``idx`` of ``level`` in the tree with ``sizes`` nodes a level."""
    at, k = idx, idx
    for size in sizes[level + 1:]:            # parents complete before it
        k //= fan
        at += k
    k = idx + 1
    for size in reversed(sizes[:level]):      # all below it and before it
        k *= fan
        at += min(k, size)
    return at


def siblings(idx: int, size: int, fan: int = FAN) -> list[int]:
    """The others of the run that holds node ``idx`` on a level of ``size`` nodes."""
    first = idx - idx % fan
    return [k for k in range(first, min(first + fan, size)) if k != idx]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """A value as hashed: ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _grow(base: int, first: int, digests: list[str], sizes: list[int], height: int, fan: int):
    """(level, idx, digest) above ``digests`` (nodes ``first``... of level ``base``) in order of completion, leaves
    included; at most ``height`` levels."""
    top = min(base + height, len(sizes) - 1)
    open_: list[list[str]] = [[] for _ in range(height + 1)]
    count = [first // fan ** k for k in range(height + 1)]

    def append(level: int, digest: str):
        at = level - base
        idx = count[at]
        count[at] += 1
        yield level, idx, digest
        if level < top:
            open_[at].append(digest)
            if len(open_[at]) == fan or idx == sizes[level] - 1:
                run, open_[at] = open_[at], []
                yield from append(level + 1, sha("".join(run)))

    for d in digests:
        yield from append(base, d)


def build(leaves: DataFrame, most: int, height: int = HEIGHT, fan: int = FAN) -> list[DataFrame]:
    """The log of every tree, one part per round, from (tree, leaves, rank from 0, digest) rows.

    ``most``: leaves of the largest tree.  A part holds what its builders append; a node that two rounds meet
    (a builder's top) is in the lower one only.
    """
    parts, base, now = [], 0, leaves.select("tree", "leaves", F.col("rank").alias("idx"), "digest")
    while True:
        width, at, lowest = fan ** height, base, base == 0

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("idx", kind="stable")
            tree, n = group["tree"].iloc[0], int(group["leaves"].iloc[0])
            sizes = levels(n, fan)
            rows = [(tree, n, lv, i, position(lv, i, sizes, fan), d)
                    for lv, i, d in _grow(at, int(group["idx"].iloc[0]), list(group["digest"]), sizes, height, fan)
                    if lowest or lv > at]
            return pd.DataFrame(rows, columns=[c.split()[0] for c in LOG.split(", ")])

        builder = F.expr(f"idx div {width}").alias("builder")
        part = written(now.groupBy("tree", builder).applyInPandas(run, LOG), f"merkle-{base}")
        parts.append(part)
        base += height
        if len(levels(most, fan)) - 1 <= base:
            return parts
        now = part.where(F.col("level") == base).select("tree", "leaves", "idx", "digest")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def roots(parts: list[DataFrame], fan: int = FAN) -> DataFrame:
    """(tree, leaves, digest) of every tree's root: the only node of the lowest level that has one."""
    width = F.pow(F.lit(float(fan)), F.col("level"))
    only = (F.col("idx") == 0) & (width >= F.col("leaves")) & ((F.col("level") == 0) | (width < fan * F.col("leaves")))
    return _union(parts).where(only).select("tree", "leaves", "digest")


def _paths(nodes: DataFrame, log: DataFrame, base: int, fan: int) -> DataFrame:
    """(tree, idx, path): for nodes (tree, leaves, idx) of level ``base`` the siblings from there up to the root.

    ``path`` is one string of runs, lowest first: ``digest,digest*digest;...`` with ``*`` where the node itself stands.
    """
    @F.udf("array<struct<level:int,k:int,pos:bigint>>")
    def wanted(n, idx):
        sizes, out = levels(n, fan), []
        for level in range(base, len(sizes) - 1):
            first = idx - idx % fan
            out += [(level, k - idx, position(level, k, sizes, fan)) for k in siblings(idx, sizes[level], fan)]
            out += [(level, 0, -1)]          # the node itself
            idx = first // fan
        return out

    asked = nodes.select("tree", "idx", F.explode_outer(wanted("leaves", "idx")).alias("w")).select(
        "tree", "idx", "w.level", "w.k", "w.pos")
    found = asked.join(log.select("tree", "pos", "digest"), ["tree", "pos"], "left")
    runs = F.array_sort(F.collect_list(F.struct("level", "k", F.coalesce("digest", F.lit("*")).alias("d"))))
    text = F.array_join(F.transform("runs", lambda r: F.concat(r["level"].cast("string"), F.lit(":"), r["d"])), ";")
    # No siblings at all (a tree of one node): one null entry.
    return (found.where("pos IS NOT NULL OR level IS NULL").groupBy("tree", "idx").agg(runs.alias("runs"))
            .select("tree", "idx", F.when(F.col("runs")[0]["level"].isNull(), "").otherwise(text).alias("path")))


def _runs(path: str | None) -> list[list[str]]:
    """The runs of a path, lowest first; the node's own place is ``*``."""
    out: list[list[str]] = []
    was = None
    for entry in path.split(";") if path else []:
        level, digest = entry.split(":")
        if level != was:
            out.append([])
            was = level
        out[-1].append(digest)
    return out


def _fold(digest: str, runs: list[list[str]]) -> str:
    for run in runs:
        digest = sha("".join(digest if d == "*" else d for d in run))
    return digest


def manifest(docs: DataFrame, id_col: str = "doc_id", tree_col: str = "source", fields=FIELDS,
             tampered: list[Column] | None = None, height: int = HEIGHT, fan: int = FAN) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``tampered``: the fields' values as found later, in the order of ``fields`` (unchanged by default); a row's
    folded root is recomputed from them and the original siblings.
    """
    ids = col(id_col).cast("bigint")
    tree = F.coalesce(F.concat(F.lit("="), col(tree_col).cast("string")), F.lit(""))  # null first
    original = [col(f) for f in fields]
    rows = docs.select(ids.alias("id"), tree.alias("tree"), leaf(original).alias("leaf"),
                       leaf(tampered or original).alias("found"))
    rows = written(ordered_scan(rows, ["tree"], ["id", "leaf"], "rank"), "merkle-ranks")
    trees = written(rows.groupBy("tree").agg(F.count("*").alias("leaves")), "merkle-trees")
    most = trees.agg(F.max("leaves"), F.count("*")).first()
    if not most[1]:
        return docs.sparkSession.createDataFrame([], "id bigint, leaf string, subroot string, root string, "
                                                     "proof_sha256 string, folded_root string, verified boolean")
    rows = rows.join(trees, "tree").withColumn("rank", F.col("rank") - 1)
    low = build(rows.select("tree", "leaves", "rank", F.col("leaf").alias("digest")), most[0], height, fan)
    tops = written(roots(low, fan), "merkle-subroots")
    # The tree over the subroots: ``tree`` becomes its leaves' order, there is one tree.
    order = ordered_scan(tops.select(F.lit("").alias("all"), "tree", "digest"), ["all"], ["tree"], "rank")
    order = written(order.withColumn("rank", F.col("rank") - 1), "merkle-sources")
    high = build(order.select(F.lit("").alias("tree"), F.lit(most[1]).alias("leaves"), "rank", "digest"), most[1],
                 height, fan)
    root = roots(high, fan).first()["digest"]
    above = _paths(order.select(F.lit("").alias("tree"), F.lit(most[1]).alias("leaves"), F.col("rank").alias("idx")),
                   _union(high), 0, fan).select("idx", F.col("path").alias("source_path"))
    sources = order.join(above, order["rank"] == above["idx"]).select(
        "tree", F.col("digest").alias("subroot"), F.lit(root).alias("root"), "source_path")
    upper = _union([low[0].where(F.col("level") >= height), *low[1:]])
    blocks = written(trees.select("tree", "leaves", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.expr(f"(leaves - 1) div {fan ** height}"))).alias("idx")),
        "merkle-blocks")
    paths = _paths(blocks, upper, height, fan).withColumnRenamed("idx", "builder")
    heads = written(paths.join(sources, "tree"), "merkle-paths")

    owner = F.expr(f"rank div {fan ** height}").alias("builder")
    below = F.expr(f"idx div element_at(array({', '.join(str(fan ** k) for k in range(height, -1, -1))}), level + 1)")
    schema = ("id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
              "verified boolean")

    def prove(own: pd.DataFrame, log: pd.DataFrame) -> pd.DataFrame:
        head = log[log["level"] < 0].iloc[0]
        log = log[log["level"] >= 0].sort_values("pos")
        n, digests, low_pos = int(own["leaves"].iloc[0]), list(log["digest"]), int(log["pos"].iloc[0])
        sizes = levels(n, fan)
        subroot, root_ = head["subroot"], head["root"]
        shared = _runs(head["path"]) + _runs(head["source_path"])
        tail = "".join(d for run in shared for d in run if d != "*")
        top = min(height, len(sizes) - 1)
        found: dict[tuple[int, int], list[str]] = {}
        out = []
        for i, rank, was, is_ in zip(own["id"], own["rank"], own["leaf"], own["found"]):
            runs, idx = [], int(rank)
            for level in range(top):
                key = level, idx
                run = found.get(key)
                if run is None:
                    first = idx - idx % fan
                    run = found[key] = ["*" if k == idx else digests[position(level, k, sizes, fan) - low_pos]
                                        for k in range(first, min(first + fan, sizes[level]))]
                runs.append(run)
                idx //= fan
            proof = sha("".join(d for run in runs for d in run if d != "*") + tail)
            folded = _fold(_fold(is_, runs), shared)
            out.append((i, was, subroot, root_, proof, folded, folded == root_))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"id": "Int64"})

    nodes = low[0].where(F.col("level") <= height).select(
        "tree", below.alias("builder"), "level", "pos", "digest", *[F.lit(None).cast("string").alias(c)
                                                                  for c in ("subroot", "root", "path", "source_path")])
    lead = heads.select("tree", "builder", F.lit(-1).alias("level"), F.lit(-1).cast("bigint").alias("pos"),
                        F.lit(None).cast("string").alias("digest"), "subroot", "root", "path", "source_path")
    mine = rows.select("tree", owner, "id", "rank", "leaves", "leaf", "found")
    return mine.groupBy("tree", "builder").cogroup(
        nodes.unionByName(lead).groupBy("tree", "builder")).applyInPandas(prove, schema)


def op13_merkle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = [cut if f == "text" else F.col(f) for f in FIELDS]
    return manifest(docs, tampered=found).withColumnRenamed("id", "doc_id")


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_STEPS = ", ".join(["-1"] * 8)


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(text if f == "text" else f) for f in FIELDS) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """Nodes (tree, n nodes on the level, level, idx, h) and the other nodes left and right in their run."""
    return f"""
{name}(tree, n, level, idx, h) AS (
  SELECT tree, n, 0, idx, h FROM {leaves}
  UNION ALL
  SELECT tree, (n + 2) // 3, level + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY tree, n, level, idx // 3),
{name}_run AS (
  SELECT a.tree, a.level, a.idx,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx < a.idx), '') AS lft,
         coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (WHERE b.idx > a.idx), '') AS rgt
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.idx // 3 = b.idx // 3
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.idx)"""


ORACLE = f"""
WITH RECURSIVE docs AS (
  SELECT *, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS leaf, {_leaf_sql("replace(text, chr(10), '')")} AS cut,
         list_reduce(flatten([[CAST(ascii(c) AS BIGINT), {_STEPS}]
                              FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                     lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END,
                     CAST(4294967295 AS BIGINT)) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, leaf, tree, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS rid,
         row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY tree) AS n,
         leaf AS h, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN cut ELSE leaf END AS found
  FROM docs),
{_tree_sql('nodes', 'leaves')},
subroots AS (SELECT tree AS of, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, '' AS tree
             FROM nodes WHERE n = 1),
{_tree_sql('tops', 'subroots')},
steps AS (
  SELECT l.rid, r.level AS height, r.lft, r.rgt FROM leaves l JOIN nodes_run r
    ON l.tree = r.tree AND r.idx = l.idx // CAST(pow(3, r.level) AS BIGINT)
  UNION ALL
  SELECT l.rid, 1000 + r.level, r.lft, r.rgt FROM leaves l JOIN subroots s ON s.of = l.tree JOIN tops_run r
    ON r.idx = s.idx // CAST(pow(3, r.level) AS BIGINT)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY height) AS step FROM steps),
proofs AS (SELECT l.rid, sha256(coalesce(string_agg(lft || rgt, '' ORDER BY step), '')) AS proof_sha256, count(step) AS k
           FROM leaves l LEFT JOIN numbered s ON l.rid = s.rid GROUP BY l.rid),
folds(rid, step, h) AS (
  SELECT rid, 0, found FROM leaves
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(s.lft || f.h || s.rgt)
  FROM folds f JOIN numbered s ON s.rid = f.rid AND s.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.h AS subroot, t.h AS root, p.proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM leaves l JOIN subroots s ON s.of = l.tree JOIN proofs p ON p.rid = l.rid
JOIN folds f ON f.rid = l.rid AND f.step = p.k CROSS JOIN (SELECT h FROM tops WHERE n = 1) t"""
