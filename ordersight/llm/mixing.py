"""Mixing sources to target weights by systematic sampling (operator 9).

Each document of a source expects ``target / source_size`` copies.  Within the
source the expected copies are prefix-summed in a fixed order, one random
offset per source (a hash of its name and the seed) is added, and a document is
emitted once per integer boundary that its stretch of the sum crosses.  The
order is by size, so the sample is spread evenly over short and long documents
and the words taken stay within about one document of the target.

No window holds a source: positions are built from counts per (source, size),
counts per (source, size, slice of ids) and a row number inside that cell.

Defined cases: a null text has size 0; a null source is a source of its own,
ordered last; a source without words has target 0 and takes nothing; rows that
repeat are sampled one by one (equal rows are interchangeable); null ids come
first in their cell; an empty table gives an empty result; columns of the input
are kept as they are, and added ones get a leading underscore if they clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import col, free, table, word_count, written

SLICES = 1024
CAP = 3
SEED = 42


def source_targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows: weights 1, 2, 3, 1, ... by
    code point (null last) share the total; a target stops at ``cap`` times its source and
    the excess is shared by weight among the rest.

    The shares settle at ``min(cap * source_size, level * weight)``; sorted by
    ``cap * source_size / weight``, the first source whose cap is not below the level
    that its predecessors' caps leave gives that level.  One row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    src = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    src = src.withColumn("rank", F.row_number().over(by_name))
    src = src.withColumn("weight", (1 + (F.col("rank") - 1) % 3).cast("bigint"))
    src = src.withColumn("limit", F.col("source_size") * cap)
    src = src.withColumn("fill", F.col("limit") / F.col("weight"))
    earlier = Window.orderBy("fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(earlier), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    src = src.withColumn("level", left / weights)
    src = src.withColumn("level", F.max(F.when(F.col("level") <= F.col("fill"), F.col("level"))).over(every))
    target = F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight"))
    return src.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _offset(source: Column, seed: int) -> Column:
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\u0000")))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        sizes: DataFrame | None = None, cap: int = CAP, seed: int = SEED, slices: int = SLICES) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``cap``) added.

    ``sizes``: (id, source, size) of the same rows if already known; else they are
    computed and written once.  The rows of ``docs`` are shuffled once.
    """
    n_size, n_total, n_target, n_copies, n_slice, n_pos = free(
        docs, "size", "source_size", "target", "copies", "slice", "pos")
    sized = docs.withColumn(n_size, word_count(col(text_col)) if sizes is None else col("size"))
    if sizes is None:
        sizes = written(docs.select(col(id_col).alias("id"), col(source_col).alias("source"),
                                    word_count(col(text_col)).alias("size")), "sizes")
    else:
        sized, n_size = docs, "size"
    targets = source_targets(sizes, cap)

    def cut(c: Column) -> Column:
        return F.coalesce(F.pmod(c, F.lit(slices)), F.lit(-1)).cast("int")

    cells = sizes.groupBy("source", "size", cut(F.col("id")).alias("slice")).agg(F.count("*").alias("n"))
    within = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0)))
    of_size = sizes.groupBy("source", "size").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    of_size = of_size.select("source", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("below"))
    cells = (cells.alias("c").join(of_size.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))
                                   & (F.col("c.size") == F.col("s.size")))
             .select("c.source", "c.size", "c.slice", (F.col("before") + F.col("below")).alias("first")))
    cells = (cells.alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
             .select(F.col("c.source").alias("c_source"), F.col("c.size").alias("c_size"),
                     F.col("slice").alias("c_slice"), "first",
                     "t.source_size", "t.target"))
    names = dict(zip(cells.columns, free(sized, *[f"cell_{c}" for c in cells.columns])))
    cells = cells.select(*[F.col(c).alias(n) for c, n in names.items()])
    cell = {c: col(n) for c, n in names.items()}

    rows = sized.withColumn(n_slice, cut(col(id_col)))
    rows = rows.withColumn(n_pos, F.row_number().over(
        Window.partitionBy(col(source_col), col(n_size), col(n_slice)).orderBy(col(id_col))))
    out = rows.join(cells, col(source_col).eqNullSafe(cell["c_source"])
                    & (col(n_size) == cell["c_size"]) & (col(n_slice) == cell["c_slice"]))
    k = (cell["first"] + col(n_pos) - 1).cast("double")
    rate = F.when(cell["source_size"] > 0, cell["target"] / cell["source_size"]).otherwise(0.0)
    u = _offset(col(source_col), seed)
    copies = F.least(F.floor((k + 1) * rate + u) - F.floor(k * rate + u), F.lit(cap).cast("bigint"))
    return out.select(*[col(c) for c in docs.columns if c != n_size], col(n_size),
                      cell["source_size"].alias(n_total), cell["target"].alias(n_target),
                      copies.cast("int").alias(n_copies))


def op9_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = written(docs.select(F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    out = mix(sizes, id_col="id", sizes=sizes)
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                      (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), "copies")


def stage(spark, docs, sf_dir):
    """Pipeline stage: each document as often as the mix takes it."""
    mixed = mix(docs)
    copies = mixed.columns[-1]
    return (mixed.withColumn(copies, F.explode(F.expr(
        f"CASE WHEN `{copies}` > 0 THEN sequence(1, `{copies}`) ELSE array() END")))
        .select(*[col(c) for c in docs.columns]))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank
        FROM d GROUP BY source),
w AS (SELECT *, 1 + (rank - 1) % 3 AS w, s * 3 AS lim, (s * 3)::DOUBLE / (1 + (rank - 1) % 3) AS fill FROM src),
lev AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(lim) OVER e, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER e, 0))::DOUBLE AS lv
  FROM w WINDOW e AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (SELECT source, s AS source_size,
               coalesce(least(lim::DOUBLE, max(CASE WHEN lv <= fill THEN lv END) OVER () * w), 0.0) AS target
        FROM lev),
pos AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS r,
         ('0x' || substr(md5('42:' || coalesce(d.source, chr(0))), 1, 12))::BIGINT::DOUBLE / 281474976710656.0 AS u,
         (row_number() OVER (PARTITION BY d.source
            ORDER BY d.size, coalesce(((d.doc_id % 1024) + 1024) % 1024, -1), d.doc_id NULLS FIRST) - 1)::DOUBLE AS k
  FROM d JOIN tgt t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor((k + 1) * r + u) - floor(k * r + u), 3)::INTEGER AS copies FROM pos)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies FROM c
"""
