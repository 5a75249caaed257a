"""Secret scan with corpus-wide ownership frequency (operator 4, DataFrame functions only).

Candidates come from three base patterns (leftmost, non-overlapping per kind).
Java's ``split`` and ``regexp_extract_all`` with one pattern give the gaps
between matches and the matches themselves, so running sums of their lengths are
the code-point positions.  Each candidate value is hashed and counted over the
whole corpus by distinct repositories and owners: a value seen with
``example_owners`` owners or more, or in ``example_repos`` repositories or more, is
a widely copied example; any other that a single owner uses and that mixes
letters and digits is live-looking, and its value becomes an added span of kind
``live``.

``owner_col`` names who owns a row and ``repo_col`` the unit of publication; for
``documents`` they are source and doc_id.  A null owner or repository is one of
its own.  Values are pre-aggregated per (value, owner, repository), so a value
that a third of all rows hold costs one row per task and group; the counts go
back to the candidates over a salted join.

Defined cases: a null or empty text has no spans (hash of the empty string);
rows that repeat are reported each by itself; texts are scanned whole; extra
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import col, free, table, written

#: kind, pattern, group of the value, least length of the value (fixed values; a
#: run of 24 or more hex digits is what a maximal run of them with that length is).
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
LIVE = "live"
EXAMPLE_OWNERS = 3
#: Copies in so many repositories are no secret, whoever owns them.
EXAMPLE_REPOS = 25
SALTS = 16
MASK = "[SECRET]"


def _matches(text: Column, number: int) -> Column:
    """Array of (kind, k, gap, len, value) of one kind, in order."""
    name, pattern, group, _ = KINDS[number]
    p = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, p, F.lit(0))
    values = F.regexp_extract_all(text, p, F.lit(group))
    found = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("g"), hits.alias("h"), values.alias("v")),
                        lambda x, k: F.struct(F.lit(number).alias("kind"), k.alias("k"),
                                              F.length(x["g"]).cast("bigint").alias("gap"),
                                              F.length(x["h"]).cast("bigint").alias("len"), x["v"].alias("value")))
    none = F.expr("CAST(array() AS array<struct<kind:int,k:int,gap:bigint,len:bigint,value:string>>)")
    return F.when(text.rlike(pattern), found).otherwise(none)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
               repo_col: str = "doc_id") -> DataFrame:
    """One row per candidate, at least one per document (kind null if it has none):
    row, id, text_hash, owner, repo, kind, start, end, value, value_hash."""
    text = F.coalesce(col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(id_col).alias("id"),
                       F.xxhash64(text).alias("text_hash"), col(owner_col).cast("string").alias("owner"),
                       col(repo_col).cast("string").alias("repo"), text.alias("text"))
    rows = rows.select("row", "id", "text_hash", "owner", "repo", F.explode_outer(
        F.concat(*[_matches(F.col("text"), n) for n in range(len(KINDS))])).alias("m"))
    rows = written(rows.select("row", "id", "text_hash", "owner", "repo", "m.*"), "candidates")
    before = Window.partitionBy("row", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    least = F.element_at(F.array(*[F.lit(k[3]) for k in KINDS]), F.col("kind") + 1)
    rows = rows.repartition("row").withColumn("end", end)
    keep = F.length("value") >= least
    fields = {"kind": F.col("kind"), "start": F.col("end") - F.col("len"), "end": F.col("end"), "value": F.col("value"),
              "value_hash": F.sha2("value", 256)}
    return rows.select("row", "id", "text_hash", "owner", "repo", *[F.when(keep, c).alias(n) for n, c in fields.items()])


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, uses, n_repos, n_owners over the whole corpus."""
    per_repo = found.where("value_hash IS NOT NULL").groupBy("value_hash", "owner", "repo").agg(
        F.count("*").alias("uses"))
    per_owner = per_repo.groupBy("value_hash", "owner").agg(F.sum("uses").alias("uses"), F.count("*").alias("n_repos"))
    return per_owner.groupBy("value_hash").agg(F.sum("uses").alias("uses"), F.sum("n_repos").alias("n_repos"),
                                               F.count("*").alias("n_owners"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source",
         repo_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS) -> DataFrame:
    """Candidates with uses, n_repos, n_owners and verdict: example, live or shared.

    Only rows with a candidate meet the counts; the others keep apart."""
    found = candidates(docs, id_col, text_col, owner_col, repo_col)
    freq = ownership(found).where("uses > 1").withColumn("salt", F.explode(F.expr(f"sequence(0, {SALTS - 1})")))
    some = found.where("value_hash IS NOT NULL").withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    counts = ["uses", "n_repos", "n_owners"]
    out = some.join(freq, ["value_hash", "salt"], "left").select(
        *found.columns, *[F.coalesce(c, F.lit(1).cast("bigint")).alias(c) for c in counts])
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    out = out.withColumn("verdict", F.when(copied, "example").when((F.col("n_owners") == 1) & mixed, LIVE)
                         .otherwise("shared"))
    none = found.where("value_hash IS NULL").select(
        *found.columns, *[F.lit(None).cast("bigint").alias(c) for c in counts], F.lit(None).cast("string").alias("verdict"))
    return out.unionByName(none)


def _spans(items: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(items), lambda s: F.concat_ws(
        ":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def document_spans(found: DataFrame) -> DataFrame:
    """One row per scanned row: row, id, counts by kind and verdict, base and all spans as text."""
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("kind") + 1)
    base = F.when(F.col("kind").isNotNull(),
                  F.struct(F.col("start"), F.col("kind"), F.col("end"), name.alias("name")))
    live = F.when(F.col("verdict") == LIVE, F.struct(
        (F.col("end") - F.length("value")).alias("start"), F.lit(len(KINDS)).alias("kind"), F.col("end"),
        F.lit(LIVE).alias("name")))
    count = {f"n_{k[0]}": F.count_if(F.col("kind") == n) for n, k in enumerate(KINDS)}
    count |= {f"n_{v}": F.count_if(F.col("verdict") == v) for v in ("example", "live")}
    count["n_repos"] = F.coalesce(F.max("n_repos"), F.lit(0).cast("bigint"))
    out = found.groupBy("row", "id").agg(*[c.alias(n) for n, c in count.items()],
                                         F.collect_list(base).alias("base"), F.collect_set(live).alias("live"))
    return out.select("row", "id", *count, _spans(F.col("base")).alias("base_spans"),
                      _spans(F.concat("base", "live")).alias("spans"))


def op4_secret_scan(spark, sf_dir):
    out = document_spans(scan(table(spark, sf_dir, "documents")))
    return out.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex",
                      F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_example", "n_live", "n_repos")


def masked(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           mask: str = MASK) -> DataFrame:
    """``docs`` with the values of candidates that aren't examples replaced by ``mask``; other rows unchanged.

    Rows are matched by id and text hash: equal ones have equal spans.  A column
    ``n_chars`` follows the new text.
    """
    n_id, n_hash, n_parts = free(docs, "span_id", "span_hash", "parts")
    spans = found.where("verdict <> 'example'").select(
        "row", "id", "text_hash", (F.col("end") - F.length("value")).alias("start"), "end")
    # Overlapping spans of different kinds count as one: a span starts a new run where it begins after all before it.
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("row", "id", "text_hash", "run").agg(F.min("start").alias("s"), F.max("end").alias("e"))
    runs = runs.groupBy("row", "id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("parts"))
    runs = runs.groupBy(F.col("id").alias(n_id), F.col("text_hash").alias(n_hash)).agg(
        F.min_by("parts", "row").alias(n_parts))
    text, parts = col(text_col), col(n_parts)
    rows = docs.join(runs, col(id_col).eqNullSafe(F.col(n_id))
                     & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col(n_hash)), "left")
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(parts, lambda p: p["e"]))
    ends = F.concat(F.transform(parts, lambda p: p["s"]), F.array(F.length(text).cast("bigint")))
    cut = F.array_join(F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda z: F.substring(
        text, (z["a"] + 1).cast("int"), (z["b"] - z["a"]).cast("int"))), mask)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(parts.isNull(), F.col("n_chars")).otherwise(
            F.length(cut).cast(docs.schema["n_chars"].dataType)))
    rows = rows.withColumn(text_col, F.when(parts.isNull(), text).otherwise(cut))
    return rows.select(*[col(c) for c in docs.columns])


def stage(spark, docs, sf_dir):
    """Pipeline stage: every document stays; credentials that aren't widely copied examples are masked."""
    return masked(docs, scan(docs))


def _oracle() -> str:
    kinds = [("assign", r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
             ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]{24,}", 0, 24)]
    found = " UNION ALL ".join(
        f"SELECT doc_id, source, {n} AS k, '{name}' AS kind, {least} AS least, unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS i,"
        f" unnest(regexp_extract_all(t, '{p}')) AS hit, unnest(regexp_extract_all(t, '{p}', {group})) AS v,"
        f" unnest(regexp_split_to_array(t, '{p}')[1:len(regexp_extract_all(t, '{p}'))]) AS gap FROM d"
        f" WHERE regexp_matches(t, '{p}')" for n, (name, p, group, least) in enumerate(kinds))
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({found}),
c AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM m),
s AS (SELECT doc_id, source, k, kind, v, CAST(e - length(hit) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM c WHERE length(v) >= least),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT (source, doc_id)) AS repos
        FROM s GROUP BY v),
k AS (SELECT s.*, owners, repos, owners >= {EXAMPLE_OWNERS} OR repos >= {EXAMPLE_REPOS} AS example FROM s JOIN own USING (v)),
j AS (SELECT *, NOT example AND owners = 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AS live FROM k),
a AS (SELECT doc_id, k, kind, b, e FROM j UNION ALL
      SELECT DISTINCT doc_id, {len(KINDS)}, '{LIVE}', CAST(e - length(v) AS BIGINT), e FROM j WHERE live),
t AS (SELECT doc_id, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e) FILTER (k < {len(KINDS)}) AS base,
             string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k, e) AS spans FROM a GROUP BY doc_id),
n AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
             count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (example) AS n_example, count(*) FILTER (live) AS n_live,
             max(repos) AS n_repos
      FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live,
       coalesce(n_repos, 0) AS n_repos
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""


ORACLE = _oracle()
