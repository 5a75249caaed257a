"""Answer-text shaping: section buckets, evidence-gap sentences, list items,
action titles and policy-basis sentences, plus credential redaction.

Every operator here works on one answer at a time and is written with
higher-order array functions over the answer's own lines or sentences, so it is
row-local: no shuffle, and the work is linear in the lines of a text (folds run
over its headings, or keep five items at most).  Each step is a column of its
own, so none is evaluated twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.functions.text import js_trim, redact_credentials

# Fixed patterns of the answer contract.
MD_HEADING = r"^#{1,3}\s+(.+?)\s*#*\s*$"
BOLD_HEADING = r"^\*\*(.+?)\*\*:?\s*$"
SECTIONS = ("executive", "observed", "interpretation", "policy", "actions", "limitations")
SENTENCE_SPLIT = r"(?<=[.!?])\s+(?=[A-Z0-9])"
GAP_PATTERN = (r"(?i)does not prove|do not prove|does not establish|cannot (?:confirm|establish|verify|rule out)"
               r"|not (?:directly )?(?:linked|available|included|provided|verified|yet verified)|no direct|lack of"
               r"|without (?:a |the )?(?:direct|detailed|complete)|remains? (?:uncertain|unverified)|unknown"
               r"|evidence gap|would need to be verified|not enough evidence")
LIST_SPLIT = r"(?m)(?=^\s*(?:[-*+]\s|\d+[.)]\s))"
BULLET_PREFIX = r"^\s*(?:[-*+]\s|\d+[.)]\s)"
BOLD_TITLE = r"^(\*\*(.+?)\*\*[:\s-]*)"
POLICY_PATTERN = r"(?i)policy|threshold|requires?|must |business days|days late|below \d|above \d|otif"
MAX_GAPS = 5
TITLE_CHARS = 90


def heading_text(line: Column) -> Column:
    """Markdown (#..###) or bold-only heading text; NULL for body lines."""
    return (F.when(line.rlike(MD_HEADING), F.regexp_extract(line, MD_HEADING, 1))
            .when(line.rlike(BOLD_HEADING), F.regexp_extract(line, BOLD_HEADING, 1)))


def section_bucket(heading: Column) -> Column:
    """Keyword bucket of a heading, tested in order; NULL when unknown."""
    n = F.lower(heading)
    # Fixed keywords of the answer contract.
    return (F.when(n.contains("executive") | n.contains("investigation"), F.lit("executive"))
            .when(n.contains("observed") | n.contains("operational fact"), F.lit("observed"))
            .when(n.contains("interpret"), F.lit("interpretation"))
            .when(n.contains("recommend") | n.contains("management action") | n.startswith("action"), F.lit("actions"))
            .when(n.contains("policy"), F.lit("policy"))
            .when(n.contains("limitation") | n.contains("evidence gap"), F.lit("limitations")))


def answer_sections(df: DataFrame, text_col: str = "answer") -> DataFrame:
    """Split an answer into the six section buckets.  Headings switch
    the current bucket (unknown headings keep it) and are dropped; body lines
    go to the current bucket (initially executive), so an answer without
    headings is entirely executive.

    The headings' line numbers cut the lines into segments; a fold over the
    headings gives each segment its bucket, and a section is its segments'
    slices of the lines."""
    keep = [c for c in df.columns if c != text_col]
    df = df.withColumn("_lines", F.split(F.col(text_col), "\n", -1))
    heads = F.filter(F.transform("_lines", lambda x, i: F.struct(i.alias("i"), heading_text(x).alias("h"))),
                     lambda x: x["h"].isNotNull())
    df = df.withColumn("_heads", F.transform(heads, lambda x: F.struct(x["i"].alias("i"), section_bucket(x["h"]).alias("b"))))
    init = F.struct(F.lit("executive").alias("cur"), F.lit(0).alias("at"),
                    F.array().cast("array<struct<b:string,s:int,n:int>>").alias("out"))

    def segment(acc, end):
        return F.array_append(acc["out"], F.struct(acc["cur"].alias("b"), acc["at"].alias("s"), (end - acc["at"]).alias("n")))

    df = df.withColumn("_state", F.aggregate("_heads", init, lambda acc, x: F.struct(
        F.coalesce(x["b"], acc["cur"]).alias("cur"), (x["i"] + 1).alias("at"), segment(acc, x["i"]).alias("out"))))
    df = df.withColumn("_segments", segment(F.col("_state"), F.size("_lines")))

    def body_of(sec: str) -> Column:
        own = F.filter("_segments", lambda g: (g["b"] == F.lit(sec)) & (g["n"] > 0))
        return js_trim(F.array_join(F.flatten(F.transform(own, lambda g: F.slice("_lines", g["s"] + 1, g["n"]))), "\n"))

    return df.select(*keep, *[body_of(s).alias(s) for s in SECTIONS])


def gap_list(text: Column) -> Column:
    """Gap sentences of a text -- bullets and bold stripped, split into sentences, kept if they match the
    gap pattern, de-duplicated case-insensitively (ignoring a leading "1." / "2)"), the first five."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?m)^\s*[-*+]\s+", ""), r"\*\*", "")
    sents = F.transform(F.split(t, SENTENCE_SPLIT, -1), lambda s: js_trim(s))
    items = F.transform(sents, lambda s: F.struct(
        s.alias("sentence"), js_trim(F.regexp_replace(s, r"^\d+[.)]\s*", "")).alias("norm")))
    cand = F.filter(items, lambda x: (x["norm"] != "") & x["norm"].rlike(GAP_PATTERN))
    init = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(cand, init, lambda acc, x: F.when(
        (F.size(acc["keys"]) >= MAX_GAPS) | F.array_contains(acc["keys"], F.lower(x["norm"])), acc).otherwise(
        F.struct(F.array_append(acc["keys"], F.lower(x["norm"])).alias("keys"),
                 F.array_append(acc["out"], x["sentence"]).alias("out"))))["out"]


def evidence_gaps(df: DataFrame, text_col: str = "gap_source", coverage_col: str | None = None) -> DataFrame:
    """One row per evidence gap: the gap sentences and then, if ``coverage_col`` is given and not NULL, the
    date-coverage gap; distinct, the first five."""
    keep = [c for c in df.columns if c not in (text_col, coverage_col)]
    df = df.withColumn("_gaps", gap_list(F.col(text_col)))
    gaps = F.col("_gaps")
    if coverage_col:
        last = F.when(F.col(coverage_col).isNotNull(), F.array(coverage_col)).otherwise(F.array().cast("array<string>"))
        gaps = F.array_distinct(F.concat(gaps, last))
    return df.select(*keep, F.posexplode(F.slice(gaps, 1, MAX_GAPS)).alias("pos", "gap")) \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("gap_rank"), "gap")


def list_items(content: Column) -> Column:
    """Bullet / numbered items if more than one, else blank-line
    paragraphs if more than one, else the whole (trimmed) content."""
    nonempty = lambda arr: F.filter(F.transform(arr, lambda s: js_trim(s)), lambda s: s != "")
    items = nonempty(F.split(content, LIST_SPLIT, -1))
    paras = nonempty(F.split(content, r"\n\s*\n", -1))
    whole = nonempty(F.array(content))
    return F.when(F.size(items) > 1, items).when(F.size(paras) > 1, paras).otherwise(whole)


def list_item_rows(df: DataFrame, content_col: str = "actions") -> DataFrame:
    """X17 as rows: (keys..., item_no, item)."""
    keep = [c for c in df.columns if c != content_col]
    return df.select(*keep, F.posexplode(list_items(F.col(content_col))).alias("pos", "item")) \
        .select(*keep, (F.col("pos") + 1).cast("int").alias("item_no"), "item")


def action_items(df: DataFrame, content_col: str = "actions") -> DataFrame:
    """X17 + X18: one row per action item with its title (bold prefix, else
    the first clause up to 90 characters), body and policy-basis sentences."""
    keep = [c for c in df.columns if c != content_col]
    ex = df.select(*keep, F.posexplode(list_items(F.col(content_col))).alias("pos", "item"))
    cleaned = js_trim(F.regexp_replace("item", BULLET_PREFIX, ""))
    ex = ex.withColumn("cleaned", cleaned)
    c = F.col("cleaned")
    bold = F.regexp_extract(c, BOLD_TITLE, 2)
    has_bold = c.rlike(BOLD_TITLE)
    clause = F.substring(F.element_at(F.split(c, r"[.!?:;]", -1), 1), 1, TITLE_CHARS)
    title = F.when(has_bold, bold).when(clause != "", clause).otherwise(F.lit("Recommended action"))
    ex = ex.withColumn("title", title)
    rest = lambda n: c.substr(n + F.lit(1), F.length(c) + F.lit(1))  # noqa: E731  (JS slice(n))
    after_bold = js_trim(rest(F.length(F.regexp_extract(c, BOLD_TITLE, 1))))
    after_title = js_trim(F.regexp_replace(rest(F.length(F.col("title"))), r"^[:\s-]+", ""))
    ex = ex.withColumn("body", F.when(has_bold, after_bold).otherwise(after_title))
    basis = F.array_join(F.filter(F.split(F.col("body"), r"(?<=[.!?])\s+", -1), lambda s: s.rlike(POLICY_PATTERN)), " ")
    return ex.select(*keep, (F.col("pos") + 1).cast("int").alias("item_no"), "title", "body",
                     basis.alias("policy_basis"))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Credential redaction as a column job."""
    r = redact_credentials(F.col(text_col))
    return df.withColumn("redacted", r).withColumn("was_redacted", F.col("redacted") != F.col(text_col))
