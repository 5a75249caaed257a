"""Registered text / vector queries and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.functions.text import pad_number
from ordersight.operators import chunker, embed, search, summaries
from ordersight.plans import params as P
from ordersight.plans.registry import register
from ordersight.sources.scratch import scratch_path

ORACLE: dict[str, str] = {}
EVERY = P.QUERY_VECTOR_EVERY


def _hit_cols(vec_id, label):
    doc = F.concat(F.lit("doc_"), label.cast("string"))
    return [doc.alias("document"),
            F.concat(F.lit("Section "), (vec_id % 7).cast("string")).alias("section"),
            F.concat(doc, F.lit("#"), pad_number(vec_id, 4)).alias("chunk_id")]


def vector_index(m):
    """The ``embeddings`` table as a search index with hit labels."""
    return m.t.embeddings.select("vec_id", "label", *_hit_cols(F.col("vec_id"), F.col("label")), "embedding")


def vector_queries(m):
    """Query vectors: every 50th embedding, so the query side grows with the table; each one is searched for among all
    rows but its own."""
    e = m.t.embeddings
    return e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_hits(m, k, floor=-1.0):
    return search.cosine_top_k(vector_index(m), vector_queries(m), k=k, min_similarity=floor, id_col="vec_id",
                               own_col="query_id")


_SIM = ("CASE WHEN list_dot_product(v, v) = 0 OR list_dot_product(qv, qv) = 0 THEN 0.0 "
        "ELSE list_dot_product(v, qv) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(qv, qv))) END")


def _topk_sql(k: int, floor: float = -1.0) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id % {EVERY} = 0),
    ix AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT q.query_id, ix.vec_id, ix.label, {_SIM} AS sim FROM q JOIN ix ON ix.vec_id <> q.query_id),
    s2 AS (SELECT query_id, vec_id, label, CAST(round(sim * 1000000) AS BIGINT) / 1000000.0 AS similarity
           FROM s WHERE sim >= {floor}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s2),
    hits AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, label, 'doc_' || CAST(label AS VARCHAR) AS document,
                    'Section ' || CAST(vec_id % 7 AS VARCHAR) AS section,
                    'doc_' || CAST(label AS VARCHAR) || '#' || lpad(CAST(vec_id AS VARCHAR),
                        CAST(greatest(4, length(CAST(vec_id AS VARCHAR))) AS INTEGER), '0') AS chunk_id,
                    similarity FROM r WHERE rank <= {k})"""


@register("vector_topk")
def q_vector_topk(m):
    """Exact cosine top-3 for every query vector over the index."""
    return vector_hits(m, P.TOP_K)


ORACLE["vector_topk"] = _topk_sql(P.TOP_K) + " SELECT * FROM hits"


@register("vector_topk_min_similarity")
def q_vector_topk_min_similarity(m):
    """Top-50 with a similarity floor (>=)."""
    return vector_hits(m, 50, P.MIN_SIMILARITY)


ORACLE["vector_topk_min_similarity"] = _topk_sql(50, P.MIN_SIMILARITY) + " SELECT * FROM hits"


def _hits_with_text(m, k):
    """Hits joined to their passage text.  Documents are first semi-filtered by
    the hit ids (k per query: AQE broadcasts the id list when small), so full
    texts of non-hits are never shuffled."""
    h = vector_hits(m, k)
    d = m.t.documents.select(F.col("doc_id").alias("vec_id"), "text") \
        .join(h.select("vec_id").distinct(), "vec_id", "left_semi")
    return h.join(d, "vec_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


_HITS_TEXT_SQL = _topk_sql(10) + """,
    ht AS (SELECT h.*, COALESCE(d.text, '') AS text FROM hits h LEFT JOIN documents d ON d.doc_id = h.vec_id),
    src AS (SELECT query_id, document, section, MIN(rank) AS position,
                   arg_max(chunk_id, rank) AS chunk_id, arg_max(similarity, rank) AS similarity,
                   substr(trim(regexp_replace(arg_max(text, rank), '\\s+', ' ', 'g')), 1, 240) AS preview
            FROM ht GROUP BY query_id, document, section)"""


@register("policy_sources")
def q_policy_sources(m):
    """Search hits deduplicated per document::section (last value at first position)."""
    return search.policy_sources(_hits_with_text(m, 10))


ORACLE["policy_sources"] = _HITS_TEXT_SQL + """
    SELECT query_id, CAST(position AS INTEGER) AS position, document, section, chunk_id, similarity, preview FROM src"""


@register("sources_by_document")
def q_sources_by_document(m):
    """X11: deduplicated passages grouped per document (count + ordered sections)."""
    return search.sources_by_document(search.policy_sources(_hits_with_text(m, 10)))


ORACLE["sources_by_document"] = _HITS_TEXT_SQL + """
    SELECT query_id, document, COUNT(*) AS passages, list(section ORDER BY position) AS sections
    FROM src GROUP BY query_id, document"""

# ---- chunking / embedding -----------------------------------------------------


def doc_chunks(m):
    return chunker.chunk_documents(chunker.documents_as_markdown(m.t.documents), max_characters=P.CHUNK_MAX_CHARACTERS)


# The oracle's own packing: every line of a text is a block; blocks over the limit are cut one
# piece at a time, and blocks are packed one at a time, by recursion.  Limit 1800, least cut 990.
_CHUNKS_CTE = r"""WITH RECURSIVE
    ln AS (SELECT doc_id, bno, regexp_replace(line, '^\s+|\s+$', '', 'g') AS block
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS bno FROM documents)),
    cut(doc_id, bno, pno, piece, rest) AS (
      SELECT doc_id, bno, 0, CAST(NULL AS VARCHAR), block FROM ln WHERE length(block) > 1800
      UNION ALL
      SELECT doc_id, bno, pno + 1, trim(left(rest, CAST(c AS INTEGER))), trim(substr(rest, c + 1))
      FROM (SELECT *, CASE WHEN sp > 0 AND 1801 - sp >= 990 THEN 1801 - sp ELSE 1800 END AS c
            FROM (SELECT *, strpos(reverse(left(rest, 1801)), ' ') AS sp FROM cut WHERE length(rest) > 1800))),
    part AS (SELECT doc_id, bno, 0 AS pno, block AS p FROM ln WHERE length(block) BETWEEN 1 AND 1800
             UNION ALL SELECT doc_id, bno, pno, piece FROM cut WHERE pno > 0
             UNION ALL SELECT doc_id, bno, pno + 1, rest FROM cut WHERE length(rest) <= 1800),
    sq AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY bno, pno) AS rn FROM part WHERE p <> ''),
    pk(doc_id, rn, size, seq) AS (
      SELECT doc_id, rn, CAST(length(p) AS BIGINT), 1 FROM sq WHERE rn = 1
      UNION ALL
      SELECT sq.doc_id, sq.rn, CASE WHEN pk.size + 2 + length(sq.p) > 1800 THEN length(sq.p)
                                    ELSE pk.size + 2 + length(sq.p) END,
             CASE WHEN pk.size + 2 + length(sq.p) > 1800 THEN pk.seq + 1 ELSE pk.seq END
      FROM pk JOIN sq ON sq.doc_id = pk.doc_id AND sq.rn = pk.rn + 1),
    chunks AS (
      SELECT 'doc_' || doc_id || '.md' AS document, 'Document ' || doc_id AS document_title,
             any_value(d.source) || CASE WHEN doc_id % 4 = 0 THEN ' >  > Detail' ELSE '' END AS section,
             'doc_' || doc_id || '.md#' || lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), '0')
               AS chunk_id,
             CAST(seq AS INTEGER) AS chunk_seq, string_agg(sq.p, chr(10) || chr(10) ORDER BY sq.rn) AS text
      FROM pk JOIN sq USING (doc_id, rn) JOIN documents d USING (doc_id) GROUP BY doc_id, seq)"""

_INPUT_SQL = "'Document: ' || document_title || chr(10) || 'Section: ' || section || chr(10) || chr(10) || text"


def _embedded(name: str, src: str, key: str, text: str) -> str:
    """CTEs that give ``name`` (key, embedding) of the texts in ``src``: signed counts by MD5 prefix, length 1."""
    return f""",
    {name}_tok AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM {src}),
    {name}_n AS (SELECT k, ('0x' || substr(md5(w), 1, 8))::BIGINT AS h FROM {name}_tok),
    {name}_c AS (SELECT k, h % {P.EMBED_DIM} AS b, SUM(CASE WHEN (h // {P.EMBED_DIM}) % 2 = 1 THEN 1 ELSE -1 END) AS n
                 FROM {name}_n GROUP BY ALL),
    {name}_m AS (SELECT k, map(list(b), list(n)) AS m, SUM(n * n) AS sq FROM {name}_c GROUP BY k),
    {name} AS (SELECT s.{key}, list_transform(range(0, {P.EMBED_DIM}), lambda b: CASE WHEN sq > 0 THEN
                 CAST(COALESCE(m[b], 0) AS DOUBLE) / sqrt(CAST(sq AS DOUBLE)) ELSE 0.0 END) AS embedding
               FROM {src} s LEFT JOIN {name}_m ON k = s.{key})"""


@register("policy_chunks")
def q_policy_chunks(m):
    """Heading-aware chunks of every document."""
    return doc_chunks(m)


ORACLE["policy_chunks"] = _CHUNKS_CTE + " SELECT * FROM chunks"


@register("policy_chunk_coverage")
def q_policy_chunk_coverage(m):
    """Per document, non-whitespace characters over all chunks and
    whether every chunk is within the size cap -- proves no text is lost or
    duplicated by the chunker, checked against the raw ``documents`` text."""
    c = doc_chunks(m)
    g = c.groupBy("document").agg(
        F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("non_ws_chars"),
        F.max(F.length("text")).alias("max_len"))
    return g.select(F.regexp_extract("document", r"^doc_(\d+)\.md$", 1).cast("bigint").alias("doc_id"),
                    F.col("non_ws_chars").cast("bigint").alias("non_ws_chars"),
                    (F.col("max_len") <= P.CHUNK_MAX_CHARACTERS).alias("within_limit"))


ORACLE["policy_chunk_coverage"] = r"""
    SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS non_ws_chars, TRUE AS within_limit
    FROM documents WHERE length(trim(text)) > 0"""


def _input(c):
    return embed.embedding_input_text(F.col("document_title"), F.col("section"), F.col("text"))


@register("embedding_input_text")
def q_embedding_input_text(m):
    """The embedding input text of every chunk."""
    c = doc_chunks(m)
    return c.select("chunk_id", _input(c).alias("input_text"))


ORACLE["embedding_input_text"] = _CHUNKS_CTE + f" SELECT chunk_id, {_INPUT_SQL} AS input_text FROM chunks"


@register("embed_chunks")
def q_embed_chunks(m):
    """Every chunk embedded through the pluggable hook."""
    return embed.embed_column(doc_chunks(m), "text", "embedding", embed.HashingEmbedder(P.EMBED_DIM))


ORACLE["embed_chunks"] = (_CHUNKS_CTE + _embedded("e", "chunks", "chunk_id", "text")
                          + " SELECT c.*, e.embedding FROM chunks c JOIN e USING (chunk_id)")


@register("vector_index_manifest")
def q_vector_index_manifest(m):
    """Index rows (chunk + embedding + schema version, model, document count)."""
    return embed.index_rows(doc_chunks(m), embed.HashingEmbedder(P.EMBED_DIM), documents=m.t.documents)


_INDEX_SQL = _CHUNKS_CTE + f", cin AS (SELECT *, {_INPUT_SQL} AS i FROM chunks)" + _embedded("e", "cin", "chunk_id", "i")
ORACLE["vector_index_manifest"] = _INDEX_SQL + f"""
    SELECT 1 AS schema_version, 'hashing-{P.EMBED_DIM}' AS embedding_model,
           (SELECT COUNT(*) FROM documents) AS document_count, c.*, e.embedding
    FROM chunks c JOIN e USING (chunk_id)"""


@register("vector_index_published")
def q_vector_index_published(m):
    """The index written as a version, published, and read back through its pointer and the gate."""
    emb = embed.HashingEmbedder(P.EMBED_DIM)
    base = scratch_path(m.spark, "vector-index")
    embed.publish_vector_index(embed.index_rows(doc_chunks(m), emb, documents=m.t.documents), base)
    return embed.open_vector_index(m.spark, base, emb.model).drop("created_at")


ORACLE["vector_index_published"] = ORACLE["vector_index_manifest"]


@register("policy_search")
def q_policy_search(m):
    """X8 end to end: benchmark texts as queries against embedded document chunks; ties by
    document, then chunk."""
    emb = embed.HashingEmbedder(P.EMBED_DIM)
    chunks = doc_chunks(m)
    chunks = chunks.withColumn("_at", embed.chunk_order(chunks))
    idx = embed.embed_column(chunks.withColumn("_in", _input(chunks)), "_in", "embedding", emb).drop("_in")
    qs = embed.embed_column(m.t.benchmark.select(F.col("item_id").alias("query_id"), "text"), "text", "embedding", emb)
    return search.cosine_top_k(idx, qs, k=P.TOP_K, id_col="_at").drop("_at")


ORACLE["policy_search"] = _INDEX_SQL + _embedded("q", "benchmark", "item_id", "text") + f""",
    s AS (SELECT q.item_id AS query_id, e.chunk_id,
                 CAST(round(CASE WHEN list_dot_product(q.embedding, q.embedding) = 0
                                   OR list_dot_product(e.embedding, e.embedding) = 0 THEN 0.0
                                 ELSE list_dot_product(q.embedding, e.embedding)
                                      / (sqrt(list_dot_product(q.embedding, q.embedding))
                                         * sqrt(list_dot_product(e.embedding, e.embedding))) END * 1000000) AS BIGINT)
                   / 1000000.0 AS similarity
          FROM q CROSS JOIN e),
    r AS (SELECT s.query_id, c.*, s.similarity,
                 row_number() OVER (PARTITION BY s.query_id ORDER BY s.similarity DESC, c.document, c.chunk_seq) AS rk
          FROM s JOIN chunks c USING (chunk_id))
    SELECT query_id, CAST(rk AS INTEGER) AS rank, document, document_title, section, chunk_id, chunk_seq, text, similarity
    FROM r WHERE rk <= {P.TOP_K}"""


@register("policy_search_summaries")
def q_policy_search_summaries(m):
    """One sentence per search: how many passages, and from which documents and sections."""
    return summaries.policy_summaries(q_policy_search(m))


ORACLE["policy_search_summaries"] = f"""
    SELECT query_id, CAST(COUNT(*) AS VARCHAR) || ' policy passages; '
           || string_agg(document || ' — ' || section, '; ' ORDER BY rank) || '.' AS summary
    FROM ({ORACLE['policy_search']}) h GROUP BY query_id"""


@register("document_titles")
def q_document_titles(m):
    """display title of a policy document by its file name."""
    name = F.concat(F.element_at(F.array(*map(F.lit, ("shipping_sla_", "inventory_sop_", "vendor_escalation_", "other_"))),
                                 (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"), F.lit(".md"))
    return m.t.documents.select("doc_id", name.alias("document"), search.document_title(name).alias("title"))


ORACLE["document_titles"] = """
    SELECT doc_id, d AS document, CASE doc_id % 4 WHEN 0 THEN 'Shipping SLA' WHEN 1 THEN 'Inventory SOP'
             WHEN 2 THEN 'Vendor Escalation Procedure' ELSE d END AS title
    FROM (SELECT doc_id, ['shipping_sla_', 'inventory_sop_', 'vendor_escalation_', 'other_'][doc_id % 4 + 1]
                         || CAST(doc_id AS VARCHAR) || '.md' AS d FROM documents)"""
