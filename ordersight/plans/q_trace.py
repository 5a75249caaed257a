"""Registered trace (events) and answer-text (conversations) queries and
their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ordersight.operators import answers, trace
from ordersight.plans.registry import register

ORACLE: dict[str, str] = {}

# ---- trace over events -------------------------------------------------------

_TOOL_SQL = ("CASE WHEN k % 10 = 0 THEN 'search_company_policies' "
             + "".join(f"WHEN event_type = '{e}' THEN '{t}' " for e, t in trace.EVENT_TOOL.items()) + "END")
_IDKEY_SQL = "CASE name " + "".join(f"WHEN '{t}' THEN '{k}' " for t, k in trace._ID_KEY.items()) + "END"
_LABEL_SQL = "CASE name " + "".join(f"WHEN '{t}' THEN '{lbl}' " for t, lbl in trace.TOOL_LABELS.items()) + "ELSE name END"

TRACE_CTE = f"""WITH ev AS (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
    tr0 AS (SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq,
                   ts, event_id, user_id, event_type, k, {_TOOL_SQL} AS name FROM ev),
    tr AS (SELECT run_id, seq, ts, name,
             CASE WHEN name = 'search_company_policies' THEN
               '{{"query": "' || event_type || ' trend for user ' || CAST(user_id AS VARCHAR)
               || CASE WHEN k % 4 = 0 THEN ' Bearer tok' || CAST(event_id AS VARCHAR)
                       WHEN k % 7 = 0 THEN ' sk-' || lpad(CAST(event_id AS VARCHAR), 18, 'x') ELSE '' END
               || '", "topK": ' || CAST(k % 60 AS VARCHAR) || '}}'
             ELSE
               '{{"startDate": "' || strftime(CAST(ts AS DATE), '%Y-%m-%d') || '", "endDate": "'
               || CASE WHEN k % 13 = 0 THEN strftime(CAST(ts AS DATE) + k, '%Y/%m/%d')
                       ELSE strftime(CAST(ts AS DATE) + k, '%Y-%m-%d') END || '"'
               || CASE WHEN {_IDKEY_SQL} IS NOT NULL THEN ', "' || {_IDKEY_SQL} || '": ' || CAST(k AS VARCHAR)
                       WHEN k % 3 = 0 THEN ', "warehouseId": ' || CAST(k AS VARCHAR) ELSE '' END
               || CASE WHEN k % 5 = 1 THEN ', "tags": [1, 2, 3]' WHEN k % 5 = 2 THEN ', "filters": {{"a": 1}}' ELSE '' END
               || '}}'
             END AS arguments
           FROM tr0)"""


def _trace(m):
    return trace.events_trace(m.t.events)


@register("trace_sequence")
def q_trace_sequence(m):
    """Ordinal, label and context of every tool call per run."""
    return trace.trace_sequence(_trace(m))


ORACLE["trace_sequence"] = TRACE_CTE + f"""
    SELECT run_id, seq, name, {_LABEL_SQL} AS label,
           CASE WHEN contains(lower(name), 'polic') THEN 'policy' ELSE 'operational' END AS context,
           CASE WHEN contains(lower(name), 'polic') THEN 'approved_policy_passages' ELSE 'operational_facts' END AS context_type
    FROM tr"""


@register("trace_cap_audit")
def q_trace_cap_audit(m):
    """Rounds (> 6 h gap) and call numbers per run against the 6 / 18 caps."""
    return trace.trace_cap_audit(_trace(m))


ORACLE["trace_cap_audit"] = TRACE_CTE + f""",
    g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run_id ORDER BY seq)
                          > CAST({trace.ROUND_GAP_SECONDS} AS BIGINT) * 1000000 THEN 1 ELSE 0 END AS nr FROM tr),
    r AS (SELECT *, CAST(1 + SUM(nr) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS INTEGER) AS round FROM g)
    SELECT run_id, seq, name, round, seq AS call_number, round <= {trace.MAX_TOOL_CALL_ROUNDS} AS within_round_cap,
           seq <= {trace.MAX_TOTAL_TOOL_CALLS} AS within_call_cap,
           round <= {trace.MAX_TOOL_CALL_ROUNDS} AND seq <= {trace.MAX_TOTAL_TOOL_CALLS} AS accepted
    FROM r"""


@register("trace_tools_used")
def q_trace_tools_used(m):
    """Distinct tools per run in first-seen order."""
    return trace.tools_used(_trace(m))


ORACLE["trace_tools_used"] = TRACE_CTE + f""",
    g AS (SELECT run_id, name, MIN(seq) AS first_seq FROM tr GROUP BY run_id, name)
    SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY first_seq) AS INTEGER) AS position, name,
           {_LABEL_SQL} AS label, CASE WHEN contains(lower(name), 'polic') THEN 'policy' ELSE 'operational' END AS context,
           first_seq
    FROM g"""

_JTYPE = ("CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' "
          "WHEN 'DOUBLE' THEN 'number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' "
          "WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN 'null' ELSE 'other' END")
_REDACT_SQL = ("regexp_replace(regexp_replace(regexp_replace({x}, '\\bsk-[A-Za-z0-9_-]{{16,}}\\b', "
               "'[credential-redacted]', 'g'), '(?i)\\bBearer\\s+\\S+', 'Bearer [credential-redacted]', 'g'), "
               "'(?i)OPENAI_API_KEY\\s*[=:]\\s*\\S+', 'OPENAI_API_KEY=[credential-redacted]', 'g')")
_ARGS_CTE = TRACE_CTE + f""",
    kv AS (SELECT tr.run_id, tr.seq, tr.name, j.key, j.value, {_JTYPE} AS json_type, j.value ->> '$' AS s
           FROM tr, json_each(tr.arguments) AS j)"""


@register("sanitize_arguments")
def q_sanitize_arguments(m):
    """Sanitised argument display values and whitelist projection."""
    return trace.sanitize_arguments(_trace(m))


ORACLE["sanitize_arguments"] = _ARGS_CTE + f"""
    SELECT run_id, seq, name, key, json_type,
           CASE json_type WHEN 'string' THEN substr({_REDACT_SQL.format(x='s')}, 1,
                                     CASE WHEN contains(lower(key), 'query') THEN 400 ELSE 80 END)
                          WHEN 'array' THEN '[' || CAST(json_array_length(value) AS VARCHAR) || ' items]'
                          WHEN 'object' THEN '[object]'
                          ELSE CAST(value AS VARCHAR) END AS sanitized,
           key IN ({", ".join(f"'{k}'" for k in trace.WHITELIST_KEYS)})
             AND ((json_type = 'string' AND length(s) <= CASE WHEN key = 'query' THEN 4000 ELSE 10 END)
                  OR json_type IN ('integer', 'null')) AS whitelisted
    FROM kv"""


# The oracle's own statement of the six strict tool contracts (fixed values).
_RULES = """VALUES
    ('get_otif_metrics', 'startDate', 'date', TRUE), ('get_otif_metrics', 'endDate', 'date', TRUE),
    ('get_otif_metrics', 'warehouseId', 'id', FALSE), ('get_otif_metrics', 'customerId', 'id', FALSE),
    ('get_warehouse_performance', 'startDate', 'date', TRUE), ('get_warehouse_performance', 'endDate', 'date', TRUE),
    ('get_inventory_health', 'startDate', 'date', TRUE), ('get_inventory_health', 'endDate', 'date', TRUE),
    ('get_inventory_health', 'warehouseId', 'id', FALSE), ('get_inventory_health', 'productId', 'id', FALSE),
    ('get_vendor_performance', 'startDate', 'date', TRUE), ('get_vendor_performance', 'endDate', 'date', TRUE),
    ('get_vendor_performance', 'vendorId', 'id', FALSE),
    ('get_customer_impact', 'startDate', 'date', TRUE), ('get_customer_impact', 'endDate', 'date', TRUE),
    ('get_customer_impact', 'warehouseId', 'id', FALSE),
    ('search_company_policies', 'query', 'question', TRUE), ('search_company_policies', 'topK', 'count', FALSE)"""


@register("json_contract_violations")
def q_json_contract_violations(m):
    """Tool-call arguments validated against each tool's contract."""
    return trace.contract_violations(_trace(m))


ORACLE["json_contract_violations"] = _ARGS_CTE + f""",
    rules(tool, key, kind, required) AS ({_RULES}),
    missing AS (SELECT run_id, seq, name, key, 'missing_required' AS violation FROM
                  (SELECT tr.run_id, tr.seq, tr.name, r.key FROM tr JOIN rules r ON r.tool = tr.name AND r.required
                   EXCEPT ALL SELECT run_id, seq, name, key FROM kv WHERE (name, key) IN (SELECT (tool, key) FROM rules WHERE required))),
    given AS (SELECT kv.*, r.kind, TRY_CAST(s AS DOUBLE) AS n FROM kv LEFT JOIN rules r ON r.tool = kv.name AND r.key = kv.key),
    checked AS (SELECT run_id, seq, name, key,
      CASE WHEN kind IS NULL THEN 'unexpected_key'
           WHEN kind IN ('date', 'question') AND json_type <> 'string' THEN 'invalid_type'
           WHEN kind IN ('id', 'count') AND (json_type NOT IN ('integer', 'number') OR n <> floor(n)
                                             OR abs(n) > 9007199254740991) THEN 'invalid_type'
           WHEN kind = 'date' AND NOT regexp_full_match(s, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN 'invalid_value'
           WHEN kind = 'question' AND length(s) NOT BETWEEN 1 AND 4000 THEN 'invalid_value'
           WHEN kind = 'id' AND n < 1 THEN 'invalid_value'
           WHEN kind = 'count' AND n NOT BETWEEN 1 AND 50 THEN 'invalid_value' END AS violation
      FROM given)
    SELECT * FROM missing UNION ALL SELECT * FROM checked WHERE violation IS NOT NULL"""


@register("projected_arguments")
def q_projected_arguments(m):
    """Each call's whitelisted arguments as one JSON object."""
    return trace.project_arguments(_trace(m))


ORACLE["projected_arguments"] = _ARGS_CTE + """
    SELECT run_id, seq, name, '{' || COALESCE(string_agg('"' || key || '":' || CAST(value AS VARCHAR), ',' ORDER BY key)
             FILTER (key IN ('startDate', 'endDate', 'warehouseId', 'customerId', 'productId', 'vendorId', 'query', 'topK')
               AND (json_type IN ('integer', 'null')
                    OR json_type = 'string' AND length(s) <= CASE WHEN key = 'query' THEN 4000 ELSE 10 END)), '') || '}'
           AS projected
    FROM kv GROUP BY run_id, seq, name"""

# ---- answers over conversations ----------------------------------------------

# Answer templates: literal parts and column references, shared by the Spark
# side and the oracle so both build identical answer texts.  One in four answers
# is the raw text; the templates differ in heading forms, order, unknown and
# repeated headings, lists and sentence ends.
_T1 = [
    "## Executive summary\n", ("col", "text"),
    "\n\n### Observed operational facts\n- Orders late in turn ", ("col", "turn"), ".\n",
    "## Appendix notes\nThe data does not prove a cause. The cause remains unknown. no direct link was found. "
    "The cause remains unknown.\n",
    "**Recommended actions**:\n1. **Escalate vendor ", ("col", "conv_id"),
    "**: Policy requires escalation after 3 late POs. Track weekly.\n2. Review stock for site ", ("col", "turn"),
    ". Stock below 50% of target must escalate. Keep notes\n- Notify affected customers\n",
    "## Limitations\nThe evidence does not establish causation. 1) Carrier delays remain unverified. "
    "2) carrier delays remain unverified.",
]
_T2 = [
    "Opening words before any heading.\n# Investigation ", ("col", "conv_id"), " #\n", ("col", "text"),
    "\n**Policy basis**\nAbove 5 days late a review is required.\n\n## Recommendations\n\nCall the carrier; then wait.\n\n"
    "Move stock to site ", ("col", "turn"), "\n   \nOTIF must recover!\n## Policy again ##\nSecond policy part\n"
    "### Interpretation\nDemand rose. Lack of scan data. Not enough evidence? Nothing else. Unknown carrier. A lack of labels. "
    "Cannot confirm the route. Cannot verify the dock. Would need to be verified\n",
]
_T3 = [
    "**Observed**\n* first ", ("col", "turn"), "\n* second\n#### Too deep for a heading\n##NoSpace\n**Not bold** tail\n",
    "# Management actions\n+ **Ship early:** within 2 business days. Nothing more\n+ plain item without a clause end\n+ : odd start\n"
    "# Evidence gaps\n- ", ("col", "text"), "\n- Without detailed counts. WITHOUT DETAILED COUNTS. **No direct** proof! 3. No direct proof!",
]
_TEMPLATES = {1: _T1, 2: _T2, 3: _T3}


def _answer_col():
    def build(parts):
        return F.concat(*[F.col(p[1]).cast("string") if isinstance(p, tuple) else F.lit(p) for p in parts])

    pick = (F.col("conv_id") + F.col("turn")) % 4
    out = F.when(pick == 0, F.col("text"))
    for k, parts in _TEMPLATES.items():
        out = out.when(pick == k, build(parts))
    return out


def _sql_lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_ANSWER_SQL = ("CASE (conv_id + turn) % 4 WHEN 0 THEN text " + " ".join(
    f"WHEN {k} THEN " + " || ".join(f"CAST({p[1]} AS VARCHAR)" if isinstance(p, tuple) else _sql_lit(p) for p in parts)
    for k, parts in _TEMPLATES.items()) + " END")


def _answers(m):
    c = m.t.conversations.filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", _answer_col().alias("answer"))


_SECTION_SQL = "CASE " + "".join(
    f"WHEN {cond} THEN '{b}' " for cond, b in [
        ("contains(lower(h), 'executive') OR contains(lower(h), 'investigation')", "executive"),
        ("contains(lower(h), 'observed') OR contains(lower(h), 'operational fact')", "observed"),
        ("contains(lower(h), 'interpret')", "interpretation"),
        ("contains(lower(h), 'recommend') OR contains(lower(h), 'management action') OR starts_with(lower(h), 'action')",
         "actions"),
        ("contains(lower(h), 'policy')", "policy"),
        ("contains(lower(h), 'limitation') OR contains(lower(h), 'evidence gap')", "limitations")]) + "END"

_SECTIONS_CTE = f"""WITH ans AS (SELECT conv_id, turn, {_ANSWER_SQL} AS answer FROM conversations WHERE role = 'assistant'),
    ln AS (SELECT conv_id, turn, unnest(string_split(answer, chr(10))) AS line,
                  unnest(range(1, len(string_split(answer, chr(10))) + 1)) AS pos FROM ans),
    hd AS (SELECT *, CASE WHEN regexp_matches(line, '{answers.MD_HEADING}') THEN regexp_extract(line, '{answers.MD_HEADING}', 1)
                          WHEN regexp_matches(line, '{answers.BOLD_HEADING}') THEN regexp_extract(line, '{answers.BOLD_HEADING}', 1)
                     END AS h FROM ln),
    bk AS (SELECT *, CASE WHEN h IS NOT NULL THEN {_SECTION_SQL} END AS b FROM hd),
    cu AS (SELECT *, COALESCE(last_value(b IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'executive') AS cur FROM bk),
    agg AS (SELECT conv_id, turn, cur, string_agg(line, chr(10) ORDER BY pos) AS txt FROM cu WHERE h IS NULL
            GROUP BY conv_id, turn, cur),
    sec AS (SELECT a.conv_id, a.turn, a.answer, """ + ", ".join(
    f"regexp_replace(COALESCE(MAX(CASE WHEN g.cur = '{s}' THEN g.txt END), ''), '^\\s+|\\s+$', '', 'g') AS {s}"
    for s in answers.SECTIONS) + """
            FROM ans a LEFT JOIN agg g ON g.conv_id = a.conv_id AND g.turn = a.turn GROUP BY a.conv_id, a.turn, a.answer)"""


def _sections(m):
    a = _answers(m)
    s = answers.answer_sections(a.withColumn("_a", F.col("answer")), "_a")
    return s


@register("answer_sections")
def q_answer_sections(m):
    """Assistant answers split into the six section buckets."""
    return _sections(m).drop("answer")


ORACLE["answer_sections"] = _SECTIONS_CTE + " SELECT conv_id, turn, " + ", ".join(answers.SECTIONS) + " FROM sec"


@register("evidence_gaps")
def q_evidence_gaps(m):
    """X16 / T-11: first five distinct evidence-gap sentences per answer."""
    s = _sections(m)
    src = F.when(F.col("limitations") != "", F.col("limitations")).otherwise(F.col("answer"))
    return answers.evidence_gaps(s.select("conv_id", "turn", src.alias("gap_source")), "gap_source")


ORACLE["evidence_gaps"] = _SECTIONS_CTE + f""",
    src AS (SELECT conv_id, turn, replace(regexp_replace(CASE WHEN limitations <> '' THEN limitations ELSE answer END,
                   '(?m)^\\s*[-*+]\\s+', '', 'g'), '**', '') AS t FROM sec),
    sp AS (SELECT conv_id, turn, string_split(regexp_replace(t, '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'),
                  chr(1)) AS arr FROM src),
    se AS (SELECT conv_id, turn, unnest(arr) AS raw, unnest(range(1, len(arr) + 1)) AS pos FROM sp),
    nm AS (SELECT conv_id, turn, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS sentence FROM se),
    nm2 AS (SELECT *, regexp_replace(regexp_replace(sentence, '^\\d+[.)]\\s*', ''), '^\\s+|\\s+$', '', 'g') AS norm FROM nm),
    cand AS (SELECT * FROM nm2 WHERE norm <> '' AND regexp_matches(norm, '{answers.GAP_PATTERN}')),
    dd AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, lower(norm) ORDER BY pos) AS k FROM cand),
    rk AS (SELECT conv_id, turn, sentence, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS gap_rank
           FROM dd WHERE k = 1)
    SELECT conv_id, turn, CAST(gap_rank AS INTEGER) AS gap_rank, sentence AS gap FROM rk WHERE gap_rank <= {answers.MAX_GAPS}"""


@register("run_evidence_gaps")
def q_run_evidence_gaps(m):
    """X16 whole: an answer's gap sentences, then its run's date-coverage gap, distinct, first five."""
    s = _sections(m)
    src = F.when(F.col("limitations") != "", F.col("limitations")).otherwise(F.col("answer"))
    cover = trace.evidence_date_coverage(trace.events_trace(m.t.events, numbered=False))
    both = s.select("conv_id", "turn", src.alias("gap_source")).join(
        cover.select(F.col("run_id").alias("conv_id"), "coverage_gap"), "conv_id", "left")
    return answers.evidence_gaps(both, "gap_source", "coverage_gap")


@register("list_items")
def q_list_items(m):
    """Recommended-action content split into list items (bullets, else paragraphs)."""
    s = _sections(m)
    return answers.list_item_rows(s.select("conv_id", "turn", "actions"), "actions")


@register("action_policy_basis")
def q_action_policy_basis(m):
    """Action items with title, body and policy-basis sentences."""
    s = _sections(m)
    return answers.action_items(s.select("conv_id", "turn", "actions"), "actions")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


ORACLE["action_policy_basis"] = _SECTIONS_CTE + f""",
    li AS (SELECT conv_id, turn, actions,
             list_filter(list_transform(string_split(regexp_replace(actions, '(?m)^(\\s*(?:[-*+]\\s|\\d+[.)]\\s))',
               chr(1) || '\\1', 'g'), chr(1)), lambda x: {_trim('x')}), lambda x: x <> '') AS items,
             list_filter(list_transform(regexp_split_to_array(actions, '\\n\\s*\\n'), lambda x: {_trim('x')}), lambda x: x <> '') AS paras
           FROM sec),
    ch AS (SELECT conv_id, turn, CASE WHEN len(items) > 1 THEN items WHEN len(paras) > 1 THEN paras
                  ELSE list_filter([{_trim('actions')}], lambda x: x <> '') END AS arr FROM li),
    it AS (SELECT conv_id, turn, unnest(arr) AS item, unnest(range(1, len(arr) + 1)) AS item_no FROM ch),
    cl AS (SELECT conv_id, turn, item_no, {_trim("regexp_replace(item, '" + answers.BULLET_PREFIX + "', '')")} AS c
           FROM it),
    ti AS (SELECT *, regexp_matches(c, '^(\\*\\*(.+?)\\*\\*[:\\s-]*)') AS hb,
                  regexp_extract(c, '^(\\*\\*(.+?)\\*\\*[:\\s-]*)', 1) AS m0,
                  regexp_extract(c, '^(\\*\\*(.+?)\\*\\*[:\\s-]*)', 2) AS m2,
                  substr(string_split_regex(c, '[.!?:;]')[1], 1, {answers.TITLE_CHARS}) AS clause FROM cl),
    t2 AS (SELECT *, CASE WHEN hb THEN m2 WHEN clause <> '' THEN clause ELSE 'Recommended action' END AS title FROM ti),
    bo AS (SELECT *, CASE WHEN hb THEN {_trim('substr(c, length(m0) + 1)')}
                          ELSE {_trim("regexp_replace(substr(c, length(title) + 1), '^[:\\s-]+', '')")} END AS body FROM t2)
    SELECT conv_id, turn, CAST(item_no AS INTEGER) AS item_no, title, body,
           array_to_string(list_filter(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
                           lambda x: regexp_matches(x, '{answers.POLICY_PATTERN}')), ' ') AS policy_basis
    FROM bo"""

_SECRET_PARTS = ("CASE WHEN turn % 3 = 0 THEN ' Bearer abc' || CAST(conv_id AS VARCHAR) || '.' "
                 "WHEN turn % 3 = 1 THEN ' key sk-' || lpad(CAST(conv_id AS VARCHAR), 20, 'Z') "
                 "WHEN conv_id % 2 = 0 THEN ' OPENAI_API_KEY = secret' || CAST(turn AS VARCHAR) ELSE '' END")


@register("redact_credentials")
def q_redact_credentials(m):
    """Credential redaction over every conversation turn (secrets injected)."""
    c = m.t.conversations
    secret = (F.when(F.col("turn") % 3 == 0, F.concat(F.lit(" Bearer abc"), F.col("conv_id").cast("string"), F.lit(".")))
              .when(F.col("turn") % 3 == 1, F.concat(F.lit(" key sk-"), F.lpad(F.col("conv_id").cast("string"), 20, "Z")))
              .when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" OPENAI_API_KEY = secret"), F.col("turn").cast("string")))
              .otherwise(F.lit("")))
    t = c.select("conv_id", "turn", F.concat(F.col("text"), secret).alias("text"))
    return answers.redact(t, "text").select("conv_id", "turn", "redacted", "was_redacted")


ORACLE["redact_credentials"] = f"""WITH t AS (SELECT conv_id, turn, text || {_SECRET_PARTS} AS text FROM conversations)
    SELECT conv_id, turn, {_REDACT_SQL.format(x='text')} AS redacted, {_REDACT_SQL.format(x='text')} <> text AS was_redacted
    FROM t"""


@register("evidence_date_coverage")
def q_evidence_date_coverage(m):
    """Month end parsed from the question text vs the latest requested end date."""
    return trace.evidence_date_coverage(trace.events_trace(m.t.events, numbered=False))


ORACLE["evidence_date_coverage"] = _ARGS_CTE + f""",
    q AS (SELECT run_id, 'How did service perform in '
                 || strftime(CAST(MIN(ts) AS DATE) + {trace.QUESTION_LEAD_DAYS}, '%B %Y') || '?' AS question
          FROM tr GROUP BY run_id),
    e AS (SELECT run_id, MAX(s) AS latest_requested_end FROM kv
          WHERE key = 'endDate' AND json_type = 'string' AND regexp_matches(s, '{trace.DATE_REGEX}') GROUP BY run_id),
    j AS (SELECT q.run_id, q.question, e.latest_requested_end,
                 strftime(last_day(strptime(regexp_extract(q.question, '{trace.ASKED_MONTH}', 0), '%B %Y')), '%Y-%m-%d')
                   AS month_end
          FROM q LEFT JOIN e ON e.run_id = q.run_id)
    SELECT run_id, question, month_end, latest_requested_end,
           CASE WHEN latest_requested_end <= month_end THEN 'The investigation''s tool evidence ends on '
                || latest_requested_end || '; later performance was not assessed.' END AS coverage_gap
    FROM j"""


_GAPS = ORACLE["evidence_gaps"]
_COVER = ORACLE["evidence_date_coverage"]
ORACLE["run_evidence_gaps"] = f"""
    WITH g AS (SELECT conv_id, turn, gap_rank AS pos, gap FROM ({_GAPS}) x),
    c AS (SELECT a.conv_id, a.turn, 99 AS pos, coverage_gap AS gap
          FROM (SELECT conv_id, turn FROM conversations WHERE role = 'assistant') a JOIN ({_COVER}) y ON y.run_id = a.conv_id
          WHERE coverage_gap IS NOT NULL),
    u AS (SELECT conv_id, turn, gap, MIN(pos) AS pos FROM (SELECT * FROM g UNION ALL SELECT * FROM c) z GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rk FROM u)
    SELECT conv_id, turn, CAST(rk AS INTEGER) AS gap_rank, gap FROM r WHERE rk <= 5"""


def _list_items_sql() -> str:
    # the item split is the first part of the action-basis statement (up to the items CTE)
    full = ORACLE["action_policy_basis"]
    head = full[: full.index(",\n    cl AS (")]
    return head + " SELECT conv_id, turn, CAST(item_no AS INTEGER) AS item_no, item FROM it"


ORACLE["list_items"] = _list_items_sql()
