"""Tool-call traces: ordering, labels, caps, argument sanitising and
argument-contract validation.

A trace is (run_id, seq, name, arguments JSON).  Argument JSON is parsed once
into a VARIANT map and exploded to (key, value) rows, so type checks use the
value's real JSON type (``schema_of_variant``) and stay JVM-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.functions.scan import ordered_scan
from ordersight.functions.text import redact_credentials
from ordersight.functions.windows import epoch_micros

# Fixed values of the tool catalogue.
TOOL_LABELS = {
    "get_otif_metrics": "OTIF Metrics",
    "get_warehouse_performance": "Warehouse Performance",
    "get_inventory_health": "Inventory Health",
    "get_vendor_performance": "Vendor Performance",
    "get_customer_impact": "Customer Impact",
    "search_company_policies": "Policy Search",
}
MAX_TOOL_CALL_ROUNDS = 6
MAX_TOTAL_TOOL_CALLS = 18
ROUND_GAP_SECONDS = 6 * 3600
WHITELIST_KEYS = ("startDate", "endDate", "warehouseId", "customerId", "productId", "vendorId", "query", "topK")
DATE_REGEX = r"^\d{4}-\d{2}-\d{2}$"

# (tool, key, type, required, min_len, max_len, pattern, minimum, maximum)
CONTRACT = [
    *[(t, k, "string", True, None, None, DATE_REGEX, None, None)
      for t in ("get_otif_metrics", "get_warehouse_performance", "get_inventory_health",
                "get_vendor_performance", "get_customer_impact") for k in ("startDate", "endDate")],
    ("get_otif_metrics", "warehouseId", "integer", False, None, None, None, 1.0, None),
    ("get_otif_metrics", "customerId", "integer", False, None, None, None, 1.0, None),
    ("get_inventory_health", "warehouseId", "integer", False, None, None, None, 1.0, None),
    ("get_inventory_health", "productId", "integer", False, None, None, None, 1.0, None),
    ("get_vendor_performance", "vendorId", "integer", False, None, None, None, 1.0, None),
    ("get_customer_impact", "warehouseId", "integer", False, None, None, None, 1.0, None),
    ("search_company_policies", "query", "string", True, 1, 4000, None, None, None),
    ("search_company_policies", "topK", "integer", False, None, None, None, 1.0, 50.0),
]
MAX_SAFE_INTEGER = 2.0**53 - 1

# events.event_type -> business tool (the test-data mapping)
EVENT_TOOL = {"view": "get_otif_metrics", "signup": "get_warehouse_performance", "click": "get_inventory_health",
              "error": "get_vendor_performance", "purchase": "get_customer_impact"}
_ID_KEY = {"get_otif_metrics": "warehouseId", "get_inventory_health": "productId",
           "get_vendor_performance": "vendorId", "get_customer_impact": "warehouseId"}


def label_expr(name: Column) -> Column:
    """tool name -> display label (unknown names pass through)."""
    m = F.create_map(*[F.lit(x) for kv in TOOL_LABELS.items() for x in kv])
    return F.coalesce(m[name], name)


def context_expr(name: Column) -> Column:
    """Policy passages vs operational facts by tool name."""
    return F.when(F.lower(name).contains("polic"), F.lit("policy")).otherwise(F.lit("operational"))


def context_type_expr(name: Column) -> Column:
    return F.when(F.lower(name).contains("polic"), F.lit("approved_policy_passages")).otherwise(
        F.lit("operational_facts"))


def events_trace(events: DataFrame, numbered: bool = True) -> DataFrame:
    """Map the ``events`` table onto tool-call traces: run = user, seq by
    (ts, event_id), tool by event type (every tenth k is a policy search),
    arguments JSON built from the event; some calls deliberately break the
    contract (id 0, slash dates, extra keys, topK > 50, credentials).

    Calls are numbered, and rounds told apart, in one ordered scan of the raw events; what is built from an event
    is built afterwards, and only if it is asked for.  ``numbered=False`` leaves ``seq`` and ``round`` out, and with
    them the shuffle."""
    raw = events.select("user_id", "ts", "event_id", "event_type", "props")
    if numbered:
        raw = ordered_scan(raw.withColumn("_us", epoch_micros("ts")), ["user_id"], ["ts", "event_id"], "seq",
                           session=("round", "_us", ROUND_GAP_SECONDS * 1_000_000))
    k = F.get_json_object("props", "$.k").cast("int")
    tool = F.when(k % 10 == 0, F.lit("search_company_policies")).otherwise(
        F.create_map(*[F.lit(x) for kv in EVENT_TOOL.items() for x in kv])[F.col("event_type")])
    d1 = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")
    d2 = F.when(k % 13 == 0, F.date_format(F.date_add(F.col("ts").cast("date"), k), "yyyy/MM/dd")).otherwise(
        F.date_format(F.date_add(F.col("ts").cast("date"), k), "yyyy-MM-dd"))
    dates = F.concat(F.lit('{"startDate": "'), d1, F.lit('", "endDate": "'), d2, F.lit('"'))
    secret = (F.when(k % 4 == 0, F.concat(F.lit(" Bearer tok"), F.col("event_id").cast("string")))
              .when(k % 7 == 0, F.concat(F.lit(" sk-"), F.lpad(F.col("event_id").cast("string"), 18, "x")))
              .otherwise(F.lit("")))
    search_args = F.concat(F.lit('{"query": "'), F.col("event_type"), F.lit(" trend for user "),
                           F.col("user_id").cast("string"), secret, F.lit('", "topK": '), (k % 60).cast("string"),
                           F.lit("}"))
    id_key = F.create_map(*[F.lit(x) for kv in _ID_KEY.items() for x in kv])[tool]
    extras = (F.when(k % 5 == 1, F.lit(', "tags": [1, 2, 3]')).when(k % 5 == 2, F.lit(', "filters": {"a": 1}'))
              .otherwise(F.lit("")))
    biz = F.concat(dates,
                   F.when(id_key.isNotNull(), F.concat(F.lit(', "'), id_key, F.lit('": '), k.cast("string")))
                   .when(k % 3 == 0, F.concat(F.lit(', "warehouseId": '), k.cast("string")))
                   .otherwise(F.lit("")),
                   extras, F.lit("}"))
    args = F.when(tool == "search_company_policies", search_args).otherwise(biz)
    numbers = [F.col("seq").cast("int").alias("seq"), F.col("round").cast("int").alias("round")] if numbered else []
    return raw.select(F.col("user_id").alias("run_id"), *numbers, "ts", tool.alias("name"), args.alias("arguments"))


def trace_sequence(trace: DataFrame) -> DataFrame:
    """Ordinal, label and context of every call of every run."""
    return trace.select("run_id", "seq", "name", label_expr(F.col("name")).alias("label"),
                        context_expr(F.col("name")).alias("context"),
                        context_type_expr(F.col("name")).alias("context_type"))


def trace_cap_audit(trace: DataFrame) -> DataFrame:
    """Round number (a new round after a > 6 h gap) and call number per
    run; calls beyond 6 rounds or 18 calls are flagged as rejected.

    A trace without rounds gets them from an ordered scan, which spreads a run that holds a third of all calls
    over as many tasks as its calls need."""
    t = trace
    if "round" not in t.columns:
        t = ordered_scan(t.withColumn("_us", epoch_micros("ts")), ["run_id"], ["seq"],
                         session=("round", "_us", ROUND_GAP_SECONDS * 1_000_000))
        t = t.withColumn("round", F.col("round").cast("int"))
    rnd = F.col("round")
    return t.select("run_id", "seq", "name", rnd.alias("round"), F.col("seq").alias("call_number"),
                    (rnd <= MAX_TOOL_CALL_ROUNDS).alias("within_round_cap"),
                    (F.col("seq") <= MAX_TOTAL_TOOL_CALLS).alias("within_call_cap"),
                    ((rnd <= MAX_TOOL_CALL_ROUNDS) & (F.col("seq") <= MAX_TOTAL_TOOL_CALLS)).alias("accepted"))


def tools_used(trace: DataFrame) -> DataFrame:
    """Distinct tools per run in first-seen order (min seq, then rank)."""
    g = trace.groupBy("run_id", "name").agg(F.min("seq").alias("first_seq"))
    w = Window.partitionBy("run_id").orderBy("first_seq")
    return g.select("run_id", F.row_number().over(w).alias("position"), "name",
                    label_expr(F.col("name")).alias("label"), context_expr(F.col("name")).alias("context"),
                    "first_seq")


def parsed_arguments() -> Column:
    """The arguments as a map; NULL if the text is NULL, not JSON or not an object (that call only is unfit)."""
    return F.try_variant_get(F.try_parse_json("arguments"), "$", "map<string,variant>")


def argument_values(trace: DataFrame) -> DataFrame:
    """(run_id, seq, name, key, value VARIANT, json_type) per argument."""
    kv = trace.select("run_id", "seq", "name", F.explode(parsed_arguments()).alias("key", "value"))
    return kv.withColumn("json_type", json_type(F.schema_of_variant("value")))


def json_type(schema: Column) -> Column:
    """Collapse a variant schema string to a JSON type name."""
    return (F.when(schema == "STRING", F.lit("string"))
            .when(schema.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("integer"))
            .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), F.lit("number"))
            .when(schema == "BOOLEAN", F.lit("boolean"))
            .when(schema.startswith("ARRAY"), F.lit("array"))
            .when(schema.startswith("OBJECT"), F.lit("object"))
            .when(schema == "VOID", F.lit("null"))
            .otherwise(F.lit("other")))


def sanitize_arguments(trace: DataFrame) -> DataFrame:
    """X13 + X14: per argument, the sanitised display value (strings redacted
    and cut to 400 characters when the key mentions "query", else 80;
    arrays -> "[n items]"; objects -> "[object]"; scalars as JSON) and whether
    the whitelist projection keeps it (8 known keys; strings of at most 10
    characters, 4000 for query; integers; null)."""
    return sanitized(argument_values(trace)).select("run_id", "seq", "name", "key", "json_type", "sanitized",
                                                    "whitelisted")


def sanitized(a: DataFrame) -> DataFrame:
    """Argument rows with their display value and whether the whitelist keeps them."""
    s = F.try_variant_get("value", "$", "string")
    num = F.try_variant_get("value", "$", "double")
    cut = F.when(F.lower("key").contains("query"), F.lit(400)).otherwise(F.lit(80))
    n_items = F.size(F.try_variant_get("value", "$", "array<variant>"))
    shown = (F.when(F.col("json_type") == "string", F.expr("substring(x, 1, c)"))
             .when(F.col("json_type") == "array", F.concat(F.lit("["), n_items.cast("string"), F.lit(" items]")))
             .when(F.col("json_type") == "object", F.lit("[object]"))
             .otherwise(F.to_json("value")))
    a = a.withColumn("x", redact_credentials(s)).withColumn("c", cut)
    keep_len = F.when(F.col("key") == "query", F.lit(4000)).otherwise(F.lit(10))
    kept = (F.col("key").isin(*WHITELIST_KEYS)
            & (((F.col("json_type") == "string") & (F.length(s) <= keep_len))
               | (F.col("json_type") == "null") | (F.col("json_type").isin("integer", "number")
                                                  & (num == F.floor(num).cast("double")))))
    return a.withColumns({"sanitized": shown, "whitelisted": kept}).drop("x", "c")


def project_arguments(trace: DataFrame) -> DataFrame:
    """Per call, the arguments that the whitelist keeps, as one JSON object with sorted keys."""
    kept = F.struct("key", F.to_json("value").alias("value"))
    a = argument_values(trace)
    return (sanitized(a).groupBy("run_id", "seq", "name")
            .agg(F.array_sort(F.collect_list(F.when(F.col("whitelisted"), kept))).alias("_kept"))
            .select("run_id", "seq", "name", F.concat(F.lit("{"), F.array_join(F.transform(
                "_kept", lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])), ","), F.lit("}"))
                .alias("projected")))


MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September",
               "October", "November", "December")
QUESTION_LEAD_DAYS = 105
# Fixed value: the date-coverage gap sentence.
COVERAGE_GAP_TEMPLATE = "The investigation's tool evidence ends on %s; later performance was not assessed."
ASKED_MONTH = r"(?i)(" + "|".join(MONTH_NAMES) + r")\s+(20\d{2})"


def month_end_from_text(text: Column) -> Column:
    """last day of the first "<Month> <YYYY>" mentioned in a text (NULL if none)."""
    found = F.regexp_extract(text, ASKED_MONTH, 0)
    return F.when(found != "", F.last_day(F.to_date(F.initcap(found), "MMMM yyyy")))


def evidence_date_coverage(trace: DataFrame) -> DataFrame:
    """X16 date-coverage gap per run: the question asks about the month
    ``QUESTION_LEAD_DAYS`` after the run's first call; when the latest requested ``endDate`` (valid ISO strings
    only, compared as text) is on or before that month's end, the gap
    sentence says where the evidence ends.  Two per-run aggregates joined on
    run_id (both hash-partitioned by run_id already)."""
    q = trace.groupBy("run_id").agg(F.min("ts").alias("first_ts")).select(
        "run_id", F.concat(F.lit("How did service perform in "),
                           F.date_format(F.date_add(F.col("first_ts").cast("date"), QUESTION_LEAD_DAYS), "MMMM yyyy"),
                           F.lit("?")).alias("question"))
    arg = F.try_variant_get(F.try_parse_json("arguments"), "$.endDate", "variant")
    s = F.try_variant_get(arg, "$", "string")
    ends = trace.select("run_id", F.when(F.schema_of_variant(arg) == "STRING", s).alias("_end"))
    s = F.col("_end")
    ends = ends.filter(s.rlike(DATE_REGEX)) \
        .groupBy("run_id").agg(F.max(s).alias("latest_requested_end"))
    j = q.join(ends, "run_id", "left")
    month_end = F.date_format(month_end_from_text(F.col("question")), "yyyy-MM-dd")
    gap = F.when(F.col("latest_requested_end") <= month_end,
                 F.format_string(COVERAGE_GAP_TEMPLATE, F.col("latest_requested_end")))
    return j.select("run_id", "question", month_end.alias("month_end"), "latest_requested_end",
                    gap.alias("coverage_gap"))


def _rule_map() -> Column:
    """"tool<TAB>key" -> rule struct, as a literal map (a fixed ~20-entry contract)."""
    entries = []
    for tool, key, typ, _req, mn, mx, pat, lo, hi in CONTRACT:
        entries += [F.lit(f"{tool}\t{key}"),
                    F.struct(F.lit(typ).alias("type"), F.lit(mn).cast("int").alias("min_len"),
                             F.lit(mx).cast("int").alias("max_len"), F.lit(pat).cast("string").alias("pattern"),
                             F.lit(lo).cast("double").alias("minimum"), F.lit(hi).cast("double").alias("maximum"))]
    return F.create_map(*entries)


def _required_map() -> Column:
    req: dict[str, list[str]] = {}
    for tool, key, _t, required, *_ in CONTRACT:
        if required:
            req.setdefault(tool, []).append(key)
    return F.create_map(*[x for tool, keys in req.items() for x in (F.lit(tool), F.array(*map(F.lit, keys)))])


def contract_violations(trace: DataFrame) -> DataFrame:
    """Validate every call's arguments against its tool's contract.

    Violations: invalid_json (NULL, malformed or not an object; no key), missing_required, unexpected_key
    (every tool of the contract is strict), invalid_type (an integer is a whole number up to 2^53 - 1, however
    it is written), invalid_value (length, pattern, minimum, maximum).  The contract is a literal map, so the
    whole check is row-local: each call's missing required keys and its (key, value) arguments are exploded
    once and checked with plain column expressions (whole-stage codegen; no lambda per key) -- no join, no
    shuffle."""
    args = parsed_arguments()
    calls = trace.select("run_id", "seq", "name", args.alias("args"))
    rules, required = _rule_map(), _required_map()
    name = F.col("name")
    present = F.map_keys("args")
    # Missing required keys get a SQL NULL value; a given key's value is never
    # SQL NULL (JSON null parses to a VOID variant), so ``value IS NULL``
    # marks the missing ones after one explode of both lists.
    missing = F.transform(
        F.array_except(F.coalesce(required[name], F.array().cast("array<string>")), present),
        lambda k: F.struct(k.alias("key"), F.lit(None).cast("variant").alias("value")))
    unfit = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("variant").alias("value")))
    entries = F.when(F.col("args").isNull(), unfit).otherwise(F.concat(missing, F.map_entries("args")))
    kv = calls.select("run_id", "seq", "name", F.explode(entries).alias("a")) \
        .select("run_id", "seq", "name", "a.key", "a.value", F.col("a.value").isNull().alias("missing"),
                F.schema_of_variant("a.value").alias("_schema"))
    # Look the rule up and read the value once per argument (one projection),
    # then decide from plain columns: keeps the generated code small.
    kv = kv.select("run_id", "seq", "name", "key", "missing",
                   rules[F.concat(name, F.lit("\t"), F.col("key"))].alias("rule"),
                   json_type(F.col("_schema")).alias("jt"),
                   F.try_variant_get("value", "$", "string").alias("s"),
                   F.try_variant_get("value", "$", "double").alias("num"))
    rule, jt, s, num = F.col("rule"), F.col("jt"), F.col("s"), F.col("num")
    type_ok = (F.when(rule["type"] == "string", jt == "string")
               .when(rule["type"] == "integer", jt.isin("integer", "number") & (num == F.floor(num).cast("double"))
                     & (F.abs(num) <= MAX_SAFE_INTEGER))
               .when(rule["type"] == "number", jt.isin("integer", "number"))
               .otherwise(F.lit(True)))
    value_ok = (F.coalesce(F.length(s) >= rule["min_len"], F.lit(True))
                & F.coalesce(F.length(s) <= rule["max_len"], F.lit(True))
                & F.coalesce(F.regexp_like(s, rule["pattern"]), F.lit(True))
                & F.coalesce(num >= rule["minimum"], F.lit(True))
                & F.coalesce(num <= rule["maximum"], F.lit(True)))
    known = name.isin(*sorted({c[0] for c in CONTRACT}))
    v = (F.when(F.col("key").isNull(), F.lit("invalid_json"))
         .when(F.col("missing"), F.lit("missing_required"))
         .when(rule.isNull(), F.when(known, F.lit("unexpected_key")))
         .when(~type_ok, F.lit("invalid_type"))
         .when(~value_ok, F.lit("invalid_value")))
    # Keep only real violations with a generator rather than a Filter: a
    # filter on ``violation`` would be pushed below the projection above and
    # re-evaluate the rule lookup once per reference.
    return kv.select("run_id", "seq", "name", "key", F.explode(F.array_compact(F.array(v))).alias("violation"))
