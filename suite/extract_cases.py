"""X and W8: detection, extraction tiers, whole-output formats, the full structuring."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import rule_sql as R
from suite.merge_cases import CONTEXT, KEEPS, PAIRS, RUNS
from suite.views import table, view, with_views
from tracemill.functions import extract as FX
from tracemill.functions import text as T
from tracemill.operators import extract as X
from tracemill.operators import lines as L
from tracemill.operators import query as Q
from tracemill.operators.lines import MAX_OUTPUT_BYTES
from tracemill.plans.formats import line_format_events
from tracemill.plans.structure import complete_output, structure_output
from tracemill.sources.rulepacks import load_packs, resolve_packs

PACKS = resolve_packs(load_packs())
LINE_PACKS = [p for p in PACKS if p.rules and not p.stateful]
STATEFUL_PACKS = [p for p in PACKS if p.stateful]
TASK_PACKS = [p for p in PACKS if p.name in ("cargo", "python", "go", "npm", "eslint")]

# ---- detection ----------------------------------------------------------------------


def detect_tool(spark, sf):
    found = X.detect_tool(view(spark, sf, "tasks_v").select("task_id", "command"), PACKS)
    return found.select("task_id", F.col("detected").alias("parser"), "route")


VERSION = "concat_ws('.', o_orderkey % 3, o_custkey % 12, {last})"


def version_ok(spark, sf):
    last = "CASE WHEN o_orderkey % 7 = 0 THEN 'rc' ELSE CAST(o_orderkey % 4 AS STRING) END"
    orders = table(spark, sf, "orders").withColumn("version", F.expr(VERSION.replace("{last}", last)))
    return orders.select(
        "o_orderkey", X.version_ok(F.col("version"), F.lit("1.5"), F.lit("2.3.1")).alias("ok")
    )


def resolve_rules(spark, sf):
    parsers = table(spark, sf, "part").selectExpr(
        "p_brand AS name", "p_size AS priority", "p_partkey AS ord",
        "CASE WHEN p_partkey % 3 = 0 THEN 'user' ELSE 'builtin' END AS source",
    )
    return X.resolve_rules(parsers)


def active_rules(spark, sf):
    rules = table(spark, sf, "part").selectExpr(
        "p_brand AS parser", "p_partkey AS ord", "p_size % 2 = 0 AS deprecated",
        "CASE WHEN p_partkey % 3 = 0 THEN 'new' END AS replaced_by",
    )
    return X.active_rules(rules)


# ---- tiers --------------------------------------------------------------------------


def plain_lines(spark, sf, packs):
    """Lines without colour codes, spread over the packs by position."""
    names = F.array(*[F.lit(p.name) for p in packs])
    lines = view(spark, sf, "lines_v").withColumn("text", T.strip_ansi(F.col("text")))
    slot = (F.col("task_id").cast("long") + F.col("line_no")) % len(packs) + 1
    return lines.withColumn("parser_name", F.element_at(names, slot.cast("int")))


def package_lines(spark, sf):
    """Package manager output around the text lines, for the stateful packs."""
    return view(spark, sf, "doc_lines").selectExpr(
        "task_id", "line_no",
        """CASE (line_no + doc_id) % 8 WHEN 0 THEN 'added ' || length(text) || ' packages'
          WHEN 1 THEN 'npm ERR! ' || text WHEN 2 THEN 'npm WARN ' || text
          WHEN 3 THEN 'ERROR: ' || text WHEN 4 THEN 'Collecting ' || text
          WHEN 5 THEN 'ERROR in ' || text WHEN 6 THEN 'warn  ' || text ELSE text END AS text""",
        "CASE doc_id % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pip' WHEN 2 THEN 'pnpm' ELSE 'webpack' END AS parser_name",
    )


def apply_line_rules(spark, sf):
    return X.apply_line_rules(plain_lines(spark, sf, LINE_PACKS), LINE_PACKS).drop("n_bytes")


def apply_stateful_rules(spark, sf):
    return X.apply_stateful_rules(package_lines(spark, sf), STATEFUL_PACKS)


def completion_summary(spark, sf):
    lines = package_lines(spark, sf)
    tasks = view(spark, sf, "tasks_v").select("task_id", "exit_code").withColumn("parser_name", F.lit("npm"))
    npm = [p for p in STATEFUL_PACKS if p.name == "npm"]
    return X.completion_summary(X.apply_stateful_rules(lines, npm), tasks)


def crash_lines(spark, sf):
    """Text lines dressed as crash output of each kind."""
    return view(spark, sf, "doc_lines").selectExpr(
        "task_id", "line_no",
        """CASE (line_no + doc_id) % 9 WHEN 0 THEN '\\tmain.go:' || line_no || ' +0x1d ' || text
          WHEN 1 THEN '  File "app.py", line ' || line_no || ', in f' WHEN 2 THEN 'ValueError: ' || text
          WHEN 3 THEN 'thread ''main'' panicked at oops, src/m.rs:' || line_no || ':5'
          WHEN 4 THEN 'RangeError: ' || text WHEN 5 THEN '    at f (a.js:' || line_no || ':1)'
          WHEN 6 THEN 'Segmentation fault' WHEN 7 THEN 'Killed ' || text ELSE text END AS text""",
    )


def apply_crash_rules(spark, sf):
    return X.apply_crash_rules(crash_lines(spark, sf))


def keyword_lines(spark, sf):
    return view(spark, sf, "doc_lines").selectExpr(
        "task_id", "line_no",
        """CASE (line_no + doc_id) % 11 WHEN 0 THEN 'a.c:' || line_no || ':2: fatal error: ' || text
          WHEN 1 THEN 'a.c:' || line_no || ': Error ' || text WHEN 2 THEN 'build FAILED ' || text
          WHEN 3 THEN '| error[E1]: ' || text WHEN 4 THEN text || ' fatal: x'
          WHEN 5 THEN 'b.c:' || line_no || ':3: warning: ' || text WHEN 6 THEN 'deprecated call ' || text
          WHEN 7 THEN 'error handling of ' || text WHEN 8 THEN '12 passed, 0 failed'
          WHEN 9 THEN 'test a::failed_b ... ok' ELSE text END AS text""",
    )


def apply_heuristics(spark, sf):
    return X.apply_heuristics(keyword_lines(spark, sf))


def is_success_summary(spark, sf):
    return keyword_lines(spark, sf).select(
        "task_id", "line_no", T.is_success_summary(F.col("text")).alias("success")
    )


def normalize_severity(spark, sf):
    raw = F.concat(F.lit(" "), F.col("o_orderpriority"))
    word = F.expr("""CASE o_orderkey % 6 WHEN 0 THEN 'FATAL' WHEN 1 THEN 'Errors' WHEN 2 THEN 'warned'
        WHEN 3 THEN 'note' WHEN 4 THEN 'Debug' ELSE 'x' END""")
    return table(spark, sf, "orders").select(
        "o_orderkey", T.normalize_severity(F.concat(word, raw), "info").alias("severity")
    )


def raw_event(spark, sf):
    return X.raw_events(keyword_lines(spark, sf))


def escalate_stderr(spark, sf):
    lines = view(spark, sf, "lines_v").withColumn("message", T.strip_ansi(F.col("text")))
    events = lines.selectExpr(
        "task_id", "line_no", "source", "message",
        "CASE line_no % 3 WHEN 0 THEN 'summary' ELSE 'log' END AS type",
        "CASE line_no % 2 WHEN 0 THEN 'info' ELSE 'warning' END AS severity",
    )
    return X.escalate_stderr(events)


JSON_TEXT = """CASE event_id % 4
  WHEN 0 THEN props
  WHEN 1 THEN ' {"level":"' || event_type || '","code":' || CAST(user_id AS STRING) || ',"msg":"m ' || event_type
    || '","path":"p/' || CAST(user_id AS STRING) || '","lineno":' || CAST(event_id AS STRING) || '}'
  WHEN 2 THEN '{"type":"' || event_type || '","severity":"critical","error_code":"X' || CAST(user_id AS STRING)
    || '","text":"t"}'
  ELSE '{"level":"' || event_type || '", broken' END"""


def json_line_event(spark, sf):
    lines = table(spark, sf, "events").selectExpr("event_id", f"{JSON_TEXT} AS text")
    return X.apply_tier(lines, FX.json_line_event(F.col("text")), "json")


def parse_lines(spark, sf):
    lines, tasks = view(spark, sf, "lines_v"), view(spark, sf, "tasks_v")
    return X.parse_lines(lines.drop("n_bytes"), tasks, TASK_PACKS)


def parse_bad_bytes(spark, sf):
    """Lines that are not valid text still give one event each."""
    odd = (F.col("line_no") % 2 == 1)
    raw = F.when(odd, F.concat(F.col("text").cast("binary"), F.expr("X'FF'"))).otherwise(
        F.col("text").cast("binary"))
    lines = view(spark, sf, "doc_lines").select(
        "task_id", "line_no", T.cap_line(raw).alias("text"), F.lit(None).cast("string").alias("parser_name"))
    return X.parse_tagged_lines(lines, TASK_PACKS).select("task_id", "line_no", "tier", "message")


# ---- formats ------------------------------------------------------------------------

RAW_TEXT = """CASE doc_id % 6
  WHEN 1 THEN '[{"level":"error","msg":"' || source || '","code":' || CAST(n_chars AS STRING) || '},[1,2],"x"]'
  WHEN 2 THEN '{"a":' || CAST(doc_id AS STRING) || '}' || chr(10) || '{"type":"t","message":"' || lang || '","code":5}'
  WHEN 3 THEN '---' || chr(10) || 'lang: ' || lang || chr(10) || '# c' || chr(10) || 'source: ' || source || ': 1'
  WHEN 4 THEN lang || ',' || source || chr(10) || 'x,' || CAST(n_chars AS STRING)
  ELSE text END"""


def raw_rows(spark, sf):
    return table(spark, sf, "documents").selectExpr("CAST(doc_id AS STRING) AS task_id", f"{RAW_TEXT} AS raw")


def detect_format(spark, sf):
    return X.detect_format(raw_rows(spark, sf)).select("task_id", "format")


def format_events(spark, sf):
    return X.format_events(raw_rows(spark, sf))


def format_events_by_lines(spark, sf):
    """The same from the outputs' lines, none of them put together."""
    lines = raw_rows(spark, sf).select("task_id", F.posexplode(F.split("raw", "\n")).alias("line_no", "text"))
    return line_format_events(lines.withColumn("line_no", F.col("line_no").cast("long")))


def gate_format_events(spark, sf):
    raw = raw_rows(spark, sf)
    lines = L.split_lines(raw)
    capped = L.cap_task_output(lines, 2000)
    tagged = lines.drop("n_bytes", "source").withColumn("parser_name", F.lit(None).cast("string"))
    return X.gate_format_events(X.format_events(raw), X.parse_tagged_lines(tagged, []), capped).select(
        "task_id", "item", "code", "message")


# ---- everything ---------------------------------------------------------------------

#: Positions between the lines of two tasks that become those of one; no task has as many.
LONG_STEP = 10_000


def structured(spark, sf):
    return structure_output(view(spark, sf, "lines_v"), view(spark, sf, "tasks_v"), TASK_PACKS, max_bytes=MAX_OUTPUT_BYTES)


def structure_all(spark, sf):
    return structured(spark, sf).withColumn("context_after", F.array_join("context_after", "|"))


def structure_uncapped(spark, sf):
    """The same over all lines of every task, on segments."""
    out = structure_output(view(spark, sf, "lines_v"), view(spark, sf, "tasks_v"), TASK_PACKS)
    return out.withColumn("context_after", F.array_join("context_after", "|"))


def structure_long_task(spark, sf):
    """A third of the tasks' lines as those of one task, over many segments."""
    task = F.col("task_id").cast("long")
    lines = view(spark, sf, "lines_v").withColumns({
        "task_id": F.when(task % 3 == 0, "1").otherwise(F.col("task_id")),
        "line_no": F.when(task % 3 == 0, (task + 1) * LONG_STEP + F.col("line_no")).otherwise(F.col("line_no"))})
    out = structure_output(lines, view(spark, sf, "tasks_v"), TASK_PACKS, width=LONG_STEP)
    return out.withColumn("context_after", F.array_join("context_after", "|"))


def complete_lines(spark, sf):
    """The line view, with every seventh task printing a table and npm runs adding packages."""
    lines = view(spark, sf, "lines_v")
    task = F.col("task_id").cast("long")
    text = (F.when(task % 7 == 0, F.concat(F.lit("a,b,"), "line_no"))
            .when((task % 6 == 3) & (F.col("line_no") == 1), "added 3 packages").otherwise(F.col("text")))
    return lines.withColumn("text", text)


def complete_all(spark, sf):
    return _completed(complete_output(complete_lines(spark, sf), view(spark, sf, "tasks_v"), TASK_PACKS, max_bytes=MAX_OUTPUT_BYTES))


def complete_uncapped(spark, sf):
    return _completed(complete_output(complete_lines(spark, sf), view(spark, sf, "tasks_v"), TASK_PACKS))


def _completed(out):
    return out.filter("tier = 'format' OR (type = 'summary' AND message LIKE 'npm install%')").select(
        "task_id", "seq", "tier", "type", "severity", "code", "message")


def primary_from_lines(spark, sf):
    return Q.primary_diagnostic(structured(spark, sf))


# ---- SQL ----------------------------------------------------------------------------

PLAIN = "regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g')"
LIST = "[" + ", ".join(R.quote(p.name) for p in LINE_PACKS) + "]"
CASE_COLUMNS = ", ".join(f"e.{f} AS {f}" for f in R.FIELDS)

LINE_RULE_SQL = f"""
SELECT task_id, line_no, source, parser_name, {R.spread('e')}, 'rule' AS tier
FROM (SELECT *, {R.by_parser('parser_name', LINE_PACKS, 'text')} AS e
  FROM (SELECT task_id, line_no, source, {PLAIN} AS text,
    {LIST}[(CAST(task_id AS BIGINT) + line_no) % {len(LINE_PACKS)} + 1] AS parser_name FROM lines_v) a) b
WHERE e IS NOT NULL
"""

PACKAGE_LINES = """SELECT task_id, line_no, doc_id,
  CASE (line_no + doc_id) % 8 WHEN 0 THEN 'added ' || length(text) || ' packages'
    WHEN 1 THEN 'npm ERR! ' || text WHEN 2 THEN 'npm WARN ' || text
    WHEN 3 THEN 'ERROR: ' || text WHEN 4 THEN 'Collecting ' || text
    WHEN 5 THEN 'ERROR in ' || text WHEN 6 THEN 'warn  ' || text ELSE text END AS text,
  CASE doc_id % 4 WHEN 0 THEN 'npm' WHEN 1 THEN 'pip' WHEN 2 THEN 'pnpm' ELSE 'webpack' END AS parser_name
FROM doc_lines"""


def stateful_list(pack, text):
    hits = ", ".join(f"CASE WHEN {R.hit(text, r.regex)} THEN {R.rule_event(text, r, False)} END" for r in pack.active_rules)
    return f"list_filter([{hits}], lambda x: x IS NOT NULL)"


def stateful_case(packs, parser="parser_name", text="text"):
    whens = " ".join(f"WHEN {R.quote(p.name)} THEN {stateful_list(p, text)}" for p in packs)
    return f"CASE {parser} {whens} ELSE [] END"


STATEFUL_SQL = f"""
SELECT task_id, line_no, parser_name, z[1] AS idx, {", ".join(f"z[2].{f} AS {f}" for f in R.FIELDS)}, 'stateful' AS tier
FROM (SELECT *, {stateful_case(STATEFUL_PACKS)} AS many FROM ({PACKAGE_LINES}) p) q,
  unnest(list_zip(range(0, len(many)), many)) AS t(z)
"""

COMPLETION_SQL = f"""
SELECT f.task_id, 'summary' AS type,
  CASE WHEN has_error OR coalesce(exit_code, -1) <> 0 THEN 'error' ELSE 'info' END AS severity,
  'npm install ' || CASE WHEN has_adds THEN 'completed' ELSE 'failed' END || ' (exit '
    || CAST(coalesce(exit_code, -1) AS STRING) || ')' AS message
FROM (SELECT task_id, bool_or(text LIKE 'added % packages' ) AS has_adds, bool_or(starts_with(text, 'npm ERR! ') AND length(text) > 9) AS has_error
  FROM ({PACKAGE_LINES}) p WHERE parser_name = 'npm' GROUP BY 1) f
JOIN tasks_v t ON t.task_id = f.task_id WHERE has_adds OR has_error
"""

CRASH_LINES = """SELECT task_id, line_no,
  CASE (line_no + doc_id) % 9 WHEN 0 THEN chr(9) || 'main.go:' || line_no || ' +0x1d ' || text
    WHEN 1 THEN '  File "app.py", line ' || line_no || ', in f' WHEN 2 THEN 'ValueError: ' || text
    WHEN 3 THEN 'thread ''main'' panicked at oops, src/m.rs:' || line_no || ':5'
    WHEN 4 THEN 'RangeError: ' || text WHEN 5 THEN '    at f (a.js:' || line_no || ':1)'
    WHEN 6 THEN 'Segmentation fault' WHEN 7 THEN 'Killed ' || text ELSE text END AS text FROM doc_lines"""

KEYWORD_LINES = """SELECT task_id, line_no,
  CASE (line_no + doc_id) % 11 WHEN 0 THEN 'a.c:' || line_no || ':2: fatal error: ' || text
    WHEN 1 THEN 'a.c:' || line_no || ': Error ' || text WHEN 2 THEN 'build FAILED ' || text
    WHEN 3 THEN '| error[E1]: ' || text WHEN 4 THEN text || ' fatal: x'
    WHEN 5 THEN 'b.c:' || line_no || ':3: warning: ' || text WHEN 6 THEN 'deprecated call ' || text
    WHEN 7 THEN 'error handling of ' || text WHEN 8 THEN '12 passed, 0 failed'
    WHEN 9 THEN 'test a::failed_b ... ok' ELSE text END AS text FROM doc_lines"""


def tier_sql(lines, expr, tier):
    return f"""SELECT task_id, line_no, {R.spread('e')}, '{tier}' AS tier
FROM (SELECT task_id, line_no, {expr} AS e FROM ({lines}) l) x WHERE e IS NOT NULL"""


HEURISTIC = R.heuristic_sql("text", FX.HEURISTIC_RULES)
CRASH = R.crash_sql("text", FX.CRASH_RULES)
SIGNALS = " OR ".join(
    [f"contains(lower(message), {R.quote(w)})" for w in T.STDERR_SIGNALS]
    + ["starts_with(lower(message), 'e ')", "starts_with(lower(message), 'e' || chr(9))"]
)

ESCALATE_SQL = f"""
SELECT task_id, line_no, source, message, type,
  CASE WHEN source = 'stderr' AND type <> 'summary' AND ({SIGNALS}) THEN 'error' ELSE severity END AS severity
FROM (SELECT task_id, line_no, source, {PLAIN} AS message,
  CASE line_no % 3 WHEN 0 THEN 'summary' ELSE 'log' END AS type,
  CASE line_no % 2 WHEN 0 THEN 'info' ELSE 'warning' END AS severity FROM lines_v) l
"""

JSON_SQL = f"""
SELECT event_id, 'json' AS tier,
  CASE event_id % 4 WHEN 0 THEN 'data' WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'diagnostic' ELSE 'log' END
    ELSE event_type END AS type,
  CASE event_id % 4 WHEN 0 THEN 'info' WHEN 1 THEN CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END
    ELSE 'error' END AS severity,
  CASE event_id % 4 WHEN 1 THEN CAST(user_id AS STRING) WHEN 2 THEN 'X' || CAST(user_id AS STRING) END AS code,
  CASE event_id % 4 WHEN 0 THEN replace(props, ' ', '') WHEN 1 THEN 'm ' || event_type ELSE 't' END AS message,
  CASE event_id % 4 WHEN 1 THEN 'p/' || CAST(user_id AS STRING) END AS file,
  CASE event_id % 4 WHEN 1 THEN event_id END AS line, CAST(NULL AS BIGINT) AS col
FROM events WHERE event_id % 4 <> 3
"""

NPM = [p for p in TASK_PACKS if p.stateful]
TASK_LINE_PACKS = [p for p in TASK_PACKS if not p.stateful]
RAW_EVENT = R.event("'log'", "'info'", "text")
PARSED = f"""
SELECT task_id, line_no, source, z[1] AS idx, {", ".join(f"z[2].{f} AS {f}" for f in R.FIELDS)}, tier FROM (
  SELECT *, CASE WHEN len(many) > 0 THEN 'stateful' WHEN r IS NOT NULL THEN 'rule' WHEN c IS NOT NULL THEN 'crash'
      WHEN h IS NOT NULL THEN 'heuristic' ELSE 'raw' END AS tier,
    CASE WHEN len(many) > 0 THEN many ELSE [coalesce(r, c, h, {RAW_EVENT})] END AS evs
  FROM (SELECT task_id, line_no, source, text, {stateful_case(NPM)} AS many,
      {R.by_parser('parser_name', TASK_LINE_PACKS, 'text')} AS r, {CRASH} AS c, {HEURISTIC} AS h
    FROM (SELECT l.task_id, line_no, source, {PLAIN} AS text, parser_name
      FROM lines_v l LEFT JOIN tasks_v t ON l.task_id = t.task_id) a) b) c,
  unnest(list_zip(range(0, len(evs)), evs)) AS t(z)
"""

# the merge SQL of suite.merge_cases, over the parsed events in (line_no, idx) order
ESCALATED = f"""SELECT * EXCLUDE (severity, idx, source), line_no * 100 + idx AS seq,
  CASE WHEN source = 'stderr' AND type <> 'summary' AND severity IN ('info', 'warning') AND ({SIGNALS})
    THEN 'error' ELSE severity END AS severity FROM parsed"""
STEP_RUNS = RUNS.replace("merge_v", "escalated").replace("SELECT task_id, seq,", "SELECT task_id, seq, line_no, tier,", 1)
STEP_COLLAPSED = f"""SELECT * EXCLUDE (c, message), CAST(c AS BIGINT) AS repeat_count,
  CASE WHEN c > 1 THEN message || ' (repeated ' || CAST(c AS STRING) || ' times)' ELSE message END AS message
FROM ({STEP_RUNS}) x"""
STEP_PAIRED = f"""SELECT task_id, seq, line_no, tier, repeat_count, type, severity, code, message, paired,
  CASE WHEN paired AND file IS NULL THEN partner.file ELSE file END AS file,
  CASE WHEN paired AND file IS NULL THEN partner.line ELSE line END AS line,
  CASE WHEN paired AND file IS NULL THEN partner.col ELSE col END AS col
FROM ({PAIRS.replace('merge_v', 'collapsed')}) p WHERE NOT (kind IS NOT DISTINCT FROM 'L' AND paired)"""
STEP_TAGGED = f"""SELECT *, ctx AND coalesce(head.t = 'diagnostic', false) AS absorbed
FROM (SELECT *, last_value(CASE WHEN NOT ctx THEN {{'s': seq, 't': type}} END IGNORE NULLS)
    OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
  FROM (SELECT *, type = 'log' AND {CONTEXT} AS ctx FROM paired_events) a) b"""
STRUCTURE_SQL = f"""
WITH parsed AS ({PARSED}), escalated AS ({ESCALATED}), collapsed AS ({STEP_COLLAPSED}),
paired_events AS ({STEP_PAIRED}), tagged AS ({STEP_TAGGED}), final AS (
  SELECT e.* EXCLUDE (ctx, head, absorbed, seq), c.joined AS context_after,
    row_number() OVER (PARTITION BY e.task_id ORDER BY e.seq) AS seq
  FROM tagged e LEFT JOIN (SELECT task_id, head.s AS seq, string_agg(message, '|' ORDER BY seq) AS joined
    FROM tagged WHERE absorbed AND {KEEPS} GROUP BY 1, 2) c ON e.task_id = c.task_id AND e.seq = c.seq
  WHERE NOT e.absorbed)
"""
PRIMARY_TAIL = """
SELECT task_id, seq, type, code, message, file, line FROM (
  SELECT f.*, row_number() OVER (PARTITION BY f.task_id ORDER BY CASE WHEN banner AND f.type = 'diagnostic' THEN -f.seq
    WHEN banner THEN 1000000000 + f.seq ELSE f.seq END) AS pick
  FROM final f JOIN (SELECT task_id, starts_with(ltrim(arg_min(message, seq)), 'Traceback (') AS banner
    FROM final WHERE severity = 'error' AND type <> 'log' GROUP BY 1) b ON f.task_id = b.task_id
  WHERE severity = 'error' AND f.type <> 'log') x
WHERE pick = 1
"""

LINES_OF = "list_transform(string_split(body, chr(10)), lambda x: regexp_replace(x, '\\r$', ''))"
DOC_SOURCE = f"(SELECT CAST(doc_id AS STRING) AS task_id, {RAW_TEXT} AS raw FROM documents)"
FORMAT_ROWS = f"""
SELECT *, filled[1] AS first_row,
  CASE WHEN contains(filled[1], chr(9)) THEN chr(9) WHEN contains(filled[1], ',') THEN ','
    WHEN contains(filled[1], '|') THEN '|' END AS delim,
  list_filter(list_transform(all_rows, lambda x: {R.strip('x')}), lambda x: contains(x, ': ') AND NOT starts_with(x, '#')) AS pairs
FROM (SELECT *, list_filter(all_rows, lambda x: {R.strip('x')} <> '') AS filled
  FROM (SELECT *, {LINES_OF} AS all_rows FROM (SELECT task_id, {R.strip('raw')} AS body FROM {DOC_SOURCE} a) b) c) d
"""
FORMAT_SQL = f"""
SELECT *, CASE WHEN body = '' THEN NULL
  WHEN left(body, 1) IN ('{{', '[') AND json_valid(body) THEN 'json'
  WHEN len(filled) >= 2 AND len(list_filter(filled, lambda x: starts_with(trim(x), '{{') AND json_valid(trim(x)))) >= len(filled) * 4 // 5 THEN 'ndjson'
  WHEN (trim(all_rows[1]) = '---' OR (len(all_rows) >= 2 AND len(list_filter(all_rows[1:5], lambda x:
      NOT (trim(x) = '' OR starts_with(trim(x), '#') OR contains({R.strip('x')}, ': ')))) = 0)) AND len(pairs) > 0 THEN 'yaml'
  WHEN len(filled) >= 2 AND delim IS NOT NULL AND len(string_split(first_row, delim)) >= 2
    AND len(list_filter(filled, lambda x: len(string_split(x, delim)) <> len(string_split(first_row, delim)))) = 0 THEN 'csv'
  END AS format
FROM ({FORMAT_ROWS}) f
"""
FORMAT_EVENT_SQL = f"""
SELECT task_id, format, CAST(z[1] AS BIGINT) AS item, z[2].type AS type, z[2].severity AS severity, z[2].code AS code,
  z[2].message AS message, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS BIGINT) AS line, CAST(NULL AS BIGINT) AS col
FROM (SELECT task_id, format, CASE format
    WHEN 'json' THEN [{{'type': 'diagnostic', 'severity': 'error', 'code': regexp_extract(body, 'code":(\\d+)', 1),
        'message': regexp_extract(body, 'msg":"([^"]*)"', 1)}},
      {{'type': 'data', 'severity': 'info', 'code': NULL, 'message': 'JSON array (2 items)'}},
      {{'type': 'data', 'severity': 'info', 'code': NULL, 'message': '"x"'}}]
    WHEN 'ndjson' THEN [{{'type': 'data', 'severity': 'info', 'code': NULL, 'message': filled[1]}},
      {{'type': 't', 'severity': 'info', 'code': '5', 'message': regexp_extract(body, 'message":"([^"]*)"', 1)}}]
    WHEN 'yaml' THEN list_transform(pairs, lambda x: {{'type': 'data', 'severity': 'info',
      'code': left(x, instr(x, ': ') - 1), 'message': x[instr(x, ': ') + 2:]}})
    WHEN 'csv' THEN list_transform(filled, lambda x: {{'type': 'data', 'severity': 'info', 'code': CAST(NULL AS VARCHAR),
      'message': replace(x, delim, ', ')}}) END AS evs
  FROM ({FORMAT_SQL}) g WHERE format IS NOT NULL) h, unnest(list_zip(range(1, len(evs) + 1), evs)) AS t(z)
"""
GATE_SQL = f"""
SELECT task_id, item, code, message FROM ({FORMAT_EVENT_SQL}) e WHERE format <> 'ndjson' AND task_id NOT IN (
  SELECT CAST(doc_id AS STRING) FROM documents WHERE
    strlen({RAW_TEXT}) + CASE WHEN ends_with({RAW_TEXT}, chr(10)) THEN 0 ELSE 0 END > 2000
    OR len(list_filter(string_split({RAW_TEXT}, chr(10)), lambda x: starts_with(trim(x), '{{') AND json_valid(trim(x)))) > 0)
"""

COMPLETE_LINES = """(SELECT * REPLACE (CASE WHEN CAST(task_id AS BIGINT) % 7 = 0 THEN 'a,b,' || line_no
  WHEN CAST(task_id AS BIGINT) % 6 = 3 AND line_no = 1 THEN 'added 3 packages' ELSE text END AS text) FROM lines_v)"""
LONG_LINES = f"""(SELECT * REPLACE (CASE WHEN CAST(task_id AS BIGINT) % 3 = 0 THEN '1' ELSE task_id END AS task_id,
  CASE WHEN CAST(task_id AS BIGINT) % 3 = 0 THEN (CAST(task_id AS BIGINT) + 1) * {LONG_STEP} + line_no ELSE line_no END AS line_no)
  FROM lines_v)"""
LINE_SOURCE = f"(SELECT task_id, string_agg(text, chr(10) ORDER BY line_no) AS raw FROM {COMPLETE_LINES} l GROUP BY 1)"
COMPLETE_SQL = (STRUCTURE_SQL.replace("FROM lines_v l LEFT", f"FROM {COMPLETE_LINES} l LEFT") + f"""
, data AS ({FORMAT_EVENT_SQL.replace(DOC_SOURCE, LINE_SOURCE)}),
last AS (SELECT task_id, max(seq) AS s FROM final GROUP BY 1),
flags AS (SELECT p.task_id, bool_or(type = 'summary' AND starts_with(message, 'added ')) AS has_adds,
    bool_or(type = 'diagnostic' AND severity = 'error') AS has_error
  FROM parsed p JOIN tasks_v t ON t.task_id = p.task_id WHERE tier = 'stateful' AND t.parser_name = 'npm' GROUP BY 1)
SELECT d.task_id, CAST(coalesce(l.s, 0) + item AS BIGINT) AS seq, 'format' AS tier, type, severity, code, message
FROM data d LEFT JOIN last l ON l.task_id = d.task_id
UNION ALL SELECT f.task_id, CAST(coalesce(l.s, 0) + coalesce(n.m, 0) + 1 AS BIGINT), 'stateful', 'summary',
  CASE WHEN has_error OR coalesce(exit_code, -1) <> 0 THEN 'error' ELSE 'info' END, NULL,
  'npm install ' || CASE WHEN has_adds THEN 'completed' ELSE 'failed' END || ' (exit ' || CAST(coalesce(exit_code, -1) AS STRING) || ')'
FROM flags f JOIN tasks_v t ON t.task_id = f.task_id LEFT JOIN last l ON l.task_id = f.task_id
LEFT JOIN (SELECT task_id, max(item) AS m FROM data GROUP BY 1) n ON n.task_id = f.task_id
WHERE has_adds OR has_error
""")

BAD_BYTES_SQL = f"""
SELECT task_id, line_no, CASE WHEN c IS NOT NULL THEN 'crash' WHEN h IS NOT NULL THEN 'heuristic' ELSE 'raw' END AS tier,
  coalesce(c.message, h.message, text) AS message
FROM (SELECT task_id, line_no, text, {CRASH} AS c, {HEURISTIC} AS h FROM (SELECT task_id, line_no,
  CASE WHEN line_no % 2 = 1 THEN text || chr(65533) || ' [invalid UTF-8 replaced]' ELSE text END AS text FROM doc_lines) l) t
"""

CASES = {
    "x1_detect_tool": (detect_tool, with_views("""
        SELECT task_id, coalesce(parser_name, 'inspection') AS parser,
          CASE WHEN parser_name IS NULL THEN 'fast' ELSE 'structured' END AS route FROM tasks_v""", "tasks_v")),
    "x2_version_ok": (version_ok, """
        SELECT o_orderkey, NOT (v < [1, 5] OR v > [2, 3, 1]) AS ok FROM (SELECT o_orderkey,
          CASE WHEN o_orderkey % 7 = 0 THEN [o_orderkey % 3, o_custkey % 12]
            ELSE [o_orderkey % 3, o_custkey % 12, o_orderkey % 4] END AS v FROM orders) o"""),
    "x3_resolve_rules": (resolve_rules, """
        SELECT name, priority, ord, source FROM (SELECT *, row_number() OVER (PARTITION BY name
          ORDER BY priority DESC, source <> 'user', ord) AS n FROM (SELECT p_brand AS name, p_size AS priority,
          p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 THEN 'user' ELSE 'builtin' END AS source FROM part) p) q
        WHERE n = 1"""),
    "x4_active_rules": (active_rules, """
        SELECT * FROM (SELECT p_brand AS parser, p_partkey AS ord, p_size % 2 = 0 AS deprecated,
          CASE WHEN p_partkey % 3 = 0 THEN 'new' END AS replaced_by FROM part) p
        WHERE NOT (deprecated AND replaced_by IS NOT NULL)"""),
    "x5_apply_line_rules": (apply_line_rules, with_views(LINE_RULE_SQL, "lines_v")),
    "x6_apply_stateful_rules": (apply_stateful_rules, with_views(STATEFUL_SQL, "doc_lines")),
    "x7_completion_summary": (completion_summary, with_views(COMPLETION_SQL, "doc_lines", "tasks_v")),
    "x8_apply_crash_rules": (apply_crash_rules, with_views(tier_sql(CRASH_LINES, CRASH, "crash"), "doc_lines")),
    "x9_apply_heuristics": (apply_heuristics, with_views(tier_sql(KEYWORD_LINES, HEURISTIC, "heuristic"), "doc_lines")),
    "x10_is_success_summary": (is_success_summary, with_views(
        f"SELECT task_id, line_no, {R.SUCCESS.format('text')} AS success FROM ({KEYWORD_LINES}) l", "doc_lines")),
    "x11_normalize_severity": (normalize_severity, """
        SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'error' WHEN 2 THEN 'warning'
          ELSE 'info' END AS severity FROM orders"""),
    "x12_raw_event": (raw_event, with_views(tier_sql(
        KEYWORD_LINES, R.event("'log'", f"coalesce(({HEURISTIC}).severity, 'info')", "text"), "raw"), "doc_lines")),
    "x13_escalate_stderr": (escalate_stderr, with_views(ESCALATE_SQL, "lines_v")),
    "x14_json_line_event": (json_line_event, JSON_SQL),
    "x15_detect_format": (detect_format, f"SELECT task_id, format FROM ({FORMAT_SQL}) f"),
    "x16_format_events": (format_events, FORMAT_EVENT_SQL),
    "x16_format_events_by_lines": (format_events_by_lines, FORMAT_EVENT_SQL),
    "x17_gate_format_events": (gate_format_events, GATE_SQL),
    "x18_parse_lines": (parse_lines, with_views(PARSED, "lines_v", "tasks_v")),
    "x19_parse_bad_bytes": (parse_bad_bytes, with_views(BAD_BYTES_SQL, "doc_lines")),
    "w8_structure_output": (structure_all, with_views(STRUCTURE_SQL + "SELECT * FROM final", "lines_v", "tasks_v")),
    "w8_complete_output": (complete_all, with_views(COMPLETE_SQL, "lines_v", "tasks_v")),
    "w8_structure_uncapped": (structure_uncapped, with_views(STRUCTURE_SQL + "SELECT * FROM final", "lines_v", "tasks_v")),
    "w8_structure_long_task": (structure_long_task, with_views(
        STRUCTURE_SQL.replace("FROM lines_v l LEFT", f"FROM {LONG_LINES} l LEFT") + "SELECT * FROM final", "lines_v", "tasks_v")),
    "w8_complete_uncapped": (complete_uncapped, with_views(COMPLETE_SQL, "lines_v", "tasks_v")),
    "w8_primary_from_lines": (primary_from_lines, with_views(STRUCTURE_SQL + PRIMARY_TAIL, "lines_v", "tasks_v")),
}
