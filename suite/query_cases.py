"""Q: query surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.line_cases import BACK, FRONT
from suite.views import table, view, with_views
from tracemill.functions import text as T
from tracemill.operators import query as Q


def ev(spark, sf):
    return view(spark, sf, "events_v")


def tk(spark, sf):
    return view(spark, sf, "tasks_v")


def event_filter(spark, sf):
    return ev(spark, sf).filter(Q.event_filter("diagnostic", "error", file="f1"))


def query_events(spark, sf):
    return Q.query_events(ev(spark, sf), "77", limit=3, offset=1, include_logs=True).select(
        "task_id", "seq", "type", "message")


def event_summary(spark, sf):
    return Q.event_summary(ev(spark, sf), severity="error")


def search_events(spark, sf):
    return Q.search_events(ev(spark, sf), tk(spark, sf), limit=50, offset=7, severity="error").select(
        "task_id", "seq", "code", "message", "started_at")


def list_tasks(spark, sf):
    return Q.list_tasks(tk(spark, sf), '"failed"').select("task_id", "status", "started_at")


def get_tasks(spark, sf):
    return Q.get_tasks(tk(spark, sf), ["3", "14", "159"]).select("task_id", "command", "status")


def tail_raw(spark, sf):
    return Q.tail_raw(view(spark, sf, "doc_lines"), 3).select("task_id", "line_no", "text")


def tail_events(spark, sf):
    return Q.tail_events(ev(spark, sf), 2).select("task_id", "seq", "type", "message")


def inline_events(spark, sf):
    return Q.inline_events(ev(spark, sf), tk(spark, sf)).select("task_id", "seq", "type", "severity")


def truncation_flag(spark, sf):
    sample = Q.inline_events(ev(spark, sf), tk(spark, sf))
    return Q.truncation_flag(sample, Q.response_counts(ev(spark, sf)))


def banner_events(spark, sf):
    """Events of which some first errors are traceback banners."""
    banner = (F.col("task_id").cast("long") % 3 == 0) & (F.col("severity") == "error")
    return ev(spark, sf).withColumn(
        "message", F.when(banner, F.concat(F.lit(" Traceback (x) "), "message")).otherwise(F.col("message")))


def primary_diagnostic(spark, sf):
    return Q.primary_diagnostic(banner_events(spark, sf))


def compact_summary(spark, sf):
    events, tasks = ev(spark, sf), tk(spark, sf)
    return Q.compact_summary(Q.inline_events(events, tasks), tasks, Q.primary_diagnostic(events))


def format_diagnostic(spark, sf):
    return ev(spark, sf).select(
        "task_id", "seq",
        Q.format_diagnostic(F.col("code"), F.col("file"), F.col("line"), F.col("message")).alias("text"))


def diagnostics_equal(spark, sf):
    events = ev(spark, sf).filter("type in ('diagnostic', 'location')")
    primary = Q.primary_diagnostic(events)
    fields = ["code", "file", "line", "message"]
    pairs = events.select("task_id", "seq", F.struct(*fields).alias("b")).join(
        primary.select("task_id", F.struct(*fields).alias("a")), "task_id")
    return pairs.select("task_id", "seq", Q.diagnostics_equal("a", "b").alias("same"))


def is_secondary_summary(spark, sf):
    message = F.expr("""CASE line_no % 5 WHEN 0 THEN 'error: Could not compile ' || text
        WHEN 1 THEN 'aborting due to ' || line_no || ' previous errors' WHEN 2 THEN 'For more information about this error, x'
        WHEN 3 THEN 'due to ' || text ELSE text END""")
    return view(spark, sf, "doc_lines").select("task_id", "line_no", T.is_secondary_summary(message).alias("secondary"))


def outcome_flags(spark, sf):
    return Q.outcome_flags(tk(spark, sf)).select("task_id", "is_failure", "is_tool_error")


def final_status(spark, sf):
    orders = table(spark, sf, "orders").withColumn("s", Q.final_status(
        F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") % 5 == 0,
        F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3 - 1)))
    return orders.select("o_orderkey", "s.status", "s.exit_code")


def duration_text(spark, sf):
    return tk(spark, sf).select("task_id", T.duration_text(F.col("duration_ms")).alias("text"))


def one_line_summary(spark, sf):
    return Q.one_line_summary(tk(spark, sf), Q.primary_diagnostic(ev(spark, sf)))


def response_view(spark, sf):
    raw = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("raw_output"))
    return Q.response_view(tk(spark, sf), ev(spark, sf), raw)


BANNERED = """(SELECT * REPLACE (CASE WHEN CAST(task_id AS BIGINT) % 3 = 0 AND severity = 'error'
  THEN ' Traceback (x) ' || message ELSE message END AS message) FROM events_v)"""


def primary_sql(source):
    return f"""SELECT task_id, seq, type, code, message, file, line FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN banner AND type = 'diagnostic' THEN -seq
    WHEN banner THEN seq + 1000000000000000 ELSE seq END) AS pick
  FROM (SELECT *, starts_with(ltrim(first_value(message) OVER (PARTITION BY task_id ORDER BY seq)), 'Traceback (') AS banner
    FROM {source} s WHERE severity = 'error' AND type <> 'log') e) x WHERE pick = 1"""


INLINE = """SELECT * FROM (SELECT e.*, coalesce(t.exit_code, 0) <> 0 AS failed,
    row_number() OVER (PARTITION BY e.task_id ORDER BY e.seq) AS n
  FROM events_v e JOIN tasks_v t ON e.task_id = t.task_id
  WHERE type <> 'log' AND (coalesce(t.exit_code, 0) = 0 OR severity = 'error')) x
WHERE n <= CASE WHEN failed THEN 20 ELSE 5 END"""


def diag_sql(p=""):
    return f"""CASE WHEN concat_ws(' ', nullif({p}code, ''), {p}file || ':' || CAST({p}line AS STRING), nullif({p}message, '')) = '' THEN 'diagnostic'
  ELSE concat_ws(' ', nullif({p}code, ''), {p}file || ':' || CAST({p}line AS STRING), nullif({p}message, '')) END"""


def same_sql(a, b):
    return f"""(coalesce({a}.code, '') = coalesce({b}.code, '') AND coalesce({a}.file, '') = coalesce({b}.file, '')
  AND {a}.line IS NOT DISTINCT FROM {b}.line AND ({a}.message = {b}.message OR {a}.message = '' OR {b}.message = ''))"""


FAILURE = "(status IN ('failed', 'timeout') OR coalesce(exit_code, 0) <> 0)"
PRIMARY = primary_sql("events_v")
COMPACT_SQL = f"""
WITH prim AS ({PRIMARY}), sample AS ({INLINE}), rest AS (
  SELECT s.task_id, s.seq, {diag_sql('s.')} AS line_text,
    row_number() OVER (PARTITION BY s.task_id ORDER BY s.seq) + CASE WHEN p.task_id IS NULL THEN 0 ELSE 1 END AS n
  FROM sample s LEFT JOIN prim p ON s.task_id = p.task_id
  WHERE s.severity IN ('error', 'warning') AND NOT coalesce({same_sql('p', 's')}, false)),
all_lines AS (SELECT task_id, 1 AS n, {diag_sql()} AS line_text FROM prim
  UNION ALL SELECT task_id, n, line_text FROM rest WHERE n <= 8),
joined AS (SELECT task_id, string_agg(line_text, chr(10) ORDER BY n) AS body, count(*) AS c FROM all_lines GROUP BY 1),
fall AS (SELECT task_id, string_agg(message, chr(10) ORDER BY seq) AS body, count(*) AS c FROM sample WHERE n <= 8 AND message <> '' GROUP BY 1)
SELECT t.task_id, status || CASE WHEN exit_code IS NOT NULL THEN ' (exit ' || CAST(exit_code AS STRING) || ')' ELSE '' END
    || coalesce(chr(10) || coalesce(j.body, f.body), '') AS text, coalesce(j.c, f.c, 0) AS inlined
FROM tasks_v t LEFT JOIN joined j ON t.task_id = j.task_id LEFT JOIN fall f ON t.task_id = f.task_id WHERE {FAILURE}
"""
DURATION = "CASE WHEN duration_ms < 1000 THEN CAST(duration_ms AS STRING) || 'ms' ELSE printf('%.1f', duration_ms / 1000.0::DOUBLE) || 's' END"
ONE_LINE_SQL = f"""
SELECT t.task_id, CASE status WHEN 'completed' THEN '✓' WHEN 'failed' THEN '✗' WHEN 'timeout' THEN '⏱' WHEN 'killed' THEN '⏹' ELSE '⟳' END
  || ' ' || CAST(error_count AS STRING) || CASE WHEN error_count = 1 THEN ' error' ELSE ' errors' END
  || CASE WHEN duration_ms IS NOT NULL THEN ', ' || {DURATION} ELSE '' END
  || CASE WHEN coalesce(exit_code, 0) <> 0 THEN ' (exit ' || CAST(exit_code AS STRING) || ')' ELSE '' END
  || CASE WHEN coalesce(p.message, '') <> '' THEN chr(10) || 'Primary diagnostic: ' || p.message ELSE '' END AS summary
FROM tasks_v t LEFT JOIN ({PRIMARY}) p ON t.task_id = p.task_id
"""
CLIPPED = """(SELECT CAST(doc_id AS STRING) AS task_id, text AS raw, strlen(text) > 16384 AS clipped,
  CASE WHEN strlen(text) > 16384 THEN {0} END AS head, CASE WHEN strlen(text) > 16384 THEN {1} END AS tail FROM documents)""".format(
    FRONT.format("text", 8192), BACK.format("text", 8192))
VIEW_SQL = COMPACT_SQL.replace("\nSELECT t.task_id, status ||", ", compact AS (SELECT t.task_id, status ||").rstrip() + f""")
SELECT task_id, status, exit_code, text, used_raw AND (clipped OR contains(raw, '[output truncated at ') OR contains(raw, '[line truncated at ')) AS raw_truncated,
  incomplete AS events_incomplete, status = 'running' OR incomplete
    OR (used_raw AND (clipped OR contains(raw, '[output truncated at ') OR contains(raw, '[line truncated at '))) AS needs_handle, is_tool_error
FROM (SELECT t.task_id, status, exit_code, r.raw, coalesce(r.clipped, false) AS clipped, NOT structured AND coalesce(r.raw, '') <> '' AS used_raw,
    CASE WHEN structured THEN visible > 8 ELSE visible > 0 END AS incomplete,
    status = 'timeout' OR coalesce(exit_code, 0) NOT IN (0, 1) OR error_count > 0 AS is_tool_error,
    CASE WHEN structured THEN c.text WHEN coalesce(r.raw, '') <> '' THEN CASE WHEN r.clipped
        THEN r.head || chr(10) || '[…]' || chr(10) || r.tail || chr(10) || '[output clipped: '
          || CAST(strlen(r.raw) - strlen(r.head) - strlen(r.tail) AS STRING) || ' bytes omitted]' ELSE r.raw END
      WHEN {FAILURE} THEN '[command failed: exit code ' || coalesce(CAST(exit_code AS STRING), 'unknown') || ']'
      WHEN status = 'running' THEN '' ELSE '✓' END AS text
  FROM (SELECT t.*, {FAILURE} AND t.task_id IN (SELECT task_id FROM sample) AS structured,
      coalesce(v.visible, 0) AS visible FROM tasks_v t
    LEFT JOIN (SELECT task_id, count(*) AS visible FROM events_v WHERE type <> 'log' GROUP BY 1) v ON v.task_id = t.task_id) t
  LEFT JOIN compact c ON c.task_id = t.task_id LEFT JOIN {CLIPPED} r ON r.task_id = t.task_id) x
"""
TE = ("tasks_v", "events_v")
CASES = {
    "q1_event_filter": (event_filter, with_views(
        "SELECT * FROM events_v WHERE type = 'diagnostic' AND severity = 'error' AND contains(file, 'f1')", "events_v")),
    "q2_query_events": (query_events, with_views(
        "SELECT task_id, seq, type, message FROM events_v WHERE task_id = '77' ORDER BY seq LIMIT 3 OFFSET 1", "events_v")),
    "q3_event_summary": (event_summary, with_views(
        "SELECT count(*) AS total, count(*) AS errors, CAST(0 AS BIGINT) AS warnings FROM events_v WHERE severity = 'error' AND type <> 'log'", "events_v")),
    "q4_search_events": (search_events, with_views(
        """SELECT e.task_id, seq, code, message, started_at FROM events_v e JOIN tasks_v t ON e.task_id = t.task_id
          WHERE severity = 'error' AND type <> 'log' ORDER BY started_at DESC, e.task_id, seq LIMIT 50 OFFSET 7""", *TE)),
    "q5_list_tasks": (list_tasks, with_views(
        "SELECT task_id, status, started_at FROM tasks_v WHERE status = 'failed' ORDER BY started_at DESC, task_id LIMIT 10", "tasks_v")),
    "q6_get_tasks": (get_tasks, with_views(
        "SELECT task_id, command, status FROM tasks_v WHERE task_id IN ('3', '14', '159')", "tasks_v")),
    "q7_tail_raw": (tail_raw, with_views(
        "SELECT task_id, line_no, text FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY line_no DESC) AS n FROM doc_lines) t WHERE n <= 3", "doc_lines")),
    "q8_tail_events": (tail_events, with_views(
        "SELECT task_id, seq, type, message FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq DESC) AS n FROM events_v) t WHERE n <= 2", "events_v")),
    "q9_inline_events": (inline_events, with_views(f"SELECT task_id, seq, type, severity FROM ({INLINE}) i", *TE)),
    "q10_truncation_flag": (truncation_flag, with_views(f"""
        SELECT c.task_id, coalesce(s.shown, 0) AS shown, c.total, coalesce(s.shown, 0) < c.total AS truncated,
          CASE WHEN coalesce(s.shown, 0) < c.total THEN 'Showing ' || CAST(coalesce(s.shown, 0) AS STRING) || '/' || CAST(c.total AS STRING) || ' events' END AS hint
        FROM (SELECT task_id, count(*) AS total FROM events_v WHERE type <> 'log' GROUP BY 1) c
        LEFT JOIN (SELECT task_id, count(*) AS shown FROM ({INLINE}) i GROUP BY 1) s ON c.task_id = s.task_id""", *TE)),
    "q11_primary_diagnostic": (primary_diagnostic, with_views(primary_sql(BANNERED), "events_v")),
    "q12_response_counts": (lambda spark, sf: Q.response_counts(ev(spark, sf)), with_views(
        """SELECT task_id, count(*) AS visible, count(*) FILTER (WHERE severity = 'error') AS errors,
          count(*) FILTER (WHERE severity = 'warning') AS warnings FROM events_v WHERE type <> 'log' GROUP BY 1""", "events_v")),
    "q13_compact_summary": (compact_summary, with_views(COMPACT_SQL, *TE)),
    "q14_format_diagnostic": (format_diagnostic, with_views(f"SELECT task_id, seq, {diag_sql()} AS text FROM events_v", "events_v")),
    "q15_diagnostics_equal": (diagnostics_equal, with_views(
        f"SELECT e.task_id, e.seq, {same_sql('p', 'e')} AS same FROM events_v e JOIN ({PRIMARY}) p ON e.task_id = p.task_id WHERE e.type IN ('diagnostic', 'location')", "events_v")),
    "q16_is_secondary_summary": (is_secondary_summary, with_views("""
        SELECT task_id, line_no, line_no % 5 IN (0, 1, 2) OR contains(lower(text), 'could not compile')
          OR (contains(lower(text), 'previous error') AND (line_no % 5 = 3 OR contains(lower(text), 'due to')))
          OR (line_no % 5 = 4 AND (starts_with(lower(text), 'for more information about this error')
            OR starts_with(lower(text), 'some errors have detailed explanations'))) AS secondary FROM doc_lines""", "doc_lines")),
    "q17_top_event_lines": (lambda spark, sf: Q.top_event_lines(ev(spark, sf)), with_views(
        """SELECT task_id, n AS position, CASE WHEN file IS NOT NULL THEN file || ':' || CAST(line AS STRING) || ': ' || message ELSE message END AS text
          FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS n FROM events_v WHERE severity IN ('error', 'warning')) t WHERE n <= 8""", "events_v")),
    "q18_outcome_flags": (outcome_flags, with_views(
        f"SELECT task_id, {FAILURE} AS is_failure, (status = 'timeout' OR coalesce(exit_code, 0) NOT IN (0, 1) OR error_count > 0) AS is_tool_error FROM tasks_v", "tasks_v")),
    "q19_final_status": (final_status, """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'killed' WHEN o_orderkey % 5 = 0 THEN 'timeout'
            WHEN o_custkey % 3 = 1 THEN 'completed' ELSE 'failed' END AS status,
          CASE WHEN o_orderkey % 7 = 0 THEN -3 WHEN o_orderkey % 5 = 0 THEN -2 WHEN o_custkey % 3 = 0 THEN -1
            ELSE o_custkey % 3 - 1 END AS exit_code FROM orders"""),
    "q20_duration_text": (duration_text, with_views(f"SELECT task_id, {DURATION} AS text FROM tasks_v", "tasks_v")),
    "q20_one_line_summary": (one_line_summary, with_views(ONE_LINE_SQL, *TE)),
    "q21_response_view": (response_view, with_views(VIEW_SQL, *TE)),
}
