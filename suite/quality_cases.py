"""B (and J7, J8): extraction quality and agent benchmark scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.views import table, view, with_views
from tracemill.operators import lookup as J
from tracemill.operators import quality as B

COLS = ["type", "severity", "code", "message", "file", "line"]


def actual(spark, sf):
    return view(spark, sf, "merge_v").select(F.col("task_id").alias("fixture"), F.col("seq").alias("idx"), *COLS)


def expected(spark, sf):
    """The same events, some severities changed, some rows dropped, some codes left out."""
    return actual(spark, sf).filter("idx % 29 <> 0").withColumns({
        "severity": F.expr("CASE WHEN idx % 17 = 0 THEN 'info' ELSE severity END"),
        "line": F.expr("CASE WHEN idx % 13 = 0 THEN line + 1 ELSE line END"),
    })


def match_expected(spark, sf):
    pairs = J.match_expected(actual(spark, sf), expected(spark, sf))
    return pairs.select("fixture", "idx", F.col("e.severity").alias("want"), F.col("a.severity").alias("got"))


def score_fixtures(spark, sf):
    return B.score_fixtures(actual(spark, sf), expected(spark, sf))


def field_rates(spark, sf):
    return B.field_rates(actual(spark, sf), expected(spark, sf))


def first_error_advantage(spark, sf):
    return B.first_error_advantage(view(spark, sf, "lines_v"), view(spark, sf, "merge_v"))


#: Some lines of any kind say that something failed.
FAILED_TEXT = "CASE WHEN line_no % 7 = 3 THEN text || ' (Failed)' ELSE text END"


def raw_lines(spark, sf):
    return view(spark, sf, "lines_v").withColumn("text", F.expr(FAILED_TEXT))


def unparsed_error_lines(spark, sf):
    events = view(spark, sf, "merge_v").withColumnRenamed("seq", "line_no")
    return B.unparsed_error_lines(raw_lines(spark, sf), events)


def report(spark, sf):
    return B.benchmark_report(view(spark, sf, "merge_v"), actual(spark, sf), expected(spark, sf))


def benchmark_report(spark, sf):
    return report(spark, sf)


def benchmark_totals(spark, sf):
    return B.benchmark_totals(report(spark, sf))


def compare_reports(spark, sf):
    old_events = view(spark, sf, "merge_v").filter("task_id % 7 <> 0 AND type <> 'crash'")
    old = B.benchmark_report(old_events, actual(spark, sf), actual(spark, sf))
    return B.compare_reports(report(spark, sf), old)


def full_report(spark, sf):
    return B.benchmark_report(view(spark, sf, "merge_v"), actual(spark, sf), expected(spark, sf), raw_lines(spark, sf))


def line_totals(spark, sf):
    return B.benchmark_line_totals(full_report(spark, sf))


def diff_reports(spark, sf):
    """Against a report without some tasks and crashes, in which all was as expected; the new one lacks others."""
    old_events = view(spark, sf, "merge_v").filter("task_id % 7 <> 0 AND type <> 'crash'")
    old = B.benchmark_report(old_events, actual(spark, sf), actual(spark, sf), raw_lines(spark, sf))
    return B.diff_reports(full_report(spark, sf).filter("fixture % 11 <> 0"), old)


MESSAGE = """'note' || chr(10) || 'EXIT_CODE: ' || CAST(turn % 3 AS STRING) || chr(10) || 'CODE: E' || CAST(conv_id % 7 AS STRING)
  || chr(10) || 'MESSAGE: ' || text || chr(10) || 'LOCATION: src/a.rs:' || CAST(turn AS STRING) || chr(10)
  || CASE WHEN turn % 2 = 0 THEN 'Status: PASS' ELSE 'STATUS: failing' END"""


def runs(spark, sf):
    """One run per conversation turn."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id || '-' || turn AS task_id", "CASE WHEN conv_id % 2 = 0 THEN 'tool' ELSE 'shell' END AS mode",
        "CASE WHEN turn % 2 = 0 THEN 'fix' ELSE 'diagnose' END AS kind",
        "CASE conv_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'ok' END AS status", "conv_id % 3 = 0 AS verify_pass",
        f"{MESSAGE} AS last_message", "'[]' AS tools", "conv_id", "turn")


def run_expected(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id || '-' || turn AS task_id", "CASE WHEN conv_id % 4 > 0 THEN CAST(turn % 2 AS INT) END AS exit_code",
        "'e' || (conv_id % 5) AS code", "array('the', 'zzz') AS message_contains",
        "'src/a.rs' AS location_file", "CASE WHEN turn > 0 THEN 1 END AS location_line")


def agent_events(spark, sf):
    """Turns as tool calls (assistant) or shell commands, with repeated commands per run."""
    return table(spark, sf, "conversations").selectExpr(
        "CAST(conv_id AS STRING) AS task_id", "CASE WHEN conv_id % 2 = 0 THEN 'tool' ELSE 'shell' END AS mode", "turn AS pos",
        "CASE WHEN role = 'assistant' OR conv_id % 4 = 0 THEN 'mcp' ELSE 'shell' END AS kind",
        "CASE WHEN role = 'assistant' OR conv_id % 4 = 0 THEN 'runner' END AS server",
        "role || (turn % 2) AS command", "CAST(NULL AS STRING) AS arguments", "length(text) AS tokens")


def run_list(spark, sf):
    return agent_events(spark, sf).groupBy("task_id", "mode").agg(
        F.when(F.max("pos") % 2 == 0, "fix").otherwise("diagnose").alias("kind"))


def extract_report(spark, sf):
    out = B.extract_report(runs(spark, sf))
    return out.select("task_id", "report_exit_code", "report_code", "report_message", "report_location", "claimed_status")


def score_diagnose(spark, sf):
    out = B.score_diagnose(runs(spark, sf), run_expected(spark, sf))
    return out.select("task_id", "exit_ok", "code_ok", "msg_ok", "loc_ok", "success", "primary_hit")


def score_fix(spark, sf):
    return B.score_fix(runs(spark, sf)).select("task_id", "claimed_status", "success")


def path_compliance(spark, sf):
    return B.path_compliance(agent_events(spark, sf), run_list(spark, sf), "runner", "tool")


def mode_summary(spark, sf):
    tokens = agent_events(spark, sf).groupBy("task_id", "mode").agg(
        F.sum("tokens").alias("input_tokens"), F.max("tokens").cast("long").alias("output_tokens"),
        (F.max("pos") > 3).alias("success"), (F.max("pos") > 1).alias("primary_hit"))
    scored = tokens.join(path_compliance(spark, sf), ["task_id", "mode"]).join(
        B.count_retries(agent_events(spark, sf)), ["task_id", "mode"], "left")
    return B.mode_summary(scored)


EXPECTED = """(SELECT task_id, seq, type, CASE WHEN seq % 17 = 0 THEN 'info' ELSE severity END AS severity, code, message, file,
  CASE WHEN seq % 13 = 0 THEN line + 1 ELSE line END AS line FROM merge_v WHERE seq % 29 <> 0)"""


def ok(col):
    return f"(e.task_id IS NOT NULL AND a.task_id IS NOT NULL AND (e.{col} IS NULL OR coalesce(e.{col} = a.{col}, false)))"


SCORED = f"""SELECT coalesce(e.task_id, a.task_id) AS fixture, coalesce(e.seq, a.seq) AS idx, e.task_id IS NOT NULL AS is_e, a.task_id IS NOT NULL AS is_a,
  {ok('type')} AS type_ok, {ok('severity')} AS sev_ok, {ok('code')} AS code_ok, {ok('message')} AS message_ok, {ok('file')} AS file_ok, {ok('line')} AS line_ok
FROM {EXPECTED} e FULL JOIN merge_v a ON e.task_id = a.task_id AND e.seq = a.seq"""
ALL_OK = "type_ok AND sev_ok AND code_ok AND message_ok AND file_ok AND line_ok"
FIXTURE_SQL = f"""SELECT *, n_expected = n_actual AND matched >= n_expected * 0.95 AS passed FROM (SELECT fixture,
  count(*) FILTER (WHERE is_e) AS n_expected, count(*) FILTER (WHERE is_a) AS n_actual, count(*) FILTER (WHERE {ALL_OK}) AS matched
  FROM ({SCORED}) s GROUP BY 1) t"""
RATES_SQL = "SELECT fixture, " + ", ".join(
    f"count(*) FILTER (WHERE {n}_ok) * 100.0::DOUBLE / count(*) FILTER (WHERE is_e) AS {n}_pct" for n in B.FIELDS
) + f" FROM ({SCORED}) s GROUP BY 1 HAVING count(*) FILTER (WHERE is_e) > 0"
DENSITY = """SELECT task_id AS fixture, count(*) AS events, 2 * count(*) + count(severity) + count(code) + count(file) AS fields,
  count(file) AS with_location, count(code) AS with_code, count(*) FILTER (WHERE type <> 'log') AS diagnostic_events FROM {src} GROUP BY 1"""
REPORT_SQL = f"""SELECT d.*, CASE WHEN n_expected > 0 THEN matched::DOUBLE / n_expected ELSE 1.0 END AS accuracy,
  fields::DOUBLE / events AS fields_per_event FROM ({DENSITY.replace('{src}', 'merge_v')}) d LEFT JOIN ({FIXTURE_SQL}) f ON f.fixture = d.fixture"""
OLD_SQL = DENSITY.replace("{src}", "(SELECT * FROM merge_v WHERE CAST(task_id AS BIGINT) % 7 <> 0 AND type <> 'crash') m")
OLD_EVENTS = "(SELECT * FROM merge_v WHERE CAST(task_id AS BIGINT) % 7 <> 0 AND type <> 'crash')"
RAW_LINES = f"(SELECT task_id, line_no, {FAILED_TEXT} AS text FROM lines_v)"
FIRST = " OR ".join(f"contains(text, '{w}')" for w in B.FIRST_ERROR_WORDS)
WORDS = " OR ".join(f"contains(lower(text), '{w}')" for w in B.ERROR_WORDS)


def full_report_sql(events, accuracy):
    """The report with lines; `accuracy` has fixture, accuracy."""
    return f"""SELECT d.*, a.accuracy, fields::DOUBLE / events AS fields_per_event, raw_lines, unparsed,
  CASE WHEN event_seq IS NOT NULL THEN coalesce(event_seq < raw_line, true) END AS faster
FROM ({DENSITY.replace('{src}', f'{events} ev')}) d LEFT JOIN ({accuracy}) a ON a.fixture = d.fixture
JOIN (SELECT task_id, count(*) FILTER (WHERE trim(text) <> '') AS raw_lines, min(line_no) FILTER (WHERE {FIRST}) AS raw_line,
    count(*) FILTER (WHERE ({WORDS}) AND NOT EXISTS (SELECT 1 FROM {events} p WHERE p.type <> 'log' AND p.task_id = l.task_id AND p.seq = l.line_no)) AS unparsed
  FROM {RAW_LINES} l GROUP BY 1) w ON w.task_id = d.fixture
LEFT JOIN (SELECT task_id, min(seq) AS event_seq FROM {events} f WHERE severity IN ('error', 'warning') GROUP BY 1) e ON e.task_id = d.fixture"""


FULL_SQL = full_report_sql("merge_v", f"SELECT fixture, CASE WHEN n_expected > 0 THEN matched::DOUBLE / n_expected ELSE 1.0 END AS accuracy FROM ({FIXTURE_SQL}) x")
FULL_OLD_SQL = full_report_sql(OLD_EVENTS, "SELECT DISTINCT task_id AS fixture, 1.0::DOUBLE AS accuracy FROM merge_v")
PCT = "count(*) FILTER (WHERE {t}faster) * 100.0::DOUBLE / nullif(count({t}faster), 0)"
DIFF_SQL = f"""WITH fresh AS ({FULL_SQL}), n AS (SELECT * FROM fresh WHERE CAST(fixture AS BIGINT) % 11 <> 0), o AS ({FULL_OLD_SQL}),
  of_all AS (SELECT avg(accuracy) AS accuracy, {PCT.format(t='')} AS pct, sum(unparsed) AS unparsed, sum(diagnostic_events) AS diagnostics FROM n),
  of_old AS (SELECT avg(accuracy) AS accuracy, {PCT.format(t='')} AS pct, sum(unparsed) AS unparsed, sum(diagnostic_events) AS diagnostics FROM o)
SELECT coalesce(n.fixture, o.fixture) AS fixture, CASE WHEN o.fixture IS NULL THEN 'added' WHEN n.fixture IS NULL THEN 'removed' ELSE 'both' END AS change,
  n.accuracy - o.accuracy AS accuracy_delta, n.faster::INT * 100.0::DOUBLE - o.faster::INT * 100.0::DOUBLE AS advantage_delta,
  CAST(n.unparsed - o.unparsed AS BIGINT) AS unparsed_delta, CAST(n.diagnostic_events - o.diagnostic_events AS BIGINT) AS diagnostics_delta
FROM n FULL JOIN o ON n.fixture = o.fixture
UNION ALL SELECT NULL, 'total', a.accuracy - b.accuracy, a.pct - b.pct, CAST(a.unparsed - b.unparsed AS BIGINT), CAST(a.diagnostics - b.diagnostics AS BIGINT)
FROM of_all a, of_old b"""

RUNS = f"""(SELECT conv_id || '-' || turn AS task_id, conv_id, turn, text, {MESSAGE} AS last_message FROM conversations)"""
FIRST_LINE = "trim(split_part(text, chr(10), 1))"
DIAGNOSE_SQL = f"""
SELECT task_id, exit_ok, code_ok, msg_ok, loc_ok, exit_ok AND code_ok AND msg_ok AND loc_ok AND ran AS success, loc_ok AND msg_ok AS primary_hit
FROM (SELECT task_id, conv_id % 5 <> 0 AS ran,
    conv_id % 4 = 0 OR turn % 3 = turn % 2 OR contains(blob, CAST(turn % 2 AS STRING)) AS exit_ok,
    contains(CAST(turn % 3 AS STRING), 'e' || (conv_id % 5)) OR contains(blob, 'e' || (conv_id % 5)) AS code_ok,
    contains(lower(blob), 'the') OR contains(lower(blob), 'zzz') AS msg_ok,
    turn = 0 OR contains(blob, 'src/a.rs:1') OR contains('src/a.rs:' || turn, '1') AS loc_ok
  FROM (SELECT *, last_message || chr(10) || '[]' AS blob FROM {RUNS} r) b) c
"""
AGENT = """(SELECT CAST(conv_id AS STRING) AS task_id, CASE WHEN conv_id % 2 = 0 THEN 'tool' ELSE 'shell' END AS mode, turn AS pos,
  role = 'assistant' OR conv_id % 4 = 0 AS is_tool, role || CAST(turn % 2 AS STRING) AS command, length(text) AS tokens FROM conversations)"""
RETRY_SQL = f"SELECT task_id, mode, count(*) - count(DISTINCT command) AS retries FROM {AGENT} a GROUP BY 1, 2"
PATH_SQL = f"""SELECT task_id, mode, count(*) AS tool_rounds, count(*) FILTER (WHERE is_tool) AS tool_calls, count(*) FILTER (WHERE NOT is_tool) AS shell_calls,
  CASE WHEN mode = 'tool' THEN count(*) FILTER (WHERE is_tool) > 0 AND count(*) FILTER (WHERE NOT is_tool) = 0
    ELSE count(*) FILTER (WHERE is_tool) = 0 AND (count(*) FILTER (WHERE NOT is_tool) > 0 OR max(pos) % 2 = 0) END AS path_compliance
FROM {AGENT} a GROUP BY 1, 2"""
MODE_SQL = f"""SELECT p.mode, count(*) AS n, avg((t.top > 3)::INT) AS success_rate, avg((t.top > 1)::INT) AS primary_hit_rate,
  avg(path_compliance::INT) AS path_compliance_rate, sum(tool_rounds)::DOUBLE / count(*) AS avg_tool_rounds, sum(retries)::DOUBLE / count(*) AS avg_retries,
  CAST(sum(t.total) AS BIGINT) AS total_input_tokens, CAST(sum(t.most) AS BIGINT) AS total_output_tokens
FROM ({PATH_SQL}) p JOIN (SELECT task_id, max(pos) AS top, sum(tokens) AS total, max(tokens) AS most FROM {AGENT} a GROUP BY 1) t ON p.task_id = t.task_id
LEFT JOIN ({RETRY_SQL}) r ON r.task_id = p.task_id GROUP BY 1"""

M = ("merge_v",)
CASES = {
    "j7_match_expected": (match_expected, with_views(
        f"SELECT coalesce(e.task_id, a.task_id) AS fixture, coalesce(e.seq, a.seq) AS idx, e.severity AS want, a.severity AS got FROM {EXPECTED} e FULL JOIN merge_v a ON e.task_id = a.task_id AND e.seq = a.seq", *M)),
    "b1_score_fixtures": (score_fixtures, with_views(FIXTURE_SQL, *M)),
    "b2_field_rates": (field_rates, with_views(RATES_SQL, *M)),
    "b3_first_error_advantage": (first_error_advantage, with_views(f"""
        SELECT coalesce(s.task_id, r.task_id) AS task_id, raw_line, event_seq, CASE WHEN event_seq IS NOT NULL THEN coalesce(event_seq < raw_line, true) END AS faster
        FROM (SELECT task_id, min(seq) AS event_seq FROM merge_v WHERE severity IN ('error', 'warning') GROUP BY 1) s
        FULL JOIN (SELECT task_id, min(line_no) AS raw_line FROM lines_v WHERE {FIRST} GROUP BY 1) r ON s.task_id = r.task_id""", "merge_v", "lines_v")),
    "b4_unparsed_error_lines": (unparsed_error_lines, with_views(f"""
        SELECT l.task_id, count(*) AS unparsed FROM {RAW_LINES} l JOIN merge_v m ON m.task_id = l.task_id AND m.seq = l.line_no
        WHERE ({WORDS}) AND m.type = 'log' GROUP BY 1""", "merge_v", "lines_v")),
    "b5_benchmark_report": (benchmark_report, with_views(REPORT_SQL, *M)),
    "b5_benchmark_totals": (benchmark_totals, with_views(
        f"SELECT count(*) AS fixtures, CAST(sum(events) AS BIGINT) AS events, avg(accuracy) AS avg_accuracy, sum(fields)::DOUBLE / sum(events) AS fields_per_event, CAST(sum(diagnostic_events) AS BIGINT) AS diagnostic_events FROM ({REPORT_SQL}) r", *M)),
    "b6_compare_reports": (compare_reports, with_views(
        f"SELECT r.fixture, CASE WHEN o.fixture IS NOT NULL THEN r.accuracy - 1.0 END AS accuracy_delta, r.diagnostic_events - o.diagnostic_events AS diagnostics_delta FROM ({REPORT_SQL}) r LEFT JOIN ({OLD_SQL}) o ON o.fixture = r.fixture", *M)),
    "b5_report_with_lines": (full_report, with_views(FULL_SQL, "merge_v", "lines_v")),
    "b5_line_totals": (line_totals, with_views(f"""
        SELECT CAST(sum(raw_lines) AS BIGINT) AS raw_lines, coalesce({PCT.format(t='')}, 0) AS error_speed_advantage_pct,
          CAST(sum(unparsed) AS BIGINT) AS unparsed_error_lines, CAST(sum(with_location) AS BIGINT) AS with_location,
          CAST(sum(with_code) AS BIGINT) AS with_code FROM ({FULL_SQL}) r""", "merge_v", "lines_v")),
    "b6_diff_reports": (diff_reports, with_views(DIFF_SQL, "merge_v", "lines_v")),
    "b7_extract_report": (extract_report, f"""
        SELECT task_id, CAST(turn % 3 AS STRING) AS report_exit_code, CAST(turn % 3 AS STRING) AS report_code,
          {FIRST_LINE} AS report_message, 'src/a.rs:' || CAST(turn AS STRING) AS report_location,
          CASE WHEN turn % 2 = 0 THEN 'pass' END AS claimed_status FROM {RUNS} r"""),
    "b8_score_diagnose": (score_diagnose, DIAGNOSE_SQL),
    "b9_score_fix": (score_fix, f"""
        SELECT task_id, CASE WHEN turn % 2 = 0 THEN 'pass' END AS claimed_status, conv_id % 3 = 0 AS success FROM {RUNS} r"""),
    "b10_count_retries": (lambda spark, sf: B.count_retries(agent_events(spark, sf)), RETRY_SQL),
    "b11_path_compliance": (path_compliance, PATH_SQL),
    "b12_mode_summary": (mode_summary, MODE_SQL),
}
