"""A: aggregates over tasks and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.views import view, with_views
from tracemill.operators import analytics, stats as S

PURPOSE_RULES = [("command", r"^cargo ", "build"), ("cwd", r"7$", "seven"), ("command", r"grep", "search")]


def on_tasks(op):
    return lambda spark, sf: op(view(spark, sf, "tasks_v"))


def on_both(op):
    return lambda spark, sf: op(view(spark, sf, "tasks_v"), view(spark, sf, "events_v"))


def on_events(op):
    return lambda spark, sf: op(view(spark, sf, "events_v"))


def backfill_purpose(spark, sf):
    filled = S.backfill_purpose(view(spark, sf, "tasks_v"), PURPOSE_RULES)
    return filled.select("task_id", "purpose")


def repair_tasks(spark, sf):
    """Tasks packed into one busy day, so that streaks close within the window."""
    tasks = view(spark, sf, "tasks_v")
    return tasks.withColumn("cwd", F.concat(F.lit("/w/"), F.col("task_id").cast("long") % 40)).withColumn(
        "started_at", F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, cast(task_id as bigint) div 40 % 4000, 0)")
    )


def repair_loops(spark, sf):
    return analytics.repair_loops(repair_tasks(spark, sf)).drop("opened", "closed")


def repair_loop_stats(spark, sf):
    return S.repair_loop_stats(analytics.repair_loops(repair_tasks(spark, sf)))


FAILED = "status IN ('failed', 'timeout')"
PURPOSE_SQL = f"""SELECT coalesce(purpose, 'real') AS purpose, count(*) AS total, count(*) FILTER (WHERE {FAILED}) AS failed,
  count(*) FILTER (WHERE {FAILED}) * 100.0::DOUBLE / count(*) AS failure_rate_pct,
  sum(duration_ms)::DOUBLE / nullif(count(duration_ms), 0) AS avg_duration_ms FROM tasks_v GROUP BY 1"""
TOTALS_SQL = "SELECT count(*) AS total_tasks, " + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS {c}" for c in S.TOTALS) + " FROM tasks_v"
STATUS_SQL = "SELECT " + ", ".join(
    f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in S.STATUSES) + " FROM tasks_v"
DURATION_SQL = """SELECT avg(duration_ms) AS avg_duration_ms, d[50 * (len(d) - 1) // 100 + 1] AS p50_duration_ms,
  d[99 * (len(d) - 1) // 100 + 1] AS p99_duration_ms
FROM tasks_v, (SELECT list(duration_ms ORDER BY duration_ms) AS d FROM tasks_v WHERE duration_ms IS NOT NULL) l GROUP BY d"""
RATE_SQL = f"SELECT count(*) FILTER (WHERE {FAILED})::DOUBLE / count(*) AS failure_rate_frac FROM tasks_v"
USAGE_SQL = """SELECT parser_name AS parser, count(*) AS count FROM tasks_v WHERE parser_name IS NOT NULL
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""
COVERAGE_SQL = "SELECT sum(visible_events) * 100.0::DOUBLE / sum(events_count) AS parser_coverage_pct FROM tasks_v"
EFFICIENCY_SQL = f"""SELECT least(greatest(raw_output_bytes - structured_events_bytes, 0) * 100.0::DOUBLE / raw_output_bytes, 100.0::DOUBLE) AS content_convergence_pct,
  skipped_noise_events * 100.0::DOUBLE / (visible_events + skipped_noise_events) AS noise_filter_pct,
  CAST(NULL AS DOUBLE) AS diagnostic_completeness_pct,
  dedup_collapsed * 100.0::DOUBLE / (visible_events + skipped_noise_events + dedup_collapsed) AS dedup_reduction_pct
FROM ({TOTALS_SQL}) t"""
SPAN = "greatest(max(CAST(started_at AS DATE)) - min(CAST(started_at AS DATE)), 1)"
SUMMARY_SQL = f"""SELECT t.total_tasks, e.total_events, e.total_errors, CAST(t.span AS BIGINT) AS date_range_days,
  t.total_tasks::DOUBLE / t.span AS avg_tasks_per_day
FROM (SELECT count(*) AS total_tasks, {SPAN} AS span FROM tasks_v) t,
  (SELECT count(*) AS total_events, count(*) FILTER (WHERE severity = 'error') AS total_errors FROM events_v) e"""
TEMPORAL_SQL = f"""SELECT t.first_date, t.last_date, CAST(t.span AS BIGINT) AS span_days,
  t.n::DOUBLE / t.span AS avg_tasks_per_day, e.n::DOUBLE / t.span AS avg_events_per_day
FROM (SELECT count(*) AS n, min(CAST(started_at AS DATE)) AS first_date, max(CAST(started_at AS DATE)) AS last_date,
  {SPAN} AS span FROM tasks_v) t, (SELECT count(*) AS n FROM events_v) e"""
DENSITY_SQL = """SELECT sum(3 + (severity IS NOT NULL)::INT + (file IS NOT NULL)::INT + (code IS NOT NULL)::INT)::DOUBLE / count(*) AS avg_fields_per_event,
  count(file) AS events_with_location, count(code) AS events_with_code,
  count(*) FILTER (WHERE file IS NOT NULL OR code IS NOT NULL)::DOUBLE / count(*) * 100 AS structured_event_pct FROM events_v"""
COMMANDS_SQL = """SELECT count(DISTINCT command) AS unique_commands, count(*) FILTER (WHERE carrier = 'shell') AS shell,
  count(*) FILTER (WHERE carrier = 'shell_composite') AS shell_composite, count(*) FILTER (WHERE carrier = 'python') AS python,
  CAST(0 AS BIGINT) AS script_other, CAST(0 AS BIGINT) AS unknown FROM tasks_v"""


def tidy(sql, section, columns, label=None):
    """(section, metric, value) rows of a SQL report."""
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, " + (f"{label} || '.{c}'" if label else f"'{c}'")
        + f" AS metric, CAST({'(' + c + ' - DATE ' + chr(39) + '1970-01-01' + chr(39) + ')' if c.endswith('_date') else c} AS DOUBLE) AS value FROM ({sql}) r"
        for c in columns
    )


IMPACT_SQL = " UNION ALL ".join([
    tidy(SUMMARY_SQL, "summary", ["total_tasks", "total_events", "total_errors", "date_range_days", "avg_tasks_per_day"]),
    tidy(DENSITY_SQL, "density", ["avg_fields_per_event", "events_with_location", "events_with_code", "structured_event_pct"]),
    tidy(COMMANDS_SQL, "commands", ["unique_commands", "shell", "shell_composite", "python", "script_other", "unknown"]),
    tidy(TEMPORAL_SQL, "temporal", ["first_date", "last_date", "span_days", "avg_tasks_per_day", "avg_events_per_day"]),
])
STATS_SQL = " UNION ALL ".join([
    tidy(TOTALS_SQL, "totals", ["total_tasks", *S.TOTALS]), tidy(STATUS_SQL, "status", S.STATUSES),
    tidy(PURPOSE_SQL, "purpose", ["total", "failed", "failure_rate_pct", "avg_duration_ms"], "purpose"),
    tidy(DURATION_SQL, "duration", ["avg_duration_ms", "p50_duration_ms", "p99_duration_ms"]),
    tidy(RATE_SQL, "failure", ["failure_rate_frac"]), tidy(USAGE_SQL, "parser", ["count"], "parser"),
    tidy(COVERAGE_SQL, "coverage", ["parser_coverage_pct"]),
    tidy(EFFICIENCY_SQL, "efficiency", ["content_convergence_pct", "noise_filter_pct", "diagnostic_completeness_pct", "dedup_reduction_pct"]),
])
METRICS_SQL = """SELECT task_id, count(*) AS events_count, count(*) FILTER (WHERE severity = 'error') AS error_count,
  count(*) FILTER (WHERE type = 'log') AS skipped_noise_events, count(*) FILTER (WHERE type <> 'log') AS visible_events,
  count(file) AS locations_extracted, count(code) AS codes_extracted FROM events_v GROUP BY 1"""

# streaks found by a recursive scan per directory: state 0 = closed, else position of the opener
LOOPS_SQL = """WITH RECURSIVE t AS (
  SELECT '/w/' || CAST(CAST(task_id AS BIGINT) % 40 AS STRING) AS cwd,
    (CAST(task_id AS BIGINT) // 40 % 4000) * 60000 AS ms, error_count > 0 AS err,
    status = 'completed' AND exit_code = 0 AS suc,
    row_number() OVER (PARTITION BY CAST(task_id AS BIGINT) % 40 ORDER BY CAST(task_id AS BIGINT) // 40 % 4000, task_id) AS pos
  FROM tasks_v WHERE purpose IS NULL),
walk AS (
  SELECT cwd, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS opener, CAST(0 AS BIGINT) AS opened_ms, CAST(NULL AS BIGINT) AS retries, CAST(NULL AS BIGINT) AS duration_ms
  FROM (SELECT DISTINCT cwd FROM t) d
  UNION ALL
  SELECT t.cwd, t.pos, CASE WHEN w.opener > 0 AND t.suc THEN 0 WHEN w.opener = 0 AND t.err THEN t.pos ELSE w.opener END,
    CASE WHEN w.opener = 0 AND t.err THEN t.ms ELSE w.opened_ms END,
    CASE WHEN w.opener > 0 AND t.suc THEN t.pos - w.opener END,
    CASE WHEN w.opener > 0 AND t.suc THEN t.ms - w.opened_ms END
  FROM walk w JOIN t ON t.cwd = w.cwd AND t.pos = w.pos + 1)
"""
LOOP_ROWS = "SELECT cwd, retries, duration_ms FROM walk WHERE retries <= 5 AND duration_ms <= 1800000"
LOOP_STATS = f"""SELECT count(*) AS fix_loops, coalesce(sum(retries)::DOUBLE / nullif(count(*), 0), 0) AS avg_retries_to_fix,
  CAST(coalesce(round(sum(duration_ms)::DOUBLE / nullif(count(*), 0)), 0) AS BIGINT) AS avg_fix_duration_ms,
  coalesce(min(duration_ms), 0) AS fastest_fix_ms FROM ({LOOP_ROWS}) l"""

T, E = ("tasks_v",), ("events_v",)
CASES = {
    "a1_status_counts": (on_tasks(S.status_counts), with_views(STATUS_SQL, *T)),
    "a2_purpose_breakdown": (on_tasks(S.purpose_breakdown), with_views(PURPOSE_SQL, *T)),
    "a3_real_vs_test": (on_tasks(S.real_vs_test), with_views(
        f"""SELECT CASE purpose WHEN 'real' THEN 'real' ELSE 'test' END AS kind, CAST(sum(total) AS BIGINT) AS total,
          CAST(sum(failed) AS BIGINT) AS failed, avg(avg_duration_ms) AS avg_duration_ms,
          sum(failed) * 100.0::DOUBLE / sum(total) AS failure_rate_pct FROM ({PURPOSE_SQL}) p GROUP BY 1""", *T)),
    "a4_totals": (on_tasks(S.totals), with_views(TOTALS_SQL, *T)),
    "a6_duration_stats": (on_tasks(S.duration_stats), with_views(DURATION_SQL, *T)),
    "a7_failure_rate": (on_tasks(S.failure_rate), with_views(RATE_SQL, *T)),
    "a8_parser_usage": (on_tasks(S.parser_usage), with_views(USAGE_SQL, *T)),
    "a9_parser_coverage": (on_both(S.parser_coverage), with_views(COVERAGE_SQL, *T)),
    "a10_task_metrics": (lambda spark, sf: S.task_metrics(view(spark, sf, "events_v")).drop("structured_events_bytes"),
                         with_views(METRICS_SQL, *E)),
    "a11_efficiency_report": (on_tasks(S.efficiency_report), with_views(EFFICIENCY_SQL, *T)),
    "a13_impact_summary": (on_both(S.impact_summary), with_views(SUMMARY_SQL, *T, *E)),
    "a14_span_days": (on_tasks(S.span_days), with_views(f"SELECT CAST({SPAN} AS BIGINT) AS span_days FROM tasks_v", *T)),
    "a15_information_density": (on_events(S.information_density), with_views(DENSITY_SQL, *E)),
    "a16_command_patterns": (on_tasks(S.command_patterns), with_views(COMMANDS_SQL, *T)),
    "a17_temporal_metrics": (on_both(S.temporal_metrics), with_views(TEMPORAL_SQL, *T, *E)),
    "a18_impact_report": (on_both(S.impact_report), with_views(IMPACT_SQL, *T, *E)),
    "a19_stats_report": (on_both(S.stats_report), with_views(STATS_SQL, *T)),
    "a20_health": (on_tasks(S.health), with_views(
        "SELECT count(*) FILTER (WHERE status = 'running') AS running, count(*) AS total, CAST(0 AS BIGINT) AS corrupt FROM tasks_v", *T)),
    "w9_repair_loops": (repair_loops, with_views(LOOPS_SQL + LOOP_ROWS, *T)),
    "a21_repair_loop_stats": (repair_loop_stats, with_views(LOOPS_SQL + LOOP_STATS, *T)),
    "a22_ecosystem_table": (on_tasks(S.ecosystem_table), with_views(
        """SELECT coalesce(parser_name, 'raw') AS parser, status, count(*) AS tasks, """ + ", ".join(
            f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("events_count", "error_count", "raw_output_bytes", "structured_events_bytes"))
        + " FROM tasks_v GROUP BY 1, 2", *T)),
    "a23_backfill_purpose": (backfill_purpose, with_views(
        """SELECT task_id, coalesce(purpose, CASE WHEN command LIKE 'cargo %' THEN 'build' WHEN cwd LIKE '%7' THEN 'seven'
          WHEN contains(command, 'grep') THEN 'search' END) AS purpose FROM tasks_v""", *T)),
}
