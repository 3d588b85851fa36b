"""Extraction quality against expected events, and scoring of agent benchmark runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import contains_any, java, let
from ..functions.text import trim
from .lookup import match_expected

# ---- fixed values -------------------------------------------------------------------
FIRST_ERROR_WORDS = ["error", "Error", "ERROR", "warning", "Warning", "WARNING", "panic", "fatal", "FAIL"]
ERROR_WORDS = ["error", "failed", "panic", "exception", "fatal", "fail"]
GATE = 0.95
REPORT_FIELDS = {
    "exit_code": r"(?i)EXIT_CODE:\s*(\S+)", "code": r"CODE:\s*(.+)",
    "message": r"MESSAGE:\s*(.+)", "location": r"LOCATION:\s*(.+)",
}
STATUS_LINE = r"(?im)^STATUS:\s*(pass|fail)\b"
GOOD_RUN_STATES = ["ok", "codex_nonzero"]
# -------------------------------------------------------------------------------------

FIELDS = {"type": "type", "sev": "severity", "code": "code", "message": "message", "file": "file", "line": "line"}


def score_events(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per position: which fields agree; a field the expectation leaves out agrees."""
    pairs = match_expected(actual, expected)
    there = F.col("e").isNotNull() & F.col("a").isNotNull()
    checks = {
        f"{name}_ok": there & (F.col(f"e.{col}").isNull() | F.coalesce(F.col(f"e.{col}") == F.col(f"a.{col}"), F.lit(False)))
        for name, col in FIELDS.items()
    }
    every = F.lit(True)
    for check in checks.values():
        every = every & check
    return pairs.select(
        "fixture", "idx", F.col("e").isNotNull().alias("is_expected"),
        F.col("a").isNotNull().alias("is_actual"),
        *[c.alias(n) for n, c in checks.items()], every.alias("matched"),
    )


def score_fixtures(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per fixture: counts, matches, and whether it passes the gate."""
    scored = score_events(actual, expected).groupBy("fixture").agg(
        F.count_if("is_expected").alias("n_expected"), F.count_if("is_actual").alias("n_actual"),
        F.count_if("matched").alias("matched"),
    )
    enough = F.col("matched") >= F.col("n_expected") * GATE
    return scored.withColumn("passed", (F.col("n_expected") == F.col("n_actual")) & enough)


def field_rates(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Per fixture: percent of expected events on which each field agrees."""
    n = F.nullif(F.count_if("is_expected"), F.lit(0))
    return score_events(actual, expected).groupBy("fixture").agg(
        *[(F.count_if(f"{name}_ok") * 100.0 / n).alias(f"{name}_pct") for name in FIELDS]
    ).filter(F.col("type_pct").isNotNull())


def first_error_advantage(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Per task: does the first error event come before the first error line of the raw text?"""
    raw = lines.filter(contains_any(F.col("text"), FIRST_ERROR_WORDS)).groupBy("task_id").agg(
        F.min("line_no").alias("raw_line"))
    structured = events.filter(F.col("severity").isin("error", "warning")).groupBy("task_id").agg(
        F.min("seq").alias("event_seq"))
    return structured.join(raw, "task_id", "full_outer").select(
        "task_id", "raw_line", "event_seq",
        F.when(F.col("event_seq").isNotNull(),
               F.coalesce(F.col("event_seq") < F.col("raw_line"), F.lit(True))).alias("faster"),
    )


def unparsed_error_lines(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Per task: lines with an error word of which only log events came (keyed by line_no)."""
    suspicious = lines.filter(
        let(F.lower("text"), lambda low: contains_any(low, ERROR_WORDS))
    ).select("task_id", "line_no")
    parsed = events.filter(F.col("type") != "log").select("task_id", "line_no")
    return suspicious.join(parsed, ["task_id", "line_no"], "left_anti").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("unparsed"))


def _density(events: DataFrame) -> list[Column]:
    extra = sum(F.count_if(F.col(c).isNotNull()) for c in ("severity", "code", "file"))
    n = F.count(F.lit(1))
    return [
        n.alias("events"), (2 * n + extra).alias("fields"),
        F.count_if(F.col("file").isNotNull()).alias("with_location"),
        F.count_if(F.col("code").isNotNull()).alias("with_code"),
        F.count_if(F.col("type") != "log").alias("diagnostic_events"),
    ]


def line_report(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Per task: lines that are not blank, whether its first error comes first as an event, error lines left unparsed."""
    raw = lines.groupBy("task_id").agg(F.count_if(trim(F.col("text")) != "").alias("raw_lines"))
    faster = first_error_advantage(lines, events).select("task_id", "faster")
    unparsed = unparsed_error_lines(lines, events.withColumn("line_no", F.col("seq")))
    return raw.join(faster, "task_id", "left").join(unparsed, "task_id", "left").withColumn(
        "unparsed", F.coalesce("unparsed", F.lit(0).cast("long")))


def benchmark_report(events: DataFrame, actual: DataFrame, expected: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """Per fixture: event density and accuracy; with the raw lines also raw_lines, faster and unparsed.

    Events with lines have the number of their line as `seq`.
    """
    density = events.groupBy(F.col("task_id").alias("fixture")).agg(*_density(events))
    scores = score_fixtures(actual, expected).select(
        "fixture", F.when(F.col("n_expected") > 0, F.col("matched") / F.col("n_expected"))
        .otherwise(F.lit(1.0)).alias("accuracy"))
    report = density.join(scores, "fixture", "left").withColumn(
        "fields_per_event", F.col("fields") / F.col("events"))
    if lines is None:
        return report
    return report.join(line_report(lines, events).withColumnRenamed("task_id", "fixture"), "fixture", "left")


def _advantage(of: Column) -> Column:
    """Percent of fixtures whose first error comes first as an event, of those that have one."""
    return F.count_if(of & F.col("faster")) * 100.0 / F.nullif(F.count_if(of & F.col("faster").isNotNull()), F.lit(0))


def benchmark_totals(report: DataFrame) -> DataFrame:
    """One row over all fixtures."""
    return report.agg(
        F.count(F.lit(1)).alias("fixtures"), F.sum("events").alias("events"),
        F.avg("accuracy").alias("avg_accuracy"),
        (F.sum("fields") / F.sum("events")).alias("fields_per_event"),
        F.sum("diagnostic_events").alias("diagnostic_events"),
    )


def benchmark_line_totals(report: DataFrame) -> DataFrame:
    """One row over all fixtures of a report with lines: what `benchmark_totals` leaves out."""
    return report.agg(
        F.sum("raw_lines").alias("raw_lines"), F.coalesce(_advantage(F.lit(True)), F.lit(0.0)).alias("error_speed_advantage_pct"),
        F.sum("unparsed").alias("unparsed_error_lines"), F.sum("with_location").alias("with_location"),
        F.sum("with_code").alias("with_code"))


def diff_reports(new: DataFrame, old: DataFrame) -> DataFrame:
    """Changes between two reports with lines: a row for each fixture of either, and one over all (fixture null).

    Both reports go through one aggregation with two grouping sets.  A fixture in one report only is `added` or
    `removed` and has no changes; the row over all is `total`, its accuracy an average over fixtures and its
    advantage a percentage.
    """
    names = ["fixture", "accuracy", "faster", "unparsed", "diagnostic_events"]
    both = new.select(*names, F.lit(True).alias("is_new")).unionByName(old.select(*names, F.lit(False).alias("is_new")))
    now, then = F.col("is_new"), ~F.col("is_new")

    def change(measure):
        return measure(now) - measure(then)

    sides = both.groupingSets([["fixture"], []], "fixture").agg(
        F.grouping("fixture").alias("_total"), F.bool_or(now).alias("_new"), F.bool_or(then).alias("_old"),
        change(lambda side: F.avg(F.when(side, F.col("accuracy")))).alias("accuracy_delta"),
        change(_advantage).alias("advantage_delta"),
        change(lambda side: F.sum(F.when(side, F.col("unparsed")))).alias("unparsed_delta"),
        change(lambda side: F.sum(F.when(side, F.col("diagnostic_events")))).alias("diagnostics_delta"),
    )
    kind = (F.when(F.col("_total") == 1, "total").when(~F.col("_old"), "added").when(~F.col("_new"), "removed").otherwise("both"))
    return sides.select("fixture", kind.alias("change"), "accuracy_delta", "advantage_delta", "unparsed_delta", "diagnostics_delta")


def compare_reports(new: DataFrame, old: DataFrame) -> DataFrame:
    """Per fixture of the new report: change of accuracy and diagnostics; null where it is new."""
    before = old.select("fixture", F.col("accuracy").alias("_accuracy"),
                        F.col("diagnostic_events").alias("_diagnostics"))
    return new.join(before, "fixture", "left").select(
        "fixture", (F.col("accuracy") - F.col("_accuracy")).alias("accuracy_delta"),
        (F.col("diagnostic_events") - F.col("_diagnostics")).alias("diagnostics_delta"),
    )


# ---- agent runs ---------------------------------------------------------------------


def report_field(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, java(REPORT_FIELDS[name]), 1)
    return F.when(text.rlike(java(REPORT_FIELDS[name])), trim(found))


def extract_report(runs: DataFrame) -> DataFrame:
    """Fields that a run's last message reports."""
    text = F.col("last_message")
    status = F.lower(F.regexp_extract(text, java(STATUS_LINE), 1))
    return runs.withColumns(
        {**{f"report_{n}": report_field(text, n) for n in REPORT_FIELDS},
         "claimed_status": F.nullif(status, F.lit(""))}
    )


def score_diagnose(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """Diagnose runs: exit code, code, message and location found.

    `expected` has exit_code, code, message_contains, location_file, location_line per
    task; what is null there is not asked for.  `tools` of a run is its tool log as text.
    """
    rows = extract_report(runs).join(
        expected.select("task_id", *[F.col(c).alias(f"want_{c}") for c in expected.columns if c != "task_id"]),
        "task_id", "left",
    ).withColumn("_blob", F.concat_ws("\n", "last_message", "tools"))
    blob, none = F.col("_blob"), F.lit("")
    code, file = F.col("want_code"), F.col("want_location_file")
    wanted_exit = F.col("want_exit_code").cast("string")
    exit_ok = wanted_exit.isNull() | F.col("report_exit_code").eqNullSafe(wanted_exit) | blob.contains(wanted_exit)
    code_ok = code.isNull() | (code == "") | F.lower(F.coalesce("report_code", none)).contains(F.lower(code)) | blob.contains(code)
    needles = F.coalesce("want_message_contains", F.array().cast("array<string>"))
    msg_ok = (F.size(needles) == 0) | F.exists(needles, lambda n: F.lower(blob).contains(F.lower(n)))
    line = F.col("want_location_line").cast("string")
    at = blob.contains(F.concat(file, F.lit(":"), line)) | F.coalesce("report_location", blob).contains(line)
    loc_ok = file.isNull() | (file == "") | (blob.contains(file) & (line.isNull() | at))
    checks = {"exit_ok": exit_ok, "code_ok": code_ok, "msg_ok": msg_ok, "loc_ok": loc_ok}
    scored = rows.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in checks.items()})
    ran = F.col("status").isNull() | F.col("status").isin(GOOD_RUN_STATES)
    return scored.withColumns(
        {"success": F.col("exit_ok") & F.col("code_ok") & F.col("msg_ok") & F.col("loc_ok") & ran,
         "primary_hit": F.col("loc_ok") & F.col("msg_ok")}
    ).drop("_blob", *[f"want_{c}" for c in expected.columns if c != "task_id"])


def score_fix(runs: DataFrame) -> DataFrame:
    """Fix runs succeed when the independent check passed, whatever the run claims."""
    passed = F.coalesce("verify_pass", F.lit(False))
    return extract_report(runs).withColumns({"success": passed, "primary_hit": passed})


RUN = ["task_id", "mode"]


def count_retries(agent_events: DataFrame) -> DataFrame:
    """Per run: commands run again word for word.  Equal commands are counted first."""
    command = F.coalesce("command", "arguments")
    per_command = agent_events.filter(command.isNotNull()).groupBy(*RUN, command.alias("_c")).agg(
        F.count(F.lit(1)).alias("_n"))
    return per_command.groupBy(*RUN).agg((F.sum("_n") - F.count(F.lit(1))).alias("retries"))


def path_compliance(agent_events: DataFrame, runs: DataFrame, server: str, tool_mode: str) -> DataFrame:
    """Per run: tool rounds, and whether it kept to the path of its mode.

    In `tool_mode` runs use the named server and no shell; other runs the reverse, where a
    fix may also do without any command.
    """
    is_tool = F.col("kind") == "mcp"
    counts = agent_events.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("tool_rounds"),
        F.count_if(is_tool & (F.col("server") == server)).alias("tool_calls"),
        F.count_if(F.col("kind") == "shell").alias("shell_calls"),
    )
    rows = runs.select(*RUN, F.col("kind").alias("_task_kind")).join(counts, RUN, "left").na.fill(
        0, ["tool_rounds", "tool_calls", "shell_calls"])
    kept = F.when(
        F.col("mode") == tool_mode, (F.col("tool_calls") > 0) & (F.col("shell_calls") == 0)
    ).otherwise((F.col("tool_calls") == 0) & ((F.col("shell_calls") > 0) | (F.col("_task_kind") == "fix")))
    return rows.withColumn("path_compliance", kept).drop("_task_kind")


def mode_summary(scored: DataFrame) -> DataFrame:
    """Per mode: runs, success, hit and compliance rates, average rounds, token sums."""
    rate = lambda c: F.avg(F.col(c).cast("int"))
    n = F.count(F.lit(1))
    return scored.groupBy("mode").agg(
        n.alias("n"), rate("success").alias("success_rate"), rate("primary_hit").alias("primary_hit_rate"),
        rate("path_compliance").alias("path_compliance_rate"),
        (F.sum("tool_rounds") / n).alias("avg_tool_rounds"), (F.sum("retries") / n).alias("avg_retries"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("total_output_tokens"),
    )
