"""Query surface: filters, paging, per-task selections and response texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip_text, duration_text, is_secondary_summary

DEFAULT_LIMIT = 20
TASK_LIMIT = 10
FAILED_SAMPLE, OTHER_SAMPLE = 20, 5
COMPACT_ROWS = 8
STATUS_ICONS = {"completed": "✓", "failed": "✗", "timeout": "⏱", "killed": "⏹", "running": "⟳"}


def event_filter(
    event_type: str | None = None, severity: str | None = None, code: str | None = None,
    file: str | None = None, include_logs: bool = False,
) -> Column:
    """Equality on type, severity and code; substring on file; logs only on request."""
    cond = F.lit(True)
    if not include_logs:
        cond = cond & (F.col("type") != "log")
    for name, value in (("type", event_type), ("severity", severity), ("code", code)):
        if value is not None:
            cond = cond & (F.col(name) == value)
    if file is not None:
        cond = cond & F.col("file").contains(file)
    return cond


def _page(df: DataFrame, limit: int, offset: int) -> DataFrame:
    return df.offset(offset).limit(limit)


def query_events(
    events: DataFrame, task_id: str, limit: int = DEFAULT_LIMIT, offset: int = 0, **params
) -> DataFrame:
    """One page of a task's matching events in seq order."""
    mine = events.filter((F.col("task_id") == task_id) & event_filter(**params))
    return _page(mine.orderBy("seq"), limit, offset)


def event_summary(events: DataFrame, task_id: str | None = None, **params) -> DataFrame:
    """Total, errors and warnings of the matching events, before paging."""
    mine = events.filter(event_filter(**params))
    if task_id is not None:
        mine = mine.filter(F.col("task_id") == task_id)
    return mine.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def search_events(
    events: DataFrame, tasks: DataFrame, limit: int = DEFAULT_LIMIT, offset: int = 0, **params
) -> DataFrame:
    """One page of matching events over all tasks, newest task first."""
    found = events.filter(event_filter(**params)).join(
        tasks.select("task_id", "started_at"), "task_id"
    )
    return _page(found.orderBy(F.desc("started_at"), "task_id", "seq"), limit, offset)


def list_tasks(tasks: DataFrame, status: str | None = None, limit: int = TASK_LIMIT) -> DataFrame:
    if status is not None:
        tasks = tasks.filter(F.col("status") == status.strip('"'))
    return tasks.orderBy(F.desc("started_at"), "task_id").limit(limit)


def get_tasks(tasks: DataFrame, ids) -> DataFrame:
    return tasks.filter(F.col("task_id").isin(list(ids)))


def tail_raw(lines: DataFrame, n: int) -> DataFrame:
    """Last n lines of every task; 0 means all."""
    return _last(lines, "line_no", n)


def tail_events(events: DataFrame, n: int) -> DataFrame:
    """Last n events of every task, logs included."""
    return _last(events, "seq", n)


def _last(df: DataFrame, position: str, n: int) -> DataFrame:
    if n == 0:
        return df
    newest = Window.partitionBy("task_id").orderBy(F.desc(position))
    return df.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= n).drop("_n")


def _first(events: DataFrame, n: int) -> DataFrame:
    """First n events of every task; Spark drops the rest before the shuffle."""
    oldest = Window.partitionBy("task_id").orderBy("seq")
    return events.withColumn("_n", F.row_number().over(oldest)).filter(F.col("_n") <= n).drop("_n")


def inline_events(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sample per task: the first 20 errors of a failed task, else its first 5 non-log events.

    Both samples are cut down before the join, so a task with very many events brings no more
    than 25 of them to it.
    """
    visible = events.filter(F.col("type") != "log")
    errors = _first(visible.filter(F.col("severity") == "error"), FAILED_SAMPLE)
    others = _first(visible, OTHER_SAMPLE)
    both = errors.withColumn("_of_failed", F.lit(True)).unionByName(
        others.withColumn("_of_failed", F.lit(False)))
    failed = F.coalesce(F.col("exit_code"), F.lit(0)) != 0
    flags = tasks.select("task_id", failed.alias("_of_failed"))
    return both.join(flags, ["task_id", "_of_failed"]).select(events.columns)


def response_counts(events: DataFrame) -> DataFrame:
    """Per task: visible events, and the errors and warnings among them."""
    return events.filter(F.col("type") != "log").groupBy("task_id").agg(
        F.count(F.lit(1)).alias("visible"),
        F.count_if(F.col("severity") == "error").alias("errors"),
        F.count_if(F.col("severity") == "warning").alias("warnings"),
    )


def truncation_flag(sample: DataFrame, counts: DataFrame) -> DataFrame:
    """Per task: shown and total events, and whether some are missing."""
    shown = sample.groupBy("task_id").agg(F.count(F.lit(1)).alias("shown"))
    joined = counts.select("task_id", F.col("visible").alias("total")).join(shown, "task_id", "left")
    shown = F.coalesce("shown", F.lit(0))
    return joined.select(
        "task_id", shown.alias("shown"), "total", (shown < F.col("total")).alias("truncated"),
        F.when(shown < F.col("total"),
               F.format_string("Showing %d/%d events", shown, F.col("total"))).alias("hint"),
    )


def primary_diagnostic(events: DataFrame) -> DataFrame:
    """Per task the first error; behind a traceback banner the last error diagnostic."""
    fields = F.struct("seq", "type", "code", "message", "file", "line")
    errors = events.filter((F.col("severity") == "error") & (F.col("type") != "log"))
    picked = errors.groupBy("task_id").agg(
        F.min(fields).alias("_first"),
        F.max(F.when(F.col("type") == "diagnostic", fields)).alias("_last"),
    )
    banner = F.ltrim(F.col("_first.message")).startswith("Traceback (")
    return picked.select(
        "task_id", F.when(banner, F.coalesce("_last", "_first")).otherwise(F.col("_first")).alias("_p")
    ).select("task_id", "_p.*")


def format_diagnostic(code: Column, file: Column, line: Column, message: Column) -> Column:
    """`code file:line message`, whatever of it there is."""
    place = F.when(F.coalesce(file, F.lit("")) != "",
                   F.concat_ws(":", file, line.cast("string")))
    text = F.concat_ws(" ", F.nullif(code, F.lit("")), place, F.nullif(message, F.lit("")))
    return F.when(text == "", "diagnostic").otherwise(text)


def diagnostics_equal(a: str, b: str) -> Column:
    """Same code, file and line, and the same message unless one of them is empty."""
    def text(side, name):
        return F.coalesce(F.col(f"{side}.{name}"), F.lit(""))

    left, right = text(a, "message"), text(b, "message")
    return (
        (text(a, "code") == text(b, "code"))
        & (text(a, "file") == text(b, "file"))
        & F.col(f"{a}.line").eqNullSafe(F.col(f"{b}.line"))
        & ((left == right) | (left == "") | (right == ""))
    )


def top_event_lines(events: DataFrame, n: int = COMPACT_ROWS) -> DataFrame:
    """Per task the first n error or warning events as `file:line: message` lines."""
    wanted = events.filter(F.col("severity").isin("error", "warning"))
    oldest = Window.partitionBy("task_id").orderBy("seq")
    place = F.when(F.col("file").isNotNull() & (F.col("file") != ""),
                   F.concat_ws(":", "file", F.col("line").cast("string")))
    return (
        wanted.withColumn("position", F.row_number().over(oldest))
        .filter(F.col("position") <= n)
        .select("task_id", "position", F.concat_ws(": ", place, "message").alias("text"))
    )


def outcome_flags(tasks: DataFrame) -> DataFrame:
    """`is_failure` of the command, and `is_tool_error` for callers."""
    code = F.coalesce(F.col("exit_code"), F.lit(0))
    return tasks.withColumns(
        {
            "is_failure": F.col("status").isin("failed", "timeout") | (code != 0),
            "is_tool_error": (F.col("status") == "timeout") | ~code.isin(0, 1)
            | (F.col("error_count") > 0),
        }
    )


def final_status(killed: Column, timed_out: Column, exit_code: Column) -> Column:
    """Struct (status, exit_code) of a finished command."""
    code = exit_code.cast("int")
    return F.struct(
        F.when(killed, "killed").when(timed_out, "timeout")
        .when(F.coalesce(code == 0, F.lit(False)), "completed").otherwise("failed").alias("status"),
        F.when(killed, F.lit(-3)).when(timed_out, F.lit(-2))
        .otherwise(F.coalesce(code, F.lit(-1))).alias("exit_code"),
    )


def one_line_summary(tasks: DataFrame, primary: DataFrame) -> DataFrame:
    """`✗ 2 errors, 10.5s (exit 1)` plus the primary diagnostic on a second line."""
    icons = F.create_map(*[F.lit(x) for item in STATUS_ICONS.items() for x in item])
    joined = tasks.join(primary.select("task_id", F.col("message").alias("_why")), "task_id", "left")
    code = F.col("exit_code")
    return joined.select(
        "task_id",
        F.concat(
            F.coalesce(F.try_element_at(icons, F.col("status")), F.lit("?")), F.lit(" "),
            F.col("error_count").cast("string"),
            F.when(F.col("error_count") == 1, " error").otherwise(" errors"),
            F.when(F.col("duration_ms").isNotNull(),
                   F.concat(F.lit(", "), duration_text(F.col("duration_ms")))).otherwise(""),
            F.when(code != 0, F.concat(F.lit(" (exit "), code.cast("string"), F.lit(")"))).otherwise(""),
            F.when(F.col("_why") != "", F.concat(F.lit("\nPrimary diagnostic: "), "_why")).otherwise(""),
        ).alias("summary"),
    )


def compact_summary(sample: DataFrame, tasks: DataFrame, primary: DataFrame) -> DataFrame:
    """Per failed task: status line, primary diagnostic, then further errors and warnings.

    `sample` is the inline sample (at most 20 events per task), so the lists are short.
    """
    return _compact(sample, tasks, primary).drop("has_events")


def _compact(sample: DataFrame, tasks: DataFrame, primary: DataFrame) -> DataFrame:
    fields = ["code", "file", "line", "message"]
    ranked = sample.select("task_id", F.struct("seq", "severity", *fields).alias("e"))
    grouped = ranked.groupBy("task_id").agg(F.array_sort(F.collect_list("e")).alias("events"))
    failed = outcome_flags(tasks).filter("is_failure").select("task_id", "status", "exit_code")
    rows = failed.join(grouped, "task_id", "left").join(
        primary.select("task_id", F.struct(*fields).alias("p")), "task_id", "left"
    )

    def text(event):
        return format_diagnostic(event["code"], event["file"], event["line"], event["message"])

    def same(event):
        blank = F.lit("")
        left, right = F.coalesce(event["message"], blank), F.coalesce(F.col("p.message"), blank)
        return (
            F.coalesce(event["code"], blank).eqNullSafe(F.coalesce("p.code", blank))
            & F.coalesce(event["file"], blank).eqNullSafe(F.coalesce("p.file", blank))
            & event["line"].eqNullSafe(F.col("p.line"))
            & ((left == right) | (left == "") | (right == ""))
        )

    more = F.filter(
        F.coalesce("events", F.array()),
        lambda e: e["severity"].isin("error", "warning")
        & ~is_secondary_summary(e["message"])
        & ~(F.col("p").isNotNull() & same(e)),
    )
    room = F.when(F.col("p").isNotNull(), COMPACT_ROWS - 1).otherwise(COMPACT_ROWS)
    lead = F.when(F.col("p").isNotNull(), F.array(text(F.col("p")))).otherwise(F.array())
    lines = F.concat(lead, F.transform(F.slice(more, F.lit(1), room), text))
    fallback = F.filter(
        F.transform(F.slice(F.coalesce("events", F.array()), 1, COMPACT_ROWS), lambda e: e["message"]),
        lambda m: m != "",
    )
    rows = rows.withColumn("_lines", lines).withColumn(
        "_lines", F.when(F.size("_lines") > 0, F.col("_lines")).otherwise(fallback)
    )
    head = F.concat(
        F.col("status"),
        F.when(F.col("exit_code").isNotNull(),
               F.concat(F.lit(" (exit "), F.col("exit_code").cast("string"), F.lit(")"))).otherwise(""),
    )
    return rows.select(
        "task_id", F.array_join(F.concat(F.array(head), "_lines"), "\n").alias("text"),
        F.size("_lines").cast("long").alias("inlined"),
        F.col("events").isNotNull().alias("has_events"),
    )


def response_view(tasks: DataFrame, events: DataFrame, raw: DataFrame) -> DataFrame:
    """What a caller sees of each run: compact diagnostics, else clipped output, else a label.

    `raw` has one captured output per task (task_id, raw_output).
    """
    compact = _compact(inline_events(events, tasks), tasks, primary_diagnostic(events)).select(
        "task_id", F.col("text").alias("_compact"), F.col("has_events").alias("_some"))
    counts = response_counts(events).select("task_id", "visible")
    rows = (
        outcome_flags(tasks)
        .join(compact, "task_id", "left").join(counts, "task_id", "left")
        .join(raw.select("task_id", "raw_output"), "task_id", "left")
        .withColumn("_clip", clip_text(F.coalesce("raw_output", F.lit(""))))
    )
    structured = F.col("is_failure") & F.coalesce("_some", F.lit(False))
    has_raw = F.coalesce("raw_output", F.lit("")) != ""
    used_raw = ~structured & has_raw
    label = F.concat(F.lit("[command failed: exit code "),
                     F.coalesce(F.col("exit_code").cast("string"), F.lit("unknown")), F.lit("]"))
    text = (
        F.when(structured, F.col("_compact"))
        .when(has_raw, F.concat(
            F.col("_clip.text"),
            F.when(F.col("_clip.clipped"),
                   F.format_string("\n[output clipped: %d bytes omitted]", "_clip.omitted_bytes"))
            .otherwise("")))
        .when(F.col("is_failure"), label)
        .when(F.col("status") == "running", "").otherwise("✓")
    )
    cut = F.col("_clip.clipped") | F.col("raw_output").contains("[output truncated at ") | F.col(
        "raw_output").contains("[line truncated at ")
    raw_truncated = used_raw & F.coalesce(cut, F.lit(False))
    visible = F.coalesce("visible", F.lit(0))
    incomplete = F.when(structured, visible > COMPACT_ROWS).otherwise(visible > 0)
    return rows.select(
        "task_id", "status", "exit_code", text.alias("text"), raw_truncated.alias("raw_truncated"),
        incomplete.alias("events_incomplete"),
        ((F.col("status") == "running") | incomplete | raw_truncated).alias("needs_handle"),
        "is_tool_error",
    )


