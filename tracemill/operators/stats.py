"""Aggregates over tasks and events.

Every aggregate combines on the map side.  Reports are unions of (section, metric, value)
rows, so no one-row tables are joined.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import STATUSES

REPAIR_MAX_RETRIES = 5
REPAIR_MAX_SECONDS = 30 * 60
DURATION_BUCKET_MS = 65_536
PERCENTILES = (50, 99)
TOP_PARSERS = 10
CARRIERS = ["shell", "shell_composite", "python", "script_other"]


def _failed() -> Column:
    return F.col("status").isin("failed", "timeout")


def _count(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _pct(part: Column, whole: Column) -> Column:
    return part * F.lit(100.0) / F.nullif(whole, F.lit(0))


def _merge_rows(frames: Sequence[DataFrame], *columns: Column) -> DataFrame:
    """One row out of several one-row frames: union, then aggregate."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).agg(*columns)


def status_counts(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def purpose_breakdown(tasks: DataFrame) -> DataFrame:
    """Per purpose (untagged = `real`): total, failed, failure percent, average duration."""
    return (
        tasks.groupBy(F.coalesce("purpose", F.lit("real")).alias("purpose"))
        .agg(
            _count("total"), F.count_if(_failed()).alias("failed"),
            F.sum("duration_ms").alias("_ms"), F.count("duration_ms").alias("_timed"),
        )
        .select(
            "purpose", "total", "failed",
            _pct(F.col("failed"), F.col("total")).alias("failure_rate_pct"),
            (F.col("_ms") / F.nullif(F.col("_timed"), F.lit(0))).alias("avg_duration_ms"),
        )
    )


def real_vs_test(tasks: DataFrame) -> DataFrame:
    """Real work against tagged test work; a group's average is the mean over its purposes."""
    kind = F.when(F.col("purpose") == "real", "real").otherwise("test")
    return (
        purpose_breakdown(tasks).groupBy(kind.alias("kind"))
        .agg(F.sum("total").alias("total"), F.sum("failed").alias("failed"),
             F.avg("avg_duration_ms").alias("avg_duration_ms"))
        .withColumn("failure_rate_pct", _pct(F.col("failed"), F.col("total")))
    )


TOTALS = ["events_count", "error_count", "dedup_collapsed", "raw_output_bytes",
          "structured_events_bytes", "visible_events", "skipped_noise_events",
          "locations_extracted", "codes_extracted"]


def _total_columns() -> list[Column]:
    return [_count("total_tasks"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]]


def totals(tasks: DataFrame) -> DataFrame:
    return tasks.agg(*_total_columns())


def duration_stats(tasks: DataFrame) -> DataFrame:
    """Average, and the exact values at index floor(p * (n - 1) / 100) of the sorted durations.

    Equal durations are counted first.  Ranks come from bucket totals plus a running count
    inside the bucket, so no window holds more than one bucket's distinct values; the window
    over buckets has one row per 65.5 seconds of duration.
    """
    counted = (
        tasks.filter(F.col("duration_ms").isNotNull()).groupBy("duration_ms").agg(_count())
        .withColumn("bucket", F.expr(f"duration_ms div {DURATION_BUCKET_MS}"))
    )
    line = Window.partitionBy(F.lit(0))
    upto = line.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counted.groupBy("bucket").agg(F.sum("n").alias("_n")).select(
        "bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
        F.sum("_n").over(line).alias("_total"),
    )
    inside = Window.partitionBy("bucket").orderBy("duration_ms").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = counted.withColumn("_in", F.sum("n").over(inside)).join(buckets, "bucket")
    below = F.col("_before") + F.col("_in")

    def at(p: int) -> Column:
        index = F.expr(f"{p} * (_total - 1) div 100")
        return F.min(F.when(below > index, F.col("duration_ms"))).alias(f"p{p}_duration_ms")

    return ranked.agg(
        (F.sum(F.col("duration_ms") * F.col("n")) / F.sum("n")).alias("avg_duration_ms"),
        *[at(p) for p in PERCENTILES],
    )


def _failure_column() -> Column:
    rate = F.count_if(_failed()) / F.nullif(F.count(F.lit(1)), F.lit(0))
    return rate.alias("failure_rate_frac")


def failure_rate(tasks: DataFrame) -> DataFrame:
    return tasks.agg(_failure_column())


def parser_usage(tasks: DataFrame, k: int = TOP_PARSERS) -> DataFrame:
    return (
        tasks.filter(F.col("parser_name").isNotNull())
        .groupBy(F.col("parser_name").alias("parser")).agg(_count("count"))
        .orderBy(F.desc("count"), "parser").limit(k)
    )


def _coverage() -> Column:
    visible, noise = F.col("visible_events"), F.col("skipped_noise_events")
    structured = F.when(visible + noise > 0, visible).otherwise(F.col("scanned"))
    return _pct(structured, F.col("events_count"))


def parser_coverage(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Percent of events that are not plain logs; from task counters, else from the events."""
    names = ["visible_events", "skipped_noise_events", "events_count"]
    kept = tasks.agg(*[F.sum(c).alias(c) for c in names])
    seen = events.agg(F.count_if(F.col("type") != "log").alias("scanned"))
    merged = _merge_rows([kept, seen], *[F.max(c).alias(c) for c in [*names, "scanned"]])
    return merged.select(_coverage().alias("parser_coverage_pct"))


def task_metrics(events: DataFrame) -> DataFrame:
    """Per task: counters, and bytes of the events as JSON lines."""
    log = F.col("type") == "log"
    fields = [c for c in ("seq", "type", "severity", "code", "message", "file", "line", "col")]
    return events.groupBy("task_id").agg(
        _count("events_count"),
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(log).alias("skipped_noise_events"),
        F.count_if(~log).alias("visible_events"),
        F.count_if(F.col("file").isNotNull()).alias("locations_extracted"),
        F.count_if(F.col("code").isNotNull()).alias("codes_extracted"),
        F.sum(F.octet_length(F.to_json(F.struct(*fields))) + 1).alias("structured_events_bytes"),
    )


EFFICIENCY = ["content_convergence_pct", "noise_filter_pct", "diagnostic_completeness_pct",
              "dedup_reduction_pct"]


def _efficiency_columns() -> list[Column]:
    raw, structured = F.col("raw_output_bytes"), F.col("structured_events_bytes")
    visible, noise, dups = F.col("visible_events"), F.col("skipped_noise_events"), F.col("dedup_collapsed")
    saved = F.greatest(raw - structured, F.lit(0))
    return [
        F.least(_pct(saved, raw), F.lit(100.0)).alias("content_convergence_pct"),
        _pct(noise, visible + noise).alias("noise_filter_pct"),
        F.lit(None).cast("double").alias("diagnostic_completeness_pct"),
        _pct(dups, visible + noise + dups).alias("dedup_reduction_pct"),
    ]


def efficiency_report(tasks: DataFrame) -> DataFrame:
    return totals(tasks).select(*_efficiency_columns())


def _span() -> Column:
    """Days from the first to the last date; one day at least, 0 without any."""
    days = F.greatest(F.date_diff(F.col("last_date"), F.col("first_date")), F.lit(1))
    return F.coalesce(days, F.lit(0)).cast("long")


def _dates(tasks: DataFrame) -> DataFrame:
    day = F.col("started_at").cast("date")
    return tasks.agg(
        _count("total_tasks"), F.min(day).alias("first_date"), F.max(day).alias("last_date")
    )


def span_days(tasks: DataFrame) -> DataFrame:
    return _dates(tasks).select(_span().alias("span_days"))


def _per_day(total: str) -> Column:
    span = _span()
    return F.when(span > 0, F.col(total) / span).otherwise(F.lit(0.0))


def _activity(tasks: DataFrame, events: DataFrame) -> DataFrame:
    counts = events.agg(
        _count("total_events"), F.count_if(F.col("severity") == "error").alias("total_errors")
    )
    names = ["total_tasks", "first_date", "last_date", "total_events", "total_errors"]
    return _merge_rows([_dates(tasks), counts], *[F.max(n).alias(n) for n in names])


def impact_summary(tasks: DataFrame, events: DataFrame) -> DataFrame:
    return _activity(tasks, events).select(
        "total_tasks", "total_events", "total_errors", _span().alias("date_range_days"),
        _per_day("total_tasks").alias("avg_tasks_per_day"),
    )


def temporal_metrics(tasks: DataFrame, events: DataFrame) -> DataFrame:
    return _activity(tasks, events).select(
        "first_date", "last_date", _span().alias("span_days"),
        _per_day("total_tasks").alias("avg_tasks_per_day"),
        _per_day("total_events").alias("avg_events_per_day"),
    )


def _density_columns() -> list[Column]:
    has = {c: F.col(c).isNotNull() for c in ("severity", "file", "code")}
    total = F.count(F.lit(1))
    some = F.nullif(total, F.lit(0))
    fields = 3 * total + sum(F.count_if(c) for c in has.values())
    structured = F.count_if(has["file"] | has["code"])
    return [
        F.coalesce(fields / some, F.lit(0.0)).alias("avg_fields_per_event"),
        F.count_if(has["file"]).alias("events_with_location"),
        F.count_if(has["code"]).alias("events_with_code"),
        F.coalesce(structured / some * 100, F.lit(0.0)).alias("structured_event_pct"),
    ]


def information_density(events: DataFrame) -> DataFrame:
    return events.agg(*_density_columns())


def command_patterns(tasks: DataFrame) -> DataFrame:
    """Distinct commands and tasks per carrier, commands pre-counted to one row each."""
    named = {c: F.col("carrier") == c for c in CARRIERS}
    other = F.coalesce(~F.col("carrier").isin(CARRIERS), F.lit(True))
    per_command = tasks.groupBy("command").agg(
        *[F.count_if(cond).alias(c) for c, cond in named.items()], F.count_if(other).alias("unknown")
    )
    return per_command.agg(
        _count("unique_commands"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in [*CARRIERS, "unknown"]],
    )


def _tidy(df: DataFrame, sections: dict[str, Sequence[str]], label: Column | None = None) -> DataFrame:
    """Rows (section, metric, value) of report columns; dates as day numbers."""
    types = {f.name: f.dataType.typeName() for f in df.schema.fields}
    rows = [
        F.struct(
            F.lit(section).alias("section"),
            (F.lit(name) if label is None else F.concat(label, F.lit("."), F.lit(name))).alias("metric"),
            (F.unix_date(name) if types[name] == "date" else F.col(name)).cast("double").alias("value"),
        )
        for section, names in sections.items() for name in names
    ]
    return df.select(F.inline(F.array(*rows)))


DENSITY = ["avg_fields_per_event", "events_with_location", "events_with_code", "structured_event_pct"]


def impact_report(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Summary, density and temporal figures from one pass over each table, and commands."""
    n = F.count(F.lit(1))
    counts = events.agg(
        n.alias("total_events"), F.count_if(F.col("severity") == "error").alias("total_errors"),
        *_density_columns(),
    )
    names = ["total_tasks", "first_date", "last_date", "total_events", "total_errors", *DENSITY]
    row = _merge_rows([_dates(tasks), counts], *[F.max(c).alias(c) for c in names]).withColumns(
        {"date_range_days": _span(), "span_days": _span(),
         "avg_tasks_per_day": _per_day("total_tasks"), "avg_events_per_day": _per_day("total_events")})
    figures = {
        "summary": ["total_tasks", "total_events", "total_errors", "date_range_days", "avg_tasks_per_day"],
        "density": DENSITY,
        "temporal": ["first_date", "last_date", "span_days", "avg_tasks_per_day", "avg_events_per_day"],
    }
    commands = {"commands": ["unique_commands", *CARRIERS, "unknown"]}
    return _tidy(row, figures).unionByName(_tidy(command_patterns(tasks), commands))


def stats_report(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Totals, status, failure, coverage and efficiency from one pass; then the breakdowns."""
    counts = tasks.agg(
        *_total_columns(), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES],
        _failure_column(),
    )
    seen = events.agg(F.count_if(F.col("type") != "log").alias("scanned"))
    names = ["total_tasks", *TOTALS, *STATUSES, "failure_rate_frac", "scanned"]
    row = _merge_rows([counts, seen], *[F.max(c).alias(c) for c in names]).select(
        "*", _coverage().alias("parser_coverage_pct"), *_efficiency_columns())
    figures = {
        "totals": ["total_tasks", *TOTALS], "status": STATUSES, "failure": ["failure_rate_frac"],
        "coverage": ["parser_coverage_pct"], "efficiency": EFFICIENCY,
    }
    parts = [
        _tidy(row, figures),
        _tidy(purpose_breakdown(tasks),
              {"purpose": ["total", "failed", "failure_rate_pct", "avg_duration_ms"]}, F.col("purpose")),
        _tidy(duration_stats(tasks),
              {"duration": ["avg_duration_ms", *[f"p{p}_duration_ms" for p in PERCENTILES]]}),
        _tidy(parser_usage(tasks), {"parser": ["count"]}, F.col("parser")),
    ]
    return reduce(DataFrame.unionByName, parts)


def health(tasks: DataFrame, corrupt_rows: DataFrame | None = None) -> DataFrame:
    """Running and total tasks, and whether any stored row is corrupt."""
    counts = tasks.agg(F.count_if(F.col("status") == "running").alias("running"), _count("total"))
    if corrupt_rows is None:
        return counts.withColumn("corrupt", F.lit(0).cast("long"))
    bad = corrupt_rows.agg(_count("corrupt"))
    return _merge_rows([counts, bad], *[F.max(c).alias(c) for c in ("running", "total", "corrupt")])


def ecosystem_table(tasks: DataFrame) -> DataFrame:
    """Per tool and status: tasks, events, errors, raw and structured bytes."""
    sums = ["events_count", "error_count", "raw_output_bytes", "structured_events_bytes"]
    return tasks.groupBy(F.coalesce("parser_name", F.lit("raw")).alias("parser"), "status").agg(
        _count("tasks"), *[F.sum(c).alias(c) for c in sums]
    )


def backfill_purpose(tasks: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Fill missing purposes: the first (column, regex, purpose) that matches applies."""
    guess = F
    for column, regex, purpose in rules:
        guess = guess.when(F.col(column).rlike(regex), purpose)
    return tasks.withColumn("purpose", F.coalesce("purpose", guess.otherwise(None)))


def repair_loop_stats(loops: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    some = F.nullif(n, F.lit(0))
    return loops.agg(
        n.alias("fix_loops"),
        F.coalesce(F.sum("retries") / some, F.lit(0.0)).alias("avg_retries_to_fix"),
        F.coalesce(F.round(F.sum("duration_ms") / some), F.lit(0)).cast("long").alias("avg_fix_duration_ms"),
        F.coalesce(F.min("duration_ms"), F.lit(0)).cast("long").alias("fastest_fix_ms"),
    )
