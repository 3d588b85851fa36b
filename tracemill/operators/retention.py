"""Retention and maintenance: results are new tables, inputs stay as they are."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import cascade

# ---- fixed values: fields removed by scrubbing ----------------------------------------
SCRUBBED_FIELDS = ["context", "correlated_errors"]
SCRUBBED_METRIC = "contexts_enriched"
# -------------------------------------------------------------------------------------


def _terminal() -> Column:
    return F.col("status") != "running"


def removed_by_keep(tasks: DataFrame, k: int) -> DataFrame:
    """Finished tasks beyond the newest k; running tasks neither count nor go.

    The newest k are a distributed top-k; the rest is an anti-join, not a global sort.
    """
    done = tasks.filter(_terminal())
    kept = done.orderBy(F.desc("started_at"), F.desc("task_id")).limit(k).select("task_id")
    return done.join(kept, "task_id", "left_anti")


def removed_by_age(tasks: DataFrame, days: int, now: datetime.datetime) -> DataFrame:
    """Finished tasks started more than `days` days before `now`."""
    cutoff = now - datetime.timedelta(days=days)
    return tasks.filter(_terminal() & (F.col("started_at") < F.lit(cutoff)))


def prune_counts(removed: DataFrame, events: DataFrame) -> DataFrame:
    """How many tasks and events a removal deletes."""
    gone = events.join(removed.select("task_id"), "task_id", "left_semi")
    rows = removed.agg(F.count(F.lit(1)).alias("tasks_deleted")).unionByName(
        gone.agg(F.count(F.lit(1)).alias("events_deleted")), allowMissingColumns=True
    )
    return rows.agg(*[F.max(c).alias(c) for c in ("tasks_deleted", "events_deleted")])


def prune(tasks: DataFrame, events: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks, events) without the removed tasks."""
    return cascade(tasks, removed), cascade(events, removed)


def recover_interrupted(tasks: DataFrame, now: datetime.datetime) -> DataFrame:
    """Tasks still running at load time become failed, finished now, without a pid."""
    running = F.col("status") == "running"
    changes = {
        "status": F.when(running, "failed").otherwise(F.col("status")),
        "finished_at": F.when(running, F.lit(now).cast(tasks.schema["finished_at"].dataType))
        .otherwise(F.col("finished_at")),
    }
    if "pid" in tasks.columns:
        changes["pid"] = F.when(~running, F.col("pid"))
    return tasks.withColumns(changes)


def extract_inline_raw(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tasks without inline output, raw table of the outputs that were inline)."""
    raw = tasks.filter(F.col("raw_output").isNotNull()).select("task_id", "raw_output")
    return tasks.withColumn("raw_output", F.lit(None).cast("string")), raw


def scrub_context(rows: DataFrame, text: str = "value") -> DataFrame:
    """Drop context fields from JSON rows; rows that are no JSON object stay as they are.

    Rows without such a field are returned byte for byte, so a second run changes nothing.
    """
    line = F.col(text)
    fields = F.try_variant_get(F.try_parse_json(line), "$", "map<string,variant>")
    metrics = F.try_variant_get(F.try_element_at(fields, F.lit("metrics")), "$", "map<string,variant>")
    has_metric = F.coalesce(F.map_contains_key(metrics, SCRUBBED_METRIC), F.lit(False))
    touched = F.coalesce(
        F.arrays_overlap(F.map_keys(fields), F.array(*[F.lit(f) for f in SCRUBBED_FIELDS])), F.lit(False)
    ) | has_metric
    slim = F.map_filter(metrics, lambda k, v: k != SCRUBBED_METRIC)
    kept = F.map_filter(fields, lambda k, v: ~k.isin(SCRUBBED_FIELDS))
    rebuilt = F.transform_values(
        kept,
        lambda k, v: F.when((k == "metrics") & has_metric, F.to_json(slim)).otherwise(F.to_json(v)),
    )
    entries = F.transform(
        F.map_entries(rebuilt),
        lambda e: F.concat(F.to_json(F.array(e["key"])), F.lit(":"), e["value"]),
    )
    # `["key"]` is the quoted key in brackets
    clean = F.transform(entries, lambda e: F.regexp_replace(e, r'^\[("(?:[^"\\]|\\.)*")\]:', "$1:"))
    body = F.concat(F.lit("{"), F.array_join(clean, ","), F.lit("}"))
    return rows.withColumn(text, F.when(touched, body).otherwise(line))
