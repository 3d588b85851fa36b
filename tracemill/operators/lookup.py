"""Lookups and correlations as joins.

Joins are plain equi-joins: Spark broadcasts a side by its measured size and splits skewed
partitions; no hint forces a broadcast of a side that could grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTEXT_LINES = 3


def attach_code_refs(
    events: DataFrame, tasks: DataFrame, refs: DataFrame, form: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Add `reference`: entries for the event's code, of the task's tool if that is known.

    Events without a code or an entry pass through with null.  `form` turns a list of entries into
    what events get instead; it is applied once per list, not once per event.
    """
    entry = F.array_sort(F.collect_list(F.struct("tool", "message")))
    entry = form(entry) if form else entry
    code = F.col("code").alias("_code")
    by_tool = refs.filter(F.col("tool").isNotNull()).groupBy(F.col("tool").alias("_tool"), code).agg(entry.alias("reference"))
    by_code = refs.groupBy(code).agg(entry.alias("reference")).select(F.lit(None).cast("string").alias("_tool"), "*")
    # one join, the last one, brings the lists, so no shuffle carries them; a task without a tool looks up the null one
    lists = by_tool.unionByName(by_code).select(F.coalesce("_tool", F.lit("")).alias("_tool"), F.isnull("_tool").alias("_any"), "_code", "reference")
    tools = tasks.select("task_id", F.col("parser_name").alias("_tool"))
    # events without a code skip the joins
    coded = events.filter(F.col("code").isNotNull()).withColumn("_code", F.col("code"))
    found = (
        coded.join(tools, "task_id", "left")
        .withColumn("_any", F.isnull("_tool")).withColumn("_tool", F.coalesce("_tool", F.lit("")))
        # dealt out while rows are short: tasks share the long lists evenly, and a broadcast join, which then begins its
        # own compiled stage, copies a row with its list once
        .repartition("task_id", "seq")
        .join(lists, ["_tool", "_any", "_code"], "left")
        .select(*events.columns, "reference")
    )
    rest = events.filter(F.col("code").isNull())
    return found.unionByName(rest, allowMissingColumns=True)


def with_task(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events with the tool and command of their task."""
    return events.join(tasks.select("task_id", "parser_name", "command"), "task_id")


def source_context(
    events: DataFrame, source_lines: DataFrame, k: int = CONTEXT_LINES,
    max_files: int | None = None, max_bytes: int | None = None,
) -> DataFrame:
    """Lines around `file:line` of errors and warnings: one row per event and source line.

    The range becomes 2k+1 wanted line numbers and an equi-join on (file, line_no).  With
    `max_bytes` or `max_files`, larger files or files past a task's first ones are left out.
    """
    wanted = events.filter(
        F.col("severity").isin("error", "warning") & F.col("file").isNotNull() & (F.col("line") > 0)
    )
    first_use = Window.partitionBy("task_id").orderBy("_first", "file")
    files = (
        wanted.groupBy("task_id", "file").agg(F.min("seq").alias("_first"))
    )
    if max_files is not None:
        files = files.withColumn("_n", F.row_number().over(first_use)).filter(F.col("_n") <= max_files)
    files = files.select("task_id", "file")
    small = source_lines.groupBy("file").agg(
        F.sum(F.octet_length("text") + 1).alias("_bytes")
    )
    if max_bytes is not None:
        small = small.filter(F.col("_bytes") <= max_bytes)
    small = small.select("file")
    spots = (
        wanted.join(files, ["task_id", "file"]).join(small, "file")
        .select("task_id", "seq", "file", F.col("line").alias("at"),
                F.explode(F.sequence(F.col("line") - k, F.col("line") + k)).alias("line_no"))
    )
    return spots.join(source_lines, ["file", "line_no"]).select(
        "task_id", "seq", "file", "line_no",
        F.when(F.col("line_no") < F.col("at"), "before")
        .when(F.col("line_no") > F.col("at"), "after").otherwise("line").alias("part"),
        "text",
    )


def changed_file_errors(events: DataFrame, changed: DataFrame) -> DataFrame:
    """Distinct files with errors, flagged when they are among the changed files."""
    files = events.filter((F.col("severity") == "error") & F.col("file").isNotNull()).select("file").distinct()
    marks = changed.select("file").distinct().withColumn("_changed", F.lit(True))
    return files.join(marks, "file", "left").select(
        "file", F.coalesce("_changed", F.lit(False)).alias("is_changed")
    )


def cascade(rows: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of tasks that were not removed."""
    return rows.join(removed.select("task_id"), "task_id", "left_anti")


def orphan_events(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """Events whose task is unknown."""
    return events.join(tasks.select("task_id"), "task_id", "left_anti")


def duplicate_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def match_expected(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected and actual events side by side by position (structs `e` and `a`)."""
    keys = ["fixture", "idx"]

    def packed(df, name):
        return df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))

    return packed(expected, "e").join(packed(actual, "a"), keys, "full_outer")


def diff_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parsers added or removed, and changed rule and deprecated counts."""

    def counted(rules, side):
        return rules.groupBy("parser").agg(
            F.count(F.lit(1)).alias(f"{side}_rules"),
            F.count_if("deprecated").alias(f"{side}_deprecated"),
        )

    both = counted(old, "old").join(counted(new, "new"), "parser", "full_outer")
    changes = both.select(
        "parser",
        F.when(F.col("old_rules").isNull(), "added").when(F.col("new_rules").isNull(), "removed")
        .otherwise("changed").alias("change"),
        (F.coalesce("new_rules", F.lit(0)) - F.coalesce("old_rules", F.lit(0))).alias("rules_delta"),
        (F.coalesce("new_deprecated", F.lit(0)) - F.coalesce("old_deprecated", F.lit(0))).alias("deprecated_delta"),
    )
    return changes.filter("change <> 'changed' or rules_delta <> 0 or deprecated_delta <> 0")
