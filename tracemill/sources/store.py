"""Readers and writers of the JSON-lines store: tasks, events, raw output, audit, snapshots.

Text files are read split by split.  A row's line number comes from its place in the split
plus the lines of the splits before it, so no file has to be read by a single task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import AGENT_JSON, EVENT_JSON, TASK_JSON
from .commits import commit, committed_paths

CORRUPT = "_corrupt"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of text files below a path or several: (path, file, line_no from 1, place among the lines of all files in
    the order of paths, value), a `\\r` kept as it is.

    The numbers of the splits are broadcast, a row for each split, which the driver lists anyway: a join by split
    would bring all rows of a split to one task of a shuffle that has no more tasks than there are splits.
    """
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = rows.select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
    ).withColumn("_id", F.monotonically_increasing_id())
    before = Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before_all = Window.orderBy("path", "_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("path", "_block").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    ).select("path", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
             F.coalesce(F.sum("_n").over(before_all), F.lit(0)).alias("_before_all"))
    at = F.col("_id") - F.col("_first") + 1
    return rows.join(F.broadcast(blocks), ["path", "_block"]).select(
        "path", "file", (F.col("_before") + at).alias("line_no"), (F.col("_before_all") + at).alias("place"), "value"
    )


def parse_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Numbered lines plus `row` (struct) and `_corrupt` (the text of a row that does not parse)."""
    full = f"{schema}, {CORRUPT} string"
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    filled = lines.filter(F.trim("value") != "").withColumn("row", parsed)
    whole = F.try_parse_json("value").isNotNull() & F.col(f"row.{CORRUPT}").isNull()
    return filled.withColumn(CORRUPT, F.when(~whole, F.col("value")))


def split_corrupt(rows: DataFrame, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(good, corrupt) rows.  `skip` drops corrupt rows, `fail` raises when one is read."""
    bad = F.col(CORRUPT).isNotNull()
    if mode == "fail":
        checked = F.when(bad, F.raise_error(F.concat(
            F.lit("corrupt row in "), "file", F.lit(" line "), F.col("line_no").cast("string"))))
        return rows.withColumn(CORRUPT, checked.otherwise(None)).filter(F.col(CORRUPT).isNull()), rows.limit(0)
    corrupt = rows.filter(bad).select("path", "file", "line_no", F.col(CORRUPT).alias("value"))
    return rows.filter(~bad), corrupt if mode == "quarantine" else corrupt.limit(0)


def _timestamp(col: str) -> Column:
    return F.try_to_timestamp(F.col(col))


def read_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, corrupt rows); the last row of a repeated task_id wins.

    Sorts carry a row's text and its place, not its fields; the fields of the last ones are read again.
    """
    good, corrupt = split_corrupt(parse_rows(numbered_lines(spark, path), TASK_JSON))
    latest = good.select(F.col("row.task_id").alias("task_id"), F.col("value").alias("row_text"), "place").groupBy(
        "task_id").agg(F.max_by("row_text", "place").alias("row_text"))
    columns = [f.name for f in good.schema["row"].dataType.fields if f.name != CORRUPT]
    return latest.select(F.from_json("row_text", TASK_JSON).alias("row")).select("row.*").select(
        *[_timestamp(c).alias(c) if c.endswith("_at") else F.col(c) for c in columns]
    ), corrupt


def _task_of_file() -> Column:
    return F.regexp_extract("file", r"^(.*?)\.[^.]*$", 1)


def flat_event(row: str) -> list[Column]:
    names = ["seq", "type", "severity", "code", "message"]
    return [F.col(f"{row}.{n}").alias(n) for n in names] + [
        F.col(f"{row}.location.file").alias("file"), F.col(f"{row}.location.line").alias("line"),
        F.col(f"{row}.location.column").alias("col"), F.col(f"{row}.context.after").alias("context_after"),
    ]


def read_events(spark: SparkSession, path: str, mode: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """(events, corrupt rows) of files named `<task_id>.jsonl`."""
    good, corrupt = split_corrupt(parse_rows(numbered_lines(spark, path), EVENT_JSON), mode)
    return good.select(_task_of_file().alias("task_id"), *flat_event("row")), corrupt


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Captured output of files named `<task_id>.txt`, as lines with their bytes.

    Every line has a terminator of one byte but perhaps a file's last; that shows in the size of the file.
    """
    lines = numbered_lines(spark, path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("length").alias("_size"))
    read = lines.groupBy("path").agg(F.sum(F.octet_length("value") + 1).alias("_bytes"), F.max("line_no").alias("_last"))
    open_ended = read.join(files, "path").filter("_bytes > _size").select("path", F.col("_last").alias("line_no"), F.lit(1).alias("_less"))
    return lines.join(open_ended, ["path", "line_no"], "left").select(
        _task_of_file().alias("task_id"), "line_no", F.lit("stdout").alias("source"),
        F.regexp_replace("value", r"\r\z", "").alias("text"),
        (F.octet_length("value") + 1 - F.coalesce("_less", F.lit(0))).cast("long").alias("n_bytes"),
    )


def read_agent_events(spark: SparkSession, path: str) -> DataFrame:
    """Tool rounds of transcripts in folders `<task>__<mode>`; malformed lines are skipped."""
    good, _ = split_corrupt(parse_rows(numbered_lines(spark, path), AGENT_JSON), "skip")
    folder = F.regexp_extract("path", r"([^/]+)__([^/_]+)/[^/]*$", 1)
    mode = F.regexp_extract("path", r"([^/]+)__([^/_]+)/[^/]*$", 2)
    kind = (
        F.when(F.col("row.item.type") == "mcp_tool_call", "mcp")
        .when(F.col("row.item.type") == "command_execution", "shell")
    )
    return good.filter(F.col("row.type").isin("item.completed", "turn.completed", "error")).select(
        folder.alias("task_id"), mode.alias("mode"), F.col("line_no").alias("pos"),
        F.col("row.type").alias("type"), kind.alias("kind"), F.col("row.item.server").alias("server"),
        F.col("row.item.tool").alias("tool"),
        F.coalesce("row.item.command", "row.item.cmd").alias("command"),
        F.col("row.item.arguments").alias("arguments"), F.col("row.item.text").alias("text"),
        F.col("row.usage").alias("usage"), F.col("row.message").alias("error"),
    )


def read_fixtures(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, expected events) of golden pairs `<pack>/<name>.txt` and `<pack>/<name>.json`.

    Golden files are small by nature; each expected file is one JSON array.
    """
    fixture = F.regexp_extract("path", r"([^/]+/[^/]+)\.[^.]*$", 1)
    lines = numbered_lines(spark, f"{path}/*/*.txt").select(
        fixture.alias("fixture"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("parser_name"),
        "line_no", F.col("value").alias("text"))
    item = "type string, severity string, code string, message string, file string, line bigint"
    whole = spark.read.text(f"{path}/*/*.json", wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    expected = whole.select(
        fixture.alias("fixture"),
        F.posexplode(F.from_json("value", f"array<struct<{item.replace(' ', ':').replace(',:', ', ')}>>")).alias("idx", "e"),
    ).select("fixture", (F.col("idx") + 1).cast("long").alias("idx"), "e.*")
    return lines, expected


# ---- writers ------------------------------------------------------------------------


def event_json() -> Column:
    location = F.when(F.col("file").isNotNull(), F.struct("file", "line", F.col("col").alias("column")))
    return F.to_json(F.struct("task_id", "seq", "type", "severity", "code", "message",
                              location.alias("location")))


def write_events(events: DataFrame, path: str, event_date: Column, batch: str | None = None) -> int:
    """Append events as JSON lines under `event_date=`; one file per task would be too many.

    They count from the commit on, and a batch of a name counts once.
    """
    rows = events.select(event_json().alias("value"), event_date.alias("event_date"))
    return commit(lambda folder: rows.write.partitionBy("event_date").text(folder), events.sparkSession, path, batch)


def write_tasks(tasks: DataFrame, path: str, corrupt: DataFrame | None = None) -> int:
    """Write a full snapshot, corrupt rows kept as they were, in place of the one before; the commit's number."""
    rows = tasks.select(F.to_json(F.struct(*tasks.columns)).alias("value"))
    if corrupt is not None:
        rows = rows.unionByName(corrupt.select("value"))
    return commit(rows.write.text, tasks.sparkSession, path, replaces=True)


def current_tasks_path(spark: SparkSession, path: str) -> str:
    """Folder of the newest snapshot."""
    return committed_paths(spark, path)[-1]


def write_audit(audit: DataFrame, path: str, batch: str | None = None) -> int:
    return commit(audit.write.json, audit.sparkSession, path, batch)


def write_metrics_snapshot(report: DataFrame, path: str, snapshot_date: str, provenance: dict, batch: str | None = None) -> int:
    """Store a report with its `snapshot_date`, each row with where its numbers come from."""
    rows = report.withColumns(
        {"snapshot_date": F.lit(snapshot_date), "provenance": F.lit(json.dumps(provenance, sort_keys=True))})
    return commit(rows.write.partitionBy("snapshot_date").json, report.sparkSession, path, batch)


# ---- checks -------------------------------------------------------------------------


def integrity_report(spark: SparkSession, tasks_path: str, events_path: str) -> DataFrame:
    """Corrupt task and event rows by file and line."""
    found = [
        parse_rows(numbered_lines(spark, path), schema).filter(F.col(CORRUPT).isNotNull()).select(
            F.lit(kind).alias("kind"), "file", "line_no", F.col(CORRUPT).alias("value"))
        for kind, path, schema in (("task", tasks_path, TASK_JSON), ("event", events_path, EVENT_JSON))
    ]
    return found[0].unionByName(found[1])


def store_size(spark: SparkSession, path: str) -> DataFrame:
    """Total bytes of all files below a path; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
