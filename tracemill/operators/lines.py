"""Line operators: split, cap, clip (inputs keyed by task_id, ordered by line_no)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_noise, utf8_prefix
from ..plans.segments import SEGMENT_POSITIONS, running_total

MAX_OUTPUT_BYTES = 10_485_760
LINE_ORDER = ("line_no",)


def split_lines(raw: DataFrame, text: str = "raw", source: str = "stdout") -> DataFrame:
    """Lines of whole outputs: (task_id, line_no from 1, source, text, n_bytes).

    A line ends at `\\n`; one `\\r` before it is dropped; n_bytes counts the terminator.
    """
    parts = F.split(F.col(text), "\n")
    exploded = raw.select(
        *[c for c in raw.columns if c != text],
        F.size(parts).alias("_n"),
        F.posexplode(parts).alias("_pos", "_part"),
    )
    last = F.col("_pos") + 1 == F.col("_n")
    return (
        exploded.filter(~(last & (F.col("_part") == "")))
        .withColumns(
            {
                "line_no": (F.col("_pos") + 1).cast("long"),
                "source": F.lit(source),
                "text": F.regexp_replace("_part", r"\r\z", ""),
                "n_bytes": (F.octet_length("_part") + F.when(last, 0).otherwise(1)).cast("long"),
            }
        )
        .drop("_pos", "_part", "_n")
    )


def truncation_notice(max_bytes: int) -> Column:
    return F.lit(f"Output truncated: exceeded {max_bytes} byte limit")


def cap_task_output(
    lines: DataFrame, max_bytes: int = MAX_OUTPUT_BYTES, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """Keep each task's lines up to `max_bytes`; the line that crosses becomes one notice.

    The notice row has `truncated` true and replaces everything from there on.
    """
    total = running_total(lines, F.col("n_bytes"), "_used", LINE_ORDER, width)
    crossing = F.col("_used") > max_bytes
    notice = truncation_notice(max_bytes)
    return (
        total.filter(F.col("_used") - F.col("n_bytes") <= max_bytes)
        .withColumn("truncated", crossing)
        .withColumn("text", F.when(crossing, notice).otherwise(F.col("text")))
        .drop("_used")
    )


def join_capped_lines(
    lines: DataFrame, max_bytes: int, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """One text per task: lines within `max_bytes`, the prefix of the crossing line, a note.

    The text of one task is at most `max_bytes` plus one line, so the list is bounded.
    """
    total = running_total(lines, F.col("n_bytes"), "_used", LINE_ORDER, width)
    before = F.col("_used") - F.col("n_bytes")
    crossing = F.col("_used") > max_bytes
    room = F.least(F.lit(max_bytes) - before, F.octet_length("text"))
    kept = total.filter(before <= max_bytes).select(
        "task_id", "line_no", crossing.alias("crossing"),
        F.when(crossing, utf8_prefix(F.col("text"), room)).otherwise(F.col("text")).alias("text"),
    )
    ordered = F.array_sort(
        F.collect_list(F.when(~F.col("crossing") | (F.col("text") != ""),
                              F.struct("line_no", "text")))
    )
    body = F.array_join(F.transform(ordered, lambda x: x["text"]), "\n")
    note = F.lit(f"[output truncated at {max_bytes} bytes]")
    return kept.groupBy("task_id").agg(
        F.max("crossing").alias("truncated"), body.alias("body")
    ).select(
        "task_id", "truncated",
        F.when(~F.col("truncated"), F.col("body"))
        .when(F.col("body") == "", note)
        .otherwise(F.concat("body", F.lit("\n"), note)).alias("raw_output"),
    )


def drop_noise(events: DataFrame) -> DataFrame:
    """Without blank, colour-only and lone-colon log events."""
    return events.filter(~((F.col("type") == "log") & is_noise(F.col("message"))))
