"""From captured lines to final events: cap, parse, escalate, collapse, pair, absorb, number."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.extract import json_line_event
from ..functions.text import strip_ansi
from ..operators import extract, lines as line_ops, merge
from ..sources.rulepacks import Pack
from ..sources.steps import stored
from .formats import line_format_events
from .segments import SEGMENT_POSITIONS
from .transducer import merge_events

ORDER = ("line_no", "idx")


def structure_output(
    lines: DataFrame,
    tasks: DataFrame,
    packs: Sequence[Pack],
    max_bytes: int | None = None,
    width: int = SEGMENT_POSITIONS,
) -> DataFrame:
    """Final events of every task, numbered by `seq`; all merge steps run in one pass over segments of `width` lines.

    With `max_bytes` a task's output is cut there first, and one window per task is safe: the
    merge steps share a single shuffle on task_id.
    """
    if max_bytes is None:
        events = extract.escalate_stderr(extract.parse_lines(lines.drop("n_bytes"), tasks, packs)).drop("source")
        return merge_events(line_ops.drop_noise(events), ORDER, width).drop("idx")
    capped = line_ops.cap_task_output(lines, max_bytes).drop("n_bytes")
    parsed = extract.escalate_stderr(extract.parse_lines(capped, tasks, packs)).drop("source")
    # the notice of a cut task is no tool output: whatever the tiers made of it gives way
    cut = F.col("truncated")
    notice = {"type": "system", "severity": "warning", "tier": "system"}
    gone = {"code": "string", "file": "string", "line": "long", "col": "long"}
    events = parsed.filter(~cut | (F.col("idx") == 0)).withColumns({
        **{n: F.when(cut, v).otherwise(F.col(n)) for n, v in notice.items()},
        **{n: F.when(~cut, F.col(n)).cast(t) for n, t in gone.items()},
        "message": F.when(cut, line_ops.truncation_notice(max_bytes)).otherwise(F.col("message")),
    }).drop("truncated")
    merged = merge.pair_locations(merge.collapse_repeats(line_ops.drop_noise(events), ORDER, None), ORDER, None)
    return merge.assign_seq(merge.absorb_context(merged, ORDER, None), ORDER, None).drop("idx")


def complete_output(
    lines: DataFrame,
    tasks: DataFrame,
    packs: Sequence[Pack],
    max_bytes: int | None = None,
    width: int = SEGMENT_POSITIONS,
) -> DataFrame:
    """`structure_output`, then what is only known when a task has ended.

    Behind a task's events come the data events of a structured output as a whole (unless
    the output was cut or had JSON lines) and the summary of an npm run.  Outputs of any size
    are read from their lines.  Events are written to the shared folder once, as their
    numbers are needed before the rest can be put behind them.
    """
    events = stored(structure_output(lines, tasks, packs, max_bytes, width), "task-events")
    whole = lines if max_bytes is None else line_ops.cap_task_output(lines, max_bytes)
    json_line = F.col("text").contains("{") & json_line_event(strip_ansi(F.col("text"))).isNotNull()
    barred = json_line if max_bytes is None else json_line | F.col("truncated")
    data = stored(line_format_events(whole, width, barred), "task-data")
    npm = tasks.filter(F.col("parser_name") == "npm").select("task_id", "parser_name")
    npm_lines = whole.select("task_id", "line_no", strip_ansi(F.col("text")).alias("text")).join(npm, "task_id")
    stateful = extract.apply_stateful_rules(npm_lines, [p for p in packs if p.name == "npm"])
    ends = extract.completion_summary(stateful, tasks).withColumn("item", F.lit(None).cast("long"))
    last = events.groupBy("task_id").agg(F.max("seq").alias("_last"))
    items = data.groupBy("task_id").agg(F.max("item").alias("_items"))
    extra = data.drop("format").unionByName(ends, allowMissingColumns=True).join(last, "task_id", "left").join(
        items, "task_id", "left")
    position = F.coalesce("item", F.coalesce("_items", F.lit(0)) + 1)
    tail = extra.withColumns(
        {"seq": F.coalesce("_last", F.lit(0)) + position, "tier": F.when(F.col("item").isNull(), "stateful").otherwise("format")}
    ).drop("item", "_last", "_items")
    return events.unionByName(tail, allowMissingColumns=True)
