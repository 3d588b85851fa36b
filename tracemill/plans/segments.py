"""Per-task sequences that survive a huge task.

One task may hold a third of all lines, so nothing here sorts a whole task in one window.
A task is cut into segments of consecutive positions; windows run per (task, segment), and
what must flow across a border is carried by a table of one small row per segment.  Tasks
that fit into one segment need no carry, so that table is empty for them and the join that
brings it back adds no shuffle to the large side.

`width=None` switches segments off, for input whose size per task is bounded already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = "task_id"
SEG = "seg"
SEGMENT_POSITIONS = 100_000


def with_segment(df: DataFrame, position: str, width: int | None) -> DataFrame:
    seg = F.lit(0).cast("long") if width is None else F.expr(f"{position} div {int(width)}")
    return df.withColumn(SEG, seg)


def segment_window(order, width: int | None) -> WindowSpec:
    keys = [KEY] if width is None else [KEY, SEG]
    return Window.partitionBy(*keys).orderBy(*order)


def running(window: WindowSpec) -> WindowSpec:
    return window.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def segments() -> WindowSpec:
    """Over a summary: the segments of a task in order."""
    return Window.partitionBy(KEY).orderBy(SEG)


def before() -> WindowSpec:
    """Over a summary: all segments before this one."""
    return segments().rowsBetween(Window.unboundedPreceding, -1)


def carry(df: DataFrame, summary: DataFrame, carried: dict[str, Column]) -> DataFrame:
    """Attach to every row what the earlier segments of its task hand over.

    `summary` has one row per (task, segment); `carried` are columns over it, usually
    windows over segments() or before().  Rows of single-segment tasks get nulls.
    """
    several = F.count(F.lit(1)).over(Window.partitionBy(KEY)) > 1
    handed = (
        summary.withColumns({**carried, "_several": several})
        .filter("_several")
        .select(KEY, SEG, *carried)
    )
    return df.join(handed, [KEY, SEG], "left")


def summarize(df: DataFrame, **aggregates: Column) -> DataFrame:
    return df.groupBy(KEY, SEG).agg(*[col.alias(name) for name, col in aggregates.items()])


def running_total(df: DataFrame, value: Column, name: str, order, width) -> DataFrame:
    """Column `name`: sum of `value` over the task up to and including the row."""
    base = with_segment(df, order[0], width).withColumn("_value", value)
    local = F.sum("_value").over(running(segment_window(order, width)))
    if width is None:
        return base.withColumn(name, local).drop("_value", SEG)
    totals = summarize(base, _total=F.sum("_value"))
    rows = carry(base, totals, {"_before": F.sum("_total").over(before())})
    return rows.withColumn(name, local + F.coalesce("_before", F.lit(0))).drop(
        "_value", "_before", SEG
    )
