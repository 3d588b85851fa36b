"""Repair loops: a failure streak in one directory that a success closes quickly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.segments import KEY, SEG, before, carry, running, segment_window, segments, summarize
from .stats import REPAIR_MAX_RETRIES, REPAIR_MAX_SECONDS

DAY_SECONDS = 86_400


def repair_loops(tasks: DataFrame) -> DataFrame:
    """Loops per cwd over untagged tasks: (cwd, opened, closed, retries, duration_ms).

    Whether a streak is open after a task follows from the task alone: an error opens it, a
    clean success closes it, a success with errors does whichever is due, others change
    nothing.  So the state is the last forced state flipped by the parity of the toggles
    since, and windows per (cwd, day) with a carry per day replace a scan over the cwd.
    """
    error = F.col("error_count") > 0
    success = (F.col("status") == "completed") & F.coalesce(F.col("exit_code") == 0, F.lit(False))
    rows = tasks.filter(
        F.col("purpose").isNull() & F.col("cwd").isNotNull() & F.col("started_at").isNotNull()
    ).select(
        F.col("cwd").alias(KEY), F.col("task_id").alias("id"), "started_at",
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("us"),
        F.when(error & ~success, 1).when(success & ~error, 0).alias("forced"),
        (error & success).cast("long").alias("toggle"),
    ).withColumn(SEG, F.expr(f"us div {DAY_SECONDS * 1_000_000}"))

    order = ("us", "id")
    w = segment_window(order, 1)
    resets = F.sum(F.col("forced").isNotNull().cast("long")).over(running(w))
    rows = rows.withColumns({"_reset": resets, "_rn": F.row_number().over(w)})
    inside = Window.partitionBy(KEY, SEG, "_reset").orderBy(*order)
    rows = rows.withColumns(
        {
            "_base": F.first("forced").over(running(inside)),
            "_flips": F.sum("toggle").over(running(inside)),
        }
    )
    # a day hands on: its last forced state, the flips after it, its number of tasks
    day = summarize(
        rows, _base_out=F.max_by("_base", "_rn"), _flips_out=F.max_by("_flips", "_rn"),
        _n=F.count(F.lit(1)), _resets=F.max("_reset"),
    )
    chain = F.sum((F.col("_resets") > 0).cast("long")).over(running(segments()))
    day = day.withColumn("_chain", chain)
    through = Window.partitionBy(KEY, "_chain").orderBy(SEG)
    state_out = (
        F.coalesce(F.first("_base_out").over(running(through)), F.lit(0))
        + F.sum("_flips_out").over(running(through))
    ) % 2
    day = day.withColumn("_out", state_out)
    rows = carry(
        rows, day,
        {"_in": F.lag("_out").over(segments()), "_before": F.sum("_n").over(before())},
    )
    start = F.coalesce("_in", F.lit(0))
    state = (F.when(F.col("_reset") > 0, F.col("_base")).otherwise(start) + F.col("_flips")) % 2
    rows = rows.withColumns({"_open": state, "pos": F.col("_rn") + F.coalesce("_before", F.lit(0))})
    was_open = F.coalesce(F.lag("_open").over(w), start)
    rows = rows.withColumns(
        {"_opens": (was_open == 0) & (F.col("_open") == 1), "_closes": (was_open == 1) & (F.col("_open") == 0)}
    )
    # only openers and closers matter from here on; each closer takes the opener before it
    marks = rows.filter("_opens or _closes").withColumn(
        "_opener", F.when(F.col("_opens"), F.struct("us", "pos", "started_at"))
    )
    marks = marks.select(KEY, SEG, "us", "id", "pos", "started_at", "_closes", "_opener")
    last = F.last("_opener", ignorenulls=True).over(running(w))
    top = summarize(marks, _top=F.max("_opener"))
    marks = carry(marks, top, {"_prior": F.max("_top").over(before())})
    loops = marks.withColumn("_from", F.coalesce(last, F.col("_prior"))).filter("_closes")
    return loops.select(
        F.col(KEY).alias("cwd"), F.col("_from.started_at").alias("opened"),
        F.col("started_at").alias("closed"),
        (F.col("pos") - F.col("_from.pos")).cast("long").alias("retries"),
        F.expr("(us - _from.us) div 1000").alias("duration_ms"),
    ).filter(
        (F.col("retries") <= REPAIR_MAX_RETRIES)
        & (F.col("duration_ms") <= REPAIR_MAX_SECONDS * 1000)
    )
