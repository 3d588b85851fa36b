"""Cross-line operators over events keyed by task_id and ordered within the task.

`order` names the position columns; the first one is numeric and dense enough to cut
segments from.  Every operator returns the input columns plus its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_context_line, is_noise, keeps_context_text
from ..plans.segments import (
    KEY, SEG, SEGMENT_POSITIONS, before, carry, running, running_total, segment_window,
    segments, summarize, with_segment,
)

SEQ = ("seq",)
IDENTITY = ["type", "message", "file", "line", "col"]


def collapse_repeats(
    events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """One row per run of equal neighbours (type, message, location), with `repeat_count`.

    The first row of the run is kept; runs longer than one get a message suffix.
    """
    w = segment_window(order, width)
    part = Window.partitionBy(*([KEY] if width is None else [KEY, SEG]))
    columns = events.columns
    same = F.col("_id").eqNullSafe(F.lag("_id").over(w))
    runs = (
        with_segment(events, order[0], width)
        .withColumn("_id", F.struct(*IDENTITY))
        .withColumns({"_rn": F.row_number().over(w), "_n": F.count(F.lit(1)).over(part),
                      "_same": same})
        .filter(~F.col("_same"))
        .withColumn("_next", F.lead("_rn").over(w))
        .withColumn(
            "repeat_count",
            (F.coalesce("_next", F.col("_n") + 1) - F.col("_rn")).cast("long"),
        )
    )
    if width is not None:
        runs = _join_border_runs(runs, columns)
    suffix = F.concat(F.lit(" (repeated "), F.col("repeat_count").cast("string"), F.lit(" times)"))
    return runs.select(
        *[c for c in columns if c != "message"],
        F.when(F.col("repeat_count") > 1, F.concat("message", suffix))
        .otherwise(F.col("message")).alias("message"),
        "repeat_count",
    )


def _join_border_runs(runs: DataFrame, columns: list[str]) -> DataFrame:
    """Merge runs that continue across segment borders.

    Only the first and last run of a segment can, so at most two rows per segment are
    looked at together; all other runs are final.
    """
    first, last = F.col("_rn") == 1, F.col("_next").isNull()
    by_task = Window.partitionBy(KEY).orderBy(SEG, "_rn")
    chain = Window.partitionBy(KEY, "_chain")
    keep = [*columns, "repeat_count"]
    borders = (
        runs.filter(first | last)
        .withColumn("_joins", first & F.col("_id").eqNullSafe(F.lag("_id").over(by_task)))
        .withColumn("_chain", F.sum((~F.col("_joins")).cast("long")).over(running(by_task)))
        .withColumn("repeat_count", F.sum("repeat_count").over(chain))
        .filter(~F.col("_joins"))
    )
    return runs.filter(~(first | last)).select(*keep).unionByName(borders.select(*keep))


def collapsed_counts(
    events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """Per task: events dropped as noise plus events folded into a repeat."""
    noise = (F.col("type") == "log") & is_noise(F.col("message"))
    dropped = events.groupBy(KEY).agg(F.count_if(noise).alias("noise"))
    folded = (
        collapse_repeats(events.filter(~noise), order, width)
        .groupBy(KEY).agg(F.sum(F.col("repeat_count") - 1).alias("repeats"))
    )
    return dropped.join(folded, KEY, "left").select(
        KEY, (F.col("noise") + F.coalesce("repeats", F.lit(0))).alias("collapsed")
    )


def _mark_pairs(events: DataFrame, order, width: int | None) -> DataFrame:
    """Add `_paired` and `_partner` (the neighbour's location) to every event.

    Greedy pairing inside a stretch of strictly alternating kinds: odd positions lead,
    even positions follow.
    """
    w = segment_window(order, width)
    kind = (
        F.when(F.col("type").isin("diagnostic", "crash"), "D")
        .when(F.col("type") == "location", "L")
    )
    linked = F.coalesce(F.col("_kind") != F.lag("_kind").over(w), F.lit(False))
    rows = (
        with_segment(events, order[0], width)
        .withColumn("_kind", kind)
        .withColumn("_loc", F.when(F.col("file").isNotNull(), F.struct("file", "line", "col")))
        .withColumns({"_rn": F.row_number().over(w), "_linked": linked})
        .withColumn(
            "_start", F.max(F.when(~F.col("_linked"), F.col("_rn"))).over(running(w))
        )
        .withColumn("_pos", F.col("_rn") - F.col("_start") + 1)
    )
    zero = F.lit(0)
    if width is None:
        rows = rows.withColumns(
            {"_offset": zero, "_prev_loc": F.lit(None).cast("struct<file:string,line:bigint,col:bigint>"),
             "_next_loc": F.lit(None).cast("struct<file:string,line:bigint,col:bigint>"),
             "_next_linked": F.lit(False)}
        )
    else:
        rows = carry(rows, *_pair_borders(rows))
    head = F.col("_start") == 1
    position = F.col("_pos") + F.when(head, F.coalesce("_offset", zero)).otherwise(zero)
    follows = position % 2 == 0
    has_next = F.coalesce(F.lead("_linked").over(w), F.col("_next_linked"), F.lit(False))
    is_last = F.lead("_rn").over(w).isNull()
    is_first = F.col("_rn") == 1
    before = F.when(is_first, F.col("_prev_loc")).otherwise(F.lag("_loc").over(w))
    after = F.when(is_last, F.col("_next_loc")).otherwise(F.lead("_loc").over(w))
    return rows.withColumns(
        {
            "_paired": F.col("_kind").isNotNull() & (follows | has_next),
            "_partner": F.when(follows, before).when(has_next, after),
        }
    )


def _pair_borders(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Per segment: what the pairing needs to know about its neighbours."""
    summary = summarize(
        rows,
        _first=F.max(F.when(F.col("_rn") == 1, F.struct("_kind", "_loc"))),
        _last=F.max_by(F.struct("_kind", "_loc"), "_rn"),
        _tail=F.max_by("_pos", "_rn"),
        _tail_start=F.max_by("_start", "_rn"),
    )
    previous = F.lag("_last").over(segments())
    summary = summary.withColumns(
        {
            "_joined": F.coalesce(F.col("_first._kind") != previous["_kind"], F.lit(False)),
            "_prev_loc": previous["_loc"],
        }
    )
    # a stretch reaches through a segment only if it fills it and joins the one before
    fresh = ~F.col("_joined") | (F.col("_tail_start") > 1)
    summary = summary.withColumn("_stretch", F.sum(fresh.cast("long")).over(running(segments())))
    inside = Window.partitionBy(KEY, "_stretch").orderBy(SEG)
    summary = summary.withColumn("_length", F.sum("_tail").over(running(inside)))
    carried = {
        "_offset": F.when(F.col("_joined"), F.lag("_length").over(segments())).otherwise(0),
        "_prev_loc": F.col("_prev_loc"),
        "_next_loc": F.lead("_first").over(segments())["_loc"],
        "_next_linked": F.lead("_joined").over(segments()),
    }
    return summary, carried


def pair_locations(
    events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """Give a diagnostic the location event next to it; the used location event goes away.

    Adds `paired` (true on diagnostics that took part in a pair).
    """
    rows = _mark_pairs(events, order, width).filter(
        ~((F.col("_kind") == "L") & F.col("_paired")) | F.col("_kind").isNull()
    )
    takes = F.col("_paired") & F.col("file").isNull()
    moved = {
        name: F.when(takes, F.col("_partner")[name]).otherwise(F.col(name)).alias(name)
        for name in ("file", "line", "col")
    }
    return rows.select(
        *[moved.get(c, F.col(c)) for c in events.columns],
        F.col("_paired").alias("paired"),
    )


def pairs_merged(
    events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    return pair_locations(events, order, width).groupBy(KEY).agg(
        F.count_if("paired").alias("pairs_merged")
    )


def tag_context(
    events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """Add `absorbed` and `head` (position struct of the diagnostic that takes the line).

    Only log events are absorbed; they go to the last other event if that is a diagnostic.
    """
    w = segment_window(order, width)
    context = (F.col("type") == "log") & is_context_line(F.col("message"))
    head = F.when(~context, F.struct(*order, F.col("type").alias("head_type")))
    rows = with_segment(events, order[0], width).withColumns({"_context": context, "_head": head})
    local = F.last("_head", ignorenulls=True).over(running(w))
    if width is None:
        rows = rows.withColumn("head", local)
    else:
        rows = carry(rows, summarize(rows, _top=F.max("_head")), {"_before": F.max("_top").over(before())})
        rows = rows.withColumn("head", F.coalesce(local, F.col("_before"))).drop("_before")
    absorbed = F.col("_context") & F.coalesce(F.col("head.head_type") == "diagnostic", F.lit(False))
    return rows.withColumn("absorbed", absorbed).drop("_context", "_head", SEG)


def context_lines(tagged: DataFrame, order=SEQ) -> DataFrame:
    """Long form: one row per kept context line, keyed by its diagnostic."""
    return tagged.filter(F.col("absorbed") & keeps_context_text(F.col("message"))).select(
        KEY, *[F.col("head")[c].alias(f"head_{c}") for c in order], *order,
        F.col("message").alias("text"),
    )


def surviving_events(tagged: DataFrame) -> DataFrame:
    return tagged.filter(~F.col("absorbed")).drop("absorbed", "head")


def absorb_context(
    events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS
) -> DataFrame:
    """Events without their context lines; diagnostics carry them in `context_after`.

    The array of one diagnostic is as long as its context.  Use it on capped output (at
    most 10 MiB per task); `context_lines` is the form without such a bound.
    """
    tagged = tag_context(events, order, width)
    columns = events.columns
    text = F.when(
        F.col("absorbed") & keeps_context_text(F.col("message")),
        F.struct(*order, F.col("message").alias("text")),
    )
    own = F.when(~F.col("absorbed"), F.struct(*columns))
    key = F.when(F.col("absorbed"), F.struct(*[F.col("head")[c].alias(c) for c in order])).otherwise(
        F.struct(*order)
    )
    grouped = tagged.select(KEY, key.alias("_key"), own.alias("_own"), text.alias("_text")).groupBy(
        KEY, "_key"
    ).agg(F.first("_own", ignorenulls=True).alias("_own"), F.collect_list("_text").alias("_after"))
    after = F.transform(F.array_sort("_after"), lambda x: x["text"])
    # the grouping key stays the task's column, so the partitioning serves the next step too
    own = [F.col(KEY) if c == KEY else F.col(f"_own.{c}").alias(c) for c in columns]
    return grouped.select(*own, F.when(F.size("_after") > 0, after).alias("context_after"))


def assign_seq(events: DataFrame, order=SEQ, width: int | None = SEGMENT_POSITIONS) -> DataFrame:
    """Number the remaining events of a task 1..n in a new `seq`."""
    counted = running_total(events, F.lit(1).cast("long"), "_seq", order, width)
    return counted.withColumn("seq", F.col("_seq")).drop("_seq")
