"""All merge steps of a task in one pass over its segments.

Collapsing repeats, pairing locations, absorbing context and numbering each need to know little of what lies
before and after a segment: whether its first run goes on from the segment before, the parity of an open
alternation, the event that takes context lines, and a count.  A segment is summed up by its first run, its
last run, and what lies between them under either parity; prefixes over these small rows say what the segments
hand over, and one more pass over the events finishes them.  So the events are shuffled and read once, in
segments, however many steps there are and however long a task is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_context_line, keeps_context_text
from ..operators.merge import IDENTITY
from .segments import KEY, SEG, SEGMENT_POSITIONS, before, running, segments, with_segment

_LOCATION = "struct<file:string,line:bigint,col:bigint>"


def _repeated(message: Column, count: Column) -> Column:
    return F.when(count > 1, F.concat(message, F.lit(" (repeated "), count.cast("string"), F.lit(" times)"))).otherwise(message)


def _context(message: Column) -> Column:
    return (F.col("type") == "log") & is_context_line(message)


def _even(position: Column) -> Column:
    return position % 2 == 0


def _runs(events: DataFrame, order: tuple[str, ...], width: int) -> DataFrame:
    """First events of the runs of each segment, with their place, kind, and place in an alternation of kinds."""
    w = Window.partitionBy(KEY, SEG).orderBy(*order)
    kind = F.when(F.col("type").isin("diagnostic", "crash"), "D").when(F.col("type") == "location", "L")
    rows = (
        with_segment(events, order[0], width).repartition(KEY, SEG)
        .withColumn("_id", F.struct(*IDENTITY))
        .withColumns({"_at": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy(KEY, SEG)),
                      "_same": F.col("_id").eqNullSafe(F.lag("_id").over(w))})
        .filter(~F.col("_same"))
        .withColumn("_until", F.lead("_at").over(w))
        .withColumns({"_count": (F.coalesce("_until", F.col("_all") + 1) - F.col("_at")).cast("long"), "_kind": kind,
                      "_loc": F.when(F.col("file").isNotNull(), F.struct("file", "line", "col")),
                      "_first": F.col("_at") == 1, "_last": F.col("_until").isNull(), "_rn": F.row_number().over(w)})
        .withColumn("_linked", F.coalesce(F.col("_kind") != F.lag("_kind").over(w), F.lit(False)))
        .withColumns({"_start": F.max(F.when(~F.col("_linked"), F.col("_rn"))).over(running(w)),
                      "_then": F.coalesce(F.lead("_linked").over(w), F.lit(False))})
        .withColumn("_pos", F.col("_rn") - F.col("_start") + 1)
    )
    return rows.drop("_same", "_all", "_until", "_at")


def _summary(runs: DataFrame, order: tuple[str, ...], columns: list[str]) -> DataFrame:
    """One row for each segment: its first run, its last, and the runs between them under either parity."""
    w = Window.partitionBy(KEY, SEG).orderBy(*order)
    inner = ~F.col("_first") & ~F.col("_last")
    rows = runs.withColumn("_ctx", _context(_repeated(F.col("message"), F.col("_count"))))
    out = {}
    for p in (0, 1):
        gone = (F.col("_kind") == "L") & (F.col("_then") | _even(F.col("_pos") + F.when(F.col("_start") == 1, p).otherwise(0)))
        solid = inner & ~F.col("_ctx") & ~F.coalesce(gone, F.lit(False))
        rows = rows.withColumn(f"_solid{p}", F.when(solid, F.struct(*order, F.col("type").alias("head_type"))))
        rows = rows.withColumn(f"_head{p}", F.last(f"_solid{p}", ignorenulls=True).over(running(w)))
        taker = F.col(f"_head{p}.head_type")
        out |= {
            f"stay{p}": F.count_if(inner & (F.col(f"_solid{p}").isNotNull() | (F.col("_ctx") & (taker != "diagnostic")))),
            f"lead{p}": F.count_if(inner & F.col("_ctx") & F.col(f"_head{p}").isNull()),
            f"head{p}": F.max(f"_solid{p}"),
        }
    border = F.struct(
        F.struct(*order, F.col("type").alias("head_type")).alias("head"), "_id", "_kind", "_loc", "_count", "_pos", "_start", "_then", "_linked",
        "_ctx", _context(_repeated(F.col("message"), F.col("_count") + 1)).alias("_ctx_more"))
    # keys as aggregates: what a join asks of them is not pushed below the shuffle, which would make it another one
    task, seg = rows[KEY], rows[SEG]
    return rows.groupBy(task.alias("_task"), seg.alias("_seg")).agg(
        F.max(task).alias(KEY), F.max(seg).alias(SEG), F.max("_rn").alias("n"), F.max_by(border, F.when(F.col("_first"), 1)).alias("a"), F.max_by(border, F.when(F.col("_last"), 1)).alias("z"),
        F.max_by(F.struct("_linked", "_loc"), F.when(F.col("_rn") == 2, 1)).alias("second"), *[v.alias(k) for k, v in out.items()],
        # reads all columns, so that the summary and the events it is joined to come from one shuffle
        F.max(F.xxhash64(*columns)).alias("any"))


def _handed(summary: DataFrame) -> DataFrame:
    """What the other segments of a task hand over to each; no row for a task of one segment."""
    w, earlier = segments(), before()
    # the segments after this one, nearest last: a frame that ends at the task's end is read anew for every row
    later = Window.partitionBy(KEY).orderBy(F.desc(SEG)).rowsBetween(Window.unboundedPreceding, -1)
    a, z, n = F.col("a"), F.col("z"), F.col("n")
    prior = F.lag("z").over(w)
    s = summary.withColumns({
        "several": F.count(F.lit(1)).over(Window.partitionBy(KEY)) > 1,
        "joined": F.coalesce(a["_id"].eqNullSafe(prior["_id"]) & prior.isNotNull(), F.lit(False)),
        "linked": F.coalesce(a["_kind"] != prior["_kind"], F.lit(False)), "prev_loc": prior["_loc"]})
    s = s.filter(F.col("several") & F.col("any").isNotNull())
    joined, through = F.col("joined"), F.col("joined") & (n == 1)
    follower = F.when(~joined, F.struct(F.col("linked").alias("linked"), a["_loc"].alias("loc"))).when(
        n > 1, F.struct(F.col("second._linked").alias("linked"), F.col("second._loc").alias("loc")))
    # place in an alternation that goes on from the segment before
    fresh = ~(joined | F.col("linked")) | (z["_start"] > 1)
    s = s.withColumns({"fresh": fresh, "more": F.sum(F.when(joined, a["_count"]).otherwise(0)).over(running(w)), "follower": follower})
    s = s.withColumn("stretch", F.sum(F.col("fresh").cast("long")).over(running(w)))
    s = s.withColumn("place", F.sum(z["_pos"] - F.when(~F.col("fresh") & joined, 1).otherwise(0)).over(
        running(Window.partitionBy(KEY, "stretch").orderBy(SEG))))
    s = s.withColumns({
        "offset": F.when(joined | F.col("linked"), F.lag("place").over(w) - joined.cast("int")).otherwise(0),
        "next": F.last("follower", ignorenulls=True).over(later),
        "goes_on": F.coalesce(F.lead("joined").over(w), F.lit(False)),
        "extra": F.coalesce(F.last(F.when(~through, F.col("more")), ignorenulls=True).over(later),
                            F.last("more").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) - F.col("more")})
    linked_next = F.coalesce(F.col("next.linked"), F.lit(False))

    def fate(run: Column, alone: Column):
        """(context, removed) of a border run; `alone` says whether its segment ends with it."""
        ctx = F.when(alone & F.col("goes_on"), run["_ctx_more"]).otherwise(run["_ctx"])
        place = run["_pos"] + F.when(run["_start"] == 1, F.col("offset")).otherwise(0)
        gone = (run["_kind"] == "L") & (_even(place) | F.when(alone, linked_next).otherwise(run["_then"]))
        return ctx, F.coalesce(gone, F.lit(False))

    (a_ctx, a_gone), (z_ctx, z_gone) = fate(a, n == 1), fate(z, F.lit(True))
    a_solid, z_solid = ~joined & ~a_ctx & ~a_gone, (n > 1) & ~z_ctx & ~z_gone
    odd = F.col("offset") % 2 == 1
    inner_head = F.when(odd, F.col("head1")).otherwise(F.col("head0"))
    s = s.withColumns({"a_head": F.when(a_solid, a["head"]), "z_head": F.when(z_solid, z["head"]), "i_head": inner_head,
                       "a_ctx": ~joined & a_ctx, "z_ctx": (n > 1) & z_ctx,
                       "stay": F.when(odd, F.col("stay1")).otherwise(F.col("stay0")), "lead": F.when(odd, F.col("lead1")).otherwise(F.col("lead0"))})
    s = s.withColumn("head_in", F.last(F.coalesce("z_head", "i_head", "a_head"), ignorenulls=True).over(earlier))
    head1 = F.coalesce("a_head", "head_in")
    head2 = F.coalesce("i_head", head1)
    takes = lambda head: F.coalesce(head["head_type"] == "diagnostic", F.lit(False))
    kept = (
        F.when(F.col("a_head").isNotNull(), 1).when(F.col("a_ctx") & ~takes(F.col("head_in")), 1).otherwise(0)
        + F.col("stay") + F.when(takes(head1), 0).otherwise(F.col("lead"))
        + F.when(F.col("z_head").isNotNull(), 1).when(F.col("z_ctx") & ~takes(head2), 1).otherwise(0))
    s = s.withColumn("kept", kept).withColumn("numbered", F.coalesce(F.sum("kept").over(earlier), F.lit(0)))
    return s.select(KEY, SEG, "joined", "offset", "prev_loc", F.col("next.linked").alias("next_linked"), F.col("next.loc").alias("next_loc"),
                    "extra", "head_in", "numbered")


def merge_events(events: DataFrame, order: tuple[str, ...] = ("seq",), width: int = SEGMENT_POSITIONS) -> DataFrame:
    """Collapsed, paired, absorbed and numbered events: `repeat_count`, `paired`, `context_after` and `seq`.

    The same as collapse_repeats, pair_locations, absorb_context and assign_seq one after the other.
    """
    columns = events.columns
    runs = _runs(events, order, width)
    rows = runs.join(_handed(_summary(runs, order, columns)), [KEY, SEG], "left")
    w = Window.partitionBy(KEY, SEG).orderBy(*order)
    no, zero = F.lit(False), F.lit(0)
    follows = _even(F.col("_pos") + F.when(F.col("_start") == 1, F.coalesce("offset", zero)).otherwise(0))
    has_next = F.when(F.col("_last"), F.coalesce("next_linked", no)).otherwise(F.col("_then"))
    rows = rows.withColumns({
        "_follows": follows, "_before": F.when(F.col("_first"), F.col("prev_loc")).otherwise(F.lag("_loc").over(w)),
        "_after": F.when(F.col("_last"), F.col("next_loc")).otherwise(F.lead("_loc").over(w)),
        "repeat_count": F.col("_count") + F.when(F.col("_last"), F.coalesce("extra", zero)).otherwise(0)})
    rows = rows.withColumn("paired", F.col("_kind").isNotNull() & (F.col("_follows") | has_next))
    rows = rows.filter(~(F.col("_first") & F.coalesce("joined", no)) & (F.col("_kind").isNull() | (F.col("_kind") == "D") | ~F.col("paired")))
    takes = F.col("paired") & F.col("file").isNull()
    partner = F.when(F.col("_follows"), F.col("_before")).otherwise(F.col("_after"))
    rows = rows.withColumn("_partner", F.when(takes, partner)).withColumns({
        **{c: F.when(takes, F.col("_partner")[c]).otherwise(F.col(c)) for c in ("file", "line", "col")},
        "message": _repeated(F.col("message"), F.col("repeat_count"))})
    rows = rows.withColumn("_ctx", _context(F.col("message")))
    head = F.when(~F.col("_ctx"), F.struct(*order, F.col("type").alias("head_type")))
    rows = rows.withColumn("_head", F.coalesce(F.last(head, ignorenulls=True).over(running(w)), F.col("head_in")))
    absorbed = F.col("_ctx") & F.coalesce(F.col("_head.head_type") == "diagnostic", no)
    rows = rows.withColumn("_absorbed", absorbed)
    rows = rows.withColumn("seq_", F.coalesce("numbered", zero) + F.sum((~F.col("_absorbed")).cast("long")).over(running(w)))

    # the context of a diagnostic comes to it, from later segments too
    kept = [*[c for c in columns if c != "seq"], "repeat_count", "paired"]
    text = F.when(F.col("_absorbed") & keeps_context_text(F.col("message")), F.struct(*order, F.col("message").alias("text")))
    key = F.when(F.col("_absorbed"), F.struct(*[F.col("_head")[c].alias(c) for c in order])).otherwise(F.struct(*order))
    own = F.when(~F.col("_absorbed"), F.struct(*kept, F.col("seq_").alias("seq")))
    grouped = rows.select(KEY, key.alias("_key"), own.alias("_own"), text.alias("_text")).groupBy(KEY, "_key").agg(
        F.first("_own", ignorenulls=True).alias("_own"), F.collect_list("_text").alias("_texts"))
    after = F.transform(F.array_sort("_texts"), lambda x: x["text"])
    return grouped.select("_own.*", F.when(F.size("_texts") > 0, after).alias("context_after"))
