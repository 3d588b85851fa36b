"""Rules with conditions, as functions on a small set of states that compose over segments.

What a task's rules remember (`key=value`) takes few states: those that the transitions can reach from
nothing.  A line maps each state to the next one, a segment of lines too, and so does any row of segments; the
state in which a segment begins is a prefix of such maps, found in a fixed number of doubling steps over one
small row per segment.  Then each segment plays its own lines from there.  A task may have any number of lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.rulepacks import Rule
from .segments import KEY, SEG

SEGMENT_LINES = 1_000
#: Doubling steps: two to this power segments of one task with lines that match.
STEPS = 24


def _pair(text: str | None) -> tuple[str, str] | None:
    return tuple(text.split("=", 1)) if text else None


def state_table(packs: Sequence[Sequence[Rule]]) -> tuple[int, list[list[int]]]:
    """Number of states and, for each rule of all packs in order, what it makes of each state.

    An entry is twice the next state, plus one where the rule fires.  State 0 is that of nothing yet.
    """
    tables, most = [], 1
    for rules in packs:
        pairs = [(_pair(r.state_condition), _pair(r.state_transition)) for r in rules]
        numbers, queue, rows = {frozenset(): 0}, [frozenset()], [[] for _ in rules]
        for state in queue:  # grows while it is read
            held = dict(state)
            for row, (need, change) in zip(rows, pairs):
                fires = need is None or held.get(need[0]) == need[1]
                after = frozenset({**held, **dict([change])}.items()) if fires and change else state
                if after not in numbers:
                    numbers[after] = len(numbers)
                    queue.append(after)
                row.append(2 * numbers[after] + fires)
        tables += rows
        most = max(most, len(numbers))
    return most, [row + [2 * s for s in range(len(row), most)] for row in tables]


def _step(states: int, table: list[list[int]], numbers: Sequence[int]):
    """Entry of the table by rule number and state."""
    first = min(numbers)
    flat = [[2 * s for s in range(states)] for _ in range(max(numbers) - first + 1)]
    for number, row in zip(numbers, table):
        flat[number - first] = row
    entries = F.array(*[F.lit(x) for row in flat for x in row])
    return lambda state, number: F.get(entries, (number - first) * states + state)


def _fold(numbers: Column, state: Column, step) -> Column:
    """State after a line."""
    return F.aggregate(numbers, state, lambda s, n: (step(s, n) / 2).cast("int"))


def _kept(numbers: Column, state: Column, step) -> Column:
    """Rule numbers of a line that fire."""
    start = F.struct(state.alias("s"), F.array().cast("array<int>").alias("kept"))

    def play(acc, n):
        entry = step(acc["s"], n)
        return F.struct((entry / 2).cast("int").alias("s"), F.when(entry % 2 == 1, F.concat(acc["kept"], F.array(n))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(numbers, start, play)["kept"]


def start_states(effects: DataFrame, steps: int = STEPS) -> DataFrame:
    """(task_id, seg, start) of tasks with several segments, from the map `effect` of each segment."""
    w = Window.partitionBy(KEY).orderBy(SEG)
    out = effects.withColumn("_several", F.count(F.lit(1)).over(Window.partitionBy(KEY)) > 1).filter("_several")
    for step in range(steps):
        before = F.lag("effect", 2**step).over(w)
        out = out.withColumn("_before", before).withColumn(
            "effect", F.when(F.col("_before").isNotNull(), F.transform("_before", lambda s: F.get("effect", s))).otherwise(F.col("effect")))
    return out.select(KEY, SEG, F.lag(F.get("effect", F.lit(0))).over(w).alias("start"))


def conditional_rules(lines: DataFrame, column: str, numbers: Sequence[int], packs: Sequence[Sequence[Rule]],
                      width: int = SEGMENT_LINES) -> DataFrame:
    """Lines with only those rule numbers in `column` that fire, in the order of line_no.

    `numbers` are those of all rules of all packs in order; a task's lines have rules of one pack.  Lines of
    equal line_no are taken in the order of their columns.
    """
    states, table = state_table(packs)
    step = _step(states, table, numbers)
    columns = lines.columns
    rows = lines.withColumn(SEG, F.expr(f"line_no div {int(width)}")).withColumn("_line", F.struct("line_no", F.struct(*columns).alias("row")))
    # a segment holds the matching lines among `width` ones
    held = rows.groupBy(F.col(KEY).alias("_task"), F.col(SEG).alias("_seg")).agg(
        # keys as aggregates: the join's filter on them stays above the shuffle, so both sides of it read the same one
        F.max(KEY).alias(KEY), F.max(SEG).alias(SEG), F.sort_array(F.collect_list("_line")).alias("_lines"))
    every = F.sequence(F.lit(0), F.lit(states - 1))
    effect = F.transform(every, lambda s: F.aggregate("_lines", s, lambda acc, x: _fold(x["row"][column], acc, step)))
    starts = start_states(held.select(KEY, SEG, effect.alias("effect")))
    held = held.join(starts, [KEY, SEG], "left").withColumn("start", F.coalesce("start", F.lit(0)))
    begin = F.struct(F.col("start").alias("s"), F.array().cast("array<array<int>>").alias("out"))

    def play(acc, x):
        own = x["row"][column]
        return F.struct(_fold(own, acc["s"], step).alias("s"), F.concat(acc["out"], F.array(_kept(own, acc["s"], step))).alias("out"))

    held = held.withColumn("_out", F.aggregate("_lines", begin, play)["out"])
    each = held.select(F.explode(F.arrays_zip("_lines", "_out")).alias("x"))
    return each.select(*[F.col("x._out").alias(c) if c == column else F.col(f"x._lines.row.{c}").alias(c) for c in columns])
