"""Rules with conditions on live lines: a task's lines put in order, and what its rules remember as state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..plans.conditions import state_table
from ..sources.rulepacks import Rule
from .stateful import InOrder, with_state

IDLE_MS = 600_000


class _Conditions(InOrder):
    def __init__(self, schema, column, numbers, packs, idle_ms):
        super().__init__(schema, idle_ms)
        self.at, (_, table) = schema.names.index(column), state_table(packs)
        self.table = dict(zip(numbers, table))

    def init(self, handle):
        super().init(handle)
        self.state = handle.getValueState("state", "state int")

    def load(self, known):
        before = self.state.get() if known else None
        self.now = self.saved = before[0] if before else 0

    def save(self):
        if self.now != self.saved:
            self.state.update((self.now,))

    def played(self, row):
        kept = []
        for number in row[self.at]:
            entry = self.table[number][self.now]
            self.now = entry // 2
            if entry % 2:
                kept.append(number)
        yield row if len(kept) == len(row[self.at]) else self.row(*row[: self.at], kept, *row[self.at + 1 :])


def conditional_rules_live(
    lines: DataFrame, column: str, numbers: Sequence[int], packs: Sequence[Sequence[Rule]], idle_ms: int | None = IDLE_MS
) -> DataFrame:
    """The same as plans.conditions.conditional_rules on a stream of all lines of its tasks, numbered from 1.

    A line waits for those before it; after `idle_ms` without them it goes on (None: it waits).
    """
    return with_state(lines, "task_id", _Conditions(lines.schema, column, numbers, packs, idle_ms), lines.schema, idle_ms is not None)
