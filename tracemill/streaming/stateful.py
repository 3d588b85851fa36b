"""Keyed state of live operators: what a task needs to remember, field by field, and timers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(df: DataFrame, key: str, processor: StatefulProcessor, schema: StructType | str, timers: bool) -> DataFrame:
    """Rows of a stream through a processor per key; its fields need the session's state store to be RocksDB's.

    Without timers a run over finite input can end.
    """
    df.sparkSession.conf.set(STORE, ROCKS)
    return df.groupBy(key).transformWithState(processor, schema, "append", "ProcessingTime" if timers else "None")


class Timed(StatefulProcessor):
    """A processor with at most one timer for a key, `idle_ms` after its last rows."""

    idle_ms: int | None = None

    def init(self, handle):
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long") if self.idle_ms is not None else None

    def wait(self, now: int) -> None:
        if self.timer is None:
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(now + self.idle_ms)
        self.timer.update((now + self.idle_ms,))

    def stop_waiting(self, delete: bool = True) -> None:
        if self.timer is not None and self.timer.exists():
            if delete:
                self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()

    def close(self) -> None:
        pass


class InOrder(Timed):
    """Lines of a task in the order of line_no, each worked on once those before it are there.

    Lines that come early wait in a map of the state; `played` takes a line in order and gives rows out.
    Lines that came already are dropped.  A line that never comes holds the others until the timer, which
    then works on what is there.
    """

    def __init__(self, schema: StructType, idle_ms: int | None):
        self.schema, self.idle_ms = schema, idle_ms

    def init(self, handle):
        super().init(handle)
        self.row = Row(*self.schema.names)
        self.next = handle.getValueState("next", "line_no long, early long")
        self.early = handle.getMapState("early", "line_no long", StructType().add("row", self.schema))

    def played(self, row: Row) -> list[Row]:
        raise NotImplementedError

    def load(self, known: bool) -> None:
        """Called before rows of a key are played; `known` says whether it had rows before."""

    def save(self) -> None:
        """Called after rows of a key were played."""

    def handleInputRows(self, key, rows, timerValues):
        before = self.next.get()  # each question to the state is a round trip, so few are asked
        line, early = before or (1, 0)
        self.load(before is not None)
        held = {}
        for row in rows:
            if row.line_no == line:
                yield from self.played(row)
                line += 1
                while held or early:
                    if line in held:
                        row = held.pop(line)
                    elif early and self.early.containsKey((line,)):
                        row, early = self.row(*self.early.getValue((line,))[0]), early - 1
                        self.early.removeKey((line,))
                    else:
                        break
                    yield from self.played(row)
                    line += 1
            elif row.line_no > line:
                held[row.line_no] = row
        for number, row in held.items():
            early += not self.early.containsKey((number,))
            self.early.updateValue((number,), (tuple(row),))
        self.next.update((line, early))
        self.save()
        if early:
            self.wait(timerValues.getCurrentProcessingTimeInMs())
        else:
            self.stop_waiting()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        line, _ = self.next.get()
        self.load(True)
        for number, row in sorted(((k[0], v[0]) for k, v in self.early.iterator()), key=lambda x: x[0]):
            yield from self.played(self.row(*row))
            line = number + 1
        self.early.clear()
        self.next.update((line, 0))
        self.save()
        self.stop_waiting(delete=False)
