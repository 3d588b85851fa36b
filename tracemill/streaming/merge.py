"""Live merging: the batch merge steps as one per-task state that survives micro-batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import is_context_line, is_noise, keeps_context_text
from .stateful import Timed, with_state

IDENTITY = ["type", "message", "file", "line", "col"]
CARRIED = ["line_no", "tier", "type", "severity", "code", "message", "file", "line", "col"]
OUTPUT = (
    "task_id string, seq bigint, line_no bigint, tier string, type string, severity string, "
    "code string, message string, file string, line bigint, col bigint, repeat_count bigint, "
    "paired boolean, context_after array<string>"
)


class TaskMerge:
    """Collapse, pair and absorb for one task; `state` is plain data between batches.

    `earlier` gives the context lines that an open diagnostic took in earlier batches.
    """

    def __init__(self, state: dict | None, max_bytes: int | None, earlier=list):
        self.max_bytes, self.earlier = max_bytes, earlier
        self.s = state or {"next": 1, "used": 0, "cut": False, "seq": 0, "early": {},
                           "run": None, "pair": None, "head": None}
        self.out: list[dict] = []

    def _emit(self, event: dict) -> None:
        self.s["seq"] += 1
        if event.pop("stored", False):
            event = {**event, "context_after": [*self.earlier(), *event["context_after"]]}
        self.out.append({**event, "seq": self.s["seq"]})

    def _absorb(self, event: dict) -> None:
        head = self.s["head"]
        if event["type"] == "log" and event["context"] and head and head["type"] == "diagnostic":
            if event["keeps"]:
                head["context_after"].append(event["message"])
            return
        if head:
            self._emit(head)
        self.s["head"] = {**event, "context_after": []}

    def _pair(self, event: dict) -> None:
        kind = {"diagnostic": "D", "crash": "D", "location": "L"}.get(event["type"])
        waiting = self.s["pair"]
        self.s["pair"] = None
        if waiting and kind and waiting["kind"] != kind:
            diag, place = (event, waiting) if kind == "D" else (waiting, event)
            if diag["file"] is None:
                diag = {**diag, "file": place["file"], "line": place["line"], "col": place["col"]}
            self._absorb({**diag, "paired": True, "line_no": diag["line_no"]})
            return
        if waiting:
            self._absorb(waiting)
        if kind:
            self.s["pair"] = {**event, "kind": kind, "paired": False}
        else:
            self._absorb({**event, "paired": False})

    def _end_run(self) -> None:
        run, self.s["run"] = self.s["run"], None
        if run:
            n = run["repeat_count"]
            suffix = f" (repeated {n} times)" if n > 1 else ""
            self._pair({**run, "message": run["message"] + suffix})

    def _event(self, event: dict) -> None:
        if event["noise"]:
            return
        run = self.s["run"]
        if run and all(run[k] == event[k] for k in IDENTITY):
            run["repeat_count"] += 1
            return
        self._end_run()
        self.s["run"] = {**event, "repeat_count": 1}

    def _line(self, events: list[dict]) -> None:
        if self.s["cut"]:
            return
        self.s["used"] += events[0]["n_bytes"]
        if self.max_bytes is not None and self.s["used"] > self.max_bytes:
            self.s["cut"] = True
            text = f"Output truncated: exceeded {self.max_bytes} byte limit"
            blank = dict.fromkeys(CARRIED)
            self._event({**blank, "line_no": events[0]["line_no"], "tier": "system", "type": "system",
                         "severity": "warning", "message": text, "noise": False, "context": False,
                         "keeps": False})
            return
        for event in sorted(events, key=lambda e: e["idx"]):
            self._event(event)

    def feed(self, events: list[dict]) -> None:
        """Take lines in any order; each is worked on once all lines before it are there."""
        if self.s["cut"]:
            return
        early = self.s["early"]
        for event in events:
            early.setdefault(str(event["line_no"]), []).append(event)
        while str(self.s["next"]) in early:
            self._line(early.pop(str(self.s["next"])))
            self.s["next"] += 1

    def finish(self) -> None:
        """End of the task: work on what is left, gaps or not, and flush."""
        for key in sorted(self.s["early"], key=int):
            self._line(self.s["early"].pop(key))
        self._end_run()
        if self.s["pair"]:
            waiting, self.s["pair"] = self.s["pair"], None
            self._absorb(waiting)
        if self.s["head"]:
            self._emit(self.s["head"])


NAMES = [column.strip().split(" ")[0] for column in OUTPUT.split(", ")]
EVENT = (
    "line_no long, idx long, n_bytes long, tier string, type string, severity string, code string, message string, "
    "file string, line long, col long, noise boolean, context boolean, keeps boolean, repeat_count long, paired boolean, kind string"
)
FIELDS = [column.strip().split(" ")[0] for column in EVENT.split(", ")]
INPUT = FIELDS[: FIELDS.index("repeat_count")]
CLOSED_MS = 86_400_000


class _Merge(Timed):
    """What an open task needs, field by field: progress, the open run, pair and diagnostic, its context lines,
    and lines that came early; of a closed one a mark, so that late lines open no second task."""

    def __init__(self, max_bytes: int | None, idle_ms: int | None, closed_ms: int | None):
        self.max_bytes, self.idle_ms, self.closed_ms = max_bytes, idle_ms, closed_ms

    def init(self, handle):
        super().init(handle)
        self.progress = handle.getValueState("progress", "next long, used long, cut boolean, seq long, early long, total long")
        self.open = {name: handle.getValueState(name, EVENT) for name in ("run", "pair", "head")}
        self.context = handle.getListState("context", "text string")
        self.early = handle.getMapState("early", "line_no long", f"events array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>")
        self.closed = handle.getValueState("closed", "yes boolean", self.closed_ms)

    def _load(self):
        # each question to the state is a round trip: a task that is new has nothing to ask for
        before = self.progress.get()
        self.known, known = before is not None, before or (1, 0, False, 0, 0, None)
        state = dict(zip(("next", "used", "cut", "seq"), known))
        for name, value in self.open.items():
            held = value.get() if self.known else None
            state[name] = dict(zip(FIELDS, held)) if held else None
        self.had = {name for name in self.open if state[name]}
        if state["head"]:
            state["head"] |= {"context_after": [], "stored": True}
        merge = TaskMerge({**state, "early": {}}, self.max_bytes, lambda: [text for text, in self.context.get()])
        return merge, known[4], known[5]

    def _take(self, merge, line_no, events):
        if not merge.s["cut"]:
            merge._line(events)
        merge.s["next"] = line_no + 1

    def _output(self, merge, key):
        for event in merge.out:
            row = {**{n: event.get(n) for n in NAMES}, "task_id": key[0], "context_after": event.get("context_after") or None}
            yield Row(*NAMES)(*[row[n] for n in NAMES])

    def _save(self, merge, early, total):
        s = merge.s
        self.progress.update((s["next"], s["used"], s["cut"], s["seq"], early, total))
        for name, value in self.open.items():
            if s[name]:
                value.update(tuple(s[name].get(f) for f in FIELDS))
            elif name in self.had:
                value.clear()
        head = s["head"]
        texts = [(text,) for text in head["context_after"]] if head else []
        if self.known and not (head and head.get("stored")):
            self.context.clear()
        if texts:
            self.context.appendList(texts)

    def _finish(self, merge, key, held, early):
        """Work on the lines left, gaps or not: `held` ones and those that wait in the state, if any are `early`."""
        stored = self.early.iterator() if early else ()
        waiting = {n: [dict(zip(FIELDS, e)) for e in events] for (n,), (events,) in stored if n >= merge.s["next"]}
        for line_no, events in sorted({**waiting, **held}.items()):
            self._take(merge, line_no, events)
        merge.finish()
        yield from self._output(merge, key)
        if self.known:
            for value in (self.progress, self.context, self.early, *self.open.values()):
                value.clear()
        self.closed.update((True,))

    def handleInputRows(self, key, rows, timerValues):
        if self.closed.exists():
            return
        merge, early, total = self._load()
        held, ended = {}, False
        for row in rows:
            if row.type == "end":
                ended, total = ended or row.line is None, total if row.line is None else row.line
            elif row.line_no >= merge.s["next"]:
                held.setdefault(row.line_no, {})[row.idx] = {**row.asDict(), "paired": False, "repeat_count": 1, "kind": None}
        while held or early:
            line_no = merge.s["next"]
            if line_no in held:
                self._take(merge, line_no, list(held.pop(line_no).values()))
            elif early and self.early.containsKey((line_no,)):
                events, early = self.early.getValue((line_no,))[0], early - 1
                self.early.removeKey((line_no,))
                self._take(merge, line_no, [dict(zip(FIELDS, e)) for e in events])
            else:
                break
        if ended or total is not None and merge.s["next"] > total:
            yield from self._finish(merge, key, {n: list(events.values()) for n, events in held.items()}, early)
            self.stop_waiting()
            return
        for line_no, events in held.items():
            early += not self.early.containsKey((line_no,))
            self.early.updateValue((line_no,), ([tuple(e.get(f) for f in FIELDS) for e in events.values()],))
        self._save(merge, early, total)
        self.wait(timerValues.getCurrentProcessingTimeInMs())
        yield from self._output(merge, key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.progress.exists():
            merge, early, _ = self._load()
            yield from self._finish(merge, key, {}, early)
        self.stop_waiting(delete=False)


def stream_merge(
    events: DataFrame, max_bytes: int | None = None, idle_ms: int | None = 600_000, closed_ms: int = CLOSED_MS
) -> DataFrame:
    """Merged events of parsed lines (with n_bytes, line_no, idx); rows of type `end` close a task.

    An end row that has the number of lines (in `line`) closes the task when these are there, in whatever
    order they and it come, lines sent twice counting once; one without closes it at once.  A task without an end row, or that lost a line,
    is closed after `idle_ms` without rows; with None it waits, so that a run over finite input can end.
    Rows of a closed task are dropped, for `closed_ms` with timers, so no seq comes twice.  A task's state is
    one pending run, pair and diagnostic with its context, and lines that came early; `max_bytes` cuts a task's output.
    """
    message = F.col("message")
    noise = (F.col("type") == "log") & is_noise(message)
    tagged = events.withColumns({"noise": noise, "context": is_context_line(message), "keeps": keeps_context_text(message)})
    tagged = tagged.select("task_id", *INPUT)
    processor = _Merge(max_bytes, idle_ms, closed_ms if idle_ms is not None else None)
    return with_state(tagged, "task_id", processor, OUTPUT, idle_ms is not None)


def end_rows(tasks: DataFrame, lines: Column | None = None) -> DataFrame:
    """One `end` row per finished task, shaped like parsed lines; `lines` is the number of its lines, if known."""
    blank: dict[str, Column] = {n: F.lit(None).cast("string") for n in ("tier", "severity", "code", "file")}
    return tasks.filter("status <> 'running'").select(
        "task_id", F.lit(0).cast("long").alias("line_no"), F.lit(0).cast("long").alias("idx"),
        F.lit(0).cast("long").alias("n_bytes"), F.lit("end").alias("type"), F.lit("").alias("message"),
        *[c.alias(n) for n, c in blank.items()],
        (F.lit(None) if lines is None else lines).cast("long").alias("line"), F.lit(None).cast("long").alias("col"),
    )
