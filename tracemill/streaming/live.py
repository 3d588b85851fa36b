"""Live operators: parsing, replay protection, notifications, status, sessions, counters.

All but the sinks also run on batch DataFrames, where they give the same rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.extract import escalate_stderr, parse_tagged_lines
from ..operators.lookup import diff_rules
from ..sources.rulepacks import Pack, load_packs, resolve_packs, to_dimensions
from .conditions import IDLE_MS
from .stateful import with_state

# ---- fixed values -------------------------------------------------------------------
REPLAY_TTL_SECONDS = 120
IDLE_GAP = "300 seconds"
MAX_TASK_MS = 3_600_000
NOTIFY_ROWS = 50
NOTIFY_WAIT_MS = 100
NOTIFY_TRIGGER = "100 milliseconds"
RELOAD_DEBOUNCE_SECONDS = 0.5
KINDS = {"TaskUpdate": "task/update", "TaskComplete": "task/complete",
         "Diagnostic": "task/diagnostic", "DaemonShutdown": "daemon/shutdown"}
# -------------------------------------------------------------------------------------


def stream_parse(lines: DataFrame, tasks: DataFrame, packs: Sequence[Pack], idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Parsed and escalated events of lines as they arrive; `tasks` is a static lookup.

    Rules with conditions put a task's lines in order; a lost one holds the others for `idle_ms` (None: for good).
    """
    tagged = lines.join(tasks.select("task_id", "parser_name"), "task_id", "left")
    return escalate_stderr(parse_tagged_lines(tagged, packs, idle_ms))


def fingerprint(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def dedup_requests(
    requests: DataFrame, key: str, ts: str, fields: Sequence[str], ttl_seconds: int = REPLAY_TTL_SECONDS
) -> DataFrame:
    """First of the requests with the same key and content within the time to live.

    The time counts from the request that was kept.  The state per (key, content) is that one
    time, so it works the same however the stream is cut into batches; it is dropped once the
    watermark is past it.
    """
    marked = requests.withColumn("fingerprint", fingerprint(*fields)).withColumn(
        "_us", F.unix_micros(ts)).withWatermark(ts, f"{ttl_seconds} seconds")
    ttl = ttl_seconds * 1_000_000
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields)

    def step(_, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        kept = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("_us", kind="stable")
        flags = []
        for now in rows["_us"]:
            fresh = kept is None or now - kept >= ttl
            kept = int(now) if fresh else kept
            flags.append(fresh)
        state.update((kept,))
        state.setTimeoutTimestamp(max((kept + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        yield rows[flags]

    return marked.groupBy(key, "fingerprint").applyInPandasWithState(
        step, schema, "kept bigint", "append", GroupStateTimeout.EventTimeTimeout
    ).drop("_us")


def to_notifications(bus: DataFrame) -> DataFrame:
    """Bus events (kind, connection_id, task_id, payload columns) as method and JSON params."""
    method = F.coalesce(*[F.when(F.col("kind") == k, m) for k, m in KINDS.items()])
    body = (
        F.when(F.col("kind") == "TaskUpdate", F.to_json(F.struct("task_id", "status")))
        .when(F.col("kind") == "TaskComplete", F.to_json(F.struct("task_id", "status", "exit_code")))
        .when(F.col("kind") == "Diagnostic",
              F.to_json(F.struct("task_id", F.struct("type", "severity", "message").alias("event"))))
        .otherwise("{}")
    )
    return bus.filter(F.col("kind").isin(list(KINDS))).select(
        "connection_id", "kind", method.alias("method"), body.alias("params"))


def notification_batches(events: DataFrame, rows: int = NOTIFY_ROWS) -> DataFrame:
    """Events in chunks of at most `rows` per task, each an ordered list of messages."""
    chunk = F.expr(f"(seq - 1) div {rows}")
    item = F.struct("seq", "type", "severity", "message")
    return events.groupBy("task_id", chunk.alias("chunk")).agg(
        F.to_json(F.array_sort(F.collect_list(item))).alias("events"), F.count(F.lit(1)).alias("n"))


class _Buffer(StatefulProcessor):
    """Messages of a task until there are `rows` of them or the first has waited `wait_ms`."""

    def __init__(self, rows: int, wait_ms: int):
        self.rows, self.wait_ms = rows, wait_ms

    def init(self, handle):
        self.handle = handle
        self.held = handle.getListState("held", "message string")
        self.count = handle.getValueState("count", "held int, chunk long, timer long")

    def _flush(self, key, messages, chunk):
        return Row(task_id=key[0], chunk=chunk, events=f"[{','.join(messages)}]", n=len(messages))

    def handleInputRows(self, key, rows, timerValues):
        held, chunk, timer = self.count.get() if self.count.exists() else (0, 0, None)
        fresh = []
        for row in rows:
            fresh.append(row.message)
            if held + len(fresh) == self.rows:
                yield self._flush(key, [*(m for m, in self.held.get()), *fresh] if held else fresh, chunk)
                if held:
                    self.held.clear()
                fresh, held, chunk = [], 0, chunk + 1
        if timer is not None and held == 0:
            self.handle.deleteTimer(timer)
            timer = None
        if fresh:
            self.held.appendList([(m,) for m in fresh])
            held += len(fresh)
            if timer is None:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
                self.handle.registerTimer(timer)
        self.count.update((held, chunk, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held, chunk, _ = self.count.get()
        if held:
            yield self._flush(key, [m for m, in self.held.get()], chunk)
            self.held.clear()
        self.count.update((0, chunk + (held > 0), None))

    def close(self) -> None:
        pass


def buffered_notifications(events: DataFrame, rows: int = NOTIFY_ROWS, wait_ms: int = NOTIFY_WAIT_MS) -> DataFrame:
    """Events of a stream in chunks per task: `rows` of them, or fewer after `wait_ms`, as they came."""
    message = F.to_json(F.struct("seq", "type", "severity", "message")).alias("message")
    return with_state(events.select("task_id", message), "task_id", _Buffer(rows, wait_ms),
                      "task_id string, chunk long, events string, n long", True)


def stream_notify(events: DataFrame, sink: Callable[[DataFrame], None], checkpoint: str, rows: int = NOTIFY_ROWS,
                  wait_ms: int = NOTIFY_WAIT_MS):
    """Start handing the chunks of `buffered_notifications` to `sink`, as they are complete."""
    return (
        buffered_notifications(events, rows, wait_ms).writeStream.option("checkpointLocation", checkpoint)
        .trigger(processingTime=NOTIFY_TRIGGER).foreachBatch(lambda df, _: sink(df)).start()
    )


def overflow_counts(dropped: DataFrame) -> DataFrame:
    """Notifications lost per connection."""
    return dropped.groupBy("connection_id").agg(F.sum("dropped").alias("overflow"))


def latest_status(updates: DataFrame) -> DataFrame:
    """Newest status per task, and whether it is final."""
    newest = F.max(F.struct("ts", "status")).alias("_last")
    return updates.groupBy("task_id").agg(newest).select(
        "task_id", F.col("_last.ts").alias("ts"), F.col("_last.status").alias("status"),
        (F.col("_last.status") != "running").alias("is_final"))


def detect_timeouts(tasks: DataFrame, requested_ms: Column, max_ms: int = MAX_TASK_MS) -> DataFrame:
    """Tasks that ran longer than allowed: min(requested, maximum), with their timeout status."""
    allowed = F.least(F.coalesce(requested_ms, F.lit(max_ms)), F.lit(max_ms)).cast("long")
    return tasks.withColumn("allowed_ms", allowed).filter(F.col("duration_ms") > F.col("allowed_ms")).select(
        "task_id", "duration_ms", "allowed_ms", F.lit("timeout").alias("status"), F.lit(-2).alias("exit_code"))


class _Timeouts(StatefulProcessor):
    """The end of a running task's allowance as a timer, which its final status takes back."""

    def init(self, handle):
        self.handle = handle
        self.running = handle.getValueState("running", "started long, allowed long, timer long")

    def handleInputRows(self, key, rows, timerValues):
        now, final, first = timerValues.getCurrentProcessingTimeInMs(), False, None
        for row in rows:
            final = final or row.final
            first = row if first is None or row.started < first.started else first
        if self.running.exists():
            if final:
                self.handle.deleteTimer(self.running.get()[2])
                self.running.clear()
        elif not final:
            timer = max(now + 1, first.started + first.allowed)
            self.handle.registerTimer(timer)
            self.running.update((first.started, first.allowed, timer))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        started, allowed, _ = self.running.get()
        self.running.clear()
        duration = timerValues.getCurrentProcessingTimeInMs() - started
        yield Row(task_id=key[0], duration_ms=duration, allowed_ms=allowed, status="timeout", exit_code=-2)

    def close(self) -> None:
        pass


def stream_timeouts(updates: DataFrame, requested_ms: Column, max_ms: int = MAX_TASK_MS) -> DataFrame:
    """Tasks of a stream of (task_id, status, started_at) that ran longer than allowed without a final status.

    A task is reported when its allowance ends, though no row of it ever comes again.
    """
    allowed = F.least(F.coalesce(requested_ms, F.lit(max_ms)), F.lit(max_ms)).cast("long").alias("allowed")
    rows = updates.select("task_id", (F.col("status") != "running").alias("final"), F.unix_millis("started_at").alias("started"), allowed)
    return with_state(rows, "task_id", _Timeouts(), "task_id string, duration_ms long, allowed_ms long, status string, exit_code int", True)


def activity_sessions(activity: DataFrame, key: str, ts: str, gap: str = IDLE_GAP) -> DataFrame:
    """Sessions per key that end after `gap` without activity."""
    if activity.isStreaming:
        activity = activity.withWatermark(ts, gap)
    session = F.session_window(F.col(ts), gap)
    return activity.groupBy(F.col(key), session.alias("w")).agg(F.count(F.lit(1)).alias("actions")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "actions")


def live_counters(tasks: DataFrame) -> DataFrame:
    """Created, completed and failed tasks, events, and tasks per carrier, over all so far."""
    status = F.col("status")
    carriers = ["shell", "shell_composite", "python", "script_other"]
    return tasks.groupBy().agg(
        F.count(F.lit(1)).alias("created"), F.count_if(status == "completed").alias("completed"),
        F.count_if(status.isin("failed", "timeout", "killed")).alias("failed"),
        F.sum("events_count").alias("events"),
        *[F.count_if(F.col("carrier") == c).alias(f"carrier_{c}") for c in carriers],
    )


class RuleCatalog:
    """Rule packs of user folders, re-read between micro-batches when the files changed."""

    def __init__(self, dirs: Sequence[str] = ()):
        self.dirs = list(dirs)
        self._seen = self._marks()
        self._checked = time.monotonic()
        self.packs = resolve_packs(load_packs(self.dirs))

    def _marks(self):
        files = [p for d in self.dirs for p in sorted(Path(d).expanduser().glob("*.toml"))]
        return [(str(p), p.stat().st_mtime_ns, p.stat().st_size) for p in files]

    def refresh(self, spark) -> DataFrame | None:
        """Reload if something changed; the rule difference then, else None."""
        now = time.monotonic()
        if now - self._checked < RELOAD_DEBOUNCE_SECONDS:
            return None
        self._checked, marks = now, self._marks()
        if marks == self._seen:
            return None
        old, self._seen = self.packs, marks
        self.packs = resolve_packs(load_packs(self.dirs))
        return diff_rules(to_dimensions(spark, old)[1], to_dimensions(spark, self.packs)[1])


def stream_with_reload(
    lines: DataFrame, tasks: DataFrame, catalog: RuleCatalog, sink: Callable[[DataFrame, DataFrame | None], None], checkpoint: str, **trigger
):
    """Start parsing each micro-batch with the rules that are current when it begins.

    `sink` gets the events and, when the packs changed since the batch before, the difference of their rules.
    """

    def step(batch: DataFrame, _):
        changed = catalog.refresh(batch.sparkSession)
        sink(stream_parse(batch, tasks, catalog.packs), changed)

    return lines.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": NOTIFY_TRIGGER})).foreachBatch(step).start()
