"""Streams cut into several batches give the batch result."""

import datetime
import json
import random
import time

from pyspark.sql import functions as F

from tracemill.operators import extract
from tracemill.plans.structure import structure_output
from tracemill.sources.rulepacks import Pack, Rule, load_packs, resolve_packs
from tracemill.streaming import live, merge

LINES = "task_id string, line_no long, source string, text string, n_bytes long"


def test_out_of_order_lines_over_batches(spark, tmp_path):
    texts = ["error[E0308]: mismatched", "  --> a.rs:1:2", "   | expected", "again", "again", "warning: w",
             "warning: w", "  --> b.rs:3:4", "done"]
    rows = [(t, n, "stdout", s, len(s) + 1) for t in ("p", "q") for n, s in enumerate(texts, 1)]
    packs = [p for p in resolve_packs(load_packs()) if p.name == "cargo"]
    tasks = spark.createDataFrame([("p", "cargo"), ("q", "cargo")], "task_id string, parser_name string")
    for i, part in enumerate([rows[1::2], rows[::2]]):
        spark.createDataFrame(part, LINES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    end = [(t, 0, "end", "", 0) for t in ("p", "q")]
    spark.createDataFrame(end, LINES).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    parsed = live.stream_parse(lines, tasks, packs).drop("source")
    parsed = parsed.withColumn("type", F.when(F.col("line_no") == 0, "end").otherwise(F.col("type")))
    out = merge.stream_merge(parsed, idle_ms=None)
    query = (out.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(90)
    assert query.exception() is None
    key = ["task_id", "seq", "type", "message", "file", "line", "repeat_count", "context_after"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*key).orderBy("task_id", "seq").collect()
    want = structure_output(spark.createDataFrame(rows, LINES), tasks, packs).select(*key).orderBy("task_id", "seq").collect()
    assert got == want and len(got) == 8


def parsed_parts(spark, tmp_path, parts):
    """Parsed lines of one file a micro-batch; rows of type `end` have line_no 0 and the count in n_bytes."""
    packs = [p for p in resolve_packs(load_packs()) if p.name == "cargo"]
    tasks = spark.createDataFrame([(t, "cargo") for t in "pqrs"], "task_id string, parser_name string")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, LINES).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    lines = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    parsed = live.stream_parse(lines, tasks, packs).drop("source")
    end = F.col("line_no") == 0
    return parsed.withColumns({"type": F.when(end, "end").otherwise(F.col("type")),
                               "line": F.when(end & (F.col("n_bytes") > 0), F.col("n_bytes")).when(~end, F.col("line"))}), tasks, packs


def run(df, tmp_path, until=None, **trigger):
    query = (df.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(**(trigger or {"availableNow": True})).start())
    if until is None:
        query.awaitTermination(120)
    else:
        last = time.time() + 90
        while time.time() < last and query.isActive and not until():
            time.sleep(0.5)
        query.stop()
    assert query.exception() is None
    return df.sparkSession.read.schema(df.schema).parquet(str(tmp_path / "out"))


TEXTS = ["error[E0308]: mismatched", "  --> a.rs:1:2", "   | expected", "again", "again", "warning: w", "warning: w", "  --> b.rs:3:4",
         "   | one", "   | two", "   | three", "done"]
KEY = ["task_id", "seq", "line_no", "type", "message", "file", "line", "repeat_count", "paired", "context_after"]


def lines_of(tasks, lost=()):
    return [(t, n, "stdout", s, len(s) + 1) for t in tasks for n, s in enumerate(TEXTS, 1) if (t, n) not in lost]


def batch_rows(spark, rows, tasks, packs):
    return structure_output(spark.createDataFrame(rows, LINES), tasks, packs).select(*KEY).orderBy("task_id", "seq").collect()


def test_end_before_lines(spark, tmp_path):
    """End rows with a line count come first, lines over many batches and in any order, some twice and some late."""
    rows = lines_of("pq")
    ends = [(t, 0, "end", "", len(TEXTS)) for t in "pq"]
    parts = [ends[:1] + rows[20:], rows[10:20], rows[5:10] + rows[8:12], ends[1:], rows[:5], rows[3:15], rows]
    parsed, tasks, packs = parsed_parts(spark, tmp_path, parts)
    got = run(merge.stream_merge(parsed, idle_ms=None), tmp_path).select(*KEY).orderBy("task_id", "seq").collect()
    assert got == batch_rows(spark, rows, tasks, packs)
    assert len({(r.task_id, r.seq) for r in got}) == len(got)


def test_lost_line(spark, tmp_path):
    """A task that lost a line is closed by the timer, with the rest; rows that come after it change nothing."""
    rows = lines_of("pq", lost={("p", 4)})
    parts = [rows[:8], [("p", 0, "end", "", len(TEXTS)), ("q", 0, "end", "", len(TEXTS))], rows[8:]]
    parsed, tasks, packs = parsed_parts(spark, tmp_path, parts)
    want = batch_rows(spark, rows, tasks, packs)
    merged = merge.stream_merge(parsed, idle_ms=6_000)
    read = lambda: spark.read.schema(merged.schema).parquet(str(tmp_path / "out")).count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
    got = run(merged, tmp_path, until=lambda: read() >= len(want), processingTime="500 milliseconds")
    assert got.select(*KEY).orderBy("task_id", "seq").collect() == want


def test_conditions_on_streams(spark, tmp_path):
    """Lines in any order over batches give the rules of the batch; a lost line holds the others till the timer."""
    rules = (Rule("open", "summary", "info", "^begin (.+)", {"message": 1}, state_transition="in=yes"),
             Rule("inside", "diagnostic", "error", "^bad (.+)", {"message": 1}, state_condition="in=yes"),
             Rule("close", "summary", "info", "^end (.+)", {"message": 1}, state_condition="in=yes", state_transition="in=no"))
    pack, words = Pack("p", rules, stateful=True), ["bad", "begin", "bad", "bad", "end", "bad", "end", "begin", "x", "bad"]
    schema = "task_id string, line_no long, source string, text string, parser_name string"
    rows = [(t, n, "stdout", f"{w} {n}", "p" if t != "w" else "none") for t in "uvw" for n, w in enumerate(words * 2, 1)]
    random.Random(3).shuffle(rows)
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    lines = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = run(extract.parse_tagged_lines(lines, [pack], idle_ms=None), tmp_path)
    want = extract.parse_tagged_lines(spark.createDataFrame(rows, schema), [pack])
    key = ["task_id", "line_no", "idx", "tier", "type", "message"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, want.select(*key).collect()))
    assert got.filter("tier = 'stateful'").count() > 10


def test_timeouts_on_streams(spark, tmp_path):
    """A task of which only its start is known is reported; one that ended in time is not."""
    schema = "task_id string, status string, started_at timestamp"
    now = datetime.datetime.now(datetime.timezone.utc)
    for i, part in enumerate([[("a", "running", now), ("b", "running", now)], [("b", "completed", now)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    updates = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = live.stream_timeouts(updates, F.lit(15_000), 60_000)
    read = lambda: spark.read.schema(out.schema).parquet(str(tmp_path / "out")).count() if (tmp_path / "out" / "_spark_metadata").exists() else 0
    rows = run(out, tmp_path, until=lambda: read() > 0, processingTime="500 milliseconds").collect()
    assert [(r.task_id, r.allowed_ms, r.status, r.exit_code) for r in rows] == [("a", 15_000, "timeout", -2)] and rows[0].duration_ms >= 15_000


def test_rules_reload_between_batches(spark, tmp_path):
    """A pack file that comes between two batches is used by the second."""
    packs, source = tmp_path / "packs", tmp_path / "in"
    packs.mkdir()
    lines = [("t", n, "stdout", f"oops {n}", 7) for n in range(1, 5)]
    spark.createDataFrame(lines[:2], LINES).coalesce(1).write.parquet(str(source / "0"))
    tasks = spark.createDataFrame([("t", "mine")], "task_id string, parser_name string")
    stream = spark.readStream.schema(LINES).parquet(str(source / "*"))
    seen, catalog = [], live.RuleCatalog([str(packs)])
    query = live.stream_with_reload(
        stream, tasks, catalog, lambda df, diff: seen.append((df.select("line_no", "tier", "type").collect(), None if diff is None else diff.count())),
        str(tmp_path / "cp"), processingTime="200 milliseconds")
    query.processAllAvailable()
    (packs / "mine.toml").write_text('[meta]\nname = "mine"\n[[pattern]]\nname = "o"\nregex = "^oops (.+)"\nevent_type = "diagnostic"\nseverity = "error"\n')
    time.sleep(live.RELOAD_DEBOUNCE_SECONDS + 0.2)
    spark.createDataFrame(lines[2:], LINES).coalesce(1).write.parquet(str(source / "1"))
    query.processAllAvailable()
    query.stop()
    (first, none), (second, changed) = seen
    assert {(r.tier, r.type) for r in first} == {("raw", "log")} and none is None
    assert {(r.tier, r.type) for r in second} == {("rule", "diagnostic")} and changed == 1


def test_sessions_equal_batch(spark, tmp_path):
    rows = [("u", s) for s in (0, 100, 500, 1000, 1200)]
    df = spark.createDataFrame(rows, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts"))
    got = live.activity_sessions(df, "key", "ts").orderBy("session_start").collect()
    assert [r.actions for r in got] == [2, 1, 2]


def test_notifications_reach_the_sink_in_chunks(spark, tmp_path):
    """Chunks of 50 at once, what is left after the wait; all messages once and in order."""
    schema = "task_id string, seq long, type string, severity string, message string"
    rows = [("t", n, "log", "info", f"m{n}") for n in range(1, 121)]
    for i in range(3):
        spark.createDataFrame(rows[40 * i : 40 * i + 40], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    seen = []
    query = live.stream_notify(events, lambda df: seen.extend(df.collect()), str(tmp_path / "cp"), wait_ms=15_000)
    last = time.time() + 90
    while sum(r.n for r in seen) < 120 and time.time() < last:
        time.sleep(0.3)
    query.stop()
    assert [(r.chunk, r.n) for r in seen] == [(0, 50), (1, 50), (2, 20)]
    assert [e["message"] for r in seen for e in json.loads(r.events)] == [f"m{n}" for n in range(1, 121)]
    batch = live.notification_batches(spark.createDataFrame(rows, schema)).orderBy("chunk").collect()
    assert [r.events for r in batch] == [r.events for r in seen]


def test_replay_window_over_batches(spark, tmp_path):
    schema = "client string, at timestamp, body string"
    base = 1_700_000_000
    for i, seconds in enumerate([(0, 60, 119), (130, 200, 260)]):
        spark.createDataFrame([("c", s, "x") for s in seconds], "client string, s long, body string").select(
            "client", F.timestamp_seconds(F.col("s") + base).alias("at"), "body"
        ).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    kept = live.dedup_requests(stream, "client", "at", ["body"])
    query = (kept.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(90)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "out")).select(F.unix_seconds("at").alias("s")).collect()
    assert sorted(r.s - base for r in got) == [0, 130, 260]


def test_a_new_task_asks_its_state_little():
    """Each question to the state is a round trip; a task that comes and ends in one batch has nothing there."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row

    from tracemill.streaming.merge import INPUT, _Merge

    handle, states = MagicMock(), {}

    def state(name, *_):
        states[name] = MagicMock(**{"get.return_value": None, "exists.return_value": False, "iterator.return_value": iter(())})
        return states[name]

    handle.getValueState = handle.getListState = handle.getMapState = state
    processor = _Merge(None, None, None)
    processor.init(handle)
    blank = dict.fromkeys(INPUT) | {"idx": 0, "n_bytes": 1, "noise": False, "context": False, "keeps": False}
    rows = [Row(*INPUT)(*{**blank, **r}.values()) for r in (
        {"line_no": 3, "type": "log", "message": "c"}, {"line_no": 1, "type": "log", "message": "a"},
        {"line_no": 0, "type": "end", "line": None})]
    out = list(processor.handleInputRows(("t",), iter(rows), None))
    assert [(r.seq, r.message) for r in out] == [(1, "a"), (2, "c")]
    assert sum(len(s.method_calls) for s in states.values()) == 3
