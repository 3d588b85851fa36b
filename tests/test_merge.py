"""Segmented merge operators against a plain sequential state machine, with tiny segments."""

import random

import pytest
from pyspark.sql import functions as F

from suite.merge_cases import embed_context
from tracemill.operators import merge as M
from tracemill.plans.segments import running_total
from tracemill.plans.transducer import merge_events
from tracemill.streaming.merge import TaskMerge

SCHEMA = ("task_id string, line_no long, idx long, type string, severity string, code string, "
          "message string, file string, line long, col long, tier string")


def random_events(seed, tasks=12, most=40):
    rng, rows = random.Random(seed), []
    for t in range(tasks):
        for n in range(1, rng.randint(1, most) + 1):
            kind = rng.choice(["diagnostic", "diagnostic", "crash", "location", "location", "log", "log", "summary"])
            message = {"log": rng.choice(["| ctx", "plain", "= note: a", "|"]), "location": ""}.get(
                kind, rng.choice(["a", "a", "b"]))
            has_place = kind == "location" or rng.random() < 0.2
            rows.append((f"t{t}", n, 0, kind, "error", None, message,
                         rng.choice(["x", "y"]) if has_place else None, 1 if has_place else None, None, "rule"))
    return rows


def sequential(rows):
    """Expected final events per task, by the streaming state machine."""
    out = []
    for task in sorted({r[0] for r in rows}):
        merge = TaskMerge(None, 10**9)
        for r in rows:
            if r[0] == task:
                context = r[3] == "log" and (r[6].startswith("|") or r[6].startswith("= "))
                merge.feed([{**dict(zip(["line_no", "idx", "type", "severity", "code", "message", "file", "line",
                                         "col", "tier"], r[1:])), "n_bytes": 1, "noise": False,
                             "context": context, "keeps": r[6] != "|"}])
        merge.finish()
        out += [(task, e["seq"], e["line_no"], e["type"], e["message"], e["file"], e["repeat_count"], e["paired"],
                 tuple(e.get("context_after") or ())) for e in merge.out]
    return sorted(out)


@pytest.mark.parametrize("width", [1, 3, 7, None])
def test_segments_equal_state_machine(spark, width):
    rows = random_events(width or 99)
    events, order = spark.createDataFrame(rows, SCHEMA), ("line_no", "idx")
    merged = M.pair_locations(M.collapse_repeats(events, order, width), order, width)
    final = M.assign_seq(M.absorb_context(merged, order, width), order, width)
    got = sorted(
        (r.task_id, r.seq, r.line_no, r.type, r.message, r.file, r.repeat_count, r.paired, tuple(r.context_after or ()))
        for r in final.collect()
    )
    assert got == sequential(rows)


@pytest.mark.parametrize("width", [1, 2, 3, 7, 100])
@pytest.mark.parametrize("seed", [1, 2])
def test_one_pass_equals_state_machine(spark, width, seed):
    rows = random_events(100 * seed + width, tasks=25)
    # runs of one event over segments, alternations, and lines that are context only when repeated
    rng = random.Random(seed)
    for t in range(25, 60):
        pool = [("diagnostic", "a", None), ("location", "", "x"), ("location", "", "y"), ("log", "the trait", None), ("log", "| c", None), ("crash", "c", None)]
        n, pick = 0, pool[0]
        for _ in range(rng.randint(1, 40)):
            n, pick = n + 1, pick if rng.random() < 0.4 else rng.choice(pool[: rng.choice([2, 3, 6])])
            rows.append((f"t{t}", n, 0, pick[0], "error", None, pick[1], pick[2], 1 if pick[2] else None, None, "rule"))
    events, order = spark.createDataFrame(rows, SCHEMA), ("line_no", "idx")
    final = merge_events(events, order, width)
    steps = M.pair_locations(M.collapse_repeats(events, order, None), order, None)
    steps = M.assign_seq(M.absorb_context(steps, order, None), order, None)
    found = lambda df: sorted(
        (r.task_id, r.seq, r.line_no, r.type, r.message, r.file or "", r.repeat_count, r.paired, tuple(r.context_after or ())) for r in df.collect())
    assert found(final) == found(steps)
    assert sorted(final.columns) == sorted(steps.columns)


def test_long_runs_cross_many_segments(spark):
    base = spark.range(1, 1001).select(
        F.lit("t").alias("task_id"), F.col("id").alias("seq"), F.lit("log").alias("type"), F.lit("info").alias("severity"),
        F.lit(None).cast("string").alias("code"), F.when(F.col("id") <= 900, "same").otherwise("tail").alias("message"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("col"))
    rows = M.collapse_repeats(base, width=10).orderBy("seq").collect()
    assert [(r.seq, r.repeat_count, r.message) for r in rows] == [
        (1, 900, "same (repeated 900 times)"), (901, 100, "tail (repeated 100 times)")]


def test_alternation_parity_crosses_segments(spark):
    kind = F.when(F.col("id") % 2 == 1, "diagnostic").otherwise("location")
    events = spark.range(1, 100).select(
        F.lit("t").alias("task_id"), F.col("id").alias("seq"), kind.alias("type"), F.lit("error").alias("severity"),
        F.lit(None).cast("string").alias("code"), F.col("id").cast("string").alias("message"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("f"), "id")).alias("file"),
        F.when(F.col("id") % 2 == 0, F.col("id")).alias("line"), F.lit(None).cast("long").alias("col"))
    rows = M.pair_locations(events, width=5).orderBy("seq").collect()
    assert len(rows) == 50
    assert all(r.paired and r.file == f"f{r.seq + 1}" for r in rows[:-1])
    assert not rows[-1].paired


def test_running_total_over_segments(spark):
    df = spark.range(1, 501).select(F.lit("t").alias("task_id"), F.col("id").alias("line_no"))
    rows = running_total(df, F.col("line_no"), "total", ("line_no",), 7).collect()
    assert all(r.total == r.line_no * (r.line_no + 1) // 2 for r in rows)


def test_context_reaches_into_later_segments(spark):
    df = spark.range(1, 31).select(
        F.lit("t").alias("task_id"), F.col("id").alias("seq"),
        F.when(F.col("id") == 2, "diagnostic").otherwise("log").alias("type"), F.lit("error").alias("severity"),
        F.lit(None).cast("string").alias("code"), F.when(F.col("id") == 2, "bad").otherwise("| x").alias("message"),
        F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("line"), F.lit(None).cast("long").alias("col"))
    tagged = M.tag_context(df, width=4)
    assert M.surviving_events(tagged).count() == 2
    assert {r.head_seq for r in M.context_lines(tagged).collect()} == {2}


def test_embed_context_of_large_task(spark, tmp_path):
    """The registered query keeps all events of a task of more than 10 MiB."""
    lines = []
    for n in range(1, 451):  # each becomes a log event with its text as message, but every third a blank one
        parts = next(p for p in range(1000, 1010) if ((n // 2) * 7 + p) % 10 == 8)
        lines.append("x" * (40 * parts))
    spark.createDataFrame([(0, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = embed_context(spark, str(tmp_path))
    assert out.count() == 450 and out.agg(F.sum(F.length("message"))).first()[0] > 10 * 2**20
