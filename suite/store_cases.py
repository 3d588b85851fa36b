"""S, R3, A12: readers and writers, over files that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from suite.audit_cases import BASE, SHAPES, commands, pick
from suite.scratch import folder
from suite.stats_cases import STATS_SQL
from suite.views import table, view, with_views
from tracemill.operators import audit, stats
from tracemill.sources import rulepacks, store
from tracemill.sources.commits import read_committed
from tracemill.sources.ranges import write_lines


def task_lines(spark, sf):
    """Tasks as JSON rows: an outdated row before each, and a broken row for some."""
    tasks = view(spark, sf, "tasks_v").select(
        "task_id", "command", "status", "exit_code", "duration_ms", "events_count")
    new = F.to_json(F.struct(*tasks.columns))
    old = F.concat(F.lit('{"task_id":"'), "task_id", F.lit('","status":"running"}'))
    bad = F.when(F.col("task_id").cast("long") % 50 == 0, F.concat(F.lit('{"task_id": "x'), "task_id"))
    return tasks.select(F.explode(F.array_compact(F.array(old, bad, new))).alias("value"))


def tasks_path(spark, sf):
    path = folder(spark, "tasks")
    task_lines(spark, sf).write.text(path)
    return path


def read_tasks(spark, sf):
    tasks, _ = store.read_tasks(spark, tasks_path(spark, sf))
    return tasks.select("task_id", "command", "status", "exit_code", "duration_ms", "events_count")


def quarantine(spark, sf):
    _, corrupt = store.read_tasks(spark, tasks_path(spark, sf))
    return corrupt.select("value")


def write_tasks(spark, sf):
    """Read, write a snapshot with the corrupt rows, and read that again."""
    tasks, corrupt = store.read_tasks(spark, tasks_path(spark, sf))
    path = folder(spark, "snapshot")
    store.write_tasks(tasks, path, corrupt)
    again, bad = store.read_tasks(spark, store.current_tasks_path(spark, path))
    return again.select("task_id", F.lit("task").alias("kind")).unionByName(
        bad.select(F.col("value").alias("task_id"), F.lit("corrupt").alias("kind")))


def write_events(spark, sf):
    """Append events by day and read them back."""
    path = folder(spark, "events")
    events = view(spark, sf, "merge_v")
    store.write_events(events, path, F.concat(F.lit("2024-01-0"), (F.col("seq") % 5 + 1).cast("string")))
    rows = read_committed(spark, path, "value string", "text").withColumn("row", F.from_json("value", f"task_id string, {store.EVENT_JSON}"))
    return rows.select("row.task_id", *store.flat_event("row")).drop("context_after")


def read_events(spark, sf):
    """Task ids come from file names, here those of the written partitions."""
    path = folder(spark, "event-files")
    events = view(spark, sf, "merge_v")
    broken = F.when(F.col("seq") % 40 == 0, F.lit("{broken")).otherwise(store.event_json())
    events.select(broken.alias("value")).write.text(path)
    good, corrupt = store.read_events(spark, path)
    return good.drop("task_id", "context_after").unionByName(
        corrupt.select(F.lit("corrupt").alias("type"), F.col("value").alias("message")), allowMissingColumns=True)


def read_raw(spark, sf):
    path = folder(spark, "raw")
    table(spark, sf, "documents").select("text").write.text(path)
    lines = store.read_raw(spark, path)
    again = F.count(F.lit(1)).over(Window.partitionBy("task_id", "line_no"))
    return lines.select("text", "n_bytes", again.alias("at_its_place"))


def read_agent_events(spark, sf):
    path = folder(spark, "agent")
    rows = table(spark, sf, "conversations").select(F.explode(F.array(
        F.to_json(F.struct(F.lit("item.completed").alias("type"), F.struct(
            F.lit("command_execution").alias("type"), F.col("role").alias("command")).alias("item"))),
        F.lit("not json"), F.lit('{"type":"item.started"}'))).alias("value"))
    rows.write.text(f"{path}/job1__shell")
    out = store.read_agent_events(spark, path)
    return out.groupBy("task_id", "mode", "kind", "command").agg(F.count(F.lit(1)).alias("n"))


def write_audit(spark, sf):
    path = folder(spark, "audit")
    store.write_audit(audit.audit_log(commands(spark, sf)), path)
    return read_committed(spark, path, "task_id string, blocked boolean, exit_code int")


def write_metrics_snapshot(spark, sf):
    path = folder(spark, "metrics")
    report = stats.stats_report(view(spark, sf, "tasks_v"), view(spark, sf, "events_v"))
    store.write_metrics_snapshot(report, path, "2024-01-01", {"corpus": "tasks_v", "excluded": "none"})
    saved = read_committed(spark, path, "section string, metric string, value double, provenance string, snapshot_date date")
    return saved.select("section", "metric", "value", "provenance", F.col("snapshot_date").cast("string"))


def rule_usage(spark, sf):
    """Loaded rule dimension joined to the tasks that use it."""
    parsers, rules = rulepacks.load_rules(spark)
    used = view(spark, sf, "tasks_v").groupBy("parser_name").agg(F.count(F.lit(1)).alias("tasks"))
    counts = rules.groupBy("parser").agg(F.count(F.lit(1)).alias("rules"))
    return used.join(counts, used.parser_name == counts.parser).join(
        parsers.select(F.col("name").alias("parser"), "priority"), "parser").select("parser", "tasks", "rules", "priority")


def code_ref_usage(spark, sf):
    refs = rulepacks.load_code_refs(spark).select("tool", "code")
    codes = table(spark, sf, "lineitem").selectExpr("CAST(l_partkey % 150 AS STRING) AS code")
    return codes.groupBy("code").agg(F.count(F.lit(1)).alias("n")).join(refs, "code")


def integrity_report(spark, sf):
    events = folder(spark, "event-files")
    row = F.when(F.col("seq") % 40 == 0, F.concat(F.lit("{broken "), "task_id")).otherwise(store.event_json())
    view(spark, sf, "merge_v").select(row.alias("value")).write.text(events)
    return store.integrity_report(spark, tasks_path(spark, sf), events).select("kind", "value")


def store_size(spark, sf):
    """Of the documents' texts, written as four files by all tasks."""
    path = folder(spark, "sized")
    write_lines(F.col("text"), table(spark, sf, "documents"), path, 4)
    return store.store_size(spark, path)


BAD = """SELECT '{"task_id": "x' || task_id AS value FROM tasks_v WHERE CAST(task_id AS BIGINT) % 50 = 0"""
PACK_RULES = {"cargo": 9, "python": 9, "go": 4, "npm": 5, "eslint": 5}
CASES = {
    "s1_read_tasks": (read_tasks, with_views(
        "SELECT task_id, command, status, exit_code, duration_ms, events_count FROM tasks_v", "tasks_v")),
    "s2_read_events": (read_events, with_views(
        """SELECT CASE WHEN broken THEN NULL ELSE seq END AS seq, CASE WHEN broken THEN 'corrupt' ELSE type END AS type,
             CASE WHEN NOT broken THEN severity END AS severity, CASE WHEN NOT broken THEN code END AS code,
             CASE WHEN broken THEN '{broken' ELSE message END AS message, CASE WHEN NOT broken THEN file END AS file,
             CASE WHEN NOT broken AND file IS NOT NULL THEN line END AS line, CAST(NULL AS BIGINT) AS col
           FROM (SELECT *, seq % 40 = 0 AS broken FROM merge_v) m""", "merge_v")),
    "s3_quarantine": (quarantine, with_views(BAD, "tasks_v")),
    "s4_read_raw": (read_raw, """SELECT CASE WHEN ends_with(x, chr(13)) THEN left(x, -1) ELSE x END AS text,
        CAST(strlen(x) + 1 AS BIGINT) AS n_bytes, CAST(1 AS BIGINT) AS at_its_place
        FROM (SELECT unnest(string_split(text, chr(10))) AS x FROM documents) t"""),
    "s5_load_rules": (rule_usage, with_views(
        "SELECT parser_name AS parser, count(*) AS tasks, CASE parser_name " + " ".join(
            f"WHEN '{p}' THEN {n}" for p, n in PACK_RULES.items())
        + " END AS rules, 50 AS priority FROM tasks_v WHERE parser_name IS NOT NULL GROUP BY 1", "tasks_v")),
    "s6_load_code_refs": (code_ref_usage, """
        SELECT c.code, n, tool FROM (SELECT CAST(l_partkey % 150 AS STRING) AS code, count(*) AS n FROM lineitem GROUP BY 1) c
        JOIN (VALUES ('aws', '1'), ('aws', '2'), ('aws', '130'), ('docker', '125'), ('docker', '126'), ('docker', '127'),
          ('docker', '130'), ('docker', '137'), ('docker', '143'), ('kubectl', '1'), ('kubectl', '2'), ('kubectl', '130')) r(tool, code)
        ON r.code = c.code"""),
    "s7_read_agent_events": (read_agent_events,
        "SELECT 'job1' AS task_id, 'shell' AS mode, 'shell' AS kind, role AS command, count(*) AS n FROM conversations GROUP BY role"),
    "s9_write_events": (write_events, with_views("SELECT * FROM merge_v", "merge_v")),
    "s10_write_tasks": (write_tasks, with_views(
        f"SELECT task_id, 'task' AS kind FROM tasks_v UNION ALL SELECT value, 'corrupt' FROM ({BAD}) b", "tasks_v")),
    "s11_write_audit": (write_audit, f"""SELECT task_id, blocked, CASE WHEN NOT blocked THEN CAST(CAST(task_id AS BIGINT) % 2 AS INTEGER) END AS exit_code
        FROM (SELECT task_id, {pick([str(bool(s[5] or s[6])).lower() for s in SHAPES])} AS blocked FROM ({BASE}) b) c"""),
    "s12_write_metrics_snapshot": (write_metrics_snapshot, with_views(
        f"""SELECT *, '2024-01-01' AS snapshot_date, '{{"corpus": "tasks_v", "excluded": "none"}}' AS provenance FROM ({STATS_SQL}) s""",
        "tasks_v", "events_v")),
    "r3_integrity_report": (integrity_report, with_views(
        f"SELECT 'task' AS kind, value FROM ({BAD}) b UNION ALL SELECT 'event', '{{broken ' || task_id FROM merge_v WHERE seq % 40 = 0", "tasks_v", "merge_v")),
    "a12_store_size": (store_size, "SELECT CAST(4 AS BIGINT) AS files, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes FROM documents"),
}
