"""T: streaming; streams read the given files and are run to the end of their input."""

from __future__ import annotations

import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

from suite import condition_cases as C
from suite import extract_cases as X
from suite.scratch import run_append, run_latest
from suite.views import stream, table, view, with_views
from tracemill.operators import merge as M
from tracemill.operators.extract import apply_line_rules, parse_tagged_lines
from tracemill.streaming import live as L
from tracemill.streaming import merge as SM


def lines_stream(spark, sf):
    return view(spark, sf, "lines_v", stream)


def stream_parse(spark, sf):
    lines = lines_stream(spark, sf).drop("n_bytes")
    return run_append(spark, L.stream_parse(lines, view(spark, sf, "tasks_v"), X.TASK_PACKS), "parse")


def stream_merge(spark, sf):
    """All lines, and an end row per task with the number of its lines, in one stream."""
    parsed = L.stream_parse(lines_stream(spark, sf), view(spark, sf, "tasks_v"), X.TASK_PACKS)
    ends = SM.end_rows(stream(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.lit("completed").alias("status"), "text"), F.size(F.split("text", "\n")))
    rows = parsed.drop("source").unionByName(ends)
    out = run_append(spark, SM.stream_merge(rows, idle_ms=None), "merge")
    return out.withColumn("context_after", F.array_join("context_after", "|"))


def requests(df):
    """Actions rounded so that equal requests repeat within seconds."""
    return df.select(
        (F.col("user_id") % 3).alias("client"), F.col("ts").cast("timestamp").alias("at"), "event_type")


def dedup_requests(spark, sf):
    kept = L.dedup_requests(requests(stream(spark, sf, "events")), "client", "at", ["event_type"], 3600)
    return run_append(spark, kept, "replay").select("client", "event_type", F.unix_micros("at").alias("us"))


def notification_batches(spark, sf):
    events = M.assign_seq(view(spark, sf, "merge_v").withColumnRenamed("seq", "line_no"), ("line_no",))
    return L.notification_batches(events).select("task_id", "chunk", "n")


def bus(spark, sf):
    return table(spark, sf, "events").selectExpr(
        "user_id AS connection_id", "CAST(event_id AS STRING) AS task_id", "'failed' AS status", "CAST(1 AS INT) AS exit_code",
        "'diagnostic' AS type", "'error' AS severity", "event_type AS message",
        "CASE event_id % 5 WHEN 0 THEN 'TaskUpdate' WHEN 1 THEN 'TaskComplete' WHEN 2 THEN 'Diagnostic' WHEN 3 THEN 'DaemonShutdown' ELSE 'StreamOutput' END AS kind",
        "event_id % 4 AS dropped")


def to_notifications(spark, sf):
    return L.to_notifications(bus(spark, sf))


def overflow_counts(spark, sf):
    dropped = stream(spark, sf, "events").selectExpr("user_id AS connection_id", "event_id % 4 AS dropped")
    return run_latest(spark, L.overflow_counts(dropped), "overflow")


STATUS = "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'running' END"


def latest_status(spark, sf):
    updates = stream(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS task_id", "ts", f"{STATUS} AS status")
    return run_latest(spark, L.latest_status(updates), "status")


def detect_timeouts(spark, sf):
    limit = F.when(F.col("task_id").cast("long") % 3 > 0, F.col("task_id").cast("long") % 3 * 40_000)
    return L.detect_timeouts(view(spark, sf, "tasks_v"), limit, 60_000)


def activity_sessions(spark, sf):
    activity = view(spark, sf, "activity_v").withColumn("ts", F.col("ts").cast("timestamp"))
    out = L.activity_sessions(activity, "key", "ts", "3600 seconds")
    return out.select("key", "actions", F.unix_micros("session_start").alias("start_us"),
                      F.unix_micros("session_end").alias("end_us"))


def live_counters(spark, sf):
    return run_latest(spark, L.live_counters(view(spark, sf, "tasks_v", stream)), "counters")


#: A user pack that takes the place of a bundled one while a run goes on.
NEW_PACK = X.LINE_PACKS[0].name
NEW_RULE = '[meta]\nname = "{}"\npriority = 1000\n[[pattern]]\nname = "all"\nregex = "^(.+)"\nevent_type = "summary"\nseverity = "info"\nfields = {{message = 1}}\n'


def hot_reload(spark, sf):
    """The lines parsed before and after a pack file came; the driver alone reads the folder."""
    home = Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    catalog, lines = L.RuleCatalog([str(home)]), X.plain_lines(spark, sf, X.LINE_PACKS)
    old = apply_line_rules(lines, catalog.packs).withColumn("version", F.lit(1))
    (home / "new.toml").write_text(NEW_RULE.format(NEW_PACK))
    while catalog.refresh(spark) is None:
        time.sleep(0.1)
    new = apply_line_rules(lines, catalog.packs).withColumn("version", F.lit(2))
    return old.unionByName(new).groupBy("version", "parser_name", "type").agg(F.count(F.lit(1)).alias("n"))


def stream_conditions(spark, sf):
    """Rules with conditions on lines that come as a stream."""
    lines = C.said(view(spark, sf, "lines_v", stream)).drop("n_bytes").withColumn("parser_name", F.lit("blocks"))
    return run_append(spark, parse_tagged_lines(lines, [C.BLOCKS], idle_ms=None), "conditions")


PARSED_ESCALATED = f"""SELECT * REPLACE (CASE WHEN source = 'stderr' AND type <> 'summary' AND severity IN ('info', 'warning')
  AND ({X.SIGNALS}) THEN 'error' ELSE severity END AS severity) FROM ({X.PARSED}) p"""
# keep the first, then drop repeats until an hour after the kept one, by recursion over each group
REPLAY_SQL = """WITH RECURSIVE r AS (SELECT user_id % 3 AS client, event_type, epoch_us(ts) AS us,
  row_number() OVER (PARTITION BY user_id % 3, event_type ORDER BY ts, event_id) AS n FROM events),
walk AS (SELECT client, event_type, us, n, us AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.client, r.event_type, r.us, r.n, CASE WHEN r.us - w.kept >= 3600000000 THEN r.us ELSE w.kept END
  FROM walk w JOIN r ON r.client = w.client AND r.event_type = w.event_type AND r.n = w.n + 1)
SELECT client, event_type, us FROM walk WHERE kept = us"""
SESSION_SQL = """SELECT key, count(*) AS actions, min(us) AS start_us, max(us) + 3600000000 AS end_us FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY key ORDER BY us, event_id) AS s FROM (
    SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY key ORDER BY us, event_id) < 3600000000 THEN 0 ELSE 1 END AS fresh
    FROM (SELECT key, event_id, epoch_us(ts) AS us FROM activity_v) a) b) c GROUP BY key, s"""
NOTIFY_SQL = """SELECT user_id AS connection_id, kind,
  CASE kind WHEN 'TaskUpdate' THEN 'task/update' WHEN 'TaskComplete' THEN 'task/complete' WHEN 'Diagnostic' THEN 'task/diagnostic' ELSE 'daemon/shutdown' END AS method,
  CASE kind WHEN 'TaskUpdate' THEN '{"task_id":"' || event_id || '","status":"failed"}'
    WHEN 'TaskComplete' THEN '{"task_id":"' || event_id || '","status":"failed","exit_code":1}'
    WHEN 'Diagnostic' THEN '{"task_id":"' || event_id || '","event":{"type":"diagnostic","severity":"error","message":"' || event_type || '"}}'
    ELSE '{}' END AS params
FROM (SELECT *, CASE event_id % 5 WHEN 0 THEN 'TaskUpdate' WHEN 1 THEN 'TaskComplete' WHEN 2 THEN 'Diagnostic' WHEN 3 THEN 'DaemonShutdown' END AS kind FROM events) e
WHERE kind IS NOT NULL"""
RELOAD_SQL = f"""SELECT 1 AS version, parser_name, type, count(*) AS n FROM ({X.LINE_RULE_SQL}) x GROUP BY 1, 2, 3
UNION ALL SELECT 2, parser_name, CASE WHEN parser_name = '{NEW_PACK}' THEN 'summary' ELSE type END AS kind, count(*) FROM (
  SELECT parser_name, type FROM ({X.LINE_RULE_SQL}) x WHERE parser_name <> '{NEW_PACK}'
  UNION ALL SELECT '{NEW_PACK}', 'summary' FROM (SELECT {X.PLAIN} AS plain FROM lines_v
    WHERE {X.LIST}[(CAST(task_id AS BIGINT) + line_no) % {len(X.LINE_PACKS)} + 1] = '{NEW_PACK}') l WHERE plain <> '') y GROUP BY 1, 2, 3"""

CASES = {
    "t1_stream_parse": (stream_parse, with_views(PARSED_ESCALATED, "lines_v", "tasks_v")),
    "t2_stream_merge": (stream_merge, with_views(X.STRUCTURE_SQL + "SELECT * FROM final", "lines_v", "tasks_v")),
    "t3_dedup_requests": (dedup_requests, REPLAY_SQL),
    "t4_notification_batches": (notification_batches, with_views(
        "SELECT task_id, (s - 1) // 50 AS chunk, count(*) AS n FROM (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY seq) AS s FROM merge_v) m GROUP BY 1, 2", "merge_v")),
    "t5_to_notifications": (to_notifications, NOTIFY_SQL),
    "t6_overflow_counts": (overflow_counts, "SELECT user_id AS connection_id, CAST(sum(event_id % 4) AS BIGINT) AS overflow FROM events GROUP BY 1"),
    "t7_latest_status": (latest_status, f"""
        SELECT task_id, ts, status, status <> 'running' AS is_final FROM (SELECT CAST(user_id AS STRING) AS task_id, ts, {STATUS} AS status,
          row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, {STATUS} DESC) AS n FROM events) e WHERE n = 1"""),
    "t8_detect_timeouts": (detect_timeouts, with_views("""
        SELECT task_id, duration_ms, allowed_ms, 'timeout' AS status, -2 AS exit_code FROM (SELECT *, CASE CAST(task_id AS BIGINT) % 3
          WHEN 1 THEN 40000 ELSE 60000 END AS allowed_ms FROM tasks_v) t WHERE duration_ms > allowed_ms""", "tasks_v")),
    "t9_activity_sessions": (activity_sessions, with_views(SESSION_SQL, "activity_v")),
    "t10_live_counters": (live_counters, with_views("""
        SELECT count(*) AS created, count(*) FILTER (WHERE status = 'completed') AS completed,
          count(*) FILTER (WHERE status IN ('failed', 'timeout', 'killed')) AS failed, CAST(sum(events_count) AS BIGINT) AS events,
          count(*) FILTER (WHERE carrier = 'shell') AS carrier_shell, count(*) FILTER (WHERE carrier = 'shell_composite') AS carrier_shell_composite,
          count(*) FILTER (WHERE carrier = 'python') AS carrier_python, CAST(0 AS BIGINT) AS carrier_script_other FROM tasks_v""", "tasks_v")),
    "t1_conditional_stream": (stream_conditions, with_views(C.FIRED.replace(C.LINES, C.SAID), "lines_v")),
    "t11_hot_reload": (hot_reload, with_views(RELOAD_SQL, "lines_v")),
}
