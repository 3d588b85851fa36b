"""Input views over the given tables, one definition for both engines.

Each view is a projection (no shuffle) of a whole table.  `{...}` marks the few spots where
Spark and DuckDB spell the same thing differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "div": "div", "days": "unix_date(CAST({} AS DATE))",
    "add_seconds": "{} + make_dt_interval(0, 0, 0, {})",
    "add_millis": "timestampadd(MILLISECOND, {1}, {0})",
    "explode": "lateral view posexplode(split(text, '\\n')) t AS pos, part",
    "line_no": "CAST(pos + 1 AS BIGINT)", "ansi": "chr(27)", "bytes": "octet_length",
}
DUCK = {
    "div": "//", "days": "(CAST({} AS DATE) - DATE '1970-01-01')",
    "add_seconds": "{} + to_seconds({})", "add_millis": "{} + to_milliseconds({})",
    "explode": ", unnest(list_zip(range(1, len(string_split(text, chr(10))) + 1), "
               "string_split(text, chr(10)))) AS t(z)",
    "line_no": "CAST(z[1] AS BIGINT)", "ansi": "chr(27)", "bytes": "strlen",
}

TASKS = """
SELECT task_id, command, cwd, status,
  CASE status WHEN 'completed' THEN 0 WHEN 'failed' THEN 1 WHEN 'timeout' THEN -2
    WHEN 'killed' THEN -3 END AS exit_code,
  parser_name, started_at,
  CASE WHEN status <> 'running' THEN {finish} END AS finished_at,
  CASE WHEN status <> 'running' THEN ms END AS duration_ms,
  purpose, carrier, visible_events + skipped_noise_events AS events_count,
  CASE WHEN status = 'failed' THEN 1 + custkey % 5 ELSE 0 END AS error_count,
  dedup_collapsed, raw_output_bytes, structured_events_bytes, visible_events,
  skipped_noise_events, locations_extracted, codes_extracted
FROM (
  SELECT CAST(o_orderkey AS STRING) AS task_id, o_custkey AS custkey,
    CASE o_orderkey % 6 WHEN 0 THEN 'cargo build' WHEN 1 THEN 'python3 run.py'
      WHEN 2 THEN 'go test ./...' WHEN 3 THEN 'npm install' WHEN 4 THEN 'eslint src'
      ELSE 'ls | grep x' END || ' --id ' || CAST(o_custkey % 20 AS STRING) AS command,
    '/w/' || CAST(o_custkey AS STRING) AS cwd,
    CASE WHEN o_orderstatus = 'O' THEN 'running' WHEN o_orderkey % 11 = 0 THEN 'timeout'
      WHEN o_orderkey % 13 = 0 THEN 'killed' WHEN o_orderstatus = 'F' THEN 'failed'
      ELSE 'completed' END AS status,
    CASE o_orderkey % 6 WHEN 0 THEN 'cargo' WHEN 1 THEN 'python' WHEN 2 THEN 'go'
      WHEN 3 THEN 'npm' WHEN 4 THEN 'eslint' END AS parser_name,
    {start} AS started_at,
    CAST(floor(o_totalprice) AS BIGINT) % 100000 AS ms,
    CASE o_custkey % 10 WHEN 0 THEN 'dogfood' WHEN 1 THEN 'sample' END AS purpose,
    CASE o_orderkey % 6 WHEN 1 THEN 'python' WHEN 5 THEN 'shell_composite'
      ELSE 'shell' END AS carrier,
    o_orderkey % 9 AS dedup_collapsed,
    CAST(floor(o_totalprice) AS BIGINT) AS raw_output_bytes,
    CAST(floor(o_totalprice) AS BIGINT) {div} 3 + o_custkey % 7 AS structured_events_bytes,
    o_orderkey % 50 AS visible_events, o_orderkey % 17 AS skipped_noise_events,
    o_orderkey % 23 AS locations_extracted, o_orderkey % 5 AS codes_extracted
  FROM orders) o
"""

# seq packs line number, ship day and price: unique per task and in a fixed order
EVENTS = """
SELECT CAST(l_orderkey AS STRING) AS task_id,
  (CAST(l_linenumber AS BIGINT) * 100000 + {day}) * 100000000
    + CAST(round(l_extendedprice * 100) AS BIGINT) AS seq,
  CASE l_partkey % 5 WHEN 1 THEN 'location' WHEN 2 THEN 'log' WHEN 3 THEN 'summary'
    ELSE 'diagnostic' END AS type,
  CASE WHEN l_partkey % 5 IN (0, 4) THEN
    CASE l_linestatus WHEN 'F' THEN 'error' ELSE 'warning' END ELSE 'info' END AS severity,
  CASE WHEN l_partkey % 5 IN (0, 4) AND l_suppkey % 3 = 0
    THEN 'E0' || CAST(300 + l_suppkey % 20 AS STRING) END AS code,
  CASE WHEN l_partkey % 5 = 1 THEN '' ELSE 'msg ' || CAST(l_suppkey % 2 AS STRING) END AS message,
  CASE WHEN l_partkey % 5 = 1 OR (l_partkey % 5 = 0 AND l_suppkey % 4 = 0)
    THEN 'src/f' || CAST(l_partkey % 50 AS STRING) || '.rs' END AS file,
  CASE WHEN l_partkey % 5 = 1 OR (l_partkey % 5 = 0 AND l_suppkey % 4 = 0)
    THEN CAST(l_quantity AS BIGINT) END AS line,
  CAST(NULL AS BIGINT) AS col
FROM lineitem
"""

DOC_LINES = """
SELECT CAST(doc_id AS STRING) AS task_id, doc_id, {line_no} AS line_no, {part} AS text
FROM documents {explode}
"""

LOG_LINES = """
SELECT task_id, line_no, source, text, CAST({bytes}(text) + 1 AS BIGINT) AS n_bytes FROM (
  SELECT task_id, line_no, source,
    CASE WHEN line_no % 4 = 0 THEN {ansi} || '[31m' || plain || {ansi} || '[0m'
      ELSE plain END AS text
  FROM (
    SELECT task_id, line_no,
      CASE WHEN (doc_id + line_no) % 3 = 0 THEN 'stderr' ELSE 'stdout' END AS source,
      CASE WHEN line_no % 19 = 0 THEN ' '
        ELSE CASE ((line_no {div} 2) * 7 + doc_id + length(text) {div} 40) % 10
        WHEN 0 THEN 'error[E0' || CAST(300 + (doc_id + line_no) % 20 AS STRING) || ']: ' || text
        WHEN 1 THEN '  --> src/f' || CAST(line_no % 50 AS STRING) || '.rs:'
          || CAST(1 + length(text) % 200 AS STRING) || ':1'
        WHEN 2 THEN '  --> src/g.rs:7:1'
        WHEN 3 THEN 'error: cannot build unit ' || CAST(doc_id % 3 AS STRING)
        WHEN 4 THEN 'warning: unused import'
        WHEN 5 THEN '   | ^^^^ expected ' || CAST(line_no % 4 AS STRING)
        WHEN 6 THEN '   = note: required here'
        WHEN 7 THEN 'Finished `dev` profile [x] target(s) in 0.1s'
        WHEN 8 THEN text
        ELSE 'plain note: permission denied' END END AS plain
    FROM doc_lines) a) b
"""

# events of the line view, by line shape only (no regex), as dense input of the merge steps
MERGE_EVENTS = """
SELECT task_id, line_no AS seq,
  CASE k WHEN 0 THEN 'diagnostic' WHEN 1 THEN 'location' WHEN 2 THEN 'location'
    WHEN 3 THEN 'diagnostic' WHEN 4 THEN 'crash' WHEN 7 THEN 'summary' ELSE 'log' END AS type,
  CASE WHEN k IN (0, 3) THEN 'error' WHEN k = 4 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN k = 0 THEN 'E0' || CAST(300 + line_no % 20 AS STRING) END AS code,
  CASE k WHEN 0 THEN 'mismatched' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'cannot build'
    WHEN 4 THEN 'unused' WHEN 5 THEN '  | ^^^^ expected ' || CAST(line_no % 2 AS STRING)
    WHEN 6 THEN '= note: required' WHEN 7 THEN 'Finished'
    WHEN 8 THEN CASE WHEN line_no % 3 = 0 THEN ' ' ELSE text END ELSE '|' END AS message,
  CASE WHEN k = 1 THEN 'src/f' || CAST(line_no % 3 AS STRING) || '.rs' WHEN k = 2 THEN 'src/g.rs'
    WHEN k = 3 AND line_no % 2 = 0 THEN 'src/own.rs' END AS file,
  CASE WHEN k IN (1, 2) THEN 1 + line_no % 3 WHEN k = 3 AND line_no % 2 = 0 THEN 9 END AS line,
  CAST(NULL AS BIGINT) AS col
FROM (SELECT *, ((line_no {div} 2) * 7 + doc_id + length(text) {div} 40) % 10 AS k FROM doc_lines) d
"""

ACTIVITY = """
SELECT CAST(user_id AS STRING) AS key, event_id, ts, event_type AS kind, props AS payload, value
FROM events
"""

SOURCE_LINES = """
SELECT 'src/f' || CAST(p_partkey % 50 AS STRING) || '.rs' AS file,
  p_partkey {div} 50 + 1 AS line_no, p_name AS text
FROM part
"""


def _render(sql: str, d: dict) -> str:
    return (
        sql.replace("{div}", d["div"])
        .replace("{finish}", d["add_millis"].format("started_at", "ms"))
        .replace("{start}", d["add_seconds"].format("o_orderdate", "o_orderkey % 86400"))
        .replace("{day}", d["days"].format("l_shipdate"))
        .replace("{line_no}", d["line_no"])
        .replace("{part}", "part" if d is SPARK else "z[2]")
        .replace("{explode}", d["explode"])
        .replace("{ansi}", d["ansi"])
        .replace("{bytes}", d["bytes"])
    )


VIEWS = {
    "tasks_v": TASKS, "events_v": EVENTS, "doc_lines": DOC_LINES, "lines_v": LOG_LINES,
    "merge_v": MERGE_EVENTS, "activity_v": ACTIVITY, "source_v": SOURCE_LINES,
}
NEEDS = {"lines_v": ["doc_lines"], "merge_v": ["doc_lines"]}
TABLES = {
    "tasks_v": "orders", "events_v": "lineitem", "doc_lines": "documents", "lines_v": "documents",
    "merge_v": "documents", "activity_v": "events", "source_v": "part",
}


def with_views(sql: str, *names: str) -> str:
    """DuckDB query with the named views as common table expressions."""
    order: list[str] = []
    for name in names:
        order += [n for n in [*NEEDS.get(name, []), name] if n not in order]
    ctes = ",\n".join(f"{n} AS ({_render(VIEWS[n], DUCK)})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE '):]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of its files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}*.parquet")


def view(spark: SparkSession, sf_dir: str, name: str, read=table) -> DataFrame:
    """The named view as a DataFrame; `read=stream` makes it a streaming one."""
    sql = _render(VIEWS[name], SPARK)
    sources = {TABLES[name]: read(spark, sf_dir, TABLES[name])}
    for inner in NEEDS.get(name, []):
        sources[inner] = view(spark, sf_dir, inner, read)
    for source in sources:
        sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(sql, **sources)
