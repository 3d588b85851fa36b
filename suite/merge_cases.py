"""W: cross-line operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.line_cases import NOISE
from suite.views import view, with_views
from tracemill.functions import text as T
from tracemill.operators import lines as L
from tracemill.operators import merge as M


def _events(spark, sf):
    return view(spark, sf, "merge_v")


def collapse_repeats(spark, sf):
    return M.collapse_repeats(L.drop_noise(_events(spark, sf)))


def collapsed_counts(spark, sf):
    return M.collapsed_counts(_events(spark, sf))


def pair_locations(spark, sf):
    return M.pair_locations(_events(spark, sf))


def pairs_merged(spark, sf):
    return M.pairs_merged(_events(spark, sf))


def is_context_line(spark, sf):
    return _events(spark, sf).select("task_id", "seq", T.is_context_line(F.col("message")).alias("is_context"))


def absorb_context(spark, sf):
    return M.surviving_events(M.tag_context(_events(spark, sf)))


def context_lines(spark, sf):
    return M.context_lines(M.tag_context(_events(spark, sf)))


def embed_context(spark, sf):
    """The array form, over all events."""
    out = M.absorb_context(_events(spark, sf))
    return out.withColumn("context_after", F.array_join("context_after", "|"))


def assign_seq(spark, sf):
    events = _events(spark, sf).filter("type <> 'log'").withColumnRenamed("seq", "line_no")
    return M.assign_seq(events, ("line_no",))



RUNS = """
SELECT task_id, seq, type, severity, code, message, file, line, col,
  coalesce(lead(rn) OVER (PARTITION BY task_id ORDER BY seq), n + 1) - rn AS c
FROM (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY task_id) AS n,
    (type, message, file, line, col) IS NOT DISTINCT FROM
      (lag(type) OVER w, lag(message) OVER w, lag(file) OVER w, lag(line) OVER w, lag(col) OVER w) AS same
  FROM (SELECT * FROM merge_v WHERE NOT (type = 'log' AND {noise})) e
  WINDOW w AS (PARTITION BY task_id ORDER BY seq)) r
WHERE NOT same
""".replace("{noise}", NOISE)

COLLAPSE_SQL = f"""
SELECT task_id, seq, type, severity, code, file, line, col, CAST(c AS BIGINT) AS repeat_count,
  CASE WHEN c > 1 THEN message || ' (repeated ' || CAST(c AS STRING) || ' times)' ELSE message END AS message
FROM ({RUNS}) x
"""

COLLAPSED_SQL = f"""
SELECT a.task_id, CAST(a.noise + coalesce(b.reps, 0) AS BIGINT) AS collapsed
FROM (SELECT task_id, count(*) FILTER (WHERE type = 'log' AND {NOISE}) AS noise FROM merge_v GROUP BY 1) a
LEFT JOIN (SELECT task_id, sum(c - 1) AS reps FROM ({RUNS}) x GROUP BY 1) b ON a.task_id = b.task_id
"""

PAIRS = """
SELECT *, kind IS NOT NULL AND (pos % 2 = 0 OR coalesce(next_linked, false)) AS paired,
  CASE WHEN pos % 2 = 0 THEN prev_loc WHEN next_linked THEN next_loc END AS partner
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, island ORDER BY seq) AS pos,
    lead(linked) OVER w AS next_linked, lag(loc) OVER w AS prev_loc, lead(loc) OVER w AS next_loc
  FROM (SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER w AS island
    FROM (SELECT *, coalesce(kind <> lag(kind) OVER w, false) AS linked
      FROM (SELECT *, CASE WHEN type IN ('diagnostic', 'crash') THEN 'D' WHEN type = 'location' THEN 'L' END AS kind,
          CASE WHEN file IS NOT NULL THEN {'file': file, 'line': line, 'col': col} END AS loc FROM merge_v) a
      WINDOW w AS (PARTITION BY task_id ORDER BY seq)) b
    WINDOW w AS (PARTITION BY task_id ORDER BY seq)) c
  WINDOW w AS (PARTITION BY task_id ORDER BY seq)) d
"""

PAIR_SQL = f"""
SELECT task_id, seq, type, severity, code, message, paired,
  CASE WHEN paired AND file IS NULL THEN partner.file ELSE file END AS file,
  CASE WHEN paired AND file IS NULL THEN partner.line ELSE line END AS line,
  CASE WHEN paired AND file IS NULL THEN partner.col ELSE col END AS col
FROM ({PAIRS}) p WHERE NOT (kind IS NOT DISTINCT FROM 'L' AND paired)
"""

CONTEXT = """(regexp_matches(trim(message), '^= [A-Za-z]*:') OR starts_with(trim(message), '|')
  OR regexp_matches(trim(message), '^[0-9][0-9 ]* [|] ') OR starts_with(trim(message), 'expected type ')
  OR starts_with(trim(message), 'found type ') OR starts_with(trim(message), 'the trait ')
  OR starts_with(trim(message), '^^^') OR starts_with(trim(message), '---'))"""

TAGGED = f"""
SELECT *, ctx AND coalesce(head.t = 'diagnostic', false) AS absorbed
FROM (SELECT *, last_value(CASE WHEN NOT ctx THEN {{'s': seq, 't': type}} END IGNORE NULLS)
    OVER (PARTITION BY task_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head
  FROM (SELECT *, type = 'log' AND {CONTEXT} AS ctx FROM merge_v) a) b
"""
KEEPS = """NOT (regexp_matches(trim(message), '^[|]\\s*[-^|]*$') OR trim(message) IN ('', '}', '//', '///')
  OR starts_with(trim(message), '-->') OR contains(trim(message), chr(27)))"""

EMBED_SQL = f"""
WITH tagged AS ({TAGGED})
SELECT e.task_id, e.seq, e.type, e.severity, e.code, e.message, e.file, e.line, e.col, c.joined AS context_after
FROM tagged e LEFT JOIN (SELECT task_id, head.s AS seq, string_agg(message, '|' ORDER BY seq) AS joined
  FROM tagged WHERE absorbed AND {KEEPS} GROUP BY 1, 2) c ON e.task_id = c.task_id AND e.seq = c.seq
WHERE NOT e.absorbed
"""

SEQ_SQL = """
SELECT task_id, seq AS line_no, type, severity, code, message, file, line, col,
  row_number() OVER (PARTITION BY task_id ORDER BY seq) AS seq
FROM merge_v WHERE type <> 'log'
"""

CASES = {
    "w1_collapse_repeats": (collapse_repeats, with_views(COLLAPSE_SQL, "merge_v")),
    "w2_collapsed_counts": (collapsed_counts, with_views(COLLAPSED_SQL, "merge_v")),
    "w3_pair_locations": (pair_locations, with_views(PAIR_SQL, "merge_v")),
    "w4_pairs_merged": (pairs_merged, with_views(
        f"SELECT task_id, count(*) FILTER (WHERE paired AND kind = 'D') AS pairs_merged FROM ({PAIRS}) p GROUP BY 1",
        "merge_v")),
    "w5_is_context_line": (is_context_line, with_views(
        f"SELECT task_id, seq, {CONTEXT} AS is_context FROM merge_v", "merge_v")),
    "w6_absorb_context": (absorb_context, with_views(
        f"SELECT task_id, seq, type, severity, code, message, file, line, col FROM ({TAGGED}) t WHERE NOT absorbed",
        "merge_v")),
    "w6_context_lines": (context_lines, with_views(
        f"SELECT task_id, head.s AS head_seq, seq, message AS text FROM ({TAGGED}) t WHERE absorbed AND {KEEPS}",
        "merge_v")),
    "w6_embed_context": (embed_context, with_views(EMBED_SQL, "merge_v")),
    "w7_assign_seq": (assign_seq, with_views(SEQ_SQL, "merge_v")),
}
