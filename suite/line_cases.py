"""N: line normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.views import table, view, with_views
from tracemill.functions import text as T
from tracemill.operators import lines as L

CAP = 600
CLIP = 400


def raw_outputs(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("raw")
    )


def split_lines(spark, sf):
    return L.split_lines(raw_outputs(spark, sf))


def repair_utf8(spark, sf):
    odd = F.col("doc_id") % 2 == 1
    raw = F.when(odd, F.concat(F.col("text").cast("binary"), F.expr("X'FF'"))).otherwise(
        F.col("text").cast("binary")
    )
    return table(spark, sf, "documents").select("doc_id", T.repair_utf8(raw).alias("line"))


def cap_line(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.cap_line(F.col("text"), 2000).alias("line"))


def cap_task_output(spark, sf):
    return L.cap_task_output(view(spark, sf, "lines_v"), CAP)


def strip_ansi(spark, sf):
    return view(spark, sf, "lines_v").select("task_id", "line_no", T.strip_ansi(F.col("text")).alias("text"))


def drop_noise(spark, sf):
    return L.drop_noise(view(spark, sf, "merge_v"))


def clip_text(spark, sf):
    clipped = table(spark, sf, "documents").withColumn("c", T.clip_text(F.col("text"), CLIP))
    return clipped.select("doc_id", "c.text", "c.clipped", "c.omitted_bytes")


def join_capped_lines(spark, sf):
    return L.join_capped_lines(view(spark, sf, "lines_v"), CAP)


# characters of {0} that fit into {1} bytes, from the front or the back
FRONT = "left({0}, CAST(list_max(list_filter(range(0, {1} + 1), lambda k: strlen(left({0}, k)) <= {1})) AS BIGINT))"
BACK = "right({0}, CAST(list_max(list_filter(range(0, {1} + 1), lambda k: strlen(right({0}, k)) <= {1})) AS BIGINT))"

SPLIT_SQL = """
SELECT CAST(doc_id AS STRING) AS task_id, CAST(z[1] AS BIGINT) AS line_no, 'stdout' AS source,
  CASE WHEN ends_with(z[2], chr(13)) THEN left(z[2], length(z[2]) - 1) ELSE z[2] END AS text,
  CAST(strlen(z[2]) + CASE WHEN z[1] = n THEN 0 ELSE 1 END AS BIGINT) AS n_bytes
FROM (SELECT doc_id, string_split(text, chr(10)) AS p, len(string_split(text, chr(10))) AS n FROM documents) d,
  unnest(list_zip(range(1, n + 1), p)) AS t(z)
WHERE NOT (z[1] = n AND z[2] = '')
"""

CAP_SQL = f"""
SELECT task_id, line_no, source, n_bytes, used > {CAP} AS truncated,
  CASE WHEN used > {CAP} THEN 'Output truncated: exceeded {CAP} byte limit' ELSE text END AS text
FROM (SELECT *, sum(n_bytes) OVER (PARTITION BY task_id ORDER BY line_no) AS used FROM lines_v) t
WHERE used - n_bytes <= {CAP}
"""

NOISE = "regexp_matches(message, '^(\\s|\\x1b\\[[0-9;]*m)*:?(\\s|\\x1b\\[[0-9;]*m)*$')"

HALF = CLIP // 2
CLIP_SQL = f"""
SELECT doc_id, over AS clipped,
  CASE WHEN over THEN head || chr(10) || '[…]' || chr(10) || tail ELSE text END AS text,
  CAST(CASE WHEN over THEN strlen(text) - strlen(head) - strlen(tail) ELSE 0 END AS BIGINT) AS omitted_bytes
FROM (SELECT doc_id, text, strlen(text) > {CLIP} AS over,
  {FRONT.format("text", HALF)} AS head, {BACK.format("text", HALF)} AS tail FROM documents) d
"""

JOIN_SQL = f"""
SELECT task_id, bool_or(crossing) AS truncated,
  CASE WHEN NOT bool_or(crossing) THEN string_agg(body, chr(10) ORDER BY line_no)
    WHEN coalesce(string_agg(body, chr(10) ORDER BY line_no), '') = '' THEN '[output truncated at {CAP} bytes]'
    ELSE string_agg(body, chr(10) ORDER BY line_no) || chr(10) || '[output truncated at {CAP} bytes]'
  END AS raw_output
FROM (SELECT task_id, line_no, used > {CAP} AS crossing,
    CASE WHEN used <= {CAP} THEN text
      ELSE nullif({FRONT.format("text", f"CAST(least({CAP} - used + n_bytes, strlen(text)) AS BIGINT)")}, '') END AS body
  FROM (SELECT *, sum(n_bytes) OVER (PARTITION BY task_id ORDER BY line_no) AS used FROM lines_v) t
  WHERE used - n_bytes <= {CAP}) k
GROUP BY task_id
"""

CAP_LINE_SQL = f"""
SELECT doc_id, CASE WHEN strlen(text) <= 2000 THEN text
  ELSE head || CASE WHEN strlen(head) < 2000 THEN chr(65533) || ' [invalid UTF-8 replaced]' ELSE '' END
    || ' [line truncated at 2000 bytes]' END AS line
FROM (SELECT doc_id, text, CASE WHEN strlen(text) > 2000 THEN {FRONT.format("text", 2000)} END AS head FROM documents) d
"""

CASES = {
    "n1_split_lines": (split_lines, SPLIT_SQL),
    "n2_repair_utf8": (repair_utf8, """SELECT doc_id, CASE WHEN doc_id % 2 = 1
        THEN text || chr(65533) || ' [invalid UTF-8 replaced]' ELSE text END AS line FROM documents"""),
    "n3_cap_line": (cap_line, CAP_LINE_SQL),
    "n4_cap_task_output": (cap_task_output, with_views(CAP_SQL, "lines_v")),
    "n5_strip_ansi": (strip_ansi, with_views(
        "SELECT task_id, line_no, regexp_replace(text, '\\x1b\\[[0-9;]*m', '', 'g') AS text FROM lines_v",
        "lines_v")),
    "n6_drop_noise": (drop_noise, with_views(
        f"SELECT * FROM merge_v WHERE NOT (type = 'log' AND {NOISE})", "merge_v")),
    "n7_clip_text": (clip_text, CLIP_SQL),
    "n8_join_capped_lines": (join_capped_lines, with_views(JOIN_SQL, "lines_v")),
}
