"""X18 and W8 with rules that have conditions, over tasks of which one has a third of all lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import rule_sql as R
from suite.extract_cases import CRASH, HEURISTIC, LONG_LINES, LONG_STEP, PARSED, PLAIN, RAW_EVENT, STRUCTURE_SQL
from suite.views import view, with_views
from tracemill.operators import extract as X
from tracemill.plans.structure import structure_output
from tracemill.sources.rulepacks import Pack, Rule

#: A mark opens the deep part of a section, only inside one; `leave` ends it, only if it is open.
RULES = (
    Rule("section", "summary", "info", "^section (.+)", {"message": 1}, state_transition="block=yes"),
    Rule("mark", "summary", "info", "^mark (.+)", {"message": 1}, state_condition="block=yes", state_transition="deep=yes"),
    Rule("bad", "diagnostic", "error", "^bad (.+)", {"message": 1}, state_condition="block=yes"),
    Rule("deep", "diagnostic", "warning", "^deep (.+)", {"message": 1}, state_condition="deep=yes"),
    Rule("leave", "summary", "info", "^leave (.+)", {"message": 1}, state_condition="deep=yes", state_transition="deep=no"),
    Rule("end", "summary", "info", "^end (.+)", {"message": 1}, state_transition="block=no"),
)
BLOCKS = Pack("blocks", RULES, stateful=True)
WORDS = ["section", "bad", "mark", "deep", "end", "leave", "bad", "deep", "mark"]


def said(lines):
    """Log lines, most of them a word of the pack and the line's number."""
    word = F.get(F.array(*map(F.lit, WORDS)), ((F.col("line_no") * 7 + F.length("text")) % 13).cast("int"))
    return lines.withColumn("text", F.when(word.isNotNull(), F.concat(word, F.lit(" "), "line_no")).otherwise(F.col("text")))


def condition_lines(spark, sf):
    """Every third task's lines are those of one task."""
    task = F.col("task_id").cast("long")
    return said(view(spark, sf, "lines_v")).withColumns({
        "task_id": F.when(task % 3 == 0, "1").otherwise(F.col("task_id")),
        "line_no": F.when(task % 3 == 0, (task + 1) * LONG_STEP + F.col("line_no")).otherwise(F.col("line_no"))})


def conditional_rules(spark, sf):
    lines = condition_lines(spark, sf).drop("n_bytes").withColumn("parser_name", F.lit("blocks"))
    return X.parse_tagged_lines(lines, [BLOCKS])


def structure_conditional(spark, sf):
    lines = condition_lines(spark, sf)
    tasks = lines.select("task_id").distinct().withColumn("parser_name", F.lit("blocks"))
    out = structure_output(lines, tasks, [BLOCKS], width=LONG_STEP)
    return out.withColumn("context_after", F.array_join("context_after", "|"))


WORD = "[" + ", ".join(R.quote(w) for w in WORDS) + "][(line_no * 7 + length(text)) % 13 + 1]"
SAID = f"(SELECT * REPLACE (CASE WHEN {WORD} IS NOT NULL THEN {WORD} || ' ' || line_no ELSE text END AS text) FROM lines_v)"
LINES = LONG_LINES.replace("FROM lines_v", f"FROM {SAID} s")
BEFORE = "OVER (PARTITION BY task_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _when(rule):
    need = f" AND {rule.state_condition.split('=')[0]} = {R.quote(rule.state_condition.split('=')[1])}" if rule.state_condition else ""
    return f"CASE WHEN {R.hit('text', rule.regex)}{need} THEN {R.rule_event('text', rule, False)} END"


MANY = "list_filter([" + ", ".join(map(_when, RULES)) + "], lambda x: x IS NOT NULL)"
#: Each state is the last value set before the line; a mark counts inside a section only, any `leave` ends the deep part.
FIRED = f"""
SELECT task_id, line_no, source, z[1] AS idx, {", ".join(f"z[2].{f} AS {f}" for f in R.FIELDS)}, tier FROM (
  SELECT *, CASE WHEN len(many) > 0 THEN 'stateful' WHEN c IS NOT NULL THEN 'crash' WHEN h IS NOT NULL THEN 'heuristic' ELSE 'raw' END AS tier,
    CASE WHEN len(many) > 0 THEN many ELSE [coalesce(c, h, {RAW_EVENT})] END AS evs
  FROM (SELECT *, {MANY} AS many, {CRASH} AS c, {HEURISTIC} AS h FROM (
    SELECT *, last_value(CASE WHEN starts_with(text, 'mark ') AND block = 'yes' THEN 'yes' WHEN starts_with(text, 'leave ') THEN 'no' END IGNORE NULLS) {BEFORE} AS deep
    FROM (SELECT *, last_value(CASE WHEN starts_with(text, 'section ') THEN 'yes' WHEN starts_with(text, 'end ') THEN 'no' END IGNORE NULLS) {BEFORE} AS block
      FROM (SELECT task_id, line_no, source, {PLAIN} AS text FROM {LINES} l) l0) l1) l2) l3) l4,
  unnest(list_zip(range(0, len(evs)), evs)) AS t(z)
"""

CASES = {
    "x18_conditional_rules": (conditional_rules, with_views(FIRED, "lines_v")),
    "w8_conditional_rules": (structure_conditional, with_views(
        STRUCTURE_SQL.replace(PARSED, FIRED) + "SELECT * FROM final", "lines_v", "tasks_v")),
}
