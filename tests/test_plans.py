"""Plans: pruned scans, early top-k, one shuffle for the merge steps."""

import re

import pytest
from pyspark.sql import functions as F

from suite import query_cases, stats_cases
from suite.extract_cases import structure_long_task, structured
from suite.registry import CASES
from tracemill.operators import query as Q
from tracemill.operators.audit import BLOCKED_PATTERNS
from tracemill.plans import formats

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_needed_columns(spark):
    text = plan(stats_cases.on_tasks(stats_cases.S.status_counts)(spark, SF))
    schema = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in schema.split(",")} <= {"o_orderkey", "o_orderstatus"}


@pytest.mark.parametrize("name", ["q7_tail_raw", "q9_inline_events", "q17_top_event_lines"])
def test_top_rows_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(CASES[name][0](spark, SF))


def test_filters_reach_the_scan(spark):
    text = plan(Q.get_tasks(query_cases.tk(spark, SF).filter("status = 'running'"), ["3"]))
    assert "PushedFilters: [IsNotNull" in text


def test_merge_steps_share_one_shuffle(spark):
    text = plan(structured(spark, SF))
    assert text.count("hashpartitioning(task_id") <= 6
    assert "CartesianProduct" not in text and "SinglePartition" not in text


def test_segments_of_long_tasks_hand_over_in_linear_time(spark):
    """A frame from a row to the end of its task is read anew for every row."""
    text = plan(structure_long_task(spark, SF))
    assert "Window" in text and not re.search(r"RowFrame, (-?\d+|currentrow\$\(\)), unboundedfollowing", text)


def test_segments_and_their_summary_come_from_one_shuffle(spark):
    """A filter that only the summary has would make its shuffle another one."""
    assert "THEN true ELSE isnotnull(cast(doc_id" not in plan(structure_long_task(spark, SF))


@pytest.mark.parametrize("query", ["au6_varied_policy", "au7_varied_guardrails", "au7_guardrail_scan"])
def test_commands_are_read_on_all_cores(spark, query):
    assert CASES[query][0](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_what_a_filter_asks_for_is_computed_once(spark):
    """A filter on a computed column, pushed below it, would compute it a second time."""
    text = plan(CASES["au6_varied_policy"][0](spark, SF))
    assert text.count(f"matches pattern '{BLOCKED_PATTERNS[3]}'") == 1
    # lines without conditional rules, and both sides of the join of those with them
    assert plan(CASES["x18_conditional_rules"][0](spark, SF)).count(", (?dU)^section (.+))") == 3


def test_segments_with_conditions_come_from_one_shuffle(spark):
    out = CASES["x18_conditional_rules"][0](spark, SF)
    out.collect()
    assert plan(out).split("Initial Plan")[0].count("Generate posexplode(split(") == 2


def test_reference_lists_come_with_the_last_join(spark):
    out = CASES["j1_attach_code_refs"][0](spark, SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2  # with tasks, then with the lists


def test_ends_of_outputs_are_found_without_their_texts(spark):
    """Before lines are joined with the ends of their output, only numbers are aggregated and shuffled for these."""
    lines = spark.createDataFrame(
        [("a", 1, " \t"), ("a", 2, "  [1,"), ("a", 3, "2] "), ("a", 4, ""), ("b", 1, "k: 1"), ("b", 2, "{}"), ("c", 1, "\u00a0")],
        "task_id string, line_no long, text string")
    body = formats._body(lines, F.col("text").startswith("{"))
    assert "SortAggregate" not in plan(body) and "LeftAnti" not in plan(body)
    assert sorted(map(tuple, body.collect())) == [("a", 2, "[", "[1,"), ("a", 3, "[", "2]")]
    stats = plan(formats._line_formats(body))
    assert "min_by" not in stats


def test_reference_text_is_made_once_per_list(spark):
    out = CASES["j1_attach_code_refs"][0](spark, SF)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [n for n, line in enumerate(lines) if "array_join(" in line]
    assert made and all("Aggregate [" in lines[n] for n in made)  # of lists, below the joins
    joins = [n for n, line in enumerate(lines) if "Join LeftOuter" in line]
    assert any("RepartitionByExpression [task_id" in line for line in lines[joins[0]:joins[1]])  # events are dealt out before they get texts
