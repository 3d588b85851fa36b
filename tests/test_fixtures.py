"""Golden logs written for this test: whole outputs and the events they must give."""

import pytest

from tracemill.plans.structure import structure_output
from tracemill.sources.rulepacks import load_packs, resolve_packs

# (pack, output, [(type, severity, code, message, file, line)])
GOLDEN = [
    ("cargo", "error[E0425]: cannot find value `n`\n  --> src/lib.rs:4:9\n   |\n 4 |     n + 1\n   |     ^ not found\nwarning: unused variable: `k`\n",
     [("diagnostic", "error", "E0425", "cannot find value `n`", "src/lib.rs", 4),
      ("diagnostic", "warning", None, "unused variable: `k`", None, None)]),
    ("python", 'Traceback (most recent call last):\n  File "job.py", line 3, in run\nValueError: bad input\n',
     [("diagnostic", "error", None, "Traceback (most recent call last):", "job.py", 3),
      ("diagnostic", "error", None, "ValueError: bad input", None, None)]),
    ("eslint", "/app/a.js\n  3:7  error  Unexpected var  no-var\n  9:1  warning  Missing semi  semi\n",
     [("diagnostic", "error", "no-var", "Unexpected var", "app/a.js", 0),
      ("diagnostic", "warning", "semi", "Missing semi", None, None)]),
    ("go", "./m.go:8:2: undefined: foo\n--- FAIL: TestA (0.00s)\nok  \tpkg/b\t0.1s\n",
     [("diagnostic", "error", None, "undefined: foo", "./m.go", 8),
      ("test_result", "error", None, "TestA", None, None), ("test_result", "info", None, "pkg/b", None, None)]),
    ("npm", "npm WARN old thing\nnpm ERR! code X\nadded 3 packages\n",
     [("diagnostic", "warning", None, "old thing", None, None), ("diagnostic", "error", None, "code X", None, None),
      ("summary", "info", None, "added 3 packages", None, None)]),
    ("curl", "HTTP/2 204\n", [("diagnostic", "info", "204", "", None, None)]),
    (None, "step\nstep\nstep\n{\"level\":\"warn\",\"msg\":\"slow\",\"file\":\"q.sql\",\"line\":7}\nbuild failed\n",
     [("log", "info", None, "step (repeated 3 times)", None, None),
      ("diagnostic", "warning", None, "slow", "q.sql", 7),
      ("diagnostic", "error", None, "build failed", None, None)]),
]


@pytest.fixture(scope="module")
def structured(spark):
    lines, tasks = [], []
    for i, (pack, output, _) in enumerate(GOLDEN):
        tasks.append((str(i), pack))
        for n, text in enumerate(output.splitlines(), 1):
            lines.append((str(i), n, "stdout", text, len(text) + 1))
    out = structure_output(
        spark.createDataFrame(lines, "task_id string, line_no long, source string, text string, n_bytes long"),
        spark.createDataFrame(tasks, "task_id string, parser_name string"), resolve_packs(load_packs()))
    return out.orderBy("task_id", "seq").collect()


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden(structured, i):
    got = [(r.type, r.severity, r.code, r.message, r.file, r.line) for r in structured if r.task_id == str(i)]
    assert got == GOLDEN[i][2]


def test_context_is_absorbed(structured):
    first = [r for r in structured if r.task_id == "0"][0]
    assert first.context_after == [" 4 |     n + 1", "   |     ^ not found"]


def test_cap_notice(spark):
    lines = spark.createDataFrame(
        [("t", n, "stdout", f"line {n}", 7) for n in range(1, 10)],
        "task_id string, line_no long, source string, text string, n_bytes long")
    tasks = spark.createDataFrame([("t", None)], "task_id string, parser_name string")
    rows = structure_output(lines, tasks, [], max_bytes=15).orderBy("seq").collect()
    assert [(r.type, r.message) for r in rows] == [
        ("log", "line 1"), ("log", "line 2"), ("system", "Output truncated: exceeded 15 byte limit")]
