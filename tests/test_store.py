"""Readers and writers on files with awkward splits."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracemill.sources import commits, ranges, store
from tracemill.streaming.live import RuleCatalog


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_across_splits(spark, tmp_path, small_splits):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{name}{n}\r\n" for n in range(1, 2001)))
    rows = store.read_raw(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 4
    got = rows.collect()
    assert len(got) == 4000 and all(r.text == f"{r.task_id}{r.line_no}" for r in got)
    assert sum(r.n_bytes for r in got) == sum(p.stat().st_size for p in tmp_path.glob("*.txt"))


def test_last_task_row_wins_and_corrupt_is_kept(spark, tmp_path, small_splits):
    rows = [f'{{"task_id":"{i % 100}","status":"s{i}"}}' for i in range(1000)] + ['{"task_id":']
    (tmp_path / "tasks.jsonl").write_text("\n".join(rows) + "\n")
    tasks, corrupt = store.read_tasks(spark, str(tmp_path))
    assert {r.task_id: r.status for r in tasks.collect()} == {str(i): f"s{900 + i}" for i in range(100)}
    assert [(r.line_no, r.value) for r in corrupt.collect()] == [(1001, '{"task_id":')]


def test_rows_are_numbered_where_they_are_read(spark, tmp_path, small_splits):
    """No shuffle brings the rows of a split together, and no sort carries their paths."""
    for name in ("b", "a"):  # the last row is that of the last path, whichever was written first
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"task_id":"{i % 100}","status":"{name}{i}"}}\n' for i in range(1000)))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks, _ = store.read_tasks(spark, str(tmp_path))
        text = tasks._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in text and "max_by(row" in text
        assert not any("path" in line for line in text.splitlines() if "max_by(row" in line)
        assert {r.task_id: r.status for r in tasks.collect()} == {str(i): f"b{900 + i}" for i in range(100)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_sorts_carry_the_text_of_a_row(spark, tmp_path, small_splits):
    """The last row of a task is found by its place among all lines, and its fields are read from its text."""
    line = '{{"task_id":"{0}","status":"{1}","exit_code":{2},"started_at":"2024-01-02 03:04:05","metrics":{{"visible_events":{2}}}}}\n'
    for name in ("b", "a"):
        (tmp_path / f"{name}.jsonl").write_text("".join(line.format(i % 50, name, i) for i in range(200)))
    places = store.numbered_lines(spark, str(tmp_path)).collect()
    assert sorted((r.file, r.line_no) for r in places) == [(r.file, r.line_no) for r in sorted(places, key=lambda r: r.place)]
    assert sorted(r.place for r in places) == list(range(1, 401))
    tasks, _ = store.read_tasks(spark, str(tmp_path))
    plan = [x for x in tasks._jdf.queryExecution().executedPlan().toString().splitlines() if "max_by(" in x]
    assert len(plan) == 2 and all("max_by(row_text" in x and "struct(" not in x for x in plan)
    got = tasks.select("task_id", "status", "exit_code", F.col("started_at").cast("string"), "metrics.visible_events", "cwd")
    assert sorted(tuple(r) for r in got.collect()) == sorted((str(i), "b", 150 + i, "2024-01-02 03:04:05", 150 + i, None) for i in range(50))


def test_modes(spark, tmp_path):
    (tmp_path / "t1.jsonl").write_text('{"seq":1,"type":"log","message":"m","location":{"file":"f","line":2}}\n\nbad\n')
    good, corrupt = store.read_events(spark, str(tmp_path))
    assert [(r.task_id, r.seq, r.file, r.line) for r in good.collect()] == [("t1", 1, "f", 2)]
    assert [r.line_no for r in corrupt.collect()] == [3]
    assert store.read_events(spark, str(tmp_path), "skip")[1].count() == 0
    with pytest.raises(PySparkException):
        store.read_events(spark, str(tmp_path), "fail")[0].collect()


def test_fixture_pairs(spark, tmp_path):
    (tmp_path / "go").mkdir()
    (tmp_path / "go" / "one.txt").write_text("a\nb\n")
    (tmp_path / "go" / "one.json").write_text('[{"type":"log","message":"a"},{"type":"log","message":"b","line":3}]')
    lines, expected = store.read_fixtures(spark, str(tmp_path))
    assert {(r.fixture, r.parser_name, r.line_no, r.text) for r in lines.collect()} == {
        ("go/one", "go", 1, "a"), ("go/one", "go", 2, "b")}
    assert [(r.idx, r.message, r.line) for r in expected.orderBy("idx").collect()] == [(1, "a", None), (2, "b", 3)]


def test_hot_reload(spark, tmp_path):
    catalog = RuleCatalog([tmp_path])
    catalog._checked -= 10
    assert catalog.refresh(spark) is None
    (tmp_path / "mytool.toml").write_text(
        '[meta]\nname = "mytool"\npriority = 60\n[[pattern]]\nname = "x"\nregex = "^x"\nevent_type = "log"\nseverity = "info"\n')
    catalog._checked -= 10
    diff = catalog.refresh(spark)
    assert [(r.parser, r.change, r.rules_delta) for r in diff.collect()] == [("mytool", "added", 1)]


def rows(spark, path, version=None):
    return sorted(r.n for r in commits.read_committed(spark, path, "n int", "json", version).collect())


def test_commits_show_whole_states(spark, tmp_path):
    """A reader between data and manifest sees what was there; a batch counts once; a replacement ends what was before."""
    path, seen = str(tmp_path / "table"), []
    part = lambda n: spark.createDataFrame([(n,)], "n int").write.json
    assert rows(spark, path) == []

    def looking(folder):
        part(2)(folder)
        seen.append(rows(spark, path))

    assert commits.commit(part(1), spark, path, "a") == 1
    assert commits.commit(looking, spark, path, "b") == 2 and seen == [[1]]
    assert commits.commit(part(9), spark, path, "b") == 2
    assert rows(spark, path) == [1, 2]
    assert commits.commit(part(5), spark, path, replaces=True) == 3
    assert rows(spark, path) == [5] and rows(spark, path, 2) == [1, 2]


def test_writers_at_the_same_time(spark, tmp_path):
    """One that finds its number taken takes the next; the same batch by two writers counts once."""
    path = str(tmp_path / "table")
    part = lambda n: spark.createDataFrame([(n,)], "n int").write.json

    def overtaken(folder):
        part(1)(folder)
        commits.commit(part(2), spark, path, "other")

    def repeated(folder):
        part(3)(folder)
        commits.commit(part(4), spark, path, "same")

    assert commits.commit(overtaken, spark, path, "first") == 2
    assert commits.commit(repeated, spark, path, "same") == 3
    assert rows(spark, path) == [1, 2, 4]


def test_last_line_without_terminator(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    (tmp_path / "b.txt").write_text("one\r\n\n")
    got = sorted((r.task_id, r.line_no, r.text, r.n_bytes) for r in store.read_raw(spark, str(tmp_path)).collect())
    assert got == [("a", 1, "one", 4), ("a", 2, "two", 3), ("b", 1, "one", 5), ("b", 2, "", 1)]


def test_files_are_written_by_all_tasks(spark, tmp_path, small_splits):
    """Four files hold all lines, whole, and no shuffle brings texts to as few tasks."""
    texts = [f"{i} " + "wörd " * (i % 40) for i in range(2000)] + ["", "a\nb", None]
    spark.createDataFrame([(t,) for t in texts], "text string").repartition(1).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    out = tmp_path / "out put"  # its URI has an escape
    ranges.write_lines(F.col("text"), rows.unionByName(rows).unionByName(rows.limit(0)), str(out), 4)
    files = sorted(out.glob("*"))
    assert len(files) == 4 and all(f.stat().st_size > 10_000 for f in files)
    got = sorted(line for f in files for line in f.read_text().splitlines())
    assert got == sorted(2 * "\n".join(t for t in texts if t is not None).split("\n"))
    assert store.store_size(spark, str(out)).collect() == [(4, 2 * sum(len(t.encode()) + 1 for t in texts if t is not None))]
    ranges.write_lines(F.col("text"), rows.limit(0), str(tmp_path / "none"), 4)
    assert [f.stat().st_size for f in (tmp_path / "none").glob("*")] == [0] * 4


def test_sized_files_need_no_shuffle_of_texts(spark, tmp_path, monkeypatch):
    """a12_store_size: repartition(4) would bring a quarter of the texts to each task."""
    from pyspark.sql import DataFrame

    monkeypatch.setattr(DataFrame, "repartition", lambda *_: pytest.fail("texts are shuffled"))
    from suite.store_cases import store_size

    assert [r.files for r in store_size(spark, "/root/testdata/sf0.001").collect()] == [4]


def test_files_where_ranges_cannot_be_written(spark, tmp_path, monkeypatch):
    """Spark's writer makes them, with the same lines."""
    monkeypatch.setattr(ranges, "mounted", lambda *_: None)
    ranges.write_lines(F.concat(F.lit("x"), "id"), spark.range(1000), str(tmp_path / "out"), 4)
    files = list((tmp_path / "out").glob("part-*"))
    assert len(files) == 4 and sorted(x for f in files for x in f.read_text().split()) == sorted(f"x{i}" for i in range(1000))


def test_rows_that_change_between_passes_fail(spark, tmp_path):
    rows = spark.range(1000).select(F.expr("repeat('y', cast(double(reflect('java.lang.Math', 'random')) * 50 as int))").alias("text"))
    with pytest.raises(Exception, match="came differently"):
        ranges.write_lines(F.col("text"), rows, str(tmp_path / "out"), 4)
