"""Functions and small operators on hand-made input."""

import datetime
import random
import warnings

import pytest
from pyspark.sql import functions as F

from tracemill.functions import patterns, shell
from tracemill.functions import text as T
from tracemill.functions.extract import RuleBook
from tracemill.operators import audit, extract, lookup, quality, retention
from tracemill.operators import query as Q
from tracemill.plans.conditions import conditional_rules
from tracemill.plans.formats import line_format_events
from tracemill.plans.structure import complete_output, structure_output
from tracemill.sources.rulepacks import Pack, Rule, load_packs, resolve_packs


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(build(F.col("x"))).first()[0]


def test_packs_are_complete():
    packs = load_packs()
    assert len(packs) == 38 and sum(len(p.rules) for p in packs) == 215


def test_repair_and_cap(spark):
    assert one(spark, bytearray(b"a\xffb"), T.repair_utf8, "binary") == "a�b [invalid UTF-8 replaced]"
    assert one(spark, bytearray(b"abcdef"), lambda c: T.cap_line(c, 4), "binary") == "abcd [line truncated at 4 bytes]"
    assert one(spark, bytearray("é".encode() * 3), lambda c: T.cap_line(c, 6), "binary") == "ééé"


def test_clip_keeps_whole_characters(spark):
    clip = one(spark, "é" * 10, lambda c: T.clip_text(c, 10))
    assert clip.text == "éé\n[…]\néé" and clip.clipped and clip.omitted_bytes == 12


@pytest.mark.parametrize("ms, text", [(999, "999ms"), (1000, "1.0s"), (2250, "2.2s"), (2750, "2.8s"), (1950, "1.9s"), (1150, "1.1s")])
def test_duration_text(spark, ms, text):
    assert one(spark, ms, T.duration_text, "long") == text == (f"{ms / 1000:.1f}s" if ms > 999 else text)


@pytest.mark.parametrize("text, words, exe", [
    ("A=1 env -i B=2 nice -n 5 make all", ["make"], 0),
    ("timeout -k 5 10 cargo test", ["cargo"], 0),
    ("if true; then rm x; fi", ["if", "rm", "fi"], 0),
    ("case $a in x) ls ;; esac", ["ls", "esac"], 0),
    ("bash -lc 'git status; ls'", ["bash", "git", "ls"], 0),
    ("echo $(date) `id`", ["echo", "date", "id"], 0),
    ("find . -exec sh -c 'rm x' \\;", ["find", "sh", "rm"], 0),
    ("env -S 'rm -rf /' x", ["rm -rf /", "rm"], 0),
    ("$'\\x72m' -rf /", ["rm"], 0),
])
def test_programs_reached(text, words, exe):
    shape = shell.shape_of(text)
    names = [c["words"][c["exe"]] if c["exe"] >= 0 else "" for c in shape["commands"]]
    assert [n for n in names] == words or [n for n in names if n] == [w for w in words if w]


def command_texts(rng):
    words = ["ls", "-la", "A=1", "_b2=x y", "/usr/bin/git", "make", "'a b'", '"c;d"', "''", "x'y'\"z\"", "$HOME", "${X}", "{}", "a)", "'p)'", "sudo", "env", "find",
             "bash", "-c", "case", "then", "2", "\\n", "$(id)", "`id`", "#c", "$'x'", "é", "(", "'", '"', "'it; is | x'", "1=2", "$\"q\""]
    signs = [" ", "  ", "\t", ";", ";;", " && ", "||", " | ", "|", "&", " > ", ">>", "2>&1", "<", "\n", " ; ", "&>", "|&", "<>", "\r"]
    out = ["", None, " ", "ls", "A=1", "A=1 ls", "a;", ";a", "ls -la | grep 'a; rm -rf /'", "x " * 3000, "'a'" * 2000]
    for _ in range(3000):
        odd = rng.random() < 0.4
        pick = lambda: rng.choice(words if odd else words[:13] + ["'it; is | x'", "1=2"])
        out.append("".join(x for _ in range(rng.randint(1, 7)) for x in (pick(), rng.choice(signs[: 20 if odd else 17]))))
    return out


def test_plain_commands_need_no_scanner(spark):
    """Expressions give what the scanner gives, and leave it only commands that have more to them."""
    texts = command_texts(random.Random(4))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, command string")
    plain = {r.id: r.x for r in rows.select("id", shell._plain_shape(F.coalesce("command", F.lit(""))).cast(shell.SHAPE).alias("x")).collect()}
    both = {r.id: r.shape.asDict(True) for r in shell.with_shape(rows).collect()}
    for k, text in enumerate(texts):
        want = shell.shape_of(text or "")
        assert both[k] == want, text
        assert plain[k] is None or plain[k].asDict(True) == want, text
    easy = [k for k, t in enumerate(texts) if t and not set(t) & set("\\`()#\r{}é$\"'") and not any(w in t for w in ("sudo", "env", "find", "bash", "case", "then"))]
    assert len(easy) > 200 and all(plain[k] for k in easy if len(texts[k]) < 4000)
    assert sum(x is not None for x in plain.values()) > 1500


@pytest.mark.parametrize("pattern, text, first", [
    (r"(?P<file_name>\w+)\.rs", "see main.rs", "main"), (r"(?<file>\w+)\.rs", "see main.rs", "main"),
    (r"^(\p{L}+)$", "größe", "größe"), (r"(ab)\z", "ab", "ab"), (r"(\x{41}b)", "Ab", "Ab"), (r"(\u{1F600})", "a😀", "😀"),
    (r"([[:alpha:]_]+)", "9x_é", "x_"), (r"([[:^digit:]]+)", "12ab", "ab"),
])
def test_rule_dialect(spark, pattern, text, first):
    """Named groups, Unicode classes and \\z are rules, and match in Java."""
    assert patterns.is_safe(pattern)
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_extract("t", patterns.java(pattern), 1).alias("x")).first()
    assert row.x == first


@pytest.mark.parametrize("pattern", [
    "(a+)+", "(a*)*", "(a*b*)*", "(a?b?)*", "(x{2,3})*", "(a|b|ab)*c", "(a|ab|b)*", "(?:a|a)*", "(?i)(a|A)*", r"(\w+\s?)*x",
    r"(?:\p{L}|\d)+x", "(.|x)*y", r"(\s|\t)+;", "([ab]|b[c])*(a|aa)+$", "(a", "(a)?(?(1)b|c)", "[b-a]",
])
def test_unusable_rules_are_refused(spark, pattern):
    """What Java cannot compile, and loops that one string can go round in two ways."""
    assert not patterns.is_safe(pattern)


@pytest.mark.parametrize("pattern", [
    "(a|ab)*c", "(ab)*", "(?:a|b)*c", r"(\w+\s)*x", r"^(\d+\.)*\d+$", "(.*)(.*)", "((a|b)c)*", "@{59}", "(a{1,30}b)*",
    r"[^:]+:\d+(?::\d+)?", r"(?:[^|]|\|\|)+", r"(?:\d{1,3}\.){3}\d{1,3}", "(?<!a)b+(?=c)", r"\Qa+\E+b", "a*+b",
])
def test_rules_without_such_loops_are_kept(spark, pattern):
    """They are run on a text that repeats, so one that takes exponential time would show."""
    assert patterns.is_safe(pattern)
    text = F.repeat(F.lit("ab a:1.2|| @"), 40)
    assert spark.range(1).select(text.rlike(patterns.java(pattern)).alias("x")).first().x in (True, False)


def test_bundled_rules_compile_in_java(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert sum(len(p.rules) for p in load_packs()) == 215


def test_one_long_task_needs_no_cap(spark):
    """Segments of three lines give what one window over the whole task gives."""
    texts = ["error: bad", "  --> a.rs:1:1", "   | ^^^ x", "  = note: y", "same", "same", "same", "same", "warning: odd", "  --> b.rs:2:2", "done"] * 9
    lines = spark.createDataFrame(
        [("t", n, "stdout", s, len(s) + 1) for n, s in enumerate(texts, 1)],
        "task_id string, line_no long, source string, text string, n_bytes long")
    tasks = spark.createDataFrame([("t", "cargo")], "task_id string, parser_name string")
    packs = resolve_packs(load_packs([]))
    want = structure_output(lines, tasks, packs, max_bytes=10**9).orderBy("seq").collect()
    for width in (3, 100_000):
        got = structure_output(lines, tasks, packs, width=width).orderBy("seq")
        assert got.select(*want[0].asDict()).collect() == want


def test_nesting_limit():
    assert shell.shape_of("$(" * 70 + "ls" + ")" * 70)["too_deep"]


def test_stateful_conditions(spark):
    rules = (
        Rule("open", "summary", "info", "^begin", state_transition="in=yes"),
        Rule("inside", "diagnostic", "error", "^bad (.+)", {"message": 1}, state_condition="in=yes"),
        Rule("close", "summary", "info", "^end", state_transition="in=no"),
    )
    pack = Pack("p", rules, stateful=True)
    lines = [("t", n, "stdout", s, "p", 9) for n, s in enumerate(["bad 0", "begin", "bad 1", "end", "bad 2"], 1)]
    df = spark.createDataFrame(lines, "task_id string, line_no long, source string, text string, parser_name string, n_bytes long")
    rows = extract.apply_stateful_rules(df, [pack]).orderBy("line_no").collect()
    assert [(r.line_no, r.message) for r in rows] == [(2, "begin"), (3, "1"), (4, "end")]
    other = df.withColumns({"task_id": F.lit("u"), "parser_name": F.lit("none")}).filter("line_no = 1")
    out = extract.parse_tagged_lines(df.unionByName(other).repartition(3), [pack]).orderBy("task_id", "line_no", "idx").collect()
    assert [(r.task_id, r.line_no, r.tier, r.message) for r in out] == [
        ("t", 1, "raw", "bad 0"), ("t", 2, "stateful", "begin"), ("t", 3, "stateful", "1"),
        ("t", 4, "stateful", "end"), ("t", 5, "raw", "bad 2"), ("u", 1, "raw", "bad 0")]


@pytest.mark.parametrize("width", [1, 3, 1000])
def test_conditions_compose_over_segments(spark, width):
    """Rules that gate rules and toggle their own key, against playing the lines one by one."""
    rng = random.Random(width)
    texts = {"a": (None, "x=1"), "b": ("x=1", "y=1"), "c": ("y=1", "x=2"), "d": ("x=2", "x=1"), "e": ("y=1", None), "f": ("x=2", "y=0"), "g": (None, None)}
    rules = tuple(Rule(k, "log", "info", f"{k}", {}, state_condition=n, state_transition=c) for k, (n, c) in texts.items())
    packs = [Pack("p", rules, stateful=True), Pack("q", rules[1:4], stateful=True)]
    rows, want = [], {}
    for task in range(6):
        state, pack = {}, packs[task % 2]
        for line in range(1, rng.randint(2, 400)):
            text = "".join(rng.sample("abcdefgh", rng.randint(1, 3)))
            rows.append((f"t{task}", line, text, pack.name))
            for k, rule in enumerate(pack.rules):
                need, change = (v.split("=") if v else None for v in (rule.state_condition, rule.state_transition))
                if rule.name in text and (need is None or state.get(need[0]) == need[1]):
                    want.setdefault((f"t{task}", line), []).append(rule.name)
                    state.update([change] if change else [])
    lines = spark.createDataFrame(rows, "task_id string, line_no long, text string, parser_name string")
    book = RuleBook(packs)
    matched = lines.withColumn("many", book.stateful_rules(F.col("text"), F.col("parser_name"))).filter(F.size("many") > 0)
    numbers = [n for p in packs for n, _ in book.by_pack[p.name]]
    names = dict(zip(numbers, [r.name for p in packs for r in p.rules]))
    out = conditional_rules(matched.repartition(3), "many", numbers, [p.active_rules for p in packs], width)
    assert out.columns == matched.columns
    assert {(r.task_id, r.line_no): [names[n] for n in r.many] for r in out.collect() if r.many} == want


def test_user_pack_wins_tie(tmp_path):
    (tmp_path / "go.toml").write_text(
        '[meta]\nname = "go"\npriority = 50\n[[pattern]]\nname = "x"\nregex = "^x"\nevent_type = "log"\nseverity = "info"\n')
    (tmp_path / "broken.toml").write_text("[[[")
    with pytest.warns(UserWarning):
        packs = {p.name: p for p in resolve_packs(load_packs([tmp_path]))}
    assert packs["go"].source == "user" and packs["go"].detect == ("go",) and len(packs["go"].rules) == 1


def test_version_suffix_and_nested_detection(spark):
    commands = ["python3.12 a.py", "gcc-14 x.c", "npmx run", "sh -c 'cargo test -q'", "ls | npm test", "rg 'x; cargo build'"]
    df = spark.createDataFrame([(c,) for c in commands], "command string")
    got = {r.command: r.detected for r in extract.detect_tool(df, load_packs()).collect()}
    assert [got[c] for c in commands] == ["python", "cc", None, "cargo-test", "npm", "inspection"]


def test_secondary_and_primary(spark):
    rows = [("t", 1, "log", "error", None, "noise", None, None), ("t", 2, "diagnostic", "error", None, "Traceback (most", None, None),
            ("t", 3, "summary", "error", None, "s", None, None), ("t", 4, "diagnostic", "error", "E", "why", "f", 1)]
    events = spark.createDataFrame(rows, "task_id string, seq long, type string, severity string, code string, message string, file string, line long")
    assert Q.primary_diagnostic(events).first().seq == 4


def test_prune_edges(spark):
    tasks = spark.createDataFrame(
        [(str(i), "running" if i % 3 == 0 else "completed", datetime.datetime(2024, 1, 1 + i)) for i in range(9)],
        "task_id string, status string, started_at timestamp")
    assert retention.removed_by_keep(tasks, 0).count() == 6
    assert retention.removed_by_keep(tasks, 100).count() == 0
    assert {r.task_id for r in retention.removed_by_keep(tasks, 2).collect()} == {"1", "2", "4", "5"}


def test_scrub_keeps_broken_rows(spark):
    rows = ['{"a":"q\\"c","context":1}', '{"context":', 'plain', '{"b": 1}']
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    assert [r.value for r in retention.scrub_context(df).collect()] == ['{"a":"q\\"c"}', rows[1], rows[2], rows[3]]


def test_diagnose_checks(spark):
    runs = spark.createDataFrame(
        [("a", "tool", "EXIT_CODE: 101\nCODE: E0308\nMESSAGE: mismatched\nLOCATION: src/m.rs:4", "[]", "ok"),
         ("b", "tool", "nothing", "[]", "ok")],
        "task_id string, mode string, last_message string, tools string, status string")
    expected = spark.createDataFrame(
        [(t, 101, "E0308", ["mismatch"], "src/m.rs", 4) for t in "ab"],
        "task_id string, exit_code int, code string, message_contains array<string>, location_file string, location_line int")
    got = {r.task_id: r.success for r in quality.score_diagnose(runs, expected).collect()}
    assert got == {"a": True, "b": False}


@pytest.mark.parametrize("command, blocked", [
    ("rm -rf ${DIR}", True), ("rm -r x", False), ("git checkout -- .", True), ("git checkout main", False),
    ("git restore --staged f", False), ("git restore f", True), ("find ~ -delete", True), ("eval ls", False),
    ("bash -c '$X y'", True), ("rm -$FLAGS /", True), ("git -c clean.requireForce=false clean", True),
    ("{ rm -rf / ; }", True), ("(cd a && rm -fr ..)", True), ("busybox rm -rf /", True), ("ls", False),
])
def test_guardrails(spark, command, blocked):
    tasks = spark.createDataFrame([("1", command)], "task_id string, command string")
    assert audit.guardrail_scan(tasks).first().blocked is blocked


def outputs(rng):
    """Texts near the border of each format."""
    piece = lambda: rng.choice(['1', '"a,b]"', '{"level": "error", "msg": "x\\"y"}', '[1, [2]]', 'null', '"\\\\"', '{"a":\n [1,\n2]}', '[]', '{}', '-', '"open', '1 2'])
    array = lambda n: "[" + rng.choice([",", " , ", ",\n", "\n,\n"]).join(piece() for _ in range(n)) + "]"
    plain = ["a: 1", "# c", "", "b: c: d", "x", "---", "a,b", "c,d", "p|q", "\ta\tb", "t\tu\t", '{"a":1}', '{"b":[', "}"]
    out = ["", " \n ", "[]", "[ ]", "[,]", "[1,]", "{}", "[1]]", "[1] x", '{"a":1} {"b":2}', "[[1],[2", "[{]}", '["a\nb"]', "]", "a\\b,c\nd,e\\", "\r\n[1,\r\n2]\r\n"]
    for _ in range(60):
        out.append(array(rng.randint(0, 5)) if rng.random() < 0.5 else "\n".join(rng.choices(plain, k=rng.randint(1, 7))))
        out.append("\n".join(rng.choices(plain[rng.randint(0, 12):][:3], k=rng.randint(1, 8))))
        out.append(rng.choice(["", "\n", " \n\t"]) + '{"k": ' + array(2) + "}" + rng.choice(["", "\n\n", "\n{}"]))
    return out


@pytest.mark.parametrize("width", [1, 100_000])
def test_formats_by_lines_equal_whole_texts(spark, width):
    texts = outputs(random.Random(width))
    raw = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "task_id string, raw string")
    lines = [(f"t{k}", 2 * n, line) for k, t in enumerate(texts) for n, line in enumerate(t.split("\n"), 1)]
    found = line_format_events(spark.createDataFrame(lines, "task_id string, line_no long, text string").repartition(4), width)
    want = extract.format_events(raw)
    columns = want.columns
    show = lambda df: sorted(map(repr, df.select(*columns).collect()))
    assert show(found) == show(want) and want.select("format").distinct().count() == 4


def test_long_array_is_cut_into_items(spark):
    """An array of 12 MB, above what was read as one, over many lines, and one in one line."""
    line = F.concat(F.when(F.col("id") == 0, "[").otherwise(","), F.lit('{"level":"error","msg":"'), F.repeat(F.lit("x,]"), 600), F.lit('","code":'), "id", F.lit("}"))
    many = spark.range(6_000).select(F.lit("many").alias("task_id"), (F.col("id") + 1).alias("line_no"), line.alias("text"))
    many = many.unionByName(spark.createDataFrame([("many", 6_001, "]"), ("one", 1, "[" + ",".join(['{"a": [1, "]"]}'] * 3_000) + "]")], many.schema))
    rows = line_format_events(many, 1_000).groupBy("task_id", "format", "type").agg(F.count("*"), F.max("item")).collect()
    assert sorted(map(tuple, rows)) == [("many", "json", "diagnostic", 6_000, 6_000), ("one", "json", "data", 3_000, 3_000)]


def test_complete_output_reads_an_array_of_any_size(spark):
    """Data events of 12 MB of one task's output, behind its own events; a task with a JSON line gives none."""
    line = F.concat(F.when(F.col("id") == 0, "[").otherwise(","), F.lit('{"level":"error","msg":"'), F.repeat(F.lit("x,]"), 600), F.lit('","code":'), "id", F.lit("}"))
    rows = spark.range(6_000).select(F.lit("many").alias("task_id"), (F.col("id") + 1).alias("line_no"), line.alias("text"))
    rows = rows.unionByName(spark.createDataFrame([("many", 6_001, "]"), ("mixed", 1, '{"level":"info","msg":"m"}'), ("mixed", 2, "[1]")], rows.schema))
    lines = rows.select("*", F.lit("stdout").alias("source"), (F.octet_length("text") + 1).cast("long").alias("n_bytes"))
    tasks = spark.createDataFrame([("many", None, 0), ("mixed", None, 0)], "task_id string, parser_name string, exit_code int")
    out = complete_output(lines, tasks, [], width=1_000)
    own, data = out.filter("tier <> 'format' and task_id = 'many'"), out.filter("tier = 'format'")
    assert [tuple(r) for r in data.groupBy("task_id", "type").agg(F.count("*")).collect()] == [("many", "diagnostic", 6_000)]
    assert data.agg(F.min("seq")).first()[0] == own.agg(F.max("seq")).first()[0] + 1
    assert out.groupBy("task_id", "seq").count().filter("count > 1").count() == 0


def test_code_references_in_a_form_of_their_own(spark):
    events = spark.createDataFrame(
        [("cargo", 1, "E1"), ("cargo", 2, "E2"), ("cargo", 3, None), ("none", 1, "E1"), ("npm", 1, "E1"), ("gone", 1, "E1"), ("twice", 1, "E1"), (None, 1, "E1")],
        "task_id string, seq long, code string")
    tasks = spark.createDataFrame(
        [("cargo", "cargo"), ("none", None), ("npm", "npm"), ("twice", "cargo"), ("twice", ""), (None, "cargo")], "task_id string, parser_name string")
    refs = spark.createDataFrame(
        [("cargo", "E1", "b"), ("cargo", "E1", "a"), ("cargo", "E1", "a"), ("go", "E1", None), (None, "E1", "x"), ("", "E1", "y"), ("go", "E2", "z"), ("go", None, "q")],
        "tool string, code string, message string")
    text = lambda r: F.array_join(F.transform(r, lambda x: F.concat(x["tool"], F.lit(":"), x["message"])), "|")
    found = lookup.attach_code_refs(events, tasks, refs, text)
    every, own = ":y|cargo:a|cargo:a|cargo:b", "cargo:a|cargo:a|cargo:b"
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, [
        ("cargo", 1, "E1", own), ("cargo", 2, "E2", None), ("cargo", 3, None, None), ("none", 1, "E1", every), ("npm", 1, "E1", None),
        ("gone", 1, "E1", every), ("twice", 1, "E1", own), ("twice", 1, "E1", ":y"), (None, 1, "E1", every)]))
    later = lookup.attach_code_refs(events, tasks, refs).withColumn("reference", text("reference"))
    assert sorted(map(repr, later.collect())) == sorted(map(repr, found.collect()))
