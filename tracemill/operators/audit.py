"""Command-log audit: shape, carrier, route, policy, guardrails, limits.

`with_shape` reads a command's words once; everything after it is Spark columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import computed, contains_any, java, let
from ..functions.shell import FLAGS, with_shape
from ..plans.segments import KEY, running_total

# ---- fixed values -------------------------------------------------------------------
INSPECTION_TOOLS = [
    "echo", "cat", "ls", "ll", "dir", "pwd", "whoami", "date", "env", "printenv", "uname",
    "hostname", "id", "groups", "tty", "head", "tail", "wc", "stat", "file", "which", "whereis",
    "uniq", "sort", "cut", "tr", "printf", "locate", "du", "df", "pgrep", "pidof", "true", "false",
    "test", "[", "basename", "dirname", "realpath", "readlink", "expr", "seq", "grep", "egrep",
    "fgrep", "rg", "ag", "sed",
]
LITERAL_TOOLS = ["rg", "grep", "egrep", "fgrep", "ag", "head", "tail", "sort", "uniq", "wc", "cut", "tr"]
DATA_TOOLS = ["echo", "printf"]
SCRIPT_TOOLS = ["node", "nodejs", "deno", "bun", "ruby", "perl", "php", "Rscript", "lua"]
WATCH_WORDS = ["--watch", "--follow", "-f", "daemon"]
SHORT_BYTES, SHORT_WORDS = 80, 5
BLOCKED_PATTERNS = [
    r"""rm\s+-rf\s*(?:--\s*)?["']?[/~]""", r"""rm\s+--recursive\s+--force\s*["']?[/~]""",
    r"rm\s*\$\{IFS\}-rf", r"dd\s+if=", r"mkfs\.", r"mkfs\s",
    r"curl.*\|\s*(ba)?sh", r"wget.*\|\s*(ba)?sh", r"\|\s*(ba)?sh",
    r"\|\s*base64\s+-d\s*\|\s*(ba)?sh", r"base64\s+-d.*\|\s*(ba)?sh", r"eval\s+\$\(|eval\s+`",
    r"sudo\s+.*rm\s+-[a-zA-Z]*[rR]", r"sudo\s+.*rm\s+-[a-zA-Z]*[fF]",
    r"sudo\s+.*\b(dd|mkfs|fdisk|parted)\b", r"sudo\s+.*\bchmod\s+(-R\s+)?777\b", r"sudo\s+su\b",
    r"su\s+-", r"cat\s+.*\.ssh/(id_rsa|id_ed25519|id_dsa|id_ecdsa|authorized_keys)",
    r"/proc/self/environ", r"/proc/\d+/environ", r"nc\s+-l", r"ncat\s+-l", r"chmod\s+(-R\s+)?777",
    r":\(\)\{\s*:\|:&\s*\};:",
]
GUARDRAIL_REASON = "command matched a security guardrail or exceeded the shell analysis nesting limit"
GIT_VALUE_OPTIONS = ["-C", "-c", "--config-env", "--exec-path", "--git-dir", "--work-tree",
                     "--namespace", "--super-prefix"]
CONCURRENCY_LIMIT = 4
RATE_BURST, RATE_PER_SECOND = 20.0, 10.0
# -------------------------------------------------------------------------------------

MARK = "\x01"


def _program(command: Column) -> Column:
    """Base name of the program a simple command runs, '' if none."""
    word = F.when(command["exe"] >= 0, F.element_at(command["words"], command["exe"] + 1))
    return F.coalesce(F.element_at(F.split(word, "/"), -1), F.lit(""))


def _visible(shape: str = "shape") -> Column:
    return F.filter(f"{shape}.commands", lambda c: c["origin"].isin("top", "nested"))


def _top(shape: str = "shape") -> Column:
    return F.filter(f"{shape}.commands", lambda c: c["origin"] == "top")


def command_flags(tasks: DataFrame) -> DataFrame:
    """Shell structure per command and the programs it runs, nested shells included."""
    shaped = with_shape(tasks)
    programs = F.filter(F.transform(_visible(), _program), lambda p: p != "")
    return shaped.select("task_id", *[F.col(f"shape.{f}").alias(f) for f in FLAGS],
                         F.size(_top()).alias("n_commands"), programs.alias("programs"))


def nested_commands(tasks: DataFrame) -> DataFrame:
    """One row per simple command, whatever level it runs at."""
    shaped = with_shape(tasks)
    return shaped.select("task_id", F.posexplode("shape.commands").alias("position", "c")).select(
        "task_id", "position", "c.origin", _program(F.col("c")).alias("program"),
        F.array_join("c.words", " ").alias("words"),
    )


def carrier_class() -> Column:
    """What a shaped command is carried by: an interpreter, composed shell, or a plain call."""
    flags = F.lit(False)
    for flag in FLAGS:
        flags = flags | F.col(f"shape.{flag}")
    first = F.coalesce(_program(F.try_element_at(_top(), F.lit(1))), F.lit(""))
    return let(first, lambda base: (
        F.when(F.trim("command") == "", "unknown")
        .when((base == "py") | base.startswith("python"), "python")
        .when(base.isin(SCRIPT_TOOLS), "script_other")
        .when(flags | (F.size(_top()) > 1), "shell_composite")
        .otherwise("shell")
    ))


def classify_carrier(tasks: DataFrame) -> DataFrame:
    return with_shape(tasks).select("task_id", carrier_class().alias("carrier"))


def classify_route(tasks: DataFrame) -> DataFrame:
    """`fast` for short read-only commands, else `structured`.

    `tasks` may carry `detected` and `route` of the tool detection.
    """
    shaped = with_shape(tasks)
    detected = F.col("detected").isNotNull() if "detected" in tasks.columns else F.lit(False)
    is_fast = F.coalesce(F.col("route") == "fast", F.lit(False)) if "route" in tasks.columns else F.lit(False)
    programs = F.filter(F.transform(_top(), _program), lambda p: p != "")
    inspects = (F.size(programs) > 0) & F.forall(programs, lambda p: p.isin(INSPECTION_TOOLS))

    def unsafe(c: Column) -> Column:
        words, name = c["words"], _program(c)
        return (
            ((name == "tail") & F.exists(words, lambda w: w.isin("-f", "--follow")))
            | ((name == "sed") & F.exists(words, lambda w: w.startswith("-i")))
            | ((name == "sort") & F.exists(words, lambda w: (w == "-o") | w.startswith("--output")))
        )

    words = F.flatten(F.transform(_top(), lambda c: c["words"]))
    watches = F.exists(words, lambda w: w.isin(WATCH_WORDS) | w.endswith(".server"))
    s = {f: F.col(f"shape.{f}") for f in FLAGS}
    fast = (
        F.when(F.trim("command") == "", True)
        .when(s["redirection"] | s["background"] | s["substitution"] | s["nested_shell"], False)
        .when(inspects & ~F.exists(_top(), unsafe) & (~detected | is_fast), True)
        .when(F.exists(_top(), unsafe) | s["pipe"], False)
        .when(detected & ~is_fast, False)
        .when(watches | s["control"], False)
        .otherwise((F.octet_length(F.trim("command")) <= SHORT_BYTES) & (F.size(words) <= SHORT_WORDS))
    )
    return shaped.select("task_id", F.when(fast, "fast").otherwise("structured").alias("route_class"))


def policy_reason(patterns: Sequence[str] = BLOCKED_PATTERNS, custom: Sequence[str] = ()) -> Column:
    """First blocked pattern of a shaped command.

    Bundled patterns see the command without quoting, and without text that is only data: the
    arguments of a lone echo or printf, and quoted search text of a pure reader pipeline.
    Custom patterns see the exact text.
    """
    composed = F.lit(False)
    for flag in FLAGS:
        composed = composed | F.col(f"shape.{flag}")
    programs = F.transform(_top(), _program)
    lone_data = (F.size(_top()) == 1) & ~composed & F.forall(programs, lambda p: p.isin(DATA_TOOLS))
    readers = (F.size(_top()) > 0) & F.forall(programs, lambda p: p.isin(LITERAL_TOOLS))
    candidate = (
        F.when(lone_data, F.element_at(programs, 1))
        .when(readers, F.col("shape.blanked")).otherwise(F.col("shape.plain"))
    )

    def first(text: Column) -> Column:
        cond = F
        for pattern in patterns:
            cond = cond.when(text["p"].rlike(java(pattern)), f"matches pattern '{pattern}'")
        for pattern in custom:
            cond = cond.when(text["c"].rlike(java(pattern)), f"matches pattern '{pattern}'")
        return cond.otherwise(None)

    return let(F.struct(candidate.alias("p"), F.col("command").alias("c")), first)


def policy_scan(tasks: DataFrame, patterns=BLOCKED_PATTERNS, custom=()) -> DataFrame:
    """Commands that match a blocked pattern, with the reason."""
    judged = computed(with_shape(tasks), "reason", policy_reason(patterns, custom))
    return judged.select("task_id", "command", "reason").filter(F.col("reason").isNotNull())


# ---- guardrails ---------------------------------------------------------------------


def _expands(word: Column) -> Column:
    """The shell may replace the word by something else."""
    return contains_any(word, ["$", "`", "*", "?", "["]) | (
        word.contains("{") & word.contains(",") & word.contains("}")
    )


def _protected(path: Column) -> Column:
    return path.rlike(r"^[/~]|\$|(^|/)\.\.(/|$)|^(\.|\*|\./\*)/*$")


def _args(c: Column) -> Column:
    return F.slice(c["words"], c["exe"] + 2, F.greatest(F.size(c["words"]) - c["exe"] - 1, F.lit(0)))


def _exe_word(c: Column) -> Column:
    return F.coalesce(F.when(c["exe"] >= 0, F.element_at(c["words"], c["exe"] + 1)), F.lit(""))


def _removes_recursively(c: Column, args: Column) -> Column:
    """A recursive forced rm of a protected target, with unclear words read as the worst case."""

    def test(split: Column) -> Column:
        options, rest = split["options"], split["rest"]
        short = F.filter(options, lambda w: w.rlike("^-[^-]"))
        unclear = F.exists(short, lambda w: w.contains("$") | w.contains("`"))
        targets = F.concat(F.filter(options, lambda w: ~w.rlike("^-.")), rest)
        literal = F.exists(targets, lambda w: _protected(w) & ~_expands(w))
        dynamic = F.size(F.filter(options, _expands))
        recursive = unclear | F.array_contains(options, "--recursive") | F.exists(
            short, lambda w: w.rlike("^-[^$`]*[rR]"))
        force = unclear | F.array_contains(options, "--force") | F.exists(
            short, lambda w: w.rlike("^-[^$`]*f"))
        worst = (dynamic > 0) & (recursive | force | literal | (dynamic > 1))
        target = unclear | F.exists(targets, lambda w: _protected(w) | _expands(w))
        return ((recursive & force) | worst) & target

    cut = F.array_position(args, "--").cast("int")
    options = F.when(cut > 0, F.slice(args, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(args)
    rest = F.when(cut > 0, F.slice(args, cut + 1, F.size(args))).otherwise(F.slice(args, 1, 0))
    is_rm = (_program(c) == "rm") | _expands(_exe_word(c))
    return is_rm & let(F.struct(options.alias("options"), rest.alias("rest")), test)


def _discards_worktree(c: Column) -> Column:
    """git clean, reset, checkout, restore, switch or stash in a form that loses work."""
    value = "|".join(GIT_VALUE_OPTIONS)
    head = rf"^((?:(?:{value}){MARK}[^{MARK}]*{MARK}|-[^{MARK}]*{MARK})*+)([^{MARK}]+)(?:{MARK}(.*))?$"

    def test(joined: Column) -> Column:
        before = F.regexp_extract(joined, head, 1)
        sub = F.regexp_extract(joined, head, 2)
        rest = F.split(F.regexp_extract(joined, head, 3), MARK)
        lead = F.slice(rest, 1, F.when(F.array_position(rest, "--") > 0, F.array_position(rest, "--").cast("int") - 1)
                       .otherwise(F.size(rest)))
        short_f = lambda ws: F.exists(ws, lambda w: w.rlike("^-[^-]*f"))
        clean_force = short_f(rest) | F.array_contains(rest, "--force") | before.contains(
            f"-c{MARK}clean.requireForce=false{MARK}")
        harmless = F.exists(rest, lambda w: w.isin("--dry-run", "--interactive") | w.rlike("^-[^-]*[ni]"))
        action = F.element_at(F.filter(rest, lambda w: (w != "") & ~w.startswith("-")), 1)
        return (
            ((sub == "clean") & clean_force & ~harmless)
            | ((sub == "reset") & F.exists(rest, lambda w: w.isin("--hard", "--merge")))
            | ((sub == "checkout") & (short_f(lead) | F.array_contains(lead, "--force") | F.array_contains(rest, "--")))
            | ((sub == "restore") & F.exists(rest, lambda w: (w != "") & ((w == "--") | ~w.startswith("-")))
               & ~(F.array_contains(rest, "--staged") & ~F.array_contains(rest, "--worktree")))
            | ((sub == "switch") & F.exists(rest, lambda w: w.isin("--discard-changes", "--force", "-f")))
            | ((sub == "stash") & F.coalesce(
                F.try_element_at(F.filter(rest, lambda w: (w != "") & ~w.startswith("-")), F.lit(1))
                .isin("clear", "drop"), F.lit(False)))
        )

    is_git = (_program(c) == "git") | _expands(_exe_word(c))
    return is_git & let(F.array_join(_args(c), MARK), test)


def _finds_protected(c: Column) -> Column:
    """find starting at a protected place."""
    joined = F.array_join(_args(c), MARK)
    roots = F.regexp_extract(
        joined, rf"^(?:-[HLP]{MARK})*((?:[^-!({MARK}][^{MARK}]*(?:{MARK}|$))*)", 1)
    return (_program(c) == "find") & F.exists(
        F.filter(F.split(roots, MARK), lambda w: w != ""), lambda w: _protected(w) | _expands(w))


def guardrail_hit() -> Column:
    """A shaped command would remove protected files or discard work, at any nesting level."""

    def bad(c: Column, commands: Column) -> Column:
        args = _args(c)
        in_place = F.transform(args, lambda w: F.when(w == "{}", ".").otherwise(w))
        parent = F.try_element_at(commands, c["parent"] + 1)
        from_find = (c["origin"] == "payload") & (c["parent"] >= 0) & F.coalesce(
            _finds_protected(parent), F.lit(False))
        return F.coalesce(
            _removes_recursively(c, args)
            | _discards_worktree(c)
            | ((_program(c) == "eval") & F.exists(args, _expands))
            | (_finds_protected(c) & F.array_contains(args, "-delete"))
            | (from_find & ((_program(c) == "rm") | _removes_recursively(c, in_place)))
            | (c["origin"].isin("nested", "inner") & _expands(_exe_word(c))),
            F.lit(False),
        )

    # most commands name none of these words and skip the deep check
    risky = F.col("command").rlike(
        r"rm|git|eval|find|\\|['\"][\"']|\$|`|\*|\?|\[|\{|xargs|busybox|toybox|coproc")
    deep = let(F.col("shape.commands"), lambda commands: F.exists(commands, lambda c: bad(c, commands)))
    return F.col("shape.too_deep") | (risky & deep)


def guardrail_scan(tasks: DataFrame) -> DataFrame:
    return with_shape(tasks).select("task_id", "command", guardrail_hit().alias("blocked"))


def allowlist_violations(tasks: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Programs run, nested ones included, that are not on the list."""
    programs = F.filter(F.transform(_visible(), _program), lambda p: p != "")
    return with_shape(tasks).select(
        "task_id", F.explode(F.array_distinct(programs)).alias("program")
    ).filter(~F.col("program").isin(list(allowed)))


def _outside(roots: Sequence[str]) -> Column:
    inside = F.lit(False)
    for root in roots:
        root = root.rstrip("/")
        inside = inside | (F.col("cwd") == root) | F.col("cwd").startswith(root + "/")
    climbs = F.col("cwd").rlike(r"(^|/)\.\.(/|$)")
    return F.col("cwd").isNotNull() & (climbs | ~inside)


def cwd_violations(tasks: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Tasks whose cwd is under no allowed root, judged by the path text alone."""
    return tasks.filter(_outside(roots)).select("task_id", "cwd")


def audit_log(
    tasks: DataFrame, patterns: Sequence[str] = BLOCKED_PATTERNS,
    allowed: Sequence[str] | None = None, roots: Sequence[str] | None = None,
) -> DataFrame:
    """One audit row per command: blocked with a reason, else its exit code."""
    reasons = [F.when(guardrail_hit(), GUARDRAIL_REASON), policy_reason(patterns)]
    if allowed is not None:
        programs = F.filter(F.transform(_visible(), _program), lambda p: (p != "") & ~p.isin(list(allowed)))
        unlisted = F.try_element_at(programs, F.lit(1))
        reasons.append(F.when(unlisted.isNotNull(), F.concat(F.lit("'"), unlisted, F.lit("' not in whitelist"))))
    if roots is not None:
        reasons.append(F.when(_outside(roots), "working directory is outside the allowed roots"))
    judged = with_shape(tasks).withColumn("reason", F.coalesce(*reasons))
    blocked = F.col("reason").isNotNull()
    return judged.select(
        F.col("started_at").alias("ts"), "task_id", "command", "cwd",
        F.when(~blocked, F.col("exit_code")).alias("exit_code"), blocked.alias("blocked"), "reason",
    )


# ---- limits -------------------------------------------------------------------------


def rate_limit_replay(
    requests: DataFrame, key: str = "key", ts: str = "ts", tie: str = "event_id",
    burst: float = RATE_BURST, rate: float = RATE_PER_SECOND,
) -> DataFrame:
    """Mark the requests a token bucket per key would have rejected (`rejected`).

    After burst/rate idle seconds the bucket is full whatever came before, so a key's time
    line falls into independent sessions; they, not whole keys, are the groups.  Sessions of
    no more requests than the bucket holds reject nothing and never leave the JVM.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    day = 86_400_000_000
    rows = requests.select("*", us.alias("_us")).withColumn("_day", F.expr(f"_us div {day}"))
    local = Window.partitionBy(key, "_day").orderBy("_us", tie)
    days = Window.partitionBy(key).orderBy("_day")
    last = rows.groupBy(key, "_day").agg(F.max("_us").alias("_last")).select(
        key, "_day", F.lag("_last").over(days).alias("_before"))
    idle = int(burst / rate * 1_000_000)
    rows = rows.join(last, [key, "_day"])
    gap = F.col("_us") - F.coalesce(F.lag("_us").over(local), F.col("_before"))
    rows = rows.withColumn("_starts", F.coalesce(gap >= idle, F.lit(True)))
    # a session is named by its first request; one that runs over midnight takes the carried name
    first = F.last(F.when(F.col("_starts"), F.col("_us")), ignorenulls=True)
    named = rows.withColumn("_own", first.over(local.rowsBetween(Window.unboundedPreceding, 0)))
    carried = rows.groupBy(key, "_day").agg(
        F.max(F.when(F.col("_starts"), F.col("_us"))).alias("_name")
    ).select(key, "_day", F.last("_name", ignorenulls=True).over(
        days.rowsBetween(Window.unboundedPreceding, -1)).alias("_prior"))
    sessions = named.join(carried, [key, "_day"]).withColumn("_session", F.coalesce("_own", "_prior"))

    def replay(batches):
        # rows arrive sorted by session and time; the bucket is all that is kept between them
        session, tokens, before = None, burst, 0
        for frame in batches:
            out = []
            for name, now in zip(zip(frame[key], frame["_session"]), frame["_us"]):
                if name != session:
                    session, tokens = name, burst
                else:
                    tokens = min(burst, tokens + (now - before) / 1e6 * rate)
                before = now
                out.append(tokens < 1.0)
                tokens -= tokens >= 1.0
            yield pd.DataFrame({key: frame[key], tie: frame[tie], "rejected": out})

    size = F.count(F.lit(1)).over(Window.partitionBy(key, "_session"))
    sessions = sessions.select(key, tie, "_us", "_session").withColumn("_size", size)
    calm = F.col("_size") <= int(burst)
    types = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    schema = f"{key} {types[key]}, {tie} {types[tie]}, rejected boolean"
    ordered = (
        sessions.filter(~calm).drop("_size").repartition(key, "_session")
        .sortWithinPartitions(key, "_session", "_us", tie)
    )
    quiet = sessions.filter(calm).select(key, tie, F.lit(False).alias("rejected"))
    return quiet.unionByName(ordered.mapInPandas(replay, schema))


def concurrency_overflow(
    tasks: DataFrame, key: str = "cwd", limit: int = CONCURRENCY_LIMIT
) -> DataFrame:
    """Tasks that started while `limit` or more others of the same key were running."""
    def second(name):
        return F.unix_micros(F.col(name).cast("timestamp")).alias("us")

    starts = tasks.select(F.col(key).alias(KEY), F.col("task_id").alias("id"), second("started_at"),
                          F.lit(1).cast("long").alias("step"))
    ends = tasks.filter(F.col("finished_at").isNotNull()).select(
        F.col(key).alias(KEY), F.col("task_id").alias("id"), second("finished_at"),
        F.lit(-1).cast("long").alias("step"))
    steps = starts.unionByName(ends)
    counted = running_total(steps, F.col("step"), "running", ("us", "step", "id"), 86_400_000_000)
    return counted.filter((F.col("step") == 1) & (F.col("running") > limit)).select(
        F.col(KEY).alias(key), F.col("id").alias("task_id"), "running")
