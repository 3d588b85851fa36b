"""Extraction operators: tool detection, the tier cascade, whole-output formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.extract import RuleBook
from ..functions.patterns import computed
from ..functions.shell import with_shape
from ..functions.text import looks_like_stderr_error, strip_ansi, trim
from ..plans.conditions import conditional_rules
from ..schemas import EVENT_FIELDS
from ..sources.rulepacks import Pack, resolve_packs
from ..streaming.conditions import IDLE_MS, conditional_rules_live

# ---- tool detection -----------------------------------------------------------------


def _lookup(packs: Sequence[Pack]) -> tuple[list[Pack], dict[str, int], dict[str, int]]:
    ranked = resolve_packs(list(packs))
    names: dict[str, int] = {}
    prefixes: dict[str, int] = {}
    for rank, pack in enumerate(ranked):
        for name in pack.detect:
            names.setdefault(name.lower(), rank)
        for prefix in pack.detect_full:
            prefixes.setdefault(prefix.lower(), rank)
    return ranked, names, prefixes


def _literal_map(entries: dict) -> Column:
    pairs = [F.lit(x) for item in entries.items() for x in item]
    return F.create_map(*pairs) if pairs else F.expr("map(cast(null as string), 0)")


def _command_rank(command: Column, names: dict, prefixes: dict) -> Column:
    """Rank of the best pack for one simple command, null if none."""
    words = F.slice(
        command["words"], command["exe"] + 1, F.greatest(F.size(command["words"]) - command["exe"], F.lit(0))
    )
    program = F.lower(F.element_at(F.split(F.element_at(words, 1), "/"), -1))
    # python3.12 may be claimed as `python3` (exact name plus a version suffix)
    cuts = F.sequence(F.lit(1), F.greatest(F.length(program) - 1, F.lit(1)))
    shortened = F.transform(
        F.filter(cuts, lambda i: F.substring(program, i + 1, F.lit(2)).rlike(r"^[.-][0-9]")),
        lambda i: F.substring(program, F.lit(1), i),
    )
    depth = max((len(p.split()) for p in prefixes), default=0)
    starts = [
        F.lower(F.array_join(F.slice(words, 1, n), " ")) for n in range(1, depth + 1)
    ]
    name_map, prefix_map = _literal_map(names), _literal_map(prefixes)
    ranks = F.concat(
        F.transform(F.concat(F.array(program), shortened), lambda n: F.try_element_at(name_map, n)),
        F.transform(F.array(*starts), lambda p: F.try_element_at(prefix_map, p))
        if starts else F.array(F.lit(None).cast("int")),
    )
    return F.when(command["exe"] >= 0, F.array_min(ranks))


def detect_tool(tasks: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Add `detected` (pack name) and `route`; a fast pack only counts if nothing else matches."""
    ranked, names, prefixes = _lookup(packs)
    fast = [i for i, p in enumerate(ranked) if p.route == "fast"]
    shaped = with_shape(tasks, "_shape")
    visible = F.filter("_shape.commands", lambda c: c["origin"].isin("top", "nested"))
    shaped = shaped.withColumn(
        "_ranks",
        F.array_compact(F.transform(visible, lambda c: _command_rank(c, names, prefixes))),
    )
    is_fast = (lambda r: r.isin(fast)) if fast else (lambda r: F.lit(False))
    slow = F.filter("_ranks", lambda r: ~is_fast(r))
    best = F.coalesce(F.try_element_at(slow, F.lit(1)), F.try_element_at("_ranks", F.lit(1)))
    labels = F.array(*[F.struct(F.lit(p.name).alias("n"), F.lit(p.route).alias("r")) for p in ranked])
    return (
        shaped.withColumn("_best", F.try_element_at(labels, best + 1))
        .withColumns({"detected": F.col("_best.n"), "route": F.col("_best.r")})
        .drop("_shape", "_ranks", "_best")
    )


def _parts(version: Column) -> Column:
    numbers = F.transform(F.split(version, r"\."), lambda p: p.try_cast("int"))
    return F.array_compact(numbers)


def version_ok(version: Column, minimum: Column, maximum: Column) -> Column:
    """min <= version <= max, number by number; whatever does not parse passes."""
    have, low, high = _parts(version), _parts(minimum), _parts(maximum)
    too_low = F.coalesce((F.size(low) > 0) & (have < low), F.lit(False))
    too_high = F.coalesce((F.size(high) > 0) & (have > high), F.lit(False))
    unknown = F.coalesce(F.size(have) == 0, F.lit(True))
    return unknown | ~(too_low | too_high)


def resolve_rules(parsers: DataFrame, tie=("ord",)) -> DataFrame:
    """One parser per name: highest priority, user before builtin, then the `tie` columns."""
    rank = Window.partitionBy("name").orderBy(
        F.desc("priority"), (F.col("source") != "user").cast("int"), *tie
    )
    return parsers.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def active_rules(rules: DataFrame) -> DataFrame:
    return rules.filter(~(F.col("deprecated") & F.col("replaced_by").isNotNull()))


# ---- tiers --------------------------------------------------------------------------


def _event_columns(event: str) -> list[Column]:
    return [F.col(f"{event}.{name}").alias(name) for name in EVENT_FIELDS]


def apply_tier(lines: DataFrame, event: Column, tier: str) -> DataFrame:
    """Lines on which the given event column finds something, as event rows."""
    keep = [c for c in lines.columns if c != "text"]
    return (
        lines.withColumn("_event", event)
        .filter(F.col("_event").isNotNull())
        .select(*keep, *_event_columns("_event"), F.lit(tier).alias("tier"))
    )


def _apply_numbers(lines: DataFrame, book: RuleBook, number: Column, tier: str) -> DataFrame:
    keep = [c for c in lines.columns if c != "text"]
    return (
        lines.withColumn("_no", number)
        .filter(F.col("_no").isNotNull())
        .withColumn("_event", book.event(F.col("text"), F.col("_no")))
        .select(*keep, *_event_columns("_event"), F.lit(tier).alias("tier"))
    )


def apply_line_rules(lines: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """First matching rule of the line's parser (lines carry `parser_name`)."""
    book = RuleBook(packs)
    return _apply_numbers(lines, book, book.line_rule(F.col("text"), F.col("parser_name")), "rule")


def apply_crash_rules(lines: DataFrame) -> DataFrame:
    book = RuleBook()
    return _apply_numbers(lines, book, book.crash_rule(F.col("text")), "crash")


def apply_heuristics(lines: DataFrame) -> DataFrame:
    book = RuleBook()
    return _apply_numbers(lines, book, book.guess_rule(F.col("text")), "heuristic")


def raw_events(lines: DataFrame) -> DataFrame:
    """Every line as a log event, with the severity the keyword fallback would give it."""
    book, keep = RuleBook(), [c for c in lines.columns if c != "text"]
    severity = F.coalesce(F.col("_guess.severity"), F.lit("info"))
    return (
        lines.withColumn("_no", book.guess_rule(F.col("text")))
        .withColumn("_guess", book.event(F.col("text"), F.col("_no")))
        .withColumn("_event", X.raw_event(F.col("text"), severity))
        .select(*keep, *_event_columns("_event"), F.lit("raw").alias("tier"))
    )


def _conditional(packs: Sequence[Pack]) -> list[Pack]:
    return [p for p in packs if p.stateful and any(r.state_condition for r in p.active_rules)]


def _fired(lines: DataFrame, book: RuleBook, packs: Sequence[Pack], column: str, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Lines with only those rule numbers in `column` whose `key=value` conditions hold.

    Lines on which rules of a pack with conditions match are read in a task's order; all others stay as they
    are.  A stream's lines come in no order, so all of a task with such a pack are put in order there.
    """
    packs = _conditional(packs)
    if not packs:
        return lines
    numbers = [number for pack in packs for number, _ in book.by_pack[pack.name]]
    rules = [p.active_rules for p in packs]
    bound = F.coalesce(F.col("parser_name").isin([p.name for p in packs]), F.lit(False))
    if lines.isStreaming:
        return lines.filter(~bound).unionByName(conditional_rules_live(lines.filter(bound), column, numbers, rules, idle_ms))
    bound = bound & (F.size(column) > 0)
    return lines.filter(~bound).unionByName(conditional_rules(lines.filter(bound), column, numbers, rules))


def apply_stateful_rules(lines: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Every matching rule of a stateful parser whose condition holds, one event each, numbered by `idx`."""
    stateful = [p for p in packs if p.stateful]
    keep = [c for c in lines.columns if c != "text"]
    book = RuleBook(stateful)
    matched = lines.withColumn("_many", book.stateful_rules(F.col("text"), F.col("parser_name")))
    return (
        _fired(matched, book, stateful, "_many")
        .select(*keep, "text", F.posexplode("_many").alias("idx", "_no"))
        .withColumn("_event", book.event(F.col("text"), F.col("_no")))
        .select(*keep, F.col("idx").cast("long").alias("idx"), *_event_columns("_event"),
                F.lit("stateful").alias("tier"))
    )


def completion_summary(events: DataFrame, tasks: DataFrame) -> DataFrame:
    """npm only: one summary per task that added packages or reported an error."""
    npm = tasks.filter(F.col("parser_name") == "npm").select("task_id", "exit_code")
    added = (F.col("type") == "summary") & F.col("message").startswith("added ")
    failed = (F.col("type") == "diagnostic") & (F.col("severity") == "error")
    flags = events.filter(F.col("tier") == "stateful").groupBy("task_id").agg(
        F.bool_or(added).alias("has_adds"), F.bool_or(failed).alias("has_error")
    )
    exit_text = F.coalesce(F.col("exit_code"), F.lit(-1)).cast("string")
    return flags.filter("has_adds or has_error").join(npm, "task_id").select(
        "task_id",
        F.lit("summary").alias("type"),
        F.when(F.col("has_error") | (F.coalesce("exit_code", F.lit(-1)) != 0), "error")
        .otherwise("info").alias("severity"),
        F.concat(
            F.when(F.col("has_adds"), "npm install completed (exit ").otherwise(
                "npm install failed (exit "),
            exit_text, F.lit(")"),
        ).alias("message"),
    )


def escalate_stderr(events: DataFrame) -> DataFrame:
    """stderr events whose message signals a failure become errors, summaries excepted."""
    raise_it = (
        (F.col("source") == "stderr")
        & (F.col("type") != "summary")
        & F.col("severity").isin("info", "warning")
        & looks_like_stderr_error(F.col("message"))
    )
    return events.withColumn(
        "severity", F.when(raise_it, "error").otherwise(F.col("severity"))
    )


def parse_tagged_lines(lines: DataFrame, packs: Sequence[Pack], idle_ms: int | None = IDLE_MS) -> DataFrame:
    """The tier cascade on lines that carry `parser_name`: first tier with a result wins.

    Stateless, hence valid on streams, but for packs whose rules have conditions: there a task's lines,
    numbered from 1, wait for those before them, for `idle_ms` at most.  Each tier's tests run
    only where the tiers before it found nothing.  `idx` numbers the events of one line.
    """
    text, parser, book = F.col("text"), F.col("parser_name"), RuleBook(packs)
    keep = [c for c in lines.columns if c not in ("text", "parser_name")]
    open_line = F.col("_json").isNull()
    single = F.coalesce(
        book.line_rule(text, parser), book.crash_rule(text), book.guess_rule(text)
    )
    numbers = F.when(F.size("_many") > 0, F.col("_many")).otherwise(F.array("_one"))
    event = F.coalesce("_json", book.event(text, F.col("_no")), X.raw_event(text))
    tier = F.when(open_line, F.coalesce(book.tier(F.col("_no")), F.lit("raw"))).otherwise("json")
    matched = lines.withColumn("text", strip_ansi(text)).withColumn("_json", X.json_line_event(text))
    many = F.when(open_line, book.stateful_rules(text, parser)).otherwise(F.array().cast("array<int>"))
    matched = computed(matched, "_many", many) if _conditional(packs) else matched.withColumn("_many", many)
    fired = (
        _fired(matched, book, packs, "_many", idle_ms)
        .withColumn("_one", F.when(open_line & (F.size("_many") == 0), single))
        .select(*keep, "text", "_json", F.posexplode(numbers).alias("idx", "_no"))
    )
    return (
        computed(fired, "_event", event)
        .select(*keep, F.col("idx").cast("long").alias("idx"), *_event_columns("_event"),
                tier.alias("tier"))
    )


def parse_lines(lines: DataFrame, tasks: DataFrame, packs: Sequence[Pack]) -> DataFrame:
    """Lines to events, with the parser looked up from the line's task."""
    parsers = tasks.select("task_id", "parser_name")
    return parse_tagged_lines(lines.join(parsers, "task_id", "left"), packs)


# ---- whole-output formats (one row per task, whole text) ----------------------------


def _parses(line: Column) -> Column:
    return trim(line).startswith("{") & X.strict_json(trim(line)).isNotNull()


def _with_output_lines(raw: DataFrame, text: str) -> DataFrame:
    body = trim(F.col(text))
    rows = F.transform(F.split(body, "\n"), lambda x: F.regexp_replace(x, r"\r\z", ""))
    return raw.withColumn("_body", body).withColumn("_rows", rows).withColumn(
        "_filled", F.filter("_rows", lambda x: trim(x) != "")
    )


def _yaml_pairs(rows: str) -> Column:
    """Trimmed `key: value` rows."""
    trimmed = F.transform(rows, lambda x: trim(x))
    return F.filter(
        trimmed,
        lambda x: x.contains(": ") & ~x.startswith("#"),
    )


def _delimiter(first: Column) -> Column:
    return F.when(first.contains("\t"), "\t").when(first.contains(","), ",").when(
        first.contains("|"), "|"
    )


def _columns(line: Column, delimiter: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, delimiter, F.lit(""))) + 1


def _tag_format(raw: DataFrame, text: str) -> DataFrame:
    rows = _with_output_lines(raw, text)
    n = F.size("_filled")
    opens = F.substring("_body", 1, 1).isin("{", "[")
    variant = F.when(opens, X.strict_json(F.col("_body")))
    n_json = F.size(F.filter("_filled", _parses))
    yaml_head = F.forall(
        F.slice("_rows", 1, 5),
        lambda x: (trim(x) == "") | trim(x).startswith("#") | trim(x).contains(": "),
    )
    yaml = (trim(F.get("_rows", F.lit(0))) == "---") | ((F.size("_rows") >= 2) & yaml_head)
    rows = rows.withColumn("_delim", _delimiter(F.get("_filled", F.lit(0))))
    width = _columns(F.get("_filled", F.lit(0)), F.col("_delim"))
    table = (n >= 2) & F.col("_delim").isNotNull() & F.forall(
        "_filled", lambda x: _columns(x, F.col("_delim")) == width
    )
    return rows.withColumn(
        "format",
        F.when(F.col("_body") == "", F.lit(None))
        .when(variant.isNotNull(), "json")
        .when((n >= 2) & (n_json >= F.floor(n * 4 / 5)), "ndjson")
        .when(yaml & (F.size(_yaml_pairs("_rows")) > 0), "yaml")
        .when(table, "csv"),
    )


def detect_format(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Add `format` (json, ndjson, yaml, csv or null) to rows of whole outputs."""
    return _tag_format(raw, text).select(*raw.columns, "format")


def format_events(raw: DataFrame, text: str = "raw") -> DataFrame:
    """Data events of structured outputs, numbered by `item` from 1."""
    info = F.lit("info")
    tagged = _tag_format(raw, text)
    whole = X.strict_json(F.col("_body"))
    elements = F.coalesce(
        F.try_variant_get(whole, "$", "array<variant>"), F.array(whole)
    )
    json_events = F.transform(elements, lambda v: X.json_value_event(v, F.to_json(v)))
    nd_rows = F.transform(F.filter("_filled", _parses), lambda x: F.try_parse_json(trim(x)))
    nd_events = F.transform(nd_rows, lambda v: X.json_value_event(v, F.to_json(v)))

    def yaml_event(row: Column) -> Column:
        key = F.substring_index(row, ": ", 1)
        value = F.substring(row, F.length(key) + 3, F.length(row))
        return X.event_struct(F.lit("data"), info, value, key)

    csv_events = F.transform(
        "_filled",
        lambda x: X.event_struct(F.lit("data"), info, F.replace(x, F.col("_delim"), F.lit(", "))),
    )
    events = (
        F.when(F.col("format") == "json", json_events)
        .when(F.col("format") == "ndjson", nd_events)
        .when(F.col("format") == "yaml", F.transform(_yaml_pairs("_rows"), yaml_event))
        .when(F.col("format") == "csv", csv_events)
    )
    keep = [c for c in raw.columns if c != text]
    return tagged.select(*keep, "format", F.posexplode(events).alias("_pos", "_event")).select(
        *keep, "format", (F.col("_pos") + 1).cast("long").alias("item"), *_event_columns("_event")
    )


def gate_format_events(
    data_events: DataFrame, line_events: DataFrame, capped_lines: DataFrame
) -> DataFrame:
    """Without tasks that had a JSON line already or whose output was cut."""
    parsed = line_events.filter(F.col("tier") == "json").select("task_id")
    cut = capped_lines.filter("truncated").select("task_id")
    return data_events.join(parsed.unionByName(cut).distinct(), "task_id", "left_anti")
