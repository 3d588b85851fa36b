"""Extraction tiers as columns.

Rules are data.  Matching is one `case when` of regex tests that yields a rule number; what
the rule captures is looked up by that number in a literal table and extracted by a single
expression, so the plan grows by one small test per rule.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EVENT_STRUCT
from ..sources.rulepacks import Pack
from .patterns import contains_any, java, let, matches
from .text import ascii_lower, is_success_summary, normalize_severity, trim

# ---- fixed values: crash signatures (language, regex, field -> group) ----------------
PYTHON_EXCEPTION_STEMS = (
    "Type|Value|Key|Index|Attribute|Runtime|OS|IO|Import|Name|Syntax|ZeroDivision|Memory|"
    "Recursion|StopIteration|Assertion|Permission|Timeout|Process|Unicode|UnicodeEncode|"
    "UnicodeDecode|UnicodeTranslate|SystemExit|KeyboardInterrupt|GeneratorExit|BlockingIO|"
    "BrokenPipe|ChildProcess|ConnectionAborted|ConnectionRefused|ConnectionReset|FileExists|"
    "FileNotFound|IsADirectory|NotADirectory|Interrupted|Overflow|Arithmetic|FloatingPoint|"
    "Buffer|Lookup|Environment|EOF|UnboundLocal|Indentation|Tab|Deprecation|"
    "PendingDeprecation|ResourceWarning"
)
CRASH_RULES = [
    ("go", r"^(.+\.go):(\d+)(?::\d+)?\s+(.+)$", {"file": 1, "line": 2, "message": 3}),
    ("python", r'^\s*File "(.+?)", line (\d+)', {"file": 1, "line": 2}),
    ("python", rf"^(?:(?:{PYTHON_EXCEPTION_STEMS})(?:Error|Exception|Warning)):\s+(.+)$", {"message": 1}),
    ("rust", r"^thread '.+' panicked at (.+), (.+):(\d+):", {"message": 1, "file": 2, "line": 3}),
    ("node", r"^(\w*Error): (.+)$", {"message": 2}),
    ("node", r"^\s+at .+ \((.+):(\d+):\d+\)", {"file": 1, "line": 2}),
    ("shell", r"^(Segmentation fault|Bus error|Abort trap|Killed)$", {}),
]
# literal text one of which every crash line holds
CRASH_HINTS = [".go:", 'File "', "Error", "Exception", "Warning", "panicked at", "at ",
               "Segmentation fault", "Bus error", "Abort trap", "Killed"]
# ---- fixed values: heuristic signatures (severity, regex, field -> group) ------------
HEURISTIC_RULES = [
    ("error", r"^([^:\s]+):(\d+):(\d+):\s*(?i:(?:fatal\s+)?error)", {"file": 1, "line": 2, "col": 3}),
    ("error", r"^([^:\s]+):(\d+):\s*(?i:(?:fatal\s+)?error)", {"file": 1, "line": 2}),
    ("error", r"(?i)\b(?:fatal\s+error|FAILED|panic|traceback|segmentation fault|bus error|killed|aborted)", {}),
    ("error", r"(?i)(?:^|[:\|]\s*)error(?:\[[\w]+\])?\s*:", {}),
    ("error", r"(?i)(?:^|\s)fatal\s*:", {}),
    ("warning", r"^([^:\s]+):(\d+):(\d+):\s*(?i:warning)", {"file": 1, "line": 2, "col": 3}),
    ("warning", r"^([^:\s]+):(\d+):\s*(?i:warning)", {"file": 1, "line": 2}),
    ("warning", r"(?i)\b(?:warn(?:ing)?|deprecated|notice|attention)\b", {}),
]
# literal text one of which every heuristic line holds, lower case
HEURISTIC_HINTS = ["error", "fatal", "failed", "panic", "traceback", "segmentation fault",
                   "bus error", "killed", "aborted", "warn", "deprecated", "notice", "attention"]
JSON_CODE_KEYS = ["code", "errorCode", "error_code"]
JSON_MESSAGE_KEYS = ["message", "msg", "text"]
JSON_FILE_KEYS = ["file", "filename", "path"]
JSON_LINE_KEYS = ["line", "lineNumber", "lineno"]
# -------------------------------------------------------------------------------------


def event_struct(type, severity, message, code=None, file=None, line=None, col=None) -> Column:
    """Event struct; a known file without a line number gets line 0."""
    none = F.lit(None)
    file = none.cast("string") if file is None else file
    line = none.cast("long") if line is None else line.cast("long")
    return F.struct(
        type.alias("type"),
        severity.alias("severity"),
        (none if code is None else code).cast("string").alias("code"),
        message.alias("message"),
        file.alias("file"),
        F.when(file.isNotNull(), F.coalesce(line, F.lit(0).cast("long"))).alias("line"),
        F.when(file.isNotNull(), (none if col is None else col).cast("long")).alias("col"),
    ).cast(EVENT_STRUCT)


def raw_event(text: Column, severity: Column | None = None) -> Column:
    return event_struct(F.lit("log"), F.lit("info") if severity is None else severity, text)


SPEC = (
    "struct<tier:string,regex:string,type:string,severity:string,code:string,code_at:int,"
    "message_at:int,file_at:int,line_at:int,col_at:int,severity_at:int,blank:boolean>"
)


def _group_source(regex: str, index: int) -> str:
    """The text of capture group `index` of a pattern."""
    count, i, in_class = 0, 0, False
    starts: list[tuple[int, int]] = []
    while i < len(regex):
        ch = regex[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            captures = not regex.startswith("(?", i)
            count += captures
            starts.append((count if captures else 0, i + 1))
        elif ch == ")":
            number, start = starts.pop()
            if number == index:
                return regex[start:i]
        i += 1
    return ""


def _may_be_blank(regex: str, index: int | None) -> bool:
    """The group can match empty text; such a match then counts as an empty value."""
    return bool(index) and re.fullmatch(_group_source(regex, index), "") is not None


@dataclass
class RuleBook:
    """All rules of all tiers under one numbering (from 1)."""

    packs: Sequence[Pack] = ()
    specs: list[tuple] = field(default_factory=list)
    by_pack: dict[str, list[tuple[int, str]]] = field(default_factory=dict)
    crash: list[tuple[int, str]] = field(default_factory=list)
    guess: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self):
        for pack in self.packs:
            tier = "stateful" if pack.stateful else "rule"
            self.by_pack[pack.name] = [
                self._add(tier, r.regex, r.event_type, r.severity, None, r.fields, not pack.stateful)
                for r in pack.active_rules
            ]
        for language, regex, fields in CRASH_RULES:
            self.crash.append(self._add("crash", regex, "crash", "error", language, fields))
        for severity, regex, fields in HEURISTIC_RULES:
            self.guess.append(self._add("heuristic", regex, "diagnostic", severity, None, fields))

    def _add(self, tier, regex, event_type, severity, code, fields, full=True):
        """`full` is false for stateful rules: they take neither code nor column."""
        column = fields.get("column", fields.get("col"))
        self.specs.append((
            tier, java(regex), event_type, severity, code, fields.get("code") if full else None,
            fields.get("message"), fields.get("file"), fields.get("line"),
            column if full else None, fields.get("severity"),
            _may_be_blank(regex, fields.get("message")),
        ))
        return len(self.specs), regex

    def table(self) -> Column:
        """The specs as one literal; it is folded when the query is planned."""
        names = [f.split(":")[0] for f in SPEC[7:-1].split(",")]
        rows = [{n: v for n, v in zip(names, spec) if v is not None} for spec in self.specs]
        return F.from_json(F.lit(json.dumps(rows)), f"array<{SPEC}>")

    @staticmethod
    def first(text: Column, rules) -> Column:
        """Number of the first rule that matches, null if none."""
        cond = F.lit(None).cast("int")
        for number, regex in reversed(rules):
            cond = F.when(matches(text, regex), F.lit(number)).otherwise(cond)
        return cond

    @staticmethod
    def every(text: Column, rules) -> Column:
        """Numbers of all rules that match, in order."""
        return F.array_compact(F.array(*[F.when(matches(text, r), F.lit(n)) for n, r in rules]))

    def _choose(self, text: Column, parser: Column, stateful: bool, build, otherwise) -> Column:
        """One branch per pack, chosen by the task's parser: only that pack's tests run.

        The branches sit in a lambda: hundreds of regex tests would not fit into one
        generated method, and in a lambda each keeps its compiled pattern all the same.
        """
        packs = [p for p in self.packs if p.stateful == stateful and p.rules]

        def branches(line: Column) -> Column:
            cond = F
            for pack in packs:
                cond = cond.when(line["p"] == pack.name, build(line["t"], self.by_pack[pack.name]))
            return cond.otherwise(otherwise)

        if not packs:
            return otherwise
        return let(F.struct(text.alias("t"), parser.alias("p")), branches)

    def line_rule(self, text: Column, parser: Column) -> Column:
        return self._choose(text, parser, False, self.first, F.lit(None).cast("int"))

    def stateful_rules(self, text: Column, parser: Column) -> Column:
        return self._choose(text, parser, True, self.every, F.array().cast("array<int>"))

    def crash_rule(self, text: Column) -> Column:
        found = let(text, lambda line: self.first(line, self.crash))
        return F.when(contains_any(text, CRASH_HINTS), found)

    def guess_rule(self, text: Column) -> Column:
        """Keyword fallback; lines that report success do not count."""
        hinted = let(ascii_lower(text), lambda low: contains_any(low, HEURISTIC_HINTS))
        found = let(text, lambda line: self.first(line, self.guess))
        return F.when(hinted & ~is_success_summary(text), found)

    def event(self, text: Column, number: Column) -> Column:
        """The event of rule `number` on this line."""

        def build(spec: Column) -> Column:
            def captured(name: str) -> Column:
                found = F.call_function("regexp_extract", text, spec["regex"], spec[name])
                return F.when(spec[name].isNotNull(), F.nullif(found, F.lit("")))

            return event_struct(
                spec["type"],
                F.when(spec["severity_at"].isNull(), spec["severity"])
                .otherwise(normalize_severity(captured("severity_at"), spec["severity"])),
                F.coalesce(trim(captured("message_at")), F.when(spec["blank"], ""), text),
                F.coalesce(captured("code_at"), spec["code"]),
                captured("file_at"),
                captured("line_at").try_cast("long"),
                captured("col_at").try_cast("long"),
            )

        return F.when(number.isNotNull(), let(F.element_at(self.table(), number), build))

    def tier(self, number: Column) -> Column:
        return F.when(number.isNotNull(), F.element_at(self.table(), number)["tier"])


def _first_key(variant: Column, keys: list[str], type_name: str) -> Column:
    """Typed value of the first key present; a value of another type counts as absent."""
    cond = F.lit(None).cast(type_name)
    for key in reversed(keys):
        present = F.try_variant_get(variant, f"$.{key}", "variant")
        cond = F.when(present.isNotNull(), _typed(present, type_name)).otherwise(cond)
    return cond


def _kind(variant: Column) -> Column:
    return F.schema_of_variant(variant)


def _typed(variant: Column, type_name: str) -> Column:
    value = F.try_variant_get(variant, "$", type_name)
    if type_name == "string":
        return F.when(_kind(variant) == "STRING", value)
    return F.when(_kind(variant) == "BIGINT", value)


def json_value_event(variant: Column, text: Column) -> Column:
    """Event of one JSON value; `text` is its compact form."""
    level = _first_key(variant, ["level"], "string")
    severity = F.coalesce(_first_key(variant, ["severity"], "string"), level)
    message = _first_key(variant, JSON_MESSAGE_KEYS, "string")
    line = _first_key(variant, JSON_LINE_KEYS, "long")
    kind = _kind(variant)
    obj = event_struct(
        F.coalesce(
            _first_key(variant, ["type"], "string"),
            F.when(level.isin("error", "fatal", "warn", "warning"), "diagnostic")
            .when(level.isNotNull(), "log"),
            F.lit("data"),
        ),
        F.when(severity.isin("error", "fatal", "critical"), "error")
        .when(severity.isin("warn", "warning"), "warning").otherwise("info"),
        F.coalesce(F.nullif(message, F.lit("")), text),
        F.coalesce(
            _first_key(variant, JSON_CODE_KEYS, "string"),
            _first_key(variant, JSON_CODE_KEYS, "long").cast("string"),
            _first_key(variant, ["code"], "long").cast("string"),
        ),
        _first_key(variant, JSON_FILE_KEYS, "string"),
        F.when(line >= 0, line),
    )
    items = F.size(F.try_variant_get(variant, "$", "array<variant>"))
    other = event_struct(
        F.lit("data"), F.lit("info"),
        F.when(kind.startswith("ARRAY"), F.format_string("JSON array (%d items)", items))
        .otherwise(text),
    )
    return F.when(kind.startswith("OBJECT"), obj).otherwise(other)


def strict_json(text: Column) -> Column:
    """Variant of a text that is one whole JSON value, else null.

    The parser stops after the first value and ignores what follows; only a single value
    with nothing behind it still parses both as an array element and as an object field.
    """
    inside = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(inside) == 1) & field.isNotNull(), F.element_at(inside, 1))


def json_line_event(text: Column) -> Column:
    """A line that starts with `{` and parses is a structured record."""

    def event(body: Column) -> Column:
        return let(
            strict_json(body),
            lambda v: F.when(v.isNotNull(), json_value_event(v, F.to_json(v))),
        )

    return F.when(matches(text, r"^\s*\{"), let(trim(text), event))
