"""DuckDB expressions for rule packs: the same rule data run by a linear-time regex engine."""

from __future__ import annotations

FIELDS = ["type", "severity", "code", "message", "file", "line", "col"]


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^\\s+|\\s+$', '', 'g')"


def group(text: str, regex: str, index: int) -> str:
    return f"nullif(regexp_extract({text}, {quote(regex)}, {index}), '')"


def number(text: str, regex: str, index: int) -> str:
    return f"TRY_CAST({group(text, regex, index)} AS BIGINT)"


def severity_sql(raw: str, default: str) -> str:
    low = f"lower({strip(raw)})"
    return (
        f"CASE WHEN {low} LIKE 'fatal%' OR {low} LIKE 'error%' THEN 'error' "
        f"WHEN {low} LIKE 'warn%' THEN 'warning' WHEN {low} LIKE 'info%' OR {low} LIKE 'note%' "
        f"OR {low} LIKE 'debug%' THEN 'info' ELSE {quote(default)} END"
    )


def event(type_, severity, message, code="NULL", file=None, line=None, col=None) -> str:
    has = file or "NULL"
    return (
        f"{{'type': {type_}, 'severity': {severity}, 'code': CAST({code} AS VARCHAR), "
        f"'message': {message}, 'file': CAST({has} AS VARCHAR), "
        f"'line': CASE WHEN {has} IS NOT NULL THEN coalesce({line or 'NULL'}, CAST(0 AS BIGINT)) END, "
        f"'col': CASE WHEN {has} IS NOT NULL THEN CAST({col or 'NULL'} AS BIGINT) END}}"
    )


def rule_event(text: str, rule, with_code=True) -> str:
    f, regex = rule.fields, rule.regex
    message = f"coalesce({strip(group(text, regex, f['message']))}, {text})" if "message" in f else text
    severity = quote(rule.severity)
    if "severity" in f:
        severity = severity_sql(group(text, regex, f["severity"]), rule.severity)
    return event(
        quote(rule.event_type), severity, message,
        group(text, regex, f["code"]) if "code" in f and with_code else "NULL",
        group(text, regex, f["file"]) if "file" in f else None,
        number(text, regex, f["line"]) if "line" in f else None,
        number(text, regex, f["column"]) if "column" in f and with_code else None,
    )


def hit(text: str, regex: str) -> str:
    return f"regexp_matches({text}, {quote(regex)})"


def first_rule(text: str, pack) -> str:
    whens = " ".join(f"WHEN {hit(text, r.regex)} THEN {rule_event(text, r)}" for r in pack.active_rules)
    return f"CASE {whens} END"


def by_parser(parser: str, packs, text: str) -> str:
    whens = " ".join(f"WHEN {quote(p.name)} THEN {first_rule(text, p)}" for p in packs)
    return f"CASE {parser} {whens} END"


def table_event(text: str, rules, make) -> str:
    return "CASE " + " ".join(f"WHEN {hit(text, r[1])} THEN {make(r)}" for r in rules) + " END"


def crash_sql(text: str, rules) -> str:
    def make(rule):
        language, regex, f = rule
        message = f"coalesce({strip(group(text, regex, f['message']))}, {text})" if "message" in f else text
        return event("'crash'", "'error'", message, quote(language),
                     group(text, regex, f["file"]) if "file" in f else None,
                     number(text, regex, f["line"]) if "line" in f else None)

    return table_event(text, rules, make)


SUCCESS = """(lower(trim({0})) LIKE 'test result: ok%'
  OR (lower(trim({0})) LIKE 'test %' AND lower(trim({0})) LIKE '% ... ok')
  OR ((contains(lower({0}), '0 failed') OR contains(lower({0}), '0 failures')
       OR contains(lower({0}), 'failed: 0') OR contains(lower({0}), 'failures: 0'))
      AND NOT (contains(lower({0}), 'error:') OR contains(lower({0}), 'error[')
       OR contains(lower({0}), 'traceback') OR contains(lower({0}), 'segmentation fault')
       OR (contains(lower({0}), 'panic') AND NOT contains(lower({0}), '0 panic')))))"""


def heuristic_sql(text: str, rules) -> str:
    def make(rule):
        severity, regex, f = rule
        return event("'diagnostic'", quote(severity), text, "NULL",
                     group(text, regex, f["file"]) if "file" in f else None,
                     number(text, regex, f["line"]) if "line" in f else None,
                     number(text, regex, f["col"]) if "col" in f else None)

    found = table_event(text, rules, make)
    return f"CASE WHEN {SUCCESS.format(text)} THEN NULL ELSE {found} END"


def spread(expr: str) -> str:
    return ", ".join(f"{expr}.{n} AS {n}" for n in FIELDS)
