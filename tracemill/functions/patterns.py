"""Regular-expression helpers.

Rule patterns follow the linear-time dialect of the rule files: `$` matches only at the
end of the text and classes are Unicode.  Java gets the same meaning from the `d`
(unix lines) and `U` (Unicode classes) flags.
"""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ambiguity import has_ambiguous_loop

JAVA_FLAGS = "(?dU)"

#: a quantified group that itself ends in a quantifier, for patterns that only Java reads
_NESTED_QUANTIFIER = re.compile(r"\((?:[^()\\]|\\.)*[+*]\)[+*{]")

#: a named group in either spelling; rules take groups by number, and Java allows no `_` in names
_NAMED_GROUP = re.compile(r"(?<!\\)((?:\\\\)*)\(\?P?<[A-Za-z_]\w*>")
#: what the rules' dialect spells in another way than Java
_CODE_POINT = re.compile(r"(?<!\\)((?:\\\\)*)\\[uU]\{([0-9A-Fa-f]+)\}")
_ASCII_CLASS = re.compile(r"\[:(\^?)(\w+):\]")
# ---- fixed values -------------------------------------------------------------------
ASCII_CLASSES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9",
    "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z",
    "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
# -------------------------------------------------------------------------------------
#: what Java and the rules' dialect know and Python does not, with something alike for the look at loops
_ALIKE = [
    (re.compile(r"\\p(?:\{[^}]*\}|[A-Z])"), r"\\w"), (re.compile(r"\\P(?:\{[^}]*\}|[A-Z])"), r"\\W"), (re.compile(r"\\z"), r"\\Z"),
    (re.compile(r"\\x\{([0-9A-Fa-f]+)\}"), lambda m: f"\\U{int(m[1], 16):08x}"), (re.compile(r"\\h"), r"\\s"), (re.compile(r"\\R"), r"\\n"),
]


def unnamed(pattern: str) -> str:
    """The pattern with its named groups as plain ones."""
    return _NAMED_GROUP.sub(r"\1(", pattern)


def _spelled(pattern: str) -> str:
    """The pattern in Java's spelling."""
    def ascii_class(found):
        inside = ASCII_CLASSES.get(found[2])
        return found[0] if inside is None else f"[^{inside}]" if found[1] else inside

    return _ASCII_CLASS.sub(ascii_class, _CODE_POINT.sub(r"\1\\x{\2}", unnamed(pattern)))


def java(pattern: str) -> str:
    return JAVA_FLAGS + _spelled(pattern)


def _alike(pattern: str) -> str:
    pattern = _spelled(pattern)
    for form, alike in _ALIKE:
        pattern = form.sub(alike, pattern)
    return pattern


def is_safe(pattern: str) -> bool:
    """False for a pattern that does not compile, or has a loop that takes exponential time.

    Java judges what compiles, as it runs the rules; without a Spark session to ask, Python does.
    """
    context = SparkContext._active_spark_context
    try:
        if context is not None:
            context._jvm.java.util.regex.Pattern.compile(java(pattern))
        else:
            re.compile(_alike(pattern))
    except (Py4JJavaError, PySparkException, re.error, OverflowError, ValueError):
        return False
    try:
        return not has_ambiguous_loop(_alike(pattern))
    except (re.error, OverflowError, ValueError):  # read by Java alone
        return not _NESTED_QUANTIFIER.search(pattern)


def let(value: Column, body) -> Column:
    """`body(value)` with the value computed once per row.

    A column used several times is repeated in the generated code; bound in a lambda it is
    not, which keeps long text predicates small and evaluates their input once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def computed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Rows with the column `name`, computed once per row whatever reads or filters it.

    A filter on a plain column goes below the projection that makes it and so computes it a second time; none goes
    below a generator that makes what it asks for.
    """
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def group(text: Column, pattern: str, index: int) -> Column:
    """Captured group, or null where the group took no part (or was empty)."""
    return F.nullif(F.regexp_extract(text, java(pattern), index), F.lit(""))


def contains_any(text: Column, words) -> Column:
    """Any of the literal words occurs in the text (cheap byte search, no regex)."""

    def test(bound: Column) -> Column:
        cond = F.lit(False)
        for word in words:
            cond = cond | bound.contains(word)
        return cond

    return let(text, test)
