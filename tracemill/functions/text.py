"""Scalar line and message functions: pure columns, usable in batch and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import contains_any, let, matches

# ---- fixed values -------------------------------------------------------------------
ANSI_SGR = r"\x1b\[[0-9;]*m"
INVALID_UTF8_MARK = " [invalid UTF-8 replaced]"
MAX_LINE_BYTES = 65_536
INLINE_LIMIT_BYTES = 16_384
CLIP_MARK = "\n[…]\n"
ZERO_FAILURE_WORDS = ["0 failed", "0 failures", "failed: 0", "failures: 0"]
STRONG_ERROR_WORDS = ["error:", "error[", "traceback", "segmentation fault"]
STDERR_SIGNALS = [
    "error:", "error ", "failed:", "fatal:", "panic:", "panic!",
    "traceback (most recent call last)", "segmentation fault", "abort trap",
    "command not found", "no such file", "cannot find", "permission denied",
    "access denied", "not found", "syntax error", "unexpected token",
]
STDERR_PREFIXES = ["e ", "e\t"]
CONTEXT_PREFIXES = ["|", "expected type ", "found type ", "the trait ", "^^^", "---"]
DIRECTIVE = r"^= [A-Za-z]*:"
NUMBERED_SOURCE = r"^[0-9][0-9 ]* \| "
# -------------------------------------------------------------------------------------


def trim(col: Column) -> Column:
    """Strip whitespace of any kind from both ends (Spark's `trim` strips blanks only)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def ascii_lower(col: Column) -> Column:
    return F.lower(col)


def repair_utf8(raw: Column) -> Column:
    """Decode bytes; text that was not valid UTF-8 gets replacement marks and a note."""
    binary = raw.cast("binary")
    return F.when(F.is_valid_utf8(binary.cast("string")), binary.cast("string")).otherwise(
        F.concat(F.make_valid_utf8(binary.cast("string")), F.lit(INVALID_UTF8_MARK))
    )


def cap_line(raw: Column, limit: int = MAX_LINE_BYTES) -> Column:
    """Decode a line and keep at most `limit` bytes of it, with a note when it was cut."""
    binary = raw.cast("binary")
    head = F.substring(binary, 1, limit)
    return F.when(F.octet_length(binary) <= limit, repair_utf8(binary)).otherwise(
        F.concat(repair_utf8(head), F.lit(f" [line truncated at {limit} bytes]"))
    )


def strip_ansi(col: Column) -> Column:
    """Remove colour codes; the regex only runs on lines that hold an escape byte."""
    return F.when(col.contains("\x1b"), F.regexp_replace(col, ANSI_SGR, "")).otherwise(col)


def is_noise(message: Column) -> Column:
    """Blank, colour-only, or a lone colon."""
    visible = trim(strip_ansi(message))
    return visible.isin("", ":")


def _utf8_prefix(text: Column, n_bytes: Column) -> Column:
    """Longest prefix of whole characters within n_bytes bytes."""
    cut = F.substring(text.cast("binary"), F.lit(1), n_bytes)
    # a cut inside a character leaves at most three stray bytes at the end
    cond = F.lit(None).cast("string")
    for drop in (3, 2, 1, 0):
        shorter = F.substring(cut, F.lit(1), F.octet_length(cut) - drop).cast("string")
        cond = F.when(F.is_valid_utf8(shorter), shorter).otherwise(cond)
    return F.coalesce(cond, F.lit(""))


def utf8_prefix(text: Column, n_bytes: Column | int) -> Column:
    n_bytes = F.lit(n_bytes) if isinstance(n_bytes, int) else n_bytes
    return _utf8_prefix(text, n_bytes.cast("int"))


def utf8_suffix(text: Column, n_bytes: int) -> Column:
    """Longest suffix of whole characters within n_bytes bytes."""
    binary = text.cast("binary")
    size = F.octet_length(binary)
    cond = F.lit(None).cast("string")
    for drop in (3, 2, 1, 0):
        shorter = F.substring(binary, size - (n_bytes - drop) + 1, size).cast("string")
        cond = F.when(F.is_valid_utf8(shorter), shorter).otherwise(cond)
    return F.coalesce(cond, F.lit(""))


def clip_text(col: Column, limit: int = INLINE_LIMIT_BYTES) -> Column:
    """Struct (text, clipped, omitted_bytes): head and tail of a text over the limit."""
    edge = limit // 2
    size = F.octet_length(col)
    head, tail = utf8_prefix(col, edge), utf8_suffix(col, edge)
    over = size > limit
    return F.struct(
        F.when(over, F.concat(head, F.lit(CLIP_MARK), tail)).otherwise(col).alias("text"),
        over.alias("clipped"),
        F.when(over, size - F.octet_length(head) - F.octet_length(tail))
        .otherwise(F.lit(0)).cast("long").alias("omitted_bytes"),
    )


def is_success_summary(line: Column) -> Column:
    """A line that reports success although it holds words such as `failed`."""

    def test(low: Column) -> Column:
        strong = contains_any(low, STRONG_ERROR_WORDS) | (
            low.contains("panic") & ~low.contains("0 panic")
        )
        return (
            low.startswith("test result: ok")
            | (low.startswith("test ") & low.endswith(" ... ok"))
            | (contains_any(low, ZERO_FAILURE_WORDS) & ~strong)
        )

    return let(ascii_lower(trim(line)), test)


def normalize_severity(raw: Column, default: Column | str) -> Column:
    default = F.lit(default) if isinstance(default, str) else default
    known = let(
        ascii_lower(trim(raw)),
        lambda low: F.when(low.startswith("fatal") | low.startswith("error"), "error")
        .when(low.startswith("warn"), "warning")
        .when(low.startswith("info") | low.startswith("note") | low.startswith("debug"), "info"),
    )
    return F.coalesce(known, default)


def looks_like_stderr_error(message: Column) -> Column:
    def test(low: Column) -> Column:
        cond = contains_any(low, STDERR_SIGNALS)
        for prefix in STDERR_PREFIXES:
            cond = cond | low.startswith(prefix)
        return cond

    return let(ascii_lower(message), test)


def is_context_line(message: Column) -> Column:
    """Compiler continuation lines that belong to the diagnostic before them."""

    def test(body: Column) -> Column:
        cond = matches(body, DIRECTIVE) | matches(body, NUMBERED_SOURCE)
        for prefix in CONTEXT_PREFIXES:
            cond = cond | body.startswith(prefix)
        return cond

    return let(trim(message), test)


def keeps_context_text(message: Column) -> Column:
    """Of the context lines, those that carry text worth keeping."""
    return let(
        trim(message),
        lambda body: ~(
            matches(body, r"^\|\s*[\^\-|]*$")
            | body.isin("", "}", "//", "///")
            | body.startswith("-->")
            | body.contains("\x1b")
        ),
    )


def is_secondary_summary(message: Column) -> Column:
    return let(
        ascii_lower(message),
        lambda low: low.contains("could not compile")
        | (low.contains("due to") & low.contains("previous error"))
        | low.startswith("for more information about this error")
        | low.startswith("some errors have detailed explanations"),
    )


def duration_text(ms: Column) -> Column:
    """`123ms` below one second, else seconds with one decimal.

    One decimal is rounded on the exact binary value of ms/1000, as C's `%.1f` does; only
    values ending in 50 ms can tie, and there the sign of the division error decides.
    """
    seconds = ms / F.lit(1000.0)
    split = seconds * F.lit(134217729.0)  # 2^27 + 1 splits a double into two exact halves
    high = split - (split - seconds)
    error = (high * 1000.0 - ms) + (seconds - high) * 1000.0
    tenths = F.floor(ms / 100).cast("long")
    rest = ms % 100
    up = (rest > 50) | ((rest == 50) & ((error > 0) | ((error == 0) & (tenths % 2 == 1))))
    rounded = tenths + up.cast("long")
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(
        F.concat(
            F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"),
            F.lit("s"),
        )
    )

