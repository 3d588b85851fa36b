"""Words and flags of shell command texts.

Plain commands (words, quotes, signs between commands) are read by expressions.  Escapes, substitutions and
programs that run their arguments need a scanner, an Arrow-batched column that gets those commands alone.
What the words mean (tool, carrier, policy) is decided by Spark columns over the result.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import computed, let

# ---- fixed values -------------------------------------------------------------------
MAX_NESTING = 64
SHELLS = {"sh", "bash", "zsh", "dash", "ksh", "fish"}
KEYWORDS = {"do", "then", "else", "elif"}
WRAPPERS = {"command", "builtin", "exec", "nohup", "time", "env", "nice", "timeout", "stdbuf",
            "setsid", "sudo"}
VALUE_OPTIONS = {
    "nice": {"-n", "--adjustment"},
    "timeout": {"-k", "--kill-after", "-s", "--signal"},
    "stdbuf": {"-i", "-o", "-e"},
    "sudo": {"-u", "--user", "-g", "--group", "-h", "--host", "-p", "--prompt", "-C",
             "--close-from", "-T", "--command-timeout", "-R", "--chroot", "-D", "--chdir"},
    "xargs": {"-a", "--arg-file", "-d", "--delimiter", "-E", "--eof", "-I", "--replace", "-L",
              "--max-lines", "-n", "--max-args", "-P", "--max-procs", "-s", "--max-chars"},
}
ANSI_C = {"a": "\a", "b": "\b", "e": "\x1b", "E": "\x1b", "f": "\f", "n": "\n", "r": "\r",
          "t": "\t", "v": "\v", "\\": "\\", "'": "'", '"': '"', "?": "?", "\n": ""}
# -------------------------------------------------------------------------------------

SHAPE = (
    "struct<commands:array<struct<words:array<string>,exe:int,origin:string,parent:int>>,"
    "control:boolean,pipe:boolean,redirection:boolean,background:boolean,"
    "substitution:boolean,nested_shell:boolean,too_deep:boolean,plain:string,blanked:string>"
)
FLAGS = ["control", "pipe", "redirection", "background", "substitution", "nested_shell"]

TOKEN = re.compile(
    r"""(?P<escape>\\.?) | (?P<ansi>\$'(?:\\.|[^'\\])*(?:'|\Z)) | (?P<single>'[^']*(?:'|\Z))
      | (?P<double>"(?:\\.|[^"\\])*(?:"|\Z)) | (?P<substitution>\$(?=\()|`)
      | (?P<control>\n|;;?|\|\||&&) | (?P<pipe>\|) | (?P<background>&)
      | (?P<redirection>[<>][<>&]?) | (?P<blank>[^\S\n]+) | (?P<comment>\#[^\n]*)
      | (?P<plain>[^\\$'"`\n;|&<>\s\#]+|.)""",
    re.X | re.S,
)
ANSI_ESCAPE = re.compile(r"\\(x[0-9a-fA-F]{1,2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)", re.S)


SPECIAL = re.compile(r"""[\\$'"`\n;|&<>#]""")
EMBEDS = re.compile(r"[(`{]")
QUOTING = re.compile(r"""[\\'"]""")


def _ansi_char(match) -> str:
    body = match.group(1)
    if body in ANSI_C:
        return ANSI_C[body]
    base = 16 if body[0] in "xuU" and len(body) > 1 else 8
    digits = body[1:] if base == 16 else body
    try:
        return chr(int(digits, base))
    except (ValueError, OverflowError):
        return match.group(0)


def split_commands(text: str) -> tuple[list[list[str]], set[str]]:
    """Words per simple command, and the kinds of shell structure seen outside quotes."""
    if not SPECIAL.search(text):
        words = text.split()
        return ([words] if words else []), set()
    commands, words, word, seen, pos = [], [], "", set(), 0
    while pos < len(text):
        match = TOKEN.match(text, pos)
        kind, token, pos = match.lastgroup, match.group(), match.end()
        if kind == "comment" and word:
            kind, token, pos = "plain", "#", match.start() + 1
        if kind in ("control", "pipe", "background", "redirection", "blank"):
            if word:
                words.append(word)
                word = ""
            if kind != "blank":
                seen.add(kind)
            if kind in ("control", "pipe", "background") and words:
                commands.append(words)
                words = []
        elif kind == "escape":
            word += "\\" if token == "\\" else token[1:].replace("\n", "")
        elif kind == "single":
            word += token.strip("'") if "'" not in token[1:-1] else token[1:]
        elif kind == "double":
            body = token[1:-1] if len(token) > 1 and token.endswith('"') else token[1:]
            if re.search(r"(?<!\\)(?:\$\(|`)", body):
                seen.add("substitution")
            word += re.sub(r"\\(.)", lambda m: m.group(1).replace("\n", ""), body, flags=re.S)
        elif kind == "ansi":
            body = token[2:-1] if len(token) > 2 and token.endswith("'") else token[2:]
            word += ANSI_ESCAPE.sub(_ansi_char, body)
        elif kind != "comment":
            if kind == "substitution":
                seen.add(kind)
            word += token
    if word:
        words.append(word)
    if words:
        commands.append(words)
    return commands, seen


def _base(word: str) -> str:
    return word.rsplit("/", 1)[-1]


def _is_assignment(word: str) -> bool:
    return re.match(r"[A-Za-z_][A-Za-z0-9_]*=", word) is not None


def _skip_options(words, i, tool) -> int:
    while i < len(words) and (words[i].startswith("-") or (tool == "env" and _is_assignment(words[i]))):
        if words[i] == "--":
            return i + 1
        i += 2 if words[i] in VALUE_OPTIONS.get(tool, ()) else 1
    return i + 1 if tool == "timeout" else i


def _after_assignment(words, i):
    """Assignments count in front of everything else only."""
    return i + 1 if all(map(_is_assignment, words[: i + 1])) else None


def _after_case(words, i):
    """`case WORD in PATTERN)`, or all that there is of it."""
    if _base(words[i]) != "case":
        return None
    rest = words[i:]
    start = rest.index("in") if "in" in rest else len(rest)
    return i + 1 + next((k for k in range(start, len(rest)) if rest[k].endswith(")")), len(rest))


def _after_keyword(words, i):
    base = _base(words[i])
    return i + 1 if base in KEYWORDS or words[i].endswith(")") and base not in WRAPPERS else None


def _after_wrapper(words, i):
    base = _base(words[i])
    return _skip_options(words, i + 1, base) if base in WRAPPERS else None


#: What may stand in front of a program; each gives the place behind it, or None where it does not stand.
PREFIXES = (_after_assignment, _after_case, _after_keyword, _after_wrapper)


def program_place(words: list[str]) -> int:
    """Position of the program that runs; -1 if none."""
    place = 0
    while place < len(words):
        behind = next((end for prefix in PREFIXES if (end := prefix(words, place)) is not None), None)
        if behind is None:
            return place
        place = behind
    return -1


def _nested_shell(words, exe):
    if exe >= 0 and _base(words[exe]) in SHELLS:
        for i in range(exe + 1, len(words)):
            if not words[i].startswith("-"):
                return None
            if "c" in words[i][1:]:
                return words[i + 1] if i + 1 < len(words) else None
    return None


def _embedded(text: str) -> list[str]:
    """Bodies of $( ), <( ), >( ), ( ), { } and backticks outside single quotes."""
    if not EMBEDS.search(text):
        return []
    found, stack, quote, tick, i = [], [], "", -1, 0
    while i < len(text):
        ch = text[i]
        if ch == "\\" and quote != "'":
            i += 2
            continue
        if quote == "'":
            quote = "" if ch == "'" else quote
        elif ch == '"' or (ch == "'" and not quote):
            quote = "" if quote == ch else ch
        elif ch == "`":
            if tick >= 0:
                found.append(text[tick:i])
            tick = i + 1 if tick < 0 else -1
        elif ch == "(" and (not quote or text[i - 1 : i] == "$"):
            stack.append((")", i + 1, quote))
            quote = ""
        elif ch == "{" and not quote and text[i + 1 : i + 2].isspace():
            stack.append(("}", i + 1, quote))
        elif stack and ch == stack[-1][0] and not quote:
            _, start, quote = stack.pop()
            if not stack:
                found.append(text[start:i])
        i += 1
    return found


def _payloads(words, exe):
    """Commands that a program is asked to run through its arguments."""
    out = []
    for i, word in enumerate(words[: exe + 1 if exe >= 0 else len(words)]):
        if _base(word) == "env":
            rest = words[i + 1 :]
            for j, option in enumerate(rest):
                body = re.match(r"(?:--split-string=|-S)(.+)", option, re.S)
                if option in ("-S", "--split-string") and j + 1 < len(rest):
                    out.append((split_commands(rest[j + 1])[0] or [[]])[0] + rest[j + 2 :])
                elif body:
                    out.append((split_commands(body.group(1))[0] or [[]])[0] + rest[j + 1 :])
                elif not option.startswith("-") and not _is_assignment(option):
                    break
    if exe < 0:
        return out
    tool, args = _base(words[exe]), words[exe + 1 :]
    if tool == "xargs":
        out.append(args[_skip_options(args, 0, "xargs") :])
    elif tool in ("busybox", "toybox"):
        out.append(args)
    elif tool == "coproc":
        out += [args, args[1:]]
    elif tool == "find":
        for i, arg in enumerate(args):
            if arg in ("-exec", "-execdir"):
                end = next((j for j in range(i + 1, len(args)) if args[j] in (";", "+")), len(args))
                out.append(args[i + 1 : end])
    return [p for p in out if p]


def unquote(text: str, blank: bool = False) -> str:
    """The text without its quoting; with `blank`, quoted characters become spaces."""
    if not QUOTING.search(text):
        return text
    out, pos = [], 0
    while pos < len(text):
        match = TOKEN.match(text, pos)
        kind, token, pos = match.lastgroup, match.group(), match.end()
        if kind == "comment":
            token, pos = "#", match.start() + 1
        if kind in ("single", "double"):
            closed = len(token) > 1 and token[-1] == token[0]
            body = token[1:-1] if closed else token[1:]
            if blank:
                body = " " * len(body)
            elif kind == "double":
                body = re.sub(r"\\\n|\\([$`\"\\])", lambda m: m.group(1) or "", body)
            out.append(body)
        elif kind == "escape" and len(token) > 1:
            out.append(token[1:].replace("\n", ""))
        else:
            out.append(token)
    return "".join(out)


def shape_of(text: str) -> dict:
    """All simple commands reachable from a text, outermost first, with its own flags.

    `origin` tells how a command is reached: top, nested (`sh -c`), embedded (substitution or
    group), payload (argument of find, xargs and the like) or inner (a shell inside those).
    """
    text = text.strip()
    found, flags, too_deep = [], set(), False
    todo = [("text", text, "top", 0, -1)]
    while todo:
        what, item, origin, depth, parent = todo.pop()
        if depth >= MAX_NESTING:
            too_deep = True
            continue
        if what == "text":
            commands, seen = split_commands(item)
            if depth == 0:
                flags = seen
            inner = [("text", e, "embedded", depth + 1, parent) for e in _embedded(item)]
            todo += reversed([("words", c, origin, depth, parent) for c in commands] + inner)
            continue
        exe = program_place(item)
        found.append({"words": item, "exe": exe, "origin": origin, "parent": parent})
        here = len(found) - 1
        more = [("words", p, "payload", depth + 1, here) for p in _payloads(item, exe)]
        nested = _nested_shell(item, exe)
        if nested is not None:
            if depth == 0:
                flags.add("nested_shell")
            inside = "nested" if origin in ("top", "nested") else "inner"
            more.insert(0, ("text", nested, inside, depth + 1, here))
        todo += reversed(more)
    return {
        "commands": found, **{f: f in flags for f in FLAGS}, "too_deep": too_deep,
        "plain": unquote(text), "blanked": unquote(text, blank=True),
    }


def _shapes(texts: pd.Series) -> pd.DataFrame:
    memo = {text: shape_of(text) for text in texts.unique() if text is not None}  # commands repeat a lot
    nothing = dict.fromkeys(["commands", *FLAGS, "too_deep", "plain", "blanked"])
    return pd.DataFrame([memo.get(text, nothing) for text in texts], columns=list(nothing))


# ---- plain commands, as expressions -------------------------------------------------

#: Programs and words in front of them that have commands within their arguments, or another program behind them.
_OPENERS = sorted(SHELLS | KEYWORDS | WRAPPERS | {"case", "xargs", "busybox", "toybox", "coproc", "find"})
_QUOTED = r"""'([^']*)'|"([^"]*)\""""
_WORD_OR_SIGN = r"""(?:[^\s'"|&;<>]+|'[^']*'|"[^"]*")+|;;?|\n|\|\|?|&&?|[<>][<>&]?"""
#: A longer command may hold more quoted pieces than Java's matcher has stack for; the scanner reads it.
_PLAIN_TEXT = r"\A[\x20-\x7E\t\n]{0,4000}\z"
_SIGNS = (";", ";;", "\n", "||", "&&", "|", "&")
_ENDS, _PARTS = "\x01", "\x02"


def _plain_shape(text: Column) -> Column:
    """Shape of a command of words, whole quotes and signs between commands; null where there is more to it.

    No escapes, comments, substitutions and groups, and no program that runs its arguments.
    """
    bare = F.regexp_replace(text, _QUOTED, "")
    easy = text.rlike(_PLAIN_TEXT) & ~text.rlike(r"[\\\\`]|\$[('\"]") & ~bare.rlike(r"""['"()#]|\{\s""")

    # few words have what the patterns look for, so cheap tests come first
    quotes = lambda x: x.contains("'") | x.contains('"')
    redirects = lambda x: x.startswith("<") | x.startswith(">")
    assigns = lambda w: w.contains("=") & w.rlike(r"\A[A-Za-z_][A-Za-z0-9_]*=")

    def part(token):
        return (F.when(token.isin(*_SIGNS), _ENDS).when(redirects(token), "")
                .when(quotes(token), F.regexp_replace(token, _QUOTED, "$1$2")).otherwise(token))

    def command(words):
        place = F.array_position(F.transform(words, lambda w: ~assigns(w)), True).cast("int") - 1
        return F.struct(words.alias("words"), place.alias("exe"), F.lit("top").alias("origin"), F.lit(-1).alias("parent"))

    def opens(c):
        word = F.when(c["exe"] >= 0, F.element_at(c["words"], c["exe"] + 1))
        return F.coalesce(word.endswith(")") | F.element_at(F.split(word, "/"), -1).isin(_OPENERS), F.lit(False))

    def shape(s):
        tokens = s["tokens"]
        said = lambda *signs: F.exists(tokens, lambda t: t.isin(*signs))
        blanked = F.array_join(F.transform(F.regexp_extract_all(s["text"], F.lit(f"{_QUOTED}|[^'\"]+"), F.lit(0)), lambda t: F.when(
            t.rlike(r"""\A['"]"""), F.repeat(F.lit(" "), F.length(t) - 2)).otherwise(t)), "")
        no = F.lit(False)
        return F.when(~F.exists(s["commands"], opens), F.struct(
            s["commands"].alias("commands"), said(";", ";;", "\n", "||", "&&").alias("control"), said("|").alias("pipe"),
            F.exists(tokens, redirects).alias("redirection"), said("&").alias("background"),
            no.alias("substitution"), no.alias("nested_shell"), no.alias("too_deep"),
            F.when(quotes(s["text"]), F.regexp_replace(s["text"], _QUOTED, "$1$2")).otherwise(s["text"]).alias("plain"),
            F.when(quotes(s["text"]), blanked).otherwise(s["text"]).alias("blanked")))

    def commands(tokens):
        parts = F.split(F.array_join(F.transform(tokens, part), _PARTS), _ENDS)
        words = F.transform(parts, lambda c: F.filter(F.split(c, _PARTS), lambda w: w != ""))
        return F.transform(F.filter(words, lambda w: F.size(w) > 0), command)

    trimmed = F.regexp_replace(text, r"\A\s+|\s+\z", "")
    read = let(F.struct(trimmed.alias("text"), F.regexp_extract_all(trimmed, F.lit(_WORD_OR_SIGN), F.lit(0)).alias("tokens")),
               lambda s: F.struct(s["text"].alias("text"), s["tokens"].alias("tokens"), commands(s["tokens"]).alias("commands")))
    return F.when(easy, let(read, shape))


def with_shape(rows: DataFrame, name: str = "shape") -> DataFrame:
    """Add the shape of `command`: plain ones by expressions, and only the others by the scanner.

    The scanner's column is marked non-deterministic so that no filter repeats it.
    """
    text = F.coalesce("command", F.lit(""))
    rows = computed(rows, "_plain", _plain_shape(text))
    scanned = F.pandas_udf(_shapes, SHAPE).asNondeterministic()(F.when(F.col("_plain").isNull(), text))
    return computed(rows, name, F.coalesce(F.col("_plain").cast(SHAPE), scanned)).drop("_plain")
