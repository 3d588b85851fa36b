"""Data events of structured outputs, from their lines: no output is ever in one row.

NDJSON, YAML and tables are judged by counts over a task's lines and give an event for each line.  A JSON array
is cut into its items by prefix sums: each line, in which strings begin and end, adds to the depth of brackets
and to the number of commas between items; a line that knows the sums before it knows which of its pieces
belong to which item.  Items then are parsed one by one, and the array is one if all of them are.  Only a JSON
object is put together, as its event is that object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions.text import trim
from ..operators.extract import _columns, _delimiter, _event_columns, _parses
from ..sources.steps import stored
from .segments import KEY, SEGMENT_POSITIONS, running_total

#: Control characters, which JSON has none of, stand for what must not be seen: brackets and commas within
#: strings, escaped backslashes, escaped quotes.
SHOWN, HIDDEN = "[]{},", "\x01\x02\x03\x04\x05"
ESCAPES = {"\\\\": "\x06", '\\"': "\x07"}
TOKEN = r"[\[\]{},]|[^\[\]{},]+"
DELIMITERS = {"tab": "\t", "comma": ",", "bar": "|"}


def _filled(row: Column) -> Column:
    """Whether anything is left of a row when it is trimmed; like the tests below, without making the trimmed row."""
    return row.rlike(r"(?U)\S")


def _starts(row: Column, sign: str) -> Column:
    return row.contains(sign) & row.rlike(rf"(?U)^\s*\{sign}")


def _has_pair(row: Column) -> Column:
    return row.contains(": ") & row.rlike(r"(?Us): .*\S")


def _is_pair(row: Column) -> Column:
    return _has_pair(row) & ~_starts(row, "#")


def _is_json(row: Column) -> Column:
    return F.when(_starts(row, "{"), _parses(row)).otherwise(False)


def _body(lines: DataFrame, barred: Column) -> DataFrame:
    """Lines from the first to the last that is not blank, as rows of the trimmed output, of tasks without a barred line."""
    rows, filled = lines.select(KEY, "line_no", "text"), _filled(F.col("text"))
    # the first line's number and opener in one integer, so that no text is sorted or shuffled for it
    opener = F.when(_starts(F.col("text"), "["), 1).when(_starts(F.col("text"), "{"), 2).otherwise(0)
    ends = lines.groupBy(KEY).agg(
        F.min(F.when(filled, F.col("line_no") * 4 + opener)).alias("_top"), F.max(F.when(filled, F.col("line_no"))).alias("_last"),
        F.bool_or(barred).alias("_barred"))
    ends = ends.filter(F.col("_top").isNotNull() & ~F.coalesce("_barred", F.lit(False))).select(KEY, "_last", F.floor(F.col("_top") / 4).alias("_first"), F.get(F.array(F.lit(""), F.lit("["), F.lit("{")), F.col("_top") % 4).alias("opener"))
    row = F.when(F.col("line_no") == F.col("_first"), F.regexp_replace("text", r"(?U)^\s+", "")).otherwise(F.col("text"))
    rows = rows.join(ends, KEY).filter(F.col("line_no").between(F.col("_first"), F.col("_last"))).withColumn("row", row)
    row = F.when(F.col("line_no") == F.col("_last"), F.regexp_replace("row", r"(?U)\s+\z", "")).otherwise(F.col("row"))
    rows = rows.withColumn("row", row)
    row = F.when(F.col("row").endswith("\r"), F.regexp_replace("row", r"\r\z", "")).otherwise(F.col("row"))
    return rows.select(KEY, "line_no", "opener", row.alias("row"))


def _line_formats(body: DataFrame) -> DataFrame:
    """task_id, format, delimiter of what is judged line by line."""
    row = F.col("row")
    filled = _filled(row)
    counts = {f"{side.__name__}_{name}": side(F.when(filled, _columns(row, F.lit(d)))) for name, d in DELIMITERS.items() for side in (F.min, F.max)}
    stats = body.groupBy(KEY).agg(
        F.count_if(filled).alias("n"), F.count(F.lit(1)).alias("rows"), F.count_if(_is_json(row)).alias("n_json"),
        F.count_if(_is_pair(row)).alias("pairs"), *[c.alias(k) for k, c in counts.items()])
    head = body.withColumn("_rn", F.row_number().over(Window.partitionBy(KEY).orderBy("line_no"))).filter("_rn <= 5")
    plain = ~filled | _starts(row, "#") | _has_pair(row)
    head = head.groupBy(KEY).agg(F.bool_and(plain).alias("plain"), F.max(F.when(F.col("_rn") == 1, row)).alias("top"))
    delimiter = _delimiter(F.col("top"))
    even = F.lit(False)
    for name, d in DELIMITERS.items():
        even = F.when(delimiter == d, (F.col(f"min_{name}") == F.col(f"max_{name}"))).otherwise(even)
    n = F.col("n")
    return stats.join(head, KEY).select(
        KEY, delimiter.alias("delim"),
        F.when((n >= 2) & (F.col("n_json") >= F.floor(n * 4 / 5)), "ndjson")
        .when(((trim(F.col("top")) == "---") | ((F.col("rows") >= 2) & F.col("plain"))) & (F.col("pairs") > 0), "yaml")
        .when((n >= 2) & delimiter.isNotNull() & even, "csv").alias("format"))


def _hide(row: Column) -> Column:
    """The row with only those brackets and commas that are outside of strings."""
    for shown, hidden in ESCAPES.items():
        row = F.replace(row, F.lit(shown), F.lit(hidden))
    parts = F.transform(F.split(row, '"'), lambda p, i: F.when(i % 2 == 1, F.translate(p, SHOWN, HIDDEN)).otherwise(p))
    return F.array_join(parts, '"')


def _show(text: Column) -> Column:
    text = F.translate(text, HIDDEN, SHOWN)
    for shown, hidden in ESCAPES.items():
        text = F.replace(text, F.lit(hidden), F.lit(shown))
    return text


def _number(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _scan(tokens: Column, depth: Column) -> Column:
    """What a line has: commas between items, values begun and ended at the outermost level, anything else there."""
    names = ("commas", "begun", "ended", "stray")
    zero = F.struct(depth.cast("long").alias("depth"), *[F.lit(0).alias(n) for n in names])

    def step(s, t):
        opens, closes, d = t.isin("[", "{"), t.isin("]", "}"), s["depth"]
        tests = {"commas": (t == ",") & (d == 1), "begun": opens & (d == 0), "ended": closes & (d == 1), "stray": (d == 0) & ~opens & (trim(t) != "")}
        return F.struct((d + F.when(opens, 1).when(closes, -1).otherwise(0)).cast("long").alias("depth"),
                        *[(s[n] + tests[n].cast("int")).alias(n) for n in names])

    return F.aggregate(tokens, zero, step)


def _json_shapes(body: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Lines of outputs that may be one JSON value, with the depth and the commas before each; and those that are
    one by their brackets and quotes."""
    rows = body.filter(F.col("opener").isin("[", "{")).withColumn("hidden", _hide(F.col("row")))
    # strings cannot go over a line's end in JSON, so a line's brackets need no more than the line
    rows = rows.withColumns({
        "adds": (_number(F.col("hidden"), "[{") - _number(F.col("hidden"), "]}")).cast("long"),
        "open": (_number(F.col("hidden"), '"') % 2 == 1) | (_number(F.col("row"), HIDDEN + "".join(ESCAPES.values())) > 0)})
    rows = running_total(rows, F.col("adds"), "depth", ("line_no",), width).withColumn("depth", F.col("depth") - F.col("adds"))
    rows = stored(rows.select(KEY, "line_no", "opener", "hidden", "adds", "open", "depth"), "format-depths")
    rows = rows.withColumn("tokens", F.regexp_extract_all("hidden", F.lit(TOKEN), F.lit(0)))
    rows = rows.withColumn("scan", _scan(F.col("tokens"), F.col("depth")))
    rows = running_total(rows, F.col("scan.commas").cast("long"), "commas", ("line_no",), width)
    rows = rows.withColumn("commas", F.col("commas") - F.col("scan.commas"))
    whole = rows.groupBy(KEY, "opener").agg(
        F.sum("adds").alias("end"), F.sum("scan.begun").alias("begun"), F.sum("scan.ended").alias("ended"), F.sum("scan.stray").alias("stray"),
        F.bool_or("open").alias("open"), F.min("depth").alias("least"))
    whole = whole.filter("end = 0 and begun = 1 and ended = 1 and stray = 0 and not open and least >= 0").select(KEY, "opener")
    return rows, whole


def _array_items(rows: DataFrame, whole: DataFrame) -> DataFrame:
    """task_id, item (from 0) and text of each item of the arrays."""
    rows = rows.join(whole.filter("opener = '['").select(KEY), KEY, "left_semi")
    each = rows.select(KEY, "line_no", "depth", "commas", F.posexplode(F.concat("tokens", F.array(F.lit("\n")))).alias("pos", "token"))
    w = Window.partitionBy(KEY, "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value: F.coalesce(F.sum(value).over(w), F.lit(0))
    token = F.col("token")
    step = F.when(token.isin("[", "{"), 1).when(token.isin("]", "}"), -1).otherwise(0)
    each = each.withColumn("step", step).withColumn("at", F.col("depth") + before(F.col("step")))
    comma = (token == ",") & (F.col("at") == 1)
    each = each.withColumn("cut", comma.cast("int")).withColumn("item", F.col("commas") + before(F.col("cut")))
    outer = comma | ((F.col("at") == 0) & (F.col("step") == 1)) | ((F.col("at") == 1) & (F.col("step") == -1)) | ((F.col("at") == 0) & (token != "\n"))
    # a cut leaves an empty piece, so that an item without text is one too
    pieces = each.select(KEY, "item", "line_no", "pos", F.when(outer, "").otherwise(token).alias("token"))
    last = each.filter("cut = 1").select(KEY, (F.col("item") + 1).alias("item"), "line_no", "pos", F.lit("").alias("token"))
    return pieces.unionByName(last).groupBy(KEY, "item").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "pos", "token"))), lambda x: x["token"]), "").alias("text")
    ).withColumn("text", _show(F.col("text")))


def _json_events(body: DataFrame, width: int) -> DataFrame:
    """task_id, item (from 1, or null for a task without any) and event of outputs that are one JSON value."""
    rows, whole = _json_shapes(body, width)
    whole = stored(whole, "format-whole")
    items = stored(_array_items(rows, whole), "format-items").withColumn("value", X.strict_json(F.col("text")))
    blank = (F.col("item") == 0) & (trim(F.col("text")) == "")
    good = items.groupBy(KEY).agg(F.bool_and(F.col("value").isNotNull() | blank).alias("good"), F.count(F.lit(1)).alias("n"), F.bool_or(blank).alias("blank"))
    good = good.filter("good and (n = 1 or not blank)").select(KEY)
    arrays = items.join(good, KEY, "left_semi").select(KEY, F.when(~blank, F.col("item") + 1).alias("item"),
                                                       F.when(~blank, X.json_value_event(F.col("value"), F.to_json("value"))).alias("event"))
    texts = body.join(whole.filter("opener = '{'").select(KEY), KEY, "left_semi").groupBy(KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "row"))), lambda x: x["row"]), "\n").alias("text"))
    objects = texts.withColumn("value", X.strict_json(F.col("text"))).filter("value is not null").select(
        KEY, F.lit(1).cast("long").alias("item"), X.json_value_event(F.col("value"), F.to_json("value")).alias("event"))
    return arrays.unionByName(objects)


def line_format_events(lines: DataFrame, width: int = SEGMENT_POSITIONS, barred: Column | None = None) -> DataFrame:
    """Data events of the outputs in lines (task_id, line_no, text), numbered by `item` from 1 in each task.

    An output with a line for which `barred` holds has none.

    The same as operators.extract.format_events over the lines put together, for output of any size.  What
    several steps read (the bodies of the outputs, the depths of their brackets, the items) is written once to
    the shared folder, so the lines are read twice, and nothing is computed again.
    """
    body = stored(_body(lines, F.lit(False) if barred is None else barred), "format-bodies")
    json = stored(_json_events(body, width), "format-json")
    formats = _line_formats(body).filter("format is not null").join(json.select(KEY).distinct(), KEY, "left_anti")
    row, kind, info = F.col("row"), F.col("format"), F.lit("info")
    filled = _filled(row)
    own = F.when(kind == "ndjson", _is_json(row)).when(kind == "yaml", _is_pair(row)).otherwise(filled)
    rows = running_total(body.join(formats, KEY).filter(own), F.lit(1).cast("long"), "item", ("line_no",), width)
    variant, pair = F.try_parse_json(trim(row)), trim(row)
    key = F.substring_index(pair, ": ", 1)
    event = (
        F.when(kind == "ndjson", X.json_value_event(variant, F.to_json(variant)))
        .when(kind == "yaml", X.event_struct(F.lit("data"), info, F.substring(pair, F.length(key) + 3, F.length(pair)), key))
        .otherwise(X.event_struct(F.lit("data"), info, F.replace(row, F.col("delim"), F.lit(", ")))))
    rows = rows.select(KEY, "format", "item", event.alias("event"))
    rows = rows.unionByName(json.filter("item is not null").withColumn("format", F.lit("json")))
    return rows.select(KEY, "format", "item", *_event_columns("event"))
