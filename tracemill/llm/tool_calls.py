"""Link tool calls and their results, order them by dependency, validate arguments, serialise canonical JSON.

Calls and results meet by a hash join on their identifiers.  A call may refer to earlier ones; joins order
the calls topologically, a call's level being one more than the highest of what it refers to.
One conversation or tool may have most rows: no step gathers a conversation.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

_SURROGATE = re.compile("[\ud800-\udfff]")
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}


def violations(value, schema: dict, path: str = "") -> list[str]:
    """What a JSON value breaks of a schema (type, required, properties, additionalProperties, items, enum, bounds)."""
    kind = schema.get("type")
    if kind and (not isinstance(value, TYPES[kind]) or isinstance(value, bool) and kind != "boolean"):
        return [f"{path or '/'}: not of type {kind}"]
    out = [f"{path or '/'}: not allowed"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, str):
        out += [f"{path or '/'}: shorter than {schema['minLength']}"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{path or '/'}: longer than {schema['maxLength']}"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{path or '/'}: below {schema['minimum']}"] if value < schema.get("minimum", value) else []
        out += [f"{path or '/'}: above {schema['maximum']}"] if value > schema.get("maximum", value) else []
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}/{i}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}/{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}/{k}: unknown")
    return out


def canonical(value) -> str:
    """JSON with sorted keys and without blanks; a lone surrogate, which has no UTF-8, stays escaped."""
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def escaped(text: str) -> str:
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _no_number(text: str):
    raise ValueError("not JSON")


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise OverflowError
    return value


def parsed(text: str | None) -> tuple[object, list[str]]:
    """Value of arguments and what is wrong with them as JSON; the text itself where they have no value."""
    try:
        value = json.loads(text or "", parse_constant=_no_number, parse_float=_number)
        json.dumps(value)  # what can be read may still be too deep to write
        return value, []
    except ValueError:
        return text, ["/: not JSON"]
    except OverflowError:
        return text, ["/: number beyond double"]
    except RecursionError:
        return text, ["/: nested too deeply"]


def _chains(nodes: DataFrame) -> DataFrame:
    """(conv_id, call_id, to, dist, end) of calls with one reference, by pointer doubling.

    `to` is the first call on the way that has none (end 0) or several (end 2), `dist` references away; end
    is null for calls that lead into a cycle.
    """
    key = ["conv_id", "call_id"]
    targets = nodes.select("conv_id", F.col("call_id").alias("to"), F.col("n").alias("end"))
    chain = nodes.filter("n = 1").join(targets, ["conv_id", "to"]).select(
        *key, "to", F.lit(1).cast("long").alias("dist"), F.when(F.col("end") != 1, F.least("end", F.lit(2))).alias("end"))
    chain, reach = common.materialize(chain, "call-chains"), 1
    longest = chain.count()
    while reach <= longest and not chain.filter("end is null").isEmpty():
        ahead = chain.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("dist").alias("more"), F.col("end").alias("next_end"))
        jumped = chain.filter("end is null").join(ahead, ["conv_id", "to"]).select(
            *key, F.col("next").alias("to"), (F.col("dist") + F.col("more")).alias("dist"), F.col("next_end").alias("end"))
        old, chain = chain, common.materialize(chain.filter("end is not null").unionByName(jumped), "call-chains")
        common.discard(old)
        reach *= 2
    return chain


def _joint_levels(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls with several references: edges(conv_id, call_id, anchor, dist, level).

    One round for each level among these calls only, each over those still open.
    """
    key, folder, rounds = ["conv_id", "call_id"], common.shared_folder(edges.sparkSession, "call-levels"), 0
    read = edges.sparkSession.read.schema("conv_id long, call_id string, level long").parquet
    while True:
        state = edges.groupBy(*key).agg((F.count("*") - F.count("level")).alias("missing"), F.max("level").alias("level"))
        state = state.filter("missing = 0").select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "level")
        state.write.parquet(f"{folder}/round={rounds}")
        done = read(f"{folder}/round={rounds}")
        if done.isEmpty():
            return read(*[f"{folder}/round={r}" for r in range(rounds + 1)])
        known = done.select("conv_id", F.col("call_id").alias("anchor"), F.col("level").alias("below"))
        left = edges.join(done.select(*key), key, "left_anti").join(known, ["conv_id", "anchor"], "left")
        left = left.select(*key, "anchor", "dist", F.coalesce("level", F.col("below") + F.col("dist")).alias("level"))
        old, edges = edges, common.materialize(left, "call-joints")
        common.discard(old)
        rounds += 1


def order_calls(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls(conv_id, call_id, after array<string>): 0 without references.

    References to calls that do not exist are left out; calls in or behind a cycle have level null.  Chains
    of single references are followed by pointer doubling, so their length costs its logarithm in rounds;
    what remains is one round for each level among the calls with several references.
    """
    key = ["conv_id", "call_id"]
    links = calls.select(*key, F.explode("after").alias("on")).distinct()
    links = common.materialize(links.join(calls.select("conv_id", F.col("call_id").alias("on")), ["conv_id", "on"]), "call-links")
    kinds = links.groupBy(*key).agg(F.count("*").cast("int").alias("n"), F.min("on").alias("to"))
    nodes = common.materialize(calls.select(*key).join(kinds, key, "left").withColumn("n", F.coalesce("n", F.lit(0))), "call-nodes")
    chain = _chains(nodes)
    rooted = chain.filter("end = 0").select(*key, F.col("dist").alias("level"))
    levels = nodes.filter("n = 0").select(*key, F.lit(0).cast("long").alias("level")).unionByName(rooted)
    joints = nodes.filter("n > 1").select(*key)
    if not joints.isEmpty():
        targets = nodes.drop("to").join(chain.withColumnRenamed("to", "anchor"), key, "left").select(
            "conv_id", F.col("call_id").alias("on"), F.coalesce("anchor", "call_id").alias("anchor"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"),
            ((F.col("n") == 0) | F.coalesce(F.col("end") == 0, F.lit(False))).alias("rooted"))
        edges = links.join(joints, key, "left_semi").join(targets, ["conv_id", "on"]).select(
            *key, "anchor", "dist", F.when(F.col("rooted"), F.col("dist")).alias("level"))
        found = _joint_levels(common.materialize(edges, "call-joints"))
        levels = levels.unionByName(joints.join(found, key, "left"))
        below = found.select("conv_id", F.col("call_id").alias("to"), "level")
        levels = levels.unionByName(chain.filter("end = 2").join(below, ["conv_id", "to"], "left").select(
            *key, (F.col("level") + F.col("dist")).alias("level")))
    cyclic = chain.filter("end is null").select(*key, F.lit(None).cast("long").alias("level"))
    return levels.unionByName(cyclic).withColumn("level", F.col("level").cast("int"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, name, level, linked, valid, errors, json) for each call.

    calls: conv_id, call_id, turn, name, arguments (JSON text), after (array of call ids); results: conv_id,
    call_id, content.  Calls and results that repeat an identifier of their conversation count once: the
    first by turn and text, or by content.  A call without result has linked false and a null result; null
    or broken arguments, numbers beyond double, nesting beyond what Python reads and unknown tools are invalid,
    with the reason in errors and the arguments' text in json.  Other columns are not read.  Rows without conv_id or
    call_id cannot be linked and are left out.  Within a conversation, (level, turn, call_id) is a
    topological order.
    """
    key = ["conv_id", "call_id"]
    first = F.min(F.struct("turn", "name", "arguments", "after")).alias("c")
    calls = calls.filter("conv_id is not null and call_id is not null").groupBy(*key).agg(first).select(*key, "c.*")
    calls = calls.withColumn("after", F.coalesce("after", F.array().cast("array<string>")))
    results = results.filter("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    joined = calls.join(results, key, "left").join(order_calls(calls), key, "left")
    joined = joined.select(*key, "turn", "name", "arguments", "level", F.coalesce("linked", F.lit(False)).alias("linked"), "content")

    def finish(batches):
        for batch in batches:
            valid, errors, texts = [], [], []
            for row in batch.to_pylist():
                arguments, wrong = parsed(row["arguments"])
                if not wrong:
                    wrong = violations(arguments, schemas[row["name"]]) if row["name"] in schemas else ["/: unknown tool"]
                valid.append(not wrong)
                errors.append(escaped("; ".join(wrong)))
                texts.append(canonical({"arguments": arguments, "id": row["call_id"], "name": row["name"], "result": row["content"]}))
            kept = [batch.column(c) for c in ("conv_id", "call_id", "turn", "name", "level", "linked")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())],
                                             names=["conv_id", "call_id", "turn", "name", "level", "linked", "valid", "errors", "json"])

    return joined.mapInArrow(finish, "conv_id long, call_id string, turn long, name string, level int, linked boolean, valid boolean, errors string, json string")


#: Tools that the turns of a conversation are read as, and their schemas.
TOOLS = ["search", "lookup", "count"]
_QUERY = {"type": "string", "minLength": 20, "maxLength": 400}
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "properties": {"query": _QUERY, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}, "additionalProperties": False},
    "lookup": {"type": "object", "required": ["query"], "properties": {"query": _QUERY, "limit": {"type": "integer", "maximum": 40}}, "additionalProperties": False},
    "count": {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 5}}, "additionalProperties": False},
}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations(conv_id, turn, role, text): a user's turn calls a tool, the assistant's
    next turn is its result, and a call refers to the one two turns before.  Null text is empty."""
    text = F.coalesce("text", F.lit(""))
    name = lambda back: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), F.col("turn") - back)
    user = turns.filter("role = 'user'").select(
        "conv_id", name(0).alias("call_id"), "turn",
        F.get(F.array(*map(F.lit, TOOLS)), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(TOOLS))).cast("int")).alias("name"),
        F.to_json(F.struct(F.length(text).alias("limit"), text.alias("query"))).alias("arguments"), F.array(name(2)).alias("after"))
    return user, turns.filter("role = 'assistant'").select("conv_id", name(1).alias("call_id"), text.alias("content"))


SQL = """
WITH calls AS (
  SELECT DISTINCT conv_id, turn, coalesce(text, '') AS t, 'c' || conv_id || '-' || turn AS call_id,
    CASE (conv_id + turn) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'count' END AS name
  FROM conversations WHERE role = 'user'),
results AS (SELECT conv_id, turn - 1 AS turn, min(coalesce(text, '')) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
runs AS (SELECT *, turn // 2 - row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS run FROM calls),
levels AS (SELECT *, CAST((turn - min(turn) OVER (PARTITION BY conv_id, turn % 2, run)) // 2 AS INTEGER) AS level FROM runs),
checked AS (
  SELECT *, concat_ws('; ',
    CASE WHEN name = 'search' AND length(t) > 50 THEN '/limit: above 50' WHEN name = 'search' AND length(t) < 1 THEN '/limit: below 1'
      WHEN name = 'lookup' AND length(t) > 40 THEN '/limit: above 40' WHEN name = 'count' AND length(t) < 5 THEN '/limit: below 5' END,
    CASE WHEN name <> 'count' AND length(t) < 20 THEN '/query: shorter than 20' WHEN name <> 'count' AND length(t) > 400 THEN '/query: longer than 400' END) AS errors
  FROM levels)
SELECT c.conv_id, call_id, c.turn, name, level, content IS NOT NULL AS linked, errors = '' AS valid, errors,
  '{"arguments":{"limit":' || length(t) || ',"query":' || CAST(to_json(t) AS VARCHAR) || '},"id":"' || call_id || '","name":"' || name
  || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM checked c LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn
"""
