"""Repair of a conversation's structure as a shortest path over scalar integer weights.

A path keeps, reroles or deletes each row and inserts empty rows, so that the roles' initials read
`(s?(ua)+)?`.  Its weight is one integer: high digits hold the cost, low digits of a fixed width the edits'
letters in order, three bits each, padded with zeros at the end.  The least integer is thus the cheapest
path and, of those, the one whose letters come first; nothing else decides.

Letters and rows give the cost, so of two paths of one cost between the same states neither's letters begin
the other's, and least weights of adjacent segments compose (`_join`): a conversation of any length is cut
into segments by a range sort, each segment's weights between all states are found where it lies, and only
weights meet.  Conversations that lie within one segment are done there.  One of many segments has its
weights joined in one task, a few bytes a row like its audit, which is a value of the result, and its text
passes through the one hash in order, a row at a time.

Rows and results
* null role or text: one space; a null turn or conv_id: one space in the damage's key.  Null conv_ids are
  one conversation.  Rows of one turn are ordered by role, then text; repeated rows count as often as they come
  and may be numerous, for they are counted before they are sorted.
* blank, repeated and empty texts and roles other than the three: a role's initial counts as written, an
  empty role has none, is never legal beside another, and has to be reroled or deleted.
* an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

#: Octal digits of the letters, ascending as in ASCII; 0 pads.
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_LETTERS = str.maketrans("1234", "DIKR")
#: State after the last kept or inserted row: none yet, system, user, assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAME = {USER: "user", ASSISTANT: "assistant"}
_INITIAL = {USER: "u", ASSISTANT: "a"}
_LEGAL = {"su", "ua", "au"}

_SUMS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_OUT = ", ".join(f"{c} long" for c in _SUMS) + ", audit string, repaired_sha256 string"
_SEGMENT = (f"conv_id long, at long, done boolean, n long, width int, weights array<binary>, first_turn long, last_turn long, "
            f"turns long, first_initial string, last_initial string, rows array<struct<role:string,text:string,copies:long>>, {_OUT}")


def _code(initial: str, gone: bool, cut: bool) -> int:
    """What an edit's cost depends on: initial, must be deleted, truncated."""
    return ("sua".find(initial) + 1 if initial else 0) * 4 + 2 * bool(gone) + bool(cut)


def _weights(codes: bytes, ends: tuple, width: int) -> list:
    """Least weight from each state before the rows to the end; `ends` has the weight after them by state.

    codes: `_code` of each row.  A step puts a letter in front: the cost adds, the digits move one place on,
    and the padding takes up the one that leaves.
    """
    low = 3 * width
    mask = (1 << low) - 1

    def step(weight, letter, cost):
        return None if weight is None else ((weight >> low) + cost << low) | letter << low - 3 | (weight & mask) >> 3

    def least(*found):
        found = [w for w in found if w is not None]
        return min(found) if found else None

    now = list(ends)
    for code in reversed(codes):
        initial, gone, cut = ("", "s", "u", "a")[code >> 2], code & 2, code & 1
        then, now = now, [None] * 4
        for state in range(4):
            found = [step(then[state], DELETE, 2)]
            if not gone:
                role, extra = _NEXT[state], 5 * cut
                found.append(step(then[role], *((KEEP, extra) if initial == _INITIAL[role] else (REROLE, 1 + extra))))
                if state == START and initial == "s":
                    found.append(step(then[SYSTEM], KEEP, extra))
            now[state] = least(*found)
        user, assistant = now[USER], now[ASSISTANT]
        now[USER] = least(user, step(assistant, INSERT, 5))
        now[ASSISTANT] = least(assistant, step(user, INSERT, 5))
        for state in (START, SYSTEM):
            now[state] = least(now[state], step(now[USER], INSERT, 5))
    return now


def _final(width: int) -> tuple:
    """Weights after the last row: nothing, or what completes a pair."""
    low = 3 * width
    one, two = (5 << low) | INSERT << low - 3, (10 << low) | INSERT << low - 3 | INSERT << low - 6
    return 0, two, one, 0


def _join(a, wide: int, b, width: int):
    """Weight of path a (of `wide` letters' width) followed by path b."""
    if a is None or b is None:
        return None
    digits, more = a & (1 << 3 * wide) - 1, b & (1 << 3 * width) - 1
    free = wide if not digits else ((digits & -digits).bit_length() - 1) // 3
    cost = (a >> 3 * wide) + (b >> 3 * width)
    return cost << 3 * (wide + width) | digits << 3 * width | more << 3 * free


def _between(codes: bytes) -> tuple[list, int]:
    """Least weights from each state before the rows to each after them, as a flat list, and their width."""
    width = 3 * len(codes) + 3
    columns = [_weights(codes, tuple(0 if s == t else None for s in range(4)), width) for t in range(4)]
    return [columns[t][s] for s in range(4) for t in range(4)], width


def _joined(parts: list) -> tuple[list, int]:
    """All weights in order as one, by halves."""
    while len(parts) > 1:
        pairs = [parts[i : i + 2] for i in range(0, len(parts), 2)]
        parts = []
        for pair in pairs:
            if len(pair) == 1:
                parts.append(pair[0])
                continue
            (a, wide), (b, width) = pair
            out = []
            for s in range(4):
                for t in range(4):
                    found = [w for m in range(4) if (w := _join(a[4 * s + m], wide, b[4 * m + t], width)) is not None]
                    out.append(min(found) if found else None)
            parts.append((out, wide + width))
    return parts[0]


def _read(weight: int, width: int) -> tuple[int, str]:
    """Cost and letters of a weight."""
    return weight >> 3 * width, f"{weight & (1 << 3 * width) - 1:o}".rstrip("0").translate(_LETTERS)


@lru_cache(maxsize=20_000)
def _whole(codes: bytes) -> tuple[int, str]:
    width = 3 * len(codes) + 3
    return _read(_weights(codes, _final(width), width)[START], width)


class _Writer:
    """Hash of a repaired conversation, row by row."""

    def __init__(self):
        self.state, self.hash, self.empty = START, hashlib.sha256(), True

    def _put(self, role: str, text: str):
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def insert(self):
        self.state = _NEXT[self.state]
        self._put(_NAME[self.state], "")

    def write(self, role: str, text: str, copies: int, letters):
        """A row and the rows put before it; letters: those not used yet, in order."""
        for _ in range(copies):
            while (letter := next(letters)) == "I":
                self.insert()
            if letter == "K":
                self.state = SYSTEM if self.state == START and role[:1] == "s" else _NEXT[self.state]
                self._put(role, text)
            elif letter == "R":
                self.state = _NEXT[self.state]
                self._put(_NAME[self.state], text)

    def digest(self, letters) -> str:
        """letters: those left after the last row, all of them insertions."""
        for _ in letters:
            self.insert()
        return self.hash.hexdigest()


def _segments(size: int, heavy: int):
    """Python side of the first pass: rows of one task, sorted, to finished conversations and open segments."""

    def cut(batches):
        task, k, rows, conv, began, names = None, 0, [], None, False, None

        def segment(end: bool):
            """The rows held: done if the conversation begins and ends here."""
            nonlocal k, rows, began
            blank = duplicate = truncated = illegal = turns = 0
            codes, last, before = bytearray(), None, None
            for turn, role, text, copies, later, state, tail in rows:
                initial = role[:1]
                for c in range(copies):
                    if before is not None:
                        illegal += before + initial not in _LEGAL
                    before = initial
                    gone = state or later or tail or c
                    codes.append(_code(initial, gone, not gone and text[1]))
                    if state:
                        blank += 1
                    elif gone:
                        duplicate += 1
                    else:
                        truncated += text[1]
                if turn is not None and copies and turn != last:
                    turns, last = turns + 1, turn
            some = [r for r in rows if r[3]]
            known = [r[0] for r in some if r[0] is not None]
            codes = bytes(codes)
            out = {"conv_id": conv, "at": (task << 33) + k, "done": began and end, "n": len(codes), "turns": turns,
                   "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
                   "first_initial": some[0][1][:1] if some else None, "last_initial": some[-1][1][:1] if some else None,
                   "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal}
            plain = [(r[1], r[2][0], r[3]) for r in some]
            if out["done"]:
                cost, audit = _whole(codes)
                writer, letters = _Writer(), iter(audit)
                for row in plain:
                    writer.write(*row, letters)
                gaps = known[-1] - known[0] + 1 - turns if known else 0
                out |= {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": writer.digest(letters)}
            else:
                found, width = _between(codes)
                out |= {"width": width, "rows": [{"role": r, "text": t, "copies": c} for r, t, c in plain],
                        "weights": [None if w is None else w.to_bytes((w.bit_length() + 7) // 8 or 1, "big") for w in found]}
            k, rows, began = k + 1, [], False
            return out

        schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("done", pa.bool_()), ("n", pa.int64()), ("width", pa.int32()),
                            ("weights", pa.list_(pa.binary())), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
                            ("first_initial", pa.string()), ("last_initial", pa.string()),
                            ("rows", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string()), ("copies", pa.int64())]))),
                            *[(c, pa.int64()) for c in _SUMS],
                            ("audit", pa.string()), ("repaired_sha256", pa.string())])
        count = weight = 0
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "task", "turn", "role", "text", "copies", "later", "blank", "cut")]
            for now, task, turn, role, text, copies, later, state, bad in zip(*columns):
                if names is None or (now,) != names:
                    if rows:
                        found.append(segment(True))
                    # the task's first conversation may have begun in the task before, its last may go on
                    began, names, conv, count, weight = names is not None, (now,), now, 0, 0
                tail = 0
                while True:  # a row of more copies than a segment takes goes on in the next
                    part = min(copies, max(1, size - count))
                    if rows and (count + max(part, 1) > size or weight + len(text) > heavy):
                        found.append(segment(False))
                        count = weight = 0
                        continue
                    rows.append((turn, role, (text, bad), part, later, state, tail))
                    count, weight, copies, tail = count + max(part, 1), weight + len(text), copies - part, 1
                    if copies <= 0:
                        break
            yield pa.RecordBatch.from_pylist(found, schema)
        if rows:
            yield pa.RecordBatch.from_pylist([segment(False)], schema)

    return cut


def _fold(pdf):
    """All segments of one conversation: totals in its first row, and each segment's letters."""
    pdf = pdf.sort_values("at", ignore_index=True)
    parts = [([None if w is None else int.from_bytes(w, "big") for w in ws], int(width)) for ws, width in zip(pdf["weights"], pdf["width"])]
    whole, width = _joined(parts)
    ends = _final(3)
    cost, audit = _read(min(w for t in range(4) if (w := _join(whole[t], width, ends[t], 3)) is not None), width + 3)
    rows = np.cumsum(pdf["n"])
    is_row = np.frombuffer(audit.encode(), np.uint8) != ord("I")
    place = np.flatnonzero(is_row) + 1  # letters up to and with the k-th row
    till = [int(place[n - 1]) if n else 0 for n in rows]
    till[-1] = len(audit)
    out = pdf[["conv_id", "at"]].copy()
    out["audit"] = [audit[a:b] for a, b in zip([0, *till], till)]
    illegal, turns, last, first_turn, last_turn, before = 0, 0, None, None, None, None
    for r in pdf.itertuples():
        illegal, turns = illegal + r.illegal, turns + r.turns
        if r.n and isinstance(r.first_initial, str):
            illegal += before is not None and before + r.first_initial not in _LEGAL
            before = r.last_initial
        if r.turns:
            turns -= last == r.first_turn
            first_turn, last_turn, last = r.first_turn if first_turn is None else first_turn, r.last_turn, r.last_turn
    for c, v in {"gaps": int(last_turn - first_turn) + 1 - turns if last is not None else 0, "blank": pdf["blank"].sum(),
                 "duplicate": pdf["duplicate"].sum(), "truncated": pdf["truncated"].sum(), "illegal": illegal, "cost": cost}.items():
        out[c] = int(v)
    return out


def _hashes(batches):
    """Letters and rows of segments, sorted, to one row for each conversation; texts pass by row by row."""
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _SUMS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    held, writer, audit, ahead, letters = None, None, [], deque(), None

    def use(ahead):
        while ahead:
            yield ahead.popleft()

    def done():
        return held | {"audit": "".join(audit), "repaired_sha256": writer.digest(letters)}

    for batch in batches:
        found = []
        for r in batch.to_pylist():
            if held is None or r["conv_id"] != held["conv_id"]:
                if held:
                    found.append(done())
                held, writer, audit, ahead = {c: r[c] for c in ("conv_id", *_SUMS)}, _Writer(), [], deque()
                letters = use(ahead)
            if r["role"] is None:
                audit.append(r["audit"])
                ahead.extend(r["audit"])
            else:
                writer.write(r["role"], r["text"], r["copies"], letters)
        yield pa.RecordBatch.from_pylist(found, schema)
    if held:
        yield pa.RecordBatch.from_pylist([done()], schema)


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage; one that is dropped stays with 0 copies."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("code", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20)
    code = F.col("code")
    text = F.when(code.isin(0, 1), "").when(code == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(code == 0, "").when(code == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.when(code == 0, 0).when(code == 3, 2).otherwise(1).cast("long").alias("copies"))


def repair(rows: DataFrame, size: int = 256, heavy: int = 1 << 22) -> DataFrame:
    """Faults, cheapest edits and hash of the repaired text of every conversation.

    rows: conv_id, turn, role, text (not null) and copies.  A segment has at most `size` rows and, but for
    its last row, `heavy` characters.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = [F.xxhash64(F.lit(i), "role", "text").alias(f"key_{i}") for i in range(2)]
    rows = rows.select("*", *key)
    at = F.struct(F.col("turn").isNotNull(), "turn")
    first = rows.filter("copies > 0").groupBy(F.col("conv_id").alias("c"), F.col("key_0").alias("k"), F.col("key_1").alias("l")).agg(
        F.min(at).alias("first"), F.max(at).alias("last")).filter("not (first <=> last)").select("c", "k", "l", "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key_0") == F.col("k")) & (F.col("key_1") == F.col("l"))
    rows = rows.join(first, same, "left").withColumns({
        "later": F.coalesce(F.col("first") < at, F.lit(False)),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "cut": F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).rlike(r"[^.!?]")})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id().cast("long"))
    rows = rows.select("conv_id", "task", "turn", "role", "text", "copies", "later", "blank", "cut")
    parts = common.materialize(rows.mapInArrow(_segments(size, heavy), _SEGMENT), "turns")

    done = parts.filter("done").select("conv_id", *_SUMS, "audit", "repaired_sha256")
    opened = parts.filter("not done")
    known = {c: F.coalesce(c, F.lit(0)) for c in ("first_turn", "last_turn")}  # read only where a segment has turns
    letters = opened.select("conv_id", "at", "n", "width", "weights", "turns", "first_initial", "last_initial", "blank", "duplicate",
                            "truncated", "illegal", *[v.alias(c) for c, v in known.items()])
    letters = letters.groupBy("conv_id").applyInPandas(_fold, f"conv_id long, at long, audit string, {', '.join(f'{c} long' for c in _SUMS)}")
    texts = opened.select("conv_id", "at", F.posexplode("rows").alias("place", "row")).select("conv_id", "at", "place", "row.*")
    both = letters.withColumn("place", F.lit(-1)).unionByName(texts, allowMissingColumns=True)
    both = both.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place")
    return done.unionByName(both.mapInArrow(_hashes, f"conv_id long, {_OUT}"))


def repair_turns(conversations: DataFrame, size: int = 256) -> DataFrame:
    """The given damage, then the repair, for every conv_id of the table."""
    return repair(damage(conversations), size)


def sql() -> str:
    """The query in DuckDB's SQL: the same paths by recursion, with weights as strings of cost and letters."""
    def add(state, cost, letter, text):
        return (f"CASE WHEN {state} IS NOT NULL THEN {{'k': printf('%06d', CAST(substr({state}.k, 1, 6) AS INT) + {cost}) || substr({state}.k, 7)"
                f" || '{letter}', 't': {state}.t || {text}}} END")

    def insert(state, role):
        return add(state, 5, "I", f"chr(10) || '{role}:'")

    def take(state, role):
        kept = add(state, "5 * cut", "K", "chr(10) || role || ':' || text")
        new = add(state, "1 + 5 * cut", "R", f"chr(10) || '{role}:' || text")
        return f"CASE WHEN gone THEN NULL WHEN initial = '{role[0]}' THEN {kept} ELSE {new} END"

    steps = ", ".join(["-1"] * 8)
    null = "CAST(NULL AS STRUCT(k VARCHAR, t VARCHAR))"
    i2 = f"list_min([s2, {insert('s0', 'user')}, {insert('s1', 'user')}, {insert('s3', 'user')}])"
    system = f"CASE WHEN NOT gone AND initial = 's' THEN {add('s0', '5 * cut', 'K', 'chr(10) || role || chr(58) || text')} END"
    return f"""
    WITH RECURSIVE raw AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               xor(list_reduce(list_concat([4294967295], flatten(list_transform(
                   string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
                   lambda c: [CAST(ord(c) AS BIGINT), {steps}]))),
                   lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS code
        FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN code = 1 THEN '' WHEN code = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy
        FROM raw WHERE code <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM damaged),
    judged AS (
        SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
               row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
               NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS bad,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) || left(role, 1) NOT IN ('su', 'ua', 'au') AS odd
        FROM placed),
    faults AS (SELECT *, blank OR again AS gone, CAST(bad AND NOT blank AND NOT again AS INT) AS cut FROM judged),
    sums AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
               count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut = 1) AS truncated,
               count(*) FILTER (odd) AS illegal, max(k) AS n
        FROM faults GROUP BY conv_id),
    names AS (SELECT DISTINCT conv_id FROM conversations),
    path(conv_id, k, s0, s1, s2, s3) AS (
        SELECT conv_id, CAST(0 AS BIGINT), {{'k': '000000', 't': ''}}, {null}, {null}, {null} FROM names
        UNION ALL
        SELECT conv_id, k, {add('i0', 2, 'D', "''")}, list_min([{add('i1', 2, 'D', "''")}, {system.replace('s0', 'i0')}]),
               list_min([{add('i2', 2, 'D', "''")}, {take('i0', 'user')}, {take('i1', 'user')}, {take('i3', 'user')}]),
               list_min([{add('i3', 2, 'D', "''")}, {take('i2', 'assistant')}])
        FROM (SELECT f.conv_id, f.k, f.role, f.text, f.initial, f.gone, f.cut, s0 AS i0, s1 AS i1, i2,
                     list_min([s3, {insert('i2', 'assistant')}]) AS i3
              FROM (SELECT *, {i2} AS i2 FROM path) AS p JOIN faults AS f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.k = p.k + 1)),
    ended AS (
        SELECT p.conv_id, list_min([s0, s3, {insert('s2', 'assistant')}, {insert('two', 'assistant')}]) AS best
        FROM (SELECT *, {insert('s1', 'user')} AS two FROM path) AS p LEFT JOIN sums ON p.conv_id IS NOT DISTINCT FROM sums.conv_id
        WHERE p.k = coalesce(n, 0))
    SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(substr(best.k, 1, 6) AS BIGINT) AS cost,
           substr(best.k, 7) AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
    FROM ended AS e LEFT JOIN sums ON e.conv_id IS NOT DISTINCT FROM sums.conv_id"""
