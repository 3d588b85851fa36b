"""Repeated byte strings by merging sparse Burrows-Wheeler transforms of text shards.

Every window of `width` bytes is named by its anchor: the 32-byte gram of least hash in it, the first of
equal ones.  Equal windows have equal anchors at equal places, so only suffixes that start at an anchor or
up to `width` bytes before it matter, and only within one anchor's group.  Windows in a row with the same
anchor form a span; spans are counted first, so copies of whole spans are settled without their text.

What is left are different spans with one anchor, the borders of repeated passages.  Each task over
documents (a shard) sorts its spans by the text that follows the anchor, which with the bytes before the
anchors is the shard's transform, kept at the anchors only.  Merging refines the interleave of the shards:
all rows of a group form one block, and each pass parts blocks by the next byte, keeping the shards' own
order; the pass in which two neighbours part is their common prefix.  Then one LF step at a time prepends
the byte before the suffixes by a stable distribution, which never sorts suffixes again and carries the
common prefixes along by range minima.  Neighbours with `width` bytes in common are repeated intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import common

GRAM = 32
_STEPS = np.random.default_rng(11).integers(1, 2**63, 6, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.uint64((1 << 24) - 1)


def _spans(data: np.ndarray, at: np.ndarray, width: int):
    """(document, first window, last window, anchor, anchor's hash) of each span in a chunk of texts."""
    n = len(data)
    if n < width:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    gram, size = common.BYTE_CODES[data], 1
    for step in _STEPS[:5]:
        gram = gram[:-size] * step + gram[size:]
        size *= 2
    gram = common.mix(gram)
    least, reach, span = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), 1, width - GRAM + 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    anchor = (least & _PLACE).astype(np.int64)
    valid = np.zeros(n - width + 2, np.int8)
    lengths = np.diff(at)
    long = np.flatnonzero(lengths >= width)
    np.add.at(valid, at[long], 1)
    np.add.at(valid, at[long] + lengths[long] - width + 1, -1)
    inside = np.cumsum(valid[:-1]).astype(bool)
    opens = np.zeros(len(inside), bool)
    opens[at[long]] = True
    change = np.ones(len(inside), bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | opens[1:] | (inside[1:] != inside[:-1])
    starts = np.flatnonzero(change & inside)
    stops = np.append(np.flatnonzero(change), len(inside))
    ends = stops[np.searchsorted(stops, starts, "right")] - 1
    doc = np.searchsorted(at, starts, "right") - 1
    return [doc, starts, ends, anchor[starts], gram[anchor[starts]]]


def _pieces(batch, piece: int, width: int):
    """Chunks of texts as in common.chunks, but very long texts in pieces that overlap by a window less a byte."""
    for first, last, data, at in common.chunks(batch):
        if len(data) <= piece:
            yield first, data, at, 0
            continue
        for begin in range(0, max(1, len(data) - width + 1), piece):  # such a chunk is one text
            part = data[begin : begin + piece + width - 1]
            yield first, part, np.array([0, len(part)]), begin


def spans(docs: DataFrame, width: int, piece: int = 1 << 22) -> DataFrame:
    """All spans: the text's key, start byte, windows, bytes before the anchor, hashes of anchor and of the span's text."""

    def scan(batches):
        for batch in batches:
            for first, data, at, begin in _pieces(batch, piece, width):
                doc, start, end, anchor, gram = _spans(data, at, width)
                raw = memoryview(np.ascontiguousarray(data))
                shape = ((anchor - start) * (1 << 20) + (anchor - end)).tolist()
                texts = np.array([
                    xxhash.xxh3_64_intdigest(raw[a:b], seed)
                    for a, b, seed in zip(start.tolist(), (end + width).tolist(), shape)
                ], np.uint64)
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays([
                    batch.column("key_x").take(rows), batch.column("key_y").take(rows),
                    pa.array(start - at[doc] + begin, pa.int64()), pa.array(end - start + 1, pa.int32()),
                    pa.array(anchor - start, pa.int32()), pa.array(gram.view(np.int64)), pa.array(texts.view(np.int64)),
                ], names=["key_x", "key_y", "start", "n", "lead", "anchor", "span"])

    return docs.select("key_x", "key_y", "text").mapInArrow(scan, "key_x long, key_y long, start long, n int, lead int, anchor long, span long")


def _minima(common_prefix: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least common prefix between rows left < right: the minimum over entries left + 1 .. right."""
    gap, table, power = right - left, common_prefix, 1
    out = np.full(len(left), np.iinfo(np.int16).max, np.int16)
    while True:
        level = (gap >= power) & (gap < 2 * power)
        if level.any():
            a, b = left[level] + 1, right[level] + 1 - power
            out[level] = np.minimum(table[a], table[b])
        if 2 * power > gap.max(initial=0):
            return out
        table = np.minimum(table, np.append(table[power:], np.full(power, np.iinfo(np.int16).max, np.int16)))
        power *= 2


def merge_transforms(group: np.ndarray, shard: np.ndarray, order: np.ndarray, after: np.ndarray, before: np.ndarray,
                     lead: np.ndarray, last: np.ndarray, width: int) -> np.ndarray:
    """Which windows of each span are repeated in another span: a mask (span, bytes before the anchor).

    group: anchor's number; shard, order: place in the shard's sorted order; after, before: symbols (byte + 1,
    0 beyond the text) from the anchor onward and backward; lead, last: most and least bytes of a window
    before the anchor.
    """
    rows = np.lexsort((order, shard, group))  # the interleave at depth 0: group by group, shard by shard
    block = group[rows].astype(np.int64)
    prefix = np.full(len(rows), width, np.int16)
    prefix[0], prefix[1:][block[1:] != block[:-1]] = -1, -1
    new = np.append(True, block[1:] != block[:-1])
    for depth in range(width):
        block = np.cumsum(new)
        sizes = np.bincount(block)
        live = np.flatnonzero(sizes[block] > 1)
        if not len(live):
            break
        key = block[live] * 257 + after[rows[live], depth]
        kept = np.argsort(key, kind="stable")
        rows[live], key = rows[live][kept], key[kept]
        parted = np.append(False, key[1:] != key[:-1]) & ~new[live]
        prefix[live[parted]] = depth
        new[live[parted]] = True
    found = np.zeros((len(rows), int(lead.max(initial=0)) + 1), bool)
    for step in range(found.shape[1]):
        beside = np.maximum(prefix, np.append(prefix[1:], -1))
        hit = rows[beside >= width]
        found[hit[(last[hit] <= step) & (step <= lead[hit])], step] = True
        keep = np.flatnonzero(lead[rows] > step)
        if len(keep) < 2:
            break
        key = group[rows[keep]].astype(np.int64) * 257 + before[rows[keep], step]
        moved = np.argsort(key, kind="stable")
        key, places = key[moved], keep[moved]
        grown = np.full(len(places), -1, np.int16)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        grown[same] = np.minimum(_minima(prefix, places[same - 1], places[same]), width - 1) + 1
        rows, prefix = rows[places], grown
    return found


def _border_texts(needs: DataFrame, width: int) -> DataFrame:
    """The shards' transforms at the anchors: a row for each wanted span, with its place in the shard's order."""

    def cut(batches):
        for batch in batches:
            out = []
            for text, wanted in zip(batch.column("text"), batch.column("wanted").to_pylist()):
                raw = (text.as_py() or "").encode() if wanted else b""
                out += [(w["anchor"], w["span"], w["lead"], w["n"], raw[w["start"] : w["start"] + w["n"] - 1 + width]) for w in wanted or ()]
            out.sort(key=lambda r: (r[0], r[4][r[2] :]))
            cols = list(zip(*out)) if out else [()] * 5
            source = int(xxhash.xxh3_64_intdigest(cols[4][0]) >> 1) if out else 0
            yield pa.RecordBatch.from_arrays([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()),
                pa.array(cols[4], pa.binary()), pa.array([source] * len(out), pa.int64()), pa.array(range(len(out)), pa.int32()),
            ], names=["anchor", "span", "lead", "n", "bytes", "shard", "place"])

    return needs.mapInArrow(cut, "anchor long, span long, lead int, n int, bytes binary, shard long, place int")


def _symbols(texts: list[bytes], columns: int) -> np.ndarray:
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), columns), np.int16)
    out[np.arange(columns)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int16) + 1
    return out


def _merged(rows: DataFrame, width: int, bucket: int) -> DataFrame:
    """Repeated window intervals of each border span; whole anchor groups are merged, `bucket` rows at a time."""

    def resolve(table):
        texts, lead = table["bytes"].to_pylist(), table["lead"].to_numpy()
        n = table["n"].to_numpy()
        after = _symbols([t[a : a + width] for t, a in zip(texts, lead.tolist())], width)
        before = _symbols([t[:a][::-1] for t, a in zip(texts, lead.tolist())], int(lead.max()) + 1)
        group = np.unique(table["anchor"].to_numpy(), return_inverse=True)[1]
        found = merge_transforms(group, table["shard"].to_numpy(), table["place"].to_numpy(), after, before, lead, lead - n + 1, width)
        window = found[:, ::-1]  # windows in text order; the first one has the most bytes before the anchor
        edge = np.diff(np.pad(window.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        stop = np.nonzero(edge == -1)[1]
        shift = found.shape[1] - 1 - lead[row]
        spans = table["span"].to_numpy()[row]
        return pa.RecordBatch.from_arrays(
            [pa.array(table["anchor"].to_numpy()[row]), pa.array(spans), pa.array((first - shift).astype(np.int64)), pa.array((stop - shift - 1).astype(np.int64))],
            names=["anchor", "span", "first", "last"])

    def merge(batches):
        held, size = [], 0
        for group in common.sorted_groups(batches, "anchor"):
            if held and size + group.num_rows > bucket:
                yield resolve(pa.concat_tables(held))
                held, size = [], 0
            held.append(group)
            size += group.num_rows
        if held:
            yield resolve(pa.concat_tables(held))

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(merge, "anchor long, span long, first long, last long")


def _counted(rows: DataFrame, width: int) -> DataFrame:
    """The same for spans of very frequent anchors: windows are counted one by one, spread over all tasks."""

    def windows(batches):
        for batch in batches:
            anchors, spans, leads, ns, texts = (batch.column(c).to_pylist() for c in ("anchor", "span", "lead", "n", "bytes"))
            out = [(a, s, i, d[:8], d[8:]) for a, s, lead, n, t in zip(anchors, spans, leads, ns, texts)
                   for i in range(n) for d in [xxhash.xxh3_128_digest(t[i : i + width], lead - i)]]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()),
                 pa.array(np.frombuffer(b"".join(cols[3]), np.int64)), pa.array(np.frombuffer(b"".join(cols[4]), np.int64))],
                names=["anchor", "span", "i", "x", "y"])

    each = rows.mapInArrow(windows, "anchor long, span long, i long, x long, y long")
    often = each.groupBy("x", "y").agg(F.count("*").alias("c")).filter("c > 1").select("x", "y")
    return each.join(often, ["x", "y"]).select("anchor", "span", F.col("i").alias("first"), F.col("i").alias("last"))


def repeated_ranges(docs: DataFrame, width: int = 200, hot: int = 20_000, bucket: int = 20_000) -> tuple[DataFrame, DataFrame, int]:
    """docs(doc_id, text[, carried]) with the byte ranges covered by repeated windows: (texts, ranges(key_x, key_y, a, b), spans).

    Texts have the key of their doc_id and text, for doc_id may be null or name several texts.
    """
    texts = common.with_key(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")
    every = common.materialize(spans(texts, width), "bwt-spans")
    anchors = every.groupBy("anchor").agg(F.count("*").alias("c"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    anchors = anchors.filter("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("mixed"))
    size = every.count()  # each step below has as many rows at most, and a file for every task
    again = common.materialize(common.gathered(every.join(anchors, "anchor"), size), "bwt-again")
    common.discard(every)
    classes = again.groupBy("anchor", "span").agg(
        F.count("*").alias("c"), F.first("mixed").alias("mixed"), F.min(F.struct("key_x", "key_y", "start", "n", "lead")).alias("r"))
    border = classes.filter("mixed").select("anchor", "span", "r.*")
    wanted = border.groupBy("key_x", "key_y").agg(F.collect_list(F.struct("anchor", "span", "lead", "n", "start")).alias("wanted"))
    needs = common.gathered(texts.join(wanted, ["key_x", "key_y"]).select("text", "wanted"), size)
    transforms = common.materialize(_border_texts(needs, width), "bwt-shards")
    crowded = transforms.groupBy("anchor").agg(F.count("*").alias("c")).filter(F.col("c") > hot).select("anchor")
    parts = _merged(transforms.join(crowded, "anchor", "left_anti"), width, bucket)
    parts = parts.unionByName(_counted(transforms.join(crowded, "anchor", "left_semi"), width))
    ones = again.join(parts, ["anchor", "span"]).select(
        "key_x", "key_y", (F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + width).alias("b"))
    whole = classes.filter("c > 1").select("anchor", "span")
    copies = again.join(whole, ["anchor", "span"]).select("key_x", "key_y", F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + width).alias("b"))
    return texts, ones.unionByName(copies), size


def _kept(text: bytes, ranges) -> tuple[bytes, int, int]:
    """What remains of a text, the bytes removed, and the number of maximal removed runs."""
    out, at, removed, runs = [], 0, 0, 0
    for a, b in sorted((r["a"], r["b"]) for r in ranges or ()):
        if not runs or a > at:
            out.append(text[at:a])
            runs += 1
        removed += max(0, b - max(a, at))
        at = max(at, b)
    out.append(text[at:])
    return b"".join(out), removed, runs


def remove_repeats(
    docs: DataFrame, width: int = 200, hot: int = 20_000, with_text: bool = False, carry: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, text][, ...]) for each row of docs(doc_id, text).

    Removes each byte covered by a string of `width` bytes that starts anywhere else too; strings are judged
    on the input and never cross texts.  Null and empty texts have no bytes and nothing to remove; repeated
    rows remove each other.  Texts shorter than `width` stay whole.  A row whose doc_id is null, or that of
    another text, is judged by its own text and returned too.  With `with_text` the remaining bytes are
    returned as text, a code point of which bytes were removed being dropped; `carry` names other columns of
    docs that are returned with their row.
    `hot` is the number of border spans of one anchor from which they are counted window by window.
    """
    carried = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    texts, ranges, size = repeated_ranges(docs.select("doc_id", "text", carried.alias("carried")), width, hot)
    ranges = ranges.groupBy("key_x", "key_y").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))
    joined = texts.join(ranges, ["key_x", "key_y"], "left").select("doc_id", "text", "ranges", *[F.col(f"carried.`{c}`").alias(f"__{i}") for i, c in enumerate(carry)])
    joined = common.gathered(joined, size)

    def cut(batches):
        for batch in batches:
            out = []
            for doc, text, ranges in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("ranges").to_pylist()):
                value = text.as_py()
                raw = (value or "").encode()
                kept, removed, runs = _kept(raw, ranges)
                out.append((doc, len(raw), removed, runs, hashlib.sha256(kept).hexdigest(),
                            None if value is None or not with_text else kept.decode("utf-8", "ignore")))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([*[pa.array(c, k) for c, k in zip(cols, kinds)], *[batch.column(f"__{i}") for i in range(len(carry))]],
                                             names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", *carry])

    fixed = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
    result = joined.mapInArrow(cut, T.StructType([*fixed.fields, *[docs.schema[c] for c in carry]]))
    return result if with_text else result.drop("text")
