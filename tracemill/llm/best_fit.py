"""Pack tokenised documents into sequences of fixed capacity by bulk-synchronous best fit.

Documents are range-sorted by length and sequences by gap.  Documents of one length are interchangeable, as
are sequences with one gap, so a round handles a whole length at once, the longest first: it sweeps the
gaps from the successor of the length upward, gives each sequence of the smallest gap as many documents as
fit, in the order of the documents' ranks, updates the gaps and, when no gap is left, opens sequences.  That
is best fit in decreasing order, in at most `capacity` rounds however many documents there are.  The rounds
run over the histogram of lengths (at most `capacity` rows); ranks are dealt and looked up by all tasks.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.tokens import encoded

SALTS = 64


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Documents as ids and end_id, those above the capacity cut from the back: (doc_id, piece, start, length, ids_crc32[, ids])."""

    def cut(batches):
        for batch, first, texts in encoded(batches, tokenizer):
            rows, docs_of = [], batch.column("doc_id").slice(first, len(texts)).to_pylist()
            for doc, ids in zip(docs_of, texts):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                head = len(ids) % capacity or capacity
                edges = [0, *range(head, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ids[a:b].tobytes() if with_ids else None)
                         for k, (a, b) in enumerate(zip(edges, edges[1:]))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rounds of best fit over a histogram of lengths: (length, from rank, documents, per sequence, first sequence, offset).

    The documents of a row go, by rank and `per sequence` at a time, to consecutive sequences from `first
    sequence` on, the first of each at `offset`.
    """
    gaps: list[int] = []
    open_runs: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, sequences)
    out, opened = [], 0

    def add(gap, first, n):
        if gap > 0 and n > 0:
            if gap not in open_runs:
                bisect.insort(gaps, gap)
            open_runs.setdefault(gap, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = open_runs[gap].pop(0)
                if not open_runs[gap]:
                    del open_runs[gap], gaps[at]
            else:
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, each, first, capacity - gap))
                add(gap - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                rest = min(left, each - 1)  # fewer than one more sequence takes
                if rest:
                    out.append((length, rank, rest, rest, first + full, capacity - gap))
                    rank, left = rank + rest, left - rest
                    add(gap - rest * length, first + full, 1)
                    full += 1
                add(gap, first + full, n - full)
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) for each piece of docs(doc_id, text).

    Null and empty texts are one piece of the end id.  Texts of any length are cut and packed whole; repeated
    rows are packed each by itself; a null doc_id is kept.  Equal lengths are dealt in the order of a hash of
    doc_id and piece.  An empty table gives no pieces; other columns are not read.
    """
    cut = pieces(docs, tokenizer, capacity, end_id, with_ids)
    cut = common.materialize(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "fit-pieces")
    counts = common.materialize(cut.groupBy("length", "salt").agg(F.count("*").alias("n")), "fit-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    rounds = sweep(histogram, capacity)
    runs = docs.sparkSession.createDataFrame(rounds, "length long, begin long, n long, each long, first long, offset long")
    runs = runs.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("begin", "n", "each", "first", "offset"))).alias("runs"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")
    classes = counts.withColumn("before", before).join(runs, "length").select("length", "salt", "before", "runs")
    rank = F.row_number().over(W.partitionBy("length", "salt").orderBy(F.xxhash64("piece", "doc_id"), "doc_id", "piece")) - 1
    placed = cut.withColumn("rank", rank).join(classes, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    run = F.filter("runs", lambda r: (r["begin"] <= F.col("rank")) & (F.col("rank") < r["begin"] + r["n"]))[0]
    placed = placed.withColumn("run", run).withColumn("k", F.col("rank") - F.col("run.begin"))
    out = placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.first") + F.floor(F.col("k") / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.offset") + F.col("k") % F.col("run.each") * F.col("length")).cast("long").alias("offset"), "ids")
    return common.gathered(out if with_ids else out.drop("ids"), sum(histogram.values()))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, doc_ids, ids) of packed pieces with ids: little-endian unsigned 32-bit ids, back to back."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))  # at most `capacity` pieces each
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), joined.alias("ids"))
