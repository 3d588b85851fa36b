"""Quality of texts by compression: which of two zstandard dictionaries, of good or of bad text, helps more.

A text is compressed in blocks of `block` bytes with either dictionary; the bytes that the good one saves over
the bad one, for each byte of text, are its difference.  Text that repeats itself needs no dictionary and
has none.  A logistic curve, fitted on labelled rows that are in neither dictionary, makes the difference a
probability of label 1.

The model is fitted on a bounded sample of labelled rows, the same on each run: the `per_class` rows of each
label that come first by a hash of doc_id, of each at most `piece` characters in 8 places over the whole text,
and `calibrate` other rows, whole.  Lines that are in both samples are left out, as they tell nothing.  All rows
are scored, over their whole texts.

Rows and results
* learned from: rows with a doc_id that is not held out and labels that agree on 0 or 1; of texts of one
  doc_id the least.  Without text of both labels every score is the share of label 1, smoothed.
* a null text counts as empty, its difference is 0; a null doc_id is not held out and not learned from;
  repeated rows are scored each; an empty table gives no row.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

LEVEL = 3
PLACES = 8


@dataclass(frozen=True)
class Model:
    """Dictionaries, block size and curve; `unit` is the spread of the differences it was fitted on."""

    good: bytes
    bad: bytes
    block: int
    slope: float
    start: float
    unit: float

    def probability(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference / self.unit + self.start, -30, 30)))


def held_out(doc_id: str | Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of texts; where they are too few to train one, their last bytes are it."""
    size = min(size, sum(map(len, texts)) // 8)
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[-max(size, 1 << 10) :]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(content)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)


def _differences(good: bytes, bad: bytes, block: int, batches):
    """(batch, difference of each row) of batches with a column text."""
    good, bad = _compressor(good), _compressor(bad)
    for batch in batches:
        data, at = common.string_bytes(batch.column("text"))
        whole, at = memoryview(data), at.tolist()
        out = np.zeros(len(at) - 1)
        for k, (a, b) in enumerate(zip(at, at[1:])):
            saved = 0
            for x in range(a, b, block):
                part = whole[x : min(x + block, b)]
                saved += len(bad.compress(part)) - len(good.compress(part))
            out[k] = saved / max(b - a, 1)
        yield batch, out


def _curve(x: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Slope, start and unit of the logistic curve of labels over x, by Newton's method with smoothed targets."""
    ones = label.sum()
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    unit = float(x.std()) or 1.0
    rows, w = np.c_[x / unit, np.ones(len(x))], np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), rows.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
    return float(w[0]), float(w[1]), unit


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, calibrate: int = 3000, piece: int = 8192,
        size: int = 1 << 18, block: int = 512) -> Model:
    """Model of the labelled rows that are not held out; at most 2 * per_class + calibrate rows are read."""
    known = labels.select(F.col("doc_id").cast("long"), "quality").filter(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
    known = known.filter("label = other and label in (0, 1)").select("doc_id", "label", F.xxhash64("doc_id", F.lit(12)).alias("turn"))
    known = common.materialize(known, "labels")
    learn = [known.filter(f"label = {c} and turn % 2 = 0").orderBy("turn", "doc_id").limit(per_class) for c in (0, 1)]
    picked = learn[0].unionByName(learn[1]).withColumn("use", F.lit("learn")).unionByName(
        known.filter("turn % 2 <> 0").orderBy("turn", "doc_id").limit(calibrate).withColumn("use", F.lit("fit")))
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("text <> ''")
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label", "turn", "use").agg(F.min("text").alias("text"))
    sample = common.materialize(sample, "sample")

    step = F.expr(f"(length(text) - {piece // PLACES}) / {PLACES - 1}")
    places = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda k: F.substring("text", (k * step).cast("int") + 1, F.lit(piece // PLACES)))
    short = F.when(F.length("text") <= piece, F.col("text")).otherwise(F.concat_ws("\n", places))
    lines = {0: [], 1: []}
    for r in sample.filter("use = 'learn'").select("label", "turn", short.alias("text")).orderBy("turn").collect():
        lines[r.label].append(r.text.split("\n"))
    both = set().union(*lines[0]) & set().union(*lines[1])
    content = []
    for c in (0, 1):
        kept = ["\n".join(x for x in text if x not in both).encode() for text in lines[c]]
        content.append(dictionary([t[a : a + 1024] for t in kept for a in range(0, len(t), 1024)], size))
    bad, good = content
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if not good or not bad:
        return Model(b"", b"", block, 0.0, float(np.log(share / (1 - share))), 1.0)

    def differences(batches):
        for batch, out in _differences(good, bad, block, batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("doc_id"), pa.array(out)], names=["label", "doc_id", "x"])

    seen = sample.filter("use = 'fit'").select("label", "doc_id", "text").mapInArrow(differences, "label int, doc_id long, x double")
    seen = seen.orderBy("doc_id").toPandas()
    slope, start, unit = _curve(seen["x"].to_numpy(), seen["label"].to_numpy()) if len(seen) else (0.0, float(np.log(share / (1 - share))), 1.0)
    return Model(good, bad, block, slope, start, unit)


def score(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def scores(batches):
        if not model.good:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(np.zeros(batch.num_rows)))], names=["doc_id", "score"])
            return
        for batch, out in _differences(model.good, model.bad, model.block, batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(out))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scores, "doc_id long, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def quality_scores(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """Fit on the labelled rows of docs, then score all of them."""
    return score(docs, fit(docs, labels, **limits))
