"""Token ids in files of shuffled planes.

A file holds the ids of a run of documents in ascending doc_id order, cut into blocks of a fixed number of
ids.  A block is transposed into byte planes (all lowest bytes, then all second bytes, ...) or bit planes,
and each plane is compressed with zstandard by itself, so the planes of high bytes almost vanish.

Layout: magic and kind of planes (8 bytes); planes, block after block; zstandard-compressed document table
(ids as 64-bit integers, null flags, numbers of tokens); chunk index (for each block: file position, first
id, number of ids, the sizes of its planes); position and length of table and index (4 x 8 bytes).
All integers are little-endian.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.files import new_file, open_file
from tracemill.llm.tokens import encoded

MAGIC = {"byte": b"IDPLANE1", "bit": b"IDPLANE2"}
PLANES = {"byte": 4, "bit": 32}


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], count: int, kind: str) -> np.ndarray:
    if kind == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=count, bitorder="little") for p in planes], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u4").reshape(-1)


class PlaneWriter:
    """Writes blocks to a stream as ids come; holds less than one block and what one call brings."""

    def __init__(self, out, block: int, kind: str, level: int):
        self.out, self.block, self.kind = out, block, kind
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held, self.first, self.index = [], 0, 0, []
        self.docs, self.nulls, self.sizes = [], [], []
        self.at = self._put(MAGIC[kind], 0)

    def _put(self, data: bytes, at: int) -> int:
        self.out.write(data)
        return at + len(data)

    def _flush(self, every: bool):
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        whole = len(ids) if every else len(ids) // self.block * self.block
        for a in range(0, whole, self.block):
            part = ids[a : min(a + self.block, whole)]
            packed = [self.pack(p) for p in to_planes(part, self.kind)]
            self.index.append([self.at, self.first, len(part), *map(len, packed)])
            self.at, self.first = self._put(b"".join(packed), self.at), self.first + len(part)
        self.held, self.n_held = [ids[whole:]], len(ids) - whole

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def close(self) -> int:
        """Write what is left, the tables and their places; gives the number of ids."""
        if self.n_held:
            self._flush(True)
        table = self.pack(np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, np.uint8).tobytes() + np.array(self.sizes, "<i8").tobytes())
        index = np.array(self.index, "<i8").tobytes()
        self._put(table + index + np.array([self.at, len(table), self.at + len(table), len(index)], "<i8").tobytes(), self.at)
        return self.first


def read_planes(source):
    """(document ids, null flags, sizes, iterator of id blocks) of a file opened for reading."""
    kind = {v: k for k, v in MAGIC.items()}[source.read(8)]
    source.seek(-32, 2)
    table_at, table_size, index_at, index_size = np.frombuffer(source.read(32), "<i8").tolist()
    unpack = zstandard.ZstdDecompressor()
    source.seek(table_at)
    table = unpack.decompress(source.read(table_size))
    n = len(table) // 17
    docs, nulls, sizes = np.frombuffer(table[: 8 * n], "<i8"), np.frombuffer(table[8 * n : 9 * n], np.uint8), np.frombuffer(table[9 * n :], "<i8")
    source.seek(index_at)
    index = np.frombuffer(source.read(index_size), "<i8").reshape(-1, 3 + PLANES[kind])

    def blocks():
        for at, _, count, *lengths in index.tolist():
            source.seek(at)
            data, edges = source.read(sum(lengths)), np.cumsum([0, *lengths]).tolist()
            yield from_planes([unpack.decompress(data[a:b]) for a, b in zip(edges, edges[1:])], count, kind)

    return docs, nulls.astype(bool), sizes, blocks()


def write_ids(docs: DataFrame, tokenizer: str, end_id: int, folder: str, block: int = 1 << 16, kind: str = "byte", level: int = 3) -> DataFrame:
    """Write docs(doc_id, text) as plane files; (part, path, n_ids) for each file, parts in ascending doc_id order.

    Null text is empty and has the end id only; rows with null doc_id come first; repeated rows are written
    as often as they come.  The order is made by a range partitioning that Spark samples, one file for each
    part.  An empty table makes no file.
    """

    def write(batches):
        part, writer = TaskContext.get().partitionId(), None
        with new_file(folder, ".ids") as (out, path):
            for batch, first, texts in encoded(batches, tokenizer):
                writer = writer or PlaneWriter(out, block, kind, level)
                for doc, ids in zip(batch.column("doc_id").slice(first, len(texts)).to_pylist(), texts):
                    writer.add(doc, np.append(ids, np.uint32(end_id)).astype(np.uint32))
            n = writer.close() if writer else 0
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * bool(writer), pa.int32()), pa.array([path] * bool(writer), pa.string()), pa.array([n] * bool(writer), pa.int64())],
            names=["part", "path", "n_ids"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return common.materialize(ordered.mapInArrow(write, "part int, path string, n_ids long"), "plane-manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files of a manifest."""
    start = F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row for each file
    files = manifest.withColumn("start", F.coalesce(start, F.lit(0))).select("path", "start")

    def read(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_file(path) as source:
                    docs, nulls, sizes, blocks = read_planes(source)
                    sums, row, left, crc = [], 0, int(sizes[0]), 0
                    for ids in blocks:
                        raw, at = memoryview(ids.tobytes()), 0
                        while at < len(ids):
                            n = min(left, len(ids) - at)
                            crc, at, left = zlib.crc32(raw[4 * at : 4 * (at + n)], crc), at + n, left - n
                            if not left:
                                sums.append(crc)
                                row, crc = row + 1, 0
                                left = int(sizes[row]) if row < len(sizes) else -1
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs, pa.int64(), mask=nulls), pa.array(start + np.cumsum(sizes) - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, so that files are not put together in one task
    return files.repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
