"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector is rotated by a random orthogonal matrix and keeps only the signs, packed into bits, besides its
length and the inner product of its unit vector with the code's.  From these the inner product with a query
is estimated without bias; its error is at most length * query length * sqrt((1 - c * c) / (c * c)) *
`bound` / sqrt(d - 1) with a probability that `bound` sets (3: all but some thousandths).  Vectors whose
upper bound reaches the query's k-th best score so far are reranked by exact inner products.

Vectors are packed into blocks where they are read; queries in groups of fixed size meet the blocks one at
a time, so a task holds one group's best rows and one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm import common


def rotation(d: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, the same for equal d and seed."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths, and inner products of unit vectors with their codes; numbers of any size."""
    unit, length = _scaled(vectors)
    turned = unit.astype(np.float32) @ rotation(vectors.shape[1])
    inner = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned > 0, axis=1), length, np.maximum(inner, 1e-6)


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and lengths; a length beyond the largest double is infinite, its unit vector is not."""
    most = np.abs(vectors).max(axis=1)
    small = vectors / most[:, None]
    length = np.linalg.norm(small, axis=1)
    with np.errstate(over="ignore"):
        return small / length[:, None], length * most


def estimate(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, inner: np.ndarray, bound: float):
    """Estimated inner products of each query with each coded vector, and their error bounds.

    Where one is beyond the largest double, the estimate is 0 and the bound infinite.
    """
    d = queries.shape[1]
    unit, size = _scaled(queries)
    turned = unit.astype(np.float32) @ rotation(d)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * 2 - 1
    spread = np.sqrt(np.maximum(1 - inner**2, 0)) / inner * bound / np.sqrt(max(d - 1, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        scale = size[:, None] * length[None, :]
        about, error = (turned @ signs.T) * (scale / (inner * np.sqrt(d))[None, :]), scale * spread[None, :]
    known = np.isfinite(about) & np.isfinite(error)
    return np.where(known, about, 0.0), np.where(known, error, np.inf)


def _packed(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` vectors of one dimension; unusable vectors take no part."""

    def pack(batches):
        for batch in batches:
            ids, rows = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("embedding").to_pylist()
            by_size: dict[int, list[int]] = {}
            for i, row in enumerate(rows):
                by_size.setdefault(len(row), []).append(i)
            for d, places in by_size.items():
                for a in range(0, len(places), size):
                    part = places[a : a + size]
                    block = np.array([rows[i] for i in part], np.float64)
                    codes, length, inner = encode(block)
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in (
                        (d, pa.int32()), (len(part), pa.int32()), (ids[part].astype("<i8").tobytes(), pa.binary()), (block.tobytes(), pa.binary()),
                        (codes.tobytes(), pa.binary()), (length.tobytes(), pa.binary()), (inner.tobytes(), pa.binary()))],
                        names=["d", "n", "ids", "vectors", "codes", "length", "inner"])

    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = clean.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return clean.mapInArrow(pack, "d int, n int, ids binary, vectors binary, codes binary, length binary, inner binary")


class Search:
    """The best k of a group of queries over blocks that come one by one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, bound: float):
        self.ids, self.vectors, self.k, self.bound = ids, vectors, k, bound
        self.hit, self.score = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)  # the k-th best score so far
        self.reranked = 0

    def add(self, ids, vectors, codes, length, inner):
        about, error = estimate(self.vectors, codes, length, inner, self.bound)
        likely = min(2 * self.k, len(ids))  # exact scores of the likeliest set the bar for the others
        first = np.argpartition(-about, likely - 1, axis=1)[:, :likely]
        upper = about + error
        np.put_along_axis(upper, first, np.nan, axis=1)
        for q, seeds in enumerate(first):
            self._rerank(q, seeds, ids, vectors)
            self._rerank(q, np.flatnonzero(upper[q] >= self.floor[q]), ids, vectors)

    def _rerank(self, q, v, ids, vectors):
        self.reranked += len(v)
        with np.errstate(over="ignore", invalid="ignore"):
            score = np.einsum("ij,j->i", vectors[v], self.vectors[q])
        score = np.where(np.isnan(score), -np.inf, score)
        good = (score >= self.floor[q]) & (ids[v] != self.ids[q])
        if not good.any():
            return
        hit, score = np.append(self.hit[q], ids[v[good]]), np.append(self.score[q], score[good])
        order = np.lexsort((hit, -score))  # highest score, then smallest id
        hit, score = hit[order], score[order]
        once = np.sort(np.unique(hit, return_index=True)[1])[: self.k]
        self.hit[q], self.score[q] = hit[once], score[once]
        if len(once) == self.k:
            self.floor[q] = score[once[-1]]


def _load(row: dict, codes: bool):
    n, d = row["n"], row["d"]
    out = [np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vectors"], np.float64).reshape(n, d)]
    if codes:
        out += [np.frombuffer(row["codes"], np.uint8).reshape(n, -1), np.frombuffer(row["length"]), np.frombuffer(row["inner"])]
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, bound: float = 3.0, group: int = 1024, block: int = 4096, slices: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors(vec_id, embedding) for each row of queries, by inner product.

    Nearest first, equal scores by smaller vec_id; a query is no candidate of its own vec_id; with fewer
    than k candidates all are returned.  Vectors that are null, empty or zero, or that hold a null or a
    number that is not finite, take no part on either side, nor do those without vec_id; vectors of another
    dimension are no candidates.  Numbers may be of any size; a product beyond the largest double is infinite,
    one that is no number counts as the least.  Repeated queries count once, and of repeated candidates the best one.
    """
    data = common.materialize(_packed(vectors, block), "code-blocks")
    asked = common.materialize(_packed(queries.dropDuplicates(["vec_id"]), group), "code-queries")
    asked = asked.withColumn("grp", F.xxhash64("ids", "d"))
    spread = asked.select("grp", "d", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    part = F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")
    data = data.withColumn("slice", part).join(spread, ["d", "slice"]).withColumn("kind", F.lit(1))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumn("kind", F.lit(0))
    rows = data.unionByName(asked).withColumn("task", F.xxhash64("grp", "slice"))

    def search(batches):
        now, state = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["task"] != now:
                    if state is not None:
                        yield _result(state)
                    now, state = row["task"], Search(*_load(row, False), k, bound)
                else:
                    state.add(*_load(row, True))
        if state is not None:
            yield _result(state)

    def _result(s):
        found = [np.concatenate(x) for x in (s.hit, s.score)]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(s.ids, list(map(len, s.hit)))), *map(pa.array, found)], names=["query_id", "vec_id", "score"])

    rows = rows.select("task", "kind", "d", "n", "ids", "vectors", "codes", "length", "inner")
    found = rows.repartition("task").sortWithinPartitions("task", "kind").mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
