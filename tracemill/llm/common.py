"""Helpers shared by the operators: shared folders, materialised steps, sorted groups, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

#: Bytes of texts that are looked at together; only a single text may have more.
CHUNK = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; an own temporary folder only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gathered(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """df of about `rows` rows in no more tasks than they fill, but one a core; fewer stay as they are.

    Shuffles deal any step into spark.sql.shuffle.partitions; steps far smaller than the input need not start
    as many tasks.  Rows of one key stay together.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised step that nothing reads any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def with_key(df: DataFrame, *columns: str) -> DataFrame:
    """df with `key_x` and `key_y`, never null: a 128-bit hash of the columns, nulls included.

    It names a row where doc_id is null or names several rows; rows with one key are alike in the columns.
    """
    nulls = F.concat(*[F.isnull(c).cast("string") for c in columns])  # xxhash64 passes nulls over
    return df.withColumns({k: F.xxhash64(F.lit(i), nulls, *columns) for i, k in enumerate(("key_x", "key_y"))})


def sorted_groups(batches, key: str):
    """Arrow tables, one for each run of equal values of an integer column; groups may span batches.

    Holds one group at a time, so callers bound the size of a group.
    """
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        keys = rows[key].to_numpy()
        if held and last != keys[0]:
            yield pa.concat_tables(held)
            held = []
        start = 0
        for cut in np.flatnonzero(keys[1:] != keys[:-1]) + 1:
            yield pa.concat_tables([*held, rows.slice(start, cut - start)])
            held, start = [], cut
        held.append(rows.slice(start))
        last = keys[-1]
    if held:
        yield pa.concat_tables(held)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (from 0) of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batch, text: str = "text", limit: int = CHUNK):
    """(first row, last row, bytes, offsets) of whole texts; a chunk exceeds the limit only by its last text."""
    data, at = string_bytes(batch.column(text))
    first = 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


_RANDOM = np.random.default_rng(20240229)
BYTE_CODES = _RANDOM.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_GAP = np.zeros(256, bool)
IS_GAP[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {}


def _cumulative(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64.

    Those of a chunk are kept between calls; more, for a longer text, are not, as workers outlive their tasks.
    """
    if n > CHUNK + 1:
        return _cumulative(_BASE, n), _cumulative(_INVERSE, n)
    if not _powers:
        _powers.update(up=_cumulative(_BASE, CHUNK + 1), down=_cumulative(_INVERSE, CHUNK + 1))
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, A-Z lower-cased, and per text the index of its first word (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~IS_GAP[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[LOWER[data]] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one text after the other, and where each text begins.

    A shingle is `size` words in a row; a text of fewer words has the whole sequence as its only one.
    """
    words, first = word_hashes(data, at)
    hashed = words.copy()
    for step in range(1, size):
        hashed[: len(words) - step] = mix(hashed[: len(words) - step] * np.uint64(_BASE) + words[step:]) if len(words) > step else 0
    sets, begin = [], [0]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            own = np.unique(hashed[a : b - size + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = mix(np.array([whole], np.uint64) * np.uint64(_BASE) + w)[0]
            own = np.array([whole], np.uint64)
        else:
            own = words[:0]
        sets.append(own)
        begin.append(begin[-1] + len(own))
    return np.concatenate(sets) if sets else words[:0], np.array(begin)


def _local_stars(batches):
    """Contract the edges of one task's batches: each vertex points to the smallest of its group there."""
    for batch in batches:
        a, b = batch.column("u").to_pylist(), batch.column("v").to_pylist()
        up: dict[int, int] = {}

        def root(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for x, y in zip(a, b):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", prefix: str = "links") -> DataFrame:
    """(id, component): smallest id reachable over undirected edges, for every id that has an edge.

    Contracts the edges of each Arrow batch, then alternates two star contractions until every id points
    to a root; each round is materialised, and the edges are before the first one: where Python makes them,
    a task that also contracted them would hold two workers, which executors keep for all later steps.  Minima
    are aggregated before the shuffle, and the joins that follow can be split where one id has most edges.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v")
    old = materialize(e, prefix)
    e = materialize(gathered(old, old.count()).mapInArrow(_local_stars, "u long, v long"), prefix)
    discard(old)
    while True:
        rows = e.count()
        e = gathered(e, rows)
        ends = e.select(F.col("u").alias("id"), F.col("v").alias("to"), F.lit(0).alias("root"))
        ends = ends.unionByName(e.select(F.col("v").alias("id"), F.lit(None).cast("long").alias("to"), F.lit(1).alias("root")))
        ends = gathered(ends.groupBy("id").agg(F.min("to").alias("low"), F.max("to").alias("high"), F.max("root").alias("root")), 2 * rows)
        if ends.filter("low <> high or (low is not null and root = 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        far = gathered(both.join(least, "u"), 2 * rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = far.groupBy("u").agg(F.min("v").alias("m"))
        near = gathered(far.join(least, "u"), rows).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        near = near.unionByName(gathered(least, rows).select("u", F.col("m").alias("v")))
        old, e = e, materialize(near.mapInArrow(_local_stars, "u long, v long"), prefix)
        discard(old)
    e = gathered(e.distinct(), rows)
    roots = gathered(e.select("v").distinct(), rows).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
