"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

A source's documents are dealt into blocks by a hash.  A source is taken as many whole times as its target
asks for, and blocks in permuted order fill the rest; in the block that crosses the target single documents
do.  The drawn blocks of all sources are then split among the output shards: each node of a binary tree
divides its exact numbers of blocks per source between its two children by a multivariate hypergeometric
draw, as if it dealt shuffled blocks, and each shard gets disjoint runs of the permuted blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import common
from tracemill.llm.target_ratio import words_of

WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(sid, source, source_size, target) from sizes(source, size): sources by code point, null last, share
    `share` times all sizes by repeating weights; a target stops at `most` times its source's size and the
    excess is shared again.  Sources in order of most * size / weight are capped up to a point, so one pass
    of running sums over the sources finds where the resharing ends.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("sid") % len(weights))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    up = W.orderBy(F.col("cap") / F.col("weight"), "sid")
    before, after = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    level = F.min_by("level", F.struct(F.col("cap") / F.col("weight"), "sid")).over(W.partitionBy("open"))
    target = F.when(F.col("open"), F.least(level * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    return per.select("sid", "source", "source_size", target.alias("target"))


def _split(seed: int):
    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        k = rows["k"].to_numpy(np.int64)
        draw = np.random.default_rng([seed, int(rows["node"].iloc[0])])
        left = draw.multivariate_hypergeometric(k, int(k.sum()) // 2, method="marginals")
        node = rows["node"].to_numpy()
        return pd.DataFrame({
            "node": np.concatenate([2 * node, 2 * node + 1]), "sid": np.tile(rows["sid"].to_numpy(), 2),
            "k": np.concatenate([left, k - left])})

    return split


def split_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(sid, shard, k) for 2**levels shards from quotas(sid, k): one distributed round for each tree level."""
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), F.col("sid").cast("long").alias("sid"), F.col("k").cast("long").alias("k"))
    for _ in range(levels):
        nodes = nodes.groupBy("node").applyInPandas(_split(seed), "node long, sid long, k long")
    return nodes.select("sid", (F.col("node") - 2**levels).cast("int").alias("shard"), "k")


def _fill(key: tuple[str, ...]):
    """Copies of the documents of a crossing block: what fits in hash order, then the one that comes nearest."""
    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["tie", "doc_id", "size", *key], kind="stable")
        room, more = float(rows["room"].iloc[0]), []
        for size in rows["size"].tolist():
            more.append(int(size <= room))
            room -= size * more[-1]
        closer = [(abs(size - room), i) for i, size in enumerate(rows["size"].tolist()) if not more[i] and size < 2 * room]
        if closer:
            more[min(closer)[1]] = 1
        return rows.assign(n=(rows["times"] + more).astype("int32"))

    return fill


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 20_000,
    levels: int = 4, seed: int = 17, key: tuple[str, ...] = (),
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, shards[, key]) for each row of docs(doc_id, text, source).

    size: words of the text (0 for null); taken: size times the number of copies that the mix takes, at most
    `most` (a whole number of) times; shards: the output shard of each copy.  In the block
    at the crossing, about `block_words` long, documents are taken while they fit.  Equal seeds give equal mixes; repeated rows count as
    rows of their own.  A null source is a source, the last one; a null doc_id is hashed as null.  Documents
    without words are never taken, and an empty table or one without words has targets of 0.  `key` names
    columns of docs, integers without null, that tell rows of one or no doc_id apart: they are returned, order
    such rows, and the first is hashed for a null doc_id.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), *key)
    own = F.coalesce("doc_id", *key[:1])
    d = common.materialize(d, "mix-sizes")
    sources = source_targets(d, weights, share, most)
    n = F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    sources = sources.withColumns({"n_blocks": n, "times": times})
    sources = common.materialize(sources.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size")), "mix-sources")
    named = sources.withColumnRenamed("source", "name")
    d = d.join(named, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn(
        "block", F.pmod(F.xxhash64(own, F.lit(seed)), F.col("n_blocks")))

    blocks = d.filter("size > 0").groupBy("sid", "block").agg(
        F.sum("size").alias("words"), F.first("times").alias("times"), F.first("rest").alias("rest"))
    order = W.partitionBy("sid").orderBy(F.xxhash64("sid", "block", F.lit(seed + 1)), "block")
    blocks = blocks.withColumn("rank", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order))
    blocks = blocks.withColumn("room", F.col("rest") - F.col("upto") + F.col("words"))
    state = F.when(F.col("room") <= 0, 0).when(F.col("room") >= F.col("words"), 2).otherwise(1)
    blocks = common.materialize(blocks.withColumn("state", state), "mix-blocks")

    drawn = blocks.withColumn("copies", F.col("times") + (F.col("state") > 0).cast("int"))
    held = blocks.groupBy("sid").agg(F.count("*").alias("held"))
    quotas = drawn.groupBy("sid").agg(F.sum("copies").alias("k"))
    shards = split_quotas(quotas, levels, seed)
    till = F.sum("k").over(W.partitionBy("sid").orderBy("shard"))
    places = shards.withColumn("till", till).filter("k > 0").select(
        "sid", "shard", F.explode(F.sequence(F.col("till") - F.col("k"), F.col("till") - 1)).alias("place"))
    copies = drawn.filter("copies > 0").join(held, "sid").select(
        "sid", "block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "rank", "held")
    copies = copies.select("sid", "block", "copy", (F.col("copy") * F.col("held") + F.col("rank")).cast("long").alias("place"))
    dealt = copies.join(places, ["sid", "place"]).groupBy("sid", "block").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("copy", "shard"))), lambda x: x["shard"]).alias("dealt"))
    dealt = dealt.join(blocks.select("sid", "block", "state", "room"), ["sid", "block"])

    rows = d.join(dealt, ["sid", "block"], "left").select("doc_id", "source", "size", "source_size", "target", "sid", "block", "times", "state", "room", "dealt", *key)
    crossing = rows.filter("state = 1 and size > 0").withColumn("tie", F.xxhash64(own, F.lit(seed + 2)))
    crossing = crossing.withColumn("doc_id", F.col("doc_id").cast("string"))  # pandas has no null among integers
    schema = T.StructType([*crossing.schema.fields, T.StructField("n", T.IntegerType())])
    crossing = crossing.groupBy("sid", "block").applyInPandas(_fill(key), schema).drop("tie").withColumn("doc_id", F.col("doc_id").cast("long"))
    others = rows.filter("state is null or state <> 1 or size = 0")
    others = others.withColumn("n", F.when(F.col("size") > 0, F.col("times") + (F.coalesce("state", F.lit(0)) == 2).cast("int")).otherwise(0))
    return crossing.unionByName(others).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"),
        F.coalesce(F.slice("dealt", F.lit(1), F.col("n")), F.array().cast("array<int>")).alias("shards"), *key)


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs as often as they are taken, shuffled within their output shards."""
    seed = options.get("seed", 17)
    whole = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row"))
    keyed, key = common.with_key(whole, *[f"row.`{c}`" for c in docs.columns]), ("key_x", "key_y")
    taken = mix_sources(keyed, **options, key=key).select(*key, F.explode("shards").alias("__shard"))
    rows = keyed.dropDuplicates(list(key)).join(taken, list(key))
    own = F.coalesce("doc_id", "key_x")
    part = F.pmod(F.xxhash64(own, F.lit(seed + 3)), F.lit(64))
    rows = rows.repartition("__shard", part).sortWithinPartitions("__shard", part, F.xxhash64(own, "__shard", F.lit(seed + 4)), *key)
    return rows.select("row.*")
