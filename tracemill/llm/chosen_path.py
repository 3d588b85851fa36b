"""Near-duplicate documents by a chosen-path set similarity join.

Each document becomes the set of its word shingles and a signature of minwise tokens.  A tree starts with
all distinct sets in one node; a node that is too large sends each member to the children named by two of
the member's own tokens, chosen by the node's seed, so similar sets stay together and others part.  Small
nodes are compared exhaustively on signatures; independent trees make a miss unlikely.  What remains
together is confirmed on full sets, and components are built from confirmed links only.

With similarity s two sets share a child with probability 1 - (1 - s)**2 at each level, so one tree misses
a pair of s = 0.85 with probability of about 0.03 at any depth, and `trees` trees with 0.03**trees.  The
signature test asks for `agreement` of the tokens, over six standard deviations below 0.85 for 128 tokens.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common

TOKENS = 128
HUBS = 8
_SEEDS = np.random.default_rng(7).integers(1, 2**63, TOKENS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _node(parent: np.ndarray, slot: np.ndarray, token: np.ndarray) -> np.ndarray:
    return common.mix(common.mix(parent + slot.astype(np.uint64)) ^ token.astype(np.uint64)).view(np.int64)


def document_sets(docs: DataFrame, shingle: int = 5, trees: int = 4) -> DataFrame:
    """Set size, identity, signature (full tokens and their low bytes) and first-level nodes of each document."""

    def sets(batches):
        for batch in batches:
            for first, last, data, at in common.chunks(batch):
                hashes, begin = common.shingle_sets(data, at, shingle)
                sizes = np.diff(begin)
                some = np.flatnonzero(sizes)
                tokens = np.zeros((len(sizes), TOKENS), np.uint32)
                scratch = np.empty_like(hashes)
                for t in range(TOKENS if len(some) else 0):
                    np.multiply(hashes, _SEEDS[t], out=scratch)
                    tokens[some, t] = np.minimum.reduceat(scratch, begin[some]) >> np.uint64(32)
                raw = hashes.view(np.uint8)
                keys = np.frombuffer(b"".join(
                    xxhash.xxh3_128_digest(raw[8 * a : 8 * b].data) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())
                ), np.int64).reshape(-1, 2)
                slots = np.arange(2 * trees)
                nodes = _node(slots.astype(np.uint64)[None, :] // np.uint64(2), slots[None, :], tokens[:, : 2 * trees])
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, last - first).cast(pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    pa.array([r.tobytes() for r in tokens], pa.binary()),
                    pa.array([r.tobytes() for r in tokens.astype(np.uint8)], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(nodes.reshape(-1)), 2 * trees).cast(pa.list_(pa.int64())),
                ], names=["doc_id", "n_shingles", "key_a", "key_b", "tokens", "low", "nodes"])

    schema = "doc_id long, n_shingles long, key_a long, key_b long, tokens binary, low binary, nodes array<long>"
    return docs.select("doc_id", "text").mapInArrow(sets, schema)


def _matrix(column, kind=np.uint8) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _forest(n: int, similar) -> list[tuple[int, int]]:
    """Spanning edges of the similarity graph over n members; similar(v, others) is a mask over others."""
    edges, left = [], np.arange(n)
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            v = queue.pop()
            hit = similar(v, left)
            found = left[hit]
            edges += [(v, u) for u in found]
            queue += found.tolist()
            left = left[~hit]
    return edges


def _edges(rows, cols=("a", "b")) -> pa.RecordBatch:
    a, b = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=list(cols))


def _compare_leaves(rows: DataFrame, agreement: float, size: int) -> DataFrame:
    """Candidate edges inside small nodes (node, rep, low); `size` rows in about."""
    need = int(np.ceil(agreement * TOKENS))

    def compare(batches):
        out = []
        for group in common.sorted_groups(batches, "node"):
            if group.num_rows < 2:
                continue
            reps, low = group["rep"].to_numpy(), _matrix(group["low"])
            edges = _forest(len(reps), lambda v, others: (low[others] == low[v]).sum(axis=1) >= need)
            out += [(int(reps[x]), int(reps[y])) for x, y in edges]
            if len(out) > 50_000:
                yield _edges(out)
                out = []
        yield _edges(out)

    rows = common.gathered(rows.repartition("node"), size)
    return rows.sortWithinPartitions("node").mapInArrow(compare, "a long, b long")


def _hub_masks(rows: DataFrame, agreement: float) -> DataFrame:
    """For members of large nodes (node, rep, low, hubs, hub_lows): which of the node's hubs they resemble, as bits."""
    need = int(np.ceil(agreement * TOKENS))

    def compare(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                low, hubs = _matrix(part.column("low")), _matrix(part.column("hub_lows")).reshape(part.num_rows, -1, TOKENS)
                same = np.count_nonzero(hubs == low[:, None, :], axis=2) >= need
                mask = (same << np.arange(same.shape[1])).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("rep"), part.column("hubs"), pa.array(mask)], names=["node", "rep", "hubs", "mask"])

    return rows.mapInArrow(compare, "node long, rep long, hubs array<long>, mask int")


def _with_hubs(large: DataFrame, low: DataFrame, agreement: float, size: int) -> DataFrame:
    """(node, rep, hubs, mask) of `size` members of large nodes; a node's hubs are HUBS of its members by hash."""
    picks = large.groupBy("node").agg(*[F.min_by("rep", F.xxhash64("node", "rep", F.lit(i))).alias(f"h{i}") for i in range(HUBS)])
    picks = common.gathered(picks, size).select("node", F.posexplode(F.array(*[f"h{i}" for i in range(HUBS)])).alias("i", "rep"))
    picks = common.gathered(common.gathered(picks.join(low, "rep"), size).dropDuplicates(["node", "i"]), size)  # of repeated rows
    picks = picks.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("i", "rep", "low"))).alias("h"))  # HUBS rows each
    joined = F.aggregate("h", F.lit(b""), lambda acc, x: F.concat(acc, x["low"]))
    picks = picks.select("node", F.transform("h", lambda x: x["rep"]).alias("hubs"), joined.alias("hub_lows"))
    members = common.gathered(large.join(low, "rep"), size).join(picks, "node")
    return _hub_masks(common.gathered(members, size).select("node", "rep", "low", "hubs", "hub_lows"), agreement)


def _hub_groups(near: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Of `size` members: edges of members to a hub they resemble, and between hubs that one member resembles; and per node its main
    group of hubs (as bits), reached from the commonest mask, with the numbers of members like and unlike it."""
    hit = F.filter("hubs", lambda h, i: F.get(F.reverse(F.split(F.lpad(F.bin("mask"), HUBS, "0"), "")), i) == "1")
    masks = near.groupBy("node", "mask").agg(F.count("*").alias("n"), F.first("hubs").alias("hubs"))
    masks = common.materialize(common.gathered(masks, size), "path-masks")  # 2**HUBS rows of a node at most
    links = near.filter("mask <> 0").select(F.get(hit, 0).alias("a"), F.col("rep").alias("b")).filter("a <> b")
    joint = masks.filter("mask <> 0").select(hit.alias("hit")).select(F.get("hit", 0).alias("a"), F.explode("hit").alias("b")).filter("a <> b")
    start = F.max_by(F.col("mask"), F.when(F.col("mask") != 0, F.struct("n", "mask")))
    nodes = masks.groupBy("node").agg(start.alias("main"), F.collect_list(F.struct("mask", "n")).alias("masks"))
    nodes = common.gathered(nodes, size)
    meets = lambda m, x: m.bitwiseAND(x["mask"]) != 0
    grown = F.aggregate(F.sequence(F.lit(1), F.lit(HUBS)), F.col("main"), lambda m, _: F.aggregate(
        "masks", m, lambda acc, x: F.when(meets(acc, x), acc.bitwiseOR(x["mask"])).otherwise(acc)))
    total = lambda test: F.aggregate("masks", F.lit(0).cast("long"), lambda acc, x: acc + F.when(test(x), x["n"]).otherwise(F.lit(0).cast("long")))
    nodes = nodes.withColumn("main", grown)
    like = total(lambda x: meets(F.col("main"), x))
    nodes = nodes.select("node", "main", like.alias("alike"), (total(lambda x: F.lit(True)) - like).alias("unlike"))
    return links.unionByName(joint), nodes


def _children(rows: DataFrame) -> DataFrame:
    """Two children of each (node, rep, tokens), by two tokens that the node chooses."""

    def split(batches):
        for batch in batches:
            node, tokens = batch.column("node").to_numpy().view(np.uint64), _matrix(batch.column("tokens"), np.uint32)
            seeds = common.mix(node ^ np.uint64(0xA5A5A5A5))
            one = (seeds % np.uint64(TOKENS)).astype(np.int64)
            two = (one + 1 + ((seeds >> np.uint64(32)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
            at = np.arange(len(node))
            for slot in (one, two):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_node(node, slot, tokens[at, slot])), batch.column("rep")], names=["node", "rep"])

    return rows.mapInArrow(split, "node long, rep long")


def _blocks(rows: DataFrame, sizes: DataFrame, key: str, cap: int) -> DataFrame:
    """Rows of groups of any size as bounded groups: every pair of rows of a group meets in one of them.

    A group beyond `cap` is cut into blocks, and a row goes to each pair of blocks that has its own.
    """
    parts = F.ceil(F.col("size") / F.lit(cap / 2)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")
    return (
        rows.join(sizes, key)
        .withColumn("parts", F.when(F.col("size") <= cap, 1).otherwise(parts)).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .filter((F.col("parts") == 1) | (F.col("other") != F.col("own")))
        .withColumn("grp", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")))
        .drop("parts", "own", "other", "size")
    )


def _minor_blocks(members: DataFrame, leaf: int) -> DataFrame:
    """Members outside their node's main group, against all members of the node, in bounded groups."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("alike") / F.lit(leaf))).cast("int")
    rows = members.withColumn("parts", parts)
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts")).cast("int")
    spread = F.when(F.col("linked"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.select("node", "rep", F.explode(spread).alias("part")).select(F.xxhash64("node", "part").alias("node"), "rep")


def candidate_edges(sets: DataFrame, leaf: int, agreement: float, depth: int) -> DataFrame:
    """Edges over distinct sets that connect any two of similar signatures, directly or through others.

    All members of a node of more than `leaf` are compared with HUBS of them.  Hubs that one member resembles
    are connected through it.  When few members are unlike the main group of connected hubs, these are
    compared with every member in blocks, and the node is done, for the others are connected through the
    hubs; else all members go on to the node's children.
    """
    reps = sets.filter("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"), F.first("nodes").alias("nodes"))
    reps = common.gathered(reps, sets.count())
    rows = common.materialize(reps.select(F.explode("nodes").alias("node"), "rep"), "path-nodes")
    low, tokens = (sets.select(F.col("doc_id").alias("rep"), c) for c in ("low", "tokens"))
    out = None
    for level in range(depth + 1):
        count = rows.count()
        sizes = common.gathered(rows.groupBy("node").agg(F.count("*").alias("size")), count)
        old, rows = rows, common.materialize(common.gathered(rows.join(sizes.filter("size > 1"), "node"), count), "path-nodes")
        common.discard(old)
        count = rows.count()
        groups = rows.filter(F.col("size") <= leaf).select("node", "rep")
        large = rows.filter(F.col("size") > leaf).select("node", "rep")
        many = None
        if not large.isEmpty():
            near = common.materialize(_with_hubs(large, low, agreement, count), "path-hubs")
            links, nodes = _hub_groups(near, count)
            out = links if out is None else out.unionByName(links)
            few = nodes.filter(F.col("unlike").between(1, 4 * leaf)).select("node", "main", "alike")
            linked = (F.col("mask").bitwiseAND(F.col("main")) != 0).alias("linked")
            minor = near.join(few, "node").select("node", "rep", linked, "alike")
            groups = groups.unionByName(_minor_blocks(minor, 2 * leaf))
            many = nodes.filter(F.col("unlike") > 4 * leaf).select("node", (F.col("alike") + F.col("unlike")).alias("size"))
            rest = near.select("node", "rep")
            if level == depth:
                groups = groups.unionByName(_blocks(rest, many, "node", 4 * leaf).select(F.col("grp").alias("node"), "rep"))
        edges = _compare_leaves(common.gathered(groups.join(low, "rep"), count).select("node", "rep", "low"), agreement, count)
        out = edges if out is None else out.unionByName(edges)
        if many is None or level == depth or many.isEmpty():
            return out
        rows = _children(common.gathered(rest.join(many, "node").join(tokens, "rep"), count).select("node", "rep", "tokens"))
        rows = common.materialize(rows, "path-nodes")


def _confirm(rows: DataFrame, shingle: int, part: int, whole: int, size: int) -> DataFrame:
    """Edges between about `size` members (grp, rep, text) whose full sets have part * intersection >= whole * union."""

    def compare(batches):
        for group in common.sorted_groups(batches, "grp"):
            ids, first = np.unique(group["rep"].to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            hashes, begin = common.shingle_sets(*common.string_bytes(group["text"].take(pa.array(first))), shingle)
            sizes = np.diff(begin)
            values, places = np.unique(hashes, return_inverse=True)
            marked = np.zeros(len(values), bool)

            def similar(v, others):
                marked[places[begin[v] : begin[v + 1]]] = True
                near = np.minimum(sizes[others], sizes[v]) * part >= np.maximum(sizes[others], sizes[v]) * whole
                hit = np.zeros(len(others), bool)
                tried = others[near]
                if len(tried):
                    if 8 * len(tried) > len(sizes):
                        both = np.add.reduceat(marked[places], begin[:-1], dtype=np.int64)[tried]
                    else:
                        span = np.concatenate([places[begin[u] : begin[u + 1]] for u in tried])
                        both = np.add.reduceat(marked[span], np.concatenate([[0], np.cumsum(sizes[tried])[:-1]]), dtype=np.int64)
                    hit[near] = part * both >= whole * (sizes[tried] + sizes[v] - both)
                marked[places[begin[v] : begin[v + 1]]] = False
                return hit

            yield _edges([(int(ids[x]), int(ids[y])) for x, y in _forest(len(ids), similar)])

    rows = common.gathered(rows.repartition("grp"), size, 2_000)
    return rows.sortWithinPartitions("grp").mapInArrow(compare, "a long, b long")


def _confirmed(near: DataFrame, texts: DataFrame, shingle: int, part: int, whole: int, cap: int, hubs: int = 64) -> DataFrame:
    """Confirmed edges that span the links inside each candidate component of near(rep, comp).

    Components of up to `cap` members are compared at once.  A larger one is first cut into chunks that all
    hold about `hubs` common members, which connect most of it; who is outside its largest confirmed part
    then is compared with every member, in blocks.
    """

    count = near.count()

    def confirm(groups):
        found = common.gathered(groups.hint("merge").join(texts, "rep"), count, 2_000)
        return _confirm(found.select("grp", "rep", "text"), shingle, part, whole, count)

    sized = common.gathered(near.join(common.gathered(near.groupBy("comp").agg(F.count("*").alias("size")), count), "comp"), count)
    small = sized.filter(F.col("size") <= cap).select(F.col("comp").alias("grp"), "rep")
    big = sized.filter(F.col("size") > cap)
    chunks = F.ceil(F.col("size") / F.lit(cap / 2)).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(3)), chunks).cast("int")
    hub = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("size")) < hubs
    spread = big.withColumn("chunk", F.explode(F.when(hub, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))))
    first = confirm(small.unionByName(spread.select(F.xxhash64("comp", "chunk").alias("grp"), "rep")))
    if big.isEmpty():
        return first
    first = common.materialize(first, "path-first")
    found = common.components(first).toDF("rep", "label")
    members = big.select(F.col("comp").alias("node"), "rep").join(found, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    counts = members.groupBy("node", "label").agg(F.count("*").alias("n")).groupBy("node").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("alike"), F.sum("n").alias("size"))
    counts = common.materialize(counts.filter("size > alike"), "path-rest")
    few = counts.filter(F.col("size") - F.col("alike") <= cap)
    members = members.join(counts.select("node", "main"), "node").select("node", "rep", (F.col("label") == F.col("main")).alias("linked"))
    blocks = _minor_blocks(members.join(few.select("node", "alike"), "node"), cap // 2).select(F.col("node").alias("grp"), "rep")
    pairs = _blocks(members.select("node", "rep"), counts.filter(F.col("size") - F.col("alike") > cap).select("node", "size"), "node", cap)
    return first.unionByName(confirm(blocks.unionByName(pairs.select("grp", "rep"))))


def near_duplicates(
    docs: DataFrame, shingle: int = 5, part: int = 100, whole: int = 85, trees: int = 4, leaf: int = 256,
    agreement: float = 0.65, depth: int = 8, cap: int = 2000,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text).

    Two documents are linked when part * intersection >= whole * union of their shingle sets; component_id is
    the smallest doc_id reachable over links.  A text without words (null and empty ones too) has an empty
    set, is linked with nothing and kept.  Equal sets are linked without a comparison.  Repeated rows give
    repeated results; doc_id is taken to name one text, and a row whose doc_id is null is its own component.
    No table is too small (empty gives empty); other columns are not read.  `leaf` is the size up to which
    a node is compared at once, `depth` that of a tree; nodes still larger there, and components beyond
    `cap`, are compared block by block, so these bounds change the work and not the result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    every = common.materialize(document_sets(texts, shingle, trees), "path-sets")
    sets = every.filter("doc_id is not null")
    near = common.materialize(common.components(candidate_edges(sets, leaf, agreement, depth)).toDF("rep", "comp"), "path-near")
    labels = common.components(_confirmed(near, texts.withColumnRenamed("doc_id", "rep"), shingle, part, whole, cap))
    reps = sets.filter("n_shingles > 0").groupBy("key_a", "key_b").agg(F.min("doc_id").alias("rep"))
    reps = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("key_a", "key_b", F.coalesce("component", "rep").alias("component"))
    out = every.filter("n_shingles > 0").join(reps, ["key_a", "key_b"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    empty = every.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
