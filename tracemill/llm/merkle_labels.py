"""Merkle manifest of a table with nested-interval labels.

Every node carries the interval of leaf ranks that it covers.  A leaf's ancestors are the nodes whose
intervals contain its rank: leaves and nodes meet in buckets, one for each level and the rank divided by the
level's width, and the containment decides.  A node brings the intervals of its children; those that do not
contain the rank, the difference between parent and own branch, are the siblings of the leaf's proof.

Trees are built in tiers of `TIER` levels: a tier's nodes come from groups of at most `ARITY ** TIER` digests,
its tops are the next tier's leaves, and a proof is the tier's own part followed by that of its top.  So a tree
of any size, one with all rows too, takes a few rounds, no task holds more than a group, and each row meets
the levels of one tier only.  Ranks come from a range sort with a count for each task and tree.

Rows and results
* null fields hash as `-`; a null source is a tree of its own and comes first, a null doc_id comes first in its
  tree and is never tampered with.  Rows of one doc_id are ordered by their leaves; repeated rows are leaves
  each.  A lone leaf is its subroot, a lone source's subroot the root.  An empty table gives no row.
* columns other than the five are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracemill.llm import common

ARITY = 3
TIER = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(**changed: Column) -> Column:
    """Digest of a row's fields, some of them replaced."""
    return F.sha2(F.concat(*[_field(changed.get(c, F.col(c))) for c in FIELDS]), 256)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """df with `rank` from 0 within its `tree` and the tree's `size`.

    The sort deals one tree to many tasks; equal rows get ranks of their own in any order.
    """
    keys = [F.asc_nulls_first(c) for c in ("tree", *order, "__row")]
    placed = df.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = common.materialize(placed.withColumn("__row", F.monotonically_increasing_id()), "ranks")
    placed = placed.withColumn("__task", F.shiftright("__row", 33))
    runs = placed.groupBy(F.col("tree").alias("__tree"), F.col("__task").alias("__run")).agg(
        F.min("__row").alias("__first"), F.count("*").alias("__n"))  # no more rows than trees and tasks
    whole = W.partitionBy("__tree")
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = common.materialize(runs.select("*", before.alias("__before"), F.sum("__n").over(whole).alias("size")), "runs")
    out = placed.join(runs, (F.col("tree") == F.col("__tree")) & (F.col("__task") == F.col("__run")))
    return out.select(*df.columns, (F.col("__row") - F.col("__first") + F.col("__before")).alias("rank"), "size")


def _tier(leaves: DataFrame, base: int) -> DataFrame:
    """A row for each group of a tier: its top and its nodes with their intervals and children.

    leaves: tree, rank, size (of the tree in this tier's leaves), total (in the lowest leaves) and digest;
    each covers ARITY ** base ranks.
    """
    rows = leaves.groupBy("tree", "size", "total", F.expr(f"rank div {ARITY ** TIER}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest"))).alias("found"))
    rows = rows.select("tree", "size", "total", "block", F.transform("found", lambda x: x["digest"]).alias("d0"),
                       sum((F.col("size") > ARITY**k).cast("int") for k in range(TIER)).alias("depth"))
    nodes = []
    for level in range(1, TIER + 1):
        below, width, part = f"d{level - 1}", ARITY ** (base + level), ARITY ** (base + level - 1)
        rows = rows.withColumn(f"d{level}", F.expr(
            f"transform(sequence(0, (size({below}) - 1) div {ARITY}), i -> sha2(concat_ws('', slice({below}, {ARITY} * i + 1, {ARITY})), 256))"))
        lo, child = f"(block * {ARITY ** (TIER - level)} + i) * {width}L", f"{part}L * j + (block * {ARITY ** (TIER - level)} + i) * {width}L"
        nodes.append(f"""if(depth < {level}, array(), transform(d{level}, (d, i) -> struct({level} as level, {lo} as lo,
            least({lo} + {width}L, total) as hi, d as digest, transform(slice({below}, {ARITY} * i + 1, {ARITY}), (c, j) -> struct(
                {child} as lo, least({child} + {part}L, total) as hi, c as digest)) as children)))""")
    top = F.expr(f"element_at(array({', '.join(f'd{k}' for k in range(TIER + 1))}), depth + 1)[0]")
    return common.materialize(rows.select("tree", "size", "total", "block", top.alias("top"), F.expr(f"concat({', '.join(nodes)})").alias("nodes")), "nodes")


def _attach(leaves: DataFrame, tier: DataFrame, base: int) -> DataFrame:
    """tree, rank and path: the siblings left and right of each leaf's branch in the tier, from the lowest level up."""
    buckets = f"transform(sequence(1, {TIER}), l -> struct(l as level, rank div cast(power({ARITY}, l) as bigint) as bucket))"
    depth = " + ".join(f"int(size > {ARITY ** k})" for k in range(TIER))
    own = leaves.select(F.col("tree").alias("t"), "rank", (F.col("rank") * ARITY**base).alias("at"),
                        F.explode(F.expr(f"slice({buckets}, 1, {depth})")).alias("b")).select("t", "rank", "at", "b.*")
    nodes = tier.select("tree", F.explode("nodes").alias("n")).select(
        "tree", F.col("n.level").alias("of"), "n.lo", "n.hi", "n.children", F.expr(f"n.lo div cast(power({ARITY}, n.level + {base}) as bigint)").alias("holds"))
    held = (F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi"))
    both = own.join(nodes, (F.col("t") == F.col("tree")) & (F.col("level") == F.col("of")) & (F.col("bucket") == F.col("holds")) & held)

    def beside(side: str) -> Column:
        return F.expr(f"concat_ws('', transform(filter(children, c -> {side}), c -> c.digest))")

    step = F.struct("level", beside("c.hi <= at").alias("left"), beside("c.lo > at").alias("right"))
    return both.groupBy("tree", "rank").agg(F.sort_array(F.collect_list(step)).alias("path"))


def _continued(path: DataFrame, above: DataFrame | None) -> DataFrame:
    """Paths of a tier, each followed by that of its group's top in the tier above."""
    if above is None:
        return path
    more = above.select(F.col("tree").alias("t"), F.col("rank").alias("r"), F.col("path").alias("more"))
    whole = F.concat("path", F.coalesce("more", F.array().cast(path.schema["path"].dataType)))
    same = (F.col("tree") == F.col("t")) & (F.expr(f"rank div {ARITY ** TIER}") == F.col("r"))
    return path.join(more, same, "left").select("tree", "rank", whole.alias("path"))


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees over tree, rank, size and digest: paths of leaves in the lowest tier (tree, rank, path), paths of
    that tier's groups above it (tree, rank, path; none for a group that is its tree's only one), and roots (tree, root).

    A path is a list of (level, left, right), the digests to the left and right of the branch.
    """
    tiers, base, now = [], 0, leaves.withColumn("total", F.col("size"))
    most = leaves.agg(F.max("size")).first()[0] or 0
    while True:
        tier = _tier(now, base)
        tiers.append((_attach(now, tier, base), tier))
        if most <= ARITY**TIER:
            break
        most, base = -(-most // ARITY**TIER), base + TIER
        now = tier.filter(f"size > {ARITY ** TIER}").select(
            "tree", F.col("block").alias("rank"), F.expr(f"(size + {ARITY ** TIER - 1}) div {ARITY ** TIER}").alias("size"), "total",
            F.col("top").alias("digest"))
    roots, above = None, None
    for path, tier in reversed(tiers):
        ends = tier.filter(f"size <= {ARITY ** TIER}").select("tree", F.col("top").alias("root"))
        roots = ends if roots is None else roots.unionByName(ends)
        if tier is not tiers[0][1]:
            above = _continued(path, above)
    lowest = tiers[0][0]
    return lowest, lowest.limit(0) if above is None else above, roots


def manifest(docs: DataFrame) -> DataFrame:
    """Leaf, roots and proof of every row, and whether its leaf, tampered with where the rule says, verifies."""
    own = docs.select(F.col("doc_id").cast("long"), "source", "lang", "n_chars", "text")
    touched = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains("text", F.lit("\n"))
    leaf = leaf_hash()
    bad = F.when(touched, leaf_hash(text=F.translate("text", "\n", "")))
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # null first, then bytewise
    rows = common.materialize(own.select("doc_id", tree.alias("tree"), leaf.alias("leaf"), bad.alias("bad")), "leaves")
    rows = common.materialize(ranked(rows, "doc_id", "leaf"), "ranked")
    low, high, subroots = forest(rows.select("tree", "rank", "size", F.col("leaf").alias("digest")))

    sources = common.materialize(subroots, "subroots")
    tops = ranked(sources.select(F.lit("*").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("digest")), "source")
    tops = common.materialize(tops, "tops")
    last, over, root = forest(tops.select("tree", "rank", "size", "digest"))
    last = _continued(last, over).select(F.col("rank").alias("k"), F.col("path").alias("last"))
    ends = tops.join(last, F.col("rank") == F.col("k"), "left").join(root, "tree")
    ends = common.materialize(ends.select(F.col("source").alias("of"), F.col("digest").alias("subroot"), "last", "root"), "ends")

    none = F.array().cast(low.schema["path"].dataType)
    groups = rows.select("tree", F.expr(f"rank div {ARITY ** TIER}").alias("block")).distinct()
    up = high.select(F.col("tree").alias("t"), F.col("rank").alias("r"), F.col("path").alias("high"))
    groups = groups.join(up, (F.col("tree") == F.col("t")) & (F.col("block") == F.col("r")), "left").join(ends, F.col("tree") == F.col("of"))
    groups = groups.select(F.col("tree").alias("t"), "block", "subroot", "root", F.concat(
        F.coalesce("high", none), F.coalesce("last", none)).alias("high"))
    groups = common.materialize(groups, "groups")

    low = low.select(F.col("tree").alias("u"), F.col("rank").alias("k"), F.col("path").alias("low"))
    out = rows.join(low, (F.col("tree") == F.col("u")) & (F.col("rank") == F.col("k")), "left")
    out = out.join(groups, (F.col("tree") == F.col("t")) & (F.expr(f"rank div {ARITY ** TIER}") == F.col("block")))
    out = out.select("doc_id", "leaf", "subroot", "root", F.coalesce("bad", "leaf").alias("given"),
                     F.concat(F.coalesce("low", none), "high").alias("path"))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["left"], s["right"])))
    folded = F.aggregate("path", F.col("given"), lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))
    out = out.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same trees by recursion: `runs` holds the nodes of each run, a leaf's run at a level comes from its rank.
SQL = """
WITH RECURSIVE fields AS (
    SELECT doc_id, source, doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
               lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 2 = 0 AS touched,
           [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS head, text FROM documents),
hashed AS (
    SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || bad) AS given
    FROM (SELECT doc_id, source, list_aggregate(list_transform(head, lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END), 'string_agg', '') AS head,
                 CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS body,
                 CASE WHEN text IS NULL THEN '-' WHEN touched THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '')
                      ELSE strlen(text) || ':' || text END AS bad FROM fields)),
leaves AS (
    SELECT row_number() OVER () AS id, doc_id, source, leaf, given,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank FROM hashed),
nodes(source, level, i, h, n) AS (
    SELECT source, 0, rank, leaf, count(*) OVER (PARTITION BY source) FROM leaves
    UNION ALL
    SELECT source, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max(n + 2) // 3
    FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM nodes WHERE n = 1),
tops(level, i, h, n) AS (
    SELECT 0, rank, h, count(*) OVER () FROM subroots
    UNION ALL
    SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), max(n + 2) // 3 FROM tops WHERE n > 1 GROUP BY level, i // 3),
runs AS (SELECT source, level, i // 3 AS run, list(h ORDER BY i) AS hs FROM nodes WHERE n > 1 GROUP BY source, level, i // 3),
top_runs AS (SELECT level, i // 3 AS run, list(h ORDER BY i) AS hs FROM tops WHERE n > 1 GROUP BY level, i // 3),
steps AS (
    SELECT id, level, hs, (rank // CAST(3 ** level AS BIGINT)) % 3 AS place FROM leaves JOIN runs
    ON leaves.source IS NOT DISTINCT FROM runs.source AND run = rank // CAST(3 ** (level + 1) AS BIGINT)
    UNION ALL
    SELECT id, 1000 + level, hs, (s.rank // CAST(3 ** level AS BIGINT)) % 3 FROM leaves
    JOIN subroots AS s ON leaves.source IS NOT DISTINCT FROM s.source JOIN top_runs ON run = s.rank // CAST(3 ** (level + 1) AS BIGINT)),
sides AS (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY level) AS k, coalesce(list_aggregate(hs[1:place], 'string_agg', ''), '') AS l,
           coalesce(list_aggregate(hs[place + 2:], 'string_agg', ''), '') AS r FROM steps),
proofs AS (SELECT id, string_agg(l || r, '' ORDER BY k) AS proof, max(k) AS depth FROM sides GROUP BY id),
fold(id, k, h) AS (
    SELECT id, CAST(0 AS BIGINT), given FROM leaves
    UNION ALL
    SELECT fold.id, fold.k + 1, sha256(l || h || r) FROM fold JOIN sides ON fold.id = sides.id AND sides.k = fold.k + 1)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
       fold.h AS folded_root, fold.h = (SELECT h FROM tops WHERE n = 1) AS verified
FROM leaves JOIN subroots AS s ON leaves.source IS NOT DISTINCT FROM s.source
LEFT JOIN proofs ON proofs.id = leaves.id JOIN fold ON fold.id = leaves.id AND fold.k = coalesce(depth, 0)"""
