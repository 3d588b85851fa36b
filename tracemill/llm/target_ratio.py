"""Quality rules: word statistics of every text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over hashed words and word pairs: trusted documents (labelled of good
quality and not toxic) against all documents.  A document's score is the mean log ratio of its n-grams, in
millionths of a nat and integer arithmetic, so the verdict does not depend on the order of additions.
Only DataFrame functions are used; the corpus is read once for the counts and once for the scores, counts
combine before their shuffle, and what is looked up per n-gram is one array of `buckets` numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.common import GAP

WINDOW = 5
UNIT = 1_000_000


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _covered(grams: Column) -> Column:
    """Words covered by 5-word windows (as an array of hashes in text order) that occur twice or more."""
    pairs = F.array_sort(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s):
        same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))

    def width(at):
        reach = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

    return _let(pairs, lambda s: _let(repeated(s), width))


def hashes_of(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bucket(buckets: int, *hashes: Column) -> Column:
    """Bucket of a hashed word, or of two in a row."""
    return F.pmod(hashes[0] if len(hashes) == 1 else F.xxhash64(*hashes), F.lit(buckets)).cast("int")


def _pairs(hashes: Column, body) -> Column:
    """body(former, latter) of each two words in a row."""
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - 1), lambda i: body(F.get(hashes, i - 1), F.get(hashes, i)))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the key of both, its words and the base statistics."""
    d = common.with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", "text")
    d = d.select("doc_id", "key_x", "key_y", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", "key_x", "key_y", "text", words_of(F.col("text")).alias("words"))
    words, count = F.col("words"), F.size("words")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    grams = F.transform(
        F.sequence(F.lit(0), count - WINDOW), lambda i: F.xxhash64(*[F.get("hashes", i + k) for k in range(WINDOW)]))
    d = d.select("doc_id", "key_x", "key_y", "text", "words", hashes_of(words).alias("hashes")).select(
        "doc_id", "key_x", "key_y", "hashes", count.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.when(count > WINDOW, grams).alias("grams"))
    dup = F.size(F.array_distinct("grams")) < F.size("grams")
    d = d.withColumn("n_repeat_words", F.when(F.col("grams").isNotNull() & dup, _covered(F.col("grams"))).otherwise(F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.drop("grams").withColumn("base_failed", failed)


def _trusted(labels: DataFrame) -> DataFrame:
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0")
    return good.select(F.col("doc_id").alias("of")).distinct().hint("merge")  # grows with the corpus


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int, smoothing: float = 1.0) -> DataFrame:
    """One row: log ratio of target to raw for every bucket, in units; zeros while nothing is trusted."""
    grams = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_trusted(labels), F.col("doc_id") == F.col("of"), "left")
    grams = grams.select(F.col("of").isNotNull().cast("int").alias("t"), hashes_of(words_of(F.col("text"))).alias("hashes"))
    hashes = F.col("hashes")
    single = F.transform(hashes, lambda h: _bucket(buckets, h))
    double = _pairs(hashes, lambda g, h: _bucket(buckets, g, h))
    counts = grams.select("t", F.explode(F.when(F.size(hashes) > 1, F.concat(single, double)).otherwise(single)).alias("bucket"))
    counts = counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    all_buckets = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    table = all_buckets.join(counts, "bucket", "left").groupBy().agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))).alias("c"),
        F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t"))
    share = lambda n, total: F.log((n + smoothing) / (total + smoothing * buckets))
    ratio = lambda x: F.round(UNIT * (share(x["target"], F.col("t")) - share(x["raw"], F.col("r")))).cast("long")
    return table.select(F.transform("c", lambda x: F.when(F.col("t") > 0, ratio(x)).otherwise(F.lit(0).cast("long"))).alias("w"))


def low_quantile(scores: DataFrame, share: float) -> DataFrame:
    """One row, bar: the score, down to a thousandth of a nat, below which lie at most `share` of the scores.

    A histogram of as many rows as scores have thousandths, so exact and the same in any order; null of none.
    """
    step = UNIT // 1000
    bins = scores.groupBy(F.floor(F.col("score") / step).alias("bin")).agg(F.count("*").alias("n"))
    whole = bins.groupBy().agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("total"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("bar"))

    def fold(a, x):
        seen = a["seen"] + x["n"]
        found = F.when(seen > F.floor(F.col("total") * share), x["bin"] * step)
        return F.struct(seen.alias("seen"), F.coalesce(a["bar"], found).alias("bar"))

    return whole.select(F.aggregate("h", start, fold)["bar"].alias("bar"))


def quality_rules(
    docs: DataFrame, labels: DataFrame, buckets: int = 10_000, least: float = -0.15, with_key: bool = False,
    lost: float = 0.001,
) -> DataFrame:
    """(doc_id[, key_x, key_y], n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept) per row of docs.

    base_failed: fewer than 10 words, or over 20% of the words in repeated windows of 5 words.  score: mean
    log ratio of the document's n-grams in millionths of a nat (null without words); kept: the base rules
    hold and the score is at least `least` nats and at least the bar, ties kept.  The bar is the score below
    which lie at most a share `lost` of the trusted rows that the base rules hold for, so it follows the
    ratio as the corpus and its buckets change it; without such rows `least` alone counts.  Null text counts as empty and fails by its
    length.  Repeated rows give repeated results and count as often; a null doc_id is never trusted; labels
    that repeat count once, and without trusted documents every score is 0.  Other columns are not read.
    With `with_key` a row has the key of its doc_id and text, for doc_id may be null or name several texts.
    """
    d = base_rules(docs)
    weights = log_ratios(docs, labels, buckets)
    d = d.withColumn("w", weights.scalar())
    hashes, zero = F.col("hashes"), F.lit(0).cast("long")
    weight = lambda *h: F.get(F.col("w"), _bucket(buckets, *h))
    single = F.aggregate(hashes, zero, lambda a, h: a + weight(h))
    double = F.aggregate(
        F.sequence(F.lit(1), F.size(hashes) - 1), zero, lambda a, i: a + weight(F.get(hashes, i - 1), F.get(hashes, i)))
    n = F.size(hashes)
    total = F.when(n > 1, single + double).otherwise(single)
    d = d.withColumn("score", F.when(n > 0, F.floor(total / (2 * n - 1))).cast("long"))
    out = d.select("doc_id", *(("key_x", "key_y") if with_key else ()), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score")
    out = common.materialize(out, "quality")  # a filter on it would else be pushed down and repeat all of the work
    good = out.filter("not base_failed").join(_trusted(labels), F.col("doc_id") == F.col("of"))
    bar = common.materialize(low_quantile(good.select("score"), lost), "quality-bar")
    kept = ~F.col("base_failed") & (F.col("score") >= F.greatest(F.lit(int(least * UNIT)), bar.scalar()))
    return out.withColumn("kept", F.coalesce(kept, F.lit(False)))
