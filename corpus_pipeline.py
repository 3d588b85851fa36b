"""The corpus pipeline: quality rules, near-duplicates, repeated strings, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  `run` writes what a stage returns to the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import common
from tracemill.llm.best_fit import pack
from tracemill.llm.bwt_dedup import remove_repeats
from tracemill.llm.chosen_path import near_duplicates
from tracemill.llm.source_mix import mixed_rows
from tracemill.llm.target_ratio import quality_rules

#: Texts that fill a task.  Every task writes a file, and on local file systems Hadoop starts processes for each.
TEXTS = 2_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    kept = quality_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_key=True).filter("kept")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*docs.columns).alias("row"))
    keyed = common.with_key(rows, "doc_id", "text")
    kept = keyed.join(kept.select("key_x", "key_y"), ["key_x", "key_y"], "left_semi").select("row.*")
    return common.gathered(kept, docs.count(), TEXTS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest doc_id; one row of repeated ones.

    Near-duplicates share 0.8 or more of their shingles of five words.  Rows are told apart by a number of
    their own, for doc_id may be null or name several texts; a null one is the greatest.
    """
    rows = common.materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), whole=80).withColumnRenamed("doc_id", "__row")
    keyed = common.with_key(rows, "text").select("__row", "doc_id", "key_x", "key_y")
    found = found.select("__row", "n_shingles", "component_id").join(keyed, "__row")
    # texts without words are no near-duplicates, but may be repeated rows
    wordless, own = F.col("n_shingles") == 0, F.coalesce("doc_id", "__row")
    group = [F.when(~wordless, F.col("component_id")), F.when(wordless, F.col("doc_id").isNull()),
             *[F.when(wordless, c) for c in (own, F.col("key_x"), F.col("key_y"))]]
    first = found.groupBy(*[c.alias(f"g{i}") for i, c in enumerate(group)]).agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key_x", "key_y", "__row"))["__row"].alias("__row"))
    return common.gathered(rows.join(first.select("__row"), "__row", "left_semi").select(*docs.columns), rows.count(), TEXTS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated strings; n_chars is that of the new text, and empty ones go."""
    whole = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"))
    rows = remove_repeats(whole, with_text=True, carry=("__row",)).filter("text <> ''")
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"__row.{c}").alias(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("repeats", repeats), ("mix", mix), ("packing", packing)]

#: Hashed n-grams, signatures, seeded draws and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
