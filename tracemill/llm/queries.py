"""Registered queries of the subpackage: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tracemill.llm import license_scan, merkle_labels, tool_calls, turn_repair
from tracemill.llm.arc_convert import archive_pages
from tracemill.llm.best_fit import pack
from tracemill.llm.bwt_dedup import remove_repeats
from tracemill.llm.chosen_path import near_duplicates
from tracemill.llm.common import shared_folder
from tracemill.llm.compressed_size import quality_scores
from tracemill.llm.one_bit_codes import nearest
from tracemill.llm.plane_files import read_ids, write_ids
from tracemill.llm.source_mix import mix_sources
from tracemill.llm.target_ratio import quality_rules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.conversation_calls(_table(spark, sf_dir, "conversations"))
    return tool_calls.link_calls(calls, results, tool_calls.SCHEMAS)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select(*[c for c in out.columns if c != "score"], "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_ids(write_ids(_table(spark, sf_dir, "documents"), path, 2, shared_folder(spark, "ids")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(_table(spark, sf_dir, "documents"))
    return out.select(*[c for c in out.columns if c not in ("source", "shards")], "source", "shards")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_turns(_table(spark, sf_dir, "conversations"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_labels.manifest(_table(spark, sf_dir, "documents"))


CASES = {
    "op1_license_scan": (op1, license_scan.sql()),
    "op2_best_fit_packing": (op2, None),
    "op3_nearest_neighbours": (op3, None),
    "op4_tool_calls": (op4, tool_calls.SQL),
    "op5_quality_rules": (op5, None),
    "op6_arc_to_warc": (op6, None),
    "op7_near_duplicates": (op7, None),
    "op8_plane_files": (op8, None),
    "op9_repeated_strings": (op9, None),
    "op10_source_mix": (op10, None),
    "op11_turn_repair": (op11, turn_repair.sql()),
    "op12_compressed_size": (op12, None),
    "op13_merkle_labels": (op13, merkle_labels.SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
