"""Working folders for queries that write files or run streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.sources.steps import shared_folder as folder


def run_append(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Run an append stream over all its input and read what it wrote."""
    base = folder(spark, name)
    query = (
        df.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/out").start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def run_latest(spark: SparkSession, df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run an aggregating stream over all its input and read its last result."""
    base = folder(spark, name)
    query = (
        df.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{base}/checkpoint")
        .foreachBatch(lambda out, _: out.write.mode("overwrite").parquet(f"{base}/out")).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")
