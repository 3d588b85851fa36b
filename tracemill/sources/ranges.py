"""Text in a given number of files, each written by many tasks.

Spark's writers make a file in one task, so a given number of files means as many tasks, however long the text is.
Here the bytes of every task are summed first, which gives each its own range of every file; then tasks write their
ranges at once.  A repeated attempt puts the same bytes in the same place.
"""

from __future__ import annotations

import os
from contextlib import ExitStack
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .steps import stored

CHANGED = "rows came differently when they were computed again"


def mounted(spark: SparkSession, path: str) -> str | None:
    """The path on a file system that the machines mount, else None: object stores and HDFS have no ranges to write."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toUri().toString()
    return unquote(urlparse(uri).path) if urlparse(uri).scheme == "file" else None


def write_lines(lines: Column, rows: DataFrame, path: str, files: int) -> None:
    """Write a line for each row as `files` text files below a new path; no line (null) is not written.

    Rows go to the files in turn.  They are computed twice and must come alike, as rows read from files do: bytes that
    do not fill their ranges raise an error.  Where files can't be written by ranges, Spark's writer makes them, one
    task a file.
    """
    spark = rows.sparkSession
    rows = rows.select(lines.alias("value"))
    base = mounted(spark, path)
    if base is None:
        rows.filter("value IS NOT NULL").repartition(files).write.text(path)
        return
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = rows.select(
        F.spark_partition_id().alias("part"), (place % files).cast("int").alias("file"), F.col("value").cast("binary").alias("value")
    ).filter("value IS NOT NULL")
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = stored(rows.groupBy("part", "file").agg(F.sum(F.octet_length("value") + 1).alias("n")).select(
        "part", "file", "n", F.sum("n").over(before).alias("stop")), "ranges")
    os.makedirs(base)
    for k in range(files):
        open(_name(base, k), "xb").close()
    ranges = room.select("part", "file", (F.col("stop") - F.col("n")).alias("start"), "stop")
    written = rows.join(F.broadcast(ranges), ["part", "file"], "left").select("file", "start", "stop", "value").mapInArrow(
        _writer(base), "n long")
    if written.agg(F.sum("n")).first() != room.agg(F.sum("n")).first():
        raise ValueError(CHANGED)


def _name(base: str, file: int) -> str:
    return f"{base}/part-{file:05d}.txt"


def _writer(base: str):
    """Writes the rows of a task, each behind the one before it in its file; gives the number of bytes."""
    def write(batches):
        outs, n = {}, 0
        with ExitStack() as stack:
            for batch in batches:
                for file, start, stop, value in zip(*(c.to_pylist() for c in batch.columns)):
                    if start is None:
                        raise ValueError(CHANGED)
                    if file not in outs:
                        out = stack.enter_context(open(_name(base, file), "r+b"))
                        out.seek(start)
                        outs[file] = [out, start, stop]
                    line, at = value + b"\n", outs[file]
                    at[1] += len(line)
                    if at[1] > stop:
                        raise ValueError(CHANGED)
                    at[0].write(line)
                    n += len(line)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    return write
