"""Bytes in files: the sink behind the binary formats, and ranges of records for their sources."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of records that one task reads at a time, and tasks at most.
RANGE = 1 << 26
TASKS = 1 << 16


def open_store(uri: str):
    """The file system of a path as Spark names it, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def byte_ranges(spark: SparkSession, path: str, head: int, record: int, size: int | None = None) -> DataFrame:
    """(file, first, n): runs of whole records of about ``size`` bytes (``RANGE``) in the files of a path, after ``head`` bytes each.

    Only names and lengths are read here. Ranges are dealt out to tasks, so one large file is read by many and no row
    holds a file; a file with less than one record has no range.
    """
    per = max(1, (size or RANGE) // record)
    t = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.floor((F.col("length") - head) / record).alias("all"))
    t = t.filter("all > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1, F.lit(per).cast("long"))))
    t = t.select("file", "first", F.least(F.lit(per).cast("long"), F.col("all") - F.col("first")).alias("n"))
    return t.repartition(max(1, min(TASKS, t.count())), "file", "first")


def read_at(file: str, start: int, length: int) -> bytes:
    """Bytes of a file, read in a task; fewer at its end."""
    store, name = open_store(file)
    with store.open_input_file(name) as f:
        return f.read_at(length, start)


def write_files(df: DataFrame, path: str) -> int:
    """Write df(name, content) as one file per row below ``path``, from the tasks; returns the number of files.

    A retried task writes the same names again, so a lost executor leaves no double.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(path)
        store.create_dir(base, recursive=True)
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"n": [len(pdf)]})

    return df.select("name", "content").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0
