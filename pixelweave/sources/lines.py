"""Text lines with a dense, scalable position: running totals per file split plus split offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import cut

SPLIT = ["file", "_blk"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, _blk, _mid, line): ``_blk`` orders the splits of a file, ``_mid`` the lines of a split."""
    t = spark.read.text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_blk"),
                    F.monotonically_increasing_id().alias("_mid"), F.col("value").alias("line"))


def running(t: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """Adds, per name, the total weight of all EARLIER lines of the same file.

    Splits are bounded by the reader, so the window inside a split is bounded too; only one row per
    split takes part in the ordering across splits.
    """
    t = cut(t.withColumns({f"_w_{n}": e.cast("long") for n, e in weights.items()}))
    per = t.groupBy(*SPLIT).agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    before = Window.partitionBy("file").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*SPLIT, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in weights])
    own = Window.partitionBy(*SPLIT).orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({n: F.coalesce(F.sum(f"_w_{n}").over(own), F.lit(0)) for n in weights}).join(per, SPLIT)
    t = t.withColumns({n: F.col(n) + F.col(f"_o_{n}") for n in weights})
    return t.drop(*[f"_{k}_{n}" for n in weights for k in "wo"])
