"""Distributed helpers shared by the operators: prefix sums, components, row blocks."""

from __future__ import annotations

import ctypes
import gc
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut

#: Expected rows of one leaf of a prefix sum, and children of one of its inner nodes (2 ** 8).
LEAF_ROWS = 64
DIGIT_BITS = 8


def settled(df: DataFrame) -> DataFrame:
    """``cut``; then Spark may drop the shuffle files of the round, which it does once its driver has collected garbage."""
    out = cut(df)
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def hand_back() -> None:
    """Called where a Python task ends: workers are used again, and what the task has freed would stay theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def prefix_sums(df: DataFrame, group: str, key: Column, order: list[str], value: str, rows: int, out: str) -> DataFrame:
    """Adds ``out``: the total of ``value`` over the rows of the same ``group`` that come earlier.

    Rows are sorted by ``key``, an evenly spread 64-bit hash, then by ``order``. The leading bits of
    the key cut every group into leaves of about ``LEAF_ROWS`` rows; sums go up a tree with 256
    children a node and offsets come down again, so no window holds more than a leaf or the
    children of one node, however large a group is. ``rows`` is the size of the table.
    Groups may be null.
    """
    bits = max(0, math.ceil(math.log2(max(1, rows) / LEAF_ROWS)))
    t = df.withColumns({"_k": key, "_g": F.coalesce(F.xxhash64(F.struct(F.col(group).isNull(), F.col(group))), F.lit(0))})
    cuts = list(range(0, bits, DIGIT_BITS)) + [bits]  # 0 .. bits: the tree's levels

    def lead(c: Column, n: int) -> Column:
        return F.shiftrightunsigned(c, 64 - n) if n else F.lit(0).cast("long")

    t = t.withColumn("_leaf", lead(F.col("_k"), bits))
    sums = t.groupBy(F.col(group), "_g", "_leaf").agg(F.sum(value).alias("_s"))
    levels = [sums]
    for n in reversed(cuts[:-1]):
        sums = sums.withColumn("_leaf", F.shiftrightunsigned("_leaf", cuts[cuts.index(n) + 1] - n))
        sums = sums.groupBy(F.col(group), "_g", "_leaf").agg(F.sum("_s").alias("_s"))
        levels.append(sums)
    offsets = None
    for depth in range(len(levels) - 2, -1, -1):
        n = cuts[len(cuts) - 1 - depth]
        up = cuts[len(cuts) - 2 - depth]
        own = levels[depth].withColumn("_up", F.shiftrightunsigned("_leaf", n - up))
        before = Window.partitionBy("_g", group, "_up").orderBy("_leaf").rowsBetween(Window.unboundedPreceding, -1)
        own = own.withColumn("_o", F.coalesce(F.sum("_s").over(before), F.lit(0)))
        if offsets is not None:
            above = offsets.select(F.col("_g").alias("_g2"), F.col(group).alias("_n2"), F.col("_leaf").alias("_up2"), F.col("_o").alias("_o2"))
            own = own.join(above, (F.col("_g") == F.col("_g2")) & F.col(group).eqNullSafe(F.col("_n2")) & (F.col("_up") == F.col("_up2")))
            own = own.withColumn("_o", F.col("_o") + F.col("_o2"))
        offsets = own.select("_g", group, "_leaf", "_o")
    inside = Window.partitionBy("_g", group, "_leaf").orderBy("_k", *order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn(out, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if offsets is not None:
        o = offsets.select(F.col("_g").alias("_g3"), F.col(group).alias("_n3"), F.col("_leaf").alias("_l3"), "_o")
        t = t.join(o, (F.col("_g") == F.col("_g3")) & F.col(group).eqNullSafe(F.col("_n3")) & (F.col("_leaf") == F.col("_l3")))
        t = t.withColumn(out, F.col(out) + F.col("_o")).drop("_g3", "_n3", "_l3", "_o")
    return t.drop("_k", "_g", "_leaf")


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``: root is the smallest node reachable.

    Alternating large-star and small-star rounds: the number of rounds grows with the logarithm of
    the graph, every round is joins and minima over the links, and each is written to the shared
    folder. Only the number of links that changed reaches the driver.
    """
    edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = cut(small.filter("a != b").distinct())
        if after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty():
            break
        edges = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
