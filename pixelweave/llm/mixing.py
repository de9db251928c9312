"""Mixing the text outputs of several node types to target weights, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import cut
from .common import prefix_sums

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to ``totals(node_type, source_size, weight)``, one row per node type.

    The types share ``share`` times the total size by weight; no target passes ``most`` times its
    own size, and what is above is shared anew by weight among the others until none is above.
    In order of cap / weight the capped types come first, so two running sums find the level at
    which the rest is filled. The table holds one row per node type, a setting of the mix.
    """
    cap, w = F.lit(float(most)) * F.col("source_size"), F.col("weight").cast("double")
    t = totals.withColumns({"_cap": cap.cast("double"), "_w": w}).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "node_type")
    everyone = Window.partitionBy()
    t = t.withColumns({
        "_budget": F.sum("source_size").over(everyone) * F.lit(float(share)),
        "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "_rest": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    t = t.withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_rest"))
    t = t.withColumn("_open", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "node_type", "_level"))).over(everyone))
    target = F.when(F.col("_open").isNull() | (F.col("_ratio") <= F.col("_level")), F.col("_cap")).otherwise(F.col("_w") * F.col("_open._level"))
    return t.withColumn("target", target).drop(*[c for c in t.columns if c.startswith("_")])


def mix_sources(texts: DataFrame, weights: DataFrame | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """How many words of each text a mix takes: ``node_id, node_type, size, source_size, target, taken``.

    ``texts(node_id, node_type, text)``; a text's ``size`` is its number of words (null: 0).
    ``weights(node_type, weight)`` gives each type's weight; without it the types, in code point
    order with null last, weigh 5, 2, 1, repeating. ``target`` is the budget of the text's type.

    Texts get a hash-random key from (seed, node_id), types are sorted by it, and distributed prefix
    sums of the sizes give each text its place. A mix takes whole epochs of a type while its budget
    holds, then the texts in key order, and cuts the last one so that each type's taken words are
    its target rounded down. So no text is taken more than ``ceil(most)`` times.

    Null types are a type of their own; null ids share a key and count as texts; empty texts take
    nothing; repeated rows are separate texts; rows of equal key are ordered by id and size, so reruns
    agree; an empty table gives no rows; other columns are ignored.
    """
    t = cut(texts.select("node_id", "node_type", word_count(F.col("text")).alias("size")))
    totals = t.groupBy("node_type").agg(F.sum("size").alias("source_size"))
    if weights is None:
        rank = F.row_number().over(Window.orderBy(F.col("node_type").asc_nulls_last()))
        totals = totals.withColumn("weight", F.element_at(F.array(F.lit(1), F.lit(5), F.lit(2)), (rank % 3 + 1).cast("int")))
    else:
        w = weights.select(F.col("node_type").alias("_t"), "weight")
        totals = totals.join(w, F.col("node_type").eqNullSafe(F.col("_t"))).drop("_t")
    budget = targets(totals, share, most).select(F.col("node_type").alias("_t"), "source_size", "target")
    key = F.xxhash64(F.lit(seed), F.col("node_id"))
    t = prefix_sums(t, "node_type", key, ["node_id", "size"], "size", t.count(), "_before")
    t = t.join(budget, F.col("node_type").eqNullSafe(F.col("_t")))
    whole = F.floor(F.col("target")).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - epochs * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("_before")))
    return t.select("node_id", "node_type", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"))
