"""Inputs that Spark derives from the given tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import d, hash2, u8
from ..schema import PIXEL, spread


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def px_embed(spark: SparkSession, sf: str) -> DataFrame:
    """one 8x8 colour image per embedding."""
    e = spread(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    t = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))

    def at(k: int):
        return F.col("embedding")[(F.col("i") + k) % 64].cast("double")

    return t.select(
        F.col("vec_id").alias("image_id"),
        F.lit(0).alias("frame"),
        F.lit(8).alias("w"),
        F.lit(8).alias("h"),
        (F.col("i") % 8).alias("x"),
        F.shiftright("i", 3).alias("y"),
        u8(d(128) + d(512) * at(0)).alias("r"),
        u8(d(128) + d(512) * at(21)).alias("g"),
        u8(d(128) + d(512) * at(42)).alias("b"),
        u8(d(200) + d(800) * at(11)).alias("a"),
    )


def px_embed_b(spark: SparkSession, sf: str) -> DataFrame:
    """F1 with neighbours swapped (image n holds image n xor 1): the second operand."""
    return px_embed(spark, sf).withColumn("image_id", F.col("image_id").bitwiseXOR(F.lit(1).cast("long"))).select(*PIXEL)


def px_part(spark: SparkSession, sf: str) -> DataFrame:
    """one 16x16 hashed image per part."""
    p = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    t = p.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    t = t.select("p_partkey", (F.col("i") % 16).alias("x"), F.shiftright("i", 4).alias("y"))
    v = hash2(F.col("x"), F.col("y"), F.col("p_partkey"))
    t = t.withColumn("v", v)
    v = F.col("v")

    def byte(k: int):
        return F.shiftright(v, k).bitwiseAND(F.lit(255).cast("long")).cast("int")

    return t.select(
        F.col("p_partkey").alias("image_id"),
        F.lit(0).alias("frame"),
        F.lit(16).alias("w"),
        F.lit(16).alias("h"),
        "x",
        "y",
        byte(0).alias("r"),
        byte(8).alias("g"),
        byte(16).alias("b"),
        F.when(F.shiftright(v, 24).bitwiseAND(F.lit(7).cast("long")) == 0, F.lit(0)).otherwise(F.lit(255)).alias("a"),
    )


def mask_part(spark: SparkSession, sf: str) -> DataFrame:
    """one blocky 16x16 black/white mask per part."""
    p = spread(table(spark, sf, "part").select("p_partkey"), "p_partkey")
    t = p.select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    t = t.select("p_partkey", (F.col("i") % 16).alias("x"), F.shiftright("i", 4).alias("y"))
    v = hash2(F.shiftright("x", 1), F.shiftright("y", 1), F.col("p_partkey"))
    on = F.when(v.bitwiseAND(F.lit(3).cast("long")) < 2, F.lit(255)).otherwise(F.lit(0))
    t = t.withColumn("v", on)
    return t.select(
        F.col("p_partkey").alias("image_id"),
        F.lit(0).alias("frame"),
        F.lit(16).alias("w"),
        F.lit(16).alias("h"),
        "x",
        "y",
        F.col("v").alias("r"),
        F.col("v").alias("g"),
        F.col("v").alias("b"),
        F.lit(255).alias("a"),
    )


def img_part(spark: SparkSession, sf: str) -> DataFrame:
    """Blank canvases sized by part: between 5 and 20 pixels a side."""
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    return p.select(
        F.col("p_partkey").alias("image_id"),
        F.lit(0).alias("frame"),
        (F.lit(5) + (F.col("p_partkey") % 11)).cast("int").alias("w"),
        (F.lit(6) + (F.col("p_size") % 15)).cast("int").alias("h"),
    )


def seq_frames(spark: SparkSession, sf: str) -> DataFrame:
    """F4 frame table: one sequence per user, one frame per event."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("user_id", "event_id", "ts")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t = e.withColumn("us", us).withColumn("frame", (F.row_number().over(w) - 1).cast("int"))
    t = t.withColumn("next_us", F.lead("us").over(w))
    gap = F.floor((F.col("next_us") - F.col("us")) / 1000)
    return t.select(
        F.col("user_id").alias("image_id"),
        "frame",
        "event_id",
        F.coalesce(F.least(F.lit(1000).cast("long"), gap), F.lit(100).cast("long")).cast("int").alias("delay_ms"),
    )


def seq_pixels(frames: DataFrame) -> DataFrame:
    """F4 pixels: a 4x4 raster per frame."""
    t = frames.select("image_id", "frame", "event_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i"))
    x, y = F.col("i") % 4, F.shiftright("i", 2)
    v = ((F.col("event_id") + x * 4 + y * 16) % 256).cast("int")
    return t.select(
        "image_id",
        "frame",
        F.lit(4).alias("w"),
        F.lit(4).alias("h"),
        x.alias("x"),
        y.alias("y"),
        v.alias("r"),
        (F.lit(255) - v).alias("g"),
        F.lit(64).alias("b"),
        F.lit(255).alias("a"),
    )
