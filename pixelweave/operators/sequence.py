"""Frame sequences. Re-timing is closed-form index arithmetic on the small frame table; pixels follow by one join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import d, jsround
from ..schema import IMG, PIXEL, images_of


def lengths(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return frames.groupBy(*(keys or ["image_id"])).agg(F.count(F.lit(1)).cast("int").alias("n"))


def _indexed(frames: DataFrame, n_out: Column, src) -> DataFrame:
    t = lengths(frames).withColumn("_m", n_out.cast("int")).filter("_m > 0")
    t = t.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)))
    return t.select("image_id", "frame", src(F.col("frame")).cast("int").alias("src"))


def _resample(i: Column, n: Column, count: int) -> Column:
    picked = F.least(n - 1, jsround(d(i) * d(n) / float(max(1, count))))
    return F.when(F.lit(count) < n, picked).otherwise(i) if count > 0 else i


def resample_frames(frames: DataFrame, count: int) -> DataFrame:
    """(image_id, frame, src): evenly picked frames; never invents any."""
    n = F.col("n")
    return _indexed(frames, F.least(n, F.lit(count)) if count > 0 else n, lambda i: _resample(i, n, count))


def _ping(i: Column, n: Column) -> Column:
    return F.when(i < n, i).otherwise(n * 2 - 2 - i)


def ping_pong(frames: DataFrame) -> DataFrame:
    n = F.col("n")
    return _indexed(frames, F.when(n >= 3, n * 2 - 2).otherwise(n), lambda i: _ping(i, n))


def repeat_frames(frames: DataFrame, cycles: float) -> DataFrame:
    k = max(1, math.floor(cycles))
    return _indexed(frames, F.col("n") * k, lambda i: i % F.col("n"))


def reverse_frames(frames: DataFrame) -> DataFrame:
    return _indexed(frames, F.col("n"), lambda i: F.col("n") - 1 - i)


def shape_index(frames: DataFrame, frame_count: int = 0, loop: str = "forward", cycles: float = 1, reverse: bool = False) -> DataFrame:
    """Resample, reverse, ping-pong and repeat composed into one index table (image_id, frame, src)."""
    n0 = F.col("n")
    n1 = F.least(n0, F.lit(int(frame_count))) if frame_count > 0 else n0
    n2 = F.when(n1 >= 3, n1 * 2 - 2).otherwise(n1) if loop == "pingpong" else n1
    k = max(1, math.floor(cycles))

    def src(i: Column) -> Column:
        j = i % n2
        if loop == "pingpong":
            j = F.when(n1 >= 3, _ping(j, n1)).otherwise(j)
        if reverse:
            j = n1 - 1 - j
        return _resample(j, n0, int(frame_count))

    return _indexed(frames, n2 * k, src)


def take(p: DataFrame, index: DataFrame) -> DataFrame:
    """Rows of ``p`` re-framed by an index table."""
    cols = p.columns
    t = p.withColumnRenamed("frame", "src").join(index, ["image_id", "src"])
    return t.select(cols)


def shape_sequence(p: DataFrame, frames: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(pixels, frames) after shaping; a frame without a delay gets 100 ms."""
    idx = shape_index(frames, **options)
    delays = take(frames.select("image_id", "frame", F.coalesce("delay_ms", F.lit(100)).alias("delay_ms")), idx)
    return take(p, idx), delays


def frame_select(p: DataFrame, index: float) -> DataFrame:
    """One frame per sequence; negative counts from the end, out of range clamps."""
    k = math.floor(index + 0.5)
    n = lengths(images_of(p))
    at = F.lit(k) if k >= 0 else F.col("n") + k
    pick = n.select("image_id", F.greatest(F.lit(0), F.least(F.col("n") - 1, at)).alias("frame"))
    return p.join(pick, ["image_id", "frame"], "left_semi")


def frames_per_lens(ppi, lpi, samples=1) -> Column:
    ppi, lpi, s = d(ppi), d(lpi), F.greatest(d(1), d(samples))
    ok = (ppi > 0) & (lpi > 0)
    return F.when(ok, F.floor(ppi / F.when(ok, lpi).otherwise(d(1)) / s)).otherwise(F.lit(0)).cast("int")


def sequence_summary(frames: DataFrame, images: DataFrame, ppi: float = 0, lpi: float = 0, samples: float = 1) -> DataFrame:
    """Per sequence: frame count, size, play time, frames a lens can hold, whether they fit."""
    size = images.filter("frame = 0").select("image_id", "w", "h")
    t = frames.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_frames"), F.sum("delay_ms").alias("total_ms"))
    fit = frames_per_lens(ppi, lpi, samples)
    t = t.join(size, "image_id").withColumn("lens_frames", fit)
    return t.withColumn("fits", (F.col("lens_frames") > 0) & (F.col("n_frames") <= F.col("lens_frames")))


def carry_timing(inputs: DataFrame, out_frames: DataFrame) -> DataFrame:
    """(image_id, frame, delay_ms): timing of a mapped run.

    ``inputs`` is (image_id, input, frame, delay_ms).  The longest input with a delay on every frame
    donates its timing (the first on ties); it is dropped when the output does not have as many
    frames as the longest input.
    """
    per = inputs.groupBy("image_id", "input").agg(
        F.count(F.lit(1)).alias("n"), (F.count("delay_ms") == F.count(F.lit(1))).alias("full"))
    best = per.groupBy("image_id").agg(
        F.max("n").alias("frames"), F.max(F.when(F.col("full"), F.struct("n", (-F.col("input")).alias("neg")))).alias("b"))
    out = out_frames.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_out"))
    keep = best.join(out, "image_id").filter("b is not null and n_out = frames").select("image_id", (-F.col("b.neg")).alias("input"))
    return inputs.join(keep, ["image_id", "input"], "left_semi").select("image_id", "frame", "delay_ms")


def first_frame_scalars(report: DataFrame) -> DataFrame:
    """Outputs that are not images keep the value of frame 0."""
    return report.filter("frame = 0").drop("frame")


def to_image(p: DataFrame) -> DataFrame:
    return p.filter("frame = 0")


def to_images(parts: list[DataFrame]) -> DataFrame:
    """Flatten several pixel tables (stills or sequences) into one list of frames per image.

    Only per-part frame counts are aggregated; pixels get their new frame number by an offset.
    """
    tagged = reduce(DataFrame.union, [df.select(*PIXEL).withColumn("part", F.lit(i)) for i, df in enumerate(parts)])
    n = tagged.filter("x = 0 and y = 0").groupBy("image_id", "part").agg(F.count(F.lit(1)).cast("int").alias("n"))
    wide = n.groupBy("image_id").agg(*[F.sum(F.when(F.col("part") < i, F.col("n")).otherwise(F.lit(0))).alias(f"o{i}") for i in range(len(parts))])
    off = wide.select("image_id", F.posexplode(F.array(*[F.col(f"o{i}") for i in range(len(parts))])).alias("part", "off"))
    t = tagged.join(off, ["image_id", "part"])
    return t.select("image_id", (F.col("frame") + F.col("off")).cast("int").alias("frame"), *PIXEL[2:])


def map_frames(p: DataFrame, op) -> DataFrame:
    """Any image operator per frame: ``frame`` is part of every key, so this is plain application."""
    return p.transform(op)
