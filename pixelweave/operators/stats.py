"""Histograms, thresholds, ranges and reports.

Counting is always partial-then-final aggregation, so one image holding a third of all pixels
costs 256 shuffle rows per map task, not its pixels.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clamp01, d, jsround, luminance, u8
from ..schema import IMG, RGB
from .color import bw, threshold
from .tiles import coloured, luminances, on_tiles_with, pixels, remembered, with_levels


def histogram(p: DataFrame) -> DataFrame:
    """(image_id, frame, channel, bin, n); transparent pixels do not vote."""
    t = p.filter("a <> 0").select(*IMG, F.expr("stack(3, 'r', r, 'g', g, 'b', b) as (channel, bin)"))
    return t.groupBy(*IMG, "channel", "bin").agg(F.count(F.lit(1)).alias("n"))


def luminance_histogram(p: DataFrame) -> DataFrame:
    t = p.filter("a <> 0").select(*IMG, jsround(luminance()).alias("bin"))
    return t.groupBy(*IMG, "bin").agg(F.count(F.lit(1)).alias("n"))


def otsu_level(hist: DataFrame) -> DataFrame:
    """(image_id, frame, level). At most 256 counters per image reach the window."""
    run = Window.partitionBy(*IMG).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*IMG).orderBy("bin").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    weighted = F.col("bin").cast("long") * F.col("n")
    t = hist.select(
        *IMG, "bin",
        F.sum("n").over(run).alias("wb"), F.sum(weighted).over(run).alias("sb"),
        F.sum("n").over(full).alias("n_all"), F.sum(weighted).over(full).alias("s_all"),
    )
    wf = F.col("n_all") - F.col("wb")
    gap = d("sb") / d("wb") - d(F.col("s_all") - F.col("sb")) / d(wf)
    between = F.when(wf > 0, d("wb") * d(wf) * gap * gap)
    best = t.withColumn("between", between).groupBy(*IMG).agg(
        F.max(F.when(F.col("between").isNotNull(), F.struct(F.col("between"), (-F.col("bin")).alias("neg")))).alias("m")
    )
    return best.select(*IMG, F.least(F.lit(255), F.coalesce(-F.col("m.neg"), F.lit(127)) + 1).alias("level"))


def percentile_level(hist: DataFrame, percentile: float) -> DataFrame:
    """Highest value whose count from the top reaches the share."""
    frac = max(0.0, min(100.0, percentile)) / 100
    if frac == 0:
        return hist.select(*IMG).distinct().withColumn("level", F.lit(255))
    top = Window.partitionBy(*IMG).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    full = Window.partitionBy(*IMG).orderBy(F.desc("bin")).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    t = hist.select(*IMG, "bin", F.sum("n").over(top).alias("acc"), F.sum("n").over(full).alias("total"))
    return t.groupBy(*IMG).agg(
        F.coalesce(F.max(F.when(F.col("acc") >= d(frac) * F.col("total"), F.col("bin"))), F.lit(0)).alias("level")
    )


def auto_level(p: DataFrame, mode: str = "otsu", percentile: float = 20.0) -> DataFrame:
    hist = luminance_histogram(p)
    return otsu_level(hist) if mode == "otsu" else percentile_level(hist, percentile)


def _over(invert: bool):
    """``threshold`` of packed pixels."""
    def step(tile: np.ndarray, px: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = np.where((luminances(px) >= level) != invert, 255, 0).astype(np.uint8)
        return tile, coloured(px, np.stack([v, v, v, np.full_like(v, 255)], axis=1))

    return on_tiles_with(step)


def auto_threshold(p: DataFrame, mode: str = "otsu", percentile: float = 20.0, invert: bool = False) -> DataFrame:
    """Binarise each image at its own level; an image without visible pixels uses 128.

    The level table is joined back with a plain equi-join: AQE broadcasts it when its measured
    size allows and otherwise splits skewed pixel partitions. Pixels that come from tiles stay packed in it.
    """
    packed = remembered(p)
    if packed is not None:
        t = with_levels(packed, auto_level(p, mode, percentile)).withColumn("level", F.coalesce("level", F.lit(128)))
        return pixels(t.withColumn("_px", _over(invert)("_px", "level")).drop("level"))
    t = p.join(auto_level(p, mode, percentile), IMG, "left").withColumn("level", F.coalesce("level", F.lit(128)))
    return threshold(t, F.col("level"), invert).select(p.columns)


def normalize(p: DataFrame) -> DataFrame:
    """Stretch every channel to 0..255 by its visible range."""
    seen = F.col("a") != 0
    stats = p.groupBy(*IMG).agg(
        *[f(F.when(seen, F.col(ch))).alias(f"_{n}{ch}") for ch in RGB for n, f in (("lo", F.min), ("hi", F.max))]
    )
    t = p.join(stats, IMG, "left")

    def stretch(ch: str) -> Column:
        lo, hi = F.col(f"_lo{ch}"), F.col(f"_hi{ch}")
        scale = d(255) / d(hi - lo)
        return F.when(hi > lo, u8(d(F.col(ch) - lo) * scale)).otherwise(F.col(ch))

    return t.withColumns({ch: stretch(ch) for ch in RGB}).select(p.columns)


def coverage(m: DataFrame) -> DataFrame:
    """Share of pixels that are on, and whether it lies in the printable 5-30 % band."""
    on = F.when(luminance() / 255.0 >= 0.5, F.lit(1)).otherwise(F.lit(0))
    t = m.groupBy(*IMG).agg(F.sum(on).alias("n_on"), F.count(F.lit(1)).alias("n"))
    share = d("n_on") / d("n")
    return t.select(*IMG, "n_on", "n", share.alias("coverage"), share.between(0.05, 0.30).alias("in_band"))


def mesh_bounds(tris: DataFrame) -> DataFrame:
    """Per mesh: min, max, centre and size of every axis; an empty mesh has no row."""
    aggs = []
    for k in "xyz":
        corners = [F.col(f"{v}{k}") for v in "abc"]
        aggs += [F.min(F.least(*corners)).alias(f"min_{k}"), F.max(F.greatest(*corners)).alias(f"max_{k}")]
    t = tris.groupBy("mesh_id").agg(*aggs)
    return _extent(t, ["mesh_id"])


def _extent(t: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*t.columns]
    for k in "xyz":
        lo, hi = F.col(f"min_{k}"), F.col(f"max_{k}")
        t = t.withColumns({f"centre_{k}": (lo + hi) / 2, f"size_{k}": hi - lo})
    return t.select(*keys, *[x for x in t.columns if x not in keys])


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), d(0)).alias(name)


def mesh_bounds_total(tris: DataFrame) -> DataFrame:
    """Bounds of the whole table as one mesh; zeros when it is empty."""
    aggs = []
    for k in "xyz":
        corners = [F.col(f"{v}{k}") for v in "abc"]
        aggs += [F.min(F.least(*corners)).alias(f"min_{k}"), F.max(F.greatest(*corners)).alias(f"max_{k}")]
    t = tris.agg(*aggs)
    return _extent(t.select(*[_zero(x) for x in t.columns]), [])


def cloud_bounds(splats: DataFrame, extra: list[Column] | None = None) -> DataFrame:
    aggs = []
    for k in "xyz":
        aggs += [F.min(f"p{k}").alias(f"min_{k}"), F.max(f"p{k}").alias(f"max_{k}")]
    t = splats.groupBy("cloud_id").agg(*aggs, *(extra or []))
    t = _extent(t, ["cloud_id"])
    sx, sy, sz = (F.col(f"size_{k}") for k in "xyz")
    return t.withColumn("radius", F.sqrt(sx * sx + sy * sy + sz * sz) / 2)


def mesh_report(tris: DataFrame) -> DataFrame:
    """Triangle count, extents and which colour the mesh brings along."""
    flags = [
        F.max(F.col(c).isNotNull()).alias(n) if c in tris.columns else F.lit(False).alias(n)
        for c, n in (("uv", "has_uv"), ("rgb", "has_colour"))
    ]
    t = tris.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("triangles"), *flags)
    return t.join(mesh_bounds(tris), "mesh_id")


def cloud_report(splats: DataFrame, dropped: str | None = None) -> DataFrame:
    """Count, dropped count, extents, centre and radius in one pass."""
    drop = F.sum(dropped) if dropped else F.lit(0).cast("long")
    return cloud_bounds(splats, [F.count(F.lit(1)).alias("n"), F.coalesce(drop, F.lit(0)).alias("dropped")])


def fill_report(warped: DataFrame) -> DataFrame:
    """Share of warped pixels that were invented, and the longest run of them on any scanline.

    ``warped`` holds (image_id, frame, x, y, filled). Islands are found per scanline.
    """
    line = Window.partitionBy(*IMG, "y").orderBy("x")
    hit = F.when(F.col("filled"), F.lit(1)).otherwise(F.lit(0))
    t = warped.withColumn("_real", F.sum(F.lit(1) - hit).over(line))
    runs = t.groupBy(*IMG, "y", "_real").agg(F.sum(hit).alias("run"), F.count(F.lit(1)).alias("n"))
    t = runs.groupBy(*IMG).agg(F.sum("run").alias("n_filled"), F.sum("n").alias("n"), F.max("run").alias("longest"))
    return t.select(*IMG, "n_filled", "n", (d("n_filled") / d("n")).alias("share"), "longest")
