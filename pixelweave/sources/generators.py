"""Synthetic rasters on a table of canvases ``images(image_id, frame, w, h, ...)``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import clamp01, d, hash2, ifloor, jsround, u8
from ..schema import IMG, PIXEL


#: Rows of a canvas that stay together.
BAND = 64


def grid(images: DataFrame, w="w", h="h") -> DataFrame:
    """Every pixel position of every canvas.

    Rows are expanded first and re-spread by (image, ``BAND`` rows) before the columns are: one canvas of
    hundreds of megapixels becomes hundreds of tasks instead of one, and a small one stays together.
    """
    t = images.withColumns({"w": F.col(w).cast("int"), "h": F.col(h).cast("int")}).filter("w > 0 and h > 0")
    t = t.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    t = t.repartition(*IMG, F.shiftright("y", BAND.bit_length() - 1))
    return t.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("w") - 1)))


def _fill(g: DataFrame, channels: list[Column], keep=()) -> DataFrame:
    return g.select(*PIXEL[:6], *[ch.alias(n) for ch, n in zip(channels, "rgba")], *keep)


def solid(images: DataFrame, rgba) -> DataFrame:
    return _fill(grid(images), [u8(v) for v in rgba])


def ramp(g: DataFrame, c0, c1, t: Column, keep=()) -> DataFrame:
    g = g.withColumn("_t", t)
    return _fill(g, [u8(d(p) + d(q - p) * F.col("_t")) for p, q in zip(c0, c1)], keep)


def linear_gradient(images: DataFrame, c0, c1, horizontal: bool = True) -> DataFrame:
    pos, n = ("x", "w") if horizontal else ("y", "h")
    return ramp(grid(images), c0, c1, d(pos) / F.greatest(d(1), d(n) - 1))


def radial_gradient(images: DataFrame, c0, c1, mode="radial", radius=1.0, inner=0.5, angle=0.0, feather=0.0) -> DataFrame:
    return radial_over(grid(images), c0, c1, mode, radius, inner, angle, feather)


def radial_over(g: DataFrame, c0, c1, mode="radial", radius=1.0, inner=0.5, angle=0.0, feather=0.0, keep=()) -> DataFrame:
    """The gradient at the pixels of ``g``, whose columns ``keep`` stay."""
    unit = F.greatest(d(1e-6), F.least(d("w"), d("h")) / 2)
    dx, dy = d("x") + 0.5 - d("w") / 2, d("y") + 0.5 - d("h") / 2
    if mode == "conic":
        # atan2 here drops the sign of zero: the exact centre is half a turn
        bearing = F.when((dx == 0) & (dy == 0), d(math.pi)).otherwise(F.atan2(dx, -dy))
        turn = bearing / (math.pi * 2) + (-angle / 360)
        return ramp(g, c0, c1, (turn % d(1) + 1.0) % d(1), keep)
    g = g.withColumns({"_d": F.sqrt(dx * dx + dy * dy), "_u": unit})
    dist, unit = F.col("_d"), F.col("_u")
    r_out = unit * max(1e-6, radius)
    if mode == "radial":
        return ramp(g, c0, c1, clamp01(dist / r_out), keep)
    r_in = unit * max(0.0, inner)
    lo, hi = F.least(r_out, r_in), F.greatest(r_out, r_in)
    soft = max(0.0, feather)

    def step(edge: Column) -> Column:
        if soft <= 0:
            return F.when(dist >= edge, d(1)).otherwise(d(0))
        return clamp01((dist - edge) / (unit * soft) + 0.5)

    return ramp(g, c0, c1, step(lo) * (d(1) - step(hi)), keep)


def value_noise(images: DataFrame, scale: float, seed=0) -> DataFrame:
    """Seeded lattice noise; ``seed`` may be a number or a column of the canvas table."""
    s = max(1.0, float(scale))
    sd = F.lit(int(math.floor(seed))).cast("long") if isinstance(seed, (int, float)) else F.col(seed).cast("long")
    g = grid(images).withColumns({"_gx": d("x") / s, "_gy": d("y") / s, "_s": sd})
    g = g.withColumns({"_x0": ifloor("_gx"), "_y0": ifloor("_gy")})
    tx, ty = F.col("_gx") - F.col("_x0"), F.col("_gy") - F.col("_y0")

    def v(i: int, j: int) -> Column:
        return d(hash2(F.col("_x0") + i, F.col("_y0") + j, F.col("_s"))) / 4294967295.0

    g = g.withColumns(
        {"_tx": tx * tx * (d(3) - tx * 2), "_ty": ty * ty * (d(3) - ty * 2),
         "_a": v(0, 0), "_b": v(1, 0), "_c": v(0, 1), "_e": v(1, 1)}
    )
    top = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_tx")
    bot = F.col("_c") + (F.col("_e") - F.col("_c")) * F.col("_tx")
    g = g.withColumn("_v", u8(jsround((top + (bot - top) * F.col("_ty")) * 255.0)))
    return _fill(g, [F.col("_v"), F.col("_v"), F.col("_v"), F.lit(255)])


def histogram_image(hist: DataFrame, width: int = 256, height: int = 128) -> DataFrame:
    """Draw ``hist(image_id, frame, channel, bin, n)`` as additive bars.

    The 768 counters of an image fold into one row of three 256-slot maps before the canvas is
    expanded, so the drawing itself needs no join.
    """
    w, h = max(16, int(width)), max(16, int(height))
    side = hist.groupBy(*IMG).agg(
        *[
            F.map_from_entries(
                F.collect_list(F.when(F.col("channel") == ch, F.struct(F.col("bin"), F.col("n"))))
            ).alias(f"_{ch}")
            for ch in "rgb"
        ],
        F.greatest(F.lit(1).cast("long"), F.max("n")).alias("_max"),
    )
    # bar heights per column: one row per (image, column), then the column is filled downwards
    cols = side.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(w - 1))))
    slot = F.least(F.lit(255), ifloor(d("x") / w * 256.0))
    cols = cols.withColumn("_bin", slot)
    bar = {
        f"_h{ch}": jsround(d(F.coalesce(F.try_element_at(f"_{ch}", F.col("_bin")), F.lit(0).cast("long"))) / d("_max") * h)
        for ch in "rgb"
    }
    cols = cols.withColumns(bar).select(*IMG, "x", *bar)
    full = cols.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(h - 1))))
    up = F.lit(h) - F.col("y")
    paint = [
        (F.when(up <= F.col(f"_h{ch}"), F.lit(min(255, base + 200))).otherwise(F.lit(base))).alias(ch)
        for ch, base in (("r", 20), ("g", 20), ("b", 24))
    ]
    return full.select(*IMG, F.lit(w).alias("w"), F.lit(h).alias("h"), "x", "y", *paint, F.lit(255).alias("a"))
