"""Per-pixel colour: narrow projections that stay inside whole-stage codegen (no shuffle)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import (
    c, clamp01, d, js_round_py, jsround, luminance, rgb_to_hsv, u8, with_hsl, with_rgb_of_hsl,
)
from ..schema import RGB, RGBA


def _set(p: DataFrame, **cols: Column) -> DataFrame:
    return p.withColumns(cols)


def _each(p: DataFrame, fn, channels=RGB) -> DataFrame:
    return p.withColumns({ch: fn(F.col(ch), i) for i, ch in enumerate(channels)})


def grey(p: DataFrame, v: Column, alpha: Column | None = None) -> DataFrame:
    """Write one value to r, g, b; opaque unless an alpha is given."""
    return p.withColumn("_v", v).withColumns(
        {"r": F.col("_v"), "g": F.col("_v"), "b": F.col("_v"), "a": F.lit(255) if alpha is None else alpha}
    ).drop("_v")


def bw(p: DataFrame, on: Column) -> DataFrame:
    return grey(p, F.when(on, F.lit(255)).otherwise(F.lit(0)))


def invert(p: DataFrame, r=True, g=True, b=True, a=False) -> DataFrame:
    flags = dict(r=r, g=g, b=b, a=a)
    return p.withColumns({ch: F.lit(255) - F.col(ch) for ch in RGBA if flags[ch]}) if any(flags.values()) else p


def grayscale(p: DataFrame) -> DataFrame:
    return grey(p, jsround(luminance()), F.col("a"))


def brightness_contrast(p: DataFrame, brightness: float, contrast: float) -> DataFrame:
    add, k = brightness * 2.55, contrast * 2.55
    f = (259 * (k + 255)) / (255 * (259 - k))
    return _each(p, lambda v, i: u8(d(f) * (v - 128) + 128.0 + add))


def threshold(p: DataFrame, level, invert: bool = False) -> DataFrame:
    on = luminance() >= d(level)
    return bw(p, ~on if invert else on)


def levels(p: DataFrame, black: float, white: float, gamma: float) -> DataFrame:
    rng, inv = max(1.0, white - black), 1 / max(0.01, gamma)
    return _each(p, lambda v, i: u8(jsround(F.pow(clamp01((d(v) - black) / rng), d(inv)) * 255.0)))


def curve_values(points: list[tuple[float, float]]) -> list[int]:
    """The 256-entry look-up table of a handful of control points (a driver-side constant)."""
    pts = sorted(
        ((min(255.0, max(0.0, x)), min(255.0, max(0.0, y))) for x, y in points if math.isfinite(x) and math.isfinite(y)),
        key=lambda q: q[0],
    )
    if not pts:
        return list(range(256))
    out = []
    for i in range(256):
        if i <= pts[0][0]:
            out.append(int(pts[0][1]))
        elif i >= pts[-1][0]:
            out.append(int(pts[-1][1]))
        else:
            j = max(k for k, q in enumerate(pts) if q[0] <= i)
            (x0, y0), (x1, y1) = pts[j], pts[j + 1]
            out.append(js_round_py(y0 + (y1 - y0) * ((i - x0) / (x1 - x0) if x1 != x0 else 0.0)))
    return out


def curve_lut(points: DataFrame, key: str = "curve_id") -> DataFrame:
    """Look-up tables of MANY curves: points(key, ord, px, py) -> (key, v, lut), 256 rows a curve.

    Each control point owns the integers up to the next point, so a curve is one window over its
    own (few) points followed by an explode; there is no range join.
    """
    w = Window.partitionBy(key).orderBy("px", "ord")
    full = Window.partitionBy(key).orderBy("px", "ord").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    pts = points.select(key, "ord", F.greatest(d(0), F.least(d(255), d("px"))).alias("px"),
                        F.greatest(d(0), F.least(d(255), d("py"))).alias("py"))
    seg = pts.select(
        key, "px", "py",
        F.lead("px").over(w).alias("nx"), F.lead("py").over(w).alias("ny"), F.row_number().over(w).alias("k"),
        F.first("px").over(full).alias("x0"), F.first("py").over(full).alias("y0"),
        F.last("px").over(full).alias("xn"), F.last("py").over(full).alias("yn"),
    )
    lo = F.when(F.col("k") == 1, F.lit(0)).otherwise(F.ceil("px")).cast("int")
    hi = F.when(F.col("nx").isNull(), F.lit(255)).otherwise(F.ceil("nx") - 1).cast("int")
    seg = seg.withColumns({"lo": lo, "hi": hi}).filter("lo <= hi")
    rows = seg.withColumn("v", F.explode(F.sequence("lo", "hi")))
    t = F.when(F.col("nx") == F.col("px"), d(0)).otherwise((F.col("v") - F.col("px")) / (F.col("nx") - F.col("px")))
    lut = (
        F.when(F.col("v") <= F.col("x0"), F.col("y0").cast("int"))
        .when(F.col("v") >= F.col("xn"), F.col("yn").cast("int"))
        .otherwise(jsround(F.col("py") + (F.col("ny") - F.col("py")) * t))
    )
    return rows.select(key, "v", lut.alias("lut"))


def apply_curve(p: DataFrame, points: list[tuple[float, float]], channel: str = "rgb") -> DataFrame:
    lut = F.lit(curve_values(points))
    hit = [ch for ch in RGB if channel == "rgb" or channel == ch]
    return p.withColumns({ch: F.get(lut, F.col(ch)).cast("int") for ch in hit})


def opacity(p: DataFrame, factor: float) -> DataFrame:
    return _set(p, a=u8(d("a") * max(0.0, min(1.0, factor))))


def tint(p: DataFrame, color) -> DataFrame:
    return _each(p, lambda v, i: u8(d(v) * float(color[i]) / 255.0))


def gradient_map(p: DataFrame, low, high) -> DataFrame:
    t = p.withColumn("_t", luminance() / 255.0)
    return _each(t, lambda v, i: u8(d(low[i]) + d(high[i] - low[i]) * F.col("_t"))).drop("_t")


def hue_saturation(p: DataFrame, hue_degrees: float, saturation: float) -> DataFrame:
    t = with_hsl(p).withColumn("_h", (F.col("_h") + hue_degrees / 360) % d(1.0))
    t = t.withColumns({"_h": F.when(F.col("_h") < 0, F.col("_h") + 1.0).otherwise(F.col("_h")), "_s": clamp01(F.col("_s") * saturation)})
    return with_rgb_of_hsl(t)


def white_balance(p: DataFrame, temperature: float, green: float) -> DataFrame:
    k = (1 + temperature / 200, 1 + green / 200, 1 - temperature / 200)
    return _each(p, lambda v, i: u8(d(v) * k[i]))


def posterize(p: DataFrame, n: float) -> DataFrame:
    step = 255 / (max(2, math.floor(n)) - 1)
    return _each(p, lambda v, i: jsround(jsround(d(v) / step) * d(step)))


def alpha_cleanup(p: DataFrame, cut: float, mode: str = "transparent") -> DataFrame:
    low = F.col("a") < cut
    if mode == "transparent":
        return _set(p, a=F.when(low, F.lit(0)).otherwise(F.col("a")))
    v = F.lit(255 if mode == "white" else 0)
    cols = {ch: F.when(low, v).otherwise(F.col(ch)) for ch in RGB}
    return p.withColumns({**cols, "a": F.when(low, F.lit(255)).otherwise(F.col("a"))})


def flatten(p: DataFrame, background) -> DataFrame:
    t = p.withColumn("_k", d("a") / 255.0)
    k = F.col("_k")
    t = _each(t, lambda v, i: u8(d(v) * k + d(background[i]) * (d(1) - k)))
    return t.withColumn("a", F.lit(255)).drop("_k")


def extract_channel(p: DataFrame, channel: str) -> DataFrame:
    if channel in RGBA:
        return grey(p, F.col(channel))
    if channel == "lum":
        return grey(p, jsround(luminance()))
    h, s, v = rgb_to_hsv()
    return grey(p, u8(jsround({"hue": h, "sat": s, "val": v}[channel] * 255.0)))


def colour_distance(color) -> Column:
    """Largest per-channel distance; ``color`` holds numbers or columns."""
    return F.greatest(*[F.abs(F.col(ch) - c(color[i])) for i, ch in enumerate(RGB)])


def chroma_key(p: DataFrame, color, tolerance: float) -> DataFrame:
    return bw(p, colour_distance(color) <= tolerance)


def remove_color(p: DataFrame, color, tolerance: float) -> DataFrame:
    return _set(p, a=F.when(colour_distance(color) <= tolerance, F.lit(0)).otherwise(F.col("a")))


def vignette(p: DataFrame, strength: float) -> DataFrame:
    s = max(0.0, min(1.0, strength))
    cx, cy = (d("w") - 1) / 2, (d("h") - 1) / 2
    span = F.sqrt(cx * cx + cy * cy)
    span = F.when(span == 0, d(1)).otherwise(span)
    dx, dy = d("x") - cx, d("y") - cy
    dist = F.sqrt(dx * dx + dy * dy) / span
    t = p.withColumn("_f", d(1) - d(s) * dist * dist)
    return _each(t, lambda v, i: u8(d(v) * F.col("_f"))).drop("_f")
