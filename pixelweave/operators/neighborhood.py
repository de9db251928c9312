"""Neighbourhood filters: windows inside row bands (see ``bands``), one shuffle each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, clamp, d, jsround, luminance, rgb_to_hsv, u8
from ..schema import IMG, PIXEL, POS, RGB, RGBA, SIZE, large
from .bands import AXES, edge_sum, extreme, in_bands, out_of_bands, shift_names, shifted
from .color import grey
from .tiles import RIM, back, beside, channels, coloured, dealt, extremes, lines, luminances, matched, on_tiles, packed_colour, pixels, within


def _blur_in_bands(t: DataFrame, r: int) -> DataFrame:
    """Premultiply, blur rows, blur columns, unpremultiply; a byte store after each step."""
    win = float(2 * r + 1)
    t = t.withColumns({ch: u8(d(ch) * d("a") / 255.0) for ch in RGB})
    for axis in ("row", "column"):
        t = edge_sum(t, RGBA, r, axis)
        t = t.withColumns({ch: u8(d(ch) / win) for ch in RGBA})
    a = F.col("a")
    return t.withColumns({ch: F.when(a > 0, u8(d(ch) * 255.0 / d(F.greatest(a, F.lit(1))))).otherwise(F.lit(0)) for ch in RGB})


def box_blur(p: DataFrame, radius: float) -> DataFrame:
    r = max(0, math.floor(radius))
    if r == 0:
        return p
    return out_of_bands(_blur_in_bands(in_bands(p, r), r), r).select(*PIXEL)


def sharpen(p: DataFrame, amount: float) -> DataFrame:
    """v + k (v - blur(v)); the original channels ride along in the same shuffle."""
    if amount <= 0:
        return p
    t = in_bands(p, 1).withColumns({f"_{ch}": F.col(ch) for ch in RGBA})
    t = out_of_bands(_blur_in_bands(t, 1), 1)
    cols = {ch: u8(d(f"_{ch}") + d(amount) * (d(f"_{ch}") - d(ch))) for ch in RGB}
    return t.withColumns({**cols, "a": F.col("_a")}).select(*PIXEL)


def _morph(p: DataFrame, radius: float, ops: list[str]) -> DataFrame:
    """Square-element morphology; a whole open/close chain shares one shuffle and one halo.

    The reach is not capped at the image side: a window past the border sees the border only. Narrow reach works on tiles.
    """
    r = max(0, math.floor(radius))
    if r == 0:
        return p
    halo = r * len(ops)
    if halo <= RIM:
        return pixels(dealt(p, halo).withColumn("_px", _extremes(r, ops)("_px")))
    t = in_bands(p, halo)
    for op in ops:
        for axis in ("row", "column"):
            t = extreme(t, RGBA, r, axis, op)
    return out_of_bands(t, halo).select(*PIXEL)


def _extremes(r: int, ops: list[str]):
    def step(tile: np.ndarray, px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, order, column = lines(tile, px)
        v = channels(px)
        for op in ops:
            best = np.maximum if op == "max" else np.minimum
            v = extremes(v, row, r, best)
            v = back(extremes(v[order], column, r, best), order)
        return within(tile, coloured(px, v))

    return on_tiles(step)


def dilate(p: DataFrame, radius: float) -> DataFrame:
    return _morph(p, radius, ["max"])


def erode(p: DataFrame, radius: float) -> DataFrame:
    return _morph(p, radius, ["min"])


def open_close(p: DataFrame, radius: float, op: str = "open") -> DataFrame:
    return _morph(p, radius, ["min", "max"] if op == "open" else ["max", "min"])


def _sobel(tile: np.ndarray, px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitude of the 3x3 clamped gradient: row neighbours first, then each by column."""
    row, order, column = lines(tile, px)
    o = luminances(px)
    v = {}
    for i, side in zip((-1, 0, 1), (beside(o, row)[0], o, beside(o, row)[1])):
        side = side[order]
        v[i, -1], v[i, 1] = beside(side, column)
        v[i, 0] = side
    gx = -v[-1, -1] + v[1, -1] - v[-1, 0] * 2 + v[1, 0] * 2 - v[-1, 1] + v[1, 1]
    gy = -v[-1, -1] - v[0, -1] * 2 - v[1, -1] + v[-1, 1] + v[0, 1] * 2 + v[1, 1]
    mag = np.rint(np.clip(back(np.sqrt(gx * gx + gy * gy), order), 0.0, 255.0)).astype(np.uint8)
    return within(tile, coloured(px, np.stack([mag, mag, mag, np.full_like(mag, 255)], axis=1)))


def sobel(p: DataFrame) -> DataFrame:
    return pixels(dealt(p, 1).withColumn("_px", on_tiles(_sobel)("_px")))


def _packed_normal(t: DataFrame, nx: Column, ny: Column) -> DataFrame:
    """Unit normal of (nx, ny, 1) packed into bytes."""
    t = t.withColumns({"_nx": nx, "_ny": ny})
    t = t.withColumn("_len", F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + 1.0))
    pack = lambda e: u8((e / F.col("_len") * 0.5 + 0.5) * 255.0)
    return t.withColumns({"r": pack(F.col("_nx")), "g": pack(F.col("_ny")), "b": pack(d(1)), "a": F.lit(255)})


def _gradient(p: DataFrame, value: Column, keep_bands: bool = False) -> DataFrame:
    """Columns _dx, _dy: next minus previous value along each axis, edges clamped."""
    t = in_bands(p, 1).withColumn("_v", value)
    t = shifted(t, ["_v"], 1, "row").withColumn("_dx", F.col("_v_p1") - F.col("_v_m1")).drop("_v_m1", "_v_p1")
    t = shifted(t, ["_v"], 1, "column").withColumn("_dy", F.col("_v_p1") - F.col("_v_m1")).drop("_v_m1", "_v_p1")
    return out_of_bands(t, 1)


def normal_map(p: DataFrame, strength: float = 1.0) -> DataFrame:
    t = _gradient(p, luminance() / 255.0)
    return _packed_normal(t, -(F.col("_dx") * float(strength)), -(F.col("_dy") * float(strength))).select(*PIXEL)


def highlight_extract(p: DataFrame, radius: float = 8, gain: float = 2, bias: float = 0, sat_rejection: float = 1) -> DataFrame:
    """Locally bright and desaturated pixels: positive high-pass of luminance, weighted by (1-s)^k."""
    r = max(0, math.floor(radius))
    k = max(0.0, sat_rejection)
    _, sat, _ = rgb_to_hsv()
    t = p.withColumns({"_lum": u8(luminance()), "_sat": sat}) if k > 0 else p.withColumn("_lum", u8(luminance()))
    if r > 0:
        t = in_bands(t.drop(*RGBA), r).withColumn("_base", F.col("_lum"))
        for axis in ("row", "column"):
            t = edge_sum(t, ["_base"], r, axis)
            t = t.withColumn("_base", u8(d("_base") / float(2 * r + 1)))
        t = out_of_bands(t, r)
    else:
        t = t.withColumn("_base", F.col("_lum"))
    spec = F.greatest(d(0), (d("_lum") - d("_base") - float(bias)) * float(gain))
    if k > 0:
        spec = spec * F.pow(d(1) - F.col("_sat"), d(k))
    return grey(t, u8(spec)).select(*PIXEL)


def gaussian_kernel(sigma: float) -> list[float]:
    r = max(1, math.ceil(sigma * 3))
    k = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-r, r + 1)]
    s = sum(k)
    return [v / s for v in k]


def gaussian_heights(p: DataFrame, sigma: float = 0.0) -> DataFrame:
    """(image_id, frame, w, h, x, y, height): luminance 0..1, optionally Gaussian-smoothed."""
    lum01 = luminance() / 255.0
    if sigma <= 0:
        return p.select(*PIXEL[:6], lum01.alias("height"))
    k = gaussian_kernel(sigma)
    r = (len(k) - 1) // 2
    t = in_bands(p.select(*PIXEL[:6], lum01.alias("height")), r)
    for axis in ("row", "column"):
        t = shifted(t, ["height"], r, axis)
        names = [f"height_m{i}" for i in range(r, 0, -1)] + ["height"] + [f"height_p{i}" for i in range(1, r + 1)]
        acc = F.col(names[0]) * k[0]
        for n, kv in zip(names[1:], k[1:]):
            acc = acc + F.col(n) * kv
        t = t.withColumn("height", acc).drop(*shift_names(["height"], r))
    return out_of_bands(t, r)


def smoothing_radius(longest_side: int, fraction: float) -> int:
    return math.floor(longest_side * max(0.0, fraction) + 0.5)


RELIEF_SCALE = 0.12  # fixed value: displayed height per unit of relief


def smooth_normal_map(p: DataFrame, aspect: float, relief: float, radius: int) -> DataFrame:
    """Low-pass the height field (no byte store), then pack its slopes as normals.

    Luminance is held as exact integer thousandths, so the two blurs are integer sums and a flat
    area stays exactly flat.
    """
    milli = F.lit(299) * F.col("r") + F.lit(587) * F.col("g") + F.lit(114) * F.col("b")
    halo = radius + 1
    t = in_bands(p, halo).withColumn("_v", milli.cast("long"))
    scale = 255000.0
    if radius >= 1:
        for axis in ("row", "column"):
            t = edge_sum(t, ["_v"], radius, axis)
        scale *= (2 * radius + 1) ** 2
    t = shifted(t, ["_v"], 1, "row").withColumn("_gx", d(F.col("_v_p1") - F.col("_v_m1")) / scale).drop("_v_m1", "_v_p1")
    t = shifted(t, ["_v"], 1, "column").withColumn("_gy", d(F.col("_v_p1") - F.col("_v_m1")) / scale).drop("_v_m1", "_v_p1")
    t = out_of_bands(t, halo)
    sx, sy = (1.0, 1 / aspect) if aspect >= 1 else (aspect, 1.0)
    amp = relief * RELIEF_SCALE
    ax, ay = d(amp) * (d("w") - 1) / (4 * sx), d(amp) * (d("h") - 1) / (4 * sy)
    return _packed_normal(t, -F.col("_gx") * ax, F.col("_gy") * ay).select(*PIXEL)


def gloss_preview(art: DataFrame, gloss: DataFrame | None = None, height: DataFrame | None = None, azimuth=135.0,
                  elevation=45.0, shininess=32.0, intensity=1.0, matte=0.0, height_strength=2.0, same_size=False) -> DataFrame:
    """Blinn-Phong highlight from the height normals, screened over the art where the mask is on."""
    from .compose import KEY, fit_to

    el, az = math.radians(elevation), math.radians(azimuth)
    light = (math.cos(el) * math.cos(az), math.cos(el) * math.sin(az), math.sin(el))
    hv = (light[0], light[1], light[2] + 1)
    n = math.sqrt(sum(v * v for v in hv)) or 1.0
    hx, hy, hz = (v / n for v in hv)
    t = art
    if gloss is not None:
        g = gloss if same_size else fit_to(gloss, art)
        t = matched(t, g)
        on = packed_colour("_other")
        t = t.withColumn("_gv", F.coalesce(luminance(on["r"], on["g"], on["b"]) / 255.0, d(0))).drop("_other")
    else:
        t = t.withColumn("_gv", d(0))
    if height is not None:
        m = height if same_size else fit_to(height, art)
        m = _gradient(m, luminance() / 255.0)
        m = m.withColumns({"_nx": -(F.col("_dx") * float(height_strength)), "_ny": -(F.col("_dy") * float(height_strength))})
        m = m.withColumn("_len", F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + 1.0))
        dot = F.col("_nx") / F.col("_len") * hx + F.col("_ny") / F.col("_len") * hy + d(1) / F.col("_len") * hz
        t = t.join(large(m.select(*KEY, F.greatest(d(0), dot).alias("_dot"))), KEY, "left")
        t = t.withColumn("_dot", F.coalesce("_dot", d(max(0.0, hz))))
    else:
        t = t.withColumn("_dot", d(max(0.0, hz)))
    t = t.withColumns({"_w": clamp(F.pow("_dot", d(shininess)) * float(intensity) * F.col("_gv"), 0, 1),
                       "_mf": d(1) - d(matte) * (d(1) - F.col("_gv"))})
    base = lambda ch: d(ch) * F.col("_mf")
    return t.select(*PIXEL[:6], *[u8(base(ch) + (d(255) - base(ch)) * F.col("_w")).alias(ch) for ch in RGB], "a")


DIAGONAL = math.sqrt(2)


def _spread(t: DataFrame, line: Column, at: Column, diagonal: bool) -> DataFrame:
    """Straight and diagonal steps (n, m) to the nearest source, lowered by steps along one family of lines.

    Along a line a source at q costs cost(q) + c |at - q|. The least of cost - c q over what lies before a pixel names the best source
    there, whatever its distance: one running minimum each way. Steps are counted, so lengths carry no rounding.
    """
    c = DIAGONAL if diagonal else 1.0
    cost = F.col("_n") + F.lit(DIAGONAL) * F.col("_m")
    t = t.withColumns({"_line": line, "_at": at}).withColumn("_cost", cost)
    every = Window.partitionBy(*IMG, "_line")

    def best(sign: float, order: Column) -> Column:
        own = F.when(F.col("_n").isNotNull(), F.struct((F.col("_cost") - F.lit(sign * c) * F.col("_at")).alias("k"), F.col("_n").alias("n"), F.col("_m").alias("m"), F.col("_at").alias("q")))
        return F.min(own).over(every.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    t = t.withColumns({"_f": best(1.0, F.col("_at").asc()), "_b": best(-1.0, F.col("_at").desc())})
    before, behind = F.col("_f.k") + F.lit(c) * F.col("_at"), F.col("_b.k") - F.lit(c) * F.col("_at")
    src = F.when(F.col("_b").isNull() | (before <= behind), F.col("_f")).otherwise(F.col("_b"))
    t = t.withColumn("_src", src)
    steps = F.abs(F.col("_at") - F.col("_src.q"))
    n, m = F.col("_src.n"), F.col("_src.m")
    return t.withColumns({"_n": n if diagonal else n + steps, "_m": m + steps if diagonal else m}).drop("_line", "_at", "_cost", "_f", "_b", "_src")


def distance_to_opaque(p: DataFrame, alpha_threshold: float = 0, max_distance: float = 8) -> DataFrame:
    """(…, dist): octile distance to the nearest pixel with more alpha; null beyond ``max_distance``.

    A shortest way in the octile metric goes along a row or a column and along one diagonal, inside the rectangle between its
    ends. So scans along rows, columns and both diagonals (``_spread``) one after another find it: the cost does not
    depend on the reach. Pixels are dealt out by line, and no task holds more of one image than its lines.
    """
    on = F.col("a") > alpha_threshold
    t = p.withColumns({"_n": F.when(on, F.lit(0)), "_m": F.when(on, F.lit(0))})
    t = _spread(t, F.col("y"), F.col("x"), False)
    t = _spread(t, F.col("x"), F.col("y"), False)
    t = _spread(t, F.col("x") - F.col("y"), F.col("y"), True)
    t = _spread(t, F.col("x") + F.col("y"), F.col("y"), True)
    dist = F.col("_n") + F.lit(DIAGONAL) * F.col("_m")
    return t.withColumn("dist", F.when(dist <= max_distance, dist)).drop("_n", "_m")


def outline(p: DataFrame, thickness: float, color, alpha_threshold: float = 0) -> DataFrame:
    """Colour the pixels within a distance of the shape, then lay the original on top."""
    from .compose import composite

    if thickness >= 1:
        t = distance_to_opaque(p, alpha_threshold, thickness)
        ring = (F.col("a") <= alpha_threshold) & F.col("dist").isNotNull()
    else:
        t, ring = p, F.lit(False)
    under = [F.when(ring, F.lit(color[i])).otherwise(F.lit(0)) for i in range(4)]
    out = composite([F.col(ch) for ch in RGBA], under)
    seen = F.col("a") > 0
    return t.select(*PIXEL[:6], *[F.when(seen, out[i]).otherwise(under[i]).alias(ch) for i, ch in enumerate(RGBA)])
