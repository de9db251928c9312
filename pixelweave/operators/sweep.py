"""Parameter sweeps over the lens and viewing model: one row per settings combination.

Settings columns: width_mm, ppi, lpi, height_mm, ri and optionally profile ('circle' / 'ellipse') and
focus ('axis' / 'cone').
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, d, ifloor, jsround

CONE_FRACTIONS = [0.0, 0.25, 0.5, 0.75, 1.0]  # fixed values: parts of the half cone that are tried
MAX_POPOUT = 0.25  # fixed value: share of the viewing distance a picture may stand in front
MAX_STEP_LENSLETS = 1.5  # fixed value: largest comfortable movement per view


class ColumnMath:
    """The few functions the shared formulas need, on columns; the ``math`` module is the scalar twin."""

    sin, cos, tan, asin, atan2, sqrt = F.sin, F.cos, F.tan, F.asin, F.atan2, F.sqrt


def conic_sag(r: Column, radius: Column, k: Column) -> Column:
    big = F.greatest(d(1e-9), radius)
    disc = d(1) - (k + 1.0) * (r * r) / (big * big)
    return r * r / (big * (F.sqrt(F.greatest(d(0), disc)) + 1.0))


def conic_slope(r: Column, radius: Column, k: Column) -> Column:
    big = F.greatest(d(1e-9), radius)
    disc = d(1) - (k + 1.0) * r * r / (big * big)
    return r / (big * F.sqrt(F.greatest(d(1e-12), disc)))


def _index(ri="ri") -> Column:
    return F.greatest(d(1.0001), d(ri))


def _height(h="height_mm") -> Column:
    return F.greatest(d(1e-6), d(h))


def _axial(s: DataFrame) -> DataFrame:
    """Everything that does not depend on the chosen radius."""
    n, h = _index(), _height()
    profile = F.col("profile") if "profile" in s.columns else F.lit("circle")
    s = s.withColumns({
        "pitch_mm": d(25.4) / F.greatest(d(1e-6), d("lpi")), "pitch_px": F.greatest(d(1e-6), d("ppi")) / F.greatest(d(1e-6), d("lpi")),
        "conic_k": F.when(profile == "ellipse", d(-1) / (n * n)).otherwise(d(0)),
    })
    half, reach = F.col("pitch_mm") / 2, F.sqrt(F.col("conic_k") + 1.0)
    wanted = h * (n - 1) / n
    sin_air = F.least(d(1), n * (half / F.sqrt(half * half + h * h)))
    return s.withColumns({
        "feasible": wanted >= reach * half, "min_height_mm": n * reach * F.col("pitch_mm") / ((n - 1) * 2),
        "axial_radius_mm": F.when(wanted >= reach * half, wanted).otherwise(reach * half),
        "view_angle_deg": F.asin(sin_air) * (180 / math.pi) * 2,
    })


def lens_geometry(settings: DataFrame) -> DataFrame:
    """Adds pitch, radius, sag, base, focus, total height, feasibility and viewing cone."""
    s = _axial(settings)
    if "focus" in s.columns:
        cone = (F.col("focus") == "cone") & F.col("feasible")
        tuned = best_radius(settings.filter("focus = 'cone'")).filter(cone).withColumnRenamed("best_radius_mm", "radius_mm")
        s = s.filter(~cone).withColumn("radius_mm", F.col("axial_radius_mm")).unionByName(tuned)
    else:
        s = s.withColumn("radius_mm", F.col("axial_radius_mm"))
    n, h = _index(), _height()
    s = s.withColumn("sag_mm", conic_sag(F.col("pitch_mm") / 2, F.col("radius_mm"), F.col("conic_k")))
    s = s.withColumn("base_mm", F.greatest(d(0), h - F.col("sag_mm")))
    return s.withColumns({"focus_mm": n * F.col("radius_mm") / (n - 1), "total_mm": F.col("base_mm") + F.col("sag_mm")})


def with_landing(t: DataFrame, rays: int, radius: str) -> DataFrame:
    """Adds ``_x``: where ray ``_i`` of ``rays`` at cone fraction ``_f`` lands under the lens; null when it does not.

    Written in steps so that generated code computes every intermediate once.
    """
    n, h, k, big = _index(), _height(), F.col("conic_k"), F.col(radius)
    scale = 0.99 * (1.0 if rays > 1 else 0.0)
    t = t.withColumns({"_o": F.col("pitch_mm") / 2 * scale * (d("_i") * 2.0 / float(max(1, rays - 1)) - 1.0),
                       "_th": F.col("_f") * (F.col("view_angle_deg") / 2) * (math.pi / 180)})
    t = t.withColumns({"_dx": -F.sin("_th"), "_dy": -F.cos("_th"), "_ao": F.abs("_o")})
    t = t.withColumns({"_y": h - conic_sag(F.col("_ao"), big, k), "_sl": conic_slope(F.col("_ao"), big, k) * F.signum("_o")})
    t = t.withColumns({"_ny": d(1) / F.sqrt(F.col("_sl") * F.col("_sl") + 1.0), "_eta": d(1) / n})
    t = t.withColumn("_nx", F.col("_sl") * F.col("_ny"))
    t = t.withColumn("_ci", -(F.col("_dx") * F.col("_nx") + F.col("_dy") * F.col("_ny")))
    t = t.withColumn("_q", d(1) - F.col("_eta") * F.col("_eta") * (d(1) - F.col("_ci") * F.col("_ci")))
    t = t.withColumn("_ff", F.col("_eta") * F.col("_ci") - F.sqrt(F.greatest(d(0), F.col("_q"))))
    t = t.withColumns({"_ix": F.col("_eta") * F.col("_dx") + F.col("_ff") * F.col("_nx"), "_iy": F.col("_eta") * F.col("_dy") + F.col("_ff") * F.col("_ny")})
    fall = F.when(F.col("_iy") < 0, F.col("_iy")).otherwise(d(-1))
    return t.withColumn("_x", F.when((F.col("_q") >= 0) & (F.col("_iy") < 0), F.col("_o") + F.col("_y") / -fall * F.col("_ix")))


def spot_size_sweep(settings: DataFrame, keys: list[str], rays: int = 41) -> DataFrame:
    """(keys, worst_spot_mm): widest spread of a bundle over the cone.

    Rays are exploded in generated code; the partial aggregate folds a setting's rays back to one
    row per angle before anything is shuffled.
    """
    g = lens_geometry(settings)
    t = g.withColumn("_f", F.explode(F.array(*[d(v) for v in CONE_FRACTIONS])))
    t = t.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
    t = with_landing(t, rays, "radius_mm")
    spot = t.groupBy(*keys, "_f").agg(F.coalesce(F.max("_x") - F.min("_x"), d(0)).alias("spot"))
    return spot.groupBy(*keys).agg(F.max("spot").alias("worst_spot_mm"))


def best_radius(settings: DataFrame, rays: int = 25, grid: int = 32, rounds: int = 3) -> DataFrame:
    """Adds ``best_radius_mm``: the radius in [R, 1.6 R] with the least worst spot, to within 1e-4 R.

    Each round spreads ``grid`` + 1 radii over the interval and keeps the neighbours of the best, which
    narrows it sixteenfold.  Settings are hashed once by their own columns; every aggregate of every
    round then stays inside its partition, and the rays run in generated code.
    Infeasible lenses keep their axial radius.
    """
    s = _axial(settings)
    keys = s.columns
    t = s.distinct().repartition(*keys).withColumns({"_lo": F.col("axial_radius_mm"), "_hi": F.col("axial_radius_mm") * 1.6})
    inside = [*keys, "_lo", "_hi"]
    for _ in range(rounds):
        r = t.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(grid))))
        r = r.withColumn("_r", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_k") / float(grid))
        r = r.withColumn("_f", F.explode(F.array(*[d(v) for v in CONE_FRACTIONS])))
        r = r.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(rays - 1))))
        r = with_landing(r, rays, "_r")
        r = r.groupBy(*inside, "_k", "_f").agg(F.coalesce(F.max("_x") - F.min("_x"), d(0)).alias("_s"))
        r = r.groupBy(*inside, "_k").agg(F.max("_s").alias("_s"))
        r = r.groupBy(*inside).agg(F.min(F.struct("_s", "_k"))["_k"].alias("_k"))
        at = lambda k: F.col("_lo") + (F.col("_hi") - F.col("_lo")) * k / float(grid)
        t = r.select(*keys, at(F.greatest(F.lit(0), F.col("_k") - 1)).alias("_lo"), at(F.least(F.lit(grid), F.col("_k") + 1)).alias("_hi"))
    mid = (F.col("_lo") + F.col("_hi")) / 2
    return t.select(*keys, F.when(F.col("feasible"), mid).otherwise(F.col("axial_radius_mm")).alias("best_radius_mm"))


def snap_pixels_per_lens(ppl, parity: str = "any") -> Column:
    t = F.greatest(d(2), d(ppl))
    if parity == "any":
        return F.greatest(F.lit(2), jsround(t))
    odd = 0 if parity == "even" else 1
    return F.greatest(F.lit(3 if odd else 2), jsround((t - odd) / 2) * 2 + odd)


def sweep_values(specs: DataFrame) -> DataFrame:
    """specs(spec_id, lo, hi, bands, snap, ppi) -> (spec_id, pos, value).

    With ``snap`` each value is moved to a whole number of pixels per lens and repeats are dropped,
    the first one staying.
    """
    n = F.greatest(F.lit(2), jsround("bands"))
    lo, hi = F.least(d("lo"), d("hi")), F.greatest(d("lo"), d("hi"))
    t = specs.withColumn("pos", F.explode(F.sequence(F.lit(0), n - 1)))
    t = t.withColumn("even", lo + (hi - lo) * F.col("pos") / (n - 1))
    snap = F.col("snap") & (F.col("ppi") > 0)
    ppl = snap_pixels_per_lens(d("ppi") / F.greatest(d(1e-6), F.col("even")))
    t = t.withColumn("_k", F.when(snap, ppl).otherwise(-1 - F.col("pos")))
    t = t.groupBy("spec_id", "_k").agg(F.min("pos").alias("pos"), F.min_by("even", "pos").alias("even"), F.first("ppi").alias("ppi"))
    value = F.when(F.col("_k") > 0, d("ppi") / d(F.greatest(F.col("_k"), F.lit(1)))).otherwise(F.col("even"))
    return t.select("spec_id", "pos", value.alias("value"))


def height_for_angle(pitch_mm, ri, angle_deg) -> Column:
    angle = F.least(d(179.9), F.greatest(d(0.1), d(angle_deg)))
    inside = F.least(d(0.999999), F.greatest(d(1e-6), F.sin(angle / 2 * (math.pi / 180)) / _index(ri)))
    return d(pitch_mm) / 2 * F.sqrt(d(1) / (inside * inside) - 1)


def pitch_fit(settings: DataFrame, views: int = 0) -> DataFrame:
    """Adds ppl, whole, parity, drift_px, lens_count and px_per_view."""
    ppl = F.greatest(d(1e-6), d("ppi")) / F.greatest(d(1e-6), d("lpi"))
    s = settings.withColumn("ppl", ppl)
    frac = F.col("ppl") - jsround("ppl")
    s = s.withColumns({"whole": F.abs(frac) < 1e-9, "lens_count": F.greatest(d(0.01), d("width_mm")) * F.greatest(d(1e-6), d("lpi")) / 25.4})
    per = F.col("ppl") / float(views or 1)
    return s.withColumns({
        "parity": F.when(F.col("whole"), F.when(jsround("ppl") % 2 == 0, "even").otherwise("odd")),
        "drift_px": F.abs(frac) * F.col("lens_count"),
        "px_per_view": F.when(F.lit(views > 0) & (F.abs(per - jsround(per)) < 1e-9), per),
    })


def eye_offset(i, n, cone_deg, distance, m=ColumnMath) -> Column | float:
    """Sideways eye position of view i of n across a cone."""
    if m is math:
        if n == 1:
            return 0.0
        return math.tan((i / (n - 1) * 2 - 1) * (max(0.0, cone_deg) * math.pi / 360)) * max(1e-6, distance)
    half = F.greatest(d(0), d(cone_deg)) * math.pi / 360
    frac = d(i) / F.greatest(d(n) - 1, d(1)) * 2 - 1
    return F.when(c(n) <= 1, d(0)).otherwise(F.tan(frac * half) * F.greatest(d(1e-6), d(distance)))


def eye_offsets(settings: DataFrame) -> DataFrame:
    """settings(…, views, cone_deg, distance_mm) exploded to one row per eye (eye, ex)."""
    n = F.greatest(F.lit(1), jsround("views"))
    t = settings.withColumn("eye", F.explode(F.sequence(F.lit(0), n - 1)))
    return t.withColumn("ex", eye_offset("eye", n, "cone_deg", "distance_mm"))


def eye_grid(settings: DataFrame) -> DataFrame:
    """settings(…, cols, rows, cone_deg, distance_mm) -> row-major eyes (eye, ex, ey) from the upper left."""
    cols, rows = F.greatest(F.lit(1), jsround("cols")), F.greatest(F.lit(1), jsround("rows"))
    t = settings.withColumn("eye", F.explode(F.sequence(F.lit(0), cols * rows - 1)))
    col, row = F.col("eye") % cols, ifloor(d("eye") / d(cols))
    return t.withColumns({"ex": eye_offset(col, cols, "cone_deg", "distance_mm"), "ey": -eye_offset(row, rows, "cone_deg", "distance_mm")})


def clamp_setback(setback, distance) -> Column:
    return F.greatest(F.greatest(d(1e-6), d(distance)) * -MAX_POPOUT, d(setback))


def disparity(settings: DataFrame) -> DataFrame:
    """settings(…, views, cone_deg, distance_mm, depth_mm, setback_mm, lpi) plus worst movement per eye step."""
    n = F.greatest(F.lit(1), jsround("views"))
    first, second = (eye_offset(F.lit(i), n, "cone_deg", "distance_mm") for i in (0, 1))
    s = settings.withColumns({"step_mm": F.when(n > 1, F.abs(second - first)).otherwise(d(0)), "near_mm": clamp_setback("setback_mm", "distance_mm")})
    s = s.withColumn("far_mm", F.col("near_mm") + F.greatest(d(0), d("depth_mm")))
    dist = F.greatest(d(1e-6), d("distance_mm"))

    def at(behind: str) -> Column:
        z = -F.col(behind)
        return F.when(z >= dist, d(float("inf"))).otherwise(F.abs(F.col("step_mm") * z / F.when(z >= dist, d(1)).otherwise(dist - z)))

    s = s.withColumn("worst_mm", F.greatest(at("near_mm"), at("far_mm")))
    s = s.withColumn("lenslets", F.col("worst_mm") / (d(25.4) / F.greatest(d(1e-6), d("lpi"))))
    return s.withColumn("comfortable", F.col("lenslets") <= MAX_STEP_LENSLETS)


def plane_facing(ex, ey, dist, follow, m=ColumnMath):
    """Axes u, v and normal n of a picture plane turned towards an eye (``follow`` 0..1)."""
    yaw = m.atan2(ex, dist) * follow
    span = m.sqrt(ex * ex + ey * ey + dist * dist)
    pitch = -m.asin(ey / span) * follow
    sy, cy, sp, cp = m.sin(yaw), m.cos(yaw), m.sin(pitch), m.cos(pitch)
    return dict(n=(sy * cp, -sp, cy * cp), u=(cy, cy * 0.0, -sy), v=(sy * sp, cp, cy * sp), yaw=yaw, pitch=pitch)


def plane_hit(p, ex, ey, dist, x, y) -> tuple[Column, Column]:
    """Plane coordinates (a, b) of the ray from an eye through sheet point (x, y)."""
    n, u, v = p["n"], p["u"], p["v"]
    ne = n[0] * ex + n[1] * ey + n[2] * dist
    denom = ne - (n[0] * x + n[1] * y)
    t = ne / F.when(F.abs(denom) < 1e-9, d(1e-9)).otherwise(denom)
    hx, hy, hz = ex + t * (x - ex), ey + t * (y - ey), dist - t * dist
    return u[0] * hx + u[1] * hy + u[2] * hz, v[0] * hx + v[1] * hy + v[2] * hz


def cover_scale(settings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, scale): how much larger than the sheet the picture must be so that every view covers it.

    settings(keys, cols, rows, cone_deg, distance_mm, width_mm, height_mm, follow); rows = 0 is a run of
    ``cols`` eyes on a line.
    """
    line = F.col("rows") == 0
    t = eye_grid(settings).withColumn("ey", F.when(line, d(0)).otherwise(F.col("ey")))
    t = t.withColumn("_d", F.greatest(d(1), d("distance_mm")))
    t = t.withColumns({"_hw": F.greatest(d(0.01), d("width_mm")) / 2, "_hh": F.greatest(d(0.01), d("height_mm")) / 2,
                       "_f": F.least(d(1), F.greatest(d(0), d("follow")))})
    t = t.withColumn("_s", F.explode(F.array(*[F.struct(d(a).alias("x"), d(b).alias("y")) for a in (-1, 1) for b in (-1, 1)])))
    plane = plane_facing(F.col("ex"), F.col("ey"), F.col("_d"), F.col("_f"))
    a, b = plane_hit(plane, F.col("ex"), F.col("ey"), F.col("_d"), F.col("_s.x") * F.col("_hw"), F.col("_s.y") * F.col("_hh"))
    need = F.greatest(F.abs(a) / F.col("_hw"), F.abs(b) / F.col("_hh"))
    return t.groupBy(*keys).agg(F.greatest(d(1), F.max(need)).alias("scale"))
