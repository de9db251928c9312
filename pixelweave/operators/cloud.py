"""Point clouds of anisotropic splats: orientation, culling, projection and ordered blending."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import d, idiv, ifloor, u8
from ..schema import IMG, POS, RGB, SIZE, cut
from .mesh import canvas, tiles
from .stats import cloud_bounds
from .sweep import eye_offset

# fixed values of the projection
MIN_VARIANCE_PX = 0.3
DEPTH_BUCKETS = 1 << 16
#: Depth buckets of one chunk; a pixel has at most DEPTH_BUCKETS / CHUNK chunks.
CHUNK = 1 << 10


@dataclass(frozen=True)
class Camera:
    position: tuple = (0.0, 0.0, 0.0)
    rotation: tuple = (0.0, 0.0, 0.0)  # pitch, yaw, roll in degrees
    scale: float = 1.0  # scene units per mm


@dataclass(frozen=True)
class CloudView:
    """What is drawn, from where and how large."""

    camera: Camera = Camera()
    width_mm: float = 100.0
    height_mm: float = 100.0
    distance: float = 400.0
    cone_deg: float = 30.0
    cols: int = 3
    rows: int = 0  # 0: a run of ``cols`` eyes on a line
    width_px: int = 64
    background: tuple = (255, 255, 255)
    supersample: int = 1
    front_margin: float = 0.0
    budget: int = 0

    def eyes(self) -> list[tuple[float, float]]:
        off = lambda i, n: eye_offset(i, n, self.cone_deg, self.distance, math)
        if self.rows == 0:
            return [(off(i, self.cols), 0.0) for i in range(max(1, self.cols))]
        return [(off(c, self.cols), -off(r, self.rows)) for r in range(self.rows) for c in range(self.cols)]

    def raster(self) -> tuple[int, int, int]:
        ss = max(1, math.floor(self.supersample + 0.5))
        w = max(8, math.floor(self.width_px + 0.5)) * ss
        return w, max(8, math.floor(self.width_px * self.height_mm / max(1e-6, self.width_mm) + 0.5)) * ss, ss


def orient_cloud(splats: DataFrame, up: str = "-y") -> DataFrame:
    """Turn a cloud upright: '-y' (y down), 'y' (already upright) or 'z'."""
    if up == "y":
        return splats
    py, pz, x, y, z, w = (F.col(c) for c in ("py", "pz", "qx", "qy", "qz", "qw"))
    if up == "-y":
        return splats.withColumns({"py": -py, "pz": -pz, "qx": w, "qy": -z, "qz": y, "qw": -x})
    c, s = math.sqrt(0.5), -math.sqrt(0.5)
    return splats.withColumns({"py": pz, "pz": -py, "qx": x * c + w * s, "qy": y * c - z * s, "qz": z * c + y * s, "qw": w * c - x * s})


def camera_basis(pitch, yaw, roll, m=math) -> list:
    """Nine numbers: right, up and back axes of a camera (numbers or columns)."""
    k = math.pi / 180
    p, y, r = pitch * k, yaw * k, roll * k
    cp, sp, cy, sy, cr, sr = m.cos(p), m.sin(p), m.cos(y), m.sin(y), m.cos(r), m.sin(r)
    return [cy * cr + sy * sp * sr, cp * sr, -sy * cr + cy * sp * sr, -cy * sr + sy * sp * cr, cp * cr, sy * sr + cy * sp * cr,
            sy * cp, -sp, cy * cp]


def camera_axes(cameras: DataFrame) -> DataFrame:
    """cameras(…, pitch, yaw, roll) plus right, up and forward axes."""
    from .sweep import ColumnMath

    b = camera_basis(d("pitch"), d("yaw"), d("roll"), ColumnMath)
    names = [f"{a}_{k}" for a in ("right", "up", "back") for k in "xyz"]
    t = cameras.withColumns(dict(zip(names, b)))
    return t.withColumns({f"forward_{k}": -F.col(f"back_{k}") for k in "xyz"}).drop("back_x", "back_y", "back_z")


def framing_camera(splats: DataFrame, width_mm: float) -> DataFrame:
    """(cloud_id, px, py, pz, pitch, yaw, roll, scale): a camera that sees each whole cloud."""
    b = cloud_bounds(splats)
    r = F.greatest(d(1e-6), F.col("radius"))
    zero = d(0)
    return b.select("cloud_id", F.col("centre_x").alias("px"), F.col("centre_y").alias("py"), (F.col("centre_z") + r).alias("pz"),
                    zero.alias("pitch"), zero.alias("yaw"), zero.alias("roll"), (r * 2 / max(1.0, width_mm)).alias("scale"))


def indexed(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds a dense ``k`` (0-based rank of ``order`` per key) and ``n`` (count per key) without a single-task sort.

    Rows are range-partitioned once; ranks are made inside a partition and shifted by the counts of
    the partitions before it.
    """
    t = cut(df.repartitionByRange(key, order).withColumn("_pid", F.spark_partition_id()))
    per = t.groupBy(key, "_pid").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(key).orderBy("_pid")
    per = per.select(key, "_pid", (F.sum("_c").over(w) - F.col("_c")).alias("_off"), F.sum("_c").over(Window.partitionBy(key)).alias("n"))
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_pid").orderBy(order)) - 1)
    return t.join(per, [key, "_pid"]).withColumn("k", F.col("_off") + F.col("_r")).drop("_pid", "_r", "_off")


def on_stride(k: Column, n: Column, keep: Column) -> Column:
    """Whether rank k of n is one of ``keep`` evenly strided picks."""
    step = d(n) / d(keep)
    picks = F.floor(d(n) / step)
    g = F.ceil(d(k) / step)
    hit = lambda i: (i >= 0) & (i < picks) & (F.least(n - 1, F.floor(d(i) * step)) == k)
    return F.when(n <= keep, F.lit(True)).otherwise(hit(g - 1) | hit(g) | hit(g + 1))


def stride_sample(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """At most n records per key by even stride, plus ``dropped``, how many were left out."""
    t = indexed(df, key, order).filter(on_stride(F.col("k"), F.col("n"), F.lit(n).cast("long")))
    return t.withColumn("dropped", F.greatest(F.lit(0).cast("long"), F.col("n") - n)).drop("k", "n")


thin_to_budget = stride_sample


def cull_cloud(splats: DataFrame, v: CloudView) -> DataFrame:
    """World to camera (cx, cy, cz in mm) plus ``state``: kept, culled (in front) or off (outside every eye's sheet)."""
    b = camera_basis(*v.camera.rotation)
    per = 1 / max(1e-9, v.camera.scale)
    w = [(F.col(c) - float(o)) * per for c, o in zip(("px", "py", "pz"), v.camera.position)]
    dist = max(1e-6, v.distance)
    row = lambda i: w[0] * b[3 * i] + w[1] * b[3 * i + 1] + w[2] * b[3 * i + 2]
    t = splats.withColumns({"cx": row(0), "cy": row(1), "cz": row(2)})
    front = F.col("cz") > -max(0.0, v.front_margin)
    room = d(dist) - F.col("cz")
    near = d(dist) / F.when(room != 0, room)
    t = t.withColumn("_t", near)
    reach = F.greatest("sx", "sy", "sz") * 3 * per * F.col("_t")
    ex, ey = (max(abs(e[i]) for e in v.eyes()) for i in (0, 1))

    def off(c: str, eye: float, half: float) -> Column:
        span = (d(1) - F.col("_t")) * eye + reach
        at = F.col("_t") * F.col(c)
        return (at + span < -half) | (at - span > half)

    out = off("cx", ex, v.width_mm / 2) | off("cy", ey, v.height_mm / 2)
    return t.withColumn("state", F.when(front, "culled").when(out, "off").otherwise("kept")).drop("_t")


def camera_covariance(t: DataFrame, camera: Camera) -> DataFrame:
    """Adds the six covariance entries in mm² (k00 k01 k02 k11 k12 k22) from quaternion, radii and camera axes."""
    b = camera_basis(*camera.rotation)
    per = 1 / max(1e-9, camera.scale)
    x, y, z, w = (F.col(c) for c in ("qx", "qy", "qz", "qw"))
    r = [[d(1) - (y * y + z * z) * 2, (x * y - w * z) * 2, (x * z + w * y) * 2],
         [(x * y + w * z) * 2, d(1) - (x * x + z * z) * 2, (y * z - w * x) * 2],
         [(x * z - w * y) * 2, (y * z + w * x) * 2, d(1) - (x * x + y * y) * 2]]
    size = [F.col(c) * per for c in ("sx", "sy", "sz")]
    t = t.withColumns({f"_m{i}{j}": (r[0][j] * b[3 * i] + r[1][j] * b[3 * i + 1] + r[2][j] * b[3 * i + 2]) * size[j] for i in range(3) for j in range(3)})
    m = lambda i, k: sum((F.col(f"_m{i}{j}") * F.col(f"_m{k}{j}") for j in range(1, 3)), F.col(f"_m{i}0") * F.col(f"_m{k}0"))
    t = t.withColumns({f"k{i}{k}": m(i, k) for i, k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))})
    return t.drop(*[f"_m{i}{j}" for i in range(3) for j in range(3)])


def splat_footprint(t: DataFrame, v: CloudView) -> DataFrame:
    """One row per splat and eye that can show it: screen centre, inverse covariance, radius and box."""
    w, h, _ = v.raster()
    dist = max(1e-6, v.distance)
    kpx = w / max(1e-6, v.width_mm)
    hw, hh = v.width_mm / 2, v.height_mm / 2
    table = F.array(*[F.struct(F.lit(i).alias("view"), d(ex).alias("ex"), d(ey).alias("ey")) for i, (ex, ey) in enumerate(v.eyes())])
    t = t.filter("a <> 0").withColumn("_e", F.explode(table))
    ex, ey = F.col("_e.ex"), F.col("_e.ey")
    t = t.withColumn("_t", d(dist) / (d(dist) - F.col("cz")))
    n = F.col("_t")
    t = t.withColumns({"_X": ex + n * (F.col("cx") - ex), "_Y": ey + n * (F.col("cy") - ey),
                       "_j0": (F.col("cx") - ex) * n * n / dist, "_j1": (F.col("cy") - ey) * n * n / dist})
    t = t.filter((F.abs("_X") <= hw * 2) & (F.abs("_Y") <= hh * 2))
    j0, j1 = F.col("_j0"), F.col("_j1")
    s = kpx * kpx
    t = t.withColumns({
        "_a": (n * n * F.col("k00") + n * j0 * F.col("k02") * 2 + j0 * j0 * F.col("k22")) * s + MIN_VARIANCE_PX,
        "_b": (n * n * F.col("k11") + n * j1 * F.col("k12") * 2 + j1 * j1 * F.col("k22")) * s + MIN_VARIANCE_PX,
        "_c": (n * n * F.col("k01") + n * j1 * F.col("k02") + j0 * n * F.col("k12") + j0 * j1 * F.col("k22")) * s,
    })
    good = F.col("_a") * F.col("_b") - F.col("_c") * F.col("_c") > 1e-12
    flat = d(MIN_VARIANCE_PX * 2)
    t = t.withColumns({"_a": F.when(good, F.col("_a")).otherwise(flat), "_b": F.when(good, F.col("_b")).otherwise(flat), "_c": F.when(good, F.col("_c")).otherwise(d(0))})
    t = t.withColumn("_det", F.col("_a") * F.col("_b") - F.col("_c") * F.col("_c"))
    half = (F.col("_a") - F.col("_b")) / 2
    lam = (F.col("_a") + F.col("_b")) / 2 + F.sqrt(F.greatest(d(0), half * half + F.col("_c") * F.col("_c")))
    t = t.withColumns({
        "i00": F.col("_b") / F.col("_det"), "i01": -F.col("_c") / F.col("_det"), "i11": F.col("_a") / F.col("_det"),
        "radius": F.ceil(F.sqrt(F.greatest(lam, d(MIN_VARIANCE_PX))) * 3).cast("int"),
        "sx_px": (F.col("_X") + hw) * kpx, "sy_px": (d(hh) - F.col("_Y")) * kpx,
    })
    box = lambda c, hi, lim: (F.least(F.lit(lim - 1), F.ceil(F.col(c) + F.col("radius")).cast("int")) if hi
                              else F.greatest(F.lit(0), F.floor(F.col(c) - F.col("radius")).cast("int")))
    t = t.withColumns({"x0": box("sx_px", False, w), "x1": box("sx_px", True, w), "y0": box("sy_px", False, h), "y1": box("sy_px", True, h)})
    return t.select("cloud_id", "splat_id", F.col("_e.view").alias("view"), "cz", *RGB, "a", "i00", "i01", "i11", "radius", "sx_px", "sy_px", "x0", "x1", "y0", "y1")


def composite_splats(foot: DataFrame) -> DataFrame:
    """(image_id, frame, x, y, pr, pg, pb, alpha, depth): far to near over-blend at every touched pixel.

    Layers form an ordered monoid: (light, transmittance), where what lies in front dims what lies behind. Each pixel's splats are
    folded by depth chunk first, at most ``DEPTH_BUCKETS / CHUNK`` of them, and then the chunks, so no task orders the whole list of
    a pixel. A splat of full opacity leaves a transmittance of exactly 0. Footprints (one row per splat and
    eye) are written once: they are read for the depth range and again for the far larger expansion into pixels.
    """
    key = ["cloud_id", "view"]
    foot = cut(foot)
    rng = foot.groupBy(*key).agg(F.min("cz").alias("_lo"), F.max("cz").alias("_hi"))
    t = foot.filter("x0 <= x1 and y0 <= y1").join(rng, key)
    span = F.greatest(d(1e-6), F.col("_hi") - F.col("_lo"))
    bucket = F.floor(F.least(d(DEPTH_BUCKETS - 1), (F.col("cz") - F.col("_lo")) / span * float(DEPTH_BUCKETS - 1))).cast("int")
    t = tiles(t.withColumn("_q", bucket).drop("_lo", "_hi"), [*key, "splat_id"])
    dx, dy = d("x") + 0.5 - F.col("sx_px"), d("y") + 0.5 - F.col("sy_px")
    power = (F.col("i00") * dx * dx + F.col("i01") * dx * dy * 2 + F.col("i11") * dy * dy) * 0.5
    t = t.withColumn("_p", power).filter("_p <= 8").withColumn("_av", d("a") / 255.0 * F.exp(-F.col("_p"))).filter(F.col("_av") >= 1 / 512)
    t = t.select(F.col("cloud_id").alias("image_id"), F.col("view").alias("frame"), *POS, F.floor(F.col("_q") / CHUNK).alias("_chunk"), "_q", "splat_id", "cz", *RGB, "_av")
    through = F.greatest(d(0), d(1) - F.col("_av"))
    nearer = lambda over: F.coalesce(F.product("_t").over(over.rowsBetween(Window.unboundedPreceding, -1)), d(1))
    t = t.withColumn("_t", through)
    t = t.withColumn("_w", F.col("_av") * nearer(Window.partitionBy(*IMG, *POS, "_chunk").orderBy(F.desc("_q"), F.desc("splat_id"))))
    light = {**{f"p{ch}": d(ch) / 255.0 * F.col("_w") for ch in RGB}, "alpha": F.col("_w"), "depth": F.col("cz") * F.col("_w")}
    chunks = t.groupBy(*IMG, *POS, "_chunk").agg(*[F.sum(e).alias(n) for n, e in light.items()], F.product("_t").alias("_t"))
    chunks = chunks.withColumn("_front", nearer(Window.partitionBy(*IMG, *POS).orderBy(F.desc("_chunk"))))
    return chunks.groupBy(*IMG, *POS).agg(*[F.sum(F.col(n) * F.col("_front")).alias(n) for n in light])


def resolve_views(acc: DataFrame, clouds: DataFrame, v: CloudView) -> DataFrame:
    """Blend over the paper colour and box-filter: untouched pixels are paper."""
    w, h, ss = v.raster()
    ow, oh = max(1, math.floor(w / ss + 0.5)), max(1, math.floor(h / ss + 0.5))
    n = float(ss * ss)
    part = acc.select(*IMG, idiv("x", ss).alias("x"), idiv("y", ss).alias("y"),
                      *[(F.col(f"p{ch}") * 255.0 - F.col("alpha") * float(bg)).alias(f"p{ch}") for ch, bg in zip(RGB, v.background)])
    paper = canvas(clouds, "cloud_id", len(v.eyes()), ow, oh).select(*IMG, *POS, *[d(0).alias(f"p{ch}") for ch in RGB])
    t = part.union(paper).groupBy(*IMG, *POS).agg(*[F.sum(f"p{ch}").alias(f"p{ch}") for ch in RGB])
    return t.select(*IMG, F.lit(ow).alias("w"), F.lit(oh).alias("h"), *POS,
                    *[u8(F.col(f"p{ch}") / n + float(bg)).alias(ch) for ch, bg in zip(RGB, v.background)], F.lit(255).alias("a"))


def resolve_depth(acc: DataFrame, v: CloudView) -> tuple[DataFrame, DataFrame]:
    """(normalised depth of the touched output pixels, coverage per view); thin pixels do not count."""
    w, h, ss = v.raster()
    solid = acc.filter("alpha >= 0.02").withColumn("z", F.col("depth") / F.col("alpha"))
    s = solid.groupBy(*IMG).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"), F.count(F.lit(1)).alias("n_hit"))
    t = solid.filter((F.col("x") % ss == 0) & (F.col("y") % ss == 0)).join(s, IMG)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(d(1))
    grey = t.select(*IMG, idiv("x", ss).alias("x"), idiv("y", ss).alias("y"), u8((F.col("z") - F.col("_lo")) / span * 255.0).alias("v"))
    return grey, s.select(*IMG, "n_hit", (d("n_hit") / float(w * h)).alias("coverage"), (-F.col("_hi")).alias("near_mm"), (-F.col("_lo")).alias("far_mm"))


def cloud_views(splats: DataFrame, v: CloudView) -> DataFrame:
    """The run or grid of views of every cloud: cull, thin to the budget, project, blend, resolve."""
    kept = cull_cloud(splats, v).filter("state = 'kept'").drop("state")
    if v.budget > 0:
        kept = thin_to_budget(kept, "cloud_id", "splat_id", v.budget).drop("dropped")
    acc = composite_splats(splat_footprint(camera_covariance(kept, v.camera), v))
    return resolve_views(acc, splats, v)
