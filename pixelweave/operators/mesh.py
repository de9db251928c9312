"""Triangle meshes: relief meshes from images, fitting, projection and z-buffer rendering."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import clamp01, d, idiv, ifloor, jsround, luminance, u8
from ..schema import IMG, PIXEL, POS, RGB, SIZE, TRI, large
from ..sources.generators import grid
from .bands import by_column, by_row, in_bands, out_of_bands, shifted
from .neighborhood import gaussian_heights
from .regrid import bilinear
from .stats import mesh_bounds
from .sweep import MAX_POPOUT, eye_offset

TILE = 64  # side of the screen tiles a large triangle is cut into before it is expanded
CELL = 8  # side of a tile's cells, each with a nearness that triangles behind it are held against


def triangle(*pts: tuple[Column, Column, Column]) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(TRI, [c for p in pts for c in p])])


def _included(min_white: float) -> Column:
    return F.lit(True) if min_white < 0 else luminance() >= d(min_white)


def heightmap_to_mesh(p: DataFrame, min_white: float = 1, base: float = 0.0, depth: float = 10.0, width: float = 100.0,
                      sigma: float = 0.0) -> DataFrame:
    """(mesh_id, frame, tri_id, ax..cz): a closed relief over the included pixels.

    A cell needs the 3x3 neighbourhood only: corner heights are means of the included pixels around
    a corner, skirts stand where a neighbour is missing.  All of it comes from one banded shuffle,
    without corner joins or anti joins.
    """
    src = p.select(*PIXEL[:6], *RGB)
    if sigma > 0:
        src = src.join(large(gaussian_heights(p, sigma).select(*IMG, *POS, "height")), [*IMG, *POS])
    else:
        src = src.withColumn("height", luminance() / 255.0)
    t = in_bands(src, 1).withColumn("v", F.when(_included(min_white), F.col("height")))
    t = shifted(t, ["v"], 1, "row", clamp=False).withColumnsRenamed({"v_m1": "vl", "v": "vo", "v_p1": "vr"})
    t = shifted(t, ["vl", "vo", "vr"], 1, "column", clamp=False)
    t = out_of_bands(t, 1).filter("vo is not null")
    ps = d(width) / d("w")

    def corner(*cells: str) -> Column:
        total, n = d(0), F.lit(0)
        for c in cells:
            total = total + F.coalesce(F.col(c), d(0))
            n = n + F.when(F.col(c).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        return d(base) + total / n * depth

    t = t.withColumns({
        "x0": d("x") * ps, "x1": (d("x") + 1) * ps, "yt": (d("h") - d("y")) * ps, "yb": (d("h") - d("y") - 1) * ps,
        "za": corner("vl_m1", "vo_m1", "vl", "vo"), "zb": corner("vo_m1", "vr_m1", "vo", "vr"),
        "zc": corner("vo", "vr", "vo_p1", "vr_p1"), "zd": corner("vl", "vo", "vl_p1", "vo_p1"),
    })
    x0, x1, yt, yb, za, zb, zc, zd = (F.col(c) for c in ("x0", "x1", "yt", "yb", "za", "zb", "zc", "zd"))
    z = d(0)
    a, b, c, e = (x0, yt, za), (x1, yt, zb), (x1, yb, zc), (x0, yb, zd)
    a0, b0, c0, e0 = ((q[0], q[1], z) for q in (a, b, c, e))
    faces = [triangle(a, e, c), triangle(a, c, b), triangle(a0, b0, c0), triangle(a0, c0, e0)]
    for missing, m, n, m0, n0 in (("vl", a, e, a0, e0), ("vo_p1", e, c, e0, c0), ("vr", c, b, c0, b0), ("vo_m1", b, a, b0, a0)):
        gone = F.col(missing).isNull()
        faces += [F.when(gone, triangle(m, m0, n0)), F.when(gone, triangle(m, n0, n))]
    cell = (d("y") * d("w") + d("x")).cast("long") * len(faces)
    t = t.select(F.col("image_id").alias("mesh_id"), "frame", cell.alias("_c"), F.posexplode(F.array(*faces)).alias("_k", "_t"))
    return t.filter("_t is not null").select("mesh_id", "frame", (F.col("_c") + F.col("_k")).alias("tri_id"), *[f"_t.{n}" for n in TRI])


def _merge(t: DataFrame, keys: list[str], pos: str, lo: str, hi: str) -> DataFrame:
    """Gaps and islands: merge rows with equal keys over consecutive positions into [lo, hi]."""
    w = Window.partitionBy(*keys).orderBy(pos)
    t = t.withColumn("_g", F.col(pos) - F.row_number().over(w))
    return t.groupBy(*keys, "_g").agg(F.min(pos).alias(lo), F.max(pos).alias(hi)).drop("_g")


def plateau_rects(p: DataFrame, levels: int = 16, min_white: float = 1, base: float = 0.0, depth: float = 10.0) -> DataFrame:
    """(image_id, frame, w, h, kind, x0, x1, y0, y1, z0, z1, dir): merged tops, bottoms and walls of a stepped relief.

    Equal cells merge along x and then identical runs along y; walls merge along their edge.  The
    cells covered and the wall area do not depend on the tiling.  Coordinates are pixel edges.
    """
    steps = max(2, min(256, math.floor(levels))) - 1
    lv = F.when(_included(min_white), jsround(clamp01(luminance() / 255.0) * steps))
    z = F.when(lv.isNotNull(), d(base) + d(lv) / steps * depth).otherwise(d(0))
    t = p.select(*PIXEL[:6], lv.alias("lv"), z.alias("z"))
    key = [*IMG, *SIZE]
    inside = t.filter("lv is not null")
    tops = _merge(_merge(inside, [*key, "y", "lv", "z"], "x", "x0", "x1"), [*key, "lv", "z", "x0", "x1"], "y", "y0", "y1")
    floors = _merge(_merge(inside, [*key, "y"], "x", "x0", "x1"), [*key, "x0", "x1"], "y", "y0", "y1")
    b = in_bands(t, 1)
    b = b.withColumn("zl", F.coalesce(F.lag("z").over(by_row()), d(0))).withColumn("zu", F.coalesce(F.lag("z").over(by_column()), d(0)))
    b = out_of_bands(b, 1)

    def walls(pos: str, n: str, before: str) -> DataFrame:
        """Both sides of every cell edge across one axis; the last cell also closes the far border."""
        own = F.struct(F.col(pos).alias("e"), F.col(before).alias("a"), F.col("z").alias("b"))
        far = F.when(F.col(pos) == F.col(n) - 1, F.struct((F.col(pos) + 1).alias("e"), F.col("z").alias("a"), d(0).alias("b")))
        s = b.select(*key, *POS, F.explode(F.array(own, far)).alias("s")).filter("s is not null")
        s = s.select(*key, *POS, "s.e", F.least("s.a", "s.b").alias("z0"), F.greatest("s.a", "s.b").alias("z1"),
                     F.signum(F.col("s.a") - F.col("s.b")).cast("int").alias("dir"))
        along, lo, hi = ("y", "y0", "y1") if pos == "x" else ("x", "x0", "x1")
        m = _merge(s.filter("dir <> 0"), [*key, "e", "z0", "z1", "dir"], along, lo, hi)
        e0, e1 = ("x0", "x1") if pos == "x" else ("y0", "y1")
        return m.withColumns({e0: F.col("e"), e1: F.col("e"), hi: F.col(hi) + 1, "kind": F.lit(f"wall_{pos}")})

    cols = [*key, "kind", "x0", "x1", "y0", "y1", "z0", "z1", "dir"]
    flat = lambda df, kind, zc: df.withColumns(
        {"kind": F.lit(kind), "x1": F.col("x1") + 1, "y1": F.col("y1") + 1, "z0": zc, "z1": zc, "dir": F.lit(0)}).select(cols)
    return flat(tops, "top", F.col("z")).union(flat(floors, "bottom", d(0))).union(
        walls("x", "w", "zl").select(cols)).union(walls("y", "h", "zu").select(cols))


def plateau_mesh(p: DataFrame, width: float = 100.0, **options) -> DataFrame:
    """Two triangles per merged rectangle of ``plateau_rects``."""
    r = plateau_rects(p, **options)
    ps = d(width) / d("w")
    r = r.withColumns({"X0": d("x0") * ps, "X1": d("x1") * ps, "YT": (d("h") - d("y0")) * ps, "YB": (d("h") - d("y1")) * ps})
    x0, x1, yt, yb, z0, z1 = (F.col(c) for c in ("X0", "X1", "YT", "YB", "z0", "z1"))
    up, down = F.col("kind") == "top", F.col("kind") == "bottom"
    vertical = F.col("kind") == "wall_x"
    fwd = F.col("dir") > 0
    # a wall runs from point m to point n; its direction decides which side faces out
    mx, nx = F.when(vertical | fwd, x0).otherwise(x1), F.when(vertical, x0).when(fwd, x1).otherwise(x0)
    my, ny = F.when(vertical, F.when(fwd, yb).otherwise(yt)).otherwise(yt), F.when(vertical, F.when(fwd, yt).otherwise(yb)).otherwise(yt)
    a, b, c, e = (x0, yt, z1), (x1, yt, z1), (x1, yb, z1), (x0, yb, z1)
    two = lambda s, t: F.array(s, t)
    tris = (
        F.when(up, two(triangle(a, e, c), triangle(a, c, b))).when(down, two(triangle(a, b, c), triangle(a, c, e)))
        .otherwise(two(triangle((mx, my, z1), (mx, my, z0), (nx, ny, z0)), triangle((mx, my, z1), (nx, ny, z0), (nx, ny, z1))))
    )
    t = r.select(F.col("image_id").alias("mesh_id"), "frame", F.explode(tris).alias("_t"))
    return t.select("mesh_id", "frame", *[f"_t.{n}" for n in TRI])


def face_normal(prefix: str = "") -> tuple[Column, Column, Column]:
    """Unit normal from the winding; zero for a degenerate triangle."""
    v = {n: F.col(prefix + n) for n in TRI}
    u = [v[f"b{k}"] - v[f"a{k}"] for k in "xyz"]
    w = [v[f"c{k}"] - v[f"a{k}"] for k in "xyz"]
    n = [u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    size = F.when(size == 0, d(1)).otherwise(size)
    return tuple(c / size for c in n)


def face_normals(tris: DataFrame) -> DataFrame:
    n = face_normal()
    return tris.withColumns({"nx": n[0], "ny": n[1], "nz": n[2]})


def fit_mesh(tris: DataFrame, rotation=(0.0, 0.0, 0.0), width_mm=100.0, height_mm=100.0, margin=0.05, depth_mm=10.0, distance=400.0,
             fit_at_z: float = 0.0) -> DataFrame:
    """Rotate about x, y, z, centre and scale to the sheet; adds ``zscale``, the depth compression.

    Bounds are one aggregate per mesh, joined back by mesh: AQE broadcasts them while they are small.
    """
    rx, ry, rz = (v * math.pi / 180 for v in rotation)

    def turn(v: str) -> dict[str, Column]:
        x, y, z = (F.col(f"{v}{k}") for k in "xyz")
        y1, z1 = y * math.cos(rx) - z * math.sin(rx), y * math.sin(rx) + z * math.cos(rx)
        x2, z2 = x * math.cos(ry) + z1 * math.sin(ry), -x * math.sin(ry) + z1 * math.cos(ry)
        return {f"{v}x": x2 * math.cos(rz) - y1 * math.sin(rz), f"{v}y": x2 * math.sin(rz) + y1 * math.cos(rz), f"{v}z": z2}

    t = tris.withColumns({**turn("a"), **turn("b"), **turn("c")})
    m = min(0.4, max(0.0, margin))
    dist = max(1e-6, distance)
    near = max(1e-6, (dist - fit_at_z) / dist)
    b = mesh_bounds(t)
    solid = lambda c: F.when(F.col(c) == 0, d(1e-6)).otherwise(F.col(c))
    scale = F.least(d(max(0.01, width_mm) * (1 - m)) / solid("size_x"), d(max(0.01, height_mm) * (1 - m)) / solid("size_y")) * near
    b = b.select("mesh_id", *[F.col(f"centre_{k}").alias(f"_c{k}") for k in "xyz"], scale.alias("_s"), F.col("size_z").alias("_sz"))
    t = t.join(b, "mesh_id")
    t = t.withColumns({f"{v}{k}": (F.col(f"{v}{k}") - F.col(f"_c{k}")) * F.col("_s") for v in "abc" for k in "xyz"})
    true_depth = F.col("_sz") * F.col("_s")
    zs = F.when(true_depth > 1e-6, d(max(0.0, depth_mm)) / F.when(true_depth > 1e-6, true_depth).otherwise(d(1))).otherwise(d(0))
    return t.withColumn("zscale", zs).drop("_cx", "_cy", "_cz", "_s", "_sz")


def project_to_sheet(x: Column, y: Column, z: Column, ex: Column, ey: Column, distance: float) -> tuple[Column, Column, Column]:
    """Sheet position and nearness t = D / (D - z); t is null for a point in the eye plane."""
    room = d(distance) - z
    t = d(distance) / F.when(room != 0, room)
    return ex + t * (x - ex), ey + t * (y - ey), t


@dataclass(frozen=True)
class Shading:
    colour: tuple = (200, 200, 200)
    background: tuple = (255, 255, 255)
    ambient: float = 0.35
    azimuth: float = 30.0
    elevation: float = 40.0


def light_vector(s: Shading) -> tuple[float, float, float]:
    az, el = s.azimuth * math.pi / 180, s.elevation * math.pi / 180
    return math.sin(az) * math.cos(el), math.sin(el), math.cos(az) * math.cos(el)


def tiles(t: DataFrame, keys: list[str]) -> DataFrame:
    """Cut boxes x0..x1, y0..y1 into screen tiles and spread the tiles, then expand pixels inside each.

    One huge triangle or splat becomes many bounded tasks instead of one.
    """
    t = t.withColumn("_ty", F.explode(F.sequence(idiv("y0", TILE), idiv("y1", TILE))))
    t = t.withColumn("_tx", F.explode(F.sequence(idiv("x0", TILE), idiv("x1", TILE))))
    t = t.repartition(*keys, "_ty", "_tx")
    lo = lambda a, b: F.greatest(F.col(a), F.col(b) * TILE)
    hi = lambda a, b: F.least(F.col(a), F.col(b) * TILE + TILE - 1)
    t = t.withColumn("y", F.explode(F.sequence(lo("y0", "_ty"), hi("y1", "_ty"))))
    return t.withColumn("x", F.explode(F.sequence(lo("x0", "_tx"), hi("x1", "_tx")))).drop("_tx", "_ty")


def canvas(meshes: DataFrame, key: str, n_views: int, w: int, h: int) -> DataFrame:
    """Every pixel of every view of every mesh / cloud."""
    t = meshes.select(F.col(key).alias("image_id")).distinct()
    t = t.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(n_views - 1)))).withColumns({"w": F.lit(w), "h": F.lit(h)})
    return grid(t)


def raster_size(width_px: float, width_mm: float, height_mm: float, supersample: float) -> tuple[int, int, int]:
    ss = min(4, max(1, math.floor(supersample + 0.5)))
    w = max(1, math.floor(width_px + 0.5)) * ss
    return w, max(1, math.floor(width_px * height_mm / max(0.01, width_mm) + 0.5)) * ss, ss


def _weights(px: Column, py: Column) -> tuple[Column, Column, Column]:
    """Shares of the three corners at a point of the screen; all are 0 or more inside."""
    inv = d(1) / F.col("_area")
    w0 = ((F.col("s1") - px) * (F.col("q2") - py) - (F.col("q1") - py) * (F.col("s2") - px)) * inv
    w1 = ((F.col("s2") - px) * (F.col("q0") - py) - (F.col("q2") - py) * (F.col("s0") - px)) * inv
    return w0, w1, d(1) - w0 - w1


def project_triangles(tris: DataFrame, eyes: list[tuple[float, float]], w: int, h: int, width_mm: float, height_mm: float, distance: float, z_offset: float,
                      shading: Shading) -> DataFrame:
    """Triangles of ``fit_mesh`` as each eye sees them: corners ``s, q`` in pixels with nearness ``t``, light, box of pixels."""
    dist = max(1e-6, distance)
    table = F.array(*[F.struct(F.lit(i).alias("view"), d(ex).alias("_ex"), d(ey).alias("_ey")) for i, (ex, ey) in enumerate(eyes)])
    amb = min(1.0, max(0.0, shading.ambient))
    n = face_normal()
    lv = light_vector(shading)
    t = tris.withColumn("_df", d(amb) + F.abs(n[0] * lv[0] + n[1] * lv[1] + n[2] * lv[2]) * (1 - amb))
    t = t.select("*", F.inline(table))
    kx, ky = w / max(0.01, width_mm), h / max(0.01, height_mm)
    cols = {}
    for i, v in enumerate("abc"):
        x, y, near = project_to_sheet(F.col(f"{v}x"), F.col(f"{v}y"), F.col(f"{v}z") * F.col("zscale") + z_offset, F.col("_ex"), F.col("_ey"), dist)
        cols |= {f"s{i}": x * kx + w / 2, f"q{i}": d(h / 2) - y * ky, f"t{i}": near}
    extra = [c for c in ("uv", "rgb") if c in tris.columns]
    # Rows of one struct: filters on the corners are not rewritten into filters on the whole projection.
    corners = F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()])))
    t = t.select("mesh_id", "tri_id", "view", "_df", *extra, corners).filter("t0 > 0 and t1 > 0 and t2 > 0")
    area = (F.col("s1") - F.col("s0")) * (F.col("q2") - F.col("q0")) - (F.col("q1") - F.col("q0")) * (F.col("s2") - F.col("s0"))
    t = t.withColumn("_area", area).filter("_area <> 0")
    clip = lambda f, n, e: F.greatest(F.lit(0), F.floor(F.least(*e)).cast("int")) if f else F.least(F.lit(n - 1), F.ceil(F.greatest(*e)).cast("int"))
    t = t.withColumns({"x0": clip(True, w, ["s0", "s1", "s2"]), "x1": clip(False, w, ["s0", "s1", "s2"]),
                       "y0": clip(True, h, ["q0", "q1", "q2"]), "y1": clip(False, h, ["q0", "q1", "q2"])}).filter("x0 <= x1 and y0 <= y1")
    reach = F.greatest(*[F.abs(f"{a}{i}") for i in range(3) for a in "sq"], d(max(w, h)))
    more = {"_m": reach * reach / F.abs("_area") * 1e-13, "_top": F.greatest("t0", "t1", "t2")}
    inv = d(1) / F.col("_area")
    more |= {"_gx0": (F.col("q1") - F.col("q2")) * inv, "_gy0": (F.col("s2") - F.col("s1")) * inv, "_gx1": (F.col("q2") - F.col("q0")) * inv, "_gy1": (F.col("s0") - F.col("s2")) * inv}
    keep = ["mesh_id", "tri_id", "view", "_df", "_area", *[f"{a}{i}" for i in range(3) for a in "sqt"], "x0", "x1", "y0", "y1", *extra]
    return t.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in more.items()]))))


def _in_tiles(t: DataFrame) -> DataFrame:
    """One row per triangle and tile that its box meets, spread over all tasks."""
    t = t.withColumn("_ty", F.explode(F.sequence(idiv("y0", TILE), idiv("y1", TILE))))
    t = t.withColumn("_tx", F.explode(F.sequence(idiv("x0", TILE), idiv("x1", TILE))))
    return t.repartition("mesh_id", "tri_id", "view", "_ty", "_tx")


def _in_cells(t: DataFrame, w: int, h: int) -> DataFrame:
    """Cells of a tile that a triangle may touch, ``_xa .. _xb, _ya .. _yb``.

    Weights and nearness are linear on the screen, so the corners of a cell bound them (``_bound``). ``_m`` bounds the
    rounding of a weight; triangles too thin for such a bound (``_m`` of 0.5 or more) keep every cell.
    """
    for a in "yx":
        lo = F.greatest(F.col(f"{a}0"), F.col(f"_t{a}") * TILE)
        hi = F.least(F.col(f"{a}1"), F.col(f"_t{a}") * TILE + (TILE - 1))
        t = t.withColumn(f"_c{a}", F.explode(F.sequence(F.floor(lo / CELL).cast("int"), F.floor(hi / CELL).cast("int"))))
    box = {f"_{a}a": F.col(f"_c{a}") * CELL for a in "xy"} | {f"_{a}b": F.least(F.col(f"_c{a}") * CELL + (CELL - 1), F.lit(n - 1)) for a, n in (("x", w), ("y", h))}
    t = t.withColumns(box)
    w0, w1, _ = _weights(d("_xa") + 0.5, d("_ya") + 0.5)
    t = t.select("*", F.inline(F.array(F.struct(w0.alias("_b0"), w1.alias("_b1")))))
    return t.filter((F.col("_m") >= 0.5) | (F.least(*[_bound(k, "greatest") for k in range(3)]) >= -F.col("_m")))


def _linear(k: int | str) -> tuple[str, str, str]:
    """Value at a cell's first pixel and slopes: of weight k, or of the nearness ("t")."""
    if k == "t":
        parts = [_linear(i) for i in range(3)]
        return tuple("(" + " + ".join(f"{p[j]} * t{i}" for i, p in enumerate(parts)) + ")" for j in range(3))
    if k == 2:
        return "(1D - _b0 - _b1)", "(-_gx0 - _gx1)", "(-_gy0 - _gy1)"
    return f"_b{k}", f"_gx{k}", f"_gy{k}"


def _bound(k: int | str, side: str) -> Column:
    """``least`` or ``greatest`` value over a cell's pixels."""
    base, gx, gy = _linear(k)
    return F.expr(f"{base} + {side}(0D, {gx} * (_xb - _xa)) + {side}(0D, {gy} * (_yb - _ya))")


def _slack() -> Column:
    """A bound of the rounding of a nearness."""
    return (F.col("_m") * 4 + 1e-12) * F.col("_top")


def cell_floors(t: DataFrame, w: int, h: int) -> DataFrame:
    """(mesh_id, view, _ty, _tx, floors): per tile a map from cell to a nearness that every pixel of the cell is sure to reach.

    Only triangles of at least four cells' area count. One that fills a cell gives its least nearness there. Where
    several meet, each pixel takes the greatest nearness and the cell the least of its pixels, if all are filled: the
    levels are tile, cell, pixel, and pixels are made only along the edges of large triangles.
    """
    cell = ["mesh_id", "view", "_ty", "_tx", "_cy", "_cx"]
    big = _in_cells(_in_tiles(t.filter(F.abs("_area") >= 8 * CELL * CELL)), w, h).filter("_m < 0.5")
    inside = F.least(*[_bound(k, "least") for k in range(3)]) >= F.col("_m")
    whole = big.filter(inside).select(*cell, (_bound("t", "least") - _slack()).alias("floor"))
    edge = big.filter(~inside)
    edge = edge.withColumn("y", F.explode(F.sequence("_ya", "_yb"))).withColumn("x", F.explode(F.sequence("_xa", "_xb")))
    w0, w1, w2 = _weights(d("x") + 0.5, d("y") + 0.5)
    edge = edge.withColumns({"_w0": w0, "_w1": w1, "_w2": w2}).filter(F.least("_w0", "_w1", "_w2") >= 0)  # as pixels are decided
    near = F.col("_w0") * F.col("t0") + F.col("_w1") * F.col("t1") + F.col("_w2") * F.col("t2") - _slack()
    n = ((F.col("_xb") - F.col("_xa") + 1) * (F.col("_yb") - F.col("_ya") + 1)).alias("_n")
    edge = edge.select(*cell, n, "x", "y", near.alias("floor")).groupBy(*cell, "_n", "x", "y").agg(F.max("floor").alias("floor"))
    full = edge.groupBy(*cell, "_n").agg(F.min("floor").alias("floor"), F.count("*").alias("_k")).filter("_k = _n")
    best = whole.union(full.select(*cell, "floor")).groupBy(*cell).agg(F.max("floor").alias("floor"))
    entry = F.struct((F.col("_cy") * (1 << 24) + F.col("_cx")).alias("k"), "floor")
    return best.groupBy(*cell[:4]).agg(F.map_from_entries(F.collect_list(entry)).alias("floors"))  # at most one entry a cell


def visible_cells(t: DataFrame, w: int, h: int) -> DataFrame:
    """Cells of ``project_triangles`` rows in which something of the triangle may be seen.

    A cell is left out if the triangle misses it, or if all of it there is farther than the cell's floor; at equal
    nearness it stays, so ties are decided as without the floors. Floors have one row per tile of a view.
    """
    key = ["mesh_id", "view", "_ty", "_tx"]
    c = _in_cells(_in_tiles(t).join(cell_floors(t, w, h), key, "left"), w, h)
    floor = F.try_element_at("floors", F.col("_cy") * (1 << 24) + F.col("_cx"))
    hidden = (F.col("_m") < 0.5) & (F.least(_bound("t", "greatest"), F.col("_top")) + _slack() < floor)
    return c.filter(~F.coalesce(hidden, F.lit(False))).drop("floors", "_ty", "_tx", "_b0", "_b1")


def rasterize(tris: DataFrame, eyes: list[tuple[float, float]], width_px=64, width_mm=100.0, height_mm=100.0, distance=400.0, z_offset=0.0,
              supersample=1, shading: Shading = Shading(), texture: DataFrame | None = None) -> DataFrame:
    """(image_id, frame, w, h, x, y, r, g, b, a, t) of fitted triangles; frame is the eye, t the nearness (0 = nothing).

    ``tris`` comes from ``fit_mesh``; it may carry ``rgb`` (nine vertex bytes) or ``uv`` (six numbers,
    used with a ``texture`` raster whose image_id is the mesh).  The nearest triangle wins, the
    earliest one on ties.  What large triangles hide is dropped cell by cell before pixels are made.
    """
    w, h, _ = raster_size(width_px, width_mm, height_mm, supersample)
    extra = [c for c in ("uv", "rgb") if c in tris.columns]
    t = project_triangles(tris, eyes, w, h, width_mm, height_mm, distance, z_offset, shading)
    t = visible_cells(t, w, h)
    for a in "yx":
        t = t.withColumn(a, F.explode(F.sequence(F.greatest(f"{a}0", f"_{a}a"), F.least(f"{a}1", f"_{a}b"))))
    w0, w1, _ = _weights(d("x") + 0.5, d("y") + 0.5)
    t = t.withColumns({"_w0": w0, "_w1": w1})
    t = t.withColumn("_w2", d(1) - F.col("_w0") - F.col("_w1")).filter("_w0 >= 0 and _w1 >= 0 and _w2 >= 0")
    t = t.withColumns({"_p0": F.col("_w0") * F.col("t0"), "_p1": F.col("_w1") * F.col("t1"), "_p2": F.col("_w2") * F.col("t2")})
    t = t.withColumn("_t", F.col("_p0") + F.col("_p1") + F.col("_p2"))
    mix = lambda a, i, j, k: (F.col("_p0") * F.get(a, F.lit(i)) + F.col("_p1") * F.get(a, F.lit(j)) + F.col("_p2") * F.get(a, F.lit(k))) / F.col("_t")
    plain = [u8(F.col("_df") * float(v)) for v in shading.colour]
    textured = texture is not None and "uv" in extra
    if "rgb" in extra and not textured:
        plain = [F.when(F.col("rgb").isNotNull(), u8(mix("rgb", i, 3 + i, 6 + i) * F.col("_df"))).otherwise(v) for i, v in enumerate(plain)]
    uv = [mix("uv", 0, 2, 4), mix("uv", 1, 3, 5)] if textured else [F.lit(None).cast("double")] * 2
    frag = t.select(F.col("mesh_id").alias("image_id"), F.col("view").alias("frame"), *POS, F.struct(
        F.col("_t").alias("t"), (-F.col("tri_id")).alias("o"), *[v.alias(ch) for v, ch in zip(plain, RGB)], uv[0].alias("u"), uv[1].alias("v"), F.col("_df").alias("df")).alias("s"))
    paper = canvas(tris, "mesh_id", len(eyes), w, h).select(*IMG, *POS, F.struct(
        d(0).alias("t"), F.lit(-(1 << 62)).cast("long").alias("o"), *[F.lit(int(v)).alias(ch) for v, ch in zip(shading.background, RGB)],
        F.lit(None).cast("double").alias("u"), F.lit(None).cast("double").alias("v"), d(0).alias("df")).alias("s"))
    out = frag.union(paper).groupBy(*IMG, *POS).agg(F.max("s").alias("s"))
    out = out.select(*IMG, F.lit(w).alias("w"), F.lit(h).alias("h"), *POS, "s.r", "s.g", "s.b", F.lit(255).alias("a"), "s.t", "s.u", "s.v", "s.df")
    if textured:
        out = _textured(out, texture)
    return out.drop("u", "v", "df")


def _textured(out: DataFrame, texture: DataFrame) -> DataFrame:
    """Colour the visible pixels from the mesh's texture: wrapped bilinear sampling of the four texels."""
    size = texture.filter("x = 0 and y = 0").select("image_id", F.col("w").alias("tw"), F.col("h").alias("th"))
    t = out.filter("u is not null").join(size, "image_id")
    t = t.withColumns({"_fx": (F.col("u") - F.floor("u")) * F.col("tw") - 0.5, "_fy": (d(1) - (F.col("v") - F.floor("v"))) * F.col("th") - 0.5})
    t = t.withColumns({"_x0": ifloor("_fx"), "_y0": ifloor("_fy")})
    wrap = lambda c, n: (F.col(c) % F.col(n) + F.col(n)) % F.col(n)
    corner = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in (("", (0, 0)), ("10", (1, 0)), ("01", (0, 1)), ("11", (1, 1)))])
    e = t.select(*IMG, *POS, "_x0", "_y0", "tw", "th", F.explode(corner).alias("_c"))
    e = e.withColumns({"_xi": F.col("_x0") + F.col("_c.i"), "_yi": F.col("_y0") + F.col("_c.j")})
    e = e.select(*IMG, *POS, "_c.k", wrap("_xi", "tw").alias("_tx"), wrap("_yi", "th").alias("_ty"))
    tex = texture.select("image_id", F.col("x").alias("_tx"), F.col("y").alias("_ty"), *RGB)
    e = e.join(tex, ["image_id", "_tx", "_ty"])
    e = e.groupBy(*IMG, *POS).agg(*[F.max(F.when(F.col("k") == k, F.col(ch))).alias(f"_{ch}{k}") for ch in RGB for k in ("", "10", "01", "11")])
    t = t.join(e, [*IMG, *POS])
    wx, wy = F.col("_fx") - F.col("_x0"), F.col("_fy") - F.col("_y0")
    t = t.withColumns({ch: u8(u8(bilinear(f"_{ch}", wx, wy)) * F.col("df")) for ch in RGB}).select(out.columns)
    return out.filter("u is null").union(t)


def supersample_down(p: DataFrame, k: int) -> DataFrame:
    """Box filter by an integer factor; opaque."""
    if k <= 1:
        return p.select(*PIXEL)
    t = p.groupBy(*IMG, jsround(d("w") / k).alias("w"), jsround(d("h") / k).alias("h"), idiv("x", k).alias("x"), idiv("y", k).alias("y")).agg(
        *[F.sum(ch).alias(ch) for ch in RGB])
    return t.select(*PIXEL[:6], *[u8(d(ch) / float(k * k)).alias(ch) for ch in RGB], F.lit(255).alias("a"))


def depth_image(z: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """(grey depth raster, coverage per image) of a rendered view: near is white, nothing is black."""
    hit = F.when(F.col("t") > 0, F.col("t"))
    s = z.groupBy(*IMG).agg(F.min(hit).alias("_lo"), F.max(hit).alias("_hi"), F.count(hit).alias("n_hit"), F.count(F.lit(1)).alias("n"))
    t = z.filter((F.col("x") % k == 0) & (F.col("y") % k == 0)).join(s, IMG)
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(d(1))
    v = F.when(F.col("t") > 0, jsround((F.col("t") - F.col("_lo")) / span * 255.0)).otherwise(F.lit(0))
    grey = t.select(*IMG, jsround(d("w") / k).alias("w"), jsround(d("h") / k).alias("h"), idiv("x", k).alias("x"), idiv("y", k).alias("y"),
                    *[v.alias(ch) for ch in RGB], F.lit(255).alias("a"))
    return grey, s.select(*IMG, "n_hit", "n", (d("n_hit") / d("n")).alias("coverage"))


def _views(tris: DataFrame, eyes, depth_mm, setback, distance, fit: dict, render: dict) -> DataFrame:
    near = max(-MAX_POPOUT * max(1e-6, distance), setback)
    deep = max(0.0, depth_mm)
    m = fit_mesh(tris, depth_mm=deep, distance=distance, fit_at_z=-near, **fit)
    return rasterize(m, eyes, distance=distance, z_offset=-(near + deep / 2), **render)


def mesh_view_grid(tris: DataFrame, cols: int = 3, rows: int | None = None, cone_deg=30.0, distance=400.0, depth_mm=10.0, setback=0.0,
                   width_mm=100.0, height_mm=100.0, width_px=64, supersample=1, rotation=(0.0, 0.0, 0.0), margin=0.05,
                   shading: Shading = Shading(), texture: DataFrame | None = None) -> DataFrame:
    """All eye positions of a grid, row-major from the upper left (frame = view)."""
    rows = cols if rows is None else rows
    eyes = [(eye_offset(c, cols, cone_deg, distance, math), -eye_offset(r, rows, cone_deg, distance, math)) for r in range(rows) for c in range(cols)]
    z = _views(tris, eyes, depth_mm, setback, distance, dict(rotation=rotation, width_mm=width_mm, height_mm=height_mm, margin=margin),
               dict(width_px=width_px, width_mm=width_mm, height_mm=height_mm, supersample=supersample, shading=shading, texture=texture))
    return supersample_down(z, raster_size(width_px, width_mm, height_mm, supersample)[2])


def mesh_view_run(tris: DataFrame, views: int = 5, cone_deg=30.0, distance=400.0, depth_mm=10.0, setback=0.0, width_mm=100.0, height_mm=100.0,
                  width_px=64, supersample=1, rotation=(0.0, 0.0, 0.0), margin=0.05, shading: Shading = Shading(),
                  texture: DataFrame | None = None) -> DataFrame:
    """A one-dimensional run of views, left eye first."""
    eyes = [(eye_offset(i, views, cone_deg, distance, math), 0.0) for i in range(max(1, views))]
    z = _views(tris, eyes, depth_mm, setback, distance, dict(rotation=rotation, width_mm=width_mm, height_mm=height_mm, margin=margin),
               dict(width_px=width_px, width_mm=width_mm, height_mm=height_mm, supersample=supersample, shading=shading, texture=texture))
    return supersample_down(z, raster_size(width_px, width_mm, height_mm, supersample)[2])
