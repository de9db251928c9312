"""Registered queries: meshes, clouds, file formats."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from ..functions.core import d, hash2, luminance
from ..operators import cloud as cl
from ..operators import mesh as ms
from ..operators import stats
from ..schema import PIXEL, TRI, ensure_checkpoint_dir, spread
from ..sources import cloudio, files, graphio, images, meshio
from . import fixtures as fx
from . import sqlkit as K
from .catalog_raster import OUT, OUTS, rnd, srnd
from .registry import query


def scratch(s) -> str:
    ensure_checkpoint_dir(s)
    return f"{s.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


# ---- fixtures ------------------------------------------------------------------------------
def tris(s, sf):
    """one triangle per part, five meshes; dense tri_id per mesh."""
    p = spread(fx.table(s, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    k = F.col("p_partkey")
    t = p.withColumns({"v": hash2(k, F.lit(1), F.lit(5)), "u": hash2(k, F.lit(2), F.lit(9))})
    byte = lambda c, n: F.shiftright(c, n).bitwiseAND(F.lit(255).cast("long")).cast("double")
    r = F.col("p_size") / 10.0
    off = dict(ax=-r, ay=-r, az=d(0), bx=r, by=-r * 0.5, bz=r, cx=byte("u", 0) / 64.0, cy=r, cz=-r)
    c = dict(x=byte("v", 0), y=byte("v", 8), z=byte("v", 16))
    return t.select((k % 5).alias("mesh_id"), F.floor(k / 5).cast("long").alias("tri_id"), *[(c[n[1]] + off[n]).alias(n) for n in TRI])


_B = lambda c, n: f"(({c}>>{n})&255)::DOUBLE"
_C = {"x": _B("v", 0), "y": _B("v", 8), "z": _B("v", 16)}
_OFF = dict(ax="-q", ay="-q", az="0e0", bx="q", by="-q*0.5e0", bz="q", cx=f"{_B('u', 0)}/64e0", cy="q", cz="-q")
TR = ("tr AS (SELECT p_partkey%5 AS mesh_id, p_partkey//5 AS tri_id, " + ", ".join(f"{_C[n[1]]}+({_OFF[n]}) AS {n}" for n in TRI)
      + f" FROM (SELECT p_partkey, p_size/10e0 AS q, {K.hash2('p_partkey', '1', '5')} AS v, {K.hash2('p_partkey', '2', '9')} AS u FROM part))")
_BOUNDS = ("bd AS (SELECT mesh_id, count(*) AS triangles, " + ", ".join(
    f"min(least(a{k},b{k},c{k})) AS mn{k}, max(greatest(a{k},b{k},c{k})) AS mx{k}" for k in "xyz") + " FROM {0} GROUP BY mesh_id)")
_BCOLS = ", ".join(f"mn{k} AS min_{k}, mx{k} AS max_{k}, (mn{k}+mx{k})/2e0 AS centre_{k}, mx{k}-mn{k} AS size_{k}" for k in "xyz")
query("A8_mesh_bounds", K.sql(f"SELECT mesh_id, {_BCOLS} FROM bd", TR, _BOUNDS.format("tr")))(lambda s, sf: stats.mesh_bounds(tris(s, sf)))
query("A8_mesh_bounds_total", K.sql(f"SELECT {_BCOLS} FROM bd", TR, _BOUNDS.format("(SELECT 0 AS mesh_id, * EXCLUDE (mesh_id) FROM tr)")))(
    lambda s, sf: stats.mesh_bounds_total(tris(s, sf)))
query("A11_mesh_report", K.sql(f"SELECT mesh_id, triangles, false AS has_uv, mesh_id = 2 AS has_colour, {_BCOLS} FROM bd", TR, _BOUNDS.format("tr")))(
    lambda s, sf: stats.mesh_report(tris(s, sf).withColumn("rgb", F.when((F.col("mesh_id") == 2) & (F.col("tri_id") % 2 == 0), F.lit([1] * 9)))))


def splats(s, sf):
    """one splat per embedding, three clouds."""
    e = spread(fx.table(s, sf, "embeddings").select("vec_id", "embedding"), "vec_id")
    at = lambda i: F.col("embedding")[i].cast("double")
    from ..functions.core import u8

    q = [at(6), at(7), at(8), at(9) + 1.0]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    return e.select((F.col("vec_id") % 3).alias("cloud_id"), F.col("vec_id").alias("splat_id"), *[(at(i) * 10.0).alias(c) for i, c in enumerate(("px", "py", "pz"))],
                    *[F.exp(at(3 + i) * 2.0 - 3.0).alias(c) for i, c in enumerate(("sx", "sy", "sz"))], *[(v / n).alias(c) for v, c in zip(q, ("qx", "qy", "qz", "qw"))],
                    *[u8(at(10 + i) * 512.0 + 128.0).alias(c) for i, c in enumerate("rgb")], u8(at(13) * 400.0 + 160.0).alias("a"))


_E = lambda i: f"embedding[{i + 1}]::DOUBLE"
_QN = f"sqrt({_E(6)}*{_E(6)}+{_E(7)}*{_E(7)}+{_E(8)}*{_E(8)}+({_E(9)}+1e0)*({_E(9)}+1e0))"
SPL = ("sp AS (SELECT vec_id%3 AS cloud_id, vec_id AS splat_id, " + ", ".join(f"{_E(i)}*10e0 AS {c}" for i, c in enumerate(("px", "py", "pz"))) + ", "
       + ", ".join(f"exp({_E(3 + i)}*2e0-3e0) AS {c}" for i, c in enumerate(("sx", "sy", "sz"))) + ", "
       + ", ".join(f"({_E(6 + i)}{'+1e0' if i == 3 else ''})/{_QN} AS {c}" for i, c in enumerate(("qx", "qy", "qz", "qw"))) + ", "
       + ", ".join(f"{K.u8(f'{_E(10 + i)}*512e0+128e0')} AS {c}" for i, c in enumerate("rgb")) + f", {K.u8(f'{_E(13)}*400e0+160e0')} AS a FROM embeddings)")
_CB = ("cb AS (SELECT cloud_id, count(*) AS n, " + ", ".join(f"min(p{k}) AS mn{k}, max(p{k}) AS mx{k}" for k in "xyz") + " FROM sp GROUP BY cloud_id)")
_RAD = "sqrt((mxx-mnx)*(mxx-mnx)+(mxy-mny)*(mxy-mny)+(mxz-mnz)*(mxz-mnz))/2e0"
query("A9_cloud_bounds", K.sql(f"SELECT cloud_id, {_BCOLS}, {_RAD} AS radius FROM cb", SPL, _CB))(lambda s, sf: stats.cloud_bounds(splats(s, sf)))
query("A12_cloud_report", K.sql(f"SELECT cloud_id, n, (n*2)::BIGINT AS dropped, {_BCOLS}, {_RAD} AS radius FROM cb", SPL, _CB))(
    lambda s, sf: stats.cloud_report(splats(s, sf).withColumn("dropped", F.lit(2)), "dropped"))

# ---- M -------------------------------------------------------------------------------------
_COR = lambda cells: "(1e0+(" + "+".join(f"coalesce({c}, 0e0)" for c in cells) + ")/nullif(" + "+".join(f"({c} IS NOT NULL)::INTEGER" for c in cells) + ", 0)*10e0)"
_NB = {(i, j): f"n{i + 1}{j + 1}.v" for i in (-1, 0, 1) for j in (-1, 0, 1)}
_CELL = (f"hv AS (SELECT image_id, w, h, x, y, {K.lum()}/255e0 AS v FROM px WHERE {K.lum()} >= 110), "
         "cl AS (SELECT c.image_id, c.x, c.y, c.x*(100e0/c.w) AS x0, (c.x+1)*(100e0/c.w) AS x1, (c.h-c.y)*(100e0/c.w) AS yt, (c.h-c.y-1)*(100e0/c.w) AS yb, "
         f"{_COR([_NB[-1, -1], _NB[0, -1], _NB[-1, 0], 'c.v'])} AS za, {_COR([_NB[0, -1], _NB[1, -1], 'c.v', _NB[1, 0]])} AS zb, "
         f"{_COR(['c.v', _NB[1, 0], _NB[0, 1], _NB[1, 1]])} AS zc, {_COR([_NB[-1, 0], 'c.v', _NB[-1, 1], _NB[0, 1]])} AS zd, "
         f"{_NB[-1, 0]} IS NULL AS ow, {_NB[0, 1]} IS NULL AS os, {_NB[1, 0]} IS NULL AS oe, {_NB[0, -1]} IS NULL AS o_n FROM hv c "
         + " ".join(f"LEFT JOIN hv n{i + 1}{j + 1} ON n{i + 1}{j + 1}.image_id=c.image_id AND n{i + 1}{j + 1}.x=c.x+({i}) AND n{i + 1}{j + 1}.y=c.y+({j})"
                    for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)) + ")")
_P = {"a": "x0, yt, za", "b": "x1, yt, zb", "c": "x1, yb, zc", "d": "x0, yb, zd", "A": "x0, yt, 0e0", "B": "x1, yt, 0e0", "C": "x1, yb, 0e0", "D": "x0, yb, 0e0"}
_FACES = [("adc", "true"), ("acb", "true"), ("ABC", "true"), ("ACD", "true"), ("aAD", "ow"), ("aDd", "ow"), ("dDC", "os"), ("dCc", "os"), ("cCB", "oe"), ("cBb", "oe"),
          ("bBA", "o_n"), ("bAa", "o_n")]
query("M1_heightmap_to_mesh", K.sql(
    "SELECT mesh_id, " + ", ".join(f"{srnd(n)} AS {n}" for n in TRI) + " FROM (" + " UNION ALL ".join(
        f"SELECT image_id AS mesh_id, {', '.join(f'{e.strip()} AS {n}' for e, n in zip(', '.join(_P[q] for q in f).split(','), TRI))} FROM cl WHERE {cond}" for f, cond in _FACES) + ")",
    K.PX, _CELL))(lambda s, sf: ms.heightmap_to_mesh(fx.px_embed(s, sf), 110, 1.0, 10.0, 100.0).select("mesh_id", *[rnd(n).alias(n) for n in TRI]))
_ZZ = f"CASE WHEN {K.lum()} >= 110 THEN 1e0+{K.jsr(f'{K.lum()}/255e0*5e0')}/5e0*10e0 ELSE 0e0 END"
query("M2_plateau_areas", K.sql(
    "SELECT image_id, 'top' AS kind, round(z, 3) AS level, count(*)::DOUBLE AS area FROM pz WHERE z > 0 GROUP BY ALL UNION ALL SELECT image_id, 'bottom', 0e0, count(*)::DOUBLE FROM pz WHERE z > 0 GROUP BY ALL UNION ALL "
    f"SELECT image_id, 'wall_x', 0e0, {srnd('sum(abs(z-l))+sum(CASE WHEN x=w-1 THEN z ELSE 0e0 END)', 3)} FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY image_id, y ORDER BY x), 0e0) AS l FROM pz) GROUP BY image_id UNION ALL "
    f"SELECT image_id, 'wall_y', 0e0, {srnd('sum(abs(z-l))+sum(CASE WHEN y=h-1 THEN z ELSE 0e0 END)', 3)} FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY image_id, x ORDER BY y), 0e0) AS l FROM pz) GROUP BY image_id",
    K.PX, f"pz AS (SELECT image_id, w, h, x, y, {_ZZ} AS z FROM px)"))(
    lambda s, sf: ms.plateau_rects(fx.px_embed(s, sf), 6, 110, 1.0, 10.0).withColumn("n", F.when(F.col("kind").startswith("wall"), (F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0")) * (F.col("z1") - F.col("z0"))).otherwise(
        (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).groupBy("image_id", "kind", F.when(F.col("kind") == "top", F.round("z1", 3)).otherwise(F.lit(0.0)).alias("level")).agg(rnd(F.sum("n"), 3).alias("area")))


@query("M2_plateau_mesh")
def _plateau(s, sf):
    return ms.plateau_mesh(fx.px_embed(s, sf), 100.0, levels=6, min_white=110, base=1.0, depth=10.0).select("mesh_id", *[rnd(n).alias(n) for n in TRI])


_NRM = ("nr AS (SELECT *, sqrt(n0*n0+n1*n1+n2*n2) AS ln FROM (SELECT *, uy*vz-uz*vy AS n0, uz*vx-ux*vz AS n1, ux*vy-uy*vx AS n2 FROM (SELECT *, bx-ax AS ux, b_y-ay AS uy, bz-az AS uz, "
        "cx-ax AS vx, cy-ay AS vy, cz-az AS vz FROM (SELECT * RENAME (by AS b_y) FROM {0}))))")
query("M3_face_normals", K.sql(
    f"SELECT mesh_id, tri_id, " + ", ".join(f"{srnd(f'CASE WHEN ln=0 THEN n{i} ELSE n{i}/ln END')} AS n{k}" for i, k in enumerate("xyz")) + " FROM nr", TR, _NRM.format("tr")))(
    lambda s, sf: ms.face_normals(tris(s, sf)).select("mesh_id", "tri_id", *[rnd(f"n{k}").alias(f"n{k}") for k in "xyz"]))
_ROT = (20.0, -35.0, 10.0)


def _fit_sql() -> str:
    (cx, sx), (cy, sy), (cz, sz) = [(f"({math.cos(v * math.pi / 180)!r})::DOUBLE", f"({math.sin(v * math.pi / 180)!r})::DOUBLE") for v in _ROT]
    turn = []
    for v in "abc":
        y1, z1 = f"({v}y*{cx}-{v}z*{sx})", f"({v}y*{sx}+{v}z*{cx})"
        x2, z2 = f"({v}x*{cy}+{z1}*{sy})", f"(-{v}x*{sy}+{z1}*{cy})"
        turn += [f"{x2}*{cz}-{y1}*{sz} AS {v}x", f"{x2}*{sz}+{y1}*{cz} AS {v}y", f"{z2} AS {v}z"]
    scale = "least(57e0/(mxx-mnx), 38e0/(mxy-mny))*((300e0+4e0)/300e0)"
    return (f"tn AS (SELECT mesh_id, tri_id, {', '.join(turn)} FROM tr), {_BOUNDS.format('tn')}, "
            f"ft AS (SELECT t.mesh_id, tri_id, {', '.join(f'({n}-(mn{n[1]}+mx{n[1]})/2e0)*({scale}) AS {n}' for n in TRI)}, 8e0/((mxz-mnz)*({scale})) AS zscale FROM tn t JOIN bd USING (mesh_id))")


_FITKW = dict(rotation=_ROT, width_mm=60.0, height_mm=40.0, margin=0.05)
query("M4_fit_mesh", K.sql(f"SELECT mesh_id, tri_id, {', '.join(f'{srnd(n)} AS {n}' for n in TRI)}, {srnd('zscale')} AS zscale FROM ft", TR, _fit_sql()))(
    lambda s, sf: ms.fit_mesh(tris(s, sf), depth_mm=8.0, distance=300.0, fit_at_z=-4.0, **_FITKW).select("mesh_id", "tri_id", *[rnd(n).alias(n) for n in TRI], rnd("zscale").alias("zscale")))


@query("M5_project_to_sheet", K.sql(
    f"SELECT mesh_id, tri_id, {srnd('15e0+t*(ax-15e0)')} AS sx, {srnd('-7e0+t*(ay+7e0)')} AS sy, {srnd('t')} AS t FROM (SELECT *, 300e0/(300e0-az) AS t FROM tr)", TR))
def _project(s, sf):
    x, y, t = ms.project_to_sheet(F.col("ax"), F.col("ay"), F.col("az"), d(15), d(-7), 300.0)
    return tris(s, sf).select("mesh_id", "tri_id", rnd(x).alias("sx"), rnd(y).alias("sy"), rnd(t).alias("t"))


_EYES = [(-40.0, 0.0), (25.0, 10.0)]
_SHADE = ms.Shading((210, 180, 90), (12, 24, 48), 0.3, 25.0, 50.0)


def raster_sql(eyes, w: int, h: int, zoff: float) -> str:
    """CTE zb: brute-force z-buffer of ft over every pixel."""
    lv = ms.light_vector(_SHADE)
    vals = ", ".join(f"({i}, {ex!r}::DOUBLE, {ey!r}::DOUBLE)" for i, (ex, ey) in enumerate(eyes))
    kx, ky = f"({w / 60.0!r})::DOUBLE", f"({h / 40.0!r})::DOUBLE"
    proj = ", ".join(f"300e0/(300e0-({v}z*zscale+{zoff!r}::DOUBLE)) AS t{i}" for i, v in enumerate("abc"))
    scr = ", ".join(f"(ex+t{i}*({v}x-ex))*{kx}+{w / 2!r}::DOUBLE AS s{i}, {h / 2!r}::DOUBLE-(ey+t{i}*({'b_y' if v == 'b' else v + 'y'}-ey))*{ky} AS q{i}" for i, v in enumerate("abc"))
    return (
        _NRM.format("ft") + f", r0 AS (SELECT *, 0.3e0+0.7e0*abs((n0*{lv[0]!r}::DOUBLE+n1*{lv[1]!r}::DOUBLE+n2*{lv[2]!r}::DOUBLE)/(CASE WHEN ln=0 THEN 1e0 ELSE ln END)) AS df, {proj} FROM nr, (VALUES {vals}) e(view, ex, ey)), "
        f"r1 AS (SELECT *, {scr} FROM r0), r2 AS (SELECT *, (s1-s0)*(q2-q0)-(q1-q0)*(s2-s0) AS ar FROM r1), "
        f"r3 AS (SELECT mesh_id, view, tri_id, df, t0, t1, t2, x::INTEGER AS x, y::INTEGER AS y, ((s1-(x+0.5e0))*(q2-(y+0.5e0))-(q1-(y+0.5e0))*(s2-(x+0.5e0)))*(1e0/ar) AS w0, "
        f"((s2-(x+0.5e0))*(q0-(y+0.5e0))-(q2-(y+0.5e0))*(s0-(x+0.5e0)))*(1e0/ar) AS w1 FROM r2, range({w}) a(x), range({h}) b(y) WHERE ar <> 0 AND x BETWEEN floor(least(s0,s1,s2)) AND ceil(greatest(s0,s1,s2)) "
        "AND y BETWEEN floor(least(q0,q1,q2)) AND ceil(greatest(q0,q1,q2))), "
        "r4 AS (SELECT *, w0*t0+w1*t1+(1e0-w0-w1)*t2 AS t FROM r3 WHERE w0>=0 AND w1>=0 AND 1e0-w0-w1>=0), "
        "r5 AS (SELECT * FROM r4 QUALIFY row_number() OVER (PARTITION BY mesh_id, view, x, y ORDER BY t DESC, tri_id)=1), "
        f"zb AS (SELECT m.mesh_id AS image_id, v.view AS frame, {w} AS w, {h} AS h, x.x::INTEGER AS x, y.y::INTEGER AS y, " + ", ".join(
            f"CASE WHEN r5.t IS NULL THEN {bg} ELSE {K.u8(f'df*{c}e0')} END AS {ch}" for ch, c, bg in zip("rgb", _SHADE.colour, _SHADE.background))
        + f", 255 AS a, coalesce(r5.t, 0e0) AS t FROM (SELECT DISTINCT mesh_id FROM ft) m, (VALUES {vals}) v(view, ex, ey), range({w}) x(x), range({h}) y(y) "
        "LEFT JOIN r5 ON r5.mesh_id=m.mesh_id AND r5.view=v.view AND r5.x=x.x AND r5.y=y.y)"
    )


def rendered(s, sf, ss=1):
    m = ms.fit_mesh(tris(s, sf), depth_mm=8.0, distance=300.0, fit_at_z=-4.0, **_FITKW)
    return ms.rasterize(m, _EYES, 24, 60.0, 40.0, 300.0, -8.0, ss, _SHADE)


_RAST = (TR, _fit_sql(), raster_sql(_EYES, 24, 16, -8.0))
query("M6_rasterize", K.sql(f"SELECT image_id, frame, x, y, r, g, b, {srnd('t')} AS t FROM zb", *_RAST))(
    lambda s, sf: rendered(s, sf).select("image_id", "frame", "x", "y", "r", "g", "b", rnd("t").alias("t")))
_DOWN = lambda src, k, n: (
    f"SELECT image_id, frame, x//{k} AS x, y//{k} AS y, " + ", ".join(f"{K.u8(f'sum({c})/{n}e0')} AS {c}" for c in "rgb") + f", 255 AS a FROM {src} GROUP BY image_id, frame, x//{k}, y//{k}")
query("M7_supersample_down", K.sql(_DOWN("pp", 4, 16), K.PART))(lambda s, sf: ms.supersample_down(fx.px_part(s, sf), 4).select(*OUT))
_DEP = ("SELECT image_id, frame, x, y, CASE WHEN t > 0 THEN " + K.jsr("(t-lo)/(CASE WHEN hi > lo THEN hi-lo ELSE 1e0 END)*255e0") +
        " ELSE 0 END AS r FROM zb JOIN (SELECT image_id, frame, min(t) FILTER (t>0) AS lo, max(t) FILTER (t>0) AS hi FROM zb GROUP BY ALL) USING (image_id, frame)")
query("M8_depth_image", K.sql(_DEP, *_RAST))(lambda s, sf: ms.depth_image(rendered(s, sf))[0].select("image_id", "frame", "x", "y", "r"))
query("M8_depth_coverage", K.sql("SELECT image_id, frame, count(*) FILTER (t>0) AS n_hit, count(*) AS n FROM zb GROUP BY ALL", *_RAST))(
    lambda s, sf: ms.depth_image(rendered(s, sf))[1].select("image_id", "frame", "n_hit", "n"))
_H = 30.0 * math.pi / 360
_GE = [(math.tan((c * 2 - 1) * _H) * 300.0, -math.tan((r * 2 - 1) * _H) * 300.0) for r in (0, 1) for c in (0, 1)]
_RE = [(math.tan((i / 2 * 2 - 1) * _H) * 300.0, 0.0) for i in range(3)]
_VKW = dict(cone_deg=30.0, distance=300.0, depth_mm=8.0, setback=4.0, width_mm=60.0, height_mm=40.0, rotation=_ROT, margin=0.05, shading=_SHADE)
query("M9_mesh_view_grid", K.sql("SELECT image_id, frame, x, y, r, g, b FROM zb", TR, _fit_sql(), raster_sql(_GE, 18, 12, -8.0)))(
    lambda s, sf: ms.mesh_view_grid(tris(s, sf), 2, 2, width_px=18, **_VKW).select("image_id", "frame", "x", "y", "r", "g", "b"))
query("M10_mesh_view_run", K.sql(_DOWN("zb", 2, 4), TR, _fit_sql(), raster_sql(_RE, 24, 16, -8.0)))(
    lambda s, sf: ms.mesh_view_run(tris(s, sf), 3, width_px=12, supersample=2, **_VKW).select(*OUT))

# ---- X -------------------------------------------------------------------------------------
_R5 = f"({math.sqrt(0.5)!r})::DOUBLE"
query("X1_orient_y_down", K.sql(f"SELECT splat_id, {srnd('-py')} AS py, {srnd('-pz')} AS pz, {srnd('qw')} AS qx, {srnd('-qz')} AS qy, {srnd('qy')} AS qz, {srnd('-qx')} AS qw FROM sp", SPL))(
    lambda s, sf: cl.orient_cloud(splats(s, sf), "-y").select("splat_id", *[rnd(c).alias(c) for c in ("py", "pz", "qx", "qy", "qz", "qw")]))
query("X1_orient_z_up", K.sql(
    f"SELECT splat_id, {srnd('pz')} AS py, {srnd('-py')} AS pz, {srnd(f'{_R5}*qx-{_R5}*qw')} AS qx, {srnd(f'{_R5}*qy+{_R5}*qz')} AS qy, {srnd(f'{_R5}*qz-{_R5}*qy')} AS qz, {srnd(f'{_R5}*qw+{_R5}*qx')} AS qw FROM sp", SPL))(
    lambda s, sf: cl.orient_cloud(splats(s, sf), "z").select("splat_id", *[rnd(c).alias(c) for c in ("py", "pz", "qx", "qy", "qz", "qw")]))
_CA = "cam AS (SELECT splat_id, px*9e0*pi()/180e0 AS p, py*9e0*pi()/180e0 AS y, pz*9e0*pi()/180e0 AS r FROM sp)"
query("X2_camera_axes", K.sql(
    f"SELECT splat_id, {srnd('cos(y)*cos(r)+sin(y)*sin(p)*sin(r)')} AS right_x, {srnd('cos(p)*sin(r)')} AS right_y, {srnd('-sin(y)*cos(r)+cos(y)*sin(p)*sin(r)')} AS right_z, "
    f"{srnd('-cos(y)*sin(r)+sin(y)*sin(p)*cos(r)')} AS up_x, {srnd('cos(p)*cos(r)')} AS up_y, {srnd('sin(y)*sin(r)+cos(y)*sin(p)*cos(r)')} AS up_z, {srnd('-sin(y)*cos(p)')} AS forward_x, "
    f"{srnd('sin(p)')} AS forward_y, {srnd('-cos(y)*cos(p)')} AS forward_z FROM cam", SPL, _CA))(
    lambda s, sf: cl.camera_axes(splats(s, sf).select("splat_id", *[(F.col(f"p{k}") * 9.0).alias(n) for k, n in zip("xyz", ("pitch", "yaw", "roll"))])).select(
        "splat_id", *[rnd(f"{a}_{k}").alias(f"{a}_{k}") for a in ("right", "up", "forward") for k in "xyz"]))
query("X3_framing_camera", K.sql(
    f"SELECT cloud_id, {srnd('(mnx+mxx)/2e0')} AS px, {srnd('(mny+mxy)/2e0')} AS py, {srnd(f'(mnz+mxz)/2e0+{_RAD}')} AS pz, {srnd(f'{_RAD}*2e0/100e0')} AS scale FROM cb", SPL, _CB))(
    lambda s, sf: cl.framing_camera(splats(s, sf), 100.0).select("cloud_id", *[rnd(c).alias(c) for c in ("px", "py", "pz", "scale")]))
VIEW = cl.CloudView(cl.Camera((0.3, -0.2, 2.0), (10.0, -20.0, 5.0), 0.1), 60.0, 40.0, 300.0, 20.0, 2, 0, 18, (250, 240, 230), 1, 0.0)
_BS = [f"({v!r})::DOUBLE" for v in cl.camera_basis(10.0, -20.0, 5.0)]
_EX = [e[0] for e in VIEW.eyes()]
_CS = (
    "w0 AS (SELECT *, (px-0.3e0)*(1e0/0.1e0) AS wx, (py+0.2e0)*(1e0/0.1e0) AS wy, (pz-2e0)*(1e0/0.1e0) AS wz FROM sp), "
    f"w1 AS (SELECT *, {_BS[0]}*wx+{_BS[1]}*wy+{_BS[2]}*wz AS cx, {_BS[3]}*wx+{_BS[4]}*wy+{_BS[5]}*wz AS cy, {_BS[6]}*wx+{_BS[7]}*wy+{_BS[8]}*wz AS cz FROM w0), "
    "w2 AS (SELECT *, 300e0/(300e0-cz) AS t FROM w1), w3 AS (SELECT *, 3e0*greatest(sx,sy,sz)*(1e0/0.1e0)*t AS rc FROM w2), "
    f"w4 AS (SELECT *, CASE WHEN cz > 0 THEN 'culled' WHEN t*cx+({max(map(abs, _EX))!r}::DOUBLE*(1e0-t)+rc) < -30 OR t*cx-({max(map(abs, _EX))!r}::DOUBLE*(1e0-t)+rc) > 30 OR t*cy+rc < -20 OR t*cy-rc > 20 THEN 'off' ELSE 'kept' END AS state FROM w3)"
)
query("X4_cull_cloud", K.sql(f"SELECT splat_id, state, {srnd('cx')} AS cx, {srnd('cy')} AS cy, {srnd('cz')} AS cz FROM w4", SPL, _CS))(
    lambda s, sf: cl.cull_cloud(splats(s, sf), VIEW).select("splat_id", "state", *[rnd(c).alias(c) for c in ("cx", "cy", "cz")]))
_STRIDE = ("SELECT k0.{key} FROM (SELECT *, row_number() OVER (PARTITION BY {grp} ORDER BY {key})-1 AS k, count(*) OVER (PARTITION BY {grp}) AS n FROM {src}) k0 WHERE n <= {m} OR k IN "
           "(SELECT least(n-1, floor(i*(n/{m}e0))) FROM range({m}) t(i) WHERE i < floor(n/(n/{m}e0)))")
query("X5_thin_to_budget", K.sql(f"SELECT splat_id, greatest(0, n-70) AS dropped FROM (SELECT k0.splat_id, n FROM ({'SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY splat_id)-1 AS k, count(*) OVER (PARTITION BY cloud_id) AS n FROM sp'}) k0 "
                                 "WHERE n <= 70 OR k IN (SELECT least(n-1, floor(i*(n/70e0))) FROM range(70) t(i) WHERE i < floor(n/(n/70e0))))", SPL))(
    lambda s, sf: cl.thin_to_budget(splats(s, sf), "cloud_id", "splat_id", 70).select("splat_id", "dropped"))
query("S11_stride_sample", "SELECT event_id, n-777 AS dropped FROM (SELECT event_id, row_number() OVER (ORDER BY event_id)-1 AS k, count(*) OVER () AS n FROM events) k0 WHERE k IN "
      "(SELECT least(n-1, floor(i*(n/777e0))) FROM range(777) t(i) WHERE i < floor(n/(n/777e0)))")(
    lambda s, sf: cl.stride_sample(fx.table(s, sf, "events").select(F.lit(0).alias("g"), "event_id"), "g", "event_id", 777).select("event_id", "dropped"))
_CV0 = ("v0 AS (SELECT *, 1-2*(qy*qy+qz*qz) AS r00, 2*(qx*qy-qw*qz) AS r01, 2*(qx*qz+qw*qy) AS r02, 2*(qx*qy+qw*qz) AS r10, 1-2*(qx*qx+qz*qz) AS r11, 2*(qy*qz-qw*qx) AS r12, "
        "2*(qx*qz-qw*qy) AS r20, 2*(qy*qz+qw*qx) AS r21, 1-2*(qx*qx+qy*qy) AS r22 FROM w4 WHERE state='kept'), ")
_CV = (_CV0 + "v1 AS (SELECT *, " + ", ".join(f"({_BS[3 * i]}*r0{j}+{_BS[3 * i + 1]}*r1{j}+{_BS[3 * i + 2]}*r2{j})*(s{'xyz'[j]}*10e0) AS m{i}{j}" for i in range(3) for j in range(3)) + " FROM v0), "
       "cv AS (SELECT *, " + ", ".join(f"m{i}0*m{k}0+m{i}1*m{k}1+m{i}2*m{k}2 AS k{i}{k}" for i, k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))) + " FROM v1)")


def seen(s, sf):
    return cl.camera_covariance(cl.cull_cloud(splats(s, sf), VIEW).filter("state = 'kept'"), VIEW.camera)


_K6 = ("k00", "k01", "k02", "k11", "k12", "k22")
query("X6_camera_covariance", K.sql(f"SELECT splat_id, {', '.join(f'{srnd(k, 5)} AS {k}' for k in _K6)} FROM cv", SPL, _CS, _CV))(
    lambda s, sf: seen(s, sf).select("splat_id", *[rnd(k, 5).alias(k) for k in _K6]))
_KP = "(18e0/60e0)"
_FP = (
    "f0 AS (SELECT cv.* EXCLUDE (t), v.view, v.ex, 300e0/(300e0-cz) AS t FROM cv, (VALUES " + ", ".join(f"({i}, {e!r}::DOUBLE)" for i, e in enumerate(_EX)) + ") v(view, ex) WHERE a <> 0), "
    "f1 AS (SELECT *, ex+t*(cx-ex) AS bx, t*cy AS b_y, (cx-ex)*t*t/300e0 AS j0, cy*t*t/300e0 AS j1 FROM f0), "
    f"f2 AS (SELECT *, (t*t*k00+2*t*j0*k02+j0*j0*k22)*{_KP}*{_KP}+0.3e0 AS va, (t*t*k11+2*t*j1*k12+j1*j1*k22)*{_KP}*{_KP}+0.3e0 AS vb, (t*t*k01+t*j1*k02+j0*t*k12+j0*j1*k22)*{_KP}*{_KP} AS vc FROM f1 WHERE abs(bx) <= 60 AND abs(b_y) <= 40), "
    f"fp AS (SELECT *, va*vb-vc*vc AS det, ceil(3*sqrt(greatest((va+vb)/2+sqrt(greatest(0, (va-vb)/2*(va-vb)/2+vc*vc)), 0.3e0)))::INTEGER AS radius, (bx+30)*{_KP} AS sx_px, (20-b_y)*{_KP} AS sy_px FROM f2)"
)
query("X7_splat_footprint", K.sql(
    f"SELECT splat_id, view, radius, {srnd('sx_px', 5)} AS sx_px, {srnd('sy_px', 5)} AS sy_px, {srnd('vb/det', 5)} AS i00, {srnd('-vc/det', 5)} AS i01, {srnd('va/det', 5)} AS i11 FROM fp", SPL, _CS, _CV, _FP))(
    lambda s, sf: cl.splat_footprint(seen(s, sf), VIEW).select("splat_id", "view", "radius", *[rnd(c, 5).alias(c) for c in ("sx_px", "sy_px", "i00", "i01", "i11")]))
_PX8 = (
    "zr AS (SELECT cloud_id, view, min(cz) AS lo, max(cz) AS hi FROM fp GROUP BY ALL), "
    "q0 AS (SELECT fp.*, floor(least(65535e0, (cz-lo)/greatest(1e-6, hi-lo)*65535e0))::INTEGER AS bk FROM fp JOIN zr USING (cloud_id, view)), "
    "q1 AS (SELECT *, x.x::INTEGER AS xx, y.y::INTEGER AS yy, x.x+0.5e0-sx_px AS dx, y.y+0.5e0-sy_px AS dy FROM q0, range(18) x(x), range(12) y(y) WHERE x.x BETWEEN floor(sx_px-radius) AND ceil(sx_px+radius) AND y.y BETWEEN floor(sy_px-radius) AND ceil(sy_px+radius)), "
    "q2 AS (SELECT *, a/255e0*exp(-(0.5e0*(vb/det*dx*dx+2*(-vc/det)*dx*dy+va/det*dy*dy))) AS av FROM q1 WHERE 0.5e0*(vb/det*dx*dx+2*(-vc/det)*dx*dy+va/det*dy*dy) <= 8), "
    "q3 AS (SELECT *, row_number() OVER (PARTITION BY cloud_id, view, xx, yy ORDER BY bk, splat_id) AS od FROM q2 WHERE av >= 1e0/512e0), "
    # the blend itself, one splat after the other from the back
    "bl AS (SELECT cloud_id, view, xx, yy, list(struct_pack(av := av, r := r, g := g, b := b, z := cz) ORDER BY od) AS l FROM q3 GROUP BY ALL), "
    "ac AS (SELECT cloud_id AS image_id, view AS frame, xx AS x, yy AS y, " + ", ".join(
        f"list_reduce(list_transform(l, lambda s: [s.av, s.{c}/255e0*s.av]), lambda p, q: [q[1]+p[1]*(1e0-q[1]), q[2]+p[2]*(1e0-q[1])])[2] AS p{c}" for c in "rgb")
    + ", list_reduce(list_transform(l, lambda s: s.av), lambda p, q: q+p*(1e0-q)) AS alpha, list_reduce(list_transform(l, lambda s: [s.av, s.z*s.av]), lambda p, q: [q[1]+p[1]*(1e0-q[1]), q[2]+p[2]*(1e0-q[1])])[2] AS depth FROM bl)"
)


def blended(s, sf):
    return cl.composite_splats(cl.splat_footprint(seen(s, sf), VIEW))


_XA = (SPL, _CS, _CV, _FP, _PX8)
query("X8_composite_splats", K.sql(f"SELECT image_id, frame, x, y, {', '.join(f'{srnd(c, 5)} AS {c}' for c in ('pr', 'pg', 'pb', 'alpha', 'depth'))} FROM ac", *_XA))(
    lambda s, sf: blended(s, sf).select("image_id", "frame", "x", "y", *[rnd(c, 5).alias(c) for c in ("pr", "pg", "pb", "alpha", "depth")]))
_RES = ("SELECT c.image_id, c.frame::INTEGER AS frame, c.x::INTEGER AS x, c.y::INTEGER AS y, " + ", ".join(
    f"{K.u8(f'coalesce(p{c}*255e0-alpha*{bg}e0, 0e0)+{bg}e0')} AS {c}" for c, bg in zip("rgb", VIEW.background))
    + " FROM (SELECT k.cloud_id AS image_id, frame, x, y FROM (SELECT DISTINCT cloud_id FROM sp) k, range(2) f(frame), range(18) a(x), range(12) b(y)) c LEFT JOIN ac USING (image_id, frame, x, y)")
query("X9_resolve_views", K.sql(_RES, *_XA))(lambda s, sf: cl.resolve_views(blended(s, sf), splats(s, sf), VIEW).select("image_id", "frame", "x", "y", "r", "g", "b"))
query("X9_resolve_depth", K.sql(
    f"SELECT image_id, frame, x, y, {K.u8('(z-lo)/(CASE WHEN hi>lo THEN hi-lo ELSE 1e0 END)*255e0')} AS v FROM (SELECT *, depth/alpha AS z FROM ac WHERE alpha >= 0.02e0) JOIN "
    "(SELECT image_id, frame, min(depth/alpha) AS lo, max(depth/alpha) AS hi FROM ac WHERE alpha >= 0.02e0 GROUP BY ALL) USING (image_id, frame)", *_XA))(
    lambda s, sf: cl.resolve_depth(blended(s, sf), VIEW)[0])
query("X9_depth_coverage", K.sql(f"SELECT image_id, frame, count(*) AS n_hit, {srnd('count(*)/216e0')} AS coverage FROM ac WHERE alpha >= 0.02e0 GROUP BY ALL", *_XA))(
    lambda s, sf: cl.resolve_depth(blended(s, sf), VIEW)[1].select("image_id", "frame", "n_hit", rnd("coverage").alias("coverage")))
query("X10_cloud_views", K.sql(_RES, *_XA))(lambda s, sf: cl.cloud_views(splats(s, sf), VIEW).select("image_id", "frame", "x", "y", "r", "g", "b"))

# ---- S: files ------------------------------------------------------------------------------
query("S2_write_read_pixels", K.sql(f"SELECT {K.OUTS} FROM px", K.PX))(lambda s, sf: (lambda path: (images.write_pixels(fx.px_embed(s, sf), path), images.read_pixels(s, path))[1])(scratch(s)).select(*OUTS))
query("S17_prompt_table", "SELECT doc_id, 'Describe this text.' AS text FROM documents")(
    lambda s, sf: images.prompt_table(fx.table(s, sf, "documents").select("doc_id"), "Describe this text."))


def ply_columns(s, sf):
    at = lambda i: F.col("embedding")[i].cast("double")
    names = ["x", "y", "z", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3", "f_dc_0", "f_dc_1", "f_dc_2", "opacity"]
    return spread(fx.table(s, sf, "embeddings"), "vec_id").select(F.col("vec_id").alias("splat_id"), *[(at(i) * 8.0).alias(n) for i, n in enumerate(names)])


_PQ = "sqrt(" + "+".join(f"{_E(i)}*8e0*({_E(i)}*8e0)" for i in (7, 8, 9, 6)) + ")"
query("S9_decode_ply_columns", (
    "SELECT vec_id AS splat_id, " + ", ".join(f"{srnd(f'exp({_E(3 + i)}*8e0)')} AS s{k}" for i, k in enumerate("xyz")) + ", " + ", ".join(f"{srnd(f'{_E(i)}*8e0/{_PQ}')} AS {n}" for i, n in ((7, "qx"), (8, "qy"), (9, "qz"), (6, "qw")))
    + ", " + ", ".join(f"{K.u8(f'(0.5e0+{cloudio.SH_C0!r}::DOUBLE*({_E(10 + i)}*8e0))*255e0')} AS {c}" for i, c in enumerate("rgb")) + f", {K.u8(f'1e0/(1e0+exp(-({_E(13)}*8e0)))*255e0')} AS a FROM embeddings"))(
    lambda s, sf: cloudio.decode_ply_columns(ply_columns(s, sf)).select("splat_id", *[rnd(c).alias(c) for c in ("sx", "sy", "sz", "qx", "qy", "qz", "qw")], *"rgba"))
_CODE = [f"{n}{i}" for n, k in (("lo", 3), ("hi", 3), ("q", 4), ("s", 3), ("c", 4)) for i in range(k)]
_BOOK_S, _BOOK_C = [i / 40 - 3 for i in range(200)], [i / 60 - 2 for i in range(240)]


def codes(s, sf):
    k = F.col("p_partkey")
    t = fx.table(s, sf, "part").select("p_partkey")
    cols = [(F.lit(252) + k % 4).cast("int").alias(c) if c == "q3" else hash2(k, F.lit(i), F.lit(3)).bitwiseAND(F.lit(255).cast("long")).cast("int").alias(c) for i, c in enumerate(_CODE)]
    return t.select(k.alias("splat_id"), *cols)


_CD = ("cd AS (SELECT p_partkey AS splat_id, " + ", ".join("(252+p_partkey%4)::INTEGER AS q3" if c == "q3" else f"({K.hash2('p_partkey', str(i), '3')} & 255)::INTEGER AS {c}" for i, c in enumerate(_CODE)) + " FROM part), "
       "ce AS (SELECT *, " + ", ".join(f"((q{i}/255e0)*2-1)/sqrt(2e0) AS p{i}" for i in range(3)) + ", " + ", ".join(
           f"{lo}::DOUBLE+({hi - lo})::DOUBLE*((lo{i} | (hi{i} << 8))/65535e0) AS m{i}" for i, (lo, hi) in enumerate(((-2.0, 3.0), (-1.5, 1.0), (-4.0, 0.5)))) + ", q3-252 AS dr FROM cd)")
_LAST = "sqrt(greatest(0e0, 1e0-(p0*p0+p1*p1+p2*p2)))"
_SLOT = lambda k: "CASE dr " + " ".join(f"WHEN {x} THEN {_LAST if x == k else f'p{k if k < x else k - 1}'}" for x in range(4)) + " END"
query("S10_dequantise_cloud", K.sql(
    "SELECT splat_id, " + ", ".join(f"{srnd(f'sign(m{i})*(exp(abs(m{i}))-1)')} AS p{k}" for i, k in enumerate("xyz")) + ", " + ", ".join(f"{srnd(f'exp(least(199, s{i})/40e0-3e0)')} AS s{k}" for i, k in enumerate("xyz"))
    + ", " + ", ".join(f"{srnd(_SLOT(k))} AS {n}" for k, n in ((1, "qx"), (2, "qy"), (3, "qz"), (0, "qw"))) + ", "
    + ", ".join(f"{K.u8(f'(0.5e0+(least(239, c{i})/60e0-2e0)*{cloudio.SH_C0!r}::DOUBLE)*255e0')} AS {c}" for i, c in enumerate("rgb")) + ", c3 AS a FROM ce", _CD))(
    lambda s, sf: cloudio.dequantise_cloud(codes(s, sf), _BOOK_S, _BOOK_C, (-2.0, -1.5, -4.0), (3.0, 1.0, 0.5)).select(
        "splat_id", *[rnd(c).alias(c) for c in ("px", "py", "pz", "sx", "sy", "sz", "qx", "qy", "qz", "qw")], *"rgba"))
_NUM = lambda e: f"CASE WHEN {e}=floor({e}) THEN ({e})::BIGINT::VARCHAR ELSE ({e})::VARCHAR END"


def flat_tris(s, sf):
    """Triangles whose coordinates are multiples of a quarter, so that their text is exact."""
    return tris(s, sf).select("mesh_id", "tri_id", *[(F.floor(F.col(n) * 4) / 4).alias(n) for n in TRI])


_FT4 = "t4 AS (SELECT mesh_id, tri_id, " + ", ".join(f"floor({n}*4)/4e0 AS {n}" for n in TRI) + " FROM tr)"
_VERT = lambda v, lead: f"'{lead}' || " + " || ' ' || ".join(_NUM(f"{v}{k}") for k in "xyz")
query("S15_facets_to_text", K.sql(
    "SELECT mesh_id, tri_id, concat_ws(chr(10), '    outer loop', " + ", ".join(_VERT(v, "      vertex ") for v in "abc") + ", '    endloop', '  endfacet') AS text FROM t4", TR, _FT4))(
    lambda s, sf: meshio.facets_to_text(flat_tris(s, sf)).select("mesh_id", "tri_id", F.regexp_replace("text", "^[^\n]*\n", "").alias("text")))
query("S16_mesh_to_obj_lines", K.sql(
    " UNION ALL ".join(f"SELECT mesh_id, 0 AS section, tri_id*3+{i} AS ord, {_VERT(v, 'v ')} AS text FROM t4" for i, v in enumerate("abc"))
    + " UNION ALL SELECT mesh_id, 1, tri_id, 'f ' || (tri_id*3+1) || ' ' || (tri_id*3+2) || ' ' || (tri_id*3+3) FROM t4", TR, _FT4))(lambda s, sf: meshio.mesh_to_obj_lines(flat_tris(s, sf)))
_ROUND = "SELECT mesh_id, tri_id, " + ", ".join(TRI) + " FROM t4"
_MESHOF = lambda: F.regexp_extract("file", r"mesh_id=(\d+)", 1).cast("long").alias("mesh_id")


@query("S12_read_obj", K.sql(_ROUND, TR, _FT4))
def _obj(s, sf):
    """Meshes written as OBJ lines (relative indices in odd meshes) and read back."""
    path = scratch(s)
    lines = meshio.mesh_to_obj_lines(flat_tris(s, sf))
    n = lines.filter("section = 0").groupBy("mesh_id").agg(F.count(F.lit(1)).alias("nv"))
    rel = F.concat(F.lit("f "), F.concat_ws(" ", *[(F.col("ord") * 3 + i - F.col("nv")).cast("string") for i in range(3)]))
    text = F.when((F.col("section") == 1) & (F.col("mesh_id") % 2 == 1), rel).otherwise(F.col("text"))
    t = lines.join(n, "mesh_id").select("mesh_id", "section", "ord", text.alias("text"))
    # a stated number of partitions is kept as it is: without it adaptive execution may cut a large mesh into several files
    t.repartition(s.sparkContext.defaultParallelism, "mesh_id").sortWithinPartitions("mesh_id", "section", "ord").select("mesh_id", "text").write.partitionBy("mesh_id").text(path)
    return meshio.read_obj(s, path + "/*").select(_MESHOF(), "tri_id", *TRI)


@query("S13_read_ascii_stl", K.sql("SELECT mesh_id, " + ", ".join(TRI) + " FROM t4", TR, _FT4))
def _stl(s, sf):
    path = scratch(s)
    meshio.write_ascii_stl(flat_tris(s, sf), path)
    return meshio.read_ascii_stl(s, path + "/*").select(_MESHOF(), *TRI)


@query("S18_read_saved_graph", "SELECT 'n' || p_partkey AS id, 'filter' AS type, '{\"size\":' || p_size || '}' AS config, CASE WHEN p_partkey >= 2 THEN 'n' || (p_partkey//2) END AS target, 1 AS version FROM part")
def _graph(s, sf):
    """One saved graph per part brand: nodes and edges as JSON files, read back and joined."""
    path = scratch(s)
    p = fx.table(s, sf, "part")
    node = F.struct(F.concat(F.lit("n"), "p_partkey").alias("id"), F.lit("filter").alias("type"), F.struct(F.col("p_size").alias("size")).alias("config"))
    edge = F.struct(F.concat(F.lit("e"), "p_partkey").alias("id"), F.concat(F.lit("n"), "p_partkey").alias("source"), F.lit("out").alias("sourceHandle"),
                    F.concat(F.lit("n"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("target"), F.lit("in").alias("targetHandle"))
    g = p.groupBy("p_brand").agg(F.collect_list(node).alias("nodes"), F.collect_list(F.when(F.col("p_partkey") >= 2, edge)).alias("edges"))
    g.repartition("p_brand").write.partitionBy("p_brand").json(path)
    graphs, nodes, edges = graphio.read_saved_graph(s, path + "/*")
    t = nodes.join(edges.select("file", F.col("source").alias("id"), "target"), ["file", "id"], "left").join(graphs, "file")
    return t.select("id", "type", "config", "target", "version")


# ---- S: binary files, written from the tables and read back --------------------------------
@query("S1_read_images", K.sql("SELECT image_id, w, h, x, y, r, g, b, 255 AS a FROM px", K.PX))
def _images(s, sf):
    """Every embedding image as a 24-bit bitmap (rows from the bottom, channels B, G, R)."""
    path = scratch(s)
    px = fx.px_embed(s, sf)
    dot = F.concat(*[F.lpad(F.hex(ch), 2, "0") for ch in ("b", "g", "r")])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("o"), "x", dot.alias("d")))), lambda v: v["d"]), "")
    head = "424DF600000000000000360000002800000008000000080000000100180000000000C0000000" + "00" * 16
    t = px.groupBy("image_id").agg(F.unhex(F.concat(F.lit(head), body)).alias("content"))  # 64 pixels each
    files.write_files(t.withColumn("name", F.concat(F.lit("img"), "image_id", F.lit(".bmp"))), path)
    im, p = images.read_images(s, path)
    name = F.regexp_extract("origin", r"img(\d+)\.bmp", 1).cast("long")
    return p.drop("frame").join(im.select(F.col("image_id"), name.alias("n")), "image_id").drop("image_id").withColumnRenamed("n", "image_id").select(
        "image_id", "w", "h", "x", "y", *"rgba")


@query("S8_read_splats", "SELECT " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(("px", "py", "pz", "sx", "sy", "sz")))
       + ", (vec_id%256)::INTEGER AS r, (vec_id%251)::INTEGER AS g, 7 AS b, 255 AS a, 1e0 AS qw FROM embeddings")
def _splat_files(s, sf):
    """Records packed a batch at a time, one file per batch."""
    import numpy as np
    import pandas as pd

    path = scratch(s)

    def pack(batches):
        for pdf in batches:
            e, k = np.stack(pdf["embedding"].to_numpy()), pdf["vec_id"].to_numpy()
            a = np.zeros(len(pdf), [("p", "<f4", 6), ("c", "u1", 4), ("q", "u1", 4)])
            a["p"], a["q"] = e[:, :6], (255, 128, 128, 128)
            a["c"] = np.stack([k % 256, k % 251, np.full(len(k), 7), np.full(len(k), 255)], axis=1)
            yield pd.DataFrame({"name": [f"part{k.min()}.splat"], "content": [a.tobytes()]})

    files.write_files(fx.table(s, sf, "embeddings").select("vec_id", "embedding").mapInPandas(pack, "name string, content binary"), path)
    return cloudio.read_splats(s, path).select("px", "py", "pz", "sx", "sy", "sz", *"rgba", "qw")


@query("S14_read_binary_stl", K.sql("SELECT " + ", ".join(TRI) + " FROM t4", TR, _FT4))
def _binary_stl(s, sf):
    import numpy as np
    import pandas as pd

    path = scratch(s)

    def pack(batches):
        for pdf in batches:
            a = np.zeros(len(pdf), [("n", "<f4", 3), ("v", "<f4", 9), ("k", "<u2")])
            a["v"] = pdf[TRI].to_numpy()
            head = b"solid but binary".ljust(80) + len(a).to_bytes(4, "little")
            yield pd.DataFrame({"name": [f"mesh{pdf['key'].min()}.stl"], "content": [head + a.tobytes()]})

    t = flat_tris(s, sf).withColumn("key", F.col("tri_id") * 5 + F.col("mesh_id")).drop("mesh_id", "tri_id")
    files.write_files(t.mapInPandas(pack, "name string, content binary"), path)
    return meshio.read_binary_stl(s, path).select(*TRI)
