"""Registered queries: lens sweeps, multi-view sheets, view synthesis."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.core import d
from ..operators import multiview as mv
from ..operators import stats
from ..operators import sweep as sw
from ..operators import viewsynth as vs
from ..schema import PIXEL
from . import fixtures as fx
from . import sqlkit as K
from .catalog_raster import OUT, OUTS, bilinear_sql, blur_sql, rnd, sample_sql, srnd
from .registry import query

PI = repr(math.pi) + "e0"


# ---- K -------------------------------------------------------------------------------------
def lens_settings(s, sf):
    """lens designs spanned by the line items."""
    return fx.table(s, sf, "lineitem").select(
        (F.col("l_quantity") + 50.0).alias("width_mm"), d(1440).alias("ppi"), (F.col("l_linenumber") * 10 + 20).cast("double").alias("lpi"),
        (F.col("l_discount") * 5.0 + 0.5).alias("height_mm"), (F.col("l_tax") + 1.4).alias("ri"),
        F.when(F.col("l_linenumber") % 2 == 0, "ellipse").otherwise("circle").alias("profile")).distinct()


_LS = ("ls AS (SELECT DISTINCT l_quantity+50e0 AS width_mm, 1440e0 AS ppi, (l_linenumber*10+20)::DOUBLE AS lpi, l_discount*5e0+0.5e0 AS height_mm, l_tax+1.4e0 AS ri, "
       "CASE WHEN l_linenumber%2=0 THEN 'ellipse' ELSE 'circle' END AS profile FROM lineitem)")
_SAG = lambda r, R, k: f"(({r})*({r})/({R}*(1e0+sqrt(greatest(0e0, 1e0-(1e0+{k})*({r})*({r})/({R}*{R}))))))"
_GEO = (
    "g0 AS (SELECT *, 25.4e0/lpi AS p, ppi/lpi AS ppx, CASE WHEN profile='ellipse' THEN -1e0/(ri*ri) ELSE 0e0 END AS k FROM ls), "
    "g1 AS (SELECT *, height_mm*(ri-1e0)/ri AS wr, sqrt(1e0+k) AS rc FROM g0), "
    "g2 AS (SELECT *, wr >= rc*p/2e0 AS ok, CASE WHEN wr >= rc*p/2e0 THEN wr ELSE rc*p/2e0 END AS rad, "
    "2e0*asin(least(1e0, ri*((p/2e0)/sqrt(p/2e0*p/2e0+height_mm*height_mm))))*180e0/pi() AS va FROM g1), "
    f"g3 AS (SELECT *, {_SAG('p/2e0', 'rad', 'k')} AS sag FROM g2)"
)
_KEYS = ["width_mm", "lpi", "height_mm", "ri"]
query("K1_lens_geometry", K.sql(
    f"SELECT width_mm, lpi, height_mm, ri, {srnd('p')} AS pitch_mm, {srnd('ppx')} AS pitch_px, ok AS feasible, {srnd('rad')} AS radius_mm, {srnd('sag')} AS sag_mm, "
    f"{srnd('greatest(0e0, height_mm-sag)')} AS base_mm, {srnd('ri*rad/(ri-1e0)')} AS focus_mm, {srnd('ri*rc*p/(2e0*(ri-1e0))')} AS min_height_mm, {srnd('va')} AS view_angle_deg, "
    f"{srnd('greatest(0e0, height_mm-sag)+sag')} AS total_mm FROM g3", _LS, _GEO))(
    lambda s, sf: sw.lens_geometry(lens_settings(s, sf)).select(*_KEYS, "feasible", *[rnd(c).alias(c) for c in (
        "pitch_mm", "pitch_px", "radius_mm", "sag_mm", "base_mm", "focus_mm", "min_height_mm", "view_angle_deg", "total_mm")]))
_SPOT = (
    "s0 AS (SELECT g3.*, f, (p/2e0*0.99e0)*(2e0*i/40e0-1e0) AS o, f*(va/2e0)*pi()/180e0 AS th FROM g3, (VALUES (0e0),(0.25e0),(0.5e0),(0.75e0),(1e0)) t(f), range(41) u(i)), "
    f"s1 AS (SELECT *, -sin(th) AS dx, -cos(th) AS dy, height_mm-{_SAG('abs(o)', 'rad', 'k')} AS yy, "
    "abs(o)/(rad*sqrt(greatest(1e-12, 1e0-(1e0+k)*o*o/(rad*rad))))*sign(o) AS sl FROM s0), "
    "s2 AS (SELECT *, sl/sqrt(sl*sl+1e0) AS nx, 1e0/sqrt(sl*sl+1e0) AS ny, 1e0/ri AS eta FROM s1), s3 AS (SELECT *, -(dx*nx+dy*ny) AS ci FROM s2), "
    "s4 AS (SELECT *, 1e0-eta*eta*(1e0-ci*ci) AS kk FROM s3), s5 AS (SELECT *, eta*ci-sqrt(kk) AS ff FROM s4 WHERE kk >= 0), "
    "s6 AS (SELECT *, eta*dx+ff*nx AS ix, eta*dy+ff*ny AS iy FROM s5), s7 AS (SELECT *, o+(yy/-iy)*ix AS lx FROM s6 WHERE iy < 0), "
    "s8 AS (SELECT width_mm, lpi, height_mm, ri, f, max(lx)-min(lx) AS sp FROM s7 GROUP BY ALL)"
)
query("K2_spot_size_sweep", K.sql(f"SELECT width_mm, lpi, height_mm, ri, {srnd('max(sp)')} AS worst_spot_mm FROM s8 GROUP BY ALL", _LS, _GEO, _SPOT))(
    lambda s, sf: sw.spot_size_sweep(lens_settings(s, sf), _KEYS).withColumn("worst_spot_mm", rnd("worst_spot_mm")))
query("K3_best_radius")(lambda s, sf: sw.best_radius(lens_settings(s, sf).drop("width_mm").distinct().repartition(s.sparkContext.defaultParallelism)).select(
    "lpi", "height_mm", "ri", rnd("best_radius_mm").alias("best_radius_mm"), "feasible"))


def sweep_specs(s, sf):
    k = F.col("p_partkey")
    return fx.table(s, sf, "part").select(k.alias("spec_id"), (k % 30 + 20).cast("double").alias("lo"), (k % 17 * 4 + 10).cast("double").alias("hi"),
                                          (F.col("p_size") % 9).cast("double").alias("bands"), (k % 2 == 0).alias("snap"), d(600).alias("ppi"))


query("K4_sweep_values", K.sql(
    f"SELECT spec_id, min(pos)::INTEGER AS pos, min(CASE WHEN snap THEN 600e0/pl ELSE e END) AS value FROM (SELECT *, greatest(2, {K.jsr('greatest(2e0, 600e0/greatest(1e-6, e))')}) AS pl FROM "
    "(SELECT *, least(lo, hi)+(greatest(lo, hi)-least(lo, hi))*pos/(n-1) AS e FROM sp, range(9) t(pos) WHERE pos < n)) GROUP BY spec_id, CASE WHEN snap THEN pl ELSE -pos-1 END",
    "sp AS (SELECT p_partkey AS spec_id, (p_partkey%30+20)::DOUBLE AS lo, (p_partkey%17*4+10)::DOUBLE AS hi, greatest(2, p_size%9) AS n, p_partkey%2=0 AS snap FROM part)"))(
    lambda s, sf: sw.sweep_values(sweep_specs(s, sf)))
query("K5_height_for_angle", K.sql(
    f"SELECT lpi, ri, width_mm, {srnd('p/2e0*sqrt(1e0/(si*si)-1e0)')} AS height FROM (SELECT *, least(0.999999e0, greatest(1e-6, sin(least(179.9e0, greatest(0.1e0, width_mm))/2e0*(pi()/180e0))/ri)) AS si "
    "FROM (SELECT DISTINCT lpi, ri, width_mm, 25.4e0/lpi AS p FROM ls))", _LS))(
    lambda s, sf: lens_settings(s, sf).select("lpi", "ri", "width_mm").distinct().select("lpi", "ri", "width_mm", rnd(sw.height_for_angle(d(25.4) / F.col("lpi"), "ri", "width_mm")).alias("height")))
query("K6_pitch_fit", K.sql(
    f"SELECT DISTINCT width_mm, lpi, {srnd('ppi/lpi')} AS ppl, abs(ppi/lpi-floor(ppi/lpi+0.5e0)) < 1e-9 AS whole, CASE WHEN abs(ppi/lpi-floor(ppi/lpi+0.5e0)) < 1e-9 THEN "
    f"CASE WHEN floor(ppi/lpi+0.5e0)::BIGINT%2=0 THEN 'even' ELSE 'odd' END END AS parity, {srnd('abs(ppi/lpi-floor(ppi/lpi+0.5e0))*(width_mm*lpi/25.4e0)')} AS drift_px, "
    f"{srnd('width_mm*lpi/25.4e0')} AS lens_count, CASE WHEN abs(ppi/lpi/4e0-floor(ppi/lpi/4e0+0.5e0)) < 1e-9 THEN {srnd('ppi/lpi/4e0')} END AS px_per_view FROM ls", _LS))(
    lambda s, sf: sw.pitch_fit(lens_settings(s, sf).select("width_mm", "lpi", "ppi").distinct(), 4).select(
        "width_mm", "lpi", "whole", "parity", *[rnd(c).alias(c) for c in ("ppl", "drift_px", "lens_count", "px_per_view")]))


def eye_settings(s, sf):
    q = F.col("l_quantity")
    return fx.table(s, sf, "lineitem").select(
        q.alias("cone_deg"), (F.col("l_linenumber")).alias("views"), (F.col("l_discount") * 1000 + 200).alias("distance_mm"), (F.col("l_tax") * 100).alias("depth_mm"),
        (q - 25).alias("setback_mm")).distinct().withColumn("lpi", d(45))


_ES = ("es AS (SELECT DISTINCT l_quantity AS cone_deg, l_linenumber AS views, l_discount*1000+200 AS distance_mm, l_tax*100 AS depth_mm, l_quantity-25 AS setback_mm FROM lineitem)")
_EO = lambda i, n: f"CASE WHEN {n} <= 1 THEN 0e0 ELSE tan(({i}/greatest({n}-1e0, 1e0)*2e0-1e0)*(cone_deg*{PI}/360e0))*distance_mm END".replace("e0e0", "e0")
query("K7_eye_offsets", K.sql(f"SELECT DISTINCT cone_deg, views, distance_mm, i::INTEGER AS eye, {srnd(_EO('i', 'views'))} AS ex FROM es, range(7) t(i) WHERE i < views", _ES))(
    lambda s, sf: sw.eye_offsets(eye_settings(s, sf).select("cone_deg", "views", "distance_mm").distinct()).withColumn("ex", rnd("ex")))
query("K7_eye_grid", K.sql(
    f"SELECT DISTINCT cone_deg, views AS cols, 3 AS rows, distance_mm, i::INTEGER AS eye, {srnd(_EO('(i%views)', 'views'))} AS ex, {srnd('-(' + _EO('(i//views)', '3e0') + ')')} AS ey FROM es, range(21) t(i) WHERE i < views*3", _ES))(
    lambda s, sf: sw.eye_grid(eye_settings(s, sf).select("cone_deg", F.col("views").alias("cols"), F.lit(3).alias("rows"), "distance_mm").distinct()).withColumns(
        {"ex": rnd("ex"), "ey": rnd("ey")}))
_DAT = lambda z: f"abs(st*(-({z}))/(distance_mm+({z})))"
query("K8_disparity", K.sql(
    f"SELECT cone_deg, views, distance_mm, depth_mm, {srnd('wm')} AS worst_mm, {srnd('wm/(25.4e0/45e0)')} AS lenslets, wm/(25.4e0/45e0) <= 1.5e0 AS comfortable FROM (SELECT *, greatest({_DAT('nr')}, {_DAT('(nr+depth_mm)')}) AS wm "
    f"FROM (SELECT *, CASE WHEN views > 1 THEN abs(({_EO('1', 'views')})-({_EO('0', 'views')})) ELSE 0e0 END AS st, greatest(-0.25e0*distance_mm, setback_mm) AS nr FROM es))", _ES))(
    lambda s, sf: sw.disparity(eye_settings(s, sf)).select("cone_deg", "views", "distance_mm", "depth_mm", rnd("worst_mm").alias("worst_mm"), rnd("lenslets").alias("lenslets"), "comfortable"))


def cover_settings(s, sf):
    return fx.table(s, sf, "lineitem").select(
        F.col("l_quantity").alias("cone_deg"), F.col("l_linenumber").alias("cols"), (F.col("l_linenumber") % 3).alias("rows"), (F.col("l_discount") * 1000 + 200).alias("distance_mm")
    ).distinct().withColumns({"width_mm": d(100), "height_mm": d(60), "follow": d(0.8)})


_HIT = (
    "p0 AS (SELECT *, 0.8e0*atan2(ex, distance_mm) AS yw, 0.8e0*(-asin(ey/sqrt(ex*ex+ey*ey+distance_mm*distance_mm))) AS pt FROM ep), "
    "p1 AS (SELECT *, sin(yw) AS sy, cos(yw) AS cy, sin(pt) AS s_p, cos(pt) AS c_p FROM p0), "
    "p2 AS (SELECT p1.*, cx*50e0 AS x, cyy*30e0 AS y FROM p1, (VALUES (-1),(1)) a(cx), (VALUES (-1),(1)) b(cyy)), "
    "p3 AS (SELECT *, sy*c_p*ex-s_p*ey+cy*c_p*distance_mm AS ne, sy*c_p*x-s_p*y AS nq FROM p2), "
    "p4 AS (SELECT *, ne/(ne-nq) AS t FROM p3), p5 AS (SELECT *, ex+t*(x-ex) AS hx, ey+t*(y-ey) AS hy, distance_mm-t*distance_mm AS hz FROM p4), "
    "p6 AS (SELECT *, abs(cy*hx-sy*hz)/50e0 AS na, abs(sy*s_p*hx+c_p*hy+cy*s_p*hz)/30e0 AS nb FROM p5)"
)
query("K9_cover_scale", K.sql(
    f"SELECT cone_deg, cols, rows, distance_mm, {srnd('greatest(1e0, max(greatest(na, nb)))')} AS scale FROM p6 GROUP BY ALL",
    "cs AS (SELECT DISTINCT l_quantity AS cone_deg, l_linenumber AS cols, l_linenumber%3 AS rows, l_discount*1000+200 AS distance_mm FROM lineitem)",
    f"ep AS (SELECT *, {_EO('(i%cols)', 'cols')} AS ex, CASE WHEN rows=0 THEN 0e0 ELSE -({_EO('(i//cols)', 'rows')}) END AS ey FROM cs, range(21) t(i) WHERE i < cols*greatest(1, rows))", _HIT))(
    lambda s, sf: sw.cover_scale(cover_settings(s, sf), ["cone_deg", "cols", "rows", "distance_mm"]).withColumn("scale", rnd("scale")))


# ---- V -------------------------------------------------------------------------------------
def view_px(s, sf):
    """Sequences of four 8x8 views."""
    p = fx.px_embed(s, sf)
    return p.select(F.floor(F.col("image_id") / 4).cast("long").alias("image_id"), (F.col("image_id") % 4).cast("int").alias("frame"), *PIXEL[2:])


_VW = "vw AS (SELECT image_id//4 AS image_id, (image_id%4)::INTEGER AS frame, w, h, x, y, r, g, b, a FROM px)"
LENS = mv.Lens(width_mm=10.0, ppi=90.0, lpi=20.0, phase=0.3, height_mm=1.1, ri=1.5, strip_samples=1.0, phase_y=0.6)
TURNED = mv.Lens(width_mm=10.0, ppi=90.0, lpi=20.0, phase=0.3, height_mm=1.1, ri=1.5, orientation=23.0, packing="square", phase_y=0.6, profile="ellipse", spin=0.2)


def view_sizes(s, sf):
    """Size facts of imagined sequences: one per part."""
    k = F.col("p_partkey")
    return fx.table(s, sf, "part").select(k.alias("image_id"), (k % 40 + 5).cast("int").alias("w0"), (F.col("p_size") + 3).cast("int").alias("h0"),
                                          (k % 6 + 2).cast("int").alias("n_views"), (k % 40 + 5 + k % 3 * 20).cast("int").alias("w_max"))


_VS = "vz AS (SELECT p_partkey AS image_id, (p_partkey%40+5)::INTEGER AS w0, (p_size+3)::INTEGER AS h0, (p_partkey%6+2)::INTEGER AS n, (p_partkey%40+5+p_partkey%3*20)::INTEGER AS wm FROM part)"
_CELLS = 10.0 * 20.0 / 25.4
_CAP = math.floor(10.0 * (90.0 / 25.4) + 0.5)


def size_sql(src: str, need: str, strips: str) -> str:
    c = f"{_CELLS!r}::DOUBLE"
    return (f"z1 AS (SELECT *, greatest(CAST(ceil({need}) AS INTEGER), wm) AS tg, greatest(1, {strips}) AS st FROM {src}), "
            f"z2 AS (SELECT *, greatest(st, CAST(ceil(tg/{c}/st-1e-9) AS INTEGER)*st) AS eq, greatest(1, {K.jsr(f'{_CAP}/{c}')}) AS pc FROM z1), "
            f"z3 AS (SELECT *, greatest(1, {K.jsr(f'eq*{c}')}) AS we, greatest(1, {K.jsr(f'pc*{c}')}) AS wc, greatest(1, {K.jsr(f'greatest(1, pc-1)*{c}')}) AS wd FROM z2), "
            f"sz AS (SELECT image_id, w0, h0, n, w, greatest(1, {K.jsr('w*h0/w0::DOUBLE')}) AS h FROM (SELECT *, CASE WHEN we <= {_CAP} THEN we WHEN wc <= {_CAP} THEN wc ELSE wd END AS w FROM z3))")


query("V1_sheet_size", K.sql(f"SELECT image_id, {_CAP} AS w, greatest(1, {K.jsr(f'{_CAP}*h0/w0::DOUBLE')}) AS h FROM vz", _VS))(
    lambda s, sf: mv.sheet_size(view_sizes(s, sf), LENS).select("image_id", "w", "h"))
for _kind, _need, _strips, _kw in (("strips", f"n*{_CELLS!r}::DOUBLE", "n", {}), ("grid", f"{_CELLS * max(3, 2 / mv.HEX_ROW)!r}::DOUBLE", "3", dict(cols=3, rows=2)),
                                   ("radial", f"n*{_CELLS!r}::DOUBLE/{PI}".replace("e0e0", "e0"), "1", {})):
    query(f"V2_interlaced_size_{_kind}", K.sql("SELECT image_id, w, h FROM sz", _VS, size_sql("vz", _need, _strips)))(
        lambda s, sf, k=_kind, kw=_kw: mv.interlaced_size(view_sizes(s, sf), LENS, k, **kw).select("image_id", "w", "h"))
_SEQZ = "vz AS (SELECT image_id, 8 AS w0, 8 AS h0, count(DISTINCT frame)::INTEGER AS n, 8 AS wm FROM vw GROUP BY image_id)"


def sheet_sql(lens: mv.Lens, lo: float = 0, step: float = 0, n: int = 1, gap: float = 0) -> str:
    """CTE sh: output pixels with mm position, u, v along the lens axes and the band pitch."""
    th = lens.orientation * math.pi / 180
    c, s = f"({math.cos(th)!r})::DOUBLE", f"({math.sin(th)!r})::DOUBLE"
    slot = "0"
    if n > 1:
        pts = f"0e0, -10e0*{s}, hm*{c}, -10e0*{s}+hm*{c}"
        slot = (f"CASE WHEN (-xm*{s}+ym*{c}-least({pts})) - least({n - 1}, greatest(0, floor((-xm*{s}+ym*{c}-least({pts}))/((greatest({pts})-least({pts}))/{n}))))*((greatest({pts})-least({pts}))/{n}) < {gap}e0 THEN NULL "
                f"ELSE least({n - 1}, greatest(0, floor((-xm*{s}+ym*{c}-least({pts}))/((greatest({pts})-least({pts}))/{n})))) END")
    pitch = "25.4e0/20e0" if n == 1 else f"25.4e0/({lo}e0+{step}e0*slot)"
    return (f"h0 AS (SELECT *, (x+0.5e0)*(10e0/w) AS xm, (y+0.5e0)*(10e0/w) AS ym, 10e0*h0/w0 AS hm FROM (SELECT sz.*, xo::INTEGER AS x, yo::INTEGER AS y FROM sz, range(w) a(xo), range(h) b(yo))), "
            f"h1 AS (SELECT *, {slot} AS slot, xm*{c}+ym*{s} AS uu, -xm*{s}+ym*{c} AS vv, {c} AS co, {s} AS si FROM h0), sh AS (SELECT *, {pitch} AS pt FROM h1)")


def strips_sql(sw: str = "8", sh: str = "8") -> str:
    return ("pp0 AS (SELECT *, uu/pt+0.3e0 AS po, floor(uu/pt+0.3e0) AS ce FROM sh WHERE slot IS NOT NULL), "
            "pp1 AS (SELECT *, least(n-1, CAST(floor((po-ce)*n) AS INTEGER)) AS frame, (ce+0.5e0-0.3e0)*pt-uu AS sf FROM pp0), "
            f"pts AS (SELECT *, (xm+sf*co)/10e0 AS u, (ym+sf*si)/hm AS v, {sw} AS sw, {sh} AS sh FROM pp1)")


_SMP = sample_sql("pts", "vw", "sm", "{t}.image_id=o.image_id AND {t}.frame=o.frame", "o.image_id, 0 AS frame, o.w, o.h, o.x, o.y")
_STR = size_sql("vz", f"n*{_CELLS!r}::DOUBLE", "n")
_WHITE = "SELECT image_id, 0 AS frame, w, h, x, y, 255 AS r, 255 AS g, 255 AS b, 255 AS a FROM sh WHERE slot IS NULL"
query("V3_interlace_strips", K.sql(f"SELECT {K.OUTS} FROM sm", K.PX, _VW, _SEQZ, _STR, sheet_sql(LENS), strips_sql(), _SMP))(
    lambda s, sf: mv.interlace_strips(view_px(s, sf), LENS).select(*OUTS))
_SWEEP = mv.Sweep("lpi", 15.0, 25.0, 3, gap_mm=0.5)
query("V3_interlace_sweep", K.sql(f"SELECT {K.OUTS} FROM sm UNION ALL {_WHITE}", K.PX, _VW, _SEQZ, _STR, sheet_sql(TURNED, 15.0, 5.0, 3, 0.5), strips_sql(), _SMP))(
    lambda s, sf: mv.interlace_strips(view_px(s, sf), TURNED, sweep=_SWEEP).select(*OUTS))


def lattice_sql(src: str, dst: str, packing: str, keys: str) -> str:
    """CTE dst: src(su, sv) plus cu, cv, du, dv."""
    if packing == "square":
        return f"{dst} AS (SELECT *, floor(su)+0.5e0 AS cu, floor(sv)+0.5e0 AS cv, su-(floor(su)+0.5e0) AS du, sv-(floor(sv)+0.5e0) AS dv FROM {src})"
    hr = f"{mv.HEX_ROW!r}::DOUBLE"
    return (f"{dst}0 AS (SELECT *, floor(sv)+k AS rw, CASE WHEN (CAST(floor(sv)+k AS BIGINT) & 1)=1 THEN 0.5e0 ELSE 0e0 END AS od FROM {src}, (VALUES (-1),(0),(1)) t(k)), "
            f"{dst}1 AS (SELECT *, floor(su-od-0.5e0+0.5e0)+0.5e0+od AS cu, rw+0.5e0 AS cv FROM {dst}0), {dst}2 AS (SELECT *, su-cu AS du, (sv-cv)*{hr} AS dv FROM {dst}1), "
            f"{dst} AS (SELECT * FROM {dst}2 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY du*du+dv*dv, k) = 1)")


query("V4_lattice_at", K.sql(
    f"SELECT DISTINCT su, sv, cu, cv, {srnd('du')} AS du, {srnd('dv')} AS dv FROM lt", "lp AS (SELECT DISTINCT l_quantity*0.37e0-5e0 AS su, l_extendedprice/1013e0-7e0 AS sv FROM lineitem)",
    lattice_sql("lp", "lt", "hex", "su, sv")))(
    lambda s, sf: fx.table(s, sf, "lineitem").select((F.col("l_quantity") * 0.37 - 5.0).alias("su"), (F.col("l_extendedprice") / 1013.0 - 7.0).alias("sv")).distinct().withColumn(
        "at", mv.lattice_at(F.col("su"), F.col("sv"), "hex")).select("su", "sv", "at.cu", "at.cv", rnd("at.du").alias("du"), rnd("at.dv").alias("dv")))


def cell_sql(packing: str, view: str) -> str:
    sc = f"{mv.HEX_ROW!r}::DOUBLE" if packing == "hex" else "1e0"
    return (f"c0 AS (SELECT *, uu/pt+0.3e0 AS su, vv/(pt*{sc})+0.6e0 AS sv FROM sh), {lattice_sql('c0', 'c1', packing, 'image_id, x, y')}, "
            f"pts AS (SELECT *, ((cu-0.3e0)*pt*co-(cv-0.6e0)*pt*{sc}*si)/10e0 AS u, ((cu-0.3e0)*pt*si+(cv-0.6e0)*pt*{sc}*co)/hm AS v, {view} AS frame, 8 AS sw, 8 AS sh FROM c1)")


_TILE = lambda o: f"CAST(floor(least(0.999999e0, greatest(0e0, {o}+0.5e0))*2) AS INTEGER)"
query("V5_interlace_grid", K.sql(
    f"SELECT {K.OUTS} FROM sm", K.PX, _VW, _SEQZ, size_sql("vz", f"{_CELLS * max(2, 2 / mv.HEX_ROW)!r}::DOUBLE", "2"), sheet_sql(LENS),
    cell_sql("hex", f"(1-{_TILE('dv')})*2+(1-{_TILE('du')})"), _SMP))(
    lambda s, sf: mv.interlace_grid(view_px(s, sf), LENS, 2, 2).select(*OUTS))
_TH = 23.0 * math.pi / 180
_TURNS = f"(atan2(-(du*({math.sin(_TH)!r})::DOUBLE+dv*({math.cos(_TH)!r})::DOUBLE), du*({math.cos(_TH)!r})::DOUBLE-dv*({math.sin(_TH)!r})::DOUBLE)/{2 * math.pi!r}::DOUBLE+0.5e0+0.7e0/n)"
query("V6_interlace_radial", K.sql(
    f"SELECT {K.OUTS} FROM sm", K.PX, _VW, _SEQZ, size_sql("vz", f"n*{_CELLS!r}::DOUBLE/{math.pi!r}::DOUBLE", "1"), sheet_sql(TURNED),
    cell_sql("square", f"least(n-1, CAST(floor(({_TURNS}-floor({_TURNS}))*n) AS INTEGER))"), _SMP))(
    lambda s, sf: mv.interlace_radial(view_px(s, sf), TURNED).select(*OUTS))


def _geometry(lens: mv.Lens) -> dict:
    """Lens numbers of one design, worked out apart from the operators."""
    p, n, h = 25.4 / lens.lpi, lens.ri, lens.height_mm
    k = -1 / (n * n) if lens.profile == "ellipse" else 0.0
    rad = max(h * (n - 1) / n, math.sqrt(1 + k) * p / 2)
    sag = (p / 2) ** 2 / (rad * (1 + math.sqrt(max(0.0, 1 - (1 + k) * (p / 2) ** 2 / rad**2))))
    base = max(0.0, h - sag)
    return dict(k=k, rad=rad, sag=sag, base=base, top=base + sag)


def _height_sql(lens: mv.Lens, off: str, inside: str = "true") -> str:
    g = {a: f"({b!r})::DOUBLE" for a, b in _geometry(lens).items()}
    return K.jsr(f"least(1e0, ({g['base']}+greatest(0e0, CASE WHEN {inside} THEN {g['sag']}-{_SAG(off, g['rad'], g['k'])} ELSE 0e0 END))/{g['top']})*65535e0")


_PRESS = f"sz AS (SELECT image_id, w0, h0, n, {_CAP} AS w, {_CAP} AS h FROM vz)"
query("V7_strip_height_field", K.sql(
    f"SELECT image_id, x, y, {_height_sql(TURNED, 'o')} AS height FROM (SELECT *, abs((uu/pt+0.3e0-floor(uu/pt+0.3e0)-0.5e0)*pt) AS o FROM sh)", K.PX, _VW, _SEQZ, _PRESS, sheet_sql(TURNED)))(
    lambda s, sf: mv.strip_height_field(view_px(s, sf), TURNED).select("image_id", "x", "y", "height"))
query("V8_cap_height_field", K.sql(
    f"SELECT image_id, x, y, {_height_sql(LENS, 'o', 'o <= pt/2e0')} AS height FROM (SELECT *, sqrt(du*pt*du*pt+dv*pt*dv*pt) AS o FROM pts)", K.PX, _VW, _SEQZ, _PRESS, sheet_sql(LENS), cell_sql("hex", "0")))(
    lambda s, sf: mv.cap_height_field(view_px(s, sf), LENS).select("image_id", "x", "y", "height"))
query("V9_height_preview", K.sql(
    f"SELECT image_id, 0 AS frame, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT *, {_height_sql(TURNED, 'o')} >> 8 AS v FROM (SELECT *, abs((uu/pt+0.3e0-floor(uu/pt+0.3e0)-0.5e0)*pt) AS o FROM sh))",
    K.PX, _VW, _SEQZ, _PRESS, sheet_sql(TURNED)))(lambda s, sf: mv.height_preview(mv.strip_height_field(view_px(s, sf), TURNED)).select(*OUT))


def grid_counts(s, sf):
    k = F.col("p_partkey")
    return fx.table(s, sf, "part").select(k.alias("image_id"), (k % 18).alias("cols"), (F.col("p_size") % 7).alias("rows"))


_GC = ("gc AS (SELECT p_partkey AS image_id, greatest(2, p_partkey%18)::INTEGER AS cols, greatest(2, p_size%7)::INTEGER AS rows FROM part), "
       "ge AS (SELECT image_id, cols, rows, c::INTEGER AS col, r::INTEGER AS row_ FROM gc, range(cols) a(c), range(rows) b(r))")
_AX = lambda i, n, lo, hi: (
    f"CASE WHEN {i}*2=({n}-1) THEN 'Centre' WHEN ceil(({n}-1)/2e0)<=1 THEN CASE WHEN {i}*2<{n}-1 THEN '{lo}' ELSE '{hi}' END WHEN ceil(({n}-1)/2e0)=2 THEN CASE WHEN ceil(abs({i}-({n}-1)/2e0))=1 THEN "
    f"CASE WHEN {i}*2<{n}-1 THEN '{lo}' ELSE '{hi}' END ELSE 'Far ' || lower(CASE WHEN {i}*2<{n}-1 THEN '{lo}' ELSE '{hi}' END) END ELSE CASE WHEN {i}*2<{n}-1 THEN '{lo}' ELSE '{hi}' END || ' ' || ceil(abs({i}-({n}-1)/2e0))::INTEGER END")
_LAB = ("gl AS (SELECT *, 'c' || col || 'r' || row_ AS id, CASE WHEN ax='Centre' AND ay='Centre' THEN 'Centre (neutral)' WHEN ax='Centre' THEN ay WHEN ay='Centre' THEN ax ELSE ax || ' · ' || ay END AS label FROM "
        f"(SELECT *, {_AX('col', 'cols', 'Left', 'Right')} AS ax, {_AX('row_', 'rows', 'Up', 'Down')} AS ay FROM ge))")
query("V10_switch_views", "SELECT p_partkey AS image_id, i::INTEGER AS frame, CASE WHEN i%2=0 THEN 255 ELSE 0 END AS r FROM part, range(greatest(2, p_size)) t(i)")(
    lambda s, sf: mv.switch_views(fx.table(s, sf, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_size").alias("n"))).select("image_id", "frame", "r"))
query("V10_switch_views_grid", K.sql("SELECT image_id, row_*cols+col AS frame, CASE WHEN (col+row_)%2=0 THEN 255 ELSE 0 END AS r FROM ge", _GC))(
    lambda s, sf: mv.switch_views(grid_counts(s, sf), "grid").select("image_id", "frame", "r"))
query("V11_grid_cells", K.sql("SELECT image_id, col, row_ AS \"row\", id, label FROM gl", _GC, _LAB))(
    lambda s, sf: mv.grid_cells(grid_counts(s, sf)).select("image_id", "col", "row", "id", "label"))
_BEAR = " ".join(f"WHEN {i} THEN '{b}'" for i, b in enumerate(mv.BEARINGS))
query("V11_radial_views", (
    "SELECT image_id, view, 'a' || view AS id, angle_deg, CASE WHEN angle_deg/45e0=floor(angle_deg/45e0) THEN t || '° · ' || CASE (angle_deg/45e0)::INTEGER%8 " + _BEAR + " END ELSE t || '°' END AS label FROM "
    "(SELECT *, CASE WHEN tn=floor(tn) THEN tn::INTEGER::VARCHAR ELSE tn::VARCHAR END AS t FROM (SELECT p_partkey AS image_id, i::INTEGER AS view, i*360e0/n AS angle_deg, floor(i*360e0/n*10+0.5e0)/10e0 AS tn FROM "
    "(SELECT p_partkey, greatest(2, p_partkey%14) AS n FROM part), range(n) t(i)))"))(
    lambda s, sf: mv.radial_views(fx.table(s, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_partkey") % 14).alias("n"))).select("image_id", "view", "id", "angle_deg", "label"))
query("V12_missing_views", K.sql(
    "SELECT image_id, count(*) AS n_missing, CASE WHEN count(*) <= 6 THEN string_agg(label, ', ' ORDER BY pos) ELSE string_agg(label, ', ' ORDER BY pos) FILTER (k <= 6) || ' … and ' || (count(*)-6) || ' more' END AS summary "
    "FROM (SELECT *, row_*cols+col AS pos, row_number() OVER (PARTITION BY image_id ORDER BY row_*cols+col) AS k FROM gl WHERE (image_id*7+row_*3+col)%5 >= 2) GROUP BY image_id", _GC, _LAB))(
    lambda s, sf: (lambda e: mv.missing_views(e, e.filter("(image_id * 7 + row * 3 + col) % 5 < 2").select("image_id", "id")))(
        mv.grid_cells(grid_counts(s, sf)).withColumn("pos", F.col("row") * F.col("cols") + F.col("col")).select("image_id", "pos", "id", "label", "row", "col")))

# ---- Y -------------------------------------------------------------------------------------
_GREYB = lambda src, dst, e: f"{dst} AS (SELECT image_id, frame, w, h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT *, {K.u8(e)} AS v FROM {src}))"
query("Y1_prepare_depth", K.sql(f"SELECT {K.OUT} FROM dp", K.PX, blur_sql("px", "bl", 1), _GREYB("bl", "dp", f"255e0-{K.lum()}")))(
    lambda s, sf: vs.prepare_depth(fx.px_embed(s, sf), 1, invert=True).select(*OUT))
_SHIFT = lambda lv, ex, w: (
    f"CAST((-({ex})*(-((1e0-{lv}/255e0)*9e0+2e0))/(400e0-(-((1e0-{lv}/255e0)*9e0+2e0))))*({w}/20e0) AS FLOAT)")
_SKW = dict(width_mm=20.0, distance=400.0, depth_mm=9.0, setback=2.0)
query("Y2_shift_lut", K.sql(
    f"SELECT cone_deg, views, distance_mm, eye, level::INTEGER AS level, {srnd(_SHIFT('level', 'ex', '64'), 3)} AS shift FROM (SELECT DISTINCT cone_deg, views, distance_mm, i::INTEGER AS eye, {_EO('i', 'views')} AS ex "
    "FROM (SELECT DISTINCT cone_deg, views, distance_mm FROM es), range(views) t(i)), range(256) u(level)", _ES))(
    lambda s, sf: vs.shift_lut(sw.eye_offsets(eye_settings(s, sf).select("cone_deg", "views", "distance_mm").distinct()).withColumn("w", F.lit(64)), **_SKW).select(
        "cone_deg", "views", "distance_mm", "eye", "level", rnd("shift", 3).alias("shift")))
EYES = [-70.0, -20.0, 0.0, 45.0]
_MV = ("dp AS (SELECT image_id, frame, x, y, CAST(round_even(" + K.lum() + ", 0) AS INTEGER) AS ky FROM pxb), "
       f"mo AS (SELECT p.image_id, v AS view, p.w, p.h, p.y, p.x, ky, r, g, b, a, CAST(p.x::DOUBLE + {_SHIFT('ky', 'e', 'p.w')}::DOUBLE AS FLOAT) AS xs FROM px p JOIN dp USING (image_id, frame, x, y), "
       "(VALUES " + ", ".join(f"({i}, {e}e0)" for i, e in enumerate(EYES)) + ") t(v, e))")
_FW = f"fw AS (SELECT image_id, view, y, w, px, ky, 0 AS pass, x AS od, x AS src FROM (SELECT *, {K.jsr('xs')} AS px FROM mo) WHERE px >= 0 AND px < w)"
_GP = ("gp AS (SELECT image_id, view, y, w, px::INTEGER AS px, CASE WHEN ky <= nk THEN ky ELSE nk END AS ky, 1 AS pass, x AS od, CASE WHEN ky <= nk THEN x ELSE x+1 END AS src FROM "
       "(SELECT *, lead(xs) OVER q AS nx, lead(ky) OVER q AS nk FROM mo WINDOW q AS (PARTITION BY image_id, view, y ORDER BY x)), range(8) t(px) WHERE nx::DOUBLE-xs::DOUBLE > 1 AND px >= ceil(xs) AND px <= floor(nx))")
_LD = ("ld AS (SELECT image_id, view, y, px, src, pass=0 AS drawn FROM (SELECT *, row_number() OVER (PARTITION BY image_id, view, y, px ORDER BY ky DESC, pass, od) AS k FROM {0}) WHERE k=1)")
_COL = "JOIN px p ON p.image_id={0}.image_id AND p.y={0}.y AND p.x={0}.src"


def moved_px(s, sf):
    return vs.moved(fx.px_embed(s, sf), vs.prepare_depth(fx.px_embed_b(s, sf)), EYES, **_SKW)


def _landed(df):
    return df.select("image_id", "view", "y", "px", "src", "drawn", F.shiftright("rgba", 24).cast("int").alias("r"))


query("Y3_warp_forward", K.sql(f"SELECT ld.image_id, view, ld.y, px, src, drawn, p.r FROM ld {_COL.format('ld')}", K.PX, K.PXB, _MV, _FW, _LD.format("fw")))(
    lambda s, sf: _landed(vs.settle(vs.warp_forward(moved_px(s, sf)))))
_BOTH = "al AS (SELECT * FROM fw UNION ALL SELECT * FROM gp)"
query("Y4_warp_gap_fill", K.sql(f"SELECT ld.image_id, view, ld.y, px, src, drawn, p.r FROM ld {_COL.format('ld')}", K.PX, K.PXB, _MV, _FW, _GP, _BOTH, _LD.format("al")))(
    lambda s, sf: (lambda m: _landed(vs.settle(vs.warp_forward(m).union(vs.warp_gap_fill(m)))))(moved_px(s, sf)))
_CL = (
    "k0 AS (SELECT *, last(xs) OVER q - first(xs) OVER q AS sp, last(x) OVER q - first(x) OVER q AS dx FROM (SELECT image_id, view, w, y, x, ky, xs::DOUBLE AS xs FROM mo) "
    "WINDOW q AS (PARTITION BY image_id, view, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)), "
    "k1 AS (SELECT *, x - row_number() OVER (PARTITION BY image_id, view, y ORDER BY x) AS gg FROM k0 WHERE sp-dx > 0.6e0), "
    "k2 AS (SELECT image_id, view, w, y, min(x) AS s, max(x) AS e FROM k1 GROUP BY image_id, view, w, y, gg), "
    "k3 AS (SELECT k2.*, CASE WHEN a.ky <= b.ky THEN s ELSE e END AS fr, greatest(0, ceil(a.xs)) AS lo, least(k2.w-1, floor(b.xs)) AS hi FROM k2 JOIN mo a ON a.image_id=k2.image_id AND a.view=k2.view AND a.y=k2.y AND a.x=s "
    "JOIN mo b ON b.image_id=k2.image_id AND b.view=k2.view AND b.y=k2.y AND b.x=e), "
    "k4 AS (SELECT k3.image_id, k3.view, k3.y, t.px::INTEGER AS px, s, e, fr, l.src, l.drawn FROM k3 CROSS JOIN range(8) t(px) LEFT JOIN ld l ON l.image_id=k3.image_id AND l.view=k3.view AND l.y=k3.y AND l.px=t.px "
    "WHERE t.px BETWEEN lo AND hi AND (l.src IS NULL OR (l.src > s AND l.src < e))), "
    "k5 AS (SELECT * FROM k4 QUALIFY row_number() OVER (PARTITION BY image_id, view, y, px ORDER BY s)=1), "
    "lc AS (SELECT image_id, view, y, px, coalesce(k5.fr, l.src) AS src, k5.fr IS NULL AND l.drawn AS drawn FROM ld l FULL JOIN k5 USING (image_id, view, y, px))"
)
query("Y5_warp_cliffs", K.sql(f"SELECT lc.image_id, view, lc.y, px, lc.src, lc.drawn, p.r FROM lc {_COL.format('lc')}", K.PX, K.PXB, _MV, _FW, _GP, _BOTH, _LD.format("al"), _CL))(
    lambda s, sf: (lambda m: _landed(vs.warp_cliffs(vs.settle(vs.warp_forward(m).union(vs.warp_gap_fill(m))), vs.cliffs(m, 0.6, 2))))(moved_px(s, sf)))
_MG = (
    "ln AS (SELECT image_id, view, y, min(px) AS f, max(px) AS l FROM lc GROUP BY ALL), "
    "mg AS (SELECT q.image_id, q.view, q.y, q.x::INTEGER AS x, CASE WHEN q.x < f THEN (SELECT src FROM lc WHERE lc.image_id=q.image_id AND lc.view=q.view AND lc.y=q.y AND px=f) "
    "WHEN q.x > l THEN (SELECT src FROM lc WHERE lc.image_id=q.image_id AND lc.view=q.view AND lc.y=q.y AND px=l) ELSE c.src END AS src, coalesce(c.drawn, false) AS drawn, f FROM "
    "(SELECT DISTINCT image_id, view, y, x FROM mo) q LEFT JOIN ln USING (image_id, view, y) LEFT JOIN lc c ON c.image_id=q.image_id AND c.view=q.view AND c.y=q.y AND c.px=q.x), "
    "dv AS (SELECT m.image_id, m.view AS frame, m.x, m.y, coalesce(p.r, 0) AS r, coalesce(p.g, 0) AS g, coalesce(p.b, 0) AS b, coalesce(p.a, 0) AS a, src IS NOT NULL AND NOT drawn AS filled "
    "FROM mg m LEFT JOIN px p ON p.image_id=m.image_id AND p.y=m.y AND p.x=m.src)"
)
_WARP = (K.PX, K.PXB, _MV, _FW, _GP, _BOTH, _LD.format("al"), _CL, _MG)


def warped(s, sf):
    m = moved_px(s, sf)
    landed = vs.settle(vs.warp_forward(m).union(vs.warp_gap_fill(m)))
    return vs.warp_margins(vs.warp_cliffs(landed, vs.cliffs(m, 0.6, 2)), m.filter("x = 0").select(*vs.LINE, "w", "h"))


query("Y6_warp_margins", K.sql("SELECT image_id, frame, x, y, r, g, b, a, filled FROM dv", *_WARP))(lambda s, sf: warped(s, sf).select(*OUT, "filled"))
query("A13_fill_report", K.sql(
    f"SELECT image_id, frame, n_filled, n, {srnd('n_filled/n::DOUBLE')} AS share, longest FROM (SELECT image_id, frame, sum(nf)::BIGINT AS n_filled, sum(n)::BIGINT AS n, max(nf)::BIGINT AS longest FROM "
    "(SELECT image_id, frame, y, rl, count(*) FILTER (filled) AS nf, count(*) AS n FROM (SELECT *, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY image_id, frame, y ORDER BY x) AS rl FROM dv) GROUP BY ALL) GROUP BY ALL)", *_WARP))(
    lambda s, sf: stats.fill_report(warped(s, sf)).withColumn("share", rnd("share")))
query("Y7_depth_views")(lambda s, sf: vs.depth_views(fx.px_embed(s, sf), fx.px_embed_b(s, sf), views=3, cone_deg=40.0, width_mm=20.0).select(*OUT, "filled"))


def _facing_sql() -> str:
    wm, hm, dist, w, h, cols, rows, cone, f = 20.0, 15.0, 100.0, 12, 9, 2, 2, 30.0, 0.7
    eyes, scale = [], 1.0
    half = cone * math.pi / 360
    for r in range(rows):
        for c in range(cols):
            ex, ey = math.tan((c / (cols - 1) * 2 - 1) * half) * dist, -math.tan((r / (rows - 1) * 2 - 1) * half) * dist
            yaw, pitch = f * math.atan2(ex, dist), -f * math.asin(ey / math.sqrt(ex * ex + ey * ey + dist * dist))
            sy, cy, sp, cp = math.sin(yaw), math.cos(yaw), math.sin(pitch), math.cos(pitch)
            n, u, v = (sy * cp, -sp, cy * cp), (cy, 0.0, -sy), (sy * sp, cp, cy * sp)
            for qx in (-wm / 2, wm / 2):
                for qy in (-hm / 2, hm / 2):
                    ne = n[0] * ex + n[1] * ey + n[2] * dist
                    t = ne / (ne - (n[0] * qx + n[1] * qy))
                    hx, hy, hz = ex + t * (qx - ex), ey + t * (qy - ey), dist - t * dist
                    scale = max(scale, abs(u[0] * hx + u[2] * hz) / (wm / 2), abs(v[0] * hx + v[1] * hy + v[2] * hz) / (hm / 2))
            eyes.append((len(eyes), ex, ey, *n, *u, *v))
    vals = ", ".join("(" + ", ".join(f"({x!r})::DOUBLE" if i else str(x) for i, x in enumerate(e)) + ")" for e in eyes)
    tall = f"(1e0/({wm / hm!r})::DOUBLE)"
    return K.sql(
        f"SELECT {K.OUTS} FROM sm", K.PX, f"ey AS (SELECT * FROM (VALUES {vals}) t(view, ex, e_y, n0, n1, n2, u0, u1, u2, v0, v1, v2))",
        f"f0 AS (SELECT i.image_id, ey.*, x::INTEGER AS x, y::INTEGER AS y, (x+0.5e0)*({wm}e0/{w})-{wm / 2}e0 AS qx, {hm / 2}e0-(y+0.5e0)*({hm}e0/{h}) AS qy FROM (SELECT DISTINCT image_id FROM px) i, ey, range({w}) a(x), range({h}) b(y))",
        f"f1 AS (SELECT *, n0*ex+n1*e_y+n2*{dist}e0 AS ne, n0*qx+n1*qy AS nq FROM f0), f2 AS (SELECT *, ne/(ne-nq) AS t FROM f1), "
        f"f3 AS (SELECT *, ex+t*(qx-ex) AS hx, e_y+t*(qy-e_y) AS hy, {dist}e0-t*{dist}e0 AS hz FROM f2)",
        f"pts AS (SELECT image_id, view AS frame, {w} AS w, {h} AS h, x, y, 8 AS sw, 8 AS sh, 0.5e0+0.5e0*(u0*hx+u1*hy+u2*hz)/({scale * wm / 2!r})::DOUBLE AS u, "
        f"0.5e0-0.5e0*(v0*hx+v1*hy+v2*hz)*{tall}/({scale * hm / 2!r})::DOUBLE AS v FROM f3)",
        sample_sql("pts", "px", "sm", "{t}.image_id=o.image_id", "o.image_id, o.frame, o.w, o.h, o.x, o.y"))


query("Y8_facing_views", _facing_sql())(
    lambda s, sf: vs.facing_views(fx.px_embed(s, sf), 2, 2, 30.0, 20.0, 15.0, 100.0, 12, 0.7).select(*OUTS))
