"""Registered queries: the recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import color, enrich, multiview
from ..schema import PIXEL
from . import fixtures as fx
from . import recipes as rc
from . import sqlkit as K
from .catalog_graph import cc_join_sql
from .catalog_raster import (
    COVER, HIST, LHIST, OTSU, OUT, OUTS, PCT, _AT, _DD, _U, blur_sql, gloss_sql, grad_sql, highlight_sql, hist_image_sql,
    morph_sql, noise_sql, normal_sql, rnd, sobel_sql, srnd,
)
from .catalog_shapes import _ROT, tris
from .catalog_views import _CAP, _CELLS, _SMP, LENS, _height_sql, sheet_sql, size_sql, strips_sql
from .registry import query

PX, PART = K.PX, K.PART


def thr_sql(src: str, dst: str, level: str, no: str = "") -> str:
    cols = _AT.format(n=no, src=src, lv=level)
    return f"{dst} AS (SELECT t.*, {src}.w, {src}.h FROM ({cols}) t JOIN {src} USING (image_id, frame, x, y))"


def despeckle_sql(src: str, dst: str, area: int) -> str:
    return (f"{dst}a AS (SELECT image_id, frame, x, y, {K.lum()} >= 128 AS onn FROM {src}), {cc_join_sql(f'{dst}a', f'{dst}c')}, "
            f"{dst}n AS (SELECT image_id, frame, lb, count(*) AS n FROM {dst}cl WHERE onn GROUP BY ALL), "
            f"{dst} AS (SELECT image_id, frame, {src}.w, {src}.h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT p.image_id, p.frame, p.x, p.y, CASE WHEN p.onn AND q.n >= {area} THEN 255 ELSE 0 END AS v "
            f"FROM {dst}cl p LEFT JOIN {dst}n q USING (image_id, frame, lb)) JOIN {src} USING (image_id, frame, x, y))")


_Z1 = (PX, highlight_sql("px", "hx", 2, 1.0, 4.0, 2.0), blur_sql("hx", "bl", 1), LHIST.format("bl"), OTSU, thr_sql("bl", "th", "ot"), despeckle_sql("th", "ds", 3), morph_sql("ds", "er", 1, "min"))
_Z1KW = dict(radius=2, min_area=3)
query("Z1_painted_highlights", K.sql(f"SELECT {K.OUT} FROM gp", *_Z1, gloss_sql("px", "er", None, "gp", matte=0.1)))(
    lambda s, sf: rc.painted_highlights(fx.px_embed(s, sf), **_Z1KW)[0].select(*OUT))
query("Z1_highlight_coverage", K.sql(COVER.format(srnd("n_on/n::DOUBLE"), "er"), *_Z1))(lambda s, sf: rc.painted_highlights(fx.px_embed(s, sf), **_Z1KW)[1].withColumn("coverage", rnd("coverage")))
query("Z2_relief_peaks", K.sql(f"SELECT {K.OUT} FROM gp", PX, LHIST.format("px"), PCT.format(f=0.2), thr_sql("px", "th", "pl"), despeckle_sql("th", "ds", 3), gloss_sql("px", "ds", "px", "gp", shine=24.0, matte=0.15, hs=3.0)))(
    lambda s, sf: rc.relief_peaks(fx.px_embed(s, sf), min_area=3).select(*OUT))
query("Z3_linework", K.sql(f"SELECT {K.OUT} FROM gp", PART, sobel_sql("pp", "so"), morph_sql("so", "mo", 1, "max"), LHIST.format("mo"), OTSU, thr_sql("mo", "th", "ot"), gloss_sql("pp", "th", None, "gp", matte=0.1)))(
    lambda s, sf: rc.linework(fx.px_part(s, sf)).select(*OUT))
query("Z4_dark_luxury", K.sql(
    f"SELECT {K.OUT} FROM gp", PX, f"gy AS (SELECT image_id, frame, w, h, x, y, v AS r, v AS g, v AS b, a FROM (SELECT *, 255-{K.jsr(K.lum())} AS v FROM px))", LHIST.format("gy"), PCT.format(f=0.1), thr_sql("gy", "th", "pl"),
    gloss_sql("px", "th", None, "gp", shine=48.0, matte=0.25)))(lambda s, sf: rc.dark_luxury(fx.px_embed(s, sf)).select(*OUT))
query("Z5_noise_normal_map", K.sql(f"SELECT {K.OUTS} FROM nm", K.IMGS, K.GRID, noise_sql("gr", 22.0, "3"), blur_sql("nz", "bl", 2), grad_sql("bl", "gd"), normal_sql("gd", "nm", "-(dx*2e0)", "-(dy*2e0)")))(
    lambda s, sf: rc.noise_normal_map(fx.img_part(s, sf)).select(*OUTS))
_GV = [K.u8(f"{p}e0+({q - p})::DOUBLE*(y/greatest(1,h-1)::DOUBLE)") for p, q in zip((30, 58, 138), (245, 158, 11))]
_VF = ("(1e0-0.6e0*(sqrt((x-(w-1)/2e0)*(x-(w-1)/2e0)+(y-(h-1)/2e0)*(y-(h-1)/2e0))/sqrt((w-1)/2e0*((w-1)/2e0)+(h-1)/2e0*((h-1)/2e0)))*(sqrt((x-(w-1)/2e0)*(x-(w-1)/2e0)+(y-(h-1)/2e0)*(y-(h-1)/2e0))"
       "/sqrt((w-1)/2e0*((w-1)/2e0)+(h-1)/2e0*((h-1)/2e0))))")
query("Z6_gradient_histogram", K.sql(
    f"SELECT {K.OUTS} FROM him", K.IMGS, K.GRID, f"g1 AS (SELECT image_id, frame, w, h, x, y, {_GV[0]} AS r, {_GV[1]} AS g, {_GV[2]} AS b, 255 AS a FROM gr)",
    f"vg AS (SELECT image_id, frame, {', '.join(f'{K.u8(f'{c}*{_VF}')} AS {c}' for c in 'rgb')}, a FROM g1)", HIST.format("vg"), hist_image_sql(32, 16)))(
    lambda s, sf: rc.gradient_histogram(fx.img_part(s, sf), width=32, height=16).select(*OUTS))
query("Z7_gradient_mesh", K.sql(
    "SELECT image_id AS mesh_id, (w*h*4 + 2*(2*w+2*h))::BIGINT AS triangles, 0e0 AS min_z FROM im", K.IMGS))(
    lambda s, sf: rc.gradient_mesh(fx.img_part(s, sf)).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("triangles"), F.min(F.least("az", "bz", "cz")).alias("min_z")))
_FLIP = multiview.Lens(width_mm=10.0, ppi=90.0, lpi=20.0, phase=0.3, height_mm=1.1, ri=1.5)
query("Z8_spinner_sheet")(lambda s, sf: rc.spinner_sheet(fx.img_part(s, sf).withColumn("h", F.col("w")), LENS).select(*OUTS))
_NEED = size_sql("vz", f"n*{_CELLS!r}::DOUBLE", "n")
query("Z9_animated_sheet", K.sql(
    f"SELECT {K.OUTS} FROM sm", K.FRAMES, K.SEQ, "nn AS (SELECT image_id, count(*)::INTEGER AS c FROM fr GROUP BY image_id)",
    f"ix AS (SELECT image_id, i::INTEGER AS frame, CASE WHEN c <= 8 THEN i ELSE least(c-1, {K.jsr('i*c/8e0')}) END::INTEGER AS src FROM nn, range(8) t(i) WHERE i < c)",
    "vw AS (SELECT s.image_id, ix.frame, w, h, x, y, r, g, b, a FROM sq s JOIN ix ON ix.image_id=s.image_id AND ix.src=s.frame)",
    "vz AS (SELECT image_id, 4 AS w0, 4 AS h0, least(c, 8) AS n, 4 AS wm FROM nn)", _NEED, sheet_sql(_FLIP), strips_sql("4", "4"), _SMP))(
    lambda s, sf: (lambda f: rc.animated_sheet(fx.seq_pixels(f), f, _FLIP))(fx.seq_frames(s, sf)).select(*OUTS))
_EDGE = lambda e: K.clamp01(f"({_DD}-({_U}*{e}e0))/({_U}*0.03e0)+0.5e0")
_DOTS = ("vw AS (SELECT image_id, frame, w, h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT image_id, 0 AS frame, w, h, x, y, "
         + K.u8(f"255e0+(-255e0)*{K.clamp01(f'{_DD}/({_U}*0.45e0)')}") + " AS v FROM gr UNION ALL SELECT image_id, 1, w, h, x, y, "
         + K.u8(f"255e0*({_EDGE(0.56)}*(1e0-{_EDGE(0.82)}))") + " FROM gr))")
_DOTZ = "vz AS (SELECT image_id, w AS w0, h AS h0, 2 AS n, w AS wm FROM im)"
query("Z11_two_frame_flip", K.sql(f"SELECT {K.OUTS} FROM sm", K.IMGS, K.GRID, _DOTS, _DOTZ, _NEED, sheet_sql(_FLIP), strips_sql("w0", "h0"), _SMP))(
    lambda s, sf: rc.two_frame_flip(fx.img_part(s, sf), _FLIP)[0].select(*OUTS))
query("Z11_flip_relief", K.sql(
    f"SELECT image_id, x, y, {_height_sql(_FLIP, 'o')} AS height FROM (SELECT *, abs((uu/pt+0.3e0-floor(uu/pt+0.3e0)-0.5e0)*pt) AS o FROM sh)", K.IMGS, _DOTZ,
    f"sz AS (SELECT image_id, w0, h0, n, {_CAP} AS w, greatest(1, {K.jsr(f'{_CAP}*h0/w0::DOUBLE')}) AS h FROM vz)", sheet_sql(_FLIP)))(
    lambda s, sf: rc.two_frame_flip(fx.img_part(s, sf), _FLIP)[1].select("image_id", "x", "y", "height"))
_MV = dict(cone_deg=30.0, distance=300.0, depth_mm=1.0, width_mm=60.0, height_mm=40.0, rotation=_ROT, width_px=18)
query("Z12_mesh_grid_sheet")(lambda s, sf: rc.mesh_grid_sheet(tris(s, sf), LENS, 2, **_MV).select(*OUTS))
query("Z13_mesh_strip_sheet")(lambda s, sf: rc.mesh_strip_sheet(tris(s, sf), _FLIP, 3, **_MV).select(*OUTS))


@query("Z10_subgraph_function", K.sql(f"SELECT image_id, frame, x, y, {', '.join(f'{K.jsr(f'{K.jsr(f'(255-{c})/{255 / 3!r}e0')}*{255 / 3!r}e0')} AS {c}' for c in 'rgb')}, a FROM px", PX))
def _subgraph(s, sf):
    """A named sub-graph is a plain function of DataFrames."""
    return fx.px_embed(s, sf).transform(color.invert).transform(color.posterize, 4).select(*OUT)


@query("Z14_material_masks")
def _materials(s, sf):
    """A stand-in model answers each picture's request with a threshold; cached answers are reused."""
    import re

    art = fx.px_embed(s, sf)
    ids = fx.table(s, sf, "embeddings").select(F.col("vec_id").alias("request_id"))
    requests = ids.select("request_id", F.concat(F.lit('{"mask_prompt":"metal","picture":'), "request_id", F.lit(',"seed":1}')).alias("request"))
    known = requests.filter("request_id % 3 = 0").select(enrich.request_key(F.lit("m/seg"), "request").alias("key"), F.lit("120").alias("answer"))

    def model(text: str) -> str:
        return str(100 + int(re.search(r'"picture":(\d+)', text).group(1)) % 50)

    def mask_of(answers):
        t = art.join(answers.select(F.col("request_id").alias("image_id"), F.col("answer").cast("int").alias("_cut")), "image_id")
        return color.threshold(t, F.col("_cut")).select(*PIXEL)

    return rc.material_masks(art, requests, known, "m/seg", model, mask_of, min_area=3).select(*OUT)
