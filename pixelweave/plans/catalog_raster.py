"""Registered queries: colour, sources, composition, statistics, neighbourhoods, geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import core as C
from ..operators import color, compose, neighborhood, regrid, stats
from ..schema import IMG, PIXEL
from ..sources import generators as gen
from . import fixtures as fx
from . import sqlkit as K
from .registry import query

OUT = ["image_id", "frame", "x", "y", "r", "g", "b", "a"]
OUTS = ["image_id", "frame", "w", "h", "x", "y", "r", "g", "b", "a"]
PX, PXB, PART, MASK = K.PX, K.PXB, K.PART, K.MASK


def rnd(col, n: int = 6):
    """Fixed rounding rule for reported doubles, the same text in both engines."""
    return F.floor(C.d(col) * float(10**n) + 0.5) / float(10**n)


def srnd(e: str, n: int = 6) -> str:
    return f"(floor(CAST({e} AS DOUBLE)*1e{n} + 0.5e0) / 1e{n})"


def on_px(name: str, fn, sql: str, cols=OUT):
    """A one-input operator over the 8x8 embedding images."""
    query(name, sql)(lambda s, sf, fn=fn: fn(fx.px_embed(s, sf)).select(*cols))


# ---- P: per-pixel colour -------------------------------------------------------------------
query("P1_luminance", K.sql(f"SELECT image_id, frame, x, y, {srnd(K.lum())} AS lum FROM px", PX))(
    lambda s, sf: fx.px_embed(s, sf).select(*OUT[:4], rnd(C.luminance()).alias("lum"))
)

# hex texts of every accepted and rejected length, derived from part
_HEX = (
    "hx AS (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '#' || substr(h, 1, 3) WHEN 1 THEN '#' || substr(h, 1, 4) "
    "WHEN 2 THEN '#' || substr(h, 1, 6) WHEN 3 THEN substr(h, 1, 8) WHEN 4 THEN '#' || substr(h, 1, 5) "
    "ELSE '#zz' || substr(h, 1, 4) END AS t FROM (SELECT p_partkey, md5(p_name) AS h FROM part))"
)


def _hexbyte(s: str) -> str:
    return f"coalesce(TRY_CAST('0x' || nullif(regexp_extract({s}, '^[0-9a-fA-F]+'), '') AS INTEGER), 0)"


def _hexpick(i: int, alpha: bool = False) -> str:
    short = _hexbyte(f"substr(t, {i}, 1) || substr(t, {i}, 1)")
    long = _hexbyte(f"substr(t, {2 * i - 1}, 2)")
    if alpha:
        return f"CASE length(t) WHEN 4 THEN {short} WHEN 8 THEN {long} ELSE 255 END"
    return f"CASE WHEN length(t) IN (3,4) THEN {short} WHEN length(t) IN (6,8) THEN {long} ELSE 0 END"


@query("P2_hex_to_rgba", K.sql(
    f"SELECT id, {_hexpick(1)}::INTEGER AS r, {_hexpick(2)}::INTEGER AS g, {_hexpick(3)}::INTEGER AS b, "
    f"{_hexpick(4, True)}::INTEGER AS a FROM (SELECT id, ltrim(t, '#') AS t FROM hx)", _HEX))
def _hex(s, sf):
    h = F.md5(F.col("p_name"))
    k = F.col("p_partkey") % 6
    t = fx.table(s, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(k == 0, F.concat(F.lit("#"), F.substring(h, 1, 3))).when(k == 1, F.concat(F.lit("#"), F.substring(h, 1, 4)))
        .when(k == 2, F.concat(F.lit("#"), F.substring(h, 1, 6))).when(k == 3, F.substring(h, 1, 8))
        .when(k == 4, F.concat(F.lit("#"), F.substring(h, 1, 5))).otherwise(F.concat(F.lit("#zz"), F.substring(h, 1, 4)))
        .alias("t"),
    )
    return t.select("id", C.hex_to_rgba("t").alias("c")).select("id", "c.r", "c.g", "c.b", "c.a")


on_px("P3_invert", lambda p: color.invert(p, r=True, g=False, b=True, a=True),
      K.sql("SELECT image_id, frame, x, y, 255-r AS r, g, 255-b AS b, 255-a AS a FROM px", PX))
on_px("P4_grayscale", color.grayscale, K.grey(K.jsr(K.lum()), a="a"))
_BC = (259 * (-40 * 2.55 + 255)) / (255 * (259 + 40 * 2.55))
on_px("P5_brightness_contrast", lambda p: color.brightness_contrast(p, 20, -40),
      K.rgb_map(lambda ch, i: K.u8(f"{_BC!r}e0*({ch}-128)+128e0+{20 * 2.55!r}e0")))
on_px("P6_threshold", lambda p: color.threshold(p, 120), K.bw(f"{K.lum()} >= 120"))
on_px("P6_threshold_inverted", lambda p: color.threshold(p, 120, invert=True), K.bw(f"NOT ({K.lum()} >= 120)"))
on_px("P7_levels", lambda p: color.levels(p, 40, 210, 1.8),
      K.rgb_map(lambda ch, i: K.jsr(f"pow({K.clamp01(f'({ch}-40)/170e0')}, {1 / 1.8!r}e0)*255e0")))

_CURVE = [(30, 10), (120, 180.5), (200, 90), (240, 250)]
_LUTSQL = (
    "cp AS (SELECT * FROM (VALUES (1,30e0,10e0),(2,120e0,180.5e0),(3,200e0,90e0),(4,240e0,250e0)) t(k,px,py)), "
    "lut AS (SELECT v::INTEGER AS v, CASE WHEN v <= 30 THEN 10 WHEN v >= 240 THEN 250 ELSE "
    "(SELECT " + K.jsr("a.py + (b.py-a.py)*((v-a.px)/(b.px-a.px))") +
    " FROM cp a JOIN cp b ON b.k = a.k+1 WHERE a.px <= v AND b.px > v) END::INTEGER AS lut FROM range(256) t(v))"
)
on_px("P9_apply_curve", lambda p: color.apply_curve(p, _CURVE, "rgb"), K.sql(
    "SELECT image_id, frame, x, y, l1.lut AS r, l2.lut AS g, l3.lut AS b, a FROM px JOIN lut l1 ON l1.v = px.r "
    "JOIN lut l2 ON l2.v = px.g JOIN lut l3 ON l3.v = px.b", PX, _LUTSQL))
on_px("P9_apply_curve_green", lambda p: color.apply_curve(p, _CURVE, "g"), K.sql(
    "SELECT image_id, frame, x, y, r, l2.lut AS g, b, a FROM px JOIN lut l2 ON l2.v = px.g", PX, _LUTSQL))


def curve_points(s, sf):
    """Four to five control points per part, unsorted and with ties, from hashed bytes."""
    p = fx.table(s, sf, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"))
    v = C.hash2(F.col("p_partkey"), F.col("ord"), F.lit(7))
    return p.withColumn("v", v).filter("ord < 4 or p_partkey % 3 = 0").select(
        F.col("p_partkey").alias("curve_id"), "ord",
        ((F.col("v") % 17) * 17).cast("double").alias("px"), ((F.shiftright("v", 8) % 600) / 2.0).alias("py"),
    )


_CPTS = (
    "pt AS (SELECT curve_id, ord, least(255e0, px) AS px, least(255e0, py) AS py FROM (SELECT p_partkey AS curve_id, ord, "
    f"((v % 17)*17)::DOUBLE AS px, ((v >> 8) % 600)/2e0 AS py FROM (SELECT p_partkey, ord, {K.hash2('p_partkey', 'ord', '7')} AS v "
    "FROM part, range(5) t(ord)) WHERE ord < 4 OR p_partkey % 3 = 0)), "
    "od AS (SELECT *, row_number() OVER (PARTITION BY curve_id ORDER BY px, ord) AS k, count(*) OVER (PARTITION BY curve_id) AS n FROM pt), "
    "ends AS (SELECT curve_id, min(CASE WHEN k=1 THEN px END) AS x0, min(CASE WHEN k=1 THEN py END) AS y0, "
    "max(CASE WHEN k=n THEN px END) AS xn, max(CASE WHEN k=n THEN py END) AS yn FROM od GROUP BY curve_id), "
    "cell AS (SELECT e.*, v::INTEGER AS v, (SELECT max(k) FROM od WHERE od.curve_id = e.curve_id AND od.px <= v) AS j "
    "FROM ends e, range(256) t(v))"
)
query("P8_curve_lut", K.sql(
    "SELECT c.curve_id, c.v, CASE WHEN c.v <= x0 THEN trunc(y0)::INTEGER WHEN c.v >= xn THEN trunc(yn)::INTEGER ELSE "
    + K.jsr("a.py + (b.py-a.py)*(CASE WHEN b.px=a.px THEN 0 ELSE (c.v-a.px)/(b.px-a.px) END)")
    + " END::INTEGER AS lut FROM cell c LEFT JOIN od a ON a.curve_id=c.curve_id AND a.k=c.j "
    "LEFT JOIN od b ON b.curve_id=c.curve_id AND b.k=c.j+1", _CPTS))(lambda s, sf: color.curve_lut(curve_points(s, sf)))

on_px("P10_opacity", lambda p: color.opacity(p, 0.35),
      K.sql(f"SELECT image_id, frame, x, y, r, g, b, {K.u8('a*0.35e0')} AS a FROM px", PX))
_T = (200, 90, 31)
on_px("P11_tint", lambda p: color.tint(p, _T), K.rgb_map(lambda ch, i: K.u8(f"{ch}*{_T[i]}e0/255e0")))
_LO, _HI = (10, 40, 90), (250, 200, 30)
on_px("P12_gradient_map", lambda p: color.gradient_map(p, _LO, _HI),
      K.rgb_map(lambda ch, i: K.u8(f"{_LO[i]}e0+({_HI[i] - _LO[i]})::DOUBLE*({K.lum()}/255e0)")))

# colour spaces in SQL, written out once
_MXMN = ("n0 AS (SELECT *, r/255e0 AS rr, g/255e0 AS gg, b/255e0 AS bb FROM px), "
         "n1 AS (SELECT *, greatest(rr,gg,bb) AS mx, least(rr,gg,bb) AS mn FROM n0)")
_HUE = ("CASE WHEN mx=mn THEN 0e0 WHEN mx=rr THEN ((gg-bb)/(mx-mn) + CASE WHEN gg<bb THEN 6e0 ELSE 0e0 END)/6e0 "
        "WHEN mx=gg THEN ((bb-rr)/(mx-mn)+2e0)/6e0 ELSE ((rr-gg)/(mx-mn)+4e0)/6e0 END")
_SATL = ("CASE WHEN mx=mn THEN 0e0 WHEN (mx+mn)/2e0 > 0.5e0 THEN (mx-mn)/(2e0-mx-mn) ELSE (mx-mn)/(mx+mn) END")
_SATV = "CASE WHEN mx=0 THEN 0e0 ELSE (mx-mn)/mx END"


@query("P13_rgb_to_hsl", K.sql(f"SELECT image_id, frame, x, y, {srnd(_HUE)} AS hue, {srnd(_SATL)} AS sat, "
                               f"{srnd('(mx+mn)/2e0')} AS light FROM n1", PX, _MXMN))
def _hsl(s, sf):
    return C.with_hsl(fx.px_embed(s, sf)).select(*OUT[:4], rnd("_h").alias("hue"), rnd("_s").alias("sat"), rnd("_l").alias("light"))


@query("P14_rgb_to_hsv", K.sql(f"SELECT image_id, frame, x, y, {srnd(_HUE)} AS hue, {srnd(_SATV)} AS sat, "
                               f"{srnd('mx')} AS val FROM n1", PX, _MXMN))
def _hsv(s, sf):
    h, sat, v = C.rgb_to_hsv()
    return fx.px_embed(s, sf).select(*OUT[:4], rnd(h).alias("hue"), rnd(sat).alias("sat"), rnd(v).alias("val"))


def _hue2(t: str) -> str:
    return (f"CASE WHEN {t} < 1e0/6e0 THEN p+(q-p)*6e0*{t} WHEN {t} < 0.5e0 THEN q WHEN {t} < 2e0/3e0 "
            f"THEN p+(q-p)*(2e0/3e0-{t})*6e0 ELSE p END")


def _hsl_to_rgb_sql(src: str) -> str:
    """Columns hh, ss, ll of src -> r, g, b."""
    wrap = lambda e: f"CASE WHEN {e} < 0 THEN {e}+1e0 WHEN {e} > 1 THEN {e}-1e0 ELSE {e} END"
    return (
        f"h1 AS (SELECT *, CASE WHEN ll < 0.5e0 THEN ll*(1e0+ss) ELSE ll+ss-ll*ss END AS q FROM {src}), "
        "h2 AS (SELECT *, 2e0*ll-q AS p, " + ", ".join(
            f"{wrap(f'(hh{o})')} AS t{ch}" for ch, o in (("r", "+1e0/3e0"), ("g", ""), ("b", "-1e0/3e0"))) + " FROM h1), "
        "h3 AS (SELECT image_id, frame, x, y, " + ", ".join(
            f"CASE WHEN ss = 0 THEN {K.jsr('ll*255e0')} ELSE {K.jsr('(' + _hue2('t' + ch) + ')*255e0')} END AS {ch}"
            for ch in "rgb") + ", a FROM h2)"
    )


on_px("P13_hsl_to_rgb", lambda p: C.with_rgb_of_hsl(C.with_hsl(p)), K.sql(
    f"SELECT {K.OUT} FROM h3", PX, _MXMN, f"n2 AS (SELECT * , {_HUE} AS hh, {_SATL} AS ss, (mx+mn)/2e0 AS ll FROM n1)",
    _hsl_to_rgb_sql("n2")))
on_px("P15_hue_saturation", lambda p: color.hue_saturation(p, -75, 1.4), K.sql(
    f"SELECT {K.OUT} FROM h3", PX, _MXMN,
    f"n2 AS (SELECT image_id, frame, x, y, a, ({_HUE} + {-75 / 360!r}e0) % 1e0 AS h0, "
    f"{K.clamp01('(' + _SATL + ')*1.4e0')} AS ss, (mx+mn)/2e0 AS ll FROM n1), "
    "n3 AS (SELECT *, CASE WHEN h0 < 0 THEN h0+1e0 ELSE h0 END AS hh FROM n2)", _hsl_to_rgb_sql("n3")))
_WB = (1 + 30 / 200, 1 - 20 / 200, 1 - 30 / 200)
on_px("P16_white_balance", lambda p: color.white_balance(p, 30, -20), K.rgb_map(lambda ch, i: K.u8(f"{ch}*{_WB[i]!r}e0")))
on_px("P17_posterize", lambda p: color.posterize(p, 5),
      K.rgb_map(lambda ch, i: K.jsr(f"{K.jsr(f'{ch}/{255 / 4!r}e0')}*{255 / 4!r}e0")))
on_px("P18_alpha_cleanup", lambda p: color.alpha_cleanup(p, 180, "transparent"),
      K.sql("SELECT image_id, frame, x, y, r, g, b, CASE WHEN a < 180 THEN 0 ELSE a END AS a FROM px", PX))
on_px("P18_alpha_cleanup_white", lambda p: color.alpha_cleanup(p, 180, "white"),
      K.rgb_map(lambda ch, i: f"CASE WHEN a < 180 THEN 255 ELSE {ch} END", a="CASE WHEN a < 180 THEN 255 ELSE a END"))
_BG = (30, 60, 200)
on_px("P19_flatten", lambda p: color.flatten(p, _BG),
      K.rgb_map(lambda ch, i: K.u8(f"{ch}*(a/255e0)+{_BG[i]}e0*(1e0-a/255e0)"), a="255"))
for _ch, _e in (("r", "r"), ("a", "a"), ("lum", K.jsr(K.lum())), ("hue", K.jsr(f"({_HUE})*255e0")),
                ("sat", K.jsr(f"({_SATV})*255e0")), ("val", K.jsr("mx*255e0"))):
    on_px(f"P20_extract_channel_{_ch}", lambda p, ch=_ch: color.extract_channel(p, ch),
          K.grey(_e, src="n1" if _ch in ("hue", "sat", "val") else "px",
                 ctes=(PX, _MXMN) if _ch in ("hue", "sat", "val") else (PX,)))
_KEYC = (120, 140, 150)
_DIST = "greatest(abs(r-120), abs(g-140), abs(b-150))"
on_px("P21_chroma_key", lambda p: color.chroma_key(p, _KEYC, 60), K.bw(f"{_DIST} <= 60"))
on_px("P22_remove_color", lambda p: color.remove_color(p, _KEYC, 60),
      K.sql(f"SELECT image_id, frame, x, y, r, g, b, CASE WHEN {_DIST} <= 60 THEN 0 ELSE a END AS a FROM px", PX))
_VIG = "(sqrt((x-3.5e0)*(x-3.5e0)+(y-3.5e0)*(y-3.5e0))/sqrt(3.5e0*3.5e0+3.5e0*3.5e0))"
on_px("P23_vignette", lambda p: color.vignette(p, 0.8), K.rgb_map(lambda ch, i: K.u8(f"{ch}*(1e0-0.8e0*{_VIG}*{_VIG})")))


@query("P24_safe_scalars", K.sql(
    "SELECT event_id, coalesce(TRY_CAST(nullif(regexp_extract(t, '^\\s*([+-]?\\d+\\.?\\d*)', 1), '') AS DOUBLE), -1e0) AS num, "
    "coalesce(t, 'none') AS str, CASE trim(t) WHEN 'true' THEN true WHEN 'false' THEN false ELSE false END AS flag FROM raw",
    "raw AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN props ->> '$.k' WHEN 1 THEN event_type WHEN 2 THEN 'true' "
    "WHEN 3 THEN NULL ELSE (props ->> '$.k') || 'px' END AS t FROM events)"))
def _safe(s, sf):
    k = F.col("event_id") % 5
    v = F.get_json_object("props", "$.k")
    t = fx.table(s, sf, "events").select(
        "event_id",
        F.when(k == 0, v).when(k == 1, F.col("event_type")).when(k == 2, F.lit("true"))
        .when(k == 3, F.lit(None).cast("string")).otherwise(F.concat(v, F.lit("px"))).alias("t"),
    )
    return t.select("event_id", C.safe_num("t", -1).alias("num"), C.safe_str("t", "none").alias("str"),
                    C.safe_bool("t").alias("flag"))


# ---- S: generated rasters ------------------------------------------------------------------
IM, GR = K.IMGS, K.GRID


def on_img(name: str, fn, channels: list[str], extra: str = ""):
    chans = ", ".join(f"{e} AS {c}" for e, c in zip(channels, "rgba"))
    query(name, K.sql(f"SELECT image_id, frame, w, h, x, y, {chans} FROM gr{extra}", IM, GR))(
        lambda s, sf, fn=fn: fn(fx.img_part(s, sf)).select(*OUTS)
    )


def _ramp(c0, c1, t: str) -> list[str]:
    return [K.u8(f"{p}e0+({q - p})::DOUBLE*({t})") for p, q in zip(c0, c1)]


_C0, _C1 = (10, 200, 30, 255), (250, 20, 90, 40)
on_img("S3_solid", lambda im: gen.solid(im, (12, 200, 77, 130)), ["12", "200", "77", "130"])
on_img("S4_linear_gradient", lambda im: gen.linear_gradient(im, _C0, _C1, True), _ramp(_C0, _C1, "x/greatest(1,w-1)::DOUBLE"))
on_img("S4_linear_gradient_vertical", lambda im: gen.linear_gradient(im, _C0, _C1, False),
       _ramp(_C0, _C1, "y/greatest(1,h-1)::DOUBLE"))
_DX, _DY, _U = "(x+0.5e0-w/2e0)", "(y+0.5e0-h/2e0)", "(least(w,h)/2e0)"
_DD = f"sqrt({_DX}*{_DX}+{_DY}*{_DY})"
on_img("S5_radial_gradient", lambda im: gen.radial_gradient(im, _C0, _C1, "radial", radius=0.9),
       _ramp(_C0, _C1, K.clamp01(f"{_DD}/({_U}*0.9e0)")))


def _soft(edge: str) -> str:
    return K.clamp01(f"({_DD}-{edge})/({_U}*0.15e0)+0.5e0")


on_img("S5_ring_gradient", lambda im: gen.radial_gradient(im, _C0, _C1, "ring", radius=0.4, inner=0.8, feather=0.15),
       _ramp(_C0, _C1, f"{_soft(f'({_U}*0.4e0)')}*(1e0-{_soft(f'({_U}*0.8e0)')})"))
on_img("S5_conic_gradient", lambda im: gen.radial_gradient(im, _C0, _C1, "conic", angle=40),
       _ramp(_C0, _C1, f"((atan2({_DX}, -{_DY})/{3.141592653589793 * 2!r}e0 + {-40 / 360!r}e0) % 1e0 + 1e0) % 1e0"))


def noise_sql(src: str, scale: float, seed: str) -> str:
    """CTE nz: grey value noise on a grid."""
    v = lambda i, j: f"({K.hash2(f'x0+{i}', f'y0+{j}', seed)})::DOUBLE/4294967295e0"
    return (
        f"z0 AS (SELECT *, x/{scale}e0 AS gx, y/{scale}e0 AS gy, CAST(floor(x/{scale}e0) AS BIGINT) AS x0, "
        f"CAST(floor(y/{scale}e0) AS BIGINT) AS y0 FROM {src}), "
        f"z1 AS (SELECT *, gx-x0 AS fx, gy-y0 AS fy, {v(0, 0)} AS va, {v(1, 0)} AS vb, {v(0, 1)} AS vc, {v(1, 1)} AS vd FROM z0), "
        "z2 AS (SELECT *, fx*fx*(3e0-fx*2e0) AS tx, fy*fy*(3e0-fy*2e0) AS ty FROM z1), "
        "z3 AS (SELECT *, va+(vb-va)*tx AS tt, vc+(vd-vc)*tx AS bb FROM z2), "
        f"nz AS (SELECT image_id, frame, w, h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT *, {K.jsr('(tt+(bb-tt)*ty)*255e0')} AS v FROM z3))"
    )


query("S6_value_noise", K.sql(f"SELECT {K.OUTS} FROM nz", IM, GR, noise_sql("gr", 3.5, "image_id")))(
    lambda s, sf: gen.value_noise(fx.img_part(s, sf), 3.5, "image_id").select(*OUTS)
)
HIST = ("hi AS (SELECT image_id, frame, channel, bin, count(*) AS n FROM (SELECT image_id, frame, 'r' AS channel, r AS bin FROM {0} "
        "WHERE a<>0 UNION ALL SELECT image_id, frame, 'g', g FROM {0} WHERE a<>0 UNION ALL SELECT image_id, frame, 'b', b FROM {0} "
        "WHERE a<>0) GROUP BY ALL)")


def hist_image_sql(w: int, h: int) -> str:
    bar = lambda c, base: (
        f"CASE WHEN {h}-y <= " + K.jsr(f"coalesce(h{c}.n,0)/mx::DOUBLE*{h}e0") + f" THEN {min(255, base + 200)} ELSE {base} END AS {c}"
    )
    return (
        "mxs AS (SELECT image_id, frame, greatest(1, max(n)) AS mx FROM hi GROUP BY image_id, frame), "
        f"him AS (SELECT m.image_id, m.frame, {w} AS w, {h} AS h, x::INTEGER AS x, y::INTEGER AS y, {bar('r', 20)}, {bar('g', 20)}, {bar('b', 24)}, "
        f"255 AS a FROM mxs m, range({w}) t(x), range({h}) u(y) "
        + " ".join(
            f"LEFT JOIN hi h{c} ON h{c}.image_id=m.image_id AND h{c}.frame=m.frame AND h{c}.channel='{c}' AND "
            f"h{c}.bin = least(255, CAST(floor(x/{w}e0*256) AS INTEGER))" for c in "rgb") + ")"
    )


query("S7_histogram_image", K.sql(f"SELECT {K.OUTS} FROM him", PX, HIST.format("px"), hist_image_sql(32, 16)))(
    lambda s, sf: gen.histogram_image(stats.histogram(fx.px_embed(s, sf)), 32, 16).select(*OUTS)
)

# ---- J: multi-image ------------------------------------------------------------------------
_BLEND = {
    "max": "greatest(p.{c}, q.{c})", "min": "least(p.{c}, q.{c})", "multiply": "p.{c}*q.{c}/255e0",
    "add": "least(255, p.{c}+q.{c})", "subtract": "greatest(0, p.{c}-q.{c})", "difference": "abs(p.{c}-q.{c})",
    "screen": "255e0-(255e0-p.{c})*(255e0-q.{c})/255e0", "average": "(p.{c}+q.{c})/2e0",
}
_J = "FROM px p JOIN pxb q USING (image_id, frame, x, y)"


def over_sql(top: str, bot: str, rounding=K.u8) -> str:
    at, ab = f"({top}.a/255e0)", f"({bot}.a/255e0)"
    ao = f"({at}+{ab}*(1e0-{at}))"
    return ", ".join(
        f"CASE WHEN {ao} > 0 THEN {rounding(f'({top}.{c}*{at}+{bot}.{c}*{ab}*(1e0-{at}))/{ao}')} ELSE 0 END AS {c}" for c in "rgb"
    ) + f", {rounding(f'{ao}*255e0')} AS a"


for _m, _e in _BLEND.items():
    query(f"J1_combine_{_m}", K.sql(
        "SELECT image_id, frame, x, y, " + ", ".join(f"{K.u8(_e.format(c=c))} AS {c}" for c in "rgb")
        + f", greatest(p.a, q.a) AS a {_J}", PX, PXB))(
        lambda s, sf, m=_m: compose.combine(fx.px_embed(s, sf), fx.px_embed_b(s, sf), m, same_size=True).select(*OUT)
    )
for _m in ("over", "under"):
    query(f"J2_combine_{_m}", K.sql(
        f"SELECT image_id, frame, x, y, {over_sql(*(('p', 'q') if _m == 'over' else ('q', 'p')))} {_J}", PX, PXB))(
        lambda s, sf, m=_m: compose.combine(fx.px_embed(s, sf), fx.px_embed_b(s, sf), m, same_size=True).select(*OUT)
    )

# sizes differ (8x8 under 16x16) and each side has images the other lacks
_FIT = ("fit AS (SELECT t.image_id, t.frame, t.w, t.h, xo::INTEGER AS x, yo::INTEGER AS y, p.r, p.g, p.b, p.a FROM "
        "(SELECT * FROM (SELECT i.image_id, i.frame, i.w AS sw, i.h AS sh, coalesce(z.w, i.w) AS w, coalesce(z.h, i.h) AS h "
        "FROM (SELECT DISTINCT image_id, frame, w, h FROM {b}) i LEFT JOIN (SELECT DISTINCT image_id, frame, w, h FROM {a}) z "
        "USING (image_id, frame)) u, range(u.w) tx(xo), range(u.h) ty(yo)) t JOIN {b} p ON p.image_id=t.image_id AND p.frame=t.frame "
        "AND p.x = least(sw-1, CAST(floor(xo/t.w::DOUBLE*sw) AS INTEGER)) AND p.y = least(sh-1, CAST(floor(yo/t.h::DOUBLE*sh) AS INTEGER)))")
query("J1_combine_resized_outer", K.sql(
    "SELECT image_id, frame, coalesce(p.w, q.w) AS w, coalesce(p.h, q.h) AS h, x, y, " + ", ".join(
        f"CASE WHEN p.w IS NOT NULL AND q.w IS NOT NULL THEN {K.u8(f'255e0-(255e0-p.{c})*(255e0-q.{c})/255e0')} "
        f"ELSE coalesce(p.{c}, q.{c}) END AS {c}" for c in "rgb")
    + ", CASE WHEN p.w IS NOT NULL AND q.w IS NOT NULL THEN greatest(p.a, q.a) ELSE coalesce(p.a, q.a) END AS a "
    "FROM pp p FULL JOIN fit q USING (image_id, frame, x, y)", PX, PART,
    "sx AS (SELECT image_id + 100 AS image_id, frame, w, h, x, y, r, g, b, a FROM px)", _FIT.format(a="pp", b="sx")))(
    lambda s, sf: compose.combine(
        fx.px_part(s, sf), fx.px_embed(s, sf).withColumn("image_id", F.col("image_id") + 100).select(*PIXEL), "screen"
    ).select(*OUTS)
)


# layers: the eight rows of an embedding image become eight 8x1 layers
_LAY = ("ly AS (SELECT image_id, frame, y AS layer, w, 1 AS h, x, 0 AS y, r, g, b, a FROM px)")


def layers(s, sf):
    return fx.px_embed(s, sf).select("image_id", "frame", F.col("y").alias("layer"), "w", F.lit(1).alias("h"), "x",
                                     F.lit(0).alias("y"), "r", "g", "b", "a")


for _m in ("screen", "average", "over", "under", "add", "subtract", "max", "min", "multiply", "difference"):
    _step = (over_sql(*(("f", "l") if _m == "over" else ("l", "f"))) if _m in ("over", "under") else
             ", ".join(f"{K.u8(_BLEND[_m].replace('p.', 'f.').replace('q.', 'l.').format(c=c))} AS {c}" for c in "rgb")
             + ", greatest(f.a, l.a) AS a")
    query(f"J3_fold_combine_{_m}", K.sql(
        f"SELECT {K.OUT} FROM fo WHERE layer = 7", PX, _LAY,
        "fo AS (SELECT image_id, frame, layer, x, y, r, g, b, a FROM ly WHERE layer = 0 UNION ALL "
        f"SELECT l.image_id, l.frame, l.layer, l.x, l.y, {_step} FROM fo f JOIN ly l ON l.image_id=f.image_id AND "
        "l.frame=f.frame AND l.x=f.x AND l.y=f.y AND l.layer=f.layer+1)"))(
        lambda s, sf, m=_m: compose.fold_combine(layers(s, sf), "layer", m).select(*OUT)
    )

query("J4_apply_mask", K.sql(
    f"SELECT image_id, frame, x, y, p.r, p.g, p.b, CASE WHEN q.r IS NULL THEN p.a ELSE {K.u8(f'p.a*({K.lum(chr(113) + chr(46))}/255e0)')} END AS a "
    "FROM px p LEFT JOIN (SELECT * FROM pxb WHERE image_id % 3 <> 0) q USING (image_id, frame, x, y)", PX, PXB))(
    lambda s, sf: compose.apply_mask(fx.px_embed(s, sf), fx.px_embed_b(s, sf).filter("image_id % 3 <> 0"), same_size=True).select(*OUT)
)
_ONA, _ONB = f"({K.lum('p.')} >= 128)", f"({K.lum('q.')} >= 128)"
for _m, _e in (("and", f"{_ONA} AND {_ONB}"), ("or", f"{_ONA} OR {_ONB}"), ("subtract", f"{_ONA} AND NOT {_ONB}"),
               ("xor", f"{_ONA} <> {_ONB}")):
    query(f"J5_mask_{_m}", K.sql(
        f"SELECT image_id, frame, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT image_id, frame, x, y, "
        f"CASE WHEN {_e} THEN 255 ELSE 0 END AS v {_J})", PX, PXB))(
        lambda s, sf, m=_m: compose.mask_combine(fx.px_embed(s, sf), fx.px_embed_b(s, sf), m, same_size=True).select(*OUT)
    )
    _set = {"and": "INTERSECT", "or": "UNION", "subtract": "EXCEPT"}.get(_m)
    _pos = "SELECT image_id, frame, x, y FROM {} WHERE " + f"{K.lum()} >= 128"
    _A, _B = _pos.format("px"), _pos.format("pxb")
    query(f"J5_mask_set_{_m}", K.sql(
        f"{_A} {_set} {_B}" if _set else f"(({_A}) EXCEPT ({_B})) UNION (({_B}) EXCEPT ({_A}))", PX, PXB))(
        lambda s, sf, m=_m: compose.mask_set(fx.px_embed(s, sf).filter(C.luminance() >= 128),
                                             fx.px_embed_b(s, sf).filter(C.luminance() >= 128), m)
    )
for _v in (False, True):
    _p, _tag = ("y", "_vertical") if _v else ("x", "")
    query(f"J6_split_compare{_tag}", K.sql(
        "SELECT image_id, frame, x, y, " + ", ".join(
            f"CASE WHEN {_p} = 3 THEN 255 WHEN {_p} < 3 THEN p.{c} ELSE q.{c} END AS {c}" for c in "rgba") + f" {_J}", PX, PXB))(
        lambda s, sf, v=_v: compose.split_compare(fx.px_embed(s, sf), fx.px_embed_b(s, sf), 0.4, v, same_size=True).select(*OUT)
    )
query("J7_channel_pack", K.sql(
    f"SELECT image_id, frame, x, y, {K.u8(K.lum('p.'))} AS r, coalesce({K.u8(K.lum('q.'))}, 0) AS g, 0 AS b, "
    f"coalesce({K.u8('q.a*1e0')}, 255) AS a FROM px p LEFT JOIN (SELECT * FROM pxb WHERE image_id % 4 <> 1) q "
    "USING (image_id, frame, x, y)", PX, PXB))(
    lambda s, sf: compose.channel_pack(
        r=fx.px_embed(s, sf), g=fx.px_embed_b(s, sf).filter("image_id % 4 <> 1"),
        a=color.grey(fx.px_embed_b(s, sf).filter("image_id % 4 <> 1"), F.col("a")), same_size=True).select(*OUT)
)
_PASTE = ("pa AS (SELECT image_id, frame, p.w, p.h, x, y, " + ", ".join(
    f"CASE WHEN q.a IS NULL THEN p.{c} ELSE {{{c}}} END AS {c}" for c in "rgba") + " FROM {base} p LEFT JOIN "
    "(SELECT image_id, frame, x+{ox} AS x, y+{oy} AS y, r, g, b, a FROM {ov} WHERE a > 0) q USING (image_id, frame, x, y))")


def paste_sql(base: str, ov: str, ox: str, oy: str) -> str:
    parts = dict(zip("rgba", [s.rsplit(" AS ", 1)[0] for s in _split_top(over_sql("q", "p", K.jsr))]))
    return _PASTE.format(base=base, ov=ov, ox=ox, oy=oy, **parts)


def _split_top(s: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for ch in s:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(cur.strip())
            cur = ""
        else:
            cur += ch
    return [*out, cur.strip()]


query("J8_paste", K.sql(f"SELECT {K.OUT} FROM pa", PX, PXB, paste_sql("px", "pxb", "3", "-2")))(
    lambda s, sf: compose.paste(fx.px_embed(s, sf), fx.px_embed_b(s, sf), 3, -2).select(*OUT)
)
_CROP = "cr AS (SELECT image_id, frame, 3 AS w, 4 AS h, x-5 AS x, y-2 AS y, r, g, b, a FROM px WHERE x>=5 AND y>=2 AND y<6)"
query("J9_split_region", K.sql(
    "SELECT image_id, frame, x, y, r, g, b, a, '{\"x\":5,\"y\":2,\"width\":3,\"height\":4}' AS region FROM cr", PX, _CROP))(
    lambda s, sf: (lambda cr: cr[0].join(cr[1], IMG).select(*OUT, "region"))(compose.split_region(fx.px_embed(s, sf), 5, 2, 9, 4))
)
# regions: valid for two images in three, broken text for the rest
_RG = ("rg AS (SELECT vec_id AS image_id, vec_id % 3 <> 0 AS ok, CASE WHEN vec_id % 3 <> 0 THEN 1 ELSE 2 END AS px, "
       "CASE WHEN vec_id % 3 <> 0 THEN 2 ELSE 1 END AS py, CASE WHEN vec_id % 3 <> 0 THEN 5 ELSE 8 END AS pw, "
       "CASE WHEN vec_id % 3 <> 0 THEN 6 ELSE 3 END AS ph FROM embeddings)")


def bilinear_sql(src: str, dst: str, tw: str, th: str) -> str:
    """CTE dst: corner-aligned bilinear resize of src (join-based definition); tw, th per row of src."""
    pos = lambda o, n, m: f"(CASE WHEN {n} > 1 THEN {o}*({m}-1)/({n}-1)::DOUBLE ELSE 0e0 END)"
    mixed = lambda c: K.u8(
        f"(a.{c}*(1e0-wx)+b.{c}*wx)*(1e0-wy)+(c.{c}*(1e0-wx)+d.{c}*wx)*wy")
    key = lambda t, x, y: f"JOIN {src} {t} ON {t}.image_id=o.image_id AND {t}.frame=o.frame AND {t}.x={x} AND {t}.y={y}"
    return (
        f"{dst}i AS (SELECT DISTINCT image_id, frame, w AS sw, h AS sh, {tw} AS tw, {th} AS th FROM {src}), "
        f"{dst}o AS (SELECT *, CAST(floor(fx) AS INTEGER) AS x0, CAST(floor(fy) AS INTEGER) AS y0, fx-floor(fx) AS wx, fy-floor(fy) AS wy FROM "
        f"(SELECT *, xo::INTEGER AS x, yo::INTEGER AS y, {pos('xo', 'tw', 'sw')} AS fx, {pos('yo', 'th', 'sh')} AS fy FROM {dst}i, range(tw) u(xo), range(th) v(yo))), "
        f"{dst} AS (SELECT o.image_id, o.frame, tw::INTEGER AS w, th::INTEGER AS h, o.x, o.y, {', '.join(f'{mixed(c)} AS {c}' for c in 'rgba')} FROM {dst}o o "
        f"{key('a', 'x0', 'y0')} {key('b', 'least(sw-1,x0+1)', 'y0')} {key('c', 'x0', 'least(sh-1,y0+1)')} "
        f"{key('d', 'least(sw-1,x0+1)', 'least(sh-1,y0+1)')})"
    )


@query("J10_place_image", K.sql(
    f"SELECT {K.OUT} FROM pa", PX, PXB, _RG, "ov AS (SELECT b.*, pw, ph FROM pxb b JOIN rg USING (image_id))",
    bilinear_sql("ov", "bz", "pw", "ph"), "bp AS (SELECT b.*, px, py FROM bz b JOIN rg USING (image_id))",
    paste_sql("px", "bp", "px", "py")))
def _place(s, sf):
    ok = F.col("vec_id") % 3 != 0
    regions = fx.table(s, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"), F.lit(0).alias("frame"),
        F.when(ok, F.lit('{"x":1,"y":2,"width":5,"height":6}')).otherwise(F.lit('{"x":1,"y":null')).alias("region"),
    )
    return compose.place_image(fx.px_embed(s, sf), fx.px_embed_b(s, sf), regions, x=2, y=1, width=0, height=3).select(*OUT)


# ---- A: aggregations -----------------------------------------------------------------------
query("A1_histogram", K.sql("SELECT image_id, frame, channel, bin, n FROM hi", PART, HIST.format("pp")))(
    lambda s, sf: stats.histogram(fx.px_part(s, sf)))
LHIST = f"lh AS (SELECT image_id, frame, {K.jsr(K.lum())} AS bin, count(*) AS n FROM {{0}} WHERE a<>0 GROUP BY ALL)"
query("A2_luminance_histogram", K.sql("SELECT image_id, frame, bin, n FROM lh", PART, LHIST.format("pp")))(
    lambda s, sf: stats.luminance_histogram(fx.px_part(s, sf)))
OTSU = (
    "o1 AS (SELECT i.image_id, i.frame, v::INTEGER AS v, coalesce(n, 0) AS n FROM (SELECT DISTINCT image_id, frame FROM lh) i "
    "CROSS JOIN range(256) t(v) LEFT JOIN lh ON lh.image_id=i.image_id AND lh.frame=i.frame AND lh.bin=v), "
    "o2 AS (SELECT *, sum(n) OVER q AS wb, sum(v*n) OVER q AS sb, sum(n) OVER (PARTITION BY image_id, frame) AS tot, "
    "sum(v*n) OVER (PARTITION BY image_id, frame) AS stot FROM o1 WINDOW q AS (PARTITION BY image_id, frame ORDER BY v)), "
    "o3 AS (SELECT *, wb::DOUBLE*(tot-wb)::DOUBLE*(sb::DOUBLE/wb::DOUBLE-(stot-sb)::DOUBLE/(tot-wb)::DOUBLE)"
    "*(sb::DOUBLE/wb::DOUBLE-(stot-sb)::DOUBLE/(tot-wb)::DOUBLE) AS bt FROM o2 WHERE wb > 0 AND tot > wb), "
    "o4 AS (SELECT image_id, frame, v, row_number() OVER (PARTITION BY image_id, frame ORDER BY bt DESC, v) AS k FROM o3), "
    "ot AS (SELECT i.image_id, i.frame, least(255, coalesce(o4.v, 127)+1)::INTEGER AS level FROM (SELECT DISTINCT image_id, frame FROM lh) i "
    "LEFT JOIN o4 ON o4.image_id=i.image_id AND o4.frame=i.frame AND k=1)"
)
PCT = (
    "pl AS (SELECT image_id, frame, max(CASE WHEN acc >= {f}e0*tot THEN bin END)::INTEGER AS level FROM (SELECT image_id, frame, bin, "
    "sum(n) OVER (PARTITION BY image_id, frame ORDER BY bin DESC) AS acc, sum(n) OVER (PARTITION BY image_id, frame) AS tot "
    "FROM lh) GROUP BY image_id, frame)"
)
query("A3_otsu_level", K.sql("SELECT image_id, frame, level FROM ot", PART, LHIST.format("pp"), OTSU))(
    lambda s, sf: stats.otsu_level(stats.luminance_histogram(fx.px_part(s, sf))))
query("A4_percentile_level", K.sql("SELECT image_id, frame, level FROM pl", PART, LHIST.format("pp"), PCT.format(f=0.2)))(
    lambda s, sf: stats.percentile_level(stats.luminance_histogram(fx.px_part(s, sf)), 20))
_AT = ("SELECT image_id, frame, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT p.image_id, p.frame, x, y, CASE WHEN {n} "
       f"{K.lum()} >= coalesce(level, 128) THEN 255 ELSE 0 END AS v FROM {{src}} p LEFT JOIN {{lv}} l ON l.image_id=p.image_id AND l.frame=p.frame)")
query("A5_auto_threshold_otsu", K.sql(_AT.format(n="", src="pp", lv="ot"), PART, LHIST.format("pp"), OTSU))(
    lambda s, sf: stats.auto_threshold(fx.px_part(s, sf), "otsu").select(*OUT))
query("A5_auto_threshold_percentile", K.sql(_AT.format(n="NOT", src="px", lv="pl"), PX, LHIST.format("px"), PCT.format(f=0.35)))(
    lambda s, sf: stats.auto_threshold(fx.px_embed(s, sf), "percentile", 35, invert=True).select(*OUT))
query("A6_normalize", K.sql(
    "SELECT image_id, frame, x, y, " + ", ".join(
        f"CASE WHEN hi{c} > lo{c} THEN {K.u8(f'({c}-lo{c})*(255e0/(hi{c}-lo{c}))')} ELSE {c} END AS {c}" for c in "rgb")
    + ", a FROM pp JOIN st USING (image_id, frame)", PART,
    "st AS (SELECT image_id, frame, " + ", ".join(
        f"min({c}) FILTER (a<>0) AS lo{c}, max({c}) FILTER (a<>0) AS hi{c}" for c in "rgb") + " FROM pp GROUP BY image_id, frame)"))(
    lambda s, sf: stats.normalize(fx.px_part(s, sf)).select(*OUT))
COVER = (
    "SELECT image_id, frame, n_on, n, {0} AS coverage, n_on/n::DOUBLE BETWEEN 0.05e0 AND 0.3e0 AS in_band FROM (SELECT image_id, frame, "
    f"sum(CASE WHEN {K.lum()}/255e0 >= 0.5e0 THEN 1 ELSE 0 END)::BIGINT AS n_on, count(*) AS n FROM {{1}} GROUP BY image_id, frame)"
)


def coverage_out(m: DataFrame) -> DataFrame:
    return stats.coverage(m).withColumn("coverage", rnd("coverage"))


query("A7_coverage", K.sql(COVER.format(srnd("n_on/n::DOUBLE"), "mk"), MASK))(lambda s, sf: coverage_out(fx.mask_part(s, sf)))
query("recipe_otsu_coverage", K.sql(
    COVER.format(srnd("n_on/n::DOUBLE"), "th"), PX, f"gy AS ({K.grey(K.jsr(K.lum()), a='a', ctes=(PX,)).split(') SELECT', 1)[0] and ''}"
    f"SELECT image_id, frame, x, y, v AS r, v AS g, v AS b, a FROM (SELECT *, {K.jsr(K.lum())} AS v FROM px))",
    LHIST.format("gy"), OTSU, f"th AS ({_AT.format(n='', src='gy', lv='ot')})"))(
    lambda s, sf: coverage_out(stats.auto_threshold(color.grayscale(fx.px_embed(s, sf)), "otsu")))

# ---- W: neighbourhoods ---------------------------------------------------------------------


def axis_sql(src: str, dst: str, axis: str, r: int, channels: dict[str, str], keep: str = "") -> str:
    """CTE dst: aggregate over 2r+1 clamped neighbours of src along an axis (join-based definition)."""
    moving, fixed, n = ("x", "y", "w") if axis == "row" else ("y", "x", "h")
    aggs = ", ".join(f"{e} AS {c}" for c, e in channels.items())
    return (f"{dst} AS (SELECT p.image_id, p.frame, p.w, p.h, p.x, p.y{keep}, {aggs} FROM {src} p CROSS JOIN range({-r}, {r + 1}) t(k) "
            f"JOIN {src} q ON q.image_id=p.image_id AND q.frame=p.frame AND q.{fixed}=p.{fixed} AND "
            f"q.{moving}=greatest(0, least(p.{n}-1, p.{moving}+k)) GROUP BY ALL)")


def blur_sql(src: str, dst: str, r: int) -> str:
    mean = {c: K.u8(f"sum(q.{c})/{2 * r + 1}e0") for c in "rgba"}
    prem = ", ".join(f"{K.u8(f'{c}*a/255e0')} AS {c}" for c in "rgb")
    un = ", ".join(f"CASE WHEN a > 0 THEN {K.u8(f'{c}*255e0/a')} ELSE 0 END AS {c}" for c in "rgb")
    return (f"{dst}1 AS (SELECT image_id, frame, w, h, x, y, {prem}, a FROM {src}), "
            + axis_sql(f"{dst}1", f"{dst}2", "row", r, mean) + ", " + axis_sql(f"{dst}2", f"{dst}3", "column", r, mean)
            + f", {dst} AS (SELECT image_id, frame, w, h, x, y, {un}, a FROM {dst}3)")


def morph_sql(src: str, dst: str, r: int, fn: str) -> str:
    ext = {c: f"{fn}(q.{c})" for c in "rgba"}
    return axis_sql(src, f"{dst}1", "row", r, ext) + ", " + axis_sql(f"{dst}1", dst, "column", r, ext)


for _r in (1, 3):
    on_px(f"W1_box_blur_r{_r}", lambda p, r=_r: neighborhood.box_blur(p, r), K.sql(f"SELECT {K.OUT} FROM bl", PX, blur_sql("px", "bl", _r)))
query("W1_box_blur_wide", K.sql(f"SELECT {K.OUT} FROM bl", PART, blur_sql("pp", "bl", 5)))(
    lambda s, sf: neighborhood.box_blur(fx.px_part(s, sf), 5).select(*OUT))
on_px("W2_sharpen", lambda p: neighborhood.sharpen(p, 0.8), K.sql(
    "SELECT p.image_id, p.frame, p.x, p.y, " + ", ".join(f"{K.u8(f'p.{c}+0.8e0*(p.{c}-q.{c})')} AS {c}" for c in "rgb")
    + ", p.a FROM px p JOIN bl q USING (image_id, frame, x, y)", PX, blur_sql("px", "bl", 1)))
for _n, _f, _r in (("W3_dilate", "max", 2), ("W4_erode", "min", 2)):
    query(_n, K.sql(f"SELECT {K.OUT} FROM mo", PART, morph_sql("pp", "mo", _r, _f)))(
        lambda s, sf, n=_n, r=_r: (neighborhood.dilate if "dilate" in n else neighborhood.erode)(fx.px_part(s, sf), r).select(*OUT))
query("W3_dilate_wide", K.sql(f"SELECT {K.OUT} FROM mo", PX, morph_sql("px", "mo", 5, "max")))(
    lambda s, sf: neighborhood.dilate(fx.px_embed(s, sf), 5).select(*OUT))
for _n, _a, _b in (("open", "min", "max"), ("close", "max", "min")):
    on_px(f"W5_{_n}", lambda p, n=_n: neighborhood.open_close(p, 1, n), K.sql(
        f"SELECT {K.OUT} FROM m2", PX, morph_sql("px", "m1", 1, _a), morph_sql("m1", "m2", 1, _b)))

_SH = lambda v, part, order: (
    f"coalesce(lag({v}) OVER (PARTITION BY image_id, frame, {part} ORDER BY {order}), {v}) AS {v}m, "
    f"coalesce(lead({v}) OVER (PARTITION BY image_id, frame, {part} ORDER BY {order}), {v}) AS {v}p")


def sobel_sql(src: str, dst: str) -> str:
    gx = "(-vmm + vpm - vm*2 + vp*2 - vmp + vpp)"
    gy = "(-vmm - v_m*2 - vpm + vmp + v_p*2 + vpp)"
    return (
        f"{dst}0 AS (SELECT *, {K.lum()} AS v FROM {src}), {dst}1 AS (SELECT *, {_SH('v', 'y', 'x')} FROM {dst}0), "
        f"{dst}2 AS (SELECT *, {_SH('vm', 'x', 'y')}, {_SH('vp', 'x', 'y')}, {_SH('v', 'x', 'y').replace('vm', 'v_m').replace('vp', 'v_p')} FROM {dst}1), "
        f"{dst} AS (SELECT image_id, frame, w, h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT image_id, frame, w, h, x, y, "
        f"{K.u8(f'sqrt({gx}*{gx}+{gy}*{gy})')} AS v FROM {dst}2))"
    )


def grad_sql(src: str, dst: str, value: str = "") -> str:
    """CTE dst: src plus dx, dy of luminance/255."""
    value = value or f"{K.lum()}/255e0"
    return (f"{dst}0 AS (SELECT *, {value} AS v FROM {src}), {dst}1 AS (SELECT *, {_SH('v', 'y', 'x')} FROM {dst}0), "
            f"{dst}2 AS (SELECT *, vp-vm AS dx, {_SH('v', 'x', 'y').replace('vm', 'wm').replace('vp', 'wp')} FROM {dst}1), "
            f"{dst} AS (SELECT *, wp-wm AS dy FROM {dst}2)")


def normal_sql(src: str, dst: str, nx: str, ny: str) -> str:
    return (f"{dst}x AS (SELECT *, {nx} AS nx, {ny} AS ny FROM {src}), "
            f"{dst}y AS (SELECT *, sqrt(nx*nx+ny*ny+1e0) AS ln FROM {dst}x), "
            f"{dst} AS (SELECT image_id, frame, w, h, x, y, {K.u8('(nx/ln*0.5e0+0.5e0)*255e0')} AS r, "
            f"{K.u8('(ny/ln*0.5e0+0.5e0)*255e0')} AS g, {K.u8('(1e0/ln*0.5e0+0.5e0)*255e0')} AS b, 255 AS a FROM {dst}y)")


query("W6_sobel", K.sql(f"SELECT {K.OUT} FROM so", PART, sobel_sql("pp", "so")))(
    lambda s, sf: neighborhood.sobel(fx.px_part(s, sf)).select(*OUT))
query("W7_normal_map", K.sql(f"SELECT {K.OUT} FROM nm", PART, grad_sql("pp", "gd"), normal_sql("gd", "nm", "-(dx*2.5e0)", "-(dy*2.5e0)")))(
    lambda s, sf: neighborhood.normal_map(fx.px_part(s, sf), 2.5).select(*OUT))


def highlight_sql(src: str, dst: str, r: int, gain: float, bias: float, k: float) -> str:
    sat = "(CASE WHEN greatest(r,g,b)=0 THEN 0e0 ELSE (greatest(r/255e0,g/255e0,b/255e0)-least(r/255e0,g/255e0,b/255e0))/greatest(r/255e0,g/255e0,b/255e0) END)"
    mean = {"l": K.u8(f"sum(q.l)/{2 * r + 1}e0")}
    return (
        f"{dst}0 AS (SELECT *, {K.u8(K.lum())} AS l FROM {src}), " + axis_sql(f"{dst}0", f"{dst}1", "row", r, mean) + ", "
        + axis_sql(f"{dst}1", f"{dst}2", "column", r, mean) +
        f", {dst} AS (SELECT image_id, frame, w, h, x, y, v AS r, v AS g, v AS b, 255 AS a FROM (SELECT p.image_id, p.frame, p.w, p.h, p.x, p.y, "
        + K.u8(f"greatest(0e0, (p.l-q.l-{bias}e0)*{gain}e0)*pow(1e0-{sat}, {k}e0)")
        + f" AS v FROM {dst}0 p JOIN {dst}2 q USING (image_id, frame, x, y)))"
    )


on_px("W8_highlight_extract", lambda p: neighborhood.highlight_extract(p, 2, 3.0, 4.0, 1.5),
      K.sql(f"SELECT {K.OUT} FROM hx", PX, highlight_sql("px", "hx", 2, 3.0, 4.0, 1.5)))


def gauss_sql(src: str, dst: str, sigma: float) -> str:
    k = neighborhood.gaussian_kernel(sigma)
    r = (len(k) - 1) // 2
    pick = lambda t: "(" + "+".join(f"{kv!r}e0*(max(q.v) FILTER (k={i - r}))".replace("e0*", "*", 1) for i, kv in enumerate(k)) + ")"
    return (f"{dst}0 AS (SELECT image_id, frame, w, h, x, y, {K.lum()}/255e0 AS v FROM {src}), "
            + axis_sql(f"{dst}0", f"{dst}1", "row", r, {"v": pick(0)}) + ", " + axis_sql(f"{dst}1", dst, "column", r, {"v": pick(0)}))


query("W9_gaussian_heights", K.sql(f"SELECT image_id, frame, x, y, {srnd('v')} AS height FROM gh",
                                   PX, gauss_sql("px", "gh", 0.8).replace("*(max", "::DOUBLE*(max")))(
    lambda s, sf: neighborhood.gaussian_heights(fx.px_embed(s, sf), 0.8).select(*OUT[:4], rnd("height").alias("height")))
_SN = 0.6 * neighborhood.RELIEF_SCALE
on_px("W10_smooth_normal_map", lambda p: neighborhood.smooth_normal_map(p, 1.5, 0.6, neighborhood.smoothing_radius(8, 0.2)), K.sql(
    f"SELECT {K.OUT} FROM nm", PX, "s0 AS (SELECT image_id, frame, w, h, x, y, 299*r+587*g+114*b AS v FROM px)",
    axis_sql("s0", "s1", "row", 2, {"v": "sum(q.v)"}), axis_sql("s1", "s2", "column", 2, {"v": "sum(q.v)"}),
    "s3 AS (SELECT * EXCLUDE (v), v::BIGINT AS vv FROM s2)", grad_sql("s3", "gd", "vv"),
    normal_sql("gd", "nm", f"-(dx::DOUBLE/{255000.0 * 25!r}e0)*({_SN!r}e0*7/4e0)", f"(dy::DOUBLE/{255000.0 * 25!r}e0)*({_SN!r}e0*7/(4*{1 / 1.5!r}e0))")))


def gloss_sql(art: str, gloss: str, height: str | None, dst: str, az=135.0, el=45.0, shine=32.0, inten=1.0, matte=0.0, hs=2.0) -> str:
    import math
    e, a = math.radians(el), math.radians(az)
    hv = (math.cos(e) * math.cos(a), math.cos(e) * math.sin(a), math.sin(e) + 1)
    n = math.sqrt(sum(v * v for v in hv))
    hx, hy, hz = (f"({v / n!r})::DOUBLE" for v in hv)
    if height:
        pre = grad_sql(height, f"{dst}g") + (
            f", {dst}n AS (SELECT *, sqrt(nx*nx+ny*ny+1e0) AS ln FROM (SELECT *, -(dx*{hs}e0) AS nx, -(dy*{hs}e0) AS ny FROM {dst}g)), "
            f"{dst}d AS (SELECT image_id, frame, x, y, greatest(0e0, nx/ln*{hx}+ny/ln*{hy}+1e0/ln*{hz}) AS dt FROM {dst}n), ")
        j = f"LEFT JOIN {dst}d USING (image_id, frame, x, y)"
    else:
        pre, j = "", ""
    dt = f"coalesce(dt, greatest(0e0, {hz}))" if height else f"greatest(0e0, {hz})"
    gv = f"coalesce({K.lum('q.')}/255e0, 0e0)"
    base = lambda c: f"({c}*mf)"
    return (pre + f"{dst}p AS (SELECT image_id, frame, p.w, p.h, x, y, p.r, p.g, p.b, p.a, {K.clamp01(f'pow({dt}, {shine}e0)*{inten}e0*{gv}')} AS sw, "
            f"1e0-{matte}e0*(1e0-{gv}) AS mf FROM {art} p LEFT JOIN {gloss} q USING (image_id, frame, x, y) {j}), "
            f"{dst} AS (SELECT image_id, frame, w, h, x, y, {', '.join(f'{K.u8(f'{base(c)}+(255e0-{base(c)})*sw')} AS {c}' for c in 'rgb')}, a FROM {dst}p)")


query("W11_gloss_preview", K.sql(f"SELECT {K.OUT} FROM gp", PX, PXB, gloss_sql("px", "pxb", "pxb", "gp", 120.0, 40.0, 8.0, 1.3, 0.4, 3.0)))(
    lambda s, sf: neighborhood.gloss_preview(fx.px_embed(s, sf), fx.px_embed_b(s, sf), fx.px_embed_b(s, sf), 120.0, 40.0, 8.0, 1.3, 0.4, 3.0,
                                             same_size=True).select(*OUT))
query("W11_gloss_preview_flat", K.sql(f"SELECT {K.OUT} FROM gp", PX, PXB, gloss_sql("px", "pxb", None, "gp")))(
    lambda s, sf: neighborhood.gloss_preview(fx.px_embed(s, sf), fx.px_embed_b(s, sf), same_size=True).select(*OUT))
_DST = ("ds AS (SELECT p.image_id, p.frame, p.w, p.h, p.x, p.y, p.r, p.g, p.b, p.a, min(CASE WHEN q.a > {t} THEN greatest(abs(p.x-q.x), abs(p.y-q.y)) "
        "- least(abs(p.x-q.x), abs(p.y-q.y)) + sqrt(2e0)*least(abs(p.x-q.x), abs(p.y-q.y)) END) AS dist FROM px p JOIN px q "
        "ON q.image_id=p.image_id AND q.frame=p.frame GROUP BY ALL)")
query("W13_distance_to_opaque", K.sql(
    f"SELECT image_id, frame, x, y, CASE WHEN dist <= 4 THEN {srnd('dist')} END AS dist FROM ds", PX, _DST.format(t=245)))(
    lambda s, sf: neighborhood.distance_to_opaque(fx.px_embed(s, sf), 245, 4).select(*OUT[:4], rnd("dist").alias("dist")))
_OC = (250, 10, 90, 200)


def _outline_sql() -> str:
    under = [f"CASE WHEN p.a <= 245 AND p.dist <= 2 THEN {v} ELSE 0 END AS {c}" for v, c in zip(_OC, "rgba")]
    over = [s.rsplit(" AS ", 1)[0] for s in _split_top(over_sql("p", "q"))]
    return K.sql("SELECT p.image_id, p.frame, p.x, p.y, " + ", ".join(
        f"CASE WHEN p.a > 0 THEN {o} ELSE q.{c} END AS {c}" for o, c in zip(over, "rgba"))
        + " FROM ds p JOIN un q USING (image_id, frame, x, y)", PX, _DST.format(t=245),
        f"un AS (SELECT image_id, frame, x, y, {', '.join(under)} FROM ds p)")


on_px("W12_outline", lambda p: neighborhood.outline(p, 2, _OC, 245), _outline_sql())

# ---- R: geometry ---------------------------------------------------------------------------
on_px("R1_crop", lambda p: regrid.crop(p, -1, 3, 6, 90), K.sql(
    "SELECT image_id, frame, 5 AS w, 5 AS h, x, y-3 AS y, r, g, b, a FROM px WHERE x < 5 AND y >= 3", PX), OUTS)
on_px("R1_crop_outside", lambda p: regrid.crop(p, 9, 3, 6, 90), K.sql(
    "SELECT DISTINCT image_id, frame, 1 AS w, 1 AS h, 0 AS x, 0 AS y, 0 AS r, 0 AS g, 0 AS b, 0 AS a FROM px", PX), OUTS)
on_px("R2_pad", lambda p: regrid.pad(p, 2), K.sql(
    "SELECT i.image_id, i.frame, 12 AS w, 12 AS h, xo::INTEGER AS x, yo::INTEGER AS y, " + ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in "rgba")
    + " FROM (SELECT DISTINCT image_id, frame FROM px) i CROSS JOIN range(12) t(xo) CROSS JOIN range(12) u(yo) LEFT JOIN px p "
    "ON p.image_id=i.image_id AND p.frame=i.frame AND p.x=xo-2 AND p.y=yo-2", PX), OUTS)
for _n, _op, _x, _y in (("R3_rotate90", "rotate90", "h-1-y", "x"), ("R3_rotate180", "rotate180", "w-1-x", "h-1-y"),
                        ("R3_rotate270", "rotate270", "y", "w-1-x"), ("R4_flip_h", "flip_h", "w-1-x", "y"), ("R4_flip_v", "flip_v", "x", "h-1-y")):
    _wh = "h AS w, w AS h" if _op in ("rotate90", "rotate270") else "w, h"
    query(_n, K.sql(f"SELECT image_id, frame, {_wh}, {_x} AS x, {_y} AS y, r, g, b, a FROM nz", IM, GR, noise_sql("gr", 2.0, "image_id")))(
        lambda s, sf, op=_op: regrid.transform(gen.value_noise(fx.img_part(s, sf), 2.0, "image_id"), op).select(*OUTS))


def rotate_sql(src: str, dst: str, deg: float) -> str:
    import math
    r = deg * math.pi / 180
    c, s = f"({math.cos(r)!r})::DOUBLE", f"({math.sin(r)!r})::DOUBLE"
    ext = lambda a, b: f"greatest(1, CAST(ceil(greatest(0e0, sw*{a}, sh*{b}, sw*{a}+sh*{b}) - least(0e0, sw*{a}, sh*{b}, sw*{a}+sh*{b})) AS INTEGER))"
    key = lambda t, x, y: f"LEFT JOIN {src} {t} ON ok AND {t}.image_id=o.image_id AND {t}.frame=o.frame AND {t}.x={x} AND {t}.y={y}"
    mixed = lambda ch: f"CASE WHEN ok THEN {K.u8(f'(a.{ch}*(1e0-wx)+b.{ch}*wx)*(1e0-wy)+(c.{ch}*(1e0-wx)+d.{ch}*wx)*wy')} ELSE 0 END AS {ch}"
    return (
        f"{dst}i AS (SELECT DISTINCT image_id, frame, w AS sw, h AS sh FROM {src}), "
        f"{dst}j AS (SELECT *, {ext(c, f'(-{s})')} AS nw, {ext(s, c)} AS nh FROM {dst}i), "
        f"{dst}k AS (SELECT *, xo::INTEGER AS x, yo::INTEGER AS y, xo+0.5e0-nw/2e0 AS dx, yo+0.5e0-nh/2e0 AS dy FROM {dst}j, range(nw) u(xo), range(nh) v(yo)), "
        f"{dst}l AS (SELECT *, dx*{c}+dy*{s}+sw/2e0-0.5e0 AS sx, -dx*{s}+dy*{c}+sh/2e0-0.5e0 AS sy FROM {dst}k), "
        f"{dst}o AS (SELECT *, sx>=0 AND sy>=0 AND sx<=sw-1 AND sy<=sh-1 AS ok, CAST(floor(sx) AS INTEGER) AS x0, CAST(floor(sy) AS INTEGER) AS y0, "
        f"sx-floor(sx) AS wx, sy-floor(sy) AS wy FROM {dst}l), "
        f"{dst} AS (SELECT o.image_id, o.frame, nw AS w, nh AS h, o.x, o.y, {', '.join(mixed(ch) for ch in 'rgba')} FROM {dst}o o "
        f"{key('a', 'x0', 'y0')} {key('b', 'least(sw-1,x0+1)', 'y0')} {key('c', 'x0', 'least(sh-1,y0+1)')} {key('d', 'least(sw-1,x0+1)', 'least(sh-1,y0+1)')})"
    )


for _deg in (30.0, 200.0):
    query(f"R5_rotate_{int(_deg)}", K.sql(f"SELECT {K.OUTS} FROM ro", IM, GR, noise_sql("gr", 2.0, "image_id"), rotate_sql("nz", "ro", _deg)))(
        lambda s, sf, deg=_deg: regrid.rotate(gen.value_noise(fx.img_part(s, sf), 2.0, "image_id"), deg).select(*OUTS))
on_px("R6_seamless_tile", lambda p: regrid.seamless_tile(p, 0.6), K.sql(
    "SELECT p.image_id, p.frame, p.x, p.y, " + ", ".join(f"{K.u8(f'p.{c}*(1e0-k)+q.{c}*k')} AS {c}" for c in "rgba")
    + " FROM (SELECT *, greatest(0e0, 1e0-least(x,7-x)/2.4e0, 1e0-least(y,7-y)/2.4e0) AS k FROM px) p JOIN px q ON q.image_id=p.image_id "
    "AND q.frame=p.frame AND q.x=(p.x+4)%8 AND q.y=(p.y+4)%8", PX))


def nearest_sql(src: str, dst: str, tw: str, th: str, keep: str = "") -> str:
    return (f"{dst}i AS (SELECT DISTINCT image_id, frame, w AS sw, h AS sh{keep}, {tw} AS tw, {th} AS th FROM {src}), "
            f"{dst} AS (SELECT i.image_id, i.frame, tw::INTEGER AS w, th::INTEGER AS h, xo::INTEGER AS x, yo::INTEGER AS y{keep.replace(',', ', i.')}, p.r, p.g, p.b, p.a "
            f"FROM (SELECT * FROM {dst}i, range(tw) u(xo), range(th) v(yo)) i JOIN {src} p ON p.image_id=i.image_id AND p.frame=i.frame AND "
            f"p.x=least(sw-1, CAST(floor(xo/tw::DOUBLE*sw) AS INTEGER)) AND p.y=least(sh-1, CAST(floor(yo/th::DOUBLE*sh) AS INTEGER)))")


_NZ = (IM, GR, noise_sql("gr", 2.0, "image_id"))


def noise_px(s, sf):
    return gen.value_noise(fx.img_part(s, sf), 2.0, "image_id")


query("R7_pixelate", K.sql(
    f"SELECT {K.OUTS} FROM n2", *_NZ, "nk AS (SELECT *, w AS ow, h AS oh FROM nz)",
    nearest_sql("nk", "n1", "ceil(w/3e0)::INTEGER", "ceil(h/3e0)::INTEGER", ",ow,oh"), nearest_sql("n1", "n2", "ow", "oh")))(
    lambda s, sf: regrid.pixelate(noise_px(s, sf), 3).select(*OUTS))
query("R8_resize_nearest", K.sql(f"SELECT {K.OUTS} FROM n1", *_NZ, nearest_sql("nz", "n1", "13", "7")))(
    lambda s, sf: regrid.resize_nearest(noise_px(s, sf), 13, 7).select(*OUTS))
query("R9_resize_bilinear", K.sql(f"SELECT {K.OUTS} FROM b1", *_NZ, bilinear_sql("nz", "b1", "13", "9")))(
    lambda s, sf: regrid.resize_bilinear(noise_px(s, sf), 13, 9).select(*OUTS))
query("R9_resize_bilinear_line", K.sql(f"SELECT {K.OUTS} FROM b1", *_NZ, bilinear_sql("nz", "b1", "1", "20")))(
    lambda s, sf: regrid.resize_bilinear(noise_px(s, sf), 1, 20).select(*OUTS))
query("R10_resize_scale", K.sql(f"SELECT {K.OUTS} FROM b1", *_NZ, bilinear_sql("nz", "b1", K.jsr("w*1.7e0"), K.jsr("h*1.7e0"))))(
    lambda s, sf: regrid.resize(noise_px(s, sf), "scale", 1.7).select(*OUTS))
query("R10_resize_exact_nearest", K.sql(f"SELECT {K.OUTS} FROM n1", *_NZ, nearest_sql("nz", "n1", "5", "11")))(
    lambda s, sf: regrid.resize(noise_px(s, sf), "dimensions", width=5, height=11, method="nearest").select(*OUTS))
_LONG = "CASE WHEN greatest(w,h) <= 9 THEN {v} ELSE greatest(1, " + K.jsr("{v}*(9e0/greatest(w,h))") + ") END"
query("R11_downscale_to_max", K.sql(f"SELECT {K.OUTS} FROM n1", *_NZ, nearest_sql("nz", "n1", _LONG.format(v="w"), _LONG.format(v="h"))))(
    lambda s, sf: regrid.downscale_to_max(noise_px(s, sf), 9).select(*OUTS))


def sample_sql(points: str, src: str, dst: str, join: str, cols: str) -> str:
    """CTE dst: points(u, v, …) sampled bilinearly from src with clamped half-pixel centres."""
    key = lambda t, x, y: f"JOIN {src} {t} ON {join.format(t=t)} AND {t}.x={x} AND {t}.y={y}"
    mixed = lambda c: K.u8(f"(a.{c}*(1e0-wx)+b.{c}*wx)*(1e0-wy)+(c.{c}*(1e0-wx)+d.{c}*wx)*wy")
    return (f"{dst}f AS (SELECT *, greatest(0e0, least(sw-1e0, u*sw-0.5e0)) AS fx, greatest(0e0, least(sh-1e0, v*sh-0.5e0)) AS fy FROM {points}), "
            f"{dst}o AS (SELECT *, CAST(floor(fx) AS INTEGER) AS x0, CAST(floor(fy) AS INTEGER) AS y0, fx-floor(fx) AS wx, fy-floor(fy) AS wy FROM {dst}f), "
            f"{dst} AS (SELECT {cols}, {', '.join(f'{mixed(c)} AS {c}' for c in 'rgba')} FROM {dst}o o {key('a', 'x0', 'y0')} {key('b', 'least(sw-1,x0+1)', 'y0')} "
            f"{key('c', 'x0', 'least(sh-1,y0+1)')} {key('d', 'least(sw-1,x0+1)', 'least(sh-1,y0+1)')})")


# three sample points per line item, some outside [0, 1]
_PTS = ("pts AS (SELECT l_partkey AS image_id, 0 AS frame, rowid_ AS pid, 16 AS sw, 16 AS sh, u, v FROM (SELECT l_partkey, "
        "l_orderkey*10+l_linenumber AS rowid_, l_quantity/40e0 - 0.1e0 AS u, l_tax*10e0+l_discount AS v FROM lineitem) GROUP BY ALL)")
query("R12_sample_at", K.sql("SELECT image_id, pid, u, v, r, g, b, a FROM sm", PART, _PTS, sample_sql(
    "pts", "pp", "sm", "{t}.image_id=o.image_id AND {t}.frame=o.frame", "o.image_id, o.pid, o.u, o.v")))(
    lambda s, sf: regrid.sample_at(
        fx.table(s, sf, "lineitem").select(
            F.col("l_partkey").alias("image_id"), F.lit(0).alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pid"),
            F.lit(16).alias("sw"), F.lit(16).alias("sh"), (F.col("l_quantity") / 40.0 - 0.1).alias("u"),
            (F.col("l_tax") * 10.0 + F.col("l_discount")).alias("v")).distinct(),
        fx.px_part(s, sf)).select("image_id", "pid", "u", "v", "r", "g", "b", "a"))
