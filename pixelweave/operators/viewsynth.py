"""View synthesis: depth-shifted views of one picture as set logic per scanline, and turned picture planes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import d, jsround, luminance, u8
from ..schema import IMG, PIXEL, POS, RGBA, SIZE, cut, images_of, large
from ..sources.generators import grid
from .color import grey
from .neighborhood import box_blur
from .regrid import resize_bilinear, sample_at
from .sweep import MAX_POPOUT, cover_scale, eye_offset, plane_facing, plane_hit

MIN_VIEW_PX = 16  # fixed value: smallest working width


def working_size(p: DataFrame, width_px: int = 0) -> DataFrame:
    """Adds ``tw``, ``th``: the working raster of each picture."""
    want = F.lit(int(width_px)) if width_px > 0 else F.col("w")
    tw = F.greatest(F.lit(MIN_VIEW_PX), want)
    return p.withColumn("tw", tw).withColumn("th", F.greatest(F.lit(1), jsround(d("h") * F.col("tw") / F.greatest(F.col("w"), F.lit(1)))))


def prepare_depth(depth: DataFrame, blur_px: float = 0, invert: bool = False, tw=None, th=None) -> DataFrame:
    """Resize to the picture, blur, luminance, optional inversion; white is near."""
    t = depth if tw is None else resize_bilinear(depth, tw, th)
    r = max(0, math.floor(blur_px + 0.5))
    t = box_blur(t, r) if r > 0 else t
    lum = d(255) - luminance() if invert else luminance()
    return grey(t, u8(lum)).select(*PIXEL)


def shift_of(level: Column, eye: Column, w: Column, width_mm: float, distance: float, depth_mm: float, setback: float) -> Column:
    """Sideways shift in pixels of a depth level (255 near) seen from an eye, in single precision."""
    dist = max(1e-6, distance)
    near = max(-MAX_POPOUT * dist, setback)
    z = -((d(1) - d(level) / 255.0) * max(0.0, depth_mm) + near)
    return (-eye * z / (d(dist) - z) * (d(w) / max(1e-6, width_mm))).cast("float")


def shift_lut(eyes: DataFrame, width_mm=100.0, distance=400.0, depth_mm=5.0, setback=0.0) -> DataFrame:
    """eyes(…, ex, w) x 256 depth levels -> shift in pixels."""
    t = eyes.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return t.withColumn("shift", shift_of(F.col("level"), F.col("ex"), F.col("w"), width_mm, distance, depth_mm, setback))


LINE = ["image_id", "view", "y"]


def _line() -> Window:
    return Window.partitionBy(*LINE).orderBy("x")


def moved(p: DataFrame, depth: DataFrame, eyes: list[float], **lens) -> DataFrame:
    """(image_id, view, w, h, y, x, key, xs, rgba): where every pixel goes for every eye; colours packed in one number.

    The steps of a warp each read this table, so picture and depth are joined once and written, before they are fanned out to the eyes.
    """
    pack = F.shiftleft(d("r").cast("long"), 24) + F.shiftleft(F.col("g").cast("long"), 16) + F.shiftleft(F.col("b").cast("long"), 8) + F.col("a")
    t = p.select(*IMG, *SIZE, *POS, pack.alias("rgba")).join(large(depth.select(*IMG, *POS, F.col("r").alias("key"))), [*IMG, *POS])
    table = F.array(*[F.struct(F.lit(i).alias("view"), d(e).alias("ex")) for i, e in enumerate(eyes)])
    t = cut(t).withColumn("_e", F.explode(table)).select("image_id", F.col("_e.view").alias("view"), *SIZE, "y", "x", "key", "rgba", F.col("_e.ex").alias("ex"))
    shift = shift_of(F.col("key"), F.col("ex"), F.col("w"), **lens)
    return t.withColumn("xs", (F.col("x").cast("double") + shift.cast("double")).cast("float")).drop("ex")


def warp_forward(m: DataFrame) -> DataFrame:
    """Candidates (line, px, key, pass, ord, src, rgba) of pixels landing on a column."""
    t = m.withColumn("px", jsround(d("xs"))).filter("px >= 0 and px < w")
    return t.select(*LINE, *SIZE, "px", "key", F.lit(0).alias("pass"), F.col("x").alias("ord"), F.col("x").alias("src"), "rgba")


def warp_gap_fill(m: DataFrame) -> DataFrame:
    """Candidates that close the span between neighbours which moved apart, from the farther one."""
    w = _line()
    t = m.withColumns({f"n_{v}": F.lead(v).over(w) for v in ("xs", "key", "rgba")})
    t = t.filter(d("n_xs") - d("xs") > 1)
    own = F.col("key") <= F.col("n_key")
    lo, hi = F.greatest(F.lit(0), F.ceil(d("xs")).cast("int")), F.least(F.col("w") - 1, F.floor(d("n_xs")).cast("int"))
    t = t.withColumns({"_lo": lo, "_hi": hi}).filter("_lo <= _hi").withColumn("px", F.explode(F.sequence("_lo", "_hi")))
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return t.select(*LINE, *SIZE, "px", pick("key", "n_key").alias("key"), F.lit(1).alias("pass"), F.col("x").alias("ord"),
                    F.when(own, F.col("x")).otherwise(F.col("x") + 1).alias("src"), pick("rgba", "n_rgba").alias("rgba"))


def warp_candidates(m: DataFrame) -> DataFrame:
    """What ``warp_forward`` and ``warp_gap_fill`` make, in one pass over the lines: it stays dealt out by line."""
    w = _line()
    t = m.withColumns({f"n_{v}": F.lead(v).over(w) for v in ("xs", "key", "rgba")})
    at = jsround(d("xs")).cast("int")
    lo, hi = F.greatest(F.lit(0), F.ceil(d("xs")).cast("int")), F.least(F.col("w") - 1, F.floor(d("n_xs")).cast("int"))
    t = t.withColumns({"_at": at, "_lo": lo, "_hi": hi})
    none = F.array().cast("array<int>")
    # a column and in its lowest bit the pass
    lands = F.when((F.col("_at") >= 0) & (F.col("_at") < F.col("w")), F.array(F.col("_at") * 2)).otherwise(none)
    gap = (d("n_xs") - d("xs") > 1) & (F.col("_lo") <= F.col("_hi"))
    fills = F.when(gap, F.sequence(F.col("_lo") * 2 + 1, F.col("_hi") * 2 + 1, F.lit(2))).otherwise(none)
    t = t.withColumn("_c", F.explode(F.concat(lands, fills))).withColumn("pass", F.col("_c").bitwiseAND(F.lit(1)))
    own = (F.col("pass") == 0) | (F.col("key") <= F.col("n_key"))
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    return t.select(*LINE, *SIZE, F.shiftright("_c", 1).alias("px"), pick("key", "n_key").alias("key"), "pass", F.col("x").alias("ord"),
                    F.when(own, F.col("x")).otherwise(F.col("x") + 1).alias("src"), pick("rgba", "n_rgba").alias("rgba"))


def settle(candidates: DataFrame) -> DataFrame:
    """(line, px, src, rgba, drawn): nearest depth wins; then the forward pass, then the earliest."""
    best = F.max(F.struct("key", (-F.col("pass")).alias("p"), (-F.col("ord")).alias("o"), "src", "rgba", *SIZE)).alias("m")
    t = candidates.groupBy(*LINE, "px").agg(best)
    return t.select(*LINE, F.col("m.w").alias("w"), F.col("m.h").alias("h"), "px", F.col("m.src").alias("src"), F.col("m.rgba").alias("rgba"),
                    (F.col("m.p") == 0).alias("drawn"))


def cliffs(m: DataFrame, jump: float, window: int) -> DataFrame:
    """Islands of steep stretch per line: (line, start, end, src, rgba, lo, hi), colour from the far plateau."""
    w = _line()
    frame = w.rowsBetween(-window, window)
    wide = d(F.last("xs").over(frame)) - d(F.first("xs").over(frame)) - (F.last("x").over(frame) - F.first("x").over(frame))
    t = m.withColumn("_wide", wide).filter(F.col("_wide") > jump)
    t = t.withColumn("_g", F.col("x") - F.row_number().over(w))
    ends = [f(F.struct("x", "key", "xs", "rgba")).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))]
    t = t.groupBy(*LINE, *SIZE, "_g").agg(*ends)
    own = F.col("a.key") <= F.col("b.key")
    pick = lambda v: F.when(own, F.col(f"a.{v}")).otherwise(F.col(f"b.{v}"))
    return t.select(*LINE, *SIZE, F.col("a.x").alias("start"), F.col("b.x").alias("end"), pick("x").alias("src"), pick("rgba").alias("rgba"),
                    F.greatest(F.lit(0), F.ceil(d("a.xs")).cast("int")).alias("lo"), F.least(F.col("w") - 1, F.floor(d("b.xs")).cast("int")).alias("hi"))


def warp_cliffs(landed: DataFrame, islands: DataFrame) -> DataFrame:
    """Repaint what a cliff smeared: empty columns and columns fed from inside it.

    Islands are disjoint in source columns, so of all islands over a column the earliest whose
    condition holds is the one a sequential pass would apply.
    """
    cover = islands.filter("lo <= hi").withColumn("px", F.explode(F.sequence("lo", "hi")))
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    own = landed.select(*LINE, "px", *SIZE, "src", "rgba", "drawn", *none("int", "start", "end", "_src"), *none("long", "_rgba"))
    over = cover.select(*LINE, "px", *SIZE, *none("int", "src"), *none("long", "rgba"), *none("boolean", "drawn"), "start", "end", F.col("src").alias("_src"), F.col("rgba").alias("_rgba"))
    # both stay dealt out by line: no join, which would deal them by column
    t = own.union(over).withColumn("_at", F.max("src").over(Window.partitionBy(*LINE, "px")))
    hit = F.col("start").isNotNull() & (F.col("_at").isNull() | ((F.col("_at") > F.col("start")) & (F.col("_at") < F.col("end"))))
    paint = F.min(F.when(hit, F.struct("start", F.col("_src").alias("src"), F.col("_rgba").alias("rgba")))).alias("p")
    old = F.max(F.struct("src", "rgba", "drawn")).alias("o")
    t = t.groupBy(*LINE, "px").agg(paint, old, *[F.max(v).alias(v) for v in SIZE])
    keep = F.col("p").isNull()
    t = t.select(*LINE, *SIZE, "px", F.when(keep, F.col("o.src")).otherwise(F.col("p.src")).alias("src"),
                 F.when(keep, F.col("o.rgba")).otherwise(F.col("p.rgba")).alias("rgba"), (keep & F.col("o.drawn")).alias("drawn"))
    return t.filter("src is not null")


def warp_margins(landed: DataFrame, lines: DataFrame) -> DataFrame:
    """All columns of every line: margins hold the first / last landed pixel, inner holes stay empty.

    ``lines`` is one row per line; it adds a marker before column 0 so that a line on which nothing
    landed still yields its (empty) columns.
    """
    mark = lines.select(*LINE, *SIZE, F.lit(-1).alias("px"), F.lit(None).cast("int").alias("src"), F.lit(None).cast("long").alias("rgba"),
                        F.lit(None).cast("boolean").alias("drawn"))
    w = Window.partitionBy(*LINE).orderBy("px")
    t = landed.select(mark.columns).union(mark.repartition(*LINE))
    t = t.withColumns({"_before": F.lag("px").over(w), "_after": F.lead("px").over(w)})
    empty = (F.col("px") == -1) & F.col("_after").isNull()
    lo = F.when(empty | (F.col("_before") == -1), F.lit(0)).otherwise(F.col("px"))
    hi = F.when(F.col("_after").isNull(), F.col("w") - 1).otherwise(F.col("_after") - 1)
    t = t.filter(empty | (F.col("px") >= 0)).withColumns({"_lo": lo, "_hi": hi}).withColumn("x", F.explode(F.sequence("_lo", "_hi")))
    real = F.col("x") == F.col("px")
    hole = (F.col("x") > F.col("px")) & F.col("_after").isNotNull() | F.col("rgba").isNull()
    v = F.when(hole, F.lit(0).cast("long")).otherwise(F.col("rgba"))
    byte = lambda k: F.shiftright(v, k).bitwiseAND(F.lit(255).cast("long")).cast("int")
    filled = F.when(F.col("rgba").isNotNull(), ~(real & F.coalesce("drawn", F.lit(False)))).otherwise(F.lit(False))
    return t.select("image_id", F.col("view").alias("frame"), *SIZE, "x", "y", byte(24).alias("r"), byte(16).alias("g"), byte(8).alias("b"),
                    byte(0).alias("a"), filled.alias("filled"))


def depth_views(p: DataFrame, depth: DataFrame, views: int = 12, cone_deg: float = 20.0, width_mm=100.0, distance=400.0, depth_mm=5.0,
                setback=0.0, blur_px=1.0, invert=False, edge_jump=1.5, width_px: int = 0, prepared: bool = False) -> DataFrame:
    """One frame per eye from a picture and its depth map, plus ``filled`` (see ``stats.fill_report``).

    Picture and depth are brought to the working size, and the depth is blurred and reduced to
    levels, unless both come ``prepared``.
    """
    if not prepared:
        sized = working_size(p, width_px)
        to = images_of(sized.withColumns({"w": F.col("tw"), "h": F.col("th")})).withColumnsRenamed({"w": "tw", "h": "th"})
        p = resize_bilinear(sized, F.col("tw"), F.col("th"))
        depth = prepare_depth(depth.join(to, IMG), blur_px, invert, F.col("tw"), F.col("th"))
    n = max(1, math.floor(views + 0.5))
    eyes = [eye_offset(i, n, cone_deg, distance, math) for i in range(n)]
    m = moved(p, depth, eyes, width_mm=width_mm, distance=distance, depth_mm=depth_mm, setback=setback)
    landed = settle(warp_candidates(m))
    islands = cliffs(m, max(0.0, edge_jump), max(2, math.floor(blur_px + 0.5) + 2))
    return warp_margins(warp_cliffs(landed, islands), m.filter("x = 0").select(*LINE, *SIZE))


def facing_views(p: DataFrame, cols: int = 5, rows: int = 0, cone_deg: float = 30.0, width_mm=100.0, height_mm=100.0, distance=400.0,
                 width_px: int = 64, follow: float = 1.0, zoom: float = 1.0) -> DataFrame:
    """Views of a flat picture turned towards each eye; rows = 0 is a run of ``cols`` eyes."""
    spark = p.sparkSession
    one = spark.createDataFrame([(0, cols, rows, cone_deg, distance, width_mm, height_mm, follow)],
                                "k int, cols int, rows int, cone_deg double, distance_mm double, width_mm double, height_mm double, follow double")
    scale = cover_scale(one, ["k"]).first()["scale"] * max(1.0, zoom)  # one settings row
    wm, hm, dist = max(0.01, width_mm), max(0.01, height_mm), max(1.0, distance)
    f = min(1.0, max(0.0, follow))
    w = max(8, math.floor(width_px + 0.5))
    h = max(1, math.floor(w * hm / wm + 0.5))
    wanted = max(8, math.ceil(w * scale))
    # reduce the source once, before it is fanned out to all eyes
    big = F.col("w") > wanted
    src = resize_bilinear(p, F.when(big, F.lit(wanted)).otherwise(F.col("w")),
                          F.when(big, F.greatest(F.lit(1), jsround(d("h") * wanted / F.col("w")))).otherwise(F.col("h")))
    n = max(1, cols) * max(1, rows)
    eyes = []
    for i in range(n):
        ex = eye_offset(i % cols, cols, cone_deg, distance, math)
        ey = -eye_offset(i // cols, rows, cone_deg, distance, math) if rows > 0 else 0.0
        pl = plane_facing(ex, ey, dist, f, math)
        eyes.append(F.struct(F.lit(i).alias("view"), d(ex).alias("ex"), d(ey).alias("ey"),
                             *[d(pl[k][j]).alias(f"{k}{j}") for k in "nuv" for j in range(3)]))
    im = src.filter("x = 0 and y = 0").select("image_id", "frame", F.col("w").alias("sw"), F.col("h").alias("sh"))
    g = grid(im.withColumns({"w": F.lit(w), "h": F.lit(h)}))
    g = g.withColumn("_e", F.explode(F.array(*eyes)))
    plane = {k: tuple(F.col(f"_e.{k}{j}") for j in range(3)) for k in "nuv"}
    sx, sy = (d("x") + 0.5) * (wm / w) - wm / 2, d(hm / 2) - (d("y") + 0.5) * (hm / h)
    a, b = plane_hit(plane, F.col("_e.ex"), F.col("_e.ey"), d(dist), sx, sy)
    aspect = F.greatest(d(1e-6), d("sw") / F.greatest(d(1), d("sh")))
    wide = aspect > wm / hm
    fx, fy = F.when(wide, d(wm / hm) / aspect).otherwise(d(1)), F.when(wide, d(1)).otherwise(aspect / (wm / hm))
    pw, ph = scale * wm / 2, scale * hm / 2
    g = g.withColumns({"u": a * 0.5 * fx / pw + 0.5, "v": d(0.5) - b * 0.5 * fy / ph, "view": F.col("_e.view")})
    out = sample_at(g.drop("_e"), src)
    return out.select("image_id", F.col("view").alias("frame"), "w", "h", "x", "y", *RGBA)
