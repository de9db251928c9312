"""Geometry: crops, flips, resizes, rotation, sampling.

Resampling is written as a SCATTER, not a gather join: the output positions a source pixel feeds
form a contiguous range that column arithmetic gives exactly, so nearest resizing is one narrow
``explode`` without any shuffle, and bilinear needs only the shuffle that brings a pixel's right
and lower neighbours to it (``with_quad``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import c, clamp01, d, jsround, u8
from ..schema import IMG, PIXEL, POS, RGBA, SIZE, images_of, large, pack_rgba, unpack_rgba
from .bands import by_column, by_row, in_bands, out_of_bands


def crop(p: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Intersection with the image; without overlap one transparent pixel is left."""
    rx, ry = math.floor(x), math.floor(y)
    x0, y0 = max(0, rx), max(0, ry)
    x1 = F.least(F.col("w"), F.lit(rx + max(0, math.floor(w))))
    y1 = F.least(F.col("h"), F.lit(ry + max(0, math.floor(h))))
    ow, oh = x1 - x0, y1 - y0
    empty = (ow <= 0) | (oh <= 0)
    inside = (F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)
    t = p.filter(inside | (empty & (F.col("x") == 0) & (F.col("y") == 0)))
    return t.select(
        *IMG,
        F.when(empty, F.lit(1)).otherwise(ow).alias("w"),
        F.when(empty, F.lit(1)).otherwise(oh).alias("h"),
        F.when(empty, F.lit(0)).otherwise(F.col("x") - x0).alias("x"),
        F.when(empty, F.lit(0)).otherwise(F.col("y") - y0).alias("y"),
        *[F.when(empty, F.lit(0)).otherwise(F.col(ch)).alias(ch) for ch in RGBA],
    )


def pad(p: DataFrame, amount: float) -> DataFrame:
    """Transparent border. Border pixels emit their own padding, so there is no grid and no join."""
    a = max(0, math.floor(amount))
    if a == 0:
        return p

    def cells(pos: str, n: str) -> Column:
        at = F.col(pos) + a
        lo = F.when(F.col(pos) == 0, F.lit(0)).otherwise(at)
        hi = F.when(F.col(pos) == F.col(n) - 1, at + a).otherwise(at)
        return F.explode(F.sequence(lo, hi))

    t = p.withColumn("_nx", cells("x", "w")).withColumn("_ny", cells("y", "h"))
    own = (F.col("_nx") == F.col("x") + a) & (F.col("_ny") == F.col("y") + a)
    return t.select(
        *IMG, (F.col("w") + 2 * a).alias("w"), (F.col("h") + 2 * a).alias("h"), F.col("_nx").alias("x"),
        F.col("_ny").alias("y"), *[F.when(own, F.col(ch)).otherwise(F.lit(0)).alias(ch) for ch in RGBA],
    )


def transform(p: DataFrame, op: str) -> DataFrame:
    """Quarter turns and flips: key arithmetic only."""
    x, y, w, h = (F.col(v) for v in ("x", "y", "w", "h"))
    nx, ny, nw, nh = {
        "rotate90": (h - 1 - y, x, h, w),
        "rotate180": (w - 1 - x, h - 1 - y, w, h),
        "rotate270": (y, w - 1 - x, h, w),
        "flip_h": (w - 1 - x, y, w, h),
        "flip_v": (x, h - 1 - y, w, h),
    }[op]
    return p.select(*IMG, nw.alias("w"), nh.alias("h"), nx.alias("x"), ny.alias("y"), *RGBA)


def scatter(p: DataFrame, tw: Column, th: Column, kind: str) -> DataFrame:
    """Explode each source pixel to the output positions (_ox, _oy) whose top-left source it is.

    Along an axis those positions are a range.  Its ends are guessed by division and put right by
    one step with the exact index formula, so floating-point borders cannot lose or repeat a pixel.
    """
    p = p.withColumns({"_tw": tw.cast("int"), "_th": th.cast("int")})

    def span(df: DataFrame, pos: str, n: str, out: str, name: str) -> DataFrame:
        n_src, n_out = F.col(n), F.col(out)
        if kind == "nearest":
            index = lambda i: F.least(n_src - 1, F.floor(d(i) / d(n_out) * d(n_src)).cast("int"))
            per = d(n_out) / d(n_src)
        else:
            steps = F.greatest(n_out - 1, F.lit(1))
            index = lambda i: F.floor(d(i) * d(n_src - 1) / d(steps)).cast("int")
            per = d(steps) / F.greatest(d(n_src) - 1, d(1))
        t = df.withColumn("_per", per)
        t = t.withColumns({"_lo": F.ceil(F.col(pos) * F.col("_per")).cast("int"), "_hi": F.ceil((F.col(pos) + 1) * F.col("_per")).cast("int")})

        def first(g: str, s: Column) -> Column:
            g = F.col(g)
            exact = F.when((g > 0) & (index(g - 1) >= s), g - 1).when(index(g) >= s, g).otherwise(g + 1)
            return F.when(s <= 0, F.lit(0)).when(s >= n_src, n_out).otherwise(F.least(exact, n_out))

        t = t.withColumns({"_lo": first("_lo", F.col(pos)), "_hi": first("_hi", F.col(pos) + 1)})
        if kind != "nearest":  # a single output column reads the first source column only
            one = n_out == 1
            t = t.withColumns({"_lo": F.when(one & (F.col(pos) > 0), F.lit(1)).otherwise(F.col("_lo")), "_hi": F.when(one, F.lit(1)).otherwise(F.col("_hi"))})
        # an empty range turns into a null array, which explodes to nothing
        cells = F.when(F.col("_lo") < F.col("_hi"), F.sequence(F.col("_lo"), F.col("_hi") - 1))
        return t.withColumn(name, F.explode(cells)).drop("_lo", "_hi", "_per")

    t = span(p, "x", "w", "_tw", "_ox")
    return span(t, "y", "h", "_th", "_oy")


def resize_nearest(p: DataFrame, w, h, keys: list[str] = IMG) -> DataFrame:
    """Nearest-neighbour resize to numbers or per-image columns. Narrow: no shuffle."""
    t = scatter(p, c(w), c(h), "nearest")
    return t.select(*keys, F.col("_tw").alias("w"), F.col("_th").alias("h"), F.col("_ox").alias("x"),
                    F.col("_oy").alias("y"), *RGBA)


CORNERS = ("", "10", "01", "11")


def packed_quad(p: DataFrame) -> DataFrame:
    """Bring the right (10), lower (01) and diagonal (11) neighbours to every pixel, edges clamped; colours packed in ``_rgba``."""
    t = in_bands(p, 1, packed=True)
    row, col = by_row(), by_column()
    t = t.withColumn("_rgba10", F.coalesce(F.lead("_rgba").over(row), F.col("_rgba")))
    t = t.withColumns({f"_rgba{to}": F.coalesce(F.lead(f"_rgba{frm}").over(col), F.col(f"_rgba{frm}")) for frm, to in (("", "01"), ("10", "11"))})
    return out_of_bands(t, 1)


def with_quad(p: DataFrame) -> DataFrame:
    """``packed_quad`` with a column per channel and neighbour."""
    t = packed_quad(p)
    t = t.withColumns({f"{ch}{s}": e for s in CORNERS for ch, e in unpack_rgba(f"_rgba{s}").items()})
    return t.drop(*[f"_rgba{s}" for s in CORNERS])


def bilinear(ch: str, wx: Column, wy: Column) -> Column:
    top = d(ch) * (d(1) - wx) + d(f"{ch}10") * wx
    bot = d(f"{ch}01") * (d(1) - wx) + d(f"{ch}11") * wx
    return top * (d(1) - wy) + bot * wy


def resize_bilinear(p: DataFrame, w, h, keep: list[str] | None = None) -> DataFrame:
    """Corner-aligned bilinear resize; an image already of the target size is unchanged."""
    keep = keep or []
    q = with_quad(p.withColumns({"_rw": F.greatest(F.lit(1), F.floor(c(w)).cast("int")),
                                 "_rh": F.greatest(F.lit(1), F.floor(c(h)).cast("int"))}))
    t = scatter(q, F.col("_rw"), F.col("_rh"), "bilinear")

    def weight(o: str, n_src: str, n_out: str, s: str) -> Column:
        pos = F.when(F.col(n_out) > 1, d(o) * (d(n_src) - 1) / F.greatest(d(n_out) - 1, d(1))).otherwise(d(0))
        return pos - F.col(s)

    t = t.withColumns({"_wx": weight("_ox", "w", "_tw", "x"), "_wy": weight("_oy", "h", "_th", "y")})
    return t.select(
        *IMG, F.col("_tw").alias("w"), F.col("_th").alias("h"), F.col("_ox").alias("x"), F.col("_oy").alias("y"),
        *[u8(bilinear(ch, F.col("_wx"), F.col("_wy"))).alias(ch) for ch in RGBA], *keep,
    )


def resize(p: DataFrame, mode: str = "scale", scale: float = 1.0, width: float = 0, height: float = 0,
           method: str = "bilinear") -> DataFrame:
    """By a factor (keeps the aspect) or to an exact size."""
    if mode == "scale":
        s = max(0.01, scale)
        w, h = (F.greatest(F.lit(1), jsround(d(n) * s)) for n in SIZE)
    else:
        w, h = F.lit(int(max(1, width))), F.lit(int(max(1, height)))
    return resize_nearest(p, w, h) if method == "nearest" else resize_bilinear(p, w, h)


def downscale_to_max(p: DataFrame, n: int) -> DataFrame:
    """Longest side at most n, aspect kept, nearest; images that fit are unchanged."""
    if n <= 0:
        return p
    longest = F.greatest("w", "h")
    k = d(n) / d(longest)

    def size(v: str) -> Column:
        return F.when(longest <= n, F.col(v)).otherwise(F.greatest(F.lit(1), jsround(d(v) * k)))

    return resize_nearest(p, size("w"), size("h"))


def pixelate(p: DataFrame, block: float) -> DataFrame:
    """Nearest down by the block and nearest up again: two narrow scatters."""
    b = max(1, math.floor(block))
    if b <= 1:
        return p
    t = p.withColumns({"_w0": F.col("w"), "_h0": F.col("h")})
    small = [F.greatest(F.lit(1), F.ceil(d(v) / b).cast("int")) for v in SIZE]
    t = resize_nearest(t, *small, keys=[*IMG, "_w0", "_h0"])
    return resize_nearest(t, F.col("_w0"), F.col("_h0"))


def rotate(p: DataFrame, degrees: float) -> DataFrame:
    """Any angle, canvas grown to fit, bilinear, transparent outside the source.

    A source quad covers a unit square, whose rotated image touches at most three output columns
    and rows: those few candidates are exploded and tested exactly.  Only the cells outside the
    source come from the (cheap) grid of canvases.
    """
    from ..sources.generators import grid

    rad = degrees * math.pi / 180
    cos, sin = math.cos(rad), math.sin(rad)

    def extent(kx: float, ky: float) -> Column:
        pts = [d(0), d("w") * kx, d("h") * ky, d("w") * kx + d("h") * ky]
        return F.greatest(F.lit(1), F.ceil(F.greatest(*pts) - F.least(*pts)).cast("int"))

    def sized(df: DataFrame) -> DataFrame:
        return df.withColumns({"_nw": extent(cos, -sin), "_nh": extent(sin, cos)})

    def source(x: str, y: str, w: str, h: str) -> tuple[Column, Column]:
        dx, dy = d(x) + 0.5 - d("_nw") / 2, d(y) + 0.5 - d("_nh") / 2
        return dx * cos + dy * sin + d(w) / 2 - 0.5, -dx * sin + dy * cos + d(h) / 2 - 0.5

    half = (abs(cos) + abs(sin)) / 2 + 1e-6
    q = sized(with_quad(p))
    u, v = d("x") + 1 - d("w") / 2, d("y") + 1 - d("h") / 2
    mx = u * cos - v * sin + d("_nw") / 2 - 0.5
    my = u * sin + v * cos + d("_nh") / 2 - 0.5

    def candidates(m: Column, n: str) -> Column:
        lo = F.greatest(F.lit(0), F.ceil(m - half).cast("int"))
        hi = F.least(F.col(n) - 1, F.floor(m + half).cast("int"))
        return F.explode(F.filter(F.sequence(F.least(lo, hi), F.greatest(lo, hi)), lambda k: k.between(lo, hi)))

    q = q.withColumns({"_mx": mx, "_my": my})
    q = q.withColumn("_ox", candidates(F.col("_mx"), "_nw")).withColumn("_oy", candidates(F.col("_my"), "_nh"))
    sx, sy = source("_ox", "_oy", "w", "h")
    q = q.withColumns({"_sx": sx, "_sy": sy}).filter(
        "floor(_sx) = x and floor(_sy) = y and _sx >= 0 and _sy >= 0 and _sx <= w - 1 and _sy <= h - 1"
    )
    wx, wy = F.col("_sx") - F.col("x"), F.col("_sy") - F.col("y")
    inside = q.select(
        *IMG, F.col("_nw").alias("w"), F.col("_nh").alias("h"), F.col("_ox").alias("x"), F.col("_oy").alias("y"),
        *[u8(bilinear(ch, wx, wy)).alias(ch) for ch in RGBA],
    )
    canvas = sized(images_of(p)).withColumns({"_w0": F.col("w"), "_h0": F.col("h")})
    g = grid(canvas, "_nw", "_nh")
    sx, sy = source("x", "y", "_w0", "_h0")
    g = g.withColumns({"_sx": sx, "_sy": sy}).filter("_sx < 0 or _sy < 0 or _sx > _w0 - 1 or _sy > _h0 - 1")
    outside = g.select(*IMG, "w", "h", *POS, *[F.lit(0).alias(ch) for ch in RGBA])
    return inside.union(outside)


def seamless_tile(p: DataFrame, feather: float = 0.5) -> DataFrame:
    """Cross-fade the borders with the half-offset copy; only the blended rim is joined."""
    f = max(0.0, min(1.0, feather))

    def rim(pos: str, n: str) -> Column:
        margin = d(n) * f / 2
        raw = F.least(F.col(pos), F.col(n) - 1 - F.col(pos))
        return F.when(margin > 0, F.greatest(d(0), d(1) - d(raw) / F.when(margin > 0, margin).otherwise(d(1)))).otherwise(d(0))

    weight = F.greatest(rim("x", "w"), rim("y", "h"))
    half = [F.shiftright("w", 1), F.shiftright("h", 1)]
    other = p.select(
        *IMG, *SIZE, ((F.col("x") - half[0] + F.col("w")) % F.col("w")).alias("x"),
        ((F.col("y") - half[1] + F.col("h")) % F.col("h")).alias("y"), *[F.col(ch).alias(f"_o{ch}") for ch in RGBA],
    ).filter(weight > 0).drop(*SIZE)
    t = p.join(large(other), [*IMG, *POS], "left").withColumn("_k", weight)
    k = F.col("_k")
    return t.select(
        *IMG, *SIZE, *POS,
        *[F.when(k > 0, u8(d(ch) * (d(1) - k) + d(f"_o{ch}") * k)).otherwise(F.col(ch)).alias(ch) for ch in RGBA],
    )


#: Side of the tiles in which pixels are looked up.
TILE = 64


def sample_at(points: DataFrame, p: DataFrame, u="u", v="v", keys: list[str] = IMG) -> DataFrame:
    """Edge-clamped bilinear samples at normalised (u, v), half-pixel centres.

    ``points`` carries ``keys`` plus the source size (``sw``, ``sh``).  It is joined to the packed tiles of ``p`` by the tile of its
    top-left source pixel, so one large image spreads over its tiles and what is shuffled of ``p`` is a row a tile.
    Of an image that is there several times every copy is sampled, in one sequence of pixels: the next one of a pixel is its next copy, and that
    of its last copy the next pixel.
    """
    lim = lambda e, n: F.greatest(d(0), F.least(d(n) - 1, e))
    t = points.withColumns({"_fx": lim(d(u) * d("sw") - 0.5, "sw"), "_fy": lim(d(v) * d("sh") - 0.5, "sh")})
    # a key that cannot be null spares the join a null filter, which Catalyst would push down by
    # repeating the whole sampling formula
    t = t.withColumns({k: F.coalesce(F.floor(v).cast("int"), F.lit(-1)) for k, v in (("_qx", "_fx"), ("_qy", "_fy"))})
    t = t.withColumns({"_tx": F.shiftright("_qx", TILE.bit_length() - 1), "_ty": F.shiftright("_qy", TILE.bit_length() - 1)})
    q = pixel_tiles(p, SIZE).select(*keys, "_tx", "_ty", F.col("w").alias("_w"), F.col("h").alias("_h"), "_px")
    t = t.join(large(q), [*keys, "_tx", "_ty"], "inner").filter("_qx < _w and _qy < _h")
    x, y, across = F.col("_qx") - F.col("_tx") * TILE, F.col("_qy") - F.col("_ty") * TILE, _tile_row("_w")
    copies = F.floor(F.size("_px") / (across * F.least(F.col("_h") - F.col("_ty") * TILE, F.lit(TILE + 1)))).cast("int")
    t = t.withColumns({"_n": F.greatest(copies, F.lit(1)), "_at": y * across + x, "_right": F.when(F.col("_qx") < F.col("_w") - 1, 1).otherwise(0),
                       "_below": F.when(F.col("_qy") < F.col("_h") - 1, across).otherwise(0)})
    t = t.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    at = lambda k: F.get("_px", k * F.col("_n"))
    own, right, below = at(F.col("_at")), at(F.col("_at") + F.col("_right")), at(F.col("_at") + F.col("_below"))
    last, ahead = F.col("_copy") == F.col("_n"), F.when(F.col("_copy") + 1 == F.col("_n"), right).otherwise(own)
    turn = F.when((F.col("_n") > 1) & (F.col("_below") > 0), below).otherwise(at(F.col("_at") + F.col("_right") + F.col("_below")))
    near = {"": own, "10": F.when(last, right).otherwise(own), "01": F.when(last, below).otherwise(own), "11": F.when(last, turn).otherwise(ahead)}
    t = t.withColumns({f"_q{s}": e for s, e in near.items()})
    byte = lambda s, k: F.shiftright(f"_q{s}", k).bitwiseAND(F.lit(255).cast("long"))
    t = t.withColumns({f"_q{ch}{s}": byte(s, k) for s in CORNERS for ch, k in zip(RGBA, (24, 16, 8, 0))})
    wx, wy = F.col("_fx") - F.col("_qx"), F.col("_fy") - F.col("_qy")
    drop = [f"_q{ch}{s}" for ch in ["", *RGBA] for s in CORNERS] + ["_fx", "_fy", "_qx", "_qy", "_tx", "_ty", "_w", "_h", "_px", "_n", "_at", "_right", "_below", "_copy"]
    return t.withColumns({ch: u8(bilinear(f"_q{ch}", wx, wy)) for ch in RGBA}).drop(*drop)


def tile_code(frame: str, tx: str, ty: str) -> Column:
    """Frame and tile in one number."""
    at = F.shiftleft(F.col(ty).cast("long"), 16) + F.col(tx).cast("long")
    return F.shiftleft(F.col(frame).cast("long"), 32) + at


def pixel_tiles(p: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(image_id, frame, keep…, _tx, _ty, _px): the colours of each tile with the column and row behind it, row by row, one number a pixel.

    Every pixel of an image is there once. The upper half of a number is its place, so sorting the numbers sorts the pixels.
    """
    t = p.select(*IMG, *{"w": 0, **dict.fromkeys(keep)}, *POS, pack_rgba().alias("_rgba"))
    for o, v in (("_ty", "y"), ("_tx", "x")):
        own = F.shiftright(v, TILE.bit_length() - 1)
        t = t.withColumn(o, F.explode(F.when((F.col(v) > 0) & (F.col(v).bitwiseAND(TILE - 1) == 0), F.array(own - 1, own)).otherwise(F.array(own))))
    place = (F.col("y") - F.col("_ty") * TILE) * _tile_row("w") + F.col("x") - F.col("_tx") * TILE
    t = t.select(*IMG, *keep, "_tx", "_ty", (F.shiftleft(place.cast("long"), 32) + F.col("_rgba").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("_px"))
    return t.groupBy(*IMG, *keep, "_tx", "_ty").agg(F.sort_array(F.collect_list("_px")).alias("_px"))


def _tile_row(w: str) -> Column:
    """Pixels in a row of a tile, the one behind it included."""
    return F.least(F.col(w) - F.col("_tx") * TILE, F.lit(TILE + 1))


def sample_in_tiles(points: DataFrame) -> DataFrame:
    """``points`` at (u, v) of view ``_view`` of size (sw, sh) with their source pixel and the ``_code`` of its tile, as in ``sample_at``."""
    lim = lambda e, n: F.greatest(d(0), F.least(d(n) - 1, e))
    t = points.withColumns({"_fx": lim(d("u") * d("sw") - 0.5, "sw"), "_fy": lim(d("v") * d("sh") - 0.5, "sh")})
    t = t.withColumns({"_qx": F.floor("_fx").cast("int"), "_qy": F.floor("_fy").cast("int")})
    t = t.withColumns({"_tx": F.floor(F.col("_qx") / TILE).cast("int"), "_ty": F.floor(F.col("_qy") / TILE).cast("int")})
    t = t.withColumn("_code", F.when(F.col("sw").isNotNull(), tile_code("_view", "_tx", "_ty")))
    # a generator of one row: no filter is pushed down below it, which would repeat the whole formula
    own = ["sw", "sh", "_fx", "_fy", "_qx", "_qy", "_tx", "_ty", "_code"]
    rest = [c for c in t.columns if c not in own]
    return t.select(*rest, F.explode(F.array(F.struct(*own))).alias("_at")).select(*rest, "_at.*")


def sampled(points: DataFrame) -> DataFrame:
    """Points of ``sample_in_tiles`` with the bilinear sample from ``_px``, their tile of ``pixel_tiles``."""
    x, y = F.col("_qx"), F.col("_qy")
    near = {"0": (x, y), "1": (F.least(x + 1, F.col("sw") - 1), F.least(y + 1, F.col("sh") - 1))}

    def at(i: Column, j: Column) -> Column:
        return F.get("_px", (j - F.col("_ty") * TILE) * _tile_row("sw") + i - F.col("_tx") * TILE)

    t = points.withColumns({f"_c{s}": at(near[s[:1] or "0"][0], near[s[1:] or "0"][1]) for s in CORNERS})
    byte = lambda s, k: F.shiftright(f"_c{s}", k).bitwiseAND(F.lit(255).cast("long"))
    t = t.withColumns({f"_q{ch}{s}": byte(s, k) for s in CORNERS for ch, k in zip(RGBA, (24, 16, 8, 0))})
    wx, wy = F.col("_fx") - x, F.col("_fy") - y
    return t.withColumns({ch: u8(bilinear(f"_q{ch}", wx, wy)) for ch in RGBA})
