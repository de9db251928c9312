"""Multi-image operators: equi-joins on (image_id, frame, x, y).

The key holds the pixel position, so an image that is a third of the corpus still spreads over all
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import c, clamp01, d, idiv, jsround, luminance, u8
from ..schema import IMG, PIXEL, POS, RGB, RGBA, SIZE, images_of, large
from .color import bw
from .regrid import resize_bilinear, resize_nearest

KEY = IMG + POS


def fit_to(b: DataFrame, a: DataFrame) -> DataFrame:
    """Resize b (nearest) to the size of the same image in a; images a lacks keep their size."""
    sizes = images_of(a).select(*IMG, F.col("w").alias("_tw"), F.col("h").alias("_th"))
    t = b.join(sizes, IMG, "left")
    return resize_nearest(t, F.coalesce("_tw", "w"), F.coalesce("_th", "h")).select(*PIXEL)


def _side(df: DataFrame, tag: str) -> DataFrame:
    return df.select(*KEY, *[F.col(v).alias(f"{tag}{v}") for v in SIZE + RGBA])


def pair(a: DataFrame, b: DataFrame, how: str, same_size: bool) -> DataFrame:
    b = b if same_size else fit_to(b, a)
    return _side(a, "_a").join(large(_side(b, "_b")), KEY, how)


def blend(a: Column, b: Column, mode: str) -> Column:
    a, b = d(a), d(b)
    return {
        "max": lambda: F.greatest(a, b),
        "min": lambda: F.least(a, b),
        "multiply": lambda: a * b / 255.0,
        "add": lambda: F.least(d(255), a + b),
        "subtract": lambda: F.greatest(d(0), a - b),
        "difference": lambda: F.abs(a - b),
        "screen": lambda: d(255) - (d(255) - a) * (d(255) - b) / 255.0,
        "average": lambda: (a + b) / 2.0,
    }[mode]()


def composite(top: list[Column], bottom: list[Column], rounding=u8) -> list[Column]:
    """Source-over of two RGBA quadruples; a fully transparent result is black."""
    at, ab = d(top[3]) / 255.0, d(bottom[3]) / 255.0
    rest = d(1) - at
    ao = at + ab * rest
    rgb = [
        F.when(ao > 0, rounding((d(top[i]) * at + d(bottom[i]) * ab * rest) / ao)).otherwise(F.lit(0)) for i in range(3)
    ]
    return [*rgb, rounding(ao * 255.0)]


def mix(a: list[Column], b: list[Column], mode: str) -> list[Column]:
    if mode in ("over", "under"):
        return composite(a, b) if mode == "over" else composite(b, a)
    return [u8(blend(a[i], b[i], mode)) for i in range(3)] + [F.greatest(a[3], b[3])]


def combine(a: DataFrame, b: DataFrame, mode: str = "over", same_size: bool = False) -> DataFrame:
    """Blend two corpora; an image present on one side only passes through."""
    t = pair(a, b, "full_outer", same_size)
    left, right = [[F.col(f"_{s}{ch}") for ch in RGBA] for s in "ab"]
    has_a, has_b = F.col("_aw").isNotNull(), F.col("_bw").isNotNull()
    out = mix(left, right, mode)
    cols = [
        F.when(has_a & has_b, out[i]).when(has_a, left[i]).otherwise(right[i]).alias(ch) for i, ch in enumerate(RGBA)
    ]
    return t.select(*IMG, *[F.coalesce(f"_a{s}", f"_b{s}").alias(s) for s in SIZE], *POS, *cols)


def broadcast_still(seq: DataFrame, still: DataFrame, mode: str = "over", same_size: bool = False) -> DataFrame:
    """One still composited on each frame: the still is joined without its frame."""
    frames = images_of(seq).select("image_id", "frame", F.col("w").alias("_tw"), F.col("h").alias("_th"))
    if same_size:
        held = still.drop("frame")
        t = _side(seq, "_a").join(large(held.select("image_id", *POS, *[F.col(v).alias(f"_b{v}") for v in SIZE + RGBA])),
                                  ["image_id", *POS], "left")
    else:
        sizes = frames.select("image_id", "_tw", "_th").distinct()
        t = resize_nearest(still.drop("frame").join(sizes, "image_id"), F.col("_tw"), F.col("_th"), keys=["image_id"])
        t = t.select("image_id", *POS, F.col("w").alias("_aw"), F.col("h").alias("_ah"),
                     *[F.col(v).alias(f"_b{v}") for v in RGBA], F.lit(1).alias("_bw"))
        t = _side(seq, "_a").join(large(t), ["image_id", "_aw", "_ah", *POS], "left")
    left, right = [[F.col(f"_{s}{ch}") for ch in RGBA] for s in "ab"]
    out = mix(left, right, mode)
    cols = [F.when(F.col("_bw").isNotNull(), out[i]).otherwise(left[i]).alias(ch) for i, ch in enumerate(RGBA)]
    return t.select(*IMG, *[F.col(f"_a{s}").alias(s) for s in SIZE], *POS, *cols)


def hold_last_index(frames_a: DataFrame, frames_b: DataFrame) -> DataFrame:
    """(image_id, frame, fa, fb): the longer length, each side holding its last frame."""
    na = frames_a.groupBy("image_id").agg(F.max("frame").alias("na"))
    nb = frames_b.groupBy("image_id").agg(F.max("frame").alias("nb"))
    t = na.join(nb, "image_id").withColumn("frame", F.explode(F.sequence(F.lit(0), F.greatest("na", "nb"))))
    return t.select("image_id", "frame", F.least("frame", "na").alias("fa"), F.least("frame", "nb").alias("fb"))


def hold_last_join(a: DataFrame, b: DataFrame, mode: str = "over", same_size: bool = False) -> DataFrame:
    """Blend two sequences of different length: an as-of join made equi by the index table."""
    idx = hold_last_index(images_of(a), images_of(b))
    left = a.withColumnRenamed("frame", "fa").join(idx.select("image_id", "frame", "fa"), ["image_id", "fa"])
    right = b.withColumnRenamed("frame", "fb").join(idx.select("image_id", "frame", "fb"), ["image_id", "fb"])
    return combine(left.select(*PIXEL), right.select(*PIXEL), mode, same_size)


def fold_combine(p: DataFrame, order: str, mode: str, layers_per_pass: int = 1024) -> DataFrame:
    """Blend the layers of each image left to right, quantising after every step.

    ``p`` holds one row per (image_id, frame, order, x, y), all layers of one size.  Order-free modes
    are plain aggregates (partial then final).  Order-dependent modes fold sorted chunks: a chunk
    holds at most ``layers_per_pass`` layers, however deep the stack is.
    """
    key = [*IMG, *SIZE, *POS]
    if mode in ("max", "min", "add", "subtract"):
        first = F.min(F.struct(order, *RGB))
        agg = p.groupBy(*key).agg(
            first.alias("_f"), F.max("a").alias("a"),
            *[f(ch).alias(f"_{n}{ch}") for ch in RGB for n, f in (("hi", F.max), ("lo", F.min), ("sum", F.sum))],
        )
        pick = {
            "max": lambda ch: F.col(f"_hi{ch}"),
            "min": lambda ch: F.col(f"_lo{ch}"),
            "add": lambda ch: F.least(F.lit(255), F.col(f"_sum{ch}")).cast("int"),
            "subtract": lambda ch: F.greatest(F.lit(0), F.col(f"_f.{ch}") * 2 - F.col(f"_sum{ch}")).cast("int"),
        }[mode]
        return agg.select(*key, *[pick(ch).alias(ch) for ch in RGB], "a")

    depth = p.filter("x = 0 and y = 0").groupBy(*IMG).count().agg(F.max("count")).first()[0] or 0
    rank = Window.partitionBy(*IMG, *POS).orderBy(order)
    ranked = p.withColumn("_k", F.row_number().over(rank) - 1) if depth > layers_per_pass else p.withColumn("_k", F.col(order))
    acc = None
    for chunk in range(max(1, -(-depth // layers_per_pass))):
        part = ranked
        if depth > layers_per_pass:
            part = ranked.filter(F.col("_k").between(chunk * layers_per_pass, (chunk + 1) * layers_per_pass - 1))
        part = part.select(*key, "_k", *RGBA)
        if acc is not None:
            part = part.union(acc.select(*key, F.lit(-1).alias("_k"), *RGBA))
        layers = F.array_sort(F.collect_list(F.struct("_k", *RGBA)))
        stacked = part.groupBy(*key).agg(layers.alias("_l"))

        def step(s: Column, v: Column) -> Column:
            out = mix([s[ch] for ch in RGBA], [v[ch] for ch in RGBA], mode)
            return F.struct(*[o.cast("int").alias(ch) for o, ch in zip(out, RGBA)])

        head = F.col("_l")[0]
        start = F.struct(*[head[ch].cast("int").alias(ch) for ch in RGBA])
        rest = F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))
        stacked = stacked.withColumn("_o", F.aggregate(rest, start, step))
        acc = stacked.select(*key, *[F.col(f"_o.{ch}").alias(ch) for ch in RGBA])
    return acc


def apply_mask(p: DataFrame, m: DataFrame, same_size: bool = False) -> DataFrame:
    t = pair(p, m, "left", same_size)
    light = (d(0.299) * F.col("_br") + d(0.587) * F.col("_bg") + d(0.114) * F.col("_bb")) / 255.0
    a = F.when(F.col("_bw").isNotNull(), u8(d("_aa") * light)).otherwise(F.col("_aa"))
    return t.select(*IMG, *[F.col(f"_a{s}").alias(s) for s in SIZE], *POS, *[F.col(f"_a{ch}").alias(ch) for ch in RGB],
                    a.alias("a"))


def mask_combine(a: DataFrame, b: DataFrame, op: str, cut: float = 128, same_size: bool = False) -> DataFrame:
    t = pair(a, b, "inner", same_size)
    on_a, on_b = [luminance(f"_{s}r", f"_{s}g", f"_{s}b") >= d(cut) for s in "ab"]
    on = {"and": on_a & on_b, "or": on_a | on_b, "subtract": on_a & ~on_b, "xor": on_a != on_b}[op]
    t = t.select(*IMG, *[F.col(f"_a{s}").alias(s) for s in SIZE], *POS, on.alias("_on"))
    return bw(t, F.col("_on")).select(*PIXEL)


def mask_set(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """The same four operations as set algebra over the positions of pixels that are on."""
    a, b = a.select(*KEY), b.select(*KEY)
    if op == "and":
        return a.intersect(b)
    if op == "or":
        return a.union(b).distinct()
    if op == "subtract":
        return a.subtract(b)
    return a.subtract(b).union(b.subtract(a))


def split_compare(a: DataFrame, b: DataFrame, split: float = 0.5, vertical: bool = False, same_size=False) -> DataFrame:
    t = pair(a, b, "inner", same_size)
    pos, n = ("y", "_ah") if vertical else ("x", "_aw")
    edge = jsround(d(max(0.0, min(1.0, split))) * F.col(n))
    cols = [
        F.when(F.col(pos) == edge, F.lit(255)).when(F.col(pos) < edge, F.col(f"_a{ch}")).otherwise(F.col(f"_b{ch}")).alias(ch)
        for ch in RGBA
    ]
    return t.select(*IMG, *[F.col(f"_a{s}").alias(s) for s in SIZE], *POS, *cols)


def channel_pack(r=None, g=None, b=None, a=None, same_size: bool = False) -> DataFrame:
    """Luminance of up to four corpora into one; the first one given sets the size."""
    given = [(ch, df) for ch, df in zip(RGBA, (r, g, b, a)) if df is not None]
    if not given:
        raise ValueError("channel_pack needs at least one source")
    ref = given[0][1]
    t = ref.select(*IMG, *SIZE, *POS, luminance().alias(f"_{given[0][0]}"))
    for ch, df in given[1:]:
        df = df if same_size else fit_to(df, ref)
        t = t.join(large(df.select(*KEY, luminance().alias(f"_{ch}"))), KEY, "left")
    have = {ch for ch, _ in given}
    cols = []
    for ch in RGBA:
        missing = F.lit(255 if ch == "a" else 0)
        cols.append((F.coalesce(u8(F.col(f"_{ch}")), missing) if ch in have else missing).alias(ch))
    return t.select(*IMG, *SIZE, *POS, *cols)


def paste(base: DataFrame, overlay: DataFrame, x=0, y=0) -> DataFrame:
    """Source-over at (x, y) (numbers, or columns of the overlay); clipped to the base."""
    ov = overlay.select(
        *IMG, (F.col("x") + jsround(c(x))).alias("x"), (F.col("y") + jsround(c(y))).alias("y"),
        *[F.col(ch).alias(f"_o{ch}") for ch in RGBA],
    ).filter("_oa > 0")
    t = base.join(large(ov), KEY, "left")
    out = composite([F.col(f"_o{ch}") for ch in RGBA], [F.col(ch) for ch in RGBA], jsround)
    hit = F.col("_oa").isNotNull()
    return t.select(*IMG, *SIZE, *POS, *[F.when(hit, out[i]).otherwise(F.col(ch)).alias(ch) for i, ch in enumerate(RGBA)])


def split_region(p: DataFrame, x: float, y: float, w: float, h: float) -> tuple[DataFrame, DataFrame]:
    """A crop, and the rectangle it really covers as JSON text per image."""
    from math import floor

    from .regrid import crop

    rx, ry = max(0, floor(x)), max(0, floor(y))
    cut = crop(p, rx, ry, w, h)
    regions = images_of(cut).select(
        *IMG,
        F.to_json(F.struct(F.lit(rx).alias("x"), F.lit(ry).alias("y"), F.col("w").alias("width"), F.col("h").alias("height")))
        .alias("region"),
    )
    return cut, regions


def parse_region(text: str = "region") -> Column:
    """A struct when the text is a JSON object with four finite numbers, else null."""
    s = F.from_json(c(text), "x double, y double, width double, height double")
    ok = s["x"].isNotNull() & s["y"].isNotNull() & s["width"].isNotNull() & s["height"].isNotNull()
    return F.when(ok, s)


def place_image(base: DataFrame, overlay: DataFrame, regions: DataFrame | None = None, x=0, y=0, width=0, height=0) -> DataFrame:
    """Scale the overlay (bilinear) to a rectangle and paste it; a valid region row wins over the arguments."""
    t = overlay
    if regions is None:
        t = t.withColumns({"_px": d(x), "_py": d(y), "_pw": d(width), "_ph": d(height)})
    else:
        r = regions.select(*IMG, parse_region("region").alias("_rg"))
        t = t.join(r, IMG, "left").withColumns(
            {n: F.coalesce(F.col(f"_rg.{k}"), d(v))
             for n, k, v in (("_px", "x", x), ("_py", "y", y), ("_pw", "width", width), ("_ph", "height", height))}
        ).drop("_rg")
    tw = F.greatest(F.lit(1), F.when(F.col("_pw") <= 0, F.col("w")).otherwise(jsround("_pw")))
    th = F.greatest(F.lit(1), F.when(F.col("_ph") <= 0, F.col("h")).otherwise(jsround("_ph")))
    sized = resize_bilinear(t, tw, th, keep=["_px", "_py"])
    return paste(base, sized, F.col("_px"), F.col("_py"))
