"""Pixels packed by tile: one row and one number a pixel for each ``SIDE`` x ``SIDE`` square of an image.

Operators that look at neighbours work on a tile and a rim around it with NumPy, and give the tiles on to the next operator
(``pixels`` remembers what it was unpacked from, a table what it was dealt out as). So a pixel by itself is shuffled at most once in
a chain of operators; what is dealt out or joined is a row a tile. A tile has a fixed size, whatever the size of the image.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import IMG, POS, RGBA, SIZE, large, pack_rgba

SIDE = 32
#: Widest rim of a tile, so that a tile's numbers stay in the tens of kilobytes.
RIM = 16
#: Added to places, so that those of the rim are not negative; bits of a place along one axis.
PAD, BITS = 64, 12
#: Pixels that NumPy takes at a time.
SLICE = 1 << 16
TILE = [*IMG, *SIZE, "_tx", "_ty"]


def remembered(p: DataFrame) -> DataFrame | None:
    """The tiles that ``p`` was unpacked from, if it is what an operator on tiles gave back."""
    return getattr(p, "pixelweave_tiles", None)


def pixels(tiles: DataFrame) -> DataFrame:
    """Tiles as a pixel table that remembers them."""
    t = tiles.select(*IMG, *SIZE, "_tx", "_ty", F.explode("_px").alias("_p"))
    out = t.select(*IMG, *SIZE, *place("_p"), *[e.alias(ch) for ch, e in packed_colour("_p").items()])
    out.pixelweave_tiles = tiles
    return out


def place(px: str) -> list[Column]:
    x = F.shiftright(px, 32).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int") - PAD + F.col("_tx") * SIDE
    return [x.alias("x"), (F.shiftright(px, 32 + BITS).cast("int") - PAD + F.col("_ty") * SIDE).alias("y")]


def packed_colour(px: str) -> dict[str, Column]:
    return {ch: F.shiftright(px, k).bitwiseAND(F.lit(255)).cast("int") for ch, k in zip(RGBA, (24, 16, 8, 0))}


def _number() -> Column:
    """Frame and tile in one number: what a tile is dealt out and joined by, with its image."""
    at = F.shiftleft(F.col("_ty").cast("long"), 16) + F.col("_tx")
    return F.coalesce(F.shiftleft(F.coalesce(F.col("frame"), F.lit(-1 << 31)).cast("long"), 32) + at, F.lit(0))


def tiles_of(p: DataFrame, halo: int = 0) -> DataFrame:
    """(image_id, frame, w, h, _tx, _ty, _px, _tile): the pixels of each tile and ``halo`` more on each side, in any order.

    Grouping keeps an order by image that ``p`` was dealt out in; else the pixels are shuffled once, packed where they lie.
    """
    t = p.select(*IMG, *SIZE, *POS, F.coalesce(pack_rgba(), F.lit(0)).alias("_rgba"))
    for o, v, n in (("_ty", "y", "h"), ("_tx", "x", "w")):
        lo, hi = F.greatest(F.lit(0), F.col(v) - halo), F.least(F.col(n) - 1, F.col(v) + halo)
        at = F.sequence(*[F.shiftright(e, SIDE.bit_length() - 1) for e in (lo, hi)]) if halo else F.array(F.shiftright(v, SIDE.bit_length() - 1))
        t = t.withColumn(o, F.explode(at))
    at = F.shiftleft(F.col("y") - F.col("_ty") * SIDE + PAD, BITS) + F.col("x") - F.col("_tx") * SIDE + PAD
    t = t.select(*TILE, (F.shiftleft(at.cast("long"), 32) + F.col("_rgba").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))).alias("_px"))
    return t.groupBy(*TILE).agg(F.collect_list("_px").alias("_px")).withColumn("_tile", _number())


def dealt(p: DataFrame, halo: int) -> DataFrame:
    """Tiles and their rims, dealt out by tile, so that the tiles of a large image come to many tasks."""
    known = remembered(p)
    if known is not None:
        return _rimmed(known, halo)
    p.pixelweave_dealt = tiles_of(p, halo).repartition("image_id", "_tile")
    return p.pixelweave_dealt


def _rimmed(tiles: DataFrame, halo: int) -> DataFrame:
    """Every tile with the pixels within ``halo`` of it that lie in the tiles around."""
    t = tiles
    for o, n, to in (("_ty", "h", "_dy"), ("_tx", "w", "_dx")):
        near = [F.lit(0), F.when(F.col(o) > 0, F.lit(-1)), F.when((F.col(o) + 1) * SIDE < F.col(n), F.lit(1))]
        t = t.withColumn(to, F.explode(F.array_compact(F.array(*near))))
    moved = F.shiftleft((-F.shiftleft(F.col("_dy"), BITS) - F.col("_dx")).cast("long") * SIDE, 32)
    inside = lambda e: e.between(PAD - halo, PAD + SIDE + halo - 1)
    rim = F.filter(F.transform("_px", lambda p: p + moved), lambda p: inside(F.shiftright(p, 32).bitwiseAND(F.lit((1 << BITS) - 1))) & inside(F.shiftright(p, 32 + BITS)))
    t = t.withColumn("_px", F.when((F.col("_dx") == 0) & (F.col("_dy") == 0), F.col("_px")).otherwise(rim))
    t = t.withColumns({"_tx": F.col("_tx") + F.col("_dx"), "_ty": F.col("_ty") + F.col("_dy")})
    return t.groupBy(*TILE).agg(F.flatten(F.collect_list("_px")).alias("_px")).withColumn("_tile", _number())


def _slices(lists: pa.ListArray) -> list[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` pixels."""
    ends, out, lo = lists.offsets.to_numpy(), [], 0
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, "right")) - 1)
        out.append((lo, hi))
        lo = hi
    return out


def _rows(lists: pa.ListArray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(tile, pixel) of rows lo to hi, by tile, row and column. What is at one place more than once stays in order."""
    ends = lists.offsets.to_numpy()[lo:hi + 1]
    tile, px = np.repeat(np.arange(hi - lo), np.diff(ends)), lists.values.to_numpy()[ends[0]:ends[-1]]
    at = px >> 32
    if np.any((at[1:] < at[:-1]) & (tile[1:] == tile[:-1])):
        order = np.lexsort((at, tile))
        return tile[order], px[order]
    return tile, px


def _lists(counts: list[np.ndarray], values: pa.Array) -> pa.ListArray:
    ends = np.concatenate([[0], *counts]).cumsum().astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values)


Step = Callable[..., tuple[np.ndarray, np.ndarray]]


def _each(lists: pa.ListArray, step: Step, *own: np.ndarray) -> pa.ListArray:
    counts, values = [], []
    for lo, hi in _slices(lists):
        tile, px = _rows(lists, lo, hi)
        tile, px = step(tile, px, *[v[lo:hi][tile] for v in own])
        counts.append(np.bincount(tile, minlength=hi - lo))
        values.append(px)
    return _lists(counts, pa.array(np.concatenate(values) if values else np.empty(0, np.int64)))


def on_tiles(step: Step) -> Callable[[str], Column]:
    """``step`` takes the tiles and pixels of some rows, in order, and gives back those of the result."""
    @F.arrow_udf("array<bigint>")
    def run(px: pa.Array) -> pa.Array:
        return _each(px, step)

    return run


def on_tiles_with(step: Step) -> Callable[[str, str], Column]:
    """``on_tiles`` with a number of each tile, dealt out to its pixels."""
    @F.arrow_udf("array<bigint>")
    def run(px: pa.Array, own: pa.Array) -> pa.Array:
        return _each(px, step, own.to_numpy(zero_copy_only=False))

    return run


def channels(px: np.ndarray) -> np.ndarray:
    """The colours as rows of r, g, b, a."""
    return (px & 0xFFFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, ::-1]


def coloured(px: np.ndarray, rgba: np.ndarray) -> np.ndarray:
    """The pixels with other colours."""
    packed = np.ascontiguousarray(rgba[:, ::-1], np.uint8).view("<u4")[:, 0]
    return (px >> 32 << 32) | packed.astype(np.int64)


def luminances(px: np.ndarray) -> np.ndarray:
    c = channels(px).astype(np.float64)
    return 0.299 * c[:, 0] + 0.587 * c[:, 1] + 0.114 * c[:, 2]


def lines(tile: np.ndarray, px: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line each pixel is on by row, the order by column, and the line by column in that order."""
    at = (tile << 2 * BITS) | (px >> 32)
    down = (tile << 2 * BITS) | (px >> 32 & (1 << BITS) - 1) << BITS | px >> 32 + BITS
    order = np.argsort(down, kind="stable")
    return at >> BITS, order, down[order] >> BITS


def beside(v: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values one step before and behind along a line; the ends of a line repeat their own."""
    same = line[1:] == line[:-1]
    before, behind = v.copy(), v.copy()
    before[1:][same], behind[:-1][same] = v[:-1][same], v[1:][same]
    return before, behind


def extremes(v: np.ndarray, line: np.ndarray, reach: int, best: np.ufunc) -> np.ndarray:
    """The extreme of each column of ``v`` up to ``reach`` steps before and behind along a line."""
    out = v.copy()
    for k in range(1, min(reach, len(v) - 1) + 1):
        same = line[k:] == line[:-k]
        out[k:][same] = best(out[k:][same], v[:-k][same])
        out[:-k][same] = best(out[:-k][same], v[k:][same])
    return out


def back(v: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.empty_like(v)
    out[order] = v
    return out


def within(tile: np.ndarray, px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of the tiles without their rims."""
    x, y = (px >> 32) & (1 << BITS) - 1, px >> 32 + BITS
    own = (x >= PAD) & (x < PAD + SIDE) & (y >= PAD) & (y < PAD + SIDE)
    return (tile, px) if own.all() else (tile[own], px[own])


def _matched(px: pa.Array, others: pa.Array) -> pa.Array:
    counts, left, right = [], [], []
    for lo, hi in _slices(px):
        (tile, a), (tile_b, b) = within(*_rows(px, lo, hi)), _rows(others, lo, hi)
        key, key_b = (tile << 2 * BITS) | (a >> 32), (tile_b << 2 * BITS) | (b >> 32)
        first = np.searchsorted(key_b, key, "left")
        n = np.searchsorted(key_b, key, "right") - first
        rows = np.maximum(n, 1)
        at = np.repeat(np.arange(len(a)), rows)
        hit = first[at] + np.arange(len(at)) - np.repeat(rows.cumsum() - rows, rows)
        none = n[at] == 0
        left.append(a[at])
        right.append(pa.array(np.append(b, 0)[np.where(none, len(b), hit)], mask=none))
        counts.append(np.bincount(tile[at], minlength=hi - lo))
    left, right = pa.array(np.concatenate(left)) if left else pa.array([], pa.int64()), pa.concat_arrays(right) if right else pa.array([], pa.int64())
    return _lists(counts, pa.StructArray.from_arrays([left, right], ["p", "other"]))


def never_null(df: DataFrame, c: str) -> Column:
    """A key of the right side of a left join. One that may be null is filtered for it down to the scan, which then is another
    scan than that of the left side, and nothing of what both sides read is shared. Rows with a null key are left out by their values."""
    return F.coalesce(c, F.lit(-1).cast(df.schema[c].dataType))


def with_levels(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """``tiles`` with the ``level`` of their image, null where ``levels(image_id, frame, level)`` has none."""
    named = F.when(F.col("image_id").isNotNull() & F.col("frame").isNotNull(), F.col("level"))
    own = levels.select(*[never_null(levels, c).alias(f"_{c}") for c in IMG], named.alias("level")).groupBy(*[f"_{c}" for c in IMG]).agg(F.max("level").alias("level"))
    return tiles.join(own, [F.col(c) == F.col(f"_{c}") for c in IMG], "left").select(*tiles.columns, "level")


def matched(p: DataFrame, other: DataFrame) -> DataFrame:
    """The pixels of ``p`` joined by place to those of ``other``, packed in ``_other`` and null where there is none: a left join, tile by tile.

    If ``p`` was dealt out before, this is the same shuffle.
    """
    a, b = (next((t for t in (getattr(p, "pixelweave_dealt", None), remembered(p)) if t is not None), None), remembered(other))
    a, b = tiles_of(p) if a is None else a, tiles_of(other) if b is None else b
    named = F.when(F.col("image_id").isNotNull() & F.col("frame").isNotNull(), F.col("_px"))
    b = b.select(never_null(b, "image_id").alias("_image"), F.col("_tile").alias("_at"), named.alias("_px"))
    b = b.groupBy("_image", "_at").agg(F.flatten(F.collect_list("_px")).alias("_others"))
    t = a.join(large(b), (F.col("image_id") == F.col("_image")) & (F.col("_tile") == F.col("_at")), "left")
    both = F.arrow_udf(_matched, "array<struct<p:bigint,other:bigint>>")("_px", F.coalesce("_others", F.array().cast("array<bigint>")))
    t = t.select(*TILE, F.inline(both).alias("_p", "_other"))
    return t.select(*IMG, *SIZE, *place("_p"), *[e.alias(ch) for ch, e in packed_colour("_p").items()], "_other")
