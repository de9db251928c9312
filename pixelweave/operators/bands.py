"""Row bands with a halo: one shuffle per neighbourhood operator, whatever the image size.

An image is cut into bands of rows; rows within ``halo`` of a band edge are copied to the next
band.  Rows are then hashed by (image, band).  Both the scanline window (by row) and the column
window (by column) live inside one band, so a separable filter needs ONE shuffle instead of two,
and an image of any size spreads over its bands: no task ever holds more than a band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.core import idiv
from ..schema import IMG, POS, RGBA, SIZE, pack_rgba, unpack_rgba


def band_rows(halo: int) -> int:
    return max(64, 4 * halo)


def _key(band: Column) -> Column:
    """Frame and band in one number. A constant frame by itself is folded away in windows but not in the shuffle, and Spark then
    shuffles again before each window."""
    return F.shiftleft(F.coalesce(F.col("frame"), F.lit(-1 << 31)).cast("long"), 32) + band


def in_bands(p: DataFrame, halo: int, packed: bool = False) -> DataFrame:
    """Rows dealt out by band. ``packed`` leaves the colour as it was shuffled, in one int ``_rgba``.

    What is equal along a scanline stands side by side and colour last, so that a shuffled pixel takes about a quarter of the bytes.
    """
    n = band_rows(halo)
    lo = idiv(F.greatest(F.lit(0), F.col("y") - halo), n)
    hi = idiv(F.least(F.col("h") - 1, F.col("y") + halo), n)
    t = p.withColumn("_band", F.explode(F.sequence(lo, hi))).withColumn("_band", _key(F.col("_band")))
    colour = set(RGBA) <= set(p.columns)
    own = [*IMG, *SIZE, *POS, *(RGBA if colour else [])]
    rest = [v for v in p.columns if v not in own]
    t = t.select(*IMG, "_band", *SIZE, *rest, "y", "x", *([pack_rgba().alias("_rgba")] if colour else [])).repartition("image_id", "_band")
    if packed or not colour:
        return t
    return t.withColumns(unpack_rgba("_rgba")).drop("_rgba")


def out_of_bands(t: DataFrame, halo: int) -> DataFrame:
    return t.filter(F.col("_band") == _key(idiv("y", band_rows(halo)))).drop("_band")


def by_row() -> WindowSpec:
    return Window.partitionBy("image_id", "_band", "y").orderBy("x")


def by_column() -> WindowSpec:
    return Window.partitionBy("image_id", "_band", "x").orderBy("y")


AXES = {"row": (by_row, "x", "w"), "column": (by_column, "y", "h")}


def shifted(t: DataFrame, cols: list[str], reach: int, axis: str, clamp: bool = True) -> DataFrame:
    """Columns ``c_m<k>`` / ``c_p<k>``: the values k steps before / after.

    Beyond the border they repeat the border value (``clamp``) or are null.
    """
    spec = AXES[axis][0]()
    raw = {}
    for name in cols:
        for k in range(1, reach + 1):
            raw[f"{name}_m{k}"] = F.lag(name, k).over(spec)
            raw[f"{name}_p{k}"] = F.lead(name, k).over(spec)
    t = t.withColumns(raw)
    if not clamp:
        return t

    def held(name: str, side: str, k: int) -> Column:
        return F.coalesce(*[F.col(f"{name}_{side}{j}") for j in range(k, 0, -1)], F.col(name))

    return t.withColumns(
        {f"{n}_{s}{k}": held(n, s, k) for n in cols for s in "mp" for k in range(1, reach + 1)}
    )


def shift_names(cols: list[str], reach: int) -> list[str]:
    return [f"{n}_{s}{k}" for n in cols for s in "mp" for k in range(1, reach + 1)]


def edge_sum(t: DataFrame, cols: list[str], r: int, axis: str) -> DataFrame:
    """Replace integer columns by their edge-clamped sum over 2r+1 positions.

    Narrow reach: neighbours are added up.  Wide reach: differences of a running sum, so the work
    per pixel does not grow with r.
    """
    spec_fn, pos, n = AXES[axis]
    if r <= 2:
        t = shifted(t, cols, r, axis)

        def total(name: str) -> Column:
            terms = [F.col(f"{name}_m{k}") for k in range(r, 0, -1)] + [F.col(name)]
            terms += [F.col(f"{name}_p{k}") for k in range(1, r + 1)]
            out = terms[0]
            for x in terms[1:]:
                out = out + x
            return out

        return t.withColumns({name: total(name) for name in cols}).drop(*shift_names(cols, r))
    spec = spec_fn()
    run = spec.rowsBetween(Window.unboundedPreceding, 0)
    full = spec.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = {}
    for name in cols:
        cum[f"_c{name}"] = F.sum(name).over(run)
        cum[f"_f{name}"] = F.first(name).over(full)
        cum[f"_l{name}"] = F.last(name).over(full)
        cum[f"_t{name}"] = F.sum(name).over(full)
    t = t.withColumns(cum)
    ends = {}
    for name in cols:
        ends[f"_b{name}"] = F.lag(f"_c{name}", r + 1).over(spec)
        ends[f"_e{name}"] = F.lead(f"_c{name}", r).over(spec)
    t = t.withColumns(ends)
    before = F.greatest(F.lit(0), F.lit(r) - F.col(pos))
    after = F.greatest(F.lit(0), F.col(pos) + r - (F.col(n) - 1))
    out = {
        name: F.coalesce(f"_e{name}", f"_t{name}") - F.coalesce(F.col(f"_b{name}"), F.lit(0))
        + before * F.col(f"_f{name}") + after * F.col(f"_l{name}")
        for name in cols
    }
    return t.withColumns(out).drop(*[f"_{k}{name}" for k in "cfltbe" for name in cols])


def extreme(t: DataFrame, cols: list[str], r: int, axis: str, op: str) -> DataFrame:
    """Local max (dilate) or min (erode) over 2r+1 positions.

    A border-clamped frame and a shrunken one agree for extremes.  Wide reach doubles the covered
    length with each step, so it needs log2(r) passes over one sort.
    """
    spec = AXES[axis][0]()
    best = F.greatest if op == "max" else F.least
    if r <= 3:
        t = shifted(t, cols, r, axis, clamp=False)
        names = {c: [c] + shift_names([c], r) for c in cols}
        return t.withColumns({c: best(*[F.col(v) for v in names[c]]) for c in cols}).drop(*shift_names(cols, r))
    # one-sided extremes over r+1 positions, forwards (_p) and backwards (_m)
    t = t.withColumns({f"{c}_{s}": F.col(c) for c in cols for s in "mp"})
    have = 1
    while have < r + 1:
        step = min(have, r + 1 - have)
        t = t.withColumns({f"{c}_{s}n": f(f"{c}_{s}", step).over(spec) for c in cols for s, f in (("m", F.lag), ("p", F.lead))})
        t = t.withColumns({f"{c}_{s}": best(F.col(f"{c}_{s}"), F.col(f"{c}_{s}n")) for c in cols for s in "mp"})
        have += step
    t = t.withColumns({c: best(F.col(f"{c}_m"), F.col(f"{c}_p")) for c in cols})
    return t.drop(*[f"{c}_{s}{k}" for c in cols for s in "mp" for k in ("", "n")])
