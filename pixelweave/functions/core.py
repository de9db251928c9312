"""Scalar building blocks: 8-bit stores, rounding rules, luminance, colour spaces.

Two rounding rules matter everywhere: ``u8`` is the clamped store of a real number into a byte
(half to even), ``jsround`` is ``floor(v + 0.5)``.  ``rint`` is used for half-even because it is a
primitive in generated code, where ``bround`` on doubles goes through BigDecimal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(v) -> Column:
    """Column from a name, a Column or a Python number."""
    if isinstance(v, Column):
        return v
    if isinstance(v, str):
        return F.col(v)
    return F.lit(v)


def d(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else c(v).cast("double")


def clamp(v, lo, hi) -> Column:
    return F.greatest(d(lo), F.least(d(hi), d(v)))


def clamp01(v) -> Column:
    return clamp(v, 0.0, 1.0)


def u8(v) -> Column:
    return F.rint(clamp(v, 0.0, 255.0)).cast("int")


def jsround(v) -> Column:
    return F.floor(d(v) + 0.5).cast("int")


def ifloor(v) -> Column:
    return F.floor(d(v)).cast("int")


def idiv(a, b) -> Column:
    """Floor division for non-negative integers, exact and JVM-side."""
    return F.floor(d(a) / d(b)).cast("int")


def luminance(r="r", g="g", b="b") -> Column:
    return d(0.299) * c(r) + d(0.587) * c(g) + d(0.114) * c(b)


def js_round_py(v: float) -> int:
    return math.floor(v + 0.5)


def rgb_hue(r: Column, g: Column, b: Column, mx: Column, delta: Column) -> Column:
    """Hue in [0, 1) from channels in [0, 1]; the first largest channel decides."""
    six = F.when(g < b, d(6)).otherwise(d(0))
    sector = (
        F.when(mx == r, (g - b) / delta + six).when(mx == g, (b - r) / delta + 2.0).otherwise((r - g) / delta + 4.0)
    )
    return F.when(delta != 0, sector / 6.0).otherwise(d(0))


def rgb_to_hsv(r="r", g="g", b="b") -> tuple[Column, Column, Column]:
    r, g, b = (d(c(v)) / 255.0 for v in (r, g, b))
    mx, mn = F.greatest(r, g, b), F.least(r, g, b)
    sat = F.when(mx != 0, (mx - mn) / mx).otherwise(d(0))
    return rgb_hue(r, g, b, mx, mx - mn), sat, mx


def with_hsl(p: DataFrame) -> DataFrame:
    """Adds ``_h``, ``_s``, ``_l``.

    Written in steps: Catalyst keeps a step whose result is used many times as its own projection, so
    generated code computes it once and stays small enough to be compiled well.
    """
    t = p.withColumns({f"_{ch}": d(ch) / 255.0 for ch in "rgb"})
    t = t.withColumns({"_mx": F.greatest("_r", "_g", "_b"), "_mn": F.least("_r", "_g", "_b")})
    t = t.withColumns({"_l": (F.col("_mx") + F.col("_mn")) / 2.0, "_dl": F.col("_mx") - F.col("_mn")})
    flat = F.col("_dl") == 0
    room = F.when(F.col("_l") > 0.5, d(2) - F.col("_mx") - F.col("_mn")).otherwise(F.col("_mx") + F.col("_mn"))
    hue = rgb_hue(F.col("_r"), F.col("_g"), F.col("_b"), F.col("_mx"), F.col("_dl"))
    t = t.withColumns({"_h": hue, "_s": F.when(flat, d(0)).otherwise(F.col("_dl") / F.when(flat, d(1)).otherwise(room))})
    return t.drop("_r", "_g", "_b", "_mx", "_mn", "_dl")


def with_rgb_of_hsl(p: DataFrame) -> DataFrame:
    """Replaces r, g, b by the colour of ``_h``, ``_s``, ``_l`` (dropped), in steps like ``with_hsl``."""
    q = F.when(F.col("_l") < 0.5, F.col("_l") * (F.col("_s") + 1.0)).otherwise(F.col("_l") + F.col("_s") - F.col("_l") * F.col("_s"))
    t = p.withColumn("_q", q).withColumn("_p", F.col("_l") * 2.0 - F.col("_q"))
    shift = {"r": F.col("_h") + 1 / 3, "g": F.col("_h") + 0.0, "b": F.col("_h") - 1 / 3}
    t = t.withColumns({f"_t{ch}": e for ch, e in shift.items()})
    t = t.withColumns({f"_t{ch}": F.when(F.col(f"_t{ch}") < 0, F.col(f"_t{ch}") + 1.0).when(F.col(f"_t{ch}") > 1, F.col(f"_t{ch}") - 1.0).otherwise(F.col(f"_t{ch}")) for ch in "rgb"})
    lo, hi = F.col("_p"), F.col("_q")

    def value(ch: str) -> Column:
        w = F.col(f"_t{ch}")
        v = (
            F.when(w < 1 / 6, lo + (hi - lo) * 6.0 * w).when(w < 1 / 2, hi)
            .when(w < 2 / 3, lo + (hi - lo) * (d(2 / 3) - w) * 6.0).otherwise(lo)
        )
        return jsround(F.when(F.col("_s") == 0, F.col("_l")).otherwise(v) * 255.0)

    t = t.withColumns({ch: value(ch) for ch in "rgb"})
    return t.drop("_h", "_s", "_l", "_q", "_p", "_tr", "_tg", "_tb")


def hex_to_rgba(text, alpha: int = 255) -> Column:
    """``#rgb``, ``#rgba``, ``#rrggbb``, ``#rrggbbaa`` → struct; any other length is black."""
    t = F.trim(F.regexp_replace(c(text), "^#", ""))
    n = F.length(t)

    def byte(s: Column) -> Column:
        # a byte is the longest leading run of hex digits, 0 when there is none
        digits = F.regexp_extract(s, "^[ ]*([0-9a-fA-F]+)", 1)
        return F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 16, 10).cast("int"))

    def short(i: int) -> Column:
        ch = F.substring(t, i, 1)
        return byte(F.concat(ch, ch))

    def long(i: int) -> Column:
        return byte(F.substring(t, 2 * i - 1, 2))

    def pick(i: int) -> Column:
        return F.when(n.isin(3, 4), short(i)).when(n.isin(6, 8), long(i)).otherwise(F.lit(0))

    a = F.when(n == 4, short(4)).when(n == 8, long(4)).otherwise(F.lit(alpha))
    return F.struct(pick(1).alias("r"), pick(2).alias("g"), pick(3).alias("b"), a.alias("a"))


def safe_num(text, fallback: float = 0.0) -> Column:
    """Leading number of a text, or the fallback when there is none or it is not finite."""
    # fixed value: the numeric prefix accepted before trailing text is ignored
    lead = F.regexp_extract(c(text), r"^\s*([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?))", 1)
    v = F.when(lead != "", lead.try_cast("double"))
    return F.coalesce(F.when(F.abs(v) < d(float("inf")), v), d(fallback))


def safe_str(v, fallback: str = "") -> Column:
    return F.coalesce(c(v).cast("string"), F.lit(fallback))


def safe_bool(json_text, fallback: bool = False) -> Column:
    """Only a real JSON boolean counts; the text "true" in quotes or a number does not."""
    t = F.trim(c(json_text))
    return F.when(t == "true", F.lit(True)).when(t == "false", F.lit(False)).otherwise(F.lit(fallback))


_M32 = 4294967295


def hash2(ix: Column, iy: Column, seed: Column) -> Column:
    """32-bit lattice hash on BIGINT; fixed values: the four mixing multipliers."""
    m = F.lit(_M32).cast("long")
    h = (
        c(ix).cast("long") * F.lit(374761393).cast("long")
        + c(iy).cast("long") * F.lit(668265263).cast("long")
        + c(seed).cast("long") * F.lit(362437).cast("long")
    ).bitwiseAND(m)
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * F.lit(1274126177).cast("long")).bitwiseAND(m)
    return h.bitwiseXOR(F.shiftright(h, 16))
