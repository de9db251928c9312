"""Point-cloud formats as tables of splats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import d, u8
from ..schema import SPLAT_POS, SPLAT_QUAT, SPLAT_RADII
from .files import byte_ranges, read_at

SH_C0 = 0.28209479177387814  # fixed value: zeroth harmonic, 1 / (2 sqrt(pi))
RECORD = 32  # bytes of one flat splat record
ROWS_PER_BATCH = 1 << 16  # records decoded at a time


def _unit(x: Column, y: Column, z: Column, w: Column) -> list[Column]:
    n = F.sqrt(x * x + y * y + z * z + w * w)
    n = F.when(n == 0, d(1)).otherwise(n)
    return [(q / n).alias(name) for q, name in zip((x, y, z, w), SPLAT_QUAT)]


def read_splats(spark: SparkSession, path: str) -> DataFrame:
    """(file, splat_id, position, radii, quaternion, colour) of flat 32-byte records; splats are numbered from 0 in each file.

    Tasks read ranges of records (``byte_ranges``), so one file of any size is read in parallel.
    """
    return decode_splats(byte_ranges(spark, path, 0, RECORD))


def decode_splats(ranges: DataFrame) -> DataFrame:
    """The splats in ranges(file, first, n)."""
    import numpy as np
    import pandas as pd

    rec = np.dtype([("p", "<f4", 3), ("s", "<f4", 3), ("c", "u1", 4), ("q", "u1", 4)])

    def decode(batches):
        for pdf in batches:
            for file, first, n in zip(pdf["file"], pdf["first"], pdf["n"]):
                for i in range(first, first + n, ROWS_PER_BATCH):
                    a = np.frombuffer(read_at(file, i * RECORD, min(ROWS_PER_BATCH, first + n - i) * RECORD), rec)
                    q = (a["q"].astype("f8") - 128) / 128
                    cols = {n: a["p"][:, k].astype("f8") for k, n in enumerate(SPLAT_POS)} | {n: a["s"][:, k].astype("f8") for k, n in enumerate(SPLAT_RADII)}
                    cols |= {n: q[:, k] for n, k in (("qw", 0), ("qx", 1), ("qy", 2), ("qz", 3))} | {n: a["c"][:, k].astype("i4") for k, n in enumerate("rgba")}
                    yield pd.DataFrame({"file": file, "splat_id": np.arange(i, i + len(a)), **cols})

    types = "file string, splat_id long, " + ", ".join(f"{c} double" for c in SPLAT_POS + SPLAT_RADII + SPLAT_QUAT) + ", r int, g int, b int, a int"
    t = ranges.mapInPandas(decode, types)
    q = _unit(*[F.col(c) for c in SPLAT_QUAT])
    return t.select("file", "splat_id", *SPLAT_POS, *SPLAT_RADII, *q, *"rgba")


def decode_ply_columns(raw: DataFrame) -> DataFrame:
    """Trained parameters (x y z, scale_0..2, rot_0..3, f_dc_0..2, opacity) to usable ones; other columns ride along."""
    used = ["x", "y", "z", *[f"scale_{i}" for i in range(3)], *[f"rot_{i}" for i in range(4)], *[f"f_dc_{i}" for i in range(3)], "opacity"]
    keep = [c for c in raw.columns if c not in used]
    q = _unit(F.col("rot_1"), F.col("rot_2"), F.col("rot_3"), F.col("rot_0"))
    return raw.select(
        *keep, *[F.col(a).alias(b) for a, b in zip("xyz", SPLAT_POS)], *[F.exp(f"scale_{i}").alias(n) for i, n in enumerate(SPLAT_RADII)], *q,
        *[u8((F.col(f"f_dc_{i}") * SH_C0 + 0.5) * 255.0).alias(ch) for i, ch in enumerate("rgb")],
        u8(d(1) / (F.exp(-F.col("opacity")) + 1.0) * 255.0).alias("a"))


def dequantise_cloud(codes: DataFrame, scale_book: list[float], colour_book: list[float], mins, maxs) -> DataFrame:
    """Codebook cloud: codes(…, lo0..2, hi0..2, q0..3, s0..2, c0..3) in bytes to splats.

    Books have at most 256 entries (a byte indexes them), so they travel as array literals.
    """
    drop = [f"{n}{i}" for n, k in (("lo", 3), ("hi", 3), ("q", 4), ("s", 3), ("c", 4)) for i in range(k)]
    keep = [c for c in codes.columns if c not in drop]
    sbook, cbook = F.lit([float(v) for v in scale_book]), F.lit([float(v) for v in colour_book])

    def unlog(v: Column) -> Column:
        return F.signum(v) * (F.exp(F.abs(v)) - 1)

    def position(i: int) -> Column:
        v = d(F.col(f"lo{i}").bitwiseOR(F.shiftleft(f"hi{i}", 8))) / 65535.0
        return unlog(d(mins[i]) + d(maxs[i] - mins[i]) * v)

    t = codes.withColumn("_drop", F.greatest(F.lit(0), F.least(F.lit(3), F.col("q3") - 252)))
    part = [(d(f"q{i}") / 255.0 * 2 - 1) / (2**0.5) for i in range(3)]
    last = F.sqrt(F.greatest(d(0), d(1) - (part[0] * part[0] + part[1] * part[1] + part[2] * part[2])))

    def slot(k: int) -> Column:
        """Component k: the dropped one is rebuilt, the others keep their order."""
        e = F.when(F.col("_drop") == k, last)
        for dropped in range(4):
            if dropped != k:
                e = e.when(F.col("_drop") == dropped, part[k if k < dropped else k - 1])
        return e

    book = lambda b, n, c: F.get(b, F.least(F.lit(n - 1), F.col(c)))
    return t.select(
        *keep, *[position(i).alias(n) for i, n in enumerate(SPLAT_POS)], *[F.exp(book(sbook, len(scale_book), f"s{i}")).alias(n) for i, n in enumerate(SPLAT_RADII)],
        slot(1).alias("qx"), slot(2).alias("qy"), slot(3).alias("qz"), slot(0).alias("qw"),
        *[u8((book(cbook, len(colour_book), f"c{i}") * SH_C0 + 0.5) * 255.0).alias(ch) for i, ch in enumerate("rgb")], F.col("c3").alias("a"))
