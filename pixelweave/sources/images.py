"""Image corpora in and out: decoded image files, and pixels at rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.regrid import downscale_to_max
from ..schema import PIXEL, PIXEL_SCHEMA, images_of

TILE = 64  # side of a stored tile
ROWS_PER_FILE = 1 << 22
ROWS_PER_BATCH = 1 << 18  # pixels handed over at a time


def read_images(spark: SparkSession, path: str, max_size: int = 0) -> tuple[DataFrame, DataFrame]:
    """(images, pixels) of a folder of image files; ``images`` also keeps the file name and whether it could be decoded.

    Spark's image source decodes in the executors (bytes in B, G, R(, A) order, row by row); the
    bytes are unpacked in Arrow batches of whole pixels.  The id is a hash of the file name.
    Files that cannot be decoded are in ``images`` too, without a size and with ``readable`` false.
    """
    import numpy as np
    import pyarrow as pa

    src = spark.read.format("image").load(path).select("image.*").withColumn("image_id", F.xxhash64("origin"))
    fine = F.col("width") > 0

    def unpack(batches):
        for batch in batches:
            for row in batch.to_pylist():
                k, w, h = row["nChannels"], row["width"], row["height"]
                v = np.frombuffer(row["data"], "u1").reshape(-1, k)
                rgb = (v[:, 2], v[:, 1], v[:, 0]) if k >= 3 else (v[:, 0],) * 3
                a = v[:, 3] if k == 4 else np.full(len(v), 255)
                for i in range(0, len(v), ROWS_PER_BATCH):
                    s = slice(i, i + ROWS_PER_BATCH)
                    pos = np.arange(i, min(len(v), i + ROWS_PER_BATCH))
                    n = len(pos)
                    cols = [np.full(n, row["image_id"], "i8"), *[np.full(n, c, "i4") for c in (0, w, h)], pos % w, pos // w, *[c[s] for c in rgb], a[s]]
                    yield pa.record_batch([pa.array(c.astype("i8" if j == 0 else "i4")) for j, c in enumerate(cols)], names=PIXEL)

    p = src.filter(fine).select("image_id", "nChannels", "width", "height", "data").mapInArrow(unpack, PIXEL_SCHEMA)
    size = [F.when(fine, F.col(c)).alias(n) for c, n in (("width", "w"), ("height", "h"))]
    images = src.select("image_id", F.lit(0).alias("frame"), *size, "origin", fine.alias("readable"))
    if max_size > 0:
        p = downscale_to_max(p, max_size)
        images = images.select("image_id", "frame", "origin", "readable").join(images_of(p).drop("frame"), "image_id", "left")
    return images, p


def morton(x: Column, y: Column) -> Column:
    """The bits of two tile numbers (16 each) by turns: neighbours in the plane mostly are neighbours in this order."""
    bit = lambda v, k, to: F.shiftleft(F.shiftright(v.cast("long"), k).bitwiseAND(1), to)
    return reduce(lambda u, v: u.bitwiseOR(v), [bit(v, k, 2 * k + o) for k in range(16) for o, v in enumerate((x, y))])


def write_pixels(p: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE, mode: str = "errorifexists") -> None:
    """Parquet in ranges of (image, frame, tile): a file holds neighbouring tiles of few images, or part of one.

    Tiles of ``TILE`` pixels a side lie in Morton order, so the ranges of x and y in a file's and row group's footer are narrow and
    a reader of part of an image skips the rest. The number of files comes from the number of pixels.
    """
    t = p.select(*PIXEL).withColumn("_tile", morton(F.floor(F.col("x") / TILE), F.floor(F.col("y") / TILE)))
    key = ["image_id", "frame", "_tile", "y", "x"]
    files = max(1, -(-p.count() // rows_per_file))
    t.repartitionByRange(files, *key).sortWithinPartitions(*key).drop("_tile").write.mode(mode).parquet(path)


def read_pixels(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None) -> DataFrame:
    """The stored pixels, or those with x0 <= x < x1 and y0 <= y < y1 of ``box``; the bounds reach the footers."""
    t = spark.read.parquet(path).select(*PIXEL)
    if box is None:
        return t
    x0, y0, x1, y1 = box
    return t.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))


def prompt_table(df: DataFrame, text: str, column: str = "text") -> DataFrame:
    """A literal text on every row."""
    return df.withColumn(column, F.lit(text))
