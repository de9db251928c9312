"""Table layouts shared by every operator.

A raster corpus is ONE table with one row per pixel.  The image size (``w``, ``h``) is carried on
every row: constant columns cost next to nothing in Parquet, and no operator then has to join a
separate size table just to find an image border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMG = ["image_id", "frame"]
SIZE = ["w", "h"]
POS = ["x", "y"]
RGB = ["r", "g", "b"]
RGBA = ["r", "g", "b", "a"]
PIXEL = IMG + SIZE + POS + RGBA

PIXEL_SCHEMA = T.StructType(
    [T.StructField("image_id", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ["frame", *SIZE, *POS, *RGBA]]
)
IMAGE_SCHEMA = T.StructType(
    [T.StructField("image_id", T.LongType())] + [T.StructField(c, T.IntegerType()) for c in ["frame", *SIZE]]
)

TRI = ["ax", "ay", "az", "bx", "by", "bz", "cx", "cy", "cz"]
TRIANGLE_SCHEMA = T.StructType(
    [T.StructField("mesh_id", T.LongType()), T.StructField("tri_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in TRI]
)
SPLAT_POS = ["px", "py", "pz"]
SPLAT_RADII = ["sx", "sy", "sz"]
SPLAT_QUAT = ["qx", "qy", "qz", "qw"]
SPLAT_SCHEMA = T.StructType(
    [T.StructField("cloud_id", T.LongType()), T.StructField("splat_id", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in SPLAT_POS + SPLAT_RADII + SPLAT_QUAT]
    + [T.StructField(c, T.IntegerType()) for c in RGBA]
)


def require(df: DataFrame, cols: list[str], what: str) -> DataFrame:
    """Fail early, on the driver, when an operator is given a table of the wrong shape."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}; has {df.columns}")
    return df


def images_of(pixels: DataFrame) -> DataFrame:
    """One row per (image, frame) with its size. The filter reaches the Parquet scan."""
    return pixels.filter((F.col("x") == 0) & (F.col("y") == 0)).select(*IMG, *SIZE)


SPREAD_ROWS = 1 << 11


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a small table out by key before its rows are expanded to pixels, splats or facets.

    Every core has work, and a task gets about ``SPREAD_ROWS`` rows whatever the size of the table: what a later step keeps per key
    (a histogram has up to 768 counters an image) does not grow with the input. Parquet tells the count from its footers.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(n, *keys)


def large(df: DataFrame) -> DataFrame:
    """Marks a side of a join that grows with the pixels.

    Spark's estimate of a table leaves out what ``explode`` adds, so it may plan to broadcast all pixels through the driver,
    and adaptive execution does not take that back. A merge join is dealt out by key and still splits skewed keys.
    """
    return df.hint("merge")


def pack_rgba(suffix: str = "") -> Column:
    """The four bytes of a colour in one int: a shuffled pixel has one column of colour instead of four."""
    r, g, b, a = (F.col(f"{ch}{suffix}").cast("int") for ch in RGBA)
    return F.shiftleft(r, 24).bitwiseOR(F.shiftleft(g, 16)).bitwiseOR(F.shiftleft(b, 8)).bitwiseOR(a)


def unpack_rgba(packed: str) -> dict[str, Column]:
    return {ch: F.shiftrightunsigned(packed, k).bitwiseAND(F.lit(255)) for ch, k in zip(RGBA, (24, 16, 8, 0))}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Honour the cluster's shared checkpoint folder; fall back to a scratch one in tests only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder: iterative operators cut lineage there")
    import tempfile

    sc.setCheckpointDir(tempfile.mkdtemp(prefix="pixelweave-checkpoint-"))


#: Rounds of more bytes than this are not broadcast where ``apart`` is asked for.
APART_BYTES = 1 << 18


def cut(df: DataFrame, apart: bool = False) -> DataFrame:
    """Cut lineage between the rounds of an iterative operator.

    The round is written once to the shared checkpoint folder and read back, so a lost executor
    re-reads a table instead of replaying all rounds, and the next plan knows the real size.
    With ``apart`` a round of more than ``APART_BYTES`` is joined by merging: each broadcast goes through the driver, a loop
    makes some in every round, and Spark compares the size of compressed files with its limit, so their sum would grow with the input.
    """
    import uuid

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if not apart:
        return out
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return large(out) if size > APART_BYTES else out


def cut_apart(df: DataFrame) -> DataFrame:
    """``cut`` for loops over graphs; small graphs keep their broadcasts."""
    return cut(df, apart=True)
