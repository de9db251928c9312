"""Mesh text and binary formats as tables of triangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import jsround
from ..operators.mesh import face_normal
from ..schema import TRI
from .files import byte_ranges, read_at
from .lines import read_lines, running

HEAD, FACET = 84, 50  # bytes before the facets of a binary file, and of each
ROWS_PER_BATCH = 1 << 16  # facets decoded at a time

# fixed values: a number inside mesh text
NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"


def number_text(v: Column) -> Column:
    """A number the way mesh text spells it: no needless fraction, plain digits down to 1e-7."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    small = (F.abs(v) < 1e-3) & (F.abs(v) >= 1e-7)
    plain = F.regexp_replace(F.when(small, v).otherwise(F.lit(0.0)).cast("decimal(38,24)").cast("string"), "0+$", "")
    return F.when(whole, v.cast("long").cast("string")).when(small, plain).otherwise(v.cast("string"))


def facets_to_text(tris: DataFrame) -> DataFrame:
    """(mesh_id, tri_id, text): one ASCII facet block per triangle, normal from the winding."""
    point = lambda v: F.concat(F.lit("      vertex "), F.concat_ws(" ", *[number_text(F.col(f"{v}{k}")) for k in "xyz"]))
    head = F.concat(F.lit("  facet normal "), F.concat_ws(" ", *[number_text(c) for c in face_normal()]))
    text = F.concat_ws("\n", head, F.lit("    outer loop"), point("a"), point("b"), point("c"), F.lit("    endloop"), F.lit("  endfacet"))
    return tris.select("mesh_id", "tri_id", text.alias("text"))


def write_ascii_stl(tris: DataFrame, path: str) -> None:
    """One folder per mesh; blocks are self-contained, so parts can be written in parallel."""
    facets_to_text(tris).select("mesh_id", "text").write.partitionBy("mesh_id").text(path)


def mesh_to_obj_lines(tris: DataFrame) -> DataFrame:
    """(mesh_id, section, ord, text): three ``v`` lines and one 1-based ``f`` line per triangle.

    ``tri_id`` must be dense per mesh (0, 1, …); (section, ord) is the order of the lines in a file.
    """
    base = F.col("tri_id") * 3
    v = lambda p: F.concat(F.lit("v "), F.concat_ws(" ", *[number_text(F.col(f"{p}{k}")) for k in "xyz"]))
    row = lambda s, o, t: F.struct(F.lit(s).alias("section"), o.alias("ord"), t.alias("text"))
    face = F.concat(F.lit("f "), F.concat_ws(" ", *[(base + i).cast("string") for i in (1, 2, 3)]))
    rows = F.array(*[row(0, base + i, v(p)) for i, p in enumerate("abc")], row(1, F.col("tri_id"), face))
    return tris.select("mesh_id", F.explode(rows).alias("_r")).select("mesh_id", "_r.section", "_r.ord", "_r.text")


def read_ascii_stl(spark: SparkSession, path: str) -> DataFrame:
    """(file, tri_id, ax..cz): every number in order, nine at a time; normals and solid names are dropped first."""
    t = read_lines(spark, path)
    body = F.regexp_replace(F.col("line"), r"(?i)^[ \t]*(?:end)?solid.*", " ")
    body = F.regexp_replace(body, r"(?i)facet\s+normal.*", " ")
    body = F.regexp_replace(body, r"(?i)\bvertex\b", " ")
    t = t.withColumn("_n", F.regexp_extract_all(body, F.lit(f"({NUMBER})"), F.lit(1))).filter(F.size("_n") > 0)
    t = running(t.drop("line"), {"at": F.size("_n")})
    t = t.select("file", "at", F.posexplode("_n").alias("_i", "_v"))
    t = t.select("file", (F.col("at") + F.col("_i")).alias("_p"), F.col("_v").cast("double").alias("v"))
    t = t.groupBy("file", F.floor(F.col("_p") / 9).cast("long").alias("tri_id")).agg(
        *[F.max(F.when(F.col("_p") % 9 == i, F.col("v"))).alias(n) for i, n in enumerate(TRI)], F.count(F.lit(1)).alias("_c"))
    return t.filter("_c = 9").drop("_c")


def read_binary_stl(spark: SparkSession, path: str) -> DataFrame:
    """(file, tri_id, ax..cz): 84-byte header, then 50-byte facets; the smaller of declared and present counts.

    Tasks read ranges of facets (``byte_ranges``), each with the declared count from its file's header.
    """
    return decode_facets(byte_ranges(spark, path, HEAD, FACET))


def decode_facets(ranges: DataFrame) -> DataFrame:
    """The triangles in ranges(file, first, n)."""
    import numpy as np
    import pandas as pd

    rec = np.dtype([("normal", "<f4", 3), ("v", "<f4", 9), ("attr", "<u2")])

    def decode(batches):
        for pdf in batches:
            for file, first, n in zip(pdf["file"], pdf["first"], pdf["n"]):
                end = min(first + n, int.from_bytes(read_at(file, HEAD - 4, 4), "little"))
                for i in range(first, end, ROWS_PER_BATCH):
                    v = np.frombuffer(read_at(file, HEAD + i * FACET, min(ROWS_PER_BATCH, end - i) * FACET), rec)["v"].astype("f8")
                    yield pd.DataFrame({"file": file, "tri_id": np.arange(i, i + len(v)), **{c: v[:, k] for k, c in enumerate(TRI)}})

    return ranges.mapInPandas(decode, "file string, tri_id long, " + ", ".join(f"{c} double" for c in TRI))


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """(file, tri_id, ax..cz, uv, rgb): positions, optional texture coordinates and vertex colours.

    Relative indices need the number of vertices seen so far: running totals per file split.  Faces
    are fanned, their corners joined to vertices and texture points by index.
    """
    t = read_lines(spark, path).withColumn("line", F.trim(F.regexp_replace("line", r"[\s]+", " ")))
    t = t.withColumn("_k", F.substring_index("line", " ", 1)).filter("_k in ('v', 'vt', 'f') and instr(line, ' ') > 0")
    t = t.withColumn("_p", F.slice(F.split("line", " "), 2, 1 << 30)).drop("line")
    is_ = lambda k: F.when(F.col("_k") == k, F.lit(1)).otherwise(F.lit(0))
    fan = F.when(F.col("_k") == "f", F.greatest(F.lit(0), F.size("_p") - 2)).otherwise(F.lit(0))
    t = running(t, {"nv": is_("v"), "nt": is_("vt"), "nf": fan})
    num = lambda i: F.coalesce(F.regexp_extract(F.coalesce(F.get("_p", F.lit(i)), F.lit("")), f"^({NUMBER})", 1).try_cast("double"), F.lit(0.0))
    coloured = F.size("_p") >= 6
    v = t.filter("_k = 'v'").select("file", F.col("nv").alias("_vi"), *[num(i).alias(c) for i, c in enumerate("xyz")],
                                    *[F.when(coloured, num(3 + i)).otherwise(F.lit(1.0)).alias(c) for i, c in enumerate("rgb")], coloured.alias("_has"))
    vt = t.filter("_k = 'vt'").select("file", F.col("nt").alias("_ti"), num(0).alias("u"), num(1).alias("tv"))
    info = v.groupBy("file").agg(F.max("_has").alias("_any"), F.max(F.when(F.col("_has"), F.greatest("r", "g", "b"))).alias("_top"))
    face = t.filter("_k = 'f' and size(_p) >= 3").withColumn("_i", F.explode(F.sequence(F.lit(2), F.size("_p") - 1)))
    face = face.select("file", (F.col("nf") + F.col("_i") - 2).alias("tri_id"), "nv", "nt", F.posexplode(
        F.array(F.get("_p", F.lit(0)), F.get("_p", F.col("_i") - 1), F.get("_p", F.col("_i")))).alias("_c", "_s"))
    index = lambda part, n: F.when(part.try_cast("long") < 0, F.col(n) + part.try_cast("long")).otherwise(part.try_cast("long") - 1)
    parts = F.split("_s", "/")
    face = face.withColumns({"_vi": index(F.get(parts, F.lit(0)), "nv"), "_ti": index(F.nullif(F.get(parts, F.lit(1)), F.lit("")), "nt")})
    c = face.select("file", "tri_id", "_c", "_vi", "_ti").join(v, ["file", "_vi"], "left").join(vt, ["file", "_ti"], "left").join(info, "file", "left")
    scale = F.when(F.col("_top") > 1.001, F.lit(1.0)).otherwise(F.lit(255.0))
    at = lambda e, i: F.max(F.when(F.col("_c") == i, e))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    byte = lambda n: F.coalesce(jsround(F.col(n) * scale), F.lit(0))
    out = c.groupBy("file", "tri_id").agg(
        *[at(zero(k), i).alias(f"{p}{k}") for i, p in enumerate("abc") for k in "xyz"],
        F.array(*[at(zero(n), i) for i in range(3) for n in ("u", "tv")]).alias("_uv"), F.count("u").alias("_nuv"),
        F.array(*[at(byte(n), i) for i in range(3) for n in "rgb"]).alias("_rgb"), F.max("_any").alias("_any"))
    any_uv = out.groupBy("file").agg((F.max("_nuv") > 0).alias("_tex"))
    out = out.join(any_uv, "file")
    return out.select("file", "tri_id", *TRI, F.when(F.col("_tex"), F.col("_uv")).alias("uv"), F.when(F.col("_any"), F.col("_rgb")).alias("rgb"))
