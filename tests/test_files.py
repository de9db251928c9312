"""File formats: written by hand, read in parallel."""

import hashlib
import struct
import time
from functools import reduce

import numpy as np
from helpers import noise, pixels, raster

from pixelweave.operators import color, enrich
from pixelweave.sources import cloudio, files, generators, graphio, images, meshio
from pixelweave.streaming import streams
from pyspark.sql import functions as F


def bmp(a):
    """A 24-bit bitmap, bottom row first."""
    h, w, _ = a.shape
    pad = (-w * 3) % 4
    body = b"".join(a[y, :, 2::-1].astype("u1").tobytes() + b"\0" * pad for y in range(h - 1, -1, -1))
    return b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body


def test_read_images(spark, tmp_path):
    a = noise(5, 7, 1, opaque=True)
    (tmp_path / "one.bmp").write_bytes(bmp(a))
    im, p = images.read_images(spark, str(tmp_path))
    assert (next(iter(raster(p).values())) == a).all()
    assert (im.first().w, im.first().h) == (7, 5)
    im, p = images.read_images(spark, str(tmp_path), 3)
    assert next(iter(raster(p).values())).shape == (2, 3, 4) and im.first().w == 3
    (tmp_path / "two.bmp").write_bytes(b"BM no picture")
    for most in (0, 3):
        im, p = images.read_images(spark, str(tmp_path), most)
        told = {r.origin[-7:]: (r.readable, r.w is None) for r in im.collect()}
        assert told == {"one.bmp": (True, False), "two.bmp": (False, True)} and len(raster(p)) == 1


def test_pixels_at_rest(spark, tmp_path, monkeypatch):
    """Pixels come back, in files sized from the data, and a crop meets few of their footers."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(images, "TILE", 4)
    a, b = noise(64, 48, 2), noise(3, 5, 3)
    images.write_pixels(pixels(spark, a).union(pixels(spark, b, 2)), str(tmp_path / "px"), 128)
    back = raster(images.read_pixels(spark, str(tmp_path / "px")))
    assert (back[(1, 0)] == a).all() and (back[(2, 0)] == b).all()
    x0, y0, x1, y1 = box = (20, 30, 28, 38)
    crop = images.read_pixels(spark, str(tmp_path / "px"), box).collect()
    assert len(crop) == 64 and all((r.r, r.a) == (a[r.y, r.x, 0], a[r.y, r.x, 3]) for r in crop)
    met, parts = 0, list((tmp_path / "px").glob("part-*"))
    for f in parts:
        g = pq.ParquetFile(f).metadata.row_group(0)
        at = {g.column(k).path_in_schema: g.column(k).statistics for k in range(g.num_columns)}
        met += at["x"].min < x1 and at["x"].max >= x0 and at["y"].min < y1 and at["y"].max >= y0
    assert len(parts) > 15 and met * 2 < len(parts)


def test_one_large_file_is_read_in_ranges(spark, tmp_path, monkeypatch):
    """A file of 3 GB is many ranges, the last of which is read alone; small ranges give the same rows as one."""
    big = tmp_path / "big.splat"
    with open(big, "wb") as f:
        f.truncate(3 << 30)
        f.seek((3 << 30) - 32)
        f.write(struct.pack("<6f8B", *range(6), 1, 2, 3, 4, 255, 128, 128, 128))
    ranges = files.byte_ranges(spark, str(big), 0, 32)
    assert ranges.count() == 48 and ranges.rdd.getNumPartitions() == 48
    last = cloudio.decode_splats(ranges.filter(f"first + n = {(3 << 30) // 32}")).filter("g = 2").collect()
    assert [(r.splat_id, r.px, r.sz) for r in last] == [((3 << 30) // 32 - 1, 0.0, 5.0)]
    monkeypatch.setattr(files, "RANGE", 150)
    facets = [struct.pack("<12fH", 0, 0, 1, *[k] * 9, 0) for k in range(20)]
    for name, declared in (("a", 20), ("b", 4)):
        (tmp_path / f"{name}.stl").write_bytes(b"x" * 80 + struct.pack("<I", declared) + b"".join(facets) + b"rest")
    (tmp_path / "c.stl").write_bytes(b"short")
    got = sorted((r.file[-5], r.tri_id, r.ax) for r in meshio.read_binary_stl(spark, str(tmp_path / "*.stl")).collect())
    assert got == [("a", k, k) for k in range(20)] + [("b", k, k) for k in range(4)]


def test_flat_splat_records(spark, tmp_path):
    rec = struct.pack("<6f8B", 1, 2, 3, 0.5, 0.25, 0.125, 9, 8, 7, 6, 255, 128, 128, 128)
    (tmp_path / "c.splat").write_bytes(rec * 3)
    rows = cloudio.read_splats(spark, str(tmp_path / "c.splat")).orderBy("splat_id").collect()
    assert [r.splat_id for r in rows] == [0, 1, 2]
    assert (rows[0].px, rows[0].sz, rows[0].r, rows[0].a, rows[0].qw, rows[0].qx) == (1, 0.125, 9, 6, 1, 0)


def test_binary_stl_takes_the_smaller_count(spark, tmp_path):
    facet = struct.pack("<12fH", 0, 0, 1, *range(9), 0)
    (tmp_path / "m.stl").write_bytes(b"solid".ljust(80) + struct.pack("<I", 5) + facet * 2 + b"junk")
    rows = meshio.read_binary_stl(spark, str(tmp_path / "m.stl")).collect()
    assert len(rows) == 2 and (rows[0].ax, rows[0].cz) == (0, 8)


def test_obj_polygons_relative_indices_and_colours(spark, tmp_path):
    (tmp_path / "m.obj").write_text(
        "# c\no thing\nv 0 0 0 255 0 0\nv 1 0 0 0 255 0\nv 1 1 0 0 0 255\nv 0 1 0 9 9 9\nvt 0 0\nvt 1 1\n"
        "f 1/1 2/2 3 4\nv 5 5 5\nf -1 -2 -3\nf 1 2 99\n")
    rows = {r.tri_id: r for r in meshio.read_obj(spark, str(tmp_path / "m.obj")).collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert (rows[1].ax, rows[1].bx, rows[1].by, rows[1].cy) == (0, 1, 1, 1)
    assert rows[0].rgb == [255, 0, 0, 0, 255, 0, 0, 0, 255] and rows[0].uv == [0, 0, 1, 1, 0, 0]
    assert (rows[2].ax, rows[2].bx, rows[2].by, rows[2].cx) == (5, 0, 1, 1)
    assert (rows[3].cx, rows[3].rgb[6:]) == (0, [0, 0, 0])


def test_ascii_stl_ignores_names_and_normals(spark, tmp_path):
    (tmp_path / "m.stl").write_text("solid Part2\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\n vertex 1e0 0 .5\nvertex -1 2. 3\nendloop\nendfacet\nendsolid Part2\n")
    rows = meshio.read_ascii_stl(spark, str(tmp_path / "m.stl")).collect()
    assert len(rows) == 1 and (rows[0].bx, rows[0].bz, rows[0].cx, rows[0].cz) == (1, 0.5, -1, 3)


def test_saved_graph_defaults(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"nodes":[{"id":"a","type":"t","config":{"k":[1]}}]}')
    graphs, nodes, edges = graphio.read_saved_graph(spark, str(tmp_path))
    assert (graphs.first().saved_version, graphs.first().version) == (0, 1)
    assert nodes.first().config == '{"k":[1]}' and edges.count() == 0


def test_stream_equals_batch(spark, tmp_path):
    p = pixels(spark, noise(4, 4, 3))
    p.repartition(4).write.parquet(str(tmp_path / "in"))
    s = streams.read_pixel_stream(spark, str(tmp_path / "in"), 1)
    streams.stream_histogram(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    from pixelweave.operators import stats

    key = lambda df: sorted(map(tuple, df.select("image_id", "channel", "bin", "n").collect()))
    assert key(streams.latest_counts(spark, str(tmp_path / "out"))) == key(stats.histogram(p))
    streams.stream_colour(s, color.invert, str(tmp_path / "o2"), str(tmp_path / "c2")).awaitTermination()
    assert (raster(spark.read.parquet(str(tmp_path / "o2")))[(1, 0)] == raster(color.invert(p))[(1, 0)]).all()


def test_wide_histogram_drawing(spark):
    from pixelweave.operators import stats

    a = np.zeros((2, 2, 4), int)
    a[..., 3] = 255
    got = raster(generators.histogram_image(stats.histogram(pixels(spark, a)), 32, 16))[(1, 0)]
    assert got[0, 0].tolist() == [220, 220, 224, 255] and got[0, 31].tolist() == [20, 20, 24, 255]


def test_cache_is_joined_where_it_lies(spark, tmp_path):
    """A bucketed cache takes no shuffle in the join, keeps its rows over a reopening, and misses are sent once a key."""
    path = f"{tmp_path}/it's answers"
    known = [(hashlib.sha256(f'm|{{"seed":{k}}}'.encode()).hexdigest(), f"a{k}") for k in range(0, 40, 2)]
    enrich.append_cache(spark.createDataFrame(known[:10], "key string, answer string"), path, 4)
    enrich.append_cache(spark.createDataFrame([*known[10:], (None, "x"), ("y", None)], "key string, answer string"), path, 4)
    spark.sql(f"DROP TABLE {enrich._cache_name(path)}")
    cache = enrich.open_cache(spark, path, 4)
    asked = [(k, f'{{"seed":{k % 30}}}') for k in range(60)] + [(100, '{"a":1}'), (101, '{"a":1}')]
    requests = spark.createDataFrame(asked, "request_id long, request string")
    hits, misses = enrich.split_cache(requests, cache, "m")
    assert sorted((r.request_id, r.answer) for r in hits.collect()) == [(k, f"a{k % 30}") for k in range(60) if k % 2 == 0]
    assert sorted((r.request_id, r.request) for r in misses.collect()) == [(k, f'{{"seed":{k}}}') for k in range(1, 30, 2)] + asked[-2:]
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = requests.withColumn("key", enrich.request_key(F.lit("m"), "request")).join(cache, "key", "left")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan and "Bucketed: true" in plan  # the requests' side alone is shuffled


def test_images_close_when_their_pixels_are_complete(spark, tmp_path):
    """Pixels of three images over several batches: each complete one comes out once and is forgotten, the rest waits for its timer."""
    from pixelweave.operators import stats

    p = reduce(lambda a, b: a.union(b), [pixels(spark, noise(6, 5, k), k) for k in range(3)])
    late = (F.col("image_id") == 2) & (F.col("y") == 5)
    p.filter(~late).repartition(4).write.parquet(str(tmp_path / "in"))
    run = lambda: streams.stream_closed_histograms(streams.read_pixel_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(100)
    key = lambda df: sorted(map(tuple, df.select("image_id", "channel", "bin", "n").collect()))
    assert run()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("not complete").isEmpty() and key(got) == key(stats.histogram(p.filter("image_id < 2")))
    p.filter(late).write.mode("append").parquet(str(tmp_path / "in"))
    assert run()
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(stats.histogram(p))  # nothing came out twice


def test_an_incomplete_image_is_closed_by_its_timer(spark, tmp_path):
    from pixelweave.operators import stats

    p = pixels(spark, noise(4, 4, 1)).filter("y < 3")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    pixels(spark, noise(2, 2, 5), 9).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.read.schema("image_id long, frame int, channel string, bin int, n long, complete boolean").parquet(str(tmp_path / "out"))
    q = streams.stream_closed_histograms(streams.read_pixel_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), 1)
    try:
        for _ in range(100):
            time.sleep(0.5)
            if (tmp_path / "out" / "_spark_metadata").exists() and read().select("image_id").distinct().count() == 2:
                break
    finally:
        q.stop()
    got = read()
    key = lambda df: sorted(map(tuple, df.select("image_id", "channel", "bin", "n").collect()))
    assert key(got.filter("not complete")) == key(stats.histogram(p)) and {r.image_id for r in got.filter("complete").collect()} == {9}
