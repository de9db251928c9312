"""Plans and partitions that have to hold on larger tables: what is broadcast, shuffled and kept per task."""

import numpy as np
from helpers import noise, pixels, raster
from pyspark.sql import functions as F

from pixelweave import schema
from pixelweave.operators import neighborhood, regrid
from pixelweave.schema import IMG


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def expanded(spark, n=6):
    """Images made by explode, whose size Spark underestimates, with a constant frame."""
    t = spark.range(n).select(F.col("id").alias("image_id"), F.lit(0).alias("frame"), F.lit(16).alias("w"), F.lit(16).alias("h"),
                              F.explode(F.sequence(F.lit(0), F.lit(255))).alias("i"))
    v = (F.col("i") * 37 + F.col("image_id") * 11) % 256
    return t.select(*IMG, "w", "h", (F.col("i") % 16).cast("int").alias("x"), F.shiftright("i", 4).alias("y"),
                    *[((v + k) % 256).cast("int").alias(ch) for k, ch in enumerate("rgba")])


def test_sampled_pixels_are_not_broadcast(spark):
    p = expanded(spark)
    pts = spark.range(6).select(F.col("id").alias("image_id"), F.lit(0).alias("frame"), F.lit(16).alias("sw"), F.lit(16).alias("sh"), F.lit(0.5).alias("u"), F.lit(0.5).alias("v"))
    t = regrid.sample_at(pts, p)
    assert "BroadcastHashJoin" not in plan(t)
    assert t.count() == 6


def test_bands_of_a_constant_frame_are_shuffled_once(spark):
    for f in (lambda p: neighborhood.dilate(p, 2), neighborhood.sobel, lambda p: neighborhood.box_blur(p, 5)):
        assert plan(f(expanded(spark))).count("Exchange hashpartitioning") == 1


def test_bands_keep_frames_apart(spark):
    a, b = noise(70, 5, 1), noise(70, 5, 2)
    both = pixels(spark, a, 1, 0).union(pixels(spark, b, 1, 1))
    got = raster(neighborhood.dilate(both, 1))
    for frame, src in ((0, a), (1, b)):
        pad = np.pad(src, ((1, 1), (1, 1), (0, 0)), mode="edge")
        want = np.max([pad[i:i + 70, j:j + 5] for i in range(3) for j in range(3)], axis=0)
        assert (got[1, frame] == want).all()


def test_packed_colours_come_back(spark):
    df = spark.createDataFrame([(255, 128, 0, 255), (0, 0, 0, 0), (1, 2, 3, 4), (127, 255, 254, 128)], "r int, g int, b int, a int")
    back = df.select(schema.pack_rgba().alias("_p"), *[F.col(ch).alias(f"_{ch}") for ch in "rgba"]).withColumns(schema.unpack_rgba("_p"))
    assert back.filter("r <> _r or g <> _g or b <> _b or a <> _a").count() == 0


def test_spread_gives_a_task_a_bounded_number_of_rows(spark):
    n = 20 * 2048
    assert schema.spread(spark.range(n), "id").rdd.getNumPartitions() >= 20
    assert schema.spread(spark.range(n, numPartitions=64), "id").rdd.getNumPartitions() == 20


def test_obj_files_are_written_from_a_stated_number_of_partitions(spark, monkeypatch):
    """Without it adaptive execution cut large meshes into several files (seen at 600 000 triangles), each with its own count of lines."""
    import pytest
    from pyspark.sql.readwriter import DataFrameWriter

    from pixelweave.plans import catalog_shapes as cs

    class Written(Exception):
        pass

    def text(self, path, *args):
        raise Written(plan(self._df))

    monkeypatch.setattr(DataFrameWriter, "text", text)
    with pytest.raises(Written) as seen:
        cs._obj(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_COL" not in str(seen.value) and "REPARTITION_BY_NUM" in str(seen.value).split("FileScan")[0]


def test_joined_pixels_are_not_broadcast(spark):
    from pixelweave.operators import compose

    p = expanded(spark)
    for t in (neighborhood.gloss_preview(p, p, same_size=True), regrid.seamless_tile(p, 0.5), compose.paste(p, p)):
        assert "BroadcastHashJoin" not in plan(t)


def test_samples_from_tiles_are_those_of_a_join_by_pixel(spark):
    p = pixels(spark, noise(70, 131, 3), 1, 0).union(pixels(spark, noise(70, 131, 4), 1, 2))
    pts = spark.range(4000).select(F.col("id").alias("pid"), F.lit(1).cast("long").alias("image_id"), (F.col("id") % 2 * 2).cast("int").alias("frame"),
                                   F.lit(131).alias("sw"), F.lit(70).alias("sh"), (F.rand(1) * 1.1 - 0.05).alias("u"), (F.rand(2) * 1.1 - 0.05).alias("v")).localCheckpoint()
    want = regrid.sample_at(pts, p).select("pid", *"rgba")
    tiles = regrid.pixel_tiles(p).select("image_id", regrid.tile_code("frame", "_tx", "_ty").alias("_code"), "_px")
    got = regrid.sampled(regrid.sample_in_tiles(pts.withColumn("_view", F.col("frame"))).join(tiles, ["image_id", "_code"])).select("pid", *"rgba")
    assert tiles.count() == 2 * 3 * 2
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pixels_of_a_sheet_are_not_shuffled(spark):
    from pixelweave.operators import multiview

    t = multiview.interlace_grid(expanded(spark), multiview.Lens(width_mm=10.0, ppi=90.0, lpi=20.0), 1, 1)
    shuffles = [line for line in plan(t).splitlines() if "Exchange hashpartitioning" in line]
    assert shuffles and not any("_qx" in line or " y#" in line for line in shuffles)
    assert t.count() == t.select("image_id", "x", "y").distinct().count() > 6 * 16 * 16


def test_despeckle_shuffles_runs_and_broadcasts_no_labels(spark, monkeypatch):
    from pixelweave.operators import components

    seen = []
    monkeypatch.setattr(components, "cut", lambda df: seen.append(plan(df)) or schema.cut(df))
    t = components.despeckle(expanded(spark), 4, 3)
    assert t.count() == 6 * 256
    assert not any("sequence(x0" in p for p in seen)
    lines = plan(t).splitlines()
    made, moved = ([k for k, line in enumerate(lines) if s in line] for s in ("sequence(x0", "Exchange hashpartitioning"))
    assert made and moved and max(made) < min(moved)
    assert not any("BroadcastHashJoin" in p for p in [*seen, plan(t)])


def test_despeckle_of_several_tiles_is_that_of_one(spark):
    from pixelweave.operators import components

    p = pixels(spark, np.repeat(noise(23, 37, 6)[..., :1] // 90 * 127, 4, 2), 1).union(pixels(spark, np.repeat(noise(9, 50, 7)[..., :1] // 90 * 127, 4, 2), 2))
    want = raster(components.despeckle(p, 7, 5))
    got = raster(components.despeckle(p, 7, 5, tile=3))
    assert got.keys() == want.keys() and all((got[k] == want[k]).all() for k in want)


def test_large_rounds_of_graph_loops_are_not_broadcast(spark):
    from pixelweave.operators import digraph as m

    small = spark.range(100).select(F.col("id").alias("s"), F.xxhash64("id").alias("t"))
    big = m.cut(spark.range(60_000).select(F.col("id").alias("s"), F.xxhash64("id").alias("t")))
    assert "BroadcastHashJoin" not in plan(big.join(big.select(F.col("t").alias("s")), "s"))
    assert "BroadcastHashJoin" not in plan(m.cut(small).join(big.select("s"), "s", "left_semi"))
    assert "BroadcastHashJoin" in plan(m.cut(small).join(m.cut(small).select(F.col("t").alias("s")), "s"))


def test_depth_views_shuffle_a_fanned_out_pixel_once(spark):
    from pixelweave.operators import viewsynth as vs

    p = expanded(spark)
    t = vs.depth_views(p, p, views=3, cone_deg=40.0, width_mm=20.0, prepared=True)
    moves = [line for line in plan(t).splitlines() if "Exchange" in line and "Reused" not in line]
    # the table of the eyes' pixels, read by two steps that share its shuffle at run time, and a marker a line
    assert len(moves) == 3 and not any(" px#" in line or "px#" in line.split("hashpartitioning")[-1] for line in moves)
    assert "Join" not in plan(t)
    assert t.count() == 6 * 256 * 3


def test_candidates_of_one_pass_are_those_of_two(spark):
    from pixelweave.operators import viewsynth as vs

    p = pixels(spark, noise(9, 21, 8), 1).union(pixels(spark, noise(5, 40, 9), 2))
    m = vs.moved(p, p, [-70.0, 0.0, 45.0], width_mm=20.0, distance=400.0, depth_mm=9.0, setback=2.0)
    want = vs.warp_forward(m).union(vs.warp_gap_fill(m))
    got = vs.warp_candidates(m)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_decided_parts_are_dealt_out(spark):
    """Parts of few bytes do not all go to one task, and a part stays whole and in order."""
    from pixelweave.operators import digraph

    rows = spark.range(64).select((F.col("id") % 16).alias("part"), F.col("id").alias("ord"), (-F.col("id")).alias("_k"))
    got = digraph._dealt(rows, 64).select("part", "_k", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at")).collect()
    assert len({(r.part, r.task) for r in got}) == 16 and len({r.task for r in got}) > 1
    order = sorted(got, key=lambda r: r["at"])
    assert [(r.part, r["_k"]) for r in order] == [(r.part, r["_k"]) for r in sorted(order, key=lambda r: (r.task, r.part, r["_k"]))]


def test_linework_shuffles_tiles(spark):
    from pixelweave.plans import recipes

    t = recipes.linework(expanded(spark))
    moves = [line for line in plan(t).splitlines() if "Exchange hashpartitioning" in line]
    assert moves and not any(s in line for line in moves for s in ("_band#", " x#", " y#", "(x#"))
    assert t.count() == 6 * 256


def test_operators_on_tiles_across_their_borders(spark):
    a, b = noise(70, 37, 1), noise(9, 101, 2)
    p = pixels(spark, a, 1, 0).union(pixels(spark, b, 1, 2))

    def brute(src, reach, best):
        pad = np.pad(src, ((reach, reach), (reach, reach), (0, 0)), mode="edge")
        return best([pad[i:i + src.shape[0], j:j + src.shape[1]] for i in range(2 * reach + 1) for j in range(2 * reach + 1)], axis=0)

    def edges(src):
        v = np.pad(0.299 * src[..., 0] + 0.587 * src[..., 1] + 0.114 * src[..., 2], 1, mode="edge")
        at = lambda i, j: v[1 + j:v.shape[0] - 1 + j, 1 + i:v.shape[1] - 1 + i]
        gx = -at(-1, -1) + at(1, -1) - at(-1, 0) * 2 + at(1, 0) * 2 - at(-1, 1) + at(1, 1)
        gy = -at(-1, -1) - at(0, -1) * 2 - at(1, -1) + at(-1, 1) + at(0, 1) * 2 + at(1, 1)
        mag = np.rint(np.clip(np.sqrt(gx * gx + gy * gy), 0, 255)).astype(int)
        return np.stack([mag, mag, mag, np.full_like(mag, 255)], axis=-1)

    cases = [(neighborhood.sobel(p), edges), (neighborhood.dilate(neighborhood.sobel(p), 2), lambda s: brute(edges(s), 2, np.max)),
             (neighborhood.open_close(p, 4), lambda s: brute(brute(s, 4, np.min), 4, np.max)), (neighborhood.erode(p, 20), lambda s: brute(s, 20, np.min))]
    for got, want in cases:
        got = raster(got)
        assert (got[1, 0] == want(a)).all() and (got[1, 2] == want(b)).all()


def test_an_image_that_is_there_twice_is_one_sequence_of_pixels(spark):
    """Copies get different edges; what comes next takes them in the order of the rows, as windows do."""
    from pixelweave.operators.bands import extreme, in_bands, out_of_bands

    one = pixels(spark, noise(9, 13, 11, opaque=True), 1).coalesce(1)
    edges = neighborhood.sobel(one.union(one).coalesce(1))
    t = in_bands(edges.localCheckpoint(), 1)
    for axis in ("row", "column"):
        t = extreme(t, list("rgba"), 1, axis, "max")
    want = out_of_bands(t, 1).select(edges.columns)
    assert sorted(map(tuple, neighborhood.dilate(edges, 1).collect())) == sorted(map(tuple, want.collect()))


def test_gloss_is_joined_tile_by_tile_as_pixel_by_pixel(spark):
    """Pixels without a mask are matt, repeated ones of the mask repeat the art, and of images without an id nothing is joined."""
    from pixelweave.operators.compose import KEY
    from pixelweave.operators.tiles import matched, packed_colour

    art = pixels(spark, noise(40, 37, 3), 1).union(pixels(spark, noise(5, 4, 4), 2)).union(pixels(spark, noise(3, 3, 5), 3).withColumn("image_id", F.lit(None).cast("long")))
    mask = pixels(spark, noise(40, 37, 6), 1).filter("x <> 33")
    mask = mask.union(mask.filter("y = 7")).union(art.filter("image_id is null"))
    cols = [*art.columns, *[f"m{ch}" for ch in "rgba"]]
    want = art.join(mask.select(*KEY, *[F.col(ch).alias(f"m{ch}") for ch in "rgba"]), KEY, "left").select(cols)
    got = matched(art, mask).select(*art.columns, *[e.alias(f"m{ch}") for ch, e in packed_colour("_other").items()])
    order = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert got.columns == cols and order(got) == order(want)


def test_sample_at_joins_tiles_and_gives_what_a_join_by_pixel_gives(spark):
    """Two frames of several tiles, and an image that is there three times."""
    from pixelweave.functions.core import u8

    p = pixels(spark, noise(70, 131, 3), 1, 0).union(pixels(spark, noise(70, 131, 4), 1, 2)).union(pixels(spark, noise(66, 9, 5), 2))
    small = pixels(spark, noise(5, 6, 6), 3).localCheckpoint()
    p = p.union(small).union(small).union(small)
    sizes = spark.createDataFrame([(1, 0, 131, 70), (1, 2, 131, 70), (2, 0, 9, 66), (3, 0, 6, 5), (4, 0, 6, 5), (None, 0, 6, 5)], "image_id long, frame int, sw int, sh int")
    pts = spark.range(1500).crossJoin(sizes).select(F.col("id").alias("pid"), *sizes.columns, F.when(F.col("id") > 3, F.rand(1) * 1.2 - 0.1).alias("u"), (F.rand(2) * 1.2 - 0.1).alias("v")).localCheckpoint()
    t = regrid.sample_at(pts, p).select(*pts.columns, *"rgba")
    moves = [line for line in plan(t).splitlines() if "Exchange hashpartitioning" in line]
    assert moves and not any(s in line for line in moves for s in ("_qx#", "_band#"))
    q = regrid.with_quad(p).drop("w", "h").withColumnsRenamed({"x": "_x", "y": "_y"})
    fx, fy = (F.greatest(F.lit(0.0), F.least(F.col(n) - 1.0, F.col(c) * F.col(n) - 0.5)) for c, n in (("u", "sw"), ("v", "sh")))
    want = pts.withColumns({"_fx": fx, "_fy": fy}).withColumns({"_x": F.floor("_fx").cast("int"), "_y": F.floor("_fy").cast("int")}).join(q, [*IMG, "_x", "_y"])
    want = want.select(*pts.columns, *[u8(regrid.bilinear(ch, F.col("_fx") - F.col("_x"), F.col("_fy") - F.col("_y"))).alias(ch) for ch in "rgba"])
    order = lambda t: sorted(map(tuple, t.collect()), key=repr)
    assert order(t) == order(want) and t.filter("image_id = 3").count() == 4500


def test_sheets_of_small_views_tell_their_pixels_once(spark):
    """What a tile of the sheet needs is known without its pixels where every view is one tile; else they are asked."""
    from pixelweave.operators import multiview

    views = "map(0, named_struct('w', 9, 'h', 9), 3, named_struct('w', 64, 'h', 2)) as _views"
    sheet = spark.range(3).selectExpr("id as image_id", "0 as _oy", "1 as _ox", views, "case id when 0 then true when 1 then false end as _one")
    asked = lambda t: t.select("image_id", "_oy", "_ox", F.lit(True).alias("_live"), F.when(F.col("image_id") > 0, F.col("image_id") * 7).alias("_code"))
    got = multiview._needed(sheet, asked, ["image_id", "_oy", "_ox"], False).collect()
    assert sorted((r.image_id, r["_code"]) for r in got) == [(0, 0), (0, 3 << 32), (1, 7), (2, 14)]
    assert sorted(r["_code"] for r in multiview._needed(sheet, asked, ["image_id", "_oy", "_ox"], True).collect()) == [7, 14]


def test_paths_are_not_broadcast_once_rounds_are_large(spark, monkeypatch):
    """The rounds of ``paths_between`` are joined by merging from ``APART_BYTES`` on, so what goes through the driver stays bounded."""
    from pixelweave.operators import reach

    plans = []
    keep = schema.cut

    def seen(df, apart=False):
        plans.append(plan(df))
        return keep(df, apart)

    monkeypatch.setattr(schema, "cut", seen)
    monkeypatch.setattr(schema, "APART_BYTES", 0)
    edges = spark.range(2, 60).selectExpr("id as source", "id div 2 as target").union(spark.range(3, 60).selectExpr("id as source", "id div 3 as target"))
    pairs = spark.range(2, 60).selectExpr("id as src", "id div 6 as dst").filter("dst > 0")
    got = {(r.src, r.dst): r.connected for r in reach.paths_between(edges, pairs).collect()}
    below = {k: {k} for k in range(60)}
    for k in range(2, 60):
        below[k] |= below[k // 2] | (below[k // 3] if k > 2 else set())
    assert got == {(k, k // 6): k // 6 in below[k] for k in range(6, 60)}
    # the landmarks, a table of fixed size, and two tables that are no round yet, once each
    assert len(plans) > 10 and sum("BroadcastHashJoin" in p for p in plans) <= 3
