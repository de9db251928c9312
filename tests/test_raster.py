"""Literal cases and NumPy cross-checks of the raster operators."""

from functools import reduce

import numpy as np
import pytest
from helpers import noise, pixels, raster, u8

from pixelweave.operators import bands, color, components, compose, neighborhood, regrid, stats
from pixelweave.schema import images_of


def one(df):
    return next(iter(raster(df).values()))


def test_grey_of_red(spark):
    p = pixels(spark, np.array([[[255, 0, 0, 255]]]))
    assert one(color.grayscale(p))[0, 0].tolist() == [76, 76, 76, 255]


def test_brightness_keeps_alpha(spark):
    p = pixels(spark, np.array([[[100, 100, 100, 128]]]))
    assert one(color.brightness_contrast(p, 100, 0))[0, 0].tolist() == [255, 255, 255, 128]


def test_percentile_of_ramp(spark):
    a = np.array([[[v, v, v, 255] for v in range(0, 250, 25)]])
    p = pixels(spark, a)
    assert stats.auto_level(p, "percentile", 20).first().level == 200
    assert (one(stats.auto_threshold(p, "percentile", 20))[..., 0] == 255).sum() == 2


def test_constant_image_uses_mid_level(spark):
    p = pixels(spark, np.full((3, 3, 4), 255))
    assert stats.auto_level(p).first().level == 128
    clear = pixels(spark, np.zeros((2, 2, 4), int), 2)
    assert {tuple(v) for v in one(stats.auto_threshold(clear)).reshape(-1, 4)} == {(0, 0, 0, 255)}


def test_empty_curve_is_identity_and_ends_truncate():
    assert color.curve_values([]) == list(range(256))
    lut = color.curve_values([(100, 10.9), (200, 99.9)])
    assert lut[0] == 10 and lut[255] == 99 and lut[150] == 55


def blur(a, r):
    pm = a.astype(float).copy()
    pm[..., :3] = u8(a[..., :3] * a[..., 3:] / 255)
    for axis in (1, 0):
        n = pm.shape[axis]
        idx = [np.clip(np.arange(n) + k, 0, n - 1) for k in range(-r, r + 1)]
        pm = u8(sum(np.take(pm, i, axis) for i in idx) / (2 * r + 1)).astype(float)
    al = pm[..., 3:]
    pm[..., :3] = np.where(al > 0, u8(pm[..., :3] * 255 / np.where(al > 0, al, 1)), 0)
    return pm.astype(int)


@pytest.mark.parametrize("r", [1, 2, 5, 20])
def test_blur_over_several_bands(spark, r):
    a = noise(150, 5, r)
    assert bands.band_rows(r) < 150
    assert (one(neighborhood.box_blur(pixels(spark, a), r)) == blur(a, r)).all()


@pytest.mark.parametrize("r", [1, 3, 7])
def test_open_over_several_bands(spark, r):
    a = noise(140, 4, 9)

    def ext(v, f):
        for axis in (1, 0):
            n = v.shape[axis]
            v = f([np.take(v, np.clip(np.arange(n) + k, 0, n - 1), axis) for k in range(-r, r + 1)], axis=0)
        return v

    assert (one(neighborhood.open_close(pixels(spark, a), r, "open")) == ext(ext(a, np.min), np.max)).all()


def test_sharpen_flat_is_unchanged(spark):
    a = np.full((5, 5, 4), 200)
    a[..., 3] = 255
    assert (one(neighborhood.sharpen(pixels(spark, a), 2.0)) == a).all()


def test_flat_normal_is_flat_blue(spark):
    a = np.full((4, 4, 4), 90)
    assert {tuple(v) for v in one(neighborhood.normal_map(pixels(spark, a), 3)).reshape(-1, 4)} == {(128, 128, 255, 255)}


@pytest.mark.parametrize("size", [(7, 13), (1, 1), (16, 5), (9, 9), (23, 31)])
def test_nearest_resize_is_complete(spark, size):
    a = noise(9, 11, 3)
    w, h = size
    got = one(regrid.resize_nearest(pixels(spark, a), w, h))
    ys = np.minimum(8, np.floor(np.arange(h) / h * 9)).astype(int)
    xs = np.minimum(10, np.floor(np.arange(w) / w * 11)).astype(int)
    assert (got == a[np.ix_(ys, xs)]).all()


@pytest.mark.parametrize("size", [(6, 4), (1, 9), (20, 1), (17, 140)])
def test_bilinear_resize(spark, size):
    a = noise(70, 5, 4)
    w, h = size
    got = one(regrid.resize_bilinear(pixels(spark, a), w, h))
    fy = np.arange(h) * 69 / (h - 1) if h > 1 else np.zeros(1)
    fx = np.arange(w) * 4 / (w - 1) if w > 1 else np.zeros(1)
    y0, x0 = np.floor(fy).astype(int), np.floor(fx).astype(int)
    y1, x1 = np.minimum(69, y0 + 1), np.minimum(4, x0 + 1)
    wy, wx = (fy - y0)[:, None, None], (fx - x0)[None, :, None]
    top = a[np.ix_(y0, x0)] * (1 - wx) + a[np.ix_(y0, x1)] * wx
    bot = a[np.ix_(y1, x0)] * (1 - wx) + a[np.ix_(y1, x1)] * wx
    assert (got == u8(top * (1 - wy) + bot * wy)).all()


def test_rotate_quarter_turn_matches_transform_size(spark):
    a = noise(4, 7, 5)
    got = raster(regrid.rotate(pixels(spark, a), 45))[(1, 0)]
    assert got.shape[0] == got.shape[1] == 8
    assert (got[0, 0] == 0).all()


def test_pad_and_crop_are_inverse(spark):
    a = noise(3, 5, 6)
    p = pixels(spark, a)
    assert (one(regrid.crop(regrid.pad(p, 2), 2, 2, 5, 3)) == a).all()
    assert one(regrid.crop(p, 50, 0, 2, 2)).tolist() == [[[0, 0, 0, 0]]]


def test_second_operand_is_fitted_and_missing_side_passes(spark):
    a, b, lone = noise(4, 4, 1), noise(2, 2, 2), noise(3, 3, 3)
    left = pixels(spark, a, 1)
    right = pixels(spark, b, 1).union(pixels(spark, lone, 7))
    got = raster(compose.combine(left, right, "add"))
    want = np.minimum(255, a[..., :3] + np.repeat(np.repeat(b, 2, 0), 2, 1)[..., :3])
    assert (got[(1, 0)][..., :3] == want).all()
    assert (got[(7, 0)] == lone).all()


def test_deep_stacks_fold_in_chunks(spark):
    from pyspark.sql import functions as F

    layers = [noise(2, 3, s) for s in range(11)]
    p = None
    for i, a in enumerate(layers):
        t = pixels(spark, a).withColumn("layer", F.lit(i * 3))
        p = t if p is None else p.union(t)
    for mode in ("screen", "over"):
        whole = raster(compose.fold_combine(p, "layer", mode))[(1, 0)]
        parts = raster(compose.fold_combine(p, "layer", mode, layers_per_pass=4))[(1, 0)]
        assert (whole == parts).all()
    got = raster(compose.fold_combine(p, "layer", "subtract"))[(1, 0)]
    acc = layers[0][..., :3].copy()
    for a in layers[1:]:
        acc = np.maximum(0, acc - a[..., :3])
    assert (got[..., :3] == acc).all()


def flood(on):
    """Row-major first pixel of every 4-connected component."""
    h, w = on.shape
    lab = {}
    for y in range(h):
        for x in range(w):
            if (y, x) in lab:
                continue
            stack, lab[(y, x)] = [(y, x)], (y, x)
            while stack:
                cy, cx = stack.pop()
                for q in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                    if 0 <= q[0] < h and 0 <= q[1] < w and q not in lab and on[q] == on[cy, cx]:
                        lab[q] = (y, x)
                        stack.append(q)
    return lab


@pytest.mark.parametrize("tile", [256, 5, 2, 1])
def test_components_across_tiles(spark, tile):
    """Tiles of any size, merged over several levels: noise, a spiral through all tiles, and columns that meet at the last row only."""
    noisy = np.random.default_rng(2).random((23, 37)) < 0.6
    spiral = np.zeros((25, 25), bool)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(400):
        spiral[y, x] = True
        ahead = (y + 2 * dy, x + 2 * dx)
        if not (0 <= y + dy < 25 and 0 <= x + dx < 25) or (0 <= ahead[0] < 25 and 0 <= ahead[1] < 25 and spiral[ahead]):
            dy, dx = dx, -dy
        if spiral[y + dy, x + dx]:
            break
        y, x = y + dy, x + dx
    comb = np.zeros((18, 21), bool)
    comb[:, ::2] = True
    comb[-1] = True
    images = [noisy, spiral, comb, np.ones((9, 30), bool), np.zeros((4, 4), bool)]
    table = [pixels(spark, np.repeat(np.where(on, 255, 0)[..., None], 4, 2), k) for k, on in enumerate(images)]
    out = components.components(reduce(lambda a, b: a.union(b), table), tile=tile).collect()
    for k, on in enumerate(images):
        got = {(r.y, r.x): (r.label_y, r.label_x) for r in out if r.image_id == k}
        assert got == {q: v for q, v in flood(on).items() if on[q]}


def test_despeckle_blob_and_speck(spark):
    on = np.zeros((12, 12), bool)
    on[2:6, 2:6] = True
    on[3, 3] = False  # a hole
    on[9, 9:11] = True
    a = np.repeat(np.where(on, 255, 0)[..., None], 4, 2)
    got = one(components.despeckle(pixels(spark, a), 9, 4))[..., 0] == 255
    want = np.zeros((12, 12), bool)
    want[2:6, 2:6] = True
    assert (got == want).all()


def test_wand_ignores_seeds_outside(spark):
    a = np.zeros((3, 4, 4), int)
    a[:, 2:] = 200
    seeds = spark.createDataFrame([(1, 0, 0, 0.4, 0.4), (1, 0, 1, 9.0, 0.0)], "image_id long, frame int, seed_id int, x double, y double")
    got = {(r.x, r.y) for r in components.magic_wand(pixels(spark, a), seeds, 10, tile=2).collect()}
    assert got == {(x, y) for x in (0, 1) for y in (0, 1, 2)}


def test_outline_reaches_thickness(spark):
    a = np.zeros((5, 5, 4), int)
    a[2, 2] = (10, 20, 30, 255)
    got = one(neighborhood.outline(pixels(spark, a), 1, (255, 0, 0, 255)))
    assert got[2, 2].tolist() == [10, 20, 30, 255] and got[1, 2].tolist() == [255, 0, 0, 255] and got[1, 1].tolist() == [0, 0, 0, 0]


def test_images_of_has_one_row_per_frame(spark):
    assert images_of(pixels(spark, noise(3, 4))).collect()[0].asDict() == {"image_id": 1, "frame": 0, "w": 4, "h": 3}


@pytest.mark.parametrize("reach", [1, 4.5, 200])
def test_distance_against_brute_force(spark, reach):
    """Octile distance to the nearest opaque pixel, at any reach, with several images, an empty and a full one."""
    rng, images = np.random.default_rng(5), []
    for h, w, share in ((31, 17, 0.02), (5, 40, 0.01), (12, 12, 0), (6, 6, 1)):
        a = np.zeros((h, w, 4), int)
        a[..., 3] = np.where(rng.random((h, w)) < share, 200, 7)
        images.append(a)
    table = reduce(lambda a, b: a.union(b), [pixels(spark, a, k) for k, a in enumerate(images)])
    got = {(r.image_id, r.y, r.x): r.dist for r in neighborhood.distance_to_opaque(table, 10, reach).collect()}
    for k, a in enumerate(images):
        ys, xs = np.nonzero(a[..., 3] > 10)
        for y in range(a.shape[0]):
            for x in range(a.shape[1]):
                dy, dx = np.abs(ys - y), np.abs(xs - x)
                lo = np.minimum(dx, dy)
                best = (np.maximum(dx, dy) - lo + np.sqrt(2) * lo).min(initial=np.inf)
                assert got[k, y, x] == (best if best <= reach else None)
