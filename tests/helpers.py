"""Small rasters in and out of pixel tables."""

import numpy as np

from pixelweave.schema import PIXEL_SCHEMA


def pixels(spark, arr, image_id=1, frame=0):
    """An (h, w, 4) array as a pixel table."""
    h, w, _ = arr.shape
    rows = [(image_id, frame, w, h, x, y, *(int(v) for v in arr[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, PIXEL_SCHEMA)


def raster(df):
    """{(image_id, frame): (h, w, 4) array} of a pixel table; every pixel must be there exactly once."""
    out = {}
    for r in df.collect():
        a = out.setdefault((r.image_id, r.frame), np.full((r.h, r.w, 4), -1))
        assert a[r.y, r.x, 0] == -1, "pixel twice"
        a[r.y, r.x] = (r.r, r.g, r.b, r.a)
    assert all((a >= 0).all() for a in out.values()), "pixel missing"
    return out


def noise(h, w, seed=0, opaque=False):
    a = np.random.default_rng(seed).integers(0, 256, (h, w, 4))
    if opaque:
        a[..., 3] = 255
    return a


def u8(v):
    return np.rint(np.clip(v, 0, 255)).astype(int)
