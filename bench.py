"""Headline timings: one JSON line. BENCH_SF_DIR picks the data, BENCH_CPUS the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pixelweave.operators import color, components, compose, neighborhood, regrid, stats  # noqa: E402
from pixelweave.plans import catalog  # noqa: E402
from pixelweave.plans import fixtures as fx  # noqa: E402
from pixelweave.session import local_session  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")


def px(s):
    return fx.px_part(s, SF)


def other(s):
    return px(s).withColumn("image_id", F.col("image_id").bitwiseXOR(F.lit(1).cast("long")))


# 16x16 images per part: 5.1 million pixels at sf0.1
OPS = {
    "brightness_contrast": lambda s: color.brightness_contrast(px(s), 20, -40),
    "hue_saturation": lambda s: color.hue_saturation(px(s), -75, 1.4),
    "histogram": lambda s: stats.histogram(px(s)),
    "otsu_threshold": lambda s: stats.auto_threshold(px(s), "otsu"),
    "normalize": lambda s: stats.normalize(px(s)),
    "combine_over": lambda s: compose.combine(px(s), other(s), "over", same_size=True),
    "box_blur_r1": lambda s: neighborhood.box_blur(px(s), 1),
    "box_blur_r8": lambda s: neighborhood.box_blur(px(s), 8),
    "dilate_r2": lambda s: neighborhood.dilate(px(s), 2),
    "sobel": lambda s: neighborhood.sobel(px(s)),
    "rotate90": lambda s: regrid.transform(px(s), "rotate90"),
    "resize_nearest_x2": lambda s: regrid.resize_nearest(px(s), 32, 32),
    "resize_bilinear_24": lambda s: regrid.resize_bilinear(px(s), 24, 24),
    "components": lambda s: components.components(fx.mask_part(s, SF)),
}
NAMED = ["recipe_otsu_coverage", "V5_interlace_grid", "K2_spot_size_sweep", "G2_descendants", "E5_cache_misses", "Q5_shape_sequence", "X8_composite_splats",
         "M6_rasterize", "Y6_warp_margins"]


def main() -> None:
    spark = local_session(app="bench")
    runs = dict(OPS) | {n: (lambda s, n=n: catalog.QUERIES[n](s, SF)) for n in NAMED}
    only = set(sys.argv[1:])
    fx.px_part(spark, SF).limit(1).count()  # start-up is not part of a query
    times = {}
    for name, make in runs.items():
        if only and name not in only:
            continue
        t = time.time()
        make(spark).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"# {name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF.rstrip("/"))}))


if __name__ == "__main__":
    main()
