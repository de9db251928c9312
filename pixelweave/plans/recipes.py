"""End-to-end recipes: functions from DataFrames to DataFrames, made of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import color, components, compose, mesh, multiview, neighborhood, regrid, sequence, stats
from ..operators.enrich import append_cache, call_model, split_cache
from ..schema import PIXEL, RGBA
from ..sources import generators as gen

BLACK, WHITE = (0, 0, 0, 255), (255, 255, 255, 255)


def painted_highlights(art: DataFrame, radius=24, gain=1.0, bias=4.0, sat_rejection=2.0, blur=1, min_area=9, shrink=1,
                       matte=0.1) -> tuple[DataFrame, DataFrame]:
    """(preview, coverage): highlights -> blur -> Otsu -> despeckle -> erode -> simulated print."""
    g = neighborhood.highlight_extract(art, radius, gain, bias, sat_rejection)
    g = stats.auto_threshold(neighborhood.box_blur(g, blur), "otsu")
    g = neighborhood.erode(components.despeckle(g, min_area), shrink)
    return neighborhood.gloss_preview(art, g, matte=matte, same_size=True), stats.coverage(g)


def relief_peaks(height: DataFrame, percentile=20.0, min_area=9) -> DataFrame:
    """Gloss the brightest part of a height map, lit by that same map."""
    g = components.despeckle(stats.auto_threshold(height, "percentile", percentile), min_area)
    return neighborhood.gloss_preview(height, g, height, shininess=24.0, matte=0.15, height_strength=3.0, same_size=True)


def linework(art: DataFrame, grow=1) -> DataFrame:
    g = stats.auto_threshold(neighborhood.dilate(neighborhood.sobel(art), grow), "otsu")
    return neighborhood.gloss_preview(art, g, matte=0.1, same_size=True)


def dark_luxury(art: DataFrame, percentile=10.0) -> DataFrame:
    g = stats.auto_threshold(color.invert(color.grayscale(art)), "percentile", percentile)
    return neighborhood.gloss_preview(art, g, shininess=48.0, matte=0.25, same_size=True)


def noise_normal_map(canvases: DataFrame, scale=22.0, seed=3, blur=2, strength=2.0) -> DataFrame:
    return neighborhood.normal_map(neighborhood.box_blur(gen.value_noise(canvases, scale, seed), blur), strength)


def gradient_histogram(canvases: DataFrame, c0=(30, 58, 138, 255), c1=(245, 158, 11, 255), strength=0.6, width=256, height=128) -> DataFrame:
    return gen.histogram_image(stats.histogram(color.vignette(gen.linear_gradient(canvases, c0, c1, False), strength)), width, height)


def gradient_mesh(canvases: DataFrame) -> DataFrame:
    return mesh.heightmap_to_mesh(gen.linear_gradient(canvases, BLACK, WHITE, True), -1, 2.0, 20.0, 100.0)


def spinner_views(canvases: DataFrame, ticks=12) -> DataFrame:
    """Four quarter turns of a ring with graduated ticks, as views of a 2x2 grid, row by row."""
    ring = gen.radial_gradient(canvases, BLACK, WHITE, "ring", 0.82, 0.56, 0.0, 0.03)
    left, right = [f"_{ch}" for ch in RGBA], list(RGBA)  # both are drawn on the same pixels, so nothing has to be joined
    sweep = color.posterize(gen.radial_over(ring.withColumnsRenamed(dict(zip(RGBA, left))), BLACK, WHITE, "conic", 0.9, 0.6, 0.0, 0.02, left), ticks)
    s = sweep.select(*PIXEL[:6], *[v.alias(ch) for v, ch in zip(compose.mix([F.col(v) for v in left], [F.col(v) for v in right], "multiply"), RGBA)])
    turned = [s, regrid.transform(s, "rotate90"), regrid.transform(s, "rotate270"), regrid.transform(s, "rotate180")]
    out = [v.withColumn("frame", F.lit(i)).select(*PIXEL) for i, v in enumerate(turned)]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def spinner_sheet(canvases: DataFrame, lens: multiview.Lens) -> DataFrame:
    return multiview.interlace_grid(spinner_views(canvases), lens, 2, 2)


def animated_sheet(p: DataFrame, frames: DataFrame, lens: multiview.Lens, frame_count=8) -> DataFrame:
    """A sequence resampled to what the lens can hold, printed as one sheet."""
    shaped, _ = sequence.shape_sequence(p, frames, frame_count=frame_count)
    return multiview.interlace_strips(shaped, lens)


def two_frame_flip(canvases: DataFrame, lens: multiview.Lens) -> tuple[DataFrame, DataFrame]:
    """(artwork, relief) of a sheet that swaps a dot for a ring."""
    dot = gen.radial_gradient(canvases, WHITE, BLACK, "radial", 0.45, 0.0, 0.0, 0.05)
    ring = gen.radial_gradient(canvases, BLACK, WHITE, "ring", 0.82, 0.56, 0.0, 0.03).withColumn("frame", F.lit(1))
    views = dot.union(ring.select(*PIXEL))
    return multiview.interlace_strips(views, lens), multiview.strip_height_field(views, lens)


def mesh_grid_sheet(tris: DataFrame, lens: multiview.Lens, grid=3, **views) -> DataFrame:
    return multiview.interlace_grid(mesh.mesh_view_grid(tris, grid, grid, **views), lens, grid, grid)


def mesh_strip_sheet(tris: DataFrame, lens: multiview.Lens, count=12, **views) -> DataFrame:
    return multiview.interlace_strips(mesh.mesh_view_run(tris, count, **views), lens)


def material_masks(art: DataFrame, requests: DataFrame, cache: DataFrame, model: str, fn, mask_of, min_area=9, cache_path: str | None = None) -> DataFrame:
    """Masks from a model (answers cached by content), cleaned into a gloss mask and previewed.

    ``mask_of`` turns (request_id, answer) rows into a mask raster: the model's output format is the
    caller's business.
    """
    hits, misses = split_cache(requests, cache, model)
    fresh = call_model(misses, fn)
    if cache_path:
        append_cache(fresh, cache_path)
    answers = hits.select("request_id", "answer").union(fresh.filter("error is null").select("request_id", "answer"))
    g = components.despeckle(stats.auto_threshold(mask_of(answers), "otsu"), min_area)
    return neighborhood.gloss_preview(art, g, matte=0.1, same_size=True)
