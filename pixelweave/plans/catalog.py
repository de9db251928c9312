"""All registered queries. Importing the parts fills the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (  # noqa: F401
    catalog_flow,
    catalog_graph,
    catalog_raster,
    catalog_recipes,
    catalog_shapes,
    catalog_views,
)
from . import registry
from .registry import ORACLES  # noqa: F401

# joins of two pixel tables, and results of millions of rows, are by far the longest comparisons: they come last
LONG = ("Y2_shift_lut", "Z11_two_frame_flip", "Z11_flip_relief")
QUERIES = dict(sorted(registry.QUERIES.items(), key=lambda q: q[0] in LONG or "USING (image_id, frame, x, y)" in ORACLES.get(q[0], "")))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["recipe_otsu_coverage"](spark, sf)
