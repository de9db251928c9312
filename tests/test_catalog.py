"""Registry hygiene, and a sample of the registered pairs compared with DuckDB."""

import pytest
from compare import compare, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = ["P5_brightness_contrast", "P15_hue_saturation", "J2_combine_over", "A3_otsu_level", "W1_box_blur_r3", "R9_resize_bilinear", "C2_components", "Q5_shape_sequence",
          "G7_stale_nodes", "G12_sanitize_edges", "E3_build_request", "E5_cache_misses", "V5_interlace_grid", "K1_lens_geometry", "M6_rasterize", "Y6_warp_margins", "S12_read_obj",
          "T2_stream_histogram", "Z3_linework", "X7_splat_footprint"]


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 200


def test_entry_runs(spark):
    df = entry(spark)
    assert df.count() == 500 and df.columns == ["image_id", "frame", "n_on", "n", "coverage", "in_band"]


@pytest.mark.parametrize("name", SAMPLE)
def test_pair(spark, name):
    _, why = compare(spark, duck(SF), name, queries()[name], oracle_sql()[name], SF)
    assert why is None
