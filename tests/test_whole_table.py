"""Queries over tables of more rows than the smallest size has, where a cut by id would show."""

from pathlib import Path

import pytest
from compare import assert_same, connect

from voxlake.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def larger(small):
    return str(Path(small).parent / "sf0.01")


@pytest.mark.parametrize("name", ["g11_surface_stats", "g12_quad_spacing", "g13_covariance", "m6_rescale", "m2_quad_points", "j10_surface_volume", "i3_apply_lut", "i4_local_contrast", "i5_ambient_occlusion", "i6_auto_window", "m5_grid_from_mesh", "j2_sample_trilinear", "s11_coalesce_ranges"])
def test_whole_table(spark, larger, name):
    assert_same(QUERIES[name](spark, larger), connect(larger), SQL[name])


@pytest.mark.parametrize("name", ["n11_render_quad_max", "n10_render_surface_light"])
def test_rendered_surface_is_the_whole_table(spark, larger, name):
    assert QUERIES[name](spark, larger).select("i").distinct().count() == 100
