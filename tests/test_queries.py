"""Queries against their oracle SQL on the smallest tables, one or more of each family."""

from __future__ import annotations

import pytest

from motiongraph.plans import catalog

from .conftest import DATA, same

CHOSEN = """a1_amplitude a2_sum_motion a6_distance_change a8_angle_change a12_tortuosity_change a16_curvature_maxchange a23_over_time
a24_pooled a27_ring_rollup a29_fit_circle a36_mesh_volume a37_ttest_paired a39_normality_screen g2_prune_weak_round g4_prune_redundant
g11_hooks j1_local_maxima j4_nearest j4_nearest_in_grid j6_adjacent_ring_gaps j14_sample_field j15_weld_vertices j20_quadrangles j25_resample
p8_drop_side s8_append_graph s12_unpivot_positions s17_parse_xyz t6_sector_nearest u2_split_endpoints v4_angle w3_smooth_open w6_curvature
w7_corners w13_arm_angles w16_gaussian_filter w18_periods w20_best_lag w29_subpixel""".split()


@pytest.mark.parametrize("name", CHOSEN)
def test_against_oracle(spark, duck, name):
    same(catalog.queries()[name](spark, f"{DATA}/sf0.001"), duck.execute(catalog.oracle_sql()[name]).fetchdf())


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
