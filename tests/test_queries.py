"""Every cheap query against its SQL on the smallest tables; `check_oracles.py` runs all of them at any size."""

import pytest
from check_oracles import compare, duck

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# Heavy geometry is left to check_oracles.py, which also covers it at larger sizes.
HEAVY = {"water_proximity", "recomputed_tiles", "park_scores", "park_scores_degrees", "release_2_9", "release_3_3", "release_train", "segment_water",
         "water_visibility_tiles", "footprint_tiles", "polygon_cover", "scored_routes", "strategy_metrics", "corridor_means", "scenic_moments",
         "edge_penalties", "fallback_scores"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - HEAVY))
def test_query_matches_sql(spark, con, name):
    problems, _, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert not problems


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 225
