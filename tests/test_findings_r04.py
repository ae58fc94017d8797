"""Findings of the fourth round: each test failed before."""

import pytest

import __spark_entry__ as entry
from vistagrid.operators import requests as rq
from vistagrid.operators import spatial as sp
from vistagrid.plans import request_plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ranked_tiles", "sector_tiles", "spaced_anchors", "vibe_availability", "waypoint_rings", "strategy_rings", "scenic_regions"])
def test_pairs_of_requests_and_tiles_stay_in_their_task(spark, name):
    # Every pair went through a shuffle to be ranked, and lists were kept on disk for a second use.
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    after = plan[:plan.index("FlatMapCoGroupsInArrow")]
    assert "Exchange" not in after and "InMemoryTableScan" not in plan and "Window" not in plan


def test_parts_of_a_crowded_home_change_nothing(spark, monkeypatch):
    def rows():
        return sorted((r.request_id, r.position, r.cell, round(r.selection, 9)) for r in rq.ranked_rows(request_plans.ranked(spark, SF)).collect())

    whole = rows()
    monkeypatch.setattr(rq, "PART", 3)
    monkeypatch.setattr(rq, "AT_A_TIME", 2)
    monkeypatch.setattr(rq, "HOME", 9)
    assert whole and rows() == whole


def test_overlaps_are_clipped_over_batches(spark):
    # the clipping fold was interpreted, and grew with every use of its parts.
    pairs = spark.sql("""SELECT cell, class_id, transform(ring, p -> named_struct('lon', p[0], 'lat', p[1])) AS ring, transform(hex, p -> named_struct('lon', p[0], 'lat', p[1])) AS tile_ring FROM VALUES
        ('a', 1, array(array(0D, 0D), array(2D, 0D), array(2D, 2D), array(0D, 2D), array(0D, 0D)), array(array(1D, 1D), array(3D, 1D), array(3D, 3D), array(1D, 3D), array(1D, 1D))),
        ('b', 2, array(array(0D, 0D), array(0D, 2D), array(2D, 0D), array(0D, 0D)), array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 1D), array(0D, 0D))),
        ('c', 3, array(array(5D, 5D), array(6D, 5D), array(6D, 6D), array(5D, 5D)), array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 1D), array(0D, 0D))) AS t(cell, class_id, ring, hex)""")
    fold = {r.cell: r.area for r in pairs.select("cell", sp.overlap_area("ring", "tile_ring").alias("area")).collect()}
    out = sp.with_overlap_area(pairs)
    assert {r.cell: r.area for r in out.collect()} == fold == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert "MapInArrow" in entry.queries()["canopy_by_overlap"](spark, SF)._jdf.queryExecution().executedPlan().toString()
