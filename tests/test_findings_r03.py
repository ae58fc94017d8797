"""Findings of the third round: each test failed before."""

import math
import random

from vistagrid.operators import explain as ex
from vistagrid.operators import options as op
from vistagrid.operators import paths as pa
from vistagrid.plans import path_plans


def _routes(spark):
    rng = random.Random(3)
    rows = []
    for route in range(40):
        n, lat = rng.choice((1, 2, 5, 23)), 43.0
        for k in range(n):
            lat += rng.random() * 0.006
            rows.append((route, k, n, lat, -79.0))
    return rows, spark.createDataFrame(rows, "route_id long, seq long, n_points long, lat double, lon double")


def test_paths_are_sampled_many_routes_at_a_time(spark):
    # Three Python calls per route and span made the time of short routes.
    rows, points = _routes(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = pa.sample_path(points, 450.0, span=4)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "InPandas" not in plan and "InArrow" in plan
        got = sorted((r.route_id, r.idx, r.seq, r.n_samples, r.lat) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    cum = {(r.route_id, r.seq): r.cum_m for r in pa.with_cumulative(points).collect()}
    want = []
    for route in range(40):
        own = [r for r in rows if r[0] == route]
        kept = [0]
        for _, k, *_ in own[1:]:
            if cum[route, k] - cum[route, kept[-1]] >= 450.0 - 1e-6 or k == len(own) - 1:
                kept.append(k)
        want += [(route, i, k, len(kept), own[k][3]) for i, k in enumerate(kept)]
    assert got == sorted(want)


def test_separation_is_computed_over_batches(spark):
    # Spark interpreted every distance of every pair of paths.
    rng = random.Random(5)
    path = lambda n: [(43.0 + rng.random() / 50, -79.0 + rng.random() / 50) for _ in range(n)]
    rows = [(0, path(7), path(3)), (1, path(1), None), (2, path(2), path(80)), (3, path(4), path(4))]
    pairs = spark.createDataFrame(rows, "k long, a array<struct<lat:double,lon:double>>, b array<struct<lat:double,lon:double>>").repartition(1)
    out = op.with_separation(pairs, "a", "b", "sep")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: r.sep for r in out.collect()}

    def km(p, q):
        (a, b), (c, d) = ([math.radians(v) for v in x] for x in (p, q))
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    for k, a, b in rows:
        if b is None:
            assert got[k] is None
        else:
            one = sum(min(km(p, q) for q in b) for p in a) / len(a) + sum(min(km(p, q) for q in a) for p in b) / len(b)
            assert abs(got[k] - one / 2) < 1e-9


def test_scored_routes_are_cut_from_their_plans(spark):
    # one plan of sampling, corridor, parts and scores, described anew at each step, filled the driver.
    plan = path_plans.scored_routes(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "InMemoryRelation" not in plan


def test_corridor_cells_are_spread_over_tasks(spark):
    # all samples of a cell met its tile in one task.
    _, points = _routes(spark)
    tiles = points.select(path_plans.GRID.cell_of("lat", "lon").alias("cell")).distinct()
    out = pa.corridor_tiles(points, tiles, path_plans.GRID)
    assert "__salt" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r.route_id for r in out.collect()} == set(range(40))


def test_baseline_pairs_stay_in_their_task(spark):
    # a row for every start and cell of its neighbourhood went through three shuffles.
    rng = random.Random(7)
    names = ", ".join(f"{k} double" for k in ex.AVERAGED)
    tiles = [(f"{i}:0:7", 43.0 + rng.random() * 2, -79.0 + rng.random() * 2, *[rng.random() for _ in ex.AVERAGED]) for i in range(400)]
    # Twins at one place: the smaller cell is the nearer one.
    tiles += [(f"{i}:1:7", *t[1:3], *[rng.random() for _ in ex.AVERAGED]) for i, t in enumerate(tiles)]
    starts = [(i, 43.0 + rng.random() * 2, -79.0 + rng.random() * 2) for i in range(90)] + [(900, 10.0, 10.0)]
    starts += [(1000 + i, *starts[i][1:]) for i in range(5)] + [(2000, None, 3.0)]
    before = ex.PART, ex.AT_A_TIME
    ex.PART, ex.AT_A_TIME = 16, 8
    try:
        out = ex.baseline_averages(spark.createDataFrame(starts, "request_id long, lat double, lon double"), spark.createDataFrame(tiles, f"cell string, lat double, lon double, {names}"), path_plans.GRID, metres=30_000.0, most=25)
        got = {r.request_id: r for r in out.collect()}
        assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        ex.PART, ex.AT_A_TIME = before

    def metres(a, b, c, d):
        x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371000.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    for k, lat, lon in starts:
        near = [] if lat is None else sorted((metres(lat, lon, t[1], t[2]), t[0], t[3:]) for t in tiles if metres(lat, lon, t[1], t[2]) <= 30_000.0)[:25]
        assert bool(near) == (k in got)
        if near:
            assert got[k].baseline_tiles == len(near)
            for j, name in enumerate(ex.AVERAGED):
                assert abs(got[k][name] - sum(n[2][j] for n in near) / len(near)) <= 0.00005 + 1e-9


def test_nodes_are_dealt_once(spark):
    # nodes went through three shuffles, with a path of four cell names each and four copies in the last one.
    from pyspark.sql import functions as F

    from vistagrid.operators.spatial import nearest_node

    rng = random.Random(11)
    nodes = [(i, 43.0 + rng.random(), -79.0 + rng.random()) for i in range(300)]
    points = [(i, 43.0 + rng.random(), -79.0 + rng.random()) for i in range(50)] + [(90, -30.0, 100.0), (91, 43.5, -150.0)]
    n = spark.createDataFrame([*nodes, (1000, *nodes[3][1:])], "node_id long, lat double, lon double")
    p = spark.createDataFrame([*points, (99, None, 1.0)], "k long, lat double, lon double")
    want = {k: min(((a - y) ** 2 + (b - x) ** 2, i) for i, a, b in nodes) for k, y, x in points}
    got = {r.k: (r.distance2, r.node_id) for r in nearest_node(p, n, path_plans.GRID, "k").collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-9 for k in want)
    bare = nearest_node(p, n.select("lat", "lon"), path_plans.GRID, "k")
    assert bare.columns == ["k", "distance2"] and bare.where(F.col("distance2") < 0).count() == 0
    assert {r.k: r.distance2 for r in bare.collect()} == {k: v[0] for k, v in got.items()}


def test_best_tiles_of_a_vibe_are_a_bounded_top_k(spark):
    # every task sorted nine rows for each of its tiles.
    from vistagrid.plans import tile_plans

    plan = tile_plans.flagship_vibe_tiles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("TakeOrderedAndProject") == 9 and "WindowGroupLimit" not in plan
