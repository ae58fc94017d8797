"""Operators against brute force on small fixtures, and invariants."""

import json
import math
import random

from pyspark.sql import functions as F

from vistagrid.functions import geo, text
from vistagrid.functions.cells import HexGrid
from vistagrid.operators import analytics as an
from vistagrid.operators import enrich as en
from vistagrid.operators import options as op
from vistagrid.operators import paths as pa
from vistagrid.operators import skew
from vistagrid.operators import spatial as sp
from vistagrid.sources import readers as rd
from vistagrid.sources.fixtures import GRID, domain
from vistagrid.streaming import streams as st

SF = "/root/testdata/sf0.001"


def test_metadata_check_walks_like_a_parser(spark):
    def walk(v, depth=1):
        items, deepest, longest = 0, 0, 0
        if isinstance(v, (dict, list)):
            deepest = depth
            pairs = v.items() if isinstance(v, dict) else ((None, x) for x in v)
            for k, x in pairs:
                i, d, n = walk(x, depth + 1)
                items, deepest = items + 1 + i, max(deepest, d)
                longest = max(longest, n, len(k) if k else 0)
        elif isinstance(v, str):
            longest = len(v)
        return items, deepest, longest

    values = [{"a": {"b": {"c": {"d": 1}}}}, {"k": [1, 2, {"x": None}], "t": True}, {"q": 'say "hi" [x] {y}, ok\\'}, {}, {"a": [], "b": {}},
              {f"k{i}": i for i in range(60)}, {"long": "x" * 1200}, {"a": {"b": {"c": {"d": {"e": 1}}}}}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, m string")
    for row in df.select("i", text.metadata_check("m").alias("c")).collect():
        items, depth, longest = walk(values[row.i])
        assert (row.c.items, row.c.depth) == (items, depth)
        assert row.c.ok == (items <= 50 and depth <= 4 and longest <= 1000)


def test_running_total_and_halo_cross_spans(spark):
    rows = [(1, i, float(i % 7)) for i in range(50)] + [(2, i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "k int, seq bigint, v double")
    got = {(r.k, r.seq): r.t for r in skew.running_total(df, ["k"], "seq", "v", "t", span=8).collect()}
    for k, seq, _ in rows:
        assert got[(k, seq)] == sum(v for kk, s, v in rows if kk == k and s <= seq)
    w = skew.span_window(["k"], "seq")
    halo = skew.with_halo(df, ["k"], "seq", before=1, after=1, span=8)
    out = skew.drop_halo(halo.withColumns({"p": F.lag("v").over(w), "n": F.lead("v").over(w)})).collect()
    assert len(out) == len(rows)
    value = {(k, s): v for k, s, v in rows}
    for r in out:
        assert r.p == value.get((r.k, r.seq - 1)) and r.n == value.get((r.k, r.seq + 1))


def test_sample_path_matches_plain_walk(spark):
    random.seed(3)
    pts = [(1, i, 40, 43 + 0.001 * i + random.random() / 500, -79 + random.random() / 400) for i in range(40)]
    df = spark.createDataFrame(pts, "route_id bigint, seq bigint, n_points bigint, lat double, lon double")

    def km(a, b):
        x = math.sin(math.radians(b[3] - a[3]) / 2) ** 2 + math.cos(math.radians(a[3])) * math.cos(math.radians(b[3])) * math.sin(math.radians(b[4] - a[4]) / 2) ** 2
        return 2 * 6371.0 * math.atan2(math.sqrt(x), math.sqrt(1 - x))

    want, acc = [0], 0.0
    for i in range(1, 40):
        acc += km(pts[i - 1], pts[i]) * 1000
        if acc >= 500:
            want.append(i)
            acc = 0.0
    if want[-1] != 39:
        want.append(39)
    assert sorted(r.seq for r in pa.sample_path(df, 500.0).collect()) == want
    assert sorted((r.idx, r.seq, r.n_samples) for r in pa.sample_path(df, 500.0, span=4).collect()) == [(k, s, len(want)) for k, s in enumerate(want)]


def test_sample_path_does_not_depend_on_spans(spark):
    rng = random.Random(8)
    # Routes of one point, of standing still, of short steps and of steps longer than the distance.
    rows = [(r, i, n, 43.0 + (0 if r == 2 else step * i), -79 + rng.random() * step) for r, n, step in ((1, 1, 0.1), (2, 9, 0.0), (3, 57, 0.0003), (4, 23, 0.02), (5, 30, 0.004)) for i in range(n)]
    df = spark.createDataFrame(rows, "route_id bigint, seq bigint, n_points bigint, lat double, lon double")
    whole = sorted((r.route_id, r.idx, r.seq, r.n_samples) for r in pa.sample_path(df, 450.0).collect())
    assert sorted((r.route_id, r.idx, r.seq, r.n_samples) for r in pa.sample_path(df, 450.0, span=3).collect()) == whole
    assert [w for w in whole if w[0] == 1] == [(1, 0, 0, 1)] and [w[2] for w in whole if w[0] == 2] == [0, 8]


def test_overlap_area_of_square_and_hexagon(spark):
    grid = HexGrid(lon0=0.0, lat0=0.0, edge7=1.0, aspect=1.0)
    ring = [(-5.0, -5.0), (5.0, -5.0), (5.0, 5.0), (-5.0, 5.0), (-5.0, -5.0)]
    half = [(0.0, -5.0), (5.0, -5.0), (5.0, 5.0), (0.0, 5.0), (0.0, -5.0)]
    far = [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 10.0), (9.0, 9.0)]
    df = spark.createDataFrame([(i, [{"lon": x, "lat": y} for x, y in r]) for i, r in enumerate((ring, half, far))], "i int, ring array<struct<lon:double,lat:double>>")
    got = {r.i: r.a for r in df.select("i", sp.overlap_area("ring", grid.boundary(F.lit(0), F.lit(0))).alias("a")).collect()}
    full = 1.5 * math.sqrt(3)
    assert abs(got[0] - full) < 1e-9 and abs(got[1] - full / 2) < 1e-9 and got[2] == 0.0


def test_traffic_csv_and_tile_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("h3,score\n0:0:7,0.4\n,0.9\n1:0:7,abc\n2:0:7,7\n")
    got = {r.cell: r.traffic_score for r in rd.read_traffic_csv(spark, str(tmp_path / "t.csv")).collect()}
    assert got == {"0:0:7": 0.4, "1:0:7": 0.5, "2:0:7": 1.0}
    tiles = domain(spark, SF, "tiles").select(*[f.name for f in rd.TILE_SCHEMA])
    rd.write_tiles(tiles, str(tmp_path / "tiles"))
    back = rd.read_tiles(spark, str(tmp_path / "tiles"), tiles.where("scoring_version IS NOT NULL").first().scoring_version)
    assert 0 < back.count() < tiles.count()


def test_release_train_resumes_after_any_version(spark):
    tiles = domain(spark, SF, "tiles").withColumn("scoring_version", F.lit("3.0-overture-lightpollution-enrichment"))
    parts = [F.lit(0.3).alias(f) for f in en.FEATURES]
    features = tiles.select("cell", *parts)
    whole = en.release_train(tiles, features)
    half = en.release_train(en.release_train(tiles, features, upto="3.4"), features)
    cols = ["cell", "scenic_score", "water_score", "poi_score", "scoring_version"]
    assert whole.select(*cols).exceptAll(half.select(*cols)).count() == 0


def test_exact_percentile_matches_interpolation(spark):
    import numpy as np

    random.seed(5)
    rows = [(random.choice("ab"), float(random.randint(0, 5000))) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, v double")
    for r in an.exact_percentile(df, ["k"], "v", 0.95, "p").collect():
        assert abs(r.p - np.percentile([v for k, v in rows if k == r.k], 95)) < 1e-9


def test_stream_dedup_equals_batch(spark, tmp_path):
    t = domain(spark, SF, "traffic").select("event_id", "cell", "ts_us").limit(300)
    src = str(tmp_path / "in")
    t.unionByName(t).repartition(3).write.parquet(src)
    stream = spark.readStream.schema("event_id bigint, cell string, ts_us bigint").parquet(src).withColumn("at", F.timestamp_micros("ts_us"))
    q = st.dedup_events(stream, delay="60 days").writeStream.format("memory").queryName("dedup_out").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("dedup_out").count() == st.dedup_events_batch(t.unionByName(t)).count() == 300


def test_rollup_stream_equals_batch(spark, tmp_path):
    events = domain(spark, SF, "analytics_events")
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    st.rollup_stream(stream, lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}"), str(tmp_path / "cp")).awaitTermination()
    merged = spark.read.parquet(out).groupBy(*an.ROLLUP_KEYS).agg(F.sum("event_count").alias("n"))
    want = an.daily_rollup(events).select(*an.ROLLUP_KEYS, F.col("event_count").alias("n"))
    assert merged.exceptAll(want).count() == 0 and merged.count() == want.count()


def test_jaccard_is_symmetric_and_dedup_idempotent(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c", "d"])], "x array<string>, y array<string>")
    a, b = df.select(op.jaccard("x", "y"), op.jaccard("y", "x")).first()
    assert a == b == 0.25
    once = op.dedup_best(domain(spark, SF, "candidates"))
    assert op.dedup_best(once.select(*domain(spark, SF, "candidates").columns)).count() == once.count()


def test_flat_scores_are_spread_without_changing_others(spark):
    got = op.flat_score_fallback(domain(spark, SF, "candidates"))
    assert got.where("flat").count() > 0
    assert got.where("NOT flat").join(domain(spark, SF, "candidates").select("candidate_id", F.col("score").alias("s0")), "candidate_id").where("score <> s0").count() == 0


def test_plans_have_no_cartesian_product(spark):
    for name in ("point_in_polygon", "within_radius"):
        pts = domain(spark, SF, "places").select("place_id", "lon", "lat")
        if name == "point_in_polygon":
            df = sp.point_in_polygon(pts, domain(spark, SF, "areas"), GRID)
        else:
            t = domain(spark, SF, "tiles").select("cell", F.col("lat").alias("tile_lat"), F.col("lon").alias("tile_lon"))
            df = sp.within_radius(pts, t, 3000.0, GRID)
        text_plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in text_plan and "BroadcastNestedLoopJoin" not in text_plan


def test_haversine_known_distance(spark):
    d = spark.range(1).select(geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d")).first().d
    assert abs(d - math.pi * 6371000 / 180) < 1e-6


def test_nearest_node_of_far_points(spark):
    """Points far from every node still get their nearest one."""
    from vistagrid.functions.cells import HexGrid
    from vistagrid.operators.spatial import nearest_node

    places = [(1, 43.0, -79.0), (2, 43.01, -79.02), (3, 44.5, -80.0), (4, -10.0, 20.0)]
    starts = [(k, 43.0 - 1.7 * k, -79.0 + 2.3 * k) for k in range(40)] + [(100, 10.0, -40.0), (101, 60.0, -130.0), (102, -80.0, 170.0)]
    got = nearest_node(spark.createDataFrame(starts, "k long, lat double, lon double"), spark.createDataFrame(places, "node_id long, lat double, lon double"), HexGrid(), "k").collect()
    want = {k: min(((a - lat) ** 2 + (b - lon) ** 2, n) for n, a, b in places) for k, lat, lon in starts}
    assert len(got) == len(starts)
    for r in got:
        assert r.node_id == want[r.k][1] and abs(r.distance2 - want[r.k][0]) < 1e-9


def test_clock_debounce_loses_no_event(spark):
    """Late events of a cell start or join a burst; nothing is dropped and a quiet cell is released by the clock."""
    from vistagrid.streaming import streams as st

    pending = spark.createDataFrame([("a", 0), ("a", 5_000_000), ("b", 1_000_000), ("c", 29_000_000)], "cell string, ts_us long")
    ready, waiting = st.debounce_by_clock(pending, 20_000_000, 10)
    assert sorted(tuple(r) for r in ready.collect()) == [("a", 0, 15_000_000, 2), ("b", 1_000_000, 11_000_000, 1)]
    assert [r.cell for r in waiting.collect()] == ["c"]


def test_ledger_never_forgets(spark, tmp_path):
    """An id seen in any earlier batch is left out, however old."""
    from vistagrid.streaming import streams as st

    seen = []
    for k, ids in enumerate([[1, 2, 2], [2, 3], [1, 4]]):
        spark.createDataFrame([(i, k * 10_000_000_000) for i in ids], "event_id long, ts_us long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("event_id long, ts_us long").parquet(str(tmp_path / "in"))
        st.dedup_against_ledger(stream, str(tmp_path / "ledger"), lambda df, n: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [1, 2, 3, 4]


def test_exports_join_to_valid_files(spark):
    import json
    from xml.dom.minidom import parseString

    from vistagrid.sources import readers as rd

    points = spark.createDataFrame([(1, k, 43.0 + k / 1e4, -79.0) for k in range(9000)] + [(2, 0, 43.0, -79.0)], "route_id long, seq long, lat double, lon double")
    for fn, name in ((rd.export_geojson, "geojson"), (rd.export_gpx, "gpx")):
        rows = sorted(tuple(r) for r in fn(points).collect())
        texts = {k: "".join(t for i, _, t in rows if i == k) for k in (1, 2)}
        n = [len(json.loads(texts[k])["geometry"]["coordinates"]) if name == "geojson" else len(parseString(texts[k]).getElementsByTagName("trkpt")) for k in (1, 2)]
        assert n == [9000, 1]


def test_snapshot_restores_nulls_and_counts_changes(spark, tmp_path):
    from vistagrid.operators import quality as qu

    path = str(tmp_path / "snap")
    before = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.3)], "cell string, v double")
    qu.snapshot(before, ["v"], path)
    after = spark.createDataFrame([("a", 0.9), ("b", 0.8), ("d", 0.7)], "cell string, v double")
    assert tuple(qu.snapshot_parity(after, ["v"], path).first()) == (3, 3, 2, 2)
    assert sorted((r.cell, r.v) for r in qu.restore(after, ["v"], path).collect()) == [("a", 0.1), ("b", None), ("d", 0.7)]


def test_topic_round_trip(spark, tmp_path):
    """What a sink writes, a source reads back."""
    from vistagrid.streaming import streams as st

    spark.createDataFrame([(1, "x"), (2, None)], "event_id long, cell string").write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema("event_id long, cell string").parquet(str(tmp_path / "in"))
    st.write_topic(events, str(tmp_path / "cp"), path=str(tmp_path / "out")).awaitTermination()
    back = st.read_topic(spark, "event_id long, cell string", str(tmp_path / "out"))
    back.writeStream.format("memory").queryName("topic_back").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.event_id, r.cell) for r in spark.table("topic_back").collect()) == [(1, "x"), (2, None)]


def test_polygons_spread_over_cells_are_never_broadcast(spark):
    # Few polygons become many rows; a broadcast of them ended the driver.
    tiles, areas, places = (domain(spark, SF, n) for n in ("tiles", "areas", "places"))
    for df in (sp.tile_polygon_distances(tiles, areas, GRID, 5000.0), sp.touching_tiles(tiles, areas, GRID, "area_id"), sp.point_in_polygon(places, areas, GRID)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        exact = [k for k in plan.split("\n") if "BroadcastHashJoin" in k and ("__cell" in k or "__env" in k)]
        assert not exact and "SortMergeJoin" in plan


def test_compact_tables_are_dealt_to_all_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert all(domain(spark, SF, name).rdd.getNumPartitions() == n for name in ("areas", "raster_tiles"))
