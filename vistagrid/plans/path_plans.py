"""Path and route-scoring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, text
from vistagrid.operators import paths as pa
from vistagrid.operators.profiles import known_vibes
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.tile_plans import SCORED, scored_tiles
from vistagrid.sources.fixtures import GRID, domain

POINTS = "route_points"


def points(spark, sf):
    return domain(spark, sf, POINTS)


def trips(spark, sf):
    return domain(spark, sf, "trips").withColumn("vibes", known_vibes(text.parse_vibes("vibes_json")))


_next = "lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon"
_km = q.hav("lat", "lon", "nlat", "nlon", "6371e0")
STEPS = f"steps AS (SELECT *, CASE WHEN nlat IS NULL THEN 0e0 ELSE {_km} END AS to_next FROM (SELECT *, {_next} FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)))"
TURNS = f"""turns AS (SELECT route_id, coalesce(least(1e0, avg(CASE WHEN abs(b2 - b1) > 180 THEN 360 - abs(b2 - b1) ELSE abs(b2 - b1) END) / 90), 0e0) AS mean_turn FROM (
    SELECT route_id, CASE WHEN plat IS NOT NULL AND nlat IS NOT NULL THEN {q.brg('plat', 'plon', 'lat', 'lon')} END AS b1, {q.brg('lat', 'lon', 'nlat', 'nlon')} AS b2 FROM (
      SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, {_next} FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq))) GROUP BY 1)"""


def sampled_sql(name: str, metres: int) -> str:
    """Recursive walk over cumulative metres."""
    return f"""{name}_cum AS (SELECT route_id, seq, n_points, lat, lon, coalesce(sum(to_next * 1000) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS cum FROM steps),
      {name}_next AS MATERIALIZED (SELECT a.route_id, a.seq, min(b.seq) AS nxt FROM {name}_cum a JOIN {name}_cum b ON a.route_id = b.route_id AND b.cum - a.cum >= {metres} - 1e-7 GROUP BY 1, 2),
      {name}_walk AS (SELECT DISTINCT route_id, CAST(0 AS BIGINT) AS seq FROM route_points UNION ALL SELECT n.route_id, n.nxt FROM {name}_walk w JOIN {name}_next n ON n.route_id = w.route_id AND n.seq = w.seq),
      {name} AS (SELECT route_id, seq, n_points, lat, lon, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS idx, count(*) OVER (PARTITION BY route_id) AS n_samples FROM {name}_cum
        WHERE seq = n_points - 1 OR (route_id, seq) IN (SELECT (route_id, seq) FROM {name}_walk))"""


@query("distance_to_next", oracle([POINTS], "SELECT route_id, seq, to_next FROM steps", "to_next", STEPS))
def distance_to_next(spark, sf):
    return pa.distance_to_next(points(spark, sf)).select("route_id", "seq", "to_next")


@query("mean_turns", oracle([POINTS], "SELECT * FROM turns", "mean_turn", TURNS))
def mean_turns(spark, sf):
    return pa.mean_turn(points(spark, sf))


@query("compressed_cells", oracle([POINTS], f"""SELECT route_id, seq, cell FROM (SELECT *, lag(cell) OVER (PARTITION BY route_id ORDER BY seq) AS prev FROM (
    SELECT route_id, seq, {q.cell_text(8)} AS cell FROM ({q.axial('lat', 'lon', 8, POINTS)}))) WHERE prev IS NULL OR cell <> prev"""))
def compressed_cells(spark, sf):
    return pa.compress_cells(points(spark, sf), GRID).select("route_id", "seq", "cell")


def _even(n: int) -> str:
    return f"SELECT p.* FROM route_points p WHERE n_points <= {n} OR EXISTS (SELECT 1 FROM range(0, {n}) r(i) WHERE floor(i * (n_points - 1) / {n - 1}e0 + 0.5e0) = p.seq)"


@query("downsampled_points", oracle([POINTS], f"SELECT route_id, seq, 'even' AS mode FROM ({_even(20)}) UNION ALL SELECT route_id, seq, 'step' FROM route_points WHERE seq % greatest(1, CAST(ceil(n_points / 20e0) AS BIGINT)) = 0 OR seq = n_points - 1"))
def downsampled_points(spark, sf):
    p = points(spark, sf)
    return pa.downsample(p, 20).select("route_id", "seq", F.lit("even").alias("mode")).unionByName(
        pa.downsample_step(p, 20).select("route_id", "seq", F.lit("step").alias("mode")))


@query("segment_scores", oracle([POINTS], f"""SELECT s.route_id, seq, {q.cl('(0.3e0 + s.route_id % 7 / 10e0) * 0.82e0 + to_next / total * 0.12e0 + (1 - abs(seq / greatest(1, n_points - 2) - 0.5e0) * 2) * 0.06e0')} AS segment_score
    FROM steps s JOIN (SELECT route_id, sum(to_next) AS total FROM steps GROUP BY 1) t USING (route_id) WHERE seq < n_points - 1""", "segment_score", STEPS))
def segment_scores(spark, sf):
    p = points(spark, sf)
    return pa.segment_scores(p, p.select("route_id").distinct().withColumn("score", F.lit(0.3) + F.col("route_id") % 7 / 10.0))


@query("sampled_paths", oracle([POINTS], "SELECT route_id, seq, idx, n_samples FROM samples", extra=STEPS + ", " + sampled_sql("samples", 900), recursive=True))
def sampled_paths(spark, sf):
    return pa.sample_path(points(spark, sf), 900.0).select("route_id", "seq", "idx", "n_samples")


LEGS = """legs AS (SELECT *, CASE WHEN n_samples < 9 THEN NULL WHEN idx >= (CASE WHEN f > 3 THEN greatest(1, f // 5) ELSE 0 END) AND idx < f THEN 1 WHEN idx >= f AND idx < m THEN 2
    WHEN idx >= m AND idx < (CASE WHEN n_samples - m > 3 THEN n_samples - greatest(1, (n_samples - m) // 5) ELSE n_samples END) THEN 3 END AS leg
    FROM (SELECT *, greatest(f + 2, (n_samples * 2) // 3) AS m FROM (SELECT *, greatest(2, n_samples // 3) AS f FROM craft_samples)))"""


@query("path_legs", oracle([POINTS], "SELECT route_id, idx, leg FROM legs", extra=STEPS + ", " + sampled_sql("craft_samples", 350) + ", " + LEGS, recursive=True))
def path_legs(spark, sf):
    return pa.leg_split(pa.sample_path(points(spark, sf), 350.0)).select("route_id", "idx", "leg")


CRAFT = f"""{LEGS}, craft_cells AS (SELECT *, lag(cell) OVER (PARTITION BY route_id ORDER BY idx) AS prev FROM (SELECT route_id, idx, {q.cell_text(8)} AS cell FROM ({q.axial('lat', 'lon', 8, 'craft_samples')}))),
  line AS (SELECT *, CASE WHEN prev IS NOT NULL THEN least(cell, prev) || '|' || greatest(cell, prev) END AS edge FROM craft_cells WHERE prev IS NULL OR cell <> prev),
  shares AS (SELECT route_id, (count(*) - count(DISTINCT cell)) / count(*) AS repeated_cell_share, CASE WHEN count(*) < 3 THEN 0e0 ELSE (count(edge) - count(DISTINCT edge)) / count(edge) END AS reverse_overlap_share FROM line GROUP BY 1),
  seps AS (SELECT route_id, min(m) AS leg_separation FROM (SELECT route_id, a, b, avg(m) AS m FROM (SELECT route_id, least(l1, l2) AS a, greatest(l1, l2) AS b, l1, avg(least(1e0, d / 0.85e0)) AS m FROM (
      SELECT x.route_id, x.leg AS l1, y.leg AS l2, x.idx, min({q.hav('x.lat', 'x.lon', 'y.lat', 'y.lon', '6371e0')}) AS d FROM legs x JOIN legs y ON x.route_id = y.route_id AND x.leg <> y.leg GROUP BY ALL) GROUP BY ALL) GROUP BY ALL) GROUP BY 1),
  dups AS (SELECT route_id, count(DISTINCT idx) AS k FROM (SELECT x.route_id, x.idx FROM craft_samples x JOIN craft_samples y ON x.route_id = y.route_id AND y.idx > x.idx + 4
      AND NOT (x.idx <= 4 AND y.idx >= x.n_samples - 5) WHERE x.n_samples >= 8 AND {q.hav('x.lat', 'x.lon', 'y.lat', 'y.lon', '6371e0')} <= 0.12) GROUP BY 1),
  craft AS (SELECT *, least(1e0, repeated_cell_share * 0.34e0 + reverse_overlap_share * 0.3e0 + (1 - leg_separation) * 0.24e0 + near_duplicate_risk * 0.12e0) AS backtracking_penalty FROM (
    SELECT s.route_id, repeated_cell_share, reverse_overlap_share, coalesce(leg_separation, 1e0) AS leg_separation, coalesce(k, 0) / n.n AS near_duplicate_risk FROM shares s LEFT JOIN seps USING (route_id)
      LEFT JOIN dups USING (route_id) JOIN (SELECT route_id, max(n_samples) AS n FROM craft_samples GROUP BY 1) n USING (route_id)))"""
CRAFT_EXTRA = STEPS + ", " + sampled_sql("craft_samples", 350) + ", " + CRAFT
_craft_cols = "repeated_cell_share reverse_overlap_share leg_separation near_duplicate_risk backtracking_penalty"


@query("craft_metrics", oracle([POINTS], "SELECT * FROM craft", _craft_cols, CRAFT_EXTRA, recursive=True))
def craft_metrics(spark, sf):
    return pa.craft_metrics(points(spark, sf), GRID)


CORRIDOR = f"""{SCORED}, corridor AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY idx) - 1 AS pos, count(*) OVER (PARTITION BY route_id) AS n_tiles FROM (
    SELECT c.route_id, c.idx, t.*, p.* EXCLUDE (route_id), {q.tile_score({k: f'w_{k}' for k in catalog.COMPONENTS})} AS landscape, {q.URBAN} AS pressure, {q.OPEN_SPACE} AS opn
    FROM (SELECT route_id, idx, {q.cell_text(7)} AS cell FROM ({q.axial('lat', 'lon', 7, 'corridor_samples')})) c JOIN scored t USING (cell) JOIN trips p ON p.route_id = c.route_id)),
  fits AS ({q.fit_rows('scored')}), trip_vibes AS (SELECT DISTINCT route_id, unnest(CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[])) AS vibe FROM trips),
  fit_means AS (SELECT c.route_id, avg(f.fit) AS vibe_fit_score FROM corridor c JOIN trip_vibes v USING (route_id) JOIN fits f ON f.cell = c.cell AND f.vibe = v.vibe GROUP BY 1),
  means AS (SELECT route_id, avg(landscape) AS landscape_score, avg(pressure) AS urban_penalty, {', '.join(f'avg({s}) AS {s}' for s in pa.SIGNAL_MEANS)}, count(*) AS corridor_tile_samples,
    least(1e0, max(landscape) * 0.32e0 + count(*) FILTER (landscape >= 0.45) / count(*) * 0.46e0 + (1 - least(1e0, stddev_pop(landscape) / 0.35e0)) * 0.22e0) AS scenic_moments_score FROM corridor GROUP BY 1),
  edges AS (SELECT route_id, {q.cl('(1 - avg(landscape)) * 0.55e0 + avg(pressure) * 0.45e0')} AS start_end_penalty FROM corridor WHERE pos < least(4, n_tiles) OR pos >= greatest(least(4, n_tiles), n_tiles - least(4, n_tiles)) GROUP BY 1)"""
CORRIDOR_EXTRA = STEPS + ", " + sampled_sql("corridor_samples", 500) + ", " + CORRIDOR


@query("corridor_tiles", oracle([POINTS, "tiles", "trips"], "SELECT route_id, idx, pos, cell, n_tiles FROM corridor", extra=CORRIDOR_EXTRA, recursive=True))
def corridor_tiles(spark, sf):
    return pa.corridor_tiles(points(spark, sf), domain(spark, sf, "tiles").select("cell"), GRID).select("route_id", "idx", "pos", "cell", "n_tiles")


def corridor(spark, sf):
    return pa.corridor_scores(points(spark, sf), trips(spark, sf), scored_tiles(spark, sf), GRID)


@query("corridor_means", oracle([POINTS, "tiles", "trips"], "SELECT m.* EXCLUDE (scenic_moments_score), vibe_fit_score FROM means m JOIN fit_means USING (route_id)",
                                "landscape_score vibe_fit_score urban_penalty " + " ".join(pa.SIGNAL_MEANS), CORRIDOR_EXTRA, recursive=True))
def corridor_means(spark, sf):
    return pa.corridor_means(corridor(spark, sf))


@query("scenic_moments", oracle([POINTS, "tiles", "trips"], "SELECT route_id, scenic_moments_score FROM means", "scenic_moments_score", CORRIDOR_EXTRA, recursive=True))
def scenic_moments(spark, sf):
    return pa.scenic_moments(corridor(spark, sf))


@query("edge_penalties", oracle([POINTS, "tiles", "trips"], "SELECT * FROM edges", "start_end_penalty", CORRIDOR_EXTRA, recursive=True))
def edge_penalties(spark, sf):
    return pa.edge_penalty(corridor(spark, sf))


def _g(x, a, b):
    return q.cl(f"({x} - {a}e0) / {round(b - a, 4)}e0")


_lu, _ls = "(1 - pressure)", "(1 - road_stress_score)"
STRATEGY = f"""members AS (SELECT route_id, strategy, landscape, greatest(water, elevation, poi, scenic_poi_score, viewpoint_score) AS photo, {_g('greatest(water, bridge_coastal_score)', .38, .70)} AS mw,
    {_g(q.cl(f'opn * 0.68e0 + {_lu} * 0.2e0 + {_ls} * 0.12e0'), .40, .72)} AS mo, {_g(q.cl(f'solitude * 0.44e0 + greenery * 0.18e0 + {_lu} * 0.2e0 + {_ls} * 0.08e0 + darkness_score * 0.1e0'), .40, .72)} AS mq,
    {_g('greatest(curves, elevation)', .38, .70)} AS mc FROM corridor),
  tops AS (SELECT route_id, avg(v) AS top FROM (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY v DESC) AS rn, count(*) OVER (PARTITION BY route_id) AS n FROM (
      SELECT route_id, CASE strategy WHEN 'OPEN_SPACE_ESCAPE' THEN mo WHEN 'QUIET_LOW_PRESSURE' THEN mq WHEN 'CURVY_ELEVATION' THEN mc END AS v FROM members)) WHERE rn <= ceil(n * 0.35e0) GROUP BY 1),
  strat AS (SELECT route_id, water_share, open_share, quiet_share, curve_share, photo_peak, {q.cl('fit')} AS strategy_fit_score, {q.cl('(expected - fit) / expected')} AS strategy_mismatch_penalty FROM (
    SELECT *, CASE strategy WHEN 'PHOTO_PEAKS' THEN 0.68e0 WHEN 'BALANCED_VARIETY' THEN 0.38e0 ELSE 0.34e0 END AS expected, CASE strategy WHEN 'WATER_FOLLOWING' THEN water_share
      WHEN 'OPEN_SPACE_ESCAPE' THEN open_share * 0.62e0 + top * 0.38e0 WHEN 'QUIET_LOW_PRESSURE' THEN quiet_share * 0.62e0 + top * 0.38e0 WHEN 'PHOTO_PEAKS' THEN photo_peak
      WHEN 'CURVY_ELEVATION' THEN curve_share * 0.62e0 + top * 0.38e0 ELSE ((water_share >= 0.25)::INT + (open_share >= 0.25)::INT + (quiet_share >= 0.25)::INT + (curve_share >= 0.25)::INT) / 4 * 0.58e0
        + photo_peak * 0.22e0 + (water_share + open_share + quiet_share + curve_share) / 4 * 0.2e0 END AS fit
    FROM (SELECT route_id, any_value(strategy) AS strategy, avg(mw) AS water_share, avg(mo) AS open_share, avg(mq) AS quiet_share, avg(mc) AS curve_share, greatest(max(photo), max(landscape)) AS photo_peak FROM members GROUP BY 1)
      JOIN tops USING (route_id)))"""
_strat_cols = "water_share open_share quiet_share curve_share photo_peak strategy_fit_score strategy_mismatch_penalty"


@query("strategy_metrics", oracle([POINTS, "tiles", "trips"], "SELECT * FROM strat", _strat_cols, CORRIDOR_EXTRA + ", " + STRATEGY, recursive=True))
def strategy_metrics(spark, sf):
    return pa.strategy_metrics(corridor(spark, sf))


ENDS = f"""ends AS (SELECT route_id, {q.hav('la', 'lo', 'za', 'zo', '6371e0')} AS closure_km FROM (SELECT route_id, arg_min(lat, seq) AS la, arg_min(lon, seq) AS lo, arg_max(lat, seq) AS za, arg_max(lon, seq) AS zo FROM route_points GROUP BY 1))"""


@query("route_shapes", oracle([POINTS, "trips"], f"""SELECT route_id, closure_km, {q.cl('(1 - least(1e0, abs(minutes - target_minutes) / target_minutes)) * 0.45e0 + least(1e0, minutes / target_minutes) * 0.25e0 + greatest(0e0, 1 - closure_km / 10) * 0.3e0')} AS route_shape_score
    FROM ends JOIN trips USING (route_id)""", "closure_km route_shape_score", ENDS))
def route_shapes(spark, sf):
    df = pa.closure_km(points(spark, sf)).join(domain(spark, sf, "trips"), "route_id")
    return df.select("route_id", "closure_km", pa.route_shape(F.col("target_minutes"), F.col("minutes"), F.col("closure_km")).alias("route_shape_score"))


_parts = "landscape_score vibe_fit_score drive_quality_score route_shape_score scenic_moments_score urban_penalty start_end_penalty strategy_fit_score strategy_mismatch_penalty backtracking_penalty"
_final = q.cl("landscape_score * 0.38e0 + vibe_fit_score * 0.24e0 + drive_quality_score * 0.14e0 + route_shape_score * 0.1e0 + scenic_moments_score * 0.14e0 - urban_penalty * 0.1e0 - start_end_penalty * 0.06e0 - strategy_mismatch_penalty * 0.08e0 - backtracking_penalty * 0.08e0")


@query("scored_routes", oracle([POINTS, "tiles", "trips"], f"""SELECT route_id, {_final} AS final_score, false AS fallback, {_parts.replace(' ', ', ')} FROM (
    SELECT route_id, landscape_score, vibe_fit_score, {q.cl('mean_turn * 0.52e0 + (1 - urban_penalty) * 0.28e0 + (1 - road_stress_score) * 0.2e0')} AS drive_quality_score,
      {q.cl('(1 - least(1e0, abs(minutes - target_minutes) / target_minutes)) * 0.45e0 + least(1e0, minutes / target_minutes) * 0.25e0 + greatest(0e0, 1 - closure_km / 10) * 0.3e0')} AS route_shape_score,
      scenic_moments_score, urban_penalty, start_end_penalty, strategy_fit_score, strategy_mismatch_penalty, backtracking_penalty
    FROM means JOIN fit_means USING (route_id) JOIN edges USING (route_id) JOIN strat USING (route_id) JOIN ends USING (route_id) JOIN turns USING (route_id) JOIN craft USING (route_id) JOIN trips USING (route_id))""",
    "final_score " + _parts, CORRIDOR_EXTRA + ", " + STRATEGY + ", " + ENDS + ", " + TURNS + ", " + sampled_sql("craft_samples", 350) + ", " + CRAFT, recursive=True))
def scored_routes(spark, sf):
    return pa.score_routes(points(spark, sf), trips(spark, sf), scored_tiles(spark, sf), GRID)


@query("fallback_scores", oracle([POINTS, "trips", "tiles"], f"""SELECT route_id, {q.cl('density - backtracking_penalty * 0.08e0')} AS final_score FROM (SELECT route_id, 0.245e0 + mean_turn * 0.2e0 + greatest(0e0, 1 - closure_km / 15) * 0.1e0 AS density, backtracking_penalty
    FROM ends JOIN turns USING (route_id) JOIN craft USING (route_id))""", "final_score", ENDS + ", " + TURNS + ", " + CRAFT_EXTRA, recursive=True))
def fallback_scores(spark, sf):
    """Paths moved ten degrees north, away from every tile."""
    far = points(spark, sf)
    base = pa.closure_km(far).join(trips(spark, sf), "route_id").join(pa.mean_turn(far), "route_id").join(pa.craft_metrics(far, GRID), "route_id")
    base = base.withColumns({"start_lat": F.col("start_lat") + 30.0, "route_shape_score": F.lit(0.0)})
    return pa.fallback_score(base, scored_tiles(spark, sf), GRID).select("route_id", "final_score")
