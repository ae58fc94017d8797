"""Request ranking, anchors, waypoint rings and spatial lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, scoring, text
from vistagrid.operators import requests as rq
from vistagrid.operators import rings
from vistagrid.operators import spatial as sp
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.tile_plans import SCORED, scored_tiles
from vistagrid.sources.fixtures import GRID, domain

V36, V37 = catalog.VERSIONS["3.6"], catalog.VERSIONS["3.7"]
TR = "trip_requests"
KS = catalog.COMPONENTS


def trips(spark, sf):
    return domain(spark, sf, TR, ("customer",)).withColumns({"vibes": text.parse_vibes("vibes_json"), "preferences": F.create_map().cast("map<string,double>")})


_prof = "(SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{w}e0' for w in p[1])}, {str(p[4]).lower()}, {str(bool(p[3])).lower()}, {p[5]}e0, {p[6]}e0)" for k, p in catalog.VIBE_PROFILES.items()) + f") v(vibe, {', '.join(f'w_{k}' for k in KS)}, outw, hasanti, mb, mm))"
PREP = f"""rv AS (SELECT DISTINCT request_id, unnest(CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[])) AS vibe FROM trip_requests),
  prepared AS (SELECT t.*, b.* EXCLUDE (request_id), CASE WHEN o THEN budget / 4.2e0 ELSE budget / 6.5e0 END AS radius0, greatest(2.5e0, CASE WHEN o THEN budget / 4.2e0 ELSE budget / 6.5e0 END) AS radius_km,
    greatest(4, least(22, CASE WHEN o THEN ceil(ceil(budget / 5e0) * 1.65e0) ELSE ceil(budget / 5e0) END)) AS ring FROM trip_requests t JOIN (
      SELECT request_id, {', '.join(f'avg(w_{k}) AS w_{k}' for k in KS)}, bool_or(outw) AND bool_or(hasanti) AS o, avg(mb) AS min_best, avg(mm) AS min_mean FROM rv JOIN {_prof} USING (vibe) GROUP BY 1) b USING (request_id))"""
NEAR = f"""{SCORED}, fits AS ({q.fit_rows('scored')}), {PREP}, starts AS (SELECT * FROM ({q.axial('lat', 'lon', 7, 'prepared')})),
  ringed AS (SELECT s.request_id, s.radius_km, t.cell, t.tile_key, {q.hav('s.lat', 's.lon', 't.lat', 't.lon', '6371e0')} AS distance_km, {q.tile_score({k: f's.w_{k}' for k in KS})} AS scenic
    FROM starts s JOIN scored t ON greatest(abs(t.q - s.cq), abs(t.r - s.cr), abs(t.q - s.cq + t.r - s.cr)) <= s.ring),
  fitted AS (SELECT r.request_id, r.cell, avg(f.fit) AS fit FROM ringed r JOIN rv USING (request_id) JOIN fits f ON f.tile_key = r.tile_key AND f.vibe = rv.vibe GROUP BY ALL),
  near AS (SELECT r.*, f.fit, round(scenic * 0.35e0 + fit * 0.55e0 + (1 - least(1e0, abs(distance_km - radius_km) / greatest(1e0, radius_km))) * 0.1e0, 9) AS selection FROM ringed r JOIN fitted f USING (request_id, cell)),
  ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY selection DESC, cell) AS position FROM near) WHERE position <= 48)"""


def ranked(spark, sf, *keep, carry=None, roads=None):
    """Tile lists of all requests with the named request columns."""
    # Component columns are held, since each of the nine fits would carry their whole expressions again.
    tiles = rings.held(domain(spark, sf, "tiles", ("part",)), **scoring.component_columns())
    return rq.rank_tiles(rq.prepare_requests(trips(spark, sf)), tiles, GRID, ["request_id", *keep], carry, roads)


@query("ring_tile_counts", oracle([TR, "tiles"], "SELECT request_id, count(*) AS tiles, sum(tile_key)::BIGINT AS key_sum FROM ringed GROUP BY 1", extra=NEAR))
def ring_tile_counts(spark, sf):
    p = rq.prepare_requests(trips(spark, sf)).select("request_id", "lat", "lon", "ring")
    t = domain(spark, sf, "tiles").select("cell", "tile_key")
    return sp.ring_join(p, t, GRID).groupBy("request_id").agg(F.count("*").alias("tiles"), F.sum("tile_key").alias("key_sum"))


@query("ranked_tiles", oracle([TR, "tiles"], "SELECT request_id, position, cell, scenic, fit, distance_km, selection FROM ranked", "scenic fit distance_km selection", NEAR))
def ranked_tiles(spark, sf):
    return rq.ranked_rows(ranked(spark, sf)).select("request_id", "position", "cell", "scenic", "fit", "distance_km", "selection")


@query("anchored_tiles")
def anchored_tiles(spark, sf):
    """Ranking at road anchors; the ranking and the anchor lookup are each checked by SQL on their own."""
    out = ranked(spark, sf, "lat", "lon", "radius_km", roads=domain(spark, sf, "roads"))
    return rq.ranked_rows(out).select("request_id", "position", "cell", "anchor_lat", "anchor_lon", "distance_km", "selection")


@query("vibe_availability", oracle([TR, "tiles"], """SELECT request_id, tiles, best, mean12, CASE WHEN tiles < 3 THEN 'no_scenic_data' WHEN best >= greatest(0.32e0, min_best) AND mean12 >= greatest(0.26e0, min_mean) THEN 'available' ELSE 'weak_fit' END AS availability
    FROM (SELECT request_id, count(*) AS tiles, max(fit) AS best, avg(fit) FILTER (k <= 12) AS mean12 FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fit DESC, cell) AS k FROM ranked) GROUP BY 1) JOIN prepared USING (request_id)""", "best mean12", NEAR))
def vibe_availability(spark, sf):
    return rq.vibe_availability(ranked(spark, sf, "min_best", "min_mean"))


@query("ring_parameters", oracle([TR], "SELECT request_id, CAST(ring AS BIGINT) AS ring, radius_km FROM prepared", "radius_km", PREP))
def ring_parameters(spark, sf):
    return rq.prepare_requests(trips(spark, sf)).select("request_id", "ring", "radius_km")


@query("waypoint_counts", oracle([TR], """SELECT request_id, CASE WHEN request_id % 4 = 0 THEN '8,6,4' ELSE (SELECT string_agg(x, ',' ORDER BY p) FROM (SELECT x, min(p) AS p FROM (SELECT unnest([k, greatest(2, k - 1), least(10, k + 1), 8, 6, 4]) AS x, unnest([1, 2, 3, 4, 5, 6]) AS p) GROUP BY x)) END AS counts
    FROM (SELECT request_id, CAST(greatest(2, least(10, floor(request_id % 23 / 2e0 + 0.5e0))) AS BIGINT) AS k FROM trip_requests)"""))
def waypoint_counts(spark, sf):
    learned = F.when(F.col("request_id") % 4 != 0, F.col("request_id") % 23 / 2.0)
    return domain(spark, sf, TR).select("request_id", F.array_join(F.transform(rq.waypoint_counts(learned), lambda x: x.cast("string")), ",").alias("counts"))


@query("geometric_ring_counts", oracle([TR], "SELECT request_id, k AS kind, n FROM trip_requests, (VALUES ('synthetic', 61), ('budget', 120), ('diversity', 8)) v(k, n)"))
def geometric_ring_counts(spark, sf):
    return rq.geometric_rings(domain(spark, sf, TR)).groupBy("request_id", "kind").agg(F.count("*").alias("n"))


@query("top_tiles", oracle(["tiles"], "SELECT cell, scenic_score FROM tiles ORDER BY scenic_score DESC, cell LIMIT 50", "scenic_score"))
def top_tiles(spark, sf):
    return domain(spark, sf, "tiles").select("cell", "scenic_score").orderBy(F.desc("scenic_score"), "cell").limit(50)


def _regions(score: str) -> str:
    return f"""SELECT request_id, position, cell, composite, feature, confidence FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY composite DESC, cell) AS position FROM (
      SELECT *, round({score}, 9) AS composite, CASE WHEN water_proximity = top THEN 'waterfront' WHEN elevation_variance = top THEN 'elevation' WHEN natural_land_use = top THEN 'nature' WHEN poi_density = top THEN 'landmarks' ELSE 'views' END AS feature,
        greatest(0.1e0, (water_proximity + elevation_variance + natural_land_use + poi_density + visual_complexity) / 5) AS confidence
      FROM (SELECT p.request_id, s.* , greatest(water_proximity, elevation_variance, natural_land_use, poi_density, visual_complexity) AS top, row_number() OVER (PARTITION BY p.request_id ORDER BY scenic_score DESC, s.cell) AS n
        FROM trip_requests p JOIN scored s ON s.scoring_version = '{V37}' AND abs(s.lat - p.lat) < 0.13 AND {q.hav('p.lat', 'p.lon', 's.lat', 's.lon')} <= 12000) WHERE n <= 15)) WHERE position <= 5"""


@query("scenic_regions", oracle([TR, "tiles"], _regions(q.tile_score({k: f'{w}e0' for k, w in zip(KS, catalog.VIBE_PROFILES['coastal'][1])})), "composite confidence", SCORED))
def scenic_regions(spark, sf):
    return rq.scenic_regions(domain(spark, sf, TR, ("customer",)).select("request_id", "lat", "lon"), scored_tiles(spark, sf), 12000.0, 5, GRID, V37, "coastal")


@query("tiles_within_radius", oracle([TR, "tiles"], f"""SELECT p.request_id, t.cell, {q.hav('p.lat', 'p.lon', 't.lat', 't.lon')} AS distance_m FROM trip_requests p JOIN tiles t ON abs(t.lat - p.lat) < 0.06 AND {q.hav('p.lat', 'p.lon', 't.lat', 't.lon')} <= 5000""", "distance_m"))
def tiles_within_radius(spark, sf):
    t = domain(spark, sf, "tiles").select("cell", F.col("lat").alias("tile_lat"), F.col("lon").alias("tile_lon"))
    return sp.within_radius(domain(spark, sf, TR).select("request_id", "lat", "lon"), t, 5000.0, GRID).select("request_id", "cell", "distance_m")


@query("nearest_tiles", oracle([TR, "tiles"], f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY distance_m, cell) AS position FROM (
    SELECT p.request_id, t.cell, {q.hav('p.lat', 'p.lon', 't.lat', 't.lon')} AS distance_m FROM trip_requests p JOIN tiles t ON abs(t.lat - p.lat) < 0.09) WHERE distance_m <= 8000) WHERE position <= 4""", "distance_m"))
def nearest_tiles(spark, sf):
    t = domain(spark, sf, "tiles").select("cell", F.col("lat").alias("tile_lat"), F.col("lon").alias("tile_lon"))
    return sp.nearest_k(domain(spark, sf, TR).select("request_id", "lat", "lon"), t, 8000.0, 4, GRID, "request_id", "cell").select("request_id", "cell", "distance_m", "position")


@query("places_in_areas", oracle(["places", "areas"], """SELECT place_id, area_id FROM places JOIN areas ON lon >= ring[1].lon AND lon < ring[3].lon AND lat >= ring[1].lat AND lat < ring[3].lat"""))
def places_in_areas(spark, sf):
    return sp.point_in_polygon(domain(spark, sf, "places").select("place_id", "lon", "lat"), domain(spark, sf, "areas"), GRID).select("place_id", "area_id")


_ord = "CASE lower(coalesce(road_type, 'unknown')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in rq.ROAD_ORDER.items()) + " ELSE 5 END"
_comf = "CASE " + " ".join(f"WHEN lower(coalesce(road_type, 'unknown')) IN ({', '.join(repr(n) for n in names)}) THEN {v}e0" for names, v in rq.ROAD_COMFORT) + " ELSE 0.65e0 END"
_spd = "CASE WHEN speed_kmh <= 0 THEN 0.62e0 WHEN speed_kmh <= 40 THEN 0.88e0 WHEN speed_kmh <= 60 THEN 0.74e0 WHEN speed_kmh <= 80 THEN 0.48e0 ELSE 0.2e0 END"
_seg = [q.pt_seg("t.lon * s", "t.lat * 111320", f"g[{i}].lon * s", f"g[{i}].lat * 111320", f"g[{i + 1}].lon * s", f"g[{i + 1}].lat * 111320") for i in (1, 2)]


@query("road_anchors", oracle(["tiles", "roads"], f"""SELECT cell, coalesce(b.lat2, tlat) AS anchor_lat, coalesce(b.lon2, tlon) AS anchor_lon FROM (SELECT cell, lat AS tlat, lon AS tlon FROM tiles) LEFT JOIN (
    SELECT cell, arg_max(lat2, sc) AS lat2, arg_max(lon2, sc) AS lon2 FROM (SELECT *, round({_comf} * 0.28e0 + {_spd} * 0.18e0 + (1 - road_stress_score) * 0.2e0
        + {q.cl('curvature * 0.65e0 + least(abs(elevation_change), 80) / 80 * 0.2e0 + least(length_m, 1200) / 1200 * 0.15e0')} * 0.17e0
        + {q.cl('scenic_score * 0.35e0 + water_visibility_score * 0.18e0 + green_score * 0.16e0 + solitude_score * 0.16e0 + curve_score * 0.15e0')} * 0.17e0, 9)::DECIMAL(18, 9) * 1000000000000000 - road_id::DECIMAL(38, 0) / 1000 AS sc,
      row_number() OVER (PARTITION BY cell ORDER BY {_ord}, curvature DESC, length_m DESC, road_id) AS n FROM (
        SELECT t.* , r.* EXCLUDE (cell, geom), g[2].lat AS lat2, g[2].lon AS lon2 FROM (SELECT *, cos(radians(lat)) * 111320 AS s FROM tiles) t JOIN (SELECT *, geom AS g FROM roads) r
          ON abs(g[1].lat - t.lat) < 0.03 AND abs(g[1].lon - t.lon) < 0.04 WHERE least({_seg[0]}, {_seg[1]}) <= 900)) WHERE n <= 24 GROUP BY 1) b USING (cell)""", "anchor_lat anchor_lon"))
def road_anchors(spark, sf):
    t = domain(spark, sf, "tiles").withColumns({"tile_lat": F.col("lat"), "tile_lon": F.col("lon")})
    return rq.anchor_join(t, domain(spark, sf, "roads"), GRID)


_node = "concat(CAST(round(geom[{i}].lat * 1e7) AS BIGINT), ',', CAST(round(geom[{i}].lon * 1e7) AS BIGINT))"


@query("road_edges", oracle(["roads", "tiles"], f"SELECT road_id, {_node.format(i=1)} AS from_node, {_node.format(i=3)} AS to_node, 1 - coalesce(scenic_score, 0.5e0) + length_m / 100000 AS weight FROM roads LEFT JOIN (SELECT cell, scenic_score FROM tiles) USING (cell)", "weight"))
def road_edges(spark, sf):
    t = domain(spark, sf, "tiles").select("cell", F.col("scenic_score").alias("tile_score"))
    return rq.road_edges(domain(spark, sf, "roads"), t)


@query("nearest_nodes", oracle([TR, "roads"], f"""SELECT request_id, distance2 FROM (SELECT request_id, min(d2) AS distance2 FROM (SELECT p.request_id, (n.lat - p.lat) ** 2 + (n.lon - p.lon) ** 2 AS d2 FROM trip_requests p JOIN n ON abs(n.lat - p.lat) < 0.05 AND abs(n.lon - p.lon) < 0.05) GROUP BY 1
    UNION ALL SELECT request_id, min((n.lat - p.lat) ** 2 + (n.lon - p.lon) ** 2) FROM (SELECT request_id + 10000000 AS request_id, lat - request_id % 80 AS lat, lon + 5 + request_id % 120 AS lon FROM trip_requests WHERE request_id % 16 = 0) p CROSS JOIN n GROUP BY 1)""", "distance2",
    "n AS (SELECT DISTINCT geom[1].lat AS lat, geom[1].lon AS lon FROM roads UNION SELECT DISTINCT geom[3].lat, geom[3].lon FROM roads)"))
def nearest_nodes(spark, sf):
    """All requests, and a sixteenth of them moved far from every node."""
    nodes = rq.road_ends(domain(spark, sf, "roads"))
    r = domain(spark, sf, TR).select("request_id", "lat", "lon")
    far = r.where("request_id % 16 = 0").select((F.col("request_id") + 10000000).alias("request_id"), (F.col("lat") - F.col("request_id") % 80).alias("lat"),
                                                (F.col("lon") + 5 + F.col("request_id") % 120).alias("lon"))
    return sp.nearest_node(r.unionByName(far), nodes, GRID, "request_id")


@query("recent_requests", oracle(["requests"], """SELECT 'latest' AS kind, request_id FROM (SELECT * FROM requests ORDER BY created_us DESC, request_id DESC LIMIT 40) UNION ALL
    SELECT 'per_user', request_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_us DESC, request_id DESC) AS n FROM requests) WHERE n <= 2"""))
def recent_requests(spark, sf):
    r = domain(spark, sf, "requests")
    return rq.recent_starts(r, 40).select(F.lit("latest").alias("kind"), "request_id").unionByName(rq.recent_per_user(r, 2).select(F.lit("per_user").alias("kind"), "request_id"))


@query("coverage_differences", oracle(["tiles", "traffic", "roads"], """SELECT cell, 'missing' AS side FROM (SELECT cell FROM tiles EXCEPT SELECT cell FROM traffic) UNION ALL SELECT cell, 'extra' FROM (SELECT cell FROM traffic EXCEPT SELECT cell FROM tiles)"""))
def coverage_differences(spark, sf):
    return rq.coverage_diff(domain(spark, sf, "tiles"), domain(spark, sf, "traffic"), "cell")


@query("table_counts", oracle(["places", "buildings"], "SELECT 'places' AS table_name, count(*) AS n FROM places UNION ALL SELECT 'buildings', count(*) FROM buildings"))
def table_counts(spark, sf):
    return rq.union_counts(places=domain(spark, sf, "places"), buildings=domain(spark, sf, "buildings"))
