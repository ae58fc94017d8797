"""Scans, staging, exports and release files."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, geo
from vistagrid.operators.skew import numbered_in_ranges
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.sources import readers as rd
from vistagrid.sources.fixtures import domain

V36, V37 = catalog.VERSIONS["3.6"], catalog.VERSIONS["3.7"]
BOX = (-79.9, 43.05, -79.0, 43.45)


@query("tiles_of_version", oracle(["tiles"], f"SELECT cell, scenic_score, bridge_coastal_score, last_scored_us FROM tiles WHERE scoring_version = '{V37}'",
                                  "scenic_score bridge_coastal_score"))
def tiles_of_version(spark, sf):
    return domain(spark, sf, "tiles").where(F.col("scoring_version") == V37).select("cell", "scenic_score", "bridge_coastal_score", "last_scored_us")


@query("road_scan", oracle(["roads"], "SELECT road_id, way_id, cell, length_m, speed_kmh, road_type, surface, len(geom) AS points FROM roads", "length_m"))
def road_scan(spark, sf):
    return domain(spark, sf, "roads").select(
        "road_id", "way_id", "cell", "length_m", "speed_kmh", "road_type", "surface", F.size("geom").alias("points"))


def boxed(df):
    return df.withColumn("bbox", F.struct(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")))


@query("places_in_bbox", oracle(["places"], f"""SELECT place_id, name, category, confidence FROM places WHERE lon >= {BOX[0]} AND lon < {BOX[2]}
    AND lat >= {BOX[1]} AND lat <= {BOX[3]} AND (confidence IS NULL OR confidence >= 0.6)""", "confidence"))
def places_in_bbox(spark, sf):
    return rd.places_in_box(boxed(domain(spark, sf, "places")), BOX).select("place_id", "name", "category", "confidence")


@query("building_centroids", oracle(["areas"], "SELECT area_id AS id, (ring[1].lon + ring[3].lon) / 2 AS lon, (ring[1].lat + ring[3].lat) / 2 AS lat FROM areas", "lon lat"))
def building_centroids(spark, sf):
    return rd.footprint_centroids(domain(spark, sf, "areas").withColumnRenamed("area_id", "id"))


@query("longitude_strips", oracle(["buildings"], """SELECT CAST(floor((lon + 141) / 0.5e0) AS BIGINT) AS strip, count(*) AS n, min(lon) AS min_lon, max(lon) AS max_lon
    FROM buildings WHERE lon IS NOT NULL GROUP BY 1""", "min_lon max_lon"))
def longitude_strips(spark, sf):
    df = rd.lon_strips(domain(spark, sf, "buildings").where("lon IS NOT NULL"), 0.5, -141.0)
    return df.groupBy("strip").agg(F.count("*").alias("n"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def staged_places(spark, sf):
    """Every fourth place arrives twice with a blank name, and every ninth without a position."""
    p = domain(spark, sf, "places")
    again = p.where("place_id % 4 = 0").withColumns({"name": F.lit(""), "confidence": F.col("confidence") / 2})
    return p.unionByName(again).withColumn("lon", F.when(F.col("place_id") % 9 != 0, F.col("lon")))


@query("normalized_places", oracle(["places"], "SELECT place_id, name, category, confidence, lon, lat FROM places WHERE place_id % 9 <> 0 AND place_id % 4 <> 0 "
    "UNION ALL SELECT place_id, name, category, confidence, lon, lat FROM places WHERE place_id % 9 <> 0 AND place_id % 4 = 0", "confidence lon lat"))
def normalized_places(spark, sf):
    return rd.normalize_places(staged_places(spark, sf)).select("place_id", "name", "category", "confidence", "lon", "lat")


@query("traffic_rows", oracle(["traffic_raw"], """SELECT event_id, trim(cell_text) AS cell, greatest(0e0, least(1e0, coalesce(try_cast(score_text AS DOUBLE), 0.5e0))) AS traffic_score
    FROM traffic_raw WHERE trim(cell_text) <> ''""", "traffic_score"))
def traffic_rows(spark, sf):
    return rd.parse_traffic(domain(spark, sf, "traffic_raw"))


@query("traffic_upserts", oracle(["traffic"], """SELECT cell, traffic_score, event_id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ts_us DESC, event_id DESC) AS n FROM traffic) WHERE n = 1""", "traffic_score"))
def traffic_upserts(spark, sf):
    t = domain(spark, sf, "traffic")
    late = F.col("event_id") % 2 == 1
    return rd.upsert_latest(t.where(~late), t.where(late), ["cell"], ["ts_us", "event_id"]).select("cell", "traffic_score", "event_id")


@query("loaded_polygons", oracle(["water"], "SELECT water_id, len(ring) AS points, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS scalerank FROM water"))
def loaded_polygons(spark, sf):
    df = rd.load_polygons(domain(spark, sf, "water"), {"name": "string", "scalerank": "double"})
    return df.select("water_id", F.size("ring").alias("points"), "name", "scalerank")


@query("appended_pages", oracle(["areas", "water"], "SELECT area_id AS feature_id, 'areas' AS page FROM areas WHERE area_id % 3 <> 0 UNION ALL SELECT water_id, 'water' FROM water"))
def appended_pages(spark, sf):
    empty = F.when(F.col("area_id") % 3 != 0, F.col("ring"))
    first = domain(spark, sf, "areas").select(F.col("area_id").alias("feature_id"), F.lit("areas").alias("page"), empty.alias("ring"))
    second = domain(spark, sf, "water").select(F.col("water_id").alias("feature_id"), F.lit("water").alias("page"), "ring")
    return rd.drop_empty_rings(first.unionByName(second)).select("feature_id", "page")


@query("exploded_multipolygons", oracle(["areas"], """SELECT area_id, p AS part_no, CASE WHEN area_id % 5 = 0 THEN NULL ELSE 10 + area_id % 7 END AS class_id, len(ring) AS points
    FROM areas, range(0, 2) r(p) WHERE p <= area_id % 2"""))
def exploded_multipolygons(spark, sf):
    a = domain(spark, sf, "areas")
    parts = F.when(F.col("area_id") % 2 == 1, F.array("ring", "ring")).otherwise(F.array("ring"))
    klass = F.when(F.col("area_id") % 5 == 0, "forest").otherwise((10 + F.col("area_id") % 7).cast("string"))
    df = a.select("area_id", parts.alias("parts"), klass.alias("class_text"))
    return rd.explode_multipolygon(df).select("area_id", "part_no", "class_id", F.size("ring").alias("points"))


@query("raster_tile_summary", oracle(["raster_tiles"], """SELECT count(*) AS raster_tiles, min(width) AS min_width, max(width) AS max_width, CAST(sum(len(landcover)) AS BIGINT) AS pixels,
    min(x0) AS min_x, max(y0) AS max_y FROM raster_tiles""", "min_x max_y"))
def raster_tile_summary(spark, sf):
    return rd.raster_summary(domain(spark, sf, "raster_tiles"))


@query("light_sample_summary", oracle(["light_samples"], """SELECT count(*) AS sample_rows, count(*) FILTER (darkness_score <> 0.5) AS changed_rows, min(darkness_score) AS min_darkness,
    avg(darkness_score) AS avg_darkness, max(darkness_score) AS max_darkness, stddev_pop(darkness_score) AS stddev_darkness FROM light_samples""",
    "min_darkness avg_darkness max_darkness stddev_darkness"))
def light_sample_summary(spark, sf):
    return rd.light_sample_summary(domain(spark, sf, "light_samples"))


@query("target_sample_points", oracle(["tiles"], f"SELECT cell, lon, lat FROM tiles WHERE coalesce(scoring_version, '') <> '{V37}'", "lon lat"))
def target_sample_points(spark, sf):
    return rd.sample_points(domain(spark, sf, "tiles"), V37)


@query("release_rows", oracle(["tiles"], f"SELECT {', '.join(rd.EXPORT_COLUMNS)} FROM tiles WHERE scoring_version = '{V37}'",
                              " ".join(n for n in rd.EXPORT_COLUMNS if n in catalog.TILE_SCORES)))
def release_rows(spark, sf):
    return rd.release_rows(domain(spark, sf, "tiles"), V37)


@query("release_statistics", oracle(["tiles"], f"""SELECT count(*) AS tile_count, min(scenic_score) AS min_score, max(scenic_score) AS max_score, avg(scenic_score) AS avg_score,
    stddev_pop(scenic_score) AS stddev_score, min(last_scored_us) AS first_scored_us, max(last_scored_us) AS last_scored_us,
    concat('{{"tile_count":', count(*), ',"first_scored_us":', min(last_scored_us), ',"last_scored_us":', max(last_scored_us), '}}') AS stats_json
    FROM tiles WHERE scoring_version = '{V37}'""", "min_score max_score avg_score stddev_score"))
def release_statistics(spark, sf):
    return rd.release_stats(domain(spark, sf, "tiles"), V37)


@query("segment_endpoints", oracle(["roads"], """SELECT road_id, geom[1].lat AS start_lat, geom[1].lon AS start_lon, geom[3].lat AS end_lat, geom[3].lon AS end_lon
    FROM roads WHERE elevation_change = 0""", "start_lat start_lon end_lat end_lon"))
def segment_endpoints(spark, sf):
    return rd.segment_endpoints(domain(spark, sf, "roads"))




def _document_sql(name: str, head: str, point: str, between: str, foot: str) -> str:
    part = f"CAST(floor(seq / {rd.EXPORT_SPAN}) AS BIGINT) + 1"
    return f"""SELECT route_id, {part} AS part, concat(CASE WHEN {part} > 1 THEN '{between}' ELSE '' END, string_agg({point}, '{between}' ORDER BY seq)) AS {name} FROM route_points GROUP BY 1, 2
    UNION ALL SELECT DISTINCT route_id, 0, {head} FROM route_points UNION ALL SELECT route_id, max({part}) + 1, '{foot}' FROM route_points GROUP BY 1"""


@query("exported_geojson", oracle(["route_points"], _document_sql(
    "geojson", """concat('{"type":"Feature","properties":{"routeId":', route_id, '},"geometry":{"type":"LineString","coordinates":[')""", "concat('[', lon, ',', lat, ']')", ",", "]}}")))
def exported_geojson(spark, sf):
    return rd.export_geojson(domain(spark, sf, "route_points"))


@query("exported_gpx", oracle(["route_points"], _document_sql(
    "gpx", """concat('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Loop &amp; &quot;view&quot; ', route_id, '</name><trkseg>')""",
    """concat('<trkpt lat="', lat, '" lon="', lon, '" />')""", "", "</trkseg></trk></gpx>")))
def exported_gpx(spark, sf):
    return rd.export_gpx(domain(spark, sf, "route_points"), 'Loop & "view"')


@query("polygon_measures", oracle(["areas"], """SELECT area_id, ring[1].lon AS min_lon, ring[1].lat AS min_lat, ring[3].lon AS max_lon, ring[3].lat AS max_lat,
    (ring[1].lon + ring[3].lon) / 2 AS centroid_lon, (ring[1].lat + ring[3].lat) / 2 AS centroid_lat, (ring[3].lon - ring[1].lon) * (ring[3].lat - ring[1].lat) AS area FROM areas""",
    "min_lon min_lat max_lon max_lat centroid_lon centroid_lat area"))
def polygon_measures(spark, sf):
    df = domain(spark, sf, "areas").select("area_id", geo.envelope("ring").alias("e"), geo.polygon_centroid("ring").alias("c"), (geo.ring_area2("ring") / 2).alias("area"))
    return df.select("area_id", "e.*", F.col("c.lon").alias("centroid_lon"), F.col("c.lat").alias("centroid_lat"), "area")


@query("decoded_polylines", oracle(["route_points"], """SELECT route_id * 1000 + CAST(floor(seq / 40) AS BIGINT) AS path_id, seq % 40 AS seq, round(lat * 1e5) / 1e5 AS lat, round(lon * 1e5) / 1e5 AS lon
    FROM (SELECT route_id, seq, round(lat + 3e-6, 6) AS lat, round(lon - 3e-6, 6) AS lon FROM route_points)""", "lat lon"))
def decoded_polylines(spark, sf):
    """Paths of 40 points are encoded on the JVM and decoded again to point rows."""
    p = domain(spark, sf, "route_points").withColumns({
        "path_id": F.col("route_id") * 1000 + F.floor(F.col("seq") / 40), "lat": F.round(F.col("lat") + 3e-6, 6), "lon": F.round(F.col("lon") - 3e-6, 6)})
    paths = p.groupBy("path_id").agg(F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("pts"))
    return rd.explode_polyline(paths.select("path_id", rd.encode_polyline(F.col("pts")).alias("encoded")), "encoded", "path_id")


@query("spec_road_scores", oracle(["roads", "tiles"], """SELECT road_id AS id, road_type AS highway_type, length_m, curvature AS curvature_score,
    greatest(0e0, least(1e0, abs(elevation_change) / 100)) AS elevation_score, coalesce(1 - (1 - least(1e0, road_density)), 0.5e0) AS traffic_score,
    coalesce(natural_land_use, 0.5e0) AS greenery_score, coalesce(scenic_score, 0.5e0) AS scenic_score FROM roads LEFT JOIN tiles USING (cell)""",
    "length_m curvature_score elevation_score traffic_score greenery_score scenic_score"))
def spec_road_scores(spark, sf):
    return _views(spark, sf)["road_segment_scores"]


def _views(spark, sf):
    routes = domain(spark, sf, "routes").withColumn("job_id", F.col("route_id"))
    return rd.spec_views(domain(spark, sf, "roads"), domain(spark, sf, "tiles"), domain(spark, sf, "requests"), routes)


@query("spec_routes", oracle(["routes", "requests"], """SELECT r.route_id AS id, r.route_id AS job_id, km * 1000 AS total_distance_m, minutes * 60 AS estimated_duration_s, score AS scenic_score,
    q.lat AS start_lat, q.lon AS start_lng, q.budget AS time_budget_minutes, 'STANDARD' AS quality_tier FROM routes r JOIN requests q ON q.request_id = r.route_id""",
    "total_distance_m scenic_score start_lat start_lng"))
def spec_routes(spark, sf):
    return _views(spark, sf)["route"]


@query("numbered_tiles", oracle(["tiles"], "SELECT cell, row_number() OVER (ORDER BY cell) AS rn FROM tiles"))
def numbered_tiles(spark, sf):
    """Global numbering by cell text, ranked inside ranges of the order."""
    return numbered_in_ranges(domain(spark, sf, "tiles").select("cell"), ["cell"]).select("cell", "rn")


@query("batch_plan", oracle(["tiles"], f"""SELECT CAST((rn - 1) // 300 AS BIGINT) AS batch, min(rn) AS start_rn, max(rn) AS end_rn, count(*) AS n, min(cell) AS first_cell FROM (
    SELECT cell, row_number() OVER (ORDER BY cell) AS rn FROM tiles WHERE coalesce(scoring_version, '') <> '{V37}') GROUP BY 1"""))
def batch_plan(spark, sf):
    df = numbered_in_ranges(rd.target_tiles(domain(spark, sf, "tiles"), V37).select("cell"), ["cell"])
    return df.withColumn("batch", F.floor((F.col("rn") - 1) / 300)).groupBy("batch").agg(
        F.min("rn").alias("start_rn"), F.max("rn").alias("end_rn"), F.count("*").alias("n"), F.min("cell").alias("first_cell"))


@query("target_tiles", oracle(["tiles"], f"""SELECT cell, 'any' AS scope FROM tiles WHERE coalesce(scoring_version, '') <> '{V37}' UNION ALL
    SELECT cell, 'from_previous' FROM tiles WHERE coalesce(scoring_version, '') = '{V36}'"""))
def target_tiles(spark, sf):
    t = domain(spark, sf, "tiles")
    return rd.target_tiles(t, V37).select("cell", F.lit("any").alias("scope")).unionByName(
        rd.target_tiles(t, V37, V36).select("cell", F.lit("from_previous").alias("scope")))


@query("required_sources", """SELECT * FROM (VALUES ('areas', 1), ('roads', 1), ('tiles', 1)) v(source, rows_seen)""")
def required_sources(spark, sf):
    return rd.require_sources(**{n: domain(spark, sf, n) for n in ("roads", "tiles", "areas")})
