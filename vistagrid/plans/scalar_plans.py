"""Geometry, cell and text scalars applied to whole domain tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from vistagrid.functions import catalog, cells, geo, scoring, text
from vistagrid.functions.scalars import clamp01, finite01, graded, round_half_up
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.sources.fixtures import GRID, domain

SECRET = "rotate-me"


@query("haversine_radii", oracle(["requests"], f"""SELECT request_id,
    {q.hav('lat', 'lon', '45e0', '-79e0')} AS metres, {q.hav('lat', 'lon', '45e0', '-79e0', '6371e0')} AS km,
    {q.hav('lat', 'lon', '45e0', '-79e0', '6371.0088e0')} AS km_report FROM requests""", "metres km km_report"))
def haversine_radii(spark, sf):
    args = ("lat", "lon", F.lit(45.0), F.lit(-79.0))
    return domain(spark, sf, "requests").select(
        "request_id", geo.haversine(*args).alias("metres"), geo.haversine(*args, geo.EARTH_KM).alias("km"),
        geo.haversine(*args, geo.EARTH_KM_REPORT).alias("km_report"))


@query("bearing_and_sector", oracle(["requests"], f"""SELECT request_id, b AS bearing, CAST(floor(b / 45e0) AS BIGINT) AS sector8,
    CAST(floor(b / 30e0) AS BIGINT) AS sector12 FROM (SELECT request_id, {q.brg('43.4e0', '-79.3e0', 'lat', 'lon')} AS b FROM requests)""", "bearing"))
def bearing_and_sector(spark, sf):
    b = geo.bearing(F.lit(43.4), F.lit(-79.3), "lat", "lon")
    return domain(spark, sf, "requests").select("request_id", b.alias("bearing")).select(
        "request_id", "bearing", geo.sector("bearing", 8).alias("sector8"), geo.sector("bearing", 12).alias("sector12"))


_dest = q.dest("lat", "lon", "(request_id % 360)", "(request_id % 50 - 5) * 1000e0")


@query("destination_points", oracle(["requests"], f"SELECT request_id, {_dest[0]} AS to_lat, {_dest[1]} AS to_lon FROM requests", "to_lat to_lon"))
def destination_points(spark, sf):
    d = geo.destination("lat", "lon", F.col("request_id") % 360, (F.col("request_id") % 50 - 5) * 1000.0)
    return domain(spark, sf, "requests").select("request_id", d.alias("d")).select(
        "request_id", F.col("d.lat").alias("to_lat"), F.col("d.lon").alias("to_lon"))


_bx = {n: q.dest("lat", "lon", f"{b}e0", "2500e0") for n, b in (("n", 0), ("e", 90), ("s", 180), ("w", 270))}


@query("bounding_boxes", oracle(["requests"], f"""SELECT request_id, {_bx['w'][1]} AS min_lon, {_bx['s'][0]} AS min_lat, {_bx['e'][1]} AS max_lon,
    {_bx['n'][0]} AS max_lat, lat - 2.5e0 / 111 AS box_south, lon + 2.5e0 / (111 * cos(radians(lat))) AS box_east FROM requests""",
       "min_lon min_lat max_lon max_lat box_south box_east"))
def bounding_boxes(spark, sf):
    df = domain(spark, sf, "requests").select(
        "request_id", geo.bbox_exact("lat", "lon", 2500.0).alias("x"), geo.bbox_degrees("lat", "lon", 2.5).alias("d"))
    return df.select("request_id", "x.*", F.col("d.min_lat").alias("box_south"), F.col("d.max_lon").alias("box_east"))


@query("wrapped_longitudes", oracle(["requests"], """SELECT request_id, CASE WHEN w > 180 THEN w - 360 * ceil((w - 180) / 360)
    WHEN w < -180 THEN w + 360 * ceil((-180 - w) / 360) ELSE w END AS lon_wrapped FROM (SELECT request_id, lon * (request_id % 13 - 6) AS w FROM requests)""", "lon_wrapped"))
def wrapped_longitudes(spark, sf):
    return domain(spark, sf, "requests").select(
        "request_id", geo.normalize_lon(F.col("lon") * (F.col("request_id") % 13 - 6)).alias("lon_wrapped"))


def _leg(i: int, j: int) -> str:
    return q.hav(f"geom[{i}].lat", f"geom[{i}].lon", f"geom[{j}].lat", f"geom[{j}].lon")


@query("road_curvature", oracle(["roads"], f"""SELECT road_id, CASE WHEN s < 1 THEN 0e0 ELSE least(1e0, (p - s) / s / 0.5e0) END AS curvature_score
    FROM (SELECT road_id, {_leg(1, 3)} AS s, {_leg(1, 2)} + {_leg(2, 3)} AS p FROM roads)""", "curvature_score"))
def road_curvature(spark, sf):
    return domain(spark, sf, "roads").select("road_id", geo.path_curvature("geom").alias("curvature_score"))


_c7, _c8, _c5 = (q.axial("lat", "lon", r, "requests", "request_id, lat, lon") for r in (7, 8, 5))


@query("point_cells", oracle(["requests"], f"""SELECT a.request_id, {q.cell_text(7, 'a.cq', 'a.cr')} AS cell7, {q.cell_text(8, 'b.cq', 'b.cr')} AS cell8,
    {q.cell_text(5, 'c.cq', 'c.cr')} AS cell5 FROM ({_c7}) a JOIN ({_c8}) b USING (request_id) JOIN ({_c5}) c USING (request_id)"""))
def point_cells(spark, sf):
    return domain(spark, sf, "requests").select(
        "request_id", *[GRID.cell_of("lat", "lon", r).alias(f"cell{r}") for r in (7, 8, 5)])


@query("cell_centers", oracle(["tiles"], """SELECT cell, 1.5e0 * 0.0179e0 * r / sqrt(2e0) + 43 AS center_lat,
    0.0179e0 * sqrt(3e0) * (q + r / 2e0) - 80 AS center_lon FROM tiles""", "center_lat center_lon"))
def cell_centers(spark, sf):
    return domain(spark, sf, "tiles").select("cell", GRID.cell_center("cell").alias("c")).select(
        "cell", F.col("c.lat").alias("center_lat"), F.col("c.lon").alias("center_lon"))


@query("cell_ring_counts", oracle(["tiles"], """SELECT t.cell, count(*) AS disk, count(n.cell) AS present, min(n.tile_key) AS lowest_key
    FROM tiles t CROSS JOIN (SELECT dq, dr FROM range(-2, 3) a(dq), range(-2, 3) b(dr) WHERE abs(dq + dr) <= 2) d
    LEFT JOIN tiles n ON n.q = t.q + d.dq AND n.r = t.r + d.dr GROUP BY t.cell"""))
def cell_ring_counts(spark, sf):
    tiles = domain(spark, sf, "tiles").select("cell", "tile_key")
    ring = tiles.select(F.col("cell").alias("origin"), F.explode(cells.k_ring("cell", F.lit(2))).alias("cell"))
    return ring.join(tiles, "cell", "left").groupBy(F.col("origin").alias("cell")).agg(
        F.count("*").alias("disk"), F.count("tile_key").alias("present"), F.min("tile_key").alias("lowest_key"))


_pq, _pr = "((3e0 * q + r) / 7)", "((2e0 * r - q) / 7)"


@query("cell_hierarchy", oracle(["tiles"], f"""SELECT p.pq || ':' || p.pr || ':6' AS parent, count(*) AS children_present, min(tile_key) AS lowest_key,
      bool_and(abs(q - (2 * pq - pr)) <= 1 AND abs(r - (pq + 3 * pr)) <= 1 AND abs(q - (2 * pq - pr) + r - (pq + 3 * pr)) <= 1) AS inside_flower
    FROM (SELECT tile_key, q, r, CAST(CASE WHEN dq > dr AND dq > ds THEN -r0 - s0 ELSE q0 END AS BIGINT) AS pq,
        CAST(CASE WHEN NOT (dq > dr AND dq > ds) AND dr > ds THEN -q0 - s0 ELSE r0 END AS BIGINT) AS pr
      FROM (SELECT *, abs(q0 - fq) AS dq, abs(r0 - fr) AS dr, abs(s0 + fq + fr) AS ds
        FROM (SELECT *, floor(fq + 0.5) AS q0, floor(fr + 0.5) AS r0, floor(-fq - fr + 0.5) AS s0
          FROM (SELECT tile_key, q, r, {_pq} AS fq, {_pr} AS fr FROM tiles)))) p GROUP BY 1"""))
def cell_hierarchy(spark, sf):
    df = domain(spark, sf, "tiles").select("cell", "tile_key", cells.cell_parent("cell").alias("parent"))
    own = F.array_contains(cells.cell_children("parent"), F.col("cell"))
    return df.groupBy("parent").agg(F.count("*").alias("children_present"), F.min("tile_key").alias("lowest_key"),
                                    F.bool_and(own).alias("inside_flower"))


@query("cell_validity", oracle(["traffic_raw"], r"""SELECT event_id, regexp_matches(cell_text, '^-?[0-9]{1,9}:-?[0-9]{1,9}:([0-9]|1[0-5])$') AS valid,
    try_cast(split_part(cell_text, ':', 3) AS BIGINT) AS resolution FROM traffic_raw"""))
def cell_validity(spark, sf):
    valid = cells.cell_valid("cell_text")
    return domain(spark, sf, "traffic_raw").select(
        "event_id", valid.alias("valid"), F.when(valid, cells.cell_resolution("cell_text")).alias("resolution"))


@query("coordinate_keys", oracle(["route_points"], """SELECT route_id, seq, format('{:.3f},{:.3f}', round(round(lat * 1e6) / 1e3) / 1e3, round(round(lon * 1e6) / 1e3) / 1e3) AS key3,
    format('{:.5f},{:.5f}', round(round(lat * 1e6) / 1e1) / 1e5, round(round(lon * 1e6) / 1e1) / 1e5) AS key5 FROM route_points"""))
def coordinate_keys(spark, sf):
    return domain(spark, sf, "route_points").select(
        "route_id", "seq", geo.coord_key("lat", "lon", 3).alias("key3"), geo.coord_key("lat", "lon", 5).alias("key5"))


@query("region_grid_keys", oracle(["buildings"], """SELECT building_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN
    format('grid:{:.1f}:{:.1f}', floor(lat / 0.5e0) * 0.5e0, floor(lon / 0.5e0) * 0.5e0) END AS region_key FROM buildings"""))
def region_grid_keys(spark, sf):
    return domain(spark, sf, "buildings").select("building_id", text.region_grid("lat", "lon").alias("region_key"))


@query("time_buckets", oracle(["raw_events"], """SELECT event_id, CASE WHEN time_budget_minutes > 0 THEN least(360, greatest(15, ((time_budget_minutes + 7) // 15) * 15)) END AS bucket_capped,
    greatest(15, ((greatest(1, time_budget_minutes) + 7) // 15) * 15) AS bucket_open FROM raw_events"""))
def time_buckets(spark, sf):
    m = F.col("time_budget_minutes")
    return domain(spark, sf, "raw_events").select(
        "event_id", text.time_bucket_capped(m).alias("bucket_capped"), text.time_bucket(F.greatest(F.lit(1), m)).alias("bucket_open"))


@query("road_travel_seconds", oracle(["roads"], """SELECT road_id, greatest(1, CAST(round(length_m / (CASE WHEN speed_kmh > 0 THEN speed_kmh ELSE 50 END * 1000e0 / 3600)) AS BIGINT)) AS seconds FROM roads"""))
def road_travel_seconds(spark, sf):
    speed = F.when(F.col("speed_kmh") > 0, F.col("speed_kmh")).otherwise(50)
    seconds = F.greatest(F.lit(1).cast("bigint"), F.round(F.col("length_m") / (speed * 1000.0 / 3600.0)).cast("bigint"))
    return domain(spark, sf, "roads").select("road_id", seconds.alias("seconds"))


@query("score_colors", oracle(["tiles"], """SELECT cell, format('#{:02X}{:02X}4D', CASE WHEN s < 0.5 THEN 255 ELSE CAST(floor(255 - (s - 0.5e0) / 0.5e0 * 154 + 0.5e0) AS INT) END,
    CASE WHEN s < 0.5 THEN CAST(floor(96 + s / 0.5e0 * 128 + 0.5e0) AS INT) ELSE 224 END) AS color FROM (SELECT cell, scenic_score AS s FROM tiles)"""))
def score_colors(spark, sf):
    return domain(spark, sf, "tiles").select("cell", scoring.score_color("scenic_score").alias("color"))


def _snap(i: int) -> str:
    return f"concat(CAST(round(geom[{i}].lon * 1e7) AS BIGINT), ',', CAST(round(geom[{i}].lat * 1e7) AS BIGINT))"


@query("segment_identities", oracle(["roads"], f"""SELECT road_id, concat(way_id, ':', least(f, b)) AS identity_key, f <= b AS canonical_forward
    FROM (SELECT road_id, way_id, md5(concat_ws(';', {_snap(1)}, {_snap(2)}, {_snap(3)})) AS f, md5(concat_ws(';', {_snap(3)}, {_snap(2)}, {_snap(1)})) AS b FROM roads)"""))
def segment_identities(spark, sf):
    from vistagrid.operators.roads import segment_identity
    return segment_identity(domain(spark, sf, "roads")).select("road_id", "identity_key", "canonical_forward")


@query("rounding_and_clamps", oracle(["requests"], """SELECT request_id, floor(x * 100 + 0.5) / 100 AS half_up2, greatest(0e0, least(1e0, x)) AS clamped,
    CASE WHEN request_id % 7 = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, x)) END AS finite, greatest(0e0, least(1e0, (x - 0.4e0) / 0.32e0)) AS membership
    FROM (SELECT request_id, (request_id % 401 - 200) / 163e0 AS x FROM requests)""", "half_up2 clamped finite membership"))
def rounding_and_clamps(spark, sf):
    df = domain(spark, sf, "requests").select("request_id", ((F.col("request_id") % 401 - 200) / 163.0).alias("x"))
    odd = F.when(F.col("request_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("x"))
    return df.select("request_id", round_half_up("x", 2).alias("half_up2"), clamp01("x").alias("clamped"),
                     finite01(odd).alias("finite"), graded("x", 0.40, 0.72).alias("membership"))


@query("quality_tiers", oracle(["candidates"], """SELECT candidate_id, CASE WHEN n < 2 OR score < 0.45 THEN 'DEGRADED' WHEN score >= 0.78 AND n >= 3 THEN 'PREMIUM' ELSE 'STANDARD' END AS tier
    FROM (SELECT *, candidate_id % 6 AS n FROM candidates)"""))
def quality_tiers(spark, sf):
    return domain(spark, sf, "candidates").select("candidate_id", scoring.quality_tier("score", F.col("candidate_id") % 6).alias("tier"))


_alias_rows = q.values([(a, v) for v, names in catalog.VIBE_ALIASES.items() for a in names], "alias, canon")


def _norm(e: str) -> str:
    return f"trim(regexp_replace(replace(lower({e}), '&', ' and '), '[^a-z0-9]+', '_', 'g'), '_')"


@query("normalized_vibes", oracle(["requests"], f"""SELECT request_id, coalesce(a.canon, s) AS vibe_key, coalesce(a.canon, s) IN ({', '.join(repr(v) for v in catalog.VIBES)}) AS known
    FROM (SELECT request_id, {_norm('vibe')} AS s FROM requests) r LEFT JOIN {_alias_rows} a ON a.alias = r.s"""))
def normalized_vibes(spark, sf):
    v = text.normalize_vibe("vibe")
    return domain(spark, sf, "requests").select("request_id", v.alias("vibe_key"), text.supported(v).alias("known"))


VIBE_ITEMS = f"""vibe_items AS (SELECT request_id, min(pos) AS pos, vibe FROM (
      SELECT r.request_id, r.pos, coalesce(a.canon, r.s) AS vibe FROM (
        SELECT request_id, pos, {_norm('item')} AS s FROM (
          SELECT request_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
            SELECT request_id, CASE WHEN json_valid(vibes_json) THEN CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) END AS items FROM requests))
        WHERE item IS NOT NULL AND trim(item) <> '') r LEFT JOIN {_alias_rows} a ON a.alias = r.s)
    WHERE vibe IN ({', '.join(repr(v) for v in catalog.VIBES)}) GROUP BY request_id, vibe)"""
RESOLVED_VIBES = VIBE_ITEMS + f""", resolved_vibes AS (SELECT r.request_id, CASE WHEN p.vibes IS NOT NULL THEN p.vibes
      WHEN coalesce(a.canon, {_norm("coalesce(r.vibe, '')")}) = '' THEN ['countryside'] ELSE [coalesce(a.canon, {_norm('r.vibe')})] END AS vibes
    FROM requests r LEFT JOIN (SELECT request_id, list(vibe ORDER BY pos) AS vibes FROM vibe_items GROUP BY 1) p USING (request_id)
    LEFT JOIN {_alias_rows} a ON a.alias = {_norm("coalesce(r.vibe, '')")})"""


@query("parsed_vibes", oracle(["requests"], """SELECT r.request_id, coalesce(string_agg(v.vibe, '|' ORDER BY v.pos), '') AS vibes
    FROM requests r LEFT JOIN vibe_items v USING (request_id) GROUP BY 1""", extra=VIBE_ITEMS))
def parsed_vibes(spark, sf):
    return domain(spark, sf, "requests").select("request_id", F.array_join(text.parse_vibes("vibes_json"), "|").alias("vibes"))


_labels = q.values(list(catalog.VIBE_LABELS.items()), "vibe, label")


@query("resolved_vibe_labels", oracle(["requests"], f"""SELECT request_id, array_to_string(vibes, '|') AS vibes,
      (SELECT string_agg(coalesce(l.label, x.vibe), ' + ' ORDER BY x.pos) FROM (SELECT unnest(vibes) AS vibe, generate_subscripts(vibes, 1) AS pos) x
       LEFT JOIN {_labels} l ON l.vibe = x.vibe) AS label FROM resolved_vibes""", extra=RESOLVED_VIBES))
def resolved_vibe_labels(spark, sf):
    df = domain(spark, sf, "requests").select("request_id", text.resolve_vibes("vibes_json", "vibe").alias("v"))
    return df.select("request_id", F.array_join("v", "|").alias("vibes"), text.display_list("v").alias("label"))


@query("parsed_preferences", oracle(["requests"], f"""SELECT request_id,
      CASE WHEN j IS NOT NULL THEN greatest(0e0, least(1e0, try_cast(json_extract_string(j, '$.Water') AS DOUBLE))) END AS water,
      CASE WHEN j IS NOT NULL THEN greatest(0e0, least(1e0, try_cast(json_extract_string(j, '$.curve') AS DOUBLE))) END AS curves,
      CASE WHEN j IS NOT NULL THEN greatest(0e0, least(1e0, try_cast(json_extract_string(j, '$."solitude "') AS DOUBLE))) END AS solitude, CASE WHEN j IS NULL THEN 0 ELSE 3 END AS accepted
    FROM (SELECT request_id, CASE WHEN json_valid(preferences_json) THEN preferences_json END AS j FROM requests)""", "water curves solitude"))
def parsed_preferences(spark, sf):
    df = domain(spark, sf, "requests").select("request_id", text.parse_preferences("preferences_json").alias("p"))
    return df.select("request_id", *[F.col("p")[k].alias(k) for k in ("water", "curves", "solitude")],
                     F.coalesce(F.size(F.map_keys("p")), F.lit(0)).alias("accepted"))


@query("parsed_breakdowns", oracle(["routes"], """SELECT route_id, CASE WHEN json_valid(breakdown_json) THEN try_cast(json_extract_string(breakdown_json, '$.final_score') AS DOUBLE) END AS final_score,
    CASE WHEN json_valid(breakdown_json) THEN try_cast(json_extract_string(breakdown_json, '$.vibe_fit_score') AS DOUBLE) END AS vibe_fit_score,
    CASE WHEN json_valid(breakdown_json) THEN 2 ELSE 0 END AS entries FROM routes""", "final_score vibe_fit_score"))
def parsed_breakdowns(spark, sf):
    df = domain(spark, sf, "routes").select("route_id", text.parse_breakdown("breakdown_json").alias("b"))
    return df.select("route_id", F.col("b")["final_score"].alias("final_score"), F.col("b")["vibe_fit_score"].alias("vibe_fit_score"),
                     F.size("b").alias("entries"))


_key = SECRET.encode().ljust(64, b"\0")
_ipad, _opad = (bytes(b ^ x for b in _key).hex() for x in (0x36, 0x5C))
assert len(hashlib.sha256().hexdigest()) == 64


@query("hashed_clients", oracle(["raw_events"], f"""SELECT event_id, sha256(unhex('{_opad}') || unhex(sha256(unhex('{_ipad}') || encode(m)))) AS client_hash
    FROM (SELECT event_id, CASE WHEN trim(client_id) <> '' THEN trim(client_id) ELSE trim(session_id) END AS m FROM raw_events)"""))
def hashed_clients(spark, sf):
    return domain(spark, sf, "raw_events").select("event_id", text.hash_client("client_id", "session_id", SECRET).alias("client_hash"))


@query("metadata_checks")
def metadata_checks(spark, sf):
    """Depth, item count and sizes of event metadata; checked against a recursive walk in the tests."""
    return domain(spark, sf, "raw_events").select("event_id", text.metadata_check("metadata_json").alias("m")).select("event_id", "m.*")


@query("feedback_tags", oracle(["ratings"], f"""SELECT r.rating_id, coalesce((SELECT array_to_string(list(t ORDER BY p)[1:4], '|') FROM (
      SELECT t, min(p) AS p FROM (SELECT replace(replace(lower(trim(x)), '-', '_'), ' ', '_') AS t, p FROM (
        SELECT unnest(string_split(r.tags_text, '|')) AS x, generate_subscripts(string_split(r.tags_text, '|'), 1) AS p))
      WHERE t IN ({', '.join(repr(t) for t in catalog.FEEDBACK_TAGS)}) GROUP BY t)), '') AS tags FROM ratings r"""))
def feedback_tags(spark, sf):
    tags = text.normalize_feedback_tags(F.split("tags_text", r"\|"))
    return domain(spark, sf, "ratings").select("rating_id", F.array_join(tags, "|").alias("tags"))


@query("calibration_keys", oracle(["requests"], f"""SELECT request_id, concat_ws('|', CASE WHEN trim(coalesce(route_mode, '')) = '' THEN 'unknown' ELSE lower(trim(route_mode)) END,
    {q.cell_text(5)}, greatest(15, ((budget + 7) // 15) * 15), 'water_following') AS key FROM ({q.axial('lat', 'lon', 5, 'requests')})"""))
def calibration_keys(spark, sf):
    return domain(spark, sf, "requests").select("request_id", text.calibration_key(
        "route_mode", GRID.cell_of("lat", "lon", 5), "budget", F.lit("WATER_FOLLOWING")).alias("key"))


@query("normalized_profiles", oracle(["routes"], """SELECT route_id, CASE WHEN replace(replace(lower(trim(route_profile)), '-', '_'), ' ', '_') IN ('most_scenic', 'balanced', 'shorter')
    THEN replace(replace(lower(trim(route_profile)), '-', '_'), ' ', '_') END AS profile FROM routes"""))
def normalized_profiles(spark, sf):
    return domain(spark, sf, "routes").select("route_id", text.normalize_profile("route_profile").alias("profile"))


POI_RULES = [("tourism", None), ("leisure", None), ("natural", ["peak", "viewpoint", "spring"]), ("amenity", ["park", "camp_site"])]
WATER_RULES = [("natural", ["water", "bay", "wetland"]), ("water", None), ("waterway", None), ("landuse", ["reservoir", "basin"])]
SQL_POI = "(tags['tourism'] IS NOT NULL OR tags['leisure'] IS NOT NULL OR coalesce(tags['natural'] IN ('peak', 'viewpoint', 'spring'), false) OR coalesce(tags['amenity'] IN ('park', 'camp_site'), false))"
SQL_WATER = "(coalesce(tags['natural'] IN ('water', 'bay', 'wetland'), false) OR tags['water'] IS NOT NULL OR tags['waterway'] IS NOT NULL OR coalesce(tags['landuse'] IN ('reservoir', 'basin'), false))"


@query("tag_matches", oracle(["places"], f"""SELECT place_id, {SQL_POI} AS is_poi, tags['amenity'] IS NOT NULL AS has_amenity,
    coalesce(tags['natural'] NOT IN ('', 'no'), false) AS natural_set FROM places"""))
def tag_matches(spark, sf):
    return domain(spark, sf, "places").select(
        "place_id", text.any_tag("tags", POI_RULES).alias("is_poi"), text.tag_present("tags", "amenity").alias("has_amenity"),
        text.tag_set("tags", "natural").alias("natural_set"))
