"""Enrichment of the tile table from roads, water, rasters, places and buildings."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog
from vistagrid.operators import enrich as en
from vistagrid.operators import spatial as sp
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.scalar_plans import SQL_POI, SQL_WATER
from vistagrid.sources.fixtures import GRID, domain

V = catalog.VERSIONS
u, cl = q.u, q.cl
COS0 = "cos(radians(road_edges_lat)) * 111320e0"
ROAD_EDGES = q.path_edges("road_edges", "roads", "road_id, cell", "geom", 3, "j", "k")


def _get(spark, sf, *names):
    return [domain(spark, sf, n) for n in names]


WATER_NEAR = f"""{ROAD_EDGES}, {q.path_edges('water_edges', 'water', 'water_id, tags', 'ring', 5, 'm', 'n')},
  near_water AS ({q.path_rect_pairs('road_edges', 'water_edges', 'road_id', '0.07e0', COS0, '111320e0', 'road_id')})"""


@query("water_proximity", oracle(["roads", "water"], """SELECT cell, 1 - coalesce(min(CASE WHEN distance <= 5000 THEN distance END), 5000e0) / 5000 AS water_proximity
    FROM roads LEFT JOIN near_water USING (road_id) GROUP BY 1""", "water_proximity", WATER_NEAR.replace("water_id, tags,", "water_id,").replace("FROM water)", f"FROM (SELECT * FROM water WHERE {SQL_WATER}))")))
def water_proximity(spark, sf):
    roads, water = _get(spark, sf, "roads", "water")
    return en.water_proximity(roads, water.where(en.water_tags()), GRID)


@query("road_signals", oracle(["roads"], f"""SELECT cell, greatest(0e0, least(1e0, (max(elevation_change) - min(elevation_change)) / 2000)) AS elevation_variance,
    greatest(0e0, least(1e0, 0.5e0 + (count(*) FILTER (road_type IN ('residential', 'service', 'living_street')) - count(*) FILTER (road_type IN ('motorway', 'trunk', 'primary'))) / count(*) * 0.5e0)) AS natural_land_use,
    least(1e0, count(*) / 5.16e0 / 100) AS road_density, count(*) AS road_count FROM roads GROUP BY 1""", "elevation_variance natural_land_use road_density"))
def road_signals(spark, sf):
    return en.road_signals(domain(spark, sf, "roads"))


@query("traffic_blend", oracle(["roads", "traffic"], """SELECT r.cell, greatest(0e0, least(1e0, coalesce(t, 0.5e0))) AS traffic_signal_score,
    greatest(0e0, least(1e0, least(1e0, n / 5.16e0 / 100) * 0.75e0 + coalesce(t, 0.5e0) * 0.25e0)) AS road_density
    FROM (SELECT cell, count(*) AS n FROM roads GROUP BY 1) r LEFT JOIN (SELECT cell, avg(traffic_score) AS t FROM traffic GROUP BY 1) t USING (cell)""", "traffic_signal_score road_density"))
def traffic_blend(spark, sf):
    roads, traffic = _get(spark, sf, "roads", "traffic")
    base = en.road_signals(roads)
    out = base.join(en.traffic_avg(base, traffic), "cell")
    return out.select("cell", "traffic_signal_score", en.blend_road_traffic("road_density", "traffic_signal_score").alias("road_density"))


POI_SQL = f"""SELECT r.cell, least(1e0, coalesce(n, 0) / 5.16e0 / 10) AS poi_density FROM (SELECT DISTINCT cell FROM roads) r LEFT JOIN (
    SELECT cell, count(DISTINCT place_id) AS n FROM (SELECT cell, place_id, {q.pt_seg('px', 'py', 'jx', 'jy', 'kx', 'ky')} AS d FROM (
      SELECT e.cell, p.place_id, p.lon * s AS px, p.lat * 111320 AS py, jx * s AS jx, jy * 111320 AS jy, kx * s AS kx, ky * 111320 AS ky
      FROM road_edges e JOIN (SELECT *, cos(radians(lat)) * 111320 AS s FROM places WHERE {SQL_POI}) p
        ON p.lon BETWEEN road_edges_w - 0.004 AND road_edges_e + 0.004 AND p.lat BETWEEN road_edges_s - 0.003 AND road_edges_n + 0.003)) WHERE d <= 250 GROUP BY 1) n USING (cell)"""


@query("poi_density", oracle(["roads", "places"], POI_SQL, "poi_density", ROAD_EDGES))
def poi_density(spark, sf):
    places, roads = _get(spark, sf, "places", "roads")
    return en.poi_density(places, roads, GRID)


def _park(degrees: bool) -> tuple[str, str]:
    sx, sy = ("1e0", "1e0") if degrees else ("cos(radians(clat)) * 111320e0", "111320e0")
    near, far = ("0.02e0", "0.05e0") if degrees else ("2000", "5000")
    extra = f"""hexes AS ({q.hexagon()}), {q.path_edges('hex_edges', 'hexes', 'tile_key, cell, clat, hex', 'hex', 7, 'j', 'k')},
      {q.path_edges('area_edges', 'areas', 'area_id', 'ring', 5, 'm', 'n')},
      park_near AS ({q.path_rect_pairs('hex_edges', 'area_edges', 'cell', '0.08e0', sx, sy, 'cell')})"""
    body = f"""SELECT cell, CASE WHEN distance <= 0 THEN 1e0 WHEN distance <= {near} THEN 0.6e0 WHEN distance <= {far} THEN 0.3e0 ELSE 0e0 END AS park_score
      FROM tiles LEFT JOIN park_near USING (cell)"""
    return body, extra


# A rectangle inside a hexagon is caught by the distance of its edges only when they touch, so the check adds the containment rule.
_inside = f"""area_in_tile AS (SELECT DISTINCT concat(cq, ':', cr, ':7') AS cell FROM ({q.axial('ring[1].lat', 'ring[1].lon', 7, 'areas')}))"""


def _park_oracle(degrees: bool) -> str:
    body, extra = _park(degrees)
    body = body.replace("WHEN distance <= 0 THEN", "WHEN distance <= 0 OR cell IN (SELECT cell FROM area_in_tile) THEN")
    return oracle(["tiles", "areas"], body, "park_score", extra + ", " + _inside)


@query("park_scores", _park_oracle(False))
def park_scores(spark, sf):
    tiles, areas = _get(spark, sf, "tiles", "areas")
    return en.park_score(tiles, areas, GRID)


@query("park_scores_degrees", _park_oracle(True))
def park_scores_degrees(spark, sf):
    tiles, areas = _get(spark, sf, "tiles", "areas")
    return en.park_score(tiles, areas, GRID, degrees=True)


@query("park_multipliers", oracle(["tiles"], "SELECT cell, least(1e0, scenic_score * (1 + park_score * 0.3e0)) AS boosted, elevation_variance * 0.6e0 + natural_land_use * 0.4e0 AS visual FROM tiles", "boosted visual"))
def park_multipliers(spark, sf):
    return domain(spark, sf, "tiles").select("cell", en.park_multiplier().alias("boosted"), en.visual_complexity("elevation_variance", "natural_land_use").alias("visual"))


_rec_park_body, _rec_park_extra = _park(False)
_rec_extra = (WATER_NEAR.replace("water_id, tags,", "water_id,").replace("FROM water)", f"FROM (SELECT * FROM water WHERE {SQL_WATER}))") + ", " + _rec_park_extra + ", " + _inside + f""",
  parts AS (SELECT s.cell, s.elevation_variance AS ev, s.natural_land_use AS land, least(1e0, s.n / 5.16e0 / 100) * 0.75e0 + coalesce(t.t, 0.5e0) * 0.25e0 AS rd, coalesce(t.t, 0.5e0) AS tr,
      w.wp, p.poi_density AS poi, k.park_score AS park FROM (
        SELECT cell, greatest(0e0, least(1e0, (max(elevation_change) - min(elevation_change)) / 2000)) AS elevation_variance, count(*) AS n,
          greatest(0e0, least(1e0, 0.5e0 + (count(*) FILTER (road_type IN ('residential', 'service', 'living_street')) - count(*) FILTER (road_type IN ('motorway', 'trunk', 'primary'))) / count(*) * 0.5e0)) AS natural_land_use
        FROM roads GROUP BY 1) s
      LEFT JOIN (SELECT cell, avg(traffic_score) AS t FROM traffic GROUP BY 1) t USING (cell)
      JOIN (SELECT cell, 1 - coalesce(min(CASE WHEN distance <= 5000 THEN distance END), 5000e0) / 5000 AS wp FROM roads LEFT JOIN near_water USING (road_id) GROUP BY 1) w USING (cell)
      JOIN ({POI_SQL}) p USING (cell) JOIN ({_rec_park_body.replace("WHEN distance <= 0 THEN", "WHEN distance <= 0 OR cell IN (SELECT cell FROM area_in_tile) THEN")}) k USING (cell)
      WHERE s.cell IN (SELECT cell FROM traffic))""")


@query("recomputed_tiles", oracle(["roads", "water", "traffic", "places", "areas", "tiles"], f"""SELECT cell, wp AS water_score, ev AS elevation_score, land AS green_score, (1 - rd + tr) / 2 AS solitude_score,
    ev * 0.6e0 + land * 0.4e0 AS curve_score, poi AS poi_score, park AS park_score, rd AS road_density, '{V['2.1']}' AS scoring_version,
    least(1e0, (wp * 0.25e0 + land * 0.22e0 + ev * 0.15e0 + (1 - rd + tr) / 2 * 0.12e0 + (ev * 0.6e0 + land * 0.4e0) * 0.11e0 + poi * 0.15e0) * (1 + park * 0.3e0)) AS scenic_score FROM parts""",
    "water_score elevation_score green_score solitude_score curve_score poi_score park_score road_density scenic_score", _rec_extra))
def recomputed_tiles(spark, sf):
    """All cells named by the traffic table, recomputed from their sources."""
    roads, water, traffic, places, areas = _get(spark, sf, "roads", "water", "traffic", "places", "areas")
    out = en.recompute_tiles(traffic.select("cell"), roads, water.where(en.water_tags()), traffic, places, areas, GRID)
    return out.select("cell", "water_score", "elevation_score", "green_score", "solitude_score", "curve_score", "poi_score", "park_score", "road_density",
                      "scoring_version", "scenic_score")


HISTOGRAM = f"SELECT concat(cq, ':', cr, ':7') AS cell, CAST(v AS INT) AS class_id, count(*) AS pixels FROM ({q.pixels('landcover')}) GROUP BY ALL"


@query("zonal_histogram", oracle(["raster_tiles"], HISTOGRAM))
def zonal_histogram(spark, sf):
    return en.zonal_histogram(domain(spark, sf, "raster_tiles"), GRID)


_lc = q.values(catalog.LANDCOVER_WEIGHTS, "class_id, green_weight, is_urban")
LANDCOVER = f"""SELECT cell, sum(pixels * coalesce(green_weight, 0)) / sum(pixels) AS lc_green, sum(CASE WHEN is_urban THEN pixels ELSE 0 END) / sum(pixels) AS lc_urban
    FROM ({HISTOGRAM}) LEFT JOIN {_lc} USING (class_id) GROUP BY 1"""


def landcover(spark, sf):
    return en.landcover_green_urban(en.zonal_histogram(domain(spark, sf, "raster_tiles"), GRID), en.landcover_table(spark))


@query("landcover_green_urban", oracle(["raster_tiles"], LANDCOVER, "lc_green lc_urban"))
def landcover_green_urban(spark, sf):
    return landcover(spark, sf)


@query("green_solitude_base", oracle(["raster_tiles", "tiles"], f"""SELECT cell, {u('lc_green')} AS green_score, {cl(f"(1 - coalesce(lc_urban, 0)) * 0.6e0 + (1 - {u('road_density')}) * 0.4e0")} AS solitude_score
    FROM tiles LEFT JOIN ({LANDCOVER}) USING (cell)""", "green_score solitude_score"))
def green_solitude_base(spark, sf):
    cols = en.green_solitude_26()
    return domain(spark, sf, "tiles").join(landcover(spark, sf), "cell", "left").select("cell", *[cols[k].alias(k) for k in ("green_score", "solitude_score")])


@query("zonal_relief", oracle(["raster_tiles"], f"SELECT concat(cq, ':', cr, ':7') AS cell, least(1e0, stddev_pop(v) / 100) AS dem_relief FROM ({q.pixels('elevation')}) GROUP BY 1", "dem_relief"))
def zonal_relief(spark, sf):
    return en.zonal_stddev(domain(spark, sf, "raster_tiles"), GRID)


@query("composite_base", oracle(["tiles"], "SELECT cell, least(1e0, water_score * 0.25e0 + green_score * 0.2e0 + elevation_score * 0.2e0 + solitude_score * 0.1e0 + curve_score * 0.1e0 + poi_score * 0.15e0) AS composite FROM tiles", "composite"))
def composite_base(spark, sf):
    return domain(spark, sf, "tiles").select("cell", en.composite_26().alias("composite"))


_hexes = f"""hexes AS ({q.hexagon()}), {q.path_edges('hex_edges', 'hexes', 'tile_key, cell, hex', 'hex', 7, 'j', 'k')}, boxes AS (SELECT raster_id, [
    {{'lon': x0, 'lat': y0 - 16 * dy}}, {{'lon': x0 + 16 * dx, 'lat': y0 - 16 * dy}}, {{'lon': x0 + 16 * dx, 'lat': y0}}, {{'lon': x0, 'lat': y0}}, {{'lon': x0, 'lat': y0 - 16 * dy}}] AS ring FROM raster_tiles),
    {q.path_edges('box_edges', 'boxes', 'raster_id', 'ring', 5, 'm', 'n')}"""


@query("footprint_tiles", oracle(["tiles", "raster_tiles"], f"SELECT cell FROM ({q.path_rect_pairs('hex_edges', 'box_edges', 'cell', '0.001e0', '1e0', '1e0', 'cell')}) WHERE distance = 0", extra=_hexes))
def footprint_tiles(spark, sf):
    tiles, raster = _get(spark, sf, "tiles", "raster_tiles")
    return sp.scope_to_footprint(tiles, raster, GRID).select("cell")


def _released(tag: str, new: dict[str, str], src: str, inner: str) -> tuple[str, str]:
    """Check SQL of one release: new values where the version differs, else the old ones."""
    cols = ", ".join(f"CASE WHEN coalesce(scoring_version, '') <> '{V[tag]}' THEN {e} ELSE {k} END AS {k}" for k, e in new.items())
    version = f"CASE WHEN coalesce(scoring_version, '') <> '{V[tag]}' THEN '{V[tag]}' ELSE scoring_version END AS scoring_version"
    return f"SELECT cell, {cols}, {version} FROM (SELECT *, {inner} FROM {src})" if inner else f"SELECT cell, {cols}, {version} FROM {src}", " ".join(new)


def _show(df, names: str):
    return df.select("cell", *names.split(), "scoring_version")


R28 = _released("2.8", {"green_score": "g", "solitude_score": "s", "elevation_score": "e", "scenic_score": cl("water_score * 0.25e0 + g * 0.22e0 + e * 0.15e0 + s * 0.12e0 + curve_score * 0.11e0 + poi_score * 0.15e0")},
                f"(tiles LEFT JOIN ({LANDCOVER}) USING (cell))",
                f"coalesce(lc_green, green_score) AS g, {cl(f'(1 - coalesce(lc_urban, 0)) * 0.6e0 + (1 - road_density) * 0.4e0')} AS s, elevation_score * (1 - coalesce(lc_urban, 0) * 0.8e0) AS e")


@query("release_2_8", oracle(["tiles", "raster_tiles"], R28[0], R28[1]))
def release_2_8(spark, sf):
    return _show(en.calibrate_28(domain(spark, sf, "tiles").join(landcover(spark, sf), "cell", "left")), R28[1])


R29 = _released("2.9", {"park_score": "park_new", "scenic_score": "least(1e0, (water_score * 0.25e0 + green_score * 0.22e0 + elevation_score * 0.15e0 + solitude_score * 0.12e0 + curve_score * 0.11e0 + poi_score * 0.15e0) * (1 + park_new * 0.3e0))"},
                f"(tiles JOIN (SELECT cell, park_score AS park_new FROM ({_park(True)[0].replace('WHEN distance <= 0 THEN', 'WHEN distance <= 0 OR cell IN (SELECT cell FROM area_in_tile) THEN')})) USING (cell))", "")


@query("release_2_9", oracle(["tiles", "areas"], R29[0], R29[1], _park(True)[1] + ", " + _inside))
def release_2_9(spark, sf):
    tiles, areas = _get(spark, sf, "tiles", "areas")
    park = en.park_score(tiles, areas, GRID, degrees=True).withColumnRenamed("park_score", "park_new")
    return _show(en.enrich_29(tiles.join(park, "cell")), R29[1])


@query("polygon_cover", oracle(["tiles", "areas"], f"""SELECT area_id, count(*) AS touching_tiles FROM ({q.path_rect_pairs('hex_edges', 'area_edges', 'area_id, cell', '0.001e0', '1e0', '1e0', 'area_id, cell')}
      UNION SELECT area_id, cell, 0e0 FROM (SELECT area_id, concat(cq, ':', cr, ':7') AS cell FROM ({q.axial('ring[1].lat', 'ring[1].lon', 7, 'areas')})) JOIN tiles USING (cell)) WHERE distance = 0 GROUP BY 1""",
    extra=f"hexes AS ({q.hexagon()}), {q.path_edges('hex_edges', 'hexes', 'tile_key, cell, hex', 'hex', 7, 'j', 'k')}, {q.path_edges('area_edges', 'areas', 'area_id', 'ring', 5, 'm', 'n')}").replace("count(*) AS touching_tiles", "count(DISTINCT cell) AS touching_tiles"))
def polygon_cover(spark, sf):
    """Areas split over the lattice, kept where the hexagon of a tile really touches."""
    tiles, areas = _get(spark, sf, "tiles", "areas")
    return sp.touching_tiles(tiles, areas, GRID, "area_id").groupBy("area_id").agg(F.count("*").alias("touching_tiles"))


_pcell = f"SELECT *, concat(cq, ':', cr, ':7') AS cell FROM ({q.axial('lat', 'lon', 7, 'places')})"
PLACE_SCORE = f"""SELECT cell, least(1e0, ln(1 + coalesce(s, 0)) / ln(18)) AS place_score FROM tiles LEFT JOIN (
    SELECT cell, sum(CASE WHEN regexp_matches(lower(coalesce(category, '')), '{catalog.PLACE_PATTERN}') THEN 3e0 ELSE 1e0 END) AS s FROM ({_pcell}) GROUP BY 1) USING (cell)"""
BUILDINGS = f"""SELECT cell, least(1e0, ln(1 + coalesce(n, 0)) / ln(250)) AS building_score, coalesce(n, 0) AS building_count FROM tiles LEFT JOIN (
    SELECT concat(cq, ':', cr, ':7') AS cell, count(*) AS n FROM ({q.axial('lat', 'lon', 7, 'buildings')}) WHERE lon IS NOT NULL GROUP BY 1) USING (cell)"""


@query("place_tile_scores", oracle(["tiles", "places"], PLACE_SCORE, "place_score"))
def place_tile_scores(spark, sf):
    return en.place_tile_score(*_get(spark, sf, "tiles", "places"), GRID)


@query("building_density", oracle(["tiles", "buildings"], BUILDINGS, "building_score"))
def building_density(spark, sf):
    return en.building_density(*_get(spark, sf, "tiles", "buildings"), GRID)


def _sampled(band: str, src: str, key: str) -> str:
    """SELECT of key and the pixel under each point of src (lon, lat); lowest raster id wins."""
    return f"""SELECT {key}, arg_min(v, raster_id) AS v FROM (SELECT p.{key}, r.raster_id, r.nodata, r.{band}[CAST(floor((r.y0 - p.lat) / r.dy) * 16 + floor((p.lon - r.x0) / r.dx) AS BIGINT) + 1] AS v
      FROM {src} p JOIN raster_tiles r ON floor((p.lon - r.x0) / r.dx) BETWEEN 0 AND 15 AND floor((r.y0 - p.lat) / r.dy) BETWEEN 0 AND 15) WHERE v <> nodata GROUP BY 1"""


DARK = f"""SELECT cell, coalesce(s.d, CASE WHEN l.v IS NOT NULL THEN greatest(0e0, least(1e0, 1 - greatest(0e0, l.v) / 100)) END, 0.5e0) AS dark_score
    FROM tiles LEFT JOIN (SELECT cell, max(darkness_score) AS d FROM light_samples GROUP BY 1) s USING (cell) LEFT JOIN ({_sampled('light', 'tiles', 'cell')}) l USING (cell)"""


@query("darkness_scores", oracle(["tiles", "light_samples", "raster_tiles"], DARK, "dark_score"))
def darkness_scores(spark, sf):
    return en.darkness(*_get(spark, sf, "tiles", "light_samples", "raster_tiles"), GRID)


@query("raw_darkness", oracle(["light_samples"], "SELECT cell, CASE WHEN raw_value = 0 THEN 0.5e0 ELSE greatest(0e0, least(1e0, 1 - raw_value / 120)) END AS darkness FROM light_samples", "darkness"))
def raw_darkness(spark, sf):
    value = F.when(F.col("raw_value") == 0, F.lit(float("nan"))).otherwise(F.col("raw_value"))
    return domain(spark, sf, "light_samples").select("cell", en.to_darkness(value, 120.0).alias("darkness"))


_feature_join = f"(tiles JOIN ({PLACE_SCORE}) USING (cell) JOIN ({BUILDINGS}) USING (cell) JOIN ({DARK}) USING (cell))"
_feature_tables = ["tiles", "places", "buildings", "light_samples", "raster_tiles"]
R30 = _released("3.0", {"overture_poi_score": "place_score", "building_density_score": "building_score", "darkness_score": "dark_score", "urban_penalty_score": "building_score",
                        "poi_score": "p", "solitude_score": cl("s"),
                        "scenic_score": cl("water_score * 0.22e0 + green_score * 0.2e0 + elevation_score * 0.14e0 + s * 0.14e0 + curve_score * 0.1e0 + p * 0.12e0 + park_score * 0.08e0 - building_score * 0.1e0")},
                _feature_join, "greatest(poi_score, place_score) AS p, solitude_score * 0.6e0 + (1 - building_score) * 0.25e0 + dark_score * 0.15e0 AS s")


def featured(spark, sf):
    tiles, places, buildings, samples, raster = _get(spark, sf, *_feature_tables)
    return (tiles.join(en.place_tile_score(tiles, places, GRID), "cell").join(en.building_density(tiles, buildings, GRID), "cell")
            .join(en.darkness(tiles, samples, raster, GRID), "cell"))


@query("release_3_0", oracle(_feature_tables, R30[0], R30[1]))
def release_3_0(spark, sf):
    return _show(en.enrich_30(featured(spark, sf)), R30[1])


def _r31(src: str):
    return _released("3.1", {"overture_poi_score": "place_score", "building_density_score": "building_score", "darkness_score": "dark_score", "urban_penalty_score": "up",
                             "poi_score": "p", "solitude_score": "s",
                             "scenic_score": cl("water_score * 0.22e0 + green_score * 0.2e0 + elevation_score * 0.14e0 + s * 0.14e0 + curve_score * 0.1e0 + p * 0.12e0 + park_score * 0.08e0 - up * 0.1e0")},
                     src, f"""greatest(poi_score, place_score) AS p, {cl('building_score * 0.45e0 + road_density * 0.2e0 + (1 - dark_score) * 0.2e0 + (1 - green_score) * 0.15e0')} AS up,
                     {cl('solitude_score * 0.45e0 + (1 - building_score) * 0.2e0 + dark_score * 0.2e0 + (1 - road_density) * 0.15e0')} AS s""")


R31 = _r31(_feature_join)


@query("release_3_1", oracle(_feature_tables, R31[0], R31[1]))
def release_3_1(spark, sf):
    return _show(en.enrich_31(featured(spark, sf)), R31[1])


_type_case = "CASE lower(coalesce(road_type, 'unknown')) " + " ".join(f"WHEN '{t}' THEN {w}e0" for t, w in catalog.ROAD_TYPE_STRESS) + " ELSE 0.36e0 END"
_surface_case = "CASE lower(coalesce(surface, 'unknown')) " + " ".join(f"WHEN '{t}' THEN {w}e0" for t, w in catalog.SURFACE_STRESS) + " ELSE 0.08e0 END"
_speed_case = "CASE WHEN speed_kmh <= 0 THEN 0.32e0 " + " ".join(f"WHEN speed_kmh <= {a} THEN {b}e0" for a, b in catalog.SPEED_STRESS) + " ELSE 0.92e0 END"
STRESS = f"SELECT *, {_type_case} * 0.55e0 + {_speed_case} * 0.3e0 + {_surface_case} * 0.15e0 AS stress, greatest(length_m, 1) AS w FROM roads"


@query("segment_stress", oracle(["roads"], f"SELECT road_id, stress, coalesce(lower(road_type) IN ({', '.join(repr(m) for m in catalog.MAJOR_ROADS)}), false) AS major FROM ({STRESS})", "stress"))
def segment_stress(spark, sf):
    return en.segment_stress(domain(spark, sf, "roads")).select("road_id", "stress", "major")


ROAD_STRESS = f"""SELECT cell, sum(stress * w) / sum(w) AS stress_score, coalesce(sum(w) FILTER (road_type IN ({', '.join(repr(m) for m in catalog.MAJOR_ROADS)})), 0) / sum(w) AS major_share,
    count(*) AS segments, sum(w) AS total_length_m FROM ({STRESS}) GROUP BY 1"""


@query("road_stress_tiles", oracle(["roads"], ROAD_STRESS, "stress_score major_share total_length_m"))
def road_stress_tiles(spark, sf):
    return en.road_stress_tiles(domain(spark, sf, "roads"))


R32 = _released("3.2", {"road_stress_score": "t", "solitude_score": "s",
                        "scenic_score": cl("water_score * 0.22e0 + green_score * 0.2e0 + elevation_score * 0.14e0 + s * 0.14e0 + curve_score * 0.1e0 + greatest(poi_score, overture_poi_score) * 0.12e0 + park_score * 0.08e0 - urban_penalty_score * 0.08e0 - t * 0.06e0")},
                f"(SELECT *, coalesce(stress_score, least(0.35e0, road_density * 0.35e0)) AS t FROM (SELECT * FROM tiles LEFT JOIN (SELECT * FROM ({ROAD_STRESS}) WHERE segments % 3 <> 0) USING (cell)))",
                cl("solitude_score * 0.5e0 + (1 - building_density_score) * 0.18e0 + darkness_score * 0.17e0 + (1 - road_density) * 0.1e0 + (1 - t) * 0.05e0") + " AS s")


@query("release_3_2", oracle(["tiles", "roads"], R32[0], R32[1]))
def release_3_2(spark, sf):
    """Cells whose segment count is a multiple of three are left without a stress row, to use the fallback."""
    tiles, roads = _get(spark, sf, "tiles", "roads")
    stress = en.road_stress_tiles(roads).where("segments % 3 <> 0").select("cell", "stress_score")
    return _show(en.enrich_32(tiles.join(stress, "cell", "left")), R32[1])


_bridge = "coalesce(tags['bridge'] NOT IN ('', 'no'), false)"
HINTS = f"SELECT line_id, geom, {_bridge} AS bridge_hint, true AS coastal_hint FROM hint_lines WHERE {_bridge} OR tags['waterway'] IS NOT NULL OR tags['ford'] IS NOT NULL"


@query("water_hints", oracle(["hint_lines"], f"SELECT line_id, bridge_hint, coastal_hint FROM ({HINTS})"))
def water_hints(spark, sf):
    return en.water_hints(domain(spark, sf, "hint_lines")).select("line_id", "bridge_hint", "coastal_hint")


SEGMENT_EXTRA = f"""{ROAD_EDGES}, {q.path_edges('water_edges', 'water', 'water_id', 'ring', 5, 'm', 'n')}, hints AS ({HINTS}),
  near_deg AS ({q.path_rect_pairs('road_edges', 'water_edges', 'road_id', '0.0036e0', '1e0', '1e0', 'road_id')}),
  near_hint AS (SELECT road_id, bool_or(bridge_hint) AS bridge_hint, bool_or(coastal_hint) AS coastal_hint FROM (
    SELECT *, {q.seg_seg()} AS d FROM (SELECT e.*, geom[1].lon AS mx, geom[1].lat AS my, geom[2].lon AS nx, geom[2].lat AS ny, bridge_hint, coastal_hint FROM road_edges e JOIN hints h
      ON road_edges_w <= greatest(geom[1].lon, geom[2].lon) + 0.001 AND road_edges_e >= least(geom[1].lon, geom[2].lon) - 0.001
      AND road_edges_s <= greatest(geom[1].lat, geom[2].lat) + 0.001 AND road_edges_n >= least(geom[1].lat, geom[2].lat) - 0.001)) WHERE d <= 0.0004 GROUP BY 1),
  segment_water AS (SELECT road_id, cell, greatest(length_m, 1) AS length_weight, CASE WHEN distance <= 0.0035 THEN distance * 111320 END AS water_m, coalesce(distance = 0, false) AS crosses,
    coalesce(bridge_hint, false) AS bridge_hint, coalesce(coastal_hint, false) AS coastal_hint FROM roads LEFT JOIN near_deg USING (road_id) LEFT JOIN near_hint USING (road_id))"""


@query("segment_water", oracle(["roads", "water", "hint_lines"], "SELECT * FROM segment_water", "length_weight water_m", SEGMENT_EXTRA))
def segment_water(spark, sf):
    roads, water, lines = _get(spark, sf, "roads", "water", "hint_lines")
    return en.segment_water(roads, water, en.water_hints(lines), GRID)


VISIBILITY = """SELECT cell, sum(seen * length_weight) / sum(length_weight) AS visibility, max(crossing) AS crossing, sum(shore * length_weight) / sum(length_weight) AS coastal, count(*) AS segments FROM (
    SELECT *, CASE WHEN water_m <= 25 THEN 1e0 WHEN water_m <= 75 THEN 0.82e0 WHEN water_m <= 150 THEN 0.56e0 WHEN water_m <= 300 THEN 0.28e0 ELSE 0e0 END AS seen,
      CASE WHEN crosses OR bridge_hint THEN 1e0 WHEN coastal_hint THEN 0.45e0 ELSE 0e0 END AS crossing,
      CASE WHEN water_m IS NULL THEN 0e0 WHEN crosses OR bridge_hint THEN 0.35e0 WHEN water_m <= 50 THEN 1e0 WHEN water_m <= 125 THEN 0.7e0 WHEN water_m <= 250 THEN 0.35e0 ELSE 0e0 END AS shore
    FROM segment_water) GROUP BY 1"""


def visibility(spark, sf):
    roads, water, lines = _get(spark, sf, "roads", "water", "hint_lines")
    return en.water_visibility_tiles(en.segment_water(roads, water, en.water_hints(lines), GRID))


@query("water_visibility_tiles", oracle(["roads", "water", "hint_lines"], VISIBILITY, "visibility crossing coastal", SEGMENT_EXTRA))
def water_visibility_tiles(spark, sf):
    return visibility(spark, sf)


_c3 = "{w} * {ww}e0 + {g} * 0.2e0 + elevation_score * 0.14e0 + {s} * 0.14e0 + curve_score * 0.1e0 + {p} * {pw}e0 + park_score * 0.08e0 - urban_penalty_score * 0.08e0 - {t} * 0.06e0"


def _comp(w="water_score", g="green_score", s="solitude_score", p="greatest(poi_score, overture_poi_score)", t="road_stress_score", ww=0.22, pw=0.12):
    return cl(_c3.format(w=w, g=g, s=s, p=p, t=t, ww=ww, pw=pw))


R33 = _released("3.3", {"water_visibility_score": "coalesce(visibility, 0)", "water_crossing_score": "coalesce(crossing, 0)", "coastal_road_score": "coalesce(coastal, 0)", "water_score": "w", "scenic_score": _comp("w")},
                f"(tiles LEFT JOIN (SELECT cell, visibility, crossing, coastal FROM ({VISIBILITY})) USING (cell))",
                "greatest(water_score, coalesce(visibility, 0) * 0.62e0 + coalesce(coastal, 0) * 0.26e0 + coalesce(crossing, 0) * 0.12e0) AS w")


@query("release_3_3", oracle(["tiles", "roads", "water", "hint_lines"], R33[0], R33[1], SEGMENT_EXTRA))
def release_3_3(spark, sf):
    return _show(en.enrich_33(domain(spark, sf, "tiles").join(visibility(spark, sf).drop("segments"), "cell", "left")), R33[1])


_canopy_rows = q.values(catalog.CANOPY_WEIGHTS, "class_id, canopy_weight")
CANOPY = f"SELECT cell, coalesce(canopy_weight, 0) AS canopy FROM tiles LEFT JOIN ({_sampled('landcover', 'tiles', 'cell')}) s USING (cell) LEFT JOIN {_canopy_rows} c ON c.class_id = s.v"


@query("canopy_at_center", oracle(["tiles", "raster_tiles"], CANOPY, "canopy"))
def canopy_at_center(spark, sf):
    tiles, raster = _get(spark, sf, "tiles", "raster_tiles")
    return en.canopy_point(tiles, raster, en.canopy_table(spark), GRID)


@query("canopy_by_overlap")
def canopy_by_overlap(spark, sf):
    """Exact polygon clipping; compared with a brute-force clip in the tests."""
    tiles, areas = _get(spark, sf, "tiles", "areas")
    classed = areas.withColumn("class_id", F.element_at(F.array(*[F.lit(k) for k in (41, 52, 90, 24, 15)]), (F.col("area_id") % 5 + 1).cast("int")))
    return en.canopy_overlap(tiles, classed, en.canopy_table(spark), GRID)


R34 = _released("3.4", {"tree_canopy_score": "canopy", "green_score": "g", "natural_land_use": "greatest(natural_land_use, g)", "scenic_score": _comp(g="g")},
                f"(tiles JOIN ({CANOPY}) USING (cell))", "greatest(green_score, green_score * 0.65e0 + canopy * 0.35e0) AS g")


@query("release_3_4", oracle(["tiles", "raster_tiles"], R34[0], R34[1]))
def release_3_4(spark, sf):
    tiles, raster = _get(spark, sf, "tiles", "raster_tiles")
    return _show(en.enrich_34(tiles.join(en.canopy_point(tiles, raster, en.canopy_table(spark), GRID), "cell")), R34[1])


SIGNALS = {"scenic": (catalog.SCENIC_PLACE_WEIGHTS, catalog.PLACE_SIGNAL_SCENIC), "viewpoint": (catalog.VIEWPOINT_WEIGHTS, catalog.PLACE_SIGNAL_VIEWPOINT),
           "bridge": (catalog.BRIDGE_COASTAL_WEIGHTS, catalog.PLACE_SIGNAL_BRIDGE)}


def _weighted(kind: str) -> str:
    return f"""SELECT p.*, w.weight, w.category_group, least(1e0, coalesce(confidence, 0.75e0)) AS conf FROM ({_pcell}) p JOIN {q.values(SIGNALS[kind][0], 'category, weight, category_group')} w USING (category)
      WHERE coalesce(confidence, 0.75e0) >= 0.35"""


def _signal(kind: str) -> str:
    a, b, m, l1, l2 = SIGNALS[kind][1]
    return f"""SELECT cell, least(1e0, ln(1 + sum(weight * conf)) / ln({1 + l1}e0) * {a}e0 + ln(1 + count(DISTINCT category_group)) / ln({1 + l2}e0) * {b}e0 + max(weight * conf) * {m}e0) AS {kind}_place,
      count(*) AS places, count(DISTINCT category_group) AS groups FROM ({_weighted(kind)}) GROUP BY 1"""


def signal(spark, sf, kind):
    rows, shape = SIGNALS[kind]
    return en.place_signal_tiles(en.weighted_places(domain(spark, sf, "places"), en.place_weights(spark, rows)), shape, GRID, f"{kind}_place")


@query("weighted_places", oracle(["places"], " UNION ALL ".join(f"SELECT '{k}' AS kind, place_id, weight, conf AS confidence, category_group FROM ({_weighted(k)})" for k in SIGNALS), "weight confidence"))
def weighted_places(spark, sf):
    out = None
    for kind, (rows, _) in SIGNALS.items():
        part = en.weighted_places(domain(spark, sf, "places"), en.place_weights(spark, rows)).select(
            F.lit(kind).alias("kind"), "place_id", "weight", "confidence", "category_group")
        out = part if out is None else out.unionByName(part)
    return out


for _kind in SIGNALS:
    query(f"{_kind}_place_tiles", oracle(["places"], _signal(_kind), f"{_kind}_place"))(lambda spark, sf, kind=_kind: signal(spark, sf, kind))


def _side(kind: str) -> str:
    return f"(tiles LEFT JOIN (SELECT cell, {kind}_place FROM ({_signal(kind)})) USING (cell))"


R35 = _released("3.5", {"scenic_poi_score": "coalesce(scenic_place, 0)", "poi_score": "p", "poi_density": "greatest(poi_density, p)", "scenic_score": _comp(p="p", ww=0.21, pw=0.13)},
                _side("scenic"), "greatest(poi_score, overture_poi_score, coalesce(scenic_place, 0)) AS p")
R36 = _released("3.6", {"viewpoint_score": "v", "scenic_poi_score": "greatest(scenic_poi_score, v * 0.85e0)", "poi_score": "greatest(poi_score, scenic_poi_score, v * 0.85e0)",
                        "poi_density": "greatest(poi_density, poi_score, v * 0.85e0)", "scenic_score": cl("scenic_score + v * 0.035e0")}, _side("viewpoint"), "coalesce(viewpoint_place, 0) AS v")
R37 = _released("3.7", {"bridge_coastal_score": "b", "water_score": "greatest(water_score, b * 0.7e0)", "scenic_score": cl("scenic_score + b * 0.03e0")}, _side("bridge"),
                cl("water_visibility_score * 0.3e0 + coastal_road_score * 0.3e0 + water_crossing_score * 0.24e0 + coalesce(bridge_place, 0) * 0.16e0") + " AS b")


@query("release_3_5", oracle(["tiles", "places"], R35[0], R35[1]))
def release_3_5(spark, sf):
    return _show(en.enrich_35(domain(spark, sf, "tiles").join(signal(spark, sf, "scenic").select("cell", "scenic_place"), "cell", "left")), R35[1])


@query("release_3_6", oracle(["tiles", "places"], R36[0], R36[1]))
def release_3_6(spark, sf):
    return _show(en.enrich_36(domain(spark, sf, "tiles").join(signal(spark, sf, "viewpoint").select("cell", "viewpoint_place"), "cell", "left")), R36[1])


@query("release_3_7", oracle(["tiles", "places"], R37[0], R37[1]))
def release_3_7(spark, sf):
    return _show(en.enrich_37(domain(spark, sf, "tiles").join(signal(spark, sf, "bridge").select("cell", "bridge_place"), "cell", "left")), R37[1])


_report = ["bridge_coastal_score", "scenic_score"]


@query("release_report", oracle(["tiles"], "SELECT count(*) AS tiles, " + ", ".join(
    f"count(*) FILTER ({s} > 0) AS {s}_non_zero, min({s}) AS {s}_min, avg({s}) AS {s}_avg, max({s}) AS {s}_max, stddev_pop({s}) AS {s}_stddev" for s in _report)
    + f" FROM tiles WHERE scoring_version = '{V['3.7']}'", " ".join(f"{s}_{k}" for s in _report for k in ("min", "avg", "max", "stddev"))))
def release_report(spark, sf):
    return en.release_report(domain(spark, sf, "tiles"), V["3.7"], _report)


@query("version_counts", oracle(["tiles"], "SELECT scoring_version, count(*) AS n FROM tiles GROUP BY 1"))
def version_counts(spark, sf):
    return en.version_counts(domain(spark, sf, "tiles"))


@query("elevation_changes", oracle(["roads", "raster_tiles"], f"""SELECT a.road_id, abs(b.v - a.v) AS elevation_change FROM ({_sampled('elevation', '(SELECT road_id, geom[1].lon AS lon, geom[1].lat AS lat FROM roads WHERE elevation_change = 0)', 'road_id')}) a
    JOIN ({_sampled('elevation', '(SELECT road_id, geom[3].lon AS lon, geom[3].lat AS lat FROM roads WHERE elevation_change = 0)', 'road_id')}) b USING (road_id)""", "elevation_change"))
def elevation_changes(spark, sf):
    return en.elevation_change(*_get(spark, sf, "roads", "raster_tiles"), GRID)


def train_sources(spark, sf):
    names = ["places", "buildings", "light_samples", "roads", "water", "hint_lines"]
    out = dict(zip(names, _get(spark, sf, *names)))
    out["raster"] = domain(spark, sf, "raster_tiles")
    return out


def _train_sql() -> tuple[str, str]:
    """The seven releases as CTEs; every step keeps the whole row."""
    steps = {
        "3.1": _r31("x"), "3.2": None, "3.3": None, "3.4": None, "3.5": None, "3.6": None, "3.7": None}
    new = {
        "3.1": ({"overture_poi_score": "place_score", "building_density_score": "building_score", "darkness_score": "dark_score", "urban_penalty_score": "t2", "poi_score": "t1", "solitude_score": "t3",
                 "scenic_score": cl("water_score * 0.22e0 + green_score * 0.2e0 + elevation_score * 0.14e0 + t3 * 0.14e0 + curve_score * 0.1e0 + t1 * 0.12e0 + park_score * 0.08e0 - t2 * 0.1e0")},
                ["greatest(poi_score, place_score)", cl("building_score * 0.45e0 + road_density * 0.2e0 + (1 - dark_score) * 0.2e0 + (1 - green_score) * 0.15e0"),
                 cl("solitude_score * 0.45e0 + (1 - building_score) * 0.2e0 + dark_score * 0.2e0 + (1 - road_density) * 0.15e0")]),
        "3.2": ({"road_stress_score": "t1", "solitude_score": "t2", "scenic_score": _comp(s="t2", t="t1")},
                ["coalesce(stress_score, least(0.35e0, road_density * 0.35e0))",
                 cl("solitude_score * 0.5e0 + (1 - building_density_score) * 0.18e0 + darkness_score * 0.17e0 + (1 - road_density) * 0.1e0 + (1 - coalesce(stress_score, least(0.35e0, road_density * 0.35e0))) * 0.05e0")]),
        "3.3": ({"water_visibility_score": "coalesce(visibility, 0)", "water_crossing_score": "coalesce(crossing, 0)", "coastal_road_score": "coalesce(coastal, 0)", "water_score": "t1", "scenic_score": _comp("t1")},
                ["greatest(water_score, coalesce(visibility, 0) * 0.62e0 + coalesce(coastal, 0) * 0.26e0 + coalesce(crossing, 0) * 0.12e0)"]),
        "3.4": ({"tree_canopy_score": "canopy", "green_score": "t1", "natural_land_use": "greatest(natural_land_use, t1)", "scenic_score": _comp(g="t1")}, ["greatest(green_score, green_score * 0.65e0 + canopy * 0.35e0)"]),
        "3.5": ({"scenic_poi_score": "coalesce(scenic_place, 0)", "poi_score": "t1", "poi_density": "greatest(poi_density, t1)", "scenic_score": _comp(p="t1", ww=0.21, pw=0.13)},
                ["greatest(poi_score, overture_poi_score, coalesce(scenic_place, 0))"]),
        "3.6": ({"viewpoint_score": "t1", "scenic_poi_score": "greatest(scenic_poi_score, t1 * 0.85e0)", "poi_score": "greatest(poi_score, scenic_poi_score, t1 * 0.85e0)",
                 "poi_density": "greatest(poi_density, poi_score, t1 * 0.85e0)", "scenic_score": cl("scenic_score + t1 * 0.035e0")}, ["coalesce(viewpoint_place, 0)"]),
        "3.7": ({"bridge_coastal_score": "t1", "water_score": "greatest(water_score, t1 * 0.7e0)", "scenic_score": cl("scenic_score + t1 * 0.03e0")},
                [cl("water_visibility_score * 0.3e0 + coastal_road_score * 0.3e0 + water_crossing_score * 0.24e0 + coalesce(bridge_place, 0) * 0.16e0")]),
    }
    ctes = [SEGMENT_EXTRA, f"""v0 AS MATERIALIZED (SELECT * FROM tiles JOIN ({PLACE_SCORE}) USING (cell) JOIN (SELECT cell, building_score FROM ({BUILDINGS})) USING (cell) JOIN ({DARK}) USING (cell)
      LEFT JOIN (SELECT cell, stress_score FROM ({ROAD_STRESS})) USING (cell) LEFT JOIN (SELECT cell, visibility, crossing, coastal FROM ({VISIBILITY})) USING (cell) JOIN ({CANOPY}) USING (cell)
      LEFT JOIN (SELECT cell, scenic_place FROM ({_signal('scenic')})) USING (cell) LEFT JOIN (SELECT cell, viewpoint_place FROM ({_signal('viewpoint')})) USING (cell)
      LEFT JOIN (SELECT cell, bridge_place FROM ({_signal('bridge')})) USING (cell))"""]
    for i, tag in enumerate(steps):
        cols, temps = new[tag]
        hit = f"coalesce(try_cast(left(scoring_version, 3) AS DOUBLE), 0) < {tag}"
        sets = ", ".join(f"CASE WHEN {hit} THEN {e} ELSE {k} END AS {k}" for k, e in cols.items())
        t = ", ".join(f"{e} AS t{j + 1}" for j, e in enumerate(temps))
        ctes.append(f"v{i + 1} AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(f't{j + 1}' for j in range(len(temps)))}) REPLACE ({sets}, CASE WHEN {hit} THEN '{V[tag]}' ELSE scoring_version END AS scoring_version) FROM (SELECT *, {t} FROM v{i}))")
    return "SELECT cell, scenic_score, water_score, green_score, solitude_score, poi_score, viewpoint_score, bridge_coastal_score, scoring_version FROM v7", ",\n".join(ctes)


_train_cols = "scenic_score water_score green_score solitude_score poi_score viewpoint_score bridge_coastal_score"


@query("release_train", oracle(["tiles", "places", "buildings", "light_samples", "raster_tiles", "roads", "water", "hint_lines"], _train_sql()[0], _train_cols, _train_sql()[1]))
def release_train(spark, sf):
    tiles = domain(spark, sf, "tiles")
    out = en.release_train(tiles, en.tile_features(tiles, train_sources(spark, sf), GRID))
    return _show(out, _train_cols)
