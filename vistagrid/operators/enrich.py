"""Batch enrichment of the tile table, release 2.1 to 3.7, as joins on cell and one select per release."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistagrid.functions import catalog, geo, scoring, text
from vistagrid.functions.cells import HexGrid
from vistagrid.functions.scalars import c, clamp01, unit, weighted_sum
from vistagrid.operators import spatial as sp

V = catalog.VERSIONS
# Tile area in km2 and search radii in metres.
TILE_KM2 = 5.16
WATER_RADIUS_M = 5000.0
POI_RADIUS_M = 250.0
PARK_NEAR_M, PARK_FAR_M = 2000.0, 5000.0
PARK_NEAR_DEG, PARK_FAR_DEG = 0.02, 0.05
WATER_BAND_DEG, HINT_DEG = 0.0035, 0.0004


# --- signals computed from roads, water, places, parks ---------------------------------------------------------------

def water_tags() -> Column:
    return text.any_tag("tags", [("natural", ["water", "bay", "wetland"]), ("water", None), ("waterway", None), ("landuse", ["reservoir", "basin"])])


def poi_tags() -> Column:
    return text.any_tag("tags", [("tourism", None), ("leisure", None), ("natural", ["peak", "viewpoint", "spring"]), ("amenity", ["park", "camp_site"])])


def water_proximity(roads: DataFrame, water: DataFrame, grid: HexGrid, reaches: tuple[float, ...] = (600.0, WATER_RADIUS_M)) -> DataFrame:
    """cell, water_proximity: 1 at the shore falling to 0 at 5 km; cells without water in reach give 0.

    A tile that has water within a short reach is finished there, so the wide search only sees tiles far from water.
    """
    todo, found = roads.select("cell", F.col("cell").alias("tile"), "geom"), None
    for reach in reaches:
        near = sp.path_polygon_distance(todo.drop("cell"), water, grid, reach, "tile").where(F.col("distance") <= reach)
        best = near.select(F.col("tile").alias("cell"), F.col("distance").alias("d"))
        found = best if found is None else found.unionByName(best)
        if reach != reaches[-1]:
            todo = todo.join(best.select("cell"), "cell", "left_anti")
    out = roads.select("cell").distinct().join(found, "cell", "left")
    return out.select("cell", (1.0 - F.coalesce("d", F.lit(WATER_RADIUS_M)) / WATER_RADIUS_M).alias("water_proximity"))


def road_signals(roads: DataFrame) -> DataFrame:
    """Elevation range, land-use ratio and road density of each cell in one aggregate."""
    local, major = ["residential", "service", "living_street"], ["motorway", "trunk", "primary"]
    n = F.count("*")
    span = F.coalesce(F.max("elevation_change"), F.lit(0.0)) - F.coalesce(F.min("elevation_change"), F.lit(0.0))
    ratio = (F.count_if(F.col("road_type").isin(local)) - F.count_if(F.col("road_type").isin(major))) / n
    return roads.groupBy("cell").agg(clamp01(span / 2000.0).alias("elevation_variance"), clamp01(ratio * 0.5 + 0.5).alias("natural_land_use"),
                                     F.least(F.lit(1.0), n / TILE_KM2 / 100.0).alias("road_density"), n.alias("road_count"))


def traffic_avg(cells_df: DataFrame, traffic: DataFrame) -> DataFrame:
    """cell, traffic_signal_score: mean signal, 0.5 where nothing was measured."""
    mean = traffic.groupBy("cell").agg(F.avg("traffic_score").alias("t"))
    return cells_df.select("cell").distinct().join(mean, "cell", "left").select("cell", clamp01(F.coalesce("t", F.lit(0.5))).alias("traffic_signal_score"))


def blend_road_traffic(density, traffic) -> Column:
    return clamp01(c(density) * 0.75 + c(traffic) * 0.25)


def poi_density(points: DataFrame, roads: DataFrame, grid: HexGrid) -> DataFrame:
    """cell, poi_density: tagged points with a road of the cell within 250 m, each counted once, per km2, /10."""
    tagged = points.where(poi_tags())
    near = sp.points_near_roads(tagged, roads, POI_RADIUS_M, grid, "place_id")
    n = near.groupBy("cell").agg(F.count("*").alias("n"))
    return roads.select("cell").distinct().join(n, "cell", "left").select(
        "cell", F.least(F.lit(1.0), F.coalesce("n", F.lit(0)) / TILE_KM2 / 10.0).alias("poi_density"))


def park_score(tiles: DataFrame, areas: DataFrame, grid: HexGrid, degrees: bool = False) -> DataFrame:
    """cell, park_score: 1 inside, 0.6 near, 0.3 farther, 0 beyond; bands in metres or in degrees."""
    near, far = (PARK_NEAR_DEG, PARK_FAR_DEG) if degrees else (PARK_NEAR_M, PARK_FAR_M)
    reach = PARK_FAR_DEG * geo.METRES_PER_DEGREE if degrees else PARK_FAR_M
    d = sp.tile_polygon_distances(tiles, areas, grid, reach, degrees)
    band = F.when(F.col("distance") <= 0.0, 1.0).when(F.col("distance") <= near, 0.6).when(F.col("distance") <= far, 0.3).otherwise(0.0)
    return tiles.select("cell").join(d, "cell", "left").select("cell", F.coalesce(band, F.lit(0.0)).alias("park_score"))


def park_multiplier(score="scenic_score", park="park_score") -> Column:
    return clamp01(c(score) * (1.0 + c(park) * 0.3))


def visual_complexity(elevation, land) -> Column:
    return c(elevation) * 0.6 + c(land) * 0.4


def recompute_tiles(cells_df: DataFrame, roads: DataFrame, water: DataFrame, traffic: DataFrame, points: DataFrame, areas: DataFrame,
                    grid: HexGrid) -> DataFrame:
    """Full 2.1 recomputation of the named cells that have roads: all signals, components, composite, version."""
    wanted = cells_df.select(F.trim("cell").alias("cell")).where("cell <> ''").distinct()
    r = roads.join(wanted, "cell", "left_semi")
    out = road_signals(r)
    for part in (water_proximity(r, water, grid), traffic_avg(r, traffic), poi_density(points, r, grid), park_score(out.select("cell"), areas, grid)):
        out = out.join(part, "cell", "left")
    out = out.withColumns({"road_density": blend_road_traffic("road_density", "traffic_signal_score"),
                           "visual_complexity": visual_complexity("elevation_variance", "natural_land_use"),
                           "scoring_version": F.lit(V["2.1"])})
    out = scoring.sync_legacy(out)
    return out.withColumn("scenic_score", scoring.composite_score())


# --- rasters ---------------------------------------------------------------------------------------------------------

def zonal_histogram(raster: DataFrame, grid: HexGrid, band: str = "landcover") -> DataFrame:
    """Valid pixels per cell and class."""
    px = sp.raster_pixels(raster, band, grid)
    return px.groupBy("cell", F.col("value").cast("int").alias("class_id")).agg(F.count("*").alias("pixels"))


def landcover_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog.LANDCOVER_WEIGHTS, "class_id int, green_weight double, is_urban boolean")


def landcover_green_urban(histogram: DataFrame, weights: DataFrame) -> DataFrame:
    """cell, lc_green, lc_urban as pixel-weighted means; `weights` is the fixed class table."""
    h = histogram.join(F.broadcast(weights), "class_id", "left")
    px = F.col("pixels")
    return h.groupBy("cell").agg(
        (F.sum(px * F.coalesce("green_weight", F.lit(0.0))) / F.sum(px)).alias("lc_green"),
        (F.sum(px * F.when(F.coalesce("is_urban", F.lit(False)), 1.0).otherwise(0.0)) / F.sum(px)).alias("lc_urban"))


def zonal_stddev(raster: DataFrame, grid: HexGrid, band: str = "elevation") -> DataFrame:
    return sp.raster_pixels(raster, band, grid).groupBy("cell").agg(clamp01(F.stddev_pop("value") / 100.0).alias("dem_relief"))


def to_darkness(value, reference_max: float = 100.0) -> Column:
    """1 - max(0, v) / max, clamped; missing or non-finite values are neutral."""
    v = c(value)
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(odd, 0.5).otherwise(clamp01(1.0 - F.greatest(F.lit(0.0), v) / reference_max))


def darkness(tiles: DataFrame, samples: DataFrame | None, raster: DataFrame | None, grid: HexGrid, allow_neutral: bool = True,
             reference_max: float = 100.0) -> DataFrame:
    """cell, darkness_score: stored sample first, else raster, else neutral; without leave to be neutral a tile fails the job."""
    out = tiles.select("cell", "lon", "lat")
    if samples is not None:
        s = samples.groupBy("cell").agg(F.max("darkness_score").alias("sampled"))
        out = out.join(s, "cell", "left")
    else:
        out = out.withColumn("sampled", F.lit(None).cast("double"))
    if raster is not None:
        lit = sp.sample_raster(out.where("sampled IS NULL"), raster, "light", grid, "cell")
        out = out.join(lit.select("cell", to_darkness("value", reference_max).alias("lit")), "cell", "left")
        neutral = F.lit(0.5)
    else:
        out = out.withColumn("lit", F.lit(None).cast("double"))
        neutral = F.lit(0.5) if allow_neutral else F.raise_error(F.concat(F.lit("no darkness source for tile "), F.col("cell"))).cast("double")
    return out.select("cell", F.when(F.col("sampled").isNotNull(), clamp01("sampled")).when(F.col("lit").isNotNull(), F.col("lit")).otherwise(neutral).alias("dark_score"))


def canopy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(catalog.CANOPY_WEIGHTS, "class_id int, canopy_weight double")


def canopy_point(tiles: DataFrame, raster: DataFrame, weights: DataFrame, grid: HexGrid) -> DataFrame:
    """cell, canopy: weight of the land-cover class under the centre; 0 without a class."""
    at = sp.sample_raster(tiles.select("cell", "lon", "lat"), raster, "landcover", grid, "cell")
    hit = at.select("cell", F.col("value").cast("int").alias("class_id")).join(F.broadcast(weights), "class_id", "left")
    return tiles.select("cell").join(hit, "cell", "left").select("cell", unit("canopy_weight").alias("canopy"))


def canopy_overlap(tiles: DataFrame, polygons: DataFrame, weights: DataFrame, grid: HexGrid) -> DataFrame:
    """cell, canopy: overlap-area weighted mean over classified polygons; exact clipping against the hexagon."""
    pairs = sp.tile_rings(tiles.select("cell").join(sp.cover_polygons(polygons.select("class_id", "ring"), grid), "cell"), grid)
    box, hexbox = geo.envelope("ring"), geo.envelope("tile_ring")
    pairs = pairs.withColumns({"b": box, "h": hexbox}).where("b.min_lon < h.max_lon AND b.max_lon > h.min_lon AND b.min_lat < h.max_lat AND b.max_lat > h.min_lat")
    pairs = sp.with_overlap_area(pairs.select("cell", "class_id", "ring", "tile_ring")).where("area > 0").join(F.broadcast(weights), "class_id", "left")
    return pairs.groupBy("cell").agg(clamp01(F.sum(F.col("area") * F.coalesce("canopy_weight", F.lit(0.0))) / F.sum("area")).alias("canopy"))


def elevation_change(roads: DataFrame, raster: DataFrame, grid: HexGrid) -> DataFrame:
    """road_id, elevation_change from the two end points; roads with a missing end are left out."""
    ends = roads.where(F.coalesce("elevation_change", F.lit(0.0)) == 0.0).select("road_id", F.explode(F.array(
        F.struct(F.lit("a").alias("end"), F.element_at("geom", 1).alias("p")), F.struct(F.lit("b").alias("end"), F.element_at("geom", -1).alias("p")))).alias("e"))
    points = ends.select(F.concat_ws(":", F.col("road_id").cast("string"), "e.end").alias("key"), F.col("e.p.lon").alias("lon"), F.col("e.p.lat").alias("lat"))
    z = sp.sample_raster(points, raster, "elevation", grid, "key")
    return z.groupBy(F.split_part("key", F.lit(":"), F.lit(1)).cast("bigint").alias("road_id")).agg(
        F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("elevation_change")).where("n = 2").drop("n")


# --- places and buildings --------------------------------------------------------------------------------------------

def place_tile_score(tiles: DataFrame, places: DataFrame, grid: HexGrid) -> DataFrame:
    """cell, place_score: log scale of places per tile, scenic categories counting three times.

    Places are summed per cell before the join, so a crowded cell reaches the tile table as one row.
    """
    worth = F.when(F.lower(F.coalesce("category", F.lit(""))).rlike(catalog.PLACE_PATTERN), 3.0).otherwise(1.0)
    s = places.groupBy(grid.cell_of("lat", "lon").alias("cell")).agg(F.sum(worth).alias("s"))
    return tiles.select("cell").join(s, "cell", "left").select("cell", F.least(F.lit(1.0), F.log(1.0 + F.coalesce("s", F.lit(0.0))) / math.log(18.0)).alias("place_score"))


def building_density(tiles: DataFrame, buildings: DataFrame, grid: HexGrid) -> DataFrame:
    n = buildings.where("lon IS NOT NULL AND lat IS NOT NULL").groupBy(grid.cell_of("lat", "lon").alias("cell")).agg(F.count("*").alias("n"))
    return tiles.select("cell").join(n, "cell", "left").select(
        "cell", F.least(F.lit(1.0), F.log(1.0 + F.coalesce("n", F.lit(0))) / math.log(250.0)).alias("building_score"), F.coalesce("n", F.lit(0)).alias("building_count"))


def place_weights(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(rows, "category string, weight double, category_group string")


def weighted_places(places: DataFrame, weights: DataFrame) -> DataFrame:
    """Places of a weighted category with confidence (0.75 when unknown) of at least 0.35; `weights` is a fixed table."""
    conf = F.coalesce("confidence", F.lit(0.75))
    return places.where(conf >= 0.35).withColumn("confidence", clamp01(conf)).join(F.broadcast(weights), "category")


def place_signal_tiles(weighted: DataFrame, shape: tuple[float, float, float, float, float], grid: HexGrid, name: str) -> DataFrame:
    """cell, <name>: blend of summed signal, number of category groups and best place."""
    a, b, best, l1, l2 = shape
    signal = F.col("weight") * F.col("confidence")
    raw = weighted.groupBy(grid.cell_of("lat", "lon").alias("cell")).agg(
        F.sum(signal).alias("s"), F.count("*").alias("places"), F.size(F.collect_set("category_group")).alias("groups"), F.max(signal).alias("m"))
    score = F.log(1.0 + F.col("s")) / math.log(1.0 + l1) * a + F.log(1.0 + F.col("groups")) / math.log(1.0 + l2) * b + F.col("m") * best
    return raw.select("cell", clamp01(score).alias(name), "places", "groups")


# --- roads: stress and water visibility ------------------------------------------------------------------------------

def segment_stress(roads: DataFrame) -> DataFrame:
    """Adds stress (0..1) and major (flag) of each segment; lookups stay literal maps, so nothing is joined."""
    types, surfaces = text.literal_map(catalog.ROAD_TYPE_STRESS), text.literal_map(catalog.SURFACE_STRESS)
    kind = F.lower(F.coalesce("road_type", F.lit("unknown")))
    by_type = F.coalesce(types[kind], F.lit(catalog.ROAD_TYPE_STRESS_OTHER))
    by_surface = F.coalesce(surfaces[F.lower(F.coalesce("surface", F.lit("unknown")))], F.lit(catalog.SURFACE_STRESS_OTHER))
    speed = F.coalesce("speed_kmh", F.lit(0))
    by_speed = F.when(speed <= 0, catalog.SPEED_STRESS_UNKNOWN)
    for limit, value in catalog.SPEED_STRESS:
        by_speed = by_speed.when(speed <= limit, value)
    by_speed = by_speed.otherwise(catalog.SPEED_STRESS_FAST)
    return roads.withColumns({"stress": clamp01(weighted_sum([(by_type, 0.55), (by_speed, 0.30), (by_surface, 0.15)])),
                              "major": kind.isin(catalog.MAJOR_ROADS), "length_weight": F.greatest(F.coalesce("length_m", F.lit(0.0)), F.lit(1.0))})


def road_stress_tiles(roads: DataFrame) -> DataFrame:
    s = segment_stress(roads.where(F.coalesce("cell", F.lit("")) != ""))
    w = F.col("length_weight")
    return s.groupBy("cell").agg(clamp01(F.sum(F.col("stress") * w) / F.sum(w)).alias("stress_score"),
                                 (F.sum(F.when(F.col("major"), w).otherwise(0.0)) / F.sum(w)).alias("major_share"),
                                 F.count("*").alias("segments"), F.sum(w).alias("total_length_m"))


def water_hints(lines: DataFrame) -> DataFrame:
    """Lines that hint at water: bridge flag, and coastal flag (bridge, waterway or ford)."""
    bridge = text.tag_set("tags", "bridge")
    coastal = bridge | text.tag_present("tags", "waterway") | text.tag_present("tags", "ford")
    return lines.where(coastal & (F.size("geom") > 0)).withColumns({"bridge_hint": bridge, "coastal_hint": coastal})


def segment_water(roads: DataFrame, water: DataFrame, hints: DataFrame, grid: HexGrid) -> DataFrame:
    """Per road: distance to water in metres (within 0.0035 degrees), crossing, bridge and coastal hints."""
    r = roads.where(F.coalesce("cell", F.lit("")) != "")
    near = sp.path_polygon_distance(r, water, grid, WATER_BAND_DEG * geo.METRES_PER_DEGREE, "road_id", degrees=True).where(F.col("distance") <= WATER_BAND_DEG)
    hint = sp.line_hints(r, hints, grid, HINT_DEG, ["bridge_hint", "coastal_hint"])
    out = r.select("road_id", "cell", "length_m").join(near, "road_id", "left").join(hint, "road_id", "left")
    return out.select("road_id", "cell", F.greatest(F.coalesce("length_m", F.lit(0.0)), F.lit(1.0)).alias("length_weight"),
                      (F.col("distance") * geo.METRES_PER_DEGREE).alias("water_m"), F.coalesce(F.col("distance") <= 0.0, F.lit(False)).alias("crosses"),
                      F.coalesce("bridge_hint", F.lit(False)).alias("bridge_hint"), F.coalesce("coastal_hint", F.lit(False)).alias("coastal_hint"))


def water_visibility_tiles(segments: DataFrame) -> DataFrame:
    m, w = F.col("water_m"), F.col("length_weight")
    over = F.col("crosses") | F.col("bridge_hint")
    seen = F.when(m.isNull(), 0.0).when(m <= 25, 1.0).when(m <= 75, 0.82).when(m <= 150, 0.56).when(m <= 300, 0.28).otherwise(0.0)
    crossing = F.when(over, 1.0).when(F.col("coastal_hint"), 0.45).otherwise(0.0)
    coastal = F.when(m.isNull(), 0.0).when(over, 0.35).when(m <= 50, 1.0).when(m <= 125, 0.70).when(m <= 250, 0.35).otherwise(0.0)
    return segments.groupBy("cell").agg(clamp01(F.sum(seen * w) / F.sum(w)).alias("visibility"), clamp01(F.max(crossing)).alias("crossing"),
                                        clamp01(F.sum(coastal * w) / F.sum(w)).alias("coastal"), F.count("*").alias("segments"))


# --- releases --------------------------------------------------------------------------------------------------------

def version_rank() -> Column:
    """Number of the row's release, such as 3.4, from its version name; other names rank 0."""
    number = F.regexp_extract(F.coalesce("scoring_version", F.lit("")), r"^([0-9]+[.][0-9]+)", 1)
    return F.when(number == "", 0.0).otherwise(number.cast("double"))


def release(tiles: DataFrame, tag: str, columns: dict[str, Column], temp: dict[str, Column] | None = None, source: str = "", scored_us: int = 0,
            ahead: bool = False) -> DataFrame:
    """One release step: all new values are computed from the old row, rows out of scope stay as they are.

    In scope: version differs from the target and, when given, equals `source`; with `ahead`, version is older.
    """
    current = F.coalesce("scoring_version", F.lit(""))
    hit = version_rank() < float(tag) if ahead else current != V[tag]
    if source:
        hit = hit & (current == source)
    df = tiles.withColumn("__hit", hit)
    if temp:
        df = df.withColumns(temp)
    new = {k: F.when(F.col("__hit"), v).otherwise(F.col(k)) for k, v in columns.items()}
    new["scoring_version"] = F.when(F.col("__hit"), V[tag]).otherwise(F.col("scoring_version"))
    new["last_scored_us"] = F.when(F.col("__hit"), F.lit(scored_us)).otherwise(F.col("last_scored_us"))
    return df.withColumns(new).drop("__hit", *(temp or {}))


def z(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def green_solitude_26() -> dict[str, Column]:
    green = unit("lc_green")
    quiet = clamp01((1.0 - z("lc_urban")) * 0.6 + (1.0 - unit("road_density")) * 0.4)
    return {"green_score": green, "natural_land_use": green, "solitude_score": quiet}


def composite_26() -> Column:
    return clamp01(weighted_sum([(z("water_score"), 0.25), (z("green_score"), 0.20), (z("elevation_score"), 0.20), (z("solitude_score"), 0.10),
                                 (z("curve_score"), 0.10), (z("poi_score"), 0.15)]))


def calibrate_28(tiles: DataFrame, **kw) -> DataFrame:
    """Needs lc_green and lc_urban (null where the tile has no pixels)."""
    temp = {"__g": clamp01(F.coalesce("lc_green", "green_score", F.lit(0.0))),
            "__s": clamp01((1.0 - z("lc_urban")) * 0.6 + (1.0 - unit("road_density")) * 0.4),
            "__e": clamp01(z("elevation_score") * (1.0 - z("lc_urban") * 0.80))}
    total = weighted_sum([(z("water_score"), 0.25), ("__g", 0.22), ("__e", 0.15), ("__s", 0.12), (z("curve_score"), 0.11), (z("poi_score"), 0.15)])
    return release(tiles, "2.8", {"green_score": F.col("__g"), "natural_land_use": F.col("__g"), "solitude_score": F.col("__s"),
                                  "elevation_score": F.col("__e"), "elevation_variance": F.col("__e"), "scenic_score": clamp01(total)}, temp, **kw)


def enrich_29(tiles: DataFrame, **kw) -> DataFrame:
    """Needs park_new."""
    base = weighted_sum([(z("water_score"), 0.25), (z("green_score"), 0.22), (z("elevation_score"), 0.15), (z("solitude_score"), 0.12),
                         (z("curve_score"), 0.11), (z("poi_score"), 0.15)])
    return release(tiles, "2.9", {"park_score": F.col("park_new"), "scenic_score": clamp01(base * (1.0 + F.col("park_new") * 0.30))}, **kw)


def enrich_30(tiles: DataFrame, **kw) -> DataFrame:
    """Needs place_score, building_score, dark_score."""
    temp = {"__b": z("building_score"), "__d": F.coalesce("dark_score", F.lit(0.5)), "__p": F.greatest(z("poi_score"), z("place_score"))}
    temp["__s"] = z("solitude_score") * 0.60 + (1.0 - z("building_score")) * 0.25 + F.coalesce("dark_score", F.lit(0.5)) * 0.15
    total = weighted_sum([(z("water_score"), 0.22), (z("green_score"), 0.20), (z("elevation_score"), 0.14), ("__s", 0.14), (z("curve_score"), 0.10),
                          ("__p", 0.12), (z("park_score"), 0.08), (F.least(F.lit(1.0), "__b"), -0.10)])
    return release(tiles, "3.0", {"overture_poi_score": z("place_score"), "building_density_score": F.col("__b"), "darkness_score": F.col("__d"),
                                  "urban_penalty_score": F.least(F.lit(1.0), "__b"), "poi_score": F.col("__p"), "solitude_score": clamp01("__s"),
                                  "scenic_score": clamp01(total)}, temp, **kw)


def enrich_31(tiles: DataFrame, **kw) -> DataFrame:
    """Needs place_score, building_score, dark_score."""
    dark = F.coalesce("dark_score", F.lit(0.5))
    temp = {"__p": F.greatest(z("poi_score"), z("place_score")),
            "__u": clamp01(weighted_sum([(z("building_score"), 0.45), (unit("road_density"), 0.20), (1.0 - dark, 0.20), (1.0 - unit("green_score"), 0.15)])),
            "__s": clamp01(weighted_sum([(unit("solitude_score"), 0.45), (1.0 - z("building_score"), 0.20), (dark, 0.20), (1.0 - unit("road_density"), 0.15)]))}
    total = weighted_sum([(z("water_score"), 0.22), (z("green_score"), 0.20), (z("elevation_score"), 0.14), ("__s", 0.14), (z("curve_score"), 0.10),
                          ("__p", 0.12), (z("park_score"), 0.08), ("__u", -0.10)])
    return release(tiles, "3.1", {"overture_poi_score": z("place_score"), "building_density_score": unit("building_score"), "darkness_score": clamp01(dark),
                                  "urban_penalty_score": F.col("__u"), "poi_score": F.col("__p"), "solitude_score": F.col("__s"),
                                  "scenic_score": clamp01(total)}, temp, **kw)


def _composite_3x(water, green, solitude, poi, water_weight=0.22, poi_weight=0.12, stress=None) -> Column:
    return clamp01(weighted_sum([(water, water_weight), (green, 0.20), (unit("elevation_score"), 0.14), (solitude, 0.14), (unit("curve_score"), 0.10),
                                 (poi, poi_weight), (unit("park_score"), 0.08), (unit("urban_penalty_score"), -0.08),
                                 (unit("road_stress_score") if stress is None else stress, -0.06)]))


def _poi_best() -> Column:
    return clamp01(F.greatest(z("poi_score"), z("overture_poi_score")))


def enrich_32(tiles: DataFrame, **kw) -> DataFrame:
    """Needs stress_score (null where the tile has no road)."""
    temp = {"__t": clamp01(F.coalesce("stress_score", F.least(F.lit(0.35), unit("road_density") * 0.35)))}
    quiet = clamp01(weighted_sum([(unit("solitude_score"), 0.50), (1.0 - unit("building_density_score"), 0.18), (unit("darkness_score", 0.5), 0.17),
                                  (1.0 - unit("road_density"), 0.10), (1.0 - clamp01(F.coalesce("stress_score", F.least(F.lit(0.35), unit("road_density") * 0.35))), 0.05)]))
    temp["__s"] = quiet
    return release(tiles, "3.2", {"road_stress_score": F.col("__t"), "solitude_score": F.col("__s"),
                                  "scenic_score": _composite_3x(unit("water_score"), unit("green_score"), F.col("__s"), _poi_best(), stress=F.col("__t"))}, temp, **kw)


def enrich_33(tiles: DataFrame, **kw) -> DataFrame:
    """Needs visibility, crossing, coastal."""
    v, x, k = unit("visibility"), unit("crossing"), unit("coastal")
    temp = {"__w": F.greatest(unit("water_score"), clamp01(weighted_sum([(v, 0.62), (k, 0.26), (x, 0.12)])))}
    return release(tiles, "3.3", {"water_visibility_score": v, "water_crossing_score": x, "coastal_road_score": k, "water_score": F.col("__w"),
                                  "scenic_score": _composite_3x(F.col("__w"), unit("green_score"), unit("solitude_score"), _poi_best())}, temp, **kw)


def enrich_34(tiles: DataFrame, **kw) -> DataFrame:
    """Needs canopy."""
    tree = clamp01(F.coalesce("canopy", "tree_canopy_score", F.lit(0.0)))
    temp = {"__g": F.greatest(unit("green_score"), clamp01(unit("green_score") * 0.65 + tree * 0.35)), "__t": tree}
    return release(tiles, "3.4", {"tree_canopy_score": F.col("__t"), "green_score": F.col("__g"), "natural_land_use": F.greatest(z("natural_land_use"), "__g"),
                                  "scenic_score": _composite_3x(unit("water_score"), F.col("__g"), unit("solitude_score"), _poi_best())}, temp, **kw)


def enrich_35(tiles: DataFrame, **kw) -> DataFrame:
    """Needs scenic_place."""
    temp = {"__p": F.greatest(unit("poi_score"), unit("overture_poi_score"), unit("scenic_place"))}
    return release(tiles, "3.5", {"scenic_poi_score": unit("scenic_place"), "poi_score": F.col("__p"), "poi_density": F.greatest(z("poi_density"), "__p"),
                                  "scenic_score": _composite_3x(unit("water_score"), unit("green_score"), unit("solitude_score"), F.col("__p"), 0.21, 0.13)}, temp, **kw)


def enrich_36(tiles: DataFrame, **kw) -> DataFrame:
    """Needs viewpoint_place. poi_score and poi_density read the values from before this release."""
    vp = unit("viewpoint_place")
    return release(tiles, "3.6", {"viewpoint_score": vp, "scenic_poi_score": F.greatest(z("scenic_poi_score"), vp * 0.85),
                                  "poi_score": F.greatest(z("poi_score"), z("scenic_poi_score"), vp * 0.85),
                                  "poi_density": F.greatest(z("poi_density"), z("poi_score"), vp * 0.85),
                                  "scenic_score": clamp01(z("scenic_score") + vp * 0.035)}, **kw)


def enrich_37(tiles: DataFrame, **kw) -> DataFrame:
    """Needs bridge_place."""
    temp = {"__b": clamp01(weighted_sum([(unit("water_visibility_score"), 0.30), (unit("coastal_road_score"), 0.30), (unit("water_crossing_score"), 0.24),
                                         (unit("bridge_place"), 0.16)]))}
    return release(tiles, "3.7", {"bridge_coastal_score": F.col("__b"), "water_score": F.greatest(z("water_score"), F.col("__b") * 0.70),
                                  "scenic_score": clamp01(z("scenic_score") + F.col("__b") * 0.030)}, temp, **kw)


TRAIN = [("3.1", enrich_31), ("3.2", enrich_32), ("3.3", enrich_33), ("3.4", enrich_34), ("3.5", enrich_35), ("3.6", enrich_36), ("3.7", enrich_37)]
FEATURES = ["place_score", "building_score", "dark_score", "stress_score", "visibility", "crossing", "coastal", "canopy", "scenic_place", "viewpoint_place", "bridge_place"]


def tile_features(tiles: DataFrame, src: dict[str, DataFrame], grid: HexGrid) -> DataFrame:
    """All per-cell inputs of the 3.x releases. Every part is already grouped by cell, so the joins need no further shuffle."""
    spark = tiles.sparkSession
    base = tiles.select("cell", "lon", "lat")
    parts = [
        place_tile_score(base, src["places"], grid), building_density(base, src["buildings"], grid).select("cell", "building_score"),
        darkness(base, src.get("light_samples"), src.get("raster"), grid), road_stress_tiles(src["roads"]).select("cell", "stress_score"),
        water_visibility_tiles(segment_water(src["roads"], src["water"], water_hints(src["hint_lines"]), grid)).drop("segments"),
        canopy_point(base, src["raster"], canopy_table(spark), grid)]
    for name, rows, shape in (("scenic_place", catalog.SCENIC_PLACE_WEIGHTS, catalog.PLACE_SIGNAL_SCENIC),
                              ("viewpoint_place", catalog.VIEWPOINT_WEIGHTS, catalog.PLACE_SIGNAL_VIEWPOINT),
                              ("bridge_place", catalog.BRIDGE_COASTAL_WEIGHTS, catalog.PLACE_SIGNAL_BRIDGE)):
        parts.append(place_signal_tiles(weighted_places(src["places"], place_weights(spark, rows)), shape, grid, name).select("cell", name))
    out = base.select("cell")
    for part in parts:
        out = out.join(part, "cell", "left")
    return out


def release_train(tiles: DataFrame, features: DataFrame, upto: str = "3.7", scored_us: int = 0) -> DataFrame:
    """Releases 3.1 to `upto` in one pass. Each row starts after the release it already has, so a rerun resumes."""
    df = tiles.join(features, "cell", "left")
    for tag, step in TRAIN:
        if float(tag) <= float(upto):
            df = step(df, ahead=True, scored_us=scored_us)
    return df.drop(*FEATURES)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written completely; a half-written one is redone."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_releases(tiles: DataFrame, features: DataFrame, folder: str, upto: str = "3.7", scored_us: int = 0) -> DataFrame:
    """The same train with a written table per release in a shared folder; finished releases are read back, not redone."""
    spark = tiles.sparkSession
    df = tiles
    for tag, step in TRAIN:
        if float(tag) > float(upto):
            break
        path = f"{folder}/release_{tag.replace('.', '_')}"
        if _finished(spark, path):
            df = spark.read.parquet(path)
            continue
        done = step(df.join(features, "cell", "left"), ahead=True, scored_us=scored_us).drop(*FEATURES)
        done.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
    return df


def release_report(tiles: DataFrame, version: str, signals: list[str]) -> DataFrame:
    aggs = [F.count("*").alias("tiles")]
    for s in signals:
        aggs += [F.count_if(F.col(s) > 0).alias(f"{s}_non_zero"), F.min(s).alias(f"{s}_min"), F.avg(s).alias(f"{s}_avg"), F.max(s).alias(f"{s}_max"),
                 F.stddev_pop(s).alias(f"{s}_stddev")]
    return tiles.where(F.col("scoring_version") == version).agg(*aggs)


def version_counts(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("scoring_version").agg(F.count("*").alias("n"))
