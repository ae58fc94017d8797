"""Readers, writers and staging operators for the domain tables."""

from __future__ import annotations

import xml.sax.saxutils as sax
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistagrid.functions import catalog, geo
from vistagrid.functions.scalars import clamp01

POINT = T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())])
TILE_SCHEMA = T.StructType(
    [T.StructField("cell", T.StringType())]
    + [T.StructField(n, T.DoubleType()) for n in catalog.TILE_SCORES]
    + [T.StructField("last_scored_us", T.LongType()), T.StructField("scoring_version", T.StringType())])
ROAD_SCHEMA = T.StructType([
    T.StructField("road_id", T.LongType()), T.StructField("way_id", T.LongType()), T.StructField("cell", T.StringType()),
    T.StructField("length_m", T.DoubleType()), T.StructField("speed_kmh", T.IntegerType()),
    T.StructField("road_type", T.StringType()), T.StructField("surface", T.StringType()),
    T.StructField("curvature", T.DoubleType()), T.StructField("elevation_change", T.DoubleType()),
    T.StructField("geom", T.ArrayType(POINT))])
BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("xmin", "xmax", "ymin", "ymax")])


def read_tiles(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """Typed tile scan. Written with `write_tiles` the version is a partition, so the filter prunes folders."""
    tiles = spark.read.schema(TILE_SCHEMA).parquet(path)
    return tiles if version is None else tiles.where(F.col("scoring_version") == version)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Tiles as parquet, one folder per version, clustered by cell inside it."""
    tiles.repartitionByRange("scoring_version", "cell").sortWithinPartitions("scoring_version", "cell").write.mode(
        "overwrite").partitionBy("scoring_version").parquet(path)


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROAD_SCHEMA).parquet(path)


def in_bbox(bbox: tuple[float, float, float, float], prefix: str = "bbox.") -> Column:
    """Overlap with [min_lon, max_lon) x [min_lat, max_lat] on plain columns, so parquet statistics can prune."""
    min_lon, min_lat, max_lon, max_lat = bbox
    return ((F.col(f"{prefix}xmax") >= min_lon) & (F.col(f"{prefix}xmin") < max_lon)
            & (F.col(f"{prefix}ymax") >= min_lat) & (F.col(f"{prefix}ymin") <= max_lat))


def confident(min_conf: float = 0.60) -> Column:
    return F.col("confidence").isNull() | (F.col("confidence") >= min_conf)


def read_places(spark: SparkSession, path: str, bbox, min_conf: float = 0.60) -> DataFrame:
    return places_in_box(spark.read.parquet(path), bbox, min_conf)


def places_in_box(places: DataFrame, bbox, min_conf: float = 0.60) -> DataFrame:
    return places.where(in_bbox(bbox) & confident(min_conf))


def read_buildings(spark: SparkSession, path: str, bbox) -> DataFrame:
    """Building footprints (`ring`) reduced to centroid lon and lat."""
    return footprint_centroids(spark.read.parquet(path).where(in_bbox(bbox)))


def footprint_centroids(footprints: DataFrame) -> DataFrame:
    return footprints.withColumn("centroid", geo.polygon_centroid("ring")).select(
        "id", F.col("centroid.lon").alias("lon"), F.col("centroid.lat").alias("lat"))


def lon_strips(df: DataFrame, degrees: float = 5.0, origin: float = -180.0, lon: str = "lon") -> DataFrame:
    """Adds the half-open longitude strip of each row; write with partitionBy('strip')."""
    return df.withColumn("strip", F.floor((F.col(lon) - origin) / degrees))


def normalize_places(staged: DataFrame) -> DataFrame:
    """One row per id with blank texts as null; rows without id or position are dropped.

    `max_by` keeps the most confident copy and combines map-side, so many copies of one id do not pile up in a task.
    """
    clean = staged.where(F.col("place_id").isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    rest = [c for c in staged.columns if c not in ("place_id", "tags")]
    order = F.struct(F.coalesce("confidence", F.lit(-1.0)), F.coalesce("name", F.lit("")), F.coalesce("category", F.lit("")), "lon", "lat")
    best = clean.groupBy("place_id").agg(F.max_by(F.struct(*rest), order).alias("b")).select("place_id", "b.*")
    return best.withColumns({n: F.when(F.col(n) != "", F.col(n)) for n in ("name", "category")})


def parse_traffic(raw: DataFrame) -> DataFrame:
    """Blank cells are skipped; unreadable scores become 0.5; others are clamped."""
    score = F.coalesce(F.expr("try_cast(trim(score_text) AS double)"), F.lit(0.5))
    return raw.where(F.trim("cell_text") != "").withColumns({"cell": F.trim("cell_text"), "traffic_score": clamp01(score)}).drop(
        "cell_text", "score_text")


def read_traffic_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = "cell_text string, score_text string"
    raw = spark.read.schema(schema).option("header", True).csv(path)
    return parse_traffic(raw.where(F.col("cell_text").isNotNull()))


def upsert_latest(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins per key. One partial aggregate instead of a window: a hot key never becomes one big group."""
    both = base.select(*delta.columns).unionByName(delta)
    rest = [c for c in delta.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, "v.*")


def load_polygons(df: DataFrame, optional: dict[str, str], ring: str = "ring") -> DataFrame:
    """Keeps rings with at least four points and adds absent optional columns as typed nulls."""
    for name, kind in optional.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df.where(F.size(ring) >= 4)


def append_pages(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Feature pages (line-delimited JSON files) as one table without empty geometries."""
    return drop_empty_rings(spark.read.schema(schema).json(paths))


def drop_empty_rings(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("ring").isNotNull() & (F.size("ring") > 0))


def explode_multipolygon(df: DataFrame, parts: str = "parts", klass: str = "class_text") -> DataFrame:
    """One row per polygon part; the class text becomes an integer (null when it is not one)."""
    rest = [c for c in df.columns if c not in (parts, klass)]
    return df.select(*rest, F.expr(f"try_cast({klass} AS int)").alias("class_id"),
                     F.posexplode(parts).alias("part_no", "ring"))


def raster_summary(raster: DataFrame, band: str = "landcover") -> DataFrame:
    return raster.agg(F.count("*").alias("raster_tiles"), F.min("width").alias("min_width"), F.max("width").alias("max_width"),
                      F.sum(F.size(band)).alias("pixels"), F.min("x0").alias("min_x"), F.max("y0").alias("max_y"))


def read_raster_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def light_sample_summary(samples: DataFrame) -> DataFrame:
    d = F.col("darkness_score")
    return samples.agg(F.count("*").alias("sample_rows"), F.count_if(d != 0.5).alias("changed_rows"), F.min(d).alias("min_darkness"),
                       F.avg(d).alias("avg_darkness"), F.max(d).alias("max_darkness"), F.stddev_pop(d).alias("stddev_darkness"))


def target_tiles(tiles: DataFrame, to: str, source: str = "") -> DataFrame:
    """Tiles not yet at version `to`, optionally only those at `source`; a null version reads as ''."""
    current = F.coalesce("scoring_version", F.lit(""))
    out = tiles.where(current != to)
    return out if source == "" else out.where(current == source)


def sample_points(tiles: DataFrame, to: str) -> DataFrame:
    """One interior point of each target tile, ordered by cell."""
    return target_tiles(tiles, to).where(F.coalesce("cell", F.lit("")) != "").select("cell", "lon", "lat").orderBy("cell")


EXPORT_COLUMNS = [
    "cell", "scenic_score", "water_score", "green_score", "elevation_score", "solitude_score", "curve_score", "poi_score",
    "park_score", "overture_poi_score", "building_density_score", "darkness_score", "urban_penalty_score",
    "road_stress_score", "natural_land_use", "elevation_variance", "last_scored_us", "scoring_version",
    "water_visibility_score", "water_crossing_score", "coastal_road_score", "tree_canopy_score", "scenic_poi_score",
    "viewpoint_score", "bridge_coastal_score"]


def release_rows(tiles: DataFrame, version: str) -> DataFrame:
    return tiles.where(F.col("scoring_version") == version).select(*EXPORT_COLUMNS).orderBy("cell")


def export_release(tiles: DataFrame, version: str, path: str) -> None:
    """Range-sorted CSV parts of one version; fails when the version has no tile."""
    rows = release_rows(tiles, version)
    if rows.isEmpty():
        raise ValueError(f"no tile at version {version}")
    rows.write.mode("overwrite").option("header", True).csv(path)


def release_stats(tiles: DataFrame, version: str) -> DataFrame:
    s = F.col("scenic_score")
    out = tiles.where(F.col("scoring_version") == version).agg(
        F.count("*").alias("tile_count"), F.min(s).alias("min_score"), F.max(s).alias("max_score"), F.avg(s).alias("avg_score"),
        F.stddev_pop(s).alias("stddev_score"), F.min("last_scored_us").alias("first_scored_us"), F.max("last_scored_us").alias("last_scored_us"))
    return out.withColumn("stats_json", F.to_json(F.struct("tile_count", "first_scored_us", "last_scored_us")))


def segment_endpoints(roads: DataFrame, limit: int | None = None) -> DataFrame:
    """First and last point of the segments that still lack an elevation change."""
    first, last = F.element_at("geom", 1), F.element_at("geom", -1)
    out = roads.where(F.coalesce("elevation_change", F.lit(0.0)) == 0.0).select(
        "road_id", first["lat"].alias("start_lat"), first["lon"].alias("start_lon"),
        last["lat"].alias("end_lat"), last["lon"].alias("end_lon"))
    return out if limit is None else out.orderBy("road_id").limit(limit)


# Points in one body row of an exported route.
EXPORT_SPAN = 4096


def _document(points: DataFrame, name: str, head: Column, point: Column, between: str, foot: str) -> DataFrame:
    """(route_id, part, text) rows of one document per route: a header row, body rows in order, a footer row.

    Every route has this shape, whatever its length, and the texts joined in the order of `part` are the valid file.
    """
    part = F.floor(F.col("seq") / EXPORT_SPAN) + 1
    lines = points.select("route_id", part.alias("part"), "seq", point.alias("line"))
    body = lines.groupBy("route_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda p: p["line"]), between).alias("text"))
    body = body.select("route_id", "part", F.when(F.col("part") > 1, F.concat(F.lit(between), "text")).otherwise(F.col("text")).alias(name))
    ends = body.groupBy("route_id").agg(F.max("part").alias("last"))
    rows = F.array(F.struct(F.lit(0).cast("bigint").alias("part"), head.alias(name)), F.struct((F.col("last") + 1).alias("part"), F.lit(foot).alias(name)))
    return body.unionByName(ends.select("route_id", F.explode(rows).alias("r")).select("route_id", "r.*"))


def export_geojson(points: DataFrame) -> DataFrame:
    """LineString feature text of each route, as header, body and footer rows."""
    head = F.concat(F.lit('{"type":"Feature","properties":{"routeId":'), F.col("route_id").cast("string"), F.lit('},"geometry":{"type":"LineString","coordinates":['))
    point = F.concat(F.lit("["), F.col("lon").cast("string"), F.lit(","), F.col("lat").cast("string"), F.lit("]"))
    return _document(points, "geojson", head, point, ",", "]}}")


def export_gpx(points: DataFrame, title: str = "Route") -> DataFrame:
    """GPX track text of each route, as header, body and footer rows."""
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
                          + sax.escape(title, {'"': "&quot;"}) + " "), F.col("route_id").cast("string"), F.lit("</name><trkseg>"))
    point = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lon").cast("string"), F.lit('" />'))
    return _document(points, "gpx", head, point, "", "</trkseg></trk></gpx>")


def _decode(text: str) -> tuple[list[float], list[float]]:
    """Points of one encoded path at 1e-5 degrees: zig-zag deltas in 5-bit groups."""
    values, value, shift = [], 0, 0
    for ch in text:
        bits = ord(ch) - 63
        value |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            values.append(-(value + 1 >> 1) if value & 1 else value >> 1)
            value = shift = 0
    lats = pd.Series(values[0::2], dtype="float64").cumsum() / 1e5
    lons = pd.Series(values[1::2], dtype="float64").cumsum() / 1e5
    return list(lats), list(lons)


def explode_polyline(df: DataFrame, col: str, key: str) -> DataFrame:
    """Encoded-path column to point rows. Decoding is sequential inside a text, so it runs as Arrow batches."""
    key_type = df.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, text in zip(batch[key], batch[col]):
                lats, lons = _decode(text or "")
                yield pd.DataFrame({key: [k] * len(lats), "seq": range(len(lats)), "lat": lats, "lon": lons})

    return df.select(key, col).mapInPandas(decode, f"{key} {key_type}, seq bigint, lat double, lon double")


def encode_polyline(points: Column) -> Column:
    """Encoded text of a bounded point array; the inverse of `explode_polyline`, kept on the JVM."""
    n = F.size(points)
    whole = F.transform(points, lambda p: F.struct(F.round(p["lat"] * 1e5).cast("bigint").alias("a"), F.round(p["lon"] * 1e5).cast("bigint").alias("o")))
    shifted = F.concat(F.array(F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("o"))), F.slice(whole, F.lit(1), n - 1))
    flat = F.flatten(F.zip_with(whole, shifted, lambda c, p: F.array(c["a"] - p["a"], c["o"] - p["o"])))

    def spell(v: Column) -> Column:
        z = F.when(v < 0, -v * 2 - 1).otherwise(v * 2)
        groups = F.greatest(F.lit(1), F.ceil(F.length(F.bin(z)) / 5).cast("int"))
        chars = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.char(
            F.floor(z / F.pow(F.lit(32.0), i)) % 32 + F.when(i < groups - 1, 32).otherwise(0) + 63))
        return F.array_join(chars, "")

    return F.array_join(F.transform(flat, spell), "")


def spec_views(roads: DataFrame, tiles: DataFrame, jobs: DataFrame, routes: DataFrame) -> dict[str, DataFrame]:
    """Compatibility projections under the older column names."""
    speed = F.when(F.col("speed_kmh") > 0, F.col("speed_kmh")).otherwise(50)
    segment = roads.select(
        F.col("road_id").alias("id"), "way_id", F.col("cell").alias("h3_index_res7"), F.col("road_type").alias("highway_type"),
        F.col("surface").alias("surface_type"), "speed_kmh", "length_m", F.col("curvature").alias("curvature_score"),
        F.col("elevation_change").alias("elevation_gain_m"),
        F.greatest(F.lit(1).cast("bigint"), F.round(F.col("length_m") / (speed * 1000.0 / 3600.0)).cast("bigint")).alias("estimated_travel_time_s"),
        F.lit("osm").alias("data_source"))
    tile = tiles.select(
        F.col("cell").alias("h3_index"), F.lit(7).alias("h3_resolution"), F.col("lat").alias("center_lat"), F.col("lon").alias("center_lng"),
        F.col("natural_land_use").alias("land_use_score"), F.col("elevation_variance").alias("elevation_score"),
        F.col("water_proximity").alias("water_proximity_score"), (1.0 - F.least(F.lit(1.0), "road_density")).alias("traffic_density_score"),
        F.col("road_density").alias("road_curvature_score"), F.col("poi_density").alias("poi_density_score"),
        F.col("scenic_score").alias("composite_score"), F.lit(0.7).alias("confidence"))
    job = jobs.select(F.col("request_id").alias("id"), "user_id", F.col("lat").alias("start_lat"), F.col("lon").alias("start_lng"),
                      F.col("budget").alias("time_budget_minutes"), "vibe",
                      F.when(F.upper("status") == "SUBMITTED", "QUEUED").otherwise(F.upper("status")).alias("status"),
                      F.col("created_us").alias("queued_us"))
    route = routes.join(job.select(F.col("id").alias("job_id"), "start_lat", "start_lng", "time_budget_minutes"), "job_id").select(
        F.col("route_id").alias("id"), "job_id", (F.col("km") * 1000.0).alias("total_distance_m"),
        (F.col("minutes") * 60).alias("estimated_duration_s"), F.col("score").alias("scenic_score"), "start_lat", "start_lng",
        "time_budget_minutes", F.lit("STANDARD").alias("quality_tier"))
    road_scores = segment.join(tile, segment["h3_index_res7"] == tile["h3_index"], "left").select(
        segment["id"], "highway_type", segment["length_m"], segment["curvature_score"],
        clamp01(F.abs(F.coalesce("elevation_gain_m", F.lit(0.0))) / 100.0).alias("elevation_score"),
        F.coalesce(1.0 - F.col("traffic_density_score"), F.lit(0.5)).alias("traffic_score"),
        F.coalesce("land_use_score", F.lit(0.5)).alias("greenery_score"), F.coalesce("composite_score", F.lit(0.5)).alias("scenic_score"))
    return {"road_segment": segment, "scenic_score_tile": tile, "route_job": job, "route": route, "road_segment_scores": road_scores}


def require_sources(**inputs: DataFrame) -> DataFrame:
    """One row per named input telling whether it has rows; raises with the names of the empty ones.

    Each check reads at most one row of its input.
    """
    missing = sorted(name for name, df in inputs.items() if df.isEmpty())
    if missing:
        raise ValueError("missing or empty input: " + ", ".join(missing))
    first = next(iter(inputs.values()))
    out = None
    for name, df in inputs.items():
        row = df.limit(1).agg(F.count("*").alias("rows_seen")).select(F.lit(name).alias("source"), "rows_seen")
        out = row if out is None else out.unionByName(row)
    return out if out is not None else first
