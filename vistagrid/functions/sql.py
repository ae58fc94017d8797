"""The scalar functions for SQL users: `register(spark)` makes temporary SQL functions that Catalyst inlines.

A function is the text of an expression, so a query that calls it has the same plan as one that uses the Column: nothing
runs in Python. Columns without lambdas or structs are rendered from their resolved expression; the others are short texts
that may call the functions before them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vistagrid.functions import catalog, cells, geo, scalars, scoring, text
from vistagrid.functions.cells import HexGrid

PREFIX = "vg_"


def _doubles(names: str) -> list[tuple[str, str]]:
    return [(n, "DOUBLE") for n in names.split()]


def _strings(names: str) -> list[tuple[str, str]]:
    return [(n, "STRING") for n in names.split()]


def columns(grid: HexGrid) -> dict[str, tuple[list[tuple[str, str]], Callable[..., Column]]]:
    """Functions that are rendered: parameters and the Column."""
    return {
        "haversine_m": (_doubles("lat1 lon1 lat2 lon2"), geo.haversine), "haversine_km": (_doubles("lat1 lon1 lat2 lon2"), lambda *p: geo.haversine(*p, geo.EARTH_KM)),
        "bearing": (_doubles("lat1 lon1 lat2 lon2"), geo.bearing), "turn": (_doubles("bearing1 bearing2"), geo.turn), "normalize_lon": (_doubles("lon"), geo.normalize_lon),
        "point_segment_distance": (_doubles("px py ax ay bx by"), geo.point_segment_distance), "sector": ([("bearing", "DOUBLE"), ("n", "INT")], lambda b, n: F.floor(b / (360.0 / n)).cast("int")),
        "cell_of": (_doubles("lat lon"), grid.cell_of), "cell_parent": (_strings("cell"), cells.cell_parent), "cell_valid": (_strings("cell"), cells.cell_valid), "cell_resolution": (_strings("cell"), cells.cell_resolution),
        "ring_distance": (_strings("a b"), cells.ring_distance), "coord_key": (_doubles("lat lon"), lambda a, b: geo.coord_key(a, b, 3)), "region_grid": (_doubles("lat lon"), text.region_grid),
        "time_bucket": ([("minutes", "INT")], text.time_bucket), "time_bucket_capped": ([("minutes", "INT")], text.time_bucket_capped),
        "travel_seconds": ([("length_m", "DOUBLE"), ("speed_kmh", "INT")], lambda m, v: F.greatest(F.lit(1), scalars.round_half_up(m / (F.when(v > 0, v).otherwise(50) * 1000.0 / 3600.0)).cast("int"))),
        "score_color": (_doubles("score"), scoring.score_color), "quality_tier": ([("score", "DOUBLE"), ("options", "INT")], scoring.quality_tier),
        "clamp01": (_doubles("x"), scalars.clamp01), "clamp": (_doubles("x low high"), scalars.clamp), "finite01": (_doubles("x"), scalars.finite01), "round_half_up4": (_doubles("x"), lambda x: scalars.round_half_up(x, 4)),
        "graded": (_doubles("x floor_at full_at"), lambda x, a, b: scalars.clamp01((x - a) / F.greatest(F.lit(0.01), b - a))),
        "normalize_vibe": (_strings("vibe"), text.normalize_vibe), "calibration_key": ([*_strings("mode region"), ("minutes", "INT"), *_strings("strategy")], text.calibration_key),
        "normalize_profile": (_strings("profile"), text.normalize_profile), "normalize_region": (_strings("region"), text.normalize_region), "blank_to_null": (_strings("value"), text.blank_to_null)}


def _listed(items) -> str:
    return ", ".join(f"'{i}'" for i in items)


def texts(p: str, vibe: str, metres: str) -> dict[str, tuple[list[tuple[str, str]], str, str]]:
    """Functions over arrays, structs and JSON: parameters, result type and body; `p` is the prefix of the others.

    SQL functions cannot be called on the variable of a lambda, so there the rendered texts stand themselves: `vibe`, the
    canonical spelling of v, and `metres`, the great-circle distance of lat1, lon1, lat2, lon2.
    """
    step = lambda a, b: f"concat(CAST(split_part(cell, ':', 1) AS BIGINT) {a}, ':', CAST(split_part(cell, ':', 2) AS BIGINT) {b}, ':', split_part(cell, ':', 3))"
    labels = ", ".join(f"'{k}', '{v}'" for k, v in catalog.VIBE_LABELS.items())
    path = "ARRAY<STRUCT<lon: DOUBLE, lat: DOUBLE>>"
    ends = "named_struct('lat1', geom[i - 1].lat, 'lon1', geom[i - 1].lon, 'lat2', geom[i].lat, 'lon2', geom[i].lon)"
    leg = re.sub(r"\b(l(?:at|on)[12])\b", r"s.\1", metres)
    far = f"greatest(0D, metres) / {float(geo.EARTH_M)}D"
    reached = f"asin(sin(radians(lat)) * cos({far}) + cos(radians(lat)) * sin({far}) * cos(radians(bearing)))"
    straight = f"{p}haversine_m(geom[0].lat, geom[0].lon, element_at(geom, -1).lat, element_at(geom, -1).lon)"
    return {
        "k_ring": ([("cell", "STRING"), ("k", "INT")], "ARRAY<STRING>", f"transform(flatten(transform(sequence(-k, k), a -> transform(sequence(greatest(-k, -a - k), least(k, -a + k)), b -> named_struct('q', a, 'r', b)))), d -> {step('+ d.q', '+ d.r')})"),
        "cell_children": (_strings("cell"), "ARRAY<STRING>", "transform(array(named_struct('q', -1, 'r', 0), named_struct('q', -1, 'r', 1), named_struct('q', 0, 'r', -1), named_struct('q', 0, 'r', 0), named_struct('q', 0, 'r', 1), named_struct('q', 1, 'r', -1), "
                          "named_struct('q', 1, 'r', 0)), d -> concat(CAST(split_part(cell, ':', 1) AS BIGINT) * 2 - CAST(split_part(cell, ':', 2) AS BIGINT) + d.q, ':', "
                          "CAST(split_part(cell, ':', 2) AS BIGINT) * 3 + CAST(split_part(cell, ':', 1) AS BIGINT) + d.r, ':', CAST(split_part(cell, ':', 3) AS INT) + 1))"),
        "destination_lat": (_doubles("lat lon bearing metres"), "DOUBLE", f"degrees({reached})"),
        "destination_lon": (_doubles("lat lon bearing metres"), "DOUBLE", f"{p}normalize_lon(degrees(radians(lon) + atan2(sin(radians(bearing)) * sin({far}) * cos(radians(lat)), cos({far}) - sin(radians(lat)) * sin({reached}))))"),
        "destination": (_doubles("lat lon bearing metres"), "STRUCT<lat: DOUBLE, lon: DOUBLE>", f"named_struct('lat', {p}destination_lat(lat, lon, bearing, metres), 'lon', {p}destination_lon(lat, lon, bearing, metres))"),
        "bbox_exact": (_doubles("lat lon metres"), "STRUCT<min_lon: DOUBLE, min_lat: DOUBLE, max_lon: DOUBLE, max_lat: DOUBLE>",
                       f"named_struct('min_lon', {p}destination_lon(lat, lon, 270D, metres), 'min_lat', {p}destination_lat(lat, lon, 180D, metres), 'max_lon', {p}destination_lon(lat, lon, 90D, metres), 'max_lat', {p}destination_lat(lat, lon, 0D, metres))"),
        "path_length": ([("geom", path)], "DOUBLE", f"CASE WHEN size(geom) < 2 THEN 0D ELSE aggregate(transform(transform(sequence(1, size(geom) - 1), i -> {ends}), s -> {leg}), 0D, (sum, x) -> sum + x) END"),
        "path_curvature": ([("geom", path)], "DOUBLE", f"CASE WHEN size(geom) < 2 THEN 0D WHEN {straight} < 1D THEN 0D ELSE least(1D, ({p}path_length(geom) - {straight}) / {straight} / 0.5D) END"),
        "parse_vibes": (_strings("raw"), "ARRAY<STRING>", f"coalesce(array_distinct(filter(transform(filter(from_json(raw, 'array<string>'), v -> v IS NOT NULL AND trim(v) <> ''), v -> {vibe}), v -> v IN ({_listed(catalog.VIBES)}))), CAST(array() AS ARRAY<STRING>))"),
        "resolve_vibes": (_strings("raw vibe"), "ARRAY<STRING>", f"CASE WHEN size({p}parse_vibes(raw)) > 0 THEN {p}parse_vibes(raw) ELSE array(CASE WHEN {p}normalize_vibe(vibe) = '' THEN '{catalog.DEFAULT_VIBE}' ELSE {p}normalize_vibe(vibe) END) END"),
        "normalize_feedback_tags": ([("tags", "ARRAY<STRING>")], "ARRAY<STRING>", f"slice(array_distinct(filter(transform(filter(tags, t -> t IS NOT NULL), t -> translate(lower(trim(t)), '- ', '__')), t -> t IN ({_listed(catalog.FEEDBACK_TAGS)}))), 1, 4)"),
        "display_list": ([("vibes", "ARRAY<STRING>")], "STRING", f"CASE WHEN size(coalesce(filter(transform(vibes, v -> coalesce(map({labels})[{vibe}], v)), v -> v IS NOT NULL AND trim(v) <> ''), array())) > 0 "
                         f"THEN array_join(filter(transform(vibes, v -> coalesce(map({labels})[{vibe}], v)), v -> v IS NOT NULL AND trim(v) <> ''), ' + ') ELSE '{catalog.VIBE_LABELS[catalog.DEFAULT_VIBE]}' END"),
        "tag_set": ([("tags", "MAP<STRING, STRING>"), ("key", "STRING")], "BOOLEAN", "coalesce(tags[key] NOT IN ('', 'no'), false)")}


def rendered(spark: SparkSession, parameters: list[tuple[str, str]], fn: Callable[..., Column]) -> tuple[str, str]:
    """Result type and SQL text of a Column function of the given parameters."""
    rows = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in parameters)).select(fn(*[F.col(n) for n, _ in parameters]).alias("result"))
    return rows.schema["result"].dataType.simpleString(), rows._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession, grid: HexGrid | None = None, prefix: str = PREFIX) -> list[str]:
    """Makes the functions of the session; the names that SQL can call from now on."""
    grid = grid or HexGrid()
    made = {name: (parameters, *rendered(spark, parameters, fn)) for name, (parameters, fn) in columns(grid).items()}
    made |= texts(prefix, rendered(spark, _strings("v"), text.normalize_vibe)[1], made["haversine_m"][2])
    for name, (parameters, result, body) in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({', '.join(f'{n} {t}' for n, t in parameters)}) RETURNS {result} RETURN {body}")
    return [prefix + name for name in made]
