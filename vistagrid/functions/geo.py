"""Great-circle and planar geometry as Column expressions.

Paths and rings are `array<struct<lon: double, lat: double>>`; a ring repeats its first point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistagrid.functions.scalars import c, clamp, clamp01

# The earth radii used by the different parts of the scoring rules.
EARTH_M = 6371000.0
EARTH_KM = 6371.0
EARTH_KM_REPORT = 6371.0088
METRES_PER_DEGREE = 111320.0
KM_PER_DEGREE_BOX = 111.0


def haversine(lat1, lon1, lat2, lon2, radius: float = EARTH_M) -> Column:
    lat1, lon1, lat2, lon2 = (c(v) for v in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * radius)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in degrees, [0, 360)."""
    p1, p2 = F.radians(c(lat1)), F.radians(c(lat2))
    dl = F.radians(c(lon2) - c(lon1))
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def turn(b1, b2) -> Column:
    """Absolute bearing change in degrees, 0..180."""
    d = F.abs(c(b2) - c(b1))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def normalize_lon(lon) -> Column:
    """Wrap to [-180, 180]; values already inside are kept as they are."""
    x = c(lon)
    up = F.ceil((x - 180.0) / 360.0) * 360.0
    down = F.ceil((-180.0 - x) / 360.0) * 360.0
    return F.when(x > 180.0, x - up).when(x < -180.0, x + down).otherwise(x)


def destination(lat, lon, bearing_deg, distance, radius: float = EARTH_M) -> Column:
    """struct(lat, lon) reached from a point; negative distances count as 0."""
    p, b = F.radians(c(lat)), F.radians(c(bearing_deg))
    d = F.greatest(F.lit(0.0), c(distance)) / radius
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    l2 = F.radians(c(lon)) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.struct(F.degrees(p2).alias("lat"), normalize_lon(F.degrees(l2)).alias("lon"))


def bbox_exact(lat, lon, metres) -> Column:
    """struct(min_lon, min_lat, max_lon, max_lat) from four great-circle destinations."""
    north, east, south, west = (destination(lat, lon, F.lit(b), metres) for b in (0.0, 90.0, 180.0, 270.0))
    return F.struct(
        west["lon"].alias("min_lon"), south["lat"].alias("min_lat"),
        east["lon"].alias("max_lon"), north["lat"].alias("max_lat"),
    )


def bbox_degrees(lat, lon, km) -> Column:
    """Cheap box: r/111 degrees of latitude and r/(111 cos lat) of longitude."""
    dlat = c(km) / KM_PER_DEGREE_BOX
    dlon = c(km) / (F.cos(F.radians(c(lat))) * KM_PER_DEGREE_BOX)
    return F.struct(
        (c(lon) - dlon).alias("min_lon"), (c(lat) - dlat).alias("min_lat"),
        (c(lon) + dlon).alias("max_lon"), (c(lat) + dlat).alias("max_lat"),
    )


def point(lon, lat) -> Column:
    return F.struct(c(lon).alias("lon"), c(lat).alias("lat"))


def steps(geom) -> Column:
    """Consecutive point pairs of a path: array<struct<a, b>>."""
    g = c(geom)
    n = F.size(g)
    return F.when(
        n >= 2,
        F.zip_with(F.slice(g, F.lit(1), n - 1), F.slice(g, F.lit(2), n - 1),
                   lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
    )


def path_length(geom, radius: float = EARTH_M) -> Column:
    legs = F.transform(steps(geom), lambda s: haversine(s["a"]["lat"], s["a"]["lon"], s["b"]["lat"], s["b"]["lon"], radius))
    return F.aggregate(legs, F.lit(0.0), lambda acc, x: acc + x)


def path_curvature(geom) -> Column:
    """Excess of path length over the straight line, scaled so that 50 % excess is 1."""
    g = c(geom)
    first, last = F.element_at(g, 1), F.element_at(g, -1)
    straight = haversine(first["lat"], first["lon"], last["lat"], last["lon"])
    return F.when((F.size(g) < 2) | (straight < 1.0), 0.0).otherwise(
        F.least(F.lit(1.0), (path_length(g) - straight) / straight / 0.5))


def mean_turn_array(geom) -> Column:
    """Mean absolute bearing change / 90 of a bounded point array; fewer than 3 points give 0."""
    s = steps(geom)
    b = F.transform(s, lambda x: bearing(x["a"]["lat"], x["a"]["lon"], x["b"]["lat"], x["b"]["lon"]))
    n = F.size(b)
    turns = F.zip_with(F.slice(b, F.lit(1), n - 1), F.slice(b, F.lit(2), n - 1), turn)
    total = F.aggregate(turns, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(c(geom)) < 3, 0.0).otherwise(clamp01(total / (n - 1) / 90.0))


def envelope(ring) -> Column:
    xs = F.transform(c(ring), lambda p: p["lon"])
    ys = F.transform(c(ring), lambda p: p["lat"])
    return F.struct(F.array_min(xs).alias("min_lon"), F.array_min(ys).alias("min_lat"),
                    F.array_max(xs).alias("max_lon"), F.array_max(ys).alias("max_lat"))


def ring_area2(ring) -> Column:
    """Twice the signed area, in squared degrees."""
    o = F.element_at(c(ring), 1)
    return F.aggregate(
        steps(ring), F.lit(0.0),
        lambda acc, s: acc + (s["a"]["lon"] - o["lon"]) * (s["b"]["lat"] - o["lat"])
        - (s["b"]["lon"] - o["lon"]) * (s["a"]["lat"] - o["lat"]))


def polygon_centroid(ring) -> Column:
    """Area centroid of a ring; a degenerate ring falls back to the mean of its points."""
    g = c(ring)
    o = F.element_at(g, 1)

    def moment(axis: str) -> Column:
        return F.aggregate(
            steps(g), F.lit(0.0),
            lambda acc, s: acc + (s["a"][axis] + s["b"][axis] - o[axis] * 2.0)
            * ((s["a"]["lon"] - o["lon"]) * (s["b"]["lat"] - o["lat"])
               - (s["b"]["lon"] - o["lon"]) * (s["a"]["lat"] - o["lat"])))

    def mean(axis: str) -> Column:
        return F.aggregate(g, F.lit(0.0), lambda acc, p: acc + p[axis]) / F.size(g)

    a2 = ring_area2(g)
    flat = F.coalesce(F.abs(a2) < 1e-18, F.lit(True))

    def coordinate(axis: str) -> Column:
        return F.when(flat, mean(axis)).otherwise(o[axis] + moment(axis) / (a2 * 3.0)).alias(axis)

    return F.struct(coordinate("lon"), coordinate("lat"))


def point_in_ring(lon, lat, ring) -> Column:
    """Even-odd ray cast; the half-open edge rule assigns shared borders once."""
    x, y = c(lon), c(lat)

    def flips(acc, s):
        a, b = s["a"], s["b"]
        spans = (a["lat"] > y) != (b["lat"] > y)
        cross = a["lon"] + (y - a["lat"]) / (b["lat"] - a["lat"]) * (b["lon"] - a["lon"])
        return acc + F.when(spans & (x < cross), 1).otherwise(0)

    return F.aggregate(steps(ring), F.lit(0), flips) % 2 == 1


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    norm = dx * dx + dy * dy
    t = F.when(norm > 0.0, clamp(((px - ax) * dx + (py - ay) * dy) / norm, 0.0, 1.0)).otherwise(0.0)
    ex, ey = ax + t * dx - px, ay + t * dy - py
    return F.sqrt(ex * ex + ey * ey)


def sector(bearing_deg, n: int) -> Column:
    return F.floor(c(bearing_deg) / (360.0 / n)).cast("int")


def coord_key(lat, lon, digits: int) -> Column:
    return F.format_string(f"%.{digits}f,%.{digits}f", c(lat), c(lon))
