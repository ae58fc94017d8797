"""Spatial joins as equi-joins on hexagon cells followed by an exact Column filter.

Every join here shuffles on the cell. The side that can be crowded is salted, the other side is copied once per salt,
so one crowded cell is shared by several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vistagrid.functions import cells, geo
from vistagrid.functions.cells import HexGrid
from vistagrid.functions.scalars import c
from vistagrid.session import shared

SALTS = 4
# Lines are cut into pieces of at most this length, so that a piece belongs to one cell. Borders that are copied to all cells
# in reach are cut at the radius, if that is longer: shorter pieces would only meet more often.
PIECE_M = 2000.0
# Distances below this (degrees or metres) count as touching.
TOUCH = 1e-9


def salted_join(crowded: DataFrame, other: DataFrame, on: str, how: str = "inner", by: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join that spreads each key of `crowded` over `salts` tasks; `other` is repeated per salt (inner or left).

    `other` is mostly a small table spread over many cells. The bytes of its file say nothing about that, so it is never
    gathered at the driver for a broadcast.
    """
    other = other.hint("merge")
    if salts == 1:
        return crowded.repartition(int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions")), on).join(other, on, how)
    left = crowded.withColumn("__salt", F.pmod(F.xxhash64(*(by or [on])), F.lit(salts)))
    right = other.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    # The pairs cost far more than their input bytes suggest, so the partition count is fixed, not coalesced by size.
    left = left.repartition(int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions")), on, "__salt")
    return left.join(right, [on, "__salt"], how).drop("__salt")


def metre_scales(lat) -> tuple[Column, Column]:
    """Factors that turn degrees into local metres around a latitude."""
    return F.cos(F.radians(c(lat))) * geo.METRES_PER_DEGREE, F.lit(geo.METRES_PER_DEGREE)


def tile_rings(tiles: DataFrame, grid: HexGrid) -> DataFrame:
    """Adds the hexagon of each tile as `tile_ring` and its centre as `center`."""
    placed = tiles.withColumns({"__q": cells.cell_q("cell"), "__r": cells.cell_r("cell")})
    placed = placed.withColumn("center", grid.center_axial("__q", "__r", 7))
    return placed.withColumn("tile_ring", grid.boundary_around("center")).drop("__q", "__r")


def ring_join(requests: DataFrame, tiles: DataFrame, grid: HexGrid, ring: str = "ring", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Tiles within `ring` lattice steps of each request's start cell.

    Both sides meet on blocks of 8 x 8 lattice positions: a ring of 22 touches at most 49 blocks instead of 1,519
    single cells per request. The exact ring test follows.
    """
    q, r = grid.axial(lat, lon, 7)
    starts = requests.withColumns({"__q": q, "__r": r})
    starts = starts.withColumn("__bq", F.explode(F.sequence(F.floor((F.col("__q") - F.col(ring)) / 8), F.floor((F.col("__q") + F.col(ring)) / 8))))
    starts = starts.withColumn("__br", F.explode(F.sequence(F.floor((F.col("__r") - F.col(ring)) / 8), F.floor((F.col("__r") + F.col(ring)) / 8))))
    spread = tiles.withColumns({"__tq": cells.cell_q("cell"), "__tr": cells.cell_r("cell")})
    spread = spread.withColumns({"__bq": F.floor(F.col("__tq") / 8), "__br": F.floor(F.col("__tr") / 8)})
    dq, dr = F.col("__tq") - F.col("__q"), F.col("__tr") - F.col("__r")
    inside = F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr)) <= F.col(ring)
    return starts.join(spread, ["__bq", "__br"]).where(inside).drop("__q", "__r", "__bq", "__br", "__tq", "__tr")


def within_radius(points: DataFrame, tiles: DataFrame, metres: float, grid: HexGrid, lat: str = "lat", lon: str = "lon",
                  to_lat: str = "tile_lat", to_lon: str = "tile_lon") -> DataFrame:
    """Pairs at most `metres` apart (great circle), with `distance_m`.

    The meeting resolution follows from the radius, so a pair is only formed in its own neighbourhood.
    """
    res = grid.resolution_for(metres)
    ring = cells.k_ring(grid.cell_of(lat, lon, res), grid.ring_for_metres(metres, lat, res))
    # A point becomes many pairs, so the points are dealt to all tasks first.
    left = points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))).withColumn("__cell", F.explode(ring))
    right = grid.placed(tiles, to_lat, to_lon, "__cell", res)
    pairs = left.join(right, "__cell").drop("__cell")
    return pairs.withColumn("distance_m", geo.haversine(lat, lon, to_lat, to_lon)).where(F.col("distance_m") <= metres)


def nearest_k(points: DataFrame, tiles: DataFrame, metres: float, k: int, grid: HexGrid, key: str, tie: str, **names) -> DataFrame:
    """Up to k nearest tiles per point inside a radius; the limit is applied before the shuffle as well."""
    pairs = within_radius(points, tiles, metres, grid, **names)
    order = Window.partitionBy(key).orderBy("distance_m", tie)
    return pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= k)


def cover_polygons(polygons: DataFrame, grid: HexGrid, ring: str = "ring") -> DataFrame:
    """Polygons split over the cells they may touch, one row per cell."""
    return grid.cover(polygons.withColumn("__env", geo.envelope(ring)), "__env").drop("__env")


def in_envelope(lon, lat, env) -> Column:
    e = c(env)
    return (c(lon) >= e["min_lon"]) & (c(lon) <= e["max_lon"]) & (c(lat) >= e["min_lat"]) & (c(lat) <= e["max_lat"])


def point_in_polygon(points: DataFrame, polygons: DataFrame, grid: HexGrid, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Inner join of points with the polygons that contain them. Cells are disjoint, so no pair appears twice."""
    left = grid.placed(points, lat, lon, "cell")
    right = grid.cover(polygons.withColumn("__env", geo.envelope("ring")), "__env")
    pairs = salted_join(left, right, "cell", by=[lon, lat])
    inside = F.when(in_envelope(lon, lat, "__env"), geo.point_in_ring(lon, lat, "ring")).otherwise(False)
    return pairs.where(inside).drop("cell", "__env")


def piece_length(metres: float) -> float:
    """Longest border piece of a search with this radius."""
    return max(PIECE_M, metres)


def line_pieces(df: DataFrame, keys: list[str], path: str, prefix: str, longest: float = PIECE_M) -> DataFrame:
    """Segments of a path, cut to at most `longest` metres: keys, <prefix>x1, <prefix>y1, <prefix>x2, <prefix>y2 in degrees."""
    seg = df.select(*keys, F.explode(geo.steps(path)).alias("__s"))
    ax, ay, bx, by = (F.col(f"__s.{e}.{k}") for e in ("a", "b") for k in ("lon", "lat"))
    mx, my = (bx - ax) * F.cos(F.radians(ay)), by - ay
    n = F.greatest(F.lit(1), F.ceil(F.sqrt(mx * mx + my * my) * geo.METRES_PER_DEGREE / longest).cast("int"))
    seg = seg.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))

    def at(a, b, step):
        return F.when(step == F.col("__n"), b).otherwise(a + (b - a) * step / F.col("__n"))

    i, k = F.col("__i"), F.col("__i") + 1
    return seg.select(*keys, at(ax, bx, i).alias(f"{prefix}x1"), at(ay, by, i).alias(f"{prefix}y1"),
                      at(ax, bx, k).alias(f"{prefix}x2"), at(ay, by, k).alias(f"{prefix}y2"))


def _ends(prefix: str, sx=1.0, sy=1.0) -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") * (sx if k[0] == "x" else sy) for k in ("x1", "y1", "x2", "y2")}


def at_middle(pieces: DataFrame, grid: HexGrid, prefix: str, name: str) -> DataFrame:
    """Adds the cell of each piece's middle; named steps, because the rounding repeats its input."""
    p = lambda k: F.col(f"{prefix}{k}")
    out = pieces.withColumns({"__my": (p("y1") + p("y2")) / 2, "__mx": (p("x1") + p("x2")) / 2})
    return grid.placed(out, "__my", "__mx", name).drop("__my", "__mx")


def piece_pairs(left: DataFrame, right: DataFrame, grid: HexGrid, metres: float, scale_lat: str | None, salts: int = SALTS) -> DataFrame:
    """Pairs of left pieces (l...) and right pieces (r...) that may be within `metres`, with `distance`.

    A left piece lives in one cell, that of its middle; a right piece is copied to every cell the radius can touch.
    `scale_lat` names the latitude that turns degrees into metres; without it the
    distance stays in degrees.
    """
    env = F.struct(F.least("rx1", "rx2").alias("min_lon"), F.least("ry1", "ry2").alias("min_lat"),
                   F.greatest("rx1", "rx2").alias("max_lon"), F.greatest("ry1", "ry2").alias("max_lat"))
    wide = grid.cover(right.withColumn("__env", env), "__env", metres + PIECE_M / 2 + 10.0, "__cell").drop("__env")
    pairs = salted_join(at_middle(left, grid, "l", "__cell"), wide, "__cell", by=["lx1", "ly1"], salts=salts).drop("__cell")
    sx, sy = (F.lit(1.0), F.lit(1.0)) if scale_lat is None else metre_scales(scale_lat)
    reach = metres if scale_lat is not None else metres / geo.METRES_PER_DEGREE
    return with_piece_distance(pairs, sx, sy, reach)


ENDS = [f"{s}{k}" for s in "lr" for k in ("x1", "y1", "x2", "y2")]


def with_piece_distance(pairs: DataFrame, sx: Column, sy: Column, reach: float) -> DataFrame:
    """Adds `distance` of the piece pairs and drops those farther apart than `reach`.

    Boxes are compared in Spark; the exact distances of what is left are computed over whole Arrow batches, since the
    arithmetic as generated code is a method so long that Java only interprets it.
    """
    keep = [n for n in pairs.columns if n not in ENDS]
    c = F.col
    gap_x = F.greatest(F.least("lx1", "lx2") - F.greatest("rx1", "rx2"), F.least("rx1", "rx2") - F.greatest("lx1", "lx2"))
    gap_y = F.greatest(F.least("ly1", "ly2") - F.greatest("ry1", "ry2"), F.least("ry1", "ry2") - F.greatest("ly1", "ly2"))
    p = pairs.where((gap_x * sx <= reach * (1 + TOUCH) + TOUCH) & (gap_y * sy <= reach * (1 + TOUCH) + TOUCH))
    p = p.select(*keep, *[(c(e) * (sx if e[1] == "x" else sy)).alias(e) for e in ENDS])
    schema = StructType([*p.select(*keep).schema.fields, StructField("distance", DoubleType())])
    return p.mapInArrow(_piece_distances(keep, reach), schema)


def _piece_distances(keep: list[str], reach: float):
    def along(dot, norm):
        return np.where(norm > 0, np.clip(dot / np.where(norm > 0, norm, 1.0), 0.0, 1.0), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lx1, ly1, lx2, ly2, rx1, ry1, rx2, ry2 = (batch.column(e).to_numpy(zero_copy_only=False) for e in ENDS)
            ux, uy, vx, vy, wx, wy, zx, zy = lx2 - lx1, ly2 - ly1, rx2 - rx1, ry2 - ry1, rx1 - lx1, ry1 - ly1, rx2 - lx1, ry2 - ly1
            uu, vv = ux * ux + uy * uy, vx * vx + vy * vy
            crossing = ((ux * wy - uy * wx) * (ux * zy - uy * zx) < 0) & ((vy * wx - vx * wy) * (vx * (uy - wy) - vy * (ux - wx)) < 0)
            t1, t2 = along(wx * ux + wy * uy, uu), along(zx * ux + zy * uy, uu)
            t3, t4 = along(-wx * vx - wy * vy, vv), along((ux - wx) * vx + (uy - wy) * vy, vv)
            squares = [(t1 * ux - wx) ** 2 + (t1 * uy - wy) ** 2, (t2 * ux - zx) ** 2 + (t2 * uy - zy) ** 2,
                       (wx + t3 * vx) ** 2 + (wy + t3 * vy) ** 2, (wx + t4 * vx - ux) ** 2 + (wy + t4 * vy - uy) ** 2]
            distance = np.where(crossing, 0.0, np.sqrt(np.minimum.reduce(squares)))
            near = pa.array(distance <= reach)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).filter(near) for k in keep], pa.array(distance).filter(near)], names=[*keep, "distance"])

    return run


def path_polygon_distance(paths: DataFrame, polygons: DataFrame, grid: HexGrid, metres: float, key: str, path: str = "geom", degrees: bool = False) -> DataFrame:
    """Distance of each path to the nearest filled polygon within reach; paths without one are absent. Paths that share a key
    count as one.

    Border pieces meet border pieces; a path that starts inside a polygon has distance 0.
    """
    first = F.element_at(path, 1)
    left = line_pieces(paths.withColumn("__lat", first["lat"]), [key, "__lat"], path, "l")
    right = line_pieces(polygons, [], "ring", "r", piece_length(metres))
    # Degree distances use plain degrees on both axes, so the radius must hold along a parallel too.
    edge = piece_pairs(left, right, grid, metres, None if degrees else "__lat").groupBy(key).agg(F.min("distance").alias("distance"))
    starts = paths.select(key, first["lon"].alias("lon"), first["lat"].alias("lat"))
    inside = point_in_polygon(starts, polygons.select("ring"), grid).select(key, F.lit(0.0).alias("distance"))
    out = edge.unionByName(inside).groupBy(key).agg(F.min("distance").alias("distance"))
    return out.withColumn("distance", F.when(F.col("distance") <= TOUCH, 0.0).otherwise(F.col("distance")))


def tile_polygon_distances(tiles: DataFrame, polygons: DataFrame, grid: HexGrid, metres: float, degrees: bool = False) -> DataFrame:
    """cell and distance (metres, or plain degrees) of the nearest polygon within reach of each tile."""
    hexes = tile_rings(tiles.select("cell"), grid)
    left = line_pieces(hexes.withColumn("__lat", F.col("center.lat")), ["cell", "__lat"], "tile_ring", "l")
    # The borders of a lattice never crowd a cell, so nothing is salted.
    edge = piece_pairs(left, line_pieces(polygons, [], "ring", "r", piece_length(metres)), grid, metres, None if degrees else "__lat", salts=1)
    tile_inside = point_in_polygon(hexes.select(F.col("cell").alias("tile"), F.col("center.lon").alias("lon"), F.col("center.lat").alias("lat")),
                                   polygons.select("ring"), grid).select(F.col("tile").alias("cell"), F.lit(0.0).alias("distance"))
    start = F.element_at("ring", 1)
    first = polygons.select(start["lat"].alias("__lat"), start["lon"].alias("__lon"), F.lit(0.0).alias("distance"))
    polygon_inside = grid.placed(first, "__lat", "__lon", "cell").select("cell", "distance").join(tiles.select("cell"), "cell", "left_semi")
    out = edge.select("cell", "distance").unionByName(tile_inside).unionByName(polygon_inside).groupBy("cell").agg(F.min("distance").alias("distance"))
    return out.withColumn("distance", F.when(F.col("distance") <= TOUCH, 0.0).otherwise(F.col("distance")))


def touching_tiles(tiles: DataFrame, polygons: DataFrame, grid: HexGrid, key: str) -> DataFrame:
    """Distinct (key, cell) pairs of polygons and the tiles whose hexagon they touch."""
    hexes = tile_rings(tiles.select("cell"), grid)
    edge = piece_pairs(line_pieces(hexes, ["cell"], "tile_ring", "l"), line_pieces(polygons, [key], "ring", "r"), grid, 0.0, None, salts=1)
    tile_inside = point_in_polygon(hexes.select(F.col("cell").alias("tile"), F.col("center.lon").alias("lon"), F.col("center.lat").alias("lat")),
                                   polygons.select(key, "ring"), grid).select(key, F.col("tile").alias("cell"))
    start = F.element_at("ring", 1)
    first = polygons.select(key, start["lat"].alias("__lat"), start["lon"].alias("__lon"))
    polygon_inside = grid.placed(first, "__lat", "__lon", "cell").join(tiles.select("cell"), "cell", "left_semi")
    return edge.where(F.col("distance") <= TOUCH).select(key, "cell").unionByName(tile_inside).unionByName(polygon_inside.select(key, "cell")).distinct()


def line_hints(roads: DataFrame, hints: DataFrame, grid: HexGrid, degrees: float, flags: list[str], key: str = "road_id") -> DataFrame:
    """bool_or of hint flags over the hint lines within `degrees` of each road."""
    left, right = line_pieces(roads, [key], "geom", "l"), line_pieces(hints, flags, "geom", "r")
    pairs = piece_pairs(left, right, grid, degrees * geo.METRES_PER_DEGREE, None).where(F.col("distance") <= degrees)
    return pairs.groupBy(key).agg(*[F.bool_or(f).alias(f) for f in flags])


def pieces_near_points(pieces: DataFrame, points: DataFrame, metres: float, grid: HexGrid) -> DataFrame:
    """Pairs of road pieces (r...) and points (px, py) at most `metres` apart.

    The few points are copied to the cells they can reach; every piece, of which there are many, stays one row.
    """
    env = F.struct(F.col("px").alias("min_lon"), F.col("py").alias("min_lat"), F.col("px").alias("max_lon"), F.col("py").alias("max_lat"))
    wide = grid.cover(points.withColumn("__env", env), "__env", metres + PIECE_M / 2 + 10.0, "__cell").drop("__env")
    pairs = salted_join(at_middle(pieces, grid, "r", "__cell"), wide, "__cell", by=["rx1", "ry1"]).drop("__cell")
    sx, sy = metre_scales("py")
    pairs = pairs.withColumns({"__sx": sx, "__sy": sy})
    pairs = pairs.withColumns({f"__{k}": F.col(k) * F.col("__sx" if "x" in k else "__sy") for k in ("rx1", "ry1", "rx2", "ry2", "px", "py")})
    near = F.col("__px").between(F.least("__rx1", "__rx2") - metres, F.greatest("__rx1", "__rx2") + metres) & F.col("__py").between(F.least("__ry1", "__ry2") - metres, F.greatest("__ry1", "__ry2") + metres)
    d = geo.point_segment_distance(*[F.col(f"__{k}") for k in ("px", "py", "rx1", "ry1", "rx2", "ry2")])
    return pairs.where(near).where(d <= metres).drop("__sx", "__sy", "__rx1", "__ry1", "__rx2", "__ry2", "__px", "__py")


def points_near_roads(points: DataFrame, roads: DataFrame, metres: float, grid: HexGrid, point_key: str) -> DataFrame:
    """Distinct (tile cell of a road, point) pairs with a road of that tile within `metres` of the point."""
    spots = points.select(point_key, F.col("lon").alias("px"), F.col("lat").alias("py"))
    near = pieces_near_points(line_pieces(roads, ["cell"], "geom", "r"), spots, metres, grid)
    return near.select("cell", point_key).distinct()


def raster_pixels(raster: DataFrame, band: str, grid: HexGrid) -> DataFrame:
    """One row per valid pixel: raster_id, cell of the pixel centre, value."""
    px = raster.select("raster_id", "x0", "y0", "dx", "dy", "width", "nodata", F.posexplode(band).alias("i", "value"))
    px = px.where((F.col("value") != F.col("nodata")) & ~F.isnan("value"))
    lon = F.col("x0") + (F.col("i") % F.col("width") + 0.5) * F.col("dx")
    lat = F.col("y0") - (F.floor(F.col("i") / F.col("width")) + 0.5) * F.col("dy")
    return px.select("raster_id", "i", grid.cell_of(lat, lon).alias("cell"), "value")


def raster_envelope() -> Column:
    return F.struct(F.col("x0").alias("min_lon"), (F.col("y0") - F.col("dy") * F.col("height")).alias("min_lat"),
                    (F.col("x0") + F.col("dx") * F.col("width")).alias("max_lon"), F.col("y0").alias("max_lat"))


def sample_raster(points: DataFrame, raster: DataFrame, band: str, grid: HexGrid, key: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pixel value under each point (key, value); several rasters: the lowest id with a valid pixel wins.

    Points first meet raster outlines only; the pixel arrays then travel once per raster, not once per cell.
    """
    outlines = grid.cover(raster.select("raster_id", "x0", "y0", "dx", "dy", "width", "height").withColumn("__env", raster_envelope()), "__env")
    left = points.select(key, F.col(lon).alias("__lon"), F.col(lat).alias("__lat"))
    left = grid.placed(left, "__lat", "__lon", "cell")
    col, row = F.floor((F.col("__lon") - F.col("x0")) / F.col("dx")), F.floor((F.col("y0") - F.col("__lat")) / F.col("dy"))
    hit = (col >= 0) & (row >= 0) & (col < F.col("width")) & (row < F.col("height"))
    where = salted_join(left, outlines, "cell", by=[key]).where(hit).select(key, "raster_id", (row * F.col("width") + col).cast("int").alias("i"))
    values = where.join(raster.select("raster_id", "nodata", F.col(band).alias("__px")), "raster_id")
    values = values.withColumn("value", F.element_at("__px", F.col("i") + 1)).where((F.col("value") != F.col("nodata")) & ~F.isnan("value"))
    return values.groupBy(key).agg(F.min_by("value", "raster_id").alias("value"))


def scope_to_footprint(tiles: DataFrame, raster: DataFrame, grid: HexGrid) -> DataFrame:
    """Tiles whose hexagon touches a raster outline."""
    env = raster_envelope()
    box = F.array(*[geo.point(env[a], env[b]) for a, b in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"),
                                                           ("min_lon", "max_lat"), ("min_lon", "min_lat"))])
    touching = touching_tiles(tiles, raster.select("raster_id", box.alias("ring")), grid, "raster_id")
    return tiles.join(touching.select("cell").distinct(), "cell", "left_semi")


def clip_to_ring(subject, convex) -> Column:
    """Part of a ring inside a convex counter-clockwise ring, as an open point array (empty when disjoint)."""
    none = F.array().cast("array<struct<lon:double,lat:double>>")

    def clip(poly, edge):
        a, b = edge["a"], edge["b"]

        def tagged(p):
            side = (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])
            return F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), side.alias("s"))

        def leg(p, q):
            t = p["s"] / (p["s"] - q["s"])
            cut = F.struct((p["lon"] + (q["lon"] - p["lon"]) * t).alias("lon"), (p["lat"] + (q["lat"] - p["lat"]) * t).alias("lat"))
            end = F.struct(q["lon"].alias("lon"), q["lat"].alias("lat"))
            enters, kept = (p["s"] >= 0) != (q["s"] >= 0), q["s"] >= 0
            return F.when(enters & kept, F.array(cut, end)).when(enters, F.array(cut)).when(kept, F.array(end)).otherwise(none)

        turned = F.concat(F.slice(poly, F.lit(2), F.greatest(F.lit(0), F.size(poly) - 1)), F.slice(poly, F.lit(1), F.lit(1)))
        return F.flatten(F.zip_with(F.transform(poly, tagged), F.transform(turned, tagged), leg))

    g = c(subject)
    return F.aggregate(geo.steps(convex), F.slice(g, F.lit(1), F.size(g) - 1), clip)


def overlap_area(subject, convex) -> Column:
    """Area of the overlap in squared degrees."""
    part = clip_to_ring(subject, convex)
    return F.coalesce(F.abs(geo.ring_area2(F.concat(part, F.slice(part, 1, 1)))) / 2.0, F.lit(0.0))


def _clipped_area(subject: list[tuple[float, float]], convex: list[tuple[float, float]]) -> float:
    """Area of the part of a ring inside a convex counter-clockwise ring, by the steps of `clip_to_ring`."""
    part = subject[:-1]
    for (ax, ay), (bx, by) in zip(convex, convex[1:]):
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in part]
        left, part = part, []
        for i, s in enumerate(sides):
            j = i + 1 if i + 1 < len(sides) else 0
            if (s >= 0) != (sides[j] >= 0):
                t = s / (s - sides[j])
                part.append((left[i][0] + (left[j][0] - left[i][0]) * t, left[i][1] + (left[j][1] - left[i][1]) * t))
            if sides[j] >= 0:
                part.append(left[j])
    ox, oy = part[0] if part else (0.0, 0.0)
    return abs(sum((ax - ox) * (by - oy) - (ay - oy) * (bx - ox) for (ax, ay), (bx, by) in zip(part, part[1:] + part[:1]))) / 2.0


def with_overlap_area(pairs: DataFrame) -> DataFrame:
    """Adds `area`, the overlap of `ring` and the convex `tile_ring`, and drops both. As expressions, the fold over the edges would
    be interpreted, with every side of every point computed several times."""
    keep = [n for n in pairs.columns if n not in ("ring", "tile_ring")]
    schema = StructType([*pairs.select(*keep).schema.fields, StructField("area", DoubleType())])

    def points(rings) -> Iterator[list[tuple[float, float]]]:
        ends, flat = np.r_[0, np.cumsum(rings.value_lengths().to_numpy(zero_copy_only=False))].astype(int), rings.flatten()
        at = list(zip(flat.field("lon").to_pylist(), flat.field("lat").to_pylist()))
        return (at[a:b] for a, b in zip(ends, ends[1:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = [_clipped_area(s, t) for s, t in zip(points(batch.column("ring")), points(batch.column("tile_ring")))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(areas, pa.float64())], names=[*keep, "area"])

    return pairs.mapInArrow(run, schema)


# Resolutions of the pyramid that `nearest_node` descends; the lattice has under a thousand cells at the first.
NEAREST_LEVELS = (1, 3, 5, 6, 7)


def _gap2(a_low, a_high, b_low, b_high) -> Column:
    """Squared smallest distance of two intervals."""
    d = F.greatest(c(a_low) - c(b_high), c(b_low) - c(a_high), F.lit(0.0))
    return d * d


def _span2(a_low, a_high, b_low, b_high) -> Column:
    """Squared largest distance of two intervals."""
    d = F.greatest(c(a_high) - c(b_low), c(b_high) - c(a_low))
    return d * d


def _box(south="s", north="n", west="w", east="e") -> list[Column]:
    return [F.min(south).alias("s"), F.max(north).alias("n"), F.min(west).alias("w"), F.max(east).alias("e")]


BOX = ["s", "n", "w", "e"]


def _axial_key(q, r) -> Column:
    """One number for a lattice position."""
    return (c(q) + (1 << 30)) * (1 << 32) + (c(r) + (1 << 30))


def _keyed(df: DataFrame, y: str | Column, x: str | Column, grid: HexGrid, res: int, name: str) -> DataFrame:
    """Adds the lattice position of a point as a number; named steps, since the rounding repeats its input."""
    out = df.withColumns({"__ky": c(y), "__kx": c(x)})
    q, r = grid.axial("__ky", "__kx", res)
    return out.withColumns({"__q": q, "__r": r}).withColumn(name, _axial_key("__q", "__r")).drop("__q", "__r", "__ky", "__kx")


def _pyramid(boxes: DataFrame, grid: HexGrid, levels: tuple[int, ...]) -> list[DataFrame]:
    """From the boxes of the finest cells (k, s, n, w, e): per level, cells with their box (k, s, n, w, e, up). `up` is the cell
    of the level above that has the middle of the box, so every cell lies below one other; 0 at the first."""
    out = [boxes]
    for res in levels[-2::-1]:
        out[0] = _keyed(out[0], (F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2, grid, res, "up")
        out.insert(0, shared(out[0].groupBy(F.col("up").alias("__k")).agg(*_box())))
    out[0] = out[0].withColumn("up", F.lit(0).cast("bigint"))
    return out


def _family(level: DataFrame, name: str) -> DataFrame:
    """The cells below each cell as one list; the lattice bounds its length."""
    return level.groupBy("up").agg(F.collect_list(F.struct("__k", *BOX)).alias(name))


def _candidates(box: Column, lists: Column) -> Column:
    """The cells of a list with the least distance and the worst case of their nearest node, for the points of a box."""
    return F.transform(lists, lambda x: F.struct(
        x["__k"].alias("__k"), *[x[b].alias(b) for b in BOX], (_gap2(box["s"], box["n"], x["s"], x["n"]) + _gap2(box["w"], box["e"], x["w"], x["e"])).alias("low"),
        (_span2(box["s"], box["n"], x["s"], x["n"]) + _span2(box["w"], box["e"], x["w"], x["e"])).alias("high")))


def _within_reach(met: str) -> Column:
    """Of the cells with their bounds, those that are not farther than the worst case of some other one."""
    # Bound to a variable, the reach is computed once for a list, not for each of its cells.
    reach = F.array(F.array_min(F.transform(met, lambda x: x["high"])))
    return F.element_at(F.transform(reach, lambda r: F.filter(met, lambda x: x["low"] <= r * (1 + TOUCH) + TOUCH * TOUCH)), 1)


def nearest_node(points: DataFrame, nodes: DataFrame, grid: HexGrid, key: str, levels: tuple[int, ...] = NEAREST_LEVELS) -> DataFrame:
    """Nearest node by squared degrees: (key, node_id, distance2), ties to the smaller node id; without a column node_id in
    `nodes` only (key, distance2), and the nodes travel without ids. A node may be given twice.

    Nodes form a pyramid of cells, each with the tight box of its nodes, and so do the points. Both descend together: a cell of
    points knows the few cells of nodes that can hold a nearest one; a level below, each of its cells keeps those of their
    cells that are no farther than the worst case of some other. Lists of cells travel by the cell of points above, so the
    last level moves one row for each coarse cell, and pairs are made in place. At the end each point keeps the finest cells
    that can hold its own nearest node. Nodes are dealt once, by their finest cell.
    """
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def placed(df: DataFrame) -> DataFrame:
        return _keyed(df.where("__y IS NOT NULL AND __x IS NOT NULL"), "__y", "__x", grid, levels[-1], "__k")

    def boxed(df: DataFrame) -> list[DataFrame]:
        return _pyramid(shared(df.groupBy("__k").agg(*_box("__y", "__y", "__x", "__x"))), grid, levels)

    carried = [n for n in ("node_id",) if n in nodes.columns]
    # A crowded cell is shared by several tasks; the points of a cell, which are few, are copied to them.
    dealt = placed(nodes.select(*carried, F.col("lat").alias("__y"), F.col("lon").alias("__x")))
    dealt = shared(dealt.withColumn("__salt", F.pmod(F.xxhash64("__y", "__x"), F.lit(SALTS))).repartition(tasks, "__k", "__salt"))
    above = boxed(dealt)
    asked = placed(points.select(key, F.col("lat").alias("__y"), F.col("lon").alias("__x")))
    groups = boxed(asked)
    front = None
    for cells_, own in zip(above, groups):
        family = _family(cells_, "below")
        if front is None:
            # The first level is bounded by the lattice.
            lists = family.select(F.lit(0).cast("bigint").alias("up"), "below")
        else:
            lists = front.select("__k", F.explode("kept").alias("open")).select("__k", F.col("open.__k").alias("open")).join(family.withColumnRenamed("up", "open"), "open")
            # Bounds cost far more than the bytes of the lists suggest, so the partition count is fixed, not coalesced by size.
            lists = lists.groupBy(F.col("__k").alias("up")).agg(F.flatten(F.collect_list("below")).alias("below")).repartition(tasks, "up")
        met = _family(own, "own").repartition(tasks, "up").join(F.broadcast(lists) if front is None else lists.hint("merge"), "up").select("below", F.explode("own").alias("o"))
        front = met.select(F.col("o.__k").alias("__k"), _candidates(F.col("o"), F.col("below")).alias("met")).select("__k", _within_reach("met").alias("kept"))
    # Each point looks at the boxes of its cell's candidates again from its own place.
    last = front.select("__k", F.col("kept").alias("below"))
    here = F.struct(F.col("__y").alias("s"), F.col("__y").alias("n"), F.col("__x").alias("w"), F.col("__x").alias("e"))
    near = salted_join(asked, last, "__k", by=[key]).select(key, "__y", "__x", _candidates(here, F.col("below")).alias("met"))
    wanted = near.select(key, F.col("__y").alias("__py"), F.col("__x").alias("__px"), F.explode(F.transform(_within_reach("met"), lambda x: x["__k"])).alias("__k"))
    wanted = wanted.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))).repartition(tasks, "__k", "__salt")
    dy, dx = F.col("__y") - F.col("__py"), F.col("__x") - F.col("__px")
    best = wanted.join(dealt, ["__k", "__salt"]).withColumn("d2", dy * dy + dx * dx).groupBy(key).agg(F.min(F.struct("d2", *carried)).alias("b"))
    return best.select(key, *[F.col(f"b.{n}").alias(n) for n in carried], F.col("b.d2").alias("distance2"))
