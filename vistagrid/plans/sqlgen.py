"""Pieces of check SQL (DuckDB dialect) shared by several queries. Never used by the Spark plans."""

from __future__ import annotations

import math

from vistagrid.functions import catalog
from vistagrid.functions.cells import ROOT3, TWIST
from vistagrid.sources.fixtures import GRID


def u(x: str, default: str = "0e0") -> str:
    return f"greatest(0e0, least(1e0, coalesce({x}, {default})))"


def cl(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def hav(lat1, lon1, lat2, lon2, r="6371000e0") -> str:
    a = (f"(sin(radians({lat2} - ({lat1})) / 2) ** 2 + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"sin(radians({lon2} - ({lon1})) / 2) ** 2)")
    return f"(2 * {r} * atan2(sqrt({a}), sqrt(1 - {a})))"


def brg(lat1, lon1, lat2, lon2) -> str:
    y = f"sin(radians({lon2} - ({lon1}))) * cos(radians({lat2}))"
    x = (f"cos(radians({lat1})) * sin(radians({lat2})) - sin(radians({lat1})) * cos(radians({lat2})) * "
         f"cos(radians({lon2} - ({lon1})))")
    return f"((degrees(atan2({y}, {x})) + 360e0) % 360e0)"


def dest(lat, lon, b, d, r="6371000e0") -> tuple[str, str]:
    ad = f"(greatest(0e0, {d}) / {r})"
    p2 = f"asin(sin(radians({lat})) * cos({ad}) + cos(radians({lat})) * sin({ad}) * cos(radians({b})))"
    l2 = (f"degrees(radians({lon}) + atan2(sin(radians({b})) * sin({ad}) * cos(radians({lat})), "
          f"cos({ad}) - sin(radians({lat})) * sin({p2})))")
    return f"degrees({p2})", f"(CASE WHEN {l2} > 180 THEN {l2} - 360 WHEN {l2} < -180 THEN {l2} + 360 ELSE {l2} END)"


def axial(lat: str, lon: str, res: int, src: str, keep: str = "*") -> str:
    """SELECT that adds q and r of a point to the rows of `src`."""
    a, e = TWIST * (7 - res), GRID.edge(res)
    ca, sa = math.cos(a), math.sin(a)
    x, y = f"(({lon}) - ({GRID.lon0!r}e0))", f"((({lat}) - ({GRID.lat0!r}e0)) * {GRID.aspect!r}e0)"
    return f"""SELECT * EXCLUDE (fr, fq, rq, rr, rs),
        CAST(CASE WHEN abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs + fq + fr) THEN -rr - rs ELSE rq END AS BIGINT) AS cq,
        CAST(CASE WHEN NOT (abs(rq - fq) > abs(rr - fr) AND abs(rq - fq) > abs(rs + fq + fr)) AND abs(rr - fr) > abs(rs + fq + fr)
          THEN -rq - rs ELSE rr END AS BIGINT) AS cr
      FROM (SELECT *, floor(fq + 0.5e0) AS rq, floor(fr + 0.5e0) AS rr, floor(-fq - fr + 0.5e0) AS rs
        FROM (SELECT *, (({x}) * ({ca!r}e0) + ({y}) * ({sa!r}e0)) / ({e!r}e0) / ({ROOT3!r}e0) - fr / 2 AS fq
          FROM (SELECT {keep}, (({y}) * ({ca!r}e0) - ({x}) * ({sa!r}e0)) / ({e!r}e0) / 1.5e0 AS fr FROM {src}) a0) a1) a2"""


def cell_text(res: int, q="cq", r="cr") -> str:
    return f"concat({q}, ':', {r}, ':{res}')"


_on = "coalesce(scoring_version LIKE '3.%', false)"


def _res(comp: str, legacy: str) -> str:
    return f"CASE WHEN {_on} OR coalesce({comp}, 0e0) > 0 THEN {u(comp)} ELSE {cl(legacy)} END"


def components(src: str = "tiles") -> str:
    """SELECT of all tile columns plus the six components."""
    legacy_quiet = f"(1e0 - {u('road_density')} + {u('traffic_signal_score', '0.5e0')}) / 2"
    return f"""SELECT *, CASE WHEN {_on} THEN greatest(w0, greatest({cl(f"{u('water_visibility_score')} * 0.62e0 + {u('coastal_road_score')} * 0.26e0 + {u('water_crossing_score')} * 0.12e0")},
          {u('bridge_coastal_score')})) ELSE w0 END AS water,
        CASE WHEN {_on} AND {u('tree_canopy_score')} > 0 THEN greatest(g0, {cl(f"g0 * 0.65e0 + {u('tree_canopy_score')} * 0.35e0")}) ELSE g0 END AS greenery,
        CASE WHEN {_on} THEN {cl(f"s0 * 0.60e0 + (1 - {u('building_density_score')}) * 0.25e0 + {u('darkness_score')} * 0.10e0 + (1 - {u('road_stress_score')}) * 0.05e0")} ELSE s0 END AS solitude,
        CASE WHEN {_on} THEN greatest(p0, {u('overture_poi_score')}, {u('scenic_poi_score')}, {u('viewpoint_score')}) ELSE p0 END AS poi
      FROM (SELECT *, {_res('water_score', "coalesce(water_proximity, 0e0)")} AS w0, {_res('green_score', "coalesce(natural_land_use, 0e0)")} AS g0,
        {_res('elevation_score', "coalesce(elevation_variance, 0e0)")} AS elevation, {_res('solitude_score', legacy_quiet)} AS s0,
        {_res('curve_score', "coalesce(visual_complexity, 0e0)")} AS curves, {_res('poi_score', "coalesce(poi_density, 0e0)")} AS p0 FROM {src}) c0"""


def tile_score(weights: dict[str, str]) -> str:
    num = " + ".join(f"{k} * {w}" for k, w in weights.items())
    den = " + ".join(weights.values())
    boosted = f"least(1e0, {cl(f'({num}) / greatest(0.0001e0, {den})')} * (1 + {u('park_score')} * 0.30e0))"
    return (f"CASE WHEN {_on} THEN {cl(f'''{cl(f'{boosted} - ' + u('urban_penalty_score') + ' * 0.10e0')} - {u('road_stress_score')} * 0.06e0''')}"
            f" ELSE {boosted} END")


OPEN_SPACE = cl(f"solitude * 0.40e0 + (1 - {u('road_density')}) * 0.20e0 + (1 - {u('building_density_score')}) * 0.15e0 + "
                f"(1 - {u('urban_penalty_score')}) * 0.10e0 + (1 - {u('road_stress_score')}) * 0.10e0 + (1 - poi) * 0.05e0")
URBAN = f"({u('urban_penalty_score')} * 0.65e0 + {u('building_density_score')} * 0.25e0 + {u('road_density')} * 0.10e0)"


def values(rows, names: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, float):
            return f"{v!r}e0"
        return f"'{v}'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


def weight_of(vibe: str, component: str) -> float:
    w = dict(zip(catalog.COMPONENTS, catalog.VIBE_PROFILES[vibe][1]))
    w["viewpoint"], w["bridge_coastal"] = max(w["poi"], w["elevation"]), max(w["water"], w["poi"])
    w["tree_canopy"], w["open_space"] = max(w["greenery"], w["solitude"]), max(w["solitude"], w["curves"])
    return w[component]


def fit_rows(src: str) -> str:
    """SELECT cell-level rows (tile_key, cell, vibe, fit) by unpivoting targets and antis: a second formulation."""
    def value(comp):
        if comp == "open_space":
            return OPEN_SPACE
        return comp if comp in catalog.COMPONENTS else u(f"{comp}_score")

    def anti(comp):
        return comp if comp in ("poi", "curves") else u("road_density" if comp == "road_density" else f"{comp}_score")

    arms = []
    for vibe, (_, _, targets, antis, *_rest) in catalog.VIBE_PROFILES.items():
        num = " + ".join(f"{value(t)} * {weight_of(vibe, t)!r}e0" for t in targets)
        den = " + ".join(f"{weight_of(vibe, t)!r}e0" for t in targets)
        pen = f"{cl('(' + ' + '.join(anti(a) for a in antis) + f') / {len(antis)}e0')}" if antis else "0e0"
        arms.append(f"SELECT tile_key, cell, '{vibe}' AS vibe, {cl(f'{cl(f'({num}) / ({den})')} - {pen} * 0.24e0')} AS fit FROM {src}")
    return " UNION ALL ".join(arms)


def pt_seg(px, py, ax, ay, bx, by) -> str:
    n = f"(({bx} - {ax}) ** 2 + ({by} - {ay}) ** 2)"
    t = f"(CASE WHEN {n} > 0 THEN greatest(0e0, least(1e0, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / {n})) ELSE 0e0 END)"
    return f"sqrt(({ax} + {t} * ({bx} - {ax}) - {px}) ** 2 + ({ay} + {t} * ({by} - {ay}) - {py}) ** 2)"


def seg_seg() -> str:
    """Distance of segment (jx, jy)-(kx, ky) to (mx, my)-(nx, ny), columns of one row."""
    def side(a, b, p):
        return f"sign(({b}x - {a}x) * ({p}y - {a}y) - ({b}y - {a}y) * ({p}x - {a}x))"

    crossing = f"{side('j', 'k', 'm')} * {side('j', 'k', 'n')} < 0 AND {side('m', 'n', 'j')} * {side('m', 'n', 'k')} < 0"
    ends = ", ".join([pt_seg("jx", "jy", "mx", "my", "nx", "ny"), pt_seg("kx", "ky", "mx", "my", "nx", "ny"),
                      pt_seg("mx", "my", "jx", "jy", "kx", "ky"), pt_seg("nx", "ny", "jx", "jy", "kx", "ky")])
    return f"CASE WHEN {crossing} THEN 0e0 ELSE least({ends}) END"


def path_edges(name: str, src: str, key: str, path: str, n: int, first: str, second: str) -> str:
    """CTE with one row per edge of a path of n points, with its envelope."""
    items = ", ".join(f"{{'{first}x': {path}[{i}].lon, '{first}y': {path}[{i}].lat, '{second}x': {path}[{i + 1}].lon, '{second}y': {path}[{i + 1}].lat}}" for i in range(1, n))
    lons, lats = (", ".join(f"{path}[{i}].{k}" for i in range(1, n + 1)) for k in ("lon", "lat"))
    return (f"{name} AS (SELECT {key}, least({lons}) AS {name}_w, greatest({lons}) AS {name}_e, least({lats}) AS {name}_s, greatest({lats}) AS {name}_n, "
            f"{path}[1].lon AS {name}_lon, {path}[1].lat AS {name}_lat, unnest([{items}], recursive := true) FROM {src})")


def path_rect_pairs(left: str, right: str, keys: str, margin_deg: str, lon_scale: str, lat_scale: str, group: str) -> str:
    """SELECT of the smallest distance per key pair of a path and a filled axis-aligned rectangle."""
    return f"""SELECT {group}, min(CASE WHEN inside THEN 0e0 ELSE {seg_seg()} END) AS distance FROM (
      SELECT {keys}, {left}_lon >= {right}_w AND {left}_lon < {right}_e AND {left}_lat >= {right}_s AND {left}_lat < {right}_n AS inside,
        jx * {lon_scale} AS jx, jy * {lat_scale} AS jy, kx * {lon_scale} AS kx, ky * {lat_scale} AS ky,
        mx * {lon_scale} AS mx, my * {lat_scale} AS my, nx * {lon_scale} AS nx, ny * {lat_scale} AS ny
      FROM {left} JOIN {right} ON {left}_w <= {right}_e + {margin_deg} AND {left}_e >= {right}_w - {margin_deg}
        AND {left}_s <= {right}_n + {margin_deg} AND {left}_n >= {right}_s - {margin_deg}) GROUP BY {group}"""


def hexagon(src: str = "tiles") -> str:
    """SELECT with tile_key, cell and ring `hex` of seven points."""
    e = GRID.edge7
    pts = ", ".join(f"{{'lon': clon + ({e * math.cos(math.pi / 6 + i * math.pi / 3)!r}e0), 'lat': clat + ({e * math.sin(math.pi / 6 + i * math.pi / 3) / GRID.aspect!r}e0)}}"
                    for i in (0, 1, 2, 3, 4, 5, 0)).replace("e-17e0", "e-17").replace("e-18e0", "e-18")
    return (f"SELECT *, [{pts}] AS hex FROM (SELECT tile_key, cell, 0.0179e0 * sqrt(3e0) * (q + r / 2e0) - 80e0 AS clon, "
            f"1.5e0 * 0.0179e0 * r / sqrt(2e0) + 43e0 AS clat FROM {src})")


def pixels(band: str, src: str = "raster_tiles") -> str:
    return axial("lat", "lon", 7, f"""(SELECT raster_id, v, x0 + (i % width + 0.5e0) * dx AS lon, y0 - (i // width + 0.5e0) * dy AS lat FROM (
      SELECT raster_id, x0, y0, dx, dy, width, nodata, unnest({band}) AS v, generate_subscripts({band}, 1) - 1 AS i FROM {src}) WHERE v <> nodata) px""")
