"""Domain tables derived from the driver tables.

Each rule is one SQL text, rendered once for Spark and once for the DuckDB check, so both engines start from the
same rows. A text may name driver tables or other domain tables; `Dialect` supplies the few spellings that differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vistagrid.functions import catalog
from vistagrid.functions.cells import HexGrid

# Driver tables of few bytes whose rows stand for polygons and rasters.
COMPACT = {"supplier"}
GRID = HexGrid(lon0=-80.0, lat0=43.0)
E7 = "0.0179e0"


class Dialect:
    """SQL spelling of one engine."""

    def __init__(self, spark_dir: str | None = None, parts: int = 0, dealt: tuple[str, ...] = ()):
        self.spark_dir = spark_dir
        self.parts = parts
        self.dealt = COMPACT | {*dealt}

    @property
    def spark(self) -> bool:
        return self.spark_dir is not None

    def src(self, name: str) -> str:
        if name in RULES:
            return f"({render(name, self)})" if self.spark else name
        if not self.spark:
            return name
        file = f"parquet.`{self.spark_dir}/{name}.parquet`"
        # A file of few row groups is read by few tasks, while each of its rows may become hundreds; deal its rows first.
        return f"(SELECT /*+ REPARTITION({self.parts}) */ * FROM {file})" if name in self.dealt else file

    def micros(self, e: str) -> str:
        return f"unix_micros(CAST({e} AS TIMESTAMP))" if self.spark else f"epoch_us({e})"

    def pt(self, lon: str, lat: str) -> str:
        return f"named_struct('lon', {lon}, 'lat', {lat})" if self.spark else f"{{'lon': {lon}, 'lat': {lat}}}"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def pixels(self, expr: str, n: int) -> str:
        if self.spark:
            return f"transform(sequence(0, {n - 1}), i -> {expr})"
        return f"list_transform(range(0, {n}), lambda i: {expr})"

    def map(self, *pairs: tuple[str, str]) -> str:
        """String map whose null values mean `key absent`; built from at most a few fixed keys."""
        if self.spark:
            return "map_filter(map(%s), (k, v) -> v IS NOT NULL)" % ", ".join(f"'{k}', {v}" for k, v in pairs)
        return "map_from_entries(list_filter([%s], lambda e: e.v IS NOT NULL))" % ", ".join(
            f"{{'k': '{k}', 'v': {v}}}" for k, v in pairs)

    def date(self, e: str) -> str:
        return f"date_format({e}, 'yyyy-MM-dd')" if self.spark else f"strftime({e}, '%Y-%m-%d')"


def pick(index: str, values) -> str:
    """CASE lookup of a literal by position; None becomes null."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"(CASE {index} {arms} END)"


def _idiv(a: str, b) -> str:
    return f"CAST(floor({a} / {float(b)}e0) AS BIGINT)"


def _q(k: str) -> str:
    return f"({k} % 50 + 50 * {_idiv(k, 50000)})"


def _r(k: str) -> str:
    return f"({_idiv(k, 50)} % 1000)"


def _lon(k: str) -> str:
    return f"({E7} * sqrt(3e0) * ({_q(k)} + {_r(k)} / 2e0) - 80e0)"


def _lat(k: str) -> str:
    return f"(1.5e0 * {E7} * {_r(k)} / sqrt(2e0) + 43e0)"


def _cell(k: str) -> str:
    return f"concat(CAST({_q(k)} AS VARCHAR(20)), ':', CAST({_r(k)} AS VARCHAR(20)), ':7')"


PRIMES = [17, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113, 127, 131,
          137, 139]
VIBES = list(catalog.VIBES)
EVENT_NAMES = ["route_generate_clicked", "route_generate_submitted", "route_generation_completed",
               "route_generation_failed", "vibe_unavailable", "start_drive_clicked", "navigation_opened",
               "route_option_selected", "route_map_painted"]


def _tiles(d: Dialect) -> str:
    k = "p_partkey"
    scores = ", ".join(
        f"CASE WHEN {k} % {p} = 0 THEN 0e0 ELSE (({k} * {p} + {7 * i}) % 1009) / 1008e0 END AS {name}"
        for i, (name, p) in enumerate(zip(catalog.TILE_SCORES, PRIMES)))
    return f"""SELECT {k} AS tile_key, {_cell(k)} AS cell, {_q(k)} AS q, {_r(k)} AS r,
      round({_lon(k)}, 9) AS lon, round({_lat(k)}, 9) AS lat, {scores},
      1704067200000000 + {k} * 1000000 AS last_scored_us,
      CASE {k} % 4 WHEN 0 THEN '{catalog.VERSIONS["3.6"]}' WHEN 1 THEN '{catalog.VERSIONS["3.7"]}'
        WHEN 2 THEN '{catalog.VERSIONS["2.9"]}' END AS scoring_version
      FROM {d.src('part')}"""


ROAD_TYPES = [t for t, _ in catalog.ROAD_TYPE_STRESS] + ["ferry", None]
SURFACES = [t for t, _ in catalog.SURFACE_STRESS] + [None]


def _roads(d: Dialect) -> str:
    i = "(l_orderkey * 8 + l_linenumber)"
    lon, lat = _lon("l_partkey"), _lat("l_partkey")
    pts = [d.pt(f"round({lon} + (({i} % {m}) - {m // 2}) * {dx}e0, 7)", f"round({lat} + (({i} % {n}) - {n // 2}) * {dy}e0, 7)")
           for m, dx, n, dy in ((7, 0.0031, 5, 0.0027), (11, 0.0013, 3, 0.0049), (13, 0.0017, 9, 0.0011))]
    unique = f"({i} * 10000000 + (l_partkey * 7919 + CAST(round(l_extendedprice * 100e0) AS BIGINT)) % 10000000)"
    return f"""SELECT {unique} AS road_id, l_orderkey AS way_id, {_cell('l_partkey')} AS cell,
      l_extendedprice / 50e0 AS length_m, CAST(((l_orderkey + 13 * l_linenumber) % 13) * 10 AS INT) AS speed_kmh,
      {pick('l_partkey % 17', ROAD_TYPES)} AS road_type, {pick('l_partkey % 16', SURFACES)} AS surface,
      l_discount * 10e0 AS curvature, CASE WHEN l_orderkey % 5 = 0 THEN 0e0 ELSE l_tax * 1000e0 END AS elevation_change,
      {d.arr(*pts)} AS geom FROM {d.src('lineitem')}"""


CATEGORIES = [x[0] for x in catalog.SCENIC_PLACE_WEIGHTS] + ["restaurant", "gas_station", "tourist_attraction", "bank"]


def _places(d: Dialect) -> str:
    k = "c_custkey"
    return f"""SELECT {k} AS place_id, c_name AS name, {pick(f'{k} % 40', CATEGORIES)} AS category,
      CASE WHEN {k} % 11 = 0 THEN NULL ELSE ({k} * 37 % 101) / 100e0 END AS confidence,
      round({_lon(k)} + (({k} % 9) - 4) * 0.0021e0, 7) AS lon, round({_lat(k)} + (({k} % 7) - 3) * 0.0017e0, 7) AS lat,
      {d.map(('tourism', f"CASE WHEN {k} % 5 = 0 THEN 'viewpoint' END"),
             ('leisure', f"CASE WHEN {k} % 7 = 0 THEN 'park' END"),
             ('natural', f"CASE {k} % 6 WHEN 0 THEN 'peak' WHEN 1 THEN 'spring' WHEN 2 THEN 'tree' END"),
             ('amenity', f"CASE {k} % 4 WHEN 0 THEN 'camp_site' WHEN 1 THEN 'cafe' END"))} AS tags
      FROM {d.src('customer')}"""


def _buildings(d: Dialect) -> str:
    k = "o_custkey"
    return f"""SELECT o_orderkey AS building_id,
      CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE round({_lon(k)} + ((o_orderkey % 15) - 7) * 0.0019e0, 7) END AS lon,
      round({_lat(k)} + ((o_orderkey % 11) - 5) * 0.0013e0, 7) AS lat FROM {d.src('orders')}"""


def _square(d: Dialect, key: str, shift: str) -> str:
    lon, lat = f"({_lon(key)} + {shift})", f"({_lat(key)} + {shift})"
    half = "(0.005e0 + (s_suppkey % 5) * 0.005e0)"
    corner = [d.pt(f"round({lon} {a} {half}, 7)", f"round({lat} {b} {half}, 7)")
              for a, b in (("-", "-"), ("+", "-"), ("+", "+"), ("-", "+"), ("-", "-"))]
    return d.arr(*corner)


def _areas(d: Dialect) -> str:
    return f"SELECT s_suppkey AS area_id, {_square(d, 's_suppkey * 19', '0.0031e0')} AS ring FROM {d.src('supplier')}"


def _water(d: Dialect) -> str:
    return f"""SELECT s_suppkey AS water_id, {_square(d, '(s_suppkey * 17 + 5)', '0.0023e0')} AS ring,
      {d.map(('natural', "CASE s_suppkey % 5 WHEN 0 THEN 'water' WHEN 1 THEN 'bay' WHEN 2 THEN 'cliff' END"),
             ('water', "CASE WHEN s_suppkey % 4 = 0 THEN 'lake' END"),
             ('waterway', "CASE WHEN s_suppkey % 6 = 0 THEN 'riverbank' END"),
             ('landuse', "CASE s_suppkey % 3 WHEN 0 THEN 'reservoir' WHEN 1 THEN 'forest' END"))} AS tags
      FROM {d.src('supplier')}"""


def _lines(d: Dialect) -> str:
    k = "(s_suppkey * 13 + 3)"
    a = d.pt(f"round({_lon(k)} - 0.01e0, 7)", f"round({_lat(k)} + 0.001e0, 7)")
    b = d.pt(f"round({_lon(k)} + 0.012e0, 7)", f"round({_lat(k)} - 0.002e0, 7)")
    return f"""SELECT s_suppkey AS line_id, {d.arr(a, b)} AS geom,
      {d.map(('bridge', "CASE s_suppkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN '' END"),
             ('waterway', "CASE WHEN s_suppkey % 3 = 0 THEN 'river' END"),
             ('ford', "CASE WHEN s_suppkey % 7 = 0 THEN 'yes' END"),
             ('tunnel', "CASE WHEN s_suppkey % 8 = 0 THEN 'yes' END"))} AS tags
      FROM {d.src('supplier')}"""


def _raster(d: Dialect) -> str:
    k = "(s_suppkey * 11 + 2)"
    n = "s_suppkey"
    return f"""SELECT s_suppkey AS raster_id, round({_lon(k)} - 0.03e0, 7) AS x0, round({_lat(k)} + 0.03e0, 7) AS y0,
      0.004e0 AS dx, 0.004e0 AS dy, 16 AS width, 16 AS height, 0e0 AS nodata,
      {d.pixels(f"(({n} * 31 + 7 * i) % 20) * 1e0", 256)} AS landcover,
      {d.pixels(f"CASE WHEN ({n} + i) % 23 = 0 THEN 0e0 ELSE 20e0 + (({n} * 17 + i * 13) % 487) END", 256)} AS elevation,
      {d.pixels(f"(({n} * 7 + i * 3) % 131) * 1e0", 256)} AS light
      FROM {d.src('supplier')}"""


def _traffic(d: Dialect) -> str:
    return f"""SELECT {_cell('user_id')} AS cell, (event_id % 101) / 100e0 AS traffic_score,
      {d.micros('ts')} AS ts_us, event_id FROM {d.src('events')}"""


def _traffic_raw(d: Dialect) -> str:
    return f"""SELECT CASE WHEN event_id % 29 = 0 THEN '  ' ELSE {_cell('user_id')} END AS cell_text,
      CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 31 = 0 THEN '1.7'
        ELSE concat('0.', CAST(10 + event_id % 90 AS VARCHAR(20))) END AS score_text, event_id
      FROM {d.src('events')}"""


def _light_samples(d: Dialect) -> str:
    k = "p_partkey"
    return f"""SELECT {_cell(k)} AS cell, ({k} * 13 % 140) * 1e0 AS raw_value,
      CASE WHEN {k} % 9 = 0 THEN 0.5e0 ELSE ({k} * 29 % 1009) / 1008e0 END AS darkness_score
      FROM {d.src('part')} WHERE {k} % 3 <> 0"""


def _vibe_at(e: str) -> str:
    return pick(e, VIBES)


def _vibes_json(key: str) -> str:
    a, b, c = _vibe_at(f"({key} % 9)"), _vibe_at(f"(({key} + 4) % 9)"), _vibe_at(f"(({key} * 2 + 1) % 9)")
    return f"""(CASE {key} % 3 WHEN 0 THEN concat('["', {a}, '"]') WHEN 1 THEN concat('["', {a}, '","', {b}, '"]')
      ELSE concat('["', {a}, '","', {b}, '","', {c}, '"]') END)"""


def _requests(d: Dialect) -> str:
    k = "o_orderkey"
    raw = [" Coastal ", "Sunday Drive", "WINDING", "quiet", "photo-op", "unknown vibe", "open roads", "Nature", "&hide&"]
    return f"""SELECT {k} AS request_id, o_custkey AS user_id, {d.micros('o_orderdate')} AS created_us,
      round({_lat('o_custkey')} + (({k} % 5) - 2) * 0.0011e0, 7) AS lat,
      round({_lon('o_custkey')} + (({k} % 3) - 1) * 0.0012e0, 7) AS lon,
      CAST(15 + {k} % 226 AS INT) AS budget, {pick(f'{k} % 4', ['drive', 'cycle', ' Drive ', None])} AS route_mode,
      CASE WHEN {k} % 23 = 0 THEN NULL WHEN {k} % 29 = 0 THEN 'not json'
        WHEN {k} % 31 = 0 THEN concat('["', {pick(f'{k} % 9', raw)}, '","coastal",null,""]')
        ELSE {_vibes_json(k)} END AS vibes_json,
      {pick(f'{k} % 9', raw)} AS vibe,
      CASE WHEN {k} % 3 = 0 THEN NULL WHEN {k} % 37 = 0 THEN '{{broken'
        ELSE concat('{{"Water":', CAST(({k} % 150) / 100e0 AS VARCHAR(20)), ',"curve":"0.', CAST(10 + {k} % 80 AS VARCHAR(20)),
          '","scenery":"high","solitude ":', CAST(({k} % 7) / 8e0 AS VARCHAR(20)), '}}') END AS preferences_json,
      {pick(f'{k} % 10', ['queued', 'processing', 'completed', 'failed', 'completed', 'unavailable', 'queued', 'completed', 'cancelled', 'completed'])} AS status
      FROM {d.src('orders')}"""


def _trip_requests(d: Dialect) -> str:
    k = "c_custkey"
    return f"""SELECT {k} AS request_id, round({_lat(k)} + ({k} % 3 - 1) * 0.002e0, 7) AS lat, round({_lon(k)} + ({k} % 5 - 2) * 0.002e0, 7) AS lon,
      CAST(15 + {k} % 60 AS INT) AS budget, {_vibes_json(k)} AS vibes_json FROM {d.src('customer')}"""


def _candidates(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""SELECT {k} AS candidate_id, o_custkey AS request_id,
      CAST(30 + o_custkey % 150 AS INT) AS target_minutes,
      {pick('o_custkey % 6', catalog.STRATEGIES)} AS strategy,
      concat('sig', CAST({k} % 41 AS VARCHAR(20))) AS signature,
      CASE WHEN o_custkey % 13 = 0 THEN 0.5e0 ELSE ({k} * 61 % 997) / 996e0 END AS score,
      CAST(10 + ({k} * 37) % 190 AS INT) AS minutes, 2e0 + ({k} * 17 % 811) / 10e0 AS km,
      ({k} * 43 % 101) / 100e0 AS mean_turn, ({k} * 29 % 89) / 200e0 AS backtracking_penalty,
      CASE WHEN {k} % 19 = 0 THEN NULL ELSE ({k} * 53 % 103) / 102e0 END AS strategy_fit_score,
      ({k} * 59 % 107) / 106e0 AS strategy_mismatch_penalty,
      CASE WHEN {k} % 17 = 0 THEN NULL ELSE ({k} * 67 % 109) / 108e0 END AS corridor_urban_pressure,
      ({k} * 71 % 113) / 112e0 AS urban_penalty, ({k} * 73 % 127) / 126e0 AS curve_elevation_corridor_share,
      ({k} * 79 % 131) / 130e0 AS open_space_corridor_share, ({k} * 83 % 137) / 136e0 AS quiet_corridor_share,
      {_vibes_json('o_custkey')} AS vibes_json
      FROM {d.src('orders')}"""


def _routes(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""SELECT {k} AS route_id, o_custkey AS job_id, {d.micros('o_orderdate')} AS created_us,
      {pick(f'{k} % 5', ['MOST_SCENIC', 'balanced', ' shorter', 'other', None])} AS route_profile,
      ({k} * 61 % 997) / 996e0 AS score, CAST(10 + {k} * 37 % 190 AS INT) AS minutes, 2e0 + ({k} * 17 % 811) / 10e0 AS km,
      CASE WHEN {k} % 7 = 0 THEN NULL WHEN {k} % 11 = 0 THEN 'oops'
        ELSE concat('{{"final_score":', CAST(({k} % 8) / 8e0 AS VARCHAR(20)), ',"note":"x","vibe_fit_score":',
          CAST(({k} % 5) / 4e0 AS VARCHAR(20)), '}}') END AS breakdown_json
      FROM {d.src('orders')}"""


def _ranked_events(d: Dialect) -> str:
    """Dense position of each event of a user by (ts, event_id): rank inside an hour plus the rows of earlier hours,
    so that no user is ever sorted in one task."""
    return f"""SELECT e.event_id, e.user_id, e.ts_us, h.before + e.rn - 1 AS seq, h.total
      FROM (SELECT event_id, user_id, {d.micros('ts')} AS ts_us, date_trunc('hour', ts) AS hr,
              row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn
            FROM {d.src('events')}) e
      JOIN (SELECT user_id, hr,
              CAST(sum(n) OVER (PARTITION BY user_id ORDER BY hr) AS BIGINT) - n AS before,
              CAST(sum(n) OVER (PARTITION BY user_id) AS BIGINT) AS total
            FROM (SELECT user_id, date_trunc('hour', ts) AS hr, count(*) AS n FROM {d.src('events')} GROUP BY 1, 2) x) h
        ON e.user_id = h.user_id AND e.hr = h.hr"""


def _route_points(d: Dialect) -> str:
    return f"""SELECT user_id AS route_id, seq, total AS n_points,
      round(43.5e0 + (0.05e0 + 0.01e0 * (user_id % 7)) * sin(6.283185307179586e0 * seq / total) + (event_id % 10) * 0.0005e0, 6) AS lat,
      round(-79.5e0 + (0.07e0 + 0.01e0 * (user_id % 5)) * cos(6.283185307179586e0 * seq / total), 6) AS lon
      FROM {d.src('ranked_events')} x"""


def _trips(d: Dialect) -> str:
    g = "CAST(floor(user_id / 3e0) AS BIGINT)"
    return f"""SELECT user_id AS route_id, {g} AS request_id, user_id % 3 AS option_no,
      {pick('user_id % 3', catalog.PROFILES)} AS route_profile,
      CAST(40 + {g} * 7 % 120 AS INT) AS target_minutes, CAST(35 + (user_id * 11) % 130 AS INT) AS minutes,
      8e0 + (user_id * 17 % 311) / 10e0 AS km, {_vibes_json(g)} AS vibes_json,
      {pick(f'{g} % 6', catalog.STRATEGIES)} AS strategy,
      0.2e0 + ({g} % 9) / 10e0 AS w_water, 0.25e0 + ({g} % 7) / 10e0 AS w_greenery, 0.1e0 + ({g} % 8) / 10e0 AS w_elevation,
      0.3e0 + ({g} % 6) / 10e0 AS w_solitude, 0.15e0 + ({g} % 5) / 10e0 AS w_curves, 0.05e0 + ({g} % 4) / 10e0 AS w_poi
      FROM (SELECT DISTINCT user_id FROM {d.src('events')}) x"""


def _analytics_events(d: Dialect) -> str:
    k = "event_id"
    return f"""SELECT {k} AS event_id, {pick(f'{k} % 9', EVENT_NAMES)} AS event_name, user_id,
      concat('client-', CAST(user_id AS VARCHAR(20))) AS client_id,
      CASE WHEN {k} % 5 = 0 THEN NULL ELSE CAST(round(value * 100e0) AS BIGINT) END AS duration_ms,
      CASE WHEN {k} % 7 = 0 THEN NULL ELSE CAST({k} % 400 AS INT) END AS time_budget_minutes,
      CASE WHEN {k} % 6 = 0 THEN NULL ELSE concat('grid:', CAST(43 + user_id % 4 AS VARCHAR(20)), '.5:-79.0') END AS region_key,
      {pick(f'{k} % 5', ['drive', 'cycle', 'drive', None, 'walk'])} AS route_mode,
      {pick(f'{k} % 4', ['most_scenic', 'balanced', 'shorter', None])} AS route_profile,
      CASE WHEN {k} % 8 = 0 THEN NULL ELSE CAST({k} % 5 AS INT) END AS route_count,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE ({k} * 61 % 997) / 996e0 END AS scenic_score,
      CASE WHEN {k} % 10 = 0 THEN NULL ELSE {_vibes_json(k)} END AS vibes_json,
      {d.micros('ts')} AS created_us, {d.date('ts')} AS day
      FROM {d.src('events')}"""


def _raw_events(d: Dialect) -> str:
    k = "event_id"
    names = [" Route_Generate_Clicked ", "route_generate_submitted", "NAVIGATION_OPENED", "bogus_event", "theme_toggled",
             None, "gpx_exported"]
    vibes = ['["Coastal","River"]', '["winding","twisty"]', '["coastal","mountain","relaxing","nature"]', '["not a vibe"]', None, '[]']
    return f"""SELECT {k} AS event_id, {pick(f'{k} % 7', names)} AS event_name, {pick(f'{k} % 6', vibes)} AS vibes_json,
      CASE WHEN {k} % 3 = 0 THEN '   ' ELSE concat(' Client-', CAST(user_id AS VARCHAR(20)), ' ') END AS client_id,
      concat('session-', CAST(user_id AS VARCHAR(20))) AS session_id,
      CASE {k} % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' GRID:43.5:-79.0 '
        ELSE concat('Region-', '0123456789012345678901234567890123456789', CAST(user_id AS VARCHAR(20))) END AS region_key,
      {pick(f'{k} % 5', [' Drive ', 'CYCLE', None, '', 'walk'])} AS route_mode,
      CAST({k} % 420 - 10 AS INT) AS time_budget_minutes,
      CASE WHEN {k} % 13 = 0 THEN '{{"a":{{"b":{{"c":{{"d":1}}}}}}}}' WHEN {k} % 13 = 1 THEN '{{"k":[1,2,{{"x":null}}],"t":true}}'
        WHEN {k} % 13 = 2 THEN NULL ELSE props END AS metadata_json
      FROM {d.src('events')}"""


def _ratings(d: Dialect) -> str:
    k = "o_orderkey"
    t = catalog.FEEDBACK_TAGS
    return f"""SELECT {k} AS rating_id, {d.micros('o_orderdate')} AS rated_us, CAST(1 + {k} % 5 AS INT) AS rating,
      {_vibe_at(f'({k} % 9)')} AS vibe,
      CASE WHEN {k} % 4 = 0 THEN '' WHEN {k} % 4 = 1 THEN {pick(f'{k} % 11', t)}
        ELSE concat({pick(f'{k} % 11', t)}, '|', {pick(f'({k} * 3 + 2) % 11', t)}, '|', ' Loved-Water ', '|nonsense|loved curves') END AS tags_text,
      ({k} * 7 % 11) / 10e0 AS water, ({k} * 13 % 17) / 16e0 AS greenery, ({k} * 5 % 7) / 6e0 AS elevation,
      ({k} * 19 % 23) / 22e0 AS solitude, ({k} * 3 % 13) / 12e0 AS curves, ({k} * 11 % 29) / 28e0 AS poi
      FROM {d.src('orders')}"""


def _duration_observations(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""SELECT {k} AS route_id, {pick(f'{k} % 2', ['drive', 'cycle'])} AS route_mode,
      {_lat('o_custkey')} AS lat, {_lon('o_custkey')} AS lon, {pick(f'{k} % 6', catalog.STRATEGIES)} AS strategy,
      CAST(15 + {k} % 60 AS INT) AS target_minutes, CAST(({k} * 37) % 150 AS INT) AS duration_minutes,
      CASE WHEN {k} % 14 = 0 THEN NULL ELSE ({k} * 7 % 101) / 9e0 END AS radius_km, CAST({k} % 9 AS INT) AS waypoint_count
      FROM {d.src('orders')}"""


def _weight_calibrations(d: Dialect) -> str:
    means = ", ".join(f"greatest(0.7e0, least(1.3e0, round(avg({k}) + {0.3 + 0.07 * i}e0, 6))) AS m_{k}"
                      for i, k in enumerate(catalog.COMPONENTS))
    return f"SELECT vibe, {means} FROM {d.src('ratings')} x WHERE vibe NOT IN ('mountain', 'relaxing') GROUP BY vibe"


def _lifecycle(d: Dialect) -> str:
    return f"""SELECT user_id AS job_id, event_id, ts_us,
      CASE WHEN event_id % 13 = 0 AND seq > 0 THEN seq - 1 WHEN event_id % 17 = 0 AND seq > 2 THEN seq - 2 ELSE seq END AS state_rev,
      event_id % 4 AS option_rev,
      {pick('seq % 7', ['queued', 'processing', 'retry', 'processing', 'primary_ready', 'progress', 'completed'])} AS status,
      seq FROM {d.src('ranked_events')} x"""


JOB_EVENT_KINDS = ["claim", "primary", "release", "claim", "bogus", " Claim ", "expire", "claim", "primary", "release", "claim", "transient_failure", "claim", "primary", "release",
                   "claim", "primary", "claim", "release", "claim", "complete", "claim", "release", "primary", "claim", "release", "claim", "primary", "claim", "release", "transient_failure",
                   "claim", "primary", "release", "claim", "permanent_failure", "claim", "release", "primary", None, "claim"]


def _job_events(d: Dialect) -> str:
    return f"""SELECT user_id AS job_id, event_id, ts_us AS at_us, {pick('(event_id * 7 + seq) % 41', JOB_EVENT_KINDS)} AS kind FROM {d.src('ranked_events')} x"""


def _job_limits(d: Dialect) -> str:
    return f"""SELECT user_id AS job_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(user_id % 7 - 1 AS INT) END AS max_retries
      FROM (SELECT DISTINCT user_id FROM {d.src('events')} WHERE user_id % 19 <> 0) x"""


def _jobs(d: Dialect) -> str:
    k = "o_orderkey"
    return f"""SELECT {k} AS job_id, {d.micros('o_orderdate')} AS submitted_us,
      {d.micros('o_orderdate')} + ({k} % 50) * 1000000 AS started_us,
      CASE WHEN {k} % 4 = 0 THEN NULL ELSE {d.micros('o_orderdate')} + (60 + {k} % 300) * 1000000 END AS completed_us,
      CASE WHEN {k} % 3 = 0 THEN NULL ELSE {d.micros('o_orderdate')} + (55 + {k} % 200) * 1000000 END AS primary_us,
      CASE WHEN {k} % 7 = 0 THEN NULL ELSE {d.micros('o_orderdate')} + ({k} % 97) * 1000000 END AS lease_us,
      CASE WHEN {k} % 6 <> 0 THEN {d.micros('o_orderdate')} + ({k} % 89) * 1000000 END AS dispatch_lease_us,
      {pick(f'{k} % 5', ['QUEUED', 'PROCESSING', 'COMPLETED', 'FAILED', 'PRIMARY_READY'])} AS status,
      CAST({k} % 4 AS INT) AS option_count, {pick(f'{k} % 2', ['drive', 'cycle'])} AS route_mode,
      {pick(f'{k} % 6', catalog.STRATEGIES)} AS strategy,
      CASE WHEN {k} % 9 = 0 THEN NULL ELSE {d.micros('o_orderdate')} + ({k} % 211) * 1000000 END AS available_us,
      CASE WHEN {k} % 5 = 0 THEN {d.micros('o_orderdate')} END AS sent_us, CAST({k} % 9 AS INT) AS attempts
      FROM {d.src('orders')}"""


def _eval_scenarios(d: Dialect, run: int) -> str:
    k = "c_custkey"
    return f"""SELECT {k} AS scenario_id, CASE WHEN ({k} + {run}) % 9 = 0 THEN 'FAILED' WHEN ({k} + {run}) % 31 = 0 THEN NULL ELSE 'COMPLETED' END AS status,
      {pick(f'{k} % 4', ['No strong water nearby', 'No scenic data found here', None, 'timed out'])} AS failure_reason, CAST(20 + {k} % 140 AS INT) AS budget,
      CASE WHEN {k} % 6 = 0 THEN NULL ELSE ({k} * 29 % 101) / 50e0 END AS min_separation_km, {_vibes_json(k)} AS vibes_json FROM {d.src('customer')} WHERE {k} % 17 <> {run + 3}"""


def _eval_options(d: Dialect, run: int) -> str:
    k = "c_custkey"
    out = []
    for i, profile in enumerate(catalog.PROFILES):
        x = f"({k} * 3 + {i} + {run * 5})"
        points = [d.pt(f"round({_lon(k)} + {0.01 * (j + i)}e0 + ({x} % 7) * 0.0011e0, 6)", f"round({_lat(k)} + {0.004 * j * j}e0 - ({x} % 5) * 0.0017e0, 6)") for j in range(5)]
        score = f"({x} * 61 % 101) / 100e0"
        lead = pick(f"CAST(floor({k} / 2e0) AS BIGINT) % 3", ["water", "curves", None]) if i == 0 else f"CASE WHEN {k} % 5 = 0 THEN 'water' WHEN {k} % 5 = 1 THEN 'curves' ELSE {pick(f'{x} % 3', ['water', 'poi', 'curves'])} END"
        out.append(f"""SELECT {k} AS scenario_id, {i} AS option_no, {x} AS route_id, '{profile}' AS profile, CASE WHEN {x} % 11 = 0 THEN NULL ELSE CAST(8 + ({k} * 13 + {i * 9} * ({k} % 2)) % 190 AS INT) END AS duration_minutes,
          CASE WHEN {x} % 13 = 0 THEN NULL WHEN {k} % 4 = 0 THEN 40e0 + {i} * ({k} % 3) WHEN {k} % 4 = 1 THEN 0.5e0 + {i} * 0.01e0 ELSE {score} END AS scenic_score, CASE WHEN {x} % 19 = 0 THEN NULL ELSE {score} END AS final_score,
          {pick(f'{x} % 23', ['old_planner', '', None, 'other'] + ['planner_v2'] * 19)} AS algorithm, CASE WHEN {x} % 7 = 0 THEN NULL ELSE ({x} * 17 % 97) / 96e0 END AS strategy_fit, ({x} * 37 % 89) / 88e0 AS strategy_mismatch,
          CASE WHEN {x} % 29 = 0 THEN NULL ELSE {x} % 31 <> 0 END AS has_explanation, {pick(f'{x} % 5', ['loop_closure', 'quiet_share_ok|loop_closure', '', None, 'water_share_ok'])} AS failed_text, {lead} AS lead_part,
          CASE WHEN {x} % 14 = 0 THEN NULL ELSE ({x} * 7 % 53) / 90e0 END AS avg_a, ({x} * 11 % 59) / 80e0 AS avg_b, ({x} * 5 % 41) / 400e0 - 0.05e0 AS lift_a, CASE WHEN {x} % 3 = 0 THEN NULL ELSE ({x} * 3 % 43) / 300e0 END AS share_a,
          2e0 + ({x} * 19 % 311) / 10e0 AS distance_km, ({x} * 23 % 71) / 70e0 AS scenic_poi, CASE WHEN {x} % 10 = 0 THEN NULL ELSE ({x} * 31 % 67) / 66e0 END AS water_share, ({x} * 41 % 61) / 60e0 AS photo_peak,
          ({x} * 43 % 47) / 46e0 AS backtracking, CASE WHEN {x} % 8 = 0 THEN NULL ELSE ({x} * 47 % 37) / 36e0 END AS viewpoint, ({x} * 53 % 31) / 30e0 AS bridge_coastal,
          concat('leads with ', coalesce({lead}, 'nothing')) AS summary, CASE WHEN {x} % 21 = 0 THEN NULL ELSE {d.arr(*points)} END AS points
          FROM {d.src('customer')} WHERE {k} % 17 <> {run + 3} AND {k} % 16 <> {i} AND {k} % 20 <> 0""")
    return " UNION ALL ".join(out)


RULES: dict[str, Callable[[Dialect], str]] = {
    "tiles": _tiles, "roads": _roads, "places": _places, "buildings": _buildings, "areas": _areas, "water": _water,
    "hint_lines": _lines, "raster_tiles": _raster, "traffic": _traffic, "traffic_raw": _traffic_raw,
    "light_samples": _light_samples, "requests": _requests, "trip_requests": _trip_requests, "candidates": _candidates, "routes": _routes,
    "ranked_events": _ranked_events, "route_points": _route_points, "trips": _trips,
    "analytics_events": _analytics_events, "raw_events": _raw_events, "ratings": _ratings, "weight_calibrations": _weight_calibrations,
    "duration_observations": _duration_observations, "lifecycle": _lifecycle,
    "jobs": _jobs, "job_events": _job_events, "job_limits": _job_limits,
    "eval_scenarios": lambda d: _eval_scenarios(d, 0), "eval_options": lambda d: _eval_options(d, 0), "later_scenarios": lambda d: _eval_scenarios(d, 1), "later_options": lambda d: _eval_options(d, 1),
}
NEEDS = {"weight_calibrations": ["ratings"], "route_points": ["ranked_events"], "lifecycle": ["ranked_events"], "job_events": ["ranked_events"]}


def render(name: str, d: Dialect) -> str:
    return RULES[name](d)


def domain(spark: SparkSession, sf_dir: str, name: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Domain table `name` as a lazy DataFrame over the driver's parquet files; the rows of the files named in `dealt` are dealt to
    all tasks first, for plans that compute much from each of few rows."""
    return spark.sql(render(name, Dialect(sf_dir, int(spark.conf.get("spark.sql.shuffle.partitions")), dealt)))


def duck_ctes(*names: str) -> str:
    """`WITH` prefix that defines the named domain tables for DuckDB."""
    order: list[str] = []
    for name in names:
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    d = Dialect()
    return "WITH " + ",\n".join(f"{n} AS ({render(n, d)})" for n in order)
