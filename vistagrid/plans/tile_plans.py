"""Tile scoring queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vistagrid.functions import catalog, scoring, text
from vistagrid.operators.profiles import blend_profiles, effective_weights
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.scalar_plans import RESOLVED_VIBES
from vistagrid.sources.fixtures import domain

COMPONENTS = " ".join(catalog.COMPONENTS)
SCORED = f"scored AS ({q.components()})"


def scored_tiles(spark, sf):
    return scoring.component_scores(domain(spark, sf, "tiles"))


def literal_weights(values):
    return {k: F.lit(v) for k, v in zip(catalog.COMPONENTS, values)}


def sql_weights(values):
    return {k: f"{v!r}e0" for k, v in zip(catalog.COMPONENTS, values)}


_profile_rows = q.values([(k, *p[1]) for k, p in catalog.VIBE_PROFILES.items()], "vibe, " + ", ".join(f"w_{k}" for k in catalog.COMPONENTS))


@query("flagship_vibe_tiles", oracle(["tiles"], f"""SELECT vibe, position, cell, scenic, fit, selection FROM (
      SELECT *, row_number() OVER (PARTITION BY vibe ORDER BY selection DESC, cell) AS position FROM (
        SELECT vibe, cell, scenic, fit, round(scenic * 0.35e0 + fit * 0.65e0, 9) AS selection FROM (
          SELECT p.vibe, s.cell, {q.tile_score({k: f'p.w_{k}' for k in catalog.COMPONENTS})} AS scenic, f.fit
          FROM scored s CROSS JOIN {_profile_rows} p JOIN fits f ON f.tile_key = s.tile_key AND f.vibe = p.vibe)))
      WHERE position <= 25""", "scenic fit selection", SCORED + f", fits AS ({q.fit_rows('scored')})"))
def flagship_vibe_tiles(spark, sf):
    """Best 25 tiles of each vibe: per vibe one bounded top-k, for which no task sorts or holds its rows."""
    tiles = scored_tiles(spark, sf)
    best = None
    for v, p in catalog.VIBE_PROFILES.items():
        rows = tiles.select("cell", scoring.score_tile(literal_weights(p[1])).alias("scenic"), scoring.vibe_fit_one(v).alias("fit"))
        rows = rows.withColumn("selection", F.round(F.col("scenic") * 0.35 + F.col("fit") * 0.65, 9))
        top = rows.orderBy(F.desc("selection"), "cell").limit(25).select(F.lit(v).alias("vibe"), "cell", "scenic", "fit", "selection")
        best = top if best is None else best.unionByName(top)
    order = Window.partitionBy("vibe").orderBy(F.desc("selection"), "cell")
    return best.withColumn("position", F.row_number().over(order)).select("vibe", "position", "cell", "scenic", "fit", "selection")


@query("tile_components", oracle(["tiles"], f"SELECT cell, {', '.join(catalog.COMPONENTS)} FROM scored", COMPONENTS, SCORED))
def tile_components(spark, sf):
    return scored_tiles(spark, sf).select("cell", *catalog.COMPONENTS)


@query("tile_preference_scores", oracle(["tiles"], "SELECT cell, " + ", ".join(
    f"{q.tile_score(sql_weights(p[1]))} AS s_{v}" for v, p in catalog.VIBE_PROFILES.items()) + " FROM scored",
    " ".join(f"s_{v}" for v in catalog.VIBES), SCORED))
def tile_preference_scores(spark, sf):
    return scored_tiles(spark, sf).select("cell", *[
        scoring.score_tile(literal_weights(p[1])).alias(f"s_{v}") for v, p in catalog.VIBE_PROFILES.items()])


def _composite_sql() -> str:
    u = q.u
    legacy = {"w": u("water_proximity"), "g": u("natural_land_use"), "e": u("elevation_variance"),
              "s": f"((1e0 - {u('road_density')} + {u('traffic_signal_score', '0.5e0')}) / 2)", "c": u("visual_complexity"), "p": u("poi_density")}
    new = {"w": "water_score", "g": "green_score", "e": "elevation_score", "s": "solitude_score", "c": "curve_score", "p": "poi_score"}
    empty = "NOT coalesce(scoring_version LIKE '3.%', false) AND " + " AND ".join(f"{u(v)} = 0" for v in new.values())
    base = " + ".join(f"(CASE WHEN {empty} THEN {legacy[k]} ELSE {u(new[k])} END) * {w}e0"
                      for k, w in (("w", .25), ("g", .22), ("e", .15), ("s", .12), ("c", .11), ("p", .15)))
    return f"least(1e0, {q.cl(base)} * (1 + {u('park_score')} * 0.3e0))"


_blanked = "SELECT * REPLACE (" + ", ".join(f"CASE WHEN tile_key % 5 = 0 THEN 0e0 ELSE {n} END AS {n}" for n in scoring.COMPONENT_COLUMNS.values()) + ") FROM tiles"


@query("tile_composites", oracle(["tiles"], f"SELECT cell, {_composite_sql()} AS composite FROM blanked", "composite", f"blanked AS ({_blanked})"))
def tile_composites(spark, sf):
    """A fifth of the tiles have their components blanked so that the legacy branch is exercised."""
    tiles = domain(spark, sf, "tiles")
    blank = F.col("tile_key") % 5 == 0
    tiles = tiles.withColumns({n: F.when(blank, 0.0).otherwise(F.col(n)) for n in scoring.COMPONENT_COLUMNS.values()})
    return tiles.select("cell", scoring.composite_score().alias("composite"))


@query("tile_legacy_sync", oracle(["tiles"], f"""SELECT cell, {q.u('water_proximity')} AS water_score, {q.u('natural_land_use')} AS green_score,
    {q.cl('CASE WHEN ev > 1 THEN ev / 40 ELSE ev END')} AS elevation_score, {q.cl(f"(1e0 - {q.u('road_density')} + {q.u('traffic_signal_score', '0.5e0')}) / 2")} AS solitude_score,
    {q.u('visual_complexity')} AS curve_score, {q.u('poi_density')} AS poi_score FROM (SELECT *, elevation_variance * (1 + tile_key % 3 * 6) AS ev FROM tiles)""",
    " ".join(scoring.COMPONENT_COLUMNS.values())))
def tile_legacy_sync(spark, sf):
    tiles = domain(spark, sf, "tiles").withColumn("elevation_variance", F.col("elevation_variance") * (1 + F.col("tile_key") % 3 * 6))
    return scoring.sync_legacy(tiles).select("cell", *scoring.COMPONENT_COLUMNS.values())


@query("tile_open_space_and_pressure", oracle(["tiles"], f"SELECT cell, {q.OPEN_SPACE} AS open_space, {q.cl(q.URBAN)} AS urban_pressure FROM scored",
                                              "open_space urban_pressure", SCORED))
def tile_open_space_and_pressure(spark, sf):
    return scored_tiles(spark, sf).select("cell", scoring.open_space().alias("open_space"), scoring.urban_pressure().alias("urban_pressure"))


@query("tile_vibe_fits", oracle(["tiles"], "SELECT cell, vibe, fit FROM (" + q.fit_rows("scored") + ")", "fit", SCORED))
def tile_vibe_fits(spark, sf):
    return scored_tiles(spark, sf).select("cell", F.explode(scoring.vibe_fits()).alias("vibe", "fit"))


_sig = {"water_proximity": "water_proximity", "elevation": "elevation_variance", "land_use": "natural_land_use",
        "curvature": "visual_complexity", "traffic": "traffic_signal_score", "poi": "poi_density"}


@query("tile_signal_composites", oracle(["tiles"], "SELECT x.cell, w.vibe, sum(coalesce(x.v, 0.5e0) * w.weight) AS composite FROM (" + " UNION ALL ".join(
    f"SELECT cell, '{s}' AS signal, CASE WHEN tile_key % {7 + i} = 0 THEN NULL ELSE {col} END AS v FROM tiles" for i, (s, col) in enumerate(_sig.items()))
    + ") x JOIN " + q.values([(v, s, w) for v, ws in catalog.SIGNAL_WEIGHTS.items() for s, w in zip(catalog.SIGNALS, ws)], "vibe, signal, weight")
    + " w USING (signal) GROUP BY 1, 2", "composite"))
def tile_signal_composites(spark, sf):
    signals = {s: F.when(F.col("tile_key") % (7 + i) != 0, F.col(col)) for i, (s, col) in enumerate(_sig.items())}
    rows = F.create_map(*[x for v in catalog.SIGNAL_WEIGHTS for x in (F.lit(v), scoring.signal_composite(v, signals))])
    return domain(spark, sf, "tiles").select("cell", F.explode(rows).alias("vibe", "composite"))


VARIETY_SQL = ("(" + q.cl("(water + greenery + elevation + solitude + curves) / 5 * 0.55e0 + (CAST(water >= 0.35e0 AS INT) + CAST(greenery >= 0.35e0 AS INT) + "
                          "CAST(elevation >= 0.35e0 AS INT) + CAST(solitude >= 0.35e0 AS INT) + CAST(curves >= 0.35e0 AS INT)) / 5 * 0.45e0") + ")")


@query("tile_landscape_variety", oracle(["tiles"], f"SELECT cell, {VARIETY_SQL} AS variety FROM scored", "variety", SCORED))
def tile_landscape_variety(spark, sf):
    return scored_tiles(spark, sf).select("cell", scoring.landscape_variety().alias("variety"))


def anchor_sql(fit: str, scenic: str) -> dict[str, str]:
    low = f"(1 - {q.cl(q.URBAN)})"
    peak = f"greatest(water, elevation, poi, {q.u('viewpoint_score')})"
    return {
        "WATER_FOLLOWING": f"water * 0.58e0 + greenery * 0.12e0 + {q.u('bridge_coastal_score')} * 0.08e0 + {fit} * 0.14e0 + {low} * 0.08e0",
        "OPEN_SPACE_ESCAPE": f"{q.OPEN_SPACE} * 0.55e0 + solitude * 0.20e0 + {low} * 0.15e0 + (1 - {q.u('road_density')}) * 0.10e0",
        "QUIET_LOW_PRESSURE": f"solitude * 0.48e0 + greenery * 0.20e0 + {low} * 0.22e0 + {q.u('darkness_score')} * 0.10e0",
        "PHOTO_PEAKS": f"{peak} * 0.44e0 + poi * 0.16e0 + {q.u('viewpoint_score')} * 0.18e0 + {fit} * 0.14e0 + {scenic} * 0.08e0",
        "CURVY_ELEVATION": f"curves * 0.45e0 + elevation * 0.30e0 + {fit} * 0.15e0 + {low} * 0.10e0",
        "BALANCED_VARIETY": f"{scenic} * 0.42e0 + {fit} * 0.34e0 + {VARIETY_SQL} * 0.24e0",
    }


@query("tile_strategy_anchors", oracle(["tiles"], " UNION ALL ".join(
    f"SELECT cell, '{s}' AS strategy, {q.cl(e)} AS anchor_score FROM (SELECT s.*, f.fit FROM scored s JOIN fits f ON f.tile_key = s.tile_key AND f.vibe = 'coastal')"
    for s, e in anchor_sql("fit", "scenic_score").items()), "anchor_score", SCORED + f", fits AS ({q.fit_rows('scored')})"))
def tile_strategy_anchors(spark, sf):
    tiles = scored_tiles(spark, sf).withColumn("fit", scoring.vibe_fit_one("coastal"))
    tiles = tiles.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in catalog.STRATEGIES])))
    return tiles.select("cell", "strategy", scoring.strategy_anchor_score("strategy", "fit", "scenic_score").alias("anchor_score"))


@query("tile_selection_scores", oracle(["tiles"], """SELECT cell, scenic_score * 0.35e0 + fit * 0.55e0 + near * 0.1e0 AS strict_selection,
    scenic_score * 0.55e0 + fit * 0.35e0 + near * 0.1e0 AS relaxed_selection FROM (SELECT s.*, f.fit, 1 - least(1e0, abs((s.tile_key % 30) - 9.5e0) / 9.5e0) AS near
    FROM scored s JOIN fits f ON f.tile_key = s.tile_key AND f.vibe = 'relaxing')""", "strict_selection relaxed_selection",
    SCORED + f", fits AS ({q.fit_rows('scored')})"))
def tile_selection_scores(spark, sf):
    tiles = scored_tiles(spark, sf).withColumn("fit", scoring.vibe_fit_one("relaxing"))
    args = ("scenic_score", "fit", F.col("tile_key") % 30, F.lit(9.5))
    return tiles.select("cell", scoring.tile_selection_score(*args).alias("strict_selection"),
                        scoring.tile_selection_score(*args, strict=False).alias("relaxed_selection"))


@query("tile_dominant_features", oracle(["tiles"], """SELECT cell, CASE WHEN water_proximity = top THEN 'waterfront' WHEN elevation_variance = top THEN 'elevation'
    WHEN natural_land_use = top THEN 'nature' WHEN poi_density = top THEN 'landmarks' ELSE 'views' END AS feature, least(1e0, greatest(0.1e0, mean5)) AS confidence
    FROM (SELECT *, greatest(water_proximity, elevation_variance, natural_land_use, poi_density, visual_complexity) AS top,
      (water_proximity + elevation_variance + natural_land_use + poi_density + visual_complexity) / 5 AS mean5 FROM tiles)""", "confidence"))
def tile_dominant_features(spark, sf):
    return domain(spark, sf, "tiles").select("cell", scoring.dominant_feature().alias("feature"), scoring.tile_confidence().alias("confidence"))


def resolved_requests(spark, sf):
    return domain(spark, sf, "requests").withColumns({
        "vibes": text.resolve_vibes("vibes_json", "vibe"), "preferences": text.parse_preferences("preferences_json")})


_profile_lists = ("(SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {p[2]!r}, {p[3]!r}::VARCHAR[], {str(p[4]).lower()}, {p[5]}e0, {p[6]}e0, {catalog.VIBES.index(k)})" for k, p in catalog.VIBE_PROFILES.items())
    + ") v(vibe, targets, antis, outward, min_best, min_mean, rank))")
KNOWN_VIBES = f"""known_vibes AS (SELECT request_id, list(vibe ORDER BY pos) AS vibes FROM (SELECT request_id, vibe, min(pos) AS pos FROM (
    SELECT request_id, CASE WHEN v IN ({', '.join(repr(v) for v in catalog.VIBES)}) THEN v ELSE 'countryside' END AS vibe, pos FROM (
      SELECT request_id, unnest(vibes) AS v, generate_subscripts(vibes, 1) AS pos FROM resolved_vibes)) GROUP BY 1, 2) GROUP BY 1)"""
_strategy_sql = "CASE " + " ".join(f"WHEN list_has_any(vibes, {m!r}) THEN '{s}'" for s, m in catalog.STRATEGY_VIBES) + " ELSE 'BALANCED_VARIETY' END"


def _ordered_distinct(field: str) -> str:
    return f"""(SELECT coalesce(string_agg(x, '|' ORDER BY p), '') FROM (SELECT x, min(p) AS p FROM (
      SELECT unnest(l.{field}) AS x, v.pos * 10 + generate_subscripts(l.{field}, 1) AS p FROM (SELECT unnest(k.vibes) AS vibe, generate_subscripts(k.vibes, 1) AS pos) v
      JOIN {_profile_lists} l ON l.vibe = v.vibe) GROUP BY x))"""


@query("blended_profiles", oracle(["requests"], f"""SELECT k.request_id, {_ordered_distinct('targets')} AS targets, {_ordered_distinct('antis')} AS antis,
    b.outward, b.min_best, b.min_mean, {_strategy_sql} AS strategy FROM known_vibes k JOIN (
      SELECT request_id, bool_or(outward) AS outward, avg(min_best) AS min_best, avg(min_mean) AS min_mean
      FROM (SELECT request_id, unnest(vibes) AS vibe FROM known_vibes) JOIN {_profile_lists} USING (vibe) GROUP BY 1) b USING (request_id)""",
    "min_best min_mean", RESOLVED_VIBES + ", " + KNOWN_VIBES))
def blended_profiles(spark, sf):
    df = blend_profiles(resolved_requests(spark, sf))
    return df.select("request_id", F.array_join("targets", "|").alias("targets"), F.array_join("antis", "|").alias("antis"),
                     "outward", "min_best", "min_mean", "strategy")


@query("resolved_strategies", oracle(["requests"], f"SELECT request_id, {_strategy_sql} AS strategy FROM resolved_vibes", extra=RESOLVED_VIBES))
def resolved_strategies(spark, sf):
    return resolved_requests(spark, sf).select("request_id", scoring.resolve_strategy("vibes").alias("strategy"))


def _weights_sql(ratios: bool) -> str:
    ks = catalog.COMPONENTS
    pref = {"water": "$.Water", "curves": "$.curve", "solitude": '$."solitude "'}
    over = {k: f"CASE WHEN j IS NOT NULL THEN greatest(0e0, least(1e0, try_cast(json_extract_string(j, '{p}') AS DOUBLE))) END" for k, p in pref.items()}
    base = ", ".join(f"coalesce({over.get(k, 'NULL')}, d_{k}) AS b_{k}" for k in ks)
    total = "greatest(0.0001e0, " + " + ".join(f"b_{k}" for k in ks) + ")" if ratios else "1e0"
    mult = ", ".join(f"b_{k} / {total} * coalesce(m_{k}, 1e0) AS x_{k}" for k in ks)
    total2 = "greatest(0.0001e0, " + " + ".join(f"x_{k}" for k in ks) + ")" if ratios else "1e0"
    return f"""SELECT request_id, {', '.join(f'x_{k} / {total2} AS w_{k}' for k in ks)} FROM (SELECT request_id, {mult} FROM (
      SELECT r.request_id, m.*, {base} FROM (SELECT request_id, CASE WHEN json_valid(preferences_json) THEN preferences_json END AS j FROM requests) r
      JOIN (SELECT request_id, {', '.join(f'avg(w_{k}) AS d_{k}' for k in ks)} FROM (SELECT request_id, unnest(vibes) AS vibe FROM known_vibes) JOIN {_profile_rows} USING (vibe) GROUP BY 1) d USING (request_id)
      LEFT JOIN (SELECT request_id AS rid, {', '.join(f'avg(m_{k}) AS m_{k}' for k in ks)} FROM (SELECT request_id, unnest(vibes) AS vibe FROM resolved_vibes) JOIN weight_calibrations USING (vibe) GROUP BY 1) m
        ON m.rid = r.request_id))"""


_wcols = " ".join(f"w_{k}" for k in catalog.COMPONENTS)
_wextra = RESOLVED_VIBES + ", " + KNOWN_VIBES


@query("request_weight_ratios", oracle(["requests", "weight_calibrations"], _weights_sql(True), _wcols, _wextra))
def request_weight_ratios(spark, sf):
    df = effective_weights(resolved_requests(spark, sf), domain(spark, sf, "weight_calibrations"))
    return df.select("request_id", *[f"w_{k}" for k in catalog.COMPONENTS])


@query("request_planner_weights", oracle(["requests", "weight_calibrations"], _weights_sql(False), _wcols, _wextra))
def request_planner_weights(spark, sf):
    df = effective_weights(resolved_requests(spark, sf), domain(spark, sf, "weight_calibrations"), ratios=False)
    return df.select("request_id", *[f"w_{k}" for k in catalog.COMPONENTS])
