"""Texts that explain an option: evidence, reasons, summary, highlights. All are expressions on one row."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions.scalars import clamp01
from vistagrid.functions.text import normalize_profile
from vistagrid.operators.paths import distance_to_next

# Evidence texts in their order, with the metric and the least value that earns them. `{}` stands for a percentage.
# Shares also take the average of a component; the others need the metric to be there.
SHARE, SCORE = "share", "score"
EVIDENCE = [
    (SHARE, "water_corridor_share", "water", 0.20, "follows water for {} of the drive"),
    (SCORE, "water_visibility_score", None, 0.25, "uses roads with stronger visible-water context"),
    (SCORE, "coastal_road_score", None, 0.25, "stays on more water-adjacent road corridors"),
    (SCORE, "bridge_coastal_score", None, 0.18, "adds bridge, pier, or coastal-road moments"),
    (SCORE, "water_crossing_score", None, 0.20, "includes bridge or water-crossing moments"),
    (SCORE, "tree_canopy_score", None, 0.26, "spends meaningful time in tree-covered corridors"),
    (SCORE, "scenic_poi_score", None, 0.18, "passes stronger scenic stops, landmarks, or natural features"),
    (SCORE, "viewpoint_score", None, 0.18, "has stronger viewpoint or photo-landmark signal"),
    (SHARE, "quiet_corridor_share", "solitude", 0.25, "keeps {} of the drive in quieter corridors"),
    (SHARE, "curve_elevation_corridor_share", "elevation", 0.25, "has rolling or curvy terrain through {} of the route"),
]
OPEN_TEXT, CALM_TEXT, PEAK_TEXT = "leans into open-space roads", "avoids high-stress road classes", "includes strong scenic stretches"
LOW_URBAN_TEXT, HIGH_URBAN_TEXT = "has lower urban pressure than nearby alternatives", "still carries some urban pressure near the start or finish"
NO_EVIDENCE = "uses the strongest scenic tiles available near this start"
OPENERS = {"most_scenic": "This is the strongest scenic option nearby", "balanced": "This route balances scenery with drive time", "shorter": "This is the shorter scenic option"}
PHRASES = {"water": "waterfront views", "greenery": "green cover", "elevation": "rolling terrain", "solitude": "quieter roads", "open_space": "open roads", "curves": "curvier roads", "poi": "interesting stops",
           "scenic_poi": "scenic stops", "viewpoint": "viewpoints", "bridge_coastal": "bridge and coastal-road moments"}
ADJECTIVES = {"water": "waterfront", "greenery": "green", "elevation": "rolling terrain", "solitude": "quiet", "open_space": "open road", "curves": "winding road", "poi": "stop-worthy"}
TRADEOFFS = ["closer timing", "a cleaner loop shape", "less urban pressure"]


def _looked_up(table: dict[str, str], name: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    return F.coalesce(texts[name], F.replace(F.lower(name), F.lit("_"), F.lit(" ")))


def _present(texts: list[Column]) -> Column:
    return F.filter(F.array(*texts), lambda t: t.isNotNull())


def percent(share: Column) -> Column:
    return F.concat(F.round(clamp01(share) * 100.0).cast("int").cast("string"), F.lit("%"))


def joined(items: Column) -> Column:
    """One, two or three texts as a list in a sentence."""
    a, b, third = (F.get(items, F.lit(k)) for k in range(3))
    return F.when(F.size(items) == 0, "uses the strongest scenic signals available").when(F.size(items) == 1, a).when(F.size(items) == 2, F.concat(a, F.lit(" and "), b)).otherwise(
        F.concat(a, F.lit(", "), b, F.lit(", and "), third))


def _metric(name: str) -> Column:
    return clamp01(F.coalesce(F.col("metrics")[name], F.lit(0.0)))


def _share(metric: str, component: str) -> Column:
    return clamp01(F.greatest(_metric(metric), F.coalesce(F.col("components")[component], F.lit(0.0))))


def evidence() -> Column:
    """Evidence of a route in order, from the maps `metrics` and `components` and the leading components."""
    has = lambda name: F.map_contains_key("metrics", F.lit(name))
    found = []
    for kind, metric, component, least, words in EVIDENCE:
        value = _share(metric, component) if kind == SHARE else _metric(metric)
        earned = value >= least if kind == SHARE else has(metric) & (value >= least)
        parts = words.split("{}")
        found.append(F.when(earned, F.lit(words) if len(parts) == 1 else F.concat(F.lit(parts[0]), percent(value), F.lit(parts[1]))))
    quiet = _share("quiet_corridor_share", "solitude") >= 0.25
    urban = _metric("urban_penalty")
    found += [F.when((_share("open_space_corridor_share", "open_space") >= 0.25) & ~quiet, OPEN_TEXT), F.when(has("road_stress_score") & (_metric("road_stress_score") <= 0.32), CALM_TEXT),
              F.when(F.greatest(_metric("scenic_moments_score"), _metric("photo_peak_score")) >= 0.42, PEAK_TEXT), F.when((urban > 0) & (urban <= 0.25), LOW_URBAN_TEXT).when(urban >= 0.45, HIGH_URBAN_TEXT)]
    some = _present(found)
    leads = F.transform(F.slice(F.coalesce(F.col("leading_components"), F.array().cast("array<string>")), 1, 2), lambda k: F.concat(F.lit("leans on "), _looked_up(PHRASES, k)))
    return F.when(F.size(some) > 0, some).when(F.size(leads) > 0, leads).otherwise(F.array(F.lit(NO_EVIDENCE)))


def human_reasons(routes: DataFrame) -> DataFrame:
    """Adds `human_reasons`: the sentence that opens with the profile, then every piece of evidence as a sentence.

    Needs metrics, components, leading_components, route_profile, vibes, minutes and target_minutes.
    """
    over = F.col("minutes") - F.col("target_minutes")
    near = F.abs(over) <= F.greatest(F.lit(5.0), F.floor(F.col("target_minutes") * 0.10 + 0.5))
    budget = F.when(F.col("target_minutes") > 0, F.when(near, F.concat(F.lit("stays close to your "), F.col("target_minutes").cast("string"), F.lit("-minute budget"))).when(
        over > 0, F.concat(F.lit("runs about "), over.cast("string"), F.lit(" minutes over your requested budget"))))
    rows = routes.withColumn("__evidence", evidence())
    rows = rows.withColumn("__evidence", F.concat("__evidence", _present([budget])))
    profile = normalize_profile("route_profile")
    first_vibe = F.get(F.col("vibes"), F.lit(0))
    other = F.when(first_vibe.isNotNull(), F.concat(F.lit("This route fits "), F.regexp_replace(F.lower(first_vibe), "[-_]", " "))).otherwise("This route was selected")
    opener = functools.reduce(lambda out, p: F.when(profile == p[0], p[1]).otherwise(out), OPENERS.items(), other)
    primary = F.concat(opener, F.lit(" because it "), joined(F.slice("__evidence", 1, 3)), F.lit("."))
    sentences = F.transform("__evidence", lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, F.lit(2), F.length(t)), F.lit(".")))
    return rows.withColumn("human_reasons", F.concat(F.array(primary), sentences)).drop("__evidence")


def option_summary() -> Column:
    """Summary of an option by its profile, from its leading components and metrics; other profiles take their first reason."""
    lead = lambda k: F.get(F.col("leading_components"), F.lit(k))
    first = F.coalesce(_looked_up(ADJECTIVES, lead(0)), F.lit("scenic"))
    second = F.coalesce(F.concat(F.lit(" plus "), _looked_up(ADJECTIVES, lead(1)), F.lit(" support")), F.lit(""))
    kept = [_metric("duration_fit_ratio") >= 0.88, (_metric("backtracking_penalty") <= 0.22) | (_metric("leg_separation_score") >= 0.55) | (_metric("route_shape_score") >= 0.72),
            (_metric("corridor_urban_pressure") <= 0.42) | (_metric("urban_penalty") <= 0.42)]
    trades = _present([F.when(k, t) for k, t in zip(kept, TRADEOFFS)])
    traded = F.when(F.size(trades) > 0, joined(F.slice(trades, 1, 2))).otherwise("a steadier drive")
    time = F.when(F.col("minutes") > 0, F.concat(F.lit(" in a "), F.col("minutes").cast("string"), F.lit("-minute drive"))).otherwise("")
    profile = normalize_profile("route_profile")
    return (F.when(profile == "most_scenic", F.concat(F.lit("Best scenic match nearby, with the strongest "), first, F.lit(" signal"), second, F.lit(".")))
            .when(profile == "balanced", F.concat(F.lit("Balanced trades peak scenic intensity for "), traded, F.lit(", while keeping "), first, F.lit(" character in the route.")))
            .when(profile == "shorter", F.concat(F.lit("Shorter keeps the best available "), first, F.lit(" feel"), time, F.lit(", with less time commitment than the other options.")))
            .otherwise(F.coalesce(F.get(F.col("human_reasons"), F.lit(0)), F.lit("Selected from nearby scenic tiles along this route."))))


def highlights(routes: DataFrame, points: DataFrame) -> DataFrame:
    """Start, midpoint and destination of every route, and a summary line: route_id, place, type, point_index, lat, lon, to_next_km, description.

    `routes` has route_id, vibe and score. Which points these are follows from their position, so paths are only filtered.
    """
    n, seq = F.col("n_points"), F.col("seq")
    middle = F.floor(n / 2)
    kinds = F.filter(F.array(F.when(seq == 0, F.struct(F.lit(1).alias("place"), F.lit("start").alias("type"))), F.when((n > 2) & (seq == middle), F.struct(F.lit(2).alias("place"), F.lit("midpoint").alias("type"))),
                             F.when((n > 1) & (seq == n - 1), F.struct(F.lit(3).alias("place"), F.lit("destination").alias("type")))), lambda k: k.isNotNull())
    marked = distance_to_next(points).withColumn("k", F.explode(kinds))
    stops = marked.select("route_id", "k.place", "k.type", seq.alias("point_index"), "lat", "lon", F.col("to_next").alias("to_next_km"), F.lit(None).cast("string").alias("description"))
    ends = points.where("seq = 0").select("route_id", "n_points").join(routes, "route_id")
    words = F.format_string("%s loop with scenic match %s/100 and %d waypoint%s", F.col("vibe"), F.format_string("%.1f", F.round(F.col("score") * 100.0, 1)), n, F.when(n == 1, "").otherwise("s"))
    none = lambda kind: F.lit(None).cast(kind)
    lines = ends.select("route_id", F.lit(0).alias("place"), F.lit("route_summary").alias("type"), none("bigint").alias("point_index"), none("double").alias("lat"), none("double").alias("lon"), none("double").alias("to_next_km"), words.alias("description"))
    return lines.unionByName(stops)
