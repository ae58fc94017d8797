"""Score expressions over one tile row (columns named as in catalog.TILE_SCORES plus scoring_version)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog
from vistagrid.functions.scalars import c, clamp01, mean_of, unit, weighted_sum

FALLBACK = 0.35  # neutral scenic value. Fixed value.


def enriched() -> Column:
    """Versions 3.x make component columns authoritative even where they are 0."""
    return F.coalesce(F.col("scoring_version").startswith("3."), F.lit(False))


def legacy_solitude() -> Column:
    return clamp01((F.lit(1.0) - unit("road_density") + unit("traffic_signal_score", 0.5)) / 2.0)


def _resolved(component: str, legacy: Column) -> Column:
    value = F.coalesce(c(component), F.lit(0.0))
    return F.when(enriched() | (value > 0.0), clamp01(value)).otherwise(clamp01(legacy))


def component_columns() -> dict[str, Column]:
    on = enriched()
    z = F.lit(0.0)

    def coalesced(name):
        return F.coalesce(c(name), z)

    water = _resolved("water_score", coalesced("water_proximity"))
    seen = clamp01(weighted_sum([(unit("water_visibility_score"), 0.62), (unit("coastal_road_score"), 0.26),
                                 (unit("water_crossing_score"), 0.12)]))
    green = _resolved("green_score", coalesced("natural_land_use"))
    canopy = unit("tree_canopy_score")
    elevation = _resolved("elevation_score", coalesced("elevation_variance"))
    quiet = _resolved("solitude_score", legacy_solitude())
    quiet_enriched = clamp01(weighted_sum([
        (quiet, 0.60), (1.0 - unit("building_density_score"), 0.25), (unit("darkness_score"), 0.10),
        (1.0 - unit("road_stress_score"), 0.05)]))
    poi = _resolved("poi_score", coalesced("poi_density"))
    return {
        "water": F.when(on, F.greatest(water, seen, unit("bridge_coastal_score"))).otherwise(water),
        "greenery": F.when(on & (canopy > 0.0), F.greatest(green, clamp01(green * 0.65 + canopy * 0.35))).otherwise(green),
        "elevation": elevation,
        "solitude": F.when(on, quiet_enriched).otherwise(quiet),
        "curves": _resolved("curve_score", coalesced("visual_complexity")),
        "poi": F.when(on, F.greatest(poi, unit("overture_poi_score"), unit("scenic_poi_score"), unit("viewpoint_score"))).otherwise(poi),
    }


def component_scores(tiles: DataFrame) -> DataFrame:
    """Adds water, greenery, elevation, solitude, curves and poi."""
    return tiles.withColumns(component_columns())


def park_boost(base) -> Column:
    return clamp01(c(base) * (1.0 + unit("park_score") * 0.30))


def score_tile(weights: dict[str, Column]) -> Column:
    """Preference-weighted score of a tile row that already has its component columns."""
    total = F.greatest(F.lit(0.0001), weighted_sum([(weights[k], 1.0) for k in catalog.COMPONENTS]))
    weighted = weighted_sum([(F.col(k), weights[k]) for k in catalog.COMPONENTS])
    boosted = park_boost(clamp01(weighted / total))
    less_urban = clamp01(boosted - unit("urban_penalty_score") * 0.10)
    return F.when(enriched(), clamp01(less_urban - unit("road_stress_score") * 0.06)).otherwise(boosted)


BASE_WEIGHTS = [("water", 0.25), ("greenery", 0.22), ("elevation", 0.15), ("solitude", 0.12), ("curves", 0.11), ("poi", 0.15)]
COMPONENT_COLUMNS = {"water": "water_score", "greenery": "green_score", "elevation": "elevation_score",
                     "solitude": "solitude_score", "curves": "curve_score", "poi": "poi_score"}


def legacy_columns() -> dict[str, Column]:
    return {"water": unit("water_proximity"), "greenery": unit("natural_land_use"), "elevation": unit("elevation_variance"),
            "solitude": legacy_solitude(), "curves": unit("visual_complexity"), "poi": unit("poi_density")}


def composite_score() -> Column:
    """Stored composite: fixed weights and park boost; an all-zero older tile falls back to its legacy signals."""
    parts = {k: unit(v) for k, v in COMPONENT_COLUMNS.items()}
    legacy = legacy_columns()
    empty = ~enriched() & (F.greatest(*parts.values()) == 0.0)
    base = weighted_sum([(F.when(empty, legacy[k]).otherwise(parts[k]), w) for k, w in BASE_WEIGHTS])
    return park_boost(clamp01(base))


def sync_legacy(tiles: DataFrame) -> DataFrame:
    """Component columns rebuilt from the legacy signals; elevations above 1 are metres-like and divided by 40."""
    legacy = legacy_columns()
    raw = F.coalesce(c("elevation_variance"), F.lit(0.0))
    legacy["elevation"] = clamp01(F.when(raw > 1.0, raw / 40.0).otherwise(raw))
    return tiles.withColumns({COMPONENT_COLUMNS[k]: v for k, v in legacy.items()})


def open_space() -> Column:
    """Needs component columns."""
    return clamp01(weighted_sum([
        (c("solitude"), 0.40), (1.0 - unit("road_density"), 0.20), (1.0 - unit("building_density_score"), 0.15),
        (1.0 - unit("urban_penalty_score"), 0.10), (1.0 - unit("road_stress_score"), 0.10), (1.0 - c("poi"), 0.05)]))


def urban_pressure() -> Column:
    return weighted_sum([(unit("urban_penalty_score"), 0.65), (unit("building_density_score"), 0.25), (unit("road_density"), 0.10)])


def target_weight(vibe: str, component: str) -> float:
    w = dict(zip(catalog.COMPONENTS, catalog.VIBE_PROFILES[vibe][1]))
    derived = {"scenic_poi": w["poi"], "viewpoint": max(w["poi"], w["elevation"]),
               "bridge_coastal": max(w["water"], w["poi"]), "tree_canopy": max(w["greenery"], w["solitude"]),
               "open_space": max(w["solitude"], w["curves"])}
    return w.get(component, derived.get(component, 0.0))


def target_value(component: str) -> Column:
    if component == "open_space":
        return open_space()
    if component in catalog.COMPONENTS:
        return F.col(component)
    return unit(f"{component}_score")


def anti_value(component: str) -> Column:
    return {"urban_penalty": unit("urban_penalty_score"), "building_density": unit("building_density_score"),
            "road_stress": unit("road_stress_score"), "road_density": unit("road_density"),
            "poi": F.col("poi"), "curves": F.col("curves")}[component]


def vibe_fit_one(vibe: str) -> Column:
    """Target mean minus 0.24 of the anti mean; every built-in vibe has strict intent."""
    _, _, targets, antis, *_ = catalog.VIBE_PROFILES[vibe]
    weights = [target_weight(vibe, t) for t in targets]
    target = clamp01(weighted_sum([(target_value(t), w) for t, w in zip(targets, weights)]) / sum(weights))
    if not antis:
        return target
    return clamp01(target - clamp01(mean_of(*[anti_value(a) for a in antis])) * 0.24)


def vibe_fits() -> Column:
    """map<vibe, fit> of the nine vibes; computed once per tile, before any join with requests."""
    return F.create_map(*[x for v in catalog.VIBES for x in (F.lit(v), vibe_fit_one(v))])


def blended_fit(fits, vibes) -> Column:
    """Mean fit over the vibes of a request."""
    v = c(vibes)
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + c(fits)[x]) / F.size(v)


def landscape_variety() -> Column:
    parts = [F.col(k) for k in ("water", "greenery", "elevation", "solitude", "curves")]
    useful = weighted_sum([(F.when(p >= 0.35, 1.0).otherwise(0.0), 0.2) for p in parts])
    return clamp01(clamp01(mean_of(*parts)) * 0.55 + useful * 0.45)


def _strategy_forms(fit, scenic) -> dict[str, list]:
    """Terms of the anchor value under each of the six strategies."""
    low_urban = 1.0 - clamp01(urban_pressure())
    peak = F.greatest(F.col("water"), F.col("elevation"), F.col("poi"), unit("viewpoint_score"))
    return {
        "WATER_FOLLOWING": [(F.col("water"), 0.58), (F.col("greenery"), 0.12), (unit("bridge_coastal_score"), 0.08),
                            (fit, 0.14), (low_urban, 0.08)],
        "OPEN_SPACE_ESCAPE": [(open_space(), 0.55), (F.col("solitude"), 0.20), (low_urban, 0.15),
                              (1.0 - unit("road_density"), 0.10)],
        "QUIET_LOW_PRESSURE": [(F.col("solitude"), 0.48), (F.col("greenery"), 0.20), (low_urban, 0.22),
                               (unit("darkness_score"), 0.10)],
        "PHOTO_PEAKS": [(peak, 0.44), (F.col("poi"), 0.16), (unit("viewpoint_score"), 0.18), (fit, 0.14), (scenic, 0.08)],
        "CURVY_ELEVATION": [(F.col("curves"), 0.45), (F.col("elevation"), 0.30), (fit, 0.15), (low_urban, 0.10)],
        "BALANCED_VARIETY": [(scenic, 0.42), (fit, 0.34), (landscape_variety(), 0.24)],
    }


def strategy_anchor_score(strategy, fit, scenic) -> Column:
    """Anchor value of a tile under one of the six strategies."""
    s = c(strategy)
    forms = _strategy_forms(c(fit), c(scenic))
    out = clamp01(weighted_sum(forms.pop("BALANCED_VARIETY")))
    for name, pairs in forms.items():
        out = F.when(s == name, clamp01(weighted_sum(pairs))).otherwise(out)
    return out


def strategy_bases() -> dict[str, tuple[Column, float, float]]:
    """Per strategy the part of its anchor value that a tile has by itself, and the weights of fit and scenic score in the rest."""
    out = {}
    for name, pairs in _strategy_forms("fit", "scenic").items():
        share = {term: w for term, w in pairs if isinstance(term, str)}
        out[name] = (weighted_sum([(term, w) for term, w in pairs if not isinstance(term, str)]), share.get("fit", 0.0), share.get("scenic", 0.0))
    return out


def tile_selection_score(scenic, fit, distance_km, radius_km, strict=True) -> Column:
    near = 1.0 - F.least(F.lit(1.0), F.abs(c(distance_km) - c(radius_km)) / F.greatest(F.lit(1.0), c(radius_km)))
    a, b = (0.35, 0.55) if strict else (0.55, 0.35)
    return c(scenic) * a + c(fit) * b + near * 0.10


def resolve_strategy(vibes) -> Column:
    out = F.lit("BALANCED_VARIETY")
    for name, members in reversed(catalog.STRATEGY_VIBES):
        out = F.when(F.arrays_overlap(c(vibes), F.array(*[F.lit(m) for m in members])), name).otherwise(out)
    return out


def signal_composite(vibe: str, signals: dict[str, Column]) -> Column:
    """Older weighting of six raw signals; a missing signal counts 0.5."""
    weights = catalog.SIGNAL_WEIGHTS[vibe]
    return weighted_sum([(F.coalesce(signals[s], F.lit(0.5)), w) for s, w in zip(catalog.SIGNALS, weights)])


def dominant_feature() -> Column:
    """Name of the first largest of the five legacy signals."""
    names = [("waterfront", "water_proximity"), ("elevation", "elevation_variance"), ("nature", "natural_land_use"),
             ("landmarks", "poi_density"), ("views", "visual_complexity")]
    values = [F.coalesce(c(col), F.lit(0.0)) for _, col in names]
    top = F.greatest(*values)
    out = F.lit(names[-1][0])
    for (name, _), value in reversed(list(zip(names, values))[:-1]):
        out = F.when(value == top, name).otherwise(out)
    return out


def tile_confidence() -> Column:
    names = ("water_proximity", "elevation_variance", "natural_land_use", "poi_density", "visual_complexity")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), mean_of(*[F.coalesce(c(n), F.lit(0.0)) for n in names])))


def quality_tier(score, options) -> Column:
    return F.when((c(options) < 2) | (c(score) < 0.45), "DEGRADED").when(
        (c(score) >= 0.78) & (c(options) >= 3), "PREMIUM").otherwise("STANDARD")


def score_color(score) -> Column:
    """'#RRGG4D': red to yellow below 0.5, yellow to green above."""
    s = clamp01(c(score))
    low = s < 0.5
    red = F.when(low, 255).otherwise(F.floor(255 - (s - 0.5) / 0.5 * 154 + 0.5)).cast("int")
    green = F.when(low, F.floor(96 + s / 0.5 * 128 + 0.5)).otherwise(224).cast("int")
    return F.format_string("#%02X%02X4D", red, green)
