"""Release validation, audits and route contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog, text
from vistagrid.functions.scalars import clamp01


def audit_tiles(tiles: DataFrame, signals: list[str], neutral: float = 0.5) -> DataFrame:
    """Per signal: min, mean, max, spread, share of neutral and of non-zero values; one pass over the tiles."""
    aggs = []
    for s in signals:
        v = F.col(s)
        aggs.append(F.struct(F.lit(s).alias("signal"), F.min(v).alias("min_value"), F.avg(v).alias("avg_value"), F.max(v).alias("max_value"),
                             F.stddev_pop(v).alias("stddev_value"), F.avg(F.when(F.abs(v - neutral) < 1e-9, 1.0).otherwise(0.0)).alias("neutral_share"),
                             F.avg(F.when(v > 0, 1.0).otherwise(0.0)).alias("non_zero_share")).alias(s))
    return tiles.agg(*aggs).select(F.explode(F.array(*signals)).alias("x")).select("x.*")


def readiness_checks(tiles: DataFrame, roads: DataFrame, places: DataFrame, waters: DataFrame, landcover: DataFrame, parks: DataFrame, light: DataFrame) -> DataFrame:
    """(check, status) of every data source: ready, needs data QA, missing, candidate, present or partial.

    Each check is one aggregate over its table, so the result has a fixed number of rows.
    """
    def check(name, df, status):
        return df.agg(F.lit(name).alias("check"), status.alias("status")).select("check", "status")

    n = F.count("*")
    dark = F.coalesce(F.stddev_pop("darkness_score"), F.lit(0.0))
    neutral = F.coalesce(F.count_if(F.col("darkness_score") == 0.5) / n, F.lit(1.0))
    tags = audit_tags(places, None)
    seen = F.coalesce(F.sum(F.when(F.col("feature").isin("viewpoint", "peak"), F.col("n"))), F.lit(0))
    rows = [check("darkness", tiles, F.when((dark > 0.01) & (neutral < 0.90), "ready").otherwise("needs data QA")),
            check("road_stress_score", tiles, F.when(F.coalesce(F.stddev_pop("road_stress_score"), F.lit(0.0)) > 0.01, "ready").otherwise("needs data QA")),
            check("light_samples", light, F.when(n > 0, "present").otherwise("missing")),
            check("road_class", roads, F.when(n > 0, "candidate").otherwise("blocked")),
            check("viewpoints", tags, F.when(seen > 0, "candidate").otherwise("needs data QA")),
            check("water_visibility", waters, F.when(n > 0, "partial").otherwise("needs data QA")),
            check("tree_canopy", landcover, F.when(n > 0, "partial").otherwise("missing")),
            check("parks", parks, F.when(n > 0, "ready").otherwise("missing"))]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def audit_roads(roads: DataFrame) -> DataFrame:
    n = F.count("*")
    return roads.agg(n.alias("segments"), (F.count("road_type") / n).alias("type_coverage"), (F.count("surface") / n).alias("surface_coverage"),
                     (F.count("speed_kmh") / n).alias("speed_coverage"), (F.count_if(F.coalesce("elevation_change", F.lit(0.0)) != 0) / n).alias("elevation_coverage"),
                     (F.count_if(F.col("road_type").isin("motorway", "trunk", "primary")) / n).alias("major_share"),
                     (F.count_if(F.col("road_type").isin("residential", "service", "living_street")) / n).alias("local_share"), F.count_distinct("cell").alias("tiles"))


def top_road_types(roads: DataFrame, n: int = 12) -> DataFrame:
    return roads.groupBy(F.coalesce("road_type", F.lit("unknown")).alias("road_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "road_type").limit(n)


def audit_tags(places: DataFrame, lines: DataFrame | None) -> DataFrame:
    """Counts of tagged features, as (feature, n) rows; without `lines` only those of points."""
    points = {"viewpoint": text.tag_in("tags", "tourism", ["viewpoint"]), "peak": text.tag_in("tags", "natural", ["peak"]), "spring": text.tag_in("tags", "natural", ["spring"]),
              "tourism": F.col("tags")["tourism"].isNotNull()}
    bridge = text.tag_set("tags", "bridge")
    seasonal = text.tag_set("tags", "seasonal") | F.col("tags")["winter_road"].isNotNull() | F.col("tags")["ice_road"].isNotNull() | F.col("tags")["access:conditional"].isNotNull()
    ways = {"bridge": bridge, "tunnel": text.tag_set("tags", "tunnel"), "waterway": text.tag_present("tags", "waterway"), "seasonal": seasonal,
            "coastal_hint": bridge | F.col("tags")["waterway"].isNotNull() | F.col("tags")["ford"].isNotNull()}
    out = None
    for df, kinds in ((places, points), (lines, ways)):
        if df is not None:
            part = df.agg(*[F.count_if(v).alias(k) for k, v in kinds.items()]).unpivot([], list(kinds), "feature", "n")
            out = part if out is None else out.unionByName(part)
    return out


def validate_release(release: DataFrame, target: DataFrame, version: str, signals: list[str]) -> DataFrame:
    """(check, n) rows: values that are NaN, infinite or outside [0, 1], wrong versions, missing and extra keys."""
    long = release.select("cell", *signals).unpivot(["cell"], signals, "signal", "v")
    bad = long.agg(F.count_if(F.isnan("v")).alias("nan_values"), F.count_if(F.abs("v") == float("inf")).alias("infinite_values"),
                   F.count_if((F.col("v") < 0) | (F.col("v") > 1)).alias("out_of_range"))
    other = release.agg(F.count_if(F.coalesce("scoring_version", F.lit("")) != version).alias("wrong_version"), (F.count("*") - F.count_distinct("cell")).alias("repeated_keys"))
    missing = target.select("cell").join(release.select("cell"), "cell", "left_anti").agg(F.count("*").alias("missing_keys"))
    extra = release.select("cell").join(target.select("cell"), "cell", "left_anti").agg(F.count("*").alias("extra_keys"))
    out = None
    for df in (bad, other, missing, extra):
        part = df.unpivot([], df.columns, "check", "n")
        out = part if out is None else out.unionByName(part)
    return out


def apply_release(tiles: DataFrame, release: DataFrame, columns: list[str]) -> DataFrame:
    """Tiles with the released values; a null in the release keeps the stored value."""
    r = release.select("cell", *[F.col(x).alias(f"__{x}") for x in columns])
    return tiles.join(r, "cell", "left").withColumns({x: F.coalesce(F.col(f"__{x}"), F.col(x)) for x in columns}).drop(*[f"__{x}" for x in columns])


def snapshot(tiles: DataFrame, columns: list[str], path: str) -> None:
    """Keeps the released columns of every tile before a release, as a table at `path`."""
    tiles.select("cell", *columns).write.mode("overwrite").parquet(path)


def restore(tiles: DataFrame, columns: list[str], path: str) -> DataFrame:
    """Tiles with the columns of a snapshot, nulls included; tiles that it does not know stay as they are."""
    old = tiles.sparkSession.read.parquet(path).select("cell", F.struct(*columns).alias("__old"))
    known = F.col("__old").isNotNull()
    return tiles.join(old, "cell", "left").withColumns({x: F.when(known, F.col(f"__old.{x}")).otherwise(F.col(x)) for x in columns}).drop("__old")


def snapshot_parity(tiles: DataFrame, columns: list[str], path: str) -> DataFrame:
    """One row: tiles and snapshot rows, keys on one side only, and rows whose values differ."""
    old = tiles.sparkSession.read.parquet(path).select("cell", F.struct(*columns).alias("old"))
    both = tiles.select("cell", F.struct(*columns).alias("new")).join(old, "cell", "full")
    return both.agg(F.count("new").alias("tiles"), F.count("old").alias("snapshot_rows"), F.count_if(F.col("new").isNull() | F.col("old").isNull()).alias("one_sided"),
                    F.count_if(F.col("new").isNotNull() & F.col("old").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed"))


def gate_darkness(tiles: DataFrame, version: str, allow_neutral: bool = False) -> DataFrame:
    """One row (tiles, verdict): why a release must not ship, or 'warn' when most penalties equal the density, or 'pass'.

    Darkness is flat when no tile differs from the default or nothing varies; a dry run may allow that.
    """
    g = tiles.agg(F.count("*").alias("tiles"), F.count_if(F.col("scoring_version") == version).alias("at_version"),
                  F.coalesce(F.stddev_pop("darkness_score"), F.lit(0.0)).alias("sd"), F.count_if(F.col("darkness_score") != 0.5).alias("changed"),
                  F.count_if(F.col("building_density_score") == F.col("urban_penalty_score")).alias("equal_penalty"))
    flat = F.lit(not allow_neutral) & ((F.col("changed") == 0) | (F.col("sd") <= 0))
    verdict = (F.when(F.col("tiles") == 0, "no_tiles").when(F.col("at_version") != F.col("tiles"), "mixed_versions").when(flat, "flat_darkness")
               .when(F.col("equal_penalty") >= F.col("tiles"), "urban_equals_building").when(F.col("equal_penalty") / F.col("tiles") > 0.5, "warn").otherwise("pass"))
    return g.select("tiles", verdict.alias("verdict"))


def budget_flags() -> dict[str, Column]:
    t, m = F.col("target_minutes"), F.col("minutes")
    return {"over_budget": m > t + F.greatest(F.lit(5.0), t * 0.15), "under_budget": m < F.greatest(F.lit(10.0), t * 0.55)}


def target_components(vibes) -> Column:
    """Ordered distinct target components of a vibe list."""
    table = F.create_map(*[x for v, p in catalog.VIBE_PROFILES.items() for x in (F.lit(v), F.array(*[F.lit(t) for t in p[2]]))])
    return F.array_distinct(F.flatten(F.transform(vibes, lambda v: table[v])))


# Contract limits, the vibes a flag belongs to, and the messages of broken flags, in their order.
LIMITS = {"closure_km": 3.0, "unique_ratio": 0.72, "repeated_corridor_cell_share": 0.25, "leg_separation_score": 0.35, "backtracking_penalty": 0.35,
          "corridor_urban_pressure": 0.42, "edge_urban_pressure": 0.58, "scenic_peak": 0.42, "score": 0.65, "water": 0.28, "elevation": 0.28, "quiet": 0.32,
          "road_stress_score": 0.48, "tree_canopy_score": 0.26}
FLAG_VIBES = {"water_share_ok": ["coastal", "riverside"], "elevation_curve_share_ok": ["mountain", "winding_roads", "adventure"],
              "quiet_share_ok": ["countryside", "open_roads", "relaxing"], "road_stress_ok": ["countryside", "open_roads", "relaxing"],
              "tree_canopy_ok": ["nature_escape"]}
WARNINGS = {"time_budget_fit": "Route duration does not fit the requested time budget.", "loop_closure": "Route does not close cleanly as a loop.",
            "low_repeated_road_risk": "Route may repeat too much road.",
            "repeated_corridor_ok": "Route reuses too many corridor cells.", "leg_separation_ok": "Route legs may not separate enough.",
            "backtracking_risk_ok": "Route may backtrack too much.", "corridor_urban_pressure_ok": "Route corridor has more urban pressure than expected.",
            "edge_urban_pressure_ok": "Route starts or ends in a more urban area.", "scenic_peak_ok": "Route lacks a strong scenic stretch.",
            "water_share_ok": "Water-focused vibe has low water corridor share.", "elevation_curve_share_ok": "Mountain or winding vibe has weak elevation/curve share.",
            "quiet_share_ok": "Quiet/rural vibe has weak quiet corridor share.", "road_stress_ok": "Quiet/rural vibe uses higher-stress road classes.",
            "tree_canopy_ok": "Nature vibe has weak tree-canopy signal."}


def contract_flags(routes: DataFrame, metrics: str = "metrics", components: str = "components", vibes: str = "vibes") -> DataFrame:
    """The 15 contract flags of each route; flags of other vibes are null.

    Needs minutes, target_minutes, closure_km, unique_ratio (distinct places over points), score, the map `metrics` of
    the score breakdown, the map `components` of tile averages, and the list `vibes`. A metric that is absent counts as
    kept where it is a limit and as 0 where it is a share.
    """
    m, comp = F.col(metrics), F.col(components)

    def known(key):
        return F.when(m[key].isNotNull(), clamp01(m[key]))

    def value(key):
        return F.coalesce(known(key), F.lit(0.0))

    def at_most(limit, *keys):
        return F.coalesce(F.coalesce(*[known(k) for k in keys]) <= limit, F.lit(True))

    def at_least(limit, key):
        return F.coalesce(known(key) >= limit, F.lit(True))

    def best(key, component):
        return clamp01(F.greatest(value(key), F.coalesce(comp[component], F.lit(0.0))))

    b, target = budget_flags(), F.coalesce(F.col("target_minutes"), F.lit(0))
    urban = at_most(LIMITS["corridor_urban_pressure"], "corridor_urban_pressure", "urban_penalty")
    flags = {"time_budget_fit": (target <= 0) | (~b["over_budget"] & ~b["under_budget"]),
             "loop_closure": F.coalesce(F.col("closure_km"), F.lit(0.0)) <= LIMITS["closure_km"],
             "low_repeated_road_risk": F.coalesce(F.col("unique_ratio"), F.lit(1.0)) >= LIMITS["unique_ratio"],
             "repeated_corridor_ok": at_most(LIMITS["repeated_corridor_cell_share"], "repeated_corridor_cell_share"),
             "leg_separation_ok": at_least(LIMITS["leg_separation_score"], "leg_separation_score"),
             "backtracking_risk_ok": at_most(LIMITS["backtracking_penalty"], "backtracking_penalty"),
             "corridor_urban_pressure_ok": urban,
             "edge_urban_pressure_ok": at_most(LIMITS["edge_urban_pressure"], "edge_urban_pressure", "start_end_penalty"),
             "urban_pressure_ok": urban,
             "scenic_peak_ok": (F.greatest(value("scenic_moments_score"), value("photo_peak_score")) >= LIMITS["scenic_peak"])
             | F.coalesce(F.col("score") >= LIMITS["score"], F.lit(False)),
             "water_share_ok": F.greatest(best("water_corridor_share", "water"), value("bridge_coastal_score")) >= LIMITS["water"],
             "elevation_curve_share_ok": best("curve_elevation_corridor_share", "elevation") >= LIMITS["elevation"],
             "quiet_share_ok": best("quiet_corridor_share", "solitude") >= LIMITS["quiet"],
             "road_stress_ok": at_most(LIMITS["road_stress_score"], "road_stress_score"),
             "tree_canopy_ok": at_least(LIMITS["tree_canopy_score"], "tree_canopy_score")}
    for name, wanted in FLAG_VIBES.items():
        flags[name] = F.when(F.arrays_overlap(F.col(vibes), F.array(*[F.lit(v) for v in wanted])), flags[name])
    return routes.withColumns(flags)


def contract_warnings() -> Column:
    """Messages of the broken flags, in fixed order; flags of other vibes say nothing."""
    return F.filter(F.array(*[F.when(~F.col(k), F.lit(v)) for k, v in WARNINGS.items()]), lambda w: w.isNotNull())


def unique_ratio(points: DataFrame) -> DataFrame:
    """Distinct places at five digits over the points of each route; 1 for fewer than two points."""
    place = F.concat_ws(",", F.round("lon", 5), F.round("lat", 5))
    per = points.groupBy("route_id", place.alias("place")).agg(F.count("*").alias("n"))
    n = F.sum("n")
    return per.groupBy("route_id").agg(F.when(n < 2, 1.0).otherwise(F.count("*") / n).alias("unique_ratio"))


# Codes, texts and suggestions shown for a failed job.
FAILED_TEXT = "Route generation failed. Try a different starting point, more time, or another vibe."
FAILED_VIBES = ["countryside", "open_roads"]
FAILED_ACTIONS = ["Try Country", "Try Open Road", "Increase time budget"]
NEXT_VIBES = {"countryside": ["open_roads", "relaxing", "nature_escape"], "mountain": ["adventure", "winding_roads", "open_roads"]}
OTHER_VIBES = ["countryside", "open_roads", "relaxing"]


def failure_guidance(status: str = "status", reason: str = "failure_reason", vibes: str = "vibes", minutes: str = "target_minutes") -> dict[str, Column]:
    """Code, message, suggested vibes and suggested actions of a job; null and empty unless it has failed.

    A vibe that cannot be met nearby leads to related vibes that were not asked for, and to the next larger budget.
    """
    def words(items):
        return F.array(*[F.lit(i) for i in items])

    failed = F.coalesce(F.col(status) == "FAILED", F.lit(False))
    told = F.when(F.trim(F.coalesce(F.col(reason), F.lit(""))) != "", F.col(reason))
    unmet = F.coalesce(F.lower(told).contains("no strong ") | F.lower(told).contains("no feasible route found"), F.lit(False))
    related = words(OTHER_VIBES)
    for vibe, items in reversed(NEXT_VIBES.items()):
        related = F.when(F.array_contains(vibes, vibe), words(items)).otherwise(related)
    budget = F.col(minutes)
    longer = F.when(budget < 60, 60).when(budget < 90, 90).when(budget < 120, 120).otherwise(budget + 30)
    actions = F.array(F.lit("Try Country"), F.lit("Try Open Road"), F.format_string("Increase time budget to %d minutes", longer.cast("int")),
                      F.lit("Move the start point farther from downtown"))
    none = F.array().cast("array<string>")
    return {"code": F.when(failed & unmet, "vibe_unavailable").when(failed, "route_generation_failed"), "message": F.when(failed, F.coalesce(told, F.lit(FAILED_TEXT))),
            "suggested_vibes": F.when(failed & unmet, F.array_except(related, F.col(vibes))).when(failed, words(FAILED_VIBES)).otherwise(none),
            "suggested_actions": F.when(failed & unmet, actions).when(failed, words(FAILED_ACTIONS)).otherwise(none)}
