"""Quality evaluation: flags of scenarios and their options, summaries, and the comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog
from vistagrid.functions import geo
from vistagrid.operators.quality import LIMITS

# Fixed values of the evaluation rules.
TARGETS = ["targetAverage", "targetLift", "targetContribution"]
SPREAD, SPREAD_PERCENT, SEPARATION_KM = 0.025, 2.5, 0.35
WEAK_FIT, MISMATCH, WEAK_AVERAGE, WEAK_SHARE, FLAT_LIFT = 0.30, 0.50, 0.22, 0.08, 0.03
GEOMETRY_KM, GEOMETRY_SAMPLES, SCORE_CHANGE, PRESENT = 0.20, 60, 0.005, 0.01
EARTH_KM = 6371.0088
# Signals of an option that two runs are compared by.
SIGNALS = ["distance_km", "duration_minutes", "final_score", "scenic_poi", "water_share", "photo_peak", "backtracking"]
KEPT = ["viewpoint", "bridge_coastal"]
# Vibes, older spellings included, to which a fallback flag belongs.
FALLBACK_VIBES = {
    "road_stress_ok": ["countryside", "sunday_cruise", "quiet", "minimal_traffic", "low_traffic", "open_roads", "relaxing", "clear_my_head", "smooth_cruise"],
    "tree_canopy_ok": ["forest", "nature_escape", "nature"],
    "water_share_ok": ["coastal", "riverside", "sunset", "golden_hour", "sunrise", "date_night", "photo_worthy", "photo_run", "photo"],
    "elevation_curve_share_ok": ["mountain", "winding_roads", "winding", "adventure"],
    "quiet_share_ok": ["countryside", "country", "sunday", "sunday_cruise", "quiet", "minimal_traffic", "low_traffic", "relaxing", "open_roads"],
    "photo_poi_signal_ok": ["photo_worthy", "photo_run", "photo", "date_night", "hidden_gems"]}
PHOTO_MIN = 0.30
FALLBACK_FLAGS = ["time_budget_fit", "loop_closure", "low_repeated_road_risk", "repeated_corridor_ok", "leg_separation_ok", "backtracking_risk_ok", "corridor_urban_pressure_ok", "urban_pressure_ok",
                  "edge_urban_pressure_ok", "road_stress_ok", "tree_canopy_ok", "scenic_peak_ok", "water_share_ok", "elevation_curve_share_ok", "quiet_share_ok", "photo_poi_signal_ok"]


def mean_of_keys(values: Column, keys: Column) -> Column:
    """Mean of a map's values under the given keys; keys that it lacks do not count, none gives null."""
    found = F.filter(F.transform(keys, lambda k: values[k]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x) / F.size(found))


def target_signal(options: DataFrame, targets: str = "targets") -> DataFrame:
    """Adds target_average, target_lift and target_contribution from the maps averages, lifts, contributions."""
    keys = F.col(targets)
    return options.withColumns({f"target_{n}": mean_of_keys(F.col(m), keys) for n, m in (("average", "averages"), ("lift", "lifts"), ("contribution", "contributions"))})


def fallback_contract_flags(routes: DataFrame, metrics: str = "metrics", vibes: str = "vibes") -> DataFrame:
    """Contract flags for runs without explanations: null unless the metric is there and the vibes ask for the flag.

    Needs minutes, target_minutes, closure_km, unique_ratio, score, the map `metrics` and the list `vibes`.
    """
    m = F.col(metrics)
    target, minutes = F.col("target_minutes"), F.col("minutes")

    def at_most(limit, *keys):
        return F.coalesce(*[m[k] for k in keys]) <= limit

    def best_at_least(limit, *keys):
        return F.greatest(*[m[k] for k in keys], F.lit(None).cast("double")) >= limit

    urban = at_most(LIMITS["corridor_urban_pressure"], "corridor_urban_pressure", "urban_penalty")
    score = F.when(F.col("score") > 1.5, F.col("score") / 100.0).otherwise(F.col("score"))
    flags = {"time_budget_fit": F.when(target > 0, (minutes <= target + F.greatest(F.lit(5.0), target * 0.15)) & (minutes >= F.greatest(F.lit(10.0), target * 0.55))),
             "loop_closure": F.col("closure_km") <= LIMITS["closure_km"], "low_repeated_road_risk": F.col("unique_ratio") >= LIMITS["unique_ratio"],
             "repeated_corridor_ok": at_most(LIMITS["repeated_corridor_cell_share"], "repeated_corridor_cell_share"), "leg_separation_ok": m["leg_separation_score"] >= LIMITS["leg_separation_score"],
             "backtracking_risk_ok": at_most(LIMITS["backtracking_penalty"], "backtracking_penalty"), "corridor_urban_pressure_ok": urban, "urban_pressure_ok": urban,
             "edge_urban_pressure_ok": at_most(LIMITS["edge_urban_pressure"], "edge_urban_pressure", "start_end_penalty"), "road_stress_ok": at_most(LIMITS["road_stress_score"], "road_stress_score"),
             "tree_canopy_ok": m["tree_canopy_score"] >= LIMITS["tree_canopy_score"],
             "scenic_peak_ok": F.coalesce(best_at_least(LIMITS["scenic_peak"], "scenic_moments_score", "photo_peak_score"), score >= LIMITS["score"]),
             "water_share_ok": best_at_least(LIMITS["water"], "water_corridor_share", "bridge_coastal_score"), "elevation_curve_share_ok": m["curve_elevation_corridor_share"] >= LIMITS["elevation"],
             "quiet_share_ok": m["quiet_corridor_share"] >= LIMITS["quiet"], "photo_poi_signal_ok": best_at_least(PHOTO_MIN, "photo_peak_score", "scenic_poi_score", "viewpoint_score")}
    for name, wanted in FALLBACK_VIBES.items():
        flags[name] = F.when(F.arrays_overlap(F.col(vibes), F.array(*map(F.lit, wanted))), flags[name])
    return routes.withColumns({k: flags[k] for k in FALLBACK_FLAGS})


# --- scenario flags ---------------------------------------------------------------------------------------------------


OPTION = ["profile", "duration_minutes", "scenic_score", "final_score", "algorithm", "strategy_fit", "strategy_mismatch", "has_explanation", "failed_flags", "lead_part", "target_average", "target_lift", "target_contribution"]


def gathered(scenarios: DataFrame, options: DataFrame) -> DataFrame:
    """Scenarios with their options, a handful each, as one ordered array `o`; the only shuffle of the flags."""
    rows = options.groupBy("scenario_id").agg(F.sort_array(F.collect_list(F.struct("option_no", *OPTION))).alias("o"))
    kind = rows.schema["o"].dataType.simpleString()
    return scenarios.join(rows, "scenario_id", "left").withColumn("o", F.coalesce("o", F.array().cast(kind)))


def _values(field: str) -> Column:
    return F.filter(F.transform("o", lambda x: x[field]), lambda v: v.isNotNull())


def spread(field: str) -> Column:
    """Largest minus smallest value of the options; null for fewer than two values."""
    v = _values(field)
    return F.when(F.size(v) >= 2, F.array_max(v) - F.array_min(v))


def _profiles(rule, unique: bool = False) -> Column:
    names = F.transform(F.filter("o", rule), lambda x: x["profile"])
    return F.array_distinct(names) if unique else names


def _listed(code: str, names: Column) -> Column:
    """[code:a+b] for names that are there."""
    return F.when(F.size(names) > 0, F.array(F.concat(F.lit(f"{code}:"), F.array_join(names, "+"))))


def _when(condition: Column, code: str | Column) -> Column:
    return F.when(condition, F.array(F.lit(code) if isinstance(code, str) else code))


def rules(expected: str) -> list[Column]:
    """The rules of a completed scenario with options, in the order of their flags; each gives an array of flags or null.

    A rule reads single options, all options together, or the scenario: whatever its scope, it is an expression on the one row.
    """
    low = F.greatest(F.lit(10.0), F.col("budget") * 0.55)
    high = F.col("budget") + F.greatest(F.lit(5.0), F.col("budget") * 0.15)
    top = F.array_max(_values("scenic_score"))
    failed = F.array_sort(F.array_distinct(F.flatten(F.transform("o", lambda x: F.coalesce(x["failed_flags"], F.array().cast("array<string>"))))))
    leads = F.array_distinct(_values("lead_part"))
    primary = F.coalesce(F.get(F.filter("o", lambda x: x["profile"] == catalog.PROFILES[0]), F.lit(0)), F.get("o", F.lit(0)))
    weak = F.coalesce(primary["target_average"] < WEAK_AVERAGE, F.lit(False)) | (
        F.coalesce(primary["target_contribution"] < WEAK_SHARE, F.lit(False)) & F.coalesce(F.abs(primary["target_lift"]) < FLAT_LIFT, F.lit(False)))
    return [
        _when(F.size("o") < 3, "fewer_than_three_options"),
        _listed("over_budget", _profiles(lambda x: x["duration_minutes"] > high)),
        _listed("under_budget", _profiles(lambda x: x["duration_minutes"] < low)),
        _when(spread("scenic_score") < F.when(top > 1.5, SPREAD_PERCENT).otherwise(SPREAD), "low_scenic_spread"),
        _when(spread("duration_minutes") < F.greatest(F.lit(4.0), F.col("budget") * 0.08), "low_duration_spread"),
        _when(F.col("min_separation_km") < SEPARATION_KM, "low_geometry_separation"),
        _when(F.exists("o", lambda x: ~F.coalesce(x["has_explanation"], F.lit(False))), "missing_explanations"),
        _when(F.exists("o", lambda x: x["final_score"].isNull()), "missing_v2_breakdown"),
        _listed("unexpected_algorithm", F.array_distinct(F.transform(F.filter("o", lambda x: (x["algorithm"] != "") & (x["algorithm"] != expected)), lambda x: x["algorithm"]))),
        _listed("weak_strategy_fit", _profiles(lambda x: x["strategy_fit"] < WEAK_FIT, unique=True)),
        _listed("strategy_mismatch", _profiles(lambda x: x["strategy_mismatch"] > MISMATCH, unique=True)),
        F.transform(F.filter(failed, lambda f: f != ""), lambda f: F.concat(F.lit("contract_failed:"), f, F.lit(":"), F.array_join(_profiles(lambda x: F.array_contains(x["failed_flags"], f), unique=True), "+"))),
        _when((F.size(leads) == 1) & (F.size("o") > 1), F.concat(F.lit("same_leading_component:"), F.get(leads, F.lit(0)))),
        _when(weak, F.concat(F.lit("weak_vibe_signal:"), F.array_join("targets", "+")))]


def scenario_flags(scenarios: DataFrame, options: DataFrame, expected: str) -> DataFrame:
    """Flags of each scenario in the order of the rules.

    `scenarios`: scenario_id, status, failure_reason, budget, min_separation_km, targets. `options`: scenario_id, option_no and
    OPTION. Scenarios that are not completed, or have no option, get one flag that says why.
    """
    none = F.array().cast("array<string>")
    found = F.flatten(F.array(*[F.coalesce(r, none) for r in rules(expected)]))
    reason = F.coalesce("failure_reason", F.lit(""))
    stopped = F.when(reason.startswith("No strong "), "vibe_unavailable").when(reason.startswith("No scenic data found"), "scenic_data_unavailable").otherwise("job_not_completed")
    done = F.coalesce(F.col("status") == "COMPLETED", F.lit(False))
    flags = F.when(~done, F.array(stopped)).when(F.size("o") == 0, F.array(F.lit("no_route_options"))).otherwise(found)
    return gathered(scenarios, options).withColumn("flags", flags)


def scenario_summary(flagged: DataFrame) -> DataFrame:
    """Number of options, spreads and means per scenario, from `scenario_flags`."""
    mean = lambda field: F.when(F.size(_values(field)) > 0, F.aggregate(_values(field), F.lit(0.0), lambda acc, x: acc + x) / F.size(_values(field)))
    return flagged.select("scenario_id", "status", F.size("o").alias("options"), spread("scenic_score").alias("score_spread"), spread("duration_minutes").cast("double").alias("duration_spread"),
                          "min_separation_km", mean("final_score").alias("avg_final_score"), mean("strategy_fit").alias("avg_strategy_fit"), mean("strategy_mismatch").alias("avg_strategy_mismatch"),
                          F.array_join(F.array_distinct(F.filter(_values("algorithm"), lambda a: a != "")), "+").alias("algorithms"), F.size("flags").alias("flag_count"))


def flag_counts(flagged: DataFrame) -> DataFrame:
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


# --- comparison -------------------------------------------------------------------------------------------------------


def sampled_points(points: Column, most: int = GEOMETRY_SAMPLES) -> Column:
    """At most `most` points at even positions, halves to the even position."""
    n = F.size(points)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(points, F.bround(i * (n - 1) / F.lit(float(most - 1))).cast("int")))
    return F.when(n <= most, points).otherwise(picked)


def geometry_distance_km(a: str, b: str) -> Column:
    """Mean nearest distance both ways of the sampled points; null if either has none."""
    def nearest(x, y):
        d = F.transform(x, lambda p: F.array_min(F.transform(y, lambda r: geo.haversine(p["lat"], p["lon"], r["lat"], r["lon"], EARTH_KM))))
        return F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v) / F.size(x)

    x, y = F.col(a), F.col(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), (nearest(x, y) + nearest(y, x)) / 2.0)


def compare_evals(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One row per scenario that both runs have and profile, with signals before, after and their difference.

    A run is (scenarios: scenario_id, status, vibes; options: scenario_id, profile, option_no, route_id, points, summary,
    SIGNALS, KEPT). Of several options of a profile the last counts. A profile that a run lacks leaves its side null.
    """
    def side(options, name):
        rows = options.where(F.col("profile").isin(catalog.PROFILES)).groupBy("scenario_id", "profile").agg(
            F.max_by(F.struct("route_id", sampled_points(F.col("points")).alias("points"), "summary", *SIGNALS, *KEPT), "option_no").alias(name))
        return rows

    scenarios = before[0].select("scenario_id", "vibes", F.col("status").alias("before_status")).join(after[0].select("scenario_id", F.col("status").alias("after_status")), "scenario_id")
    both = side(before[1], "b").join(side(after[1], "a"), ["scenario_id", "profile"], "full")
    rows = scenarios.withColumn("profile", F.explode(F.array(*map(F.lit, catalog.PROFILES)))).join(both, ["scenario_id", "profile"], "left")
    distance = geometry_distance_km("b.points", "a.points")
    rows = rows.withColumn("geometry_km", distance)
    return rows.select("scenario_id", "profile", F.array_join("vibes", "+").alias("vibes"), "before_status", "after_status", F.col("b.route_id").alias("before_route_id"), F.col("a.route_id").alias("after_route_id"),
                       *[(F.col(f"a.{s}") - F.col(f"b.{s}")).cast("double").alias(f"{s}_delta") for s in SIGNALS], *[F.col(f"a.{k}").alias(f"after_{k}") for k in KEPT],
                       "geometry_km", F.coalesce(F.col("geometry_km") >= GEOMETRY_KM, F.lit(False)).alias("geometry_changed"), (~F.col("a.summary").eqNullSafe(F.col("b.summary"))).alias("explanation_changed"))


def comparable(compared: DataFrame) -> DataFrame:
    return compared.where((F.col("before_status") == "COMPLETED") & (F.col("after_status") == "COMPLETED"))


def compare_summary(compared: DataFrame) -> DataFrame:
    """Counts and means over the comparable rows."""
    return comparable(compared).agg(
        F.count("*").alias("rows"), F.count_if("geometry_changed").alias("geometry_changed"), F.count_if(F.abs("final_score_delta") >= SCORE_CHANGE).alias("score_changed"),
        F.count_if(F.col("after_viewpoint") > PRESENT).alias("with_viewpoint"), F.count_if(F.col("after_bridge_coastal") > PRESENT).alias("with_bridge_coastal"),
        F.count_if(F.col("vibes").rlike("photo|coastal|date|sunset|hidden")).alias("photo_coastal"), F.avg("geometry_km").alias("avg_geometry_km"), F.avg("final_score_delta").alias("avg_score_delta"),
        F.avg("after_viewpoint").alias("avg_viewpoint"), F.avg("after_bridge_coastal").alias("avg_bridge_coastal"))


def top_changes(compared: DataFrame, n: int, *by: str) -> DataFrame:
    """The n comparable rows with the largest values; missing values come last, ties by scenario and profile."""
    return comparable(compared).orderBy(*[F.desc_nulls_last(c) for c in by], "scenario_id", "profile").limit(n)
