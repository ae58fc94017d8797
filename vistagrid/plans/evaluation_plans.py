"""Quality evaluation of runs: target signals, fallback flags, scenario flags and summaries, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, text
from vistagrid.operators import evaluation as ev
from vistagrid.operators import quality as qu
from vistagrid.plans import sqlgen as q
from vistagrid.plans.quality_plans import METRICS
from vistagrid.plans.registry import oracle, query
from vistagrid.sources.fixtures import domain

EXPECTED = "planner_v2"
RUN, LATER = ["eval_scenarios", "eval_options"], ["later_scenarios", "later_options"]
# Component maps of an option: key -> column, for averages, lifts and contributions.
MAPS = {"averages": {"water": "avg_a", "curves": "avg_b", "solitude": "avg_a", "greenery": "avg_b"}, "lifts": {"water": "lift_a", "elevation": "lift_a", "solitude": "avg_b"}, "contributions": {"water": "share_a", "solitude": "share_a", "curves": "avg_b"}}


def scenarios(spark, sf, name="eval_scenarios"):
    s = domain(spark, sf, name).withColumn("vibes", text.parse_vibes("vibes_json"))
    return s.withColumn("targets", qu.target_components(F.col("vibes")))


def options(spark, sf, name="eval_options"):
    o = domain(spark, sf, name)
    maps = {m: F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("v")) for k, c in keys.items()]), lambda e: e["v"].isNotNull())) for m, keys in MAPS.items()}
    return o.withColumns(maps | {"failed_flags": F.split("failed_text", r"\|")})


def evaluated(spark, sf):
    s = scenarios(spark, sf)
    return ev.scenario_flags(s, ev.target_signal(options(spark, sf).join(s.select("scenario_id", "targets"), "scenario_id")), EXPECTED)


_targets = q.values([(v, t, i) for v, p in catalog.VIBE_PROFILES.items() for i, t in enumerate(p[2])], "vibe, target, o")
_maps = q.values([(m, k, c) for m, keys in MAPS.items() for k, c in keys.items()], "name, target, source")
_TARGETS = f"""wanted AS (SELECT scenario_id, target, min(pos * 10 + o) AS p FROM (SELECT scenario_id, unnest(v) AS vibe, generate_subscripts(v, 1) AS pos FROM (
      SELECT scenario_id, CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) AS v FROM eval_scenarios)) JOIN {_targets} USING (vibe) GROUP BY 1, 2),
  named AS (SELECT scenario_id, string_agg(target, '+' ORDER BY p) AS targets FROM wanted GROUP BY 1),
  long_values AS (SELECT * FROM (SELECT scenario_id, option_no, avg_a, avg_b, lift_a, share_a FROM eval_options) UNPIVOT INCLUDE NULLS (value FOR source IN (avg_a, avg_b, lift_a, share_a))),
  means AS (SELECT l.scenario_id, l.option_no, avg(value) FILTER (m.name = 'averages') AS target_average, avg(value) FILTER (m.name = 'lifts') AS target_lift, avg(value) FILTER (m.name = 'contributions') AS target_contribution
    FROM long_values l JOIN {_maps} m USING (source) JOIN wanted w ON w.scenario_id = l.scenario_id AND w.target = m.target GROUP BY 1, 2),
  opts AS (SELECT o.*, m.target_average, m.target_lift, m.target_contribution FROM eval_options o JOIN eval_scenarios s USING (scenario_id) LEFT JOIN means m ON m.scenario_id = o.scenario_id AND m.option_no = o.option_no)"""


@query("target_signals", oracle(RUN, "SELECT scenario_id, option_no, target_average, target_lift, target_contribution FROM opts", "target_average target_lift target_contribution", _TARGETS))
def target_signals(spark, sf):
    s = scenarios(spark, sf).select("scenario_id", "targets")
    return ev.target_signal(options(spark, sf).join(s, "scenario_id")).select("scenario_id", "option_no", "target_average", "target_lift", "target_contribution")


_over = "o.duration_minutes > s.budget + greatest(5e0, s.budget * 0.15e0)"
_under = "o.duration_minutes < greatest(10e0, s.budget * 0.55e0)"


def _named(at: int, code: str, rule: str, what: str = "o.profile") -> str:
    """Flag `code:a+b` over the options for which a rule holds, names in the order of the options, each once."""
    return f"""SELECT scenario_id, {at} AS place, '' AS part, '{code}:' || string_agg(what, '+' ORDER BY first) AS flag FROM (
      SELECT s.scenario_id, {what} AS what, min(o.option_no) AS first FROM live s JOIN opts o USING (scenario_id) WHERE {rule} GROUP BY 1, 2) GROUP BY 1"""


def _single(at: int, code: str, condition: str) -> str:
    return f"SELECT scenario_id, {at}, '', '{code}' FROM sums WHERE {condition}"


_FLAGS = f"""{_TARGETS}, live AS (SELECT * FROM eval_scenarios WHERE status = 'COMPLETED'),
  sums AS (SELECT s.scenario_id, any_value(s.budget) AS budget, any_value(s.min_separation_km) AS sep, count(o.option_no) AS n, max(scenic_score) - min(scenic_score) AS score_spread, count(scenic_score) AS scores, max(scenic_score) AS top,
      max(duration_minutes) - min(duration_minutes) AS time_spread, count(duration_minutes) AS times, count(*) FILTER (o.option_no IS NOT NULL AND NOT coalesce(has_explanation, false)) AS unexplained,
      count(*) FILTER (o.option_no IS NOT NULL AND final_score IS NULL) AS unscored, count(DISTINCT lead_part) AS leads, max(lead_part) AS lead_name FROM live s LEFT JOIN opts o USING (scenario_id) GROUP BY 1),
  firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY CASE WHEN profile = 'most_scenic' THEN 0 ELSE 1 END, option_no) AS rn FROM opts) WHERE rn = 1),
  broken AS (SELECT scenario_id, f, profile, min(option_no) AS first FROM (SELECT scenario_id, profile, option_no, unnest(string_split(failed_text, '|')) AS f FROM opts) WHERE f <> '' GROUP BY 1, 2, 3),
  raised AS (SELECT scenario_id, 0 AS place, '' AS part, CASE WHEN failure_reason LIKE 'No strong %' THEN 'vibe_unavailable' WHEN failure_reason LIKE 'No scenic data found%' THEN 'scenic_data_unavailable' ELSE 'job_not_completed' END AS flag
      FROM eval_scenarios WHERE status IS DISTINCT FROM 'COMPLETED'
    UNION ALL SELECT scenario_id, 1, '', 'no_route_options' FROM sums WHERE n = 0 UNION ALL {_single(2, 'fewer_than_three_options', 'n BETWEEN 1 AND 2')}
    UNION ALL {_named(3, 'over_budget', _over)} UNION ALL {_named(4, 'under_budget', _under)}
    UNION ALL {_single(5, 'low_scenic_spread', 'scores >= 2 AND score_spread < CASE WHEN top > 1.5 THEN 2.5e0 ELSE 0.025e0 END')} UNION ALL {_single(6, 'low_duration_spread', 'times >= 2 AND time_spread < greatest(4e0, budget * 0.08e0)')}
    UNION ALL {_single(7, 'low_geometry_separation', 'n > 0 AND sep < 0.35')} UNION ALL {_single(8, 'missing_explanations', 'unexplained > 0')} UNION ALL {_single(9, 'missing_v2_breakdown', 'unscored > 0')}
    UNION ALL {_named(10, 'unexpected_algorithm', f"o.algorithm <> '' AND o.algorithm <> '{EXPECTED}'", 'o.algorithm')} UNION ALL {_named(11, 'weak_strategy_fit', 'o.strategy_fit < 0.30')} UNION ALL {_named(12, 'strategy_mismatch', 'o.strategy_mismatch > 0.50')}
    UNION ALL SELECT scenario_id, 13, f, 'contract_failed:' || f || ':' || string_agg(profile, '+' ORDER BY first) FROM broken JOIN live USING (scenario_id) GROUP BY scenario_id, f
    UNION ALL SELECT scenario_id, 14, '', 'same_leading_component:' || lead_name FROM sums WHERE leads = 1 AND n > 1
    UNION ALL SELECT f.scenario_id, 15, '', 'weak_vibe_signal:' || n.targets FROM firsts f JOIN live USING (scenario_id) JOIN named n USING (scenario_id)
      WHERE coalesce(target_average < 0.22, false) OR (coalesce(target_contribution < 0.08, false) AND coalesce(abs(target_lift) < 0.03, false)))"""


@query("scenario_flags", oracle(RUN, "SELECT scenario_id, string_agg(flag, ',' ORDER BY place, part) AS flags FROM (SELECT scenario_id, place, part, flag FROM raised UNION ALL SELECT scenario_id, 99, '', NULL FROM eval_scenarios) GROUP BY 1", extra=_FLAGS))
def scenario_flags(spark, sf):
    return evaluated(spark, sf).select("scenario_id", F.when(F.size("flags") > 0, F.array_join("flags", ",")).alias("flags"))


@query("flag_counts", oracle(RUN, "SELECT flag, count(*) AS n FROM raised GROUP BY 1", extra=_FLAGS))
def flag_counts(spark, sf):
    return ev.flag_counts(evaluated(spark, sf))


@query("scenario_summaries", oracle(RUN, """SELECT s.scenario_id, s.status, count(o.option_no) AS options, CASE WHEN count(scenic_score) >= 2 THEN max(scenic_score) - min(scenic_score) END AS score_spread,
    CASE WHEN count(duration_minutes) >= 2 THEN (max(duration_minutes) - min(duration_minutes))::DOUBLE END AS duration_spread, any_value(s.min_separation_km) AS min_separation_km, avg(final_score) AS avg_final_score,
    avg(strategy_fit) AS avg_strategy_fit, avg(strategy_mismatch) AS avg_strategy_mismatch, coalesce((SELECT string_agg(algorithm, '+' ORDER BY first) FROM (SELECT algorithm, min(option_no) AS first FROM opts x WHERE x.scenario_id = s.scenario_id AND algorithm <> '' GROUP BY 1)), '') AS algorithms,
    (SELECT count(*) FROM raised r WHERE r.scenario_id = s.scenario_id) AS flag_count FROM eval_scenarios s LEFT JOIN opts o USING (scenario_id) GROUP BY s.scenario_id, s.status""",
                                    "score_spread duration_spread min_separation_km avg_final_score avg_strategy_fit avg_strategy_mismatch", _FLAGS))
def scenario_summaries(spark, sf):
    return ev.scenario_summary(evaluated(spark, sf))


_m = {k: f"({v})" for k, v in METRICS.items()} | {"scenic_poi_score": "(strategy_fit_score / 2)", "viewpoint_score": "(CASE WHEN candidate_id % 4 = 0 THEN NULL ELSE urban_penalty / 2 END)"}
_urban = f"coalesce({_m['corridor_urban_pressure']}, {_m['urban_penalty']}) <= 0.42"
_fallback = {
    "time_budget_fit": "CASE WHEN candidate_id % 12 <> 0 THEN minutes <= target_minutes + greatest(5e0, target_minutes * 0.15e0) AND minutes >= greatest(10e0, target_minutes * 0.55e0) END",
    "loop_closure": "CASE WHEN candidate_id % 13 <> 0 THEN km / 20 <= 3 END", "low_repeated_road_risk": "candidate_id * 47 % 101 / 100e0 >= 0.72", "repeated_corridor_ok": f"{_m['repeated_corridor_cell_share']} <= 0.25",
    "leg_separation_ok": f"{_m['leg_separation_score']} >= 0.35", "backtracking_risk_ok": f"{_m['backtracking_penalty']} <= 0.35", "corridor_urban_pressure_ok": _urban, "urban_pressure_ok": _urban,
    "edge_urban_pressure_ok": f"coalesce({_m['edge_urban_pressure']}, {_m['start_end_penalty']}) <= 0.58", "road_stress_ok": f"{_m['road_stress_score']} <= 0.48", "tree_canopy_ok": f"{_m['tree_canopy_score']} >= 0.26",
    "scenic_peak_ok": f"coalesce(greatest({_m['scenic_moments_score']}, {_m['photo_peak_score']}) >= 0.42, CASE WHEN shown > 1.5 THEN shown / 100 ELSE shown END >= 0.65)",
    "water_share_ok": f"greatest({_m['water_corridor_share']}, {_m['bridge_coastal_score']}) >= 0.28", "elevation_curve_share_ok": f"{_m['curve_elevation_corridor_share']} >= 0.28", "quiet_share_ok": f"{_m['quiet_corridor_share']} >= 0.32",
    "photo_poi_signal_ok": f"greatest({_m['photo_peak_score']}, {_m['scenic_poi_score']}, {_m['viewpoint_score']}) >= 0.30"}
_fallback = {k: f"CASE WHEN list_has_any(v, {ev.FALLBACK_VIBES[k]}) THEN {e} END" if k in ev.FALLBACK_VIBES else e for k, e in _fallback.items()}
_SHOWN = "CASE WHEN candidate_id % 2 = 0 THEN score * 100 ELSE score END"


@query("fallback_flags", oracle(["candidates"], "SELECT candidate_id, " + ", ".join(f"{e} AS {k}" for k, e in _fallback.items()) + f""" FROM (SELECT *, {_SHOWN} AS shown,
    list_append(CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]), CASE candidate_id % 5 WHEN 0 THEN 'photo' WHEN 1 THEN 'forest' ELSE 'none' END) AS v FROM candidates)"""))
def fallback_flags(spark, sf):
    c = domain(spark, sf, "candidates")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).cast("double").alias("value")) for k, v in _m.items()])
    vibes = F.array_append(text.parse_vibes("vibes_json"), F.when(F.col("candidate_id") % 5 == 0, "photo").when(F.col("candidate_id") % 5 == 1, "forest").otherwise("none"))
    rows = c.select("candidate_id", "minutes", F.expr("CASE WHEN candidate_id % 12 = 0 THEN 0 ELSE target_minutes END").alias("target_minutes"), F.expr("CASE WHEN candidate_id % 13 <> 0 THEN km / 20 END").alias("closure_km"),
                    (F.col("candidate_id") * 47 % 101 / 100.0).alias("unique_ratio"), F.expr(_SHOWN).alias("score"), vibes.alias("vibes"), F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("metrics"))
    return ev.fallback_contract_flags(rows).select("candidate_id", *ev.FALLBACK_FLAGS)


def compared(spark, sf):
    return ev.compare_evals((scenarios(spark, sf), options(spark, sf)), (scenarios(spark, sf, "later_scenarios"), options(spark, sf, "later_options")))


_deltas = ", ".join(f"(a.{s} - b.{s})::DOUBLE AS {s}_delta" for s in ev.SIGNALS)
_COMPARE = f"""spelled AS (SELECT scenario_id, string_agg(vibe, '+' ORDER BY p) AS vibes FROM (SELECT scenario_id, vibe, min(p) AS p FROM (SELECT scenario_id, unnest(v) AS vibe, generate_subscripts(v, 1) AS p FROM (
      SELECT scenario_id, CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) AS v FROM eval_scenarios)) GROUP BY 1, 2) GROUP BY 1),
  both_runs AS (SELECT s.scenario_id, vibes, s.status AS before_status, l.status AS after_status FROM eval_scenarios s JOIN later_scenarios l USING (scenario_id) JOIN spelled USING (scenario_id)),
  pts_b AS (SELECT scenario_id, profile, unnest(points).lat AS lat, unnest(points).lon AS lon, generate_subscripts(points, 1) AS i FROM eval_options), pts_a AS (SELECT scenario_id, profile, unnest(points).lat AS lat, unnest(points).lon AS lon, generate_subscripts(points, 1) AS i FROM later_options),
  there AS (SELECT p.scenario_id, p.profile, p.i, min({q.hav('p.lat', 'p.lon', 'r.lat', 'r.lon', '6371.0088e0')}) AS m FROM pts_b p JOIN pts_a r USING (scenario_id, profile) GROUP BY 1, 2, 3),
  back AS (SELECT p.scenario_id, p.profile, p.i, min({q.hav('p.lat', 'p.lon', 'r.lat', 'r.lon', '6371.0088e0')}) AS m FROM pts_a p JOIN pts_b r USING (scenario_id, profile) GROUP BY 1, 2, 3),
  apart AS (SELECT scenario_id, profile, (x.m + y.m) / 2 AS geometry_km FROM (SELECT scenario_id, profile, avg(m) AS m FROM there GROUP BY 1, 2) x JOIN (SELECT scenario_id, profile, avg(m) AS m FROM back GROUP BY 1, 2) y USING (scenario_id, profile)),
  compared AS (SELECT s.scenario_id, p.profile, s.vibes, before_status, after_status, b.route_id AS before_route_id, a.route_id AS after_route_id, {_deltas}, {', '.join(f'a.{k} AS after_{k}' for k in ev.KEPT)}, geometry_km,
      coalesce(geometry_km >= 0.20, false) AS geometry_changed, a.summary IS DISTINCT FROM b.summary AS explanation_changed
    FROM both_runs s CROSS JOIN (VALUES {', '.join(f"('{p}')" for p in catalog.PROFILES)}) p(profile) LEFT JOIN eval_options b ON b.scenario_id = s.scenario_id AND b.profile = p.profile
      LEFT JOIN later_options a ON a.scenario_id = s.scenario_id AND a.profile = p.profile LEFT JOIN apart d ON d.scenario_id = s.scenario_id AND d.profile = p.profile),
  fair AS (SELECT * FROM compared WHERE before_status = 'COMPLETED' AND after_status = 'COMPLETED')"""
_DOUBLES = " ".join([*[f"{s}_delta" for s in ev.SIGNALS], *[f"after_{k}" for k in ev.KEPT], "geometry_km"])


@query("compared_evals", oracle([*RUN, *LATER], "SELECT * FROM compared", _DOUBLES, _COMPARE))
def compared_evals(spark, sf):
    return compared(spark, sf)


@query("comparison_summary", oracle([*RUN, *LATER], """SELECT count(*) AS rows, count(*) FILTER (geometry_changed) AS geometry_changed, count(*) FILTER (abs(final_score_delta) >= 0.005) AS score_changed, count(*) FILTER (after_viewpoint > 0.01) AS with_viewpoint,
    count(*) FILTER (after_bridge_coastal > 0.01) AS with_bridge_coastal, count(*) FILTER (regexp_matches(vibes, 'photo|coastal|date|sunset|hidden')) AS photo_coastal, avg(geometry_km) AS avg_geometry_km, avg(final_score_delta) AS avg_score_delta,
    avg(after_viewpoint) AS avg_viewpoint, avg(after_bridge_coastal) AS avg_bridge_coastal FROM fair""", "avg_geometry_km avg_score_delta avg_viewpoint avg_bridge_coastal", _COMPARE))
def comparison_summary(spark, sf):
    return ev.compare_summary(compared(spark, sf))


@query("top_changes", oracle([*RUN, *LATER], """SELECT 'geometry' AS kind, scenario_id, profile, geometry_km FROM (SELECT * FROM fair ORDER BY round(geometry_km, 6) DESC NULLS LAST, scenario_id, profile LIMIT 10)
    UNION ALL SELECT 'signal', scenario_id, profile, geometry_km FROM (SELECT * FROM fair ORDER BY after_viewpoint DESC NULLS LAST, after_bridge_coastal DESC NULLS LAST, scenario_id, profile LIMIT 12)""", "geometry_km", _COMPARE))
def top_changes(spark, sf):
    c = compared(spark, sf).withColumn("rounded_km", F.round("geometry_km", 6))
    pick = lambda kind, df: df.select(F.lit(kind).alias("kind"), "scenario_id", "profile", "geometry_km")
    return pick("geometry", ev.top_changes(c, 10, "rounded_km")).unionByName(pick("signal", ev.top_changes(c, 12, "after_viewpoint", "after_bridge_coastal")))
