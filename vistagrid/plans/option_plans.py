"""Option selection queries over candidates, routes and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.operators import options as op
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.sources.fixtures import domain

CANDS = "candidates"
BEST = """best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY request_id, signature ORDER BY floor(score / 0.0001) DESC, minutes, km, candidate_id) AS rn FROM candidates) WHERE rn = 1)"""
MAXMIN = "greatest(target_minutes, least(CAST(ceil(target_minutes * 1.15e0) AS BIGINT), target_minutes + greatest(3, least(10, CAST(ceil(target_minutes * 0.15e0) AS BIGINT)))))"


def cands(spark, sf):
    return domain(spark, sf, CANDS)


@query("deduplicated_candidates", oracle([CANDS], "SELECT request_id, signature, candidate_id, score, minutes FROM best", "score", BEST))
def deduplicated_candidates(spark, sf):
    c = cands(spark, sf)
    return op.union_candidates(c.where("candidate_id % 2 = 0"), c.where("candidate_id % 2 = 1")).select("request_id", "signature", "candidate_id", "score", "minutes")


@query("interleaved_lists", oracle([CANDS], """SELECT candidate_id, CASE WHEN candidate_id % 2 = 0 THEN minutes * 2 ELSE minutes * 2 + 1 END AS slot FROM candidates"""))
def interleaved_lists(spark, sf):
    c = cands(spark, sf).select("candidate_id", F.col("minutes").alias("position"))
    return op.interleave(c.where("candidate_id % 2 = 0"), c.where("candidate_id % 2 = 1")).select("candidate_id", "slot")


@query("max_minutes", oracle([CANDS], f"SELECT candidate_id, {MAXMIN} AS max_minutes, minutes <= {MAXMIN} AS fits FROM candidates"))
def max_minutes(spark, sf):
    m = op.max_minutes(F.col("target_minutes"))
    return cands(spark, sf).select("candidate_id", m.alias("max_minutes"), (F.col("minutes") <= m).alias("fits"))


@query("in_budget_candidates", oracle([CANDS], f"SELECT request_id, count(*) AS n, min(minutes) AS shortest FROM candidates WHERE minutes <= {MAXMIN} GROUP BY 1"))
def in_budget_candidates(spark, sf):
    return op.in_budget(cands(spark, sf)).groupBy("request_id").agg(F.count("*").alias("n"), F.min("minutes").alias("shortest"))


_fit, _urban = "coalesce(strategy_fit_score, 0)", "coalesce(corridor_urban_pressure, urban_penalty, 1)"
STRICT = f"""CASE strategy WHEN 'CURVY_ELEVATION' THEN {_fit} >= 0.32 AND curve_elevation_corridor_share >= 0.28 WHEN 'OPEN_SPACE_ESCAPE' THEN {_fit} >= 0.24 AND {_urban} <= 0.72 AND open_space_corridor_share >= 0.18
    WHEN 'QUIET_LOW_PRESSURE' THEN {_fit} >= 0.3 AND {_urban} <= 0.58 AND quiet_corridor_share >= 0.32 ELSE true END"""


@query("strict_contracts", oracle([CANDS], f"""SELECT candidate_id, request_id FROM (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM candidates WHERE {STRICT})
    WHERE n >= 3 OR strategy NOT IN ('CURVY_ELEVATION', 'OPEN_SPACE_ESCAPE', 'QUIET_LOW_PRESSURE')"""))
def strict_contracts(spark, sf):
    return op.strict_contract(cands(spark, sf)).select("candidate_id", "request_id")


_ratio = "(minutes / greatest(1, target_minutes))"
_sf = f"(1 - least(1e0, abs({_ratio} - 0.78e0) / 0.28e0))"
PROFILE = f"""fitted AS (SELECT *, {q.cl(f'1 - (CASE WHEN minutes <= target_minutes THEN target_minutes - minutes ELSE (minutes - target_minutes) * 2 END) / {MAXMIN}')} AS fit, least(1e0, {_ratio}) AS use,
    {q.cl(f'CASE WHEN {_ratio} < 0.6 THEN {_sf} * least(1e0, {_ratio} / 0.6e0) * 0.55e0 WHEN {_ratio} > 1 THEN {_sf} * greatest(0.35e0, 1 - ({_ratio} - 1) * 2) ELSE {_sf} END')} AS shortfit,
    greatest(0.1e0, max(km) OVER (PARTITION BY request_id)) AS max_km FROM candidates),
  profiles AS (SELECT *, score * 0.74e0 + fit * 0.08e0 + use * 0.18e0 - backtracking_penalty * 0.18e0 AS s_scenic,
    score * 0.46e0 + fit * 0.34e0 + use * 0.12e0 + mean_turn * 0.08e0 - backtracking_penalty * 0.12e0 AS s_balanced,
    shortfit * 0.46e0 + score * 0.28e0 + fit * 0.14e0 + (1 - km / max_km) * 0.08e0 + mean_turn * 0.04e0 - backtracking_penalty * 0.07e0 AS s_shorter,
    CASE WHEN strategy = 'BALANCED_VARIETY' THEN score ELSE {_fit} * 0.42e0 + score * 0.32e0 + (1 - least(1e0, abs(minutes - target_minutes) / target_minutes)) * 0.14e0 + use * 0.08e0 - strategy_mismatch_penalty * 0.18e0 END AS s_primary FROM fitted)"""


@query("profile_scores", oracle([CANDS], "SELECT candidate_id, s_scenic, s_balanced, s_shorter, s_primary FROM profiles", "s_scenic s_balanced s_shorter s_primary", PROFILE))
def profile_scores(spark, sf):
    return op.profile_scores(cands(spark, sf)).select("candidate_id", "s_scenic", "s_balanced", "s_shorter", "s_primary")


@query("flat_score_spread")
def flat_score_spread(spark, sf):
    """Jitter comes from crc32, which the check engine lacks, so there is no SQL twin."""
    return op.flat_score_fallback(cands(spark, sf)).select("candidate_id", "request_id", "flat", "score")


RESCUE = """SELECT request_id, useful, useful < 3 OR hi < need OR hi - lo < gap AS needs_rescue FROM (SELECT request_id, count(*) FILTER (minutes >= ceil(greatest(10e0, target_minutes * 0.55e0))) AS useful,
    max(minutes) AS hi, min(minutes) AS lo, max(ceil(greatest(10e0, target_minutes * 0.55e0))) AS need, max(greatest(4, ceil(target_minutes * 0.08e0))) AS gap FROM {src} GROUP BY 1)"""


@query("rescue_flags", oracle([CANDS], RESCUE.format(src="candidates")))
def rescue_flags(spark, sf):
    return op.rescue_flags(cands(spark, sf))


@query("early_stop_report", oracle([CANDS], f"""SELECT a.request_id, attempts, coalesce(n, 0) AS eligible, attempts >= (CASE WHEN strategy = 'BALANCED_VARIETY' THEN 12 ELSE 24 END) AND coalesce(n, 0) >= 3 AND NOT coalesce(needs_rescue, true) AS may_stop
    FROM (SELECT request_id, count(*) AS attempts, any_value(strategy) AS strategy FROM candidates GROUP BY 1) a LEFT JOIN (SELECT request_id, count(*) AS n FROM ok GROUP BY 1) e USING (request_id)
    LEFT JOIN ({RESCUE.format(src='ok')}) r USING (request_id)""", extra=BEST + f", ok AS (SELECT * FROM best WHERE minutes <= {MAXMIN} AND {STRICT})"))
def early_stop_report(spark, sf):
    return op.early_stop_eligible(cands(spark, sf))


@query("backfilled_profiles", oracle(["routes"], """SELECT route_id, coalesce(route_profile, CASE row_number() OVER (PARTITION BY job_id ORDER BY created_us, route_id) WHEN 1 THEN 'most_scenic' WHEN 2 THEN 'balanced' WHEN 3 THEN 'shorter' END) AS route_profile FROM routes"""))
def backfilled_profiles(spark, sf):
    return op.backfill_profile(domain(spark, sf, "routes")).select("route_id", "route_profile")


@query("assigned_profiles", oracle(["routes"], """SELECT job_id, profile, route_id FROM named UNION ALL SELECT m.job_id, m.profile, s.route_id FROM (
      SELECT j.job_id, p.profile, row_number() OVER (PARTITION BY j.job_id ORDER BY p.o) AS k FROM (SELECT DISTINCT job_id FROM routes) j, (VALUES ('most_scenic', 1), ('balanced', 2), ('shorter', 3)) p(profile, o)
      WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.job_id = j.job_id AND n.profile = p.profile)) m
    JOIN (SELECT job_id, route_id, row_number() OVER (PARTITION BY job_id ORDER BY created_us, route_id) AS k FROM routes WHERE route_id NOT IN (SELECT route_id FROM named)) s ON s.job_id = m.job_id AND s.k = m.k""",
    extra="""named AS (SELECT job_id, profile, route_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, profile ORDER BY created_us, route_id) AS n FROM (
      SELECT *, lower(trim(route_profile)) AS profile FROM routes) WHERE profile IN ('most_scenic', 'balanced', 'shorter')) WHERE n = 1)"""))
def assigned_profiles(spark, sf):
    return op.assign_profiles(domain(spark, sf, "routes"))


LATEST = """SELECT job_id, state_rev, option_rev, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY state_rev DESC, option_rev DESC, event_id) AS n FROM lifecycle) WHERE n = 1"""


@query("latest_states", oracle(["lifecycle"], LATEST))
def latest_states(spark, sf):
    return op.latest_state(domain(spark, sf, "lifecycle"))


PAIRS = f"""even AS (SELECT p.route_id, p.lat, p.lon, t.request_id, t.option_no FROM route_points p JOIN trips t USING (route_id) WHERE n_points <= 80 OR EXISTS (SELECT 1 FROM range(0, 80) r(i) WHERE floor(i * (n_points - 1) / 79e0 + 0.5e0) = p.seq)),
  one_way AS (SELECT request_id, a, b, avg(d) AS m FROM (SELECT x.request_id, x.option_no AS a, y.option_no AS b, x.lat, x.lon, x.rn, min({q.hav('x.lat', 'x.lon', 'y.lat', 'y.lon', '6371e0')}) AS d
    FROM (SELECT *, row_number() OVER () AS rn FROM even) x JOIN even y ON x.request_id = y.request_id AND x.option_no <> y.option_no GROUP BY ALL) GROUP BY ALL),
  seps AS (SELECT request_id, least(a, b) AS first_option, greatest(a, b) AS second_option, avg(m) AS separation_km FROM one_way GROUP BY ALL),
  keyed AS (SELECT DISTINCT t.request_id, t.option_no, format('{{:.3f}},{{:.3f}}', round(round(lat * 1e6) / 1e3) / 1e3, round(round(lon * 1e6) / 1e3) / 1e3) AS k FROM route_points p JOIN trips t USING (route_id)
    WHERE seq % greatest(1, CAST(ceil(n_points / 96e0) AS BIGINT)) = 0 OR seq = n_points - 1),
  sizes AS (SELECT request_id, option_no, count(*) AS n FROM keyed GROUP BY ALL),
  overlap AS (SELECT x.request_id, x.option_no AS a, y.option_no AS b, count(*) AS common FROM keyed x JOIN keyed y ON x.request_id = y.request_id AND x.k = y.k AND x.option_no < y.option_no GROUP BY ALL),
  pairs AS (SELECT s.*, coalesce(common, 0) / (x.n + y.n - coalesce(common, 0)) AS similarity, abs(ta.minutes - tb.minutes) < greatest(4, ceil(ta.target_minutes * 0.08e0)) AND abs(ta.km - tb.km) < greatest(2e0, least(ta.km, tb.km) * 0.08e0) AS close_call
    FROM seps s JOIN sizes x ON x.request_id = s.request_id AND x.option_no = first_option JOIN sizes y ON y.request_id = s.request_id AND y.option_no = second_option
    LEFT JOIN overlap o ON o.request_id = s.request_id AND o.a = first_option AND o.b = second_option
    JOIN trips ta ON ta.request_id = s.request_id AND ta.option_no = first_option JOIN trips tb ON tb.request_id = s.request_id AND tb.option_no = second_option)"""


def trip_pairs(spark, sf):
    arrays = op.path_arrays(domain(spark, sf, "route_points"))
    t = domain(spark, sf, "trips").select("request_id", "option_no", "route_id", "minutes", "km", "target_minutes").join(arrays, "route_id")
    p = op.with_separation(op.option_pairs(t), "a_pts", "b_pts", "separation_km")
    return p.select("request_id", F.col("a_option_no").alias("first_option"), F.col("b_option_no").alias("second_option"),
                    "separation_km", op.jaccard("a_keys", "b_keys").alias("similarity"), op.gaps_small("a_", "b_").alias("close_call"))


@query("option_pair_measures", oracle(["route_points", "trips"], "SELECT * FROM pairs", "separation_km similarity", PAIRS))
def option_pair_measures(spark, sf):
    return trip_pairs(spark, sf)


@query("option_pair_diversity", oracle(["route_points", "trips"], """SELECT request_id, first_option, second_option, greatest(CASE WHEN separation_km < 0.35 THEN (0.35e0 - separation_km) * 0.65e0 ELSE 0e0 END,
    CASE WHEN similarity > 0.72 THEN 0.28e0 + similarity - 0.72e0 ELSE 0e0 END, CASE WHEN similarity > 0.5 AND close_call THEN 0.18e0 ELSE 0e0 END) AS penalty,
    separation_km >= 0.35 AND similarity <= 0.72 AND NOT (similarity > 0.5 AND close_call) AS different FROM pairs""", "penalty", PAIRS))
def option_pair_diversity(spark, sf):
    m = (F.col("separation_km"), F.col("similarity"), F.col("close_call"))
    return trip_pairs(spark, sf).select("request_id", "first_option", "second_option", op.pair_penalty(*m).alias("penalty"), op.pair_different(*m).alias("different"))


@query("min_option_separation", oracle(["route_points", "trips"], "SELECT request_id, min(separation_km) AS min_separation_km, count(*) AS pairs FROM pairs GROUP BY 1", "min_separation_km", PAIRS))
def min_option_separation(spark, sf):
    return trip_pairs(spark, sf).groupBy("request_id").agg(F.min("separation_km").alias("min_separation_km"), F.count("*").alias("pairs"))


@query("selected_options")
def selected_options(spark, sf):
    """Greedy choice of three trips out of each group of six."""
    t = domain(spark, sf, "trips")
    c = t.select(F.col("route_id").alias("candidate_id"), F.floor(F.col("route_id") / 6).alias("request_id"), F.col("route_id").cast("string").alias("signature"),
                 ((F.col("route_id") * 61 % 97) / 96.0).alias("score"), "minutes", "km", F.lit(90).alias("target_minutes"), F.lit("BALANCED_VARIETY").alias("strategy"),
                 ((F.col("route_id") * 7 % 11) / 10.0).alias("mean_turn"), F.lit(0.0).alias("backtracking_penalty"), F.lit(0.0).alias("strategy_fit_score"),
                 F.lit(0.0).alias("strategy_mismatch_penalty"))
    arrays = op.path_arrays(domain(spark, sf, "route_points")).withColumnRenamed("route_id", "candidate_id")
    return op.select_options(op.profile_scores(c), arrays)
