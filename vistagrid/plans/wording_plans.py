"""Texts that explain an option."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, text
from vistagrid.operators import status as st
from vistagrid.operators import wording as wd
from vistagrid.plans import sqlgen as q
from vistagrid.plans.quality_plans import AVERAGES, METRICS
from vistagrid.plans.registry import oracle, query
from vistagrid.sources.fixtures import domain

_absent = "CASE WHEN candidate_id % {n} = 0 THEN NULL ELSE {v} END"
VALUES = METRICS | {"water_visibility_score": _absent.format(n=4, v="urban_penalty"), "coastal_road_score": _absent.format(n=3, v="quiet_corridor_share / 2"), "water_crossing_score": _absent.format(n=7, v="mean_turn / 3"),
                    "scenic_poi_score": _absent.format(n=5, v="backtracking_penalty"), "viewpoint_score": _absent.format(n=6, v="urban_penalty / 3"), "open_space_corridor_share": "open_space_corridor_share",
                    "duration_fit_ratio": _absent.format(n=8, v="strategy_mismatch_penalty"), "route_shape_score": "quiet_corridor_share"}
# Every tenth candidate has no metric at all, so that the leading components have to speak.
VALUES = {k: f"CASE WHEN candidate_id % 10 <> 7 THEN {v} END" for k, v in VALUES.items()}
MEANS = {k: f"CASE WHEN candidate_id % 10 <> 7 THEN {v} END" for k, v in AVERAGES.items()} | {"open_space": "CASE WHEN candidate_id % 10 <> 7 THEN mean_turn / 4 END"}
_profile = "CASE candidate_id % 4 WHEN 0 THEN 'most_scenic' WHEN 1 THEN ' Balanced' WHEN 2 THEN 'shorter' END"
_target = "CASE WHEN candidate_id % 12 = 0 THEN 0 ELSE target_minutes END"


def option_rows(spark, sf):
    c = domain(spark, sf, "candidates")

    def table(rules):
        entries = F.array(*[F.struct(F.lit(k).alias("key"), F.expr(v).cast("double").alias("value")) for k, v in rules.items()])
        return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))

    leads = F.when(F.col("candidate_id") % 20 == 17, F.array().cast("array<string>")).otherwise(F.array(*[F.element_at(F.array(*map(F.lit, wd.PHRASES)), (F.col("candidate_id") * k % 7 + 1).cast("int")) for k in (1, 3, 5)]))
    return c.select("candidate_id", "minutes", F.expr(_target).alias("target_minutes"), F.expr(_profile).alias("route_profile"), text.parse_vibes("vibes_json").alias("vibes"), table(VALUES).alias("metrics"), table(MEANS).alias("components"), leads.alias("leading_components"))


def _m(name: str) -> str:
    return q.cl(f"coalesce({VALUES[name]}, 0e0)")


def _s(metric: str, component: str) -> str:
    return f"greatest({_m(metric)}, {q.cl(f'coalesce({MEANS[component]}, 0e0)')})" if component in MEANS else _m(metric)


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _evidence() -> list[str]:
    out = []
    for kind, metric, component, least, words in wd.EVIDENCE:
        value = _s(metric, component) if kind == wd.SHARE else _m(metric)
        rule = f"{value} >= {least}e0" + ("" if kind == wd.SHARE else f" AND ({VALUES[metric]}) IS NOT NULL")
        shown = f" || CAST(CAST(round({value} * 100e0) AS BIGINT) AS VARCHAR) || '%' || ".join(_quoted(p) for p in words.split("{}"))
        out.append(f"CASE WHEN {rule} THEN {shown} END")
    u = _m("urban_penalty")
    return [*out, f"CASE WHEN {_s('open_space_corridor_share', 'open_space')} >= 0.25 AND {_s('quiet_corridor_share', 'solitude')} < 0.25 THEN {_quoted(wd.OPEN_TEXT)} END",
            f"CASE WHEN ({VALUES['road_stress_score']}) IS NOT NULL AND {_m('road_stress_score')} <= 0.32 THEN {_quoted(wd.CALM_TEXT)} END",
            f"CASE WHEN greatest({_m('scenic_moments_score')}, {_m('photo_peak_score')}) >= 0.42 THEN {_quoted(wd.PEAK_TEXT)} END",
            f"CASE WHEN {u} > 0 AND {u} <= 0.25 THEN {_quoted(wd.LOW_URBAN_TEXT)} WHEN {u} >= 0.45 THEN {_quoted(wd.HIGH_URBAN_TEXT)} END"]


_names = list(wd.PHRASES)
_leads = "CASE WHEN candidate_id % 20 = 17 THEN [] ELSE [" + ", ".join(f"{_names}[candidate_id * {k} % 7 + 1]" for k in (1, 3, 5)) + "] END"
_say = lambda table, e: f"CASE {e} " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in table.items()) + f" ELSE replace({e}, '_', ' ') END"
_list = lambda items: f"[x FOR x IN [{', '.join(items)}] IF x IS NOT NULL]"
_three = lambda v: f"CASE len({v}) WHEN 0 THEN 'uses the strongest scenic signals available' WHEN 1 THEN {v}[1] WHEN 2 THEN {v}[1] || ' and ' || {v}[2] ELSE {v}[1] || ', ' || {v}[2] || ', and ' || {v}[3] END"
_WORDS = f"""given AS (SELECT *, {_profile} AS profile, {_target} AS target, {_leads} AS leads, CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) AS v, {_list(_evidence())} AS found FROM candidates),
  backed AS (SELECT *, CASE WHEN len(found) > 0 THEN found WHEN len(leads) > 0 THEN ['leans on ' || ({_say(wd.PHRASES, 'k')}) FOR k IN leads[1:2]] ELSE ['{wd.NO_EVIDENCE}'] END AS backing FROM given),
  timed AS (SELECT *, list_concat(backing, {_list(["CASE WHEN target > 0 THEN CASE WHEN abs(minutes - target) <= greatest(5e0, floor(target * 0.1e0 + 0.5e0)) THEN 'stays close to your ' || target || '-minute budget' WHEN minutes > target THEN 'runs about ' || (minutes - target) || ' minutes over your requested budget' END END"])}) AS ev FROM backed),
  opened AS (SELECT *, CASE lower(trim(profile)) {' '.join(f"WHEN '{p}' THEN '{t}'" for p, t in wd.OPENERS.items())} ELSE CASE WHEN len(v) > 0 THEN 'This route fits ' || replace(v[1], '_', ' ') ELSE 'This route was selected' END END AS opener FROM timed),
  reasoned AS (SELECT *, opener || ' because it ' || ({_three('ev[1:3]')}) || '.' AS first_reason FROM opened)"""
_trades = _list([f"CASE WHEN {_m('duration_fit_ratio')} >= 0.88 THEN '{wd.TRADEOFFS[0]}' END", f"CASE WHEN {_m('backtracking_penalty')} <= 0.22 OR {_m('leg_separation_score')} >= 0.55 OR {_m('route_shape_score')} >= 0.72 THEN '{wd.TRADEOFFS[1]}' END",
                 f"CASE WHEN {_m('corridor_urban_pressure')} <= 0.42 OR {_m('urban_penalty')} <= 0.42 THEN '{wd.TRADEOFFS[2]}' END"])


@query("human_reasons", oracle(["candidates"], "SELECT candidate_id, array_to_string(list_concat([first_reason], [upper(x[1]) || x[2:] || '.' FOR x IN ev]), ' ') AS reasons FROM reasoned", extra=_WORDS))
def human_reasons(spark, sf):
    return wd.human_reasons(option_rows(spark, sf)).select("candidate_id", F.array_join("human_reasons", " ").alias("reasons"))


@query("option_summaries", oracle(["candidates"], f"""SELECT candidate_id, CASE lower(trim(profile)) WHEN 'most_scenic' THEN 'Best scenic match nearby, with the strongest ' || lead1 || ' signal' || coalesce(' plus ' || lead2 || ' support', '') || '.'
    WHEN 'balanced' THEN 'Balanced trades peak scenic intensity for ' || CASE WHEN len(trades) > 0 THEN {_three('trades[1:2]')} ELSE 'a steadier drive' END || ', while keeping ' || lead1 || ' character in the route.'
    WHEN 'shorter' THEN 'Shorter keeps the best available ' || lead1 || ' feel' || CASE WHEN minutes > 0 THEN ' in a ' || minutes || '-minute drive' ELSE '' END || ', with less time commitment than the other options.' ELSE first_reason END AS summary
    FROM (SELECT *, coalesce({_say(wd.ADJECTIVES, 'leads[1]')}, 'scenic') AS lead1, {_say(wd.ADJECTIVES, 'leads[2]')} AS lead2, {_trades} AS trades FROM reasoned)""", extra=_WORDS))
def option_summaries(spark, sf):
    return wd.human_reasons(option_rows(spark, sf)).select("candidate_id", wd.option_summary().alias("summary"))


_vibe = f"{q.values(list(enumerate(catalog.VIBES)), 'place, vibe')}"


@query("route_highlights", oracle(["route_points"], f"""SELECT route_id, 0 AS place, 'route_summary' AS type, NULL::BIGINT AS point_index, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, NULL::DOUBLE AS to_next_km,
      vibe || ' loop with scenic match ' || printf('%.1f', round(route_id % 101 / 101e0 * 100, 1)) || '/100 and ' || n_points || ' waypoint' || CASE WHEN n_points = 1 THEN '' ELSE 's' END AS description
    FROM (SELECT route_id, n_points FROM route_points WHERE seq = 0) JOIN {_vibe} v ON v.place = route_id % 9
    UNION ALL SELECT route_id, k, ['start', 'midpoint', 'destination'][k], seq, lat, lon, coalesce({q.hav('lat', 'lon', 'nlat', 'nlon', '6371e0')}, 0e0), NULL
    FROM (SELECT *, lead(lat) OVER w AS nlat, lead(lon) OVER w AS nlon, unnest([1, 2, 3]) AS k FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq))
    WHERE (k = 1 AND seq = 0) OR (k = 2 AND n_points > 2 AND seq = n_points // 2) OR (k = 3 AND n_points > 1 AND seq = n_points - 1)""", "lat lon to_next_km"))
def route_highlights(spark, sf):
    points = domain(spark, sf, "route_points")
    vibe = F.element_at(F.array(*map(F.lit, catalog.VIBES)), (F.col("route_id") % 9 + 1).cast("int"))
    return wd.highlights(points.where("seq = 0").select("route_id", vibe.alias("vibe"), (F.col("route_id") % 101 / 101.0).alias("score")), points)


_JOB = "CASE WHEN job_id % 3 = 0 THEN job_id * 10 END"
_reason = "CASE WHEN job_id % 2 = 0 THEN 'No strong hills nearby' WHEN job_id % 7 = 1 THEN '' ELSE 'timed out' END"


@query("job_status", oracle(["jobs", "routes"], f"""SELECT j.job_id, j.status, CASE WHEN pub THEN coalesce({_JOB.replace('job_id', 'j.job_id')}, o.first_route) END AS route_id,
      '/routes/route/' || CASE WHEN pub THEN coalesce({_JOB.replace('job_id', 'j.job_id')}, o.first_route) END AS route_url, CASE WHEN pub THEN coalesce(array_to_string(CASE WHEN j.option_count > 0 THEN o.items[1:j.option_count] ELSE o.items END, '|'), '') ELSE '' END AS options,
      CASE WHEN j.status IN ('QUEUED', 'PROCESSING', 'PRIMARY_READY') THEN 3 END AS remaining_minutes, CASE WHEN j.status = 'FAILED' THEN CASE WHEN job_id % 2 = 0 THEN 'vibe_unavailable' ELSE 'route_generation_failed' END END AS code
    FROM (SELECT *, status IN ('PRIMARY_READY', 'COMPLETED') AS pub FROM jobs) j LEFT JOIN (SELECT job_id AS jid, list(profile || ':' || route_id ORDER BY place) AS items, arg_min(route_id, place) AS first_route FROM (
      SELECT *, CASE profile WHEN 'most_scenic' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END AS place FROM assigned) GROUP BY 1) o ON o.jid = j.job_id""",
    extra="""named AS (SELECT job_id, profile, route_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id, profile ORDER BY created_us, route_id) AS n FROM (
      SELECT *, lower(trim(route_profile)) AS profile FROM routes) WHERE profile IN ('most_scenic', 'balanced', 'shorter')) WHERE n = 1),
    assigned AS (SELECT job_id, profile, route_id FROM named UNION ALL SELECT m.job_id, m.profile, s.route_id FROM (
      SELECT j.job_id, p.profile, row_number() OVER (PARTITION BY j.job_id ORDER BY p.o) AS k FROM (SELECT DISTINCT job_id FROM routes) j, (VALUES ('most_scenic', 1), ('balanced', 2), ('shorter', 3)) p(profile, o)
      WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.job_id = j.job_id AND n.profile = p.profile)) m
    JOIN (SELECT job_id, route_id, row_number() OVER (PARTITION BY job_id ORDER BY created_us, route_id) AS k FROM routes WHERE route_id NOT IN (SELECT route_id FROM named)) s ON s.job_id = m.job_id AND s.k = m.k)"""))
def job_status(spark, sf):
    jobs = domain(spark, sf, "jobs").select("job_id", "status", F.expr(_JOB).alias("route_id"), "option_count", F.expr(_reason).alias("failure_reason"), F.array(F.lit("coastal")).alias("vibes"), F.lit(45).alias("target_minutes"))
    done = st.job_status(jobs, domain(spark, sf, "routes"))
    return done.select("job_id", "status", "route_id", "route_url", F.array_join(F.transform("options", lambda o: F.concat_ws(":", o["profile"], o["route_id"].cast("string"))), "|").alias("options"), "remaining_minutes", "code")


_algorithm = "CASE job_id % 4 WHEN 0 THEN 'beam_v1' WHEN 1 THEN ' ' WHEN 2 THEN 'planner_v2' END"


@query("route_details", oracle(["trips", "route_points", "jobs"], f"""SELECT t.route_id, t.request_id AS job_id, '/routes/route/' || t.route_id AS route_url, t.route_id % 101 / 101e0 * 100 AS score,
      CASE WHEN coalesce(p.n_points, 0) < 2 OR t.route_id % 101 / 101e0 < 0.45 THEN 'DEGRADED' WHEN t.route_id % 101 / 101e0 >= 0.78 AND p.n_points >= 3 THEN 'PREMIUM' ELSE 'STANDARD' END AS quality_tier, t.km, t.minutes,
      coalesce(p.lat, 0e0) AS start_lat, coalesce(p.lon, 0e0) AS start_lon, j.route_mode, coalesce(j.option_count, 0) AS option_count, CASE WHEN trim(coalesce(a, '')) = '' THEN 'unknown' ELSE a END AS algorithm,
      coalesce(b, CASE WHEN a LIKE 'beam%' THEN 10 END) AS beam_candidates, CAST(floor((completed_us - started_us) / 1000) AS BIGINT) AS computation_ms
    FROM trips t LEFT JOIN (SELECT * FROM route_points WHERE seq = 0) p ON p.route_id = t.route_id LEFT JOIN (SELECT *, {_algorithm} AS a, CASE WHEN job_id % 8 = 0 THEN 25 END AS b FROM jobs) j ON j.job_id = t.request_id""", "score km start_lat start_lon"))
def route_details(spark, sf):
    jobs = domain(spark, sf, "jobs").select("job_id", "route_mode", "started_us", "completed_us", F.expr(_algorithm).alias("algorithm"), F.when(F.col("job_id") % 8 == 0, 25).alias("beam_candidates"), "option_count")
    routes = domain(spark, sf, "trips").select("route_id", F.col("request_id").alias("job_id"), (F.col("route_id") % 101 / 101.0).alias("score"), "km", "minutes")
    return st.route_details(routes, domain(spark, sf, "route_points").where("seq = 0").select("route_id", "lat", "lon", "n_points"), jobs)
