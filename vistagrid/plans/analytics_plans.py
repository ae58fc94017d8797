"""Product analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vistagrid.functions import catalog, text
from vistagrid.operators import analytics as an
from vistagrid.plans import sqlgen as q
from vistagrid.plans.registry import oracle, query
from vistagrid.plans.scalar_plans import SECRET, _alias_rows, _norm
from vistagrid.plans.tile_plans import SCORED, scored_tiles
from vistagrid.sources.fixtures import GRID, domain

DAY_US = 24 * an.HOUR_US
TO_US = 1704067200000000 + 28 * DAY_US  # 29 January 2024
MID_US = TO_US - 14 * DAY_US
SCOPE = f"created_us >= {TO_US - 14 * DAY_US} AND created_us < {TO_US}"
_known = ", ".join(repr(v) for v in catalog.VIBES)
_events = ", ".join(repr(v) for v in catalog.ANALYTICS_EVENTS)


@query("normalized_events", oracle(["raw_events"], f"""SELECT r.event_id, name AS event_name, v.vibes,
      CASE WHEN NOT coalesce(name IN ({_events}), false) THEN 'unsupported_event' WHEN coalesce(v.n, 0) > 3 THEN 'too_many_vibes'
        WHEN coalesce(v.bad, false) THEN 'unsupported_vibe' WHEN time_budget_minutes < 1 THEN 'invalid_time_budget' END AS reject_reason,
      CASE WHEN region = '' THEN NULL ELSE left(region, 40) END AS region_key, CASE WHEN mode = '' THEN NULL ELSE mode END AS route_mode,
      CASE WHEN time_budget_minutes > 0 THEN least(360, greatest(15, ((time_budget_minutes + 7) // 15) * 15)) END AS time_budget_bucket
    FROM (SELECT *, lower(trim(event_name)) AS name, lower(trim(region_key)) AS region, lower(trim(route_mode)) AS mode FROM raw_events) r
    LEFT JOIN (SELECT event_id, string_agg(vibe, '|' ORDER BY p) AS vibes, sum(c) AS n, bool_or(vibe NOT IN ({_known})) AS bad FROM (
        SELECT event_id, coalesce(a.canon, s) AS vibe, min(pos) AS p, count(*) AS c FROM (
          SELECT event_id, pos, {_norm('item')} AS s FROM (SELECT event_id, unnest(items) AS item, generate_subscripts(items, 1) AS pos FROM (
            SELECT event_id, CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[]) AS items FROM raw_events)))
          LEFT JOIN {_alias_rows} a ON a.alias = s GROUP BY 1, 2) GROUP BY 1) v USING (event_id)"""))
def normalized_events(spark, sf):
    df = an.normalize_event(domain(spark, sf, "raw_events"), SECRET)
    vibes = F.when(F.size("vibes") > 0, F.array_join("vibes", "|"))
    return df.select("event_id", "event_name", vibes.alias("vibes"), "reject_reason", "region_key", "route_mode", "time_budget_bucket")


@query("rejected_event_counts", oracle(["raw_events"], f"""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT coalesce(lower(trim(event_name)) IN ({_events}), false) THEN 'unsupported_event'
    WHEN json_array_length(vibes_json) > 3 THEN 'too_many_vibes' WHEN vibes_json LIKE '%not a vibe%' THEN 'unsupported_vibe' WHEN time_budget_minutes < 1 THEN 'invalid_time_budget' ELSE 'accepted' END AS reason
    FROM raw_events) GROUP BY 1"""))
def rejected_event_counts(spark, sf):
    good, bad = an.split_events(an.normalize_event(domain(spark, sf, "raw_events"), SECRET))
    return (bad.groupBy(F.col("reject_reason").alias("reason")).agg(F.count("*").alias("n"))
            .unionByName(good.agg(F.lit("accepted").alias("reason"), F.count("*").alias("n"))))


@query("event_counts", oracle(["analytics_events"], f"SELECT event_name, count(*) AS n FROM analytics_events WHERE {SCOPE} GROUP BY 1"))
def event_counts(spark, sf):
    return an.event_counts(domain(spark, sf, "analytics_events"), MID_US, TO_US)


@query("distinct_clients", oracle(["analytics_events"], f"SELECT count(DISTINCT client_id) AS clients FROM analytics_events WHERE {SCOPE}"))
def distinct_clients(spark, sf):
    return an.distinct_clients(domain(spark, sf, "analytics_events"), MID_US, TO_US)


@query("latency_percentiles", oracle(["analytics_events"], """SELECT event_name, avg(duration_ms) AS mean_ms, quantile_cont(duration_ms, 0.95) AS p95_ms, quantile_cont(duration_ms, 0.5) AS p50_ms
    FROM analytics_events WHERE duration_ms IS NOT NULL GROUP BY 1""", "mean_ms p95_ms p50_ms"))
def latency_percentiles(spark, sf):
    e = domain(spark, sf, "analytics_events")
    mean = e.where("duration_ms IS NOT NULL").groupBy("event_name").agg(F.avg("duration_ms").alias("mean_ms"))
    return mean.join(an.exact_percentile(e, ["event_name"], "duration_ms", 0.95, "p95_ms"), "event_name").join(
        an.exact_percentile(e, ["event_name"], "duration_ms", 0.5, "p50_ms"), "event_name")


@query("top_modes_and_regions", oracle(["analytics_events"], f"""(SELECT 'mode' AS kind, route_mode AS name, count(*) AS n FROM analytics_events WHERE {SCOPE} AND event_name IN
    ('route_generate_submitted', 'route_generation_completed') AND route_mode IS NOT NULL GROUP BY 2 ORDER BY n DESC, name LIMIT 10) UNION ALL
    (SELECT 'region', region_key, count(*) AS n FROM analytics_events WHERE {SCOPE} AND region_key IS NOT NULL GROUP BY 2 ORDER BY n DESC, 2 LIMIT 3)"""))
def top_modes_and_regions(spark, sf):
    e = an.in_window(domain(spark, sf, "analytics_events"), MID_US, TO_US)
    wanted = e.where(F.col("event_name").isin("route_generate_submitted", "route_generation_completed"))
    modes = an.top_counts(wanted, "route_mode").withColumn("kind", F.lit("mode"))
    return modes.unionByName(an.top_counts(e, "region_key", 3).withColumn("kind", F.lit("region")))


@query("top_vibes", oracle(["analytics_events"], f"""SELECT vibe AS name, count(*) AS n FROM (SELECT unnest(CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[])) AS vibe FROM analytics_events
    WHERE {SCOPE} AND event_name IN ('route_generate_submitted', 'route_generation_completed')) GROUP BY 1 ORDER BY n DESC, name LIMIT 10"""))
def top_vibes(spark, sf):
    return an.top_vibes(an.in_window(domain(spark, sf, "analytics_events"), MID_US, TO_US))


def _summary_sql(where: str) -> str:
    done, failed = "event_name = 'route_generation_completed'", "event_name = 'route_generation_failed'"
    return f"""SELECT count(*) AS total_events, count(*) FILTER (event_name = 'route_generate_clicked') AS generate_clicks,
      count(*) FILTER (event_name = 'route_generate_submitted') AS submitted_routes, count(*) FILTER ({done}) AS completed_routes, count(*) FILTER ({failed}) AS failed_routes,
      count(*) FILTER (event_name = 'vibe_unavailable') AS vibe_unavailable_routes, count(*) FILTER (event_name = 'start_drive_clicked') AS start_drive_clicks,
      count(*) FILTER (event_name = 'navigation_opened') AS navigation_opens, count(*) FILTER (event_name = 'plan_new_route_clicked') AS plan_new_route_clicks,
      count(DISTINCT client_id) AS unique_clients, floor(count(*) FILTER ({done}) / count(*) FILTER ({done} OR {failed}) * 1e4 + 0.5) / 1e4 AS route_success_rate,
      floor(avg(duration_ms) FILTER ({done} OR {failed}) * 100 + 0.5) / 100 AS average_generation_ms,
      floor(avg(route_count) FILTER ({done}) * 100 + 0.5) / 100 AS average_route_options,
      floor(count(*) FILTER ({done} AND route_count >= 3) / count(*) FILTER ({done} AND route_count IS NOT NULL) * 1e4 + 0.5) / 1e4 AS three_option_rate,
      floor(avg(scenic_score) FILTER ({done}) * 1e4 + 0.5) / 1e4 AS average_scenic_score,
      floor(quantile_cont(duration_ms, 0.95) FILTER ({done} OR {failed}) * 100 + 0.5) / 100 AS p95_generation_ms FROM analytics_events WHERE {where}"""


_sum_doubles = "route_success_rate average_generation_ms average_route_options three_option_rate average_scenic_score p95_generation_ms"


@query("analytics_summary", oracle(["analytics_events"], _summary_sql(SCOPE), _sum_doubles))
def analytics_summary(spark, sf):
    return an.analytics_summary(domain(spark, sf, "analytics_events"), TO_US, 14)


ROLLUP_SQL = """SELECT day, coalesce(region_key, 'unknown') AS region_key, coalesce(route_mode, 'unknown') AS route_mode, vibe, coalesce(CASE WHEN time_budget_minutes > 0 THEN
      least(360, greatest(15, ((time_budget_minutes + 7) // 15) * 15)) END, 0) AS time_budget_bucket, count(*) AS event_count,
      count(*) FILTER (event_name = 'route_generate_submitted') AS submitted_count, count(*) FILTER (event_name = 'route_generation_completed') AS completed_count,
      count(*) FILTER (event_name = 'route_generation_failed') AS failed_count, count(*) FILTER (event_name = 'vibe_unavailable') AS vibe_unavailable_count,
      count(*) FILTER (event_name = 'start_drive_clicked') AS start_drive_count, count(*) FILTER (event_name = 'navigation_opened') AS navigation_open_count,
      coalesce(sum(duration_ms) FILTER (ok), 0)::DOUBLE AS generation_ms_total, count(duration_ms) FILTER (ok) AS generation_ms_count,
      coalesce(sum(route_count) FILTER (ok), 0)::BIGINT AS route_options_total, count(route_count) FILTER (ok) AS route_options_count,
      coalesce(sum(scenic_score) FILTER (ok), 0)::DOUBLE AS scenic_score_total, count(scenic_score) FILTER (ok) AS scenic_score_count
    FROM (SELECT *, event_name <> 'route_map_painted' AS ok FROM analytics_events) e JOIN (
      SELECT event_id, unnest(coalesce(list_distinct(CAST(json_extract_string(vibes_json, '$[*]') AS VARCHAR[])), ['unknown'])) AS vibe FROM analytics_events) v USING (event_id)
    GROUP BY ALL"""
ROLLUP_ORACLE = oracle(["analytics_events"], ROLLUP_SQL, "generation_ms_total scenic_score_total")


@query("daily_rollup", ROLLUP_ORACLE)
def daily_rollup(spark, sf):
    return an.daily_rollup(domain(spark, sf, "analytics_events"))


@query("merged_rollups", ROLLUP_ORACLE)
def merged_rollups(spark, sf):
    """Roll-ups of the even and odd events, merged, equal the roll-up of all events."""
    e = domain(spark, sf, "analytics_events")
    return an.merge_rollups(an.daily_rollup(e.where("event_id % 2 = 0")), an.daily_rollup(e.where("event_id % 2 = 1")))


@query("funnel_rates", oracle(["analytics_events"], f"SELECT start_drive_clicks / generate_clicks AS conversion, navigation_opens / start_drive_clicks AS navigation_rate FROM ({_summary_sql(SCOPE)})",
                              "conversion navigation_rate"))
def funnel_rates(spark, sf):
    return an.funnel_rates(an.analytics_summary(domain(spark, sf, "analytics_events"), TO_US, 14))


_long = " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS cur, (SELECT {m} FROM p)::DOUBLE AS prev FROM c" for m in an.METRICS)


@query("metric_deltas", oracle(["analytics_events"], f"SELECT metric, CASE WHEN cur > prev THEN 'up' ELSE 'down' END AS direction, abs(cur - prev) AS change FROM ({_long}) WHERE abs(cur - prev) >= 0.0001",
    "change", f"c AS ({_summary_sql(SCOPE)}), p AS ({_summary_sql(f'created_us >= {MID_US - 14 * DAY_US} AND created_us < {MID_US}')})"))
def metric_deltas(spark, sf):
    e = domain(spark, sf, "analytics_events")
    return an.metric_deltas(an.analytics_summary(e, TO_US, 14), an.analytics_summary(e, MID_US, 14))


def runs(spark, sf):
    j = domain(spark, sf, "jobs")
    return j.select("route_mode", "strategy", "status", ((F.col("started_us") - F.col("submitted_us")) / 1000).alias("queue"),
                    ((F.col("primary_us") - F.col("started_us")) / 1000).alias("primary"), ((F.col("completed_us") - F.col("started_us")) / 1000).alias("total"))


_stages = " UNION ALL ".join(f"SELECT route_mode, strategy, status, '{n}' AS stage, greatest(0e0, ({a} - {b}) / 1000e0) AS ms FROM jobs WHERE {a} IS NOT NULL"
                             for n, a, b in (("queue", "started_us", "submitted_us"), ("primary", "primary_us", "started_us"), ("total", "completed_us", "started_us")))


@query("stage_metrics", oracle(["jobs"], f"""SELECT route_mode, strategy, status, stage, count(*) AS n, sum(ms) AS total_ms, max(ms) AS max_ms, quantile_cont(ms, 0.95) AS p95_ms
    FROM ({_stages}) GROUP BY ALL""", "total_ms max_ms p95_ms"))
def stage_metrics(spark, sf):
    df = runs(spark, sf)
    return an.stage_metrics(df, ["route_mode", "strategy", "status"], ["queue", "primary", "total"])


@query("region_score_summary", oracle(["analytics_events"], """SELECT coalesce(region_key, 'none') AS region_key, min(scenic_score) AS min_score, max(scenic_score) AS max_score, avg(scenic_score) AS avg_score,
    max(scenic_score) - min(scenic_score) AS spread, count(*) AS n FROM analytics_events GROUP BY 1""", "min_score max_score avg_score spread"))
def region_score_summary(spark, sf):
    e = domain(spark, sf, "analytics_events").select(F.coalesce("region_key", F.lit("none")).alias("region_key"), F.col("scenic_score").alias("score"))
    return an.region_score_summary(e)


_avg7 = ", ".join(f"floor(avg({e}) * 1e4 + 0.5) / 1e4 AS {k}" for k, e in [*[(k, k) for k in catalog.COMPONENTS], ("open_space", q.OPEN_SPACE)])


@query("component_averages", oracle(["tiles"], f"SELECT coalesce(scoring_version, 'none') AS version, {_avg7}, count(*) AS n FROM scored GROUP BY 1",
                                    " ".join(catalog.COMPONENTS) + " open_space", SCORED))
def component_averages(spark, sf):
    return an.component_averages(scored_tiles(spark, sf).withColumn("version", F.coalesce("scoring_version", F.lit("none"))), ["version"])


@query("duration_calibration", oracle(["duration_observations"], f"""SELECT concat_ws('|', route_mode, {q.cell_text(5)}, greatest(15, ((target_minutes + 7) // 15) * 15), lower(strategy)) AS calibration_key,
      avg(corr) AS radius_multiplier, avg(greatest(2e0, least(10e0, waypoint_count * corr))) AS learned_waypoints, avg(radius_km) AS avg_radius_km, avg(waypoint_count) AS avg_waypoints,
      avg(greatest(0.25e0, least(3e0, duration_minutes / target_minutes))) AS avg_duration_ratio, count(*) AS samples, count(*) >= 3 AS usable
    FROM (SELECT *, greatest(0.75e0, least(1.25e0, target_minutes / duration_minutes)) AS corr FROM ({q.axial('lat', 'lon', 5, 'duration_observations')})
      WHERE radius_km > 0 AND waypoint_count > 0 AND duration_minutes > 0) GROUP BY 1""", "radius_multiplier learned_waypoints avg_radius_km avg_waypoints avg_duration_ratio"))
def duration_calibration(spark, sf):
    return an.duration_calibration(domain(spark, sf, "duration_observations"), GRID)


def rated(spark, sf):
    r = domain(spark, sf, "ratings").withColumn("tags", text.normalize_feedback_tags(F.split("tags_text", r"\|")))
    return an.calibration_deltas(r)


_signals = q.values([(t, *s) for t, s in catalog.FEEDBACK_SIGNALS.items()], "tag, " + ", ".join(f"t_{k}" for k in catalog.COMPONENTS))
_fold = ", ".join(f"list_reduce(list_prepend(1e0, list(d_{k} ORDER BY rated_us, rating_id)), lambda x, y: greatest(0.7e0, least(1.3e0, x + y))) AS m_{k}" for k in catalog.COMPONENTS)


CALIBRATION_ORACLE = oracle(["ratings"], f"""SELECT vibe, {_fold}, count(*) AS samples FROM (SELECT r.*, {', '.join(
      f"0.04e0 * ((rating - 3) / 2e0 * greatest(0e0, least(1e0, {k})) + greatest(-1e0, least(1e0, coalesce(s_{k}, 0e0)))) AS d_{k}" for k in catalog.COMPONENTS)}
    FROM ratings r LEFT JOIN (SELECT rating_id, {', '.join(f'sum(t_{k}) AS s_{k}' for k in catalog.COMPONENTS)} FROM (
      SELECT rating_id, tag FROM (SELECT rating_id, tag, row_number() OVER (PARTITION BY rating_id ORDER BY min(p)) AS n FROM (
        SELECT rating_id, replace(replace(lower(trim(x)), '-', '_'), ' ', '_') AS tag, p FROM (SELECT rating_id, unnest(string_split(tags_text, '|')) AS x,
          generate_subscripts(string_split(tags_text, '|'), 1) AS p FROM ratings)) WHERE tag IN ({', '.join(repr(t) for t in catalog.FEEDBACK_TAGS)}) GROUP BY 1, 2) WHERE n <= 4)
      JOIN {_signals} USING (tag) GROUP BY 1) s USING (rating_id)) GROUP BY 1""", " ".join(f"m_{k}" for k in catalog.COMPONENTS))


@query("weight_calibration", CALIBRATION_ORACLE)
def weight_calibration(spark, sf):
    return an.weight_calibration(rated(spark, sf))


@query("duplicate_profiles", oracle(["routes"], "SELECT job_id, route_profile, count(*) AS n FROM routes WHERE route_profile IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"))
def duplicate_profiles(spark, sf):
    return an.duplicate_groups(domain(spark, sf, "routes"), ["job_id", "route_profile"])


@query("option_counts", oracle(["routes"], "SELECT job_id, count(*) AS options FROM routes WHERE lower(trim(route_profile)) IN ('most_scenic', 'balanced', 'shorter') GROUP BY 1"))
def option_counts(spark, sf):
    return an.option_counts(domain(spark, sf, "routes"))
