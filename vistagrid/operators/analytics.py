"""Product analytics: event intake, roll-ups, summaries, calibrations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vistagrid.functions import catalog, scoring, text
from vistagrid.functions.scalars import clamp, clamp01, round_half_up
from vistagrid.operators.skew import SPAN, numbered

FINISHED = ["route_generation_completed", "route_generation_failed"]
DEMAND = ["route_generate_submitted", "route_generation_completed", "vibe_unavailable"]
HOUR_US = 3_600_000_000


def normalize_event(raw: DataFrame, secret: str) -> DataFrame:
    """Cleaned event rows with `reject_reason`: null for good rows, else the first broken rule."""
    name = F.lower(F.trim("event_name"))
    given = F.from_json("vibes_json", "array<string>")
    vibes = F.transform(given, text.normalize_vibe)
    reason = (F.when(~F.coalesce(name.isin(catalog.ANALYTICS_EVENTS), F.lit(False)), "unsupported_event")
              .when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 3, "too_many_vibes")
              .when(F.coalesce(F.exists(vibes, lambda v: ~text.supported(v)), F.lit(False)), "unsupported_vibe")
              .when(F.coalesce(F.col("time_budget_minutes") < 1, F.lit(False)), "invalid_time_budget")
              .when(~text.metadata_check("metadata_json")["ok"], "invalid_metadata"))
    return raw.select(
        "event_id", name.alias("event_name"), F.array_distinct(vibes).alias("vibes"),
        text.hash_client("client_id", "session_id", secret).alias("client_hash"), text.normalize_region("region_key").alias("region_key"),
        text.blank_to_null("route_mode").alias("route_mode"), text.time_bucket_capped("time_budget_minutes").alias("time_budget_bucket"),
        reason.alias("reject_reason"))


def split_events(normalized: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = F.col("reject_reason").isNotNull()
    return normalized.where(~bad).drop("reject_reason"), normalized.where(bad)


def in_window(events: DataFrame, from_us: int, to_us: int, at: str = "created_us") -> DataFrame:
    return events.where((F.col(at) >= from_us) & (F.col(at) < to_us))


def event_counts(events: DataFrame, from_us: int, to_us: int) -> DataFrame:
    return in_window(events, from_us, to_us).groupBy("event_name").agg(F.count("*").alias("n"))


def distinct_clients(events: DataFrame, from_us: int, to_us: int, column: str = "client_id", approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
    return in_window(events, from_us, to_us).agg(count.alias("clients"))


def avg_or_zero(value: Column, when: Column) -> Column:
    return F.coalesce(F.avg(F.when(when, value)), F.lit(0.0))


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str) -> DataFrame:
    """Linearly interpolated percentile of non-negative values, without holding a group in one task.

    A log-spaced histogram (under 5,000 buckets) finds the buckets that hold the two ranks; only their distinct
    values are then counted. Every other row is seen once, in a partial aggregate.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    rows = rows.withColumn("__b", F.floor(F.log2(F.col("__v") + 1.0) * 64))
    hist = rows.groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    hist = hist.withColumns({"__upto": F.sum("__n").over(part.orderBy("__b")), "__total": F.sum("__n").over(part)})
    pos = (F.col("__total") - 1) * p
    hist = hist.withColumns({"__pos": pos, "__lo": F.floor(pos), "__hi": F.ceil(pos), "__before": F.col("__upto") - F.col("__n")})
    hot = hist.where((F.col("__before") <= F.col("__hi")) & (F.col("__upto") > F.col("__lo")))
    counted = rows.groupBy(*keys, "__b", "__v").agg(F.count("*").alias("__c")).join(
        hot.select(*keys, "__b", "__before", "__pos", "__lo", "__hi"), [*keys, "__b"])
    inner = Window.partitionBy(*keys, "__b").orderBy("__v")
    counted = counted.withColumn("__end", F.col("__before") + F.sum("__c").over(inner))

    def at(rank: str) -> Column:
        return F.min(F.when(F.col("__end") > F.col(rank), F.col("__v")))

    agg = [at("__lo").alias("__a"), at("__hi").alias("__z"), F.max(F.col("__pos") - F.col("__lo")).alias("__f")]
    out = counted.groupBy(*keys).agg(*agg) if keys else counted.agg(*agg)
    return out.select(*keys, (F.col("__a") + (F.col("__z") - F.col("__a")) * F.col("__f")).alias(name))


def top_counts(events: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (events.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("name"))
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(n))


def top_vibes(events: DataFrame, n: int = 10) -> DataFrame:
    wanted = events.where(F.col("event_name").isin("route_generate_submitted", "route_generation_completed"))
    return top_counts(wanted.select(F.explode(F.from_json("vibes_json", "array<string>")).alias("vibe")), "vibe", n)


def analytics_summary(events: DataFrame, to_us: int, days: int) -> DataFrame:
    """One row of counts, rates and latencies for the last 1..90 days; a single conditional pass plus the p95."""
    days = max(1, min(days, 90))
    scope = in_window(events, to_us - days * 24 * HOUR_US, to_us)
    name = F.col("event_name")
    done, failed = name == "route_generation_completed", name == "route_generation_failed"

    def n(when):
        return F.count_if(when)

    def rate(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    base = scope.agg(
        F.count("*").alias("total_events"), n(name == "route_generate_clicked").alias("generate_clicks"),
        n(name == "route_generate_submitted").alias("submitted_routes"), n(done).alias("completed_routes"), n(failed).alias("failed_routes"),
        n(name == "vibe_unavailable").alias("vibe_unavailable_routes"), n(name == "start_drive_clicked").alias("start_drive_clicks"),
        n(name == "navigation_opened").alias("navigation_opens"), n(name == "plan_new_route_clicked").alias("plan_new_route_clicks"),
        F.count_distinct("client_id").alias("unique_clients"),
        round_half_up(rate(n(done), n(done | failed)), 4).alias("route_success_rate"),
        round_half_up(avg_or_zero(F.col("duration_ms"), done | failed), 2).alias("average_generation_ms"),
        round_half_up(avg_or_zero(F.col("route_count"), done), 2).alias("average_route_options"),
        round_half_up(rate(n(done & (F.col("route_count") >= 3)), n(done & F.col("route_count").isNotNull())), 4).alias("three_option_rate"),
        round_half_up(avg_or_zero(F.col("scenic_score"), done), 4).alias("average_scenic_score"))
    p95 = exact_percentile(scope.where(done | failed), [], "duration_ms", 0.95, "p")
    p95 = p95.agg(round_half_up(F.coalesce(F.max("p"), F.lit(0.0)), 2).alias("p95_generation_ms"))
    # Both sides are one-row aggregates.
    return base.withColumn("one", F.lit(1)).join(p95.withColumn("one", F.lit(1)), "one").drop("one")


ROLLUP_KEYS = ["day", "region_key", "route_mode", "vibe", "time_budget_bucket"]
ROLLUP_SUMS = ["event_count", "submitted_count", "completed_count", "failed_count", "vibe_unavailable_count", "start_drive_count",
               "navigation_open_count", "generation_ms_total", "generation_ms_count", "route_options_total", "route_options_count",
               "scenic_score_total", "scenic_score_count"]


def rollup_rows(events: DataFrame) -> DataFrame:
    """Events fanned out per vibe with the roll-up keys filled in; `milestone` rows carry no sums."""
    vibes = F.array_distinct(F.filter(F.transform(F.from_json("vibes_json", "array<string>"), text.blank_to_null), lambda v: v.isNotNull()))
    vibes = F.when(F.size(F.coalesce(vibes, F.array().cast("array<string>"))) > 0, vibes).otherwise(F.array(F.lit("unknown")))
    return events.select(
        "day", F.coalesce("region_key", F.lit("unknown")).alias("region_key"), F.coalesce("route_mode", F.lit("unknown")).alias("route_mode"),
        F.explode(vibes).alias("vibe"), F.coalesce(text.time_bucket_capped("time_budget_minutes"), F.lit(0)).alias("time_budget_bucket"),
        "event_name", F.col("event_name").isin(catalog.LATENCY_MILESTONES).alias("milestone"), "duration_ms", "route_count", "scenic_score")


def rollup_aggregates() -> list[Column]:
    name, counted = F.col("event_name"), ~F.col("milestone")

    def total(value):
        return F.coalesce(F.sum(F.when(counted, F.col(value))), F.lit(0))

    def present(value):
        return F.count_if(counted & F.col(value).isNotNull())

    flags = {"submitted_count": "route_generate_submitted", "completed_count": "route_generation_completed",
             "failed_count": "route_generation_failed", "vibe_unavailable_count": "vibe_unavailable",
             "start_drive_count": "start_drive_clicked", "navigation_open_count": "navigation_opened"}
    return [F.count("*").alias("event_count"), *[F.count_if(name == v).alias(k) for k, v in flags.items()],
            total("duration_ms").cast("double").alias("generation_ms_total"), present("duration_ms").alias("generation_ms_count"),
            total("route_count").cast("bigint").alias("route_options_total"), present("route_count").alias("route_options_count"),
            total("scenic_score").cast("double").alias("scenic_score_total"), present("scenic_score").alias("scenic_score_count")]


def daily_rollup(events: DataFrame) -> DataFrame:
    return rollup_rows(events).groupBy(*ROLLUP_KEYS).agg(*rollup_aggregates())


def merge_rollups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Additive upsert of two roll-up tables."""
    return a.unionByName(b).groupBy(*ROLLUP_KEYS).agg(*[F.sum(s).alias(s) for s in ROLLUP_SUMS])


def funnel_rates(summary: DataFrame) -> DataFrame:
    def rate(a, b):
        return F.when(F.col(b) == 0, 0.0).otherwise(F.col(a) / F.col(b))

    return summary.select(rate("start_drive_clicks", "generate_clicks").alias("conversion"),
                          rate("navigation_opens", "start_drive_clicks").alias("navigation_rate"))


METRICS = ["completed_routes", "unique_clients", "route_success_rate", "average_generation_ms", "p95_generation_ms", "average_route_options",
           "three_option_rate", "average_scenic_score", "start_drive_clicks", "navigation_opens", "plan_new_route_clicks"]


def metric_deltas(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Metric changes of at least 1e-4 with their direction."""
    def long(df, name):
        wide = df.select(*[F.col(m).cast("double").alias(m) for m in METRICS])
        return wide.unpivot([], METRICS, "metric", name)

    change = F.col("cur") - F.col("prev")
    return (long(current, "cur").join(long(previous, "prev"), "metric").where(F.abs(change) >= 0.0001)
            .select("metric", F.when(change > 0, "up").otherwise("down").alias("direction"), F.abs(change).alias("change")))


def stage_metrics(runs: DataFrame, keys: list[str], stages: list[str], p: float = 0.95) -> DataFrame:
    """Count, sum and percentile of each stage duration per key; negative durations count as 0."""
    long = runs.select(*keys, *[F.col(s).cast("double").alias(s) for s in stages]).unpivot(keys, stages, "stage", "ms")
    long = long.where("ms IS NOT NULL").withColumn("ms", F.greatest(F.lit(0.0), "ms"))
    sums = long.groupBy(*keys, "stage").agg(F.count("*").alias("n"), F.sum("ms").alias("total_ms"), F.max("ms").alias("max_ms"))
    return sums.join(exact_percentile(long, [*keys, "stage"], "ms", p, "p95_ms"), [*keys, "stage"])


def duration_calibration(observations: DataFrame, grid) -> DataFrame:
    """Means of corrections per (mode, region, bucket, strategy); invalid observations are skipped."""
    o = observations.where((F.col("radius_km") > 0) & (F.col("waypoint_count") > 0) & (F.col("target_minutes") > 0) & (F.col("duration_minutes") > 0))
    correction = clamp(F.col("target_minutes") / F.col("duration_minutes"), 0.75, 1.25)
    key = text.calibration_key("route_mode", grid.cell_of("lat", "lon", 5), "target_minutes", "strategy")
    return o.groupBy(key.alias("calibration_key")).agg(
        F.avg(correction).alias("radius_multiplier"), F.avg(clamp(F.col("waypoint_count") * correction, 2.0, 10.0)).alias("learned_waypoints"),
        F.avg("radius_km").alias("avg_radius_km"), F.avg(F.col("waypoint_count").cast("double")).alias("avg_waypoints"),
        F.avg(clamp(F.col("duration_minutes") / F.col("target_minutes"), 0.25, 3.0)).alias("avg_duration_ratio"),
        F.count("*").alias("samples")).withColumn("usable", F.col("samples") >= 3)


# Learning rate and limits of the weight calibration. Fixed values.
RATE, LOW, HIGH = 0.04, 0.70, 1.30


def calibration_deltas(ratings: DataFrame, tags: str = "tags") -> DataFrame:
    """d_<component>: step of one rating, from its score, component ratios and feedback tags."""
    signal = (F.col("rating") - 3.0) / 2.0
    out = {}
    for i, k in enumerate(catalog.COMPONENTS):
        table = text.literal_map((t, s[i]) for t, s in catalog.FEEDBACK_SIGNALS.items())
        tag_sum = F.aggregate(F.coalesce(F.col(tags), F.array().cast("array<string>")), F.lit(0.0), lambda acc, t: acc + F.coalesce(table[t], F.lit(0.0)))
        out[f"d_{k}"] = (signal * clamp01(F.col(k)) + clamp(tag_sum, -1.0, 1.0)) * RATE
    return ratings.withColumns(out)


def compose_shifts(items: Column, field: str) -> Column:
    """Composition of clamped shifts x -> min(hi, max(lo, x + a)), in array order.

    The maps are closed under composition, so any run of ratings shrinks to three numbers.
    """
    start = F.struct(F.lit(0.0).alias("a"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

    def step(acc, x):
        f = x[field]
        return F.struct((acc["a"] + f["a"]).alias("a"), F.least(f["hi"], F.greatest(f["lo"], acc["lo"] + f["a"])).alias("lo"),
                        F.least(f["hi"], F.greatest(f["lo"], acc["hi"] + f["a"])).alias("hi"))

    return F.aggregate(items, start, step)


def weight_calibration(ratings: DataFrame, levels: int = 2) -> DataFrame:
    """Multipliers per vibe after folding all its ratings in time order, each step clamped to [0.70, 1.30].

    Nine vibes share all ratings, so no vibe is folded in one task: runs of 4,096 ratings are composed first, then
    runs of runs, and the last group per vibe only holds those summaries.
    """
    hour = F.floor(F.col("rated_us") / HOUR_US)
    ranked = numbered(ratings, ["rated_us", "rating_id"], hour, ["vibe"], "pos")
    maps = [F.struct(F.col(f"d_{k}").alias("a"), F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")).alias(k) for k in catalog.COMPONENTS]
    runs = ranked.select("vibe", F.col("pos").alias("pos"), F.lit(1).cast("bigint").alias("n"), *maps)
    fields = [F.col("pos"), F.col("n"), *[F.col(k) for k in catalog.COMPONENTS]]
    for level in range(levels + 1):
        keys = ["vibe"] if level == levels else ["vibe", F.floor(F.col("pos") / SPAN).alias("run")]
        grouped = runs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
        pos = F.lit(0).cast("bigint") if level == levels else F.col("run")
        total = F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"])
        runs = grouped.select("vibe", pos.alias("pos"), total.alias("n"), *[compose_shifts(F.col("items"), k).alias(k) for k in catalog.COMPONENTS])

    def applied(k):
        f = F.col(k)
        return F.least(f["hi"], F.greatest(f["lo"], f["a"] + 1.0))

    return runs.select("vibe", *[applied(k).alias(f"m_{k}") for k in catalog.COMPONENTS], F.col("n").alias("samples"))


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def option_counts(routes: DataFrame) -> DataFrame:
    return routes.where(text.normalize_profile("route_profile").isNotNull()).groupBy("job_id").agg(F.count("*").alias("options"))


def region_score_summary(options: DataFrame) -> DataFrame:
    """Score range per region key, and the spread of option scores."""
    return options.groupBy("region_key").agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"),
                                             (F.max("score") - F.min("score")).alias("spread"), F.count("*").alias("n"))


def component_averages(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Seven means rounded to 4 digits, used by explanations; needs component columns."""
    values = {**{k: F.col(k) for k in catalog.COMPONENTS}, "open_space": scoring.open_space()}
    return rows.groupBy(*keys).agg(*[round_half_up(F.avg(v), 4).alias(k) for k, v in values.items()], F.count("*").alias("n"))
