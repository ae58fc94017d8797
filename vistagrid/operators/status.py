"""What a user sees of a job and of a route."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog, scoring
from vistagrid.operators.options import assign_profiles
from vistagrid.operators.quality import failure_guidance

# States that show routes, states that still work, minutes that remain then, and the path of a route.
PUBLISHED, WORKING, REMAINING, ROUTE_PATH = ["PRIMARY_READY", "COMPLETED"], ["QUEUED", "PROCESSING", "PRIMARY_READY"], 3, "/routes/route/"
UNKNOWN_ALGORITHM, BEAM, BEAM_CANDIDATES = "unknown", "beam", 10


def route_url(route_id: str):
    return F.concat(F.lit(ROUTE_PATH), F.col(route_id).cast("string"))


def job_options(routes: DataFrame) -> DataFrame:
    """job_id and its options, at most one per profile, in the order of the profiles."""
    place = F.array_position(F.array(*map(F.lit, catalog.PROFILES)), F.col("profile"))
    named = assign_profiles(routes).join(routes.select("route_id", (F.col("score") * 100.0).alias("score")), "route_id")
    return named.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "profile", "route_id", "score"))).alias("options"))


def job_status(jobs: DataFrame, routes: DataFrame) -> DataFrame:
    """State of every job with the routes it shows, the primary one first, and what to do after a failure.

    `jobs`: job_id, status, route_id, option_count, failure_reason, vibes, target_minutes. Only published states show routes; a
    job without a primary route of its own shows that of its first option. A positive option count limits the options.
    """
    rows = jobs.join(job_options(routes), "job_id", "left")
    published = F.coalesce(F.col("status").isin(PUBLISHED), F.lit(False))
    none = F.array().cast(rows.schema["options"].dataType)
    shown = F.coalesce(F.when(published, F.col("options")), none)
    limit = F.when(F.col("option_count") > 0, F.least(F.col("option_count"), F.size(shown))).otherwise(F.size(shown))
    rows = rows.withColumn("shown", F.slice(shown, F.lit(1), limit)).withColumn("primary_id", F.when(published, F.coalesce("route_id", F.get(shown, F.lit(0))["route_id"])))
    return rows.select("job_id", "status", F.col("primary_id").alias("route_id"), route_url("primary_id").alias("route_url"), F.col("shown").alias("options"),
                       F.when(F.col("status").isin(WORKING), REMAINING).alias("remaining_minutes"), *[v.alias(k) for k, v in failure_guidance().items()])


def route_details(routes: DataFrame, starts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Facts of every route beside its geometry: score in percent, quality tier, start, and the facts of its job if it has one.

    `routes`: route_id, job_id, score, km, minutes. `starts`: route_id, lat, lon, n_points. `jobs`: job_id, route_mode, started_us,
    completed_us, algorithm, beam_candidates, option_count.
    """
    algorithm = F.when(F.trim(F.coalesce("algorithm", F.lit(""))) == "", UNKNOWN_ALGORITHM).otherwise(F.col("algorithm"))
    met = routes.join(starts, "route_id", "left").join(jobs, "job_id", "left").withColumn("algorithm", algorithm)
    return met.select("route_id", "job_id", route_url("route_id").alias("route_url"), (F.col("score") * 100.0).alias("score"), scoring.quality_tier("score", F.coalesce("n_points", F.lit(0))).alias("quality_tier"), "km", "minutes",
                      F.coalesce("lat", F.lit(0.0)).alias("start_lat"), F.coalesce("lon", F.lit(0.0)).alias("start_lon"), "route_mode", F.coalesce("option_count", F.lit(0)).alias("option_count"), "algorithm",
                      F.coalesce("beam_candidates", F.when(F.col("algorithm").startswith(BEAM), BEAM_CANDIDATES)).alias("beam_candidates"), F.floor((F.col("completed_us") - F.col("started_us")) / 1000).alias("computation_ms"))
