"""Option selection over candidate tables: dedup, profile scores, pair measures, greedy picks, profile assignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vistagrid.functions import catalog, geo, text
from vistagrid.functions.scalars import clamp01, weighted_sum
from vistagrid.operators.paths import KM
from vistagrid.session import cut_lineage

# Fixed values of the selection rules.
SEPARATION_KM, SIMILAR, ALIKE = 0.35, 0.72, 0.50
SHORT_RATIO, SHORT_MIN = 0.78, 0.60


def union_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    return dedup_best(a.unionByName(b))


def dedup_best(cands: DataFrame) -> DataFrame:
    """One candidate per (request, signature): higher score in steps of 1e-4, then fewer minutes, then fewer km, then id."""
    rest = [x for x in cands.columns if x not in ("request_id", "signature")]
    order = F.struct(-F.floor(F.col("score") / 0.0001), "minutes", "km", "candidate_id")
    return cands.groupBy("request_id", "signature").agg(F.min_by(F.struct(*rest), order).alias("b")).select("request_id", "signature", "b.*")


def interleave(a: DataFrame, b: DataFrame, order: str = "position") -> DataFrame:
    """Two ordered lists merged one by one (a first), renumbered by `slot`."""
    return a.withColumn("slot", F.col(order) * 2).unionByName(b.withColumn("slot", F.col(order) * 2 + 1))


def max_minutes(target, ratio: float = 1.15) -> Column:
    t = F.greatest(F.lit(1), target)
    slack = F.greatest(F.lit(3), F.least(F.lit(10), F.ceil(t * 0.15)))
    return F.greatest(t, F.least(F.ceil(t * min(1.15, max(1.0, ratio))), t + slack)).cast("int")


def in_budget(cands: DataFrame) -> DataFrame:
    return cands.where(F.col("minutes") <= max_minutes(F.col("target_minutes")))


def strict_ok() -> Column:
    """Whether a candidate satisfies the strict contract of its strategy; other strategies always do."""
    fit = F.coalesce("strategy_fit_score", F.lit(0.0))
    urban = F.coalesce("corridor_urban_pressure", "urban_penalty", F.lit(1.0))
    s = F.col("strategy")
    return (F.when(s == "CURVY_ELEVATION", (fit >= 0.32) & (F.coalesce("curve_elevation_corridor_share", F.lit(0.0)) >= 0.28))
            .when(s == "OPEN_SPACE_ESCAPE", (fit >= 0.24) & (urban <= 0.72) & (F.coalesce("open_space_corridor_share", F.lit(0.0)) >= 0.18))
            .when(s == "QUIET_LOW_PRESSURE", (fit >= 0.30) & (urban <= 0.58) & (F.coalesce("quiet_corridor_share", F.lit(0.0)) >= 0.32))
            .otherwise(True))


def strict_contract(cands: DataFrame) -> DataFrame:
    """Candidates that satisfy their contract, for requests with at least three of them; the rest have no result."""
    ok = cands.where(strict_ok())
    enough = ok.groupBy("request_id").agg(F.count("*").alias("n"), F.first("strategy").alias("s"))
    lax = ~F.col("s").isin("CURVY_ELEVATION", "OPEN_SPACE_ESCAPE", "QUIET_LOW_PRESSURE")
    return ok.join(enough.where((F.col("n") >= 3) | lax).select("request_id"), "request_id", "left_semi")


def budget_fit() -> Column:
    m, t = F.col("minutes"), F.col("target_minutes")
    gap = F.when(m <= t, t - m).otherwise((m - t) * 2)
    return clamp01(1.0 - gap / F.greatest(F.lit(1), max_minutes(t)))


def budget_use() -> Column:
    return clamp01(F.col("minutes") / F.greatest(F.lit(1), F.col("target_minutes")))


def shorter_fit() -> Column:
    ratio = F.col("minutes") / F.greatest(F.lit(1.0), F.col("target_minutes"))
    fit = 1.0 - clamp01(F.abs(ratio - SHORT_RATIO) / 0.28)
    fit = F.when(ratio < SHORT_MIN, fit * clamp01(ratio / SHORT_MIN) * 0.55).when(ratio > 1.0, fit * F.greatest(F.lit(0.35), 1.0 - (ratio - 1.0) * 2.0)).otherwise(fit)
    return clamp01(fit)


def profile_scores(cands: DataFrame) -> DataFrame:
    """Adds s_scenic, s_balanced, s_shorter and s_primary; needs mean_turn and backtracking_penalty."""
    longest = cands.groupBy("request_id").agg(F.greatest(F.lit(0.1), F.max("km")).alias("max_km"))
    df = cands.join(longest, "request_id").withColumns({"fit": budget_fit(), "use": budget_use()})
    back = F.coalesce("backtracking_penalty", F.lit(0.0))
    target = F.greatest(F.lit(1), "target_minutes")
    near = 1.0 - clamp01(F.abs(F.col("minutes") - F.col("target_minutes")) / target)
    primary = weighted_sum([(F.coalesce("strategy_fit_score", F.lit(0.0)), 0.42), ("score", 0.32), (near, 0.14), ("use", 0.08),
                            (F.coalesce("strategy_mismatch_penalty", F.lit(0.0)), -0.18)])
    return df.withColumns({
        "s_scenic": weighted_sum([("score", 0.74), ("fit", 0.08), ("use", 0.18), (back, -0.18)]),
        "s_balanced": weighted_sum([("score", 0.46), ("fit", 0.34), ("use", 0.12), ("mean_turn", 0.08), (back, -0.12)]),
        "s_shorter": weighted_sum([(shorter_fit(), 0.46), ("score", 0.28), ("fit", 0.14), (1.0 - clamp01(F.col("km") / F.col("max_km")), 0.08),
                                   ("mean_turn", 0.04), (back, -0.07)]),
        "s_primary": F.when(F.col("strategy") == "BALANCED_VARIETY", F.col("score")).otherwise(primary)}).drop("max_km", "use")


def gaps_small(a: str, b: str) -> Column:
    """Duration and distance of two candidates are both too close to call them different."""
    minutes = F.abs(F.col(f"{a}minutes") - F.col(f"{b}minutes")) < F.greatest(F.lit(4), F.ceil(F.col(f"{a}target_minutes") * 0.08))
    km = F.abs(F.col(f"{a}km") - F.col(f"{b}km")) < F.greatest(F.lit(2.0), F.least(f"{a}km", f"{b}km") * 0.08)
    return minutes & km


def pair_penalty(separation: Column, similarity: Column, close: Column) -> Column:
    return F.greatest(F.when(separation < SEPARATION_KM, (SEPARATION_KM - separation) * 0.65).otherwise(0.0),
                      F.when(similarity > SIMILAR, similarity - SIMILAR + 0.28).otherwise(0.0),
                      F.when((similarity > ALIKE) & close, 0.18).otherwise(0.0))


def pair_different(separation: Column, similarity: Column, close: Column) -> Column:
    return (separation >= SEPARATION_KM) & (similarity <= SIMILAR) & ~((similarity > ALIKE) & close)


def path_arrays(points: DataFrame, samples: int = 80, cells: int = 96) -> DataFrame:
    """Per path: at most 80 evenly spaced points for distances and at most 97 coarse cells for overlap.

    Both arrays are bounded by construction, so pairs of paths can be compared without joining point tables.
    """
    from vistagrid.operators.paths import downsample, downsample_step

    even = downsample(points, samples).groupBy("route_id").agg(F.collect_list(F.struct("lat", "lon")).alias("pts"))
    keys = downsample_step(points, cells).groupBy("route_id").agg(F.collect_set(geo.coord_key("lat", "lon", 3)).alias("keys"))
    return even.join(keys, "route_id")


def with_separation(pairs: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """Adds the mean nearest distance both ways of two bounded point arrays in km, null where one is null.

    Computed over whole Arrow batches: as functions on arrays Spark interprets every one of the up to 12,800 distances of a pair.
    """
    def points(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return column.offsets.to_numpy(), *(np.radians(column.values.field(k).to_numpy()) for k in ("lat", "lon"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (ends, lat, lon), (ends2, lat2, lon2) = points(batch.column(a)), points(batch.column(b))
            found: list[float | None] = [None] * batch.num_rows
            for k in np.flatnonzero(batch.column(a).is_valid().to_numpy(False) & batch.column(b).is_valid().to_numpy(False)).tolist():
                i, j = slice(ends[k], ends[k + 1]), slice(ends2[k], ends2[k + 1])
                h = np.sin((lat2[None, j] - lat[i, None]) / 2) ** 2 + np.cos(lat[i, None]) * np.cos(lat2[None, j]) * np.sin((lon2[None, j] - lon[i, None]) / 2) ** 2
                if h.size:
                    found[k] = float(sum(np.arctan2(np.sqrt(x), np.sqrt(1 - x)).mean() for x in (h.min(axis=1), h.min(axis=0))) * KM)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, name])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField(name, DoubleType())]))


def jaccard(a, b) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(F.col(a)) + F.size(F.col(b)) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def option_pairs(options: DataFrame, key: str = "request_id", order: str = "option_no") -> DataFrame:
    """Pairs i < j of the options of a request. A request has one option per profile, so at most three pairs; repeated options are kept."""
    one = options
    left = one.select(key, *[F.col(c).alias(f"a_{c}") for c in one.columns if c != key])
    right = one.select(key, *[F.col(c).alias(f"b_{c}") for c in one.columns if c != key])
    return left.join(right, key).where(F.col(f"a_{order}") < F.col(f"b_{order}"))


def select_options(cands: DataFrame, arrays: DataFrame) -> DataFrame:
    """Three greedy picks per request (option 1..3): primary, balanced, shorter, each penalised by its nearness to the
    earlier picks. Only (candidate, pick) pairs are formed, never candidate pairs. Each round ends in a checkpoint in the
    shared folder, which keeps the plans of later rounds small.

    `cands` comes from profile_scores; `arrays` has (candidate_id, pts, keys).
    """
    pool = cut_lineage(cands.join(arrays, "candidate_id").withColumns({"penalty": F.lit(0.0), "nearest": F.lit(1e9), "differs": F.lit(True)}))
    picked, rounds = None, [("s_primary", False), ("s_balanced", True), ("s_shorter", True), ("s_balanced", False), ("s_shorter", False), ("fallback", False), ("fallback", False)]
    for i, (score, strict) in enumerate(rounds):
        value = F.col(score) if score != "fallback" else F.col("s_scenic") + clamp01(F.col("nearest") / SEPARATION_KM) * 0.30 + F.col("fit") * 0.10
        eligible = pool.where(F.col("differs")) if strict else pool
        if picked is not None:
            full = picked.groupBy("request_id").agg(F.count("*").alias("n")).where("n >= 3").select("request_id")
            eligible = eligible.join(full, "request_id", "left_anti")
        pick = eligible.groupBy("request_id").agg(F.max(F.struct((value - F.col("penalty")).alias("v"), (-F.col("candidate_id")).alias("neg"), "signature", "minutes", "km",
                                                                 "target_minutes", "pts", "keys")).alias("p"))
        pick = cut_lineage(pick.select("request_id", (-F.col("p.neg")).alias("p_id"), F.col("p.signature").alias("p_signature"), F.col("p.minutes").alias("p_minutes"),
                                  F.col("p.km").alias("p_km"), F.col("p.pts").alias("p_pts"), F.col("p.keys").alias("p_keys")))
        chosen = pick.select("request_id", F.col("p_id").alias("candidate_id"), F.lit(i).alias("round"))
        picked = chosen if picked is None else picked.unionByName(chosen)
        if i < len(rounds) - 1:
            j = pool.join(pick, "request_id", "left")
            has = F.col("p_id").isNotNull()
            j = j.where(~has | (F.col("signature") != F.col("p_signature")))
            j = with_separation(j, "pts", "p_pts", "sep").withColumns({"sim": F.when(has, jaccard("keys", "p_keys")),
                               "close": F.when(has, (F.abs(F.col("minutes") - F.col("p_minutes")) < F.greatest(F.lit(4), F.ceil(F.col("target_minutes") * 0.08)))
                                               & (F.abs(F.col("km") - F.col("p_km")) < F.greatest(F.lit(2.0), F.least("km", "p_km") * 0.08)))})
            pool = cut_lineage(j.withColumns({
                "penalty": F.when(has, F.greatest("penalty", pair_penalty(F.col("sep"), F.col("sim"), F.col("close")))).otherwise(F.col("penalty")),
                "nearest": F.when(has, F.least("nearest", "sep")).otherwise(F.col("nearest")),
                "differs": F.when(has, F.col("differs") & pair_different(F.col("sep"), F.col("sim"), F.col("close"))).otherwise(F.col("differs"))}).select(*pool.columns))
    order = Window.partitionBy("request_id").orderBy("round")
    return picked.withColumn("option", F.row_number().over(order)).drop("round")


def flat_score_fallback(cands: DataFrame) -> DataFrame:
    """Scores of requests whose candidates all score alike are spread by distance, turn, time fit and a small jitter."""
    span = cands.groupBy("request_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"), F.min("km").alias("km_lo"), F.max("km").alias("km_hi"), F.count("*").alias("n"))
    df = cands.join(span, "request_id")
    reach = F.when(F.col("km_hi") - F.col("km_lo") <= 0.0001, 0.5).otherwise(clamp01((F.col("km") - F.col("km_lo")) / (F.col("km_hi") - F.col("km_lo"))))
    time = clamp01(1.0 - F.abs(F.col("minutes") - F.col("target_minutes")) / F.greatest(F.lit(1.0), "target_minutes"))
    jitter = F.pmod(F.crc32("signature"), F.lit(1000)) / 1e6
    flat = (F.col("n") >= 2) & (F.col("hi") - F.col("lo") <= 0.0001)
    spread = clamp01(weighted_sum([(reach, 0.40), ("mean_turn", 0.25), (time, 0.10)]) + 0.25 + jitter)
    return df.withColumns({"flat": flat, "score": F.when(flat, spread).otherwise(F.col("score"))}).drop("lo", "hi", "km_lo", "km_hi", "n")


def rescue_flags(cands: DataFrame) -> DataFrame:
    """Per request: useful candidates, and whether the pool needs a rescue."""
    t = F.col("target_minutes")
    useful = F.ceil(F.greatest(F.lit(10.0), F.greatest(F.lit(1), t) * 0.55))
    g = cands.groupBy("request_id").agg(F.count_if(F.col("minutes") >= useful).alias("useful"), F.max("minutes").alias("hi"), F.min("minutes").alias("lo"),
                                        F.max(useful).alias("need"), F.max(F.greatest(F.lit(4), F.ceil(t * 0.08))).alias("gap"))
    return g.select("request_id", "useful", ((F.col("useful") < 3) | (F.col("hi") < F.col("need")) | (F.col("hi") - F.col("lo") < F.col("gap"))).alias("needs_rescue"))


def early_stop_eligible(cands: DataFrame) -> DataFrame:
    """Report of requests whose pool of deduplicated, in-budget, contract-keeping candidates would already suffice."""
    ok = in_budget(dedup_best(cands)).where(strict_ok())
    flags = rescue_flags(ok)
    n = cands.groupBy("request_id").agg(F.count("*").alias("attempts"), F.first("strategy").alias("strategy"))
    need = F.when(F.col("strategy") == "BALANCED_VARIETY", 12).otherwise(24)
    e = ok.groupBy("request_id").agg(F.count("*").alias("eligible"))
    out = n.join(e, "request_id", "left").join(flags, "request_id", "left")
    enough = (F.col("attempts") >= need) & (F.coalesce("eligible", F.lit(0)) >= 3) & ~F.coalesce("needs_rescue", F.lit(True))
    return out.select("request_id", "attempts", F.coalesce("eligible", F.lit(0)).alias("eligible"), enough.alias("may_stop"))


def backfill_profile(routes: DataFrame) -> DataFrame:
    """The first three routes of a job by time receive the three profiles where they have none.

    The rank limit is applied before the shuffle too, so a crowded job never reaches one task whole.
    """
    w = Window.partitionBy("job_id").orderBy("created_us", "route_id")
    first = routes.select("job_id", "route_id", "created_us").withColumn("n", F.row_number().over(w)).where("n <= 3")
    name = F.element_at(F.array(*[F.lit(p) for p in catalog.PROFILES]), F.col("n"))
    return routes.join(first.select("route_id", name.alias("filled")), "route_id", "left").withColumn(
        "route_profile", F.coalesce("route_profile", "filled")).drop("filled")


def assign_profiles(routes: DataFrame) -> DataFrame:
    """job_id, profile, route_id: the earliest route of each named profile; gaps are filled in order by the leftovers.

    At most three leftovers per job can be used, so ranks are cut at three.
    """
    r = routes.select("job_id", "route_id", "created_us", text.normalize_profile("route_profile").alias("profile"))
    named = r.where("profile IS NOT NULL").groupBy("job_id", "profile").agg(F.min(F.struct("created_us", "route_id")).alias("m")).select(
        "job_id", "profile", F.col("m.route_id").alias("route_id"))
    order = Window.partitionBy("job_id").orderBy("created_us", "route_id")
    spare = r.join(named.select("route_id"), "route_id", "left_anti").withColumn("k", F.row_number().over(order)).where("k <= 3").select("job_id", "k", "route_id")
    have = named.groupBy("job_id").agg(F.collect_set("profile").alias("have"))
    every = F.array(*[F.lit(p) for p in catalog.PROFILES])
    missing = r.select("job_id").distinct().join(have, "job_id", "left").select(
        "job_id", F.posexplode(F.filter(every, lambda p: ~F.array_contains(F.coalesce("have", F.array().cast("array<string>")), p))).alias("k0", "profile"))
    filled = missing.withColumn("k", F.col("k0") + 1).join(spare, ["job_id", "k"]).select("job_id", "profile", "route_id")
    return named.unionByName(filled)


def latest_state(events: DataFrame) -> DataFrame:
    """Row with the highest (state_rev, option_rev) per job; equal revisions go to the lowest event id."""
    return events.groupBy("job_id").agg(F.max_by(F.struct("state_rev", "option_rev", "status", "event_id"), F.struct("state_rev", "option_rev", -F.col("event_id"))).alias("s")).select("job_id", "s.*")
