"""Why an option was chosen: averages against a baseline, lifts, ranking signals and leading components."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog, geo, scoring
from vistagrid.functions.cells import HexGrid, k_ring
from vistagrid.functions.scalars import clamp, clamp01, round_half_up
from vistagrid.functions.text import normalize_profile
from vistagrid.operators.paths import downsample_step
from vistagrid.operators.profiles import blend_profiles

# Fixed values of the explanation rules.
BASELINE_M, BASELINE_TILES, SAMPLES = 50_000.0, 1000, 160
EPSILON, LEADS = 0.003, 3
STRICT_GAIN, ANTI_CUT, WEIGHTY_GAIN, FLAT_CUT = 1.35, 0.45, 1.08, 0.40
POI_ASKED, POI_FACTOR, POI_SUPPORT, POI_CAP, WEIGHTY = 0.30, 0.62, 0.04, 0.82, 0.16
AVERAGED = ["water", "greenery", "elevation", "solitude", "open_space", "curves", "poi"]
EXPLAINED = [*AVERAGED, "scenic_poi", "viewpoint", "bridge_coastal"]
# Components that a profile would rather lead with; the most scenic profile keeps its own order.
PROFILE_LEADS = {"balanced": ["solitude", "greenery", "curves", "elevation", "water", "poi"],
                 "shorter": ["curves", "elevation", "solitude", "greenery", "water", "poi"]}


def explained_components(tiles: DataFrame) -> DataFrame:
    """The seven averaged components of tiles that already have their component columns."""
    return tiles.select("cell", "lat", "lon", *[(scoring.open_space() if k == "open_space" else F.col(k)).alias(k) for k in AVERAGED])


# --- baseline -------------------------------------------------------------------------------------------------------


# Starts of a home that one task takes, and starts that are measured at a time.
PART, AT_A_TIME = 4096, 64


def _nearest_sums(metres: float, most: int):
    """Component sums over the `most` nearest tiles of each start, for the starts and the tiles in reach of one part of a home."""
    def run(starts: pa.Table, tiles: pa.Table) -> pa.Table:
        # In the order of their cells, so that the first of equal distances is the smaller cell.
        tiles = tiles.take(pc.sort_indices(tiles, [("cell", "ascending")]))
        tlat, tlon = (tiles[k].to_numpy() for k in ("tlat", "tlon"))
        values = np.nan_to_num(np.column_stack([tiles[k].to_numpy() for k in AVERAGED]))
        # Sums of multiples of 2^-30 are exact in any order, so a mean on the border of two roundings doesn't depend on noise.
        coarse = np.rint(values * 2.0**30) / 2.0**30
        fine = values - coarse
        slat, slon = (starts[k].to_numpy() for k in ("slat", "slon"))
        order = np.lexsort((slon, np.floor(slat * 10)))
        slat, slon = slat[order], slon[order]
        high, n, sums = metres / 111_000.0, np.zeros(len(slat), dtype=np.int64), np.zeros((len(slat), len(AVERAGED)))
        for i in range(0, len(slat), AT_A_TIME):
            y, x = slat[i:i + AT_A_TIME], slon[i:i + AT_A_TIME]
            wide = high / np.cos(np.radians(min(89.0, np.abs(y).max() + high)))
            near = np.flatnonzero((tlat >= y.min() - high) & (tlat <= y.max() + high) & (tlon >= x.min() - wide) & (tlon <= x.max() + wide))
            if not len(near):
                continue
            half_lat = np.sin(np.radians(tlat[near] - y[:, None]) / 2)
            half_lon = np.sin(np.radians(tlon[near] - x[:, None]) / 2)
            a = half_lat * half_lat + np.cos(np.radians(y))[:, None] * np.cos(np.radians(tlat[near])) * half_lon * half_lon
            d = np.arctan2(np.sqrt(a), np.sqrt(1 - a)) * (2 * geo.EARTH_M)
            d[d > metres] = np.inf
            if len(near) > most:
                last = np.partition(d, most - 1, axis=1)[:, most - 1:most]
                ties = (d == last) & (last < np.inf)
                taken = (d < last) | (ties & (np.cumsum(ties, axis=1) <= most - (d < last).sum(axis=1, keepdims=True)))
            else:
                taken = d < np.inf
            weights = taken.astype(float)
            n[i:i + AT_A_TIME], sums[i:i + AT_A_TIME] = taken.sum(axis=1), weights @ coarse[near] + weights @ fine[near]
        some = n > 0
        return pa.table({"slat": slat[some], "slon": slon[some], "baseline_tiles": n[some], **{k: sums[some, j] for j, k in enumerate(AVERAGED)}})

    return run


def baseline_averages(starts: DataFrame, tiles: DataFrame, grid: HexGrid, key: str = "request_id", metres: float = BASELINE_M, most: int = BASELINE_TILES) -> DataFrame:
    """Component means over the `most` nearest tiles within `metres` of each start: key, the seven means, baseline_tiles.

    `tiles` as from `explained_components`, one per cell. Starts live in a home, a cell whose one-cell ring reaches `metres`; a
    tile is copied to the few homes it can matter to, and no pair of start and tile ever leaves its task: distances of many
    starts are computed and added up over whole arrays. A home of many starts is dealt in parts, as many as its starts ask
    for; the table of homes is bounded by the lattice. Starts at the same place ask once. Ties go to the smaller cell.
    """
    res, tasks = grid.resolution_for(metres), int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    located = starts.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    homes = grid.placed(located, "slat", "slon", "home", res).groupBy("home").agg(F.ceil(F.count("*") / PART).alias("parts"))
    asked = grid.placed(located.distinct(), "slat", "slon", "home", res).join(F.broadcast(homes), "home")
    asked = asked.select("home", F.pmod(F.xxhash64("slat", "slon"), F.col("parts")).alias("part"), "slat", "slon")
    # The ring is taken at the latitude of the farthest start, where degrees of longitude are shortest.
    ring = k_ring(grid.cell_of("tlat", "tlon", res), grid.ring_for_metres(metres, F.least(F.lit(89.0), F.abs("tlat") + metres / 111_000.0), res))
    spread = tiles.select("cell", F.col("lat").alias("tlat"), F.col("lon").alias("tlon"), *AVERAGED)
    spread = spread.repartition(tasks).withColumn("home", F.explode(ring)).join(F.broadcast(homes), "home")
    spread = spread.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = "slat double, slon double, baseline_tiles bigint, " + ", ".join(f"{k} double" for k in AVERAGED)
    met = [df.repartition(tasks, "home", "part").groupBy("home", "part") for df in (asked, spread)]
    sums = met[0].cogroup(met[1]).applyInArrow(_nearest_sums(metres, most), schema)
    means = sums.select("slat", "slon", *[round_half_up(clamp01(F.col(k) / F.col("baseline_tiles")), 4).alias(k) for k in AVERAGED], "baseline_tiles")
    return starts.select(key, "lat", "lon").join(means, (F.col("lat") == F.col("slat")) & (F.col("lon") == F.col("slon"))).drop("lat", "lon", "slat", "slon")


# --- vectors of components ------------------------------------------------------------------------------------------


Vector = dict[str, Column]


def mapped(v: Vector, fn: Callable[[str, Column], Column]) -> Vector:
    return {k: fn(k, x) for k, x in v.items()}


def times(v: Vector, w: Vector) -> Vector:
    """Product by component; components that `w` lacks count as 0."""
    return mapped(v, lambda k, x: x * w.get(k, F.lit(0.0)))


def share(v: Vector) -> Vector:
    total = F.greatest(F.lit(0.0001), functools.reduce(lambda a, b: a + b, v.values()))
    return mapped(v, lambda k, x: x / total)


def rounded(v: Vector) -> Vector:
    return mapped(v, lambda k, x: round_half_up(clamp01(x), 4))


def greatest_of(v: Vector) -> Column:
    return F.greatest(*v.values())


def as_struct(v: Vector) -> Column:
    return F.struct(*[x.alias(k) for k, x in v.items()])


def from_struct(name: str, keys: list[str] = EXPLAINED) -> Vector:
    return {k: F.col(f"{name}.{k}") for k in keys}


def first_k(v: Vector, k: int) -> Column:
    """Names of the k largest components; equal values in component order."""
    ranked = F.sort_array(F.array(*[F.struct((-x).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, x) in enumerate(v.items())]))
    return F.transform(F.slice(ranked, 1, k), lambda s: s["name"])


def component_lifts(averages: Vector, baseline: Vector) -> Vector:
    """Average minus baseline per component; without a baseline nothing is lifted, and what is not averaged is 0."""
    return {k: round_half_up(clamp(averages[k] - F.coalesce(baseline[k], averages[k]), -1.0, 1.0), 4) if k in averages else F.lit(0.0) for k in EXPLAINED}


def weighted_lifts(lifts: Vector, weights: Vector) -> Vector:
    return rounded(times(mapped(lifts, lambda k, x: F.greatest(F.lit(0.0), x)), weights))


def contributions(averages: Vector, weights: Vector) -> Vector:
    return rounded(share(times({k: averages.get(k, F.lit(0.0)) for k in EXPLAINED}, weights)))


def _signals(base: Vector, lifts: Vector, weights: Vector, lift_based: bool) -> Vector:
    """One round of ranking signals, with the points of interest not yet capped."""
    def signal(k: str, x: Column) -> Column:
        x = x * F.when(F.array_contains("targets", k), F.when(F.col("strict"), STRICT_GAIN).otherwise(1.18)).otherwise(1.0)
        x = x * F.when(F.array_contains("antis", k), ANTI_CUT).otherwise(1.0)
        weight = weights.get(k, F.lit(0.0))
        if k == "poi":
            return x * F.when(weight >= POI_ASKED, POI_FACTOR).otherwise(POI_SUPPORT)
        x = x * F.when(weight >= WEIGHTY, WEIGHTY_GAIN).otherwise(1.0)
        return x * F.when(lifts[k] <= EPSILON, FLAT_CUT).otherwise(1.0) if lift_based else x

    return rounded(mapped(base, signal))


def _capped(signals: Vector, weights: Vector, best_other: Column) -> Vector:
    cap = (weights["poi"] < POI_ASKED) & (best_other > EPSILON)
    return {k: F.when(cap, round_half_up(clamp01(F.least(x, best_other * POI_CAP)), 4)).otherwise(x) if k == "poi" else x for k, x in signals.items()}


def explained(options: DataFrame) -> DataFrame:
    """Adds lifts, contributions and the leading components of each option.

    Needs structs `averages` and `baseline` (AVERAGED; a null baseline lifts nothing), `weights` (ratios, AVERAGED), and the
    vibe profile columns targets, antis, strict. Where no component but points of interest carries a signal, the signals
    are built again from the contributions.
    """
    averages, weights = from_struct("averages", AVERAGED), from_struct("weights", AVERAGED)
    lifted = options.withColumns({"lifts": as_struct(component_lifts(averages, from_struct("baseline", AVERAGED))), "contributions": as_struct(contributions(averages, weights))})
    lifts = from_struct("lifts")
    lifted = lifted.withColumn("weighted_lifts", as_struct(weighted_lifts(lifts, weights)))
    lifted = lifted.withColumn("lift_based", greatest_of(from_struct("weighted_lifts")) > EPSILON)
    for name, base, lift_based in (("by_lift", "weighted_lifts", True), ("by_share", "contributions", False)):
        lifted = lifted.withColumn(name, as_struct(_signals(from_struct(base), lifts, weights, lift_based)))
        others = {k: x for k, x in from_struct(name).items() if k != "poi"}
        lifted = lifted.withColumn(f"{name}_other", greatest_of(others))
        lifted = lifted.withColumn(name, as_struct(_capped(from_struct(name), weights, F.col(f"{name}_other"))))
    use = F.col("lift_based") & (F.col("by_lift_other") > EPSILON)
    lifted = lifted.withColumn("signals", F.when(use, F.col("by_lift")).otherwise(F.col("by_share")))
    return lifted.withColumn("leading_components", first_k(from_struct("signals"), LEADS)).drop("by_lift", "by_share", "by_lift_other", "by_share_other", "weighted_lifts")


def route_averages(points: DataFrame, tiles: DataFrame, grid: HexGrid) -> DataFrame:
    """Means over the tiles under at most about 160 samples of each route, each tile once: route_id, averages, sample_tiles."""
    cells = downsample_step(points, SAMPLES).select("route_id", grid.cell_of("lat", "lon").alias("cell")).distinct()
    met = cells.join(tiles.drop("lat", "lon"), "cell")
    means = {k: round_half_up(clamp01(F.avg(k)), 4) for k in AVERAGED}
    return met.groupBy("route_id").agg(as_struct(means).alias("averages"), F.count("*").alias("sample_tiles"))


def explained_options(trips: DataFrame, points: DataFrame, tiles: DataFrame, grid: HexGrid, metres: float = BASELINE_M, most: int = BASELINE_TILES) -> DataFrame:
    """Explanation of every option (route_id, request_id, option_no, route_profile, vibes, w_<component>); the baseline is
    taken around the first point of the request's first option."""
    comps = explained_components(scoring.component_scores(tiles))
    first = trips.groupBy("request_id").agg(F.min("route_id").alias("route_id"))
    starts = first.join(points.where("seq = 0").select("route_id", "lat", "lon"), "route_id").select("request_id", "lat", "lon")
    base = baseline_averages(starts, comps, grid, metres=metres, most=most).select("request_id", F.struct(*AVERAGED).alias("baseline"), "baseline_tiles")
    total = F.greatest(F.lit(0.0001), functools.reduce(lambda a, b: a + b, [F.col(f"w_{k}") for k in catalog.COMPONENTS]))
    ratios = {k: F.col(f"w_{'solitude' if k == 'open_space' else k}") / total for k in AVERAGED}
    options = blend_profiles(trips.withColumn("weights", as_struct(ratios)))
    return explained(options.join(route_averages(points, comps, grid), "route_id").join(base, "request_id", "left"))


# --- leads ----------------------------------------------------------------------------------------------------------


def diversify_leads(options: DataFrame, key: str = "request_id", order: str = "option_no") -> DataFrame:
    """Leading components per option, re-ordered where all options of a request lead with the same one.

    The options of a request (a handful by contract) are folded in their order with the set of used leads: each takes the first
    component its profile prefers that is among its own and unused, then its first unused one, then its first. Requests with
    one option, or with an option that leads with nothing, stay as they are.
    """
    wanted = F.create_map(*[x for p, names in PROFILE_LEADS.items() for x in (F.lit(p), F.array(*map(F.lit, names)))])
    own = F.coalesce(F.col("leading_components"), F.array().cast("array<string>"))
    rows = options.select(key, F.struct(F.col(order).alias("at"), F.col("route_id"), own.alias("leads"), F.coalesce(wanted[normalize_profile("route_profile")], own).alias("prefers")).alias("o"))
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list("o")).alias("os"))
    firsts = F.transform("os", lambda o: F.get(o["leads"], F.lit(0)))
    same = (F.size("os") > 1) & ~F.exists(firsts, lambda f: f.isNull()) & (F.size(F.array_distinct(firsts)) == 1)

    def take(acc, o):
        free = lambda names: F.filter(names, lambda n: F.array_contains(o["leads"], n) & ~F.array_contains(acc["used"], n))
        lead = F.coalesce(F.get(free(o["prefers"]), F.lit(0)), F.get(free(o["leads"]), F.lit(0)), F.get(o["leads"], F.lit(0)))
        turned = F.concat(F.array(lead), F.filter(o["leads"], lambda n: n != lead))
        return F.struct(F.array_append(acc["used"], lead).alias("used"), F.array_append(acc["done"], F.struct(o["route_id"].alias("route_id"), turned.alias("leads"))).alias("done"))

    kind = options.schema["route_id"].dataType.simpleString()
    none = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast(f"array<struct<route_id:{kind},leads:array<string>>>").alias("done"))
    kept = F.transform("os", lambda o: F.struct(o["route_id"].alias("route_id"), o["leads"].alias("leads")))
    done = grouped.select(key, F.explode(F.when(same, F.aggregate("os", none, take)["done"]).otherwise(kept)).alias("d"), same.alias("diversified"))
    return done.select(key, "d.route_id", F.col("d.leads").alias("leading_components"), "diversified")
