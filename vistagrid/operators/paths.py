"""Path operators on point tables (route_id, seq = 0, 1, 2, ..., n_points, lat, lon) and path scoring.

Neighbouring points are reached through spans with halos, so a route with any share of all points stays spread out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vistagrid.functions import catalog, cells, geo, scoring
from vistagrid.functions.cells import HexGrid
from vistagrid.functions.scalars import clamp01, graded, mean_of, unit, weighted_sum
from vistagrid.operators.skew import SPAN, drop_halo, numbered, running_total, span_window, with_halo
from vistagrid.operators.spatial import salted_join
from vistagrid.session import cut_lineage, shared

ROUTE = ["route_id"]
KM = geo.EARTH_KM


def with_next(points: DataFrame) -> DataFrame:
    """Adds next_lat and next_lon (null at the end)."""
    w = span_window(ROUTE, "seq")
    out = with_halo(points, ROUTE, "seq", after=1).withColumns({"next_lat": F.lead("lat").over(w), "next_lon": F.lead("lon").over(w)})
    return drop_halo(out)


def distance_to_next(points: DataFrame, radius: float = KM) -> DataFrame:
    """Kilometres to the next point, 0 at the last one."""
    d = geo.haversine("lat", "lon", "next_lat", "next_lon", radius)
    return with_next(points).withColumn("to_next", F.when(F.col("next_lat").isNull(), 0.0).otherwise(d)).drop("next_lat", "next_lon")


def mean_turn(points: DataFrame) -> DataFrame:
    """route_id, mean_turn: mean absolute bearing change / 90; fewer than three points give 0."""
    w = span_window(ROUTE, "seq")
    p = with_halo(points, ROUTE, "seq", before=1, after=1).withColumns({
        "a_lat": F.lag("lat").over(w), "a_lon": F.lag("lon").over(w), "b_lat": F.lead("lat").over(w), "b_lon": F.lead("lon").over(w)})
    into, out = geo.bearing("a_lat", "a_lon", "lat", "lon"), geo.bearing("lat", "lon", "b_lat", "b_lon")
    p = drop_halo(p).withColumns({"b1": into, "b2": out})
    t = F.when(F.col("a_lat").isNotNull() & F.col("b_lat").isNotNull(), geo.turn("b1", "b2"))
    return p.groupBy("route_id").agg(clamp01(F.coalesce(F.avg(t), F.lit(0.0)) / 90.0).alias("mean_turn"))


def compress_cells(points: DataFrame, grid: HexGrid, res: int = cells.CRAFT_RESOLUTION) -> DataFrame:
    """Cells along each path without consecutive repeats; needs dense seq."""
    w = span_window(ROUTE, "seq")
    p = with_halo(points.withColumn("cell", grid.cell_of("lat", "lon", res)), ROUTE, "seq", before=1)
    p = drop_halo(p.withColumn("prev_cell", F.lag("cell").over(w)))
    return p.where(F.col("prev_cell").isNull() | (F.col("cell") != F.col("prev_cell"))).select("route_id", "seq", "cell", "prev_cell")


def downsample(points: DataFrame, n: int) -> DataFrame:
    """At most n points at evenly spaced rounded positions, ends included; short paths are kept whole.

    Whether a position is hit follows from arithmetic on (seq, n_points), so this is a plain filter.
    """
    last = F.col("n_points") - 1
    i0 = F.floor(F.col("seq") * (n - 1) / F.greatest(F.lit(1), last))

    def hits(i):
        return (i >= 0) & (i <= n - 1) & (F.floor(i * last / float(n - 1) + 0.5) == F.col("seq"))

    return points.where((F.col("n_points") <= n) | hits(i0 - 1) | hits(i0) | hits(i0 + 1))


def downsample_step(points: DataFrame, n: int) -> DataFrame:
    """Every ceil(count / n)-th point and the last one."""
    step = F.greatest(F.lit(1), F.ceil(F.col("n_points") / float(n)))
    return points.where((F.col("seq") % step == 0) | (F.col("seq") == F.col("n_points") - 1))


def segment_scores(points: DataFrame, routes: DataFrame) -> DataFrame:
    """Score of each leg from the route score, its share of the distance and its closeness to the middle."""
    d = distance_to_next(points)
    total = d.groupBy("route_id").agg(F.sum("to_next").alias("total"))
    legs = d.where(F.col("seq") < F.col("n_points") - 1).join(total, "route_id").join(routes.select("route_id", "score"), "route_id")
    share = F.when(F.col("total") > 0, F.col("to_next") / F.col("total")).otherwise(1.0 / (F.col("n_points") - 1))
    progress = F.col("seq") / F.greatest(F.lit(1), F.col("n_points") - 2)
    score = clamp01(F.col("score") * 0.82 + share * 0.12 + (1.0 - F.abs(progress - 0.5) * 2.0) * 0.06)
    return legs.select("route_id", "seq", score.alias("segment_score"))


def with_cumulative(points: DataFrame) -> DataFrame:
    """Adds cum_m, the metres travelled up to each point."""
    d = distance_to_next(points).withColumn("step_m", F.col("to_next") * 1000.0)
    return running_total(d, ROUTE, "seq", "step_m", "upto").withColumn("cum_m", F.col("upto") - F.col("step_m")).drop("upto", "step_m", "to_next")


# A kept point may lie this much before its mark: running sums and restarted sums differ in the last digits.
SLACK_M = 1e-7
EXITS = "route_id bigint, span bigint, keys array<double>, exits array<double>, counts array<bigint>, at_end array<boolean>"
ENTRIES = "route_id bigint, span bigint, mark double, base bigint, n_samples bigint, closing boolean"


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of whole groups and where each group starts (and the end), from rows sorted by the keys.

    Most routes are short; many of them share a batch, where a call per group would cost more than its work.
    """
    held: list[pa.RecordBatch] = []

    def joined(parts):
        rows = pa.concat_batches(parts)
        change = np.logical_or.reduce([np.diff(rows.column(k).to_numpy()) != 0 for k in keys])
        return rows, np.r_[0, np.flatnonzero(change) + 1, rows.num_rows]

    for batch in batches:
        if not batch.num_rows:
            continue
        other = np.logical_or.reduce([(ids := batch.column(k).to_numpy()) != ids[-1] for k in keys])
        start = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if start:
            yield joined([*held, batch.slice(0, start)])
            held = []
        held.append(batch.slice(start))
    if held:
        yield joined(held)


def _next_kept(cum: np.ndarray, metres: float) -> list[int]:
    """For every point of a span the next kept one, if it is kept itself."""
    return np.maximum(np.searchsorted(cum, cum + metres - SLACK_M), np.arange(len(cum)) + 1).tolist()


def _exit_maps(metres: float):
    """What a walk does to a span, whatever came before it: for each point that can be the span's first kept one, the
    travelled metres at its last kept one, the number of kept ones, and whether the last kept one ends the span.

    A walk enters a span at most `metres` behind its first point, so only the points up to there can be first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, ["route_id", "span"]):
            every, maps = rows.column("cum_m").to_numpy(), []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                cum = every[a:b]
                after = _next_kept(cum, metres)
                last, count = list(range(len(cum))), [1] * len(cum)
                for i in range(len(cum) - 1, -1, -1):
                    if after[i] < len(cum):
                        last[i], count[i] = last[after[i]], count[after[i]] + 1
                n = min(len(cum), int(np.searchsorted(cum, cum[0] + metres, "right")) + 1)
                maps.append((cum[:n], cum[last[:n]], count[:n], [x == len(cum) - 1 for x in last[:n]]))
            first = pa.array(at[:-1])
            kinds = [pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]
            yield pa.RecordBatch.from_arrays([rows.column("route_id").take(first), rows.column("span").take(first), *[pa.array(x, t) for x, t in zip(zip(*maps), kinds)]],
                                             names=["route_id", "span", "keys", "exits", "counts", "at_end"])

    return run


def _walks(metres: float):
    """Entry mark of every span of a route, from its exit maps in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, ["route_id"]):
            maps = list(zip(*[rows.column(k).to_pylist() for k in ("keys", "exits", "counts", "at_end")]))
            entries = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                mark, n, closed, own = -np.inf, 0, False, []
                for keys, exits, counts, at_end in maps[a:b]:
                    own.append((mark, n))
                    i = bisect_left(keys, mark - SLACK_M)
                    closed = False
                    if i < len(keys):
                        mark, n, closed = exits[i] + metres, n + counts[i], at_end[i]
                total = n if closed else n + 1
                entries += [(*e, total, not closed and k == b - a - 1) for k, e in enumerate(own)]
            yield pa.RecordBatch.from_arrays([rows.column("route_id"), rows.column("span"), *[pa.array(x, t) for x, t in zip(zip(*entries), (pa.float64(), pa.int64(), pa.int64(), pa.bool_()))]],
                                             names=["route_id", "span", "mark", "base", "n_samples", "closing"])

    return run


def _kept(metres: float, names: list[str]):
    """Kept points of the spans, each span led by the row of its entry mark; the closing span also keeps the route's last point."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, at in whole_groups(batches, ["route_id", "span"]):
            first = pa.array(at[:-1])
            marks, bases, totals, closing = (rows.column(k).take(first).to_pylist() for k in ("mark", "base", "n_samples", "closing"))
            every, kept, idx, n = rows.column("cum_m").to_numpy(zero_copy_only=False), [], [], []
            for a, b, mark, base, total, close in zip((at[:-1] + 1).tolist(), at[1:].tolist(), marks, bases, totals, closing):
                cum = every[a:b]
                after, own = _next_kept(cum, metres), []
                i = int(np.searchsorted(cum, mark - SLACK_M))
                while i < len(cum):
                    own.append(a + i)
                    i = after[i]
                if close:
                    own.append(b - 1)
                kept += own
                idx += range(base, base + len(own))
                n += [total] * len(own)
            chosen = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([*[rows.column(k).take(chosen) for k in names], pa.array(idx, pa.int64()), pa.array(n, pa.int64())], names=[*names, "idx", "n_samples"])

    return run


def sample_path(points: DataFrame, metres: float, span: int = SPAN) -> DataFrame:
    """First point, each point at which at least `metres` have gathered since the last kept one, and the last point.

    Adds `idx` and `n_samples`. Three steps, none of which needs a whole route in one task: every span of 4,096 points gives
    its exit map, a few numbers; a walk over the maps of a route gives each span its entry mark; every span then keeps its
    points from there. Each step runs over sorted partitions, many routes at a time.
    """
    names = points.columns
    cum = with_cumulative(points).select(*names, F.floor(F.col("seq") / span).alias("span"), "cum_m")

    def dealt(df: DataFrame, *keys: str, order: tuple = ()) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, *order)

    maps = dealt(cum.select("route_id", "span", "seq", "cum_m"), "route_id", "span", order=("seq",)).mapInArrow(_exit_maps(metres), EXITS)
    entries = dealt(maps, "route_id", order=("span",)).mapInArrow(_walks(metres), ENTRIES)
    rows = dealt(cum.unionByName(entries, allowMissingColumns=True), "route_id", "span", order=(F.col("seq").asc_nulls_first(),))
    schema = StructType([*points.schema.fields, StructField("idx", LongType()), StructField("n_samples", LongType())])
    return rows.mapInArrow(_kept(metres, names), schema)


def leg_split(samples: DataFrame) -> DataFrame:
    """Adds leg 1, 2 or 3 (null in the trimmed ends) to samples with idx and n_samples; needs at least nine samples."""
    n, i = F.col("n_samples"), F.col("idx")
    first = F.greatest(F.lit(2), F.floor(n / 3))
    middle = F.greatest(first + 2, F.floor(n * 2 / 3))

    def trim(length):
        return F.greatest(F.lit(1), F.floor(length / 5))

    start = F.when(first > 3, trim(first)).otherwise(0)
    tail = n - middle
    stop = F.when(tail > 3, n - trim(tail)).otherwise(n)
    leg = (F.when(n < 9, None).when((i >= start) & (i < first), 1).when((i >= first) & (i < middle), 2).when((i >= middle) & (i < stop), 3))
    return samples.withColumn("leg", leg)


NEAR_KM, LEG_KM, WINDOW_STEPS = 0.12, 0.85, 4


def craft_metrics(points: DataFrame, grid: HexGrid, metres: float = 350.0) -> DataFrame:
    """Repeated cells, reversed edges, separation of the three legs, near duplicates and the backtracking penalty."""
    headers = points.groupBy("route_id").agg(F.max("n_points").alias("n_points"))
    sampled = shared(sample_path(points, metres))
    few = sampled.groupBy("route_id").agg(F.max("n_samples").alias("k"))
    # Fewer than four samples: the path itself takes their place.
    whole = points.join(few.where("k < 4").select("route_id"), "route_id", "left_semi").withColumns({"idx": F.col("seq"), "n_samples": F.col("n_points")})
    cols = ["route_id", "idx", "n_samples", "lat", "lon"]
    s = shared(sampled.where("n_samples >= 4").select(*cols).unionByName(whole.select(*cols)))
    line = compress_cells(s.withColumn("seq", F.col("idx")), grid)
    edge = F.when(F.col("prev_cell").isNotNull(), F.concat_ws("|", F.least("cell", "prev_cell"), F.greatest("cell", "prev_cell")))
    shares = line.withColumn("edge", edge).groupBy("route_id").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("u"),
                                                                  F.count("edge").alias("e"), F.count_distinct("edge").alias("ue"))
    repeated = F.when(F.col("n") < 2, 0.0).otherwise((F.col("n") - F.col("u")) / F.col("n"))
    reverse = F.when((F.col("n") < 3) | (F.col("e") == 0), 0.0).otherwise((F.col("e") - F.col("ue")) / F.col("e"))
    shares = shares.select("route_id", repeated.alias("repeated_cell_share"), reverse.alias("reverse_overlap_share"))
    out = headers.join(shares, "route_id", "left").join(leg_separation(s), "route_id", "left").join(near_duplicates(s, grid), "route_id", "left")
    short = F.col("n_points") < 4
    r, v = (F.when(short, 0.0).otherwise(F.coalesce(k, F.lit(0.0))) for k in ("repeated_cell_share", "reverse_overlap_share"))
    leg = F.when(short, 1.0).otherwise(F.coalesce("leg_separation", F.lit(1.0)))
    dup = F.when(short, 0.0).otherwise(F.coalesce("near_duplicate_risk", F.lit(0.0)))
    penalty = F.when(short, 0.0).otherwise(clamp01(weighted_sum([(r, 0.34), (v, 0.30), (1.0 - leg, 0.24), (dup, 0.12)])))
    return out.select("route_id", r.alias("repeated_cell_share"), v.alias("reverse_overlap_share"), leg.alias("leg_separation"),
                      dup.alias("near_duplicate_risk"), penalty.alias("backtracking_penalty"))


def leg_separation(samples: DataFrame) -> DataFrame:
    """Smallest symmetric mean nearest distance among the three legs, scaled so that 0.85 km is fully separate."""
    legs = leg_split(samples).where("leg IS NOT NULL").select("route_id", "idx", "leg", "lat", "lon")
    other = legs.select("route_id", F.col("leg").alias("to_leg"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    pairs = legs.join(other, "route_id").where(F.col("leg") != F.col("to_leg"))
    near = pairs.groupBy("route_id", "leg", "to_leg", "idx").agg(F.min(geo.haversine("lat", "lon", "to_lat", "to_lon", KM)).alias("d"))
    one_way = near.groupBy("route_id", F.least("leg", "to_leg").alias("a"), F.greatest("leg", "to_leg").alias("b"), "leg").agg(F.avg(clamp01(F.col("d") / LEG_KM)).alias("m"))
    both = one_way.groupBy("route_id", "a", "b").agg(F.avg("m").alias("m"), F.count("*").alias("n"))
    return both.groupBy("route_id").agg(F.when(F.count("*") == 3, clamp01(F.min("m"))).otherwise(1.0).alias("leg_separation"))


def near_duplicates(samples: DataFrame, grid: HexGrid) -> DataFrame:
    """Share of samples that come back within 0.12 km of a sample more than four steps later, loop closure excepted.

    Samples meet through fine cells and their neighbours, never all against all.
    """
    res = grid.resolution_for(NEAR_KM * 1000.0)
    s = samples.where("n_samples >= 8").select("route_id", "idx", "n_samples", "lat", "lon")
    left = s.withColumn("__c", F.explode(cells.k_ring(grid.cell_of("lat", "lon", res), grid.ring_for_metres(NEAR_KM * 1000.0, "lat", res))))
    right = s.select("route_id", F.col("idx").alias("j"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"), grid.cell_of("lat", "lon", res).alias("__c"))
    closure = (F.col("idx") <= WINDOW_STEPS) & (F.col("j") >= F.col("n_samples") - WINDOW_STEPS - 1)
    hit = left.join(right, ["route_id", "__c"]).where((F.col("j") > F.col("idx") + WINDOW_STEPS) & ~closure
                                                      & (geo.haversine("lat", "lon", "to_lat", "to_lon", KM) <= NEAR_KM))
    risky = hit.select("route_id", "idx").distinct().groupBy("route_id").agg(F.count("*").alias("risky"))
    total = s.groupBy("route_id").agg(F.max("n_samples").alias("n"))
    return total.join(risky, "route_id", "left").select("route_id", clamp01(F.coalesce("risky", F.lit(0)) / F.col("n")).alias("near_duplicate_risk"))


# --- corridor scoring ------------------------------------------------------------------------------------------------

def corridor_tiles(points: DataFrame, tiles: DataFrame, grid: HexGrid, metres: float = 500.0) -> DataFrame:
    """Tiles along each path in order, repeats kept; a path without any tile of its own uses the tiles within two rings.

    Adds `pos` (dense) and `n_tiles` per route.
    """
    s = shared(sample_path(points, metres).select("route_id", "idx", grid.cell_of("lat", "lon").alias("cell")))
    known = tiles.select("cell")
    direct = s.join(known, "cell", "left_semi")
    lost = s.join(direct.select("route_id").distinct(), "route_id", "left_anti")
    ring = lost.select("route_id", F.explode(cells.k_ring("cell", F.lit(2))).alias("cell")).distinct().join(known, "cell", "left_semi")
    found = cut_lineage(direct.unionByName(ring.withColumn("idx", F.lit(0).cast("bigint"))))
    # Positions: rows of earlier spans of samples, then the rank inside a span; the tile columns come last. However many routes
    # there are, they may share a few cells: each cell is spread over tasks, and only the tiles that are met take part.
    ranked = numbered(found, ["idx", "cell"], F.floor(F.col("idx") / 4096), ROUTE, "pos", total="n_tiles")
    met = tiles.join(found.select("cell").distinct(), "cell", "left_semi")
    return salted_join(ranked.withColumn("pos", F.col("pos") - 1), met, "cell", by=["route_id", "idx"])


def corridor_scores(points: DataFrame, trips: DataFrame, tiles: DataFrame, grid: HexGrid) -> DataFrame:
    """Corridor tiles with the score and fit of the trip's own weights and vibes; `tiles` has component columns.

    Fits of all vibes are computed once per tile, before the join.
    """
    priced = tiles.withColumns({"fits": scoring.vibe_fits(), "pressure": scoring.urban_pressure(), "open": scoring.open_space()})
    c = corridor_tiles(points, priced, grid).join(trips, "route_id")
    weights = {k: F.col(f"w_{k}") for k in catalog.COMPONENTS}
    return c.withColumns({"landscape": scoring.score_tile(weights), "fit": scoring.blended_fit("fits", "vibes")})


SIGNAL_MEANS = ["road_stress_score", "water_visibility_score", "water_crossing_score", "coastal_road_score", "tree_canopy_score",
                "scenic_poi_score", "viewpoint_score", "bridge_coastal_score"]


def corridor_means(corridor: DataFrame) -> DataFrame:
    return corridor.groupBy("route_id").agg(
        clamp01(F.avg("landscape")).alias("landscape_score"), F.avg("fit").alias("vibe_fit_score"), clamp01(F.avg("pressure")).alias("urban_penalty"),
        *[clamp01(F.avg(unit(s))).alias(s) for s in SIGNAL_MEANS], F.count("*").alias("corridor_tile_samples"))


def scenic_moments(corridor: DataFrame) -> DataFrame:
    """Peak, continuity above 0.45 and evenness of the landscape scores."""
    m = corridor.groupBy("route_id").agg(F.max("landscape").alias("peak"), F.count_if(F.col("landscape") >= 0.45).alias("k"), F.count("*").alias("n"),
                                         F.stddev_pop(clamp01("landscape")).alias("sd"))
    even = 1.0 - clamp01(F.coalesce("sd", F.lit(0.0)) / 0.35)
    return m.select("route_id", clamp01(F.col("peak") * 0.32 + F.col("k") / F.col("n") * 0.46 + even * 0.22).alias("scenic_moments_score"))


def edge_penalty(corridor: DataFrame, edge: int = 4) -> DataFrame:
    """Weak scenery and urban pressure over the first and last four tiles."""
    k = F.least(F.lit(edge), F.col("n_tiles"))
    at_edge = (F.col("pos") < k) | (F.col("pos") >= F.greatest(k, F.col("n_tiles") - k))
    return corridor.where(at_edge).groupBy("route_id").agg(
        clamp01((1.0 - F.avg("landscape")) * 0.55 + clamp01(F.avg("pressure")) * 0.45).alias("start_end_penalty"))


def top_fraction_mean(df: DataFrame, key: str, value: str, fraction: float, name: str, buckets: int = 1024) -> DataFrame:
    """Mean of the largest ceil(n * fraction) values in [0, 1] per key, without sorting a key in one task.

    A histogram finds the bucket the cut falls into; only that bucket is ranked, by distinct value.
    """
    d = df.select(key, F.col(value).alias("v")).withColumn("b", F.least(F.lit(buckets - 1), F.floor(F.col("v") * buckets)))
    h = d.groupBy(key, "b").agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    w = Window.partitionBy(key).orderBy(F.desc("b"))
    h = h.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(key))})
    limit = F.greatest(F.lit(1), F.ceil(F.col("total") * fraction))
    h = h.withColumns({"want": limit, "before": F.col("upto") - F.col("n")})
    full = h.where("upto <= want").select(key, "s", F.col("n").cast("double").alias("k"))
    cut = h.where("upto > want AND before < want").select(key, "b", (F.col("want") - F.col("before")).alias("need"))
    vals = d.groupBy(key, "b", "v").agg(F.count("*").alias("c")).join(cut, [key, "b"])
    vals = vals.withColumn("seen", F.sum("c").over(Window.partitionBy(key, "b").orderBy(F.desc("v"))) - F.col("c"))
    take = F.least(F.col("c"), F.greatest(F.lit(0), F.col("need") - F.col("seen")))
    part = vals.where("seen < need").select(key, (F.col("v") * take).alias("s"), take.cast("double").alias("k"))
    return full.unionByName(part).groupBy(key).agg((F.sum("s") / F.sum("k")).alias(name))


def strategy_metrics(corridor: DataFrame) -> DataFrame:
    """Corridor shares, photo peak, strategy fit and mismatch penalty per route."""
    corridor = shared(corridor)
    low_urban, low_stress = 1.0 - clamp01("pressure"), 1.0 - unit("road_stress_score")
    quiet = clamp01(weighted_sum([("solitude", 0.44), ("greenery", 0.18), (low_urban, 0.20), (low_stress, 0.08), (unit("darkness_score"), 0.10)]))
    opening = clamp01(weighted_sum([("open", 0.68), (low_urban, 0.20), (low_stress, 0.12)]))
    photo = F.greatest("water", "elevation", "poi", unit("scenic_poi_score"), unit("viewpoint_score"))
    c = corridor.withColumns({"m_water": graded(F.greatest("water", unit("bridge_coastal_score")), 0.38, 0.70), "m_open": graded(opening, 0.40, 0.72),
                              "m_quiet": graded(quiet, 0.40, 0.72), "m_curve": graded(F.greatest("curves", "elevation"), 0.38, 0.70), "photo": photo})
    m = c.groupBy("route_id").agg(clamp01(F.avg("m_water")).alias("water_share"), clamp01(F.avg("m_open")).alias("open_share"),
                                  clamp01(F.avg("m_quiet")).alias("quiet_share"), clamp01(F.avg("m_curve")).alias("curve_share"),
                                  clamp01(F.greatest(F.max("photo"), F.max("landscape"))).alias("photo_peak"), F.first("strategy").alias("strategy"))
    chosen = F.when(F.col("strategy") == "OPEN_SPACE_ESCAPE", F.col("m_open")).when(F.col("strategy") == "QUIET_LOW_PRESSURE", F.col("m_quiet")).when(
        F.col("strategy") == "CURVY_ELEVATION", F.col("m_curve"))
    stretch = c.withColumn("chosen", chosen).where("chosen IS NOT NULL")
    m = m.join(top_fraction_mean(stretch, "route_id", "chosen", 0.35, "top"), "route_id", "left")

    def stretched(share):
        return clamp01(F.col(share) * 0.62 + F.coalesce("top", F.lit(0.0)) * 0.38)

    shares = [F.col(k) for k in ("water_share", "open_share", "quiet_share", "curve_share")]
    variety = weighted_sum([(F.when(x >= 0.25, 1.0).otherwise(0.0), 0.25) for x in shares])
    s = F.col("strategy")
    fit = (F.when(s == "WATER_FOLLOWING", F.col("water_share")).when(s == "OPEN_SPACE_ESCAPE", stretched("open_share"))
           .when(s == "QUIET_LOW_PRESSURE", stretched("quiet_share")).when(s == "PHOTO_PEAKS", F.col("photo_peak"))
           .when(s == "CURVY_ELEVATION", stretched("curve_share"))
           .otherwise(clamp01(variety * 0.58 + F.col("photo_peak") * 0.22 + mean_of(*shares) * 0.20)))
    expected = F.when(s == "PHOTO_PEAKS", 0.68).when(s == "BALANCED_VARIETY", 0.38).otherwise(0.34)
    m = m.withColumn("strategy_fit", fit)
    return m.select("route_id", "water_share", "open_share", "quiet_share", "curve_share", "photo_peak", clamp01("strategy_fit").alias("strategy_fit_score"),
                    clamp01((expected - F.col("strategy_fit")) / expected).alias("strategy_mismatch_penalty"))


def closure_km(points: DataFrame, radius: float = KM) -> DataFrame:
    """Distance between the first and the last point of each route."""
    at = F.struct("lat", "lon")
    e = points.groupBy("route_id").agg(F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("z"), F.max("n_points").alias("n_points"))
    return e.select("route_id", "n_points", geo.haversine("a.lat", "a.lon", "z.lat", "z.lon", radius).alias("closure_km"),
                    F.col("a.lat").alias("start_lat"), F.col("a.lon").alias("start_lon"))


def route_shape(target, minutes, closure) -> Column:
    t = F.greatest(F.lit(1.0), target)
    fit = 1.0 - clamp01(F.abs(minutes - t) / t)
    return clamp01(fit * 0.45 + clamp01(minutes / t) * 0.25 + clamp01(1.0 - closure / 10.0) * 0.30)


def drive_quality(turn, urban, stress) -> Column:
    return clamp01(turn * 0.52 + (1.0 - urban) * 0.28 + (1.0 - stress) * 0.20)


def score_routes(points: DataFrame, trips: DataFrame, tiles: DataFrame, grid: HexGrid) -> DataFrame:
    """Final score and its parts per route; a route without corridor tiles falls back to its start area or its shape."""
    # Corridor and parts are cut from their plans: one plan of everything, with its updates while it runs, fills the driver.
    points = cut_lineage(points)
    corridor = cut_lineage(corridor_scores(points, trips, tiles, grid).drop("fits"))
    out = closure_km(points).join(trips, "route_id").join(mean_turn(points), "route_id").join(cut_lineage(craft_metrics(points, grid)), "route_id")
    for part in (corridor_means(corridor), scenic_moments(corridor), edge_penalty(corridor), strategy_metrics(corridor)):
        out = out.join(cut_lineage(part), "route_id", "left")
    out = cut_lineage(out)
    out = out.withColumns({"route_shape_score": route_shape(F.col("target_minutes"), F.col("minutes"), F.col("closure_km")),
                           "drive_quality_score": drive_quality(F.col("mean_turn"), F.col("urban_penalty"), F.col("road_stress_score"))})
    total = weighted_sum([("landscape_score", 0.38), ("vibe_fit_score", 0.24), ("drive_quality_score", 0.14), ("route_shape_score", 0.10),
                          ("scenic_moments_score", 0.14), ("urban_penalty", -0.10), ("start_end_penalty", -0.06), ("strategy_mismatch_penalty", -0.08),
                          ("backtracking_penalty", -0.08)])
    scored = out.where("corridor_tile_samples IS NOT NULL").withColumns({
        "final_score": F.when(F.col("n_points") < 2, 0.0).otherwise(clamp01(total)), "fallback": F.lit(False)})
    rest = fallback_score(out.where("corridor_tile_samples IS NULL"), tiles, grid)
    cols = ["route_id", "final_score", "fallback", "landscape_score", "vibe_fit_score", "drive_quality_score", "route_shape_score", "scenic_moments_score",
            "urban_penalty", "start_end_penalty", "strategy_fit_score", "strategy_mismatch_penalty", "backtracking_penalty"]
    return scored.select(*cols).unionByName(rest.select(*cols))


def fallback_score(routes: DataFrame, tiles: DataFrame, grid: HexGrid, ring: int = 6) -> DataFrame:
    """Score of routes without corridor tiles: mean tile score around the start, else a neutral value plus turn and closure."""
    weights = {k: F.col(f"w_{k}") for k in catalog.COMPONENTS}
    near = routes.select("route_id", *[f"w_{k}" for k in catalog.COMPONENTS], F.explode(cells.k_ring(grid.cell_of("start_lat", "start_lon"), F.lit(ring))).alias("cell"))
    area = near.join(tiles, "cell").groupBy("route_id").agg(clamp01(F.avg(scoring.score_tile(weights))).alias("area_score"))
    shape = clamp01(scoring.FALLBACK * 0.7 + F.col("mean_turn") * 0.2 + clamp01(1.0 - F.col("closure_km") / 15.0) * 0.1)
    df = routes.join(area, "route_id", "left").withColumn("density", F.coalesce("area_score", shape))
    final = clamp01(F.col("density") - F.col("backtracking_penalty") * 0.08)
    zero = F.lit(0.0)
    return df.withColumns({"final_score": final, "fallback": F.lit(True), "landscape_score": final, "vibe_fit_score": final, "drive_quality_score": F.col("mean_turn"),
                           "scenic_moments_score": final, "urban_penalty": zero, "start_end_penalty": zero, "strategy_fit_score": F.col("density"),
                           "strategy_mismatch_penalty": zero})
