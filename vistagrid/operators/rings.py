"""Waypoint rings that follow the geometry strategy of a request.

Every request is one row with its anchors, at most twelve, in an array; the shapes of its strategy are folds over that array,
so no anchor meets the anchors of another request and nothing is shuffled after the anchors are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog, geo, scoring
from vistagrid.functions.scalars import c, clamp01

# Fixed values of the ring rules.
ANCHORS, SPACING_KM, PAIRS = 12, 1.6, 18
SECTORS = 8
POINT = "struct<lat:double,lon:double>"


def _rule(index: int) -> Column:
    """Number of a strategy's row in STRATEGY_RULES."""
    table = F.create_map(*[x for k, v in catalog.STRATEGY_RULES.items() for x in (F.lit(k), F.lit(float(v[index])))])
    return table[F.col("strategy")]


def strategy_window() -> tuple[Column, Column]:
    """Nearest and farthest distance of an anchor in km, from the target radius, the budget and the strategy."""
    low = F.greatest(F.lit(2.0), F.col("radius_km") * _rule(0))
    by_time = F.greatest(_rule(2), F.col("budget") / _rule(3))
    return low, F.greatest(low + 1.0, F.least(by_time, F.col("radius_km") * _rule(1)))


def held(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row: Spark would copy the expression of a list to every place that reads it, inside
    a fold once for each step; it does not look through a generator."""
    out = df.withColumn("__held", F.explode(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
    return out.withColumns({k: F.col(f"__held.{k}") for k in columns}).drop("__held")


def greedy_spaced(spots: Column, n: int, km: float) -> Column:
    """Of an ordered array of spots those that are at least `km` from all taken before, up to n; one pass over the array."""
    none = F.filter(spots, lambda s: F.lit(False))

    def step(acc, s):
        far = ~F.exists(acc, lambda a: geo.haversine(a["lat"], a["lon"], s["lat"], s["lon"], geo.EARTH_KM) < km)
        return F.when((F.size(acc) < n) & far, F.concat(acc, F.array(s))).otherwise(acc)

    return F.aggregate(spots, none, step)


def base_columns() -> dict[str, Column]:
    """Per strategy, as b_<strategy>, the part of the anchor value that a tile has by itself."""
    return {f"b_{name}": base for name, (base, _, _) in scoring.strategy_bases().items()}


def strategy_anchors(lists: DataFrame) -> DataFrame:
    """Anchors per request in the order of their strategy score: request_id, strategy, slat, slon and the array `a` of
    (k, lat, lon, bearing, km, sector). `lists` as from `rank_tiles`, with `base_columns`."""
    low, high = strategy_window()
    out = lists.withColumns({"__lo": low, "__hi": high})

    def value(t):
        terms = {name: clamp01(t[f"b_{name}"] + t["fit"] * fit + t["scenic"] * scenic) for name, (_, fit, scenic) in scoring.strategy_bases().items()}
        found = terms.pop("BALANCED_VARIETY")
        for name, term in terms.items():
            found = F.when(F.col("strategy") == name, term).otherwise(found)
        return F.round(found, 9)

    inside = F.filter("tiles", lambda t: (t["distance_km"] >= F.col("__lo")) & (t["distance_km"] <= F.col("__hi")))
    spots = F.sort_array(F.transform(inside, lambda t: F.struct((-value(t)).alias("neg"), *[t[k].alias(k) for k in ("position", "lat", "lon")])))
    out = held(out.select("request_id", "strategy", F.col("lat").alias("slat"), F.col("lon").alias("slon"), spots.alias("__sorted")), spots=F.col("__sorted"))
    taken = held(out, taken=greedy_spaced(F.col("spots"), ANCHORS, SPACING_KM))

    def fact(s, k):
        bearing = geo.bearing("slat", "slon", s["lat"], s["lon"])
        return F.struct(k.alias("k"), s["lat"].alias("lat"), s["lon"].alias("lon"), bearing.alias("bearing"), geo.haversine("slat", "slon", s["lat"], s["lon"], geo.EARTH_KM).alias("km"), geo.sector(bearing, SECTORS).alias("sector"))

    return held(taken, a=F.transform("taken", fact)).select("request_id", "strategy", "slat", "slon", "a")


def _at(spots: Column, i: Column) -> Column:
    return F.element_at(spots, (i + 1).cast("int"))


def _ring(*points: Column) -> Column:
    return F.array(*[F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")) for p in points])


def _places(spots: Column) -> Column:
    return F.sequence(F.lit(0), F.size(spots) - 1)


def _off(bearing: Column, km: Column) -> Column:
    return geo.destination("slat", "slon", bearing, km, geo.EARTH_KM)


def _none() -> Column:
    return F.array().cast(f"array<array<{POINT}>>")


def water_rings(a: Column) -> Column:
    """Along the compass: each anchor alone, with the next, and with the next two."""
    by_bearing = F.array_sort(a, lambda x, y: F.when(x["bearing"] < y["bearing"], -1).when(x["bearing"] > y["bearing"], 1).otherwise(x["k"] - y["k"]))
    n = F.size(a)

    def from_here(i):
        one, two, three = (_at(by_bearing, (i + d) % n) for d in range(3))
        rings = F.array(_ring(one), F.when(n > 1, _ring(one, two)), F.when(n >= 3, _ring(one, two, three)))
        return F.filter(rings, lambda r: r.isNotNull())

    return F.flatten(F.transform(_places(a), from_here))


def directional_rings(a: Column, push: float, gap: int) -> Column:
    """Each anchor with a point pushed outwards to its right, then up to 18 pairs at least `gap` sectors apart."""
    single = F.transform(a, lambda p: _ring(p, _off(p["bearing"] + 36.0, F.greatest(F.lit(2.0), p["km"] * push))))

    def apart(p, s):
        d = F.abs(p["sector"] - s["sector"])
        return F.least(d, SECTORS - d) >= gap

    pairs = F.flatten(F.transform(a, lambda p: F.transform(F.filter(a, lambda s: (s["k"] > p["k"]) & apart(p, s)), lambda s: _ring(p, s))))
    return F.concat(single, F.slice(pairs, 1, PAIRS))


def quiet_rings(a: Column) -> Column:
    """Directional rings, then each anchor alone, with a point beyond it, and with a point before it."""
    def around(p):
        beyond = _off(p["bearing"] + 18.0, F.greatest(F.lit(3.0), p["km"] * 1.38))
        before = _off(p["bearing"] - 16.0, F.greatest(F.lit(3.0), p["km"] * 0.92))
        return F.array(_ring(p), _ring(p, beyond), _ring(before, p))

    return F.concat(directional_rings(a, 1.32, 0), F.flatten(F.transform(a, around)))


def peak_rings(a: Column) -> Column:
    """Best anchors alone and with the next best, and the three best."""
    n = F.size(a)
    each = F.transform(_places(a), lambda i: F.filter(F.array(_ring(_at(a, i)), F.when(i + 1 < n, _ring(_at(a, i), _at(a, F.least(i + 1, n - 1))))), lambda r: r.isNotNull()))
    top = F.when(n >= 3, F.array(_ring(*[F.get(a, F.lit(k)) for k in range(3)]))).otherwise(_none())
    return F.concat(F.flatten(each), top)


def balanced_rings(a: Column) -> Column:
    """Three, four and five anchors spread evenly over the sectors."""
    by_sector = F.array_sort(a, lambda x, y: F.when(x["sector"] != y["sector"], x["sector"] - y["sector"]).otherwise(x["k"] - y["k"]))
    n = F.size(a)

    def spread(count):
        ring = F.transform(F.sequence(F.lit(0), count - 1), lambda i: _at(by_sector, F.floor(i * n / count)))
        return F.transform(ring, lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))

    return F.transform(F.filter(F.array(*map(F.lit, (3, 4, 5))), lambda count: n >= count), spread)


def ring_signature(points="points") -> Column:
    return F.array_join(F.transform(c(points), lambda p: geo.coord_key(p["lat"], p["lon"], 5)), "|")


def first_of_each(rings: Column, names: Column) -> Column:
    """Of an array of rings the first of each name, in order."""
    return F.filter(rings, lambda r, i: F.array_position(names, F.get(names, i)) == i + 1)


def strategy_rings(lists: DataFrame) -> DataFrame:
    """Rings of each request by its `strategy` column: request_id, strategy, ring_no, signature, points (start left out)."""
    anchors = strategy_anchors(lists).where(F.size("a") > 0)
    a = F.col("a")
    shape = F.col("strategy")
    rings = (F.when(shape == "WATER_FOLLOWING", water_rings(a)).when(shape == "OPEN_SPACE_ESCAPE", directional_rings(a, 1.18, 2)).when(shape == "QUIET_LOW_PRESSURE", quiet_rings(a))
             .when(shape == "PHOTO_PEAKS", peak_rings(a)).when(shape == "CURVY_ELEVATION", directional_rings(a, 1.22, 2)).otherwise(balanced_rings(a)))
    signed = held(held(anchors, rings=rings), signed=F.transform("rings", lambda r: F.struct(ring_signature(r).alias("signature"), r.alias("points"))))
    unique = held(signed, names=F.transform("signed", lambda s: s["signature"])).select("request_id", "strategy", F.posexplode(first_of_each(F.col("signed"), F.col("names"))).alias("ring_no", "r"))
    return unique.select("request_id", "strategy", "ring_no", "r.signature", "r.points")
