"""Request-level vibe logic: blends, weights and strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistagrid.functions import catalog, scoring
from vistagrid.functions.scalars import c
from vistagrid.functions.text import literal_map


def _per_vibe(values: dict[str, object]) -> Column:
    return literal_map(values.items())


def _strings(items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def known_vibes(vibes) -> Column:
    """Vibes with unknown names replaced by the default; an empty list becomes the default."""
    v = F.transform(c(vibes), lambda x: F.when(x.isin(catalog.VIBES), x).otherwise(catalog.DEFAULT_VIBE))
    return F.when(F.size(F.coalesce(v, F.array().cast("array<string>"))) > 0, F.array_distinct(v)).otherwise(
        _strings([catalog.DEFAULT_VIBE]))


def mean_over(vibes, values: dict[str, float]) -> Column:
    table = _per_vibe(values)
    return F.aggregate(c(vibes), F.lit(0.0), lambda acc, v: acc + table[v]) / F.size(c(vibes))


def lists_over(vibes, index: int) -> Column:
    table = F.create_map(*[x for k, p in catalog.VIBE_PROFILES.items() for x in (F.lit(k), _strings(p[index]))])
    return F.array_distinct(F.flatten(F.transform(c(vibes), lambda v: table[v])))


def blend_profiles(requests: DataFrame, vibes: str = "vibes") -> DataFrame:
    """Adds the blended profile of each request. The nine profiles are literals, so nothing is shuffled."""
    df = requests.withColumn("known", known_vibes(vibes))
    outward = [k for k, p in catalog.VIBE_PROFILES.items() if p[4]]
    return df.withColumns({
        "targets": lists_over("known", 2),
        "antis": lists_over("known", 3),
        "outward": F.arrays_overlap("known", _strings(outward)),
        "strict": F.size("known") > 0,
        "min_best": mean_over("known", {k: p[5] for k, p in catalog.VIBE_PROFILES.items()}),
        "min_mean": mean_over("known", {k: p[6] for k, p in catalog.VIBE_PROFILES.items()}),
        "strategy": scoring.resolve_strategy("known"),
    })


def default_weights(vibes) -> dict[str, Column]:
    return {k: mean_over(vibes, {v: p[1][i] for v, p in catalog.VIBE_PROFILES.items()})
            for i, k in enumerate(catalog.COMPONENTS)}


def normalized(weights: dict[str, Column]) -> dict[str, Column]:
    total = weights[catalog.COMPONENTS[0]]
    for k in catalog.COMPONENTS[1:]:
        total = total + weights[k]
    total = F.greatest(F.lit(0.0001), total)
    return {k: weights[k] / total for k in catalog.COMPONENTS}


def effective_weights(requests: DataFrame, calibrations: DataFrame | None, key: str = "request_id",
                      vibes: str = "vibes", preferences: str = "preferences", ratios: bool = True, newest: str | None = None) -> DataFrame:
    """w_<component> per request: vibe defaults, overrides, then mean learned multipliers of its vibes.

    `ratios` normalizes before and after calibration (the form stored with a request); without it the raw
    weights are multiplied (the form used while planning, which may be applied on top of the stored one).
    `calibrations` has rows (vibe, m_<component>); of several rows of a vibe the newest by `newest` counts, or without
    that column the one with the largest multipliers in component order.
    """
    base = {k: F.coalesce(F.col(preferences)[k], v) for k, v in default_weights("__known").items()}
    df = requests.withColumn("__known", known_vibes(vibes)).withColumns({f"w_{k}": v for k, v in base.items()}).drop("__known")
    cols = {k: F.col(f"w_{k}") for k in catalog.COMPONENTS}
    if ratios:
        df = df.withColumns({f"w_{k}": v for k, v in normalized(cols).items()})
    if calibrations is None:
        return df
    # The filter to known vibes bounds the broadcast side at nine rows.
    factors = F.struct(*[f"m_{k}" for k in catalog.COMPONENTS])
    order = F.struct(F.col(newest), factors) if newest else factors
    table = F.broadcast(calibrations.where(F.col("vibe").isin(catalog.VIBES)).groupBy("vibe").agg(F.max_by(factors, order).alias("m")).select("vibe", "m.*"))
    means = (df.select(key, F.explode(vibes).alias("vibe")).join(table, "vibe")
             .groupBy(key).agg(*[F.avg(f"m_{k}").alias(f"m_{k}") for k in catalog.COMPONENTS]))
    df = df.join(means, key, "left")
    df = df.withColumns({f"w_{k}": F.col(f"w_{k}") * F.coalesce(F.col(f"m_{k}"), F.lit(1.0)) for k in catalog.COMPONENTS})
    df = df.drop(*[f"m_{k}" for k in catalog.COMPONENTS])
    return df.withColumns({f"w_{k}": v for k, v in normalized(cols).items()}) if ratios else df


def weight_columns(prefix: str = "w_") -> dict[str, Column]:
    return {k: F.col(f"{prefix}{k}") for k in catalog.COMPONENTS}
