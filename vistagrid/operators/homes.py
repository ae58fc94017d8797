"""Joins within homes: square blocks of a plane in which one side lives and to which the other side is copied.

Each row of the living side is in one home, a row of the other side in all homes its span touches, and a function over Arrow
tables gets both sides of a home. No pair ever leaves its task. A home with many rows on its crowded side is dealt in parts,
as many as its rows ask for; the table of homes is bounded by the plane.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HOME = ["__hu", "__hv"]


def _block(value: Column, size: float) -> Column:
    return F.floor(value / size)


def meet(living: DataFrame, at: tuple[Column, Column], other: DataFrame, span: tuple[Column, Column, Column, Column], size: float, part: int,
         run: Callable[[pa.Table, pa.Table], pa.Table], schema: StructType, crowded: str = "living") -> DataFrame:
    """Rows of `run(living, other)` of every home. `at` places the living rows; `span` is (low, high, low, high) of the places the
    other rows can matter to. Rows without a place are left out. `crowded` names the side that is dealt in parts of about `part` rows."""
    tasks = int(living.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = living.withColumns({h: _block(v, size) for h, v in zip(HOME, at)}).where("__hu IS NOT NULL AND __hv IS NOT NULL")
    wide = other.withColumns({f"{h}{e}": _block(span[2 * i + j], size) for i, h in enumerate(HOME) for j, e in enumerate("ab")})
    for h in HOME:
        wide = wide.withColumn(h, F.explode(F.when(F.col(f"{h}a") <= F.col(f"{h}b"), F.sequence(f"{h}a", f"{h}b")))).drop(f"{h}a", f"{h}b")
    counted = own if crowded == "living" else wide
    parts = counted.groupBy(*HOME).agg(F.ceil(F.count("*") / part).cast("int").alias("__parts"))
    if crowded != "living":
        parts = own.select(*HOME).distinct().join(parts, HOME, "left").select(*HOME, F.coalesce("__parts", F.lit(1)).alias("__parts"))
    hashed = F.pmod(F.xxhash64(*(living if crowded == "living" else other).columns[:1]), F.col("__parts")).cast("int")
    copied = F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))
    sides = [df.join(F.broadcast(parts), HOME).withColumn("__part", hashed if side == crowded else copied).drop("__parts").repartition(tasks, *HOME, "__part").groupBy(*HOME, "__part")
             for side, df in (("living", own), ("other", wide))]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def arrow_type(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    """Numbers of a column, NaN for nulls."""
    return table[name].to_numpy()


def ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges that begin at `first` and are `n` long, and the range of each."""
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - np.repeat(np.cumsum(n) - n - first, n), owner


def first_of_each(owner: np.ndarray, limit: int) -> np.ndarray:
    """Places of the first `limit` entries of each owner; `owner` is in order."""
    if not len(owner):
        return np.empty(0, dtype=np.int64)
    start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    place = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)]))
    return np.flatnonzero(place < limit)


def haversine(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray, radius: float) -> np.ndarray:
    half_lat, half_lon = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * half_lon * half_lon
    return np.arctan2(np.sqrt(a), np.sqrt(1 - a)) * (2 * radius)


def bearing(lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Initial bearing in degrees, [0, 360)."""
    p1, p2, dl = np.radians(lat1), np.radians(lat2), np.radians(lon2 - lon1)
    x = np.cos(p1) * np.sin(p2) - np.sin(p1) * np.cos(p2) * np.cos(dl)
    return (np.degrees(np.arctan2(np.sin(dl) * np.cos(p2), x)) + 360.0) % 360.0
