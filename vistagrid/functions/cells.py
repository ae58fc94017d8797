"""Hexagonal cell index as pure Column arithmetic.

A cell id is the opaque string ``q:r:res`` of an axial hexagon lattice on an equirectangular plane. Each coarser
resolution is the index-7 sublattice of the finer one (basis (2,1), (-1,3) in axial steps), so every cell has
exactly seven children, parents and children are exact inverses, and a k-ring holds 1 + 3k(k+1) cells.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistagrid.functions.scalars import c

DEFAULT_RESOLUTION = 7
CRAFT_RESOLUTION = 8
REGION_RESOLUTION = 5
ROOT3 = math.sqrt(3.0)
# Angle between the lattices of two neighbouring resolutions.
TWIST = math.atan2(ROOT3 / 2, 2.5)


def make_cell(q, r, res) -> Column:
    return F.concat(c(q).cast("string"), F.lit(":"), c(r).cast("string"), F.lit(":"), c(res).cast("string"))


def cell_q(cell) -> Column:
    return F.split_part(c(cell), F.lit(":"), F.lit(1)).cast("bigint")


def cell_r(cell) -> Column:
    return F.split_part(c(cell), F.lit(":"), F.lit(2)).cast("bigint")


def cell_resolution(cell) -> Column:
    return F.split_part(c(cell), F.lit(":"), F.lit(3)).cast("int")


def cell_valid(cell) -> Column:
    return F.coalesce(c(cell).rlike(r"^-?[0-9]{1,9}:-?[0-9]{1,9}:([0-9]|1[0-5])$"), F.lit(False))


def cube_round(q, r) -> tuple[Column, Column]:
    """Nearest lattice point of fractional axial coordinates."""
    qf, rf = c(q), c(r)
    sf = -qf - rf
    q0, r0, s0 = F.floor(qf + 0.5), F.floor(rf + 0.5), F.floor(sf + 0.5)
    dq, dr, ds = F.abs(q0 - qf), F.abs(r0 - rf), F.abs(s0 - sf)
    q1 = F.when((dq > dr) & (dq > ds), -r0 - s0).otherwise(q0)
    r1 = F.when(~((dq > dr) & (dq > ds)) & (dr > ds), -q0 - s0).otherwise(r0)
    return q1.cast("bigint"), r1.cast("bigint")


@dataclass(frozen=True)
class HexGrid:
    """Grid parameters: anchor point, edge of a resolution-7 cell in degrees of longitude, latitude stretch."""

    lon0: float = 0.0
    lat0: float = 0.0
    edge7: float = 0.0179
    aspect: float = math.sqrt(2.0)

    def edge(self, res: int) -> float:
        return self.edge7 * 7.0 ** ((7 - res) / 2.0)

    def _turn(self, res: int) -> tuple[float, float]:
        a = TWIST * (7 - res)
        return math.cos(a), math.sin(a)

    def axial(self, lat, lon, res: int) -> tuple[Column, Column]:
        cos_a, sin_a = self._turn(res)
        e = self.edge(res)
        x, y = c(lon) - self.lon0, (c(lat) - self.lat0) * self.aspect
        u, v = (x * cos_a + y * sin_a) / e, (y * cos_a - x * sin_a) / e
        r = v / 1.5
        return cube_round(u / ROOT3 - r / 2.0, r)

    def cell_of(self, lat, lon, res: int = DEFAULT_RESOLUTION) -> Column:
        q, r = self.axial(lat, lon, res)
        return make_cell(q, r, F.lit(res))

    def placed(self, df, lat: str, lon: str, name: str, res: int = DEFAULT_RESOLUTION):
        """Adds the cell of a point as join key `name`: the empty string, which no cell has, where a coordinate is null.

        Named steps, and a key that is never null, keep generated code small: for a key that may be null, Spark would copy
        the whole arithmetic into a filter, whose code then grows beyond what Java compiles.
        """
        cos_a, sin_a = self._turn(res)
        e = self.edge(res)
        x, y = c(lon) - self.lon0, (c(lat) - self.lat0) * self.aspect
        out = df.withColumns({"__u": (x * cos_a + y * sin_a) / e, "__v": (y * cos_a - x * sin_a) / e / 1.5})
        out = out.withColumn("__u", F.col("__u") / ROOT3 - F.col("__v") / 2.0)
        q, r = cube_round("__u", "__v")
        return out.withColumn(name, F.coalesce(make_cell(q, r, F.lit(res)), F.lit(""))).drop("__u", "__v")

    def center_axial(self, q, r, res: int) -> Column:
        cos_a, sin_a = self._turn(res)
        e = self.edge(res)
        u, v = (c(q) + c(r) / 2.0) * (ROOT3 * e), c(r) * (1.5 * e)
        x, y = u * cos_a - v * sin_a, u * sin_a + v * cos_a
        return F.struct((y / self.aspect + self.lat0).alias("lat"), (x + self.lon0).alias("lon"))

    def cell_center(self, cell, res: int = DEFAULT_RESOLUTION) -> Column:
        """struct(lat, lon) of the centre; cells of another resolution give null."""
        return F.when(cell_resolution(cell) == res, self.center_axial(cell_q(cell), cell_r(cell), res))

    def boundary(self, q, r, res: int = DEFAULT_RESOLUTION) -> Column:
        """Closed ring of the six corners."""
        return self.boundary_around(self.center_axial(q, r, res), res)

    def boundary_around(self, center, res: int = DEFAULT_RESOLUTION) -> Column:
        """Closed ring of the six corners around a centre struct."""
        e, a, mid = self.edge(res), TWIST * (7 - res), c(center)
        corners = []
        for i in (0, 1, 2, 3, 4, 5, 0):
            t = math.pi / 6 + i * math.pi / 3 + a
            corners.append(F.struct((mid["lon"] + e * math.cos(t)).alias("lon"),
                                    (mid["lat"] + e * math.sin(t) / self.aspect).alias("lat")))
        return F.array(*corners)

    def ring_for_metres(self, metres: float, lat, res: int = DEFAULT_RESOLUTION) -> Column:
        """Ring size that is certain to reach `metres` from any point of the cell, at the latitude of the row."""
        stretch = F.greatest(F.lit(self.aspect), 1.0 / F.cos(F.radians(F.abs(c(lat)))))
        return F.greatest(F.lit(1), F.ceil((stretch * (metres / 111000.0 / self.edge(res)) + 0.5) / 1.5).cast("int"))

    def resolution_for(self, metres: float, finest: int = 12) -> int:
        """Finest resolution whose one-cell ring reaches `metres` at mid latitudes."""
        res = 0
        while res < finest and metres / 111000.0 * self.aspect / self.edge(res + 1) <= 1.0:
            res += 1
        return res

    def cover(self, df, envelope, margin_m: float = 0.0, name: str = "cell"):
        """One row per resolution-7 cell that may touch an envelope struct widened by a margin; never too few.

        Rows and columns of the lattice are exploded one after the other, so a continent-sized polygon never
        builds one huge array; it becomes many rows that later steps spread over the cluster.
        """
        e, env = self.edge(7), c(envelope)
        dlat = margin_m / 111000.0
        widest = F.least(F.lit(89.0), F.greatest(F.abs(env["min_lat"]), F.abs(env["max_lat"])) + dlat)
        dy, dx = dlat * self.aspect + e, F.lit(dlat) / F.cos(F.radians(widest)) + e
        y_lo, y_hi = ((env[k] - self.lat0) * self.aspect for k in ("min_lat", "max_lat"))
        x_lo, x_hi = (env[k] - self.lon0 for k in ("min_lon", "max_lon"))
        rows = F.sequence(F.ceil((y_lo - dy) / (1.5 * e)), F.floor((y_hi + dy) / (1.5 * e)))
        out = df.withColumns({"__lo": x_lo - dx, "__hi": x_hi + dx}).withColumn("__r", F.explode(rows))
        first = F.ceil(F.col("__lo") / (ROOT3 * e) - F.col("__r") / 2.0)
        last = F.floor(F.col("__hi") / (ROOT3 * e) - F.col("__r") / 2.0)
        out = out.withColumn("__q", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
        return out.withColumn(name, F.coalesce(make_cell("__q", "__r", F.lit(7)), F.lit(""))).drop("__lo", "__hi", "__r", "__q")


def k_ring_axial(k) -> Column:
    """array<struct<dq, dr>> of the disk of radius k around the origin."""
    span = F.sequence(-c(k), c(k))
    return F.flatten(F.transform(span, lambda dq: F.transform(
        F.sequence(F.greatest(-c(k), -dq - c(k)), F.least(c(k), -dq + c(k))),
        lambda dr: F.struct(dq.alias("dq"), dr.alias("dr")))))


def k_ring(cell, k) -> Column:
    """array<string> of the cells within k steps; explode it for an equi-join."""
    q, r, res = cell_q(cell), cell_r(cell), cell_resolution(cell)
    return F.transform(k_ring_axial(k), lambda d: make_cell(q + d["dq"], r + d["dr"], res))


def ring_distance(a, b) -> Column:
    dq, dr = cell_q(a) - cell_q(b), cell_r(a) - cell_r(b)
    return F.greatest(F.abs(dq), F.abs(dr), F.abs(dq + dr))


def parent_axial(q, r) -> tuple[Column, Column]:
    """Lattice coordinates one resolution coarser. Chain it through named columns, not nested: it repeats its input."""
    return cube_round((c(q) * 3 + c(r)) / 7.0, (c(r) * 2 - c(q)) / 7.0)


def cell_parent(cell) -> Column:
    """Cell one resolution coarser."""
    q, r = cell_q(cell), cell_r(cell)
    pq, pr = parent_axial(q, r)
    return make_cell(pq, pr, cell_resolution(cell) - 1)


def cell_children(cell) -> Column:
    """The seven cells one resolution finer."""
    q, r, res = cell_q(cell), cell_r(cell), cell_resolution(cell) + 1
    return F.transform(k_ring_axial(F.lit(1)), lambda d: make_cell(q * 2 - r + d["dq"], r * 3 + q + d["dr"], res))
