"""Conic map projections on the ellipsoid as column expressions.

The inverse of both conics needs the latitude of a given area or shape, found
by a fixed number of steps that are folded over a short array: the expression
stays one of a few nodes, and all of it runs in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import atanh, cos, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and flattening of GRS 80 and WGS 84. Fixed values.
ELLIPSOIDS = {"GRS80": (6378137.0, 1 / 298.257222101), "WGS84": (6378137.0, 1 / 298.257223563)}
UNITS = {"m": 1.0, "km": 1000.0, "us-ft": 1200 / 3937, "ft": 0.3048}
#: Steps of the inverse; each squares the error or divides it by over a hundred.
STEPS = 8


def _fold(start: Column, step: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda phi, _: step(phi))


@dataclass(frozen=True)
class Conic:
    """Albers' equal-area (``aea``) or Lambert's conformal conic (``lcc``): standard parallels, origin and false origin in degrees and metres."""

    kind: str
    lat1: float
    lat2: float
    lat0: float
    lon0: float
    x0: float = 0.0
    y0: float = 0.0
    axis: float = ELLIPSOIDS["GRS80"][0]
    flattening: float = ELLIPSOIDS["GRS80"][1]
    unit: float = 1.0

    @classmethod
    def of(cls, proj4: str) -> Conic:
        """From a text such as "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=37.5 +lon_0=-96 +datum=NAD83 +units=m"; other projections are errors."""
        said = dict(x.partition("=")[::2] for x in proj4.replace("+", " ").split())
        if said.get("proj") not in ("aea", "lcc"):
            raise ValueError(f"no conic: {proj4}")
        axis, flattening = ELLIPSOIDS["WGS84" if "WGS84" in (said.get("datum"), said.get("ellps")) else "GRS80"]
        n = lambda name, default=0.0: float(said.get(name) or default)
        lat1 = n("lat_1")
        return cls(said["proj"], lat1, n("lat_2", lat1), n("lat_0"), n("lon_0"), n("x_0"), n("y_0"), axis, flattening, UNITS[said.get("units") or "m"])

    @property
    def e(self) -> float:
        return sqrt(self.flattening * (2 - self.flattening))

    def _m(self, phi: float) -> float:
        return cos(phi) / sqrt(1 - (self.e * sin(phi)) ** 2)

    def _q(self, phi: float) -> float:
        """The area below a latitude, for Albers."""
        s = sin(phi)
        return (1 - self.e**2) * (s / (1 - (self.e * s) ** 2) + atanh(self.e * s) / self.e)

    def _t(self, phi: float) -> float:
        """The conformal co-latitude's half tangent, for Lambert."""
        s = self.e * sin(phi)
        return tan(pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def constants(self) -> tuple[float, float, float]:
        """(cone, constant, radius of the origin)."""
        p1, p2, p0 = (radians(x) for x in (self.lat1, self.lat2, self.lat0))
        m1, m2 = self._m(p1), self._m(p2)
        if self.kind == "aea":
            cone = sin(p1) if abs(p1 - p2) < 1e-12 else (m1**2 - m2**2) / (self._q(p2) - self._q(p1))
            c = m1**2 + cone * self._q(p1)
            return cone, c, self.axis * sqrt(c - cone * self._q(p0)) / cone
        cone = sin(p1) if abs(p1 - p2) < 1e-12 else log(m1 / m2) / log(self._t(p1) / self._t(p2))
        c = m1 / (cone * self._t(p1) ** cone)
        return cone, c, self.axis * c * self._t(p0) ** cone

    def _log_ratio(self, phi: Column) -> Column:
        """ln((1 - e sin phi) / (1 + e sin phi))."""
        s = self.e * F.sin(phi)
        return F.log((1 - s) / (1 + s))

    def forward(self, lat: Column, lon: Column) -> tuple[Column, Column]:
        """(x, y) of places in degrees."""
        cone, c, origin = self.constants()
        phi, e = F.radians(lat), self.e
        if self.kind == "aea":
            s = F.sin(phi)
            q = (1 - e * e) * (s / (1 - e * e * s * s) - self._log_ratio(phi) / (2 * e))
            radius = self.axis * F.sqrt(c - cone * q) / cone
        else:
            t = F.tan(pi / 4 - phi / 2) * F.exp(-e / 2 * self._log_ratio(phi))
            radius = self.axis * c * F.pow(t, F.lit(cone))
        # Longitudes count the short way round.
        turn = cone * F.radians(F.pmod(lon - self.lon0 + 180, F.lit(360.0)) - 180)
        return (self.x0 + radius * F.sin(turn)) / self.unit, (self.y0 + origin - radius * F.cos(turn)) / self.unit

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(lat, lon) in degrees of places on the map; null where no latitude has such a place."""
        cone, c, origin = self.constants()
        sign, e = (1.0 if cone > 0 else -1.0), self.e
        dx, dy = (x * self.unit - self.x0) * sign, (origin - (y * self.unit - self.y0)) * sign
        radius = F.sqrt(dx * dx + dy * dy)
        if self.kind == "aea":
            q = (c - F.pow(radius * cone / self.axis, 2)) / cone
            pole = self._q(pi / 2)

            def step(phi: Column) -> Column:
                s = F.sin(phi)
                d = 1 - e * e * s * s
                more = d * d / (2 * F.cos(phi)) * (q / (1 - e * e) - s / d + self._log_ratio(phi) / (2 * e))
                return F.when(F.abs(q) < pole * (1 - 1e-12), phi + more).otherwise(phi)

            phi = F.when(F.abs(q) <= pole * (1 + 1e-9), _fold(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / pole))), step))
        else:
            t = F.pow(radius / (self.axis * c * sign), F.lit(1 / cone))
            phi = _fold(pi / 2 - 2 * F.atan(t), lambda p: pi / 2 - 2 * F.atan(t * F.exp(e / 2 * self._log_ratio(p))))
        return F.degrees(phi), F.pmod(F.lit(self.lon0) + F.degrees(F.atan2(dx, dy)) / cone + 180, F.lit(360.0)) - 180


def cell_places(cells: DataFrame, crs: Conic, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """Adds lat and lon of the cells' centres, by row and col of a raster that begins at (x0, y0) on the map."""
    lat, lon = crs.inverse(F.lit(x0) + (F.col("col") + 0.5) * dx, F.lit(y0) + (F.col("row") + 0.5) * dy)
    return cells.withColumns({"lat": lat, "lon": lon})


def corrected_points(points: DataFrame, crs: Conic, width: int, resolution: int, x0: float, dx: float, y0: float, dy: float, gid: str = "sc_point_gid", corners: bool = False) -> DataFrame:
    """Supply-curve points with lat and lon of the centre of their block of resolution x resolution cells, by their gid in rows of blocks; with ``corners`` also the block's corners as rings (ring, array of lat and lon).

    width: columns of the raster; the last block of a row may reach over its
    edge. Null gids give null places.
    """
    across = -(-width // resolution)
    row, col, wide, tall = F.expr(f"{gid} div {across}"), F.col(gid) % across, dx * resolution, dy * resolution
    at = lambda i, j: crs.inverse(F.lit(x0) + (col + i) * wide, F.lit(y0) + (row + j) * tall)
    lat, lon = at(0.5, 0.5)
    out = points.withColumns({"lat": lat, "lon": lon})
    if corners:
        out = out.withColumn("ring", F.array(*[F.struct(p.alias("lat"), q.alias("lon")) for p, q in (at(i, j) for i, j in ((0, 0), (0, 1), (1, 1), (1, 0)))]))
    return out
