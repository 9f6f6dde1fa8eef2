"""Distances, grids and coordinates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Offsets of the eight neighbours, from north clockwise: (name, rows, columns).
DIRECTIONS = [("N", -1, 0), ("NE", -1, 1), ("E", 0, 1), ("SE", 1, 1), ("S", 1, 0), ("SW", 1, -1), ("W", 0, -1), ("NW", -1, -1)]


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of points in degrees."""
    a, b, c, d = (F.radians(x) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Unit-sphere coordinates; their straight distance orders points as the great circle does."""
    a, b = F.radians(lat), F.radians(lon)
    return [F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a)]


def distance(left: list[Column], right: list[Column]) -> Column:
    """Straight distance."""
    total = F.lit(0.0)
    for a, b in zip(left, right):
        total = total + (a - b) * (a - b)
    return F.sqrt(total)


def cell_centre(row: Column, col: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """(y, x) of a cell's centre under an affine transform without rotation."""
    return F.lit(y0) + (row + 0.5) * dy, F.lit(x0) + (col + 0.5) * dx


def cell_of(y: Column, x: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """(row, col) of the cell that holds a point."""
    return F.floor((y - y0) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Position between low and high; 1 where they are the same."""
    return F.when(high > low, (value - low) / (high - low)).otherwise(F.lit(1.0))


def project_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    """The point of a segment that is nearest to p."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, ((px - x1) * dx + (py - y1) * dy) / length).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return x1 + t * dx, y1 + t * dy
