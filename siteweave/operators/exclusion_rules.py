"""Setback rules as data: feature masks, buffers by name, calculators made from specifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.text import normalised
from siteweave.operators import raster

#: Names of generic multipliers of wind turbines, and their values. Fixed values.
WIND_MULTIPLIERS = {"high": 3.0, "moderate": 1.1}


def feature_mask(kind: Column, subtype: Column, kinds: list[str], excluded: list[str] = ()) -> Column:
    """Rules of these feature types whose subtype isn't excluded; a null subtype is none of them."""
    own = normalised(kind).isin([k.lower() for k in kinds])
    return own & ~F.coalesce(normalised(subtype).isin([x.lower() for x in excluded]), F.lit(False)) if excluded else own


def flicker_mask(kind: Column) -> Column:
    return feature_mask(kind, F.lit(None).cast("string"), ["shadow flicker"])


def generic_multiplier(value: float | str | None) -> float | None:
    """A number as it is, or a name's value."""
    if isinstance(value, str):
        if value.lower() not in WIND_MULTIPLIERS:
            raise ValueError(f"unknown multiplier: {value}")
        return WIND_MULTIPLIERS[value.lower()]
    return value


def validated_multipliers(features: list[str], multipliers: dict[str, float] | float | None) -> dict[str, float | None]:
    """A multiplier for each feature type; names without a feature and features without a multiplier are errors."""
    if not isinstance(multipliers, dict):
        return {f: generic_multiplier(multipliers) for f in features}
    unknown, lacking = sorted(set(multipliers) - set(features)), sorted(set(features) - set(multipliers))
    if unknown or lacking:
        raise ValueError(f"multipliers without features: {unknown}; features without multipliers: {lacking}")
    return {f: generic_multiplier(m) for f, m in multipliers.items()}


def box_cells(boxes: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(row, col, keep) of every cell of each box (r1, c1, r2, c2), edges included; a box emits its own cells."""
    rows, cols = F.explode(F.sequence("r1", "r2")), F.explode(F.sequence("c1", "c2"))
    return boxes.filter("r1 <= r2 and c1 <= c2").withColumn("row", rows).withColumn("col", cols).select("row", "col", *keep)


def grown(boxes: DataFrame, distance: float, keep: list[str] = ()) -> DataFrame:
    """Distinct cells of the boxes and of a margin of ``distance`` cells around them."""
    d = int(distance)
    wider = boxes.select((F.col("r1") - d).alias("r1"), (F.col("c1") - d).alias("c1"), (F.col("r2") + d).alias("r2"), (F.col("c2") + d).alias("c2"), *keep)
    return box_cells(wider, keep).distinct()


def inner_ring(boxes: DataFrame, distance: float, keep: list[str] = ()) -> DataFrame:
    """Distinct cells of each box that lie within ``distance`` cells of its edge: the ring inside a parcel."""
    d = int(distance)
    edges = F.least(F.col("row") - F.col("r1"), F.col("r2") - F.col("row"), F.col("col") - F.col("c1"), F.col("c2") - F.col("col"))
    return box_cells(boxes, ["r1", "c1", "r2", "c2", *keep]).filter(edges < d).select("row", "col", *keep).distinct()


#: Cells near features, by the name of a buffer.
BUFFERS: dict[str, Callable[..., DataFrame]] = {"default": grown, "parcel": inner_ring}


@dataclass(frozen=True)
class Setback:
    """What makes a kind of setback: the feature types that rules speak of, subtypes that they don't, and the buffer of its features."""

    kinds: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    buffer: str = "default"

    def rules(self, regulations: DataFrame) -> DataFrame:
        """The regulations of this kind; columns Feature Type and Feature Subtype."""
        return regulations.filter(feature_mask(F.col("Feature Type"), F.col("Feature Subtype"), list(self.kinds), list(self.excluded)))

    def cells(self, boxes: DataFrame, distance: float, keep: list[str] = ()) -> DataFrame:
        return BUFFERS[self.buffer](boxes, distance, keep)


def calculator(setback: Setback) -> Callable[..., DataFrame]:
    """A function (cells, boxes, rules, generic) that adds excluded to the cells. In counties with a rule (fips, distance) its distance counts, for the features of that county; elsewhere the generic one, if any. Distances are whole cells."""

    def excluded(cells: DataFrame, boxes: DataFrame, rules: DataFrame | None = None, generic: float | None = None) -> DataFrame:
        flag = F.lit(False)
        if generic is not None:
            near = setback.cells(boxes, generic).withColumn("__g", F.lit(True))
            cells, flag = cells.join(near, raster.CELL, "left"), F.coalesce("__g", F.lit(False))
        if rules is not None:
            distances = [r["distance"] for r in rules.select("distance").distinct().orderBy("distance").limit(1001).collect()]
            if len(distances) > 1000:
                raise ValueError("more than 1000 different distances")
            for d in distances:
                name = f"__l{distances.index(d)}"
                ruled = rules.filter(F.col("distance") == d).select("fips").distinct().withColumn(f"{name}r", F.lit(True))
                own = setback.cells(boxes.join(ruled, "fips", "left_semi"), d, ["fips"]).withColumn(name, F.lit(True))
                cells = cells.join(ruled, "fips", "left").join(own, [*raster.CELL, "fips"], "left")
                flag = F.when(F.col(f"{name}r"), F.coalesce(name, F.lit(False))).otherwise(flag)
        return cells.withColumn("excluded", flag).drop(*[c for c in cells.columns if c.startswith("__")])

    return excluded


def window_of(miny: Column, minx: Column, maxy: Column, maxx: Column, x0: float, dx: float, y0: float, dy: float, height: int, width: int) -> list[Column]:
    """(row_start, row_stop, col_start, col_stop) of the cells that a box touches, clamped to the raster."""
    cut = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n))).cast("int")
    ys, xs = [(c - y0) / dy for c in (miny, maxy)], [(c - x0) / dx for c in (minx, maxx)]
    return [
        cut(F.floor(F.least(*ys)), height).alias("row_start"), cut(F.ceil(F.greatest(*ys)), height).alias("row_stop"),
        cut(F.floor(F.least(*xs)), width).alias("col_start"), cut(F.ceil(F.greatest(*xs)), width).alias("col_stop"),
    ]


def buffered_bounds(boxes: DataFrame, distance: float, cell: float) -> DataFrame:
    """Boxes grown on each side by twice the distance and a cell."""
    d = 2 * distance + cell
    return boxes.withColumns({"minx": F.col("minx") - d, "miny": F.col("miny") - d, "maxx": F.col("maxx") + d, "maxy": F.col("maxy") + d})


def county_in_window(cells: DataFrame, fips: int, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """(row, col, inside) of a window's cells: whether they lie in the county; rows and columns count from the window's corner."""
    held = cells.filter(F.col("row").between(rows[0], rows[1] - 1) & F.col("col").between(cols[0], cols[1] - 1))
    return held.select((F.col("row") - rows[0]).alias("row"), (F.col("col") - cols[0]).alias("col"), F.coalesce(F.col("fips") == fips, F.lit(False)).alias("inside"))


def extents(cells: DataFrame, land: Column) -> DataFrame:
    """Adds wet, wet_plus, dry, dry_plus and landfall: water and land, each without and with the land next to water."""
    out = raster.masks(cells, land)
    return out.withColumns({"wet": F.col("offshore"), "wet_plus": F.col("offshore") | F.col("landfall"), "dry": F.col("land"), "dry_plus": F.col("raw_land")}).drop("raw_land", "land", "offshore")


def checked_mask(cells: DataFrame, value: str) -> DataFrame:
    """The cells, if the mask holds 0 and 1 and nothing else."""
    ends = cells.agg(F.min(value), F.max(value), F.count_if(~F.col(value).isin(0, 1) | F.col(value).isNull())).first()
    if tuple(ends) != (0, 1, 0):
        raise ValueError(f"not a mask: from {ends[0]} to {ends[1]}, {ends[2]} other values")
    return cells


def gids_of_counties(cells: DataFrame, gid: str, county: str = "fips") -> DataFrame:
    """(county, gid): the supply-curve points that have cells in each county, many to many."""
    return cells.filter(F.col(gid).isNotNull() & F.col(county).isNotNull()).select(county, gid).distinct()


def aggregated_cell(row: Column, col: Column, resolution: int, width: int) -> Column:
    """The gid of the coarse cell that holds a fine one; width counts fine columns."""
    return (F.floor(row / resolution) * -(-width // resolution) + F.floor(col / resolution)).cast("long")


def reprojected(source: DataFrame, rows: DataFrame, source_affine: tuple[float, float, float, float], target_affine: tuple[float, float, float, float], fill: float = -1.0) -> DataFrame:
    """(row, col, value): for each cell of the target the value of the source cell that holds its centre, else ``fill``. Affines are (x0, dx, y0, dy) in one coordinate system."""
    x0, dx, y0, dy = target_affine
    sx, sdx, sy, sdy = source_affine
    y, x = F.lit(y0) + (F.col("row") + 0.5) * dy, F.lit(x0) + (F.col("col") + 0.5) * dx
    asked = rows.select("row", "col", F.floor((y - sy) / sdy).cast("int").alias("sr"), F.floor((x - sx) / sdx).cast("int").alias("sc"))
    known = source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col("value").alias("v"))
    return asked.join(known, ["sr", "sc"], "left").select("row", "col", F.coalesce("v", F.lit(fill)).alias("value"))
