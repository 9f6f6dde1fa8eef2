"""Ports, assembly areas and inputs of offshore sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.functions.spatial import haversine_km
from siteweave.operators.spatial_joins import nearest_by_degrees


def port_names(ports: DataFrame, parts: list[str], out: str = "name") -> DataFrame:
    """Adds a port's name from its parts; it is an error if two ports share one."""
    named = ports.withColumn(out, F.concat_ws("_", *[F.col(c).cast("string") for c in parts]))
    twice = named.groupBy(out).count().filter("count > 1").orderBy(out).limit(5).collect()
    if twice:
        raise ValueError(f"ports share a name: {', '.join(r[out] for r in twice)}")
    return named


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (miny, minx, maxy, maxx), edges included."""
    return lat.between(box[0], box[2]) & lon.between(box[1], box[3])


def clamped(df: DataFrame, depth: str | None = None, distances: tuple[str, ...] = (), downtime: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """Depths made positive, distances in km instead of metres, downtimes kept inside (0, 1) by the tolerance."""
    new = {c: F.col(c) / 1000 for c in distances}
    if depth:
        new[depth] = F.abs(depth)
    if downtime:
        new[downtime] = F.when(F.col(downtime) <= 0, tolerance).when(F.col(downtime) >= 1, 1 - tolerance).otherwise(F.col(downtime))
    return df.withColumns(new)


def sites_on_raster(sites: DataFrame, centres: DataFrame) -> DataFrame:
    """The sites with the (row, col) of their label's centre; sites whose label has no cell go. sites: (gid, ...); centres: (gid, row, col)."""
    return sites.join(centres, "gid")


def layer_values(sites: DataFrame, cells: DataFrame, layers: dict[str, str]) -> DataFrame:
    """Adds the layers' values, under the names given, at each site's cell; null outside of the raster."""
    return sites.join(cells.select("row", "col", *[F.col(c).alias(name) for name, c in layers.items()]), ["row", "col"], "left")


def assembly_table(areas: DataFrame, pixels: DataFrame) -> DataFrame:
    """(area, row, col, dist_p_to_a): the distance to ports at the valid pixel that is nearest to each area. areas: (area, lat, lon); pixels: (pixel, row, col, lat, lon, dist), invalid ones with a negative dist."""
    valid = pixels.filter("dist >= 0")
    near = nearest_by_degrees(areas, valid, "area", "pixel").select("area", "pixel")
    return near.join(valid.select("pixel", "row", "col", F.col("dist").alias("dist_p_to_a")), "pixel").drop("pixel")


def assembly_distances(sites: DataFrame, areas: DataFrame) -> DataFrame:
    """(gid, area, dist_p_to_a, dist_a_to_s): each site's nearest assembly area, by degrees, with its distance to ports and the site's great-circle distance to it."""
    near = nearest_by_degrees(sites.select("gid", "lat", "lon"), areas.select("area", "lat", "lon"), "gid", "area").select("gid", "area")
    both = near.join(sites.select("gid", F.col("lat").alias("slat"), F.col("lon").alias("slon")), "gid").join(areas, "area")
    return both.select("gid", "area", "dist_p_to_a", haversine_km(F.col("slat"), F.col("slon"), F.col("lat"), F.col("lon")).alias("dist_a_to_s"))


def array_efficiency(sites: DataFrame, points: DataFrame) -> DataFrame:
    """(gid, aeff) of the nearest point; points: (point, lat, lon, aeff)."""
    near = nearest_by_degrees(sites.select("gid", "lat", "lon"), points.select("point", "lat", "lon"), "gid", "point").select("gid", "point")
    return near.join(points.select("point", "aeff"), "point").select("gid", "aeff")


def offshore_inputs(sites: DataFrame, centres: DataFrame, cells: DataFrame, layers: dict[str, str], areas: DataFrame | None = None, points: DataFrame | None = None, depth: str | None = None, distances: tuple[str, ...] = (), downtime: str | None = None, tolerance: float = 0.01) -> DataFrame:
    """The inputs of each offshore site: layer values at its cell, clamped, and what its nearest assembly area and array-efficiency point give."""
    placed = sites_on_raster(sites, centres)
    out = clamped(layer_values(placed, cells, layers), depth, distances, downtime, tolerance)
    if areas is not None:
        out = out.join(assembly_distances(placed, areas), "gid", "left")
    return out if points is None else out.join(array_efficiency(placed, points), "gid", "left")
