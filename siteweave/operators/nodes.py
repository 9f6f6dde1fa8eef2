"""Aggregation of supply-curve points to grid nodes, plants and zones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions.text import class_of, zone_of
from siteweave.operators.allocation import merge_small
from siteweave.operators.quantiles import percentiles
from siteweave.operators.spatial_joins import nearest_by_degrees


def built_points(curve: DataFrame, build: DataFrame, year: int, on: str = "sc_gid") -> DataFrame:
    """The supply curve's points that are built in a year, with their built capacity. build: (on, year, built)."""
    total = build.filter(F.col("year") == year).groupBy(on).agg(F.sum("built").alias("built"))
    return curve.join(total, on)


def points_without_curve(curve: DataFrame, build: DataFrame, year: int, on: str = "sc_gid") -> DataFrame:
    """(on): what is built in a year and missing from the supply curve."""
    return build.filter(F.col("year") == year).select(on).distinct().join(curve, on, "left_anti")


def build_resources(build: DataFrame, curve: DataFrame, on: str = "sc_gid") -> DataFrame:
    """(res_gid): the distinct resources of all built points; curve: (on, res_gids)."""
    return build.select(on).distinct().join(curve.select(on, "res_gids"), on, "left").select(F.explode("res_gids").alias("res_gid")).distinct()


def reassigned_capacity(points: DataFrame, bad: DataFrame, on: str = "sc_gid", tolerance: float = 1e-3) -> DataFrame:
    """The good points with the capacity of bad ones added to the nearest good one. points: (on, lat, lon, capacity); bad: (on).

    It is an error if more than the tolerance of all capacity is lost, as
    when no good point is left.
    """
    good, moved = points.join(bad.select(on).distinct(), on, "left_anti"), points.join(bad.select(on).distinct(), on, "left_semi")
    near = nearest_by_degrees(moved.select(F.col(on).alias("bad"), "lat", "lon"), good.select(on, "lat", "lon"), "bad", on)
    added = near.join(moved.select(F.col(on).alias("bad"), F.col("capacity").alias("added")), "bad").groupBy(on).agg(F.sum("added").alias("added"))
    out = good.join(added, on, "left").withColumn("capacity", F.col("capacity") + F.coalesce("added", F.lit(0.0))).drop("added")
    before, after = (df.agg(F.sum("capacity")).first()[0] or 0.0 for df in (points, out))
    if abs(before - after) > tolerance * abs(before):
        raise ValueError(f"capacity of {before - after} lost on missing resources")
    return out


def bus_table(df: DataFrame) -> DataFrame:
    """Buses with coordinates and capacity, columns in lower case, with their plant: all buses of one place make one, named by its smallest bus. Adds plant, plant_capacity and share."""
    low = df.toDF(*[c.lower() for c in df.columns])
    good = low.filter(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & (F.col("capacity") > 0))
    plants = good.groupBy("lat", "lon").agg(F.min("bus").alias("plant"), F.sum("capacity").alias("plant_capacity"))
    return good.join(plants, ["lat", "lon"]).withColumn("share", F.col("capacity") / F.col("plant_capacity"))


def bus_builds(buses: DataFrame, builds: DataFrame, curve: DataFrame) -> DataFrame:
    """(bus, gid, capacity and the curve's columns): each plant's build shared out to its buses. builds: (plant, gid, built); curve: (gid, ...)."""
    whole = builds.join(curve, "gid", "left")
    return buses.select("bus", "plant", "share").join(whole, "plant").withColumn("capacity", F.col("built") * F.col("share")).drop("plant", "share", "built")


def percentile_distance(df: DataFrame, distance: str, share: float = 0.9, keys: tuple[str, ...] = (), miles: bool = False) -> DataFrame:
    """(keys, distance): the exact percentile of distances, in km, however many of them a group has."""
    value = F.col(distance) * 1.6 if miles else F.col(distance)
    return percentiles(df, value, [share], keys).withColumnRenamed("p0", distance)


def node_map(points: DataFrame, nodes: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(gid, node): as a table (gid, node) says, its keys compared as text, else the nearest node. points: (gid, lat, lon); nodes: (node, lat, lon)."""
    if table is None:
        return nearest_by_degrees(points, nodes, "gid", "node").select("gid", "node")
    known = table.select(F.col("gid").cast("string").alias("key"), F.col("node"))
    return points.select("gid", F.col("gid").cast("string").alias("key")).join(known, "key", "left").select("gid", "node")


def aggregated(points: DataFrame, nodes: DataFrame, least: float = 0.0, table: DataFrame | None = None) -> DataFrame:
    """(node, capacity, members): capacity of the points of each node, nodes under ``least`` merged into the nearest larger one."""
    of = points.select("gid", "capacity").join(node_map(points, nodes, table), "gid").groupBy("node").agg(F.sum("capacity").alias("capacity"))
    return merge_small(of.join(nodes.select("node", "lat", "lon"), "node"), least)


def node_profiles(points: DataFrame, profiles: DataFrame, nodes: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(node, ts, value): capacity times capacity factor of all points of a node; profiles: (gid, ts, value)."""
    shares = points.select("gid", "capacity").join(node_map(points, nodes, table), "gid")
    return profiles.join(shares, "gid").groupBy("node", "ts").agg(F.sum(F.col("value") * F.col("capacity")).alias("value"))


def zone_capacity(builds: dict[str, DataFrame], classes: list[int] | None = None) -> DataFrame:
    """(tech, zone, class, capacity, n) of several technologies; builds by technology: (region, category, capacity). Class and zone come from the names; without ``classes`` all that occur count."""
    parts = [df.select(F.lit(tech).alias("tech"), zone_of(F.col("region")).alias("zone"), class_of(F.col("category")).alias("class"), "capacity") for tech, df in builds.items()]
    every = reduce(DataFrame.unionByName, parts).filter("class is not null")
    every = every.filter(F.col("class").isin(classes)) if classes is not None else every
    return every.groupBy("tech", "zone", "class").agg(F.sum("capacity").alias("capacity"), F.count("*").alias("n"))


def quality(old: DataFrame, new: DataFrame, key: str = "gid") -> DataFrame:
    """(key, old_mean, old_max, new_mean, new_max): profiles before and after a change; (key, value) each."""
    of = lambda df, name: df.groupBy(key).agg(F.avg("value").alias(f"{name}_mean"), F.max("value").alias(f"{name}_max"))
    return of(old, "old").join(of(new, "new"), key, "full")


def one_to_one(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A left join; it is an error if a key repeats on either side."""
    for name, df in (("left", left), ("right", right)):
        if not df.groupBy(on).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            raise ValueError(f"{on} repeats on the {name} side")
    return left.join(right, on, "left")


def shares_of_plant(df: DataFrame, plant: str, capacity: str) -> DataFrame:
    """Adds share, the row's part of its plant's capacity."""
    return df.withColumn("share", F.try_divide(F.col(capacity), F.sum(capacity).over(Window.partitionBy(plant))))
