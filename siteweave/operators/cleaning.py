"""Cleaning of node, regulation and supply-curve tables, and set operations on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions.text import letters_only, normalised, title
from siteweave.schema import require


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def unique_names(df: DataFrame, name: str, order: list[Column], tag: str | None = None) -> DataFrame:
    """Names with the tag behind; those that repeat get 0, 1, ... behind."""
    tagged = F.concat_ws(" ", F.col(name), F.lit(tag)) if tag else F.col(name)
    df = df.withColumn(name, tagged)
    rows = Window.partitionBy(name)
    number = F.row_number().over(rows.orderBy(*order)) - 1
    return df.withColumn("__n", F.count("*").over(rows)).withColumn("__i", number).withColumn(name, F.when(F.col("__n") > 1, F.concat_ws(" ", F.col(name), F.col("__i").cast("string"))).otherwise(F.col(name))).drop("__n", "__i")


def regulations(df: DataFrame, keep: tuple[str, ...] = ("geometry", "fips")) -> DataFrame:
    """Title-case columns but for ``keep``; rows without feature, type or value go; features and types are normalised."""
    named = df.toDF(*[c.upper() if c.lower() == "fips" else c if c.lower() in keep else title(c) for c in df.columns])
    require(named, ["Feature Type", "Value Type", "Value"])
    return named.dropna(subset=["Feature Type", "Value Type", "Value"]).withColumn("Feature Type", normalised(F.col("Feature Type"))).withColumn("Value Type", normalised(F.col("Value Type")))


def setback_value(kind: Column, value: Column, base: float | None = None, hub: float | None = None, rotor: float | None = None) -> Column:
    """A regulation in metres: metres as they are, multipliers of tip height, rotor diameter, hub height or the base distance; null for other kinds."""
    if (base is None) == (hub is None or rotor is None):
        raise ValueError("either a base distance, or hub height and rotor diameter")
    out = F.when(kind == "meters", value)
    if base is not None:
        return out.when(kind == "structure height multiplier", value * base)
    return out.when(kind.isin("max tip height multiplier", "structure height multiplier"), value * (hub + rotor / 2)).when(kind == "rotor diameter multiplier", value * rotor).when(kind == "hub height multiplier", value * hub)


def single_gid(df: DataFrame, gid: str) -> DataFrame:
    """A supply curve in which each point is its own resource: res_gids is [gid], gid_counts the sum of the counts."""
    return df.withColumn("res_gids", F.array(gid)).withColumn("gid_counts", F.array(F.aggregate("gid_counts", F.lit(0.0), lambda a, x: a + x)))


def flat_points(df: DataFrame) -> DataFrame:
    """(sc_gid, res_gid, count, share, capacity): a row for each resource of a point, its capacity by share of the counts."""
    whole = F.aggregate("gid_counts", F.lit(0.0), lambda a, x: a + x)
    rows = df.select("sc_gid", "capacity", whole.alias("__all"), F.inline(F.arrays_zip(F.col("res_gids").alias("res_gid"), F.col("gid_counts").alias("count"))))
    share = F.try_divide(F.col("count"), F.col("__all"))
    return rows.select("sc_gid", "res_gid", "count", share.alias("share"), (share * F.col("capacity")).alias("capacity"))


def with_region_names(df: DataFrame, states: DataFrame, state: str = "state") -> DataFrame:
    """Adds the super-region by the state's letters; states: (state, super_region)."""
    known = states.select(letters_only(F.col("state")).alias("__k"), "super_region").dropDuplicates(["__k"])
    return df.withColumn("__k", letters_only(F.col(state))).join(known, "__k", "left").drop("__k")


def with_extra(df: DataFrame, constants: dict[str, object] | None = None, table: DataFrame | None = None, on: str = "sc_point_gid") -> DataFrame:
    """Adds constant columns, or those of a table by an inner join."""
    for name, value in (constants or {}).items():
        df = df.withColumn(name, F.lit(value))
    return df.join(table, on) if table is not None else df


def reeds_columns(df: DataFrame, names: dict[str, str], defaults: tuple[str, ...], capacity: str = "capacity") -> DataFrame:
    """Points with capacity, under the names asked for; missing default columns are 1."""
    out = df.filter(F.col(capacity) > 0)
    out = out.withColumnsRenamed({a: b for a, b in names.items() if a in out.columns and b not in out.columns})
    return reduce(lambda d, c: d if c in d.columns else d.withColumn(c, F.lit(1)), defaults, out)


def members(df: DataFrame, others: DataFrame, on: str, present: bool = True) -> DataFrame:
    """The rows whose key is (or isn't) among the others."""
    return df.join(others.select(on).distinct(), on, "left_semi" if present else "left_anti")


def points_with_missing(points: DataFrame, missing: DataFrame) -> DataFrame:
    """sc_gid of the points that use any missing resource; points: (sc_gid, res_gids), missing: (res_gid)."""
    return points.select("sc_gid", F.explode("res_gids").alias("res_gid")).join(missing.select("res_gid").distinct(), "res_gid", "left_semi").select("sc_gid").distinct()


def disagreeing(a: DataFrame, b: DataFrame, on: str, columns: list[str], tolerance: float = 0.5) -> DataFrame:
    """The keys whose columns differ by more than the tolerance."""
    apart = reduce(lambda x, y: x | y, [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) > tolerance for c in columns])
    return a.alias("a").join(b.alias("b"), on).filter(apart).select(on)


def merge_extents(nodes: list[DataFrame], key: str = "node", sums: tuple[str, ...] = ("capacity",), lists: tuple[str, ...] = ("gids",)) -> DataFrame:
    """Nodes of several extents, those of one key merged: capacities added, lists chained in order."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), nodes)
    return every.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums], *[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in lists])


def added_lines(chosen: DataFrame, others: DataFrame, on: str) -> DataFrame:
    """The chosen rows and those of the others whose key isn't chosen."""
    return chosen.unionByName(members(others, chosen, on, present=False).select(*chosen.columns))


def prefixed_clusters(regions: dict[str, DataFrame], cluster: str = "cluster") -> DataFrame:
    """All regions' clusters, named region-cluster."""
    return reduce(DataFrame.unionByName, [df.withColumn(cluster, F.concat_ws("-", F.lit(name), F.col(cluster).cast("string"))) for name, df in regions.items()])
