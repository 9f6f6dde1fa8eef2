"""Table sources and sinks: files, databases, JSON list columns, raster stacks."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.functions.text import json_array
from siteweave.schema import require

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "csv": lambda s, p: s.read.csv(p, header=True, inferSchema=True),
    "json": lambda s, p: s.read.json(p, multiLine=True),
    "jsonl": lambda s, p: s.read.json(p),
    "parquet": lambda s, p: s.read.parquet(p),
    "orc": lambda s, p: s.read.orc(p),
}


def read_table(spark: SparkSession, source: str | DataFrame, required: Iterable[str] = ()) -> DataFrame:
    """A DataFrame as it is, a file by its ending, or a table of the catalog by its name."""
    if isinstance(source, DataFrame):
        return require(source, required)
    ending = source.rstrip("/").rsplit(".", 1)[-1].lower()
    return require(READERS[ending](spark, source) if ending in READERS else spark.table(source), required)


def read_database(spark: SparkSession, url: str, table: str, options: dict[str, str] | None = None, wait: float = 300, pause: float = 10) -> DataFrame:
    """A JDBC table; failed connections are tried again until ``wait`` seconds have passed."""
    began = time.monotonic()
    while True:
        try:
            return spark.read.jdbc(url, table, properties=options or {})
        except Exception:
            if time.monotonic() - began + pause > wait:
                raise
            time.sleep(pause)


def supply_curve(df: DataFrame, offshore: bool = False) -> DataFrame:
    """List columns decoded from JSON; offshore points only if asked for."""
    for name, kind in (("res_gids", "bigint"), ("gen_gids", "bigint"), ("gid_counts", "double")):
        if name in df.columns and dict(df.dtypes)[name] == "string":
            df = df.withColumn(name, json_array(F.col(name), kind))
    return df if offshore or "offshore" not in df.columns else df.filter("offshore = 0")


def generation_means(df: DataFrame) -> DataFrame:
    """(gen_gid, cf) from the first column there is of cf_mean-means, cf_mean and mean_cf."""
    found = [c for c in ("cf_mean-means", "cf_mean", "mean_cf") if c in df.columns]
    if not found:
        raise ValueError("no column of mean capacity factors")
    return df.select("gen_gid", F.col(f"`{found[0]}`").alias("cf"))


def first_gen_gid(df: DataFrame) -> DataFrame:
    """(res_gid, gen_gid), the first generation site of each resource."""
    return df.groupBy("res_gid").agg(F.min("gen_gid").alias("gen_gid"))


def one_year(df: DataFrame, year: int, time_column: str = "ts") -> DataFrame:
    """One year's rows, or its columns named <name>-<year> without the year."""
    if time_column in df.columns:
        df = df.filter((F.col(time_column) >= F.lit(f"{year}-01-01").cast("timestamp")) & (F.col(time_column) < F.lit(f"{year + 1}-01-01").cast("timestamp")))
    tail = f"-{year}"
    dated = [c for c in df.columns if len(c) > 5 and c[-5] == "-" and c[-4:].isdigit()]
    return df.select(*[F.col(f"`{c}`").alias(c.removesuffix(tail)) for c in df.columns if c not in dated or c.endswith(tail)])


def features_in(df: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Features whose box meets the one given, edges included; plain comparisons that reach the scan."""
    return df.filter((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))


def extent(df: DataFrame) -> DataFrame:
    """The box of all features and their number."""
    return df.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.countDistinct("id").alias("n"))


def dense_grid(spark: SparkSession, height: int, width: int) -> DataFrame:
    """(row, col, gid) of every cell."""
    return spark.range(height * width).select(F.expr(f"cast(id div {width} as int)").alias("row"), (F.col("id") % width).cast("int").alias("col"), F.col("id").alias("gid"))


def supply_points(spark: SparkSession, height: int, width: int, resolution: int) -> DataFrame:
    """(sc_point_gid, row, col): points of the coarse grid at their centre cell, clamped to the raster."""
    rows, cols = -(-height // resolution), -(-width // resolution)
    centre = lambda c, n: F.least(F.round(c * resolution + resolution / 2).cast("int"), F.lit(n - 1))
    grid = dense_grid(spark, rows, cols)
    return grid.select(F.col("gid").alias("sc_point_gid"), centre(F.col("row"), height).alias("row"), centre(F.col("col"), width).alias("col"))


def quantised(df: DataFrame, columns: dict[str, float], kind: str = "smallint") -> DataFrame:
    """Columns as whole numbers after scaling."""
    return df.withColumns({c: F.round(F.col(c) * scale).cast(kind) for c, scale in columns.items()})


def write_layer(cells: DataFrame, layer: str, path: str, replace: bool = True, tile: int = 256) -> None:
    """A layer of a raster stack, in folders of the stack by layer and rows of tiles."""
    rows = cells.select("row", "col", F.col(layer).alias("value"), F.expr(f"row div {tile}").alias("tile"))
    rows.repartition("tile").sortWithinPartitions("row", "col").write.mode("overwrite" if replace else "errorifexists").partitionBy("tile").parquet(f"{path}/layer={layer}")


def read_layers(spark: SparkSession, path: str, layers: list[str]) -> DataFrame:
    """Layers of a stack side by side: (row, col, layers)."""
    tables = [spark.read.parquet(f"{path}/layer={n}").select("row", "col", F.col("value").alias(n)) for n in layers]
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, ["row", "col"], "full")
    return out


def layers_of(spark: SparkSession, path: str) -> list[str]:
    """Names of a stack's layers, from its folders alone."""
    return sorted(r["layer"] for r in spark.read.parquet(path).select("layer").distinct().collect())


def files_of_year(spark: SparkSession, folder: str, year: int) -> DataFrame:
    """(path, modificationTime, length) of the files under a folder whose path holds the year; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.filter(F.col("path").contains(str(year))).select("path", "modificationTime", "length")


def same_profile(a: dict, b: dict, tolerance: float = 0.01, ignore: tuple[str, ...] = ("no_defs",)) -> list[str]:
    """What differs between two raster profiles: shape, coordinate system or transform."""
    said = [k for k in ("height", "width", "count") if a.get(k) != b.get(k)]
    crs = [{k: v for k, v in x.get("crs", {}).items() if k not in ignore} for x in (a, b)]
    if crs[0] != crs[1]:
        said.append("crs")
    if any(abs(x - y) > tolerance for x, y in zip(a.get("transform", []), b.get("transform", []))):
        said.append("transform")
    return said


def write_statistics(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Statistics as csv, json or parquet files."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"cannot write {kind}")
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if kind == "csv" else getattr(writer, kind)(path)


def write_profiles(profiles: DataFrame, path: str, by: list[str]) -> None:
    """Long profiles in folders by scenario, year, group or rank."""
    profiles.repartition(*by).sortWithinPartitions(*by, "ts").write.mode("overwrite").partitionBy(*by).parquet(path)


def update_columns(existing: DataFrame, new: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Existing rows with the new values where there are any."""
    fresh = new.select(on, *[F.col(c).alias(f"__{c}") for c in columns])
    out = existing.join(fresh, on, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])
