"""Least-cost paths over cost rasters in windows around sources; ``relaxation`` has whole rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.operators.relaxation import STEPS, relaxed_costs


def clip_windows(sources: DataFrame, targets: DataFrame, buffer: float = 1.05) -> DataFrame:
    """(source, row, col, radius): how far, in cells, each source's targets reach, times the buffer. sources: (source, row, col); targets: (source, target, row, col)."""
    far = targets.select("source", F.col("row").alias("tr"), F.col("col").alias("tc")).join(sources, "source")
    reach = F.max(F.greatest(F.abs(F.col("tr") - F.col("row")), F.abs(F.col("tc") - F.col("col"))))
    return far.groupBy("source", "row", "col").agg(F.ceil(reach * buffer).cast("int").alias("radius"))


def clipped_cells(cells: DataFrame, windows: DataFrame, tile: int = 64) -> DataFrame:
    """Each window's cells, met through tiles: (source, cells' columns)."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("radius")) / tile), F.floor((F.col(c) + F.col("radius")) / tile)))
    w = windows.select(F.col("source"), F.col("row").alias("sr"), F.col("col").alias("sc"), "radius", span("row").alias("tr"), F.col("col"))
    w = w.withColumn("tc", span("col")).drop("col")
    placed = cells.withColumn("tr", F.floor(F.col("row") / tile)).withColumn("tc", F.floor(F.col("col") / tile))
    inside = (F.abs(F.col("row") - F.col("sr")) <= F.col("radius")) & (F.abs(F.col("col") - F.col("sc")) <= F.col("radius"))
    # Neither side is sent to all: windows explode, and a raster may look small.
    return w.join(placed.hint("merge"), ["tr", "tc"]).filter(inside).drop("tr", "tc", "sr", "sc", "radius")


def least_costs(cost: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """Least cumulative costs from the start; an edge costs the mean of its cells times its length, cells of cost 0 or less are closed.

    All cells that improved hand their costs on at once, those within a
    band above the cheapest of them first, so few cells are handed on twice.
    """
    height, width = cost.shape
    edge = np.full((height + 2, width + 2), -1.0)  # a closed margin
    edge[1:-1, 1:-1] = cost
    flat, best = edge.ravel(), np.full(edge.size, np.inf)
    at = (start[0] + 1) * (width + 2) + start[1] + 1
    if flat[at] > 0:
        best[at] = 0.0
        waiting = np.array([at])
        band = 2 * float(flat[flat > 0].mean())
        while len(waiting):
            now = best[waiting] <= best[waiting].min() + band
            active, later = waiting[now], [waiting[~now]]
            for r, c, length in STEPS:
                to = active + r * (width + 2) + c
                new = best[active] + (flat[active] + flat[to]) / 2 * length
                better = (flat[to] > 0) & (new < best[to])
                np.minimum.at(best, to[better], new[better])
                later.append(to[better])
            waiting = np.unique(np.concatenate(later))
    return best.reshape(edge.shape)[1:-1, 1:-1]


def traced(cost: np.ndarray, best: np.ndarray, end: tuple[int, int]) -> list[tuple[int, int]]:
    """The cells of a cheapest path from the start to the end."""
    path, (height, width) = [end], cost.shape
    while best[path[-1]] > 0:
        y, x = path[-1]
        around = [((y + r, x + c), length) for r, c, length in STEPS if 0 <= y + r < height and 0 <= x + c < width and cost[y + r, x + c] > 0]
        path.append(min(around, key=lambda n: best[n[0]] + (cost[n[0]] + cost[y, x]) / 2 * n[1])[0])
    return path[::-1]


def least_cost_paths(cells: DataFrame, sources: DataFrame, targets: DataFrame, buffer: float = 1.05, cost: str = "routing", windows: DataFrame | None = None) -> DataFrame:
    """(source, target, step, row, col, cumulative): the path to each target, from the source on; unreachable targets have one row without a step.

    A target of several cells, such as a line, is reached at the cheapest of
    them. A task holds one source's window, whose size follows the distance of
    its targets (or ``windows``: source, row, col, radius) and not the raster.
    """
    windows = clip_windows(sources, targets, buffer) if windows is None else windows
    held = clipped_cells(cells.select("row", "col", F.col(cost).cast("double").alias("cost")), windows)
    ends = targets.join(sources.select("source", F.col("row").alias("sr"), F.col("col").alias("sc")), "source")

    def solve(area: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(goals):
            r0, c0 = (int(area[c].min()) if len(area) else 0 for c in ("row", "col"))
            grid = np.full((int(area["row"].max()) - r0 + 1, int(area["col"].max()) - c0 + 1) if len(area) else (1, 1), -1.0)
            grid[area["row"] - r0, area["col"] - c0] = area["cost"].fillna(-1.0)
            sr, sc = int(goals["sr"].iloc[0]) - r0, int(goals["sc"].iloc[0]) - c0
            inside = lambda y, x: 0 <= y < grid.shape[0] and 0 <= x < grid.shape[1]
            best = least_costs(grid, (sr, sc)) if inside(sr, sc) else np.full(grid.shape, np.inf)
            for target, own in goals.groupby("target", sort=True):
                source = own["source"].iloc[0]
                places = sorted(zip(own["row"], own["col"]))
                reach = [(best[y - r0, x - c0] if inside(y - r0, x - c0) else np.inf, (y, x)) for y, x in places]
                least, (y, x) = min(reach)
                if not np.isfinite(least):
                    out.append((source, target, None, y, x, None))
                    continue
                for step, (i, j) in enumerate(traced(grid, best, (y - r0, x - c0))):
                    out.append((source, target, step, i + r0, j + c0, float(best[i, j])))
        return pd.DataFrame(out, columns=["source", "target", "step", "row", "col", "cumulative"]).astype({"step": "Int64", "row": "int64", "col": "int64"})

    ends = ends.select(*[F.col(c).alias(c) for c in ends.columns])  # columns of their own, as both sides stem from the sources
    kinds = {**dict(sources.dtypes), **dict(targets.dtypes)}
    schema = f"source {kinds['source']}, target {kinds['target']}, step long, row long, col long, cumulative double"
    return held.groupBy("source").cogroup(ends.groupBy("source")).applyInPandas(solve, schema)


def path_totals(paths: DataFrame, cells: DataFrame, layers: list[str], invariant: list[str] = (), cell_km: float = 0.09) -> DataFrame:
    """(source, target, dist_km, cost, and <layer>_cost and <layer>_km): a path's cells charged by the length it runs in each; invariant layers by cell. Barriers, which only steer, aren't charged."""
    order = Window.partitionBy("source", "target").orderBy("step")
    to = lambda f: F.sqrt(F.pow(F.col("row") - f("row").over(order), 2) + F.pow(F.col("col") - f("col").over(order), 2))
    length = (F.coalesce(to(F.lag), F.lit(0.0)) + F.coalesce(to(F.lead), F.lit(0.0))) / 2
    measured = paths.filter("step is not null").withColumn("len", length).join(cells, ["row", "col"])
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    sums = [F.sum(value(c) * F.col("len")).alias(f"{c}_cost") for c in layers] + [F.sum(value(c)).alias(f"{c}_cost") for c in invariant]
    lengths = [F.sum(F.when(value(c) > 0, F.col("len")).otherwise(0.0) * cell_km).alias(f"{c}_km") for c in [*layers, *invariant]]
    out = measured.groupBy("source", "target").agg((F.sum("len") * cell_km).alias("dist_km"), *sums, *lengths)
    total = F.lit(0.0)
    for c in [*layers, *invariant]:
        total = total + F.col(f"{c}_cost")
    return out.withColumn("cost", total)


def tree_sums(cost: np.ndarray, best: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
    """Of each reached cell, the sums of a value's mean along all steps of its cheapest path, times their lengths; paths as ``traced`` finds them, summed all at once by pointer jumping."""
    height, width = cost.shape
    at = np.flatnonzero(np.isfinite(best.ravel()))
    number = np.full(cost.size, -1)
    number[at] = np.arange(len(at))
    row, col = np.divmod(at, width)
    flat, least = cost.ravel(), best.ravel()
    nearest, jump, length = np.full(len(at), np.inf), np.arange(len(at)), np.zeros(len(at))
    for r, c, step in STEPS:
        inside = (row + r >= 0) & (row + r < height) & (col + c >= 0) & (col + c < width) & (least[at] > 0)
        to = np.where(inside, at + r * width + c, at)
        new = np.where(inside & (number[to] >= 0), least[to] + (flat[to] + flat[at]) / 2 * step, np.inf)
        better = new < nearest
        nearest[better], jump[better], length[better] = new[better], number[to[better]], step
    sums = [(v.ravel()[at] + v.ravel()[at[jump]]) / 2 * length for v in values]
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        sums, jump = [x + x[jump] for x in sums], further
    out = []
    for x in sums:
        whole = np.full(cost.size, np.nan)
        whole[at] = x
        out.append(whole.reshape(cost.shape))
    return out


def least_cost_totals(cells: DataFrame, sources: DataFrame, targets: DataFrame, layers: list[str], cell_km: float = 0.09, buffer: float = 1.05, cost: str = "routing", windows: DataFrame | None = None) -> DataFrame:
    """What ``path_totals`` says of ``least_cost_paths`` to targets of one cell each, without the paths: sums run along a window's tree of paths. Targets without a way have no row."""
    windows = clip_windows(sources, targets, buffer) if windows is None else windows
    held = clipped_cells(cells.select("row", "col", F.col(cost).cast("double").alias("cost"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{i}") for i, c in enumerate(layers)]), windows)
    ends = targets.join(sources.select("source", F.col("row").alias("sr"), F.col("col").alias("sc")), "source")
    names = ["dist_km", *[f"{c}_cost" for c in layers], *[f"{c}_km" for c in layers]]

    def solve(area: pd.DataFrame, goals: pd.DataFrame) -> pd.DataFrame:
        out = goals[["source", "target"]].iloc[:0].copy()
        if len(goals) and len(area):
            r0, c0 = int(area["row"].min()), int(area["col"].min())
            rows, cols = area["row"].to_numpy() - r0, area["col"].to_numpy() - c0

            def filled(name: str, empty: float) -> np.ndarray:
                grid = np.full((int(rows.max()) + 1, int(cols.max()) + 1), empty)
                grid[rows, cols] = area[name].fillna(empty)
                return grid

            grid, start = filled("cost", -1.0), (int(goals["sr"].iloc[0]) - r0, int(goals["sc"].iloc[0]) - c0)
            y, x = goals["row"].to_numpy() - r0, goals["col"].to_numpy() - c0
            inside = lambda y, x: (y >= 0) & (y < grid.shape[0]) & (x >= 0) & (x < grid.shape[1])
            if inside(*start):
                best = least_costs(grid, start)
                values = [filled(f"__{i}", 0.0) for i in range(len(layers))]
                sums = tree_sums(grid, best, [np.ones(grid.shape), *values, *[(v > 0).astype(float) for v in values]])
                reached = inside(y, x)
                reached[reached] = np.isfinite(best[y[reached], x[reached]])
                out, y, x = goals.loc[reached, ["source", "target"]].copy(), y[reached], x[reached]
                for name, v in zip(names, sums):
                    out[name] = v[y, x] * (cell_km if name.endswith("_km") else 1.0)
        return out.reindex(columns=["source", "target", *names]).astype({n: float for n in names})

    ends = ends.select(*[F.col(c).alias(c) for c in ends.columns])  # columns of their own, as both sides stem from the sources
    kinds = {**dict(sources.dtypes), **dict(targets.dtypes)}
    schema = f"source {kinds['source']}, target {kinds['target']}, " + ", ".join(f"`{n}` double" for n in names)
    out = held.groupBy("source").cogroup(ends.groupBy("source")).applyInPandas(solve, schema)
    total = F.lit(0.0)
    for c in layers:
        total = total + F.col(f"{c}_cost")
    return out.withColumn("cost", total)


def port_distances(ocean: DataFrame, ports: DataFrame, cell_cost: float = 90.0) -> DataFrame:
    """(row, col, km): distance by sea to the nearest port's cell; -1 on land and where no port leads to. ocean: (row, col, dist_to_coast > 0 at sea); ports: (row, col)."""
    costs = ocean.withColumn("routing", F.when(F.col("dist_to_coast") > 0, cell_cost).otherwise(-1.0))
    best = relaxed_costs(costs, ports)
    return ocean.select("row", "col").join(best, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("best") / 1000, F.lit(-1.0)).alias("km"))


def routed_targets(nodes: DataFrame, substations: DataFrame) -> DataFrame:
    """(source, target, row, col): each network node's targets are the substations of its region."""
    return nodes.select(F.col("gid").alias("source"), "region").join(substations.select(F.col("gid").alias("target"), "row", "col", "region"), "region").select("source", "target", "row", "col")


def in_raster(features: DataFrame, height: int, width: int, lines: bool = False) -> DataFrame:
    """The features inside the raster; transmission lines outside of it are moved to its edge if ``lines``. features: (row, col, category, ...)."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    if not lines:
        return features.filter(inside)
    cut = lambda c, n: F.greatest(F.lit(0), F.least(F.col(c), F.lit(n - 1)))
    line = F.col("category") == "TransLine"
    return features.filter(inside | line).withColumns({"row": cut("row", height), "col": cut("col", width)})


def all_pairs(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and targets of the paths from each feature to all others of its set; features: (set, gid, row, col), sets of bounded size. A path is as good as its reverse, so each pair is routed once."""
    sources = features.select(F.col("gid").alias("source"), "row", "col")
    to = features.select("set", F.col("gid").alias("target"), "row", "col")
    return sources, features.select("set", F.col("gid").alias("source")).join(to, "set").filter("source < target").drop("set")
