"""Least-cost paths over whole rasters: costs relaxed tile by tile, and all paths traced back at once.

The raster is square tiles. A tile is relaxed inside by one task; then only the
borders of tiles that improved travel, and only tiles that they improve are
written again: the newest of a tile's rows counts. When nothing improves, every
cell knows the step to the cell that it was reached from, and paths walk back
inside a tile in one task and hop to the next tile in the next round, all paths
together. Rounds are cut by reliable checkpoints, so any tile can be anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions.spatial import DIRECTIONS
from siteweave.session import checkpointed

STEPS = [(r, c, sqrt(r * r + c * c)) for _, r, c in DIRECTIONS]
#: Codes of cells that no step leads on from: sources, and cells that none reaches.
SOURCE, LOST = 8, 9
TILE = 128
#: Rows of tiles' keys (8 bytes each) that may be broadcast, and changes of tiles that are kept apart before they are put together.
KEYS, CHANGES = 1_000_000, 8
TILE_KEYS = ("ty", "tx")


def relaxed_tile(costs: np.ndarray, best: np.ndarray, waiting: np.ndarray) -> np.ndarray:
    """Hands the values of the waiting cells on until no cell improves; an edge costs the mean of its cells times its length, cells of cost 0 or less are closed."""
    flat, values, width = costs.ravel(), best.ravel(), costs.shape[1]
    while len(waiting):
        later = []
        for r, c, length in STEPS:
            to = waiting + r * width + c
            ok = (to >= 0) & (to < len(flat)) & (np.abs(to % width - waiting % width) <= 1)
            i, j = waiting[ok], to[ok]
            new = values[i] + (flat[i] + flat[j]) / 2 * length
            better = (flat[i] > 0) & (flat[j] > 0) & (new < values[j] - 1e-12)
            np.minimum.at(values, j[better], new[better])
            later.append(j[better])
        waiting = np.unique(np.concatenate(later))
    return values.reshape(costs.shape)


def _squares(batch: pa.RecordBatch, tile: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for ty, tx, costs, best in zip(*[batch.column(n).to_pylist() for n in ("ty", "tx", "costs", "best")]):
        yield ty, tx, *(np.frombuffer(v).reshape(tile, tile) for v in (costs, best))


def border_rows(tiles: DataFrame, tile: int) -> DataFrame:
    """(ty, tx, r, k, costs, best): each tile's edge rows, columns and corners for the tile that they lie next to, on its side (r, k)."""
    cut = {-1: slice(0, 1), 0: slice(None), 1: slice(-1, None)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (*[pa.int32()] * 4, pa.binary(), pa.binary())
        for batch in batches:
            out = [(ty + r, tx + k, -r, -k, c[cut[r], cut[k]].tobytes(), b[cut[r], cut[k]].tobytes()) for ty, tx, c, b in _squares(batch, tile) for r, k, _ in STEPS]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=["ty", "tx", "r", "k", "costs", "best"])

    return tiles.select("ty", "tx", "costs", "best").mapInArrow(run, "ty int, tx int, r int, k int, costs binary, best binary")


def _framed(own: pa.Table, given: pa.Table, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """A tile's costs and values with a margin of one cell, filled from its neighbours' borders."""
    costs, best = np.full((tile + 2, tile + 2), -1.0), np.full((tile + 2, tile + 2), np.inf)
    costs[1:-1, 1:-1], best[1:-1, 1:-1] = (np.frombuffer(own[n][0].as_py()).reshape(tile, tile) for n in ("costs", "best"))
    side = {-1: slice(0, 1), 0: slice(1, -1), 1: slice(-1, None)}
    for r, k, c, b in zip(*[given[n].to_pylist() for n in ("r", "k", "costs", "best")]):
        shape = best[side[r], side[k]].shape
        costs[side[r], side[k]], best[side[r], side[k]] = np.frombuffer(c).reshape(shape), np.frombuffer(b).reshape(shape)
    return costs, best


def _newest(changes: list[DataFrame]) -> DataFrame:
    rows = reduce(DataFrame.unionByName, changes)
    if len(changes) == 1:
        return rows
    return rows.groupBy(*TILE_KEYS).agg(F.max_by(F.struct("costs", "best", "round"), "round").alias("t")).select(*TILE_KEYS, "t.*")


def _of(tiles: DataFrame, asked: DataFrame) -> DataFrame:
    """The tiles whose keys are asked for; the keys are broadcast if few enough, so that other tiles don't move."""
    keys = checkpointed(asked.select(*TILE_KEYS).distinct())
    return tiles.join(F.broadcast(keys) if keys.count() <= KEYS else keys, list(TILE_KEYS), "left_semi")


def relaxed_tiles(cells: DataFrame, sources: DataFrame, cost: str = "routing", tile: int = TILE) -> DataFrame:
    """(ty, tx, costs, best, round): the raster's tiles with the least cumulative cost of each cell from the nearest source, infinite where none leads. sources: (row, col). Cells with null costs are closed."""
    start = sources.select("row", "col").distinct().withColumn("__s", F.lit(True))
    placed = cells.select("row", "col", F.col(cost).cast("double").alias("c")).join(start, ["row", "col"], "left")
    placed = placed.select(*[F.floor(F.col(c) / tile).cast("int").alias(n) for c, n in (("row", "ty"), ("col", "tx"))], "row", "col", "c", F.when(F.col("__s") & (F.col("c") > 0), 0.0).otherwise(float("inf")).alias("best"))
    kinds = "ty int, tx int, costs binary, best binary, round int"

    def written(ty: int, tx: int, costs: bytes, best: np.ndarray, number: int) -> pa.Table:
        return pa.table({"ty": pa.array([ty], pa.int32()), "tx": pa.array([tx], pa.int32()), "costs": pa.array([costs], pa.binary()), "best": pa.array([np.ascontiguousarray(best).tobytes()], pa.binary()), "round": pa.array([number], pa.int32())})

    def first(key: tuple, rows: pa.Table) -> pa.Table:
        ty, tx = (k.as_py() for k in key)
        costs, best = np.full((tile, tile), -1.0), np.full((tile, tile), np.inf)
        y, x = np.asarray(rows["row"]) - ty * tile, np.asarray(rows["col"]) - tx * tile
        costs[y, x] = np.nan_to_num(np.asarray(rows["c"]), nan=-1.0)
        best[y, x] = np.asarray(rows["best"])
        best = relaxed_tile(costs, best, np.flatnonzero(np.isfinite(best)))
        return written(ty, tx, costs.tobytes(), best, 1 if np.isfinite(best).any() else 0)

    def improved(own: pa.Table, given: pa.Table) -> pa.Table:
        """The tile, if its neighbours' borders improve a cell."""
        if not len(own) or not len(given):
            return own.slice(0, 0)
        newest = int(np.argmax(np.asarray(own["round"])))
        own = own.slice(newest, 1)
        costs, best = _framed(own, given, tile)
        margin = np.ones(best.shape, bool)
        margin[1:-1, 1:-1] = False
        before = best[1:-1, 1:-1].copy()
        best = relaxed_tile(costs, best, np.flatnonzero((margin & np.isfinite(best)).ravel()))[1:-1, 1:-1]
        if not (best < before).any():
            return own.slice(0, 0)
        return written(own["ty"][0].as_py(), own["tx"][0].as_py(), own["costs"][0].as_py(), best, own["round"][0].as_py() + 1)

    changes = [checkpointed(placed.groupBy(*TILE_KEYS).applyInArrow(first, kinds))]
    active = changes[0].filter("round > 0")
    while not active.isEmpty():
        sent = checkpointed(border_rows(active, tile))
        held = _of(reduce(DataFrame.unionByName, changes), sent)
        active = checkpointed(held.groupBy(*TILE_KEYS).cogroup(sent.groupBy(*TILE_KEYS)).applyInArrow(improved, kinds))
        changes.append(active)
        if len(changes) > CHANGES:
            changes = [checkpointed(_newest(changes))]
    return checkpointed(_newest(changes))


def tile_cells(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """(row, col, best) of the open cells of tiles; null where no source leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ty, tx, c, b in _squares(batch, tile):
                c, b = c.ravel(), b.ravel()
                some = np.flatnonzero(c > 0)
                yield pa.RecordBatch.from_arrays([pa.array(some // tile + ty * tile, pa.int32()), pa.array(some % tile + tx * tile, pa.int32()), pa.array(b[some], mask=~np.isfinite(b[some]))], names=["row", "col", "best"])

    return tiles.select("ty", "tx", "costs", "best").mapInArrow(run, "row int, col int, best double")


def relaxed_costs(cells: DataFrame, sources: DataFrame, cost: str = "routing", tile: int = TILE) -> DataFrame:
    """(row, col, best): least cumulative cost from the nearest source over a whole raster; null where none leads. sources: (row, col)."""
    return tile_cells(relaxed_tiles(cells, sources, cost, tile), tile)


def step_tiles(tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """(ty, tx, steps): a byte for each cell of relaxed tiles: the direction of the cell that it was reached from, SOURCE or LOST."""

    def run(own: pa.Table, given: pa.Table) -> pa.Table:
        if not len(own):
            return pa.table({"ty": pa.array([], pa.int32()), "tx": pa.array([], pa.int32()), "steps": pa.array([], pa.binary())})
        costs, best = _framed(own, given, tile)
        here, c = best[1:-1, 1:-1], costs[1:-1, 1:-1]
        steps, least = np.full((tile, tile), LOST, np.uint8), np.full((tile, tile), np.inf)
        for k, (r, q, length) in enumerate(STEPS):
            there = slice(1 + r, tile + 1 + r), slice(1 + q, tile + 1 + q)
            way = np.where(costs[there] > 0, best[there] + (costs[there] + c) / 2 * length, np.inf)
            steps[way < least] = k
            least = np.minimum(least, way)
        steps[~np.isfinite(here) | (c <= 0)] = LOST
        steps[here == 0] = SOURCE
        return pa.table({"ty": own["ty"], "tx": own["tx"], "steps": pa.array([steps.tobytes()], pa.binary())})

    rows = tiles.select("ty", "tx", "costs", "best")
    return checkpointed(rows.groupBy(*TILE_KEYS).cogroup(border_rows(rows, tile).groupBy(*TILE_KEYS)).applyInArrow(run, "ty int, tx int, steps binary"))


def traced_back(steps: DataFrame, ends: DataFrame, tile: int = TILE) -> DataFrame:
    """(path, step, row, col): the cells of each path from its end, step 0, back to a source. ends: (path, row, col); ends that no source reaches, and null or unknown places, give no rows.

    In each round all paths walk to the border of the tile that they are in.
    Paths at the same cell go on together, so a task holds a tile and at most
    one walk for each of its cells.
    """
    names = {"path": dict(ends.dtypes)["path"]}
    walked = "row int, col int, cells array<struct<row:int,col:int>>, next struct<row:int,col:int>"
    of_tile = [F.floor(F.col(c) / tile).cast("int").alias(n) for c, n in (("row", "ty"), ("col", "tx"))]

    def walk(own: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if len(own) and len(asked):
            ty, tx = own["ty"][0].as_py(), own["tx"][0].as_py()
            code = np.frombuffer(own["steps"][0].as_py(), np.uint8).reshape(tile, tile)
            for row, col in zip(asked["row"].to_pylist(), asked["col"].to_pylist()):
                y, x, cells, on = row - ty * tile, col - tx * tile, [], None
                while code[y, x] != LOST:
                    cells.append({"row": y + ty * tile, "col": x + tx * tile})
                    if code[y, x] == SOURCE:
                        break
                    r, q, _ = STEPS[code[y, x]]
                    y, x = y + r, x + q
                    if not (0 <= y < tile and 0 <= x < tile):
                        on = {"row": y + ty * tile, "col": x + tx * tile}
                        break
                out.append((row, col, cells, on))
        cell = pa.struct([("row", pa.int32()), ("col", pa.int32())])
        columns = list(zip(*out)) or [()] * 4
        return pa.table({n: pa.array(x, t) for n, x, t in zip(("row", "col", "cells", "next"), columns, (pa.int32(), pa.int32(), pa.list_(cell), cell))})

    at = checkpointed(ends.select("path", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.lit(0).cast("long").alias("done")).dropna())
    parts = []
    while not at.isEmpty():
        asked = at.select("row", "col").distinct().select("row", "col", *of_tile)
        walks = _of(steps, asked).groupBy(*TILE_KEYS).cogroup(asked.groupBy(*TILE_KEYS)).applyInArrow(walk, walked)
        met = checkpointed(at.join(walks, ["row", "col"]).filter(F.size("cells") > 0))
        parts.append(met.select("path", "done", F.posexplode("cells").alias("i", "c")).select("path", (F.col("done") + F.col("i")).alias("step"), "c.row", "c.col"))
        at = met.filter("next IS NOT NULL").select("path", "next.row", "next.col", (F.col("done") + F.size("cells")).alias("done"))
    if not parts:
        return ends.sparkSession.createDataFrame([], f"path {names['path']}, step long, row int, col int")
    return reduce(DataFrame.unionByName, parts)


def whole_raster_paths(cells: DataFrame, sources: DataFrame, ends: DataFrame, cost: str = "routing", tile: int = TILE) -> DataFrame:
    """(path, step, row, col): cheapest paths over a whole raster from each end back to the nearest source. sources: (row, col); ends: (path, row, col)."""
    return traced_back(step_tiles(relaxed_tiles(cells, sources, cost, tile), tile), ends, tile)


def path_costs(paths: DataFrame, cells: DataFrame, cost: str = "routing") -> DataFrame:
    """(path, cells, cost, longest): how many cells each path has, what its steps cost together, and its longest step in cells."""
    priced = paths.join(cells.select("row", "col", F.col(cost).cast("double").alias("__c")), ["row", "col"])
    order = Window.partitionBy("path").orderBy("step")
    before = lambda c: F.lag(c).over(order)
    length = F.sqrt(F.pow(F.col("row") - before("row"), 2) + F.pow(F.col("col") - before("col"), 2))
    steps = priced.select("path", length.alias("length"), ((F.col("__c") + before("__c")) / 2 * length).alias("paid"))
    return steps.groupBy("path").agg(F.count("*").alias("cells"), F.coalesce(F.sum("paid"), F.lit(0.0)).alias("cost"), F.coalesce(F.max("length"), F.lit(0.0)).alias("longest"))
