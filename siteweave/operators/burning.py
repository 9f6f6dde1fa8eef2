"""Polygons and lines on rasters, and rasters as polygons.

Shapes are directed edges as ``polygons.edges`` gives them; a raster is a
``Grid`` and rows of cells. A polygon becomes runs of each raster row, from the
crossings of its edges with the row's centre line; a line becomes the squares
that each of its edges passes. Cells become polygons by their sides: those
between two cells of one value cancel, the rest are chained to rings by pointer
jumping, so that the number of rounds is the logarithm of the longest ring.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.operators.polygons import EDGE, lattice_runs, scaled, touched_squares
from siteweave.session import checkpointed

CELL = ("row", "col")
#: The corner from which each side of a cell starts (rows, columns), and where it leads; by direction, the inside on the left when rows count upwards.
STARTS = ((0, 0), (0, 1), (1, 1), (1, 0))
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


@dataclass(frozen=True)
class Grid:
    """A raster without rotation: cell (0, 0) begins at (x0, y0), a column is dx wide, a row dy high (negative downwards)."""

    rows: int
    cols: int
    x0: float = 0.0
    dx: float = 1.0
    y0: float = 0.0
    dy: float = 1.0

    def refined(self, parts: int) -> Grid:
        return Grid(self.rows * parts, self.cols * parts, self.x0, self.dx / parts, self.y0, self.dy / parts)

    def inside(self, cells: DataFrame) -> DataFrame:
        """The cells on the raster, as ints."""
        on = cells.filter(F.col("row").between(0, self.rows - 1) & F.col("col").between(0, self.cols - 1))
        return on.withColumns({c: F.col(c).cast("int") for c in CELL})

    def clipped(self, runs: DataFrame) -> DataFrame:
        """What of runs (row, first, last) is on the raster, as ints."""
        on = runs.filter(F.col("row").between(0, self.rows - 1)).withColumns({"first": F.greatest("first", F.lit(0)), "last": F.least("last", F.lit(self.cols - 1))})
        return on.filter("first <= last").withColumns({c: F.col(c).cast("int") for c in ("row", "first", "last")})

    def units(self, sides: DataFrame, shift: float = 0.0) -> DataFrame:
        """The edges in columns and rows; with a shift of 0.5 cell centres are whole numbers."""
        return scaled(sides, self.x0 + shift * self.dx, self.dx, self.y0 + shift * self.dy, self.dy)


def polygon_runs(sides: DataFrame, grid: Grid, shape: str = "shape") -> DataFrame:
    """(shape, row, first, last): the runs of cells whose centres are in each polygon."""
    runs = lattice_runs(grid.units(sides.select(shape, *EDGE), 0.5), [shape], grid.rows)
    return grid.clipped(runs.withColumnRenamed("line", "row")).select(shape, "row", "first", "last")


def run_cells(runs: DataFrame) -> DataFrame:
    """The runs' cells one by one."""
    keys = [c for c in runs.columns if c not in ("first", "last")]
    return runs.select(*keys, F.explode(F.sequence("first", "last")).alias("col"))


def burned_polygons(sides: DataFrame, grid: Grid, all_touched: bool = False, shape: str = "shape") -> DataFrame:
    """(shape, row, col): the cells whose centres are in each polygon, with ``all_touched`` also those that its boundary passes."""
    cells = run_cells(polygon_runs(sides, grid, shape))
    if not all_touched:
        return cells
    return cells.unionByName(burned_lines(sides, grid, True, shape)).distinct()


def burned_lines(sides: DataFrame, grid: Grid, all_touched: bool = False, shape: str = "shape") -> DataFrame:
    """(shape, row, col): the cells of lines (or boundaries): of every edge the cells of its ends, and one for each column, of steep edges each row, whose centre line it crosses; with ``all_touched`` every cell that it passes."""
    unit = grid.units(sides.select(shape, *EDGE))
    if all_touched:
        return grid.inside(touched_squares(unit, 0.0, closed=False).select(shape, *CELL)).distinct()
    ends = unit.select(shape, F.inline(F.array(*[F.struct(F.floor(f"y{i}").alias("row"), F.floor(f"x{i}").alias("col")) for i in (1, 2)])))
    flat = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    along = [F.when(flat, F.col(f"x{i}")).otherwise(F.col(f"y{i}")) for i in (1, 2)]
    across = [F.when(flat, F.col(f"y{i}")).otherwise(F.col(f"x{i}")) for i in (1, 2)]
    low, high = F.ceil(F.least(*along) - 0.5).cast("long"), (F.ceil(F.greatest(*along) - 0.5) - 1).cast("long")
    steps = unit.select(shape, flat.alias("flat"), *[c.alias(n) for c, n in zip((*along, *across), ("a1", "a2", "b1", "b2"))], F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>")).alias("s"))
    steps = steps.select("*", F.explode("s").alias("i")).withColumn("j", F.floor(F.col("b1") + (F.col("i") + 0.5 - F.col("a1")) / (F.col("a2") - F.col("a1")) * (F.col("b2") - F.col("b1"))))
    passed = steps.select(shape, F.when(F.col("flat"), F.col("j")).otherwise(F.col("i")).alias("row"), F.when(F.col("flat"), F.col("i")).otherwise(F.col("j")).alias("col"))
    return grid.inside(ends.unionByName(passed)).distinct()


def near_runs(sides: DataFrame, grid: Grid, distance: Column | float, shape: str = "shape") -> DataFrame:
    """(shape, row, first, last): of each row the cells whose centres lie within ``distance`` (in map units; may be a column) of an edge, apart for each shape.

    What lies near an edge has one run in a row. It begins where the edge moved
    aside by the distance, or the circle round an end, crosses the row; whether
    the cells there belong to it is asked of the cells themselves.
    """
    far = distance if isinstance(distance, Column) else F.lit(float(distance))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, *ends = (np.asarray(batch.column(i), dtype=float) for i in range(1, 6))
            v = (np.array([ends[1], ends[3]]) - grid.y0) / grid.dy
            low = np.maximum(np.ceil(v.min(0) - d / abs(grid.dy) - 0.5 - 1e-6), 0)
            high = np.minimum(np.floor(v.max(0) + d / abs(grid.dy) - 0.5 + 1e-6), grid.rows - 1)
            n = np.where((d >= 0) & (high >= low), high - low + 1, 0)
            n = np.nan_to_num(n).astype(np.int64)
            at = np.repeat(np.arange(len(batch)), n)
            row = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at].astype(np.int64)
            d, x1, y1, x2, y2 = (c[at] for c in (d, *ends))
            dx, dy, py = x2 - x1, y2 - y1, grid.y0 + (row + 0.5) * grid.dy
            length = dx * dx + dy * dy

            def held(col: np.ndarray) -> np.ndarray:
                px = grid.x0 + (col + 0.5) * grid.dx
                t = np.clip(np.divide((px - x1) * dx + (py - y1) * dy, length, out=np.zeros(len(col)), where=length > 0), 0.0, 1.0)
                x, y = x1 + t * dx, y1 + t * dy
                return (px - x) * (px - x) + (py - y) * (py - y) <= d * d

            found = []
            for side in (-1, 1):
                lean = np.divide(np.sign(dy) * dx, np.sqrt(length), out=np.zeros(len(at)), where=length > 0)
                t = np.divide(py + side * d * lean - y1, dy, out=np.where((dx >= 0) == (side < 0), 0.0, 1.0), where=dy != 0)
                t = np.clip(t, 0.0, 1.0)
                up = py - (y1 + t * dy)
                found.append((x1 + t * dx + side * np.sqrt(np.maximum(0.0, d * d - up * up)) - grid.x0) / grid.dx)
            first, last = np.ceil(np.minimum(*found) - 0.5), np.floor(np.maximum(*found) - 0.5)
            begins = np.select([held(first - 1), held(first), held(first + 1)], [first - 1, first, first + 1], np.nan)
            closes = np.select([held(last + 1), held(last), held(last - 1)], [last + 1, last, last - 1], np.nan)
            keep = begins <= closes
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[keep])), pa.array(row[keep]), pa.array(begins[keep].astype(np.int64)), pa.array(closes[keep].astype(np.int64))], names=[shape, "row", "first", "last"])

    rows = sides.select(shape, far.cast("double").alias("__d"), *[F.col(c).cast("double").alias(c) for c in EDGE])
    found = rows.mapInArrow(runs, f"{shape} {dict(sides.dtypes)[shape]}, row long, first long, last long")
    return merged_runs(grid.clipped(found), [shape, "row"])


def merged_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last): runs that overlap or follow each other as one."""
    order = Window.partitionBy(*keys).orderBy("first", "last")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = runs.withColumn("__new", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(order))
    return told.groupBy(*keys, "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run")


def near_lines(sides: DataFrame, grid: Grid, distance: Column | float, shape: str = "shape") -> DataFrame:
    """(shape, row, col): the cells whose centres lie within ``distance`` (in map units; may be a column) of an edge."""
    return run_cells(near_runs(sides, grid, distance, shape))


def buffer_runs(sides: DataFrame, grid: Grid, distance: float, shape: str = "shape") -> DataFrame:
    """(shape, row, first, last): runs, apart from each other, of the cells whose centres are in a polygon grown by the distance, or shrunk by a negative one."""
    inside, near, keys = polygon_runs(sides, grid, shape), near_runs(sides, grid, abs(distance), shape), [shape, "row"]
    if distance >= 0:
        return merged_runs(inside.unionByName(near), keys)
    # Each run near the boundary ends what is inside before it; what is inside after the last one stays.
    order = Window.partitionBy(*keys).orderBy("at")
    ends = near.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n"), F.lit(0).alias("i")), F.struct((F.col("last") + 1).alias("at"), F.lit(-1).alias("n"), F.lit(0).alias("i")))))
    ends = ends.unionByName(inside.select(*keys, F.inline(F.array(F.struct(F.col("first").alias("at"), F.lit(0).alias("n"), F.lit(1).alias("i")), F.struct((F.col("last") + 1).alias("at"), F.lit(0).alias("n"), F.lit(-1).alias("i"))))))
    level = ends.groupBy(*keys, "at").agg(F.sum("n").alias("n"), F.sum("i").alias("i"))
    level = level.select(*keys, "at", F.sum("n").over(order).alias("n"), F.sum("i").over(order).alias("i"), (F.lead("at").over(order) - 1).alias("last"))
    return level.filter("n = 0 AND i > 0").select(*keys, F.col("at").alias("first"), "last")


def burned_buffers(sides: DataFrame, grid: Grid, distance: float, shape: str = "shape") -> DataFrame:
    """(shape, row, col): the cells whose centres are in a polygon grown by the distance, or shrunk by a negative one."""
    return run_cells(buffer_runs(sides, grid, distance, shape))


def run_counts(runs: DataFrame) -> DataFrame:
    """(row, col, count): how many runs hold each cell, from where they begin and end; cells without are left out."""
    ends = runs.select("row", F.inline(F.array(F.struct(F.col("first").alias("col"), F.lit(1).alias("n")), F.struct((F.col("last") + 1).alias("col"), F.lit(-1).alias("n")))))
    order = Window.partitionBy("row").orderBy("col")
    level = ends.groupBy(*CELL).agg(F.sum("n").alias("n")).select(*CELL, F.sum("n").over(order).alias("count"), (F.lead("col").over(order) - 1).alias("last"))
    return level.filter("count > 0").select("row", F.explode(F.sequence("col", "last")).alias("col"), "count")


def coverage(sides: DataFrame, grid: Grid, parts: int, shape: str = "shape") -> DataFrame:
    """(row, col, share): the share of each cell's parts x parts sub-cells whose centres are in any polygon; cells without are left out."""
    fine = burned_polygons(sides, grid.refined(parts), shape=shape).select(*CELL).distinct()
    return fine.groupBy(*[F.expr(f"{c} div {parts}").cast("int").alias(c) for c in CELL]).agg((F.count("*") / F.lit(float(parts * parts))).alias("share"))


def burned_values(cells: DataFrame, value: str, first: Column) -> DataFrame:
    """(row, col, value): where shapes overlap, the value of the largest ``first``, of equals the larger value."""
    return cells.groupBy(*CELL).agg(F.max(F.struct(first.alias("f"), F.col(value).alias("v"))).alias("m")).select(*CELL, F.col("m.v").alias(value))


def short_lines(points: DataFrame, point_id: str, length: float = 50.0) -> DataFrame:
    """(point_id, x1, y1, x2, y2): points as lines to a place ``length`` further in both directions; null places take no part."""
    return points.dropna(subset=["x", "y"]).select(point_id, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + length).alias("x2"), (F.col("y") + length).alias("y2"))


def cell_boundaries(cells: DataFrame, value: str) -> DataFrame:
    """(id, value, x, y, dir): sides of cells that no cell of the same value shares, from corner (x, y) in direction dir; ids are distinct. Rows and columns are from 0 to 2**29."""
    sides = F.array(*[F.struct(F.lit(d).alias("dir"), F.lit(r).alias("r"), F.lit(c).alias("c")) for d, (r, c) in enumerate(STARTS)])
    out = cells.select(*CELL, value).dropna().groupBy(*CELL).agg(F.min(value).alias(value)).select(*CELL, value, F.inline(sides))
    out = out.select(value, (F.col("col") + F.col("c")).cast("long").alias("x"), (F.col("row") + F.col("r")).cast("long").alias("y"), "dir")
    # Both directions of a side start from its two ends; its lower end and axis name it.
    low = [F.col(a) - F.when(F.col("dir") == d, 1).otherwise(0) for a, d in (("x", 2), ("y", 3))]
    alone = out.groupBy(value, low[0].alias("lx"), low[1].alias("ly"), (F.col("dir") % 2).alias("axis")).agg(F.count("*").alias("n"), F.first("dir").alias("dir")).filter("n = 1")
    x, y = F.col("lx") + F.when(F.col("dir") == 2, 1).otherwise(0), F.col("ly") + F.when(F.col("dir") == 3, 1).otherwise(0)
    sides = alone.select(value, x.alias("x"), y.alias("y"), "dir")
    return sides.select((F.shiftleft("y", 33).bitwiseOR(F.shiftleft("x", 2)).bitwiseOR(F.col("dir"))).alias("id"), value, "x", "y", "dir")


def _following(sides: DataFrame, value: str, queen: bool) -> DataFrame:
    """(id, value, x, y, dir, next, corner): with the side that follows and whether it turns. Where two cells meet in a corner only, a ring stays with its cell, with ``queen`` it goes on to the other."""
    step = lambda i: sum((F.when(F.col("dir") == d, s[i]).otherwise(0) for d, s in enumerate(STEPS)), F.lit(0))
    ends = sides.withColumns({"ex": F.col("x") + step(1), "ey": F.col("y") + step(0)})
    begins = sides.select(F.col(value).alias("__v"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("id").alias("next"), F.col("dir").alias("turn"))
    met = ends.join(begins, ["ex", "ey"]).filter(F.col(value) == F.col("__v"))
    # Left turns are 1, straight on 0, right turns 3: the order of choice is left, on, right, or the reverse.
    turn = (F.col("turn") - F.col("dir") + 4) % 4
    choice = F.when(turn == 0, 1).when(turn == (3 if queen else 1), 0).otherwise(2)
    best = met.groupBy("id").agg(F.min(F.struct(choice.alias("choice"), "next", (turn != 0).alias("corner"), "ex", "ey", value)).alias("b"))
    return best.select("id", f"b.{value}", "b.next", "b.corner", F.col("b.ex").alias("x"), F.col("b.ey").alias("y"))


def ringed(links: DataFrame) -> DataFrame:
    """(id, ring, seq): the smallest id of each cycle of links (id, next) and the place of an id in it, counted from that one, by pointer jumping with reliable checkpoints."""
    state = checkpointed(links.select("id", F.col("next").alias("jump"), F.least("id", "next").alias("ring")))
    while True:
        ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("ring").alias("other"))
        now = checkpointed(state.join(ahead, "jump").select("id", F.col("further").alias("jump"), F.least("ring", "other").alias("ring"), (F.col("other") < F.col("ring")).alias("moved")))
        state = now.drop("moved")
        if now.filter("moved").isEmpty():
            break
    # The way to a cycle's first id: it ends where the next one is that id.
    cut = links.select("id", "next").join(state.select("id", "ring"), "id")
    walk = checkpointed(cut.select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("jump"), F.lit(1).cast("long").alias("left")))
    while not walk.filter("jump IS NOT NULL").isEmpty():
        ahead = walk.select(F.col("id").alias("jump"), F.col("jump").alias("further"), F.col("left").alias("more"))
        walk = checkpointed(walk.join(ahead, "jump", "left").select("id", "ring", F.col("further").alias("jump"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    length = walk.groupBy("ring").agg(F.max("left").alias("length"))
    return walk.join(length, "ring").select("id", "ring", (F.col("length") - F.col("left")).alias("seq"))


def cell_polygons(cells: DataFrame, value: str, grid: Grid | None = None, queen: bool = False) -> DataFrame:
    """(value, ring, seq, x, y): the boundaries of all cells of each value as rings with their corners only; outer rings counter-clockwise when rows count upwards, holes clockwise.

    cells: (row, col, value). Without a grid x and y are columns and rows.
    Cells that meet in a corner only are apart, with ``queen`` together.
    Repeated cells count once, with the smallest of their values; cells with
    nulls take no part.
    """
    links = checkpointed(_following(cell_boundaries(cells, value), value, queen))
    rings = links.filter("corner").join(ringed(links), "id")
    place = Window.partitionBy(value, "ring").orderBy("seq")
    out = rings.select(value, "ring", (F.row_number().over(place) - 1).alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if grid:
        out = out.withColumns({"x": F.lit(grid.x0) + F.col("x") * grid.dx, "y": F.lit(grid.y0) + F.col("y") * grid.dy})
    return out
