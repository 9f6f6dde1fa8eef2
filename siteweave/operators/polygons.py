"""Polygons with real rings: points in them, cells under them, their repair, and polygons made from cells.

A polygon is rows of vertices, (shape, ring, seq, x, y); rings close by
themselves and may be of any number, the inside is where an odd number of rings
is left behind (even-odd), so the order of rings and their directions don't
matter. Everything else works on directed edges: they meet points and each
other through square tiles, and rows of a lattice through the rows that they
cross, so no task holds a polygon or a raster.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions.spatial import project_on_segment
from siteweave.operators.spatial_joins import nearest_by_degrees
from siteweave.session import checkpointed

EDGE = ("x1", "y1", "x2", "y2")
#: Share of a tile by which tiles are shifted from round numbers, on which corners of shapes tend to lie.
SHIFT = 0.3819660112501051
#: Share of a tile within which an edge counts as touching it.
SLACK = 1e-9


def edges(vertices: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, ring, seq, x1, y1, x2, y2): each vertex with the next of its ring, the last with the first.

    Vertices with null coordinates take no part; a vertex repeated right after
    itself gives no edge, nor does a ring of one vertex.
    """
    ring = Window.partitionBy(shape, "ring").orderBy("seq")
    following = lambda c: F.coalesce(F.lead(c).over(ring), F.first(c).over(ring))
    out = vertices.dropna(subset=["x", "y"]).select(shape, "ring", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), following("x").alias("x2"), following("y").alias("y2"))
    return out.filter("x1 != x2 OR y1 != y2")


def ring_areas(sides: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, ring, area, cx, cy): the signed area, positive counter-clockwise, and the centre of each ring's area; the mean of its vertices without any."""
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    sums = sides.groupBy(shape, "ring").agg(
        F.sum(cross).alias("a"), F.sum((F.col("x1") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y1") + F.col("y2")) * cross).alias("sy"), F.avg("x1").alias("mx"), F.avg("y1").alias("my")
    )
    centre = lambda s, m: F.when(F.col("a") != 0, F.col(s) / (3 * F.col("a"))).otherwise(F.col(m))
    return sums.select(shape, "ring", (F.col("a") / 2).alias("area"), centre("sx", "mx").alias("cx"), centre("sy", "my").alias("cy"))


def _between(low: Column, high: Column) -> Column:
    """The whole numbers from low to high, none if low is above high."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))


def lattice_runs(sides: DataFrame, keys: list[str], lines: int | None = None) -> DataFrame:
    """(keys, line, first, last): the lattice points (whole x and y) inside, as runs on each line y = line, of lines 0 to ``lines`` - 1 if given. sides: (keys, x1, y1, x2, y2).

    An edge crosses the lines from its lower end, included, to its upper end;
    the crossings of a line, in order, begin and end its runs in turn.
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    start, end = F.ceil(low).cast("long"), (F.ceil(high) - 1).cast("long")
    if lines is not None:
        start, end = F.greatest(start, F.lit(0).cast("long")), F.least(end, F.lit(lines - 1).cast("long"))
    crossed = sides.withColumn("line", F.explode(_between(start, end)))
    x = F.col("x1") + (F.col("line") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    of_line = Window.partitionBy(*keys, "line").orderBy("x")
    runs = crossed.select(*keys, "line", x.alias("x")).select(*keys, "line", "x", F.row_number().over(of_line).alias("n"), F.lead("x").over(of_line).alias("to"))
    runs = runs.filter("n % 2 = 1 AND to IS NOT NULL")
    return runs.select(*keys, "line", F.ceil("x").cast("long").alias("first"), (F.ceil("to") - 1).cast("long").alias("last")).filter("first <= last")


def scaled(sides: DataFrame, x0: float, dx: float, y0: float, dy: float) -> DataFrame:
    """The edges in units of a lattice whose point (0, 0) is at (x0, y0)."""
    at = {"x": (x0, dx), "y": (y0, dy)}
    return sides.withColumns({c: (F.col(c) - at[c[0]][0]) / at[c[0]][1] for c in EDGE})


def touched_squares(sides: DataFrame, slack: float = SLACK, reach: Column | float = 0.0, closed: bool = True) -> DataFrame:
    """Adds row and col of every unit square that an edge touches, or comes within ``reach`` of: rows by its height, columns by its part in that row.

    Unless ``closed``, a square that is only touched from outside at its border
    doesn't count; an edge along a border belongs to the square above it or
    right of it.
    """
    last = (lambda low, high: F.floor(high)) if closed else (lambda low, high: F.greatest(F.floor(low), F.ceil(high) - 1))
    low, high = F.least("y1", "y2") - slack - reach, F.greatest("y1", "y2") + slack + reach
    out = sides.withColumn("row", F.explode(_between(F.floor(low), last(low, high))))
    lean = F.when(F.col("y1") != F.col("y2"), (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    inside = lambda y: F.greatest(F.least("y1", "y2"), F.least(F.greatest("y1", "y2"), y))
    here = [F.when(lean.isNull(), end).otherwise(F.col("x1") + (inside(y) - F.col("y1")) * lean) for end, y in ((F.col("x1"), F.col("row") - reach), (F.col("x2"), F.col("row") + 1 + reach))]
    low, high = F.least(*here) - slack - reach, F.greatest(*here) + slack + reach
    return out.withColumn("col", F.explode(_between(F.floor(low), last(low, high))))


def _tiling(sides: DataFrame) -> tuple[float, float, float]:
    """Origin and width of tiles, about as many as edges, for the extent of all edges."""
    n, x0, x1, y0, y1 = sides.agg(F.count("*"), F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2"))).first()
    if not n:
        return 0.0, 0.0, 1.0
    size = sqrt(max(x1 - x0, 1e-9) * max(y1 - y0, 1e-9) / n) or max(x1 - x0, y1 - y0) or 1.0
    return x0 - SHIFT * size, y0 - SHIFT * size, size


def points_in(points: DataFrame, sides: DataFrame, point_id: str, tile: float | None = None, shape: str = "shape") -> DataFrame:
    """(point_id, shape) of all polygons that hold a point; points on a boundary are held. points: (point_id, x, y); sides: as from ``edges``.

    Each tile knows of each polygon whether its lower left corner is inside. A
    point counts the edges of its tile that the way from that corner up and
    then right to the point crosses: it is inside if corner and crossings
    together are odd. Points and corners count as moved right by less than
    anything, and up by less than that, so that vertices are crossed once.
    Null points and empty tables give no rows; repeated points must not share
    an id.
    """
    x0, y0, size = _tiling(sides)
    size = tile or size
    within = scaled(sides.select(shape, *EDGE), x0, size, y0, size)
    inside = lattice_runs(within, [shape]).select(shape, F.col("line").alias("row"), F.explode(_between(F.col("first"), F.col("last"))).alias("col"))
    nothing = [F.lit(None).cast("double").alias(c) for c in EDGE]
    # Tiles only say what meets; what is crossed is asked in the coordinates given.
    told = touched_squares(scaled(sides.select(shape, *EDGE, *[F.col(c).alias(f"__{c}") for c in EDGE]), x0, size, y0, size))
    parts = inside.select("row", "col", shape, *nothing).unionByName(told.select("row", "col", shape, *[F.col(f"__{c}").cast("double").alias(c) for c in EDGE]))
    at = points.select(point_id, F.col("x").alias("px"), F.col("y").alias("py")).dropna()
    met = at.withColumn("row", F.floor((F.col("py") - y0) / size)).withColumn("col", F.floor((F.col("px") - x0) / size)).join(parts, ["row", "col"])
    c = F.col
    left, below = F.lit(x0) + c("col") * F.lit(size), F.lit(y0) + c("row") * F.lit(size)
    # Divisions are asked for only where an edge crosses the line in question.
    across_x, across_y = (c("x1") <= left) != (c("x2") <= left), (c("y1") <= c("py")) != (c("y2") <= c("py"))
    lean = F.signum((c("x2") - c("x1")) * (c("y2") - c("y1")))
    y_at = F.when(across_x, c("y1") + (left - c("x1")) / (c("x2") - c("x1")) * (c("y2") - c("y1")))
    x_at = F.when(across_y, c("x1") + (c("py") - c("y1")) / (c("y2") - c("y1")) * (c("x2") - c("x1")))
    above = lambda y: (y_at > y) | ((y_at == y) & (lean > 0))
    up = across_x & above(below) & ~above(c("py"))
    right = across_y & (x_at > left) & (x_at <= c("px"))
    on = ((c("x2") - c("x1")) * (c("py") - c("y1")) == (c("y2") - c("y1")) * (c("px") - c("x1"))) & c("px").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & c("py").between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    count = F.when(c("x1").isNull(), 1).otherwise(F.when(up, 1).otherwise(0) + F.when(right, 1).otherwise(0))
    held = met.groupBy(point_id, shape).agg(F.sum(count).alias("n"), F.max(F.coalesce(on, F.lit(False))).alias("on"))
    return held.filter("n % 2 = 1 OR on").select(point_id, shape)


def classify(points: DataFrame, sides: DataFrame, point_id: str, force: bool = False, outlier: int = -999, tile: float | None = None, shape: str = "shape") -> DataFrame:
    """(point_id, shape): the polygon that holds each point, the last (largest) of several; else ``outlier``, or with ``force`` the one whose centre of area is nearest, the first of equals.

    points: (point_id, x, y); rings as from ``oriented``, so that holes take
    their area off. Points without a place are outliers.
    """
    last = points_in(points, sides, point_id, tile, shape).groupBy(point_id).agg(F.max(shape).alias(shape))
    found = points.select(point_id, "x", "y").join(last, point_id, "left")
    if force:
        found = checkpointed(found)
        lost = found.filter(F.col(shape).isNull()).select(point_id, F.col("y").alias("lat"), F.col("x").alias("lon"))
        near = nearest_by_degrees(lost, centres(sides, shape).withColumnRenamed(shape, "__near"), point_id, "__near")
        found = found.join(near.select(point_id, "__near"), point_id, "left").withColumn(shape, F.coalesce(shape, "__near"))
    return found.select(point_id, F.coalesce(shape, F.lit(outlier)).alias(shape))


def centres(sides: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, area, lat, lon): the area and its centre, holes (rings the other way round) taken off."""
    area = F.sum("area")
    out = ring_areas(sides, shape).groupBy(shape).agg(area.alias("area"), (F.sum(F.col("cy") * F.col("area")) / area).alias("lat"), (F.sum(F.col("cx") * F.col("area")) / area).alias("lon"))
    return out.filter("area != 0")


def nearest_shape(points: DataFrame, sides: DataFrame, point_id: str, tile: float | None = None, shape: str = "shape") -> DataFrame:
    """(point_id, shape, distance): the polygon nearest to each point, 0 inside, the smallest shape of equals.

    Points outside meet the edges of the tiles around theirs; one whose nearest
    edge is not farther than a tile's width is settled, the rest looks again in
    tiles four times as wide.
    """
    x0, y0, size = _tiling(sides)
    size = tile or size
    inside = points_in(points, sides, point_id, size, shape).groupBy(point_id).agg(F.min(shape).alias(shape)).withColumn("distance", F.lit(0.0))
    out = checkpointed(inside)
    left = checkpointed(points.select(point_id, F.col("x").alias("px"), F.col("y").alias("py")).dropna().join(out, point_id, "left_anti"))
    ends = [e for c in ("x", "y") for e in (F.min(F.least(f"{c}1", f"{c}2")), F.max(F.greatest(f"{c}1", f"{c}2")))]
    box, asked = sides.agg(*ends).first(), left.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if box[0] is None or asked[0] is None:
        return out
    reach = max(max(box[1], asked[1]) - min(box[0], asked[0]), max(box[3], asked[3]) - min(box[2], asked[2]))
    step = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    while True:
        squares = touched_squares(scaled(sides.select(shape, *EDGE), x0, size, y0, size))
        around = left.withColumn("row", F.floor((F.col("py") - y0) / size)).withColumn("col", F.floor((F.col("px") - x0) / size))
        around = around.withColumn("row", F.explode(F.transform(step, lambda s: s + F.col("row")))).withColumn("col", F.explode(F.transform(step, lambda s: s + F.col("col"))))
        met = around.join(squares, ["row", "col"])
        ends = [F.col(c) * size + (x0 if c[0] == "x" else y0) for c in EDGE]
        x, y = project_on_segment(F.col("px"), F.col("py"), *ends)
        far = F.sqrt((F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y))
        # Rounded, so that the shared edge of two polygons is as far from both.
        best = met.groupBy(point_id).agg(F.min(F.struct(F.round(far, 9).alias("distance"), F.col(shape))).alias("b")).select(point_id, f"b.{shape}", "b.distance")
        best = checkpointed(best if size > reach else best.filter(F.col("distance") <= size))
        out = out.unionByName(best)
        left = checkpointed(left.join(best, point_id, "left_anti"))
        if size > reach or left.isEmpty():
            return out
        size *= 4


def oriented(vertices: DataFrame, shape: str = "shape") -> DataFrame:
    """The vertices with rings that lie inside an odd number of the shape's other rings as holes, clockwise, and all others counter-clockwise; seq runs from 0, closing and repeated vertices and rings without area are gone."""
    sides = checkpointed(edges(vertices, shape))
    turned = ring_areas(sides, shape).filter("area != 0").select(shape, "ring", "area")
    one = F.struct(F.col(shape), F.col("ring"))
    # One vertex of each ring against the other rings as polygons of their own.
    starts = sides.groupBy(shape, "ring").agg(F.min(F.struct("seq", "x1", "y1")).alias("s")).select(one.alias("id"), F.col("s.x1").alias("x"), F.col("s.y1").alias("y"))
    held = points_in(starts, sides.withColumn("outer", one), "id", shape="outer")
    depth = held.filter(F.col(f"id.{shape}") == F.col(f"outer.{shape}")).filter("id.ring != outer.ring").groupBy(F.col(f"id.{shape}").alias(shape), F.col("id.ring").alias("ring")).agg(F.count("*").alias("depth"))
    told = turned.join(depth, [shape, "ring"], "left").select(shape, "ring", (F.coalesce("depth", F.lit(0)) % 2 == 1).alias("hole"), (F.col("area") < 0).alias("clockwise"))
    rows = sides.join(told, [shape, "ring"]).withColumn("order", F.when(F.col("hole") == F.col("clockwise"), F.col("seq")).otherwise(-F.col("seq")))
    place = Window.partitionBy(shape, "ring").orderBy("order")
    return rows.select(shape, "ring", (F.row_number().over(place) - 1).alias("seq"), F.col("x1").alias("x"), F.col("y1").alias("y"), "hole")


def faults(vertices: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, ring, fault, n): what is wrong with rings: null (vertices without a place), short (fewer than three distinct vertices), flat (no area), crossing (edges of the shape that cross or overlap others, the ring of the earlier one)."""
    null = vertices.filter("x IS NULL OR y IS NULL").groupBy(shape, "ring").agg(F.count("*").alias("n")).withColumn("fault", F.lit("null"))
    size = vertices.groupBy(shape, "ring").agg(F.countDistinct(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct("x", "y"))).alias("n"))
    short = size.filter("n < 3").withColumn("fault", F.lit("short"))
    sides = checkpointed(edges(vertices, shape))
    flat = ring_areas(sides, shape).filter("area = 0").join(short.select(shape, "ring"), [shape, "ring"], "left_anti").select(shape, "ring", F.lit(1).cast("long").alias("n"), F.lit("flat").alias("fault"))
    crossing = crossings(sides, shape).groupBy(shape, F.col("ring_a").alias("ring")).agg(F.count("*").alias("n")).withColumn("fault", F.lit("crossing"))
    parts = [x.select(shape, "ring", "fault", "n") for x in (null, short, flat, crossing)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def crossings(sides: DataFrame, shape: str = "shape") -> DataFrame:
    """(shape, ring_a, seq_a, ring_b, seq_b): pairs of edges of one shape that have a point in common which is no common end."""
    x0, y0, size = _tiling(sides)
    squares = touched_squares(scaled(sides.select(shape, "ring", "seq", *EDGE), x0, size, y0, size))
    a = squares.select(shape, "row", "col", *[F.col(c).alias(f"{c}_a") for c in ("ring", "seq", *EDGE)])
    b = squares.select(shape, "row", "col", *[F.col(c).alias(f"{c}_b") for c in ("ring", "seq", *EDGE)])
    # Rows that explode count as one when Spark guesses sizes, so it is told not to send one side to all.
    pairs = a.join(b.hint("merge"), [shape, "row", "col"]).filter(F.struct("ring_a", "seq_a") < F.struct("ring_b", "seq_b"))
    p = {f"{c}{e}": F.col(f"{c}_{e}") for c in EDGE for e in "ab"}

    def side(ax, ay, bx, by, x, y):
        return F.signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))

    def on(s, ax, ay, bx, by, x, y):
        """Whether an end of the other edge lies on this one, not at an end of it."""
        inside = x.between(F.least(ax, bx), F.greatest(ax, bx)) & y.between(F.least(ay, by), F.greatest(ay, by))
        return (s == 0) & inside & ~((x == ax) & (y == ay)) & ~((x == bx) & (y == by))

    ea, eb = [p[f"{c}a"] for c in EDGE], [p[f"{c}b"] for c in EDGE]
    s1, s2 = side(*ea, eb[0], eb[1]), side(*ea, eb[2], eb[3])
    s3, s4 = side(*eb, ea[0], ea[1]), side(*eb, ea[2], ea[3])
    same = ((ea[0] == eb[0]) & (ea[1] == eb[1]) & (ea[2] == eb[2]) & (ea[3] == eb[3])) | ((ea[0] == eb[2]) & (ea[1] == eb[3]) & (ea[2] == eb[0]) & (ea[3] == eb[1]))
    touch = on(s1, *ea, eb[0], eb[1]) | on(s2, *ea, eb[2], eb[3]) | on(s3, *eb, ea[0], ea[1]) | on(s4, *eb, ea[2], ea[3])
    return pairs.filter(((s1 * s2 < 0) & (s3 * s4 < 0)) | touch | same).select(shape, "ring_a", "seq_a", "ring_b", "seq_b").distinct()


def clipped(vertices: DataFrame, box: tuple[Column | float, Column | float, Column | float, Column | float], shape: str = "shape") -> DataFrame:
    """The parts of rings inside a box (minx, miny, maxx, maxy): one side of the box after the other keeps the vertices on its inner side and puts new ones where edges cross it.

    A ring that leaves and comes back is joined along the box's sides, which
    even-odd areas and sums don't see. Box sides may be columns of the rows,
    the same in all rows of a ring. Null vertices take no part; rings outside
    give no rows.
    """
    names = ("minx", "miny", "maxx", "maxy")
    sides = [b if isinstance(b, Column) else F.lit(float(b)) for b in box]
    out = vertices.dropna(subset=["x", "y"]).select(shape, "ring", F.col("seq").cast("long").alias("seq"), *[F.col(c).cast("double").alias(c) for c in "xy"], *[s.alias(f"__{n}") for s, n in zip(sides, names)])
    ring = Window.partitionBy(shape, "ring").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for axis, other, name in (("x", "y", "minx"), ("x", "y", "maxx"), ("y", "x", "miny"), ("y", "x", "maxy")):
        limit = F.col(f"__{name}")
        inner = (lambda c: c <= limit) if name.startswith("max") else (lambda c: c >= limit)  # noqa: B023, E731
        out = out.withColumns({f"__{c}": F.coalesce(F.lag(c).over(ring), F.last(c).over(whole)) for c in "xy"})
        here, before = F.col(axis), F.col(f"__{axis}")
        crosses = inner(here) != inner(before)
        at = F.when(crosses, F.col(f"__{other}") + (limit - before) / (here - before) * (F.col(other) - F.col(f"__{other}")))
        new = {axis: limit, other: at}
        points = [
            F.struct((F.col("seq") * 2).alias("seq"), new["x"].alias("x"), new["y"].alias("y"), crosses.alias("stays")),
            F.struct((F.col("seq") * 2 + 1).alias("seq"), F.col("x").alias("x"), F.col("y").alias("y"), inner(here).alias("stays")),
        ]
        out = out.select(shape, "ring", *[f"__{n}" for n in names], F.inline(F.array(*points))).filter("stays").drop("stays")
    return out.select(shape, "ring", "seq", "x", "y")
