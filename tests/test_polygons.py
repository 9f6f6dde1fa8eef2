"""Polygons, lines and cells against brute force on lattices, where corners, sides and points coincide."""

import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from siteweave.operators import burning, polygons
from siteweave.operators.burning import Grid

VERTEX = "shape long, ring int, seq int, x double, y double"


def drawn_rings(seed, shapes=6, size=12):
    """Rings of whole corners, some crossing themselves, some with second rings."""
    rng = random.Random(seed)
    return {(s, r): [(rng.randrange(size), rng.randrange(size)) for _ in range(rng.randint(3, 8))] for s in range(shapes) for r in range(1 + s % 2)}


def vertices(spark, rings, extra=()):
    rows = [(s, r, i, float(x), float(y)) for (s, r), ring in rings.items() for i, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows + list(extra), VERTEX)


def sides(ring):
    return [(a, b) for a, b in zip(ring, ring[1:] + ring[:1]) if a != b]


def held(rings, shape, x, y):
    """Even-odd, exact, with the boundary."""
    odd = False
    for (s, _), ring in rings.items():
        for (x1, y1), (x2, y2) in sides(ring) if s == shape else []:
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 <= y) != (y2 <= y) and x1 + Fraction(y - y1) / (y2 - y1) * (x2 - x1) > x:
                odd = not odd
    return odd


@pytest.mark.parametrize(("seed", "tile"), [(1, None), (2, 1.0), (3, 2.5), (4, 40.0)])
def test_points_in_any_rings(spark, seed, tile):
    """Points on corners, sides and rows of corners; tiles of any width; rings that cross themselves."""
    rings = drawn_rings(seed)
    places = [(i, Fraction(x, 2), Fraction(y, 2)) for i, (x, y) in enumerate((x, y) for x in range(-1, 25) for y in range(-1, 25))]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, x, y in places] + [(9999, None, 1.0)], "id long, x double, y double")
    found = {tuple(r) for r in polygons.points_in(points, polygons.edges(vertices(spark, rings)), "id", tile).collect()}
    assert found == {(i, s) for i, x, y in places for s in range(6) if held(rings, s, x, y)}


def test_classification_and_nothing(spark):
    rings = {(1, 0): [(0, 0), (4, 0), (4, 4), (0, 4)], (1, 1): [(1, 1), (1, 3), (3, 3), (3, 1)], (2, 0): [(3, 3), (9, 3), (9, 9), (3, 9)]}
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 3.5, 3.5), (4, -3.0, 0.0), (5, None, None)], "id long, x double, y double")
    v = vertices(spark, rings, [(7, 0, 0, None, 1.0), (8, 0, 0, 5.0, 5.0), (8, 0, 1, 5.0, 5.0)])
    e = polygons.edges(v)
    as_dict = lambda df: {r[0]: r[1] for r in df.collect()}
    assert as_dict(polygons.classify(points, e, "id")) == {1: 1, 2: -999, 3: 2, 4: -999, 5: -999}
    assert as_dict(polygons.classify(points, e, "id", force=True)) == {1: 1, 2: 1, 3: 2, 4: 1, 5: -999}
    near = {r[0]: (r[1], r[2]) for r in polygons.nearest_shape(points, e, "id").collect()}
    assert near == {1: (1, 0.0), 2: (1, 1.0), 3: (1, 0.0), 4: (1, 3.0)}
    assert polygons.classify(points.limit(0), e, "id").count() == 0
    assert as_dict(polygons.classify(points, e.limit(0), "id")) == dict.fromkeys(range(1, 6), -999)
    assert polygons.nearest_shape(points, e.limit(0), "id").count() == 0


def test_nearest_shape_far_away(spark):
    rng = random.Random(8)
    rings = {(s, 0): [(rng.uniform(0, 100), rng.uniform(0, 5)) for _ in range(3)] for s in range(30)}
    places = [(i, rng.uniform(-300, 400), rng.uniform(-200, 300)) for i in range(60)]

    def far(x, y, ring):
        best = 1e18
        for (x1, y1), (x2, y2) in sides(ring):
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
            best = min(best, ((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) ** 0.5)
        return 0.0 if held({(0, 0): ring}, 0, Fraction(x), Fraction(y)) else best

    points = spark.createDataFrame(places, "id long, x double, y double")
    found = {r[0]: (r[1], r[2]) for r in polygons.nearest_shape(points, polygons.edges(vertices(spark, rings)), "id").collect()}
    for i, x, y in places:
        d, s = min((round(far(x, y, ring), 9), s) for (s, _), ring in rings.items())
        assert found[i][0] == s and abs(found[i][1] - d) < 1e-6


def test_rings_are_turned_and_holes_told(spark):
    rings = {
        (1, 0): [(0, 0), (0, 9), (9, 9), (9, 0)], (1, 1): [(1, 1), (8, 1), (8, 8), (1, 8)], (1, 2): [(2, 2), (2, 7), (7, 7), (7, 2)], (1, 3): [(20, 0), (22, 0), (22, 2)],
        (2, 0): [(3, 3), (5, 3), (5, 5), (5, 5), (3, 5), (3, 3)], (3, 0): [(0, 0), (4, 4)],
    }
    out = polygons.oriented(vertices(spark, rings))
    area = {(r["shape"], r["ring"]): r["area"] for r in polygons.ring_areas(polygons.edges(out)).collect()}
    assert area == {(1, 0): 81.0, (1, 1): -49.0, (1, 2): 25.0, (1, 3): 2.0, (2, 0): 4.0}
    assert {(r["shape"], r["ring"]) for r in out.filter("hole").collect()} == {(1, 1)}
    assert out.filter("shape = 2").count() == 4


def test_faults(spark):
    rings = {(1, 0): [(0, 0), (4, 0), (4, 4), (0, 4)], (2, 0): [(0, 0), (4, 4), (4, 0), (0, 4)], (3, 0): [(0, 0), (2, 2), (4, 4)], (4, 0): [(1, 1), (2, 2)], (5, 0): [(0, 0), (4, 0), (4, 4), (0, 4)], (5, 1): [(2, 2), (6, 2), (6, 3), (2, 3)], (6, 0): [(0, 0), (6, 0), (6, 6), (3, 0)]}
    out = polygons.faults(vertices(spark, rings, [(7, 0, 0, None, 1.0), (7, 0, 1, 1.0, 1.0), (7, 0, 2, 3.0, 1.0), (7, 0, 3, 3.0, 4.0)]))
    assert {(r["shape"], r["ring"], r["fault"]): r["n"] for r in out.collect()} == {
        (2, 0, "crossing"): 1, (2, 0, "flat"): 1, (3, 0, "flat"): 1, (3, 0, "crossing"): 2, (4, 0, "short"): 1 + 1, (4, 0, "crossing"): 1, (5, 0, "crossing"): 2, (6, 0, "crossing"): 2, (7, 0, "null"): 1,
    }


def test_clipping(spark):
    rings = {(1, 0): [(0, 0), (10, 0), (10, 10), (0, 10)], (1, 1): [(4, 4), (4, 6), (6, 6), (6, 4)], (2, 0): [(-5, 2), (3, 2), (3, 4)], (3, 0): [(20, 20), (21, 20), (21, 21)], (4, 0): [(0, 0), (12, 6), (0, 6)]}
    inside = polygons.clipped(vertices(spark, rings, [(9, 0, 0, None, 1.0)]), (1.0, 1.0, 5.0, 9.0))
    area = {(r["shape"], r["ring"]): round(r["area"], 9) for r in polygons.ring_areas(polygons.edges(inside)).collect()}
    # The triangle's long side is y = x / 2: above it, from x = 1 to 5 and y = 1 to 6.
    assert area == {(1, 0): 32.0, (1, 1): -2.0, (2, 0): 3.5, (4, 0): 4 * 5 - (5 - 2) * (2.5 - 1) / 2}
    own = vertices(spark, rings).withColumn("right", F.when(F.col("shape") == 1, 2.0).otherwise(5.0))
    wide = polygons.ring_areas(polygons.edges(polygons.clipped(own, (1.0, 1.0, F.col("right"), 9.0)))).filter("shape = 1")
    assert [r["area"] for r in wide.collect()] == [8.0]


# Rasters


def cells_of(df):
    return {(r["shape"], r["row"], r["col"]) for r in df.select("shape", "row", "col").collect()}


@pytest.mark.parametrize("grid", [Grid(14, 13), Grid(10, 9, -1.0, 1.5, 14.0, -1.5)])
def test_polygon_burns(spark, grid):
    """Centres on corners and rows of corners count as moved right and up by less than anything."""
    rings = drawn_rings(5)
    e = polygons.edges(vertices(spark, rings))
    found = cells_of(burning.burned_polygons(e, grid))
    for s in range(6):
        for row in range(grid.rows):
            for col in range(grid.cols):
                x, y = Fraction(grid.x0) + Fraction(2 * col + 1, 2) * Fraction(grid.dx), Fraction(grid.y0) + Fraction(2 * row + 1, 2) * Fraction(grid.dy)
                on = any((x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) for (t, _), ring in rings.items() for (x1, y1), (x2, y2) in sides(ring) if t == s)
                if not on:
                    assert ((s, row, col) in found) == held(rings, s, x, y)
    assert found <= cells_of(burning.burned_polygons(e, grid, all_touched=True))


def test_boxes_on_cell_borders_are_burned_alike(spark):
    """A box of whole cells covers just these, also with all that its sides touch; its quarter cells have shares."""
    e = polygons.edges(vertices(spark, {(1, 0): [(2, 3), (6, 3), (6, 5), (2, 5)]}))
    box = {(1, r, c) for r in (3, 4) for c in range(2, 6)}
    assert cells_of(burning.burned_polygons(e, Grid(9, 9))) == box
    assert cells_of(burning.burned_polygons(e, Grid(9, 9), all_touched=True)) == box | {(1, 5, c) for c in range(2, 6)} | {(1, r, 6) for r in (3, 4)}
    shares = {(r["row"], r["col"]): r["share"] for r in burning.coverage(polygons.edges(vertices(spark, {(1, 0): [(2, 3), (4.5, 3), (4.5, 3.5), (2, 3.5)]})), Grid(9, 9), 2).collect()}
    assert shares == {(3, 2): 0.5, (3, 3): 0.5, (3, 4): 0.25}


def test_lines(spark):
    """A line burns its ends and one cell for each step along its longer way; with all touched every cell that it passes."""
    line = spark.createDataFrame([(1, 0.5, 0.5, 6.5, 2.5), (2, 3.2, 8.9, 3.4, 5.1), (3, 1.0, 1.0, 1.0, 1.0), (4, -3.0, 4.5, 20.0, 4.5)], "shape long, x1 double, y1 double, x2 double, y2 double")
    thin = cells_of(burning.burned_lines(line, Grid(9, 9)))
    assert {c for c in thin if c[0] == 1} == {(1, 0, 0), (1, 0, 1), (1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 2, 5), (1, 2, 6)}
    assert {c for c in thin if c[0] == 2} == {(2, r, 3) for r in range(5, 9)} and {c for c in thin if c[0] == 4} == {(4, 4, c) for c in range(9)}
    assert {c for c in thin if c[0] == 3} == {(3, 1, 1)}
    wide = cells_of(burning.burned_lines(line, Grid(9, 9), all_touched=True))
    # The first line goes through corners of cells, which adds none.
    assert {c for c in wide if c[0] == 1} == {c for c in thin if c[0] == 1}
    slant = spark.createDataFrame([(1, 0.5, 0.5, 6.5, 2.9)], "shape long, x1 double, y1 double, x2 double, y2 double")
    assert cells_of(burning.burned_lines(slant, Grid(9, 9), all_touched=True)) == {(1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 2), (1, 1, 3), (1, 1, 4), (1, 2, 4), (1, 2, 5), (1, 2, 6)}


@pytest.mark.parametrize("distance", [0.0, 0.5, 1.7])
def test_buffers(spark, distance):
    rings = drawn_rings(6, 3)
    e, grid = polygons.edges(vertices(spark, rings)), Grid(12, 12, -0.25, 1.0, -0.25, 1.0)
    inside, near = cells_of(burning.burned_polygons(e, grid)), set()
    for (s, _), ring in rings.items():
        for (x1, y1), (x2, y2) in sides(ring):
            for row in range(12):
                for col in range(12):
                    x, y = col + 0.25, row + 0.25
                    t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2)))
                    if (x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2 <= distance**2:
                        near.add((s, row, col))
    assert cells_of(burning.burned_buffers(e, grid, distance)) == inside | near
    if distance:
        assert cells_of(burning.burned_buffers(e, grid, -distance)) == inside - near
    assert cells_of(burning.near_lines(e.withColumn("d", F.col("shape") - 1.0), grid, F.col("d")))


def test_overlaps_and_short_lines(spark):
    cells = spark.createDataFrame([(1, 1, 100, 69), (1, 1, 7, 230), (2, 2, 5, 69)], "row int, col int, cost int, kv int")
    assert {tuple(r) for r in burning.burned_values(cells, "cost", F.col("kv")).collect()} == {(1, 1, 7), (2, 2, 5)}
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 4.0)], "poi long, x double, y double")
    assert [tuple(r) for r in burning.short_lines(points, "poi").collect()] == [(1, 3.0, 4.0, 53.0, 54.0)]


@pytest.mark.parametrize("queen", [False, True])
def test_cells_to_polygons_and_back(spark, queen):
    """Polygons of cells burn the same cells; areas, holes and corners are right."""
    rng = random.Random(12)
    cells = {(r, c): rng.choice([1, 2, 2, 3]) for r in range(12) for c in range(15) if rng.random() < 0.8} | {(20, 20): 9, (22, 22): 9, (21, 21): 9}
    df = spark.createDataFrame([(r, c, v) for (r, c), v in cells.items()] + [(0, 0, cells.get((0, 0), 1)), (30, 30, None)], "row int, col int, shape long")
    if (0, 0) not in cells:
        cells[0, 0] = 1
    rings = burning.cell_polygons(df, "shape", queen=queen)
    e = polygons.edges(rings).cache()
    assert cells_of(burning.burned_polygons(e, Grid(40, 40))) == {(v, r, c) for (r, c), v in cells.items()}
    areas = polygons.ring_areas(e)
    assert {r["shape"]: r["a"] for r in areas.groupBy("shape").agg(F.sum("area").alias("a")).collect()} == {v: float(sum(x == v for x in cells.values())) for v in set(cells.values())}
    # Every side stays whole: sides are straight, and turn at each corner.
    assert e.filter("x1 != x2 AND y1 != y2").count() == 0
    nine = areas.filter("shape = 9").collect()
    assert [r["area"] for r in nine] == ([3.0] if queen else [1.0, 1.0, 1.0])
    assert burning.cell_polygons(df.limit(0), "shape").count() == 0


def test_a_ring_of_cells_has_a_hole(spark):
    ring = spark.createDataFrame([(r, c, 1) for r in range(3) for c in range(3) if (r, c) != (1, 1)], "row int, col int, shape long")
    areas = polygons.ring_areas(polygons.edges(burning.cell_polygons(ring, "shape", Grid(3, 3, 0.0, 2.0, 0.0, 2.0)))).collect()
    assert sorted(r["area"] for r in areas) == [-4.0, 36.0]


def test_pointer_jumping_on_cycles(spark):
    rng, nxt, start = random.Random(2), {}, 0
    for size in (1, 2, 3, 8, 31, 200):
        ids = list(range(start, start + size))
        rng.shuffle(ids)
        nxt |= dict(zip(ids, ids[1:] + ids[:1]))
        start += size
    found = {r["id"]: (r["ring"], r["seq"]) for r in burning.ringed(spark.createDataFrame(list(nxt.items()), "id long, next long")).collect()}
    for ring in {r for r, _ in found.values()}:
        at = ring
        for k in range(sum(r == ring for r, _ in found.values())):
            assert found[at] == (ring, k)
            at = nxt[at]
        assert at == ring


def test_counts_of_runs(spark):
    """Cells counted from the ends of runs are those of the runs' cells."""
    e, grid = polygons.edges(vertices(spark, drawn_rings(6, 3))), Grid(12, 12, -0.25, 1.0, -0.25, 1.0)
    for distance in (0.7, -0.7):
        want = {}
        for _, row, col in cells_of(burning.burned_buffers(e, grid, distance)):
            want[row, col] = want.get((row, col), 0) + 1
        assert {(r["row"], r["col"]): r["count"] for r in burning.run_counts(burning.buffer_runs(e, grid, distance)).collect()} == want


def test_exploded_edges_are_not_broadcast(spark, tmp_path):
    """A small file whose rows explode looks small to Spark."""
    spark.range(10).write.parquet(str(tmp_path / "ids"))
    v = spark.read.parquet(str(tmp_path / "ids")).select(F.col("id").alias("shape"), F.lit(0).alias("ring"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("seq")).withColumns({"x": F.col("seq") * 1.0, "y": F.col("seq") * 7 % 5 * 1.0})
    assert "Broadcast" not in polygons.crossings(polygons.edges(v))._jdf.queryExecution().executedPlan().toString()
