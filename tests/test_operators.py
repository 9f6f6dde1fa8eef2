"""Operators on small tables, against values worked out by hand or by brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.functions import costs
from siteweave.functions.spatial import project_on_segment
from siteweave.operators import allocation, cleaning, clustering, exclusion_rules, nodes, offshore, raster, relaxation, routing, spatial_joins, spur_lines, timeseries, transmission
from siteweave.session import checkpointed
from siteweave.schema import coordinate_columns, rename_absent, rename_prefixes, require, select_present
from siteweave.sources import tables
from siteweave.streaming import streams


def rows(df, *columns):
    return sorted(tuple(r[c] for c in (columns or df.columns)) for r in df.collect())


def test_schema_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "gid int, Latitude double, LON double")
    assert coordinate_columns(df) == ("Latitude", "LON")
    assert rename_absent(df, {"gid": "sc_gid", "LON": "Latitude"}).columns == ["sc_gid", "Latitude", "LON"]
    assert select_present(df, ["x", "LON"]).columns == ["LON"]
    with pytest.raises(ValueError, match="cap"):
        require(df, ["gid", "cap"])


def test_nearest_matches_brute_force(spark):
    rng = random.Random(3)
    q = [(i, rng.uniform(0, 50), rng.choice([1.0, 1.0, rng.uniform(-90, 90)])) for i in range(60)] + [(99, None, 1.0)]
    t = [(i, rng.uniform(0, 50) if i % 3 else 7.0, rng.uniform(-90, 90) if i % 3 else 1.0) for i in range(40)]
    found = spatial_joins.nearest_by_degrees(spark.createDataFrame(q, "a long, lat double, lon double"), spark.createDataFrame(t, "b long, lat double, lon double"), "a", "b", 3)
    want = []
    for i, y, x in q[:-1]:
        best = sorted((math.hypot(y - v, x - u), j) for j, v, u in t)[:3]
        want += [(i, j, n + 1) for n, (_, j) in enumerate(best)]
    assert rows(found, "a", "b", "rank") == sorted(want)


def test_nearest_in_crowded_cells(spark, monkeypatch):
    """Targets in one heap, many in one place, and queries far off, dealt out in slices; no pairs of all are formed; against brute force."""
    monkeypatch.setattr(spatial_joins, "CROWD", 40)
    rng = np.random.default_rng(5)
    q = np.concatenate([rng.uniform(-500, 500, (150, 2)), np.full((50, 2), 3.0)])
    t = np.concatenate([rng.integers(0, 9, (300, 2)).astype(float), np.full((200, 2), 3.0)])
    frame = lambda rows, name: spark.createDataFrame([(i, float(y), float(x)) for i, (y, x) in enumerate(rows)], f"{name} long, lat double, lon double")
    found = spatial_joins.nearest_by_degrees(frame(q, "a"), frame(t, "b"), "a", "b", 3)
    assert "FlatMapCoGroupsInArrow" not in found._jdf.queryExecution().toString()  # settled and kept
    far = np.sqrt((q[:, None, 0] - t[None, :, 0]) ** 2 + (q[:, None, 1] - t[None, :, 1]) ** 2)
    want = [(i, int(j), n + 1) for i in range(len(q)) for n, j in enumerate(np.lexsort((np.arange(len(t)), far[i]))[:3])]
    assert rows(found, "a", "b", "rank") == sorted(want)
    at, to, d, n = spatial_joins._nearest_of(q, t, np.arange(len(t)), 3)
    assert sorted(zip(at.tolist(), to.tolist(), n.tolist())) == sorted(want)


@pytest.mark.parametrize("queen", [True, False])
def test_patches_across_tiles(spark, monkeypatch, queen):
    """A winding patch through many tiles, in few rounds; against a search from cell to cell."""
    rng = random.Random(2)
    kind = {(r, c): "wall" if r % 2 and c != (0 if r % 4 == 1 else 19) else "way" for r in range(-7, 40) for c in range(20)}
    kind |= {(r, c + 30): rng.choice("ab") for r in range(-7, 20) for c in range(20) if rng.random() < 0.8}
    want, steps = {}, [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if (r or c) and (queen or 0 in (r, c))]
    for start in sorted(kind):
        open_ = [] if start in want else [start]
        while open_:
            at = open_.pop()
            if at not in want:
                want[at] = start
                open_ += [n for r, c in steps if kind.get(n := (at[0] + r, at[1] + c)) == kind[at]]
    seen = []
    monkeypatch.setattr(raster, "checkpointed", lambda df: seen.append(1) or checkpointed(df))
    cells = spark.createDataFrame([(*at, k) for at, k in kind.items()], "row int, col int, kind string")
    got = {(r["row"], r["col"]): tuple(r["patch"]) for r in raster.contiguous_patches(cells, queen, ("kind",), tile=8).collect()}
    assert got == want
    seen.clear()
    raster.contiguous_patches(cells, queen, ("kind",))
    assert len(seen) < 8


def test_totals_without_paths(spark):
    """Sums along the tree of paths are those of the paths, also of targets without a way and of the source itself."""
    rng = random.Random(4)
    cells = spark.createDataFrame([(r, c, rng.choice([-1.0, 1.5, rng.uniform(1, 9)]), rng.choice([None, 0.0, rng.uniform(0, 5)])) for r in range(30) for c in range(12)], "row int, col int, routing double, charged double")
    sources = spark.createDataFrame([(g, rng.randrange(30), rng.randrange(12)) for g in range(6)], "source long, row int, col int")
    targets = spark.createDataFrame([(g, t, rng.randrange(30), rng.randrange(12)) for g in range(6) for t in range(9)], "source long, target int, row int, col int").unionByName(sources.withColumn("target", F.lit(99)))
    want = routing.path_totals(routing.least_cost_paths(cells, sources, targets), cells, ["routing", "charged"])
    got = routing.least_cost_totals(cells, sources, targets, ["routing", "charged"])
    assert set(got.columns) == set(want.columns)
    rounded = lambda df: rows(df.select("source", "target", *[F.round(c, 9).alias(c) for c in sorted(set(df.columns) - {"source", "target"})]))
    assert rounded(got) == rounded(want) and len(rounded(got)) > 20


def test_points_of_a_cell_share_ways(spark, monkeypatch):
    """Each pair of cells is routed once, however many points and features stand on them, and all pairs of these come out."""
    seen, totals = [], routing.least_cost_totals
    monkeypatch.setattr(routing, "least_cost_totals", lambda cells, sources, targets, *a, **k: seen.append((sources.count(), targets.count())) or totals(cells, sources, targets, *a, **k))
    cells = spark.createDataFrame([(r, c, 1.0 + (r * 7 + c) % 5) for r in range(9) for c in range(9)], "row int, col int, cost double").withColumn("routing", F.col("cost"))
    points = spark.createDataFrame([(g, 2 + g % 2, 3) for g in range(10)], "source long, row int, col int")
    features = spark.createDataFrame([(g, "Substation", 1, 69, 500, 5 - g % 2, 4) for g in range(8)], "gid long, category string, region int, min_volts int, max_volts int, row int, col int")
    out = spur_lines.supply_point_costs(cells, points, features, "400MW", radius=5).select("source", "gid", "dist_km", "trans_cap_cost").collect()
    assert seen == [(2, 4)]
    assert {(r["source"], r["gid"]) for r in out} == {(p, f) for p in range(10) for f in range(8)} and len(out) == 80
    assert len({(r["source"] % 2, r["gid"] % 2, r["trans_cap_cost"]) for r in out}) == 4


def test_radius_candidates_form_no_pairs_of_the_radius(spark, monkeypatch):
    """Only a plant's two nearest sites are asked for to find its radius; against brute force."""
    real = spatial_joins.nearest
    monkeypatch.setattr(spatial_joins, "nearest", lambda *a, within=None, **k: pytest.fail("pairs") if within else real(*a, **k))
    rng = random.Random(6)
    plants = [(p, rng.uniform(25, 49), rng.uniform(-124, -67)) for p in range(5)] + [(99, -60.0, 100.0)]
    sites = [(g, rng.uniform(25, 49), rng.uniform(-124, -67), float(rng.randrange(20, 60))) for g in range(40)]
    km = lambda a, b: 2 * 6371 * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    want = set()
    for p in plants:
        r = 400.0
        while sum(km(p, s) <= r for s in sites) < 2:
            r *= 1.2
        best = min((s for s in sites if km(p, s) <= r), key=lambda s: (s[3], s[0]))
        want |= {(p[0], s[0], round(km(best, s), 3)) for s in sites if s[3] <= best[3] * 1.3}
    out = spatial_joins.radius_candidates(spark.createDataFrame(plants, "plant long, lat double, lon double"), spark.createDataFrame(sites, "gid long, lat double, lon double, lcoe double"), 400.0, digits=3)
    assert {tuple(r) for r in out.collect()} == want


def test_nearest_of_nothing(spark):
    none = spark.createDataFrame([], "b long, lat double, lon double")
    some = spark.createDataFrame([(1, 2.0, 3.0)], "a long, lat double, lon double")
    assert rows(spatial_joins.nearest_by_degrees(some, none, "a", "b")) == []


def test_lengths_and_bins(spark):
    km = spark.createDataFrame([(0.0,), (4.9,), (16.09344,), (40.0,)], "km double")
    assert [r[0] for r in km.select(costs.length_multiplier(F.col("km"), "step")).collect()] == [1.5, 1.2, 1.2, 1.0]
    linear = [r[0] for r in km.select(costs.length_multiplier(F.col("km"))).collect()]
    assert linear[0] > 1.5 and linear[2] == 1.0 and linear[3] == 1.0
    with pytest.raises(ValueError):
        costs.length_multiplier(F.col("km"), "cubic")
    assert raster.check_bins([(0, 5, 1.0), (4, 8, 2.0), (9, 10, 1.0)]) == ["bins overlap at 4", "no bin from 8 to 9"]
    with pytest.raises(ValueError):
        raster.check_bins([(5, 1, 1.0)])


def test_connection_costs(spark):
    df = spark.createDataFrame([("Substation", 2, 138, 230), ("TransLine", 3, 345, 345), ("TransLine", 3, 69, 69), ("PCALoadCen", 1, 500, 500), ("LoadCen", 1, 500, 500)], "category string, region int, min_volts int, max_volts int")
    out = [r["connection_cost"] for r in transmission.connection_costs(df, "400MW").collect()]
    assert out == [3975000.0, 6100.0 * 400 + 9700000.0, 9700000.0, 1e11, 5500000.0]


def test_segment_projection(spark):
    x, y = project_on_segment(*[F.lit(float(v)) for v in (2, 2, 0, 0, 4, 0)])
    assert spark.range(1).select(x, y).first()[:] == (2.0, 0.0)


def test_least_cost_paths_and_totals(spark):
    wall = {(r, 2) for r in range(4)}
    cells = spark.createDataFrame([(r, c, -1.0 if (r, c) in wall else 1.0) for r in range(5) for c in range(5)], "row int, col int, routing double")
    sources = spark.createDataFrame([("a", 0, 0)], "source string, row int, col int")
    targets = spark.createDataFrame([("a", "t", 0, 4), ("a", "wall", 1, 2)], "source string, target string, row int, col int")
    paths = routing.least_cost_paths(cells, sources, targets, 1.5)
    assert rows(paths.filter("step is null"), "target") == [("wall",)]
    end = paths.filter("target = 't'").orderBy(F.desc("step")).first()
    relaxed = relaxation.relaxed_costs(cells, sources)
    assert end["cumulative"] == pytest.approx(relaxed.filter("row = 0 and col = 4").first()["best"])
    total = routing.path_totals(paths.filter("target = 't'"), cells, ["routing"], cell_km=1.0).first()
    assert total["dist_km"] == pytest.approx(end["cumulative"]) and total["cost"] == pytest.approx(end["cumulative"])


def test_patches(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (5, 5)], "row int, col int")
    assert rows(raster.large_patches(cells, 3)) == [(0, 0), (0, 1), (1, 2)]
    assert rows(raster.large_patches(cells, 2, queen=False)) == [(0, 0), (0, 1)]


def test_greedy_rounds(spark):
    plants = spark.createDataFrame([(1, 5.0), (2, 4.0)], "plant long, capacity double")
    sites = spark.createDataFrame([(10, 6.0), (11, 2.0)], "gid long, capacity double")
    near = spark.createDataFrame([(1, 10, 1.0, 0.0), (2, 10, 2.0, 0.0), (1, 11, 3.0, 0.0), (2, 11, 3.0, 0.0)], "plant long, gid long, distance double, bus_distance double")
    builds, short = allocation.greedy_rounds(plants, sites, near)
    assert rows(builds) == [(1, 10, 5.0), (2, 10, 1.0), (2, 11, 2.0)]
    assert rows(short) == [(2, 1.0)]


@pytest.mark.parametrize("share", [True, False])
def test_resources_of_points(spark, share):
    """Each point's resources largest first; without sharing a resource is closed in all points that list it; against brute force."""
    rng = random.Random(7)
    plants = [(rng.choice("mn"), p, 50 - p, rng.uniform(0, 5), rng.uniform(0, 5), rng.choice([1.0, 4.0, 30.0])) for p in range(15)]
    points = {g: (rng.choice("mn"), float(rng.randrange(5)), float(rng.randrange(5))) for g in range(20)}
    held = {(g, (0 if points[g][0] == "m" else 100) + rng.randrange(25)): rng.choice([1.0, 2.0, 2.0, 5.0]) for g in points for _ in range(3)}
    left, closed, want = dict(held), set(), {}
    whole = lambda g: sum(c for (h, _), c in held.items() if h == g)
    for m, p, _, y, x, wanted in sorted(plants, key=lambda r: r[2]):
        for g in sorted((g for g in points if points[g][0] == m), key=lambda g: (math.sqrt((y - points[g][1]) ** 2 + (x - points[g][2]) ** 2), -whole(g), g)):
            for r in sorted((r for h, r in held if h == g), key=lambda r: (-left[g, r], r)):
                built = 0.0 if r in closed and not share else min(wanted, left[g, r])
                if built > 1e-12:
                    want[p, g, r] = built
                    left[g, r] -= built
                    closed.add(r)
                    wanted -= built
    of = spark.createDataFrame(plants, "market string, plant long, place int, lat double, lon double, wanted double")
    rows_ = [(*points[g][:1], g, *points[g][1:], r, c) for (g, r), c in held.items()]
    out = allocation.sequential_resource_builds(of, spark.createDataFrame(rows_, "market string, gid long, lat double, lon double, res_gid long, capacity double"), share=share, k=2)
    assert {(r["plant"], r["gid"], r["res_gid"]): round(r["built"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_final_plants_leave_the_rounds(spark, monkeypatch):
    """A chain of plants that push each other on: each round holds only what isn't final."""
    n = 5
    plants = spark.createDataFrame([(p, p, 1.0) for p in range(n)], "plant long, place int, wanted double")
    candidates = spark.createDataFrame([(p, g, g + 1, 1.0) for p in range(n) for g in range(n)], "plant long, gid long, turn int, capacity double")
    sizes = []
    monkeypatch.setattr(allocation, "checkpointed", lambda df: (kept := checkpointed(df), sizes.append(kept.count()) if kept.columns[-1] == "built" else None)[0])
    out = allocation.served_in_order(plants, candidates)
    assert rows(out, "plant", "gid", "built") == [(p, p, 1.0) for p in range(n)]
    assert sizes[0] == n * n and sizes == sorted(sizes, reverse=True) and sum(sizes) < 0.7 * n * n * len(sizes)


@pytest.mark.parametrize("k", [1, 64])
def test_greedy_builds_reach_every_site(spark, k):
    """The rounds go on through all sites of a market, however few a plant knows at first; sites at one distance included."""
    rng = random.Random(3)
    plants = [(rng.choice("mn"), p, float(rng.randrange(4)), float(rng.randrange(4)), rng.choice([3.0, 9.0, 200.0])) for p in range(12)] + [("lone", 99, 1.0, 1.0, 5.0), ("m", 98, None, 1.0, 5.0)]
    sites = [(rng.choice("mn"), g, float(rng.randrange(4)), float(rng.randrange(4)), rng.choice([2.0, 7.0])) for g in range(14)]
    free, wanted, want = {s[1]: s[4] for s in sites}, {p[1]: p[4] for p in plants}, {}
    turns = {p[1]: sorted((round(math.dist(p[2:4], s[2:4]), 6), s[1]) for s in sites if s[0] == p[0]) for p in plants if p[2] is not None}
    for turn in range(14):
        asking = {}
        for p, near in turns.items():
            if turn < len(near) and wanted[p] > 1e-9:
                asking.setdefault(near[turn][1], []).append((near[turn][0], p))
        for g, who in asking.items():
            for _, p in sorted(who):
                built = min(wanted[p], free[g])
                if built > 0:
                    want[p, g] = built
                    free[g] -= built
                    wanted[p] -= built
    of = spark.createDataFrame(plants, "market string, plant long, lat double, lon double, capacity double")
    builds, short = allocation.greedy_builds(of, spark.createDataFrame(sites, "market string, gid long, lat double, lon double, capacity double"), k=k)
    assert {(r["plant"], r["gid"]): r["built"] for r in builds.collect()} == want
    assert {r["plant"]: r["short"] for r in short.collect()} == {p: w for p, w in wanted.items() if w > 1e-9}


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("share", [True, False])
def test_sequential_builds(spark, share, small):
    """In order of place, each plant fills its nearest sites with what those before it left; against brute force."""
    rng = random.Random(5)
    plants = [(rng.choice("mn"), p, 100 - p, rng.uniform(0, 5), rng.uniform(0, 5), rng.choice([1.0, 4.0, 9.0])) for p in range(40)]
    sites = [(rng.choice("mn"), g, float(rng.randrange(5)), float(rng.randrange(5)), rng.choice([2.0, 6.0])) for g in range(30)]
    free, want = {s[1]: s[4] for s in sites}, {}
    for m, p, _, y, x, wanted in sorted(plants, key=lambda r: r[2]):
        for _, g, v, u, c in sorted((s for s in sites if s[0] == m), key=lambda s: (math.sqrt((y - s[2]) ** 2 + (x - s[3]) ** 2), -s[4], s[1])):
            built = min(wanted, free[g])
            if built > 1e-12:
                want[p, g] = built
                free[g] = free[g] - built if share else 0.0
                wanted -= built
    of = spark.createDataFrame(plants, "market string, plant long, place int, lat double, lon double, wanted double")
    out = allocation.sequential_builds(of, spark.createDataFrame(sites, "market string, gid long, lat double, lon double, capacity double"), share=share, k=2, small=small)
    assert {(r["plant"], r["gid"]): round(r["built"], 9) for r in out.collect()} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("small", [0, 10**6])
@pytest.mark.parametrize("seed", range(3))
def test_unshared_resources_in_a_task_and_in_rounds(spark, small, seed):
    """Resources that several points list and many starving plants; against brute force."""
    rng = random.Random(seed)
    plants = [(rng.choice("mn"), p, rng.randrange(10**6), rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice([1.0, 4.0, 30.0])) for p in range(40)]
    points = {g: (rng.choice("mn"), float(rng.randrange(5)), float(rng.randrange(5))) for g in range(12)}
    rows_ = [(*points[g][:1], g, *points[g][1:], r, rng.choice([0.0, 1.0, 2.0, 5.0])) for g in points for r in {(0 if points[g][0] == "m" else 100) + rng.randrange(9) for _ in range(3)}]
    whole, closed, want = {g: sum(r[5] for r in rows_ if r[1] == g) for g in points}, set(), {}
    for m, p, _, y, x, wanted in sorted(plants, key=lambda r: r[2]):
        used = set()
        for _, g, _, _, r, c in sorted((r for r in rows_ if r[0] == m), key=lambda r: (math.sqrt((y - r[2]) ** 2 + (x - r[3]) ** 2), -whole[r[1]], r[1], -r[5], r[4])):
            built = 0.0 if r in closed or r in used else min(wanted, c)
            used.add(r)
            if built > 0:
                want[p, g, r] = built
                closed.add(r)
                wanted -= built
    of = spark.createDataFrame(plants, "market string, plant long, place int, lat double, lon double, wanted double")
    out = allocation.sequential_resource_builds(of, spark.createDataFrame(rows_, "market string, gid long, lat double, lon double, res_gid long, capacity double"), share=False, k=2, small=small)
    assert {(r["plant"], r["gid"], r["res_gid"]): r["built"] for r in out.collect()} == want


def test_large_markets_take_no_rounds(spark, monkeypatch):
    """A market whose pairs are many, but whose rows aren't, is served by a task, at places near and far; against brute force."""
    rng = np.random.default_rng(8)
    sites = [("m", g, float(y), float(x), float(c)) for g, (y, x, c) in enumerate(zip(rng.integers(0, 60, 5000) / 2, rng.integers(0, 60, 5000) / 2, rng.choice([2.0, 6.0], 5000)))]
    plants = [("m", p, p, float(y), float(x), 9.0) for p, (y, x) in enumerate(zip(rng.uniform(-40, 70, 4500), rng.uniform(-40, 70, 4500)))]
    monkeypatch.setattr(allocation, "served_in_order", lambda *a: pytest.fail("rounds"))
    of = spark.createDataFrame(plants, "market string, plant long, place int, lat double, lon double, wanted double")
    out = allocation.sequential_builds(of, spark.createDataFrame(sites, "market string, gid long, lat double, lon double, capacity double"))
    got = {(r["plant"], r["gid"]): r["built"] for r in out.collect()}
    gid, y, x, size = (np.array([s[i] for s in sites]) for i in (1, 2, 3, 4))
    free, want = size.copy(), {}
    for _, p, _, v, u, wanted in plants:
        some = np.flatnonzero(free > 0)
        for i in some[np.lexsort((gid[some], -size[some], np.sqrt((v - y[some]) * (v - y[some]) + (u - x[some]) * (u - x[some]))))]:
            if wanted <= 0:
                break
            want[p, gid[i]] = built = min(wanted, free[i])
            free[i] -= built
            wanted -= built
    assert got == want


def test_greedy_round_query_against_brute_force(spark):
    from siteweave.plans.registry import PLANTS, QUERIES, SITES

    where = "/root/testdata/sf0.001"
    plants, sites = PLANTS.df(spark, where).collect(), SITES.df(spark, where).collect()
    turns = {}
    for p in plants:
        near = sorted((math.sqrt((p["lat"] - s["lat"]) ** 2 + (p["lon"] - s["lon"]) ** 2), s["gid"]) for s in sites if s["nation"] == p["nation"])
        turns[p["plant"]] = sorted((round(d, 6), g) for d, g in near)
    wanted, free, want = {p["plant"]: p["capacity"] / 50 for p in plants}, {s["gid"]: s["capacity"] for s in sites}, {}
    for turn in range(max(map(len, turns.values()))):
        asking = {}
        for p, near in turns.items():
            if turn < len(near) and wanted[p] > 1e-9:
                asking.setdefault(near[turn][1], []).append((near[turn][0], p))
        for g, who in asking.items():
            for _, p in sorted(who):
                built = min(wanted[p], free[g])
                if built > 0:
                    want[p, g] = round(built, 6)
                    free[g] -= built
                    wanted[p] -= built
    got = {(r["plant"], r["gid"]): r["built"] for r in QUERIES["greedy_round_allocation"](spark, where).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got) and got


def test_tiles_of_any_size_give_the_same_costs(spark):
    """Borders travel between tiles until no cell improves; against one window that holds all."""
    rng = np.random.default_rng(4)
    cost = np.where(rng.random((23, 31)) < 0.25, -1.0, rng.integers(1, 9, (23, 31)).astype(float))
    cost[3, 4] = 2.0
    cells = spark.createDataFrame([(r, c, float(cost[r, c])) for r in range(23) for c in range(31)], "row int, col int, routing double")
    want = routing.least_costs(cost, (3, 4))
    # Edge by edge: no neighbour offers less than a cell has.
    for r in range(23):
        for c in range(31):
            if cost[r, c] > 0 and (r, c) != (3, 4):
                offers = [want[r + y, c + x] + (cost[r, c] + cost[r + y, c + x]) / 2 * n for y, x, n in routing.STEPS if 0 <= r + y < 23 and 0 <= c + x < 31 and cost[r + y, c + x] > 0]
                assert want[r, c] == pytest.approx(min(offers, default=np.inf))
    for tile in (5, 64):
        got = {(r["row"], r["col"]): r["best"] for r in relaxation.relaxed_costs(cells, spark.createDataFrame([(3, 4)], "row int, col int"), tile=tile).collect()}
        assert len(got) == (cost > 0).sum() and all(want[k] == pytest.approx(v) if v is not None else np.isinf(want[k]) for k, v in got.items())


def test_a_line_is_reached_at_its_cheapest_cell(spark):
    cells = spark.createDataFrame([(0, c, 1.0 + c) for c in range(6)], "row int, col int, routing double")
    source = spark.createDataFrame([("s", 0, 2)], "source string, row int, col int")
    line = spark.createDataFrame([("s", "line", 0, 0), ("s", "line", 0, 4), ("s", "line", 0, 5)], "source string, target string, row int, col int")
    assert rows(routing.least_cost_paths(cells, source, line, 2.0), "step", "row", "col") == [(0, 0, 2), (1, 0, 1), (2, 0, 0)]


def test_features_within_growing_circles(spark):
    windows = spark.createDataFrame([(1, 0, 0, 1), (2, 50, 50, 3)], "source int, row int, col int, radius int")
    features = spark.createDataFrame([(7, 0, 1), (8, 50, 40), (9, 0, 30)], "gid int, row int, col int")
    wide, met = spur_lines.features_within(windows, features)
    assert rows(met, "source", "gid") == [(1, 7), (2, 8)] and wide.filter("source = 2").first()["radius"] >= 10


def test_circles_end_and_nulls_take_no_part(spark):
    """Circles grow until they hold a feature, even far away; points and features without a place are left out."""
    windows = spark.createDataFrame([(1, 0, 0, 1), (2, None, 5, 3), (3, 2, 2, 1)], "source int, row int, col int, radius int")
    features = spark.createDataFrame([(7, 300, 400), (8, None, 4), (9, 4, None)], "gid int, row int, col int")
    wide, met = spur_lines.features_within(windows, features)
    assert rows(met, "source", "gid") == [(1, 7), (3, 7)] and {r["source"]: r["radius"] for r in wide.collect()}.keys() == {1, 3}
    assert all(500 <= r["radius"] <= 502 for r in wide.filter("source = 1").collect())
    wide, met = spur_lines.features_within(windows, features.filter("gid > 7"))
    assert met.count() == 0 and rows(wide, "source", "radius") == [(1, 1), (3, 1)]
    wide, met = spur_lines.features_within(windows.filter("source = 2"), features)
    assert met.count() == 0 and wide.count() == 0


def test_regional_costs_stay_in_the_zone(spark):
    cells = spark.createDataFrame([(r, c, 1.0, 1.0) for r in range(6) for c in range(6)], "row int, col int, routing double, cost double")
    points = spark.createDataFrame([(1, 0, 0, "a"), (2, 5, 5, "b")], "source int, row int, col int, zone string")
    features = spark.createDataFrame([(7, 0, 3, "a", "Substation", 2, 500, 500), (8, 5, 1, "b", "Substation", 2, 500, 500), (9, 1, 1, "a", None, 2, 69, 69)], "gid int, row int, col int, zone string, category string, region int, min_volts int, max_volts int")
    out = spur_lines.regional_costs(cells, points, features, "400MW", cell_km=10.0)
    assert rows(out, "source", "gid", "dist_km", "xformer_cost") == [(1, 7, 30.0, 0.0), (2, 8, 40.0, 0.0)]
    assert all(r["trans_cap_cost"] == pytest.approx(r["tie_line_cost"] + 3975000) for r in out.collect())


def test_substations_and_totals(spark):
    substations = spark.createDataFrame([(1, 1.0, 1.0, [5, 6]), (2, 9.0, 9.0, [5])], "gid int, lat double, lon double, trans_gids array<int>")
    lines = spark.createDataFrame([(5, 50), (6, 230)], "gid int, voltage int")
    regions = spark.createDataFrame([("r", 0.0, 0.0, 2.0, 2.0)], "region string, minx double, miny double, maxx double, maxy double")
    assert rows(spur_lines.substations_in_regions(substations, lines, regions), "gid", "region", "max_volts") == [(1, "r", 230)]
    totals = spark.createDataFrame([(1, 3.0, 1.0, 2.0), (2, 3.0, 1.0, 1.0)], "source int, cost double, a_cost double, b_cost double")
    assert rows(spur_lines.disagreeing_totals(totals, ["a", "b"]), "source") == [(2,)]


def test_clustering_pipeline_gives_touching_ranked_clusters(spark):
    from siteweave.plans.registry import QUERIES

    out = QUERIES["clustering_pipeline"](spark, "/root/testdata/sf0.001").collect()
    gids = [r["gid"] for r in out]
    assert len(gids) == len(set(gids)) and {r["cluster"].split("-")[0] for r in out} == {"even", "odd"}
    for c in {r["cluster"] for r in out}:
        mine = sorted((r["rank"], r["rmse"]) for r in out if r["cluster"] == c)
        assert [k for k, _ in mine] == list(range(len(mine))) and all(a[1] <= b[1] + 1e-9 for a, b in zip(mine, mine[1:]))


def test_settled_assignment_ends(spark):
    sites = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(30)], "gid long, lat double, lon double")
    coefficients = spark.createDataFrame([(i, k, float((i * (k + 3)) % 5)) for i in range(30) for k in range(4)], "gid long, idx int, value double")
    out = clustering.settled_assignment(sites, coefficients, spark.createDataFrame([(i, i % 3) for i in range(30)], "gid long, cluster int"))
    again = clustering.reassigned(sites, coefficients, out)
    assert out.count() == 30 and again.count() == 30


def test_nodes_and_offshore_helpers(spark):
    with pytest.raises(ValueError, match="lost"):
        nodes.reassigned_capacity(spark.createDataFrame([(1, 1.0, 1.0, 5.0)], "sc_gid int, lat double, lon double, capacity double"), spark.createDataFrame([(1,)], "sc_gid int"))
    with pytest.raises(ValueError, match="repeats"):
        nodes.one_to_one(spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1,)], "k int"), "k")
    with pytest.raises(ValueError, match="a_1"):
        offshore.port_names(spark.createDataFrame([("a", 1), ("a", 1)], "n string, s int"), ["n", "s"])
    df = spark.createDataFrame([(-5.0, 1500.0, 0.0), (3.0, 10.0, 1.5), (2.0, 0.0, 0.5)], "d double, m double, t double")
    assert rows(offshore.clamped(df, "d", ("m",), "t")) == [(2.0, 0.0, 0.5), (3.0, 0.01, 0.99), (5.0, 1.5, 0.01)]
    places = spark.createDataFrame([(1, 0.0, 0.0)], "gid int, lat double, lon double")
    points = spark.createDataFrame([(4, 1.0, 0.0, 0.9), (5, 3.0, 0.0, 0.8)], "point int, lat double, lon double, aeff double")
    assert rows(offshore.array_efficiency(places, points)) == [(1, 0.9)]


def test_rules_as_data(spark):
    assert exclusion_rules.validated_multipliers(["a", "b"], {"a": "high", "b": 2.0}) == {"a": 3.0, "b": 2.0}
    assert exclusion_rules.validated_multipliers(["a"], "moderate") == {"a": 1.1}
    with pytest.raises(ValueError, match="without"):
        exclusion_rules.validated_multipliers(["a"], {"b": 1.0})
    box = spark.createDataFrame([(0, 0, 4, 4)], "r1 int, c1 int, r2 int, c2 int")
    assert exclusion_rules.inner_ring(box, 1).count() == 16 and exclusion_rules.inner_ring(box, 9).count() == 25 and exclusion_rules.grown(box, 1).count() == 49
    mask = spark.createDataFrame([(0,), (1,)], "v int")
    assert exclusion_rules.checked_mask(mask, "v").count() == 2
    with pytest.raises(ValueError, match="not a mask"):
        exclusion_rules.checked_mask(mask.filter("v = 1"), "v")
    kinds = spark.createDataFrame([("Shadow-Flicker", 1), ("Roads", 2)], "k string, i int")
    assert rows(kinds.filter(exclusion_rules.flicker_mask(F.col("k"))), "i") == [(1,)]


def test_writers_and_discovery(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0)], "gid int, scenario string, value double").withColumn("ts", F.lit("2012-01-01").cast("timestamp"))
    tables.write_profiles(df, str(tmp_path / "p"), ["scenario"])
    assert rows(spark.read.parquet(str(tmp_path / "p")), "gid", "scenario") == [(1, "a")]
    tables.write_statistics(df.drop("ts"), str(tmp_path / "year_2012.csv"))
    assert [r[0] for r in tables.files_of_year(spark, str(tmp_path), 2012).select("path").collect()] != []
    with pytest.raises(ValueError):
        tables.write_statistics(df, str(tmp_path / "x"), "xls")
    tables.write_layer(tables.dense_grid(spark, 2, 2).withColumn("v", F.lit(1)), "v", str(tmp_path / "stack"))
    assert tables.layers_of(spark, str(tmp_path / "stack")) == ["v"]
    stream = streams.profile_stream(spark, str(tmp_path / "p" / "scenario=a"), "gid int, value double, ts timestamp")
    streams.write_parquet(stream, str(tmp_path / "out"), str(tmp_path / "progress")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    assert rename_prefixes(spark.createDataFrame([(1, 2, 3)], "capacity int, mean_cf int, gid int"), {"cap": "pv_cap", "mean": "pv_res_gid"}).columns == ["pv_cap", "pv_res_gid", "gid"]


def test_drawn_counts_are_rounded_up(spark):
    df = spark.createDataFrame([(1, 4.0, 8), (2, 4.0, 8)], "gid int, capacity double, count int").withColumn("wanted", F.lit(5.0)).withColumn("k", F.lit(1))
    assert rows(allocation.drawn(df, ["k"], "wanted", [F.col("gid")]), "gid", "used", "n_used") == [(1, 4.0, 8), (2, 1.0, 2)]


def test_haar_of_two_levels(spark):
    df = spark.createDataFrame([([4.0, 2.0, 5.0, 5.0],)], "v array<double>")
    assert clustering.haar_coefficients(df, "v", 2).first()["coefficients"] == [8, -2, 1, 0]


def test_renumbered_clusters(spark):
    df = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 3), (5, 9), (6, 9)], "gid long, k int")
    assert rows(clustering.renumbered(df, "gid", "k")) == [(1, 2), (2, 2), (3, 2), (4, 0), (5, 1), (6, 1)]


def test_unique_names_and_disagreement(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, n string")
    assert rows(cleaning.unique_names(df, "n", [F.col("i")])) == [(1, "a 0"), (2, "a 1"), (3, "b")]
    other = spark.createDataFrame([(1, 1.0), (2, 5.0)], "i int, lat double")
    assert rows(cleaning.disagreeing(other, spark.createDataFrame([(1, 1.4), (2, 4.0)], "i int, lat double"), "i", ["lat"])) == [(2,)]


def test_capacity_mix_and_user_statistics(spark):
    pairs = spark.createDataFrame([(1, 1.0, 3.0), (1, 2.0, 5.0)], "gid int, solar double, wind double")
    caps = spark.createDataFrame([(1, 1.0, 3.0)], "gid int, cap_a double, cap_b double")
    assert [r["mix"] for r in timeseries.capacity_mix(pairs, caps).orderBy("mix").collect()] == [2.5, 4.25]
    out = timeseries.with_statistics(pairs, ["gid"], {"gap": lambda a, b: F.max(b - a)})
    assert rows(out) == [(1, 3.0)]


def test_sources(spark, tmp_path):
    spark.createDataFrame([(1, "[1, 2]", "[0.5, 1.5]", 0), (2, "[3]", "[2]", 1)], "sc_gid int, res_gids string, gid_counts string, offshore int").coalesce(1).write.csv(str(tmp_path / "a.csv"), header=True)
    sc = tables.supply_curve(tables.read_table(spark, str(tmp_path / "a.csv"), ["sc_gid"]))
    assert rows(sc, "sc_gid", "res_gids", "gid_counts") == [(1, [1, 2], [0.5, 1.5])]
    grid = tables.dense_grid(spark, 3, 4).withColumn("v", F.col("gid") * 2)
    tables.write_layer(grid, "v", str(tmp_path / "stack"))
    assert rows(tables.read_layers(spark, str(tmp_path / "stack"), ["v"])) == rows(grid, "row", "col", "v")
    assert tables.same_profile({"height": 2, "transform": [0, 1]}, {"height": 3, "transform": [0.5, 1]}) == ["height", "transform"]
    wide = spark.createDataFrame([(1, 2, 3)], "`cf-2012` int, `cf-2013` int, gid int")
    assert tables.one_year(wide, 2012).columns == ["cf", "gid"]


def test_streams_match_batches(spark, tmp_path):
    profiles = spark.range(200).select((F.col("id") % 3).alias("gid"), F.timestamp_seconds(F.col("id") * 900).alias("ts"), F.col("id").cast("double").alias("value"))
    profiles.write.parquet(str(tmp_path / "in"))
    stream = streams.profile_stream(spark, str(tmp_path / "in"), "gid long, ts timestamp, value double")
    query = streams.resample_stream(stream).writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert rows(spark.table("hours")) == rows(timeseries.resample(profiles, "1 hour"))


def test_tau_b_by_sorting():
    """All pairs against brute force, with ties."""
    rng = random.Random(1)
    sign = lambda x: (x > 0) - (x < 0)
    for n in (0, 1, 2, 3, 40, 101):
        a, b = ([float(rng.randrange(9)) for _ in range(n)] for _ in "ab")
        signs = [(sign(a[i] - a[j]), sign(b[i] - b[j])) for i in range(n) for j in range(i)]
        under = math.sqrt(sum(abs(x) for x, _ in signs)) * math.sqrt(sum(abs(y) for _, y in signs))
        want = sum(x * y for x, y in signs) / under if under else None
        got = timeseries.tau_b(np.array(a), np.array(b))
        assert got == want or got == pytest.approx(want)
    ranks = np.array([rng.randrange(50) for _ in range(300)])
    assert timeseries.inversions(ranks) == sum(int(ranks[i] > ranks[j]) for j in range(300) for i in range(j))


def test_paths_over_a_whole_raster(spark):
    """Paths of all ends at once, over tiles of any size: they end at a source, step between neighbours, and cost what the cell's cost says."""
    rng = np.random.default_rng(9)
    cost = np.where(rng.random((26, 34)) < 0.3, -1.0, rng.integers(1, 9, (26, 34)).astype(float))
    cost[3, 4] = cost[20, 30] = 2.0
    cost[10:13, 10:13] = -1.0
    cost[11, 11] = 1.0  # shut in
    cells = spark.createDataFrame([(r, c, float(cost[r, c]) if (r, c) != (0, 0) else None) for r in range(26) for c in range(34)], "row int, col int, routing double")
    cost[0, 0] = -1.0
    sources = spark.createDataFrame([(3, 4), (20, 30), (20, 30)], "row int, col int")
    best = np.minimum(routing.least_costs(cost, (3, 4)), routing.least_costs(cost, (20, 30)))
    places = [(f"p{r}-{c}", r, c) for r in range(0, 26, 3) for c in range(0, 34, 2)] + [("source", 3, 4), ("shut", 11, 11), ("none", None, 3), ("outside", 99, 99), ("again", 0, 2)]
    ends = spark.createDataFrame(places, "path string, row int, col int")
    for tile in (5, 16, 64):
        found = {}
        for r in relaxation.whole_raster_paths(cells, sources, ends, tile=tile).orderBy("path", "step").collect():
            found.setdefault(r["path"], []).append((r["step"], r["row"], r["col"]))
        for name, row, col in places:
            if row is None or row > 25 or not np.isfinite(best[row, col]) or cost[row, col] <= 0:
                assert name not in found
                continue
            steps = found[name]
            assert [s for s, _, _ in steps] == list(range(len(steps))) and steps[0][1:] == (row, col) and steps[-1][1:] in ((3, 4), (20, 30))
            paid = 0.0
            for (_, a, b), (_, c, d) in zip(steps, steps[1:]):
                assert max(abs(a - c), abs(b - d)) == 1
                paid += (cost[a, b] + cost[c, d]) / 2 * math.hypot(a - c, b - d)
            assert paid == pytest.approx(best[row, col])
    assert relaxation.whole_raster_paths(cells, sources.limit(0), ends).count() == 0
    assert relaxation.whole_raster_paths(cells.limit(0), sources, ends).count() == 0


def test_only_active_tiles_are_written(spark, monkeypatch):
    """A corridor of tiles beside many that nothing reaches: rounds write the corridor's tiles alone."""
    cells = spark.createDataFrame([(r, c, 1.0 if r < 4 else -1.0) for r in range(16) for c in range(24)], "row int, col int, routing double")
    written = []
    monkeypatch.setattr(relaxation, "checkpointed", lambda df: written.append(kept := checkpointed(df)) or kept)
    relaxation.relaxed_tiles(cells, spark.createDataFrame([(0, 0)], "row int, col int"), tile=4)
    rounds = [w.count() for w in written if w.columns == ["ty", "tx", "costs", "best", "round"]]
    # All 24 tiles first, then one tile of the corridor in each round, none in the last; in between and at the end changes are put together.
    assert [n for n in rounds if n < 24] == [1, 1, 1, 1, 1, 0]
