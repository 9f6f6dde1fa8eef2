"""Queries on cell tables: layers, masks, setbacks, zones."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteweave.operators import raster
from siteweave.plans.registry import CELLS, ORDERS, SITES, View, query
from siteweave.sources.tables import dense_grid

#: Features on the raster: one for each supplier.
FEATURES = View("supplier", {"row": "CAST(s_suppkey * 17 % 400 AS INT)", "col": "CAST(s_suppkey * 29 % 50 AS INT)", "fips": "CAST(floor((s_suppkey * 17 % 400) / 1e1) AS INT)"})
NEAR = "pow(c.row - f.row, 2) + pow(c.col - f.col, 2) <= {d} * {d}"


@query("SELECT fips, round(sum(fraction), 6) AS included, CAST(sum(ceil(fraction)) AS BIGINT) AS n_included, count(*) AS n_cells, round(avg(fraction), 6) AS fraction FROM {cells} GROUP BY fips", cells=CELLS)
def zonal_stats(cells):
    return raster.zonal(cells, "fips", "fraction").withColumn("included", F.round("included", 6)).withColumn("fraction", F.round("fraction", 6))


@query("SELECT size, CAST(floor(avg(row)) AS INTEGER) AS row, CAST(floor(avg(col)) AS INTEGER) AS col FROM {cells} GROUP BY size", cells=CELLS)
def label_centroid(cells):
    return raster.label_centres(cells, "size")


@query("SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(sum(price), 4) AS price FROM {cells} GROUP BY row // 4, col // 4", cells=CELLS)
def block_aggregate(cells):
    return raster.downsample(cells, "price", 4).withColumn("price", F.round("price", 4))


@query("SELECT row, col, max(value) AS value FROM (SELECT row, col, size * 1e0 AS value FROM {cells} UNION ALL SELECT row, col, slope * 5 FROM {cells} UNION ALL SELECT row, col, land * 1e0 FROM {cells}) GROUP BY row, col", cells=CELLS)
def raster_reduce_max(cells):
    layers = [cells.select("row", "col", e.cast("double").alias("value")) for e in (F.col("size"), F.col("slope") * 5, F.col("land"))]
    return raster.reduce_layers(layers)


@query("SELECT row, col, least(price, 1200e0) AS value FROM {cells}", cells=CELLS)
def raster_reduce_min(cells):
    return raster.reduce_layers([cells.select("row", "col", F.col("price").alias("value")), cells.select("row", "col", F.lit(1200.0).alias("value"))], "min")


@query("""
WITH m AS (SELECT * FROM (VALUES (1, 1, 2.25e0, 1.3e0, 1.59e0, 1.2e0, 1.4e0, 1.75e0), (2, 1, 3e0, 2e0, 3e0, 2e0, 1.5e0, 2e0), (3, 1.03e0, 1.2e0, 1.08e0, 1.2e0, 1.8e0, 1.1e0, 1.21e0), (4, 1, 1.47e0, 1.75e0, 1.12e0, 1.33e0, 1.2e0, 1.6e0)) t(region, cropland, forest, suburban, urban, wetland, hill, mountain)),
c AS (SELECT * FROM (VALUES (1, 3052857), (2, 4777000), (3, 2787303), (4, 4056410)) t(region, per_mile))
SELECT row, col, round(CASE WHEN use_code = 11 THEN 10e0 ELSE
    coalesce(CASE WHEN use_code IN (80, 81) THEN cropland WHEN use_code IN (41, 42, 43) THEN forest WHEN use_code IN (21, 22, 23) THEN suburban WHEN use_code = 24 THEN urban WHEN use_code IN (90, 95) THEN wetland ELSE 1 END, 1)
    * coalesce(CASE WHEN slope >= 8 THEN mountain WHEN slope >= 2 THEN hill ELSE 1 END, 1) END, 6) AS multiplier,
    round(per_mile / 1609.344e0 * 90 * CASE WHEN use_code = 11 THEN 10e0 ELSE
    coalesce(CASE WHEN use_code IN (80, 81) THEN cropland WHEN use_code IN (41, 42, 43) THEN forest WHEN use_code IN (21, 22, 23) THEN suburban WHEN use_code = 24 THEN urban WHEN use_code IN (90, 95) THEN wetland ELSE 1 END, 1)
    * coalesce(CASE WHEN slope >= 8 THEN mountain WHEN slope >= 2 THEN hill ELSE 1 END, 1) END, 3) AS cost
FROM {cells} LEFT JOIN m USING (region) LEFT JOIN c USING (region)
""", cells=CELLS)
def dry_cost_multiplier(cells):
    out = raster.dry_costs(raster.dry_multipliers(cells, "region", "use_code", "slope", "multiplier"), 1500, "region", "multiplier", "cost")
    return out.select("row", "col", F.round("multiplier", 6).alias("multiplier"), F.round("cost", 3).alias("cost"))


@query("""
SELECT row, col, round(CASE WHEN land > 7 THEN 0e0 ELSE (CASE WHEN land > 2 THEN 5e0 ELSE 0e0 END) + (CASE WHEN size >= 1 AND size < 25 THEN 10e0 ELSE 0e0 END) + (CASE WHEN size >= 25 AND size < 60 THEN 20e0 ELSE 0e0 END)
    + (CASE region WHEN 1 THEN 7e0 WHEN 2 THEN 9e0 ELSE 0e0 END) END / 1609.344e0 * 90, 9) AS cost FROM {cells}
""", cells=CELLS)
def layer_build_forced_inclusion(cells):
    everywhere = F.lit(True)
    parts = [
        raster.component(F.col("land") > 2, global_value=5.0),
        raster.component(everywhere, bins=(F.col("size"), [(1, 25, 10.0), (25, 60, 20.0)])),
        raster.component(everywhere, mapping=(F.col("region"), {1: 7.0, 2: 9.0})),
    ]
    out = raster.build_layer(cells, parts, "cost", [F.when(F.col("land") > 7, 1).otherwise(0)], per_mile=True)
    return out.select("row", "col", F.round("cost", 9).alias("cost"))


@query("SELECT row, col, slope + (CASE WHEN land = 0 THEN 1 ELSE 0 END) * 1e6 AS cost FROM {cells}", cells=CELLS)
def friction_barrier_merge(cells):
    return raster.with_barriers(cells.withColumn("barrier", F.when(F.col("land") == 0, 1).otherwise(0)), "slope", "barrier", "cost").select("row", "col", "cost")


@query("""
WITH c AS (SELECT row, col, land > 2 AS raw_land FROM {cells}),
w AS (SELECT DISTINCT w.row + r AS row, w.col + k AS col FROM c w, (SELECT unnest([-1, 0, 1]) AS r), (SELECT unnest([-1, 0, 1]) AS k) WHERE NOT raw_land AND (r <> 0 OR k <> 0))
SELECT c.row, c.col, raw_land, raw_land AND w.row IS NOT NULL AS landfall, raw_land AND w.row IS NULL AS land, NOT raw_land AS offshore FROM c LEFT JOIN w ON c.row = w.row AND c.col = w.col
""", cells=CELLS)
def landfall_mask(cells):
    return raster.masks(cells.select("row", "col", (F.col("land") > 2).alias("is_land")), F.col("is_land")).select("row", "col", "raw_land", "landfall", "land", "offshore")


@query(f"SELECT row, col, EXISTS (SELECT 1 FROM {{features}} f WHERE {NEAR.format(d='3.5e0')}) AS excluded FROM {{cells}} c", cells=CELLS, features=FEATURES)
def setback_generic(cells, features):
    return raster.setbacks(cells, features, 3.5).select("row", "col", "excluded")


@query(f"""
WITH rules AS (SELECT DISTINCT fips, fips % 4 + 0.5e0 AS distance FROM {{cells}} WHERE fips % 2 = 0)
SELECT row, col, CASE WHEN r.fips IS NOT NULL THEN EXISTS (SELECT 1 FROM {{features}} f WHERE f.fips = c.fips AND {NEAR.format(d='r.distance')})
    ELSE EXISTS (SELECT 1 FROM {{features}} f WHERE {NEAR.format(d='2.5e0')}) END AS excluded
FROM {{cells}} c LEFT JOIN rules r ON c.fips = r.fips
""", cells=CELLS, features=FEATURES)
def setback_local_override(cells, features):
    rules = cells.select("fips").distinct().filter("fips % 2 = 0").withColumn("distance", F.col("fips") % 4 + 0.5)
    return raster.local_setbacks(cells, features, rules, 2.5).select("row", "col", "excluded")


@query("""
WITH s AS (SELECT row, col, row * 4 + i AS y, col * 4 + j AS x FROM {cells}, (SELECT unnest(range(0, 4)) AS i), (SELECT unnest(range(0, 4)) AS j))
SELECT row, col, 1 - sum(CASE WHEN EXISTS (SELECT 1 FROM {features} f WHERE pow(y - (f.row * 4 + 1.5e0), 2) + pow(x - (f.col * 4 + 1.5e0), 2) <= 36) THEN 1 ELSE 0 END) / 16e0 AS inclusion FROM s GROUP BY row, col
""", cells=CELLS, features=FEATURES)
def partial_inclusion(cells, features):
    return raster.partial_inclusion(cells, features, 1.5, 4).select("row", "col", "inclusion")


@query("""
WITH h AS (SELECT row, col FROM (SELECT unnest(range(0, 7)) AS row), (SELECT unnest(range(0, 9)) AS col) WHERE (row * 5 + col * 3) % 7 / 7e2 > 30 / 8760e0),
s AS (SELECT 3 - row AS dr, 4 - col AS dc FROM h)
SELECT DISTINCT CAST(greatest(0, least(b.row + dr, 399)) AS BIGINT) AS row, CAST(greatest(0, least(b.col + dc, 49)) AS BIGINT) AS col FROM {features} b, s
""", features=FEATURES)
def flicker_shift_exclusions(features):
    heat = dense_grid(features.sparkSession, 7, 9).withColumn("value", (F.col("row") * 5 + F.col("col") * 3) % 7 / 700.0)
    out = raster.shifted(features, raster.flicker_shifts(heat, 7, 9, 30), 400, 50)
    return out.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"))


@query(f"""
WITH l AS (SELECT row, col, max(land) / 9e0 AS v FROM {{cells}} WHERE fips % 2 = 0 AND land > 4 GROUP BY row, col)
SELECT c.row, c.col, CASE WHEN c.fips % 2 = 0 THEN coalesce(l.v, 0) ELSE c.fraction END AS value FROM {{cells}} c LEFT JOIN l ON c.row = l.row AND c.col = l.col
""", cells=CELLS)
def merge_local_exclusions(cells):
    ruled = cells.filter("fips % 2 = 0")
    local = ruled.filter("land > 4").select("row", "col", (F.col("land") / 9).alias("value"))
    return raster.merge_exclusions(cells.select("row", "col", F.col("fraction").alias("value")), local, ruled)


@query("SELECT row, col, fraction * (CASE WHEN land > 3 THEN 1 ELSE 0 END) * 36 AS capacity FROM {cells} WHERE row BETWEEN 5 AND 29 AND col BETWEEN 10 AND 39", cells=CELLS)
def tech_potential_window(cells):
    return raster.tech_potential(cells, "fraction", F.col("land") > 3, 36.0, (5, 30), (10, 40))


@query("""
WITH t AS (SELECT CAST(gid % 2000 AS BIGINT) AS g, min(struct_pack(price := price)) AS v FROM {orders} GROUP BY gid % 2000)
SELECT c.row, c.col, t.v.price AS price FROM {cells} c LEFT JOIN t ON c.row * 50 + c.col = t.g
""", cells=CELLS, orders=ORDERS)
def table_to_raster(cells, orders):
    table = orders.select((F.col("gid") % 2000).alias("g"), "price")
    return raster.to_raster(table, "g", ["price"], 50, cells)


@query("SELECT CAST(gid % 40 AS INTEGER) AS row, CAST(gid % 50 AS INTEGER) AS col, max(voltage) AS capacity FROM {orders} GROUP BY gid % 40, gid % 50", orders=ORDERS)
def hottest_line_capacity(orders):
    lines = orders.select((F.col("gid") % 40).cast("int").alias("row"), (F.col("gid") % 50).cast("int").alias("col"), F.col("voltage").alias("capacity"))
    return raster.hottest_capacity(lines)


@query("""
WITH r AS (SELECT s.gid, d.direction, d.i, (s.gid * d.i) % 11 AS value FROM {sites} s, (SELECT * FROM (VALUES ('N', 1), ('NE', 2), ('E', 3), ('SE', 4), ('S', 5), ('SW', 6), ('W', 7), ('NW', 8)) t(direction, i)) d)
SELECT gid, direction FROM r QUALIFY row_number() OVER (PARTITION BY gid ORDER BY value DESC, i) = 1
""", sites=SITES)
def prominent_direction(sites):
    names = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]
    rose = sites.select("gid", F.posexplode(F.array(*[F.lit(n) for n in names])).alias("i", "direction")).select("gid", "direction", (F.col("gid") * (F.col("i") + 1) % 11).alias("value"))
    return raster.prominent_direction(rose, names)


@query("""
WITH RECURSIVE c AS (SELECT row, col, row * 50 + col AS id FROM {cells} WHERE land > 3),
e AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON abs(a.row - b.row) + abs(a.col - b.col) = 1),
l(id, label) USING KEY (id) AS (
    SELECT id, id FROM c
    UNION
    SELECT e.a, min(l.label) FROM l JOIN e ON l.id = e.b JOIN recurring.l AS r ON r.id = e.a WHERE l.label < r.label GROUP BY e.a
)
SELECT c.row, c.col FROM c JOIN l ON c.id = l.id WHERE label IN (SELECT label FROM l GROUP BY label HAVING count(*) >= 4)
""", cells=CELLS)
def contiguous_area_filter(cells):
    return raster.large_patches(cells.filter("land > 3"), 4, queen=False)

