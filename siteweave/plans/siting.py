"""Queries on node aggregation, offshore inputs and exclusion rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteweave.functions import costs
from siteweave.operators import allocation, cleaning, exclusion_rules, nodes, offshore, raster
from siteweave.plans.registry import CELLS, LINES, NATIONS, ORDERS, PLANTS, SITES, View, query
from siteweave.sources import tables as sources

BUILDS = View("orders", {"sc_gid": "CAST(o_custkey % 1200 AS BIGINT)", "year": "CAST(year(o_orderdate) AS INT)", "built": "o_totalprice"})
BUSES = View("customer", {"bus": "c_custkey", "lat": "CASE WHEN c_custkey % 37 = 5 THEN 95e0 ELSE 25e0 + c_custkey % 40 END", "lon": "-100e0 + c_nationkey", "capacity": "c_acctbal"})
BOXES = View("supplier", {"gid": "s_suppkey", "r1": "CAST(s_suppkey * 17 % 400 AS INT)", "c1": "CAST(s_suppkey * 29 % 40 AS INT)", "r2": "CAST(s_suppkey * 17 % 400 + 3 + s_suppkey % 5 AS INT)", "c2": "CAST(s_suppkey * 29 % 40 + 4 AS INT)", "fips": "CAST(floor((s_suppkey * 17 % 400) / 1e1) AS INT)"})
CURVE = PLANTS


@query("SELECT plant AS sc_gid, capacity, round(sum(built), 2) AS built FROM {curve} c JOIN {builds} b ON c.plant = b.sc_gid WHERE year = 1997 GROUP BY plant, capacity", curve=CURVE, builds=BUILDS)
def built_points(curve, builds):
    out = nodes.built_points(curve.select(F.col("plant").alias("sc_gid"), "capacity"), builds, 1997)
    return out.withColumn("built", F.round("built", 2))


@query("SELECT DISTINCT sc_gid FROM {builds} WHERE year = 1998 AND sc_gid NOT IN (SELECT plant FROM {curve} WHERE name <> 'MACHINERY')", curve=CURVE, builds=BUILDS)
def points_without_curve(curve, builds):
    """Built points that a curve without one of the segments lacks."""
    return nodes.points_without_curve(curve.filter("name <> 'MACHINERY'").select(F.col("plant").alias("sc_gid")), builds, 1998)


@query("SELECT DISTINCT res_gid FROM {lines} WHERE gid IN (SELECT sc_gid FROM {builds})", lines=LINES, builds=BUILDS)
def build_resources(lines, builds):
    curve = lines.groupBy(F.col("gid").alias("sc_gid")).agg(F.collect_set("res_gid").alias("res_gids"))
    return nodes.build_resources(builds, curve)


@query("""
WITH bad AS (SELECT DISTINCT gid FROM {lines} WHERE discount = 0 AND tax = 0 AND price > 90000), good AS (SELECT * FROM {sites} WHERE gid NOT IN (SELECT gid FROM bad)),
moved AS (
    SELECT g.gid, b.capacity FROM {sites} b, good g WHERE b.gid IN (SELECT gid FROM bad)
    QUALIFY row_number() OVER (PARTITION BY b.gid ORDER BY sqrt(pow(b.lat - g.lat, 2) + pow(b.lon - g.lon, 2)), g.gid) = 1
), added AS (SELECT gid, sum(capacity) AS c FROM moved GROUP BY gid)
SELECT g.gid, round(g.capacity + coalesce(c, 0), 4) AS capacity FROM good g LEFT JOIN added a ON g.gid = a.gid
""", sites=SITES, lines=LINES)
def reassigned_capacity(sites, lines):
    bad = lines.filter("discount = 0 AND tax = 0 AND price > 90000").select("gid")
    out = nodes.reassigned_capacity(sites.select("gid", "lat", "lon", "capacity"), bad, "gid")
    return out.select("gid", F.round("capacity", 4).alias("capacity"))


@query("""
WITH good AS (SELECT * FROM {buses} WHERE lat BETWEEN -90 AND 90 AND capacity > 0)
SELECT bus, min(bus) OVER w AS plant, round(sum(capacity) OVER w, 4) AS plant_capacity, round(capacity / sum(capacity) OVER w, 9) AS share FROM good WINDOW w AS (PARTITION BY lat, lon)
""", buses=BUSES)
def bus_table(buses):
    out = nodes.bus_table(buses.withColumnsRenamed({"bus": "BUS", "lat": "Lat"}))
    return out.select("bus", "plant", F.round("plant_capacity", 4).alias("plant_capacity"), F.round("share", 9).alias("share"))


@query("""
WITH good AS (SELECT * FROM {buses} WHERE lat BETWEEN -90 AND 90 AND capacity > 0),
b AS (SELECT bus, min(bus) OVER w AS plant, capacity / sum(capacity) OVER w AS share FROM good WINDOW w AS (PARTITION BY lat, lon)),
u AS (SELECT sc_gid AS plant, sc_gid % 100 AS gid, sum(built) AS built FROM {builds} GROUP BY sc_gid)
SELECT b.bus, u.gid, s.lcoe, round(u.built * b.share, 3) AS capacity FROM b JOIN u USING (plant) LEFT JOIN {sites} s ON s.gid = u.gid
""", buses=BUSES, builds=BUILDS, sites=SITES)
def bus_builds(buses, builds, sites):
    made = builds.groupBy(F.col("sc_gid").alias("plant")).agg(F.sum("built").alias("built")).withColumn("gid", F.col("plant") % 100)
    out = nodes.bus_builds(nodes.bus_table(buses), made, sites.select("gid", "lcoe"))
    return out.select("bus", "gid", "lcoe", F.round("capacity", 3).alias("capacity"))


@query("SELECT nation, round(quantile_cont(capacity * 1.6e0, 0.9), 6) AS capacity FROM {plants} GROUP BY nation", plants=PLANTS)
def percentile_distance(plants):
    return nodes.percentile_distance(plants, "capacity", 0.9, ("nation",), miles=True).withColumn("capacity", F.round("capacity", 6))


NEAREST = "near AS (SELECT p.plant, p.capacity, s.gid AS node FROM {plants} p, {sites} s QUALIFY row_number() OVER (PARTITION BY p.plant ORDER BY sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)), s.gid) = 1)"


@query(f"""
WITH {NEAREST}, whole AS (SELECT node, sum(near.capacity) AS capacity, lat, lon FROM near JOIN {{sites}} ON gid = node GROUP BY node, lat, lon),
big AS (SELECT * FROM whole WHERE capacity >= 60000), small AS (SELECT * FROM whole WHERE capacity < 60000),
moved AS (
    SELECT b.node AS to_node, s.node, s.capacity FROM small s, big b
    QUALIFY row_number() OVER (PARTITION BY s.node ORDER BY sqrt(pow(s.lat - b.lat, 2) + pow(s.lon - b.lon, 2)), b.node) = 1
), every AS (SELECT node AS to_node, node, capacity FROM big UNION ALL SELECT * FROM moved UNION ALL SELECT node, node, capacity FROM small WHERE NOT EXISTS (SELECT 1 FROM big))
SELECT to_node AS node, round(sum(capacity), 3) AS capacity, array_to_string(list(node ORDER BY node), ',') AS members FROM every GROUP BY to_node
""", plants=PLANTS, sites=SITES)
def node_aggregation(plants, sites):
    points = plants.select(F.col("plant").alias("gid"), "lat", "lon", "capacity")
    out = nodes.aggregated(points, sites.select(F.col("gid").alias("node"), "lat", "lon"), 60000.0)
    return out.select("node", F.round("capacity", 3).alias("capacity"), F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""
WITH {NEAREST}, f AS (SELECT cust AS plant, date_trunc('month', ts) AS ts, sum(price) / 1e6 AS value FROM {{orders}} GROUP BY ALL)
SELECT node, CAST(ts AS VARCHAR) AS ts, round(sum(value * capacity), 3) AS value FROM f JOIN near USING (plant) GROUP BY node, ts
""", plants=PLANTS, sites=SITES, orders=ORDERS)
def node_profiles(plants, sites, orders):
    points = plants.select(F.col("plant").alias("gid"), "lat", "lon", "capacity")
    profiles = orders.groupBy(F.col("cust").alias("gid"), F.date_trunc("month", "ts").alias("ts")).agg((F.sum("price") / 1e6).alias("value"))
    out = nodes.node_profiles(points, profiles, sites.select(F.col("gid").alias("node"), "lat", "lon"))
    return out.select("node", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 3).alias("value"))


@query("SELECT plant, CASE WHEN plant % 3 <> 1 THEN plant % 7 END AS node FROM {plants}", plants=PLANTS)
def node_map_by_table(plants):
    table = plants.filter("plant % 3 <> 1").select(F.col("plant").cast("string").alias("gid"), (F.col("plant") % 7).alias("node"))
    return nodes.node_map(plants.select(F.col("plant").alias("gid")), plants, table).withColumnRenamed("gid", "plant")


@query("""
WITH b AS (SELECT 'upv' AS tech, 'p' || nation AS zone, CAST(plant % 5 AS INTEGER) AS class, capacity FROM {plants} UNION ALL SELECT 'wind', 's' || nation, CAST(gid % 3 AS INTEGER), capacity FROM {sites})
SELECT tech, zone, class, round(sum(capacity), 4) AS capacity, count(*) AS n FROM b GROUP BY tech, zone, class
""", plants=PLANTS, sites=SITES)
def zone_capacity(plants, sites):
    named = lambda df, zone, gid: df.select(F.concat(F.lit(zone), F.col("nation").cast("string")).alias("region"), F.concat(F.lit("tech_"), gid.cast("string")).alias("category"), "capacity")
    out = nodes.zone_capacity({"upv": named(plants, "zone p", F.col("plant") % 5), "wind": named(sites, "s", F.col("gid") % 3)})
    return out.withColumn("capacity", F.round("capacity", 4))


@query("SELECT gid, round(avg(actual), 6) AS old_mean, max(actual) AS old_max, round(avg(forecast), 6) AS new_mean, max(forecast) AS new_max FROM {lines} GROUP BY gid", lines=LINES)
def profile_quality(lines):
    out = nodes.quality(lines.select("gid", F.col("actual").alias("value")), lines.select("gid", F.col("forecast").alias("value")))
    return out.select("gid", F.round("old_mean", 6).alias("old_mean"), "old_max", F.round("new_mean", 6).alias("new_mean"), "new_max")


@query("SELECT s.gid, n.name, s.capacity, round(s.capacity / sum(s.capacity) OVER (PARTITION BY s.nation), 9) AS share FROM {sites} s LEFT JOIN {nations} n ON s.gid = n.gid", sites=SITES, nations=NATIONS)
def one_to_one_share(sites, nations):
    joined = nodes.one_to_one(sites.select("gid", "nation", "capacity"), nations.select("gid", "name"), "gid")
    return nodes.shares_of_plant(joined, "nation", "capacity").select("gid", "name", "capacity", F.round("share", 9).alias("share"))


CENTRES = "k AS (SELECT size AS gid, CAST(floor(avg(row)) AS INTEGER) AS row, CAST(floor(avg(col)) AS INTEGER) AS col FROM {cells} GROUP BY size)"
AREAS = """px AS (SELECT row, col, 25 + row / 1e1 AS lat, -124 + col AS lon, CASE WHEN land > 1 THEN price ELSE -1 END AS dist FROM {cells}),
a AS (
    SELECT n.gid AS area, n.lat, n.lon, dist AS dist_p_to_a FROM {nations} n0 JOIN (SELECT gid, 26 + gid / 1e1 AS lat, -120 + gid AS lon FROM {nations}) n ON n0.gid = n.gid, px WHERE dist >= 0
    QUALIFY row_number() OVER (PARTITION BY n.gid ORDER BY sqrt(pow(n.lat - px.lat, 2) + pow(n.lon - px.lon, 2)), px.row * 50 + px.col) = 1
)"""


def _areas(cells, nations):
    pixels = cells.select((F.col("row") * 50 + F.col("col")).alias("pixel"), "row", "col", (25 + F.col("row") / 10).alias("lat"), (F.col("col") - 124).cast("double").alias("lon"), F.when(F.col("land") > 1, F.col("price")).otherwise(-1.0).alias("dist"))
    areas = nations.select(F.col("gid").alias("area"), (26 + F.col("gid") / 10).alias("lat"), (F.col("gid") - 120).cast("double").alias("lon"))
    return areas, offshore.assembly_table(areas, pixels)


@query(f"WITH {AREAS} SELECT area, dist_p_to_a FROM a", cells=CELLS, nations=NATIONS)
def assembly_areas(cells, nations):
    return _areas(cells, nations)[1].select("area", "dist_p_to_a")


@query(f"""
WITH {CENTRES}, {AREAS}, p AS (SELECT s.gid, s.lat, s.lon, k.row, k.col FROM {{sites}} s JOIN k ON s.gid = k.gid),
d AS (
    SELECT p.gid, a.area, a.dist_p_to_a, 2 * 6371e0 * asin(sqrt(pow(sin((radians(a.lat) - radians(p.lat)) / 2), 2) + cos(radians(p.lat)) * cos(radians(a.lat)) * pow(sin((radians(a.lon) - radians(p.lon)) / 2), 2))) AS km
    FROM p, a QUALIFY row_number() OVER (PARTITION BY p.gid ORDER BY sqrt(pow(p.lat - a.lat, 2) + pow(p.lon - a.lon, 2)), a.area) = 1
)
SELECT p.gid, p.row, p.col, abs(c.slope - 20) AS depth, round(c.price / 1000, 9) AS dist, CASE WHEN c.fraction <= 0 THEN 0.01e0 WHEN c.fraction >= 1 THEN 0.99e0 ELSE c.fraction END AS downtime, d.area, d.dist_p_to_a, round(km, 4) AS dist_a_to_s
FROM p LEFT JOIN {{cells}} c ON p.row = c.row AND p.col = c.col LEFT JOIN d ON p.gid = d.gid
""", sites=SITES, cells=CELLS, nations=NATIONS)
def offshore_inputs(sites, cells, nations):
    centres = raster.label_centres(cells, "size").withColumnRenamed("size", "gid")
    areas, table = _areas(cells, nations)
    layers = cells.withColumn("below", F.col("slope") - 20)
    out = offshore.offshore_inputs(sites.select("gid", "lat", "lon"), centres, layers, {"depth": "below", "dist": "price", "downtime": "fraction"}, table.select("area", "dist_p_to_a").join(areas, "area"), None, "depth", ("dist",), "downtime")
    return out.select("gid", "row", "col", "depth", F.round("dist", 9).alias("dist"), "downtime", "area", "dist_p_to_a", F.round("dist_a_to_s", 4).alias("dist_a_to_s"))


@query("SELECT gid, concat(name, '_', region) AS name FROM {nations}", nations=NATIONS)
def port_names(nations):
    return offshore.port_names(nations.withColumnRenamed("name", "n"), ["n", "region"]).select("gid", "name")


@query("SELECT gid FROM {orders} WHERE priority = '1-URGENT'", orders=ORDERS)
def regulation_mask(orders):
    kind, sub = F.when(F.col("priority").isin("1-URGENT", "2-HIGH"), "Roads").otherwise("Parcels"), F.when(F.col("priority") == "2-HIGH", "High-Ways")
    rules = orders.select("gid", kind.alias("Feature Type"), sub.alias("Feature Subtype"))
    return exclusion_rules.Setback(("roads",), ("high ways",)).rules(rules).select("gid")


RING = "least(c.row - b.r1, b.r2 - c.row, c.col - b.c1, b.c2 - c.col) BETWEEN 0 AND 1"


@query(f"SELECT row, col, EXISTS (SELECT 1 FROM {{boxes}} b WHERE {RING}) AS excluded FROM {{cells}} c", cells=CELLS, boxes=BOXES)
def parcel_ring(cells, boxes):
    return exclusion_rules.calculator(exclusion_rules.Setback(("parcels",), buffer="parcel"))(cells, boxes, None, 2).select("row", "col", "excluded")


@query("""
WITH rules AS (SELECT DISTINCT fips, fips % 3 AS d FROM {cells} WHERE fips % 2 = 0)
SELECT row, col, CASE WHEN r.fips IS NOT NULL THEN EXISTS (SELECT 1 FROM {boxes} b WHERE b.fips = c.fips AND c.row BETWEEN b.r1 - r.d AND b.r2 + r.d AND c.col BETWEEN b.c1 - r.d AND b.c2 + r.d)
    ELSE EXISTS (SELECT 1 FROM {boxes} b WHERE c.row BETWEEN b.r1 - 1 AND b.r2 + 1 AND c.col BETWEEN b.c1 - 1 AND b.c2 + 1) END AS excluded
FROM {cells} c LEFT JOIN rules r ON c.fips = r.fips
""", cells=CELLS, boxes=BOXES)
def box_setbacks(cells, boxes):
    rules = cells.select("fips").distinct().filter("fips % 2 = 0").withColumn("distance", F.col("fips") % 3)
    return exclusion_rules.calculator(exclusion_rules.Setback(("structures",)))(cells, boxes, rules, 1).select("row", "col", "excluded")


@query("""
SELECT gid, CAST(greatest(0, least(floor((lat - 1 - 25) / 0.5e0), 60)) AS INTEGER) AS row_start, CAST(greatest(0, least(ceil((lat + 1 - 25) / 0.5e0), 60)) AS INTEGER) AS row_stop,
       CAST(greatest(0, least(floor((lon - 1.5e0 + 124) / 0.5e0), 100)) AS INTEGER) AS col_start, CAST(greatest(0, least(ceil((lon + 1.5e0 + 124) / 0.5e0), 100)) AS INTEGER) AS col_stop
FROM {sites}
""", sites=SITES)
def window_of_bounds(sites):
    cell, d = 0.5, 0.25
    boxes = sites.select("gid", (F.col("lon") - 0.5).alias("minx"), F.col("lat").alias("miny"), (F.col("lon") + 0.5).alias("maxx"), F.col("lat").alias("maxy"))
    wide = exclusion_rules.buffered_bounds(boxes, d, cell)
    window = exclusion_rules.window_of(F.col("miny"), F.col("minx"), F.col("maxy"), F.col("maxx"), -124.0, cell, 25.0, cell, 60, 100)
    return wide.select("gid", *window)


@query("SELECT row - 5 AS row, col - 10 AS col, fips = 1 AS inside FROM {cells} WHERE row BETWEEN 5 AND 29 AND col BETWEEN 10 AND 39", cells=CELLS)
def county_in_window(cells):
    return exclusion_rules.county_in_window(cells, 1, (5, 30), (10, 40))


@query("""
WITH c AS (SELECT row, col, land > 2 AS raw_land FROM {cells}),
w AS (SELECT DISTINCT w.row + r AS row, w.col + k AS col FROM c w, (SELECT unnest([-1, 0, 1]) AS r), (SELECT unnest([-1, 0, 1]) AS k) WHERE NOT raw_land AND (r <> 0 OR k <> 0))
SELECT c.row, c.col, raw_land AND w.row IS NOT NULL AS landfall, NOT raw_land AS wet, NOT raw_land OR w.row IS NOT NULL AS wet_plus, raw_land AND w.row IS NULL AS dry, raw_land AS dry_plus
FROM c LEFT JOIN w ON c.row = w.row AND c.col = w.col
""", cells=CELLS)
def layer_extents(cells):
    return exclusion_rules.extents(cells.select("row", "col", "land"), F.col("land") > 2).select("row", "col", "landfall", "wet", "wet_plus", "dry", "dry_plus")


@query("SELECT DISTINCT fips, size FROM {cells}", cells=CELLS)
def gids_of_counties(cells):
    return exclusion_rules.gids_of_counties(cells, "size")


@query("SELECT row, col, CAST((row // 8) * 7 + col // 8 AS BIGINT) AS gid FROM {cells}", cells=CELLS)
def aggregated_cell(cells):
    return cells.select("row", "col", exclusion_rules.aggregated_cell(F.col("row"), F.col("col"), 8, 50).alias("gid"))


@query("""
WITH t AS (SELECT row, col, CAST(floor((1 + (row + 0.5e0) * 1.5e0) / 2) AS INTEGER) AS sr, CAST(floor((3 + (col + 0.5e0) * 1.5e0) / 2) AS INTEGER) AS sc FROM {cells})
SELECT t.row, t.col, coalesce(c.price, -1) AS value FROM t LEFT JOIN {cells} c ON c.row = t.sr AND c.col = t.sc
""", cells=CELLS)
def reprojected_layer(cells):
    return exclusion_rules.reprojected(cells.select("row", "col", F.col("price").alias("value")), cells, (0.0, 2.0, 0.0, 2.0), (3.0, 1.5, 1.0, 1.5))


@query("SELECT s.gid, s.capacity, 7 AS tag, p.n FROM {sites} s JOIN (SELECT nation AS gid, count(*) AS n FROM {plants} GROUP BY nation) p USING (gid)", sites=SITES, plants=PLANTS)
def with_extra_columns(sites, plants):
    table = plants.groupBy(F.col("nation").alias("gid")).agg(F.count("*").alias("n"))
    return cleaning.with_extra(sites.select("gid", "capacity"), {"tag": 7}, table, "gid")


@query("SELECT gid, gid AS res_gid, sum(1 + line) * 1e0 AS n FROM {lines} GROUP BY gid", lines=LINES)
def single_gid_points(lines):
    points = lines.groupBy("gid").agg(F.collect_list("res_gid").alias("res_gids"), F.collect_list((1 + F.col("line")).cast("double")).alias("gid_counts"))
    out = cleaning.single_gid(points, "gid")
    return out.select("gid", F.col("res_gids")[0].alias("res_gid"), F.col("gid_counts")[0].alias("n"))


@query("SELECT gid, count(DISTINCT okey) AS n FROM {lines} GROUP BY gid HAVING count(DISTINCT okey) > 1", lines=LINES)
def shared_sites(lines):
    return allocation.shared_sites(lines.select("gid", F.col("okey").alias("plant")))


@query("SELECT res_gid, min(gid) AS gen_gid FROM {lines} GROUP BY res_gid", lines=LINES)
def first_gen_gid(lines):
    return sources.first_gen_gid(lines.select("res_gid", F.col("gid").alias("gen_gid")))


@query("SELECT gid AS gen_gid, lcoe AS cf FROM {sites}", sites=SITES)
def generation_means(sites):
    return sources.generation_means(sites.select(F.col("gid").alias("gen_gid"), F.col("lcoe").alias("cf_mean-means"), F.lit(0.0).alias("mean_cf")))


@query("SELECT min(lon - 1) AS minx, min(lat - 1) AS miny, max(lon + 1) AS maxx, max(lat + 1) AS maxy, count(DISTINCT gid) AS n FROM {sites}", sites=SITES)
def feature_extent(sites):
    return sources.extent(sites.select(F.col("gid").alias("id"), (F.col("lon") - 1).alias("minx"), (F.col("lat") - 1).alias("miny"), (F.col("lon") + 1).alias("maxx"), (F.col("lat") + 1).alias("maxy")))


@query("""
WITH p AS (SELECT CAST(r * 7 + c AS BIGINT) AS sc_point_gid, CAST(least(r * 8 + 4, 399) AS INTEGER) AS row, CAST(least(c * 8 + 4, 49) AS INTEGER) AS col FROM (SELECT unnest(range(0, 50)) AS r), (SELECT unnest(range(0, 7)) AS c))
SELECT sc_point_gid, row, col, land, price FROM p JOIN {cells} USING (row, col)
""", cells=CELLS)
def supply_points(cells):
    """The layers of the cell in the centre of each supply-curve point."""
    return sources.supply_points(cells.sparkSession, 400, 50, 8).join(cells, ["row", "col"]).select("sc_point_gid", "row", "col", "land", "price")


@query("SELECT row, col, CAST(round(price * 10) AS SMALLINT) AS price, CAST(round(slope * 100) AS SMALLINT) AS slope FROM {cells}", cells=CELLS)
def quantised_layers(cells):
    return sources.quantised(cells.select("row", "col", "price", "slope"), {"price": 10, "slope": 100})


@query("SELECT n.gid, kv, cost FROM {nations} n JOIN (SELECT * FROM (VALUES (1, 69, 3498000e0), (1, 138, 5541000e0), (1, 230, 9171000e0), (1, 500, 15489000e0), (2, 69, 3975000e0), (2, 138, 8870000e0), (2, 230, 17525000e0), (2, 500, 37017000e0), (3, 69, 5700000e0), (3, 138, 7800000e0), (3, 230, 9700000e0), (3, 500, 20300000e0), (4, 69, 3064000e0), (4, 138, 4692000e0), (4, 230, 5732000e0), (4, 500, 20364000e0)) t(region, kv, cost)) USING (region)", nations=NATIONS)
def new_substation_costs(nations):
    """What a new substation of each voltage costs in each nation of a region with costs."""
    return nations.select("gid", "region").join(costs.by_region(nations.sparkSession, costs.NEW_SUBSTATION, "kv", "cost"), "region").select("gid", "kv", "cost")


FLICKER_RULES = View("part", {"gid": "p_partkey", "kind": "CASE p_size % 3 WHEN 0 THEN 'Shadow Flicker' WHEN 1 THEN 'Roads' ELSE NULL END", "hours": "p_size"})


@query("SELECT gid, hours FROM {rules} WHERE kind = 'Shadow Flicker'", rules=FLICKER_RULES)
def flicker_rules(rules):
    return rules.filter(exclusion_rules.flicker_mask(F.col("kind"))).select("gid", "hours")
