"""Queries on places: neighbours, radii, bins, regions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions.projections import Conic, corrected_points
from siteweave.functions.spatial import cell_centre, cell_of, haversine_km, min_max, project_on_segment
from siteweave.operators import raster
from siteweave.operators import spatial_joins as sj
from siteweave.plans.registry import CELLS, ORDERS, PLANTS, SITES, query
from siteweave.sources.tables import features_in

KM = "2 * 6371e0 * asin(sqrt(least(1e0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))))"
APART = KM.format(a="p.lat", b="p.lon", c="s.lat", d="s.lon")
#: (region, minx, miny, maxx, maxy)
BOXES = [("west", -124.0, 25.0, -110.0, 49.0), ("middle", -112.0, 25.0, -95.0, 40.0), ("north", -111.0, 38.0, -90.0, 48.0), ("east", -89.0, 30.0, -67.0, 45.0)]
BOX_VALUES = ", ".join(str(b) for b in BOXES)


def boxes(spark):
    return spark.createDataFrame(BOXES, "region string, minx double, miny double, maxx double, maxy double")


@query("""
WITH d AS (SELECT plant, gid, sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)) AS distance FROM {plants} p, {sites} s),
r AS (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY distance, gid) AS n FROM d)
SELECT plant, gid, round(distance, 6) AS distance FROM r WHERE n = 1
""", plants=PLANTS, sites=SITES)
def nearest_site(plants, sites):
    return sj.nearest_by_degrees(plants, sites, "plant", "gid").select("plant", "gid", F.round("distance", 6).alias("distance"))


@query(f"""
WITH d AS (SELECT plant, gid, {APART} AS distance FROM {{plants}} p, {{sites}} s),
r AS (SELECT *, row_number() OVER (PARTITION BY plant ORDER BY distance, gid) AS n FROM d)
SELECT plant, gid, CAST(n AS INTEGER) AS rank, round(distance, 4) AS distance FROM r WHERE n <= 3
""", plants=PLANTS, sites=SITES)
def knn_sites(plants, sites):
    return sj.nearest_by_haversine(plants, sites, "plant", "gid", 3).select("plant", "gid", "rank", F.round("distance", 4).alias("distance"))


@query("""
WITH d AS (SELECT plant, gid, sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)) AS distance FROM {plants} p, {sites} s),
r AS (SELECT plant, gid, distance FROM d QUALIFY row_number() OVER (PARTITION BY plant ORDER BY distance, gid) = 1)
SELECT plant AS a_gid, gid AS b_gid, round(distance, 6) AS distance FROM r WHERE distance <= 1.5e0 * (SELECT quantile_cont(distance, 0.5) FROM r)
""", plants=PLANTS, sites=SITES)
def site_pairs_median_filter(plants, sites):
    return sj.site_pairs(plants.withColumnRenamed("plant", "gid"), sites).withColumn("distance", F.round("distance", 6))


@query(f"""
WITH RECURSIVE d AS (SELECT plant, s.gid, s.lat, s.lon, s.lcoe, {APART} AS km FROM {{plants}} p, {{sites}} s),
radii AS (SELECT 400e0 AS r UNION ALL SELECT r * 1.2e0 FROM radii WHERE r < 30000),
reach AS (SELECT plant, min(r) AS r FROM (SELECT plant, r FROM d JOIN radii ON km <= r GROUP BY plant, r HAVING count(*) > 1) GROUP BY plant),
best AS (
    SELECT plant, gid, lat, lon, lcoe FROM d JOIN reach USING (plant) WHERE km <= r
    QUALIFY row_number() OVER (PARTITION BY plant ORDER BY lcoe, gid) = 1
)
SELECT p.plant, s.gid, round({APART}, 4) AS distance FROM best p, {{sites}} s WHERE s.lcoe <= p.lcoe * 1.3e0
""", plants=PLANTS, sites=SITES)
def radius_lcoe_candidates(plants, sites):
    return sj.radius_candidates(plants.select("plant", "lat", "lon"), sites.select("gid", "lat", "lon", "lcoe"), 400.0, digits=4)


CLASSES = [69, 115, 138, 161, 230, 345]


@query("SELECT gid, CAST(coalesce((SELECT min(c) FROM (VALUES (69), (115), (138), (161), (230), (345)) t(c) WHERE c >= voltage), 345) AS INTEGER) AS class FROM {orders}", orders=ORDERS)
def xformer_asof_class(orders):
    return sj.as_of_at_least(orders, "voltage", CLASSES, "class").select("gid", "class")


@query("SELECT gid, CAST(CASE WHEN voltage > 0 AND voltage <= 100 THEN 1 WHEN voltage > 100 AND voltage <= 300 THEN 2 WHEN voltage > 300 AND voltage <= 400 THEN 3 END AS INTEGER) AS bin FROM {orders}", orders=ORDERS)
def voltage_bins(orders):
    return sj.cut(orders, "voltage", [0, 100, 300, 400], "bin").select("gid", "bin")


@query("SELECT gid, CAST(CASE WHEN price > 0 AND price <= 100000 THEN 1 WHEN price > 100000 AND price <= 250000 THEN 2 WHEN price > 250000 AND price <= 400000 THEN 3 END AS INTEGER) AS trg FROM {orders}", orders=ORDERS)
def trg_cut(orders):
    return sj.cut(orders, "price", [0, 100_000, 250_000, 400_000], "trg").select("gid", "trg")


@query("SELECT row, col, (CASE WHEN size >= 1 AND size < 20 THEN 2e0 ELSE 0e0 END) + (CASE WHEN size >= 10 AND size < 40 THEN 3e0 ELSE 0e0 END) + (CASE WHEN size >= 30 AND size < 60 THEN 5e0 ELSE 0e0 END) AS cost FROM {cells}", cells=CELLS)
def raster_bins_overlap(cells):
    return sj.bin_values(cells, "size", [(1, 20, 2.0), (10, 40, 3.0), (30, 60, 5.0)], "cost").select("row", "col", "cost")


@query("""
WITH bands AS (SELECT unnest(range(0, 500)) AS b)
SELECT gid, CAST(b AS BIGINT) AS band FROM {orders} JOIN bands ON price > b * 1e3 AND price <= (b + 1) * 1e3
""", orders=ORDERS)
def price_bands(orders):
    bands = orders.sparkSession.range(500).select(F.col("id").alias("band"), (F.col("id") * 1e3).alias("low"), ((F.col("id") + 1) * 1e3).alias("high"))
    return sj.range_join(orders, bands, "price", "low", "high", 1e3).select("gid", "band")


REGION_SQL = f"b AS (SELECT * FROM (VALUES {BOX_VALUES}) t(region, minx, miny, maxx, maxy)), inside AS (SELECT gid, min(region) AS region FROM {{sites}} JOIN b ON lon BETWEEN minx AND maxx AND lat BETWEEN miny AND maxy GROUP BY gid)"


@query(f"WITH {REGION_SQL} SELECT s.gid, coalesce(i.region, '-999') AS region FROM {{sites}} s LEFT JOIN inside i ON s.gid = i.gid", sites=SITES)
def point_in_region_bbox(sites):
    return sj.classify(sites, boxes(sites.sparkSession), "gid")


@query(f"""
WITH {REGION_SQL}, c AS (SELECT region, (miny + maxy) / 2 AS lat, (minx + maxx) / 2 AS lon FROM b),
near AS (
    SELECT s.gid, c.region FROM {{sites}} s, c QUALIFY row_number() OVER (PARTITION BY s.gid ORDER BY sqrt(pow(s.lat - c.lat, 2) + pow(s.lon - c.lon, 2)), c.region) = 1
)
SELECT s.gid, coalesce(i.region, n.region) AS region FROM {{sites}} s LEFT JOIN inside i ON s.gid = i.gid LEFT JOIN near n ON s.gid = n.gid
""", sites=SITES)
def point_in_region_nearest(sites):
    return sj.classify(sites, boxes(sites.sparkSession), "gid", force=True)


@query(f"""
WITH b AS (SELECT * FROM (VALUES {BOX_VALUES}) t(region, minx, miny, maxx, maxy)), f AS (SELECT gid, lon - 1 AS minx, lat - 1 AS miny, lon + 1 AS maxx, lat + 1 AS maxy FROM {{sites}})
SELECT gid, region FROM f JOIN b ON f.minx - 0.5e0 <= b.maxx AND f.maxx + 0.5e0 >= b.minx AND f.miny - 0.5e0 <= b.maxy AND f.maxy + 0.5e0 >= b.miny
""", sites=SITES)
def bbox_overlap_join(sites):
    features = sites.select("gid", (F.col("lon") - 1).alias("minx"), (F.col("lat") - 1).alias("miny"), (F.col("lon") + 1).alias("maxx"), (F.col("lat") + 1).alias("maxy"))
    return sj.overlapping(features, boxes(sites.sparkSession), "gid", "region", 5.0, 0.5)


@query(f"SELECT plant, round({KM.format(a='lat', b='lon', c='40e0', d='-100e0')}, 4) AS km FROM {{plants}}", plants=PLANTS)
def haversine_distance(plants):
    return plants.select("plant", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-100.0)), 4).alias("km"))


@query("""
WITH o AS (SELECT * FROM (VALUES ('N', -1, 0), ('NE', -1, 1), ('E', 0, 1), ('SE', 1, 1), ('S', 1, 0), ('SW', 1, -1), ('W', 0, -1), ('NW', -1, -1)) t(direction, r, c))
SELECT gid, direction, CAST(greatest(0, least(gid // 10 + r, 99)) * 10 + greatest(0, least(gid % 10 + c, 9)) AS BIGINT) AS neighbour FROM {sites}, o
""", sites=SITES)
def neighbors_8dir(sites):
    return raster.neighbours(sites.select("gid"), "gid", 10, 100)


@query("""
WITH s AS (SELECT plant, lon, lat, -120e0 + nation AS x1, 30e0 AS y1, -100e0 + nation AS x2, 30e0 + nation AS y2 FROM {plants}),
t AS (SELECT *, greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) AS t FROM s)
SELECT plant, round(x1 + t * (x2 - x1), 6) AS x, round(y1 + t * (y2 - y1), 6) AS y FROM t
""", plants=PLANTS)
def nearest_on_line(plants):
    n = F.col("nation")
    x, y = project_on_segment(F.col("lon"), F.col("lat"), n - 120.0, F.lit(30.0), n - 100.0, n + 30.0)
    return plants.select("plant", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("SELECT plant, CAST(floor((lat - 25) / 0.25e0) AS INTEGER) AS row, CAST(floor((lon + 125) / 0.5e0) AS INTEGER) AS col, round(25 + (floor((lat - 25) / 0.25e0) + 0.5e0) * 0.25e0, 6) AS y, round(-125 + (floor((lon + 125) / 0.5e0) + 0.5e0) * 0.5e0, 6) AS x FROM {plants}", plants=PLANTS)
def pixel_of_point(plants):
    row, col = cell_of(F.col("lat"), F.col("lon"), -125.0, 0.5, 25.0, 0.25)
    y, x = cell_centre(row, col, -125.0, 0.5, 25.0, 0.25)
    return plants.select("plant", row.alias("row"), col.alias("col"), F.round(y, 6).alias("y"), F.round(x, 6).alias("x"))


@query("SELECT gid, nation, round(CASE WHEN max(capacity) OVER w > min(capacity) OVER w THEN (capacity - min(capacity) OVER w) / (max(capacity) OVER w - min(capacity) OVER w) ELSE 1 END, 9) AS scaled FROM {sites} WINDOW w AS (PARTITION BY nation)", sites=SITES)
def min_max_scaling(sites):
    nation = Window.partitionBy("nation")
    scaled = min_max(F.col("capacity"), F.min("capacity").over(nation), F.max("capacity").over(nation))
    return sites.select("gid", "nation", F.round(scaled, 9).alias("scaled"))


@query("SELECT gid FROM (SELECT gid, lon - 1 AS minx, lat - 1 AS miny, lon + 1 AS maxx, lat + 1 AS maxy FROM {sites}) WHERE minx <= -95 AND maxx >= -110 AND miny <= 42 AND maxy >= 33", sites=SITES)
def bbox_scan(sites):
    features = sites.select("gid", (F.col("lon") - 1).alias("minx"), (F.col("lat") - 1).alias("miny"), (F.col("lon") + 1).alias("maxx"), (F.col("lat") + 1).alias("maxy"))
    return features_in(features, -110.0, 33.0, -95.0, 42.0).select("gid")


#: Albers' conic with parallels 29.5 and 45.5 from (37.5, -96), and Lambert's with 33 and 45 from (39, -96); in SQL by the same formulas.
ALBERS = Conic.of("+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=37.5 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83 +units=m +no_defs")
LAMBERT = Conic.of("+proj=lcc +lat_1=33 +lat_2=45 +lat_0=39 +lon_0=-96 +x_0=1000 +y_0=-2000 +ellps=GRS80 +units=m")
_Q = "((1 - e * e) * (sin({p}) / (1 - pow(e * sin({p}), 2)) - ln((1 - e * sin({p})) / (1 + e * sin({p}))) / (2 * e)))"
_M = "(cos({p}) / sqrt(1 - pow(e * sin({p}), 2)))"
_T = "(tan(pi() / 4 - {p} / 2) / pow((1 - e * sin({p})) / (1 + e * sin({p})), e / 2))"


@query(f"""
WITH k AS (SELECT sqrt(0.006694380022903416e0) AS e, 6378137e0 AS a, radians(29.5e0) AS p1, radians(45.5e0) AS p2, radians(37.5e0) AS p0),
n AS (SELECT *, (pow({_M.format(p='p1')}, 2) - pow({_M.format(p='p2')}, 2)) / ({_Q.format(p='p2')} - {_Q.format(p='p1')}) AS n FROM k),
c AS (SELECT *, pow({_M.format(p='p1')}, 2) + n * {_Q.format(p='p1')} AS c FROM n),
r AS (SELECT *, a * sqrt(c - n * {_Q.format(p='p0')}) / n AS r0 FROM c),
s AS (SELECT gid, a, n, r0, a * sqrt(c - n * {_Q.format(p='radians(lat)')}) / n AS r, n * radians(lon + 96) AS t FROM r, {{sites}})
SELECT gid, round(r * sin(t), 3) AS x, round(r0 - r * cos(t), 3) AS y FROM s
""", sites=SITES)
def albers_places(sites):
    x, y = ALBERS.forward(F.col("lat"), F.col("lon"))
    return sites.select("gid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""
WITH k AS (SELECT sqrt(0.006694380022903416e0) AS e, 6378137e0 AS a, radians(33e0) AS p1, radians(45e0) AS p2, radians(39e0) AS p0),
n AS (SELECT *, ln({_M.format(p='p1')} / {_M.format(p='p2')}) / ln({_T.format(p='p1')} / {_T.format(p='p2')}) AS n FROM k),
c AS (SELECT *, {_M.format(p='p1')} / (n * pow({_T.format(p='p1')}, n)) AS f FROM n),
s AS (SELECT gid, n, a * f * pow({_T.format(p='p0')}, n) AS r0, a * f * pow({_T.format(p='radians(lat)')}, n) AS r, n * radians(lon + 96) AS t FROM c, {{sites}})
SELECT gid, round(1000 + r * sin(t), 3) AS x, round(r0 - r * cos(t) - 2000, 3) AS y FROM s
""", sites=SITES)
def lambert_places(sites):
    x, y = LAMBERT.forward(F.col("lat"), F.col("lon"))
    return sites.select("gid", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


_PHI = f"""list_reduce(range(0, 9), lambda p, i: p + pow(1 - pow(e * sin(p), 2), 2) / (2 * cos(p)) * (q / (1 - e * e) - sin(p) / (1 - pow(e * sin(p), 2)) + ln((1 - e * sin(p)) / (1 + e * sin(p))) / (2 * e)), asin(q / 2))"""


@query(f"""
WITH k AS (SELECT sqrt(0.006694380022903416e0) AS e, 6378137e0 AS a, radians(29.5e0) AS p1, radians(45.5e0) AS p2, radians(37.5e0) AS p0),
n AS (SELECT *, (pow({_M.format(p='p1')}, 2) - pow({_M.format(p='p2')}, 2)) / ({_Q.format(p='p2')} - {_Q.format(p='p1')}) AS n FROM k),
c AS (SELECT *, pow({_M.format(p='p1')}, 2) + n * {_Q.format(p='p1')} AS c FROM n),
r AS (SELECT *, a * sqrt(c - n * {_Q.format(p='p0')}) / n AS r0 FROM c),
spots AS (SELECT gid, e, a, n, c, r0, -2300000 + (gid % 30000 % 52 + 0.5e0) * 90 * 1000 AS x, 1600000 - (gid % 30000 // 52 + 0.5e0) * 90 * 64 AS y FROM r, {{orders}}),
s AS (SELECT gid, e, n, (c - pow(sqrt(x * x + pow(r0 - y, 2)) * n / a, 2)) / n AS q, atan2(x, r0 - y) AS t FROM spots)
SELECT gid, round({_PHI}, 8) AS phi, round(-96 + degrees(t) / n, 6) AS lon FROM s
""", orders=ORDERS)
def corrected_supply_points(orders):
    """Latitudes (in radians) and longitudes of supply-curve points, by their place in the grid of the raster on Albers' map."""
    points = orders.select("gid", (F.col("gid") % 30000).alias("sc_point_gid"))
    out = corrected_points(points, ALBERS, 52 * 64, 64, -2300000.0, 90.0 * 1000 / 64, 1600000.0, -90.0)
    return out.select("gid", F.round(F.radians("lat"), 8).alias("phi"), F.round("lon", 6).alias("lon"))
