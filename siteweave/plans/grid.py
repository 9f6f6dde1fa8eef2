"""Queries on transmission costs, paths and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.functions import costs
from siteweave.operators import burning, clustering, relaxation, routing, spur_lines, transmission
from siteweave.plans.registry import CELLS, LINES, NATIONS, ORDERS, PLANTS, SITES, VECTORS, View, query

FEATURES = View("orders", {
    "gid": "o_orderkey", "region": "CAST(1 + o_orderkey % 4 AS INT)", "dist_km": "(o_orderkey * 37 % 3000) / 1e2",
    "category": "CASE o_orderpriority WHEN '1-URGENT' THEN 'TransLine' WHEN '2-HIGH' THEN 'Substation' WHEN '3-MEDIUM' THEN 'LoadCen' WHEN '4-NOT SPECIFIED' THEN 'PCALoadCen' ELSE 'Substation' END",
    "min_volts": "CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 69 WHEN 1 THEN 138 ELSE 345 END", "max_volts": "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 69 WHEN 1 THEN 230 WHEN 2 THEN 345 ELSE 500 END",
    "raw_line_cost": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END", "poi": "o_custkey",
})
STEP = "CASE WHEN {d} < 4.828032e0 THEN 1.5e0 WHEN {d} <= 16.09344e0 THEN 1.2e0 ELSE 1e0 END"
LINEAR = "CASE WHEN {d} <= 16.09344e0 THEN -0.5e0 / (16.09344e0 - 2.414016e0) * ({d} - 16.09344e0) + 1 ELSE 1e0 END"


@query(f"SELECT gid, {STEP.format(d='dist_km')} AS length_mult FROM {{features}}", features=FEATURES)
def length_mult_step(features):
    return features.select("gid", costs.length_multiplier(F.col("dist_km"), "step").alias("length_mult"))


@query(f"SELECT gid, round({LINEAR.format(d='dist_km')}, 9) AS length_mult FROM {{features}}", features=FEATURES)
def length_mult_linear(features):
    return features.select("gid", F.round(costs.length_multiplier(F.col("dist_km"), "linear"), 9).alias("length_mult"))


CONNECTED = """
x AS (SELECT * FROM (VALUES (69, 4970e0), (115, 4970e0), (138, 4970e0), (161, 5230e0), (230, 7110e0), (345, 6100e0), (500, 7490e0)) t(kv, cost)),
n AS (SELECT * FROM (VALUES (1, 9171000e0, 5500000e0), (2, 17525000e0, 3975000e0), (3, 9700000e0, 2200000e0), (4, 5732000e0, 2210000e0)) t(region, fresh, upgrade)),
c AS (
    SELECT f.*, CASE WHEN (category = 'TransLine' AND max_volts < 230) OR min_volts <= 230 OR region = 1 THEN 0 ELSE (SELECT cost FROM x WHERE kv = (SELECT coalesce(min(kv), 500) FROM x WHERE kv >= max_volts)) END AS per_mw,
           CASE WHEN category IN ('Substation', 'LoadCen') THEN upgrade ELSE 0 END AS up, CASE WHEN category = 'TransLine' THEN fresh ELSE 0 END AS fr
    FROM {features} f JOIN n USING (region)
), k AS (SELECT *, CASE WHEN category = 'PCALoadCen' THEN 1e11 ELSE per_mw * 400 + up + fr END AS connection FROM c)"""


@query(f"WITH {CONNECTED} SELECT gid, per_mw * 1e0 AS xformer_cost_per_mw, up * 1e0 AS sub_upgrade_cost, fr * 1e0 AS new_sub_cost, connection AS connection_cost FROM k", features=FEATURES)
def connection_costs(features):
    return transmission.connection_costs(features, "400MW").select("gid", "xformer_cost_per_mw", "sub_upgrade_cost", "new_sub_cost", "connection_cost")


@query(f"""
WITH {CONNECTED}, t AS (
    SELECT *, CASE WHEN dist_km < 5 THEN raw_line_cost * CASE WHEN dist_km > 1e-9 THEN 5 / dist_km ELSE 1 END ELSE raw_line_cost END AS raw, greatest(dist_km, 5e0) AS km FROM k
), u AS (SELECT *, CASE WHEN category = 'TransLine' AND (raw IS NULL OR max_volts < 230) THEN 1e12 ELSE raw * {LINEAR.format(d='km')} END AS tie FROM t)
SELECT gid, round(tie, 2) AS tie_line_cost, round(tie + connection, 2) AS trans_cap_cost FROM u WHERE tie IS NOT NULL
""", features=FEATURES)
def trans_cap_total(features):
    out = transmission.total_costs(features, "400MW", 5.0)
    return out.select("gid", F.round("tie_line_cost", 2).alias("tie_line_cost"), F.round("trans_cap_cost", 2).alias("trans_cap_cost"))


@query("SELECT poi, gid, dist_km FROM {features} QUALIFY row_number() OVER (PARTITION BY poi ORDER BY dist_km, gid) = 1", features=FEATURES)
def min_reinforcement_per_poi(features):
    return transmission.cheapest(features, "poi", "dist_km", "gid").select("poi", "gid", "dist_km")


@query("""
WITH r AS (SELECT gid AS poi, round(sum(price), 2) AS reinforcement_cost, count(*) AS n FROM {lines} GROUP BY gid)
SELECT f.gid, f.poi, r.reinforcement_cost, r.n FROM {features} f JOIN r USING (poi)
""", features=FEATURES, lines=LINES)
def merge_reinforcement(features, lines):
    reinforcement = lines.groupBy(F.col("gid").alias("poi")).agg(F.round(F.sum("price"), 2).alias("reinforcement_cost"), F.count("*").alias("n"))
    return transmission.merge_reinforcement(features.select("gid", "poi"), reinforcement, "poi", ["reinforcement_cost", "n"])


@query("SELECT row, col, CASE WHEN land > 7 THEN price * 1e-9 ELSE price END AS routing, CASE WHEN land > 7 THEN price / 400 ELSE price / 1500 END * 0.5e0 AS charged FROM {cells}", cells=CELLS)
def reinforced_cell_costs(cells):
    out = transmission.reinforced_cell_costs(cells.withColumn("line_capacity", F.when(F.col("land") > 7, 400.0)), "price", 1500.0)
    return out.select("row", "col", "routing", "charged")


@query("SELECT row, col, CASE WHEN (slope + 1) * (1 + CASE WHEN land = 0 THEN 100 ELSE 0 END) > 0 AND size > 3 THEN (slope + 1) * (1 + CASE WHEN land = 0 THEN 100 ELSE 0 END) ELSE -1 END AS routing FROM {cells}", cells=CELLS)
def routing_surface(cells):
    cost = F.when(F.col("size") > 3, F.col("slope") + 1).otherwise(0.0)
    return transmission.routing_costs(cells, cost, F.lit(0.0), F.when(F.col("land") == 0, 1.0)).select("row", "col", "routing")


RELAX = """
WITH RECURSIVE c AS (SELECT row, col, row * 50 + col AS id, CASE WHEN size > 3 THEN slope + 1 ELSE -1 END AS cost FROM {cells}),
g AS (SELECT * FROM c WHERE cost > 0),
e AS (SELECT a.id AS a, b.id AS b, (a.cost + b.cost) / 2 * sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) AS w FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
d(id, best) USING KEY (id) AS (
    SELECT id, CAST(0 AS DOUBLE) FROM g WHERE row % 20 = 7 AND col % 20 = 9
    UNION
    SELECT e.b, min(d.best + e.w) FROM d JOIN e ON d.id = e.a LEFT JOIN recurring.d AS r ON r.id = e.b WHERE r.best IS NULL OR d.best + e.w < r.best - 1e-12 GROUP BY e.b
)"""


def _surface(cells: DataFrame) -> DataFrame:
    return cells.select("row", "col", F.when(F.col("size") > 3, F.col("slope") + 1).otherwise(-1.0).alias("routing"))


@query(RELAX + "SELECT c.row, c.col, round(best, 6) AS best FROM c JOIN d ON c.id = d.id", cells=CELLS)
def grid_least_cost(cells):
    surface = _surface(cells)
    best = relaxation.relaxed_costs(surface, surface.filter("row % 20 = 7 AND col % 20 = 9 AND routing > 0"))
    return best.filter("best is not null").withColumn("best", F.round("best", 6))


@query(RELAX + "SELECT c.id AS path, round(best, 6) AS cost, best > 0 AS moves FROM c JOIN d ON c.id = d.id WHERE c.row % 3 = 1", cells=CELLS)
def whole_raster_paths(cells):
    """What the cells of the traced path from every third row to the nearest source cost together, all steps between neighbours."""
    surface = _surface(cells)
    sources = surface.filter("row % 20 = 7 AND col % 20 = 9 AND routing > 0")
    ends = surface.filter("row % 3 = 1").select((F.col("row") * 50 + F.col("col")).alias("path"), "row", "col")
    out = relaxation.path_costs(relaxation.whole_raster_paths(surface, sources, ends, tile=32), surface)
    return out.filter("longest < 1.5").select("path", F.round("cost", 6).alias("cost"), (F.col("cells") > 1).alias("moves"))


@query(RELAX + """, l AS (SELECT gid, gid * 2 + 0.5e0 AS x1, gid % 9 + 0.25e0 AS y1, gid * 2 + 7.75e0 AS x2, gid % 9 + 3.5e0 AS y2 FROM {nations}),
k AS (
    SELECT DISTINCT l.gid, c.row, c.col FROM l JOIN c ON floor(x1) = c.col AND floor(y1) = c.row OR floor(x2) = c.col AND floor(y2) = c.row
        OR x1 <= c.col + 0.5e0 AND x2 > c.col + 0.5e0 AND floor(y1 + (c.col + 0.5e0 - x1) / (x2 - x1) * (y2 - y1)) = c.row
)
SELECT k.gid, k.row, k.col, round(d.best, 6) AS best FROM k JOIN c ON k.row = c.row AND k.col = c.col JOIN d ON d.id = c.id
QUALIFY row_number() OVER (PARTITION BY k.gid ORDER BY round(d.best, 6), k.row, k.col) = 1
""", cells=CELLS, nations=NATIONS)
def cheapest_line_cells(cells, nations):
    """Where each nation's line is reached most cheaply from the nearest source: lines become cells, of which the cheapest counts."""
    surface = _surface(cells)
    best = relaxation.relaxed_costs(surface, surface.filter("row % 20 = 7 AND col % 20 = 9 AND routing > 0"))
    lines = nations.select("gid", (F.col("gid") * 2 + 0.5).alias("x1"), (F.col("gid") % 9 + 0.25).alias("y1"), (F.col("gid") * 2 + 7.75).alias("x2"), (F.col("gid") % 9 + 3.5).alias("y2"))
    reached = burning.burned_lines(lines, burning.Grid(400, 50), shape="gid").join(best, ["row", "col"]).filter("best IS NOT NULL")
    first = reached.groupBy("gid").agg(F.min(F.struct(F.round("best", 6).alias("best"), "row", "col")).alias("m"))
    return first.select("gid", "m.row", "m.col", "m.best")


@query("""
WITH RECURSIVE c AS (SELECT row, col, row * 50 + col AS id, land > 1 AS sea FROM {cells}), g AS (SELECT * FROM c WHERE sea),
e AS (SELECT a.id AS a, b.id AS b, 90 * sqrt(pow(a.row - b.row, 2) + pow(a.col - b.col, 2)) AS w FROM g a JOIN g b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
d(id, best) USING KEY (id) AS (
    SELECT id, CAST(0 AS DOUBLE) FROM g WHERE row % 30 = 4 AND col % 25 = 11
    UNION
    SELECT e.b, min(d.best + e.w) FROM d JOIN e ON d.id = e.a LEFT JOIN recurring.d AS r ON r.id = e.b WHERE r.best IS NULL OR d.best + e.w < r.best - 1e-12 GROUP BY e.b
)
SELECT c.row, c.col, round(coalesce(best / 1000, -1), 6) AS km FROM c LEFT JOIN d ON c.id = d.id
""", cells=CELLS)
def port_distance_min(cells):
    ocean = cells.select("row", "col", F.when(F.col("land") > 1, 1.0).otherwise(0.0).alias("dist_to_coast"))
    ports = ocean.filter("row % 30 = 4 AND col % 25 = 11 AND dist_to_coast > 0").select("row", "col")
    return routing.port_distances(ocean, ports).withColumn("km", F.round("km", 6))


def _placed(df: DataFrame, gid: str, height: int, name: str = "source") -> DataFrame:
    """Rows spread over the raster by their number."""
    return df.withColumn("row", (F.col(gid) * 17 % height).cast("int")).withColumn("col", (F.col(gid) * 29 % 50).cast("int")).withColumnRenamed(gid, name)


def _height(cells: DataFrame) -> int:
    return (cells.agg(F.max("row")).first()[0] or 0) + 1


def _varied(cells: DataFrame) -> DataFrame:
    """A surface on which hardly two ways cost the same."""
    return cells.select("row", "col", "land", F.when(F.col("size") > 3, F.col("slope") + 1 + F.col("price") / 7919).otherwise(-1.0).alias("cost")).withColumn("routing", F.col("cost"))


def _targets(placed: DataFrame, height: int) -> DataFrame:
    each = placed.withColumn("target", F.explode(F.array(F.lit(5), F.lit(11))))
    return each.select("source", "target", F.least(F.col("row") + F.col("target"), F.lit(height - 1)).alias("row"), F.least(F.col("col") + 6, F.lit(49)).alias("col"))


#: From tables s (source, row, col) and w (source, row, col, radius): the least costs inside each source's window, with the length and charge of the way.
WAYS = """
c AS (SELECT row, col, land, CASE WHEN size > 3 THEN slope + 1 + price / 7919e0 ELSE -1 END AS cost FROM {{cells}}), h AS (SELECT max(row) + 1 AS n FROM c),
{places},
g AS (SELECT w.source, c.row, c.col, c.row * 50 + c.col AS id, {routing} AS cost, {charge} AS charge FROM c JOIN w ON abs(c.row - w.row) <= radius AND abs(c.col - w.col) <= radius WHERE cost > 0),
e AS (
    SELECT a.source, a.id AS a, b.id AS b, l, (a.cost + b.cost) / 2 * l AS w, (a.charge + b.charge) / 2 * l AS f
    FROM (SELECT a.*, r, k, sqrt(r * r + k * k) AS l FROM g a, (SELECT unnest([-1, 0, 1]) AS r), (SELECT unnest([-1, 0, 1]) AS k) WHERE r <> 0 OR k <> 0) a JOIN g b ON a.source = b.source AND b.row = a.row + r AND b.col = a.col + k
),
d(source, id, best, len, charged) USING KEY (source, id) AS (
    SELECT g.source, id, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM g JOIN s ON g.source = s.source AND g.row = s.row AND g.col = s.col
    UNION
    SELECT e.source, e.b, min(d.best + e.w), arg_min(d.len + e.l, d.best + e.w), arg_min(d.charged + e.f, d.best + e.w) FROM d JOIN e ON d.source = e.source AND d.id = e.a LEFT JOIN recurring.d AS r ON r.source = e.source AND r.id = e.b
    WHERE r.best IS NULL OR d.best + e.w < r.best - 1e-12 GROUP BY e.source, e.b
)"""
SITE_PLACES = """s AS (SELECT gid AS source, gid * 17 % n AS row, gid * 29 % 50 AS col FROM {sites}, h),
t AS (SELECT source, CAST(k AS INTEGER) AS target, least(row + k, n - 1) AS row, least(col + 6, 49) AS col FROM s, h, (SELECT unnest([5, 11]) AS k)),
w AS (SELECT s.source, s.row, s.col, ceil(max(greatest(abs(t.row - s.row), abs(t.col - s.col))) * 1.3e0) AS radius FROM s JOIN t ON s.source = t.source GROUP BY s.source, s.row, s.col)"""


@query("WITH RECURSIVE " + WAYS.format(places=SITE_PLACES, routing="cost", charge="cost").replace("{{", "{").replace("}}", "}") + """
SELECT t.source, t.target, round(len * 0.09e0, 6) AS dist_km, round(best, 6) AS cost, round(best, 6) AS cost_cost, round(len * 0.09e0, 6) AS cost_km FROM t JOIN d ON d.source = t.source AND d.id = t.row * 50 + t.col
""", cells=CELLS, sites=SITES)
def least_cost_path_totals(cells, sites):
    """Each site's paths to two places on the raster, with length and cost."""
    height, surface = _height(cells), _varied(cells)
    placed = _placed(sites.select("gid"), "gid", height)
    paths = routing.least_cost_paths(surface, placed, _targets(placed, height), buffer=1.3)
    out = routing.path_totals(paths, surface, ["cost"])
    return out.select("source", "target", *[F.round(c, 6).alias(c) for c in ("dist_km", "cost", "cost_cost", "cost_km")])


POINTS = """s AS (SELECT gid AS source, gid * 17 % n AS row, gid * 29 % 50 AS col FROM {sites}, h), w AS (SELECT *, 5 AS radius FROM s),
q AS (
    SELECT plant AS gid, plant * 17 % n AS row, plant * 29 % 50 AS col, CAST(1 + plant % 4 AS INTEGER) AS region,
           CASE plant % 4 WHEN 0 THEN 'TransLine' WHEN 1 THEN 'Substation' WHEN 2 THEN 'LoadCen' ELSE 'PCALoadCen' END AS category,
           CASE plant % 3 WHEN 0 THEN 69 WHEN 1 THEN 138 ELSE 345 END AS min_volts, CASE plant % 5 WHEN 0 THEN 69 WHEN 1 THEN 230 ELSE 500 END AS max_volts FROM {plants}, h
),
features AS (
    SELECT s.source, q.gid, q.region, q.category, q.min_volts, q.max_volts, q.row * 50 + q.col AS id FROM s JOIN q ON pow(q.row - s.row, 2) + pow(q.col - s.col, 2) <= 16
)"""


def _features(plants: DataFrame, height: int) -> DataFrame:
    number = F.col("plant")
    kinds = plants.select(
        "plant", (1 + number % 4).cast("int").alias("region"), F.get(F.array(*[F.lit(x) for x in ("TransLine", "Substation", "LoadCen", "PCALoadCen")]), (number % 4).cast("int")).alias("category"),
        F.get(F.array(F.lit(69), F.lit(138), F.lit(345)), (number % 3).cast("int")).alias("min_volts"), F.get(F.array(F.lit(69), F.lit(230), F.lit(500), F.lit(500), F.lit(500)), (number % 5).cast("int")).alias("max_volts"),
    )
    return _placed(kinds, "plant", height, "gid")


@query("WITH RECURSIVE " + WAYS.format(places=POINTS, routing="cost", charge="cost").replace("{{", "{").replace("}}", "}") + "," + CONNECTED.replace("{features}", "ways").replace("c AS (\n    SELECT f.*", "cc AS (\n    SELECT f.*").replace("FROM c)", "FROM cc)").replace("\nx AS", "\nways AS (SELECT f.*, coalesce(len * 9e-1, 0) AS dist_km, best AS raw_line_cost FROM features f LEFT JOIN d ON d.source = f.source AND d.id = f.id),\nx AS") + f""", r AS (
    SELECT *, CASE WHEN dist_km < 5.76e0 THEN raw_line_cost * CASE WHEN dist_km > 1e-9 THEN 5.76e0 / dist_km ELSE 1 END ELSE raw_line_cost END AS raw, greatest(dist_km, 5.76e0) AS km FROM k
), u AS (SELECT *, CASE WHEN category = 'TransLine' AND (raw IS NULL OR max_volts < 230) THEN 1e12 ELSE raw * {LINEAR.format(d='km')} END AS tie FROM r)
SELECT source, gid, round(km, 6) AS dist_km, round(tie, 3) AS tie_line_cost, round(tie + connection, 2) AS trans_cap_cost FROM u WHERE tie IS NOT NULL
""", cells=CELLS, sites=SITES, plants=PLANTS)
def supply_point_costs(cells, sites, plants):
    """Every site's ways to all features within four cells, with tie-line, connection and total costs."""
    height, surface = _height(cells), _varied(cells)
    points = _placed(sites.select("gid"), "gid", height)
    out = spur_lines.supply_point_costs(surface, points, _features(plants, height), "400MW", radius=4, buffer=1.25, cell_km=0.9)
    return out.select("source", "gid", F.round("dist_km", 6).alias("dist_km"), F.round("tie_line_cost", 3).alias("tie_line_cost"), F.round("trans_cap_cost", 2).alias("trans_cap_cost"))


@query(None, cells=CELLS, sites=SITES, plants=PLANTS)
def nearest_sink_costs(cells, sites, plants):
    """Every site's ways to the features within the reach of its two nearest sinks."""
    height, surface = _height(cells), _varied(cells)
    out = spur_lines.supply_point_costs(surface, _placed(sites.select("gid"), "gid", height), _features(plants, height), "400MW", cell_km=0.9)
    return out.select("source", "gid", "dist_km", "tie_line_cost", "trans_cap_cost")


NODES = """s AS (SELECT gid AS source, gid * 17 % n AS row, gid * 29 % 50 AS col FROM {nations}, h),
t AS (SELECT nation AS source, gid AS target, gid * 13 % n AS row, gid * 31 % 50 AS col FROM {sites}, h),
w AS (SELECT s.source, s.row, s.col, ceil(max(greatest(abs(t.row - s.row), abs(t.col - s.col))) * 1.05e0) AS radius FROM s JOIN t ON s.source = t.source GROUP BY s.source, s.row, s.col)"""


@query("WITH RECURSIVE " + WAYS.format(places=NODES, routing="CASE WHEN land > 7 THEN cost * 1e-9 ELSE cost END", charge="CASE WHEN land > 7 THEN cost / 400 ELSE cost / 1500 END * 0.5e0").replace("{{", "{").replace("}}", "}") + """
SELECT t.source AS gid, t.target AS poi, round(len * 0.09e0, 6) AS dist_km, round(charged, 9) AS reinforcement_cost FROM t JOIN d ON d.source = t.source AND d.id = t.row * 50 + t.col
QUALIFY row_number() OVER (PARTITION BY t.source ORDER BY charged, t.target) = 1
""", cells=CELLS, nations=NATIONS, sites=SITES)
def reinforcement_paths(cells, nations, sites):
    """The cheapest way from each nation's node to a site of the nation."""
    height = _height(cells)
    surface = _varied(cells).withColumn("line_capacity", F.when(F.col("land") > 7, 400.0)).filter("cost > 0")
    nodes = _placed(nations.select("gid", F.col("gid").alias("region")).withColumnRenamed("gid", "g"), "g", height, "gid")
    substations = sites.select("gid", (F.col("gid") * 13 % height).cast("int").alias("row"), (F.col("gid") * 31 % 50).cast("int").alias("col"), F.col("nation").alias("region"))
    out = spur_lines.reinforcement(surface, nodes, substations, 1500.0)
    return out.select("gid", "poi", F.round("dist_km", 6).alias("dist_km"), F.round("reinforcement_cost", 9).alias("reinforcement_cost"))


@query("SELECT s.gid, CAST(greatest(0, least(s.gid * 7 - 50, 399)) AS INTEGER) AS row, CAST(s.gid % 50 AS INTEGER) AS col FROM {sites} s WHERE s.gid % 2 = 0 OR s.gid * 7 - 50 BETWEEN 0 AND 399", sites=SITES)
def features_in_raster(sites):
    placed = sites.select("gid", (F.col("gid") * 7 - 50).cast("int").alias("row"), (F.col("gid") % 50).cast("int").alias("col"), F.when(F.col("gid") % 2 == 0, "TransLine").otherwise("Substation").alias("category"))
    return routing.in_raster(placed, 400, 50, lines=True).select("gid", "row", "col")


@query("SELECT a.gid AS source, b.gid AS target FROM {sites} a JOIN {sites} b ON a.nation = b.nation AND a.gid < b.gid", sites=SITES)
def all_pairs_of_set(sites):
    placed = sites.select(F.col("nation").alias("set"), "gid", F.col("gid").cast("int").alias("row"), F.col("gid").cast("int").alias("col"))
    return routing.all_pairs(placed)[1].select("source", "target")


@query("SELECT gid, CAST(gid * 17 % 20 AS INTEGER) AS row, CAST(gid * 29 % 50 AS INTEGER) AS col, c.price AS start_cost FROM {sites} s LEFT JOIN {cells} c ON s.gid * 17 % 20 = c.row AND s.gid * 29 % 50 = c.col", sites=SITES, cells=CELLS)
def starting_costs(sites, cells):
    out = spur_lines.starting_costs(_placed(sites.select("gid"), "gid", 20), cells, "price")
    return out.select(F.col("source").alias("gid"), "row", "col", "start_cost")


@query("""
WITH RECURSIVE m AS (SELECT CAST(row * 50 + col AS BIGINT) AS gid, row, col, region AS cluster FROM {cells}),
e AS (SELECT a.gid AS a, b.gid AS b FROM m a JOIN m b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.gid <> b.gid AND a.cluster = b.cluster),
l(id, label) USING KEY (id) AS (
    SELECT gid, gid FROM m
    UNION
    SELECT e.a, min(l.label) FROM l JOIN e ON l.id = e.b JOIN recurring.l AS r ON r.id = e.a WHERE l.label < r.label GROUP BY e.a
), p AS (SELECT gid, row, col, cluster, label FROM m JOIN l ON m.gid = l.id),
k AS (SELECT cluster, label FROM p GROUP BY cluster, label QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, label) = 1),
stay AS (SELECT p.* FROM p JOIN k ON p.cluster = k.cluster AND p.label = k.label),
moved AS (
    SELECT p.gid, s.cluster FROM p JOIN stay s ON abs(p.row - s.row) <= 50 WHERE p.gid NOT IN (SELECT gid FROM stay)
    QUALIFY row_number() OVER (PARTITION BY p.gid ORDER BY sqrt(pow(p.row - s.row, 2) + pow(p.col - s.col, 2)), s.gid) = 1
)
SELECT gid, cluster FROM stay UNION ALL SELECT gid, cluster FROM moved
""", cells=View("part", {"row": "CAST(floor(p_partkey / 5e1) AS INT)", "col": "CAST(p_partkey % 50 AS INT)", "region": "CAST(p_size % 3 AS INT)"}))
def contiguous_clusters(cells):
    sites = cells.select((F.col("row") * 50 + F.col("col")).cast("long").alias("gid"), "row", "col", F.col("region").alias("cluster"))
    return clustering.contiguous_clusters(sites, drop_islands=False)


@query(None, vectors=VECTORS, sites=View("embeddings", {"gid": "vec_id", "lat": "(vec_id * 37 % 100) / 1e1", "lon": "(vec_id * 91 % 70) / 1e1", "row": "CAST(floor(vec_id / 2e1) AS INT)", "col": "CAST(vec_id % 20 AS INT)", "region": "CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END"}))
def clustering_pipeline(vectors, sites):
    """Both regions clustered, settled, made contiguous and ranked."""
    return clustering.clustered_regions(sites, vectors, {"even": 3, "odd": 4})


RANKED = """
m AS (SELECT v.gid, label AS cluster, idx, value FROM {vectors} v JOIN (SELECT vec_id AS gid, label FROM embeddings) USING (gid)),
a AS (SELECT cluster, idx, avg(value) AS mean FROM m GROUP BY cluster, idx),
e AS (SELECT gid, cluster, sqrt(avg(pow(value - mean, 2))) AS rmse FROM m JOIN a USING (cluster, idx) GROUP BY gid, cluster),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(rmse, 9), gid) - 1 AS rank FROM e)"""
LABELS = View("embeddings", {"gid": "vec_id", "cluster": "label"})


@query(f"WITH {RANKED} SELECT gid, cluster, round(rmse, 6) AS rmse, CAST(rank AS INTEGER) AS rank FROM r", vectors=VECTORS, labels=LABELS)
def cluster_rank(vectors, labels):
    return clustering.cluster_ranks(vectors.join(labels, "gid")).withColumn("rmse", F.round("rmse", 6))


@query(f"WITH {RANKED} SELECT cluster, r.gid, CAST(rank AS INTEGER) AS rank, idx, value FROM r JOIN {{vectors}} v ON r.gid = v.gid WHERE rank < 2", vectors=VECTORS, labels=LABELS)
def representative_profile(vectors, labels):
    ranks = clustering.representatives(clustering.cluster_ranks(vectors.join(labels, "gid")), 2)
    return ranks.select("cluster", "gid", "rank").join(vectors, "gid")


@query(f"WITH {RANKED} SELECT gid, cluster, CASE WHEN gid % 3 <> 0 THEN CAST(row_number() OVER (PARTITION BY cluster, gid % 3 <> 0 ORDER BY rank) - 1 AS INTEGER) END AS rank_included FROM r", vectors=VECTORS, labels=LABELS)
def rank_after_exclusions(vectors, labels):
    return clustering.reranked(clustering.cluster_ranks(vectors.join(labels, "gid")), F.col("gid") % 3 != 0, ["cluster"]).select("gid", "cluster", "rank_included")


@query("SELECT nation AS cluster, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, round(avg(lcoe / 100), 6) AS fraction, count(*) AS n, round(sum(capacity), 4) AS area FROM {sites} GROUP BY nation", sites=SITES)
def cluster_summary(sites):
    members = sites.select("gid", F.col("nation").alias("cluster"), "lat", "lon", (F.col("lcoe") / 100).alias("fraction"), F.col("capacity").alias("area"))
    out = clustering.summary(members)
    return out.select("cluster", *[F.round(c, 6).alias(c) for c in ("lat", "lon", "fraction")], "n", F.round("area", 4).alias("area"))


@query("""
WITH s AS (SELECT DISTINCT gid, gid * 37 % 100 / 1e1 AS lat, gid * 91 % 70 / 1e1 AS lon FROM {vectors}), l AS (SELECT vec_id AS gid, label AS cluster FROM embeddings),
c AS (SELECT cluster, avg(lat) AS clat, avg(lon) AS clon FROM s JOIN l USING (gid) GROUP BY cluster),
m AS (SELECT cluster, idx, avg(value) AS mean FROM {vectors} JOIN l USING (gid) GROUP BY cluster, idx),
e AS (SELECT v.gid, m.cluster, sqrt(avg(pow(v.value - m.mean, 2))) AS rmse FROM {vectors} v JOIN m USING (idx) GROUP BY v.gid, m.cluster),
b AS (SELECT s.gid, c.cluster, sqrt(pow(lat - clat, 2) + pow(lon - clon, 2)) AS dist, rmse FROM s, c JOIN e ON e.gid = s.gid AND e.cluster = c.cluster),
n AS (SELECT min(dist) AS ld, max(dist) AS hd, min(rmse) AS lr, max(rmse) AS hr FROM b)
SELECT gid, cluster FROM b, n QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(pow((dist - ld) / (hd - ld), 2) + pow((rmse - lr) / (hr - lr), 2), 9), cluster) = 1
""", vectors=VECTORS, labels=LABELS)
def dist_rank_assign(vectors, labels):
    sites = vectors.select("gid").distinct().select("gid", (F.col("gid") * 37 % 100 / 10.0).alias("lat"), (F.col("gid") * 91 % 70 / 10.0).alias("lon"))
    return clustering.reassigned(sites, vectors, labels)


@query("""
WITH p AS (SELECT gid, idx // 2 AS k, sum(value * 1e2 * CASE WHEN idx % 2 = 0 THEN 1 ELSE 1 END) / sqrt(2e0) AS a, sum(value * 1e2 * CASE WHEN idx % 2 = 0 THEN 1 ELSE -1 END) / sqrt(2e0) AS d FROM {vectors} GROUP BY gid, idx // 2)
SELECT gid, CAST(k AS INTEGER) AS idx, CAST(round(a) AS INTEGER) AS coefficient FROM p UNION ALL SELECT gid, CAST(32 + k AS INTEGER), CAST(round(d) AS INTEGER) FROM p
""", vectors=VECTORS)
def haar_level1(vectors):
    arrays = vectors.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).select("gid", F.transform("v", lambda x: x["value"] * 100).alias("v"))
    out = clustering.haar_coefficients(arrays, "v", 1)
    return out.select("gid", F.posexplode("coefficients").alias("idx", "coefficient"))


@query(None, vectors=VECTORS)
def kmeans_labels(vectors):
    arrays = vectors.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("v")).select("gid", F.transform("v", lambda x: x["value"]).alias("v"))
    return clustering.kmeans_labels(arrays, "gid", "v", 5)
