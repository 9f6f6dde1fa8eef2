"""Queries on node, plant and regulation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteweave.functions import costs
from siteweave.functions.text import class_of, json_array, json_map, normalised, zone_of
from siteweave.operators import allocation, cleaning, spatial_joins, transmission
from siteweave.plans.registry import LINES, NATIONS, ORDERS, PLANTS, REGIONS, SITES, View, query
from siteweave.sources import tables as sources

PARTS = View("part", {"gid": "p_partkey", "name": "p_name", "brand": "p_brand", "kind": "p_type", "size": "p_size", "price": "p_retailprice"})


@query("SELECT nation, name, plant, capacity FROM {plants} QUALIFY row_number() OVER (PARTITION BY nation, name ORDER BY capacity DESC, plant) = 1", plants=PLANTS)
def dedupe_keep_first(plants):
    return cleaning.keep_first(plants, ["nation", "name"], [F.desc("capacity"), F.col("plant")]).select("nation", "name", "plant", "capacity")


@query("SELECT gid, trim(replace(replace(lower(concat(' ', name, '-', region)), '-', ' '), '_', ' ')) AS name FROM {nations}", nations=NATIONS)
def normalize_regulations(nations):
    return nations.select("gid", normalised(F.concat(F.lit(" "), "name", F.lit("-"), F.col("region").cast("string"))).alias("name"))


@query("""
SELECT gid, CASE gid % 5 WHEN 0 THEN region * 1e0 WHEN 1 THEN region * (100e0 + 60e0) WHEN 2 THEN region * 120e0 WHEN 3 THEN region * 100e0 END AS meters FROM {nations} WHERE gid % 5 <> 4
""", nations=NATIONS)
def setback_value_case(nations):
    kinds = F.array(*[F.lit(x) for x in ("Meters", "Max-tip Height Multiplier", "Rotor_Diameter Multiplier", "Hub-height Multiplier", "Other")])
    table = nations.select("gid", F.lit("Structures").alias("feature type"), F.get(kinds, F.col("gid") % 5).alias("value type"), F.col("region").cast("double").alias("value"))
    rules = cleaning.regulations(table).withColumnRenamed("Gid", "gid")
    value = cleaning.setback_value(F.col("Value Type"), F.col("Value"), hub=100.0, rotor=120.0)
    return rules.select("gid", value.alias("meters")).dropna()


@query("""
WITH t AS (SELECT plant, concat(name, ' wind') AS name FROM {plants})
SELECT plant, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN concat(name, ' ', row_number() OVER (PARTITION BY name ORDER BY plant) - 1) ELSE name END AS name FROM t
""", plants=PLANTS)
def unique_names(plants):
    return cleaning.unique_names(plants, "name", [F.col("plant")], "wind").select("plant", "name")


@query("SELECT plant, capacity FROM {plants} WHERE plant IN (SELECT cust FROM {orders})", plants=PLANTS, orders=ORDERS)
def semi_missing(plants, orders):
    return cleaning.members(plants, orders.select(F.col("cust").alias("plant")), "plant").select("plant", "capacity")


@query("SELECT plant, capacity FROM {plants} WHERE plant NOT IN (SELECT cust FROM {orders} WHERE price > 450000)", plants=PLANTS, orders=ORDERS)
def anti_missing(plants, orders):
    return cleaning.members(plants, orders.filter("price > 450000").select(F.col("cust").alias("plant")), "plant", present=False).select("plant", "capacity")


@query("SELECT coalesce(p.plant, o.plant) AS plant, p.capacity, o.n FROM {plants} p FULL JOIN (SELECT cust + 5 AS plant, count(*) AS n FROM {orders} GROUP BY cust) o ON p.plant = o.plant", plants=PLANTS, orders=ORDERS)
def outer_plants(plants, orders):
    counts = orders.groupBy((F.col("cust") + 5).alias("plant")).agg(F.count("*").alias("n"))
    return plants.select("plant", "capacity").join(counts, "plant", "full")


@query("""
WITH a AS (SELECT nation AS node, sum(capacity) AS capacity, list(gid ORDER BY gid) AS gids FROM {sites} GROUP BY nation),
b AS (SELECT nation + 3 AS node, sum(capacity) AS capacity, list(plant ORDER BY plant) AS gids FROM {plants} GROUP BY nation),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT node, round(sum(capacity), 4) AS capacity, array_to_string(list_sort(flatten(list(gids))), ',') AS gids FROM u GROUP BY node
""", sites=SITES, plants=PLANTS)
def union_merge_extent(sites, plants):
    a = sites.groupBy(F.col("nation").alias("node")).agg(F.sum("capacity").alias("capacity"), F.collect_list("gid").alias("gids"))
    b = plants.groupBy((F.col("nation") + 3).alias("node")).agg(F.sum("capacity").alias("capacity"), F.collect_list("plant").alias("gids"))
    out = cleaning.merge_extents([a, b])
    return out.select("node", F.round("capacity", 4).alias("capacity"), F.array_join(F.transform("gids", lambda x: x.cast("string")), ",").alias("gids"))


@query("""
WITH ends AS (SELECT gid, unnest(lines) AS line FROM (SELECT gid, list(DISTINCT okey) AS lines FROM {lines} GROUP BY gid))
SELECT e.gid, min(voltage) AS min_volts, max(voltage) AS max_volts FROM ends e JOIN {orders} o ON e.line = o.gid GROUP BY e.gid HAVING max(voltage) >= 69
""", lines=LINES, orders=ORDERS)
def substation_voltage_range(lines, orders):
    return transmission.substation_voltages(lines.groupBy("gid").agg(F.collect_set("okey").alias("trans_gids")), orders)


@query("""
SELECT user_id AS gid, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY user_id
""", events=View("events", {"gid": "user_id", "props": "props"}))
def json_map_parse(events):
    parsed = events.select("gid", F.try_element_at(json_map(F.col("props"), "bigint"), F.lit("k")).alias("k"))
    return parsed.groupBy("gid").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("""
WITH t AS (SELECT gid, res_gid, 1 + line AS c FROM {lines}), s AS (SELECT gid, sum(c) AS total FROM t GROUP BY gid)
SELECT t.gid AS sc_gid, res_gid, sum(c) * 1e0 AS count, round(sum(c) / max(total) * 100, 6) AS capacity FROM t JOIN s USING (gid) GROUP BY t.gid, res_gid
""", lines=LINES)
def json_array_parse(lines):
    counted = lines.groupBy("gid", "res_gid").agg(F.sum(1 + F.col("line")).alias("c"))
    as_text = counted.groupBy(F.col("gid").alias("sc_gid")).agg(F.collect_list(F.struct("res_gid", "c")).alias("x"))
    text = as_text.select("sc_gid", F.lit(100.0).alias("capacity"), F.to_json(F.col("x.res_gid")).alias("res_gids"), F.to_json(F.col("x.c")).alias("gid_counts"))
    points = text.withColumn("res_gids", json_array(F.col("res_gids"))).withColumn("gid_counts", json_array(F.col("gid_counts"), "double"))
    return cleaning.flat_points(points).select("sc_gid", "res_gid", "count", F.round("capacity", 6).alias("capacity"))


@query("SELECT gid, count(DISTINCT res_gid) AS n FROM {lines} GROUP BY gid", lines=LINES)
def distinct_gids(lines):
    return lines.groupBy("gid").agg(F.countDistinct("res_gid").alias("n"))


@query(None, lines=LINES)
def approx_gid_count(lines):
    return lines.groupBy("gid").agg(F.approx_count_distinct("res_gid").alias("n"))


@query("SELECT gid, regexp_extract(lower(name), '[a-z]+_([0-9]+)', 1) AS digits, CAST(string_split(brand, '#')[2] AS INTEGER) AS class FROM (SELECT p_partkey AS gid, p_brand AS brand, concat('Zone_', p_size, '_x') AS name FROM part)", parts=PARTS)
def zone_and_class_parse(parts):
    named = parts.select("gid", F.concat(F.lit("zone s"), F.col("size").cast("string"), F.lit("x")).alias("zone"), F.translate("brand", "#", "_").alias("category"))
    return named.select("gid", F.substring(zone_of(F.col("zone")), 2, 9).alias("digits"), class_of(F.col("category")).alias("class"))


@query("SELECT n.gid, n.name, r.name AS super_region FROM {nations} n LEFT JOIN {regions} r USING (region)", nations=NATIONS, regions=REGIONS)
def state_super_region(nations, regions):
    states = nations.join(regions.withColumnRenamed("name", "super_region"), "region").select(F.concat(F.lit("St. "), F.translate("name", "0123456789_", "abcdefghijk")).alias("state"), "super_region")
    asked = nations.withColumn("state", F.upper(F.concat(F.lit("st "), F.translate("name", "0123456789_", "abcdefghijk"))))
    return cleaning.with_region_names(asked, states).select("gid", "name", "super_region")


@query("SELECT gid, cost, n_gids FROM (SELECT gid, lcoe AS cost, capacity, CAST(1 AS INTEGER) AS n_gids FROM {sites}) WHERE capacity > 500", sites=SITES)
def reeds_columns(sites):
    return cleaning.reeds_columns(sites.withColumn("capacity", F.when(F.col("capacity") > 500, F.col("capacity")).otherwise(0.0)), {"lcoe": "cost"}, ("n_gids",)).select("gid", "cost", "n_gids")


@query("""
WITH bad AS (SELECT DISTINCT res_gid FROM {lines} WHERE discount = 0) SELECT DISTINCT gid AS sc_gid FROM {lines} WHERE res_gid IN (SELECT res_gid FROM bad)
""", lines=LINES)
def points_with_missing(lines):
    points = lines.groupBy(F.col("gid").alias("sc_gid")).agg(F.collect_set("res_gid").alias("res_gids"))
    return cleaning.points_with_missing(points, lines.filter("discount = 0").select("res_gid"))


@query("""
WITH t AS (SELECT gid, res_gid, okey, line, actual, sum(actual) OVER (PARTITION BY gid ORDER BY price DESC, okey, line, res_gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {lines})
SELECT gid, okey, line, res_gid, least(actual, greatest(0, 5000 - coalesce(prev, 0))) AS built FROM t
""", lines=LINES)
def running_fill_buildout(lines):
    out = allocation.filled(lines.withColumn("wanted", F.lit(5000.0)), ["gid"], "actual", "wanted", [F.desc("price"), F.col("okey"), F.col("line"), F.col("res_gid")])
    return out.select("gid", "okey", "line", "res_gid", "built")


@query("""
WITH big AS (SELECT * FROM {plants} WHERE capacity >= 2000), small AS (SELECT * FROM {plants} WHERE capacity < 2000),
moved AS (
    SELECT b.plant AS node, s.plant AS member, s.capacity FROM small s, big b
    QUALIFY row_number() OVER (PARTITION BY s.plant ORDER BY sqrt(pow(s.lat - b.lat, 2) + pow(s.lon - b.lon, 2)), b.plant) = 1
), every AS (SELECT node, member, capacity FROM moved UNION ALL SELECT plant, plant, capacity FROM big)
SELECT node, round(sum(capacity), 4) AS capacity, count(*) AS n FROM every GROUP BY node
""", plants=PLANTS)
def merge_small_nodes(plants):
    out = allocation.merge_small(plants.withColumnRenamed("plant", "node"), 2000.0)
    return out.select("node", F.round("capacity", 4).alias("capacity"), F.size("members").cast("long").alias("n"))


@query("""
WITH RECURSIVE line AS (SELECT plant, nation, lat, lon, capacity / 50 AS wanted, row_number() OVER (PARTITION BY nation ORDER BY plant) AS place FROM {plants}),
state AS (
    SELECT nation, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS plant, gid, lat, lon, capacity, capacity AS free, CAST(0 AS DOUBLE) AS built FROM {sites}
    UNION ALL
    SELECT nation, place, plant, gid, lat, lon, capacity, free, least(free, greatest(0, wanted - coalesce(nearer, 0))) AS built
    FROM (
        SELECT *, sum(free) OVER (PARTITION BY nation ORDER BY distance, capacity DESC, gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS nearer
        FROM (
            SELECT s.nation, p.place, p.plant, s.gid, s.lat, s.lon, s.capacity, s.free - s.built AS free, p.wanted, sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)) AS distance
            FROM state s JOIN line p ON s.nation = p.nation AND p.place = s.place + 1
        )
    )
)
SELECT plant, gid, round(built, 6) AS built FROM state WHERE round(built, 6) > 0
""", plants=PLANTS, sites=SITES)
def sequential_builder(plants, sites):
    """In each nation plants in order of their number fill their nearest sites."""
    wanted = plants.select(F.col("nation").alias("market"), "plant", F.col("plant").alias("place"), "lat", "lon", (F.col("capacity") / 50).alias("wanted"))
    near = sites.select(F.col("nation").alias("market"), "gid", "lat", "lon", "capacity")
    return allocation.sequential_builds(wanted, near).withColumn("built", F.round("built", 6)).filter("built > 0")


@query("""
WITH RECURSIVE line AS (SELECT plant, nation, lat, lon, capacity / 100 AS wanted, row_number() OVER (PARTITION BY nation ORDER BY plant) AS place FROM {plants}),
held AS (SELECT nation, gid, lat, lon, i AS res_gid, round(capacity / (2 + (gid * 5 + i) % 4), 2) AS capacity, sum(round(capacity / (2 + (gid * 5 + i) % 4), 2)) OVER (PARTITION BY gid) AS whole
    FROM (SELECT *, unnest([gid * 10, gid * 10 + 1, nation * 100000 + 7]) AS i FROM {sites})),
state AS (
    SELECT nation, CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS plant, gid, res_gid, lat, lon, capacity, whole, FALSE AS closed, CAST(0 AS DOUBLE) AS built FROM held
    UNION ALL
    SELECT nation, place, plant, gid, res_gid, lat, lon, capacity, whole, closed OR bool_or(used > 0) OVER (PARTITION BY res_gid), used AS built
    FROM (
        SELECT *, least(free, greatest(0, wanted - coalesce(sum(free) OVER (PARTITION BY nation ORDER BY distance, whole DESC, gid, capacity DESC, res_gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used
        FROM (
            SELECT *, CASE WHEN closed OR row_number() OVER (PARTITION BY res_gid ORDER BY distance, whole DESC, gid) > 1 THEN 0 ELSE capacity END AS free
            FROM (SELECT s.nation, p.place, p.plant, s.gid, s.res_gid, s.lat, s.lon, s.capacity, s.whole, s.closed, p.wanted, sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)) AS distance FROM state s JOIN line p ON s.nation = p.nation AND p.place = s.place + 1)
        )
    )
)
SELECT plant, gid, res_gid, round(built, 6) AS built FROM state WHERE round(built, 6) > 0
""", plants=PLANTS, sites=SITES)
def sequential_resources_unshared(plants, sites):
    """In each nation plants in order of their number draw the resources of their nearest points, each resource once; one resource is listed in all points of a nation."""
    wanted = plants.select(F.col("nation").alias("market"), "plant", F.col("plant").alias("place"), "lat", "lon", (F.col("capacity") / 100).alias("wanted"))
    listed = sites.withColumn("res_gid", F.explode(F.array(F.col("gid") * 10, F.col("gid") * 10 + 1, F.col("nation") * 100000 + 7)))
    held = listed.select(F.col("nation").alias("market"), "gid", "lat", "lon", F.col("res_gid").cast("long").alias("res_gid"), F.round(F.col("capacity") / (2 + (F.col("gid") * 5 + F.col("res_gid")) % 4), 2).alias("capacity"))
    return allocation.sequential_resource_builds(wanted, held, share=False).withColumn("built", F.round("built", 6)).filter("built > 0")


def _nearest_of_nation(plants, sites, k):
    here = [F.col("lat"), F.col("lon")]
    near = spatial_joins.nearest(plants, sites, here, here, "plant", "gid", k, by="nation")
    return near.select("plant", "gid", F.round("distance", 6).alias("distance"), F.lit(0.0).alias("bus_distance"))


@query("""
WITH a AS (
    SELECT p.plant, s.gid, p.capacity / 50 AS wanted, s.capacity AS free, round(sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)), 6) AS distance
    FROM {plants} p JOIN {sites} s USING (nation) QUALIFY row_number() OVER (PARTITION BY p.plant ORDER BY sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)), s.gid) = 1
), b AS (SELECT *, coalesce(sum(wanted) OVER (PARTITION BY gid ORDER BY distance, plant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM a)
SELECT plant, gid, round(least(wanted, greatest(0, free - prev)), 4) AS built FROM b WHERE least(wanted, greatest(0, free - prev)) > 0
""", plants=PLANTS, sites=SITES)
def contention_round(plants, sites):
    asked = _nearest_of_nation(plants, sites, 1).join(plants.select("plant", (F.col("capacity") / 50).alias("wanted")), "plant")
    return allocation.contention_round(asked, sites.select("gid", "capacity")).withColumn("built", F.round("built", 4))


@query("""
WITH RECURSIVE ranked AS (
    SELECT plant, gid, distance, wanted, free, row_number() OVER (PARTITION BY plant ORDER BY distance, gid) AS turn
    FROM (SELECT p.plant, s.gid, p.capacity / 50 AS wanted, s.capacity AS free, round(sqrt(pow(p.lat - s.lat, 2) + pow(p.lon - s.lon, 2)), 6) AS distance FROM {plants} p JOIN {sites} s USING (nation))
), rounds AS (
    SELECT 0 AS n, *, CAST(0 AS DOUBLE) AS built FROM ranked
    UNION ALL
    SELECT n + 1, plant, gid, distance, wanted - sum(now) OVER (PARTITION BY plant), free - sum(now) OVER (PARTITION BY gid), turn, now FROM (
        SELECT *, CASE WHEN asks THEN least(wanted, greatest(0, free - coalesce(sum(CASE WHEN asks THEN wanted ELSE 0 END) OVER (PARTITION BY gid ORDER BY distance, plant ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) ELSE 0 END AS now
        FROM (SELECT *, turn = n + 1 AND wanted > 1e-9 AS asks FROM rounds WHERE n < (SELECT max(turn) FROM ranked))
    )
)
SELECT plant, gid, round(built, 6) AS built FROM rounds WHERE round(built, 6) > 0
""", plants=PLANTS, sites=SITES)
def greedy_round_allocation(plants, sites):
    """Each plant asks the sites of its nation in turn, nearest first, until all that it wants is built or no site is left."""
    wanted = plants.select("nation", "plant", "lat", "lon", (F.col("capacity") / 50).alias("capacity"))
    builds, _ = allocation.greedy_builds(wanted, sites, "nation", k=4)
    return builds.withColumn("built", F.round("built", 6)).filter("built > 0")


@query("""
WITH t AS (SELECT gid, okey, line, res_gid, actual, coalesce(sum(actual) OVER (PARTITION BY gid ORDER BY actual DESC, okey, line, res_gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM {lines}),
u AS (SELECT *, least(actual, greatest(0, 777.5e0 - prev)) AS used FROM t)
SELECT gid, okey, line, res_gid, used, CAST(ceil(used / actual * (line + 3)) AS BIGINT) AS n_used FROM u WHERE used > 0
""", lines=LINES)
def drawn_resources(lines):
    table = lines.withColumnRenamed("actual", "capacity").withColumn("count", F.col("line") + 3).withColumn("wanted", F.lit(777.5))
    out = allocation.drawn(table, ["gid"], "wanted", [F.desc("capacity"), F.col("okey"), F.col("line"), F.col("res_gid")])
    return out.select("gid", "okey", "line", "res_gid", "used", "n_used")


@query("SELECT gid, 90000 - sum(actual) AS short FROM {lines} GROUP BY gid HAVING 90000 - sum(actual) > 1e-6", lines=LINES)
def unfilled_requests(lines):
    return allocation.unfilled(lines.withColumn("wanted", F.lit(90000.0)), ["gid"], "actual", "wanted")


@query("""
SELECT plant, CAST(CASE plant % 6 WHEN 0 THEN 102 WHEN 1 THEN 205 WHEN 2 THEN 400 WHEN 3 THEN 1500 WHEN 4 THEN 3000 END AS INTEGER) AS mw,
       CAST(CASE plant % 6 WHEN 0 THEN 69 WHEN 1 THEN 138 WHEN 2 THEN 230 WHEN 3 THEN 500 WHEN 4 THEN 500 END AS INTEGER) AS kv
FROM {plants}
""", plants=PLANTS)
def capacity_class_parse(plants):
    names = F.array(*[F.lit(x) for x in ("100MW", "200", "400MW", "1000", "3000MW", "7MW")])
    mw = costs.line_megawatts(F.get(names, (F.col("plant") % 6).cast("int")))
    return plants.select("plant", mw.alias("mw"), costs.line_kilovolts(mw).alias("kv"))


@query("""
SELECT gid, CAST(NULL AS DOUBLE) AS cost, capacity FROM {sites} UNION ALL SELECT plant, capacity * 2, NULL FROM {plants} WHERE name NOT IN ('MACHINERY', 'BUILDING')
""", sites=SITES, plants=PLANTS)
def union_result_files(sites, plants):
    a = sites.select("gid", "capacity", F.lit("site").alias("category"))
    b = plants.select(F.col("plant").alias("gid"), (F.col("capacity") * 2).alias("cost"), F.col("name").alias("category"))
    return transmission.merge_results([a, b], ("MACHINERY", "BUILDING")).select("gid", "cost", "capacity")


@query("""
WITH s AS (SELECT nation AS region, gid AS cluster FROM {sites}) SELECT CASE WHEN region < 10 THEN 'low-' ELSE 'high-' END || cluster AS cluster, region FROM s
""", sites=SITES)
def prefixed_clusters(sites):
    table = sites.select(F.col("gid").alias("cluster"), F.col("nation").alias("region"))
    return cleaning.prefixed_clusters({"low": table.filter("region < 10"), "high": table.filter("region >= 10")})


@query("SELECT p.plant, p.capacity FROM {plants} p WHERE nation < 5 UNION ALL SELECT plant, capacity FROM {plants} WHERE capacity > 5000 AND plant NOT IN (SELECT plant FROM {plants} WHERE nation < 5)", plants=PLANTS)
def added_lines(plants):
    return cleaning.added_lines(plants.filter("nation < 5").select("plant", "capacity"), plants.filter("capacity > 5000"), "plant")


@query("SELECT gid FROM {sites} JOIN (SELECT plant AS gid, lat, lon FROM {plants}) p USING (gid) WHERE abs({sites}.lat - p.lat) > 5 OR abs({sites}.lon - p.lon) > 5".replace("FROM {sites}", "FROM {sites} s").replace("{sites}.", "s."), sites=SITES, plants=PLANTS)
def coordinate_disagreement(sites, plants):
    return cleaning.disagreeing(sites, plants.withColumnRenamed("plant", "gid"), "gid", ["lat", "lon"], 5.0)


@query("SELECT gid, coalesce(CAST(n AS DOUBLE), capacity) AS capacity FROM {sites} LEFT JOIN (SELECT nation AS gid, count(*) AS n FROM {plants} GROUP BY nation) USING (gid)", sites=SITES, plants=PLANTS)
def updated_capacities(sites, plants):
    new = plants.groupBy(F.col("nation").alias("gid")).agg(F.count("*").cast("double").alias("capacity"))
    return sources.update_columns(sites.select("gid", "capacity"), new, "gid", ["capacity"])
