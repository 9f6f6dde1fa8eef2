"""Queries with their SQL, and the logical tables both are built on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@dataclass(frozen=True)
class View:
    """A table's rows under columns whose expressions mean the same in Spark and DuckDB."""

    table: str
    columns: dict[str, str] = field(default_factory=dict)
    where: str = ""

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        out = out.where(self.where) if self.where else out
        return out.selectExpr(*[f"{e} AS {n}" for n, e in self.columns.items()])

    @property
    def sql(self) -> str:
        return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in self.columns.items())} FROM {self.table}{f' WHERE {self.where}' if self.where else ''})"


@dataclass(frozen=True)
class Matrix:
    """Embedding vectors as long profiles (gid, idx, value)."""

    where: str = "TRUE"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(self.where)
        return rows.selectExpr("vec_id AS gid", "posexplode(embedding) AS (idx, v)").selectExpr("gid", "CAST(idx AS BIGINT) AS idx", "CAST(v AS DOUBLE) AS value")

    @property
    def sql(self) -> str:
        return f"(SELECT gid, idx, CAST(e[idx + 1] AS DOUBLE) AS value FROM (SELECT vec_id AS gid, embedding AS e, unnest(range(0, len(embedding))) AS idx FROM embeddings WHERE {self.where}))"


def query(sql: str | None = None, **views: View | Matrix):
    """Registers f(spark, sf_dir, **tables) under its name, with its SQL in which {view} stands for a view's rows."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(**{n: v.df(spark, sf_dir) for n, v in views.items()})

        QUERIES[f.__name__] = run
        if sql:
            text = sql
            for n, v in views.items():
                text = text.replace("{" + n + "}", v.sql)
            ORACLES[f.__name__] = text
        return f

    return register


SITES = View("supplier", {
    "gid": "s_suppkey", "lat": "25 + (s_suppkey * 37 % 2400) / 1e2", "lon": "-124 + (s_suppkey * 91 % 5700) / 1e2",
    "timezone": "CAST(-5 - s_suppkey % 4 AS INT)", "capacity": "abs(s_acctbal)", "lcoe": "20 + (s_suppkey * 13 % 97) / 1e0", "nation": "s_nationkey",
})
PLANTS = View("customer", {
    "plant": "c_custkey", "lat": "26 + (c_custkey * 53 % 2300) / 1e2", "lon": "-123 + (c_custkey * 71 % 5500) / 1e2",
    "capacity": "abs(c_acctbal) + 1", "nation": "c_nationkey", "name": "c_mktsegment",
})
SOLAR = View("events", {"gid": "user_id % 10", "ts": "date_trunc('hour', ts)", "value": "value"}, "event_type = 'view'")
WIND = View("events", {"gid": "user_id % 10", "ts": "date_trunc('hour', ts)", "value": "value"}, "event_type = 'click'")
PROFILES = View("events", {"gid": "user_id", "ts": "ts", "value": "value"})
VECTORS = Matrix()
LINES = View("lineitem", {"gid": "l_suppkey", "res_gid": "l_partkey", "line": "l_linenumber", "okey": "l_orderkey", "actual": "l_quantity", "forecast": "l_extendedprice / 1e3", "discount": "l_discount", "tax": "l_tax", "price": "l_extendedprice", "ts": "l_shipdate"})
ORDERS = View("orders", {"gid": "o_orderkey", "cust": "o_custkey", "price": "o_totalprice", "priority": "o_orderpriority", "voltage": "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 69 WHEN 1 THEN 138 WHEN 2 THEN 230 WHEN 3 THEN 345 ELSE 500 END", "ts": "o_orderdate"})
CELLS = View("part", {
    "row": "CAST(floor(p_partkey / 5e1) AS INT)", "col": "CAST(p_partkey % 50 AS INT)", "size": "p_size", "price": "p_retailprice",
    "land": "CAST((p_partkey * 7919 % 1009) % 10 AS INT)", "region": "CAST(p_partkey % 5 AS INT)", "use_code": "CAST(CASE p_size % 8 WHEN 0 THEN 11 WHEN 1 THEN 21 WHEN 2 THEN 24 WHEN 3 THEN 41 WHEN 4 THEN 80 WHEN 5 THEN 90 ELSE 52 END AS INT)",
    "slope": "(p_size * 3 % 12) / 1e0", "fips": "CAST(floor(p_partkey / 5e2) AS INT)", "fraction": "(p_size % 5) / 4e0",
})
NATIONS = View("nation", {"gid": "n_nationkey", "name": "n_name", "region": "n_regionkey"})
REGIONS = View("region", {"region": "r_regionkey", "name": "r_name"})
