"""Exact percentiles by refinement, joins of streams, and state that starts from a table."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteweave.operators import quantiles
from siteweave.streaming import streams


def drawn(kind, n, rng):
    return {
        "uniform": lambda: [rng.uniform(-5, 5) for _ in range(n)],
        "ties": lambda: [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(n)],
        "spread": lambda: [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-200, 200) for _ in range(n)],
        "crowded": lambda: [1e9 + rng.random() * 1e-6 for _ in range(n - 1)] + [-1e12],
        "same": lambda: [3.5] * n,
    }[kind]()


@pytest.mark.parametrize("few", [1, 4096])
def test_percentiles_of_groups(spark, few):
    """As numpy says, however few values may be sorted and however values are spread."""
    rng = random.Random(3)
    groups = {k: drawn(k, n, rng) for k, n in (("uniform", 700), ("ties", 300), ("spread", 400), ("crowded", 500), ("same", 50))} | {"one": [2.0], "two": [1.0, 4.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("none", None), ("one", float("nan")), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r["k"]: [r[f"p{i}"] for i in range(5)] for r in quantiles.percentiles(df, "v", shares, ("k",), bins=256, few=few).collect()}
    assert found.pop("none") == [None] * 5 and found.keys() == groups.keys()
    for k, got in found.items():
        want = np.quantile(np.array(groups[k]), shares)
        assert np.allclose(got, want, rtol=1e-12, atol=0), k
        assert [got[0], got[-1]] == [min(groups[k]), max(groups[k])]


def test_percentiles_of_all_and_of_nothing(spark):
    df = spark.range(10_001).select((F.col("id") * 3 % 10_001).cast("double").alias("v"))
    assert quantiles.percentiles(df, "v", [0.5, 0.9], few=10).first().asDict() == {"p0": 5000.0, "p1": 9000.0}
    assert quantiles.percentiles(df, F.col("v") * 2, [0.1]).first()[0] == 2000.0
    assert quantiles.percentiles(df.limit(0), "v", [0.5]).first()[0] is None
    assert quantiles.percentiles(df.limit(0).withColumn("k", F.lit(1)), "v", [0.5], ("k",)).count() == 0


def test_ranks_outside_of_a_group(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 1.0)], "k int, v double")
    ranks = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, -1), (2, 0), (3, 0)], "k int, rank int")
    assert sorted(tuple(r) for r in quantiles.order_statistics(df, "v", ["k"], ranks).collect()) == [(1, 0, 3.0), (1, 1, 5.0), (2, 0, 1.0)]


def at(minute):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)


def parts(spark, folder, batches, schema):
    """One file a batch, in order of time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_forecasts_meet_actual_values(spark, tmp_path):
    """The stream gives the rows of the batch, without late ones; a forecast without a partner comes once none can come."""
    schema = "gid long, ts timestamp, value double"
    forecasts = [[(1, at(0), 5.0), (2, at(1), 7.0)], [(1, at(300), 6.0)], [(3, at(600), 1.0)], [(1, at(2), 9.0)]]
    actuals = [[(1, at(3), 4.0), (1, at(9), 4.5), (2, at(20), 7.0)], [(1, at(301), 6.5)], [(None, at(600), 1.0)], [(1, at(4), 1.0)]]
    f, a = (parts(spark, str(tmp_path / n), b, schema) for n, b in (("f", forecasts), ("a", actuals)))
    query = streams.forecast_errors(f, a, how="leftOuter").writeStream.format("memory").queryName("met").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    found = {(r["gid"], r["ts"], r["actual"]) for r in spark.table("met").collect()}
    # The pair of the last batch lies hours behind the stream's time: too late on both sides.
    assert {(1, at(0), 4.0), (1, at(0), 4.5), (1, at(300), 6.5), (2, at(1), None)} <= found
    assert not any(t == at(2) and v == 1.0 for _, t, v in found) and not any(v == 1.0 for _, _, v in found)
    whole = [spark.createDataFrame(sum(b, []), schema) for b in (forecasts, actuals)]
    batch = {(r["gid"], r["ts"], r["actual"]) for r in streams.forecast_errors(*whole).collect()}
    assert batch == {(1, at(0), 4.0), (1, at(0), 4.5), (1, at(0), 1.0), (1, at(2), 4.0), (1, at(2), 4.5), (1, at(2), 1.0), (1, at(300), 6.5)}


def test_remaining_capacity_starts_from_a_table(spark, tmp_path):
    """Sites keep what they have left between batches, close in the stream's time, and tell then what is left."""
    for k, v in streams.ROCKSDB.items():
        spark.conf.set(k, v)
    batches = [[(1, at(0), 4.0), (2, at(1), 1.0), (9, at(1), 1.0)], [(1, at(2), 4.0), (1, at(3), None), (2, at(2), 0.5)], [(3, at(500), 1.0)], [(2, at(501), 1.0), (1, at(501), 1.0), (3, at(502), 2.0)], [(3, at(900), 0.25)]]
    requests = parts(spark, str(tmp_path / "r"), batches, "gid long, ts timestamp, wanted double")
    sites = spark.createDataFrame([(1, 6.0, None), (2, 5.0, at(100)), (3, 2.5, None), (4, None, None)], "gid long, capacity double, closes timestamp")
    query = streams.remaining_capacity(requests, sites).writeStream.format("memory").queryName("left").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    spark.conf.unset(next(iter(streams.ROCKSDB)))
    out = spark.table("left").collect()
    built = {}
    for r in out:
        if not r["closed"]:
            built.setdefault(r["gid"], []).append(r["built"])
    assert sorted(built[1]) == [0.0, 0.0, 2.0, 4.0] and sorted(built[2]) == [0.0, 0.5, 1.0] and sorted(built[3]) == [0.0, 1.0, 1.5] and built[9] == [0.0]
    assert [(r["gid"], r["built"]) for r in out if r["closed"]] == [(2, 3.5)]


def test_forecasts_meet_actuals_of_near_times_only(spark):
    """Rows of a gid meet by spans of time, in the plan too; further columns stay."""
    day = [(g, f"2020-01-0{d} {h:02}:30:00", float(h)) for g in (1, 2) for d in (1, 2) for h in range(24)]
    table = spark.createDataFrame(day, "gid int, at string, value double").withColumn("ts", F.col("at").cast("timestamp"))
    out = streams.forecast_errors(table, table.drop("at"), "2 hours")
    assert "actual_span" in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 2 * (48 + 47 + 46) and "at" in out.columns
