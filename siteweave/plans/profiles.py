"""Queries on profiles: correlation, stability, resampling, forecasts, directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.operators import clustering
from siteweave.operators import timeseries as ts
from siteweave.plans.registry import LINES, PROFILES, SITES, SOLAR, VECTORS, WIND, View, query
from siteweave.streaming import streams

PAIRS = """
pairs AS (
    SELECT gid, ts, solar, wind FROM (SELECT gid, ts, sum(value) AS solar FROM {solar} GROUP BY gid, ts)
    JOIN (SELECT gid, ts, sum(value) AS wind FROM {wind} GROUP BY gid, ts) USING (gid, ts)
)"""
CORR = "covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0)"


def hourly_pairs(solar: DataFrame, wind: DataFrame) -> DataFrame:
    total = lambda df: df.groupBy("gid", "ts").agg(F.sum("value").alias("value"))
    return ts.align(total(solar), total(wind))


@query(f"""
WITH {PAIRS}, g AS (SELECT gid, year(ts) AS y, month(ts) AS m, dayofyear(ts) AS d, hour(ts) AS h, solar, wind FROM pairs),
a AS (
    SELECT gid, y, m, d, h, grouping(y) AS gy, grouping(m) AS gm, grouping(d) AS gd, grouping(h) AS gh,
           {CORR.format(a='solar', b='wind')} AS c, count(*) AS n
    FROM g GROUP BY GROUPING SETS ((gid, y), (gid, m), (gid, d), (gid, h), (gid, m, h))
)
SELECT gid, round(c, 6) AS corr, n,
       CASE WHEN gm = 0 AND gh = 0 THEN 'month-hour' WHEN gm = 0 THEN 'month' WHEN gh = 0 THEN 'hour' WHEN gd = 0 THEN 'doy' ELSE 'year' END AS grouping,
       CASE WHEN gm = 0 AND gh = 0 THEN strftime(make_date(2001, m, 1), '%b') || '-' || printf('%02d:00UTC', h)
            WHEN gm = 0 THEN strftime(make_date(2001, m, 1), '%b') WHEN gh = 0 THEN printf('%02d:00UTC', h)
            WHEN gd = 0 THEN CAST(d AS VARCHAR) ELSE CAST(y AS VARCHAR) END AS label
FROM a
""", solar=SOLAR, wind=WIND)
def hybrid_corr_grouping_sets(solar, wind):
    return ts.correlations(hourly_pairs(solar, wind)).withColumn("corr", F.round("corr", 6))


@query(f"""
WITH {PAIRS}, r AS (
    SELECT gid, rank() OVER (PARTITION BY gid ORDER BY solar) + (count(*) OVER (PARTITION BY gid, solar) - 1) / 2e0 AS a,
           rank() OVER (PARTITION BY gid ORDER BY wind) + (count(*) OVER (PARTITION BY gid, wind) - 1) / 2e0 AS b FROM pairs
)
SELECT gid, round({CORR.format(a='a', b='b')}, 6) AS spearman FROM r GROUP BY gid
""", solar=SOLAR, wind=WIND)
def hybrid_spearman(solar, wind):
    return ts.spearman(hourly_pairs(solar, wind), ["gid"]).withColumn("spearman", F.round("spearman", 6))


TAU = "round(sum(a * b) / nullif(sqrt(sum(abs(a))) * sqrt(sum(abs(b))), 0), 6)"
SIGNS = "sign(x.solar - y.solar) AS a, sign(x.wind - y.wind) AS b"


@query(f"""
WITH {PAIRS}, s AS (SELECT x.gid, {SIGNS} FROM pairs x JOIN pairs y ON x.gid = y.gid AND x.ts < y.ts)
SELECT p.gid, {TAU} AS tau FROM (SELECT DISTINCT gid FROM pairs) p LEFT JOIN s ON p.gid = s.gid GROUP BY p.gid
""", solar=SOLAR, wind=WIND)
def hybrid_kendall(solar, wind):
    """Tau-b of all pairs of hours of each site."""
    return ts.kendall(hourly_pairs(solar, wind), ["gid"]).withColumn("tau", F.round("tau", 6))


@query(f"""
WITH {PAIRS}, h AS (SELECT *, CAST(hour(ts) AS INTEGER) AS hour FROM pairs), s AS (SELECT x.gid, x.hour, {SIGNS} FROM h x JOIN h y ON x.gid = y.gid AND x.hour = y.hour AND x.ts < y.ts)
SELECT p.gid, p.hour, {TAU} AS tau FROM (SELECT DISTINCT gid, hour FROM h) p LEFT JOIN s ON p.gid = s.gid AND p.hour = s.hour GROUP BY p.gid, p.hour
""", solar=SOLAR, wind=WIND)
def site_kendall(solar, wind):
    """Tau-b of the times of each site at each hour of day."""
    return ts.kendall(hourly_pairs(solar, wind).withColumn("hour", F.hour("ts")), ["gid", "hour"]).withColumn("tau", F.round("tau", 6))


def mirrored(vectors: DataFrame) -> DataFrame:
    """Each profile beside its own reversal."""
    back = vectors.select("gid", (63 - F.col("idx")).alias("idx"), F.col("value").alias("wind"))
    return vectors.withColumnRenamed("value", "solar").join(back, ["gid", "idx"])


LAGGED = """
WITH p AS (SELECT a.gid, a.idx, a.value AS solar, b.value AS wind FROM {vectors} a JOIN {vectors} b ON a.gid = b.gid AND b.idx = 63 - a.idx),
z AS (
    SELECT gid, idx, (solar - avg(solar) OVER w) / nullif(stddev_pop(solar) OVER w, 0) AS za, (wind - avg(wind) OVER w) / nullif(stddev_pop(wind) OVER w, 0) AS zb
    FROM p WINDOW w AS (PARTITION BY gid)
), lags AS (
    SELECT a.gid, m AS lag, sum(a.za * b.zb) / 63 AS corr FROM z a, (SELECT unnest(range(-50, 51)) AS m) JOIN z b ON a.gid = b.gid AND (b.idx + m + 128) % 64 = a.idx GROUP BY a.gid, m
)"""


@query(LAGGED + "SELECT gid, CAST(lag AS INTEGER) AS lag, round(corr, 6) AS corr FROM lags", vectors=VECTORS)
def lag_cross_correlation(vectors):
    return ts.lag_correlations(mirrored(vectors), 64, range(-50, 51)).withColumn("corr", F.round("corr", 6))


@query(LAGGED + "SELECT gid, CAST(arg_max(lag, struct_pack(a := round(corr, 9), b := -lag)) AS INTEGER) AS optimal_lag, round(max(round(corr, 9)), 6) AS corr FROM lags GROUP BY gid", vectors=VECTORS)
def optimal_lag(vectors):
    lagged = ts.lag_correlations(mirrored(vectors), 64, range(-50, 51)).withColumn("corr", F.round("corr", 9))
    return ts.best_lag(lagged).withColumn("corr", F.round("corr", 6))


@query(f"""
WITH {PAIRS}, m AS (SELECT gid, ts, solar, wind, (solar * (1 + gid) + wind * 5) / (6 + gid) AS mix FROM pairs),
d AS (
    SELECT gid, CAST(ts AS DATE) AS day, sqrt(var_pop(mix) * count(mix)) AS sm, sqrt(var_pop(solar) * count(solar)) AS sr, avg(mix) AS um, avg(solar) AS ur
    FROM m GROUP BY gid, CAST(ts AS DATE)
)
SELECT gid, CAST(year(day) AS INTEGER) AS year, CAST(month(day) AS INTEGER) AS month, round(avg(1 - (sm / nullif(sr, 0)) * (ur / nullif(um, 0))), 6) AS stability,
       round(avg(ur), 6) AS reference_mean, round(avg(um), 6) AS mix_mean
FROM d GROUP BY gid, year(day), month(day)
""", solar=SOLAR, wind=WIND)
def stability_coefficient(solar, wind):
    pairs = hourly_pairs(solar, wind)
    capacities = pairs.select("gid").distinct().select("gid", (F.col("gid") + 1).cast("double").alias("cap_a"), F.lit(5.0).alias("cap_b"))
    out = ts.stability(ts.capacity_mix(pairs, capacities), groupings=("year", "month"))
    return out.select("gid", "year", "month", *[F.round(c, 6).alias(c) for c in ("stability", "reference_mean", "mix_mean")])


@query("SELECT gid, CAST(date_trunc('day', ts) AS VARCHAR) AS ts, round(avg(value), 6) AS value FROM {profiles} GROUP BY gid, date_trunc('day', ts)", profiles=PROFILES)
def temporal_resample_mean(profiles):
    return _shown(ts.resample(profiles, "1 day"))


@query("SELECT gid, CAST(date_trunc('month', ts) AS VARCHAR) AS ts, round(sum(value), 6) AS value FROM {profiles} GROUP BY gid, date_trunc('month', ts)", profiles=PROFILES)
def temporal_resample_sum(profiles):
    return _shown(ts.resample(profiles, "month", "sum"))


@query("SELECT gid, CAST(time_bucket(INTERVAL 6 HOUR, ts) AS VARCHAR) AS ts, round(avg(value), 6) AS value FROM {profiles} GROUP BY gid, time_bucket(INTERVAL 6 HOUR, ts)", profiles=PROFILES)
def temporal_resample_six_hours(profiles):
    return _shown(ts.resample(profiles, "6 hours"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("gid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 6).alias("value"))


@query("SELECT gid, CAST((idx - 5 - gid % 4 + 64) % 64 AS BIGINT) AS idx, value FROM {vectors}", vectors=VECTORS)
def local_time_roll(vectors):
    offsets = vectors.select("gid").distinct().select("gid", (F.lit(-5) - F.col("gid") % 4).alias("timezone"))
    return ts.local_roll(vectors, offsets, 64)


@query("""
WITH m AS (SELECT gid, (idx + 58) % 64 AS idx, CASE WHEN idx >= 6 THEN value END AS value FROM {vectors})
SELECT gid, CAST(idx AS BIGINT) AS idx, last_value(value IGNORE NULLS) OVER (PARTITION BY gid ORDER BY idx ROWS UNBOUNDED PRECEDING) AS value FROM m
""", vectors=VECTORS)
def tz_shift_ffill(vectors):
    return ts.shift_and_fill(vectors, 64, -6)


@query("""
WITH m AS (SELECT gid, (idx + 3) % 64 AS idx, CASE WHEN idx + 3 < 64 THEN value END AS value FROM {vectors})
SELECT gid, CAST(idx AS BIGINT) AS idx, first_value(value IGNORE NULLS) OVER (PARTITION BY gid ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM m
""", vectors=VECTORS)
def tz_shift_bfill(vectors):
    return ts.shift_and_fill(vectors, 64, 3)


FACTORS = "f AS (SELECT gid, sum(actual) / nullif(sum(forecast), 0) AS factor, max(actual) AS most FROM {lines} GROUP BY gid), c AS (SELECT l.*, least(forecast * factor, most) AS corrected FROM {lines} l JOIN f USING (gid))"


@query(f"WITH {FACTORS} SELECT okey, line, gid, res_gid, round(corrected, 6) AS corrected FROM c", lines=LINES)
def forecast_bias_correct(lines):
    return ts.bias_corrected(lines).select("okey", "line", "gid", "res_gid", F.round("corrected", 6).alias("corrected"))


@query(f"WITH {FACTORS} SELECT okey, line, gid, res_gid, round(actual * 0.75e0 + corrected * 0.25e0, 6) AS blend FROM c", lines=LINES)
def forecast_blend(lines):
    return ts.blended(lines, 0.25).select("okey", "line", "gid", "res_gid", F.round("blend", 6).alias("blend"))


@query(f"WITH {FACTORS} SELECT gid, round(avg(abs(corrected - actual)), 6) AS mae, round(100 * avg(abs(corrected - actual)) / nullif(max(actual), 0), 6) AS mae_percent FROM c GROUP BY gid", lines=LINES)
def forecast_mae(lines):
    out = ts.mean_absolute_error(ts.bias_corrected(lines), "corrected")
    return out.select("gid", F.round("mae", 6).alias("mae"), F.round("mae_percent", 6).alias("mae_percent"))


DIRECTIONS = View("events", {"gid": "user_id", "value": "value * 7 % 360", "weight": "1 + event_id % 3"})


@query("SELECT gid, round((degrees(atan2(sum(sin(radians(value)) * weight), sum(cos(radians(value)) * weight))) + 360) % 360, 6) AS direction FROM {directions} GROUP BY gid", directions=DIRECTIONS)
def circular_mean_direction(directions):
    return ts.circular_mean(directions, weight="weight").withColumn("direction", F.round("direction", 6))


@query("""
WITH s AS (SELECT gid, line, sum(actual) AS v FROM {lines} GROUP BY gid, line), d AS (SELECT gid, nation AS plant, capacity FROM {sites})
SELECT plant, line, round(sum(v * capacity), 3) AS value FROM s JOIN d USING (gid) GROUP BY plant, line
""", lines=LINES, sites=SITES)
def weighted_profile_sum(lines, sites):
    profiles = lines.groupBy("gid", F.col("line").alias("ts")).agg(F.sum("actual").alias("value"))
    out = ts.weighted_profiles(profiles, sites.select("gid", F.col("nation").alias("plant"), "capacity"))
    return out.select("plant", F.col("ts").alias("line"), F.round("value", 3).alias("value"))


@query("""
WITH p AS (SELECT event_type AS source, user_id AS gid, date_trunc('day', ts) AS ts, sum(value) AS value FROM events GROUP BY ALL),
s AS (SELECT * FROM (VALUES ('view', 0.5e0), ('click', 0.3e0), ('error', 0.2e0)) t(source, fraction))
SELECT gid, CAST(ts AS VARCHAR) AS ts, round(sum(value * fraction), 6) AS value, abs(sum(fraction) - 1) < 1e-6 AS complete FROM p JOIN s USING (source) GROUP BY gid, ts
""", events=View("events", {"source": "event_type", "gid": "user_id", "ts": "date_trunc('day', ts)", "value": "value"}))
def dpv_blend(events):
    shares = events.sparkSession.createDataFrame([("view", 0.5), ("click", 0.3), ("error", 0.2)], "source string, fraction double")
    daily = events.groupBy("source", "gid", "ts").agg(F.sum("value").alias("value"))
    out = ts.blended_sources(daily, shares)
    return out.select("gid", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("value", 6).alias("value"), "complete")


@query("""
WITH o AS (SELECT gid, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY gid ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY gid ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM {profiles}),
s AS (SELECT gid, ts, sum(new) OVER (PARTITION BY gid ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT gid, CAST(date_trunc('second', min(ts)) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY gid, k
""", profiles=PROFILES)
def session_windows(profiles):
    out = streams.sessions(profiles, "6 hours")
    return out.select("gid", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""
WITH p AS (SELECT gid, value, time_bucket(INTERVAL 12 HOUR, ts) AS b FROM {profiles}), w AS (SELECT gid, value, b AS start FROM p UNION ALL SELECT gid, value, b - INTERVAL 12 HOUR FROM p)
SELECT gid, CAST(start AS VARCHAR) AS start, round(avg(value), 6) AS mean FROM w GROUP BY gid, start
""", profiles=PROFILES)
def sliding_window_means(profiles):
    out = streams.sliding_means(profiles, "24 hours", "12 hours")
    return out.select("gid", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.round("mean", 6).alias("mean"))


@query("SELECT user_id AS gid, round(min(value), 6) AS low, round(max(value) - min(value * 3 + 1), 6) AS spread FROM events GROUP BY user_id", profiles=PROFILES)
def user_statistics(profiles):
    out = ts.with_statistics(profiles.withColumn("other", F.col("value") * 3 + 1), ["gid"], {"low": lambda a, b: F.min(a), "spread": lambda a, b: F.max(a) - F.min(b)}, "value", "other")
    return out.select("gid", F.round("low", 6).alias("low"), F.round("spread", 6).alias("spread"))


@query("SELECT gid, CAST(idx // 8 AS BIGINT) AS idx, CAST(3 AS INTEGER) AS level, round(sum(value), 6) AS value FROM {vectors} GROUP BY gid, idx // 8 UNION ALL SELECT gid, CAST(idx // 4 AS BIGINT), 2, round(sum(value), 6) FROM {vectors} GROUP BY gid, idx // 4 UNION ALL SELECT gid, CAST(idx // 2 AS BIGINT), 1, round(sum(value), 6) FROM {vectors} GROUP BY gid, idx // 2", vectors=VECTORS)
def block_sums_by_level(vectors):
    return clustering.sums_by_level(vectors, 3).withColumn("value", F.round("value", 6))


@query("SELECT f.gid, CAST(f.ts AS VARCHAR) AS ts, CAST(a.ts AS VARCHAR) AS actual_ts, round(f.value - a.value, 6) AS error FROM {solar} f JOIN {wind} a ON f.gid = a.gid AND a.ts >= f.ts AND a.ts <= f.ts + INTERVAL 2 HOUR", solar=SOLAR, wind=WIND)
def forecast_actual_join(solar, wind):
    """Each forecast with the actual values of the next two hours, as the join of two streams gives them."""
    # Times are written out once for each row and not for each pair.
    solar, wind = (df.withColumn(name, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) for df, name in ((solar, "at"), (wind, "actual_at")))
    out = streams.forecast_errors(solar, wind, "2 hours")
    return out.select("gid", F.col("at").alias("ts"), F.col("actual_at").alias("actual_ts"), F.round("error", 6).alias("error"))
