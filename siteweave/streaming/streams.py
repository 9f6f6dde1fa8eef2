"""The grouped time-series operators over streams, joins of streams, and state that starts from a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from siteweave.operators.timeseries import resample


def profile_stream(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """Rows of the parquet files that arrive in a folder, at most so many files in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def resample_stream(profiles: DataFrame, width: str = "1 hour", late: str = "1 day", method: str = "mean") -> DataFrame:
    """``resample`` with rows up to ``late`` behind; later ones are dropped by the watermark."""
    return resample(profiles.withWatermark("ts", late), width, method)


def sliding_means(profiles: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(gid, start, mean) of overlapping windows."""
    grouped = profiles.withWatermark("ts", late).groupBy("gid", F.window("ts", width, step).alias("w"))
    return grouped.agg(F.avg("value").alias("mean")).select("gid", F.col("w.start").alias("start"), "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(gid, start, end, n): runs of events without a longer gap."""
    grouped = events.withWatermark("ts", late).groupBy("gid", F.session_window("ts", gap).alias("s"))
    return grouped.agg(F.count("*").alias("n")).select("gid", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def write_parquet(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to parquet files, with its progress in the checkpoint folder; stops when all that has arrived is written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def forecast_errors(forecasts: DataFrame, actuals: DataFrame, within: str = "10 minutes", late: str = "1 hour", how: str = "inner") -> DataFrame:
    """(gid, ts, forecast, actual_ts, actual, error): each forecast with the actual values of its gid up to ``within`` after it.

    Both are (gid, ts, value), streams or tables. Rows up to ``late`` behind
    count, later ones are dropped; state is kept only as long as a partner can
    come. With ``leftOuter`` a forecast without a partner comes once none can
    come any more. Rows with nulls in gid or ts have no partner. An inner join
    meets through spans of time as long as ``within``, so that no two rows of a
    gid meet whose times are far apart. Further columns stay; none may be in both.
    """
    more = [c for df in (forecasts, actuals) for c in df.columns if c not in ("gid", "ts", "value")]
    f = forecasts.select(F.col("gid"), F.col("ts"), F.col("value").alias("forecast"), *[c for c in forecasts.columns if c in more]).withWatermark("ts", late)
    a = actuals.select(F.col("gid").alias("actual_gid"), F.col("ts").alias("actual_ts"), F.col("value").alias("actual"), *[c for c in actuals.columns if c in more]).withWatermark("actual_ts", late)
    near = F.expr(f"gid = actual_gid AND actual_ts >= ts AND actual_ts <= ts + INTERVAL {within}")
    if how == "inner":
        width = F.greatest(F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {within})"), F.lit(1))
        span = lambda at: F.floor(F.unix_micros(at) / width)
        f = f.withColumn("span", F.explode(F.sequence(span(F.col("ts")), span(F.expr(f"ts + INTERVAL {within}")))))
        a, near = a.withColumn("actual_span", span(F.col("actual_ts"))), near & (F.col("span") == F.col("actual_span"))
        if not (f.isStreaming or a.isStreaming):
            # The pairs are many more than the rows, whose bytes Spark goes by when it joins small partitions.
            n = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            f, a = f.repartition(n, "gid", "span"), a.repartition(n, "actual_gid", "actual_span")
    return f.join(a, near, how).select("gid", "ts", "forecast", "actual_ts", "actual", (F.col("forecast") - F.col("actual")).alias("error"), *more)


class RemainingCapacity(StatefulProcessor):
    """Serves requests (gid, ts, wanted) from what a site has left; requests after it closes get nothing. State starts from a table (gid, capacity, closes); unknown sites give nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.site = handle, handle.getValueState("site", "left double, closes long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        """The table's row of a site; of several the first, a null capacity is none."""
        row = initialState.iloc[0]
        closes = None if pd.isna(row["closes"]) else int(row["closes"].timestamp() * 1000)
        self.site.update((0.0 if pd.isna(row["capacity"]) else float(row["capacity"]), closes))
        if closes is not None:
            self.handle.registerTimer(closes)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        left, closes = self.site.get() or (0.0, None)
        for part in rows:
            out = []
            # Requests of a batch come in order of time, the smaller one first of equals.
            for ts, wanted in part.sort_values(["ts", "wanted"])[["ts", "wanted"]].itertuples(index=False):
                shut = closes is not None and ts.timestamp() * 1000 > closes
                built = 0.0 if shut or pd.isna(wanted) else min(left, max(0.0, float(wanted)))
                left -= built
                out.append((key[0], wanted, built, False))
            yield pd.DataFrame(out, columns=["gid", "wanted", "built", "closed"])
        self.site.update((left, closes))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The stream's time has passed the site's end: what it has left is told once."""
        left, closes = self.site.get() or (0.0, None)
        self.site.update((0.0, closes))
        yield pd.DataFrame({"gid": [key[0]], "wanted": [None], "built": [left], "closed": [True]}).astype({"wanted": "float64"})

    def close(self) -> None:
        pass


def remaining_capacity(requests: DataFrame, sites: DataFrame, late: str = "1 hour") -> DataFrame:
    """(gid, wanted, built, closed): what each request of a stream (gid, ts, wanted) gets of its site's capacity, and, closed, what a site has left when the stream's time has passed its ``closes``.

    sites: a table (gid, capacity, closes timestamp or null), spread over the
    state store by gid, so that any number of sites can have state. The session
    must keep state in RocksDB (``ROCKSDB``).
    """
    initial = sites.select("gid", F.col("capacity").cast("double").alias("capacity"), "closes").groupBy("gid")
    timed = requests.select("gid", "ts", F.col("wanted").cast("double").alias("wanted")).withWatermark("ts", late)
    kind = dict(requests.dtypes)["gid"]
    return timed.groupBy("gid").transformWithStateInPandas(RemainingCapacity(), f"gid {kind}, wanted double, built double, closed boolean", "Append", "EventTime", initial)


#: The setting under which state of this kind is kept.
ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
