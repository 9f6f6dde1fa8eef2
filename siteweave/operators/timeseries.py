"""Grouped statistics, resampling and forecast correction of long profiles (gid, ts, value)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Calendar parts by grouping name.
CALENDAR = {"year": F.year, "month": F.month, "doy": F.dayofyear, "hour": F.hour}
GROUPINGS = [("year",), ("month",), ("doy",), ("hour",), ("month", "hour")]


def align(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("solar", "wind")) -> DataFrame:
    """(gid, ts, a, b): both profiles at the times that they share."""
    a, b = (df.select("gid", "ts", F.col("value").alias(n)) for df, n in zip((left, right), names))
    return a.join(b, ["gid", "ts"])


def grouping_label() -> Column:
    """A name of a calendar group: Jan, 18:00UTC, Jan-18:00UTC, 2012, or the day of the year."""
    month = F.date_format(F.make_date(F.lit(2001), F.col("month"), F.lit(1)), "MMM")
    hour = F.format_string("%02d:00UTC", F.col("hour"))
    return F.when(F.col("grouping") == "month-hour", F.concat_ws("-", month, hour)).when(F.col("grouping") == "month", month).when(F.col("grouping") == "hour", hour).when(F.col("grouping") == "doy", F.col("doy").cast("string")).otherwise(F.col("year").cast("string"))


def by_calendar(df: DataFrame, groupings: list[tuple[str, ...]], aggregates: list[Column], keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """Aggregates of each key and calendar group, all groupings in one pass: columns grouping, label and the aggregates."""
    parts = [c for c in CALENDAR if any(c in g for g in groupings)]
    stamped = df.select("*", *[CALENDAR[c](F.col("ts")).alias(c) for c in parts])
    sets = [[F.col(k) for k in keys] + [F.col(c) for c in g] for g in groupings]
    level = F.concat_ws("-", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in parts])
    out = stamped.groupingSets(sets, *keys, *parts).agg(level.alias("grouping"), *aggregates)
    for c in CALENDAR:
        if c not in parts:
            out = out.withColumn(c, F.lit(None).cast("int"))
    return out.withColumn("label", grouping_label()).drop(*CALENDAR)


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation; null without variance."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def correlations(pairs: DataFrame, groupings: list[tuple[str, ...]] = GROUPINGS, a: str = "solar", b: str = "wind") -> DataFrame:
    """Pearson correlation of each site and calendar group."""
    return by_calendar(pairs, groupings, [safe_corr(F.col(a), F.col(b)).alias("corr"), F.count("*").alias("n")])


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2


def spearman(pairs: DataFrame, keys: list[str], a: str = "solar", b: str = "wind") -> DataFrame:
    """Rank correlation of each group."""
    ranked = pairs.select(*keys, average_rank(a, keys).alias("ra"), average_rank(b, keys).alias("rb"))
    return ranked.groupBy(*keys).agg(safe_corr(F.col("ra"), F.col("rb")).alias("spearman"))


def inversions(ranks: np.ndarray) -> int:
    """Pairs in which a larger whole number stands before a smaller one: of the two that first differ in a bit, the one with it comes first."""
    total, order = 0, ranks
    for bit in range(int(ranks.max(initial=0)).bit_length() - 1, -1, -1):
        order = order[np.argsort(order >> (bit + 1), kind="stable")]
        group, one = order >> (bit + 1), (order >> bit) & 1
        before = np.cumsum(one) - one
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        before -= np.repeat(before[begins], np.diff(np.append(begins, len(group))))
        total += int(before[one == 0].sum())
        # The order of the input inside a group is what counts on the next bit.
        order = order[np.argsort(order >> bit, kind="stable")]
    return total


def tau_b(a: np.ndarray, b: np.ndarray) -> float | None:
    """Kendall's tau-b of all pairs of two columns, in n log n steps; null without variance."""
    n = len(a)
    tied = lambda *columns: sum(int(c) * (int(c) - 1) // 2 for c in np.unique(np.stack(columns), axis=1, return_counts=True)[1]) if n else 0
    order = np.lexsort((b, a))
    discordant = inversions(np.unique(b, return_inverse=True)[1][order]) if n else 0
    pairs, in_a, in_b, in_both = n * (n - 1) // 2, tied(a), tied(b), tied(a, b)
    if pairs == in_a or pairs == in_b:
        return None
    return (pairs - in_a - in_b + in_both - 2 * discordant) / (float(pairs - in_a) ** 0.5 * float(pairs - in_b) ** 0.5)


def kendall(pairs: DataFrame, keys: list[str], a: str = "solar", b: str = "wind") -> DataFrame:
    """Kendall's tau-b of each group over all pairs of its rows; a task sorts one group, the times of a site. Rows with a null count for nothing; groups of one row, or without variance, have a null."""
    rows = pairs.select(*keys, F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna(subset=["a", "b"])

    def run(table: pa.Table) -> pa.Table:
        tau = tau_b(table["a"].to_numpy(), table["b"].to_numpy())
        return table.select(keys).slice(0, 1).append_column("tau", pa.array([tau], pa.float64()))

    return rows.groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {t}" for k, t in rows.dtypes if k in keys) + ", tau double")


def lag_correlations(pairs: DataFrame, steps: int, lags: range, index: str = "idx", a: str = "solar", b: str = "wind", compat: bool = False) -> DataFrame:
    """(gid, lag, corr): b rolled by each lag round a profile of ``steps`` values. compat divides b by its mean, not its deviation.

    A site's profile is one row of arrays and all its lags come from one
    Fourier transform, so profiles are shuffled once, however many lags.
    """
    sites = Window.partitionBy("gid")
    spread = F.avg(b) if compat else F.stddev_pop(b)
    scored = pairs.select(
        "gid", F.col(index).cast("int").alias("at"),
        F.try_divide(F.col(a) - F.avg(a).over(sites), F.stddev_pop(a).over(sites)).alias("za"),
        F.try_divide(F.col(b) - F.avg(b).over(sites), spread.over(sites)).alias("zb"),
    )
    rows = scored.groupBy("gid").agg(F.collect_list(F.struct("at", F.coalesce("za", F.lit(float("nan"))).alias("za"), F.coalesce("zb", F.lit(float("nan"))).alias("zb"))).alias("p")).select("gid", "p.at", "p.za", "p.zb")
    kind, wanted = dict(pairs.dtypes)["gid"], np.array(list(lags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            row, at = np.repeat(np.arange(len(batch)), sizes), np.asarray(batch.column(1).flatten()) % steps
            both = np.full((2, len(batch), steps), np.nan)
            for i in (0, 1):
                both[i, row, at] = np.asarray(batch.column(2 + i).flatten())
            empty = np.isnan(both).all(2).any(0)
            fa, fb = np.fft.rfft(np.nan_to_num(both))
            corr = np.fft.irfft(fa * np.conj(fb), steps)[:, wanted % steps] / (steps - 1)
            gids = batch.column(0).take(pa.array(np.repeat(np.arange(len(batch)), len(wanted))))
            yield pa.RecordBatch.from_arrays([gids, pa.array(np.tile(wanted, len(batch)), pa.int32()), pa.array(corr.ravel(), mask=np.repeat(empty, len(wanted)))], names=["gid", "lag", "corr"])

    return rows.mapInArrow(run, f"gid {kind}, lag int, corr double")


def best_lag(lagged: DataFrame) -> DataFrame:
    """(gid, optimal_lag, corr): the lag of the largest correlation, the smallest lag of equals."""
    best = F.max_by(F.struct("lag", "corr"), F.struct("corr", (-F.col("lag")).alias("l")))
    return lagged.groupBy("gid").agg(best.alias("b")).select("gid", F.col("b.lag").alias("optimal_lag"), F.col("b.corr").alias("corr"))


def capacity_mix(pairs: DataFrame, capacities: DataFrame, a: str = "solar", b: str = "wind") -> DataFrame:
    """Adds mix, the capacity-weighted mean of both profiles; capacities: (gid, cap_a, cap_b)."""
    return pairs.join(capacities, "gid").withColumn("mix", F.try_divide(F.col(a) * F.col("cap_a") + F.col(b) * F.col("cap_b"), F.col("cap_a") + F.col("cap_b")))


def stability(pairs: DataFrame, reference: str = "solar", groupings: tuple[str, ...] = ("year",)) -> DataFrame:
    """Mean over days of 1 - (mix deviation / reference deviation) (reference mean / mix mean); days without a finite value don't count."""
    deviation = lambda c: F.sqrt(F.var_pop(c) * F.count(c))
    daily = pairs.groupBy("gid", F.to_date("ts").alias("day")).agg(deviation(F.col("mix")).alias("sm"), deviation(F.col(reference)).alias("sr"), F.avg("mix").alias("um"), F.avg(reference).alias("ur"))
    each = daily.withColumn("s", 1 - F.try_divide(F.col("sm"), F.col("sr")) * F.try_divide(F.col("ur"), F.col("um")))
    return each.groupBy("gid", *[CALENDAR[g](F.col("day")).alias(g) for g in groupings]).agg(F.avg("s").alias("stability"), F.avg("ur").alias("reference_mean"), F.avg("um").alias("mix_mean"))


def resample(profiles: DataFrame, width: str = "1 day", method: str = "mean", keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """Mean or sum of each key in fixed windows, or calendar months or years; works on streams with a watermark too."""
    how = {"mean": F.avg, "sum": F.sum}[method]
    if width in ("month", "year"):
        return profiles.groupBy(*keys, F.date_trunc(width, "ts").alias("ts")).agg(how("value").alias("value"))
    return profiles.groupBy(*keys, F.window("ts", width).alias("w")).agg(how("value").alias("value")).select(*keys, F.col("w.start").alias("ts"), "value")


def local_roll(profiles: DataFrame, offsets: DataFrame, steps: int, per_hour: int = 1) -> DataFrame:
    """(gid, idx, value) rolled round by each site's hours from UTC; offsets: (gid, timezone)."""
    shifted = profiles.join(offsets, "gid")
    return shifted.select("gid", F.pmod(F.col("idx") + F.col("timezone") * per_hour, F.lit(steps)).alias("idx"), "value")


def shift_and_fill(profiles: DataFrame, steps: int, shift: int, keys: tuple[str, ...] = ("gid",)) -> DataFrame:
    """Rolls every profile by ``shift`` steps; values that wrapped are filled from the last one before (shift > 0: the first one after)."""
    moved = profiles.select(*keys, (F.col("idx") + shift).alias("to"), "value")
    moved = moved.select(*keys, F.pmod("to", F.lit(steps)).alias("idx"), F.when(F.col("to").between(0, steps - 1), F.col("value")).alias("value"))
    rows = Window.partitionBy(*keys).orderBy("idx")
    filled = F.first("value", ignorenulls=True).over(rows.rowsBetween(0, Window.unboundedFollowing)) if shift > 0 else F.last("value", ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))
    return moved.select(*keys, "idx", filled.alias("value"))


def bias_corrected(pairs: DataFrame) -> DataFrame:
    """Adds corrected: forecasts times the site's ratio of total actual to total forecast, at most its largest actual. pairs: (gid, ..., actual, forecast)."""
    factors = pairs.groupBy("gid").agg(F.try_divide(F.sum("actual"), F.sum("forecast")).alias("factor"), F.max("actual").alias("most"))
    return pairs.join(factors, "gid").withColumn("corrected", F.least(F.col("forecast") * F.col("factor"), F.col("most"))).drop("factor", "most")


def blended(pairs: DataFrame, share: float) -> DataFrame:
    """Adds blend: share of the corrected forecast, the rest actual."""
    return bias_corrected(pairs).withColumn("blend", F.col("actual") * (1 - share) + F.col("corrected") * share)


def mean_absolute_error(pairs: DataFrame, forecast: str = "forecast") -> DataFrame:
    """(gid, mae, mae_percent): mean error, and its percentage of the largest actual."""
    error = F.avg(F.abs(F.col(forecast) - F.col("actual")))
    return pairs.groupBy("gid").agg(error.alias("mae"), (100 * F.try_divide(error, F.max("actual"))).alias("mae_percent"))


def circular_mean(directions: DataFrame, keys: tuple[str, ...] = ("gid",), weight: str | None = None) -> DataFrame:
    """Mean of directions in degrees, weighted if a column is named; null for groups without weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    angle = F.radians("value")
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin(angle) * w), F.sum(F.cos(angle) * w))) + 360, F.lit(360.0))
    return directions.groupBy(*keys).agg(F.when(F.sum(w) > 0, mean).alias("direction"))


def with_statistics(pairs: DataFrame, keys: list[str], statistics: dict[str, Callable[[Column, Column], Column]], a: str = "solar", b: str = "wind") -> DataFrame:
    """User statistics by name: each makes an aggregate of two columns, built in or a pandas UDAF."""
    return pairs.groupBy(*keys).agg(*[f(F.col(a), F.col(b)).alias(name) for name, f in statistics.items()])


def weighted_profiles(profiles: DataFrame, shares: DataFrame, owner: str = "plant") -> DataFrame:
    """(owner, ts, value): sum of profile times capacity; shares: (owner, gid, capacity)."""
    return profiles.join(shares, "gid").groupBy(owner, "ts").agg(F.sum(F.col("value") * F.col("capacity")).alias("value"))


def blended_sources(profiles: DataFrame, shares: DataFrame) -> DataFrame:
    """(gid, ts, value): sources mixed by their fractions, and whether the fractions add up to 1. profiles: (source, gid, ts, value); shares: (source, fraction)."""
    mixed = profiles.join(F.broadcast(shares) if shares.limit(1001).count() <= 1000 else shares, "source")
    return mixed.groupBy("gid", "ts").agg(F.sum(F.col("value") * F.col("fraction")).alias("value"), (F.abs(F.sum("fraction") - 1) < 1e-6).alias("complete"))
