"""Exact order statistics and percentiles of any number of values, without a task that holds a group.

The wanted rank's value lies in a range, at first that of the group. A round
counts the values in equal bins of the range, keeps the bin that holds the rank
and the smallest and largest value in it, and forgets the rest; it ends when
these are the same, or so few values are left that they can be sorted. Groups
and ranks are refined together, so rounds follow the widest spread, not the
number of groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.session import checkpointed

BINS = 1024
#: Values of a group that are sorted at last.
FEW = 4096
#: Rows of ranks that may be broadcast (about 64 bytes each).
BROADCAST = 200_000


def order_statistics(df: DataFrame, value: str, keys: list[str], ranks: DataFrame, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, rank, value): the values at ranks, counted from 0 in ascending order. ranks: (keys, rank); ranks outside of a group give no rows, null and NaN values don't count."""
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    ends = rows.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("size"))
    asked = ranks.select(*keys, F.col("rank").cast("long").alias("rank")).distinct()
    wanted = asked.join(ends, keys) if keys else asked.crossJoin(F.broadcast(ends))  # one row of all
    wanted = checkpointed(wanted.filter("rank >= 0 AND rank < size").withColumn("left", F.col("rank")))
    found = [wanted.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("v"))]
    done, round_ = F.col("lo") == F.col("hi"), 0
    while True:
        open_ = wanted.filter(~done)
        large = open_.filter(F.col("size") > few)
        if large.isEmpty():
            break
        met = _met(rows, large, keys)
        # Every other round has bins of equal ratio, for values of all magnitudes.
        at = _magnitude if round_ % 2 else lambda c: c / 2  # halves, so that no difference overflows
        low, wide = at(F.col("lo")), at(F.col("hi")) - at(F.col("lo"))
        part = F.when(wide > 0, F.least(F.lit(bins - 1), F.floor((at(F.col("v")) - low) / wide * bins))).otherwise(0)
        round_ += 1
        counted = met.groupBy(*keys, "rank", "left", part.alias("bin")).agg(F.count("*").alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("size").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        chosen = counted.withColumn("before", before).filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("size")))
        narrowed = chosen.select(*keys, "rank", "lo", "hi", "size", (F.col("left") - F.col("before")).alias("left"))
        wanted = checkpointed(narrowed.unionByName(open_.filter(F.col("size") <= few).select(*narrowed.columns)))
        found.append(wanted.filter(done).select(*keys, "rank", F.col("lo").alias("v")))
    last = _met(rows, wanted.filter(~done), keys)
    place = F.row_number().over(Window.partitionBy(*keys, "rank").orderBy("v")) - 1
    out = last.withColumn("place", place).filter("place = left").select(*keys, "rank", "v")
    for f in found:
        out = out.unionByName(f)
    return out.withColumnRenamed("v", value)


def _magnitude(c: Column) -> Column:
    """Grows with the value, by as much for each doubling."""
    size = F.log2(F.abs(c)) + 1100
    return F.when(c > 0, size).when(c < 0, -size).otherwise(0.0)


def _met(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The values in the range of each wanted rank of their group."""
    few = wanted.count() <= BROADCAST
    asked = wanted.select(*keys, "rank", "lo", "hi", "left")
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    if keys:
        return rows.join(F.broadcast(asked) if few else asked, keys).filter(inside)
    return rows.join(F.broadcast(asked), inside)  # a rank or two of all values


def percentiles(df: DataFrame, value: str | Column, shares: list[float], keys: tuple[str, ...] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, p0, p1, ...): exact percentiles of each group, between two values in proportion. Groups without values have nulls; without keys one row."""
    names, rows = list(keys), df.withColumn("__value", (F.col(value) if isinstance(value, str) else value).cast("double"))
    sizes = checkpointed(rows.groupBy(*names).agg(F.count_if(F.col("__value").isNotNull() & ~F.isnan("__value")).alias("size")))
    place = F.array(*[F.struct(F.lit(i).alias("i"), ((F.col("size") - 1) * F.lit(float(s))).alias("at")) for i, s in enumerate(shares)])
    at = sizes.filter("size > 0").select(*names, F.inline(place)).withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    told = order_statistics(rows, "__value", names, at.select(*names, "rank").distinct(), bins, few)
    part = 1 - F.abs(F.col("at") - F.col("rank"))
    mixed = at.join(told, [*names, "rank"])
    wide = mixed.groupBy(*names).agg(*[F.sum(F.when(F.col("i") == i, F.col("__value") * part)).alias(f"p{i}") for i in range(len(shares))])
    if not names:
        return wide
    missing = [F.col(f"p{i}") for i in range(len(shares))]
    return sizes.select(*names).join(wide, names, "left").select(*names, *missing)
