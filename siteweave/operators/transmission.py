"""Tie-line, connection and reinforcement costs of transmission features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions import costs
from siteweave.operators.spatial_joins import as_of_at_least


def substation_voltages(substations: DataFrame, lines: DataFrame, least_kv: float = 69) -> DataFrame:
    """(gid, min_volts, max_volts) of the lines at each substation; those whose largest is under ``least_kv`` go. substations: (gid, trans_gids); lines: (gid, voltage)."""
    ends = substations.select("gid", F.explode("trans_gids").alias("line"))
    volts = lines.select(F.col("gid").alias("line"), "voltage")
    return ends.join(volts, "line").groupBy("gid").agg(F.min("voltage").alias("min_volts"), F.max("voltage").alias("max_volts")).filter(F.col("max_volts") >= least_kv)


def _lookup(table: dict[str, dict[int, float]], region: Column, kv: int) -> Column:
    out = F.lit(None).cast("double")
    for name, number in costs.REGIONS.items():
        if kv in table[name]:
            out = F.when(region == number, float(table[name][kv])).otherwise(out)
    return out


def connection_costs(features: DataFrame, capacity_class: str) -> DataFrame:
    """Adds xformer_cost_per_mw, xformer_cost, sub_upgrade_cost, new_sub_cost and connection_cost for a tie line of the class.

    features: category, region, min_volts, max_volts. Transformers are free at
    lines under the tie line's voltage, at features whose lowest voltage is
    not above it, and in region TEPPC; a sink costs a fixed sum.
    """
    mw = costs.CLASS_MW[capacity_class]
    kv = costs.MW_KV[mw]
    out = as_of_at_least(features, "max_volts", sorted(costs.TRANSFORMER_PER_MVA[kv]), "__class")
    per_mw = F.lit(None).cast("double")
    for volts, cost in costs.TRANSFORMER_PER_MVA[kv].items():
        per_mw = F.when(F.col("__class") == volts, float(cost)).otherwise(per_mw)
    free = ((F.col("category") == "TransLine") & (F.col("max_volts") < kv)) | (F.col("min_volts") <= kv) | (F.col("region") == costs.REGIONS["TEPPC"])
    out = out.withColumn("xformer_cost_per_mw", F.when(free, 0.0).otherwise(per_mw)).withColumn("xformer_cost", F.col("xformer_cost_per_mw") * mw)
    is_sub = F.col("category").isin("Substation", "LoadCen")
    out = out.withColumn("sub_upgrade_cost", F.when(is_sub, _lookup(costs.SUBSTATION_UPGRADE, F.col("region"), kv)).otherwise(0.0))
    out = out.withColumn("new_sub_cost", F.when(F.col("category") == "TransLine", _lookup(costs.NEW_SUBSTATION, F.col("region"), kv)).otherwise(0.0))
    total = F.col("xformer_cost") + F.col("sub_upgrade_cost") + F.col("new_sub_cost")
    return out.withColumn("connection_cost", F.when(F.col("category") == "PCALoadCen", costs.SINK_COST).otherwise(total)).drop("__class")


def tie_line_costs(features: DataFrame, capacity_class: str, least_km: float = 0.0, kind: str = "linear") -> DataFrame:
    """Adds length_mult and tie_line_cost from raw_line_cost and dist_km.

    Short lines cost as if they had the least length; lines under the tie
    line's voltage and unreachable lines cost a fixed sum; other unreachable
    features keep a null cost.
    """
    kv = costs.MW_KV[costs.CLASS_MW[capacity_class]]
    short = F.col("dist_km") < least_km
    scale = F.when(short & (F.col("dist_km") > 1e-9), F.lit(float(least_km)) / F.col("dist_km")).otherwise(1.0)
    out = features.withColumn("raw_line_cost", F.col("raw_line_cost") * scale).withColumn("dist_km", F.when(short, float(least_km)).otherwise(F.col("dist_km")))
    line = F.col("category") == "TransLine"
    unusable = line & (F.col("raw_line_cost").isNull() | (F.col("max_volts") < kv))
    out = out.withColumn("length_mult", costs.length_multiplier(F.col("dist_km"), kind))
    return out.withColumn("tie_line_cost", F.when(unusable, costs.UNREACHABLE_LINE_COST).otherwise(F.col("raw_line_cost") * F.col("length_mult")))


def total_costs(features: DataFrame, capacity_class: str, least_km: float = 0.0, kind: str = "linear") -> DataFrame:
    """Adds trans_cap_cost, tie line plus connection; unreachable features go."""
    out = connection_costs(tie_line_costs(features, capacity_class, least_km, kind), capacity_class)
    return out.filter(F.col("tie_line_cost").isNotNull()).withColumn("trans_cap_cost", F.col("tie_line_cost") + F.col("connection_cost"))


def cheapest(df: DataFrame, key: str, cost: str, tie: str) -> DataFrame:
    """The cheapest row of each key, the smaller ``tie`` of equals."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(cost, tie))
    return df.withColumn("__n", first).filter("__n = 1").drop("__n")


def merge_reinforcement(costs_table: DataFrame, reinforcement: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Costs of features that have reinforcement, with its columns; reinforcement has one row of each key."""
    return costs_table.drop(*columns).join(reinforcement.select(on, *columns), on)


def merge_results(parts: list[DataFrame], drop: tuple[str, ...] = ()) -> DataFrame:
    """Result tables under each other, without the categories named."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return every.filter(~F.col("category").isin(list(drop))) if drop else every


def reinforced_cell_costs(cells: DataFrame, base: str, line_mw: float, line: str = "line_capacity") -> DataFrame:
    """Adds routing and charged costs per MW of a cell for reinforcement: nearly free to route along existing lines, half the usual charge everywhere."""
    charged = F.when(F.col(line) > 0, F.col(base) / F.col(line)).otherwise(F.col(base) / line_mw) * 0.5
    return cells.withColumn("charged", charged).withColumn("routing", F.when(F.col(line) > 0, F.col(base) * 1e-9).otherwise(F.col(base)))


def routing_costs(cells: DataFrame, cost: Column, fixed: Column, barrier: Column, out: str = "routing", multiplier: float = costs.BARRIER_MULTIPLIER) -> DataFrame:
    """Adds the routing surface: costs raised by barriers; -1, impassable, where nothing is to be paid."""
    value = (cost + fixed) * (1 + F.coalesce(barrier, F.lit(0.0)) * multiplier)
    return cells.withColumn(out, F.when(value > 0, value).otherwise(-1.0))
