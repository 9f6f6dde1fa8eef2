"""Transmission cost tables and multipliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names, classes and costs that results must agree on.
REGIONS = {"TEPPC": 1, "SCE": 2, "MISO": 3, "Southeast": 4}
CLASS_MW = {"100MW": 102, "200MW": 205, "400MW": 400, "1000MW": 1500, "3000MW": 3000}
MW_KV = {68: 46, 102: 69, 171: 115, 205: 138, 240: 161, 343: 230, 400: 230, 750: 345, 1500: 500, 3000: 500}
LINE_COST_PER_MILE = {
    "TEPPC": {102: 983701, 205: 1180083, 400: 1579572, 1500: 3052857, 3000: 2525849},
    "SCE": {102: 1524000, 205: 2084122, 400: 3034000, 1500: 4777000, 3000: 3952357},
    "MISO": {102: 1254921, 205: 1446469, 400: 1694747, 1500: 2787303, 3000: 2306137},
    "Southeast": {102: 818852, 205: 984325, 400: 1567655, 1500: 4056410, 3000: 3356161},
}
NEW_SUBSTATION = {
    "TEPPC": {69: 3498000, 138: 5541000, 230: 9171000, 500: 15489000},
    "SCE": {69: 3975000, 138: 8870000, 230: 17525000, 500: 37017000},
    "MISO": {69: 5700000, 138: 7800000, 230: 9700000, 500: 20300000},
    "Southeast": {69: 3064000, 138: 4692000, 230: 5732000, 500: 20364000},
}
SUBSTATION_UPGRADE = {
    "TEPPC": {69: 1352000, 138: 2198000, 230: 5500000, 500: 10236000},
    "SCE": {69: 767000, 138: 1117000, 230: 3975000, 500: 9665000},
    "MISO": {69: 1100000, 138: 1600000, 230: 2200000, 500: 5300000},
    "Southeast": {69: 1179000, 138: 1179000, 230: 2210000, 500: 8340000},
}
TRANSFORMER_PER_MVA = {
    69: {69: 4720, 115: 3840, 138: 4260, 161: 4480, 230: 4970, 345: 6100, 500: 7860},
    115: {69: 3840, 115: 5230, 138: 4260, 161: 4480, 230: 4970, 345: 5790, 500: 7110},
    138: {69: 4260, 115: 4260, 138: 5790, 161: 4720, 230: 4970, 345: 5790, 500: 7110},
    161: {69: 4480, 115: 4480, 138: 4720, 161: 6420, 230: 5230, 345: 6100, 500: 7490},
    230: {69: 4970, 115: 4970, 138: 4970, 161: 5230, 230: 7110, 345: 6100, 500: 7490},
    345: {69: 6100, 115: 5790, 138: 5790, 161: 6100, 230: 6100, 345: 8670, 500: 7860},
    500: {69: 7860, 115: 7110, 138: 7110, 161: 7490, 230: 7490, 345: 7860, 500: 11610},
}
LAND_USE = {"cropland": [80, 81], "forest": [41, 42, 43], "suburban": [21, 22, 23], "urban": [24], "wetland": [90, 95]}
LAND_USE_MULTIPLIERS = {
    "TEPPC": {"cropland": 1, "forest": 2.25, "suburban": 1.3, "urban": 1.59, "wetland": 1.2},
    "SCE": {"cropland": 1, "forest": 3, "suburban": 2, "urban": 3, "wetland": 2},
    "MISO": {"cropland": 1.03, "forest": 1.2, "suburban": 1.08, "urban": 1.2, "wetland": 1.8},
    "Southeast": {"cropland": 1, "forest": 1.47, "suburban": 1.75, "urban": 1.12, "wetland": 1.33},
}
SLOPE_MULTIPLIERS = {"TEPPC": (1.4, 1.75), "SCE": (1.5, 2), "MISO": (1.1, 1.21), "Southeast": (1.2, 1.6)}
HILL_SLOPE, MOUNTAIN_SLOPE = 2, 8
WATER_CLASS, WATER_MULTIPLIER = 11, 10.0
METERS_PER_MILE, CELL_METERS = 1609.344, 90
SHORT_KM, MEDIUM_KM, SHORT_MULTIPLIER, MEDIUM_MULTIPLIER = 4.828032, 16.09344, 1.5, 1.2
SINK_COST, UNREACHABLE_LINE_COST = 1e11, 1e12
BARRIER_MULTIPLIER = 100.0


def by_region(spark: SparkSession, values: dict[str, dict[int, float]], key: str, value: str) -> DataFrame:
    """A table (region, key, value) of a cost dictionary, by region number."""
    return spark.createDataFrame([(REGIONS[r], k, float(v)) for r, kv in values.items() for k, v in kv.items()], f"region int, {key} int, {value} double")


def per_cell(per_mile: Column, cell_meters: float = CELL_METERS) -> Column:
    return per_mile / METERS_PER_MILE * cell_meters


def length_multiplier(km: Column, kind: str = "linear") -> Column:
    """More for short lines: in steps, or falling in a line up to the medium length."""
    if kind == "step":
        return F.when(km < SHORT_KM, SHORT_MULTIPLIER).when(km <= MEDIUM_KM, MEDIUM_MULTIPLIER).otherwise(1.0)
    if kind != "linear":
        raise ValueError(f"unknown kind of length multiplier: {kind}")
    slope = (1 - SHORT_MULTIPLIER) / (MEDIUM_KM - SHORT_KM / 2)
    return F.when(km <= MEDIUM_KM, slope * (km - MEDIUM_KM) + 1).otherwise(1.0)


def slope_multiplier(slope: Column, hill: Column, mountain: Column) -> Column:
    return F.when(slope >= MOUNTAIN_SLOPE, mountain).when(slope >= HILL_SLOPE, hill).otherwise(1.0)


def land_use_name(code: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, codes in LAND_USE.items():
        out = F.when(code.isin(codes), name).otherwise(out)
    return out


def line_megawatts(capacity_class: Column) -> Column:
    """MW of a class such as 100MW or 100."""
    named = F.concat(F.regexp_replace(capacity_class.cast("string"), "MW$", ""), F.lit("MW"))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASS_MW.items() for x in kv]), named)


def line_kilovolts(megawatts: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in MW_KV.items() for x in kv]), megawatts.cast("int"))
