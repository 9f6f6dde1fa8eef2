"""Map algebra over cell tables (row, col, one column for each layer)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.functions import costs
from siteweave.functions.spatial import DIRECTIONS
from siteweave.session import checkpointed

CELL = ["row", "col"]


def to_raster(table: DataFrame, gid: str, columns: list[str], width: int, cells: DataFrame) -> DataFrame:
    """The table's columns on every cell of the domain: (row, col, columns); gid = row * width + col, the first row of each gid counts."""
    first = table.groupBy(gid).agg(F.min(F.struct(*columns)).alias("v")).select(F.col(gid).alias("__g"), *[F.col(f"v.{c}") for c in columns])
    return cells.select("row", "col", (F.col("row") * width + F.col("col")).alias("__g")).join(first, "__g", "left").drop("__g")


def component(mask: Column, global_value: float | None = None, bins: tuple[Column, list[tuple[float, float, float]]] | None = None, mapping: tuple[Column, dict[int, float]] | None = None, passed: Column | None = None) -> Column:
    """A layer's part: one constant, one summed set of bins, one map of codes or the raster itself, 0 outside the mask."""
    if sum(x is not None for x in (global_value, bins, mapping, passed)) != 1:
        raise ValueError("exactly one of global_value, bins, mapping and passed")
    if global_value is not None:
        value = F.lit(float(global_value))
    elif bins is not None:
        check_bins(bins[1])
        value = reduce(lambda a, b: a + b, [F.when((bins[0] >= lo) & (bins[0] < hi), float(v)).otherwise(0.0) for lo, hi, v in bins[1]], F.lit(0.0))
    elif mapping is not None:
        value = reduce(lambda a, kv: F.when(mapping[0] == kv[0], float(kv[1])).otherwise(a), mapping[1].items(), F.lit(0.0))
    else:
        value = F.coalesce(passed, F.lit(0.0))
    return F.when(mask, value).otherwise(0.0)


def check_bins(bins: list[tuple[float, float, float]]) -> list[str]:
    """Raises for bins that end before they start; tells overlaps and gaps."""
    said = []
    for (lo, hi, _), nxt in zip(sorted(bins), [*sorted(bins)[1:], None]):
        if lo > hi:
            raise ValueError(f"bin from {lo} to {hi}")
        if nxt and nxt[0] < hi:
            said.append(f"bins overlap at {nxt[0]}")
        elif nxt and nxt[0] > hi:
            said.append(f"no bin from {hi} to {nxt[0]}")
    return said


def build_layer(cells: DataFrame, parts: list[Column], out: str, forced_inclusion: list[Column] = (), per_mile: bool = False) -> DataFrame:
    """Adds the sum of the parts; any forced inclusion above 0 makes it 0; costs per mile become costs per cell."""
    total = reduce(lambda a, b: a + b, parts)
    if forced_inclusion:
        total = F.when(reduce(lambda a, b: a | b, [F.coalesce(f > 0, F.lit(False)) for f in forced_inclusion]), 0.0).otherwise(total)
    return cells.withColumn(out, costs.per_cell(total) if per_mile else total)


def neighbour_any(cells: DataFrame, flag: Column, out: str) -> DataFrame:
    """Adds whether any of the eight neighbours has the flag."""
    offsets = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for _, r, c in DIRECTIONS])
    touched = cells.filter(flag).select("row", "col", F.explode(offsets).alias("o")).select((F.col("row") + F.col("o.r")).alias("row"), (F.col("col") + F.col("o.c")).alias("col")).distinct()
    return cells.join(touched.withColumn("__hit", F.lit(True)), CELL, "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def masks(cells: DataFrame, land: Column) -> DataFrame:
    """Adds raw_land, landfall (land next to water), land (without landfall), offshore."""
    raw = cells.withColumn("raw_land", land)
    near = neighbour_any(raw, ~F.col("raw_land"), "__water")
    return near.withColumn("landfall", F.col("raw_land") & F.col("__water")).withColumn("land", F.col("raw_land") & ~F.col("landfall")).withColumn("offshore", ~F.col("raw_land")).drop("__water")


def dry_multipliers(cells: DataFrame, region: str, land_use: str, slope: str, out: str) -> DataFrame:
    """Adds land-use times slope multiplier of each cell's region; 1 for regions without own values; water last."""
    name = costs.land_use_name(F.col(land_use))
    use, steep = F.lit(1.0), F.lit(1.0)
    for r, number in costs.REGIONS.items():
        table = reduce(lambda a, kv: F.when(name == kv[0], float(kv[1])).otherwise(a), costs.LAND_USE_MULTIPLIERS[r].items(), F.lit(1.0))
        hill, mountain = costs.SLOPE_MULTIPLIERS[r]
        use = F.when(F.col(region) == number, table).otherwise(use)
        steep = F.when(F.col(region) == number, costs.slope_multiplier(F.col(slope), F.lit(float(hill)), F.lit(float(mountain)))).otherwise(steep)
    return cells.withColumn(out, F.when(F.col(land_use) == costs.WATER_CLASS, costs.WATER_MULTIPLIER).otherwise(use * steep))


def dry_costs(cells: DataFrame, megawatts: int, region: str, multiplier: str, out: str) -> DataFrame:
    """Adds the line cost of each cell: the region's cost per mile, per cell, times the multiplier; null without region."""
    per_mile = F.lit(None).cast("double")
    for r, number in costs.REGIONS.items():
        per_mile = F.when(F.col(region) == number, float(costs.LINE_COST_PER_MILE[r][megawatts])).otherwise(per_mile)
    return cells.withColumn(out, costs.per_cell(per_mile) * F.col(multiplier))


def with_barriers(cells: DataFrame, friction: str, barrier: str, out: str, factor: float = 1e6) -> DataFrame:
    return cells.withColumn(out, F.coalesce(F.col(friction), F.lit(0.0)) + F.coalesce(F.col(barrier), F.lit(0.0)) * factor)


def zonal(cells: DataFrame, zone: str, value: str) -> DataFrame:
    """(zone, included, n_included, n_cells, fraction): sums of the value and of its ceiling, and the mean."""
    return cells.groupBy(zone).agg(F.sum(value).alias("included"), F.sum(F.ceil(value)).cast("long").alias("n_included"), F.count("*").alias("n_cells"), F.avg(value).alias("fraction"))


def label_centres(cells: DataFrame, label: str) -> DataFrame:
    """(label, row, col): the mean cell of each label, truncated."""
    return cells.groupBy(label).agg(F.floor(F.avg("row")).cast("int").alias("row"), F.floor(F.avg("col")).cast("int").alias("col"))


def downsample(cells: DataFrame, value: str, size: int, how: str = "sum") -> DataFrame:
    """(row, col, value) of blocks of size x size cells."""
    f = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return cells.groupBy(F.expr(f"row div {size}").cast("int").alias("row"), F.expr(f"col div {size}").cast("int").alias("col")).agg(f(value).alias(value))


def reduce_layers(layers: list[DataFrame], how: str = "max") -> DataFrame:
    """(row, col, value): the largest or smallest value of several rasters."""
    f = {"max": F.max, "min": F.min}[how]
    return reduce(DataFrame.unionByName, [x.select("row", "col", "value") for x in layers]).groupBy(*CELL).agg(f("value").alias("value"))


def burn(features: DataFrame, distance: str, keep: list[str] = ()) -> DataFrame:
    """Cells within each feature's distance, in cells, of its own: (row, col, keep...); each feature emits its own disc, so nothing is paired with the whole raster."""
    reach = F.floor(F.col(distance)).cast("int")
    span = F.sequence(-reach, reach)
    out = features.withColumn("__r", F.explode(span)).withColumn("__c", F.explode(span))
    out = out.filter(F.col("__r") * F.col("__r") + F.col("__c") * F.col("__c") <= F.col(distance) * F.col(distance))
    return out.select((F.col("row") + F.col("__r")).alias("row"), (F.col("col") + F.col("__c")).alias("col"), *keep)


def setbacks(cells: DataFrame, features: DataFrame, distance: float, out: str = "excluded") -> DataFrame:
    """Adds whether a cell is within the distance of a feature."""
    near = burn(features.withColumn("__d", F.lit(float(distance))), "__d").distinct().withColumn(out, F.lit(True))
    return cells.join(near, CELL, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def local_setbacks(cells: DataFrame, features: DataFrame, rules: DataFrame, generic: float | None, county: str = "fips", out: str = "excluded") -> DataFrame:
    """Adds exclusions under local rules: inside a county with a rule its own distance counts, even if shorter; elsewhere the generic one, if any. rules: (fips, distance)."""
    ruled = cells.join(rules.select(county, F.col("distance").alias("__local")), county, "left")
    local = burn(features.join(rules, county), "distance", [county]).distinct().withColumn("__l", F.lit(True))
    ruled = ruled.join(local, [*CELL, county], "left")
    if generic is not None:
        everywhere = burn(features.withColumn("__d", F.lit(float(generic))), "__d").distinct().withColumn("__g", F.lit(True))
        ruled = ruled.join(everywhere, CELL, "left")
    else:
        ruled = ruled.withColumn("__g", F.lit(False))
    flag = F.when(F.col("__local").isNotNull(), F.coalesce("__l", F.lit(False))).otherwise(F.coalesce("__g", F.lit(False)))
    return ruled.withColumn(out, flag).drop("__local", "__l", "__g")


def partial_inclusion(cells: DataFrame, features: DataFrame, radius: float, parts: int, out: str = "inclusion") -> DataFrame:
    """Adds 1 - the share of a cell's parts x parts sub-cells within ``radius`` cells of a feature's centre."""
    fine = features.select((F.col("row") * parts + (parts - 1) / 2).alias("__y"), (F.col("col") * parts + (parts - 1) / 2).alias("__x"))
    r = radius * parts
    span = lambda c: F.explode(F.sequence(F.ceil(F.col(c) - r).cast("int"), F.floor(F.col(c) + r).cast("int")))
    covered = fine.withColumn("y", span("__y")).withColumn("x", span("__x")).filter(F.pow(F.col("y") - F.col("__y"), 2) + F.pow(F.col("x") - F.col("__x"), 2) <= r * r).select("y", "x").distinct()
    share = covered.groupBy(F.floor(F.col("y") / parts).cast("int").alias("row"), F.floor(F.col("x") / parts).cast("int").alias("col")).agg((F.count("*") / F.lit(float(parts * parts))).alias("__s"))
    return cells.join(share, CELL, "left").withColumn(out, 1 - F.coalesce("__s", F.lit(0.0))).drop("__s")


def shifted(buildings: DataFrame, shifts: DataFrame, rows: int, cols: int, max_shifts: int = 100_000) -> DataFrame:
    """Distinct cells that every building's shadow falls on, clamped to the raster; shifts (dr, dc) is a heat map of bounded size."""
    if shifts.limit(max_shifts + 1).count() > max_shifts:
        raise ValueError(f"a heat map of more than {max_shifts} cells")
    offsets = shifts.agg(F.collect_list(F.struct("dr", "dc")).alias("__o"))  # one row, checked above
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    each = buildings.select("row", "col", F.lit(1).alias("__k")).join(F.broadcast(offsets.withColumn("__k", F.lit(1))), "__k").withColumn("o", F.explode("__o"))
    return each.select(clamp(F.col("row") + F.col("o.dr"), rows).alias("row"), clamp(F.col("col") + F.col("o.dc"), cols).alias("col")).distinct()


def flicker_shifts(heat: DataFrame, rows: int, cols: int, hours: float) -> DataFrame:
    """(dr, dc): cells of a heat map (row, col, value = share of the year) with more hours than allowed, seen from the turbine in the centre, turned round."""
    return heat.filter(F.col("value") > hours / 8760).select((F.lit(rows // 2) - F.col("row")).alias("dr"), (F.lit(cols // 2) - F.col("col")).alias("dc"))


def merge_exclusions(generic: DataFrame, local: DataFrame, counties: DataFrame, inclusion: bool = False) -> DataFrame:
    """(row, col, value): local values in the cells of counties with rules (row, col), else generic ones; several local values merge by the stricter."""
    how = F.min if inclusion else F.max
    own = local.groupBy(*CELL).agg(how("value").alias("__l"))
    out = generic.join(own, CELL, "left").join(counties.select(*CELL).distinct().withColumn("__in", F.lit(True)), CELL, "left")
    nothing = F.lit(1.0 if inclusion else 0.0)
    return out.select(*CELL, F.when(F.coalesce("__in", F.lit(False)), F.coalesce("__l", nothing)).otherwise(F.col("value")).alias("value"))


def neighbours(sites: DataFrame, gid: str, width: int, height: int) -> DataFrame:
    """(gid, direction, neighbour) of gids on a width x height grid, clamped at the edges."""
    offsets = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, r, c in DIRECTIONS])
    row, col = F.expr(f"{gid} div {width}"), F.col(gid) % width
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(c, F.lit(n - 1)))
    out = sites.select(gid, row.alias("__r"), col.alias("__c"), F.explode(offsets).alias("o"))
    return out.select(gid, F.col("o.name").alias("direction"), (clamp(F.col("__r") + F.col("o.r"), height) * width + clamp(F.col("__c") + F.col("o.c"), width)).cast("long").alias("neighbour"))


def tech_potential(cells: DataFrame, base: str, mask: Column, density: float, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None) -> DataFrame:
    """(row, col, capacity) in a window: the base layer as weight, times the mask, times the density."""
    out = cells
    for name, part in (("row", rows), ("col", cols)):
        if part:
            out = out.filter(F.col(name).between(part[0], part[1] - 1))
    return out.select(*CELL, (F.col(base) * mask.cast("double") * density).alias("capacity"))


def hottest_capacity(lines: DataFrame) -> DataFrame:
    """(row, col, capacity): where lines overlap the higher capacity stays."""
    return lines.groupBy(*CELL).agg(F.max("capacity").alias("capacity"))


def _labelled(row: np.ndarray, col: np.ndarray, kind: np.ndarray, queen: bool) -> np.ndarray:
    """The first cell, by row and column, of each cell's patch of one kind, as its number."""
    width, height = int(np.ptp(col)) + 3, int(np.ptp(row)) + 2
    key = (kind * height + row - row.min()) * width + col - col.min() + 1
    cells, first, own = np.unique(key, return_index=True, return_inverse=True)
    links = []
    for step in (1, width, *((width - 1, width + 1) if queen else ())):
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        links.append(np.stack([np.flatnonzero(cells[at] == cells + step), at[cells[at] == cells + step]]))
    a, b = np.concatenate(links, axis=1)
    # Kinds are apart by a row that holds no cell, so steps don't lead from one to the other.
    label = np.arange(len(cells))
    while (label[a] != label[b]).any():
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while (label != label[label]).any():
            label = label[label]
    return first[label[own.ravel()]]


def _least_of_linked(links: DataFrame) -> DataFrame:
    """(node, least): the smallest node that links (node, other), given both ways, lead to, by rounds of labels handed on and followed."""
    labels = checkpointed(links.groupBy("node").agg(F.least("node", F.min("other")).alias("least")))
    while True:
        sent = links.join(labels.select(F.col("node").alias("other"), F.col("least").alias("new")), "other").groupBy("node").agg(F.min("new").alias("new"))
        # A label is a node; following it to that node's own label halves the way each round.
        follow = labels.select(F.col("node").alias("new"), F.col("least").alias("further"))
        now = checkpointed(labels.join(sent, "node").join(follow, "new", "left").select("node", "least", F.least("least", "new", F.coalesce("further", "new")).alias("to")))
        labels = now.select("node", F.col("to").alias("least"))
        # Labels only fall, so the rounds end.
        if now.filter("least != to").isEmpty():
            return labels


def contiguous_patches(cells: DataFrame, queen: bool = True, by: tuple[str, ...] = (), tile: int = 256) -> DataFrame:
    """(row, col, by, patch): connected cells, of one value of the columns ``by``, get their smallest (row, col) as patch.

    A task labels the cells of a tile; then only labels that meet across borders
    of tiles are joined, by rounds with reliable checkpoints.
    """
    at = [*CELL, *by]
    kinds = dict(cells.dtypes)
    tiled = cells.select(*at, *[F.floor(F.col(c) / tile).alias(f"__{c}") for c in CELL]).dropna(subset=at)

    def label(own: pa.Table) -> pa.Table:
        row, col = (own[c].to_numpy().astype(np.int64) for c in CELL)
        kind = np.zeros(len(own), dtype=np.int64)
        for c in by:
            codes = own[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kind = np.unique(kind * (codes.max() + 1) + codes, return_inverse=True)[1].ravel()
        to = pa.array(_labelled(row, col, kind, queen))
        return pa.table({**{c: own[c] for c in at}, "__r": own["row"].take(to), "__c": own["col"].take(to)})

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in at], f"__r {kinds['row']}, __c {kinds['col']}"])
    labels = checkpointed(tiled.groupBy("__row", "__col").applyInArrow(label, schema))
    node = F.struct(*by, "__r", "__c")
    edge = F.lit(False)
    for c in CELL:
        edge = edge | F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = labels.filter(edge).select(*at, node.alias("node"))
    steps = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for _, r, c in DIRECTIONS if queen or 0 in (r, c)])
    over = border.select(*by, "node", "row", "col", F.explode(steps).alias("s"))
    ahead = {c: F.col(c) + F.col(f"s.{n}") for c, n in zip(CELL, "rc")}
    crosses = [F.floor(ahead[c] / tile) != F.floor(F.col(c) / tile) for c in CELL]
    over = over.filter(crosses[0] | crosses[1]).select(*by, "node", *[ahead[c].alias(c) for c in CELL])
    links = checkpointed(over.join(border.withColumnRenamed("node", "other").hint("merge"), at).filter("node != other").select("node", "other").distinct())
    patch = F.struct(F.col("__r").alias("row"), F.col("__c").alias("col")).alias("patch")
    if links.isEmpty():
        return labels.select(*at, patch)
    least = _least_of_linked(links)
    found = labels.withColumn("node", node).join(least, "node", "left").withColumns({c: F.coalesce(F.col(f"least.{c}"), F.col(c)) for c in ("__r", "__c")})
    return found.select(*at, patch)


def large_patches(cells: DataFrame, least_cells: int, queen: bool = True) -> DataFrame:
    """The cells of patches of at least ``least_cells`` cells."""
    labelled = contiguous_patches(cells, queen)
    large = labelled.groupBy("patch").agg(F.count("*").alias("n")).filter(F.col("n") >= least_cells)
    return labelled.join(large, "patch", "left_semi").select(*CELL)


def prominent_direction(rose: DataFrame, order: list[str]) -> DataFrame:
    """(gid, direction) with the largest value, the earlier in ``order`` of equals; rose: (gid, direction, value)."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("direction"))
    first = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), place))
    return rose.withColumn("__n", first).filter("__n = 1").select("gid", "direction")
