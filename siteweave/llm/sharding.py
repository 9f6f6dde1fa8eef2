"""Sharding by a hierarchical weighted hash tree.

Every row descends from the root to a region, a rack and a shard. At each
level every child draws ``ln(u) / weight`` with u hashed from the row's key and
the child's own name; the largest draw wins. A child's draw depends on nothing
but the key, its name and its weight, so a change of weights moves rows only
into or out of the subtrees whose weights changed.

Documents are sharded by the number of shards alone. Every region has places
for the same number of racks and shards and draws with the weight of all its
places, filled or not. A row tries its regions from the largest draw on, each
at the one place that the draws inside it choose, and stays at the first place
that is filled. One more shard fills one more place: the rows that had passed
it by go there, and no other row moves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SHARDS = 40
SHARDS_PER_RACK = 4
RACKS_PER_REGION = 2
#: Rows of a numbering group; a shard's slots are counted within groups, at least LEAST_GROUPS of them.
GROUP_ROWS, LEAST_GROUPS = 1_000_000, 64


@dataclass(frozen=True)
class Leaf:
    """A shard and its place; weight > 0."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int = SHARDS, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> tuple[Leaf, ...]:
    """Equal shards, filled rack by rack and region by region."""
    return tuple(Leaf(s // (per_rack * racks), s // per_rack, s) for s in range(shards))


def _children(tree: tuple[Leaf, ...], parent, child) -> Column:
    """parent id -> array of (child id, weight) as a literal map."""
    weights: dict[int, dict[int, float]] = {}
    for leaf in tree:
        if leaf.weight <= 0:
            raise ValueError("weights must be positive")
        kids = weights.setdefault(parent(leaf), {})
        kids[child(leaf)] = kids.get(child(leaf), 0.0) + leaf.weight
    entries = []
    for key, kids in sorted(weights.items()):
        entries += [F.lit(key), F.array(*[F.struct(F.lit(k).alias("id"), F.lit(float(w)).alias("weight")) for k, w in sorted(kids.items())])]
    return F.create_map(*entries)


def _draw(key: Column, level: str, children: Column) -> Column:
    """The child with the largest weighted draw; equal draws go to the larger id."""
    mantissa = lambda c: F.shiftrightunsigned(F.xxhash64(key, F.lit(level), c["id"]), 11)
    draws = F.transform(children, lambda c: F.struct((F.log((mantissa(c) + 1) / F.lit(float(1 << 53))) / c["weight"]).alias("draw"), c["id"].alias("id")))
    return F.array_max(draws)["id"]


def assign(df: DataFrame, key: str, tree: tuple[Leaf, ...], out: str = "shard") -> DataFrame:
    """Adds the shard of each row; the row's key and the tree decide alone, a null key being a key like others."""
    region, rack = f"__{out}_region", f"__{out}_rack"
    levels = [
        (region, "region", _children(tree, lambda x: 0, lambda x: x.region), F.lit(0)),
        (rack, "rack", _children(tree, lambda x: x.region, lambda x: x.rack), F.col(region)),
        (out, "shard", _children(tree, lambda x: x.rack, lambda x: x.shard), F.col(rack)),
    ]
    for name, level, kids, parent in levels:
        df = df.withColumn(name, _draw(F.col(key), level, F.element_at(kids, parent)))
    return df.drop(region, rack)


def _best(key: Column, level: str, first: Column, n: int) -> Column:
    """The child with the largest draw of n children of weight 1 that are numbered from ``first`` on; equal draws go to the larger number."""
    draws = [F.struct(F.shiftrightunsigned(F.xxhash64(key, F.lit(level), (first + i).cast("int")), 11).alias("draw"), (first + i).cast("int").alias("id")) for i in range(n)]
    return F.array_max(F.array(*draws))["id"] if n > 1 else first


def place_of(key: Column, shards: int, per_rack: int = SHARDS_PER_RACK, racks: int = RACKS_PER_REGION) -> Column:
    """The shard of a key among ``shards`` equal ones; key and number decide alone, and one more shard takes rows only into itself."""
    regions = -(-shards // (per_rack * racks))
    draws = F.array(*[F.struct(F.shiftrightunsigned(F.xxhash64(key, F.lit("region"), F.lit(r)), 11).alias("draw"), F.lit(r).alias("id")) for r in range(regions)])
    order = F.transform(F.sort_array(draws, asc=False), lambda x: x["id"])
    # Only the last region may have places that aren't filled, so two tries are enough.
    tries = F.transform(F.slice(order, 1, 2), lambda r: _best(key, "shard", _best(key, "rack", r * racks, racks) * per_rack, per_rack))
    filled = F.filter(tries, lambda s: s < shards)
    # With one region alone all of its shards draw for rows that find an empty place.
    return F.coalesce(F.get(filled, F.lit(0)), _best(key, "shard", F.lit(0), min(shards, per_rack * racks))).cast("int")


def shard_documents(docs: DataFrame, shards: int = SHARDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Shard, slot and size of each document.

    Null texts have no bytes; null doc_ids are one key. Repeated rows each get
    a slot of their own in the same shard. An empty table gives no rows.
    Slots follow (group, doc_id, size, text_crc32) in each shard, gapless from
    0; a shard's rows are numbered in independent groups of about
    ``group_rows`` rows, whose starts come from counts, so no task gets a
    whole shard.
    """
    groups = max(LEAST_GROUPS, -(-docs.count() // (shards * group_rows)))
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sized.withColumn("shard", place_of(F.col("doc_id"), shards)).withColumn("__group", F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "text_crc32"), F.lit(groups)))
    # At most shards * groups rows: one for each group_rows rows of the input or LEAST_GROUPS of a shard.
    counts = placed.groupBy("shard", "__group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "__group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("shard", "__group").orderBy("doc_id", "size", "text_crc32")
    numbered = placed.join(starts, ["shard", "__group"]).withColumn("slot", F.col("__start") + F.row_number().over(within) - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), place_of(F.col("doc_id"), shards + 1).alias("grown_shard"))
