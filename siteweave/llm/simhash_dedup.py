"""SimHash near-duplicates with pivot distance tables.

Fingerprints within ``DISTANCE`` bits are linked and links are closed to
components. Equal fingerprints collapse first. The Hamming distances of each
distinct fingerprint to ``PIVOTS`` reference fingerprints are computed once and
travel with it, a byte each. Segments split the fingerprints coarsely: two
linked ones agree in some k of k + DISTANCE segments (the pigeonhole
principle), and k is the least for which a bucket by chance holds at most
``CHANCE`` others, so buckets are full of pairs that aren't links. There the
pivot table discards every pair whose largest coordinate difference is over
``DISTANCE`` (the triangle inequality), coordinate by coordinate, and only
survivors are compared. A bucket yields a spanning forest of its links, never
all its pairs; a crowded bucket is dealt out in pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed

WORDS = 4
DISTANCE = 4
PIVOTS = 16
SEED = 42
#: Others that a bucket may hold by chance before longer segments are used.
CHANCE = 512
#: Parts of a large component's fingerprints.
SALTS = 16
#: Fingerprints of a block; a bucket of more is dealt out in pairs of blocks.
BLOCK = 4096
#: Buckets up to this size are compared pair by pair, so many pairs at once; larger ones centre by centre.
SMALL, PAIRS = 2048, 1 << 21


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of the text's word shingles; 0 without words."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        starts, ends = starts[: -words + 1 or None], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # a bounded part of a very long text
        set_bits += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, fp): the fingerprint as a signed long, and a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x or "", words) for x in (v.as_py() for v in batch.column(2))), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, "doc_id long, text_key long, fp long")


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed pseudo-random 64-bit values."""
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def pivot_table(fp: Column, pivots: int = PIVOTS) -> list[Column]:
    """Distances to the reference fingerprints, a byte each, as longs t0, t1, ... of eight."""
    signed = [int(x) - (1 << 64) if x >= 1 << 63 else int(x) for x in reference_fingerprints(pivots)]
    far = [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("long") for p in signed]
    packed = [reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, 8 * i) for i, x in enumerate(far[at : at + 8])]) for at in range(0, pivots, 8)]
    return [x.alias(f"t{i}") for i, x in enumerate(packed)]


def pairs_within(sizes: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b), b < a, of all pairs inside consecutive groups of these sizes, about ``most`` pairs at a time."""
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.arange(len(begins)) - begins
    total = np.concatenate([[0], np.cumsum(before)])
    at = 0
    while at < len(before):
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        a = np.repeat(np.arange(at, end), before[at:end])
        yield a, begins[a] + np.arange(len(a)) - (total[a] - total[at])
        at = end


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that no coordinate of the pivot table discards."""
    for p in range(table.shape[1]):
        stay = np.abs(table[a, p] - table[b, p]) <= distance
        a, b = a[stay], b[stay]
    return a, b


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component under the links (a, b)."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        if not ((root[a] != least) | (root[b] != least)).any():
            return root
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]


def spanning_forest(fps: np.ndarray, table: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, root) positions of the components of distinct fingerprints, for many of them; table has a row of pivot distances for each."""
    by_first = np.argsort(table[:, 0], kind="stable")
    firsts = table[by_first, 0]
    root = np.arange(len(fps))

    def join(a: int, others: np.ndarray) -> None:
        roots = np.unique(np.append(root[others], root[a]))
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]

    def linked(a: int, among: np.ndarray) -> np.ndarray:
        """Those of ``among`` within the distance of a, the table's coordinates first."""
        for p in range(1, table.shape[1]):
            if len(among) < 64:
                break
            among = among[np.abs(table[among, p] - table[a, p]) <= distance]
        among = among[np.abs(table[among] - table[a]).max(1) <= distance] if len(among) else among
        return among[np.bitwise_count(fps[among] ^ fps[a]) <= distance]

    # Centres link all around them; what a centre has linked is no centre again.
    free, centres = np.ones(len(fps), bool), []
    for a in range(len(fps)):
        if free[a]:
            lo, hi = np.searchsorted(firsts, [table[a, 0] - distance, table[a, 0] + distance + 1])
            near = linked(a, by_first[lo:hi])
            join(a, near)
            free[near] = False
            if len(near) > 1:
                centres.append((a, near))
    # Links between members of different centres: both ends are near one centre, by the triangle inequality.
    for a, near in centres:
        far = np.flatnonzero((root != root[a]) & (np.bitwise_count(fps ^ fps[a]) <= 2 * distance))
        if len(far):
            for b in near:
                far = far[root[far] != root[b]]
                if not len(far):
                    break
                found = linked(b, far)
                if len(found):
                    join(b, found)
    return [(i, int(r)) for i, r in enumerate(root) if r != i]


def segments(parts: int) -> list[int]:
    """Masks that cut 64 bits into so many parts."""
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def segment_masks(count: int, distance: int = DISTANCE, chance: int = CHANCE) -> list[int]:
    """Masks of k of k + distance segments; k makes a bucket by chance hold at most ``chance`` others of ``count`` fingerprints."""
    k = next((k for k in range(1, 12) if count <= chance * 2 ** (64 * k / (k + distance))), 12)
    return [sum(x) for x in combinations(segments(k + distance), k)]


def masked(word: Column, mask: int) -> Column:
    return word.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def bucket_blocks(keyed: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """A row for each bucket of more than one member: each of the columns as an array. keyed: (part, value, columns); a bucket of more than ``block`` members comes in pairs of blocks, dealt by the first column."""
    crowded = keyed.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    dealt = (
        keyed.join(crowded.select("part", "value", F.expr(f"int(ceil(n / {block}))").alias("blocks")), ["part", "value"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64(columns[0]), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("part", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.struct(*columns).alias("m"))
    )
    met = dealt.groupBy("part", "value", "i", "j").agg(F.collect_list("m").alias("m")).filter(F.size("m") > 1)
    return met.select(*[F.col(f"m.{c}").alias(c) for c in columns])


def link_forest(distinct: DataFrame, count: int, distance: int = DISTANCE, pivots: int = PIVOTS, block: int = BLOCK, chance: int = CHANCE) -> DataFrame:
    """(a, b): edges whose components are those of all links between the fingerprints in column fp."""
    tables = [f"t{i}" for i in range(-(-pivots // 8))]
    keys = F.array(*[F.struct(F.lit(i).alias("part"), masked(F.col("fp"), m).alias("value")) for i, m in enumerate(segment_masks(count, distance, chance))])
    keyed = distinct.select("fp", *pivot_table(F.col("fp"), pivots)).select("fp", *tables, F.inline(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            fps, sizes = np.asarray(column.flatten()).view(np.uint64), np.asarray(column.value_lengths())
            table = np.concatenate([np.ascontiguousarray(np.asarray(c.flatten())).view(np.uint8).reshape(-1, 8) for c in batch.columns[1:]], 1)[:, :pivots].astype(np.int16)
            ones, twos = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            small = np.repeat(sizes <= SMALL, sizes)
            some, few = fps[small], table[small]
            for a, b in pairs_within(sizes[sizes <= SMALL]):
                a, b = survivors(few, a, b, distance)
                near = np.bitwise_count(some[a] ^ some[b]) <= distance
                ends, at = np.unique(np.concatenate([a[near], b[near]]), return_inverse=True)
                root = ends[roots_of(len(ends), at[: len(at) // 2], at[len(at) // 2 :])]
                ones.append(some[ends[root != ends]])
                twos.append(some[root[root != ends]])
            for end, size in zip(np.cumsum(sizes)[sizes > SMALL], sizes[sizes > SMALL]):
                found = np.array(spanning_forest(fps[end - size : end], table[end - size : end], distance), np.int64).reshape(-1, 2) + end - size
                ones.append(fps[found[:, 0]])
                twos.append(fps[found[:, 1]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (ones, twos)], names=["a", "b"])

    return bucket_blocks(keyed, ["fp", *tables], block).mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by large-star and small-star steps with reliable checkpoints."""
    edges = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    state = None
    while True:
        # Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = checkpointed(small.filter("a > b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) of each document.

    Null and empty texts have fingerprint 0 and are linked like others.
    Repeated rows each get their row. component_id is the smallest doc_id of
    the component, null if all are null. An empty table gives no rows.
    """
    fps = checkpointed(fingerprints(docs, words))
    distinct = checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(link_forest(distinct.select("fp"), distinct.count(), distance))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # One large component is one root: its rows are dealt out by a salt, and the ids of components are repeated for each.
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")
    grouped = labelled.join(roots.select("root").distinct(), "root", "left_semi")
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = labelled.withColumn("salt", salt).join(ids, ["root", "salt"], "left")
    # A fingerprint without a link is its own component.
    alone = F.col("root") == F.col("fp")
    by_fp = found.select("fp", F.coalesce("component_id", F.when(alone, F.col("least"))).alias("component_id"))
    return fps.join(by_fp, "fp", "left").select("doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
