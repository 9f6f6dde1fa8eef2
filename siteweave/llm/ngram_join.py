"""Exact Jaccard self-join of shingle sets by partitions of the universe and the pigeonhole principle.

Sets fall into bands by size. Two sets of similarity ``LEAST`` per cent or
more, the smaller of size n, differ in at most n (100 - LEAST) / LEAST shingles,
so n is at least that much below the band's end gives one bound H for a band.
The universe of hashed shingles is cut into m ranges, the segments; each has a
threshold t: 0 (its subsets are equal) or 1 (they differ by one shingle at
most). As long as the sum of t + 1 is H + 1, some segment of any similar pair
meets its threshold. Keys are hashes of a segment's subset and, where t is 1,
of the subset without one of its shingles: sets that differ by one shingle
there share such a key. ``allocation`` chooses how many segments have t = 1 by
cost: fewer, larger segments meet by chance (both empty) less often, but give a
key for each of their shingles.

Large sets pass all other tests by chance, so buckets of empty subsets would
join unlike sets to crowds whose work grows with the square of the input.
``spare_segments`` adds e segments to a band's m: then the thresholds that a
similar pair meets add up to e + 1 at least, and a set with e empty subsets at
most needs no keys for them. Only the few sets with more keep these keys.

Sets that share a key are compared by size and by the parity of their shingles
in 32 classes, which differ in no more classes than the sets in shingles; what
passes makes crowds, whose texts travel once and are compared exactly. Equal
sets are one set throughout. A bucket is read up to a bound; the keys of larger
ones are named in the same pass, and their rows dealt out in pairs of blocks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from math import comb, exp, expm1, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed
from siteweave.llm.near_copies import BLOCK, EMPTY, centre_links, crowd_links, shingle_sets
from siteweave.llm.simhash_dedup import components, pairs_within, roots_of
from siteweave.llm.words import mix

SHINGLE = 3
#: Per cent of the union that similar sets share.
LEAST = 90
#: Steps of the ratio of similar sizes that a band spans.
STEPS = 3
#: Compared pairs that cost as much as a shuffled key.
ROW = 64
#: Sets of a bucket that meet in one row; a larger bucket is dealt out in pairs of blocks.
BUCKET = 4096
#: Rows of a table that may be broadcast (about 40 bytes each).
SMALL = 800_000
#: Texts whose sets are made, and pairs that are compared at once.
ROWS = 128
PAIRS = 1 << 18
#: Largest set size for which bands are made; the last band has no end.
LARGEST = 1 << 40
SALTS = 16
#: Pairs that meet by empty subsets only, as a share of the sets of a band.
STRAY = 1e-4
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def bands(least: int = LEAST) -> list[int]:
    """First sizes of all bands; smaller sets are similar to equal ones only. A set similar to a smaller one is in its band or the next."""
    out = [-(-least // (100 - least))]
    while out[-1] < LARGEST:
        end = out[-1]
        for _ in range(STEPS):
            end = 100 * end // least + 1
        out.append(end)
    return out


def differences(size: int, least: int = LEAST) -> int:
    """The most shingles in which a set and a similar one of at least its size differ."""
    return size * (100 - least) // least


def allocation(sizes: dict[int, tuple[int, int]], least: int = LEAST, row: float = ROW) -> list[tuple[int, int]]:
    """(segments, those with threshold 1) of each band. sizes: sets and shingles of each band.

    The cost of k segments with threshold 1 is that of all keys and of the
    pairs that meet by empty subsets, expected for hashed shingles.
    """
    first, out = bands(least), []
    for g in range(len(first) - 1):
        most = differences(first[g + 1] - 1, least)
        here, after = sizes.get(g, (0, 0)), sizes.get(g + 1, (0, 0))
        sets = here[0] + after[0]
        mean = (here[1] + after[1]) / sets if sets else first[g]

        def cost(k: int) -> float:
            m = most + 1 - k
            empty = sets * (1 - 1 / m) ** mean
            single = sets * mean / m * (1 - 1 / m) ** max(mean - 1, 0)
            return row * sets * (m + k * mean / m) + m * empty * empty / 2 + k * empty * single

        # Costs fall, then rise: walk while they fall.
        k = 0
        while k < (most + 1) // 2 and cost(k + 1) < cost(k):
            k += 1
        out.append((most + 1 - k, k))
    return out


def more_than(mean: float, most: int) -> float:
    """The probability of more than ``most`` events where ``mean`` are expected."""
    return -expm1(-mean) if not most else sum(exp(i * log(mean) - mean - lgamma(i + 1)) for i in range(most + 1, most + 60)) if mean else 0.0


def sketches_pass(size: int, most: int) -> float:
    """The probability that the parities of two unlike sets of this size differ in ``most`` classes at most."""
    odd = (1 - (1 - 2 / 32) ** (2 * size)) / 2
    return sum(comb(32, i) * odd**i * (1 - odd) ** (32 - i) for i in range(min(most, 32) + 1))


def spare_segments(sizes: dict[int, tuple[int, int]], plan: list[tuple[int, int]], least: int = LEAST, stray: float = STRAY) -> list[int]:
    """Segments to add to each band: the fewest that leave at most ``stray`` pairs by empty subsets for each set, or else those that leave the fewest; half as many as there are at most. sizes: as for ``allocation``."""
    first, out = bands(least), []
    for g, (m, k) in enumerate(plan):
        sets = sizes.get(g, (0, 0))[0] + sizes.get(g + 1, (0, 0))[0]
        passed = sketches_pass(first[g], differences(first[g], least)) if sets else 0.0

        def pairs(e: int) -> float:
            # Small sets have the most empty subsets.
            keep = sets * more_than((m + e - k) * (1 - 1 / (m + e)) ** first[g], e)
            return keep * keep * (e + 1) ** 2 / (m + e) / 2 * passed

        best = 0
        for e in range(m // 2 + 1 if sets else 0):
            best = min(best, e, key=pairs)
            if pairs(best) <= stray * sets:
                break
        out.append(best)
    return out


def band_sizes(docs: DataFrame, least: int = LEAST) -> dict[int, tuple[int, int]]:
    """Documents and words of each band by words (as many as spaces and one), over all rows; at most one row of a band comes to the driver."""
    first = bands(least)
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "))) + 1
    band = sum((F.when(F.col("w") >= x, 1).otherwise(0) for x in first[1:]), F.lit(0))
    rows = docs.select(words.cast("long").alias("w")).filter(F.col("w") >= first[0]).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    return {r["band"]: (r["n"], r["s"]) for r in rows.collect()}


def sketch(shingles: np.ndarray) -> int:
    """Twice the size in the upper 32 bits; bit i of the lower ones is the parity of the number of shingles in class i of 32."""
    odd = np.bincount((shingles & np.uint64(31)).astype(np.int64), minlength=32) & 1
    return 2 * len(shingles) << 32 | int(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint32)[0])


class Signer:
    """The keys of a set under an allocation."""

    def __init__(self, plan: list[tuple[int, int]], least: int = LEAST, spare: list[int] | None = None):
        self.spare = spare or [0] * len(plan)
        self.plan, self.least, self.first = [(m + e, k) for (m, k), e in zip(plan, self.spare)], least, bands(least)
        self.edges: dict[int, np.ndarray] = {}

    def groups(self, size: int) -> list[int]:
        """The bands of the smaller sets that a set of this size may be similar to, as the smaller one or the larger one."""
        b = bisect_right(self.first, size) - 1
        if b < 0:
            return []
        return [b, b - 1] if b and -(-self.least * size // 100) < self.first[b] else [b]

    def keys(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the subsets of all segments, without empty ones where spare segments make up for them, and of those with one shingle less where the threshold is 1. shingles: distinct, sorted."""
        whole, less = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(shingles)])
        for g in self.groups(len(shingles)):
            m, k = self.plan[g]
            if m not in self.edges:
                self.edges[m] = np.array([(i << 64) // m for i in range(1, m)], np.uint64)
            at = np.concatenate([[0], np.searchsorted(shingles, self.edges[m]), [len(shingles)]])
            subset = sums[at[1:]] - sums[at[:-1]]
            salt = (np.arange(m, dtype=np.uint64) + np.uint64(1)) * _STEP + mix(np.array([g + 1], np.uint64))
            needed = (np.diff(at) > 0) | (np.arange(m) < k)
            if m - np.count_nonzero(needed) > self.spare[g]:
                needed[:] = True
            whole.append(mix(subset + salt)[needed])
            if k:
                segment = np.repeat(np.arange(k), np.diff(at[: k + 1]))
                less.append(mix((subset + salt)[segment] - shingles[: at[k]]))
        return np.concatenate(whole), np.concatenate(less)


def shingled(docs: DataFrame, words: int, signer: Signer | None) -> DataFrame:
    """(doc_id, th, n, k1, k2) of each row: a hash of its text, the size of its set and 128 bits of the set's hash; with a signer also its sketch and both kinds of keys. n is 0 without words."""

    def listed(arrays: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *[len(x) for x in arrays]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))

    def told(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, k1, k2, meta, whole, less = [], [], [], [], [], []
        for x in shingle_sets(batch.column(2), words):
            size = 0 if np.array_equal(x, EMPTY) else len(x)
            n.append(size)
            k1.append(x.sum(dtype=np.uint64) + np.uint64(size))
            k2.append(mix(x ^ _OTHER).sum(dtype=np.uint64))
            if signer:
                meta.append(sketch(x))
                keys = signer.keys(x) if size else (x[:0], x[:0])
                whole.append(keys[0])
                less.append(keys[1])
        columns = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), *[pa.array(mix(np.array(k, np.uint64)).view(np.int64)) for k in (k1, k2)]]
        if signer:
            columns += [pa.array(meta, pa.int64()), listed(whole), listed(less)]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                yield told(batch.slice(at, ROWS))

    schema = "doc_id long, th long, n long, k1 long, k2 long" + (", meta long, whole array<long>, less array<long>" if signer else "")
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def distinct_sets(docs: DataFrame, words: int, signer: Signer) -> DataFrame:
    """(node, k1, k2, meta, whole, less, rep, least) of each distinct set that has a shingle: a number, its sketch and keys, one of its rows, and its smallest doc_id."""
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("rep")
    rows = shingled(docs, words, signer).filter("n > 0").groupBy("k1", "k2").agg(rep, *[F.first(c).alias(c) for c in ("meta", "whole", "less")])
    # Numbers are fixed once the rows are written.
    return checkpointed(rows.withColumn("least", F.col("rep.doc_id")).withColumn("node", F.monotonically_increasing_id()))


def bucket_keys(sets: DataFrame) -> DataFrame:
    """(value, node, meta): a row for each key; the size in meta is odd for subsets with one shingle less."""
    keys = F.concat(F.transform("whole", lambda v: F.struct(v.alias("value"), F.col("meta"))), F.transform("less", lambda v: F.struct(v.alias("value"), (F.col("meta") + (1 << 32)).alias("meta"))))
    return sets.select("node", F.inline(keys)).select("value", "node", "meta")


def buckets(keyed: DataFrame, block: int = BUCKET) -> DataFrame:
    """(value, node, meta): arrays of each bucket of several sets, of the first ``block`` and one more at most."""
    first = keyed.withColumn("at", F.row_number().over(Window.partitionBy("value").orderBy("node"))).filter(F.col("at") <= block + 1)
    met = first.groupBy("value").agg(F.collect_list(F.struct("node", "meta")).alias("m")).filter(F.size("m") > 1)
    return met.select("value", F.col("m.node").alias("node"), F.col("m.meta").alias("meta"))


def block_pairs(keyed: DataFrame, crowded: DataFrame, block: int = BUCKET) -> DataFrame:
    """(cross, node, meta, own): arrays of the blocks of crowded buckets and, with cross true, of their pairs of blocks. crowded: (value)."""
    many = crowded.count()
    inside = checkpointed(keyed.join(F.broadcast(crowded) if many <= SMALL else crowded, "value"))
    blocks = inside.groupBy("value").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = inside.join(F.broadcast(blocks) if many <= SMALL else blocks, "value").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = dealt.groupBy("value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(F.struct("node", "meta", "own")).alias("m"))
    return met.filter(F.size("m") > 1).select((F.col("i") != F.col("j")).alias("cross"), *[F.col(f"m.{c}").alias(c) for c in ("node", "meta", "own")])


def near_pairs(lengths: np.ndarray, node: np.ndarray, meta: np.ndarray, least: int, apart: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of pairs of one bucket each that sizes and parities allow. apart: a number for each position; only pairs with different ones count, below 0 all."""
    size, part, odd = meta >> 33, (meta >> 32 & 1).astype(bool), meta.astype(np.uint32)
    for a, b in pairs_within(lengths, PAIRS):
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        stay = (100 * low >= least * high) & ~(part[a] & part[b]) & (node[a] != node[b])
        if apart is not None:
            stay &= (apart[a] < 0) | (apart[a] != apart[b])
        a, b, low = a[stay], b[stay], low[stay]
        near = np.bitwise_count(odd[a] ^ odd[b]) <= low * (100 - least) // least
        yield a[near], b[near]


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), a < b, that join what the pairs join."""
    ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in pairs:
        ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = ends[roots_of(len(ends), at[: len(a)], at[len(a) :])]
        ones.append(node[ends[root != ends]])
        twos.append(node[root[root != ends]])
    a, b = np.concatenate(ones), np.concatenate(twos)
    return np.minimum(a, b), np.maximum(a, b)


def candidates(sets: DataFrame, least: int = LEAST, block: int = BUCKET) -> DataFrame:
    """(a, b): edges whose components hold all pairs of sets that share a key and that sizes and parities allow."""

    def in_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, (node, meta) = np.asarray(batch.column(1).value_lengths()), (np.asarray(c.flatten()) for c in batch.columns[1:])
            large = lengths > block
            keep = np.repeat(~large, lengths)
            a, b = forest(near_pairs(lengths[~large], node[keep], meta[keep], least), node[keep])
            values = np.asarray(batch.column(0))[large]
            # A key of a crowded bucket comes as an edge without an end.
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, values])), pa.array(np.concatenate([b, values]), mask=np.arange(len(a) + len(values)) >= len(a))], names=["a", "b"])

    def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, (node, meta, own) = np.asarray(batch.column(1).value_lengths()), (np.asarray(c.flatten()) for c in batch.columns[1:])
            cross = np.repeat(np.asarray(batch.column(0).to_numpy(zero_copy_only=False)), lengths)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(near_pairs(lengths, node, meta, least, np.where(cross, own, -1)), node)], names=["a", "b"])

    keyed = bucket_keys(sets)
    found = checkpointed(buckets(keyed, block).mapInArrow(in_buckets, "a long, b long").distinct())
    crowded = found.filter("b IS NULL").select(F.col("a").alias("value"))
    edges = found.filter("b IS NOT NULL")
    if crowded.isEmpty():
        return edges
    return edges.unionByName(block_pairs(keyed, crowded, block).mapInArrow(in_blocks, "a long, b long"))


def links(docs: DataFrame, sets: DataFrame, words: int = SHINGLE, least: int = LEAST, block: int = BUCKET, crowd: int = BLOCK) -> DataFrame:
    """(node, root) of the sets that are similar to another; root is the smallest node of the component and has no row of its own."""
    crowds = components(candidates(sets, least, block))
    members = crowds.union(crowds.select("root", "root").distinct()).toDF("node", "crowd")
    places = checkpointed(sets.select("node", "rep.*").join(members, "node").select("none", F.coalesce("doc_id", F.lit(0)).alias("id"), "th", F.col("node").alias("key"), "crowd"))
    rows = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), "text")
    few = places.count() <= SMALL
    found = rows.join(F.broadcast(places) if few else places, ["none", "id", "th"])
    texts = checkpointed(found.groupBy("key").agg(F.first("crowd").alias("crowd"), F.first("text").alias("text")))
    large = checkpointed(texts.groupBy("crowd").count().filter(F.col("count") > crowd).select("crowd"))
    share = least / 100
    if large.isEmpty():
        return components(crowd_links(texts, None, share, crowd, words, few))
    centred = checkpointed(centre_links(texts, large, share, words, few))
    return components(centred.unionByName(crowd_links(texts, centred, share, crowd, words, few)))


def similar_documents(docs: DataFrame, words: int = SHINGLE, least: int = LEAST, row: float = ROW) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document: documents link when their sets of ``words``-word shingles share ``least`` per cent of their union.

    Words are runs of anything but white space, A-Z as a-z; a text of fewer
    words is one shingle. Null texts and texts without words have no shingles
    and link with nothing, also not with each other. Repeated rows each get
    their row. component_id is the smallest doc_id of the component, null if
    all are null. Columns other than doc_id and text take no part. An empty
    table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = band_sizes(docs, least)
    plan = allocation(sizes, least, row)
    signer = Signer(plan, least, spare_segments(sizes, plan, least))
    sets = distinct_sets(docs, words, signer)
    roots = links(docs, sets, words, least)
    labelled = sets.select("node", "k1", "k2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # One large component is one root: its sets are dealt out by a salt, and the ids of components are repeated for each.
    grouped = labelled.join(roots.select("root").distinct(), "root", "left_semi")
    ids = grouped.groupBy("root").agg(F.min("least").alias("of_root")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = labelled.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(ids, ["root", "salt"], "left")
    by_set = found.select("k1", "k2", F.coalesce("of_root", F.when(F.col("root") == F.col("node"), F.col("least"))).alias("of_set"))
    out = shingled(docs, words, None).join(by_set, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("of_set")).otherwise(F.col("doc_id")).alias("component_id"))
