"""SimHash near-dedup by similarity: one row of each group of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Two texts at 0.8 differ in a share ``APART`` of their SimHash bits, about ten
of 64, which no small distance covers. So fingerprints are wide
here: several lanes of 64 bits from shingle hashes salted anew. Texts that
agree in a segment of any lane are candidates; ``tables_for`` chooses segments
and lanes by the number of texts, so that chance buckets stay small and a pair
at 0.8 shares a bucket with probability 1 - ``MISSED`` (a nearer pair more
surely).

Inside buckets pivot distance tables discard chance pairs. Distances of whole
lanes to pivots are all within a few bits of half the width and would discard
nothing at this similarity, so pivots are bytes here: a row of the table holds
the distance of each byte of three lanes to each pivot. By the triangle
inequality two bytes differ in at least as many bits as their distances to any
pivot do, so the sum over all bytes of the largest difference is no more than
the Hamming distance. Only pairs whose sum is at most ``NEAR`` are compared.
The distances of all 256 bytes to the pivots are computed once; rows are looked
up in the bucket, which is cheaper than to carry them.

Candidates make crowds. Only the texts of crowds travel, once: a crowd of more
than ``BLOCK`` texts first meets one centre, and only texts not similar to it
are still open and compared with the others, in pairs of blocks. Every link
needs the exact similarity of both shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed
from siteweave.llm.simhash_dedup import components, masked, pairs_within, roots_of, segments
from siteweave.llm.words import gram_hashes, mix, pieces, word_hashes, word_spans

SHINGLE = 5
LEAST = 0.8
#: Share of the bits in which texts of similarity LEAST differ: the angle of sets whose cosine is 2 LEAST / (1 + LEAST), over pi.
APART = float(np.arccos(2 * LEAST / (1 + LEAST)) / np.pi)
MISSED = 0.001
#: Others that a bucket may hold by chance, and members of a block of a larger bucket.
CHANCE, BUCKET = 4096, 8192
#: Most differing bits of candidates in three lanes (192 bits; 29 expected at LEAST, with a deviation of 5).
NEAR = 46
#: Reference bytes of the pivot table, and the distances of all bytes to them: no pivot is the complement of another, which would tell the same.
PIVOTS = np.array([0x00, 0x8B, 0xCC], np.uint8)
PIVOT_DISTANCES = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ PIVOTS).astype(np.int8)
#: Pairs whose rows of the pivot table meet at once.
ROWS = 1 << 15
#: Texts of a block; a crowd of more is dealt out in pairs of blocks.
BLOCK = 256
#: Rows of a table of keys that may be broadcast (24 bytes each).
FEW = 800_000
#: Columns of shared shingles that meet at once.
PART = 4096
#: The shingle of texts without words, which are copies of each other.
EMPTY = np.zeros(1, np.uint64)


def shingle_sets(column, words: int = SHINGLE) -> Iterator[np.ndarray]:
    """Of each row, the hashes of its distinct shingles, sorted; a shorter text is one shingle. Words are as in SimHash: A-Z as a-z, split at white space."""
    for _, bounds, data in pieces(column):
        starts, ends, first = word_spans(data, bounds)
        hashes = word_hashes(data, starts, ends, lower=True)
        grams = gram_hashes(hashes, words)
        for a, b in zip(first[:-1], first[1:]):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            else:
                yield gram_hashes(hashes[a:b], int(b - a)) if b > a else EMPTY


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The Jaccard similarity of two sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def tables_for(count: int) -> tuple[int, int]:
    """(segments of a lane, lanes) for so many texts."""
    parts = next((p for p in (5, 4, 3, 2) if count <= CHANCE * 2 ** (64 / p)), 2)
    found = (1 - APART) ** (64 / parts)
    return parts, max(3, ceil(log(MISSED) / log(1 - found) / parts))


def wide_fingerprint(shingles: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """A SimHash of 64 bits for each salt; a bit is 1 if set in over half of the salted hashes."""
    out = np.zeros(64 * len(salts), np.int64)
    for at in range(0, len(shingles), 255):  # so many bits add up in a byte
        hashes = mix(shingles[at : at + 255, None] ^ salts)
        out += np.unpackbits(hashes.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * out > len(shingles), bitorder="little").view(np.uint64)


def text_key() -> list[Column]:
    """128 bits of a text's hash."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2")]


def sketches(docs: DataFrame, lanes: int) -> DataFrame:
    """(key, k1, k2, least, w0, w1, ...) of each distinct text: a number, fixed once the rows are written, 128 bits of its hash, its smallest doc_id (null only without any) and its lanes."""
    salts = np.random.default_rng(42).integers(0, 1 << 64, lanes, dtype=np.uint64)
    names = [f"w{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(x, salts) for x in shingle_sets(batch.column(3))], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(np.ascontiguousarray(x).view(np.int64)) for x in found.T]], names=["doc_id", "k1", "k2", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(), "text").mapInArrow(run, f"doc_id long, k1 long, k2 long, {', '.join(f'{n} long' for n in names)}")
    return rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), *[F.first(n).alias(n) for n in names]).withColumn("key", F.monotonically_increasing_id())


def lane_buckets(keyed: DataFrame, columns: list[str], block: int) -> DataFrame:
    """As ``bucket_blocks``; which buckets are crowded is found first, so that rows needn't move to be told, and none is asked if there are no such buckets."""
    crowded = checkpointed(keyed.groupBy("part", "value").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("part", "value", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    many = crowded.count()
    member = F.struct(*columns)
    if many:
        dealt = keyed.join(F.broadcast(crowded) if many <= FEW else crowded, ["part", "value"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64(columns[0]), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = dealt.groupBy("part", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(member).alias("m"))
    else:
        met = keyed.groupBy("part", "value").agg(F.collect_list(member).alias("m"))
    return met.filter(F.size("m") > 1).select(*[F.col(f"m.{c}").alias(c) for c in columns])


def pivot_table(lanes: list[np.ndarray]) -> np.ndarray:
    """A row for each fingerprint: the distances of all bytes of its lanes to the first pivot, then to the next."""
    found = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) for x in lanes], axis=1)
    return np.concatenate([PIVOT_DISTANCES[:, p][found] for p in range(len(PIVOTS))], axis=1)


def survivors(table: np.ndarray, a: np.ndarray, b: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that the pivot table doesn't prove to differ in more than ``near`` bits."""
    width, stay = table.shape[1] // len(PIVOTS), np.zeros(len(a), bool)
    for at in range(0, len(a), ROWS):
        apart = np.abs(table[a[at : at + ROWS]] - table[b[at : at + ROWS]])
        most = apart[:, :width]
        for p in range(1, len(PIVOTS)):
            most = np.maximum(most, apart[:, p * width : (p + 1) * width])
        stay[at : at + ROWS] = most.sum(1, dtype=np.int16) <= near
    return a[stay], b[stay]


def candidates(sketched: DataFrame, parts: int, lanes: int, near: int = NEAR, block: int = BUCKET) -> DataFrame:
    """(a, b): edges whose components hold all texts that share a bucket and differ in at most ``near`` bits of three lanes."""
    lane = lambda i: F.col(f"w{i % lanes}")
    rows = [F.struct(F.lit(i * parts + k).alias("part"), masked(lane(i), m).alias("value"), lane(i).alias("x"), lane(i + 1).alias("y"), lane(i + 2).alias("z")) for i in range(lanes) for k, m in enumerate(segments(parts))]
    keyed = sketched.select("key", F.inline(F.array(*rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, *words = (np.asarray(c.flatten()) for c in batch.columns)
            sizes = np.asarray(batch.column(0).value_lengths())
            # Members in order of keys: buckets of one crowd then have mostly one root, and a member few edges in all.
            order = np.lexsort((keys, np.repeat(np.arange(len(sizes)), sizes)))
            keys, words = keys[order], [w[order] for w in words]
            table = pivot_table(words)
            ones, twos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in pairs_within(sizes):
                a, b = survivors(table, a, b, near)
                apart = np.zeros(len(a), np.uint8)
                for w in words:
                    apart += np.bitwise_count((w[a] ^ w[b]).view(np.uint64))  # of signed values it would count the magnitude's bits
                    stay = apart <= near
                    a, b, apart = a[stay], b[stay], apart[stay]
                ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
                root = ends[roots_of(len(ends), at[: len(a)], at[len(a) :])]
                ones.append(keys[ends[root != ends]])
                twos.append(keys[root[root != ends]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ones, twos)], names=["a", "b"])

    return lane_buckets(keyed, ["key", "x", "y", "z"], block).mapInArrow(run, "a long, b long").distinct()


def centre_links(texts: DataFrame, large: DataFrame, least: float = LEAST, words: int = SHINGLE, few: bool = False) -> DataFrame:
    """(a, b): the texts of large crowds that are similar to their crowd's centre b. texts: (key, crowd, text); large: (crowd). few: keys of texts were counted to be few enough for a broadcast, so that texts needn't move to meet them."""
    told = F.broadcast if few else lambda df: df
    inside = texts.join(told(large), "crowd", "left_semi")
    drawn = inside.groupBy("crowd").agg(F.min(F.struct(F.xxhash64(F.lit("centre"), "key").alias("draw"), "key")).alias("c")).select("crowd", F.col("c.key").alias("b"))
    centres = texts.join(told(drawn.withColumnRenamed("b", "key")), ["crowd", "key"]).select("crowd", F.col("key").alias("b"), F.col("text").alias("centre"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            near = []
            for i, (b, x) in enumerate(zip(batch.column(1).to_pylist(), shingle_sets(batch.column(2), words))):
                if b not in held:
                    held = {b: next(shingle_sets(batch.column(3).slice(i, 1), words))}
                near.append(similarity(x, held[b]) >= least)
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    both = inside.join(centres, "crowd").filter("key != b")
    return both.select(F.col("key").alias("a"), "b", "text", "centre").mapInArrow(run, "a long, b long")


def links_among(sets: list[np.ndarray], roots: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Positions of similar sets, so many as join the components of all similar ones; roots tell the components they have."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(x) for x in sets])
    row, often = np.repeat(np.arange(len(sets)), sizes), np.bincount(column) > 1
    row, column = row[often[column]], (np.cumsum(often) - 1)[column[often[column]]]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    both = np.zeros((len(sets), len(sets)))
    for at in range(0, int(often.sum()), PART):
        lo, hi = np.searchsorted(column, [at, at + PART])
        part = np.zeros((len(sets), PART), np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        both += part @ part.T
    near = both >= least * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    label, out = np.unique(roots, return_inverse=True)[1], []
    for i in range(len(sets)):
        others = np.flatnonzero(near[i])
        for j in others[label[others] != label[i]]:
            if label[j] != label[i]:
                out.append((i, int(j)))
                label[label == label[j]] = label[i]
    return out


def crowd_links(texts: DataFrame, centred: DataFrame | None = None, least: float = LEAST, block: int = BLOCK, words: int = SHINGLE, few: bool = False) -> DataFrame:
    """(a, b): links that, with those to centres, join the similar texts of each crowd. texts: (key, crowd, text); centred: (a, b) as from centre_links; few: as there."""
    told = F.broadcast if few else lambda df: df
    if centred is None:
        members = texts.withColumn("root", F.col("key")).withColumn("near", F.lit(False))
    else:
        # A centre is similar to itself.
        known = centred.unionByName(centred.select(F.col("b").alias("a"), "b").distinct()).select(F.col("a").alias("key"), F.col("b").alias("root"))
        members = texts.join(told(known), "key", "left").withColumn("near", F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "key"))
    blocks = lambda flag: F.ceil(F.count_if(flag) / F.lit(block)).cast("int")
    sizes = members.groupBy("crowd").agg(blocks(~F.col("near")).alias("opens"), blocks(F.col("near")).alias("nears")).filter("opens > 0")
    own = F.pmod(F.xxhash64("key"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("opens"))).cast("int")
    each = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.expr("cast(array() as array<struct<kind:int,i:int,j:int>>)"))
    met = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    # Open texts meet each other and those near the centre, which don't meet again among themselves.
    open_pairs = each(F.col("opens"), lambda o: met(0, F.least("own", o), F.greatest("own", o)))
    pairs = F.when(F.col("near"), each(F.col("opens"), lambda o: met(1, o, F.col("own")))).otherwise(F.concat(open_pairs, each(F.col("nears"), lambda c: met(1, F.col("own"), c))))
    dealt = members.join(told(sizes), "crowd").withColumn("own", own).select("key", "root", "crowd", "text", F.inline(pairs))

    def run(table: pa.Table) -> pa.Table:
        keys, roots = table["key"].to_numpy(), table["root"].to_numpy()
        found = np.array(links_among(list(shingle_sets(table["text"], words)), roots, least), np.int64).reshape(-1, 2)
        a, b = keys[found[:, 0]], keys[found[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return dealt.groupBy("crowd", "kind", "i", "j").applyInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, sketched: DataFrame, parts: int, lanes: int, least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """(node, root) of the keys of texts that have a link; root is the smallest of the component and has no row of its own."""
    crowds = components(candidates(sketched, parts, lanes))
    members = crowds.union(crowds.select("root", "root").distinct()).toDF("key", "crowd")
    members = checkpointed(members.join(sketched.select("key", "k1", "k2"), "key"))
    few = members.count() <= FEW
    texts = docs.select(*text_key(), "text").join(F.broadcast(members) if few else members, ["k1", "k2"]).groupBy("key").agg(F.first("crowd").alias("crowd"), F.first("text").alias("text"))
    texts = checkpointed(texts)
    large = checkpointed(texts.groupBy("crowd").count().filter(F.col("count") > block).select("crowd"))
    if large.isEmpty():
        return components(crowd_links(texts, None, least, block, few=few))
    centred = checkpointed(centre_links(texts, large, least, few=few))
    return components(centred.unionByName(crowd_links(texts, centred, least, block, few=few)))


def keep_one_row(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, that with the smallest doc_id, null last; of rows with one doc_id and text, one.

    Null and empty texts, and texts without words, are copies of each other.
    Columns pass through under any name. An empty table gives no rows.
    """
    parts, lanes = tables_for(docs.count())
    sketched = checkpointed(sketches(docs, lanes))
    roots = similar_components(docs, sketched, parts, lanes)
    labelled = sketched.select("key", "k1", "k2", "least").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kept = labelled.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "k1", "k2")).alias("k"))
    # An id as text without null, so that the join and the choice of one row are dealt out by the same columns.
    name = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("none"))
    kept = kept.select(name(F.col("k.least")).alias("id"), "k.k1", "k.k2")
    rows = docs.select(name(F.col("doc_id")).alias("id"), *text_key(), F.struct(*docs.columns).alias("row"))
    return rows.join(kept, ["id", "k1", "k2"]).dropDuplicates(["id", "k1", "k2"]).select("row.*")
