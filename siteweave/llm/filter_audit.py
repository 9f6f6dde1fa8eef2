"""Filter interaction audit over a packed bitmap index.

Each row's failed filters are bits of a small number. Batches of rows become
numpy bitsets, one for each filter and label, in which every part has its own
run of 64-bit words; AND-NOT of the filters of a subset and a popcount give
what that subset leaves of each part. Subsets are the prefixes of all orders,
so the counts of the 2**n subsets, summed over batches, tell every order's
steps: removals are differences of two subsets that differ by one filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
LABELS = ("quality", "toxic")


def text_filters(text: Column) -> dict[str, Column]:
    """When a text fails: A under 50 words, B under 65 % of them distinct, C over 5 % capital letters, D one of the signs #$%&*|."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 50,
        "B": F.size(F.array_distinct(words)) * F.lit(100) < F.size(words) * F.lit(65),
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 5,
        "D": text.rlike(r"[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """(doc_id, part, key, mask) of each row of (doc_id, source, text): bit i of mask is set where the i-th filter fails; key is the SHA-256 of the text."""
    bits = [F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(filters.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), mask.alias("mask")
    )


def with_repeats(rows: DataFrame, bit: int) -> DataFrame:
    """Sets a bit of mask where a smaller doc_id has the same key. A row is no repeat if it holds its key's smallest doc_id, so rows meet by key and doc_id together and the copies of a text are dealt out."""
    firsts = rows.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    repeat = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(firsts, ["key", "doc_id"], "left").withColumn("mask", F.col("mask") + F.when(repeat, F.lit(1 << bit)).otherwise(F.lit(0))).drop("first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds booleans good (a label of the doc_id has quality 1) and toxic (one has toxic 1)."""
    told = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(n) for c, n in zip(LABELS, ("good", "bad"))])
    return rows.join(told, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic"))


def subset_counts(part: pa.Array, mask: np.ndarray, labels: list[np.ndarray], filters: int) -> tuple[pa.Array, np.ndarray]:
    """The parts of these rows and, by subset of filters, label (all rows first) and part, how many rows the subset leaves."""
    named = part.dictionary_encode()
    codes = named.indices.to_numpy()
    sizes = np.bincount(codes, minlength=len(named.dictionary))
    words = -(-sizes // 64)
    first = np.cumsum(words) - words
    by_part = np.argsort(codes, kind="stable")
    place = np.repeat(64 * first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))

    def bitset(flags: np.ndarray) -> np.ndarray:
        bits = np.zeros(64 * int(words.sum()), np.uint8)
        bits[place] = flags[by_part]
        return np.packbits(bits, bitorder="little").view(np.uint64)

    fails = [bitset(mask >> f & 1) for f in range(filters)]
    kept = [bitset(np.ones(len(codes), np.uint8)), *[bitset(x) for x in labels]]
    left = [np.full(len(kept[0]), ~np.uint64(0))]
    out = np.zeros((1 << filters, len(kept), len(sizes)), np.int64)
    for subset in range(1 << filters):
        if subset:
            last = subset.bit_length() - 1
            left.append(left[subset ^ 1 << last] & ~fails[last])
        for i, rows in enumerate(kept):
            out[subset, i] = np.add.reduceat(np.bitwise_count(left[subset] & rows).astype(np.int64), first)
    return named.dictionary, out


def counted(rows: DataFrame, filters: int) -> DataFrame:
    """(part, subset, n, good, toxic): the rows that a subset of filters leaves of each part. rows: (part, mask, good, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            mask, good, toxic = (np.asarray(x.to_numpy(zero_copy_only=False)) for x in batch.columns[1:])
            parts, counts = subset_counts(batch.column(0), mask, [good, toxic], filters)
            subsets, n = counts.shape[0], len(parts)
            yield pa.RecordBatch.from_arrays(
                [parts.take(pa.array(np.tile(np.arange(n), subsets))), pa.array(np.repeat(np.arange(subsets, dtype=np.int32), n)), *[pa.array(counts[:, i].ravel()) for i in range(3)]],
                names=["part", "subset", "n", "good", "toxic"],
            )

    found = rows.mapInArrow(run, "part string, subset int, n long, good long, toxic long")
    return found.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """One row for each part, order of the filters and step, from the counts of all subsets (at most 2**len(names) rows of a part)."""
    every = (1 << len(names)) - 1
    held = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("s"))
    n = lambda subset, what="n": F.get(F.col("s"), subset)[what]

    def shapley(f: int) -> Column:
        """Removals by filter f over all orders: a prefix set S comes before f in |S|! (m - 1 - |S|)! of them."""
        out = F.lit(0).cast("long")
        for s in range(every + 1):
            if not s >> f & 1:
                before = s.bit_count()
                out = out + (n(F.lit(s)) - n(F.lit(s | 1 << f))) * factorial(before) * factorial(len(names) - 1 - before)
        return out

    held = held.select("part", "s", F.array(*[shapley(f) for f in range(len(names))]).alias("all_orders"))
    steps = []
    for order in permutations(range(len(names))):
        done = 0
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(names[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("f"), F.lit(done).alias("before"), F.lit(done | 1 << f).alias("after")))
            done |= 1 << f
    out = held.select("part", "s", "all_orders", F.inline(F.array(*steps)))
    bit = F.col("after") - F.col("before")
    removed = lambda what="n": n(F.col("before"), what) - n(F.col("after"), what)
    return out.select(
        "part", "filter_order", "step", n(F.col("after")).alias("kept"), removed().alias("removed"), (n(F.lit(0)) - n(bit) - removed()).alias("redundant"),
        (n(F.lit(every) - bit) - n(F.lit(every))).alias("unique_fails"), removed("good").alias("good_lost"), removed("toxic").alias("toxic_lost"), F.get("all_orders", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, repeats: str = "E") -> DataFrame:
    """What each filter removes of each source at each step of every order of the filters.

    docs: (doc_id, source, text); labels: (doc_id, quality, toxic). filters:
    when a row fails, by a letter each (A to D of text_filters); repeats: the
    letter of the filter that fails a text which a smaller doc_id has too.

    Null texts are empty, null sources the part ''. Repeated rows count each; a
    row of the same doc_id and text is no repeat of the other. A null doc_id
    is not larger than any and has no label; of several labels of a doc_id any
    1 counts. An empty table gives no rows. Columns other than those named
    take no part.
    """
    filters = filters or text_filters(F.coalesce(F.col("text"), F.lit("")))
    rows = checkpointed(failures(docs, filters))  # read twice: for the firsts and for itself
    names = "".join(filters) + repeats
    flagged = with_labels(with_repeats(rows, len(filters)), labels)
    return interactions(counted(flagged, len(names)), names)
