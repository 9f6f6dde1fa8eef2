"""Source divergence audit: how far each source's terms are from the other sources and from the whole of its language.

Shares are integers in parts of 10**9 (``share``), their distance an integer
too (``apart``), so all results are exact. Two sources are compared by a sparse
sum: a term that neither holds adds the distance of both baselines, which is
counted once for all terms; a term of one source corrects it by that source's
share alone, so only its distinct shares matter; a term of both is corrected
in numpy, pairs of the term's sources a slice at a time. The best terms of a
group are found by radix selection: histograms over leading bits of the values
give the edge of the k-th, rows below it go, and ties at the last edge are cut
by their leading UTF-8 bytes in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed
from siteweave.llm.simhash_dedup import pairs_within
from siteweave.llm.words import pieces

SCALE = 1_000_000_000
LEAST_DOCS = 10
BEST = 10
#: Bits of a round of radix selection, and of the values (distances are at most SCALE + 1).
DIGIT, BITS = 16, 32
#: Ties of a group that a sort may hold.
TIES = 4096
#: Sources of a language that meet in one row.
BLOCK = 1024
#: Bytes of a table that may be broadcast.
SMALL = 32 << 20
#: Bytes of text whose terms are counted at once.
PIECE = 4 << 20

_inside = np.zeros(256, bool)
_inside[0x41:0x5B] = _inside[0x61:0x7B] = _inside[0x80:] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 0x20


def terms_of(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of consecutive rows, A-Z as a-z, and the row of each."""
    inside = _inside[data]
    begins, ends, cut = inside.copy(), inside.copy(), np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    offsets = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(_lower[data[inside]]))
    return terms, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents of each term. docs: (lang, source, text), without nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            group = langs.indices.to_numpy().astype(np.int64) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
            for first, bounds, data in pieces(batch.column(2), PIECE):
                terms, row = terms_of(data, bounds)
                if not len(terms):
                    continue
                coded = terms.dictionary_encode()
                code, many = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                keys, n = np.unique(group[first + row] * many + code, return_counts=True)
                each = np.unique(row * many + code)
                df = np.unique(group[first + each // many] * many + each % many, return_counts=True)[1]
                of = keys // many
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(of // len(sources.dictionary))), sources.dictionary.take(pa.array(of % len(sources.dictionary))),
                        coded.dictionary.cast(pa.string()).take(pa.array(keys % many)), pa.array(n.astype(np.int64)), pa.array(df.astype(np.int64)),
                    ],
                    names=["lang", "source", "term", "n", "df"],
                )

    found = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, df long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def kept_terms(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, total, leads): terms in at least so many documents of their language, its total of each, and one row of each term marked. A term has a row for each source at most."""
    of_term = Window.partitionBy("lang", "term")
    summed = counts.select("lang", "source", "term", "n", F.sum("df").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total"), (F.col("source") == F.min("source").over(of_term)).alias("leads"))
    return summed.filter(F.col("docs") >= least).drop("docs")


def group_sizes(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, idx, blocks, n, lang_n, v, base) of each group: its place among its language's sources, occurrences of kept terms in it and in its language, kept terms, and its share of a term that it lacks (null without kept terms)."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("leads").alias("leading"))
    sized = groups.join(of_group, ["lang", "source"], "left").na.fill(0, ["n", "leading"])
    of_lang = Window.partitionBy("lang")
    sized = sized.select("lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).alias("idx"), F.ceil(F.count("*").over(of_lang) / F.lit(BLOCK)).cast("int").alias("blocks"), "n", F.sum("n").over(of_lang).alias("lang_n"), F.sum("leading").over(of_lang).alias("v"))
    return sized.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), exact for any counts."""
    over = F.call_function("div", (count + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), (n + 2 * v).cast("decimal(20,0)"))
    return over + F.lit(1).cast("long")


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def few_bytes(df: DataFrame) -> DataFrame:
    """The table, to be broadcast if its rows are counted to be small; joined by a shuffle otherwise."""
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))).cast("long") + 64).alias("b")).first()["b"] or 0
    return F.broadcast(df) if held <= SMALL else df


def above_edge(rows: DataFrame, groups: list[str], digit: Column, k: int, smallest: bool = False) -> DataFrame:
    """The rows of each group that may be among its k largest (or smallest) by leading digits, with the edge: the last digit that the k need, by a histogram of digits."""
    first = F.col("digit").asc() if smallest else F.col("digit").desc()
    before = Window.partitionBy(*groups).orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*groups, digit.alias("digit")).agg(F.count("*").alias("many"))
    needed = bins.withColumn("before", F.coalesce(F.sum("many").over(before), F.lit(0))).filter(F.col("before") < k)
    edges = checkpointed(needed.groupBy(*groups).agg((F.max if smallest else F.min)("digit").alias("edge")))
    both = rows.drop("edge").join(few_bytes(edges), groups)
    return both.filter(digit <= F.col("edge") if smallest else digit >= F.col("edge"))


def best_of_groups(rows: DataFrame, groups: list[str], k: int = BEST, bits: int = BITS, ties: int = TIES) -> DataFrame:
    """(groups, item, value, rank): the k largest values of each group, ties to the item with smaller UTF-8 bytes. rows: (groups, item, value); values from 0 to 2**bits - 1, items of a group distinct.

    A group with fewer rows keeps all; an empty table gives none.
    """
    for shift in range(bits - DIGIT, -1, -DIGIT):
        rows = above_edge(rows, groups, F.shiftright("value", shift), k)
        rows = checkpointed(rows)
    # Now the edge is the k-th value; rows above it are fewer than k.
    rows, width = rows.withColumnRenamed("edge", "last"), 0
    while not rows.groupBy(*groups).count().filter(F.col("count") > k + ties).isEmpty():
        width += 2
        head = F.when(F.col("value") > F.col("last"), F.lit("")).otherwise(F.hex(F.substring(F.col("item").cast("binary"), 1, width)))
        rows = checkpointed(above_edge(rows, groups, head, k, smallest=True))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.col("value").desc(), "item")))
    return ranked.filter(F.col("rank") <= k).select(*groups, "item", "value", "rank")


def shared_corrections(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, a, b, shared), a < b by place: what terms of both sources add beyond what each alone corrects."""
    met = kept.join(few_bytes(sized.drop("lang_n")), ["lang", "source"]).withColumn("own", F.expr(f"idx div {BLOCK}").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("idx", "own", share(F.col("n_here"), F.col("n"), F.col("v")).alias("p"), "base")
    rows = met.groupBy("lang", "term", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).agg(F.collect_list(member).alias("m"))
    rows = rows.filter(F.size("m") > 1).select("lang", (F.col("i") == F.col("j")).alias("same"), *[F.col(f"m.{c}").alias(c) for c in ("idx", "own", "p", "base")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far = lambda p, q: (p - q) * (p - q) // (p + q)
        for batch in batches:
            if not len(batch):
                continue
            sizes = np.asarray(batch.column(2).value_lengths())
            idx, own, p, base = (np.asarray(c.flatten()).astype(np.int64) for c in batch.columns[2:])
            langs = batch.column(0).dictionary_encode()
            lang, same = (np.repeat(np.asarray(x.to_numpy(zero_copy_only=False)), sizes) for x in (langs.indices, batch.column(1)))
            most = int(idx.max()) + 1
            for a, b in pairs_within(sizes):
                stay = same[a] | (own[a] != own[b])
                a, b = a[stay], b[stay]
                if not len(a):
                    continue
                more = far(p[a], p[b]) - far(p[a], base[b]) - far(base[a], p[b]) + far(base[a], base[b])
                key = (lang[a].astype(np.int64) * most + np.minimum(idx[a], idx[b])) * most + np.maximum(idx[a], idx[b])
                by_key = np.argsort(key, kind="stable")
                keys, at = np.unique(key[by_key], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [langs.dictionary.take(pa.array(keys // most // most)), pa.array((keys // most % most).astype(np.int32)), pa.array((keys % most).astype(np.int32)), pa.array(np.add.reduceat(more[by_key], at))],
                    names=["lang", "a", "b", "shared"],
                )

    return rows.mapInArrow(run, "lang string, a int, b int, shared long").groupBy("lang", "a", "b").agg(F.sum("shared").alias("shared"))


def own_corrections(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, a, base, own): what the terms of source a add to the distance of baselines against a source with baseline ``base``. A source's distinct shares are few; they are dealt out over its language's baselines."""
    deals = 8
    shares = kept.join(few_bytes(sized), ["lang", "source"]).groupBy("lang", "idx", "blocks", "base", share(F.col("n_here"), F.col("n"), F.col("v")).alias("p")).agg(F.count("*").alias("many"))
    shares = shares.withColumn("deal", F.pmod(F.xxhash64("idx", "p"), F.col("blocks") * deals).cast("int")).withColumnRenamed("base", "mine")
    bases = sized.filter("v > 0").select("lang", "blocks", "base").distinct().select("lang", "base", F.explode(F.sequence(F.lit(0), F.col("blocks") * deals - 1)).alias("deal"))
    more = F.col("many") * (apart(F.col("p"), F.col("base")) - apart(F.col("mine"), F.col("base")))
    return shares.join(bases, ["lang", "deal"]).groupBy("lang", F.col("idx").alias("a"), "base").agg(F.sum(more).alias("own"))


def source_pairs(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each source from each other source of its language, over all kept terms; 0 without kept terms."""
    shared = shared_corrections(kept, sized)
    own = checkpointed(own_corrections(kept, sized))
    ones = sized.select("lang", "source", F.col("idx").alias("x"), F.col("base").alias("x_base"), "v", F.pmod("idx", "blocks").alias("deal"))
    twos = sized.select("lang", F.col("source").alias("item"), F.col("idx").alias("y"), F.col("base").alias("y_base"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("deal"))
    pairs = ones.join(twos, ["lang", "deal"]).filter("x != y").withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    pairs = pairs.join(shared, ["lang", "a", "b"], "left")
    pairs = pairs.join(own.select("lang", F.col("a").alias("x"), F.col("base").alias("y_base"), F.col("own").alias("by_x")), ["lang", "x", "y_base"], "left")
    pairs = pairs.join(own.select("lang", F.col("a").alias("y"), F.col("base").alias("x_base"), F.col("own").alias("by_y")), ["lang", "y", "x_base"], "left")
    zero = F.lit(0).cast("long")
    value = F.coalesce(F.col("v") * apart(F.col("x_base"), F.col("y_base")), zero) + F.coalesce("shared", zero) + F.coalesce("by_x", zero) + F.coalesce("by_y", zero)
    return pairs.select("lang", "source", "item", value.alias("value"))


def term_distances(kept: DataFrame, sized: DataFrame) -> DataFrame:
    """(lang, source, item, value): the distance of each group's terms from its language, where the group has more of them."""
    told = kept.join(few_bytes(sized), ["lang", "source"])
    told = told.select("lang", "source", F.col("term").alias("item"), share(F.col("n_here"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"))
    return told.filter("p > q").select("lang", "source", "item", apart(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCS, best: int = BEST) -> DataFrame:
    """(lang, source, part, item, value, rank): distances of each (lang, source) from the language's other sources (part pair, all ranks) and its terms furthest above the language (part term, the first ``best``).

    docs: (lang, source, text). Null texts, langs and sources are ''. Texts
    without terms still make their group, whose shares are those of unseen
    terms. Repeated rows count each. Ties go to the item with smaller UTF-8
    bytes. A language with one source has no pairs; an empty table gives no
    rows. Other columns take no part.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = checkpointed(kept_terms(counted_terms(docs), least))
    sized = checkpointed(group_sizes(docs.select("lang", "source").distinct(), kept))
    kept = kept.withColumnRenamed("n", "n_here")
    pairs = source_pairs(kept, sized)
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    terms = best_of_groups(term_distances(kept, sized), ["lang", "source"], best)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
