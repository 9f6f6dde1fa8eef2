"""Benchmark decontamination by winnowing, with built-in functions only.

The fingerprint of a window of ``WINDOW`` words is the smallest of its
``GRAM``-gram hashes. Consecutive windows mostly share it, so one fingerprint
stands for a stretch of windows; equal windows always have equal fingerprints,
which finds every shared span of that length. A document's stretches meet the
test fingerprints; each hit is extended over the windows of its stretch by
comparing whole windows. Items shorter than a window are looked for, in the
same pass, where their first word occurs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.llm.common import checkpointed

WINDOW = 10
GRAM = 5
#: Up to so many rows, the test side is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), GAP), "")


def _each(count: Column, body: Callable[[Column], Column], of_type: str) -> Column:
    """body(0) .. body(count - 1)."""
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), body)).otherwise(F.expr(f"cast(array() as array<{of_type}>)"))


def _minima(words: Column, window: int, gram: int, body: Callable[[Column], Column]) -> Column:
    """body applied to the array of each window's smallest gram hash."""
    width = window - gram + 1
    grams = _each(F.size(words) - gram + 1, lambda i: F.xxhash64(F.slice(words, i + 1, gram)), "bigint")
    return _let(grams, lambda g: _let(_each(F.size(g) - width + 1, lambda i: F.array_min(F.slice(g, i + 1, width)), "bigint"), body))


def _stretches(words: Column, window: int, gram: int) -> Column:
    """Structs (start, stop, fp): windows start .. stop - 1 have the same fingerprint."""

    def cut(m: Column) -> Column:
        new = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (x != F.get(m, i - 1)), i)), lambda i: i.isNotNull())
        return _let(new, lambda at: F.transform(at, lambda i, j: F.struct(i.alias("start"), F.coalesce(F.get(at, j + 1), F.size(m)).alias("stop"), F.get(m, i).alias("fp"))))

    return _minima(words, window, gram, cut)


def _first_word(word: Column) -> Column:
    """The fingerprint of items that are shorter than a window."""
    return F.xxhash64(F.lit(2), word)


def _content(words: Column, start: Column, length: int | Column) -> Column:
    """128 bits of the window's words."""
    return _let(F.slice(words, start + 1, length), lambda w: F.struct(F.xxhash64(w).alias("x"), F.xxhash64(F.lit(1), w).alias("y")))


def _sized(df: DataFrame, limit: int) -> DataFrame:
    """With a broadcast hint if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def test_windows(items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, n, fp, content) of each distinct window; an item shorter than a window is one window of its n words, whose fingerprint is its first word's."""
    words = items.filter("item_id is not null and text is not null").select("item_id", _words().alias("w"))
    long = F.transform(F.array("w"), lambda w: _minima(w, window, gram, lambda m: F.transform(m, lambda x, i: F.struct(F.lit(window).alias("n"), x.alias("fp"), _content(w, i, window).alias("content")))))[0]
    n = F.size("w")
    short = F.transform(F.array("w"), lambda w: F.array(F.struct(F.size(w).alias("n"), _first_word(w[0]).alias("fp"), _content(w, F.lit(0), F.size(w)).alias("content"))))[0]
    return words.filter(n > 0).select("item_id", F.inline(F.when(n >= window, long).otherwise(short))).distinct()


def distinct_windows(tests: DataFrame) -> DataFrame:
    """(content, n, fp, owners): each window once; windows of the same items have the same owners, 128 bits."""
    owners = F.struct(F.bit_xor(F.xxhash64("item_id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("y"))
    return tests.groupBy("content").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), owners.alias("owners"))


def candidates(docs: DataFrame, windows: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, n_words, near): each distinct document, with the places start .. stop - 1 whose fingerprint occurs in the test's windows of lengths ``sizes``."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce("text", F.lit("")).alias("text"))
    # A document's words are split once: its number of words travels with its stretches, as one that starts before 0.
    whole = lambda w: F.array(F.struct(F.lit(-1).alias("start"), F.size(w).alias("stop"), F.xxhash64("doc_id", "text_key").alias("fp")))
    places = [whole, lambda w: _stretches(w, window, gram)]
    if not windows.filter(F.col("n") < window).isEmpty():
        # Items shorter than a window start at one of their first words, whatever their lengths.
        places.append(lambda w: F.transform(w, lambda x, i: F.struct(i.alias("start"), (i + 1).alias("stop"), _first_word(x).alias("fp"))))
    stretches = keyed.select("doc_id", "text_key", F.inline(_let(_words(), lambda w: F.concat(*[of(w) for of in places]))))
    known = windows.groupBy("fp").agg(F.collect_set("n").alias("sizes"))
    told = stretches.join(_sized(known, broadcast_rows), "fp", "left").filter("start < 0 or sizes is not null")
    is_whole = F.col("start") < 0
    return told.groupBy("doc_id", "text_key").agg(F.max(F.when(is_whole, F.col("stop"))).alias("n_words"), F.collect_set(F.when(~is_whole, F.struct("start", "stop", "sizes"))).alias("near"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, start, n, owners): where items' windows occur in documents, each window once however many items have it."""
    windows = checkpointed(distinct_windows(test_windows(items, window, gram)))
    return extended(docs, candidates(docs, windows, window, gram, broadcast_rows), windows, broadcast_rows)


def extended(docs: DataFrame, told: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The hits among the candidates' places, compared whole."""
    keyed = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    near = told.filter(F.size("near") > 0).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "near")
    again = keyed.join(near, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))).select("doc_id", "text_key", "text", "near")
    of_size = lambda r, n: F.transform(F.sequence(r["start"], r["stop"] - 1), lambda s: F.struct(s.alias("start"), n.alias("n")))
    places = F.flatten(F.transform("near", lambda r: F.flatten(F.transform(r["sizes"], lambda n: of_size(r, n)))))
    read = lambda w: F.transform(F.filter(places, lambda p: p["start"] + p["n"] <= F.size(w)), lambda p: F.struct(p["start"].alias("start"), _content(w, p["start"], p["n"]).alias("content")))
    found = again.select("doc_id", "text_key", F.inline(_let(_words(), read)))
    return found.join(_sized(windows.select("content", "owners", "n"), broadcast_rows), "content").select("doc_id", "text_key", "start", "n", "owners")


def named(found: DataFrame, tests: DataFrame, windows: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, text_key, items): the sorted ids, as strings, of the items whose windows a document holds."""
    # Windows of the same items are told apart by nothing here: one of them names the items, and a document asks for them once.
    one = windows.groupBy("owners").agg(F.min("content").alias("content"))
    of = one.join(tests.select("content", F.col("item_id").cast("string").alias("item")), "content").select("owners", "item")
    asked = found.select("doc_id", "text_key", "owners").distinct()
    return asked.join(_sized(of, broadcast_rows), "owners").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item")).alias("items"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items, contaminated) of each document; items are the sorted ids as strings.

    A null text has no words and no hits. Items without an id or words take no
    part; rows that repeat an item_id are one item. Rows that repeat a doc_id
    and text each get their row. Empty tables: no documents give no rows, no
    items give documents without hits.
    """
    tests = checkpointed(test_windows(items, window, gram))
    windows = checkpointed(distinct_windows(tests))
    told = checkpointed(candidates(docs, windows, window, gram))  # this and the next are read twice below
    found = checkpointed(extended(docs, told, windows))
    spans = found.select("doc_id", "text_key", "start", (F.col("start") + F.col("n")).alias("stop")).groupBy("doc_id", "text_key", "start").agg(F.max("stop").alias("stop"))
    before = Window.partitionBy("doc_id", "text_key").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(before), F.col("start"))))
    n_hit = spans.withColumn("fresh", fresh).groupBy("doc_id", "text_key").agg(F.sum("fresh").alias("n_hit"))
    both = n_hit.alias("h").join(named(found, tests, windows).alias("t"), F.expr("h.doc_id <=> t.doc_id and h.text_key = t.text_key")).select(F.col("h.doc_id").alias("i"), F.col("h.text_key").alias("k"), "n_hit", "items")
    words_of = told.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("n_words").cast("long").alias("n_words"))
    counted = docs.select("doc_id", F.xxhash64("text").alias("text_key")).join(words_of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))).drop("d", "t")
    out = counted.join(both, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left")
    items_of = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"), items_of.alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents without any hit.

    Null and empty texts have no words and stay; rows that repeat a doc_id and
    text stay or go together. Columns pass through under any name. No documents
    give no rows, no items all documents.
    """
    found = hits(docs, items, window, gram).select(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("k"))
    return rows.join(found, F.col("i").eqNullSafe(F.col("id")) & (F.col("k") == F.col("key")), "left_anti").select("row.*")
