"""Removal of repeated runs of lines, by winnowing over line hashes.

In every window of ``RUN`` consecutive lines the smallest line hash (the last
one of equals) is selected, and a line that many windows select is kept as one
fingerprint. Equal runs of that length select the same line, so each has a
fingerprint in common with its copies. Lines of ``LONG`` words or more are
fingerprints of their own. Fingerprints that occur in one place only are
settled at once. The places of the others are joined: each is extended both
ways over the windows that selected it, and every window meets the first place
that agrees with it line by line. All but the first of equal windows are
deleted, so of each maximal repeated run the first place stays whole. Built-in
functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed

RUN = 2
LONG = 50
WORD = r"[^\x20\x09-\x0D]+"


def _hashes(lines: Column) -> Column:
    """A hash of each line whose lowest bit tells whether the line shows anything."""
    return F.transform(lines, lambda x: F.xxhash64(x).bitwiseAND(F.lit(-2)).bitwiseOR(F.when(F.length(F.trim(x)) > 0, 1).otherwise(0).cast("long")))


def _shows(hashes: Column) -> Column:
    return F.exists(hashes, lambda h: h.bitwiseAND(F.lit(1)) == 1)


def _fingerprints(lines: Column, run: int, long: int) -> Column:
    """Structs (n, fp, at, first, around): the selected lines, the first window that selected each, and the hashes of all lines of its windows."""

    def least(h: Column, i: Column) -> Column:
        # The position counts down, so that the last one of equals is the smallest.
        return -F.array_min(F.transform(F.slice(h, i + 1, run), lambda x, j: F.struct(x.alias("h"), (-(i + j)).alias("p"))))["p"]

    def selected(h: Column) -> Column:
        windows = F.size(h) - run + 1
        chosen = F.when(windows > 0, F.transform(F.sequence(F.lit(0), windows - 1), lambda i: least(h, i))).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(F.array(chosen), lambda c: _stretches(h, c))[0]

    def _stretches(h: Column, c: Column) -> Column:
        starts = F.filter(F.transform(c, lambda p, i: F.when((i == 0) | (p != F.get(c, i - 1)), i)), lambda i: i.isNotNull())
        return F.transform(F.array(starts), lambda s: F.transform(s, lambda i, j: F.struct(
            F.lit(run).alias("n"), F.get(h, F.get(c, i)).alias("fp"), F.get(c, i).alias("at"), i.alias("first"),
            F.slice(h, i + 1, F.coalesce(F.get(s, j + 1), F.size(c)) - i + run - 1).alias("around"),
        )))[0]

    runs = F.transform(F.array(_hashes(lines)), selected)[0]
    whole = lambda x: F.array(F.xxhash64(x).bitwiseOR(F.lit(1)), F.xxhash64(F.lit(1), x))
    longs = F.transform(lines, lambda x, i: F.when(F.regexp_count(x, F.lit(WORD)) >= long, F.struct(F.lit(1).alias("n"), F.xxhash64(x).alias("fp"), i.alias("at"), i.alias("first"), whole(x).alias("around"))))
    return F.filter(F.concat(runs, longs), lambda x: x.isNotNull() & _shows(x["around"]))


def fingerprints(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, text_key, n, fp, at, first, around) of the lines that winnowing selects."""
    found = F.transform(F.array(F.split("text", "\n")), lambda lines: _fingerprints(lines, run, long))[0]
    return docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), F.inline(found))


def extended(places: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text_key, n, start, content): places extended to all windows that selected them; content is 128 bits of a window's lines."""
    content = lambda h: F.struct(F.xxhash64(h).alias("x"), F.xxhash64(F.lit(1), h).alias("y"))
    last = F.when(F.col("n") == 1, 0).otherwise(F.size("around") - run)
    windows = F.transform(F.sequence(F.lit(0), last), lambda s: F.struct((F.col("first") + s).alias("start"), F.when(F.col("n") == 1, F.col("around")).otherwise(F.slice("around", s + 1, run)).alias("lines")))
    shown = F.transform(F.filter(windows, lambda w: _shows(w["lines"])), lambda w: F.struct(w["start"].alias("start"), content(w["lines"]).alias("content")))
    return places.select("doc_id", "text_key", "n", F.inline(shown))


def removed_lines(docs: DataFrame, run: int = RUN, long: int = LONG) -> DataFrame:
    """(doc_id, text_key, removed): positions of the lines to delete, for documents that have any."""
    selected = fingerprints(docs, run, long)
    at = F.struct("doc_id", "text_key", "at")
    # Written tables on the small side let adaptive execution split the other side of a join at a very common line.
    shared = checkpointed(selected.groupBy("n", "fp").agg(F.min(at).alias("p"), F.max(at).alias("q")).filter("p != q").select("n", "fp"))
    windows = checkpointed(extended(selected.join(shared, ["n", "fp"], "left_semi"), run))
    place = F.struct("doc_id", "text_key", "start")
    first = checkpointed(windows.groupBy("n", "content").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first != last").drop("last"))
    later = windows.join(first, ["n", "content"]).filter(place != F.col("first"))
    lines = later.select("doc_id", "text_key", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line"))
    return lines.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("line")).alias("removed"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN, long: int = LONG, counts: bool = True) -> DataFrame:
    """The documents without later repeats; with ``counts`` also n_lines and n_removed, in place of columns of these names.

    A line is deleted if a window that covers it (``run`` lines, not all of
    them blank, or one line of ``long`` words) also starts earlier: at a
    smaller doc_id (nulls first, then by a hash of the text), or earlier in
    the same document. A null text stays null and has no lines; an empty text
    has one. Rows that repeat a doc_id and text count as one document. Other
    columns pass through under any name, n_chars follows the new text. Empty
    in, empty out.
    """
    # The input's columns travel in a struct of their own, so that none of their names can clash.
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"))
    removed = removed_lines(docs.select("doc_id", "text"), run, long).select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "removed")
    out = rows.join(removed, F.col("id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left")
    lines = F.split("row.text", "\n")
    keep = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda i: F.get(x, i))
    kept = F.transform(F.array(lines), lambda x: F.array_join(keep(x), "\n"))[0]
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(kept)
    count = lambda x: F.coalesce(F.greatest(F.size(x), F.lit(0)), F.lit(0)).cast("long")
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    added = {"n_lines": count(lines), "n_removed": count(F.col("removed"))} if counts else {}
    kept_columns = [(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in added]
    return out.select(*kept_columns, *[v.alias(k) for k, v in added.items()])
