"""Removal of repeated word passages by prefix-partitioned suffix trees.

A suffix is a document read from one of its words on, here up to ``REACH``
words of it, as symbols that stand for ``STEP`` words each. Suffixes are dealt
out by prefix: a census counts every prefix of ``SHORT`` words, a suffix alone
under its prefix is a leaf of the tree and goes no further, and the more
suffixes share a prefix, the longer the prefixes that split them, so that a
group fits a task. A task builds the suffix tree of its group from the sorted
suffixes and the common prefixes of neighbours. The inner nodes of at least
``WINDOW`` words are repeats, and the deepest one that holds a suffix and an
earlier one tells how far the passage at this suffix is repeated: as far as
REACH, its maximal repeat. All suffixes below such nodes but the first are late.

Documents travel in chunks of about ``CHUNK`` bytes. Each chunk builds the
tree of its own suffixes first, in the same way, and sends only those that
aren't late inside it, so a passage that a third of all documents share is
sent once by each chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import parts, text_bytes
from siteweave.llm.words import gram_hashes, mix, pieces, word_hashes, word_spans

WINDOW = 20
REACH = 40
STEP = 5
SHORT = 10
#: Suffixes with one prefix above which longer prefixes split them, by STEP words for each factor of GROWTH.
CROWD, GROWTH = 100_000, 8
CHUNK = 8 << 20
#: Text bytes for each group of prefixes.
GROUP = 8 << 20
#: Bytes of a symbol.
WIDTH = 3


class Chunk:
    """The words and windows of a chunk's documents, in order of doc_id (nulls first) and then of text. Rows that repeat a document have no windows of their own."""

    def __init__(self, table: pa.Table, window: int):
        ids = table["doc_id"].combine_chunks().fill_null(np.iinfo(np.int64).min)
        self.table = table.append_column("place", ids).sort_by([("place", "ascending"), ("text_key", "ascending")])
        self.doc_ids, self.keys = (np.asarray(self.table[c]).astype(np.int64) for c in ("place", "text_key"))
        words, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)], 0
        for _, bounds, data in pieces(self.table["text"]):
            starts, ends, first = word_spans(data, bounds)
            words.append(word_hashes(data, starts, ends))
            firsts.append(first[1:] + at)
            at += len(starts)
        self.words, self.firsts = np.concatenate(words), np.concatenate(firsts)
        counts = np.diff(self.firsts)
        again = np.zeros(len(counts), bool)
        again[1:] = (self.doc_ids[1:] == self.doc_ids[:-1]) & (self.keys[1:] == self.keys[:-1])
        #: The first row of each row's document.
        self.lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(counts))))
        # Positions at which a whole window starts.
        n = np.where(again, 0, np.maximum(counts - window + 1, 0))
        self.row = np.repeat(np.arange(len(counts)), n)
        self.at = self.firsts[self.row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def prefixes(self, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct prefix hashes, how often each occurs, and the prefix of each window."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        values, inverse, counts = np.unique(gram_hashes(self.words, short)[self.at], return_inverse=True, return_counts=True)
        return values, counts, inverse

    def symbols(self, some: np.ndarray, reach: int) -> np.ndarray:
        """[n, reach / STEP]: the suffixes at these windows; 0 for symbols that aren't whole."""
        at, end = self.at[some], self.firsts[self.row[some] + 1]
        steps = gram_hashes(self.words, STEP) >> np.uint64(64 - 8 * WIDTH)
        out = np.zeros((len(some), reach // STEP), np.uint32)
        for k in range(out.shape[1]):
            whole = at + STEP * (k + 1) <= end
            out[whole, k] = np.maximum(steps[at[whole] + STEP * k], 1)
        return out

    def repeated(self, short: int, window: int, reach: int) -> np.ndarray:
        """For each window the symbols that its suffix has in common with an earlier one of this chunk, 0 for fewer than a window."""
        _, counts, prefix_of = self.prefixes(short)
        some = np.flatnonzero(counts[prefix_of] > 1) if len(self.at) else np.zeros(0, np.int64)
        out = np.zeros(len(self.at), np.uint8)
        out[some] = repeats(self.symbols(some, reach), np.arange(len(some)), window // STEP)
        return out


def suffix_tree(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(leaves from left to right, depth of the inner node that joins each leaf with the next): sorted suffixes and common prefixes of neighbours. Symbols that are 0 lie behind a suffix's end."""
    n, width = symbols.shape
    pairs = symbols.reshape(n, -1, 2).astype(np.uint64) if width % 2 == 0 else symbols[:, :, None].astype(np.uint64)
    keys = pairs[:, :, 0] if pairs.shape[2] == 1 else (pairs[:, :, 0] << np.uint64(32)) | pairs[:, :, 1]
    order = np.lexsort(keys.T[::-1])
    leaves = symbols[order]
    differs = (leaves[1:] != leaves[:-1]) | (leaves[1:] == 0)
    return order, np.where(differs.any(1), differs.argmax(1), width) if n > 1 else np.zeros(0, np.int64)


def nodes(depths: np.ndarray, depth: int) -> np.ndarray:
    """The number of the inner node of at least this depth above each leaf; a leaf without one has a number of its own."""
    return np.concatenate([[0], np.cumsum(depths < depth)])


def repeats(symbols: np.ndarray, place: np.ndarray, least: int) -> np.ndarray:
    """The depth of the deepest node over each suffix and one with a smaller place, 0 if under ``least``; places are distinct."""
    out = np.zeros(len(symbols), np.uint8)
    if len(symbols):
        order, depths = suffix_tree(symbols)
        placed = place[order]
        for depth in range(least, symbols.shape[1] + 1):
            node = nodes(depths, depth)
            first = np.minimum.reduceat(placed, np.flatnonzero(np.diff(node, prepend=-1)))
            out[order[placed > first[node]]] = depth
    return out


def prefix_symbols(suffixes: np.ndarray, crowd: int, short: int = SHORT, window: int = WINDOW) -> np.ndarray:
    """Symbols of the prefix that splits so many suffixes of one short prefix: longer ones the more there are, at most a window."""
    more = np.ceil(np.log(np.maximum(suffixes / crowd, 1)) / np.log(GROWTH)).astype(np.int64)
    return np.minimum(short // STEP + more, window // STEP)


def _by_group(values: np.ndarray, groups: int) -> np.ndarray:
    """Where each group's part of the sorted hashes begins: groups are equal ranges of hash values."""
    edges = [(g << 64) // groups for g in range(groups)]
    return np.append(np.searchsorted(values, np.array(edges, np.uint64)), len(values))


def _ascending(values: np.ndarray) -> bytes:
    """Ascending whole numbers as differences, lowest bytes of all first, so that what is zero lies together and compresses."""
    return np.diff(values.astype("<i8"), prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes()


def _ascended(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _table(rows: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({k: pa.array(v, types[k]) for k, v in rows.items()})


def remove_repeats(docs: DataFrame, window: int = WINDOW, short: int = SHORT, reach: int = REACH, crowd: int = CROWD, chunk_bytes: int = CHUNK, group_bytes: int = GROUP) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) of each document; kept is the kept words, joined by one space.

    A word goes if a window of ``window`` words covers it whose words also
    start earlier: in a document with a smaller doc_id (nulls first, then by a
    hash of the text), or earlier in the same one. Null and empty texts have
    no words. Rows that repeat a doc_id and text count as one document and
    each get their row. Texts shorter than a window are kept. An empty table
    gives no rows. Windows are compared by hashes of 96 bits.
    """
    if window % STEP or short % STEP or reach % STEP or not short <= window <= reach:
        raise ValueError(f"short, window and reach must be ascending multiples of {STEP}")
    total = text_bytes(docs)
    chunks, groups = parts(total, chunk_bytes), parts(total, group_bytes)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    # Rows with one doc_id share a chunk; those without are dealt out by their texts.
    dealt = F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.lit("chunk"), "doc_id")).otherwise(F.col("text_key"))
    chunked = keyed.withColumn("chunk", F.pmod(dealt, F.lit(chunks))).repartition("chunk")

    def census(table: pa.Table) -> pa.Table:
        values, counts, _ = Chunk(table, window).prefixes(short)
        bounds, number = _by_group(values, groups), table["chunk"][0].as_py()
        rows: dict[str, list] = {"grp": [], "chunk": [], "prefixes": [], "several": [], "counts": []}
        for g in np.flatnonzero(np.diff(bounds)):
            part = slice(bounds[g], bounds[g + 1])
            rows["grp"].append(g)
            rows["chunk"].append(number)
            # A group is a range of hashes: the low half tells its prefixes apart, chance agreement only costs work.
            rows["prefixes"].append(values[part].astype("<u4").tobytes())
            rows["several"].append(np.packbits(counts[part] > 1).tobytes())
            rows["counts"].append(counts[part][counts[part] > 1].astype("<u4").tobytes())
        return _table(rows, {"grp": pa.int64(), "chunk": pa.int64(), **{k: pa.binary() for k in ("prefixes", "several", "counts")}})

    def verdicts(table: pa.Table) -> pa.Table:
        """For each chunk's prefixes 0 where no other chunk has them, else the symbols of the prefix that splits their suffixes."""
        sent = [np.frombuffer(x, "<u4") for x in table["prefixes"].to_pylist()]
        counts = []
        for prefixes, several, many in zip(sent, table["several"].to_pylist(), table["counts"].to_pylist()):
            own = np.ones(len(prefixes), np.int64)
            own[np.unpackbits(np.frombuffer(several, np.uint8))[: len(prefixes)].astype(bool)] = np.frombuffer(many, "<u4")
            counts.append(own)
        _, inverse, in_chunks = np.unique(np.concatenate(sent), return_inverse=True, return_counts=True)
        suffixes = np.bincount(inverse, np.concatenate(counts))
        verdict = np.where(in_chunks > 1, prefix_symbols(suffixes, crowd, short, window), 0).astype(np.uint8)[inverse]
        back = np.split(verdict, np.cumsum([len(x) for x in sent])[:-1])
        return pa.table({"chunk": table["chunk"], "grp": table["grp"], "verdict": pa.array([x.tobytes() for x in back], pa.binary())})

    def suffixes(table: pa.Table, told: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"grp": [], "chunk": [], "symbols": [], "at": [], "doc_ids": [], "keys": []}
        if len(table) and len(told):
            chunk = Chunk(table, window)
            _, _, prefix_of = chunk.prefixes(short)
            verdict = np.frombuffer(b"".join(told.sort_by("grp")["verdict"].to_pylist()), np.uint8)[prefix_of]
            some = np.flatnonzero((verdict > 0) & (chunk.repeated(short, window, reach) == 0))
            symbols = chunk.symbols(some, reach)
            key = np.zeros(len(some), np.uint64)
            for i in range(window // STEP):
                key = np.where(i < verdict[some], mix(key + symbols[:, i]), key)
            group = (key >> np.uint64(8)) % np.uint64(groups)
            order = np.argsort(group, kind="stable")
            bounds = np.searchsorted(group[order], np.arange(groups + 1))
            for g in np.flatnonzero(np.diff(bounds)):
                part = order[bounds[g] : bounds[g + 1]]
                row = chunk.row[some[part]]
                rows["grp"].append(g)
                rows["chunk"].append(table["chunk"][0].as_py())
                rows["symbols"].append(symbols[part].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :WIDTH].tobytes())
                rows["at"].append(_ascending(chunk.at[some[part]]))
                rows["doc_ids"].append(_ascending(chunk.doc_ids[row]))
                # Texts tell documents apart only where ids don't.
                rows["keys"].append(chunk.keys[row].tobytes() if table["doc_id"].null_count else b"")
        return _table(rows, {"grp": pa.int64(), "chunk": pa.int64(), **{k: pa.binary() for k in ("symbols", "at", "doc_ids", "keys")}})

    def trees(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        at, doc = (np.concatenate([_ascended(x[name]) for x in sent]) for name in ("at", "doc_ids"))
        own = [len(x["at"]) // 8 for x in sent]
        key = np.concatenate([np.frombuffer(x["keys"], np.int64) if x["keys"] else np.zeros(n, np.int64) for x, n in zip(sent, own)])
        wide = np.zeros((len(at) * (reach // STEP), 4), np.uint8)
        wide[:, :WIDTH] = np.frombuffer(b"".join(x["symbols"] for x in sent), np.uint8).reshape(-1, WIDTH)
        place = np.empty(len(at), np.int64)
        place[np.lexsort((at, key, doc))] = np.arange(len(at))
        depth = repeats(wide.view("<u4").reshape(len(at), -1), place, window // STEP)
        bounds = np.concatenate([[0], np.cumsum(own)])
        rows: dict[str, list] = {"chunk": [], "at": [], "depth": []}
        for i, x in enumerate(sent):
            part = bounds[i] + np.flatnonzero(depth[bounds[i] : bounds[i + 1]])
            if len(part):
                rows["chunk"].append(x["chunk"])
                rows["at"].append(at[part].astype("<u4").tobytes())
                rows["depth"].append(depth[part].tobytes())
        return _table(rows, {"chunk": pa.int64(), "at": pa.binary(), "depth": pa.binary()})

    def rest(table: pa.Table, found: pa.Table) -> pa.Table:
        chunk = Chunk(table, window)
        inside = chunk.repeated(short, window, reach)
        late = [(chunk.at[inside > 0], inside[inside > 0]), *((np.frombuffer(x["at"], "<u4"), np.frombuffer(x["depth"], np.uint8)) for x in found.to_pylist())]
        covered = np.zeros(len(chunk.words) + 1, np.int64)
        for at, depth in late:
            np.add.at(covered, at, 1)
            np.add.at(covered, at + depth.astype(np.int64) * STEP, -1)
        gone = np.cumsum(covered)[:-1] > 0
        counts, kept, digests = [], [], []
        for i, (first, text) in enumerate(zip(chunk.lead, chunk.table["text"])):
            if first != i:  # a repeated row
                for out in (counts, kept, digests):
                    out.append(out[first])
                continue
            words = (text.as_py() or "").encode().split()
            here = gone[chunk.firsts[i] : chunk.firsts[i + 1]]
            left = b" ".join(words if not here.any() else [words[k] for k in np.flatnonzero(~here)])
            counts.append((len(words), int(here.sum())))
            kept.append(left)
            digests.append(hashlib.sha256(left).hexdigest())
        n = list(zip(*counts)) or [(), ()]
        return pa.table({"doc_id": chunk.table["doc_id"], "n_words": pa.array(n[0], pa.int64()), "n_removed": pa.array(n[1], pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string()), "kept_sha256": pa.array(digests, pa.string())})

    counted = chunked.groupBy("chunk").applyInArrow(census, "grp long, chunk long, prefixes binary, several binary, counts binary")
    told = counted.groupBy("grp").applyInArrow(verdicts, "chunk long, grp long, verdict binary")
    sent = chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(suffixes, "grp long, chunk long, symbols binary, at binary, doc_ids binary, keys binary")
    late = sent.groupBy("grp").applyInArrow(trees, "chunk long, at binary, depth binary")
    return chunked.groupBy("chunk").cogroup(late.groupBy("chunk")).applyInArrow(rest, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
