"""Language-model scoring from a log-frequency Bloom filter.

The filter holds quantised counts of words and word pairs: an n-gram whose
count falls in level q (2**(q-1) up to 2**q - 1) is entered once for each
level up to q, and a look-up probes level after level until one is missing.
N-grams are dealt out to groups by hash; the task that adds up a group's
counts also writes the group's slice of the filter, whose bits grow with its
entries, so that every level of every n-gram is kept at any input size.

A word w after v has probability (c(v, w) + WEIGHT p(w)) / (c(v) + WEIGHT),
with c from the filter and p(w) the add-one probability from exact counts.
Each chunk of documents asks the groups for its own words and pairs by a
shuffle and is answered exact word counts and filter levels, so neither
vocabulary nor filter is ever broadcast or brought to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.common import checkpointed, parts, text_bytes
from siteweave.llm.words import mix, pieces, word_hashes, word_spans

FOLDS, HELD_OUT = 7, 2
WEIGHT = 200.0
BITS_PER_ENTRY = 10
PROBES = 3
CHUNK = 8 << 20
GROUP = 8 << 20
#: Tokens counted together in a task.
BLOCK_TOKENS = 4_000_000
PROBE_KEYS = 1 << 18
END = np.uint64(0x452821E638D01377)
PAIR = np.uint64(0x9FB21C651E98DF25)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves HELD_OUT; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def tokens_of(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of words and one end for each row, first token of each row and one more) of pieces of a text column, A-Z as a-z."""
    for _, bounds, data in pieces(column):
        starts, ends, first = word_spans(data, bounds)
        yield np.insert(word_hashes(data, starts, ends, lower=True), first[1:], END), first + np.arange(len(first))


def pair_keys(tokens: np.ndarray) -> np.ndarray:
    """A hash of each token and the one before it; a row starts after an end."""
    before = np.concatenate([[END], tokens[:-1]]) if len(tokens) else tokens
    return mix(before * PAIR + tokens)


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    """The range of equal size that each hash falls into."""
    return ((keys >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)


def _cut(keys: np.ndarray, groups: int) -> np.ndarray:
    return np.append(np.searchsorted(keys, np.array([-(-(g << 32) // groups) << 32 for g in range(groups)], np.uint64)), len(keys))


def shorts(keys: np.ndarray, groups: int) -> np.ndarray:
    """The group of each hash, before its low 32 bits."""
    return group_of(keys, groups).astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def _cut_shorts(keys: np.ndarray, groups: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange(groups + 1, dtype=np.uint64) << np.uint64(32))


def planes(values: np.ndarray, kind: str) -> bytes:
    """The lowest bytes of all values, then the next ones; high bytes, mostly 0, lie together and compress well."""
    return values.astype(kind).view(np.uint8).reshape(len(values), -1 if len(values) else 1).T.tobytes()


def unplaned(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def steps(keys: np.ndarray, kind: str) -> bytes:
    """Sorted keys as the differences from one to the next."""
    return planes(np.diff(keys, prepend=keys[:0].sum(dtype=keys.dtype)), kind)


def unstepped(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unplaned(data, kind), dtype=kind)


def _totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their summed counts, and the place of each key given."""
    values, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(inverse, np.concatenate(counts), len(values)).astype(np.int64), inverse


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.frexp(counts.astype(np.float64))[1]


def expected(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts, 0 for level 0."""
    return np.where(level > 0, (3 * 2.0 ** (level - 1) - 1) / 2, 0.0)


def probes(keys: np.ndarray, level: int | np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Positions of a key's bits on a level, a row for each probe."""
    salted = keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level).astype(np.uint64)
    return np.stack([mix(salted + np.uint64(i * 0x632BE59BD9B4E019 % (1 << 64))) % np.asarray(bits, np.uint64) for i in range(PROBES)])


def slice_of_filter(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None) -> tuple[bytes, int]:
    """(bits, floor): the keys' counts on all levels; with a limit, from the lowest floor on for which the bits suffice."""
    top = levels(counts)
    floor = 1
    while (entries := int(np.maximum(top - floor + 1, 0).sum())) * BITS_PER_ENTRY > (most_bits or np.inf):
        floor += 1
    size = max(1, -(-entries * BITS_PER_ENTRY // 8))
    marked = np.zeros(8 * size, bool)
    for level in range(floor, int(top.max(initial=0)) + 1):
        marked[probes(keys[top >= level], level, 8 * size).ravel().astype(np.int64)] = True
    return np.packbits(marked, bitorder="little").tobytes(), floor


@dataclass
class Filter:
    """Slices of the filter end to end, where each begins (bytes), and their floors."""

    data: np.ndarray
    begins: np.ndarray
    floors: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Expected counts by repeated membership probes."""
        return expected(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Highest levels by repeated membership probes, so many keys at a time; 0 for a key that isn't held."""
        parts_of = np.split(keys, range(PROBE_KEYS, len(keys), PROBE_KEYS))
        return np.concatenate([self._levels(x) for x in parts_of])

    def _levels(self, keys: np.ndarray) -> np.ndarray:
        groups = group_of(keys, len(self.floors))
        short = keys & np.uint64(0xFFFFFFFF)
        begin, bits = self.begins[groups] * 8, (self.begins[groups + 1] - self.begins[groups]) * 8
        level, found = self.floors[groups], np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        while len(alive):
            at = probes(short[alive], level[alive], bits[alive]).astype(np.int64) + begin[alive]
            alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0)]
            found[alive] = level[alive]
            level[alive] += 1
        return found


@dataclass
class Model:
    #: (grp, data, tokens, types): each group's slice of the filter with its totals.
    slices: DataFrame
    tokens: int
    distinct: int


def train(docs: DataFrame, groups: int) -> Model:
    """Counts all words, ends and word pairs of the documents and writes the filter's slices; only totals reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(blocks: list[np.ndarray]) -> pa.RecordBatch:
            rows: dict[str, list] = {"grp": [], "words": [], "word_counts": [], "pairs": [], "pair_counts": []}
            words, word_counts = np.unique(np.concatenate(blocks), return_counts=True)
            pairs, pair_counts = np.unique(np.concatenate([shorts(pair_keys(x), groups) for x in blocks]), return_counts=True)
            w, p = _cut(words, groups), _cut_shorts(pairs, groups)
            for g in range(groups):
                rows["grp"].append(g)
                rows["words"].append(steps(words[w[g] : w[g + 1]], "<u8"))
                rows["word_counts"].append(planes(word_counts[w[g] : w[g + 1]], "<u4"))
                rows["pairs"].append(steps(pairs[p[g] : p[g + 1]] & np.uint64(0xFFFFFFFF), "<u4"))
                rows["pair_counts"].append(planes(pair_counts[p[g] : p[g + 1]], "<u4"))
            return pa.RecordBatch.from_pydict(rows, schema=pa.schema([("grp", pa.int64()), *[(k, pa.binary()) for k in ("words", "word_counts", "pairs", "pair_counts")]]))

        held: list[np.ndarray] = []
        for batch in batches:
            for tokens, _ in tokens_of(batch.column(0)):
                held.append(tokens)
                if sum(map(len, held)) > BLOCK_TOKENS:
                    yield packed(held)
                    held = []
        if held:
            yield packed(held)

    def build(table: pa.Table) -> pa.Table:
        read = lambda name, kind, of: [of(x, kind) for x in table[name].to_pylist()]
        words, word_counts, _ = _totals(read("words", "<u8", unstepped), read("word_counts", "<u4", unplaned))
        pairs, pair_counts, _ = _totals(read("pairs", "<u4", unstepped), read("pair_counts", "<u4", unplaned))
        keys = np.concatenate([words & np.uint64(0xFFFFFFFF), pairs.astype(np.uint64)])
        data, _ = slice_of_filter(keys, np.concatenate([word_counts, pair_counts]))
        return pa.table({"grp": table["grp"][:1], "data": pa.array([data], pa.binary()), "tokens": pa.array([int(word_counts.sum())], pa.int64()), "types": pa.array([len(words)], pa.int64())})

    counted = docs.select("text").mapInArrow(count, "grp long, words binary, word_counts binary, pairs binary, pair_counts binary")
    slices = checkpointed(counted.groupBy("grp").applyInArrow(build, "grp long, data binary, tokens long, types long"))
    totals = slices.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    return Model(slices, totals["tokens"] or 0, totals["types"] or 0)


def score(docs: DataFrame, weight: float = WEIGHT, chunk_bytes: int = CHUNK, group_bytes: int = GROUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Null and empty texts are one end. Repeated rows each get their row (and
    count as often in training). Without training documents every count is 0.
    An empty table gives no rows.
    """
    total = text_bytes(docs)
    chunks, groups = parts(total, chunk_bytes), parts(total, group_bytes)
    model = train(docs.filter(~held_out()), groups)
    n_train, denominator = model.tokens, float(model.tokens + model.distinct + 1)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    chunked = keyed.withColumn("chunk", F.pmod(F.xxhash64(F.lit("chunk"), "doc_id", F.xxhash64("text")), F.lit(chunks))).repartition("chunk")

    def vocabulary(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A chunk's tokens, the first token of each row and one more, and its distinct tokens."""
        found = list(tokens_of(table["text"]))
        tokens = np.concatenate([x for x, _ in found])
        sizes = np.concatenate([np.diff(x) for _, x in found])
        return tokens, np.concatenate([[0], np.cumsum(sizes)]), np.unique(tokens)

    def ask(table: pa.Table) -> pa.Table:
        tokens, first, words = vocabulary(table)
        trained = ~np.asarray(table["held_out"].combine_chunks().cast(pa.int8())).astype(bool)
        counts = np.bincount(np.searchsorted(words, tokens), np.repeat(trained, np.diff(first)), len(words))
        pairs = np.unique(shorts(pair_keys(tokens), groups))
        w, p = _cut(words, groups), _cut_shorts(pairs, groups)
        some = np.flatnonzero(np.diff(w) + np.diff(p))
        part = lambda x, at, kind, to: pa.array([to(x[at[g] : at[g + 1]], kind) for g in some], pa.binary())
        return pa.table({"grp": pa.array(some, pa.int64()), "chunk": pa.array([table["chunk"][0].as_py()] * len(some), pa.int64()), "words": part(words, w, "<u8", steps), "counts": part(counts, w, "<u4", planes), "pairs": part(pairs & np.uint64(0xFFFFFFFF), p, "<u4", steps)})

    def answer(table: pa.Table, slices: pa.Table) -> pa.Table:
        if not len(table):
            return pa.table({"chunk": pa.array([], pa.int64()), "grp": pa.array([], pa.int64()), **{k: pa.array([], pa.binary()) for k in ("totals", "word_levels", "pair_levels")}})
        sent = [unstepped(x, "<u8") for x in table["words"].to_pylist()]
        asked = [unstepped(x, "<u4") for x in table["pairs"].to_pylist()]
        words, totals, inverse = _totals(sent, [unplaned(x, "<u4") for x in table["counts"].to_pylist()])
        # A group without training text has no slice.
        data = np.frombuffer(slices["data"][0].as_py() if len(slices) else b"\0", np.uint8)
        held = Filter(data, np.array([0, len(data)]), np.array([1]))
        pairs, pair_inverse = np.unique(np.concatenate(asked), return_inverse=True)
        back = lambda x, sizes, kind: pa.array([planes(y, kind) for y in np.split(x, np.cumsum([len(y) for y in sizes])[:-1])], pa.binary())
        return pa.table({"chunk": table["chunk"], "grp": table["grp"], "totals": back(totals[inverse], sent, "<u8"), "word_levels": back(held.levels(words)[inverse], sent, "u1"), "pair_levels": back(held.levels(pairs.astype(np.uint64))[pair_inverse], asked, "u1")})

    def rate(table: pa.Table, told: pa.Table) -> pa.Table:
        tokens, first, words = vocabulary(table)
        told = told.sort_by("grp")
        joined = lambda name, kind: np.concatenate([unplaned(x, kind) for x in told[name].to_pylist()])
        of = np.searchsorted(words, tokens)
        count = joined("totals", "<u8").astype(np.float64)[of]
        base = (count + 1) / denominator
        context = expected(joined("word_levels", "u1").astype(np.int64))[np.concatenate([np.searchsorted(words, [END]), of[:-1]])]
        _, pair_of = np.unique(shorts(pair_keys(tokens), groups), return_inverse=True)
        pair = expected(joined("pair_levels", "u1").astype(np.int64))[pair_of]
        p = (pair + weight * base) / (np.maximum(context, pair) + weight)
        by_row = lambda x: pa.array(np.add.reduceat(x, first[:-1]))
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(np.diff(first), pa.int64()), "n_known": by_row((count > 0).astype(np.int64)), "train_tokens": pa.array(np.full(len(table), n_train), pa.int64()), "base_score": by_row(np.log10(base)), "score": by_row(np.log10(p))})

    asked = chunked.groupBy("chunk").applyInArrow(ask, "grp long, chunk long, words binary, counts binary, pairs binary")
    told = asked.groupBy("grp").cogroup(model.slices.groupBy("grp")).applyInArrow(answer, "chunk long, grp long, totals binary, word_levels binary, pair_levels binary")
    return chunked.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
