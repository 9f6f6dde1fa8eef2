"""Harmonic packing of token sequences.

Class j holds pieces longer than capacity/(j+1) and up to capacity/j; each of
its bins takes j pieces, whatever their exact lengths. A piece that would
leave more than ``SLACK`` of its slot empty is cut: first at the exact slot of
the next class, then the same way for what is left, so two to four pieces fill
their slots nearly to the end. A bin's class fixes its number of pieces, so
workers that know how many pieces of a class come before theirs fill their
bins without hearing of each other.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from siteweave.llm.common import checkpointed
from siteweave.llm.words import pieces, word_spans

CAPACITY = 2048
END = 1
SLACK = 0.02
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Parts and words whose ids a task remembers; most are known as one of both kinds only.
CACHE_WORDS = 250_000
#: Documents for each rank group of a class, and the fewest groups.
GROUP_DOCS, LEAST_GROUPS = 1_000_000, 64
PIECES = "doc_id long, part long, start long, length long, ids_crc32 long, doc_tokens long"


def harmonic_class(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def cuts(total: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of ``total`` tokens, in order."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        j = capacity // rest
        slot, smaller = capacity // j, capacity // (j + 1)
        if rest >= (1 - slack) * slot or smaller < 1:
            out.append(rest)
            break
        out.append(smaller)
        rest -= smaller
    return out


#: The normaliser and pre-tokenizer for which words may be looked up one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: White space that parts words here; any other is left to the tokenizer.
_CUTS = b" \t\n\r"
_CUT = np.isin(np.arange(256), list(_CUTS))
#: Bytes whose words are looked up whole: apostrophes, which begin some parts, starts of special tokens, control characters and what is not ASCII.
_ODD = ~_CUT & (np.isin(np.arange(256), [0x27, 0x3C]) | (np.arange(256) < 0x21) | (np.arange(256) > 0x7E))
_ODD_BYTE = re.compile(b"[^!-&(-;=-~]")
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Kinds of bytes: white space 0, letters 1, digits 2, others 3.
_KIND = np.array([0 if c in _CUTS else 1 if chr(c).isalpha() and c < 128 else 2 if 0x30 <= c < 0x3A else 3 for c in range(256)], np.uint8)
_LATIN = "\u00DF-\u00F6\u00F8-\u012F\u0131-\u017F"
#: Words of printable ASCII and precomposed Latin letters: normalised by lower() alone, and split by _PARTS as the tokenizer would.
_PLAIN = re.compile(f"[!-~\u00C0-\u00D6\u00D8-\u00DE{_LATIN}]+")
_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
#: Characters that stand for bytes: printable ones for themselves, the others in order from 256 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}


class WordIds:
    """Ids of texts as little-endian uint32 bytes.

    Where the file declares the parts above, white space never joins tokens,
    so ids are looked up part by part. ASCII words without apostrophes are split
    for a piece of a batch at once and each different part is looked up once;
    another plain word is split by itself. Only parts new to the cache go to the
    tokenizer's model; any other word goes through the whole tokenizer. With any
    other tokenizer whole texts do.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        self.tokenizer, self.held, self.parts, self.limit = Tokenizer.from_file(path), {}, {}, cache_words
        self.model = self.tokenizer.model
        declared = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        self.by_word = declared == [NORMALIZER, {"type": "Sequence", "pretokenizers": [SPLIT, BYTE_LEVEL]}]

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            found = self.parts[text] = self.split(text if text.isascii() else "".join(map(_BYTES.__getitem__, text.encode())))
        return found

    def split(self, shown: str) -> bytes:
        return array("I", [x.id for x in self.model.tokenize(shown)]).tobytes()

    def word(self, text: str) -> bytes:
        if _PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
            return self.part(text) if text.isalpha() else b"".join(map(self.part, _PARTS.findall(text)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def lookup(self, found: bytes) -> bytes:
        """The ids of a part, or of a word with a byte that is left to ``word``."""
        ids = self.held.get(found)
        if ids is None:
            ids = self.held[found] = self.word(found.decode()) if _ODD_BYTE.search(found) else self.split(found.decode())
        return ids

    def column(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, bounds of the rows in ids) of consecutive texts; a null text is empty."""
        for row, bounds, data in pieces(texts):
            if not self.by_word:
                found = self.tokenizer.encode_batch([data[a:b].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:])], add_special_tokens=False)
                yield row, np.array([i for x in found for i in x.ids], "<u4"), np.cumsum([0, *[len(x.ids) for x in found]])
                continue
            for held in (self.held, self.parts):
                if len(held) > self.limit:
                    held.clear()
            starts, ends, first = word_spans(data, bounds, _CUT)
            kind, odd = _KIND[data], np.append(0, np.cumsum(_ODD[data], dtype=np.int64))
            whole = odd[ends] > odd[starts]
            edges = np.zeros(len(data) + 1, np.int8)
            edges[starts[whole]] = 1
            edges[ends[whole]] -= 1
            inside = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
            # A part begins with each digit and where the kind of byte changes, in a word that is looked up whole only with the word.
            begins = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == 2))[: len(data)] & ~inside
            begins[starts] = True
            dense = kind != 0
            places = np.flatnonzero(begins & dense)
            shown = np.where(inside, data, _LOWER[data])[dense]
            before = np.cumsum(dense)
            offsets = np.append(before[places] - 1, len(shown)).astype(np.int64)
            # Different parts are looked up once.
            words = pa.Array.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(shown)]).dictionary_encode()
            found, code = list(map(self.lookup, words.dictionary.to_pylist())), words.indices.to_numpy()
            first = np.searchsorted(places, np.append(starts, len(data))[first])
            ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
            many = sizes[code]
            sums = np.append(0, np.cumsum(many))
            at = np.arange(sums[-1]) + np.repeat((np.cumsum(sizes) - sizes)[code] - sums[:-1], many)
            yield row, ids[at], sums[first]

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [ids[a:b].tobytes() for _, ids, bounds in self.column(pa.array(texts, pa.string())) for a, b in zip(bounds[:-1], bounds[1:])]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document; ``part`` counts a document's pieces. A null text is empty and keeps its end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds(tokenizer)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for first, ids, bounds in ids_of.column(batch.column(1)):
                ends = bounds[1:] + np.arange(len(bounds) - 1)
                whole = np.full(len(ids) + len(ends), END, "<u4")
                inside = np.ones(len(whole), bool)
                inside[ends] = False
                whole[inside] = ids
                held, at = memoryview(whole).cast("B"), 0
                for doc_id, end in zip(doc_ids[first : first + len(ends)], (ends + 1).tolist()):
                    start, n = 0, end - at
                    for part, length in enumerate(cuts(n, capacity)):
                        rows.append((doc_id, part, start, length, zlib.crc32(held[4 * (at + start) : 4 * (at + start + length)]), n))
                        start += length
                    at = end
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "part", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def _best_fit(rows: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Puts the few pieces of unfinished bins, longest first, where they leave least room."""
    table = pa.Table.from_batches(list(rows)) if rows else None
    if table is None or not len(table):
        return
    table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
    by_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    bins, places, opened = [], [], 0
    for length in table["length"].to_pylist():
        room = next((r for r in range(length, capacity + 1) if by_room[r]), None)
        b, held = by_room[room].pop() if room is not None else (opened, 0)
        opened += room is None
        left = (capacity if room is None else room) - length
        bins.append(b)
        places.append(held)
        by_room[left].append((b, held + length))
    table = table.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(places, pa.int64()))
    yield from table.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "offset"]).combine_chunks().to_batches()


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    Null and empty texts are one end id. Repeated rows are packed as often as
    they occur; null doc_ids are ids like others. An empty table gives no
    rows. Class j's pieces are ranked through counts by (class, group): a bin
    is rank div j. Less than j pieces of each class stay over, 9,882 in all at
    most for a capacity of 2048, however large the input; one task packs those
    by best fit.
    """
    groups = max(LEAST_GROUPS, -(-docs.count() // group_docs))
    spark = docs.sparkSession
    # Pieces of repeated rows are the same but for their partition, which parts them; the checkpoint fixes it.
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(groups))
    found = token_pieces(docs, tokenizer, capacity).drop("part")
    found = checkpointed(found.withColumn("class", F.expr(f"{capacity} div length")).withColumn("group", group))
    counts = found.groupBy("class", "group").agg(F.count("*").alias("n"))
    before = Window.partitionBy("class").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("class", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    totals = counts.groupBy("class").agg(F.expr("sum(n) div class").alias("bins")).collect()  # at most one row for each length
    base, at = [], 0
    for row in sorted(totals, key=lambda r: r["class"]):
        base.append((row["class"], row["bins"], at))
        at += row["bins"]
    bases = spark.createDataFrame(base or [(0, 0, 0)], "class long, bins long, base long")
    # Equal pieces may change places: nothing that is returned tells them apart.
    rank = F.col("first") + F.row_number().over(Window.partitionBy("class", "group").orderBy("doc_id", "start", "ids_crc32", "length", "doc_tokens")) - 1
    ranked = found.join(starts, ["class", "group"]).withColumn("rank", rank).join(F.broadcast(bases), "class").withColumn("bin", F.expr("rank div class"))
    full = ranked.filter("bin < bins").withColumn("sequence_id", F.col("base") + F.col("bin"))
    above = Window.partitionBy("sequence_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(above), F.lit(0)))
    over = ranked.filter("bin >= bins").select("doc_id", "start", "length", "ids_crc32", "doc_tokens").repartition(1)
    over = over.mapInArrow(lambda rows: _best_fit(rows, capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(*columns).unionByName(over.withColumn("sequence_id", F.col("bin") + F.lit(at)).select(*columns))
