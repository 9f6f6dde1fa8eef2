"""Exact top-k inner products by MaxScore over sharded, impact-ordered postings.

A dimension is a term. A shard holds its vectors once, and for every term the
order of its documents by impact, so a query reads a term's list from the end
that suits its weight's sign. A few documents at the heads of the heaviest
lists set the first bar, the k-th best score so far. Terms are ordered by
weight; as many light ones as cannot lift a document over half the bar are
non-essential: together they add at most the sum of their bounds, and at most
the product of the query's and the document's norms over them. The other half
of the bar is shared out among the essential terms, and a list is read only
down to its share: a document in no part that was read stays under the bar.
The rest of the terms is probed for documents that still can reach the bar.
Each shard keeps its k best for each query; shards are merged by rank.

Queries travel as broadcast blocks of bounded size; the shards are written
once and scanned once for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siteweave.llm.common import checkpointed

TOP = 5
EVERY = 50
SHARD_ROWS = 8192
#: Bytes of a block of queries; blocks are broadcast one after the other.
BLOCK_BYTES = 32 << 20
#: Documents that set a query's first bar: so many at the heads of so many lists.
HEAD, LISTS = 16, 8
#: Terms probed between two looks at the bar.
PROBE = 8


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(256 x) of each component; null vectors, and those with a null or non-finite component, are left out, exact repeats kept once."""
    # Anything but a finite number fails this comparison.
    whole = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)))
    return (
        vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & whole)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
        .dropDuplicates(["vec_id", "v"])
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with 0."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten(), np.float64)
    return out


def posting_lists(docs: np.ndarray) -> np.ndarray:
    """[terms, documents]: each term's documents in order of their components."""
    return np.argsort(docs, axis=0, kind="stable").T.astype(np.int32)


def max_score(weights: np.ndarray, query_id: int, docs: np.ndarray, ids: np.ndarray, lists: np.ndarray, k: int, work: dict[str, int] | None = None) -> list[tuple[int, float]]:
    """(position, score) of a query's k best documents of other ids; ties go to the smaller id. docs are sorted by id. ``work`` counts postings and components read."""
    some = np.flatnonzero(weights)
    terms = some[np.argsort(-np.abs(weights[some]), kind="stable")]
    mine = ids == query_id
    sides = [lists[t][::-1] if weights[t] > 0 else lists[t] for t in terms]
    # Heads of lists: exact scores of a few documents give the first bar.
    heads = np.unique(np.concatenate([s[:HEAD] for s in sides[:LISTS]] or [np.zeros(0, np.int32)]))
    heads = heads[~mine[heads]]
    scores = docs[heads] @ weights
    bar = np.partition(scores, -k)[-k] if len(heads) >= k else -np.inf
    # What all terms from each on can add at most: by their bounds, and by norms.
    most = np.array([weights[t] * docs[s[0], t] for t, s in zip(terms, sides)])
    sums = np.concatenate([np.cumsum(most[::-1])[::-1], [0.0]])
    length = np.concatenate([np.cumsum(np.square(weights[terms])[::-1])[::-1], [0.0]]) ** 0.5
    squares = np.einsum("ij,ij->i", docs, docs)
    adds = np.minimum(sums, length * np.sqrt(squares.max(initial=0.0)))
    seen = np.ones(len(docs), bool)
    essential = min(len(terms), int(np.argmax(adds <= bar / 2))) if bar > 0 and len(terms) else 0
    if essential:
        # An essential term's share of what is left of the bar goes by its weight; above it the list is read.
        share = (bar - adds[essential]) / np.abs(weights[terms[:essential]]).sum()
        seen[:] = False
        for t, side in zip(terms[:essential], sides):
            impact = np.sign(weights[t]) * docs[side, t]
            read = side[: int(np.searchsorted(-impact, -share, side="right"))]
            seen[read] = True
            if work is not None:
                work["postings"] = work.get("postings", 0) + len(read)
    alive = np.flatnonzero(seen & ~mine)
    got, rest = np.zeros(len(alive)), squares[alive]
    for at in range(0, len(terms), PROBE):
        part = terms[at : at + PROBE]
        values = docs[np.ix_(alive, part)]
        got += values @ weights[part]
        rest -= np.einsum("ij,ij->i", values, values)
        if work is not None:
            work["components"] = work.get("components", 0) + values.size
        end = min(at + PROBE, len(terms))
        # Rounding may leave a norm slightly too small.
        reach = got + np.minimum(sums[end], length[end] * np.sqrt(np.maximum(rest, 0.0)) * (1 + 1e-9) + 1e-6)
        stay = reach >= bar
        alive, got, rest = alive[stay], got[stay], rest[stay]
    best = np.lexsort((ids[alive], -got))[:k]
    return list(zip(alive[best].tolist(), got[best].tolist()))


def shards_of(ints: DataFrame, shards: int, width: int) -> DataFrame:
    """(ids, vectors, lists) of each shard as bytes, written once; vectors sorted by id."""

    def index(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        docs = _matrix(table["v"].combine_chunks(), width)
        blobs = (np.asarray(table["vec_id"]).astype(np.int64), docs, posting_lists(docs))
        return pa.table({n: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for n, x in zip(("ids", "vectors", "lists"), blobs)})

    dealt = ints.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return checkpointed(dealt.groupBy("shard").applyInArrow(index, "ids binary, vectors binary, lists binary"))


def search(vectors: DataFrame, every: int = EVERY, k: int = TOP, shard_rows: int = SHARD_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each query's k best other vectors: (query_id, rank, vec_id, score).

    Queries are the vectors whose id is divisible by ``every``. They are
    broadcast in blocks of ``block_bytes``; a task holds one block and one
    shard of ``shard_rows`` vectors at a time. Shorter vectors count as filled
    up with 0. Ids repeated with other components: each row is a candidate and
    each such query's results are ranked together, a candidate counting once
    with its best score. No vectors give no rows. Sums are exact below 2**53.
    """
    spark = vectors.sparkSession
    ints = checkpointed(integer_vectors(vectors))
    is_query = F.col("vec_id") % every == 0
    some = ints.agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q"), F.max(F.size("v")).alias("width")).first()
    width = some["width"] or 1
    blocks = -(-(some["q"] or 1) * width * 8 // block_bytes)
    index = shards_of(ints, -(-(some["n"] or 1) // shard_rows), width)
    queries = ints.filter(is_query).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "vec_id"), F.lit(blocks)))

    def against(block: int) -> DataFrame:
        mine = queries.filter(F.col("block") == block).select("vec_id", "v").toArrow()  # about block_bytes
        held = spark.sparkContext.broadcast((np.asarray(mine["vec_id"]).astype(np.int64), _matrix(mine["v"].combine_chunks(), width)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, weights = held.value
            for batch in batches:
                for at in range(len(batch)):
                    ids, docs, lists = (np.frombuffer(batch.column(i)[at].as_buffer(), t) for i, t in enumerate((np.int64, np.float64, np.int32)))
                    docs, lists = docs.reshape(-1, width), lists.reshape(width, -1)
                    copies = int(np.unique(ids, return_counts=True)[1].max())  # rows that may share one candidate's id
                    rows = [(int(q), int(ids[d]), int(s)) for q, w in zip(query_ids, weights) for d, s in max_score(w, q, docs, ids, lists, k * copies)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

        return index.mapInArrow(run, "query_id long, vec_id long, score long")

    found = reduce(DataFrame.unionByName, [against(b) for b in range(blocks)])
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
