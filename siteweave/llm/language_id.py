"""Language identification by a bidirectional gated recurrent network over bytes.

One gated recurrent unit reads a text's bytes forwards, another backwards; at
every byte both states give probabilities of the languages, and a document's
probabilities are the mean over all its bytes. Texts are read in windows of
``WINDOW`` bytes, each from a zero state, so that thousands of windows of
many documents advance together as the columns of a matrix and one very long
text is as quick as many short ones. Training is backpropagation through time
in numpy, on the driver, over a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteweave.llm.words import text_column

UNKNOWN = "und"
FOLDS = 5
WINDOW = 128
HIDDEN = 8
#: Bounds of the training sample: documents of all languages (many languages have fewer each, one at least), documents of a language, pieces of a document and characters of a piece.
SAMPLE_TOTAL, SAMPLE_DOCS, SAMPLE_PIECES, SAMPLE_CHARS = 38_400, 600, 3, 96
TRAIN_BYTES = 96
EPOCHS, BATCH, RATE = 6, 256, 0.02
SEED = 7
#: Windows that advance together.
COLUMNS = 2048


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text is divisible by FOLDS; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass
class Network:
    """For both directions: ``table`` [256, 3H] of each byte's input to update, reset and candidate; ``inner`` [H, 3H]; ``bias`` [3H] of the candidate's inner part. ``out`` [2H, L] and ``shift`` [L] give the languages' logits."""

    langs: list[str]
    table: list[np.ndarray]
    inner: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.table, *self.inner, self.out, self.shift]


def new_network(langs: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)
    return Network(langs, [normal(256, 3 * hidden) for _ in "><"], [normal(hidden, 3 * hidden) for _ in "><"], normal(2 * hidden, len(langs)), np.zeros(len(langs), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def gradients(net: Network, data: np.ndarray, mask: np.ndarray, lang: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions, and its gradients by backpropagation through time. data, mask: [T, N]; lang: [N]."""
    t_max, n = data.shape
    hidden = net.inner[0].shape[0]
    states, tapes = [], []
    for d, (table, inner) in enumerate(zip(net.table, net.inner)):
        h = np.zeros((n, hidden), np.float32)
        seen, tape = np.zeros((t_max, n, hidden), np.float32), {}
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            a, u = table[data[t]], h @ inner
            z = _sigmoid(a[:, :hidden] + u[:, :hidden])
            r = _sigmoid(a[:, hidden : 2 * hidden] + u[:, hidden : 2 * hidden])
            c = np.tanh(a[:, 2 * hidden :] + r * u[:, 2 * hidden :])
            tape[t] = h, z, r, c, u[:, 2 * hidden :]
            h = ((1 - z) * c + z * h) * mask[t][:, None]
            seen[t] = h
        states.append(seen)
        tapes.append(tape)
    both = np.concatenate(states, 2)
    p = _softmax(both @ net.out + net.shift)
    total = mask.sum()
    loss = -float((np.log(p[:, np.arange(n), lang] + 1e-9) * mask).sum() / total)
    dy = p
    dy[:, np.arange(n), lang] -= 1
    dy *= (mask / total)[:, :, None]
    d_out, d_shift = both.reshape(-1, 2 * hidden).T @ dy.reshape(-1, dy.shape[2]), dy.sum((0, 1))
    d_both = dy @ net.out.T
    d_tables, d_inners = [], []
    for d, (table, inner) in enumerate(zip(net.table, net.inner)):
        d_table, d_inner, dh = np.zeros_like(table), np.zeros_like(inner), np.zeros((n, hidden), np.float32)
        for t in range(t_max - 1, -1, -1) if d == 0 else range(t_max):
            h, z, r, c, uc = tapes[d][t]
            dh = (dh + d_both[t, :, d * hidden : (d + 1) * hidden]) * mask[t][:, None]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (h - c) * z * (1 - z)
            dr = dc * uc * r * (1 - r)
            da = np.concatenate([dz, dr, dc], 1)
            du = np.concatenate([dz, dr, dc * r], 1)
            np.add.at(d_table, data[t], da)
            d_inner += h.T @ du
            dh = dh * z + du @ inner.T
        d_tables.append(d_table)
        d_inners.append(d_inner)
    return loss, [*d_tables, *d_inners, d_out, d_shift]


def fit(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network trained by Adam on (language, bytes) pieces; languages weigh the same."""
    langs = sorted({x for x, _ in samples})
    net, rng = new_network(langs, hidden, seed), np.random.default_rng(seed)
    if len(langs) < 2:
        return net
    data = np.zeros((TRAIN_BYTES, len(samples)), np.uint8)
    mask = np.zeros((TRAIN_BYTES, len(samples)), np.float32)
    for i, (_, x) in enumerate(samples):
        x = x[:TRAIN_BYTES]
        data[: len(x), i], mask[: len(x), i] = np.frombuffer(x, np.uint8), 1
    lang = np.array([langs.index(x) for x, _ in samples])
    mask *= (len(samples) / len(langs) / np.bincount(lang, minlength=len(langs)))[lang].astype(np.float32)[None, :]
    seen = (mask > 0).astype(np.float32)
    weight = mask.max(0)
    params = net.parameters()
    first, second, step = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params], 0
    steps = epochs * -(-len(samples) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        # Pieces of small languages are drawn more often.
        order = rng.choice(len(samples), len(samples), p=weight / weight.sum()) if weight.max() > 1.5 * weight.min() else order
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            _, grads = gradients(net, data[:, some], seen[:, some], lang[some])
            step += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * step / steps)) * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for x, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                x -= (rate * m / (np.sqrt(v) + 1e-6)).astype(np.float32)
    return net


def position_probabilities(net: Network, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """[L, T, N]: the languages' probabilities at each position of the windows' columns; data is [T, N], sizes the bytes of each window."""
    t_max, n = data.shape
    hidden, whole = net.inner[0].shape[0], bool((sizes == t_max).all())
    both = np.empty((2 * hidden, t_max, n), np.float32)
    gates, work = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32)
    for d, (table, inner) in enumerate(zip(net.table, net.inner)):
        # Gates as tanh of half their input.
        half = np.ones(3 * hidden, np.float32)
        half[: 2 * hidden] = 0.5
        table_t, inner_t = np.ascontiguousarray((table * half).T), np.ascontiguousarray((inner * half).T)
        h = np.zeros((hidden, n), np.float32)
        for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
            np.take(table_t, data[t], axis=1, out=gates, mode="clip")
            np.matmul(inner_t, h, out=work)
            zr, c = gates[: 2 * hidden], gates[2 * hidden :]
            zr += work[: 2 * hidden]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= 0.5
            work[2 * hidden :] *= zr[hidden:]
            c += work[2 * hidden :]
            np.tanh(c, out=c)
            h -= c
            h *= zr[:hidden]
            h += c
            if not whole:
                h *= t < sizes
            both[d * hidden : (d + 1) * hidden, t] = h
    logits = np.matmul(net.out.T, both.reshape(2 * hidden, -1)) + net.shift[:, None]
    logits -= logits.max(0)
    np.exp(logits, out=logits)
    logits /= logits.sum(0)
    return logits.reshape(-1, t_max, n)


def _windows(column, size: int = WINDOW):
    """Bytes of a text column; of all windows: place in them, place in the text, size and row; bytes of each text. A text's last window may be shorter."""
    column = text_column(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), count)
    within = size * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
    return data, offsets[:-1][row] + within, within, np.minimum(size, lengths[row] - within), row, lengths


def _blocks(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int = WINDOW) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows, [T, N] bytes) of blocks of windows of like sizes."""
    order = np.argsort(-size, kind="stable")
    for at in range(0, len(order), COLUMNS):
        some = order[at : at + COLUMNS]
        longest = int(size[some[0]])
        places = np.minimum(start[some][None, :] + np.arange(longest)[:, None], len(data) - 1)
        yield some, data[places]


def document_probabilities(net: Network, column) -> np.ndarray:
    """[rows, L]: mean probabilities over each text's bytes, 0 for empty texts."""
    data, start, _, size, row, lengths = _windows(column)
    out = np.zeros((len(lengths), len(net.langs)))
    for some, block in _blocks(data, start, size):
        p = position_probabilities(net, block, size[some])
        p *= np.arange(len(block))[:, None] < size[some]
        np.add.at(out, row[some], p.sum(1).T)
    return out / np.maximum(lengths, 1)[:, None]


def position_labels(net: Network, column) -> list[np.ndarray]:
    """For each text, the position of the most probable language at each byte."""
    data, start, within, size, row, lengths = _windows(column)
    base = np.concatenate([[0], np.cumsum(lengths)])
    begin = base[row] + within
    labels = np.zeros(base[-1], np.int64)
    for some, block in _blocks(data, start, size):
        best = position_probabilities(net, block, size[some]).argmax(0)
        for k, w in enumerate(some):
            labels[begin[w] : begin[w] + size[w]] = best[: size[w], k]
    return np.split(labels, base[1:-1])


def training_sample(docs: DataFrame, docs_of_each: int = SAMPLE_DOCS, pieces: int = SAMPLE_PIECES, chars: int = SAMPLE_CHARS) -> list[tuple[str, bytes]]:
    """(language, bytes) of a bounded number of labelled pieces outside the held-out fold, drawn by hash from whole texts."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out())
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return []
    docs_of_each = max(1, min(docs_of_each, SAMPLE_TOTAL // len(counts)))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 40))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(int(min(1.0, 1.3 * docs_of_each / r["count"]) * (1 << 40))))])
    begin = lambda k: F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    cut = F.array_distinct(F.array(*[F.substring("text", begin(k).cast("int"), F.lit(chars)) for k in range(pieces)]))
    some = labelled.filter(F.col("text").isNotNull() & (draw < F.element_at(share, F.col("lang"))))
    rows = some.select("lang", draw.alias("draw"), cut.alias("cut")).orderBy("draw", "lang", "cut").limit(2 * docs_of_each * len(counts)).collect()
    taken: dict[str, int] = {}
    out = []
    for r in rows:
        if taken.setdefault(r["lang"], 0) < docs_of_each:
            taken[r["lang"]] += 1
            out += [(r["lang"], x.encode()) for x in r["cut"] if x]
    return out


def train(docs: DataFrame) -> Network:
    return fit(training_sample(docs))


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each document; the score is the mean probability of the predicted language.

    A text that is null or has no letter gets ``und`` and score 0, as do all
    texts if nothing can be learned. Learning takes text and lang only, a
    prediction text only. Repeated rows each get their row; an empty table
    gives no rows. A single learned language is predicted throughout.
    """
    net = net or train(docs)
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(net.langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = np.array([*net.langs, UNKNOWN])
        for batch in batches:
            p = document_probabilities(net, batch.column(3))
            known = np.asarray(batch.column(2).cast(pa.int8())).astype(bool)
            best = p.argmax(1) if p.shape[1] else np.zeros(len(p), int)
            score = np.where(known, p[np.arange(len(p)), best] if p.shape[1] else 0, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs[np.where(known, best, len(langs) - 1)].tolist(), pa.string()), pa.array(np.clip(score, 0, 1).astype(np.float64))], names=["doc_id", "held_out", "lang_pred", "score"])

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), letter.alias("letter"), "text")
    return columns.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def labelled_runs(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, runs): of each text, the stretches of bytes whose positions get one language, as (start, length, lang)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for labels in position_labels(net, batch.column(1)):
                edges = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]) if len(labels) else np.zeros(1, int)
                rows.append([{"start": int(a), "length": int(b - a), "lang": net.langs[labels[a]]} for a, b in zip(edges, edges[1:])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "runs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, runs array<struct<start:long,length:long,lang:string>>")


def least_certain(net: Network, samples: list[tuple[str, bytes]]) -> float:
    """A score between that of guessing and the lowest one of the labelled pieces: a text below it is less like any language than all that was learned from."""
    if len(net.langs) < 2:
        return 0.0
    lowest = document_probabilities(net, pa.array([x.decode(errors="replace") for _, x in samples])).max(1).min()
    return float(1 / len(net.langs) + lowest) / 2


def keep_identified(docs: DataFrame, net: Network | None = None, least: float | None = None) -> DataFrame:
    """The documents with a language whose score is at least ``least``, in one pass without a shuffle.

    Without a network one is trained, and ``least`` follows from its training
    pieces. Null and empty texts and those without any letter go. If no
    language can be learned, all with a letter stay. Repeated rows stay or go
    together; columns pass through under any name. An empty table gives no rows.
    """
    if net is None:
        samples = training_sample(docs)
        net = fit(samples)
        least = least_certain(net, samples) if least is None else least
    letter, least = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)), least or 0.0
    if not net.langs:
        return docs.filter(letter)
    # A row travels as one column, whatever its own columns are called.
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", letter.alias("letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = document_probabilities(net, batch.column(1)).max(1, initial=0)
            keep = np.asarray(batch.column(2).cast(pa.int8())).astype(bool) & (best >= least)
            yield batch.select([0]).filter(pa.array(keep))

    return rows.mapInArrow(run, rows.select("row").schema).select("row.*")
