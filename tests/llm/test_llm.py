"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import inspect
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siteweave.llm import decontamination, language_id, line_dedup, lm_scoring, packing, sharding, simhash_dedup, substring_dedup, topk_search, warc
from siteweave.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def corpus(seed=5):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    long, shared = text(400), text(60)
    out = [(i, text(rng.randint(1, 80))) for i in range(40)]
    out += [(100, long), (101, long), (102, long + " extra"), (103, text(10) + " " + shared + " " + text(5)), (104, shared + " " + shared), (105, " ".join(["alpha"] * 90))]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "Äpfel ÉTÉ naïve—dash 中文字 x"), (204, "ALPHA Beta\ngamma\r\ndelta"), (205, "\n\n\n"), (None, "alpha beta gamma " * 9), (300, text(20000))]
    return [*out, (7, out[7][1]), (7, out[7][1])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "x", 1, 1, "clash", "clash") for i, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int, chunk string, fp string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def hashed(key, level, kid):
    return xxhash.xxh64_intdigest(int(kid).to_bytes(4, "little", signed=True), xxhash.xxh64_intdigest(level.encode(), xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42))) >> 11


def brute_place(key, shards):
    best = lambda level, kids: max((hashed(key, level, x), x) for x in kids)[1]
    for r in sorted(range(-(-shards // 8)), key=lambda r: -hashed(key, "region", r)):
        rack = best("rack", [2 * r, 2 * r + 1])
        shard = best("shard", range(4 * rack, 4 * rack + 4))
        if shard < shards:
            return shard
    return best("shard", range(min(shards, 8)))


def test_sharding(docs, none):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == len(corpus())
    for r in out:
        if r["doc_id"] is not None:
            assert r["shard"] == brute_place(r["doc_id"], 40) and r["grown_shard"] == brute_place(r["doc_id"], 41) and r["grown_shard"] in (r["shard"], 40)
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    texts = {i: t for i, t in corpus()}
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) for r in out)
    assert sharding.shard_documents(none).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    """Whatever the number of shards; grown_shard is the shard under one more, and shards stay nearly equal."""
    n = 8000
    rows = spark.range(n).select(*[sharding.place_of(F.col("id"), k).alias(f"s{k}") for k in range(1, 66)]).collect()
    for k in range(1, 65):
        assert all(r[f"s{k + 1}"] in (r[f"s{k}"], k) for r in rows)
        sizes = Counter(r[f"s{k}"] for r in rows)
        assert set(sizes) <= set(range(k))
        if k % 8 == 0:
            assert len(sizes) == k and max(sizes.values()) < 1.6 * n / k
    grown = sharding.shard_documents(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), 43).collect()
    assert all(r["shard"] == rows[r["doc_id"]]["s43"] and r["grown_shard"] == rows[r["doc_id"]]["s44"] for r in grown)


def test_weights_move_rows_only_where_they_change(spark):
    tree = sharding.uniform_tree(16)
    heavier = tuple(sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else x.weight) for x in tree)
    keys = spark.range(2000).withColumnRenamed("id", "k")
    rows = sharding.assign(sharding.assign(keys, "k", tree, "a"), "k", heavier, "b").filter("a != b").collect()
    region = {x.shard: x.region for x in tree}
    assert rows and all(region[r["b"]] == region[5] for r in rows)


def test_language_identification(spark, none):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    net = language_id.train(docs)
    out = language_id.identify(docs, net).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.97
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 --"), (4, "the " * 30000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in language_id.identify(odd, net).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] in net.langs and 0 < found[4]["score"] <= 1
    assert sorted(r["doc_id"] for r in language_id.keep_identified(odd, net).collect()) == [4]
    runs = {r["doc_id"]: r["runs"] for r in language_id.labelled_runs(odd, net).collect()}
    assert runs[1] == [] and sum(x["length"] for x in runs[4]) == 120000
    assert language_id.identify(none).count() == 0


def test_gradients_of_the_network():
    rng = np.random.default_rng(1)
    net = language_id.new_network(["a", "b", "c"], 3)
    for x in (net.table, net.inner):
        for i, y in enumerate(x):
            x[i] = y.astype(np.float64)
    net.out, net.shift = net.out.astype(np.float64), net.shift.astype(np.float64)
    data, lang = rng.integers(0, 6, (5, 4)), np.array([0, 1, 2, 1])
    mask = np.ones((5, 4))
    mask[3:, 1] = 0
    _, grads = language_id.gradients(net, data, mask, lang)
    for x, g in zip(net.parameters(), grads):
        for at in [tuple(rng.integers(0, n) for n in x.shape) for _ in range(6)] + [(2, 1)[: x.ndim]]:
            old, loss = x[at], []
            for d in (1e-4, -1e-4):
                x[at] = old + d
                loss.append(language_id.gradients(net, data, mask, lang)[0])
            x[at] = old
            assert g[at] == pytest.approx((loss[0] - loss[1]) / 2e-4, abs=2e-4)


def test_probabilities_against_brute_force():
    """The network step by step, byte by byte, in windows of 128 bytes, for short, long and empty texts."""
    net = language_id.new_network(["a", "b", "c"], 5, seed=3)
    sigmoid, rng = lambda x: 1 / (1 + np.exp(-x)), random.Random(1)

    def states(window, d):
        h, out = np.zeros(5), {}
        for t in range(len(window)) if d == 0 else reversed(range(len(window))):
            a, u = net.table[d][window[t]], h @ net.inner[d]
            z, r = sigmoid(a[:5] + u[:5]), sigmoid(a[5:10] + u[5:10])
            h = (1 - z) * np.tanh(a[10:] + r * u[10:]) + z * h
            out[t] = h
        return out

    texts = ["x", "", "Ünïcode and more", "".join(rng.choice("abcdé \n") for _ in range(700)), None]
    got, labels = language_id.document_probabilities(net, pa.array(texts)), language_id.position_labels(net, pa.array(texts))
    for i, text in enumerate(texts):
        data, p = (text or "").encode(), []
        for at in range(0, len(data), 128):
            window = data[at : at + 128]
            ahead, back = states(window, 0), states(window, 1)
            logits = np.array([np.concatenate([ahead[t], back[t]]) @ net.out + net.shift for t in range(len(window))])
            p += list(np.exp(logits) / np.exp(logits).sum(1, keepdims=True))
        assert np.allclose(got[i], np.mean(p, 0) if p else 0, atol=1e-5)
        assert [int(x) for x in labels[i]] == [int(np.argmax(x)) for x in p]


def test_uncertain_texts_are_rejected(spark):
    """The network decides, not only the letters; repeated rows and clashing columns."""
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    samples = language_id.training_sample(docs)
    net = language_id.fit(samples)
    least = language_id.least_certain(net, samples)
    assert 1 / len(net.langs) < least < 0.5
    kept = language_id.keep_identified(docs, net, least)
    scores = language_id.identify(docs, net)
    assert kept.count() == scores.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).count() > 0.99 * docs.filter("text rlike '[a-z]'").count()
    flat = language_id.new_network(net.langs)
    for x in flat.parameters():
        x[:] = 0  # every language is as likely
    twice = docs.limit(20).withColumns({"letter": F.lit(1), "score": F.lit("x")})
    assert language_id.keep_identified(twice, flat, least).count() == 0
    assert language_id.keep_identified(twice.union(twice), net, least).columns == twice.columns
    many = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"))
    assert len({x for x, _ in language_id.training_sample(many)}) > 200


def brute_top(vectors, every, k):
    ints = {(i, tuple(int(np.floor(np.float64(np.float32(x)) * 256)) for x in v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in ints if i % every == 0}):
        best = {}
        for i, v in ints:
            for j, w in ints:
                if i == q and j != q:
                    best[j] = max(best.get(j, -(10**18)), sum(a * b for a, b in zip(v, w)))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(q, n + 1, j, s) for n, (j, s) in enumerate(ranked)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows,block_bytes", [(8192, 32 << 20), (20, 200)])
def test_topk_search(spark, shard_rows, block_bytes):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) if rng.random() < 0.7 else 0.0 for _ in range(8)]) for i in range(120)]
    rows += [(200 + i, rows[50][1]) for i in range(9)] + [(300, None), (350, [1.0] * 7 + [None]), (400, [float("nan")] * 8), (450, [float("inf")] * 8), (None, rows[0][1]), (500, [0.5] * 5), (3, [9.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, score int, shard string")
    found = topk_search.search(df, shard_rows=shard_rows, block_bytes=block_bytes)
    assert collected(found, "query_id", "rank", "vec_id", "score") == brute_top(rows, 50, 5)
    assert topk_search.search(df.limit(0)).count() == 0
    assert topk_search.search(df.filter("vec_id = 50")).count() == 0


@pytest.mark.parametrize("kind", ["sparse", "clustered", "random", "negative"])
def test_max_score_reads_parts_of_lists(kind):
    """The same results as all products; where vectors are sparse or clustered, a small part of the postings and components is read."""
    rng = np.random.default_rng(6)
    docs = np.floor(rng.normal(0, 40, (3000, 32)))
    if kind == "sparse":
        docs = np.maximum(docs, 0) * (rng.random(docs.shape) < 0.1)
    elif kind == "clustered":
        docs = np.floor(docs / 8) + 60 * rng.integers(-2, 3, (30, 32))[rng.integers(0, 30, 3000)]
    elif kind == "negative":
        docs = -np.abs(docs) - 1
        docs[0] *= -1
    ids, lists, work = np.arange(3000) * 3, topk_search.posting_lists(docs), {}
    for q in range(0, 3000, 150):
        got = topk_search.max_score(docs[q], ids[q], docs, ids, lists, 5, work)
        scores = docs @ docs[q]
        scores[q] = -np.inf
        want = np.lexsort((ids, -scores))[:5]
        assert got == [(d, scores[d]) for d in want]
    if kind in ("sparse", "clustered"):
        assert work["postings"] < 0.5 * 20 * docs.size and work["components"] < 0.35 * 20 * docs.size


def test_packing(docs, none):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for i, t in corpus():
        want[i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)] += 1
    pieces = packing.pack(docs).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    # Each id of each document lies in exactly one piece, whatever the cuts.
    for i, mine in by_doc.items():
        texts = [ids for (k, ids), n in want.items() if k == i for _ in range(n)]
        assert sum(r["length"] for r in mine) == sum(map(len, texts))
        for ids in set(texts):
            own = Counter((r["start"], r["length"]) for r in mine if r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()))
            covered = np.zeros(len(ids), int)
            for (at, n), times in own.items():
                covered[at : at + n] += times
            assert (covered == texts.count(ids)).all()
    used = sum(r["length"] for r in pieces)
    assert used == sum(len(ids) * n for (_, ids), n in want.items()) and used > 0.95 * 2048 * len(by_sequence)
    for rows in by_sequence.values():
        end = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= 2048
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 31, 64, 500, 683, 1023, 1024, 1025, 1500, 2047, 2048, 5000])
def test_cuts_fill_their_slots(n):
    parts = packing.cuts(n)
    assert sum(parts) == n and max(parts) <= 2048
    slots = sum(2048 / packing.harmonic_class(x) for x in parts)
    assert slots <= 1.04 * n + 2


def test_words_equal_whole_texts():
    tokenizer, ids = Tokenizer.from_file(packing.TOKENIZER), packing.WordIds(packing.TOKENIZER, 50)
    rng, letters = random.Random(4), "aAbß'sStTrReEvVmMlLdD09_-.,!éÉÇøØ×÷İıΣς中́​\xa0 \x0b\n\t<|>½٣"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert ids([text])[0] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_columns_of_texts_look_up_each_part_once(monkeypatch):
    """Ids of whole columns, also of empty, null and spaced texts, are the tokenizer's; a part that occurs in many words and cases is asked for once."""
    ids, rng = packing.WordIds(packing.TOKENIZER), random.Random(9)
    tokenizer, asked = Tokenizer.from_file(packing.TOKENIZER), Counter()
    lookup = ids.lookup
    monkeypatch.setattr(ids, "lookup", lambda found: asked.update([found]) or lookup(found))
    words = ["alpha", "Alpha,", "(ALPHA)", "beta2alpha", "it's", "'s", "été", "a<|b", "x\x0by", "don't!", "42", "--"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", " \t"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts = ["", None, "  ", *texts, " alpha", "Alpha", None, "\n"]
    got = [part.tolist() for _, flat, bounds in ids.column(pa.array(texts)) for part in np.split(flat, bounds[1:-1])]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert asked[b"alpha"] == 1 and b"Alpha," not in asked and max(asked.values()) == 1


@pytest.mark.parametrize("size", [8 << 20, 4000])
def test_lm_scoring(docs, none, size):
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(x for i, t in corpus() if not held(i) for x in tokens(t))
    total, types = sum(counts.values()), len(counts)
    out = lm_scoring.score(docs, chunk_bytes=size, group_bytes=size).collect()
    texts = {i: t for i, t in corpus()}
    assert len(out) == len(corpus())
    for r in out:
        mine = tokens(texts[r["doc_id"]])
        assert r["held_out"] == held(r["doc_id"]) and r["n_tokens"] == len(mine) and r["train_tokens"] == total
        assert r["n_known"] == sum(counts[x] > 0 for x in mine)
        assert r["base_score"] == pytest.approx(sum(np.log10((counts[x] + 1) / (total + types + 1)) for x in mine))
        assert r["score"] < 0
    assert lm_scoring.score(none).count() == 0


def test_filter_returns_levels():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    counts = rng.integers(1, 300, 3000)
    data, floor = lm_scoring.slice_of_filter(keys, counts, 1 << 22)
    held = lm_scoring.Filter(np.frombuffer(data, np.uint8), np.array([0, len(data)]), np.array([floor]))
    got, true = held.counts(keys), lm_scoring.expected(lm_scoring.levels(counts))
    assert floor == 1 and (got >= true).all() and (got == true).mean() > 0.95
    assert (held.counts(rng.integers(0, 1 << 32, 3000, dtype=np.uint64)) > 0).mean() < 0.05
    small, floor = lm_scoring.slice_of_filter(keys, counts, 40_000)
    assert floor > 1 and len(small) * 8 <= 40_008


@pytest.mark.parametrize("groups", [1, 2, 3, 64, 1000])
def test_lm_keys_travel_whole(groups):
    """Sorted keys as differences and bytes by place come back as they were; cuts follow the groups."""
    keys = np.sort(np.random.default_rng(groups).integers(0, 1 << 64, 5000, dtype=np.uint64))
    keys = np.concatenate([[np.uint64(0)], keys, [np.uint64((1 << 64) - 1)]])
    of, short = lm_scoring.group_of(keys, groups), np.unique(lm_scoring.shorts(keys, groups))
    begins, p = lm_scoring._cut(keys, groups), lm_scoring._cut_shorts(short, groups)
    for g in range(groups):
        assert (of[begins[g] : begins[g + 1]] == g).all()
        mine = short[p[g] : p[g + 1]] & np.uint64(0xFFFFFFFF)
        assert mine.tolist() == sorted({int(k) & 0xFFFFFFFF for k in keys[of == g]})
        assert (lm_scoring.unstepped(lm_scoring.steps(mine, "<u4"), "<u4") == mine).all()
    for x in (keys, keys[:0], keys[:1]):
        assert (lm_scoring.unstepped(lm_scoring.steps(x, "<u8"), "<u8") == x).all()
        assert (lm_scoring.unplaned(lm_scoring.planes(x, "<u8"), "<u8") == x).all()


@pytest.mark.parametrize("size", [8 << 20, 3000])
def test_lm_scores_lose_no_level(spark, size):
    """Every score against brute force on levels; score can't be told to leave low levels out."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.randint(20, 60)))) for i in range(150)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: [*t.encode().split(), None] for i, t in rows}
    words = Counter(x for i, t in tokens.items() if not held(i) for x in t)
    pairs = Counter(x for i, t in tokens.items() if not held(i) for x in zip([None, *t], t))
    near = lambda n: float(lm_scoring.expected(lm_scoring.levels(np.array([n])))[0]) if n else 0.0
    prob = lambda v, w, base: (near(pairs[v, w]) + lm_scoring.WEIGHT * base) / (max(near(words[v]), near(pairs[v, w])) + lm_scoring.WEIGHT)
    base = lambda w: (words[w] + 1) / (sum(words.values()) + len(words) + 1)
    want = {i: sum(np.log10(prob(v, w, base(w))) for v, w in zip([None, *t], t)) for i, t in tokens.items()}
    assert "max_bits" not in inspect.signature(lm_scoring.score).parameters
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=size, group_bytes=size).collect()
    off = np.array([abs(r["score"] / want[r["doc_id"]] - 1) for r in out])
    # Only the false positives of a Bloom filter may differ, mostly in unseen pairs of held-out rows.
    assert len(off) == len(rows) and np.median(off) < 1e-9 and off.mean() < 0.004 and off.max() < 0.04


def components_of(values, distance):
    ids = sorted(values, key=lambda x: (x is None, x))
    left, out = set(range(len(ids))), {}
    while left:
        todo, seen = [left.pop()], set()
        while todo:
            a = todo.pop()
            seen.add(a)
            near = {b for b in left if bin(values[ids[a]] ^ values[ids[b]]).count("1") <= distance}
            left -= near
            todo += near
        known = [ids[x] for x in seen if ids[x] is not None]
        out |= {ids[x]: min(known) if known else None for x in seen}
    return out


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [words] if 0 < len(words) < 4 else [words[i : i + 4] for i in range(len(words) - 3)]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_near_duplicates(docs, none):
    values = {i: brute_fingerprint(t) for i, t in corpus()}
    want = components_of(values, 4)
    out = simhash_dedup.near_duplicates(docs).collect()
    assert len(out) == len(corpus())
    assert all(r["fingerprint"] == f"{values[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]] for r in out)
    assert simhash_dedup.near_duplicates(none).count() == 0


def test_pivot_tables_discard_pairs(spark):
    """The table is the distances to the references, goes with each fingerprint, and discards nearly all pairs of a bucket before any is compared."""
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    fps[200:] = fps[:100] ^ (np.uint64(1) << rng.integers(0, 64, 100, dtype=np.uint64))
    rows = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").select("fp", *simhash_dedup.pivot_table(F.col("fp"))).collect()
    table = np.array([[*np.int64(r["t0"]).tobytes(), *np.int64(r["t1"]).tobytes()] for r in rows], np.int16)
    assert (table == np.bitwise_count(fps[:, None] ^ simhash_dedup.reference_fingerprints()[None, :])).all()
    pairs = [(a, b) for part in simhash_dedup.pairs_within(np.array([300]), 1000) for a, b in zip(*part)]
    assert len(pairs) == len(set(pairs)) == 300 * 299 // 2 and all(b < a for a, b in pairs)
    a, b = np.array(pairs).T
    left, right = simhash_dedup.survivors(table, a, b, 4)
    near = set(zip(a[close := np.bitwise_count(fps[a] ^ fps[b]) <= 4], b[close]))
    assert near <= set(zip(left, right)) and len(near) >= 100 and len(left) < len(near) + 0.002 * len(pairs)


def test_segments_are_coarse():
    assert len(simhash_dedup.segment_masks(10**6)) == 5 and len(simhash_dedup.segment_masks(10**8)) == 15
    assert list(simhash_dedup.pairs_within(np.array([1, 0, 1]))) == [] or all(len(a) == 0 for a, _ in simhash_dedup.pairs_within(np.array([1, 0, 1])))


@pytest.mark.parametrize("block", [4096, 16])
def test_links_of_crowded_fingerprints(spark, block):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = {}
    for i in range(220):
        v = centres[i % 3] if i < 180 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 6)):
            v ^= 1 << rng.randrange(64)
        values[i] = v
    distinct = sorted(set(values.values()))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in distinct], "fp long")
    roots = {r["node"]: r["root"] for r in simhash_dedup.components(simhash_dedup.link_forest(df, len(distinct), block=block)).collect()}
    want = components_of({v: v for v in distinct}, 4)
    groups = lambda f: sorted(sorted(v for v in distinct if f(v) == g) for g in {f(v) for v in distinct})
    assert groups(lambda v: roots.get(signed(v), signed(v))) == groups(lambda v: want[v])


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["root"] for r in simhash_dedup.components(edges).collect()} == {0, 100}


def brute_lines(rows, run=2, long=50):
    first, gone, done = {}, {}, set()
    for i, t in sorted({x for x in rows if x[1] is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = t.split("\n")
        for at in range(len(lines)):
            for n in (run, 1):
                part = lines[at : at + n]
                if len(part) == n and any(x.strip(" ") for x in part) and (n > 1 or len(part[0].encode().split()) >= long):
                    if first.setdefault((n, *part), (i, at)) != (i, at):
                        gone.setdefault(i, set()).update(range(at, at + n))
        done.add(i)
    return {i: (t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ()))) for i, t in rows}


def test_line_dedup(spark, none):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b b", "c", "", "d " * 55, "e"]) for _ in range(rng.randint(1, 9)))) for i in range(60)]
    rows += [(90, None), (91, ""), (92, "a\nb b"), (93, "\n\n\n"), (94, "\n".join(f"line {i % 700}" for i in range(1500)))]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in [*rows, rows[3]]], "doc_id long, text string, n_chars long, fp string")
    out = line_dedup.drop_repeated_lines(df).collect()
    want = brute_lines(rows)
    assert len(out) == len(rows) + 1
    for r in out:
        assert r["text"] == want[r["doc_id"]] and r["fp"] == "x"
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert line_dedup.drop_repeated_lines(none).count() == 0
    clash = df.withColumns({c: F.lit(5) for c in ("removed", "__id", "row", "key", "n_lines")})
    out = line_dedup.drop_repeated_lines(clash).collect()
    assert len(out) == len(rows) + 1 and all(r["text"] == want[r["doc_id"]] and r["removed"] == r["row"] == 5 for r in out)
    assert all(r["n_lines"] == (len(dict(rows)[r["doc_id"]].split("\n")) if dict(rows)[r["doc_id"]] is not None else 0) for r in out)
    assert line_dedup.drop_repeated_lines(clash, counts=False).columns == clash.columns


def test_winnowing_selects_fewer_lines_than_windows(spark):
    """One fingerprint for each run of windows with one minimum; equal runs have one in common; extension gives back all windows."""
    rng = random.Random(1)
    lines = [f"line {rng.randrange(10**6)}" for _ in range(300)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(lines[100:104])), (3, "\n".join(lines[7:9]))]
    found = line_dedup.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), run=4)
    mine = {i: {(r["fp"], r["at"]) for r in found.collect() if r["doc_id"] == i} for i in (1, 2)}
    assert len(mine[1]) < 0.6 * 297 and len(mine[2]) == 1 and {(f, at + 100) for f, at in mine[2]} <= mine[1]
    windows = line_dedup.extended(found, run=4).collect()
    assert sorted(r["start"] for r in windows if r["doc_id"] == 1) == list(range(297)) and [r["doc_id"] for r in windows if r["doc_id"] == 3] == []
    same = [r["start"] for r in windows if r["doc_id"] == 1 and r["content"] in [x["content"] for x in windows if x["doc_id"] == 2]]
    assert same == [100]


def test_decontamination(spark, docs, none):
    import re

    items = [(1, " ".join(corpus()[43][1].split()[12:40])), (2, "alpha BETA gamma"), (3, None), (4, ""), (5, "zzz"), (6, "alpha " * 14), (6, "extra"), (7, "中文字 x"), (None, "alpha"), (8, " ".join(corpus()[43][1].split()[12:40])), (9, "alpha beta"), (10, "Alpha Beta")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, fp string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - 9)) if w and i is not None else ():
            windows.setdefault(tuple(w[at : at + 10]), set()).add(str(i))
    want = {}
    for i, t in corpus():
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for at in range(len(w) - n + 1):
                if mine := windows.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    found |= mine
        want[i] = (len(w), len(hit), sorted(found), bool(hit))
    for rows in (500_000, 0):
        out = decontamination.contamination(docs, bench).collect() if rows else decontamination.hits(docs, bench, broadcast_rows=0).select("doc_id").distinct().collect()
        if rows:
            assert len(out) == len(corpus())
            assert all((r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == want[r["doc_id"]] for r in out)
        else:
            assert {r["doc_id"] for r in out} == {i for i, x in want.items() if x[3]}
    assert {r["doc_id"] for r in decontamination.keep_clean(docs, bench).collect()} == {i for i, x in want.items() if not x[3]}
    assert decontamination.contamination(none, bench).count() == 0
    assert not any(r["contaminated"] for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://x/{i}", "page %d " % (i % 7) * 900) for i in range(30)] + [(50, None, None), (51, "http://a b\r\nc", ""), (52, "u", "é" * 700_000), (None, "n", "only here"), (60, "u", "twice"), (60, "u", "twice")]
    df = spark.createDataFrame([(*x, "clash") for x in pages], "page_id long, url string, html string, is_revisit string").withColumns({c: F.lit("clash") for c in ("refers_to", "first", "__first", "digest", "salt")}).repartition(4)
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in pages:
        payload = (h or "").encode()
        revisit = h != "only here" and least[h or ""] != i
        want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", least[h or ""] if revisit else None))
    folder = f"file://{tmp_path}/w"
    out = warc.archive(df, folder)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collected(out, *columns) == sorted(want, key=str)
    index = spark.read.parquet(f"{folder}/index")
    some = warc.read_bundles(index, spark.createDataFrame([(52,), (8,)], "page_id long"))
    assert sorted(r["page_id"] for r in some.collect()) == [8, 52]
    bundle = next(tmp_path.glob("w/bundles/*.zst")).read_bytes()
    import io

    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bundle), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1")
    assert warc.archive(df.limit(0), f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize("size,crowd", [(8 << 20, 100_000), (3000, 100_000), (3000, 2)])
def test_substring_dedup(docs, none, size, crowd):
    seen, want = set(), {}
    for i, t in sorted(set(corpus()), key=lambda x: (x[0] is not None, x[0] or 0)):
        words = (t or "").encode().split()
        gone = set()
        for at in range(len(words) - 19):
            key = tuple(words[at : at + 20])
            gone.update(range(at, at + 20) if key in seen else ())
            seen.add(key)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        want[i] = (len(words), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest())
    out = substring_dedup.remove_repeats(docs, chunk_bytes=size, group_bytes=size, crowd=crowd).collect()
    assert len(out) == len(corpus())
    assert all((r["n_words"], r["n_removed"], r["kept"], r["kept_sha256"]) == want[r["doc_id"]] for r in out)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_suffix_tree_gives_maximal_repeats():
    """Depths of inner nodes, and of the deepest one with an earlier suffix, against all pairs."""
    rng = np.random.default_rng(0)
    symbols = rng.integers(1, 3, (60, 8)).astype(np.uint32)
    symbols[50:] = symbols[:10]
    for i in range(0, 60, 7):
        symbols[i, 5:] = 0  # suffixes that end earlier
    order, depths = substring_dedup.suffix_tree(symbols)
    common = lambda a, b: next((k for k in range(8) if symbols[a, k] != symbols[b, k] or symbols[a, k] == 0), 8)
    assert sorted(order) == list(range(60)) and all(tuple(symbols[a]) <= tuple(symbols[b]) for a, b in zip(order, order[1:]))
    assert [common(a, b) for a, b in zip(order, order[1:])] == depths.tolist()
    place = rng.permutation(60)
    want = [max([d for j in range(60) if place[j] < place[i] and (d := common(i, j)) >= 2], default=0) for i in range(60)]
    got = substring_dedup.repeats(symbols, place, 2)
    assert got.tolist() == want and {2, 3, 8} <= set(want)
    assert substring_dedup.prefix_symbols(np.array([1, 100, 101, 900, 10**9]), 100).tolist() == [2, 2, 3, 4, 4]


def test_packed_numbers_come_back():
    for values in (np.zeros(0, np.int64), np.array([np.iinfo(np.int64).min, -3, 5, 5, 10**12, np.iinfo(np.int64).max]), np.arange(1000) * 7):
        assert (substring_dedup._ascended(substring_dedup._ascending(values)) == values).all()


def test_repeats_of_passages_across_chunks(spark):
    """Chunks so small that nearly all repeats lie in different ones; a tree that found none would keep every word."""
    rng = random.Random(2)
    shared = [" ".join(f"s{k}x{i}" for i in range(n)) for k, n in enumerate((20, 33, 39, 40, 41, 75, 200))]
    rows = [(i if i % 9 else None, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " " + shared[i % 7] + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(70)]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=600, group_bytes=600).collect()
    assert sum(r["n_removed"] for r in out) == sum(9 * len(x.split()) for x in shared)
    assert sorted(r["n_removed"] for r in out).count(0) == 7


def test_packing_leaves_little_padding(spark):
    rows = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    out = packing.pack(rows.union(rows.limit(50)))
    filled, sequences = out.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert filled > 0.99 * 2048 * sequences
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, tokenizer = packing.WordIds(path), Tokenizer.from_file(path)
    texts = ["Two  spaces and\ttabs, l'été", ""]
    assert not ids.by_word and packing.WordIds(packing.TOKENIZER).by_word
    assert ids(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0
