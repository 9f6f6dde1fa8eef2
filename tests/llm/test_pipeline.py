"""The whole pipeline against brute force on a small corpus."""

import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from siteweave.llm import near_copies, packing
from tests.llm.test_llm import brute_lines, corpus


def one_of_each(rows):
    """One row of each component of texts whose sets of five-word shingles have a similarity of 0.8."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return [min((x for x, q in zip(rows, root) if q == r), key=lambda x: (x[0] is None, x[0])) for r in dict.fromkeys(root)]


def test_pipeline(spark, tmp_path):
    rows = [x for n, x in enumerate(corpus()) if x not in corpus()[:n]]
    rng = random.Random(1)
    words = [f"k{rng.randrange(10**6)}" for _ in range(120)]
    # Near copies at 0.92 and 0.72, which four bits of a SimHash don't tell.
    rows += [(500, " ".join(words)), (501, " ".join([*words, "a5", "b5", "c5", "d5", "e5", "f5", "g5", "h5", "i5", "j5"])), (502, " ".join([*words[:100], *[f"m{i}" for i in range(18)]]))]
    passage = "quo vadis domine sed libera nos a malo semper et ubique"
    rows += [(400, "x1 x2 x3 x4 x5 x6 " + passage + " y1 y2 y3"), (401, "Quo, VADIS " + passage[10:])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    cleaned = brute_lines(left)
    left = [(i, cleaned[i]) for i, _ in left]
    left = one_of_each(left)
    grams = passage.split()
    windows = {tuple(grams[k : k + 10]) for k in range(len(grams) - 9)}
    words = lambda t: "".join(c if c.isalnum() or ord(c) > 127 else " " for c in t.lower()).split()
    shares = lambda w: any(tuple(w[k : k + 10]) in windows for k in range(len(w)))
    left = [(i, t) for i, t in left if not shares(words(t))]
    assert {i for i, _ in left} < {i for i, _ in rows} - {400, 401, 200, 201, 202, 205}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, want = Tokenizer.from_file(packing.TOKENIZER), []
    for i, t in left:
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for n in packing.cuts(len(ids)):
            want.append((i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
            at += n
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out), key=str) == sorted(want, key=str)


def test_stages_return_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        assert docs.columns == columns


def test_stages_keep_clashing_columns(spark, tmp_path):
    """Columns of any name, repeated rows and empty tables pass each stage."""
    spark.createDataFrame([(1, "quo vadis domine sed libera nos a malo semper et ubique")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    names = ["row", "letter", "__letter", "id", "__id", "key", "__key", "k1", "k2", "i", "k", "crowd", "node", "near"]
    texts = [(1, "alpha beta gamma delta " * 5), (1, "alpha beta gamma delta " * 5), (2, "one line\nand more"), (None, "some other words here"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", *range(len(names))) for i, t in texts], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    assert sorted((r["doc_id"] for r in left.collect()), key=str) == [1, 2, None]
    assert all(r["near"] == len(names) - 1 for r in left.collect())
    assert len({r["doc_id"] for r in corpus_pipeline.packed(spark, left, str(tmp_path)).collect()}) == 3


def test_near_dedup_keeps_one_row_of_similar_texts(spark):
    rng = random.Random(4)
    base = [[f"v{rng.randrange(5000)}" for _ in range(300)] for _ in range(12)]
    edited = lambda ws, n: [f"e{rng.randrange(10**6)}" if i in set(range(7, 300, 300 // n)) else w for i, w in enumerate(ws)]
    rows = [(100 * i + j, " ".join(w)) for i, b in enumerate(base) for j, w in enumerate([b, edited(b, 3), edited(b, 5), edited(b, 6), edited(b, 30)])]
    rows += [rows[0], rows[0], (7001, "only these"), (7001, "only these"), (None, "no id at all"), (None, "no id at all"), (9000, ""), (9001, " "), (9002, None)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for _, t in rows)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    groups = {r: sorted((x for x, q in zip(rows, root) if q == r), key=lambda x: (x[0] is None, x[0]))[0][0] for r in set(root)}
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n int")
    out = corpus_pipeline.without_near_duplicates(spark, docs, "").collect()
    assert sorted((r["doc_id"] for r in out), key=str) == sorted(groups.values(), key=str)
    assert corpus_pipeline.without_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_crowds_of_similar_texts_by_blocks(spark):
    rng = random.Random(6)
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    texts = sorted({" ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.02 else w for w in base) for _ in range(60)})
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    members = docs.selectExpr("xxhash64(text) AS key", "1L AS crowd", "text")
    large = spark.createDataFrame([(1,)], "crowd long")
    key = {r["key"]: r["doc_id"] for r in docs.selectExpr("doc_id", "xxhash64(text) AS key").collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(196)} for w in map(str.split, texts)]
    near = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if near(i, j) and root[i] != root[j]:
                a = root[i]
                root = [root[j] if r == a else r for r in root]
    centred = {(key[r["a"]], key[r["b"]]) for r in near_copies.centre_links(members, large, 0.6).collect()}
    centre = {b for _, b in centred}
    assert len(centre) == 1 and centred == {(i, j) for j in centre for i in range(60) if i != j and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])} != set()
    most = max(range(60), key=lambda j: sum(near(i, j) for i in range(60)))
    back = {i: k for k, i in key.items()}
    centred = spark.createDataFrame([(back[i], back[most]) for i in range(60) if i != most and near(i, most)], "a long, b long")
    for block, first in ((256, None), (7, None), (7, centred)):
        found = near_copies.crowd_links(members, first, block=block)
        links = [(key[r["a"]], key[r["b"]]) for r in (found if first is None else found.union(first)).collect()]
        assert all(near(i, j) for i, j in links)
        got = list(range(60))
        for i, j in links:
            a = got[i]
            got = [got[j] if g == a else g for g in got]
        assert len(set(zip(got, root))) == len(set(got)) == len(set(root)) and 1 < len(set(root)) < 60


def test_texts_stay_where_no_language_can_be_learned(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, "mehr Worte", None)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.of_known_language(spark, docs, "").collect()) == [1, 3]


def test_wide_fingerprints_find_pairs_at_the_least_similarity():
    """Of pairs of sets at similarity 0.8, the share that meets in a bucket and is within the distance; chance pairs aren't."""
    rng = np.random.default_rng(3)
    parts, lanes = near_copies.tables_for(1_000_000)
    salts = rng.integers(0, 1 << 64, lanes, dtype=np.uint64)
    masks = np.array(near_copies.segments(parts), np.uint64)

    def meet(a, b):
        x, y = near_copies.wide_fingerprint(a, salts), near_copies.wide_fingerprint(b, salts)
        apart = np.bitwise_count(x ^ y).astype(int)
        lane = np.flatnonzero(((x[:, None] ^ y[:, None]) & masks == 0).any(1))
        return any(apart[i] + apart[(i + 1) % lanes] + apart[(i + 2) % lanes] <= near_copies.NEAR for i in lane)

    hits, chance = 0, 0
    for _ in range(400):
        n = int(rng.integers(9, 300))
        one = rng.integers(0, 1 << 64, n + n // 9, dtype=np.uint64)
        a, b = one[: n], one[n // 9 :]
        assert len(np.intersect1d(a, b)) / len(one) >= 0.79
        hits += meet(a, b)
        chance += meet(a, rng.integers(0, 1 << 64, n, dtype=np.uint64))
    assert hits >= 0.98 * 400 and chance == 0
    assert near_copies.tables_for(10**10)[1] > near_copies.tables_for(10**8)[1] > lanes


def test_pivot_tables_discard_chance_pairs_only():
    """The table never discards a pair within the distance, and nearly all chance pairs."""
    rng = np.random.default_rng(5)
    near = rng.integers(0, 1 << 64, (3, 4000), dtype=np.uint64)
    flips = np.zeros((4000, 192), np.uint8)
    for i in range(4000):
        flips[i, rng.choice(192, int(rng.integers(0, 70)), replace=False)] = 1
    other = near ^ np.packbits(flips, axis=1, bitorder="little").view(np.uint64).T
    table = near_copies.pivot_table([np.concatenate([x, y]) for x, y in zip(near, other)])
    a, b = np.arange(4000), np.arange(4000, 8000)
    found, _ = near_copies.survivors(table, a, b, near_copies.NEAR)
    within = flips.sum(1) <= near_copies.NEAR
    assert np.isin(a[within], found).all() and within.sum() > 2000
    one, two = rng.integers(0, 4000, (2, 100_000))
    apart = one != two
    left, _ = near_copies.survivors(table, one[apart], two[apart], near_copies.NEAR)
    assert len(left) < 0.01 * apart.sum()
