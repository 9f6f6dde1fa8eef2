"""Filter audit, shingle join and divergence audit against brute force and SQL, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siteweave.llm import divergence, filter_audit, ngram_join
from siteweave.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omi pi rho sig tau ups".split()


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_ngram_join", "op13_divergence"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in df.collect()))) == sorted(map(str, cursor.fetchall()))


def corpus(seed=3):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    out = [(i, text(rng.randint(1, 120)), f"s{i % 3}") for i in range(60)]
    long = text(4000).split()
    near = lambda n: " ".join(long[:900] + ["x"] * n)
    out += [(100 + i, near(i), "s1") for i in range(4)] + [(110, " ".join(long), None)]
    out += [(200, None, "s1"), (201, "", "s1"), (202, " \n\t ", None), (203, "A $ B", ""), (204, "ONE", "s2"), (205, "one", "s2"), (206, "one two", "s2"), (207, "One Two", "s2"), (None, text(70), "s0"), (None, text(70), None)]
    return [*out, out[5], out[5], (300, out[6][1], "s2"), (301, "É" * 30 + "A", "s2")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, s, "en", 1, 1, "c", "c", 0) for i, t, s in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, mask int, node long, part string, key string, n long").repartition(3)


# Filter audit


def brute_audit(rows, labels):
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    firsts = defaultdict(list)
    for i, t, _ in rows:
        if i is not None:
            firsts[t or ""].append(i)
    marked = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), i is not None and min(firsts[t]) < i]
        marked.append((s or "", {x for x, f in zip("ABCDE", fails) if f}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {m[0] for m in marked}:
            left = [m for m in marked if m[0] == part]
            for k, f in enumerate(order):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                all_failing = [m for m in marked if m[0] == part and f in m[1]]
                shapley[part, f] += len(gone)
                out[part, order, k + 1] = (len(left), len(gone), len(all_failing) - len(gone), sum(m[1] == {f} for m in all_failing), sum(m[2] for m in gone), sum(m[3] for m in gone))
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in out.items()}


def test_filter_audit(spark, docs):
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(5, 1, 0), (5, 0, 1), (None, 1, 1), (203, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    found = filter_audit.audit(docs, table).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in found} == brute_audit(corpus(), labels)
    assert len(found) == 600 * 4
    assert filter_audit.audit(docs.limit(0), table).count() == 0
    assert filter_audit.audit(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_bitmaps_of_many_parts():
    """Parts of any sizes share words with no other part."""
    rng = np.random.default_rng(1)
    part = [f"p{x}" for x in rng.integers(0, 40, 3000)]
    mask, good = rng.integers(0, 8, 3000), rng.random(3000) < 0.3
    parts, counts = filter_audit.subset_counts(pa.array(part), mask, [good, ~good], 3)
    for subset in range(8):
        for i, p in enumerate(parts.to_pylist()):
            here = (np.array(part) == p) & (mask & subset == 0)
            assert counts[subset, :, i].tolist() == [here.sum(), (here & good).sum(), (here & ~good).sum()]


# Shingle join


def brute_components(rows, words=3, least=90):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return frozenset(" ".join(w[i : i + words]) for i in range(max(len(w) - words, 0) + 1)) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    distinct = list({s for s in sets if s})
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * min(len(a), len(b)) >= least * max(len(a), len(b)) and 100 * len(a & b) >= least * len(a | b):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            ids[find(s)].append(i)
    return sorted(str((i, len(s), min(ids[find(s)], default=None) if s else i)) for (i, _), s in zip(rows, sets))


def found_components(out):
    return sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out.collect())


def test_shingle_join(docs):
    assert found_components(ngram_join.similar_documents(docs)) == brute_components([(i, t) for i, t, _ in corpus()])
    assert ngram_join.similar_documents(docs.limit(0)).count() == 0


def near_sets(seed, n=220):
    """Texts of distinct words, and copies with a share of their words changed near the bound."""
    rng, out, fresh = random.Random(seed), [], iter(range(10**7))
    for size in (9, 10, 11, 12, 14, 19, 21, 30, 45, 90, 200):
        for _ in range(n // 22):
            w = [f"w{next(fresh)}" for _ in range(size)]
            out.append((len(out), " ".join(w)))
            for _ in range(rng.randint(1, 3)):
                v = list(w)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    at = rng.randrange(len(v))
                    v[at : at + rng.randint(0, 1)] = [f"w{next(fresh)}"] if rng.random() < 0.6 else []
                out.append((len(out), " ".join(v if rng.random() < 0.7 else v + [f"w{next(fresh)}"])))
    return out


@pytest.mark.parametrize("row", [0.0, 64.0])
def test_shingle_join_near_the_bound(spark, row):
    """Under both allocations: with keys for nothing, all thresholds are 1; both find every similar pair."""
    rows = near_sets(7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = ngram_join.allocation({g: (10**9, 10**10) for g in range(40)}, row=row)
    assert row or any(k > 0 for _, k in plan)
    assert found_components(ngram_join.similar_documents(df, row=row)) == brute_components(rows)


@pytest.mark.parametrize("ones", [0, 1])
def test_similar_sets_share_a_key(ones):
    """The pigeonhole bound for drawn sets at and above the similarity, with no and with as many one-deletions as can be."""
    rng = np.random.default_rng(11)
    first = ngram_join.bands()
    most = [ngram_join.differences(first[g + 1] - 1) for g in range(40)]
    plan = [(h + 1 - k, k) for h in most for k in [(h + 1) // 2 if ones else 0]]
    signer, met = ngram_join.Signer(plan), 0
    for _ in range(3000):
        n = int(rng.integers(9, 400))
        a = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        lost = int(rng.integers(0, n // 9 + 1))
        gained = int(rng.integers(0, n // 9 + 1))
        b = np.concatenate([a[lost:], rng.integers(0, 1 << 64, gained, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            (wa, la), (wb, lb) = signer.keys(a), signer.keys(b)
            assert np.isin(wa, wb).any() or np.isin(wa, lb).any() or np.isin(la, wb).any()
            met += 1
    assert met > 500


def test_spare_segments_lose_no_pair():
    """With spare segments empty subsets have no keys; drawn similar sets of any size still share one, also where most subsets are empty."""
    rng, sizes = np.random.default_rng(12), {g: (10**6, 10**8) for g in range(40)}
    plan = ngram_join.allocation(sizes, row=64.0)
    spare = ngram_join.spare_segments(sizes, plan)
    assert max(spare[4:20]) > 1 and ngram_join.spare_segments({}, plan) == [0] * len(plan)
    signer, plain, met, fewer = ngram_join.Signer(plan, spare=spare), ngram_join.Signer(plan), 0, 0
    for _ in range(3000):
        n, top = int(rng.integers(9, 400)), 1 << int(rng.integers(58, 65))
        a = np.unique(rng.integers(0, top, n, dtype=np.uint64))
        lost, gained = (int(rng.integers(0, n // 9 + 1)) for _ in range(2))
        b = np.unique(np.concatenate([a[lost:], rng.integers(0, top, gained, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        fewer += len(signer.keys(a)[0]) < sum(m + e for g in signer.groups(len(a)) for (m, _), e in [(plan[g], spare[g])])
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert np.isin(signer.keys(a)[0], signer.keys(b)[0]).any() and np.isin(plain.keys(a)[0], plain.keys(b)[0]).any()
            met += 1
    assert met > 500 and fewer > 0


def test_unlike_large_sets_make_no_crowds(spark):
    """Empty subsets, which large unlike sets share by chance, join nothing; with keys for them they do."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(10**7)}" for _ in range(180 + i % 20))) for i in range(3000)], "doc_id long, text string")
    sizes = ngram_join.band_sizes(docs)
    plan = ngram_join.allocation(sizes)
    found = [ngram_join.candidates(ngram_join.distinct_sets(docs, 3, s)).count() for s in (ngram_join.Signer(plan, spare=ngram_join.spare_segments(sizes, plan)), ngram_join.Signer(plan))]
    assert found[0] <= 2 and found[1] > 20, found


def test_allocation_follows_cost():
    """Few sets: only subsets; many small sets: larger segments with one-deletions, thresholds always adding up."""
    first = ngram_join.bands()
    few, many = (ngram_join.allocation({g: (n, n * first[g]) for g in range(20)}) for n in (100, 10**11))
    for g in range(20):
        bound = ngram_join.differences(first[g + 1] - 1) + 1
        assert few[g] == (bound, 0) and sum(many[g]) == bound
    assert many[0][1] > 0 and many[2][1] > 0


def test_large_buckets_come_in_blocks(spark):
    """Buckets beyond the bound are named and come in blocks, in which no pair is lost and none is repeated; their links are found."""
    keyed = spark.range(50).select(F.lit(1).cast("long").alias("value"), F.col("id").alias("node"), F.lit(20 << 33).cast("long").alias("meta"))
    assert [len(r["node"]) for r in ngram_join.buckets(keyed, 8).collect()] == [9]
    pairs = Counter()
    for r in ngram_join.block_pairs(keyed, keyed.select("value").distinct(), 8).collect():
        for i, a in enumerate(r["node"]):
            for j in range(i):
                if not r["cross"] or r["own"][i] != r["own"][j]:
                    pairs[frozenset((a, r["node"][j]))] += 1
    assert len(pairs) == 50 * 49 // 2 and set(pairs.values()) == {1}
    sets = keyed.select("node", "meta", F.array("value").alias("whole"), F.array().cast("array<long>").alias("less"))
    linked = ngram_join.components(ngram_join.candidates(sets, block=8)).collect()
    assert sorted((r["node"], r["root"]) for r in linked) == [(i, 0) for i in range(1, 50)]


# Divergence


def brute_divergence(rows, least, best=10):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))) for lang, source, text in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == lang]
        df = Counter(t for d in here for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = {s: Counter() for s in {d[1] for d in here}}
        for _, s, w in here:
            count[s].update(t for t in w if t in kept)
        whole = sum(count.values(), Counter())
        share = lambda c, t: 1 + 10**9 * (c[t] + 2) // (c.total() + 2 * len(kept))
        far = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in count.items():
            pairs = [(o, sum(far(share(c, t), share(count[o], t)) for t in kept)) for o in count if o != s]
            terms = [(t, far(share(c, t), share(whole, t))) for t in kept if c[t] and share(c, t) > share(whole, t)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked if part == "pair" else ranked[:best])}
    return out


def rows_of_sources():
    rng = random.Random(9)
    out = []
    for i in range(400):
        lang, source = rng.choice(["en", "de", None, "few"]), rng.choice(["a", "b", "c", "é", None, "z z"])
        out.append((lang, source, " ".join(rng.choice(WORDS[: 6 + i % 14]) + rng.choice(["", "X", "é", "_b", "'s", "9"]) for _ in range(rng.randint(0, 40)))))
    out += [("xx", f"s{i}", "only here") for i in range(3)] + [("xx", "s1", None), ("one", "lone", "alpha"), ("en", "wordless", "123 --"), ("en", "long", "Alpha beta " * 20000)]
    return [*out, out[3], out[3]]


def test_divergence(spark):
    rows = rows_of_sources()
    df = spark.createDataFrame([(*r, 1, "c", 0) for r in rows], "lang string, source string, text string, idx int, term string, n long").repartition(3)
    found = [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_divergence(rows, 10)
    assert divergence.audit(df.limit(0)).count() == 0


def test_pairs_of_many_sources_in_blocks(spark, monkeypatch):
    """Sources beyond a block meet in pairs of blocks, each pair once."""
    monkeypatch.setattr(divergence, "BLOCK", 4)
    rng = random.Random(2)
    rows = [("en", f"s{i % 11}", " ".join(rng.choice(WORDS) for _ in range(15))) for i in range(120)]
    found = divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), least=2)
    assert {(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in found.collect()} == brute_divergence(rows, 2)


@pytest.mark.parametrize("ties", [0, 3, 4096])
def test_radix_selection(spark, ties):
    """The k largest of each group, ties by bytes, however few ties a sort may hold."""
    rng = random.Random(4)
    rows = [(g, f"prefix-{'é' * (x % 3)}{x}", v) for g, many in (("a", 300), ("b", 4), ("c", 40)) for x in range(many) for v in [rng.choice([0, 5, 70000, 70001, (1 << 31) + 3, 65536]) if g != "c" else 8]]
    df = spark.createDataFrame(rows, "g string, item string, value long").repartition(3)
    found = sorted(tuple(r) for r in divergence.best_of_groups(df, ["g"], 10, ties=ties).select("g", "rank", "item", "value").collect())
    wanted = []
    for g in "abc":
        ranked = sorted(((i, v) for h, i, v in rows if h == g), key=lambda x: (-x[1], x[0].encode()))
        wanted += [(g, k + 1, i, v) for k, (i, v) in enumerate(ranked[:10])]
    assert found == sorted(wanted)
