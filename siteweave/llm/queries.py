"""The queries of the training-data operators and, where SQL can say it, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteweave.llm import decontamination, divergence, filter_audit, language_id, line_dedup, lm_scoring, ngram_join, packing, sharding, simhash_dedup, substring_dedup, topk_search, warc
from siteweave.llm.common import table


def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards by doc_id and number of shards; nulls, ties and repeated rows as shard_documents says."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; null and letterless texts are und."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50; null and non-finite vectors take no part."""
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; null texts are empty and keep their end id."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole text; null texts are one end."""
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; null texts have fingerprint zero and are linked like others."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those removed and a digest of the rest; null texts have no lines."""
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document; null texts have no words."""
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to bundles and read back; null pages are empty payloads."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed and a digest of the rest; null texts have no words."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each source at every step of all orders; null texts and sources are empty."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's shingle set and its component of similar ones; texts without words link with nothing."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of every source from the others of its language, and its terms furthest above the language; nulls are empty."""
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shard, op2_language_id, op3_topk_search, op4_pack, op5_lm_score, op6_near_duplicates, op7_line_dedup, op8_decontaminate, op9_warc, op10_substring_dedup,
        op11_filter_audit, op12_ngram_join, op13_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_topk_search": """
WITH ok AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM ok q JOIN ok c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
""",
    "op7_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
pos AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs),
windows AS (
    SELECT doc_id, i, 2 AS n, l[i:i + 1] AS k FROM pos WHERE i < len(l) AND (trim(l[i]) <> '' OR trim(l[i + 1]) <> '')
    UNION ALL
    SELECT doc_id, i, 1 AS n, [l[i]] AS k FROM pos WHERE len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) >= 50
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n, k ORDER BY doc_id, i) AS r FROM windows),
removed AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM ranked WHERE r > 1),
kept AS (
    SELECT p.doc_id, count(*) AS n_lines, count(r.i) AS n_removed,
           string_agg(p.l[p.i], chr(10) ORDER BY p.i) FILTER (WHERE r.i IS NULL) AS text
    FROM pos p LEFT JOIN removed r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op8_decontaminate": r"""
WITH lowered AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), tests AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), test_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM tests WHERE len(w) > 0)
), doc_windows AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, (SELECT DISTINCT n FROM test_windows) WHERE len(w) >= n)
), found AS (
    SELECT doc_id, i, d.n, item_id FROM doc_windows d JOIN test_windows t ON d.n = t.n AND d.k = t.k
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN covered c ON l.doc_id = c.doc_id LEFT JOIN named m ON l.doc_id = m.doc_id
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (
    SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h,
           min(page_id) OVER (PARTITION BY html) AS first_id FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST(concat('0x', substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM s
""",
    "op10_substring_dedup": r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20)),
firsts AS (SELECT k, min(struct_pack(d := doc_id, i := i)) AS f FROM windows GROUP BY k HAVING count(*) > 1),
removed AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM windows JOIN firsts USING (k)
    WHERE doc_id <> f.d OR i <> f.i
),
kept AS (
    SELECT p.doc_id, count(r.i) AS n_removed, string_agg(p.w[p.i], ' ' ORDER BY p.i) FILTER (WHERE r.i IS NULL) AS t
    FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs) p LEFT JOIN removed r ON p.doc_id = r.doc_id AND p.i = r.i
    GROUP BY p.doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op11_filter_audit": r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
marked AS (
    SELECT doc_id, part, concat(
        CASE WHEN len(w) < 50 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
        CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END,
        CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS fails
    FROM words
),
told AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
classes AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM marked m LEFT JOIN told USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
gone AS (
    SELECT filter_order, c.*, coalesce(list_min(list_transform(string_split(fails, ''), lambda f: CASE WHEN f = '' THEN 6 ELSE instr(filter_order, f) END)), 6) AS gone_at FROM orders, classes c
),
counted AS (
    SELECT part, filter_order, step, CAST(sum(CASE WHEN gone_at > step THEN n ELSE 0 END) AS BIGINT) AS kept,
           CAST(sum(CASE WHEN gone_at = step THEN n ELSE 0 END) AS BIGINT) AS removed,
           CAST(sum(CASE WHEN gone_at < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS BIGINT) AS redundant,
           CAST(sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
           CAST(sum(CASE WHEN gone_at = step THEN good ELSE 0 END) AS BIGINT) AS good_lost,
           CAST(sum(CASE WHEN gone_at = step THEN bad ELSE 0 END) AS BIGINT) AS toxic_lost
    FROM steps JOIN gone USING (filter_order) GROUP BY part, filter_order, step
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM counted
""",
    "op12_ngram_join": r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 0) + 2), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s FROM docs
), classes AS (
    SELECT s, min(doc_id) AS id FROM sets WHERE len(s) > 0 GROUP BY s
), tokens AS (SELECT id, len(s) AS n, unnest(s) AS k FROM classes),
links AS (
    SELECT a.id AS a, b.id AS b FROM tokens a JOIN tokens b ON a.k = b.k AND a.id <> b.id AND 100 * b.n >= 90 * a.n AND 100 * a.n >= 90 * b.n
    GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach AS (SELECT id AS a, id AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN least l ON c.id = l.id
""",
    "op13_divergence": r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
    FROM documents
), grp AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN terms t ON w.lang = t.lang AND w.term = t.term GROUP BY w.lang, w.source, w.term),
langs AS (SELECT lang, CAST(sum(total) AS HUGEINT) AS n, CAST(count(*) AS HUGEINT) AS v FROM terms GROUP BY lang),
sizes AS (SELECT g.lang, g.source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM grp g LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
shares AS (
    SELECT s.lang, s.source, t.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * CAST(coalesce(c.n, 0) + 2 AS HUGEINT) // (s.n + 2 * l.v) AS p, 1 + 1000000000 * CAST(t.total + 2 AS HUGEINT) // (l.n + 2 * l.v) AS q
    FROM sizes s JOIN langs l ON s.lang = l.lang JOIN terms t ON t.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = t.term
), sums AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), best AS (
    SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best)
)
SELECT lang, source, part, item, value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 10
""",
}
