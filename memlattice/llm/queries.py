"""The registered queries of the corpus operators, over whole tables, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann_join import nearest
from .itq_dedup import near_duplicates
from .jaccard_join import jaccard_components
from .lm_score import lm_scores
from .packing import pack_pow2
from .quality import quality
from .resample import resample
from .source_mix import mix
from .suffix_dedup import remove_repeats
from .toxicity import toxicity
from .tput import search
from .url_filter import filter_urls
from .winnowing import as_string, fingerprints


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings: 0 for bad quality, 1 for good but toxic, 2 for good and clean."""
    labels = _table(spark, sf_dir, "labels")
    good = F.col("quality") == 1
    return labels.select("doc_id", F.when(~good, 0).when(F.col("toxic") == 1, 1).when(good & (F.col("toxic") == 0), 2).alias("grade"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(_table(spark, sf_dir, "documents").select("doc_id", "text"), grades(spark, sf_dir))
    return out.select("doc_id", "expected_grade", "tail_probability", "keep")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_pow2(_table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return out.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcomes = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return filter_urls(_table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op11_tput_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 50)


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints(_table(spark, sf_dir, "documents"))
    strings = [as_string(F.col(a)).alias(b) for a, b in (("prints", "fingerprint"), ("edited_prints", "edited_fingerprint"))]
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *strings, "near_edited", "near_next")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_lm_scores, op3_source_mix, op4_jaccard_join, op5_quality, op6_packing, op7_suffix_dedup, op8_url_filter, op9_nearest, op10_near_vectors, op11_tput_search, op12_winnowing, op13_resample, pipeline)}

ORACLES: dict[str, str] = {
    "op2_lm_scores": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT doc_id, i, w[i] AS g1, CASE WHEN i > 1 THEN w[i-1] || ' ' || w[i] END AS g2,
         CASE WHEN i > 2 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS g3 FROM places),
rest AS (
  SELECT doc_id, i, count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS c0,
         count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS c1,
         count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) AS c2,
         count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) AS c3 FROM grams),
both_words AS (
  SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS b2, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS b3 FROM rest),
logs AS (
  SELECT doc_id, CASE WHEN i > 2 AND c3 > 0 AND b3 > 0 THEN ln(c3 / b3)
    WHEN i > 1 AND c2 > 0 AND b2 > 0 THEN ln(c2 / b2) + (least(i, 3) - 2) * ln(0.4)
    WHEN c1 > 0 AND c0 > 0 THEN ln(c1 / c0) + (least(i, 3) - 1) * ln(0.4)
    ELSE least(i, 3) * ln(0.4) - ln(c0 + 1) END AS s FROM both_words)
SELECT doc_id, len(w)::BIGINT AS n_words, round(coalesce(sum(s), 0), 6) AS log_score, round(avg(s), 6) AS mean_log_score
FROM words LEFT JOIN logs USING (doc_id) GROUP BY doc_id, len(w)
""",
    "op4_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)]
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) m ON m.a = d.doc_id
""",
    "op7_suffix_dedup": r"""
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
windows AS (SELECT doc_id, i, t[i + 1 : i + 100] AS w FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 99)) AS i FROM bytes WHERE octet_length(t) >= 100)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS n FROM windows) WHERE n > 1),
every AS (SELECT doc_id, unnest(range(0, octet_length(t))) AS i, unnest(regexp_extract_all(hex(t), '..')) AS x FROM bytes),
marked AS (
  SELECT doc_id, i, x, coalesce(max(CASE WHEN a.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM every LEFT JOIN again a USING (doc_id, i)),
edges AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM marked),
told AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(x, '' ORDER BY i) FILTER (gone = 0), '') AS kept FROM edges GROUP BY 1)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM bytes LEFT JOIN told USING (doc_id)
""",
    "op8_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
hosts AS (
  SELECT host, string_split(host, '.') AS l, count(quality) AS n, coalesce(sum(quality), 0)::BIGINT AS g
  FROM parts LEFT JOIN labels ON doc_id = page_id GROUP BY 1),
named AS (SELECT host, l[-1] AS suffix, array_to_string(l[-2:], '.') AS domain, n, g FROM hosts),
whole AS (SELECT CASE WHEN sum(n) > 0 THEN sum(g) / sum(n) ELSE 0.5 END AS above FROM named),
l1 AS (SELECT suffix, sum(n) AS n, sum(g) AS g, any_value(above) AS above FROM named, whole GROUP BY 1),
s1 AS (SELECT coalesce(sum(n * (g / n - above) * (g / n - above)), 0) AS ss, coalesce(sum(above * (1 - above)), 0) AS vk, coalesce(sum(n * above * (1 - above)), 0) AS vn FROM l1 WHERE n > 0),
k1 AS (SELECT 1 / CASE WHEN vn - vk > 0 THEN least(0.5, greatest(0.001, (ss - vk) / (vn - vk))) ELSE 0.5 END - 1 AS k FROM s1),
m1 AS (SELECT suffix, (g + k * above) / (n + k) AS above FROM l1, k1),
l2 AS (SELECT suffix, domain, sum(n) AS n, sum(g) AS g, any_value(above) AS above FROM named JOIN m1 USING (suffix) GROUP BY 1, 2),
s2 AS (SELECT coalesce(sum(n * (g / n - above) * (g / n - above)), 0) AS ss, coalesce(sum(above * (1 - above)), 0) AS vk, coalesce(sum(n * above * (1 - above)), 0) AS vn FROM l2 WHERE n > 0),
k2 AS (SELECT 1 / CASE WHEN vn - vk > 0 THEN least(0.5, greatest(0.001, (ss - vk) / (vn - vk))) ELSE 0.5 END - 1 AS k FROM s2),
m2 AS (SELECT suffix, domain, (g + k * above) / (n + k) AS above FROM l2, k2),
l3 AS (SELECT host, n, g, above FROM named JOIN m2 USING (suffix, domain)),
s3 AS (SELECT coalesce(sum(n * (g / n - above) * (g / n - above)), 0) AS ss, coalesce(sum(above * (1 - above)), 0) AS vk, coalesce(sum(n * above * (1 - above)), 0) AS vn FROM l3 WHERE n > 0),
k3 AS (SELECT 1 / CASE WHEN vn - vk > 0 THEN least(0.5, greatest(0.001, (ss - vk) / (vn - vk))) ELSE 0.5 END - 1 AS k FROM s3),
m3 AS (SELECT host, n, (g + k * above) / (n + k) AS m, k FROM l3, k3),
judged AS (
  SELECT page_id, host, path, m - 1.64 * sqrt(m * (1 - m) / (n + k + 1)) AS bound,
    CASE WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/7%' THEN 'example.com/en/7'
         WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/de/8%' THEN 'example.net/de/8'
         WHEN ('.' || host) LIKE '%.com' AND path LIKE '/en/%' THEN 'com/en/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/de/%' THEN 'net/de/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM parts JOIN m3 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.6 THEN 'allow' ELSE 'block' END AS verdict
FROM judged
""",
    "op10_near_vectors": """
WITH RECURSIVE links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.9),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
degree AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(m.b, e.vec_id)) AS component_id, e.vec_id <= coalesce(m.b, e.vec_id) AS kept
FROM embeddings e LEFT JOIN degree d ON d.a = e.vec_id LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY 1) m ON m.a = e.vec_id
""",
    "op11_tput_search": r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
asks AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
whole AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS l FROM terms WHERE len(w) > 0),
counts AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM terms) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, whole GROUP BY t, n_docs),
scores AS (
  SELECT item_id, doc_id, sum(g.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(d.w) * n_docs) // l))))::BIGINT AS score
  FROM asks JOIN counts USING (t) JOIN weights g USING (t) JOIN terms d USING (doc_id), whole GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
""",
    "op13_resample": r"""
WITH table_of AS (
  SELECT list(c ORDER BY b) AS x FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS b))),
split AS (
  SELECT 0 AS side, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split),
every AS (SELECT side, doc_id, unnest(w) AS f FROM words),
buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, [('0x' || h)::BIGINT FOR h IN regexp_extract_all(hex(encode(f)), '..')]),
    lambda c, b: xor(c // 256, x[xor(c % 256, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM every), table_of),
shares AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM every JOIN buckets USING (f) GROUP BY 1),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM shares) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM shares) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM shares),
weights AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM every JOIN buckets USING (f) JOIN gains USING (bucket) WHERE side = 0 GROUP BY 1),
scored AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || w.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words w LEFT JOIN weights v ON v.doc_id = w.doc_id WHERE side = 0),
placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= (SELECT (10 * count(*)) // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank FROM placed
""",
}
