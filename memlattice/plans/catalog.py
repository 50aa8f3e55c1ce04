"""The registered queries with their SQL: each applies an operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import segment as S
from ..functions import temporal as TM
from ..functions import text as T
from ..operators import fusion, graph, keyword, lifecycle, signals, vector
from ..sources import adapters as A
from ..sources.indexstore import IndexStore
from ..staging import shared_dir
from .hybrid import Params, all_signals, hybrid_search, keyword_road, time_filter

NOW = "2024-02-01T00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


MEM, QRY, VER, REL, MEN = A.MEMORIES_SQL, A.QUERIES_SQL, A.VERSIONS_SQL, A.RELATIONS_SQL, A.MENTIONS_SQL
VALID = f"(valid_from IS NULL OR valid_from <= '{NOW}') AND (valid_to IS NULL OR valid_to >= '{NOW}')"
DAYS = lambda c: f"greatest(date_diff('day', substr({c}, 1, 10)::DATE, DATE '2024-02-01'), 0)"
TEMPORAL_SCORE = f"(1 / (1 + 0.5 * {DAYS('created_at')}) + 1 / (1 + 0.3 * coalesce({DAYS('last_recalled')}, {DAYS('created_at')}))) * (importance / 3) * decay * (1 + 0.1 * recall_count)"
WORDS = lambda c: f"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
BM25 = f"""terms AS (SELECT DISTINCT query_id, unnest(list_filter({WORDS('text')}, lambda t: t <> 'pattern')) AS term FROM qry),
bag AS (SELECT key, {WORDS("concat_ws(' ', content, namespace)")} AS t FROM mem),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM bag),
tf AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(t) AS dl, unnest(t) AS term FROM bag) WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, key, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY 1, 2)"""
KNN = """sem AS (SELECT query_id, vec_id AS key, list_cosine_similarity(v, embedding::DOUBLE[]) AS score FROM qry, embeddings WHERE v IS NOT NULL)"""
TRIGGERS_SQL = ", ".join(f"('{w}', '{c}')" for w, c in signals.TRIGGERS.items())


def _rank(source: str, channel: str, n: int, by: str = "query_id") -> str:
    return f"SELECT {by}, '{channel}' AS channel, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round(score, 6) DESC, key) - 1 AS rank FROM {source}) WHERE rank < {n}"


SIGNALS = f"""{MEM}, {QRY}, qns AS (SELECT *, 'src' || (query_id % 20)::VARCHAR AS namespace FROM qry), {BM25}, {KNN},
bmn AS (SELECT query_id, key, score FROM bm JOIN mem USING (key) JOIN qns USING (query_id, namespace)),
semp AS (SELECT query_id, key, score FROM sem JOIN mem USING (key) JOIN qns USING (query_id, namespace) WHERE score > 0),
tmp AS (SELECT namespace, key, {TEMPORAL_SCORE} AS score FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, key) AS rn FROM mem) WHERE rn <= 30),
imp AS (SELECT namespace, key, importance * decay / 5 AS score FROM mem WHERE tier IN ('hot', 'warm')),
cat AS (SELECT query_id, key, 1.0::DOUBLE AS score FROM (SELECT query_id, c, namespace FROM qns, (VALUES {TRIGGERS_SQL}) t(w, c) WHERE contains(text, w)) n JOIN mem m ON category = c AND m.namespace = n.namespace WHERE tier IN ('hot', 'warm')),
sig AS ({_rank("bmn", "keyword", 50)} UNION ALL {_rank("semp", "semantic", 50)}
  UNION ALL SELECT query_id, channel, key, score, rank FROM qns JOIN ({_rank("tmp", "temporal", 30, "namespace")} UNION ALL {_rank("imp", "importance", 30, "namespace")}) USING (namespace)
  UNION ALL {_rank("cat", "category", 10)})"""
FUSED = f"""{SIGNALS}, fused AS (
  SELECT query_id, key, sum(CASE channel WHEN 'category' THEN 0.5 ELSE 1.0 END / (61 + rank)) AS rrf,
    coalesce(max(score) FILTER (channel = 'semantic'), 0) AS sem, coalesce(max(score) FILTER (channel = 'keyword'), 0) AS kw FROM sig GROUP BY 1, 2)"""
ONCE = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
FOUND = lambda c: ONCE(f"list_filter(regexp_extract_all({c}, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: length(x) <= 24)")
SHARED = lambda q, c: f"len(list_intersect({FOUND(q)}, {FOUND(c)}[1:8]))"
SCORED = f"""{FUSED}, kept AS (
  SELECT query_id, f.key, sem, kw, recall_count, last_recalled,
    rrf + least(0.05, 0.01 * {SHARED('q.text', 'm.content')}) AS rrf
  FROM fused f JOIN mem m USING (key) JOIN qry q USING (query_id) WHERE superseded_by IS NULL AND {VALID}),
scored AS (SELECT *, CASE WHEN max(rrf) OVER w > 0 THEN 0.3 * rrf / max(rrf) OVER w ELSE 0 END + CASE WHEN max(sem) OVER w > 0 THEN 0.2 * sem / max(sem) OVER w ELSE 0 END
    + CASE WHEN max(kw) OVER w > 0 THEN 0.5 * kw / max(kw) OVER w ELSE 0 END + 0.1 * recall_count / (recall_count + 10)
    + 0.1 * CASE WHEN last_recalled IS NULL THEN 0.5 ELSE exp(-0.01 * greatest(epoch(TIMESTAMP '2024-02-01') - epoch(last_recalled::TIMESTAMP), 0) / 3600) END
    + CASE WHEN sem >= 0.9 THEN (sem - 0.9) / 0.1 ELSE 0 END AS score
  FROM kept WINDOW w AS (PARTITION BY query_id))"""


def in_namespaces(queries: DataFrame) -> DataFrame:
    return queries.withColumn("namespace", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))


def _queries(s: SparkSession, d: str) -> DataFrame:
    return in_namespaces(A.queries(s, d))


# --- scans, lists and statistics ---
@query(f"WITH {MEM} SELECT namespace, key, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, key) AS rn FROM mem) WHERE rn <= 20")
def ns_recent_topk(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("namespace").orderBy(F.desc("created_at"), "key")
    return A.memories(s, d).select("namespace", "key", F.row_number().over(w).cast("long").alias("rank")).filter("rank <= 20")


@query(f"WITH {MEM} SELECT namespace, tier, count(*) AS n, count(*) FILTER (superseded_by IS NULL) AS tips, round(avg(decay), 6) AS decay FROM mem GROUP BY 1, 2")
def stats_pivot(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).groupBy("namespace", "tier").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("superseded_by").isNull(), 1)).alias("tips"), F.round(F.avg("decay"), 6).alias("decay"))


_NAMES = ("documents", "embeddings", "orders", "lineitem", "events", "conversations", "labels", "pages")


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n FROM {t}" for t in _NAMES))
def table_counts(s: SparkSession, d: str) -> DataFrame:
    out = None
    for t in _NAMES:
        one = A.table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tab"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT conv_id, count(*) AS turns, count(*) FILTER (role IN ('user', 'human')) AS user_turns, max(turn) AS last_turn, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def session_rollup(s: SparkSession, d: str) -> DataFrame:
    c = A.table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("role").isin("user", "human"), 1)).alias("user_turns"), F.max("turn").alias("last_turn"), F.sum(F.length("text")).cast("long").alias("chars"))


@query("SELECT len(embedding) AS dim, label, count(*) AS n FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1, 2")
def vector_dimensions(s: SparkSession, d: str) -> DataFrame:
    return vector.clean(A.vectors(s, d)).groupBy(F.size("v").cast("long").alias("dim"), F.col("namespace").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEM} SELECT namespace, count(*) AS n FROM mem WHERE evolved_at IS NULL GROUP BY 1 ORDER BY n DESC, namespace LIMIT 1")
def evolve_backlog(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).filter("evolved_at is null").groupBy("namespace").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "namespace").limit(1)


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def orphan_vectors(s: SparkSession, d: str) -> DataFrame:
    held = A.table(s, d, "labels").select(F.col("doc_id").alias("key"))
    return A.vectors(s, d).join(held, "key", "left_anti").select(F.col("key").alias("vec_id"))


@query(f"WITH {MEM} SELECT key, importance, decay FROM mem WHERE tier = 'hot' AND category = 'fact' AND importance >= 3 AND content LIKE '%the%' ORDER BY importance DESC, key LIMIT 50 OFFSET 10")
def browse_list(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).filter((F.col("tier") == "hot") & (F.col("category") == "fact") & (F.col("importance") >= 3) & F.contains("content", F.lit("the")))
    return m.select("key", "importance", "decay").orderBy(F.desc("importance"), "key").offset(10).limit(50)


# --- signals ---
@query(f"WITH {MEM} SELECT namespace, key, round({TEMPORAL_SCORE}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, key) AS rn FROM mem) WHERE rn <= 30")
def temporal_signal(s: SparkSession, d: str) -> DataFrame:
    return signals.temporal(A.memories(s, d), NOW, 30).withColumn("score", F.round("score", 6))


@query(f"WITH {MEM}, imp AS (SELECT namespace, key, importance * decay / 5 AS score FROM mem WHERE tier IN ('hot', 'warm')) SELECT namespace, key, round(score, 6) AS score, rank FROM ({_rank('imp', 'importance', 30, 'namespace')})")
def importance_signal(s: SparkSession, d: str) -> DataFrame:
    return signals.ranked(signals.importance(A.memories(s, d)), "importance", 30, "namespace").select("namespace", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


_CATEGORY_QUERIES = "qry AS (SELECT event_type AS query_id, 'which ' || event_type || ' decision, 决定 or fact' AS text FROM (SELECT DISTINCT event_type FROM events))"


@query(f"WITH {MEM}, {_CATEGORY_QUERIES} SELECT query_id, key, count(*) AS n FROM (SELECT query_id, c FROM qry, (VALUES {TRIGGERS_SQL}) t(w, c) WHERE contains(text, w)) JOIN mem ON category = c WHERE tier IN ('hot', 'warm') GROUP BY 1, 2")
def category_signal(s: SparkSession, d: str) -> DataFrame:
    q = A.table(s, d, "events").select(F.col("event_type").alias("query_id")).distinct().withColumn("text", F.concat(F.lit("which "), "query_id", F.lit(" decision, 决定 or fact")))
    return signals.category(q, A.memories(s, d)).groupBy("query_id", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEM}, {QRY}, {BM25} SELECT query_id, key, round(score, 6) AS score, rank FROM ({_rank('bm', 'keyword', 50)})")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """Over postings in blocks: what can't be among the 50 best isn't scored."""
    out = signals.ranked(keyword.best(S.query_terms(A.queries(s, d), ["query_id"]), keyword.index_of(A.memories(s, d)), 50), "keyword", 50)
    return out.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


HAN = "".join(chr(0x4E00 + i) for i in range(26))
CHINESE = lambda c: f"translate(lower({c}), 'abcdefghijklmnopqrstuvwxyz', '{HAN}')"


@query(f"""WITH q AS (SELECT item_id AS query_id, trim(substr({CHINESE('text')}, 1, 24)) AS needle FROM (SELECT item_id, trim(text) AS text FROM benchmark))
SELECT query_id, doc_id AS key FROM q JOIN (SELECT doc_id, {CHINESE('text')} AS content FROM documents) ON contains(content, needle)""")
def keyword_contains(s: SparkSession, d: str) -> DataFrame:
    """Documents and queries with their letters turned into Chinese characters, as the tables have none."""
    q = A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), T.words_in_chinese(F.concat(F.lit("[pattern] "), F.trim("text"))).alias("text"))
    q = q.withColumn("text", F.replace("text", T.words_in_chinese(F.lit("[pattern]")), F.lit("[pattern]")))
    docs = A.memories(s, d).withColumn("content", T.words_in_chinese(F.col("content")))
    return signals.keyword_contains(q, docs).select("query_id", "key")


UNSPACED = lambda c: CHINESE(f"regexp_replace({c}, ' ', '', 'g')")
#: Runs of Chinese letters and of others, in SQL.
RUNS = lambda c: f"list_filter(regexp_split_to_array(regexp_replace(strip_accents({c}), '([㐀-䶿一-鿿]+)', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


@query(f"""WITH RECURSIVE dict AS (SELECT word, count(*)::DOUBLE AS freq FROM (SELECT unnest(regexp_extract_all({CHINESE('text')}, '[一-鿿]+')) AS word FROM documents) GROUP BY 1),
whole AS (SELECT sum(freq) AS total FROM dict),
weighted AS (SELECT word, floor(1000000 * ln(freq / total) + 0.5)::BIGINT AS w FROM dict, whole),
texts AS (SELECT 0 AS side, item_id AS id, {UNSPACED('text')} AS t FROM benchmark UNION ALL SELECT 1, doc_id, {UNSPACED('text')} FROM documents),
pieces AS (SELECT side, id, unnest({RUNS('t')}) AS run FROM texts),
runs AS (SELECT DISTINCT run FROM pieces WHERE regexp_full_match(run, '[㐀-䶿一-鿿]+')),
spots AS (SELECT run, unnest(range(1, length(run) + 1)) AS i FROM runs),
parts AS (SELECT run, i, n, substr(run, i, n) AS word FROM spots, (SELECT DISTINCT length(word) AS n FROM dict) WHERE i + n - 1 <= length(run)),
edges AS (SELECT run, i, list({{'w': w, 'n': n::BIGINT}}) AS e FROM parts JOIN weighted USING (word) GROUP BY 1, 2),
graphs AS (
  SELECT run, list(coalesce(e, [{{'w': floor(-1000000 * ln(total) + 0.5)::BIGINT, 'n': 1::BIGINT}}]) ORDER BY i DESC) AS g
  FROM spots LEFT JOIN edges USING (run, i), whole GROUP BY 1),
paths AS (
  SELECT run, list_reduce(list_prepend([{{'w': 0::BIGINT, 'n': 0::BIGINT}}], g),
    lambda best, e: list_prepend(list_sort(list_transform(e, lambda x: {{'w': x.w + best[x.n].w, 'n': x.n}}), 'DESC')[1], best)) AS best FROM graphs),
walk AS (
  SELECT run, 1::BIGINT AS pos, best FROM paths
  UNION ALL SELECT run, pos + best[pos].n, best FROM walk WHERE pos + best[pos].n <= length(run)),
cut AS (SELECT run, substr(run, pos, best[pos].n) AS term FROM walk),
terms AS (SELECT side, id, coalesce(term, run) AS term FROM pieces LEFT JOIN cut USING (run)),
asked AS (SELECT DISTINCT id AS query_id, term FROM terms WHERE side = 0 AND term <> 'pattern' AND NOT regexp_full_match(term, '[㐀-䶿一-鿿]')),
lens AS (SELECT d.doc_id AS key, count(term) AS dl FROM documents d LEFT JOIN terms ON side = 1 AND id = d.doc_id GROUP BY 1),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
tf AS (SELECT id AS key, term, count(*) AS tf FROM terms WHERE side = 1 AND term IN (SELECT term FROM asked) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT query_id, key, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN lens USING (key), stats GROUP BY 1, 2),
needles AS (SELECT id AS query_id, trim(substr(trim(t), 1, 24)) AS needle FROM texts WHERE side = 0),
lit AS (SELECT query_id, id AS key FROM needles JOIN texts ON side = 1 AND contains(t, needle) WHERE regexp_matches(needle, '[一-鿿]')),
united AS (SELECT query_id, key, 20.0::DOUBLE AS score, 1 AS l FROM lit UNION ALL SELECT query_id, key, score, 0 FROM bm WHERE (query_id, key) NOT IN (SELECT (query_id, key) FROM lit))
SELECT query_id, key, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY l DESC, round(score, 6) DESC, key) - 1 AS rank FROM united) WHERE rank < 50""")
def keyword_chinese(s: SparkSession, d: str) -> DataFrame:
    """The united keyword channel over texts in Chinese letters without blanks; the dictionary has the words of the documents with their counts."""
    plain = lambda c: T.words_in_chinese(F.replace(c, F.lit(" "), F.lit("")))
    docs = A.table(s, d, "documents")
    word = F.explode(F.regexp_extract_all(T.words_in_chinese(F.col("text")), F.lit("([一-鿿]+)"), 1))
    dictionary = docs.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    q = A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), plain("text").alias("text"))
    m = docs.select(F.col("doc_id").alias("key"), plain("text").alias("content"))
    road = keyword_road(q, m, 50, keyword.index_of(m, [], dictionary), dictionary)
    return road.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {QRY}, {KNN} SELECT query_id, key, round(score, 6) AS score, rank FROM ({_rank('sem', 'semantic', 10)})")
def knn_exact(s: SparkSession, d: str) -> DataFrame:
    out = signals.ranked(vector.knn(A.queries(s, d).filter("v is not null").select("query_id", "v"), A.vectors(s, d), 10), "semantic", 10)
    return out.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {QRY}, sem AS (SELECT query_id, vec_id AS key, max(list_cosine_similarity(v, e)) AS score FROM qry,
  (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id, list_reverse(embedding)::DOUBLE[] FROM embeddings) WHERE v IS NOT NULL GROUP BY 1, 2)
SELECT query_id, key, round(score, 6) AS score, rank FROM ({_rank('(SELECT * FROM sem WHERE score > 0)', 'semantic', 10)})""")
def knn_dual_road(s: SparkSession, d: str) -> DataFrame:
    v = A.vectors(s, d)
    asked = v.withColumn("v", F.reverse("v"))
    out = signals.ranked(signals.semantic(A.queries(s, d).filter("v is not null"), [v, asked], 10), "semantic", 10)
    return out.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {QRY}, sem AS (SELECT query_id, vec_id AS key, list_cosine_similarity(v, embedding::DOUBLE[]) AS score FROM qry, embeddings WHERE v IS NOT NULL AND label = query_id % 5)
SELECT query_id, key, round(score, 6) AS score, rank FROM ({_rank('sem', 'semantic', 10)})""")
def knn_filtered(s: SparkSession, d: str) -> DataFrame:
    q = A.queries(s, d).filter("v is not null").select("query_id", "v", (F.col("query_id") % 5).cast("int").alias("namespace"))
    out = signals.ranked(vector.knn(q, A.vectors(s, d), 10, same=["namespace"]), "semantic", 10)
    return out.select("query_id", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("""WITH p AS (SELECT a.vec_id AS key, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
q AS (SELECT *, list_transform(x, lambda t: abs(t) / list_sum(list_transform(x, lambda u: abs(u)))) AS px, list_transform(y, lambda t: abs(t) / list_sum(list_transform(y, lambda u: abs(u)))) AS py FROM p)
SELECT key, round(list_distance(x, y), 6) AS l2, round(list_sum(list_transform(list_zip(x, y), lambda z: abs(z[1] - z[2]))), 6) AS l1, round(list_dot_product(x, y), 6) AS dot,
  round(list_cosine_similarity(x, y), 6) AS cos, round(sqrt(greatest(1 - list_sum(list_transform(list_zip(px, py), lambda z: sqrt(z[1] * z[2]))), 0)), 6) AS hellinger,
  round(list_sum(list_transform(list_zip(px, py), lambda z: (z[1] - z[2]) * ln(greatest(z[1], 1e-30) / greatest(z[2], 1e-30)))), 5) AS jeffreys FROM q""")
def vector_distances(s: SparkSession, d: str) -> DataFrame:
    v = A.vectors(s, d)
    p = v.select("key", F.col("v").alias("x")).join(v.select((F.col("key") - 1).alias("key"), F.col("v").alias("y")), "key")
    norm = lambda c: F.transform(c, lambda t: F.abs(t) / F.aggregate(F.transform(c, F.abs), F.lit(0.0), lambda a, b: a + b))
    p = p.withColumn("px", norm(F.col("x"))).withColumn("py", norm(F.col("y")))
    x, y, px, py = (F.col(c) for c in ("x", "y", "px", "py"))
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    return p.select("key", r(vector.l2(x, y), "l2"), r(vector.l1(x, y), "l1"), r(vector.dot(x, y), "dot"), r(vector.cosine(x, y), "cos"), r(vector.hellinger(px, py), "hellinger"), r(vector.jeffreys(px, py), "jeffreys", 5))


@query("""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS n FROM s),
e AS (SELECT a, b, round(c, 2) AS weight FROM r WHERE n <= 8 AND c >= 0.3)
SELECT a AS source, b AS target, weight FROM e UNION SELECT b, a, weight FROM e""")
def knn_edges(s: SparkSession, d: str) -> DataFrame:
    return vector.knn_edges(A.vectors(s, d), k=12, least=0.3, same=["namespace"])


@query()
def greedy_capped_knn(s: SparkSession, d: str) -> DataFrame:
    e = vector.knn_edges(A.vectors(s, d), k=8, least=0.3, same=["namespace"])
    ns = A.vectors(s, d).select(F.col("key").alias("source"), "namespace")
    pairs = e.join(ns, "source").groupBy("namespace", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").alias("weight"))
    return vector.capped_graph(pairs, 3)


@query("""WITH s AS (SELECT a.vec_id AS new, b.vec_id AS old, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY round(c, 6) DESC, old) AS n FROM s)
SELECT old, min(new) AS new FROM r WHERE n <= 10 AND same AND round(c, 6) > 0.3 GROUP BY 1""")
def near_dup_supersede(s: SparkSession, d: str) -> DataFrame:
    return vector.near_duplicates(A.vectors(s, d), least=0.3, same=["namespace"]).select("old", "new")


# --- fusion and the whole pipeline ---
@query(f"WITH {FUSED} SELECT query_id, key, round(rrf, 6) AS rrf, round(sem, 6) AS sem, round(kw, 6) AS kw FROM fused")
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    found = all_signals(_queries(s, d), A.memories(s, d), A.vectors(s, d), Params(NOW))
    return fusion.rrf(found).select("query_id", "key", *(F.round(c, 6).alias(c) for c in ("rrf", "sem", "kw")))


@query(f"WITH {SIGNALS} SELECT channel, count(*) AS n, count(DISTINCT query_id) AS queries FROM sig GROUP BY 1")
def channel_contributions(s: SparkSession, d: str) -> DataFrame:
    found = all_signals(_queries(s, d), A.memories(s, d), A.vectors(s, d), Params(NOW))
    return found.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("query_id").alias("queries"))


@query(f"WITH {SCORED} SELECT query_id, key, round(score, 6) AS score FROM scored")
def two_stage_rerank(s: SparkSession, d: str) -> DataFrame:
    q, m = _queries(s, d), A.memories(s, d)
    fused = fusion.rrf(all_signals(q, m, A.vectors(s, d), Params(NOW))).join(m, "key")
    kept = time_filter(fused, Params(NOW)).join(q.select("query_id", F.col("text").alias("q_text")), "query_id")
    kept = kept.withColumn("rrf", F.col("rrf") + fusion.text_signal_boost(F.col("q_text"), F.col("content"), NOW))
    return fusion.rerank(kept, NOW).select("query_id", "key", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED}, res AS (SELECT DISTINCT query_id, key, 1 AS r FROM sig WHERE channel IN ('keyword', 'semantic') AND rank < 50),
fin AS (SELECT query_id, key, score, coalesce(r, 0) AS reserved, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(r, 0) DESC, round(score, 6) DESC, key) AS rank FROM scored LEFT JOIN res USING (query_id, key))
SELECT query_id, rank, key, round(score, 6) AS score, reserved, 'current' AS time_status FROM fin WHERE rank <= 10""")
def hybrid_search_full(s: SparkSession, d: str) -> DataFrame:
    out = hybrid_search(_queries(s, d), A.memories(s, d), A.vectors(s, d), Params(NOW))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 6).alias("score"), F.col("reserved").cast("int").alias("reserved"), "time_status")


@query(ORACLES["hybrid_search_full"])
def hybrid_search_indexed(s: SparkSession, d: str) -> DataFrame:
    """The whole search, its keyword channel over a stored index that is written in two versions: all but every third document, then the others."""
    m = A.memories(s, d)
    store = IndexStore(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}", ("namespace",))
    store.build(m.filter("key % 3 <> 0"))
    store.append(m.filter("key % 3 = 0"))
    out = hybrid_search(_queries(s, d), m, A.vectors(s, d), Params(NOW), index=store.read())
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 6).alias("score"), F.col("reserved").cast("int").alias("reserved"), "time_status")


@query(f"""WITH {FUSED} SELECT query_id, key, round(rrf * CASE WHEN superseded_by IS NULL AND {VALID} THEN 1 ELSE 0.5 END, 6) AS rrf,
  CASE WHEN superseded_by IS NULL AND {VALID} THEN 'current' ELSE 'superseded' END AS time_status FROM fused JOIN mem USING (key)""")
def include_superseded(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d)
    fused = fusion.rrf(all_signals(_queries(s, d), m, A.vectors(s, d), Params(NOW))).join(m, "key")
    return time_filter(fused, Params(NOW, include_superseded=True)).select("query_id", "key", F.round("rrf", 6).alias("rrf"), "time_status")


@query(f"""WITH {QRY}, {KNN}, got AS ({_rank('sem', 'semantic', 5)}), gold AS (SELECT query_id, key FROM sem WHERE score >= 0.2 AND key <> query_id)
SELECT g.query_id, count(*) AS gold, count(t.key) AS hit, round(count(t.key) / count(*), 6) AS recall FROM gold g LEFT JOIN got t ON t.query_id = g.query_id AND t.key = g.key GROUP BY 1""")
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    q, v = A.queries(s, d).filter("v is not null").select("query_id", "v"), A.vectors(s, d)
    got = signals.ranked(vector.knn(q, v, 5), "semantic", 5).select("query_id", "key", F.lit(1).alias("hit"))
    gold = vector.knn(q, v, None, least=0.2).filter(F.col("key") != F.col("query_id"))
    return gold.join(got, ["query_id", "key"], "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"), F.count("hit").alias("hit"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("recall"))


# --- time ---
@query(f"WITH {VER} SELECT entity, key, price FROM ver WHERE (valid_from IS NULL OR valid_from <= '1996-06-01T00:00:00') AND (valid_to IS NULL OR valid_to >= '1996-06-01T00:00:00')")
def as_of_versions(s: SparkSession, d: str) -> DataFrame:
    return A.versions(s, d).filter(TM.valid_at(F.col("valid_from"), F.col("valid_to"), "1996-06-01T00:00:00")).select("entity", "key", "price")


@query(f"WITH {MEM} SELECT key FROM mem WHERE superseded_by IS NULL AND {VALID}")
def latest_now(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).filter(F.col("superseded_by").isNull() & TM.valid_at(F.col("valid_from"), F.col("valid_to"), NOW)).select("key")


@query(f"WITH {VER} SELECT entity, count(*) AS versions, max(key) FILTER (superseded_by IS NULL) AS tip FROM ver GROUP BY 1")
def supersession_chain(s: SparkSession, d: str) -> DataFrame:
    return A.versions(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("versions"), F.max(F.when(F.col("superseded_by").isNull(), F.col("key"))).alias("tip"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS stamp FROM events")
def normalize_times(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(F.lit("1970-01-01 00:00:00"), F.lit(""), F.lit("0")), (F.col("event_id") % 9 / 3 + 1).cast("int"))).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return e.select("event_id", TM.normalise_stamp(raw).alias("stamp"))


# --- text ---
@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '([0-9]+(?:\\.[0-9]+)?)', 1), lambda x: length(x) <= 24))), '|') AS numbers FROM documents")
def extract_numbers(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(T.numbers(F.col("text"))), "|").alias("numbers"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS dates FROM events")
def extract_dates(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("on "), F.date_format("ts", "yyyy/MM/dd"), F.lit(" and again "), F.date_format("ts", "yyyy-MM-dd"))
    return A.table(s, d, "events").select("event_id", F.array_join(T.dates(text), "|").alias("dates"))


@query("SELECT doc_id, sum(length(x)) AS chars, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[!?\\n。！？；;]'), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> '')) AS x FROM documents) GROUP BY 1")
def split_sentences(s: SparkSession, d: str) -> DataFrame:
    parts = A.table(s, d, "documents").select("doc_id", F.explode(T.sentences(F.col("text"))).alias("x"))
    parts = parts.withColumn("x", F.regexp_replace("x", "[!?。！？；;]$", "")).withColumn("x", F.regexp_replace("x", r"^[ \t\r]+|[ \t\r]+$", "")).filter("x <> ''")
    return parts.groupBy("doc_id").agg(F.sum(F.length("x")).alias("chars"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, i AS part, length(substr(text, i * 3300 + 1, 3500)) AS chars, substr(sha256(substr(text, i * 3300 + 1, 3500)), 1, 16) AS id FROM documents, unnest(range(0, greatest(ceil((length(text) - 3500) / 3300.0), 0)::BIGINT + 1)) t(i)")
def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    parts = A.table(s, d, "documents").select("doc_id", F.posexplode(T.chunk_text(F.col("text"))).alias("part", "c"))
    return parts.select("doc_id", F.col("part").cast("long").alias("part"), F.length("c").cast("long").alias("chars"), T.content_id(F.col("c")).alias("id"))


@query(f"""SELECT event_id, strftime(DATE '2026-07-16' - 1, '%Y-%m-%d') || '|2026-07-06|2026-07-08|2026-08-01' AS said FROM events""")
def relative_dates(s: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("昨天见面, 上周三再谈, 下个月定; event "), F.col("event_id").cast("string"))
    return A.table(s, d, "events").select("event_id", F.array_join(T.relative_dates(text, "2026-07-16"), "|").alias("said"))


@query(f"""WITH {MEM}, {QRY}, {BM25} SELECT query_id, key, round(least(0.05, 0.01 * {SHARED("t", "content")})::DOUBLE, 6) AS boost
FROM (SELECT item_id AS query_id, text || ' 2 12 7' AS t FROM benchmark) JOIN bm USING (query_id) JOIN mem USING (key)""")
def text_signal_boost(s: SparkSession, d: str) -> DataFrame:
    q = A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat("text", F.lit(" 2 12 7")).alias("t"))
    m = A.memories(s, d)
    # signals are found once for each document and query, not for each pair
    numbers, dates = fusion.content_signals(F.col("content"), NOW)
    own, asked = m.select("key", numbers.alias("numbers"), dates.alias("dates")), q.select("query_id", fusion.query_signals(F.col("t"), NOW).alias("asked"))
    hits = signals.bm25(A.queries(s, d), m).select("query_id", "key").join(own, "key").join(asked, "query_id")
    return hits.select("query_id", "key", F.round(fusion.boost_of(F.col("asked"), F.col("numbers"), F.col("dates")), 6).alias("boost"))


@query("SELECT substr(sha256(text), 1, 16) AS id, count(*) - 1 AS recall_count, max(1 + doc_id % 5)::DOUBLE AS importance, min(doc_id) AS first_key FROM documents GROUP BY 1")
def exact_dedup_fold(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.fold_exact(A.memories(s, d).withColumn("confidence", F.lit(0.5))).select("id", "recall_count", "importance", "first_key")


@query()
def distill(s: SparkSession, d: str) -> DataFrame:
    short = T.distill(F.col("text"))
    return A.table(s, d, "documents").select("doc_id", T.content_id(short).alias("id"), F.length(short).cast("long").alias("chars"), (short != F.col("text")).alias("cut"))


_HALF = f"CASE doc_id % 3 WHEN 0 THEN {CHINESE('text')} WHEN 1 THEN {CHINESE('substr(text, 1, length(text) // 3)')} || substr(text, length(text) // 3 + 1) ELSE text END"


@query(rf"""WITH t AS (SELECT source, {_HALF} AS text FROM documents) SELECT source, count(*) AS n, sum(CASE WHEN regexp_matches(text, '[一-鿿]') THEN 1 ELSE 0 END)::BIGINT AS cjk,
  sum(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) > 0 AND 2 * length(regexp_replace(text, '[^一-鿿㐀-䶿]', '', 'g')) >= length(regexp_replace(text, '\s', '', 'g')) THEN 1 ELSE 0 END)::BIGINT AS chinese FROM t GROUP BY 1""")
def language_flags(s: SparkSession, d: str) -> DataFrame:
    """A third of the documents with Chinese characters for letters, a third with some at the beginning."""
    text, third = F.col("text"), F.floor(F.length("text") / 3).cast("int")
    mixed = F.concat(T.words_in_chinese(F.substr(text, F.lit(1), third)), F.substr(text, third + 1))
    t = F.when(F.col("doc_id") % 3 == 0, T.words_in_chinese(text)).when(F.col("doc_id") % 3 == 1, mixed).otherwise(text)
    return A.table(s, d, "documents").select("source", t.alias("t")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(T.has_cjk(F.col("t")).cast("long")).alias("cjk"), F.sum(T.mostly_chinese(F.col("t")).cast("long")).alias("chinese"))


# --- filters, profile, preferences ---
@query(f"WITH {MEM} SELECT key FROM mem WHERE list_has_all(tags, ['pref', 'hard_rule'])")
def tags_all_filter(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).filter(F.size(F.array_except(F.array(F.lit("pref"), F.lit("hard_rule")), F.col("tags"))) == 0).select("key")


@query(f"WITH {MEM} SELECT namespace, granted, count(*) AS n FROM mem, (VALUES ('src1'), ('src2/x'), ('src'), ('*')) t(granted) WHERE granted = '*' OR namespace = granted OR starts_with(namespace, granted || '/') OR starts_with(granted, namespace || '/') GROUP BY 1, 2")
def ns_access_join(s: SparkSession, d: str) -> DataFrame:
    ns = A.memories(s, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))
    granted = F.explode(F.array(*map(F.lit, ("src1", "src2/x", "src", "*"))))
    g, n = F.col("granted"), F.col("namespace")
    ok = (g == "*") | (g == n) | F.startswith(n, F.concat(g, F.lit("/"))) | F.startswith(g, F.concat(n, F.lit("/")))
    return ns.withColumn("granted", granted).filter(ok).select("namespace", "granted", "n")


_KIND = "CASE WHEN list_contains(tags, 'hard_rule') THEN 'hard_rule' WHEN list_contains(tags, 'pref') THEN 'pref' WHEN list_contains(tags, 'style') THEN 'style' WHEN list_has_any(tags, ['insight', 'auto_insight']) THEN 'insight' ELSE category END"
_PARTS = {
    "static": "((category = 'preference' AND list_has_any(tags, ['hard_rule', 'pref', 'style'])) OR list_contains(tags, 'profile_static'))",
    "dynamic": "((category IN ('decision', 'fact', 'pattern') OR list_has_any(tags, ['decision', 'fact', 'pattern'])) AND NOT list_has_any(tags, ['insight', 'auto_insight']))",
}


@query(f"""WITH {MEM}, now AS (SELECT *, {_KIND} AS kind FROM mem WHERE superseded_by IS NULL AND {VALID}),
p AS (SELECT *, 'static' AS part, list_contains(tags, 'hard_rule') AS top FROM now WHERE {_PARTS["static"]} UNION ALL SELECT *, 'dynamic', false FROM now WHERE {_PARTS["dynamic"]}),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace, part ORDER BY top DESC, importance DESC, created_at DESC, key) AS n FROM p)
SELECT namespace, part, kind, key FROM r WHERE n <= CASE part WHEN 'static' THEN 12 ELSE 15 END""")
def profile_static_dynamic(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.profile(A.memories(s, d), NOW).select("namespace", "part", "kind", "key")


@query(f"WITH {MEM} SELECT namespace, key, 'memory' AS origin FROM mem WHERE list_contains(tags, 'pref') UNION ALL SELECT 'src' || label::VARCHAR, vec_id, 'legacy' FROM embeddings")
def prefs_union(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).filter(F.array_contains("tags", "pref")).select("namespace", "key", F.lit("memory").alias("origin"))
    return m.unionByName(A.vectors(s, d).select(F.concat(F.lit("src"), F.col("namespace").cast("string")).alias("namespace"), "key", F.lit("legacy").alias("origin")))


@query(f"WITH {MEM}, d AS (SELECT namespace, key FROM mem WHERE category = 'decision' AND list_contains(tags, 'hard_rule')), f AS (SELECT namespace, key FROM mem WHERE list_contains(tags, 'insight')) SELECT namespace, key FROM d UNION ALL SELECT namespace, key FROM f WHERE namespace NOT IN (SELECT namespace FROM d)")
def decisions_fallback(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d)
    first, second = m.filter((F.col("category") == "decision") & F.array_contains("tags", "hard_rule")).select("namespace", "key"), m.filter(F.array_contains("tags", "insight")).select("namespace", "key")
    return first.unionByName(second.join(first.select("namespace").distinct(), "namespace", "left_anti"))


@query(f"WITH {MEM} SELECT key, created_at FROM mem WHERE created_at > '2024-01-05T00:00:00' AND category = 'observation' ORDER BY created_at, key LIMIT 200")
def unconsolidated_batch(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.observe_cursor(A.memories(s, d), "2024-01-05T00:00:00").select("key", "created_at")


# --- graph ---
@query(f"WITH {REL} SELECT node, count(*) AS links FROM (SELECT source_id AS node FROM rel UNION ALL SELECT target_id FROM rel WHERE source_id <> target_id) GROUP BY 1")
def link_counts(s: SparkSession, d: str) -> DataFrame:
    return graph.link_counts(A.relations(s, d))


@query(f"WITH {REL} SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, relation_type, round(least(1.0, greatest(0.05, max(weight))), 2) AS weight FROM rel WHERE source_id <> target_id GROUP BY 1, 2, 3")
def undirected_dedupe(s: SparkSession, d: str) -> DataFrame:
    return graph.undirected(A.relations(s, d))


@query(f"WITH {MEN} SELECT entity, memory_id, n FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY entity) AS n FROM (SELECT DISTINCT entity, memory_id FROM men)) WHERE n <= 16")
def mention_topn(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("memory_id").orderBy("entity")
    return A.mentions(s, d).select("entity", "memory_id").distinct().withColumn("n", F.row_number().over(w).cast("long")).filter("n <= 16")


@query("""WITH men AS (SELECT DISTINCT l_partkey AS entity, l_suppkey AS memory_id FROM lineitem), deg AS (SELECT memory_id, count(*) AS deg FROM men GROUP BY 1),
p AS (SELECT a.memory_id AS a, b.memory_id AS b, count(*) AS shared FROM men a JOIN men b ON a.entity = b.entity AND a.memory_id < b.memory_id GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT a, b, shared, round(shared / (1 + ln(greatest(x.deg, y.deg))), 4) AS weight FROM p JOIN deg x ON x.memory_id = a JOIN deg y ON y.memory_id = b WHERE round(shared / (1 + ln(greatest(x.deg, y.deg))), 4) >= 0.1""")
def cooccur_pairs(s: SparkSession, d: str) -> DataFrame:
    return graph.cooccurrence(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("memory_id")))


@query("""WITH res AS (SELECT l_suppkey AS query_id, l_orderkey AS key, l_partkey AS entity FROM lineitem), r AS (SELECT DISTINCT query_id, key FROM res),
men AS (SELECT l_orderkey AS key, l_returnflag || l_linestatus AS entity FROM lineitem), own AS (SELECT query_id, key, entity FROM r JOIN men USING (key)),
sh AS (SELECT query_id, entity, count(DISTINCT key) - 1 AS others FROM own GROUP BY 1, 2),
per AS (SELECT query_id, key, 0.012 * sum(CASE WHEN entity = 'RF' THEN 1 ELSE 0 END) + 0.004 * sum(others) AS b FROM own JOIN sh USING (query_id, entity) GROUP BY 1, 2),
n AS (SELECT query_id, count(*) AS n FROM r GROUP BY 1)
SELECT query_id, key, round((CASE WHEN n > 1 THEN least(0.06, coalesce(b, 0)) ELSE 0 END)::DOUBLE, 6) AS boost FROM r JOIN n USING (query_id) LEFT JOIN per USING (query_id, key)""")
def cooccur_boost(s: SparkSession, d: str) -> DataFrame:
    li = A.table(s, d, "lineitem")
    res = li.select(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("key")).distinct()
    men = li.select(F.col("l_orderkey").alias("memory_id"), F.concat("l_returnflag", "l_linestatus").alias("entity"))
    named = res.select("query_id").distinct().withColumn("entity", F.lit("RF"))
    return fusion.cooccurrence_boost(res, men, named).select("query_id", "key", F.round("boost", 6).alias("boost"))


@query("SELECT *, row_number() OVER (ORDER BY mentions_count DESC, entity) AS rank FROM (SELECT p_brand AS entity, count(*) AS mentions_count FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1 HAVING contains(lower(p_brand), '2') OR bool_or(contains(lower(p_type), '2')))")
def entity_search(s: SparkSession, d: str) -> DataFrame:
    p, li = A.table(s, d, "part"), A.table(s, d, "lineitem")
    mentions = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("entity"), F.col("p_type").alias("context"))
    return graph.entity_search(p.select(F.col("p_brand").alias("entity")).distinct(), mentions, "2")


@query()
def graph_expand_2hop(s: SparkSession, d: str) -> DataFrame:
    seeds = A.table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") * 7).alias("node"), F.lit(1.0).alias("score"))
    return graph.expand(seeds, A.relations(s, d), 2).withColumn("score", F.round("score", 6))


@query("WITH RECURSIVE e AS (SELECT superseded_by AS o, key AS s FROM (SELECT doc_id AS key, CASE WHEN quality = 0 THEN doc_id + 1 ELSE doc_id + 2 END AS superseded_by FROM labels WHERE toxic = 1)), c AS (SELECT s, o FROM e UNION SELECT c.s, e.o FROM c JOIN e ON c.o = e.s) SELECT s, o FROM c")
def closure_supersedes(s: SparkSession, d: str) -> DataFrame:
    return graph.closure(A.table(s, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("s"), F.expr("case when quality = 0 then doc_id + 1 else doc_id + 2 end").alias("o")))


@query("SELECT DISTINCT l_suppkey AS s, l_partkey AS o FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def triples_except(s: SparkSession, d: str) -> DataFrame:
    li = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("o"), "l_returnflag")
    return li.filter("l_returnflag = 'R'").select("s", "o").subtract(li.filter("l_returnflag = 'A'").select("s", "o"))


@query(f"""WITH t AS (SELECT DISTINCT p_partkey AS k, unnest({WORDS("p_name || ' ' || p_type")}) AS w FROM part),
n AS (SELECT k, count(*) AS n FROM t GROUP BY 1), c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM t a JOIN t b ON a.w = b.w AND a.k < b.k GROUP BY 1, 2)
SELECT a, b, round(c / (x.n + y.n - c), 6) AS jaccard FROM c JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE c / (x.n + y.n - c) >= 0.6""")
def jaccard_edges(s: SparkSession, d: str) -> DataFrame:
    t = A.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.explode(F.array_distinct(T.tokens(F.concat_ws(" ", "p_name", "p_type")))).alias("w"))
    return graph.jaccard_pairs(t, 0.6).withColumn("jaccard", F.round("jaccard", 6))


# --- writes and maintenance ---
@query(f"""WITH {MEM}, r AS (SELECT doc_id AS key, source AS namespace, doc_id + doc_id % 3 AS target FROM documents)
SELECT r.key, r.target, CASE WHEN r.key = r.target THEN 409 WHEN m.namespace IS NULL THEN 404 WHEN m.namespace <> r.namespace THEN 403 WHEN m.superseded_by IS NOT NULL THEN 409 ELSE 200 END AS status FROM r LEFT JOIN mem m ON m.key = r.target""")
def explicit_supersede_status(s: SparkSession, d: str) -> DataFrame:
    r = A.table(s, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("namespace"), (F.col("doc_id") + F.col("doc_id") % 3).alias("target"))
    return lifecycle.supersede_status(r, A.memories(s, d))


@query(f"""WITH {MEM}, n AS (SELECT *, CASE WHEN tier IN ('hot', 'warm') AND decay > 0.1 THEN round(decay * 0.95, 4) ELSE decay END AS nd FROM mem)
SELECT key, round(nd, 4) AS new_decay, CASE WHEN tier IN ('hot', 'warm') AND nd <= 0.1 AND recall_count < 3 THEN 'cold' ELSE tier END AS new_tier FROM n""")
def decay_step(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.decay_step(A.memories(s, d)).select("key", F.round("new_decay", 4).alias("new_decay"), "new_tier")


@query(f"WITH {MEM} SELECT namespace, key, round(decay, 4) AS old_decay, 'decayed' AS new_tier FROM mem WHERE tier IN ('hot', 'warm') AND decay > 0.1 ORDER BY created_at DESC, key LIMIT 500")
def decay_timeline(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).filter(F.col("tier").isin("hot", "warm") & (F.col("decay") > 0.1))
    return m.orderBy(F.desc("created_at"), "key").limit(500).select("namespace", "key", F.round("decay", 4).alias("old_decay"), F.lit("decayed").alias("new_tier"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, ts, date_trunc('hour', ts) AS h FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, h ORDER BY ts, event_id) AS place FROM e)
SELECT event_id, place, place <= 1 AS admitted FROM p""")
def quota_admission(s: SparkSession, d: str) -> DataFrame:
    r = A.table(s, d, "events").select(F.col("user_id").alias("ns"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("key"))
    return lifecycle.quota_admission(r, 1, "1 hour").select(F.col("key").alias("event_id"), F.col("place").cast("long").alias("place"), "admitted")


@query("""WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, coalesce(floor(epoch(ts)) - floor(epoch(prev)) >= 86400, true) AS allowed FROM e""")
def cooldown_gate(s: SparkSession, d: str) -> DataFrame:
    r = A.table(s, d, "events").select(F.col("event_type").alias("phase"), F.col("user_id").alias("ns"), "ts", F.col("event_id").alias("key"))
    return lifecycle.cooldown(r, 86400).select(F.col("key").alias("event_id"), "allowed")


@query("SELECT strftime(ts, '%Gw%V') AS iso_week, event_type, count(*) AS n FROM events WHERE strftime(ts, '%Gw%V') > '2024w01' GROUP BY 1, 2")
def audit_week_union(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events").withColumn("iso_week", T.iso_week(F.col("ts")))
    return e.filter("iso_week > '2024w01'").groupBy("iso_week", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH b AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), t AS (SELECT day, CASE WHEN day(day) = 1 THEN 'monthly' WHEN isodow(day) = 1 THEN 'weekly' ELSE 'daily' END AS tier FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY day DESC) AS n FROM t)
SELECT strftime(day, '%Y-%m-%d') AS day, tier, n <= CASE tier WHEN 'daily' THEN 7 WHEN 'weekly' THEN 4 ELSE 3 END AS kept FROM r""")
def backup_retention(s: SparkSession, d: str) -> DataFrame:
    b = A.table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return lifecycle.backups_to_keep(b).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT doc_id, json_extract_string(j, '$.table') AS tab, length(json_extract_string(j, '$.row.content'))::BIGINT AS chars FROM (SELECT doc_id, to_json({'table': 'memories', 'row': {'id': doc_id::VARCHAR, 'content': text}}) AS j FROM documents)")
def export_jsonl(s: SparkSession, d: str) -> DataFrame:
    from ..sources.transfer import to_lines

    m = A.memories(s, d)
    lines = to_lines(m.select("id", "content"), "memories")
    back = lines.select(F.from_json("value", "table string, row struct<id: string, content: string>").alias("j"))
    return back.select(F.col("j.row.id").cast("long").alias("doc_id"), F.col("j.table").alias("tab"), F.length("j.row.content").cast("long").alias("chars"))


@query("SELECT doc_id AS key, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'ignored' ELSE 'inserted' END AS action FROM documents")
def import_conflict(s: SparkSession, d: str) -> DataFrame:
    from ..sources.transfer import import_rows

    m = A.memories(s, d).select("key", "content")
    return import_rows(A.table(s, d, "labels").select(F.col("doc_id").alias("key")), m, "key").select("key", "action")
