"""Queries of the write path, the entity graph, upkeep and evaluation over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, lifecycle, signals, vector
from ..sources import adapters as A
from .catalog import KNN, MEM, MEN, NOW, QRY, REL, VER, _rank, in_namespaces, query
from .hybrid import Params, hybrid_search


# --- entity graph ---
@query(f"WITH {MEN}, {REL} SELECT (SELECT count(DISTINCT entity) FROM men) AS entities, (SELECT count(*) FROM men) AS mentions, (SELECT count(*) FROM rel) AS edges")
def graph_counts(s: SparkSession, d: str) -> DataFrame:
    m = A.mentions(s, d).agg(F.countDistinct("entity").alias("entities"), F.count(F.lit(1)).alias("mentions"))
    return m.crossJoin(A.relations(s, d).agg(F.count(F.lit(1)).alias("edges")))  # one row each


@query(f"WITH {MEN}, e AS (SELECT DISTINCT p_brand AS entity FROM part UNION SELECT DISTINCT p_type FROM part) SELECT e.entity, count(men.entity) AS mentions_count FROM e LEFT JOIN men ON men.entity = e.entity GROUP BY 1")
def entity_mention_counts(s: SparkSession, d: str) -> DataFrame:
    p = A.table(s, d, "part")
    every = p.select(F.col("p_brand").alias("entity")).union(p.select("p_type")).distinct()
    counts = A.mentions(s, d).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "entity", "left").select("entity", F.coalesce("n", F.lit(0)).alias("mentions_count"))


@query("""WITH e AS (SELECT DISTINCT unnest(regexp_split_to_array(p_name, ' ')) AS entity FROM part), n AS (SELECT trim(entity) AS entity FROM e WHERE octet_length(encode(trim(entity))) >= 2 ORDER BY 1 LIMIT 256),
h AS (SELECT doc_id AS query_id, entity, row_number() OVER (PARTITION BY doc_id ORDER BY entity) AS r FROM documents JOIN n ON contains(lower(text), lower(entity)))
SELECT query_id, entity FROM h WHERE r <= 64""")
def names_in_queries(s: SparkSession, d: str) -> DataFrame:
    names = A.table(s, d, "part").select(F.explode(F.split("p_name", " ")).alias("entity")).distinct()
    return graph.entities_in(A.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), "text"), names)


@query(f"WITH {REL}, {MEM} SELECT source_id, count(*) AS gold, min(b.key) AS first FROM rel JOIN mem a ON a.key = source_id JOIN mem b ON b.key = target_id WHERE relation_type = 'semantic_related' AND a.namespace = b.namespace GROUP BY 1")
def gold_sets(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d)
    a, b = m.select(F.col("key").alias("source_id"), "namespace"), m.select(F.col("key").alias("target_id"), "namespace")
    both = A.relations(s, d).filter("relation_type = 'semantic_related'").join(a, "source_id").join(b, ["target_id", "namespace"])
    return both.groupBy("source_id").agg(F.count(F.lit(1)).alias("gold"), F.min("target_id").alias("first"))


@query(f"WITH {VER} SELECT key FROM ver WHERE valid_to IS NULL OR valid_to = '' OR valid_to < '1971-01-01' OR valid_to > '1997-01-01T00:00:00'")
def active_relations(s: SparkSession, d: str) -> DataFrame:
    to = F.col("valid_to")
    return A.versions(s, d).filter(to.isNull() | (to == "") | (to < "1971-01-01") | (to > "1997-01-01T00:00:00")).select("key")


#: Categories that make seeds, and the order in which they come.
_VALUE = ("pattern", "fact", "decision", "preference", "constraint", "lesson", "correction", "infrastructure", "note", "report")
_FIRST = ("pattern", "decision", "constraint", "preference", "lesson", "fact")


@query(f"""WITH {MEM}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY coalesce(nullif(list_position({list(_FIRST)}, category), 0), 7), CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 ELSE 2 END, importance DESC, decay DESC, key) AS rank
  FROM mem WHERE tier <> 'forgotten' AND category IN {_VALUE}) SELECT namespace, key, rank FROM r WHERE rank <= 100""")
def graph_seeds(s: SparkSession, d: str) -> DataFrame:
    place = F.nullif(F.array_position(F.array(*map(F.lit, _FIRST)), F.col("category")), F.lit(0))
    tier = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "warm", 1).otherwise(2)
    live = A.memories(s, d).filter((F.col("tier") != "forgotten") & F.col("category").isin(*_VALUE))
    out = lifecycle.newest(live, "namespace", 100, F.coalesce(place, F.lit(7)), tier, F.desc("importance"), F.desc("decay"), F.col("key"))
    return out.select("namespace", "key", F.col("rank").cast("long").alias("rank"))


_TYPES = ["uses", "owns", "banana", "part_of"]


@query(f"""WITH e AS (SELECT l_suppkey AS source_id, l_partkey AS target_id, {_TYPES}[(l_linenumber % 4 + 1)::INT] AS relation_type, l_discount AS weight, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT source_id, target_id, relation_type, count(*) AS writes, max(seq) AS last FROM e WHERE relation_type <> 'banana' GROUP BY 1, 2, 3""")
def edge_upserts(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("l_linenumber") % 4 + 1).cast("int"))
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    e = A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), kind.alias("relation_type"), at.alias("weight"), at.alias("at"))
    return graph.upsert_edges(e).select("source_id", "target_id", "relation_type", "writes", F.col("weight").alias("last"))


@query("""WITH t AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'P' THEN '_:b' ELSE 'c' || o_custkey END AS s, CASE WHEN o_orderpriority LIKE '1%' THEN 'banana' ELSE 'uses' END AS p, 'c' || (o_custkey + 1) AS o FROM orders),
e AS (SELECT 'c' || c_custkey AS entity FROM customer)
SELECT s, p, o, CASE WHEN s = '_:b' OR p = 'banana' OR s NOT IN (SELECT entity FROM e) OR o NOT IN (SELECT entity FROM e) THEN 'skipped' WHEN s IN (SELECT 'c' || c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'kept' ELSE 'written' END AS action FROM t""")
def ontology_write_back(s: SparkSession, d: str) -> DataFrame:
    c = lambda x: F.concat(F.lit("c"), x.cast("string"))
    key = F.col("o_custkey")
    t = A.table(s, d, "orders").select(F.when(F.col("o_orderstatus") == "P", "_:b").otherwise(c(key)).alias("s"), F.when(F.startswith("o_orderpriority", F.lit("1")), "banana").otherwise("uses").alias("p"), c(key + 1).alias("o")).distinct()
    people = A.table(s, d, "customer")
    manual = people.filter("c_mktsegment = 'BUILDING'").select(c(F.col("c_custkey")).alias("s"), F.lit("uses").alias("p"), c(F.col("c_custkey") + 1).alias("o"))
    return graph.write_back(t, people.select(c(F.col("c_custkey")).alias("entity")), manual)


@query()
def same_entity_capped(s: SparkSession, d: str) -> DataFrame:
    pairs = graph.cooccurrence(A.table(s, d, "lineitem").select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("memory_id")))
    return vector.capped_graph(pairs.select(F.lit("all").alias("namespace"), "a", "b", "weight"), 20)


@query()
def hybrid_search_graph(s: SparkSession, d: str) -> DataFrame:
    out = hybrid_search(in_namespaces(A.queries(s, d)), A.memories(s, d), A.vectors(s, d), Params(NOW, hops=2), relations=A.relations(s, d))
    return out.select("query_id", "rank", "key", F.round("score", 6).alias("score"), "reserved", "time_status")


# --- evaluation ---
@query(f"""WITH {QRY}, {KNN}, got AS ({_rank('sem', 'semantic', 5)}), gold AS (SELECT query_id, key FROM sem WHERE score >= 0.2 AND key <> query_id),
r AS (SELECT g.query_id, count(t.key) / count(*) AS recall FROM gold g LEFT JOIN got t ON t.query_id = g.query_id AND t.key = g.key GROUP BY 1)
SELECT count(*) AS probes, round(avg(recall), 6) AS recall, round(avg((recall = 0)::INT), 6) AS zero_rate, round(quantile_cont(recall, 0.5), 6) AS p50, round(quantile_cont(recall, 0.95), 6) AS p95 FROM r""")
def recall_summary(s: SparkSession, d: str) -> DataFrame:
    q, v = A.queries(s, d).filter("v is not null").select("query_id", "v"), A.vectors(s, d)
    gold = vector.knn(q, v, None, least=0.2).filter(F.col("key") != F.col("query_id")).select("query_id", "key")
    got = signals.ranked(vector.knn(q, v, 5), "semantic", 5).select("query_id", "key", F.lit(1).alias("hit"))
    r = gold.join(got, ["query_id", "key"], "left").groupBy("query_id").agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
    part = lambda p: F.round(F.percentile("recall", F.lit(p)), 6)
    return r.agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg((F.col("recall") == 0).cast("int")), 6).alias("zero_rate"), part(0.5).alias("p50"), part(0.95).alias("p95"))


@query("SELECT source AS capability, lang AS kind, count(*) AS n, round(avg(quality), 6) AS score, count(*) FILTER (toxic = 0) AS hits FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def judge_summary(s: SparkSession, d: str) -> DataFrame:
    j = A.table(s, d, "labels").join(A.table(s, d, "documents").select("doc_id", F.col("source").alias("capability"), F.col("lang").alias("kind")), "doc_id")
    return j.groupBy("capability", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("quality"), 6).alias("score"), F.count(F.when(F.col("toxic") == 0, 1)).alias("hits"))


# --- upkeep ---
_KEYS = {"documents": "doc_id", "embeddings": "vec_id", "events": "event_id", "labels": "doc_id", "orders": "o_orderkey", "conversations": "conv_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, coalesce(sum(n), 0)::BIGINT AS rows, coalesce(sum(n) FILTER (k IS NULL), 0)::BIGINT AS no_key, count(*) FILTER (k IS NOT NULL AND n > 1) AS repeated, CASE WHEN count(*) FILTER (k IS NULL OR n > 1) > 0 THEN 'fail' ELSE 'ok' END AS status FROM (SELECT {k} AS k, count(*) AS n FROM {t} GROUP BY 1)" for t, k in _KEYS.items()))
def health_checks(s: SparkSession, d: str) -> DataFrame:
    return lifecycle.health({t: (A.table(s, d, t), k) for t, k in _KEYS.items()})


@query("SELECT 'documents' AS tab, count(*) AS rows, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents UNION ALL SELECT 'embeddings', count(*), sum(4 * len(embedding))::BIGINT FROM embeddings UNION ALL SELECT 'pages', count(*), sum(octet_length(encode(html)))::BIGINT FROM pages")
def migration_manifest(s: SparkSession, d: str) -> DataFrame:
    out = None
    for t, size in (("documents", F.octet_length("text")), ("embeddings", 4 * F.size("embedding")), ("pages", F.octet_length("html"))):
        one = A.table(s, d, t).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).cast("long").alias("bytes")).select(F.lit(t).alias("tab"), "rows", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


_AGENTS = ["test_", "tester", "demo_", "agent_"]


@query(f"SELECT agent_id FROM (SELECT {_AGENTS}[(c_custkey % 4 + 1)::INT] || c_custkey AS agent_id, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN NULL ELSE 'b' END AS badge FROM customer) WHERE coalesce(badge, '') = '' OR agent_id LIKE 'test_%' OR agent_id LIKE 'demo_%'")
def dead_agents(s: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*map(F.lit, _AGENTS)), (F.col("c_custkey") % 4 + 1).cast("int")), F.col("c_custkey").cast("string"))
    seg = F.col("c_mktsegment")
    agents = A.table(s, d, "customer").select(name.alias("agent_id"), F.when(seg == "BUILDING", "").when(seg == "MACHINERY", None).otherwise("b").alias("badge"))
    return lifecycle.dead_agents(agents).select("agent_id")


@query("""WITH r AS (SELECT event_type AS phase, user_id AS ns, event_id AS seq, round(value * 10)::BIGINT AS cursor FROM events),
b AS (SELECT *, max(cursor) OVER (PARTITION BY phase, ns ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r)
SELECT phase, ns, max(cursor) AS cursor, count(*) AS runs, sum(seq % 5)::BIGINT AS items FROM b WHERE p IS NULL OR cursor > p GROUP BY 1, 2""")
def cursor_states(s: SparkSession, d: str) -> DataFrame:
    runs = A.table(s, d, "events").select(F.col("event_type").alias("phase"), F.col("user_id").alias("ns"), F.col("event_id").alias("at"), F.round(F.col("value") * 10).cast("long").alias("cursor"), (F.col("event_id") % 5).alias("items"))
    return lifecycle.cursor_states(runs)


@query("""WITH RECURSIVE r AS (SELECT event_id AS key, ts, ['consolidate', 'decay', 'dream'][(event_id % 3 + 1)::INT] AS phase, user_id AS ns, CASE WHEN event_id % 11 > 0 THEN floor(epoch(ts) / 43200)::BIGINT + event_id % 2 END AS cursor, event_id % 5 AS items FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY phase, ns ORDER BY ts, key) AS place FROM r),
f AS (SELECT phase, ns, 0::BIGINT AS place, NULL::BIGINT AS key, NULL::VARCHAR AS told, NULL::TIMESTAMP AS last, NULL::BIGINT AS cursor, 0::BIGINT AS runs, 0::BIGINT AS done FROM n WHERE place = 1
UNION ALL SELECT phase, ns, place, key, told, CASE told WHEN 'ok' THEN ts ELSE last END, CASE told WHEN 'ok' THEN new ELSE held END, CASE told WHEN 'ok' THEN runs + 1 ELSE runs END, CASE told WHEN 'ok' THEN done + items ELSE done END
FROM (SELECT n.phase, n.ns, n.place, n.key, n.ts, n.items, n.cursor AS new, f.cursor AS held, f.last, f.runs, f.done, CASE WHEN n.cursor IS NULL THEN 'empty' WHEN n.cursor <= f.cursor THEN 'behind'
WHEN epoch_us(n.ts) - epoch_us(f.last) < 1000000::BIGINT * (CASE n.phase WHEN 'consolidate' THEN 0 WHEN 'decay' THEN 60 ELSE 90000 END) THEN 'early' ELSE 'ok' END AS told FROM f JOIN n ON n.phase = f.phase AND n.ns = f.ns AND n.place = f.place + 1))
SELECT key AS event_id, told, cursor, runs, done AS items FROM f WHERE place > 0""")
def phase_updates(s: SparkSession, d: str) -> DataFrame:
    phase = F.element_at(F.array(F.lit("consolidate"), F.lit("decay"), F.lit("dream")), (F.col("event_id") % 3 + 1).cast("int"))
    cursor = F.when(F.col("event_id") % 11 > 0, F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01")).cast("long") * 2 + F.floor(F.hour("ts") / 12) + F.col("event_id") % 2)
    rows = A.table(s, d, "events").select(phase.alias("phase"), F.col("user_id").alias("ns"), "ts", F.col("event_id").alias("key"), cursor.alias("cursor"), (F.col("event_id") % 5).alias("items"))
    return lifecycle.phase_updates(rows, {"dream": 90_000}).select(F.col("key").alias("event_id"), "told", "cursor", "runs", "items")


@query("""WITH p AS (SELECT event_id, ts, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, CASE WHEN place > 2 THEN (floor(epoch(h)) + 3600 - floor(epoch(ts)))::BIGINT ELSE 0 END AS retry_after FROM p""")
def retry_after(s: SparkSession, d: str) -> DataFrame:
    r = A.table(s, d, "events").select(F.lit("all").alias("ns"), F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("key"))
    return lifecycle.quota_admission(r, 2, "1 hour").select(F.col("key").alias("event_id"), F.col("retry_after").cast("long").alias("retry_after"))


@query(f"""WITH {MEM}, r AS (SELECT user_id AS key, count(*) AS n, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last FROM events GROUP BY 1)
SELECT key, recall_count + coalesce(n, 0) AS recall_count, coalesce(last, last_recalled) AS last_recalled FROM mem LEFT JOIN r USING (key)""")
def recall_feedback(s: SparkSession, d: str) -> DataFrame:
    recalls = A.table(s, d, "events").select(F.col("user_id").alias("key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))
    return lifecycle.recall_feedback(A.memories(s, d), recalls).select("key", "recall_count", "last_recalled")


@query("SELECT conv_id AS inbox, turn, rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations WHERE role <> 'system') WHERE rank <= 5")
def mailbox_newest(s: SparkSession, d: str) -> DataFrame:
    sent = A.table(s, d, "conversations").filter("role <> 'system'").select(F.col("conv_id").alias("inbox"), "turn")
    return lifecycle.newest(sent, "inbox", 5, F.desc("turn")).select("inbox", "turn", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {MEM} SELECT CASE namespace WHEN 'src1' THEN 'moved' ELSE namespace END AS namespace, count(*) AS n FROM mem GROUP BY 1")
def namespace_move(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).withColumn("namespace", F.when(F.col("namespace") == "src1", "moved").otherwise(F.col("namespace")))
    return m.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REL}, g AS (SELECT doc_id AS key FROM labels WHERE quality = 0) SELECT source_id, target_id, count(*) AS n FROM rel WHERE source_id NOT IN (SELECT key FROM g) AND target_id NOT IN (SELECT key FROM g) GROUP BY 1, 2")
def delete_cascade(s: SparkSession, d: str) -> DataFrame:
    gone = A.table(s, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("key"))
    _, left = lifecycle.delete(A.memories(s, d), A.relations(s, d), gone)
    return left.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS skill, installs, rank FROM (SELECT *, row_number() OVER (ORDER BY installs DESC, p_retailprice DESC, p_partkey) AS rank FROM (SELECT p_partkey, p_retailprice, count(l_partkey) AS installs FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE contains(p_name, 'widget') GROUP BY 1, 2)) WHERE rank <= 20")
def skill_search(s: SparkSession, d: str) -> DataFrame:
    installs = A.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    best = A.table(s, d, "part").filter(F.contains("p_name", F.lit("widget"))).join(installs, "p_partkey", "left").select("p_partkey", "p_retailprice", F.coalesce("n", F.lit(0)).alias("installs"))
    best = best.orderBy(F.desc("installs"), F.desc("p_retailprice"), "p_partkey").limit(20)
    rank = F.row_number().over(Window.orderBy(F.desc("installs"), F.desc("p_retailprice"), "p_partkey"))
    return best.select(F.col("p_partkey").alias("skill"), "installs", rank.cast("long").alias("rank"))


@query("""WITH s AS (SELECT a.vec_id AS new, b.vec_id AS old, a.label = b.label AS same, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id AND a.label = b.label),
h AS (SELECT new, old, c, row_number() OVER (PARTITION BY new ORDER BY round(c, 6) DESC, old) AS n FROM s)
SELECT vec_id AS key, CASE WHEN round(c, 6) > 0.3 THEN old END AS bumps FROM embeddings LEFT JOIN h ON new = vec_id AND n = 1""")
def observe_near(s: SparkSession, d: str) -> DataFrame:
    v = A.vectors(s, d)
    hit = vector.knn(v.withColumnRenamed("key", "query_id"), v, 1, same=["namespace"], earlier=True).filter(F.round("score", 6) > 0.3)
    return v.select("key").join(hit.select(F.col("query_id").alias("key"), F.col("key").alias("bumps")), "key", "left")


@query("""WITH p AS (SELECT a.p_partkey AS k, a.p_name AS x, b.p_name AS y, list_distinct(regexp_split_to_array(a.p_name || ' ' || a.p_type, ' ')) AS s, list_distinct(regexp_split_to_array(b.p_name || ' ' || b.p_type, ' ')) AS t FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT k, levenshtein(x, y)::BIGINT AS edits, round(1 - len(list_intersect(s, t)) / (len(s) + len(t) - len(list_intersect(s, t))), 6) AS jaccard FROM p""")
def set_distances(s: SparkSession, d: str) -> DataFrame:
    p = A.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("x"), F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("s"))
    q = p.select((F.col("k") - 1).alias("k"), F.col("x").alias("y"), F.col("s").alias("t"))
    return p.join(q, "k").select("k", F.levenshtein("x", "y").cast("long").alias("edits"), F.round(vector.jaccard(F.col("s"), F.col("t")), 6).alias("jaccard"))


@query(f"""WITH {MEM}, {MEN}, e AS (SELECT memory_id AS key, string_agg(entity, '|' ORDER BY entity) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY entity) AS n FROM (SELECT DISTINCT entity, memory_id FROM men)) WHERE n <= 16 GROUP BY 1)
SELECT key, coalesce(entities, '') AS entities, substr(valid_from, 1, 10) AS occurred FROM mem LEFT JOIN e USING (key)""")
def ledger(s: SparkSession, d: str) -> DataFrame:
    m = A.mentions(s, d).select("entity", F.col("memory_id").alias("key")).distinct()
    e = lifecycle.newest(m, "key", 16, F.col("entity")).groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("entity")), "|").alias("entities"))
    occurred = F.coalesce(F.nullif(T.occurred(F.col("tags")), F.lit("")), F.substring("valid_from", 1, 10))
    return A.memories(s, d).join(e, "key", "left").select("key", F.coalesce("entities", F.lit("")).alias("entities"), occurred.alias("occurred"))
