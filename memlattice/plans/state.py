"""Queries of the write path, evolution, browsing, context and drawn graphs over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.temporal import valid_at
from ..operators import fusion, graph, lifecycle, signals, vector, views, writes
from ..sources import adapters as A
from ..sources import transfer
from .catalog import CHINESE, FOUND, MEM, MEN, NOW, ONCE, QRY, REL, SCORED, SIGNALS, VALID, VER, _queries, query
from .hybrid import Params, all_signals, hybrid_search
from .wording import _DATES, _MARKERS, _PARTS, _TRIM

_DAY = lambda e: f"strftime(DATE '2024-01-01' + ({e})::INT, '%Y-%m-%dT00:00:00')"
_PROMOTED = f"'[auto-promoted] ' || CASE WHEN {_TRIM.format('content')} = '' THEN '(no content)' WHEN length({_TRIM.format('content')}) > 120 THEN substr({_TRIM.format('content')}, 1, 120) || '…' ELSE {_TRIM.format('content')} END"


# --- writes ---
@query(f"""WITH {MEM} SELECT key, substr(sha256(content), 1, 16) AS id, 'hot' AS tier, 0.8::DOUBLE AS confidence, 1.0::DOUBLE AS decay, length(content) > 1200 AS cut,
  array_to_string(list_concat(list_concat(tags, list_transform(({FOUND("content")})[1:8], lambda x: 'signal:num:' || x)), list_concat(list_transform(({_DATES})[1:4], lambda x: 'signal:date:' || x), list_transform(({_MARKERS})[1:4], lambda x: 'signal:update:' || x))), '|') AS tags FROM mem""")
def remember_new(s: SparkSession, d: str) -> DataFrame:
    rows = writes.new_rows(A.memories(s, d), NOW)
    return rows.select("key", "id", "tier", "confidence", "decay", F.col("raw_ref").isNotNull().alias("cut"), F.array_join("tags", "|").alias("tags"))


def _placed(s: SparkSession, d: str) -> DataFrame:
    stamp = F.date_format(F.date_add(F.lit("2024-01-01"), (F.col("key") % 30).cast("int")), "yyyy-MM-dd'T'00:00:00")
    v = A.vectors(s, d)
    return v.select("key", F.col("namespace").cast("string").alias("namespace"), stamp.alias("valid_from"), F.when(F.col("key") % 5 == 0, F.lit("2024-01-10T00:00:00")).alias("valid_to"), F.when(F.col("key") % 9 == 0, "x").alias("superseded_by"), F.lit("hot").alias("tier"))


@query(f"""WITH s AS (SELECT a.vec_id AS new, b.vec_id AS old, a.label = b.label AS same, a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id < a.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY new ORDER BY round(c, 6) DESC, old) AS n FROM s),
p AS (SELECT old, any_value(label) AS label, min(new) AS new, arg_min(c, new) AS c FROM r WHERE n <= 10 AND same AND round(c, 6) > 0.3 GROUP BY 1)
SELECT label::VARCHAR AS namespace, old AS source_id, new AS target_id, 'updates' AS relation_type, round(c, 2) AS weight, 'cold' AS tier,
  CASE WHEN old % 5 = 0 AND '2024-01-10T00:00:00' < {_DAY('new % 30')} THEN '2024-01-10T00:00:00' ELSE {_DAY('new % 30')} END AS valid_to FROM p WHERE old % 9 <> 0""")
def near_dup_writes(s: SparkSession, d: str) -> DataFrame:
    pairs = vector.near_duplicates(A.vectors(s, d), least=0.3, same=["namespace"])
    after, edges = writes.near_dup_writes(_placed(s, d), pairs, NOW)
    state = after.select(F.col("key").alias("source_id"), "tier", "valid_to")
    return edges.drop("evidence").join(state, "source_id")


@query(f"""WITH {MEM} SELECT m.key, n.key::VARCHAR AS superseded_by, CASE WHEN n.key IS NULL THEN m.valid_to WHEN m.valid_to < n.valid_from THEN m.valid_to ELSE n.valid_from END AS valid_to,
  m.recall_count + coalesce(g.recall_count, 0) AS recall_count, CASE WHEN n.key IS NOT NULL THEN 1.0::DOUBLE END AS weight FROM mem m LEFT JOIN mem n ON n.key = m.key + 7 LEFT JOIN mem g ON g.key = m.key - 7""")
def merge_memories(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).withColumn("superseded_by", F.lit(None).cast("string"))
    pairs = m.select(F.col("key").alias("gone"), (F.col("key") + 7).alias("keep")).join(m.select(F.col("key").alias("keep")), "keep", "left_semi")
    after, edges = writes.merge(m, pairs, NOW)
    edges = edges.select(F.col("source_id").alias("key"), "weight")
    return after.select("key", "superseded_by", "valid_to", "recall_count").join(edges, "key", "left")


@query(f"WITH {MEM} SELECT target, key, created_at, row_number() OVER (PARTITION BY target ORDER BY created_at DESC, key) AS rank FROM (SELECT key - key % 5 AS target, * FROM mem WHERE key % 5 <> 0)")
def supersession_predecessors(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).withColumn("superseded_by", F.when(F.col("key") % 5 != 0, F.col("key") - F.col("key") % 5))
    return writes.predecessors(m).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH h AS (SELECT doc_id AS key, CASE WHEN doc_id % 10 = 3 THEN doc_id - 3 END AS bumps FROM documents), old AS (SELECT substr(sha256(text), 1, 16) AS id FROM documents WHERE doc_id % 2 = 0)
SELECT substr(sha256(text), 1, 16) AS id, min(doc_id) AS key, 'warm' AS tier, 2 AS importance, 0.5::DOUBLE AS confidence FROM documents JOIN h ON h.key = doc_id WHERE bumps IS NULL AND substr(sha256(text), 1, 16) NOT IN (SELECT id FROM old) GROUP BY 1""")
def observe_inserts(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d)
    hits = m.select("key", F.when(F.col("key") % 10 == 3, F.col("key") - 3).alias("bumps"))
    _, fresh = writes.observe(m.filter("key % 2 = 0"), m, hits)
    return fresh.select("id", "key", "tier", "importance", "confidence")


@query(f"WITH {MEM} SELECT key, recall_count + CASE WHEN key % 10 = 0 AND (key + 3) IN (SELECT doc_id FROM documents) THEN 1 ELSE 0 END AS recall_count FROM mem WHERE key % 2 = 0")
def observe_bumps(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d)
    hits = m.select("key", F.when(F.col("key") % 10 == 3, F.col("key") - 3).alias("bumps"))
    after, _ = writes.observe(m.filter("key % 2 = 0"), m, hits)
    return after.select("key", "recall_count")


_HEAD = f"'[文档] ' || doc_id || '.txt' || chr(10) || '类型: txt' || chr(10) || '大小: ' || octet_length(encode(text)) || ' bytes' || chr(10) || '字符: ' || length(text) || chr(10) || '分块: ' || {_PARTS} || chr(10) || '路径: ' || source || chr(10) || '---' || chr(10) || substr(text, 1, 400)"


@query(f"""SELECT doc_id, 0::BIGINT AS place, 'document' AS memory_type, substr(sha256({_HEAD}), 1, 16) AS id, NULL AS parent_id FROM documents UNION ALL
SELECT doc_id, i + 1, 'document_chunk', substr(sha256('[文档块 ' || (i + 1) || '/' || {_PARTS} || '] ' || doc_id || '.txt' || chr(10) || chr(10) || substr(text, i * 3300 + 1, 3500)), 1, 16), substr(sha256({_HEAD}), 1, 16)
FROM documents, unnest(range(0, {_PARTS})) t(i)""")
def document_ingest(s: SparkSession, d: str) -> DataFrame:
    docs = A.table(s, d, "documents").select("doc_id", F.col("source").alias("namespace"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("txt").alias("kind"), F.col("source").alias("path"), "text")
    return writes.ingest(docs, NOW).select("doc_id", "place", "memory_type", "id", "parent_id")


@query(f"""WITH {MEM} SELECT namespace, key, row_number() OVER (PARTITION BY namespace ORDER BY created_at DESC, id) AS rank FROM mem WHERE key % 3 = 0 AND key % 4 <> 1 QUALIFY rank <= 5""")
def document_list(s: SparkSession, d: str) -> DataFrame:
    i = F.col("key")
    m = A.memories(s, d).withColumn("memory_type", F.when(i % 3 == 0, "document").otherwise("document_chunk")).withColumn("parent_id", F.when(i % 4 == 0, "").when(i % 4 == 1, "p"))
    return writes.documents_list(m, 5).select("namespace", "key", F.col("rank").cast("long").alias("rank"))


def _offered(s: SparkSession, d: str) -> DataFrame:
    i, v = F.col("key") % 12, F.col("v")
    bad = F.when(i == 0, F.transform(v, lambda _: F.lit(0.0))).when(i == 3, F.slice(v, 1, 5)).when(i == 6, F.lit(None).cast("array<double>")).otherwise(F.reverse(v))
    return A.vectors(s, d).filter("key % 3 = 0").select("key", bad.alias("v"), F.col("key").alias("at"))


@query("""SELECT vec_id AS key, CASE WHEN vec_id % 12 = 9 THEN 'replaced' ELSE 'kept' END AS action, round(CASE WHEN vec_id % 12 = 9 THEN embedding[-1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings UNION ALL
SELECT vec_id, CASE WHEN vec_id % 12 = 0 THEN 'refused: norm' ELSE 'refused: dimension' END, CASE vec_id % 12 WHEN 0 THEN 0.0 WHEN 3 THEN round(embedding[1]::DOUBLE, 6) END FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 12 <> 9""")
def vector_upserts(s: SparkSession, d: str) -> DataFrame:
    v = A.vectors(s, d).select("key", "v")
    out = writes.upsert_vectors(v, _offered(s, d), 64)
    return out.select("key", "action", F.round(F.try_element_at("v", F.lit(1)), 6).alias("first"))


@query("SELECT CASE vec_id % 12 WHEN 9 THEN 'used' WHEN 0 THEN 'norm' ELSE 'dimension' END AS reason, count(*) AS n FROM embeddings WHERE vec_id % 3 = 0 GROUP BY 1")
def vector_drop_counts(s: SparkSession, d: str) -> DataFrame:
    return writes.drop_counts(_offered(s, d), 64)


@query("SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 12 = 9)")
def vectors_to_rebuild(s: SparkSession, d: str) -> DataFrame:
    return writes.without_vectors(A.memories(s, d), _offered(s, d), 64).select("key")


# --- evolution ---
@query(f"WITH {MEM} SELECT namespace, key, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS rank FROM mem WHERE evolved_at IS NULL QUALIFY rank <= 50")
def evolve_queue(s: SparkSession, d: str) -> DataFrame:
    return writes.evolve_queue(A.memories(s, d)).select("namespace", "key", F.col("rank").cast("long").alias("rank"))


def _evolving(s: SparkSession, d: str) -> DataFrame:
    old = F.when(F.col("key") % 2 == 0, F.concat(F.lit("was "), "id"))
    return writes.evolve_queue(A.memories(s, d)).drop("rank").withColumn("context", old).withColumn("link_count", F.when(F.col("key") % 2 == 0, F.col("key")))


_QUEUE = f"q AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, id) AS n FROM mem WHERE evolved_at IS NULL QUALIFY n <= 50), l AS (SELECT node, count(*) AS links FROM (SELECT source_id AS node FROM rel UNION ALL SELECT target_id FROM rel WHERE source_id <> target_id) GROUP BY 1)"


@query(f"""WITH {MEM}, {REL}, {_QUEUE} SELECT key, coalesce(links, 0) AS links, {_PROMOTED} AS context, CASE WHEN key % 2 = 0 THEN '{{"evolved_context":"was ' || id || '","link_count":' || key || '}}' ELSE '{{"evolved_context":null,"link_count":null}}' END AS old_value FROM q LEFT JOIN l ON node = key""")
def evolve_batch(s: SparkSession, d: str) -> DataFrame:
    after, log = writes.evolve_batch(_evolving(s, d), graph.link_counts(A.relations(s, d)), NOW)
    return after.select("key", F.col("link_count").alias("links"), "context").join(log.select("key", "old_value"), "key")


@query(f"""WITH {MEM}, {REL}, {_QUEUE} SELECT key, CASE WHEN key % 4 < 2 THEN CASE WHEN key % 2 = 0 THEN 'was ' || id END ELSE {_PROMOTED} END AS context, CASE WHEN key % 4 < 2 THEN CASE WHEN key % 2 = 0 THEN key END ELSE coalesce(links, 0) END AS links,
  '{NOW}' AS evolved_at, CASE WHEN key % 4 < 2 THEN 'rolled_back' ELSE 'auto_promote' END AS change_type FROM q LEFT JOIN l ON node = key""")
def evolve_rollback(s: SparkSession, d: str) -> DataFrame:
    after, log = writes.evolve_batch(_evolving(s, d), graph.link_counts(A.relations(s, d)), NOW)
    back, log = writes.rollback(after, log, after.filter("key % 4 < 2").select("key"))
    return back.select("key", "context", F.col("link_count").alias("links"), "evolved_at").join(log.select("key", "change_type"), "key")


@query("SELECT event_id AS id, event_type AS change_type, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events WHERE event_type IN ('error', 'signup') AND strftime(ts, '%Y-%m-%dT%H:%M:%S') >= '2024-01-03' ORDER BY created_at DESC, id LIMIT 5000")
def evolution_log(s: SparkSession, d: str) -> DataFrame:
    log = A.table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("change_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"))
    return writes.evolution_log(log, ("error", "signup"), "2024-01-03", 100_000)


# --- requests, messages, agents, skills ---
_KINDS = ("write", "search", "profile", "backup", "other")
_LIMITS = {"write": 3, "search": 1, "profile": 2, "backup": 0}


def _requests(s: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 5 + 1).cast("int"))
    return A.table(s, d, "events").select((F.col("user_id") % 3).alias("ns"), kind.alias("kind"), "ts", F.col("event_id").alias("key"))


@query(f"""WITH r AS (SELECT event_id, user_id % 3 AS ns, {list(_KINDS)}[(event_id % 5 + 1)::INT] AS kind, ts FROM events), w AS (SELECT *, CASE kind WHEN 'write' THEN date_trunc('day', ts) WHEN 'backup' THEN date_trunc('hour', ts) WHEN 'other' THEN NULL ELSE date_trunc('minute', ts) END AS start FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY ns, kind, start ORDER BY ts, event_id) AS place FROM w)
SELECT event_id, CASE kind WHEN 'write' THEN place <= 3 WHEN 'search' THEN place <= 1 WHEN 'profile' THEN place <= 2 WHEN 'backup' THEN false ELSE true END AS admitted FROM p""")
def quota_by_kind(s: SparkSession, d: str) -> DataFrame:
    return writes.admit(_requests(s, d), _LIMITS).select(F.col("key").alias("event_id"), "admitted")


@query("""WITH e AS (SELECT event_id, ts, ['consolidate', 'decay', 'dream'][(event_id % 3 + 1)::INT] AS phase, user_id % 2 AS ns FROM events), p AS (SELECT *, lag(ts) OVER (PARTITION BY phase, ns ORDER BY ts, event_id) AS prev FROM e)
SELECT event_id, coalesce(floor(epoch(ts)) - floor(epoch(prev)) >= CASE phase WHEN 'consolidate' THEN 0 WHEN 'decay' THEN 60 ELSE 300 END, true) AS allowed FROM p""")
def phase_cooldown(s: SparkSession, d: str) -> DataFrame:
    phase = F.element_at(F.array(F.lit("consolidate"), F.lit("decay"), F.lit("dream")), (F.col("event_id") % 3 + 1).cast("int"))
    runs = A.table(s, d, "events").select(phase.alias("phase"), (F.col("user_id") % 2).alias("ns"), "ts", F.col("event_id").alias("key"))
    return writes.phase_gate(runs).select(F.col("key").alias("event_id"), "allowed")


def _mail(s: SparkSession, d: str) -> DataFrame:
    c = A.table(s, d, "conversations")
    return writes.send(c.select(F.col("role").alias("sender"), F.col("conv_id").cast("string").alias("to"), F.col("text").alias("content"), F.col("turn").cast("string").alias("created_at")))


_MAIL = "m AS (SELECT substr(sha256(concat_ws('|', role, conv_id::VARCHAR, text, turn::VARCHAR)), 1, 16) AS id, 'agent/' || conv_id AS namespace, conv_id, turn FROM conversations)"


@query(f"WITH {_MAIL} SELECT namespace, count(*) AS n, min(id) AS first FROM m GROUP BY 1")
def mailbox_send(s: SparkSession, d: str) -> DataFrame:
    return _mail(s, d).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query(f"WITH {_MAIL}, t AS (SELECT *, conv_id % 2 = 0 AS own FROM m WHERE turn % 2 = 0) SELECT id, own AS deleted FROM t")
def mailbox_delete(s: SparkSession, d: str) -> DataFrame:
    mail = _mail(s, d).join(A.table(s, d, "conversations").select(T.content_id(F.concat_ws("|", "role", F.col("conv_id").cast("string"), "text", F.col("turn").cast("string"))).alias("id"), "conv_id", "turn"), "id")
    asked = mail.filter("turn % 2 = 0").select(F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).otherwise("x").alias("agent"), "id")
    return writes.delete_messages(mail.drop("conv_id", "turn"), asked)[1].select("id", "deleted")


@query("""WITH e AS (SELECT user_id AS agent_id, event_id AS w, CASE event_type WHEN 'signup' THEN 'register' WHEN 'error' THEN 'revoke' ELSE 'update' END AS kind, CASE WHEN event_id % 2 = 0 THEN 'n' || event_id END AS name, 'r' || event_id % 3 AS role, 'b' || event_id AS badge FROM events),
a AS (SELECT agent_id, arg_max(name, w) FILTER (kind <> 'revoke' AND name IS NOT NULL) AS name, arg_max(role, w) FILTER (kind <> 'revoke') AS role, arg_max(badge, w) FILTER (kind = 'register') AS b, max(w) FILTER (kind = 'register') AS i, max(w) FILTER (kind = 'revoke') AS o FROM e GROUP BY 1)
SELECT agent_id, name, role, CASE WHEN i IS NULL OR o > i THEN '' ELSE b END AS badge, CASE WHEN i IS NULL OR o > i THEN 'revoked' ELSE 'active' END AS status FROM a""")
def agent_states(s: SparkSession, d: str) -> DataFrame:
    i, at = F.col("event_type"), F.col("event_id")
    kind = F.when(i == "signup", "register").when(i == "error", "revoke").otherwise("update")
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return writes.agent_states(A.table(s, d, "events").select(F.col("user_id").alias("agent_id"), at.alias("at"), kind.alias("kind"), F.when(at % 2 == 0, text("n", at)).alias("name"), text("r", at % 3).alias("role"), text("b", at).alias("badge")))


@query("""WITH p AS (SELECT o_custkey AS skill, o_orderstatus AS version, 'a' || o_orderkey % 7 AS author, o_orderkey AS w FROM orders), i AS (SELECT l_suppkey AS skill, count(DISTINCT l_partkey) AS installs FROM lineitem GROUP BY 1)
SELECT skill, arg_max(version, w) AS version, arg_max(author, w) AS author, coalesce(any_value(installs), 0) AS installs FROM p LEFT JOIN i USING (skill) GROUP BY 1""")
def skill_states(s: SparkSession, d: str) -> DataFrame:
    p = A.table(s, d, "orders").select(F.col("o_custkey").alias("skill"), F.col("o_orderstatus").alias("version"), F.concat(F.lit("a"), (F.col("o_orderkey") % 7).cast("string")).alias("author"), F.col("o_orderkey").alias("at"))
    return writes.skill_states(p, A.table(s, d, "lineitem").select(F.col("l_suppkey").alias("skill"), F.col("l_partkey").alias("agent")))


@query(f"WITH {MEM} SELECT 'memories' AS tab, count(*) FILTER (namespace = 'src1') AS moved FROM mem UNION ALL SELECT 'relations', count(*) FILTER (l_suppkey = 1) FROM lineitem UNION ALL SELECT 'prefs', count(*) FILTER (label = 1) FROM embeddings")
def namespace_move_tables(s: SparkSession, d: str) -> DataFrame:
    tables = {"memories": A.memories(s, d), "relations": A.table(s, d, "lineitem").withColumn("namespace", F.concat(F.lit("src"), F.col("l_suppkey").cast("string"))), "prefs": A.vectors(s, d).withColumn("namespace", F.concat(F.lit("src"), F.col("namespace").cast("string")))}
    out = None
    for name, df in lifecycle.move_namespace(tables, "src1", "moved").items():
        one = df.agg(F.count(F.when(F.col("namespace") == "moved", 1)).alias("moved")).select(F.lit(name).alias("tab"), "moved")
        out = one if out is None else out.unionByName(one)
    return out


# --- import and export ---
_LINES = """WITH l AS (SELECT doc_id, doc_id % 9 AS k FROM documents)
SELECT CASE WHEN k = 0 THEN 'parse error' WHEN k = 1 THEN 'missing table' WHEN k = 2 THEN 'missing row' WHEN k = 3 THEN 'unknown table' WHEN k = 4 THEN 'ns mismatch' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'ignored' ELSE 'inserted' END AS action, count(*) AS n FROM l GROUP BY 1"""


@query(_LINES)
def import_report(s: SparkSession, d: str) -> DataFrame:
    k, m = F.col("key") % 9, A.memories(s, d)
    row = F.struct(F.col("key").cast("string").alias("id"), F.when(k == 4, "other").otherwise("src").alias("namespace"), "content")
    good = F.to_json(F.struct(F.when(k == 3, "pets").otherwise("memories").alias("table"), row.alias("row")))
    line = F.when(k == 0, F.lit("{broken")).when(k == 1, F.to_json(F.struct(row.alias("row")))).when(k == 2, F.lit('{"table":"memories"}')).otherwise(good)
    old = {"memories": A.table(s, d, "labels").select(F.col("doc_id").cast("string").alias("id"))}
    return transfer.import_lines(m.select(line.alias("value")), "src", old).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id, octet_length(embedding_bytes) AS chars, dims FROM (SELECT vec_id, (((4 * len(embedding) + 2) // 3) * 4)::BIGINT AS c, len(embedding)::BIGINT AS dims, encode(repeat('x', (((4 * len(embedding) + 2) // 3) * 4)::INT)) AS embedding_bytes FROM embeddings)")
def export_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors as base64 in lines of JSON, and back."""
    v = A.table(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit("src").alias("namespace"), F.col("embedding").alias("vector"), F.lit(NOW).alias("updated_at"))
    lines = transfer.export_lines({"memory_vectors": v}).filter(~F.contains("value", F.lit('"version"')))
    back = lines.select(F.from_json("value", "table string, row struct<id: string, vector: string>").alias("j")).select("j.row.*")
    return back.select(F.col("id").cast("long").alias("vec_id"), F.length("vector").cast("long").alias("chars"), F.size(transfer.bytes_to_vector(F.unbase64("vector"))).cast("long").alias("dims"))


@query("SELECT 'memories' AS tab, count(*) AS n FROM documents UNION ALL SELECT 'memory_vectors', count(*) FROM embeddings UNION ALL SELECT 'memory_relations', count(*) FROM lineitem")
def export_header(s: SparkSession, d: str) -> DataFrame:
    tables = {"memories": A.memories(s, d), "memory_vectors": A.vectors(s, d), "memory_relations": A.table(s, d, "lineitem")}
    told = transfer.header(tables).select(F.from_json("value", "version int, counts map<string, long>").alias("j"))
    return told.select(F.explode("j.counts").alias("tab", "n"))


# --- views ---
_ORDERS = {"importance": "importance DESC", "decay": "decay DESC", "created": "created_at DESC", "tier": "CASE tier WHEN 'hot' THEN 0 WHEN 'warm' THEN 1 WHEN 'cold' THEN 2 ELSE 3 END, importance DESC"}


@query(f"WITH {MEM} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{m}' AS mode, key FROM mem WHERE (contains(content, '12') OR contains(id, '12')) AND importance >= 2 ORDER BY {o}, key LIMIT 40 OFFSET 5)" for m, o in _ORDERS.items()))
def browse_modes(s: SparkSession, d: str) -> DataFrame:
    out = None
    for mode in _ORDERS:
        one = views.browse(A.memories(s, d), mode, like="12", least=2, limit=40, offset=5).select(F.lit(mode).alias("mode"), "key")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {MEM} SELECT i.id, m.namespace, m.tier FROM (SELECT DISTINCT (item_id * 3)::VARCHAR AS id FROM benchmark) i LEFT JOIN mem m USING (id)")
def point_lookup(s: SparkSession, d: str) -> DataFrame:
    ids = A.table(s, d, "benchmark").select((F.col("item_id") * 3).cast("string").alias("id"))
    return views.lookup(A.memories(s, d), ids).select("id", "namespace", "tier")


@query(f"WITH {MEM} SELECT key FROM mem WHERE superseded_by IS NULL AND (valid_from IS NULL OR valid_from <= '2024-01-21T00:00:00') AND (valid_to IS NULL OR valid_to > '2024-01-21T00:00:00')")
def reachable(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).filter(views.reachable("2024-01-21T00:00:00")).select("key")


@query(f"WITH {MEM} SELECT key FROM mem WHERE superseded_by IS NULL AND trim(content) <> '' ORDER BY md5(id || 'seed'), id LIMIT 40")
def sanity_sample(s: SparkSession, d: str) -> DataFrame:
    return views.sample(A.memories(s, d), 40, "seed").select("key")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand NOT LIKE '%3%' GROUP BY 1")
def named_mentions(s: SparkSession, d: str) -> DataFrame:
    """Mentions of entities with a name; brands with a 3 have an empty one."""
    names = A.table(s, d, "part").select(F.col("p_brand").alias("entity"), F.when(F.contains("p_brand", F.lit("3")), "").otherwise(F.col("p_brand")).alias("name")).distinct()
    return graph.named_mentions(A.mentions(s, d), names).groupBy(F.col("memory_id").alias("l_orderkey")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MEM} SELECT event_id, namespace, round(value, 6) AS new_decay FROM events JOIN mem ON key = user_id ORDER BY ts DESC, event_id LIMIT 500")
def decay_log(s: SparkSession, d: str) -> DataFrame:
    log = A.table(s, d, "events").select("event_id", F.col("user_id").alias("key"), "ts", F.round("value", 6).alias("new_decay"))
    return lifecycle.decay_log(log, A.memories(s, d)).orderBy(F.desc("ts"), "event_id").limit(500).select("event_id", "namespace", "new_decay")


@query(f"WITH {VER} SELECT event_id, v.key, v.price FROM events e JOIN ver v ON v.entity = e.event_id AND v.valid_from <= strftime(DATE '1995-01-01' + (event_id % 2400)::INT, '%Y-%m-%dT%H:%M:%S') AND (v.valid_to IS NULL OR v.valid_to >= strftime(DATE '1995-01-01' + (event_id % 2400)::INT, '%Y-%m-%dT%H:%M:%S'))")
def versions_at_events(s: SparkSession, d: str) -> DataFrame:
    """The versions that were valid at each event's own time: a range join within the entity."""
    at = F.date_format(F.date_add(F.lit("1995-01-01"), (F.col("event_id") % 2400).cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    e = A.table(s, d, "events").select("event_id", F.col("event_id").alias("entity"), at.alias("at"))
    return e.join(A.versions(s, d), "entity").filter(valid_at(F.col("valid_from"), F.col("valid_to"), F.col("at"))).select("event_id", "key", "price")


@query(f"""WITH {MEM}, {REL}, b AS (SELECT source_id AS one, target_id AS node, relation_type, weight FROM rel UNION SELECT target_id, source_id, relation_type, weight FROM rel)
SELECT one, count(*) AS n, count(m.key) AS known, max(weight) AS best FROM b LEFT JOIN mem m ON m.key = node GROUP BY 1""")
def edge_neighbours(s: SparkSession, d: str) -> DataFrame:
    near = graph.neighbours(A.relations(s, d)).join(A.memories(s, d).select(F.col("key").alias("node"), "content"), "node", "left")
    return near.groupBy(F.col("at").alias("one")).agg(F.count(F.lit(1)).alias("n"), F.count("content").alias("known"), F.max("weight").alias("best"))


@query(f"""WITH {SIGNALS}, o AS (SELECT *, list_position(['keyword', 'semantic', 'temporal', 'importance', 'category'], channel) AS c FROM sig)
SELECT query_id, key, channel, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY c, rank) AS n FROM o) WHERE n = 1""")
def signal_first_wins(s: SparkSession, d: str) -> DataFrame:
    found = all_signals(_queries(s, d), A.memories(s, d), A.vectors(s, d), Params(NOW))
    return fusion.first_wins(found).select("query_id", "key", "channel", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {SIGNALS}, p AS (SELECT query_id, key, channel, sum(CASE channel WHEN 'category' THEN 0.5 ELSE 1.0 END / (61 + rank)) AS part FROM sig GROUP BY 1, 2, 3)
SELECT query_id, key, string_agg(channel || '=' || round(part * 1000000)::BIGINT, ';' ORDER BY channel) AS parts FROM p GROUP BY 1, 2""")
def rrf_channel_sums(s: SparkSession, d: str) -> DataFrame:
    found = all_signals(_queries(s, d), A.memories(s, d), A.vectors(s, d), Params(NOW))
    told = fusion.channel_sums(found).select("query_id", "key", F.explode("channels").alias("channel", "part"))
    text = F.concat("channel", F.lit("="), F.round(F.col("part") * 1_000_000).cast("long").cast("string"))
    return told.groupBy("query_id", "key").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("parts"))


_SIGNAL_DATES = ONCE(f"list_concat({_DATES}, [occurred])")


@query(f"""WITH {MEM}, {MEN}, e AS (SELECT memory_id AS key, string_agg(entity, '|' ORDER BY entity) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY entity) AS n FROM (SELECT DISTINCT entity, memory_id FROM men)) WHERE n <= 16 GROUP BY 1),
m AS (SELECT *, CASE key % 4 WHEN 0 THEN '2023-05-0' || (1 + key % 9) WHEN 1 THEN '2022-11-05' ELSE valid_from END AS occurred, key // 10 AS query_id, key % 10 + 1 AS index FROM mem)
SELECT query_id, index, key, category AS type, occurred, valid_from AS mentioned, namespace || ':' || key AS source_ref, coalesce(entities, '') AS entities, array_to_string(({FOUND('content')})[1:8], '|') AS numbers,
  array_to_string(({_SIGNAL_DATES})[1:4], '|') AS dates, array_to_string(({_MARKERS})[1:4], '|') AS markers, evolved_at IS NULL AS pending_evolution FROM m LEFT JOIN e USING (key)""")
def ledger_rows(s: SparkSession, d: str) -> DataFrame:
    i = F.col("key")
    m = A.memories(s, d).withColumn("tags", F.when(i % 4 == 0, F.array_append("tags", F.concat(F.lit("occurred:2023-05-0"), (1 + i % 9).cast("string")))).otherwise(F.col("tags")))
    m = m.withColumn("event_time", F.when(i % 4 < 2, "2022-11-05 11:00").when(i % 4 == 2, "2024-13-99").otherwise("soon"))
    results = m.select(F.floor(i / 10).alias("query_id"), (i % 10 + 1).alias("rank"), "key")
    out = views.ledger(results, m, A.mentions(s, d).select(F.col("memory_id").alias("key"), "entity"), NOW)
    text = lambda c: F.array_join(c, "|")
    return out.select("query_id", "index", "key", "type", "occurred", "mentioned", "source_ref", text("entities").alias("entities"), text("signals.numbers").alias("numbers"), text("signals.dates").alias("dates"), text("signals.update_markers").alias("markers"), "pending_evolution")


@query(f"""WITH {MEM}, st AS (SELECT namespace, string_agg('- [' || category || '] ' || id || chr(10), '' ORDER BY importance DESC, key) AS t FROM mem WHERE category = 'preference' AND key % 3 = 1 GROUP BY 1),
dy AS (SELECT namespace, string_agg('- [' || category || '] ' || id || chr(10), '' ORDER BY importance DESC, key) AS t FROM mem WHERE category = 'fact' GROUP BY 1),
re AS (SELECT namespace, string_agg('- ' || id || chr(10), '' ORDER BY key) AS t FROM mem WHERE key % 50 = 0 GROUP BY 1), ns AS (SELECT namespace FROM st UNION SELECT namespace FROM dy UNION SELECT namespace FROM re)
SELECT namespace, '## 稳定偏好' || chr(10) || coalesce(st.t, '（无）') || chr(10) || '## 近期动态' || chr(10) || coalesce(dy.t, '（无）') || coalesce(chr(10) || '## 相关回忆' || chr(10) || re.t, '') AS prompt
FROM ns LEFT JOIN st USING (namespace) LEFT JOIN dy USING (namespace) LEFT JOIN re USING (namespace)""")
def context_prompts(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).withColumn("content", F.col("id")).withColumn("kind", F.col("category")).withColumn("n", F.struct((-F.col("importance")).alias("i"), "key"))
    a, b = m.filter("category = 'preference' and key % 3 = 1").withColumn("part", F.lit("static")), m.filter("category = 'fact'").withColumn("part", F.lit("dynamic"))
    return views.context(a.unionByName(b), m.filter("key % 50 = 0").withColumn("rank", F.col("key")))


@query("""WITH m AS (SELECT p_brand AS entity, l_orderkey AS memory_id, l_orderkey * 10 + l_linenumber AS id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 10), r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY id DESC) AS n FROM m)
SELECT entity, count(memory_id) AS mentions, coalesce(string_agg(memory_id::VARCHAR, ',' ORDER BY n), '') AS ids FROM (SELECT DISTINCT p_brand AS entity FROM part) LEFT JOIN (SELECT * FROM r WHERE n <= 20) USING (entity) GROUP BY 1""")
def graph_export_nodes(s: SparkSession, d: str) -> DataFrame:
    li, p = A.table(s, d, "lineitem").filter("l_quantity > 10"), A.table(s, d, "part")
    m = li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("entity"), F.col("l_orderkey").alias("memory_id"), F.col("p_type").alias("context"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    out = views.export_nodes(p.select(F.col("p_brand").alias("entity")).distinct(), m)
    return out.select("entity", F.size("mentions").cast("long").alias("mentions"), F.array_join(F.transform("mentions", lambda x: x["memory_id"].cast("string")), ",").alias("ids"))


@query(f"""WITH {MEM}, seeds AS (SELECT namespace, key, row_number() OVER (PARTITION BY namespace ORDER BY importance DESC, key) AS n FROM mem QUALIFY n <= 100),
e AS (SELECT l_orderkey AS s, l_partkey AS t, l_returnflag AS relation_type, l_discount * 10 AS w FROM lineitem),
u AS (SELECT a.namespace, least(s, t) AS a, greatest(s, t) AS b, relation_type, round(least(1.0, greatest(0.05, max(w))), 2) AS weight FROM e JOIN seeds a ON a.key = s JOIN seeds b ON b.key = t AND b.namespace = a.namespace WHERE s <> t GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY weight DESC, a, b, relation_type) AS rank FROM u), c AS (SELECT namespace, count(*) AS nodes FROM seeds GROUP BY 1)
SELECT namespace, a, b, relation_type, weight, rank FROM r JOIN c USING (namespace) WHERE rank <= 3 * nodes""")
def dashboard_graph(s: SparkSession, d: str) -> DataFrame:
    nodes = lifecycle.newest(A.memories(s, d), "namespace", 100, F.desc("importance"), F.col("key")).select("namespace", "key", "content")
    e = A.table(s, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("relation_type"), (F.col("l_discount") * 10).alias("weight"))
    return views.drawn_graph(nodes, e).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(c, 6) DESC, b) AS n FROM s), e AS (SELECT a, b, round(c, 2) AS weight FROM r WHERE n <= 8 AND c >= 0.3), u AS (SELECT a, b, weight FROM e UNION SELECT b, a, weight FROM e)
SELECT a AS node, string_agg(b::VARCHAR, ',' ORDER BY weight DESC, b) AS neighbours FROM u GROUP BY 1""")
def neighbour_lists(s: SparkSession, d: str) -> DataFrame:
    out = views.neighbourhoods(vector.knn_edges(A.vectors(s, d), k=12, least=0.3, same=["namespace"]))
    return out.select("node", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), ",").alias("neighbours"))


# --- search with its options ---
_AS_OF = "2024-01-15T00:00:00"
_SCORED_AS_OF = SCORED.replace(f"WHERE superseded_by IS NULL AND {VALID}", f"WHERE {VALID.replace(NOW, _AS_OF)}")


@query(f"""WITH {_SCORED_AS_OF}, res AS (SELECT DISTINCT query_id, key, 1 AS r FROM sig WHERE channel IN ('keyword', 'semantic') AND rank < 50),
fin AS (SELECT query_id, key, score, coalesce(r, 0) AS reserved, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(r, 0) DESC, round(score, 6) DESC, key) AS rank FROM scored LEFT JOIN res USING (query_id, key))
SELECT query_id, rank, key, round(score, 6) AS score, reserved, 'as_of' AS time_status, evolved_at IS NULL AS pending, list_contains(tags, 'pref') AS tagged FROM fin JOIN mem USING (key) WHERE rank <= 10""")
def hybrid_search_as_of(s: SparkSession, d: str) -> DataFrame:
    """As of a time, with the mark of rows that wait for evolution, and whether a row has the asked tag (which is looked at after the limit)."""
    m = A.memories(s, d)
    out = hybrid_search(_queries(s, d), m, A.vectors(s, d), Params(NOW, as_of=_AS_OF)).join(m.select("key", F.array_contains("tags", "pref").alias("tagged")), "key")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 6).alias("score"), F.col("reserved").cast("int").alias("reserved"), "time_status", "pending", "tagged")


_BOOSTED = SCORED.replace("rrf + least(0.05,", "rrf + coalesce(boost, 0) + least(0.05,").replace("JOIN qry q USING (query_id) WHERE", "JOIN qry q USING (query_id) LEFT JOIN boosts b ON b.query_id = f.query_id AND b.key = f.key WHERE").replace("SELECT query_id, f.key, sem", "SELECT f.query_id, f.key, sem").replace(", kept AS (", f""", men AS (SELECT doc_id AS key, lang AS entity FROM documents), cur AS (SELECT query_id, key FROM fused JOIN mem USING (key) WHERE superseded_by IS NULL AND {VALID}),
own AS (SELECT query_id, key, entity FROM cur JOIN men USING (key)), sh AS (SELECT query_id, entity, count(DISTINCT key) - 1 AS others FROM own GROUP BY 1, 2), per AS (SELECT query_id, key, 0.012 * sum(CASE WHEN entity = 'en' THEN 1 ELSE 0 END) + 0.004 * sum(others) AS b FROM own JOIN sh USING (query_id, entity) GROUP BY 1, 2),
cn AS (SELECT query_id, count(*) AS n FROM cur GROUP BY 1), boosts AS (SELECT query_id, key, CASE WHEN n > 1 THEN least(0.06, b) ELSE 0 END::DOUBLE AS boost FROM per JOIN cn USING (query_id)), kept AS (""", 1)


@query(f"""WITH {_BOOSTED}, res AS (SELECT DISTINCT query_id, key, 1 AS r FROM sig WHERE channel IN ('keyword', 'semantic') AND rank < 50),
fin AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(r, 0) DESC, round(score, 6) DESC, key) AS rank FROM scored LEFT JOIN res USING (query_id, key))
SELECT query_id, rank, key, round(score, 6) AS score FROM fin WHERE rank <= 10""")
def hybrid_search_cooccur(s: SparkSession, d: str) -> DataFrame:
    """With the co-occurrence boost: a document's language is the entity that it mentions, English what every query names."""
    q = _queries(s, d)
    men = A.table(s, d, "documents").select(F.col("doc_id").alias("memory_id"), F.col("lang").alias("entity"))
    out = hybrid_search(q, A.memories(s, d), A.vectors(s, d), Params(NOW), mentions=men, named=q.select("query_id", F.lit("en").alias("entity")))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 6).alias("score"))


@query(f"""WITH {SCORED}, res AS (SELECT DISTINCT query_id, key, 1 AS r FROM sig WHERE channel IN ('keyword', 'semantic') AND rank < 50),
fin AS (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(r, 0) DESC, round(score, 6) DESC, key) AS rank FROM scored LEFT JOIN res USING (query_id, key))
SELECT query_id, rank, key, round(score, 6) AS score FROM fin JOIN mem USING (key) WHERE rank <= 10 AND list_contains(tags, 'pref')""")
def hybrid_search_tags(s: SparkSession, d: str) -> DataFrame:
    """Only rows with a tag, which is looked at after the limit."""
    out = hybrid_search(_queries(s, d), A.memories(s, d), A.vectors(s, d), Params(NOW, tags=("pref",)))
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "key", F.round("score", 6).alias("score"))


@query(f"""WITH {MEM}, c AS (SELECT user_id AS key, arg_max(value, event_id) AS importance, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS category FROM events GROUP BY 1)
SELECT key, round(coalesce(c.importance, m.importance), 6) AS importance, coalesce(c.category, m.category) AS category FROM mem m LEFT JOIN c USING (key)""")
def memory_updates(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("at"), F.col("value").alias("importance"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("category"))
    return lifecycle.update(A.memories(s, d), e).select("key", F.round("importance", 6).alias("importance"), "category")


@query("SELECT vec_id AS key FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def delete_vectors(s: SparkSession, d: str) -> DataFrame:
    gone = A.table(s, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("key"))
    return lifecycle.delete_vectors(A.vectors(s, d), gone).select("key")
