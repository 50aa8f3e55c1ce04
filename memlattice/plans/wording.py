"""Queries of the text functions over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import adapters as A
from ..sources import transfer
from .catalog import FOUND, MEM, ONCE, WORDS, query


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_MARKERS = f"list_filter({_sql_list(T.UPDATE_MARKERS)}, lambda m: contains(lower(content), m))"
_DATES = ONCE("list_transform(regexp_extract_all(content, '([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})', 1), lambda d: replace(d, '/', '-'))")
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS id FROM documents")
def content_ids(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "documents").select("doc_id", T.content_id(F.col("text")).alias("id"))


@query(f"WITH {MEM} SELECT key, array_to_string({_MARKERS}, '|') AS markers FROM mem")
def update_markers(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).select("key", F.array_join(T.update_markers(F.col("content")), "|").alias("markers"))


@query(f"""WITH {MEM} SELECT key, array_to_string(list_concat(list_concat(tags, list_transform(({FOUND("content")})[1:8], lambda x: 'signal:num:' || x)),
  list_concat(list_transform(({_DATES})[1:4], lambda x: 'signal:date:' || x), list_transform(({_MARKERS})[1:4], lambda x: 'signal:update:' || x))), '|') AS tags FROM mem""")
def signal_tags(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).select("key", F.array_join(T.signal_tags(F.col("tags"), F.col("content")), "|").alias("tags"))


@query("SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN strftime(ts, '%Y-%m-%d') ELSE '' END AS occurred FROM events")
def occurred_dates(s: SparkSession, d: str) -> DataFrame:
    tag = F.when(F.col("event_type").isin("error", "signup"), F.concat(F.lit("occurred:"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm"))).otherwise(F.concat(F.lit("occurred:"), "event_type"))
    return A.table(s, d, "events").select("event_id", T.occurred(F.array(F.lit("plain"), tag)).alias("occurred"))


@query("SELECT l_orderkey, l_linenumber, ['updates', 'extends', 'derives', 'updates', NULL][(l_linenumber % 5 + 1)::INT] AS relation, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def relation_names(s: SparkSession, d: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Update", " extends", "DERIVE ", None, "banana"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    return A.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber", T.memory_relation(said).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, ['keyword', 'keyword', 'semantic', 'category', event_type][(user_id % 5 + 1)::INT] AS channel, count(*) AS n FROM events GROUP BY 1, 2")
def source_channels(s: SparkSession, d: str) -> DataFrame:
    source = F.element_at(F.array(F.lit("fts_keyword;semantic"), F.lit("like_road"), F.lit("ann_semantic;temporal"), F.lit("by_category"), F.col("event_type")), (F.col("user_id") % 5 + 1).cast("int"))
    return A.table(s, d, "events").groupBy("event_type", T.channel_of(source).alias("channel")).agg(F.count(F.lit(1)).alias("n"))


_PARTS = "(greatest(ceil((length(text) - 3500) / 3300.0), 0)::BIGINT + 1)"


@query(f"""SELECT doc_id, substr(sha256('[文档] ' || doc_id || '.txt' || chr(10) || '类型: txt' || chr(10) || '大小: ' || octet_length(encode(text)) || ' bytes' || chr(10) || '字符: ' || length(text)
  || chr(10) || '分块: ' || {_PARTS} || chr(10) || '路径: ' || source || chr(10) || '---' || chr(10) || substr(text, 1, 400)), 1, 16) AS id FROM documents""")
def document_manifests(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    body = T.manifest(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.lit("txt"), F.octet_length(t), t, F.col("source"))
    return A.table(s, d, "documents").select("doc_id", T.content_id(body).alias("id"))


@query(f"""SELECT doc_id, i + 1 AS place, substr(sha256('[文档块 ' || (i + 1) || '/' || {_PARTS} || '] ' || doc_id || '.txt' || chr(10) || chr(10) || substr(text, i * 3300 + 1, 3500)), 1, 16) AS id
FROM documents, unnest(range(0, {_PARTS})) t(i)""")
def document_chunks(s: SparkSession, d: str) -> DataFrame:
    parts = T.chunk_text(F.col("text"))
    out = A.table(s, d, "documents").select("doc_id", F.size(parts).alias("total"), F.posexplode(parts).alias("i", "c"))
    body = T.chunk_body(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")), F.col("i") + 1, F.col("total"), F.col("c"))
    return out.select("doc_id", (F.col("i") + 1).cast("long").alias("place"), T.content_id(body).alias("id"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]', '_', 'g') AS file, regexp_replace(regexp_replace(url, '[/\\\\]', '_', 'g'), '[^A-Za-z0-9._-]', '', 'g') AS folder,
  CASE WHEN page_id % 3 = 0 THEN 'xlsx' WHEN page_id % 3 = 1 THEN 'pdf' END AS kind FROM pages""")
def file_names(s: SparkSession, d: str) -> DataFrame:
    url, i = F.col("url"), F.col("page_id") % 3
    kind = T.detect_kind(F.concat(url, F.when(i == 0, ".XLSX").otherwise("")), F.when(i == 1, T.KINDS["pdf"]).otherwise("text/html"))
    return A.table(s, d, "pages").select("page_id", T.safe_filename(url).alias("file"), T.ns_folder(url).alias("folder"), kind.alias("kind"))


@query(f"SELECT doc_id, '[auto-promoted] ' || CASE WHEN t = '' THEN '(no content)' WHEN length(t) > 120 THEN substr(t, 1, 120) || '…' ELSE t END AS context FROM (SELECT doc_id, {_TRIM.format('text')} AS t FROM documents)")
def evolved_contexts(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "documents").select("doc_id", T.evolved_context(F.col("text")).alias("context"))


@query("SELECT doc_id, " + " || ".join(f"CASE WHEN regexp_matches(lower(text), '{'|'.join(words)}') THEN '{name}: {T.NOTES[name]}|' ELSE '' END" for name, words in T.ADVICE.items()) + " AS advice FROM documents")
def guardrail_notes(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "documents").select("doc_id", F.array_join(F.transform(T.guardrail_notes(F.col("text")), lambda n: F.concat(n, F.lit("|"))), "").alias("advice"))


@query("""SELECT event_id, '{"kind": "' || event_type || '", "user_token": "' || CASE WHEN length(event_type) > 4 THEN substr(event_type, 1, 4) ELSE '' END || '****", "p": ' || props || '}' AS params FROM events""")
def masked_params(s: SparkSession, d: str) -> DataFrame:
    raw = F.format_string('{"kind": "%s", "user_token": "%s", "p": %s}', "event_type", "event_type", "props")
    return A.table(s, d, "events").select("event_id", T.mask_secrets(raw).alias("params"))


_LATIN, _HAN = "abcdefghijklmnopqrstuvwxyz", "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥金木水火"


@query(f"""WITH w AS (SELECT p_partkey, unnest(regexp_split_to_array(translate(p_name, '{_LATIN}', '{_HAN}'), '[^一-鿿]+')) AS w FROM part),
g AS (SELECT DISTINCT p_partkey, substr(w, i, n) AS g FROM w, (VALUES (2), (3), (4)) k(n), unnest(range(1, 40)) t(i) WHERE i + n - 1 <= length(w))
SELECT p_partkey, count(*) AS n, min(g) AS first FROM g GROUP BY 1""")
def han_shingles(s: SparkSession, d: str) -> DataFrame:
    grams = A.table(s, d, "part").select("p_partkey", F.explode(T.cjk_shingles(F.translate("p_name", _LATIN, _HAN))).alias("g"))
    return grams.groupBy("p_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("first"))


@query("SELECT page_id, CASE WHEN regexp_extract(url, '([^/#]*)$', 1) = '' THEN url ELSE regexp_extract(url, '([^/#]*)$', 1) END AS name, regexp_replace(url, '[/#]+$', '') AS iri FROM pages")
def local_names(s: SparkSession, d: str) -> DataFrame:
    return A.table(s, d, "pages").select("page_id", T.local_name(F.col("url")).alias("name"), T.normal_iri(F.col("url")).alias("iri"))


@query(f"WITH {MEM} SELECT key, CASE WHEN len(tags) > 0 THEN array_to_string(tags[1:8], ' ') ELSE substr(regexp_replace({_TRIM.format('content')}, '\\s+', ' ', 'g'), 1, 40) END AS asked FROM mem")
def keyword_queries(s: SparkSession, d: str) -> DataFrame:
    return A.memories(s, d).select("key", T.keyword_query(F.col("content"), F.col("tags")).alias("asked"))


def _case(table: dict, column: str, other: object) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in table.items()) + f" ELSE {other!r} END"


@query(f"""WITH {MEM} SELECT key, CASE WHEN length(content) > 60 THEN substr(content, 1, 60) || '...' ELSE content END AS label, {_case(T.COLOURS, "category", T.GREY)} AS colour,
  {_case(T.SIZES, "tier", T.SMALL)} AS size, round(0.3::DOUBLE + 0.7::DOUBLE * decay, 6) AS opacity FROM mem""")
def node_looks(s: SparkSession, d: str) -> DataFrame:
    m = A.memories(s, d).withColumn("look", T.node_look(F.col("content"), F.col("category"), F.col("tier"), F.col("decay")))
    return m.select("key", "look.label", "look.colour", "look.size", F.round("look.opacity", 6).alias("opacity"))


@query(f"""WITH t AS (SELECT doc_id, unnest({WORDS("text")}) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY 1, 2)
SELECT doc_id, sum(n)::BIGINT AS tokens, count(*) AS terms, max(n) AS most FROM c GROUP BY 1""")
def token_frequencies(s: SparkSession, d: str) -> DataFrame:
    terms = A.table(s, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return terms.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("terms"), F.max("n").alias("most"))


@query("SELECT vec_id, (4 * len(embedding))::BIGINT AS bytes, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def vector_blobs(s: SparkSession, d: str) -> DataFrame:
    e = A.table(s, d, "embeddings").withColumn("b", transfer.vector_to_bytes(F.col("embedding")))
    back = F.aggregate(transfer.bytes_to_vector(F.col("b")).cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.octet_length("b").cast("long").alias("bytes"), F.round(back, 6).alias("total"))


@query("SELECT conv_id, turn, text AS content FROM conversations WHERE role IN ('user', 'human') AND trim(text) <> ''")
def dialog_lines(s: SparkSession, d: str) -> DataFrame:
    lines = A.table(s, d, "conversations").select(F.to_json(F.struct("role", F.to_json(F.struct("conv_id", "turn", "text")).alias("content"))).alias("value"))
    j = F.from_json("content", "conv_id long, turn long, text string")
    return transfer.dialog(lines).select(j.alias("j")).select("j.conv_id", "j.turn", F.col("j.text").alias("content")).filter(F.trim("content") != "")


@query("""SELECT 'http://x/d' || doc_id AS s, CASE WHEN quality = 1 THEN 'part_of' ELSE 'supersedes' END AS p, 'http://x/t' || toxic AS o FROM labels""")
def turtle_triples(s: SparkSession, d: str) -> DataFrame:
    text = F.format_string('@prefix x: <http://x/> .\nx:d%s a x:Doc ; x:%s x:t%s ; x:label "no" . # end', F.col("doc_id").cast("string"), F.when(F.col("quality") == 1, "partOf").otherwise("supersedes"), F.col("toxic").cast("string"))
    return transfer.triples(A.table(s, d, "labels").select(text.alias("value")), ("http://x/",))
