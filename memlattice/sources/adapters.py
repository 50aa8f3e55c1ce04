"""Engine tables from the driver's tables: memories, vectors, entities, versions, queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATEGORIES = ("fact", "preference", "decision", "pattern", "observation", "event")
TIERS = ("hot", "warm", "cold")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: tuple[str, ...], by: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.expr(by) + 1).cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memories(id, key, namespace, content, category, importance, decay, tier, recall_count, created_at, ...) from documents."""
    d = table(spark, sf_dir, "documents")
    stamp = lambda days: F.date_format(F.date_add(F.lit("2024-01-01"), days.cast("int")), "yyyy-MM-dd'T'00:00:00")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"),
        i.alias("key"),
        F.col("source").alias("namespace"),
        F.col("text").alias("content"),
        _pick(CATEGORIES, "doc_id % 6").alias("category"),
        (1 + i % 5).cast("double").alias("importance"),
        (1 - (i % 10) / 20).alias("decay"),
        _pick(TIERS, "doc_id % 3").alias("tier"),
        (i % 7).alias("recall_count"),
        stamp(i % 30).alias("created_at"),
        F.when(i % 8 == 0, stamp(i % 30 + 15)).alias("last_recalled"),
        stamp(i % 30).alias("valid_from"),
        F.when(i % 4 == 0, stamp(i % 30 + 20)).alias("valid_to"),
        F.when(i % 9 == 0, (i + 1).cast("string")).alias("superseded_by"),
        F.when(i % 5 == 0, F.array(F.lit("pref"))).when(i % 7 == 0, F.array(F.lit("hard_rule"), F.lit("pref"))).when(i % 11 == 0, F.array(F.lit("insight"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(i % 3 == 0, stamp(i % 30 + 1)).alias("evolved_at"),
    )


#: The same table in SQL, for the oracles.
MEMORIES_SQL = """mem AS (
  SELECT doc_id::VARCHAR AS id, doc_id AS key, source AS namespace, text AS content,
    ['fact','preference','decision','pattern','observation','event'][(doc_id % 6 + 1)::INT] AS category,
    (1 + doc_id % 5)::DOUBLE AS importance, 1 - (doc_id % 10) / 20.0::DOUBLE AS decay, ['hot','warm','cold'][(doc_id % 3 + 1)::INT] AS tier,
    doc_id % 7 AS recall_count, strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%dT00:00:00') AS created_at,
    CASE WHEN doc_id % 8 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 30 + 15)::INT, '%Y-%m-%dT00:00:00') END AS last_recalled,
    strftime(DATE '2024-01-01' + (doc_id % 30)::INT, '%Y-%m-%dT00:00:00') AS valid_from,
    CASE WHEN doc_id % 4 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 30 + 20)::INT, '%Y-%m-%dT00:00:00') END AS valid_to,
    CASE WHEN doc_id % 9 = 0 THEN (doc_id + 1)::VARCHAR END AS superseded_by,
    CASE WHEN doc_id % 5 = 0 THEN ['pref'] WHEN doc_id % 7 = 0 THEN ['hard_rule','pref'] WHEN doc_id % 11 = 0 THEN ['insight'] ELSE []::VARCHAR[] END AS tags,
    CASE WHEN doc_id % 3 = 0 THEN strftime(DATE '2024-01-01' + (doc_id % 30 + 1)::INT, '%Y-%m-%dT00:00:00') END AS evolved_at
  FROM documents)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("namespace"))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each benchmark item: its whole text and the vector of the same number."""
    b = table(spark, sf_dir, "benchmark")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("v"))
    return b.select("item_id", F.lower("text").alias("text")).join(e, "item_id", "left").withColumnRenamed("item_id", "query_id")


QUERIES_SQL = """qry AS (
  SELECT item_id AS query_id, lower(b.text) AS text, e.embedding::DOUBLE[] AS v
  FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as versions of one fact: each is valid until the next begins."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("entity"), stamp(F.col("o_orderdate")).alias("valid_from"), stamp(F.lead("o_orderdate").over(w)).alias("valid_to"), F.lead("o_orderkey").over(w).alias("superseded_by"), F.col("o_totalprice").alias("price"))


VERSIONS_SQL = """ver AS (
  SELECT o_orderkey AS key, o_custkey AS entity, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS valid_from,
    strftime(lead(o_orderdate) OVER w, '%Y-%m-%dT%H:%M:%S') AS valid_to, lead(o_orderkey) OVER w AS superseded_by, o_totalprice AS price
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation from each order to each of its parts, ids as they are, with a type and a weight."""
    kinds = ("updates", "extends", "derives", "semantic_related", "same_entity")
    kind, weight = _pick(kinds, "l_linenumber % 5").alias("relation_type"), F.round(F.col("l_discount") * 10, 2).alias("weight")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("target_id"), kind, weight).distinct()


RELATIONS_SQL = """rel AS (
  SELECT DISTINCT l_orderkey AS source_id, l_partkey AS target_id,
    ['updates','extends','derives','semantic_related','same_entity'][(l_linenumber % 5 + 1)::INT] AS relation_type, round(l_discount * 10, 2) AS weight FROM lineitem)"""


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity (a part's brand) is mentioned by a memory (an order) that has a part of it."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("entity"), F.col("l_orderkey").alias("memory_id"), F.col("l_linenumber").alias("n"))


MENTIONS_SQL = """men AS (SELECT p_brand AS entity, l_orderkey AS memory_id, l_linenumber AS n FROM lineitem JOIN part ON l_partkey = p_partkey)"""
