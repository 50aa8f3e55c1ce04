"""What is shown of the store: lists, samples, ledger rows, prompt context, exported and drawn graphs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import jaccard_pairs


def browse(memories: DataFrame, mode: str = "importance", tier: str | None = None, category: str | None = None, like: str | None = None, least: float | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of memories: by tier, category, text in content or id, and least importance (held between 1 and 5); sorted by importance, decay,
    created (newest first) or tier (hot, warm, cold, others)."""
    rows = memories
    if tier:
        rows = rows.filter(F.col("tier") == tier)
    if category:
        rows = rows.filter(F.col("category") == category)
    if like:
        rows = rows.filter(F.contains("content", F.lit(like)) | F.contains("id", F.lit(like)))
    if least is not None:
        rows = rows.filter(F.col("importance") >= min(max(least, 1), 5))
    place = F.when(F.col("tier") == "hot", 0).when(F.col("tier") == "warm", 1).when(F.col("tier") == "cold", 2).otherwise(3)
    order = {"importance": [F.desc("importance")], "decay": [F.desc("decay")], "created": [F.desc("created_at")], "tier": [place, F.desc("importance")]}[mode]
    return rows.orderBy(*order, "key").offset(offset).limit(limit)


def lookup(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(id) with their memories; those that aren't there come with nulls."""
    return ids.select("id").distinct().join(memories, "id", "left")


def reachable(now: str) -> Column:
    """Not superseded, begun and not ended."""
    return F.col("superseded_by").isNull() & F.coalesce(F.col("valid_from") <= now, F.lit(True)) & F.coalesce(F.col("valid_to") > now, F.lit(True))


def sample(memories: DataFrame, n: int, seed: str) -> DataFrame:
    """n live memories with content, in the order of a hash of seed and id: the same ones each time."""
    live = memories.filter(F.col("superseded_by").isNull() & (F.trim("content") != ""))
    return live.withColumn("_h", F.md5(F.concat("id", F.lit(seed)))).orderBy("_h", "id").limit(n).drop("_h")


def ledger(results: DataFrame, memories: DataFrame, mentions: DataFrame, now: str, entities: int = 16) -> DataFrame:
    """results(query_id, rank, key) with what a ledger says of each: index, type, occurred (tag, then the old event time, then valid_from),
    mentioned, source_ref, entities, signals and whether it waits for evolution. memories may have event_time; mentions(key, entity)."""
    legacy = F.col("event_time") if "event_time" in memories.columns else F.lit(None).cast("string")
    day = F.regexp_extract(legacy, "^([0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01]))", 1)
    occurred = F.coalesce(F.nullif(T.occurred(F.col("tags")), F.lit("")), F.nullif(day, F.lit("")), F.col("valid_from"))
    first = Window.partitionBy("key").orderBy("entity")
    named = mentions.select("key", "entity").distinct().withColumn("n", F.row_number().over(first)).filter(F.col("n") <= entities).groupBy("key").agg(F.array_sort(F.collect_list("entity")).alias("entities"))
    rows = results.select("query_id", "rank", "key").join(memories, "key").join(named, "key", "left").withColumn("occurred", occurred)
    return rows.select(
        "query_id", F.col("rank").alias("index"), "key", "content", F.col("category").alias("type"), "occurred", F.col("valid_from").alias("mentioned"), F.concat("namespace", F.lit(":"), F.col("key").cast("string")).alias("source_ref"),
        F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), T.text_signals(F.col("content"), F.col("tags"), F.col("occurred"), now).alias("signals"), F.col("evolved_at").isNull().alias("pending_evolution"), F.lit(True).alias("is_latest"),
    )


def context(profile: DataFrame, recall: DataFrame) -> DataFrame:
    """(namespace, prompt): profile(namespace, part, kind, content, n) and recall(namespace, content, rank) as one text, in the order of n and rank.

    A part without rows says so; without recalled rows their heading is left out.
    """
    lines = lambda df, line, n: df.groupBy("namespace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n, line.alias("line")))), lambda x: x["line"]), "").alias("lines"))
    item = F.concat(F.lit("- ["), "kind", F.lit("] "), "content", F.lit("\n"))
    out = profile.select("namespace").union(recall.select("namespace")).distinct()
    text = None
    for part, title in (("static", "## 稳定偏好\n"), ("dynamic", "## 近期动态\n")):
        out = out.join(lines(profile.filter(F.col("part") == part), item, "n").withColumnRenamed("lines", part), "namespace", "left")
        block = F.concat(F.lit(title), F.coalesce(part, F.lit("（无）")))
        text = block if text is None else F.concat(text, F.lit("\n"), block)
    out = out.join(lines(recall, F.concat(F.lit("- "), "content", F.lit("\n")), "rank").withColumnRenamed("lines", "recalled"), "namespace", "left")
    return out.select("namespace", F.concat(text, F.coalesce(F.concat(F.lit("\n## 相关回忆\n"), "recalled"), F.lit(""))).alias("prompt"))


def score_by(results: DataFrame, texts: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series], pool: int = 100) -> DataFrame:
    """results(query_id, key, rank) reordered by a function of (query, content), called with Arrow batches on the first `pool` of a query.

    texts has (query_id, key, q_text, content). Rows without a score get 0; ties keep their rank.
    """

    def run(q: pd.Series, c: pd.Series) -> pd.Series:
        return scorer(q, c).astype(float)

    scored = results.filter(F.col("rank") <= pool).join(texts, ["query_id", "key"]).withColumn("cross", F.coalesce(F.nanvl(F.pandas_udf(run, "double")("q_text", "content"), F.lit(0.0)), F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("cross"), "rank")
    return scored.withColumn("rank", F.row_number().over(w)).select("query_id", "key", "rank", "cross")


def export_nodes(entities: DataFrame, mentions: DataFrame, most: int = 20) -> DataFrame:
    """entities(entity, ...) with their last `most` mentions(entity, memory_id, context, id), newest first."""
    w = Window.partitionBy("entity").orderBy(F.desc("id"))
    last = mentions.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    held = last.groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "memory_id", "context"))), lambda x: F.struct(x["memory_id"].alias("memory_id"), x["context"].alias("context"))).alias("mentions"))
    return entities.join(held, "entity", "left").withColumn("mentions", F.coalesce("mentions", F.array().cast(held.schema["mentions"].dataType)))


def drawn_graph(nodes: DataFrame, relations: DataFrame, fallback: int = 20, least: float = 0.2) -> DataFrame:
    """(namespace, a, b, relation_type, weight, rank): edges to draw between nodes(namespace, key, content).

    Relations with both ends among a namespace's nodes, one for each pair of ends and type with the largest weight (held between .05 and 1). Where
    a namespace has fewer than `fallback` of them, pairs whose Chinese shingles have a Jaccard similarity of `least` join as `keyword`.
    Heaviest first, three for each node at most.
    """
    side = lambda c: nodes.select("namespace", F.col("key").alias(c))
    inner = relations.filter("source_id <> target_id").join(side("source_id"), "source_id").join(side("target_id"), ["namespace", "target_id"])
    weight = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.max("weight"))), 2)
    edges = inner.groupBy("namespace", F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "relation_type").agg(weight.alias("weight"))
    count = nodes.groupBy("namespace").agg(F.count(F.lit(1)).alias("nodes")).join(edges.groupBy("namespace").agg(F.count(F.lit(1)).alias("edges")), "namespace", "left")
    poor = nodes.join(count.filter(F.coalesce("edges", F.lit(0)) < fallback).select("namespace"), "namespace")
    grams = poor.filter(T.has_cjk(F.col("content"))).select(F.struct("namespace", "key").alias("k"), F.explode(T.cjk_shingles(F.col("content"))).alias("g"))
    # a shingle counts within its namespace only
    alike = jaccard_pairs(grams.select("k", F.struct("k.namespace", "g").alias("w")), least)
    known = edges.select("namespace", "a", "b").distinct()
    alike = alike.select(F.col("a.namespace").alias("namespace"), F.col("a.key").alias("a"), F.col("b.key").alias("b"), F.lit("keyword").alias("relation_type"), F.round("jaccard", 2).alias("weight")).join(known, ["namespace", "a", "b"], "left_anti")
    w = Window.partitionBy("namespace").orderBy(F.desc("weight"), "a", "b", "relation_type")
    every = edges.unionByName(alike).withColumn("rank", F.row_number().over(w)).join(count.select("namespace", "nodes"), "namespace")
    return every.filter(F.col("rank") <= 3 * F.col("nodes")).drop("nodes")


def neighbourhoods(edges: DataFrame) -> DataFrame:
    """(node, neighbours): an edge list (source, target, weight) flattened, each node's neighbours by weight and then key."""
    held = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "target")))
    return edges.groupBy(F.col("source").alias("node")).agg(F.transform(held, lambda x: x["target"]).alias("neighbours"))
