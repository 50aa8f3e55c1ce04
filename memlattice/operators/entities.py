"""Upserts of entities, of what mentions them and of edges between them, in one merge of three tables that depend on each other."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import cut
from .graph import EDGE_TYPES


@dataclass(frozen=True)
class Graph:
    """entities(entity_id, namespace, entity_type, name, aliases, summary), mentions(entity_id, memory_id, context),
    edges(source_id, target_id, relation_type, weight, evidence)."""

    entities: DataFrame
    mentions: DataFrame
    edges: DataFrame


def entity_id(namespace: Column, name: Column) -> Column:
    """The id of an entity that comes without one: the same whenever and wherever it is written."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(namespace, F.lit("")), name), 256), 1, 32)


def upsert(graph: Graph, entities: DataFrame, mentions: DataFrame, edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> tuple[Graph, DataFrame]:
    """The graph after these writes, and (kind, name, reason, n) of what was refused.

    entities(entity_id, namespace, entity_type, name, aliases, summary, at): names are trimmed, an empty one is refused. One without an id has that of the entity of its
    namespace and name (the smallest, if there are several), or a new one. Of one id the write of largest `at` sets name, aliases and summary; the type and namespace are those of the first.
    mentions(namespace, name, memory_id, context, at) and edges(namespace, source, target, relation_type, weight, evidence, at) name their ends, which
    are looked up after the entities are merged; an end that isn't there, and a type that isn't known, is refused. A mention of an entity in a memory is kept once, with its
    first context; an edge of the same ends and type takes the weight and evidence of the largest `at`. Writing the same again changes nothing.
    """
    named = entities.withColumn("name", F.trim("name"))
    sound = named.filter(F.coalesce(F.col("name"), F.lit("")) != "")
    places = lambda e: e.groupBy("namespace", "name").agg(F.min("entity_id").alias("entity_id"))
    there = places(graph.entities).withColumnRenamed("entity_id", "_there")
    found = sound.join(there, ["namespace", "name"], "left").withColumn("entity_id", F.coalesce("entity_id", "_there", entity_id(F.col("namespace"), F.col("name"))))
    last = F.struct("at", "name", "aliases", "summary")
    first = F.struct(F.col("at"), "namespace", "entity_type")
    wrote = found.groupBy("entity_id").agg(F.max(last).alias("n"), F.min(first).alias("f"))
    old = graph.entities.select("entity_id", *(F.col(c).alias(f"_{c}") for c in ("namespace", "entity_type", "name", "aliases", "summary")))
    both = old.join(wrote, "entity_id", "full")
    merged = cut(both.select(
        "entity_id", *(F.when(F.col("_name").isNotNull(), F.col(f"_{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("namespace", "entity_type")),
        *(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"_{c}")).alias(c) for c in ("name", "aliases", "summary"))))

    of = lambda side: places(merged).select("namespace", F.col("name").alias(side), F.col("entity_id").alias(f"{side}_id"))
    said = mentions.withColumn("name", F.trim("name")).join(of("name"), ["namespace", "name"], "left")
    first_said = said.filter("name_id is not null and memory_id is not null").groupBy(F.col("name_id").alias("entity_id"), "memory_id").agg(F.min_by("context", F.struct("at", "context")).alias("context"))
    new_mentions = graph.mentions.select("entity_id", "memory_id", "context").unionByName(first_said.join(graph.mentions, ["entity_id", "memory_id"], "left_anti"))

    ends = edges.withColumn("source", F.trim("source")).withColumn("target", F.trim("target")).join(of("source"), ["namespace", "source"], "left").join(of("target"), ["namespace", "target"], "left")
    lost, known = F.col("source_id").isNull() | F.col("target_id").isNull(), F.coalesce(F.col("relation_type").isin(*types), F.lit(False))
    by = ["source_id", "target_id", "relation_type"]
    latest = ends.filter(~lost & known).groupBy(*by).agg(F.max(F.struct("at", "weight", "evidence")).alias("e")).select(*by, "e.weight", "e.evidence")
    new_edges = graph.edges.join(latest, by, "left_anti").select(*by, "weight", "evidence").unionByName(latest)

    refused = [
        named.filter(F.coalesce(F.col("name"), F.lit("")) == "").select(F.lit("entity").alias("kind"), "name", F.lit("empty name").alias("reason")),
        said.filter("name_id is null or memory_id is null").select(F.lit("mention").alias("kind"), "name", F.lit("no such entity").alias("reason")),
        ends.filter(lost | ~known).select(F.lit("edge").alias("kind"), F.concat_ws(" ", "source", "relation_type", "target").alias("name"), F.when(~known, "unknown type").otherwise("no such entity").alias("reason")),
    ]
    told = refused[0].unionByName(refused[1]).unionByName(refused[2]).groupBy("kind", "name", "reason").agg(F.count(F.lit(1)).alias("n"))
    return Graph(merged, new_mentions, new_edges), told
