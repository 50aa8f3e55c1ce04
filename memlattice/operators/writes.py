"""The write path and what follows it, as old state -> new state: new rows, near duplicates, merges, observation, ingest,
vector upserts, evolution with its log, mailboxes, agents and skills."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lifecycle import COOLDOWN, OTHER_PHASES, QUOTAS, apply_supersede
from .vector import clean



def new_rows(batch: DataFrame, now: str) -> DataFrame:
    """batch(key, namespace, content, category, importance, tags) as they are stored: id of the whole content, distilled content with the whole as
    raw_ref where it differs, tags with signals, confidence .8, the hot tier, no decay yet."""
    short = T.distill(F.col("content"))
    return batch.select(
        "key", T.content_id(F.col("content")).alias("id"), "namespace", short.alias("content"), F.when(short != F.col("content"), F.col("content")).alias("raw_ref"), "category", "importance",
        T.signal_tags(F.col("tags"), F.col("content")).alias("tags"), F.lit(0.8).alias("confidence"), F.lit("hot").alias("tier"), F.lit(1.0).alias("decay"), F.lit(0).alias("recall_count"), F.lit(now).alias("created_at"), F.lit(now).alias("valid_from"),
    )


def near_dup_writes(memories: DataFrame, pairs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) after near duplicates: pairs(old, new, score) whose old row isn't superseded yet supersede it; each leaves an
    `updates` edge from old to new with the score as weight."""
    live = memories.filter("superseded_by is null").select(F.col("key").alias("old"), "namespace")
    open_pairs = pairs.join(live, "old")
    edges = open_pairs.select("namespace", F.col("old").alias("source_id"), F.col("new").alias("target_id"), F.lit("updates").alias("relation_type"), F.round("score", 2).alias("weight"), F.lit("near_dup_detection").alias("evidence"))
    return apply_supersede(memories, open_pairs.select("old", "new"), now), edges


def merge(memories: DataFrame, pairs: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(memories, edges) after merging pairs(keep, gone): gone is superseded by keep, keep's recall count grows by gone's; an edge of weight 1 says so."""
    more = pairs.join(memories.select(F.col("key").alias("gone"), "recall_count"), "gone").groupBy(F.col("keep").alias("key")).agg(F.sum("recall_count").alias("_more"))
    out = apply_supersede(memories, pairs.select(F.col("gone").alias("old"), F.col("keep").alias("new")), now).join(more, "key", "left")
    out = out.withColumn("recall_count", F.col("recall_count") + F.coalesce("_more", F.lit(0))).drop("_more")
    edges = pairs.join(memories.select(F.col("key").alias("keep"), "namespace"), "keep").select("namespace", F.col("gone").alias("source_id"), F.col("keep").alias("target_id"), F.lit("updates").alias("relation_type"), F.lit(1.0).alias("weight"), F.lit("manual_merge").alias("evidence"))
    return out, edges


def predecessors(memories: DataFrame) -> DataFrame:
    """(target, key, created_at, rank): the rows that each row superseded directly, newest first."""
    w = Window.partitionBy("target").orderBy(F.desc("created_at"), "key")
    return memories.filter("superseded_by is not null").select(F.col("superseded_by").alias("target"), "key", "created_at").withColumn("rank", F.row_number().over(w))


def observe(memories: DataFrame, batch: DataFrame, hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, inserted) after observing batch(key, namespace, content): what hits(key, bumps) says is near an older row bumps
    that row's recall count; the rest is inserted once for each new content id, warm, with importance 2 and confidence .5."""
    near = batch.select("key").join(hits.filter("bumps is not null"), "key")
    bumps = near.groupBy(F.col("bumps").alias("key")).agg(F.count(F.lit(1)).alias("_n"))
    out = memories.join(bumps, "key", "left").withColumn("recall_count", F.col("recall_count") + F.coalesce("_n", F.lit(0))).drop("_n")
    rest = batch.join(near.select("key"), "key", "left_anti").withColumn("id", T.content_id(F.col("content")))
    first = rest.groupBy("id").agg(F.min("key").alias("key"), F.min_by("namespace", "key").alias("namespace"), F.min_by("content", "key").alias("content"))
    known = memories.select(T.content_id(F.col("content")).alias("id"))
    fresh = first.join(known, "id", "left_anti")
    return out, fresh.select("id", "key", "namespace", T.distill(F.col("content")).alias("content"), F.lit("observation").alias("category"), F.lit("warm").alias("tier"), F.lit(2).alias("importance"), F.lit(0.5).alias("confidence"))


def ingest(documents: DataFrame, now: str) -> DataFrame:
    """documents(doc_id, namespace, name, kind, path, text) as rows: a manifest of type document at place 0 and its chunks of type
    document_chunk, whose parent is the manifest."""
    parts = T.chunk_text(F.col("text"))
    whole = documents.select("*", F.posexplode(F.concat(F.array(F.lit(None).cast("string")), parts)).alias("place", "part"), F.size(parts).alias("total"))
    head = T.manifest(F.col("name"), F.col("kind"), F.octet_length("text"), F.col("text"), F.col("path"))
    body = F.when(F.col("place") == 0, head).otherwise(T.chunk_body(F.col("name"), F.col("place"), F.col("total"), F.col("part")))
    return whole.select(
        "doc_id", "namespace", F.col("place").cast("long").alias("place"), T.content_id(body).alias("id"), F.when(F.col("place") > 0, T.content_id(head)).alias("parent_id"),
        F.when(F.col("place") == 0, "document").otherwise("document_chunk").alias("memory_type"), body.alias("content"), F.lit(now).alias("created_at"),
    )


def documents_list(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Manifests of each namespace, newest first: rows of type document without a parent, 200 at most."""
    w = Window.partitionBy("namespace").orderBy(F.desc("created_at"), "id")
    live = rows.filter((F.col("memory_type") == "document") & (F.coalesce("parent_id", F.lit("")) == ""))
    return live.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= min(max(limit, 1), 200))


def vector_faults(v: Column, dim: int) -> Column:
    """Why a vector is refused: dimension, norm (null, zero or not finite); null for a sound one."""
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(v.isNull() | (F.size(v) != dim), "dimension").when(F.isnan(norm) | norm.isNull() | (norm == float("inf")) | (norm == 0), "norm")


def upsert_vectors(old: DataFrame, new: DataFrame, dim: int) -> DataFrame:
    """(key, v, action) of old(key, v) and new(key, v, at): the latest sound new vector of a key replaces or adds it; refused ones are listed with
    their fault as action, and change nothing."""
    fault = vector_faults(F.col("v"), dim)
    told = new.withColumn("fault", fault)
    best = told.filter("fault is null").groupBy("key").agg(F.max_by("v", "at").alias("n"))
    both = old.join(best, "key", "full_outer")
    action = F.when(F.col("n").isNull(), "kept").when(F.col("v").isNull(), "added").otherwise("replaced")
    done = both.select("key", F.coalesce("n", "v").alias("v"), action.alias("action"))
    return done.unionByName(told.filter("fault is not null").select("key", "v", F.concat(F.lit("refused: "), "fault").alias("action")))


def drop_counts(vectors: DataFrame, dim: int) -> DataFrame:
    """(reason, n): vectors that a search leaves out, by fault; sound ones count as used."""
    return vectors.groupBy(F.coalesce(vector_faults(F.col("v"), dim), F.lit("used")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def embed(rows: DataFrame, embedder: Callable[[pd.Series], pd.Series], dim: int, text: str = "content") -> DataFrame:
    """(key, v) of rows by a function from texts to lists of floats, called with Arrow batches; vectors are scaled to length 1, unsound ones dropped."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "v": embedder(pdf["text"])})

    out = rows.select(F.col("key").cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, "key long, v array<double>")
    out = clean(out, dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return out.withColumn("_n", norm).select("key", F.transform("v", lambda x: x / F.col("_n")).alias("v"))


def without_vectors(memories: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Memories that have no sound vector: what a rebuild embeds."""
    return memories.join(vectors.filter(vector_faults(F.col("v"), dim).isNull()).select("key"), "key", "left_anti")


# --- evolution ---
def evolve_queue(memories: DataFrame, limit: int = 50) -> DataFrame:
    """The next memories of each namespace to evolve: most important first, then by id; 2000 at most."""
    w = Window.partitionBy("namespace").orderBy(F.desc("importance"), "id")
    return memories.filter("evolved_at is null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (50 if limit <= 0 else min(limit, 2000)))


def evolve_batch(batch: DataFrame, links: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(memories, log) after promoting batch(key, namespace, content, context, link_count, ...): a new context, time and number of links
    (links(node, links)); the log keeps old and new values as JSON."""
    both = batch.join(links.withColumnRenamed("node", "key"), "key", "left").withColumn("links", F.coalesce("links", F.lit(0)).cast("long"))
    fresh = T.evolved_context(F.col("content"))
    value = lambda c, n: F.to_json(F.struct(c.alias("evolved_context"), n.alias("link_count")), {"ignoreNullFields": "false"})
    log = both.select("key", "namespace", F.lit("auto_promote").alias("change_type"), value(F.col("context"), F.col("link_count")).alias("old_value"), value(fresh, F.col("links")).alias("new_value"), F.lit(now).alias("created_at"))
    return both.withColumn("context", fresh).withColumn("evolved_at", F.lit(now)).withColumn("link_count", F.col("links")).drop("links"), log


def rollback(memories: DataFrame, log: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, log) after taking back the log rows whose key is in gone(key): context and links are what they were, evolved_at
    stays; the rows are marked rolled_back."""
    marked = gone.select("key", F.lit(True).alias("_back")).distinct()
    log = log.join(marked, "key", "left").withColumn("change_type", F.when(F.col("_back"), "rolled_back").otherwise(F.col("change_type")))
    was = F.from_json("old_value", "evolved_context string, link_count long")
    old = log.filter("_back").select("key", was.alias("_was"))
    out = memories.join(old, "key", "left")
    restored = F.col("_was").isNotNull()
    out = out.withColumn("context", F.when(restored, F.col("_was.evolved_context")).otherwise(F.col("context"))).withColumn("link_count", F.when(restored, F.col("_was.link_count")).otherwise(F.col("link_count")))
    return out.drop("_was"), log.drop("_back")


def evolution_log(log: DataFrame, types: tuple[str, ...] = (), since: str = "", limit: int = 500) -> DataFrame:
    """Log rows of these types (none: all) from `since` on, newest first; 5000 at most."""
    rows = log.filter(F.col("created_at") >= since)
    rows = rows.filter(F.col("change_type").isin(*types)) if types else rows
    return rows.orderBy(F.desc("created_at"), "id").limit(500 if limit <= 0 else min(limit, 5000))


# --- phases, requests, messages, agents, skills ---
def phase_gate(runs: DataFrame) -> DataFrame:
    """runs(phase, ns, ts, key) with whether the run before, of the same phase and namespace, is as long ago as the phase asks for."""
    table = F.create_map(*(F.lit(x) for kv in COOLDOWN.items() for x in kv))
    w = Window.partitionBy("phase", "ns").orderBy("ts", "key")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    return runs.withColumn("allowed", F.coalesce(gap >= F.coalesce(F.try_element_at(table, F.col("phase")), F.lit(OTHER_PHASES)), F.lit(True)))


#: How long a quota of each kind lasts.
WINDOWS = {"write": "day", "search": "minute", "profile": "minute", "backup": "hour"}


def quota_start() -> Column:
    """The beginning of the window of a request (kind, ts); null for kinds without one."""
    start = None
    for kind, unit in WINDOWS.items():
        start = F.when(F.col("kind") == kind, F.date_trunc(unit, "ts")) if start is None else start.when(F.col("kind") == kind, F.date_trunc(unit, "ts"))
    return start


def quota_end() -> Column:
    """The end of the window of a request (kind, ts)."""
    end, start = None, quota_start()
    for kind, unit in WINDOWS.items():
        after = start + F.expr(f"INTERVAL 1 {unit}")
        end = F.when(F.col("kind") == kind, after) if end is None else end.when(F.col("kind") == kind, after)
    return end


def admit(requests: DataFrame, limits: dict[str, int] = QUOTAS) -> DataFrame:
    """requests(ns, kind, ts, key) with whether each is admitted: a namespace has so many of a kind in its day, minute or hour; kinds without a
    limit pass, a limit of 0 denies all. Denied requests don't count, as the first ones of a window are those admitted."""
    limit = F.try_element_at(F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)), F.col("kind"))
    w = Window.partitionBy("ns", "kind", "_start").orderBy("ts", "key")
    out = requests.withColumn("_start", quota_start()).withColumn("place", F.row_number().over(w))
    return out.withColumn("admitted", F.coalesce(F.col("place") <= limit, F.lit(True))).drop("_start")


def send(messages: DataFrame) -> DataFrame:
    """messages(sender, to, content, created_at) as memories of the receiver's mailbox."""
    return messages.select(T.content_id(F.concat_ws("|", "sender", "to", "content", "created_at")).alias("id"), F.concat(F.lit("agent/"), "to").alias("namespace"), F.col("sender").alias("source"), "content", F.lit("a2a_message").alias("category"), "created_at")


def delete_messages(mailbox: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mailbox, requests with deleted) after requests(agent, id): an agent deletes messages of its own mailbox only."""
    own = requests.withColumn("namespace", F.concat(F.lit("agent/"), "agent")).join(mailbox.filter("category = 'a2a_message'").select("id", "namespace", F.lit(True).alias("_own")), ["id", "namespace"], "left")
    told = own.select("agent", "id", F.coalesce("_own", F.lit(False)).alias("deleted"))
    return mailbox.join(told.filter("deleted").select("id").distinct(), "id", "left_anti"), told


def agent_states(events: DataFrame) -> DataFrame:
    """(agent_id, name, role, badge, status) after events(agent_id, at, kind, name, role, badge) in order: register or update set what they give, revoke takes
    the badge away until the next register."""
    last = lambda c, when: F.max_by(c, F.when(when & F.col(c).isNotNull(), F.col("at")))
    told = F.col("kind").isin("register", "update")
    out = events.groupBy("agent_id").agg(last("name", told).alias("name"), last("role", told).alias("role"), last("badge", F.col("kind") == "register").alias("_badge"), F.max(F.when(F.col("kind") == "register", F.col("at"))).alias("_in"), F.max(F.when(F.col("kind") == "revoke", F.col("at"))).alias("_out"))
    gone = F.coalesce(F.col("_out") > F.col("_in"), F.col("_in").isNull())
    return out.select("agent_id", "name", "role", F.when(gone, "").otherwise(F.col("_badge")).alias("badge"), F.when(gone, "revoked").otherwise("active").alias("status"))


def skill_states(publications: DataFrame, installs: DataFrame) -> DataFrame:
    """(skill, version, author, installs) of publications(skill, version, author, at) and installs(skill, agent): the last publication, and how many agents have it."""
    last = publications.groupBy("skill").agg(F.max_by("version", "at").alias("version"), F.max_by("author", "at").alias("author"))
    count = installs.groupBy("skill").agg(F.countDistinct("agent").alias("installs"))
    return last.join(count, "skill", "left").withColumn("installs", F.coalesce("installs", F.lit(0)))
