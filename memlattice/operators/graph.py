"""Entity graph, neighbour expansion, supersession chains and closures."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ..staging import cut, numbered
from .vector import BATCH_BYTES, BATCH_KEY

#: Neighbours a frontier node may add of each type, OTHER of any other, and the types it looks at first.
CAPS, OTHER = {"semantic_related": 6, "same_entity": 4, "updates": 8, "chronological": 2}, 2
FIRST = ("semantic_related", "updates", "same_entity")
#: Nodes of a frontier that are sent to all tasks; more of them are joined with the relations.
NODES = 1 << 18


def expand(seeds: DataFrame, relations: DataFrame, hops: int = 2, fanout: int = 10, decay: float = 0.5) -> DataFrame:
    """(query_id, node, hop, score, graph) reached from seeds (query_id, node, score) within `hops` (3 at most).

    Hop by hop: each frontier node looks at its first max(3 * fanout, 20) neighbours by type and weight; seen ones
    drop out; the first frontier node to claim a neighbour has it, and each adds only so many of a type. A claimed neighbour
    counts as seen even if the cap leaves it out. A score is the best seed's times
    decay for each hop and max(weight, .1); graph is the product of the weights on the way. Weights of 0 or less don't count.
    """
    priority, cap = F.lit(len(FIRST)), F.lit(OTHER)
    for name, most in CAPS.items():
        cap = F.when(F.col("relation_type") == name, most).otherwise(cap)
    for i, name in enumerate(FIRST):
        priority = F.when(F.col("relation_type") == name, i).otherwise(priority)
    ends = lambda at, node: relations.filter("weight > 0").select(F.col(at).alias("at"), F.col(node).alias("node"), "relation_type", "weight")

    def looked_at(frontier: DataFrame) -> DataFrame:
        """What the frontier's nodes look at, which doesn't depend on the query; relations of other nodes aren't dealt or sorted."""
        at = cut(frontier.select("at").distinct())
        nodes = F.broadcast(at) if at.count() <= NODES else at
        both = ends("source_id", "target_id").join(nodes, "at", "left_semi").union(ends("target_id", "source_id").join(nodes, "at", "left_semi")).distinct()
        both = both.withColumn("priority", priority).withColumn("cap", cap)
        look = Window.partitionBy("at").orderBy("priority", F.desc("weight"), "node", "relation_type")
        return both.withColumn("pos", F.row_number().over(look)).filter(F.col("pos") <= max(3 * fanout, 20))

    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    frontier = seeds.select("query_id", "node", F.max("score").over(Window.partitionBy("query_id")).alias("best"), F.lit(1.0).alias("graph"), F.row_number().over(first).alias("fpos"))
    seen, found = frontier.select("query_id", "node"), None
    for hop in range(1, min(hops, 3) + 1):
        f = frontier.select("query_id", F.col("node").alias("at"), "best", F.col("graph").alias("way"), "fpos")
        step = f.join(looked_at(f), "at").join(seen, ["query_id", "node"], "left_anti")
        claim = Window.partitionBy("query_id", "node").orderBy("fpos", "pos")
        step = step.withColumn("c", F.row_number().over(claim)).filter("c = 1")
        fits = Window.partitionBy("query_id", "at", "relation_type").orderBy("pos")
        step = step.withColumn("t", F.row_number().over(fits)).withColumn("score", F.col("best") * decay**hop * F.greatest("weight", F.lit(0.1)))
        # the next hop, what was seen and what was found all read this one
        step = cut(step.select("query_id", "node", "score", "way", "weight", "best", "fpos", "pos", "t", "cap"))
        claimed = step.select("query_id", "node")
        nodes = step.filter("t <= cap").select("query_id", "node", F.lit(hop).alias("hop"), "score", (F.col("way") * F.col("weight")).alias("graph"), "best", F.struct("fpos", "pos").alias("order"))
        frontier = nodes.select("query_id", "node", "best", "graph", F.row_number().over(Window.partitionBy("query_id").orderBy("order")).alias("fpos"))
        seen = seen.union(claimed)
        found = nodes.drop("order", "best") if found is None else found.union(nodes.drop("order", "best"))
    return found


#: Rows of one key that meet each other in one task; more are dealt into blocks, which meet two at a time.
LOT = 2000


def _in_blocks(rows: DataFrame, key: str, of: str, lot: int) -> DataFrame:
    """(key, of, _side, _i, _j): the blocks _i <= _j of a key that meet, with the rows of both; _side is a row's own block."""
    heavy = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > lot).select(key, F.ceil(F.col("_c") / lot).cast("int").alias("_g"))
    dealt = rows.select(key, of).join(heavy, key, "left").withColumn("_g", F.coalesce("_g", F.lit(1)))
    dealt = dealt.withColumn("_side", F.pmod(F.xxhash64(of), F.col("_g")).cast("int"))
    dealt = dealt.select(key, of, "_side", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)).alias("_o"))
    return dealt.select(key, of, "_side", F.least("_side", "_o").alias("_i"), F.greatest("_side", "_o").alias("_j"))


def pairs_of(rows: DataFrame, key: str, of: str, lot: int = LOT) -> DataFrame:
    """(key, a, b) with a < b for each two values of `of` under a key; rows(key, of) are distinct. A key with many rows is split in blocks."""
    dealt = _in_blocks(rows, key, of, lot)
    left = dealt.filter("_side = _i").select(key, "_i", "_j", F.col(of).alias("_x"))
    right = dealt.filter("_side = _j").select(key, "_i", "_j", F.col(of).alias("_y"))
    met = left.join(right, [key, "_i", "_j"]).filter("_i <> _j or _x < _y")
    return met.select(key, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


#: Pairs that a task counts at a time.
PAIRS = 1 << 22


def counted_pairs(rows: DataFrame, key: str, of: str, lot: int = LOT) -> DataFrame:
    """(a, b, shared) with a < b: under how many keys two values of `of` stand. rows(key, of) are distinct.

    Whole numbers that differ by less than 2^31 travel as sorted numbers of pairs, packed by a hash of the pair, some PAIRS of which are counted at a time; a pair is never a row
    before it is counted. Other values are paired as rows.
    """
    spark, p = rows.sparkSession, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, low, high = rows.dropna(subset=[key, of]), None, None  # nulls meet nothing
    if isinstance(rows.schema[of].dataType, ByteType | ShortType | IntegerType | LongType):
        sizes = rows.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"), F.min(of).alias("low"), F.max(of).alias("high"))
        low, high, n = sizes.agg(F.min("low"), F.max("high"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()  # one row
    if low is None or high - low >= 1 << 31:
        return pairs_of(rows, key, of, lot).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    buckets, kind = int(n // PAIRS) + 1, rows.schema[of].dataType.simpleString()

    def pack(keys: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(keys)
        bucket = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % buckets
        order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
        names, first = np.unique(bucket[order], return_index=True)
        # steps between sorted pairs have many bytes of 0, which stand together
        data = [pa.compress(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) for x in np.split(keys[order], first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.diff(first, append=len(keys))), pa.array(data, pa.binary())], names=["bucket", "n", "pairs"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            nx, ny = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (x, y))
            vx, vy = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) - low for c in (x, y))
            ex, ey = np.cumsum(nx), np.cumsum(ny)
            alike = [np.flatnonzero((nx == k) & (ny == 0)) for k in np.unique(nx[ny == 0]) if k > 1]
            for at in alike:  # lists of one length side by side, some PAIRS at a time
                k = int(nx[at[0]])
                i, j = np.triu_indices(k, 1)
                for some in np.array_split(at, -(-len(at) * len(i) // PAIRS)):
                    m = np.sort(vx[(ex[some] - k)[:, None] + np.arange(k)], axis=1)
                    held.append((m[:, i] << 32 | m[:, j]).ravel())
                    n += len(held[-1])
                    if n >= PAIRS:
                        yield pack(np.concatenate(held))
                        held, n = [], 0
            for r in np.flatnonzero((nx > 0) & (ny > 0)).tolist():
                a, b = vx[ex[r] - nx[r] : ex[r], None], vy[None, ey[r] - ny[r] : ey[r]]
                held.append((np.minimum(a, b) << 32 | np.maximum(a, b)).ravel())
                n += len(held[-1])
                if n >= PAIRS:
                    yield pack(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield pack(np.concatenate(held))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            pair, shared = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((pair >> 32) + low), pa.array((pair & 0xFFFFFFFF) + low), pa.array(shared)], names=["a", "b", "shared"])

        for batch in batches:
            for bucket, n, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "pairs")), strict=True):
                if bucket != now and held:
                    yield close()
                    held = []
                now = bucket
                held.append(np.cumsum(np.frombuffer(pa.decompress(data, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n).T.copy().view("<i8").ravel()))
        if held:
            yield close()

    side = lambda c: F.collect_list(F.when(c, F.col(of)))
    met = _in_blocks(rows, key, of, lot).groupBy(key, "_i", "_j").agg(side(F.col("_side") == F.col("_i")).alias("x"), side((F.col("_side") == F.col("_j")) & (F.col("_i") != F.col("_j"))).alias("y"))
    packed = met.select("x", "y").mapInArrow(paired, "bucket long, n long, pairs binary")
    dealt = packed.repartition(p, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(counted, "a long, b long, shared long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"), "shared")


def jaccard_pairs(rows: DataFrame, least: float, lot: int = LOT) -> DataFrame:
    """(a, b, jaccard) with a < b of keys whose sets rows(k, w) have a Jaccard similarity of `least` or more; rows are distinct.

    Keys of equal sets are a class, and sets are compared once for each two classes; each pair of their keys is then given. A class with many keys is dealt into blocks.
    A set's elements are put in order from the rarest. Two sets so similar share one of the first n - ceil(least * n) + 1 of each, so
    only these are joined; frequent elements hardly ever are among them.
    """
    whole = cut(rows.groupBy("k").agg(F.array_sort(F.collect_list("w")).alias("s")))
    classes = cut(whole.groupBy("s").agg(F.min("k").alias("class"), F.ceil(F.count(F.lit(1)) / lot).cast("int").alias("blocks")))
    members = whole.join(classes, "s").select("class", "k", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    each = classes.select("class", F.explode("s").alias("w"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("f"))
    sets = each.join(often, "w").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("f", "w"))).alias("s"))
    sets = sets.select("class", F.transform("s", lambda x: x["w"]).alias("s"))
    n = F.size("s")
    first = sets.select("class", F.explode(F.slice("s", F.lit(1), (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))).alias("w"))
    met = pairs_of(first, "w", "class").select("a", "b").distinct()
    side = lambda c: classes.select(F.col("class").alias(c), F.col("s").alias(f"s{c}"), F.col("blocks").alias(f"g{c}"))
    both = met.join(side("a"), "a").join(side("b"), "b")
    c = F.size(F.array_intersect("sa", "sb"))
    near = both.select("a", "b", "ga", "gb", (c / (F.size("sa") + F.size("sb") - c)).alias("jaccard")).filter(F.col("jaccard") >= least)
    near = near.select("a", "b", "jaccard", "gb", F.explode(F.sequence(F.lit(0), F.col("ga") - 1)).alias("ba")).select("a", "b", "jaccard", "ba", F.explode(F.sequence(F.lit(0), F.col("gb") - 1)).alias("bb"))
    of = lambda x: members.select(F.col("class").alias(x), F.col("block").alias(f"b{x}"), F.col("k").alias(f"k{x}"))
    apart = near.join(of("a"), ["a", "ba"]).join(of("b"), ["b", "bb"]).select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), "jaccard")
    return pairs_of(members, "class", "k", lot).select("a", "b", F.lit(1.0).alias("jaccard")).unionByName(apart)


def neighbours(relations: DataFrame) -> DataFrame:
    """(at, node, relation_type, weight): relations from both ends, each once."""
    both = relations.select(F.col("source_id").alias("at"), F.col("target_id").alias("node"), "relation_type", "weight")
    return both.union(relations.select("target_id", "source_id", "relation_type", "weight")).distinct()


def named_mentions(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """Mentions of entities (entity, name) whose name isn't empty; those of unknown entities stay."""
    return mentions.join(entities.filter(F.trim("name") == "").select("entity"), "entity", "left_anti")


def cooccurrence(mentions: DataFrame, min_shared: int = 2, least: float = 0.1) -> DataFrame:
    """(a, b, shared, weight) of memories that mention common entities: weight = shared / (1 + ln(larger degree)).

    Pairs are built per entity; those of an entity with many memories in blocks; they are counted by counted_pairs(). An entity that all memories mention pairs everything
    nevertheless, as the definition has it, so give entities that tell something apart.
    """
    m = cut(mentions.select("entity", "memory_id").distinct())
    degree = cut(m.groupBy("memory_id").agg(F.count(F.lit(1)).alias("deg")))
    shared = counted_pairs(m, "entity", "memory_id").filter(F.col("shared") >= min_shared)
    d = lambda side: degree.select(F.col("memory_id").alias(side), F.col("deg").alias(f"d{side}"))
    out = shared.join(d("a"), "a").join(d("b"), "b").withColumn("weight", F.round(F.col("shared") / (1 + F.log(F.greatest("da", "db"))), 4))
    return out.filter(F.col("weight") >= least).select("a", "b", "shared", "weight")


def undirected(relations: DataFrame) -> DataFrame:
    """One edge for each pair of ends and type, with the largest weight (clamped to .05 to 1); no self edges."""
    e = relations.filter("source_id <> target_id").groupBy(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "relation_type").agg(F.max("weight").alias("w"))
    return e.select("a", "b", "relation_type", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.05), F.col("w"))), 2).alias("weight"))


def link_counts(relations: DataFrame) -> DataFrame:
    """(node, links): relations that touch a node; one to itself counts once."""
    ends = relations.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))


def entity_search(entities: DataFrame, mentions: DataFrame, term: str) -> DataFrame:
    """(entity, mentions_count, rank) of entities whose name, aliases or summary (where entities has them), or a mention's context, has the term;
    the most mentioned has rank 1, ties by name. The term is lower-case."""
    said = [F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False)) for c in ("entity", "aliases", "summary") if c in entities.columns]
    named = functools.reduce(lambda a, b: a | b, said)
    hit = mentions.filter(F.contains(F.lower("context"), F.lit(term))).select("entity").distinct().withColumn("by_context", F.lit(True))
    counts = mentions.groupBy("entity").agg(F.count(F.lit(1)).alias("mentions_count"))
    out = entities.join(hit, "entity", "left").filter(named | F.col("by_context")).join(counts, "entity", "left")
    out = out.select("entity", F.coalesce("mentions_count", F.lit(0)).alias("mentions_count"))
    return numbered(out, "rank", F.desc("mentions_count"), F.col("entity"))


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """All (s, o) reached over edges (s, o). Each round takes only the paths that the last one found one edge further, `most` edges in all."""
    step = cut(edges.select("s", "o").distinct())
    new = paths = step
    for _ in range(most - 1):
        further = new.select("s", F.col("o").alias("_m")).join(step.select(F.col("s").alias("_m"), "o"), "_m").select("s", "o").distinct()
        new = cut(further.join(paths, ["s", "o"], "left_anti"))
        if not new.limit(1).count():
            break
        paths = paths.union(new)
    return paths


#: Kinds of edges between entities.
EDGE_TYPES = ("related_to", "uses", "depends_on", "mentions", "similar_to", "part_of", "belongs_to", "contains", "member_of", "works_at", "located_in", "founded_by", "owns", "authors", "collaborates_with", "antagonist_of", "spawned_by", "triggers", "references", "supersedes", "created_by", "conflicts_with")


def entities_in(queries: DataFrame, entities: DataFrame, among: int = 256, most: int = 64) -> DataFrame:
    """(query_id, entity) of entities whose trimmed name, of two bytes or more, stands in the query's text.

    Only the first `among` names are looked for and the first `most` of a query kept, as defined; so few names may be broadcast.
    """
    name = F.trim("entity")
    names = entities.select(name.alias("entity")).filter(F.octet_length("entity") >= 2).distinct().orderBy("entity").limit(among)
    hits = queries.join(F.broadcast(names), F.contains(F.lower("text"), F.lower("entity")))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("entity"))
    return hits.select("query_id", "entity", n.alias("n")).filter(F.col("n") <= most).drop("n")


def upsert_edges(edges: DataFrame, types: tuple[str, ...] = EDGE_TYPES) -> DataFrame:
    """edges(source_id, target_id, relation_type, weight, at): the last of each pair and type, of known types only."""
    known = edges.filter(F.col("relation_type").isin(*types))
    last = F.max_by("weight", "at").alias("weight")
    return known.groupBy("source_id", "target_id", "relation_type").agg(last, F.count(F.lit(1)).alias("writes"))


def write_back(triples: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """triples(s, p, o) with what happens to each: skipped if an end is a blank node or no entity, or the predicate no
    relation; kept if the edge (s, p, o) is there; else written."""
    known = lambda side: entities.select(F.col("entity").alias(side), F.lit(True).alias(f"_{side}"))
    out = triples.join(known("s"), "s", "left").join(known("o"), "o", "left").join(edges.select("s", "p", "o", F.lit(True).alias("_there")), ["s", "p", "o"], "left")
    bad = F.col("_s").isNull() | F.col("_o").isNull() | ~F.col("p").isin(*EDGE_TYPES) | F.startswith("s", F.lit("_:")) | F.startswith("o", F.lit("_:"))
    return out.select("s", "p", "o", F.when(F.coalesce(bad, F.lit(True)), "skipped").when(F.col("_there"), "kept").otherwise("written").alias("action"))
