"""Exact nearest neighbours, distances and neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import cut

#: Vectors of a tile, and the bytes of tiles sent to Python at a time.
TILE = 1024
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)


def _fold(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_fold(a, b, lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: F.abs(x - y))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def jaccard(a: Column, b: Column) -> Column:
    return 1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def hellinger(a: Column, b: Column) -> Column:
    """Of two distributions."""
    return F.sqrt(F.greatest(1 - _fold(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0)))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of two distributions, natural logarithms."""
    half = lambda x, y: F.when(x > 0, x * F.log(2 * x / (x + y))).otherwise(0.0)
    return F.sqrt(F.greatest(0.5 * _fold(a, b, lambda x, y: half(x, y) + half(y, x)), F.lit(0.0)))


def jeffreys(a: Column, b: Column) -> Column:
    """Of two distributions, with a floor of 1e-30 under each component."""
    low = lambda x: F.greatest(x, F.lit(1e-30))
    return _fold(a, b, lambda x, y: (x - y) * F.log(low(x) / low(y)))


def clean(vectors: DataFrame, dim: int | None = None, v: str = "v") -> DataFrame:
    """Vectors of the dimension with a finite norm over 0."""
    norm = F.sqrt(dot(F.col(v), F.col(v)))
    out = vectors.filter(F.col(v).isNotNull() & (norm > 0) & (norm < float("inf")) & ~F.isnan(norm))
    return out.filter(F.size(v) == dim) if dim else out


def _owner(same: list[str]) -> Column:
    return F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in same)) if same else F.lit(0).cast("long")


def _tiles(rows: DataFrame, same: list[str], buckets: int) -> DataFrame:
    """Rows (key long, v, same) packed, partition by partition, into tiles of one dimension and bucket of owners, TILE unit vectors at most.

    (dim, bucket, low, high, keys, owners, m): low and high are the least and largest key, owners are hashes of the columns `same`.
    """
    owner = _owner(same)
    names = ("dim", "bucket", "low", "high", "keys", "owners", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owners = batch["key"].to_numpy(zero_copy_only=False), batch["owner"].to_numpy()
            bucket = np.mod(owners, buckets)
            lengths = pc.list_value_length(batch["v"]).to_numpy(zero_copy_only=False)
            for dim, b in np.unique(np.stack([lengths, bucket])[:, lengths > 0], axis=1).T.tolist():
                at = np.flatnonzero((lengths == dim) & (bucket == b))
                m = pc.list_flatten(batch["v"].take(pa.array(at))).to_numpy(zero_copy_only=False).astype(float).reshape(-1, int(dim))
                with np.errstate(all="ignore"):
                    norm = np.sqrt((m * m).sum(axis=1))
                    ok = np.isfinite(norm) & (norm > 0)
                    m = m[ok] / norm[ok, None]
                at = at[ok]
                order = np.argsort(keys[at], kind="stable")
                at, m = at[order], m[order]
                for i in range(0, len(at), TILE):
                    of = keys[at[i : i + TILE]].astype("<i8")
                    row = (int(dim), b, int(of[0]), int(of[-1]), of.tobytes(), owners[at[i : i + TILE]].tobytes(), m[i : i + TILE].astype("<f8").tobytes())
                    yield pa.RecordBatch.from_pydict({c: [x] for c, x in zip(names, row, strict=True)}, schema=packed)

    packed = pa.schema([("dim", pa.int32()), ("bucket", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), *((c, pa.binary()) for c in names[4:])])
    rows = rows.filter(F.col("key").isNotNull() & F.col("v").isNotNull()).select(F.col("key").cast("long").alias("key"), F.col("v").cast("array<double>").alias("v"), owner.alias("owner"))
    return rows.mapInArrow(run, "dim int, bucket long, low long, high long, keys binary, owners binary, m binary")


def knn(queries: DataFrame, vectors: DataFrame, k: int | None, parts: int | None = None, same: list[str] | None = None, earlier: bool = False, least: float | None = None, grid: bool = False) -> DataFrame:
    """(query_id, key, score) of the k vectors of largest cosine, ties (to six places) to the smaller key; without k all of them.

    same: columns that must be equal on both sides; their values are dealt into buckets, and only tiles of one bucket meet. earlier: only
    vectors of a smaller key than the query's; tiles that can have none don't meet. least: only scores from there on. grid: for as many queries
    as vectors; the parts of a bucket are then rows and columns, and either side is copied as often as the other has of them.
    Both sides are packed into tiles of bounded size. The vectors' tiles of a bucket are dealt into as many parts as its share of all
    vectors asks for, the queries' tiles go to each of these (without grid); a part keeps its own k for each query before the final top k. Tiles are joined by a
    shuffle, whatever their size is thought to be: no side is collected or broadcast, and no task holds all pairs.
    """
    conf = queries.sparkSession.conf
    if conf.get(BATCH_KEY, None) is None:
        conf.set(BATCH_KEY, BATCH_BYTES)
    parts, same = parts or int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), same or []
    buckets = parts if same else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None  # a tile of queries and the best so far of each: (row, key, score); the tiles of vectors that it meets follow each other
        for batch in batches:
            for i in range(batch.num_rows):
                dim, qk, xk = batch["dim"][i].as_py(), *(np.frombuffer(batch[c][i].as_py(), "<i8") for c in ("q_keys", "x_keys"))
                q, x = (np.frombuffer(batch[c][i].as_py(), "<f8").reshape(-1, dim) for c in ("q_m", "x_m"))
                s = q @ x.T
                if same:
                    qo, xo = (np.frombuffer(batch[c][i].as_py(), "<i8") for c in ("q_owners", "x_owners"))
                    if (qo != xo[0]).any() or (xo != xo[0]).any():
                        s[qo[:, None] != xo] = -2
                if earlier:
                    s[xk >= qk[:, None]] = -2
                floor = np.full(len(qk), -1.5 if least is None else least - 1e-9)
                if k is not None and k < len(xk) and (least is None or np.count_nonzero(s >= floor[:, None]) > 4 * k * len(qk)):
                    # what is over a k-th largest score less a margin for rounding may be among the k; the order below decides
                    floor = np.maximum(floor, np.partition(s, len(xk) - k, axis=1)[:, len(xk) - k] - 2e-6)
                row, col = np.nonzero(s >= floor[:, None])
                found = row, xk[col], np.clip(s[row, col], -1, 1)
                if k is None:
                    yield rows_of(qk, found)
                    continue
                if now is None or not np.array_equal(now, qk):
                    if now is not None:
                        yield rows_of(now, held)
                    now, held = qk, best(found)
                elif len(row):
                    held = best(tuple(map(np.concatenate, zip(held, found, strict=True))))
        if now is not None:
            yield rows_of(now, held)

    def best(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        order = np.lexsort((found[1], -np.round(found[2], 6), found[0]))
        row = found[0][order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
        return tuple(c[order] for c in found)

    def rows_of(qk: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"query_id": qk[found[0]], "key": found[1], "score": found[2]})

    asked, held = _tiles(queries.withColumn("key", F.col("query_id")), same, buckets), _tiles(vectors, same, buckets)
    named = lambda side: [F.col(c).alias(f"{side}_{c}") for c in ("low", "high", "keys", "owners", "m")]
    dealt = F.lit(parts)
    if same:  # one row for each of `parts` buckets: into how many parts its tiles of vectors are dealt
        tiles = vectors.groupBy(F.pmod(_owner(same), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        shares = tiles.crossJoin(F.broadcast(tiles.agg(F.sum("n").alias("every")))).select("bucket", F.greatest(F.lit(1), F.ceil(parts * F.col("n") / F.col("every"))).cast("int").alias("dealt"))
        asked, held, dealt = asked.join(F.broadcast(shares), "bucket"), held.join(F.broadcast(shares), "bucket"), F.col("dealt")
    # a part stands in a row, for the queries' tiles, and in a column, for the vectors'
    across = F.ceil(F.sqrt(dealt)).cast("int") if grid else dealt
    down = F.ceil(dealt / across).cast("int")
    of = lambda n: F.pmod(F.xxhash64("keys"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    q = asked.select("dim", "bucket", *named("q"), of(down).alias("row"), all_of(across).alias("column"))
    x = held.select("dim", "bucket", *named("x"), all_of(down).alias("row"), of(across).alias("column"))
    # tiles are larger than their plan says and stand in several parts, so by its estimate one side would be broadcast
    both = q.hint("merge").join(x, ["row", "column", "dim", "bucket"])
    if earlier:
        both = both.filter("x_low < q_high")
    found = both.mapInArrow(run, "query_id long, key long, score double")
    if k is None:
        return found
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), F.col("key"))
    return found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).select("query_id", "key", "score")


def knn_edges(vectors: DataFrame, k: int = 12, least: float = 0.6, cap: int = 8, same: list[str] | None = None) -> DataFrame:
    """(source, target, weight): each vector's nearest ones of its namespace from `least` on, `cap` at most, both ways."""
    q = vectors.select(F.col("key").alias("query_id"), "v", *(same or []))
    near = knn(q, vectors, k + 1, same=same, grid=True).filter((F.col("query_id") != F.col("key")) & (F.col("score") >= least))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "key")
    out = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= cap).select(F.col("query_id").alias("source"), F.col("key").alias("target"), F.round("score", 2).alias("weight"))
    return out.unionAll(out.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight")).distinct()


#: Open edges that one task may decide at the end.
REST = 100_000


def capped_graph(edges: DataFrame, cap: int = 8) -> DataFrame:
    """(namespace, a, b, weight) where no end has more than `cap` links, as if taken greedily by weight, then a and b, in each namespace.

    The heaviest edges, as many as the ends could fill twice or so, are decided first; then edges at full ends are dropped, and so on with what is left.
    """
    left = cut(edges.select("namespace", "a", "b", "weight"))
    taken: DataFrame | None = None
    ends = lambda df: df.select("namespace", F.explode(F.array("a", "b")).alias("end"))
    while True:
        of = lambda c: F.approx_count_distinct(F.struct("namespace", c))
        n, several = left.agg(F.count(F.lit(1)), of("a") + of("b")).first()  # one row
        most, least = max(REST, cap * several), None
        if n > most:
            # only how many are decided at a time depends on it
            least = (left.approxQuantile("weight", [1 - most / n], 0.002) or [None])[0]
        now = left if least is None else left.filter(F.col("weight") >= least)
        room = None if taken is None else cut(ends(taken).groupBy("namespace", "end").agg((cap - F.count(F.lit(1))).cast("int").alias("left")))
        for c in ("a", "b"):
            now = now.withColumn(f"left_{c}", F.lit(cap)) if room is None else now.join(room.select("namespace", F.col("end").alias(c), F.col("left").alias(f"left_{c}")), ["namespace", c], "left").withColumn(f"left_{c}", F.coalesce(f"left_{c}", F.lit(cap)))
        won = _greedy(now)
        if least is None:
            return won if taken is None else taken.unionByName(won)
        won = cut(won)
        taken = won if taken is None else taken.unionByName(won)
        full = cut(ends(taken).groupBy("namespace", "end").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= cap).drop("n"))
        left = left.filter((F.col("weight") < least) | F.col("weight").isNull())
        for c in ("a", "b"):
            left = left.join(full.withColumnRenamed("end", c), ["namespace", c], "left_anti")
        left = cut(left.select("namespace", "a", "b", "weight"))


def _greedy(edges: DataFrame) -> DataFrame:
    """The edges (namespace, a, b, weight, left_a, left_b) that are taken greedily, where ends have room for left_a and left_b more.

    Round by round every open edge is taken that is among the best open ones at both its ends, as many as these have room for: the
    greedy choice would take it too, as nothing before it can fill an end. Edges at full ends are dropped. The last REST open edges
    are decided by one task for each namespace.
    """
    import pandas as pd

    fields = edges.select("namespace", "a", "b", "weight")
    order = [F.desc("weight"), F.col("a"), F.col("b")]
    opened = cut(edges.select("namespace", "a", "b", "weight", "left_a", "left_b"))
    taken: DataFrame | None = None

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "a", "b"], ascending=[False, True, True])
        left: dict[int, int] = {}
        keep = []
        for a, b, la, lb in zip(pdf["a"], pdf["b"], pdf["left_a"], pdf["left_b"], strict=True):
            ra, rb = left.get(a, la), left.get(b, lb)
            keep.append(ra > 0 and rb > 0)
            if keep[-1]:
                left[a], left[b] = ra - 1, rb - 1
        return pdf[keep][["namespace", "a", "b", "weight"]]

    while True:
        n = opened.count()
        if n <= REST:
            rest = opened.groupBy("namespace").applyInPandas(finish, fields.schema)
            return rest if taken is None else taken.unionByName(rest)
        # every edge stands at both its ends
        ends = opened.select("*", F.explode(F.array(F.struct(F.col("a").alias("end"), F.col("left_a").alias("room")), F.struct(F.col("b").alias("end"), F.col("left_b").alias("room")))).alias("e")).select("namespace", "a", "b", "weight", "e.end", "e.room")
        place = F.row_number().over(Window.partitionBy("namespace", "end").orderBy(*order))
        ends = ends.withColumn("inside", place <= F.col("room"))
        both = ends.groupBy("namespace", "a", "b", "weight").agg(F.min("inside").alias("won"))
        now = cut(both)
        won = now.filter("won").drop("won")
        used = won.select("namespace", F.explode(F.array("a", "b")).alias("end")).groupBy("namespace", "end").agg(F.count(F.lit(1)).cast("int").alias("used"))
        room = ends.select("namespace", "end", "room").distinct().join(used, ["namespace", "end"], "left").select("namespace", "end", (F.col("room") - F.coalesce("used", F.lit(0))).alias("left"))
        side = lambda c: room.filter("left > 0").select("namespace", F.col("end").alias(c), F.col("left").alias(f"left_{c}"))
        opened = cut(now.filter("not won").drop("won").join(side("a"), ["namespace", "a"]).join(side("b"), ["namespace", "b"]).select("namespace", "a", "b", "weight", "left_a", "left_b"))
        taken = won if taken is None else taken.unionByName(won)


def near_duplicates(vectors: DataFrame, least: float = 0.92, topk: int = 10, same: list[str] | None = None) -> DataFrame:
    """(old, new, score): each row is superseded by the first later row of its namespace that is nearer than `least` and has it in its top k.

    Later rows have larger keys. The k nearest are taken among all earlier rows, of any namespace. What is nearer than a row over `least` is over it
    too, so no others are ranked.
    """
    near = knn(vectors.withColumnRenamed("key", "query_id"), vectors, topk, earlier=True, least=least, grid=True).filter(F.round("score", 6) > least)
    if same:
        of = lambda key: vectors.select(F.col("key").alias(key), *same)
        near = near.join(of("key"), "key").join(of("query_id"), ["query_id", *same], "left_semi")
    return near.groupBy(F.col("key").alias("old")).agg(F.min("query_id").alias("new"), F.min_by("score", "query_id").alias("score"))
