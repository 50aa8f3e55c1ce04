"""Nearest neighbours by a block matrix join of int8 tiles with error bounds.

Vectors are scaled to length 1, rounded to int8 with a scale and an error norm for each, and packed in blocks. Blocks are
dealt into a grid: every block of queries meets every block of candidates in one cell, as one tile: an int8 product (exact in
float32, as 127 * 127 * d stays under 2 ** 24 for d up to 1040; wider vectors use float64). |q.x - approx| <= |eq| * |x'| +
|ex| * |q|, so a candidate whose upper bound is under the query's k-th best score so far, or under the k-th best lower bound of
the tile, can't be among the k nearest. The survivors are recomputed from the original vectors in double precision and go to
the query's heap, which is carried from tile to tile of a cell; the cells' heaps are merged by query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, n_parts
from .kernels import U64, mix
from .vectors import cosines, matrices, usable

#: Vectors in a block of candidates and of queries.
BLOCK, QUERIES = 2048, 512
_PARTS = ("n", "ids", "data", "code", "scale", "error")
_schema = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in _PARTS[1:])])


def _blocks(rows_in_block: int, parts: int):
    """Blocks of quantised vectors, each dealt to a part of the grid by a hash of its first id and its place, as ids share factors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for rows, x in matrices(batch.column("v")):
                top = np.abs(x).max(axis=1, keepdims=True)
                unit = x / top
                unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
                scale = np.abs(unit).max(axis=1) / 127
                code = np.rint(unit / scale[:, None]).astype(np.int8)
                error = np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
                for s in range(0, len(rows), rows_in_block):
                    e = slice(s, s + rows_in_block)
                    blob = [np.ascontiguousarray(a).tobytes() for a in (ids[rows[e]], x[e], code[e], scale[e], error[e])]
                    part = int(mix(mix(np.array([place], np.int64).view(U64)) ^ np.array([ids[rows[s]]], np.int64).view(U64))[0] % U64(parts))
                    place += 1
                    row = dict(zip(_schema.names, (part, x.shape[1], len(rows[e]), *blob), strict=True))
                    yield pa.RecordBatch.from_pylist([row], schema=_schema)

    return run


def _tiles(k: int):
    """The k best of each query in each cell; rows come cell by cell."""

    def read(row: dict, side: str) -> tuple[np.ndarray, ...]:
        n, d = row["n" + side], row["dim"]
        get = lambda c, t: np.frombuffer(row[c + side], t)
        return get("ids", np.int64), get("data", np.float64).reshape(n, d), get("code", np.int8).reshape(n, d), get("scale", np.float64), get("error", np.float64)

    def tile(row: dict, heaps: dict[bytes, list[list[tuple[float, int]]]]) -> None:
        qi, qx, qc, qs, qe = read(row, "_q")
        ci, cx, cc, cs, ce = read(row, "_c")
        held = heaps.setdefault(row["ids_q"] + row["data_q"], [[] for _ in qi])
        exact = np.float32 if row["dim"] <= 1040 else np.float64
        near = (qc.astype(exact) @ cc.astype(exact).T).astype(np.float64) * qs[:, None] * cs[None, :]
        slack = qe[:, None] * (1 + ce)[None, :] + ce[None, :] + 1e-9
        own = qi[:, None] == ci[None, :]
        low = np.where(own, -np.inf, near - slack)
        bound = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(qi), -np.inf)
        bound = np.maximum(bound, [h[0][0] if len(h) == k else -np.inf for h in held])
        q, c = np.nonzero((near + slack >= bound[:, None]) & ~own)
        for i, score, key in zip(q.tolist(), cosines(qx[q], cx[c]).tolist(), ci[c].tolist(), strict=True):
            if len(held[i]) < k:
                heapq.heappush(held[i], (score, -key))
            else:
                heapq.heappushpop(held[i], (score, -key))

    def emit(heaps: dict[bytes, list[list[tuple[float, int]]]]) -> Iterator[pa.RecordBatch]:
        for block, held in heaps.items():
            ids = np.frombuffer(block, np.int64, len(held))
            got = [(int(i), -key, score) for i, heap in zip(ids, held, strict=True) for score, key in heap]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, heaps = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["c"], row["q"], row["dim"]) != cell:
                    yield from emit(heaps)
                    cell, heaps = (row["c"], row["q"], row["dim"]), {}
                tile(row, heaps)
        yield from emit(heaps)

    return run


def _merge(k: int):
    """The k best of each query over all cells, ranked; rows come sorted by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []
        out: list[tuple[int, int, int, float]] = []

        def close() -> None:
            out.extend((query, n + 1, -key, score) for n, (score, key) in enumerate(sorted(heap, reverse=True)))

        def rows() -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(types)], names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, key, score in zip(*(batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")), strict=True):
                if q != query:
                    close()
                    query, heap = q, []
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, (score, -key))
            if out:
                yield rows()
                out.clear()
        close()
        yield rows()

    return run


def grid(parts: int, vectors: int, queries: int) -> tuple[int, int]:
    """Parts of the candidates and of the queries, about `parts` cells together, that copy the fewest vectors."""
    q = min(parts, max(1, round((parts * queries / max(1, vectors)) ** 0.5)))
    return max(1, parts // q), q


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors nearest to each query by cosine, ties to the smaller vec_id.

    vectors and queries have (vec_id, embedding). A query's own row (its vec_id) is no candidate; if there are fewer
    than k, all are given. Null ids and null, zero or not finite vectors take no part on either side; vectors of another
    dimension than the query's are no candidates. Of rows that share an id each counts as a query or candidate of that
    id (so a candidate may stand twice in such a query's list). Other columns are ignored; an empty side gives no rows.
    """
    p = n_parts(vectors.sparkSession)
    c, q = grid(p, vectors.count(), queries.count())
    ddl = "part int, dim int, n int, ids binary, data binary, code binary, scale binary, error binary"
    named = lambda side: [F.col(x).alias(x + side) for x in _PARTS]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = usable(vectors).transform(in_arrow, _blocks(BLOCK, c), ddl).select(F.col("part").alias("c"), every(q).alias("q"), "dim", *named("_c"))
    asked = usable(queries).transform(in_arrow, _blocks(QUERIES, q), ddl).select(every(c).alias("c"), F.col("part").alias("q"), "dim", *named("_q"))
    found = held.join(asked, ["c", "q", "dim"]).transform(in_arrow, _tiles(k), "query_id long, vec_id long, score double")
    return found.repartition(p, "query_id").sortWithinPartitions("query_id").transform(in_arrow, _merge(k), "query_id long, rank int, vec_id long, score double")
