"""Connected components of a graph whose links and nodes stay distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_arrow

#: Links held by one local contraction; more are contracted in several lots.
LOT = 1_000_000


def contract(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star (node, smallest node) for each component of the links a-b."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = inverse[: len(a)], inverse[len(a) :]
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop
        keep = label[u] != label[v]
        u, v = u[keep], v[keep]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lot: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def flush() -> pa.RecordBatch:
        a, b = contract(np.concatenate([x[0] for x in lot]), np.concatenate([x[1] for x in lot]))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        lot.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held >= LOT:
            out = flush()
            lot, held = [(out.column(0).to_numpy(), out.column(1).to_numpy())], 0
    if lot:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link in (a long, b long); component is the smallest node reached.

    Each partition first contracts its links to stars. Then stars are joined by turns of
    large-star and small-star, each a min per node (combined before the shuffle) and a join on the
    node, until the links no longer change. Links to itself and null ends are ignored; no rows give no rows.
    """
    stars = cut(links.select("a", "b").filter("a is not null and b is not null and a <> b").transform(in_arrow, _contract_partition, "a long, b long"))
    before = None
    while True:
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        stars = cut(small.filter("a <> b").distinct())
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(stars.select(F.col("b"), F.col("b")).distinct())
