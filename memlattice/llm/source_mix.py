"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Documents are dealt into shards by a seeded hash of their id. A shard of a source is a stream of tokens in seeded
order, cut into blocks of (nearly) equal length. Highest quotients weight / (2 k + 1) give each source its whole
number of blocks, and then each of its shards; a shard then takes all its blocks as often as its quota covers them, and once
more those that a seeded permutation puts first, up to the quota. The driver holds a row for each source and shard only.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import local_rows

#: Weights of the sources in code point order, repeating; what all targets add up to, and the most a source gives, in times of sizes.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2.0
#: Tokens of a block; documents of the largest source in a shard; shards of a source at most (beyond, shards grow; they are sorted, not held).
BLOCK, SHARD_DOCS, MAX_SHARDS = 64, 256, 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> list[float]:  # noqa: ANN001
    """Targets of the sources in their order: shares of total by weight, none above most times its size."""
    w = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    caps = most * np.array(sizes, float)
    out, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), total * float(sum(sizes))
    while free.any():
        share = left * w / w[free].sum()
        over = free & (share >= caps)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = caps[over]
        left -= caps[over].sum()
        free &= ~over
    return [float(x) for x in out]


def apportion(seats: int, weights: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Sainte-Laguë: seats to the highest quotients weight / (2 k + 1), none beyond most; ties to the earlier."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    seats = int(min(seats, most[weights > 0].sum())) if len(weights) else 0
    given = lambda x: np.minimum(np.floor(weights / x + 0.5).astype(np.int64), most)  # noqa: E731  quotients of at least x / 2
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    low, high = weights[weights > 0].min() / (2.0 * most.max() + 2), 2 * weights.max() + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
    got = given(high)
    while got.sum() < seats:  # those tied at the last quotient
        quotient = np.where(got < most, weights / (2 * got + 1), -1)
        got[int(quotient.argmax())] += 1
    return got


def _quotas(seed: int):
    """Quotas of one source's shards, by Sainte-Laguë, and a seeded permutation of each shard's blocks."""

    def run(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values("_shard")
        size = pdf["_total"].to_numpy(np.int64)
        n = np.where(size > 0, np.maximum(1, size // BLOCK), 0)
        quota = apportion(int(pdf["_quota"].iloc[0]), n, int(MOST) * n)
        steps, froms = [], []
        for shard, k in zip(pdf["_shard"], np.maximum(n, 1).tolist(), strict=True):
            rng = np.random.default_rng([seed, int(shard)])
            step = int(rng.integers(1, k + 1))
            while math.gcd(step, k) > 1:
                step = step % k + 1
            steps.append(step)
            froms.append(int(rng.integers(0, k)))
        return pdf.assign(_n=np.maximum(n, 1), _q=quota, _step=steps, _from=froms)[["_source", "_shard", "_total", "_n", "_q", "_step", "_from"]]

    return run


def mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...) with size, source_size, target, taken, whole and parts.

    A document's size is its number of words; its source's target is in words. `taken` words of it are in the mix: it
    stands there `whole` times, and `parts` lists the word ranges (start, length) taken once more. A null text has size 0; a
    null source is a source, the last in order. Rows of one or no doc_id are each mixed; equal ones share what is theirs in any
    order. Columns named like the six new ones are replaced, all others are passed on. An empty table gives no rows. Reruns agree.
    """
    new, kept = ("size", "source_size", "target", "taken", "whole", "parts"), "_kept"
    own = [c for c in docs.columns if c not in new]
    # the caller's columns travel in one, so that none of theirs meets one of these
    rows = docs.select(F.struct(*own).alias(kept), F.col("doc_id"), F.col("text"), F.col("source"))
    rows = rows.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    rows = rows.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    stats = rows.groupBy("_source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("c")).collect()
    stats.sort(key=lambda r: (not r["_source"], r["_source"].encode()))
    goal = targets([r["s"] for r in stats])
    shards = min(MAX_SHARDS, max(1, -(-max((r["c"] for r in stats), default=1) // SHARD_DOCS)))
    order = F.xxhash64(F.lit(seed), "doc_id", "text")
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text"), F.lit(shards)).cast("int")).withColumn("_order", order)
    cells = rows.groupBy("_source", "_shard").agg(F.sum("size").alias("_total"))
    blocks = {r["_source"]: r["n"] for r in cells.filter("_total > 0").groupBy("_source").agg(F.sum(F.greatest(F.lit(1), F.expr(f"_total div {BLOCK}"))).alias("n")).collect()}
    many = np.array([blocks.get(r["_source"], 0) for r in stats], np.int64)
    share = np.array([t / r["s"] * n if r["s"] else 0.0 for t, r, n in zip(goal, stats, many, strict=True)])
    quotas = apportion(round(share.sum()), share, int(MOST) * many) if stats else []
    told = local_rows(
        docs.sparkSession,
        _source=pa.array([r["_source"] for r in stats], pa.string()),
        _quota=pa.array([int(q) for q in quotas], pa.int64()),
        source_size=pa.array([int(r["s"]) for r in stats], pa.int64()),
        target=pa.array([float(t) for t in goal], pa.float64()),
    )
    plan = cells.join(told.select("_source", "_quota"), "_source").groupBy("_source").applyInPandas(_quotas(seed), "_source string, _shard int, _total long, _n long, _q long, _step long, _from long")
    by = Window.partitionBy("_source", "_shard").orderBy("_order", F.col("doc_id").asc_nulls_first(), "size")
    rows = rows.withColumn("_at", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(plan, ["_source", "_shard"]).join(told.drop("_quota"), "_source")
    block_of = lambda t: F.expr(f"(({t}) * _n - 1) div _total")  # noqa: E731  of the token before t
    first, last = block_of("_at + 1"), block_of("_at + size")
    chosen = F.filter(F.sequence(first, last), lambda j: F.pmod(j * F.col("_step") + F.col("_from"), F.col("_n")) < F.col("_q") % F.col("_n"))
    edge = lambda j: F.floor(j * F.col("_total") / F.col("_n")).cast("long")

    def part(j):  # noqa: ANN001, ANN202
        low, high = F.greatest(edge(j), F.col("_at")), F.least(edge(j + 1), F.col("_at") + F.col("size"))
        return F.struct((low - F.col("_at")).alias("start"), (high - low).alias("length"))

    none = F.array().cast("array<struct<start: bigint, length: bigint>>")
    rows = rows.withColumn("parts", F.when(F.col("size") > 0, F.transform(chosen, part)).otherwise(none)).withColumn("whole", F.expr("_q div _n"))
    more = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, x: acc + x["length"])
    rows = rows.withColumn("taken", F.col("whole") * F.col("size") + more)
    return rows.select(*(F.col(kept).getField(c).alias(c) for c in own), *new)


def mixed_text() -> Column:
    """A mixed document's text: the whole of it as often as it is taken, then its parts, each on lines of its own.

    A part is cut from the text as it stands, line breaks between its words included.
    """
    # every piece is a word and the white space after it; they are bound once for all parts of a text
    words = F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    part = lambda w, x: F.regexp_replace(F.array_join(F.slice(w, (x["start"] + 1).cast("int"), x["length"].cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    parts = F.flatten(F.transform(F.array(words), lambda w: F.transform("parts", lambda x: part(w, x))))
    none = F.array().cast("array<string>")
    return F.array_join(F.concat(F.array_repeat(F.col("text"), F.col("whole").cast("int")), F.when(F.size("parts") > 0, parts).otherwise(none)), "\n")
