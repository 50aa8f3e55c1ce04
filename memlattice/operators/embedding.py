"""Embedding with a cache by content, tries with growing waits, and failures kept apart."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import cut
from .vector import clean

#: Texts that a cache keeps, as defined.
CACHE = 10_000


@dataclass(frozen=True)
class Embedded:
    """vectors(key, v) of length 1, failed(key, error), and the cache(hash, v, used) for the next call."""

    vectors: DataFrame
    failed: DataFrame
    cache: DataFrame


def empty_cache(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame([], "hash string, v array<double>, used string")


def _asking(embedder: Callable[[pd.Series], pd.Series], tries: int, wait: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def ask(texts: pd.Series) -> tuple[pd.Series | None, str | None]:
        for n in range(tries):
            try:
                got = embedder(texts)
                if len(got) == len(texts):
                    return got, None
                error = f"{len(got)} vectors for {len(texts)} texts"
            except Exception as e:  # noqa: BLE001  whatever an embedder raises is its answer
                error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                time.sleep(wait * 2**n)
        return None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got, error = ask(pdf["text"])
            if got is not None:
                yield pd.DataFrame({"hash": pdf["hash"], "v": got.tolist(), "error": None})
            elif len(pdf) == 1:
                yield pd.DataFrame({"hash": pdf["hash"], "v": [None], "error": error})
            else:  # one bad text doesn't take its batch along
                each = [ask(pdf["text"].iloc[i : i + 1]) for i in range(len(pdf))]
                yield pd.DataFrame({"hash": pdf["hash"], "v": [None if g is None else g.iloc[0] for g, _ in each], "error": [e for _, e in each]})

    return run


def embed_cached(rows: DataFrame, cache: DataFrame, embedder: Callable[[pd.Series], pd.Series], dim: int, now: str, tries: int = 3, wait: float = 0.5, most: int = CACHE, text: str = "content") -> Embedded:
    """Vectors of rows(key, text), from the cache(hash, v, used) where it has the text's hash, else from the embedder.

    The embedder is asked once for each different new text: what it says is written before it is used. A batch that fails is tried again after wait, then twice
    that, and so on; after that its texts are asked for one by one. A text that still fails, and one whose vector is unsound (not of dim finite numbers, or zero), is reported for each of its rows and isn't
    cached. Null texts fail without being asked. The cache keeps the `most` texts last used (now is a time as text), of equal ones by hash.
    """
    hashed = rows.select("key", F.col(text).alias("text")).withColumn("hash", F.sha2("text", 256))
    known = cache.groupBy("hash").agg(F.max_by("v", "used").alias("v"), F.max("used").alias("used"))
    texts = hashed.filter("text is not null").groupBy("hash").agg(F.first("text").alias("text"))
    asked = cut(texts.join(known, "hash", "left_anti").mapInPandas(_asking(embedder, tries, wait), "hash string, v array<double>, error string"))
    sound = clean(asked.select(F.col("hash").alias("key"), "v"), dim)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    fresh = cut(sound.withColumn("_n", norm).select(F.col("key").alias("hash"), F.transform("v", lambda x: x / F.col("_n")).alias("v")))
    used = known.join(texts, "hash", "left_semi").withColumn("used", F.lit(now)).unionByName(known.join(texts, "hash", "left_anti"))
    kept = cut(used.unionByName(fresh.withColumn("used", F.lit(now))).orderBy(F.desc("used"), "hash").limit(most))
    vectors = hashed.join(known.select("hash", "v").unionByName(fresh), "hash").select("key", "v")
    lost = hashed.join(known, "hash", "left_anti").join(fresh, "hash", "left_anti").join(asked.select("hash", "error"), "hash", "left")
    reason = F.when(F.col("text").isNull(), "no text").otherwise(F.coalesce("error", F.lit("unsound vector")))
    return Embedded(vectors, lost.select("key", reason.alias("error")), kept)
