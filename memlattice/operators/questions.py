"""Vectors of questions that a text answers: a build that can be resumed, and search over content and question roads."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import cut, scope
from .embedding import embed_cached, empty_cache
from .vector import knn

_STORED = "key long, question string, v array<double>, error string"


def _complete(spark: SparkSession, path: str) -> list[str]:
    """Folders of the build whose writing ended: the mark of success is written last."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(at(path)) if f.isDirectory())
    return [f"{path}/{n}" for n in names if fs.exists(at(f"{path}/{n}/_SUCCESS"))]


def stored(spark: SparkSession, path: str) -> DataFrame:
    """(key, question, v, error) of all complete lots; a row without questions has neither question nor error."""
    return spark.read.schema(_STORED).parquet(*found) if (found := _complete(spark, path)) else spark.createDataFrame([], _STORED)


def build(rows: DataFrame, path: str, questions: Callable[[pd.Series], pd.Series], embedder: Callable[[pd.Series], pd.Series], dim: int, lots: int = 16, text: str = "content") -> DataFrame:
    """(key, question, v) for rows(key, text), by a function from texts to lists of questions and one from questions to vectors.

    Rows are taken in lots by a hash of their key, and each lot is a folder that counts once it is whole. Started again, after a stop or with more rows, it asks only for
    rows that no whole lot has or that failed there; so an interrupted build ends as an uninterrupted one. Both functions get Arrow batches; a question is embedded once in a lot however often
    it is asked. Blank and repeated questions of a row are dropped. A row of a batch whose questions can't be made, and a question that can't be embedded, is stored with its error.
    """
    spark = rows.sparkSession

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                got, error = [list(q) for q in questions(pdf["text"])], None
            except Exception as e:  # noqa: BLE001  whatever it raises is its answer
                got, error = [[] for _ in range(len(pdf))], f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"key": pdf["key"], "asked": got, "error": error})

    lot = F.pmod(F.xxhash64("key"), F.lit(lots))
    for n in range(lots):
        done = stored(spark, path).groupBy("key").agg(F.max(F.col("error").isNotNull()).alias("failed")).filter("not failed").select("key")
        todo = rows.filter((lot == n) & F.col(text).isNotNull()).select(F.col("key").cast("long").alias("key"), F.col(text).alias("text")).join(done, "key", "left_anti")
        if not todo.limit(1).count():
            continue
        with scope(spark):
            said = cut(todo.mapInPandas(ask, "key long, asked array<string>, error string"))
            clean = F.array_distinct(F.filter(F.transform("asked", lambda q: F.trim(q)), lambda q: q != ""))
            each = said.select("key", "error", F.explode_outer(clean).alias("question"))
            texts = each.filter("question is not null").select("question").distinct().withColumn("key", F.col("question"))
            got = embed_cached(texts, empty_cache(texts), embedder, dim, "now", text="question", most=0)
            placed = each.join(got.vectors.withColumnRenamed("key", "question"), "question", "left").join(got.failed.select(F.col("key").alias("question"), F.col("error").alias("_e")), "question", "left")
            out = placed.select("key", "question", "v", F.coalesce("error", "_e").alias("error"))
            out.write.parquet(f"{path}/lot-{n:05d}-{uuid.uuid4().hex}")
    best = Window.partitionBy("key", "question").orderBy("question")
    whole = stored(spark, path).filter("v is not null")
    return whole.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select("key", "question", "v")


def search(queries: DataFrame, roads: dict[str, DataFrame], k: int, same: list[str] | None = None) -> DataFrame:
    """(query_id, key, score, source): the k keys of largest positive cosine over all roads, with the road that gave it; of equal ones the first road.

    A road is (key, v, *same) and may have several vectors for a key, of which the nearest counts; as many are fetched as k keys can have.
    """
    found = None
    for place, (name, road) in enumerate(roads.items()):
        most = road.groupBy("key").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
        one = knn(queries.select("query_id", "v", *(same or [])), road, k * most, same=same).withColumn("source", F.struct(F.lit(-place).alias("place"), F.lit(name).alias("name")))
        found = one if found is None else found.unionByName(one)
    by = found.filter("score > 0").groupBy("query_id", "key").agg(F.max(F.struct(F.round("score", 12).alias("r"), "source", "score")).alias("b"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("b.score", 6)), "key")
    return by.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k).select("query_id", "key", "b.score", F.col("b.source.name").alias("source"))
