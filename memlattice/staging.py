"""Tables written on the way of iterative plans: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that cut() writes in the scope that this thread is in; none outside of scopes.
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. A local session without one (tests) gets a temporary folder, which is set as spark.checkpoint.dir.

    On a cluster a machine's own folder would lose rows without an error, so a session without the setting is refused there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="memlattice-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Write df to the shared folder, with these options of the writer, and read it back. The files stay, as what is read from them is lazy; those of a scope go with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    schema, made = df.schema, _scope.get()
    if made is not None:
        made.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with a number from 1 in this order, which must leave no ties open: sorted by ranges, numbered within each, ranges' sizes summed before."""
    placed = cut(df.orderBy(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + own).drop("_range", "_before")


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Write what is made within before the end: what cut() wrote within (in this thread, and not in a scope of its own) is removed then.

    What others cut, before or in other threads, stays; so a result that is still lazy isn't touched by another's scope.
    """
    made: list[str] = []
    token = _scope.set(made)
    try:
        yield
    finally:
        _scope.reset(token)
        discard(spark, *made)


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove these folders."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
