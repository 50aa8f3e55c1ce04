"""What the corpus operators share: the session's partition count, the shared folder, row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import cut, discard, scope, shared_dir  # noqa: F401  what the operators write on their way
from .kernels import forget

#: Key that stands for a null id while rows travel; it sorts before every other id.
NULL_ID = -(2**63)


def n_parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session is set; it is expected to grow with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, _c0 ..., _d, _r): _d is the id without nulls, _r tells rows of one id apart (ordered by text).

    _c0 and so on are the columns named in carry.

    Only when some id does repeat are the rows ranked, which shuffles them; else _r is a literal 0.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)))
    rows = rows.withColumn("_d", F.coalesce("doc_id", F.lit(NULL_ID)))
    repeated = rows.groupBy("_d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if not repeated:
        return rows.withColumn("_r", F.lit(0))
    by = Window.partitionBy("_d").orderBy(F.col("text").asc_nulls_first())
    return rows.withColumn("_r", F.row_number().over(by) - 1)


#: Bytes of an Arrow batch on its way to Python, unless the session says otherwise; both sides hold some of them at once.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def give_back() -> None:
    """Give the process's tables and its freed memory back: the worker may go on with another operator."""
    forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def local_rows(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A few rows that the driver has. They go as Arrow: a list of rows would go through Python workers of another kind, which the executors then keep."""
    return spark.createDataFrame(pa.table(columns))


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:  # noqa: ANN001
    """mapInArrow in bounded batches; a worker gives its freed memory back at the end of each partition."""
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)

    def frugal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(frugal, schema)
