"""Ranks of a whole table by a distributed sort: places within a part, and what stands in the parts before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_parts


def ranked(rows: DataFrame, order: list[Column], copies: str | None = None) -> DataFrame:
    """rows with rank (1, 2, ... in this order); with copies, a row stands for so many and has the rank of the first.

    Rows are dealt by ranges of the order and written with their part, so a part's bounds are drawn once. A part's rows are counted, and a
    table of one row a part has what stands before it. Equal rows fall into one part: give rows that may be equal as copies.
    The order is sampled first, which computes rows twice: give a written table.
    """
    n = F.col(copies) if copies else F.lit(1)
    dealt = cut(rows.repartitionByRange(n_parts(rows.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum(n).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.withColumn("_to", F.sum(n).over(within)).join(F.broadcast(before), "_part")
    return placed.withColumn("rank", F.col("_before") + F.col("_to") - n + 1).drop("_part", "_before", "_to")
