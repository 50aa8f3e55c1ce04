"""Backups: a folder for each day with a Parquet table each and a manifest of rows and content hashes; kept by tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import backups_to_keep
from ..staging import discard


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash): the hash adds up over rows, so their order doesn't matter."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"))


def backup(spark: SparkSession, tables: dict[str, DataFrame], base: str, day: str, keep: dict[str, int] | None = None) -> None:
    """Write tables as the backup of a day (YYYY-MM-DD), then remove backups that their tier (monthly, weekly, daily) no longer keeps."""
    told = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{base}/day={day}/{name}")
        one = fingerprint(spark.read.parquet(f"{base}/day={day}/{name}")).select(F.lit(day).alias("day"), F.lit(name).alias("table"), "*")
        told = one if told is None else told.unionByName(one)
    told.coalesce(1).write.mode("overwrite").parquet(f"{base}/_manifests/{day}")  # a row for each table
    for r in backups_to_keep(backups(spark, base).select(F.col("day").cast("date").alias("day")), keep).filter("not kept").select(F.date_format("day", "yyyy-MM-dd").alias("day")).collect():
        discard(spark, f"{base}/day={r['day']}", f"{base}/_manifests/{r['day']}")


def _manifests(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema("day string, table string, rows long, hash string").option("recursiveFileLookup", True).parquet(f"{base}/_manifests/*")


def backups(spark: SparkSession, base: str) -> DataFrame:
    """(day, tier, tables, rows) of all backups."""
    day = F.col("day").cast("date")
    tier = F.when(F.dayofmonth(day) == 1, "monthly").when(F.dayofweek(day) == 2, "weekly").otherwise("daily")
    return _manifests(spark, base).groupBy("day").agg(F.count(F.lit(1)).alias("tables"), F.sum("rows").alias("rows")).withColumn("tier", tier)


def verify(spark: SparkSession, base: str, day: str) -> DataFrame:
    """(table, ok) of a backup: whether rows and content are those of its manifest."""
    out = None
    for r in _manifests(spark, base).filter(F.col("day") == day).collect():  # a row for each table
        now = fingerprint(spark.read.parquet(f"{base}/day={day}/{r['table']}"))
        one = now.select(F.lit(r["table"]).alias("table"), ((F.col("rows") == r["rows"]) & (F.col("hash") == r["hash"])).alias("ok"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"no backup of {day}")
    return out


def restore(spark: SparkSession, base: str, day: str, table: str) -> DataFrame:
    """A table of a backup; raises if it is broken."""
    if not verify(spark, base, day).filter((F.col("table") == table) & F.col("ok")).limit(1).count():
        raise ValueError(f"the backup of {table} of {day} is broken or not there")
    return spark.read.parquet(f"{base}/day={day}/{table}")


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path, for a bundle that moves to another place."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
