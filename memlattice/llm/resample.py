"""Target-distribution importance resampling in DataFrame functions alone.

Texts are cut in words and their n-grams exploded; a feature's bucket is the crc32 of its bytes modulo the buckets. Counts for each bucket
of the corpus and of the target give a table of gains, one row a bucket and so of bounded size, which is broadcast to the exploded features. A
document's gains are summed, a Gumbel draw made from a hash of its id is added, and the highest sums are drawn: a
sample without replacement in proportion to exp(weight). The draw is a distributed sort with ranks by offsets of its parts.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .ranks import ranked

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, letters and all that isn't ASCII, only A-Z lower-cased; none for a null."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, _NO_WORD), "")


def features(of: Column, shortest: int, longest: int) -> Column:
    """All runs of shortest to longest words of an array, joined by one space."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(of) >= n, F.sequence(F.lit(1), F.size(of) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return of if n == 1 else F.transform(starts, lambda i: F.array_join(F.slice(of, i, n), " "))

    return F.concat(*(runs(n) for n in range(shortest, longest + 1))) if longest > shortest else runs(shortest)


def bucket(feature: Column, buckets: int) -> Column:
    return F.crc32(feature.cast("binary")) % buckets


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS, ngrams: tuple[int, int] = (1, 1)) -> DataFrame:
    """(bucket, gain) of every bucket that the corpus uses: floor(1000 ln) of the smoothed ratio of shares, target over corpus."""

    def counts(table: DataFrame, name: str) -> DataFrame:
        exploded = table.select(F.explode(features(words(F.col("text").cast("string")), *ngrams)).alias("f"))
        return exploded.select(bucket(F.col("f"), buckets).alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    both = counts(corpus, "s").join(counts(target, "t"), "bucket", "full").na.fill(0)
    everything = Window.partitionBy(F.lit(0))  # a row a bucket at most
    real = {c: F.col(c).cast("double") for c in "st"} | {c.upper(): F.sum(c).over(everything).cast("double") for c in "st"}
    ratio = (real["t"] + 1) * (real["S"] + buckets) / ((real["s"] + 1) * (real["T"] + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, ngrams: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): how well a document fits the target, and its place in the draw.

    docs has (doc_id, text), target has (text). Of the documents with least_words at least the percent with the highest scores are drawn, ties to the
    smaller doc_id; all others have a null rank. Null and empty texts have no features and weight 0; without any target text
    every bucket's gain compares with an empty target; a null doc_id is hashed as an empty one and comes first among
    ties. Rows of one id are drawn each by its text, in the order of their features where they tie; equal rows are one with a count until they are ranked, so
    they are no hot key. Other columns are ignored; empty docs give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(texts, target, buckets, ngrams)
    split = texts.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    exploded = split.select("doc_id", "h", F.size("w").alias("n_words"), F.posexplode_outer(features(F.col("w"), *ngrams)).alias("i", "f"))
    summed = exploded.withColumn("bucket", bucket(F.col("f"), buckets)).join(F.broadcast(gain), "bucket", "left").groupBy("doc_id", "h", "n_words").agg(
        F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, 1)).alias("copies"), F.count("f").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    drawn_by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn_by, 1, 8), 16, 10).cast("double")
    each = lambda c: F.expr(f"{c} div copies")  # noqa: E731  sums are over all copies
    scored = summed.select("doc_id", "h", F.col("n_words").cast("long").alias("n_words"), "copies", each("n_features").alias("n_features"), each("weight").alias("weight"))
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(scored.withColumn("score", (F.col("weight") + gumbel).cast("long")))
    able = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("h")]
    size = scored.filter(able).agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first()["n"]
    placed = ranked(scored.filter(able), order, "copies").unionByName(scored.filter(~able).withColumn("rank", F.lit(None).cast("long")))
    every = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("rank", F.col("rank") + F.col("copy"))
    return every.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("rank") <= percent * size // 100, F.col("rank")).alias("rank"))
