"""A corpus pipeline: each stage works on all that the stage before it kept.

Stages take (spark, docs, sf_dir) and return a DataFrame; it is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlattice.llm.common import discard, scope, shared_dir
from memlattice.llm.jaccard_join import jaccard_components
from memlattice.llm.packing import pack_pow2
from memlattice.llm.quality import quality
from memlattice.llm.queries import grades, tokenizer_path
from memlattice.llm.source_mix import mix, mixed_text
from memlattice.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects.

    A null text is read as empty and, like an empty or very short one, scored near the average text, so it stays unless the model
    rejects that. Null and repeated doc_ids and repeated rows are each judged by their text; columns other than those of documents
    go; an empty table stays empty.
    """
    return quality(docs.select(COLUMNS), grades(spark, sf_dir)).filter("keep").select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id.

    Rows without an id stay, and so do null, empty and wordless texts, which link with nothing. Rows of one id are one document:
    they stay or go together. Columns other than those of documents go; an empty table stays empty.
    """
    gone = jaccard_components(docs).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.select(COLUMNS).join(gone, "doc_id", "left_anti").select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte windows that start earlier too; documents of which nothing is left go.

    A character that a removal cuts apart goes whole. Null, empty and short texts lose nothing and stay as they are. A null id
    comes first; of rows that are equal or share an id the later ones lose what the earlier have. n_chars follows the text where
    something was removed. Columns other than those of documents go; an empty table stays empty.
    """
    marked = docs.select(COLUMNS).withColumn("no_text", F.col("text").isNull())
    out = remove_repeats(marked, as_text=True, carry=("no_text", "lang", "source", "n_chars"))
    cut = F.size("spans") > 0
    out = out.filter(~cut | (F.length("kept") > 0)).withColumn("text", F.when(~F.col("no_text"), F.col("kept")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as often as the mix takes them, one row for each document; documents that it doesn't take go.

    Null, empty and wordless texts have no words to take and go. A document that is taken once and in part is followed by those
    parts, each on lines of its own. Rows without an id, of one id and of no source (a source of its own) are mixed as others; columns other than
    those of documents go; an empty table stays empty.
    """
    mixed = mix(docs.select(COLUMNS)).filter("taken > 0").withColumn("text", F.when((F.col("whole") == 1) & (F.size("parts") == 0), F.col("text")).otherwise(mixed_text()))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two length, with their bucket.

    A null or empty text is its end mark alone. Ids, null or repeated, are passed on; each row is packed; columns other than
    doc_id and text go; an empty table stays empty.
    """
    return pack_pow2(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("jaccard", one_of_each_group), ("repeats", without_repeats), ("mix", to_weights), ("pack", packed)]
#: The learned and byte-wise stages are not SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents; what each returns is written to the shared folder and reread.

    What a stage read, and what its operator wrote on the way, is removed once the stage's rows are written; the last stage's stay.
    """
    docs, base, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with scope(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before:
            discard(spark, before)
        before = f"{base}/{name}"
        docs = spark.read.parquet(before)
    return docs
