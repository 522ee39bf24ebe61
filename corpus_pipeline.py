"""From raw documents to packed training sequences: quality, exact duplicates, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import PATTERN
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, near_dedup, packing, pii, quality
from graphloom.llm.common import checked_broadcast
from graphloom.session import cut, ship, stored


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, by the labels of the labelled ones."""
    return quality.keep(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose texts are equal but for white space, the one with the smallest id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near-duplicates, the document with the smallest id; rows that share an id are one document, null ids stay."""
    ship(spark)
    dropped = near_dedup.near_dedup(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept")
    gone = checked_broadcast(cut(dropped.select(F.col("doc_id").alias("_dropped"))))
    return docs.join(gone, docs["doc_id"] == gone["_dropped"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text."""
    ship(spark)
    redacted = pii.redact(docs, pii.fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    ship(spark)
    return packing.pack_documents(docs, "byte_bpe_50k.tiktoken", PATTERN, with_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: The classifiers and the packing have no counterpart in SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
