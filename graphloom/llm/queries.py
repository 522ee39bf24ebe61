"""The corpus operators' queries over the driver tables, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = lambda spark, sf_dir: function(ship(spark), sf_dir)
    return function


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"), digest=True)


ORACLES["op4_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from graphloom.llm.byte_bpe import encode_digests

    return encode_digests(_table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken", PATTERN)


@_query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.near_dedup import near_dedup

    return near_dedup(_table(spark, sf_dir, "documents"))


@_query
def op2_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.ngram_lm import score_documents

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 1, F.lit(False))
    return score_documents(docs, docs.where(~held_out)).withColumn("held_out", held_out)


@_query
def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    from graphloom.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), "byte_bpe_50k.tiktoken", PATTERN)


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.language_id import identify, learn_profiles

    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    profiles = learn_profiles(docs.where(~held_out))
    return identify(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@_query
def op7_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "kept")


@_query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import find_spans, fit

    docs = _table(spark, sf_dir, "documents")
    return find_spans(docs, fit(docs))


@_query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


@_query
def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.topk_search import top_k, usable

    rows = _table(spark, sf_dir, "embeddings").where(usable(F.col("embedding")))
    vectors = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double"))).alias("vector"))
    return top_k(vectors.where("vec_id % 20 = 0"), vectors)


ORACLES["op10_topk_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.c, c.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
