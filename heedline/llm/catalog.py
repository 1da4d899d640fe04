"""Registered queries of this subpackage, and the SQL for those that SQL can express."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedline.llm import bpe, chat, langid, linededup, lm, minhash, negatives, packing, spelling, substrings, tokencount, topk, winnow
from heedline.llm.common import documents, read_table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
CAPACITY, SEARCH_K, COPY_THRESHOLD = 1024, 5, 85


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), CAPACITY)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, SEARCH_K)


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(documents(spark, sf_dir))


def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_rows(read_table(spark, sf_dir, "conversations"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(documents(spark, sf_dir), COPY_THRESHOLD)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digests(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.edited_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(documents(spark, sf_dir))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", changed), F.col("vec_id") % 50 == 0)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(documents(spark, sf_dir))


_QUERIES = (
    op1_packing,
    op2_topk,
    op3_linededup,
    op4_preferences,
    op5_language,
    op6_bpe,
    op7_minhash,
    op8_fingerprints,
    op9_token_counts,
    op10_lm_scores,
    op11_spelling,
    op12_negatives,
    op13_substrings,
)

_TOPK_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM codes q JOIN codes c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk": _TOPK_SQL,
        "op3_linededup": linededup.SQL,
        "op4_preferences": chat.SQL,
        "op7_minhash": minhash.SQL,
        "op12_negatives": negatives.SQL,
        "op13_substrings": substrings.SQL,
    }
