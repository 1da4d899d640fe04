"""The corpus pipeline: language ID, line dedup, near-duplicate removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again
as the docs of the next; all but the last return the columns of ``documents``.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heedline.llm import langid, linededup, minhash, packing
from heedline.llm.catalog import BYTE_BPE, CAPACITY
from heedline.llm.common import documents, durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A document goes if no language is told or the best one has less than half of the probability.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language.

    A document goes if its text is null or empty, has no letter, or its best language has a score
    below MIN_LANGUAGE_SCORE, and all go if no row with a language may be learned from.  Equal rows
    fare alike, and so do rows without doc_id, which are not learned from.  Texts of any length are
    read whole.  Extra columns go.  No rows give no rows.
    """
    network = langid.learn(docs, langid.fold() != 0)
    found = langid.identify(docs.select(*COLUMNS), network)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)
    return found.where(sure).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three documents share, except in the last; documents left empty go.

    The last is the one with the largest doc_id; rows with one doc_id count once and lose the same
    lines, rows without are told apart by their text and come after all others.  A document that had
    no text before stays as it is.  ``n_chars`` is counted again.  Extra columns go.  No rows give no
    rows.
    """
    kept = linededup.drop_lines(docs.select(*COLUMNS))
    emptied = (F.col("n_dropped") > 0) & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    kept = kept.where(~emptied).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the smallest doc_id.

    Documents are linked at a similarity of 0.8 of their sets of five words; groups are what links
    join.  Null, empty and blank texts are linked with nothing and stay.  Rows with one doc_id and one
    text are one document, of which one row stays; of rows without doc_id one with the same text.
    Extra columns go.  No rows give no rows.
    """
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs)
    # Rows with equal id and text are one document, of which one row stays.
    first = found.where("first").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    here = F.xxhash64(F.coalesce("text", F.lit("")))
    kept = docs.join(first.distinct(), docs["doc_id"].eqNullSafe(F.col("__id")) & (here == F.col("__hash")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of token ids: a row per piece with its ids and its place.

    A null or empty text is one piece with the end id alone; only documents of more than CAPACITY ids
    are cut.  Equal rows and rows without doc_id are packed each for itself.  Extra columns go.  No rows
    give no rows.
    """
    return packing.packed_documents(docs, public_tokenizers.path(BYTE_BPE), CAPACITY, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

# Tokens and the network are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
