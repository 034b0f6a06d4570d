"""A training corpus from raw documents: language, near-duplicates, personal data, mixture, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read back as
the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erascope.llm.bpe import encoded
from erascope.llm.common import staged, table
from erascope.llm.language import keep_identified
from erascope.llm.mixture import take
from erascope.llm.near_copies import keep_one_of_near_copies
from erascope.llm.pii import mask_personal_data

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without any letter go."""
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity of five-word shingles 0.8 or more): the one with the smallest id."""
    return keep_one_of_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and access keys replaced by their kind in brackets; ``n_chars`` follows the text."""
    masked = mask_personal_data(docs)
    return masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that the sources reach their targets."""
    return take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids, ids_sha256, decoded_sha256`` of every document of the mix."""
    found = docs.select("doc_id", "lang", "source", encoded(docs, VOCABULARY, keep_ids=True).alias("found"))
    return found.select("doc_id", "lang", "source", "found.n_tokens", "found.ids", "found.ids_sha256", "found.decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", mixture),
    ("bpe_encoding", tokens),
]

# Byte-pair encoding cannot be said in SQL; the tests compare with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
