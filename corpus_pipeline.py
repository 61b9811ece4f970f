"""A training corpus from the documents table, in five stages; each reads what the one before it wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremolite.llm import bpe, langid, mixing, near_dedup, secrets
from tremolite.llm.common import staged

#: The columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text of so many characters whose best language has a lower cosine is in none of the languages: three times the spread of
#: the cosine of two random vectors. Shorter texts have too few grams to tell.
LEAST_COSINE, LEAST_CHARS = 3 / langid.DIMS**0.5, 64


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the corpus has: not ``und``, and near enough to the language's prototype.

    Texts that are null, empty or without a letter go; short ones with a letter stay. Repeated rows are judged alike; no document, none kept.
    """
    protos = langid.prototypes(docs.filter(~langid.held_out()))
    found = langid.add_language(docs.select(*COLUMNS), protos)
    near = (F.col("score") >= LEAST_COSINE) | (F.length("text") < LEAST_CHARS)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & near).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, 0.8), the one with the least doc_id."""
    return near_dedup.representatives(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts a mark in the place of each secret; every document stays, a null text as it is, and repeated rows are treated alike."""
    found = secrets.redact(secrets.find_secrets(docs))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes its words, to the nearest whole number; some are left out.

    Rows equal in doc_id and text are each repeated as often as the one of them taken most. Documents without words are left out.
    """
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(-1)).alias("__id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__hash"))
    copies = mixing.mix_sources(keyed, carry=("__id", "__hash")).withColumn("copies", F.expr("if(size > 0, CAST(round(taken / size) AS int), 0)"))
    copies = copies.groupBy("__id", "__hash").agg(F.max("copies").alias("copies")).filter("copies > 0")
    return keyed.join(copies, ["__id", "__hash"]).withColumn("__copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes, one row a copy; a null text counts as empty."""
    return bpe.bpe_report(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", byte_level_bpe),
]

#: Hashes, random vectors and token merges have no SQL form; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table, each stage's rows written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
