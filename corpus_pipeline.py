"""The training-data pipeline: five stages over ``documents``.

Each stage takes what its predecessor kept (written as Parquet in between) and
returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, common, decontaminate, langid, ngram_join, queries, suffixes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Texts of which a smaller share of n-grams belongs to their best language go.
LEAST_LANGUAGE_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or in none of the learned languages."""
    kept = langid.filter_documents(docs.select(*COLUMNS), LEAST_LANGUAGE_SCORE)
    return kept.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each class of near duplicates."""
    return ngram_join.keep_one(docs.select(*COLUMNS)).select(*COLUMNS)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts 50-byte strings that an earlier document has.  What is left of a
    character cut in two goes as well."""
    kept = suffixes.remaining_texts(docs.select(*COLUMNS), "lang", "source")
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item.  Null and empty texts hold none and
    stay, as do all documents where the benchmark is empty."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text, with the digest of what decoding gives back.  Null and
    empty texts have no tokens and the digest of nothing."""
    return bpe.encode_with_digest(docs.select("doc_id", "text"), queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.tokenizer_pattern())


STAGES = [
    ("language", language),
    ("ngram_join", near_duplicates),
    ("suffix_dedup", repeated_strings),
    ("decontaminate", benchmark),
    ("tokens", tokens),
]

#: The stages are beyond SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; what a stage
    wrote is deleted when the next one has written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    folder = common.shared_folder(spark)
    for name, stage in STAGES[:-1]:
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
