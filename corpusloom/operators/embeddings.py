"""Texts to vectors with a pluggable encoder, and scores against references.

An encoder is made by a factory in each Python worker, once, and takes lists of
texts; distinct texts are encoded once and joined back by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores
from .ordered import placed

Encoder = Callable[[list[str]], np.ndarray]


def hashed_words(width: int = 16) -> Encoder:
    """An encoder without a model: counts of blank-separated words in buckets by
    their md5."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts, strict=True):
            for word in text.split(" "):
                if word:
                    row[int(hashlib.md5(word.encode()).hexdigest()[:7], 16) % width] += 1
        return out

    return encode


def encoded(texts: DataFrame, factory: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """(text_md5, embedding) of each distinct text, at length 1; null counts as
    empty, and an encoder's zero vector stays as it is."""

    @F.pandas_udf("array<double>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = factory()
        for part in parts:
            rows: list[np.ndarray] = []
            for at in range(0, len(part), batch):
                vectors = encoder(part.iloc[at : at + batch].tolist())
                size = np.linalg.norm(vectors, axis=1, keepdims=True)
                rows.extend(vectors / np.where(size > 0, size, 1))
            yield pd.Series(rows, dtype=object)

    own = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    own = own.groupBy(F.md5("text").alias("text_md5")).agg(F.any_value("text").alias("text"))
    return own.select("text_md5", encode("text").alias("embedding"))


def with_embeddings(rows: DataFrame, vectors: DataFrame, column: str = "text", name: str = "embedding") -> DataFrame:
    """Rows with the vector of one of their text columns."""
    own = vectors.select(F.col("text_md5").alias("_md5"), F.col("embedding").alias(name))
    return rows.withColumn("_md5", F.md5(F.coalesce(column, F.lit("")))).join(own, "_md5").drop("_md5")


def scored(pairs: DataFrame, factory: Callable[[], Encoder], batch: int = 32) -> DataFrame:
    """Pairs (text, reference, ...) with the cosine of both: ``score``; null
    where one of them has no vector but zero."""
    both = pairs.select("text").unionByName(pairs.select(F.col("reference").alias("text")))
    vectors = encoded(both, factory, batch)
    own = with_embeddings(with_embeddings(pairs, vectors, "text", "_a"), vectors, "reference", "_b")
    return own.withColumn("score", scores.cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def dealt(tasks: DataFrame, workers: int, cost: Column, *order: str) -> DataFrame:
    """Tasks with the ``worker`` that takes them: by falling cost (ties by the order
    given) to the workers to and fro, so that each has the same number of dear ones."""
    own = placed(tasks.withColumn("_cost", -cost), "_at", F.col("_cost"), *order)
    turn = F.col("_at") % (2 * workers)
    return own.withColumn("worker", F.least(turn, 2 * workers - 1 - turn).cast("int")).drop("_cost", "_at")


def fan_out(tasks: DataFrame, workers: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, cost: Column | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Tasks dealt to so many workers, evenly or by their cost, each of which takes
    them in batches; a lost worker's tasks are done again."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield work(part)

    if cost is None:
        return tasks.repartition(workers).mapInPandas(run, schema)
    own = dealt(tasks, workers, cost, *order)
    return own.repartitionById(workers, F.col("worker")).mapInPandas(run, schema)
