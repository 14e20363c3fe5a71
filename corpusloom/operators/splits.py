"""Splits of authors, prompts and rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import hex_key, placed
from .pairs import shuffled

SHARES = {"train": 0.76, "val": 0.12, "test": 0.12}


def author_split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """(author_id, split): authors of several subjects go to train and count no
    further; the others, by books and then shuffled, each to the split where the
    summed squared relative distance of their subject's chunk counts to the shares is
    least (ties: train, val, test).  One row for each author of a subject is all a
    task holds."""
    many = rows.groupBy("author_id").agg(F.countDistinct("subject").alias("k"))
    single = rows.groupBy("subject", "author_id").agg(F.count("*").alias("chunks"), F.countDistinct("book_id").alias("books")).join(many.where("k = 1"), "author_id", "left_semi")

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        goal = [s * pdf.chunks.sum() for s in SHARES.values()]
        have, out = [0.0, 0.0, 0.0], []
        for author, chunks in pdf.sort_values(["books", "o"])[["author_id", "chunks"]].itertuples(index=False):
            cost = [sum(((have[j] + chunks * (i == j) - goal[j]) / max(goal[j], 1)) ** 2 for j in range(3)) for i in range(3)]
            best = cost.index(min(cost))
            have[best] += chunks
            out.append((author, list(SHARES)[best]))
        return pd.DataFrame(out, columns=["author_id", "split"])

    dealt = single.withColumn("o", shuffled(seed, "author_id")).groupBy("subject").applyInPandas(assign, "author_id string, split string")
    return dealt.unionByName(many.where("k > 1").select("author_id", F.lit("train").alias("split")))


def leakage(splits: DataFrame) -> DataFrame:
    """(split1, split2, n_authors) for each pair of splits: authors in both."""
    other = splits.select("author_id", F.col("split").alias("split2"))
    shared = splits.select("author_id", F.col("split").alias("split1")).join(other, "author_id").where("split1 < split2").groupBy("split1", "split2").agg(F.countDistinct("author_id").alias("n"))
    names = splits.sparkSession.createDataFrame([(a, b) for a in SHARES for b in SHARES if a < b], "split1 string, split2 string")
    return names.join(shared, ["split1", "split2"], "left").select("split1", "split2", F.coalesce("n", F.lit(0).cast("long")).alias("n_authors"))


def prompt_split(prompts: DataFrame, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Distinct prompts with their place in a seeded order and their split."""
    own = prompts.select("prompt").distinct().withColumn("o", shuffled(seed, "prompt"))
    ranked = placed(own, "place", hex_key(F.col("o")), "o", "prompt").select("prompt", "place")
    n = ranked.agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(n), how="cross").select("prompt", "place", F.when(F.col("place") < F.floor(F.col("n") * share), "train").otherwise("test").alias("split"))  # one row of totals
