"""Grouped statistics of scored pairs and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut
from .ordered import running


def _stats(score: str):
    q = lambda p: F.round(F.percentile(score, F.lit(p)), 4)
    return [
        F.count("*").alias("comparisons"), F.round(F.avg(score), 4).alias("mean"), F.round(F.stddev_samp(score), 4).alias("std"), q(0.5).alias("median"),
        F.round(F.min(score), 4).alias("min"), F.round(F.max(score), 4).alias("max"), q(0.25).alias("q25"), q(0.75).alias("q75"),
    ]


def overall(results: DataFrame) -> DataFrame:
    """Statistics by model, split, status and kind of pair, in this order, the
    base model before the fine-tuned one and kinds of pairs downwards.  Rows of null
    keys are left out; comparisons are all rows, scored or not."""
    own = results.dropna(subset=["model", "split", "status", "pair_type"]).groupBy("model", "split", "status", "pair_type").agg(*_stats("score"))
    return own.orderBy("model", F.col("split").try_cast("long"), "split", F.when(F.col("status") == "Base", 0).otherwise(1), F.desc("pair_type"))


def by_subject(results: DataFrame, least: int = 2) -> DataFrame:
    """The same by subject, without extremes; groups of fewer rows are left out."""
    own = results.dropna(subset=["model", "split", "status", "pair_type", "subject"]).groupBy("model", "split", "status", "pair_type", "subject").agg(*_stats("score"))
    return own.where(F.col("comparisons") >= least).drop("min", "max")


def box(results: DataFrame) -> DataFrame:
    """What a box plot shows: whiskers at 5 and 95 per cent, quartiles, median,
    and the lower end of the axis."""
    own = results.groupBy("model", "status", "pair_type").agg(F.percentile("score", F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95)))).alias("p"), F.min("score").alias("least"))
    names = ("low", "q25", "median", "q75", "high")
    return own.select("model", "status", "pair_type", *(F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(names)), F.round(F.greatest(F.lit(0.0), F.col("least") - 0.08), 6).alias("axis_low"))


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Mean and population deviation of raw and scaled scores by model, split and
    shot mode, beside the split's author (its name without ``_test``); other modes
    are skipped."""
    own = rows.where(F.col("shot_mode").isin("zero_shot", "few_shot"))
    r = lambda f, c: F.round(f(c), 6)
    own = own.groupBy("shot_mode", "model", "split").agg(r(F.avg, "raw").alias("mean_raw"), r(F.stddev_pop, "raw").alias("std_raw"), r(F.avg, "scaled").alias("mean_scaled"), r(F.stddev_pop, "scaled").alias("std_scaled"))
    return own.withColumn("author", F.replace("split", F.lit("_test"), F.lit("")))


def dataset_means(rows: DataFrame) -> DataFrame:
    """Rows, mean score and mean number of words of a dataset; means of nothing
    are 0."""
    mean = lambda c: F.coalesce(F.round(F.avg(c), 9), F.lit(0.0))
    return rows.agg(F.count("*").alias("n_rows"), mean("score").alias("mean_score"), mean("n_words").alias("mean_words"))


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and how many meet each condition."""
    return df.agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(name) for name, c in conditions.items()))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n, percent) of a column."""
    counts = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total), how="cross").select("value", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))  # one row of totals


def balance(pairs: DataFrame) -> DataFrame:
    """Whether subjects and labels are balanced: the widest gap of counts, and a
    verdict (subjects: no more than their number; labels: no more than 1)."""
    subjects = pairs.groupBy("subject").count().agg((F.max("count") - F.min("count")).alias("subject_gap"), F.count("*").alias("n_subjects"))
    labels = pairs.groupBy("label").count().agg((F.max("count") - F.min("count")).alias("label_gap"))
    return subjects.join(labels, how="cross").select("subject_gap", "label_gap", ((F.col("subject_gap") <= F.col("n_subjects")) & (F.col("label_gap") <= 1)).alias("balanced"))  # a row each


def _ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks: by distinct value, in ranges of values."""
    counts = cut(df.groupBy(column).agg(F.count("*").alias("_n")))
    upto = running(counts, F.col("_n"), "_upto", F.col(column))
    return df.join(upto.select(column, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(name)), column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation; null where a side is constant."""
    own = cut(df.select(F.col(x).alias("x"), F.col(y).alias("y")).dropna())
    own = _ranks(_ranks(own, "x", "rx"), "y", "ry")
    moments = own.agg(F.count("*").alias("n"), F.var_pop("rx").alias("vx"), F.var_pop("ry").alias("vy"), F.covar_pop("rx", "ry").alias("c"))
    return moments.select("n", F.when((F.col("vx") > 0) & (F.col("vy") > 0), F.round(F.col("c") / F.sqrt(F.col("vx") * F.col("vy")), 9)).alias("spearman"))
