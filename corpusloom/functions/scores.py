"""Scores, rewards and vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip

#: Calibration of raw cosines, and the reward's weights.
LOW, HIGH = 0.0597, 0.8192
WEIGHTS = (0.6, 0.3, 0.1)


def integrity(r1: Column, r2: Column) -> Column:
    """What two texts masked at these ratios still share."""
    return F.sqrt((1 - r1 * r1) * (1 - r2 * r2))


def zoned(value: Column, same: bool) -> Column:
    """A graded score: 0.5 to 1 for one author, 0 to 0.5 for two."""
    n = (F.greatest(value, F.lit(0.19)) - 0.19) / 0.81
    return 0.5 + 0.5 * n if same else 0.5 * (1 - n)


def to_bin(score: Column) -> Column:
    """Tenths, half to even, from 0.1 to 0.9."""
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.bround(score * 10) / 10))


def ratio_bins(spark, ratios: DataFrame | None = None) -> DataFrame:
    """(kind, r1, r2, bin) of all unordered pairs of ratios (``r``, ten tenths where
    none are given); pairs of two authors have both ratios above 0."""
    r = spark.range(10).select((F.col("id") / 10).alias("r")) if ratios is None else ratios
    pairs = r.select(F.col("r").alias("r1")).join(r.select(F.col("r").alias("r2")), F.col("r1") <= F.col("r2"))
    value = F.round(integrity(F.col("r1"), F.col("r2")), 12)
    bins = lambda kind, own, same: own.select(F.lit(kind).alias("kind"), "r1", "r2", to_bin(F.round(zoned(value, same), 9)).alias("bin"))
    return bins("same", pairs, True).unionByName(bins("cross", pairs.where("r1 > 0 and r2 > 0"), False))


def rescale(raw: Column, low: float = LOW, high: float = HIGH) -> Column:
    """A raw cosine on the calibrated range, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw - low) / (high - low)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of a row; null for a zero vector."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def normalised(v: Column) -> Column:
    """The vector at length 1."""
    return F.transform(v, lambda x: x.cast("double") / F.sqrt(dot(v, v)))


def completeness(n_words: Column, text: Column) -> Column:
    """Reward of a story's length, 0 unless it ends with its end mark."""
    over = 1 - F.sqrt(F.greatest(n_words - 1600, F.lit(0)) / 1500.0)
    text = strip(text)
    end = F.right(F.rtrim(text, F.lit(".!")), F.lit(len("THE END")))
    length = F.when((F.length(text) == 0) | (n_words < 500), 0.0).when(n_words < 1200, n_words / 1200.0).when(n_words <= 1600, 1.0).otherwise(F.greatest(F.lit(0.0), over))
    return F.when(end.rlike(r"(?Ui)THE\s?END\z"), length).otherwise(0.0)


def weighted(style: Column, content: Column, complete: Column) -> Column:
    """The weighted reward."""
    return WEIGHTS[0] * style + WEIGHTS[1] * content + WEIGHTS[2] * complete


def judged(base: Column, adheres: Column, text: Column, author: Column, title: Column) -> Column:
    """A judge's score by rule: half, rounded down, off the plot; then at most 2
    where author or title is named; 0 without the end mark as the last line."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: F.length(x) > 0)
    last = F.coalesce(F.get(lines, F.size(lines) - 1), F.lit(""))
    named = F.contains(F.lower(text), F.lower(author)) | F.contains(F.lower(text), F.lower(title))
    score = F.when(adheres, base).otherwise(F.floor(base / 2))
    return F.when(last != "THE END.", 0).when(named, F.least(score, F.lit(2))).otherwise(score).cast("long")


def digit(reply: Column) -> Column:
    """A judge's reply of one digit as tenths, 0 to 0.9; null for any other."""
    own = strip(reply)
    return F.when(own.rlike(r"^[0-9]\z"), own.cast("int") / 10)
