"""Places in a total order of many rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, key: Column) -> DataFrame:
    """The rows with ``_range``: how many of some cuts lie at or below the key."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({q for r in df.select(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).collect() for q in r[0] or []})
    if not cuts:
        return df.withColumn("_range", F.lit(0))
    return df.withColumn("_range", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= key)))


def running(df: DataFrame, amount: Column, name: str, key: Column, *order) -> DataFrame:
    """Append the sum of an amount over all rows up to each, by a numeric key and
    then the order given.

    Rows are summed up in ranges of the key, so a task holds one range; rows of
    equal keys are in one range."""
    own = _ranged(df.withColumn("_amount", amount), key)
    by = Window.partitionBy("_range").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, 0)
    before = own.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = before.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = own.join(F.broadcast(before), "_range")  # a row for each range
    return own.withColumn(name, F.col("_before") + F.sum("_amount").over(by)).drop("_range", "_before", "_amount")


def placed(df: DataFrame, name: str, key: Column, *order) -> DataFrame:
    """Append each row's place from 0 by a numeric key and then the order given."""
    own = running(df, F.lit(1), "_place", key, *order)
    return own.withColumn(name, (F.col("_place") - 1).cast("long")).drop("_place")


def hex_key(digest: Column) -> Column:
    """A number that orders hexadecimal digests as their first 15 digits do."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
