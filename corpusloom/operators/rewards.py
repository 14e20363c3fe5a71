"""Rewards of completions, and of the groups that answer one prompt.

Reward functions are the caller's: they take a batch of prompts and completions, and
the batch's other columns, and return a number for each.  What a group is compared by
is summed up by Spark, so it is the same however groups lie in batches and tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reward = Callable[[list[str], list[str], dict[str, list]], list[float]]

#: Added to a group's deviation (a fixed value).
EPSILON = 1e-4


def with_rewards(rows: DataFrame, functions: Mapping[str, Callable[[], Reward]], batch: int = 64, prompt: str = "prompt", completion: str = "completion") -> DataFrame:
    """The rows with a column for each reward function, which a factory makes once in
    a task (so a model is loaded once).  Null or blank completions get 0."""
    names = list(functions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [functions[n]() for n in names]
        for own in batches:
            for at in range(0, own.num_rows, batch):
                part = own.slice(at, batch)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}
                texts = [t or "" for t in columns[completion]]
                there = [i for i, t in enumerate(texts) if t.strip()]
                some = {n: [c[i] for i in there] for n, c in columns.items()}
                more = []
                for f in ready:
                    out = [0.0] * part.num_rows
                    for i, x in zip(there, f([p or "" for p in some[prompt]], [texts[i] for i in there], some) if there else (), strict=True):
                        out[i] = float(x)
                    more.append(pa.array(out, pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)]))


def advantages(rows: DataFrame, reward: Column, *group: str, scaled: bool = True) -> DataFrame:
    """The rows with ``reward``, their group's ``group_mean`` and ``group_std`` (of a
    sample; 0 for one completion) and ``advantage``: how far the reward lies over the
    mean, in deviations where ``scaled``.

    Groups are summed up before they are shuffled and joined back, so a prompt with
    very many completions is no task of its own."""
    own = rows.withColumn("reward", reward)
    x = F.col("reward")
    sums = own.groupBy(*group).agg(F.avg(x).alias("group_mean"), F.coalesce(F.nanvl(F.stddev_samp(x), F.lit(0.0)), F.lit(0.0)).alias("group_std"))
    right = sums.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(group)], "group_mean", "group_std")
    same = [own[c].eqNullSafe(right[f"_{i}"]) for i, c in enumerate(group)]
    both = own.join(right, same).drop(*(f"_{i}" for i in range(len(group))))
    over = F.col("reward") - F.col("group_mean")
    return both.withColumn("advantage", over / (F.col("group_std") + EPSILON) if scaled else over)
