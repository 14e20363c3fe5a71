"""A quota gate over a stream of candidates.

The number that each author has had accepted is keyed state: a micro-batch sees
its own rows and its authors' numbers, never what was accepted before.  Accepted
rows go to a Parquet sink, which takes each batch once, also after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import nsmallest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.prompts import validated


def accepted(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has been accepted."""
    return spark.read.schema(schema).parquet(path)


def gate(candidates: DataFrame, path: str, checkpoint: str, quota: int, least: float) -> StreamingQuery:
    """Start the gate on a stream of (author, arrival, text, score): of each
    author the first valid rows of a high enough score, by arrival within a
    micro-batch, up to the quota.  All that is there is worked off, then it stops."""
    columns = candidates.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema.fields)
    at = columns.index("arrival")

    def take(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        have = state.get[0] if state.exists else 0
        best: list[tuple] = []  # no more rows than the quota leaves room for
        for part in parts:
            best = nsmallest(quota - have, [*best, *part[columns].itertuples(index=False, name=None)], key=lambda r: r[at])
        state.update((have + len(best),))
        yield pd.DataFrame(best, columns=columns)

    good = candidates.where((validated(F.col("text")) == "ok") & (F.col("score") >= least))
    kept = good.groupBy("author").applyInPandasWithState(take, fields, "have long", "append", GroupStateTimeout.NoTimeout)
    return kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
