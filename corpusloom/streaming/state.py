"""Which tasks are done, saved by a stream or a batch job that may run again.

Every micro-batch is a folder of its own, named by the batch's number: a batch that is
replayed writes its folder anew, so a task is there once however often it came.  From
time to time the folders are put together in one ``base``, and what it holds goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def _folders(spark: SparkSession, path: str) -> tuple[list[int], list[int]]:
    """Numbers of the whole bases and batches."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    bases, batches = [], []
    for x in store.listStatus(root) if store.exists(root) else ():
        kind, _, n = x.getPath().getName().partition("=")
        if n.isdigit() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS")):
            {"base": bases, "batch": batches}.get(kind, []).append(int(n))
    return sorted(bases), sorted(batches)


def save(done: DataFrame, batch: int, path: str, *keys: str) -> None:
    """Write a batch's finished tasks; a batch that is already in the base is left
    alone."""
    bases, _ = _folders(done.sparkSession, path)
    if not bases or batch > bases[-1]:
        done.select(*keys).distinct().write.mode("overwrite").parquet(f"{path}/batch={batch:010d}")


def finished(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """The finished tasks, each once; those of the batches up to a number, or of all."""
    bases, batches = _folders(spark, path)
    batches = [n for n in batches if upto is None or n <= upto]
    paths = [f"{path}/base={n:010d}" for n in bases[-1:]] + [f"{path}/batch={n:010d}" for n in batches if not bases or n > bases[-1]]
    return spark.read.schema(schema).parquet(*paths).distinct() if paths else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str, upto: int) -> None:
    """Put the batches up to a number in one base; the folders that it stands for go
    last, so a job that is lost on the way leaves the state as it was."""
    bases, batches = _folders(spark, path)
    batches = [n for n in batches if n <= upto]
    if not batches:
        return
    finished(spark, path, schema, batches[-1]).write.mode("overwrite").parquet(f"{path}/base={batches[-1]:010d}")
    where = lambda kind, n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{kind}={n:010d}")
    for gone in [where("base", n) for n in bases if n != batches[-1]] + [where("batch", n) for n in batches]:
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)


def resumed(tasks: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, state: str, checkpoint: str, *keys: str, compact_every: int = 20) -> StreamingQuery:
    """Work off a stream of tasks: of each micro-batch those that are not finished
    go through ``work``, whose rows are written by the batch's number and then counted
    as finished.  All that is there is worked off, then it stops."""
    spark = tasks.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tasks.select(*keys).schema.fields)

    def each(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        before = finished(own, state, schema, n - 1)  # a batch that is replayed is done again
        todo = batch.dropDuplicates(list(keys)).join(before, list(keys), "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{out}/batch={n:010d}")
        save(own.read.parquet(f"{out}/batch={n:010d}"), n, state, *keys)
        if n % compact_every == compact_every - 1:
            compact(own, state, schema, n - 1)  # never what may be replayed

    return tasks.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def written(spark: SparkSession, out: str) -> DataFrame:
    """All rows that :func:`resumed` wrote."""
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
