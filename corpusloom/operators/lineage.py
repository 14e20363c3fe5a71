"""Cutting lineage, and folders for what is written on the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _local_folder() -> str:
    folder = tempfile.mkdtemp(prefix="corpusloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which executors share.  Only a local
    session may name none; it gets a temporary one, deleted when the process ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return folder or _local_folder()


def scratch(spark: SparkSession) -> str:
    """The path of a new folder under the shared one."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint, from which lost tasks start again."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def kept(df: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as Parquet files in a folder (a new one if none is given): smaller than
    a checkpoint, and their size is known to joins."""
    path = f"{folder}/{uuid.uuid4().hex}" if folder else scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str) -> None:
    """Delete a folder of rows that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
