"""Helpers shared by the training-data operators.

Nothing here keeps state between calls.  Work that has to survive a lost
executor is cut with :func:`durable`, which writes to the checkpoint folder the
cluster names.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # noqa: B018
except (OSError, AttributeError):  # another C library
    _LIBC = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="corpusloom-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint.

    The folder is the one of ``spark.checkpoint.dir``.  Only where a local session
    names none (tests) is a temporary folder set; on a cluster that is an error.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def doc_columns(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, so that extra columns,
    whatever their names, never meet the operators' own."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


#: Rows of an Arrow batch, and bytes of their strings, that are worked on at once;
#: a single longer row is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1000, 4 << 20


def give_back() -> None:
    """Hand memory that is free back to the system: Python workers live on from
    task to task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a task in parts of bounded numbers and bytes; when they end,
    free memory goes back."""
    try:
        for batch in batches:
            size = np.ones(batch.num_rows, np.int64)
            for c in batch.columns:
                if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                    size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            at, upto = 0, np.cumsum(size)
            while at < batch.num_rows:
                before = upto[at - 1] if at else 0
                n = max(1, min(rows, int(np.searchsorted(upto, before + most, side="right")) - at))
                yield batch.slice(at, n)
                at += n
    finally:
        give_back()


def thrifty(f: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """A grouped task after which free memory goes back."""

    def run(own: pa.Table) -> pa.Table:
        try:
            return f(own)
        finally:
            give_back()

    return run


def thrifty_pair(f: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for a task of two tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            give_back()

    return run


def where_text(docs: DataFrame, decide: Callable[[list[str]], np.ndarray]) -> DataFrame:
    """The rows whose texts (null: empty) are decided to stay, with all their
    columns; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(decide([t or "" for t in batch.column(at).to_pylist()]), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_remainder(column: str, divisor: int):
    """``crc32`` of the id as text, modulo ``divisor``; null ids give null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


#: Parts of a share: fine enough for a few rows of any number of rows.
SHARES = 1 << 52


def parts_of(most: int, n: int) -> int:
    """The share that takes about ``most`` of ``n`` rows, in ``SHARES``."""
    return SHARES if n <= most else max(1, most * SHARES // n)


def in_share(column: str, parts):
    """Whether the hash of a column's value is in the share of :func:`parts_of`."""
    return F.pmod(F.xxhash64(column), F.lit(SHARES)) < parts


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of SplitMix64, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
