"""Calls of a service for rows, in the tasks that hold them.

A task runs an event loop of its own: so many calls at once, each bounded in time and
tried again so often, with a pause that doubles; replies come back in the rows' order.
A row whose last try fails keeps its error and no reply, so nothing is lost and a job
never hangs on one row.  A lost task asks again for its rows.
"""

from __future__ import annotations

import asyncio
from collections.abc import Awaitable, Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A client is made once in each task; it takes the request and the number of the try.
Client = Callable[[], Callable[[str, int], Awaitable[str | None]]]


def called(rows: DataFrame, request: str, client: Client, valid: Callable[[str], bool], tries: int = 5, at_once: int = 32, pause: float = 0.0, seconds: float = 30.0) -> DataFrame:
    """The rows with ``reply``, ``tries`` (how many it took) and ``error`` (of the last
    try, where there is no reply).  A reply that is not valid is asked for again, as is a
    call that fails or takes too long."""
    at = rows.columns.index(request)

    async def one(ask: Callable, limit: asyncio.Semaphore, text: str | None) -> tuple[str | None, int, str | None]:
        error = None
        for n in range(tries):
            if n and pause:
                await asyncio.sleep(pause * 2 ** (n - 1))
            try:
                async with limit:
                    reply = await asyncio.wait_for(ask(text or "", n), seconds)
                if reply is not None and valid(reply):
                    return reply, n + 1, None
                error = "invalid reply"
            except Exception as e:  # noqa: BLE001  whatever a client raises is the row's error
                error = f"{type(e).__name__}: {e}"
        return None, tries, error

    async def every(ask: Callable, texts: list) -> list[tuple]:
        limit = asyncio.Semaphore(at_once)
        return await asyncio.gather(*(one(ask, limit, t) for t in texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, loop = client(), asyncio.new_event_loop()
        try:
            for batch in batches:
                found = loop.run_until_complete(every(ask, batch.column(at).to_pylist()))
                replies, took, errors = zip(*found, strict=True) if found else ((), (), ())
                more = [pa.array(replies, pa.string()), pa.array(took, pa.int32()), pa.array(errors, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "reply", "tries", "error"])
        finally:
            loop.close()

    schema = T.StructType([*rows.schema.fields, T.StructField("reply", T.StringType()), T.StructField("tries", T.IntegerType()), T.StructField("error", T.StringType())])
    return rows.mapInArrow(run, schema)


def answered(rows: DataFrame) -> DataFrame:
    """Called rows that have a reply."""
    return rows.where(F.col("reply").isNotNull()).drop("error")


def dead_letters(rows: DataFrame) -> DataFrame:
    """Called rows that have none, with their last error."""
    return rows.where(F.col("reply").isNull()).drop("reply")
