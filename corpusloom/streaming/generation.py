"""Generation as a stream: ask, check, judge, gate, write.

Tasks come from a stream whose rate limit (``maxFilesPerTrigger``) is the back-pressure:
a micro-batch asks no more than it can hold, and the next one waits until its rows are
written.  Asking and judging run in the batch's tasks with bounded calls and tries;
rows that get no reply, or one that is refused, are dropped, and so is what scores too
low.  The gate's numbers are keyed state, so a stream that is started again goes on
where it stopped, with the rows that a batch job over all tasks would take.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import calls
from ..operators.prompts import validated
from .quota import gate


def candidates(tasks: DataFrame, writer: calls.Client, judge: calls.Client, scored: Callable[[str], bool], **limits) -> DataFrame:
    """(author, arrival, text, score) of tasks (author, arrival, request) whose story
    is valid; the judge is asked about the request and the story, and answers with a
    number.  A stream or a table."""
    told = calls.called(tasks.select("author", "arrival", "request"), "request", writer, lambda reply: True, **limits)
    good = told.where(validated(F.col("reply")) == "ok").select("author", "arrival", F.concat_ws("\n", "request", "reply").alias("request"), F.col("reply").alias("text"))
    judged = calls.called(good, "request", judge, scored, **limits)
    return judged.where(F.col("reply").isNotNull()).select("author", "arrival", "text", F.col("reply").cast("double").alias("score"))


def generated(tasks: DataFrame, writer: calls.Client, judge: calls.Client, scored: Callable[[str], bool], path: str, checkpoint: str, quota: int, least: float, **limits) -> StreamingQuery:
    """Start the stream; all that is there is worked off, then it stops."""
    return gate(candidates(tasks, writer, judge, scored, **limits), path, checkpoint, quota, least)
