"""Sentences of texts of any length, by a segmenter that is loaded once a task."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spans (start, end) of a text's sentences, in order.
Segmenter = Callable[[str], list[tuple[int, int]]]

_WHITE = " \t\n\f\r"
_CUT = re.compile(f"(?<=[.!?])[{_WHITE}]+")
#: Sentences of a batch that leaves a task.
_ROWS = 5_000


def by_marks() -> Segmenter:
    """Cuts after ``.``, ``!`` or ``?`` and white space."""

    def spans(text: str) -> list[tuple[int, int]]:
        out, start = [], 0
        for cut in [*_CUT.finditer(text), None]:
            end = cut.start() if cut else len(text)
            if text[start:end].strip(_WHITE):
                out.append((start, end))
            start = cut.end() if cut else end
        return out

    return spans


def in_windows(text: str, spans: Segmenter, window: int) -> Iterator[str]:
    """A text's sentences, window by window: what begins with a window's last
    sentence, which may go on, is looked at again with the next one.  They are the same
    for every window if a segmenter needs nothing behind a sentence's successor."""
    held = ""
    for at in range(0, len(text), window):
        held += text[at : at + window]
        found = spans(held)
        for start, end in found[:-1]:
            yield held[start:end]
        held = held[found[-1][0] :] if found else held
    for start, end in spans(held):
        yield held[start:end]


def segmented(docs: DataFrame, key: str, factory: Callable[[], Segmenter], window: int = 1_000_000) -> DataFrame:
    """(key, pos, sentence) of the rows' ``text``; null texts have none."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans, rows, own = factory(), [], None

        def batch() -> pa.RecordBatch:
            keys, places, texts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(keys, own), pa.array(places, pa.int64()), pa.array(texts, pa.string())], [key, "pos", "sentence"])

        for some in batches:
            own = some.schema.field(0).type
            for i, text in zip(some.column(0).to_pylist(), some.column(1), strict=True):
                for pos, sentence in enumerate(in_windows(text.as_py() or "", spans, window)):
                    rows.append((i, pos, sentence))
                    if len(rows) >= _ROWS:
                        yield batch()
                        rows = []
        if rows:
            yield batch()

    return docs.select(key, F.col("text")).mapInArrow(run, f"`{key}` {kind}, pos long, sentence string")
