"""Chat formatting with offset-aligned loss masks.

Turns are rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line
end.  The markers are special tokens, so a token never reaches across a turn's
text; control strings inside roles and texts are escaped reversibly (``<``, any
number of ``\\``, ``|`` gets one more ``\\``), so they stay ordinary text.  The
rendering is encoded once with offsets; token spans meet the sorted spans of
assistant texts by binary search, which gives the loss mask.

Rows are ordered by turn; ties by role, then text; repeated rows are turns of
their own.  Null roles and texts are empty.  A null conv_id is a conversation too.
Conversations come sorted to their tasks and are worked on in blocks of whole turns,
and a block longer than ``BLOCK`` (one long turn) is encoded in parts cut between
words, where no token reaches across, so memory follows neither the longest
conversation nor, but for a few numbers a token, the longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, slices

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Characters after which a block of whole turns is encoded.
BLOCK = 1_000_000
#: Bytes of text in a partition, about.
PARTITION_BYTES = 32 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """Text without control strings."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    """The inverse of :func:`escape`."""
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> str:
    """The rendering of (role, text) turns."""
    return "".join(f"{START}{escape(r)}{SEP}{escape(t)}{END}\n" for r, t in turns)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendering."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(rendered)]


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The byte-level tokenizer of a file, with the markers as special tokens."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([START, SEP, END])
    t.no_padding()
    t.no_truncation()
    return t


#: A place that no token of a byte-level tokenizer reaches across.
_BETWEEN = regex.compile(r"(?<=\p{L})(?=[ \n]\p{L})")


def _parts(rendered: str) -> Iterator[tuple[int, str]]:
    at = 0
    while len(rendered) - at > 2 * BLOCK and (found := _BETWEEN.search(rendered, at + BLOCK)):
        yield at, rendered[at : found.start()]
        at = found.start()
    yield at, rendered[at:]


def encode_block(rendered: str, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, token spans (code points) and loss mask of a rendered block."""
    spans = np.array([m.span(2) for m in _TURN.finditer(rendered) if unescape(m[1]) == "assistant"], np.int64).reshape(-1, 2)
    ids, offsets = [], []
    for at, part in _parts(rendered):
        e = tokenizer(path).encode(part, add_special_tokens=False)
        ids.append(np.array(e.ids, np.int32))
        offsets.append(np.array(e.offsets, np.int64).reshape(-1, 2) + at)
    ids, offsets = np.concatenate(ids), np.concatenate(offsets)
    k = np.searchsorted(spans[:, 0], offsets[:, 0], side="right") - 1
    mask = (k >= 0) & (offsets[:, 1] > offsets[:, 0])
    if len(spans):
        mask &= offsets[:, 1] <= spans[np.maximum(k, 0), 1]
    return ids, offsets, mask


def loss_texts(rendered: str, offsets: np.ndarray, mask: np.ndarray) -> list[str]:
    """The stretches of text under a mask, unescaped, in order."""
    own = offsets[mask]
    if not len(own):
        return []
    cut = np.flatnonzero(own[1:, 0] > own[:-1, 1]) + 1  # a gap ends a stretch
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(own)]]) - 1
    return [unescape(rendered[own[a, 0] : own[b, 1]]) for a, b in zip(first, last, strict=True)]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str, bool]]:
    """(conv_id, rendered block, whether it is the last) of sorted turns."""
    current, parts, size, some = None, [], 0, False
    for batch in slices(batches):
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if some and conv != current:
                yield current, "".join(parts), True
                parts, size = [], 0
            elif size >= BLOCK:
                yield current, "".join(parts), False
                parts, size = [], 0
            current, some = conv, True
            parts.append(render([(role, text)]))
            size += len(parts[-1])
    if some:
        yield current, "".join(parts), True


def _sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(partitions(conversations.sparkSession), -(-size // PARTITION_BYTES))
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """(conv_id, block, formatted, ids, mask): each block of whole turns with
    its ids and one mask bit for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = 0
        for conv, rendered, last in _conversations(batches):
            ids, _, mask = encode_block(rendered, path)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int32()), pa.array([rendered]), pa.array([ids], pa.list_(pa.int32())), pa.array([mask.tolist()], pa.list_(pa.bool_()))], ["conv_id", "block", "formatted", "ids", "mask"])
            block = 0 if last else block + 1

    return _sorted_turns(conversations).mapInArrow(run, "conv_id long, block int, formatted string, ids array<int>, mask array<boolean>")


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def digest_conversations(conversations: DataFrame, path: str) -> DataFrame:
    """What :func:`format_conversations` holds, read back from the rendering
    and its mask and digested: one row for each conversation."""
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in DIGEST_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
        x, out = fresh(), []
        for conv, rendered, last in _conversations(batches):
            for role, text in parse(rendered):
                x[0] += 1
                x[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            ids, offsets, mask = encode_block(rendered, path)
            for text in loss_texts(rendered, offsets, mask):
                x[2] += len(text)
                x[3].update(text.encode("utf-8", "surrogatepass"))
            x[4] += len(rendered)
            x[5] += len(ids)
            x[6] += int(mask.sum())
            if last:
                out.append((conv, x[0], x[1].hexdigest(), x[2], x[3].hexdigest(), x[4], x[5], x[6]))
                x = fresh()
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return _sorted_turns(conversations).mapInArrow(run, DIGEST_SCHEMA)
