"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces.

A text is cut into paragraphs behind line ends, a paragraph into pieces where its
own last four code points say so (blanks are not needed), and paragraphs are
gathered into sections closed by paragraphs whose node says so; an edit therefore
changes only the branches around it.  A piece's node is the hash of its text, every
other node the hash of its children's nodes alone, the root included; nodes have
128 bits.  So equal roots mean equal texts, and walking two trees from the roots,
only into branches that differ, finds what they share and where they differ.

The fingerprint is the tree as one string: the root's node, then for each section
``;`` and its node, for each of its paragraphs ``,`` and its node, for each piece
``.``, its node and its length in base 16.  Nodes are 22 characters of base 64.  Null
counts as empty, whose tree has a root alone.  Repeated rows have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from base64 import b64encode
from bisect import bisect_left
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, mixed, partitions, slices

#: One position of so many ends a piece; code points of a piece at least (but
#: for a paragraph's last one) and at most.
POINTS_A_PIECE, LEAST, MOST = 64, 16, 160
#: One paragraph of so many closes a section.
PARAGRAPHS_A_SECTION = 6
#: Code points that are looked at together.
WINDOW = 1_000_000
#: Bytes of text in a range of documents, about.
RANGE_BYTES = 32 << 20
_NODE = 22
_PLACE = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def _node(level: str, content: str) -> str:
    raw = hashlib.blake2b(content.encode("utf-8", "surrogatepass"), digest_size=16, person=level.encode()).digest()
    return b64encode(raw)[:_NODE].decode()


def piece_ends(text: str) -> Iterator[tuple[int, bool]]:
    """The ends of all pieces, in order, and whether a paragraph ends there."""
    start = 0
    for at in range(0, len(text), WINDOW):
        points = np.frombuffer(text[max(0, at - 3) : at + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        h = points * _PLACE[0]
        for k in range(1, 4):
            h[k:] += points[:-k] * _PLACE[k]
        own = slice(min(at, 3), None)
        line = points[own] == 10
        chosen = np.flatnonzero((mixed(h[own]) % np.uint64(POINTS_A_PIECE) == 0) | line)
        for i, ends in zip((chosen + at + 1).tolist(), line[chosen].tolist(), strict=True):
            while i - start > MOST:
                start += MOST
                yield start, False
            if ends or i - start >= LEAST:
                yield i, ends
                start = i
    while len(text) - start > MOST:
        start += MOST
        yield start, False
    if start < len(text):
        yield len(text), True


def fingerprint(text: str) -> str:
    """The tree of a text as a string."""
    sections, paragraphs, pieces, nodes, start = [], [], [], [], 0
    out: list[str] = []
    for end, ends in piece_ends(text):
        leaf = _node("piece", text[start:end])
        nodes.append(leaf)
        pieces.append(f".{leaf}{end - start:x}")
        start = end
        if ends or end == len(text):
            node = _node("paragraph", "".join(nodes))
            paragraphs.append(node)
            out.append(f",{node}{''.join(pieces)}")
            nodes, pieces = [], []
            if int.from_bytes(node[:4].encode()) % PARAGRAPHS_A_SECTION == 0 or end == len(text):
                section = _node("section", "".join(paragraphs))
                sections.append((section, "".join(out)))
                paragraphs, out = [], []
    return _node("root", "".join(s for s, _ in sections)) + "".join(f";{s}{body}" for s, body in sections)


class Tree:
    """A fingerprint taken apart again: children are read where they are asked
    for.  A branch is (node, length, its part of the fingerprint)."""

    _MARKS = ";,."

    def __init__(self, fingerprint: str):
        self.whole = (fingerprint[:_NODE], sum(int(x.rpartition(".")[2][_NODE:], 16) for x in _leaves(fingerprint)), fingerprint[_NODE:])

    @classmethod
    def children(cls, branch: tuple[str, int, str], level: int) -> list[tuple[str, int, str]]:
        """The branches below one of a level (0: the root)."""
        out = []
        for part in branch[2].split(cls._MARKS[level])[1:]:
            if level == 2:
                out.append((part[:_NODE], int(part[_NODE:], 16), ""))
            else:
                out.append((part[:_NODE], sum(int(x[_NODE:], 16) for x in _leaves(part)), part[_NODE:]))
        return out


def _leaves(part: str) -> Iterator[str]:
    for x in part.split(".")[1:]:
        yield x.partition(",")[0].partition(";")[0]


def _common(xs: list[str], ys: list[str]) -> list[tuple[int, int]]:
    """Pairs of equal nodes in both orders: the longest increasing choice after
    the k-th occurrence of a node on one side is paired with the k-th on the other."""
    there = defaultdict(deque)
    for j, y in enumerate(ys):
        there[y].append(j)
    pairs = [(i, there[x].popleft()) for i, x in enumerate(xs) if there.get(x)]
    ends: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(ends, j)
        before.append(last[at - 1] if at else -1)
        ends[at : at + 1] = [j]
        last[at : at + 1] = [k]
    out, k = [], last[-1] if last else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def compare(a: str, b: str) -> tuple[int, int, int, list[tuple[int, int, int, int]]]:
    """Of two fingerprints: lengths of both texts, code points in pieces that
    they share in order, and the edits: (start, end) in the first text and in the
    second.  Branches with equal nodes are passed over whole; only those between
    them are walked into."""
    x, y = Tree(a).whole, Tree(b).whole
    edits: list[tuple[int, int, int, int]] = []

    def walk(xs: list, ys: list, i: int, j: int, level: int) -> int:
        """Branches of one level whose parents differ, from places i and j on."""
        if not xs or not ys or level == 3:
            if xs or ys:
                edits.append((i, i + sum(n for _, n, _ in xs), j, j + sum(n for _, n, _ in ys)))
            return 0
        down = lambda own: [c for branch in own for c in Tree.children(branch, level)]
        return align(down(xs), down(ys), i, j, level + 1)

    def align(xs: list, ys: list, i: int, j: int, level: int) -> int:
        same, p, q = 0, 0, 0
        for k, m in [*_common([n for n, _, _ in xs], [n for n, _, _ in ys]), (len(xs), len(ys))]:
            same += walk(xs[p:k], ys[q:m], i, j, level)
            i, j = i + sum(n for _, n, _ in xs[p:k]), j + sum(n for _, n, _ in ys[q:m])
            if k < len(xs):
                same, i, j = same + xs[k][1], i + xs[k][1], j + xs[k][1]
            p, q = k + 1, m + 1
        return same

    shared = x[1] if x[0] == y[0] else walk([x], [y], 0, 0, 0)
    joined: list[tuple[int, int, int, int]] = []
    for e in edits:  # neighbours are one edit
        if joined and joined[-1][1] == e[0] and joined[-1][3] == e[2]:
            e = (joined[-1][0], e[1], joined.pop()[2], e[3])
        joined.append(e)
    return x[1], y[1], shared, joined


def likeness(a: str, b: str) -> float:
    """Share of the two texts' length that lies in common pieces in order, 0 to 1,
    from the fingerprints alone; 1 for equal roots only."""
    n, m, shared, _ = compare(a, b)
    return 1.0 if a[:_NODE] == b[:_NODE] else 2 * shared / (n + m)


def edits(a: str, b: str) -> list[tuple[int, int, int, int]]:
    """Where two texts differ: (start, end) in the first and in the second, in
    code points, from the fingerprints alone."""
    return compare(a, b)[3]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t.as_py()) for t in batch.column(1)], pa.string())], ["doc_id", "fingerprint"])

    return doc_columns(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the start of another."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits string"


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited self and against the next one; ``edits``
    are the places where the edited text differs, as ``start-end>start-end``
    joined by blanks.

    Documents are ordered by doc_id (null first, ties by text); after the last
    comes the first.  Rows go to ranges of ids, and the first row of a range
    also to the range before it, so no task sees more than its ranges, and each
    reads them as a sorted stream.
    """
    docs = doc_columns(docs)
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n = max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))
    shares = [i / (2 * n) for i in range(1, 2 * n)]
    cuts = sorted({q for r in docs.select(F.percentile_approx("doc_id", shares, 20 * n)).collect() for q in r[0] or []})
    firsts = {
        r.range: r.first
        for r in docs.select("doc_id")
        .mapInArrow(lambda batches: _least_ids(batches, cuts), "range int, first long")
        .groupBy("range")
        .agg(F.min("first").alias("first"))
        .collect()
    }
    rows = docs.mapInArrow(lambda batches: _deal(batches, cuts, firsts), "range int, guest int, doc_id long, text string")
    rows = rows.repartition(n, "range").sortWithinPartitions("range", "guest", "doc_id", "text")
    return rows.mapInArrow(_next_task, EDIT_SCHEMA)


#: What null ids count as where ids are ordered.
_NULL_ID = -(1 << 63)


def _ranges(ids: pa.Array, cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Ids with nulls filled, and for each the number of cuts at or below it."""
    filled = ids.fill_null(_NULL_ID).to_numpy(zero_copy_only=False)
    return filled, np.searchsorted(np.array(cuts, np.int64), filled, side="right").astype(np.int32)


def _least_ids(batches: Iterator[pa.RecordBatch], cuts: list[int]) -> Iterator[pa.RecordBatch]:
    """The least id of each range in each batch."""
    for batch in slices(batches):
        ids, where = _ranges(batch.column(0), cuts)
        least = {int(r): int(ids[where == r].min()) for r in np.unique(where)}
        yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array(list(least.values()), pa.int64())], ["range", "first"])


def _deal(batches: Iterator[pa.RecordBatch], cuts: list[int], firsts: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """Each row under its range, and the first row of each range also as a
    guest of the range before it (of the first range: the last)."""
    there = sorted(firsts)
    before = {r: there[i - 1] for i, r in enumerate(there)}
    for batch in slices(batches):
        ids, where = _ranges(batch.column(0), cuts)
        guest = np.flatnonzero(np.fromiter((firsts[r] == i for r, i in zip(where.tolist(), ids.tolist(), strict=True)), bool, len(ids)))
        take = pa.array(np.concatenate([np.arange(len(ids)), guest]))
        at = np.concatenate([where, np.fromiter((before[r] for r in where[guest].tolist()), np.int32, len(guest))])
        flag = np.concatenate([np.zeros(len(ids), np.int32), np.ones(len(guest), np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flag), batch.column(0).take(take), batch.column(1).take(take)], ["range", "guest", "doc_id", "text"])


def _next_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row of a range with the next; the first guest closes it."""
    names = [x.split()[0] for x in EDIT_SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in EDIT_SCHEMA.split(", ")]
    held, closed, out, size = None, None, [], 0

    def row(doc, text, own, following, theirs):
        new = edited(text, following)
        changed = fingerprint(new)
        n, m, shared, where = compare(own, changed)
        near = 1.0 if own[:_NODE] == changed[:_NODE] else 2 * shared / (n + m)
        places = " ".join(f"{a}-{b}>{c}-{d}" for a, b, c, d in where)
        return doc, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, changed, near, likeness(own, theirs), places

    for batch in slices(batches):
        for where, guest, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where == closed:
                continue  # further guests of equal id
            print_ = fingerprint(text)
            if held is not None and held[0] == where:
                out.append(row(held[1], held[2], held[3], text, print_))
                size += len(text)
            held = None if guest else (where, doc, text, print_)
            closed = where if guest else None
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
