"""Removal of repeated 50-byte strings by ranks at growing lengths.

This departs from distributed prefix doubling, where Spark sorts rank pairs of all
live positions and reranks them: the README says why, with figures.  As there, a
position's rank for a length comes from its ranks for shorter ones.  Ranks here are names: fingerprints of the pair of
shorter ranks instead of places in a sorted list, so a document works out its own
ranks at all lengths without asking others.  What has to be sorted among all
documents are (rank, document) pairs, at three growing lengths; what is unique
or decided at one takes no part in the next.

* Length 24.  Of each 50-byte window only the least rank of its 24-byte strings
  is sorted.  Equal windows have equal least ranks, so a window whose least rank
  is unique to one document is unique itself.
* Length 50 to 76: runs, that is neighbouring windows with one least rank, as
  one string.  A run that a smaller document has too is covered whole.  A least
  rank with one kind of run only is decided by this.
* Length 50, the threshold: single windows of the other runs, where copies begin
  and end.  The first document with such a run sends its bytes, and its windows
  are ranked where they are sorted.

Pairs travel packed: one row holds the pairs that a batch of documents has for
a bucket of ranks, each rank once for a batch.  So a string that a third of all
documents share sends one pair from each batch and not one from each document,
and no task holds more than a bucket or a batch.  There are fewer buckets than
batches, so that a message holds many pairs.  Runs are told apart by 127 bits, single
windows by their bytes.  Exact copies of a whole text are found by digest beforehand.
A long document is ranked in segments that overlap by a window less a byte; where
runs are cut by that, their windows are still told apart one by one.

Null texts count as empty.  Documents with equal ids never remove from each
other; a null id neither removes nor is removed from.  Texts under 50 bytes stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, partitions, thrifty, thrifty_pair

#: Length of the strings, of the first sorted rank, and how many of those a window has.
WINDOW, FIRST = 50, 24
INNER = WINDOW - FIRST + 1
#: Bytes of text in a batch of documents, about, and bytes that are ranked at once.
BATCH_BYTES, CHUNK = 8 << 20, 256 << 10
#: Bytes of text for each bucket of ranks, about.
BUCKET_BYTES = 32 << 20
_K = [np.uint64(k | 1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _pair(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The rank of a string from the ranks of its two halves."""
    return mixed(a * _K[k] + mixed(b + _K[k + 1]))


class Ranks:
    """Ranks of all positions of some bytes: eight bytes are their own rank."""

    def __init__(self, raw: np.ndarray):
        x = np.zeros(len(raw) + 7, np.uint64)
        x[: len(raw)] = raw
        x = x[:-1] | x[1:] << np.uint64(8)
        x = x[:-2] | x[2:] << np.uint64(16)
        self.eight = x[:-4] | x[4:] << np.uint64(32)
        sixteen = _pair(self.eight[:-8], self.eight[8:], 0)
        self.first = _pair(sixteen[:-8], self.eight[16:], 4)

    def least(self) -> np.ndarray:
        """For each window the least rank of length 24 in it."""
        m, step = self.first, 1
        while step * 2 <= INNER:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        rest = INNER - step
        return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m

    def _double(self, at: np.ndarray) -> np.ndarray:
        return _pair(self.first[at], self.first[at + FIRST], 1)

    def whole(self, at: np.ndarray) -> np.ndarray:
        """The rank of length 50 of the windows at some positions, by 24 and 48."""
        return _pair(self._double(at), self._double(at + WINDOW - 2 * FIRST), 2)

    def run(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The rank of the string from one window to another that it overlaps."""
        return _pair(self.whole(first) + (last - first).astype(np.uint64), self.whole(last), 3)

    def same(self, at: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Whether the windows at two lists of positions have the same bytes."""
        out = np.ones(len(at), bool)
        for offset in (*range(0, WINDOW - 8, 8), WINDOW - 8):
            out &= self.eight[at + offset] == self.eight[other + offset]
        return out

    def groups(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the windows at some positions that brings equal bytes
        together, and which of them in that order are the first of their kind."""
        rank = self.whole(at)
        order = np.argsort(rank, kind="stable")
        new = np.ones(len(at), bool)
        equal = rank[order][1:] == rank[order][:-1]
        new[1:] = ~equal
        if (equal & ~self.same(at[order][1:], at[order][:-1])).any():  # one rank for unequal bytes: sort by these
            keys = [self.eight[at + offset] for offset in (WINDOW - 8, *range(40, -1, -8))]
            order = np.lexsort(keys)
            new[1:] = ~self.same(at[order][1:], at[order][:-1])
        return order, new


def _chunks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Some documents at a time: their numbers, where in them the bytes begin,
    their ends, their bytes.  A long document comes in segments."""
    own, begin, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= WINDOW:
            part = t[at : at + CHUNK + WINDOW - 1] if len(t) > 2 * CHUNK else t
            own.append(i), begin.append(at), parts.append(part)
            size += len(part)
            at += len(part) - WINDOW + 1
            if size >= CHUNK:
                yield np.array(own), np.array(begin), np.cumsum([len(p) for p in parts]), np.frombuffer(b"".join(parts), np.uint8)
                own, begin, parts, size = [], [], [], 0
    if own:
        yield np.array(own), np.array(begin), np.cumsum([len(p) for p in parts]), np.frombuffer(b"".join(parts), np.uint8)


def _windows(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that stay inside a document, and its number here."""
    n = np.diff(ends, prepend=0) - WINDOW + 1
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - begin[of] + (ends - n - WINDOW + 1)[of], of


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return start, np.diff(start, append=len(values))


_LOW = np.uint64((1 << 48) - 1)


def _pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


#: What blobs hold one after the other: a run (its least rank, its own, whose
#: lowest bit is a mark, and a document or, in the end, one bit for each window).
_RUN = np.dtype([("least", "<u8"), ("rank", "<u8"), ("doc", "<i8")])
_ONE = np.uint64(1)


def _bucket(rank: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(rank) % np.uint64(buckets)).astype(np.int32)


def _numbers(ids: list[int | None]) -> np.ndarray:
    return np.array([i if i is not None else 0 for i in ids], np.int64)


def _blobs(right: pa.Table, kind: int) -> list[bytes]:
    return [b for k, b in zip(right["kind"].to_pylist(), right["blob"].to_pylist(), strict=True) if k == kind]


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    start, n = _runs(bucket[order])
    for s, k in zip(start, n, strict=True):
        yield int(bucket[order[s]]), order[s : s + k]


def _messages(rows: list[tuple[int, int, bytes]], first: str) -> pa.Table:
    a, b, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.binary())], [first, "batch" if first == "bucket" else "kind", "blob"])


def _documents(left: pa.Table, right: pa.Table) -> tuple[list[int | None], list[bytes], list[bool]]:
    """Ids, bytes, and whether a document takes part: it has an id and is the
    first of its exact copies."""
    firsts = {int.from_bytes(b, "big", signed=True) for b in _blobs(right, 0)}
    ids, texts = left["doc_id"].to_pylist(), left["text"].cast(pa.binary()).to_pylist()
    return ids, texts, [i is not None and i in firsts for i in ids]


class _Piece:
    """Some documents that take part, their ranks, and their runs: first and
    last window, least rank, and the document's place in the batch."""

    def __init__(self, own: np.ndarray, begin: np.ndarray, ends: np.ndarray, raw: np.ndarray):
        self.own, self.begin, self.ends, self.raw, self.ranks = own, begin, ends, raw, Ranks(raw)
        at, of = _windows(ends)
        least = self.ranks.least()[at]
        cut = np.ones(len(at), bool)
        cut[1:] = (least[1:] != least[:-1]) | (of[1:] != of[:-1])
        start = np.flatnonzero(cut)
        # no more windows than have a 24-byte string in common
        n = np.diff(start, append=len(at))
        if len(n) and n.max() > INNER:
            extra = np.concatenate([np.arange(s, s + k, INNER) for s, k in zip(start[n > INNER], n[n > INNER], strict=True)])
            start = np.union1d(start, extra)
            n = np.diff(start, append=len(at))
        self.first, self.last, self.least, self.doc, self.segment = at[start], at[start] + n - 1, least[start], own[of[start]], of[start]

    def runs(self, keep: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The chosen runs as entries, unmarked."""
        e = np.empty(int(keep.sum()), _RUN)
        e["least"], e["doc"] = self.least[keep], number[self.doc[keep]]
        e["rank"] = self.ranks.run(self.first[keep], self.last[keep]) & ~_ONE
        return e


def _pieces(texts: list[bytes], part: list[bool]) -> Iterator[_Piece]:
    for x in _chunks([t if p else b"" for t, p in zip(texts, part, strict=True)]):
        yield _Piece(*x)


def _once(e: np.ndarray, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted entries, one for each key with its least document, and whether
    there was another document."""
    e = e[np.lexsort((e["doc"], *(e[k] for k in reversed(keys))))]
    new = np.ones(len(e), bool)
    new[1:] = np.logical_or.reduce([e[k][1:] != e[k][:-1] for k in keys])
    start = np.flatnonzero(new)
    return e[start], np.maximum.reduceat(e["doc"], start) != e["doc"][start]


def _first_ranks(buckets: int):
    """Pass 1: a batch's least ranks of length 24; the lowest bit says that two
    of its documents have it."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, part = _documents(left, right)
        name, doc = [], []
        for x in _pieces(texts, part):
            name.append(x.least)
            doc.append(x.doc)
        if not name:
            return _messages([], "bucket")
        name, doc = np.concatenate(name), np.concatenate(doc)
        doc = _numbers(ids)[doc]
        order = np.argsort(name, kind="stable")
        name, doc = name[order], doc[order]
        start, _ = _runs(name)
        several = np.maximum.reduceat(doc, start) != np.minimum.reduceat(doc, start)
        name = name[start]
        low = name & _LOW & ~np.uint64(1) | several.astype(np.uint64)
        batch = left["batch"][0].as_py()
        return _messages([(b, batch, _pack6(low[x])) for b, x in _by_bucket(_bucket(name, buckets))], "bucket")

    return run


def _gather(table: pa.Table, width: int) -> tuple[np.ndarray, bytes]:
    """The batch of each entry of a bucket, and the entries."""
    blobs = table["blob"].to_pylist()
    return np.repeat(np.array(table["batch"].to_pylist(), np.int32), [len(b) // width for b in blobs]), b"".join(blobs)


def _not_unique(table: pa.Table) -> pa.Table:
    """Sort a bucket; what two documents have goes back to its batches."""
    batch, blob = _gather(table, 6)
    name = _unpack6(blob)
    key = name >> np.uint64(1)
    order = np.argsort(key, kind="stable")
    start, n = _runs(key[order])
    live = np.repeat((n > 1) | np.maximum.reduceat(name[order] & np.uint64(1), start).astype(bool), n) if len(start) else np.zeros(0, bool)
    kept = order[live]
    return _messages([(b, 1, _pack6(key[kept[x]])) for b, x in _by_bucket(batch[kept])], "batch")


def _run_ranks(buckets: int):
    """Pass 2: the runs that are left, each once for the batch, with the least
    of its documents and a mark if there are more."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, part = _documents(left, right)
        live = np.unique(np.concatenate([_unpack6(b) for b in _blobs(right, 1)] or [np.zeros(0, np.uint64)]))
        found = []
        for x in _pieces(texts, part) if len(live) else ():
            key = (x.least & _LOW) >> _ONE
            found.append(x.runs(live[np.minimum(np.searchsorted(live, key), len(live) - 1)] == key, _numbers(ids)))
        if not sum(map(len, found)):
            return _messages([], "bucket")
        e, several = _once(np.concatenate(found), "least", "rank")
        e["rank"] |= several.astype(np.uint64)
        batch = left["batch"][0].as_py()
        return _messages([(b, batch, e[x].tobytes()) for b, x in _by_bucket(_bucket(e["least"], buckets))], "bucket")

    return run


def _first_runs(table: pa.Table) -> pa.Table:
    """Sort a bucket; a run's smallest document goes to each batch that has a
    larger one, and, where a least rank has several kinds of run, to its own."""
    batch, blob = _gather(table, _RUN.itemsize)
    e = np.frombuffer(blob, _RUN)
    if not len(e):
        return _messages([], "batch")
    order = np.lexsort((e["rank"] >> _ONE, e["least"]))
    e, batch = e[order].copy(), batch[order]
    mark = (e["rank"] & _ONE).astype(bool)
    e["rank"] &= ~_ONE
    new_least = np.ones(len(e), bool)
    new_least[1:] = e["least"][1:] != e["least"][:-1]
    new_run = new_least.copy()
    new_run[1:] |= e["rank"][1:] != e["rank"][:-1]
    start = np.flatnonzero(new_run)
    first = np.repeat(np.minimum.reduceat(e["doc"], start), np.diff(start, append=len(e)))
    group = np.flatnonzero(new_least)
    kinds = np.repeat(np.add.reduceat(new_run.astype(np.int64), group), np.diff(group, append=len(e)))
    told, asked = (first < e["doc"]) | mark, (kinds > 1) & (first == e["doc"])
    e["doc"] = first
    out = []
    for kind, which in ((2, told), (3, asked)):
        own, of = e[which], batch[which]
        out += [(b, kind, own[x].tobytes()) for b, x in _by_bucket(of)]
    return _messages(out, "batch")


class _Runs:
    """A look-up table of runs."""

    def __init__(self, blobs: list[bytes]):
        e = np.frombuffer(b"".join(blobs), _RUN)
        e = e[np.lexsort((e["least"], e["rank"]))]
        self.rank, self.least, self.doc = e["rank"].copy(), e["least"], e["doc"]

    def documents(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each run whether it is known, and its document."""
        known, doc = np.zeros(len(e), bool), np.zeros(len(e), np.int64)
        if len(self.rank):
            place, open_ = np.searchsorted(self.rank, e["rank"]), np.arange(len(e))
            while len(open_):  # equal ranks of unequal runs stand side by side
                p = place[open_]
                open_ = open_[(p < len(self.rank)) & (self.rank[np.minimum(p, len(self.rank) - 1)] == e["rank"][open_])]
                p = place[open_]
                hit = self.least[p] == e["least"][open_]
                known[open_[hit]], doc[open_[hit]] = True, self.doc[p[hit]]
                open_ = open_[~hit]
                place[open_] += 1
        return known, doc


def _strings(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Some stretches of bytes, one after the other."""
    begin = np.cumsum(size) - size
    return raw[np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(start, size)].tobytes()


def _run_texts(buckets: int):
    """Pass 3: the runs asked for, each once, with their bytes."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts, part = _documents(left, right)
        number, asked, out, sent = _numbers(ids), _Runs(_blobs(right, 3)), {}, set()
        for x in _pieces(texts, part) if len(asked.rank) else ():
            e = x.runs(np.ones(len(x.first), bool), number)
            known, doc = asked.documents(e)
            own = np.flatnonzero(known & (doc == e["doc"]))
            fresh = []
            for i, key in zip(own.tolist(), e[own][["least", "rank"]].tolist(), strict=True):
                if key not in sent:
                    sent.add(key)
                    fresh.append(i)
            own = np.array(fresh, np.int64)
            for b, y in _by_bucket(_bucket(e["least"][own], buckets)):
                at = own[y]
                size = x.last[at] - x.first[at] + WINDOW
                parts = out.setdefault(b, ([], [], []))
                parts[0].append(e[at].tobytes())
                parts[1].append(size.astype(np.uint8).tobytes())
                parts[2].append(_strings(x.raw, x.first[at], size))
        batch = left["batch"][0].as_py()
        return _messages([(b, batch, sum(map(len, p[1])).to_bytes(8, "little") + b"".join(b"".join(q) for q in p)) for b, p in out.items()], "bucket")

    return run


def _first_windows(table: pa.Table) -> pa.Table:
    """Sort a bucket's windows; each run goes back with one bit for each of
    its windows that a smaller document has."""
    runs, sizes, raws, batch = [], [], [], []
    for b, blob in zip(table["batch"].to_pylist(), table["blob"].to_pylist(), strict=True):
        n = int.from_bytes(blob[:8], "little")
        width = n * _RUN.itemsize
        runs.append(np.frombuffer(blob[8 : 8 + width], _RUN))
        sizes.append(np.frombuffer(blob[8 + width : 8 + width + n], np.uint8))
        raws.append(blob[8 + width + n :])
        batch.append(np.full(n, b, np.int32))
    if not runs:
        return _messages([], "batch")
    e, size, batch = np.concatenate(runs).copy(), np.concatenate(sizes).astype(np.int64), np.concatenate(batch)
    ranks = Ranks(np.frombuffer(b"".join(raws), np.uint8))
    at, of = _windows(np.cumsum(size))
    doc = e["doc"][of]
    order, new = ranks.groups(at)
    start = np.flatnonzero(new)
    least = np.empty(len(at), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], start), np.diff(start, append=len(at)))
    begin = np.flatnonzero(np.diff(of, prepend=-1))
    bit = np.int64(1) << (np.arange(len(at)) - begin[of])
    e["doc"] = np.add.reduceat(np.where(least < doc, bit, 0), begin)
    some = e["doc"] != 0
    e, batch = e[some], batch[some]
    return _messages([(b, 4, e[x].tobytes()) for b, x in _by_bucket(batch)], "batch")


def _cut(left: pa.Table, right: pa.Table) -> Iterator[tuple[bytes, np.ndarray]]:
    """Pass 4: each document of a batch with the mask of its removed bytes."""
    ids, texts, part = _documents(left, right)
    number, told, parts = _numbers(ids), _Runs(_blobs(right, 2)), _Runs(_blobs(right, 4))
    hit: dict[int, np.ndarray] = {}
    for x in _pieces(texts, part) if len(told.rank) + len(parts.rank) else ():
        e = x.runs(np.ones(len(x.first), bool), number)
        edge = np.zeros(len(x.raw) + 1, np.int32)
        known, doc = told.documents(e)
        covered = known & (doc < e["doc"])
        np.add.at(edge, x.first[covered], 1)
        np.add.at(edge, x.last[covered] + WINDOW, -1)
        known, bits = parts.documents(e)
        known &= ~covered
        for i in range(INNER):
            at = x.first[known & (bits >> i & 1).astype(bool)] + i
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
        mask = np.cumsum(edge[:-1]) > 0
        for k in np.unique(np.concatenate([x.segment[covered], x.segment[known]])).tolist():
            j, start, end = int(x.own[k]), int(x.ends[k - 1]) if k else 0, int(x.ends[k])
            own = hit.setdefault(j, np.zeros(len(texts[j]), bool))
            own[x.begin[k] : x.begin[k] + end - start] |= mask[start:end]
    for i, text in enumerate(texts):
        if ids[i] is not None and not part[i] and len(text) >= WINDOW:
            yield text, np.ones(len(text), bool)
        else:
            yield text, hit.get(i, np.zeros(len(text), bool))


def _spans(mask: np.ndarray) -> int:
    return int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(len(mask) and mask[0]))


DIGEST_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest_task(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = [(len(t), int(m.sum()), _spans(m), hashlib.sha256(np.frombuffer(t, np.uint8)[~m].tobytes()).hexdigest()) for t, m in _cut(left, right)]
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([left["doc_id"], *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _nullable(rest: pa.ChunkedArray) -> pa.ChunkedArray:
    """A struct column with nullable fields, as the schema says."""
    return rest.cast(pa.struct([pa.field(f.name, f.type) for f in rest.type]))


def _bytes_task(left: pa.Table, right: pa.Table) -> pa.Table:
    kept, spans = [], []
    for t, m in _cut(left, right):
        kept.append(np.frombuffer(t, np.uint8)[~m].tobytes())
        edge = np.flatnonzero(np.diff(np.concatenate([[False], m, [False]]).astype(np.int8)))
        spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table([left["doc_id"], pa.array(kept, pa.binary()), pa.array(spans, span), _nullable(left["rest"])], ["doc_id", "kept", "spans", "rest"])


def _text_task(left: pa.Table, right: pa.Table) -> pa.Table:
    kept = pa.array((np.frombuffer(t, np.uint8)[~m].tobytes().decode("utf-8", "ignore") if m.any() else t.decode() for t, m in _cut(left, right)), pa.string())
    return pa.table([left["doc_id"], kept, _nullable(left["rest"])], ["doc_id", "text", "rest"])


def _removal(docs: DataFrame, rest: list[str], task, schema: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    n, buckets = max(partitions(spark), -(-total // BATCH_BYTES)), max(partitions(spark), -(-total // BUCKET_BYTES))
    batch_of = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    extra = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(0).alias("none"))
    batches = docs.select("doc_id", text.alias("text"), extra.alias("rest"), batch_of(F.coalesce("doc_id", F.xxhash64(text))).alias("batch"))  # rows without an id are spread by their texts
    firsts = docs.select("doc_id", F.unhex(F.md5(text)).alias("digest")).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null")
    firsts = firsts.select(batch_of("doc_id").alias("batch"), F.lit(0).alias("kind"), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")).alias("blob"))
    told, asked = "batch int, kind int, blob binary", "bucket int, batch int, blob binary"
    meet = lambda side, f, out: batches.groupBy("batch").cogroup(side.groupBy("batch")).applyInArrow(thrifty_pair(f), out)
    # repartitioned by itself, so that the two passes that read it share one exchange
    not_unique = meet(firsts, _first_ranks(buckets), asked).groupBy("bucket").applyInArrow(thrifty(_not_unique), told)
    first_runs = meet(firsts.unionByName(not_unique), _run_ranks(buckets), asked).groupBy("bucket").applyInArrow(thrifty(_first_runs), told).repartition(max(partitions(spark), -(-n // 16)), "batch")
    first_windows = meet(firsts.unionByName(first_runs), _run_texts(buckets), asked).groupBy("bucket").applyInArrow(thrifty(_first_windows), told)
    return meet(firsts.unionByName(first_runs).unionByName(first_windows), task, schema)


def removal_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document."""
    return _removal(docs, [], _digest_task, DIGEST_SCHEMA)


def _whole(docs: DataFrame, keep: tuple[str, ...], task, schema: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in docs.select(*keep).schema) if keep else "none: int"
    out = _removal(docs, list(keep), task, f"{schema}, rest struct<{kinds}>")
    return out.select(*[c for c in out.columns if c != "rest"], *[F.col("rest")[c].alias(c) for c in keep])


def remove_repeats(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, kept bytes, removed spans) of each document, and the columns
    named in ``keep``."""
    return _whole(docs, keep, _bytes_task, "doc_id long, kept binary, spans array<struct<start:long,end:long>>")


def remaining_texts(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, text) of each document, and the columns named in ``keep``.
    What is left of a character cut in two goes as well."""
    return _whole(docs, keep, _text_task, "doc_id long, text string")
