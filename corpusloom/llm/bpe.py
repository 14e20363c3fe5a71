"""Byte-level BPE encoding and decoding with a two-tier lookup.

A slice of texts is cut into stretches that start at a blank, which no pre-token
reaches across; the distinct ones are numbered, and each is cut by the pattern, looked
up, written in decimal and decoded once.  Texts are put together from them.  Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself a vocabulary entry costs one probe and one comparison.  Tier two, for all
other pre-tokens, merges bytes: a heap of (rank, place) over a doubly linked list
of parts, whose neighbours' merged rank is looked up by their two ids, so a
pre-token of n bytes takes O(n log n), whatever its length.  Both tiers take many
pre-tokens at a time: slots and the ranks of all pairs of bytes come from arrays.

What was worked out is remembered, as packed ids, in two generations of bounded size:
when the young one is full it becomes the old one, and what is still used moves back.  A
text longer than ``LONG`` is worked through in parts of about that size, cut where
no pre-token is cut, so memory is bounded by the longest unbroken run.

Null texts count as empty; an empty text has no tokens.  Equal rows give equal
results, tables may be empty, and only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush, heapreplace
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, slices

#: Entries of a generation of the stretches' memo, and the longest stretch it keeps.
#: Pre-tokens are looked up only for stretches that are not remembered: a quarter will do.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
#: Entries where ids and bytes are returned, which take room themselves.
FEW_ENTRIES = 100_000
#: Characters of a text that are worked on at once.
LONG = 2_000_000
#: Rows and bytes of a slice of which only digests are kept: the larger, the fewer of its
#: stretches are distinct.  Slices whose ids and bytes are returned are the usual ones.
ROWS, BYTES = 5000, 10 << 20
#: Stretches that are cut or written at once, and bytes of pre-tokens that are merged at once.
TOGETHER, MERGED_BYTES = 4096, 40_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash: n keys onto the slots 0 to n-1.

    Keys are put into about n/4 groups by one half of their 64-bit hash.  Going
    from the largest group to the smallest, each group gets the first
    displacement that sends all its keys to free slots; a group of one key gets
    a free slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.groups = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        group = ((hashes >> np.uint64(32)) % np.uint64(self.groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        cut = np.searchsorted(group[order], np.arange(self.groups + 1))
        taken = np.zeros(n, bool)
        self.shift = [0] * self.groups
        tries = np.arange(256, dtype=np.uint64)
        sizes = np.diff(cut)
        for g in np.argsort(-sizes, kind="stable").tolist():
            if sizes[g] < 2:
                break
            h = hashes[order[cut[g] : cut[g + 1]]]
            low, stride, d = h & np.uint64(0xFFFFFFFF), h >> np.uint64(17) | np.uint64(1), np.uint64(0)
            while True:  # 256 displacements at once
                slots = ((low + (tries + d)[:, None] * stride) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(13) & np.uint64(0xFFFFFFFF)) % np.uint64(n)
                slots.sort(axis=1)
                fits = np.flatnonzero((slots[:, 1:] != slots[:, :-1]).all(axis=1) & ~taken[slots.astype(np.int64)].any(axis=1))
                if len(fits):
                    break
                d += np.uint64(256)
            self.shift[g] = int(d) + int(fits[0])
            taken[slots[fits[0]].astype(np.int64)] = True
        free = iter(np.flatnonzero(~taken).tolist())
        for g in np.flatnonzero(sizes == 1).tolist():  # any free slot will do: it is written down as it is
            self.shift[g] = -1 - next(free)
        self.shifts = np.array(self.shift, np.int64)

    def _place(self, h: int, d: int) -> int:
        if d < 0:
            return -1 - d
        return (((h & 0xFFFFFFFF) + d * ((h >> 17) | 1)) * 0x9E3779B97F4A7C15 >> 13 & 0xFFFFFFFF) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key; for any other string, some slot."""
        h = xxhash.xxh3_64_intdigest(key)
        return self._place(h, self.shift[(h >> 32) % self.groups])

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slots of many keys, by their hashes."""
        d = self.shifts[((hashes >> np.uint64(32)) % np.uint64(self.groups)).astype(np.int64)]
        moved = (hashes & np.uint64(0xFFFFFFFF)) + np.maximum(d, 0).astype(np.uint64) * (hashes >> np.uint64(17) | np.uint64(1))
        moved = (moved * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(13) & np.uint64(0xFFFFFFFF)) % np.uint64(self.n)
        return np.where(d < 0, -1 - d, moved.astype(np.int64))


class _Memo:
    """Results by string, in two generations of so many entries."""

    def __init__(self, work_out, entries: int):
        self.work_out, self.entries, self.young, self.old = work_out, entries, {}, {}

    def look_up(self, keys: list[str]) -> list[bytes]:
        """The results of distinct strings; what is not remembered is worked out together."""
        found = list(map(self.young.get, keys))
        absent = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in absent:
            found[i] = self.old.get(keys[i])
            if found[i] is None:
                new.append(i)
        for i, x in zip(new, self.work_out([keys[i] for i in new]), strict=True):
            found[i] = x
        for i in absent:
            if len(keys[i]) <= MEMO_CHARS:
                if len(self.young) >= self.entries:
                    self.old, self.young = self.young, {}
                self.young[keys[i]] = found[i]
        return found


class _Numbers(dict):
    """Numbers from 0 for distinct strings, in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


def _lengths(items: list) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


#: A blank after something that is not white space: no pre-token holds both.
_BREAK = re.compile(r"(?<=\S) ")


def _joined(first: list[bytes], cut: list[np.ndarray], known: list[bytes]) -> list[bytes]:
    """Texts from what their first stretches and, by number, their others became."""
    by_number = np.empty(len(known), object)
    by_number[:] = known
    return [b"".join([f, *by_number[c].tolist()]) for f, c in zip(first, cut, strict=True)]


class BytePairCodec:
    """Encoder and decoder for one vocabulary of byte ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int | None = None):
        self.find = regex.compile(pattern).findall
        self.hash = PerfectHash(list(ranks))
        self.slot_key: list[bytes | None] = [None] * self.hash.n
        self.slot_rank = [0] * self.hash.n
        self.slot_hash = np.zeros(self.hash.n, np.uint64)
        for key, rank in ranks.items():
            s = self.hash.slot(key)
            self.slot_key[s], self.slot_rank[s], self.slot_hash[s] = key, rank, xxhash.xxh3_64_intdigest(key)
        self.pieces: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
        for key, rank in ranks.items():
            self.pieces[rank] = key
        self.decimal = [b" %d" % r for r in range(len(self.pieces))]
        self.decimal_lengths, self.piece_lengths = _lengths(self.decimal), _lengths([p or b"" for p in self.pieces])
        self.packed = [array("i", (r,)).tobytes() for r in range(len(self.pieces))]  # one object for an id, however often it is remembered
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.bits = max(ranks.values(), default=0).bit_length()
        self.first = np.full(1 << 16, 1 << self.bits, np.int64)  # ranks of pairs of bytes; beyond all ranks: none
        merged = {}  # id -> the ids that can follow it -> the id of both together
        for key, rank in ranks.items():
            if len(key) == 2:
                self.first[key[0] << 8 | key[1]] = rank
            for i in range(1, len(key)):
                left, right = ranks.get(key[:i]), ranks.get(key[i:])
                if left is not None and right is not None:
                    merged.setdefault(left, {})[right] = rank
        nothing = {}.get
        self.followed = [merged[r].get if r in merged else nothing for r in range(len(self.pieces))]
        entries = entries or MEMO_ENTRIES
        self.pretokens, self.stretches = _Memo(self._pretokens, max(1, entries // 4)), _Memo(self._behind_blanks, entries)
        self.hits = [0, 0]  # pre-tokens that tier one and tier two worked out

    def whole(self, tokens: list[bytes]) -> list[int | None]:
        """Tier one: the ranks of the pre-tokens that are in the vocabulary."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
        slots = self.hash.slots(hashes)
        found: list[int | None] = [None] * len(tokens)
        for i in np.flatnonzero(self.slot_hash[slots] == hashes).tolist():
            if self.slot_key[slots[i]] == tokens[i]:
                found[i] = self.slot_rank[slots[i]]
        return found

    def merge(self, tokens: list[bytes]) -> Iterator[list[int]]:
        """Tier two: merge the adjacent pair of least rank, leftmost first."""
        upto, at = np.cumsum(_lengths(tokens)), 0
        while at < len(tokens):
            before = upto[at - 1] if at else 0
            n = max(1, int(np.searchsorted(upto, before + MERGED_BYTES, side="right")) - at)
            yield from self._merge(tokens[at : at + n])
            at += n

    def _merge(self, tokens: list[bytes]) -> Iterator[list[int]]:
        followed, lengths = self.followed, _lengths(tokens)
        longest = int(lengths.max())
        place = longest.bit_length()
        here, none = (1 << place) - 1, 1 << self.bits + place
        raw, ends = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64), lengths.cumsum()
        every = self.byte[raw]
        if (every < 0).any():
            raise ValueError("the vocabulary lacks a byte of the texts")
        # rank and place of the pair that starts at each part; ``none`` and above: no pair
        pairs = np.full(len(raw), 1 << self.bits, np.int64)
        pairs[:-1] = self.first[raw[:-1] << 8 | raw[1:]]
        pairs[ends - 1] = 1 << self.bits
        pairs = (pairs << place | np.arange(len(raw)) - np.repeat(ends - lengths, lengths)).tolist()
        every, steps, start = every.tolist(), list(range(-1, longest + 2)), 0
        for end in ends.tolist():
            n, ids, pair = end - start, every[start:end], pairs[start:end]
            after, before = steps[2 : n + 2], steps[:n]
            start = end
            heap = pair[:]  # its last entry is no pair and stays at the bottom
            heapify(heap)
            while (x := heap[0]) < none:
                i = x & here
                if pair[i] != x:
                    heappop(heap)  # one of its two parts has changed since
                    continue
                r = ids[i] = x >> place
                j = after[i]
                k = after[i] = after[j]
                pair[j], ids[j] = none, -1
                q = None
                if k < n:
                    before[k] = i
                    q = followed[r](ids[k])
                if q is None:
                    pair[i] = none
                    heappop(heap)
                else:
                    pair[i] = q = q << place | i
                    heapreplace(heap, q)
                p = before[i]
                if p >= 0:
                    if (q := followed[ids[p]](r)) is None:
                        pair[p] = none
                    else:
                        pair[p] = q = q << place | p
                        heappush(heap, q)
            yield [x for x in ids if x >= 0]

    def _pretokens(self, tokens: list[str]) -> list[bytes]:
        raw = [t.encode() for t in tokens]
        ranks = self.whole(raw)
        merged = self.merge([t for t, r in zip(raw, ranks, strict=True) if r is None])
        two = ranks.count(None)
        self.hits[0] += len(ranks) - two
        self.hits[1] += two
        return [array("i", next(merged)).tobytes() if r is None else self.packed[r] for r in ranks]

    def _strings(self, found: list[str], cuts: list[int]) -> list[bytes]:
        """The ids of strings that are runs of pre-tokens, from one cut to the next."""
        own = list(dict.fromkeys(found))
        packed = list(map(dict(zip(own, self.pretokens.look_up(own), strict=True)).__getitem__, found))
        # a single pre-token is remembered in both memos, and held once
        return [packed[a] if b - a == 1 else b"".join(packed[a:b]) for a, b in pairwise(cuts)]

    def _each(self, strings: list[str]) -> list[bytes]:
        found = list(map(self.find, strings))
        return self._strings(list(chain.from_iterable(found)), [0, *np.cumsum(_lengths(found)).tolist()])

    def _behind_blanks(self, stretches: list[str]) -> list[bytes]:
        done = []
        for at in range(0, len(stretches), TOGETHER):
            own = stretches[at : at + TOGETHER]
            if not any(not s or s[-1].isspace() for s in own):  # the next one's blank is a place to cut
                found = self.find(" " + " ".join(own))
                upto, ends = np.cumsum(_lengths(found)), np.cumsum(_lengths(own) + 1)
                last = np.searchsorted(upto, ends)
                if last[-1] < len(found) and (upto[last] == ends).all():
                    done += self._strings(found, [0, *(last + 1).tolist()])
                    continue
            done += self._each([" " + s for s in own])
        return done

    def look_up(self, texts: list[str]) -> tuple[list[bytes], list[np.ndarray], list[bytes]]:
        """The texts cut into stretches: the ids of each text's first one, the numbers
        of its others, and the ids by number."""
        numbers = _Numbers()

        def numbered(stretches: list[str]) -> np.ndarray:
            return np.fromiter(map(numbers.__getitem__, stretches), np.int32, len(stretches))

        first, cut = [], []
        for t in texts:
            own, blank, rest = t.partition(" ")
            first.append(own), cut.append(numbered(rest.split(" ") if blank else []))
        no_place = np.fromiter((not p or p[-1].isspace() for p in numbers), bool, len(numbers))  # a blank behind white space is no place to cut
        for i, t in enumerate(texts):
            if not first[i] or first[i][-1].isspace() or no_place[cut[i]].any():
                own, *rest = _BREAK.split(t)
                first[i], cut[i] = own, numbered(rest)
        return self._each(first), cut, self.stretches.look_up(list(numbers))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of some texts; each distinct stretch is looked up once."""
        return [np.frombuffer(p, np.intc).tolist() for p in self.packed_all(texts)]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """The same, packed."""
        first, cut, known = self.look_up(texts)
        return _joined(first, cut, known)

    def spelled_all(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids in decimal, a blank before each, and the bytes that
        they are decoded to; each distinct stretch is written and decoded once."""
        first, cut, known = self.look_up(texts)
        kinds = zip(self.spelled(first), self.spelled(known), strict=True)
        return list(zip(*(_joined(a, cut, b) for a, b in kinds), strict=True))

    def spelled(self, packed: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """The same of strings of packed ids."""
        done: tuple[list[bytes], list[bytes]] = [], []
        for at in range(0, len(packed), TOGETHER):
            own = packed[at : at + TOGETHER]
            ids = np.frombuffer(b"".join(own), np.intc)
            ends, every = np.cumsum(_lengths(own)) // ids.itemsize, ids.tolist()
            for out, pieces, lengths in zip(done, (self.decimal, self.pieces), (self.decimal_lengths, self.piece_lengths), strict=True):
                text = b"".join(map(pieces.__getitem__, every))
                upto = np.concatenate([[0], np.cumsum(lengths[ids])])[ends].tolist()
                out += [text[a:b] for a, b in pairwise([0, *upto])]
        return done

    def parts(self, text: str) -> Iterator[str]:
        """The text in parts of about ``LONG`` characters, cut where no
        pre-token is cut."""
        at = 0
        while len(text) - at > LONG:
            found = _BREAK.search(text, at + LONG)
            if not found:
                break
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> list[int]:
        """Ids of a text, each match of the pattern on its own."""
        return list(chain.from_iterable(self.encode_all([p])[0] for p in self.parts(text)))

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a list of ids."""
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec_at(path: str, pattern: str, entries: int | None = None) -> BytePairCodec:
    """The codec of a vocabulary file, built once in each Python worker."""
    return BytePairCodec(read_ranks(path), pattern, entries)


SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded binary"
DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _task(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_at(path, pattern) if digests else codec_at(path, pattern, FEW_ENTRIES)

        def digest(texts: list[str]) -> tuple[list, list, list]:
            counts, first, second = [], [], []
            done = iter(codec.spelled_all([t for t in texts if len(t) <= LONG]))
            for text in texts:
                of_ids, of_bytes, n = hashlib.sha256(), hashlib.sha256(), 0
                for ids, own in (next(done),) if len(text) <= LONG else (codec.spelled_all([p])[0] for p in codec.parts(text)):
                    of_ids.update(ids if n else ids[1:])
                    of_bytes.update(own)
                    n += ids.count(b" ")
                counts.append(n), first.append(of_ids.hexdigest()), second.append(of_bytes.hexdigest())
            return counts, first, second

        def whole(texts: list[str]) -> tuple[list, list, list]:
            ids = [np.frombuffer(b"".join(codec.packed_all([p])[0] for p in codec.parts(t)), np.int32) for t in texts]
            return list(map(len, ids)), ids, [codec.decode(x.tolist()) for x in ids]

        kinds = [pa.string(), pa.string()] if digests else [pa.list_(pa.int32()), pa.binary()]
        names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
        for batch in slices(batches, *(ROWS, BYTES) if digests else ()):
            counts, *rest = (digest if digests else whole)(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), *map(pa.array, rest, kinds)], ["doc_id", "n_tokens", *names])

    return run


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document; decoded are the bytes
    that decoding the ids gives back."""
    return doc_columns(docs).mapInArrow(_task(path, pattern, False), SCHEMA)


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode, decode, digest
    in the task, so ids never leave it."""
    return doc_columns(docs).mapInArrow(_task(path, pattern, True), DIGEST_SCHEMA)


def encode_with_digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): :func:`encode_documents` with a
    digest in place of the decoded bytes."""
    return encode_documents(docs, path, pattern).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
