"""Benchmark decontamination by BM25 and block-max WAND.

The test items are indexed: for each term the items that have it with their BM25
impacts, in blocks of items with each block's greatest impact.  An impact is
divided by the item's score against itself, so a score is the share of an item
(by BM25 weight) that a passage holds, and one threshold fits all items.  Items are
indexed by classes of length: up to ``LEAST_STEP`` words, then by powers of two.  For
each class every passage of every document is a query: windows of twice the class's
greatest length, moved on by half a window, so that an item always lies whole in one of
them, and its windows depend on its own length alone, never on the items beside it.  The
tests of WAND come in their order, but
for all passages of a batch at once: first the sum of the terms' greatest impacts,
then, where that reaches the threshold, the sums of the block bounds; a passage with
a block at or above the threshold goes through the WAND loop, which returns *all* items
at or above it.  A pair stands if the passage holds enough of the
question's five-grams and of the answer's words.  The answer is the item's last
sentence, the question what comes before; an item of one sentence has no answer,
which then counts as held.

The index is bounded by ``INDEX_BYTES``; a larger benchmark is searched block
after block of items, with document frequencies of the whole benchmark, and only
one block's index is held at a time.  Long texts are read in stretches of whole
windows.  Null texts have no passages; null, empty or
wordless items match nothing.  One row, the best, comes out for a document (id and
text, however often it is repeated) and item id, however many texts the id stands on
and whatever the blocks are.  Items without an id are told apart by their texts, with
a row each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_columns, durable, slices, where_text

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage needs; of the question's
#: five-grams; of the answer's words.
SCORE, QUESTION, ANSWER, GRAM = 0.6, 0.5, 0.6, 5
#: Words of the items of the first class at most, by which its passages move on; a
#: passage has twice as many.
LEAST_STEP = 64
#: Text of the items in one index; blocks of items at most, and items of a block
#: at least; bounds of all terms and blocks (4 bytes each); words queried at once;
#: characters that are cut into words at once.
INDEX_BYTES, BLOCKS, BLOCK, BOUNDS, CHUNK, CHARS = 8 << 20, 256, 4, 1 << 24, 200_000, 500_000

_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPACE = re.compile(r"[ \t\n\r]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words before the last sentence, and of it."""
    parts = [w for p in _SENTENCE.split(text) if (w := words_of(p))]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[bytes], n: int = GRAM) -> set[tuple[bytes, ...]]:
    """The n-grams of some words; fewer words are one gram."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Index:
    """Items, postings by term number, and block bounds."""

    ids: list
    texts: list[str]
    vocabulary: dict[bytes, int]
    postings: list[tuple[list[int], list[float]]]
    bounds: np.ndarray  # term, block
    most: list[float]
    own: list[float]  # each item's score against itself
    questions: list[set]
    answers: list[Counter]
    step: int
    block: int


def build(items: list[tuple], frequency: dict[bytes, int], n_items: int, mean_words: float, parts: int = 1, step: int = LEAST_STEP) -> Index:
    """The index of a class's (id, text) items under a benchmark's statistics; one
    of so many that share the room for bounds."""
    kept = [(i, t, w) for i, t in items if t and (w := words_of(t))]
    vocabulary = {w: n for n, w in enumerate(sorted({x for _, _, ws in kept for x in ws}))}
    impacts: list[dict[int, float]] = [{} for _ in vocabulary]
    own = []
    for d, (_, _, ws) in enumerate(kept):
        norm = K1 * (1 - B + B * len(ws) / mean_words)
        weight = {w: math.log(1 + (n_items - frequency[w] + 0.5) / (frequency[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
        own.append(sum(weight[w] for w in sorted(weight)))
        for w, x in weight.items():
            impacts[vocabulary[w]][d] = x / own[d]
    blocks = max(1, min(BLOCKS, BOUNDS // parts // max(1, len(vocabulary))))
    block = max(BLOCK, -(-len(kept) // blocks))
    postings = [(sorted(p), [p[d] for d in sorted(p)]) for p in impacts]
    bounds = np.zeros((max(1, len(vocabulary)), max(1, -(-len(kept) // block))), np.float32)
    for t, (ds, xs) in enumerate(postings):
        for d, x in zip(ds, xs, strict=True):
            bounds[t, d // block] = max(bounds[t, d // block], np.nextafter(np.float32(x), np.float32(2)))
    split = [question_and_answer(t) for _, t, _ in kept]
    return Index([i for i, _, _ in kept], [t if i is None else "" for i, t, _ in kept], vocabulary, postings, bounds, [max(xs) for _, xs in postings], own, [grams(q) for q, _ in split], [Counter(a) for _, a in split], step, block)


def by_length(items: list[tuple]) -> dict[int, list[tuple]]:
    """The (id, text) items by their class: the least of ``LEAST_STEP`` times a
    power of two that is not under their number of words."""
    classes: dict[int, list[tuple]] = {}
    for i, t in items:
        n = -(-len(words_of(t or "")) // LEAST_STEP)
        classes.setdefault(LEAST_STEP << max(0, n - 1).bit_length(), []).append((i, t))
    return dict(sorted(classes.items()))


def search(index: Index, terms: list[int], threshold: float = SCORE) -> list[tuple[int, float]]:
    """All items with a score of the threshold or more, by block-max WAND."""
    out = []
    # [next item, place in the list, term]
    lists = [[index.postings[t][0][0], 0, t] for t in terms]
    threshold -= 1e-9

    def move(x: list, to: int) -> None:
        ds = index.postings[x[2]][0]
        lo, hi = x[1], len(ds)
        while lo < hi:
            mid = (lo + hi) // 2
            if ds[mid] < to:
                lo = mid + 1
            else:
                hi = mid
        x[1] = lo
        x[0] = ds[lo] if lo < len(ds) else -1

    while lists:
        lists.sort()
        bound, pivot = 0.0, None
        for k, x in enumerate(lists):
            bound += index.most[x[2]]
            if bound >= threshold:
                pivot = k
                break
        if pivot is None:
            break
        d = lists[pivot][0]
        while pivot + 1 < len(lists) and lists[pivot + 1][0] == d:
            pivot += 1
        block = d // index.block
        if sum(float(index.bounds[x[2], block]) for x in lists[: pivot + 1]) < threshold:
            # no item before the block's end or the next list's item can do it
            to = (block + 1) * index.block
            if pivot + 1 < len(lists):
                to = min(to, lists[pivot + 1][0])
            for x in lists[: pivot + 1]:
                move(x, max(to, d + 1))
        elif lists[0][0] == d:
            score = 0.0
            for x in lists[: pivot + 1]:
                score += index.postings[x[2]][1][x[1]]
                move(x, d + 1)
            if score >= threshold:
                out.append((d, score))
        else:
            for x in lists[:pivot]:
                if x[0] < d:
                    move(x, d)
        lists = [x for x in lists if x[0] >= 0]
    return out


def _verified(index: Index, d: int, words: list[bytes], held: set, bag: Counter) -> tuple[float, float]:
    """Shares of the question's grams and of the answer's words; a question of
    fewer words is looked for as a whole."""
    q, a = index.questions[d], index.answers[d]
    n = len(next(iter(q), ()))
    held = held if n == GRAM else grams(words, n)
    question = len(q & held) / len(q) if q else 1.0
    answer = sum((a & bag).values()) / sum(a.values()) if a else 1.0
    return question, answer


def stretches(text: str, size: int, reach: int) -> Iterator[list[bytes]]:
    """The words of a text in stretches of ``size`` and the ``reach`` behind it; the
    text is cut into words part by part, at white space."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + CHARS)
        end = cut.end() if cut else len(text)
        held += words_of(text[at:end])
        at = end
        while len(held) > size + reach:
            yield held[: size + reach]
            del held[:size]
    if held:
        yield held


def find(group: list[Index], texts: list[str]) -> Iterator[tuple[int, Index, int, float, float, float]]:
    """(text, index, item, score, question, answer): the best passage of each
    verified pair, once for each stretch of a text that has one."""
    reach = max((index.step for index in group), default=1)
    size = -(-CHUNK // reach) * reach  # whole steps of every class
    own: list[tuple[int, list[bytes]]] = []
    n = 0

    def search_own() -> Iterator[tuple[int, Index, int, float, float, float]]:
        for index in group:
            # a class needs one of its own steps behind the stretch
            for i, *found in _find_some(index, [(i, words[: size + index.step]) for i, words in own]):
                yield i, index, *found

    for i, text in enumerate(texts):
        for words in stretches(text, size, reach):
            own.append((i, words))
            n += len(words)
            if n >= CHUNK:
                yield from search_own()
                own, n = [], 0
    yield from search_own()


def _find_some(index: Index, own: list[tuple[int, list[bytes]]]) -> Iterator[tuple[int, int, float, float, float]]:
    if not own or not index.ids:
        return
    step = index.step
    # steps of words, numbered through all texts; passage k holds the steps k and k+1 of one text
    n_words = np.array([len(w) for _, w in own])
    n_steps = -(-n_words // step)
    base = np.cumsum(n_steps) - n_steps
    term = np.fromiter((t for _, w in own for t in map(index.vocabulary.get, w, repeat(-1))), np.int64, int(n_words.sum()))
    of = np.repeat(np.arange(len(own)), n_words)
    at = base[of] + (np.arange(len(term)) - (np.cumsum(n_words) - n_words)[of]) // step
    known = term >= 0
    term, at, of = term[known], at[known], of[known]
    back = at > base[of]  # the step also ends the passage before it
    width = len(index.vocabulary)
    key = np.unique(np.concatenate([at * width + term, (at[back] - 1) * width + term[back]]))
    if not len(key):
        return
    passage, term = key // width, key % width
    start = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]]))
    ends = np.append(start, len(key))
    alive = np.flatnonzero(np.add.reduceat(index.bounds.max(axis=1)[term], start) >= SCORE - 1e-4)
    if not len(alive):
        return
    size = (ends[1:] - start)[alive]
    first = np.cumsum(size) - size
    own_term = term[np.arange(size.sum()) - np.repeat(first, size) + np.repeat(start[alive], size)]
    most = np.zeros(len(alive), np.float32)
    for b in range(index.bounds.shape[1]):
        np.maximum(most, np.add.reduceat(index.bounds[:, b][own_term], first), out=most)
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for k in alive[most >= SCORE - 1e-4]:
        p = int(passage[start[k]])
        i = int(np.searchsorted(base, p, side="right") - 1)
        hits = search(index, term[ends[k] : ends[k + 1]].tolist())
        if not hits:
            continue
        first = (p - int(base[i])) * step
        words = own[i][1][first : first + 2 * step]
        held, bag = grams(words), Counter(words)
        for d, score in hits:
            question, answer = _verified(index, d, words, held, bag)
            if question >= QUESTION and answer >= ANSWER:
                found[i, d] = max(found.get((i, d), (0.0, 0.0, 0.0)), (score, question, answer))
    for (i, d), (score, question, answer) in found.items():
        yield own[i][0], d, score, question, answer


def indexes(benchmark: DataFrame) -> Iterator[tuple[list[Index], int]]:
    """The benchmark's index in blocks of bounded text, each a few indexes of
    items of like length, with the number of blocks.

    Only one block of items, and its words' frequencies, is on the driver at a
    time; frequencies and lengths are counted by Spark over the whole benchmark.
    """
    items = benchmark.where("text is not null").select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-total // INDEX_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [words_of(t.as_py()) for t in batch.column(1)]
            rows = [(w, b, len(ws) if i == 0 else 0, int(i == 0)) for ws, b in zip(lists, batch.column(2).to_pylist(), strict=True) for i, w in enumerate(sorted(set(ws)))]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.binary(), pa.int32(), pa.int64(), pa.int64()], strict=True)], ["word", "block", "words", "items"])

    counted = items.mapInArrow(count, "word binary, block int, words long, items long")
    sums = counted.agg(F.sum("words").alias("words"), F.sum("items").alias("items")).first()
    n, mean = sums["items"] or 0, (sums["words"] or 0) / max(1, sums["items"] or 0)
    if not n:
        return
    by_word = counted.groupBy("word").agg(F.count("*").alias("n"), F.collect_set("block").alias("blocks"))
    if blocks > 1:  # read once for each block
        by_word, items = durable(by_word), durable(items)
    for b in range(blocks):
        frequency = {bytes(r.word): r.n for r in by_word.where(F.array_contains("blocks", b)).select("word", "n").collect()}
        rows = sorted({(r.item_id, r.text) for r in items.where(F.col("block") == b).collect()}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        classes = by_length(rows)
        yield [build(own, frequency, n, mean, len(classes), step) for step, own in classes.items()], blocks


SCHEMA = "doc_id long, item_id long, score double, bm25 double, question_overlap double, answer_overlap double"


_FOUND = "doc_id long, of string, item_id long, item string, score double, bm25 double, question_overlap double, answer_overlap double"


def _md5(text: str) -> str:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def _hits(docs: DataFrame, groups: Iterable[tuple[list[Index], int]]) -> DataFrame | None:
    """A row for each verified pair, with the digests of the text and, where it has
    no id, of the item.  Of several blocks each is searched and written before the
    next one is built."""
    docs, out = doc_columns(docs), None
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in _FOUND.split(", ")]
    names = [x.split()[0] for x in _FOUND.split(", ")]
    for group, blocks in groups:

        def run(batches: Iterator[pa.RecordBatch], group: list[Index] = group) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                rows = []
                for i, index, d, score, q, a in find(group, texts):
                    item = index.ids[d]
                    rows.append((ids[i].as_py(), _md5(texts[i]), item, _md5(index.texts[d]) if item is None else None, score, score * index.own[d], q, a))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        found = docs.mapInArrow(run, _FOUND)
        found = durable(found) if blocks > 1 else found  # so that the next block's index is the only one
        out = found if out is None else out.unionByName(found)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item it holds."""
    out = _hits(docs, indexes(benchmark))
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    best = F.max(F.struct("score", "bm25", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "of", "item_id", "item").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with all their columns.

    An index of one block is searched inside the filter, and no rows are shuffled.
    Of more blocks each writes the ids and digests of the texts that it finds, and
    the documents are joined against those."""
    groups = indexes(benchmark)
    first = next(groups, None)
    if first is None:
        return docs
    if first[1] == 1:
        return where_text(docs, _free_of(first[0]))
    found = _hits(docs, chain([first], groups)).select(F.col("doc_id").alias("_id"), F.col("of").alias("_of")).distinct()
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (F.md5(text.cast("binary")) == found["_of"]), "left_anti")


def _free_of(group: list[Index]):
    """Decides which texts hold no item of the indexes."""

    def decide(texts: list[str]) -> np.ndarray:
        out = np.ones(len(texts), bool)
        out[[i for i, *_ in find(group, texts)]] = False
        return out

    return decide
