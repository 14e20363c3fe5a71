"""Language identification with bit-sliced Bloom filters of letter n-grams.

All languages share one filter.  A slot is a machine word in which bit *l*
belongs to language *l* (beyond 64 languages a slot has several words), so the AND
of the slots of an n-gram gives at once all languages that contain it.  A document's n-grams are counted for each language
(popcounts of the bit planes), the counts are corrected for the false positives
that the fill of each plane lets expect, and the largest corrected count decides.

Null texts and texts without letters give ``und`` and score 0.  Ties go to the
language whose name sorts first; a text with letters of which no language knows
an n-gram goes to the language with most training documents, at score 0.  An
empty table or one without labelled rows gives only ``und``.  A text longer than
``CHUNK`` is worked through in windows, whose n-grams reach back into the one before.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_remainder, in_share, mixed, parts_of, slices, where_text

#: Lengths of the n-grams.
ORDERS = (2, 3, 4)
#: Labelled documents of each language to learn from, about.
DOCS_PER_LANGUAGE = 2000
#: An n-gram belongs to the languages whose rate is at least this share of its best rate.
RATE_SHARE = 0.25
#: And where it was seen so often at least; in a small sample once for each so
#: many n-grams, and once more.
LEAST_SEEN, SEEN_EACH = 3, 50_000
#: Slots (of 8 bytes) for each n-gram, and probes.
SLOTS_EACH, PROBES = 12, 3
#: Characters that are worked on at once.
CHUNK = 400_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of the texts, each run of other characters one blank
    and a blank at both ends: code points, their document, letters in each."""
    lows = [t.lower() for t in texts]
    points = np.frombuffer("".join(f" {t} " for t in lows).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lows])
    letter = _letters()[points]
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    keep[:1] = True
    return np.where(letter, points, np.uint32(32))[keep], doc[keep], n_letters


def ngram_hashes(points: np.ndarray, doc: np.ndarray, orders: tuple[int, ...] = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all n-grams that stay in one document, and its number."""
    found, of = [], []
    p = points.astype(np.uint64)
    for n in orders:
        if len(p) < n:
            continue
        m = len(p) - n + 1
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = h << np.uint64(15) ^ h >> np.uint64(49) ^ p[i : i + m]
        inside = doc[:m] == doc[n - 1 :]
        found.append(mixed(h[inside]))
        of.append(doc[:m][inside])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(of)


def _windows(text: str) -> Iterator[tuple[np.ndarray, int]]:
    """The folded points of one text in parts, and the letters of each part."""
    blank = False
    for at in range(0, len(text), CHUNK):
        low = text[at : at + CHUNK].lower()
        points = np.frombuffer((low if at else f" {low}").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[:1] |= not blank
        points = np.where(letter, points, np.uint32(32))[keep]
        blank = not letter[-1] if len(letter) else blank
        yield points, int(letter.sum())
    if not blank:
        yield np.full(1, 32, np.uint32), 0


def ngram_parts(texts: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of texts of about ``CHUNK`` characters together: first, last plus
    1, the n-gram hashes, the text of each (from 0 in the range), and letters.  A
    longer text comes alone, in several parts."""
    start = size = 0
    for i in range(len(texts) + 1):
        long = i < len(texts) and len(texts[i]) > CHUNK
        if start < i and (long or size >= CHUNK or i == len(texts)):
            points, doc, letters = folded(texts[start:i])
            yield (start, i, *ngram_hashes(points, doc), letters)
            start, size = i, 0
        if long:
            tail = np.zeros(0, np.uint32)
            for points, letters in _windows(texts[i]):
                both = np.concatenate([tail, points])
                own = [ngram_hashes(both[max(0, len(tail) - n + 1) :], np.zeros(len(both) - max(0, len(tail) - n + 1), np.int64), (n,))[0] for n in ORDERS]
                h = np.concatenate(own)
                yield i, i + 1, h, np.zeros(len(h), np.int64), np.array([letters])
                tail = both[1 - max(ORDERS) :]
            start = i + 1
        elif i < len(texts):
            size += len(texts[i]) + 2


@dataclass(frozen=True)
class LanguageFilter:
    """Languages by bit, the slots, and the language to fall back to."""

    languages: list[str]
    slots: np.ndarray  # one word for each slot; for more languages, rows of such
    usual: str

    def planes(self) -> np.ndarray:
        """The slots as rows of words, a row for each 64 languages."""
        return self.slots.reshape(-1, self.slots.shape[-1])

    def contains(self, hashes: np.ndarray, plane: int = 0) -> np.ndarray:
        """For each hash the word of all languages that contain it."""
        slots = self.planes()[plane]
        size = np.uint64(len(slots) - 1)
        step = hashes >> np.uint64(32) | np.uint64(1)
        found = slots[(hashes & size).astype(np.int64)]
        for i in range(1, PROBES):
            found = found & slots[(hashes + np.uint64(i) * step & size).astype(np.int64)]
        return found

    def false_rates(self) -> np.ndarray:
        """For each language the share of unseen n-grams it claims to contain."""
        planes = self.planes()
        fill = [np.count_nonzero(planes[b // 64] >> np.uint64(b % 64) & np.uint64(1)) / planes.shape[1] for b in range(len(self.languages))]
        return np.array(fill) ** PROBES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the n-grams that each language contains, all its
        n-grams, and its letters."""
        held = np.zeros((len(texts), max(1, len(self.languages))))
        total, letters = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b, hashes, of, n_letters in ngram_parts(texts):
            total[a:b] += np.bincount(of, minlength=b - a)
            letters[a:b] += n_letters
            for plane in range(-(-len(self.languages) // 64)):
                masks = self.contains(hashes, plane)
                for bit in range(min(64, len(self.languages) - 64 * plane)):
                    held[a:b, 64 * plane + bit] += np.bincount(of[(masks >> np.uint64(bit) & np.uint64(1)).astype(bool)], minlength=b - a)
        return held, total, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (the corrected share of n-grams it contains)."""
        counts, total, letters = self.counts(texts)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        wrong = self.false_rates()
        counts = np.clip((counts - wrong * total[:, None]) / (1 - np.minimum(wrong, 0.999)), 0, None)
        best = counts.argmax(axis=1)
        top = counts[np.arange(len(texts)), best]
        scores = np.where(total > 0, np.minimum(1, top / np.maximum(total, 1)), 0) * (letters > 0)
        return ["und" if not n else self.languages[k] if x > 0 else self.usual for n, k, x in zip(letters, best, top, strict=True)], scores


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            for _, _, hashes, _, _ in ngram_parts(own):
                h, n = np.unique(hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["lang", "h", "n"])


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> LanguageFilter:
    """Learn from (text, lang, doc_id) rows with text and lang.

    The bound of the sample is ``docs_per_language``: of a language with more
    rows, those are taken whose hashed id is in the share that gives about as
    many.  N-grams are counted by Spark; the n-grams that some language owns come
    to the driver, all of them, and the filter's size follows their number.
    """
    labelled = labelled.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageFilter([], np.zeros(64, np.uint64), "und")
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(parts_of(docs_per_language, sizes[k])).cast("long"))])
    rows = labelled.where(in_share("doc_id", share[F.col("lang")])).select("text", "lang")
    counts = rows.mapInArrow(_count_ngrams, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    number = F.create_map(*[x for i, k in enumerate(languages) for x in (F.lit(k), F.lit(i))])
    total = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(float(totals.get(k) or 1)))])
    often = F.col("n") >= F.least(F.lit(LEAST_SEEN), 1 + F.floor(total[F.col("lang")] / SEEN_EACH))
    by_h = counts.withColumn("r", F.col("n") / total[F.col("lang")]).groupBy("h").agg(
        F.max("r").alias("most"), F.collect_list(F.struct(number[F.col("lang")].alias("number"), "r", often.alias("often"))).alias("by")
    )
    mine = F.filter("by", lambda x: (x.r >= RATE_SHARE * F.col("most")) & x.often)

    def word(plane: int):
        bit = lambda x: F.when(F.floor(x.number / 64) == plane, F.call_function("shiftleft", F.lit(1).cast("long"), x.number % 64)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(mine, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(bit(x))).alias(f"mask{plane}")

    planes = -(-len(languages) // 64)
    kept = by_h.select("h", *map(word, range(planes))).where(" or ".join(f"mask{p} != 0" for p in range(planes))).toArrow()
    size = 1 << max(6, int(np.ceil(np.log2(max(1, len(kept) * SLOTS_EACH)))))
    slots = np.zeros((planes, size), np.uint64)
    h = kept["h"].to_numpy().view(np.uint64)
    for plane in range(planes):
        mask = kept[f"mask{plane}"].to_numpy().view(np.uint64)
        for i in range(PROBES):
            np.bitwise_or.at(slots[plane], (h + np.uint64(i) * (h >> np.uint64(32) | np.uint64(1)) & np.uint64(size - 1)).astype(np.int64), mask)
    return LanguageFilter(languages, slots, max(languages, key=lambda k: (sizes[k], k)))


def predict(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Append ``lang_pred`` and ``score`` to ``doc_id``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            labels, scores = model.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def predict_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from the rows that are not
    held out (crc32 of the id as text, modulo 4, is not 2)."""
    model = fit(docs.where(crc_remainder("doc_id", 4) != 2))
    return predict(docs, model).select("doc_id", F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def filter_documents(docs: DataFrame, least: float) -> DataFrame:
    """The rows whose text is in a learned language: not ``und``, and ``least``
    at least of its n-grams belong to the language.  Columns stay as they are;
    the model learns as in :func:`predict_documents`."""
    model = fit(docs.where(crc_remainder("doc_id", 4) != 2))

    def spoken(texts: list[str]) -> np.ndarray:
        labels, scores = model.predict(texts)
        return (np.array(labels) != "und") & (scores >= least)

    return where_text(docs, spoken)
