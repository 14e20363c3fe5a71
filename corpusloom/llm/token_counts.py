"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton enumerates the vocabulary pieces inside a word; a
dynamic programme over character places carries the best score and its number
of pieces only.  Tie rules are those of the public unigram tokenizers: starts
are taken in ascending order, at one start short pieces come first, and a later
candidate must be strictly better.  A character no piece of length one covers
may stand alone at the vocabulary's least score minus 10; such characters count
as their UTF-8 bytes where the vocabulary has byte pieces, else a run of them as
one piece.

A blank becomes U+2581; words are split before each U+2581 and one is put in
front of a text that has none there.  Null counts as empty: no pieces, score 0.

A long word keeps the last places only that a piece can reach back to, and a long
text is worked through in parts cut at blanks, so memory is bounded by neither.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, slices

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
#: Entries of the per-worker memo of words, and the longest word kept in it.
MEMO_ENTRIES, MEMO_CHARS = 300_000, 64
#: Characters of a word beyond which its places are kept in a ring; of a text that
#: are split at once.
LONG_WORD, LONG = 4096, 2_000_000


def read_pieces(path: str) -> tuple[dict[str, float], bool]:
    """Normal pieces with their scores, and whether there are byte pieces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return {p.piece: p.score for p in model.pieces if p.type == 1}, any(p.type == 6 for p in model.pieces)


class _Memo(dict):
    def __init__(self, work_out):
        super().__init__()
        self.work_out = work_out

    def __missing__(self, word: str) -> tuple[float, int]:
        return self.work_out(word)


class UnigramCounter:
    """Best score and number of pieces of texts."""

    def __init__(self, pieces: dict[str, float], byte_pieces: bool):
        self.unknown = (min(pieces.values()) if pieces else 0.0) - UNKNOWN_PENALTY
        self.byte_pieces = byte_pieces
        self.matcher = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.matcher.add_word(piece, (len(piece), score))
        if pieces:
            self.matcher.make_automaton()
        self.longest = max(map(len, pieces), default=1)
        self.memo = _Memo(self._word)

    def count_word(self, word: str) -> tuple[float, int]:
        """The dynamic programme over one word.

        Matches come by their ends, the longest first, so at a place the candidate
        of the earliest start comes first."""
        n = len(word)
        size = n + 1 if n <= LONG_WORD else self.longest + 1
        best, count = [0.0] * size, [0] * size
        run = [False] * size  # the best way ends with an unknown character
        found = self.matcher.iter(word) if len(self.matcher) else iter(())
        end, match = next(found, (-1, None))
        for j in range(n):  # ways that end with the character j
            top, so_far, alone, single = None, 0, False, False
            while end == j:
                length, score = match
                i = (j + 1 - length) % size
                if top is None or best[i] + score > top:
                    top, so_far = best[i] + score, count[i] + 1
                single |= length == 1
                end, match = next(found, (-1, None))
            if not single:
                i = j % size
                if top is None or best[i] + self.unknown > top:
                    top, alone = best[i] + self.unknown, True
                    so_far = count[i] + (len(word[j].encode("utf-8", "surrogatepass")) if self.byte_pieces else not run[i])
            k = (j + 1) % size
            best[k], count[k], run[k] = top, so_far, alone
        return best[n % size], count[n % size]

    def _word(self, word: str) -> tuple[float, int]:
        found = self.count_word(word)
        if len(word) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[word] = found
        return found

    def count(self, text: str) -> tuple[int, float, int]:
        """Pieces, score and words of a text."""
        pieces, score, words = 0, 0.0, 0
        at = int(text[:1] in (" ", BLANK))
        while text:
            end = at + LONG  # and on to the next blank
            end = min((i for i in (text.find(" ", end), text.find(BLANK, end)) if i >= 0), default=len(text)) if end < len(text) else len(text)
            found = [self.memo[BLANK + w] for w in text[at:end].replace(" ", BLANK).split(BLANK)]
            pieces, score, words = pieces + sum(n for _, n in found), sum((s for s, _ in found), score), words + len(found)
            if end == len(text):
                break
            at = end + 1
        return pieces, score, words


@lru_cache(maxsize=2)
def counter_at(path: str) -> UnigramCounter:
    """The counter of a model file, built once in each Python worker."""
    return UnigramCounter(*read_pieces(path))


SCHEMA = "doc_id long, n_tokens long, score double, n_words long"


def count_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, score, n_words) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_at(path)
        for batch in slices(batches):
            rows = list(zip(*(counter.count(t.as_py()) for t in batch.column(1)), strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.int64())], ["doc_id", "n_tokens", "score", "n_words"])

    return doc_columns(docs).mapInArrow(run, SCHEMA)
