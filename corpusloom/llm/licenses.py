"""License scans: tags, notice phrases and licence expressions.

Texts are lower-cased (A-Z) and cut into words; an Aho-Corasick automaton over
the words, joined by single blanks, finds every place of every notice phrase.  A
second automaton finds identifier tags in the raw text; what follows a tag on
its line is parsed by the shunting-yard algorithm as an expression of ids joined
by ``with``, ``and`` and ``or`` (binding in this order) and evaluated: ``and`` asks
for both sides, of ``or`` the freer side is chosen (ties: the side that asks for
fewer ids, then the left one).  So an expression has a freedom and the ids that
the freest use of it has to comply with.  After the tags that only expressions
follow, any well-formed id counts; after the loose ones, which prose uses too, an id
has to look like one.

A finding, be it a label of a notice or an expression, weighs 1/2 where it is quite
free and 1 where it allows nothing; weights w give the score 1 - 1 / (1 + sum of w).

Null counts as empty; an empty text has no words, no labels, null word places,
null freedom and score 0.  A malformed expression keeps the ids before its fault.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_columns, slices

#: Phrases of the base contract and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases of our own.
NOTICES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons": "creative-commons",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain": "public-domain",
    "unlicense": "unlicense",
    "eclipse public license": "epl",
    "licensed under the": "licensed",
    "copyright": "copyright",
}
#: Identifier tags, each followed by an expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
#: Those after which any well-formed id counts.
STRICT_TAGS = TAGS[:2]
#: How freely text under a label may be used, 0 to 1; ids are matched by prefix.
FREEDOM = {"cc0": 1.0, "unlicense": 1.0, "public-domain": 1.0, "mit": 0.95, "bsd": 0.95, "apache": 0.9, "isc": 0.95, "mpl": 0.7, "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "cc-by-nc": 0.3, "cc-by-nd": 0.3, "cc-by": 0.85, "agpl": 0.4, "gpl": 0.5, "reserved": 0.0}
UNKNOWN_FREEDOM = 0.5
PRECEDENCE = {"or": 1, "and": 2, "with": 3}

_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TO_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+-]*", re.I | re.A)
_ID = re.compile(r"[a-z0-9.+]*[0-9.+][a-z0-9.+-]*|[a-z0-9.+]+-[a-z0-9.+-]*|mit|isc|zlib|unlicense|wtfpl|psf|apache|gpl|lgpl|agpl|mpl|bsd|epl|proprietary")


def shunting_yard(tokens: list[str]) -> list[str]:
    """Postfix order of an expression; stops at the first fault and keeps the
    operands and complete operations before it."""
    out, stack, operand_next, open_ = [], [], True, 0
    for t in tokens:
        if operand_next:
            if t == "(":
                stack.append(t)
                open_ += 1
                continue
            if t in PRECEDENCE or t == ")":
                break
            out.append(t)
            operand_next = False
        elif t in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand_next = True
        elif t == ")" and open_:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            open_ -= 1
        else:
            break
    if operand_next:  # nothing follows the last operator: drop it and what opened after it
        while stack and stack[-1] == "(":
            stack.pop()
        if stack and out:
            stack.pop()
    return out + [t for t in reversed(stack) if t != "("]


def freedom(label: str) -> float:
    """The freedom of an id by its longest known prefix."""
    known = [k for k in FREEDOM if label.startswith(k)]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN_FREEDOM


def value(postfix: list[str]) -> tuple[set[str], set[str], float] | None:
    """Ids of an expression (an exception is joined to its licence), those that
    the freest choice has to comply with, and its freedom: the better side of
    ``or``, the stricter one of ``and``."""
    stack: list[tuple[set[str], set[str], float]] = []
    for t in postfix:
        if t not in PRECEDENCE:
            stack.append(({t}, {t}, freedom(t)))
            continue
        if len(stack) < 2:
            return stack[-1] if stack else None
        (right, needs_r, fr), (left, needs_l, fl) = stack.pop(), stack.pop()
        if t == "with":
            both = {f"{a} with {b}" for a in left for b in right}
            stack.append((both, both, fl))
        elif t == "and":
            stack.append((left | right, needs_l | needs_r, min(fl, fr)))
        else:
            first = (-fl, len(needs_l)) <= (-fr, len(needs_r))
            stack.append((left | right, needs_l if first else needs_r, max(fl, fr)))
    return stack[-1] if stack else None


def evaluate(postfix: list[str]) -> tuple[set[str], float] | None:
    """All ids of an expression and its freedom."""
    found = value(postfix)
    return found and (found[0], found[2])


def read_expression(text: str, start: int = 0, stop: int | None = None, any_id: bool = False) -> list[str]:
    """The expression at the start of a stretch of text, in postfix order.  What
    follows it is not read.  Ids have to look like ids, unless any well-formed one
    counts."""
    tokens, operand_next = [], True
    for m in _TOKEN.finditer(text, start, len(text) if stop is None else stop):
        t = m[0].lower()
        t = t.rstrip(".-") or t
        if operand_next and t not in ("(", ")") and not (any_id or _ID.fullmatch(t) or tokens[-1:] == ["with"]):
            break
        if not operand_next and t != ")" and t not in PRECEDENCE:
            break
        operand_next = t == "(" or t in PRECEDENCE
        tokens.append(t)
    return shunting_yard(tokens)


def parse_expression(text: str, start: int = 0, stop: int | None = None, any_id: bool = False) -> tuple[set[str], float] | None:
    """Ids and freedom of the expression at the start of a stretch of text; None
    if there is none."""
    return evaluate(read_expression(text, start, stop, any_id))


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of phrases between blanks, and of tags."""
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE).items():
        phrases.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


_LONG = 4 << 20


def scan(text: str) -> tuple[int, int, int | None, int | None, str, str, float, float | None, str]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, the
    freedom of the strictest finding, and the ids to comply with."""
    phrases, tags = automata()
    raw = text.encode("utf-8", "surrogatepass")
    spaced = raw.translate(_TO_WORDS)
    if len(raw) < _LONG:
        joined = b" ".join(spaced.split())
    else:  # no list of all words
        joined = re.sub(rb"  +", b" ", spaced).strip()
    n_words = joined.count(b" ") + 1 if joined else 0
    joined = (b" " + joined + b" ").decode("latin-1")
    n_base, first, last = 0, None, None
    base, labels, at, word = set(), set(), 0, 0
    for end, (length, label, is_base) in phrases.iter(joined):
        labels.add(label)
        if is_base:
            start = end - length + 1
            # blanks before a start tell how many words came before it
            word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
            at = start
            n_base += 1
            base.add(label)
            first = word if first is None else min(first, word)
            last = word if last is None else max(last, word)
    freedoms, needs = [freedom(x) for x in labels], set()
    low = raw.translate(_TO_LOWER)
    if b"license" in low or b"licence" in low:
        low = low.decode("latin-1")
        seen, stop = set(), -1
        for end, tag in tags.iter(low):
            if end in seen:
                continue
            seen.add(end)
            if stop < end:
                stop = low.find("\n", end)
                stop = len(low) if stop < 0 else stop
            if found := value(read_expression(low, end + 1, stop, tag in STRICT_TAGS)):
                labels |= {f"id:{x}" for x in found[0]}
                needs |= found[1]
                freedoms.append(found[2])
    weight = sum(1 - f / 2 for f in sorted(freedoms))
    return n_words, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 1 / (1 + weight), min(freedoms, default=None), ",".join(sorted(needs))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, freedom double, obligations string"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] * 2 + [pa.string()]
    for batch in slices(batches):
        rows = [scan(t.as_py()) for t in batch.column(1)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])


def scan_documents(docs: DataFrame) -> DataFrame:
    """One row for each document: base places and labels, all labels, score (0:
    no notice; nearing 1 with each finding, the faster the stricter), and what the
    expressions came to: the least freedom of all findings, the ids to comply with."""
    return doc_columns(docs).mapInArrow(_run, SCHEMA)
