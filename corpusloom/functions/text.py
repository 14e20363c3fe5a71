"""Cleaning of book texts: ordered substitutions as column expressions.

Patterns run in Java with ``(?Ud)`` so that ``\\w``, ``\\d``, ``\\s``, ``\\b`` are
Unicode and only ``\\n`` ends a line.  The order of the rules is part of their
meaning.  One rule (footnote blocks) backtracks too deep for Java on long texts
and runs in Python, on Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The cleaning patterns.
SIDENOTE = r"(?Udi)\[(?:Side[\s-]?note|Sidenote)\s*:\s*[^\]]+\]"
MARKER = r"(?Ud)\[\d+\]|\{\d+\}|\(\s*\d+\s*\)"
CITATION = r"(?Uds)\{(?:[^{}]|\{[^{}]*+\})*+\}"
TRANSLATOR = r"(?Udms)^\s*-{5,}\s*\*?.+?-{5,}\s*$"
SEPARATOR = r"(?Udm)^\s*\*(?:\s{2,}\*)+\s*$|^\s*[*\-~#]{5,}\s*$"
EMPHASIS = r"(?Ud)[_*]+(\w+)[_*]+"
STAR_LINE = r"(?Udm)^\s*[\*_]+\s*$"
ILLUSTRATION = r"(?Udi)\[Illustration[^\]]*\]"
ILLUSTRATION_BLOCK = r"(?Udis)illustration:.*?(?=\n\n|\z)"
ILLUSTRATION_BRACES = r"(?Uds)\{Illustration:.*?\}"
ILLUSTRATION_LINE = r"(?Udmi)^\s*illustration\s*$"
CHAPTER = r"(?Udmi)^\s*chapter\s*(?:\d+|I{1,3}|IV|IX|V?I{0,3})\s*.*$"
CHAPTER_LINE = r"(?Udmi)^.*\bchapter\b.*$"
PAGE = r"(?Udmi)^\s*\d+\s*$|^\s*\[pg\s*\d+\]"
URL = r"(?Ud)https?://\S+|www\.\S+"
FOOTNOTE = re.compile(r"^\s*\[\d+\]\s+(?:\w+\s+){3,}.*?(?=\n\s*(?:\[|\{|\d|$))", re.M | re.S)
TOC_HEADER = r"(?Udi)^\s*+(?:Contents|VOLUME|CHAPTER|List of Illustrations)"
TOC_BETWEEN = r"(?Ud)^\s*+(?:\z|\d+\.?\s\s*+\S)"
META_TALK = r"(?Udi)\b(I am an AI assistant|As an AI|I specialize in)\b"
HYGIENE = {
    "zero_width": r"[\u200B\u200C\u200D\u2060\uFEFF]", "bidi": r"[\u200E\u200F\u061C]", "nbsp": r"[\u00A0\u2007\u202F]",
    "soft_hyphen": r"\u00AD", "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]",
}


def _drop(text: Column, *patterns: str) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "")
    return text


#: White space of Unicode (fixed values).
WHITE = " \t\n\v\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(text, F.lit(WHITE))


def plain_spaces(text: Column) -> Column:
    """No-break and zero-width spaces as blanks."""
    return F.translate(text, "\u00a0\u200b", "  ")


def drop_footnotes(column: str) -> Column:
    """Footnote blocks, by Python's engine."""

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else FOOTNOTE.sub("", t))

    return without(column)


def drop_annotations(text: Column) -> Column:
    """Sidenotes, markers, citations, translators' notes, separators."""
    return _drop(text, SIDENOTE, MARKER, CITATION, TRANSLATOR, SEPARATOR)


def normal_format(text: Column, quotes: bool = True) -> Column:
    """Straight quotes, em dashes, no emphasis marks, no ornaments."""
    if quotes:
        text = F.translate(text, "“”‘’", "\"\"''")
    text = F.regexp_replace(F.replace(text, F.lit("--"), F.lit("—")), EMPHASIS, "$1")
    return _drop(F.translate(text, "❦†‡※", ""), STAR_LINE)


def drop_metadata(text: Column, lone_illustrations: bool = True) -> Column:
    """Illustrations, chapter lines, page numbers and addresses."""
    text = _drop(text, ILLUSTRATION, ILLUSTRATION_BLOCK, ILLUSTRATION_BRACES)
    if lone_illustrations:
        text = _drop(text, ILLUSTRATION_LINE)
    return _drop(text, CHAPTER, CHAPTER_LINE, PAGE, URL)


def tidy(text: Column) -> Column:
    """One blank line, one blank; no underscores or white space at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, r"(?U)\n\s*\n+", "\n\n"), r"[ \t]+", " ")
    return strip(F.btrim(text, F.lit("_")))


def extra_whitespace(text: Column) -> Column:
    """Line ends and no-break spaces as blanks, runs of blanks as one."""
    return strip(F.regexp_replace(F.translate(text, "\u00a0\n\r", "   "), " +", " "))


def clean_title(title: Column, empty: str | None = None) -> Column:
    """One line, without chapter ranges, chapters and parts."""
    t = strip(F.regexp_replace(F.regexp_replace(title, r"[\r\n]+", " "), r"(?U)\s+", " "))
    t = _drop(t, r"(?Ui),\s*Chapters?\s+\d+\s*(?:to|-)\s*(?:\d+|the Last)", r"(?Ui),\s*Chapters?\s+\d+", r"(?Ui),\s*Part\s+\d+\.?")
    return t if empty is None else F.when(F.coalesce(F.length(title), F.lit(0)) == 0, empty).otherwise(t)


def without_contents(text: Column) -> Column:
    """A text without its tables of contents.

    A header starts skipping; blank and numbered lines leave the state; any
    other line ends it.  So what goes is each header with the headers, blank and
    numbered lines behind it: lines become letters, and runs of letters are
    found in the string of them.  All of it stays in the row and is linear."""
    lines = F.split(text, "\n", -1)
    kind = lambda x: F.when(x.rlike(TOC_HEADER), "h").when(x.rlike(TOC_BETWEEN), "b").otherwise("t")
    runs = F.regexp_extract_all(F.array_join(F.transform(lines, kind), ""), F.lit("h[hb]*+|[bt]++"), F.lit(0))
    skipped = F.flatten(F.transform(runs, lambda r: F.array_repeat(F.startswith(r, F.lit("h")), F.length(r))))
    kept = F.filter(F.arrays_zip(lines.alias("line"), skipped.alias("skip")), lambda x: ~x.skip)
    return F.array_join(F.transform(kept, lambda x: x.line), "\n")


def clean_books(df: DataFrame, quotes: bool = True, lone_illustrations: bool = True) -> DataFrame:
    """All rules in order on the ``text`` of the rows; null counts as empty."""
    df = df.withColumn("text", plain_spaces(F.coalesce("text", F.lit("")))).withColumn("text", drop_footnotes("text"))
    # a column of its own, as what follows uses it twice
    df = df.withColumn("text", drop_metadata(normal_format(drop_annotations(F.col("text")), quotes), lone_illustrations))
    return df.withColumn("text", tidy(without_contents(F.col("text"))))


def hygiene(text: Column, *kinds: str) -> Column:
    """Optional Unicode rules: no-break spaces become blanks, the rest goes."""
    for k in kinds or HYGIENE:
        text = F.regexp_replace(text, HYGIENE[k], " " if k == "nbsp" else "")
    return text


def words(text: Column) -> Column:
    """Number of runs of letters, digits and underscores."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")).cast("long")


def sentences(text: Column) -> Column:
    """Sentences: cut after ``.``, ``!`` or ``?`` and white space; no blanks."""
    cut = F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001")
    return F.filter(cut, lambda s: F.length(F.trim(s)) > 0)
