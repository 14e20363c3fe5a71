"""Cleaning queries.  Their input has every marker that the rules look for put
around the documents' texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as ops
from ..registry import query
from ..sources.io import table

BEFORE = "[Sidenote: x y]  (3) {cite {a} b}{7} -- [2]\n*   *   *\n------\n_stress_ and *bold*\n ***\n“q” "
AFTER = " ❦†\n[Illustration: a]\n illustration \nChapter IV. The end\nA line with chapter inside\n 12 \n[pg 4] left\nsee http://a.b/c?d=1 and www.x.y here\n\n \n\nend  of\t\ttext_"
_lit = lambda s: " || ".join("chr(10)" if p == "\n" else "'" + p.replace("'", "''") + "'" for p in re.split("(\n)", s) if p)
DIRTY_SQL = f"dirty AS (SELECT doc_id, {_lit(BEFORE)} || coalesce(text, '') || {_lit(AFTER)} AS text FROM documents)"
TOC = "Contents\n1. One\n\n2 Two\nList of illustrations\nBody starts\nVOLUME I\n3. skipped\nText\nchapter one\n"


def dirty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit(BEFORE), F.coalesce("text", F.lit("")), F.lit(AFTER)).alias("text"))


def rr(x: str, pattern: str, to: str = "") -> str:
    """DuckDB: replace all."""
    return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"


# The cleaning patterns again, as DuckDB's engine reads them.
_ANNOTATIONS, _ANNOTATIONS_ONLY = "translate(text, chr(160) || chr(8203), '  ')", "text"
for _p in (r"(?i)\[(?:Side[\s-]?note|Sidenote)\s*:\s*[^\]]+\]", r"\[\d+\]|\{\d+\}|\(\s*\d+\s*\)", r"(?s)\{(?:[^{}]|\{[^{}]*\})*\}", r"(?ms)^\s*-{5,}\s*\*?.+?-{5,}\s*$", r"(?m)^\s*\*(?:\s{2,}\*)+\s*$|^\s*[*\-~#]{5,}\s*$"):
    _ANNOTATIONS, _ANNOTATIONS_ONLY = rr(_ANNOTATIONS, _p), rr(_ANNOTATIONS_ONLY, _p)
_FORMAT = rr(f"replace(translate(text, '“”‘’', '\"\"' || chr(39) || chr(39)), '--', '—')", r"[_*]+([\p{L}\p{N}_]+)[_*]+", r"\1")
_FORMAT = rr(f"translate({_FORMAT}, '❦†‡※', '')", r"(?m)^\s*[\*_]+\s*$")
_METADATA = "text"
for _p, _t in ((r"(?i)\[Illustration[^\]]*\]", ""), (r"(?is)illustration:.*?(\n\n|\z)", r"\1"), (r"(?s)\{Illustration:.*?\}", ""), (r"(?mi)^\s*illustration\s*$", ""), (r"(?mi)^\s*chapter\s*(?:\d+|I{1,3}|IV|IX|V?I{0,3})\s*.*$", ""), (r"(?mi)^.*\bchapter\b.*$", ""), (r"(?mi)^\s*\d+\s*$|^\s*\[pg\s*\d+\]", ""), (r"https?://\S+|www\.\S+", "")):
    _METADATA = rr(_METADATA, _p, _t)
_TIDY = rr(f"trim({rr(rr('text', chr(92) + 'n' + chr(92) + 's*' + chr(92) + 'n+', chr(10) * 2), '[ ' + chr(92) + 't]+', ' ')}, '_')", r"^\s+|\s+\z")
# The block behind a note ends before a line that begins with a bracket, a brace
# or a digit, or with white space up to the text's end or another line's end.
_FOOTNOTES = rr("text", r"(?ms)^\s*\[\d+\]\s+(?:[\p{L}\p{N}_]+\s+){3,}.*?(\n\s*(?:\[|\{|\d|$))", r"\1")
_TOC_STEPS = """lines AS (SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM src)),
states AS (SELECT *, CASE WHEN regexp_matches(bare, '(?i)^(Contents|VOLUME|CHAPTER|List of Illustrations)') THEN true WHEN length(bare) > 0 AND NOT regexp_matches(bare, '^\\d+\\.?\\s') THEN false END AS state FROM lines),
kept AS (SELECT * FROM (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS skip FROM states) WHERE NOT skip AND NOT regexp_matches(bare, '(?i)^(VOLUME|CHAPTER)'))"""


@query(f"WITH {DIRTY_SQL} SELECT doc_id, {_ANNOTATIONS} AS text FROM dirty")
def clean_annotations(spark, sf):
    return dirty(spark, sf).select("doc_id", ops.drop_annotations(ops.plain_spaces(F.col("text"))).alias("text"))


@query(f"WITH {DIRTY_SQL} SELECT doc_id, {_FORMAT} AS text FROM dirty")
def clean_format(spark, sf):
    return dirty(spark, sf).select("doc_id", ops.normal_format(F.col("text")).alias("text"))


@query(f"WITH {DIRTY_SQL} SELECT doc_id, {_METADATA} AS text FROM dirty")
def clean_metadata_lines(spark, sf):
    return dirty(spark, sf).select("doc_id", ops.drop_metadata(F.col("text")).alias("text"))


@query(f"WITH {DIRTY_SQL} SELECT doc_id, {_TIDY} AS text FROM dirty")
def clean_whitespace(spark, sf):
    return dirty(spark, sf).select("doc_id", ops.tidy(F.col("text")).alias("text"))


@query(f"WITH {DIRTY_SQL} SELECT doc_id, trim(regexp_replace(translate(text, chr(160) || chr(10) || chr(13), '   '), ' +', ' ', 'g')) AS text FROM dirty")
def clean_extra_whitespace(spark, sf):
    return dirty(spark, sf).select("doc_id", ops.extra_whitespace(F.col("text")).alias("text"))


@query(f"""SELECT doc_id, {_FOOTNOTES} AS text FROM (SELECT doc_id, 'Lead.' || chr(10) || '[1] a note of many words ' || coalesce(text, '') || chr(10) || chr(10) || 'Body.' AS text FROM documents)""")
def clean_footnotes(spark, sf):
    text = F.concat(F.lit("Lead.\n[1] a note of many words "), F.coalesce("text", F.lit("")), F.lit("\n\nBody."))
    return table(spark, sf, "documents").select("doc_id", text.alias("text")).select("doc_id", ops.drop_footnotes("text").alias("text"))


@query(f"""WITH src AS (SELECT doc_id, {_lit(TOC)} || coalesce(text, '') AS text FROM documents), {_TOC_STEPS}
SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id""")
def clean_toc(spark, sf):
    text = F.concat(F.lit(TOC), F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", ops.without_contents(text).alias("text"))


_BOOK = _FOOTNOTES.replace("text", "translate(text, chr(160) || chr(8203), '  ')")
_STEPS = f"""WITH {DIRTY_SQL}, s1 AS (SELECT doc_id, {_ANNOTATIONS_ONLY} AS text FROM (SELECT doc_id, {_BOOK} AS text FROM dirty)),
s2 AS (SELECT doc_id, {_FORMAT} AS text FROM s1), src AS (SELECT doc_id, {_METADATA} AS text FROM s2), {_TOC_STEPS}"""


@query(_STEPS + f""", joined AS (SELECT d.doc_id, coalesce(k.text, '') AS text FROM documents d LEFT JOIN (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM kept GROUP BY doc_id) k USING (doc_id))
SELECT doc_id, {_TIDY} AS text FROM joined""")
def clean_books(spark, sf):
    return ops.clean_books(dirty(spark, sf))


@query(r"""SELECT p_partkey AS book_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(p_name || ', Chapters ' || CAST(p_size AS VARCHAR) || ' to the Last' || chr(10) || 'of, Chapter 3 and, Part 5.', '\s+', ' ', 'g')),
  '(?i),\s*Chapters?\s+\d+\s*(?:to|-)\s*(?:\d+|the Last)', '', 'g'), '(?i),\s*Chapters?\s+\d+', '', 'g'), '(?i),\s*Part\s+\d+\.?', '', 'g') AS title FROM part""")
def clean_title(spark, sf):
    raw = F.concat("p_name", F.lit(", Chapters "), F.col("p_size").cast("string"), F.lit(" to the Last\nof, Chapter 3 and, Part 5."))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("book_id"), ops.clean_title(raw).alias("title"))


_ODD = r"\u200bzero\ufeff \u200eleft\u061c\u00a0no\u2007break\u202f so\u00adft \x01c\x9fd\ttab"
_ODD_SQL = " || ".join(f"chr({ord(c)})" for c in _ODD.encode().decode("unicode_escape"))


@query(f"""WITH odd AS (SELECT doc_id, {_ODD_SQL} || coalesce(text, '') AS text FROM documents)
SELECT doc_id, list_aggregate(list_transform(list_filter(string_split(text, ''), lambda c: NOT (unicode(c) IN (8203, 8204, 8205, 8288, 65279, 8206, 8207, 1564, 173) OR unicode(c) BETWEEN 0 AND 8 OR unicode(c) IN (11, 12) OR unicode(c) BETWEEN 14 AND 31 OR unicode(c) BETWEEN 127 AND 159)),
  lambda c: CASE WHEN unicode(c) IN (160, 8199, 8239) THEN ' ' ELSE c END), 'string_agg', '') AS text FROM odd""")
def clean_hygiene(spark, sf):
    """All five rules, over documents with a character of each kind in front."""
    odd = F.lit(_ODD.encode().decode("unicode_escape"))
    return table(spark, sf, "documents").select("doc_id", ops.hygiene(F.concat(odd, F.coalesce("text", F.lit("")))).alias("text"))


@query("SELECT doc_id, translate(coalesce(text, ''), '*', '') AS text FROM documents WHERE length(trim(translate(coalesce(text, ''), '*', ''))) > 0")
def clean_stars(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.translate(F.coalesce("text", F.lit("")), "*", "").alias("text")).where(F.length(F.trim("text")) > 0)
