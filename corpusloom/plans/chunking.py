"""Segmentation and chunk queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as ops
from ..operators import segments
from ..registry import query
from ..sources.io import table
from .views import CHUNKS_SQL, chunks

_SENTENCES = r"""sentences AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: length(trim(s)) > 0) AS s FROM documents),
flat AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) AS pos FROM sentences),
counted AS (SELECT *, len(regexp_extract_all(sentence, '[\p{L}\p{N}_]+')) AS n FROM flat)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query(f"WITH {_SENTENCES} SELECT doc_id, CAST(pos - 1 AS BIGINT) AS pos, sentence, n AS n_words FROM counted")
def sentences(spark, sf):
    own = ops.split_sentences(_docs(spark, sf), "doc_id")
    return own.select("doc_id", F.posexplode(F.arrays_zip("sentences", "counts")).alias("pos", "x")).select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("x.sentences").alias("sentence"), F.col("x.counts").alias("n_words"))


@query("WITH s AS (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[\\s]+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM documents), f AS (SELECT doc_id, unnest(list_filter(s, lambda x: length(regexp_replace(x, '\\s', '', 'g')) > 0)) AS sentence, unnest(range(len(list_filter(s, lambda x: length(regexp_replace(x, '\\s', '', 'g')) > 0)))) AS pos FROM s) SELECT doc_id, pos, sentence FROM f")
def windowed_sentences(spark, sf):
    """Sentences by a segmenter that reads texts in windows of 300 characters."""
    return segments.segmented(table(spark, sf, "documents"), "doc_id", segments.by_marks, 300)


@query(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+')) AS n_words FROM documents")
def word_count(spark, sf):
    return _docs(spark, sf).select("doc_id", T.words(F.col("text")).alias("n_words"))


def _pack_sql(sizes: str, where: str) -> str:
    return f"""WITH RECURSIVE {_SENTENCES}, sizes AS (SELECT unnest({sizes}) AS size),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM counted {where}),
walk AS (SELECT size, doc_id, k, sentence, CAST(n AS BIGINT) AS cur, CAST(0 AS BIGINT) AS chunk FROM numbered, sizes WHERE k = 1
  UNION ALL SELECT w.size, w.doc_id, s.k, s.sentence, CASE WHEN w.cur + s.n > w.size THEN s.n ELSE w.cur + s.n END, CASE WHEN w.cur + s.n > w.size THEN w.chunk + 1 ELSE w.chunk END
  FROM walk w JOIN numbered s ON s.doc_id = w.doc_id AND s.k = w.k + 1),
texts AS (SELECT size, doc_id, chunk, regexp_replace(regexp_replace(translate(string_agg(sentence, ' ' ORDER BY k), chr(160) || chr(10) || chr(13), '   '), ' +', ' ', 'g'), '^\\s+|\\s+\\z', '', 'g') AS text FROM walk GROUP BY ALL)
SELECT CAST(size AS BIGINT) AS target_length, doc_id, row_number() OVER (PARTITION BY size, doc_id ORDER BY chunk) AS chunk, md5(text) AS text_md5 FROM texts WHERE length(text) > 0"""


@query(f"SELECT doc_id, chunk, text_md5 FROM ({_pack_sql('[1500]', '')})")
def pack_chunks_1500(spark, sf):
    return ops.pack(ops.split_sentences(_docs(spark, sf), "doc_id"), "doc_id", 1500).select("doc_id", "chunk", F.md5("text").alias("text_md5"))


@query(_pack_sql("[50, 500, 1000, 1500, 2000, 2500, 3000]", "WHERE n > 0"))
def pack_chunks_multi(spark, sf):
    return ops.pack_sizes(ops.split_sentences(_docs(spark, sf), "doc_id"), "doc_id", [50, *ops.SIZES]).select("target_length", "doc_id", "chunk", F.md5("text").alias("text_md5"))


@query(f"WITH {CHUNKS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n FROM chunks WHERE length(trim(text)) > 0) SELECT doc_id, author_id || '_[' || book_id || ']_' || n AS label, author_id || '_[' || book_id || ']_1500_' || n AS sized_label FROM n")
def chunk_labels(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id"))
    own = chunks(spark, sf).where(F.length(F.trim("text")) > 0).withColumn("n", n)
    a, b, n = F.col("author_id"), F.col("book_id"), F.col("n")
    return own.select("doc_id", ops.label(a, b, n).alias("label"), ops.label(a, b, n, F.lit(1500)).alias("sized_label"))


@query(f"WITH {CHUNKS_SQL}, chunks_ AS (SELECT CASE WHEN doc_id % 13 = 5 THEN label || 'x' ELSE label END AS label, mask_ratio FROM chunks), seen AS (SELECT label, count(DISTINCT round(mask_ratio, 1)) AS n FROM chunks_ WHERE mask_ratio > 0 GROUP BY label) SELECT label, 9 - coalesce(n, 0) AS n_missing FROM (SELECT DISTINCT label FROM chunks_) LEFT JOIN seen USING (label) WHERE coalesce(n, 0) < 9")
def incomplete_labels(spark, sf):
    split = F.when(F.col("doc_id") % 13 == 5, F.concat("label", F.lit("x"))).otherwise(F.col("label"))
    return ops.incomplete_labels(chunks(spark, sf).withColumn("label", split))


@query(f"WITH {CHUNKS_SQL} SELECT round(avg(CASE WHEN trim(text) = trim(refilled) THEN 1 ELSE 0 END) * 100, 6) AS copy_rate FROM chunks WHERE mask_ratio > 0")
def copy_rate(spark, sf):
    return ops.copy_rate(chunks(spark, sf))


_UNION = f"""WITH {CHUNKS_SQL}, t AS (SELECT doc_id, book_id, author_id, subject, mask_ratio, label, regexp_replace(translate(text, '*', ''), '^\\s+|\\s+\\z', '', 'g') AS text, regexp_replace(translate(refilled, '*', ''), '^\\s+|\\s+\\z', '', 'g') AS refilled FROM chunks),
rows_ AS (SELECT doc_id, book_id, author_id, subject, text, 0.0::DOUBLE AS mask_ratio, false AS is_refilled, label FROM (SELECT *, row_number() OVER (PARTITION BY book_id, text ORDER BY doc_id) AS n FROM t WHERE length(text) > 0) WHERE n = 1
 UNION ALL SELECT doc_id, book_id, author_id, subject, refilled, mask_ratio, true, label || '_' || CAST(mask_ratio AS VARCHAR) FROM t WHERE mask_ratio > 0 AND length(refilled) > 0)"""


def rows_of(spark, sf):
    return ops.originals_and_refilled(chunks(spark, sf).withColumnRenamed("doc_id", "index"))


@query(_UNION + " SELECT doc_id, book_id, md5(text) AS text_md5, mask_ratio, is_refilled, label FROM rows_")
def original_refilled_union(spark, sf):
    return rows_of(spark, sf).select(F.col("index").alias("doc_id"), "book_id", F.md5("text").alias("text_md5"), "mask_ratio", "is_refilled", "label")


@query(_UNION + " SELECT doc_id, label, row_number() OVER (ORDER BY doc_id, is_refilled) - 1 AS chunk_id FROM rows_")
def chunk_row_ids(spark, sf):
    return ops.row_ids(rows_of(spark, sf), "index", "is_refilled").select(F.col("index").alias("doc_id"), "label", "chunk_id")


@query(_UNION + " SELECT subject, author_id, count(*) AS n_chunks, count(DISTINCT book_id) AS n_books FROM rows_ GROUP BY ALL")
def author_stats(spark, sf):
    return ops.author_stats(rows_of(spark, sf))


@query(_UNION + " SELECT subject, count(*) AS n_rows, count(DISTINCT author_id) AS n_authors FROM rows_ GROUP BY GROUPING SETS ((subject), ())")
def dataset_profile(spark, sf):
    return ops.profile(rows_of(spark, sf))
