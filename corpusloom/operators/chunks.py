"""Chunks: packing of sentences, labels, originals and refilled texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import placed

SIZES = [500, 1000, 1500, 2000, 2500, 3000]
RATIOS = [i / 10 for i in range(1, 10)]


def _ends(limits: list[int]):
    @F.pandas_udf("array<array<int>>")
    def ends(counts: pd.Series) -> pd.Series:
        def one(ns, limit: int) -> list[int]:
            out, size = [], 0
            for i, n in enumerate(ns):
                if i and size + n > limit:
                    out.append(i)
                    size = 0
                size += int(n)
            return [*out, len(ns)] if len(ns) else []

        return counts.map(lambda ns: [one(ns, limit) for limit in limits])

    return ends


def _pack(df: DataFrame, key: str, limits: list[int]) -> DataFrame:
    """(key, limit, chunk, text): where chunks end comes from Python for all
    limits at once, over numbers only; texts are cut out inside the row."""
    own = df.select(key, "sentences", F.posexplode(_ends(limits)("counts")).alias("which", "ends"))
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))
    text = F.transform("ends", lambda end, i: T.extra_whitespace(F.array_join(F.slice("sentences", start(i) + 1, end - start(i)), " ")))
    own = own.select(key, F.get(F.array(*map(F.lit, limits)), F.col("which")).cast("long").alias("target_length"), F.posexplode(F.filter(text, lambda t: F.length(t) > 0)).alias("at", "text"))
    return own.select("target_length", key, (F.col("at") + 1).cast("long").alias("chunk"), "text")


def pack(df: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, chunk, text) of (key, sentences, counts) rows: a chunk closes
    before the sentence that would bring it over the limit, if it has one; a
    longer sentence is its own chunk.  Linear in a document's sentences; nothing is
    shuffled.  Chunks are numbered from 1 after empty ones are dropped."""
    return _pack(df, key, [limit]).drop("target_length")


def split_sentences(df: DataFrame, key: str) -> DataFrame:
    """(key, sentences, counts) of (key, text): computed once for all sizes."""
    return df.select(key, T.sentences(F.col("text")).alias("sentences")).withColumn("counts", F.transform("sentences", T.words))


def pack_sizes(df: DataFrame, key: str, sizes: list[int] = SIZES) -> DataFrame:
    """(target_length, key, chunk, text) for several limits, from one pass;
    sentences without words are left out."""
    some = F.filter(F.arrays_zip("sentences", "counts"), lambda x: x.counts > 0)
    own = df.select(key, some.alias("some")).select(key, F.col("some.sentences").alias("sentences"), F.col("some.counts").alias("counts"))
    return _pack(own, key, sizes)


def label(author: Column, title: Column, number: Column, size: Column | None = None) -> Column:
    """``author_[title]_n``, or with the size before the number."""
    parts = [author, F.lit("_["), title, F.lit("]_")]
    if size is not None:
        parts += [size.cast("string"), F.lit("_")]
    return F.concat(*parts, number.cast("string"))


def primary_subject(subjects: Column, default: str = "") -> Column:
    """The first subject, or the default."""
    return F.coalesce(F.get(subjects, F.lit(0)), F.lit(default))


def cleaned(text: Column) -> Column:
    """A chunk's text without stars and white space at its ends; null is empty."""
    return T.strip(F.translate(F.coalesce(text, F.lit("")), "*", ""))


def digested(rows: DataFrame) -> DataFrame:
    """Rows whose texts stand for themselves by their digests, where only their
    equality matters: what is worked out of them shuffles no texts.  Empty texts stay."""
    digest = lambda c: F.when(F.length(cleaned(F.col(c))) > 0, F.md5(cleaned(F.col(c)))).otherwise("").alias(c)
    return rows.select(*[c for c in rows.columns if c not in ("text", "refilled")], digest("text"), digest("refilled"))


def texts_of(rows: DataFrame) -> DataFrame:
    """(index, is_refilled, text): both cleaned texts of each row."""
    one = lambda c, refilled: F.struct(F.lit(refilled).alias("is_refilled"), cleaned(F.col(c)).alias("text"))
    return rows.select("index", F.explode(F.array(one("text", False), one("refilled", True))).alias("x")).select("index", "x.*")


def originals_and_refilled(rows: DataFrame, blacklist: DataFrame | None = None) -> DataFrame:
    """Of (index, book_id, author_id, subject, text, refilled, mask_ratio, label)
    rows: an original where the book's cleaned text comes for the first time
    (ratio 0), and a refilled row for each ratio above 0."""
    if blacklist is not None:
        rows = rows.join(blacklist.select("label").distinct(), "label", "left_anti")
    rows = rows.withColumn("text", cleaned(F.col("text"))).withColumn("refilled", cleaned(F.col("refilled")))
    keep = ["index", "book_id", "author_id", "subject", "text", "mask_ratio", "is_refilled", "label"]
    first = Window.partitionBy("book_id", "text").orderBy("index")
    original = rows.where(F.length("text") > 0).withColumn("n", F.row_number().over(first)).where("n = 1")
    original = original.withColumn("mask_ratio", F.lit(0.0)).withColumn("is_refilled", F.lit(False)).select(keep)
    refilled = rows.where((F.col("mask_ratio") > 0) & (F.length("refilled") > 0)).withColumn("text", F.col("refilled")).withColumn("is_refilled", F.lit(True))
    refilled = refilled.withColumn("label", F.concat("label", F.lit("_"), F.col("mask_ratio").cast("string"))).select(keep)
    return original.unionByName(refilled)


def row_ids(df: DataFrame, *order: str) -> DataFrame:
    """``chunk_id`` from 0 in an order that is total and begins with a number.

    Rows are counted in ranges of the first column, so no task sees all."""
    return placed(df, "chunk_id", F.col(order[0]), *order[1:])


def with_book_metadata(rows: DataFrame, books: DataFrame, core: list[str]) -> DataFrame:
    """Chunks (book_id, ...) with ``author_id`` and ``subject`` of their book in
    cleaned metadata (book_id, author, subjects): the first subject of the core
    set.  Books without one have no place, and their chunks drop out."""
    first = F.get(F.filter("subjects", lambda s: s.isin(core)), F.lit(0))
    known = books.where("book_id is not null").select("book_id", F.coalesce("author", F.lit("Unknown")).alias("author_id"), first.alias("subject")).where("subject is not null").dropDuplicates(["book_id"])
    return rows.drop("author_id", "subject").join(known, "book_id")


def with_settings(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Chunks (author, ...) enriched from a configured dimension (author, title,
    genre, ...), which replaces columns of the same name.  A chunk's author counts
    as it is, or else without white space at its ends; others drop out."""
    wide = [c for c in settings.columns if c != "author"]
    known = settings.withColumnRenamed("author", "_author")
    names = known.select("_author")
    own = chunks.drop(*wide)
    exact = own.join(known, own["author"] == known["_author"])
    rest = own.join(names, own["author"] == names["_author"], "left_anti")
    stripped = rest.join(known, T.strip(rest["author"]) == known["_author"])
    return exact.unionByName(stripped).withColumn("author", F.col("_author")).drop("_author")


def with_titled_settings(chunks: DataFrame, settings: DataFrame) -> DataFrame:
    """Chunks (author, title, ...) with the other columns of the settings whose
    author and title are theirs, letter by letter; others drop out.  Chunks' columns of
    those names are replaced, and a setting that comes twice counts once."""
    more = [c for c in settings.columns if c not in ("author", "title")]
    return chunks.drop(*more).join(settings.dropDuplicates(["author", "title"]), ["author", "title"])


def last_by_text(rows: DataFrame, *keys: str, order: str = "index") -> DataFrame:
    """Of rows with equal keys the last one, at the place of the first
    (``order`` becomes the first one's)."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    own = rows.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*rest), order).alias("_row"))
    return own.select(*keys, order, "_row.*").select(*rows.columns)


def incomplete_labels(rows: DataFrame, ratios: list[float] = RATIOS) -> DataFrame:
    """Labels that lack one of the ratios."""
    seen = rows.where("mask_ratio > 0").groupBy("label").agg(F.collect_set(F.round("mask_ratio", 1)).alias("seen"))
    every = rows.select("label").distinct().join(seen, "label", "left")
    lacking = F.size(F.array_except(F.array(*map(F.lit, ratios)), F.coalesce("seen", F.array().cast("array<double>"))))
    return every.select("label", lacking.cast("long").alias("n_missing")).where("n_missing > 0")


def copy_rate(rows: DataFrame) -> DataFrame:
    """Percentage of refilled texts that equal their original; null without any."""
    same = (F.trim("text") == F.trim("refilled")).cast("int")
    return rows.where("mask_ratio > 0").agg(F.round(F.avg(same) * 100, 6).alias("copy_rate"))


def author_stats(rows: DataFrame) -> DataFrame:
    """Chunks and books of each author in a subject."""
    return rows.groupBy("subject", "author_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("book_id").alias("n_books"))


def profile(rows: DataFrame) -> DataFrame:
    """Rows and authors of each subject, and of all (subject null)."""
    return rows.groupingSets([["subject"], []], "subject").agg(F.count("*").alias("n_rows"), F.countDistinct("author_id").alias("n_authors"))
