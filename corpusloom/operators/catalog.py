"""Selection from a relational catalogue, its validation and its clean-up.

A catalogue has (book_id, title, author, subject, downloads, language), one row
for each author and subject of a book.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_alias_targets(targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """Targets (title, author) and their authors' other names (author, alias)."""
    return targets.select("title", "author").unionByName(targets.join(aliases, "author").select("title", F.col("alias").alias("author"))).distinct()


def canonical_author(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``author`` replaced by the name it is an alias of."""
    names = aliases.groupBy("alias").agg(F.min("author").alias("canonical"))
    return df.join(names, df["author"] == names["alias"], "left").withColumn("author", F.coalesce("canonical", "author")).drop("alias", "canonical")


def text_books(links: DataFrame) -> DataFrame:
    """Ids of books with a text-like form, whatever the letters' case."""
    return links.where(F.lower("kind").rlike("text|plain|txt|utf-8|ascii|html")).select("book_id").distinct()


def target_books(catalog: DataFrame, targets: DataFrame) -> DataFrame:
    """Ids of the wanted books."""
    return catalog.join(targets, ["title", "author"], "left_semi").select("book_id").distinct()


def _eligible(catalog: DataFrame, targets: DataFrame, links: DataFrame, subjects: list[str]) -> DataFrame:
    """English books of the subjects, with text, that are no targets."""
    own = catalog.where((F.col("language") == "en") & F.col("book_id").isNotNull() & F.col("subject").isin(subjects))
    return own.join(text_books(links), "book_id", "left_semi").join(target_books(catalog, targets), "book_id", "left_anti")


def group_counts(catalog: DataFrame, targets: DataFrame, links: DataFrame, subjects: list[str], least: int = 2) -> DataFrame:
    """(author, subject, n_books) of the groups with enough eligible books."""
    return _eligible(catalog, targets, links, subjects).groupBy("author", "subject").agg(F.countDistinct("book_id").alias("n_books")).where(F.col("n_books") >= least)


def select_books(catalog: DataFrame, targets: DataFrame, links: DataFrame, subjects: list[str], top: int = 2) -> DataFrame:
    """The wanted books, and of each (author, subject) with so many eligible
    books the most downloaded ones (ties: least id), with every subject.

    The catalogue is read once: rows carry whether their book is wanted, then
    their place in their group, then whether their book was chosen.  A book's
    language and downloads are the same in all its rows."""
    own = catalog.where("language = 'en' and book_id is not null").select("book_id", "title", "author", "subject", "downloads").distinct()
    own = own.join(text_books(links), "book_id", "left_semi")
    wanted = targets.select("title", "author", F.lit(True).alias("wanted")).distinct()
    book, group = Window.partitionBy("book_id"), Window.partitionBy("author", "subject", "eligible")
    own = own.join(wanted, ["title", "author"], "left").withColumn("wanted", F.coalesce(F.max("wanted").over(book), F.lit(False)))
    own = own.withColumn("eligible", ~F.col("wanted") & F.coalesce(F.col("subject").isin(subjects), F.lit(False)))
    # a book has one row for an author and subject, whatever its titles
    own = own.withColumn("place", F.dense_rank().over(group.orderBy(F.desc("downloads"), "book_id"))).withColumn("n", F.max("place").over(group))
    chosen = F.col("wanted") | (F.col("eligible") & (F.col("n") >= top) & (F.col("place") <= top))
    return own.withColumn("chosen", F.max(chosen).over(book)).where("chosen").select("book_id", "title", "author", "subject").distinct()


#: The same selection as one statement, over tables that are filled in, with named
#: parameters.
SELECTION = """
WITH own AS (SELECT DISTINCT book_id, title, author, subject, downloads FROM {books} LEFT SEMI JOIN {texts} USING (book_id) WHERE language = :language),
wanted AS (SELECT DISTINCT book_id FROM own LEFT SEMI JOIN {targets} USING (title, author)),
ranked AS (SELECT book_id, author, subject, dense_rank() OVER (PARTITION BY author, subject ORDER BY downloads DESC, book_id) AS place
  FROM own LEFT ANTI JOIN wanted USING (book_id) WHERE array_contains(:subjects, subject)),
chosen AS (SELECT book_id FROM (SELECT *, max(place) OVER (PARTITION BY author, subject) AS n FROM ranked) WHERE n >= :top AND place <= :top UNION SELECT book_id FROM wanted)
SELECT DISTINCT book_id, title, author, subject FROM own LEFT SEMI JOIN chosen USING (book_id)
"""


def selected_by_sql(catalog: DataFrame, targets: DataFrame, links: DataFrame, subjects: list[str], top: int = 2, language: str = "en") -> DataFrame:
    """:func:`select_books` as a parameterised statement."""
    args = {"language": language, "subjects": F.array(*map(F.lit, subjects)), "top": top}
    return catalog.sparkSession.sql(SELECTION, args, books=catalog, texts=text_books(links), targets=targets)


def in_report_order(books: DataFrame) -> DataFrame:
    """Books by author, then title (ties: subject, id)."""
    return books.orderBy("author", "title", "subject", "book_id")


def books_with_any_subjects(books: DataFrame, subjects: DataFrame) -> DataFrame:
    """(book_id, title, author, subjects): subjects sorted and each once; a book
    without one stays, with none."""
    of = subjects.where("subject is not null").groupBy("book_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    return books.select("book_id", "title", "author").distinct().join(of, "book_id", "left").withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>")))


def target_subjects(catalog: DataFrame, targets: DataFrame, aliases: DataFrame) -> DataFrame:
    """(title, author, subjects) of the wanted books under any of their authors'
    names, one row for each name: their subjects, sorted."""
    own = catalog.join(with_alias_targets(targets, aliases), ["title", "author"], "left_semi")
    return own.where("subject is not null").groupBy("title", "author").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def unique_subjects(by_book: DataFrame) -> DataFrame:
    """Every subject of :func:`target_subjects`, once."""
    return by_book.select(F.explode("subjects").alias("subject")).distinct()


def books_with_subjects(catalog: DataFrame) -> DataFrame:
    """One row for each book: its least author and title, its subjects sorted
    and each once."""
    return catalog.groupBy("book_id").agg(F.min("author").alias("author"), F.min("title").alias("title"), F.array_sort(F.collect_set("subject")).alias("subjects"))


def _checked(metadata: DataFrame, catalog: DataFrame, aliases: DataFrame, strict_author: bool) -> DataFrame:
    known = aliases.select(F.col("alias").alias("author"), F.col("author").alias("canonical")).unionByName(aliases.select("author", F.col("author").alias("canonical"))).groupBy("author").agg(F.min("canonical").alias("canonical"))
    there = catalog.groupBy("book_id").agg(F.min("title").alias("real_title"), F.min("author").alias("real_author"))
    both = metadata.join(there, "book_id", "left").join(known, "author", "left").join(known.select(F.col("author").alias("real_author"), F.col("canonical").alias("real_canonical")), "real_author", "left")
    same_author = (F.col("author") == F.col("real_author")) | F.coalesce(F.col("canonical") == F.col("real_canonical"), F.lit(False))
    if not strict_author:
        same_author |= F.col("canonical").isNull() & F.col("real_canonical").isNull()
    status = (
        F.when(~F.col("has_file"), "missing_file")
        .when(F.col("real_title").isNull(), "not_in_catalog")
        .when(F.lower("title") != F.lower("real_title"), "title_mismatch")
        .when(~same_author, "author_mismatch")
        .otherwise("ok")
    )
    return both.select(*metadata.columns, status.alias("status"))


def validate(metadata: DataFrame, catalog: DataFrame, aliases: DataFrame, strict_author: bool = True) -> DataFrame:
    """Metadata (book_id, title, author, has_file) with a ``status`` against the
    catalogue.  Titles match whatever their case; authors match if they, or the
    authors they are aliases of, are the same.  Not strictly, authors that no
    alias is known for always match."""
    return _checked(metadata, catalog, aliases, strict_author).select("book_id", "status")


def issue_counts(validated: DataFrame) -> DataFrame:
    """Books by status."""
    return validated.groupBy("status").agg(F.count("*").alias("n"))


def missing_targets(targets: DataFrame, books: DataFrame) -> DataFrame:
    """Wanted titles that no book has."""
    return targets.select("title").distinct().join(books.select("title"), "title", "left_anti")


def latest_by_title(books: DataFrame) -> DataFrame:
    """Of each title the book of the highest id."""
    return books.withColumn("place", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("book_id")))).where("place = 1").drop("place")


def core_subjects(subjects: Column, core: list[str]) -> Column:
    """The subjects that are in the core set, in order."""
    return F.filter(subjects, lambda s: s.isin(core))


def clean_up(books: DataFrame, targets: DataFrame, core: list[str], per_group: int = 2) -> DataFrame:
    """Targets once by title; others in pairs by (subject, author).

    Others are put under each of their core subjects; of groups with two books
    or more the two of least id stay; a book stays under its first subject; a
    group is kept if it still has exactly two.  (book_id, author, title,
    subjects, is_target); the rest is to be deleted."""
    titles = targets.select("title").distinct()
    wanted = latest_by_title(books.join(titles, "title", "left_semi"))
    wanted = wanted.withColumn("subjects", F.when(F.size(core_subjects(F.col("subjects"), core)) > 0, core_subjects(F.col("subjects"), core)).otherwise(F.col("subjects")))
    others = books.join(titles, "title", "left_anti").select("*", F.explode(F.array_distinct(core_subjects(F.col("subjects"), core))).alias("subject"))
    group = Window.partitionBy("subject", "author")
    first = others.select("*", F.row_number().over(group.orderBy("book_id")).alias("place"), F.count("*").over(group).alias("n")).where((F.col("n") >= per_group) & (F.col("place") <= per_group))
    one = first.groupBy("book_id", "author", "title").agg(F.min("subject").alias("subject"))
    pairs = one.withColumn("n", F.count("*").over(group)).where(F.col("n") == per_group).select("book_id", "author", "title", F.array("subject").alias("subjects"))
    return wanted.select("book_id", "author", "title", "subjects", F.lit(True).alias("is_target")).unionByName(pairs.withColumn("is_target", F.lit(False)))


def to_delete(books: DataFrame, kept: DataFrame) -> DataFrame:
    """Books that a clean-up rejects; nothing is deleted here."""
    return books.join(kept, "book_id", "left_anti")


def subject_stats(books: DataFrame, core: list[str], per_group: int = 2) -> DataFrame:
    """For each core subject its books, its authors, and the authors with
    exactly so many books; subjects without books have zeros."""
    own = books.select("book_id", "author", F.explode("subjects").alias("subject")).where(F.col("subject").isin(core))
    counts = own.groupBy("subject", "author").agg(F.count("*").alias("n")).groupBy("subject").agg(F.sum("n").alias("total_books"), F.count("*").alias("total_authors"), F.count_if(F.col("n") == per_group).alias("valid_authors"))
    every = books.sparkSession.createDataFrame([(s,) for s in core], "subject string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(counts, "subject", "left").select("subject", zero("total_books"), zero("total_authors"), zero("valid_authors"))


def multi_subject_authors(books: DataFrame) -> DataFrame:
    """Authors with books in several subjects."""
    return books.select("author", F.explode("subjects").alias("subject")).groupBy("author").agg(F.countDistinct("subject").alias("n_subjects")).where("n_subjects > 1")


def review(books: DataFrame, targets: DataFrame) -> DataFrame:
    """(author, n_books, titles) of the books that are no targets."""
    return books.join(targets.select("title").distinct(), "title", "left_anti").groupBy("author").agg(F.count("*").alias("n_books"), F.array_sort(F.collect_list("title")).alias("titles"))


def full_review(books: DataFrame, targets: DataFrame) -> DataFrame:
    """(is_target, author, n_books, titles): the wanted books by title and the
    others, each by author."""
    titles = targets.select("title", F.lit(True).alias("is_target")).distinct()
    own = books.join(titles, "title", "left").withColumn("is_target", F.coalesce("is_target", F.lit(False)))
    return own.groupBy("is_target", "author").agg(F.count("*").alias("n_books"), F.array_sort(F.collect_list("title")).alias("titles"))


def review_counts(books: DataFrame, targets: DataFrame) -> DataFrame:
    """One row: books, wanted books, others."""
    titles = targets.select("title", F.lit(True).alias("is_target")).distinct()
    own = books.join(titles, "title", "left")
    return own.agg(F.count("*").alias("n_books"), F.count_if("is_target").alias("n_targets"), F.count_if(F.col("is_target").isNull()).alias("n_others"))


def corrected(metadata: DataFrame, catalog: DataFrame, aliases: DataFrame, subjects: DataFrame, strict_author: bool = True) -> DataFrame:
    """Metadata (book_id, title, author, subjects, has_file) after validation:
    books without a file or a catalogue entry drop out, on a mismatch title, author
    and subjects are the catalogue's, and a book without subjects gets these."""
    real = books_with_any_subjects(catalog.groupBy("book_id").agg(F.min("title").alias("title"), F.min("author").alias("author")), subjects)
    real = real.select("book_id", *(F.col(c).alias(f"real_{c}") for c in ("title", "author", "subjects")))
    both = _checked(metadata, catalog, aliases, strict_author).join(real, "book_id").where(F.col("status").isin("ok", "title_mismatch", "author_mismatch"))
    wrong = F.col("status") != "ok"
    own = lambda c: F.when(wrong, F.col(f"real_{c}")).otherwise(F.col(c)).alias(c)
    none = F.coalesce(F.size("subjects"), F.lit(0)) <= 0
    return both.select("book_id", own("title"), own("author"), F.when(wrong | none, F.col("real_subjects")).otherwise(F.col("subjects")).alias("subjects"), wrong.alias("was_corrected"))
