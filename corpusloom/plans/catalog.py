"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ops
from ..registry import query
from .views import CATALOG_SQL, CORE, CORE_SQL, catalog, links, targets

SUBJECTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "STANDARD"]
_ELIGIBLE = f"""WITH {CATALOG_SQL},
text_ids AS (SELECT DISTINCT book_id FROM links WHERE regexp_matches(lower(kind), 'text|plain|txt|utf-8|ascii|html')),
target_ids AS (SELECT DISTINCT book_id FROM catalog JOIN targets USING (title, author)),
eligible AS (SELECT DISTINCT author, subject, book_id, downloads FROM catalog WHERE language = 'en' AND subject IN ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'STANDARD')
  AND book_id IN (SELECT book_id FROM text_ids) AND book_id NOT IN (SELECT book_id FROM target_ids)),
counted AS (SELECT author, subject, count(DISTINCT book_id) AS n_books FROM eligible GROUP BY ALL HAVING count(DISTINCT book_id) >= 2)
"""
_BOOKS = f"""WITH {CATALOG_SQL},
books AS (SELECT book_id, min(author) AS author, min(title) AS title, list_sort(list(DISTINCT subject)) AS subjects FROM
  (SELECT book_id, author, title, subject FROM catalog UNION ALL SELECT book_id, author, title, 'PROMO' FROM catalog WHERE downloads > 25) GROUP BY book_id)
"""


def _books(spark, sf):
    """Books with one or two subjects."""
    rows = catalog(spark, sf)
    return ops.books_with_subjects(rows.unionByName(rows.where("downloads > 25").withColumn("subject", F.lit("PROMO"))))


def _aliases(spark, sf):
    """Suppliers whose name ends alike are one author's names."""
    s = catalog(spark, sf).select("author").distinct()
    return s.where(F.col("author").endswith("7")).select(F.regexp_replace("author", "7$", "1").alias("author"), F.col("author").alias("alias"))


_ALIASES = "aliases AS (SELECT DISTINCT regexp_replace(author, '7$', '1') AS author, author AS alias FROM catalog WHERE author LIKE '%7')"


_SELECTED = _ELIGIBLE + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY author, subject ORDER BY downloads DESC, book_id) AS place FROM eligible SEMI JOIN counted USING (author, subject))
SELECT DISTINCT book_id, title, author, subject FROM catalog WHERE language = 'en' AND book_id IN (SELECT book_id FROM text_ids)
  AND (book_id IN (SELECT book_id FROM target_ids) OR book_id IN (SELECT book_id FROM ranked WHERE place <= 2))"""


@query(_SELECTED)
def catalog_top2_per_author_subject(spark, sf):
    return ops.select_books(catalog(spark, sf), targets(spark, sf), links(spark, sf), SUBJECTS)


@query(_SELECTED)
def catalog_selection_sql(spark, sf):
    """The same selection as one statement with parameters."""
    return ops.selected_by_sql(catalog(spark, sf), targets(spark, sf), links(spark, sf), SUBJECTS)


@query(_ELIGIBLE + "SELECT author, subject, n_books FROM counted")
def catalog_group_counts_having(spark, sf):
    return ops.group_counts(catalog(spark, sf), targets(spark, sf), links(spark, sf), SUBJECTS)


@query(_ELIGIBLE + "SELECT book_id FROM text_ids")
def catalog_text_available_semi(spark, sf):
    return ops.text_books(links(spark, sf))


@query(_ELIGIBLE + "SELECT DISTINCT book_id FROM catalog WHERE book_id NOT IN (SELECT book_id FROM target_ids)")
def catalog_not_in_targets(spark, sf):
    own = catalog(spark, sf)
    return own.join(ops.target_books(own, targets(spark, sf)), "book_id", "left_anti").select("book_id").distinct()


@query(_ELIGIBLE + "SELECT DISTINCT book_id, title FROM catalog WHERE book_id IN (SELECT book_id FROM target_ids) OR book_id IN (SELECT book_id FROM text_ids)")
def catalog_or_membership(spark, sf):
    own = catalog(spark, sf)
    either = ops.target_books(own, targets(spark, sf)).unionByName(ops.text_books(links(spark, sf))).distinct()
    return own.join(either, "book_id", "left_semi").select("book_id", "title").distinct()


@query(_BOOKS + "SELECT book_id, author, title, array_to_string(subjects, '|') AS subjects FROM books")
def catalog_subject_arrays(spark, sf):
    return _books(spark, sf).withColumn("subjects", F.array_join("subjects", "|"))


@query(_BOOKS + f", {_ALIASES} SELECT DISTINCT book_id, coalesce(a.author, c.author) AS author FROM catalog c LEFT JOIN aliases a ON a.alias = c.author")
def catalog_alias_canonical(spark, sf):
    return ops.canonical_author(catalog(spark, sf).select("book_id", "author"), _aliases(spark, sf)).distinct()


@query(_BOOKS + f", {_ALIASES} SELECT title, author FROM targets UNION SELECT t.title, a.alias FROM targets t JOIN aliases a USING (author)")
def catalog_alias_targets(spark, sf):
    return ops.with_alias_targets(targets(spark, sf), _aliases(spark, sf))


_META = """, meta AS (SELECT p_partkey AS book_id, CASE WHEN p_size > 45 THEN 'other ' || p_name ELSE upper(p_name) END AS title,
  CASE WHEN p_size < 20 THEN 'Nobody' ELSE coalesce((SELECT author FROM books b WHERE b.book_id = p_partkey), 'Nobody') END AS author, p_size <> 5 AS has_file FROM part)"""


def _metadata(spark, sf):
    from .views import table

    part = table(spark, sf, "part")
    own = _books(spark, sf).select("book_id", F.col("author").alias("real"))
    return part.join(own, part.p_partkey == own.book_id, "left").select(
        F.col("p_partkey").alias("book_id"), F.when(F.col("p_size") > 45, F.concat(F.lit("other "), "p_name")).otherwise(F.upper("p_name")).alias("title"),
        F.when(F.col("p_size") < 20, "Nobody").otherwise(F.coalesce("real", F.lit("Nobody"))).alias("author"), (F.col("p_size") != 5).alias("has_file"),
    )


_STATUS = f""", {_ALIASES}, known AS (SELECT author, min(canonical) AS canonical FROM (SELECT alias AS author, author AS canonical FROM aliases UNION ALL SELECT author, author FROM aliases) GROUP BY author),
checked AS (SELECT m.book_id, CASE WHEN NOT has_file THEN 'missing_file' WHEN b.title IS NULL THEN 'not_in_catalog' WHEN lower(m.title) <> lower(b.title) THEN 'title_mismatch'
  WHEN NOT (m.author = b.author OR coalesce(k.canonical = r.canonical, false)) THEN 'author_mismatch' ELSE 'ok' END AS status
  FROM meta m LEFT JOIN books b USING (book_id) LEFT JOIN known k ON k.author = m.author LEFT JOIN known r ON r.author = b.author)"""


@query(_BOOKS + _META + _STATUS + " SELECT book_id, status FROM checked")
def catalog_validate_status(spark, sf):
    return ops.validate(_metadata(spark, sf), catalog(spark, sf), _aliases(spark, sf))


@query(_BOOKS + _META + _STATUS + " SELECT status, count(*) AS n FROM checked GROUP BY status")
def catalog_issue_counts(spark, sf):
    return ops.issue_counts(catalog_validate_status(spark, sf))


_CLEANED = f""", wanted AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY book_id DESC) AS place FROM books WHERE title IN (SELECT title FROM targets)) WHERE place = 1),
others AS (SELECT book_id, author, title, unnest(list_filter(subjects, lambda x: x IN {CORE_SQL})) AS subject FROM books WHERE title NOT IN (SELECT title FROM targets)),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, author ORDER BY book_id) AS place, count(*) OVER (PARTITION BY subject, author) AS n FROM others) WHERE n >= 2 AND place <= 2),
one AS (SELECT book_id, author, title, min(subject) AS subject FROM first GROUP BY ALL),
pairs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY subject, author) AS n FROM one) WHERE n = 2),
cleaned AS (SELECT book_id, author, title, CASE WHEN len(list_filter(subjects, lambda x: x IN {CORE_SQL})) > 0 THEN list_filter(subjects, lambda x: x IN {CORE_SQL}) ELSE subjects END AS subjects, true AS is_target FROM wanted
  UNION ALL SELECT book_id, author, title, [subject], false FROM pairs)"""


@query(_BOOKS + _CLEANED + " SELECT book_id, author, title, array_to_string(subjects, '|') AS subjects, is_target FROM cleaned")
def cleanup_pairs(spark, sf):
    return ops.clean_up(_books(spark, sf), targets(spark, sf), CORE).withColumn("subjects", F.array_join("subjects", "|"))


@query(_BOOKS + _CLEANED + " SELECT book_id FROM books WHERE book_id NOT IN (SELECT book_id FROM cleaned)")
def cleanup_to_delete(spark, sf):
    books = _books(spark, sf)
    return ops.to_delete(books, ops.clean_up(books, targets(spark, sf), CORE)).select("book_id")


@query(_BOOKS + f""", n AS (SELECT subject, author, count(*) AS n FROM (SELECT author, unnest(subjects) AS subject FROM books) WHERE subject IN {CORE_SQL} GROUP BY ALL)
SELECT c.subject, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_books, count(author) AS total_authors, count(*) FILTER (n = 2) AS valid_authors FROM (SELECT unnest(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO']) AS subject) c LEFT JOIN n USING (subject) GROUP BY c.subject""")
def cleanup_subject_stats(spark, sf):
    return ops.subject_stats(_books(spark, sf), CORE)


@query(_BOOKS + "SELECT author, count(DISTINCT subject) AS n_subjects FROM (SELECT author, unnest(subjects) AS subject FROM books) GROUP BY author HAVING count(DISTINCT subject) > 1")
def multi_subject_authors(spark, sf):
    return ops.multi_subject_authors(_books(spark, sf))


@query(_BOOKS + "SELECT DISTINCT title FROM (SELECT title FROM targets UNION ALL SELECT title || ' lost' FROM targets WHERE length(title) % 2 = 0) WHERE title NOT IN (SELECT title FROM books)")
def missing_targets(spark, sf):
    wanted = targets(spark, sf)
    lost = wanted.where("length(title) % 2 = 0").withColumn("title", F.concat("title", F.lit(" lost")))
    return ops.missing_targets(wanted.unionByName(lost), _books(spark, sf))


@query(_BOOKS + f""", {_ALIASES}, names AS (SELECT title, author FROM targets UNION SELECT t.title, a.alias FROM targets t JOIN aliases a USING (author))
SELECT title, author, array_to_string(list_sort(list(DISTINCT subject)), '|') AS subjects FROM catalog JOIN names USING (title, author) GROUP BY title, author""")
def target_subjects(spark, sf):
    return ops.target_subjects(catalog(spark, sf), targets(spark, sf), _aliases(spark, sf)).withColumn("subjects", F.array_join("subjects", "|"))


@query(_BOOKS + f", {_ALIASES}, names AS (SELECT title, author FROM targets UNION SELECT t.title, a.alias FROM targets t JOIN aliases a USING (author)) SELECT DISTINCT subject FROM catalog JOIN names USING (title, author)")
def target_unique_subjects(spark, sf):
    return ops.unique_subjects(ops.target_subjects(catalog(spark, sf), targets(spark, sf), _aliases(spark, sf)))


_ANY = """any_ AS (SELECT b.book_id, b.title, b.author, coalesce(s.subjects, []) AS subjects FROM (SELECT book_id, min(title) AS title, min(author) AS author FROM catalog GROUP BY book_id) b
  LEFT JOIN (SELECT book_id, list_sort(list(DISTINCT subject)) AS subjects FROM catalog WHERE downloads % 3 <> 0 GROUP BY book_id) s USING (book_id))"""


def _subjects(spark, sf):
    """Subjects of books; a third of the books have none."""
    return catalog(spark, sf).where("downloads % 3 <> 0").select("book_id", "subject")


@query(_BOOKS + f", {_ANY} SELECT book_id, title, author, array_to_string(subjects, '|') AS subjects, len(subjects) AS n_subjects FROM any_")
def catalog_left_outer_subjects(spark, sf):
    one = catalog(spark, sf).groupBy("book_id").agg(F.min("title").alias("title"), F.min("author").alias("author"))
    own = ops.books_with_any_subjects(one, _subjects(spark, sf))
    return own.select("book_id", "title", "author", F.array_join("subjects", "|").alias("subjects"), F.size("subjects").cast("long").alias("n_subjects"))


@query(_BOOKS + _META + _STATUS + f""", {_ANY} SELECT m.book_id, CASE WHEN c.status = 'ok' THEN m.title ELSE r.title END AS title, CASE WHEN c.status = 'ok' THEN m.author ELSE r.author END AS author,
  CASE WHEN c.status = 'ok' AND m.book_id % 2 = 0 THEN 'kept' ELSE array_to_string(r.subjects, '|') END AS subjects, c.status <> 'ok' AS was_corrected
  FROM meta m JOIN checked c USING (book_id) JOIN any_ r USING (book_id) WHERE c.status IN ('ok', 'title_mismatch', 'author_mismatch')""")
def catalog_corrected_metadata(spark, sf):
    kept = F.when(F.col("book_id") % 2 == 0, F.array(F.lit("kept")))
    own = ops.corrected(_metadata(spark, sf).withColumn("subjects", kept), catalog(spark, sf), _aliases(spark, sf), _subjects(spark, sf))
    return own.withColumn("subjects", F.array_join("subjects", "|"))


@query(_BOOKS + "SELECT title IN (SELECT title FROM targets) AS is_target, author, count(*) AS n_books, array_to_string(list_sort(list(title)), '|') AS titles FROM books GROUP BY ALL")
def catalog_full_review(spark, sf):
    return ops.full_review(_books(spark, sf), targets(spark, sf)).withColumn("titles", F.array_join("titles", "|"))


@query(_BOOKS + "SELECT count(*) AS n_books, count(*) FILTER (title IN (SELECT title FROM targets)) AS n_targets, count(*) FILTER (title NOT IN (SELECT title FROM targets)) AS n_others FROM books")
def catalog_review_counts(spark, sf):
    return ops.review_counts(_books(spark, sf), targets(spark, sf))


@query(_BOOKS + "SELECT book_id, author, title, subject FROM catalog WHERE language = 'en' ORDER BY author, title, subject, book_id")
def catalog_report_order(spark, sf):
    """Rows come in the report's order."""
    return ops.in_report_order(catalog(spark, sf).where("language = 'en'").select("book_id", "author", "title", "subject"))


@query(_BOOKS + "SELECT title, max(book_id) AS book_id FROM books GROUP BY title")
def dedup_latest_title(spark, sf):
    return ops.latest_by_title(_books(spark, sf)).select("title", "book_id")


@query(_BOOKS + "SELECT author, count(*) AS n_books, array_to_string(list_sort(list(title)), '|') AS titles FROM books WHERE title NOT IN (SELECT title FROM targets) GROUP BY author")
def catalog_review(spark, sf):
    return ops.review(_books(spark, sf), targets(spark, sf)).withColumn("titles", F.array_join("titles", "|"))
