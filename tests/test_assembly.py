"""Places in an order, metadata joins, encoders and retries on hand-made rows."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import scores
from corpusloom.operators import chunks, embeddings, ordered, pairs, prompts, reports
from corpusloom.streaming import quota


def test_places_and_running_sums(spark):
    rows = [(i * 37 % 101 % 20, i, i % 5) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, id long, n long").repartition(7)
    got = ordered.placed(df, "place", F.col("k"), "id").collect()
    assert [(r.k, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((k, i) for k, i, _ in rows)
    assert sorted(r.place for r in got) == list(range(400))
    sums, total = {}, 0
    for k, i, n in sorted(rows):
        total += n
        sums[i] = total
    assert {r.id: r.s for r in ordered.running(df, F.col("n"), "s", F.col("k"), "id").collect()} == sums
    assert ordered.placed(df.limit(0), "place", F.col("k"), "id").count() == 0
    words = spark.createDataFrame([(str(i),) for i in range(300)], "w string").withColumn("o", F.md5("w"))
    by = ordered.placed(words, "place", ordered.hex_key(F.col("o")), "o").collect()
    assert [r.o for r in sorted(by, key=lambda r: r.place)] == sorted(r.o for r in by)


def test_ranks_of_many_ties(spark):
    df = spark.createDataFrame([(float(i % 3), float(-(i % 3))) for i in range(60)], "a double, b double")
    assert reports.spearman(df, "a", "b").first().spearman == pytest.approx(-1)


def test_books_without_a_core_subject_lose_their_chunks(spark):
    rows = spark.createDataFrame([("b1", 1, "old"), ("b2", 2, "old"), ("b3", 3, "old"), (None, 4, "old"), ("b5", 5, "old")], "book_id string, id long, subject string")
    books = spark.createDataFrame([("b1", "A", ["x", "History", "Fiction"]), ("b2", None, ["Fiction"]), ("b3", "C", ["x"]), ("b5", "D", None), (None, "E", ["Fiction"])], "book_id string, author string, subjects array<string>")
    got = chunks.with_book_metadata(rows, books, ["Fiction", "History"]).collect()
    assert {(r.id, r.author_id, r.subject) for r in got} == {(1, "A", "History"), (2, "Unknown", "Fiction")}


def test_settings_match_as_they_are_or_stripped(spark):
    rows = spark.createDataFrame([(1, "Ann"), (2, " Ann\n"), (3, " Bo"), (4, "Bo"), (5, None), (6, "Cy")], "id long, author string")
    settings = spark.createDataFrame([("Ann", "T"), (" Bo", "U")], "author string, title string")
    assert {(r.id, r.author, r.title) for r in chunks.with_settings(rows, settings).collect()} == {(1, "Ann", "T"), (2, "Ann", "T"), (3, " Bo", "U")}


def test_last_value_at_the_first_place(spark):
    rows = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y"), ("a", 2, "z"), ("a", 3, None)], "k string, index long, v string")
    assert {tuple(r) for r in chunks.last_by_text(rows, "k").collect()} == {("a", 0, None), ("b", 1, "y")}


def test_encoders_see_each_text_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None), (4, ""), (5, "a b b")], "id long, text string")
    vectors = embeddings.encoded(docs, embeddings.hashed_words, batch=2)
    assert vectors.count() == 3
    by = {r.id: np.array(r.embedding) for r in embeddings.with_embeddings(docs, vectors).collect()}
    assert len(by) == 5 and (by[1] == by[2]).all() and not by[3].any() and np.linalg.norm(by[5]) == pytest.approx(1)
    pair = docs.withColumn("reference", F.lit("a b"))
    got = {r.id: r.score for r in embeddings.scored(pair, embeddings.hashed_words).collect()}
    assert got[1] == pytest.approx(1) and got[3] is None and got[5] == pytest.approx(3 / 10**0.5)
    assert embeddings.encoded(docs.limit(0), embeddings.hashed_words).count() == 0


@pytest.mark.parametrize(("reply", "want"), [("7", 0.7), (" 0\n", 0.0), ("10", None), ("", None), ("x", None), ("٣", None), (None, None)])
def test_digits(spark, reply, want):
    got = spark.createDataFrame([(reply,)], "r string").select(scores.digit(F.col("r")).alias("x")).first().x
    assert got == (pytest.approx(want) if want is not None else None)


def test_retries_end(spark):
    tasks = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    ask = lambda t, n: t.withColumn("reply", F.when(F.col("id") == n, "5").otherwise("no"))
    got = prompts.until_valid(tasks, ask, scores.digit(F.col("reply")).isNotNull(), 3)
    assert {tuple(r) for r in got.collect()} == {(1, "5", 1), (2, "5", 2), (3, None, None)}


def test_round_robin_of_one_chunk(spark):
    own = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "author string, c long")
    turns = spark.createDataFrame([(x, t) for x in "abz" for t in range(5)], "author string, turn long")
    got = prompts.round_robin(own, turns, "c").collect()
    assert Counter(r.author for r in got) == {"a": 5, "b": 5}
    assert all((r.c == r.reference) == (r.author == "a") for r in got)
    assert [r.c for r in sorted((r for r in got if r.author == "b"), key=lambda r: r.turn)] == [1, 2, 1, 2, 1]


def test_means_and_quotas_of_nothing(spark):
    none = spark.createDataFrame([], "subject string, available long")
    assert pairs.water_fill(none, 10).count() == 0
    assert tuple(reports.dataset_means(spark.createDataFrame([], "score double, n_words long")).first()) == (0, 0.0, 0.0)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "author string, arrival long, text string, score double"
    rows = lambda ids: spark.createDataFrame([("a", i, "x THE END.", 0.9) for i in ids] + [("b", i, "x", 0.9) for i in ids], schema)
    for n, ids in enumerate(([5, 3], [9, 1, 7], [0])):
        rows(ids).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        quota.gate(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", 4, 0.5).awaitTermination()
        got = sorted(r.arrival for r in quota.accepted(spark, f"{tmp_path}/out", schema).collect())
        assert got == ([3, 5], [1, 3, 5, 7], [1, 3, 5, 7])[n]
