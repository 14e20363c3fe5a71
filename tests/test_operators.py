"""Operators on hand-made rows, and invariants of the sequential builders."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import scores, text
from corpusloom.operators import catalog, chunks, pairs, prompts, reports, splits
from corpusloom.sources import io

from .conftest import SF


def value(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def clean(spark, s, **options):
    return text.clean_books(spark.createDataFrame([(1, s)], "doc_id long, text string"), **options).first().text


def plain(pattern):
    """A pattern as Python's engine reads it."""
    flags = re.match(r"\(\?([A-Za-z]+)\)", pattern)
    letters = flags[1] if flags else ""
    return re.compile(pattern[flags.end() if flags else 0 :].replace(r"\z", r"\Z"), sum(getattr(re, x.upper()) for x in letters if x in "ims"))


def plain_clean(t):
    """The rules in order, line by line where they go by lines."""
    t = text.FOOTNOTE.sub("", t.replace("\u00a0", " ").replace("\u200b", " "))
    for p in (text.SIDENOTE, text.MARKER, text.CITATION, text.TRANSLATOR, text.SEPARATOR):
        t = plain(p).sub("", t)
    for a, b in zip("“”‘’", "\"\"''", strict=True):
        t = t.replace(a, b)
    t = plain(text.EMPHASIS).sub(r"\1", t.replace("--", "—"))
    t = plain(text.STAR_LINE).sub("", re.sub("[❦†‡※]", "", t))
    for p in (text.ILLUSTRATION, text.ILLUSTRATION_BLOCK, text.ILLUSTRATION_BRACES, text.ILLUSTRATION_LINE, text.CHAPTER, text.CHAPTER_LINE, text.PAGE, text.URL):
        t = plain(p).sub("", t)
    kept, skip = [], False
    for line in t.split("\n"):
        bare = line.strip()
        if re.match(r"(?i)(Contents|VOLUME|CHAPTER|List of Illustrations)", bare):
            skip = True
        elif skip and bare and not re.match(r"\d+\.?\s", bare):
            skip = False
        if not skip:
            kept.append(line)
    t = re.sub(r"[ \t]+", " ", re.sub(r"\n\s*\n+", "\n\n", "\n".join(kept)))
    return t.strip("_").strip()


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("a b​c", "a b c"),
        ("x [Side-note: gone] y", "x y"),
        ("a[1] b{26} c( 3 )", "a b c"),
        ("before {Name (poet), {nested} more} after", "before after"),
        ("one\n-----\n* note -----\ntwo", "one\ntwo"),
        ("one\n*   *\ntwo\n#####\nthree", "one\ntwo\nthree"),
        ("“q” ‘s’ -- t", "\"q\" 's' — t"),
        ("_é_ *bold*", "é bold"),
        ("a❦†b\n***\nc", "ab\n\nc"),
        ("a [Illustration: x] b\nillustration: gone\n\nc", "a b\n\n\nc".replace("\n\n\n", "\n\n")),
        ("a\nChapter IV. Title\nprose with chapter inside\nb", "a\n\nb"),
        ("a\n 12 \nb [pg 3]\nsee http://x.y/z ok", "a\n\nb [pg 3]\nsee ok"),
        ("Contents\n1. One\n\nBody\nVOLUME II\n2. skipped\nText", "Body\nText"),
        ("a\n\n\n\nb  \t c_", "a\n\nb c"),
        ("", ""),
    ],
)
def test_cleaning_rules(spark, raw, want):
    got = clean(spark, raw)
    assert got == plain_clean(raw)
    assert re.sub(r"\n+", "\n", got) == re.sub(r"\n+", "\n", want)


def test_blank_lines_become_one(spark):
    assert clean(spark, "a\n\n \n\n\nb\nc") == "a\n\nb\nc"


def test_cleaning_against_pythons_engine(spark):
    from corpusloom.plans.cleaning import AFTER, BEFORE, TOC

    docs = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]
    raws = [BEFORE + TOC + t + AFTER for t in docs] + [TOC, "Contents", "1. x\nContents\n2.\n3.  \n 4. y\nText\n5 z", "\nVolume\n\n"]
    df = spark.createDataFrame([(t,) for t in raws], "text string")
    assert sorted(r.text for r in text.clean_books(df).collect()) == sorted(map(plain_clean, raws))


def test_cleaning_needs_no_key(spark):
    """Rows that share a key, or have none, keep their own lines."""
    rows = [(None, "one\ntwo"), (1, "a\nb"), (1, "c\nd"), (None, None)]
    got = text.clean_books(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.text for r in got) == Counter(["one\ntwo", "a\nb", "c\nd", ""])


def test_contents_of_a_very_long_text(spark):
    raw = "Contents\n" + "1. x\n" * 200_000 + "Body\n" + "line\n" * 200_000
    got = spark.createDataFrame([(raw,)], "text string").select(text.without_contents(F.col("text")).alias("t")).first().t
    assert got == "Body\n" + "line\n" * 200_000


def test_footnotes_and_options(spark):
    assert clean(spark, "Lead.\n[1] a long note of words\nmore\n[2] x") == "Lead.\n\n x"
    assert clean(spark, "Lead.\n[1] a long note of words to the end\n") == "Lead."
    assert clean(spark, "Lead.\n[1] two words.\nBody") == "Lead.\n two words.\nBody"
    assert clean(spark, "“q”", quotes=False) == "“q”"
    long = "{" + "a " * 30_000 + "}" + "word " * 20_000
    assert len(clean(spark, long)) > 90_000


@pytest.mark.parametrize(("raw", "want"), [("A Tale, Chapters 36 to the Last", "A Tale"), ("A, Chapter 1", "A"), ("A, Part 5.", "A"), ("A\n  b", "A b"), ("", "unknown_title")])
def test_titles(spark, raw, want):
    assert value(spark, text.clean_title(F.lit(raw), "unknown_title")) == want


def plain_pack(counts, limit):
    out, cur = [], []
    for n in counts:
        if cur and sum(cur) + n > limit:
            out.append(cur)
            cur = []
        cur.append(n)
    return out + [cur] if cur else out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.integers(1, 12), max_size=12), min_size=1, max_size=5))
def test_packing(spark, many):
    rows = [(i, [" ".join(["w"] * n) + "." for n in ns], ns) for i, ns in enumerate(many)]
    got = chunks.pack(spark.createDataFrame(rows, "doc_id long, sentences array<string>, counts array<int>"), "doc_id", 10).collect()
    want = {(i, k + 1, sum(c)) for i, ns in enumerate(many) for k, c in enumerate(plain_pack(ns, 10))}
    assert {(r.doc_id, r.chunk, len(re.findall(r"\w+", r.text))) for r in got} == want


def test_row_ids_are_consecutive(spark):
    df = spark.range(500).select((F.col("id") * 7 % 1000).alias("k"))
    got = [(r.k, r.chunk_id) for r in chunks.row_ids(df, "k").orderBy("k").collect()]
    assert [i for _, i in got] == list(range(500)) and got == sorted(got)


def test_ratio_bins(spark):
    n = Counter((r.kind, r.bin) for r in scores.ratio_bins(spark).collect())
    assert n == {("same", 0.5): 2, ("same", 0.6): 8, ("same", 0.7): 9, ("same", 0.8): 12, ("same", 0.9): 24, ("cross", 0.1): 17, ("cross", 0.2): 10, ("cross", 0.3): 8, ("cross", 0.4): 8, ("cross", 0.5): 2}


@pytest.mark.parametrize(("n", "end", "want"), [(0, "THE END.", 0), (499, "THE END.", 0), (600, "the end!!", 0.5), (1199, "THEEND", 1199 / 1200), (1200, "THE END.", 1), (1600, "THE END", 1), (1601, "THE END.", 1 - (1 / 1500) ** 0.5), (3100, "THE END.", 0), (3101, "THE END.", 0), (1300, "none", 0)])
def test_completeness(spark, n, end, want):
    assert value(spark, scores.completeness(F.lit(n), F.lit("story " + end))) == pytest.approx(want)


@pytest.mark.parametrize(("out", "want"), [("", "empty"), ("  \n", "empty"), ("as an ai, THE END.", "meta"), ("story", "no_end"), ("story THE END.  ", "ok"), ("the end.", "no_end")])
def test_validator(spark, out, want):
    assert value(spark, prompts.validated(F.lit(out))) == want


def test_cosine_and_spearman(spark):
    assert value(spark, scores.cosine(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(6.0), F.lit(8.0)))) == pytest.approx(1)
    assert value(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (None, 1.0)], "a double, b double")
    assert reports.spearman(df, "a", "b").first().spearman == pytest.approx(0.5)
    assert reports.spearman(df.withColumn("b", F.lit(1.0)), "a", "b").first().spearman is None


def test_water_fill(spark):
    def rounds(available, total):
        have, left = dict.fromkeys(sorted(available), 0), total
        while left > 0 and (active := [s for s in have if have[s] < available[s]]):
            share = -(-left // len(active))
            for s in active:
                take = min(share, available[s] - have[s], left)
                have[s] += take
                left -= take
        return have

    for available, total in (({"a": 5, "b": 100, "c": 100}, 60), ({"a": 1, "b": 2, "c": 3}, 100), ({"a": 10, "b": 10, "c": 10}, 10), ({"a": 0, "b": 7}, 3), ({"a": 3, "b": 50, "c": 9, "d": 50}, 61), ({"a": 1}, 0)):
        got = {r.subject: r.quota for r in pairs.water_fill(spark.createDataFrame(list(available.items()), "subject string, available long"), total).collect()}
        assert sum(got.values()) == min(total, sum(available.values())) and got == rounds(available, total)


def test_judged_halves_then_caps(spark):
    score = lambda base, on, t: value(spark, scores.judged(F.lit(base), F.lit(on), F.lit(t), F.lit("Ann"), F.lit("Tale")))
    assert score(8, False, "by ann\nTHE END.") == 2 and score(3, False, "by ann\nTHE END.") == 1 and score(8, True, "by ann\nTHE END.\n\n") == 2
    assert score(9, False, "x\nTHE END.") == 4 and score(9, True, "x\n THE END. \t\n") == 9 and score(9, True, "THE END. x") == 0


def test_subjects_of_one_author_give_no_pairs(spark):
    rows = [("s", "a", "b1", "x"), ("s", "a", "b2", "y"), ("t", "a", "b1", "x"), ("t", "a", "b2", "y"), ("t", "c", "b3", "z")]
    df = spark.createDataFrame(rows, "subject string, author_id string, book_id string, text string")
    assert [r.subject for r in pairs.positive_pairs(df).collect()] == ["t"]


def test_report_order(spark):
    rows = [("m", "10", st, k, 0.5) for st in ("FT", "Base") for k in ("cross", "same")] + [("m", "9", "Base", "cross", None), ("a", "x", "Base", "cross", 1.0)]
    got = reports.overall(spark.createDataFrame(rows, "model string, split string, status string, pair_type string, score double")).collect()
    assert [(r.model, r.split, r.status, r.pair_type) for r in got] == [("a", "x", "Base", "cross"), ("m", "9", "Base", "cross"), ("m", "10", "Base", "same"), ("m", "10", "Base", "cross"), ("m", "10", "FT", "same"), ("m", "10", "FT", "cross")]
    assert [r.comparisons for r in got][1] == 1
    books = spark.createDataFrame([(1, "t", "b", "s"), (2, "u", "a", "s"), (3, "t", "a", "s")], "book_id long, title string, author string, subject string")
    assert [r.book_id for r in catalog.in_report_order(books).collect()] == [3, 2, 1]


def graded(spark):
    rows, n = [], 0
    for s in range(2):
        for a in range(4):
            for b in range(2):
                for r in range(10):
                    for _ in range(2):
                        rows.append((n, f"s{s}", f"a{s}{a}", f"b{s}{a}{b}", r / 10, r > 0, f"text {n}"))
                        n += 1
    return spark.createDataFrame(rows, "chunk_id long, subject string, author_id string, book_id string, mask_ratio double, is_refilled boolean, text string")


def test_graded_pairs_keep_their_rules(spark):
    rows = graded(spark)
    by = {r.chunk_id: r for r in rows.collect()}
    out = pairs.graded_pairs(rows, scores.ratio_bins(spark), 12)
    got = out.collect()
    assert Counter((r.subject, r.score) for r in got) == {(s, x): 12 for s in ("s0", "s1") for x in (0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0)}
    assert len({(min(r.id1, r.id2), max(r.id1, r.id2)) for r in got}) == len(got)
    for r in got:
        x, y = by[r.id1], by[r.id2]
        assert x.subject == y.subject == r.subject and (x.author_id == y.author_id) == (r.score >= 0.5) and x.book_id != y.book_id
        if r.score in (0.0, 1.0):
            assert not x.is_refilled and not y.is_refilled
    ends = {i for r in got if r.score in (0.0, 1.0) for i in (r.id1, r.id2)}
    assert not ends & {i for r in got if 0.5 < r.score < 1 for i in (r.id1, r.id2)}
    assert pairs.balanced(out, 5).count() == 2 * 10 * 5


def test_graded_pairs_draw_from_all_chunks(spark):
    rows, n = [], 0
    for a in range(3):
        for b in range(2):
            for r, many in ((0.0, 100), (0.1, 60), (0.9, 60)):
                for _ in range(many):
                    rows.append((n, "s", f"a{a}", f"b{a}{b}", r, r > 0, f"text {n}"))
                    n += 1
    df = spark.createDataFrame(rows, "chunk_id long, subject string, author_id string, book_id string, mask_ratio double, is_refilled boolean, text string")
    got = pairs.graded_pairs(df, scores.ratio_bins(spark), 400).collect()
    by, again = {r[0]: r for r in rows}, pairs.graded_pairs(df.repartition(5), scores.ratio_bins(spark), 400).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    for score, most in ((1.0, 240), (0.0, 120)):  # 40 originals of a book, 60 of each of two neighbours
        assert len({i for r in got if r.score == score for i in (r.id1, r.id2)}) > most
    for side in ((0.6, 0.7, 0.8, 0.9), (0.1, 0.2, 0.3, 0.4)):  # 15 of each of six books, of each of three authors
        refilled = Counter(by[i][4] for i in {i for r in got if r.score in side for i in (r.id1, r.id2)})
        assert min(refilled[0.1], refilled[0.9]) > 6 * 15
    few = pairs.graded_pairs(df, scores.ratio_bins(spark), 60).collect()
    ends = {i for r in few if r.score in (0.0, 1.0) for i in (r.id1, r.id2)}
    fresh = {i for r in few if 0.5 < r.score < 1 for i in (r.id1, r.id2) if by[i][4] == 0}
    assert fresh and not ends & fresh
    # three authors: no one is left out of score 0
    assert {by[i][2] for r in few if r.score == 0.0 for i in (r.id1, r.id2)} == {"a0", "a1", "a2"}


def test_author_split_is_disjoint(spark):
    rows = graded(spark).unionByName(graded(spark).where("author_id = 'a00'").withColumn("subject", F.lit("s1")))
    got = splits.author_split(rows).collect()
    assert len({r.author_id for r in got}) == len(got) == 8 and next(r.split for r in got if r.author_id == "a00") == "train"


def test_least_reuse(spark):
    c = [("x", "s", "positive", f"t{i}", f"t{j}") for i in range(6) for j in range(i)]
    df = spark.createDataFrame(c, "split string, subject string, label string, sentence1 string, sentence2 string")
    got = pairs.select_with_least_reuse(df, spark.createDataFrame([("s", "positive", 3)], "subject string, label string, quota long")).collect()
    assert len(got) == 3 and max(Counter(t for r in got for t in (r.sentence1, r.sentence2)).values()) <= 2


def test_catalog_selection(spark):
    rows = [(1, "T", "Al", "P", 1, "en"), (2, "a", "X", "P", 5, "en"), (3, "b", "X", "P", 5, "en"), (4, "c", "X", "P", 9, "en"), (5, "d", "Y", "P", 9, "en"), (6, "e", "X", "P", 99, "fr"), (7, "f", "X", "P", 50, "en"), (None, "g", "X", "P", 60, "en")]
    df = spark.createDataFrame(rows, "book_id long, title string, author string, subject string, downloads long, language string")
    links = spark.createDataFrame([(i, "PLAIN TEXT") for i in range(1, 7)] + [(7, "audio")], "book_id long, kind string")
    targets = catalog.with_alias_targets(spark.createDataFrame([("T", "Alan")], "title string, author string"), spark.createDataFrame([("Alan", "Al")], "author string, alias string"))
    assert {r.book_id for r in catalog.select_books(df, targets, links, ["P"]).collect()} == {1, 2, 4}


def test_validation_options(spark):
    known = spark.createDataFrame([(1, "T", "A"), (2, "U", "B")], "book_id long, title string, author string")
    meta = spark.createDataFrame([(1, "t", "Z", True), (2, "U", "B2", True), (3, "x", "y", True), (1, "T", "A", False)], "book_id long, title string, author string, has_file boolean")
    aliases = spark.createDataFrame([("B", "B2")], "author string, alias string")
    assert Counter(r.status for r in catalog.validate(meta, known, aliases).collect()) == Counter(["author_mismatch", "ok", "not_in_catalog", "missing_file"])
    assert Counter(r.status for r in catalog.validate(meta, known, aliases, strict_author=False).collect())["ok"] == 2


def test_cycle_of_nothing(spark):
    p, c = spark.createDataFrame([], "p long, prompt string"), spark.createDataFrame([(0, "t")], "c long, text string")
    c = c.withColumn("author", F.lit("a"))
    assert prompts.cycle(p, c, 3, "author").count() == 0 and prompts.cycle(spark.createDataFrame([(0, "x")], "p long, prompt string"), c.limit(0), 3, "author").count() == 0


def test_generation_rounds(spark):
    spark.sparkContext.setCheckpointDir("/tmp/corpusloom-test-checkpoint")
    tasks = spark.createDataFrame([("a",), ("b",)], "author string")

    def produce(t, n):
        return t.select("author", (F.lit(n * 10) + F.monotonically_increasing_id() % 1).alias("arrival"), F.lit("ok").alias("reason"), F.lit(0.9).alias("score"))

    done = prompts.generate(tasks, produce, 2, 0.4697, 5, spark.createDataFrame([("a",)], "author string"))
    assert Counter(r.author for r in done.collect()) == {"a": 2, "b": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "book_1.txt").write_bytes(b"line\n\xffend")
    meta = spark.createDataFrame([(1, "book_1.txt"), (2, "book_2.txt")], "id long, filename string")
    assert [(r.id, r.text) for r in io.read_texts(spark, meta, str(tmp_path / "t")).collect()] == [(1, "line\nend")]
    assert [r.id for r in io.missing_files(spark, meta, str(tmp_path / "t")).collect()] == [2]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    assert [r.a for r in io.read_lines(spark, str(tmp_path / "l.jsonl"), "a long").collect()] == [1, 2]
    (tmp_path / "m.json").write_text('[{"id": 5}]')
    assert io.read_metadata(spark, str(tmp_path / "m.json")).first().id == 5
    names = io.numeric_splits(spark.createDataFrame([("b",), ("a",)], "split string")).orderBy("place").collect()
    assert [r.split for r in names] == ["a", "b"]
    assert prompts.step_schedule(1000, 8, 4, 2, 3, 10) == {"batch": 64, "steps_per_epoch": 15, "total_steps": 45, "eval_steps": 4}
