"""Pair and split queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import chunks as C
from ..operators import pairs as ops
from ..operators import splits
from ..operators.lineage import cut, kept
from ..registry import query
from .chunking import _UNION, rows_of
from .views import CHUNKS_SQL, chunks

_R = "r AS (SELECT unnest(generate_series(0, 9)) / 10.0::DOUBLE AS r)"
_BINS = f"""WITH {_R}, p AS (SELECT a.r AS r1, b.r AS r2, round(sqrt((1 - a.r * a.r) * (1 - b.r * b.r)), 12) AS v FROM r a, r b WHERE a.r <= b.r),
z AS (SELECT 'same' AS kind, r1, r2, round(0.5::DOUBLE + 0.5::DOUBLE * ((greatest(v, 0.19::DOUBLE) - 0.19::DOUBLE) / 0.81::DOUBLE), 9) AS s FROM p UNION ALL SELECT 'cross', r1, r2, round(0.5::DOUBLE * (1 - (greatest(v, 0.19::DOUBLE) - 0.19::DOUBLE) / 0.81::DOUBLE), 9) FROM p WHERE r1 > 0 AND r2 > 0)
SELECT kind, r1, r2, greatest(0.1::DOUBLE, least(0.9::DOUBLE, round_even(s * 10, 0) / 10)) AS bin FROM z"""


@query(_BINS.replace(_R, f"""{CHUNKS_SQL}, r AS (SELECT DISTINCT round(mask_ratio, 1) AS r FROM chunks)"""))
def ratio_bins(spark, sf):
    """The bins of all pairs of ratios that the chunks have."""
    own = chunks(spark, sf).select(F.round("mask_ratio", 1).alias("r")).distinct()
    return scores.ratio_bins(spark, own)


@query(f"""WITH {CHUNKS_SQL}, p AS (SELECT a.doc_id, b.doc_id AS other, a.author_id = b.author_id AS same, sqrt((1 - a.mask_ratio * a.mask_ratio) * (1 - b.mask_ratio * b.mask_ratio)) AS v FROM chunks a JOIN chunks b ON b.doc_id = a.doc_id + 1),
z AS (SELECT *, CASE WHEN same THEN 0.5::DOUBLE + 0.5::DOUBLE * (greatest(v, 0.19::DOUBLE) - 0.19::DOUBLE) / 0.81::DOUBLE ELSE 0.5::DOUBLE * (1 - (greatest(v, 0.19::DOUBLE) - 0.19::DOUBLE) / 0.81::DOUBLE) END AS s FROM p)
SELECT doc_id, other, round(v, 9) AS integrity, round(s, 9) AS score, greatest(0.1::DOUBLE, least(0.9::DOUBLE, round_even(round(s, 9) * 10, 0) / 10)) AS bin FROM z""")
def chunk_pair_scores(spark, sf):
    """Each chunk and the next one: what their ratios leave in common, the graded
    score of one author or of two, and its bin."""
    own = chunks(spark, sf).select("doc_id", "author_id", "mask_ratio")
    other = own.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("other"), F.col("author_id").alias("author2"), F.col("mask_ratio").alias("ratio2"))
    v = scores.integrity(F.col("mask_ratio"), F.col("ratio2"))
    score = F.round(F.when(F.col("author_id") == F.col("author2"), scores.zoned(v, True)).otherwise(scores.zoned(v, False)), 9)
    return own.join(other, "doc_id").select("doc_id", "other", F.round(v, 9).alias("integrity"), score.alias("score"), scores.to_bin(score).alias("bin"))


_POS = f"""WITH {CHUNKS_SQL}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, author_id, book_id ORDER BY text) AS place FROM (SELECT DISTINCT subject, author_id, book_id, text FROM chunks WHERE length(text) >= 50)) WHERE place <= 50)
SELECT a.subject, a.author_id AS author1, a.author_id AS author2, md5(a.text) AS key1, md5(b.text) AS key2 FROM own a JOIN own b USING (subject, author_id) WHERE a.book_id < b.book_id AND a.subject IN (SELECT subject FROM own GROUP BY subject HAVING count(DISTINCT author_id) >= 2)"""
_NEG = f"""WITH {CHUNKS_SQL}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, author_id ORDER BY md5('42:' || text), text) AS place FROM (SELECT DISTINCT subject, author_id, text FROM chunks WHERE length(text) >= 50)) WHERE place <= 50),
ring AS (SELECT subject, author_id, row_number() OVER (PARTITION BY subject ORDER BY author_id) - 1 AS i, count(*) OVER (PARTITION BY subject) AS n FROM (SELECT DISTINCT subject, author_id FROM own))
SELECT a.subject, a.author_id AS author1, b.author_id AS author2, md5(a.text) AS key1, md5(b.text) AS key2 FROM own a JOIN ring x USING (subject, author_id) JOIN ring y ON y.subject = x.subject AND y.i = (x.i + 1) % x.n AND y.author_id <> x.author_id JOIN own b ON b.subject = y.subject AND b.author_id = y.author_id"""


def _eligible(spark, sf):
    return chunks(spark, sf).where(F.length("text") >= 50)


def _keys(pairs):
    return pairs.select("subject", "author1", "author2", F.col("sentence1").alias("key1"), F.col("sentence2").alias("key2"))


@query(_POS)
def eval_positive_pairs(spark, sf):
    return _keys(ops.positive_pairs(_eligible(spark, sf), digests=True))


@query(_NEG)
def eval_ring_negatives(spark, sf):
    return _keys(ops.ring_negatives(_eligible(spark, sf), digests=True))


_QUOTA = f"""WITH RECURSIVE pos AS ({_POS}), neg AS ({_NEG}), available AS (SELECT subject, sum(p) AS positives, sum(n) AS negatives, sum(p) + sum(n) AS available FROM (SELECT subject, 1 AS p, 0 AS n FROM pos UNION ALL SELECT subject, 0, 1 FROM neg) GROUP BY subject),
one AS (SELECT list(subject ORDER BY subject) AS s, list(available ORDER BY subject) AS a, count(*) AS k FROM available),
step AS (SELECT 0 AS i, 1 AS pos, s, a, k, least(3000, list_sum(a))::BIGINT AS rest, CAST(NULL AS BIGINT) AS share, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS given FROM one
  UNION ALL SELECT i + 1, CASE WHEN pos = k THEN 1 ELSE pos + 1 END, s, a, k, rest - take, now, list_transform(given, lambda x, j: CASE WHEN j = pos THEN x + take ELSE x END)
  FROM (SELECT *, CASE WHEN a[pos] > given[pos] THEN CAST(least(now, a[pos] - given[pos], rest) AS BIGINT) ELSE 0 END AS take FROM
    (SELECT *, CASE WHEN pos = 1 THEN CAST(ceil(rest / greatest(1, len(list_filter(range(1, k + 1), lambda j: a[j] > given[j])))) AS BIGINT) ELSE share END AS now FROM step WHERE rest > 0))),
q AS (SELECT subject, positives, negatives, x.quota FROM available JOIN (SELECT unnest(s) AS subject, unnest(given) AS quota FROM (SELECT s, given FROM step ORDER BY i DESC LIMIT 1)) x USING (subject))"""


def _available(spark, sf):
    own = _eligible(spark, sf)
    both = ops.positive_pairs(own).select("subject", F.lit(1).alias("p"), F.lit(0).alias("n")).unionByName(ops.ring_negatives(own).select("subject", F.lit(0).alias("p"), F.lit(1).alias("n")))
    return both.groupBy("subject").agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.count("*").alias("available"))


def _quotas(spark, sf):
    available = _available(spark, sf)
    both = ops.water_fill(available, 3000).join(available, "subject")
    pos, neg = ops.halves(F.col("quota"), F.col("positives"), F.col("negatives"))
    return both.select("subject", "quota", pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"))


@query(_QUOTA + """ SELECT subject, CAST(quota AS BIGINT) AS quota, CAST(least(positives, quota - least(negatives, quota - least(positives, (quota + 1) // 2))) AS BIGINT) AS n_pos, CAST(least(negatives, quota - least(positives, (quota + 1) // 2)) AS BIGINT) AS n_neg FROM q""")
def quota_waterfill(spark, sf):
    return _quotas(spark, sf)


#: Pairs that are wanted of a split, the splits that chunks are dealt to, and the passes
#: of a selection.
_A_SPLIT, _N_SPLITS, _PASSES = 3000, 6, 20
_IN_SPLITS = CHUNKS_SQL.replace("'subject' ||", f"CAST(500 * (1 + doc_id % {_N_SPLITS}) AS VARCHAR) || '|subject' ||")
# every pair of texts is a candidate once; of each split up to so many, dealt to its subjects in rounds
_CANDIDATES = f"""pos AS (SELECT DISTINCT subject, key1, key2 FROM ({_POS})), neg AS (SELECT DISTINCT subject, key1, key2 FROM ({_NEG})),
available AS (SELECT split_part(subject, '|', 1) AS split, split_part(subject, '|', 2) AS subject, sum(p) AS positives, sum(n) AS negatives, sum(p) + sum(n) AS available FROM (SELECT subject, 1 AS p, 0 AS n FROM pos UNION ALL SELECT subject, 0, 1 FROM neg) GROUP BY ALL),
one AS (SELECT split, list(subject ORDER BY subject) AS s, list(available ORDER BY subject) AS a, count(*) AS k FROM available GROUP BY split),
step AS (SELECT split, 0 AS i, 1 AS pos, s, a, k, least({_A_SPLIT}, list_sum(a))::BIGINT AS rest, CAST(NULL AS BIGINT) AS share, list_transform(a, lambda x: CAST(0 AS BIGINT)) AS given FROM one
  UNION ALL SELECT split, i + 1, CASE WHEN pos = k THEN 1 ELSE pos + 1 END, s, a, k, rest - take, now, list_transform(given, lambda x, j: CASE WHEN j = pos THEN x + take ELSE x END)
  FROM (SELECT *, CASE WHEN a[pos] > given[pos] THEN CAST(least(now, a[pos] - given[pos], rest) AS BIGINT) ELSE 0 END AS take FROM
    (SELECT *, CASE WHEN pos = 1 THEN CAST(ceil(rest / greatest(1, len(list_filter(range(1, k + 1), lambda j: a[j] > given[j])))) AS BIGINT) ELSE share END AS now FROM step WHERE rest > 0))),
q AS (SELECT split, subject, positives, negatives, x.quota FROM available JOIN (SELECT split, unnest(s) AS subject, unnest(given) AS quota FROM (SELECT split, s, arg_max(given, i) AS given FROM step GROUP BY split, s)) x USING (split, subject)),
got AS (SELECT split, subject, unnest(['positive', 'negative']) AS label, unnest([CAST(least(positives, quota - least(negatives, quota - least(positives, (quota + 1) // 2))) AS BIGINT), CAST(least(negatives, quota - least(positives, (quota + 1) // 2)) AS BIGINT)]) AS n FROM q)"""
# a pair is surely there to be taken if its texts have no more candidates than passes, in all of the split
_SURE = f""", c AS (SELECT split_part(subject, '|', 1) AS split, split_part(subject, '|', 2) AS subject, label, key1, key2 FROM (SELECT *, 'positive' AS label FROM pos UNION ALL SELECT *, 'negative' FROM neg)),
degree AS (SELECT split, k, count(*) AS d FROM (SELECT split, unnest([key1, key2]) AS k FROM c) GROUP BY ALL),
sure AS (SELECT c.split, subject, label, count(*) AS sure FROM c JOIN degree a ON a.split = c.split AND a.k = key1 JOIN degree b ON b.split = c.split AND b.k = key2 WHERE a.d <= {_PASSES} AND b.d <= {_PASSES} GROUP BY c.split, subject, label)"""
_TOTALS = _CANDIDATES.replace(CHUNKS_SQL, _IN_SPLITS) + _SURE


def _split_candidates(spark, sf):
    """(split, subject, label, sentence1, sentence2): the pairs of six splits of the
    chunks, each once, by the texts' digests."""
    split = (500 * (1 + F.col("doc_id") % _N_SPLITS)).cast("string")
    own = _eligible(spark, sf).withColumn("subject", F.concat_ws("|", split, "subject"))
    both = ops.positive_pairs(own, digests=True).withColumn("label", F.lit("positive")).unionByName(ops.ring_negatives(own, digests=True).withColumn("label", F.lit("negative")))
    part = F.split("subject", r"\|")
    return both.select(part[0].alias("split"), part[1].alias("subject"), "label", "sentence1", "sentence2").distinct()


def _split_quotas(candidates):
    available = candidates.groupBy("split", "subject").agg(F.count_if(F.col("label") == "positive").alias("positives"), F.count_if(F.col("label") == "negative").alias("negatives"), F.count("*").alias("available"))
    both = ops.water_fill(available, _A_SPLIT, "split").join(available, ["split", "subject"])
    pos, neg = ops.halves(F.col("quota"), F.col("positives"), F.col("negatives"))
    return both.select("split", "subject", F.explode(F.create_map(F.lit("positive"), pos.cast("long"), F.lit("negative"), neg.cast("long"))).alias("label", "quota"))


@query("WITH RECURSIVE " + _TOTALS + " SELECT split, subject, label, n AS quota, CASE WHEN coalesce(sure, 0) >= n THEN n END AS n, true AS enough, true AS known_once FROM got LEFT JOIN sure USING (split, subject, label) WHERE n > 0")
def reuse_min_totals(spark, sf):
    """What holds of the selection whatever its order.  Of each split, subject and
    label there are as many pairs as its quota says, or fewer where every other
    candidate has a text that was used in all passes by its group and those before it
    (``enough``); each is a candidate, once.  ``n`` is their number where it does not
    depend on the order, or where it is not enough."""
    candidates = kept(_split_candidates(spark, sf))
    quotas = kept(_split_quotas(candidates))
    chosen = kept(ops.select_with_least_reuse(candidates, quotas, _PASSES))
    group = ["split", "subject", "label"]
    turn = F.concat_ws("\0", "subject", F.when(F.col("label") == "positive", "0").otherwise("1"))
    key = lambda df: df.select(*group, turn.alias("turn"), F.col("sentence1").alias("a"), F.col("sentence2").alias("b"))
    ends = lambda df: df.select("split", "turn", F.explode(F.array("a", "b")).alias("v"))
    used = ends(key(chosen)).groupBy("split", "v", "turn").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("split", "v").orderBy("turn")
    full = used.withColumn("n", F.sum("n").over(upto)).where(F.col("n") >= _PASSES).groupBy("split", "v").agg(F.min("turn").alias("since"))
    often = kept(ends(key(candidates)).groupBy("split", "v").agg(F.count("*").alias("d")).join(full, ["split", "v"], "left"))
    pairs = kept(key(chosen).groupBy(*group, "a", "b").agg(F.count("*").alias("times")))
    every = key(candidates).join(pairs, [*group, "a", "b"], "left")
    for v in ("a", "b"):
        every = every.join(often.withColumnsRenamed({"v": v, "d": f"d_{v}", "since": f"since_{v}"}), ["split", v], "left")
    is_open = F.col("times").isNull() & ~F.coalesce(F.least("since_a", "since_b") <= F.col("turn"), F.lit(False))
    got = every.groupBy(*group).agg(F.count("times").alias("known"), F.count_if(is_open).alias("open"), F.count_if(F.greatest("d_a", "d_b") <= _PASSES).alias("sure"))
    taken = pairs.groupBy(*group).agg(F.count("*").alias("n"), F.max("times").alias("times"))
    got = quotas.where("quota > 0").join(got, group, "left").join(taken, group, "left").na.fill(0, ["n", "known", "sure"])
    got = got.withColumn("enough", (F.col("n") == F.col("quota")) | (F.col("n") < F.col("quota")) & (F.col("open") == 0))
    known_once = (F.col("times") == 1) & (F.col("known") == F.col("n"))
    return got.select(*group, "quota", F.when((F.col("sure") >= F.col("quota")) | ~F.col("enough"), F.col("n")).alias("n"), "enough", F.coalesce(known_once, F.lit(False)).alias("known_once"))


@query()
def reuse_min_selection(spark, sf):
    candidates = kept(_split_candidates(spark, sf))
    chosen = kept(ops.select_with_least_reuse(candidates, _split_quotas(candidates), _PASSES))
    # the chosen texts come back by their digest, of which there are as few as pairs are wanted
    few = chosen.select(F.explode(F.array("sentence1", "sentence2")).alias("digest")).distinct()
    texts = _eligible(spark, sf).select(F.md5("text").alias("digest"), "text").join(F.broadcast(few), "digest", "left_semi").groupBy("digest").agg(F.any_value("text").alias("text"))
    for n in ("sentence1", "sentence2"):
        chosen = chosen.join(texts.withColumnsRenamed({"digest": n, "text": f"{n}_"}), n).drop(n).withColumnRenamed(f"{n}_", n)
    return chosen


def _graded(spark, sf, target=60):
    """Chunks, by their texts' digests, and their graded pairs."""
    own = C.originals_and_refilled(C.digested(chunks(spark, sf).withColumnRenamed("doc_id", "index")))
    rows = cut(C.row_ids(own, "index", "is_refilled"))
    return rows, ops.graded_pairs(rows, scores.ratio_bins(spark), target)


@query()
def graded_pairs(spark, sf):
    rows, pairs = _graded(spark, sf)
    own = ops.balanced(pairs, 40)
    ids = own.select(F.explode(F.array("id1", "id2")).alias("chunk_id")).distinct()
    texts = C.texts_of(chunks(spark, sf).withColumnRenamed("doc_id", "index"))
    return ops.with_texts(own, rows.join(ids, "chunk_id", "left_semi").drop("text").join(texts, ["index", "is_refilled"]))


# all pairs that a score may have, counted: those of refilled chunks surely can be drawn, while
# originals may have gone to the extremes; a score is short only where it has no pairs left
_GRADED = _UNION + f""", bins AS ({_BINS}), k AS (SELECT subject, author_id, book_id, round(mask_ratio, 1) AS r, is_refilled AS f, count(*) AS n FROM rows_ WHERE (mask_ratio > 0) = is_refilled GROUP BY ALL),
both_ AS (SELECT a.subject, a.author_id = b.author_id AS same, least(a.r, b.r) AS r1, greatest(a.r, b.r) AS r2, a.f AND b.f AS fresh, NOT a.f AND NOT b.f AS plain, a.n * b.n AS n FROM k a JOIN k b ON a.subject = b.subject AND (a.author_id < b.author_id OR a.author_id = b.author_id AND a.book_id < b.book_id)),
possible AS (SELECT subject, CASE WHEN same THEN 1.0 ELSE 0.0 END::DOUBLE AS score, n, n AS sure FROM both_ WHERE plain
  UNION ALL SELECT subject, round(bin, 1), n, CASE WHEN fresh THEN n ELSE 0 END FROM both_ JOIN bins ON kind = CASE WHEN same THEN 'same' ELSE 'cross' END AND abs(bins.r1 - both_.r1) < 0.01 AND abs(bins.r2 - both_.r2) < 0.01 WHERE round(bin, 1) NOT IN (0.0, 0.5, 1.0)),
s AS (SELECT DISTINCT subject FROM rows_), x AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0])::DOUBLE AS score),
n AS (SELECT s.subject, x.score, coalesce(sum(n), 0) AS n, coalesce(sum(sure), 0) AS sure FROM s CROSS JOIN x LEFT JOIN possible p ON p.subject = s.subject AND p.score = x.score GROUP BY ALL)"""


@query(_GRADED + " SELECT subject, score, CAST(CASE WHEN least(n, 40) = least(sure, 40) THEN least(n, 40) END AS BIGINT) AS n, true AS enough, n > 0 AS distinct_pairs, n > 0 AS right_pairs FROM n")
def graded_pairs_totals(spark, sf):
    """What holds of the graded pairs whatever the draws.  Of each subject and score
    there are 40 pairs, or all that can be made of its chunks where those are fewer
    (``n``; null where that depends on which originals the extremes took: then there are
    at least as many as can be made of refilled chunks, ``enough``).  No pair comes
    twice, and each obeys its score's rules (authors, books, ratios of the bin)."""
    rows, pairs = _graded(spark, sf)
    own = ops.balanced(pairs, 40)
    side = lambda n: rows.select(F.col("chunk_id").alias(f"id{n}"), *(F.col(c).alias(f"{c}{n}") for c in ("author_id", "book_id", "mask_ratio", "is_refilled")), F.col("subject").alias(f"subject{n}"))
    both = own.join(side(1), "id1").join(side(2), "id2")
    same = F.col("author_id1") == F.col("author_id2")
    kind = F.when(F.col("score") > 0.5, "same").otherwise("cross")
    r = lambda f: F.round(f("mask_ratio1", "mask_ratio2"), 1)
    bins = F.broadcast(scores.ratio_bins(spark).select("kind", F.round("r1", 1).alias("r1"), F.round("r2", 1).alias("r2"), F.round("bin", 1).alias("bin")))  # 100 rows
    both = both.withColumn("kind", kind).withColumn("r1", r(F.least)).withColumn("r2", r(F.greatest)).join(bins, ["kind", "r1", "r2"], "left")
    ends = F.col("score").isin(0.0, 1.0)
    fits = F.when(ends, ~F.col("is_refilled1") & ~F.col("is_refilled2")).otherwise(F.col("bin") == F.round("score", 1))
    right = fits & (same == (F.col("score") > 0.5)) & (F.col("book_id1") != F.col("book_id2")) & (F.col("subject1") == F.col("subject")) & (F.col("subject2") == F.col("subject"))
    key = F.concat_ws(":", F.least("id1", "id2").cast("string"), F.greatest("id1", "id2").cast("string"))
    got = both.groupBy("subject", "score").agg(F.count("*").alias("n"), F.countDistinct(key).alias("n_distinct"), F.count_if(right).alias("n_right"))
    possible = _possible(rows, bins)
    every = rows.select("subject").distinct().withColumn("score", F.explode(F.array(*map(F.lit, [0.0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9, 1.0]))))
    every = every.join(possible, ["subject", "score"], "left").join(got, ["subject", "score"], "left").na.fill(0, ["n", "most", "sure"])
    fixed = F.least("most", F.lit(40)) == F.least("sure", F.lit(40))
    no = lambda c: F.coalesce(c, F.lit(False))
    enough = (F.col("n") >= F.least("sure", F.lit(40))) & (F.col("n") <= F.least("most", F.lit(40)))
    return every.select("subject", "score", F.when(fixed, F.col("n")).alias("n"), enough.alias("enough"), no(F.col("n_distinct") == F.col("n")).alias("distinct_pairs"), no(F.col("n_right") == F.col("n")).alias("right_pairs"))


def _possible(rows, bins):
    """(subject, score, most, sure): how many pairs a score can have of all chunks,
    and of refilled ones alone (the extremes: of originals)."""
    kinds = rows.where((F.col("mask_ratio") > 0) == F.col("is_refilled")).groupBy("subject", "author_id", "book_id", F.round("mask_ratio", 1).alias("r"), "is_refilled").agg(F.count("*").alias("n"))
    side = lambda n: kinds.select("subject", F.col("author_id").alias(f"author{n}"), F.col("book_id").alias(f"book{n}"), F.col("r").alias(f"ratio{n}"), F.col("is_refilled").alias(f"f{n}"), F.col("n").alias(f"n{n}"))
    both = side(1).join(side(2), "subject").where("author1 < author2 or (author1 = author2 and book1 < book2)")
    both = both.select("subject", F.when(F.col("author1") == F.col("author2"), "same").otherwise("cross").alias("kind"), F.least("ratio1", "ratio2").alias("r1"), F.greatest("ratio1", "ratio2").alias("r2"), (F.col("f1") & F.col("f2")).alias("fresh"), (~F.col("f1") & ~F.col("f2")).alias("plain"), (F.col("n1") * F.col("n2")).alias("n"))
    ends = both.where("plain").select("subject", F.when(F.col("kind") == "same", 1.0).otherwise(0.0).alias("score"), "n", F.col("n").alias("sure"))
    between = both.join(bins, ["kind", "r1", "r2"]).where("bin not in (0.0, 0.5, 1.0)").select("subject", F.col("bin").alias("score"), "n", F.when(F.col("fresh"), F.col("n")).otherwise(0).alias("sure"))
    return ends.unionByName(between).groupBy("subject", "score").agg(F.sum("n").alias("most"), F.sum("sure").alias("sure"))


@query(f"WITH {CHUNKS_SQL} SELECT subject, mask_ratio, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY subject, mask_ratio ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS place FROM chunks) WHERE place <= 7")
def balanced_sample(spark, sf):
    return ops.capped(chunks(spark, sf), ["subject", "mask_ratio"], [ops.shuffled(42, "doc_id"), F.col("doc_id")], 7).select("subject", "mask_ratio", "doc_id")


_SPLIT = _UNION.replace("WITH ", "WITH RECURSIVE ", 1) + """, moved AS (SELECT CASE WHEN author_id IN ('src1', 'src6') AND doc_id % 2 = 0 THEN 'subject3' ELSE subject END AS subject, author_id, book_id FROM rows_),
k AS (SELECT author_id, count(DISTINCT subject) AS k FROM moved GROUP BY author_id),
o AS (SELECT subject, author_id, count(*) AS c, row_number() OVER (PARTITION BY subject ORDER BY count(DISTINCT book_id), md5('42:' || author_id)) AS i, sum(count(*)) OVER (PARTITION BY subject) AS total FROM moved WHERE author_id IN (SELECT author_id FROM k WHERE k = 1) GROUP BY subject, author_id),
cost AS (SELECT subject, 0::BIGINT AS i, NULL::VARCHAR AS author_id, 0::BIGINT AS best, [0, 0, 0]::DOUBLE[] AS have FROM (SELECT DISTINCT subject FROM o)
  UNION ALL SELECT subject, i, author_id, best, list_transform(have, lambda x, n: CASE WHEN n = best THEN x + c ELSE x END) FROM (
    SELECT subject, o.i, o.author_id, o.c, have, list_position(costs, list_min(costs))::BIGINT AS best FROM (
      SELECT w.subject, o.i, o.author_id, o.c, w.have, list_transform([1, 2, 3], lambda t: list_sum(list_transform([1, 2, 3], lambda j: pow((w.have[j] + CASE WHEN j = t THEN o.c ELSE 0 END - ([0.76, 0.12, 0.12]::DOUBLE[])[j] * o.total) / greatest(([0.76, 0.12, 0.12]::DOUBLE[])[j] * o.total, 1), 2)))) AS costs FROM cost w JOIN o ON o.subject = w.subject AND o.i = w.i + 1) o)),
dealt AS (SELECT author_id, ['train', 'val', 'test'][best] AS split FROM cost WHERE author_id IS NOT NULL UNION ALL SELECT author_id, 'train' FROM k WHERE k > 1)"""


def _dealt(spark, sf):
    """Authors' splits; two authors have chunks in a second subject too."""
    moved = F.when(F.col("author_id").isin("src1", "src6") & (F.col("index") % 2 == 0), "subject3").otherwise(F.col("subject"))
    return splits.author_split(rows_of(spark, sf).withColumn("subject", moved))


@query(_SPLIT + " SELECT author_id, split FROM dealt")
def greedy_author_split(spark, sf):
    return _dealt(spark, sf)


@query(_UNION + """, s AS (SELECT DISTINCT author_id, CASE WHEN mask_ratio < 0.3 THEN 'train' WHEN mask_ratio < 0.7 THEN 'val' ELSE 'test' END AS split FROM rows_ WHERE is_refilled)
SELECT split1, split2, count(DISTINCT a.author_id) AS n_authors FROM (VALUES ('train', 'val'), ('test', 'train'), ('test', 'val')) t(split1, split2) LEFT JOIN s a ON a.split = split1 AND EXISTS (SELECT 1 FROM s b WHERE b.split = split2 AND b.author_id = a.author_id) GROUP BY ALL""")
def split_leakage(spark, sf):
    split = F.when(F.col("mask_ratio") < 0.3, "train").when(F.col("mask_ratio") < 0.7, "val").otherwise("test")
    return splits.leakage(rows_of(spark, sf).where("is_refilled").select("author_id", split.alias("split")).distinct())


@query(_SPLIT + """ SELECT split1, split2, count(DISTINCT a.author_id) AS n_authors FROM (VALUES ('train', 'val'), ('test', 'train'), ('test', 'val')) t(split1, split2) LEFT JOIN dealt a ON a.split = split1 AND EXISTS (SELECT 1 FROM dealt b WHERE b.split = split2 AND b.author_id = a.author_id) GROUP BY ALL""")
def author_split_leakage(spark, sf):
    return splits.leakage(_dealt(spark, sf))
